"""driftmark: a PySpark-native temporal text-mining engine."""
