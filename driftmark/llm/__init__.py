"""Operators for preparing training data: mixing, scoring, counting, removing repeats, decontaminating, finding PII."""
