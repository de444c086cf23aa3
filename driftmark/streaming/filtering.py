"""The HMM on streams that never end: what is known of the state at each place from all that came before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.hmm import Hmm, Moves
from ..ship import ship_package

STATES = "key long, pos long, state int, p double"


def forward_rows(model: Hmm, moves: Moves, words: np.ndarray, alpha: np.ndarray | None) -> np.ndarray:
    """Scaled forward values at each word, going on from alpha (None: the stream's begin). Where no state can have a word, the values before it stay."""
    out = np.empty((len(words), model.n))
    for t, w in enumerate(words):
        row = (model.pi if alpha is None else moves.forward(alpha)) * model.b[:, w]
        total = row.sum()
        if total > 0:
            alpha = row / total
        elif alpha is None:
            alpha = model.pi / model.pi.sum()
        out[t] = alpha
    return out


def filtered_states(observations: DataFrame, model: Hmm) -> DataFrame:
    """(key, pos, state, p) for a stream of (key, pos, word_id): of each stream (key) the likeliest state at each place and its probability; the lowest of equal ones.

    Carried from batch to batch is one vector of N numbers and the last place of each key, so a restart goes on from the checkpoint. Within a key places have to
    come in order from batch to batch; inside a batch they are sorted, and what comes at or before a place that was passed already is left out. A null word or key is left out.
    """
    ship_package(observations.sparkSession)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("pos").drop_duplicates("pos")
        alpha, last = (np.array(state.get[0]), state.get[1]) if state.exists else (None, -(2**63))
        rows = rows[rows["pos"] > last]
        if len(rows):
            found = forward_rows(model, Moves(model.a), rows["word_id"].to_numpy(), alpha)
            state.update((found[-1].tolist(), int(rows["pos"].iloc[-1])))
            yield pd.DataFrame({"key": key[0], "pos": rows["pos"].to_numpy(), "state": found.argmax(1).astype(np.int32), "p": found.max(1)})

    kept = observations.select(F.col("key").cast("long").alias("key"), "pos", F.col("word_id").cast("int").alias("word_id")).dropna()
    return kept.groupBy("key").applyInPandasWithState(follow, STATES, "alpha array<double>, last long", "append", GroupStateTimeout.NoTimeout)
