"""Mate pairing over an unbounded stream of reads, as the batch operator does it at rest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    waiting = state.get[0] if state.exists else None
    out = []
    rows = pd.concat(list(batches)).sort_values("rec_idx")
    for rec in rows["rec_idx"].tolist():
        if waiting is None:
            waiting = rec
        else:
            out.append((key[0], waiting, rec))
            waiting = None
    if waiting is None:
        if state.exists:
            state.remove()
    else:
        state.update((int(waiting),))
    yield pd.DataFrame(out, columns=["qname", "rec_1", "rec_2"])


def stream_pairs(reads: DataFrame) -> DataFrame:
    """Pairs (qname, rec_1, rec_2): a read waits in state for the next one of its name."""
    return reads.select("qname", "rec_idx").groupBy("qname").applyInPandasWithState(_pair, "qname string, rec_1 long, rec_2 long", "waiting long", "append", GroupStateTimeout.NoTimeout)
