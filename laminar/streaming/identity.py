"""Assignment to clusters as a stream: the same store as in batch, kept as state by group.

Rows of a micro-batch are sorted by arrival before they are folded, so batch and stream agree if micro-batches come in that order. State is the group's
unit vectors, cluster numbers and sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from laminar.functions import vectors as V
from laminar.operators.identity import THRESHOLD, Store


def assign_stream(vectors: DataFrame, group: str, order: str, threshold: float = THRESHOLD, mode: str = "complete_linkage") -> DataFrame:
    """Streaming vectors(group, order bigint, v) -> group, order, cluster, similarity, is_new, in append mode."""
    kind = vectors.schema[group].dataType.simpleString()

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        store = Store()
        if state.exists:
            dim, units, of, sums = state.get
            store = Store(np.frombuffer(units).reshape(-1, dim), np.frombuffer(of, np.int64), np.frombuffer(sums).reshape(-1, dim).copy())
        rows = []
        pdf = pd.concat(list(batches)).sort_values(order)
        for o, v in zip(pdf[order], pdf["v"], strict=True):
            rows.append((key[0], o, *store.assign(v, threshold, mode)))
        state.update((store.units.shape[1], store.units.tobytes(), store.of.tobytes(), store.sums.tobytes()))
        yield pd.DataFrame(rows, columns=[group, order, "cluster", "similarity", "is_new"])

    rows = vectors.select(group, F.col(order).cast("bigint").alias(order), V.doubles(F.col("v")).alias("v"))
    return rows.groupBy(group).applyInPandasWithState(
        fold, f"`{group}` {kind}, `{order}` bigint, cluster int, similarity double, is_new boolean", "dim int, units binary, of binary, sums binary", "append", GroupStateTimeout.NoTimeout
    )
