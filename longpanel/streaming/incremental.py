"""An extension for streams: history features kept up to date one report at a time.

The batch operators are the reference semantics; this gives the same running mean, exponentially
weighted mean and missing streak for rows that arrive in order of time within an entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "entity long, ord long, y double, running_mean double, ewm double, streak int"
STATE = "n long, total double, ewm double, streak int"


def incremental_history(rows: DataFrame, k: int = 8, alpha: float = 2 / 9) -> DataFrame:
    """rows (entity long, ord long, y double or null for a missed prompt) with features of earlier rows."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, ewm, streak = state.get if state.exists else (0, 0.0, 0.0, 0)
        out = []
        for y, order in sorted(((r.y, r.ord) for b in batches for r in b.itertuples()), key=lambda r: r[1]):
            out.append((key[0], order, y, total / n if n else None, ewm if n >= k else None, streak))
            if pd.isna(y):
                streak += 1
                continue
            n, total, streak = n + 1, total + y, 0
            ewm = total / n if n <= k else ewm + alpha * (y - ewm)
        state.update((n, total, ewm, streak))
        yield pd.DataFrame(out, columns=["entity", "ord", "y", "running_mean", "ewm", "streak"])

    return rows.groupBy("entity").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
