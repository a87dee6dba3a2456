"""Streaming forms: rates as details arrive, and a top-k that is kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from provenant.operators import rates as A


def running_rates(details: DataFrame, hit: Column, key: str = "record_index") -> DataFrame:
    """The rate of each record so far; for update or complete mode."""
    return details.groupBy(key).agg(A.share(hit).alias("rate"), F.count("*").alias("n"))


def windowed_rates(events: DataFrame, time: str, hit: Column, width: str, late: str) -> DataFrame:
    """Rates by event-time window; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width)).agg(A.share(hit).alias("rate"), F.count("*").alias("n"))


def deduplicated(rows: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    """One row for each key within the watermark: what retries sent twice."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def running_topk(scored: DataFrame, k: int) -> DataFrame:
    """(probe_id, entry_index, score, rank): the top k of each probe after each batch, from a state of k rows a probe."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(zip(*state.get, strict=True)) if state.exists else [], columns=["entry_index", "score"])
        rows = pd.concat([held, *(p[["entry_index", "score"]] for p in parts)]) if state.exists else pd.concat([p[["entry_index", "score"]] for p in parts])
        best = rows.sort_values(["score", "entry_index"], ascending=[False, True]).drop_duplicates("entry_index").head(k)
        state.update((best["entry_index"].tolist(), best["score"].tolist()))
        yield best.assign(probe_id=key[0], rank=range(1, len(best) + 1))[["probe_id", "entry_index", "score", "rank"]]

    return scored.groupBy("probe_id").applyInPandasWithState(step, "probe_id bigint, entry_index bigint, score double, rank int", "entries array<bigint>, scores array<double>", "update", GroupStateTimeout.NoTimeout)
