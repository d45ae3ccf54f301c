"""Sources that fall silent: told once for each silence, and once more when the source is heard again.

A source is silent when nothing came from it for longer than a limit; one that never sent anything is not. In a
table and in a stream the same rows come out: source, kind (silent or recovered), since (when it was last heard), and
at (when the limit passed, or when it was heard again). Rows without a source or a time are left out.

Times go into cells as wide as the limit. A pause longer than the limit crosses the border of a cell, so of a cell only
the first and the last time matter, and a source that sends all the time costs two numbers a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.metrics import named

HOUR = 3_600_000_000  # microseconds
OUT = "source string, kind string, since long, at long"


def silences(events: DataFrame, source: str, time: str, now: Column, hours: int = 26) -> DataFrame:
    """The silences of a table up to `now`: cells are aggregated before their shuffle, windows run over cells."""
    kind = events.schema[time].dataType
    limit = F.expr(f"INTERVAL {int(hours)} HOURS")
    cell = F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(kind), named(time)) / (hours * HOUR))
    rows = events.where(named(source).isNotNull() & named(time).isNotNull())
    cells = rows.groupBy(named(source).cast("string").alias("source"), cell.alias("cell")).agg(F.min(named(time)).alias("head"), F.max(named(time)).alias("tail"))
    heard = cells.withColumn("next", F.lead("head").over(Window.partitionBy("source").orderBy("cell")))
    pauses = heard.where(F.coalesce("next", now) > F.col("tail") + limit)
    told = F.array(F.struct(F.lit("silent").alias("kind"), (F.col("tail") + limit).alias("at")), F.struct(F.lit("recovered").alias("kind"), F.col("next").alias("at")))
    return pauses.select("source", F.col("tail").alias("since"), F.inline(told)).where("at IS NOT NULL").select("source", "kind", "since", "at")


def _cells(limit: int):
    """Batches of source and at, reduced to the first and last time of each source and cell."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                g = b.groupby(["source", b["at"] // limit], sort=False)["at"].agg(["min", "max"])
                yield g.reset_index(level="source").rename(columns={"min": "head", "max": "tail"})[["source", "head", "tail"]]

    return reduce


def _watch(limit: int):
    """The stateful step: what a source's new times, or the passing of its limit, tell."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, silent = state.get if state.exists else (None, False)
        told: list[tuple] = []
        if state.hasTimedOut:
            told.append(("silent", last, last + limit))
            silent = True
        else:
            seen = np.empty((0, 2), dtype=np.int64)
            for b in batches:  # heads and tails by cell: bounded by the time that a batch spans
                both = np.concatenate([seen, b[["head", "tail"]].to_numpy(np.int64)])
                cell, at = np.unique(both[:, 0] // limit, return_inverse=True)
                seen = np.stack([np.full(len(cell), 2**62), np.full(len(cell), -(2**62))], axis=1)
                np.minimum.at(seen[:, 0], at, both[:, 0])
                np.maximum.at(seen[:, 1], at, both[:, 1])
            for head, tail in seen.tolist():
                if last is not None and head > last + limit:
                    told += ([] if silent else [("silent", last, last + limit)]) + [("recovered", last, head)]
                    silent = False
                elif silent and tail > last:  # heard within the limit after all: the watermark had been ahead
                    told.append(("recovered", last, max(head, last)))
                    silent = False
                last = tail if last is None else max(last, tail)
        if not silent:
            due = (last + limit) // 1000 + 1
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
            else:
                told.append(("silent", last, last + limit))
                silent = True
        state.update((last, silent))
        if told:
            yield pd.DataFrame([(key[0], *t) for t in told], columns=["source", "kind", "since", "at"])

    return step


def silence_stream(events: DataFrame, source: str, time: str, hours: int = 26, late: str = "1 hour") -> DataFrame:
    """The same rows as a stream. Time passes with the newest event of any source, less `late`: a source is told to
    be silent while others still send. State is one time and one flag for each source; each task sends a batch's
    cells instead of its events to the source's task. Rows later than the watermark are left out."""
    limit = hours * HOUR
    at = named(time).cast("timestamp")
    rows = events.where(named(source).isNotNull() & at.isNotNull()).select(named(source).cast("string").alias("source"), F.unix_micros(at).alias("at"))
    cells = rows.mapInPandas(_cells(limit), "source string, head long, tail long")
    timed = cells.withColumn("heard", F.timestamp_micros("tail")).withWatermark("heard", late)
    told = timed.groupBy("source").applyInPandasWithState(_watch(limit), OUT, "last long, silent boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select("source", "kind", F.timestamp_micros("since").alias("since"), F.timestamp_micros("at").alias("at"))
