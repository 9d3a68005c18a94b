"""Streams: the commit epoch as state of each session, and windowed usage with late data.

The batch operator and the stream share one Session, so a stream's commits
equal those of the batch over the same rows in the same order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.epoch import SCHEMA, Session, row
from ..policy import Policy


def epoch_stream(m: DataFrame, policy: Policy) -> DataFrame:
    """Commits as messages (session, idx, role, nbytes, terminal) arrive; rows at or before a session's last are repeated and ignored."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, spans = (state.get[0], json.loads(state.get[1])) if state.exists else (-1, [])
        s, out = Session.unpack(policy, spans), []
        rows = sorted(r for f in frames for r in zip(f["idx"].tolist(), f["role"].tolist(), f["nbytes"].tolist(), f["terminal"].tolist()))
        for r in rows:
            if r[0] <= last:
                continue
            last = r[0]
            done = s.step(*r)
            if done:
                out.append(row(key[0], done, s))
        state.update((last, json.dumps(s.pack())))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return m.groupBy("session").applyInPandasWithState(run, SCHEMA, "last long, spans string", "append", GroupStateTimeout.NoTimeout)


def usage_stream(e: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Calls and value of each kind in each window of event time; later rows than ``late`` are dropped."""
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "calls", F.round("value", 6).alias("value"))


def quarantine(deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deltas on the revision right before them, and those out of the chain."""
    chained = F.col("base") == F.col("revision") - 1
    return deltas.where(chained), deltas.where(~chained)
