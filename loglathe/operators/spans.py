"""Rows and the spans that hold them, without a join of sessions with themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def covering(rows: DataFrame, spans: DataFrame, *values: str) -> DataFrame:
    """Each row with ``values`` of the span [start, end) of its session that holds its idx, null where none does.

    Spans of a session are disjoint: the span is the last one that started, if
    it has not ended.  One window over the union finds it.
    """
    nothing = F.lit(None).cast(spans.select(F.struct("end", *values).alias("x")).schema["x"].dataType)
    a = rows.withColumn("_span", nothing).withColumn("_at", F.col("idx").cast("bigint")).withColumn("_row", F.lit(1))
    empty = [F.col("session") if f.name == "session" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    b = spans.select(*empty, F.struct("end", *values).alias("_span"), F.col("start").cast("bigint").alias("_at"), F.lit(0).alias("_row"))
    by = W.partitionBy("session").orderBy("_at", "_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    r = a.unionByName(b).withColumn("_span", F.last("_span", True).over(by)).where("_row = 1")
    inside = F.col("idx") < F.col("_span.end")
    return r.select(*(F.col(c) for c in rows.columns), *(F.when(inside, F.col(f"_span.{v}")).alias(v) for v in values))


def held(rows: DataFrame, spans: DataFrame, *values: str) -> DataFrame:
    """The rows that a span holds, with its values."""
    return covering(rows, spans.withColumn("_held", F.lit(True)), "_held", *values).where("_held").drop("_held")
