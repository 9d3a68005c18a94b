"""State of sessions kept as tables: records, deltas, and checkpoints from time to time.

A batch of operations writes first the records of what it adds, then the deltas
that name them, and last, every so many batches, a checkpoint of the whole
state.  Each is a folder of the batch's own that a repeated batch overwrites, so
that a batch that was killed anywhere can run again and the tables come out the
same.  A state is the newest whole checkpoint and the deltas after it.

Operations have session, revision, op ('add' or 'remove') and id; revisions of a
session rise from batch to batch, and of several operations on an id in a batch
the last counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "session long, id long, revision long, batch int"
DELTAS = "session long, id long, revision long, change string, batch int"
HEADS = "session long, base long, revision long, batch int"
CHECKPOINTS = "session long, id long, revision long, batch int"
EVERY = 8


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def batches(spark: SparkSession, root: str, name: str) -> list[int]:
    """Batches whose folder of a table was written to its end."""
    fs, at = _folder(spark, f"{root}/{name}")
    if not fs.exists(at):
        return []
    found = (x.getPath() for x in fs.listStatus(at))
    done = [p.getName() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(x.split("=")[1]) for x in done if x.startswith("batch="))


def table(spark: SparkSession, root: str, name: str, schema: str, some: list[int]) -> DataFrame:
    """The rows of some batches of a table."""
    if not some:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*(f"{root}/{name}/batch={b}" for b in some))


def _write(df: DataFrame, root: str, name: str, batch: int) -> None:
    df.drop("batch").write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


def load(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """session, id, revision: the state after all batches, or after those before ``before``."""
    upto = lambda name: [b for b in batches(spark, root, name) if before is None or b < before]
    whole = upto("checkpoints")[-1:]
    later = [b for b in upto("deltas") if not whole or b > whole[0]]
    start = table(spark, root, "checkpoints", CHECKPOINTS, whole).select("session", "id", "revision", F.lit("add").alias("change"))
    return settled(start.unionByName(table(spark, root, "deltas", DELTAS, later).select("session", "id", "revision", "change")))


def settled(changes: DataFrame) -> DataFrame:
    """What is there after the last change of each id."""
    last = changes.groupBy("session", "id").agg(F.max(F.struct("revision", "change")).alias("x"))
    return last.where("x.change = 'add'").select("session", "id", "x.revision")


def persist(operations: DataFrame, batch: int, root: str, every: int = EVERY, between: Callable[[str], None] = lambda step: None) -> None:
    """Write a batch's records, deltas and heads, and a checkpoint where one is due.

    ``between`` is called with the name of each step that is done.
    """
    spark = operations.sparkSession
    changes = operations.groupBy("session", "id").agg(F.max(F.struct("revision", F.col("op").alias("change"))).alias("x")).select("session", "id", "x.*")
    _write(changes.where("change = 'add'").drop("change"), root, "records", batch)
    between("records")
    past = table(spark, root, "heads", HEADS, [b for b in batches(spark, root, "heads") if b < batch]).groupBy("session").agg(F.max("revision").alias("base"))
    heads = operations.groupBy("session").agg(F.max("revision").alias("revision")).join(past, "session", "left").select("session", F.coalesce("base", F.lit(0)).alias("base"), "revision")
    _write(heads, root, "heads", batch)
    between("heads")
    _write(changes.select("session", "id", "revision", "change"), root, "deltas", batch)
    between("deltas")
    if (batch + 1) % every == 0:
        _write(load(spark, root, batch + 1), root, "checkpoints", batch)
        between("checkpoints")


def sink(root: str, every: int = EVERY, between: Callable[[str], None] = lambda step: None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a stream of operations that are kept as tables."""

    def run(operations: DataFrame, batch: int) -> None:
        held = operations.persist()  # read by three writes
        try:
            persist(held, batch, root, every, between)
        finally:
            held.unpersist()

    return run


def audit(spark: SparkSession, root: str) -> DataFrame:
    """session, batch, fault: heads that do not go on from the one before, and additions without a record."""
    from pyspark.sql.window import Window as W

    heads = table(spark, root, "heads", HEADS, batches(spark, root, "heads"))
    before = F.coalesce(F.lag("revision").over(W.partitionBy("session").orderBy("batch")), F.lit(0))
    chain = heads.withColumn("before", before).where("base <> before").select("session", "batch", F.lit("chain").alias("fault"))
    known = table(spark, root, "records", RECORDS, batches(spark, root, "records"))
    lost = table(spark, root, "deltas", DELTAS, batches(spark, root, "deltas")).where("change = 'add'").join(known, ["session", "id", "revision", "batch"], "left_anti")
    return chain.unionByName(lost.select("session", "batch", F.lit("record").alias("fault")).distinct())
