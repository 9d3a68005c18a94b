"""A log kept as tables in batches and loaded again, beside its oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import states as Z
from ..sources import adapters as A
from ..storage import shared_dir
from ..streaming import persistence as P
from .forest_queries import ALIVE, OPS
from .registry import query

PARTS, EVERY = 5, 2


def kept(s, d):
    """The operations of each session in five batches by revision, with a checkpoint after every second; the folder they are in."""
    ops = Z.operations(A.log(s, d)).where("op in ('add', 'remove')").select(F.col("session").cast("long").alias("session"), F.col("revision").cast("long").alias("revision"), "op", F.col("id").cast("long").alias("id"))
    last = ops.groupBy("session").agg(F.max("revision").alias("last"))
    dealt = ops.join(last, "session").withColumn("part", F.floor((F.col("revision") - 1) * PARTS / F.col("last"))).drop("last").persist()
    root = f"{shared_dir(s)}/states-{uuid.uuid4().hex}"
    for batch in range(PARTS):
        P.persist(dealt.where(F.col("part") == batch).drop("part"), batch, root, EVERY)
    dealt.unpersist()
    return root


query("persisted_state", lambda s, d: P.load(s, kept(s, d)), OPS + f", r AS ({ALIVE.format('''WHERE op IN ('add', 'remove')''')}) SELECT session, id, revision FROM r WHERE op = 'add'")
query("persistence_audit", lambda s, d: P.audit(s, kept(s, d)), OPS + " SELECT session, CAST(0 AS INTEGER) AS batch, '' AS fault FROM ops WHERE false")
