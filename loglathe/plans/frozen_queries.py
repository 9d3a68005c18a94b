"""A projection that goes on from an earlier one, beside its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import frozen as Z
from ..sources import adapters as A
from .registry import query


def bodies(s, d):
    """The log as a body: views are results of peeks, signups are answers; every fourth session's first item was another one before."""
    e = A.log(s, d)
    role = F.when(F.col("kind") == "view", "toolResult").when(F.col("kind") == "signup", "assistant").otherwise("user")
    body = e.select("session", (F.col("ordinal") - 1).alias("pos"), role.alias("role"), F.when(F.col("kind") == "view", F.col("ordinal")).alias("call_id"), (F.col("k") % 3 == 0).alias("ephemeral"), F.concat_ws(":", "kind", "k").alias("item"), F.max("ordinal").over(W.partitionBy("session")).alias("n"))
    old = body.where(F.col("pos") * 2 < F.col("n")).withColumn("item", F.when((F.col("session") % 4 == 0) & (F.col("pos") == 0), "before").otherwise(F.col("item")))
    return body.drop("n"), old.drop("n")


def projected(s, d):
    body, old = bodies(s, d)
    new, sent_body = Z.withdrawn(body), Z.withdrawn(old)
    # a carrier was put behind every tenth item
    slots = sent_body.withColumn("x", F.explode(F.when(F.col("pos") % 10 == 9, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    sent = slots.select("session", (F.col("pos") + F.floor(F.col("pos") / 10) + F.col("x")).alias("pos"), F.when(F.col("x") == 0, F.col("call_id")).alias("call_id"), F.when(F.col("x") == 0, F.col("item")).otherwise(F.lit("carrier")).alias("item"))
    return Z.frozen(new, sent_body.select("session", "pos", "call_id", "item"), sent)


BODY = A.with_tables("log") + f""", bo AS (SELECT session, ordinal - 1 AS pos, CASE kind WHEN 'view' THEN 'toolResult' WHEN 'signup' THEN 'assistant' ELSE 'user' END AS role, k % 3 = 0 AS eph, kind || ':' || k AS item, max(ordinal) OVER (PARTITION BY session) AS n FROM log),
 ob AS (SELECT session, pos, role, eph, CASE WHEN session % 4 = 0 AND pos = 0 THEN 'before' ELSE item END AS item FROM bo WHERE pos * 2 < n),
 nw AS (SELECT *, role = 'toolResult' AND eph AND EXISTS (SELECT 1 FROM bo a WHERE a.session = bo.session AND a.pos > bo.pos AND a.role = 'assistant') AS consumed FROM bo),
 nb AS (SELECT session, pos, consumed, CASE WHEN consumed THEN '{Z.STUB}' ELSE item END AS item FROM nw),
 ow AS (SELECT ob.session, ob.pos, CASE WHEN nb.consumed OR ob.role = 'toolResult' AND ob.eph AND EXISTS (SELECT 1 FROM ob a WHERE a.session = ob.session AND a.pos > ob.pos AND a.role = 'assistant') THEN '{Z.STUB}' ELSE ob.item END AS item FROM ob JOIN nb USING (session, pos)),
 fz AS (SELECT session, count(*) AS held, bool_and(ow.item = nb.item) AS active FROM ow JOIN nb USING (session, pos) GROUP BY session)"""
query("frozen_projection", projected, BODY + """ SELECT ow.session, pos + pos // 10 AS pos, ow.item, 'kept' AS part FROM ow JOIN fz USING (session) WHERE active
 UNION ALL SELECT session, pos + pos // 10 + 1, 'carrier', 'kept' FROM ow JOIN fz USING (session) WHERE active AND pos % 10 = 9
 UNION ALL SELECT nb.session, pos + held // 10, nb.item, 'appended' FROM nb JOIN fz USING (session) WHERE active AND pos >= held
 UNION ALL SELECT nb.session, pos, nb.item, 'whole' FROM nb JOIN fz USING (session) WHERE NOT active""")
query("withdrawn_peeks", lambda s, d: Z.withdrawn(bodies(s, d)[0]).groupBy("session").agg(F.count_if("consumed").alias("consumed"), F.count_if((F.col("role") == "toolResult") & F.col("ephemeral")).alias("peeks")), BODY + """ SELECT session, count(*) FILTER (consumed) AS consumed, count(*) FILTER (role = 'toolResult' AND eph) AS peeks FROM nw GROUP BY session""")
