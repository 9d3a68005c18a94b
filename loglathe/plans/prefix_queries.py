"""Queries over prefixes of projections, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import forest as R
from ..operators import prefixes as P
from ..sources import adapters as A
from .forest_queries import VISIBLE, shown
from .registry import query


def projections(s, d):
    """Seven lists a session; some sessions lose an item here or there, and every eleventh has no carrier."""
    m = A.messages(s, d)
    rows = m.select("session", F.col("idx").alias("place"), F.concat_ws(":", "role", "text").alias("item"))
    p = R.projection(m, shown(s, d)).select("session", "place", F.col("fold"))
    folded = p.join(rows, ["session", "place"]).select("session", "place", F.coalesce("fold", "item").alias("item"))
    named = lambda df, name: df.select("session", F.lit(name).alias("list"), "place", "item")
    sessions = m.select("session").distinct()
    more = lambda name, place, item: sessions.select("session", F.lit(name).alias("list"), F.lit(place).alias("place"), F.lit(item).alias("item"))
    out = named(rows, "raw").unionByName(named(rows.where("not (session % 5 = 0 and place = 1)"), "expanded")).unionByName(more("expanded", 1000, "notice"))
    out = out.unionByName(named(folded, "folded")).unionByName(named(folded.withColumn("item", F.when((F.col("session") % 7 == 0) & (F.col("place") > 1), F.upper("item")).otherwise(F.col("item"))), "refolded")).unionByName(more("refolded", 1000, "notice"))
    for name in ("warm", "carrier", "withdrawn"):
        out = out.unionByName(named(folded, name)).unionByName(more(name, 1000, "warm"))
    out = out.unionByName(more("carrier", 1001, "carrier")).unionByName(more("withdrawn", 1001, "tail"))
    out = out.where("not (session % 11 = 0 and list = 'carrier') and not (session % 3 = 0 and list = 'withdrawn' and place = 1000)")
    return out.select("session", "list", (F.row_number().over(W.partitionBy("session", "list").orderBy("place")) - 1).alias("pos"), "item")


MORE = lambda name, place, item: f"SELECT DISTINCT session, '{name}' AS list, {place} AS place, '{item}' AS item FROM messages"
LISTS = VISIBLE + f""", fd AS (SELECT p.session, p.place, coalesce(p.fold, m.role || ':' || m.text) AS item FROM proj p JOIN messages m ON m.session = p.session AND m.idx = p.place),
 al AS (SELECT session, 'raw' AS list, idx AS place, role || ':' || text AS item FROM messages UNION ALL SELECT session, 'expanded', idx, role || ':' || text FROM messages WHERE NOT (session % 5 = 0 AND idx = 1) UNION ALL {MORE('expanded', 1000, 'notice')}
  UNION ALL SELECT session, 'folded', place, item FROM fd UNION ALL SELECT session, 'refolded', place, CASE WHEN session % 7 = 0 AND place > 1 THEN upper(item) ELSE item END FROM fd UNION ALL {MORE('refolded', 1000, 'notice')}
  UNION ALL SELECT session, x, place, item FROM fd CROSS JOIN (VALUES ('warm'), ('carrier'), ('withdrawn')) v(x) UNION ALL {MORE('warm', 1000, 'warm')} UNION ALL {MORE('carrier', 1000, 'warm')} UNION ALL {MORE('withdrawn', 1000, 'warm')}
  UNION ALL {MORE('carrier', 1001, 'carrier')} UNION ALL {MORE('withdrawn', 1001, 'tail')}),
 li AS (SELECT session, list, list(item ORDER BY place) AS x, count(*) AS n FROM al WHERE NOT (session % 11 = 0 AND list = 'carrier') AND NOT (session % 3 = 0 AND list = 'withdrawn' AND place = 1000) GROUP BY session, list),
 pr AS (SELECT a.session, a.list AS l, b.list AS r, a.n AS na, b.n AS nb, coalesce(list_min([i FOR i IN range(1, least(a.n, b.n) + 1) IF a.x[i] <> b.x[i]]) - 1, least(a.n, b.n)) AS common FROM li a JOIN li b ON b.session = a.session
   AND (a.list, b.list) IN (('raw', 'expanded'), ('folded', 'refolded'), ('warm', 'carrier'), ('warm', 'withdrawn'), ('carrier', 'withdrawn')))"""
query("common_prefixes", lambda s, d: P.common(projections(s, d), A.messages(s, d).select("session").distinct().select("session", F.lit("folded").alias("left"), F.lit("refolded").alias("right"))), LISTS + " SELECT session, l AS \"left\", r AS \"right\", na AS left_items, nb AS right_items, common FROM pr WHERE l = 'folded'")
SIZES = ", ".join(f"max(n) FILTER (list = '{x}') AS {x}_items" for x in P.PROJECTIONS)
KNOWN = ", ".join(f"CASE WHEN complete THEN {x} END AS {x}" for x in [*(f"{x}_items" for x in P.PROJECTIONS), "carrier_withdrawn_common", *P.RELATIONS, "fork_after_warm"])
HOLD = lambda a, b: f"bool_or(common = na) FILTER (l = '{a}' AND r = '{b}')"
query("projection_topology", lambda s, d: P.topology(projections(s, d)), LISTS + f""", sz AS (SELECT session, {SIZES}, count(*) = 7 AS complete FROM li GROUP BY session),
 rl AS (SELECT session, max(common) FILTER (l = 'carrier') AS carrier_withdrawn_common, {', '.join(f'{HOLD(*p)} AS {k}' for k, p in P.RELATIONS.items())} FROM pr GROUP BY session),
 al2 AS (SELECT *, carrier_withdrawn_common >= warm_items AS fork_after_warm FROM sz JOIN rl USING (session))
 SELECT session, complete, {KNOWN}, complete AND {' AND '.join(f'coalesce({x}, FALSE)' for x in [*P.RELATIONS, 'fork_after_warm'])} AS confirmed FROM al2""")
