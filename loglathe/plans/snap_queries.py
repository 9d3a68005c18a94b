"""Queries over spans that are moved to boundaries, each beside its oracle.

Positions are the ordinals of the log: turns begin at signups, units at signups
and clicks, folds go from a purchase to before the next, every second one kept,
and each error asks for a span.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import snapping as S
from ..sources import adapters as A
from .registry import query

TURNS = 4


def tables(s, d):
    """rows, roots, nested, units, boundaries, spans."""
    log = A.log(s, d).select("session", F.col("ordinal").alias("pos"), "kind", "value").persist()
    by = W.partitionBy("session").orderBy("pos")
    rows = log.select("session", "pos", F.concat(F.lit("row-"), "pos").alias("id"))
    buys = log.where("kind = 'purchase'").select("session", F.col("pos").alias("start"), (F.lead("pos").over(by) - 1).alias("end"), F.row_number().over(by).alias("n")).where("end > start")
    named = buys.select("session", F.concat_ws("-", F.lit("fold"), "session", "start").alias("fold"), "start", "end", (F.col("n") % 5 == 1).alias("tool"), "n")
    roots, nested = named.where("n % 4 < 2").drop("n"), named.where("n % 4 >= 2").select("session", "fold")
    last = log.where("kind = 'signup'").groupBy("session").agg((F.max("pos") - 1).alias("boundary"))
    turn = log.withColumn("turn", F.count_if(F.col("kind") == "signup").over(by).cast("bigint")).where("turn > 0 and kind in ('signup', 'click')")
    units = turn.select("session", F.col("pos").alias("start"), F.lead("pos").over(by).alias("end"), "turn").join(last, "session").where("end <= boundary + 1").drop("boundary")
    top = log.groupBy("session").agg(F.max("pos").alias("top"))
    spans = log.where("kind = 'error'").join(top, "session").select("session", F.col("pos").alias("span"), F.col("pos").alias("start"), F.least(F.col("pos") + F.floor(F.abs(F.col("value"))).cast("bigint") % 12, F.col("top")).alias("end"))
    return rows, roots, nested, units, last, spans


def places(t):
    return S.index(t[0].select("session", "pos"), t[1], t[3], TURNS).persist()


def snapped(s, d):
    t = tables(s, d)
    return S.snapped(t[5], places(t), t[4])


def whole(s, d):
    t = tables(s, d)
    return S.whole_folds(t[5], places(t), t[1])


def chosen(s, d):
    t = tables(s, d)
    return S.chosen(t[5], places(t), t[4], t[1], t[3], TURNS)


def resolved(s, d):
    """Each error asks for itself and the fold that begins before it; every seventh for an unknown id."""
    rows, roots, nested, _, _, spans = tables(s, d)
    known = roots.select("session", "fold", "start").unionByName(nested.join(A.log(s, d).where("kind = 'purchase'").select("session", F.col("ordinal").alias("start")), "session").where(F.col("fold") == F.concat_ws("-", F.lit("fold"), "session", "start")).select("session", "fold", "start"))
    near = spans.join(known.withColumnRenamed("start", "from"), "session", "left").where("from is null or from <= start").groupBy("session", "span", "start").agg(F.max_by("fold", "from").alias("fold"))
    return S.resolved(near.select("session", "span", F.array_compact(F.array(F.concat(F.lit("row-"), "start"), "fold", F.when(F.col("start") % 7 == 0, F.lit("gone")))).alias("ids")), rows, roots, nested)


BASE = f"""{A.with_tables("log").replace("WITH ", "WITH RECURSIVE ", 1)}, buys AS (SELECT session, ordinal AS start, lead(ordinal) OVER w - 1 AS "end", row_number() OVER w AS n FROM log WHERE kind = 'purchase' WINDOW w AS (PARTITION BY session ORDER BY ordinal)),
 named AS (SELECT session, concat_ws('-', 'fold', session, start) AS fold, start, "end", n % 5 = 1 AS tool, n FROM buys WHERE "end" > start), roots AS (SELECT * FROM named WHERE n % 4 < 2), nested AS (SELECT * FROM named WHERE n % 4 >= 2),
 bd AS (SELECT session, max(ordinal) - 1 AS boundary, max(ordinal) AS last FROM log WHERE kind = 'signup' GROUP BY session),
 tn AS (SELECT *, count(*) FILTER (kind = 'signup') OVER (PARTITION BY session ORDER BY ordinal) AS turn FROM log),
 un AS (SELECT session, ordinal AS start, lead(ordinal) OVER (PARTITION BY session ORDER BY ordinal) AS "end", turn FROM tn WHERE turn > 0 AND kind IN ('signup', 'click')), units AS (SELECT un.* FROM un JOIN bd USING (session) WHERE "end" <= boundary + 1),
 spans AS (SELECT session, ordinal AS span, ordinal AS start, least(ordinal + CAST(floor(abs(value)) AS BIGINT) % 12, (SELECT max(ordinal) FROM log m WHERE m.session = log.session)) AS "end" FROM log WHERE kind = 'error')"""
NOTE = "CASE WHEN {0} THEN '; ' || {1} || '@' || {2} || '-' || {3} ELSE '' END"
SNAP = BASE + f""", it(session, span, mode, pass, s, e, log, moved) AS (SELECT session, span, mode, 0, start, "end", '', TRUE FROM spans, (VALUES ('nearest'), ('exclude'), ('absorb')) m(mode)
 UNION ALL SELECT session, span, mode, pass + 1, s2, e4, log || n1 || n2 || n3 || n4 || n5 || {NOTE.format('e4 <> e3', "'more turns than a chapter holds'", 's2', 'e4')}, s2 <> s OR e4 <> e FROM (
  SELECT y.*, CASE WHEN f."end" <= e3 + 1 AND least(d.done, coalesce(c.cap, d.done)) - 1 < e3 THEN least(d.done, coalesce(c.cap, d.done)) - 1 ELSE e3 END AS e4 FROM (
   SELECT x.*, coalesce(us.start, s1) AS s2, coalesce(ue."end" - 1, e2) AS e3, {NOTE.format('us.start <> s1', "'started mid-unit'", 'us.start', 'e2')} AS n4, {NOTE.format('ue."end" - 1 <> e2', "'ended mid-unit'", 'coalesce(us.start, s1)', 'ue."end" - 1')} AS n5 FROM (
    SELECT w.*, least(e1, coalesce(boundary, e1)) AS e2, {NOTE.format('e1 > boundary', "'reached into the turn in flight'", 's1', 'boundary')} AS n3 FROM (
     SELECT v.*, CASE WHEN b IS NULL THEN e WHEN eb THEN bre ELSE brs - 1 END AS e1, {NOTE.format('b IS NOT NULL', "'ended inside ' || b || CASE WHEN eb THEN ', to its end' ELSE ', to its near boundary' END", 's1', 'CASE WHEN eb THEN bre ELSE brs - 1 END')} AS n2 FROM (
      SELECT it.*, CASE WHEN ra.fold IS NULL THEN s WHEN pass > 0 OR mode = 'absorb' OR mode = 'nearest' AND s - ra.start <= ra."end" + 1 - s THEN ra.start ELSE ra."end" + 1 END AS s1,
       {NOTE.format('ra.fold IS NOT NULL', '''CASE WHEN pass > 0 OR mode = 'absorb' OR mode = 'nearest' AND s - ra.start <= ra."end" + 1 - s THEN 'started inside ' || ra.fold || ', to its start' ELSE 'started inside ' || ra.fold || ', to its far boundary' END''', '''CASE WHEN pass > 0 OR mode = 'absorb' OR mode = 'nearest' AND s - ra.start <= ra."end" + 1 - s THEN ra.start ELSE ra."end" + 1 END''', 'e')} AS n1,
       rb.fold AS b, rb.start AS brs, rb."end" AS bre, pass > 0 OR mode = 'absorb' OR mode = 'nearest' AND rb."end" - e <= e - (rb.start - 1) AS eb
      FROM it LEFT JOIN roots ra ON ra.session = it.session AND s > ra.start AND s <= ra."end" LEFT JOIN roots rb ON rb.session = it.session AND e >= rb.start AND e < rb."end" WHERE moved AND pass < 40) v) w LEFT JOIN bd ON bd.session = w.session) x
    LEFT JOIN units us ON us.session = x.session AND s1 >= us.start AND s1 < us."end" LEFT JOIN units ue ON ue.session = x.session AND e2 >= ue.start AND e2 < ue."end") y
   LEFT JOIN (SELECT session, start, "end", turn, lead(start) OVER (PARTITION BY session ORDER BY start) AS nxt, lag(start) OVER (PARTITION BY session ORDER BY start) AS prv FROM units) f ON f.session = y.session AND s2 <= f.start AND (f.prv IS NULL OR f.prv < s2)
   LEFT JOIN (SELECT session, turn, lead(max("end"), {TURNS - 1}) OVER (PARTITION BY session ORDER BY turn) AS cap FROM units GROUP BY session, turn) c ON c.session = y.session AND c.turn = f.turn
   LEFT JOIN (SELECT session, "end" AS done, lead("end") OVER (PARTITION BY session ORDER BY start) AS nxt FROM units) d ON d.session = y.session AND d.done <= e3 + 1 AND (d.nxt IS NULL OR d.nxt > e3 + 1))),
 fin AS (SELECT session, span, mode, arg_max(s, pass) AS s, arg_max(e, pass) AS e, arg_max(log, pass) AS log FROM it GROUP BY session, span, mode),
 sn AS (SELECT session, span, mode, s AS start, e AS "end", substr(log, 3) AS log FROM fin WHERE log <> '' AND e >= s)"""
WHOLE = """wh AS (SELECT o.session, o.span, o.start, o."end", count(*) AS folds FROM (SELECT p.session, p.span, coalesce(a.start, p.start) AS start, coalesce(b."end", p."end") AS "end" FROM spans p
   LEFT JOIN roots a ON a.session = p.session AND p.start >= a.start AND p.start <= a."end" LEFT JOIN roots b ON b.session = p.session AND p."end" >= b.start AND p."end" <= b."end" WHERE a.start < p.start OR b."end" > p."end") o
  JOIN roots r ON r.session = o.session AND r.start >= o.start AND r."end" <= o."end" GROUP BY o.session, o.span, o.start, o."end" HAVING count(*) > 1 AND sum(r."end" - r.start + 1) = o."end" - o.start + 1 AND NOT bool_or(r.tool))"""
query("snapped_spans", snapped, SNAP + " SELECT * FROM sn")
query("whole_fold_spans", whole, BASE + ", " + WHOLE + " SELECT * FROM wh")
query("chosen_spans", chosen, SNAP + ", " + WHOLE + f""", rd AS (SELECT session, span, 'direct' AS reading, start, "end", '' AS log, 0 AS r FROM spans UNION ALL SELECT *, CASE mode WHEN 'nearest' THEN 1 WHEN 'exclude' THEN 2 ELSE 3 END FROM sn
   UNION ALL SELECT session, span, 'whole-folds', start, "end", 'tiled by ' || folds || ' folds', 4 FROM wh),
 ok AS (SELECT rd.* FROM rd WHERE reading = 'whole-folds' OR (SELECT coalesce(min(u.start) = rd.start AND max(u."end") = rd."end" + 1 AND sum(u."end" - u.start) = rd."end" - rd.start + 1 AND count(DISTINCT u.turn) <= {TURNS} AND max(u.turn) - min(u.turn) < {TURNS}, FALSE) FROM units u WHERE u.session = rd.session AND u."end" > rd.start AND u.start <= rd."end"))
 SELECT session, span, reading, start, "end", log FROM ok QUALIFY row_number() OVER (PARTITION BY session, span ORDER BY r) = 1""")
query("resolved_spans", resolved, BASE + """, nr AS (SELECT p.session, p.span, p.start, arg_max(n.fold, n.start) AS fold FROM spans p LEFT JOIN named n ON n.session = p.session AND n.start <= p.start GROUP BY p.session, p.span, p.start),
 hasf AS (SELECT session, count(*) AS n FROM named GROUP BY session),
 kept AS (SELECT nr.* FROM nr LEFT JOIN hasf USING (session) WHERE fold IS NOT NULL OR n IS NULL),
 rs AS (SELECT k.session, k.span, CASE WHEN k.start % 7 = 0 THEN 'unknown' WHEN x.fold IS NOT NULL THEN 'nested' END AS refused, least(k.start, coalesce(r.start, k.start)) AS s, k.start AS e, r.start AS rs, r."end" AS re FROM kept k LEFT JOIN nested x ON x.session = k.session AND x.fold = k.fold LEFT JOIN roots r ON r.session = k.session AND r.fold = k.fold)
 SELECT session, span, CASE WHEN refused IS NULL THEN s END AS start, CASE WHEN refused IS NULL THEN CASE WHEN rs = e THEN greatest(re, e) ELSE e END END AS "end", refused FROM rs""")
