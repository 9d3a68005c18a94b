"""Queries over the carriage of facts, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import attribution as T
from ..operators import forest as R
from ..sources import adapters as A
from .forest_queries import ANC, BRIEFS, EXPAND, LINE
from .registry import query
from .tree_queries import B


def lens(s, d):
    """The texts of each session's branch, of its folds' briefs, and of its dead branches, in one line each."""
    e = A.entries(s, d)
    branch = B.branch_rows(e).persist()
    m = A.messages(s, d).join(branch.select("session", "idx"), ["session", "idx"], "left_semi")
    folds = R.folds(m).persist()
    line = lambda df: df.withColumn("text", X.one_line(F.col("text")))
    return T.view(line(branch), line(e), folds, R.visible(folds, EXPAND), R.briefs_of(m, folds))


def facts(s, d):
    """What users' rows open with."""
    fact = F.left(X.one_line(F.col("text")), F.lit(30))
    return A.entries(s, d).where("role = 'user'").select("session", F.col("entry").alias("fact"), fact.alias("value")).where("length(value) >= 10")


def probes(s, d):
    """The last word of each user's row; a number is bound to the word before it."""
    words = F.split(X.one_line(F.col("text")), " ")
    e = A.entries(s, d).where("role = 'user'").select("session", F.col("entry").alias("probe"), words.alias("w"), F.pmod(F.col("entry"), F.lit(12)).cast("string").alias("digits"))
    numeric = F.col("probe") % 3 == 0
    return e.select("session", "probe", F.when(numeric, F.col("digits")).otherwise(F.element_at("w", -1)).alias("value"), F.when(F.size("w") > 1, F.element_at("w", -2)).alias("trace"))


ON_BRANCH = BRIEFS.replace(" FROM conversations)", " FROM conversations JOIN br ON br.entry = conv_id * 100 + turn)").replace("WITH RECURSIVE ", ANC + ",\n", 1)
EVERY = ON_BRANCH.replace("briefs AS (", "shown_briefs AS (").replace("b0 AS (SELECT v.*", "b00 AS (SELECT v.*").replace("FROM b0)", "FROM b00)")
LENS = EVERY + f""", b0 AS (SELECT v.session, v.fold, {LINE.format("arg_min(m.text, m.idx)")} AS line, count(*) FILTER (m.role = 'assistant') AS answers, count(*) AS n FROM folds v JOIN messages m ON m.session = v.session AND m.idx >= v.start AND m.idx < v."end" GROUP BY v.session, v.fold),
 briefs AS (SELECT session, fold, 'User: ' || CASE WHEN length(line) > 80 THEN rtrim(left(line, 77)) || '...' ELSE line END || ' · Assistant: ' || answers || ' of ' || n || ' rows' AS brief FROM b0),
 vw AS (SELECT e.session, CAST(e.entry AS VARCHAR) AS name, CASE WHEN br.entry IS NULL THEN 'off_branch' WHEN v.fold IS NULL THEN 'visible_raw' ELSE 'recoverable_source' END AS place, {LINE.format('e.text')} AS text
   FROM entries e LEFT JOIN br ON br.entry = e.entry LEFT JOIN vis v ON br.entry IS NOT NULL AND v.session = e.session AND e.idx >= v.start AND e.idx < v."end"
  UNION ALL SELECT b.session, b.fold, CASE WHEN v.fold IS NULL THEN 'recoverable_brief' ELSE 'visible_brief' END, brief FROM briefs b LEFT JOIN vis v USING (fold))"""


def attributed(facts_cte: str) -> str:
    names = lambda p: f"coalesce(string_agg(name, ',' ORDER BY name) FILTER (place = '{p}'), '') AS {p}"
    return f"""{LENS}, {facts_cte}, g AS (SELECT f.session, f.fact, {', '.join(names(p) for p in ('visible_raw', 'visible_brief', 'recoverable_source', 'recoverable_brief', 'off_branch'))}
  FROM fc f LEFT JOIN vw ON vw.session = f.session AND contains(vw.text, f.value) GROUP BY f.session, f.fact),
 cl AS (SELECT *, CASE WHEN visible_raw <> '' THEN 'visible-raw' WHEN visible_brief <> '' THEN 'visible-brief' WHEN recoverable_source <> '' OR recoverable_brief <> '' THEN 'recoverable' WHEN off_branch <> '' THEN 'absent-off-branch' ELSE 'absent' END AS class FROM g)"""


FACTS = f"fc AS (SELECT session, CAST(entry AS VARCHAR) AS fact, left({LINE.format('text')}, 30) AS value FROM entries WHERE role = 'user' AND length(left({LINE.format('text')}, 30)) >= 10)"
PROBES = f"""pr AS (SELECT session, probe, CASE WHEN probe % 3 = 0 THEN CAST(probe % 12 AS VARCHAR) ELSE w[-1] END AS value, w[-2] AS trace FROM (SELECT session, entry AS probe, string_split({LINE.format('text')}, ' ') AS w FROM entries WHERE role = 'user')),
 pv AS (SELECT *, CASE WHEN regexp_matches(value, '^[0-9]$') THEN [value, '0' || value] ELSE [value] END AS padded FROM pr),
 va AS (SELECT session, probe, 'value' AS kind, unnest(padded) AS value FROM pv WHERE NOT regexp_matches(value, '^[0-9]{{1,2}}$') UNION ALL SELECT session, probe, 'binding', trace || ': ' || unnest(padded) FROM pv WHERE trace IS NOT NULL),
 fc AS (SELECT session, probe, kind, concat_ws('/', probe, kind, value) AS fact, value FROM va)"""
query("fact_carriage", lambda s, d: T.attributed(lens(s, d), facts(s, d)), attributed(FACTS) + " SELECT session, fact, class, visible_raw, visible_brief, recoverable_source, recoverable_brief, CASE WHEN class = 'absent-off-branch' THEN off_branch ELSE '' END AS off_branch FROM cl")
query("probe_carriage", lambda s, d: T.best_carriage(lens(s, d), probes(s, d)), attributed(PROBES) + """, rk AS (SELECT fc.session, probe, kind, class, CASE class WHEN 'visible-raw' THEN 1 WHEN 'visible-brief' THEN 2 WHEN 'recoverable' THEN 3 WHEN 'absent-off-branch' THEN 4 ELSE 5 END AS r FROM fc JOIN cl ON cl.session = fc.session AND cl.fact = fc.fact)
 SELECT pr.session, pr.probe, arg_min(class, r) FILTER (kind = 'value') AS value_class, arg_min(class, r) FILTER (kind = 'binding') AS binding_class FROM pr LEFT JOIN rk USING (session, probe) GROUP BY pr.session, pr.probe""")
query("carriage_rollup", lambda s, d: T.rollup(T.best_carriage(lens(s, d), probes(s, d))), attributed(PROBES) + """, rk AS (SELECT fc.session, probe, kind, class, CASE class WHEN 'visible-raw' THEN 1 WHEN 'visible-brief' THEN 2 WHEN 'recoverable' THEN 3 WHEN 'absent-off-branch' THEN 4 ELSE 5 END AS r FROM fc JOIN cl ON cl.session = fc.session AND cl.fact = fc.fact),
 bs AS (SELECT pr.session, pr.probe, arg_min(class, r) FILTER (kind = 'value') AS value_class, arg_min(class, r) FILTER (kind = 'binding') AS binding_class FROM pr LEFT JOIN rk USING (session, probe) GROUP BY pr.session, pr.probe)
 SELECT value_class, binding_class, count(*) AS probes FROM bs GROUP BY value_class, binding_class""")
