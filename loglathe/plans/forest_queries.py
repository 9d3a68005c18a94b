"""Queries over trees, fold forests, state logs and projections, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forest as R
from ..operators import states as Z
from ..sources import adapters as A
from .registry import query
from .transcript_queries import TURNS

EXPAND = 3000
ENTRIES, LOG, PROVIDER, M = (A.with_tables(x) for x in ("entries", "log", "provider", "messages"))
ANC = ENTRIES.replace("WITH ", "WITH RECURSIVE ", 1) + """, a(node, above, distance) AS (SELECT entry, entry, 0::BIGINT FROM entries UNION ALL SELECT a.node, e.parent, a.distance + 1 FROM a JOIN entries e ON e.entry = a.above WHERE e.parent IS NOT NULL),
 leaf AS (SELECT session, arg_max(entry, idx) AS leaf FROM entries GROUP BY session), br AS (SELECT l.session, l.leaf, a.above AS entry, a.distance FROM leaf l JOIN a ON a.node = l.leaf)"""
FOREST = TURNS.replace("WITH ", "WITH RECURSIVE ", 1).replace(" folds AS (", " tf AS (") + """, c0 AS (SELECT *, (row_number() OVER (PARTITION BY session ORDER BY turn) - 1) // 2 AS chapter FROM tf), c1 AS (SELECT *, count(*) OVER (PARTITION BY session, chapter) AS mates FROM c0),
 folds AS (SELECT session, concat_ws('-', 'turn', session, turn) AS fold, 'turn' AS kind, CASE WHEN mates = 2 THEN concat_ws('-', 'chapter', session, chapter) ELSE concat_ws('-', 'all', session) END AS parent, start, "end", nbytes FROM c1
  UNION ALL SELECT session, concat_ws('-', 'chapter', session, chapter), 'chapter', concat_ws('-', 'all', session), min(start), max("end"), CAST(sum(nbytes) AS BIGINT) FROM c1 WHERE mates = 2 GROUP BY session, chapter
  UNION ALL SELECT session, concat_ws('-', 'all', session), 'all', NULL, min(start), max("end"), CAST(sum(nbytes) AS BIGINT) FROM c1 GROUP BY session),
 up(node, above, distance) AS (SELECT fold, fold, 0::BIGINT FROM folds UNION ALL SELECT up.node, f.parent, up.distance + 1 FROM up JOIN folds f ON f.fold = up.above WHERE f.parent IS NOT NULL),
 leaves AS (SELECT m.session, up.above AS fold, m.idx FROM up JOIN folds f ON f.fold = up.node AND f.kind = 'turn' JOIN messages m ON m.session = f.session AND m.idx >= f.start AND m.idx < f."end")"""
LIMIT = f"(CASE WHEN {{0}}.kind = 'all' THEN {EXPAND} ELSE {EXPAND // 2} END)"
VISIBLE = FOREST + f""", vis AS (SELECT f.session, f.fold, f.kind, f.start, f."end", f.nbytes FROM folds f LEFT JOIN folds p ON p.fold = f.parent LEFT JOIN folds g ON g.fold = p.parent
  WHERE (p.fold IS NULL OR p.nbytes >= {LIMIT.format('p')} AND (g.fold IS NULL OR g.nbytes >= {EXPAND})) AND NOT (f.kind <> 'turn' AND f.nbytes >= {LIMIT.format('f')})),
 proj AS (SELECT session, idx AS place, 'row' AS kind, NULL::VARCHAR AS fold, nbytes FROM messages m WHERE NOT EXISTS (SELECT 1 FROM vis v WHERE v.session = m.session AND m.idx >= v.start AND m.idx < v."end")
  UNION ALL SELECT session, start, kind, fold, 320 FROM vis)"""
LINE = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
FIRST = LINE.format("(SELECT arg_min(text, idx) FROM messages m WHERE m.session = v.session AND m.idx >= v.start AND m.idx < v.\"end\")")
BRIEFS = VISIBLE + f""", b0 AS (SELECT v.*, {FIRST} AS line, (SELECT count(*) FROM messages m WHERE m.session = v.session AND m.idx >= v.start AND m.idx < v."end" AND role = 'assistant') AS answers,
  (SELECT count(*) FROM messages m WHERE m.session = v.session AND m.idx >= v.start AND m.idx < v."end") AS n FROM vis v),
 briefs AS (SELECT session, fold, 'User: ' || CASE WHEN length(line) > 80 THEN rtrim(left(line, 77)) || '...' ELSE line END || ' · Assistant: ' || answers || ' of ' || n || ' rows' AS brief FROM b0)"""


def forest(s, d):
    """Used several times by each query: held, so that its windows run once."""
    return R.folds(A.messages(s, d)).persist()


def shown(s, d):
    return R.visible(forest(s, d), EXPAND).persist()


query("branch_walk", lambda s, d: R.branch(A.entries(s, d)), ANC + " SELECT * FROM br")
query("dead_branch_entries", lambda s, d: R.dead_entries(A.entries(s, d)), ANC + " SELECT session, entry, idx, role FROM entries WHERE entry NOT IN (SELECT entry FROM br)")
query("descendant_counts", lambda s, d: R.descends(A.entries(s, d)), ANC + " SELECT above AS entry, count(*) - 1 AS descendants, max(distance) AS height FROM a GROUP BY above")
query("fold_forest", forest, FOREST + " SELECT * FROM folds")
query("flatten_refs", lambda s, d: R.flatten_refs(A.messages(s, d), forest(s, d)), FOREST + " SELECT *, CAST(row_number() OVER (PARTITION BY fold ORDER BY idx) AS INTEGER) AS position FROM leaves")
query("fold_depth_tree", lambda s, d: R.tree(forest(s, d)), FOREST + """, dp AS (SELECT node, max(distance) AS depth FROM up GROUP BY node), bl AS (SELECT above, count(*) - 1 AS descendants, count(*) FILTER (kind = 'turn') AS leaves FROM up JOIN folds ON fold = node GROUP BY above)
 SELECT session, fold, kind, depth, descendants, leaves, CAST(row_number() OVER (PARTITION BY session ORDER BY start, depth) AS INTEGER) AS position FROM folds JOIN dp ON dp.node = fold JOIN bl ON bl.above = fold""")
query("fold_navigation", lambda s, d: R.navigation(forest(s, d)), FOREST + """ SELECT session, fold, lag(fold) OVER w AS previous, lead(fold) OVER w AS "next" FROM folds WINDOW w AS (PARTITION BY session, parent ORDER BY start)""")
TAMPERED = FOREST + """, bad AS (SELECT session, fold, kind, CASE WHEN kind = 'chapter' THEN 'gone' ELSE parent END AS parent, start, CASE WHEN kind = 'turn' THEN "end" + 1 ELSE "end" END AS "end" FROM folds UNION ALL SELECT session, fold, kind, parent, start, "end" FROM folds WHERE kind = 'all'),
 pp AS (SELECT fold, min(start) AS a, min("end") AS b FROM bad GROUP BY fold),
 own AS (SELECT f.session, m.idx FROM bad f JOIN messages m ON m.session = f.session AND m.idx >= f.start AND m.idx < f."end" WHERE f.kind = 'turn')
 SELECT session, 'shared row' AS what, count(*) AS n FROM (SELECT session, idx FROM own GROUP BY session, idx HAVING count(*) > 1) GROUP BY session
 UNION ALL SELECT session, 'unknown parent', count(*) FROM bad WHERE parent = 'gone' GROUP BY session
 UNION ALL SELECT f.session, 'outside of parent', count(*) FROM bad f JOIN pp ON pp.fold = f.parent WHERE f.start < a OR f."end" > b GROUP BY f.session
 UNION ALL SELECT session, 'repeated fold', count(*) FROM (SELECT session, fold FROM bad GROUP BY session, fold HAVING count(*) > 1) GROUP BY session"""


def tampered(s, d):
    """A forest with turns that overlap, chapters without parent, and repeated roots."""
    f = forest(s, d)
    bad = f.withColumn("parent", F.when(F.col("kind") == "chapter", F.lit("gone")).otherwise(F.col("parent"))).withColumn("end", F.when(F.col("kind") == "turn", F.col("end") + 1).otherwise(F.col("end")))
    return R.violations(bad.unionByName(f.where("kind = 'all'")), A.messages(s, d))


query("forest_violations", tampered, TAMPERED)
query("forest_is_valid", lambda s, d: R.violations(forest(s, d), A.messages(s, d)), M + " SELECT session, '' AS what, 0::BIGINT AS n FROM messages WHERE false")
query("visible_folds", shown, VISIBLE + " SELECT * FROM vis")
query("projection_rows", lambda s, d: R.projection(A.messages(s, d), shown(s, d)), VISIBLE + " SELECT session, place, kind, fold, CAST(nbytes AS BIGINT) AS nbytes FROM proj")
query("projection_summary", lambda s, d: R.projection_summary(A.messages(s, d), shown(s, d)), VISIBLE + """, q AS (SELECT session, count(*) AS shown, count(fold) AS folded, CAST(sum(nbytes) AS BIGINT) AS shown_bytes FROM proj GROUP BY session),
 z AS (SELECT session, count(*) AS "rows", CAST(sum(nbytes) AS BIGINT) AS bytes FROM messages GROUP BY session) SELECT *, bytes - shown_bytes AS saved FROM z JOIN q USING (session)""")
query("projection_linkage_check", lambda s, d: R.linkage_check(A.messages(s, d), shown(s, d)), VISIBLE + """, x AS (SELECT t.session, t.turn, count(*) AS n, count(p.place) AS s FROM t LEFT JOIN proj p ON p.session = t.session AND p.place = t.idx AND p.fold IS NULL WHERE turn > 0 AND role IN ('user', 'assistant') GROUP BY ALL)
 SELECT session, count(*) FILTER (s = n) AS kept, count(*) FILTER (s = 0) AS hidden, count(*) FILTER (s > 0 AND s < n) AS split FROM x GROUP BY session""")
query("visible_briefs", lambda s, d: R.briefs(A.messages(s, d), shown(s, d)), BRIEFS + " SELECT * FROM briefs")
query("carriage_classes", lambda s, d: R.carriage(A.messages(s, d), shown(s, d)), BRIEFS + f""", facts AS (SELECT session, idx AS "at", left({LINE.format('text')}, 30) AS fact FROM messages WHERE role = 'user' AND length(left({LINE.format('text')}, 30)) >= 10)
 SELECT session, "at", CASE WHEN EXISTS (SELECT 1 FROM proj p JOIN messages m ON m.session = p.session AND m.idx = p.place WHERE p.fold IS NULL AND p.session = facts.session AND contains({LINE.format('m.text')}, fact)) THEN 'visible-raw'
 WHEN EXISTS (SELECT 1 FROM briefs b WHERE b.session = facts.session AND contains(brief, fact)) THEN 'visible-brief' ELSE 'recoverable' END AS class FROM facts""")
query("recover_lossless", lambda s, d: R.recovered(A.messages(s, d), forest(s, d)), FOREST + """ SELECT fold, sha256(string_agg(sha256(text), ',' ORDER BY l.idx)) AS sha, count(*) AS "rows", CAST(sum(nbytes) AS BIGINT) AS nbytes
 FROM leaves l JOIN messages m ON m.session = l.session AND m.idx = l.idx GROUP BY fold""")
query("source_map", lambda s, d: R.source_map(A.messages(s, d), shown(s, d)), VISIBLE + """ SELECT m.session, m.idx, v.fold FROM messages m LEFT JOIN vis v ON v.session = m.session AND m.idx >= v.start AND m.idx < v."end" """)
query("slate_candidates", lambda s, d: R.slate(shown(s, d)), VISIBLE + """, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY start) AS rank FROM vis)
 SELECT session, CAST(rank AS INTEGER) AS rank, fold, CAST(ceil(nbytes / 4.0) AS BIGINT) AS expansion, round(greatest(0::DOUBLE, 1 - 320 / nbytes::DOUBLE), 4) AS saved_share FROM r WHERE rank <= 16""")
query("consolidation_shares", lambda s, d: R.fair_shares(A.messages(s, d), forest(s, d)), FOREST + """, kids AS (SELECT parent AS root, fold AS child, least(nbytes, 300) AS size FROM folds WHERE parent IS NOT NULL),
 levels AS (SELECT root, l.generate_series AS level, sum(least(size, l.generate_series)) AS used, max(size) AS top, sum(size) AS whole FROM kids, generate_series(0, 300) l GROUP BY ALL),
 best AS (SELECT root, max(level) AS level, any_value(whole) AS whole FROM levels WHERE used <= 300 GROUP BY root)
 SELECT root, child, CAST(CASE WHEN whole <= 300 THEN size ELSE least(size, level) END AS BIGINT) AS chars FROM kids JOIN best USING (root)""")
query("peek_head_tail", lambda s, d: R.peek(A.messages(s, d), 400), M + """, o AS (SELECT session, idx, text, nbytes, length(text) AS n FROM messages WHERE nbytes > 400),
 k AS (SELECT *, list_max([x FOR x IN range(60, least(n, 240) + 1) IF octet_length(encode(left(text, x))) <= 240]) AS h, list_max([x FOR x IN range(40, least(n, 160) + 1) IF octet_length(encode(right(text, x))) <= 160]) AS t FROM o)
 SELECT session, idx, left(text, h) AS head, right(text, t) AS tail, CAST(nbytes - octet_length(encode(left(text, h))) - octet_length(encode(right(text, t))) AS INTEGER) AS omitted FROM k""")

OPS = LOG + """, ops AS (SELECT session, ordinal AS revision, CASE kind WHEN 'signup' THEN 'add' WHEN 'purchase' THEN 'remove' WHEN 'click' THEN 'brief' WHEN 'view' THEN 'expand' WHEN 'error' THEN 'unpin' END AS op,
  k AS id, round(value, 2) AS value, coalesce(lag(ordinal) OVER (PARTITION BY session ORDER BY ordinal), 0) AS base FROM log)"""
ALIVE = "SELECT session, id, arg_max(op, revision) AS op, max(revision) AS revision FROM ops {0} GROUP BY session, id"
query("state_replay", lambda s, d: Z.replay(Z.operations(A.log(s, d))), OPS + f", r AS ({ALIVE.format('''WHERE op IN ('add', 'remove')''')}) SELECT session, id, revision FROM r WHERE op = 'add'")


def delta(s, d):
    o = Z.operations(A.log(s, d))
    return Z.difference(Z.replay(o, Z.middle(o)), Z.replay(o))


query("state_delta_diff", delta, OPS + f""", mid AS (SELECT session, max(revision) // 2 AS upto FROM ops GROUP BY session), a AS ({ALIVE.format("JOIN mid USING (session) WHERE op IN ('add', 'remove') AND revision <= upto")}), b AS ({ALIVE.format("WHERE op IN ('add', 'remove')")}),
 a1 AS (SELECT session, id FROM a WHERE op = 'add'), b1 AS (SELECT session, id FROM b WHERE op = 'add')
 SELECT *, 'add' AS change FROM (SELECT * FROM b1 EXCEPT SELECT * FROM a1) UNION ALL SELECT *, 'remove' FROM (SELECT * FROM a1 EXCEPT SELECT * FROM b1)""")
query("delta_chain_audit", lambda s, d: Z.audit(Z.operations(A.log(s, d)).where("op <> 'unpin'")), OPS + """, kept AS (SELECT *, coalesce(lag(revision) OVER (PARTITION BY session ORDER BY revision), 0) AS expected FROM ops WHERE op <> 'unpin')
 SELECT session, count(*) AS deltas, count(*) FILTER (base <> expected) AS broken, min(revision) FILTER (base <> expected) AS first_broken FROM kept GROUP BY session""")
query("brief_overrides", lambda s, d: Z.brief_overrides(Z.operations(A.log(s, d))), OPS + """, g AS (SELECT session, id, arg_max(value, revision) FILTER (op = 'brief') AS o, arg_max(value, revision) FILTER (op = 'add') AS s, count(*) FILTER (op = 'add') AS n FROM ops GROUP BY session, id)
 SELECT session, id, coalesce(o, s) AS brief, o IS NOT NULL AS overridden FROM g WHERE n > 0""")
query("lease_countdown", lambda s, d: Z.leases(Z.operations(A.log(s, d))), OPS + """, l AS (SELECT session, max(revision) AS last FROM ops GROUP BY session)
 SELECT session, id, max(revision) AS granted, greatest(8 - (any_value(last) - max(revision)), 0) AS "left" FROM ops JOIN l USING (session) WHERE op = 'expand' GROUP BY session, id""")
query("topology_digests", lambda s, d: Z.topology(Z.operations(A.log(s, d))), OPS + f""", r AS ({ALIVE.format("WHERE op IN ('add', 'remove')")}) SELECT session, count(*) AS folds, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS sha FROM r WHERE op = 'add' GROUP BY session""")

SUCC = LOG + """, i AS (SELECT *, count(*) FILTER (kind = 'purchase') OVER (PARTITION BY session ORDER BY ordinal) AS island FROM log), j AS (SELECT *, row_number() OVER (PARTITION BY session, island ORDER BY ordinal) AS n FROM i),
 p AS (SELECT *, list(k) OVER (PARTITION BY session, island ORDER BY ordinal) AS nxt FROM j), q AS (SELECT *, lag(nxt) OVER (PARTITION BY session ORDER BY ordinal) AS prv FROM p),
 c AS (SELECT session, ordinal, prv, nxt, coalesce(list_min([x FOR x IN range(1, least(len(prv), len(nxt)) + 1) IF prv[x] <> nxt[x]]) - 1, least(len(prv), len(nxt))) AS common FROM q WHERE prv IS NOT NULL),
 ch AS (SELECT session, ordinal, CASE WHEN common = len(prv) AND common = len(nxt) THEN 'identical' WHEN common = len(prv) THEN 'append' ELSE 'rewrite' END AS change, common, len(prv) AS "before", len(nxt) AS "after" FROM c)"""
query("projection_change", lambda s, d: Z.changes(Z.successive(A.log(s, d))), SUCC + " SELECT * FROM ch")
query("common_prefix_len", lambda s, d: Z.change_rollup(Z.successive(A.log(s, d))), SUCC + """ SELECT change, count(*) AS n, CAST(sum(common) AS BIGINT) AS common, round(sum(common)::DOUBLE / nullif(sum("before"), 0)::DOUBLE, 6) AS preserved_share FROM ch GROUP BY change""")
query("prefix_divergence", lambda s, d: Z.char_divergence(A.messages(s, d)), M + """, b AS (SELECT session, idx, text, lag(text) OVER (PARTITION BY session, role ORDER BY idx) AS prv FROM messages),
 c AS (SELECT *, string_split(prv, '') AS x, string_split(text, '') AS y FROM b WHERE prv IS NOT NULL),
 d AS (SELECT *, coalesce(list_min([i FOR i IN range(1, least(len(x), len(y)) + 1) IF x[i] <> y[i]]) - 1, least(len(x), len(y))) AS common FROM c)
 SELECT session, idx, common, round(common::DOUBLE / nullif(length(prv), 0)::DOUBLE, 6) AS identical_share FROM d""")
query("cache_miss_class", lambda s, d: Z.miss_classes(A.provider(s, d)), PROVIDER + """, l AS (SELECT *, lag(prompt) OVER (PARTITION BY session ORDER BY ordinal) AS prv FROM provider)
 SELECT CASE WHEN prv IS NULL THEN 'first' WHEN cache_read = 0 AND cache_write = 0 THEN 'unreported' WHEN cache_read = 0 THEN 'miss' WHEN cache_read / nullif(prv, 0)::DOUBLE >= 0.99 THEN 'hit' ELSE 'partial' END AS class,
 count(*) AS requests, CAST(sum(cache_read) AS BIGINT) AS read, CAST(sum(prompt) AS BIGINT) AS prompt FROM l GROUP BY 1""")


def epoch_commit(s, d):
    from ..policy import Policy
    from .epoch import epochs

    return epochs(A.messages(s, d), Policy.resolve(budget_tokens=500, consolidate_after=2, fresh_tail=0.1))


query("epoch_commit", epoch_commit)
