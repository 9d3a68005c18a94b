"""Queries over briefs made by rule, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cuts as C
from ..operators import forest as R
from ..sources import adapters as A
from .forest_queries import EXPAND, FOREST, LINE, VISIBLE, forest, shown
from .registry import query

CAP, BRIEF, SOURCE, ORIENTATION = 300, 400, 1500, 900
TRIM = "regexp_replace({0}, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')"
#: A digit at the first, second, third or a later place of what has four characters at least.
DATA = r"\b\d[\w./-]{3,}\b|\b\w\d[\w./-]{2,}\b|\b\w\w\d[\w./-]+\b|\b\w{3,}\d[\w./-]*\b|\b\d{2,}\b"


def alls(s, d):
    return forest(s, d).where("kind = 'all'")


def cuts(s, d):
    return C.all_cuts(A.messages(s, d), alls(s, d), CAP)


def facts(s, d):
    """The longest word of each user's row, among words of one length the last in order."""
    rows = C.held(A.messages(s, d).where("role = 'user'").select("session", "idx", "text"), alls(s, d), "fold")
    word = F.array_max(F.transform(F.split("text", "[^A-Za-z0-9]+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return rows.select("fold", word.alias("fact")).where("length(fact) > 3")


def cap_join(source: str, name: str) -> str:
    """fold, place, text of ``source`` joined as far as the budget goes."""
    return f"""{name}0 AS (SELECT fold, place, {TRIM.format('text')} AS text FROM {source}), {name}1 AS (SELECT *, sum(length(text) + 1) OVER w AS upto, row_number() OVER w AS n FROM {name}0 WHERE text <> '' WINDOW w AS (PARTITION BY fold ORDER BY place)),
 {name} AS (SELECT fold, left(string_agg(text, chr(10) ORDER BY place), {CAP}) AS brief FROM {name}1 WHERE upto <= {CAP} OR n = 1 GROUP BY fold)"""


TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9_./-]{{3,}}')"
CUTS = FOREST + f""", af AS (SELECT * FROM folds WHERE kind = 'all'), rw AS (SELECT m.session, f.fold, m.idx, m.role, m.text FROM messages m JOIN af f ON f.session = m.session AND m.idx >= f.start AND m.idx < f."end"),
 an AS (SELECT fold, idx AS place, left({TRIM.format('text')}, 160) AS text FROM rw WHERE role = 'assistant'), {cap_join('an', 'cn')},
 dl0 AS (SELECT fold, idx, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM rw),
 dl AS (SELECT fold, idx * 100000 + i AS place, {TRIM.format('text')} AS text FROM dl0 WHERE length({TRIM.format('text')}) BETWEEN 1 AND 300 AND regexp_matches({TRIM.format('text')}, '{DATA}')), {cap_join('dl', 'cd')},
 pg AS (SELECT fold, idx, [x FOR x IN [{TRIM.format('p')} FOR p IN regexp_split_to_array(text, '\\n{{2,}}')] IF x <> ''] AS p FROM rw),
 ht AS (SELECT fold, idx * 2 AS place, p[1] AS text FROM pg WHERE len(p) > 0 UNION ALL SELECT fold, idx * 2 + 1, p[-1] FROM pg WHERE len(p) > 1), {cap_join('ht', 'ch')},
 la AS (SELECT fold, left(arg_max({TRIM.format('text')}, idx), {CAP}) AS brief FROM rw WHERE role = 'assistant' AND {TRIM.format('text')} <> '' GROUP BY fold),
 se0 AS (SELECT session, fold, idx, unnest(ls) AS text, generate_subscripts(ls, 1) AS i FROM (SELECT *, regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(10), 'g'), '\\n+') AS ls FROM rw)),
 se AS (SELECT session, fold, idx * 100000 + i AS place, {TRIM.format('text')} AS text, length({TRIM.format('text')}) AS n FROM se0 WHERE length({TRIM.format('text')}) BETWEEN 20 AND 400),
 dfq AS (SELECT session, token, count(*) AS df FROM (SELECT session, unnest(list_distinct({TOKENS.format('text')})) AS token FROM messages) GROUP BY session, token), tot AS (SELECT session, count(*) AS total FROM messages GROUP BY session),
 sc AS (SELECT fold, place, any_value(n) AS n, any_value(text) AS text, round(avg(ln(total / (1.0::DOUBLE + df))), 6) AS score FROM (SELECT session, fold, place, n, text, unnest({TOKENS.format('text')}) AS token FROM se) JOIN dfq USING (session, token) JOIN tot USING (session) GROUP BY fold, place),
 rs AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, place) AS r FROM sc),
 gr(fold, r, used, kept) AS (SELECT fold, 0::BIGINT, 0::BIGINT, CAST([] AS BIGINT[]) FROM af UNION ALL SELECT gr.fold, rs.r, CASE WHEN used + n + 1 <= {CAP} THEN used + n + 1 ELSE used END, CASE WHEN used + n + 1 <= {CAP} THEN list_append(kept, place) ELSE kept END FROM gr JOIN rs ON rs.fold = gr.fold AND rs.r = gr.r + 1),
 gk AS (SELECT fold, unnest(kept) AS place FROM gr QUALIFY row_number() OVER (PARTITION BY fold ORDER BY r DESC) = 1), cs AS (SELECT fold, string_agg(text, chr(10) ORDER BY place) AS brief FROM gk JOIN se USING (fold, place) GROUP BY fold),
 wy AS (SELECT fold, way, coalesce(CASE way WHEN 'assistant notes' THEN cn.brief WHEN 'data lines' THEN cd.brief WHEN 'head and tail' THEN ch.brief WHEN 'last assistant' THEN la.brief ELSE cs.brief END, '') AS brief
  FROM af CROSS JOIN (VALUES ('assistant notes'), ('data lines'), ('head and tail'), ('last assistant'), ('salience')) w(way) LEFT JOIN cn USING (fold) LEFT JOIN cd USING (fold) LEFT JOIN ch USING (fold) LEFT JOIN la USING (fold) LEFT JOIN cs USING (fold))"""
query("fold_cuts", cuts, CUTS + " SELECT fold, way, brief FROM wy")
query("cut_survival", lambda s, d: C.survival(cuts(s, d), facts(s, d)), CUTS + """, fc AS (SELECT fold, list_max([{'n': length(x), 'w': x} FOR x IN regexp_split_to_array(text, '[^A-Za-z0-9]+')]).w AS fact FROM rw WHERE role = 'user')
 SELECT way, count(*) AS facts, count(*) FILTER (contains(brief, fact)) AS carried, CAST(sum(length(brief)) AS BIGINT) AS chars FROM wy JOIN fc USING (fold) WHERE length(fact) > 3 GROUP BY way""")

ALL_BRIEFS = FOREST + f""", b0 AS (SELECT v.session, v.fold, {LINE.format("arg_min(m.text, m.idx)")} AS line, count(*) FILTER (m.role = 'assistant') AS answers, count(*) AS n FROM folds v JOIN messages m ON m.session = v.session AND m.idx >= v.start AND m.idx < v."end" GROUP BY v.session, v.fold),
 briefs AS (SELECT session, fold, 'User: ' || CASE WHEN length(line) > 80 THEN rtrim(left(line, 77)) || '...' ELSE line END || ' · Assistant: ' || answers || ' of ' || n || ' rows' AS brief FROM b0),
 kids AS (SELECT k.session, k.parent AS root, k.fold, k.kind, k.start, k."end", b.brief FROM folds k JOIN folds p ON p.fold = k.parent AND p.kind = 'all' JOIN briefs b ON b.fold = k.fold)"""
NOTED = LINE.format("regexp_extract(m.text, '^[ \\t\\n\\r\\f\\x0B]*([^ \\t\\n\\r\\f\\x0B][^\\n]*(?:\\n[ \\t\\r\\f\\x0B]*[^ \\t\\n\\r\\f\\x0B][^\\n]*)*)', 1)")
query("consolidation_brief", lambda s, d: C.consolidation_brief(A.messages(s, d), forest(s, d), BRIEF), ALL_BRIEFS + f""", nt0 AS (SELECT f.fold AS root, m.idx, {NOTED} AS t FROM folds f JOIN messages m ON m.session = f.session AND m.idx >= f.start AND m.idx < f."end" WHERE f.kind = 'all' AND m.role = 'assistant'),
 sb AS (SELECT root, 0 AS side, start AS place, {LINE.format('brief')} AS text FROM kids UNION ALL SELECT root, 1, idx, CASE WHEN length(t) > 160 THEN rtrim(left(t, 157)) || '...' ELSE t END FROM nt0 WHERE t <> ''),
 s1 AS (SELECT *, count(*) FILTER (side = 0) OVER (PARTITION BY root) AS nf, count(*) FILTER (side = 1) OVER (PARTITION BY root) AS nn, row_number() OVER (PARTITION BY root ORDER BY side, place) AS i FROM sb),
 s2 AS (SELECT *, 'Grouped completed context covering ' || CASE WHEN nn > 0 THEN nf || ' folds and ' || nn || ' agent notes: ' ELSE nf || ' folds: ' END AS lead FROM s1),
 s3 AS (SELECT *, {BRIEF} - length(lead) - 1 AS room, greatest(1, least(nf + nn, CAST(floor(({BRIEF} - length(lead) - 1 + 3) / 27.0) AS BIGINT))) AS named FROM s2),
 s4 AS (SELECT *, CASE WHEN nf + nn > named THEN ' | ' || (nf + nn - named) || CASE WHEN nn > 0 THEN ' more in this group' ELSE ' more folds in this group' END ELSE '' END AS tail FROM s3 WHERE i <= named),
 s5 AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY length(text), i) AS r FROM s4),
 wf(root, r, "left", kept, i) AS (SELECT DISTINCT root, 0::BIGINT, CAST(room - length(tail) - 3 * (named - 1) AS BIGINT), '', 0::BIGINT FROM s5
  UNION ALL SELECT root, r, "left" - length(cut), cut, i FROM (SELECT s5.root, s5.r, s5.i, "left", CASE WHEN length(text) <= greatest(1, "left" // (named - s5.r + 1)) THEN text ELSE rtrim(left(text, CAST(greatest(0, greatest(1, "left" // (named - s5.r + 1)) - 3) AS BIGINT))) || '...' END AS cut FROM wf JOIN s5 ON s5.root = wf.root AND s5.r = wf.r + 1)),
 pt AS (SELECT root, string_agg(kept, ' | ' ORDER BY i) AS body FROM wf WHERE r > 0 GROUP BY root)
 SELECT DISTINCT root, {LINE.format("(lead || body || tail || '.')")} AS brief FROM pt JOIN s5 USING (root)""")
query("consolidation_source", lambda s, d: C.consolidation_source(A.messages(s, d), forest(s, d), SOURCE).withColumn("sha", F.sha2("text", 256)).drop("text"), ALL_BRIEFS + f""", ct AS (SELECT k.fold, string_agg('{{"role":' || to_json(m.role) || ',"text":' || to_json(m.text) || '}}', ',' ORDER BY m.idx) AS contents FROM kids k JOIN messages m ON m.session = k.session AND m.idx >= k.start AND m.idx < k."end" GROUP BY k.fold),
 cc1 AS (SELECT kids.*, contents, row_number() OVER (PARTITION BY root ORDER BY start) AS i, count(*) OVER (PARTITION BY root) AS n FROM kids LEFT JOIN ct USING (fold)),
 cc2 AS (SELECT *, '{{"brief":' || to_json(brief) || ',"child":' || i || ',' AS a, ',"foldId":' || to_json(fold) || ',"kind":' || to_json(kind) || ',"of":' || n || '}}' AS z FROM cc1),
 cc3 AS (SELECT *, a || '"contents":[' || coalesce(contents, '') || ']' || z AS f, a || '"collapsed":"{C.COLLAPSED}"' || z AS h, row_number() OVER (PARTITION BY root ORDER BY octet_length(encode(coalesce(contents, ''))) DESC, i) AS r FROM cc2),
 tr AS (SELECT k.root, k.k, string_agg(CASE WHEN cc3.r <= k.k THEN h ELSE f END, ',' ORDER BY i) AS body FROM cc3 JOIN (SELECT root, unnest(range(0, max(r) + 1)) AS k FROM cc3 GROUP BY root) k USING (root) GROUP BY k.root, k.k),
 ok AS (SELECT *, '[' || body || ']' AS text, max(k) OVER (PARTITION BY root) AS top FROM tr)
 SELECT root, k AS collapsed, octet_length(encode(text)) AS bytes, sha256(text) AS sha FROM ok WHERE octet_length(encode(text)) <= {SOURCE} OR k = top QUALIFY row_number() OVER (PARTITION BY root ORDER BY k) = 1""")
query("orientation", lambda s, d: C.orientation(A.messages(s, d), shown(s, d), chars=ORIENTATION), VISIBLE + f""", nr AS (SELECT v.fold, s.side, m.idx, CASE WHEN s.side = 'before' THEN v.start - m.idx ELSE m.idx - v."end" + 1 END AS step, '{{"idx":' || m.idx || ',"role":' || to_json(m.role) || ',"text":' || to_json(m.text) || '}}' AS js
   FROM vis v CROSS JOIN (VALUES ('before'), ('after')) s(side) JOIN messages m ON m.session = v.session AND (s.side = 'before' AND m.idx < v.start AND m.idx >= v.start - 2 OR s.side = 'after' AND m.idx >= v."end" AND m.idx < v."end" + 2)),
 upt AS (SELECT *, sum(length(js) + 1) OVER (PARTITION BY fold, side ORDER BY step) + 1 AS upto FROM nr), tk AS (SELECT fold, side, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS r, string_agg(js, ',' ORDER BY idx) AS t FROM upt WHERE upto <= {ORIENTATION} GROUP BY fold, side)
 SELECT v.fold, s.side, coalesce(r, '') AS "rows", '[' || coalesce(t, '') || ']' AS text FROM vis v CROSS JOIN (VALUES ('before'), ('after')) s(side) LEFT JOIN tk ON tk.fold = v.fold AND tk.side = s.side""")
