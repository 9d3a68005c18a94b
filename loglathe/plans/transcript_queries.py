"""Queries over transcripts and fold selection, each beside its oracle."""

from __future__ import annotations

from ..operators import selection as S
from ..operators import transcript as T
from ..policy import SCALED
from ..sources import adapters as A
from .registry import query

M, LOG, TOOLS = (A.with_tables(x) for x in ("messages", "log", "tools"))
FRESH, BUDGET = SCALED.zone_bytes(SCALED.fresh_tail), SCALED.budget_tokens
TURNS = f"""{M}, t AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY session ORDER BY idx) AS turn FROM messages),
 seg AS (SELECT session, turn, min(idx) AS start, max(idx) + 1 AS stop, max(idx) FILTER (role NOT IN ('custom', 'bashExecution')) + 1 AS "end",
   arg_max(terminal, idx) FILTER (role NOT IN ('custom', 'bashExecution')) AS complete, CAST(sum(nbytes) AS BIGINT) AS nbytes, count(*) AS n FROM t WHERE turn > 0 GROUP BY session, turn),
 folds AS (SELECT session, turn, start, "end", nbytes, greatest(nbytes - 240, 0) AS freed FROM seg WHERE complete)"""
LATER = "coalesce(sum(nbytes) OVER (PARTITION BY session ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
BOUNDARY = f""", suf AS (SELECT session, start, nbytes, sum(nbytes) OVER (PARTITION BY session ORDER BY start DESC) AS s FROM seg),
 bnd AS (SELECT session, coalesce(max(start) FILTER (s >= {FRESH}), min(start)) AS boundary, CAST(sum(nbytes) AS BIGINT) AS nbytes FROM suf GROUP BY session)"""
OCC = f""", occ AS (SELECT session, tokens, round(tokens / {float(BUDGET)}, 6) AS occupancy FROM (SELECT session, CAST(ceil(sum(nbytes) / 4.0) AS BIGINT) AS tokens FROM messages GROUP BY session))"""
BATCH = """, n AS (SELECT *, max(ordinal) FILTER (kind = 'click') OVER w AS batch, count(*) FILTER (kind NOT IN ('click', 'view')) OVER w AS broken FROM log WINDOW w AS (PARTITION BY session ORDER BY ordinal)),
 b AS (SELECT c.session, c.ordinal AS batch, count(v.ordinal) AS results, count(DISTINCT v.k) AS ids, CAST(coalesce(sum(octet_length(encode(v.props))), 0) AS BIGINT) AS nbytes, max(v.ordinal) AS last
   FROM n c LEFT JOIN n v ON v.session = c.session AND v.batch = c.ordinal AND v.kind = 'view' AND v.broken = c.broken WHERE c.kind = 'click' GROUP BY c.session, c.ordinal),
 batches AS (SELECT *, results > 0 AND results = ids AS complete FROM b)"""

query("complete_turns", lambda s, d: T.complete_turns(A.messages(s, d)), TURNS + """ SELECT session, turn, start, "end" FROM seg WHERE complete""")
query("chapter_segments", lambda s, d: T.segments(A.messages(s, d)), TURNS + " SELECT * FROM seg")
query("leading_continuation", lambda s, d: T.leading_continuation(A.messages(s, d)), TURNS + """ SELECT session, min(idx) AS start, max(idx) + 1 AS "end", arg_max(terminal, idx) AS terminal, arg_min(role, idx) AS first_role FROM t WHERE turn = 0 GROUP BY session""")
query("closed_units", lambda s, d: T.closed_units(A.messages(s, d)), TURNS + """ SELECT session, turn, CASE WHEN role = 'assistant' THEN 'answer' ELSE 'row' END AS kind, count(*) AS units, min(idx) AS first, max(idx) AS last
 FROM t WHERE turn > 0 GROUP BY ALL""")
query("unsafe_indices", lambda s, d: T.unsafe(A.messages(s, d)), TURNS + """ SELECT session, start AS idx, 'open' AS why FROM seg x WHERE NOT complete AND turn = (SELECT max(turn) FROM seg y WHERE y.session = x.session)
 UNION ALL SELECT session, idx, 'head' FROM t WHERE turn = 0""")
query("tool_fresh_tail", lambda s, d: T.fresh_tail(A.messages(s, d), SCALED), f"""{M}, l AS (SELECT session, idx, CAST({LATER} AS BIGINT) AS later FROM messages) SELECT * FROM l WHERE later < {FRESH}""")
query("fresh_boundary", lambda s, d: T.fresh_boundary(A.messages(s, d), SCALED), TURNS + BOUNDARY + " SELECT * FROM bnd")
query("current_turn_boundary", lambda s, d: T.current_turn_boundary(A.messages(s, d)), M + """ SELECT session, max(idx) FILTER (terminal) AS boundary, count(*) AS "rows" FROM messages GROUP BY session""")
query("span_bytes", lambda s, d: T.span_bytes(A.messages(s, d), T.complete_turns(A.messages(s, d)).select("session", "start", "end")), TURNS + """ SELECT f.session, f.start, f."end", count(*) AS "rows", CAST(sum(m.nbytes) + count(*) + 1 AS BIGINT) AS bytes
 FROM folds f JOIN messages m ON m.session = f.session AND m.idx >= f.start AND m.idx < f."end" GROUP BY ALL""")
query("linkage_counts", lambda s, d: T.linkage(A.log(s, d)), LOG + """, g AS (SELECT session, k, count(*) FILTER (kind = 'click') AS calls, count(*) FILTER (kind = 'view') AS results FROM log WHERE kind IN ('click', 'view') GROUP BY session, k)
 SELECT *, calls = 1 AND results = 1 AS linked FROM g""")
query("tool_batches", lambda s, d: T.tool_batches(A.log(s, d)), LOG + BATCH + " SELECT * FROM batches")
query("digest_anchor_unique", lambda s, d: T.unique_anchor(A.messages(s, d)), M + " SELECT sha256(text) AS sha, min(session) AS session, min(idx) AS idx FROM messages GROUP BY sha256(text) HAVING count(*) = 1")
query("window_alignment", lambda s, d: T.aligned(A.messages(s, d).where("role <> 'custom'"), A.messages(s, d)), M + """, n AS (SELECT *, row_number() OVER (PARTITION BY session, sha256(text) ORDER BY idx) AS n, sha256(text) AS sha FROM messages),
 w AS (SELECT *, row_number() OVER (PARTITION BY session, sha256(text) ORDER BY idx) AS n, sha256(text) AS sha FROM messages WHERE role <> 'custom')
 SELECT w.session, w.idx, n.idx AS entry, n.idx IS NULL AS protected FROM w LEFT JOIN n USING (session, sha, n)""")
query("protected_mass", lambda s, d: T.protected_mass(A.messages(s, d), SCALED), f"""{M}, l AS (SELECT *, {LATER} >= {FRESH} AS stale, role = 'custom' AS pin FROM messages)
 SELECT session, count(*) FILTER (pin) AS pinned, CAST(sum(CASE WHEN pin THEN nbytes ELSE 0 END) AS BIGINT) AS pinned_bytes, count(*) FILTER (pin AND stale) AS stale, CAST(sum(CASE WHEN pin AND stale THEN nbytes ELSE 0 END) AS BIGINT) AS stale_bytes FROM l GROUP BY session""")
query("unmarked_remainder_topk", lambda s, d: T.remainder(A.tool_ledger(s, d)), TOOLS + """, a AS (SELECT session, sum(nbytes) AS whole, sum(CASE WHEN tool <> 'purchase' THEN nbytes ELSE 0 END) AS free FROM tools GROUP BY session),
 r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY tokens DESC, ordinal) AS rank FROM tools WHERE tool <> 'purchase')
 SELECT session, CAST(rank AS INTEGER) AS rank, ordinal, tokens, CAST(free AS BIGINT) AS free_bytes, round(free::DOUBLE / whole::DOUBLE, 6) AS free_share FROM r JOIN a USING (session) WHERE rank <= 3""")
query("occupancy_bands", lambda s, d: T.occupancy(A.messages(s, d), SCALED), M + OCC + """ SELECT *, CASE WHEN occupancy >= 0.9 THEN 'fence' WHEN occupancy >= 0.85 THEN 'backstop' WHEN occupancy >= 0.8 THEN 'due' WHEN occupancy >= 0.2 THEN 'working' ELSE 'free' END AS band FROM occ""")
query("admission", lambda s, d: T.admission(A.messages(s, d), SCALED), f"""{M}, c AS (SELECT session, idx, CAST(ceil(nbytes / 4.0) AS BIGINT) AS cost FROM messages),
 h AS (SELECT *, CAST({BUDGET} - coalesce(sum(cost) OVER (PARTITION BY session ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS headroom FROM c) SELECT *, cost <= headroom AS admitted FROM h""")
query("capacity_accounting", lambda s, d: T.budgets(A.messages(s, d), 4096), M + """ SELECT session, CAST(ceil(sum(nbytes) / 4.0) AS BIGINT) AS used, 4096::BIGINT AS "window", (4096 - 409)::BIGINT AS budget, 409::BIGINT AS reserved,
 3687 - CAST(ceil(sum(nbytes) / 4.0) AS BIGINT) AS headroom FROM messages GROUP BY session""")

query("auto_tool_batch", lambda s, d: S.oldest_batch(T.tool_batches(A.log(s, d)), 18), LOG + BATCH + """ SELECT session, arg_min(batch, batch) AS batch, arg_min(last, batch) AS last, arg_min(results, batch) AS results, arg_min(nbytes, batch) AS nbytes
 FROM batches WHERE complete AND nbytes >= 18 GROUP BY session""")
CHAPTER = f""", c AS (SELECT a.session, a.turn, a.start, b.turn AS "to", b."end", (SELECT CAST(sum(nbytes) AS BIGINT) FROM folds x WHERE x.session = a.session AND x.turn BETWEEN a.turn AND b.turn) AS bytes
   FROM folds a JOIN folds b ON a.session = b.session AND b.turn BETWEEN a.turn AND a.turn + {SCALED.max_chapter_turns - 1}
   WHERE (SELECT count(*) FROM folds x WHERE x.session = a.session AND x.turn BETWEEN a.turn AND b.turn) = b.turn - a.turn + 1),
 v AS (SELECT * FROM c WHERE bytes BETWEEN {SCALED.min_chapter_chars} AND {SCALED.max_chapter_chars}),
 ch AS (SELECT session, turn, start, "to", "end", bytes FROM v QUALIFY row_number() OVER (PARTITION BY session ORDER BY start, "to" DESC) = 1)"""
query("auto_chapter", lambda s, d: S.chapter(A.messages(s, d), SCALED), TURNS + CHAPTER + " SELECT * FROM ch")
GROUPS = f""", g AS (SELECT *, turn - row_number() OVER (PARTITION BY session ORDER BY turn) AS run FROM folds WHERE nbytes < 800),
 h AS (SELECT *, (row_number() OVER (PARTITION BY session, run ORDER BY turn) - 1) // {SCALED.consolidate_after} AS part FROM g),
 groups AS (SELECT session, min(start) AS start, max("end") AS "end", CAST(sum(nbytes) AS BIGINT) AS nbytes FROM h GROUP BY session, run, part HAVING count(*) = {SCALED.consolidate_after})"""
query("consolidation_groups", lambda s, d: S.consolidations(A.messages(s, d), SCALED), TURNS + GROUPS + " SELECT * FROM groups")
REFOLD = """, re AS (SELECT session, turn, start, "end" FROM folds WHERE nbytes <= 400 QUALIFY row_number() OVER (PARTITION BY session ORDER BY "end", "end" - start) = 1)"""
query("refold_candidate", lambda s, d: S.refold(A.messages(s, d)), TURNS + REFOLD + " SELECT * FROM re")
query("topup_running_sum", lambda s, d: S.top_up(A.messages(s, d), SCALED, 0.1), TURNS + f""", r AS (SELECT session, turn, start, freed, CAST(sum(freed) OVER (PARTITION BY session ORDER BY start) AS BIGINT) AS upto FROM folds)
 SELECT * FROM r WHERE upto - freed < {SCALED.zone_bytes(0.1)}""")
query("ladder_rung", lambda s, d: S.rungs(A.messages(s, d), T.tool_batches(A.log(s, d)), SCALED), TURNS.replace("WITH ", "WITH " + A.ORACLE["log"] + ", ", 1) + BATCH.replace(" b AS", " b0 AS").replace("FROM b)", "FROM b0)") + OCC + CHAPTER + GROUPS + REFOLD + """
 SELECT session, occupancy, CASE WHEN EXISTS (SELECT 1 FROM batches t WHERE t.session = occ.session AND complete) THEN 'tool' WHEN occupancy >= 0.85 AND EXISTS (SELECT 1 FROM re WHERE re.session = occ.session) THEN 'refold'
 WHEN EXISTS (SELECT 1 FROM groups q WHERE q.session = occ.session) THEN 'consolidation' WHEN EXISTS (SELECT 1 FROM ch WHERE ch.session = occ.session) THEN CASE WHEN occupancy >= 0.9 THEN 'chapter' ELSE 'chapter-prepare' END ELSE 'none' END AS rung FROM occ""")
query("split_by_size", lambda s, d: S.split_by_size(A.messages(s, d), 1000), """WITH RECURSIVE """ + A.ORACLE["messages"] + """, o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY idx) AS n FROM messages),
 w(session, n, idx, nbytes, piece, used) AS (SELECT session, n, idx, nbytes, 0::BIGINT, nbytes FROM o WHERE n = 1
   UNION ALL SELECT o.session, o.n, o.idx, o.nbytes, CASE WHEN w.used > 0 AND w.used + o.nbytes > 1000 THEN w.piece + 1 ELSE w.piece END, CASE WHEN w.used > 0 AND w.used + o.nbytes > 1000 THEN o.nbytes ELSE w.used + o.nbytes END
   FROM w JOIN o ON o.session = w.session AND o.n = w.n + 1)
 SELECT session, piece, min(idx) AS start, max(idx) + 1 AS "end", CAST(sum(nbytes) AS BIGINT) AS nbytes FROM w GROUP BY session, piece""")
query("mark_accounting", lambda s, d: S.mark_accounts(A.messages(s, d), SCALED), TURNS + f""", e AS (SELECT *, coalesce(sum(nbytes) OVER (PARTITION BY session ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {FRESH} AS ok FROM folds),
 a AS (SELECT session, count(*) AS marks, count(*) FILTER (ok) AS eligible, CAST(sum(freed) AS BIGINT) AS freed, CAST(sum(CASE WHEN ok THEN freed ELSE 0 END) AS BIGINT) AS eligible_freed, min(start) AS start FROM e GROUP BY session)
 SELECT session, marks, eligible, freed, eligible_freed, round(freed / {float(SCALED.zone_bytes(1.0))}, 6) AS freed_share, (SELECT CAST(ceil(sum(nbytes) / 4.0) AS BIGINT) FROM messages m WHERE m.session = a.session AND m.idx >= a.start) AS rewrite_tokens FROM a""")
ELIGIBLE = TURNS + BOUNDARY + """, el AS (SELECT f.session, turn, CASE WHEN freed = 0 THEN 'unfulfillable' WHEN "end" > boundary THEN 'protected' ELSE 'eligible' END AS state FROM folds f JOIN bnd USING (session))"""
query("mark_eligibility", lambda s, d: S.mark_eligibility(A.messages(s, d), SCALED), ELIGIBLE + " SELECT * FROM el")
query("guard_waiver", lambda s, d: S.guard_waivers(A.messages(s, d), SCALED), ELIGIBLE + OCC + """, g AS (SELECT session, count(*) FILTER (state = 'protected') AS guarded, count(*) FILTER (state = 'eligible') AS other FROM el GROUP BY session)
 SELECT session, guarded, other, CAST(CASE WHEN occupancy >= 0.9 THEN guarded WHEN guarded >= 4 AND other = 0 AND occupancy >= 0.85 THEN greatest(guarded - 2, 1) ELSE 0 END AS BIGINT) AS waived FROM g JOIN occ USING (session)""")
