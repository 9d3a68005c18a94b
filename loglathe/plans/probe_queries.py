"""Queries over probes, audits and briefs, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import probes as P
from ..operators import selection as S
from ..operators import transcript as T
from ..policy import SCALED
from ..sources import adapters as A
from .forest_queries import LINE
from .registry import query
from .scoring_queries import AFF, affine
from .text_queries import documents
from .transcript_queries import CHAPTER, TURNS

LOG, PROVIDER, M = (A.with_tables(x) for x in ("log", "provider", "messages"))

query("events_by_kind", lambda s, d: P.by_kind(A.log(s, d)), LOG + " SELECT coalesce(kind, 'null') AS kind, count(*) AS n, min(ordinal) AS first, max(ordinal) AS last FROM log GROUP BY 1")
query("provider_exchange_audit", lambda s, d: P.alternation(A.log(s, d)), LOG + """, r AS (SELECT session, ordinal, kind, lag(kind) OVER (PARTITION BY session ORDER BY ordinal) AS b FROM log WHERE kind IN ('view', 'click')),
 w AS (SELECT *, CASE WHEN b IS NULL THEN kind = 'click' ELSE kind = b END AS wrong FROM r) SELECT session, count(*) AS records, count(*) FILTER (wrong) AS violations, min(ordinal) FILTER (wrong) AS first_violation FROM w GROUP BY session""")
query("heartbeat_audit", lambda s, d: P.heartbeats(A.log(s, d), 86_400_000), LOG + """, g AS (SELECT session, coalesce(lead(wall_ms) OVER (PARTITION BY session ORDER BY ordinal), (SELECT max(wall_ms) FROM log)) - wall_ms AS gap FROM log)
 SELECT session, max(gap) AS longest, count(*) FILTER (gap > 86400000) AS breaks, count(*) FILTER (gap > 86400000) = 0 AS kept FROM g GROUP BY session""")
query("receipts_latest", lambda s, d: P.newest(A.log(s, d), "signup"), LOG + """, r AS (SELECT session, ordinal, k, CAST(row_number() OVER (PARTITION BY session ORDER BY ordinal DESC) AS INTEGER) AS age FROM log WHERE kind = 'signup') SELECT * FROM r WHERE age <= 3""")
query("utility_margins", lambda s, d: P.margins(affine(s, d)), AFF + """, g AS (SELECT vec_id, label, max(score) FILTER (candidate = label) AS own, avg(score) FILTER (candidate <> label) AS others FROM a GROUP BY vec_id, label), m AS (SELECT vec_id, label, round(own - others, 6) AS margin FROM g)
 SELECT *, round(1 / (1 + exp(-margin)), 5) AS p, margin > 0 AS retrieve FROM m""")
query("block_spans", lambda s, d: P.blocks(documents(s, d), 1000), """SELECT doc_id AS id, CAST(b AS INTEGER) AS block, CAST(b * 1000 AS INTEGER) AS start, CAST(least((b + 1) * 1000, length(text)) AS INTEGER) AS "end" FROM documents, range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT)) t(b) WHERE length(text) > 0""")
query("combined_ratios", lambda s, d: P.combined_ratios(documents(s, d), 1000), """SELECT doc_id AS id, CAST(ceil(length(text) / 1000.0) AS BIGINT) AS blocks, round((length(text) - length(replace(text, ' ', '')))::DOUBLE / length(text), 6) AS ratio FROM documents WHERE length(text) > 0""")
query("judge_agreement", lambda s, d: P.judged(A.log(s, d)), LOG + """, r AS (SELECT kind, k, lead(k) OVER (PARTITION BY session, kind ORDER BY ordinal) AS o FROM log) SELECT kind, count(*) AS pairs, count(*) FILTER (k <> o) AS decided, count(*) FILTER (k = o) AS undecided FROM r WHERE o IS NOT NULL GROUP BY kind""")
REP = PROVIDER + """, r AS (SELECT session, CAST(coalesce(sum(cache_read) FILTER (kind = 'click'), 0) AS BIGINT) AS click, CAST(coalesce(sum(cache_read) FILTER (kind = 'view'), 0) AS BIGINT) AS "view", CAST(coalesce(sum(cache_read) FILTER (kind = 'purchase'), 0) AS BIGINT) AS purchase FROM provider GROUP BY session),
 o AS (SELECT *, CASE WHEN click = 0 AND "view" = 0 THEN 'cold' WHEN click > "view" THEN 'branch-hit' WHEN purchase > "view" THEN 'suffix-hit' ELSE 'shared' END AS outcome FROM r)"""
query("cache_repetitions", lambda s, d: P.repetitions(A.provider(s, d)), REP + " SELECT * FROM o")
query("cache_repetition_summary", lambda s, d: P.repetition_summary(A.provider(s, d)), REP + """ SELECT outcome, count(*) AS sessions, round(sum(click)::DOUBLE / nullif(sum(click + "view" + purchase), 0)::DOUBLE, 6) AS click_share FROM o GROUP BY outcome""")


def spans(s, d):
    """One span for each answer: from the row before it to its end."""
    return A.messages(s, d).where("terminal").select("session", F.greatest(F.col("idx") - 1, F.lit(0)).alias("at"), (F.col("idx") + 1).alias("to"))


query("snap_span", lambda s, d: P.snapped(spans(s, d), T.complete_turns(A.messages(s, d)).select("session", "start", "end")), TURNS + """, sp AS (SELECT session, greatest(idx - 1, 0) AS "at", idx + 1 AS "to" FROM messages WHERE terminal)
 SELECT sp.session, "at", "to", min(f.start) AS start, max(f."end") AS "end", count(*) AS turns, "at" <> min(f.start) OR "to" <> max(f."end") AS moved FROM sp JOIN folds f ON f.session = sp.session AND f.start < "to" AND f."end" > "at" GROUP BY sp.session, "at", "to" """)
query("wedge_absorb", lambda s, d: P.wedges(A.messages(s, d), S.turn_folds(A.messages(s, d)), 1024), TURNS + """ SELECT f.session, f.turn, m.idx, m.role, m.nbytes AS wedge_bytes FROM folds f JOIN messages m ON m.session = f.session AND m.idx = f.start - 1
 WHERE m.nbytes <= 1024 AND NOT EXISTS (SELECT 1 FROM folds g WHERE g.session = f.session AND g."end" = f.start)""")
query("chapter_brief", lambda s, d: P.chapter_briefs(A.messages(s, d), S.chapter(A.messages(s, d), SCALED)), TURNS + CHAPTER + f""", r AS (SELECT ch.session, ch.start, ch."end", m.idx, CASE role WHEN 'user' THEN 'User: ' || left({LINE.format('text')}, 40) WHEN 'assistant' THEN 'Assistant: ' || right({LINE.format('text')}, 40) END AS piece
 FROM ch JOIN messages m ON m.session = ch.session AND m.idx >= ch.start AND m.idx < ch."end"), u AS (SELECT *, sum(length(piece) + 3) OVER (PARTITION BY session, start ORDER BY idx) - 3 AS upto FROM r WHERE piece IS NOT NULL)
 SELECT session, start, "end", string_agg(piece, ' · ' ORDER BY idx) AS brief FROM u WHERE upto <= 200 GROUP BY session, start, "end" """)
