"""Queries over the ledgers, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledgers as L
from ..sources import adapters as A
from .registry import query

LOG, PROVIDER, TOOLS, PACE = (A.with_tables(x) for x in ("log", "provider", "tools", "pace"))
SHARE = "round(CAST({0} AS DOUBLE) / nullif(CAST({1} AS DOUBLE), 0), 6)"
BY = "(PARTITION BY session ORDER BY ordinal"
AFTER = BY + " ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
ROWS = f""", r AS (SELECT *, lag(prompt) OVER {BY}) AS prev_prompt FROM provider),
 m AS (SELECT *, coalesce(cache_read < prev_prompt - greatest(1024.0, prev_prompt * 0.02), false) AS mutated FROM r)"""
CLASSES = f""", i AS (SELECT *, coalesce(count(*) FILTER (kind = 'click') OVER {BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM provider),
 c AS (SELECT session, island, CASE WHEN bool_or(kind = 'error') THEN 'after-rollback' WHEN bool_or(kind = 'signup') THEN 'after-expand'
   WHEN bool_or(kind = 'purchase') THEN 'after-fold' ELSE 'unknown' END AS class FROM i GROUP BY ALL),
 classes AS (SELECT i.session, class, ordinal, input, cache_read, cache_write, prompt FROM i JOIN c USING (session, island) WHERE kind = 'click')"""

query("usage_totals", lambda s, d: L.usage_totals(A.provider(s, d)), f"""{PROVIDER} SELECT session, count(*) AS requests, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cache_read) AS BIGINT) AS cache_read,
 CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(output) AS BIGINT) AS output, CAST(sum(input + cache_read + cache_write + output) AS BIGINT) AS total FROM provider GROUP BY session""")
query("usage_series", lambda s, d: L.usage_series(A.provider(s, d)), f"""{PROVIDER}{ROWS} SELECT session, count(*) AS requests, count(*) FILTER (mutated) AS mutations, max(prompt) AS max_prompt,
 {SHARE.format('sum(cache_read)', 'sum(prompt)')} AS pooled_share, round(avg(cache_read / CAST(nullif(prompt, 0) AS DOUBLE)), 6) AS mean_share FROM m GROUP BY session""")
query("usage_mutation_rollup", lambda s, d: L.usage_mutation_rollup(A.provider(s, d)), f"""{PROVIDER}{ROWS}, g AS (SELECT session, count(*) FILTER (mutated) AS mutations, sum(CASE WHEN mutated THEN prev_prompt - cache_read ELSE 0 END) AS lost,
 min(ordinal) FILTER (mutated) AS f FROM m GROUP BY session) SELECT mutations, count(*) AS sessions, CAST(sum(lost) AS BIGINT) AS lost_tokens, min(f) AS earliest FROM g GROUP BY mutations""")
query("pooled_vs_mean_cache_share", lambda s, d: L.pooled_vs_mean(A.provider(s, d)), f"""{PROVIDER} SELECT kind, {SHARE.format('sum(cache_read)', 'sum(prompt)')} AS pooled_share,
 round(avg(cache_read / CAST(nullif(prompt, 0) AS DOUBLE)), 6) AS mean_share, count(*) AS requests FROM provider GROUP BY kind""")
query("billed_cost", lambda s, d: L.billed_cost(A.provider(s, d), 4000), f"""{PROVIDER} SELECT session, CAST(sum(CASE WHEN prompt > 4000 THEN (input + cache_write) * 100 + cache_read * 10 + output * 450
 ELSE (input + cache_write) * 50 + cache_read * 5 + output * 300 END) AS DOUBLE) / 1e7 AS usd, count(*) FILTER (prompt > 4000) AS long_calls,
 count(*) FILTER (stop_reason = 'error') AS unbilled, max(prompt) AS max_prompt FROM provider GROUP BY session""")
query("out_of_band_rollup", lambda s, d: L.out_of_band(A.provider(s, d)), f"""{PROVIDER}, x AS (SELECT *, CASE kind WHEN 'purchase' THEN 'compaction' WHEN 'signup' THEN 'generator' ELSE 'conversation' END AS src FROM provider)
 SELECT coalesce(src, 'total') AS source, count(*) AS calls, CAST(sum(input) AS BIGINT) AS fresh, CAST(sum(output) AS BIGINT) AS output FROM x GROUP BY ROLLUP (src)""")
query("unanswered_requests", lambda s, d: L.unanswered(A.provider(s, d).select("session", "ordinal", "prompt"), A.provider(s, d).where("stop_reason <> 'error'").select("session", "ordinal")), f"""{PROVIDER} SELECT session, ordinal, prompt FROM provider p
 WHERE NOT EXISTS (SELECT 1 FROM provider q WHERE q.session = p.session AND q.ordinal = p.ordinal AND q.stop_reason <> 'error')""")
query("witness_reconcile", lambda s, d: L.witness_reconcile(A.provider(s, d)), f"""{PROVIDER}, g AS (SELECT session, count(*) AS requests, count(*) FILTER (stop_reason <> 'error') AS responses, count(*) FILTER (stop_reason = 'error') AS markers FROM provider GROUP BY session)
 SELECT *, requests - responses BETWEEN 0 AND markers AS consistent FROM g""")
TAX = """, r AS (SELECT *, row_number() OVER (PARTITION BY session, sha ORDER BY ordinal) > 1 AS again FROM tools)
 SELECT {0}, count(*) AS results, count(*) FILTER (NOT again) AS "distinct", count(*) FILTER (again) AS repeats, CAST(sum(CASE WHEN again THEN nbytes ELSE 0 END) AS BIGINT) AS repeat_bytes,
 CAST(sum(CASE WHEN again THEN tokens ELSE 0 END) AS BIGINT) AS repeat_tokens, round(sum(CASE WHEN again THEN nbytes ELSE 0 END)::DOUBLE / sum(nbytes)::DOUBLE, 6) AS repeat_byte_share FROM r GROUP BY {0}"""
query("reread_tax", lambda s, d: L.reread_tax(A.tool_ledger(s, d)), TOOLS + TAX.format("tool"))
query("reread_tax_by_session", lambda s, d: L.reread_tax(A.tool_ledger(s, d), "session"), TOOLS + TAX.format("session"))
query("reread_top_repeats", lambda s, d: L.top_repeats(A.tool_ledger(s, d)), f"""{TOOLS} SELECT session, sha, count(*) AS n, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal, CAST(sum(tokens) - arg_min(tokens, ordinal) AS BIGINT) AS repeat_tokens
 FROM tools GROUP BY session, sha HAVING count(*) > 1 ORDER BY repeat_tokens DESC, session, sha LIMIT 10""")
query("think_time_quantiles", lambda s, d: L.think_time(A.pace(s, d)), f"""{PACE}, g AS (SELECT session, lead(requested) OVER {BY}) - released AS gap FROM pace) SELECT session, count(*) AS gaps, max(gap) AS max_gap,
 quantile_disc(gap, 0.95) AS p95, quantile_disc(gap, 0.5) AS median FROM g WHERE gap IS NOT NULL GROUP BY session""")
query("pace_gap_audit", lambda s, d: L.pace_audit(A.pace(s, d)), f"""{PACE}, g AS (SELECT session, released - lag(released) OVER {BY}) AS gap FROM pace) SELECT session, count(*) FILTER (gap > 3600000) AS late, max(gap) AS max_gap,
 count(*) FILTER (gap < 0) AS backwards FROM g GROUP BY session""")
query("inflow_trailing_max", lambda s, d: L.inflow(A.provider(s, d)), f"""{PROVIDER}, g AS (SELECT session, ordinal, greatest(prompt - lag(prompt) OVER {BY}), 0) AS step FROM provider)
 SELECT session, ordinal, step, coalesce(max(step) OVER {BY} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 0) AS expected FROM g""")
query("provider_weather", lambda s, d: L.weather(A.provider(s, d)), f"""{PROVIDER}, r AS (SELECT *, count(*) FILTER (stop_reason <> 'error') OVER {BY}) AS run FROM provider),
 e AS (SELECT session, run, min(ordinal) AS first, max(ordinal) AS last, count(*) AS errors FROM r WHERE stop_reason = 'error' GROUP BY session, run),
 j AS (SELECT e.*, b.ordinal AS good_before, a.ordinal AS good_after, coalesce(b.props = a.props, false) AS cold_restart FROM e
   LEFT JOIN provider b ON b.session = e.session AND b.ordinal = e.first - 1 LEFT JOIN provider a ON a.session = e.session AND a.ordinal = e.last + 1)
 SELECT session, first, errors, good_before, good_after, cold_restart FROM j""")
query("native_stop_gaps", lambda s, d: L.stop_gaps(A.log(s, d)), f"""{LOG}, p AS (SELECT s.session, s.ordinal, s.wall_ms, v.wall_ms AS found FROM log s ASOF LEFT JOIN (SELECT * FROM log WHERE kind = 'view') v
 ON s.session = v.session AND s.ordinal < v.ordinal WHERE s.kind = 'purchase')
 SELECT session, count(*) AS stops, count(found) AS resumed, max(found - wall_ms) AS max_gap, CAST(round(median(found - wall_ms)) AS BIGINT) AS median_gap FROM p GROUP BY session""")
query("cohort_asof_request", lambda s, d: L.cohorts(A.log(s, d)), f"""{LOG} SELECT s.session, s.ordinal, s.k, c.ordinal AS request, CASE WHEN c.ordinal IS NULL THEN 'pre-commit' ELSE 'cohort' END AS cohort
 FROM (SELECT * FROM log WHERE kind = 'signup') s ASOF LEFT JOIN (SELECT * FROM log WHERE kind = 'click') c ON s.session = c.session AND s.ordinal > c.ordinal""")
query("receipt_missing", lambda s, d: L.receipt_missing(A.log(s, d)), f"""{LOG}, p AS (SELECT c.session, c.ordinal, (SELECT min(ordinal) FROM log v WHERE v.session = c.session AND v.kind = 'view' AND v.ordinal > c.ordinal) AS projection
 FROM log c WHERE kind = 'purchase') SELECT * FROM p WHERE projection IS NOT NULL AND NOT EXISTS (SELECT 1 FROM log r WHERE r.session = p.session AND r.kind = 'signup' AND r.ordinal > p.ordinal AND r.ordinal < p.projection)""")
query("rollback_recovery_join", lambda s, d: L.rollback_recovery(A.log(s, d)), f"""{LOG} SELECT a.session, a.ordinal, a.k, min(b.ordinal) AS recovery, min(b.ordinal) IS NOT NULL AS recovered FROM log a
 LEFT JOIN log b ON a.session = b.session AND a.k = b.k AND b.kind = 'signup' AND b.ordinal > a.ordinal WHERE a.kind = 'error' GROUP BY a.session, a.ordinal, a.k""")
query("surfacing_outcomes", lambda s, d: L.surfacing(A.log(s, d)), f"""{LOG}, o AS (SELECT session, ordinal, k, lead(ordinal) OVER (PARTITION BY session, k ORDER BY ordinal) AS again FROM log WHERE kind = 'click')
 SELECT o.session, o.ordinal, o.k, again, max(p.ordinal) AS outcome FROM o LEFT JOIN log p ON p.session = o.session AND p.k = o.k AND p.kind = 'purchase' AND p.ordinal > o.ordinal AND p.ordinal < coalesce(again, 1000000000)
 GROUP BY o.session, o.ordinal, o.k, again""")
query("request_class_cache", lambda s, d: L.request_class_cache(A.provider(s, d)), f"""{PROVIDER}{CLASSES} SELECT class, count(*) AS requests, count(*) FILTER (cache_read > 0) AS hits, count(*) FILTER (cache_write > 0) AS writes,
 CAST(sum(input) AS BIGINT) AS fresh, CAST(sum(cache_read) AS BIGINT) AS read, {SHARE.format('sum(cache_read)', 'sum(prompt)')} AS pooled_share FROM classes GROUP BY class""")
query("counterfactual_cache_share", lambda s, d: L.counterfactual(A.provider(s, d)), f"""{PROVIDER}{CLASSES}, l AS (SELECT *, lag(prompt) OVER {BY}) AS prev FROM classes),
 v AS (SELECT *, least(prompt, CASE WHEN prev IS NULL THEN 0 WHEN class = 'unknown' THEN prev ELSE least(cache_read, prev) END) AS served FROM l)
 SELECT class, count(*) AS requests, CAST(sum(served) AS BIGINT) AS served, {SHARE.format('sum(served)', 'sum(prompt)')} AS counterfactual_share, {SHARE.format('sum(cache_read)', 'sum(prompt)')} AS observed_share FROM v GROUP BY class""")
query("action_usage", lambda s, d: L.action_usage(A.provider(s, d)), f"""{PROVIDER} SELECT kind, count(*) AS attempts, count(*) FILTER (stop_reason = 'stop') AS accepted, count(*) FILTER (stop_reason = 'error') AS errors,
 min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal, count(DISTINCT session) AS sessions FROM provider GROUP BY kind""")
query("curation_mass_by_origin", lambda s, d: L.curation_mass(A.tool_ledger(s, d)), f"""{TOOLS}, o AS (SELECT session, nbytes, tool IN ('purchase', 'signup') AS a FROM tools) SELECT session, CAST(sum(CASE WHEN a THEN nbytes ELSE 0 END) AS BIGINT) AS agent,
 CAST(sum(CASE WHEN a THEN 0 ELSE nbytes END) AS BIGINT) AS ladder, {SHARE.format('sum(CASE WHEN a THEN nbytes ELSE 0 END)', 'sum(nbytes)')} AS agent_share FROM o GROUP BY session""")
query("steward_windows", lambda s, d: L.steward_windows(A.log(s, d)), f"""{LOG}, c AS (SELECT session, ordinal, value >= 50 AND NOT coalesce(lag(value) OVER {BY}) >= 50, false) AS crossing FROM log),
 w AS (SELECT c.session, c.ordinal, (SELECT min(ordinal) FROM log p WHERE p.session = c.session AND p.kind = 'purchase' AND p.ordinal > c.ordinal) AS "commit" FROM c WHERE crossing)
 SELECT *, CASE WHEN "commit" IS NOT NULL THEN (SELECT count(*) FROM log a WHERE a.session = w.session AND a.kind = 'click' AND a.ordinal > w.ordinal AND a.ordinal < w."commit") END AS attempts FROM w""")
query("lastcall_table", lambda s, d: L.last_calls(A.log(s, d)), f"""{LOG}, p AS (SELECT v.session, v.ordinal, v.k, min(c.ordinal) AS response FROM log v LEFT JOIN log c ON c.session = v.session AND c.k = v.k AND c.kind = 'click' AND c.ordinal > v.ordinal
 WHERE v.kind = 'view' GROUP BY v.session, v.ordinal, v.k) SELECT *, response - ordinal - 1 AS "between" FROM p""")
query("brief_provenance_join", lambda s, d: L.brief_provenance(A.log(s, d)), f"""{LOG} SELECT session, count(*) AS records, count(*) FILTER (EXISTS (SELECT 1 FROM log u WHERE u.session = r.session AND u.k = r.k AND u.kind = 'purchase')) AS upgraded
 FROM log r WHERE kind = 'signup' GROUP BY session""")
query("state_bytes_by_field", lambda s, d: L.bytes_by_field(A.log(s, d)), f"""{LOG}, f AS (SELECT 'kind' AS field, octet_length(encode(kind)) AS n FROM log UNION ALL SELECT 'props', octet_length(encode(props)) FROM log
 UNION ALL SELECT 'ordinal', length(CAST(ordinal AS VARCHAR)) FROM log UNION ALL SELECT 'session', length(CAST(session AS VARCHAR)) FROM log)
 SELECT field, CAST(sum(n) AS BIGINT) AS nbytes, CAST(max(n) AS BIGINT) AS largest, CAST(min(n) AS BIGINT) AS smallest FROM f GROUP BY field ORDER BY nbytes DESC, field LIMIT 8""")


def tampered(s, d):
    """The chain of records whose payload was changed after sealing, for every error."""
    props = F.when(F.col("kind") == "error", F.concat("props", F.lit(" "))).otherwise(F.col("props"))
    return L.audit_chain(L.seal(A.log(s, d)).withColumn("props", props))


CHAIN = """, b AS (SELECT session, ordinal, kind, sha256(concat_ws('|', session, ordinal, kind, props)) AS sha FROM log)
 SELECT session, count(*) AS records, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS wrong_links, {0} AS wrong_digests, arg_max(sha, ordinal) AS head FROM b GROUP BY session"""
query("hash_chain_audit", lambda s, d: L.audit_chain(L.seal(A.log(s, d))), LOG + CHAIN.format("CAST(0 AS BIGINT)"))
query("hash_chain_tampered", tampered, LOG + CHAIN.format("count(*) FILTER (kind = 'error')"))
