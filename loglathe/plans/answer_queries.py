"""Queries over answers within windows, each beside its oracle.

Clicks are an assistant's texts, some empty, some with answers or headings;
signups are questions, of which every fourth is never asked.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import answers as N
from ..sources import adapters as A
from .registry import query


def rows(s, d):
    k = F.col("k")
    said = F.when(k % 5 == 0, "").when(k % 2 == 0, F.concat(F.lit("note "), k.cast("string"), F.lit("\nprobe-"), (k % 3).cast("string"), F.lit(": value "), k.cast("string"), F.lit(" \nend")))
    said = said.when(k % 7 == 0, F.concat(F.lit("# doc-"), (k % 3).cast("string"), F.lit(" title\nbody"))).otherwise(F.concat(F.lit("thinking about probe-1 "), k.cast("string")))
    return A.log(s, d).where("kind = 'click'").select("session", F.col("ordinal").alias("idx"), F.lit("assistant").alias("role"), said.alias("text"))


def questions(s, d, prefix="probe"):
    """Two chains, of odd and of even signups."""
    n = F.row_number().over(W.partitionBy("session").orderBy("ordinal"))
    e = A.log(s, d).where("kind = 'signup'").withColumn("n", n.cast("bigint"))
    name = lambda x: F.concat(F.lit(f"{prefix}-"), (x % 3).cast("string"))
    return e.select("session", (F.col("n") % 2).alias("chain"), F.col("n").alias("wave"), F.when(F.col("n") % 4 != 0, F.col("ordinal")).alias("at"), F.array(name(F.col("n")), name(F.col("n") + 1)).alias("ids"))


def probes(s, d):
    return N.first_answers(rows(s, d), questions(s, d)).drop("text")


def answered(s, d):
    q = questions(s, d)
    return N.parsed(N.first_answers(rows(s, d), q), q)


def deliverables(s, d):
    q = questions(s, d, "doc").withColumn("ids", F.slice("ids", 1, 1)).withColumn("chain", F.lit(0).cast("bigint"))
    return N.first_answers(rows(s, d), q, N.HEADING, True)


def oracle(prefix: str, chain: str, ids: str, test: str) -> str:
    return f"""{A.with_tables('log')}, rw AS (SELECT session, ordinal AS idx, CASE WHEN k % 5 = 0 THEN '' WHEN k % 2 = 0 THEN 'note ' || k || chr(10) || 'probe-' || (k % 3) || ': value ' || k || ' ' || chr(10) || 'end' WHEN k % 7 = 0 THEN '# doc-' || (k % 3) || ' title' || chr(10) || 'body' ELSE 'thinking about probe-1 ' || k END AS text FROM log WHERE kind = 'click'),
 q0 AS (SELECT session, ordinal, row_number() OVER (PARTITION BY session ORDER BY ordinal) AS n FROM log WHERE kind = 'signup'),
 q1 AS (SELECT session, {chain} AS chain, n AS wave, CASE WHEN n % 4 <> 0 THEN ordinal END AS "at", {ids} AS ids FROM q0), q AS (SELECT *, lead("at") OVER (PARTITION BY session, chain ORDER BY wave) AS nxt FROM q1),
 c AS (SELECT q.session, q.chain, q.wave, rw.idx, rw.text, {test} AS hit, row_number() OVER (PARTITION BY q.session, q.chain, q.wave ORDER BY rw.idx) AS n FROM q JOIN rw ON rw.session = q.session AND rw.idx > q."at" AND (q.nxt IS NULL OR rw.idx < q.nxt) AND trim(rw.text) <> ''),
 g AS (SELECT session, chain, wave, min(n) FILTER (hit) AS h, min(n) AS f FROM c GROUP BY ALL)"""


ASKED = "['probe-' || (n % 3), 'probe-' || ((n + 1) % 3)]"
HIT = r"regexp_matches(rw.text, '(?m)^\s*(?:' || array_to_string(q.ids, '|') || ')\s*:\s*(\S.*)$')"
PROBES = oracle("probe", "n % 2", ASKED, HIT)
query("answer_windows", probes, PROBES + """ SELECT q.session, q.chain, q.wave, "at" IS NOT NULL AS delivered, h IS NOT NULL AS matched, c.idx AS "at", c.n - 1 AS skipped FROM q LEFT JOIN g USING (session, chain, wave) LEFT JOIN c ON c.session = q.session AND c.chain = q.chain AND c.wave = q.wave AND c.n = h""".replace('"at" IS NOT', 'q."at" IS NOT'))
query("parsed_answers", answered, PROBES + r""", t AS (SELECT q.session, q.chain, q.wave, unnest(q.ids) AS id, coalesce(c.text, '') AS text FROM q LEFT JOIN g USING (session, chain, wave) LEFT JOIN c ON c.session = q.session AND c.chain = q.chain AND c.wave = q.wave AND c.n = h)
 SELECT session, chain, wave, id, CASE WHEN regexp_matches(text, '(?m)^\s*(?:' || id || ')\s*:\s*(\S.*)$') THEN trim(split_part(split_part(text, id || ': ', 2), chr(10), 1)) END AS answer FROM t""")
query("deliverable_texts", deliverables, oracle("doc", "0::BIGINT", "['doc-' || (n % 3)]", r"regexp_matches(rw.text, '(?m)^#+\s*(?:' || q.ids[1] || ')\b(.*)$')") + """ SELECT q.session, q.chain, q.wave, q."at" IS NOT NULL AS delivered, h IS NOT NULL AS matched, c.idx AS "at", c.n - 1 AS skipped, coalesce(c.text, '') AS text
 FROM q LEFT JOIN g USING (session, chain, wave) LEFT JOIN c ON c.session = q.session AND c.chain = q.chain AND c.wave = q.wave AND c.n = coalesce(h, f)""")
