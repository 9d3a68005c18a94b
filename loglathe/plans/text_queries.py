"""Queries over texts, answers and evidence, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import texts as T
from ..sources import adapters as A
from .registry import query

LOG, M = A.with_tables("log"), A.with_tables("messages")


def documents(s, d):
    return A.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")


def pages(s, d):
    return A.table(s, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))


def both(s, d):
    """All lines of documents and, under negative ids, of pages."""
    return documents(s, d).select("id", "text").unionByName(pages(s, d).select((-1 - F.col("id")).alias("id"), "text"))


def quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


L = """WITH b AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - page_id, html FROM pages), l AS (SELECT id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, unnest(string_split(text, chr(10))) AS line FROM b)"""
DEFS = L + ", df AS (SELECT id, CAST(n AS INTEGER) AS n, CASE " + " ".join(f"WHEN regexp_matches(line, {quoted(p)}) THEN '{k}'" for k, p in X.DEFINITIONS) + " END AS kind, CASE " + " ".join(f"WHEN regexp_matches(line, {quoted(p)}) THEN regexp_extract(line, {quoted(p)}, 1)" for k, p in X.DEFINITIONS) + " END AS identifier FROM l WHERE length(line) <= 400)"
query("definitions", lambda s, d: T.definitions(both(s, d)), DEFS + " SELECT id, n, kind, identifier FROM df WHERE kind IS NOT NULL")
query("unique_identifiers", lambda s, d: T.unique_identifiers(T.definitions(both(s, d))), DEFS + " SELECT identifier, min(id) AS id, min(n) AS n FROM df WHERE kind IS NOT NULL GROUP BY identifier HAVING count(DISTINCT id) = 1")
query("include_specs", lambda s, d: T.includes(both(s, d)), L + f" SELECT id, CAST(n AS INTEGER) AS n, regexp_extract(line, {quoted(X.INCLUDE)}, 1) AS target FROM l WHERE regexp_matches(line, {quoted(X.INCLUDE)})")


def planted(s, d):
    """Words that are planted: of each document's digest six digits."""
    return documents(s, d).select(F.concat(F.lit("cw-"), F.left(F.sha2("text", 256), F.lit(6))).alias("word")).distinct()


def carrying(s, d):
    """Documents with the planted word of the document after them at the end."""
    t = documents(s, d)
    other = t.select((F.col("id") - 1).alias("id"), F.concat(F.lit(" cw-"), F.left(F.sha2("text", 256), F.lit(6))).alias("more"))
    return t.join(other, "id", "left").select("id", F.concat("text", F.coalesce("more", F.lit(""))).alias("text"))


query("planted_collisions", lambda s, d: T.collisions(carrying(s, d), planted(s, d)), """WITH p AS (SELECT DISTINCT 'cw-' || left(sha256(text), 6) AS word FROM documents), t AS (SELECT a.doc_id AS id, a.text || coalesce(' cw-' || left(sha256(b.text), 6), '') AS text FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1),
 f AS (SELECT id, unnest(regexp_extract_all(text, '(?:cw|lv)-[0-9a-f]{6}')) AS word FROM t) SELECT word, count(*) AS times, count(DISTINCT id) AS texts FROM f JOIN p USING (word) GROUP BY word""")
query("file_facts", lambda s, d: T.file_facts(documents(s, d)), """SELECT doc_id AS id, sha256(text) AS sha, length(text) - length(replace(text, chr(10), '')) AS lines, length(text) AS chars, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents""")
query("corpus_manifest", lambda s, d: T.manifest(documents(s, d)), """WITH i AS (SELECT doc_id % 256 AS part, sha256(string_agg(doc_id || ':' || sha256(text), ',' ORDER BY doc_id)) AS sha, count(*) AS n FROM documents GROUP BY doc_id % 256)
 SELECT sha256(string_agg(sha, ',' ORDER BY part)) AS sha, CAST(sum(n) AS BIGINT) AS texts FROM i""")

ANSWERS = LOG + """, a AS (SELECT session, ordinal, kind, lag(k) OVER w AS truth, CASE WHEN kind <> 'error' THEN CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS BIGINT) END AS answer, lag(k, 2) OVER w AS own FROM log WINDOW w AS (PARTITION BY session, kind ORDER BY ordinal))"""
V = "CASE WHEN answer IS NULL THEN 'unanswered' WHEN {0} IS NULL THEN 'unknown' WHEN abs(answer - {0}) <= {1} THEN 'match' ELSE 'mismatch' END"
query("probe_answers", lambda s, d: T.answers(A.log(s, d)), ANSWERS + " SELECT * FROM a")
query("mechanical_verdicts", lambda s, d: T.mechanical(T.answers(A.log(s, d))), ANSWERS + f" SELECT kind, {V.format('truth', 20)} AS verdict, count(*) AS n, count(DISTINCT session) AS sessions FROM a GROUP BY 1, 2")
query("echo_verdicts", lambda s, d: T.echoes(T.answers(A.log(s, d))), ANSWERS + f", v AS (SELECT {V.format('own', 20)} AS o, {V.format('truth', 20)} AS t FROM a) SELECT o AS own, t AS truth, count(*) AS n FROM v GROUP BY o, t")
query("integrity_prefix", lambda s, d: T.integrity(T.answers(A.log(s, d))), ANSWERS + f""", v AS (SELECT session, ordinal, CAST({V.format('truth', 60)} IN ('match', 'unknown') AS INT) AS ok FROM a), r AS (SELECT *, min(ok) OVER (PARTITION BY session ORDER BY ordinal) AS sofar FROM v)
 SELECT session, CAST(sum(sofar) AS BIGINT) AS prefix, count(*) AS steps, CAST(sum(ok) AS BIGINT) AS matches FROM r GROUP BY session""")
query("recovery_window", lambda s, d: T.recovery_windows(A.log(s, d)), LOG + """, w AS (SELECT v.session, v.ordinal, (SELECT min(ordinal) FROM log c WHERE c.session = v.session AND c.kind = 'click' AND c.ordinal > v.ordinal) AS answer,
 (SELECT max(ordinal) FROM log c WHERE c.session = v.session AND c.kind = 'purchase' AND c.ordinal < v.ordinal) AS reset FROM log v WHERE v.kind = 'view')
 SELECT *, CASE WHEN answer IS NOT NULL THEN (SELECT count(*) FROM log x WHERE x.session = w.session AND x.kind = 'signup' AND x.ordinal > w.ordinal AND x.ordinal < w.answer) END AS signups,
 CASE WHEN answer IS NOT NULL THEN (SELECT count(*) FROM log x WHERE x.session = w.session AND x.kind = 'error' AND x.ordinal > w.ordinal AND x.ordinal < w.answer) END AS errors FROM w""")
query("provenance", lambda s, d: T.provenance(A.messages(s, d), "with"), M + """ SELECT session, min(idx) AS first, arg_min(role, idx) AS producer, count(*) - 1 AS echoes FROM messages WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])with($|[^a-z0-9_])') GROUP BY session""")
NORM = "trim(string_split(text, chr(10))[1])"
for _ in range(3):
    NORM = f"trim(regexp_replace(regexp_replace({NORM}, '^[\"''`*_]+|[\"''`*_.,;:!]+$', '', 'g'), '^\\./', ''))"
query("normalize_answers", lambda s, d: T.normalized(A.messages(s, d)), M + f", n AS (SELECT regexp_replace({NORM}, '^(\\S*[/.]\\S*):\\d+$', '\\1') AS answer, session FROM messages) SELECT answer, count(*) AS \"rows\", count(DISTINCT session) AS sessions FROM n GROUP BY answer")
query("evidence_preview", lambda s, d: T.previews(documents(s, d), 2048), """WITH k AS (SELECT doc_id AS id, text, octet_length(encode(text)) AS bytes, list_max([x FOR x IN range(greatest(0, 2048 - 1100), least(length(text), 2048) + 1) IF octet_length(encode(left(text, x))) <= 2048]) AS h FROM documents WHERE octet_length(encode(text)) > 2048)
 SELECT id, octet_length(encode(left(text, h))) AS shown, bytes - octet_length(encode(left(text, h))) AS omitted, '[full text: sha256/' || left(sha256(text), 2) || '/' || sha256(text) || ', ' || bytes || ' bytes]' AS reference, sha256(left(text, h)) AS head_sha FROM k""")
query("artifact_store", lambda s, d: T.artifacts(documents(s, d)), """SELECT 'sha256/' || left(sha256(text), 2) || '/' || sha256(text) AS path, CAST(max(octet_length(encode(text))) AS BIGINT) AS bytes, min(doc_id) AS first_owner, count(*) AS owners FROM documents GROUP BY sha256(text)""")
query("brief_function_survival", lambda s, d: T.survival(documents(s, d), 400), """WITH w AS (SELECT lang, text, string_split(text, chr(10)) AS ls, list_max([{'n': length(x), 'w': x} FOR x IN regexp_split_to_array(text, '[^A-Za-z]+')]).w AS fact FROM documents),
 b AS (SELECT lang, fact, 'head' AS way, left(text, 400) AS brief FROM w UNION ALL SELECT lang, fact, 'tail', right(text, 400) FROM w UNION ALL SELECT lang, fact, 'first line', ls[1] FROM w UNION ALL SELECT lang, fact, 'first and last line', ls[1] || chr(10) || ls[-1] FROM w)
 SELECT lang, way, count(*) AS texts, count(*) FILTER (contains(brief, fact)) AS carried, round(avg(length(brief)), 3) AS mean_chars FROM b GROUP BY lang, way""")
query("submission_ids", lambda s, d: T.submission_ids(documents(s, d), "salt"), "SELECT doc_id AS id, 'sub-' || left(sha256('salt:' || doc_id), 16) AS submission FROM documents")
query("blind_packet", lambda s, d: T.blind_packet(documents(s, d), "salt"), "SELECT 'sub-' || left(sha256('salt:' || doc_id), 16) AS submission, sha256(text) AS sha, length(text) AS chars FROM documents")
query("seeded_shuffle", lambda s, d: T.shuffled_sessions(A.messages(s, d), "seed"))
