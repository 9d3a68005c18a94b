"""Queries over session trees by intervals, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollback as B
from ..operators import trees as T
from ..sources import adapters as A
from .forest_queries import ANC
from .registry import query


def attempts(s, d):
    """Entries with what a rollback reads: every fifth entry is a custom record, every third answer an error, some answers hold calls."""
    e = A.entries(s, d).withColumn("nbytes", A.octets(F.col("text"))).drop("text")
    assistant = F.col("role") == "assistant"
    return e.select("*", F.when((F.col("role") == "system") | (F.col("entry") % 5 == 0), "custom").otherwise("message").alias("kind"), (assistant & (F.col("entry") % 3 == 0)).alias("error"), (assistant & (F.col("nbytes") % 3 == 0)).alias("call"), ((F.col("role") == "user") & (F.col("nbytes") % 2 == 0)).alias("result"))


ATTEMPTS = ANC + """, att AS (SELECT session, entry, parent, idx, role, octet_length(encode(text)) AS nbytes, CASE WHEN role = 'system' OR entry % 5 = 0 THEN 'custom' ELSE 'message' END AS kind, role = 'assistant' AND entry % 3 = 0 AS error,
  role = 'assistant' AND octet_length(encode(text)) % 3 = 0 AS call, role = 'user' AND octet_length(encode(text)) % 2 = 0 AS result FROM entries),
 bt AS (SELECT att.*, br.leaf FROM att JOIN br USING (session, entry)),
 er AS (SELECT session, leaf, entry AS error_entry, parent AS new_leaf, idx AS "at" FROM bt WHERE kind = 'message' AND role = 'assistant' AND error AND idx = (SELECT max(idx) FROM bt b WHERE b.session = bt.session AND b.kind = 'message'))"""

query("tree_intervals", lambda s, d: T.intervals(A.entries(s, d)).select("session", "entry", "pre", "size", "depth"), ANC + """, pa AS (SELECT node AS entry, list(e.idx ORDER BY a.distance DESC) AS path, max(distance) AS depth FROM a JOIN entries e ON e.entry = a.above GROUP BY node),
 sz AS (SELECT above AS entry, count(*) AS size FROM a GROUP BY above)
 SELECT session, entry, row_number() OVER (PARTITION BY session ORDER BY path) - 1 AS pre, size, depth FROM entries JOIN sz USING (entry) JOIN pa USING (entry)""")


def contained(s, d):
    """Pairs that preorder finds by range, for the entries that others fork from."""
    i = T.intervals(A.entries(s, d))
    forks = A.entries(s, d).where("parent is not null").groupBy("session", F.col("parent").alias("entry")).count().where("count > 1")
    top = i.join(forks.select("session", "entry"), ["session", "entry"]).select("session", F.col("entry").alias("fork"), F.col("pre").alias("a"), (F.col("pre") + F.col("size")).alias("b"))
    return i.join(top, "session").where("pre >= a and pre < b").groupBy("session", "fork").agg(F.count("*").alias("inside"), F.sum("entry").alias("sum"))


query("fork_contents", contained, ANC + """, fk AS (SELECT parent AS fork FROM entries WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) > 1)
 SELECT session, fork, count(*) AS inside, CAST(sum(a.node) AS BIGINT) AS "sum" FROM fk JOIN a ON a.above = fork JOIN entries e ON e.entry = fork GROUP BY session, fork""")
query("answer_requests", lambda s, d: T.nearest_above(A.entries(s, d), F.col("role") == "user").join(A.entries(s, d).where("role = 'assistant'").select("session", "entry"), ["session", "entry"]).select("session", "entry", F.col("found").alias("request")), ANC + """
 SELECT e.session, e.entry, arg_min(r.entry, a.distance) AS request FROM entries e LEFT JOIN (a JOIN entries r ON r.entry = a.above AND r.role = 'user') ON a.node = e.entry AND a.distance > 0 WHERE e.role = 'assistant' GROUP BY e.session, e.entry""")
query("overflow_errors", lambda s, d: B.overflow_errors(B.branch_rows(attempts(s, d))), ATTEMPTS + " SELECT * FROM er")
query("overflow_recovery", lambda s, d: B.recover(attempts(s, d), B.branch_rows(attempts(s, d))), ATTEMPTS + """, ca AS (SELECT t.entry, arg_min(c.entry, a.distance) AS found FROM att t JOIN a ON a.node = t.entry AND a.distance > 0 JOIN att c ON c.entry = a.above AND c.call AND c.kind = 'message' WHERE t.result AND t.kind = 'message' GROUP BY t.entry),
 k AS (SELECT bt.*, er.error_entry, er.new_leaf, er."at", bt.idx < er."at" AS kept FROM bt JOIN er USING (session)),
 g AS (SELECT session, leaf, error_entry, new_leaf, count(*) FILTER (NOT kept) AS entries_abandoned, CAST(ceil(coalesce(sum(nbytes) FILTER (NOT kept AND kind = 'message'), 0) / 4.0) AS BIGINT) AS tokens_rolled_back,
  count(*) FILTER (kind = 'message') AS messages_before, count(*) FILTER (kind = 'message' AND kept) AS messages_after, max(idx) FILTER (kind = 'message' AND kept AND role = 'assistant' AND (call OR NOT error)) AS deciding FROM k GROUP BY ALL),
 pe AS (SELECT g.*, b.entry AS pending FROM g LEFT JOIN bt b ON b.session = g.session AND b.idx = deciding AND b.call),
 w AS (SELECT *, CASE WHEN messages_after <> messages_before - 1 THEN 'strip' WHEN pending IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k JOIN ca ON ca.entry = k.entry WHERE k.session = pe.session AND k.kept AND ca.found = pending) THEN 'unanswered' END AS why FROM pe)
 SELECT session, error_entry, leaf AS old_leaf, new_leaf, entries_abandoned, tokens_rolled_back, messages_before, messages_after, messages_after = messages_before - 1 AS holds, why IS NULL AS replayed, why AS replay_skip_reason FROM w""")
