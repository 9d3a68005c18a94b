"""Queries over stored states and fold records, each beside its oracle.

Each event of the log gives a record; some are broken in one way, by the
ordinal, and the oracle knows which way that is.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from ..sources import adapters as A
from .registry import query

SHA = '"' + "a" * 64 + '"'
REF = '{"entryId":"e","role":"user","sessionId":"s","sha256":' + SHA + "}"
MARK = '{"mark":"refold","id":"f","origin":"agent","ordinal":1}'
HEAD = '{"version":2,"kind":"@K","sessionId":"@S","revision":@R,"expanded":["x","y"],"protected":[' + REF + '],"prepared":null,"stateSha256":' + SHA
CHECKPOINT = HEAD.replace("@K", "checkpoint") + ',"foldRefs":[{"id":"f@R","sha256":' + SHA + "}]}"
DELTA = HEAD.replace("@K", "delta") + ',"baseRevision":@B,"baseStateSha256":' + SHA + ',"addFoldRefs":[{"id":"f@R","sha256":' + SHA + '}],"removeFoldIds":["g"]}'
#: What is replaced by what, and the rule that this breaks (null: none).
STATES: list[tuple[str, str, str | None]] = [
    ("", "", None),
    ('"version":2', '"version":1', "version"),
    ('"revision":', '"revision":-', "revision"),
    ('"prepared":null', '"prepared":null,"extra":1', "keys"),
    ('"prepared":null', '"prepared":null,"notices":[]', "retired"),
    ('["x","y"]', '["x","x"]', "expanded"),
    ('["x","y"]', '["x",1]', "expanded"),
    ('"role":"user"', '"role":7', "protected"),
    ('"prepared":null', '"prepared":3', "prepared"),
    ('"prepared":null', '"prepared":null,"leases":{"f":8}', None),
    ('"prepared":null', '"prepared":null,"leases":{"f":9}', "leases"),
    ('"prepared":null', '"prepared":null,"pendingMarks":[' + MARK + "," + MARK + "]", "pendingMarks"),
    ('"prepared":null', '"prepared":null,"pendingMarks":[' + MARK + "]", None),
    ('"prepared":null', '"prepared":null,"briefs":{"f":"told","g":{"brief":"told","provenance":{"kind":"supplied"}}}', None),
    ('"prepared":null', '"prepared":null,"briefs":{"f":" "}', "briefs"),
    ('"prepared":null', '"prepared":null,"tokensSinceToolFold":1.5', "tokensSinceToolFold"),
    ('"stateSha256":"aa', '"stateSha256":"AA', "stateSha256"),
    ("}", "", "json"),
]
DELTA_ONLY = [
    ('"prepared":null', '"prepared":null,"addPendingMarks":[' + MARK + "]", "marks without order"),
    ('"prepared":null', '"prepared":null,"pendingMarks":[],"pendingMarkOrder":[]', "marks and a change to them"),
    ('"prepared":null', '"prepared":null,"briefs":{},"removeBriefIds":["f"]', "briefs and a change to them"),
    ('"baseRevision":', '"baseRevision":-', "baseRevision"),
    ('["g"]', '["g","g"]', "removeFoldIds"),
]
CASES = [*STATES, *DELTA_ONLY]
FOLD = '{"brief":"what was done","createdAt":1,"id":"@I","kind":"chapter","parentId":null,"parts":[{"kind":"raw","ref":' + REF + '},{"foldId":"f@R","kind":"fold"}],"placeholderChars":9,"provenance":{"kind":"supplied"},"sourceChars":10,"sourceSha256":' + SHA + "}"
FOLDS: list[tuple[str, str, str | None]] = [
    ("", "", None), ('"createdAt":1', '"createdAt":2', "recordSha256"), ('"kind":"chapter"', '"kind":"consolidation"', "identity"), ('"kind":"chapter"', '"kind":"other"', "kind"), ('"sourceChars":10', '"sourceChars":0', "sourceChars"),
    ('"parentId":null', '"parentId":"p"', "parentId"), ('"brief":"what was done"', '"brief":"--"', "brief"), ('"kind":"supplied"', '"kind":"model"', "provenance"), ('"role":"user"', '"role":"user","more":1', "parts"),
    ('"version":1', '"version":3', "version"), ('"sessionId":"@S"', '"sessionId":"other"', "sessionId"), ('"foldId":"@I"', '"foldId":"fold_x"', "foldId"), ('"sourceChars":10', '"sourceChars":10,"more":1', "payload"),
]


def _pick(cases, which: int, index):
    return F.element_at(F.array(*(F.lit(c[which]) for c in cases)), index)


def _filled(text, **values):
    for k, v in values.items():
        text = F.replace(text, F.lit(f"@{k}"), v)
    return text


def _broken(whole, cases):
    """The text ``whole`` with its row's case, by number ``case``, worked in; each step is a column, worked out once."""
    r = whole.withColumn("old", _pick(cases, 0, F.col("case"))).withColumn("new", _pick(cases, 1, F.col("case"))).withColumn("at", F.instr("whole", F.col("old")))
    text, old, at = F.col("whole"), F.col("old"), F.col("at")
    cut = F.when(old == "", text).when(old == "}", F.left(text, F.length(text) - 1)).otherwise(F.concat(F.left(text, at - 1), "new", F.substr(text, at + F.length(old))))
    return r.withColumn("json", cut)


def states(s, d):
    """session, ordinal, json: every fourth a checkpoint."""
    check = F.col("ordinal") % 4 == 0
    case = (F.when(check, F.col("ordinal") % len(STATES)).otherwise(F.col("ordinal") % len(CASES)) + 1).cast("int")
    e = A.log(s, d).select("session", "ordinal", case.alias("case"), F.when(check, F.lit(CHECKPOINT)).otherwise(F.lit(DELTA)).alias("whole"))
    return _broken(e, CASES).select("session", "ordinal", _filled(F.col("json"), S=F.col("session").cast("string"), R=F.col("ordinal").cast("string"), B=(F.col("ordinal") - 1).cast("string")).alias("json"))


def folds(s, d):
    e = A.log(s, d).select("session", "ordinal", (F.col("ordinal") % len(FOLDS) + 1).cast("int").alias("case"), F.col("ordinal").cast("string").alias("number"))
    parts = F.lit(FOLD[FOLD.index('"parts":') + 8 : FOLD.index(',"placeholderChars"')])
    ident = F.concat(F.lit("fold_"), F.left(F.sha2(F.concat(F.lit('{"kind":"chapter","parts":'), F.replace(parts, F.lit("@R"), F.col("number")), F.lit("}")), 256), F.lit(24)))
    e = e.withColumn("ident", ident).withColumn("own", _filled(F.lit(FOLD), I=F.col("ident"), R=F.col("number")))
    whole = F.concat(F.lit('{"version":1,"sessionId":"@S","foldId":"@I","recordSha256":"'), F.sha2("own", 256), F.lit('","fold":'), "own", F.lit("}"))
    r = _broken(e.withColumn("whole", whole), FOLDS)
    return r.select("session", "ordinal", _filled(F.col("json"), S=F.col("session").cast("string"), I=F.col("ident")).alias("json"))


def why(cases) -> str:
    return "[" + ", ".join("NULL" if c[2] is None else f"'{c[2]}'" for c in cases) + "]"


L = A.with_tables("log")
STATE = L + f""", st AS (SELECT session, ordinal, ordinal % 4 = 0 AS chk, CASE WHEN ordinal % 4 = 0 THEN {why(STATES)}[ordinal % {len(STATES)} + 1] ELSE {why(CASES)}[ordinal % {len(CASES)} + 1] END AS refused FROM log)"""
query("parsed_states", lambda s, d: R.states(states(s, d)).withColumn("folds", F.array_join("folds", ",")), STATE + """ SELECT session, ordinal, CASE WHEN refused IS NULL THEN CASE WHEN chk THEN 'checkpoint' ELSE 'delta' END END AS kind, CASE WHEN refused IS NULL THEN ordinal END AS revision,
 CASE WHEN refused IS NULL AND NOT chk THEN ordinal - 1 END AS base, CASE WHEN refused IS NULL THEN 'f' || ordinal END AS folds, refused FROM st""")
query("state_refusals", lambda s, d: R.refusals(R.states(states(s, d))), STATE + ' SELECT refused, count(*) AS "rows" FROM st GROUP BY refused')
RECORD = L + f""", fr AS (SELECT session, ordinal, {why(FOLDS)}[ordinal % {len(FOLDS)} + 1] AS refused FROM log)"""
PARTS = FOLD[FOLD.index('"parts":') + 8 : FOLD.index(',"placeholderChars"')].replace("@R", "' || ordinal || '")
query("parsed_fold_records", lambda s, d: R.fold_records(folds(s, d)), RECORD + f""" SELECT session, ordinal, CASE WHEN refused IS NULL THEN 'fold_' || left(sha256('{{"kind":"chapter","parts":{PARTS}}}'), 24) END AS fold, CASE WHEN refused IS NULL THEN 'chapter' END AS kind, CAST(CASE WHEN refused IS NULL THEN 2 END AS INTEGER) AS parts, refused FROM fr""")
query("fold_record_refusals", lambda s, d: R.refusals(R.fold_records(folds(s, d))), RECORD + ' SELECT refused, count(*) AS "rows" FROM fr GROUP BY refused')
