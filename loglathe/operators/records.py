"""Stored states and fold records: read if they are whole, else refused by name.

Columns session and json are read.  Each row gives ``refused``, the name of the
first rule that it breaks (null: none), and where it is whole its fields.  What
one row can show is checked here; chains of deltas are in ``states``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes as S

#: Limits of stored records, fields that no build reads any more, kinds and origins.
FOLDS, PARTS, EXPANDED, PROTECTED, MARKS, BRIEF = 4096, 1024, 1024, 1024, 256, 2000
RECORD_BYTES, STATE_BYTES = 256 * 1024, 512 * 1024
LEASES, LEASE = 64, 8
RETIRED = ("lastCall", "notices", "surfacing")
KINDS, ORIGINS = ("tool-result", "chapter", "consolidation"), ("agent", "ladder")

DIGEST = S.text(S.DIGEST)
ANY = S.text()
REF = S.record({"sessionId": ANY, "entryId": ANY, "role": ANY, "sha256": DIGEST})
RECORD_REF = S.record({"id": ANY, "sha256": DIGEST})
PROVENANCE = S.either(S.record({"kind": S.one_of("supplied", "deterministic")}), S.record({"kind": S.one_of("model", "luna"), "provider": ANY, "model": ANY, "effort": ANY}, {"launchContractDigest": DIGEST}))
PART = S.either(S.record({"kind": S.one_of("raw"), "ref": REF}), S.record({"kind": S.one_of("fold"), "foldId": ANY}))
BRIEF_TEXT = S.text("[A-Za-z0-9].*[A-Za-z0-9].*[A-Za-z0-9]", most=BRIEF)
FOLD = S.record({"id": ANY, "kind": S.one_of(*KINDS), "parentId": S.either(S.nothing, S.text(least=0)), "parts": S.items(PART, PARTS, 1), "brief": BRIEF_TEXT, "provenance": PROVENANCE, "sourceSha256": DIGEST, "sourceChars": S.whole(1), "placeholderChars": S.whole(1), "createdAt": S.whole()})
MARK = S.either(
    S.record({"mark": S.one_of("refold"), "id": ANY, "origin": S.one_of(*ORIGINS), "ordinal": S.whole()}),
    S.record({"mark": S.one_of("fold"), "id": ANY, "kind": S.one_of(*KINDS), "parts": S.items(PART, PARTS, 1), "brief": BRIEF_TEXT, "briefProvenance": PROVENANCE, "origin": S.one_of(*ORIGINS), "ordinal": S.whole()}),
)
MARK_LIST = S.items(MARK, MARKS, unique=lambda m: F.concat_ws(":", S.field(m, "mark", "string"), S.field(m, "id", "string")))
OVERRIDES = S.entries(S.either(S.text(r"\S", most=BRIEF), S.record({"brief": S.text(r"\S", most=BRIEF), "provenance": PROVENANCE})), FOLDS)
STRINGS = lambda most: S.items(ANY, most, unique=lambda x: F.try_variant_get(x, "$", "string"))
RECORD_REFS = S.items(RECORD_REF, FOLDS, unique=lambda r: S.field(r, "id", "string"))
PROTECTION = S.items(REF, PROTECTED, unique=lambda r: F.to_json(r))
#: What both forms of a state may say of a projection.
OPTIONAL = {"tokensSinceToolFold": S.whole(), "leases": S.entries(S.whole(1, LEASE), LEASES), "pendingMarks": MARK_LIST, "briefs": OVERRIDES}
CHANGES = {"addPendingMarks": MARK_LIST, "pendingMarkOrder": STRINGS(MARKS), "addBriefs": OVERRIDES, "removeBriefIds": STRINGS(FOLDS)}
HEAD = {"version": S.one_of(2), "kind": S.one_of("checkpoint", "delta"), "sessionId": ANY, "revision": S.whole(), "stateSha256": DIGEST}
BODY = {"expanded": STRINGS(EXPANDED), "protected": PROTECTION, "prepared": S.either(S.nothing, S.record({}, exact=False))}
CHECKPOINT = S.record({**HEAD, **BODY, "foldRefs": RECORD_REFS}, {**OPTIONAL, **CHANGES})
DELTA = S.record({**HEAD, **BODY, "baseRevision": S.whole(), "baseStateSha256": DIGEST, "addFoldRefs": RECORD_REFS, "removeFoldIds": STRINGS(FOLDS)}, {**OPTIONAL, **CHANGES})


def _read(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.try_parse_json("json"))


def _first(*rules: tuple[Column, str] | Column) -> Column:
    return F.coalesce(*(F.when(F.coalesce(r[0], F.lit(False)), F.lit(r[1])) if isinstance(r, tuple) else r for r in rules))


def states(df: DataFrame) -> DataFrame:
    """session, kind, revision, base, folds, refused: states of the second version, whole or refused by name.

    A change to marks or briefs may not stand beside the whole of them, and
    marks are not added without their order.
    """
    v = F.col("v")
    of = S.field(v, "kind", "string")
    shape = F.when(of == "delta", DELTA(v, "keys")).otherwise(CHECKPOINT(v, "keys"))
    refused = _first(
        (v.isNull(), "json"),
        (S.has(v, *RETIRED), "retired"),
        shape,
        (S.field(v, "sessionId", "string") != F.col("session").cast("string"), "sessionId"),
        ((of == "delta") & S.has(v, "addPendingMarks") & ~S.has(v, "pendingMarkOrder"), "marks without order"),
        ((of == "delta") & S.has(v, "pendingMarks") & S.has(v, "addPendingMarks", "pendingMarkOrder"), "marks and a change to them"),
        ((of == "delta") & S.has(v, "briefs") & S.has(v, "addBriefs", "removeBriefIds"), "briefs and a change to them"),
        (F.octet_length("json") > STATE_BYTES, "bytes"),
    )
    r = _read(df).withColumn("refused", refused)
    keep = lambda c: F.when(F.col("refused").isNull(), c)
    refs = F.coalesce(F.try_variant_get(v, "$.foldRefs", "array<variant>"), F.try_variant_get(v, "$.addFoldRefs", "array<variant>"))
    others = [c for c in df.columns if c not in ("json", "kind", "revision", "base", "folds", "refused")]
    return r.select(*others, keep(of).alias("kind"), keep(S.field(v, "revision", "bigint")).alias("revision"), keep(S.field(v, "baseRevision", "bigint")).alias("base"), keep(F.transform(refs, lambda x: S.field(x, "id", "string"))).alias("folds"), "refused")


def fold_id(v: Column) -> Column:
    """The identifier that a fold's kind and parts give, from canonical JSON: fields in order, no blanks."""
    own = F.concat(F.lit('{"kind":'), F.to_json(S.field(v, "kind")), F.lit(',"parts":'), F.to_json(S.field(v, "parts")), F.lit("}"))
    return F.concat(F.lit("fold_"), F.left(F.sha2(own, 256), F.lit(24)))


def fold_records(df: DataFrame) -> DataFrame:
    """session, fold, kind, parts, refused: records of folds, whole or refused by name; identity is told from content."""
    v, fold = F.col("v"), S.field(F.col("v"), "fold")
    outer = S.record({"version": S.one_of(1), "sessionId": ANY, "foldId": S.text(least=0), "recordSha256": S.text(least=0), "fold": S.record({}, exact=False)})
    refused = _first(
        (v.isNull(), "json"),
        outer(v, "keys"),
        (S.field(v, "sessionId", "string") != F.col("session").cast("string"), "sessionId"),
        FOLD(fold, "payload"),
        (~F.is_variant_null(S.field(fold, "parentId")), "parentId"),
        (S.field(fold, "id", "string") != S.field(v, "foldId", "string"), "foldId"),
        (S.field(fold, "id", "string") != fold_id(fold), "identity"),
        (F.sha2(F.to_json(fold), 256) != S.field(v, "recordSha256", "string"), "recordSha256"),
        (F.octet_length("json") > RECORD_BYTES, "bytes"),
    )
    r = _read(df).withColumn("refused", refused)
    keep = lambda c: F.when(F.col("refused").isNull(), c)
    others = [c for c in df.columns if c not in ("json", "fold", "kind", "parts", "refused")]
    return r.select(*others, keep(S.field(fold, "id", "string")).alias("fold"), keep(S.field(fold, "kind", "string")).alias("kind"), keep(F.size(F.try_variant_get(fold, "$.parts", "array<variant>"))).alias("parts"), "refused")


def refusals(parsed: DataFrame) -> DataFrame:
    """How many rows each rule refused; null: whole ones."""
    return parsed.groupBy("refused").agg(F.count("*").alias("rows"))
