"""Scalar functions of the session model, as Column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that retrieval does not count.
STOP_WORDS = """about after again against already also another because been
before being between both came come could does doing done
down during each either else even ever every exact exactly
first from have having here into just keep kept like made
make many more most much must need next none only other
over same should since some such take than that their them
then there these they this those through under until upon
very want were what when where which while will with would
your""".split()

#: What providers say when a window overflows.
OVERFLOW = r"(?i)context (?:length|window)|maximum context|too many tokens|token limit|exceeds? the (?:model|context)|prompt is too long|input length"
#: Planted words; quoted includes; oversized tools' names.
PLANTED = r"(?:cw|lv)-[0-9a-f]{6}"
INCLUDE = r'^\s*#\s*include[ \t]+"([^"]+)"'
MCP_TOOL = r"^mcp__(.+?)__.+$"
#: Kinds of definitions and the patterns of their lines, the first that matches counts.
DEFINITIONS = [
    ("fn", r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("struct", r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?struct\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?:<[^>]*>)?\s*(?:\{|;|\(|$)"),
    ("enum", r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?enum\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?:<[^>]*>)?\s*(?:\{|;|$)"),
    ("trait", r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?trait\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?:<[^>]*>)?\s*(?:\{|:|$)"),
    ("func", r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)"),
    ("type", r"^\s*type\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("def", r"^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("class", r"^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)"),
]


def retrieval_tokens(text: Column) -> Column:
    """Lower-case tokens of four characters or more, without edge underscores and stop words; repeated ones stay."""
    # from the first letter or digit of a run to its last: edge underscores stay outside
    parts = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9_]{2,}[a-z0-9]"), F.lit(0))
    return F.filter(parts, lambda x: ~x.isin(*STOP_WORDS))


def utf8_head(text: Column, n: int | Column) -> Column:
    """The longest whole-character beginning of at most n bytes."""
    raw = F.encode(text, "UTF-8")
    n = F.lit(n) if isinstance(n, int) else n
    cut = lambda less: F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(n - less, F.lit(0))).cast("string"))
    return F.coalesce(*(cut(i) for i in range(4)))


def utf8_tail(text: Column, n: int | Column) -> Column:
    """The longest whole-character end of at most n bytes."""
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(text)
    n = F.lit(n) if isinstance(n, int) else n
    start = F.greatest(size - n, F.lit(0)) + 1
    cut = lambda more: F.try_validate_utf8(F.substring(raw, start + more, size).cast("string"))
    return F.coalesce(*(cut(i) for i in range(4)))


def utf8_slice(text: Column, offset: int | Column) -> Column:
    """What begins at a byte offset, without a broken first character."""
    o = F.lit(offset) if isinstance(offset, int) else offset
    return utf8_tail(text, F.greatest(F.octet_length(text) - o, F.lit(0)))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(text) + F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", ""))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def bounded_subject(text: Column, budget: int) -> Column:
    """Up to ``budget`` characters, cut ones ending in three dots."""
    return F.when(F.length(text) > budget, F.concat(F.rtrim(F.left(text, F.lit(budget - 3))), F.lit("..."))).otherwise(text)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4).cast("bigint")


def structurally_valid_brief(text: Column, cap: int) -> Column:
    return (F.regexp_count(text, F.lit("[A-Za-z0-9]")) >= 3) & (F.length(text) <= cap)


def normalized_answer(text: Column) -> Column:
    """Without quotes, emphasis, closing punctuation, ./ and a line number after a path."""
    x = F.trim(text)
    for _ in range(3):
        x = F.trim(F.regexp_replace(F.regexp_replace(x, r"""^["'`*_]+|["'`*_.,;:!]+$""", ""), r"^\./", ""))
    return F.regexp_replace(x, r"^(\S*[/.]\S*):\d+$", "$1")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def wilson_lower(successes: Column, trials: Column, z: float = 1.6448536269514722) -> Column:
    """One-sided 95 % lower bound of a share; 0 without trials."""
    n, s = trials.cast("double"), successes.cast("double")
    p = F.try_divide(s, n)
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(trials > 0, low).otherwise(0.0)


def overflowed(text: Column) -> Column:
    return F.coalesce(text.rlike(OVERFLOW), F.lit(False))


def mcp_server(tool: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(tool, MCP_TOOL, 1), F.lit("")), F.lit(fallback))


def safe_segment(text: Column) -> Column:
    return F.left(F.regexp_replace(text, "[^a-zA-Z0-9_.-]", "_"), F.lit(120))


def prefix_length(a: Column, b: Column) -> Column:
    """How many first elements two arrays have in common."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first > 0, F.least(first - 1, F.size(a), F.size(b))).otherwise(F.least(F.size(a), F.size(b))).cast("bigint")
