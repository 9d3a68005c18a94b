"""Quality rules and n-gram perplexity with language-specific bands.

The model is a modified Kneser-Ney model of order 4 over a fixed alphabet of
64 symbols (letters without case, digits as one, punctuation, symbols, bytes
of other letters in 16 classes): all n-grams of all texts are counted, partly
within each task and then by Spark, and kept as sorted arrays of hashes in a
stored table, one model for each language, which executors fit and which
readers open by language.  An n-gram is 24 bits, its hash a bijection of them,
so that a model has 64**4 entries at most, whatever the corpus.  A document's
log-perplexity has to lie within its language's bands, which are set from the
quartiles over all documents of the language, however few they are.

Defined results: null and empty texts have no words and fail the base rules;
very long texts are handled whole; equal texts get equal figures; a null
language is a language of its own; tables without rows give no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

ORDER = 4
#: Models that a worker holds at once.
HELD_MODELS = 8
#: Bands: quartiles plus and minus so many times the quartiles' distance, which counts as LEAST_SPREAD at least; README has what they reject.
LOWER, UPPER, LEAST_SPREAD = 2.0, 2.0, 0.008

#: Characters that count as symbols, and punctuation with a symbol of its own.
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?'\"-()/"

IS_SYMBOL = np.zeros(256, np.uint8)
IS_SYMBOL[list(SYMBOLS)] = 1


def _alphabet() -> np.ndarray:
    out = np.full(256, 0, np.uint8)  # white space and control characters
    for i in range(26):
        out[97 + i] = out[65 + i] = 1 + i
    out[48:58] = 27
    for i, b in enumerate(SYMBOLS + PUNCTUATION):
        out[b] = 28 + i
    rest = [b for b in range(33, 127) if not out[b]]
    out[rest] = 47
    out[128:] = 48 + (np.arange(128, 256) & 15)
    out[47] = 46
    return out


ALPHABET = _alphabet()


# --------------------------------------------------------------- base figures
def repeats(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def by_text(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return C.mix(h ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each \\n-split line that is not empty."""
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offs, breaks + 1]))
    starts = edges[:-1]
    ends = edges[1:] - (data[np.minimum(edges[1:], len(data)) - 1] == 10) if len(starts) else edges[1:]
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def figures(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of each text."""
    n = len(offs) - 1
    starts, ends, per = C.words(data, offs)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offs])
    in_word = C._IN_WORD[data]
    chars = total(in_word & ((data & 0xC0) != 0x80))
    first, last, owner = lines(data, offs)
    inner = np.concatenate([[0], np.cumsum(in_word, dtype=np.int64)])
    some = inner[last] > inner[first]
    first, last, owner = first[some], last[some], owner[some]
    keys = np.sort(by_text(C.span_hash(data, first, last), owner))
    n_lines = np.bincount(owner, minlength=n)
    distinct = np.zeros(n, np.int64)
    if len(keys):
        order = np.argsort(by_text(C.span_hash(data, first, last), owner), kind="stable")
        fresh = np.append(True, keys[1:] != keys[:-1])
        distinct = np.bincount(owner[order[fresh]], minlength=n)
    h = C.span_hash(data, starts, ends)
    whole, doc = C.in_text(per, 3)
    windows = C.window_hash(h, 3)
    twice = np.zeros(len(doc) + 3, np.int64)
    if len(windows):
        at = np.flatnonzero(whole)
        at = at[repeats(by_text(windows[at], doc[at]))]
        np.add.at(twice, at, 1)
        np.add.at(twice, at + 3, -1)
    covered = np.cumsum(twice)[: len(doc)] > 0
    return {"n_words": per, "word_chars": chars, "n_symbols": total(IS_SYMBOL[data]), "n_dup_lines": n_lines - distinct, "n_repeat_words": np.bincount(doc[covered], minlength=n), "n_lines": n_lines}


# --------------------------------------------------------------------- n-grams
def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram of symbols that ends at each symbol (white space before the text), and symbols per text; runs of white space are one."""
    s = ALPHABET[data]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    inner = offs[(offs > 0) & (offs < len(s))]
    keep[inner] = True
    kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[offs]
    s = s[keep].astype(np.uint32)
    per = np.diff(kept)
    out = s.copy()
    for k in range(1, ORDER):
        out[k:] |= s[:-k] << np.uint32(6 * k)
    begin = kept[:-1][per > 0]
    for k in range(ORDER - 1):  # nothing of the text before
        at = begin + k
        at = at[k < per[per > 0]]
        out[at] &= np.uint32((1 << 6 * (k + 1)) - 1)
    return out, per


def hashed(keys: np.ndarray) -> np.ndarray:
    """A bijection of 24-bit integers."""
    k = keys.astype(np.uint32)
    k = (k * np.uint32(0x9E3779)) & np.uint32(0xFFFFFF)
    return k ^ (k >> np.uint32(12))


def count_grams(df: DataFrame) -> DataFrame:
    """language, gram, n: all n-grams of all texts (text, language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, index = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(index, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def rows() -> pa.RecordBatch:
            keys, n = merged()
            language = pa.DictionaryArray.from_arrays(pa.array((keys >> np.uint64(24)).astype(np.int32)), pa.array(list(names), pa.string())).cast(pa.string())
            return pa.RecordBatch.from_arrays([language, pa.array((keys & np.uint64(0xFFFFFF)).astype(np.int32)), pa.array(n)], ["language", "gram", "n"])

        for batch in C.chunks(batches):
            got, per = grams(*C.buffers(batch.column("text")))
            number = np.array([names.setdefault(x, len(names)) for x in batch.column("language").to_pylist()], np.uint64)
            keys = np.sort(got.astype(np.uint64) | (np.repeat(number, per) << np.uint64(24)))
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            held.append((keys[at], np.diff(np.append(at, len(keys)))))
            if len(held) > 15:
                held = [merged()]
                if len(held[0][0]) > 2_000_000:
                    yield rows()
                    held = []
        if held:
            yield rows()

    return df.select("text", "language").mapInArrow(run, "language string, gram int, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(grams_: np.ndarray, counts: np.ndarray) -> dict:
    """Modified Kneser-Ney: for each order sorted hashes with log10 probabilities, and of contexts with log10 back-off weights."""
    orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    keys, n = grams_.astype(np.int64), counts.astype(np.float64)
    orders[ORDER] = keys, n
    for k in range(ORDER - 1, 0, -1):  # lower orders count what they continue
        keys, n = np.unique(keys & ((1 << 6 * k) - 1), return_counts=True)
        orders[k] = keys, n.astype(np.float64)
    below_keys, below = np.zeros(1, np.int64), np.full(1, 1 / 64)
    out: dict = {}
    for k in range(1, ORDER + 1):
        keys, n = orders[k]
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        have = [float((n == i).sum()) for i in range(1, 5)]
        y = have[0] / max(1.0, have[0] + 2 * have[1])
        cut = [min(i, max(0.1 * i, i - (i + 1) * y * have[i] / have[i - 1])) if have[i - 1] else 0.5 * i for i in (1, 2, 3)]
        discount = np.choose(np.minimum(n, 3).astype(int) - 1, cut)
        context, inverse = np.unique(keys >> 6, return_inverse=True)
        total = np.bincount(inverse, n)
        gamma = np.bincount(inverse, discount) / total
        low = below[np.searchsorted(below_keys, keys & ((1 << 6 * (k - 1)) - 1))] if k > 1 else np.full(len(keys), 1 / 64)
        p = (n - discount) / total[inverse] + gamma[inverse] * low
        below_keys, below = keys, p
        h, c = hashed(keys), hashed(context)
        by_key, by_context = np.argsort(h), np.argsort(c)
        out[k] = {"keys": h[by_key], "log": np.log10(p)[by_key].astype(np.float32), "contexts": c[by_context], "back": np.log10(gamma)[by_context].astype(np.float32)}
    return out


def log_probability(model: dict, keys: np.ndarray) -> np.ndarray:
    """log10 of each n-gram's last symbol given those before, backing off where an n-gram was not counted."""
    out = np.zeros(len(keys), np.float32)
    todo = np.arange(len(keys))
    for k in range(ORDER, 0, -1):
        own = keys[todo] & np.uint32((1 << 6 * k) - 1)
        m = model[k]
        h = hashed(own)
        i = np.minimum(np.searchsorted(m["keys"], h), len(m["keys"]) - 1)
        found = m["keys"][i] == h
        out[todo[found]] += m["log"][i[found]]
        todo, own = todo[~found], own[~found]
        if not len(todo):
            return out
        h = hashed(own >> np.uint32(6))
        i = np.minimum(np.searchsorted(m["contexts"], h), len(m["contexts"]) - 1)
        known = m["contexts"][i] == h
        out[todo[known]] += m["back"][i[known]]
    out[todo] += np.float32(np.log10(1 / 64))
    return out


ARRAYS = [(f"{name}{k}", name, k, kind) for k in range(1, ORDER + 1) for name, kind in (("keys", np.uint32), ("log", np.float32), ("contexts", np.uint32), ("back", np.float32))]
MODEL = "language string, " + ", ".join(f"{column} binary" for column, *_ in ARRAYS)


def train(df: DataFrame) -> DataFrame:
    """MODEL: a stored row of sorted arrays for each language, each fitted in one task (from 64**4 n-grams at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def fitted() -> pa.RecordBatch:
            gram, n = (np.concatenate(x) for x in zip(*held))
            model = kneser_ney(gram, n)
            return pa.RecordBatch.from_arrays([pa.array([now]), *(pa.array([np.ascontiguousarray(model[k][name].astype(kind)).tobytes()], pa.binary()) for _, name, k, kind in ARRAYS)], ["language", *(c for c, *_ in ARRAYS)])

        for batch in batches:
            language = batch.column("language").to_pylist()
            edges = [0, *(i for i in range(1, len(language)) if language[i] != language[i - 1]), len(language)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if held and language[a] != now:
                    yield fitted()
                    held = []
                now = language[a]
                held.append((np.asarray(batch.column("gram"))[a:b], np.asarray(batch.column("n"))[a:b]))
        if held:
            yield fitted()
        C.release()

    counted = count_grams(df)
    return C.stored(counted.repartition(C.tasks(df.sparkSession), "language").sortWithinPartitions("language").mapInArrow(run, MODEL), "models")


def models(table: DataFrame) -> Callable[[str], dict]:
    """A reader of single models for workers: files are opened there, and the last few models kept."""
    files, kept = [*table.inputFiles()], {}

    def read(language: str) -> dict:
        if language not in kept:
            while len(kept) >= HELD_MODELS:
                kept.pop(next(iter(kept)))
            system, _ = fs.FileSystem.from_uri(files[0])
            row = dataset.dataset([fs.FileSystem.from_uri(x)[1] for x in files], filesystem=system, format="parquet").to_table(filter=dataset.field("language") == language).to_pylist()[0]
            model: dict = {k: {} for k in range(1, ORDER + 1)}
            for column, name, k, kind in ARRAYS:
                model[k][name] = np.frombuffer(row[column], kind)
            kept[language] = model
        kept[language] = kept.pop(language)  # the last used is the last to go
        return kept[language]

    return read


SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, perplexity double"


def score(df: DataFrame, table: DataFrame, through: tuple[str, ...]) -> DataFrame:
    """The columns ``through``, the base figures of each text (text, language) and its log10 perplexity a symbol (null without symbols)."""
    read = models(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches):
            data, offs = C.buffers(batch.column("text"))
            f = figures(data, offs)
            got, per = grams(data, offs)
            language = batch.column("language").dictionary_encode()
            which = np.repeat(np.asarray(language.indices), per)
            log = np.zeros(len(got), np.float32)
            for m, name in enumerate(language.dictionary.to_pylist()):
                at = np.flatnonzero(which == m)
                if len(at):
                    log[at] = log_probability(read(name), got[at])
            sums = np.concatenate([[0.0], np.cumsum(log, dtype=np.float64)])
            ends = np.concatenate([[0], np.cumsum(per)])
            mean = -np.diff(sums[ends]) / np.maximum(per, 1)
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in through), *(pa.array(f[c], pa.int64()) for c in names), pa.array(mean, mask=per == 0)], [*through, *names, "perplexity"])

    return df.select(*dict.fromkeys([*through, "text", "language"])).mapInArrow(run, C.with_columns(df, through, SCORED))


def rules(df: DataFrame, through: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``through``, the five base figures, base_failed, log perplexity and its bands, kept."""
    # null is a language of its own, told apart from one without a name
    named = df.withColumn("language", F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang")))
    carried = (*through, "language")
    scored = C.stored(score(named, train(named), carried), "scored")
    # thousandths of a perplexity and their counts: the same quartiles whatever the order of rows
    bins = scored.where("perplexity is not null").groupBy("language", F.floor(F.col("perplexity") * 1000).alias("bin")).count()
    by = Window.partitionBy("language").orderBy("bin")
    upto = bins.withColumn("upto", F.sum("count").over(by)).withColumn("n", F.sum("count").over(Window.partitionBy("language")))
    at = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("bin"))) + 0.5) / 1000
    each = upto.groupBy("language").agg(at(0.25).alias("low"), at(0.75).alias("high"))
    low, high = F.col("low"), F.col("high")
    spread = F.greatest(high - low, F.lit(LEAST_SPREAD))
    sizes = scored.groupBy("language").agg(F.count("*").alias("c"))
    bands = sizes.join(each, "language", "left").select("language", "c", (low - LOWER * spread).alias("lower"), (high + UPPER * spread).alias("upper"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    within = F.coalesce(F.col("perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    joined = C.hot_join(scored, bands, ["language"], scored.count())
    return joined.select(*through, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & within).alias("kept"), "perplexity", "lower", "upper")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(C.table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
