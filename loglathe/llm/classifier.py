"""Quality classifier from weak labels.

Seven overlapping heuristic labellers vote good, bad or nothing on every
document.  Expectation-maximisation over the counts of vote patterns (3**7 at
most, whatever the corpus) estimates each labeller's accuracies without any
true label; a pattern's posterior is a document's soft label.  The soft labels
of a bounded sample (SAMPLE documents) train a linear scorer over hashed words
and word shapes, which then scores every document.

Defined results: null and empty texts have no features, get no votes but that
on length, and are rejected; very long texts are handled whole; equal texts get
equal scores; without any row the result has none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import quality

#: Documents at most that the scorer is trained on, slots of its weights, and its passes.
SAMPLE, SLOTS, PASSES = 20_000, 1 << 16, 8
FIGURES = 40  # slots of shares
#: A document is rejected below this probability of being good.
LEAST = 0.2
#: Words that a text's features are thinned by: the fewer words, the nearer a text's score is to the bias.
THIN = 12
#: Words from which labellers of shares vote bad.
ENOUGH = 20
GOOD, BAD, NONE = 2, 1, 0
LABELLERS = ("symbols", "repetition", "lines", "function words", "sentence ends", "word length", "length")

#: Frequent function words of four languages.
FUNCTION_WORDS = "the of and to in is that for on with as by at was are this from le la les de et en des un une que der die das und ist von mit zu auf el los las del por con una se al".split()


def _word_hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return np.unique(C.span_hash(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))


_FUNCTION = None
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[65:91] = 97
_SHAPE[48:58] = 48
_SHAPE[128:] = 97


def votes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, dict]:
    """One vote (GOOD, BAD, NONE) of each labeller on each text; a pattern's number has a vote as a digit of base 3."""
    global _FUNCTION
    if _FUNCTION is None:
        _FUNCTION = _word_hashes(FUNCTION_WORDS)
    f = quality.figures(data, offs)
    n = np.maximum(f["n_words"], 1)
    starts, ends, per = C.words(data, offs)
    lower = C.LOWER[data]
    h = C.span_hash(lower, starts, ends)
    owner = np.repeat(np.arange(len(per)), per)
    common = np.bincount(owner[np.isin(h, _FUNCTION)], minlength=len(per)) / n
    first, last, of = quality.lines(data, offs)
    ended = np.isin(data[last - 1 - (data[last - 1] == 10)], np.frombuffer(b".!?:;\"')", np.uint8)) if len(first) else np.zeros(0, bool)
    closing = np.bincount(of[ended], minlength=len(per)) / np.maximum(np.bincount(of, minlength=len(per)), 1)
    symbols, repeated, doubled = f["n_symbols"] / n, f["n_repeat_words"] / n, f["n_dup_lines"] / np.maximum(f["n_lines"], 1)
    mean = f["word_chars"] / n
    some, enough = f["n_words"] > 0, f["n_words"] >= ENOUGH

    def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(some & good, GOOD, np.where(some & bad, BAD, NONE))

    all_votes = np.stack(
        [
            vote(symbols < 0.03, symbols > 0.1),
            vote(repeated < 0.15, repeated > 0.4),
            vote((doubled < 0.1) & (f["n_lines"] > 1), doubled > 0.3),
            vote(common > 0.08, (common < 0.02) & enough),
            vote(closing > 0.6, (closing < 0.2) & enough),
            vote((mean > 3) & (mean < 9), ((mean < 2.5) | (mean > 12)) & enough),
            np.where(f["n_words"] >= 30, GOOD, np.where(some, NONE, BAD)),
        ],
        1,
    )
    return all_votes, {"starts": starts, "ends": ends, "per": per, "lower": lower, "hash": h, "figures": f}


def features(data: np.ndarray, offs: np.ndarray, parts: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot and value of each hashed feature (words, word shapes, shares of repeated ones; values of a kind sum to n / (n + THIN) in a text of n words), and features per text."""
    starts, ends, per = parts["starts"], parts["ends"], parts["per"]
    shape = _SHAPE[data]
    same = np.zeros(len(data), bool)
    same[1:] = (shape[1:] == shape[:-1]) & (shape[1:] == 97)  # a run of letters has one shape
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    kept = np.flatnonzero(~same | edge[:-1])
    place = np.searchsorted(kept, starts), np.searchsorted(kept, ends)
    shapes = C.span_hash(shape[kept], *place)
    owner = np.repeat(np.arange(len(per)), per)
    half = np.uint64(SLOTS // 2)
    slots = np.concatenate([parts["hash"] % (half - np.uint64(FIGURES)) + np.uint64(FIGURES), shapes % half + half])
    keys = np.concatenate([owner, owner]).astype(np.uint64) * np.uint64(SLOTS) + slots
    keys, counts = np.unique(keys, return_counts=True)
    text = (keys // np.uint64(SLOTS)).astype(np.int64)
    values = counts / (per + THIN)[text]
    # ten buckets of each of four shares: distinct words, repeated windows, symbols, equal lines
    f, n = parts["figures"], np.maximum(per, 1)
    pairs = np.unique(owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ parts["hash"], return_index=True)[1]
    distinct = np.bincount(owner[pairs], minlength=len(per)) / n
    shares = np.stack([distinct, f["n_repeat_words"] / n, f["n_symbols"] / n, f["n_dup_lines"] / np.maximum(f["n_lines"], 1)], 1)
    bucket = np.minimum((shares * 10).astype(np.int64), 9) + 10 * np.arange(4)
    some = np.flatnonzero(per)
    keys = np.concatenate([keys, (some.astype(np.uint64)[:, None] * np.uint64(SLOTS) + bucket[some].astype(np.uint64)).reshape(-1)])
    values = np.concatenate([values, np.repeat(0.25 * per[some] / (per[some] + THIN), 4)])
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    text = (keys // np.uint64(SLOTS)).astype(np.int64)
    return (keys % np.uint64(SLOTS)).astype(np.int32), values.astype(np.float32), np.bincount(text, minlength=len(per))


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.8, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM: each labeller's chances of its votes (none, bad, good) given bad and good [labeller, class, vote], each pattern's posterior of good, the prior."""
    k = len(LABELLERS)
    digit = (patterns[:, None] // 3 ** np.arange(k)) % 3
    rates = np.tile(np.array([[0.2, 0.6, 0.2], [0.2, 0.1, 0.7]]), (k, 1, 1))
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        log = [np.log((1 - prior, prior)[y]) + np.log(rates[np.arange(k), y, digit]).sum(1) for y in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        if done:
            break
        prior = float(np.clip((post @ counts) / max(1, counts.sum()), 0.05, 0.95))
        for y, weight in ((0, counts * (1 - post)), (1, counts * post)):
            for v in range(3):
                rates[:, y, v] = weight @ (digit == v) + 1
        rates /= rates.sum(2, keepdims=True)
    return rates, post, prior


def fit_scorer(slots: np.ndarray, values: np.ndarray, per: np.ndarray, soft: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by adaptive gradient steps over blocks of documents."""
    w, bias = np.zeros(SLOTS), 0.0
    seen, seen_bias = np.full(SLOTS, 1e-3), 1e-3
    ends = np.concatenate([[0], np.cumsum(per)])
    block = 200
    for _ in range(PASSES):
        for at in range(0, len(per), block):
            to = min(at + block, len(per))
            a, b = ends[at], ends[to]
            s, v = slots[a:b], values[a:b].astype(np.float64)
            own = np.repeat(np.arange(to - at), per[at:to])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(own, w[s] * v, to - at) + bias, -30, 30)))
            error = p - soft[at:to]
            g = np.bincount(s, error[own] * v, SLOTS) / block
            seen += g * g
            w -= 1.0 * g / np.sqrt(seen) * (g != 0)
            seen_bias += error.mean() ** 2
            bias -= 0.3 * error.mean() / np.sqrt(seen_bias)
    return w, float(bias)


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """All numbers of a binary column, without copies of its cells."""
    array = column.combine_chunks().cast(pa.large_binary())
    if not len(array):
        return np.zeros(0, kind)
    _, offs, data = array.buffers()
    offs = np.frombuffer(offs, np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(kind) if offs[-1] > offs[0] else np.zeros(0, kind)


def label(df: DataFrame) -> DataFrame:
    """doc_id, pattern: every document's votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches):
            v, _ = votes(*C.buffers(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(v @ 3 ** np.arange(len(LABELLERS)), pa.int32())], ["doc_id", "pattern"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, pattern int")


def classify(df: DataFrame, least: float = LEAST, through: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``through``, and pattern, label (its posterior of good), score (the scorer's probability of good), kept."""
    spark = df.sparkSession
    labelled = C.stored(label(df), "votes")
    found = labelled.groupBy("pattern").count().toArrow()  # 3**7 rows at most
    patterns, counts = np.asarray(found.column("pattern").combine_chunks(), np.int64), np.asarray(found.column("count").combine_chunks(), np.float64)
    order = np.argsort(patterns)
    patterns, counts = patterns[order], counts[order]
    _, post, _ = fit_labellers(patterns, counts)
    soft = {int(p): float(q) for p, q in zip(patterns, post)}
    n = int(counts.sum())

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches):
            data, offs = C.buffers(batch.column("text"))
            v, parts = votes(data, offs)
            slots, values, per = features(data, offs, parts)
            ends = np.concatenate([[0], np.cumsum(per)])
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(v @ 3 ** np.arange(len(LABELLERS)), pa.int32()), cut(slots), cut(values)], ["place", "pattern", "slots", "values"])

    # the rows of the smallest hashes, copies and rows without identifiers each for itself: 9 / 10 of SAMPLE on average, the rest for chance
    share = int(min(1.0, 0.9 * SAMPLE / max(n, 1)) * (1 << 30))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.coalesce("doc_id", F.lit(0)), F.lit(11)), F.lit(1 << 30))
    picked = df.select(place.alias("place"), "text").where(F.col("place") < share).mapInArrow(sample, "place long, pattern int, slots binary, values binary").orderBy("place", "pattern", "slots", "values").limit(SAMPLE).toArrow()
    per = np.asarray(pc.binary_length(picked.column("slots").combine_chunks()), np.int64) // 4
    mixed = np.random.RandomState(5).permutation(len(per))
    slots, values = _joined(picked.column("slots"), np.int32), _joined(picked.column("values"), np.float32)
    begins = np.cumsum(per) - per
    goal = np.array([soft[p] for p in picked.column("pattern").to_pylist()])
    w, bias = fit_scorer(C.gather_spans(slots, begins[mixed], per[mixed]), C.gather_spans(values, begins[mixed], per[mixed]), per[mixed], goal[mixed])
    trained = len(per) > 0
    del picked, slots, values
    C.release()
    model = spark.sparkContext.broadcast((w, bias, soft, trained))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias, soft, trained = model.value
        for batch in C.chunks(batches):
            data, offs = C.buffers(batch.column("text"))
            v, parts = votes(data, offs)
            slots, values, per = features(data, offs, parts)
            own = np.repeat(np.arange(len(per)), per)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(own, w[slots] * values, len(per)) + bias, -30, 30)))
            pattern = v @ 3 ** np.arange(len(LABELLERS))
            mine = np.array([soft[x] for x in pattern.tolist()])
            p = p if trained else mine  # copies of few texts can all stay outside of the sample
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in through), pa.array(pattern, pa.int32()), pa.array(mine), pa.array(p), pa.array((p >= least) & (parts["per"] > 0))], [*through, "pattern", "label", "score", "kept"])

    return df.select(*dict.fromkeys([*through, "text"])).mapInArrow(run, C.with_columns(df, through, "pattern int, label double, score double, kept boolean"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(C.table(spark, sf_dir, "documents", "doc_id", "text"))
