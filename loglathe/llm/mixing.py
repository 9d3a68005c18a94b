"""Language-model scoring by online logistic context mixing.

A text is its words, A-Z lower-cased, and one end.  Each token is a walk down
a Huffman tree over the most frequent training tokens; other words escape and
are spelt, byte by byte and closed by a space, down a second tree.  Every step
down is a bit, which several predictors foretell:

* the step's own share among all training tokens, and its share after the last
  very frequent word;
* the hashed context of the two words before (ORDERS): the token that followed
  most often in the training documents gives its walk, as far as it agrees;
* the same context's last occurrence in the text itself;
* in spelling, hashed contexts of one to five bytes before.

Each gives a logit: a context's from how often it was right in its state (counts
of its token and of others, hits in a row, depth of the step).  The logits are
added under weights that a gate picks by the kind of bit and by the predictors
that still agree.  Weights are updated online within each document, TURN bits
after TURN bits, starting from weights trained on all training documents: each
half of them with the markers' shares of the other half.

The contexts of words and what follows them are counted over all training
documents: their number grows with the corpus.  Blocks of documents send their
distinct contexts and pairs to buckets by hash, a bucket sums them up and
answers with each context's two most frequent tokens and counts, and a block
takes its own document's counts out again, so that no training document is
foretold by itself.  A context of frequent words is split by what follows it
into as many parts as its words' counts call for, so that every bucket holds
about SPLIT tokens, however often a context occurs.

The TOP most frequent tokens are broadcast; the counts of rarer ones are joined.

Defined results: null and empty texts are their end alone; a null doc_id is not
held out; very long texts are scored whole; equal texts get equal scores (but
for the held out among them); without training documents every count is 0 and
the score is that of the untrained model; tables without rows give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Tokens whose counts are broadcast, and tokens of the tree; the most frequent tokens that mark what kind of text it is.
TOP, VOCABULARY, MARKERS = 1 << 18, 1 << 18, 32
FOLDS, HELD_OUT, SECOND = 7, 2, 4  # folds of the second half begin there
#: Tokens of a block of documents, of a bucket of contexts, and of the pieces of a block that are mixed at once.
BLOCK_TOKENS, SPLIT, PIECE = 1 << 19, 1 << 20, 1 << 16
#: Words before, of the contexts.
ORDERS = (2,)
#: Bits of the spelling contexts' tables, by bytes before (the first with the marker).
SPELLING, SPELLING_BITS = (1, 2, 3, 5), (18, 18, 20, 20)
SPELLING_BASES = [sum(1 << b for b in SPELLING_BITS[:k]) for k in range(len(SPELLING) + 1)]
ROW = 1 << 13  # slots of a row of the shuffled spelling tables
STATES, DEPTHS, PREDICTORS = 64, 8, len(ORDERS) + 1  # predictors: each order's contexts, and the text itself
GATES = 16
#: Bits after which a text's weights move.
TURN = 512
#: Smoothing of the counts; what backs the markers' shares; strength of the initial weights against updates, and the updates' rate.
SMOOTH, BACKING, HOLD, RATE = 0.3, 4.0, 60.0, 0.25
#: Curvature that a bit adds, on average, for a weight.
CURVE = 0.35
LARGEST = 10.0
UNIT = np.float32(LARGEST / 32767)  # of logits in tables of 16 bits
END = np.uint64(0x1F83D9ABFB41BD6B)
#: Tokens as 32 bits: the escape, the end, and before a text; known ones follow, others are hashes with the highest bit set.
ESCAPE, STOP, BEGIN = 0, 1, (1 << 30)
UNKNOWN = np.uint32(1 << 31)
CODE_BITS = 52  # the longest walk
INDEXED = np.uint64(44)  # bits of a hash below those that the top tokens are found by
DEEP_BITS = 20  # bits of a step below its depth's class
#: Classes of depths: steps 0, 1, 2, 3 by themselves, then to 5, 8, 12 and beyond.
DEEP = np.array([0, 1, 2, 3, 4, 4, 5, 5, 5, 6, 6, 6, 6] + [7] * 51, np.uint8)


# ---------------------------------------------------------------------- storage
def shut(values: np.ndarray) -> bytes:
    """An array by planes of bytes, compressed."""
    a = np.ascontiguousarray(values)
    each = a.view(np.uint8).reshape(-1, a.itemsize)
    planes = np.empty(each.shape[::-1], np.uint8)
    for k, plane in enumerate(planes):  # faster than the transposed array's bytes
        plane[:] = each[:, k]
    return zstandard.ZstdCompressor(level=1).compress(planes)


def fixed(logits: np.ndarray) -> np.ndarray:
    """Logits as 16 bits, in UNITs."""
    return np.rint(np.clip(logits, -LARGEST, LARGEST) / UNIT).astype(np.int16)


def opened(raw: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).reshape(-1)


# ----------------------------------------------------------------------- tokens
def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; hash, start and end of each token (the text's end: empty, after its words), and tokens per text."""
    lower = C.LOWER[data]
    starts, ends, per = C.words(data, offs)
    at = np.cumsum(per)
    h = np.insert(C.span_hash(lower, starts, ends), at, END)
    return lower, h, np.insert(starts, at, 0), np.insert(ends, at, 0), per + 1


def count_tokens(df: DataFrame) -> DataFrame:
    """kind (0: token, 1: byte of words), key, c over all given texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        letters = np.zeros(256, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, index = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(index, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(C.signed(keys.astype(np.uint64))), pa.array(n)], ["kind", "key", "c"])

        for batch in C.chunks(batches):
            lower, h, *_ = tokens(*C.buffers(batch.column("text")))
            letters += np.bincount(lower, minlength=256)
            held.append(np.unique(h, return_counts=True))
            if len(held) > 23:
                held = [merged()]
                if len(held[0][0]) > 2_000_000:
                    yield rows(0, *held.pop())
        if held:
            yield rows(0, *merged())
        yield rows(1, np.arange(256), letters)

    return df.select("text").mapInArrow(run, "kind int, key long, c long").groupBy("kind", "key").agg(F.sum("c").alias("c"))


def tree(weights: np.ndarray) -> dict[str, np.ndarray]:
    """Huffman codes: start and length of each symbol's steps, all steps (twice the inner node, and the bit), each symbol's code from the highest of 64 bits on; the symbols from left to right, and the range of them that is left and right of each node."""
    w = np.asarray(weights, float)
    w = np.maximum(1, np.floor(w * min(1.0, 2.0**30 / max(w.sum(), 1.0))))
    n = len(w)
    order = np.argsort(w, kind="stable")
    leaves, sums = w[order].tolist(), []
    above, bit = np.full(2 * n, -1, np.int64), np.zeros(2 * n, np.uint8)
    i = j = 0
    for node in range(n - 1):  # the two lightest of the leaves and nodes that are left
        pair, total = [], 0.0
        for _ in (0, 1):
            if j >= len(sums) or i < n and leaves[i] <= sums[j]:
                pair.append(int(order[i]))
                total += leaves[i]
                i += 1
            else:
                pair.append(n + j)
                total += sums[j]
                j += 1
        above[pair] = n + node
        bit[pair[1]] = 1
        sums.append(total)
    # all walks at once, from the leaves up
    at, up, length = np.arange(n), [], np.zeros(n, np.int64)
    while (above[at] >= 0).any():
        moving = above[at] >= 0
        up.append(np.where(moving, 2 * (above[at] - n) + bit[at], -1))
        length += moving
        at = np.where(moving, above[at], at)
    starts = np.cumsum(length) - length
    steps, codes = np.zeros(int(length.sum()), np.int32), np.zeros(n, np.uint64)
    for k, step in enumerate(up):
        some = np.flatnonzero(step >= 0)
        depth = length[some] - 1 - k
        steps[starts[some] + depth] = step[some]
        codes[some] |= (step[some] & 1).astype(np.uint64) << (np.uint64(63) - depth.astype(np.uint64))
    if n > 1 and length.max() > CODE_BITS:
        raise AssertionError("a walk is too long")
    left_to_right = np.argsort(codes)
    place = np.empty(n, np.int64)
    place[left_to_right] = np.arange(n)
    low, middle, high = np.full(max(n - 1, 1), n), np.full(max(n - 1, 1), n), np.zeros(max(n - 1, 1), np.int64)
    owner = np.repeat(place, length)
    np.minimum.at(low, steps >> 1, owner)
    np.maximum.at(high, steps >> 1, owner + 1)
    right = (steps & 1) == 1
    np.minimum.at(middle, steps[right] >> 1, owner[right])
    return {"first": starts, "length": length, "steps": steps, "codes": codes, "order": left_to_right, "low": low, "middle": middle, "high": high}


def shares(t: dict[str, np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the symbols under the zero, and under the one, of each node."""
    sums = np.concatenate([[0.0], np.cumsum(weights[t["order"]])])
    return sums[t["middle"]] - sums[t["low"]], sums[t["high"]] - sums[t["middle"]]


def lexicon(keys: np.ndarray, counts: np.ndarray, total: int, letters: np.ndarray) -> dict:
    """Sorted hashes of the top tokens with counts and symbols; both trees (in the words' steps, above DEEP_BITS, the class of the depth); each symbol's weight, each node's logit, and the logit of the bit that comes for each step."""
    order = np.lexsort((keys, -counts))
    keys, counts = keys[order], counts[order]
    symbol = np.zeros(len(keys), np.int64)
    inner = np.flatnonzero((keys != END) & (counts > 1))[: VOCABULARY - 2]
    symbol[inner] = 2 + np.arange(len(inner))
    symbol[keys == END] = STOP
    ends = int(counts[keys == END].sum())
    rare = total - int(counts[inner].sum()) - ends
    by = np.argsort(keys)
    spelt = letters.astype(np.int64) + 1
    spelt[C.SPACES] = 1
    spelt[0x20] = 1 + int(letters.sum()) // 6
    weights = np.array([max(rare, 1), max(ends, 1), *counts[inner].tolist()], float)
    words = tree(weights)
    zero, one = shares(words, weights)
    logit = np.log((one + 0.01) / (zero + 0.01)).astype(np.float32)
    words["steps"] |= DEEP[np.minimum(C.ragged(words["length"]), 63)].astype(np.int32) << DEEP_BITS
    index = np.searchsorted(keys[by] >> INDEXED, np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)
    return {
        "keys": keys[by], "index": index, "counts": counts[by], "symbol": symbol[by], "words": words, "bytes": tree(spelt), "weights": weights, "ends": ends,
        "logit": logit, "signed": np.stack([-logit, logit], 1).reshape(-1),
    }


def look_up(lex: dict, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether found, place) of each token among the top ones."""
    if not len(lex["keys"]):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    # the first key that is not smaller: from the first one with the same upper bits on
    keys, last = lex["keys"], len(lex["keys"]) - 1
    at = np.minimum(lex["index"].take((h >> INDEXED).astype(np.int64)).astype(np.int64), last)
    key = keys.take(at)
    less = np.flatnonzero((key < h) & (at < last))
    while len(less):
        at[less] += 1
        key[less] = keys.take(at[less])
        less = less[(key[less] < h[less]) & (at[less] < last)]
    return key == h, at


# ----------------------------------------------------------------------- blocks
PARTS = ("folds", "per", "sizes", "known", "base", "tok", "rare", "rare_per", "odd_text", "odd_size")


def read_block(file: str, *columns: str) -> dict:
    """Columns of a block's file."""
    system, path = fs.FileSystem.from_uri(file)
    table = pq.read_table(path, columns=list(columns), filesystem=system)
    return {c: table.column(c)[0].as_py() for c in columns}


def blocks(docs: DataFrame, lex, floor: int, folder: str) -> DataFrame:
    """block, file: some documents with their identifiers, their tokens as numbers, their base scores, hashes of tokens that are not among the top ones, and the bytes of words to spell, in a file of their own in ``folder``.

    Files have names of their own for each attempt of a task; only those that a
    finished task reports are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, held, size = lex.value, TaskContext.get().partitionId() << 32, [], 0
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)

        def block() -> pa.RecordBatch:
            nonlocal number
            ids = pa.chunked_array([x[0] for x in held]).combine_chunks()
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            rest = [pa.array([shut(np.concatenate([x[1 + k] for x in held]))], pa.large_binary()) for k in range(len(PARTS))]
            name = uuid.uuid4().hex
            pq.write_table(pa.table([lists, *rest], ["ids", *PARTS]), f"{path}/{name}", filesystem=system, compression="none", use_dictionary=False, write_statistics=False)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1]), pa.array([f"{folder}/{name}"])], ["block", "file"])

        for batch in C.chunks(batches):
            data, offs = C.buffers(batch.column("text"))
            lower, h, starts, ends, per = tokens(data, offs)
            n = len(per)
            doc = np.repeat(np.arange(n), per)
            found, at = look_up(own, h)
            if len(own["keys"]):
                count, symbol = np.where(found, own["counts"][at], 0), np.where(found, own["symbol"][at], np.where(h == END, STOP, ESCAPE))
            else:
                count, symbol = np.zeros(len(h), np.int64), np.where(h == END, STOP, ESCAPE)
            base = np.bincount(doc[found], np.log10((count[found] + 1) / floor), n).astype(float)
            tok = np.where(symbol == ESCAPE, (h >> np.uint64(33)).astype(np.uint32) | UNKNOWN, symbol.astype(np.uint32))
            odd = np.flatnonzero(symbol == ESCAPE)
            length = ends[odd] - starts[odd]
            rare = np.flatnonzero(~found)
            held.append((
                batch.column("doc_id"), np.asarray(batch.column("fold")), per.astype(np.int64), np.diff(offs), np.bincount(doc[found], minlength=n), base, tok,
                h[rare], np.bincount(doc[rare], minlength=n), C.gather_spans(lower, starts[odd], length), length,
            ))
            size += len(tok)
            if size >= BLOCK_TOKENS:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    return docs.select("doc_id", "fold", "text").mapInArrow(run, "block long, file string")


def markers(tok: np.ndarray, per: np.ndarray) -> np.ndarray:
    """The last of the most frequent tokens before each token of a text (0: none), which tells languages and kinds of text apart."""
    begin = np.repeat(np.cumsum(per) - per, per)
    place = np.maximum.accumulate(np.where((tok > STOP) & (tok < 2 + MARKERS), np.arange(len(tok)), -1))
    place = np.concatenate([[-1], place[:-1]]) if len(tok) else place
    return np.where(place >= begin, tok[np.maximum(place, 0)].astype(np.int64) - STOP, 0)


#: Whose shares the markers' tables hold.
SHARES = ("every", "first", "second")


def count_markers(made: DataFrame) -> DataFrame:
    """marker, symbol, first, second: counts over the two halves of the training documents of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, index = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(index, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        for batch in batches:
            for file in batch.column("file").to_pylist():
                row = read_block(file, "per", "folds", "tok")
                per, folds, tok = opened(row["per"], np.int64), opened(row["folds"], np.int64), opened(row["tok"], np.uint32)
                fold = np.repeat(folds, per)
                keep = fold != HELD_OUT
                symbol = np.where(tok < UNKNOWN, tok, ESCAPE).astype(np.int64)
                keys = (fold >= SECOND).astype(np.int64) << 40 | markers(tok, per) << 20 | symbol
                held.append(np.unique(keys[keep], return_counts=True))
                if len(held) > 3:
                    held = [merged()]
        if held:
            keys, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array((keys >> 40).astype(np.int32)), pa.array((keys >> 20 & 0xFFFFF).astype(np.int32)), pa.array((keys & 0xFFFFF).astype(np.int32)), pa.array(n)], ["half", "marker", "symbol", "n"])

    counted = made.select("file").mapInArrow(run, "half int, marker int, symbol int, n long")
    half = lambda k, name: F.sum(F.when(F.col("half") == k, F.col("n")).otherwise(0)).alias(name)
    return counted.groupBy("marker", "symbol").agg(half(0, "first"), half(1, "second"))


def marker_logits(counted: DataFrame, lex) -> list[np.ndarray]:
    """For each marker and node the logit of a one, backed by the node's own share: of all training documents, of the first half, and of the second; a marker is a task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lex.value
        p = 1 / (1 + np.exp(-own["logit"].astype(float)))
        sums: dict[int, np.ndarray] = {}  # as long as the tree's tokens, for each marker
        for batch in batches:
            marker, symbol, *halves = (np.asarray(batch.column(c), np.int64) for c in ("marker", "symbol", "first", "second"))
            for m in np.unique(marker).tolist():
                at = marker == m
                both = sums.setdefault(m, np.zeros((2, len(own["weights"]))))
                for k, count in enumerate(halves):
                    both[k] += np.bincount(symbol[at], count[at], len(own["weights"]))
        for m, both in sums.items():
            out = []
            for w in (both.sum(0), *both):
                zero, one = shares(own["words"], w)
                out.append(fixed(np.log((one + BACKING * p + 1e-4) / (zero + BACKING * (1 - p) + 1e-4))))
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), *(pa.array([shut(x)], pa.binary()) for x in out)], ["marker", *SHARES])

    nodes = len(lex.value["logit"])
    out = np.tile(fixed(lex.value["logit"]), (len(SHARES), MARKERS + 1, 1))
    each = counted.repartition(MARKERS + 1, "marker").mapInArrow(run, f"marker int, {', '.join(f'{c} binary' for c in SHARES)}")
    for row in each.toArrow().to_pylist():  # a row of a fixed size for each marker
        for k, c in enumerate(SHARES):
            out[k, row["marker"]] = opened(row[c], np.int16)
    return [x.reshape(-1, nodes) for x in out]


# --------------------------------------------------------------------- spelling
def spelt(lex: dict, tok: np.ndarray, per: np.ndarray, text: np.ndarray, size: np.ndarray, keep: np.ndarray, mark: np.ndarray) -> dict[str, np.ndarray]:
    """The bits of the words that escape (of those only at the places ``keep``; ``mark``: each token's marker): slots of the contexts, bit, byte of the word (3: any later one); and each word's text and bits."""
    doc = np.repeat(np.arange(len(per)), per)
    odd = np.flatnonzero(tok >= UNKNOWN)
    text = C.gather_spans(text, (np.cumsum(size) - size)[keep], size[keep])
    odd, size = odd[keep], size[keep]
    mark = mark[odd]
    text = np.insert(text, np.cumsum(size), 0x20).astype(np.int64)
    size = size + 1
    place = C.ragged(size)
    past = []
    for k in range(1, max(SPELLING) + 1):
        x = np.zeros(len(text), np.uint64)
        x[k:] = text[:-k] if k <= len(text) else 0
        x[place < k] = 0
        past.append(x << np.uint64(8 * (k - 1)))
    t = lex["bytes"]
    n = t["length"][text]
    at = np.repeat((t["first"][text] - np.cumsum(n) + n).astype(np.int32), n)
    at += np.arange(len(at), dtype=np.int32)
    step = t["steps"].take(at)
    salt, bit = (step >> 1).astype(np.uint32) * np.uint32(0x9E3779B1), (step & 1).astype(np.uint8)
    slots = np.empty((len(SPELLING), len(step)), np.int32)
    for k, order in enumerate(SPELLING):
        context = np.bitwise_or.reduce(past[:order])
        if k == 0:
            context = context | np.repeat(mark, size).astype(np.uint64) << np.uint64(32)
        with np.errstate(over="ignore"):
            x = np.repeat((C.mix(context + np.uint64(11 + k) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32), n)
            x ^= salt
            x *= np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0xC2B2AE35)
        x >>= np.uint32(32 - SPELLING_BITS[k])
        np.add(x, np.uint32(SPELLING_BASES[k]), out=slots[k].view(np.uint32))
    long = np.add.reduceat(n, np.cumsum(size) - size) if len(size) else n  # bits of each word
    return {"slots": slots, "bit": bit, "doc": doc[odd], "long": long, "place": np.repeat(np.minimum(place, 3).astype(np.uint8), n)}


def count_spelling(made: DataFrame, lex) -> DataFrame:
    """row of slots, counts: for each slot zeros and ones, over the words that escape in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SPELLING_BASES[-1], np.int64)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                row = read_block(file, "per", "folds", "tok", "odd_text", "odd_size")
                per, folds, tok = opened(row["per"], np.int64), opened(row["folds"], np.int64), opened(row["tok"], np.uint32)
                training = np.repeat(folds != HELD_OUT, per)[tok >= UNKNOWN]
                s = spelt(lex.value, tok, per, opened(row["odd_text"], np.uint8), opened(row["odd_size"], np.int64), np.flatnonzero(training), markers(tok, per))
                for k in range(len(SPELLING)):
                    a, b = 2 * SPELLING_BASES[k], 2 * SPELLING_BASES[k + 1]
                    total[a:b] += np.bincount(2 * s["slots"][k] + s["bit"] - a, minlength=b - a)
        for row, counts in enumerate(total.reshape(-1, 2 * ROW)):
            if counts.any():
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([shut(counts)], pa.binary())], ["row", "counts"])
        C.release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, raw in zip(*(batch.column(c).to_pylist() for c in ("row", "counts"))):
                sums[row] = sums.get(row, 0) + opened(raw, np.int64)
        for row, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([shut(counts)], pa.binary())], ["row", "counts"])

    kinds = "row int, counts binary"
    few = made.select("file").mapInArrow(run, kinds)
    return few.repartition(C.tasks(made.sparkSession), "row").mapInArrow(add, kinds)


def spelling_table(made: DataFrame, lex) -> np.ndarray:
    """Zeros and ones of every slot: of a fixed size, on the driver."""
    out = np.zeros((SPELLING_BASES[-1], 2), np.float32)
    for batch in C.stored(count_spelling(made, lex), "spelling").toArrow().to_batches():
        for row, raw in zip(*(batch.column(c).to_pylist() for c in ("row", "counts"))):
            out[ROW * row : ROW * (row + 1)] = opened(raw, np.int64).reshape(-1, 2)
    return out


# --------------------------------------------------------------------- contexts
def contexts(lex: dict, tok: np.ndarray, per: np.ndarray, n_buckets: int) -> dict[str, np.ndarray]:
    """The distinct contexts of a block: each token's context of each order, the parts of each context, and the sorted keys (bucket and hash) of all parts."""
    n = len(tok)
    begin = np.repeat(np.cumsum(per) - per, per)
    weight = lex["weights"]
    before, bound, key = [], np.full(n, np.iinfo(np.int64).max), []
    h = np.zeros(n, np.uint64)
    bounds = []
    for k in range(1, max(ORDERS) + 1):
        past = np.full(n, BEGIN, np.uint32)
        past[k:] = tok[:-k] if k <= n else 0
        past[np.arange(n) - k < begin] = BEGIN
        before.append(past)
        known = np.where(past < len(weight), past, 0)
        often = np.where(past < len(weight), weight[known], np.where(past == BEGIN, lex["ends"], 1))
        bound = np.minimum(bound, often.astype(np.int64))
        with np.errstate(over="ignore"):
            h = C.mix(h * np.uint64(C._BASE) + past.astype(np.uint64) + np.uint64(k))
        if k in ORDERS:
            key.append(h)
            bounds.append(bound.copy())
    distinct, inverse = numbers(np.concatenate(key))
    bound = np.zeros(len(distinct), np.int64)
    bound[inverse] = np.concatenate(bounds)
    parts = np.maximum(1, -(-bound // SPLIT))
    first = np.cumsum(parts) - parts
    with np.errstate(over="ignore"):
        k = C.mix(np.repeat(distinct, parts) + C.ragged(parts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    key = bucket_key(k, n_buckets)
    asks, ask = numbers(key)
    return {"of": inverse.reshape(len(ORDERS), n), "parts": parts, "first": first, "asks": asks, "ask": ask}


def numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's number among them."""
    low = np.uint64((1 << 20) - 1)
    # places in the lowest bits, so that values need not be sorted with them; where only those bits tell values apart, they are
    spare = 64 - max(1, int(values.max(initial=np.uint64(0))).bit_length())
    key = values << np.uint64(spare) & ~low
    key |= np.arange(len(values), dtype=np.uint64) & low
    key.sort()
    order = (key & low).astype(np.int64)
    ordered = values[order]
    if len(values) > int(low) or (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(values)
        ordered = values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return ordered[fresh], number


def bucket_key(k: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket in the upper 32 bits, another 32 bits of the hash below."""
    return ((k & np.uint64(0xFFFFFFFF)) * np.uint64(n_buckets) >> np.uint64(32)) << np.uint64(32) | k >> np.uint64(32)


def part_of(found: dict, of: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """The part of a context that a following token belongs to, as a place among the parts."""
    parts = found["parts"][of]
    out = found["first"][of].copy()
    split = np.flatnonzero(parts > 1)
    if len(split):
        out[split] += (C.mix(follows[split].astype(np.uint64)) % parts[split].astype(np.uint64)).astype(np.int64)
    return out


ENTRY = "bucket int, block long, n int, raw binary"


def entries(made: DataFrame, lex, n_buckets: int) -> DataFrame:
    """ENTRY: for each block and bucket the contexts asked for, and how often which token followed them in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, file in zip(*(batch.column(c).to_pylist() for c in ("block", "file"))):
                row = read_block(file, "per", "folds", "tok")
                per, tok = opened(row["per"], np.int64), opened(row["tok"], np.uint32)
                training = np.repeat(opened(row["folds"], np.int64) != HELD_OUT, per)
                found = contexts(lex.value, tok, per, n_buckets)
                asks, follows = found["asks"], np.tile(tok, len(ORDERS))
                of, teach = found["of"].reshape(-1), np.tile(training, len(ORDERS))
                other = np.zeros(len(asks), bool)  # asked for by held-out documents
                mine = found["first"][of[~teach]], found["parts"][of[~teach]]
                other[found["ask"][np.repeat(mine[0], mine[1]) + C.ragged(mine[1])]] = True
                of, follows = of[teach], follows[teach]
                pair, count = np.unique(of.astype(np.uint64) << np.uint64(32) | follows.astype(np.uint64), return_counts=True)
                of, follows = (pair >> np.uint64(32)).astype(np.int64), pair.astype(np.uint32)
                ask = found["ask"][part_of(found, of, follows)]
                order = np.sort(ask.astype(np.uint64) << np.uint64(32) | np.arange(len(ask), dtype=np.uint64)).astype(np.uint32)
                ask, follows, count = ask[order], follows[order], count[order]
                times = np.bincount(ask, minlength=len(asks))
                head = (2 * times + other).astype(np.uint32)
                edges = np.searchsorted(asks >> np.uint64(32), np.arange(n_buckets + 1))
                ends = np.concatenate([[0], np.cumsum(times)])[edges]
                low = asks.astype(np.uint32)
                rows = []
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    a, z, x, y = edges[b], edges[b + 1], ends[b], ends[b + 1]
                    raw = np.concatenate([np.diff(low[a:z], prepend=np.uint32(0)), head[a:z], follows[x:y], count[x:y].astype(np.uint32)])
                    rows.append((b, block, int(z - a), shut(raw)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["bucket", "block", "n", "raw"])
        C.release()

    return made.select("block", "file").mapInArrow(run, ENTRY)


def answers(asked: DataFrame) -> DataFrame:
    """ENTRY again: for each block and bucket places of contexts, how often they occur, and their two most frequent tokens with counts."""

    def solve(rows: list[tuple]) -> list[tuple]:
        asks, heads, follows, counts = [], [], [], []
        for _, _, n, raw in rows:
            x = opened(raw, np.uint32)
            asks.append(np.cumsum(x[:n], dtype=np.uint32))
            heads.append(x[n : 2 * n])
            m = (len(x) - 2 * n) // 2
            follows.append(x[2 * n : 2 * n + m])
            counts.append(x[2 * n + m :])
        key = np.repeat(np.concatenate(asks), np.concatenate(heads) >> 1).astype(np.uint64) << np.uint64(32) | np.concatenate(follows).astype(np.uint64)
        order = np.argsort(key)
        key, count = key[order], np.concatenate(counts)[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        key, count = key[first], np.add.reduceat(count, first) if len(first) else count
        ids = (key >> np.uint64(32)).astype(np.uint32)
        begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
        total = np.add.reduceat(count, begin) if len(begin) else count
        table = np.zeros((5, len(begin)), np.int64)
        table[0] = total
        place, size = np.arange(len(ids)), np.diff(np.append(begin, len(ids)))
        for row in (1, 3) if len(begin) else ():  # the most frequent token, the smallest of several; then the next
            most = np.maximum.reduceat(count, begin)
            at = np.minimum.reduceat(np.where(count == np.repeat(most, size), place, len(ids)), begin)
            table[row], table[row + 1] = most, np.where(most > 0, key.astype(np.uint32)[at], 0)
            count[at] = 0
        ids = ids[begin]
        out = []
        for (bucket, block, _, _), own, head in zip(rows, asks, heads):
            if not len(ids):
                break
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            # a context that occurs once, in the asking document, tells it nothing
            use = np.flatnonzero((ids[at] == own) & ~((table[0, at] == 1) & (head == 2)))
            if len(use):
                out.append((bucket, block, len(use), shut(np.concatenate([np.diff(use, prepend=0), table[:, at[use]].reshape(-1)]).astype(np.int64))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            done = solve(rows) if rows else []
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["bucket", "block", "n", "raw"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "n", "raw"))):
                if row[0] != last:
                    yield from flush()
                    last, rows = row[0], []
                rows.append(row)
        yield from flush()
        C.release()

    return asked.mapInArrow(run, ENTRY)


# ------------------------------------------------------------------- predictions
def agreed(lex: dict, tok: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many steps the walks of two tokens share."""
    t = lex["words"]
    a, b = (np.where(x < UNKNOWN, x, ESCAPE) for x in (tok, other))
    same = a == b
    x = ((t["codes"][a] ^ t["codes"][np.minimum(b, len(t["codes"]) - 1)]) >> np.uint64(64 - CODE_BITS)).astype(np.float64)
    return np.where(same, t["length"][a], CODE_BITS - np.frexp(x)[1]).astype(np.int64)


def grade(n: np.ndarray) -> np.ndarray:
    """0, 1, 2 to 3, more: two bits."""
    return np.minimum(np.frexp(np.maximum(n, 0).astype(np.float64))[1], 3)


def in_a_row(hit: np.ndarray) -> np.ndarray:
    """Hits just before each place, without a miss between."""
    at = np.arange(len(hit))
    miss = np.maximum.accumulate(np.where(hit, -1, at)) if len(hit) else at
    return at - 1 - np.concatenate([[-1], miss[:-1]]) if len(hit) else at


def predictions(lex: dict, found: dict, table: np.ndarray, tok: np.ndarray, per: np.ndarray, training: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each predictor the places where it foretells a token, that token, and its state.

    ``table``: for each ask of ``found`` the answer (occurrences, token and count
    twice); a training document's own occurrences are taken out of it.
    """
    n = len(tok)
    doc = np.repeat(np.arange(len(per), dtype=np.int32), per)
    teach = np.repeat(training, per)
    # the answers of a context's parts together
    parts, first, ask = found["parts"], found["first"], found["ask"]
    answer = ask[first]
    split = np.flatnonzero(parts > 1)
    if len(split):
        rows = np.repeat(first[split], parts[split]) + C.ragged(parts[split])
        owner = np.repeat(np.arange(len(split)), parts[split])
        got = table[:, ask[rows]]
        whole = np.zeros((5, len(split)), np.int64)
        whole[0] = np.bincount(owner, got[0], len(split))
        owner, count, token = np.tile(owner, 2), np.concatenate([got[1], got[3]]), np.concatenate([got[2], got[4]])
        order = np.lexsort((token, -count, owner))
        begin = np.searchsorted(owner[order], np.arange(len(split)))
        for k, row in enumerate((1, 3)):
            whole[row], whole[row + 1] = count[order][begin + k], token[order][begin + k]
        answer[split] = table.shape[1] + np.arange(len(split))
        table = np.concatenate([table, whole], 1)
    out, latest, seen = [], np.full(n, -1, np.int32), np.zeros(n, np.uint8)
    for k, of in enumerate(found["of"]):
        key = of.astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64)
        key.sort()  # by context, then place
        order = key.astype(np.uint32).astype(np.int32)
        key >>= np.uint64(32)
        alike = np.zeros(n, bool)
        alike[1:] = (key[1:] == key[:-1]) & (doc[order[1:]] == doc[order[:-1]])
        # the same context before, in the text itself; the longer context comes later
        later = np.flatnonzero(alike)
        latest[order[later]], seen[order[later]] = order[later - 1], k
        at = answer.take(of)
        some = np.flatnonzero(table[0].take(at) > 0)
        total, c1, b1, c2, b2 = table[:, at[some]]
        b1, b2, came, mine = b1.astype(np.uint32), b2.astype(np.uint32), tok[some], teach[some]
        begin = np.flatnonzero(~alike)
        size = np.diff(np.append(begin, n)).astype(np.int32)
        group = np.empty(n, np.int32)
        group[order] = np.repeat(np.arange(len(begin), dtype=np.int32), size)
        group = group[some]
        own = size[group]
        one, two = (((own == 1) & (b == came)).astype(np.int64) for b in (b1, b2))
        many = np.flatnonzero((own > 1) & mine)
        if len(many):
            # how often each token follows a context that the text has several times
            often = np.zeros(len(size), bool)
            often[group[many]] = True
            places = np.flatnonzero(np.repeat(often, size))
            pair, times = np.unique(np.repeat(np.arange(len(size), dtype=np.uint64), size)[places] << np.uint64(32) | tok[order[places]].astype(np.uint64), return_counts=True)
            for b, to in ((b1, one), (b2, two)):
                want = group[many].astype(np.uint64) << np.uint64(32) | b[many].astype(np.uint64)
                at = np.minimum(np.searchsorted(pair, want), len(pair) - 1)
                to[many] = np.where(pair[at] == want, times[at], 0)
        c1, c2, total = c1 - one * mine, c2 - two * mine, total - own * mine
        best, count = np.where(c1 >= c2, b1, b2), np.maximum(c1, c2)
        some, best, count, total = (x[count > 0] for x in (some, best, count, total))
        hit = np.zeros(n, bool)
        hit[some] = best == tok[some]
        out.append((some, best, grade(count) << 4 | grade(total - count) << 2 | grade((in_a_row(hit)[some] + 2) // 3)))
    some = np.flatnonzero(latest >= 0)
    best = tok[latest[some]]
    hit = np.zeros(n, bool)
    hit[some] = best == tok[some]
    out.append((some, best, seen[some].astype(np.int64) << 3 | np.minimum(np.frexp(in_a_row(hit)[some].astype(float))[1], 7)))
    return out


READY = "file string, steps binary, states binary, flags binary, hits binary, rights binary"


def ready(made: DataFrame, solved: DataFrame, lex, n_buckets: int, n_blocks: int) -> DataFrame:
    """For each block and predictor, the steps it shares with each token's walk (255: it foretells nothing) and its state; whether words to spell were foretold (flags: 0 no, else 1 and the predictor's state; hits); and how often each state was right in training documents (rights)."""
    one = made.select("block", "file", F.lit(-1).alias("bucket"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("raw"))
    two = solved.select("block", F.lit(None).cast("string").alias("file"), "bucket", "n", "raw")

    def finish(file: str, got: list[tuple]) -> pa.RecordBatch:
        row = read_block(file, "per", "tok", "folds")
        own = lex.value
        per, tok, training = opened(row["per"], np.int64), opened(row["tok"], np.uint32), opened(row["folds"], np.int64) != HELD_OUT
        found = contexts(own, tok, per, n_buckets)
        table = np.zeros((5, len(found["asks"])), np.int64)
        for bucket, n, raw in got:
            x = opened(raw, np.int64)
            begin = np.searchsorted(found["asks"], np.uint64(bucket) << np.uint64(32))
            table[:, begin + np.cumsum(x[:n])] = x[n:].reshape(5, n)
        length = own["words"]["length"][np.where(tok < UNKNOWN, tok, ESCAPE)]
        teach = np.repeat(training, per)
        odd = np.flatnonzero(tok >= UNKNOWN)
        flags, hits = np.zeros(len(odd), np.uint8), np.zeros(len(odd), bool)
        steps, states, rights = [], [], np.zeros((2, PREDICTORS * STATES * DEPTHS), np.int64)
        told = predictions(own, found, table, tok, per, training)
        for k, (some, best, state) in enumerate(told):
            shared = np.minimum(agreed(own, tok[some], best), length[some])
            steps.append(np.full(len(tok), 255, np.uint8))
            states.append(np.zeros(len(tok), np.uint8))
            steps[k][some], states[k][some] = shared, state
            mine = teach[some]
            n = np.minimum(shared + 1, length[some])[mine]
            step = C.ragged(n)
            cell = np.repeat((k * STATES + state[mine]) * DEPTHS, n) + DEEP[np.minimum(step, 63)]
            right = step < np.repeat(shared[mine], n)
            rights[0] += np.bincount(cell[~right], minlength=rights.shape[1])
            rights[1] += np.bincount(cell[right], minlength=rights.shape[1])
        place = np.full(len(tok), -1)
        place[odd] = np.arange(len(odd))
        for k in (len(ORDERS) - 1, PREDICTORS - 1, *range(len(ORDERS) - 2, -1, -1)):  # the longest context first, then the text itself
            some, best, state = told[k]
            use = (place[some] >= 0) & (best >= UNKNOWN)
            at, best, state, some = place[some][use], best[use], state[use], some[use]
            free = flags[at] == 0
            flags[at[free]] = 1 + k * STATES + state[free]
            hits[at[free]] = best[free] == tok[some[free]]
        sure = np.flatnonzero((flags > 0) & teach[odd])
        foretold = np.stack([np.bincount(flags[sure][hits[sure] == x], minlength=1 + PREDICTORS * STATES) for x in (False, True)])
        more = [shut(np.stack(steps)), shut(np.stack(states)), shut(flags), shut(hits), shut(np.concatenate([rights.reshape(-1), foretold.reshape(-1)]))]
        return pa.RecordBatch.from_arrays([pa.array([file]), *(pa.array([x], pa.binary()) for x in more)], [x.split()[0] for x in READY.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []
        for batch in batches:
            for file, *answer in zip(*(batch.column(c).to_pylist() for c in ("file", "bucket", "n", "raw"))):
                if file is None:
                    got.append(answer)
                    continue
                if now:
                    yield finish(now, got)
                now, got = file, []
        if now:
            yield finish(now, got)
        C.release()

    n = max(C.tasks(made.sparkSession), n_blocks // 2)
    return one.unionByName(two).repartition(n, "block").sortWithinPartitions("block", "bucket").select("file", "bucket", "n", "raw").mapInArrow(run, READY)


def signs(bit: np.ndarray) -> np.ndarray:
    """Bits as signs."""
    out = bit.astype(np.float32)
    out *= 2
    out -= 1
    return out


def right_logits(rights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits that a predictor's next step is right, by predictor, state and depth; and that a foretold word comes, by flag."""
    cut = 2 * PREDICTORS * STATES * DEPTHS
    out = []
    for x in (rights[:cut], rights[cut:]):
        wrong, right = x.reshape(2, -1).astype(float)
        out.append(np.clip(np.log((right + 0.4) / (wrong + 0.4)), -LARGEST, LARGEST).astype(np.float32))
    return out[0], out[1]


def add_rights(made: DataFrame) -> np.ndarray:
    """The sum of the blocks' tables, partly summed in each task."""
    size = 2 * PREDICTORS * STATES * DEPTHS + 2 * (1 + PREDICTORS * STATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column("rights").to_pylist():
                total += opened(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["rights"])

    total = np.zeros(size, np.int64)
    few = made.sparkSession.sparkContext.defaultParallelism
    parts = made.select("rights").mapInArrow(run, "rights binary").coalesce(few).mapInArrow(lambda b: run_bytes(b, size), "rights binary")
    for row in parts.collect():  # a small table from each
        total += np.frombuffer(row["rights"], np.int64)
    return total


def run_bytes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for batch in batches:
        for raw in batch.column("rights").to_pylist():
            total += np.frombuffer(raw, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["rights"])


# ----------------------------------------------------------------------- mixing
def streams(lex: dict, model: dict, tok: np.ndarray, per: np.ndarray, training: np.ndarray, table: np.ndarray, steps: np.ndarray, states: np.ndarray, flags: np.ndarray, hits: np.ndarray, odd_text: np.ndarray, odd_size: np.ndarray) -> tuple[list[dict], np.ndarray]:
    """Three streams of bits (of words, where no context foretells; where some does; of spelling): inputs towards the bit that came, its gate, and bits of each text; and each text's ln p of the flags.  ``table``: the first row of the markers' shares for each text."""
    n = len(per)
    doc = np.repeat(np.arange(n, dtype=np.int32), per)
    symbol = np.where(tok < UNKNOWN, tok, ESCAPE)
    t = lex["words"]
    length, first = t["length"][symbol].astype(np.int32), t["first"][symbol].astype(np.int32)
    nodes = model["markers"].shape[1]
    marked = markers(tok, per)
    mark = ((marked + np.repeat(table, per)) * nodes).astype(np.int32)
    # the steps up to which some predictor's walk agrees, and the one at which the last of them leaves
    agree = steps.view(np.int8)  # none: -1
    longest = agree[0]
    for more in agree[1:]:
        longest = np.maximum(longest, more)
    live = np.minimum(longest.astype(np.int32) + 1, length)

    def walk(begin: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = int(count.sum())
        at = np.repeat((first + begin - np.cumsum(count, dtype=np.int32) + count).astype(np.int32), count)
        at += np.arange(n, dtype=np.int32)
        node = t["steps"].take(at)
        deep = (node >> DEEP_BITS).astype(np.uint8)
        node &= (1 << DEEP_BITS) - 1
        inputs = np.empty((width, n), np.float32)
        lex["signed"].take(node, out=inputs[0], mode="clip")
        sign = signs(node & 1)
        sign *= UNIT
        node >>= 1
        node += np.repeat(mark, count)
        np.multiply(every.take(node), sign, out=inputs[1])
        return deep, inputs

    texts = np.cumsum(per) - per
    every = model["markers"].reshape(-1)
    rest = length - live
    deep, inputs = walk(live, rest, 2)
    out = [{"inputs": inputs, "gate": deep, "per": np.add.reduceat(rest, texts)}]
    deep, inputs = walk(np.zeros(len(tok), np.int32), live, 2 + PREDICTORS)
    gate = (deep == 0).view(np.uint8)
    place, begin = np.arange(len(deep), dtype=np.int32), np.cumsum(live, dtype=np.int32) - live
    for k in range(PREDICTORS):
        upto = np.repeat(begin + agree[k], live)
        cell = np.repeat((k * STATES + states[k].astype(np.int32)) * DEPTHS, live)
        cell += deep
        goes, holds = upto > place, upto >= place
        np.multiply(model["rights"].take(cell), goes.view(np.int8) * np.int8(2) - holds.view(np.int8), out=inputs[2 + k])
        gate += holds.view(np.uint8) << np.uint8(1 + k)
    out.append({"inputs": inputs, "gate": gate, "per": np.add.reduceat(live, texts)})
    odd_doc = doc[tok >= UNKNOWN]
    logit = np.where(hits, 1, -1) * model["flags"][flags]
    flagged = flags > 0
    ln = -np.bincount(odd_doc[flagged], np.log1p(np.exp(-logit[flagged].astype(float))), n)
    s = spelt(lex, tok, per, odd_text, odd_size, np.flatnonzero(~hits), marked)
    # a training document's word is taken out of the counts: a table each without a zero, and without a one
    table = (np.repeat(training[s["doc"]].view(np.uint8), s["long"]) * (s["bit"] + np.uint8(1))).astype(np.int32)
    table *= np.int32(SPELLING_BASES[-1])
    inputs = np.empty((len(SPELLING), len(table)), np.float32)
    sign = signs(s["bit"])
    sign *= UNIT
    for k, slots in enumerate(s["slots"]):
        slots += table
        np.multiply(model["spelling"].take(slots), sign, out=inputs[k])
    gate = s["place"] << np.uint8(2)
    gate |= (inputs[3] != 0).view(np.uint8) << np.uint8(1)
    gate |= (np.abs(inputs[2]) > 1.5).view(np.uint8)
    out.append({"inputs": inputs, "gate": gate, "per": np.bincount(s["doc"], s["long"], n).astype(np.int64)})
    return out, ln


def spelling_logits(counts: np.ndarray) -> np.ndarray:
    """Three tables of logits, one after the other: of the counts of zeros and ones, of those with a zero less, and with a one less."""
    out = np.empty(3 * len(counts), np.int16)
    for k, less in enumerate(([0, 0], [1, 0], [0, 1])):
        c = np.maximum(counts - np.array(less, np.float32), 0)
        out[k * len(counts) : (k + 1) * len(counts)] = fixed(np.log((c[:, 1] + SMOOTH) / (c[:, 0] + SMOOTH)))
    return out


def mix(stream: dict, weights: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of ln p of each text's bits, the weights that it ends with (by predictor, then text and gate), and its bits."""
    inputs, gate = stream["inputs"], stream["gate"]
    width, n = inputs.shape
    out = np.zeros(n_docs)
    own = np.tile(weights.astype(np.float32).T, (1, n_docs))
    per = stream["per"] if "per" in stream else np.bincount(stream["doc"], minlength=n_docs)
    if not n:
        return out, own, per
    # all first turns of the texts, then all second ones, and so on; in a text's turn its bits lie gate by gate
    turns = -(-per // TURN)
    text = np.repeat(np.arange(n_docs), turns)
    number = C.ragged(turns)
    by_number = np.argsort(number, kind="stable")
    place = np.empty(len(number), np.int64)
    place[by_number] = np.arange(len(number))
    lengths = np.minimum(per[text] - number * TURN, TURN)
    key = np.repeat((place << 4).astype(np.uint16 if len(number) <= 1 << 12 else np.int64), lengths)
    key |= gate
    order = np.argsort(key, kind="stable")
    key = key.take(order)
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begin, n))
    key = key[begin].astype(np.int64)
    turn = number[by_number][key >> 4]
    cell = text[by_number][key >> 4] << 4 | key & 15
    rate = (RATE / (HOLD + CURVE * size)).astype(np.float32)
    cuts = np.searchsorted(turn, np.arange(turn[-1] + 2)).tolist()
    edges = np.append(begin, n)[cuts].tolist()
    # inputs point towards the bit that came: positive is right
    rows = [x.take(order) for x in inputs]
    sums = np.empty(len(begin), np.float64)
    for a, b, lo, hi in zip(cuts[:-1], cuts[1:], edges[:-1], edges[1:]):
        x, at, long, first = [r[lo:hi] for r in rows], cell[a:b], size[a:b], begin[a:b] - lo
        z = own[0].take(at).repeat(long)
        z *= x[0]
        for k in range(1, width):
            more = own[k].take(at).repeat(long)
            more *= x[k]
            z += more
        np.negative(z, out=z)
        np.minimum(z, 11.5, out=z)
        np.maximum(z, -11.5, out=z)
        e = np.exp(z, out=z)
        total = 1 + e
        sums[a:b] = np.add.reduceat(np.log(total), first)
        e /= total  # what the bit that came lacked
        step = rate[a:b]
        for k in range(width):
            own[k, at] += step * np.add.reduceat(e * x[k], first)
    out -= np.bincount(cell >> 4, sums, n_docs)
    return out, own, per


def slopes(stream: dict, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the weights of each gate, the summed gradient and mean curvature over all bits."""
    inputs, gate = stream["inputs"], stream["gate"].astype(np.int64)
    z = np.zeros(len(gate), np.float32)
    for w, x in zip(weights.T.astype(np.float32), inputs):
        more = w.take(gate)
        more *= x
        z += more
    np.minimum(z, 11.5, out=z)
    np.exp(z, out=z)
    z += 1
    np.reciprocal(z, out=z)  # what the bit that came lacked
    return np.stack([np.bincount(gate, z * x, GATES) for x in inputs], 1), CURVE * np.bincount(gate, minlength=GATES)[:, None].repeat(len(inputs), 1)


#: Weights before any training, for each stream and gate.
START = [np.tile(np.array([w]), (GATES, 1)) for w in ([0.3, 0.7], [0.2, 0.5, *[0.4] * PREDICTORS], [0.1, 0.2, 0.3, 0.5])]


def flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.reshape(-1) for a in arrays])


def apart(values: np.ndarray) -> list[np.ndarray]:
    cuts = np.cumsum([a.size for a in START])[:-1]
    return [x.reshape(a.shape) for x, a in zip(np.split(values, cuts), START)]


def pieces(row: dict, lex: dict, model: dict, learning: bool = False) -> Iterator[tuple[np.ndarray, list[dict], np.ndarray]]:
    """The streams of some texts of about the same length, which have as many turns, at a time (of training documents only, each with the markers' shares of the other half, when ``learning``): their places, streams, ln p of flags."""
    per, folds, tok = opened(row["per"], np.int64), opened(row["folds"], np.int64), opened(row["tok"], np.uint32)
    steps, states = (opened(row[c], np.uint8).reshape(PREDICTORS, -1) for c in ("steps", "states"))
    flags, hits = opened(row["flags"], np.uint8), opened(row["hits"], np.bool_)
    text, size = opened(row["odd_text"], np.uint8), opened(row["odd_size"], np.int64)
    ends = np.concatenate([[0], np.cumsum(per)])
    odd = np.concatenate([[0], np.cumsum(tok >= UNKNOWN)])
    byte = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(per, kind="stable")
    if learning:  # one half after the other
        order = np.flatnonzero(folds != HELD_OUT)
        order = order[np.argsort(folds[order] >= SECOND, kind="stable")]
    table = (folds < SECOND) * (MARKERS + 1) if learning else np.zeros(len(per), np.int64)
    upto = np.concatenate([[0], np.cumsum(per[order])])
    at, most = 0, PIECE // 2 if learning else PIECE
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1)
        use, at = order[at:to], to
        words = np.repeat(ends[use], per[use]) + C.ragged(per[use])
        n_odd = odd[ends[use + 1]] - odd[ends[use]]
        odds = np.repeat(odd[ends[use]], n_odd) + C.ragged(n_odd)
        spelt_ = C.gather_spans(text, byte[odds], size[odds])
        yield use, *streams(lex, model, tok[words], per[use], folds[use] != HELD_OUT, table[use], steps.take(words, 1), states.take(words, 1), flags[odds], hits[odds], spelt_, size[odds])


NEEDED = ("folds", "per", "tok", "odd_text", "odd_size")
FOUND = ("file", "steps", "states", "flags", "hits")


def train_mixer(made: DataFrame, lex, model) -> tuple[np.ndarray, np.ndarray]:
    """Weights for each stream and gate, times the curvature behind them, and that curvature: the sums of each task's online pass over its training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bends = [a.copy() for a in START], [np.zeros(a.shape) for a in START]
        for batch in batches:
            for row in batch.to_pylist():
                for _, found, _ in pieces(row | read_block(row["file"], *NEEDED), lex.value, model.value, learning=True):
                    for k, stream in enumerate(found):
                        slope, bend = slopes(stream, weights[k])
                        bends[k] += bend
                        weights[k] += learn(slope, bend)
        yield pa.RecordBatch.from_arrays([pa.array([(flat(weights) * flat(bends)).tobytes()]), pa.array([flat(bends).tobytes()])], ["sums", "bends"])
        C.release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(flat(START).size), np.zeros(flat(START).size)]
        for batch in batches:
            for t, name in zip(total, ("sums", "bends")):
                for raw in batch.column(name).to_pylist():
                    t += np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()]) for t in total], ["sums", "bends"])

    kinds = "sums binary, bends binary"
    sums, bends = np.zeros(flat(START).size), np.zeros(flat(START).size)
    few = made.sparkSession.sparkContext.defaultParallelism
    for row in made.select(*FOUND).mapInArrow(run, kinds).repartition(few).mapInArrow(add, kinds).collect():  # a small table from each
        sums += np.frombuffer(row["sums"])
        bends += np.frombuffer(row["bends"])
    return sums, bends


def learn(slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """A damped step for the weights from a piece of texts."""
    return np.clip(0.5 * slope / (bend + 100), -0.2, 0.2)


SCORED = "doc_id long, fold long, n_tokens long, n_known long, base double, score double, n_bytes long, rare array<long>, times array<int>"


def score_blocks(made: DataFrame, lex, model, weights: list[np.ndarray]) -> DataFrame:
    """SCORED for each document of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                row |= read_block(row["file"], "ids", "sizes", "known", "base", "rare", "rare_per", *NEEDED)
                per, n_rare = opened(row["per"], np.int64), opened(row["rare_per"], np.int64)
                n = len(per)
                ln = np.zeros(n)
                for use, found, flagged in pieces(row, lex.value, model.value):
                    ln[use] += flagged
                    for k, stream in enumerate(found):
                        ln[use] += mix(stream, weights[k], len(use))[0]
                doc, h = np.repeat(np.arange(n), n_rare), opened(row["rare"], np.uint64)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                lead = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[lead], minlength=n))]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array(opened(row["folds"], np.int64)), pa.array(per), pa.array(opened(row["known"], np.int64)), pa.array(opened(row["base"], np.float64)), pa.array(ln / np.log(10)),
                        pa.array(opened(row["sizes"], np.int64)), pa.ListArray.from_arrays(offsets, pa.array(C.signed(h[lead]))), pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(lead, len(h))), pa.int32())),
                    ],
                    [x.split()[0] for x in SCORED.split(", ")],
                )
        C.release()

    return made.select(*FOUND).mapInArrow(run, SCORED)


def score(df: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = df.sparkSession
    share = spark.sparkContext.broadcast
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    fold = F.coalesce(code % FOLDS, F.lit(0)).cast("long")
    docs = df.select("doc_id", "text", fold.alias("fold"))
    counted = C.stored(count_tokens(docs.where(f"fold <> {HELD_OUT}")), "tokens")
    words = counted.where("kind = 0").select("key", "c")
    whole = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = int(whole[0]), int(whole[1])
    top = words.orderBy(F.desc("c"), "key").limit(TOP).toArrow()  # TOP rows at most
    letters = np.zeros(256, np.int64)
    for row in counted.where("kind = 1").collect():  # 256 rows
        letters[row["key"]] = row["c"]
    as_array = lambda t, name: np.asarray(t.column(name).combine_chunks(), np.int64)
    keys, counts = as_array(top, "key").view(np.uint64), as_array(top, "c")
    lex = share(lexicon(keys, counts, total, letters))
    del top, keys
    floor = total + distinct + 1
    folder = C.new_path(spark, "texts")
    listed = C.stored(blocks(docs, lex, floor, folder), "blocks")
    n_blocks = listed.count()
    made = listed.repartition(max(C.tasks(spark), n_blocks // 2), "block")
    n_buckets = max(C.tasks(spark), -(-total // SPLIT))
    asked = entries(made, lex, n_buckets).repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "block")
    done = C.stored(ready(listed, answers(asked), lex, n_buckets, n_blocks), "ready").repartition(max(C.tasks(spark), n_blocks // 2), "file")
    # tables of a fixed size are made by few tasks, which read many blocks each
    wide = listed.repartition(4 * spark.sparkContext.defaultParallelism, "block")
    spelling = spelling_table(wide, lex)
    every, *halves = marker_logits(count_markers(wide), lex)
    rights, flags = right_logits(add_rights(done))
    base = {"spelling": spelling_logits(spelling), "rights": rights, "flags": flags}
    del spelling
    # weights are trained on texts whose words the markers' shares have not seen
    start, first = flat(START), share(base | {"markers": np.concatenate(halves)})
    sums, bends = train_mixer(done, lex, first)
    first.destroy()
    weights = apart((sums + 100 * start) / (bends + 100))
    model = share(base | {"markers": every})
    del base, every, halves, first
    scored = C.stored(score_blocks(done, lex, model, weights).withColumn("row", F.monotonically_increasing_id()), "scores")
    C.remove(spark, folder)
    # rarer tokens: none of them is in many documents, as TOP others are more frequent
    pairs = scored.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    least = int(counts.min()) if len(counts) >= TOP else 0
    rarer = words.where(F.col("c") <= least) if least else words.limit(0)
    joined = pairs.join(rarer, "key", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(floor)))).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known"))
    bits = -F.col("score") * float(np.log2(10))
    return scored.select("row", "doc_id", "fold", "n_tokens", "n_known", "base", "score", "n_bytes").join(joined, "row", "left").select(
        "doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", "n_bytes", F.try_divide(bits, F.col("n_bytes")).alias("bits_per_byte"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.table(spark, sf_dir, "documents", "doc_id", "text"))
