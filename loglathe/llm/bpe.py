"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words (pre-tokens) of a chunk are walked as a trie: sorted, each
word continues from the states of the prefix that it shares with the word
before.  The state of a prefix is the last token of its encoding; a prefix of
length n ends in token t when t is a suffix of it, and t may follow the last
token of the prefix of length n - len(t).  That token is unique, so a word's
encoding is read off backwards from its last state.

Defined results: null and empty texts encode to no ids; texts may be of any
length; equal texts give equal rows; tables without rows give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

#: Entries of the direct-mapped cache of encoded words, and ids kept for them.
CACHE_SLOTS, CACHE_IDS = 1 << 20, 6_000_000

#: White space of the pattern's \s.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = range(4)


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in shown):
        out[chr(256 + n)] = b
    return out


def _classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        first = unicodedata.category(chr(cp))[0]
        if first in "LN":
            kinds[cp] = LETTER if first == "L" else NUMBER
    kinds[WHITE] = SPACE
    return kinds


class Encoder:
    """Encodes words by the trie; ``single`` may replace it by another encoder of one word."""

    def __init__(self, path: str, single=None):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        chars = _byte_chars()
        vocab = model["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in model["added_tokens"]}
        self.tokens: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, i in vocab.items():
            self.tokens[i] = bytes(chars[c] for c in text) if text.encode() not in self.special else text.encode()
        for text, i in self.special.items():
            self.tokens[i] = text
        self.merged, self.halves = {}, {}
        for pair in model["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b], self.halves[c] = c, (a, b)
        if list(self.halves) != sorted(self.halves):
            raise ValueError("ids must follow the order of the merges")
        self.ids = {t: i for i, t in enumerate(self.tokens) if i in self.halves or len(t) == 1}
        self.longest = [0] * 256
        for t in self.ids:
            self.longest[t[-1]] = max(self.longest[t[-1]], len(t))
        self.follows: dict[int, bool] = {}
        self.single = single
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.kinds = _classes()
        self.clear()

    # ---------------------------------------------------------------- words
    def clear(self) -> None:
        self.keys = np.zeros(CACHE_SLOTS, np.uint64)
        self.at = np.zeros(CACHE_SLOTS, np.int64)
        self.count = np.zeros(CACHE_SLOTS, np.int64)
        self.store = np.zeros(1 << 16, np.int32)
        self.stored = 0

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the encoding of left + right keeps the border between the two.

        Merges are undone from the border outwards, latest first; the border
        falls if two neighbours at it would have merged before either was used.
        """
        bound = len(self.tokens)
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < bound:
                return False
            undo_left = self.halves.get(left)
            undo_right = self.halves.get(right)
            if undo_left is None and undo_right is None:
                return True
            if undo_right is None or undo_left is not None and left > right:
                bound, left = left, undo_left[1]
            else:
                bound, right = right + 1, undo_right[0]

    def encode_sorted(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of words in sorted order, each shared prefix walked once."""
        out, last, lengths, before = [], [], [], b""
        ids, follows, longest, tokens = self.ids, self.follows, self.longest, self.tokens
        if len(follows) > 2_000_000:
            follows.clear()
        for word in words:
            shared, n = 0, len(word)
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared:]
            for i in range(shared, n):
                end = i + 1
                for start in range(max(0, end - longest[word[i]]), end):
                    token = ids.get(word[start:end])
                    if token is None:
                        continue
                    if start:
                        key = last[start - 1] << 20 | token
                        ok = follows.get(key)
                        if ok is None:
                            ok = follows[key] = self.may_follow(last[start - 1], token)
                        if not ok:
                            continue
                    last.append(token)
                    break
            before = word
            found, i = [], n
            while i:
                token = last[i - 1]
                found.append(token)
                i -= len(tokens[token])
            found.reverse()
            out.append(found)
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        if self.single:
            return [[self.special[w]] if w in self.special else self.single(w) for w in words]
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list = [None] * len(words)
        for i, ids in zip(order, self.encode_sorted([words[i] for i in order])):
            out[i] = [self.special[words[i]]] if words[i] in self.special else ids
        return out

    # ---------------------------------------------------------------- texts
    def split(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Byte positions where words start, by the rules of the vocabulary's pattern."""
        n_bytes = len(data)
        if not n_bytes:
            return np.zeros(0, np.int64)
        raw = data.tobytes()
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        cps = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(cps)
        kind = self.kinds[cps]
        first = np.zeros(n + 1, bool)  # where a text starts
        first[np.searchsorted(lead, offs)] = True
        inner = []
        for text in self.special:
            at = raw.find(text)
            while at >= 0:
                a = int(np.searchsorted(lead, at))
                b = int(np.searchsorted(lead, at + len(text)))
                if not first[a + 1 : b].any():
                    first[a] = first[b] = True
                    inner.append((a, b))
                    at = raw.find(text, at + len(text))
                else:
                    at = raw.find(text, at + 1)
        first[n] = True
        start = first[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # the last white-space character before other characters of the text
        gives = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
        start[gives] = True
        start[gives[cps[gives] == 0x20] + 1] = False
        # contractions at a word's start
        mark = np.flatnonzero((cps == 0x27) & start)
        if len(mark):
            padded = np.concatenate([cps, np.zeros(2, np.uint32)])
            ends = np.concatenate([first, np.ones(3, bool)])
            one, two = padded[mark + 1], padded[mark + 2]
            free1 = ~ends[mark + 1]
            free2 = free1 & ~ends[mark + 2]
            short = free1 & np.isin(one, [ord(c) for c in "stmd"])
            long = free2 & ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
            for which, length in ((short, 2), (long, 3)):
                q = mark[which]
                start[q + 1] = False
                q = q + length
                start[q[q < n]] = True
        for a, b in inner:
            start[a + 1 : b] = False
        return lead[start[: len(lead)]]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and ids per text."""
        starts = self.split(data, offs)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        h = C.span_hash(data, starts, ends) | np.uint64(1)
        if self.stored > CACHE_IDS:
            self.clear()
        slot = (h >> np.uint64(20)).astype(np.int64) & (CACHE_SLOTS - 1)
        hit = self.keys[slot] == h
        at, count = self.at[slot], self.count[slot]
        miss = np.flatnonzero(~hit)
        if len(miss):
            _, index, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            own = miss[index]
            raw = data.tobytes()
            encoded = self.encode_words([raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist())])
            counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
            flat = np.fromiter((i for ids in encoded for i in ids), np.int32, int(counts.sum()))
            places = self.stored + np.cumsum(counts) - counts
            if self.stored + len(flat) > len(self.store):
                grown = np.zeros(2 * (self.stored + len(flat)), np.int32)
                grown[: self.stored] = self.store[: self.stored]
                self.store = grown
            self.store[self.stored : self.stored + len(flat)] = flat
            self.stored += len(flat)
            self.keys[slot[own]], self.at[slot[own]], self.count[slot[own]] = h[own], places, counts
            at[miss], count[miss] = places[inverse], counts[inverse]
        ids = C.gather_spans(self.store, at, count)
        sums = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=sums[1:])
        return ids, np.diff(sums[np.searchsorted(starts, offs)])

    def decode_bytes(self, ids: np.ndarray, per: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all decoded texts, one after the other, and their offsets."""
        lengths = self.lengths[ids]
        sums = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lengths, out=sums[1:])
        ends = np.concatenate([[0], np.cumsum(per)])
        return C.gather_spans(self.bytes, self.places[ids], lengths).tobytes(), sums[ends]


_encoders: dict = {}


def encoder(path: str, fast: bool = False) -> Encoder:
    """One encoder for each worker process; ``fast``: words by tiktoken's merge loop, the same ids."""
    if (path, fast) not in _encoders:
        made = Encoder(path)
        if fast:
            import tiktoken

            ranks = {made.tokens[i]: i for i in [*made.ids.values()]}
            core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=_ranked(made), special_tokens={})
            back = np.array([ranks[t] for t in _ranked(made)], np.int32).tolist()
            made.single = lambda w: [back[i] for i in core._encode_single_piece(w)]
        _encoders[path, fast] = made
    return _encoders[path, fast]


def _ranked(e: Encoder) -> dict[bytes, int]:
    singles = [i for t, i in e.ids.items() if i not in e.halves]
    return {e.tokens[i]: n for n, i in enumerate([*singles, *e.halves])}


def encode_texts(df: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: the whole encoding and its decoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in C.chunks(batches):
            data, offs = C.buffers(batch.column("text"))
            ids, per = e.encode(data, offs)
            raw, at = e.decode_bytes(ids, per)
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in C.chunks(batches):
            data, offs = C.buffers(batch.column("text"))
            ids, per = e.encode(data, offs)
            packed = memoryview(ids.astype("<u4").tobytes())
            ends = np.concatenate([[0], np.cumsum(per)]) * 4
            raw, at = e.decode_bytes(ids, per)
            sha = lambda b: hashlib.sha256(b).hexdigest()
            one = [sha(packed[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            two = [sha(raw[a:b].decode("utf-8", "replace").encode()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(per, pa.int64()), pa.array(one), pa.array(two)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(C.table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
