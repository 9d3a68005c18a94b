"""Spelling variants of words, by minimal acyclic automata searched from both ends.

Two words at one error agree in the first half of the one, exactly, or else in
its second half.  Words are indexed by the halves that a neighbour of one more,
one fewer or as many letters would have; words of the same key meet in a block.
A block's words are held in a minimal acyclic automaton, read forward for first
halves and backward for second ones, whose edges carry counts of the words
before them, so that a path's sum is its word's number (a perfect hash).  A
query follows its half exactly and completes the rest with one error; numbers
found twice are one word, and what shares the first half counts there alone.
All words of a block are walked at once, as arrays.

Words longer than LONG letters are compared within their key directly, because
repeated letters would keep as many paths alive as the word has letters.

Defined results: null texts have no words; a null doc_id counts as an empty one
where occurrences are altered; repeated rows count again; of near words with
equal counts the smallest in code-point order is the form; words without a near
word of twice their count have no form and are their own root; tables without
rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: The letters of words.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS, OCCURRENCES, SHARE = 5, 3, 2
#: Words of a block, and of a key beyond which it is split; letters beyond which words are compared directly.
BLOCK, HOT, LONG = 8192, 16384, 256
#: Words counted in a task before their counts are handed on; code points of a text handled at once.
HELD, AT_ONCE = 400_000, 1 << 22


# ------------------------------------------------------------------- words
def runs(text: str) -> Iterator[str]:
    """Runs of letters, A-Z in lower case."""
    if len(text) <= AT_ONCE:
        yield from RUN.findall(text.encode().lower().decode())
    else:
        for found in RUN.finditer(text):
            yield found.group().encode().lower().decode()


def altered(run: str, crc: int, one_in: int | None) -> str:
    """The run without the letter that its hash points to, where ``one_in`` divides the hash."""
    if one_in:
        h = zlib.crc32(run.encode(), crc)
        if h % one_in == 0:
            at = h % len(run)
            return run[:at] + run[at + 1 :]
    return run


def vocabulary(docs: DataFrame, one_in: int | None = None, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n over all texts of columns doc_id and text.

    With ``one_in``, a run loses a letter where that number divides the hash of
    its document and itself: known misspellings, to test the grouping with.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for part in C.chunks([batch]):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    crc = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for run, n in Counter(runs(text or "")).items():
                        word = altered(run, crc, one_in)
                        if len(word) >= letters:
                            held[word] += n
                    if len(held) > HELD:
                        yield given()
        yield given()
        C.release()

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


# --------------------------------------------------------------- automaton
class Automaton:
    """A minimal acyclic automaton over sorted distinct words, as arrays.

    ``edge`` holds state * 256 + letter in order, ``to`` the next state and
    ``before`` how many words of the state come before those through the edge.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray) -> None:
        n, wide = codes.shape
        same = np.zeros(n, np.int64)  # letters shared with the word before
        if n > 1:
            same[1:] = np.cumprod((codes[1:] == codes[:-1]) & (codes[1:] != 0), axis=1).sum(1)
        # nodes of the trie: a word adds those beyond what it shares, deepest last
        own = lengths - same
        own[0] = lengths[0]
        word = np.repeat(np.arange(n), own)
        depth = C.ragged(own) + 1 + np.repeat(np.where(np.arange(n) == 0, 0, same), own)
        letter = codes[word, depth - 1]
        total = len(word) + 1  # 0 is the root
        # node of a word at a depth: its own, or that of the last word before it that owns the depth
        node = np.zeros((n, wide + 1), np.int64)
        node[word, depth] = np.arange(1, total)
        for d in range(1, wide + 1):
            node[:, d] = np.maximum.accumulate(node[:, d])  # numbers rise with words
        final = np.zeros(total, bool)
        final[node[np.arange(n), lengths]] = True
        parent = np.zeros(total, np.int64)
        parent[1:] = np.where(depth == 1, 0, node[word, depth - 1])
        height = np.zeros(total, np.int64)
        by_depth = np.argsort(depth, kind="stable")[::-1] + 1
        depths = depth[by_depth - 1]
        for d in range(wide, 0, -1):
            own_d = by_depth[np.searchsorted(-depths, -d, "left") : np.searchsorted(-depths, -d, "right")]
            np.maximum.at(height, parent[own_d], height[own_d] + 1)
        # edges in order of parent and letter: children of a node are numbered in order of letters
        kids = np.argsort(parent[1:], kind="stable") + 1
        begin = np.searchsorted(parent[kids], np.arange(total + 1))
        degree = np.diff(begin)
        state = np.zeros(total, np.int64)
        finals, edges, tos, befores = [], [], [], []
        made = 0  # states of lower heights come first: equal ones are merged height by height
        known = np.zeros(total, np.int64)  # words through a state
        for h in range(int(height.max()) + 1):
            nodes = np.flatnonzero(height == h)
            k = degree[nodes]
            rows = kids[C.gather_spans(np.arange(len(kids)), begin[nodes], k)]
            sign = state[rows] * 256 + letter[rows - 1]
            which = np.repeat(np.arange(len(nodes)), k)
            with np.errstate(over="ignore"):
                each = C.mix(sign.astype(np.uint64) + np.uint64(1)) * (C.ragged(k).astype(np.uint64) * np.uint64(2) + np.uint64(1))
                sums = np.zeros(len(rows) + 1, np.uint64)
                np.cumsum(each, out=sums[1:])
                ends = np.cumsum(k)
                digest = C.mix(sums[ends] - sums[ends - k] + final[nodes].astype(np.uint64) + np.uint64(3) * k.astype(np.uint64))
            _, lead, group = np.unique(digest, return_index=True, return_inverse=True)
            # merge only what is equal in fact
            equal = (k == k[lead][group]) & (final[nodes] == final[nodes[lead]][group])
            if equal.all() and len(rows):
                equal[which] &= sign == sign[(ends - k)[lead][group][which] + C.ragged(k)]
            if not equal.all():
                lead, group = np.arange(len(nodes)), np.arange(len(nodes))
            state[nodes] = made + group
            first_edges, count = (ends - k)[lead], k[lead]
            chosen = C.gather_spans(np.arange(len(rows)), first_edges, count)
            through = known[state[rows[chosen]]]
            cum = np.cumsum(through) - through
            starts = np.cumsum(count) - count
            base = np.repeat(cum[np.minimum(starts, max(0, len(cum) - 1))] if len(cum) else np.zeros(len(lead), np.int64), count)
            end = final[nodes[lead]].astype(np.int64)
            edges.append(np.repeat(made + np.arange(len(lead)), count) * 256 + letter[rows[chosen] - 1])
            tos.append(state[rows[chosen]])
            befores.append(cum - base + np.repeat(end, count))
            all_words = end.copy()
            np.add.at(all_words, np.repeat(np.arange(len(lead)), count), through)
            known[made : made + len(lead)] = all_words
            finals.append(end.astype(bool))
            made += len(lead)
        self.root, self.states = int(state[0]), made
        self.final = np.concatenate(finals)
        self.edge, self.to, self.before = (np.concatenate(x).astype(np.int64) for x in (edges, tos, befores))
        self.begin = np.searchsorted(self.edge, np.arange(made + 1) * 256)

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges by state and letter, and which of them exist."""
        if not len(self.edge):
            return np.zeros(len(state), np.int64), np.zeros(len(state), bool)
        want = state * 256 + letter
        at = np.minimum(np.searchsorted(self.edge, want), len(self.edge) - 1)
        return at, self.edge[at] == want

    def number(self, codes: np.ndarray, length: int) -> np.ndarray:
        """Numbers of words of one length, -1 for others."""
        state, number = np.full(len(codes), self.root), np.zeros(len(codes), np.int64)
        alive = np.ones(len(codes), bool)
        for i in range(length):
            at, there = self.step(state, codes[:, i])
            alive &= there
            state, number = np.where(alive, self.to[at], 0), number + np.where(alive, self.before[at], 0)
        return np.where(alive & self.final[state], number, -1)

    def near(self, codes: np.ndarray, length: int, exact: int) -> tuple[np.ndarray, np.ndarray]:
        """Query and word number of all words at one error from the queries, beyond the first ``exact`` letters."""
        query = np.arange(len(codes))
        state, number = np.full(len(codes), self.root), np.zeros(len(codes), np.int64)
        pool = [np.zeros(0, np.int64)] * 3
        for i in range(length + 1):
            if i >= exact:
                count = self.begin[state + 1] - self.begin[state]
                edge = C.gather_spans(np.arange(len(self.edge)), self.begin[state], count)
                own = np.repeat(np.arange(len(state)), count)
                more = [query[own], self.to[edge], number[own] + self.before[edge]]
                pool = [np.concatenate(x) for x in zip(pool, more)]  # a letter put in
                if i == length:
                    break
                other = (self.edge[edge] & 255) != codes[query[own], i]
                after = [np.concatenate((x[other], y)) for x, y in zip(more, (query, state, number))]  # replaced, or left out
                at, there = self.step(pool[1], codes[pool[0], i])
                at = at[there]
                pool = [np.concatenate((x, y)) for x, y in zip(after, (pool[0][there], self.to[at], pool[2][there] + self.before[at]))]
            at, there = self.step(state, codes[query, i])
            at = at[there]
            query, state, number = query[there], self.to[at], number[there] + self.before[at]
        done = self.final[pool[1]]
        both = np.unique(pool[0][done] * (1 << 32) + pool[2][done])
        return both >> 32, both & 0xFFFFFFFF


# ------------------------------------------------------------------ blocks
def _codes(words: list[bytes], wide: int) -> np.ndarray:
    return np.array(words, dtype=f"S{wide}").view(np.uint8).reshape(len(words), wide)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters that rows share from their start."""
    wide = min(a.shape[1], b.shape[1])
    return np.cumprod((a[:, :wide] == b[:, :wide]) & (a[:, :wide] != 0), axis=1, dtype=np.int32).sum(1, dtype=np.int64)


def _pairs(index: list[bytes], asked: list[bytes], length: int, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``asked`` and in the sorted, distinct ``index`` of the pairs that this direction has to find."""
    half = length // 2
    exact = length - half if back else half
    lengths = np.array([len(w) for w in index], np.int64)
    if length > LONG:
        queries, found = [], []
        for q, word in enumerate(asked):
            for x, other in enumerate(index):
                if abs(len(other) - length) < 2 and other != word and other[:exact] == word[:exact]:
                    short, tall = sorted((len(other), length))
                    fore = next((i for i in range(short) if other[i] != word[i]), short)
                    if other[fore + 1 - (len(other) < length) :] == word[fore + 1 - (length < len(other)) :]:
                        queries.append(q)
                        found.append(x)
        query, number = np.array(queries, np.int64), np.array(found, np.int64)
    else:
        wide = int(max(length, lengths.max())) + 1
        codes, own = _codes(index, wide), _codes(asked, wide)
        query, number = Automaton(codes, lengths).near(own, length, exact)
    if back and len(query):  # what shares the first half is found forward
        ahead = np.fromiter((asked[q][::-1][:half] != index[x][::-1][:half] for q, x in zip(query.tolist(), number.tolist())), bool, len(query))
        query, number = query[ahead], number[ahead]
    return query, number


def _found(rows: pa.Table, length: int, back: bool) -> tuple[list, list, list, list]:
    """Per word that was asked and has near words here: their number, and the best of them."""
    words = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
    if back:
        words = [w[::-1] for w in words]
    counts = rows.column("n").to_pylist()
    held = {w: n for w, n, keep in zip(words, counts, rows.column("held").to_pylist()) if keep}
    asked = sorted({w for w, ask in zip(words, rows.column("asked").to_pylist()) if ask})
    if not held or not asked:
        return [], [], [], []
    index = sorted(held)
    n_of = np.array([held[w] for w in index], np.int64)
    text = [(w[::-1] if back else w).decode("latin-1") for w in index]
    place = np.empty(len(index), np.int64)  # in the order of the words as read forward
    place[sorted(range(len(index)), key=text.__getitem__)] = np.arange(len(index))
    out: tuple[list, list, list, list] = ([], [], [], [])
    for at in range(0, len(asked), BLOCK):
        some = asked[at : at + BLOCK]
        query, number = _pairs(index, some, length, back)
        if not len(query):
            continue
        order = np.lexsort((place[number], -n_of[number], query))
        query, number = query[order], number[order]
        lead = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        out[0].extend((w[::-1] if back else w).decode("latin-1") for w in (some[q] for q in query[lead].tolist()))
        out[1].extend(np.diff(np.append(lead, len(query))).tolist())
        out[2].extend(text[i] for i in number[lead].tolist())
        out[3].extend(n_of[number[lead]].tolist())
    return out


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n in parts over columns word and n: forward and backward, and by part of a hot key.

    ``form`` is the near word of the largest n in its part; the parts of a word
    have no near word in common.
    """
    size = F.length("word")
    each = words.select("word", "n", size.alias("size"), F.explode(F.sequence(F.greatest(size - 1, F.lit(1)), size + 1)).alias("letters")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    half = F.floor(F.col("letters") / 2).cast("int")
    part = F.when(F.col("back"), F.reverse("word").substr(F.lit(1), F.col("letters") - half)).otherwise(F.col("word").substr(F.lit(1), half))
    keyed = each.select("word", "n", "letters", "back", F.xxhash64("letters", "back", part).alias("key"), (F.col("letters") == F.col("size")).alias("asked"))
    hot = keyed.groupBy("key").count().where(F.col("count") > HOT).select("key", F.ceil(F.col("count") / HOT).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    salts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("asked"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    salted = keyed.join(hot, "key", "left").select("*", F.explode(salts).alias("salt")).select("word", "n", "letters", "back", "key", "salt", "asked", (F.col("parts").isNull() | (F.col("salt") == own)).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "n_near", "form", "form_n"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        pending: list[pa.RecordBatch] = []
        size = 0
        last: tuple | None = None

        def given() -> pa.RecordBatch:
            nonlocal pending, size
            out = _found(pa.Table.from_batches(pending), *last[:2])
            pending, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

        for batch in batches:
            keys = [np.asarray(batch.column(c).cast(pa.int64())) for c in ("letters", "back", "key", "salt")]
            rows = batch.num_rows
            fresh = np.ones(rows, bool)
            if rows:
                fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            begins = np.flatnonzero(fresh).tolist()
            from_row = 0
            for a in begins:
                now = tuple(int(k[a]) for k in keys)
                # long words go by key, others by blocks of keys of one length and direction
                if last is not None and now != last and (now[:2] != last[:2] or size + a - from_row >= max(1, min(BLOCK, (1 << 21) // (last[0] + 1))) or last[0] > LONG):
                    if a > from_row:
                        pending.append(batch.slice(from_row, a - from_row))
                    from_row = a
                    if pending:
                        yield given()
                last = now
            if rows > from_row:
                pending.append(batch.slice(from_row))
                size += rows - from_row
        if pending:
            yield given()
        C.release()

    tasks = C.tasks(words.sparkSession)
    placed = salted.repartition(tasks, "key", "salt").sortWithinPartitions("letters", "back", "key", "salt")
    return placed.mapInArrow(run, "word string, n_near long, form string, form_n long")


# ------------------------------------------------------------------- forms
def forms(words: DataFrame, share: int = SHARE) -> DataFrame:
    """word, n, n_near, form, form_n over columns word and n: the near word of the largest n, if that is ``share`` times the word's."""
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    parts = near_words(words).select("word", F.lit(None).cast("long").alias("n"), "n_near", "form", "form_n")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))))
    merged = own.unionByName(parts).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    far = -F.col("best.less") >= share * F.col("n")
    return merged.select("word", "n", "n_near", F.when(far, F.col("best.form")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """word, root over columns word and form, for words that have a form.

    Chains are halved by joins; counts at least double from word to form, so
    there are few steps and no circles.
    """
    links = C.stored(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = C.stored(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        C.discard(links)
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            return links


def grouped(docs: DataFrame, one_in: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n over all texts of columns doc_id and text."""
    words = C.stored(vocabulary(docs, one_in), "words")
    found = C.stored(forms(words), "forms")
    return found.join(roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(C.table(spark, sf_dir, "documents", "doc_id", "text"), 97)
