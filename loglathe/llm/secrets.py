"""Secret scans: patterns, and character Markov models of random strings against ordinary words.

A first pass over the texts finds the base patterns' spans and the pair counts
of two first-order character models: random strings, learnt from the values
that those patterns label as secrets, and ordinary words and identifiers, learnt
from the words, without those values.  The counts are two fixed tables.  A
second pass scores every run of the models' characters, LEAST_LENGTH or longer,
that lies outside the base spans (also what a base span leaves of a run): a run
whose log-likelihood ratio is over the thresholds is a further secret, of kind
markov.

Defined results: null and empty texts have no spans; spans are in code points,
end exclusive; very long texts are scanned whole; equal texts get equal spans;
where no pattern finds a value, the random model is the uniform one; tables
without rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

KINDS = ("assign", "access", "hex", "markov")
#: The patterns of the base kinds.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"

#: Characters of a run, and log-likelihood ratio (natural) of a run and a character of it, from which it is a secret.
LEAST_LENGTH, LEAST_RATIO, LEAST_EACH = 12, 14.0, 0.3
#: Share of the uniform distribution in what backs the random model; counts that the backing distributions are worth (more for ordinary words, so that a secret's own few pairs among them weigh little).
UNIFORM, BACKING = 0.5, (20, 200)

N = len(ALPHABET) + 2  # another character, and the edge of a string
OTHER, EDGE = N - 2, N - 1
CODE = np.full(256, OTHER, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
#: Characters of runs: a full stop ends sentences and file names.
IN_RUN = (CODE < OTHER) & (np.arange(256) != ord("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pair_counts(strings: list[bytes], edges: bool = True) -> np.ndarray:
    """How often each character follows each, with an edge before and after each string."""
    counts = np.zeros(N * N, np.int64)
    if strings:
        edge = b"\x00"
        s = CODE[np.frombuffer(edge + edge.join(strings) + edge, np.uint8)]
        at = np.cumsum([0, *(len(x) + 1 for x in strings)])
        s[at] = EDGE
        counts += np.bincount(s[:-1] * N + s[1:], minlength=N * N)
        if not edges:
            counts.reshape(N, N)[EDGE, :] = counts.reshape(N, N)[:, EDGE] = 0
    return counts


FOUND = "base string, secret binary, ordinary binary"


def find(df: DataFrame, through: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``through`` and base spans; and once a task, with those columns null, the two tables of pair counts."""

    schema = C.with_columns(df, through, FOUND)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        secret, ordinary = np.zeros(N * N, np.int64), np.zeros(N * N, np.int64)
        kinds = None
        for batch in C.chunks(batches):
            data, offs = C.buffers(batch.column("text"))
            starts, ends, _ = C.words(data, offs)
            s = CODE[data]
            inside = C._IN_WORD[data].astype(bool)
            begin = np.zeros(len(data) + 1, bool)
            begin[starts] = True
            pair = inside[1:] & inside[:-1] & ~begin[1:-1]
            ordinary += np.bincount(s[:-1][pair] * N + s[1:][pair], minlength=N * N)
            ordinary += np.bincount(EDGE * N + s[starts], minlength=N * N)
            ordinary += np.bincount(s[ends - 1] * N + EDGE, minlength=N * N)
            base, values = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append(joined(spans))
                for kind, a, b in spans:
                    values.append((ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]).encode())
            secret += pair_counts(values)
            ordinary -= pair_counts(values, edges=False)  # these were counted as words
            kinds = [batch.schema.field(c).type for c in through]
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in through), pa.array(base), none, none], [*through, "base", "secret", "ordinary"])
        if kinds is not None:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.nulls(1, pa.string()), pa.array([secret.tobytes()]), pa.array([np.maximum(ordinary, 0).tobytes()])], [*through, "base", "secret", "ordinary"])

    return df.select(*through).mapInArrow(run, schema)


def add_tables(df: DataFrame) -> DataFrame:
    """The sums of the tables, partly summed in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(N * N, np.int64), np.zeros(N * N, np.int64)]
        for batch in batches:
            for t, name in zip(total, ("secret", "ordinary")):
                for raw in batch.column(name).to_pylist():
                    t += np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()]) for t in total], ["secret", "ordinary"])

    return df.select("secret", "ordinary").mapInArrow(run, "secret binary, ordinary binary")


def model(secret: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each character after each."""
    logs = []
    for counts, uniform, backing in ((secret, UNIFORM, BACKING[0]), (ordinary, 0.0, BACKING[1])):
        c = counts.reshape(N, N).astype(float)
        # what follows any character backs what follows this one
        back = (1 - uniform) * (c.sum(0) + 1) / (c.sum() + N) + uniform / N
        p = (c + backing * back) / (c.sum(1, keepdims=True) + backing)
        logs.append(np.log(p))
    return logs[0] - logs[1]


def further(data: np.ndarray, offs: np.ndarray, taken: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions (start, end) of the runs outside ``taken`` bytes that are likelier random than ordinary; runs never cross texts."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = IN_RUN[data] & ~taken
    border = np.zeros(n + 1, bool)
    border[offs] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1] & ~border[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | border[1:])) + 1
    long = ends - starts >= LEAST_LENGTH
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return starts, ends
    s = CODE[data]
    sums = np.zeros(n, np.float64)
    np.cumsum(ratio[s[:-1], s[1:]], out=sums[1:])
    total = sums[ends - 1] - sums[starts] + ratio[EDGE, s[starts]] + ratio[s[ends - 1], EDGE]
    found = (total >= LEAST_RATIO) & (total >= LEAST_EACH * (ends - starts))
    return starts[found], ends[found]


def parsed(spans: str | None) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in (spans or "").split(",") if x)]


def scan(df: DataFrame, through: tuple[str, ...] = ("doc_id",), replace: bool = False) -> DataFrame:
    """The columns ``through``, n_assign, n_access, n_hex, n_markov, base_sha256, spans (joined as kind:start:end).

    With ``replace`` only the columns ``through``, every secret of ``text`` replaced:
    in the same worker, as a second one a task would hold the texts once more.
    """
    carried = tuple(dict.fromkeys([*through, "text"]))
    found = C.stored(find(df, carried), "spans")
    tables = add_tables(found.where("secret is not null").coalesce(C.tasks(df.sparkSession))).toArrow()
    total = [np.zeros(N * N, np.int64), np.zeros(N * N, np.int64)]
    for t, name in zip(total, ("secret", "ordinary")):  # one fixed table a task
        for raw in tables.column(name).to_pylist():
            t += np.frombuffer(raw, np.int64)
    ratio = model(*total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches):
            data, offs = C.buffers(batch.column("text"))
            lead = np.flatnonzero((data & 0xC0) != 0x80)  # bytes that begin a character
            chars = np.searchsorted(lead, offs)
            place = np.append(lead, len(data))
            own = [parsed(b) for b in batch.column("base").to_pylist()]
            edge = np.zeros(len(data) + 1, np.int64)
            for i, spans in enumerate(own):
                for _, a, b in spans:
                    edge[place[chars[i] + a]] += 1
                    edge[place[chars[i] + b]] -= 1
            starts, ends = further(data, offs, np.cumsum(edge[:-1]) > 0, ratio)
            text = np.searchsorted(offs, starts, side="right") - 1
            a, b = np.searchsorted(lead, starts) - chars[text], np.searchsorted(lead, ends) - chars[text]
            for i, x, y in zip(text.tolist(), a.tolist(), b.tolist()):
                own[i].append(("markov", x, y))
            spans, counts = [], np.zeros((len(own), len(KINDS)), np.int64)
            for i, mine in enumerate(own):
                mine.sort(key=lambda x: (x[1], KINDS.index(x[0])))
                spans.append(joined(mine))
                for kind, _, _ in mine:
                    counts[i, KINDS.index(kind)] += 1
            if replace:
                texts = pa.array([redact(t, s) for t, s in zip(batch.column("text").to_pylist(), spans)], pa.string())
                yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(c) for c in through], list(through))
                continue
            sha = [hashlib.sha256((x or "").encode()).hexdigest() for x in batch.column("base").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in through), *(pa.array(counts[:, i]) for i in range(len(KINDS))), pa.array(sha), pa.array(spans, pa.string())], [*through, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kinds = "" if replace else "n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"
    return found.where("secret is null").select(*carried, "base").mapInArrow(run, C.with_columns(found, through, kinds))


def redacted(df: DataFrame) -> DataFrame:
    """The same table with every secret in ``text`` replaced, and n_chars as it is then."""
    columns = tuple(df.columns)
    out = scan(df, columns, replace=True)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns) if "n_chars" in columns else out


def redact(text: str | None, spans: str, mark: str = "[SECRET]") -> str | None:
    """The text with each span (overlapping ones together) replaced."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in spans.split(","))):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents", "doc_id", "text"))
