"""WARC archives with a two-level capture index.

Each task writes its pages as gzip-compressed records into archives of its own
in the shared folder; captures are keyed by reversed host and path.  The index
is sorted by key over all tasks into compressed blocks of lines; a sparse
directory keeps each block's first and last key, place and length.  Readers take
keys in order, a task a range of them: it reads the part of the directory that
its keys can be in, searches that by halving, reads the blocks' ranges, searches
their lines by halving, and the records' ranges follow.

Files are written by pyarrow's file systems under names of their own for each
attempt; only those that a finished task reports are in the index, so a lost
executor leaves at most files that nothing refers to.

Of pages with equal payloads of LEAST bytes or more, the smallest page_id is
stored and the others are revisits that refer to it and carry no payload.

Defined results: a null html is an empty payload; a null url has the key of no
host and no target; characters of a url that a key or header can't hold are
percent-quoted, in host and path; a null page_id is always a response; rows that repeat a
page_id and payload are stored once each, as the kind that the page_id has;
payloads may be of any length; tables without rows give no rows; extra columns
are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Payload bytes from which equal ones are stored once; lines of an index block; bytes after which a task starts another archive; bytes between ranges that are read at once.
LEAST, LINES, ARCHIVE_BYTES, GAP = 100, 3000, 512 << 20, 64 << 10
LEVEL = 3


def url_key(url: str | None) -> str:
    """com,example,www)/path?query: host labels reversed, lower case, without scheme, user, default port and fragment."""
    if not url:
        return ")/"
    m = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", url)
    if not m:
        return ")/" + quote(url.split("#")[0], safe="/?&=%;,:@+$!*'()~[]")
    scheme, host, port, rest = m.groups()
    if port in ("80", "443", "", None):
        port = ""
    else:
        port = ":" + port
    labels = quote(",".join(reversed(host.lower().strip(".").split("."))), safe="!$&'()*+,;=~[]%")
    return f"{labels}{port})" + quote(rest if rest.startswith("/") else "/" + rest, safe="/?&=%;,:@+$!*'()~[]")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of which only the headers of the response are kept."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe="/?&=%;,:@+$!*'()~#[]"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record; a response's are taken from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(x) if (x := fields[name][len("<urn:page:") : -1]) else None
    if fields["WARC-Type"] == "response":
        return {"page_id": number("WARC-Record-ID"), "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "record_type": "response", "refers_to": None, "payload": payload}
    size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    return {"page_id": number("WARC-Record-ID"), "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "record_type": "revisit", "refers_to": number("WARC-Refers-To"), "payload": None}


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    return system, path


CAPTURE = "key string, page_id long, kind string, file string, offset long, length long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Captures (CAPTURE) of all pages (page_id, url, html), written into ``folder``."""
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    sized = pages.select("page_id", "url", "html", digest.alias("digest"))
    large = sized.where(F.octet_length("html") >= LEAST).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").select("digest", "refers_to")
    revisits = C.stored(large.join(first, "digest").where("page_id <> refers_to").distinct(), "revisits")
    rows = sized.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        name, out, at = None, None, 0
        try:
            for batch in batches:
                found = []
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    raw = gzip.compress(record(page_id, url, (html or "").encode(), digest, refers_to), LEVEL, mtime=0)
                    out.write(raw)
                    found.append((url_key(url), page_id, "response" if refers_to is None else "revisit", name, at, len(raw)))
                    at += len(raw)
                if found:
                    yield _captures(found)
        finally:
            if out:
                out.close()

    return C.stored(rows.mapInArrow(run, CAPTURE), "captures")


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["key", "page_id", "kind", "file", "offset", "length"])


DIRECTORY = "first string, last string, file string, offset long, length long, lines long"


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """The directory: a row for each block of sorted index lines, written into ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        name, out, at, held = f"{uuid.uuid4().hex}.idx", None, 0, []
        done = []

        def block(rows: list[tuple]) -> int:
            text = "".join("\t".join("" if v is None else str(v) for v in r) + "\n" for r in rows)
            raw = gzip.compress(text.encode(), LEVEL, mtime=0)
            out.write(raw)
            done.append((rows[0][0], rows[-1][0], name, at, len(raw), len(rows)))
            return len(raw)

        try:
            for batch in batches:
                if out is None and batch.num_rows:
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                held += zip(*(c.to_pylist() for c in batch.columns))
                while len(held) >= LINES:
                    at += block(held[:LINES])
                    held = held[LINES:]
            if held:
                at += block(held)
        finally:
            if out:
                out.close()
        if done:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], ["first", "last", "file", "offset", "length", "lines"])

    n = C.tasks(captures.sparkSession)
    ordered = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    return C.stored(ordered.mapInArrow(run, DIRECTORY), "directory")


def _lines(raw: bytes) -> list[tuple]:
    out = []
    for line in gzip.decompress(raw).decode().split("\n")[:-1]:
        key, page_id, kind, file, offset, length = line.split("\t")
        out.append((key, int(page_id) if page_id else None, kind, file, int(offset), int(length)))
    return out


def blocks_of(firsts: list[str], lasts: list[str], keys: list[str]) -> dict[int, list[str]]:
    """The blocks that can hold each key, by halving: blocks are in order, and keys that occur often can fill several."""
    found: dict[int, list[str]] = {}
    for k in keys:
        for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k)):
            found.setdefault(i, []).append(k)
    return found


def keys_of(pages: DataFrame) -> DataFrame:
    """The distinct keys (column key) of the column url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({url_key(u) for u in batch.column("url").to_pylist()}), pa.string())], ["key"])

    return pages.select("url").mapInArrow(run, "key string").distinct()


def read_index(directory: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """Captures that the index holds of the given keys (column key).

    ``directory`` is a stored table; a task opens its files by itself and reads
    the rows between its first and last key only.
    """
    files = [*directory.inputFiles()]
    place = C.shared_dir(directory.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        home, _ = _open(place)
        part = dataset.dataset([_open(x)[1] for x in files], filesystem=home, format="parquet") if files else None
        held, rows = None, []
        for batch in batches:
            wanted = [k for k in batch.column("key").to_pylist() if k is not None]
            if not wanted or part is None:
                continue
            near = part.to_table(filter=(dataset.field("first") <= wanted[-1]) & (dataset.field("last") >= wanted[0]))
            blocks = sorted(zip(*(near.column(c).to_pylist() for c in ("first", "last", "file", "offset", "length"))))
            here = blocks_of([b[0] for b in blocks], [b[1] for b in blocks], wanted)
            for i in sorted(here):
                if blocks[i] != held:
                    _, _, file, offset, length = held = blocks[i]
                    with system.open_input_file(f"{path}/{file}") as f:
                        rows = _lines(f.read_at(length, offset))
                    own = [r[0] for r in rows]
                found = [r for k in here[i] for r in rows[bisect.bisect_left(own, k) : bisect.bisect_right(own, k)]]
                if found:
                    yield _captures(found)

    n = C.tasks(keys.sparkSession)
    return keys.select("key").distinct().repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(run, CAPTURE)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(captures: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """READ (and payload, null for revisits) of each capture, archives read by ranges."""
    names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        name, f, buffer, low = None, None, b"", 0
        try:
            for batch in batches:
                rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
                found: list[dict] = []
                held = 0
                for i, (file, offset, length) in enumerate(rows):
                    if file != name:
                        if f:
                            f.close()
                        f, name, buffer = system.open_input_file(f"{path}/{file}"), file, b""
                    if offset < low or offset + length > low + len(buffer):
                        end = offset + length
                        for other, a, n in rows[i + 1 :]:  # near ranges are one
                            if other != file or a > end + GAP or a + n - offset > 4 << 20:
                                break
                            end = max(end, a + n)
                        buffer, low = f.read_at(end - offset, offset), offset
                    found.append(parse(zlib.decompress(buffer[offset - low : offset - low + length], 31)))
                    held += length
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], k) for c, k in zip(names, kinds)], names)
                        found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], k) for c, k in zip(names, kinds)], names)
        finally:
            if f:
                f.close()

    n = C.tasks(captures.sparkSession)
    # ranges of archives, not whole ones: a large archive is read by several tasks
    near = captures.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return near.mapInArrow(run, READ + ", payload binary" * payloads)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.new_path(spark, "archives")
    pages = C.table(spark, sf_dir, "pages", "page_id", "url", "html")
    directory = write_index(write_archives(pages, folder), folder)
    return read_records(read_index(directory, folder, keys_of(pages)), folder)
