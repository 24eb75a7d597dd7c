"""Operator 5: WARC files, written and read back by a reader that salvages what damage leaves."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, staged, work_path

#: Bytes a task reads of a compressed file; members that start in its span are its own.
SPLIT, READ = 32 << 20, 1 << 20
#: Bytes of a member that are held inflated between its check and its records; a larger one is inflated again.
HELD = 4 << 20
_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/[01]\.\d+\r\n")
_RECORDS = "file string, start long, end long, kind string, uri string, record_id string, date string, page_id long, payload binary, inner_start long, inner_end long, inner_size long"


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """One WARC resource record, uncompressed. A null id, address or body leaves out its header or says so."""
    body = (html or "").encode("utf-8", "surrogatepass")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{url}")
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: text/html"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    head += ["WARC-Null-Payload: true"] * (html is None) + [f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _one_line(text: str) -> str:
    return re.sub(r"[\r\n%]", lambda m: f"%{ord(m[0]):02X}", text)


def _as_it_was(text: str) -> str:
    return re.sub(r"%(0D|0A|25)", lambda m: chr(int(m[1], 16)), text)


def member(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, body, length) of the record that data begins with; None if a check fails."""
    found = _VERSION.match(data)
    stop = data.find(b"\r\n\r\n")
    if not found or stop < 0:
        return None
    headers = {}
    for line in data[found.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.decode("utf-8", "replace").strip().lower()] = _decoded(value).strip()
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit() or "warc-type" not in headers:
        return None
    end = stop + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    body = data[stop + 4 : end]
    if any(_digest_holds(headers[name], body) is False for name in _digests(headers)):
        return None
    return headers, body, end + 4


def _decoded(value: bytes) -> str:
    try:
        return value.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return value.decode("utf-8", "replace")


def _digests(headers: dict[str, str]) -> list[str]:
    """The digests that are of the whole body; the payload of an HTTP message is a part of it that writers differ about."""
    http = headers.get("content-type", "").lower().startswith("application/http")
    return [n for n in ("warc-block-digest", *(() if http else ("warc-payload-digest",))) if n in headers]


def _digest_holds(value: str, body: bytes) -> bool | None:
    """Whether 'algorithm:base 32 or hex' is body's digest; None if the algorithm is not known."""
    algorithm, _, want = value.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in ("md5", "sha1", "sha256", "sha512"):
        return None
    got, want = hashlib.new(algorithm, body).digest(), want.strip()
    return want.lower() == got.hex() or want.upper().rstrip("=") == base64.b32encode(got).decode().rstrip("=")


def _page(headers: dict[str, str]) -> int | None:
    """Our own header as a long; null where it is none."""
    value = headers.get("warc-page-id", "")
    return int(value) if re.fullmatch(r"-?[0-9]{1,19}", value) and -(2**63) <= int(value) < 2**63 else None


class _Window:
    """Reads of a file by position, a buffer at a time."""

    def __init__(self, f, size: int) -> None:
        self.f, self.size, self.at, self.data = f, size, 0, b""

    def bytes(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        if not (self.at <= start and start + n <= self.at + len(self.data)):
            self.f.seek(start)
            self.at, self.data = start, self.f.read(min(max(n, READ), self.size - start))
        return self.data[start - self.at : start - self.at + n]

    def find(self, what: bytes, start: int, stop: int) -> int:
        """First place of `what` in [start, stop) or -1."""
        while start < stop:
            chunk = self.bytes(start, min(READ, stop - start + len(what) - 1))
            at = chunk.find(what)
            if at >= 0:
                return start + at if start + at < stop else -1
            if len(chunk) < len(what):
                return -1
            start += len(chunk) - len(what) + 1
        return -1


def _pieces(w: _Window, start: int) -> Iterator[tuple[bytes, int, bool]]:
    """(bytes, place in the file after them, whether the member ended there, sound) of a member as it inflates; after damage, what inflates before it."""
    # most members are one chunk: no state to go back to
    d, chunk = zlib.decompressobj(31), w.bytes(start, 1 << 14)
    try:
        got = d.decompress(chunk, READ)
        if d.eof:
            yield got, start + len(chunk) - len(d.unused_data), True
            return
    except zlib.error:
        pass
    d, at = zlib.decompressobj(31), start
    while chunk := w.bytes(at, 1 << 14):
        before, rest = d.copy(), chunk
        try:
            while True:
                got = d.decompress(rest, READ)
                rest = d.unconsumed_tail
                done = at + len(chunk) - len(d.unused_data) - len(rest)
                before = None if got else before
                yield got, done, d.eof
                if d.eof:
                    return
                if not rest and len(got) < READ:
                    break
        except zlib.error:
            # the damage is in chunk[a:b]
            a, b = 0, len(chunk) if before else 0
            while b - a > 1:
                middle, trial = (a + b) // 2, before.copy()
                try:
                    got = trial.decompress(chunk[a:middle])
                except zlib.error:
                    b = middle
                    continue
                before, a = trial, middle
                yield got, at + a, False
            return
        at += len(chunk)


def _records(pieces: Iterator[bytes], proven: bool) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(first byte, end, headers, body) of the sound records of an inflated member, past damaged ones.

    Of a member whose checksum does not hold (not proven) a record must have its own.
    """
    data, base, over, need, seen = bytearray(), 0, False, 0, 0
    while True:
        while not over and len(data) < need:
            piece = next(pieces, None)
            over = piece is None
            data += piece or b""
        at = data.find(b"WARC/")
        if at < 0:
            if over:
                return
            cut = max(0, len(data) - 4)
            del data[:cut]
            base, need, seen = base + cut, len(data) + 1, 0
            continue
        if at:
            del data[:at]
            base, seen = base + at, 0
        stop = data.find(b"\r\n\r\n", seen) if over or _VERSION.match(data) or len(data) < 16 else 0
        if stop < 0 and not over:
            need, seen = len(data) + 1, max(0, len(data) - 3)
            continue
        m = re.search(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", data[: stop + 2], re.I) if stop > 0 else None
        if m and not over and len(data) < stop + 8 + int(m[1]):
            need = stop + 8 + int(m[1])
            continue
        r = parse(bytes(data[: stop + 8 + int(m[1])])) if m else None
        if r and (proven or any(_digest_holds(r[0][n], r[1]) for n in _digests(r[0]))):
            yield base, base + r[2], r[0], r[1]
        cut = r[2] if r else 1
        del data[:cut]
        base, need, seen = base + cut, 1, 0


def _print(headers: dict[str, str], body: bytes) -> bytes:
    """What tells a record: a torn one may have headers of its own before those of the record that it runs into."""
    named = [headers.get(n) for n in ("warc-type", "warc-record-id", "warc-target-uri", "warc-date")]
    return hashlib.sha256(repr(named).encode("utf-8", "surrogatepass") + body).digest()


def _members_within(w: _Window, at: int, end: int) -> tuple[int, set[bytes]]:
    """(inflated bytes of the damaged member at `at` before the first sound member within it, prints of the records of all such members).

    Where a writer died and tried again, the torn member inflates on into the next one, and may come in step with it.
    """
    first, found, place = end, set(), at + 1
    while (place := w.find(_MEMBER, place, end)) >= 0:
        stop, sound = place, False
        for _, stop, sound in _pieces(w, place):
            pass
        if sound:
            first = min(first, place)
            found.update(_print(headers, body) for _, _, headers, body in _records((p[0] for p in _pieces(w, place)), True))
        place = stop if sound else place + 1
    if not found:
        return 0, found
    d, own = zlib.decompressobj(31), 0
    for place in range(at, first, 1 << 14):
        rest = w.bytes(place, min(1 << 14, first - place))
        try:
            while rest:
                own += len(d.decompress(rest, READ))
                rest = d.unconsumed_tail
        except zlib.error:
            break
    return own, found


def salvage(w: _Window, start: int, stop: int, packed: bool) -> Iterator[tuple[int, int, int, int, int | None, dict[str, str], bytes]]:
    """(start, end, inner start, inner end, inner size, headers, body) of the sound records that begin in [start, stop).

    The inner places are in the inflated member, whose size is null if it is damaged; what a damaged member only
    repeats of a sound one that it runs into is that one's. After a failed check
    the search goes on for the next version line, within a member too, or one byte after the failed
    record's or member's beginning for the next gzip member.
    """
    at = start
    while at < stop:
        at = w.find(_MEMBER if packed else b"WARC/", at, stop)
        if at < 0:
            return
        end, some = at + 1, False
        if packed:
            # once for the checksum, once for the records: neither holds more than HELD of the member
            size, sound, held = 0, False, []
            for got, end, sound in _pieces(w, at):
                size += len(got)
                if size <= HELD:
                    held.append(got)
            inflated = iter(held) if size <= HELD else (p[0] for p in _pieces(w, at))
            own, later = None, set()
            for a, b, headers, body in _records(inflated, sound) if size else ():
                if not sound:
                    if own is None:
                        own, later = _members_within(w, at, end)
                    if b > own and _print(headers, body) in later:
                        continue
                yield at, end, a, b, size if sound else None, headers, body
                some = sound
        else:
            head = w.find(b"\r\n\r\n", at, w.size) if _VERSION.match(w.bytes(at, 32)) else -1
            m = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", w.bytes(at, head + 4 - at), re.I) if head > 0 else None
            data = w.bytes(at, head - at + 8 + int(m[1])) if m and int(m[1]) <= w.size else b""
            if data and (r := parse(data)):
                end = at + r[2]
                yield at, end, 0, r[2], r[2], r[0], r[1]
                some = True
        at = end if some else at + 1


def _splits(spark: SparkSession, path: str) -> DataFrame:
    fs, base = pa.fs.FileSystem.from_uri(path)
    files = [i for i in fs.get_file_info(pa.fs.FileSelector(base, recursive=True, allow_not_found=True)) if i.is_file] if fs.get_file_info(base).type != pa.fs.FileType.File else [fs.get_file_info(base)]
    head = path[: len(path) - len(base)] if path.endswith(base) else path.split("://")[0] + "://"
    rows = []
    for i in sorted(files, key=lambda i: i.path):
        if i.base_name.startswith(("_", ".")) or not (i.path.endswith((".warc", ".warc.gz"))):
            continue
        step = SPLIT if i.path.endswith(".gz") else max(1, i.size)
        rows += [(head + i.path, a, min(a + step, i.size), i.size) for a in range(0, i.size, step)]
    df = spark.createDataFrame(rows, "file string, start long, stop long, size long")
    return df.repartition(max(1, len(rows)), "file", "start") if rows else df


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each sound record below path (*.warc.gz, *.warc).

    file, start, end (bytes in the file), kind, uri, record_id, date, page_id (our own header, else
    null, also if it is no long), payload (null if the record says so), headers that are not UTF-8 with
    replacement characters; a record whose block digest (or payload digest, but for HTTP messages) fails is
    quarantined, inner_start, inner_end, inner_size (see salvage). Compressed files are read in splits: a record belongs
    to the split its member begins in. Uncompressed files are read by one task each, since a payload may
    itself hold version lines. Empty files and folders give no rows; headers that repeat keep the last.
    Without payloads that column is null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload", pa.binary()), *((c, pa.int64()) for c in ("inner_start", "inner_end", "inner_size"))])
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = pa.fs.FileSystem.from_uri(row["file"])
                rows, held = [], 0
                with fs.open_input_file(name) as f:
                    for start, end, a, b, inner, h, body in salvage(_Window(f, row["size"]), row["start"], row["stop"], name.endswith(".gz")):
                        uri = h.get("warc-target-uri")
                        rows.append({"file": row["file"], "start": start, "end": end, "kind": h["warc-type"], "uri": None if uri is None else _as_it_was(uri), "record_id": h.get("warc-record-id"), "date": h.get("warc-date"), "page_id": _page(h), "payload": None if "warc-null-payload" in h or not payloads else body, "inner_start": a, "inner_end": b, "inner_size": inner})
                        held += len(body) if payloads else 64
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return _splits(spark, path).mapInArrow(read, _RECORDS)


def gaps(records: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """file, start, end: byte ranges of the files that no sound record covers, the quarantine log.

    next_id is the page_id of the record after the gap, null for a gap that ends its file or member. For a
    gap within a member, start and end are the member's, inner_start and inner_end the range in it
    inflated, without an end where the damage hides it; else these are null.
    """
    w = Window.partitionBy("file").orderBy("start", "end")
    spans = records.groupBy("file", "start", "end").agg(F.min("page_id").alias("page_id"))
    before = spans.withColumn("from", F.coalesce(F.lag("end").over(w), F.lit(0))).filter("start > from").select("file", F.col("from").alias("start"), F.col("start").alias("end"), F.col("page_id").alias("next_id"))
    sizes = _splits(spark, path).groupBy("file").agg(F.max("size").alias("size"))
    last = spans.groupBy("file").agg(F.max("end").alias("done"))
    tail = sizes.join(last, "file", "left").withColumn("done", F.coalesce("done", F.lit(0))).filter("done < size").select("file", F.col("done").alias("start"), F.col("size").alias("end"), F.lit(None).cast("long").alias("next_id"))
    inside = Window.partitionBy("file", "start", "end").orderBy("inner_start")
    done, following = F.coalesce(F.lag("inner_end").over(inside), F.lit(0)), F.lead("inner_start").over(inside)
    placed = records.select("file", "start", "end", "page_id", "inner_start", "inner_end", "inner_size", done.alias("done"), following.alias("following"))
    inner = placed.filter("inner_start > done").select("file", "start", "end", F.col("page_id").alias("next_id"), F.col("done").alias("inner_start"), F.col("inner_start").alias("inner_end"))
    ends = placed.filter("following IS NULL AND (inner_size IS NULL OR inner_end < inner_size)").select("file", "start", "end", F.lit(None).cast("long").alias("next_id"), F.col("inner_end").alias("inner_start"), F.col("inner_size").alias("inner_end"))
    none = [F.lit(None).cast("long").alias(c) for c in ("inner_start", "inner_end")]
    return before.unionByName(tail).select("*", *none).unionByName(inner).unionByName(ends)


def write_warc(pages: DataFrame, path: str, torn_before: str | None = None) -> DataFrame:
    """Writes page_id, url, html as .warc.gz files, one a partition and a member a record; file, records of each.

    torn_before: a predicate over pages; where it holds, half of the record's member goes before the
    whole one, as a writer leaves that dies and tries again.
    """
    torn = F.expr(torn_before) if torn_before else F.lit(False)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        # named by partition, so that a task run twice leaves one file
        n, temporary, name = 0, f"{base}/.{uuid.uuid4().hex}", None
        part = TaskContext.get().partitionId()
        with fs.open_output_stream(temporary, compression=None) as out:
            for batch in batches:
                for page_id, url, html, cut in zip(*(c.to_pylist() for c in batch.columns)):
                    data = member(record(page_id, url, html))
                    out.write((data[: len(data) // 2] if cut else b"") + data)
                    n += 1
        if n:
            name = f"{base}/part-{part:05d}.warc.gz"
            fs.move(temporary, name)
        else:
            fs.delete_file(temporary)
        yield pa.RecordBatch.from_arrays([pa.array([name] if n else [], pa.string()), pa.array([n] if n else [], pa.int64())], names=["file", "records"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.coalesce(torn, F.lit(False)).alias("torn"))
    return rows.mapInArrow(write, "file string, records long")


def round_trip(pages: DataFrame, torn_before: str | None = None) -> DataFrame:
    """page_id, url, html, gaps_before of every page, written to WARC and read back; gaps_before counts quarantined ranges.

    Nulls, empty and very long pages and repeated rows come back as they were; an empty table gives no
    rows. Other columns, whatever their names, are not read.
    """
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write_warc(pages, path, torn_before).agg(F.sum("records")).collect()
    # spans alone are kept for the gap log; bodies are read again rather than stored twice
    spans = staged(read_warc(spark, path, payloads=False).select("file", "start", "end", "page_id", "inner_start", "inner_end", "inner_size"), "warc-spans")
    records = read_warc(spark, path)
    torn = gaps(spans, spark, path).filter("next_id IS NOT NULL AND inner_start IS NULL").groupBy("file", F.col("end").alias("start")).agg(F.count("*").alias("gaps_before"))
    return records.join(torn, ["file", "start"], "left").select("page_id", F.col("uri").alias("url"), F.col("payload").cast("string").alias("html"), F.coalesce("gaps_before", F.lit(0)).cast("long").alias("gaps_before"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC files in which every 16th record is preceded by its own torn half."""
    return round_trip(documents(spark, sf_dir, "pages"), "page_id % 16 = 0")


OP5_SQL = "SELECT page_id, url, html, CASE WHEN page_id % 16 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS gaps_before FROM pages"
