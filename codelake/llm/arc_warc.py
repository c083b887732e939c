"""Legacy ARC archives converted to WARC/1.1, written and read back.

The converter takes ARC bytes with any number of records.  The version block of the archive names
the header fields; a record's header line is split by the fields of its version (1: URL, IP, date,
type, length; 2: also result code, checksum, location, offset, filename), and its payload is as long
as declared.  Each record gets an equivalent WARC identifier (a UUID from URI, date and digest, so a
second run gives the same one), an ISO timestamp from the 14 digits, a type and a SHA-1 digest.

Of records with equal payloads of ``min_bytes`` or more, the one with the largest key stays a
response, the others become revisits that refer to it; shorter payloads are always responses.

Every record is a gzip member of its own, so a reader can begin at any of them; tasks write files that
are closed at ``bytes_per_file`` bytes, under names of their own, and list them in a table.  Only the
files listed by tasks that Spark has committed are read, so what a lost task has left behind counts
for nothing.  Reading streams: one record at a time, by declared lengths, so payloads may hold
anything, record ends included.  Types are decided on keys, digests and lengths alone.

Edge cases: null payloads count as empty; a null URL becomes about:blank, and bytes that a header line
cannot hold are percent-encoded as UTF-8; equal rows are converted alike; an ARC record whose declared
length passes the end, or whose header doesn't parse, ends the archive, and the rest becomes one row
with ``error`` set; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem_of, fresh_path, materialise

#: Fixed values of the format: header fields by ARC version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
_CRLF = "\r\n"
_RECORD_END = "\r\n\r\n"
_KEY_MARK = "#record="


def arc_blob(key: Column, url: Column, payload: Column, captured: Column, version: Column) -> Column:
    """One ARC archive of one record, as bytes."""
    fields = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    block = {v: f"{v} 0 codelake\n{names}\n" for v, names in fields.items()}
    head = lambda v: f"filedesc://pages.arc 0.0.0.0 20000101000000 text/plain {'200 - - 0 pages.arc ' * (v == 2)}{len(block[v])}\n{block[v]}\n"
    size = F.octet_length(payload).cast("string")
    line = lambda middle: F.concat(url, F.lit(_KEY_MARK), key, F.lit(" 0.0.0.0 "), captured, F.lit(" text/html "), F.lit(middle), size, F.lit("\n"))
    first = F.when(version == 1, F.concat(F.lit(head(1)), line(""))).otherwise(F.concat(F.lit(head(2)), line("200 - - 0 pages.arc ")))
    return F.concat(first.cast("binary"), payload.cast("binary"), F.lit(b"\n"))


def parse_arc(blob: bytes) -> Iterator[dict]:
    """The records of an archive; ``error`` is set where it can't be read on."""
    at, version = 0, 1
    while at < len(blob):
        end = blob.find(b"\n", at)
        line = blob[at : end if end >= 0 else len(blob)].decode("utf-8", "replace").rstrip("\r")
        if not line:
            at = end + 1 if end >= 0 else len(blob)
            continue
        parts = line.split(" ")
        is_head = line.startswith("filedesc:")
        if is_head:
            mark = blob[end + 1 : end + 2]
            version = int(mark) if mark in (b"1", b"2") else 0
        names = ARC_FIELDS.get(version, ())
        if end < 0 or len(parts) != len(names) or not parts[-1].isdigit() or end + 1 + int(parts[-1]) > len(blob):
            yield {"error": f"record at byte {at} can't be read"}
            return
        record = dict(zip(names, parts, strict=True))
        at = end + 1 + int(record["length"])
        if not is_head:
            yield record | {"payload": blob[end + 1 : at], "error": None}


def warc_identity(uri: str, date: str, digest: str) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{uri} {date} {digest}'.encode()).digest()[:16], version=5)}"


def warc_date(digits: str) -> str:
    """Fourteen digits (fewer are filled up) as an ISO timestamp."""
    d = (digits + "00000101000000"[len(digits) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


_CONVERTED = "target_uri string, warc_date string, content_type string, ip string, record_id string, payload binary, payload_bytes long, digest string, error string"


def convert(archives: DataFrame, blob_col: str = "arc") -> DataFrame:
    """One row per ARC record with its WARC fields."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _CONVERTED.split(", ")]
        for frame in frames:
            rows = []
            for blob in frame[blob_col]:
                for r in parse_arc(bytes(blob or b"")):
                    if r["error"]:
                        rows.append((None,) * 8 + (r["error"],))
                        continue
                    digest, date = hashlib.sha1(r["payload"]).hexdigest(), warc_date(r["date"])
                    rows.append((r["url"], date, r["type"], r["ip"], warc_identity(r["url"], date, digest), r["payload"], len(r["payload"]), digest, None))
            yield pd.DataFrame(rows, columns=names)

    return archives.select(blob_col).mapInPandas(run, _CONVERTED)


def assign_types(records: DataFrame, key: Column, min_bytes: int) -> DataFrame:
    """Adds record_type and the identity of the record that a revisit refers to."""
    keyed = records.withColumn("__key", key)
    me = F.struct(F.col("__key"), F.col("target_uri"), F.col("record_id"), F.col("warc_date"))
    large = F.col("payload_bytes") >= min_bytes
    found = keyed.where(large).select("digest", me.alias("me")).groupBy(F.col("digest").alias("__digest")).agg(F.max("me").alias("first"), F.count("*").alias("n"))
    first = materialise(found.where("n > 1").select("__digest", "first"), "firsts")
    revisit = F.col("first").isNotNull() & ~F.col("__key").eqNullSafe(F.col("first.__key"))
    joined = keyed.join(first.hint("shuffle_hash"), (F.col("digest") == F.col("__digest")) & large, "left")  # payloads move, but are not sorted
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers", F.when(revisit, F.col("first"))).drop("__key", "__digest", "first")


def write_warc(records: DataFrame, path: str, bytes_per_file: int = 64_000_000) -> DataFrame:
    """Write the records as WARC files; file, records and bytes of each.  Revisits have an empty block and name what they refer to."""
    stored = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    header = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{_CRLF}{name}: "), value)).otherwise("")
    value = F.concat(
        F.lit("WARC/1.1"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        header("WARC-Date", F.col("warc_date")),
        header("WARC-Target-URI", F.col("target_uri")),
        header("WARC-IP-Address", F.col("ip")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        header("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers.record_id"), F.lit(">"))),
        header("WARC-Refers-To-Target-URI", F.col("refers.target_uri")),
        header("WARC-Refers-To-Date", F.col("refers.warc_date")),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        header("Content-Type", F.col("content_type")),
        header("Content-Length", F.octet_length(stored).cast("string")),
        F.lit(_RECORD_END),
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, root = filesystem_of(path)
        filesystem.create_dir(root, recursive=True)
        out, name, n, size, done = None, None, 0, 0, []
        for frame in frames:
            for head, block in frame.itertuples(index=False):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = filesystem.open_output_stream(f"{root}/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(head.encode() + block + _RECORD_END.encode()) + packer.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= bytes_per_file:
                    out.close()
                    out = done.append((name, n, size))
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pd.DataFrame(done, columns=["file", "records", "bytes"])

    made = records.where("error is null").select(value.alias("head"), stored.alias("block"))
    return materialise(made.mapInPandas(run, "file string, records long, bytes long"), "warc-files")


class _Bytes:
    """What a stream of gzip members holds, read in parts."""

    def __init__(self, stream):
        self.stream, self.packed, self.plain, self.unpacker = stream, b"", bytearray(), None

    def more(self) -> bool:
        if not self.packed:
            self.packed = self.stream.read(1 << 20)
        if not self.packed:
            return False
        if self.unpacker is None:
            self.unpacker = zlib.decompressobj(31)
        self.plain += self.unpacker.decompress(self.packed, 1 << 20)
        self.packed = self.unpacker.unconsumed_tail
        if self.unpacker.eof:  # the next member begins
            self.packed, self.unpacker = self.unpacker.unused_data, None
        return True

    def upto(self, mark: bytes) -> bytes | None:
        """All up to the mark, which goes as well; None at the end."""
        at = 0
        while (end := self.plain.find(mark, at)) < 0:
            at = max(0, len(self.plain) - len(mark))
            if not self.more():
                if self.plain:
                    raise ValueError("a WARC record is broken off")
                return None
        found = bytes(self.plain[:end])
        del self.plain[: end + len(mark)]
        return found

    def take(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self.more():
                raise ValueError("a WARC record is broken off")
        found = bytes(self.plain[:n])
        del self.plain[:n]
        return found


def parse_warc(stream) -> Iterator[tuple[dict, bytes]]:
    """Headers and blocks of the records in a stream of gzip members, one at a time."""
    source = _Bytes(stream)
    while (head := source.upto(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").split(_CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = source.take(int(headers["Content-Length"]))
        source.take(4)
        yield headers, block


_READ = "target_uri string, record_id string, warc_date string, record_type string, payload_bytes long, payload_digest string, refers_to_uri string"


def read_warc(files: DataFrame, path: str) -> DataFrame:
    """One row per record of the files listed; a stored payload that doesn't have its digest or length raises an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _READ.split(", ")]
        filesystem, root = filesystem_of(path)
        for frame in frames:
            for name in frame["file"]:
                rows = []
                with filesystem.open_input_file(f"{root}/{name}") as stream:
                    for h, payload in parse_warc(stream):
                        digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                        if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"payload of {h['WARC-Record-ID']} is damaged")
                        rows.append((h["WARC-Target-URI"], h["WARC-Record-ID"].strip("<>"), h["WARC-Date"], h["WARC-Type"], size, digest, h.get("WARC-Refers-To-Target-URI")))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                yield pd.DataFrame(rows, columns=names)

    n = max(1, files.count())
    return files.select("file").repartition(n).mapInPandas(run, _READ)


def percent_encoded(uri: Column) -> Column:
    """Blanks, control and non-ASCII characters as the percent-encoded bytes of their UTF-8."""
    one = lambda c: F.when(c.rlike(r"[^\x21-\x7e]"), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)
    spelt = F.array_join(F.transform(F.regexp_extract_all(uri, F.lit("(?s)."), F.lit(0)), one), "")
    return F.when(uri.rlike(r"[^\x21-\x7e]"), spelt).otherwise(uri)


def _key_of(uri: Column) -> Column:
    """The page id behind the last mark of a URI; null for pages without one."""
    return F.substring_index(uri, _KEY_MARK, -1).try_cast("long")


def pages_round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000, path: str | None = None) -> DataFrame:
    """ARC records of pages, converted, written as WARC and read back."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("none"))
    second = F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(1_000_000_000))
    captured = F.date_format(F.timestamp_seconds(F.lit(946_684_800) + second), "yyyyMMddHHmmss")
    url = percent_encoded(F.coalesce(F.col(url_col), F.lit("about:blank")))
    version = F.when(F.pmod(second, F.lit(2)) == 0, 1).otherwise(2)
    archives = pages.select(arc_blob(key, url, F.coalesce(html_col, F.lit("")), captured, version).alias("arc"))
    records = materialise(convert(archives), "warc-records")
    back = read_warc(write_warc(assign_types(records, _key_of(F.col("target_uri")), min_bytes), path), path)
    return back.select(
        _key_of(F.col("target_uri")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        _key_of(F.col("refers_to_uri")).alias("refers_to"),
    )
