"""WARC archives: a writer, and a reader that salvages damaged ones.

Spark's own text writer lays down archive files on any store it can write: each
row is a record, or the gzip member that holds it. The reader takes plain
archives, gzip members and files of both. When a check fails (version line,
length, blank line, digests, gzip checksum) it looks for whichever comes
first, a record that is sound or a member that holds one, goes on there, and
reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

END = b"\r\n\r\n"
_LINE = "\r\n"
_VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_MEMBER = b"\x1f\x8b\x08"
_HEX = re.compile("[0-9a-fA-F]{40}")
_BASE32 = re.compile("[A-Za-z2-7]{32}")
_ID = "urn:x-page:"


# --- writing ----------------------------------------------------------------


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A WARC record per row without its closing blank line, ``record``, and ``bytes``, those of its payload before any is left out.

    Of rows with equal payloads of at least ``min_bytes`` the one with the largest
    id is the response and the others revisit it; smaller payloads are all
    responses. A null payload is empty. Rows that repeat the largest id are all
    responses; a null id revisits a group's largest id, and is a response if the
    group has none. A null url is replaced by the record's own name.
    """
    rows = pages.select(F.col(id_col).cast("string").alias("_id"), F.col(id_col).alias("_key"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    rows = rows.withColumn("_bytes", F.octet_length("_html")).withColumn("_sha", F.sha1(F.encode("_html", "UTF-8")))
    # Ids and digests of large payloads decide; pages then meet their own revisit by id, so no payload, however common, gathers in one task.
    marks = stage(rows.where(F.col("_bytes") >= min_bytes).select("_key", "_sha"), "payloads")
    copies = marks.groupBy("_sha").agg(F.max("_key").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null").drop("_n")
    revisits = marks.join(copies, "_sha").where(~F.col("_key").eqNullSafe(F.col("_first"))).select(F.col("_key").alias("_again"), F.col("_sha").alias("_of"), "_first").distinct()
    rows = rows.join(revisits, F.col("_key").eqNullSafe(F.col("_again")) & (F.col("_sha") == F.col("_of")) & (F.col("_bytes") >= min_bytes), "left")
    revisit = F.col("_first").isNotNull()
    name = F.concat(F.lit(f"<{_ID}"), F.coalesce("_id", F.lit("")), F.lit(">"))
    url = F.coalesce(F.regexp_replace("_url", r"[\x00-\x20\x7f]", "%20"), F.concat(F.lit(_ID), F.coalesce("_id", F.lit(""))))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_LINE}Content-Type: text/html; charset=utf-8{_LINE}Content-Length: "), F.col("_bytes").cast("string"), F.lit(_LINE * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("_html")))
    length = F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("_bytes"))
    fields = [
        F.lit(f"WARC/1.1{_LINE}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{_LINE}WARC-Record-ID: "), name, F.lit(f"{_LINE}WARC-Date: {date}{_LINE}WARC-Target-URI: "), url,
        F.when(revisit, F.concat(F.lit(f"{_LINE}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_LINE}WARC-Refers-To: <{_ID}"), F.col("_first").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{_LINE}WARC-Payload-Digest: sha1:"), F.col("_sha"),
        F.lit(f"{_LINE}Content-Type: application/http; msgtype=response{_LINE}Content-Length: "), length.cast("string"), F.lit(_LINE * 2), block,
    ]
    return rows.select(F.concat(*fields).alias("record"), F.col("_bytes").alias("bytes"))


def member(record: bytes) -> bytes:
    """The gzip member of a record and its closing blank line, without the zero byte at its end.

    A member ends with its size modulo 2**32, lowest byte first, so the last byte
    is zero below 16 MB; beyond that an empty member, which always ends so, follows.
    """
    out = gzip.compress(record + END, 6, mtime=0)
    return (out if out[-1] == 0 else out + gzip.compress(b"", mtime=0))[:-1]


def write_warc(records: DataFrame, path: str, per_file: int = 2_000, file_bytes: int = 256 << 20, compression: str = "gzip") -> None:
    """Write ``record, bytes`` to archive files that fit a task's memory when they are read: at most ``per_file`` records and, but for one record that is longer, about ``file_bytes`` bytes. Records of over their share of a file are written apart from the others.

    With ``gzip`` each record is a member of its own, so damage costs one record;
    the writer's separator is the zero byte at the members' ends. Any other
    ``compression`` is the text writer's, over a file's plain records. A null
    record is left out, repeated records are written each; without records there
    is no file with any content.
    """
    separator = END.decode()

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([member(r.as_buffer().to_pybytes()) for r in batch.column("record")], pa.binary())], ["record"])

    usual = file_bytes // per_file
    longest = records.agg(F.max("bytes")).first()[0] or 0
    parts = [(F.col("bytes") <= usual, per_file)] + ([(F.col("bytes") > usual, max(1, file_bytes // longest))] if longest > usual else [])
    for which, most in parts:
        some = records.where(which & F.col("record").isNotNull()).select("record")
        if compression == "gzip":
            some, separator = some.mapInArrow(pack, "record binary").select(F.col("record").cast("string")), "\0"
        some.write.mode("append").option("lineSep", separator).option("compression", "none" if compression == "gzip" else compression).option("maxRecordsPerFile", most).text(path)


# --- reading ----------------------------------------------------------------


class Bad(ValueError):
    """A failed check; ``what`` names it."""


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return out


def _digest(value: str) -> tuple[str | None, bool]:
    """A digest field's value and whether it is a SHA-1 to check. Those (hex or base32, or 40 hex digits without a label) become lower-case hex; others stay as they are."""
    label, colon, rest = value.rpartition(":")
    if colon and label.lower() not in ("sha1", "sha-1") or not colon and not _HEX.fullmatch(rest):
        return value or None, False
    if _BASE32.fullmatch(rest):
        return base64.b32decode(rest.upper()).hex(), True
    return rest.lower(), True


def read_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and where it ends; raises Bad if a check fails."""
    version = _VERSION.match(data, at)
    if not version:
        raise Bad("version line")
    head_end = data.find(END, at)
    if head_end < 0:
        raise Bad("header end")
    head = _headers(data[version.end() : head_end])
    size = head.get("content-length", "")
    if not size.isdigit():
        raise Bad("content length")
    begin, end = head_end + 4, head_end + 4 + int(size)
    if data[end : end + 4] != END:
        raise Bad("length")
    block = data[begin:end]
    kind = head.get("warc-type", "")
    http, payload = {}, block
    if head.get("content-type", "").startswith("application/http"):
        cut = block.find(END)
        if cut < 0:
            raise Bad("http header")
        http, payload = _headers(block[:cut]), block[cut + 4 :]
    whole, known = _digest(head.get("warc-block-digest", ""))
    if known and hashlib.sha1(block).hexdigest() != whole:
        raise Bad("block digest")
    digest, known = _digest(head.get("warc-payload-digest", ""))
    if kind != "revisit" and known and hashlib.sha1(payload).hexdigest() != digest:
        raise Bad("payload digest")
    size = int(http["content-length"]) if kind == "revisit" and http.get("content-length", "").isdigit() else len(payload)
    return {"record_type": kind, "record_id": head.get("warc-record-id", "").strip("<>"), "target_uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to", "").strip("<>") or None, "payload_digest": digest, "payload_bytes": size, "payload": payload}, end + 4


def salvage_plain(data: bytes, base: int = 0):
    """Yield records and gaps ``(kind, begin, end, record or reason)`` of an uncompressed stretch."""
    at, size = 0, len(data)
    while at < size:
        try:
            record, end = read_record(data, at)
            yield "record", base + at, base + end, record
            at = end
        except Bad as why:
            gap, reason = at, str(why)
            at += 1
            while True:
                found = _VERSION.search(data, at)
                if not found:
                    at = size
                    break
                at = found.start()
                try:
                    read_record(data, at)
                    break
                except Bad:
                    at += 1
            yield "gap", base + gap, base + at, reason


def read_member(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member at ``at`` holds, up to the byte where it fails, where it ends, and whether its checksum held."""
    unzip = zlib.decompressobj(31)
    out, view, step = [], memoryview(data), 1 << 12
    pos = at
    try:
        while not unzip.eof and pos < len(data):
            out.append(unzip.decompress(view[pos : pos + step]))
            pos += step
            step = min(2 * step, 1 << 16)
    except zlib.error:
        # a failing call gives nothing: go through its bytes one by one
        unzip = zlib.decompressobj(31)
        out = [unzip.decompress(view[at:pos])]
        try:
            while True:
                out.append(unzip.decompress(view[pos : pos + 1]))
                pos += 1
        except zlib.error:
            return b"".join(out), pos, False
    return b"".join(out), min(pos, len(data)) - len(unzip.unused_data), unzip.eof


def _goes_on(data: bytes, at: int, held: set[bytes]) -> bool:
    """Whether a sound record that isn't among ``held`` is at ``at``, or a member that begins as a record or, damaged, still holds a sound one."""
    if data.startswith(_MEMBER, at):
        body, _, sound = read_member(data, at)
        return bool(sound and _VERSION.match(body)) or any(kind == "record" for kind, *_ in salvage_plain(body))
    try:
        _, end = read_record(data, at)
    except Bad:
        return False
    return data[at:end] not in held


def salvage(data: bytes):
    """Records and gaps of an archive, plain, of gzip members or of both. Offsets are bytes of the file; a record inside a member has the member's offset. From a damaged member the sound records are kept."""
    at, size = 0, len(data)
    ahead = {_MEMBER: -1, _VERSION: -1}  # the next of each that isn't before ``at``
    while at < size:
        held, until = set(), at  # what a damaged member of stored blocks would show again, up to where it fails
        if data.startswith(_MEMBER, at):
            body, end, sound = read_member(data, at)
            for kind, a, b, what in salvage_plain(body):
                if sound or kind == "record":
                    yield kind, at, end if sound else at, what
                if not sound and kind == "record":
                    held.add(body[a:b])
            until = end
            if sound:
                at = end
                continue
            reason = "gzip member"
        else:
            try:
                record, end = read_record(data, at)
                yield "record", at, end, record
                at = end
                continue
            except Bad as why:
                reason = str(why)
        gap, at = at, at + 1
        while at < size:
            if ahead[_MEMBER] < at:
                found = data.find(_MEMBER, at)
                ahead[_MEMBER] = size if found < 0 else found
            if ahead[_VERSION] < at:
                found = _VERSION.search(data, at)
                ahead[_VERSION] = found.start() if found else size
            at = min(ahead.values())
            if at == size or _goes_on(data, at, held if at < until else set()):
                break
            at += 1
        yield "gap", gap, at, reason


_ROWS = "path string, kind string, begin long, end long, reason string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of kind ``record`` and, for what had to be skipped, of kind ``gap`` with its bytes ``begin`` to ``end`` and the failed check.

    Each file is read whole by one task, so archives should stay well below an
    executor's memory (and under 2 GB, Spark's bound for one value). An empty file
    gives no rows, a file without any sound record one gap. Records are returned
    as often as they are found, repeated ones too. A field that a record doesn't
    have is null; a record without payload has an empty one of 0 bytes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_ROWS))
    names = schema.names

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                path, out, size = batch.column("path")[k].as_py(), [], 0
                for kind, begin, end, what in salvage(batch.column("content")[k].as_py()):
                    row = dict.fromkeys(names) | {"path": path, "kind": kind, "begin": begin, "end": end} | (what if kind == "record" else {"reason": what})
                    if not with_payload:
                        row["payload"] = None
                    size += len(row["payload"] or b"") + 300
                    out.append(row)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, _ROWS)


def page_id(name: Column) -> Column:
    """The page id in a record's name; null if the page had none."""
    return F.when(F.length(name) > len(_ID), F.substr(name, F.lit(len(_ID) + 1)).cast("long"))
