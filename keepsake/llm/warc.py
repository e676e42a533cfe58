"""Legacy archive converter: ARC files of either version to WARC 1.1.

An ARC file begins with a version block whose second line names the fields of the header
lines that follow: five of them in version 1, ten in version 2. Every record is such a header
line, as many bytes as its last field declares, and a line feed; files are often one gzip
member per record. The converter takes the fields by the names of the version block, reads
exactly the declared bytes, and writes an equivalent WARC record:

* id: a version 5 UUID of the archive's name and the record's offset, so a repeated
  conversion gives the same ids
* date: the 14 digits (12 in old archives, with a two-digit year) as a UTC time; digits that
  name no time give the time of the version block
* type: ``warcinfo`` for the version block, ``response`` where the bytes begin with an HTTP
  status line or the URL's scheme is ``dns``, else ``resource``
* digests: SHA-1 in base32 of the block and of the payload, computed anew
* of responses with equal payloads of at least ``least`` bytes, the one with the largest key
  stays whole; the others become ``revisit`` records that refer to it and keep their HTTP
  header only. Keys are integers in the HTTP header ``KEY_HEADER``; a record without one
  counts as the smallest, ties go to the first by archive name and offset.

Archives are listed by a manifest table written with them; a file that a lost task left is
not in it. Which records are equal is decided in a grouping of digests that is combined
before it is shuffled, and joined back by digest; a payload shared by many records is one
row on that side, so adaptive execution can split the records. Nothing but archive names and
record places passes through the shuffle, never payloads.

Nulls, odd rows: a null html is an empty payload, a null page_id a record without a key, a
null url is written as ``unknown:``; blanks and control characters in an url are
percent-encoded. Repeated rows are records of their own. Other columns are ignored. An empty
table gives no archive. A record is held in memory as a whole, an archive is not.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm.store import ship_package, use_memory, written

#: The fields of ARC header lines by version.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_HEADER = b"X-Archive-Key"
#: Payload bytes after which an archive file is closed.
ARCHIVE_BYTES = 64_000_000
#: The pages table has no time of capture.
CAPTURED = "20000101000000"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_parts(block: bytes) -> tuple[bytes, bytes] | None:
    """Header with its blank line, and payload, of an HTTP response; None if it is none."""
    if not block.startswith(b"HTTP/"):
        return None
    ends = [(at + len(mark), at) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    end = min(ends)[0] if ends else len(block)
    return block[:end], block[end:]


def http_field(header: bytes, name: bytes) -> str | None:
    for line in header.split(b"\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower():
            return value.strip().decode("latin-1")
    return None


def key_of(header: bytes) -> int | None:
    value = http_field(header, KEY_HEADER)
    try:
        return None if value is None else int(value)
    except ValueError:
        return None


# ARC


def arc_member(version: int, values: dict[str, str], block: bytes) -> bytes:
    line = " ".join(values.get(f, "-") for f in FIELDS[version][:-1]) + f" {len(block)}\n"
    return gzip.compress(line.encode() + block + b"\n", 1, mtime=0)


def arc_begin(version: int, name: str, date: str) -> bytes:
    """The version block: its record's bytes are the version line and the names of the fields."""
    block = f"{version} 0 keepsake\n{' '.join(FIELDS[version])}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Offset": "0", "Filename": name}
    return arc_member(version, values, block)


def page_block(page_id: int | None, html: str | None) -> tuple[bytes, bytes]:
    payload = (html or "").encode()
    header = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(payload)
    if page_id is not None:
        header += b"%s: %d\r\n" % (KEY_HEADER, page_id)
    return header + b"\r\n" + payload, payload


def archive_url(url: str | None) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "unknown:"


def arc_records(file: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, bytes) of every record, the version block first. ``file`` is read
    record by record; offsets count uncompressed bytes."""
    offset, names = 0, FIELDS[1]
    while line := file.readline():
        if not line.strip():  # the line feed behind a record
            offset += len(line)
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        first = offset == 0 and text.startswith("filedesc:")
        # The version block's own line has the fields of the version its block names.
        values = text.rsplit(" ", (len(FIELDS[2]) if text.count(" ") >= 9 else len(FIELDS[1])) - 1) if first else text.rsplit(" ", len(names) - 1)
        size = int(values[-1]) if values[-1].isdigit() else -1
        block = file.read(size) if size >= 0 else b""
        if size < 0 or len(block) < size:
            raise ValueError(f"broken ARC record at {offset}: {text[:200]!r}")
        if first:
            lines = block.split(b"\n")
            version = int(lines[0].split()[0])
            names = tuple(lines[1].decode().split()) if len(lines) > 1 and lines[1].strip() else FIELDS[version]
            fields = dict(zip(FIELDS[1 if len(values) == 5 else 2], values))
        else:
            fields = dict(zip(names, values))
        yield offset, fields, block
        offset += len(line) + size


# WARC


def warc_date(digits: str, otherwise: str) -> str:
    if len(digits) == 12:
        digits = ("19" if digits[:2] >= "90" else "20") + digits
    try:
        when = datetime.strptime(digits[:14], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
    except ValueError:
        return otherwise
    return when.strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{archive}#{offset}')}>"


def warc_member(fields: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def converted(archive: str, offset: int, fields: dict[str, str], block: bytes, begun: str, original: dict | None) -> bytes:
    """The WARC record equivalent to an ARC record. ``original`` names the record with the
    same payload that this one refers to, or is None."""
    url, ip = fields.get("URL", ""), fields.get("IP-address", "-")
    kind, content, parts = "resource", fields.get("Content-type", "application/octet-stream"), http_parts(block)
    if url.startswith("filedesc:"):
        kind, content = "warcinfo", "application/warc-fields"
        block = f"software: keepsake\r\nformat: WARC File Format 1.1\r\ndescription: converted from {archive}\r\n".encode()
    elif parts:
        kind, content = "response", "application/http; msgtype=response"
    elif url.startswith("dns:"):
        kind, content = "response", "text/dns"
    out = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(archive, offset), "WARC-Date": warc_date(fields.get("Archive-date", ""), begun),
        "WARC-Target-URI": None if kind == "warcinfo" else url, "WARC-Filename": archive if kind == "warcinfo" else None,
        "WARC-IP-Address": ip if ip not in ("-", "0.0.0.0") else None, "Content-Type": content,
        "WARC-Payload-Digest": None if kind == "warcinfo" else f"sha1:{sha1(parts[1] if parts else block)}",
    }
    if original is not None:
        block = parts[0] if parts else b""
        out |= {
            "WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": original["record"],
            "WARC-Refers-To-Target-URI": original["url"], "WARC-Refers-To-Date": original["date"],
        }
    return warc_member(out | {"WARC-Block-Digest": f"sha1:{sha1(block)}"}, block)


def warc_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of every record; block digests are verified."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        fields = {}
        while (line := file.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode()
        block = file.read(int(fields["content-length"]))
        digest = fields.get("warc-block-digest")
        if digest is not None and digest != f"sha1:{sha1(block)}":
            raise ValueError(f"block of {fields.get('warc-record-id')} differs from its digest")
        yield fields, block


# Spark


def _opened(folder: str):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    return system, root


def _stream(system, path: str) -> BinaryIO:
    """The uncompressed bytes of an archive, member by member."""
    raw = system.open_input_stream(path, compression=None, buffer_size=1 << 20)
    return gzip.GzipFile(fileobj=raw)


def write_arc(pages: DataFrame, folder: str, versions: tuple[int, ...] = (1, 2), captured: str = CAPTURED) -> None:
    """Pages (page_id, url, html) as gzipped ARC files under ``folder``/files, the versions by
    turns, with a table ``manifest`` of their names."""
    ship_package(pages.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("warc")
        system, root = _opened(f"{folder}/files")
        system.create_dir(root, recursive=True)
        out, held, names, count = None, 0, [], TaskContext.get().partitionId()
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
                if out is None:
                    version = versions[count % len(versions)]
                    name = f"{count:08d}-{uuid.uuid4().hex}.arc.gz"
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(arc_begin(version, name, captured))
                    names.append(name)
                block, payload = page_block(page_id.as_py(), html.as_py())
                values = {
                    "URL": archive_url(url.as_py()), "IP-address": "0.0.0.0", "Archive-date": captured,
                    "Content-type": "text/html", "Result-code": "200", "Filename": name,
                }
                out.write(arc_member(version, values, block))
                held += len(block)
                if held >= ARCHIVE_BYTES:
                    out.close()
                    out, held, count = None, 0, count + 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["archive"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    rows.mapInArrow(store, "archive string").write.parquet(f"{folder}/manifest")


def arc_index(spark: SparkSession, folder: str) -> DataFrame:
    """archive, offset, kind, key, payload bytes and digests, url and date of every record."""
    ship_package(spark)
    manifest = spark.read.parquet(f"{folder}/manifest")
    kinds = "archive string, offset long, key long, payload_bytes long, digest string, second string, record string, url string, date string"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("warc")
        system, root = _opened(f"{folder}/files")
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows, begun = [], ""
                with _stream(system, f"{root}/{archive}") as file:
                    for offset, fields, block in arc_records(file):
                        if not begun:
                            begun = warc_date(fields.get("Archive-date", ""), "1970-01-01T00:00:00Z")
                        if parts := http_parts(block):
                            header, payload = parts
                            rows.append((
                                archive, offset, key_of(header), len(payload), sha1(payload), hashlib.md5(payload).hexdigest(),
                                record_id(archive, offset), fields["URL"], warc_date(fields.get("Archive-date", ""), begun),
                            ))
                names = [k.split()[0] for k in kinds.split(", ")]
                types = [pa.int64() if k.endswith("long") else pa.string() for k in kinds.split(", ")]
                columns = zip(*rows) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return _dealt(manifest).mapInArrow(index, kinds)


def _dealt(manifest: DataFrame) -> DataFrame:
    """A row per archive is little to read and much to do: spread them over all tasks."""
    spark = manifest.sparkSession
    return manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("archive"))


def originals(index: DataFrame, least: int) -> DataFrame:
    """archive, offset and the record referred to, for every record that becomes a revisit."""
    counted = index.filter(F.col("payload_bytes") >= least)
    first = F.struct(F.coalesce(F.col("key").isNotNull(), F.lit(False)).alias("has"), F.coalesce("key", F.lit(0)).alias("key"))
    place = F.struct("archive", "offset")
    # The largest key; among equal keys the first place.
    top = counted.groupBy("digest", "second", "payload_bytes").agg(F.max(first).alias("top"), F.count("*").alias("n")).filter("n > 1")
    keys = ["digest", "second", "payload_bytes"]
    among = counted.join(top, keys).filter(first == F.col("top"))
    kept = among.groupBy(*keys).agg(F.min(F.struct(place.alias("place"), "record", "url", "date")).alias("first"))
    again = counted.join(kept, keys).filter(place != F.col("first.place"))
    return again.select("archive", "offset", F.col("first.record").alias("record"), F.col("first.url").alias("url"), F.col("first.date").alias("date"))


def convert(spark: SparkSession, arc_folder: str, folder: str, least: int = 0) -> None:
    """All ARC files of ``arc_folder`` as WARC files under ``folder``/files, with a manifest."""
    ship_package(spark)
    index = written(arc_index(spark, arc_folder), "arc-index")
    by_archive = originals(index, least).groupBy("archive").agg(F.collect_list(F.struct("offset", "record", "url", "date")).alias("revisits"))
    # Dealt after the join, whose few rows adaptive execution would gather in one task.
    work = _dealt(spark.read.parquet(f"{arc_folder}/manifest").join(by_archive, "archive", "left"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("warc")
        source, source_root = _opened(f"{arc_folder}/files")
        system, root = _opened(f"{folder}/files")
        system.create_dir(root, recursive=True)
        for batch in batches:
            for archive, revisits in zip(batch.column("archive").to_pylist(), batch.column("revisits")):
                known = {r["offset"]: r for r in revisits.as_py() or ()}
                name, begun = f"{archive.split('.')[0]}-{uuid.uuid4().hex[:8]}.warc.gz", ""
                with _stream(source, f"{source_root}/{archive}") as file, system.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for offset, fields, block in arc_records(file):
                        if not begun:
                            begun = warc_date(fields.get("Archive-date", ""), "1970-01-01T00:00:00Z")
                        out.write(converted(archive, offset, fields, block, begun, known.get(offset)))
                yield pa.RecordBatch.from_arrays([pa.array([name])], ["archive"])

    work.select("archive", "revisits").mapInArrow(store, "archive string").write.parquet(f"{folder}/manifest")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every response and revisit of the archives: key, payload_bytes, payload_digest,
    record_type, record (its id), refers_to_record, url, date. Payload digests of responses are
    verified; a revisit has its payload's length from its HTTP header."""
    ship_package(spark)
    kinds = (
        "key long, payload_bytes long, payload_digest string, record_type string, record string, "
        "refers_to_record string, url string, date string"
    )

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("warc")
        system, root = _opened(f"{folder}/files")
        names = [k.split()[0] for k in kinds.split(", ")]
        types = [pa.int64() if k.endswith("long") else pa.string() for k in kinds.split(", ")]
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows = []
                with _stream(system, f"{root}/{archive}") as file:
                    for fields, block in warc_records(file):
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        header, payload = http_parts(block) or (b"", block)
                        size = len(payload)
                        if kind == "revisit":
                            length = http_field(header, b"Content-Length")
                            size = int(length) if length is not None else None
                        elif sha1(payload) != digest:
                            raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                        rows.append((
                            key_of(header), size, digest, kind, fields["warc-record-id"], fields.get("warc-refers-to"),
                            fields.get("warc-target-uri"), fields.get("warc-date"),
                        ))
                columns = zip(*rows) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return _dealt(spark.read.parquet(f"{folder}/manifest")).mapInArrow(load, kinds)


def with_referred_keys(records: DataFrame) -> DataFrame:
    """Adds refers_to, the key of the record a revisit refers to. Only records that are referred
    to are looked up, one row each. ``records`` is written, as it is read twice."""
    wanted = records.filter("refers_to_record is not null").select(F.col("refers_to_record").alias("record")).distinct()
    keys = records.filter("record_type = 'response'").select("record", F.col("key").alias("refers_to")).join(wanted, "record", "left_semi")
    return records.join(keys.withColumnRenamed("record", "refers_to_record"), "refers_to_record", "left")
