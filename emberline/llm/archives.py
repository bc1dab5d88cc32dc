"""ARC to WARC: write pages as legacy archives, convert them, and read the result back.

An archive is a binary value of some MB. The converter parses ARC header lines by the
version that the archive's first record declares, takes each record by its declared
length, and makes a WARC record of it with an identifier, a timestamp, a type
and digests; the first record becomes a warcinfo. Of records with equal payloads, one becomes a response and the others
revisits that refer to it. What WARC has no field for (result code, checksum) is kept in fields of our own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import as_bytes, map_columns, materialize, small
from emberline.storage import scratch

#: An archive is closed when it has as many bytes.
ARCHIVE_BYTES = 1 << 22
#: Names in the header lines of ARC records, by version (fixed values).
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def arc_head(version: int, name: str, date: str) -> bytes:
    """The first record of an archive: its version and the names of the fields."""
    lines = f"{version} 0 emberline\n" + ("URL IP-address Archive-date Content-type Archive-length\n" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n")
    rest = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {rest}{len(lines)}\n{lines}\n".encode()


def arc_record(version: int, url: str, date: str, content: bytes, name: str, offset: int) -> bytes:
    rest = "" if version == 1 else f"200 {hashlib.md5(content).hexdigest()} - {offset} {name} "
    return b"".join((f"{url} 0.0.0.0 {date} text/html {rest}{len(content)}\n".encode(), content, b"\n"))


def parse_arc(data: bytes, strict: bool = True) -> Iterator[dict]:
    """Records of an ARC archive, each with the header's fields, its content, and where it begins. The first, which tells the version, is of type filedesc.

    A malformed archive is a ValueError if strict; else its records up to the fault come as they are, and then one of type error, whose url says what is wrong.
    """
    try:
        yield from _arc_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    except (ValueError, EOFError, OSError, zlib.error) as e:
        if strict:
            raise ValueError(f"malformed ARC archive: {e}") from e
        yield {"url": str(e), "date": "", "type": "error", "content": b"", "at": -1}


def _arc_records(data: bytes) -> Iterator[dict]:
    at, version = 0, 1
    first = True
    while at < len(data):
        if data[at : at + 1] == b"\n":  # a blank line between records
            at += 1
            continue
        start, end = at, data.index(b"\n", at)
        words = data[at:end].decode("utf-8", "replace").split(" ")
        size = int(words[-1])
        content = data[end + 1 : end + 1 + size]
        if size < 0 or len(content) < size:
            raise ValueError(f"a record declares {size} bytes and has {len(content)}")
        at = end + 1 + size
        if first and words[0].startswith("filedesc:"):
            version = int(content.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"version {version}")
            yield {"url": words[0], "ip": words[1], "date": words[2], "type": "filedesc", "content": content, "at": start}
        else:
            names = ARC_FIELDS[version]
            if len(words) < len(names):
                raise ValueError("a header line has too few fields")
            cut = len(words) - len(names) + 1  # a URL of old crawlers may hold blanks
            yield dict(zip(names, [" ".join(words[:cut]), *words[cut:]], strict=True)) | {"content": content, "at": start}
        first = False


def payload_of(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and the payload. Content that is no HTTP response is all payload."""
    if content[:5] != b"HTTP/":
        return b"", content
    head, gap, body = content.partition(b"\r\n\r\n")
    return head + gap, body


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*of: object) -> str:
    """The same identifier for the same record on every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, of)))}>"


def warc_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss, or a beginning of it, as in old crawls."""
    d = arc_date + "00000101000000"[len(arc_date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", len(block))] if v is not None)
    return b"".join((f"WARC/1.0\r\n{head}\r\n".encode(), block, b"\r\n\r\n"))


def member(record: bytes) -> bytes:
    """A gzip member, the same on every run."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; records may be gzip members."""
    f = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        head = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.lower()] = v.strip()
        yield head, f.read(int(head["content-length"]))


def pages_to_arc(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "20240101000000") -> DataFrame:
    """Archives (column arc) of a record for each page; a task writes its pages in turn to one of version 1 and one of version 2.

    The page's id stands in the HTTP head. White space and control characters of a URL are
    escaped; a null URL is about:blank, a null page empty.
    """
    kind = pages.select(page_id).schema[0].dataType.typeName()
    if kind not in ("long", "integer", "short", "byte"):
        raise TypeError(f"page ids must be whole numbers, not {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, made = task.partitionId() if task else 0, 0
        held: dict[int, list[bytes]] = {1: [], 2: []}
        size, names = {1: 0, 2: 0}, {1: "", 2: ""}

        def out(version: int) -> pa.RecordBatch:
            arc, held[version] = b"".join(held[version]), []
            return pa.RecordBatch.from_arrays([pa.array([arc], pa.binary())], names=["arc"])

        row = 0
        for batch in batches:
            for key, link, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                version, row = row % 2 + 1, row + 1
                if not held[version]:
                    names[version], made = f"part-{part:06d}-{made:06d}.arc", made + 1
                    held[version] = [arc_head(version, names[version], date)]
                    size[version] = len(held[version][0])
                body = body or b""
                link = "".join(c if c > " " and c != "\x7f" else "".join(f"%{x:02X}" for x in c.encode()) for c in link) if link else "about:blank"
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + ("" if key is None else f"X-Page-Id: {key}\r\n") + f"Content-Length: {len(body)}\r\n\r\n"
                record = arc_record(version, link, date, head.encode() + body, names[version], size[version])
                held[version].append(record)
                size[version] += len(record)
                if size[version] >= ARCHIVE_BYTES:
                    yield out(version)
        for version in held:
            if held[version]:
                yield out(version)

    return pages.select(F.col(page_id).cast("long"), url, html).mapInArrow(run, "arc binary")


#: What the converter takes from each ARC record, besides its content.
ARC_COLUMNS = {"url": pa.string(), "ip": pa.string(), "date": pa.string(), "type": pa.string(), "result": pa.string(), "checksum": pa.string(), "archive": pa.string(), "page_id": pa.int64(), "digest": pa.string(), "full": pa.string(), "size": pa.int64(), "record_id": pa.string(), "warcinfo_id": pa.string()}
ARC_SCHEMA = ", ".join(f"{k} {'long' if t == pa.int64() else 'string'}" for k, t in ARC_COLUMNS.items())


def arc_records(archives: DataFrame, arc: str = "arc", with_content: bool = True, strict: bool = True) -> DataFrame:
    """A row for each ARC record: ARC_COLUMNS (and content). digest is SHA-1 and full SHA-256 of the payload; record_id is the WARC identifier, warcinfo_id that of the archive's own record.

    An identifier is made of the archive's name, the record's place, URL, date and digest: rows that repeat have identifiers of their own, and reruns the same ones.
    """

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for data in batch.column(0).to_pylist():
            rows, archive, info = [], "", None
            for r in parse_arc(data or b"", strict):
                if r["type"] == "filedesc":
                    archive = r["url"].removeprefix("filedesc:").lstrip("/")
                head, payload = payload_of(r["content"]) if r["type"] != "filedesc" else (b"", r["content"])
                key = next((int(x[10:]) for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id:") and x[10:].strip().lstrip(b"-").isdigit()), None)
                digest = base32_sha1(payload)
                own = record_id(archive, r["at"], r["url"], r["date"], digest)
                info = own if r["type"] == "filedesc" else info
                rows.append((r["url"], r.get("ip"), r["date"], r["type"], r.get("result"), r.get("checksum"), archive, key, digest, hashlib.sha256(payload).hexdigest(), len(payload), own, info, *[r["content"]] * with_content))
            kinds = [*ARC_COLUMNS.values(), *[pa.binary()] * with_content]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*ARC_COLUMNS, *["content"] * with_content])

    return map_columns(archives, [F.col(arc)], ARC_SCHEMA + ", content binary" * with_content, step)


def link_revisits(records: DataFrame, slim: DataFrame, min_bytes: int = 0) -> DataFrame:
    """records with refers_to and the response's identifier, URL and date, all null where a record is no revisit. slim: the same records without content.

    Payloads are equal if SHA-1, SHA-256 and length are. Of a group, the record of the smallest page_id (then the smallest identifier) is the response; others of that
    page_id are responses too. Only payloads that occur more than once take part in the join. A table of them of checked size is
    broadcast; a larger one is joined by a shuffle that Spark may split where one payload has many records.
    """
    same = ["digest", "full", "size"]
    groups = slim.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull() & ~F.col("type").isin("filedesc", "error")).groupBy(*same).agg(F.min(F.struct("page_id", "record_id", "url", "date")).alias("_first"))
    others = slim.where(~F.col("type").isin("filedesc", "error")).groupBy(*same).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*same)
    groups = materialize(groups.join(others, same, "left_semi"))
    rows = records.join(small(groups, groups.count()), same, "left")
    other = ~F.col("page_id").eqNullSafe(F.col("_first.page_id")) & ~F.col("type").isin("filedesc", "error")
    columns = {"refers_to": "page_id", "to_record": "record_id", "to_url": "url", "to_date": "date"}
    return rows.select(*records.columns, *[F.when(other, F.col(f"_first.{c}")).alias(name) for name, c in columns.items()])


def write_warc(records: DataFrame) -> DataFrame:
    """Archives (column warc) with a gzip member for each record. A record names the warcinfo of its ARC archive, in whatever order and task records come."""

    def one(r: dict) -> bytes:
        if r["type"] == "filedesc":
            text = f"software: emberline\r\nformat: WARC File Format 1.0\r\ndescription: converted from {r['archive']}\r\n".encode()
            fields = [("WARC-Record-ID", r["record_id"]), ("WARC-Date", warc_date(r["date"])), ("WARC-Filename", r["archive"].removesuffix(".arc") + ".warc.gz"), ("WARC-Block-Digest", f"sha1:{base32_sha1(text)}"), ("Content-Type", "application/warc-fields")]
            return warc_record("warcinfo", fields, text)
        head, _ = payload_of(r["content"])
        revisit = r["refers_to"] is not None
        block = head if revisit else r["content"]
        given = lambda x: None if x in (None, "", "-") else x
        fields = [
            ("WARC-Record-ID", r["record_id"]),
            ("WARC-Warcinfo-ID", r["warcinfo_id"]),
            ("WARC-Date", warc_date(r["date"])),
            ("WARC-Target-URI", r["url"]),
            ("WARC-IP-Address", None if given(r["ip"]) in (None, "0.0.0.0") else r["ip"]),
            ("WARC-Payload-Digest", f"sha1:{r['digest']}"),
            ("WARC-Profile", REVISIT if revisit else None),
            ("WARC-Refers-To", r["to_record"]),
            ("WARC-Refers-To-Target-URI", r["to_url"]),
            ("WARC-Refers-To-Date", warc_date(r["to_date"]) if revisit else None),
            ("X-Refers-To-Page", r["refers_to"]),
            ("X-Payload-Length", r["size"]),
            ("X-Page-Id", r["page_id"]),
            ("X-Arc-Result-Code", given(r["result"])),
            ("X-Arc-Checksum", given(r["checksum"])),
            ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
            ("Content-Type", "application/http; msgtype=response" if head else r["type"]),
        ]
        return warc_record("revisit" if revisit else "response" if head else "resource", fields, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["type"] == "error":
                    continue
                held.append(member(one(r)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["warc"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["warc"])

    return records.select(*ARC_COLUMNS, "content", "refers_to", "to_record", "to_url", "to_date").mapInArrow(run, "warc binary")


def read_warc(archives: DataFrame, warc: str = "warc", with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, date and refers_to_id (and payload) of each record but warcinfos. The digest of a stored payload is computed again and must equal the declared one."""

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for data in batch.column(0).to_pylist():
            rows = []
            for h, block in parse_warc(data or b""):
                if h["warc-type"] == "warcinfo":
                    continue
                _, payload = payload_of(block)
                digest, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                if h["warc-type"] != "revisit" and (base32_sha1(payload) != digest or len(payload) != size):
                    raise ValueError(f"{h['warc-record-id']}: the payload differs from its digest")
                key, to = h.get("x-page-id"), h.get("x-refers-to-page")
                rows.append((key and int(key), size, digest, h["warc-type"], to and int(to), h["warc-record-id"], h["warc-target-uri"], h["warc-date"], h.get("warc-refers-to"), *[payload] * with_payload))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), *[pa.binary()] * with_payload]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date", "refers_to_id", *["payload"] * with_payload]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return map_columns(archives, [F.col(warc)], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string, refers_to_id string" + ", payload binary" * with_payload, step)


def convert(archives: DataFrame, min_bytes: int = 0, strict: bool = True) -> DataFrame:
    """WARC archives (column warc), written to the shared checkpoint folder, of ARC archives (column arc).

    A malformed archive ends the job if strict; else what stands before its fault is converted, and arc_records(..., strict=False) tells the faults
    (type error).
    """
    return materialize(write_warc(link_revisits(arc_records(archives, strict=strict), arc_records(archives, with_content=False, strict=strict), min_bytes)))


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Each page's record, after writing ARC, converting to WARC and reading back.

    Ids must be whole numbers. Rows without an id, and all that repeat the smallest id of their payload, are responses
    unless a smaller id has the payload; a payload whose rows have no id at all gives
    responses only. Other columns are neither read nor returned. An empty table gives no rows.
    """
    folder = scratch(pages.sparkSession, "arc")
    pages_to_arc(pages, page_id, url, html).write.option("compression", "zstd").parquet(folder)  # read twice, and names of archives hold once they are written
    return read_warc(convert(pages.sparkSession.read.parquet(folder), min_bytes))
