"""Operator 4: ZIP-packaged web archives, written and read by range.

An archive is a ZIP file with stored members: archive/data.warc.gz, one gzip member for each record, and
indexes/index.cdxj, one line for each. Reading parses the end record and the central directory (ZIP64 ones too), finds
where stored members begin, takes record ranges from the index (or from the gzip members where there is none), and
reads blocks of neighbouring records by range. Nothing is extracted, no archive is read whole by one task.

Files are opened by pyarrow's file systems, so archives may lie in any store that it reaches, and are written in the
folder all executors share. A writing task gives its files names of its own, so a task run again leaves no mixture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortexgrid.plans import materialize
from cortexgrid.plans.cut import scratch_path

#: An archive is closed at so many bytes; records are read in ranges of about so many.
ARCHIVE_BYTES, BLOCK_BYTES = 256 << 20, 4 << 20
#: Salts of the join that finds the response of equal payloads.
SALTS = 8
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, with the payload's length, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,#%[]!()*~')}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Sink(io.RawIOBase):
    """Only writes: so zipfile doesn't seek, which stores can't."""

    def __init__(self, out):
        self.out, self.n = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.n += len(data)
        return len(data)


def _entry(name: str) -> zipfile.ZipInfo:
    return zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
    """(path, records) of each archive that one task writes."""
    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist()))
    row = next(rows, None)
    while row is not None:
        store, path = fs.FileSystem.from_uri(f"{folder}/{uuid.uuid4().hex}.wacz")
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        index, at = [], 0
        with store.open_output_stream(path) as out, zipfile.ZipFile(_Sink(out), "w", zipfile.ZIP_STORED) as archive:
            with archive.open(_entry(DATA), "w", force_zip64=True) as data:
                while row is not None and at < ARCHIVE_BYTES:
                    page_id, url, html, refers_to = row
                    raw = gzip.compress(_record(page_id, url.as_py(), (html.as_py() or "").encode(), refers_to), 4, mtime=0)
                    data.write(raw)
                    index.append(f"page:{page_id} 19700101000000 " + json.dumps({"offset": at, "length": len(raw), "filename": DATA.rsplit("/", 1)[1]}))
                    at += len(raw)
                    row = next(rows, None)
            with archive.open(_entry(INDEX), "w", force_zip64=True) as lines:
                lines.write("\n".join([*index, ""]).encode())
        yield f"{folder}/{path.rsplit('/', 1)[1]}", len(index)


def write_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(archive, records): archives of pages (page_id, url, html), one record for each row.

    Of records with equal payloads of at least least_bytes, the one with the smallest page_id is the response and the
    others revisit it; rows that repeat that page_id are all responses, and so are all if none has a page_id. Smaller
    payloads are all responses. A null html is an empty payload, a null url gives no target. Other columns are ignored;
    empty pages give no archives.
    """
    folder = scratch_path(pages.sparkSession, "archives")
    payload = F.coalesce("html", F.lit(""))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.encode(payload, "UTF-8")).alias("digest"), F.octet_length(payload).alias("n"))
    equal = given.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    equal = materialize(equal.where("rows > 1 and first is not null").select("digest", "first"), "equal")
    salted = given.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("bigint"))
    spread = equal.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    joined = salted.join(spread, ["digest", "salt"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, n in _write(folder, batches):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["archive", "records"])

    return materialize(joined.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(run, "archive string, records long"), "written")


def members(f: pa.NativeFile) -> dict[str, tuple[int, int, int]]:
    """(method, start of data, compressed size) of each member, from the central directory."""
    size = f.size()
    tail = min(size, 65557)
    end = f.read_at(tail, size - tail)
    if (at := end.rfind(b"PK\x05\x06")) < 0:
        raise ValueError("no end of central directory: this is no ZIP file")
    count, length, start = struct.unpack_from("<HLL", end, at + 10)
    begins = size - tail + at
    if begins >= 20 and (locator := f.read_at(20, begins - 20))[:4] == b"PK\x06\x07":
        record = f.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is missing")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, found = f.read_at(length, start), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, names, extras, comment = struct.unpack_from("<LLHHH", directory, at + 20)
        header = struct.unpack_from("<L", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra, i = directory[at + 46 + names : at + 46 + names + extras], 0
        while i + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, i)
            if kind == 1:  # ZIP64: the fields that are all ones before, in this order
                j = i + 4
                if plain == 0xFFFFFFFF:
                    j += 8
                if packed == 0xFFFFFFFF:
                    packed, j = struct.unpack_from("<Q", extra, j)[0], j + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", extra, j)[0]
            i += 4 + n
        local = f.read_at(30, header)
        found[name] = method, header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed
        at += 46 + names + extras + comment
    return found


def _index_lines(f: pa.NativeFile, found: dict[str, tuple[int, int, int]], name: str) -> Iterator[str]:
    """Lines of an index member. Blocks of a .cdx.gz are read by range where its .idx lists them."""

    def whole(name: str) -> bytes:
        method, start, size = found[name]
        raw = f.read_at(size, start)
        return zlib.decompress(raw, -15) if method == 8 else raw

    if not name.endswith(".gz"):
        yield from whole(name).decode().splitlines()
        return
    listed = name.removesuffix(".cdx.gz") + ".idx"
    method, start, _ = found[name]
    if listed in found and method == 0:
        for line in whole(listed).decode().splitlines():
            if (at := line.find("{")) >= 0 and not line.startswith("!"):
                block = json.loads(line[at:])
                yield from gzip.decompress(f.read_at(int(block["length"]), start + int(block["offset"]))).decode().splitlines()
    else:
        yield from gzip.decompress(whole(name)).decode().splitlines()


def _ranges(f: pa.NativeFile) -> Iterator[tuple[int, int]]:
    """(offset, length) in the file of each record."""
    found = members(f)
    data = {name.rsplit("/", 1)[-1]: (start, size) for name, (method, start, size) in found.items() if method == 0 and name.endswith((".warc.gz", ".warc"))}
    if packed := [name for name, (method, *_) in found.items() if method and name.endswith((".warc.gz", ".warc"))]:
        raise ValueError(f"{packed[0]} is compressed in the ZIP file: its records can't be read by range")
    indexes = [name for name in found if name.startswith("indexes/") and name.endswith((".cdxj", ".cdx", ".cdx.gz"))]
    for name in indexes:
        for line in _index_lines(f, found, name):
            at = line.find("{")
            if at >= 0 and not line.startswith("!"):
                entry = json.loads(line[at:])
                yield data[entry["filename"].rsplit("/", 1)[-1]][0] + int(entry["offset"]), int(entry["length"])
    if not indexes:
        for start, size in data.values():
            at, begin = 0, 0
            unzip = zlib.decompressobj(31)
            while at < size:
                piece = f.read_at(min(BLOCK_BYTES, size - at), start + at)
                at += len(piece)
                while piece:
                    unzip.decompress(piece)
                    piece = unzip.unused_data
                    if unzip.eof:
                        yield start + begin, at - len(piece) - begin
                        begin, unzip = at - len(piece), zlib.decompressobj(31)


def _number(urn: str | None) -> int | None:
    """page_id of one of write_archives' URNs; other names have none."""
    text = (urn or "").strip().removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name, the last of a name; a line that begins with a blank goes on the one before."""
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _unchunked(body: bytes) -> bytes:
    """An HTTP body in chunks put together; as it is from where it is no such body, or cut off."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body if not out else b"".join(out)
        if n == 0:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def parse_record(raw: bytes) -> tuple:
    """SCHEMA's values of one record, a gzip member or plain.

    Records of any writer: page_id and refers_to are null unless the record has a URN of write_archives; a missing
    payload digest is computed. An HTTP response's payload is its body, put together if it came in chunks; other records'
    payload is their block. A SHA-1 digest that fits neither form of the payload is an error, unless the record says that
    it was truncated.
    """
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("this is no WARC record")
    fields = _fields(lines[1:])
    block = rest[: int(fields.get("content-length", len(rest)))]
    kind, name = fields.get("warc-type", "unknown").lower(), fields.get("warc-record-id")
    forms, length = [block], len(block)
    if block.startswith(b"HTTP/") or "application/http" in fields.get("content-type", ""):
        top, _, body = block.partition(b"\r\n\r\n")
        http = _fields(top.decode("latin-1").split("\r\n")[1:])
        forms, length = [body], len(body)
        if "chunked" in http.get("transfer-encoding", "").lower():
            forms.insert(0, _unchunked(body))
            length = len(forms[0])
        elif kind == "revisit" and http.get("content-length", "").isdigit():
            length = int(http["content-length"])
    revisit = kind == "revisit"
    method, _, given = fields.get("warc-payload-digest", "").rpartition(":")
    if method and method.lower() != "sha1":
        given = ""
    if given and not revisit and "warc-truncated" not in fields:
        known = {x for form in forms for x in (payload_digest(form), hashlib.sha1(form).hexdigest().upper())}
        if given.upper() not in known:
            raise ValueError(f"damaged record {name}")
    digest = None if revisit and not given else given.upper() if given and len(given) == 32 else payload_digest(forms[0])
    refers = fields.get("warc-refers-to")
    return _number(name), kind, fields.get("warc-target-uri"), length, digest, _number(refers) if revisit else None, None if revisit else forms[0], name, refers


SCHEMA = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string())])


def read_archives(archives: DataFrame, archive: str = "archive") -> DataFrame:
    """SCHEMA's columns of every record in the archives: those that an index lists, or all where there is none.

    payload is null for revisits; their payload_bytes come from the HTTP head. A file that is no ZIP file, a damaged
    record and a compressed member are errors. No archives give no rows; an archive listed twice is read twice.
    """
    files = archives.select(archive)
    tasks = max(1, files.sparkSession.sparkContext.defaultParallelism)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    # neighbouring records make a block
                    begin = end = None
                    blocks = []
                    sizes: list[int] = []
                    for offset, length in _ranges(f):
                        if begin is not None and (offset != end or offset - begin >= BLOCK_BYTES):
                            blocks.append((begin, sizes))
                            begin, sizes = None, []
                        begin = offset if begin is None else begin
                        end = offset + length
                        sizes.append(length)
                    if sizes:
                        blocks.append((begin, sizes))
                for b, s in blocks:
                    yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([b], pa.int64()), pa.array([s], pa.list_(pa.int64()))], names=["archive", "begin", "sizes"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, begin, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    block = f.read_at(sum(sizes), begin)
                at, rows = 0, []
                for n in sizes:
                    rows.append(parse_record(block[at : at + n]))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)

    located = files.repartition(tasks, archive).mapInArrow(locate, "archive string, begin long, sizes array<long>")
    dealt = located.repartition(tasks * 4, "archive", "begin")
    return dealt.mapInArrow(read, "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, record_id string, refers_to_id string")


def archived_pages(pages: DataFrame) -> DataFrame:
    """pages written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null pages are empty payloads, rows that repeat a page_id stay records of their own, and empty pages give no rows; see
    write_archives.
    """
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
