"""WARC archives: write, index, and read selected records by byte ranges.

``write`` makes archives of one gzip member per record in a shared folder. Of pages with equal payloads of
at least ``min_revisit`` bytes the one with the largest id is a response; the others are revisits
that carry its headers and digest, not its payload. Pages that cannot be repeated (see
``exact_dedup``) are written where they are read; only the others are shuffled. A task writes files of its own, named
anew on every attempt, and only files of finished attempts are in the manifest.

``index`` goes over each archive once and notes offset, length, URL and digest of every record.
``fetch`` sorts the selected index entries by file and offset, joins ranges that lie close together
into one read, and returns whole records.

A null or empty html is an empty payload. A null or empty URL is written as ``urn:page:ID``; control characters and
spaces in URLs are percent-encoded. A null id is the smallest: such a page can be a revisit but is never
referred to, and if all ids of a group are null all are responses. Rows that share the largest id are
all responses. An empty table gives no archives and no rows.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.base import join_groups, stored
from corpusloom.llm.exact_dedup import mark_possible, repeat_filter

MIN_REVISIT = 1000
FILE_BYTES = 256 << 20
READ_BYTES = 8 << 20  # one coalesced read
READ_GAP = 64 << 10  # unwanted bytes worth reading rather than seeking over
SPAN_BYTES = 16 << 20  # stretch of a file that one group of reads covers
LEVEL = 3
DATE = "2025-01-01T00:00:00Z"

_MANIFEST = "file string, records long, bytes long"
_INDEX = ("file string, offset long, length long, record_type string, url string, payload_digest string, "
          "page_id long, refers_to long")


def classify(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to of every page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn(
        "__sha", F.sha1("payload"))
    large = F.octet_length("payload") >= min_revisit
    keys = stored(rows.where(large).select("page_id", "__sha"))
    total = keys.count()
    maps, bits = repeat_filter(keys, total)
    maps = stored(maps)
    repeated = (mark_possible(keys, maps, bits).where("__again").groupBy("__sha")
                .agg(F.max("page_id").alias("__keep"), F.count(F.lit(1)).alias("__n")).where("__n > 1"))
    marked = mark_possible(rows, maps, bits)
    again = F.col("__again") & large
    alone = marked.where(~again).drop("__again").withColumn("__keep", F.lit(None).cast("long"))
    joined = join_groups(marked.where(again).drop("__again"), repeated, "__sha", F.col("__n"), total).drop("__n")
    revisit = F.col("__keep").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("__keep")))
    return alone.unionByName(joined).select(
        "page_id", "url", "payload", F.col("__sha").alias("digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("__keep")).alias("refers_to"))


def _uri(url: str | None, page: int | None) -> str:
    if not url:
        return f"urn:page:{'' if page is None else page}"
    return "".join(c if 0x20 < ord(c) != 0x7F else f"%{ord(c):02X}" for c in url)


def record_bytes(page: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, whose length is that of the whole payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page}>" if page is not None else f"<urn:uuid:{uuid.uuid4()}>"),
            ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url, page)),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{refers}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:"):-1]) if urn and urn.startswith("<urn:page:") else None


def _digest(field: str) -> str:
    return base64.b32decode(field.removeprefix("sha1:")).hex()


def write(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives below ``folder``, which all executors share; the stored manifest of finished files."""
    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root)
        out, name, records, size = None, "", 0, 0
        for batch in batches:
            for page, url, payload, digest, kind, refers in zip(*[c for c in batch.columns]):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(),
                                                      kind.as_py(), refers.as_py())) + packer.flush()
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [size]})
    return stored(classify(pages, min_revisit).mapInArrow(archives, _MANIFEST))


def members(source, chunk: int = 4 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of an open archive."""
    unpack, parts, start, at, data = zlib.decompressobj(31), [], 0, 0, b""
    while data or (data := source.read(chunk)):
        parts.append(unpack.decompress(data))
        at += len(data) - len(unpack.unused_data)
        data = unpack.unused_data
        if unpack.eof:
            yield start, at - start, b"".join(parts)
            unpack, parts, start = zlib.decompressobj(31), [], at


def index(manifest: DataFrame, folder: str) -> DataFrame:
    """Stored index of all records of the archives in ``manifest``."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with where.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for offset, length, content in members(source):
                        f, _ = _parse(content)
                        rows.append((name, offset, length, f["WARC-Type"], f["WARC-Target-URI"], _digest(f["WARC-Payload-Digest"]),
                                     _page(f["WARC-Record-ID"]), _page(f.get("WARC-Refers-To"))))
                        if len(rows) == 4096:
                            yield _batch(rows, _INDEX)
                            rows = []
                if rows:
                    yield _batch(rows, _INDEX)
    files = manifest.count()
    return stored(manifest.select("file").repartition(max(1, files), "file").mapInArrow(scan, _INDEX))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [pa.field(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), fields)], schema=pa.schema(fields))


def coalesce(entries: list[tuple[int, int]], gap: int = READ_GAP, most: int = READ_BYTES) -> list[tuple[int, int, list]]:
    """Join sorted (offset, length) into reads (offset, length, entries); one longer record makes a longer read."""
    reads: list[tuple[int, int, list]] = []
    for offset, length in entries:
        if reads and offset - (reads[-1][0] + reads[-1][1]) <= gap and offset + length - reads[-1][0] <= most:
            first, _, held = reads[-1]
            held.append((offset, length))
            reads[-1] = (first, offset + length - first, held)
        else:
            reads.append((offset, length, [(offset, length)]))
    return reads


def fetch(selected: DataFrame, folder: str, reader, schema: str) -> DataFrame:
    """Read the records of index entries; ``reader(fields, block)`` makes a row of ``schema`` from each."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            by_file: dict[str, list] = {}
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                by_file.setdefault(name, []).append((offset, length))
            for name, entries in by_file.items():
                with where.open_input_file(f"{root}/{name}") as source:
                    for first, size, held in coalesce(sorted(entries)):
                        data = source.read_at(size, first)
                        rows = [reader(*_parse(zlib.decompress(data[o - first:o - first + n], 31))) for o, n in held]
                        yield _batch(rows, schema)
    # As many tasks as there are bytes to read; by the size of the index alone they would be far too few.
    tasks = (selected.agg(F.sum("length")).first()[0] or 0) // SPAN_BYTES + 1
    span = F.expr(f"offset div {SPAN_BYTES}")
    spread = selected.select("file", "offset", "length").repartition(tasks, "file", span).sortWithinPartitions("file", "offset")
    return spread.mapInArrow(read, schema)


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def summary(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a response's digest is taken from its payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    declared = int(head.rsplit(b"Content-Length: ", 1)[1])
    digest = _digest(fields["WARC-Payload-Digest"])
    if fields["WARC-Type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (declared, digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return _page(fields["WARC-Record-ID"]), declared, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To"))


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives of all pages, index them, and read every record back by its range."""
    manifest = write(pages, folder)
    return fetch(index(manifest, folder), folder, summary, _RECORD)
