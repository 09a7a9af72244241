"""WARC archives compressed record by record with a Zstandard dictionary.

File layout (``.warc.zst``): a leading skippable frame (magic 0x184D2A5D, 32-bit
length) holds the dictionary; each record after it is one Zstandard frame made with
that dictionary, so any record can be read alone.

Records.  ``response`` records carry the payload; a ``revisit`` names the record it
repeats and carries its digest and length only.

The dictionary is trained on a bounded sample of the archived payloads
(``dictionary_records`` records, chosen by hash).  Archives are written under their
final name in one move after they are complete, in the shared folder, so a task that
runs again replaces its own file by an equal one.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import durable, shared_dir

SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def record(fields: dict[str, str], payload: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def train(samples: list[bytes], size: int) -> bytes:
    """A Zstandard dictionary; where the samples are too few or too alike to train one,
    their last bytes serve as raw content; without samples, none."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def frames(content: bytes) -> Iterator[bytes]:
    """The decompressed records of one archive, in order."""
    import zstandard

    at, known, view = 0, None, memoryview(content)
    while at < len(content):
        (magic,) = struct.unpack_from("<I", content, at)
        if magic == SKIPPABLE:
            (size,) = struct.unpack_from("<I", content, at + 4)
            known = _dictionary(content[at + 8 : at + 8 + size])
            at += 8 + size
            continue
        one, out = zstandard.ZstdDecompressor(dict_data=known).decompressobj(), []
        while not one.eof:
            piece = view[at : at + 8192]
            if not len(piece):
                raise ValueError("an archive ends inside a record")
            out.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(out)


def _one_line(text: str) -> str:
    return " ".join(text.split())


def _roles(pages: DataFrame, revisit_least: int) -> DataFrame:
    """Pages with digest and the page that is the response of their group.

    Only (digest, id) meet in the aggregate; the join back is a plain one, whose hot
    digests AQE splits.
    """
    size, digest = F.length("payload").cast("long"), F.sha1("payload")
    marked = pages.withColumns({"size": size, "digest": digest})
    firsts = durable(marked.where(size >= revisit_least).groupBy(digest.alias("digest")).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")))
    repeated = firsts.where("n > 1 and first is not null").select("digest", "first")
    return marked.join(repeated, "digest", "left").withColumn(
        "refers_to", F.when((F.col("size") >= revisit_least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    )


def _fields(page: int | None, url: str, digest: str, size: int, refers: int | None) -> dict[str, str]:
    """The header of a page's record; ``refers`` is the response of a revisit."""
    named = lambda k: f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(k.encode()).digest())}>"
    fields = {
        "WARC-Type": "response" if refers is None else "revisit",
        "WARC-Record-ID": named(f"{page}|{url}"),
        "WARC-Page-ID": "" if page is None else str(page),
        "WARC-Target-URI": _one_line(url),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": str(size),
        "Content-Type": "text/html; charset=utf-8",
    }
    if refers is not None:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To-Page-ID"] = str(refers)
    return fields


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    *,
    revisit_least: int = 1000,
    dictionary_bytes: int = 65536,
    dictionary_records: int = 1000,
    archive_bytes: int = 16 << 20,
    sample_bytes: int = 65536,
) -> DataFrame:
    """Writes a record for every row; returns (path, records, bytes) of the archives.

    Of records with equal payloads of at least ``revisit_least`` bytes the one with the
    largest id is the response and the others revisit it; rows that repeat that id are
    responses as well, and so is a group without any id.  The dictionary is trained on at
    most ``dictionary_records`` records, and of each on its first ``sample_bytes`` bytes.  Null html is an empty
    payload, a null url an empty target.  An empty table writes no archive.
    """
    text = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), text.alias("payload")
    )
    spot = F.xxhash64("page_id", "url")
    count = base.count()
    portion = min(1.0, 2.0 * dictionary_records / count) if count else 0.0
    chosen = base.where(F.pmod(spot, F.lit(1 << 20)) < int(portion * (1 << 20)) + 1).orderBy(spot).limit(dictionary_records)
    sample = chosen.select("page_id", "url", F.substring("payload", 1, sample_bytes).alias("p"), F.length("payload").alias("n"), F.sha1("payload").alias("d")).collect()
    trained = train([record(_fields(x.page_id, x.url, x.d, x.n, None), bytes(x.p))[:sample_bytes] for x in sample], dictionary_bytes)
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        disk, root = fs.FileSystem.from_uri(folder)
        disk.create_dir(root, recursive=True)
        context = TaskContext.get()
        press = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(trained))
        lead = struct.pack("<II", SKIPPABLE, len(trained)) + trained if trained else b""
        held, size, n, serial = [lead], 0, 0, 0

        def close() -> pa.RecordBatch:
            # An attempt's archives are its own: what a lost or repeated attempt left is in no result.
            name = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{serial:04d}.warc.zst"
            draft = f"{root}/_draft-{run_id}-{context.taskAttemptId()}-{serial}"
            with disk.open_output_stream(draft) as out:
                for x in held:
                    out.write(x)
            disk.move(draft, name)
            return pa.record_batch([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                fields, revisit = _fields(page, url, digest, len(payload), refers), refers is not None
                block = press.compress(record(fields, b"" if revisit else payload))
                held.append(block)
                size, n = size + len(block), n + 1
                if size >= archive_bytes:
                    yield close()
                    held, size, n, serial = [lead], 0, 0, serial + 1
        if n:
            yield close()

    marked = _roles(base, revisit_least).select("page_id", "url", "payload", "digest", "refers_to")
    return marked.mapInArrow(run, "path string, records long, bytes long")


def read_archives(paths: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record
    of the archives that ``paths (path)`` names, on the file system of ``folder``.

    A response's length and digest come from its payload as read; a revisit's are
    those its record states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        disk, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with disk.open_input_stream(path, compression=None) as file:
                    content = file.read()
                for raw in frames(content):
                    fields, payload = parse(raw)
                    page, refers = fields["WARC-Page-ID"], fields.get("WARC-Refers-To-Page-ID")
                    kind = fields["WARC-Type"]
                    digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "revisit":
                        digest, size = stated, int(fields["WARC-Payload-Length"])
                    elif digest != stated:
                        raise ValueError(f"payload of page {page} doesn't match its digest")
                    rows.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None, fields["WARC-Target-URI"]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return paths.select("path").mapInArrow(run, _READ)


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes ``pages`` as archives into ``folder`` (one of its own in the shared folder)
    and returns what reading them back gives."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    written = durable(write_archives(pages, folder, **options))
    return read_archives(written, folder)
