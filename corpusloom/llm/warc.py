"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding a run of WARC records,
and a seek table in a skippable frame at its end (frame sizes, as in the public seekable
format).  An index maps each record id to bundle, frame and offset inside the frame, so
one record is read by decompressing one frame.

Bundles are written by executors into the shared folder, under names that only one task
attempt uses; the index, written by Spark's committer, names the files that count.  A task
that runs again leaves an unused file, which ``sweep`` removes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import cut_lineage, look_up, shared_dir

#: Fixed values of the public seekable format: skippable frame number 0xE, its footer's magic number.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
CRLF = b"\r\n"
DATE = "2000-01-01T00:00:00Z"
LINE_ENDS = {10: None, 13: None}
FRAME_BYTES = 1 << 18


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(folder: str):
    """(pyarrow file system, path) of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit has no block, and ``Payload-Length`` keeps its payload's length.

    A URL with line ends cannot stand in a header; it is kept whole, quoted, in one of its own.
    """
    response = refers_to is None
    target = [] if url is None else [f"WARC-Target-URI: {url.translate(LINE_ENDS)}"]
    if target and url.translate(LINE_ENDS) != url:
        target.append(f"Quoted-Target-URI: {json.dumps(url)}")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        *target, f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"Payload-Length: {len(payload)}",
        *([] if response else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]),
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload) if response else 0}",
    ]
    return CRLF.join(x.encode("utf-8", "surrogatepass") for x in head) + CRLF + CRLF + (payload if response else b"") + CRLF + CRLF


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, place after the record)."""
    end = data.index(CRLF + CRLF, at)
    lines = data[at:end].split(CRLF)
    headers = dict(line.decode("utf-8", "surrogatepass").split(": ", 1) if b": " in line else (line.decode("utf-8", "surrogatepass").rstrip(":"), "") for line in lines[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    return headers, data[start:stop], stop + 4


def target_of(headers: dict[str, str]) -> str | None:
    quoted = headers.get("Quoted-Target-URI")
    return json.loads(quoted) if quoted else headers.get("WARC-Target-URI")


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", c, p) for c, p in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(stream) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame of an open bundle."""
    size = stream.seek(0, 2)
    stream.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    stream.seek(size - 9 - 8 * count)
    entries, offset, out = stream.read(8 * count), 0, []
    for c, p in struct.iter_unpack("<II", entries):
        out.append((offset, c, p))
        offset += c
    return out


class BundleWriter:
    """Writes frames as they fill; ``rows`` collects (page_id, bundle, frame, offset)."""

    def __init__(self, folder: str, frame_bytes: int):
        self.files, root = filesystem(folder)
        self.name = f"{root}/{uuid.uuid4().hex}.warc.zst"
        self.stream, self.frame_bytes = self.files.open_output_stream(self.name, compression=None), frame_bytes
        self.frames: list[tuple[int, int]] = []
        self.pending, self.size, self.written = [], 0, 0

    def add(self, record: bytes) -> tuple[str, int, int]:
        """(bundle, frame, offset) of the record; the frame number counts from 0."""
        if self.pending and self.size + len(record) > self.frame_bytes:
            self.flush()
        at = (self.name, len(self.frames), self.size)
        self.pending.append(record)
        self.size += len(record)
        return at

    def flush(self) -> None:
        import zstandard

        if self.pending:
            packed = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(b"".join(self.pending))
            self.frames.append((len(packed), self.size))
            self.stream.write(packed)
            self.written += len(packed)
            self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.stream.write(seek_table(self.frames))
        self.stream.close()


INDEX = "page_id long, bundle string, frame int, offset long"


def write_archive(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", smallest: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = 1 << 28) -> DataFrame:
    """Write ``pages`` under ``folder`` and return the index ``(page_id, bundle, frame, offset)`` read back from there.

    Of records with equal payloads of at least ``smallest`` bytes, the one with the largest
    id is a response and others revisit it.  Null html is an empty payload; a null id
    counts as the smallest of all.  Every row has a record; rows that repeat the kept id and its
    payload are all responses.
    """
    spark = pages.sparkSession
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    own = own.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    # Counted before the shuffle, so a payload that a third of all pages share is a few rows here.
    shared = own.where(F.col("size") >= smallest).groupBy("sha", "size").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    marked = look_up(own.select("page_id", "url", "html", "sha", "size"), cut_lineage(shared), ["sha", "size"], "copies")
    refers = F.when(F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    # A revisit's payload is only hashed; it needs no more than its digest and length.
    rows = marked.select("page_id", "url", "html", refers.alias("refers_to"))
    bundles = f"{folder}/bundles"
    files, root = filesystem(bundles)
    files.create_dir(root, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = None
        for batch in batches:
            placed = []
            for page, url, html, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                page, refers_to = None if pd.isna(page) else int(page), None if pd.isna(refers_to) else int(refers_to)
                if writer is None or writer.written >= bundle_bytes:
                    if writer:
                        writer.close()
                    writer = BundleWriter(bundles, frame_bytes)
                placed.append((page, *writer.add(build_record(page, url, html.encode("utf-8", "surrogatepass"), refers_to))))
            out = pd.DataFrame(placed, columns=["page_id", "bundle", "frame", "offset"])
            yield out.astype({"page_id": "Int64"})
        if writer:
            writer.close()

    rows.mapInPandas(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, html string"


def _page(identifier: str | None) -> int | None:
    return None if not identifier or identifier == "<urn:page:>" else int(identifier[len("<urn:page:") : -1])


def read_archive(index: DataFrame, folder: str, *, frames_a_task: int | None = None) -> DataFrame:
    """One row per record of the index, from the bundles: headers, and the block as ``html`` (null for a revisit).

    Frames are decompressed once, whole, and records are cut out at their offsets.  A task
    has the frames of one stretch of a bundle, of ``frames_a_task`` frames: as many as a
    scan's partition would hold.  A record that is not where the index says raises.
    """
    files, spark = filesystem(f"{folder}/bundles")[0], index.sparkSession
    if frames_a_task is None:
        frames_a_task = max(1, int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()) // FRAME_BYTES)
    stretches = index.withColumn("stretch", F.floor(F.col("frame") / frames_a_task))
    tasks = max(1, stretches.select("bundle", "stretch").distinct().count())
    # By ranges, so tasks have equal numbers of stretches and a stretch is never cut.
    frames = stretches.groupBy("bundle", "stretch", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets")).repartitionByRange(tasks, "bundle", "stretch").drop("stretch")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for batch in batches:
            for name, wanted in batch.groupby("bundle"):
                with files.open_input_file(name) as stream:
                    table = read_seek_table(stream)
                    for frame, offsets in zip(wanted["frame"], wanted["offsets"], strict=True):
                        at, packed, plain = table[frame]
                        stream.seek(at)
                        data, out = zstandard.ZstdDecompressor().decompress(stream.read(packed), max_output_size=plain), []
                        for offset in offsets:
                            headers, block, _ = parse_record(data, offset)
                            response = headers["WARC-Type"] == "response"
                            digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                            if response and digest32(block) != digest:
                                raise ValueError(f"{name}, frame {frame}, offset {offset}: the payload has another digest")
                            out.append((_page(headers["WARC-Record-ID"]), target_of(headers), headers["WARC-Type"], _page(headers.get("WARC-Refers-To")), digest, int(headers["Payload-Length"]), block.decode("utf-8", "surrogatepass") if response else None))
                        got = pd.DataFrame(out, columns=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "html"])
                        yield got.astype({"page_id": "Int64", "refers_to": "Int64"})

    return frames.mapInPandas(read, RECORD)


def fetch_record(index: DataFrame, folder: str, page_id: int) -> tuple[dict[str, str], bytes]:
    """One record by its id: a seek to its frame, no more.  Of several with that id, the first by bundle and place."""
    import zstandard

    row = index.where(F.col("page_id") == page_id).orderBy("bundle", "frame", "offset").first()
    if row is None:
        raise KeyError(page_id)
    with filesystem(f"{folder}/bundles")[0].open_input_file(row["bundle"]) as stream:
        at, packed, plain = read_seek_table(stream)[row["frame"]]
        stream.seek(at)
        headers, block, _ = parse_record(zstandard.ZstdDecompressor().decompress(stream.read(packed), max_output_size=plain), row["offset"])
        return headers, block


def sweep(index: DataFrame, folder: str) -> int:
    """Remove bundles that the index does not name; the number removed.  The names of an archive's files fit the driver: one per 256 MB."""
    from pyarrow import fs

    files, root = filesystem(f"{folder}/bundles")
    named = {r["bundle"].rsplit("/", 1)[-1] for r in index.select("bundle").distinct().collect()}
    stale = [f.path for f in files.get_file_info(fs.FileSelector(root)) if f.base_name not in named]
    for path in stale:
        files.delete_file(path)
    return len(stale)


def archive_digest(pages: DataFrame) -> DataFrame:
    """Write all pages, read them back, and give the contract's columns."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = write_archive(pages.select("page_id", "url", "html"), folder)
    return read_archive(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
