"""WARC archives with a two-level capture index: compressed blocks of sorted keys below a sparse block directory.

Keys are reversed hosts with paths. Each task that knows its pages' kinds writes one archive and returns where each
record lies; only these places are dealt by key ranges and sorted into blocks, with a directory of the blocks for each
range. A look-up finds the range and then the block by binary search, reads that block's bytes and finds the entry in it
by binary search; the places found are then sorted by archive, so that records that follow each other are read at once.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, make_dirs, materialize, open_store, partitions, scratch

BLOCK = 512
SPAN, GAP = 8 << 20, 64 << 10  # bytes read at once, and bytes between records that such a read may skip


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, port dropped, then path and query; lower-case host. Null: empty."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").split(".")
    except ValueError:
        return f"!){url}"
    return ",".join(reversed(host)) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record in its own gzip member. A revisit has no payload; its full length is an extension field."""
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [f"WARC-Type: {kind}", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + payload
    text = "\r\n".join(["WARC/1.1", *head, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"])
    press = zlib.compressobj(3, zlib.DEFLATED, 31)
    return press.compress(text.encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + press.flush()


def parse(member: bytes) -> dict:
    """Fields of a record as written by :func:`record`, and its payload (empty for revisits)."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields | {"payload": body.partition(b"\r\n\r\n")[2]}


_PLACES = "url_key string, tie string, archive string, at long, length long"


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        name, at, archive = uuid.uuid4().hex, 0, None  # of this attempt; only names that a finished attempt returns are ever read
        for batch in batches:
            placed: list[tuple] = []
            for row in batch.to_pylist():
                if archive is None:
                    archive = store.open_output_stream(f"{base}/{name}.warc.gz", compression=None)
                data = record(row["kind"], row["page_id"], row["url"], (row["html"] or "").encode(), row["digest"], row["refers_to"])
                archive.write(data)
                placed.append((url_key(row["url"]), row["tie"], name, at, len(data)))
                at += len(data)
            if placed:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*placed, strict=True)], names=["url_key", "tie", "archive", "at", "length"])
        if archive is not None:
            archive.close()

    return run


def _index(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        name = uuid.uuid4().hex
        at, entries, directory, index = 0, [], [], None

        def close_block() -> None:
            nonlocal at
            block = zlib.compress("\n".join(json.dumps(e) for e in entries).encode(), 6)
            index.write(block)
            directory.append([entries[0][:2], at, len(block)])
            at += len(block)
            entries.clear()

        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if index is None:
                    index = store.open_output_stream(f"{base}/{name}.cdx", compression=None)
                entries.append(list(entry))
                if len(entries) == BLOCK:
                    close_block()
        if index is not None:
            if entries:
                close_block()
            index.close()
            with store.open_output_stream(f"{base}/{name}.dir", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory).encode(), 6))
            yield pa.RecordBatch.from_pydict({"name": [name], "first_key": [directory[0][0][0]], "first_tie": [directory[0][0][1]]})

    return run


def decide(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html, digest, kind and refers_to. Of equal payloads of at least ``least`` bytes the largest page_id
    is the response. Rows that repeat that id are responses, too."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).withColumn("size", F.octet_length(F.coalesce("html", F.lit(""))))
    heads = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").select("digest", "size", "head")
    rows = rows.join(heads, ["digest", "size"], "left")
    again = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    return rows.select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("head")).alias("refers_to"))


_FETCHED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _opened(member: bytes) -> tuple:
    """The columns of ``_FETCHED`` of a record; a payload that doesn't fit its digest raises."""
    found = parse(member)
    page, ref = found["WARC-Record-ID"][10:-1], found.get("WARC-Refers-To", "<urn:page:>")[10:-1]
    full, digest = int(found["X-Payload-Length"]), found["WARC-Payload-Digest"][5:]
    if found["WARC-Type"] == "response" and (len(found["payload"]) != full or hashlib.sha1(found["payload"]).hexdigest() != digest):
        raise ValueError(f"damaged record of page {page}")
    return (None if page == "None" else int(page), found["WARC-Target-URI"], found["payload"], full, digest, found["WARC-Type"], int(ref) if ref not in ("", "None") else None)


def _read(root: str):
    """Records at sorted places (archive, at, length), neighbours of at most ``SPAN`` bytes with one read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        name, archive = None, None
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            i = 0
            while i < len(places):
                if places[i][0] != name:
                    name = places[i][0]
                    archive = store.open_input_file(f"{base}/{name}.warc.gz")
                start, end, j = places[i][1], places[i][1] + places[i][2], i + 1
                while j < len(places) and places[j][0] == name and places[j][1] <= end + GAP and places[j][1] + places[j][2] - start <= SPAN:
                    end = max(end, places[j][1] + places[j][2])
                    j += 1
                data = archive.read_at(end - start, start)
                rows, held = [], 0
                for _, at, length in places[i:j]:
                    rows.append(_opened(data[at - start : at - start + length]))
                    held += len(rows[-1][2])
                    if held > SPAN:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FETCHED, strict=True)], schema=_FETCHED)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FETCHED, strict=True)], schema=_FETCHED)
                i = j

    return run


class Archive:
    """Archives and index below ``root`` and the index's bounds: (first key, first tie, name) of each key range."""

    def __init__(self, root: str, bounds: list[tuple[str, str, str]]) -> None:
        self.root, self.bounds = root, sorted(bounds)

    def locate(self, requests: DataFrame) -> DataFrame:
        """archive, at and length of the records of ``requests`` (url_key, tie: any number of captures); a missing key
        gives no row. Requests are dealt and sorted like the index, so successive ones share blocks."""
        root, bounds = self.root, self.bounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = open_store(root)
            firsts = [(k, t) for k, t, _ in bounds]
            part, block_no, directory, block, index = -1, -1, [], [], None
            for batch in batches:
                found: list[list] = []
                for want in zip(batch.column("url_key").to_pylist(), batch.column("tie").to_pylist(), strict=True):
                    p = bisect.bisect_right(firsts, want) - 1
                    if p < 0:
                        continue
                    if p != part:
                        part, block_no = p, -1
                        with store.open_input_file(f"{base}/{bounds[p][2]}.dir") as f:
                            directory = json.loads(zlib.decompress(f.read()))
                        index = store.open_input_file(f"{base}/{bounds[p][2]}.cdx")
                    b = bisect.bisect_right(directory, list(want), key=lambda d: d[0]) - 1
                    if b != block_no:
                        block_no = b
                        block = [json.loads(x) for x in zlib.decompress(index.read_at(directory[b][2], directory[b][1])).split(b"\n")]
                    e = bisect.bisect_left(block, list(want), key=lambda x: x[:2])
                    if e < len(block) and block[e][:2] == list(want):
                        found.append(block[e][2:])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["archive", "at", "length"])

        dealt = requests.repartitionByRange(partitions(requests.sparkSession), "url_key", "tie").sortWithinPartitions("url_key", "tie")
        return in_arrow(dealt, run, "archive string, at long, length long")

    def fetch(self, requests: DataFrame) -> DataFrame:
        """Records of ``requests``, found by :meth:`locate`, as page_id, url, payload, payload_bytes, payload_digest,
        record_type, refers_to. Places are written, then dealt by ranges of archives, which are read front to back."""
        places = materialize(self.locate(requests), "warc-places")
        dealt = places.repartitionByRange(partitions(places.sparkSession), "archive", "at").sortWithinPartitions("archive", "at")
        return in_arrow(dealt, _read(self.root), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _ties(rows: DataFrame) -> DataFrame:
    """A text that tells captures of one key apart: the page_id, zero-padded, then a hash of the payload."""
    return rows.withColumn("tie", F.concat(F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0"), F.lit("-"), F.col("digest")))


def write_archive(pages: DataFrame, spark: SparkSession) -> tuple[Archive, DataFrame]:
    """Write one record per row of ``pages`` (page_id, url, html) and the index; also the keys of all captures.

    Null html is an empty payload, a null url an empty target; rows that repeat page_id, url and html are written each
    and found once for each request. Other columns are ignored. An empty table gives no archive."""
    root = scratch(spark, "warc")
    make_dirs(spark, root)
    places = materialize(in_arrow(_ties(decide(pages)), _write(root), _PLACES), "warc-written")
    dealt = places.repartitionByRange(partitions(spark), "url_key", "tie").sortWithinPartitions("url_key", "tie")
    parts = materialize(in_arrow(dealt, _index(root), "name string, first_key string, first_tie string"), "warc-parts")
    bounds = [(r["first_key"], r["first_tie"], r["name"]) for r in parts.collect()]
    return Archive(root, bounds), places.select("url_key", "tie")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read back through the index."""
    archive, keys = write_archive(pages, pages.sparkSession)
    return archive.fetch(keys).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
