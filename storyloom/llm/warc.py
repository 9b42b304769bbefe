"""WARC archives with an embedded Zstandard dictionary, written and read by tasks.

Every archive begins with a skippable frame (magic 0x184D2A5D) that holds its dictionary, built from records of the
archive itself; every record is then one frame of its own, compressed with that dictionary, so that any record can be
read by its offset alone. Archives go to the shared folder. A task writes to a name of its own and moves the finished
archive to its place, and readers only open archives that a finished task has reported: a lost executor leaves nothing
that is read.

An archive's first record is a ``warcinfo``. A revisit names the record that it repeats (``WARC-Refers-To``); ids of
records follow from page, payload and type, so that rows repeated in full share one.

Defined cases: a null payload is empty; of rows with equal payloads those with the least page_id are responses and the
others revisits of it, so that a page_id with several payloads keeps each of them; rows with a null page_id are written
and returned with a null page_id, and are revisits unless no row with that payload has an id; repeated rows are records
of their own; other columns are ignored, whatever their names; an empty table gives an empty result and no archive.
Payloads are stored whole, however long.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import respread
from ..session import bound_batches, cut, fresh_path

MAGIC = 0x184D2A5D
LEVEL = 3
#: Bytes of the dictionary, of the records that it is built from at most, and of an archive about.
DICT_BYTES, SAMPLE_BYTES, ARCHIVE_BYTES = 64 << 10, 4 << 20, 64 << 20
#: Bytes of revisits that are broadcast to the writers (64 for a row's two ids and digest); beyond that they are joined
#: by a shuffle.
BROADCAST_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {kind}')}>"


def record(uri: str, payload: bytes, page_id: int | None, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block and names the record and the page whose payload it repeats."""
    kind, digest = "response" if refers_to is None else "revisit", sha1_base32(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, kind)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {''.join(uri.split())}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest, 'response')}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    block = payload if refers_to is None else b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The record that describes an archive."""
    block = b"format: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, name, 'warcinfo')}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}"]
    return "\r\n".join([*head, "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from the records: a trained one, or where training finds too little in them the last of their bytes as
    a dictionary of raw content."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def frames(records: Iterable[bytes]) -> Iterator[bytes]:
    """The archive: the dictionary's frame, then a frame for each record. The first records, up to a bound of bytes, are
    held back until the dictionary is built from them."""
    import zstandard

    rest, first, held = iter(records), [], 0
    for r in rest:
        first.append(r)
        held += len(r)
        if held >= SAMPLE_BYTES:
            break
    trained = dictionary(first)
    yield struct.pack("<II", MAGIC, len(trained)) + trained
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained))
    for part in (first, rest):
        for r in part:
            yield pack.compress(r)


def read_frames(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time, from a binary stream."""
    import zstandard

    magic, n = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("the archive has no dictionary frame")
    trained = stream.read(n)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    data, at_end = b"", False
    while True:
        if not data and not at_end:
            data = stream.read(1 << 20)
            at_end = not data
        if not data:
            return
        one, out = unpack.decompressobj(), []
        while True:
            out.append(one.decompress(data))
            if one.eof:
                data = one.unused_data
                break
            data = stream.read(1 << 20)
            if not data:
                raise ValueError("the archive ends within a record")
        yield b"".join(out)


def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _digest() -> Column:
    return F.unhex(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the rows whose payload a page of a lower id has. Only digests are shuffled."""
    keys = cut(pages.select("page_id", _digest().alias("digest")), "digests")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    again = keys.join(respread(firsts.drop("n")), "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return again.select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Write a record for each page (page_id, url, html) below ``root``; returns (path, records) of the archives."""
    bound_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", _digest().alias("digest"))
    again = cut(revisits(pages).select(F.col("page_id").alias("again"), F.col("digest").alias("same"), "refers_to"), "revisits")
    small = again.count() * 64 <= BROADCAST_BYTES
    rows = rows.join(F.broadcast(again) if small else again, F.col("page_id").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("same")), "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records() -> Iterator[bytes]:
            for frame in batches:
                for page, url, html, first in zip(frame["page_id"], frame["url"], frame["html"], frame["refers_to"], strict=True):
                    payload = html.encode() if isinstance(html, str) else b""
                    yield record(url if isinstance(url, str) else "", payload, None if pd.isna(page) else int(page), None if pd.isna(first) else int(first))

        done: list[tuple[str, int]] = []
        stream = records()
        one = next(stream, None)
        fs, base = _store(root)
        fs.create_dir(base, recursive=True)
        while one is not None:
            name = f"{uuid.uuid4().hex}.warc.zst"
            room, count = ARCHIVE_BYTES, 0

            def some() -> Iterator[bytes]:
                nonlocal one, count
                while one is not None and room > 0:
                    count += 1
                    now, one = one, next(stream, None)
                    yield now

            with fs.open_output_stream(f"{base}/{name}.part", compression=None) as out:
                for frame in frames(chain([info(name)], some())):
                    out.write(frame)
                    room -= len(frame)
            fs.move(f"{base}/{name}.part", f"{base}/{name}")
            done.append((f"{root}/{name}", count))
        yield pd.DataFrame(done, columns=["path", "records"])

    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))
    return rows.mapInPandas(write, "path string, records bigint")


def read_archives(spark, archives: DataFrame) -> DataFrame:
    """The pages' records of the archives: page_id, uri, record_type, payload_bytes, payload_digest, refers_to, payload.

    A response's length and digest are computed from its payload and held against its headers."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        for frame in batches:
            for path in frame["path"]:
                fs, name = _store(path)
                rows, held = [], 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for data in read_frames(stream):
                        head, block = parse(data)
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                        kind = head["WARC-Type"]
                        if kind == "response" and (len(block) != n or sha1_base32(block) != digest):
                            raise ValueError(f"the payload of {head['WARC-Record-ID']} does not match its digest")
                        page, first = head["X-Page-ID"], head.get("X-Refers-To-Page")
                        rows.append((int(page) if page else None, head["WARC-Target-URI"], kind, n, digest, int(first) if first else None, block))
                        held += len(block)
                        if held >= 8 << 20:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    spread = archives.select("path").repartition(max(1, archives.count()))
    return spread.mapInPandas(read, "page_id bigint, uri string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary")


def round_trip(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write the pages' archives, then read them back."""
    spark = pages.sparkSession
    archives = cut(write_archives(pages, root or fresh_path(spark, "warc")), "archives")
    return read_archives(spark, archives)
