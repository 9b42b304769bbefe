"""Fill-in-middle transformation over texts that are stored as seekable compressed frames.

A stored text is a row of independent zstandard frames, each of :data:`FRAME_BYTES` of the text's UTF-8 at most, and a
skippable frame behind them with a table of each frame's compressed size, bytes, line ends and code points. Running sums
of that table tell which frame holds the end of any line, so that a cut decompresses one frame, not the text; frames
between two cuts are carried over as they are. Digests stream the frames in order, one decompressed at a time. Whole
blobs are plain zstandard to any other reader.

Lines are ``[^\\n]*\\n|[^\\n]+``. Defined cases: a null or empty text has no line and the form plain; a text that holds one
of the three markers is plain too, and plain texts are put out as they are. A null doc_id is drawn as an empty id. Rows
that repeat an id or a text are each transformed, every row by its own. Very long lines span frames. An empty table gives an
empty result. Other columns than doc_id and text, whatever their names, are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, cut

#: Most bytes of a text in a frame.
FRAME_BYTES = 64 << 10
LEVEL = 3
#: Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of the texts that can be cut: so many percent are, and so many of these put the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 100, 50
SEED = 7

#: Number of a skippable frame, by the zstandard format.
SKIPPABLE = 0x184D2A5E
# End of fixed values.
FIELDS = np.dtype([("packed", "<u4"), ("bytes", "<u4"), ("ends", "<u4"), ("chars", "<u4")])

Cut = tuple[int, int]


def _chars(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def frame(raw: bytes, compressor: zstandard.ZstdCompressor) -> tuple[bytes, tuple[int, int, int, int]]:
    """One frame and its row of the table."""
    packed = compressor.compress(raw)
    return packed, (len(packed), len(raw), raw.count(b"\n"), _chars(raw))


def blob(frames: Iterable[tuple[bytes, tuple[int, int, int, int]]]) -> bytes:
    """Frames, then the table of them in a skippable frame that ends with their number."""
    data, rows = [], []
    for packed, row in frames:
        data.append(packed)
        rows.append(row)
    table = np.array(rows, FIELDS).tobytes() + len(rows).to_bytes(4, "little")
    return b"".join((*data, SKIPPABLE.to_bytes(4, "little"), len(table).to_bytes(4, "little"), table))


def pack(text: bytes, compressor: zstandard.ZstdCompressor, size: int = FRAME_BYTES) -> bytes:
    return blob(frame(text[i : i + size], compressor) for i in range(0, len(text), size))


class Frames:
    """A stored text. A cut is a frame's number and an offset into its bytes; the end is one past the last frame."""

    def __init__(self, stored: bytes, decompressor: zstandard.ZstdDecompressor):
        self.stored, self.decompressor = stored, decompressor
        count = int.from_bytes(stored[-4:], "little")
        self.table = np.frombuffer(stored, FIELDS, count, len(stored) - 4 - count * FIELDS.itemsize)
        self.starts, self.bytes, self.ends, self.chars = ([0, *accumulate(map(int, self.table[k]))] for k in FIELDS.names)
        self.begin, self.end = (0, 0), (count, 0)

    def raw(self, k: int) -> bytes:
        return self.decompressor.decompress(self.stored[self.starts[k] : self.starts[k + 1]])

    @property
    def units(self) -> int:
        """Number of lines."""
        last = self.end[0] - 1
        return self.ends[-1] + (last >= 0 and not self.raw(last).endswith(b"\n"))

    def after_units(self, units: int) -> tuple[Cut, int]:
        """The cut behind the first so many lines, and the code points before it."""
        if units == 0:
            return self.begin, 0
        if units > self.ends[-1]:  # behind a last line without an end
            return self.end, self.chars[-1]
        k = int(np.searchsorted(self.ends, units)) - 1
        raw = self.raw(k)
        at = int(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)[units - self.ends[k] - 1]) + 1
        return (k, at), self.chars[k] + _chars(raw[:at])

    def at_byte(self, place: int) -> Cut:
        k = int(np.searchsorted(self.bytes, place, side="right")) - 1
        return (k, place - self.bytes[k])

    def stream(self, a: Cut, b: Cut) -> Iterator[bytes]:
        """The bytes from cut a to cut b, a frame at a time."""
        for k in range(a[0], min(b[0] + 1, self.end[0])):
            raw = self.raw(k) if k < b[0] or b[1] else b""
            yield raw[a[1] if k == a[0] else 0 : b[1] if k == b[0] else None]

    def frames(self, a: Cut, b: Cut, compressor: zstandard.ZstdCompressor) -> Iterator[tuple[bytes, tuple[int, int, int, int]]]:
        """Frames of the text from cut a to cut b: those that hold a cut are made anew, the rest carried over."""
        for k in range(a[0], min(b[0] + 1, self.end[0])):
            if k < b[0] and (k > a[0] or not a[1]):
                yield self.stored[self.starts[k] : self.starts[k + 1]], tuple(map(int, self.table[k]))
            elif k < b[0] or b[1]:
                if part := self.raw(k)[a[1] if k == a[0] else 0 : b[1] if k == b[0] else None]:
                    yield frame(part, compressor)

    def find(self, markers: tuple[bytes, ...], after: int = 0) -> list[int]:
        """Byte places of the markers, each the first one behind the one before."""
        found, place, tail, from_ = [], 0, b"", after
        for raw in self.stream(self.begin, self.end):
            seen = tail + raw
            base = place - len(tail)
            while len(found) < len(markers) and (at := seen.find(markers[len(found)], max(0, from_ - base))) >= 0:
                found.append(base + at)
                from_ = base + at + len(markers[len(found) - 1])
            place += len(raw)
            tail = seen[-2:]
        return found


    def holds(self, markers: tuple[bytes, ...]) -> bool:
        tail = b""
        for raw in self.stream(self.begin, self.end):
            seen = tail + raw
            if any(m in seen for m in markers):
                return True
            tail = seen[-2:]
        return False


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transform(doc_id: int | None, text: Frames, compressor: zstandard.ZstdCompressor) -> tuple[int, str, int | None, int | None, bytes]:
    """(lines, form, code points of prefix and middle, the output's frames) of a stored text."""
    n, (h1, h2, h3, h4) = text.units, draws(doc_id)
    if not n or h3 % 100 >= CUT_PERCENT or text.holds((PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text.stored
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    (first, before), (second, upto) = text.after_units(low), text.after_units(high)
    parts = {PREFIX: (text.begin, first), MIDDLE: (first, second), SUFFIX: (second, text.end)}
    form, order = ("spm", (SUFFIX, PREFIX, MIDDLE)) if h4 % 100 < SUFFIX_FIRST_PERCENT else ("psm", (PREFIX, SUFFIX, MIDDLE))
    out = blob(x for m in order for x in (frame(m, compressor), *text.frames(*parts[m], compressor)))
    return n, form, before, upto - before, out


def restore(output: Frames, form: str) -> Iterator[bytes]:
    """The text that an output was made of, a frame at a time: its markers are looked for and the parts read in order."""
    if form == "plain":
        yield from output.stream(output.begin, output.end)
        return
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    places = [*output.find(order), output.bytes[-1]]
    spans = {m: (output.at_byte(places[k] + len(m)), output.at_byte(places[k + 1])) for k, m in enumerate(order)}
    for m in (PREFIX, MIDDLE, SUFFIX):
        yield from output.stream(*spans[m])


def _sha256(parts: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def framed(docs: DataFrame) -> DataFrame:
    """(doc_id, frames): every text as a blob of frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(x.as_buffer().to_pybytes(), compressor) for x in batch.column(1)], pa.binary())], ["doc_id", "frames"])

    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).mapInArrow(run, "doc_id bigint, frames binary")


def transformed(store: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of a table of :func:`framed` texts; outputs are blobs too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, decompressor = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for batch in batches:
            rows = [transform(i.as_py(), Frames(x.as_buffer().to_pybytes(), decompressor), compressor) for i, x in zip(batch.column(0), batch.column(1), strict=True)]
            n, form, before, middle, out = zip(*rows, strict=True) if rows else ((),) * 5
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return store.select("doc_id", "frames").mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")


def output_texts(outputs: DataFrame) -> DataFrame:
    """The outputs as texts: ``output`` becomes a string, the other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor()
        for batch in batches:
            whole = (Frames(x.as_buffer().to_pybytes(), decompressor) for x in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(w.stream(w.begin, w.end)).decode() for w in whole], pa.string()), *batch.columns[1:]], names)

    rest = [c for c in outputs.columns if c != "output"]
    names = ["output", *rest]
    schema = ", ".join(["output string", *(f"`{c}` {outputs.schema[c].dataType.simpleString()}" for c in rest)])
    return outputs.select(*names).mapInArrow(run, schema)


def digests(outputs: DataFrame) -> DataFrame:
    """The rows of :func:`transformed` with output_sha256 and restored_sha256 in place of the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor()
        for batch in batches:
            whole = [Frames(x.as_buffer().to_pybytes(), decompressor) for x in batch.column(5)]
            out = [_sha256(w.stream(w.begin, w.end)) for w in whole]
            back = [_sha256(restore(w, form.as_py())) for w, form in zip(whole, batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.string()), pa.array(back, pa.string())], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    light = outputs.select(*names[:5], "output")
    return light.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string")


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """Texts are stored as frames in the shared folder, transformed from there, and outputs and what is rebuilt from them
    digested."""
    return digests(transformed(cut(framed(docs), "frames")))
