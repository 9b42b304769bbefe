"""Fill-in-middle over stored frames: against a rule written out on plain strings, and frames against slices."""

import hashlib
import re

import zstandard
from pyspark.sql import functions as F

from storyloom.llm import fim

C, D = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
SCHEMA = "doc_id bigint, text string, n int, form string"


def by_rule(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return (doc_id, len(units), "plain", None, None, sha(text), sha(text), text)
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(units), form, len(p), len(m), sha(out), sha(text), out)


TEXTS = [
    None, "", "\n", "a", "a\n", "\n\n\n", "a\nb\nc", "a\r\nb c\u0085d\n", "héllo\nwörld 😀\n" * 7, "x" * 200_000, "é" * 70_000 + "\n" + "😀" * 50_000, "line\n" * 60_000,
    "has <P> in it\nb", "ends <M>", "<S>", "< P>\n<P\n>", "".join(f"{'w' * (k % 91)}\n" for k in range(9_000)) + "no end",
]


def test_rule(spark):
    rows = [(k if k != 3 else None, t, 5, "clash") for k, t in enumerate(TEXTS * 3)] + [(6, TEXTS[6], 0, None)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, fim.fill_in_middle(docs).collect()), key=str)
    assert got == sorted((by_rule(i, t)[:7] for i, t, *_ in rows), key=str)
    outputs = fim.output_texts(fim.transformed(fim.framed(docs))).select("doc_id", "output").collect()
    assert sorted(map(tuple, outputs), key=str) == sorted(((by_rule(i, t)[0], by_rule(i, t)[7]) for i, t, *_ in rows), key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert fim.fill_in_middle(docs).collect() == []


def test_frames_seek_like_slices():
    text = ("zeile\n" * 3 + "ü" * 50 + "\nlast, ohne Ende").encode()
    for size in (1, 2, 7, 64, 1000):
        stored = fim.Frames(fim.pack(text, C, size), D)
        lines = re.findall(r"[^\n]*\n|[^\n]+", text.decode())
        assert stored.units == len(lines)
        for u in range(len(lines) + 1):
            at, chars = stored.after_units(u)
            head = "".join(lines[:u])
            assert b"".join(stored.stream(stored.begin, at)).decode() == head and chars == len(head)
            again = fim.Frames(fim.blob(stored.frames(at, stored.end, C)), D)
            assert b"".join(again.stream(again.begin, again.end)).decode() == "".join(lines[u:])


def test_cut_frames_alone_are_decompressed():
    class Counting:
        def __init__(self):
            self.n = 0

        def decompress(self, x):
            self.n += 1
            return D.decompress(x)

    text = b"0123456\n" * 4096
    counting = Counting()
    stored = fim.Frames(fim.pack(text, C, 1024), counting)
    stored.after_units(2000)
    assert counting.n == 1
    at, _ = stored.after_units(2001)
    counting.n = 0
    list(stored.frames(at, stored.end, C))
    assert counting.n == 1


def test_blob_is_plain_zstandard():
    text = b"one\ntwo\n" * 50_000
    with zstandard.ZstdDecompressor().stream_reader(fim.pack(text, C), read_across_frames=True) as reader:
        assert reader.read() == text


def test_markers_across_frames():
    text = b"abc<S>def<P>ghi<M>"
    for size in range(1, 9):
        stored = fim.Frames(fim.pack(text, C, size), D)
        assert stored.find((b"<S>", b"<P>", b"<M>")) == [3, 9, 15]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = fim.fill_in_middle(docs)
    wanted = [by_rule(r.doc_id, r.text)[:7] for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)
    assert {r.form for r in got.groupBy("form").agg(F.count("*")).collect()} >= {"spm", "psm"}


def test_matches_sql(spark):
    from oracle import difference

    from storyloom.llm import queries

    sf = "/root/testdata/sf0.01"
    for name in ("op11_collocations", "op13_fim"):
        assert difference(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf) is None, name
