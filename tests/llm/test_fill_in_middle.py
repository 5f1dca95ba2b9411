"""Fill-in-the-middle against plain slicing."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from panelfx.llm import fill_in_middle as fim
from panelfx.llm import queries

from .fixtures import empty, odd

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_outputs_and_round_trip(spark):
    marks = spark.createDataFrame([(k, t) for k, t in enumerate(["a <P> b", "<S>", "x<M>", "<", "<S <P <M", "P> S> M>", "<<P", "a<S b<P c<M d<"] * 30)], "doc_id long, text string")
    for df in (queries.table(spark, SF, "documents"), odd(spark), marks):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        done = fim.transformed(df)
        back = done.withColumn("restored", fim.restored(done.output, done.form)).collect()
        assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in back) == Counter(
            (d, *plain(d, t), t or "") for d, t in rows)
    assert fim.transformed(empty(spark)).collect() == []


def test_forms_occur(spark):
    forms = {r.form for r in fim.transformed(queries.table(spark, SF, "documents")).collect()}
    assert forms == {"plain", "psm", "spm"}


def texts():
    rng = np.random.default_rng(1)
    yield b""
    yield b"   "
    yield b"a"
    yield b" a "
    yield b"\n".join([b"word"] * 5000)
    yield b" ".join(b"x" * int(n) for n in rng.integers(1, 12, 3000))
    yield b" ".join(b"y" * int(n) for n in rng.choice([1, 4000], 300, p=[0.95, 0.05]))
    yield " ".join(["日本", "é", "z"] * 700).encode() + b" \t\n"


@pytest.mark.parametrize("block", [1, 7, 1 << 10, 1 << 20])
def test_rank_index_is_exact(block):
    for text in texts():
        index = fim.RankIndex(np.frombuffer(text, np.uint8), block=block)
        ends = [0, *(m.end() for m in re.finditer(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text))]
        assert index.size == len(ends) - 1
        assert [index[k] for k in range(len(ends))] == ends
        for bad in (-1, len(ends)):
            with pytest.raises(IndexError):
                index[bad]


def test_segments_keep_their_error_bound():
    x = np.cumsum(np.random.default_rng(2).integers(1, 60, 20_000))
    for error in (1, 16, 127):
        starts, offsets, slopes, rest = fim.straight(x, error)
        assert np.abs(rest).max() <= error and starts[0] == 0 and (np.diff(starts) > 0).all()
        k = np.searchsorted(starts, np.arange(len(x)), side="right") - 1
        assert (offsets[k] + np.floor(slopes[k] * (np.arange(len(x)) - starts[k])).astype(int) + rest == x).all()
    even = fim.straight(np.arange(4096) * 7 + 3, 0)
    assert len(even[0]) == 1  # a straight line is one segment
    assert len(fim.straight(x, 127)[0]) < len(x) / 20
