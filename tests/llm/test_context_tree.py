"""Context-tree weighting against a plain recursive one, and the unigram base by counting."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from panelfx.llm import context_tree as ct
from panelfx.llm import queries

from .fixtures import empty, odd


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


class PlainTree:
    """Counts of every (depth, context, decision); P_w by recursion."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for text in texts:
            for context, byte in self.symbols(text):
                node = 1
                for k in range(7, -1, -1):
                    bit = byte >> k & 1
                    for d in range(6):
                        self.n[context[5 - d:], node][bit] += 1
                        if d:
                            self.children[context[6 - d:], node].add(context[5 - d:])
                    node = node * 2 + bit
        self.memo = {}

    @staticmethod
    def symbols(text):
        line = b"\xff" * 5 + lowered(text).encode() + b"\xff"
        for i in range(5, len(line)):
            yield line[i - 5:i], line[i]

    def log_kt(self, key):
        a, b = self.n.get(key, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_w(self, context, node):
        key = context, node
        if key not in self.memo:
            kt = self.log_kt(key)
            below = sum(self.log_w(c, node) for c in self.children.get(key, ()))
            self.memo[key] = kt if len(context) == 5 else (np.logaddexp(kt, below) - math.log(2), kt, below)[0]
        return self.memo[key]

    def one(self, context, node, depth=0):
        here = context[5 - depth:]
        a, b = self.n.get((here, node), (0, 0))
        estimate = (b + 0.5) / (a + b + 1)
        if depth == 5 or sum(self.n.get((context[4 - depth:], node), (0, 0))) == 0:
            return estimate
        kt = self.log_kt((here, node))
        below = sum(self.log_w(c, node) for c in self.children.get((here, node), ()))
        own = 1 / (1 + math.exp(min(700, below - kt)))
        return own * estimate + (1 - own) * self.one(context, node, depth + 1)

    def score(self, text):
        total = 0.0
        for context, byte in self.symbols(text):
            node = 1
            for k in range(7, -1, -1):
                bit = byte >> k & 1
                p = self.one(context, node)
                total += math.log10(p if bit else 1 - p)
                node = node * 2 + bit
        return total


def base_scores(rows):
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) + [""]
    c = Counter(w for d, t in rows if not is_held_out(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(d, is_held_out(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
             sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for d, t in rows]


def compare_base(got, rows):
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 6))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    want = sorted(base_scores(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


@pytest.mark.parametrize("chunk_bytes", [ct.CHUNK_BYTES, 700])
def test_odd_rows_by_plain_tree(spark, chunk_bytes):
    df = odd(spark)
    rows = [(r.doc_id, r.text if r.text is None else r.text[:400]) for r in df.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tree = PlainTree([t for d, t in rows if not is_held_out(d)])
    want = sorted((str(d), round(tree.score(t), 6)) for d, t in rows)
    for hot in (ct.HOT, 60, 2):  # with subtrees of two bytes, of up to four, and of up to five
        got = ct.scores(df, chunk_bytes, hot).collect()
        compare_base(got, rows)
        assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == want


def test_subtrees_are_bounded(spark):
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers(0, 1 << 10, 40_000) | (1 << 16))  # few contexts hold nearly all
    df = spark.createDataFrame([(int(g), 1) for g in grams], "gram long, n long")
    for hot in (1000, 50, 10):
        sizes = ct.subtrees(df, hot).groupBy("top", "subtree").count().collect()
        assert sum(r["count"] for r in sizes) == len(grams) and all(r["count"] <= hot or r.top == ct.DEPTH for r in sizes)


def test_given_documents(spark):
    df = queries.table(spark, "/root/testdata/sf0.001", "documents")
    got = ct.scores(df, 100_000).collect()
    compare_base(got, [(r.doc_id, r.text) for r in df.collect()])
    assert ct.scores(df, 30_000).count() == len(got)
    assert ct.scores(empty(spark)).count() == 0


def test_held_out_code_length(spark):
    got = ct.scores(queries.table(spark, "/root/testdata/sf0.01", "documents")).collect()
    held = [r for r in got if r.held_out and r.n_tokens > 50]
    train = [r for r in got if not r.held_out and r.n_tokens > 50]
    mean = lambda rows: sum(r.bits_per_byte for r in rows) / len(rows)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # better than unigrams on unseen texts
    assert mean(train) < mean(held) < 2.5


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    seen = rng.integers(0, 4, (300, 6)).astype(np.uint64) + np.uint64(97)
    seen[:, 3:5] = 98  # one subtree
    context = seen[0, :5]
    every = [context.tolist() + [b] for b in range(256)]
    rows = np.unique(np.array(every + seen.astype(int).tolist()), axis=0).astype(np.uint64)
    grams = np.zeros(len(rows), np.uint64)
    for k in range(6):
        grams = grams << np.uint64(8) | rows[:, k]
    counts = np.where((rows[:, 5] >= 97) & (rows[:, 5] < 101), 3, 0)
    tree = ct.Subtree(grams, counts)
    keys, zeros, ones, log_w = tree.roots()
    import pandas as pd
    above = ct.upper_tables(pd.DataFrame({"context": ((keys >> np.uint64(8)) & np.uint64(255)).astype(int), "node": (keys & np.uint64(255)).astype(int),
                                          "zeros": zeros, "ones": ones, "below": log_w}))
    p = 10 ** tree.log10(above, {}, grams)
    mine = (rows[:, :5] == context).all(axis=1)
    assert mine.sum() == 256 and p[mine].sum() == pytest.approx(1.0)


def test_helpers():
    x = np.array([0.5, 1, 1.5, 7.9, 8, 100.5, 1e6, 1e12])
    assert np.allclose(ct.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 48, 5000).astype(np.uint64))
    lookup = ct.Lookup(keys)
    assert (lookup(keys[::-1]) == np.arange(len(keys))[::-1]).all() and (lookup(keys + np.uint64(1 << 50)) == -1).all()
    grams, edges = ct.grams_of(pa.array(["Ab", None, "c"]))
    assert edges.tolist() == [0, 3, 4, 6]
    assert [int(g).to_bytes(6, "big") for g in grams] == [b"\xff" * 5 + b"a", b"\xff" * 4 + b"ab", b"\xff" * 3 + b"ab\xff", b"\xff" * 6, b"\xff" * 5 + b"c", b"\xff" * 4 + b"c\xff"]
