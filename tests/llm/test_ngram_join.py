"""The n-gram join against all pairs by brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelfx.llm import components as cc
from panelfx.llm import ngram_join, queries

from .fixtures import empty, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """Sorted (doc_id, class_id, n_links) of (doc_id, text) rows, by all pairs of distinct sets."""
    copies = defaultdict(list)
    for d, t in rows:
        copies[shingle_set(t)].append(d)
    sets = [s for s in copies if s]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    links, parent = Counter(), list(range(len(sets)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, s in enumerate(sets):
        for j, common in Counter(j for x in s for j in where[x] if j > k).items():
            if common >= 0.8 * (len(s) + len(sets[j]) - common):
                links[k] += len(copies[sets[j]])
                links[j] += len(copies[s])
                parent[max(top(k), top(j))] = min(top(k), top(j))
    classes = defaultdict(list)
    for k, s in enumerate(sets):
        classes[top(k)] += copies[s]
    named = {t: min((d for d in ds if d is not None), default=None) for t, ds in classes.items()}
    out = [(d, named[top(k)], links[k] + len(copies[s]) - 1) for k, s in enumerate(sets) for d in copies[s]]
    out += [(d, d, 0) for d in copies.get(frozenset(), [])]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(df).collect()), key=str)


def planted(spark):
    """A large group of near copies, a chain of drifting copies, and a passage in many short texts."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    rows, doc = [], 0
    seed = [word() for _ in range(200)]
    for _ in range(60):
        text = list(seed)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(200)] = word()
        rows.append((doc, " ".join(text)))
        doc += 1
    chain = [word() for _ in range(150)]
    for _ in range(12):
        chain = chain[4:] + [word() for _ in range(4)]
        rows.append((doc, " ".join(chain)))
        doc += 1
    passage = [word() for _ in range(30)]
    for _ in range(40):
        rows.append((doc, " ".join(passage + [word() for _ in range(rng.randint(0, 60))])))
        doc += 1
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("block", [256, 7])
def test_planted_groups(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    df = planted(spark)
    assert result(df) == brute([tuple(r) for r in df.collect()])


def test_odd_rows(spark):
    df = odd(spark)
    assert result(df) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert ngram_join.near_duplicates(empty(spark)).count() == 0
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    sets = Counter(shingle_set(r.text) for r in kept.collect() if r.doc_id is not None and r.doc_id != 8)
    assert all(n == 1 for s, n in sets.items() if s)


def test_given_documents(spark):
    df = queries.table(spark, "/root/testdata/sf0.01", "documents")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert result(df) == want
    assert ngram_join.one_of_each(df).count() == len({c for _, c, _ in want})


def test_two_classes_under_one_doc_id(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(3, b, 0), (5, a, 1), (5, b + " more", 2), (9, a + " more", 3), (None, a, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    assert {r.row for r in ngram_join.one_of_each(df).collect()} == {0, 1, 4}


def test_near_copies_store_no_pairs(spark, monkeypatch):
    """What the passes write grows with members and blocks, not with pairs."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base[:60] + [f"x{rng.random()}"] + base[60:])) for k in range(900)]
    written = {}
    keep = ngram_join.stored

    def measured(table, label):
        out = keep(table, label)
        written[label] = out
        return out

    monkeypatch.setattr(ngram_join, "stored", measured)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 899)}
    assert "partners" not in written["ngram-candidates"].columns
    blocks = -(-900 // ngram_join.BLOCK)
    assert written["ngram-candidates"].count() <= 900 * ngram_join.BANDS * blocks


def test_linked_parts():
    i, j = np.array([0, 4, 2, 7, 8]), np.array([1, 2, 3, 8, 9])
    assert ngram_join.smallest_linked(i, j, 11) == [0, 0, 2, 2, 2, 5, 6, 7, 7, 7, 10]


def test_least_matches_follow_the_posterior():
    least = ngram_join.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(2)
    for n, m in least.items():
        draws = rng.beta(m + 1, n - m + 1, 200_000)
        assert 0 <= m <= n and (m == 0 or (draws >= 0.8).mean() < 1e-3)
    assert list(least.values()) == sorted(least.values())


def test_shared_counts_in_parts(monkeypatch):
    monkeypatch.setattr(ngram_join, "CELLS", 60)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 200, rng.integers(1, 90)).astype(np.uint64)) for _ in range(12)]
    got = ngram_join.shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2000 + k) for k in range(60)]
    parent = {}

    def top(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: top(k) for a, b in edges if a != b for k in (a, b)}
