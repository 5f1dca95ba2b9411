"""Compact windows and repeated passages against brute force."""

import random
import re
import time

import numpy as np
import pyarrow as pa

from panelfx.llm import compact_windows as cw
from panelfx.llm import queries

from .fixtures import empty, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(1)
    for values in (40, 1 << 60):
        h = rng.integers(1, values, 400).astype(np.uint64)
        edges = np.array([0, 3, 3, 150, 155, 400])
        want = set()

        def grow(a, b):
            if b - a < 6:
                return
            c = a + int(np.argmin(h[a:b]))
            want.add((c, a, b - 1))
            grow(a, c)
            grow(c + 1, b)

        for a, b in zip(edges[:-1], edges[1:]):
            grow(int(a), int(b))
        assert set(zip(*(x.tolist() for x in cw.tree_windows(h, edges, 6)))) == want


def test_repeated_values_leave_their_outermost_windows():
    h = np.array([5, 9, 5, 9, 5, 9, 1, 9, 5, 9, 5, 9], np.uint64)
    c, left, right = cw.tree_windows(h, np.array([0, 12]), 2)
    keep = cw.outermost(np.zeros(len(c), int), h[c].view(np.int64), c, right)
    assert set(zip(c[keep], left[keep], right[keep])) == {(0, 0, 5), (6, 0, 11), (8, 7, 11)}


def test_every_long_run_has_one_window():
    h = np.random.default_rng(2).integers(1, 1 << 60, 120).astype(np.uint64)
    c, left, right = cw.tree_windows(h, np.array([0, 120]), 10)
    for i in range(120):
        for j in range(i + 9, 120):
            hits = (left <= i) & (i <= c) & (c <= j) & (j <= right)
            assert hits.sum() == 1 and h[c[hits][0]] == h[i:j + 1].min()


def prose(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n)]


def planted(spark):
    """Documents of own words with shared passages; returns them and {(source, doc): passage words}."""
    rng = random.Random(3)
    exact, near, short, hot = prose(rng, 60), prose(rng, 90), prose(rng, 45), prose(rng, 55)
    rows, want = [], {}
    for k in range(40):
        words = prose(rng, rng.randint(20, 200))
        at = rng.randint(0, len(words))
        if k in (2, 7, 8):
            words[at:at] = exact
            want |= {(2, k): 60} if k > 2 else {}
        elif k in (11, 12):
            words[at:at] = near if k == 11 else [w if i != 30 else "changed" for i, w in enumerate(near)]
            want |= {(11, 12): 90} if k == 12 else {}
        elif k in (15, 16):
            words[at:at] = short
        elif k >= 20:
            words[at:at] = hot
            want |= {(20, k): 55} if k > 20 else {}
        rows.append((k, "\n".join(words) if k % 3 else "  " + " ".join(words).upper()))
    return spark.createDataFrame(rows, "doc_id long, text string"), want, dict(rows)


def test_planted_passages(spark):
    df, want, texts = planted(spark)
    got = cw.repeated_passages(df).collect()
    assert {(r.source_id, r.doc_id): r.end_word - r.start_word for r in got} == want
    for r in got:
        own, other = low_words(texts[r.doc_id])[r.start_word:r.end_word], low_words(texts[r.source_id])[r.source_start:r.source_end]
        x, y = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (own, other))
        assert abs(r.similarity - len(x & y) / len(x | y)) < 1e-12 and r.similarity >= 0.8


def test_cut_documents(spark):
    df, want, texts = planted(spark)
    got = {r.doc_id: r.text for r in cw.without_repeats(df).collect()}
    cut = {d: n for (_, d), n in want.items()}
    for d, t in texts.items():
        assert len(WORD.findall(got[d])) == len(WORD.findall(t)) - cut.get(d, 0)
        if d not in cut:
            assert got[d] == t


def maximal_repeats(rows, least=50):
    """(doc, word) places inside word-for-word runs of ``least`` words that an earlier document has."""
    first, out = {}, set()
    for d, t in sorted(rows):
        words = low_words(t)
        for i in range(len(words) - least + 1):
            run = tuple(words[i:i + least])
            if first.setdefault(run, d) != d:
                out |= {(d, i + k) for k in range(least)}
    return out


def test_given_documents(spark):
    df = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    texts = dict(rows)
    got = cw.repeated_passages(df).collect()
    found = {(r.doc_id, k) for r in got for k in range(r.start_word, r.end_word)}
    exact = maximal_repeats(rows)
    assert len(exact - found) <= 0.001 * len(exact)
    for r in got:
        own, other = low_words(texts[r.doc_id])[r.start_word:r.end_word], low_words(texts[r.source_id])[r.source_start:r.source_end]
        assert r.source_id < r.doc_id and len(own) >= 50
        x, y = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (own, other))
        assert len(x & y) >= 0.8 * len(x | y)


def test_segments_with_two_far_sources():
    rng = np.random.default_rng(6)
    a, b, filler = (rng.integers(1, 1 << 60, n).astype(np.uint64) for n in (60, 60, 5000))
    own, source = np.concatenate((a, b)), np.concatenate((b, filler, a))
    found = cw.segments(source, own, np.ones(len(own), bool), 46, 0.8)
    assert [x[:4] for x in found] == [(0, 59, 5060, 5119), (60, 119, 0, 59)]
    assert cw.segments(source, own[30:90], np.ones(60, bool), 46, 0.8) == []


def values(seed, *sizes):
    rng = np.random.default_rng(seed)
    return [rng.integers(1, 1 << 60, n).astype(np.uint64) for n in sizes]


def test_segments_with_a_changed_middle():
    # 64 words and 6 put in, 98 and 14 put in, 103 with 7 replaced
    for size, lost, new in ((28, 4, 10), (45, 4, 18), (44, 11, 11)):
        left, right, lost, more, front, back = values(7, size, size, lost, new, 300, 300)
        plain, changed = np.concatenate((left, lost, right)), np.concatenate((left, more, right))
        for own, other in ((changed, plain), (plain, changed)):
            own, other = np.concatenate((front, own, back)), np.concatenate((back[:7], other, front[:9]))
            found = cw.segments(other, own, np.ones(len(own), bool), 46, 0.8)
            assert [x[:4] for x in found] == [(300, len(own) - 301, 7, len(other) - 10)] and found[0][4] >= 0.8


def test_segments_whose_parts_stand_earlier():
    passage, filler, front, back = values(9, 46, 50, 300, 300)
    own = np.concatenate((front, passage, back))
    for earlier in ([passage[:10]], [passage[-10:]], [passage[:25], filler[:9], passage[20:]]):
        source = np.concatenate((*earlier, filler, passage, filler))
        at = len(source) - 96
        found = cw.segments(source, own, np.ones(len(own), bool), 46, 0.8)
        assert [x for x in found] == [(300, 345, at, at + 45, 1.0)]


def test_fragment_in_the_first_document(spark):
    rng = random.Random(11)
    rows = []
    for k in range(120):
        passage = prose(rng, rng.choice((50, 55, 60)))
        size = rng.choice((30, 40, 45, 49))
        at = rng.randint(0, len(passage) - size)
        for part in (passage[at:at + size], passage, passage):
            words, x = prose(rng, 150), rng.randint(0, 150)
            rows.append((len(rows), " ".join(words[:x] + part + words[x:])))
    exact = maximal_repeats(rows)
    assert {d for d, _ in exact} == set(range(2, 360, 3))
    got = cw.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert exact <= {(r.doc_id, k) for r in got for k in range(r.start_word, r.end_word)}


def templated(rng, lines, own):
    """A page whose every ``own``-th five-gram opens the same line of 24."""
    line = rng.integers(1, 1 << 60, 24).astype(np.uint64)
    return line, lambda seed: np.concatenate([x for g in np.random.default_rng(seed).integers(1, 1 << 60, (lines, own)).astype(np.uint64) for x in (line, g)])


def test_templated_pair_takes_under_a_second():
    rng = np.random.default_rng(21)
    passage = rng.integers(1, 1 << 60, 60).astype(np.uint64)
    for own in (30, 26, 8, 4):  # the line alone is no passage; with 8 five-grams between, three in four agree
        _, page = templated(rng, 20_000 // (24 + own), own)
        a, b = page(1), page(2)
        a[5003:5063] = passage
        b[9001:9061] = passage
        begun = time.process_time()
        found = cw.segments(a, b, np.ones(len(b), bool), 46, 0.8)
        assert time.process_time() - begun < 1
        assert any(x[0] <= 9001 and x[1] >= 9060 for x in found) and len(found) < 3
    same = np.full(20_000, 7, np.uint64)
    begun = time.process_time()
    assert cw.segments(same, same[:15_000], np.ones(15_000, bool), 46, 0.8)[0][4] == 1.0
    assert time.process_time() - begun < 1


def test_votes_by_convolution_are_the_pairs(monkeypatch):
    rng = np.random.default_rng(13)
    source, own = rng.integers(1, 5, 300).astype(np.uint64), rng.integers(1, 6, 200).astype(np.uint64)
    places = cw.Places(cw.Index(source), own)
    p = np.flatnonzero(places.hi > places.lo)
    want = np.zeros(len(own) + len(source) + 1, int)
    for i in p:
        for j in np.flatnonzero(source == own[i]):
            want[j - i + len(own)] += 1
    for pairs in (1 << 20, 100, 1):
        monkeypatch.setattr(cw, "PAIRS", pairs)
        assert (places.votes(p, len(own)) == want).all()


def changed(rng, passage):
    """A passage of the same meaning with a few words replaced, put in or left out, still of similarity 0.8."""
    words = list(passage)
    while True:
        other, spot = list(words), rng.randrange(len(words))
        kind = rng.choice(("replace", "insert", "delete"))
        other[spot:spot + (kind != "insert")] = prose(rng, rng.randint(1, 3)) if kind != "delete" else []
        x, y = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (passage, other))
        if len(x & y) < 0.8 * len(x | y) or len(other) < 50:
            return words
        words = other


def test_similar_passages_of_200_documents(spark):
    rng = random.Random(17)
    rows, want = [], {}
    for k in range(100):
        passage = prose(rng, rng.randint(55, 160))
        for part in (passage, changed(rng, passage)):
            words, x = prose(rng, 150), rng.randint(0, 150)
            want[len(rows)] = (x, x + len(part))
            rows.append((len(rows), " ".join(words[:x] + part + words[x:])))
    got = cw.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {d: {k for r in got if r.doc_id == d for k in range(r.start_word, r.end_word)} for d in range(1, 200, 2)}
    whole = [len(found[d] & set(range(*want[d]))) >= 0.8 * (want[d][1] - want[d][0]) for d in found]
    assert sum(whole) >= 90, sum(whole)
    assert all(len(found[d] - set(range(want[d][0] - 2, want[d][1] + 2))) == 0 for d in found)
    assert {r.doc_id % 2 for r in got} == {1} and all(r.source_id == r.doc_id - 1 for r in got)


def test_similar_passages_whose_first_document_has_a_fragment(spark):
    rng = random.Random(29)
    rows, want = [], set()
    for k in range(60):
        passage = prose(rng, rng.randint(55, 120))
        at = rng.randint(0, len(passage) - 45)
        for part in (passage[at:at + 45], passage, changed(rng, passage)):
            words, x = prose(rng, 150), rng.randint(0, 150)
            rows.append((len(rows), " ".join(words[:x] + part + words[x:])))
        want.add((len(rows) - 2, len(rows) - 1))
    got = cw.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.source_id, r.doc_id) for r in got} == want


def test_blocks_of_a_key_meet_all_others(spark, monkeypatch):
    rng = random.Random(31)
    line, passages = prose(rng, 30), [prose(rng, 60) for _ in range(4)]
    rows = [(k, " ".join(prose(rng, 40) + line + (passages[k % 4][:59] + [f"end{k}"] if k > 11 else prose(rng, 60)) + prose(rng, 40))) for k in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def passages_of():
        return {tuple(r) for r in cw.repeated_passages(df).collect()}

    want = passages_of()
    assert {r[0] for r in want} >= set(range(16, 24))
    monkeypatch.setattr(cw, "BLOCK", 2)
    assert passages_of() == want


def test_a_common_line_pairs_no_other_documents(spark, monkeypatch):
    rng = random.Random(37)
    line, passage = prose(rng, 13), prose(rng, 60)
    rows = [(k, " ".join(line + (prose(rng, 1) * 60 if k % 2 else prose(rng, 60)))) for k in range(80)]
    rows += [(k, " ".join(line + part + prose(rng, 30))) for k, part in ((80, passage), (81, passage[:59] + ["end"]), (82, changed(rng, passage)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, inner = [], cw.compared

    def counted(documents, found, *options):
        pairs.append({(r.source, r.doc_id) for r in found.collect()})
        return inner(documents, found, *options)

    monkeypatch.setattr(cw, "compared", counted)
    want = {tuple(r) for r in cw.repeated_passages(df).collect()}
    assert {81, 82} <= {r[0] for r in want} and all(r[3] >= 80 for r in want)
    assert not [x for x in pairs[-1] if min(x) < 80 and (min(x) % 2 == 0 or max(x) >= 80 or max(x) % 2 == 0)]  # of a repeated word and another text
    monkeypatch.setattr(cw, "CROWD", 2)
    assert {tuple(r) for r in cw.repeated_passages(df).collect()} == want


def test_least_distinct_values_of_runs():
    rng = np.random.default_rng(41)
    for _ in range(200):
        x, width = rng.integers(0, 12, rng.integers(8, 40)).astype(np.uint16), 8
        low, high = sorted(rng.integers(0, len(x), 2).tolist())
        size = max(width, high - low + 1)
        want = min(len(set(x[s:s + size].tolist())) for s in range(len(x) - size + 1) if s <= low and high < s + size)
        assert cw.least_distinct(x, low, high, width) == want


def test_equal_rows_have_equal_marks():
    front, row, back, other = values(43, 70, 18, 30, 90)
    grams = np.concatenate((front, row, back, row, other[:50], np.full(25, 7, np.uint64)))
    rows = cw.Rows(np.concatenate((grams, other)), np.array([0, len(grams), len(grams) + 90]), 18)
    assert set(rows.of(0, 60, 100)) & set(rows.of(0, 118, 135)) >= set(cw.marks(row, 18))
    assert set(rows.returning(0)) == {*cw.marks(row, 18), *cw.marks(np.full(18, 7, np.uint64), 18)} and not len(rows.returning(1))
    assert len(rows.of(1, 0, 10)) == 0 and len(cw.marks(row[:17], 18)) == 0


def test_ranges_of_pairs_are_the_outermost():
    pairs = np.array([[1, 5, 4, 9, 3, 8], [0, 5, 2, 3, 1, 2], [1, 5, 3, 12, 5, 6], [1, 4, 7, 7, 7, 7]]).T
    assert cw.ranges_of(pairs).T.tolist() == [[0, 5, 2, 3, 1, 2], [1, 4, 7, 7, 7, 7], [1, 5, 3, 12, 3, 8]]


def test_odd_rows(spark):
    df = odd(spark)
    got = cw.repeated_passages(df).collect()
    assert all(r.source_id < r.doc_id for r in got)
    assert cw.without_repeats(df).columns == df.columns
    cw.without_repeats(df).collect()
    assert cw.repeated_passages(empty(spark)).count() == 0
    assert cw.without_repeats(empty(spark)).count() == 0


def test_five_grams_stop_at_text_ends():
    grams, edges = cw.five_grams(pa.array(["a b c d e f", None, "a b c d", "A B\tC  d\ne"]))
    assert edges.tolist() == [0, 2, 2, 2, 3] and grams[0] == grams[2] != grams[1]
