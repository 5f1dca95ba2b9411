"""Sharding, mixing, quality rules, licenses, fingerprints, archives and packing against brute force."""

import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from panelfx.llm import fingerprints, license_scan, mixing, packing, quality_rules, queries, sharding, warc, words
from panelfx.llm.words import words_of
from panelfx.session import scratch_path

from .fixtures import empty, odd, odd_rows

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    return queries.table(spark, SF, "documents")


def both(spark):
    """The given table and the odd one, as (DataFrame, list of (doc_id, text, source))."""
    for df in (documents(spark), odd(spark)):
        yield df, [(r.doc_id, r.text, r.source) for r in df.collect()]


# sharding

def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one():
    keys = np.array([0, 1, -1, 2**62, -(2**63), 12345678901], np.int64)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k) % 2**64, n) for k in keys]


def test_sharding(spark):
    for df, rows in both(spark):
        got = sharding.assignment(df, 24, rows_per_bin=3).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
            (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24 and r.law == "key"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.assignment(empty(spark)).count() == 0
    assert sharding.shard(odd(spark), "doc_id", 5).columns[-1] == "row"  # an existing shard column is replaced in place


# mixing

def targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    out, full = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        out = {s: 2 * sizes[s] if s in full else left * weight[s] / open_weight for s in names}
        above = {s for s in names if s not in full and out[s] > 2 * sizes[s]}
        if not above:
            return out
        full |= above


def test_mixing(spark):
    for df, rows in both(spark):
        sizes = Counter()
        for d, t, s in rows:
            sizes[s] += len(WORD.findall(t or ""))
        want = targets(sizes)
        got = mixing.mix(df, shard_words=2000).collect()
        assert len(got) == len(rows)
        taken = Counter()
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
            assert 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
        shards = {s: max(1, -(-n // 2000)) for s, n in sizes.items()}
        for s in sizes:
            assert abs(taken[s] - want[s]) <= mixing.BLOCK * (1 + shards[s])
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df, shard_words=2000).collect()))
    assert mixing.mix(empty(spark)).count() == 0


def test_sainte_lague_deals_highest_quotients(spark):
    claims = [("a", 53.0), ("b", 24.0), ("c", 23.0), ("d", 0.0), ("e", 0.4), ("f", 24.0)]
    for seats in (0, 1, 3, 7, 100, 101):
        got = {r.source: r.quota for r in mixing.sainte_lague(
            spark.createDataFrame([(s, c, seats) for s, c in claims], "source string, claim double, seats long"),
            "seats", "claim", ["source"]).collect()}
        won = Counter()
        for _ in range(seats):
            won[max((c / (2 * won[s] + 1), -ord(s), s) for s, c in claims if c > 0)[2]] += 1
        assert got == {s: won[s] for s, _ in claims}, seats


def test_mixed_documents(spark):
    for df, rows in both(spark):
        whole = Counter()
        for r in mixing.mix(df).collect():
            whole[r.doc_id] += r.taken
        mixed = mixing.mixed_documents(df)
        assert mixed.columns == df.columns
        texts = defaultdict(set)
        for d, t, _ in rows:
            texts[d].add(t)
        got = Counter()
        for r in mixed.collect():
            assert any((t or "").startswith(r.text) for t in texts[r.doc_id])
            got[r.doc_id] += len(WORD.findall(r.text))
        if df.columns == ["doc_id", "text", "lang", "source", "n_chars"]:
            assert got == Counter({k: v for k, v in whole.items() if v})
    assert mixing.mixed_documents(empty(spark)).count() == 0


# quality rules

def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_and_rules(spark):
    labels = queries.table(spark, SF, "labels")
    for df, rows in both(spark):
        got = quality_rules.quality(df, labels).collect()
        base = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
        assert base == Counter((d, *counts(t)) for d, t, _ in rows)
        for r in got:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)
    none = spark.createDataFrame([(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality(odd(spark), none).collect()
    assert all(r.kept != r.base_failed for r in got)
    assert quality_rules.quality(empty(spark), labels).count() == 0


def test_quality_rules_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules.quality(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"))
    rows = got.join(queries.table(spark, sf, "labels"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in bad) >= 0.85 * len(bad)


def test_learned_list_finds_planted_rule():
    rng = np.random.default_rng(1)
    x = {f: rng.random(3000) for f in quality_rules.FEATURES}
    bad = ((x["symbol_share"] > 0.7) & (x["repeat_share"] < 0.5)) | (x["upper_share"] > 0.9)
    rules = quality_rules.learn(x, bad, np.arange(3000) % 3)
    caught = np.zeros(3000, bool)
    for r in rules:
        caught |= quality_rules.covers(r, x)
    assert (caught & bad).sum() > 0.95 * bad.sum() and (caught & ~bad).sum() < 0.02 * bad.sum()


# licenses

def test_license_base(spark):
    for df, rows in both(spark):
        got = {}
        for r in license_scan.scan(df).collect():
            got.setdefault(r.doc_id, []).append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        want = {}
        for d, t, _ in rows:
            low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
            hits = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
            place = [i for i, _ in hits]
            want.setdefault(d, []).append((len(words), len(hits), min(place, default=None), max(place, default=None), ",".join(sorted({x for _, x in hits}))))
        key = lambda v: sorted(map(str, v))
        assert {k: key(v) for k, v in got.items()} == {k: key(v) for k, v in want.items()}
    assert license_scan.scan(empty(spark)).count() == 0


def test_license_templates(spark):
    cases = {
        1: ("Released under the MIT License.", "mit", 1.0),
        2: ("Licensed under the GNU General Public License, as published by the Free Software Foundation, either version 3", "gpl,gpl-3.0", 1.0),
        3: ("Licensed under the GNU General Public License of version 3", "gpl", None),
        4: ("Copyright (c) 2020 Some One. All rights reserved", "copyright-reserved,reserved", 1.0),
        5: ("Copyright 1 2 3 4 5 6 7 8 9 10 all rights reserved", "reserved", None),
        6: ("licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0", 1.0),
        7: ("nothing here", "", 0.0),
        8: ("Licensed under the Apache License, Version 2", "apache-2.0", 1.0),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id long, text string")
    for r in license_scan.scan(df).collect():
        assert r.labels == cases[r.doc_id][1], r
        assert cases[r.doc_id][2] in (None, r.score), r


# fingerprints

def test_fingerprints(spark):
    for df, rows in both(spark):
        got = fingerprints.fingerprint(df).collect()
        assert len(got) == len(rows)
        ids = [r[0] for r in rows]
        if len(set(ids)) < len(ids):
            continue
        order = sorted(rows)
        want = {}
        for (d, t, _), (_, u, _) in zip(order, order[1:] + order[:1]):
            t, u = t or "", u or ""
            half = len(t) // 2
            e = t[:len(t) - half] + u[:half]
            a, b, c = (fingerprints.chunk_set(x.encode()) for x in (t, e, u))
            want[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.as_text(a), fingerprints.as_text(b),
                       fingerprints.likeness(a, b), fingerprints.likeness(a, c))
        assert {r.doc_id: tuple(r)[1:7] for r in got} == want
    assert fingerprints.fingerprint(empty(spark)).count() == 0


def test_one_document_is_its_own_next(spark):
    row = fingerprints.fingerprint(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()[0]
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_chunks_resist_shifts():
    rng = np.random.default_rng(3)
    raw = rng.integers(32, 127, 20_000).astype(np.uint8).tobytes()
    a, b = fingerprints.chunk_set(raw), fingerprints.chunk_set(b"some inserted words " + raw)
    assert fingerprints.containment(a, b) > 0.95
    ends = fingerprints.chunk_ends(np.frombuffer(raw, np.uint8))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(raw) and sizes.max() <= fingerprints.MOST and 150 < sizes.mean() < 500


# archives

def test_archives_round_trip(spark):
    pages = queries.table(spark, SF, "pages").select("page_id", "url", "html")
    body = "x" * 100
    extra = spark.createDataFrame(
        [(900, None, None), (901, "u", ""), (902, "u\nv", body), (903, "u", body), (904, "", body), (905, "u", "short"), (906, "u", "short"),
         (907, "u", "a\r\n\r\nb" * 50_000), (908, "u", "é" * 50), (909, "u", "é" * 50)], "page_id long, url string, html string")
    df = pages.unionByName(extra)
    got = {r.page_id: r for r in warc.round_trip(spark, df).collect()}
    rows = df.collect()
    assert len(got) == len(rows)
    firsts = {}
    for r in sorted(rows):
        raw = (r.html or "").encode()
        first = firsts.setdefault(raw, r.page_id) if len(raw) >= 100 else r.page_id
        g = got[r.page_id]
        assert (g.payload_bytes, g.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (g.record_type, g.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
    assert warc.round_trip(spark, extra.limit(0)).count() == 0
    ids = spark.createDataFrame([(None, "u", body), (None, "u", body), (5, None, body), (5, None, body)], "page_id long, url string, html string")
    assert warc.round_trip(spark, ids, scratch_path(spark, "warc-null")).count() == 4


def test_reader_refuses_broken_archives():
    raw = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest())
    assert [r["payload_bytes"] for r in warc.read_records(io.BytesIO(raw + raw))] == [7, 7]
    text = zlib.decompress(raw, 31)
    for bad in (text.replace(b"payload", b"paylaod"), text[:-2], text + b"x", text.replace(b"Content-Length: ", b"Content-Length: 9", 1)):
        deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(deflate.compress(bad) + deflate.flush())))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(raw[:-9])))


# packing

def test_packing(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    for df, rows in both(spark):
        got = packing.pack(df).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in got:
            by_doc[r.doc_id].append(r)
            by_sequence[r.sequence_id].append(r)
        for s in by_sequence.values():
            at = 0
            for r in sorted(s, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 4096
        want = defaultdict(list)
        for d, t, _ in rows:
            want[d].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
        assert set(by_doc) == set(want)
        for d, texts in want.items():
            pieces = Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[d])
            expected = Counter()
            for ids in texts:
                marks = packing.cuts(len(ids))
                expected.update((a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), len(ids)) for a, b in zip(marks[:-1], marks[1:]))
            assert pieces == expected
    assert packing.pack(empty(spark)).count() == 0


def test_ids_of_words_that_compose_only_in_lower_case():
    from tokenizers import Tokenizer
    path = packing.default_vocabulary()
    tokenizer = Tokenizer.from_file(path)
    texts = ["J\u030c", "H\u0331 T\u0308", "W\u030a.Y\u030a", "Plain. Words, A<|B a.b<|endoftext|>C.d É.E", None, "", "x", ".Y", "<|ENDOFTEXT|> X.Y"]
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    for rows in (range(len(texts)), *([k] for k in range(len(texts)))):
        ids, edges = packing.text_ids(pa.array([texts[k] for k in rows], pa.string()), path)
        assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])] == [want[k] for k in rows]


def test_differencing_is_even():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 512, 4000)
    window = packing.pack_group(sizes)
    sums = np.bincount(window, weights=sizes)
    assert sums.max() <= 4096 and len(sums) * 4096 / sums.sum() < 1.01
    got, total = packing.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(total) == [14, 16] and sorted(np.bincount(got, weights=[8, 7, 6, 5, 4])) == [14, 16]


# words

def test_span_hash_tells_thue_morse_words_apart():
    t = [0]
    for _ in range(13):
        t += [1 - x for x in t]
    a, b = "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)
    w = words_of(pa.array([a, b, a, a[:1024], b[:1024]]))
    h = w.hashes().tolist()
    assert h[0] == h[2] and len(set(h)) == 4


def test_span_hash_is_a_polynomial_modulo_a_prime():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 70_000).astype(np.uint8)
    h = words.SpanHash(data)
    for a, b in [(0, 0), (0, 1), (5, 900), (2047, 2049), (65_000, 70_000)]:
        want = sum((int(c) + 1) * pow(words.BASE, i, words.PRIME) for i, c in enumerate(data[a:b])) % words.PRIME
        assert h([a], [b])[0] == words.mix(np.array([want], np.uint64))[0]


def test_templates_may_open_with_a_variable():
    text = pa.array(["the year 2020 foo bar baz", "foo bar baz", "foo bar", "foo bar quux baz"])
    for markup in ("<<var 4>> foo bar baz", "<<optional>>the <<var 2>><</optional>> foo bar baz", "<<var 2>> <<optional>>year<</optional>> foo bar baz"):
        found = license_scan.scan_texts(text, (("x", markup),), ())
        assert found["labels"] == ["x", "x", "", ""]
    with pytest.raises(ValueError):
        license_scan.scan_texts(text, (("x", "<<var 3>>"),), ())


def test_ids_kept_by_a_worker_are_bounded(monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(packing, "KNOWN_BYTES", 5000)
    known = packing.WordIds(packing.default_vocabulary())
    plain = Tokenizer.from_file(packing.default_vocabulary())
    for k in range(40):
        words_ = [f"w{k}", "z" * 400, f"other{k}"]
        place = known.places(words_)
        for p, w in zip(place, words_):
            assert known.flat[known.begin[p]:known.begin[p + 1]].tolist() == plain.encode(w, add_special_tokens=False).ids
        assert known.held < 5000 + 3 * 3000


def test_source_of_empty_texts_has_many_shards(spark):
    df = spark.createDataFrame([(k, None if k % 2 else "", "a") for k in range(500)] + [(1000 + k, "one two", "b") for k in range(40)], "doc_id long, text string, source string")
    plan = mixing.mix(df, shard_rows=50)
    assert plan.count() == 540 and plan.where("source = 'a' and taken > 0").isEmpty()
    assert abs(sum(r.taken for r in plan.collect()) - 120) <= mixing.BLOCK


def test_verdicts_tell_rows_with_one_doc_id_apart(spark):
    good = " ".join(f"word{k} stands here" for k in range(40))
    df = spark.createDataFrame([(1, good, 5), (1, "too short", 6), (None, good + " again", 7), (None, "short", 8), (2, "tiny", 9)], "doc_id long, text string, row int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality_rules.kept_documents(df, labels)
    assert kept.columns == df.columns and {r.row for r in kept.collect()} == {5, 7}


def test_next_of_rows_that_share_a_doc_id(spark):
    texts = ["b" * 70 + str(k) for k in range(30)] + ["a", "c", ""]
    df = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string").repartition(9)
    got = Counter(r.edited_sha256 for r in fingerprints.fingerprint(df).collect())
    order = sorted(texts)
    want = Counter(hashlib.sha256((t[:len(t) - len(t) // 2] + u[:len(t) // 2]).encode()).hexdigest() for t, u in zip(order, order[1:] + order[:1]))
    assert got == want
