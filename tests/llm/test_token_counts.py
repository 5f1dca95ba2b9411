"""Token counts against the tokenizer itself."""

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from panelfx.llm import queries, token_counts
from panelfx.llm.words import buffer_of

from .fixtures import empty, odd

SF = "/root/testdata/sf0.001"
HARD = ["don't we'll THEY'RE 'S ''s 's's rock'n'roll", "a1b22c333,,,!!d", "<|endoftext|>x<|ENDOFTEXT|>y<|startoftext|> <| |> < |", "J̌ H̱ T̈ é é ﬁ K",
        " a b\x1cc\x85d", "日本語のテキスト" * 50, "x" * 5000, "\x00\x01 \x7f~", "1234567890" * 30, "àb ` ^_^", "  ", "tab\there\x0bthere\x0cend"]


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def counted(rows):
    return Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows)


def expected(rows, limit=2048):
    t = tokenizer()
    out = Counter()
    for d, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        out[(d, len((text or "").encode()), n, n > limit)] += 1
    return out


def test_counts_are_the_tokenizers(spark):
    hard = spark.createDataFrame(list(enumerate(HARD)) + [(99, " ".join(HARD) * 40)], "doc_id long, text string")
    for df in (queries.table(spark, SF, "documents"), odd(spark), hard):
        want = expected([(r.doc_id, r.text) for r in df.collect()])
        assert counted(token_counts.token_counts(df).collect()) == want
        assert counted(token_counts.token_counts(df, entries=7).collect()) == want  # nearly all by the cache
    assert token_counts.token_counts(empty(spark)).collect() == []


def test_limit_and_names(spark):
    df = spark.createDataFrame([("k", "one two three", 5, "t")], "id string, body string, n_tokens int, text string")
    got = token_counts.token_counts(df, limit=2, key="id", text="body").collect()[0]
    assert got.asDict() == {"doc_id": "k", "n_bytes": 13, "n_tokens": 3, "over_limit": True}


def test_blocks_cut_long_texts_at_white_space():
    texts = ["", "ab cd ef gh ij", "x" * 40, " " * 30, "", "p " + "y" * 25 + " q r", "z"]
    data, offsets = buffer_of(pa.array(texts))
    for limit in (1, 2, 3, 7, 16, 1000):
        ranges = list(token_counts.blocks(data, offsets, limit))
        assert [a for a, _ in ranges] == [0, *(b for _, b in ranges[:-1])] and ranges[-1][1] == len(data)
        words = Counter()
        for a, b in ranges:
            units, row = token_counts.pre_tokens(data, offsets, a, b)
            words.update(zip(row.tolist(), units.to_pylist()))
        assert words == Counter((k, w) for k, t in enumerate(texts) for w in t.split())


def test_long_text_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 64)
    text = " ".join(HARD) * 3
    data, offsets = buffer_of(pa.array([text, None, "end"]))
    lengths = token_counts.Lengths(token_counts.default_vocabulary())
    total = Counter()
    for a, b in token_counts.blocks(data, offsets, 64):
        units, row = token_counts.pre_tokens(data, offsets, a, b)
        for r, n in zip(row.tolist(), lengths(units.to_pylist()).tolist()):
            total[r] += n
    assert total == {0: len(tokenizer().encode(text, add_special_tokens=False).ids), 2: 1}


def test_table_finds_equal_bytes_only():
    rng = np.random.default_rng(3)
    units = list({bytes(rng.integers(97, 100, rng.integers(1, 7)).astype(np.uint8)) for _ in range(800)})
    half = units[: len(units) // 2]
    table = token_counts.LengthTable(half, list(range(len(half))))
    found = table.find(pa.array([u.decode() for u in units], pa.large_string())).tolist()
    assert found == [half.index(u) if u in half else -1 for u in units]
    assert token_counts.LengthTable([], []).find(pa.array(["a"], pa.large_string())).tolist() == [-1]
    assert table.nbytes < 64 * len(half) + 64


def test_equal_hashes_do_not_count_as_equal(monkeypatch):
    monkeypatch.setattr(token_counts.LengthTable, "home", lambda self, data, starts, ends: np.full(len(starts), self.mask, np.int64))
    table = token_counts.LengthTable([b"aa", b"ab", b"b"], [4, 5, 6])
    assert table.find(pa.array(["ab", "b", "ba", "aa", "a"], pa.large_string())).tolist() == [5, 6, -1, 4, -1]


def test_summary_keeps_what_is_frequent():
    units = pa.array([f"w{k}" for k in range(100)])
    counts = np.arange(100)
    kept, left = token_counts.summary(units, counts, 10)
    assert kept.to_pylist() == [f"w{k}" for k in range(90, 100)] and left.tolist() == list(range(1, 11))


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 2000)
    lengths = token_counts.Lengths(token_counts.default_vocabulary())
    t = tokenizer()
    for k in range(60):
        words = [f"word{k}", f"other{k}x", "y" * 3000]
        assert lengths(words).tolist() == [len(t.encode(w).ids) for w in words]
        assert lengths.held <= 2000 and max(map(len, lengths.known)) <= token_counts.CACHED_WORD
