"""Language-model scoring by context-tree weighting over bytes.

Texts (ASCII capitals lowered, UTF-8) are sequences of bytes closed by 0xFF,
which UTF-8 never has; before a text stand five such bytes.  A byte is eight
binary decisions, and each decision has a tree of contexts, the last 0 to 5
bytes.  A node holds the counts of both outcomes in the training texts, its
Krichevsky-Trofimov probability, and the weighted probability

    P_w = 1/2 P_KT + 1/2 product of the children's P_w     (P_KT at depth 5),

so the weight of every depth comes from the counts alone and all depths are
mixed in each prediction.  Where the training texts have never been (a child
without counts, whose prediction would be 1/2 whatever the context), the node
above keeps the child's share.  The code length of a text is the sum of -log2
over its bytes.

The work is spread like this.  Texts fall into chunks of bounded size.  A
chunk sends each distinct 6-gram (context and byte) once, with its training
count.  Counts are summed by gram.  Grams with the same last two context bytes
form a subtree that one task weighs, or with the same last three, four or five
where there are more than HOT of them: no task gets more than that.  Above lie
at most 256 * 255 nodes of depth 1 and 255 of depth 0, and 255 for each context
that was split (no more than grams / HOT of each depth); these are summed up in
between.  Every gram then
has one log-probability, which goes back to the chunks that hold the gram, and
a chunk sums up its texts.  Unigram counts of words travel the same way.

Defined results: a null or empty text is its end alone; a null doc_id is held
out; equal rows get equal scores and train once each; an empty table gives an
empty one; without training texts every decision has probability 1/2; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelfx.session import stored

from .groups import chunk as column_of
from .words import LOWER, buffer_of, give_back_memory, slices, word_strings

DEPTH = 5
TOP = 2                  # depth of the subtrees that one task weighs, at least
HOT = 400_000            # grams of a subtree; a larger one is split by one more byte
END = 0xFF
CHUNK_BYTES = 32 << 20
GRAM_BYTES = 1 << 19     # text that a task turns into 6-grams at once (some 100 bytes of arrays per byte)
WORD_BYTES = 2 << 20     # text that a task splits into words at once
END_WORD = ""            # no word is empty
U64 = np.uint64


# 6-grams of texts

def grams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """6-gram of every byte of all texts and of their ends; where each text's start (one more at the end)."""
    data, offsets = buffer_of(texts)
    n = np.diff(offsets)
    starts = offsets[:-1] + np.arange(len(n)) * (DEPTH + 1)
    line = np.full(len(data) + len(n) * (DEPTH + 1), END, np.uint8)
    at = np.arange(len(data)) + np.repeat((np.arange(len(n)) + 1) * (DEPTH + 1) - 1, n)
    line[at] = LOWER[data]
    wide = line.astype(U64)
    gram = np.zeros(max(0, len(line) - DEPTH), U64)
    for k in range(DEPTH + 1):
        gram = gram << U64(8) | wide[k:len(line) - DEPTH + k]
    # A text of n bytes has n + 1 grams; those that start in the next text's padding are dropped.
    begin = np.zeros(len(gram) + 1, np.int32)
    np.add.at(begin, starts, 1)
    np.add.at(begin, starts + n + 1, -1)
    return gram[np.cumsum(begin[:-1]) > 0], np.concatenate(([0], np.cumsum(n + 1)))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts."""
    values = np.sort(values)
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[at], np.diff(np.append(at, len(values)))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(count, at) if len(at) else count


class Lookup:
    """Index of many 64-bit keys in a set of distinct ones, by levels of hash tables."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys if len(keys) else np.zeros(1, U64)
        self.levels = []
        left, factor = np.arange(len(self.keys)), 0x9E3779B97F4A7C15
        while len(left):
            bits = max(4, int(len(left) * 3).bit_length())
            slot = (self.keys[left] * U64(factor)) >> U64(64 - bits)
            table = np.zeros(1 << bits, np.int32)
            table[slot] = left
            self.levels.append((U64(factor), U64(64 - bits), table))
            left = left[table[slot] != left]
            factor = factor * 0xD1342543DE82EF95 % 2**64 | 1

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted key; -1 where there is none."""
        out = np.full(len(wanted), -1, np.int64)
        open_ = None
        for factor, shift, table in self.levels:
            asked = wanted if open_ is None else wanted[open_]
            found = table[(asked * factor) >> shift]
            hit = self.keys[found] == asked
            if open_ is None:
                out[hit] = found[hit]
                open_ = np.flatnonzero(~hit)
            else:
                out[open_[hit]] = found[hit]
                open_ = open_[~hit]
            if not len(open_):
                break
        return out


# the tree

def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: recurrence up to 8, then Stirling's series."""
    low = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        low[small] += np.log(x[small])
        x = np.where(small, x + 1, x)
    i = 1 / x
    series = i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i * (1 / 1680 - i * i / 1188))))
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - low


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def weigh(kt: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln P_w, and the share of the node's own estimate in it."""
    both = np.logaddexp(kt, children)
    return both - np.log(2), np.exp(kt - both)


class Subtree:
    """Nodes of depth ``top`` to DEPTH over grams that share their last ``top`` context bytes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, top: int = TOP):
        self.top = top
        byte = (grams & U64(255)).astype(np.int64)
        context = grams >> U64(8)
        level = np.arange(8)
        self.node = (1 << level) | (byte[:, None] >> (8 - level))    # decision of each bit, by the bits before it
        self.bit = (byte[:, None] >> (7 - level)) & 1
        n = np.repeat(counts.astype(float), 8)
        ones = self.bit.reshape(-1) == 1
        self.depths: dict[int, tuple] = {}
        below = None
        for depth in range(DEPTH, top - 1, -1):
            key = (((context & U64((1 << 8 * depth) - 1))[:, None] << U64(8)) | self.node.astype(U64)).reshape(-1)
            keys, at = np.unique(key, return_inverse=True)
            count = [np.bincount(at, weights=n * side, minlength=len(keys)) for side in (~ones, ones)]
            kt = log_kt(*count)
            if below is None:
                log_w, own = kt, np.ones(len(keys))
            else:
                child_keys, child_w = below
                parent = (child_keys >> U64(8)) & U64((1 << 8 * depth) - 1)
                place = np.searchsorted(keys, parent << U64(8) | (child_keys & U64(255)))
                log_w, own = weigh(kt, np.bincount(place, weights=child_w, minlength=len(keys)))
            below = keys, log_w
            self.depths[depth] = (keys, at, count, log_w, own)

    def roots(self) -> tuple[np.ndarray, ...]:
        """keys (context, decision), zeros, ones, ln P_w at depth ``top``."""
        keys, _, count, log_w, _ = self.depths[self.top]
        return keys, *count, log_w

    def log10(self, above: dict[int, tuple[np.ndarray, ...]], split: dict[tuple[int, int], tuple[np.ndarray, ...]], grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte.

        Own share, probability of a one and use come from ``above`` by depth
        up to 1 and from ``split`` by depth and context below."""
        one = self.bit == 1
        p, seen = np.full(one.shape, 0.5), np.zeros(one.shape, bool)
        for depth in range(DEPTH, -1, -1):
            if depth >= self.top:
                _, at, (zeros, ones), _, own = self.depths[depth]
                share, estimate, used = (t[at].reshape(one.shape) for t in (own, (ones + 0.5) / (zeros + ones + 1), zeros + ones > 0))
            elif depth >= TOP:
                share, estimate, used = (t[self.node] for t in split[depth, int(grams[0] >> U64(8)) & ((1 << 8 * depth) - 1)])
            else:
                context = ((grams >> U64(8)) & U64((1 << 8 * depth) - 1)).astype(np.int64)[:, None]
                share, estimate, used = (t[context, self.node] for t in above[depth])
            share = np.where(seen, share, 1.0)
            p, seen = share * np.where(one, estimate, 1 - estimate) + (1 - share) * p, used
        return np.log10(p).sum(axis=1)


NODE = ["context", "node"]


def split_tables(nodes: pd.DataFrame) -> tuple[dict[tuple[int, int], tuple[np.ndarray, ...]], pd.DataFrame]:
    """Tables of the contexts whose subtrees were split, by depth and context, and the sums over depth TOP.

    ``nodes``: ``depth`` of the context and, per context and node, zeros, ones
    and below, summed over the subtrees under it.
    """
    tables: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
    carried = nodes.iloc[:0].drop(columns="depth")
    for depth in range(DEPTH - 1, TOP - 2, -1):
        here = pd.concat([nodes[nodes["depth"] == depth].drop(columns="depth"), carried]).groupby(NODE, as_index=False).sum()
        if depth < TOP:
            return tables, here
        zeros, ones = here["zeros"].to_numpy(float), here["ones"].to_numpy(float)
        log_w, own = weigh(log_kt(zeros, ones), here["below"].to_numpy(float))
        node, context = here["node"].to_numpy(np.int64), here["context"].to_numpy(np.int64)
        for c in np.unique(context):
            on = context == c
            share, one, used = np.full(256, 0.5), np.full(256, 0.5), np.zeros(256, bool)
            share[node[on]], one[node[on]] = own[on], (ones[on] + 0.5) / (zeros[on] + ones[on] + 1)
            used[node[on]] = zeros[on] + ones[on] > 0
            tables[depth, int(c)] = share, one, used
        carried = pd.DataFrame({"context": context & ((1 << 8 * (depth - 1)) - 1), "node": node, "zeros": zeros, "ones": ones, "below": log_w})
    return tables, carried


def upper_tables(nodes: pd.DataFrame) -> dict[int, tuple[np.ndarray, ...]]:
    """Own share, probability of a one and whether training used it, for depths above TOP.

    ``nodes``: sums over depth TOP (context, node, zeros, ones, below).
    """
    out = {}
    for depth in range(TOP - 1, -1, -1):
        share, one = (np.full((1 << 8 * depth, 256), 0.5) for _ in range(2))
        context, node = nodes["context"].to_numpy(np.int64), nodes["node"].to_numpy(np.int64)
        zeros, ones = nodes["zeros"].to_numpy(float), nodes["ones"].to_numpy(float)
        log_w, own = weigh(log_kt(zeros, ones), nodes["below"].to_numpy(float))
        share[context, node], one[context, node] = own, (ones + 0.5) / (zeros + ones + 1)
        used = np.zeros(share.shape, bool)
        used[context, node] = zeros + ones > 0
        out[depth] = share, one, used
        nodes = pd.DataFrame({"context": context & ((1 << 8 * max(0, depth - 1)) - 1), "node": node, "zeros": zeros, "ones": ones, "below": log_w})
        nodes = nodes.groupby(["context", "node"], as_index=False).sum()
    return out


# tables

def chunked(documents: DataFrame, chunk_bytes: int) -> DataFrame:
    size = documents.agg(F.sum(F.octet_length("text")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    chunks = max(1, -(-((size["n"] or 0) + 8 * size["rows"]) // chunk_bytes))
    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 10 == 0
    return documents.select("doc_id", "text", held.alias("held_out"),
                            F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))


def parts_of(group: pa.Table, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in group.to_batches():
        yield from slices(batch, limit=limit)


def count_grams(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 6-grams of a chunk, and how often training texts have them."""
    keys, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for part in parts_of(group, GRAM_BYTES):
        grams, edges = grams_of(part.column("text"))
        train = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False), np.diff(edges))
        for flags in (train, ~train):
            key, count = distinct(grams[flags])
            keys.append(key)
            counts.append(count * int(flags is train))
        if sum(map(len, keys)) > 2 * len(keys[0]) + (1 << 20):
            key, count = summed(keys, counts)
            keys, counts = [key], [count]
    return summed(keys, counts)


def count_words(group: pa.Table) -> pa.Table:
    """Distinct words of a chunk, and how often training texts have them."""
    tables = []
    for part in parts_of(group, WORD_BYTES):
        words, per_text = word_strings(pc.ascii_lower(part.column("text")))
        train = ~part.column("held_out").to_numpy(zero_copy_only=False)
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        n = np.bincount(code[np.repeat(train, per_text)], minlength=len(coded.dictionary)).astype(np.int64)
        tables.append(pa.table({"word": pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([END_WORD])]), "n": np.append(n, train.sum())}))
        if len(tables) > 6:
            tables = [merged(tables)]
    return merged(tables)


def count(group: pa.Table) -> pa.Table:
    """Both counts of a chunk: rows with a gram or with a word."""
    number = group.column("chunk")[0]
    grams, n = count_grams(group)
    give_back_memory()
    words = count_words(group)
    give_back_memory()
    names = ["chunk", "gram", "word", "n"]
    return pa.concat_tables([
        pa.Table.from_arrays([pa.repeat(number, len(grams)), pa.array(grams.astype(np.int64)), pa.nulls(len(grams), pa.string()), pa.array(n.astype(np.int64))], names=names),
        pa.Table.from_arrays([pa.repeat(number, len(words)), pa.nulls(len(words), pa.int64()), words.column("word"), words.column("n")], names=names)])


def merged(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])


def subtree_of(group: pa.Table) -> tuple[np.ndarray, Subtree]:
    grams = group.column("gram").to_numpy().astype(U64)
    return grams, Subtree(grams, group.column("n").to_numpy(), group.column("top")[0].as_py())


def summary(group: pa.Table) -> pa.Table:
    _, tree = subtree_of(group)
    keys, zeros, ones, log_w = tree.roots()
    context = (keys >> U64(8)) & U64((1 << 8 * (tree.top - 1)) - 1)
    return pa.table({"depth": np.full(len(keys), tree.top - 1, np.int32), "context": context.astype(np.int64), "node": (keys & U64(255)).astype(np.int32),
                     "zeros": zeros, "ones": ones, "below": log_w})


def subtrees(totals: DataFrame, hot: int) -> DataFrame:
    """``totals`` with the subtree of each gram: how many context bytes it shares (``top``), and these bytes."""
    def bytes_of(depth: int) -> Column:
        return F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * depth) - 1))

    top, larger = F.lit(TOP), F.lit(True)
    for depth in range(TOP, DEPTH):
        counts = totals.where(larger).groupBy(bytes_of(depth).alias("c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
        found = [r["c"] for r in counts.select("c").collect()]  # fewer than grams / hot
        if not found:
            break
        larger = larger & bytes_of(depth).isin(found)
        top = F.when(larger, F.lit(depth + 1)).otherwise(top)
    return totals.withColumn("top", top).withColumn(
        "subtree", F.shiftright("gram", 8).bitwiseAND(F.element_at(F.array(*[F.lit((1 << 8 * d) - 1) for d in range(1, DEPTH + 1)]), F.col("top"))))


def scores(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """Scores of all documents: the contract's columns and ``bits_per_byte``, the code length per byte of text and end."""
    docs = chunked(documents, chunk_bytes)
    counts = stored(docs.groupBy("chunk").applyInArrow(count, "chunk int, gram long, word string, n long"), "counts")
    grams = counts.where("gram is not null").select("chunk", "gram", "n")
    words = counts.where("word is not null").select("chunk", "word", "n")
    totals = subtrees(stored(grams.groupBy("gram").agg(F.sum("n").alias("n")), "gram-totals"), hot)
    parts = totals.groupBy("top", "subtree")
    nodes = (parts.applyInArrow(summary, "depth int, context long, node int, zeros double, ones double, below double")
             .groupBy("depth", "context", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))))
    split, first = split_tables(nodes.toPandas())  # 255 decisions each of 256 contexts of one byte, and of those that were split
    above = upper_tables(first)

    def probabilities(group: pa.Table) -> pa.Table:
        found, tree = subtree_of(group)
        return pa.table({"gram": group.column("gram"), "value": tree.log10(above, split, found)})

    values = parts.applyInArrow(probabilities, "gram long, value double")
    word_totals = stored(words.groupBy("word").agg(F.sum("n").alias("n")), "word-totals")
    corpus = word_totals.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    tokens, kinds = corpus["n"] or 0, corpus["v"] or 0

    needed = (grams.select("chunk", "gram").join(values, "gram").select("chunk", "gram", F.lit(None).cast("string").alias("word"), "value")
              .unionByName(words.select("chunk", "word").join(word_totals, "word").select(
                  "chunk", F.lit(None).cast("long").alias("gram"), "word", F.col("n").cast("double").alias("value"))))
    kind = documents.schema["doc_id"].dataType.simpleString()
    fields = ("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    names = ["doc_id", *(f.split()[0] for f in fields.split(", "))]

    def base_scores(texts: pa.Table, known: pa.Array, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known and base_score of each text."""
        end = n[known.index(pa.scalar(END_WORD)).as_py()]
        log = lambda c: np.log10((c + 0.1) / (tokens + 0.1 * (kinds + 1)))
        out = []
        for part in parts_of(texts, WORD_BYTES):
            found, per_text = word_strings(pc.ascii_lower(part.column("text")))
            coded = found.dictionary_encode()
            place = pc.index_in(coded.dictionary.cast(pa.string()), value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
            c = n[place][coded.indices.to_numpy(zero_copy_only=False)] if len(found) else np.zeros(0)
            row = np.repeat(np.arange(part.num_rows), per_text)
            out.append((per_text.astype(np.int64) + 1,
                        np.bincount(row, weights=c > 0, minlength=part.num_rows).astype(np.int64) + int(end > 0),
                        np.bincount(row, weights=log(c), minlength=part.num_rows) + log(end)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def tree_scores(texts: pa.Table, lookup: Lookup, log10: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """score and coded bytes of each text."""
        out = []
        for part in parts_of(texts, GRAM_BYTES):
            gram, edges = grams_of(part.column("text"))
            out.append((np.add.reduceat(log10[lookup(gram)], edges[:-1]), np.diff(edges)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def score(texts: pa.Table, table: pa.Table) -> pa.Table:
        by_word = table.filter(pc.is_valid(table.column("word"))).combine_chunks()
        n_tokens, n_known, base = base_scores(texts, column_of(by_word, "word"), column_of(by_word, "value").to_numpy())
        del by_word
        give_back_memory()
        by_gram = table.filter(pc.is_valid(table.column("gram"))).combine_chunks()
        del table
        total, size = tree_scores(texts, Lookup(column_of(by_gram, "gram").to_numpy().astype(U64)), column_of(by_gram, "value").to_numpy())
        give_back_memory()
        return pa.Table.from_arrays([
            texts.column("doc_id"), texts.column("held_out"), pa.array(n_tokens), pa.array(n_known),
            pa.repeat(pa.scalar(tokens, pa.int64()), len(texts)), pa.array(base), pa.array(total), pa.array(-total / np.log10(2) / size)], names=names)

    return docs.groupBy("chunk").cogroup(needed.groupBy("chunk")).applyInArrow(score, f"doc_id {kind}, {fields}")
