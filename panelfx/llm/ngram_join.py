"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word 5-grams (ASCII capitals lowered).  Texts with equal
sets are one class of copies from the start; only one of them, the
representative, is compared.  Banded MinHash values bring candidates together:
24 bands of 4 values miss a pair of similarity 0.8 with probability 3e-6.
Candidates are then compared value by value: with m of n values equal, the
posterior probability of reaching the threshold (uniform prior) is
P(Bin(n + 1, t) <= m), and a pair is dropped as soon as that falls below the
tolerance.  The rest is verified on the whole shingle sets.

Buckets of any size are cut into blocks of about ``BLOCK`` members; a task
compares two blocks.  Pairs never leave a task and are not stored: a first pass
leaves the members that have a surviving pair, a second one, with their whole
sets, finds the pairs from the signatures once more, verifies them and sends
one row per member: its links and the smallest member of its part of the block.
A pair that meets in several bands counts in the first one only.

Defined results: null, empty and blank texts have no shingle and link to
nothing, so each is its own class; a text of 1 to 4 words is one shingle of
all its words; rows with a null doc_id take part like others and a class
without any doc_id has a null class_id; repeated rows are copies; an empty
table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfx.session import stored

from .components import components
from .groups import chunk, fixed_bytes, pairs_within, whole_groups
from .mixing import fresh
from .rows import text_digest
from .words import mix, shingles, slices, words_of

N = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
VALUES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 256
PAIRS = 50_000        # pairs that a task holds at once
CELLS = 4_000_000     # cells of the incidence matrix that a task holds at once
FACTORS = mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each step's n, the fewest equal values that keep a pair."""
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        below = 0.0
        for m in range(n + 2):
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
        out[n] = m
    return out


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text."""
    values, rows = shingles(words_of(texts, lower=True), N)
    edges = np.searchsorted(rows, np.arange(len(texts) + 1))
    for a, b in zip(edges[:-1], edges[1:]):
        yield np.unique(values[a:b])


def digest(shingle_set: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest() if len(shingle_set) else None


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """VALUES MinHash values of each (non-empty) set."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), VALUES), np.uint32)
    for k, factor in enumerate(FACTORS):
        out[:, k] = np.minimum.reduceat(values * factor, starts) >> np.uint64(32)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(rows, BANDS) hashes of each band's values."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        key = mix(key ^ parts[:, :, k])
    return key.view(np.int64)


def signed(documents: DataFrame) -> DataFrame:
    """doc_id, rep (digest of the shingle set, null without shingles) and signature of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part.column("text")))
                full = [s for s in sets if len(s)]
                sigs = iter(signatures(full)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array([digest(s) for s in sets], pa.binary()),
                     pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary())], ["doc_id", "row", "rep", "sig"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", text_digest().alias("row")).mapInArrow(run, f"doc_id {kind}, row binary, rep binary, sig binary")


def banded(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(fixed_bytes(batch.column("sig"), VALUES * 4).view(np.uint32))
                rep = batch.column("rep").take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), rep], ["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key long, rep binary")


GROUP = ["key", "lo", "hi"]


def blocked(reps: DataFrame, bands: DataFrame) -> DataFrame:
    """Members of buckets with two or more, once for each pair of blocks they are in."""
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = bands.join(shared, "key").join(reps.select("rep", "sig", "copies"), "rep")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    other = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return other.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "rep", "copies", "sig")


def by_group(df: DataFrame, *then: str) -> DataFrame:
    return df.repartition(*GROUP).sortWithinPartitions(*GROUP, *then)


def survivors(table: pa.Table, starts: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that Bayesian pruning leaves, each in its first common band."""
    key, lo, hi, side = (chunk(table, c).to_numpy() for c in ("key", "lo", "hi", "side"))
    sig = fixed_bytes(chunk(table, "sig"), VALUES * 4).view(np.uint32)
    keys = band_keys(sig)
    band = np.argmax(keys == key[:, None], axis=1)
    found = []
    for left, right in pairs_within(starts, len(key), PAIRS):
        keep = (lo[left] == hi[left]) | (side[left] != side[right])
        left, right = left[keep], right[keep]
        first = np.argmax(keys[left] == keys[right], axis=1)
        keep = first == band[left]
        left, right = left[keep], right[keep]
        equal = np.zeros(len(left), np.int64)
        for n in range(STEP, VALUES + 1, STEP):
            if not len(left):
                break
            equal += (sig[left, n - STEP:n] == sig[right, n - STEP:n]).sum(axis=1)
            keep = equal >= least[n]
            left, right, equal = left[keep], right[keep], equal[keep]
        found.append((left, right))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


MEMBER = [*GROUP, "side", "rep", "copies", "sig"]


def pruned(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Members with a surviving pair in their block."""
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, GROUP):
            left, right = survivors(table, starts, least)
            if len(left):
                at = pa.array(np.union1d(left, right))
                yield pa.RecordBatch.from_arrays([chunk(table, c).take(at) for c in MEMBER], MEMBER)

    return by_group(members, "side", "rep").mapInArrow(run, "key long, lo int, hi int, side int, rep binary, copies long, sig binary")


def sets_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whole shingle sets of the wanted representatives (columns ``rep``, ``first_id``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                reps, sets = [], []
                for rep, found in zip(part.column("rep").to_pylist(), shingle_sets(part.column("text"))):
                    if digest(found) == rep:
                        reps.append(rep)
                        sets.append(found.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.binary()), pa.array(sets, pa.binary())], ["rep", "shingles"])

    texts = documents.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id"))).select("rep", "text")
    return texts.mapInArrow(run, "rep binary, shingles binary").groupBy("rep").agg(F.any_value("shingles").alias("shingles"))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over ranges of the shingles."""
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((len(sets), len(sets)), np.float64)
    width = max(1, CELLS // len(sets))
    order = np.argsort(inverse, kind="stable")
    row, inverse = row[order], inverse[order]
    for begin in range(0, len(values), width):
        a, b = np.searchsorted(inverse, [begin, begin + width])
        matrix = np.zeros((len(sets), min(width, len(values) - begin)), np.float32)
        matrix[row[a:b], inverse[a:b] - begin] = 1
        out += matrix @ matrix.T
    return out


def linked(candidates: DataFrame, sets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Verified links: rep, links (copies of its partners in the block), root (smallest member linked in the block)."""
    least_equal = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, GROUP):
            out: list[tuple[bytes, int, bytes]] = []
            left, right = survivors(table, starts, least_equal)
            order = np.argsort(left, kind="stable")
            left, right = left[order], right[order]
            reps, copies, raw = (chunk(table, c) for c in ("rep", "copies", "shingles"))
            for a, b in zip(starts, np.append(starts[1:], len(table))):
                x, y = np.searchsorted(left, [a, b])
                if x == y:
                    continue
                ids = reps.slice(a, b - a).to_pylist()
                weight = copies.slice(a, b - a).to_numpy()
                sets_ = [np.frombuffer(v.as_buffer(), np.uint64) for v in raw.slice(a, b - a)]
                i, j = left[x:y] - a, right[x:y] - a
                size = np.array([len(v) for v in sets_])
                if len(i) > 50:
                    common = shared_counts(sets_)[i, j]
                else:
                    common = np.array([len(np.intersect1d(sets_[m], sets_[n], assume_unique=True)) for m, n in zip(i, j)])
                same = common >= threshold * (size[i] + size[j] - common)
                i, j = i[same], j[same]
                links = np.bincount(i, weights=weight[j], minlength=b - a) + np.bincount(j, weights=weight[i], minlength=b - a)
                part = smallest_linked(i, j, int(b - a))
                least: dict[int, bytes] = {}
                for k in np.flatnonzero(links).tolist():
                    least[part[k]] = min(least.get(part[k], ids[k]), ids[k])
                out += [(ids[k], int(links[k]), least[part[k]]) for k in np.flatnonzero(links).tolist()]
            if out:
                r, n, root = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.binary()), pa.array(n, pa.int64()), pa.array(root, pa.binary())], ["rep", "links", "root"])

    rows = by_group(candidates.join(sets, "rep"), "side", "rep")
    return rows.mapInArrow(run, "rep binary, links long, root binary")


def smallest_linked(i: np.ndarray, j: np.ndarray, n: int) -> list[int]:
    """For 0 .. n - 1 a common number of each connected part of the pairs (i, j)."""
    part = np.arange(n)
    while True:
        low = part.copy()
        np.minimum.at(low, i, part[j])
        np.minimum.at(low, j, part[i])
        low = low[low]
        if (low == part).all():
            return part.tolist()
        part = low


def classes_of(documents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``near_duplicates`` with the digest of each row's text (``row``)."""
    rows = stored(signed(documents), "ngram-signed")
    reps = stored(rows.where("rep is not null").groupBy("rep").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.any_value("sig").alias("sig")), "ngram-reps")
    candidates = stored(pruned(blocked(reps, banded(reps)), threshold, tolerance), "ngram-candidates")
    wanted = candidates.select("rep").distinct().join(reps.select("rep", "first_id"), "rep")
    links = stored(linked(candidates, sets_of(documents, wanted), threshold, tolerance), "ngram-links")
    parts = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    classes = parts.join(reps.select("rep", "first_id"), "rep")
    names = classes.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = classes.select("rep", "root").join(names, "root").select("rep", "class_id")
    count = links.groupBy("rep").agg(F.sum("links").alias("links"))
    about = (reps.select("rep", "copies", "first_id").join(count, "rep", "left").join(named, "rep", "left")
             .select("rep", F.coalesce("class_id", "first_id").alias("class_id"),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")))
    # Stored, so that nothing but a join stands above the exchange of the rows: AQE then splits a hot class of copies.
    about = stored(about, "ngram-about")
    with_words = rows.where("rep is not null").select("doc_id", "row", "rep").join(about, "rep").drop("rep")
    without = rows.where("rep is null").select("doc_id", "row", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return with_words.unionByName(without)


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), n_links, n_copies of every row.

    Classes are the connected parts of the graph of similar texts.  ``n_links``
    counts the other rows at or above the threshold, copies included;
    ``n_copies`` the rows with an equal shingle set, its own included.
    """
    return classes_of(documents, threshold, tolerance).drop("row")


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """``documents`` without near duplicates: the row with the smallest doc_id of each class stays.

    Rows are told apart by doc_id and text, so a doc_id may stay with one of
    its texts and go with another; rows that repeat a kept row all stay, and
    so do rows without doc_id, since no decision can name them.
    """
    named = [fresh(documents, n) for n in ("gone_id", "gone_text")]
    gone = classes_of(documents, **options).where("doc_id <> class_id").select(F.col("doc_id").alias(named[0]), F.col("row").alias(named[1])).distinct()
    return documents.join(gone, (documents["doc_id"] == gone[named[0]]) & (text_digest() == gone[named[1]]), "left_anti")
