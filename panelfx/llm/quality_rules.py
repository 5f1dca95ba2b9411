"""Quality rules learned as a decision list.

Per text: counts of words, symbols, repeated lines and repeated 8-word
windows.  Sequential covering then learns, from labelled rows, an ordered list
of threshold conjunctions that reject: each rule is grown on two thirds of the
rows still uncovered (best information gain per added condition), pruned on
the other third, and kept only if it is precise there.  The list comes out as
one Spark conditional expression.

Defined results: a null or empty text has no words and fails the base rule; a
null label, or one without a document, teaches nothing; several labels of one
document count as rejected if any is 0; without usable labels the list is
empty and only the base rule rejects; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from panelfx.session import stored

from .mixing import fresh
from .rows import text_digest
from .words import SpanHash, mix, slices, whole, windows, words_of

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Rows that the learner may fetch: a bounded sample, smallest hashes first.
MAX_LABELLED = 20_000
MIN_PRECISION = 0.95
MIN_COVER = 10

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
#: Learner's features: counts over counts, so that they behave alike at any length.
FEATURES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "word_length": ("word_chars", "n_words"),
}


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each text."""
    w = words_of(texts)
    data, rows = w.data, len(w.offsets) - 1
    row_of_word = np.repeat(np.arange(rows), w.counts)

    def per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[edges[1:]] - total[edges[:-1]]

    chars = (data & 0xC0) != 0x80
    in_words = np.zeros(len(data) + 1, np.int8)
    np.add.at(in_words, w.starts, 1)
    in_words[w.ends] -= 1
    in_words = np.cumsum(in_words[:-1], dtype=np.int8).astype(bool)

    out = {"n_words": w.counts.astype(np.int64),
           "word_chars": per_text(chars & in_words, w.offsets),
           "n_symbols": per_text(SYMBOLS[data], w.offsets),
           "n_upper": per_text((data >= 0x41) & (data <= 0x5A), w.offsets),
           "n_marks": per_text(data == 0x21, w.offsets)}

    span = SpanHash(data)
    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.unique(np.concatenate((w.offsets[:-1], breaks + 1)))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    ends_with_break = data[line_end - 1] == 0x0A if len(line_end) else np.zeros(0, bool)
    line_row = np.searchsorted(w.offsets, line_start, side="right") - 1
    word_before = np.searchsorted(w.starts, line_start), np.searchsorted(w.starts, line_end)
    with_word = word_before[1] > word_before[0]
    hashes = span(line_start, line_end - ends_with_break) ^ mix(line_row.astype(np.uint64))
    hashes, line_row = hashes[with_word], line_row[with_word]
    out["n_lines"] = np.bincount(line_row, minlength=rows).astype(np.int64)
    _, kept = np.unique(hashes, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_row[kept], minlength=rows)

    hashes = span(w.starts, w.ends)
    inside = whole(w.first, WINDOW, len(hashes))
    at = np.flatnonzero(inside)
    keys = windows(hashes, WINDOW)[at] ^ mix(row_of_word[at].astype(np.uint64))
    at = at[repeated(keys)]
    covered = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    out["n_repeat_words"] = per_text(np.cumsum(covered[:-1]) > 0, w.first)
    return out


def count_table(documents: DataFrame) -> DataFrame:
    """doc_id, digest of the text (``row``) and the COUNTS of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = text_counts(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), *(pa.array(found[c], pa.int64()) for c in COUNTS)], ["doc_id", "row", *COUNTS])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", text_digest().alias("row")).mapInArrow(run, f"doc_id {kind}, row binary, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] <= self.threshold

    def column(self) -> Column:
        top, bottom = FEATURES[self.feature]
        share = F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)
        return share >= self.threshold if self.at_least else share <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> Condition | None:
    """The condition with the highest FOIL gain on these rows; ties go to the first in order."""
    start = np.log2(bad.mean()) if bad.any() else 0.0
    best, gain = None, 1e-9
    for feature in FEATURES:
        order = np.argsort(x[feature], kind="stable")
        value, hit = x[feature][order], bad[order]
        below, n = np.cumsum(hit), np.arange(1, len(hit) + 1)
        change = np.flatnonzero(value[1:] > value[:-1])
        if not len(change):
            continue
        middle = (value[change] + value[change + 1]) / 2
        for at_least in (True, False):
            p = below[-1] - below[change] if at_least else below[change]
            total = len(hit) - n[change] if at_least else n[change]
            with np.errstate(divide="ignore", invalid="ignore"):
                gains = np.where(p > 0, p * (np.log2(p / total) - start), 0.0)
            k = int(np.argmax(gains))
            if gains[k] > gain:
                best, gain = Condition(feature, at_least, float(middle[k])), gains[k]
    return best


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    rows = np.ones(len(bad), bool)
    while rows.any() and not bad[rows].all():
        condition = best_condition({k: v[rows] for k, v in x.items()}, bad[rows])
        if condition is None:
            break
        rule += (condition,)
        rows &= condition.holds(x)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The shortest prefix of the rule with the highest (bad - good) / covered on these rows."""
    def worth(r: Rule) -> float:
        hit = covers(r, x)
        return (2.0 * bad[hit].sum() - hit.sum()) / hit.sum() if hit.any() else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, min_precision: float = MIN_PRECISION,
          min_cover: int = MIN_COVER) -> list[Rule]:
    """Ordered rules that reject; ``fold`` 0 prunes, the others grow."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while bad[left].any():
        growing, pruning = left & (fold != 0), left & (fold == 0)
        rule = grow({k: v[growing] for k, v in x.items()}, bad[growing])
        if not rule:
            break
        rule = prune(rule, {k: v[pruning] for k, v in x.items()}, bad[pruning]) if bad[pruning].any() else rule
        hit = left & covers(rule, x)
        held = hit & pruning
        if hit.sum() < min_cover or bad[hit].mean() < min_precision or (held.any() and bad[held].mean() < min_precision):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as a conditional expression: false where a rule rejects."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for condition in rule[1:]:
            test = test & condition.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_rules(counts: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from at most ``max_labelled`` labelled rows that pass the base rule."""
    label = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    usable = counts.where(~base_failed()).join(label, "doc_id").select(F.xxhash64("doc_id").alias("place"), "doc_id", "quality", *COUNTS)
    # Hashes above this one can hardly be among the smallest, so that tasks send little more than the sample.
    share = min(1.0, 1.5 * max_labelled / max(1, usable.count()))
    cut = min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))
    rows = usable.where(F.col("place") <= cut).orderBy("place", "doc_id", *COUNTS).limit(max_labelled).toPandas()
    if rows.empty:
        return []
    x = {name: np.where(rows[bottom] > 0, rows[top] / rows[bottom].clip(lower=1), 0.0).astype(float)
         for name, (top, bottom) in FEATURES.items()}
    return learn(x, (rows["quality"] == 0).to_numpy(), np.arange(len(rows)) % 3)


def judged(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``quality`` with the digest of each row's text (``row``)."""
    counts = stored(count_table(documents), "quality-counts")
    rules = learn_rules(counts.drop("row"), labels, max_labelled)
    return (counts.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & verdict(rules)))


def quality(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    return judged(documents, labels, max_labelled).drop("row")


def kept_documents(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``documents`` without those that the rules reject.

    A verdict follows from the text; it comes back by doc_id (null too) and
    the text's digest, so rows that share a doc_id are judged one by one.
    """
    names = [fresh(documents, n) for n in ("kept_id", "kept_text")]
    kept = judged(documents, labels, max_labelled).where("kept").select(F.col("doc_id").alias(names[0]), F.col("row").alias(names[1])).distinct()
    return documents.join(kept, documents["doc_id"].eqNullSafe(kept[names[0]]) & (text_digest() == kept[names[1]]), "left_semi")
