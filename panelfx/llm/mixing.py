"""Mixing sources to target weights by Sainte-Laguë apportionment.

All of it is DataFrame expressions.  The budget (150 % of all words) is cut
into equal blocks of ``block`` words.  Blocks go to sources, and the blocks of
a source to its shards, by the highest quotients ``target / (2 * seats + 1)``.
A shard takes its quota of blocks from the seeded order of its documents:
whole passes first, then the start of the next pass, so that a document is
taken at most twice and quotas are met to the block.

Seats are not dealt one by one.  The divisor of any highest-quotient result
lies between ``T / (M + n/2)`` and ``T / (M - n/2)`` (T targets, M seats, n
parties), so all seats but about 2n are certain, and only the rest compete.

Defined results: a null source is a source of its own, last in order; a null
or empty text has no words and is never taken; sources without words get
target 0; equal rows are interchangeable; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from panelfx.session import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
BLOCK = 16
SHARD_WORDS = 1_000_000
SHARD_ROWS = 500_000      # rows of a shard: many documents may have no word
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: float = MAX_REPEAT) -> DataFrame:
    """Target words per source (columns ``source``, ``source_size``).

    Sources share ``share`` of all words by weight; no target passes ``repeat``
    times its source.  Giving the excess to the others again and again ends at
    one water level: sources are full in the order of cap over weight, and the
    level is the first one that no remaining source is below.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    cap = F.col("source_size") * F.lit(float(repeat))
    fill = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (sizes.withColumn("weight", weight).withColumn("cap", cap)
              .withColumn("ratio", F.col("cap") / F.col("weight"))
              .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
              .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
              .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
              .withColumn("level", F.col("left") / F.col("open")))
    level = F.max("level").over(everything)  # rises while sources are full, falls behind the first that is not
    return ranked.withColumn("water", level).select(
        "source", "source_size",
        F.coalesce(F.least(F.col("cap"), F.col("water") * F.col("weight")), F.col("cap")).alias("target"))


def sainte_lague(parties: DataFrame, seats: str, claim: str, order: list, by: list | None = None) -> DataFrame:
    """``parties`` with ``quota``: ``seats`` seats of each group ``by`` dealt by claim / (2k + 1), ties by ``order``."""
    whole = Window.partitionBy(*(by or [F.lit(1)])).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = F.col("claim_sum")
    low = F.greatest(F.lit(0), F.floor(F.col(claim) * F.greatest(F.col(seats) - F.col("party_n") / 2, F.lit(0.0)) / t - 0.5))
    high = F.ceil(F.col(claim) * (F.col(seats) + F.col("party_n") / 2) / t + 0.5)
    sized = (parties.withColumn("claim_sum", F.sum(claim).over(whole))
             .withColumn("party_n", F.count(F.lit(1)).over(whole))
             .withColumn("sure", F.when(t > 0, low).otherwise(0).cast("long"))
             .withColumn("most", F.when((t > 0) & (F.col(claim) > 0), high).otherwise(0).cast("long"))
             .withColumn("rest", F.col(seats) - F.sum("sure").over(whole)))
    rivals = sized.withColumn("seat", F.explode_outer(
        F.when(F.col("most") > F.col("sure"), F.sequence(F.col("sure"), F.col("most") - 1))))
    rank = F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(
        (F.col(claim) / (2 * F.col("seat") + 1)).desc_nulls_last(), *order, "seat"))
    won = rivals.withColumn("won", F.when(F.col("seat").isNotNull() & (rank <= F.col("rest")), 1).otherwise(0))
    return (won.groupBy(*parties.columns, "sure").agg(F.sum("won").alias("won"))
            .withColumn("quota", F.col("sure") + F.col("won")).drop("sure", "won"))


def mix(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = MAX_REPEAT,
        block: int = BLOCK, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS, seed: str = SEED) -> DataFrame:
    """Words taken from every document: doc_id, size, source_size, target, taken, quota words of its shard."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                            digest.alias("place"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("crc"))
    rows = stored(rows, "mix-sizes")  # the texts are read once; sizes, shards and the order all come from this narrow table
    about = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    sizes = about.select("source", "source_size")
    targets = source_targets(sizes, weights, share, repeat)
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seats = F.round(F.sum("target").over(total) / block).cast("long")
    sources = sainte_lague(targets.withColumn("seats", seats), "seats", "target", [F.col("source").isNull(), F.col("source")])
    counts = about.select(F.col("source").alias("r_source"), "source_rows")
    sources = sources.join(counts, F.col("source").eqNullSafe(F.col("r_source"))).select(
        "source", "source_size", "target", F.col("quota").alias("source_quota"),
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("source_rows") / shard_rows)).cast("long").alias("shards"))
    # Bounded by the number of sources; AQE broadcasts it when its measured size allows and splits a hot source otherwise.
    same = rows["source"].eqNullSafe(sources["source"])
    placed = rows.join(sources, same).drop(sources["source"]).withColumn(
        "shard", F.pmod(F.conv(F.substring("place", 1, 12), 16, 10).cast("long"), F.col("shards")))
    shards = placed.groupBy("source", "source_quota", "shard").agg(F.sum("size").cast("long").alias("shard_size"))
    quotas = sainte_lague(shards, "source_quota", "shard_size", [F.col("shard")], by=["source"]).select(
        F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "shard_size",
        F.least(F.col("quota") * block, F.col("shard_size") * repeat).alias("words"))
    seeded = Window.partitionBy("source", "shard").orderBy("place", "crc", "size")
    ahead = F.sum("size").over(seeded.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    chosen = placed.withColumn("ahead", ahead).join(
        quotas, placed["source"].eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0)
    rest = F.col("words") - passes * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead")))
    return chosen.select("doc_id", "source", "size", "source_size", "target",
                         (passes * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of ``documents``.

    A document taken for more than its size comes twice.  The last copy is cut
    behind the last word taken; text up to there is kept byte for byte.
    """
    t_id, t_source, t_size, words, left = (fresh(documents, n) for n in ("t_id", "t_source", "t_size", "words", "left"))
    taken = mix(documents, **options).where("taken > 0").groupBy("doc_id", "source", "size").agg(F.max("taken").alias(words))
    taken = taken.withColumnsRenamed({"doc_id": t_id, "source": t_source, "size": t_size})
    own = documents.join(taken, F.col("doc_id").eqNullSafe(F.col(t_id)) & F.col("source").eqNullSafe(F.col(t_source))
                         & (word_count(F.col("text")) == F.col(t_size)))
    copies = own.withColumn(left, F.explode(F.when(
        F.col(words) > F.col(t_size), F.array(F.col(t_size), F.col(words) - F.col(t_size))).otherwise(F.array(F.col(words)))))
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each piece ends with a word
    part = F.col(left) < F.col(t_size)
    copies = copies.withColumn("text", F.when(part, F.array_join(F.slice(pieces, 1, F.col(left).cast("int")), "")).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        copies = copies.withColumn("n_chars", F.when(part, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return copies.select(*documents.columns)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name
