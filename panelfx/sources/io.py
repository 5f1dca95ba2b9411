"""Sources and sinks (#1-12).

Readers keep the scan lazy so Catalyst can prune columns and push filters
into parquet (and partition filters on ``m`` into the directory listing).
Writers are partitioned parquet appends/overwrites; a CSV copy is optional.
Scratch output belongs under the session's shared checkpoint folder (see
``session.ensure_checkpoint_dir``), never a machine-local temp folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.frame import union_by_name
from ..operators.resample import bucket_rank


def read_yearly(spark: SparkSession, template: str, years: Sequence[int], encoding: str = "UTF-8") -> DataFrame | None:
    """#1 + #2: one CSV per year (``template.format(year=y)``, any path that
    the session's file systems know), absent years skipped, all columns read as strings by header name, then stacked by
    name (columns absent in a year become NULL).  A ``year`` column is added
    when the file has none.  Legacy charsets such as cp949 need
    ``spark.sql.legacy.javaCharsets=true`` on the session."""
    frames = []
    for y in years:
        path = template.format(year=y)
        if not path_exists(spark, path):
            continue
        df = (spark.read.option("header", True).option("encoding", encoding)
              .option("inferSchema", False).csv(path))
        if "year" not in df.columns:
            df = df.withColumn("year", F.lit(int(y)).cast("long"))
        frames.append(df)
    return union_by_name(frames) if frames else None


def snapshot(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """#3: persist the engineered table and return (rows, missing cells)."""
    df.write.mode(mode).parquet(path)
    saved = df.sparkSession.read.parquet(path)
    cols = saved.columns
    miss = sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0))
    return saved.agg(F.count(F.lit(1)).alias("n_rows"), miss.cast("long").alias("n_missing_cells"))


def write_imputations(df: DataFrame, path: str, m_col: str = "m", csv_path: str | None = None,
                      mode: str = "overwrite") -> None:
    """#4: all imputations as one parquet table partitioned by ``m`` (the
    per-imputation files of a single-machine layout become partitions);
    optionally a CSV copy with one folder per ``m``."""
    df.write.mode(mode).partitionBy(m_col).parquet(path)
    if csv_path:
        df.write.mode(mode).partitionBy(m_col).option("header", True).csv(csv_path)


def imputation_metadata(df: DataFrame, m_col: str = "m") -> DataFrame:
    """#5: M, rows per imputation (min and max), number and list of variables."""
    variables = [c for c in df.columns if c != m_col]
    per_m = df.groupBy(m_col).agg(F.count(F.lit(1)).alias("rows"))
    return per_m.agg(F.count(F.lit(1)).alias("n_imputations"), F.min("rows").alias("rows_min"),
                     F.max("rows").alias("rows_max")).select(
        "*", F.lit(len(variables)).alias("n_variables"),
        F.array(*[F.lit(v) for v in variables]).alias("variables"))


def read_imputations(spark: SparkSession, path: str, m: int | None = None, m_col: str = "m") -> DataFrame:
    """#6: all imputations, or one (partition pruning on ``m``)."""
    df = spark.read.parquet(path)
    return df.where(F.col(m_col) == m) if m is not None else df


def read_selected_variables(spark: SparkSession, path: str | None, col: str = "variable") -> list[str] | None:
    """#7: optional covariate list (a small one-column table); absent -> None
    (meaning "use all")."""
    if not path or not path_exists(spark, path):
        return None
    fmt = "parquet" if path.rstrip("/").endswith(".parquet") else "csv"
    df = spark.read.option("header", True).format(fmt).load(path)
    # A variable list is a handful of names, bounded by the table's width.
    return [r[0] for r in df.select(col).distinct().orderBy(col).collect()]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through the Hadoop file system of the session (works for
    local, HDFS and object-store paths alike)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def write_outcome_tables(df: DataFrame, path: str, m_col: str = "m", first_csv: str | None = None,
                         mode: str = "overwrite") -> None:
    """#8: imputations with outcome columns; optional CSV of the first one."""
    df.write.mode(mode).partitionBy(m_col).parquet(path)
    if first_csv:
        first = df.agg(F.min(m_col)).first()[0]
        df.where(F.col(m_col) == first).write.mode(mode).option("header", True).csv(first_csv)


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """#9: estimate rows as one CSV file (estimate tables are a few rows per
    group, so a single output partition is fine)."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def result_report(est: DataFrame, method: str, m: int | None = None, ate: str = "ate", se: str = "se") -> DataFrame:
    """#10: human-readable lines per estimate row (method, ATE, SE, CI, z, p,
    verdict at .05 with stars, percent change, M)."""
    from ..functions.expr import significance_stars
    verdict = F.when(F.col("p_value") < 0.05, F.concat(F.lit("significant "), significance_stars("p_value"))) \
        .otherwise(F.lit("not significant (p >= 0.05)"))
    line = F.format_string(
        "%s: ATE=%.6f SE=%.6f 95%% CI=[%.6f, %.6f] z=%.4f p=%.6f %s; effect %+.2f%%%s",
        F.lit(method), F.col(ate), F.col(se), F.col("ci_lower"), F.col("ci_upper"), F.col("z"),
        F.col("p_value"), verdict, F.col("effect_pct"),
        F.lit(f" (M={m})" if m is not None else ""))
    return est.select("*", line.alias("report"))


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    report.select("report").coalesce(1).write.mode(mode).text(path)


def matched_files(spark: SparkSession, patterns: Sequence[str]) -> list[tuple[int, str]]:
    """(number of the match, data file) of all patterns, through the session's file systems.

    Matches are numbered in the order of the patterns, then by path.  A
    matched folder is one match; its data files are listed below it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: list[tuple[int, str]] = []
    seen: set[str] = set()
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        system = path.getFileSystem(conf)
        hits = {s.getPath().toUri().toString(): s for s in (system.globStatus(path) or [])}
        for name in sorted(hits):
            if name in seen:
                continue
            number = len(seen)
            seen.add(name)
            files = [hits[name]] if hits[name].isFile() else list(system.listStatus(hits[name].getPath()))
            for f in sorted(x.getPath().toUri().toString() for x in files if x.isFile()):
                if not f.rsplit("/", 1)[-1].startswith(("_", ".")):
                    out.append((number, f))
    return out


def _file_name(path):
    """One spelling of a file's URI (``file:/a`` and ``file:///a`` are the same)."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_result_files(spark: SparkSession, patterns: Sequence[str], schema: str | None = None) -> DataFrame | None:
    """#11: every CSV matched by the patterns, columns aligned by header name.

    Columns absent in a file are NULL.  ``schema`` (DDL) names and types the
    columns; without it the types are inferred per set of equal headers.
    Adds ``source_file``, ``file_no`` (order of the patterns, then of the
    paths) and ``line_no`` (the line in the file, its header being line 1; no
    record may span lines), in place of columns of those names.  Unreadable files are skipped;
    no match gives None."""
    files = matched_files(spark, patterns)
    if not files:
        return None
    options = {"header": True, "ignoreCorruptFiles": True, "mode": "PERMISSIVE"}
    paths = [f for _, f in files]
    lines = (spark.read.option("ignoreCorruptFiles", True).text(paths)
             .select("value", _file_name(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("start"))
             .where("start = 0"))
    # The first line of the first block; a row per file reaches the driver, which lists the files anyway.
    first = (lines.withColumn("row", F.monotonically_increasing_id())
             .groupBy("file").agg(F.min_by("value", "row").alias("header")))
    headers: dict[str, list[str]] = {}
    for r in first.orderBy("file").collect():
        headers.setdefault(r["header"], []).append(r["file"])
    frames = []
    for group in headers.values():
        df = spark.read.options(**options).option("inferSchema", schema is None).csv(group)
        names = [c for c in df.columns if c not in ("source_file", "file_no", "line_no")]
        df = df.select(*names, _file_name(F.col("_metadata.file_path")).alias("source_file"),
                       F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
        # Blocks are numbered by themselves, and the counts of the blocks before are added.
        df = bucket_rank(df, ["source_file"], ["_at"], F.col("_block"), "line_no").withColumn("line_no", F.col("line_no") + 1).drop("_block", "_at")
        if schema is not None:
            wanted = StructType.fromDDL(schema)
            df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in names
                             else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted], "source_file", "line_no")
        frames.append(df)
    numbers = spark.createDataFrame([(n, f) for n, f in files], "file_no long, listed string").select(
        "file_no", _file_name(F.col("listed")).alias("source_file"))
    return union_by_name(frames).join(numbers, "source_file", "left")


CHECKPOINT_PATTERN = r"_([0-9]+)of([0-9]+)\.csv$"


def latest_checkpoint(names: DataFrame, name_col: str = "name", total: int | None = None,
                      by: Sequence[str] = ()) -> DataFrame:
    """#12: among names ``..._{i}of{total}.csv`` pick the highest i (per
    group); names that do not match (or have another total) are ignored."""
    n = F.col(name_col)
    i = F.regexp_extract(n, CHECKPOINT_PATTERN, 1)
    tot = F.regexp_extract(n, CHECKPOINT_PATTERN, 2)
    ok = i != ""
    if total is not None:
        ok = ok & (tot == str(total))
    parsed = names.where(ok).withColumn("_i", i.cast("long"))
    return parsed.groupBy(*by).agg(F.max("_i").alias("latest"), F.max_by(name_col, "_i").alias("name"))
