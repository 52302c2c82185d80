"""Scans and sinks over files, all through Spark's readers and writers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name in the folder that all executors share; where none is named, a temporary one, which only a local session may have."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/gridlore/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, tag: str) -> DataFrame:
    """The table written once to the shared folder and read back: what comes after doesn't compute it again."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_csv(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """Typed CSV scan with a header; a value that does not fit its type is an error."""
    return spark.read.schema(schema).options(header=True, mode="FAILFAST", **options).csv(path)


def scan_mapped(spark: SparkSession, path: str, schema: str, code: str, mapping: Mapping[str, str], required: Sequence[str], where: Column | None = None) -> DataFrame:
    """CSV scan that drops incomplete rows and maps a code column; an unknown code is an error."""
    rows = scan_csv(spark, path, schema).na.drop(subset=list(required))
    rows = rows.where(where) if where is not None else rows
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.coalesce(F.col(code), F.lit("")))
    bad = rows.where(mapped.isNull()).select(code).distinct().limit(5).collect()
    if bad:
        raise ValueError(f"unknown codes in {code}: {[r[0] for r in bad]}")
    return rows.withColumn(code, mapped)


def scan_first(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", **options: str) -> DataFrame:
    """The first of several paths that can be read: a landed file, else its cached copy."""
    for i, path in enumerate(paths):
        try:
            return spark.read.format(fmt).options(**options).load(path)
        except AnalysisException as e:
            if i == len(paths) - 1 or "PATH_NOT_FOUND" not in (e.getCondition() or ""):
                raise
    raise ValueError("no paths")


def scan_partitions(spark: SparkSession, path: str, key: str, values: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan of some partitions and columns; both are pruned at the reader."""
    df = spark.read.parquet(path).where(F.col(key).isin(*values))
    return df.select(*columns) if columns else df


def file_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(file, bytes, modified, rows, a count for each rule) of the files that a file scan reads: how many rows break a rule; a null counts as broken."""
    meta = F.col("_metadata")
    broken = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    return df.groupBy(meta["file_path"].alias("file"), meta["file_size"].alias("bytes"), meta["file_modification_time"].alias("modified")).agg(F.count("*").alias("rows"), *broken)


def scan_validated(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """A file scan of which every file keeps to the rules; else a ValueError names the files that don't, and the rules.

    The check reads the rules' columns of the files that the scan's filters
    leave, and brings the broken files' counts to the driver, at most 20.
    """
    bad = file_report(df, rules).where(sum((F.col(r) for r in rules), F.lit(0)) > 0).orderBy("file").limit(20).collect()
    if bad:
        raise ValueError("files that break rules: " + "; ".join(f"{r['file']}: " + ", ".join(f"{r[k]} of {r['rows']} rows {k}" for k in rules if r[k]) for r in bad))
    return df


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder or file in whatever store Spark reads it from; False if there was none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def manifest(spark: SparkSession, path: str, part: str) -> DataFrame:
    """(part, files, bytes, modified, rows, content) of the Parquet files of a folder, by the piece of their path that the pattern's group fits.

    Sizes and times are the reader's own file metadata; content is a hash of
    the rows, whatever their order and files.
    """
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    meta = F.col("_metadata")
    rows = df.select(F.regexp_extract(meta["file_path"], part, 1).alias("part"), meta["file_path"].alias("file"), meta["file_size"].alias("size"), meta["file_modification_time"].alias("modified"), F.xxhash64(*df.columns).alias("h"))
    files = rows.groupBy("part", "file").agg(F.max("size").alias("size"), F.max("modified").alias("modified"), F.count("*").alias("rows"), F.bit_xor("h").alias("h"), F.sum(F.col("h").cast("decimal(38,0)")).alias("t"))
    content = F.sha2(F.concat_ws("|", F.bit_xor("h").cast("string"), F.sum("t").cast("string"), F.sum("rows").cast("string")), 256)
    return files.groupBy("part").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("modified").alias("modified"), F.sum("rows").alias("rows"), content.alias("content"))


def manifest_diff(was: DataFrame, now: DataFrame) -> DataFrame:
    """(part, status, rows_was, rows_now): same, changed, missing or new parts of two manifests."""
    both = was.select("part", F.col("rows").alias("rows_was"), F.col("content").alias("c0")).join(now.select("part", F.col("rows").alias("rows_now"), F.col("content").alias("c1")), "part", "full")
    status = F.when(F.col("c1").isNull(), "missing").when(F.col("c0").isNull(), "new").when(F.col("c0") == F.col("c1"), "same").otherwise("changed")
    return both.select("part", status.alias("status"), "rows_was", "rows_now")


def scan_guarded(df: DataFrame, banned: str, keep: bool = False, wanted: Sequence[str] | None = None) -> DataFrame:
    """A scan without the columns that fit the pattern; asking for one is an error unless `keep`."""
    refused = [c for c in wanted or [] if re.search(banned, c)]
    if refused and not keep:
        raise ValueError(f"banned columns: {refused}")
    df = df if keep else df.drop(*[c for c in df.columns if re.search(banned, c)])
    return df.select(*wanted) if wanted else df


def scan_json_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records of a folder with the name of the file each came from."""
    return spark.read.schema(schema).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def scan_dimension(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A dimension whose key must be unique and not null."""
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.expr(" OR ".join(["n > 1", *[f"{k} IS NULL" for k in keys]]))).limit(5).collect()
    if bad:
        raise ValueError(f"key {list(keys)} is not unique: {[tuple(r) for r in bad]}")
    return df


def week_shifts(counted: DataFrame, scheduled: DataFrame, season: str, week: str, open_season: int | None = None) -> DataFrame:
    """(season, shift): by how many weeks a source counts ahead of the schedule, from the last week of each; 0 for a season that is still open.

    A shift other than 0 or 1 means that the two don't belong together, and is an error that names the seasons.
    """
    ends = [df.groupBy(season).agg(F.max(week).alias(n)) for df, n in ((counted, "c_"), (scheduled, "s_"))]
    shift = F.when(F.col(season) == open_season, 0).otherwise(F.col("c_") - F.col("s_")).cast("int")
    table = ends[0].join(ends[1], season).select(season, shift.alias("shift"))
    bad = table.where(~F.col("shift").isin(0, 1)).orderBy(season).limit(20).collect()
    if bad:
        raise ValueError("weeks that don't fit the schedule: " + ", ".join(f"{r[0]} by {r[1]}" for r in bad))
    return table


def write_partitioned(df: DataFrame, path: str, key: str, mode: str = "overwrite") -> None:
    """Parquet by partition; an overwrite replaces only the partitions that `df` has. Rows are dealt by key and hash so that a large partition has several files."""
    salted = df.repartition(F.col(key), F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    salted.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_run(rows: DataFrame, path: str, columns: Sequence[str], run: str = "run_at") -> None:
    """Append one run to a ledger: exact columns, one run time, later than any before; all or nothing."""
    if list(rows.columns) != list(columns):
        raise ValueError(f"columns {rows.columns}, not {list(columns)}")
    first, last = rows.agg(F.min(run), F.max(run)).first()
    if first is None or first != last:
        raise ValueError("a run has one time")
    try:
        before = rows.sparkSession.read.parquet(path).agg(F.max(run)).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        before = None
    if before is not None and first <= before:
        raise ValueError(f"run {first} is not later than {before}")
    rows.write.mode("append").parquet(path)


def write_csv_rounded(df: DataFrame, path: str, places: Mapping[str, int], dates: Sequence[str] = ()) -> None:
    df.withColumns({**{c: F.round(c, n) for c, n in places.items()}, **{c: F.date_format(c, "yyyy-MM-dd") for c in dates}}).write.option("header", True).csv(path)


def write_json_documents(df: DataFrame, path: str) -> None:
    """One JSON document for each row; NaN is null, and null fields are written."""
    clean = df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(k)) for c, k in df.dtypes if k in ("double", "float")})
    clean.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def table_key(df: DataFrame, *extra: object) -> str:
    """A hex key of a table's content and settings, whatever the order of its rows."""
    n, xor = df.agg(F.count("*"), F.bit_xor(F.xxhash64(*sorted(df.columns)))).first()
    return df.sparkSession.range(1).select(F.sha2(F.lit(f"{n}|{xor}|{extra}"), 256)).first()[0][:16]


def cached(df: DataFrame, root: str, key: str) -> DataFrame:
    """What is stored under the key, or `df`, stored there first."""
    spark, path = df.sparkSession, f"{root}/{key}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or "") and "UNABLE_TO_INFER" not in (e.getCondition() or ""):
            raise
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, bytes, sha256) of the files of a folder; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
