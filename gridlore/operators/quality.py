"""Data-quality checks; each returns a table of findings, or raises if told to."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NumericType, StructType


def column_report(df: DataFrame, required: Mapping[str, str]) -> DataFrame:
    """For each required column (name -> "string", "numeric" or any): whether it is there, of that kind, and how often it is filled."""
    kinds = {f.name: f.dataType for f in df.schema}
    there = [c for c in required if c in kinds]
    aggs = [F.count("*").alias("n_"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in there]]
    fits = lambda c: isinstance(kinds[c], NumericType) if required[c] == "numeric" else required[c] == "any" or kinds[c].simpleString() == required[c]
    rows = [F.struct(F.lit(c).alias("column"), F.lit(c in kinds).alias("present"), F.lit(c in kinds and fits(c)).alias("fits"), (F.col(c) if c in kinds else F.lit(None).cast("double")).alias("filled")) for c in required]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unmapped(df: DataFrame, column: str, dim: DataFrame, dim_column: str) -> DataFrame:
    """Values that the dimension lacks, and how many rows have them."""
    counts = df.groupBy(F.col(column).alias("code")).agg(F.count("*").alias("n"))
    return counts.join(dim.select(F.col(dim_column).alias("code")), "code", "left_anti")


def rules(df: DataFrame, keys: Sequence[str], checks: Mapping[str, Column]) -> DataFrame:
    """One row for each broken rule of each row; a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def dataset_report(df: DataFrame, by: Sequence[str], key: Sequence[str], sizes: tuple[int, int], numeric: Sequence[str], checks: Mapping[str, Column], codes: Sequence[str], dim: DataFrame, dim_column: str) -> DataFrame:
    """(by, check, bad) for a whole table: what each check finds in each part, 0 where it finds nothing.

    "type:c" counts rows if column c is missing or not numeric; each of `checks`
    counts rows for which it is false or null; "rows" counts keys whose rows are
    out of `sizes`; "codes" counts different codes that the dimension lacks,
    nulls aside. Three aggregates by part, each combined before its shuffle.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    tests = {f"type:{c}": F.lit(isinstance(kinds.get(c), NumericType)) for c in numeric} | dict(checks)
    per_row = df.groupBy(*by).agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(str(i)) for i, c in enumerate(tests.values())])
    found = per_row.select(*by, F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(str(i)).alias("bad")) for i, name in enumerate(tests)])).alias("s_")).select(*by, "s_.*")
    keys = df.groupBy(*by, *key).agg(F.count("*").alias("n_")).groupBy(*by).agg(F.count_if(~F.col("n_").between(*sizes)).alias("bad"))
    seen = df.select(*by, F.explode(F.array(*codes)).alias("code_")).where("code_ IS NOT NULL").distinct()
    known = dim.select(F.col(dim_column).alias("code_"), F.lit(1).alias("known_")).distinct()
    lacking = seen.join(known, "code_", "left").groupBy(*by).agg(F.count_if(F.col("known_").isNull()).alias("bad"))
    one = lambda part, name: part.select(*by, F.lit(name).alias("check"), "bad")
    return found.union(one(keys, "rows")).union(one(lacking, "codes"))


def require_empty(findings: DataFrame, what: str) -> None:
    """Raise with the first findings, if there are any."""
    first = findings.limit(5).collect()
    if first:
        raise ValueError(f"{what}: {[tuple(r) for r in first]}")


def source_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Two sources compared by key: rows in both or in one, and how often each column agrees."""
    left = a.select(*keys, *columns, F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns], F.lit(True).alias("in_b"))
    both = left.join(right, list(keys), "full_outer")
    met = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    agree = [F.avg(F.when(met, F.col(c).eqNullSafe(F.col(f"{c}_b")).cast("double"))).alias(f"{c}_agree") for c in columns]
    return both.groupBy(*by).agg(F.count_if(met).alias("matched"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), *agree)


def entity_counts(sides: DataFrame, by: Sequence[str], entity: str) -> DataFrame:
    per = sides.groupBy(*by, entity).agg(F.count("*").alias("n"))
    return per.groupBy(*by).agg(F.count("*").alias("entities"), F.min("n").alias("least"), F.max("n").alias("most"))


def funnel(df: DataFrame, by: Sequence[str], stages: Mapping[str, Column]) -> DataFrame:
    """Rows that pass each stage and all before it."""
    aggs, so_far = [F.count("*").alias("input")], F.lit(True)
    for name, ok in stages.items():
        so_far = so_far & F.coalesce(ok, F.lit(False))
        aggs.append(F.count_if(so_far).alias(name))
    return df.groupBy(*by).agg(*aggs)


def banned_columns(kind: DataType, pattern: str, path: str = "") -> list[str]:
    """Paths of all fields, nested ones too, whose name fits the pattern."""
    out: list[str] = []
    if isinstance(kind, StructType):
        for f in kind:
            here = f"{path}.{f.name}" if path else f.name
            if re.search(pattern, f.name):
                out.append(here)
            out += banned_columns(f.dataType, pattern, here)
    elif isinstance(kind, ArrayType):
        out += banned_columns(kind.elementType, pattern, f"{path}[]")
    elif isinstance(kind, MapType):
        out += banned_columns(kind.valueType, pattern, f"{path}{{}}")
    return out


def drop_banned(df: DataFrame, pattern: str, allowed: Sequence[str] = ()) -> DataFrame:
    return df.drop(*[c for c in df.columns if re.search(pattern, c) and c not in allowed])


def fingerprint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and an order-free hash of all columns: equal tables have equal hashes."""
    h = F.xxhash64(*sorted(c for c in df.columns if c not in by))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum"))


def leakage(builder: Callable[[DataFrame], DataFrame], table: DataFrame, corrupted: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """How many keys of a builder's result change when the future is corrupted; 0 for point-in-time builders."""
    from gridlore.operators.asof import changed_keys

    return changed_keys(builder(table), builder(corrupted), keys, columns)
