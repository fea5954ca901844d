"""Reshaping: wide and long forms, completed keys, value grids and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_like(
    df: DataFrame, first: list[str], prefixes: list[str] = (), drop: list[str] = ()
) -> DataFrame:
    """Named columns, then columns by prefix, then everything else."""
    lead = list(first) + [
        c for p in prefixes for c in df.columns if c.startswith(p) and c not in first
    ]
    rest = [c for c in df.columns if c not in lead]
    return df.select(*[_q(c) for c in lead + rest if c not in drop])


def map_columns(df: DataFrame, fn: Callable[[str], Column], types: list[str]) -> DataFrame:
    """Apply one expression to every column of the given types."""
    return df.withColumns({c: fn(c) for c, t in df.dtypes if t in types})


def items_to_long(df: DataFrame, items: list[str]) -> DataFrame:
    """Item columns such as ``oa_1`` to (outcome, item, response); nulls are kept."""
    ids = [c for c in df.columns if c not in items]
    parts = F.split("_name", "_")
    return df.unpivot(ids, items, "_name", "response").select(
        *ids, parts[0].alias("outcome"), parts[1].cast("int").alias("item"), "response"
    )


def to_long(
    df: DataFrame, ids: list[str], values: list[str], name: str, value: str
) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def to_wide(
    df: DataFrame, ids: list[str], names_from: list[str], levels: list, value: str, prefix: str = ""
) -> DataFrame:
    """One column per level; several name columns are joined by an underscore.

    Levels are given, so that the schema is fixed and no job has to find them. (id, level)
    is a key, so ``max`` picks the one value and, unlike ``first``, keeps the plan a
    hash aggregate with partial results before the shuffle.
    """
    key = F.col(names_from[0]) if len(names_from) == 1 else F.concat_ws("_", *names_from)
    aggs = [
        F.max(F.when(key == F.lit(v), F.col(value))).alias(f"{prefix}{v}") for v in levels
    ]
    return df.groupBy(*ids).agg(*aggs)


def crossing(df: DataFrame, **values: list) -> DataFrame:
    """Every row with every combination of a few literal values."""
    for name, levels in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in levels])))
    return df


def seq_table(df: DataFrame, name: str, start: int, stop: int) -> DataFrame:
    """Every row with every whole number from start to stop."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(start), F.lit(stop))))


def complete(df: DataFrame, ids: list[str], **values: list) -> DataFrame:
    """Add the missing combinations of ids and levels, other columns null; no row is lost."""
    grid = crossing(df.select(*ids).distinct(), **values)
    return grid.join(df, ids + list(values), "full_outer").select(*df.columns)


def recode(df: DataFrame, source: str, labels: dict, name: str) -> DataFrame:
    """Label a code and add its level number for sorting; unmatched codes stay null."""
    label, level = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (code, text) in reversed(list(enumerate(labels.items(), start=1))):
        hit = F.col(source) == F.lit(code)
        label = F.when(hit, F.lit(text)).otherwise(label)
        level = F.when(hit, F.lit(i)).otherwise(level)
    return df.withColumns({name: label, name + "_level": level})


def stack(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by column name; missing columns become null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def tag_and_stack(tables: dict[str, DataFrame], name: str) -> DataFrame:
    return stack(*[t.withColumn(name, F.lit(k)) for k, t in tables.items()])


def _q(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")
