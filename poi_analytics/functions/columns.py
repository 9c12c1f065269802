"""Optional input columns (C6-C8, C16) and the bucket rule."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns_of(df: DataFrame, candidates: Sequence[str]) -> list[str]:
    """The columns of ``df`` that the candidates name, in the candidates' order (any letter case)."""
    own = {c.lower(): c for c in reversed(df.columns)}
    return [own[c.lower()] for c in candidates if c.lower() in own]


def pick(df: DataFrame, candidates: Sequence[str], dtype: str | None = None, default=None,
         merge: bool = False, keep: Callable[[Column], Column] | None = None) -> Column:
    """One value out of optional columns.

    The first candidate that ``df`` has (C6), or with ``merge`` the first non-null among all it has
    (C8); ``keep`` lets only values that pass it count (C16: links).  Without any, the ``default``.
    """
    found = [F.col(f"`{c}`") for c in columns_of(df, candidates)]
    found = [F.when(keep(c), c) if keep else c for c in (found if merge or keep else found[:1])]
    out = F.coalesce(*found) if found else F.lit(default)
    return out.cast(dtype) if dtype else out


def is_link(c: Column) -> Column:
    return c.startswith("http")


def with_columns_present(df: DataFrame, **types: str) -> DataFrame:
    """Add the named columns that are missing, as nulls of the given types."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if not columns_of(df, [c])})


def bucketize(value: Column, rules: Sequence[tuple], default: str) -> Column:
    """ordered (predicate, label) rules folded into one ``when`` chain.

    ``rules`` holds pairs of (op, bound, label) with op in '<', '<=', '>=', '>';
    a null value satisfies no rule and so takes ``default``.
    """
    ops = {"<": lambda b: value < b, "<=": lambda b: value <= b,
           ">": lambda b: value > b, ">=": lambda b: value >= b}
    out = None
    for op, bound, label in rules:
        cond = ops[op](F.lit(bound))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def bucketize_sql(value: str, rules: Sequence[tuple], default: str) -> str:
    """The same bucket rule as SQL text (used by the oracle and by SQL users)."""
    whens = " ".join(f"WHEN {value} {op} {bound} THEN '{label}'" for op, bound, label in rules)
    return f"CASE {whens} ELSE '{default}' END"


def round_doubles(df: DataFrame, scale: int = 4) -> DataFrame:
    """C17: round every double output column; other types pass through."""
    return df.select(*[
        F.round(F.col(f.name), scale).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields])


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Every decimal output column as double."""
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name)
        for f in df.schema.fields])
