"""Column expressions that the operators share: null-safe statistics and string rules."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: A standard deviation below this counts as constant.
FLAT = 1e-12


def digits(c: Column, n: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, n) + F.lit(0.0)


def pearson(x: str | Column, y: str | Column) -> Column:
    """Aggregate; null where a side is constant (corr itself raises there in ANSI mode)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def average_rank(x: str, *keys: str) -> Column:
    """Rank of x among the rows of the keys; ties share their mean rank. NaN must be gone before."""
    by = Window.partitionBy(*keys)
    return F.rank().over(by.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2


def zscore(x: str, *keys: str, when_flat: Column | None = None) -> Column:
    """Population z-score within the keys; constant or non-finite groups give when_flat (0)."""
    w = Window.partitionBy(*keys)
    mean, sd = F.avg(x).over(w), F.stddev_pop(x).over(w)
    flat = F.lit(0.0) if when_flat is None else when_flat
    return F.when(sd.isNull() | F.isnan(sd) | (sd < FLAT), flat).otherwise(F.try_divide(F.col(x) - mean, sd))


def first_impulses(t: str) -> Column:
    """What a constant channel becomes: a tiny impulse at t = 0 and its negative at t = 1."""
    return F.when(F.col(t) == 0, 1e-6).when(F.col(t) == 1, -1e-6).otherwise(0.0)


def slugify(s: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(s)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit("variant"))


def class_dir_name(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def delta_list(s: Column) -> Column:
    """'1,3,12' to [1, 3, 12]; values under 1 count as 1; null or empty gives [1]."""
    parts = F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    out = F.transform(parts, lambda x: F.greatest(F.lit(1), x.cast("int")))
    return F.when(F.size(out) == 0, F.array(F.lit(1))).otherwise(out)


def numeric_token(x: Column) -> Column:
    """A number for a file name: at most 8 decimals, no trailing zeros, 'p' for the point."""
    s = F.regexp_replace(F.regexp_replace(F.format_string("%.8f", x), "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    return F.replace(F.when(s == "-0", "0").otherwise(s), F.lit("."), F.lit("p"))


def process_number(c: Column) -> Column:
    """10 of 'proc-10', 0 of anything else."""
    return F.coalesce(F.regexp_extract(c, "^proc-([0-9]+)$", 1).try_cast("int"), F.lit(0))
