"""String rules of studies: lists, labels of subsets, market names, feature names, directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def comma_list(c: Column) -> Column:
    """'a, b,,c' to [a, b, c]; null and empty give []."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def market_key(c: Column) -> Column:
    """Lower case, without hyphens, underscores and spaces; an ampersand is 'and'."""
    return F.replace(F.regexp_replace(F.lower(c), "[-_ ]", ""), F.lit("&"), F.lit("and"))


def subset_label(path: Column) -> Column:
    """A subset file's name without its folder and last suffix; 'all' without a file."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.when(path.isNull() | (name == ""), F.lit("all")).otherwise(F.regexp_replace(name, "(?<=.)[.][^.]*$", ""))


def direction(c: Column) -> Column:
    """(base, direction) of a directed vector's name: cov__ij to cov and ij; an undirected one has none."""
    way = F.regexp_extract(c, "__(ij|ji)$", 1)
    return F.struct(F.regexp_replace(c, "__(ij|ji)$", "").alias("base"), F.nullif(way, F.lit("")).alias("direction"))


def feature_name(a: Column, b: Column) -> Column:
    return F.concat_ws("|", a, b)


def feature_parts(c: Column) -> Column:
    """The two statistics of a feature's name, split at the first bar; the second is null without one."""
    at = F.split(c, "[|]", 2)
    return F.struct(at[0].alias("spi_a"), F.get(at, F.lit(1)).alias("spi_b"))


def class_pair(a: Column, b: Column) -> Column:
    """The name of two classes' results, in order of name."""
    return F.concat_ws("_vs_", F.array_sort(F.array(a, b)))

