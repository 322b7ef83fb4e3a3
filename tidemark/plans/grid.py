"""Experiment grids: class entries with defaults and overrides to one spec per dataset, as DataFrames."""

from __future__ import annotations

import hashlib
import json
import os
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import class_dir_name, delta_list, numeric_token, slugify
from ..sources.generators import CONNECTIVITY

#: Sources other than generators, and the keys each needs.
PACKAGES = {"aeon": ("dataset_name",), "sktime": ("dataset_name",), "yfinance": ()}
CLASS = "class_pos int, mts_class string, generator string, package string, ms array<int>, ts array<int>, instances array<int>, single_ms array<int>, single_ts array<int>, single_instances array<int>, base_seed string, out_dir string, include_base boolean, base map<string,string>, variants array<struct<name:string,params:map<string,string>>>, labels array<string>"


def dataset_seed(*parts: Any, modulus: int = 2147483647, zero: int = 2147483647) -> int:
    """A seed from the parts joined by bars: eight bytes of BLAKE2s, reduced."""
    n = int.from_bytes(hashlib.blake2s("|".join(map(str, parts)).encode(), digest_size=8).digest(), "big") % modulus
    return n or zero


def _ints(x: Any) -> list[int]:
    if x is None:
        return []
    if isinstance(x, int):
        return list(range(x))
    return [int(v) for v in x]


def _text(v: Any) -> str:
    return v if isinstance(v, str) else json.dumps(v)


def _single(over, t: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Sizes that have but a few instances, with the lengths and instances of their own."""
    ms = [int(v) for v in over("single_instance_M_values", [])]
    return ms, [int(v) for v in over("single_instance_T_values", [])] or t, _ints(over("single_instance_instances", [0])) if ms else []


def read_config(path: str) -> dict:
    """An experiment file, YAML or JSON."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f) or {}


def write_config(config: dict, path: str) -> None:
    """YAML, keys in the order given; a local file of the driver."""
    import yaml

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(config, f, sort_keys=False)


def variant_suffix(params: dict[str, Any]) -> str:
    """Parameters in order of name, floats to three figures with p for the point, as a slug; empty without any."""
    shown = (f"{k}{format(v, '.3g').replace('.', 'p') if isinstance(v, float) else v}" for k, v in sorted(params.items()))
    text = "-".join(shown)
    return (re.sub(r"[^a-z0-9]+", "-", text.strip().lower()).strip("-") or "variant") if params else ""


def parse(config: dict) -> list[tuple]:
    """Rows of CLASS, checked."""
    d, rows = config.get("defaults") or {}, []
    for pos, c in enumerate(config.get("mts_classes") or []):
        name = c.get("name")
        if not name:
            raise ValueError("a class needs a name")
        if bool(c.get("generator")) == bool(c.get("package")):
            raise ValueError(f"{name}: one of generator and package")
        if c.get("package") and c["package"] not in PACKAGES:
            raise ValueError(f"{name}: unknown package {c['package']}")
        for key in PACKAGES.get(c.get("package"), ()):
            if not c.get(key):
                raise ValueError(f"{name}: {key} is missing")
        market = c.get("package") == "yfinance"
        assets = c.get("M") or c.get("assets") or c.get("m_assets") or len(c.get("tickers") or [])
        if market and not (c.get("tickers") or c.get("market")):
            raise ValueError(f"{name}: tickers or a market")
        if market and not assets:
            raise ValueError(f"{name}: M is missing")
        over = lambda key, default=None, c=c: c.get(key) or d.get(key) or default  # noqa: E731  an empty override falls back
        archive = c.get("package") in ("aeon", "sktime")
        m = [int(assets)] if market else [0] if archive else [int(v) for v in over("M_values", [])]
        t = [0] if c.get("package") else [int(v) for v in over("T_values", [])]
        variants = [(v.get("name") or variant_suffix(v.get("params") or {}) or None, {k: _text(x) for k, x in (v.get("params") or {}).items()}) for v in c.get("variants") or []]
        if archive:
            if not c.get("classes"):
                raise ValueError(f"{name}: classes are missing")
            variants = [(str(x), {"class": str(x)}) for x in c["classes"]]
        rows.append((pos, name, c.get("generator"), c.get("package"), m, t, _ints(over("instances", 1)), *(([], [], []) if c.get("package") else _single(over, t)), str(c.get("rng_seed", config.get("rng_seed", 0))), str(config.get("base_output_dir") or "data"), not archive and bool(c.get("include_base_variant", True)), {k: _text(x) for k, x in (c.get("base_params") or {}).items()}, variants, c.get("labels") or []))
    return rows


def expand(spark: SparkSession, config: dict) -> DataFrame:
    """One row per dataset, numbered from 1: classes in file order, then M, T, instance, and the variant innermost."""
    classes = spark.createDataFrame(parse(config), CLASS)
    regular = classes.select("*", F.posexplode(F.array_except("ms", "single_ms")).alias("m_pos", "m"), F.lit(0).alias("part")).select("*", F.col("instances").alias("insts"), F.col("ts").alias("lengths"))
    single = classes.select("*", F.posexplode("single_ms").alias("m_pos", "m"), F.lit(1).alias("part")).select("*", F.col("single_instances").alias("insts"), F.col("single_ts").alias("lengths"))
    cells = regular.unionByName(single).select("*", F.posexplode("lengths").alias("t_pos", "t")).select("*", F.posexplode("insts").alias("i_pos", "instance"))
    base = F.when(F.col("include_base"), F.array(F.struct(F.lit(None).cast("string").alias("name"), F.create_map().cast("map<string,string>").alias("params")))).otherwise(F.array().cast("array<struct<name:string,params:map<string,string>>>"))
    full = cells.select("*", F.posexplode(F.concat(base, "variants")).alias("v_pos", "v"))
    order = Window.orderBy("class_pos", "part", "m_pos", "t_pos", "i_pos", "v_pos")
    overlay = F.map_concat(F.map_filter("base", lambda k, _: ~F.array_contains(F.map_keys("v.params"), k)), "v.params")  # the variant wins
    param = lambda *names: F.coalesce(*[F.element_at("params", n) for n in names])
    size = F.concat(F.lit("M"), F.col("m"), F.lit("_T"), F.col("t"), F.lit("_I"), F.col("instance"))
    cls, number = F.lower("mts_class"), lambda c: F.when(c.try_cast("double").isNull(), slugify(c)).otherwise(numeric_token(c.try_cast("double")))
    aliases = {**CONNECTIVITY, "bidirectional-list": "bidirectional-list", "list": "bidirectional-list", "ring": "bidirectional-list"}
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    named = (
        F.when(cls.startswith("cml") & param("alpha").isNotNull() & param("eps", "epsilon").isNotNull(), F.concat(size, F.lit("_alpha"), number(param("alpha")), F.lit("-eps"), number(param("eps", "epsilon"))))
        .when((cls == "kuramoto") & param("connectivity", "coupling_scheme").isNotNull() & param("k", "K").isNotNull(), F.concat(size, F.lit("_"), F.element_at(known, F.regexp_replace(F.lower(F.trim(param("connectivity", "coupling_scheme"))), "[ _]", "-")), F.lit("-k-"), number(param("k", "K"))))
        .otherwise(size)
    )
    suffix = F.when(F.col("v.name").isNotNull(), slugify(F.col("v.name")))
    out = full.withColumn("params", overlay).withColumn("index", F.row_number().over(order)).withColumn("dataset_slug", F.concat_ws("_", named, suffix))
    seeds = out.select("index", "base_seed", "out_dir", "mts_class", "dataset_slug", F.coalesce(suffix, F.lit("")).alias("v"), size.alias("size")).collect()  # a study's specs, as many as its config lists
    seed = spark.createDataFrame([(r["index"], dataset_seed(r["base_seed"], r["out_dir"], r["mts_class"], r["dataset_slug"], r["v"], *r["size"].split("_"))) for r in seeds], "index int, seed long")
    folder = F.coalesce(F.nullif(class_dir_name(F.col("mts_class")), F.lit("")), F.lit("class"))
    done = out.join(seed, "index").withColumn("slug", F.concat_ws("_", folder, F.col("dataset_slug")))
    return done.select("index", "mts_class", F.coalesce("generator", "package").alias("generator"), "m", "t", "instance", F.col("v.name").alias("variant"), "params", "labels", "slug", "dataset_slug", F.concat_ws("/", "out_dir", folder, "dataset_slug").alias("dataset_dir"), "seed", delta_list(param("delta")).alias("deltas"))


def spec_at(specs: DataFrame, index: int) -> DataFrame:
    n = specs.count()
    if not 1 <= index <= n:
        raise IndexError(f"{index} is not in 1..{n}")
    return specs.filter(F.col("index") == index)
