"""Sharding by balanced label propagation: linked documents come together, shard sizes stay even.

Documents with equal texts are linked; so are pairs of ids in `links`. A text's documents are interchangeable,
so what propagates is one row a text with its number of documents in each shard: a text that a third of all rows
share is one row too. All begin dealt out evenly. In each round a text's homes are the shards where it and its
links' texts have most documents (as many homes as it needs quotas), and its documents elsewhere ask to move
there. Moves are granted under quotas: between two shards as many as go the other way, besides those a share of the
target's room; the largest gains go first. Rounds end when links within shards no longer grow. Shards
never hold more than their quota of rows, so that documents without links, placed last, fill all up exactly: row
counts differ by one at most (the law `rows`).

Only DataFrame functions. No window has more than about the square root of all rows (numbers are dealt within
hashed parts, offsets are sums over the parts before); what comes to the driver is one number a shard or a pair of shards.

Edge cases: a null text counts as empty and links with empty ones; rows are told apart by place, so repeated and
null ids are documents of their own, and a link to an id means all its rows; links to unknown ids and to itself
say nothing; fewer rows than shards leave shards empty; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, prepare, release, written

OWNER = "shards"


def numbered(df: DataFrame, parts: list[str], amount: Column, salts: int, first: Column | None = None, by: str = "row") -> DataFrame:
    """df with `before`: the sum of amount over the part's earlier rows, in order of (first, hash of `by`, by).

    first: a small number that the order begins with. df is read twice.
    """
    cut = df.withColumns({"__first": F.lit(0) if first is None else first, "__salt": F.pmod(F.xxhash64(by), F.lit(salts)), "__n": amount})
    keys = [*parts, "__first", "__salt"]
    sums = cut.groupBy(*keys).agg(F.sum("__n").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(Window.partitionBy(*parts).orderBy("__first", "__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*keys, earlier.alias("__offset"))
    inner = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.join(offsets, keys).withColumn("before", F.col("__offset") + inner).drop("__first", "__salt", "__n", "__offset")


def even_share(upto: Column, k: int | Column, shards: int) -> Column:
    """How many of the numbers below upto leave the remainder k."""
    return F.floor((upto + (shards - 1) - k) / shards).cast("long")


def _state(texts: DataFrame, shards: int, salts: int) -> DataFrame:
    """Linked texts (g, n) with `at`, their documents in each shard: dealt out one by one over all shards."""
    o = F.col("before")
    at = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: even_share(o + F.col("n"), k, shards) - even_share(o, k, shards))
    return numbered(texts, [], F.col("n"), salts, by="g").select("g", "n", at.alias("at"))


def votes(state: DataFrame, edges: DataFrame | None, shards: int) -> DataFrame:
    """state with `vote`: for each shard the documents there of the text and of those linked with it; a text of one document doesn't count itself."""
    if edges is None:
        return state.withColumn("vote", F.col("at"))
    seen = edges.join(state.select(F.col("g").alias("b"), F.posexplode("at").alias("k", "c")), "b").filter("c > 0").groupBy(F.col("a").alias("g"), "k").agg(F.sum("c").alias("c"))
    by = seen.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("m"))
    vote = F.transform("at", lambda c, k: F.when(F.col("n") > 1, c).otherwise(0) + F.coalesce(F.try_element_at("m", k), F.lit(0)))
    return state.join(by, "g", "left").withColumn("vote", vote).drop("m")


def requests(voted: DataFrame, room: list[int], quota: int, settle: bool) -> DataFrame:
    """(g, src, dst, m, gain): documents outside their text's homes ask to go there.

    settle: shards with half the mean room, and for a text with room for all of it, come first, so that texts whose
    best shard is full get together elsewhere; a document then loses nothing by its move, or the whole text moves.
    """
    spare, half = F.array(*map(F.lit, room)), max(1, sum(room) // len(room) // 2)
    big = F.col("n") > quota
    open_ = lambda k: (F.element_at(spare, k + 1) >= F.greatest(F.lit(half), F.when(big, 0).otherwise(F.col("n") - F.col("at")[k]))) | (F.col("at")[k] == F.col("n"))
    order = F.sort_array(F.transform("vote", lambda v, k: F.struct((~(F.lit(settle) & open_(k))).alias("a"), (-v).alias("b"), F.xxhash64("g", k).alias("c"), k.alias("k"))))
    homes = F.transform(F.slice(order, F.lit(1), F.ceil(F.col("n") / quota).cast("int")), lambda s: s["k"])
    asked = voted.withColumn("homes", homes).select("g", "homes", "vote", big.alias("big"), F.posexplode("at").alias("src", "m")).filter(~F.array_contains("homes", F.col("src")) & (F.col("m") > 0))
    dst = F.element_at("homes", (F.pmod(F.xxhash64("g", "src"), F.size("homes")) + 1).cast("int"))
    gain = F.col("vote")[F.col("dst")] - F.col("vote")[F.col("src")]
    return asked.withColumn("dst", dst).withColumn("gain", gain).filter("gain >= 0 or not big").select("g", "src", "dst", "m", "gain")


def grants(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many may go from each shard to each: as many as come back, and a share of the room besides."""
    swap = {p: min(m, wanted.get(p[::-1], 0)) for p, m in wanted.items()}
    more = {p: m - swap[p] for p, m in wanted.items()}
    inbound = [sum(m for (_, d), m in more.items() if d == k) for k in range(len(room))]
    return {p: swap[p] + (m if inbound[p[1]] <= room[p[1]] else m * room[p[1]] // inbound[p[1]]) for p, m in more.items()}


def propagate(state: DataFrame, edges: DataFrame | None, quotas: list[int], salts: int, rounds: int) -> tuple[DataFrame, list[int]]:
    """The settled state, and the documents that it has in each shard."""
    spark, shards, best = state.sparkSession, len(quotas), -1
    measure = [F.sum(F.col("at")[k]).alias(f"l{k}") for k in range(shards)]
    for turn in range(rounds + 1):
        together = F.aggregate("at", F.lit(0).cast("decimal(38,0)"), lambda a, c: (a + c.cast("decimal(18,0)") * c.cast("decimal(18,0)")).cast("decimal(38,0)"))
        if edges is not None:
            voted = votes(state, edges, shards)
            together = F.aggregate(F.zip_with("at", "vote", lambda c, v: c.cast("decimal(18,0)") * v.cast("decimal(18,0)")), F.lit(0).cast("decimal(38,0)"), lambda a, c: (a + c).cast("decimal(38,0)"))
        else:
            voted = votes(state, None, shards)
        found = voted.agg(F.sum(together).alias("t"), *measure).first()
        loads = [found[f"l{k}"] or 0 for k in range(shards)]
        links = int(found["t"] or 0)
        if turn == rounds or turn % 2 == 0 and links <= best and (edges is None or turn >= 6):
            return state, loads
        best = max(links, best) if turn % 2 == 0 else best
        room = [q - x for q, x in zip(quotas, loads, strict=True)]
        # Linked texts would swap places for ever if all moved at once: half of them may, others each round.
        free = voted if edges is None else voted.filter(F.pmod(F.xxhash64("g", F.lit(turn)), F.lit(2)) == 0)
        asked = written(requests(free, room, max(1, min(quotas)), turn % 2 == 1), OWNER)
        wanted = {(r["src"], r["dst"]): r["m"] for r in asked.groupBy("src", "dst").agg(F.sum("m").alias("m")).collect()}  # a row a pair of shards
        may = grants(wanted, room)
        granted = asked
        if any(may[p] < m for p, m in wanted.items()):
            limits = spark.createDataFrame([(*p, q) for p, q in may.items()], "src int, dst int, most long")
            rank = F.lit(63) - F.floor(F.log2(F.greatest(F.col("gain"), F.lit(0)) + 1)).cast("int")
            before = numbered(asked, ["src", "dst"], F.col("m"), salts, first=rank, by="g").join(F.broadcast(limits), ["src", "dst"])  # a row a pair of shards
            granted = before.withColumn("m", F.greatest(F.lit(0), F.least("m", F.col("most") - F.col("before")))).filter("m > 0")
        moves = granted.groupBy("g").agg(F.collect_list(F.struct("src", "dst", "m")).alias("moves"))  # fewer than the shards
        change = lambda k: F.aggregate("moves", F.lit(0).cast("long"), lambda a, x: a + F.when(x["dst"] == k, x["m"]).otherwise(0) - F.when(x["src"] == k, x["m"]).otherwise(0))
        at = F.when(F.col("moves").isNull(), F.col("at")).otherwise(F.transform("at", lambda c, k: c + change(k)))
        state = written(state.join(moves, "g", "left").select("g", "n", at.alias("at")), OWNER)
    raise AssertionError


def shard(docs: DataFrame, shards: int = 24, links: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, group_size, mates (documents of the same text in the shard, itself not counted).

    links: pairs (a, b) of ids that belong together, besides equal texts.
    """
    spark = prepare(docs.sparkSession)
    release(spark, OWNER)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("g"))
    rows = written(slim, OWNER)
    total = rows.count()
    quotas = [(total + shards - 1 - k) // shards for k in range(shards)]
    salts = max(1, math.isqrt(total))
    # Counts by text and hashed part: they make the groups, and then number the rows of each.
    cells = written(rows.groupBy("g", F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt")).agg(F.count("*").alias("c")), OWNER)
    sizes = cells.groupBy("g").agg(F.sum("c").alias("n"))
    edges = None
    if links is not None:
        of = rows.select("doc_id", "g").distinct()
        pair = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).join(of.select(F.col("doc_id").alias("a"), F.col("g").alias("ga")), "a").join(of.select(F.col("doc_id").alias("b"), F.col("g").alias("gb")), "b").filter("ga <> gb").select("ga", "gb")
        edges = written(pair.unionByName(pair.select(F.col("gb").alias("ga"), F.col("ga").alias("gb"))).distinct().select(F.col("ga").alias("a"), F.col("gb").alias("b")), OWNER)
        sizes = sizes.join(edges.select(F.col("a").alias("g"), F.lit(True).alias("tied")).distinct(), "g", "left").filter("n > 1 or tied").drop("tied")
    else:
        sizes = sizes.filter("n > 1")
    state, loads = propagate(written(_state(written(sizes, OWNER), shards, salts), OWNER), edges, quotas, salts, rounds)
    # A text's documents, numbered over its cells, go to its shards by ranges of their numbers.
    before = F.coalesce(F.sum("c").over(Window.partitionBy("g").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice("at", F.lit(1), k), F.lit(0).cast("long"), lambda a, c: a + c))
    placed = cells.join(state, "g").select("g", "salt", "n", "at", ends.alias("ends"), before.alias("before"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts))).join(placed, ["g", "salt"], "left")
    index = F.col("before") + F.row_number().over(Window.partitionBy("g", "salt").orderBy("row")) - 1
    where = F.when(F.col("n").isNotNull(), F.size(F.filter("ends", lambda e: e <= F.col("index"))))
    held = salted.withColumn("index", index).withColumn("shard", where)
    held = written(held.select("row", "doc_id", "size", "text_crc32", "shard", F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.when(F.col("n").isNotNull(), F.col("at")[F.col("shard")] - 1).otherwise(F.lit(0)).cast("long").alias("mates")), OWNER)
    tied = numbered(held.filter("shard is not null"), ["shard"], F.lit(1).cast("long"), salts)
    # The others fill each shard from its load to its quota.
    room = list(accumulate((q - x for q, x in zip(quotas, loads, strict=True)), initial=0))
    loose = numbered(held.filter("shard is null"), [], F.lit(1).cast("long"), salts).withColumn("shard", F.size(F.filter(F.array(*map(F.lit, room[1:])), lambda e: e <= F.col("before"))))
    start = F.element_at(F.array(*[F.lit(x - r) for x, r in zip(loads, room[:-1], strict=True)]), F.col("shard") + 1)
    both = tied.unionByName(loose.withColumn("before", F.col("before") + start))
    return both.select("doc_id", "size", "text_crc32", "shard", F.col("before").cast("long").alias("slot"), "group_size", "mates")
