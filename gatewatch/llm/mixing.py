"""Mixing sources to target weights: exact quotas of blocks, split at random among output shards.

The words of a source lie end to end, its documents in an order drawn by hash, and are cut into blocks of equal length
(the last may be shorter).  A target in words is so many draws of blocks: whole passes over the source first, then
a part of one more pass, the last draw cut to the word.  The draws of all sources are dealt to the shards by
a splitting tree: a node halves its shards, and how many draws of each source go left follows the multivariate
hypergeometric law, as if all draws had been shuffled and cut in two; totals of shards and of sources stay exact.
Each pass permutes the blocks of a source by hash; the shards take consecutive, disjoint stretches of these draws.

Everything is DataFrame and SQL functions; the law is drawn by summing its ratios around the mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, running, saved, table

WORDS = r"[^\x20\x09-\x0D]+"
#: Sources that one draw of the law handles in a row; more sources are drawn in groups first.
FAN = 1024


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the parts' MD5."""
    text = F.concat_ws("#", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``good + bad`` things are good, by inversion of ``u``.

    Weights relative to the mode are summed to both sides over 12 standard deviations (what lies beyond is below
    the precision of a double), so the work grows with the standard deviation, not with the counts.
    """
    def drawn(s):
        a, b, d = (s[x].cast("double") for x in ("a", "b", "d"))
        up = F.when(s["m"] < s["hi"], F.sequence(s["m"], s["hi"] - 1)).otherwise(F.array().cast("array<bigint>"))
        down = F.when(s["m"] > s["lo"], F.sequence(s["m"], s["lo"] + 1, F.lit(-1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))

        def walk(ks, ratio, x):
            return F.aggregate(ks, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n")),
                               lambda acc, k: _let(acc["w"] * ratio(k.cast("double")), lambda w: F.struct(
                                   w.alias("w"), (acc["s"] + w).alias("s"),
                                   (acc["n"] + F.when(acc["s"] + w < x, 1).otherwise(0)).alias("n"))))

        rise = lambda k: (a - k) * (d - k) / ((k + 1) * (b - d + k + 1))
        fall = lambda k: k * (b - d + k) / ((a - k + 1) * (d - k + 1))
        sums = F.struct(walk(up, rise, F.lit(0.0))["s"].alias("up"), walk(down, fall, F.lit(0.0))["s"].alias("down"))
        return _let(sums, lambda t: _let(s["u"] * (1 + t["up"] + t["down"]), lambda x:
                    F.when(x < 1, s["m"])
                    .when(x < 1 + t["up"], F.least(s["hi"], s["m"] + 1 + walk(up, rise, x - 1)["n"]))
                    .otherwise(F.greatest(s["lo"], s["m"] - 1 - walk(down, fall, x - 1 - t["up"])["n"]))))

    def bounds(s):
        a, b, d = (s[x].cast("double") for x in ("a", "b", "d"))
        n = a + b
        sd = F.sqrt(d * (a / n) * (b / n) * ((n - d) / F.greatest(n - 1, F.lit(1.0))))
        lo, hi = F.greatest(s["d"] - s["b"], F.lit(0)), F.least(s["a"], s["d"])
        m = F.greatest(lo, F.least(hi, F.floor((d + 1) * (a + 1) / (n + 2))))
        r = F.ceil(12 * sd) + 30
        return F.struct(s["a"], s["b"], s["d"], s["u"], m.alias("m"), F.greatest(lo, m - r).alias("lo"), F.least(hi, m + r).alias("hi"))

    args = F.struct(good.cast("bigint").alias("a"), bad.cast("bigint").alias("b"), draws.cast("bigint").alias("d"), u.alias("u"))
    return F.when((good == 0) | (draws == 0), F.lit(0).cast("bigint")).when(bad == 0, draws.cast("bigint")).otherwise(
        _let(args, lambda s: _let(bounds(s), drawn)))


def _left(rows: DataFrame, wanted: Column, sources: int, seed: int) -> DataFrame:
    """Rows ``(lo, hi, i, q)`` of the tree's nodes -> the same with ``left``, the draws of source ``i`` that go
    left; they sum to ``wanted`` in each node."""
    tiers = [rows]
    while sources > FAN:
        rows = rows.groupBy("lo", "hi", F.floor(F.col("i") / FAN).alias("i")).agg(F.sum("q").alias("q"))
        tiers.append(rows)
        sources = -(-sources // FAN)
    left = None
    for tier in reversed(range(len(tiers))):
        node = tiers[tier].groupBy("lo", "hi", F.floor(F.col("i") / FAN).alias("group")).agg(
            F.array_sort(F.collect_list(F.struct("i", "q"))).alias("items"), F.sum("q").alias("rest"))
        node = (node.withColumn("d", wanted) if left is None
                else node.join(left.select("lo", "hi", F.col("i").alias("group"), F.col("left").alias("d")), ["lo", "hi", "group"]))
        start = F.struct(F.col("rest"), F.col("d").cast("bigint").alias("d"), F.array().cast("array<bigint>").alias("out"))

        def draw(acc, x):
            u = uniform(F.lit(seed), F.lit(tier), F.col("lo"), F.col("hi"), x["i"])
            return _let(hypergeometric(x["q"], acc["rest"] - x["q"], acc["d"], u), lambda k: F.struct(
                (acc["rest"] - x["q"]).alias("rest"), (acc["d"] - k).alias("d"), F.concat(acc["out"], F.array(k)).alias("out")))

        out = F.aggregate("items", start, draw)["out"]
        both = F.explode(F.arrays_zip(F.col("items"), out.alias("left"))).alias("x")
        left = node.select("lo", "hi", both).select("lo", "hi", "x.items.i", "x.items.q", "x.left")
    return left


def split(quotas: DataFrame, shards: int, total: int, sources: int, seed: int = 0) -> DataFrame:
    """``(i, q)``: draws of each source, numbered from 0 -> ``(i, shard, q)``.  Shard totals differ by one at most."""
    edge = lambda c: F.floor(F.lit(total).cast("decimal(30,0)") * c / shards).cast("bigint")
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "i", "q")
    width = shards
    while width > 1:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        done = nodes.filter("hi - lo = 1")
        open_ = _left(nodes.filter("hi - lo > 1"), edge(mid) - edge(F.col("lo")), sources, seed)
        halves = F.explode(F.array(F.struct(F.col("lo"), mid.alias("hi"), F.col("left").alias("q")),
                                   F.struct(mid.alias("lo"), F.col("hi"), (F.col("q") - F.col("left")).alias("q")))).alias("x")
        nodes = saved(open_.select("i", halves).select("x.lo", "x.hi", "i", "x.q").unionByName(done))
        width = -(-width // 2)
    return nodes.select("i", F.col("lo").alias("shard"), "q")


def targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``(g, size, ...)`` with ``i`` (rank by ``g``), ``weight`` (the list repeats) and ``target``: ``share`` of all sizes
    by weight, none above ``most`` times its size; what lies above goes to the others by weight, until none is above.

    Each round brings three sums to the driver; sources themselves stay where they are.
    """
    ranked = running(sources.withColumn("all", F.lit(0)), "all", ["g"], "i").drop("all", "total_i")
    ranked = saved(ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)),
                                                            (F.col("i") % len(weights) + 1).cast("int"))))
    words = ranked.agg(F.sum("size")).first()[0] or 0
    level, capped = 0.0, None
    while True:
        above = F.col("weight") * level > F.col("size") * most
        free = ranked.agg(F.sum(F.when(~above, F.col("weight"))), F.sum(F.when(above, F.col("size"))), F.sum(above.cast("bigint"))).first()
        if free[2] == capped or not free[0]:
            break
        capped = free[2]
        level = (share * words - most * (free[1] or 0)) / free[0]
    return ranked.withColumn("target", F.least(F.col("weight") * level, F.col("size") * most))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: list[float] = (5, 2, 1),
        share: float = 1.5, most: float = 2.0, shards: int = 8, block: int = 4096, seed: int = 0,
        with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mix and its base: ``pieces`` (``r, key, shard, pass, block, start, words``, and ``piece`` with
    ``with_text``: the words from ``start`` on, joined by spaces) and ``rows`` (``r, key, size, source_size, target``),
    one for each row of ``docs``; ``r`` numbers the rows of both.

    Sources go by code point, null last (a source of its own).  Null, empty and blank texts have size 0 and no pieces; repeated
    rows are rows of their own, told apart by ``r`` alone; null keys are like others.  A source's pieces sum to
    its target, rounded, and no word is taken more than ``most`` (a whole number) times.  Equal input gives equal results.
    Other columns are not read.  An empty table gives none.
    """
    if most != int(most) or most < 1:
        raise ValueError("most is a whole number from 1 on")
    body = F.coalesce(F.col(text), F.lit(""))
    # ordered by code point, null last
    g = F.coalesce(F.concat(F.lit("+"), F.col(source).cast("string")), F.lit("-"))
    light = saved(docs.select(F.monotonically_increasing_id().alias("r"), F.col(key).alias("k"), g.alias("g"),
                              F.regexp_count(body, F.lit(WORDS)).cast("bigint").alias("size"),
                              F.md5(F.concat_ws("#", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.md5(body.cast("binary")))).alias("h"),
                              *([body.alias("body")] if with_text else [])))
    sources = targets(saved(light.groupBy("g").agg(F.sum("size").alias("size"))), list(weights), share, most)
    sources = sources.withColumn("take", F.least(F.round("target").cast("bigint"), F.col("size") * int(most)))
    sources = sources.withColumns({
        "full": F.floor(F.col("size") / block).cast("bigint"),
        "blocks": F.ceil(F.col("size") / block).cast("bigint"),
        "passes": F.when(F.col("size") > 0, F.floor(F.col("take") / F.col("size"))).otherwise(0).cast("bigint")})
    sources = sources.withColumn("rest", F.col("take") - F.col("passes") * F.col("size"))
    sources = sources.withColumn("q", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("bigint"))
    sources = saved(sources)
    total, n = sources.agg(F.sum("q"), F.count("*")).first()
    dealt = split(sources.select("i", "q"), shards, total or 0, n, seed)
    ends = dealt.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("shard", "q"))).alias("c")).select(
        F.col("i").alias("si"), F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: F.aggregate(
            F.slice(F.col("c"), F.lit(1), s), F.lit(0).cast("bigint"), lambda acc, x: acc + x["q"])).alias("ends"))
    sources = saved(sources.join(ends, F.col("i") == F.col("si")).drop("si"))

    # the source's words end to end, cut into blocks
    laid = running(light.filter("size > 0").select("r", "k", "g", "size", "h"), "g", ["h", "r"], "at", F.col("size"))
    b = F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block")
    cut = laid.select("r", "k", "g", "at", "size", b)
    begin = F.greatest(F.col("at"), F.col("block") * block)
    pieces = saved(cut.select("r", "k", "g", "block", (begin - F.col("at")).alias("start"), (begin - F.col("block") * block).alias("from"),
                              (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - begin).alias("words")))
    # each pass in its own order; the short block, if any, comes last
    passes = F.explode(F.sequence(F.lit(0), F.lit(int(most) - 1))).alias("pass")
    info = sources.select(F.col("g").alias("sg"), "full", "blocks", "passes", "rest", "q", "ends", F.col("size").alias("source_size"))
    draws = saved(pieces.filter("`from` = 0").select("g", "block", passes)
                  .select(F.concat_ws("#", "pass", "g").alias("pg"), "g", "block", "pass", F.md5(F.concat_ws("#", F.lit(seed), "g", "pass", "block")).alias("h")))
    draws = running(draws, "pg", ["h", "block"], "at").select("g", "block", "pass", "h", "at")
    # the short block leaves the order: what comes behind it moves up by one
    short = draws.join(info.select("sg", "full", "blocks"), F.col("g") == F.col("sg")).filter("block = full")
    draws = draws.join(short.select(F.col("g").alias("xg"), F.col("pass").alias("xp"), F.col("at").alias("short_at")),
                       (F.col("g") == F.col("xg")) & (F.col("pass") == F.col("xp")), "left").join(info, F.col("g") == F.col("sg"))
    place = F.when(F.col("block") == F.col("full"), F.col("full")).otherwise(
        F.col("at") - F.when(F.col("short_at") < F.col("at"), 1).otherwise(0))
    draws = draws.withColumn("j", F.col("pass") * F.col("blocks") + place).filter("j < q")
    last = F.when((F.col("rest") > 0) & (F.col("j") == F.col("q") - 1), F.col("rest") - F.floor((F.col("rest") - 1) / block) * block).otherwise(block)
    draws = draws.select(F.col("g").alias("dg"), F.col("block").alias("db"), "pass", last.alias("upto"),
                         F.size(F.filter("ends", lambda e: e <= F.col("j"))).alias("shard"))
    mixed = pieces.join(draws, (F.col("g") == F.col("dg")) & (F.col("block") == F.col("db"))).withColumn(
        "words", F.least(F.col("words"), F.col("upto") - F.col("from"))).filter("words > 0")
    mixed = mixed.select("r", F.col("k").alias(key), "shard", "pass", "g", "block", "start", "words")
    if with_text:
        found = F.regexp_extract_all("body", F.lit(WORDS), F.lit(0))
        mixed = mixed.join(light.select(F.col("r").alias("lr"), "body"), F.col("r") == F.col("lr")).withColumn(
            "piece", F.concat_ws(" ", F.slice(found, F.col("start").cast("int") + 1, F.col("words").cast("int")))).drop("lr", "body")
    rows = light.select("r", "k", "g", "size").join(sources.select(F.col("g").alias("sg"), F.col("size").alias("source_size"), "target"),
                                                    F.col("g") == F.col("sg"))
    return mixed, rows.select("r", F.col("k").alias(key), "size", "source_size", "target")


def shuffled(pieces: DataFrame, parts: int = 16, seed: int = 0) -> DataFrame:
    """The pieces of each shard dealt to ``parts`` at random and shuffled there, for a writer that partitions by shard."""
    order = F.xxhash64(F.lit(seed), "g", "pass", "block", "r", "start")
    return (pieces.withColumn("part", F.pmod(order, F.lit(parts)).cast("int")).withColumn("order", F.xxhash64(order))
            .repartition("shard", "part").sortWithinPartitions("shard", "part", "order", "r").drop("order"))


@query("op12_mixing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, rows = mix(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy(F.col("r").alias("pr")).agg(F.sum("words").alias("taken"))
    return rows.join(taken, F.col("r") == F.col("pr"), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"))
