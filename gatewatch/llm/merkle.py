"""Merkle manifest of a dataset: digests of rows, of groups and of all, and a proof for every row.

A tree is built by a nested-struct rollup.  Rows of a group are ranked; the binary digits of the rank, four
to a digit column, are grouped away from the lowest up, and each grouping nests the structs of its children in one struct
with the digests of its (up to) four binary levels.  Three columns make a block of at most 4,096 rows; the digests
of the blocks are the rows of the next, 4,096 times smaller tier, until each group has one block.  Within a block one
transform walks down the nested structs and hands every row its steps, and one explode emits the rows: no join.
Between tiers, one row for each block looks up the steps above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, running, saved, table

BITS, COLUMNS = 4, 3
BLOCK_BITS = BITS * COLUMNS
STEP = "struct<left:boolean,sibling:string>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts (texts) one after another."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """Digest of a row: each value as ``-`` if null, else its UTF-8 bytes' count, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def _level(children: Column, rows: Column, height: int) -> Column:
    """Digests one binary level above ``children``; the same where the tree ends below."""
    pairs = F.transform(F.sequence(F.lit(0), ((F.size(children) - 1) / 2).cast("int")),
                        lambda j: digest(F.get(children, 2 * j), F.coalesce(F.get(children, 2 * j + 1), F.lit(""))))
    return F.when(rows > 1 << height, pairs).otherwise(children)


def _steps(node: Column, digit: Column, rows: Column, height: int) -> Column:
    """The siblings of child ``digit`` in the four levels of ``node``, with the side they lie on."""
    at = [F.when(rows > 1 << (height + k),
                 F.struct((F.shiftright(digit, k).bitwiseAND(1) == 1).alias("left"),
                          F.get(node[f"l{k}"], F.shiftright(digit, k).bitwiseXOR(1)).alias("sibling")))
          for k in range(BITS)]
    return F.filter(F.array(*at), lambda s: s.isNotNull())


def _tier(nodes: DataFrame, tier: int) -> DataFrame:
    """Rows ``(g, n, i, digest, ...)`` -> one row ``(g, n, block, node)`` for 4,096 neighbouring ``i``.

    All groupings share one shuffle: each later key is a part of the first one's distribution on (g, block)."""
    payload = [c for c in nodes.columns if c not in ("g", "n", "i")]
    cur = nodes.select("g", "n", F.shiftright("i", BLOCK_BITS).alias("block"),
                       *(F.shiftright("i", BITS * c).bitwiseAND((1 << BITS) - 1).cast("int").alias(f"d{c}") for c in range(COLUMNS)),
                       F.struct(*payload).alias("node")).repartition("g", "block")
    for c in range(COLUMNS):
        higher = [f"d{x}" for x in range(c + 1, COLUMNS)]
        height = tier * BLOCK_BITS + c * BITS
        cur = cur.groupBy("g", "n", "block", *higher).agg(F.array_sort(F.collect_list(F.struct(f"d{c}", "node"))).alias("found"))
        cur = cur.withColumn("children", F.transform("found", lambda x: x["node"])).withColumn("l0", F.transform("children", lambda x: x["digest"]))
        for k in range(BITS):
            cur = cur.withColumn(f"l{k + 1}", _level(F.col(f"l{k}"), F.col("n"), height + k))
        cur = cur.select("g", "n", "block", *higher,
                         F.struct(F.get(f"l{BITS}", F.lit(0)).alias("digest"), *(f"l{k}" for k in range(BITS)), "children").alias("node"))
    return cur


def _emit(blocks: DataFrame, tier: int, above: list[str]) -> DataFrame:
    """The rows of the blocks again, each with its ``steps`` inside the block; ``above`` are columns to keep."""
    def walk(node: Column, column: int, path: Column) -> Column:
        height = tier * BLOCK_BITS + column * BITS

        def child(x: Column, digit: Column) -> Column:
            steps = F.concat(_steps(node, digit, F.col("n"), height), path)
            return walk(x, column - 1, steps) if column else F.array(F.struct(x.alias("node"), steps.alias("steps")))
        return F.flatten(F.transform(node["children"], child))

    rows = F.posexplode(walk(F.col("node"), COLUMNS - 1, F.array().cast(f"array<{STEP}>"))).alias("at", "row")
    return blocks.select("g", "n", *above, "block", rows).select(
        "g", "n", *above, (F.shiftleft("block", BLOCK_BITS) + F.col("at")).alias("i"), "row.node.*", "row.steps")


def build(nodes: DataFrame) -> list[DataFrame]:
    """Rows ``(g, n, i, digest, ...)``, ``i`` counting from 0 to ``n - 1`` in each group ``g`` (both long) -> the tiers
    of blocks; the last has one block, the root, for each group.

    The number of tiers follows the largest group; nothing but that number reaches the driver."""
    size, tiers = nodes.agg(F.max("n")).first()[0] or 0, []
    while True:
        blocks = saved(_tier(nodes, len(tiers)))
        tiers.append(blocks)
        size = -(-size // (1 << BLOCK_BITS))
        if size <= 1:
            return tiers
        nodes = blocks.select("g", "n", F.col("block").alias("i"), F.col("node.digest").alias("digest"))


def paths(tiers: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The rows that ``tiers`` were built from, each with ``steps`` up to the group's root and on along the steps of
    ``roots`` (one row ``(g, up, ...)`` for each group), whose other columns come along.

    What lies above a block is joined to the block, never to its rows."""
    extra = [c for c in roots.columns if c not in ("g", "up")]
    above = roots.withColumn("block", F.lit(0).cast("bigint"))
    for tier in range(len(tiers) - 1, -1, -1):
        rows = tiers[tier].join(above.select(F.col("g").alias("ug"), F.col("block").alias("ub"), *extra, "up"),
                                (F.col("g") == F.col("ug")) & (F.col("block") == F.col("ub"))).drop("ug", "ub")
        rows = _emit(rows, tier, [*extra, "up"]).withColumn("steps", F.concat("steps", "up")).drop("up")
        above = rows.select("g", F.col("i").alias("block"), *extra, F.col("steps").alias("up"))
    return rows


def fold(start: Column, steps: Column) -> Column:
    """The root that ``start`` and its siblings lead to."""
    return F.aggregate(steps, start, lambda acc, s: F.when(s["sibling"].isNull(), digest(acc))
                       .when(s["left"], digest(s["sibling"], acc)).otherwise(digest(acc, s["sibling"])))


def manifest(rows: DataFrame, key: str, group: str, leaf_digest: Column, **extra: Column) -> DataFrame:
    """One row per row of ``rows``: ``key``, ``leaf``, ``subroot``, ``root``, ``steps`` (from the leaf up: the sibling's
    digest, null for a lone node, and its side) and the columns ``extra``.

    Leaves of a ``group`` are ordered by key (null first), then digest; subroots by group (null first, bytewise).
    Rows equal in all columns have equal leaves, so their order does not show.  An empty table gives no rows.
    Leaves are digests from the first step on: texts are read once and never shuffled.
    """
    light = rows.select(F.col(key).alias("k"), F.col(group).alias("group"), leaf_digest.alias("digest"),
                        *(c.alias(f"x_{n}") for n, c in extra.items()), F.monotonically_increasing_id().alias("u"),
                        # texts of groups compare bytewise; null comes before the empty text
                        F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("g"))
    ranked = running(saved(light), "g", ["k", "digest", "u"], "i").withColumnRenamed("total_i", "n").drop("u", "group")
    tiers = build(ranked.withColumn("n", F.col("n").cast("long")).withColumn("i", F.col("i").cast("long")))
    subroots = tiers[-1].select(F.lit("").alias("all"), "g", F.col("node.digest").alias("digest"))
    tops = running(subroots, "all", ["g"], "i").select(F.lit("").alias("g"), F.col("total_i").cast("long").alias("n"),
                                                       F.col("i").cast("long").alias("i"), "digest", F.col("g").alias("group"))
    top = build(tops)
    root = top[-1].select("g", F.col("node.digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("up"))
    groups = paths(top, root).select(F.col("group").alias("g"), F.col("digest").alias("subroot"), "root", F.col("steps").alias("up"))
    return paths(tiers, groups).select(F.col("k").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "steps",
                                       *(F.col(f"x_{n}").alias(n) for n in extra))


@query("op11_merkle")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row in seven is tampered with after the manifest was made: its proof no longer leads to the root."""
    docs = table(spark, sf_dir, "documents")
    columns = lambda n: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = manifest(docs, "doc_id", "lang", columns(F.col("n_chars")), changed=F.when(tampered, columns(F.col("n_chars") + 1)))
    folded = fold(F.coalesce("changed", "leaf"), F.col("steps"))
    proof = digest(F.array_join(F.transform("steps", lambda s: F.coalesce(s["sibling"], F.lit(""))), ""))
    return (out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
