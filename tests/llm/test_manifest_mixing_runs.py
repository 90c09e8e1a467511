"""Merkle manifest, mixing and periodic runs: brute force, odd rows, planted cases."""

import hashlib
import random
import zlib
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch.llm import QUERIES, merkle, mixing, runs


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Merkle manifest

def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes):
    """Root, and for each node its siblings (empty where it is alone)."""
    at, siblings = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, p in enumerate(at):
            siblings[i].append(nodes[p ^ 1] if p ^ 1 < len(nodes) else "")
            at[i] = p // 2
        nodes = [sha(*nodes[j:j + 2]) for j in range(0, len(nodes), 2)]
    return nodes[0], siblings


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, verified) for rows (doc_id, source, lang, n_chars, text)."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    subs, below = [], []
    for x in order:
        part = sorted(langs[x], key=lambda r: (r[0] is not None, r[0] or 0, sha(*map(enc, r))))
        leaves = [sha(*map(enc, r)) for r in part]
        sub, paths = plain_tree(leaves)
        subs.append(sub)
        below.append(list(zip(part, leaves, paths)))
    root, above = plain_tree(subs)
    out = []
    for sub, up, part in zip(subs, above, below):
        for r, leaf, path in part:
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            out.append((r[0], leaf, sub, root, sha(*path, *up), not tampered))
    return sorted(out, key=str)


def spark_manifest(spark, rows, tmp_path):
    schema = "doc_id long, source string, lang string, n_chars long, text string, g string, k string, digest string, node string"
    spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = merkle.op11(spark, str(tmp_path)).collect()
    assert all((r.folded_root == r.root) == r.verified for r in out)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in out), key=str)


def test_manifest_matches_plain_trees(spark, tmp_path, monkeypatch):
    # small blocks make several tiers out of a few rows
    monkeypatch.setattr(merkle, "COLUMNS", 1)
    monkeypatch.setattr(merkle, "BLOCK_BITS", 4)
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", None, "ü"]), rng.choice(["en"] * 12 + ["", None, "zé", "ab", *"0123456789"]), rng.choice([None, 3, 500]), f"text {i} 한") for i in range(400)]
    rows += [(900, "s", "one", 1, None), (None, None, None, None, None), (None, "s", "en", 5, "x"), (7, "s", "en", 5, ""), *[(8, "s", "en", 5, "same")] * 5]
    assert spark_manifest(spark, rows, tmp_path) == plain_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 17])
def test_manifest_of_few_rows(spark, tmp_path, n):
    rows = [(i, "s", "en", i, "t") for i in range(n)]
    assert spark_manifest(spark, rows, tmp_path) == plain_manifest(rows)


def test_manifest_of_no_rows_and_long_texts(spark, tmp_path):
    assert spark_manifest(spark, [(1, "s", "l", 2, "x" * 1_000_000)], tmp_path / "a") == plain_manifest([(1, "s", "l", 2, "x" * 1_000_000)])
    spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(str(tmp_path / "b/documents.parquet"))
    assert merkle.op11(spark, str(tmp_path / "b")).count() == 0


# mixing

def test_law_is_hypergeometric(spark):
    n, (a, b, d) = 20_000, (30, 50, 20)
    got = Counter(r.k for r in spark.range(n).select(mixing.hypergeometric(F.lit(a), F.lit(b), F.lit(d), mixing.uniform(F.col("id"))).alias("k")).collect())
    off = sum(abs(got[k] / n - comb(a, k) * comb(b, d - k) / comb(a + b, d)) for k in range(d + 1)) / 2
    assert off < 0.02
    edges = spark.range(50).select(*(mixing.hypergeometric(F.lit(x), F.lit(y), F.lit(z), mixing.uniform(F.col("id"))).alias(f"c{i}")
                                     for i, (x, y, z) in enumerate([(0, 5, 3), (5, 0, 3), (5, 5, 0), (3, 1, 4), (1, 9, 9)]))).collect()
    assert all(tuple(r)[:4] == (0, 3, 0, 3) and r[4] in (0, 1) for r in edges)


@pytest.mark.parametrize("fan", [1024, 3])
def test_tree_keeps_both_margins(spark, monkeypatch, fan):
    monkeypatch.setattr(mixing, "FAN", fan)
    q = [5, 0, 17, 100, 1, 33, 8, 2]
    got = mixing.split(spark.createDataFrame(list(enumerate(q)), "i long, q long"), 6, sum(q), len(q)).collect()
    assert [sum(r.q for r in got if r.i == i) for i in range(len(q))] == q
    totals = [sum(r.q for r in got if r.shard == s) for s in range(6)]
    assert sum(totals) == sum(q) and max(totals) - min(totals) <= 1 and min(r.q for r in got) >= 0


def plain_targets(sizes):
    """Targets as the contract has them, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / max(sum(w[s] for s in free), 1)
        above = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not above:
            return {s: 2 * sizes[s] if s in full else w[s] * level for s in order}
        full |= above


DOCS = "doc_id long, source string, text string, r string, g string, size long, h string, block long, shard int"


def docs_table(spark, rows):
    return spark.createDataFrame([(*r, "r", "g", 1, "h", 2, 3) for r in rows], DOCS).repartition(3)


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 9 + ["b", "ç", "z", None, ""]), " ".join(["w"] * rng.randint(0, 60)) or rng.choice([None, "", " \n"])) for i in range(700)]
    rows += [(None, "hot", "a b c"), (3, "hot", "long " * 5_000), *[(4, "b", "same text")] * 6, (5, "empty", None)]
    pieces, base = mixing.mix(docs_table(spark, rows), block=64, shards=4, with_text=True)
    base = {r.r: r for r in base.collect()}
    pieces = pieces.collect()
    assert len(base) == len(rows)
    taken = Counter()
    for p in pieces:
        taken[p.r] += p.words
        assert len(p.piece.split(" ")) == p.words
    sizes = Counter()
    for i, s, t in rows:
        sizes[s] += len((t or "").split())
    want, by_target = plain_targets(sizes), {}
    assert sorted(round(x.target, 6) for x in base.values()) == sorted(round(want[s], 6) for _, s, _ in rows)
    for x in base.values():
        assert taken[x.r] <= 2 * x.size
        by_target.setdefault((x.source_size, x.target), []).append(taken[x.r])
    for (_, target), got in by_target.items():
        assert abs(sum(got) - target) <= 0.5 * sum(1 for s in sizes if want[s] == target)
    # draws of a pass are disjoint: no word of a row twice in one pass
    seen = Counter((p.r, p["pass"], w) for p in pieces for w in range(p.start, p.start + p.words))
    assert max(seen.values()) == 1
    blocks = {(p["pass"], p.g, p.block): p.shard for p in pieces}
    assert all(blocks[p["pass"], p.g, p.block] == p.shard for p in pieces)
    shards = Counter(blocks.values())
    assert max(shards.values()) - min(shards.values()) <= 1


def test_mix_is_the_same_again_and_on_other_files(spark):
    rows = [(i, f"s{i % 4}", "w " * (i % 90)) for i in range(300)]
    def run(n):
        p, _ = mixing.mix(docs_table(spark, rows).repartition(n), block=32)
        return sorted((x.doc_id, x.shard, x["pass"], x.block, x.start, x.words) for x in p.collect())
    assert run(2) == run(5)


def test_mix_of_nothing(spark):
    for rows in ([], [(1, None, None), (2, "a", "")]):
        pieces, base = mixing.mix(docs_table(spark, rows).filter("doc_id is not null"))
        assert pieces.count() == 0 and base.count() == len(rows)
        assert all((x.size, x.source_size, x.target) == (0, 0, 0.0) for x in base.collect())
    p, _ = mixing.mix(docs_table(spark, [(i, "s", "a b c") for i in range(50)]), block=8)
    assert mixing.shuffled(p).count() == p.count()


# periodic runs

def plain_runs(x):
    out = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_row(k, text, change):
    words = (text or "").encode().split()
    words = change(words, k) if change else words
    found = plain_runs(words)
    drop = {w for s, n, q in found for w in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (k, len(words), len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha(*(f"{s},{n},{q}\n" for s, n, q in found)), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())


def test_cover_meets_every_difference():
    assert {(b - a) % runs.MODULUS for a in runs.COVER for b in runs.COVER} == set(range(runs.MODULUS))


def test_extension_matches_plain_loop():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (30, 1), (200, 2), (300, 1), (90, 40)):
        x = rng.integers(1, k + 1, n)
        ext = runs.Extension(x)
        i, j = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(n)))
        i, j = i[i != j], j[i != j]
        want = [next((t for t in range(n) if max(a, b) + t >= n or x[a + t] != x[b + t]), 0) for a, b in zip(i, j)]
        assert ext(i, j).tolist() == want


def test_runs_match_plain_loop(spark, make, odd_rows):
    rng = random.Random(2)
    rows = [r for r in odd_rows if len(r[1] or "") < 10_000]
    for i in range(120):
        n, k = rng.choice([0, 3, 6, 40, 200]), rng.choice([1, 2, 3, 30])
        rows.append((100 + i, " \n".join(f"w{rng.randint(1, k)}" for _ in range(n))))
    for change in (None, runs.planted):
        got = sorted((tuple(r) for r in runs.find_runs(make(*rows), change=change).collect()), key=str)
        assert got == sorted((plain_row(k, t, change) for k, t in rows), key=str)
    assert runs.find_runs(make(*rows).limit(0)).count() == 0


def test_runs_of_the_tables_and_of_long_texts(spark, sf, make):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("length(text) < 6000").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_runs"](spark, sf).collect()}
    assert all(got[d.doc_id] == plain_row(d.doc_id, d.text, runs.planted) for d in docs)
    assert sum(r[2] for r in got.values()) > 0
    one = runs.find_runs(make((1, "word " * 300_000), (2, " ".join(str(i % 70_000) for i in range(300_000))))).collect()
    assert sorted((r.n_runs, r.start, r.length, r.period) for r in one) == [(1, 0, 300_000, 1), (1, 0, 300_000, 70_000)]
