"""Jaccard join, packing, top-k, LM scores, sharding and the pipeline against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gatewatch.llm import QUERIES, jaccard, lm, packing, sharding, topk


# Jaccard join

def brute_components(docs, k, num, den):
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies(seed, n, words=400, low=1, high=120):
    rng = np.random.default_rng(seed)
    docs = []
    for d in range(n):
        if d % 3 and docs:
            w = docs[int(rng.integers(max(0, d - 9), d))][1].split()
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, words)}"
            if d % 2:
                w += [f"x{rng.integers(0, words)}"] * int(rng.integers(0, 3))
        else:
            w = [f"x{i}" for i in rng.integers(0, words, rng.integers(low, high))]
        docs.append((d, " ".join(w)))
    return docs


@pytest.mark.parametrize(("k", "num", "block"), [(3, 90, 500_000), (5, 80, 500_000), (2, 60, 500_000), (5, 80, 120), (3, 90, 60)])
def test_components_match_brute_force(make, k, num, block):
    docs = near_copies(num + k, 150)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           jaccard.near_duplicates(make(*docs), k, num, 100, block_shingles=block).collect()}
    assert got == brute_components(docs, k, num, 100)


def test_components_on_the_tables(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op8_jaccard_join"](spark, sf).collect()}
    assert got == brute_components(docs, 3, 90, 100)


def test_hot_group_in_many_blocks(make):
    base = [f"b{i}" for i in range(200)]
    docs = [(d, " ".join([*base[:d % 190], f"v{d}", *base[d % 190 + 1:]])) for d in range(120)]
    rows = jaccard.near_duplicates(make(*docs), 3, 90, 100, block_shingles=2000).collect()
    assert {r["component_id"] for r in rows} == {0} and sum(r["keep"] for r in rows) == 1


def test_tree_prunes_only_what_cannot_link():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(80)]
    nodes = [jaccard.signature_tree(sets, [i], 64) for i in range(80)]
    for a in range(80):
        for b in range(80):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 10 * n >= 7 * (len(sets[a]) + len(sets[b]) - n):
                assert jaccard.may_link(nodes[a], nodes[b], 7, 10)


def test_jaccard_odd_rows(odd):
    rows = jaccard.near_duplicates(odd, 5, 80, 100).collect()
    assert len(rows) == odd.count()
    assert sum(r["keep"] for r in rows) == 8  # four empty ones, one of three short, one of two long, 5, 8
    assert {r["component_id"] for r in rows if r["n_shingles"] == 1 and r["doc_id"] in (4, None)} == {4}
    out = jaccard.one_of_each(odd)
    assert out.columns == odd.columns and out.count() == 8
    assert jaccard.one_of_each(odd.limit(0)).count() == 0


def test_near_copies_when_scans_split_otherwise(spark, make, tmp_path, monkeypatch):
    """The table's scans are split in another way after every step, as when executors come and go."""
    docs = near_copies(11, 150)
    for i in range(6):
        make(*docs[i::6][:5 + 4 * i]).coalesce(1).write.parquet(f"{tmp_path}/{i}")
    table = spark.read.parquet(*(f"{tmp_path}/{i}" for i in range(6)))
    want = brute_components([(r["doc_id"], r["text"]) for r in table.collect()], 3, 90, 100)
    cost, step = "spark.sql.files.openCostInBytes", iter(range(10**6))
    before, save = spark.conf.get(cost), jaccard.saved

    def resplit(df):
        out = save(df)
        spark.conf.set(cost, ("128m", "0")[next(step) % 2])
        return out

    monkeypatch.setattr(jaccard, "saved", resplit)
    try:
        spark.conf.set(cost, "0")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(table, 3, 90, 100).collect()}
        spark.conf.set(cost, "0")
        kept = sorted(r["doc_id"] for r in jaccard.one_of_each(table, shingle=3, num=90).collect())
    finally:
        spark.conf.set(cost, before)
    assert got == want
    assert kept == sorted({c for _, c in want.values()})


# packing

def brute_ids(text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_tokenizer())
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def check_packing(docs, rows, length):
    """Every id once, in order; sequences gapless, full but for powers of two."""
    from tokenizers import Tokenizer
    enc = Tokenizer.from_file(packing.default_tokenizer())
    ids = {}
    for d, t in docs:
        ids.setdefault(d, []).append(np.array(enc.encode(t or "", add_special_tokens=False).ids + [0], "<u4"))
    total = sum(len(x) for v in ids.values() for x in v)
    assert sum(r["length"] for r in rows) == total
    seqs = {}
    for r in rows:
        assert any(zlib.crc32(x[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and len(x) == r["doc_tokens"] for x in ids[r["doc_id"]])
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, v in ids.items():
        assert sum(r["length"] for r in rows if r["doc_id"] == d) == sum(map(len, v))
    for s, parts in seqs.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == length or (at < length and at & (at - 1) == 0)
    assert sorted(seqs) == list(range(len(seqs)))


def test_packing_matches_tokenizer(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_packing(docs, QUERIES["op5_packing"](spark, sf).collect(), 1024)


def test_packing_odd_rows(odd, odd_rows):
    check_packing(odd_rows, packing.pack(odd, packing.default_tokenizer(), 64, ranges=5).collect(), 64)
    assert packing.pack(odd.limit(0), packing.default_tokenizer()).count() == 0


def test_words_encode_like_whole_texts():
    enc = packing.encoder(packing.default_tokenizer())
    for t in ("a b.\nc, d\ne", "Ciónrr ñco\nx", "it's 5kg  of", " lead", "trail ", "tab\there", "x y z", "a <|endoftext|> b", "\n", "a\n\nb", "1 2 3", " a b"):
        assert np.frombuffer(enc.ids(pa.array([t]))[0], "<u2").tolist() == brute_ids(t)[:-1]


def test_hilbert_neighbours_touch():
    old = packing.DEPTH
    packing.DEPTH = 2
    try:
        grid = np.stack(np.meshgrid(*[np.arange(4)] * packing.DIMS, indexing="ij"), -1).reshape(-1, packing.DIMS)
        order = grid[np.argsort(packing.hilbert(grid))]
        assert sorted(packing.hilbert(grid).tolist()) == list(range(4 ** packing.DIMS))
        assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
    finally:
        packing.DEPTH = old


# top-k

def test_topk_small_blocks_and_ties(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-6, 7, (700, 5))
    v[100:400] = v[0]  # one common vector
    rows = [(i, [float(x) / 1024 for x in v[i]]) for i in range(700)]
    odd = [(None, [0.1] * 5), (900, None), (1000, [float("nan")] * 5), (1100, [None, 1.0, 1.0, 1.0, 1.0]), (1200, [1.0, float("inf"), 0.0, 0.0, 0.0]),
           (300, rows[300][1]), (1300, [0.5, 0.5]), (1400, []), (1301, [0.25, 0.0])]
    df = topk.integer_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(df, df.filter("id % 100 = 0"), 10, 128, 3).collect()}
    for q in range(0, 700, 100):
        s = v @ v[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:10]
        assert [got[q, n + 1] for n in range(10)] == [(i, s[i]) for i in best]
    assert got[1300, 1] == (1301, 512 * 256) and (1300, 2) not in got and (1400, 1) not in got
    assert not any(q in (900, 1000, 1100, 1200) for q, _ in got)
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_topk_stops_before_the_end():
    rng = np.random.default_rng(4)
    v = (rng.standard_normal((6000, 16)) * 300).astype(np.int64)
    ix = topk.Index(v)
    able = ix.possible(v[0], 10, 0, 320)
    s = v @ v[0]
    assert len(able) < 6000 and set(np.argsort(-s)[1:11]) <= set(able.tolist())


# LM scores

def test_lm_base_is_exact_and_model_predicts(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    tokens = {d: [*(t or "").encode().lower().split(), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = QUERIES["op9_lm_score"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(ws) and r["train_tokens"] == n
        assert r["n_known"] == sum(c[w] > 0 for w in ws)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def test_rare_words_are_joined(spark, make):
    docs = make((1, "a b c a"), (2, "d e a"), (3, None), (None, "A zz"), (2, "d e a"))
    kw = dict(key="doc_id", text="text")
    few, all_ = (sorted(map(str, lm.score(docs, F.lit(True), common=n, **kw).collect())) for n in (1, 100))
    assert few == all_


def test_filter_never_reads_less():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 5000).astype(np.uint64)
    count = rng.integers(1, 3000, 5000)
    level = np.searchsorted(lm.EDGES, count, "right")
    read = lm.LogFrequencyFilter(h, count, 10).levels(h)
    assert (read >= level).all() and (read == level).mean() > 0.95
    other = rng.integers(2**63, 2**64, 5000, dtype=np.uint64)
    assert (lm.LogFrequencyFilter(h, count, 10).levels(other) > 0).mean() < 0.05
    assert not lm.LogFrequencyFilter(h[:0], count[:0], 10).levels(h).any()


def plain_scores(docs, learns, mu):
    """Scores by dictionaries: counts of words and pairs, read by level."""
    def spelt(t):
        return [lm.START, *(t or "").encode().lower().split(), lm.END]

    words, pairs = Counter(), Counter()
    for (_, t), yes in zip(docs, learns):
        if yes:
            words.update(spelt(t))
            pairs.update(zip(spelt(t), spelt(t)[1:]))
    n, v = sum(c for w, c in words.items() if w != lm.START), len(words) - (lm.START in words)

    def read(c):
        return float(lm.VALUES[np.searchsorted(lm.EDGES, c, "right")])

    def p(h, w):
        p1 = (read(words[w]) + 1) / (n + v + 1)
        return min(1.0, (min(read(pairs[h, w]), read(words[w]), read(words[h])) + mu * p1) / (read(words[h]) + mu))

    return [sum(math.log10(p(h, w)) for h, w in zip(spelt(t), spelt(t)[1:])) for _, t in docs]


@pytest.mark.parametrize("segment_tokens", [2**21, 3000, 200])
def test_lm_scores_match_plain_counts_however_many_segments(spark, sf, make, segment_tokens):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    docs += [(1000, None), (1001, ""), (1002, "of the " * 3000)] + [(i, "one two") for i in range(1003, 1040)]
    learns = [d % 3 != 1 for d, _ in docs]
    rows = {r["doc_id"]: r["score"] for r in
            lm.score(make(*docs), F.col("doc_id") % 3 != 1, mu=50.0, common=40, segment_tokens=segment_tokens, bits_per_item=200).collect()}
    assert len(rows) == len(docs)
    for (d, _), s in zip(docs, plain_scores(docs, learns, 50.0)):
        assert math.isclose(rows[d], s, rel_tol=1e-9, abs_tol=1e-9)


def test_lm_beats_the_base_score_at_every_segment_size(spark, sf):
    docs, held_out = spark.read.parquet(f"{sf}/documents.parquet"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    for segment_tokens in (2**21, 2000):
        r = (lm.score(docs, ~held_out, segment_tokens=segment_tokens).filter(held_out)
             .agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first())
        assert r["s"] > r["b"]


def test_lm_odd_rows(odd):
    rows = lm.score(odd, F.lit(True)).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    rows = lm.score(odd, F.lit(False)).collect()
    assert {r["train_tokens"] for r in rows} == {0} and {r["n_known"] for r in rows} == {0}
    assert lm.score(odd.limit(0), F.lit(True)).count() == 0


# sharding

def test_sharding_matches_plain_loop(spark, sf):
    import hashlib
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}

    def best(d, n):
        return max(range(n), key=lambda s: (math.log((int(hashlib.md5(f"{d}#{s}".encode()).hexdigest()[:13], 16) + 1) / (2**52 + 1)), -s))

    rows = QUERIES["op10_sharding"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), best(r["doc_id"], 8), best(r["doc_id"], 9))
        assert r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        own = sorted((r["slot"], r["doc_id"]) for r in rows if r["shard"] == s)
        assert [x for x, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)


def test_sharding_weights_and_odd_rows(spark, odd):
    rows = sharding.assign(odd, [1.0, 3.0]).collect()
    assert len(rows) == odd.count() and {r["grown_shard"] for r in rows} == {None}
    for s in (0, 1):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    share = spark.range(20_000).select((sharding.rendezvous(F.col("id"), [1.0, 3.0]) == 1).cast("int").alias("x")).agg(F.avg("x")).first()[0]
    assert abs(share - 0.75) < 0.02
    assert sharding.assign(odd.limit(0), [1.0]).count() == 0


# pipeline

def test_pipeline_stages(spark):
    from gatewatch.llm.common import saved, table
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, sf))
        if name != "packing":
            assert docs.columns == columns and docs.dtypes == before.dtypes
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
            sizes.append(docs.count())
        if name == "ngram_jaccard":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            want = {c for d, (n, c) in brute_components(rows, 5, 80, 100).items()}
            assert {r["doc_id"] for r in docs.collect()} == want
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] >= sizes[4] > 0.7 * sizes[0]
    assert docs.agg(F.sum("length")).first()[0] > 0
