"""Licence scan, line dedup, decontamination, toxicity, quality: odd rows, planted cases, check SQL."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewatch.llm import ORACLES, QUERIES, decontaminate, license_texts, licenses, line_dedup, quality, toxicity

TABLES = "documents benchmark labels embeddings"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_check_sql(name, spark, sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    cols = sorted(want.columns)
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == cols
    rows = sorted(str(tuple(r[c] for c in cols)) for r in got.collect())
    assert rows == sorted(str(r) for r in want.select(*cols).fetchall())


# licence scan

def test_license_spelling_case_and_punctuation(spark, make):
    mit = dict((n, t) for n, t in license_texts.KNOWN if n == "MIT" and len(t) > 500)["MIT"]
    docs = make((1, "Copyright (c) 1999 Someone\n\n" + mit.upper().replace(",", " ;")), (2, mit + " and more"),
                (3, "text\n  RELEASED under the MIT licence\nmore"), (4, None), (5, ""), (None, "Licensed under CC BY 4.0"), (3, "no notice"))
    got = {(r[0], r[1], tuple(r[2]), r[3]) for r in licenses.scan(docs, licenses.known_digests(spark, license_texts.KNOWN), 23).collect()}
    assert got == {(1, "MIT", (), 0), (2, None, (), 0), (3, None, ("MIT",), 1), (4, None, (), 0), (5, None, (), 0),
                   (None, "CC-BY-4.0", ("CC-BY-4.0",), 1)}


def test_license_odd_rows(spark, odd):
    got = licenses.scan(odd, licenses.known_digests(spark, license_texts.KNOWN), 23)
    assert got.count() == odd.count() and got.filter("text_license is not null or n_license_lines > 0").count() == 0
    assert licenses.scan(odd.limit(0), licenses.known_digests(spark, license_texts.KNOWN), 23).count() == 0


# line dedup

def plain_dedup(docs, long_words=50, least_words=20):
    """The same rule line by line in Python: a line goes if it lies in a chunk that occurred before."""
    seen, out = set(), {}
    words = lambda x: x.count(" ") + 1
    for d, t in sorted((x for x in docs if x[1]), key=lambda x: x[0]):
        lines = t.split("\n")
        gone = set()
        for i, x in enumerate(lines):
            for n in ([1] if words(x) >= long_words else []) + ([2] if i + 1 < len(lines) else []):
                body = "\n".join(lines[i:i + n])
                if body.strip():
                    gone |= set(range(i, i + n)) if (n, body) in seen else set()
                    seen.add((n, body))
        kept, at = [], 0
        while at < len(lines):
            end = at
            while end in gone:
                end += 1
            if end > at and words(" ".join(lines[at:end])) < least_words:
                kept += lines[at:end]
            at = max(end, at)
            if at < len(lines):
                kept.append(lines[at])
            at += 1
        out[d] = "\n".join(kept)
    return out


def test_line_dedup_removes_planted_passages(make):
    """Passages of 2 to 8 lines, each in two documents among other lines."""
    rng = np.random.default_rng(8)
    line = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    docs, planted = [], {}
    for n in range(1, 9):
        for c in range(20):
            passage = [line(max(12, -(-60 // n))) for _ in range(n)]
            for copy in range(2):
                d = len(docs)
                a, b = ([line(9) for _ in range(rng.integers(0, 4))] for _ in range(2))
                docs.append((d, "\n".join(a + passage + b)))
                if copy:
                    planted[d] = (passage, "\n".join(a + b))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(make(*docs)).collect()}
    assert sum(got[d] == rest for d, (_, rest) in planted.items()) >= 0.95 * len(planted)
    assert all(got[d] == t for d, t in docs if d not in planted)
    fewer = {r["doc_id"]: r["text"] for r in line_dedup.dedup(make(*docs), every=3).collect()}
    assert all(fewer[d] == t for d, t in docs if d not in planted) and any(fewer[d] != t for d, t in docs)


def test_line_dedup_of_very_long_texts(make):
    import time
    text = "\n".join(f"line number {i} of a long text" for i in range(100_000))
    began = time.perf_counter()
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in line_dedup.dedup(make((1, text), (2, "new\n" + text + "\nend"))).collect()}
    assert got == {1: (text, 0), 2: ("new\nend", 100_000)} and time.perf_counter() - began < 40


def test_line_dedup_with_its_own_column_names(spark):
    names = ["doc_id", "text", "marks", "removed_chunks", "lines", "p", "d", "new", "gone", "h", "start", "found", "runs", "k", "th", "r"]
    x = "\n".join("some words that are in a line %d of it" % i for i in range(9))
    df = spark.createDataFrame([(1, x, *"abcdefghijklmn"), (2, x, *"abcdefghijklmn")], names)
    out = line_dedup.dedup(df)
    assert out.columns == [*(c for c in names if c != "removed_chunks"), "removed_chunks", "removed_lines"]
    assert {(r["doc_id"], r["text"], r["marks"], r["removed_chunks"], r["removed_lines"]) for r in out.collect()} == {
        (1, x, "a", 0, 0), (2, "", "a", 1, 9)}


def test_line_dedup_matches_plain_loop(make):
    rng = np.random.default_rng(3)
    pool = [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(400)]
    shared = [pool[i:i + 12] for i in (0, 40)]
    docs = []
    for d in range(60):
        own = [f"{d} {x}" for x in rng.choice(pool, rng.integers(1, 15))]
        at = rng.integers(0, len(own))
        docs.append((d, "\n".join(own[:at] + (shared[d % 2] if d % 3 else []) + own[at:])))
    docs.append((60, "long " * 60))
    docs.append((61, "x\n" + "long " * 60 + "\ny"))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(make(*docs)).collect()}
    assert got == plain_dedup(docs)
    assert got[61] == "x\ny" and any(len(t) < len(dict(docs)[d]) for d, t in got.items())


def test_line_dedup_odd_rows(odd):
    out = line_dedup.dedup(odd)
    assert out.columns == [*odd.columns, "removed_chunks", "removed_lines"]
    rows = out.collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["text"] is None and by[2]["text"] == "" and by[4]["text"] == "one two three"
    assert by[6]["text"] != "" and by[7]["removed_chunks"] > 0
    assert line_dedup.dedup(odd.limit(0)).count() == 0


# decontamination

ITEMS = [(0, "A train leaves Boston at 60 miles per hour and arrives after 3 hours while Alice waits at the old station"),
         (1, "quite other words about rivers and the very long road that leads to the sea behind our house"), (2, None), (3, "")]


def bad_ids(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {(r["k"], r["item"]) for r in decontaminate.contaminated(docs, bench).collect()}


def test_decontamination_finds_copies_and_other_parameters(spark, make):
    filler = "nothing to see here but plain unrelated filler words that go on and on "
    docs = make((1, filler + ITEMS[0][1] + ". " + filler), (2, filler + ITEMS[0][1].replace("60", "85").replace("3 hours", "7 minutes").replace("Alice", "Bob")),
                (3, filler * 20), (4, ITEMS[1][1].upper().replace(" ", ",  ")), (5, ITEMS[1][1][:30] + filler), (None, ITEMS[1][1]))
    assert bad_ids(spark, docs) == {(1, 0), (2, 0), (4, 1), (None, 1)}


def test_variants_of_one_item_in_one_document(spark):
    def variant(*v):
        t = ITEMS[0][1]
        for a, b in zip(("Boston", "60", "3 hours", "Alice"), v):
            t = t.replace(a, b)
        return t

    two = [variant("Austin", "85", "7 hours", "Bob"), variant("Zurich", "40", "2 hours", "Carl")]
    five = [*two, *(variant(c, str(i + 70), f"{i + 11} hours", d) for i, (c, d) in enumerate((("Oslo", "Dora"), ("Rome", "Ed"), ("Kyiv", "Flo"))))]
    longer = [variant("Santa Clara", "85", "7 hours", "Bob"), variant("New York", "40", "2 hours", "Carl")]
    docs = [(1, two[0]), (2, two[1]), (3, ". ".join(two)), (4, ". ".join(five)), (5, ". some plain words stand here. ".join(five)), (6, ". ".join(longer))]
    assert bad_ids(spark, spark.createDataFrame(docs, "doc_id long, text string")) == {(d, 0) for d, _ in docs}


def test_short_items_and_items_of_slots(spark):
    bench = spark.createDataFrame([(0, "What is 12 + 15?"), (1, "What is the capital of France?"), (2, "7 9 11 13 17 19 23 29 31 37"), (3, "--"), (4, "")],
                                  "item_id long, text string")
    long = "Some text that goes on for a while stands here. "
    docs = [(1, long + "What is 12 + 15? " + long), (2, long + "What is 12 + 16? " + long), (3, long + "Q: What is the capital of Spain? " + long),
            (4, long + "7 9 11 13 17 19 23 29 31 37. " + long), (5, long + "8 9 11 14 17 20 23 29 30 37. " + long), (6, long), (7, "what is 12 15"), (8, None)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r["k"], r["item"]) for r in got} == {(1, 0), (3, 1), (4, 2), (7, 0)}


def test_items_of_few_words_need_a_whole_line(spark):
    bench = spark.createDataFrame([(0, "the"), (1, "What is it?"), (2, "12 + 15")], "item_id long, text string")
    docs = [(1, "the end of the text. What is it? I said 12 + 15 there."), (2, "A line\nthe\nmore"), (3, "Q\n  what is it\n"), (4, "so\n12 + 15"), (5, None), (6, "")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r["k"], r["item"]) for r in got} == {(2, 0), (3, 1), (4, 2)}


def test_slots_must_be_consistent(spark):
    item = "first 10 then some plain words here again 10 and then more plain words come with 10 at the very end"
    same, mixed_ = item.replace("10", "44"), item.replace("10", "1", 1).replace("again 10", "again 2").replace("with 10", "with 3")
    docs = spark.createDataFrame([(1, same), (2, mixed_)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    got = {r["k"]: r["covered"] for r in decontaminate.contaminated(docs, bench, coverage=0.01).collect()}
    assert got[1] > got.get(2, 0)


def test_decontamination_odd_rows(spark, odd):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.clean(odd, bench)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert decontaminate.clean(odd.limit(0), bench).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == odd.count()


# toxicity

def toy_labels(spark, n=300):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for d in range(n):
        t = list(rng.choice(words, 40))
        bad = d % 6 == 0
        for _ in range(1 + d % 4 if bad else 0):
            t.insert(int(rng.integers(0, 40)), ["vile", "nasty"][int(rng.integers(0, 2))])
        docs.append((d, " ".join(t)))
        labels.append((d, int(d % 5 > 0), int(bad)))
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_words_and_grades(spark, make):
    docs, labels = toy_labels(spark)
    model = toxicity.fit(make(*docs), labels)
    assert (np.diff(model.thresholds) > 0).all() and model.weights[b"vile"] > 0
    s = {r["doc_id"]: r["toxicity"] for r in toxicity.score(make((1, "vile w1"), (2, "vile nasty vile nasty w1"), (3, "w1 w2 " * 500), (4, None), (5, "")), model).collect()}
    assert s[2]["severity"] > s[1]["severity"] > s[3]["severity"] and s[4] == s[5]
    kept = toxicity.reject(make((1, "VILE, nasty!"), (2, "w1 w2"), (3, None), (None, "w3")), model)
    assert sorted((r["doc_id"] or 0, r["toxicity"]) for r in kept.collect()) == [(0, "u"), (2, "u"), (3, "u")] or kept.count() == 3


def test_toxicity_odd_rows(spark, odd, make):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.reject(odd, model).count() == odd.count()
    assert toxicity.reject(odd, model).columns == odd.columns


def test_toxicity_sample_is_bounded_in_rows(spark, make):
    docs, labels = toy_labels(spark, 60)
    more = [docs[6]] * 200 + [(7, f"w{i} other") for i in range(100)]
    sample = toxicity.labelled_sample(make(*docs, *more), labels, "toxic", 1000, "doc_id", "text").collect()
    assert len(sample) == len(set(sample)) == len({*docs, *more})
    assert toxicity.labelled_sample(make(*docs, *more), labels, "toxic", 80, "doc_id", "text").count() == 80


def test_toxicity_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("toxic", "label"), "doc_id")
    n = {(r["label"], r["toxic"]): r["n"] for r in got.groupBy("label", "toxic").agg(F.count("*").alias("n")).collect()}
    assert n.get((0, True), 0) == 0 and n[1, True] >= 0.8 * (n[1, True] + n.get((1, False), 0))


# quality

def test_quality_tables_add_up():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_additive(x, y, n_pairs=2)
    assert (0, 1) in model.pairs
    test = rng.random((500, 4))
    assert ((model.score(test) > 0.5) == ((test[:, 0] > 0.5) ^ (test[:, 1] > 0.5))).mean() > 0.95
    b = model.bins(test)
    z = model.intercept + sum(t[b[:, j]] for j, t in enumerate(model.tables)) + sum(t[b[:, i], b[:, j]] for (i, j), t in model.pairs.items())
    assert np.allclose(model.score(test), 1 / (1 + np.exp(-z)))


def test_quality_odd_rows(spark, odd):
    rows = odd.select(F.col("doc_id").alias("k"), quality.text_features("text").alias("x"))
    model = quality.fit(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(True))
    got = quality.score(rows, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_one_busy_key_does_not_fill_the_quality_sample(spark):
    """A labelled key with very many rows, equal and different ones, leaves room for the others."""
    same = [(1, [1.0] * len(quality.FEATURES))] * 3000
    other = [(1, [float(i)] * len(quality.FEATURES)) for i in range(300)] + [(d, [d % 2 * 10.0] * len(quality.FEATURES)) for d in range(2, 302)]
    rows = spark.createDataFrame(same + other, "k long, x array<double>")
    labels = spark.createDataFrame([(d, d % 2) for d in range(1, 302)], "doc_id long, quality int")
    model = quality.fit(rows, labels, F.lit(True), sample_rows=400)
    assert model.score(np.full((1, len(quality.FEATURES)), 10.0))[0] > 0.5 > model.score(np.zeros((1, len(quality.FEATURES))))[0]
