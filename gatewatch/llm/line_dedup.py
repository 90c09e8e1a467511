"""Line dedup: content-defined chunks of lines; passages seen before, anywhere, are removed.

A boundary lies at each line where the rolling hash over the hashes of that line and the next is 0 modulo ``every``.  A
chunk reaches from one boundary up to and with the line of the next, so chunks overlap by a line and depend on the lines
they hold: an insertion shifts none.  ``every=1``, the default, makes each two neighbouring lines a chunk, as a passage of
two lines has room for one boundary only; larger values make fewer, longer chunks that miss short passages.  A line of
``long_words`` words or more is a chunk of its own, too.  Of equal chunks the first stays, in order of (document key, text
hash, line).

Light rows (hashes and places) find repeated chunks.  Repeated chunks of a document whose first copies also follow each
other make one run, extended line by line as far as it goes.  The texts of runs and of their first copies
alone are fetched and compared byte by byte.  Equal runs that touch make a passage, and a passage of at least
``least_words`` words is removed.  Every line that is removed has an equal one left at its first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, saved, table

BASE, PRIME = 1_000_003, 2_147_483_647


def line_hash(line: Column) -> Column:
    """28 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _part(lines: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, n), "\n")


def chunks(docs: DataFrame, every: int, long_words: int) -> DataFrame:
    """``(k, t)`` -> ``(k, th, start, n, h)`` of every chunk that is not blank: its first line, lines and 128-bit hash."""
    lines = docs.filter(F.length("t") > 0).select("k", F.xxhash64("t").alias("th"), F.split("t", "\n").alias("lines"))
    size = F.size("lines")
    if every == 1:
        pairs = F.transform(F.slice("lines", F.lit(1), size - 1), lambda x, i: F.struct(i.alias("start"), F.lit(2).alias("n")))
    else:
        lines = lines.withColumn("m", F.transform("lines", line_hash))
        lines = lines.withColumn("b", F.filter(F.sequence(F.lit(0), size - 1), lambda i: (
            (F.get("m", i) + F.lit(BASE) * F.get("m", i + 1)) % PRIME % every == 0)))
        pairs = F.filter(F.transform("b", lambda s, j: F.struct(s.alias("start"), (F.coalesce(F.get("b", j + 1), size - 1) - s + 1).alias("n"))),
                         lambda p: p["n"] >= 2)
    long = F.filter(F.transform("lines", lambda x, i: F.when(_words(x) >= long_words, F.struct(i.alias("start"), F.lit(1).alias("n")))),
                    lambda p: p.isNotNull())
    out = lines.select("k", "th", "lines", F.explode(F.concat(pairs, long)).alias("p"))
    out = out.select("k", "th", "p.start", "p.n", _part(F.col("lines"), F.col("p.start"), F.col("p.n")).alias("x"))
    return out.filter(F.trim(F.translate("x", "\n", " ")) != "").select("k", "th", "start", "n", F.unhex(F.md5("x")).alias("h"))


def _runs(found: Column) -> Column:
    """Sorted ``(start, n, first)`` -> ``(start, n, first)`` of the runs that go on in step with their first copies."""
    at = lambda j: F.get(found, j)
    goes_on = lambda j: (
        (at(j)["start"] <= at(j - 1)["start"] + at(j - 1)["n"]) & at(j)["first"]["k"].eqNullSafe(at(j - 1)["first"]["k"])
        & (at(j)["first"]["th"] == at(j - 1)["first"]["th"])
        & (at(j)["first"]["start"] - at(j - 1)["first"]["start"] == at(j)["start"] - at(j - 1)["start"]))
    begins = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda j: (j == 0) | ~goes_on(j))
    return F.transform(F.array(begins), lambda b: F.transform(b, lambda j, i: F.struct(
        at(j)["start"].alias("start"),
        (at(F.coalesce(F.get(b, i + 1), F.size(found)) - 1)["start"] + at(F.coalesce(F.get(b, i + 1), F.size(found)) - 1)["n"]
         - at(j)["start"]).alias("n"), at(j)["first"].alias("first"))))[0]


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 1, long_words: int = 50,
          least_words: int = 20) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and columns ``removed_chunks`` (passages) and
    ``removed_lines``, which replace columns of these names.

    Null and empty texts stay as they are.  Rows with the same key and text count as one row and are treated
    alike; a null key sorts first.  A text may become empty; its row stays.
    """
    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = saved(chunks(slim, every, long_words))
    place = F.struct("k", "th", "start")
    groups = found.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    again = found.join(groups.select("h", "first"), "h").filter(place != F.col("first"))
    listed = F.array_sort(F.collect_set(F.struct("start", "n", "first")))
    runs = saved(again.groupBy("k", "th").agg(listed.alias("found")).select("k", "th", _runs(F.col("found")).alias("runs")))

    each = runs.select("k", "th", F.explode("runs").alias("r"))
    sources = each.select("r.first.*", "r.n").groupBy("k", "th").agg(F.collect_set(F.struct("start", "n")).alias("sources"))
    wanted = sources.select(F.col("k").alias("sk"), F.col("th").alias("sth"), "sources").join(
        runs, F.col("k").eqNullSafe(F.col("sk")) & (F.col("th") == F.col("sth")), "full")
    wanted = wanted.select(F.when(F.col("th").isNull(), F.col("sk")).otherwise(F.col("k")).alias("wk"),
                           F.coalesce("th", "sth").alias("wth"), "runs", "sources")
    # both sides of this join grow with the input, so neither is ever sent to all executors
    texts = slim.filter("t is not null").withColumn("th", F.xxhash64("t")).join(
        wanted.hint("merge"), F.col("k").eqNullSafe(F.col("wk")) & (F.col("th") == F.col("wth")))
    texts = texts.groupBy("k", "th").agg(*(F.first(c).alias(c) for c in ("t", "runs", "sources"))).withColumn("lines", F.split("t", "\n"))
    none = F.array().cast(dict(runs.dtypes)["runs"])
    pieces = F.concat(
        F.transform(F.coalesce("runs", none), lambda r: F.struct(F.lit(False).alias("is_first"), r["start"].alias("start"), r["n"].alias("n"),
                                                                 r["first"].alias("first"))),
        F.transform(F.coalesce("sources", F.array().cast(dict(sources.dtypes)["sources"])), lambda x: F.struct(
            F.lit(True).alias("is_first"), x["start"].alias("start"), x["n"].alias("n"), F.struct("k", "th", x["start"].alias("start")).alias("first"))))
    texts = saved(texts.select("k", "th", "lines", F.explode(pieces).alias("r")).select(
        "k", "th", "r.*", _part(F.col("lines"), F.col("r.start"), F.col("r.n")).alias("x")))
    first = texts.filter("is_first").select(F.col("k").alias("fk"), F.col("th").alias("fth"), F.col("start").alias("fs"), F.col("n").alias("fn"),
                                            F.col("x").alias("fx"))
    equal = texts.filter("not is_first").join(
        first.hint("merge"), F.col("first.k").eqNullSafe(F.col("fk")) & (F.col("first.th") == F.col("fth"))
        & (F.col("first.start") == F.col("fs")) & (F.col("n") == F.col("fn")) & (F.col("x") == F.col("fx")))
    # runs in order; those that overlap or touch make a passage (a run never ends before the one it begins behind)
    ends = equal.groupBy("k", "th").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("r"))
    ends = ends.withColumn("b", F.filter(F.sequence(F.lit(0), F.size("r") - 1), lambda j: (j == 0) | (
        F.get("r", j)["start"] > F.get("r", j - 1)["end"])))
    passages = F.transform("b", lambda j, i: F.struct(
        F.get("r", j)["start"].alias("start"), F.greatest(
            F.get("r", F.coalesce(F.get("b", i + 1), F.size("r")) - 1)["end"],
            F.coalesce(F.get("r", F.coalesce(F.get("b", i + 1), F.size("r")) - 2)["end"], F.lit(0))).alias("end")))
    drop = saved(ends.select(F.col("k").alias("dk"), F.col("th").alias("dth"), passages.alias("p")))
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("d"), F.col(key).alias("k"), F.xxhash64(text).alias("th"))
    out = rows.join(drop.hint("merge"), F.col("k").eqNullSafe(F.col("dk")) & (F.col("th") == F.col("dth")), "left")
    out = out.withColumn("lines", F.when(F.col("p").isNotNull(), F.split(F.col("d")[text], "\n")))
    long = lambda x: _words(F.array_join(F.slice("lines", x["start"] + 1, x["end"] - x["start"]), " ")) >= least_words
    out = out.withColumn("p", F.filter("p", long))
    # what lies before, between and behind the passages
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("p")), lambda i: F.slice(
        "lines", F.coalesce(F.get("p", i - 1)["end"], F.lit(0)) + 1,
        F.coalesce(F.get("p", i)["start"], F.size("lines")) - F.coalesce(F.get("p", i - 1)["end"], F.lit(0)))))
    hit = F.coalesce(F.size("p"), F.lit(0)) > 0
    out = out.withColumn("new", F.when(hit, F.array_join(kept, "\n")).otherwise(F.col("d")[text])).withColumn(
        "gone", F.when(hit, F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])).otherwise(0))
    names = [c for c in docs.columns if c.lower() not in ("removed_chunks", "removed_lines")]
    return out.select(*(F.col("new").alias(c) if c == text else F.col("d")[c].alias(c) for c in names),
                      F.when(hit, F.size("p")).otherwise(0).cast("long").alias("removed_chunks"), F.col("gone").alias("removed_lines"))


def _sql(long_words: int = 50, least_words: int = 20) -> str:
    return f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE length(text) > 0),
paired AS (SELECT *, length(x) - length(replace(x, ' ', '')) + 1 AS words, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM lines),
chunk AS (SELECT doc_id, i, 2 AS n, x || chr(10) || y AS body FROM paired WHERE y IS NOT NULL AND trim(x || y) <> ''
          UNION ALL SELECT doc_id, i, 1, x FROM paired WHERE words >= {long_words}),
again AS (SELECT * FROM chunk QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1),
line AS (SELECT doc_id, i FROM again UNION SELECT doc_id, i + 1 FROM again WHERE n = 2),
island AS (SELECT l.doc_id, l.i, p.words, l.i - row_number() OVER (PARTITION BY l.doc_id ORDER BY l.i) AS g FROM line l JOIN paired p USING (doc_id, i)),
gone AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, g) AS total FROM island QUALIFY total >= {least_words}),
kept AS (SELECT p.doc_id, string_agg(p.x, chr(10) ORDER BY p.i) FILTER (WHERE g.i IS NULL) AS text, count(DISTINCT g.g) AS removed_chunks, count(g.i) AS removed_lines
         FROM paired p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY 1)
SELECT d.doc_id, CASE WHEN length(d.text) > 0 THEN coalesce(k.text, '') ELSE d.text END AS text,
       coalesce(k.removed_chunks, 0)::BIGINT AS removed_chunks, coalesce(k.removed_lines, 0)::BIGINT AS removed_lines
FROM documents d LEFT JOIN kept k USING (doc_id)"""


@query("op2_line_dedup", _sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_chunks", "removed_lines")
