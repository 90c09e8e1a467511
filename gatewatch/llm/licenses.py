"""Licence scan: canonical text digests, hash-joined to the digests of known licence texts.

Two texts have the same canonical form when they differ only in letter case, punctuation, white space,
copyright lines and equivalent spellings.  A document's whole text is one unit; each of its lines is another
(a one-line notice is a whole text of its own).  The digest join carries no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table
from .license_texts import KNOWN

#: A line that states who holds the copyright; such lines differ between copies of one licence.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|all rights reserved)[^\n]*"
#: Spellings that licence matching guidelines treat as equal.
SPELLINGS = [("licence", "license"), ("licencing", "licensing"), ("sub-license", "sublicense"),
             ("non-commercial", "noncommercial"), ("per cent", "percent"), ("favour", "favor"),
             ("acknowledgement", "acknowledgment"), ("cc by-nc", "cc bync"), ("organisation", "organization"),
             ("https://", "http://"), ("merchantibility", "merchantability")]
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~'\\\t\r\f"
#: More known texts than this are joined by a shuffle, not broadcast.
BROADCAST_ROWS = 100_000


def bound(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once a row, however often ``fn`` names it."""
    return F.transform(F.array(value), fn)[0]


def canonical(text: Column) -> Column:
    """Canonical lines of a text: lower case, no copyright lines, equal spellings, words parted by one space."""
    def without_copyright(t: Column) -> Column:
        has = t.contains("copyright") | t.contains("(c)") | t.contains("all rights reserved")
        return F.when(has, F.regexp_replace(t, COPYRIGHT_LINE, "\n")).otherwise(t)

    t = F.lower(text)
    for spelling, to in SPELLINGS:
        t = F.replace(t, F.lit(spelling), F.lit(to))
    t = F.translate(bound(t, without_copyright), PUNCTUATION, " " * len(PUNCTUATION))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "  +", " "), " ?\n[ \n]*", "\n"))


def _whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"\n+", " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """``(license, digest)`` of known texts; a text given twice keeps its first name in name order."""
    df = spark.createDataFrame(known, "license string, text string")
    return (df.select("license", F.md5(_whole(canonical(F.col("text")))).alias("digest"))
            .groupBy("digest").agg(F.min("license").alias("license")))


def scan(docs: DataFrame, known: DataFrame, n_known: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``text_license`` (the licence that the whole text is, or null),
    ``line_licenses`` (sorted names of those that single lines are), ``n_license_lines``.

    Null and empty texts have no licence.  Rows that share a key share the findings of all of them; a null key
    is a key like any other.  Other columns of ``docs`` are not touched.
    """
    digests = bound(canonical(F.col(text)), lambda t: F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), F.md5(_whole(t)).alias("digest"))),
        F.transform(F.filter(F.split(t, "\n"), lambda x: x != ""),
                    lambda x: F.struct(F.lit(False).alias("whole"), F.md5(x).alias("digest")))))
    units = docs.select(F.col(key).alias("k"), F.explode(digests).alias("u"))
    known = F.broadcast(known) if n_known <= BROADCAST_ROWS else known
    hits = (units.select("k", "u.whole", "u.digest").join(known, "digest").groupBy("k", "whole")
            .agg(F.array_sort(F.collect_set("license")).alias("names"), F.count("*").alias("n")))
    found = hits.groupBy("k").agg(F.max(F.when(F.col("whole"), F.col("names")[0])).alias("text_license"),
                                  F.max(F.when(~F.col("whole"), F.col("names"))).alias("line_licenses"),
                                  F.max(F.when(~F.col("whole"), F.col("n"))).alias("n_license_lines"))
    rows = docs.select(F.col(key).alias("key_"))
    return (rows.join(found, F.col("key_").eqNullSafe(F.col("k")), "left")
            .select(F.col("key_").alias(key), "text_license", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"),
                    F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines")))


def _sql_canonical(c: str) -> str:
    t = f"lower({c})"
    for spelling, to in SPELLINGS:
        t = f"replace({t}, '{spelling}', '{to}')"
    t = f"regexp_replace({t}, '{COPYRIGHT_LINE}', chr(10), 'g')"
    points = [f"chr({ord(x)})" for x in PUNCTUATION]
    t = f"regexp_replace(translate({t}, {' || '.join(points)}, '{' ' * len(points)}'), '  +', ' ', 'g')"
    return f"trim(regexp_replace({t}, ' ?\\n[ \\n]*', chr(10), 'g'))"


def _sql() -> str:
    rows = ", ".join("('" + n.replace("'", "''") + "', '" + t.replace("'", "''") + "')" for n, t in KNOWN)
    whole = "trim(regexp_replace({}, '\\n+', ' ', 'g'))"
    return f"""
WITH known AS (SELECT md5({whole.format(_sql_canonical('t'))}) AS digest, min(n) AS license
               FROM (VALUES {rows}) v(n, t) GROUP BY 1),
body AS (SELECT doc_id, {_sql_canonical('text')} AS t FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM body),
hits AS (SELECT doc_id, true AS whole, license FROM body JOIN known ON md5({whole.format('t')}) = digest
         UNION ALL SELECT doc_id, false, license FROM lines JOIN known ON md5(x) = digest WHERE x <> ''),
found AS (SELECT doc_id, min(license) FILTER (WHERE whole) AS text_license,
                 array_to_string(list_sort(list_distinct(list(license) FILTER (WHERE NOT whole))), ', ') AS line_licenses,
                 count(*) FILTER (WHERE NOT whole) AS n_license_lines FROM hits GROUP BY 1)
SELECT d.doc_id, f.text_license, coalesce(f.line_licenses, '') AS line_licenses,
       coalesce(f.n_license_lines, 0) AS n_license_lines
FROM documents d LEFT JOIN found f ON d.doc_id IS NOT DISTINCT FROM f.doc_id"""


@query("op1_license_scan", _sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"), known_digests(spark, KNOWN), len(KNOWN))
    return out.withColumn("line_licenses", F.array_join("line_licenses", ", "))
