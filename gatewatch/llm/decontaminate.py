"""Benchmark decontamination by template windows.

Text becomes a template: numbers, names (capitalised words inside a sentence) and units (after a number) turn
into typed slots, everything else into lower-cased words without punctuation.  Windows of ``width`` template
tokens with at least ``plain`` words are hashed and joined between documents and benchmark items.  A matched
window counts only if its slot values agree with one mapping from benchmark values to document values, so a
question with other numbers still matches while an accidental template does not.  Each occurrence of an item in a
document has a mapping of its own: matched windows are grouped by the distance of their places in document and
item, exactly, in ranges of half an item (for inserted tokens) and over the whole document, and the best group
counts.  A document is contaminated by an item when the windows that count make up ``coverage`` of the item's windows.

A bitmap of fixed size, whatever the size of the benchmark, tells documents which windows may match; the join
decides.  A fuller bitmap lets more rows into the join and loses none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, mixed, query, saved, table

#: Words that are units when they follow a number.
UNITS = set("""mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons
lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour
hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees meter
meters metre metres kilometer kilometers kilometre kilometres mph kmh watt watts volt volts""".split())
NUMBER = re.compile(r"[-+$€£]?\d+(?:[.,:/]\d+)*(?:%|[a-z]{1,3})?")
WORD, NUM, CAP, UNIT, NONE, END = 0, 1, 2, 3, 4, 8  # kinds in the low bits of a token's code; END: closes a sentence
SLOT = {NUM: "#", CAP: "@", UNIT: "~"}
BITS = 23


class Codes(dict):
    """White-space word -> 60 bits of hash, END bit, kind; forgets all when it holds ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        bare = word.strip(".,;:!?\"'()[]{}|*#&…").lower()
        plain = "".join(c for c in bare if c.isalnum())
        kind = (NUM if NUMBER.fullmatch(bare) else NONE if not plain else UNIT if plain in UNITS
                else CAP if word.lstrip("\"'([{*")[:1].isupper() and not word.isupper() else WORD)
        c = self[word] = (xxhash.xxh64_intdigest(plain) & ~15) | kind | (END if word.rstrip("\"')]}*%&$#")[-1:] in ".!?" and word else 0)
        return c


CODES = Codes()


class Tokens:
    """A text's tokens: places in ``words``, slot kinds, codes with slots (``code``) and of the words themselves (``raw``)."""

    def __init__(self, text: str | None):
        self.words = words = (text or "").split()
        codes = np.fromiter(map(CODES.__getitem__, words), np.uint64, len(words))
        kind = (codes & np.uint64(7)).astype(np.int8)
        opens = np.ones(len(words), bool)
        opens[1:] = (codes[:-1] & np.uint64(END)) > 0
        self.at = at = np.flatnonzero(kind != NONE)
        kind, self.raw, opens = kind[at], codes[at] & ~np.uint64(15), opens[at]
        self.number = kind == NUM
        after_number = np.zeros(len(at), bool)
        after_number[1:] = kind[:-1] == NUM
        self.slot = np.where((kind == NUM) | ((kind == CAP) & ~opens) | ((kind == UNIT) & after_number), kind, WORD)
        self.code = np.where(self.slot == WORD, self.raw, self.slot.astype(np.uint64))

    def windows(self, width: int, plain: int, form: str) -> np.ndarray:
        """Hashes of all windows of ``width`` tokens; 0 where fewer than ``plain`` tokens are words.

        ``long``: the template.  ``short``: the template of a whole item, whose first token is a slot only as a
        number, whatever stands before it.  ``exact``: the tokens themselves, however many are words.
        """
        n = max(len(self.at) - width + 1, 0)
        h, words_in, is_word = np.zeros(n, np.uint64), np.zeros(n, np.int64), self.slot == WORD
        for j in range(width):
            code, word = (self.raw, None) if form == "exact" else (self.code, is_word)
            if form == "short" and j == 0:
                code, word = np.where(self.number, self.code, self.raw), ~self.number
            h += mixed(code[j:j + n] + np.uint64((0x9E3779B97F4A7C15 * (j + 1) + (form == "exact") * 0x632BE59BD9B4E019) % 2**64))
            words_in += width if word is None else word[j:j + n]
        h[words_in < min(plain, width)] = 0
        return h

    def slots(self, p: int, width: int, form: str) -> list[str]:
        """Kinds and values of the slots (``exact``: numbers) in the window at ``p``."""
        where = self.number if form == "exact" else self.slot
        return [SLOT[NUM if form == "exact" else int(self.slot[q])] + self.words[self.at[q]].strip(".,;:!?\"'()[]{}|*").lower()
                for q in range(p, p + width) if where[q] and (q > p or form != "short" or self.number[q])]


def item_form(t: Tokens, width: int, plain: int) -> tuple[int, str]:
    """Width and form of an item's windows: ``short`` where the item is shorter than ``width``, ``exact`` where no
    window holds enough words."""
    w, form = min(width, len(t.at)), "long" if len(t.at) >= width else "short"
    return w, form if t.windows(w, plain, form).any() else "exact"


def found(width: int, plain: int, forms: list[tuple[int, str]] | None = None, bitmap=None):
    """A ``mapInArrow`` function: rows ``(key columns, h, place, slots, w, form)`` for windows that ``bitmap`` lets
    through, of the given widths and forms, or of each item's own.  Windows appear at every place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value if bitmap is not None else None
        for b in batches:
            rows, hs, places, slots, ws, fs = [], [], [], [], [], []
            for r, text in enumerate(b.column("t").to_pylist()):
                t = Tokens(text)
                own = [(t, *item_form(t, width, plain))] if forms is None else [(t, w, form) for w, form in forms if w >= plain]
                if forms is not None and len(own) < len(forms):
                    # items of fewer tokens count where they are a whole line
                    lines = [Tokens(x) for x in (text or "").split("\n")]
                    own += [(x, w, form) for w, form in forms if w < plain for x in lines if len(x.at) == w]
                for t, w, form in own:
                    h = t.windows(w, plain, form)
                    ok = h != 0
                    if bits is not None and len(h):
                        i = h >> np.uint64(64 - BITS)
                        ok &= ((bits[i >> np.uint64(6)] >> (i & np.uint64(63))) & np.uint64(1)).astype(bool)
                    for p in np.flatnonzero(ok).tolist() if w else []:
                        rows.append(r), hs.append(h[p]), places.append(p), slots.append(t.slots(p, w, form)), ws.append(w), fs.append(form)
            keys = [b.column(i).take(pa.array(rows, pa.int64())) for i in range(b.num_columns) if b.schema.names[i] != "t"]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.array(hs, np.uint64).view(np.int64), pa.int64()), pa.array(places, pa.int32()),
                                              pa.array(slots, pa.list_(pa.string())), pa.array(ws, pa.int32()), pa.array(fs, pa.string())],
                                             [*(n for n in b.schema.names if n != "t"), "h", "place", "slots", "w", "form"])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, plain: int = 4, coverage: float = 0.5,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(k, th, item, covered, windows)`` per document (key and text hash) and item that contaminates it.

    Null and empty texts have no windows; benchmark rows without text match nothing.  Rows equal in key and text
    are one document.  Items with equal ids are one item.  An item shorter than ``width`` is one window of its own
    length; an item without a window of enough words is compared by its exact tokens, without other parameters.  An
    item of fewer than ``plain`` tokens (``What is it?``) is found only where it makes up a whole line.
    """
    kind = dict(benchmark.dtypes)["item_id"], dict(docs.dtypes)[key]
    items = saved(benchmark.select(F.col("item_id").alias("item"), F.col("text").alias("t"))
                  .mapInArrow(found(width, plain), f"item {kind[0]}, h long, place int, slots array<string>, w int, form string"))
    forms = sorted((r["w"], r["form"]) for r in items.select("w", "form").distinct().collect())  # at most 2 x width
    i = F.shiftrightunsigned("h", 64 - BITS)
    cells = (items.select(F.shiftright(i, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).collect())  # at most 2^17 rows
    bits = np.zeros(2 ** (BITS - 6), np.uint64)
    for r in cells:
        bits[r["w"]] = r["b"] % 2**64
    bitmap = docs.sparkSession.sparkContext.broadcast(bits)
    seen = (docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
            .mapInArrow(found(width, plain, forms, bitmap), f"k {kind[1]}, th long, h long, place int, slots array<string>, w int, form string"))
    n = items.groupBy("item").agg(F.countDistinct("h").alias("windows"), F.greatest(F.lit(2), F.floor(F.max(F.col("place") + F.col("w")) / 2)).cast("int").alias("near"))
    wanted = (items.groupBy("item", "h", "w", "form", F.col("slots").alias("want")).agg(F.min("place").alias("at")).join(n.select("item", "near"), "item"))
    pairs = saved(seen.distinct().join(wanted, ["h", "w", "form"]).filter(F.size("slots") == F.size("want")))
    hits = ("k", "th", "item", "h")
    same = pairs.filter("slots = want").select(*hits).distinct()
    # groups (kind, number) of windows that may be one occurrence, each with a mapping of its own
    by = F.col("place") - F.col("at")
    group = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), number.cast("long").alias("no")) for kind, number in enumerate(
        (F.lit(0), by, F.floor(by / F.col("near")), F.floor((by + F.floor(F.col("near") / 2)) / F.col("near")))))))
    other = pairs.filter((F.size("want") > 0) & (F.col("form") != "exact")).withColumn("g", group).select(*hits, "g", "want", "slots").distinct()
    # each benchmark value takes the document value it meets most often
    votes = (other.withColumn("z", F.explode(F.arrays_zip("want", "slots"))).groupBy("k", "th", "item", "g", "z.want", "z.slots").agg(F.count("*").alias("n")))
    best = votes.groupBy("k", "th", "item", "g", "want").agg(F.max(F.struct("n", F.col("slots").alias("v"))).alias("m"))
    maps = best.groupBy("k", "th", "item", "g").agg(F.map_from_entries(F.collect_list(F.struct("want", F.col("m.v").alias("v")))).alias("m"))
    one = [F.col(f"p.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("k", "th", "item", "g")]
    fits = (other.filter("slots <> want").alias("p").join(maps.alias("m"), one)
            .filter(F.forall(F.arrays_zip("want", "slots"), lambda z: F.element_at("m.m", z["want"]) == z["slots"]))
            .select("p.k", "p.th", "p.item", "p.g", "p.h").distinct())
    moved = fits.alias("f").join(same.alias("s"), [F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in hits], "left_anti")
    most = (moved.groupBy("k", "th", "item", "g").agg(F.count("*").alias("c")).groupBy("k", "th", "item").agg(F.max("c").alias("c")))
    covered = (same.groupBy("k", "th", "item").agg(F.count("*").alias("c")).unionByName(most)
               .groupBy("k", "th", "item").agg(F.sum("c").alias("covered")))
    return covered.join(n, "item").filter(F.col("covered") >= coverage * F.col("windows")).select("k", "th", "item", "covered", "windows")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Rows of ``docs`` that no item contaminates, in the columns of ``docs``."""
    bad = saved(contaminated(docs, benchmark, key=key, text=text, **how).select("k", "th").distinct())
    k, th = free_name(docs, "k_"), free_name(docs, "th_")
    bad = bad.withColumnsRenamed({"k": k, "th": th})
    return docs.join(bad, F.col(key).eqNullSafe(F.col(k)) & F.xxhash64(text).eqNullSafe(F.col(th)), "left_anti")


@query("op3_decontaminate")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bad = contaminated(docs, table(spark, sf_dir, "benchmark"))
    by_doc = bad.groupBy("k", "th").agg(F.count("*").alias("n_items"), F.max(F.struct((F.col("covered") / F.col("windows")).alias("share"),
                                                                                      (-F.col("item")).alias("neg"))).alias("best"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("rh"))
    return (rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("rh") == F.col("th")), "left")
            .select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    (-F.col("best.neg")).alias("item_id"), F.col("best.share").alias("coverage")))
