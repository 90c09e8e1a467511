"""Running and rolling totals per key that survive a hot key.

A window partitioned by key alone puts everything a busy address ever sent into one task, and a
sliding frame re-reads its whole frame for every row.  Here a rolling total is a running total of
signed *changes* (``+1`` when a row arrives, ``-1`` when it leaves the window), and a running total
is split in two levels:

1. changes are summed per (key, time slice) with map-side partial aggregation, and a small window
   over those sums gives every slice its opening balance;
2. inside one (key, slice) group the changes are summed in time order.

The groups that are sorted are one key's traffic of one slice, so a key that holds a third of all
rows is spread over as many tasks as it has slices.  The result is exact: sums are over integers
or decimals.

Windows that are no longer than a slice need no opening balance (``windowed_totals``): a row is
simply handed on to the next slice while it is still alive there, which takes one scan and one
shuffle.  All-time totals use the two levels (``rolling_totals``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
DEFAULT_SLICE = 10 * MINUTE
#: Rows (a key, a percentile name and three numbers each) that are sent to all executors at most.
SENT_BRACKETS = 100_000
_FIRST = -(1 << 62)  # sorts before every row of its time


@dataclass
class Rolling:
    """Sum of ``amount`` over rows with ``t - window <= ts <= t``.

    ``window=None`` never expires.  ``strict`` leaves out rows exactly ``window`` old.
    """
    name: str
    amount: Column
    window: int | None
    strict: bool = False
    type: str = "bigint"

    def gone(self, ts: Column) -> Column:
        return ts + (self.window + (0 if self.strict else 1))


@dataclass
class RollingDistinct:
    """Number of distinct ``value`` (where not NULL) within the window; None = ever seen.

    ``only`` maps further names to conditions on the value: distinct values that meet them.
    """
    name: str
    value: Column
    window: int | None
    only: dict[str, Column] = field(default_factory=dict)


def attach_row(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a one-row frame (a global aggregate) on every row.

    One row is the size bound that makes the explicit broadcast safe.
    """
    k = F.lit(1)
    return rows.withColumn("_k", k).join(F.broadcast(one_row.withColumn("_k", k)), "_k").drop("_k")


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """An equi join in which NULL keys equal each other; the keys of ``left`` stay."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def slice_of(ts: Column, size: int) -> Column:
    """Start of the slice a time falls in (integer arithmetic, negative times included)."""
    return ts - F.pmod(ts, F.lit(size))


def split_running_totals(changes: DataFrame, keys: list[str], sums: list[str], slice_us: int,
                         order: list[str] | None = None) -> DataFrame:
    """Running sums of ``sums`` per key by ``_t``.

    ``changes`` has the keys, ``_t`` (µs) and the amounts.  Without ``order`` all rows of one time
    share their total (RANGE frame); with it, rows are taken one by one in that order.
    """
    changes = changes.withColumn("_slice", slice_of(F.col("_t"), slice_us))
    part = [*keys, "_slice"]
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = (changes.groupBy(*part).agg(*[F.sum(s).alias(s) for s in sums])
               .select(*part, *[F.sum(s).over(before).alias(f"_b_{s}") for s in sums]))
    w = Window.partitionBy(*part).orderBy("_t", *(order or []))
    w = (w.rowsBetween if order else w.rangeBetween)(Window.unboundedPreceding, Window.currentRow)
    joined = join_keys(changes, opening, part)
    keep = [c for c in changes.columns if c not in sums]
    return joined.select(*keep, *[
        (F.sum(s).over(w) + F.coalesce(F.col(f"_b_{s}"), F.lit(0))).alias(s) for s in sums])


#: A flooded (key, slice) is cut into this many equal stretches of time, and at most so many groups are taken for flooded.
STRETCHES, FLOODED = 65_536, 10_000
#: Rows that a task sorts where the number of rows is known: many groups, or one.
TASK_ROWS = 50_000


def windowed_totals(rows: DataFrame, keys: list[str], ts: str, specs: list,
                    slice_us: int = 0, hot_rows: int | None = None) -> DataFrame:
    """``rows`` plus one column per spec, for windows of finite length; rows of one time see each other.

    A row is copied to the next slice when it is still inside a window there (without its payload).
    Inside a (key, slice) group a repeated value ends the earlier sighting's turn, so the distinct
    counts are sums of changes like the others, and every sum is one forward pass.

    With ``hot_rows``, groups of more rows are found first (one pass over keys and times) and cut into
    stretches that are summed on their own: sums per stretch give openings, and the first sighting of each value in
    a stretch ends its turn in the one before.  A task then sees one key's rows of ``size / STRETCHES``
    time and, for openings, one row for each stretch.  Should more than ``FLOODED`` groups be as large, the largest are cut.
    The same pass gives the number of rows, and the groups are dealt to one task for every ``TASK_ROWS``, so that what a
    task sorts does not grow with the input.
    """
    width = max(s.window for s in specs)
    size = max(slice_us, width + 1)
    plain = [s for s in specs if isinstance(s, Rolling)]
    distinct = [s for s in specs if isinstance(s, RollingDistinct)]
    types = {s.name: s.type for s in plain} | {
        n: "bigint" for s in distinct for n in (s.name, *s.only)}
    src = rows
    for s in plain:
        src = src.withColumn(f"_a_{s.name}", F.coalesce(s.amount.cast(s.type), F.lit(0).cast(s.type)))
    for s in distinct:
        src = src.withColumn(f"_v_{s.name}", s.value).withColumn(
            f"_a_{s.name}", F.col(f"_v_{s.name}").isNotNull().cast("bigint"))
        for n, cond in s.only.items():
            src = src.withColumn(f"_a_{n}", F.coalesce((cond & F.col(f"_v_{s.name}").isNotNull())
                                                       .cast("bigint"), F.lit(0).cast("bigint")))
    own = slice_of(F.col(ts), size)
    payload = [c for c in rows.columns if c not in keys and c != ts]
    both = F.explode(F.when(F.col(ts) + width >= F.col("_own") + size, F.array(F.col("_own"), F.col("_own") + size))
                     .otherwise(F.array("_own")))
    part = [*keys, "_slice"]
    src = (src.withColumn("_own", own).withColumn("_slice", both)
           .select(*keys, F.col(ts).alias("_t"), "_slice", (F.col("_slice") == F.col("_own")).alias("_home"),
                   F.when(F.col("_slice") == F.col("_own"), F.struct(*payload)).alias("_row"),
                   *[f"_a_{n}" for n in types], *[f"_v_{s.name}" for s in distinct]))
    flooded, tasks = None, []
    if hot_rows is not None:
        counts = rows.withColumn("_own", own).withColumn("_slice", both).groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
        counts = cut_lineage(counts)
        n = counts.agg(F.sum("_n")).first()[0] or 0
        tasks = [max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))]
        found = counts.where(F.col("_n") > hot_rows).orderBy(F.desc("_n")).limit(FLOODED).select(*part)
        if keep := found.collect():
            flooded = F.broadcast(rows.sparkSession.createDataFrame(keep, found.schema)
                                  .withColumnsRenamed({k: f"_r_{k}" for k in part}))

    def summed(src: DataFrame, stretch: str | None) -> DataFrame:
        where = [*part, stretch] if stretch else part
        src = src.repartition(*tasks, *where)
        for s in distinct:
            v = f"_v_{s.name}"
            nxt = F.lead("_t").over(Window.partitionBy(*where, v).orderBy("_t"))
            if stretch:
                # the last sighting of a stretch ends with the first one of the next stretch that has the value
                later = src.groupBy(*where, v).agg(F.min("_t").alias("_m")).withColumn(
                    "_m", F.lead("_m").over(Window.partitionBy(*part, v).orderBy(stretch)))
                src = join_keys(src, later, [*where, v])
                nxt = F.coalesce(nxt, F.col("_m"))
            src = src.withColumn(f"_n_{s.name}", F.least(nxt, F.col("_t") + (s.window + 1)))
            src = src.drop("_m")
        # leaving times: one per window length for the plain sums, one per distinct count
        exits = {}
        for s in plain:
            exits.setdefault((s.window, s.strict), []).append(s.name)
        turns = [(F.col("_t") + (w + (0 if strict else 1)), names) for (w, strict), names in exits.items()]
        turns += [(F.col(f"_n_{s.name}"), [s.name, *s.only]) for s in distinct]
        k = F.col("_k")
        when, keep = F.when(k == 0, F.col("_t")), k == 0
        for i, (t, names) in enumerate(turns, 1):
            when = when.when(k == i, t)
            moved = F.lit(False)
            for n in names:
                moved = moved | (F.col(f"_a_{n}") != 0)
            keep = keep | ((k == i) & moved & (t < F.col("_slice") + size))
        ev = src.withColumn("_k", F.explode(F.array(*[F.lit(i) for i in range(len(turns) + 1)]))).where(keep)
        change = []
        for n, dtype in types.items():
            a = F.col(f"_a_{n}")
            c = F.when(k == 0, a)
            for i, (_, names) in enumerate(turns, 1):
                if n in names:
                    c = c.when(k == i, -a)
            change.append(F.coalesce(c, F.lit(0).cast(dtype)).alias(n))
        ev = ev.select(*part, when.alias("_t"), ((k == 0) & F.col("_home")).alias("_home"),
                       F.when(k == 0, F.col("_row")).alias("_row"), *change)
        if stretch:
            ev = ev.withColumn(stretch, stretch_of(F.col("_t")))
            before = Window.partitionBy(*part).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
            opening = ev.groupBy(*where).agg(*[F.sum(n).alias(n) for n in types]).select(
                *where, *[F.sum(n).over(before).alias(f"_b_{n}") for n in types])
            ev = join_keys(ev, opening, where)
        w = Window.partitionBy(*where).orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        total = [(F.sum(n).over(w) + (F.coalesce(F.col(f"_b_{n}"), F.lit(0)) if stretch else 0)).cast(t).alias(n) for n, t in types.items()]
        ev = ev.select(*keys, F.col("_t").alias(ts), "_home", "_row", *total)
        return ev.where("_home").select(*keys, ts, "_row.*", *types)

    def stretch_of(t: Column) -> Column:
        # a row handed on from the slice before lies in stretch 0
        return F.floor(F.greatest(t - F.col("_slice"), F.lit(0)) / max(1, -(-size // STRETCHES))).cast("bigint")

    if flooded is None:
        return summed(src, None)
    same = F.lit(True)
    for c in part:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    cut = src.join(flooded, same, "left_semi").withColumn("_stretch", stretch_of(F.col("_t")))
    return summed(src.join(flooded, same, "left_anti"), None).unionByName(summed(cut, "_stretch"))


def rolling_totals(rows: DataFrame, keys: list[str], ts: str, specs: list, tie: str,
                   slice_us: int = DEFAULT_SLICE) -> DataFrame:
    """``rows`` plus one column per spec, all-time totals included, rows taken one by one in
    (ts, tie) order.

    The changes are read twice, once for the opening balances (narrow, pre-aggregated) and once for
    the sums: give it a table or a checkpointed frame when the rows are costly to derive.
    """
    plain = [s for s in specs if isinstance(s, Rolling)]
    expiring = [s for s in plain if s.window is not None]
    ever = [s for s in specs if isinstance(s, RollingDistinct)]
    if any(s.window is not None for s in ever):
        raise ValueError("distinct counts of a finite window: use windowed_totals")
    names = [s.name for s in specs]
    src = rows
    for s in plain:
        src = src.withColumn(f"_a_{s.name}", F.coalesce(s.amount.cast(s.type), F.lit(0).cast(s.type)))
    for s in ever:
        src = src.withColumn(f"_v_{s.name}", s.value)

    # arrivals (k = 0) and departures (k = 1..n); departures carry no payload
    k = F.col("_k")
    ev = src.withColumn("_k", F.explode(F.array(*[F.lit(i) for i in range(len(expiring) + 1)])))
    t, keep = F.when(k == 0, F.col(ts)), k == 0
    for i, s in enumerate(expiring, 1):
        t = t.when(k == i, s.gone(F.col(ts)))
        keep = keep | ((k == i) & (F.col(f"_a_{s.name}") != 0))
    amounts = []
    for s in plain:
        a = F.col(f"_a_{s.name}")
        c = F.when(k == 0, a)
        if s in expiring:
            c = c.when(k == expiring.index(s) + 1, -a)
        amounts.append(F.coalesce(c, F.lit(0).cast(s.type)).cast(s.type).alias(s.name))
    payload = [c for c in rows.columns if c not in keys]
    ev = ev.where(keep).select(
        *keys, t.alias("_t"), F.when(k == 0, F.col(tie)).otherwise(F.lit(_FIRST)).cast("bigint").alias("_o"),
        F.when(k == 0, 1).otherwise(0).alias("_home"),
        F.when(k == 0, F.struct(*payload)).alias("_row"), *amounts,
        *[F.lit(0).cast("bigint").alias(s.name) for s in ever])
    if ever:
        # the first sighting of each value, all kinds of value in one pass
        seen = (src.select(*keys, ts, tie, F.explode(F.array(*[F.struct(
                    F.lit(s.name).alias("kind"), F.col(f"_v_{s.name}").cast("string").alias("v"))
                    for s in ever])).alias("_s"))
                .where("_s.v is not null").groupBy(*keys, "_s")
                .agg(F.min(F.struct(F.col(ts).alias("t"), F.col(tie).cast("bigint").alias("o"))).alias("m")))
        ev = ev.unionByName(seen.select(
            *keys, F.col("m.t").alias("_t"), F.col("m.o").alias("_o"), F.lit(0).alias("_home"),
            F.lit(None).cast(ev.schema["_row"].dataType).alias("_row"),
            *[F.lit(0).cast(ev.schema[s.name].dataType).alias(s.name) for s in plain],
            *[F.when(F.col("_s.kind") == s.name, 1).otherwise(0).cast("bigint").alias(s.name) for s in ever]))
    out = split_running_totals(ev, keys, names, slice_us, ["_o", "_home"])
    return out.where("_home = 1").select(*keys, "_row.*", *names)


def previous_time(rows: DataFrame, keys: list[str], ts: str, tie: str, out: str = "prev_ts",
                  slice_us: int = DEFAULT_SLICE) -> DataFrame:
    """Time of the key's preceding row, split like the totals: last time of the earlier slices,
    then ``lag`` inside the slice."""
    rows = rows.withColumn("_slice", slice_of(F.col(ts), slice_us))
    part = [*keys, "_slice"]
    last = rows.groupBy(*part).agg(F.max(ts).alias("_m"))
    before = F.lag("_m").over(Window.partitionBy(*keys).orderBy("_slice"))
    last = last.select(*part, before.alias("_before"))
    w = Window.partitionBy(*part).orderBy(ts, tie)
    return (rows.join(last, part, "left")
            .withColumn(out, F.coalesce(F.lag(ts).over(w), F.col("_before")))
            .drop("_slice", "_before"))


def row_numbers(rows: DataFrame, keys: list[str], ts: str, tie: str, out: str = "rn",
                slice_us: int = DEFAULT_SLICE) -> DataFrame:
    """1-based position per key in (ts, tie) order."""
    rows = rows.withColumn("_slice", slice_of(F.col(ts), slice_us))
    part = [*keys, "_slice"]
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    n = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    n = n.select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy(*part).orderBy(ts, tie)
    return (rows.join(n, part, "left")
            .withColumn(out, F.row_number().over(w) + F.col("_before")).drop("_slice", "_before"))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    accuracy: int = 10_000, most: int = 1_000_000) -> DataFrame:
    """Exact linear-interpolated percentiles per key without holding a key's values in memory.

    A sketch of bounded size brackets every wanted rank.  While a bracket of several values holds over ``most`` rows, another
    sketch of what lies inside narrows it, some ``accuracy / 20`` times a round.  A last pass counts the values below each
    bracket and ranks the distinct values inside, at most ``most`` for a key and percentile.  Brackets (a row per key and
    percentile) are sent to the executors while they are few, else joined.
    """
    # ranks of a sketch are off by at most n / accuracy; two of those on each side are safe.  Keys
    # with fewer than ``accuracy`` values are bracketed whole.
    slack = 2.0 / accuracy
    edges = [e for p in probs.values() for e in (max(p - slack, 0.0), min(p + slack, 1.0))]
    base = rows.where(F.col(value).isNotNull()).select(
        *(keys or [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v"))
    ks = keys or ["_all"]
    sk = base.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), accuracy).alias("_e"))
    per, few = [], F.col("_n") <= min(accuracy, most)
    for i, (name, p) in enumerate(probs.items()):
        lo = F.col("_min") if p - slack <= 0 else F.when(few, F.col("_min")).otherwise(F.col("_e")[2 * i])
        hi = F.col("_max") if p + slack >= 1 else F.when(few, F.col("_max")).otherwise(F.col("_e")[2 * i + 1])
        per.append(F.struct(F.lit(name).alias("_p"), lo.alias("lo"), hi.alias("hi"),
                            (F.lit(p) * (F.col("_n") - 1)).alias("pos")))
    # how many rows a bracket may hold if its values are distinct
    wide = F.when(few, F.col("_n")).otherwise(F.ceil(F.col("_n") * 3 * slack))
    brackets = cut_lineage(sk.select(*ks, wide.cast("bigint").alias("held"), F.explode(F.array(*per)).alias("q")).select(*ks, "held", "q.*"))
    sent = brackets.count() <= SENT_BRACKETS

    def of_values(b: DataFrame) -> DataFrame:
        per_key = b.groupBy(*ks).agg(F.collect_list(F.struct("_p", "lo", "hi", "pos")).alias("_q"))
        j = join_keys(base, F.broadcast(per_key) if sent else per_key, ks, "inner")
        return j.select(*ks, "_v", F.explode("_q").alias("q")).where("_v <= q.hi")

    inside = F.col("_v") >= F.col("q.lo")
    grid = max(4, accuracy // 10)
    while brackets.where((F.col("held") > most) & (F.col("lo") < F.col("hi"))).limit(1).count():
        steps = F.percentile_approx(F.when(inside, F.col("_v")), F.array(*[F.lit(i / grid) for i in range(grid + 1)]), accuracy)
        seen = of_values(brackets.where((F.col("held") > most) & (F.col("lo") < F.col("hi")))).groupBy(*ks, F.col("q._p").alias("_p")).agg(
            F.count_if(inside).alias("n"), F.count_if(~inside).alias("below"), steps.alias("e"))
        at = (F.col("pos") - F.col("below")) / F.col("n") * grid
        first, last = (F.floor(at) - 1).cast("int"), (F.ceil(at) + 2).cast("int")
        narrow = join_keys(brackets, seen, [*ks, "_p"])
        narrow = narrow.select(
            *ks, "_p", "pos", "n", "held", F.col("lo").alias("lo0"), F.col("hi").alias("hi0"),
            F.when(F.col("n").isNull() | (first <= 0), F.col("lo")).otherwise(F.get("e", first)).alias("lo"),
            F.when(F.col("n").isNull() | (last >= grid), F.col("hi")).otherwise(F.get("e", last)).alias("hi"))
        # a bracket that stays as it is has its rows at the ends: few distinct values are left between
        stays = (F.col("lo") == F.col("lo0")) & (F.col("hi") == F.col("hi0"))
        narrow = narrow.withColumn("held", F.when(F.col("n").isNull(), F.col("held")).when(stays, 0)
                                   .otherwise(F.ceil(F.col("n") * 4 / grid).cast("bigint"))).drop("n", "lo0", "hi0")
        brackets = cut_lineage(narrow)
    # values below a bracket only need counting; inside it equal values collapse to one row
    g = (of_values(brackets).groupBy(*ks, F.col("q._p").alias("_p"), F.col("q.pos").alias("pos"),
                                     F.when(inside, F.col("_v")).alias("v")).agg(F.count(F.lit(1)).alias("c")))
    cum = F.sum("c").over(Window.partitionBy(*ks, "_p").orderBy(F.col("v").asc_nulls_first())
                          .rowsBetween(Window.unboundedPreceding, 0))
    g = g.withColumn("last", cum - 1).withColumn("first", F.col("last") - F.col("c") + 1)
    at = lambda r: F.max(F.when((F.col("first") <= r) & (F.col("last") >= r), F.col("v")))
    lo_r, hi_r = F.floor("pos"), F.ceil("pos")
    vals = g.groupBy(*ks, "_p", "pos").agg(at(lo_r).alias("a"), at(hi_r).alias("b"))
    val = F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos"))
    out = vals.groupBy(*ks).agg(*[F.max(F.when(F.col("_p") == n, val)).alias(n) for n in probs])
    return out if keys else out.drop("_all")
