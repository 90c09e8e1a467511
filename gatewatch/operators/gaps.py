"""Greedy per-key filters: keep a row only when the last *kept* row is old enough.

The decision depends on earlier decisions, so a plain ``lag`` is wrong and a fold over a whole
key would put a busy key into one task.  The timeline of a key is cut into segments:

1. every (key, segment) group works out, for each row that could be the first one kept in it,
   which row would be the last one kept (neighbouring starts mostly end alike, so the answer is a
   short list of ranges);
2. one pass per key over those ranges, read in order as a stream, finds the row each segment
   really starts from;
3. every (key, segment) group replays its part from there.

Groups are one key's traffic of one segment; step 2 sees only the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import DEFAULT_SLICE, Rolling, previous_time, rolling_totals, row_numbers, slice_of

_NEVER = -(1 << 62)
SEGMENT_LIMIT = 6 * 3600 * 1_000_000  # a key's traffic of six hours is the largest group


class _Groups:
    """Rows of several groups, each in time order, as flat arrays.

    ``jump[i]`` is the first row of the same group that may follow row ``i`` (``n`` if there is none).
    All groups are searched at once by shifting each one's times into its own range.
    """

    def __init__(self, t: np.ndarray, gap: np.ndarray, first: np.ndarray):
        self.t, self.n = t, len(t)
        self.gid = np.cumsum(first)
        self.base = t.min()
        self.span = int(t.max() - self.base) + 2
        self.pos = self.gid * self.span + (t - self.base)
        self.starts = np.flatnonzero(np.append(True, self.gid[1:] != self.gid[:-1]))
        self.end = np.append(self.starts[1:], self.n)[self.gid - self.gid[0]]
        reach = np.minimum(t - self.base + gap, self.span - 1)
        nxt = np.searchsorted(self.pos, self.gid * self.span + reach)
        # a gap that leads past the last time of the group ends its chain
        self.jump = np.where((nxt < self.end) & (t - self.base + gap < self.span), nxt, self.n)

    def at_or_after(self, times: np.ndarray) -> np.ndarray:
        """Per group: its first row that is not earlier than the group's time, ``n`` if there is none."""
        rel = np.clip(times - self.base, 0, self.span - 1)
        i = np.searchsorted(self.pos, self.gid[self.starts] * self.span + rel)
        return np.where((i < self.end[self.starts]) & (times - self.base < self.span), i, self.n)

    def last_kept(self) -> np.ndarray:
        """Where the chain from each row ends, by pointer doubling."""
        f = np.where(self.jump < self.n, self.jump, np.arange(self.n))
        while True:
            g = f[f]
            if np.array_equal(g, f):
                return f
            f = g

    def walk(self, start: np.ndarray) -> np.ndarray:
        """Mask of the rows on the chains that begin at ``start``, all groups in step."""
        kept, cur = np.zeros(self.n, bool), start[start < self.n]
        while len(cur):
            kept[cur] = True
            cur = self.jump[cur]
            cur = cur[cur < self.n]
        return kept


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Regroups Arrow batches so that no group is torn; column ``_first`` marks where groups begin."""
    held: list[pd.DataFrame] = []
    for b in batches:
        begins = np.flatnonzero(b["_first"].to_numpy())
        if not len(begins):
            held.append(b)
            continue
        if held or begins[0] > 0:
            held.append(b.iloc[:begins[0]])
            yield pd.concat(held, ignore_index=True)
        if begins[-1] > begins[0]:
            yield b.iloc[begins[0]:begins[-1]].reset_index(drop=True)
        held = [b.iloc[begins[-1]:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _in_order(df: DataFrame, part: list[str]) -> DataFrame:
    """Rows of each group next to each other in time order, group starts flagged.  The ranking and
    the final sort need the same order, so the data is sorted once."""
    w = Window.partitionBy(*part).orderBy("_t")
    return df.withColumn("_first", F.row_number().over(w) == 1).sortWithinPartitions(*part, "_t")


def greedy_keep(rows: DataFrame, keys: list[str], ts: str, tie: str, gap_us, max_gap_us: int | None = None,
                segment_us: int | None = None) -> DataFrame:
    """Rows kept by the filter: (keys, ts, tie, gap_us).

    ``gap_us`` is a column (µs a kept row blocks the key for) or a number, at most ``max_gap_us``, which is looked
    up in ``rows`` unless given; a row with a longer gap is an error, never a wrong answer.
    A row exactly ``gap`` after the last kept one is kept again.  Keys must not be NULL.
    """
    gap = F.lit(gap_us) if isinstance(gap_us, int) else gap_us
    if max_gap_us is None:
        max_gap_us = gap_us if isinstance(gap_us, int) else rows.agg(F.max(gap)).first()[0] or 1
    elif not isinstance(gap_us, int):
        gap = F.when(gap > max_gap_us, F.raise_error(F.lit("a gap is longer than max_gap_us"))).otherwise(gap)
    segment_us = segment_us or max(1, min(16 * max_gap_us, SEGMENT_LIMIT))
    src = rows.select(*keys, F.col(ts).cast("bigint").alias("_t"), F.col(tie).cast("bigint").alias("_o"),
                      gap.cast("bigint").alias("_g"))
    # rows of one time can keep only one of them; thinned out before anything reaches Python
    src = src.groupBy(*keys, "_t").agg(F.min(F.struct("_o", "_g")).alias("_m")).select(
        *keys, "_t", "_m._o", "_m._g").withColumn("_seg", slice_of(F.col("_t"), segment_us))
    types = dict(src.dtypes)
    key_ddl = ", ".join(f"`{k}` {types[k]}" for k in keys)
    part = [*keys, "_seg"]

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _whole_groups(batches):
            g = _Groups(b["_t"].to_numpy(), b["_g"].to_numpy(), b["_first"].to_numpy())
            seg = b["_seg"].to_numpy()
            last = g.last_kept()
            # candidates: rows a ban from before the segment can reach, and the first row behind them
            near = g.t < seg + max_gap_us
            near |= np.append(True, near[:-1]) | b["_first"].to_numpy()
            # of neighbouring candidates with the same end only the latest is written
            same = np.append((last[1:] == last[:-1]) & near[1:] & (g.gid[1:] == g.gid[:-1]), False)
            pick = np.flatnonzero(near & ~same)
            out = b.iloc[pick][[*keys, "_seg"]].copy()
            out["_hi"] = g.t[pick]
            out["_free"] = g.t[last[pick]] + b["_g"].to_numpy()[last[pick]]
            yield out

    table = _in_order(src.repartition(*part), part).mapInPandas(
        ranges, f"{key_ddl}, _seg bigint, _hi bigint, _free bigint")

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free, done = _NEVER, None
        for b in batches:
            hit, start = [], []
            for i, (new, seg, hi, nf) in enumerate(zip(
                    b["_first"].tolist(), b["_seg"].tolist(), b["_t"].tolist(), b["_free"].tolist())):
                if new:
                    free, done = _NEVER, None
                if seg != done and hi >= free:
                    hit.append(i)
                    start.append(free)
                    free, done = nf, seg
            out = b.iloc[hit][[*keys, "_seg"]].copy()
            out["_from"] = start
            yield out

    entry = _in_order(table.withColumnRenamed("_hi", "_t").repartition(*keys), keys).mapInPandas(
        enter, f"{key_ddl}, _seg bigint, _from bigint")

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = _NEVER
        for b in batches:
            if not len(b):
                continue
            g = _Groups(b["_t"].to_numpy(), b["_g"].to_numpy(), b["_first"].to_numpy())
            begin = b["_from"].to_numpy()[g.starts].copy()
            if not b["_first"].iloc[0]:  # a group that goes on from the batch before
                begin[0] = free
            kept = g.walk(g.at_or_after(begin))
            tail = np.flatnonzero(kept[g.starts[-1]:])
            if len(tail):
                i = g.starts[-1] + tail[-1]
                free = int(g.t[i] + b["_g"].iloc[i])
            else:
                free = int(begin[-1])
            yield b[kept][[*keys, "_t", "_o", "_g"]]

    out = _in_order(src.join(entry, part), part).mapInPandas(
        replay, f"{key_ddl}, _t bigint, _o bigint, _g bigint")
    return out.select(*keys, F.col("_t").alias(ts), F.col("_o").alias(tie), F.col("_g").alias("gap_us"))


def _limited(t: np.ndarray, taken: np.ndarray, most: int, window: int) -> np.ndarray:
    """Which of the sorted times are allowed, ``taken`` being the last allowed times before.

    The loop runs over changes, not rows: rows are allowed in one stretch up to the first that has ``most`` allowed ones
    inside its window, then all are refused in one stretch until the oldest of those leaves.
    """
    allowed, i, n = np.zeros(len(t), bool), 0, len(t)
    while i < n:
        step = 2 * most
        while i < n:
            chunk = t[i:i + step]
            line = np.concatenate([taken, chunk])
            back = len(taken) + np.arange(len(chunk)) - most
            full = (back >= 0) & (line[np.maximum(back, 0)] > chunk - window)
            free = int(full.argmax()) if full.any() else len(chunk)
            allowed[i:i + free] = True
            taken = line[:len(taken) + free][-most:]
            i += free
            if free < len(chunk):
                break
            step *= 2
        if i < n:
            i += int(np.searchsorted(t[i:], taken[0] + window, "left"))
    return allowed


def sliding_limit(rows: DataFrame, keys: list[str], ts: str, tie: str, max_requests: int,
                  window_us: int) -> DataFrame:
    """Allow a row while fewer than ``max_requests`` *allowed* rows are younger than the window.

    Idle gaps of a full window reset the state, so a key is cut there into sessions that run in parallel.  A session of
    at most ``max_requests`` rows allows all; of longer ones, rows are read in time order as a stream whose state is the last
    allowed times, and whole stretches are allowed or refused at once.
    """
    if max_requests < 1:
        raise ValueError("max_requests is at least 1")
    src = rows.select(*keys, F.col(ts).alias("_t"), F.col(tie).alias("_o"))
    src = previous_time(src, keys, "_t", "_o", "_p", slice_us=max(window_us, 60_000_000))
    fresh = F.when(F.col("_p").isNull() | (F.col("_t") - F.col("_p") >= window_us), 1).otherwise(0)
    src = rolling_totals(src, keys, "_t", [Rolling("_session", fresh, None)], tie="_o",
                         slice_us=max(window_us, 60_000_000))
    types = dict(src.dtypes)
    key_ddl = ", ".join(f"`{k}` {types[k]}" for k in keys)
    part = [*keys, "_session"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken = np.empty(0, np.int64)  # of the session that the last batch ended in
        for b in batches:
            if not len(b):
                continue
            t = b["_t"].to_numpy(np.int64)
            starts = np.flatnonzero(b["_first"].to_numpy())
            if not len(starts) or starts[0] > 0:
                starts = np.concatenate([[0], starts])
                carried = taken
            else:
                carried = taken[:0]
            ends = np.append(starts[1:], len(t))
            allowed = np.ones(len(t), bool)
            for s, e in zip(starts.tolist(), ends.tolist()) if (ends - starts).max() + len(carried) > max_requests else ():
                if e - s + (len(carried) if s == 0 else 0) > max_requests:
                    allowed[s:e] = _limited(t[s:e], carried if s == 0 else taken[:0], max_requests, window_us)
            # sessions one behind the other on one axis, a window and more apart
            length = t[ends - 1] - t[starts] + 2 * window_us
            length[0] += int(t[0] - carried[0]) if len(carried) else 0
            shift = np.repeat(np.concatenate([[0], np.cumsum(length[:-1])]) - t[starts], ends - starts)
            shift += int(t[0] - carried[0]) if len(carried) else 0
            axis = t + shift
            line = np.concatenate([carried + shift[0], axis[allowed]])
            used = len(carried) + np.cumsum(allowed) - np.searchsorted(line, axis - window_us, "right")
            last = starts[-1]
            taken = np.concatenate([carried if last == 0 else taken[:0], t[last:][allowed[last:]]])[-max_requests:]
            out = b[[*keys, "_t", "_o"]].copy()
            out["allowed"], out["remaining"] = allowed, max_requests - used
            yield out

    w = Window.partitionBy(*part).orderBy("_t", "_o")
    flagged = (src.repartition(*part).withColumn("_first", F.row_number().over(w) == 1)
               .sortWithinPartitions(*part, "_t", "_o"))
    out = flagged.mapInPandas(scan, f"{key_ddl}, _t bigint, _o bigint, allowed boolean, remaining bigint")
    return out.withColumnsRenamed({"_t": ts, "_o": tie})


def baseline_statistics(rows: DataFrame, key: str, ts: str, tie: str, value: str, anomaly: str,
                        block: int = 50_000, slice_us: int | None = None) -> DataFrame:
    """Mean ``_m`` and deviation ``_sd`` of the normal values among the last 50 samples, and
    whether they count (``_on``: 10th sample or later, a normal value in reach).

    A series is cut into numbered blocks (``_rn``, ``_blk``); the last 49 samples are handed to the
    next block for its frame.
    """
    src = row_numbers(rows.select(key, ts, tie, value, anomaly), [key], ts, tie, "_rn",
                      slice_us or DEFAULT_SLICE)
    src = src.withColumn("_home", F.expr(f"(_rn - 1) div {block}"))
    hand_on = F.when((F.col("_rn") - 1) % block >= block - 49,
                     F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home"))
    src = src.withColumn("_blk", F.explode(hand_on))
    frame = Window.partitionBy(key, "_blk").orderBy("_rn").rowsBetween(-49, 0)
    normal = F.when(~F.col(anomaly), F.col(value))
    src = (src.withColumn("_m", F.avg(normal).over(frame)).withColumn("_sd", F.stddev_pop(normal).over(frame))
           .where(F.col("_home") == F.col("_blk")).drop("_home"))
    return src.withColumn("_on", (F.col("_rn") >= 10) & F.col("_m").isNotNull())


def smoothed_threshold(rows: DataFrame, key: str, ts: str, tie: str, value: str, anomaly: str,
                       initial: DataFrame, sensitivity: float = 0.1, rate: float = 0.05,
                       block: int = 50_000, slice_us: int | None = None) -> DataFrame:
    """Adaptive threshold of each sample: ``baseline + sd * sensitivity`` after the sample is taken in.

    From a series' 10th sample on, the mean and deviation of the normal values among its last 50
    pull the baseline by ``rate``; before, and while no normal value is in reach, it stays.
    The smoothing is linear, so a block of samples is ``b_out = A * b_in + B`` and blocks compose.
    ``initial`` has (key, initial).
    """
    src = baseline_statistics(rows, key, ts, tie, value, anomaly, block, slice_us)
    part = [key, "_blk"]
    # position among the samples that move the baseline, counted inside the block
    pos = Window.partitionBy(*part).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    src = src.withColumn("_i", F.sum(F.col("_on").cast("int")).over(pos))
    n = F.max("_i").over(Window.partitionBy(*part))
    keep = 1.0 - rate
    blocks = (src.withColumn("_w", F.when(F.col("_on"), rate * F.pow(F.lit(keep), n - F.col("_i")) * F.col("_m")))
              .groupBy(*part).agg(F.max("_i").alias("n"), F.coalesce(F.sum("_w"), F.lit(0.0)).alias("b"),
                                  F.max_by("_sd", F.when(F.col("_on"), F.col("_i"))).alias("sd"))
              .join(initial, key))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, base, sd = object(), 0.0, np.nan
        for f in batches:
            opening, spread = [], []
            for kk, cnt, b, last, first in zip(f[key], f["n"], f["b"], f["sd"], f["initial"]):
                if kk != k:
                    k, base, sd = kk, first, np.nan
                opening.append(base)
                spread.append(sd)
                base = base * keep ** cnt + b
                sd = last if cnt else sd
            yield pd.DataFrame({key: f[key], "_blk": f["_blk"], "_b0": opening, "_sd0": spread,
                                "initial": f["initial"]})

    kt = dict(src.dtypes)[key]
    opening = (blocks.repartition(key).sortWithinPartitions(key, "_blk")
               .mapInPandas(chain, f"{key} {kt}, _blk bigint, _b0 double, _sd0 double, initial double"))
    joined = src.join(opening, part)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        on = pdf["_on"].to_numpy()
        base = np.full(len(pdf), np.nan)
        x = np.concatenate([[pdf["_b0"].iloc[0]], pdf["_m"].to_numpy()[on]])
        base[on] = pd.Series(x).ewm(alpha=rate, adjust=False).mean().to_numpy()[1:]
        base = pd.Series(base).ffill().fillna(pdf["_b0"].iloc[0]).to_numpy()
        # a sample that does not move the baseline leaves the last threshold standing
        sd = pd.Series(np.where(on, pdf["_sd"].to_numpy(float), np.nan)).ffill()
        sd = sd.fillna(pdf["_sd0"].iloc[0]).to_numpy()
        out = pdf[[key, ts, tie, value, anomaly]].copy()
        out["rn"], out["baseline"] = pdf["_rn"], base
        out["threshold"] = np.where(np.isnan(sd), pdf["initial"].to_numpy(), base + sd * sensitivity)
        return out

    vt = dict(src.dtypes)
    return joined.groupBy(*part).applyInPandas(
        settle, f"{key} {kt}, {ts} {vt[ts]}, {tie} {vt[tie]}, {value} {vt[value]}, "
                f"{anomaly} {vt[anomaly]}, rn bigint, baseline double, threshold double")
