"""What is known of an address when each of its requests arrives, kept by ``transformWithState``.

Addresses share state in groups by a hash, so that calls to the state store grow with groups and not with addresses; all
addresses of a group are judged in one pass over arrays.  State of a group: running totals of each address (value), requests
of the last window in buckets of a minute (map), hashes of all paths and agents seen (map, in shards), rows of the running
micro batch that wait for their bucket (map), and an event-time timer that drops the window once the group is silent and
what is known of an address after ``ttl_s``.  A forgotten address that comes back gets a new number, so nothing old is its own.

A micro batch is sorted into buckets and worked off in stretches of buckets, ``HELD_ROWS`` at a time; more rows wait in the
state.  Only buckets and shards that change are written.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.prefix import MINUTE, SECOND

BUCKET, SHARDS, HELD_ROWS = MINUTE, 4, 200_000
#: A stretch of buckets is no longer than this many.
STRETCH = 1440
NEVER = 1 << 62

#: One request on its way: hashes of uri and agent; ``is_ban`` marks a row that only reports a ban.
INPUT = {"event_id": np.int64, "ts_us": np.int64, "status": np.float64, "uri": np.int64, "agent": np.int64,
         "has_path": bool, "has_agent": bool, "sensitive": bool, "is_ban": bool, "pattern_label": object, "remote_addr": object}
ROWS = "event_id array<bigint>, ts_us array<bigint>, status array<double>, uri array<bigint>, agent array<bigint>, " \
       "has_path array<boolean>, has_agent array<boolean>, sensitive array<boolean>, is_ban array<boolean>, pattern_label array<string>, remote_addr array<string>"
WINDOW = {"ts": np.int64, "f404": bool, "uri": np.int64, "sensitive": bool, "attack": bool, "code": np.int64}
#: Totals of the addresses of a group, in order of their numbers; ``first_us`` and ``last_us`` are NEVER and -NEVER without requests.
TOTALS = ("code", "n", "attacks", "n4xx", "n404", "paths", "agents", "first_us", "last_us", "bans")
NEW = dict(zip(TOTALS[1:], (0, 0, 0, 0, 0, 0, NEVER, -NEVER, 0)))


def _ddl(cols, kinds: dict) -> str:
    return ", ".join(f"{c} array<{'boolean' if kinds.get(c) is bool else 'bigint'}>" for c in cols)


COUNTS = ("n404", "n_1min", "n_5min", "n_uris", "n_sensitive", "request_count", "attack_count", "attacks_60s", "count_4xx", "count_404",
          "unique_paths", "unique_agents", "ban_count", "first_seen_us")
OUTPUT = "remote_addr string, event_id bigint, ts_us bigint, pattern_label string, is_attack boolean, " + ", ".join(f"{c} bigint" for c in COUNTS)


def distinct_in_windows(codes: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of the windows ``[lo, hi)``, and those with ``weight``; both ends only move forward.

    An entry counts where it is the last of its code in the window: from the window that reaches it until one that
    reaches the next of its code or leaves it.  Changes of all entries are added up in one pass.
    """
    n = len(codes)
    following = np.full(n, n + 1)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    following[order[:-1][same]] = order[1:][same]
    at = np.arange(n)
    begin = np.searchsorted(hi, at, "right")
    end = np.minimum(np.searchsorted(hi, following, "right"), np.searchsorted(lo, at, "right"))
    live = end > begin
    out = []
    for w in (np.ones(n, np.int64), weight.astype(np.int64)):
        change = np.zeros(len(lo) + 1, np.int64)
        np.add.at(change, begin[live], w[live])
        np.add.at(change, end[live], -w[live])
        out.append(np.cumsum(change[:-1]))
    return out[0], out[1]


def unseen(known: tuple, code: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Marks the first row of each (code, value) that is not among the ``known`` pairs."""
    n = len(known[0])
    c, v = np.concatenate([known[0], code]), np.concatenate([known[1], value])
    order = np.lexsort((v, c))  # stable: known pairs come first
    first = np.ones(len(c), bool)
    first[1:] = (c[order[1:]] != c[order[:-1]]) | (v[order[1:]] != v[order[:-1]])
    mark = np.zeros(len(c), bool)
    mark[order[first]] = True
    return mark[n:]


class Group:
    """What is known of the addresses of a group: one entry of ``at`` and of each array of ``totals`` for each."""

    def __init__(self, stored: tuple | None):
        stored = stored or ([],) * (len(TOTALS) + 3) + (0,)
        self.addr = list(stored[0])
        self.totals = {c: np.array(v, np.int64) for c, v in zip(TOTALS, stored[1:])}
        self.ban_code, self.ban_ts = (np.array(v, np.int64) for v in stored[-3:-1])
        self.next = stored[-1]
        self.at = {a: i for i, a in enumerate(self.addr)}

    def row(self) -> tuple:
        return (self.addr, *(self.totals[c].tolist() for c in TOTALS), self.ban_code.tolist(), self.ban_ts.tolist(), self.next)

    def find(self, addr: np.ndarray) -> np.ndarray:
        """Index of each address; new ones are added."""
        codes, names = pd.factorize(addr, use_na_sentinel=False)
        names = [None if pd.isna(a) else a for a in names]
        new = [a for a in names if a not in self.at]
        self._add(new, np.zeros(len(new), np.int64))
        return np.array([self.at[a] for a in names], np.int64)[codes]

    def _add(self, addr: list, bans: np.ndarray) -> None:
        self.at |= {a: len(self.addr) + i for i, a in enumerate(addr)}
        self.addr += addr
        fresh = {c: np.full(len(addr), v) for c, v in NEW.items()} | {"code": self.next + np.arange(len(addr)), "bans": bans}
        self.totals = {c: np.concatenate([v, fresh[c]]) for c, v in self.totals.items()}
        self.next += len(addr)

    def count_bans(self, mark: int) -> None:
        """Bans behind the watermark count for every row still to come."""
        old = self.ban_ts < mark
        np.add.at(self.totals["bans"], np.searchsorted(self.totals["code"], self.ban_code[old]), 1)
        self.ban_code, self.ban_ts = self.ban_code[~old], self.ban_ts[~old]

    def forget(self, gone: np.ndarray) -> None:
        """Everything of these addresses goes but the bans, which are no counts of requests."""
        back = gone & ((self.totals["bans"] > 0) | np.isin(self.totals["code"], self.ban_code))
        codes, bans, names = self.totals["code"][back], self.totals["bans"][back], [self.addr[i] for i in np.flatnonzero(back)]
        self.addr = [self.addr[i] for i in np.flatnonzero(~gone)]
        self.at = {a: i for i, a in enumerate(self.addr)}
        self.totals = {c: v[~gone] for c, v in self.totals.items()}
        moved = np.isin(self.ban_code, codes)
        self.ban_code[moved] = self.next + np.searchsorted(codes, self.ban_code[moved])
        self._add(names, bans)


class AddressProcessor(StatefulProcessor):
    def __init__(self, rules: dict, ttl_s: int | None = 86_400):
        self.rules, self.ttl = rules, None if ttl_s is None else ttl_s * SECOND
        self.w404 = rules["time_window_minutes"] * MINUTE
        self.keep = max(self.w404, 10 * MINUTE)

    def init(self, handle) -> None:
        self.handle = handle
        self.totals = handle.getValueState(
            "totals", f"addr array<string>, {_ddl((*TOTALS, 'ban_code', 'ban_ts'), {})}, next bigint")
        self.window = handle.getMapState("window", "bucket bigint", _ddl(WINDOW, WINDOW))
        self.seen = handle.getMapState("seen", "kind int, shard int", "codes array<bigint>, hashes array<bigint>")
        self.waiting = handle.getMapState("waiting", "bucket bigint, part bigint", ROWS)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held, n_held, stored, sizes, earliest = defaultdict(list), 0, defaultdict(list), defaultdict(int), {}

        def put_aside():
            for b, parts in held.items():
                stored[b].append(len(stored[b]))
                both = {c: np.concatenate([p[c] for p in parts]) for c in INPUT}
                self.waiting.updateValue((b, stored[b][-1]), tuple(v.tolist() for v in both.values()))
            held.clear()

        for chunk in rows:
            chunk = chunk[chunk["ts_us"] >= mark]
            cols = {c: chunk[c].to_numpy(t) for c, t in INPUT.items()}
            for a, t in chunk.groupby("remote_addr", dropna=False)["ts_us"].min().items():
                a = None if pd.isna(a) else a
                earliest[a] = min(int(t), earliest.get(a, NEVER))
            bucket = cols["ts_us"] // BUCKET
            for b in np.unique(bucket):
                at = bucket == b
                held[int(b)].append({c: v[at] for c, v in cols.items()})
                sizes[int(b)] += int(at.sum())
            n_held += len(chunk)
            if n_held > HELD_ROWS:
                put_aside()
                n_held = 0
        buckets = sorted(sizes)
        if not buckets:
            return
        group = Group(self.totals.get() if self.totals.exists() else None)
        self._forget(group, mark, earliest)
        group.count_bans(mark)
        recent = {k[0]: {c: np.array(a, t) for (c, t), a in zip(WINDOW.items(), v)} for k, v in self.window.iterator()}
        i = 0
        while i < len(buckets):
            # as many buckets as hold HELD_ROWS, one at least
            j, n = i + 1, sizes[buckets[i]]
            while j < len(buckets) and n + sizes[buckets[j]] <= HELD_ROWS and buckets[j] - buckets[i] < STRETCH:
                n += sizes[buckets[j]]
                j += 1
            parts = []
            for b in buckets[i:j]:
                parts += held.pop(b, [])
                for p in stored[b]:
                    parts.append({c: np.array(v, t) for (c, t), v in zip(INPUT.items(), self.waiting.getValue((b, p)))})
                    self.waiting.removeKey((b, p))
            new = {c: np.concatenate([p[c] for p in parts]) for c in INPUT}
            new["at"] = group.find(new["remote_addr"])
            order = np.lexsort((new["event_id"], new["ts_us"], new["at"]))
            new = {c: v[order] for c, v in new.items()}
            ban = new["is_ban"]
            group.ban_code = np.concatenate([group.ban_code, group.totals["code"][new["at"][ban]]])
            group.ban_ts = np.concatenate([group.ban_ts, new["ts_us"][ban]])
            new = {c: v[~ban] for c, v in new.items()}
            if len(new["ts_us"]):
                yield self._judge(group, new, recent)
            i = j
        oldest = (mark - self.keep) // BUCKET
        for b in [b for b in recent if b < oldest]:
            if self.window.containsKey((b,)):
                self.window.removeKey((b,))
        self.totals.update(group.row())
        self._set_timer(group, mark, True)

    def _judge(self, group: Group, new: dict, recent: dict) -> pd.DataFrame:
        """Counts of the new rows of a stretch of buckets, by address in order of time; ``recent`` and ``group`` move on."""
        total, who = group.totals, new["at"]
        code = total["code"][who]
        f404 = new["status"] == 404
        bucket = new["ts_us"] // BUCKET
        fresh = {"ts": new["ts_us"], "f404": f404, "uri": new["uri"], "sensitive": new["sensitive"],
                 "attack": np.zeros(len(who), bool), "code": code}
        old = [recent[x] for x in sorted(recent) if bucket.min() - self.keep // BUCKET - 1 <= x <= bucket.max()]
        both = {c: np.concatenate([o[c] for o in old] + [fresh[c]]) for c in WINDOW}
        ours = np.isin(both["code"], code)
        is_new = np.concatenate([np.zeros(len(ours) - len(who), bool), np.ones(len(who), bool)])[ours]
        both = {c: v[ours] for c, v in both.items()}
        order = np.lexsort((both["ts"], both["code"]))
        t, f, u, s, a, k = (both[c][order] for c in WINDOW)
        at = np.flatnonzero(is_new[order])
        # one number line for all addresses, with a gap wider than any window between them
        nth = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
        t0 = t.min()
        line = nth * (t.max() - t0 + self.keep + 2) + (t - t0)
        hi = np.searchsorted(line, line[at], "right")
        lo = lambda w: np.searchsorted(line, line[at] - w, "left")
        c404 = np.concatenate([[0], np.cumsum(f)])
        by = np.lexsort((u, k))
        value = np.empty(len(u), np.int64)
        value[by] = np.cumsum(np.concatenate([[0], (u[by[1:]] != u[by[:-1]]) | (k[by[1:]] != k[by[:-1]])]))
        uris, sensitive = distinct_in_windows(value, s, lo(10 * MINUTE), hi)
        out = {"n404": c404[hi] - c404[lo(self.w404)], "n_1min": hi - lo(MINUTE), "n_5min": hi - lo(5 * MINUTE),
               "n_uris": uris, "n_sensitive": sensitive}
        r = self.rules
        attack = (pd.notna(new["pattern_label"]) | (out["n404"] >= r["not_found_threshold"]) | (out["n_1min"] > r["requests_per_minute"])
                  | (out["n_5min"] > r["requests_per_5min"]) | (uris > r["distinct_paths"]) | (sensitive > r["sensitive_paths"]))
        a[at] = attack
        attacks = np.concatenate([[0], np.cumsum(a)])
        out["attacks_60s"] = attacks[at + 1] - attacks[np.searchsorted(line, line[at] - MINUTE, "right")]
        n4xx = (new["status"] >= 400) & (new["status"] <= 499)
        begin = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        end, mine = np.append(begin[1:], len(who)) - 1, who[begin]
        run = np.repeat(np.arange(len(begin)), end - begin + 1)
        for name, col, flag in (("request_count", "n", np.ones(len(at), bool)), ("attack_count", "attacks", attack), ("count_4xx", "n4xx", n4xx),
                                ("count_404", "n404", f404), ("unique_paths", "paths", self._first(0, code, new["uri"], new["has_path"])),
                                ("unique_agents", "agents", self._first(1, code, new["agent"], new["has_agent"]))):
            sums = np.cumsum(flag)
            out[name] = sums + (total[col][mine] - (sums[begin] - flag[begin]))[run]
            total[col][mine] = out[name][end]
        by = np.lexsort((group.ban_ts, group.ban_code))
        bans = group.ban_ts[by]
        lead = np.searchsorted(group.ban_code[by], total["code"][mine], "left")
        last = np.searchsorted(group.ban_code[by], total["code"][mine], "right")
        out["ban_count"] = total["bans"][who]
        for x in np.flatnonzero(last > lead):
            rows = slice(begin[x], end[x] + 1)
            out["ban_count"][rows] += np.searchsorted(bans[lead[x]:last[x]], new["ts_us"][rows], "right")
        total["first_us"][mine] = np.minimum(total["first_us"][mine], new["ts_us"][begin])
        total["last_us"][mine] = np.maximum(total["last_us"][mine], new["ts_us"][end])
        out["first_seen_us"] = total["first_us"][who]
        fresh["attack"] = attack
        for b in np.unique(bucket).tolist():
            here = {c: v[bucket == b] for c, v in fresh.items()}
            recent[b] = {c: np.concatenate([recent[b][c], v]) for c, v in here.items()} if b in recent else here
            self.window.updateValue((b,), tuple(v.tolist() for v in recent[b].values()))
        head = {"remote_addr": new["remote_addr"], "event_id": new["event_id"], "ts_us": new["ts_us"], "pattern_label": new["pattern_label"],
                "is_attack": attack}
        return pd.DataFrame({**head, **{c: out[c].astype(np.int64) for c in COUNTS}})

    def _first(self, kind: int, code: np.ndarray, hashes: np.ndarray, present: np.ndarray) -> np.ndarray:
        """Marks rows whose hash was never seen before from their address, and remembers it."""
        mark, shard = np.zeros(len(hashes), bool), hashes % SHARDS
        for x in np.unique(shard[present]).tolist():
            here = np.flatnonzero(present & (shard == x))
            known = self.seen.getValue((kind, x))
            known = tuple(np.array(v, np.int64) for v in known) if known else (np.zeros(0, np.int64),) * 2
            new = here[unseen(known, code[here], hashes[here])]
            if len(new):
                mark[new] = True
                self.seen.updateValue((kind, x), tuple(np.concatenate([k, v[new]]).tolist() for k, v in zip(known, (code, hashes))))
        return mark

    def _forget(self, group: Group, mark: int, earliest: dict) -> None:
        """Addresses go that were silent for the time to live: until their new rows, or until the watermark."""
        if self.ttl is None or not group.addr:
            return
        last, now = group.totals["last_us"], np.full(len(group.addr), mark)
        for a, t in earliest.items():
            if a in group.at:
                now[group.at[a]] = t // BUCKET * BUCKET
        gone = (last > -NEVER) & (now >= last + self.ttl)
        if gone.any():
            group.forget(gone)
            for k, v in list(self.seen.iterator()):
                codes, hashes = (np.array(x, np.int64) for x in v)
                kept = np.isin(codes, group.totals["code"])
                if not kept.all():
                    self.seen.updateValue(k, (codes[kept].tolist(), hashes[kept].tolist()))

    def _set_timer(self, group: Group, mark: int, window: bool) -> None:
        """The next time that something is to be dropped: the window, or an address."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        last = group.totals["last_us"]
        last = last[last > -NEVER]
        due = [(int(last.max(initial=mark)) + self.keep) // 1000] if window else []
        if self.ttl is not None and len(last):
            due.append((int(last.min()) + self.ttl) // 1000 + 1)
        if due:
            self.handle.registerTimer(max(min(due), mark // 1000 + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Silent for a window: its requests go.  Silent for the time to live: the address goes."""
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        if self.totals.exists():
            group = Group(self.totals.get())
            self._forget(group, mark, {})
            silent = int(group.totals["last_us"].max(initial=-NEVER)) + self.keep <= mark
            if silent:
                self.window.clear()
            if group.addr:
                self.totals.update(group.row())
                self._set_timer(group, mark, not silent)
            else:
                self.totals.clear()
        return iter(())
