"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Benchmark items are grouped by length; each group has a window size within STEP of its items' lengths. Every
text is cut into words, and a 64-bit SimHash of word pairs is taken of every window of every size, at starts a
small share of the window apart (a text shorter than a window is one window, if its shingles could weigh enough to match).
Pairs vote with the weight that verification gives their shingles: a pair weighs as the lightest of the shingles over it, so what
many items share (a template around questions) hardly moves a fingerprint, and starts are the closer the less of an
item is its own. Where nine tenths of each item's weight are its own, pairs vote alike. A fingerprint is looked up in tables of its BLOCKS blocks, which hold every value within radius // BLOCKS bits of an
item's block: two fingerprints within the radius agree that well in one block at least, so none is missed.
Candidates within the radius are verified at every start nearby by the weighted Jaccard similarity of five-word
shingles, windows being as long as the item; a shingle weighs less the more items hold it.

The benchmark goes to the executors in lots of about LOT items, each a pass over the texts, so what is sent is bounded
whatever its size. How many items hold a shingle or have a length is counted over all lots, so lots don't change the result. Texts are never shuffled. Edge cases: null or empty texts and items match nothing; an item of
fewer than five words is one shingle, looked up as it is at every word; equal items each get their row; repeated rows of a text give repeated rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, give_back
from fieldloom.llm.shingles import SPAN, hash_words, spans, words

#: Least weighted similarity; bits in which fingerprints may differ; blocks of a fingerprint.
LEAST, RADIUS, BLOCKS = 0.75, 15, 4
#: A window size serves items up to so many times as long; starts are this share of a window apart.
STEP, STRIDE = 1.12, 1 / 16
#: Items sent at once; words handled at once.
LOT, WORDS_AT_ONCE = 20_000, 16_384
#: Groups whose tables (2 MB each) a process keeps; beyond, tables are built when needed, for so many lots of words at once.
KEPT, LOTS_AT_ONCE = 16, 8
#: Votes of a pair of full weight where weights differ; the share of an item's weight that must be its own for pairs to vote alike.
VOTES, OWN = 16, 0.9


def _kind(votes: int) -> type:
    """The smallest numbers that count so many votes in a window, as prefix sums may wrap around."""
    return np.uint8 if votes < 1 << 8 else np.int16 if votes < 1 << 15 else np.int32


def _blocked_cumsum(bits: np.ndarray, kind: type = np.int16) -> np.ndarray:
    """Prefix sums along axis 0 with a leading 0, modulo 2^16 or as ``kind`` has it: enough for windows of fewer words than its largest number."""
    n = len(bits)
    full = np.zeros((-(-n // 32) * 32 or 32, bits.shape[1]), kind)
    full[:n] = bits
    cube = full.reshape(-1, 32, bits.shape[1])
    for k in range(1, 32):
        cube[:, k] += cube[:, k - 1]
    cube[1:] += np.cumsum(cube[:-1, -1], axis=0, dtype=kind)[:, None]
    return np.concatenate([np.zeros((1, bits.shape[1]), kind), full[:n]])


def _pairs(h: np.ndarray) -> np.ndarray:
    """A hash for each word and the next (the last one: alone)."""
    nxt = np.append(h[1:], np.uint64(0))
    x = h * np.uint64(0x9E3779B97F4A7C15) + nxt * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _bits(h: np.ndarray, votes: np.ndarray | None = None) -> np.ndarray:
    """The bits of each word pair, times its votes."""
    bits = np.unpackbits(_pairs(h).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits if votes is None else bits * votes[:, None]


def _majority(upto: np.ndarray, starts: np.ndarray, last: np.ndarray, votes: np.ndarray | None = None) -> np.ndarray:
    """The fingerprint of each window: bits that more than half of its word pairs have, or of the votes, whose prefix sums are given."""
    sums = upto.take(last, 0)
    sums -= upto.take(starts, 0)
    all_ = last - starts if votes is None else votes.take(last) - votes.take(starts)
    return np.packbits(sums > (all_ // 2).astype(upto.dtype)[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, votes: np.ndarray | None = None) -> np.ndarray:
    """SimHash of the word pairs of each window [start, end) of hashed words."""
    most = len(h) if votes is None else len(h) * VOTES
    return _majority(_blocked_cumsum(_bits(h, votes), _kind(most)), starts, np.maximum(ends - 1, starts + 1), _prefix(votes))


def _prefix(votes: np.ndarray | None) -> np.ndarray | None:
    return None if votes is None else np.concatenate([[0], np.cumsum(votes, dtype=np.int64)])


def window_sizes(lengths: Iterable[int]) -> dict[int, int]:
    """The window size for each length in words; items of near lengths share one."""
    out, order, at = {}, sorted(lengths), 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and order[stop] <= order[at] * STEP:
            stop += 1
        out |= dict.fromkeys(order[at:stop], round((order[at] + order[stop - 1]) / 2))
        at = stop
    return out


class Group:
    """Up to 64 items that share a window size, and their fingerprints."""

    kept: np.ndarray | None = None

    def __init__(self, items: list, radius: int, blocks: int):
        self.items, self.radius, self.blocks, self.bits = items, radius, blocks, 64 // blocks
        self.prints = np.array([fingerprints(i["h"], np.array([0]), np.array([len(i["h"])]), i.get("votes"))[0] for i in items], np.uint64)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": None}  # megabytes that take a worker a moment to build

    def tables(self, keep: bool = False) -> np.ndarray:
        """For each block and value of it, the items whose block differs in so few bits; built when needed, and kept only if a benchmark has few groups, so that memory doesn't grow with items."""
        if self.kept is not None:
            return self.kept
        near = [0]
        for k in range(1, self.radius // self.blocks + 1):
            near += [sum(1 << b for b in c) for c in combinations(range(self.bits), k)]
        near = np.array(near, np.int64)
        kind = next(t for n, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if len(self.prints) <= n)
        tables = np.zeros((self.blocks, 1 << self.bits), kind)
        for k, p in enumerate(self.prints.tolist()):
            for b in range(self.blocks):
                tables[b, ((p >> (b * self.bits)) & ((1 << self.bits) - 1)) ^ near] |= kind(1 << k)
        self.kept = tables if keep else None
        return tables

    def search(self, prints: np.ndarray, tables: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """(window numbers, item number) of all fingerprints within the radius."""
        low = np.uint64((1 << self.bits) - 1)
        hit = np.zeros(len(prints), tables.dtype)
        for b in range(self.blocks):
            hit |= tables[b].take(((prints >> np.uint64(b * self.bits)) & low).astype(np.int64))
        some = np.flatnonzero(hit)
        hit, near = hit[some], prints[some]
        for k, p in enumerate(self.prints):
            at = np.flatnonzero((hit & hit.dtype.type(1 << k)) != 0)
            at = at[np.bitwise_count(near[at] ^ p) <= self.radius]
            if len(at):
                yield some[at], k


class Benchmark:
    """Items ready for matching; ``weights`` has a shingle's weight where it isn't the full one.

    Of a part of a benchmark, ``frequency`` (items that hold a shingle), ``total`` and ``lengths`` (items of so many words) are those of the whole.
    """

    def __init__(self, rows: list[tuple[object, str]], frequency: dict[int, int] | None = None, total: int | None = None, lengths: dict[int, int] | None = None, radius: int = RADIUS, blocks: int = BLOCKS):
        self.items = []
        for key, text in rows:
            h = hash_words(words(text)) if text else np.zeros(0, np.uint64)
            if len(h):
                self.items.append({"id": key, "h": h, "set": np.unique(spans(h))})
        if frequency is None:
            frequency = defaultdict(int)
            for i in self.items:
                for s in i["set"].tolist():
                    frequency[s] += 1
        n = max(1, total or len(self.items))
        self.full = math.log1p(n)
        self.weights = {s: math.log1p(n / f) for s, f in frequency.items() if f > 1}
        for i in self.items:
            i["weight"] = sum(self.weights.get(s, self.full) for s in i["set"].tolist())
        self.items.sort(key=lambda i: len(i["h"]))
        self.short: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))  # by words and their shingle
        at = 0
        while at < len(self.items) and len(h := self.items[at]["h"]) < SPAN:
            self.short[len(h)][int(spans(h, len(h))[0])].append(self.items[at]["id"])
            at += 1
        self.short = {n: dict(of) for n, of in self.short.items()}
        sizes = window_sizes(n for n in (lengths or Counter(len(i["h"]) for i in self.items)) if n >= SPAN)
        alike = all(i["weight"] >= OWN * self.full * len(i["set"]) for i in self.items)
        light = np.array([] if alike else sorted(self.weights), np.uint64)
        self.light = light, np.array([max(1, round(VOTES * self.weights[s] / self.full)) for s in light.tolist()], np.uint8)
        for i in self.items[at:]:
            i["votes"] = self._votes(i["h"], np.array([0, len(i["h"])]))
        self.kind = _kind(max(sizes.values(), default=0) * (VOTES if len(light) else 1))
        self.groups: list[tuple[int, list[Group]]] = []  # by window size
        self.least_words: list[float] = []  # of each size: full shingles that weigh as much as the lightest item
        self.strides: list[int] = []  # of each size: words between starts, fewer if a tenth or more of an item isn't its own
        while at < len(self.items):
            size, stop = sizes[len(self.items[at]["h"])], at
            while stop < len(self.items) and sizes[len(self.items[stop]["h"])] == size:
                stop += 1
            self.groups.append((size, [Group(self.items[k : min(stop, k + 64)], radius, blocks) for k in range(at, stop, 64)]))
            self.least_words.append(min(i["weight"] for i in self.items[at:stop]) / self.full)
            own = min(i["weight"] / (self.full * len(i["set"])) for i in self.items[at:stop])
            self.strides.append(max(1, int(size * min(1.0, own / OWN) * STRIDE)))
            at = stop
        self.keep = sum(len(groups) for _, groups in self.groups) <= KEPT

    def _votes(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray | None:
        """Votes of each word and the next in texts laid end to end, as the lightest of the shingles in its text that hold both; None if all shingles weigh the same."""
        keys, marks = self.light
        n = len(flat)
        if not len(keys) or n < SPAN:
            return np.full(n, VOTES, np.uint8) if len(keys) else None
        found = spans(flat)
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        own = np.where(keys[at] == found, marks[at], np.uint8(VOTES))
        for end in offsets[1:-1]:  # shingles over a text's end are none
            own[max(0, end - SPAN + 1) : end] = VOTES
        votes = np.full(n, VOTES, np.uint8)
        for k in range(SPAN - 1):
            np.minimum(votes[k : k + len(own)], own, out=votes[k : k + len(own)])
        return votes

    def _best(self, item: dict, h: np.ndarray, low: int, high: int) -> tuple[float, int]:
        """The best similarity of a window as long as the item that starts in [low, high], and its start."""
        size, mine = len(item["h"]), frozenset(item["set"].tolist())
        low, high = max(0, low), max(0, min(high, len(h) - size))
        if low > high:
            low = high
        part = h[low : high + size]
        found = spans(part).tolist()
        if mine.isdisjoint(found):
            return 0.0, low
        best = (0.0, low)
        width = max(1, min(size, len(part)) - SPAN + 1)
        for k in range(high - low + 1):
            window = set(found[k : k + width])
            both = window & mine
            if both:
                w = sum(self.weights.get(s, self.full) for s in both)
                v = w / (item["weight"] + sum(self.weights.get(s, self.full) for s in window) - w)
                if v > best[0] + 1e-12:
                    best = (v, low + k)
        return best

    def matches(self, texts: list[str | None], least: float = LEAST) -> Iterator[tuple[int, object, float, int, int]]:
        """(text number, item id, similarity, first word, words) of each item found in each text."""
        at, lots = 0, []
        while at < len(texts):
            found, held = [], 0
            while at + len(found) < len(texts) and (not found or held < WORDS_AT_ONCE):
                t = texts[at + len(found)]
                found.append(words(t) if t else [])
                held += len(found[-1])
            lots.append((at, hash_words([w for ws in found for w in ws]), np.array([len(w) for w in found])))
            at += len(found)
            if at == len(texts) or self.keep or len(lots) == LOTS_AT_ONCE:
                yield from self._look(lots, least)
                lots = []

    def _short(self, flat: np.ndarray, offsets: np.ndarray, least: float):
        """Items of fewer than SPAN words: a window as long is the same shingle or none of it."""
        for n, of in self.short.items() if least <= 1 else ():
            if len(flat) < n:
                continue
            found = spans(flat, n)
            at = np.flatnonzero(np.isin(found, np.array(list(of), np.uint64)))
            doc = np.searchsorted(offsets, at, "right") - 1
            inside = at + n <= offsets[doc + 1]
            seen = set()
            for d, k in zip(doc[inside].tolist(), at[inside].tolist(), strict=True):
                s = int(found[k])
                if (d, s) not in seen:
                    seen.add((d, s))
                    for key in of[s]:
                        yield d, key, 1.0, k - int(offsets[d]), n

    def _look(self, lots: list[tuple[int, np.ndarray, np.ndarray]], least: float):
        """The same of some lots of hashed texts: (number of the first, all words, words of each). A group's tables serve all of them."""
        lots = [(at, flat, counts, np.cumsum([0, *counts])) for at, flat, counts in lots if len(flat)]
        for at, flat, _, offsets in lots:
            yield from ((at + k, *rest) for k, *rest in self._short(flat, offsets, least))
        if not lots or not self.groups:
            return
        votes = [self._votes(flat, offsets) for _, flat, _, offsets in lots]
        sums = [(_blocked_cumsum(_bits(flat, v), self.kind), _prefix(v)) for (_, flat, _, _), v in zip(lots, votes, strict=True)]
        spots: dict[tuple, list[int]] = defaultdict(list)  # by lot, text, size, group, item
        for n, (size, groups) in enumerate(self.groups):
            windows = [self._windows(size, self.strides[n], least * self.least_words[n], *lot[1:], *upto) for lot, upto in zip(lots, sums, strict=True)]
            for g, group in enumerate(groups if any(w is not None for w in windows) else ()):
                tables = group.tables(self.keep)
                for k, w in enumerate(windows):
                    if w is not None:
                        doc, start, prints = w
                        for at, item in group.search(prints, tables):
                            for d, s in zip(doc[at].tolist(), start[at].tolist(), strict=True):
                                spots[k, d, n, g, item].append(s)
        for (k, d, n, g, item), starts in sorted(spots.items()):
            first, flat, _, offsets = lots[k]
            size, it = self.groups[n][0], self.groups[n][1][g].items[item]
            slack = self.strides[n] + abs(size - len(it["h"])) + 1
            h = flat[offsets[d] : offsets[d + 1]]
            best, reach = (0.0, 0), -1
            for s in sorted(starts):
                low, high = max(s - slack, reach + 1), s + slack
                if low <= high:
                    found = self._best(it, h, low, high)
                    best = found if found[0] > best[0] + 1e-12 else best
                    reach = high
            if best[0] >= least:
                yield first + d, it["id"], round(best[0], 6), best[1], min(len(it["h"]), len(h))

    @staticmethod
    def _windows(size: int, stride: int, needed: float, flat: np.ndarray, counts: np.ndarray, offsets: np.ndarray, upto: np.ndarray, votes: np.ndarray | None):
        """(text, first word, fingerprint) of each window of a size in a lot of texts; None if there is none. A shorter text is looked at if it has the shingles needed."""
        room = counts - size
        n = np.where(room >= 0, room // stride + 1 + (room % stride > 0), (room < 0) & (counts > 0) & (np.maximum(counts - SPAN + 1, 1) >= needed - 1e-9))
        if not n.any():
            return None
        doc = np.repeat(np.arange(len(counts)), n)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = np.minimum(k * stride, np.maximum(room, 0)[doc])
        begin = offsets[doc] + start
        last = np.minimum(np.maximum(begin + np.minimum(size, counts[doc]) - 1, begin + 1), len(flat))
        return doc, start, _majority(upto, begin, last, votes)


def _shared(items: DataFrame) -> DataFrame:
    """(lot, s, f) of each shingle that f > 1 of all items hold, for each lot that holds it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(spans(hash_words(words(t)))) for t in batch["t"]]
            s = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pd.DataFrame({"lot": np.repeat(batch["lot"].to_numpy(), [len(x) for x in sets]), "s": s})

    held = items.select("lot", "t").mapInPandas(run, "lot int, s long")
    return held.groupBy("s").agg(F.count(F.lit(1)).alias("f"), F.collect_set("lot").alias("lots")).where("f > 1").select(F.explode("lots").alias("lot"), "s", "f")


def _lengths(items: DataFrame) -> dict[int, int]:
    """How many items have so many words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": [len(words(t)) for t in batch["t"]]}, dtype="int64")

    return {r["n"]: r["count"] for r in items.select("t").mapInPandas(run, "n long").groupBy("n").count().collect()}


def _lots(items: DataFrame, scratch: Scratch, radius: int = RADIUS) -> Iterator[tuple[Benchmark, bool]]:
    """The items (i, t), in lots of about LOT, and whether a lot is the last."""
    total = items.count()
    lots = max(1, -(-total // LOT))
    if lots == 1:
        yield Benchmark(sorted(((r["i"], r["t"]) for r in items.collect()), key=lambda x: (x[0] is None, x)), radius=radius, total=total), True
        return
    items = items.withColumn("lot", F.pmod(F.xxhash64("i", "t"), F.lit(lots)).cast("int"))
    shared, lengths = scratch.table(_shared(items), "shared"), _lengths(items)
    for lot in range(lots):
        rows = sorted(((r["i"], r["t"]) for r in items.where(F.col("lot") == lot).collect()), key=lambda x: (x[0] is None, x))
        f = shared.where(F.col("lot") == lot).select("s", "f").toArrow()
        frequency = dict(zip(f["s"].to_numpy().view(np.uint64).tolist(), f["f"].to_pylist(), strict=True))
        yield Benchmark(rows, frequency, total, lengths, radius), lot == lots - 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: float = LEAST, radius: int = RADIUS, scratch: Scratch | None = None) -> DataFrame:
    """(id, item_id, similarity, first_word, n_words) of each benchmark item found in each text. With several lots, each one's rows are written before the next is drawn up."""
    kind = f"{id} long, item_id long, similarity double, first_word long, n_words long"
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t"))
    scratch, parts = scratch or Scratch(docs.sparkSession), []
    for mine, last in _lots(items, scratch, radius):

        def run(batches: Iterator[pd.DataFrame], mine=mine) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keys = batch["i"].astype("Int64")
                found = list(mine.matches([t if isinstance(t, str) else None for t in batch["t"]], least))
                yield pd.DataFrame(
                    {id: keys.iloc[[f[0] for f in found]].array, "item_id": pd.array([f[1] for f in found], "Int64")}
                    | {n: [f[k] for f in found] for n, k in (("similarity", 2), ("first_word", 3), ("n_words", 4))}
                )
            give_back()

        part = docs.select(F.col(id).cast("long").alias("i"), F.col(text).alias("t")).mapInPandas(run, kind)
        parts.append(part if last else scratch.table(part, f"found{len(parts)}"))
    return reduce(DataFrame.unionByName, parts)


def _leaks(mine: Benchmark):
    @F.pandas_udf("boolean")
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros(len(batch), bool)
            out[[f[0] for f in mine.matches([t if isinstance(t, str) else None for t in batch])]] = True
            yield pd.Series(out)
        give_back()

    return leaks


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """docs without those that hold a benchmark item; rows are dropped in place, so nothing is shuffled. With several lots, what is left is written before the next is drawn up."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).alias("i"), F.col(item_text).alias("t"))
    scratch, kept = scratch or Scratch(docs.sparkSession), docs
    for k, (mine, last) in enumerate(_lots(items, scratch)):
        kept = kept.where(~_leaks(mine)(F.col(text)))
        if not last:
            kept = scratch.table(kept, f"clean{k}")
            if k:
                scratch.drop(f"clean{k - 1}")
    return kept
