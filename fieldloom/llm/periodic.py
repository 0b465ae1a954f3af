"""Periodic runs of words, found with the branching tandem repeats of a suffix tree (Stoye and Gusfield).

A run is a stretch of consecutive words with smallest period q and a length of at least max(least, times * q) that no
neighbouring word extends with period q. Texts are handled a batch at a time, without a shuffle: the suffixes of all texts of a
batch are sorted together by prefix doubling, each text's first words apart from every other text's, so that the tree of
the batch is a forest of the texts' suffix trees. Its inner nodes are intervals of the sorted suffixes (their leaf lists)
with a string depth; children are what lies between a node's places of least common prefix.

Of each node with depth d the leaf lists of all children but the largest are gone through: a leaf i and i + d (or i - d)
in the node's leaf list, followed by different words, are a branching tandem repeat, which ends where a run of period d
ends. Each leaf is listed once a level of halving, n log n in all. Repeats are rotated to the left as long as the words
agree, which gives the whole run; those of multiples of a period fall on the run of the period and are merged with it.

Edge cases: a text that is null or has no words has no runs and collapses to the empty text; a null id is like any
other; repeated rows are answered each; an empty table gives an empty result; columns named like results are replaced, others
stay; texts of any length are read whole (about 300 bytes of memory a word). A row's runs don't depend on its batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from fieldloom.llm.common import give_back, without

#: A run has so many words, and so many times its period, at least.
LEAST, TIMES = 24, 3
RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets of each text's words, code of each word, words by code) of an array of texts; words are runs of other characters than space and U+0009 to U+000D."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at an end of a text leaves an empty piece there
        text_of = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(text_of[full], minlength=len(counts))
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def suffix_order(codes: np.ndarray, text_of: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each suffix, common prefix of each with the one before) of texts laid end to end.

    A suffix ends with its text; suffixes of different texts have no common prefix. ``ends``: for each place, where its text ends.
    """
    n = len(codes)
    first = text_of * (int(codes.max()) + 1) + codes
    order = np.argsort(first)
    new = np.empty(n, bool)
    new[0], new[1:] = True, first[order[1:]] != first[order[:-1]]
    apart = np.where(new, 0, -1).astype(np.int8)  # the round in which a suffix came apart from the one before it
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    levels, step, k = [rank.astype(np.int32 if n < 1 << 31 else np.int64)], 1, 0
    open_ = ~new
    open_[:-1] |= ~new[1:]
    todo = np.flatnonzero(open_)  # places of the order in groups of two or more
    while len(todo):
        at = order[todo]
        after = at + step
        inside = after < ends[at]
        nxt = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + nxt
        by = np.argsort(key)
        order[todo] = at[by]
        key = key[by]
        k += 1
        fresh = np.empty(len(todo), bool)
        fresh[0], fresh[1:] = True, key[1:] != key[:-1]
        came = fresh & (apart[todo] < 0)
        apart[todo[came]] = k
        group = np.maximum.accumulate(np.where(fresh, todo, 0))
        rank[order[todo]] = group
        levels.append(rank.astype(levels[0].dtype))
        step *= 2
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        todo = todo[~alone]
    # Pairs that came apart in round k agree in at least 2^(k-1) words; what is more is found by halving steps.
    lcp = np.zeros(n, np.int64)
    a, b = np.empty(n, np.int64), order.copy()
    a[0], a[1:] = order[0], order[:-1]
    for level in range(int(apart.max()) - 1, -1, -1):
        pairs = np.flatnonzero(apart > level)
        x, y = a[pairs], b[pairs]
        room = np.maximum(x, y) < n  # past a text's end is the next text, whose ranks differ from all of this one's
        pairs, x, y = pairs[room], x[room], y[room]
        pairs = pairs[levels[level][x] == levels[level][y]]
        lcp[pairs] += 1 << level
        a[pairs] += 1 << level
        b[pairs] += 1 << level
    return order, rank, lcp


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place with a value above 0 the nearest place before it with a smaller one, by following pointers of all such places at once; -1 if there is none."""
    at = np.arange(-1, len(values) - 1)
    todo = np.flatnonzero(values > 0)
    todo = todo[at[todo] >= 0]
    while len(todo):
        todo = todo[values[at[todo]] >= values[todo]]
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
    return at


def branching_repeats(codes: np.ndarray, order: np.ndarray, rank: np.ndarray, lcp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of each tandem repeat that another word follows than would continue it."""
    n = len(codes)
    inner = np.flatnonzero(lcp > 0)
    if not len(inner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = _smaller_before(lcp)
    right = n - 1 - _smaller_before(lcp[::-1])[::-1]  # the first place after with a smaller common prefix, n if there is none
    # A node is an interval of leaves [left, right); its places of least common prefix part its children.
    lo, hi = left[inner], right[inner]
    by = np.argsort(lo * (n + 1) + hi, kind="stable")
    cut, lo, hi = inner[by], lo[by], hi[by]
    head = np.empty(len(cut), bool)
    head[0], head[1:] = True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    last = np.empty(len(cut), bool)
    last[-1], last[:-1] = True, head[1:]
    # Children: from each cut to the next one or the node's end, and the first from the node's begin to its first cut.
    node = np.cumsum(head) - 1
    depth, node_lo, node_hi = lcp[cut[head]], lo[head], hi[head]
    cut_to = np.where(last, hi, np.append(cut[1:], 0))
    first_size, cut_size = cut[head] - node_lo, cut_to - cut
    most = np.maximum(first_size, np.maximum.reduceat(cut_size, np.flatnonzero(head)))
    # The largest child of each node is left out: its first one if that has the most leaves, else the first cut's that has.
    largest = np.flatnonzero((cut_size == most[node]) & (first_size < most)[node])
    largest = largest[np.append(True, node[largest][1:] != node[largest][:-1])] if len(largest) else largest
    rest = np.ones(len(cut), bool)
    rest[largest] = False
    firsts = np.flatnonzero(first_size < most)
    child_from = np.concatenate([node_lo[firsts], cut[rest]])
    child_node = np.concatenate([firsts, node[rest]])
    size = np.concatenate([first_size[firsts], cut_size[rest]])
    starts, periods = [], []
    bounds = np.concatenate([[0], np.cumsum(size)])
    block = 0
    while block < len(size):  # leaves of all but the largest children, a few million at a time
        upto = max(block + 1, int(np.searchsorted(bounds, bounds[block] + (1 << 21), "right")) - 1)
        many = size[block:upto]
        leaf = order[np.repeat(child_from[block:upto] - (bounds[block:upto] - bounds[block]), many) + np.arange(int(many.sum()))]
        of = np.repeat(child_node[block:upto], many)
        d, low, high = depth[of], node_lo[of], node_hi[of]
        for other, first in ((leaf + d, leaf), (leaf - d, leaf - d)):
            place = rank[np.clip(other, 0, n - 1)]
            ok = (other >= 0) & (other < n) & (place >= low) & (place < high)
            i, p = first[ok], d[ok]
            second, third = i + p, i + 2 * p  # a text's end differs from every word
            differ = (third >= ends[i]) | (codes[np.minimum(second, n - 1)] != codes[np.minimum(third, n - 1)])
            starts.append(i[differ])
            periods.append(p[differ])
        block = upto
    return np.concatenate(starts), np.concatenate(periods)


def _agreeing(codes: np.ndarray, i: int, period: int, floor: int) -> int:
    """How many words before i, down to floor, equal those a period later; compared in growing pieces."""
    count, piece = 0, 64
    while i - count > floor:
        take = min(piece, i - count - floor)
        at = i - count
        same = codes[at - take : at] == codes[at - take + period : at + period]
        if same.all():
            count, piece = count + take, piece * 2
        else:
            return count + int(np.argmin(same[::-1]))
    return count


def runs_of(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start in the text, length, period) of all runs of texts laid end to end, in this order's order by text, start and period."""
    none = np.zeros((0, 4), np.int64)
    if len(codes) == 0:
        return none
    counts = np.diff(offsets)
    text_of = np.repeat(np.arange(len(counts)), counts)
    ends, begins = np.repeat(offsets[1:], counts), np.repeat(offsets[:-1], counts)
    order, rank, lcp = suffix_order(codes, text_of, ends)
    start, period = branching_repeats(codes, order, rank, lcp, ends)
    # Rotations that a run of the least length needs; most repeats fail one of the first, or the last of them.
    need = np.maximum(least - 2 * period, (times - 2) * period)
    far = start - need >= begins[start]
    start, period, need = start[far], period[far], need[far]
    for back in (1, 2, 3, 5, None):
        step = need if back is None else np.minimum(back, need)
        same = (step <= 0) | (codes[start - step] == codes[start - step + period])
        start, period, need = start[same], period[same], need[same]
    found: dict[tuple[int, int], int] = {}
    by_end: dict[int, list[tuple[int, int]]] = {}
    for k in np.lexsort((period, start + 2 * period)):
        i, p = int(start[k]), int(period[k])
        end = i + 2 * p
        if any(p % q == 0 and s <= i for q, s in by_end.get(end, ())):
            continue  # a multiple of a period whose run covers it
        begin = i - _agreeing(codes, i, p, int(begins[i]))
        by_end.setdefault(end, []).append((p, begin))
        if end - begin >= max(least, times * p):
            found[begin, end] = min(p, found.get((begin, end), p))
    if not found:
        return none
    rows = np.array([(text_of[s], s - begins[s], e - s, p) for (s, e), p in found.items()], np.int64)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def kept_words(n: int, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which of n words stay: those in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    base = offsets[rows[:, 0]] + rows[:, 1]
    np.add.at(change, base + rows[:, 3], 1)
    np.add.at(change, base + rows[:, 2], -1)
    return np.cumsum(change[:-1]) == 0


def _joined(codes: np.ndarray, offsets: np.ndarray, dictionary: pa.Array) -> pa.Array:
    """Each text's words, joined by one space; texts beyond the 2 GB of an Arrow array of plain strings are joined one by one."""
    sizes = pc.binary_length(dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(codes) + int(sizes[codes].sum()) < 1 << 31:
        words = dictionary.cast(pa.string()).take(pa.array(codes))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words), " ")
    return pa.array([" ".join(dictionary.take(pa.array(codes[a:b])).to_pylist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.large_string())


def longest_exponent(rows: np.ndarray) -> tuple[int, int, int]:
    """(start, length, period) of the run with the greatest length over period; of equal ones the smallest start, then period."""
    best = rows[0]
    for r in rows[1:]:  # in order of start and period, so that only a greater one wins
        if int(r[2]) * int(best[3]) > int(best[2]) * int(r[3]):
            best = r
    return int(best[1]), int(best[2]), int(best[3])


def plant(codes: np.ndarray, offsets: np.ndarray, a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Codes after each word i >= a of a text has become word a + (i - a) % p; texts with p = 0 stay."""
    counts = np.diff(offsets)
    hit = np.repeat(p > 0, counts)
    begin, from_, per = (np.repeat(v, counts)[hit] for v in (offsets[:-1], a, p))
    i = np.flatnonzero(hit) - begin
    source = np.where(i >= from_, from_ + (i - from_) % np.maximum(per, 1), i)
    out = codes.copy()
    out[hit] = codes[begin + source]
    return out


def detect(docs: DataFrame, text: str = "text", crc: Column | None = None, least: int = LEAST, times: int = TIMES, collapsed: bool = False) -> DataFrame:
    """docs without its text, with the figures of each text's runs; the text without repeated periods on demand (``collapsed``, words joined by a space).

    ``crc``: an unsigned number of each row; of those that end in 0 the text is made periodic from a place on before it
    is looked at, as a planted case: with g = crc / 10 and n words, from word a = g % n on with period 1 + (n - a) / (3 + g % 8).
    """
    own = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
    kept = without(docs, text, *own)
    names = kept.columns
    given = docs.select(*[kept[c] for c in names], docs[text].alias("_periodic_text"), (F.lit(None) if crc is None else crc).cast("long").alias("_periodic_crc"))
    schema = f"{RESULT}, runs array<struct<start:long,length:long,period:long>>" + (", collapsed string" if collapsed else "")
    made = StructType.fromDDL(schema)
    out = StructType([*kept.schema.fields, *made.fields])
    types = [to_arrow_type(f.dataType) for f in made.fields]
    figures = [f.name for f in made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, codes, dictionary = words_of(batch.column(len(names)))
            n = np.diff(offsets)
            seed = pc.fill_null(batch.column(len(names) + 1), 1).to_numpy(zero_copy_only=False)
            g, on = seed // 10, (seed % 10 == 0) & (n > 0)
            a = np.where(on, g % np.maximum(n, 1), 0)
            codes = plant(codes, offsets, a, np.where(on, 1 + (n - a) // (3 + g % 8), 0))
            rows = runs_of(codes, offsets, least, times)
            stay = kept_words(len(codes), rows, offsets)
            left = np.concatenate([[0], np.cumsum(stay)])[offsets]
            joined = _joined(codes[stay], left, dictionary)
            at = np.searchsorted(rows[:, 0], np.arange(len(n) + 1))
            table: dict[str, list] = {f: [] for f in figures}
            for k in range(len(n)):
                mine = rows[at[k] : at[k + 1]]
                top = longest_exponent(mine) if len(mine) else None
                table["n_runs"].append(len(mine))
                for name, value in zip(("start", "length", "period"), top or (None,) * 3, strict=True):
                    table[name].append(value)
                table["exponent_milli"].append(1000 * top[1] // top[2] if top else None)
                listed = "".join(f"{s},{length},{q}\n" for _, s, length, q in mine.tolist())
                table["runs_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
                table["collapsed_sha256"].append(hashlib.sha256(joined[k].as_buffer()).hexdigest())
                table["runs"].append([{"start": s, "length": length, "period": q} for _, s, length, q in mine.tolist()])
            if collapsed:
                table["collapsed"] = joined
            columns = [pa.array(v, t) if isinstance(v, list) else v.cast(t) for v, t in zip(table.values(), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], [*names, *figures])
        give_back()

    return given.mapInArrow(run, out)

