"""Language-model scores: Katz backoff over Good-Turing discounted n-gram counts, exactly normalised.

A token's chance is D(c) / T of its n-gram's count c if that was seen in training, else the context's backoff weight times the
chance by the shorter context, and so on down to single words, where unseen words share one chance. D takes Good-Turing
discounts from counts up to FEW (each length has its own), T is the context's total, and a context's weight is what its
discounts leave, over what the shorter context leaves for words not seen here. Where a context's counts are all above FEW,
nothing would be left: its total is one more. So the chances of all known words and of one unknown word add up to 1 in every context.
Discounts that Good-Turing counts don't give (a count of counts is 0, or a discount leaves (0, 1)) come from a line through the
logarithms of the counts of counts; where that doesn't fall steeply enough, half a count is taken off.

How it runs. Documents are cut into lots of about LOT tokens, written as files of the shared folder with their words as codes. A lot
asks for each of its distinct n-grams once, by a 64-bit hash (``order`` lengths at a time), with how often its training documents hold
it; ranges of hashes are groups that Spark deals out evenly, however frequent a word is, since a lot names it only once. A group
adds counts up, writes them as a part of the model's table, and answers each lot. One lot owns each n-gram and reports it
to its context; sums by context (numbers of words by count, and by their count in the shorter context, all integers) make the
second table and the second answer. With both answers a lot evaluates its tokens. Nothing but twenty counts of counts reaches the
driver; tables, answers and traffic grow with the corpus. A stored model scores other documents the same way: its rows
join the lots' questions.

Words: A-Z lower-cased, runs of other characters than space and U+0009 to U+000D, then one end. Two n-grams with one
64-bit hash would be counted as one: with a billion of them, that happens to one pair in 37 corpora.

Edge cases: a null or empty text is the end alone; rows may repeat, and count and are answered each; a null ``train`` is false;
without training rows every token is the unknown word, with chance 1; an empty table gives an empty result; columns named like
results are replaced, others stay; a text longer than a lot is a lot of its own, so texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldloom.llm.common import Scratch, give_back, shared_files, small_batches, without
from fieldloom.llm.periodic import words_of
from fieldloom.llm.shingles import _MIX, _finish

#: Words of an n-gram in the registered query; counts up to this are discounted.
ORDER, FEW = 2, 5
#: Tokens of a lot; n-grams of a group, about; groups a length at least.
LOT, GROUP, GROUPS = 1 << 20, 1 << 20, 64
#: No word is empty or a space.
END, BEGIN = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"", b" "))
RESULT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ASK = "level int, bucket int, lot string, keys binary, counts binary"
_TOLD = "level int, bucket int, lot string, keys binary, counts binary, stats array<long>"


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed planes of their bytes."""
    v = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def discounts(n: list[int]) -> np.ndarray:
    """What stays of counts 0 to FEW (at 0: nothing) from the numbers of n-grams with counts 1 to FEW + 1."""
    r = np.arange(1, FEW + 1)

    def katz(m: np.ndarray) -> np.ndarray:
        common = (FEW + 1) * m[FEW] / m[0]
        return ((r + 1) * m[1 : FEW + 1] / (r * m[:FEW]) - common) / (1 - common)

    valid = lambda d: bool(np.all(np.isfinite(d)) and np.all(d > 0) and np.all(d < 1))
    n = np.array(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = katz(n)
    if not valid(d):
        some = np.flatnonzero(n > 0)
        slope = np.polyfit(np.log(some + 1.0), np.log(n[some]), 1)[0] if len(some) > 1 else 0.0
        d = katz(np.arange(1.0, FEW + 2) ** slope) if slope < -1 else 1 - 0.5 / r
        d = d if valid(d) else 1 - 0.5 / r
    return np.concatenate([[0.0], d])


@dataclass
class Model:
    """Tables of n-gram counts and of sums by context, parted by hash; ``stats`` of each length: numbers of n-grams with counts 1 to FEW + 1, of all, and the sum of counts."""

    order: int
    groups: int
    counts: DataFrame
    contexts: DataFrame
    stats: list[list[int]]

    @property
    def laws(self) -> list[np.ndarray]:
        return [discounts(s[: FEW + 1]) for s in self.stats]


class Lot:
    """The tokens of some documents: n-grams of each length as sorted distinct hashes, and where each token's are among them."""

    def __init__(self, words: np.ndarray, codes: np.ndarray, lengths: np.ndarray, order: int):
        n = len(codes)
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        inside = np.arange(n) - np.repeat(self.starts, lengths)  # words before a token in its document
        h = words[codes]
        self.keys, self.of, self.first = [], [], []  # of each length: hashes, each token's place among them, a token of each
        self.context_keys, self.context_of = [None], [None]
        back = [h]  # each token's word, the one before it, and so on
        for k in range(1, order):
            shifted = np.full(n, BEGIN)
            shifted[k:] = h[: max(0, n - k)]
            back.append(np.where(inside >= k, shifted, BEGIN))
        for k in range(1, order + 1):
            self._place(h if k == 1 else self._hash(back[:k][::-1]), self.keys, self.of, self.first)
            if k > 1:
                self._place(self._hash(back[1:k][::-1]), self.context_keys, self.context_of)

    @staticmethod
    def _hash(parts: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(parts[0]), np.uint64(len(parts)))
        for j, p in enumerate(parts):
            out = out + p * _MIX[j]
        return _finish(out)

    @staticmethod
    def _place(values: np.ndarray, keys: list, of: list, first: list | None = None) -> None:
        by = np.argsort(values)
        ordered = values[by]
        new = np.append(True, ordered[1:] != ordered[:-1]) if len(by) else np.zeros(0, bool)
        place = np.empty(len(by), np.int32)
        place[by] = np.cumsum(new, dtype=np.int32) - 1
        keys.append(ordered[new])
        of.append(place)
        if first is not None:
            first.append(by[new])


def _write(folder: str, name: str, rows: pa.RecordBatch, words: np.ndarray, codes: np.ndarray, lengths: np.ndarray, train: np.ndarray) -> None:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_batch(rows)
    parts = [sink.getvalue().to_pybytes(), words.tobytes(), pack(codes), pack(lengths), pack(train)]
    table = pa.table({"part": pa.array(parts, pa.large_binary())})
    files, path = shared_files(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)


def _read(folder: str, name: str, order: int) -> tuple[pa.RecordBatch, Lot, np.ndarray, np.ndarray]:
    """(rows, tokens, lengths, whether each document trains) of a lot."""
    files, path = shared_files(folder)
    with files.open_input_file(f"{path}/{name}") as source:
        parts = [p.as_py() for p in pa.ipc.open_file(source).read_all()["part"]]
    batches = list(pa.ipc.open_stream(parts[0]))
    lengths = unpack(parts[3]).astype(np.int64)
    return batches[0], Lot(np.frombuffer(parts[1], np.uint64), unpack(parts[2]).astype(np.int32), lengths, order), lengths, unpack(parts[4]) > 0


def _cut(docs: DataFrame, names: list[str], folder: str) -> DataFrame:
    """Writes documents (names..., text, train) as lots; (lot, tokens) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made: list[tuple[str, int]] = []
        held: list[tuple] = []
        total = 0

        def flush() -> None:
            nonlocal held, total
            if names:
                rows = pa.Table.from_batches([h[0] for h in held]).combine_chunks().to_batches()[0]
            else:  # no column is kept
                rows = pa.RecordBatch.from_arrays([pa.nulls(sum(len(h[3]) for h in held))], ["_"])
            words, codes = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True) if len(held) > 1 else (held[0][1], np.arange(len(held[0][1])))
            starts = np.concatenate([[0], np.cumsum([len(h[1]) for h in held])])
            codes = np.concatenate([codes[starts[k] : starts[k + 1]][h[2]] for k, h in enumerate(held)])
            # Codes in order of frequency are small and pack well.
            often = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[often] = np.arange(len(words))
            name = f"{part:06d}-{len(made):05d}"
            _write(folder, name, rows, words[often], rank[codes], np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held]))
            made.append((name, total))
            held, total = [], 0

        for batch in batches:
            offsets, codes, dictionary = words_of(pc.ascii_lower(batch.column(len(names))))
            spelled = dictionary.cast(pa.large_binary()).to_pylist()
            hashes = np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, spelled), np.uint64, len(spelled)), END)
            lengths = np.diff(offsets) + 1
            ended = np.insert(codes, offsets[1:], len(spelled))
            train = pc.fill_null(batch.column(len(names) + 1), False).to_numpy(zero_copy_only=False)
            bounds, at = np.concatenate([[0], np.cumsum(lengths)]), 0
            while at < len(lengths):  # whole documents, until a lot is full
                upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + LOT - total, "right")) - 1)
                rows = batch.select(range(len(names))).slice(at, upto - at)
                held.append((rows, hashes, ended[bounds[at] : bounds[upto]], lengths[at:upto], train[at:upto]))
                total += int(bounds[upto] - bounds[at])
                at = upto
                if total >= LOT or at < len(lengths):
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["lot", "tokens"])
        give_back()

    return docs.mapInArrow(run, "lot string, tokens long")


def _slices(keys: np.ndarray, groups: int) -> list[tuple[int, int, int]]:
    """(group, from, to) of sorted hashes: each group has an equal range."""
    step = (1 << 64) // groups + 1
    bounds = np.searchsorted(keys, np.array([g * step for g in range(groups)], np.uint64))
    ends = np.append(bounds[1:], len(keys))
    return [(g, int(a), int(b)) for g, (a, b) in enumerate(zip(bounds, ends, strict=True)) if b > a]


_ARROW = [("level", pa.int32()), ("bucket", pa.int32()), ("lot", pa.string()), ("keys", pa.binary()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))]


def _rows(columns: list[list]) -> pa.Table:
    """A table of _ASK, or with six columns of _TOLD."""
    fields = _ARROW[: len(columns)]
    return pa.table([pa.array(c, t) for (_, t), c in zip(fields, columns, strict=True)], names=[name for name, _ in fields])


def _asked(lot: str, level: int, keys: np.ndarray, columns: np.ndarray, groups: int, out: list[list]) -> None:
    for g, a, b in _slices(keys, groups):
        for column, value in zip(out, (level, g, lot, pack_sorted(keys[a:b]), pack(columns[:, a:b].reshape(-1))), strict=True):
            column.append(value)


def _questions(lots: DataFrame, folder: str, order: int, groups: int) -> DataFrame:
    """Each lot's distinct n-grams, with their number in its training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in batch.column(0).to_pylist():
                _, tokens, lengths, train = _read(folder, lot, order)
                counted = np.repeat(train, lengths)
                out: list[list] = [[] for _ in range(5)]
                for k in range(order):
                    seen = np.bincount(tokens.of[k][counted], minlength=len(tokens.keys[k]))
                    _asked(lot, k + 1, tokens.keys[k], seen[None], groups, out)
                yield from _rows(out).to_batches()
        give_back()

    return lots.select("lot").mapInArrow(run, _ASK)


def _gathered(table: pa.Table, width: int) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lots, bounds of their entries, distinct keys, place of each entry among them, columns of all entries) of a group's rows, in order of lots."""
    table = table.sort_by([("lot", "ascending")])
    lots = table["lot"].to_pylist()
    keys = [unpack_sorted(k.as_py()) for k in table["keys"]]
    columns = np.concatenate([unpack(c.as_py()).reshape(width, -1) for c in table["counts"]], 1).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    all_ = np.concatenate(keys)
    by = np.argsort(all_, kind="stable")
    new = np.append(True, all_[by][1:] != all_[by][:-1])
    place = np.empty(len(all_), np.int64)
    place[by] = np.cumsum(new) - 1
    return lots, bounds, all_[by][new], place, columns


def _counted(table: pa.Table) -> pa.Table:
    """A group's sums: a row of the model, and for each lot the count of each n-gram it asked for, doubled, plus one if it owns it."""
    level, bucket = table["level"][0].as_py(), table["bucket"][0].as_py()
    lots, bounds, keys, place, columns = _gathered(table, 1)
    sums = np.bincount(place, columns[0], len(keys)).astype(np.int64)
    seen = np.flatnonzero(columns[0] > 0)
    _, first = np.unique(place[seen], return_index=True)
    own = np.zeros(len(place), np.int64)
    own[seen[first]] = 1
    answer = sums[place] * 2 + own
    known = sums > 0
    stats = [*np.bincount(np.minimum(sums, FEW + 2), minlength=FEW + 3)[1 : FEW + 2].tolist(), int(known.sum()), int(sums.sum())]
    rows = [(level, bucket, None, pack_sorted(keys[known]), pack(sums[known]), stats)]
    rows += [(level, bucket, lot, None, pack(answer[a:b]), None) for lot, a, b in zip(lots, bounds[:-1], bounds[1:], strict=True) if lot is not None]
    return _rows([list(c) for c in zip(*rows, strict=True)])


#: Of a context: numbers of words with counts 1 to FEW, and the sum of larger counts; the same by their counts in the shorter context.
_SUMS = 2 * (FEW + 1)


def _summed(table: pa.Table) -> pa.Table:
    """A group's sums by context: a row of the model, and for each lot those of its contexts."""
    level, bucket = table["level"][0].as_py(), table["bucket"][0].as_py()
    lots, bounds, keys, place, columns = _gathered(table, _SUMS)
    sums = np.stack([np.bincount(place, c, len(keys)).astype(np.int64) for c in columns])
    known = sums.any(0)
    rows = [(level, bucket, None, pack_sorted(keys[known]), pack(sums[:, known].reshape(-1)), None)]
    rows += [(level, bucket, lot, None, pack(sums[:, place[a:b]].reshape(-1)), None) for lot, a, b in zip(lots, bounds[:-1], bounds[1:], strict=True) if lot is not None]
    return _rows([list(c) for c in zip(*rows, strict=True)])


def _answers(table: pa.Table, order: int, width: int) -> list[np.ndarray | None]:
    """The columns of each length, in the order of its keys."""
    table = table.sort_by([("level", "ascending"), ("bucket", "ascending")])
    parts: list[list[np.ndarray]] = [[] for _ in range(order)]
    for level, data in zip(table["level"].to_pylist(), table["counts"], strict=True):
        parts[level - 1].append(unpack(data.as_py()).reshape(width, -1).astype(np.int64))
    return [np.concatenate(p, 1) if p else None for p in parts]


def _reports(folder: str, order: int, groups: int):
    """What a lot tells its contexts, given the counts of its n-grams."""

    def run(table: pa.Table) -> pa.Table:
        lot = table["lot"][0].as_py()
        _, tokens, _, _ = _read(folder, lot, order)
        told = _answers(table, order, 1)
        out: list[list] = [[] for _ in range(5)]
        for k in range(1, order):
            mine = np.flatnonzero(told[k][0] & 1)
            sample = tokens.first[k][mine]  # a token of each n-gram that this lot owns
            context, n = tokens.context_of[k][sample], len(tokens.context_keys[k])
            columns = []
            for counts in (told[k][0][mine] >> 1, told[k - 1][0][tokens.of[k - 1][sample]] >> 1):
                columns += [np.bincount(context[counts == r], minlength=n) for r in range(1, FEW + 1)]
                columns.append(np.bincount(context[counts > FEW], counts[counts > FEW], n).astype(np.int64))
            _asked(lot, k + 1, tokens.context_keys[k], np.stack(columns), groups, out)
        return _rows(out)

    return run


def chances(tokens: Lot, counts: list[np.ndarray], contexts: list[np.ndarray | None], laws: list[np.ndarray], total: int, kinds: list[int]) -> np.ndarray:
    """Each token's chance. ``kinds``: numbers of single words with counts 1 to FEW, of which ``total`` tokens are a part."""
    r = np.arange(FEW + 1)
    keep = [np.append(law * r, 0.0) for law in laws]  # discounted counts 0 to FEW
    lost = [(1 - law[1:]) * r[1:] for law in laws]
    apart = float(np.dot(kinds, lost[0]))
    whole = total if apart > 0 else total + 1
    unknown = (apart if apart > 0 else 1.0) / whole

    def discounted(k: int, c: np.ndarray) -> np.ndarray:
        return np.where(c <= FEW, keep[k][np.minimum(c, FEW)], c)

    totals: list[np.ndarray] = [None] * len(counts)
    weights: list[np.ndarray] = [None] * len(counts)
    for k in range(1, len(counts)):
        s = contexts[k]
        left = lost[k] @ s[:FEW]
        seen = r[1:] @ s[:FEW] + s[FEW]
        totals[k] = np.where(left > 0, seen, seen + 1)
        below = keep[k - 1][1 : FEW + 1] @ s[FEW + 1 : 2 * FEW + 1] + s[2 * FEW + 1]
        if k == 1:
            shorter = whole
        else:  # the total of the context without its first word, which any token after the context tells
            token = np.empty(len(tokens.context_keys[k]), np.int64)
            token[tokens.context_of[k]] = np.arange(len(tokens.context_of[k]))
            shorter = totals[k - 1][tokens.context_of[k - 1][token]]
        weights[k] = np.where(seen > 0, np.where(left > 0, left, 1.0) / totals[k] / (1 - below / shorter), 1.0)

    def chance(k: int) -> np.ndarray:
        c = counts[k][tokens.of[k]]
        if k == 0:
            return np.where(c > 0, discounted(0, c) / whole, unknown)
        at = tokens.context_of[k]
        return np.where(c > 0, discounted(k, c) / totals[k][at], weights[k][at] * chance(k - 1))

    return chance(len(counts) - 1)


def _scores(folder: str, order: int, laws: list[np.ndarray], stats: list[list[int]], figures: list[str]):
    total, known_words = stats[0][-1], stats[0][-2]

    def run(table: pa.Table) -> pa.Table:
        rows, tokens, lengths, _ = _read(folder, table["lot"][0].as_py(), order)
        sums = pc.equal(table["kind"], 1)
        counts = [c[0] >> 1 for c in _answers(table.filter(pc.invert(sums)), order, 1)]
        contexts = _answers(table.filter(sums), order, _SUMS)
        by_token = np.log10(chances(tokens, counts, contexts, laws, total, stats[0][:FEW]))
        c = counts[0][tokens.of[0]]
        base = np.log10((c + 0.1) / (total + 0.1 * (known_words + 1)))
        add = lambda v: np.add.reduceat(v, tokens.starts)
        made = [lengths, add((c > 0).astype(np.int64)), np.full(len(lengths), total), add(base), add(by_token)]
        kept = rows.columns[: len(figures[: -len(made)])]
        return pa.Table.from_arrays([*kept, *map(pa.array, made)], figures)

    return run


def score(docs: DataFrame, train: Column | None = None, model: Model | None = None, text: str = "text", order: int = ORDER, scratch: Scratch | None = None) -> tuple[DataFrame, Model]:
    """(docs without its text, with figures of each text; the model).

    Learns from the rows where ``train`` holds, or, if a model is given, scores all rows by it. Figures: tokens, tokens known from training,
    training tokens, and log10 chances of the text by single words with 0.1 added to each count and by the model.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark)
    own = [f.name for f in StructType.fromDDL(RESULT).fields]
    kept = without(docs, text, *own)
    names = kept.columns
    learns = F.lit(False) if model is not None or train is None else train
    given = docs.select(*[kept[c] for c in names], docs[text].cast("string").alias("_katz_text"), learns.cast("boolean").alias("_katz_train"))
    order = model.order if model else order
    folder = scratch.folder("lots_files")
    lots = scratch.table(_cut(given, names, folder), "lots")
    tokens, number = lots.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    groups = model.groups if model else max(GROUPS, -(-tokens // GROUP))
    asked = _questions(lots.repartition(max(1, min(number, 10_000))), folder, order, groups)
    if model:
        asked = asked.unionByName(model.counts.select("level", "bucket", "lot", "keys", "counts"))
    told = scratch.table(asked.groupBy("level", "bucket").applyInArrow(_counted, _TOLD), "counts")
    stored = told.where("lot is null")
    if model is None:
        sums = {r["level"]: r["s"] for r in stored.groupBy("level").agg(F.array(*[F.sum(F.get("stats", k)) for k in range(FEW + 3)]).alias("s")).collect()}
        stats = [list(sums.get(k + 1) or [0] * (FEW + 3)) for k in range(order)]
    else:
        stats = model.stats
    answers = told.where("lot is not null").select("level", "bucket", "lot", "counts")
    reports = answers.groupBy("lot").applyInArrow(_reports(folder, order, groups), _ASK)
    if model:
        reports = reports.unionByName(model.contexts.select("level", "bucket", "lot", "keys", "counts"))
    contexts = scratch.table(reports.groupBy("level", "bucket").applyInArrow(_summed, _TOLD), "contexts")
    if model is None:
        model = Model(order, groups, stored, contexts.where("lot is null"), stats)
    both = answers.withColumn("kind", F.lit(0)).unionByName(contexts.where("lot is not null").select("level", "bucket", "lot", "counts").withColumn("kind", F.lit(1)))
    out = StructType([*kept.schema.fields, *StructType.fromDDL(RESULT).fields])
    return both.groupBy("lot").applyInArrow(_scores(folder, order, model.laws, stats, [*names, *own]), out), model
