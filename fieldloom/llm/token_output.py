"""Token ids in training order: a keyed Feistel permutation gives every sequence its place in fixed-stride shards.

A document's token ids are cut into sequences of LENGTH ids; the last one is padded. Sequence r of the document with id i
has the index (i - least id) * room + r, where room is the most sequences that the longest text can have, so an index
depends on the data alone, not on which task met it. A Feistel network over the least even number of bits that holds all indices,
keyed, and walked along its cycle until it lands inside the range, maps indices one to one to places in the same
range, so all the places are known in a single pass, without a count. Each shard takes an equal range of places; its rows are
sorted by place and written as raw little-endian unsigned 16-bit ids, 2 * LENGTH bytes each, so that sequence i of a
shard stands at byte i * 2 * LENGTH and a reader may start anywhere and read on. The global slot of a
sequence is the rank of its place: the sequences of the shards before, of which one count each is kept, plus its number in its own.
A shard is written under a name of its attempt and then renamed; a task that is run again leaves the same file.

Edge cases: a null or empty text has no sequence; an empty table gives an empty manifest; rows that share an id share its places,
and the order of their ids settles the tie, so each sequence still has a slot of its own; rows without an id stand for one more id; texts may be of
any length and other columns of any name. Ids that are no whole numbers (texts, say), or lie so far apart that their range times room exceeds
2^62 (hashes), are replaced by their ranks for the index, which takes a sort of the ids and a join; the manifest has the ids themselves.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from fieldloom.llm.bpe import cut, ragged
from fieldloom.llm.common import Scratch, give_back, join_sized, shared_files

#: Ids in a sequence, id that pads, words that a process keeps.
LENGTH, PAD, MOST_WORDS = 256, 50_256, 400_000
CHARS_AT_ONCE, ROUNDS = 1_000_000, 6


class Words:
    """Encodes texts by a lookup of their words; new words go to the tokenizer library."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        """Drops the kept words, as at a task's end."""
        self.of: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def _rows(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.of))
        if self.of and len(self.of) + len(new) > MOST_WORDS:
            self.forget()
            new = list(set(words))
        if new:
            one = self.encoding.encode_ordinary
            ids = [one(w) for w in new]
            self.of.update(zip(new, range(len(self.of), len(self.of) + len(new)), strict=True))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), np.uint16, int(sizes.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return np.fromiter(map(self.of.__getitem__, words), np.int64, len(words))

    def batches(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of words, ids of each word, words before each text) of lots of texts."""
        at = 0
        while at < len(texts):
            stop, held = at, 0
            while stop < len(texts) and (stop == at or held + len(texts[stop]) <= CHARS_AT_ONCE):
                held += len(texts[stop])
                stop += 1
            words, counts = cut(texts[at:stop])
            rows = self._rows(words)
            yield rows, self.ends[rows + 1] - self.ends[rows], np.concatenate([[0], np.cumsum(counts)])
            at = stop

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for rows, sizes, upto in self.batches(texts):
            ids = self.ids[ragged(self.ends[rows], sizes)]
            upto = np.concatenate([[0], np.cumsum(sizes)])[upto]
            for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                yield ids[a:b]


@lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots in [0, n) of indices in [0, n), one to one."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low, bits = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") for r in range(ROUNDS)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        a, b = x >> bits, x & low
        for k in keys:
            a, b = b, a ^ (_mix(b, k) & low)
        out[todo] = a << bits | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _numbered(ids: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """((key, number) of each distinct id, numbers from 0 on in the ids' order; how many there are). Ids are dealt by range; a row for each range reaches the driver."""
    spark = ids.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = ids.where("id is not null").distinct().repartitionByRange(parts, "id").sortWithinPartitions("id").select(F.col("id").alias("key"), F.monotonically_increasing_id().alias("at"))
    placed = scratch.table(placed, "placed").select("key", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("within"))
    before, total = [], 0
    for r in sorted(placed.groupBy("range").count().collect()):
        before.append((r["range"], total))
        total += r["count"]
    starts = spark.createDataFrame(before, "range long, before long")
    return join_sized(placed, starts, "range", "inner", len(before)).select("key", (F.col("before") + F.col("within")).alias("number")), total


def materialise(docs: DataFrame, vocabulary: str, out: str | None = None, key: int = 20_240_229, id: str = "doc_id", text: str = "text", length: int = LENGTH, shards: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Writes shards (by default as many as the input has partitions) to ``out``, a folder that all machines share; by default a new one in the shared folder.

    Returns the manifest: slot, doc_id, part (number of the sequence in its document), n_tokens, shard,
    byte_offset and sha256 of the sequence's bytes.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    out = out or scratch.path("shards")
    whole = isinstance(docs.schema[id].dataType, IntegralType)
    rows = docs.select((F.col(id).cast("long") if whole else F.col(id)).alias("id"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["id"]
    shards = shards or max(1, rows.rdd.getNumPartitions())
    low, high, longest = rows.agg(*([F.min("id"), F.max("id")] if whole else [F.lit(0), F.lit(0)]), F.max(F.octet_length("t"))).first()
    low, high, room = low or 0, high or 0, max(1, -(-(longest or 0) // length))  # a token has a byte at least
    if whole and (high - low + 2) * room <= 1 << 62:
        rows = rows.withColumn("n", F.col("id") - low)
    else:  # ids that are no whole numbers, or lie too far apart
        numbers, count = _numbered(rows.select("id"), scratch)
        rows = join_sized(rows, numbers, F.col("id") == F.col("key"), "left", count).select("id", "t", F.col("number").alias("n"))
        low, high = 0, count - 1
    space = (high - low + 2) * room  # with one more for rows without an id
    if space > 1 << 62:
        raise ValueError(f"{high - low + 1} ids with up to {room} sequences each are too many for 62 bits")
    # Ids go through Python as texts, since pandas would round large numbers among nulls; rows without one have the last number.
    rows = rows.select(F.col("id").cast("string").alias("id"), "t", F.coalesce("n", F.lit(high - low + 1)).cast("long").alias("n"))

    def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["t"]]
            keys = batch["id"].to_numpy(object)
            first = batch["n"].to_numpy(np.int64) * room
            lot: list[tuple] = []
            for k, ids in enumerate(words(vocabulary).encode(texts)):
                raw = ids.astype("<u2").tobytes()
                lot += [(k, j // (2 * length), raw[j : j + 2 * length]) for j in range(0, len(raw), 2 * length)]
                if len(lot) >= 8192 or k == len(texts) - 1 and lot:
                    row, part = np.array([x[0] for x in lot]), np.array([x[1] for x in lot])
                    place = permute(first[row] + part, space, key)
                    yield pd.DataFrame({"place": place, "shard": np.minimum(place / space * shards, shards - 1).astype(np.int32), "id": keys[row], "part": part, "ids": [x[2] for x in lot]})
                    lot = []
        words(vocabulary).forget()
        give_back()

    dealt = rows.mapInPandas(sequences, "place long, shard int, id string, part long, ids binary")
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "place", "ids")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = shared_files(out)
        system.create_dir(folder, recursive=True)
        shard, stream, name, number = -1, None, "", 0
        pad = np.uint16(PAD).astype("<u2").tobytes()

        def close() -> None:
            if stream is not None:
                stream.close()
                system.move(name, f"{folder}/shard-{shard:08d}.bin")

        try:
            for batch in batches:
                full = [b + pad * (length - len(b) // 2) for b in batch["ids"]]
                numbers = np.zeros(len(batch), np.int64)
                of = batch["shard"].to_numpy()
                for s in np.unique(of).tolist():
                    lot = np.flatnonzero(of == s)
                    if s != shard:
                        close()
                        shard, name, number = s, f"{folder}/.{s:08d}-{uuid.uuid4().hex}", 0
                        stream = system.open_output_stream(name)
                    stream.write(b"".join(full[i] for i in lot))
                    numbers[lot] = number + np.arange(len(lot))
                    number += len(lot)
                yield pd.DataFrame(
                    {
                        "number": numbers,
                        id: batch["id"],
                        "part": batch["part"],
                        "n_tokens": [len(b) // 2 for b in batch["ids"]],
                        "shard": of.astype(np.int64),
                        "sha256": [hashlib.sha256(b).hexdigest() for b in full],
                    }
                )
            close()
            stream = None
        finally:
            if stream is not None and not stream.closed:
                stream.close()

    written = scratch.table(dealt.mapInPandas(write, f"number long, {id} string, part long, n_tokens long, shard long, sha256 string"), "written")
    counts = written.groupBy("shard").agg(F.max("number").alias("last"))
    before, rows_before = [], 0
    for r in sorted(counts.collect()):  # one row a shard
        before.append((r["shard"], rows_before))
        rows_before += r["last"] + 1
    starts = docs.sparkSession.createDataFrame(before, "shard long, before long")
    found = join_sized(written, starts, "shard", "inner", len(before))
    return found.select((F.col("before") + F.col("number")).alias("slot"), F.col(id).cast(kind).alias(id), "part", "n_tokens", "shard", (F.col("number") * 2 * length).alias("byte_offset"), "sha256")


def read_shard(out: str, shard: int, start: int = 0, length: int = LENGTH) -> np.ndarray:
    """Sequences of a shard from number ``start`` on, (n, length), without reading what stands before."""
    system, folder = shared_files(out)
    with system.open_input_file(f"{folder}/shard-{shard:08d}.bin") as f:
        f.seek(start * 2 * length)
        return np.frombuffer(f.read(), "<u2").reshape(-1, length)
