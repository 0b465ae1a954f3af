"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

Texts are cut into words as the tokenizer's pattern does (checked against it in the tests), but with array
operations on code-point classes. The distinct words of a batch that the process has not met yet are rows
(word, list of ids); a recursive query turns them into token-position rows, joins neighbours with the merge
table, contracts each word's leftmost pair of least rank, and ends when no word has a pair left. A document's ids are then a
lookup of its words. Decoding joins each document's own ids with the vocabulary and aggregates the tokens' bytes in order of position.

Long words are first cut between bytes that no token of the vocabulary spans. What is still long goes to a query that
contracts all of a word's pairs of the least rank in one step, from the left, up to the first that makes a pair which ranks before
it, so that the result is that of one contraction after the other. So a word of a megabyte takes a number of steps that depends on the ranks in it.

No shuffle; memory is bounded by the batch and by MOST_WORDS kept words, which a task drops at its end; DuckDB never writes to disk. Edge
cases: null is the empty text, which has no ids and decodes to no bytes; words of any length go the same way; repeated rows get equal
results; leftmost goes first where ranks tie; an empty table gives an empty result; columns named like results are replaced, others stay.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import give_back, without

#: Words kept by a process between batches; words given to one recursive query; characters cut at once.
MOST_WORDS, WORDS_AT_ONCE, CHARS_AT_ONCE = 250_000, 10_000, 500_000
#: Ids decoded at once; bytes from which a word is cut, and from which a piece goes to the query for long ones.
IDS_AT_ONCE, CUT_FROM, LONG = 200_000, 48, 96
LETTER, NUMBER, OTHER, SPACE, GAP = range(5)

RECURSION = """
with recursive state(w, ids) using key (w) as (
  select w, ids from words
  union all
  select s.w, s.ids[: b.spot - 1] || [b.rank] || s.ids[b.spot + 2 :]
  from state s join (
    select w, (min((rank::bigint << 32) | spot) & 4294967295)::int as spot, (min((rank::bigint << 32) | spot) >> 32)::int as rank
    from (select w, unnest(ids[:-2]) as l, unnest(ids[2:]) as r, generate_subscripts(ids[2:], 1) as spot from state) p
    join merges m on m.pair = ((p.l::bigint << 32) | p.r)
    group by w) b using (w))
select w, ids from state order by w
"""
LONG_RECURSION = """
with recursive state(w, ids) using key (w) as (
  select w, ids from words
  union all
  select t.w, list(coalesce(a.rank, t.id) order by t.spot)
  from (select w, unnest(ids) as id, generate_subscripts(ids, 1) as spot from state) t
  semi join (select distinct w from (select w, unnest(ids[:-2]) as l, unnest(ids[2:]) as r from state) p join merges m on m.pair = ((p.l::bigint << 32) | p.r)) pairs on pairs.w = t.w
  left join ({chosen}) a on a.w = t.w and a.spot = t.spot
  left join ({chosen}) b on b.w = t.w and b.spot + 1 = t.spot
  where b.spot is null
  group by t.w)
select w, ids from state order by w
"""
#: Of each word's pairs of the least rank: in a row of overlapping ones every other, up to the first whose new token makes a pair that ranks before it.
CHOSEN = """
  select w, spot, rank from (
    select w, spot, rank, row_number() over (partition by w, run order by spot) as k, coalesce(sum(early) over (partition by w order by spot rows between unbounded preceding and 1 preceding), 0) as earlier
    from (select c.w, c.spot, c.rank, c.spot - row_number() over (partition by c.w order by c.spot) as run, coalesce(least(x.rank, y.rank, z.rank) < c.rank, false)::int as early
      from (select w, spot, rank, before, after from (
          select w, spot, m.rank, before, after, min(m.rank) over (partition by w) as least
          from (select *, lag(l) over (partition by w order by spot) as before, lead(r) over (partition by w order by spot) as after
            from (select w, unnest(ids[:-2]) as l, unnest(ids[2:]) as r, generate_subscripts(ids[2:], 1) as spot from state)) p
          join merges m on m.pair = ((p.l::bigint << 32) | p.r))
        where rank = least) c
      left join merges x on x.pair = ((c.before::bigint << 32) | c.rank)
      left join merges y on y.pair = ((c.rank::bigint << 32) | c.after)
      left join merges z on z.pair = ((c.rank::bigint << 32) | c.rank)))
  where earlier = 0 and k % 2 = 1"""
#: The connection has one thread, so that the rows reach the aggregation in their order. A letter stands for a byte.
DECODE = """
select k, string_agg(letters, '') as letters
from (select k, spot, letters from (select k, unnest(ids) as id, generate_subscripts(ids, 1) as spot from coded) t join vocabulary using (id) order by k, spot)
group by k order by k
"""


@lru_cache(1)
def char_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point, as the pattern's classes have them."""
    import regex

    of = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(name, every):
            for at in (ord(every[m.start()]), ord(every[m.end() - 1])):
                of[at] = kind
            of[[ord(c) for c in m.group()]] = kind
    return of


def cut(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of all texts and the number of words of each, as the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` finds them."""
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    gaps = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind = char_classes()[code]
    kind[gaps] = GAP
    before = np.empty_like(kind)
    before[0], before[1:] = GAP, kind[:-1]
    after = np.empty_like(kind)
    after[-1], after[:-1] = GAP, kind[1:]
    blank = np.zeros(len(kind), bool)  # is the character before a plain space that this run takes along?
    blank[1:] = (code[:-1] == 32) & (kind[:-1] == SPACE)
    starts = np.where(kind < SPACE, (kind != before) & ~blank, (kind != before) | (kind == SPACE) & (after < SPACE))

    at = np.flatnonzero((code == 39) & (before != OTHER) & ~blank & (after == LETTER))
    if len(at):
        ahead = np.concatenate([code, np.zeros(3, np.uint32)])
        one, two = ahead[at + 1], ahead[at + 2]
        long = (one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)
        size = np.where(np.isin(one, [115, 116, 109, 100]), 2, np.where(long, 3, 0))
        at, size = at[size > 0], size[size > 0]
        starts[at + 1] = False
        starts[at + size] = True
    places = np.flatnonzero(starts | (kind == GAP))
    upto = np.searchsorted(places, gaps)  # words of this text and those before, with the gaps before
    ends = np.append(places[1:], len(joined))
    word = kind[places] != GAP
    counts = np.diff(upto, prepend=-1) - 1
    return [joined[a:b] for a, b in zip(places[word].tolist(), ends[word].tolist(), strict=True)], counts


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at ``starts`` and are ``sizes`` long, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Codec:
    """One vocabulary: its ranks, a DuckDB connection with merge and vocabulary tables, and the words that the task has met."""

    def __init__(self, path: str):
        import duckdb
        import pyarrow as pa

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = [
            (self.ranks[t[:k]] << 32 | self.ranks[t[k:]], rank)
            for t, rank in self.ranks.items()
            for k in range(1, len(t))
            if t[:k] in self.ranks and t[k:] in self.ranks
        ]
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self._spans()
        # A word is small and many words are asked about at once: one thread, no files.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        merges = pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "rank": pa.array([r for _, r in pairs], pa.int32())})
        vocabulary = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "letters": [t.decode("latin-1") for t in self.ranks]})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", table)
            self.db.execute(f"create table {name} as select * from given")
            self.db.unregister("given")
        self.forget()

    def _spans(self) -> None:
        """What tokens hold: which two bytes are a token, and which three follow each other in one."""
        two = [t for t in self.ranks if len(t) == 2]
        three = {t[k : k + 3] for t in self.ranks for k in range(len(t) - 2)}
        self.two, self.three = np.zeros(1 << 16, bool), np.zeros(1 << 21, np.uint8)  # the second by bits
        self.two[[t[0] << 8 | t[1] for t in two]] = True
        at = np.array([t[0] << 16 | t[1] << 8 | t[2] for t in three], np.int64)
        np.bitwise_or.at(self.three, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def pieces(self, word: bytes) -> list[bytes]:
        """A word, cut wherever no token can span the cut: one that does is two bytes long or holds three that span it."""
        b = np.frombuffer(word, np.uint8).astype(np.int64)
        at = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        three = (self.three[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        whole = self.two[b[:-1] << 8 | b[1:]]  # of the cut after each byte but the last
        whole[:-1] |= three
        whole[1:] |= three
        cuts = [0, *(np.flatnonzero(~whole) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def forget(self) -> None:
        """Drops the kept words, as at a task's end: the process may go on to other work."""
        self.words: dict[str, int] = {}
        self.ids, self.id_ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _ask(self, query: str, name: str, table):
        self.db.register(name, table)
        out = self.db.sql(query).to_arrow_table().combine_chunks()
        self.db.unregister(name)
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where each word's end (after a 0)."""
        raw = [[b] if len(b) < CUT_FROM or b in self.ranks else self.pieces(b) for b in (w.encode("utf-8") for w in words)]
        upto = np.concatenate([[0], np.cumsum([len(p) for p in raw])])
        flat = [b for p in raw for b in p]
        far = np.array([len(b) >= LONG for b in flat], bool)
        if not far.any():
            ids, ends = self._contracted(flat, RECURSION)
            return ids, ends[upto]
        near, near_ends = self._contracted([b for b, f in zip(flat, far, strict=True) if not f], RECURSION)
        long, long_ends = self._contracted([b for b, f in zip(flat, far, strict=True) if f], LONG_RECURSION.format(chosen=CHOSEN))
        sizes, starts = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
        for which, ends, shift in ((~far, near_ends, 0), (far, long_ends, len(near))):
            sizes[which], starts[which] = np.diff(ends), ends[:-1] + shift
        return np.concatenate([near, long])[ragged(starts, sizes)], np.concatenate([[0], np.cumsum(sizes)])[upto]

    def _contracted(self, raw: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """The same of words or pieces of them, by one recursive query."""
        import pyarrow as pa

        whole = np.array([self.ranks.get(b, -1) for b in raw], np.int32)  # a word that is a token is that token
        sizes = np.where(whole >= 0, 1, [len(b) for b in raw])
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat, single = np.empty(ends[-1], np.int32), np.zeros(ends[-1], bool)
        single[ends[:-1][whole >= 0]] = True
        flat[single] = whole[whole >= 0]
        flat[~single] = self.bytes[np.frombuffer(b"".join([b for b, r in zip(raw, whole.tolist(), strict=True) if r < 0]), np.uint8)]
        lists = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(flat))
        done = self._ask(query, "words", pa.table({"w": np.arange(len(raw), dtype=np.int32), "ids": lists})).column("ids")
        done = done.chunk(0) if done.num_chunks else pa.array([], pa.list_(pa.int32()))
        offsets = done.offsets.to_numpy().astype(np.int64)
        return done.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of sequences of ids, given one after the other, and where each one's end (after a 0); one longer than IDS_AT_ONCE is decoded in parts."""
        parts = sorted({*ends.tolist(), *range(0, int(ends[-1]), IDS_AT_ONCE)})
        out, at = [], 0
        while at < len(parts) - 1:
            stop = at + 1
            while stop < len(parts) - 1 and parts[stop + 1] - parts[at] <= IDS_AT_ONCE:
                stop += 1
            out += self._decoded(ids[parts[at] : parts[stop]], np.array(parts[at : stop + 1]) - parts[at])
            at = stop
        place = np.searchsorted(parts, ends).tolist()
        return [b"".join(out[i:j]) for i, j in zip(place[:-1], place[1:], strict=True)]

    def _decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The same of sequences that are not empty, by one ordered aggregation."""
        import pyarrow as pa

        lists = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids.astype(np.int32)))
        done = self._ask(DECODE, "coded", pa.table({"k": np.arange(len(ends) - 1, dtype=np.int32), "ids": lists})).column("letters")
        return [x.encode("latin-1") for x in done.to_pylist()]

    def learn(self, words: set[str]) -> None:
        """Encodes words that are not kept yet."""
        new = [w for w in words if w not in self.words]
        if self.words and len(self.words) + len(new) > MOST_WORDS:
            self.forget()
            new = list(words)
        for at in range(0, len(new), WORDS_AT_ONCE):
            lot = new[at : at + WORDS_AT_ONCE]
            ids, ends = self.encode_words(lot)
            self.words.update(zip(lot, range(len(self.words), len(self.words) + len(lot)), strict=True))
            self.id_ends = np.concatenate([self.id_ends, ends[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of lots of texts one after the other, and where each text's end (after a 0)."""
        at = 0
        while at < len(texts):
            stop, held = at, 0
            while stop < len(texts) and (stop == at or held + len(texts[stop]) <= CHARS_AT_ONCE):
                held += len(texts[stop])
                stop += 1
            words, counts = cut(texts[at:stop])
            self.learn(set(words))
            rows = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            sizes = self.id_ends[rows + 1] - self.id_ends[rows]
            upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
            yield self.ids[ragged(self.id_ends[rows], sizes)], upto
            at = stop

    def texts(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, bytes that these ids decode to) of each text."""
        for ids, ends in self.encode(texts):
            raw = ids.astype("<u4", copy=False)
            for k, text in enumerate(self.decode(ids, ends)):
                yield raw[ends[k] : ends[k + 1]].tobytes(), text


@lru_cache(2)
def codec(path: str) -> Codec:
    """One codec a process and vocabulary; tasks that follow one another share its tables."""
    return Codec(path)


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """docs with the ids of each text as an array."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            coded = codec(path).encode([t or "" for t in batch])
            yield pd.Series([ids[a:b] for ids, ends in coded for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], dtype=object)
        codec(path).forget()
        give_back()

    return without(docs, name).withColumn(name, run(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """docs with the bytes that the ids stand for; null ids are none."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            held = [np.zeros(0, np.int32) if x is None else np.asarray(x, np.int32) for x in batch]
            yield pd.Series(codec(path).decode(np.concatenate([np.zeros(0, np.int32), *held]), np.cumsum([0, *map(len, held)])), dtype=object)
        give_back()

    return without(docs, name).withColumn(name, run(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of each text, encoded and decoded in one pass; with_ids adds ids_le, the ids as little-endian unsigned 32-bit integers."""
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids_le binary" * with_ids

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows = [(len(i) // 4, sha(i), sha(d), *([i] * with_ids)) for i, d in codec(path).texts([t or "" for t in batch])]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids_le"] * with_ids])
        codec(path).forget()
        give_back()

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids_le"] * with_ids]
    out = without(docs, *names)
    return out.withColumn("_r", run(F.col(text))).select(*[F.col(c) for c in out.columns], *[F.col(f"_r.{n}").alias(n) for n in names])
