"""MinHash near-duplicates with sequential Bayesian verification.

Every text has a set of five-word shingles. Texts of equal sets form a class that its least id stands for.
Signatures of the classes are cut into bands; classes that share a band are candidates. A bucket's candidates
are first compared with its least id (a star, not all pairs); the links found join buckets up into components.
Only buckets that still hold several components are gone through again, in blocks, between members of different
components, since a further link inside a component changes no result; a block verifies the likeliest pairs first and
skips those that its own links have joined by then, so it returns fewer links than it has members. Signatures are compared a batch of hashes at a time, and a pair is
dropped once the posterior chance that its similarity reaches the threshold is below ``miss``. Survivors
are verified on their full sets.

The chance that a pair at the threshold shares no band is (1 - 0.75^4)^28 < 3e-5, and smaller above it. Sets
are compared as 64-bit shingle hashes.

Edge cases: a text that is null or has no words has an empty set and links with nothing; one of fewer than
five words is one shingle; rows that repeat an id and its text are one document; rows of one id with different texts are
judged each by its own; a null id is linked with nothing and kept; of equal texts the least id stays; an empty table gives an
empty result; other columns of the table, whatever their names, are not looked at. Texts of any length go the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, give_back, join_sized
from fieldloom.llm.components import components
from fieldloom.llm.shingles import common, shingle_set

ROWS, BANDS = 4, 28
HASHES = ROWS * BANDS
#: Hashes compared at a time; chance below which a pair is dropped; least similarity in hundredths.
BATCH, MISS, LEAST = 16, 1e-6, 75
#: Members of a block of a bucket, and shingles of all of them.
BLOCK, BLOCK_SHINGLES = 512, 400_000


@lru_cache(1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, HASHES, np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures (n, HASHES) of sets, none of them empty."""
    mult, add = _multipliers()
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(flat * mult[k] + add[k], starts)
    return out


@lru_cache(8)
def least_matches(miss: float = MISS, least: int = LEAST) -> tuple[int, ...]:
    """For 1, 2, ... batches compared: the fewest matches with which similarity may still reach the threshold.

    Under a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1).
    """
    x = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            d = m * np.log(x) + (n - m) * np.log1p(-x)
            d = np.exp(d - d.max())
            if d[x >= least / 100].sum() / d.sum() >= miss:
                out.append(m)
                break
    return tuple(out)


def matching(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, miss: float = MISS, least: int = LEAST) -> np.ndarray:
    """Matches of rows of signatures a and b that may be linked, -1 of others; compared a batch of hashes at a time."""
    left = np.flatnonzero(100 * np.minimum(sizes_a, sizes_b) >= least * np.maximum(sizes_a, sizes_b))
    matches = np.zeros(len(a), np.int32)
    for k, need in enumerate(least_matches(miss, least)):
        if not len(left):
            break
        cols = slice(k * BATCH, (k + 1) * BATCH)
        matches[left] += (a[left, cols] == b[left, cols]).sum(1, dtype=np.int32)
        left = left[matches[left] >= need]
    out = np.full(len(a), -1, np.int32)
    out[left] = matches[left]
    return out


def linked(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    """Whether two sets share enough."""
    n = common(a, b)
    return 100 * n >= least * (len(a) + len(b) - n)


def sketch(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, h, n, print, signature): a hash of each text, size of its set, a 128-bit hash of that, and its signature (null of an empty set)."""

    @F.pandas_udf("n long, print binary, signature binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, sets, held = [], [], 0

            def flush() -> None:
                full = [s for s in sets if len(s)]
                found = iter(signatures(full)) if full else iter(())
                for s in sets:
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), next(found).tobytes()) if len(s) else (0, None, None))
                sets.clear()

            for t in batch:
                sets.append(shingle_set(t))
                held += len(sets[-1])
                if held > 100_000:
                    flush()
                    held = 0
            flush()
            yield pd.DataFrame(rows, columns=["n", "print", "signature"])
        give_back()

    return docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("h"), run(F.col(text)).alias("s")).select("id", "h", "s.*")


def _plausible_pairs(pairs: DataFrame, classes: DataFrame, miss: float, least: int) -> DataFrame:
    """Pairs (a, b) whose signatures pass."""

    @F.pandas_udf("boolean")
    def passes(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), np.uint32).reshape(-1, HASHES) for s in (a, b))
        return pd.Series(matching(x, y, na.to_numpy(), nb.to_numpy(), miss, least) >= 0)

    for end in ("a", "b"):
        side = classes.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"), F.col("signature").alias(f"s{end}"))
        pairs = pairs.join(side, end)
    return pairs.where(passes("sa", "sb", "na", "nb")).select("a", "b")


def _sets(docs: DataFrame, ids: DataFrame, id: str, text: str) -> DataFrame:
    """(id, set) of the classes in a table (_id, doc, h): those of a text with that id and hash."""

    @F.pandas_udf("binary")
    def build(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: shingle_set(t).tobytes())
        give_back()

    texts = docs.select(F.col(id).alias("_i"), F.xxhash64(text).alias("_h"), F.col(text).alias("_x"))
    texts = join_sized(texts, ids, (F.col("_i") == F.col("doc")) & (F.col("_h") == F.col("h"))).groupBy("_id").agg(F.first("_x").alias("_x"))  # repeated rows are one
    return texts.select(F.col("_id").alias("id"), build("_x").alias("set"))


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id: str, text: str, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """Pairs (a, b) of classes whose full sets share enough: 100 * intersection >= least * union. Sets are built only for texts in pairs."""
    pairs = scratch.table(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct()
    ids = scratch.table(ids.join(classes.select(F.col("id").alias("_id"), "doc", "h"), "_id"), "ids")

    @F.pandas_udf("boolean")
    def enough(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for one, two in batches:
            yield pd.Series([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in zip(one, two, strict=True)], dtype=bool)
        give_back()

    sets = scratch.table(_sets(docs, ids, id, text), "sets")
    found = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("tb")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("ta")), "a")
    found = scratch.table(found.where(enough("ta", "tb")).select("a", "b").distinct(), "links")
    for name in ("sets", "ids", "pairs"):
        scratch.drop(name)
    return found


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, id): the bands of each class."""
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("signature", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)])
    return classes.select(F.explode(bands).alias("key"), "id")


def _compare(group: pd.DataFrame, miss: float, least: int) -> pd.DataFrame:
    """Links between members of different components in one block, the likeliest first, until all that are linked are joined."""
    kind, i, j = group["kind"].iat[0], group["i"].iat[0], group["j"].iat[0]
    sig = np.frombuffer(b"".join(group["signature"]), np.uint32).reshape(-1, HASHES)
    sets = [np.frombuffer(x, np.uint64) for x in group["set"]]
    ids, n, mine = (group[c].to_numpy() for c in ("id", "n", "mine"))
    _, comp = np.unique(group["component"].to_numpy(), return_inverse=True)
    if kind == 0:
        inside = group["inside"].to_numpy(bool)
        left, right = np.flatnonzero(inside), np.flatnonzero(~inside)
    elif i == j:
        left = right = np.arange(len(group))
    else:
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    ps, qs, ms = [], [], []
    for at in range(0, len(left), 64):
        p, q = (x.ravel() for x in np.meshgrid(left[at : at + 64], right, indexing="ij"))
        different = comp[p] != comp[q]
        if kind and i == j:
            different &= p < q
        p, q = p[different], q[different]
        m = matching(sig[p], sig[q], n[p], n[q], miss, least)
        ps.append(p[m >= 0])
        qs.append(q[m >= 0])
        ms.append(m[m >= 0])
    root = list(range(int(comp.max()) + 1 if len(comp) else 0))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    out = []
    if ps:
        order = np.argsort(-np.concatenate(ms), kind="stable")
        for p, q in zip(np.concatenate(ps)[order].tolist(), np.concatenate(qs)[order].tolist(), strict=True):
            a, b = find(comp[p]), find(comp[q])
            if a != b and linked(sets[p], sets[q], least):
                root[a] = b
                out.append((min(ids[p], ids[q]), max(ids[p], ids[q])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _blocked(rows: DataFrame, sides: DataFrame, members: DataFrame, miss: float, least: int) -> DataFrame:
    """Links of mixed buckets between members of different components.

    rows: (key, id, component); sides: (key, home, inner_blocks, outer_blocks): the component of a mixed bucket's pivot, and
    into how many blocks members in it and outside are cut; members: (id, n, signature, set). Every pair of
    an inner and an outer block, and of two outer ones, is a group of its own, so none is larger than two blocks.
    """
    inside = F.col("component") == F.col("home")
    mine = F.pmod(F.xxhash64("id"), F.when(inside, F.col("inner_blocks")).otherwise(F.col("outer_blocks"))).cast("int")
    group = lambda i, j, kind: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(kind).alias("kind"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    none = F.array().cast("array<struct<i:int,j:int,kind:int>>")
    spread = F.when(inside, F.transform(upto("outer_blocks"), lambda j: group(F.col("mine"), j, 0))).otherwise(
        F.concat(
            F.when(F.col("inner_blocks") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("inner_blocks") - 1, F.lit(0))), lambda i: group(i, F.col("mine"), 0))).otherwise(none),
            F.transform(upto("outer_blocks"), lambda j: group(F.least(F.col("mine"), j), F.greatest(F.col("mine"), j), 1)),
        )
    )
    placed = join_sized(rows, sides, "key").withColumn("mine", mine).withColumn("inside", inside).withColumn("g", F.explode(spread))
    placed = placed.select("key", "g.*", "id", "component", "inside", "mine").join(members, "id")
    return placed.groupBy("key", "kind", "i", "j").applyInPandas(lambda g: _compare(g, miss, least), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", miss: float = MISS, least: int = LEAST, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept, text_hash) of every row: size of its set, the least id that links reach from it, whether it is that one, and xxhash64 of its text."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    drawn = scratch.table(sketch(docs, id, text), "sketches")
    able = F.col("print").isNotNull() & F.col("id").isNotNull()
    classes = drawn.where(able).groupBy("print").agg(F.min(F.struct("id", "h")).alias("of"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    # Numbers, since an id may have several texts; they are fixed once the table is written.
    classes = scratch.table(classes.select(F.monotonically_increasing_id().alias("id"), F.col("of.id").alias("doc"), F.col("of.h").alias("h"), "n", "signature", "print"), "classes")
    members = drawn.where(able).select("id", "h", "n", "print").join(classes.select("print", F.col("id").alias("class")), "print").drop("print")
    members = scratch.table(members.unionByName(drawn.where(~able).select("id", "h", "n", F.lit(None).cast("long").alias("class"))), "members")
    scratch.drop("sketches")
    classes = classes.drop("print")

    buckets = _buckets(classes)
    pivots = scratch.table(buckets.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1"), "pivots")
    rows = join_sized(buckets, pivots, "key")
    rows = scratch.table(rows.select("key", "id", "pivot", "size"), "rows")
    star = rows.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    links = verify(_plausible_pairs(star, classes, miss, least), classes, docs, id, text, scratch, least)
    found = components(links, scratch, "star")

    wide = rows.where("size > 2").select("key", "id", "pivot")
    wide = wide.join(found.withColumnRenamed("component", "c"), "id", "left").select("key", "id", "pivot", F.coalesce("c", "id").alias("component"))
    wide = scratch.table(wide, "wide")
    mixed = wide.groupBy("key").agg(F.min("pivot").alias("pivot"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    mixed = scratch.table(mixed.select("key", "pivot"), "mixed")
    if not mixed.isEmpty():
        homes = mixed.join(found.withColumnRenamed("id", "pivot"), "pivot", "left").select("key", F.coalesce("component", "pivot").alias("home"))
        homes = scratch.table(homes, "homes")
        # What was compared with the pivot need not be again; the pivot itself stays out.
        others = join_sized(wide.where("id <> pivot").select("key", "id", "component"), homes, "key").join(classes.select("id", "n"), "id")
        others = scratch.table(others, "others")
        inside = F.col("component") == F.col("home")
        size = lambda side: F.greatest(F.ceil(F.count_if(side) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")
        sides = others.groupBy("key", "home").agg(size(inside).alias("inner_blocks"), size(~inside).alias("outer_blocks"), F.count(F.lit(1)).alias("all"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("print"))
        # Buckets with the same members, as copies of one text have, are one.
        sides = sides.where("outer_blocks > 0 and all > 1").groupBy("print", "all", "home").agg(*[F.min(F.struct("key", "inner_blocks", "outer_blocks")).alias("s")]).select("s.*", "home")
        sides = scratch.table(sides, "sides")
        chosen = scratch.table(join_sized(others.select("key", "id", "component"), sides.select("key"), "key", "left_semi"), "chosen")
        ids = scratch.table(chosen.select(F.col("id").alias("_id")).distinct().join(classes.select(F.col("id").alias("_id"), "doc", "h"), "_id"), "ids")
        full = join_sized(classes.select("id", "n", "signature"), ids, F.col("id") == F.col("_id"), "left_semi").join(_sets(docs, ids, id, text), "id")
        more = scratch.table(_blocked(chosen, sides, scratch.table(full, "full"), miss, least), "more")
        if not more.isEmpty():
            found = components(links.union(more), scratch, "all")
    named = classes.select(F.col("id").alias("class"), "doc").join(found.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = scratch.table(named, "named")
    least_ids = scratch.table(found.select("component").distinct().join(named, "component").groupBy("component").agg(F.min("doc").alias("least")), "least_ids")
    named = join_sized(named, least_ids, "component", "left").select("class", F.coalesce("least", "doc").alias("component_id"))
    able = members.where("class is not null").join(named, "class").drop("class")
    out = scratch.table(able.unionByName(members.where("class is null").select("id", "h", "n", F.col("id").alias("component_id"))), "judged")
    scratch.drop_but("judged")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), F.col("h").alias("text_hash"))
