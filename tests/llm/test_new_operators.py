"""The operators that score by a language model, find periodic runs and cluster vectors, held against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import centroids, katz, periodic, queries
from fieldloom.llm.katz import FEW

SF = "/root/testdata/sf0.001"


def _plain_words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]


class PlainKatz:
    """Katz backoff by dictionaries, one chance at a time."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        self.follow = [defaultdict(set) for _ in range(order + 1)]
        for t in texts:
            words = ["<s>"] * (order - 1) + _plain_words(t) + ["</s>"]
            for i in range(order - 1, len(words)):
                for k in range(1, order + 1):
                    gram = tuple(words[i - k + 1 : i + 1])
                    self.counts[k][gram] += 1
                    self.follow[k][gram[:-1]].add(gram[-1])
        self.laws = [None]
        for k in range(1, order + 1):
            of = Counter(self.counts[k].values())
            self.laws.append(katz.discounts([of[r] for r in range(1, FEW + 2)]))
        self.n = sum(self.counts[1].values())

    def kept(self, k, c):
        return self.laws[k][c] * c if c <= FEW else c

    def total(self, context):
        k = len(context) + 1
        counts = [self.counts[k][(*context, w)] for w in self.follow[k][context]]
        return sum(counts) if any(c <= FEW for c in counts) else sum(counts) + 1

    def weight(self, context):
        k = len(context) + 1
        if context not in self.follow[k]:
            return 1.0
        seen = self.follow[k][context]
        left = 1 - sum(self.kept(k, self.counts[k][(*context, w)]) for w in seen) / self.total(context)
        return left / (1 - sum(self.chance(context[1:], w) for w in seen))

    def chance(self, context, word):
        k = len(context) + 1
        c = self.counts[k][(*context, word)]
        if c:
            return self.kept(k, c) / self.total(context)
        if k == 1:
            return 1 - sum(self.kept(1, v) for v in self.counts[1].values()) / self.total(())
        return self.weight(context) * self.chance(context[1:], word)

    def score(self, text):
        words = ["<s>"] * (self.order - 1) + _plain_words(text) + ["</s>"]
        return sum(math.log10(self.chance(tuple(words[i - self.order + 1 : i]), words[i])) for i in range(self.order - 1, len(words)))


def _corpus(n, seed, kinds=40):
    rnd = random.Random(seed)
    words = [rnd.choice("abcdefgh") * rnd.randint(1, 3) + str(k) for k in range(kinds)]
    texts = []
    for _ in range(n):
        size = rnd.choice([0, 1, 2, 5, 12, 30])
        texts.append(rnd.choice([" ", "\n", " \t "]).join(words[min(int(rnd.expovariate(0.12)), kinds - 1)] for _ in range(size)))
    return texts


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_a_plain_katz_model(spark, monkeypatch, order):
    monkeypatch.setattr(katz, "LOT", 300)
    texts = [*_corpus(90, order), None, "", "  ", "Unseen WORDS here", "a b \u0085c", "x " * 40]
    rows = [(k, t, k % 4 != 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id int, text string, learn boolean").repartition(3)
    scores, model = katz.score(docs, train=docs["learn"], order=order)
    got = {r["id"]: r for r in scores.collect()}
    plain = PlainKatz([t for _, t, learn in rows if learn], order)
    assert len(got) == len(rows)
    known = plain.counts[1]
    for k, t, _ in rows:
        words = [*_plain_words(t), "</s>"]
        assert got[k]["n_tokens"] == len(words) and got[k]["train_tokens"] == plain.n
        assert got[k]["n_known"] == sum((w,) in known for w in words)
        assert got[k]["base_score"] == pytest.approx(sum(math.log10((known[(w,)] + 0.1) / (plain.n + 0.1 * (len(known) + 1))) for w in words), rel=1e-12)
        assert got[k]["score"] == pytest.approx(plain.score(t), rel=1e-9)
    # The stored model gives others the same scores.
    again, _ = katz.score(docs.where("id % 4 = 0"), model=model)
    assert {r["id"]: pytest.approx(r["score"], rel=1e-12) for r in again.collect()} == {k: r["score"] for k, r in got.items() if k % 4 == 0}


def test_chances_of_a_context_add_up_to_one(spark):
    texts = _corpus(60, 9, kinds=12) + ["p q"] * 9 + ["p q r"] * 8
    plain = PlainKatz(texts, 2)
    for context in [("p",), ("<s>",), ("never",), *list(plain.follow[2])[:8]]:
        assert sum(plain.chance(context, w) for (w,) in plain.counts[1]) + plain.chance(context, "unknown") == pytest.approx(1, abs=1e-12)


def test_discounts_stand_for_any_counts():
    for n in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 2, 3, 4, 5, 6], [100, 40, 20, 12, 8, 6], [10, 9, 9, 9, 9, 9], [0, 0, 0, 0, 0, 3], [1000, 10, 1, 1, 1, 1]):
        d = katz.discounts(n)
        assert d[0] == 0 and np.all(d[1:] > 0) and np.all(d[1:] < 1), (n, d)


def test_katz_odd_rows(spark):
    schema = "doc_id long, Text string, n_tokens string, Score int, note string"
    empty, _ = katz.score(spark.createDataFrame([], schema), train=None, text="Text")
    assert empty.columns == ["doc_id", "note", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and empty.count() == 0
    rows = [(None, "a b", "x", 1, None), (1, "a b", "y", 2, "n"), (1, "a b", "y", 2, "n"), (2, "w " * 200_000, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    scores, _ = katz.score(docs, train=docs["doc_id"] > 0, text="Text")
    got = sorted((r["doc_id"] or 0, r["note"], r["n_tokens"], r["train_tokens"], round(r["score"], 6)) for r in scores.collect())
    assert [g[:4] for g in got] == [(0, None, 3, 200007), (1, "n", 3, 200007), (1, "n", 3, 200007), (2, None, 200001, 200007)]
    assert got[0][4] == got[1][4] == got[2][4]
    alone, _ = katz.score(docs.select("Text"), text="Text")
    assert [r["score"] for r in alone.collect()] == [0.0] * 4


def _runs(w, least, times):
    """All runs, period by period."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(least, times * q) and not any(all(w[k] == w[k + r] for k in range(s, e - r)) for r in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _figures(doc_id, text):
    """The contract's figures of a document, word by word."""
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _runs(words, 24, 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


RUN_FIELDS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_runs_of_all_documents_equal_brute_force(spark):
    got = {r["doc_id"]: tuple(r[f] for f in RUN_FIELDS) for r in queries.op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [d for d in docs if len((d["text"] or "").split()) < 700]
    assert len(got) == len(docs) and len(short) > 100
    assert {d["doc_id"]: got[d["doc_id"]] for d in short} == {d["doc_id"]: _figures(d["doc_id"], d["text"]) for d in short}
    assert sum(v[0] > 0 for v in got.values()) >= 5


def test_runs_of_random_texts_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rnd.randint(1, 5)):
            n, kinds = rnd.choice([0, 1, 2, 9, 40, 90]), rnd.choice([1, 2, 2, 3, 7])
            w = [rnd.randrange(kinds) for _ in range(n)]
            if n > 5 and rnd.random() < 0.6:
                a, p = rnd.randrange(n), rnd.randint(1, n // 2)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w * rnd.choice([1, 1, 2, 5]))
        least, times = rnd.choice([(24, 3), (6, 3), (4, 2), (2, 2), (24, 2)])
        offsets = np.cumsum([0, *map(len, texts)])
        got = periodic.runs_of(np.array([x for t in texts for x in t], np.int64), offsets, least, times)
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in _runs(t, least, times)]


def test_the_suffix_tree_of_texts_is_right():
    rnd = random.Random(2)
    for _ in range(60):
        texts = [[rnd.randrange(rnd.choice([1, 2, 4])) for _ in range(rnd.randint(1, 30))] for _ in range(rnd.randint(1, 4))]
        codes = np.array([x for t in texts for x in t], np.int64)
        lengths = np.array([len(t) for t in texts])
        text_of, ends = np.repeat(np.arange(len(texts)), lengths), np.repeat(np.cumsum(lengths), lengths)
        order, rank, lcp = periodic.suffix_order(codes, text_of, ends)
        suffix = lambda i: (text_of[i], codes[i : ends[i]].tolist())
        assert order.tolist() == sorted(range(len(codes)), key=suffix) and rank[order].tolist() == list(range(len(codes)))
        for k in range(1, len(codes)):
            a, b = suffix(order[k - 1]), suffix(order[k])
            same = next((j for j, (x, y) in enumerate(zip(a[1], b[1], strict=False)) if x != y), min(len(a[1]), len(b[1])))
            assert lcp[k] == (same if a[0] == b[0] else 0)


def test_periodic_odd_rows(spark):
    schema = "doc_id long, text string, N_Runs string, period int, note string"
    assert periodic.detect(spark.createDataFrame([], schema)).columns == ["doc_id", "note", *RUN_FIELDS, "runs"]
    assert periodic.detect(spark.createDataFrame([], schema)).count() == 0
    texts = [None, "", " \t\n", "a", "na " * 120_000, "one two three " * 9 + "four", "x" * 1_000_000]
    docs = spark.createDataFrame([(k if k else None, t, "s", 1, "n") for k, t in enumerate(texts)] * 2, schema)
    got = periodic.detect(docs, collapsed=True).collect()
    assert len(got) == 14
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[k]["n_runs"] for k in (None, 1, 2, 3, 4, 5, 6)] == [0, 0, 0, 0, 1, 1, 0]
    assert [by_id[k]["collapsed"] for k in (None, 1, 2, 3, 4, 5)] == ["", "", "", "a", "na", "one two three four"]
    assert (by_id[4]["length"], by_id[4]["exponent_milli"], by_id[5]["start"], by_id[5]["period"]) == (120_000, 120_000_000, 0, 3)
    assert by_id[5]["runs"] == [(0, 27, 3)] and by_id[5]["note"] == "n"
    r = random.Random(8)
    long = [str(r.randrange(50)) for _ in range(100_000)] * 3
    (row,) = periodic.detect(spark.createDataFrame([(1, " ".join(long))], "doc_id long, text string")).collect()
    assert (row["start"], row["length"], row["period"]) == (0, 300_000, 100_000)


def _plain_clusters(rows, count, rounds, size):
    """Lloyd's rounds with Python's integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(Fraction(x) * 256) for x in v]))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:count]
    c = [q for _, q in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda q: min(range(len(c)), key=lambda k: (far(q, c[k]), k))
    for _ in range(rounds):
        at = [near(q) for _, q in kept]
        for k in range(len(c)):
            mine = [q for (_, q), a in zip(kept, at, strict=True) if a == k]
            if mine:
                c[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = [near(q) for _, q in kept]
    d = [far(q, c[a]) for (_, q), a in zip(kept, at, strict=True)]
    fits = lambda x: x if x < 1 << 63 else None
    per = [sum(x for x, b in zip(d, at, strict=True) if b == k) for k in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i if i is not None else -1), a, fits(x), fits(per[a]), fits(sum(d)), sha[a]) for (i, _), a, x in zip(kept, at, d, strict=True))


def _clusters(spark, rows, count, rounds, size):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    start = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    got = centroids.cluster(df, start, count=count, rounds=rounds, size=size)
    return sorted(((r["vec_id"] if r["vec_id"] is not None else -1), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got.collect())


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(3)
    odd = [(None, [0.5] * 4), (900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, float("nan"), 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [1.0] * 5)]
    even = [(k, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(120)]  # many ties
    fine = [(k, (rng.normal(size=4) * 3).tolist()) for k in range(150)]
    close = [(k, (1e5 + rng.normal(size=4) * 1e-2).tolist()) for k in range(80)]  # float32 can't tell them apart
    large = [(k, (rng.normal(size=4) * 10.0 ** rng.integers(-3, 40)).tolist()) for k in range(60)]
    for rows in (even + odd, fine + fine[:20], close, fine + large, even[:3], odd[1:]):
        assert _clusters(spark, rows, 7, 3, 4) == _plain_clusters(rows, 7, 3, 4)


def test_screening_never_changes_the_nearest_centroid():
    rng = np.random.default_rng(11)
    for scale, shift in ((3, 0), (300, 0), (40, 1 << 22), (5, 1 << 26), (1 << 30, 0)):
        v, c = rng.integers(-scale, scale + 1, (300, 16)) + shift, rng.integers(-scale, scale + 1, (23, 16)) + shift
        far = ((v[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
        at, d = centroids.nearest(v, c)
        assert at.tolist() == [min(range(23), key=lambda k: (r[k], k)) for r in far.tolist()] and [int(x) for x in d] == [min(r) for r in far.tolist()]


def test_centroid_odd_columns(spark):
    df = spark.createDataFrame([(1, [0.0] * 64, 5, "n"), (1, [0.0] * 64, 6, None)], "vec_id long, embedding array<float>, Cluster int, note string")
    got = centroids.cluster(df, F.sha2(F.col("vec_id").cast("string"), 256))
    assert got.columns == ["vec_id", "note", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((r["note"] or "", r["cluster"], r["distance"], r["inertia"]) for r in got.collect()) == [("", 0, 0, 0), ("n", 0, 0, 0)]
    assert centroids.cluster(df.limit(0), F.lit("x")).count() == 0
