"""Near duplicates, decontamination, embeddings and the pipeline against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, hnsw, minhash, queries
from fieldloom.llm.common import Scratch
from fieldloom.llm.components import components

WORDS = ["ab", "the", "of", "lum", "kor", "sin", "tes", "var", "dol", "rem", "nic", "pos", "qua", "zet"]


def shingles(text):
    w = text.encode().lower().split() if text else []
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def groups(ids, linked):
    """Least id that links reach, of each id."""
    of = {i: i for i in ids}

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, groups(sets, links)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200), (301, 300), (302, 301), (300, 303)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    want = groups({x for p in links for x in p}, links)
    del want[200]
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def near_group(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.randrange(1000))
    return " ".join(w)


def test_minhash_equals_brute_force_on_chains(spark):
    rng = random.Random(6)
    docs = []
    for _ in range(6):
        w = [rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(25):  # near copies at all distances from one another, some of them linked by chains alone
            docs.append(near_group(rng, w, rng.choice([0, 1, 2, 3, 4, 6])))
    docs += ["one two", "One  TWO", "a b c d e", "", None, "   ", "x", "x"]
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    df = spark.createDataFrame([*[(i, t, "en") for i, t in rows], (3, docs[3], "en"), (None, "lost id", "en")], "doc_id long, text string, kept string")
    got = minhash.near_duplicates(df).collect()
    sets, want = brute(rows)
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_minhash_small_blocks(spark, monkeypatch):
    """Buckets cut into many blocks give the same components."""
    rng = random.Random(9)
    w = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(60)]
    rows = [(i, near_group(rng, w, rng.choice([2, 3, 4, 5]))) for i in range(80)]
    monkeypatch.setattr(minhash, "BLOCK", 7)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)[1]


def test_bayes_keeps_what_is_similar():
    need = minhash.least_matches()
    assert len(need) == minhash.HASHES // minhash.BATCH and all(a < b for a, b in zip(need, need[1:], strict=False))
    rng = np.random.default_rng(1)
    for share, floor in ((0.75, 0.999), (0.9, 1.0)):
        a = rng.integers(0, 1 << 32, (2000, minhash.HASHES), np.uint32)
        b = np.where(rng.random(a.shape) < share, a, rng.integers(0, 1 << 32, a.shape, np.uint32))
        n = np.full(len(a), 100)
        assert (minhash.matching(a, b, n, n) >= 0).mean() >= floor
    assert (minhash.matching(a, np.roll(a, 1, 0), n, n) >= 0).sum() == 0
    assert minhash.matching(a[:1], a[:1], np.array([70]), np.array([100]))[0] == -1


def test_decontamination_finds_planted_items(spark):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(n))) for k, n in enumerate([12, 15, 20, 20, 33, 47, 60, 90])] + [(50, None), (51, ""), (52, "tiny item")]
    noise = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(500, 900)) for _ in range(n))
    docs, want = [], set()
    for i in range(120):
        k, t = items[i % 8]
        if i % 3 == 0:
            docs.append((i, f"{noise(rng.randrange(80))} {t.upper()} {noise(rng.randrange(80))}"))
            want.add((i, k))
        elif i % 3 == 1:  # one word of a long item is another
            w = t.split()
            w[rng.randrange(len(w))] = "other"
            docs.append((i, f"{noise(rng.randrange(80))} {' '.join(w)} {noise(rng.randrange(80))}"))
            s, u = shingles(" ".join(w)), shingles(t)
            if len(s & u) / len(s | u) >= 0.75:
                want.add((i, k))
        else:
            w = t.split()
            docs.append((i, f"{noise(40)} {' '.join(w[: len(w) // 2])} {noise(rng.randrange(80))}"))
    docs += [(500, None), (501, ""), (502, items[4][1]), (502, items[4][1]), (503, noise(30_000) + " " + items[5][1])]
    want |= {(502, 4), (503, 5)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, similarity string")
    rows = decontaminate.decontaminate(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and sum(r.doc_id == 502 for r in rows) == 2
    clean = {r.doc_id for r in decontaminate.clean(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0 and decontaminate.decontaminate(df, bench.limit(0)).count() == 0


def test_lots_of_a_benchmark_change_nothing(spark, monkeypatch):
    """Items that share passages get the same similarities whether they are sent at once or in lots."""
    rng = random.Random(12)
    some = lambda n: [rng.choice(WORDS) + str(rng.randrange(900)) for _ in range(n)]
    passages = [some(10) for _ in range(4)]
    items = [(k, [*some(rng.randrange(9, 24)), *passages[k % 4], *some(rng.randrange(3, 9))]) for k in range(48)]
    docs = []
    for k, w in items:
        for _ in range(3):  # words of the item's own part, of the shared passage or of both are others
            v = list(w)
            for at in rng.sample(range(len(v)), rng.randrange(4)):
                v[at] = "other"
            docs.append((len(docs), " ".join([*some(20), *v, *some(rng.randrange(40))])))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(90, ""), (91, None)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")

    def both():
        return sorted(map(tuple, decontaminate.decontaminate(df, bench).collect())), {r.doc_id for r in decontaminate.clean(df, bench).collect()}

    once = both()
    assert {r[2] for r in once[0]} > {1.0} and once[1]
    for lot in (20, 5):
        monkeypatch.setattr(decontaminate, "LOT", lot)
        assert both() == once


def test_items_of_few_words_are_found_in_texts(spark):
    items = [(1, "solo"), (2, "tiny item"), (3, "of three words"), (4, "four words it has"), (5, "just five words it has"), (6, "TINY  item")]
    docs = [
        ("a b solo c d", {(1, 2)}),
        ("solo", {(1, 0)}),
        ("a tiny Item b c d e f g tiny item", {(2, 1), (6, 1)}),
        ("x of three words", {(3, 1)}),
        ("of three words", {(3, 0)}),
        ("a b c d e four words it has f", {(4, 5)}),
        ("just five words it has", {(5, 0)}),
        ("of three other words and tiny", set()),
        ("item at the end, tiny", set()),
        ("item tiny", set()),
        ("four words it", set()),
        (None, set()),
        ("", set()),
        ("tiny", set()),  # an item across two texts is in none
        ("item", set()),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(docs)], "doc_id long, text string").coalesce(1)
    got = decontaminate.decontaminate(df, bench).collect()
    size = {i: len(t.split()) for i, t in items}
    assert sorted((r.doc_id, r.item_id, r.first_word) for r in got) == sorted((k, *f) for k, (_, found) in enumerate(docs) for f in found)
    assert all((r.similarity, r.n_words) == (1.0, size[r.item_id]) for r in got)
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {k for k, (_, found) in enumerate(docs) if not found}


def test_hamming_blocks_miss_nothing():
    rng = np.random.default_rng(2)
    items = [{"h": rng.integers(0, 1 << 63, 20, np.uint64)} for _ in range(40)]
    group = decontaminate.Group(items, 15, 4)
    prints = rng.integers(0, 1 << 63, 3000, np.uint64)
    prints[:200] = group.prints[rng.integers(0, 40, 200)]
    for k in range(200):
        for b in rng.choice(64, rng.integers(0, 16), replace=False):
            prints[k] ^= np.uint64(1 << int(b))
    got = {(int(w), k) for at, k in group.search(prints, group.tables()) for w in at}
    far = np.bitwise_count(prints[:, None] ^ group.prints[None])
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(far <= 15), strict=True)}


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(500, 16))
    rows = [(i, v.astype("f4").tolist()) for i, v in enumerate(np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.1, base[:1] + rng.normal(size=(120, 16)) * 0.12, base[5:8] * 3]))]
    n = len(rows)
    rows += [(n, rows[3][1]), (n + 1, None), (n + 2, [0.0] * 16), (n + 3, [float("nan")] * 16), (n + 4, [1.0, 2.0]), (n + 5, []), (n + 6, [None] + [1.0] * 15), (n + 6, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in hnsw.near_duplicates(df).collect()}
    good = [(i, np.array(v, float)) for i, v in rows if v and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.stack([v for _, v in good])
    x /= np.sqrt((x * x).sum(1))[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [i for i, _ in good]
    want = groups(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    links = dict(zip(ids, near.sum(1).tolist(), strict=True))
    for i, _ in rows:
        r = got[i]
        assert (r.n_links, r.component_id, r.kept) == (links.get(i, 0), want.get(i, i), want.get(i, i) == i)


def test_graph_recall_by_audit():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24))
    x = np.concatenate([x, x[:300] + rng.normal(size=(300, 24)) * 0.15])
    x /= np.sqrt((x * x).sum(1))[:, None]
    graph = hnsw.Graph(x)
    assert graph.audit(0.9) >= hnsw.RECALL
    p, q = graph.search(x, 0.9)
    assert len(p) >= 0.99 * (x @ x.T >= 0.9).sum()


def test_audit_of_a_shard_without_links_of_its_own():
    """Links of vectors of other shards are found even where none lies inside the shard."""
    rng = np.random.default_rng(15)
    x = rng.normal(size=(3000, 32))
    x /= np.sqrt((x * x).sum(1))[:, None]
    assert (x @ x.T >= 0.9).sum() == len(x)
    graph = hnsw.Graph(x)
    graph.beam = 1
    assert graph.audit(0.9) >= hnsw.RECALL and graph.beam > 1
    q = x[:1000] + rng.normal(size=(1000, 32)) * 0.06
    q /= np.sqrt((q * q).sum(1))[:, None]
    found, _ = graph.search(q, 0.9)
    assert len(found) >= 0.99 * (q @ x.T >= 0.9).sum() > 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_pipeline_equals_its_parts(spark, sf):
    import corpus_pipeline as P
    from fieldloom.llm import quality, secrets

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE"]
    model = quality.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).where("keep").collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect() if r.doc_id in good]
    _, component = brute(rows)
    rows = [(i, t) for i, t in rows if component[i] == i]
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(len(s & shingles(t)) >= 0.9 * len(s) for s in items if s)]
    got = {r.doc_id: r for r in P.run(spark, sf).collect()}
    assert set(got) == {i for i, _ in rows}
    forest = secrets.forest()
    import hashlib

    for i, t in rows:
        for a, b, _, _ in reversed(secrets.scan(t, docs.where(F.col("doc_id") == i).first().source, forest) if "token" in t or "AKIA" in t or "password" in t else []):
            t = t[:a] + secrets.MARK + t[b:]
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_pipeline_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline as P

    df = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11)] * 3 + [(2, "a b c d e f", "en", "s", 11), (3, None, "en", "s", None), (None, "q r s t u v", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0) for r in P.near_dedup_stage(spark, df, "").collect()) == [0, 1, 3]


def test_queries_carry_the_contract_columns():
    assert [n for n in queries.queries()] == ["op1_url_filters", "op2_token_output", "op3_quality", "op4_html_extraction", "op5_decontamination", "op6_embedding_dedup", "op7_language_id", "op8_minhash", "op9_byte_bpe", "op10_secrets"]


def _weighted_hits(items, texts):
    """(text, item) of weighted similarity 0.75 or more at any start, shingle by shingle."""
    shingled = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
    held = Counter(s for w in items for s in set(shingled(w)))
    weigh = lambda some: sum(math.log1p(len(items) / held.get(s, 1)) for s in some)
    out = set()
    for d, t in enumerate(texts):
        for k, w in enumerate(items):
            mine = set(shingled(w))
            for a in range(max(1, len(t) - len(w) + 1)):
                window = set(shingled(t[a : a + len(w)]))
                if mine & window and weigh(mine & window) >= 0.75 * weigh(mine | window):
                    out.add((d, k))
    return out


@pytest.mark.parametrize("own, shared", [(40, 40), (40, 30), (14, 60)])
def test_items_that_share_a_template_are_found_by_their_own_words(own, shared):
    """Texts cut to an item's own words, and items with changed words inside texts: all that reach the weighted similarity, where most of each item is what all share."""
    rng = random.Random(own + shared)
    word = lambda: f"w{rng.randrange(10**6)}"
    template = [word() for _ in range(shared)]
    items = [[*(word() for _ in range(own)), *template] for _ in range(50)]
    texts = [w[: own + extra] for extra in (0, 4, 10, shared) for w in items[:20]] + [[*(word() for _ in range(rng.randrange(40))), *(x if rng.random() > 0.02 else word() for x in w), *(word() for _ in range(rng.randrange(40)))] for w in items]
    want = _weighted_hits(items, texts)
    bench = decontaminate.Benchmark([(k, " ".join(w)) for k, w in enumerate(items)])
    assert {m[:2] for m in bench.matches([" ".join(t) for t in texts])} == want and len(want) > 40
