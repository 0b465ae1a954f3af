"""Embedding near-duplicates through hierarchical navigable small-world graphs, one a shard.

Vectors are dealt to shards by a hash; equal vectors are one row with its count. A task builds the graph of
a shard (a batch of vectors at a time, so that numpy does the work), audits it, and writes it to files in the shared folder, once.
Then every vector queries every shard: a task reads the vectors of a few shards and the graphs of a few others in turn, so
nothing but the names of files is shuffled. Beams start at BEAM
and are doubled until an audit against all vectors of the shard finds at least RECALL of the links of AUDIT of its own
vectors and of as many that are not in its graph, as those of other shards, placed so that each has a link there. Each time vectors of another
shard query a graph, a sample of them is audited again, against all of the graph's vectors, and the beam doubled until they reach
RECALL too; and doubled for a query as long as its whole beam is links. All hits are verified in double precision.
A task returns a query's count of links in the shard and the shard's local components that it touches, not
pairs, so dense groups cost no rows; components of those links give the result.

A shard holds about SHARD rows (never fewer than LEAST_SHARDS shards); queries times shards is the cost of the method.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and
neither do vectors of different lengths; vectors may be of any finite size, since each is scaled by a power of two first; rows that
repeat an id and its vector are one vector; rows of one id with different vectors are judged each by its own; a null id links
with nothing and is kept; of linked vectors the least id stays; an empty table gives an empty result; other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, give_back, join_sized, shared_files
from fieldloom.llm.components import components

SHARD, LEAST_SHARDS = 20_000, 6
#: Links of a node above and at the bottom, beam in building and, at first, in searching.
LINKS, BOTTOM, BUILD_BEAM, BEAM = 12, 24, 48, 48
#: Queries of an audit, and the share of links that it must find.
AUDIT, RECALL = 512, 0.999
#: Queries of the audit of another shard's vectors; shards that a task queries with, and that it queries, at most.
SAMPLE, SHARDS_AT_ONCE = 128, 8
#: Queries searched together; nodes of each that are expanded at once; nodes below which a layer is searched in full.
TOGETHER, AT_ONCE, FULL = 192, 4, 256


class Graph:
    """Layers of links over unit vectors; layer 0 holds all nodes."""

    def __init__(self, x: np.ndarray, seed: int = 17):
        self.x = x.astype(np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum(np.floor(-np.log(rng.random(n) + 1e-12) / np.log(LINKS)).astype(int), 8) if n else np.zeros(0, int)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # nodes (row numbers) and links among them (their numbers in the layer, -1 none)
        self.extra: list[np.ndarray] = []
        order = rng.permutation(n)
        top = int(level.max()) if n else 0
        for k in range(top, -1, -1):
            nodes = order[level[order] >= k]
            self._build(nodes, LINKS if k else BOTTOM)
        self.beam = BEAM

    def _build(self, nodes: np.ndarray, width: int) -> None:
        x, m = self.x[nodes], len(nodes)
        links = np.full((m, width), -1, np.int32)
        sims = np.full((m, width), -2.0, np.float32)
        at = min(m, FULL)
        if at:
            self._wire(x, links, sims, np.arange(at), x[:at] @ x[:at].T - 3 * np.eye(at, dtype=np.float32), np.tile(np.arange(at, dtype=np.int32), (at, 1)), width)
        above = self.layers[-1] if self.layers else None
        place = {int(v): i for i, v in enumerate(nodes)} if above is not None else {}
        entry = np.array([place[int(v)] for v in above[0]], np.int32) if above is not None else None
        while at < m:
            stop = min(m, at + TOGETHER)
            rows = np.arange(at, stop)
            starts = None
            if entry is not None:
                found, _ = self._descend(x[rows])
                starts = entry[found[:, :4]]
                starts = np.where((found[:, :4] >= 0) & (starts < at), starts, -1)
            seeds = np.tile(np.arange(min(4, at), dtype=np.int32), (len(rows), 1))
            starts = seeds if starts is None else np.concatenate([starts, seeds[:, :1]], 1)
            ids, near = _beam(x[:at], links[:at], x[rows], starts, BUILD_BEAM)
            own = x[rows] @ x[rows].T - 3 * np.eye(len(rows), dtype=np.float32)
            ids = np.concatenate([ids, np.tile(rows.astype(np.int32), (len(rows), 1))], 1)
            near = np.concatenate([near, own], 1)
            self._wire(x, links, sims, rows, near, ids, width)
            at = stop
        self.layers.append((nodes, links))
        self.extra.append(_unreached(links))

    @staticmethod
    def _wire(x, links, sims, rows, near, ids, width) -> None:
        """Gives each row diverse near neighbours, and them the row."""
        k = min(near.shape[1], BUILD_BEAM)
        best = np.argpartition(-near, k - 1, 1)[:, :k] if near.shape[1] > k else np.tile(np.arange(near.shape[1]), (len(near), 1))
        near, ids = np.take_along_axis(near, best, 1), np.take_along_axis(ids, best, 1)
        best = np.argsort(-near, 1, kind="stable")
        near, ids = np.take_along_axis(near, best, 1), np.take_along_axis(ids, best, 1)
        valid = (ids >= 0) & (near > -1.5)
        cand = x[np.maximum(ids, 0)]
        among = np.einsum("bkd,bld->bkl", cand, cand)
        half = width // 2
        chosen = np.zeros(ids.shape, bool)
        count = np.zeros(len(ids), np.int64)
        blocked = np.full(ids.shape, -2.0, np.float32)
        for j in range(ids.shape[1]):
            take = valid[:, j] & (blocked[:, j] < near[:, j]) & (count < half)
            chosen[:, j] = take
            count += take
            blocked = np.where(take[:, None], np.maximum(blocked, among[:, j]), blocked)
        for j in range(ids.shape[1]):  # the nearest of the others fill up, but leave room for links back
            take = valid[:, j] & ~chosen[:, j] & (count < half + width // 4)
            chosen[:, j] |= take
            count += take
        source, at = np.nonzero(chosen)
        if not len(source):
            return
        a = np.concatenate([rows[source], ids[source, at]])
        b = np.concatenate([ids[source, at], rows[source]]).astype(np.int32)
        s = np.concatenate([near[source, at]] * 2)
        own = np.concatenate([np.ones(len(source), bool), np.zeros(len(source), bool)])
        order = np.lexsort((-s, ~own, a))
        a, b, s, own = a[order], b[order], s[order], own[order]
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        ends = np.append(starts[1:], len(a))
        for i, j in zip(starts.tolist(), ends.tolist()):
            node = a[i]
            have = links[node] >= 0
            both = np.concatenate([links[node][have], b[i:j]])
            val = np.concatenate([sims[node][have], s[i:j]])
            _, first = np.unique(both, return_index=True)
            first = first[both[first] != node]
            if len(first) > width:  # keep the diverse half, then the nearest
                first = first[np.argsort(-val[first], kind="stable")]
                v = x[both[first]]
                g = v @ v.T
                keep: list[int] = []
                for p in range(len(first)):
                    if len(keep) < half and (not keep or g[p, keep].max() < val[first[p]]):
                        keep.append(p)
                rest = [p for p in range(len(first)) if p not in set(keep)]
                first = first[(keep + rest)[:width]]
            links[node] = -1
            links[node, : len(first)], sims[node, : len(first)] = both[first], val[first]

    def _descend(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes of the lowest layer that is built, by way of those above: numbers in the layer and similarities."""
        starts = np.zeros((len(q), 1), np.int32)
        ids = near = None
        for k, (nodes, links) in enumerate(self.layers):
            if k:
                place = self._places(k)
                starts = np.where(ids[:, :4] >= 0, place[np.maximum(ids[:, :4], 0)], -1)
            ids, near = _beam(self.x[nodes], links, q, _with(starts, self.extra[k]), 8)
        return ids, near

    def _places(self, k: int) -> np.ndarray:
        """Where the nodes of layer k - 1 are in layer k."""
        of = np.full(len(self.x), -1, np.int32)
        of[self.layers[k][0]] = np.arange(len(self.layers[k][0]))
        return of[self.layers[k - 1][0]]

    def search(self, q: np.ndarray, least: float, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query number, row number) of what the beams find at ``least`` or above; a beam of nothing but hits is doubled."""
        outq, outr = [], []
        nodes, links = self.layers[-1]
        q = q.astype(np.float32)
        xs = self.x[nodes]
        upper = Graph.__new__(Graph)
        upper.x, upper.layers, upper.extra = self.x, self.layers[:-1], self.extra[:-1]
        place = self._places(len(self.layers) - 1) if len(self.layers) > 1 else None
        for at in range(0, len(q), TOGETHER):
            rows, ef = np.arange(at, min(len(q), at + TOGETHER)), beam or self.beam
            starts = np.zeros((len(rows), 1), np.int32)
            if place is not None:
                ids, _ = upper._descend(q[rows])
                starts = np.where(ids >= 0, place[np.maximum(ids, 0)], -1)
            starts = _with(starts, self.extra[-1])
            while len(rows):
                ids, near = _beam(xs, links, q[rows], starts, ef)
                full = (near.min(1) >= least) & (ids.min(1) >= 0) & (ef < len(nodes))
                r, c = np.nonzero((near >= least) & (ids >= 0) & ~full[:, None])
                outq.append(rows[r])
                outr.append(nodes[ids[r, c]])
                rows, starts, ef = rows[full], starts[full], ef * 2
        return np.concatenate(outq) if outq else np.zeros(0, int), np.concatenate(outr) if outr else np.zeros(0, int)

    def _strangers(self, least: float, rng: np.random.Generator) -> np.ndarray:
        """Vectors that are not in the graph, each in a random direction from one of AUDIT that are, at a cosine between ``least`` and 1."""
        x = self.x[rng.permutation(len(self.x))[:AUDIT]].astype(np.float64)
        u = rng.normal(size=x.shape)
        u -= (u * x).sum(1, keepdims=True) * x
        u /= np.maximum(np.sqrt((u * u).sum(1, keepdims=True)), 1e-12)
        c = rng.uniform(least + 0.01 * (1 - least), 1, (len(x), 1))
        out = c * x + np.sqrt(1 - c * c) * u
        return (out / np.sqrt((out * out).sum(1, keepdims=True))).astype(np.float32)

    def audit(self, least: float, seed: int = 23) -> float:
        """Widens the beam until a sample of the vectors and of strangers, compared with all, finds RECALL of its links; the recall."""
        rng = np.random.default_rng(seed)
        rows = rng.permutation(len(self.x))[:AUDIT]
        q = np.concatenate([self.x[rows], self._strangers(least, rng)])
        return self.widen(q, least, np.concatenate([rows, np.full(len(q) - len(rows), -1)]))

    def widen(self, q: np.ndarray, least: float, own: np.ndarray | None = None) -> float:
        """Widens the beam until queries q, compared with all vectors, find RECALL of their links; the recall. own: the row that a query is itself, or -1."""
        own = np.full(len(q), -1) if own is None else own
        want = {(i, j) for i, j in zip(*(v.tolist() for v in np.nonzero(q.astype(np.float32) @ self.x.T >= least)), strict=True) if own[i] != j}
        while want:
            found = want.intersection(zip(*(v.tolist() for v in self.search(q, least)), strict=True))
            if len(found) >= RECALL * len(want) or self.beam >= len(self.x):
                return len(found) / len(want)
            self.beam = min(len(self.x), self.beam * 2)
        return 1.0


def _with(starts: np.ndarray, extra: np.ndarray) -> np.ndarray:
    return np.concatenate([starts, np.tile(extra, (len(starts), 1))], 1) if len(extra) else starts


def _unreached(links: np.ndarray) -> np.ndarray:
    """A node of each part of the graph that can't be reached from node 0 (or from those before)."""
    n = len(links)
    seen = np.zeros(n, bool)
    out = []
    for first in range(n):
        if seen[first]:
            continue
        if first:
            out.append(first)
        front = np.array([first])
        seen[first] = True
        while len(front):
            nxt = links[front].ravel()
            nxt = np.unique(nxt[nxt >= 0])
            front = nxt[~seen[nxt]]
            seen[front] = True
    return np.array(out, np.int32)


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, starts: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once: (numbers, similarities), best first, -1 and -2 where there are fewer."""
    n, b = len(x), len(q)
    if n <= max(FULL, ef):  # a small layer is looked at whole
        near = q @ x.T
        k = min(ef, n)
        ids = np.argsort(-near, 1, kind="stable")[:, :k].astype(np.int32)
        near = np.take_along_axis(near, ids, 1)
        return (np.pad(ids, ((0, 0), (0, ef - k)), constant_values=-1), np.pad(near, ((0, 0), (0, ef - k)), constant_values=-2.0))
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    ids = np.full((b, ef), n, np.int32)
    near = np.full((b, ef), -2.0, np.float32)
    open_ = np.zeros((b, ef), bool)
    rows = np.arange(b)
    new = np.where(starts >= 0, starts, n)
    active = rows
    while len(active):
        flat = np.sort(new, 1)
        flat[:, 1:][flat[:, 1:] == flat[:, :-1]] = n
        flat[seen[active[:, None], flat]] = n
        seen[active[:, None], flat] = True
        r, c = np.nonzero(flat < n)
        s = np.full(flat.shape, -2.0, np.float32)
        s[r, c] = np.einsum("kd,kd->k", x.take(flat[r, c], 0), q.take(active[r], 0))
        all_ids = np.concatenate([ids[active], flat], 1)
        all_near = np.concatenate([near[active], s], 1)
        all_open = np.concatenate([open_[active], flat < n], 1)
        best = np.argpartition(-all_near, ef - 1, 1)[:, :ef]
        ids[active], near[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_near, best, 1)
        open_[active] = np.take_along_axis(all_open, best, 1)
        o = np.where(open_[active], near[active], -3.0)
        k = min(AT_ONCE, ef)
        pick = np.argpartition(-o, k - 1, 1)[:, :k]
        good = np.take_along_axis(o, pick, 1) > -2.5
        go = good.any(1)
        active, pick, good = active[go], pick[go], good[go]
        if not len(active):
            break
        nodes = np.where(good, np.take_along_axis(ids[active], pick, 1), -1)
        r, c = np.nonzero(good)
        open_[active[r], pick[r, c]] = False
        new = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
        new = np.where(new >= 0, new, n)
    order = np.argsort(-near, 1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    return np.where(ids == n, -1, ids), near


def _save(folder: str, **arrays) -> str:
    """The name of a new file with these arrays. A task that is run again writes another."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    system, path = shared_files(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}.npz"
    with system.open_output_stream(f"{path}/{name}") as f:
        f.write(out.getbuffer())
    return name


def _load(folder: str, name: str) -> dict[str, np.ndarray]:
    system, path = shared_files(folder)
    with system.open_input_file(f"{path}/{name}") as f, np.load(io.BytesIO(f.read())) as found:
        return dict(found)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Each row times a power of two, which brings its largest component to between a half and one and changes no digit."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _verified(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """Which pairs (row p of a, row q of b) have a cosine of ``least`` or more in double precision."""
    out = np.zeros(len(p), bool)
    for at in range(0, len(p), 50_000):
        x, y = a[p[at : at + 50_000]], b[q[at : at + 50_000]]
        out[at : at + 50_000] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) >= least
    return out


def _local(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least row number that each of n rows reaches by pairs (p, q)."""
    of = np.arange(n)
    while True:
        new = of.copy()
        np.minimum.at(new, p, of[q])
        np.minimum.at(new, q, of[p])
        new = new[new]
        if (new == of).all():
            return of
        of = new


def _build(group: pd.DataFrame, least: float, folder: str) -> pd.DataFrame:
    """Writes a shard's vectors, with what links them among each other, and its graph; the names of the files."""
    group = group.sort_values("id")
    ids, weight = group["id"].to_numpy(), group["m"].to_numpy()
    v = _scaled(np.stack(group["v"].to_numpy()).astype(np.float64))
    graph = Graph(_unit(v))
    recall = graph.audit(least - 1e-4)
    p, q = graph.search(graph.x, least - 1e-4)
    ok = (p != q) & _verified(v, v, p, q, least)
    p, q = p[ok], q[ok]
    count = np.bincount(p, weights=weight[q], minlength=len(ids)).astype(np.int64)
    vectors = _save(folder, ids=ids, weight=weight, v=v, local=ids[_local(len(ids), p, q)], count=count)
    layers = {f"nodes{k}": a for k, (a, _) in enumerate(graph.layers)} | {f"links{k}": a for k, (_, a) in enumerate(graph.layers)} | {f"extra{k}": a for k, a in enumerate(graph.extra)}
    links = _save(folder, beam=np.array(graph.beam), **layers)
    give_back()
    return pd.DataFrame({"dim": group["dim"].iloc[:1].to_numpy(), "shard": group["shard"].iloc[:1].to_numpy(), "recall": [recall], "vectors": [vectors], "links": [links]})


def _graph(folder: str, vectors: dict[str, np.ndarray], links: str) -> Graph:
    held = _load(folder, links)
    graph = Graph.__new__(Graph)
    graph.x, graph.beam = _unit(vectors["v"]).astype(np.float32), int(held["beam"])
    n = sum(k.startswith("nodes") for k in held)
    graph.layers = [(held[f"nodes{k}"], held[f"links{k}"]) for k in range(n)]
    graph.extra = [held[f"extra{k}"] for k in range(n)]
    return graph


def _query(block: dict[str, np.ndarray], vectors: dict[str, np.ndarray], graph: Graph, least: float) -> pd.DataFrame | None:
    """Counts and touched local components of each vector of a block in another shard's graph."""
    q = _unit(block["v"])
    sample = np.random.default_rng(len(q)).permutation(len(q))[:SAMPLE]
    graph.widen(q[sample], least - 1e-4)
    i, j = graph.search(q, least - 1e-4)
    ok = _verified(block["v"], vectors["v"], i, j, least)
    i, j = i[ok], j[ok]
    if not len(i):
        return None
    hits = pd.DataFrame({"id": block["ids"][i], "n": vectors["weight"][j], "to": vectors["local"][j]})
    return hits.groupby("id", as_index=False).agg(n=("n", "sum"), to=("to", lambda s: sorted(set(s))))


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", least: float = 0.9, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: vectors linked directly, least id that links reach, and whether it is this one."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    good = rows.where("sound").select("id", "v").distinct()
    classes = good.groupBy("v").agg(F.min("id").alias("of"), F.count(F.lit(1)).alias("m"))
    # Numbers, since an id may have several vectors; they are fixed once the table is written.
    classes = scratch.table(classes.select(F.monotonically_increasing_id().alias("id"), "of", "v", "m", F.size("v").alias("dim")), "classes")
    shards = max(LEAST_SHARDS, -(-classes.count() // SHARD))
    folder = scratch.folder("graphs")
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).drop("of")
    built = dealt.groupBy("dim", "shard").applyInPandas(lambda g: _build(g, least, folder), "dim int, shard int, recall double, vectors string, links string")
    built = scratch.table(built, "built")

    lot = max(1, min(SHARDS_AT_ONCE, shards // 24))
    lots = -(-shards // lot)
    held = built.groupBy("dim", F.floor(F.col("shard") / lot).cast("int").alias("lot")).agg(F.collect_list(F.struct("shard", "vectors", "links")).alias("held"))
    asking = held.select("dim", F.col("held").alias("asking"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))
    pairs = asking.join(held.withColumnRenamed("held", "asked"), ["dim", "lot"]).select("asking", "asked")
    pairs = pairs.repartition(max(1, min(lots * lots, 8 * spark.sparkContext.defaultParallelism)))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for asking, asked in zip(batch["asking"], batch["asked"], strict=True):
                for g in asked:
                    mine = _load(folder, g["vectors"])
                    graph = None
                    for b in asking:
                        if b["shard"] == g["shard"]:
                            yield pd.DataFrame({"id": mine["ids"], "n": mine["count"], "to": [[x] for x in mine["local"].tolist()]})
                            continue
                        graph = graph or _graph(folder, mine, g["links"])
                        found = _query(_load(folder, b["vectors"]), mine, graph, least)
                        if found is not None:
                            yield found
        give_back()

    found = scratch.table(pairs.mapInPandas(ask, "id long, n long, to array<long>"), "found")
    links = found.select(F.col("id").alias("a"), F.explode("to").alias("b"))
    parts = components(links, scratch, "cc")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = classes.select("id", "of", "v", "m").join(counts, "id", "left").join(parts, "id", "left")
    named = scratch.table(named.select(F.col("v").alias("_v"), "of", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), "component"), "named")
    least_ids = scratch.table(named.where("component is not null").groupBy("component").agg(F.min("of").alias("least")), "least_ids")
    named = join_sized(named, least_ids, "component", "left").select("_v", "n_links", F.coalesce("least", "of").alias("component_id"))
    able = rows.where("sound").join(named, F.col("v") == F.col("_v")).select("id", "n_links", "component_id")
    out = able.unionByName(rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    out = scratch.table(out, "judged")
    scratch.drop_but("judged")
    return out.select(F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
