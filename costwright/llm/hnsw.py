"""Embedding near-duplicates with a hierarchical navigable small-world graph per shard.

Equal vectors become one node first. Nodes are dealt to shards by a hash; each shard builds its
graph, and every node queries every shard, in blocks of queries of one home shard. A query's beam
widens until it finds a link or its worst entry is clearly below the threshold; a query that
finds one is compared with the whole shard, so it has all its links there or none. Each block then
audits itself on queries chosen by a hash: while too many of those that have links in the shard
have found none, the beam of all that found none doubles, and a beam as wide as the
shard is a full comparison. Links are verified by cosine in double precision. A block
reports its nodes' link counts, how often it found each node of the shard, and a spanning
forest of its links, never all pairs. A node that found nothing in a shard has the links that
the shard's nodes found to it.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costwright.llm.components import components
from costwright.llm.shared import written

LEAST_COSINE = 0.9
#: Links of a node on an upper layer; twice as many on the lowest.
LINKS = 16
#: Beam when building and first beam when searching.
BUILD_BEAM, BEAM = 64, 32
#: A beam is wide enough when its worst entry is this far below the threshold.
MARGIN = 0.03
#: Queries that a block audits, and the mean recall that those with a link have to reach.
AUDITED, RECALL = 512, 0.995
#: Most nodes of a shard and usual queries of a block; at least LEAST_SHARDS shards.
SHARD_NODES, BLOCK_QUERIES, LEAST_SHARDS = 25_000, 16_384, 6
#: Queries that walk a graph together; bounds the memory of what they have visited.
TOGETHER = 256


class Graph:
    """Unit vectors and the links of each layer; -1 marks a free place."""

    def __init__(self, units: np.ndarray, links: int = LINKS) -> None:
        self.units, self.links = units, links
        n = len(units)
        # layers are drawn with a fixed seed: building again gives the same graph
        draws = np.random.default_rng(n).random(n)
        self.level = np.minimum(np.floor(-np.log(1 - draws) / np.log(links)), 8).astype(int)
        self.layers = [np.full((n, links * (1 if i else 2)), -1, np.int32) for i in range(self.level.max(initial=0) + 1)]
        self.entry = -1

    def build(self) -> Graph:
        order = np.argsort(-self.level, kind="stable")  # upper layers are complete before lower ones fill
        done = 0
        while done < len(order):
            batch = order[done : done + max(1, min(done, TOGETHER))]
            self._insert(batch)
            done += len(batch)
        return self

    def _insert(self, batch: np.ndarray) -> None:
        if self.entry < 0:
            self.entry = int(batch[0])
            return
        vectors = self.units[batch]
        among = vectors @ vectors.T
        starts = np.full((len(batch), 1), self.entry)
        for layer in range(len(self.layers) - 1, -1, -1):
            ids, _ = self.walk(vectors, starts, layer, BUILD_BEAM if layer == 0 else BUILD_BEAM // 3)
            starts = ids[:, :1]
            here = np.flatnonzero(self.level[batch] >= layer)
            if not len(here):
                continue
            near = among[np.ix_(here, here)].copy()
            np.fill_diagonal(near, -2)
            width = min(self.links, len(here) - 1)
            peers = np.argsort(-near, axis=1)[:, :width]
            found = np.concatenate([ids[here], batch[here][peers]], axis=1)
            self.layers[layer][batch[here]] = chosen = self._select(batch[here], found, layer)
            self._link_back(batch[here], chosen, layer)

    def _select(self, nodes: np.ndarray, found: np.ndarray, layer: int) -> np.ndarray:
        """Of each node's candidates the nearest that are nearer to it than to one chosen before; then the nearest others."""
        most = self.layers[layer].shape[1]
        out = np.full((len(nodes), most), -1, np.int32)
        for at in range(0, len(nodes), 512):
            own, ids = nodes[at : at + 512], found[at : at + 512]
            sims = np.einsum("qcd,qd->qc", self.units[ids], self.units[own])
            sims[(ids < 0) | (ids == own[:, None])] = -3
            order = np.argsort(-sims, axis=1)
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            # the same candidate twice: near ones lie side by side only if equal, so compare ids
            ranked = np.argsort(ids, axis=1, kind="stable")
            by_id = np.take_along_axis(ids, ranked, 1)
            again = np.zeros(ids.shape, bool)
            np.put_along_axis(again, ranked[:, 1:], by_id[:, 1:] == by_id[:, :-1], 1)
            sims[again] = -3
            vectors = self.units[ids]
            between = vectors @ vectors.transpose(0, 2, 1)
            valid, closest = sims > -3, np.full(sims.shape, -2.0, np.float32)
            chosen, count = np.zeros(sims.shape, bool), np.zeros(len(own), int)
            for j in range(ids.shape[1]):
                take = valid[:, j] & (closest[:, j] < sims[:, j]) & (count < most)
                chosen[take, j] = True
                count += take
                closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
            place = np.argsort(~chosen * 2 + ~valid * 4, axis=1, kind="stable")[:, :most]
            kept = np.where(np.take_along_axis(valid, place, 1), np.take_along_axis(ids, place, 1), -1)
            out[at : at + 512, : kept.shape[1]] = kept
        return out

    def _link_back(self, nodes: np.ndarray, chosen: np.ndarray, layer: int) -> None:
        """The reverse links; a node whose places are full selects anew."""
        links = self.layers[layer]
        source, target = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.lexsort((source, target))
        source, target = source[order], target[order]
        ends = np.flatnonzero(np.concatenate((target[1:] != target[:-1], [True]))) + 1 if len(target) else []
        starts = np.concatenate(([0], ends[:-1])).astype(int) if len(target) else []
        if not len(starts):
            return
        width = int((ends - starts).max())
        added = np.full((len(starts), width), -1, np.int32)
        added[np.repeat(np.arange(len(starts)), ends - starts), np.arange(len(source)) - np.repeat(starts, ends - starts)] = source
        targets = target[starts]
        links[targets] = self._select(targets, np.concatenate([links[targets], added], axis=1), layer)

    def walk(self, vectors: np.ndarray, starts: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam nearest nodes (ids, cosines, nearest first; -1 where there are fewer) for each query."""
        parts = [
            self._walk(vectors[i : i + TOGETHER], starts[i : i + TOGETHER], layer, beam)
            for i in range(0, len(vectors), TOGETHER)
        ]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _walk(self, vectors: np.ndarray, starts: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        links, n, step = self.layers[layer], len(vectors), 3
        seen = np.zeros((n, len(self.units) + 1), bool)
        seen[:, -1] = True
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -2.0, np.float32)
        open_ = np.zeros((n, beam), bool)
        ids[:, : starts.shape[1]] = starts
        sims[:, : starts.shape[1]] = np.einsum("qsd,qd->qs", self.units[starts], vectors)
        open_[:, : starts.shape[1]] = True
        seen[np.arange(n)[:, None], starts] = True
        active = np.arange(n)
        while len(active):
            own_open = open_[active]
            first = np.argsort(~own_open, axis=1, kind="stable")[:, :step]  # entries are sorted: the nearest open ones
            use = np.take_along_axis(own_open, first, 1)
            own_open[np.arange(len(active))[:, None], first] = False
            open_[active] = own_open
            nodes = np.where(use, np.take_along_axis(ids[active], first, 1), -1)
            new = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(active), -1).astype(np.int64)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[active[:, None], new]] = -1
            seen[active[:, None], new] = True
            near = np.einsum("qcd,qd->qc", self.units[new], vectors[active])
            near[new < 0] = -2
            all_ids, all_sims = np.concatenate([ids[active], new], 1), np.concatenate([sims[active], near], 1)
            all_open = np.concatenate([open_[active], new >= 0], 1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[active] = np.take_along_axis(all_ids, order, 1)
            sims[active] = np.take_along_axis(all_sims, order, 1)
            open_[active] = np.take_along_axis(all_open, order, 1)
            active = active[open_[active].any(axis=1)]
        return ids, sims

    def nearest(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Down the layers from the entry, then the beam nearest nodes of the lowest one."""
        starts = np.full((len(vectors), 1), self.entry)
        for layer in range(len(self.layers) - 1, 0, -1):
            starts = self.walk(vectors, starts, layer, 4)[0][:, :1]
        return self.walk(vectors, starts, 0, beam)

    def to_bytes(self, units: bool = True) -> bytes:
        out = io.BytesIO()
        layers = {f"layer{i}": x for i, x in enumerate(self.layers)}
        known = {"units": self.units} if units else {}
        np.savez(out, level=self.level, entry=self.entry, **known, **layers)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, units: np.ndarray | None = None) -> Graph:
        """units: the unit vectors, where they were not written."""
        held = np.load(io.BytesIO(data))
        graph = cls.__new__(cls)
        graph.units, graph.level, graph.entry = held["units"] if units is None else units, held["level"], int(held["entry"])
        graph.layers = [held[f"layer{i}"] for i in range(graph.level.max(initial=0) + 1)]
        graph.links = graph.layers[0].shape[1] // 2
        return graph


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; those whose squares would overflow or vanish are scaled first."""
    largest = np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    vectors = vectors / np.where((largest > 1e150) | (largest < 1e-150), largest, 1)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def links_of(
    graph: Graph, exact: np.ndarray, queries: np.ndarray, least: float, own: np.ndarray | None = None
) -> list[np.ndarray]:
    """Places of the shard's vectors with cosine of at least `least` to each query; exact, queries: unit, double.

    own: the place of each query itself, which is no link, or -1.
    """
    single = queries.astype(np.float32)
    own = np.full(len(queries), -1) if own is None else own
    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)

    def compared(which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(which), TOGETHER):
            part = which[at : at + TOGETHER]
            for q, row in zip(part, queries[part] @ exact.T >= least):
                links = np.flatnonzero(row)
                yield q, links[links != own[q]]

    def complete(which: np.ndarray) -> None:
        for q, links in compared(which):
            found[q] = links

    def search(which: np.ndarray, beam: int) -> None:
        while len(which):
            if beam >= len(exact):
                return complete(which)
            ids, sims = graph.nearest(single[which], beam)
            rows, places = np.nonzero((ids >= 0) & (sims >= least - MARGIN))
            hits = ids[rows, places]
            good = (np.einsum("ij,ij->i", exact[hits], queries[which[rows]]) >= least) & (hits != own[which[rows]])
            some = np.zeros(len(which), bool)
            some[rows[good]] = True
            complete(which[some])
            which = which[~some & (sims[:, -1] >= least - MARGIN)]
            beam *= 2

    beam = BEAM
    search(np.arange(len(queries)), beam)
    audited = np.argsort([zlib.crc32(q.tobytes()) for q in queries], kind="stable")[:AUDITED]
    truth = {q: links for q, links in compared(audited) if len(links)}
    # a query has all its links or none, so its recall is 1 or 0
    while beam < len(exact) and sum(len(found[q]) > 0 for q in truth) < RECALL * len(truth):
        beam *= 2
        search(np.array([q for q in range(len(queries)) if not len(found[q])], int), beam)
    for q, links in truth.items():
        found[q] = links
    return found


def _index(nodes: pd.DataFrame) -> pd.DataFrame:
    given = np.stack(nodes["vec"].to_numpy()).astype(np.float64)
    graph = Graph(unit(given).astype(np.float32)).build()
    out = io.BytesIO()
    with np.errstate(over="ignore", under="ignore"):
        single = given.astype(np.float32)
    lean = single if (single == given).all() else given  # vectors that came as floats travel as floats
    np.savez(out, vec=lean, node=nodes["node"].to_numpy(), copies=nodes["copies"].to_numpy())
    return pd.DataFrame(
        {"dim": [given.shape[1]], "shard": [nodes["shard"].iloc[0]], "graph": [graph.to_bytes(False)], "data": [out.getvalue()]}
    )


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _search(queries: pd.DataFrame, index: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of query nodes of one home shard into this shard.

    Per query node n, the rows that it links to here, with this shard as home; per node of this shard back, the rows of the
    queries that link to it, with the queries' home; and forest links (a, b) without counts.
    """
    if not len(queries) or not len(index):
        return pd.DataFrame({c: [] for c in ("a", "b", "home", "n", "back")})
    held = np.load(io.BytesIO(index["data"].iloc[0]))
    exact, node, copies = unit(held["vec"].astype(np.float64)), held["node"], held["copies"]
    graph = Graph.from_bytes(index["graph"].iloc[0], exact.astype(np.float32))
    vectors, own = unit(np.stack(queries["vec"].to_numpy()).astype(np.float64)), queries["node"].to_numpy()
    place = {x: i for i, x in enumerate(node.tolist())}
    found = links_of(graph, exact, vectors, least, np.array([place.get(x, -1) for x in own.tolist()]))
    sizes = [len(f) for f in found]
    shard, home = int(index["shard"].iloc[0]), int(queries["home"].iloc[0])
    a, hits = np.repeat(own, sizes), np.concatenate(found)
    back = np.bincount(hits, np.repeat(queries["copies"].to_numpy(), sizes), len(node)).astype(np.int64)
    rows = [(int(q), None, shard, int(copies[f].sum()), None) for f, q in zip(found, own) if len(f)]
    rows += [(int(node[i]), None, home, None, int(back[i])) for i in np.flatnonzero(back)]
    rows += [(x, y, None, None, None) for x, y in _forest(a, node[hits])]
    return pd.DataFrame(rows, columns=["a", "b", "home", "n", "back"]).astype("Int64")


def near_duplicates(
    embeddings: DataFrame, least: float = LEAST_COSINE, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """id, n_links, component_id, kept for every row.

    n_links counts the other vectors with a cosine of at least `least`, component_id is the least
    id reachable by links, kept marks the row that has it. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do rows without an id (whose component_id is
    null and kept false); vectors of different lengths are not compared. Repeated rows
    count as one vector and each get its result; rows that share an id and have different vectors are
    vectors of their own, which share a node and so a component. An empty table gives no rows; other
    columns are not read.
    """
    rows = embeddings.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    sound = rows.filter("id is not null and size(vec) > 0").filter(
        "forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)"
    )
    nodes = sound.distinct().groupBy("vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes, "vectors")
    total = nodes.count()
    shards = max(LEAST_SHARDS, -(-total // SHARD_NODES))
    own_blocks = max(1, round(total / shards / BLOCK_QUERIES))
    blocks = shards * own_blocks
    sharded = nodes.withColumn("dim", F.size("vec")).withColumn("shard", F.expr(f"cast(pmod(xxhash64(node), {shards}) as int)"))
    index = sharded.groupBy("dim", "shard").applyInPandas(_index, "dim int, shard int, graph binary, data binary")
    index = written(index, "graphs").withColumn("block", F.explode(F.expr(f"sequence(0, {blocks - 1})")))
    queries = (
        sharded.select("dim", "node", "vec", "copies", F.col("shard").alias("home"))
        .withColumn("block", F.expr(f"cast(home * {own_blocks} + pmod(xxhash64(node, 1), {own_blocks}) as int)"))
        .withColumn("shard", F.explode(F.expr(f"sequence(0, {shards - 1})")))
    )
    keys = ("dim", "shard", "block")
    found = written(
        queries.groupBy(*keys)
        .cogroup(index.groupBy(*keys))
        .applyInPandas(lambda q, i: _search(q, i, least), "a long, b long, home long, n long, back long"),
        "links",
    )
    # a node has found all its links into a home shard or none, so the greater count has each link once
    counts = found.filter("home is not null").groupBy(F.col("a").alias("node"), "home").agg(F.sum("n").alias("n"), F.sum("back").alias("back"))
    counts = counts.groupBy("node").agg(F.sum(F.greatest("n", "back")).alias("n"))
    grouped = components(found.filter("b is not null").select("a", "b"))
    result = (
        nodes.join(counts, "node", "left")
        .join(grouped, "node", "left")
        .select(
            "vec",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    return (
        rows.join(result.withColumnRenamed("vec", "__vec"), F.expr("id is not null and vec = __vec"), "left")
        .select(
            F.col("id").alias(id_column),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(False)))
    )
