"""Embedding near-dedup over hierarchical navigable small-world graphs.

Equal vectors collapse to one node with a count.  Nodes are dealt into shards
by a hash; each shard builds a layered graph: a node reaches up to a level
drawn from its id, every layer links a node to near but mutually diverse
neighbours, and a search descends layer by layer, then widens into a beam on
the lowest.  Every node queries every shard.

Beams widen for two reasons.  A shard is audited when it is built: the links
of a fixed set of nodes, its own and other shards', found by the beam, are held
against brute force, and the shard's beam doubles until the mean recall of the
nodes that have links passes (a beam as wide as the shard is exact).  And a query whose whole beam lies above the threshold
doubles its own beam until it does not, so large groups are found whole.

Links are decided by cosine in double precision.  A task returns each query's
number of links and only a spanning forest of them, which keeps the components
as they are without listing the pairs of a large group.

Defined results: null, empty and zero vectors and those with null or
non-finite entries link with nothing; vectors of different lengths do not
link.  Rows that repeat an id with the same vector count as vectors of their
own; a null id takes part but is never the smallest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import textops as X
from sitelens.llm.common import column, cut, session
from sitelens.llm.graph import components

COSINE = 0.9
LINKS, BEAM_BUILD, PEERS, BEAM = 10, 32, 12, 16
SHARD_ROWS, LEAST_SHARDS = 50_000, 6
QUERY_ROWS, COPIES = 1024, 8
AUDIT, AUDIT_DRAWS, RECALL = 128, 8, 0.999


class Graph:
    """Unit vectors ``x`` (float32) with neighbour lists by layer; -1: none.
    Layer k holds the nodes of level k or more."""

    def __init__(self, x: np.ndarray, keys: np.ndarray):
        self.x = np.ascontiguousarray(x, np.float32)
        u = (X.mix(keys.view(X.U)) >> X.U(11)).astype(np.float64) / 2.0 ** 53
        self.level = np.minimum((-np.log(np.maximum(u, 1e-300)) / np.log(LINKS)).astype(int), 8)
        self.layers = [np.full((len(x), LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(self.level.max()) + 1)]
        self.beam = BEAM
        self._build()

    def _build(self) -> None:
        order = np.argsort(-self.level, kind="stable")
        self.entry, done, size = int(order[0]), 1, 1
        while done < len(order):
            batch = order[done:done + size]
            self._insert(batch, order[:done])
            done += len(batch)
            size = min(512, done)

    def _insert(self, batch: np.ndarray, present: np.ndarray) -> None:
        q = self.x[batch]
        at = np.full((len(batch), 1), self.entry, np.int32)
        inside = q @ q.T
        np.fill_diagonal(inside, -2)
        for k in range(len(self.layers) - 1, -1, -1):
            mine = self.level[batch] >= k
            found, sims = self.search(q, k, at, BEAM_BUILD if mine.any() else 1)
            at = found[:, :1].copy()
            rows = np.flatnonzero(mine)
            if not len(rows):
                continue
            # Nodes of the same batch are neighbours as well.
            peers = np.where(mine[None, :], inside[rows], -2)
            best = np.argpartition(-peers, min(PEERS, peers.shape[1]) - 1, axis=1)[:, :PEERS]
            ids = np.concatenate([found[rows], np.where(np.take_along_axis(peers, best, 1) > -2, batch[best], -1)], 1)
            score = np.concatenate([sims[rows], np.take_along_axis(peers, best, 1)], 1)
            chosen = self._diverse(ids, np.where(ids >= 0, score, -3), LINKS)
            links = self.layers[k]
            links[batch[rows], :LINKS] = chosen
            self._link_back(k, np.repeat(batch[rows], LINKS), chosen.ravel())

    def _diverse(self, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the row
        than to any taken before; then the nearest of the rest."""
        order = np.argsort(-score, axis=1, kind="stable")
        ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
        n, width = ids.shape
        v = self.x[np.maximum(ids, 0)]
        near = np.full((n, width), -2.0, np.float32)  # to the nearest taken
        taken = np.zeros((n, width), bool)
        for j in range(width):
            ok = (ids[:, j] >= 0) & (near[:, j] < score[:, j]) & (taken.sum(1) < most)
            taken[ok, j] = True
            if ok.any() and j + 1 < width:
                s = np.einsum("nwd,nd->nw", v[ok, j + 1:], v[ok, j])
                near[ok, j + 1:] = np.maximum(near[ok, j + 1:], s)
        rank = np.where(taken, 0, 1) + np.where(ids < 0, 2, 0)
        keep = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, keep, 1)
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def _link_back(self, k: int, src: np.ndarray, dst: np.ndarray) -> None:
        links = self.layers[k]
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        if not len(dst):
            return
        at = X.groups(dst[1:] != dst[:-1])
        nth = np.arange(len(dst)) - np.repeat(at, np.diff(np.append(at, len(dst))))
        # All nodes at once; those with more than PEERS new links in further turns.
        for turn in range(int(nth.max()) // PEERS + 1):
            now = nth // PEERS == turn
            nodes, row = np.unique(dst[now], return_inverse=True)
            fresh = np.full((len(nodes), PEERS), -1, np.int32)
            fresh[row, nth[now] % PEERS] = src[now]
            old = links[nodes]
            fresh[(fresh[:, :, None] == old[:, None, :]).any(2)] = -1
            ids = np.concatenate([old, fresh], 1)
            score = np.einsum("nwd,nd->nw", self.x[np.maximum(ids, 0)], self.x[nodes])
            links[nodes] = self._diverse(ids, np.where(ids >= 0, score, -3), links.shape[1])

    def search(self, q: np.ndarray, k: int, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once on layer ``k``: the ``beam``
        nearest nodes found, nearest first (-1: fewer)."""
        links, n = self.layers[k], len(q)
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -2.0, np.float32)
        ids[:, 0] = start[:, 0]
        sims[:, 0] = np.einsum("nd,nd->n", self.x[start[:, 0]], q)
        open_ = ids >= 0
        seen = np.zeros((n, len(self.x)), bool)
        seen[np.arange(n), start[:, 0]] = True
        live = np.arange(n)
        while len(live):
            best = np.where(open_[live], sims[live], -3).argmax(1)
            has = open_[live, best]
            live, best = live[has], best[has]
            if not len(live):
                break
            open_[live, best] = False
            near = links[ids[live, best]]
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            row, col = np.nonzero(fresh)
            new = near[row, col]
            seen[live[row], new] = True
            s = np.full(near.shape, -2.0, np.float32)
            s[row, col] = np.einsum("nd,nd->n", self.x[new], q[live[row]])
            # Only queries with a node that enters their beam have anything to update.
            enters = s.max(1) > sims[live].min(1)
            if not enters.all():
                keep = np.flatnonzero(enters)
                ids_, near, s, fresh = live[keep], near[keep], s[keep], fresh[keep]
            else:
                ids_ = live
            ids2 = np.concatenate([ids[ids_], np.where(fresh, near, -1)], 1)
            sims2 = np.concatenate([sims[ids_], s], 1)
            open2 = np.concatenate([open_[ids_], fresh], 1)
            top = np.argpartition(-sims2, beam - 1, axis=1)[:, :beam]
            ids[ids_], sims[ids_], open_[ids_] = (np.take_along_axis(a, top, 1) for a in (ids2, sims2, open2))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def near(self, q: np.ndarray, least: float, beam: int | None = None) -> list[np.ndarray]:
        """Of each query: nodes found with a similarity of ``least`` or more."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(q)
        at = np.full((len(q), 1), self.entry, np.int32)
        for k in range(len(self.layers) - 1, 0, -1):
            at = self.search(q, k, at, 1)[0]
        todo, beam = np.arange(len(q)), min(beam or self.beam, len(self.x))
        while len(todo):
            rows = max(1, (64 << 20) // (len(self.x) + beam * 64))
            again = []
            for part in np.split(todo, range(rows, len(todo), rows)):
                if beam >= len(self.x):
                    hit = (q[part] @ self.x.T) >= least
                    for i, h in zip(part, hit):
                        out[i] = np.flatnonzero(h).astype(np.int32)
                    continue
                ids, sims = self.search(q[part], 0, at[part], beam)
                full = (ids[:, -1] >= 0) & (sims[:, -1] >= least)
                again.append(part[full])
                for i, r, s in zip(part[~full], ids[~full], sims[~full]):
                    out[i] = r[(s >= least) & (r >= 0)]
            todo = np.concatenate(again) if again else np.zeros(0, int)
            beam = min(2 * beam, len(self.x))
        return out

    def audit(self, least: float, target: float, others: np.ndarray | None = None) -> float:
        """Mean recall by query, for a fixed set of nodes that have links and
        for the ``others`` (vectors of other shards) that have; widens the beam
        until it reaches ``target``.  A small group's query counts as much as
        a large one's."""
        sample = np.unique(np.linspace(0, len(self.x) - 1, AUDIT * AUDIT_DRAWS).astype(int))
        q, truth = [], []
        for part in np.split(sample, range(AUDIT, len(sample), AUDIT)):
            near = self.x[part] @ self.x.T >= least
            near[np.arange(len(part)), part] = False  # a node's link to itself proves nothing
            has = near.any(1)
            q.append(self.x[part[has]])
            truth += [np.flatnonzero(t) for t in near[has]]
        own = np.unique(np.linspace(0, len(truth) - 1, AUDIT).astype(int)) if truth else []
        q, truth = np.concatenate(q)[own] if truth else self.x[:0], [truth[i] for i in own]
        if others is not None and len(others):
            near = others @ self.x.T >= least
            has = near.any(1)
            q = np.concatenate([q, others[has]])
            truth += [np.flatnonzero(t) for t in near[has]]
        while truth:
            found = self.near(q, least)
            recall = float(np.mean([np.isin(t, f).mean() for t, f in zip(truth, found)]))
            if recall >= target or self.beam >= len(self.x):
                return recall
            self.beam = min(2 * self.beam, len(self.x))
        return 1.0


def _unit(raw: list) -> np.ndarray:
    x = np.stack([np.frombuffer(b, ">f8") for b in raw]).astype(np.float64)
    return x / np.abs(x).max(1, keepdims=True)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indices of links that form a spanning forest of all."""
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = parent[p]
            v = p
        return v

    keep = []
    for i, (s, t) in enumerate(zip(a.tolist(), b.tolist())):
        s, t = find(s), find(t)
        if s != t:
            parent[s] = t
            keep.append(i)
    return keep


def _build(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """One shard's graph as arrays; ``asked``: nodes for the audit."""
    if not len(pdf):
        return pd.DataFrame(columns=["dim", "shard", "beam", "entry", "links", "nodes", "members", "vectors"], dtype=object)
    pdf = pdf.sort_values("node")
    x = _normal(_unit(pdf["raw"].tolist()))
    g = Graph(x, pdf["node"].to_numpy())
    asked = asked[asked["home"] != pdf["shard"].iloc[0]].sort_values("node")
    g.audit(COSINE, RECALL, _normal(_unit(asked["raw"].tolist())).astype(np.float32) if len(asked) else None)
    return pd.DataFrame({
        "dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "beam": [g.beam], "entry": [g.entry],
        "links": [[a.tobytes() for a in g.layers]], "nodes": [pdf["node"].to_numpy().tobytes()],
        "members": [pdf["members"].to_numpy().tobytes()], "vectors": [x.tobytes()]})


def _query(least: float):
    """Blocks of queries against one shard."""
    def run(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "other": pd.array([], "Int64")})]
        if len(asked) and len(index):
            r = index.iloc[0]
            node, members = np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["members"], np.int64)
            x = np.frombuffer(r["vectors"], np.float64).reshape(len(node), -1)
            g = Graph.__new__(Graph)
            g.x, g.beam, g.entry = x.astype(np.float32), int(r["beam"]), int(r["entry"])
            g.layers = [np.frombuffer(b, np.int32).reshape(len(node), -1) for b in r["links"]]
            for q_nodes, q_raw in zip(asked["q_nodes"], asked["q_raw"]):
                mine, q = np.frombuffer(q_nodes, np.int64), _normal(_unit(list(q_raw)))
                counts, a, b = np.zeros(len(mine), np.int64), [], []
                for i, found in enumerate(g.near(q.astype(np.float32), least - 1e-4)):
                    found = found[(x[found] @ q[i] >= least) & (node[found] != mine[i])]
                    counts[i] = members[found].sum()
                    a.append(np.full(len(found), mine[i]))
                    b.append(node[found])
                a, b = np.concatenate(a), np.concatenate(b)
                keep = _forest(a, b)
                has = np.flatnonzero(counts)
                out.append(pd.DataFrame({"node": np.concatenate([mine[has], a[keep]]),
                                         "links": np.concatenate([counts[has], np.zeros(len(keep), np.int64)]),
                                         "other": pd.array([None] * len(has) + b[keep].tolist(), "Int64")}))
        return pd.concat(out)
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                 shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links (other vectors at ``cosine`` or
    more), component_id (smallest id reachable), kept (whether it is the own)."""
    session(vectors)
    kind = "array<double>"
    rows = vectors.select(column(vectors, id_col, "vec_id", "bigint"), F.col(f"`{vector_col}`").cast(kind).alias("v"))
    good = (F.coalesce(F.size("v"), F.lit(0)) > 0) & F.coalesce(F.forall(
        "v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False)) \
        & F.coalesce(F.exists("v", lambda e: e != 0), F.lit(False))
    rows = rows.select("vec_id", good.alias("good"), F.when(good, F.col("v")).alias("v"))
    rows = cut(rows.withColumn("key", F.when(F.col("good"), F.xxhash64("v"))).withColumn("check", F.when(F.col("good"), F.hash("v"))))
    nodes = rows.where("good").groupBy("key", "check").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("members"), F.any_value("v").alias("v"))
    nodes = nodes.mapInPandas(_raw, "node long, check int, vec_id long, members long, raw binary, dim int")
    count = rows.count()
    shards = max(LEAST_SHARDS, -(-count // shard_rows))
    nodes = cut(nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")))
    # About 2 * AUDIT nodes of all, by hash, audit every shard but their own.
    asked = nodes.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(max(1, count // (2 * AUDIT)))) == 0) \
        .select("node", "raw", "dim", F.col("shard").alias("home")) \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    index = cut(nodes.groupBy("dim", "shard").cogroup(asked.groupBy("dim", "shard")).applyInPandas(
        _build, "dim int, shard int, beam long, entry long, links array<binary>, nodes binary, members binary, vectors binary"))
    blocks = max(1, -(-count // QUERY_ROWS))
    asked = (nodes.groupBy("dim", F.pmod(F.hash("node"), F.lit(blocks)).alias("block"))
             .applyInPandas(_block, "dim int, block int, q_nodes binary, q_raw array<binary>"))
    # Queries go to every shard; each shard's graph serves them in COPIES tasks.
    copies = min(COPIES, blocks)
    asked = (asked.withColumn("copy", F.pmod(F.col("block"), F.lit(copies)))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    index = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    keys = ["dim", "shard", "copy"]
    found = asked.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(_query(cosine), "node long, links long, other long")
    found = cut(found)
    total = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.where("other IS NOT NULL"), "node", "other")
    per = (nodes.select("node", "check", "members").join(total, "node", "left")
           .join(labels.withColumnRenamed("id", "node"), "node", "left")
           .select(F.col("node").alias("key"), "check", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"),
                   F.coalesce("component", "node").alias("component")))
    mine = rows.select("vec_id", "key", "check").join(per, ["key", "check"], "left")
    least = mine.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("least"))
    return (mine.join(least, "component", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def _raw(batches):
    for pdf in batches:
        v = [np.asarray(x, np.float64) for x in pdf["v"]]
        yield pd.DataFrame({"node": pdf["key"], "check": pdf["check"], "vec_id": pdf["vec_id"].astype("Int64"), "members": pdf["members"],
                            "raw": [x.astype(">f8").tobytes() for x in v], "dim": [len(x) for x in v]})


def _block(key, pdf):
    pdf = pdf.sort_values("node")
    return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "q_nodes": [pdf["node"].to_numpy().tobytes()], "q_raw": [pdf["raw"].tolist()]})
