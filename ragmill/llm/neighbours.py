"""Approximate nearest neighbours: a graph by NN-descent, searched greedily, in Spark joins."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, met, stored

EDGES = "id long, nb long, d double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vec (doubles as bytes) of vectors that take part.

    Null vectors, zero ones, those with null or non-finite components and those of another than the commonest length
    (the longer, if tied) take no part; nor do rows without an id. Rows that repeat an id count once, with the vector
    that sorts first.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    top = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size("v") == (top["size"] if top else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch["vec_id"], "vec": [np.asarray(x, np.float64).tobytes() for x in batch["v"]]})

    return rows.mapInPandas(pack, "vec_id long, vec binary")


def by_group(rows: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, *order: str) -> DataFrame:
    """`work` on each group of `keys`, streamed from sorted partitions; groups are small by construction."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            held = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            k = held[keys].to_numpy()
            bounds = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist()]
            out = [x for p, q in zip(bounds[:-1], bounds[1:], strict=True) if (x := work(held.iloc[p:q])) is not None]
            if out:
                yield pd.concat(out, ignore_index=True)[names]
            rest = held.iloc[bounds[-1] :]
        if rest is not None and len(rest) and (x := work(rest)) is not None:
            yield x[names]

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def matrix(vecs: pd.Series, kind: type = np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in double precision: the same for a pair either way and beside any other rows."""
    diff = np.ascontiguousarray(a, np.float64) - np.ascontiguousarray(b, np.float64)
    return (diff * diff).sum(1)


def local_join(keep: int) -> Callable[[pd.DataFrame], pd.DataFrame | None]:
    """Edges among the members (nb, vec, worst) of one group: each member's `keep` nearest others, if nearer than its worst."""

    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        n = len(rows)
        if n < 2:
            return None
        x, ids, worst = matrix(rows["vec"]), rows["nb"].to_numpy(), rows["worst"].to_numpy()
        square = (x * x).sum(1, dtype=np.float64)
        d = square[:, None] + square[None] - 2.0 * (x @ x.T)
        np.fill_diagonal(d, np.inf)
        k = min(keep, n - 1)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        a = np.repeat(np.arange(n), k)
        b = near.ravel()
        maybe = (d[a, b] < worst[a] + 1e-5 * (square[a] + square[b])) & (ids[a] != ids[b])
        a, b = a[maybe], b[maybe]
        # measured again by itself: a pair has one distance, in whatever group it meets
        d = squared(x[a], x[b])
        good = d < worst[a]
        return pd.DataFrame({"id": ids[a[good]], "nb": ids[b[good]], "d": d[good]}) if good.any() else None

    return work


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct edges of each id, by one shuffle; of equal edges the old one stays."""
    order = Window.partitionBy("id").orderBy("d", "nb", F.desc("old"))
    first = edges.withColumn("_before", F.lag("nb").over(order)).where("_before is null or _before <> nb").drop("_before")
    return first.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("d", "nb"))).where(F.col("_r") <= k).drop("_r")


def both_ways(graph: DataFrame) -> DataFrame:
    return graph.unionByName(graph.select(F.col("nb").alias("id"), F.col("id").alias("nb"), "d", "old"))


def descend(graph: DataFrame, nodes: DataFrame, k: int, around: int, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One round of build_graph(): the graph with the edges found among each node's `around` nearest (old = 0 if new).

    With it come these groups (id, nbs). Those with no member that wasn't in them `before` have all met already, at no
    lower bounds, so they need not meet again.
    """
    lists = stored(nearest(both_ways(graph), around).groupBy("id").agg(F.sort_array(F.collect_list("nb")).alias("nbs")), "graph-groups")
    members = lists
    if before is not None:
        none = F.array().cast("array<long>")
        members = lists.join(before.withColumnRenamed("nbs", "met").hint("merge"), "id", "left").where(F.size(F.array_except("nbs", F.coalesce("met", none))) > 0)
    members = members.select("id", F.explode("nbs").alias("nb"))
    together = members.join(bounds_of(graph, nodes, k).hint("merge"), "nb").withColumnRenamed("id", "g")
    fresh = by_group(together, ["g"], local_join(k), EDGES).withColumn("old", F.lit(0))
    return stored(nearest(graph.withColumn("old", F.lit(1)).unionByName(fresh), k), "graph-edges"), lists


def cells(nodes: DataFrame, starts: int, bits: int, seed: int) -> DataFrame:
    """id, s, cell: on which sides of `bits` random hyperplanes a node lies, for each of `starts` sets of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch["vec"]).astype(np.float64)
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(x.shape[1], starts * bits))
            sides = (x @ planes > 0).reshape(len(x), starts, bits)
            cell = sides @ (1 << np.arange(bits, dtype=np.int64))
            yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy(), starts), "s": np.tile(np.arange(starts), len(x)), "cell": cell.ravel()})

    return nodes.mapInPandas(run, "id long, s int, cell long")


def bounds_of(graph: DataFrame | None, nodes: DataFrame, k: int) -> DataFrame:
    """nb, vec, worst: each node with the distance of its farthest of k neighbours, infinite while it has fewer."""
    far = F.lit(float("inf"))
    if graph is None:
        return nodes.select(F.col("id").alias("nb"), "vec", far.alias("worst"))
    worst = graph.groupBy("id").agg(F.max("d").alias("worst"), F.count("*").alias("has")).select(F.col("id").alias("nb"), F.when(F.col("has") < k, far).otherwise(F.col("worst")).alias("worst"))
    return nodes.select(F.col("id").alias("nb"), "vec").join(worst.hint("merge"), "nb", "left").select("nb", "vec", F.coalesce("worst", far).alias("worst"))


def start_graph(nodes: DataFrame, n: int, k: int, starts: int, group: int, batch: int = 8) -> DataFrame:
    """A first graph: in each of `starts` random partitions of space, a node meets those of its cell.

    Cells come from as many hyperplanes as give about `group` nodes each; larger ones are dealt out by a hash, so a
    group has about that many at most, whatever the vectors are.
    """
    bits, graph = max(0, math.ceil(math.log2(max(1, n / group)))), None
    for seed in range(0, starts if bits else 1, batch):
        here = stored(cells(nodes, min(batch, starts) if bits else 1, bits, seed), "graph-cells")
        sizes = stored(here.groupBy("s", "cell").agg(F.ceil(F.count("*") / group).cast("int").alias("parts")), "graph-sizes")
        dealt = here.join(few(sizes), ["s", "cell"]).select("s", "cell", F.pmod(F.xxhash64("id", "s"), F.col("parts")).alias("part"), F.col("id").alias("nb"))
        dealt = dealt.join(bounds_of(graph, nodes, k).hint("merge"), "nb")
        fresh = by_group(dealt, ["s", "cell", "part"], local_join(k), EDGES).withColumn("old", F.lit(0))
        graph = stored(nearest(fresh if graph is None else graph.unionByName(fresh), k), "graph-edges")
    return graph.withColumn("old", F.lit(0))


def build_graph(nodes: DataFrame, k: int = 14, starts: int = 48, group: int = 1024, around: int = 24, still: float = 0.001) -> DataFrame:
    """id, nb, d, old: about the k nearest neighbours of each node (id, vec as 32-bit floats), by NN-descent.

    Every node first meets those of its cell in `starts` random partitions. Then, round by round, the `around` nearest
    of a node's neighbours and of those that name it meet each other, since a neighbour's neighbours are likely to be
    neighbours; a node keeps its k nearest. Groups are bounded by construction, so no node, however central, is one
    task's work. Rounds end when fewer than `still` of all edges are new, as in the paper on NN-descent: the last ones
    change hardly any list, and the search looks beyond a node's list anyway. d is the squared distance.
    """
    n = nodes.count()
    graph, groups = start_graph(nodes, n, k, starts, group), None
    while graph.where("old = 0").count() > still * k * n:
        graph, groups = descend(graph, nodes, k, around, groups)
    return graph


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, beam: int = 64, widen: int = 20) -> DataFrame:
    """query, id, d: the `beam` nearest nodes that a greedy search finds for each query (query, id: its own node).

    A query starts at its node. In each round the neighbours, either way, of its `widen` nearest nodes not yet looked
    at are measured, and the `beam` nearest kept; it ends when all of them have been looked at. A round is two equi-
    joins of the queries' frontiers, with the graph and with the vectors; state is a row for each query and node kept.
    """
    around = stored(nearest(both_ways(graph), 40).groupBy("id").agg(F.collect_list("nb").alias("nbs")), "graph-lists")
    own = queries.join(nodes.hint("merge"), "id").select("query", "id", F.col("vec").alias("qvec"))
    state = stored(own.select("query", "qvec", F.array(F.struct("id", F.lit(0.0).alias("d"), F.lit(False).alias("done"))).alias("beam")), "graph-state")
    schema = "query long, qvec binary, beam array<struct<id:long,d:double,done:boolean>>"

    def merge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        found = {x["id"]: (x["d"], x["done"]) for x in row["beam"]}
        todo = sorted((d, i) for i, (d, done) in found.items() if not done)[:widen]
        for d, i in todo:
            found[i] = d, True
        if len(right):
            for i, d in zip(right["id"].tolist(), squared(matrix(right["vec"]), np.frombuffer(row["qvec"], np.float32)).tolist(), strict=True):
                found.setdefault(i, (d, False))
        best = sorted((d, i, done) for i, (d, done) in found.items())[:beam]
        return pd.DataFrame({"query": [row["query"]], "qvec": [row["qvec"]], "beam": [[{"id": i, "d": d, "done": done} for d, i, done in best]]})

    while True:
        open_ = F.slice(F.array_sort(F.filter(F.transform("beam", lambda x: F.struct(x["d"].alias("d"), x["id"].alias("id"), x["done"].alias("done"))), lambda x: ~x["done"])), 1, widen)
        frontier = state.select(F.col("query").alias("of"), F.explode(open_).alias("x")).select("of", F.col("x.id").alias("id"))
        if frontier.isEmpty():
            break
        new = frontier.join(around.hint("merge"), "id").select("of", F.explode("nbs").alias("id")).repartition("id").distinct().join(nodes.hint("merge"), "id")
        state = stored(state.groupBy("query").cogroup(new.groupBy("of")).applyInPandas(merge, schema), "graph-state")
    return state.select("query", F.explode("beam").alias("x")).select("query", "x.id", "x.d")


def nearest_neighbours(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other vectors found for each vector whose id is_query() picks.

    Equal vectors are one node of the graph, so a vector that a third of all rows share is one node too; its rows
    (the k + 1 with the smallest ids, which is all that a rank can reach) come back at the end. score is the Euclidean
    distance of the original vectors in double precision; ranks go by score, then vec_id. See usable() for what takes
    no part. With fewer than k candidates all are returned; an empty table gives no rows; other columns are ignored.
    """
    rows = stored(usable(vectors), "knn-vectors")
    node = rows.groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))

    def greatest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"size": [np.abs(matrix(batch["vec"], np.float64)).max()]})

    # the search has 32-bit floats of at most 1, whatever the size of the vectors
    unit = rows.select("vec").mapInPandas(greatest, "size double").agg(F.max("size").alias("size")).first()["size"] or 1.0

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slim = [(np.frombuffer(x, np.float64) / unit).astype(np.float32).tobytes() for x in batch["vec"]]
            yield pd.DataFrame({"id": batch["id"], "n": batch["n"], "vec": slim, "exact": batch["vec"]})

    nodes = stored(node.mapInPandas(shorten, "id long, n long, vec binary, exact binary"), "knn-nodes")
    slim = nodes.select("id", "vec")
    graph = build_graph(slim)
    members = met(rows, nodes.select("id", "n", F.col("exact").alias("vec")), ["vec"], "n").select("id", "vec_id")
    members = stored(members, "knn-members")
    asked = members.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query"), "id")
    # queries of one node ask the same: the node is searched once
    found = search(graph, slim, asked.select("id").distinct().select(F.col("id").alias("query"), "id"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))).where(F.col("r") <= 2 * k + 2).select("query", "id")
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")
    measured = best.join(nodes.select("id", "exact").hint("merge"), "id").join(nodes.select(F.col("id").alias("query"), F.col("exact").alias("from")).hint("merge"), "query")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = matrix(batch["exact"], np.float64), matrix(batch["from"], np.float64)
                diff = a - b
                with np.errstate(over="ignore"):
                    score = np.sqrt((diff * diff).sum(1))
                out = ~np.isfinite(score) | (score < 1e-140)  # squares out of range are taken of parts of the greatest component
                score[out] = np.sqrt(((a[out] / unit - b[out] / unit) ** 2).sum(1)) * unit
                yield pd.DataFrame({"node": batch["query"], "id": batch["id"], "score": score})

    near = measured.mapInPandas(measure, "node long, id long, score double").join(few.hint("merge"), "id").select("node", "vec_id", "score")
    order = Window.partitionBy("node").orderBy("score", "vec_id")
    near = stored(near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r"), "knn-near")
    out = asked.withColumnRenamed("id", "node").join(near.hint("merge"), "node").where("vec_id <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
