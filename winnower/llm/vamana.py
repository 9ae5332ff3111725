"""Approximate nearest neighbours by a robust-pruned directed graph over each shard of the vectors.

Equal vectors are one node. Each shard's graph starts at random and is improved in two passes: a greedy search
from the most central node proposes neighbours for each node, and relaxed pruning keeps a proposal only if no
kept neighbour is closer to it than the node is, by the factor alpha; kept edges are also proposed in the
other direction. A query is answered by beam search in every shard, and the shards' answers are merged.
Queries are packed in blocks of bounded size, and each block streams past each shard, which is sent once.

Defined results: vectors that are null, empty, zero, or hold a null or a non-finite component take no part, nor do
rows with a null id; only vectors of the query's own length are its candidates; rows that repeat id and vector
count once; equal distances go by the smaller id; an empty table gives an empty result; columns besides vec_id
and embedding are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnower.llm.common import materialize

LEAST_ROWS = 4096
SHARD_BYTES = 64 << 20
QUERY_BLOCK = 1024
DEGREE = 32
BUILD_BEAM = 48
SEARCH_BEAM = 96
ALPHA = 1.2
BATCH = 512


def distances(points: np.ndarray, ids: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ids (-1: none) to each query."""
    out = np.full(ids.shape, np.inf, query.dtype)
    row, column = np.nonzero(ids >= 0)
    gap = points[ids[row, column]]
    gap -= query[row]
    out[row, column] = np.einsum("nd,nd->n", gap, gap)
    return out


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, query: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each query the nodes of its final beam, nearest first (-1: none), and their squared distances."""
    rows = np.arange(len(query))[:, None]
    ids = np.full((len(query), beam), -1)
    ids[:, 0] = start
    far = distances(points, ids, query)
    open_ = ids >= 0
    live = np.arange(len(query))
    while len(live):
        at = np.argsort(~open_[live], axis=1, kind="stable")[:, :step]
        chosen = np.where(np.take_along_axis(open_[live], at, 1), np.take_along_axis(ids[live], at, 1), -1)
        mark = open_[live]
        np.put_along_axis(mark, at, False, 1)
        open_[live] = mark
        new = np.where(chosen[:, :, None] >= 0, graph[chosen], -1).reshape(len(live), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[(new[:, :, None] == ids[live][:, None, :]).any(2)] = -1
        both = np.concatenate([ids[live], new], 1)
        d = np.concatenate([far[live], distances(points, new, query[live])], 1)
        o = np.concatenate([open_[live], new >= 0], 1)
        order = np.argsort(d, axis=1, kind="stable")[:, :beam]
        here = rows[: len(live)]
        ids[live], far[live], open_[live] = both[here, order], d[here, order], o[here, order]
        open_[live] &= ids[live] >= 0
        live = live[open_[live].any(1)]
    return ids, far


def prune(points: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """At most degree diverse neighbours for each node from rows of proposals (-1: none)."""
    proposed = np.where(proposed == nodes[:, None], -1, np.sort(proposed, axis=1))
    proposed = np.sort(np.where(proposed == nodes[:, None], -1, proposed), axis=1)
    proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = -1
    d = distances(points, proposed, points[nodes])
    order = np.argsort(d, axis=1, kind="stable")
    proposed, d = np.take_along_axis(proposed, order, 1), np.take_along_axis(d, order, 1)
    kept, rows = np.full((len(nodes), degree), -1), np.arange(len(nodes))
    alive = proposed >= 0
    for k in range(degree):
        if not alive.any():
            break
        first = alive.argmax(1)
        some = alive[rows, first]
        best = np.where(some, proposed[rows, first], -1)
        kept[:, k] = best
        between = distances(points, proposed, points[best])
        alive &= ~((alpha * alpha * between <= d) & some[:, None])
        alive[rows, first] = False
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """Neighbours of each point (-1: none) and the node where searches start.

    A node takes edges in the other direction until its list is half as long again; then it is pruned to degree.
    """
    n, draw, room = len(points), np.random.default_rng(seed), degree + degree // 2
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, room), -1)
    if n > 1:
        some = min(degree // 2, n - 1)
        graph[:, :some] = (np.arange(n)[:, None] + draw.integers(1, n, (n, some))) % n

    def put(nodes: np.ndarray, proposed: np.ndarray, relaxed: float) -> None:
        graph[nodes, degree:] = -1
        graph[nodes, :degree] = prune(points, nodes, proposed, relaxed, degree)

    for relaxed in (1.0, alpha):
        order = draw.permutation(n)
        for i in range(0, n, BATCH):
            nodes = order[i : i + BATCH]
            found, _ = beam_search(points, graph, start, points[nodes], beam)
            put(nodes, np.concatenate([found, graph[nodes]], 1), relaxed)
            source, target = np.repeat(nodes, degree), graph[nodes, :degree].ravel()
            fresh = target >= 0
            fresh[fresh] = ~(graph[target[fresh]] == source[fresh][:, None]).any(1)
            source, target = source[fresh], target[fresh]
            order_in = np.argsort(target, kind="stable")
            source, target = source[order_in], target[order_in]
            ends, begin, many = np.unique(target, return_index=True, return_counts=True)
            graph[ends] = np.take_along_axis(graph[ends], np.argsort(graph[ends] < 0, axis=1, kind="stable"), 1)  # free places last
            have = (graph[ends] >= 0).sum(1)
            fits = have + many <= room
            which = np.repeat(np.arange(len(ends)), many)
            place = (have - begin)[which] + np.arange(len(target))
            add = fits[which]
            graph[target[add], place[add]] = source[add]
            for j in range(0, int(many[~fits].max()) if not fits.all() else 0, degree):  # a block of proposals at a time
                more = ~fits & (many > j)
                take = begin[more, None] + j + np.arange(degree)
                extra = np.where(np.arange(degree) < (many[more] - j)[:, None], source[np.minimum(take, len(source) - 1)], -1)
                put(ends[more], np.concatenate([graph[ends[more]], extra], 1), relaxed)
    for i in range(0, n, BATCH):
        full = i + np.flatnonzero((graph[i : i + BATCH] >= 0).sum(1) > degree)
        put(full, graph[full], alpha)
    graph = np.take_along_axis(graph, np.argsort(graph < 0, axis=1, kind="stable"), 1)[:, :degree]
    return connect(points, graph, start, beam), start


def reached(graph: np.ndarray, seen: np.ndarray, start: int) -> None:
    """Marks in seen what can be reached from start."""
    front = np.array([start])
    while len(front):
        seen[front] = True
        front = np.unique(graph[front])
        front = front[front >= 0]
        front = front[~seen[front]]


def connect(points: np.ndarray, graph: np.ndarray, start: int, beam: int) -> np.ndarray:
    """Adds an edge to each part that no search would reach (outliers), from the nearest node that one reaches."""
    seen = np.zeros(len(points), bool)
    reached(graph, seen, start)
    while not seen.all():
        lost = int((~seen).argmax())
        found, _ = beam_search(points, graph, start, points[[lost]], beam)
        near = int(found[0, 0])
        slot = np.flatnonzero(graph[near] < 0)
        if not len(slot):
            graph = np.concatenate([graph, np.full((len(graph), 4), -1)], 1)
            slot = np.flatnonzero(graph[near] < 0)
        graph[near, slot[0]] = lost
        reached(graph, seen, lost)
    return graph


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles, no negative zero) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    return rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))


def shard_rows(rows: int, width: int) -> int:
    """Shards grow with the square root of the table, so that queries meet fewer of them, within what a worker can hold."""
    return min(max(LEAST_ROWS, 8 * math.isqrt(rows)), max(LEAST_ROWS // 4, SHARD_BYTES // (8 * width)))


def build_index(vectors: DataFrame, neighbours: int) -> tuple[DataFrame, DataFrame]:
    """A row for each shard: its vectors, their ids (the smallest neighbours + 1 of each vector) and its graph. And, by length of vectors, the shards."""
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    least = vectors.distinct().withColumn("_n", nth).where(F.col("_n") <= neighbours + 1)
    nodes = materialize(least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("width", F.size("embedding")), "nodes")
    numbered, total = [], 0
    for width, rows in sorted(tuple(r) for r in nodes.groupBy("width").count().collect()):  # a row for each length of vectors
        count = -(-rows // shard_rows(rows, width))
        numbered.append((width, total, count))
        total += count
    shards = vectors.sparkSession.createDataFrame(numbered, "width int, first int, count int")
    dealt = nodes.join(F.broadcast(shards), "width")
    dealt = dealt.select("width", (F.col("first") + F.pmod(F.xxhash64(F.col("ids")[0]), F.col("count"))).cast("int").alias("shard"), "embedding", "ids")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ids", key=lambda s: s.str[0])
        points = np.stack(part["embedding"].to_list()).astype(np.float64)
        graph, start = build_graph(points.astype(np.float32))
        many = part["ids"].str.len().to_numpy(np.int32)
        return pd.DataFrame(
            {
                "shard": [part["shard"].iloc[0]], "width": [points.shape[1]], "start": [start], "points": [points.tobytes()], "graph": [graph.astype(np.int32).tobytes()],
                "many": [many.tobytes()], "ids": [np.concatenate(part["ids"].to_list()).astype(np.int64).tobytes()],
            }
        )

    schema = "shard int, width int, start int, points binary, graph binary, many binary, ids binary"
    return materialize(dealt.repartitionById(max(1, total), "shard").groupBy("shard").applyInPandas(build, schema), "graph"), shards


def in_blocks(queries: DataFrame, shards: DataFrame) -> DataFrame:
    """Queries (vec_id, embedding, width) as a row for each block of them and shard of their length."""
    blocks = queries.groupBy("width").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    dealt = queries.join(F.broadcast(blocks), "width").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))

    def put_together(part: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = part["vec_id"].to_numpy(np.int64), np.stack(part["embedding"].to_list()).astype(np.float64)
        return pd.DataFrame({"width": [vectors.shape[1]], "query_ids": [ids.tobytes()], "queries": [vectors.tobytes()]})

    packed = materialize(dealt.groupBy("width", "block").applyInPandas(put_together, "width int, query_ids binary, queries binary"), "queries")
    return packed.join(F.broadcast(shards), "width").select(F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)).alias("shard"), "query_ids", "queries")


class Shard:
    """A shard's vectors, ids and graph, as a worker searches them."""

    def __init__(self, row: dict) -> None:
        self.points = np.frombuffer(row["points"]).reshape(-1, row["width"])
        self.rough = self.points.astype(np.float32)
        self.graph = np.frombuffer(row["graph"], np.int32).reshape(len(self.points), -1)
        self.many, self.members = np.frombuffer(row["many"], np.int32), np.frombuffer(row["ids"], np.int64)
        self.begin, self.start = np.cumsum(self.many) - self.many, row["start"]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, neighbours: int, beam: int) -> pd.DataFrame:
        """The nearest of a block of queries: query_id, vec_id, score."""
        queries, best = queries.reshape(-1, self.points.shape[1]), []
        for i in range(0, len(queries), BATCH):
            found, _ = beam_search(self.rough, self.graph, self.start, queries[i : i + BATCH].astype(np.float32), min(beam, max(neighbours + 1, len(self.points))))
            found = found[:, : 2 * neighbours + 1]  # single precision only ranks the beam
            q, k = np.nonzero(found >= 0)
            node = found[q, k]
            gap = self.points[node] - queries[i + q]
            score = np.sqrt((gap * gap).sum(1))
            count = self.many[node]
            at = np.repeat(self.begin[node] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            got = pd.DataFrame({"query_id": np.repeat(query_ids[i + q], count), "vec_id": self.members[at], "score": np.repeat(score, count)})
            got = got[got["query_id"] != got["vec_id"]]
            best.append(got.sort_values(["query_id", "score", "vec_id"]).groupby("query_id").head(neighbours))
        return pd.concat(best)


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search_shards(index: DataFrame, blocks: DataFrame, count: int, neighbours: int, beam: int) -> DataFrame:
    """query_id, vec_id and score of each shard's nearest. A shard comes once, before the blocks of queries, which stream past it."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    held = ("width", "start", "points", "graph", "many", "ids")
    shards = index.select("shard", F.lit(0).alias("kind"), *held, none("query_ids", "binary"), none("queries", "binary"))
    asked = blocks.select("shard", F.lit(1).alias("kind"), *(none(c, "int" if c in held[:2] else "binary") for c in held), "query_ids", "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["kind"] == 0:
                    shard = Shard(row)
                else:
                    found = shard.search(np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["queries"]), neighbours, beam)
                    yield pa.RecordBatch.from_pandas(found, schema=FOUND, preserve_index=False)

    ordered = shards.union(asked).repartitionById(max(1, count), "shard").sortWithinPartitions("shard", "kind")
    return ordered.groupBy("shard").applyInArrow(search, "query_id long, vec_id long, score double")


def nearest(embeddings: DataFrame, every: int = 100, neighbours: int = 10, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the nearest found for each id divisible by every."""
    vectors = usable(embeddings)
    index, shards = build_index(vectors, neighbours)
    queries = vectors.where(F.col("vec_id") % every == 0).distinct().withColumn("width", F.size("embedding"))

    total = shards.agg(F.sum("count")).first()[0] or 0
    answers = search_shards(index, in_blocks(queries, shards), total, neighbours, beam)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return answers.withColumn("rank", place).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
