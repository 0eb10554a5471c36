"""Exact top-k by inner product: dual-tree search over cover trees.

Queries are a stated set; they come in waves of a bounded number of rows, which are sent to every task.  Each task indexes the wave by a
cover tree once, and each of its blocks of candidates by another, and walks both trees together: a pair of nodes
is dropped with all below it if no inner product in it can reach the worst kth score in the query node, by

    max <q, x>  <=  <cq, cx> + |cq| rx + |cx| rq + rq rx        (c: centres, r: covering radii)

Scores are exact integers.  The blocks' top k are merged by an ordinary ranking a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import table, written

LEAF, QUERY_LEAF = 64, 16
#: So many balls of a few points in a row end the search for balls in a node.
POOR = 48
#: Candidates of one tree; a task builds one tree after another.
BLOCK = 4096
#: Queries of one wave: so many rows, and no more, are sent to every task.
WAVE = 16_384
#: And so many bytes of vectors.
WAVE_BYTES = 32 << 20
_EXACT = 1 << 53


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products as exact long integers; those beyond a long are held at its ends."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    big = 1 << 63
    return np.array([[min(max(int(x), -big), big - 1) for x in row] for row in exact], np.int64).reshape(len(a), len(b))


class CoverTree:
    """Nested covers of ``points`` (floats that hold integers): a node's children are balls of half its radius.

    Balls of a few points are not worth nodes of their own; they go, nearest first, into leaves around the node's centre.
    Nodes are in arrays: centre, covering radius of all points below, first and last of these in ``order``, children.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order, self.leaf = points, np.arange(len(points)), leaf
        self.square = np.einsum("ij,ij->i", points, points)
        # Distances come from squares; so much can they be off.
        self.loose = 4e-8 * float(np.sqrt(self.square.max(initial=0.0)))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        if len(points):
            own = np.arange(len(points))
            self._grow(0, self._far(0, own), own, 0)
        self.radii = np.array(self.radius)
        self.centres = points[self.centre]
        self.norm = np.sqrt(self.square[self.centre])

    def _far(self, pivot: int, own: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square[own] + self.square[pivot] - 2 * (self.points[own] @ self.points[pivot]), 0))

    def _node(self, centre: int, far: np.ndarray, own: np.ndarray, at: int) -> int:
        self.centre.append(centre)
        self.radius.append(float(far.max(initial=0.0)) + self.loose)
        self.span.append((at, at + len(own)))
        self.children.append([])
        self.order[at : at + len(own)] = own
        return len(self.centre) - 1

    def _grow(self, centre: int, far: np.ndarray, own: np.ndarray, at: int) -> int:
        """Add the node of the points ``own``, at distances ``far`` from ``centre``; they take places from ``at`` on."""
        node = self._node(centre, far, own, at)
        radius = float(far.max(initial=0.0))
        if len(own) <= self.leaf or not self.loose < radius < np.inf:
            return node
        pivot, rest, near, few, poor = centre, np.arange(len(own)), far, [], 0
        while len(rest):
            if poor == POOR:  # no half-radius balls worth a node here: the points are about as far from each other as from the centre
                few.append(rest)
                break
            inside = near <= radius / 2
            if pivot != centre:
                inside |= own[rest] == pivot
            got = rest[inside]
            if len(got) * 4 > self.leaf:
                self.children[node].append(self._grow(pivot, near[inside], own[got], at))
                at += len(got)
                poor = 0
            else:
                few.append(got)
                poor += 1
            rest = rest[~inside]
            if len(rest):
                pivot = int(own[rest[0]])
                near = self._far(pivot, own[rest])
        if few:
            left = np.concatenate(few)
            left = left[np.argsort(far[left], kind="stable")]
            for k in range(0, len(left), self.leaf):
                part = left[k : k + self.leaf]
                self.children[node].append(self._node(centre, far[part], own[part], at))
                at += len(part)
        return node


def search(queries: CoverTree, q_ids: np.ndarray, data: CoverTree, d_ids: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query position, ids, scores): each query's ``k`` best in ``data`` but itself, if they reach ``floor`` (a score a query).

    ``d_ids`` holds per point the sorted ids of its copies.  Ties go to smaller ids.
    """
    n = len(queries.points)
    best_s: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    best_i: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    worst = floor.astype(np.float64).copy()
    if not n or not len(data.points):
        return
    slack = 1e-9

    def bounds(a: list[int], b: list[int]) -> np.ndarray:
        """What inner products can reach at most, for every pair of a node of ``a`` and one of ``b``."""
        dot = queries.centres[a] @ data.centres[b].T
        na, nb, ra, rb = queries.norm[a][:, None], data.norm[b], queries.radii[a][:, None], data.radii[b]
        reach = na * rb + nb * ra + ra * rb
        return dot + reach + slack * (na * nb + reach + 1)

    stack = [(float(bounds([0], [0])[0, 0]), 0, 0)]
    while stack:
        top, a, b = stack.pop()
        qs = queries.order[slice(*queries.span[a])]
        if top < worst[qs].min():
            continue
        below_a, below_b = queries.children[a], data.children[b]
        if below_a or below_b:
            xs, ys = below_a or [a], below_b or [b]
            tops = bounds(xs, ys)
            bar = np.array([worst[queries.order[slice(*queries.span[x])]].min() for x in xs])[:, None]
            i, j = np.nonzero(~(tops < bar))
            # The most promising pair is taken first.
            stack += sorted((float(tops[m, n]), xs[m], ys[n]) for m, n in zip(i.tolist(), j.tolist(), strict=True))
            continue
        ds = data.order[slice(*data.span[b])]
        scores = products(queries.points[qs], data.points[ds])
        reach = scores.max(axis=1) >= worst[qs]
        for row, q in zip(scores[reach], qs[reach], strict=True):
            near = np.flatnonzero(row >= worst[q])
            ids = np.concatenate([d_ids[ds[x]] for x in near])
            own = np.repeat(row[near], [len(d_ids[ds[x]]) for x in near])
            other = ids != q_ids[q]
            ids, own = np.concatenate([best_i[q], ids[other]]), np.concatenate([best_s[q], own[other]])
            keep = np.lexsort((ids, -own))[:k]
            best_i[q], best_s[q] = ids[keep], own[keep]
            if len(keep) == k:
                worst[q] = max(worst[q], float(own[keep][-1]))
    for q in range(n):
        if len(best_i[q]):
            yield q, best_i[q], best_s[q]


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, wave: int = WAVE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest inner products of floor(scale * component) vectors, but its own.

    Vectors that are null or hold a null, NaN or infinite component, and rows without an id, take no part; shorter vectors count as
    ended by zeros.  All rows of the query's own id are its own.  Ties go to the smaller id; repeated rows are
    candidates each, and one query.  Fewer candidates than ``k`` give them all; an empty table gives no rows.  Queries beyond one
    wave go wave by wave, each of which is written before the next one is sent.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    usable = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & F.coalesce(whole, F.lit(False)))
    usable = usable.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: v.cast("double")).alias("raw"), is_query.alias("is_query"))
    stated = usable.where("is_query").groupBy("vec_id").agg(F.min("raw").alias("raw"))
    told = stated.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("raw")), F.lit(1)).alias("width")).first()
    wave = max(64, min(wave, WAVE_BYTES // (8 * max(told["width"], 1))))
    out, rest = None, stated.toLocalIterator()  # the driver holds one partition's queries and one wave
    while rows := list(islice(rest, wave)):
        part, held = _wave(spark, usable, rows, k, scale)
        if told["n"] > wave:
            part = written(part)
            held.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out, _ = _wave(spark, usable, [], k, scale)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _wave(spark: SparkSession, usable: DataFrame, rows: list, k: int, scale: int) -> tuple[DataFrame, Broadcast]:
    q_ids = np.array([r["vec_id"] for r in rows], np.int64)
    raw = _matrix(pa.array([r["raw"] for r in rows], pa.list_(pa.float64()))) if rows else np.zeros((0, 0))
    sent = spark.sparkContext.broadcast((q_ids, np.floor(raw * scale)))  # at most WAVE vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = sent.value
        held_i: list[np.ndarray] = []
        held_x: list[np.ndarray] = []
        floor = np.full(len(ids), -np.inf)
        trees: dict[int, CoverTree] = {}

        def flush() -> pa.RecordBatch:
            width = max([points.shape[1], *(x.shape[1] for x in held_x)])
            wide = [np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in held_x]
            own, block = np.concatenate(held_i), np.concatenate(wide)
            held_i.clear()
            held_x.clear()
            # Copies of a vector are one point; of their ids only the k + 1 smallest can be among a query's best.
            distinct, where = np.unique(block, axis=0, return_inverse=True)
            order = np.lexsort((own, where.ravel()))
            cuts = np.flatnonzero(np.diff(where.ravel()[order])) + 1
            copies = [own[x][: k + 1] if len(set(own[x].tolist())) == len(x) else own[x] for x in np.split(order, cuts)]
            if width not in trees:
                trees[width] = CoverTree(np.pad(points, ((0, 0), (0, width - points.shape[1]))), max(4, min(QUERY_LEAF, len(points) // 8)))
            got: tuple[list, ...] = ([], [], [])
            for q, i, s in search(trees[width], ids, CoverTree(distinct), copies, k, floor):
                got[0].append(np.full(len(i), ids[q]))
                got[1].append(i)
                got[2].append(s)
                if len(s) == k:
                    floor[q] = max(floor[q], float(s[-1]))  # later blocks need only beat this
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in got], names=["query_id", "vec_id", "score"])

        if len(ids):
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    part = b.slice(at, BLOCK)
                    held_i.append(part.column("vec_id").to_numpy(zero_copy_only=False))
                    held_x.append(np.floor(_matrix(part.column("raw")) * scale))
                    if sum(map(len, held_i)) >= BLOCK:
                        yield flush()
            if held_i:
                yield flush()

    return usable.select("vec_id", "raw").mapInArrow(run, "query_id long, vec_id long, score long"), sent


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
