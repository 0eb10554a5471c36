"""Hard-negative mining: each anchor's scores in full order, limits found by binary search.

Anchors are a stated set; they come in waves of a bounded number of rows, which are sent to every task.  Tasks read the candidates
in blocks.  A first pass keeps each anchor's best rows of its own label, its positives.  A second one orders each anchor's scores of a
block's rows of other labels, by score and id, searches for every positive's upper limit in them and reads on from there down to the lower one.
What a block finds for an anchor or a positive is a few rows, of which the best over all blocks are the best of all, so that no
task ever holds an anchor's whole list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, written
from .topk import _matrix, products

#: Candidates that a task looks at together, and anchors whose scores of them it orders together.
BLOCK, GROUP = 8192, 256
#: Anchors of one wave: so many rows, and so many bytes of vectors, and no more, are sent to every task.
WAVE, WAVE_BYTES = 16_384, 32 << 20


def ordered(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """For every row of ``scores``, the places of its columns by score, highest first, then id; ``ids`` grow."""
    return np.argsort(-scores, axis=1, kind="stable")


def limits(score: int, low: int, high: int) -> tuple[int, int]:
    """The smallest and largest whole number x with low * score <= 100 * x <= high * score; none if they cross."""
    return -(-low * score // 100), high * score // 100


class Best:
    """The first ``k`` (score, id) of everything put under a key, by score, highest first, then id."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def put(self, key: object, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(ids):
            found = self.held.get(key, []) + [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)]
            self.held[key] = sorted(found)[: self.k]


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """vec_id, label and components of the rows that take part."""
    x = F.col(vector_col)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    found = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda v: v.cast("double")).alias("raw"), whole.alias("whole"))
    return found.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull() & F.coalesce("whole", F.lit(False))).drop("whole")


def mined(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, wave: int = WAVE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of every anchor and positive.

    Components become floor(scale * component); scores are integer inner products; higher ones come first, ties by smaller id.  An anchor's
    positives are its first ``positives`` other rows of its label; a positive's negatives the first ``negatives`` rows of other labels whose
    score is from ``low`` to ``high`` hundredths of the positive's.  ``is_anchor`` (a column of vec_id) says which rows are anchors.

    Rows with a null id or label, a null vector or a null, NaN or infinite component take no part; shorter vectors, empty ones too, count as
    ended by zeros.  Repeated rows are candidates each; of anchors with one id the one of the smallest label, then vector, counts, and no
    row of an anchor's own id is its positive or negative.  Fewer rows than asked for give them all; an empty table gives none.  Other columns
    are not read.  Anchors beyond one wave go wave by wave, each of which is written before the next one is sent.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors, id_col, vector_col, label)
    stated = usable.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "raw")).alias("own"))
    told = stated.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("own.raw")), F.lit(1)).alias("width")).first()
    wave = max(64, min(wave, WAVE_BYTES // (8 * max(told["width"], 1))))
    out, rest = None, stated.toLocalIterator()  # the driver holds one partition's anchors and one wave
    while rows := list(islice(rest, wave)):
        part = _wave(spark, usable, rows, positives, negatives, low, high, scale)
        part = written(part) if told["n"] > wave else part
        out = part if out is None else out.unionByName(part)
    return _wave(spark, usable, [], positives, negatives, low, high, scale) if out is None else out


def _wave(spark: SparkSession, usable: DataFrame, rows: list, k: int, each: int, low: int, high: int, scale: int) -> DataFrame:
    ids = np.array([r["vec_id"] for r in rows], np.int64)
    labels = np.array([r["own"]["label"] for r in rows], np.int64)
    raw = _matrix(pa.array([r["own"]["raw"] for r in rows], pa.list_(pa.float64()))) if rows else np.zeros((0, 0))
    anchors = spark.sparkContext.broadcast((ids, labels, np.floor(raw * scale)))  # at most WAVE vectors

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, labels and points of at most BLOCK candidates, in order of their ids."""
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                own = part.column("vec_id").to_numpy(zero_copy_only=False)
                order = np.argsort(own, kind="stable")
                yield own[order], part.column("label").to_numpy(zero_copy_only=False)[order], np.floor(_matrix(part.column("raw")) * scale)[order]

    def scored(batches: Iterator[pa.RecordBatch], alike: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, ids, scores) of groups of anchors of one label, and a block's rows of that label or of all others."""
        a_ids, a_labels, points = anchors.value
        for own, kinds, x in blocks(batches):
            width = max(points.shape[1], x.shape[1])
            x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
            for kind in np.unique(a_labels).tolist():
                here, there = np.flatnonzero(a_labels == kind), np.flatnonzero((kinds == kind) == alike)
                if len(there):
                    for at in range(0, len(here), GROUP):
                        some = here[at : at + GROUP]
                        yield some, own[there], products(np.pad(points[some], ((0, 0), (0, width - points.shape[1]))), x[there])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for some, own, scores in scored(batches, True):
            order = ordered(own, scores)
            for n, a in enumerate(some.tolist()):
                top = order[n, : k + (own == ids[a]).sum()]
                top = top[own[top] != ids[a]][:k]
                best.put(a, scores[n, top], own[top])
        got = [(ids[a], i, -s) for a, found in best.held.items() for s, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in got], pa.int64()) for c in range(3)], names=["anchor_id", "positive_id", "positive_score"])

    best = F.row_number().over(_order(["anchor_id"], "positive_score", "positive_id"))
    found = usable.mapInArrow(first, "anchor_id long, positive_id long, positive_score long").withColumn("rank", best).where(F.col("rank") <= k)
    place = {int(i): a for a, i in enumerate(ids)}
    of: dict[int, list[tuple[int, int, int]]] = {}
    for r in found.collect() if rows else []:  # at most ``k`` for each anchor of the wave
        of.setdefault(place[r["anchor_id"]], []).append((r["rank"], r["positive_id"], r["positive_score"]))
    positives = spark.sparkContext.broadcast(of)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(each)
        wanted = positives.value
        for some, own, scores in scored(batches, False):
            order = ordered(own, scores)
            for n, a in enumerate(some.tolist()):
                down = -scores[n, order[n]]  # grows, for the search
                for rank, _, score in wanted.get(a, []):
                    least, most = limits(score, low, high)
                    top = order[n, np.searchsorted(down, -most, "left") : np.searchsorted(down, -least, "right")]
                    top = top[: each + (own == ids[a]).sum()]
                    top = top[own[top] != ids[a]][:each]
                    best.put((a, rank), scores[n, top], own[top])
        sides = {(a, rank): (i, s) for a, found in wanted.items() for rank, i, s in found}
        got = [(ids[a], rank, *sides[a, rank], i, -s) for (a, rank), found in best.held.items() for s, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in got], pa.int64()) for c in range(6)], names=["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    near = usable.mapInArrow(second, "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(_order(["anchor_id", "place"], "negative_score", "negative_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= each).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _order(by: list[str], score: str, id_: str):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(F.desc(score), id_)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS alike, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
