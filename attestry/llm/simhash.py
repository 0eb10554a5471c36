"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are 64 bits and link at ``distance`` (4) or fewer differing bits.  Only distinct fingerprints are compared,
never texts.  Five bit segments make five tables: two linked fingerprints agree on one whole segment at least, so every
link is found inside some (segment, value) group.  A group is sorted by Gray rank, which brings fingerprints that share
long bit patterns next to each other; every ``FAN`` neighbours become a node that holds the bits on which
all of them agree (mask and pattern), and so on up to one node a group.  The group is joined with itself from the top:
two nodes that differ in more than ``distance`` of the bits that both masks share are dropped with everything below them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import durable, table
from .components import components

BITS, DISTANCE, WORDS, SEED, FAN = 64, 4, 4, 42, 8
#: Most fingerprints of a group that one task indexes; larger groups are split and joined block by block.
BLOCK = 4096


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a whole text; a text without words, or a null one, has fingerprint 0."""
    if not text:
        return 0
    words = text.encode("utf-8", "replace").lower().split()  # bytes: exactly A-Z and the six ASCII spaces
    if not words:
        return 0
    from xxhash import xxh64_intdigest as xx

    line = b" ".join(words)
    n = len(words) - WORDS + 1
    if n <= 1:
        return xx(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    hashes = np.fromiter([xx(line[a:b], SEED) for a, b in zip(starts, (ends[WORDS - 1 :] - 1).tolist(), strict=True)], np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order: the inverse of n ^ (n >> 1)."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """The hierarchy over one or more groups of codes.  Groups are runs of equal ``group``; codes in Gray order in them.

    Levels go from the codes up; a node never holds codes of two groups, and the top level has one node a group.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray, fan: int = FAN):
        order = np.lexsort((gray_rank(codes), group))
        self.order, codes, group = order, codes[order], group[order]
        every = ~np.uint64(0)
        self.levels = [(codes, np.full(len(codes), every), np.arange(len(codes) + 1))]  # pattern, mask, first child
        while len(group) and (group[1:] == group[:-1]).any():
            new = np.r_[True, group[1:] != group[:-1]]
            within = np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
            first = np.flatnonzero(within % fan == 0)
            pattern, mask, _ = self.levels[-1]
            all_and, all_or = np.bitwise_and.reduceat(pattern, first), np.bitwise_or.reduceat(pattern, first)
            agreed = np.bitwise_and.reduceat(mask, first) & ~(all_and ^ all_or)
            self.levels.append((all_and & agreed, agreed, np.r_[first, len(group)]))
            group = group[first]

    def links(self, distance: int = DISTANCE, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of positions (in the input's order) of all pairs of codes in a group that differ in at most ``distance`` bits."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        stack = [(top, np.arange(n), np.arange(n))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > most:
                stack += [(level, a[k : k + most], b[k : k + most]) for k in range(0, len(a), most)]
                continue
            pattern, mask, first = self.levels[level]
            near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= distance
            a, b = a[near], b[near]
            if not level:
                two = a < b
                if two.any():
                    yield self.order[a[two]], self.order[b[two]]
                continue
            width_a, width_b = first[a + 1] - first[a], first[b + 1] - first[b]
            size = width_a * width_b
            start = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(a)), size)
            within = np.arange(len(owner)) - start[owner]
            ca, cb = first[a][owner] + within // width_b[owner], first[b][owner] + within % width_b[owner]
            once = ca <= cb
            if once.any():
                stack.append((level - 1, ca[once], cb[once]))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position that each of ``n`` positions is connected to."""
    root = np.arange(n)
    for a, b in links:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:  # point every position at its root
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def segments(tables: int, distance: int = DISTANCE) -> list[list[tuple[int, int]]]:
    """For every table its bit ranges (shift, width): each of ``distance + 1`` segments, or all pairs out of ``distance + 2``."""
    cuts = distance + 1 if tables == distance + 1 else distance + 2
    edges = [BITS * k // cuts for k in range(cuts + 1)]
    one = [(edges[k], edges[k + 1] - edges[k]) for k in range(cuts)]
    return [[x] for x in one] if cuts == distance + 1 else [[one[i], one[j]] for i in range(cuts) for j in range(i + 1, cuts)]


def linked(codes: DataFrame, distance: int = DISTANCE, block: int = BLOCK, tables: int | None = None) -> DataFrame:
    """a, b: links among the distinct longs of ``codes`` (column fp) that connect all that ``distance`` connects.

    A task writes a spanning forest of each group instead of all its pairs.  With few codes five tables of one segment do; with
    more than ``block`` times the values of a segment, fifteen tables of two segments out of six keep groups small.  A group above
    ``block`` is split by hash into k blocks and each pair of blocks is a group of its own, so nothing is capped.
    """
    n = codes.count()
    tables = tables or (distance + 1 if n <= block << BITS // (distance + 1) else (distance + 1) * (distance + 2) // 2)
    keys = []
    for t, ranges in enumerate(segments(tables, distance)):
        key = F.lit(t).cast("long")
        for shift, width in ranges:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    routed = codes.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = routed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = durable(sizes.select("key", F.ceil(F.col("n") / (block / 2)).cast("int").alias("blocks")))
    if hot.isEmpty():
        routed = routed.select("fp", "key", F.lit(0).alias("low"), F.lit(0).alias("high"))
    else:
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
        routed = routed.join(hot, "key", "left").select("fp", "key", F.coalesce(mine, F.lit(0)).alias("mine"), other.alias("other"))
        routed = routed.select("fp", "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = ["key", "low", "high"]
    dealt = routed.repartition(parts, *cut).sortWithinPartitions(*cut)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def found(group: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            index = GrayIndex(fps.view(np.uint64), group)
            root = forest(len(fps), index.links(distance))
            own = root != np.arange(len(fps))
            return pa.RecordBatch.from_arrays([pa.array(fps[own]), pa.array(fps[root[own]])], names=["a", "b"])

        for b in batches:
            got = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*cut, "fp")])
            held = np.concatenate([*kept, got], axis=1) if kept else got
            new = np.r_[True, (held[:3, 1:] != held[:3, :-1]).any(0)] if held.shape[1] else np.zeros(0, bool)
            last = int(np.flatnonzero(new)[-1]) if len(new) else 0  # the last group may go on in the next batch
            if last:
                yield found(np.cumsum(new[:last]), held[3, :last])
            kept = [held[:, last:]]
        if kept and kept[0].shape[1]:
            yield found(np.zeros(kept[0].shape[1], np.int64), kept[0][3])

    return dealt.mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row of ``docs``.

    Texts without words have fingerprint zero and link like any other.  Repeated rows come out as often as they went in; a null
    id takes part but is nobody's component_id unless all of a component are null.  Very long texts count whole.  An empty table gives no rows;
    other columns are not read, whatever their names.
    """
    marked = durable(fingerprints(docs, text_col, id_col))
    codes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = components(linked(codes.select("fp"), distance), "a", "b").select(F.col("node").alias("fp"), "root")
    grouped = durable(codes.join(parts, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = durable(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    named = durable(grouped.join(smallest, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
