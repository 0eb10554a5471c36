"""Benchmark decontamination by spaced-seed hashing.

Texts become sequences of lower-cased words.  Every fixed mask is laid over every position of benchmark and documents; the
words under its ones, five of them, are hashed and those at its zeros ignored, so a substituted word costs only the placements
that look at it.  Where a document's hash meets a benchmark item's, the two are aligned there and compared word by word: the
document holds the item if in some ``WINDOW`` consecutive words of the item at most ``substitutions`` differ.  The masks
are lossless for that rule: whatever words of a window differ, one placement of one mask sees none of them.  Items that are shorter than
the masks are looked up as whole runs of words.

The benchmark goes to every task in waves of bounded size.  With one wave documents are never shuffled; with more, each wave writes pairs of a
text's key and an item, and texts meet their pairs once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import table, written

MASKS = ("11111", "1101011", "110111")
WORDS, WINDOW = 5, 12
#: Bytes of benchmark text that one wave sends to every task at most, and tokens of documents that are looked at together.
WAVE_BYTES, TOGETHER = 64 << 20, 1 << 20
#: Hits that are expanded together: a phrase that many items share meets each of them wherever a document repeats it.
HITS = 1 << 20
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def substitutions(window: int) -> int:
    """How many words of a window of that many may differ: a fifth, as far as the masks are lossless."""
    return 2 if window >= 11 else 1 if window >= 8 else 0


class Seeds:
    """The benchmark's vocabulary, its items as word numbers from 1, and its hashes under every mask, sorted."""

    def __init__(self, items: list[tuple[object, str]]):
        self.number: dict[str, int] = {}
        self.ids, self.items = [], []
        for key, text in items:
            own = words(text)
            if own:
                self.ids.append(key)
                self.items.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in own], np.int64))
        self.tables = []
        for mask in (*("1" * n for n in range(1, WORDS)), *MASKS):
            ones = [k for k, c in enumerate(mask) if c == "1"]
            # Items of fewer words than the masks have ones are looked for whole.
            of_mask = [(k, x) for k, x in enumerate(self.items) if (len(x) == len(ones) if len(ones) < WORDS else len(x) >= WORDS)]
            found = [(seed_hashes(x, ones), np.full(max(len(x) - ones[-1], 0), k), np.arange(max(len(x) - ones[-1], 0))) for k, x in of_mask]
            keys, item, at = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else ((), (), ())))
            order = np.argsort(keys, kind="stable")
            self.tables.append((ones, keys[order], item[order], at[order]))

    def leaks(self, tokens: np.ndarray, owner_ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, item) for the word numbers of several documents in a row (0: not in the vocabulary), each ending at ``owner_ends``."""
        known = tokens > 0
        pairs: list[np.ndarray] = []
        for ones, keys, item, at in self.tables:
            n = len(tokens) - ones[-1]
            if n <= 0 or not len(keys):
                continue
            whole = known[:n].copy()
            for k in ones[1:]:
                whole &= known[k : k + n]
            where = np.flatnonzero(whole)
            hashes = seed_hashes(tokens, ones, where)
            low, high = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
            hit = high > low
            where, low, count = where[hit], low[hit], (high - low)[hit]
            if not len(where):
                continue
            for part in np.split(np.arange(len(where)), np.flatnonzero(np.diff(np.cumsum(count) // HITS)) + 1):
                n_of = count[part]
                each = np.repeat(low[part] - (np.cumsum(n_of) - n_of), n_of) + np.arange(n_of.sum())
                place = np.repeat(where[part], n_of)
                doc = np.searchsorted(owner_ends, place, "right")
                inside = place + ones[-1] < owner_ends[doc]
                if inside.any():
                    pairs.append(np.unique(np.stack([doc, item[each], place - at[each]])[:, inside], axis=1))
        if not pairs:
            return
        seen: set[tuple[int, int]] = set()
        for doc, k, diagonal in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist():
            if (doc, k) not in seen and self._overlap(tokens, int(owner_ends[doc - 1]) if doc else 0, int(owner_ends[doc]), self.items[k], diagonal):
                seen.add((doc, k))
        yield from sorted(seen)

    @staticmethod
    def _overlap(tokens: np.ndarray, first: int, end: int, item: np.ndarray, diagonal: int) -> bool:
        window = min(WINDOW, len(item))
        a, b = max(first, diagonal), min(end, diagonal + len(item))
        if b - a < window:
            return False
        same = np.concatenate([[0], np.cumsum(tokens[a:b] == item[a - diagonal : b - diagonal])])
        return bool((same[window:] - same[:-window]).max() >= window - substitutions(window))


def seed_hashes(tokens: np.ndarray, ones: list[int], where: np.ndarray | None = None) -> np.ndarray:
    """The hash of the words under a mask's ones for every placement, or for those in ``where``."""
    at = np.arange(max(len(tokens) - ones[-1], 0)) if where is None else where
    out = np.zeros(len(at), np.uint64)
    for k in ones:
        out = (out ^ tokens[at + k].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


def leaked(docs: DataFrame, benchmark: DataFrame, column: str = "leaked_items", text_col: str = "text", wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """``docs`` with ``column``: the sorted item_ids of the benchmark items that each text holds (empty: clean).

    Whole texts are read, very long ones too.  An item of fewer than five words is held where its words stand in a row.  Null and empty texts
    hold nothing; items with a null id or without a word cannot be held; repeated rows and items are as good as one; an empty table gives
    no rows.  A column of ``docs`` that has the name ``column`` gives way to the new one.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != column]
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    waves = max(1, -(-2 * total["b"] // wave_bytes)) if total["b"] > wave_bytes else 1
    if waves == 1:
        return _wave(spark, docs.select(*kept), _rows(items), kept, column, text_col, False)[0]
    # A text is known by 128 bits of hash; of texts that many documents share, one pair an item is enough.
    key = F.struct(F.xxhash64(text_col).alias("a"), F.xxhash64(F.lit(1), text_col).alias("b"))
    texts, found = docs.select(key.alias("key"), F.col(text_col).alias("text")), []
    for w in range(waves):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(waves)) == w)
        pairs, held = _wave(spark, texts, _rows(part), ["key"], "item", "text", True)  # one wave at a time, on the driver as in the tasks
        found.append(written(pairs.distinct()))
        held.destroy()
    of_text = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    keyed = docs.select(F.struct(*kept).alias("row"), key.alias("key")).join(of_text, "key", "left")
    none = F.array().cast("array<long>")
    return keyed.select(*[F.col("row")[c].alias(c) for c in kept], F.coalesce("items", none).alias(column))


def _rows(items: DataFrame) -> list[tuple[int, str]]:
    return sorted((r["item_id"], r["text"]) for r in items.distinct().collect())  # at most about ``wave_bytes``


def _wave(spark: SparkSession, docs: DataFrame, items: list[tuple[int, str]], kept: list[str], column: str, text_col: str, pairs: bool) -> tuple[DataFrame, Broadcast]:
    """``kept`` and, as ``column``, the items that a text holds: all in an array or, as ``pairs``, a row for each."""
    sent = spark.sparkContext.broadcast(items)
    memo: list[Seeds] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not memo:
            memo.append(Seeds(sent.value))
        seeds = memo[0]
        number = seeds.number.get
        for b in batches:
            held: list[set[int]] = [set() for _ in range(b.num_rows)]
            tokens: list[int] = []
            ends: list[int] = []

            def look(first: int) -> None:
                for doc, k in seeds.leaks(np.array(tokens, np.int64), np.array(ends, np.int64)):
                    held[first + doc].add(seeds.ids[k])  # noqa: B023
                tokens.clear()  # noqa: B023
                ends.clear()  # noqa: B023

            first = 0
            for k, text in enumerate(b.column(text_col).to_pylist()):
                tokens += [number(w, 0) for w in words(text)]
                ends.append(len(tokens))
                if len(tokens) >= TOGETHER:
                    look(first)
                    first = k + 1
            if ends:
                look(first)
            if pairs:
                owner = pa.array([k for k, x in enumerate(held) for _ in x], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(owner) for c in kept), pa.array([i for x in held for i in x], pa.int64())], names=[*kept, column])
            else:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([sorted(x) for x in held], pa.list_(pa.int64()))], names=[*kept, column])

    schema = T.StructType([*docs.select(*kept).schema, T.StructField(column, T.LongType() if pairs else T.ArrayType(T.LongType()))])
    return docs.mapInArrow(run, schema), sent


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = leaked(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.size("leaked_items").alias("n_items"), F.col("leaked_items").alias("item_ids"))
