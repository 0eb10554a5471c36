"""Best-fit packing of tokenised documents by minimum bin slack.

Bin filling looks at lengths only, so it runs on the histogram of piece lengths: at most ``capacity`` counts,
whatever the corpus size.  Per bin, the longest length left is placed and a bitset subset-sum dynamic program over
the lengths still available finds the combination that leaves the least slack; the combination is removed as
many times as the counts allow, which fills that many equal bins at once.  The pieces then find their bins
without meeting: a piece's rank among the pieces of its length falls in one combination's range of ranks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import durable, table

#: How many tokens a sequence holds.
CAPACITY = 2048
#: The id that ends every document.
END_ID = 0
#: Fixed value: the pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker keeps; beyond that it starts afresh.
MEMO = 200_000


class _WordIds(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of the words seen so far.

    A key is the stretch up to the next single space; one that starts with a line break stands for itself, any other
    for a space and itself.  The vocabulary and its merge order come from the tokenizer's own file.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        #: What the library looks for before it splits a text into words.
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in visible)}
        ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items() if all(c in letters for c in k) and k not in self.added}
        self.core = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(".,")
        if core and core != word and core[-1].isalpha():  # a stop or comma after a letter starts a token of its own
            return self[core] + self.exact(word[len(core) :])
        out = self.exact(word if word[0] == "\n" else f" {word}")
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = out
        return out

    def exact(self, text: str) -> bytes:
        ids = self.core.encode_ordinary(text)
        return pack(f"<{len(ids)}I", *ids)

    def text(self, text: str) -> bytes:
        """The ids of a whole text."""
        import numpy as np

        if " ".join(text.split()) != text.replace("\n", " ") or any(t in text for t in self.added):
            # Runs of white space, or other than spaces and line breaks, are split by what follows them, and added tokens are found
            # before words are: leave those texts to the library.
            return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()
        words = text.replace("\n", " \n").split(" ")
        return self.exact(words[0]) + b"".join(map(self.__getitem__, words[1:]))


@lru_cache(maxsize=2)
def _word_ids(path: str) -> _WordIds:
    return _WordIds(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and ``END_ID``, cut into pieces of at most ``capacity``.

    Only longer documents are cut; all their pieces are full but the first, which may be shorter.  A null text is empty,
    so it gives one piece holding ``END_ID`` alone.  Ids are those of the library's default settings, so that an added token's own
    text is that token.  Very long texts are tokenised whole, one at a time.
    """
    step = 4 * capacity
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path)
        for b in batches:
            owner: list[int] = []
            out: tuple[list[int], ...] = ([], [], [], [])
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = (words.text(text) if text else b"") + end
                at, to = 0, len(ids) % step or min(step, len(ids))
                n = 0
                while at < len(ids):
                    owner.append(k)
                    for x, v in zip(out, (n, at // 4, (to - at) // 4, zlib.crc32(ids[at:to])), strict=True):
                        x.append(v)
                    at, to, n = to, to + step, n + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fill(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations ((length, how often), ...) and in how many bins each is used, until ``counts`` is used up."""
    left = {k: n for k, n in counts.items() if n > 0}
    out = []
    while left:
        lengths = sorted(left, reverse=True)
        longest, room = lengths[0], capacity - lengths[0]
        # reach: bit s is set if a sum of s can be made; grown holds the bits before each item, to walk back.
        reach, full, grown = 1, 1 << room, []
        mask = (full << 1) - 1
        for k in lengths:
            if k > room:
                continue
            copies, one = min(left[k] - (k == longest), room // k), 1
            while copies > 0 and not reach & full:  # binary splitting of the copies
                take = min(one, copies)
                more = (reach | reach << k * take) & mask
                if more != reach:
                    grown.append((k, take, reach))
                    reach = more
                copies, one = copies - take, one * 2
            if reach & full:
                break
        at, used = reach.bit_length() - 1, {longest: 1}
        for k, take, before in reversed(grown):
            if not before >> at & 1:
                used[k], at = used.get(k, 0) + take, at - k * take
        bins = min(left[k] // n for k, n in used.items())
        out.append((sorted(used.items(), reverse=True), bins))
        for k, n in used.items():
            left[k] -= n * bins
            if not left[k]:
                del left[k]
    return out


def pack_pieces(cut: DataFrame, capacity: int = CAPACITY, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """``cut`` (one row a piece, as ``pieces`` gives) with sequence_id and offset.

    Ranks within a length are taken in buckets, so that a length that a third of all pieces share is spread over
    many tasks.  What reaches the driver is a count per length.  Ties and repeated rows are separate pieces.
    """
    spark = cut.sparkSession
    by_length = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    buckets = max(64, sum(by_length.values()) // rows_per_bucket)
    ranges, next_rank, sequence = [], dict.fromkeys(by_length, 0), 0
    for combination, bins in fill(by_length, capacity):
        place = 0
        for k, n in combination:
            ranges.append((k, next_rank[k], n, sequence, place))
            next_rank[k] += n * bins
            place += n * k
        sequence += bins
    bucket: Column = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    key = ["length", "bucket"]
    rows = cut.withColumn("bucket", bucket)
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"))
    before = sizes.select(*key, (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("within", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, key).withColumn("rank", F.col("before") + F.col("within"))
    # A length gets at most log2(capacity) + 1 ranges that end it and the rest are bounded by those: a few ten thousand rows.
    table_of = spark.createDataFrame(ranges or [(0, 0, 1, 0, 0)], "length long, low long, each long, sequence long, place long")
    per_length = table_of.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "each", "sequence", "place"))).alias("ranges"))
    hit = F.element_at(F.filter("ranges", lambda r: r["low"] <= F.col("rank")), -1)
    return (
        ranked.join(F.broadcast(per_length), "length")
        .withColumn("hit", hit)
        .withColumn("nth", F.col("rank") - F.col("hit.low"))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("hit.sequence") + F.floor(F.col("nth") / F.col("hit.each"))).cast("long").alias("sequence_id"),
            (F.col("hit.place") + F.col("nth") % F.col("hit.each") * F.col("length")).cast("long").alias("offset"),
        )
    )


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack ``docs``; one row a piece.  An empty table gives no rows; other columns are ignored."""
    return pack_pieces(durable(pieces(docs, path, capacity)), capacity)


def tokenizer_path() -> str:
    """The public byte-level BPE's file, where its package is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path())
