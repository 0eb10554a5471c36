"""Leaderboard change feed: a materialised top-k view with slack, as a stateful stream.

Lines (a group, an item, a value, an arrival day) come in batches, each by a new start of one streaming query on one checkpoint.  A group's
items are dealt to buckets, so that no task holds a group.  For each bucket the state keeps the revenue of every item in a map (of
packed slots of items, which are read and written whole) and a cache of leaders: more of the best items than a board has, and a guard, a
bound that no item outside the cache is better than.  An update is looked at against the guard alone; only where leaders fall below it until
fewer than a board are left is the cache filled again, by a scan of the bucket's whole map.  What the stream hands on is what each day
changed among the leaders of a bucket, a bounded number of rows a day whatever the input.  A last pass merges a group's buckets, day
by day, into the group's board and tells what changed on it.

All boards are exact: the guard is a bound in the full order (revenue, then item), and what falls to it leaves the cache.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ._shared import moved, released, shared_dir, table, write, written

#: Places of a board; leaders that a cache keeps when it is filled or cut; and leaders at which it is cut.
BOARD, SLACK, FULL = 10, 32, 64
#: Buckets of a group's items, and slots of a bucket's map.
BUCKETS, SLOTS = 32, 64
#: Partial sums that a task holds before it hands them on.
HELD = 200_000
#: 2024-01-01 in days since 1970, the first day of the shop's data.
FIRST_DAY = 19_723
_LEAST = -(1 << 63)
_PAIR = np.dtype([("item", "<i8"), ("revenue", "<i8")])

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: none takes room ahead
    "spark.sql.streaming.minBatchesToRetain": "2",
}


class Cache:
    """The best items of a larger collection, whose other items are all at or behind ``guard``.

    An item's place is the pair (minus revenue, item): the smaller, the better.  Only items with positive revenue are ever in.
    """

    def __init__(self, board: int = BOARD, slack: int = SLACK, full: int = FULL):
        self.board, self.slack, self.full = board, slack, full
        self.held: dict[int, int] = {}
        self.guard: tuple[int, int] = (0, _LEAST)

    def put(self, item: int, revenue: int) -> None:
        if (-revenue, item) < self.guard:
            self.held[item] = revenue
            if len(self.held) >= self.full:
                self._cut(sorted((-r, i) for i, r in self.held.items()))
        else:
            self.held.pop(item, None)

    def _cut(self, places: list[tuple[int, int]]) -> None:
        self.held = {i: -r for r, i in places[: self.slack]}
        if len(places) > self.slack:
            self.guard = min(self.guard, places[self.slack])

    def short(self) -> bool:
        """If the board may lack items that are outside."""
        return len(self.held) < self.board and self.guard < (0, _LEAST)

    def refill(self, items: np.ndarray, revenues: np.ndarray) -> None:
        """From the whole collection."""
        own = revenues > 0
        items, revenues = items[own], revenues[own]
        order = np.lexsort((items, -revenues))[: self.slack + 1]
        self.guard = (0, _LEAST)
        self._cut([(-int(revenues[k]), int(items[k])) for k in order])

    def leaders(self) -> dict[int, int]:
        best = sorted((-r, i) for i, r in self.held.items())[: self.board]
        return {i: -r for r, i in best}


def slot_of(items: np.ndarray) -> np.ndarray:
    """The slot of a bucket's map that an item is in."""
    mixed = items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64) % SLOTS


class BucketLeaders(StatefulProcessor):
    """Per group and bucket: partial sums (item, day, value) in, the changes of the bucket's leaders a day out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revenues = handle.getMapState("revenues", "slot int", "pairs binary")
        self.cache = handle.getValueState("cache", "pairs binary, guard_revenue long, guard_item long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = list(rows)
        items, days, values = (np.concatenate([p[c].to_numpy(np.int64) for p in parts]) for c in ("item_id", "day", "value"))
        order = np.lexsort((items, days))
        items, days, values = items[order], days[order], values[order]
        # Of the map only the slots of the batch's items are read, once each.
        touched = np.unique(items)
        slots = slot_of(touched)
        before = {int(s): self._slot(int(s)) for s in np.unique(slots)}
        known = np.sort(np.concatenate([*before.values(), np.zeros(0, _PAIR)]), order="item")
        at = np.searchsorted(known["item"], touched)
        held = np.take(known["item"], at, mode="clip") == touched if len(known) else np.zeros(len(touched), bool)
        revenues = np.zeros(len(touched), np.int64)
        revenues[held] = known["revenue"][at[held]]
        now = dict(zip(touched.tolist(), revenues.tolist(), strict=True))
        cache = self._cached()
        board, out = cache.leaders(), []
        edges = [0, *(np.flatnonzero(np.diff(days)) + 1).tolist(), len(days)]
        for a, b in zip(edges, edges[1:], strict=False):
            for item, value in zip(items[a:b].tolist(), values[a:b].tolist(), strict=True):
                now[item] += value
                cache.put(item, now[item])
            if cache.short():
                cache.refill(*self._all(now))
            last, board = board, cache.leaders()
            day = int(days[a])
            out += [(day, i, r, True) for i, r in board.items() if last.get(i) != r]
            out += [(day, i, now.get(i, r), False) for i, r in last.items() if i not in board]
        for s in before:
            own = touched[slots == s]
            pairs = before[s]
            rest = pairs[~np.isin(pairs["item"], own)]
            new = np.empty(len(rest) + len(own), _PAIR)
            new[: len(rest)] = rest
            new["item"][len(rest) :] = own
            new["revenue"][len(rest) :] = [now[i] for i in own.tolist()]
            self.revenues.updateValue((s,), (np.sort(new, order="item").tobytes(),))
        held = np.array(list(cache.held.items()), np.int64).reshape(-1, 2)
        self.cache.update((held.tobytes(), *cache.guard))
        if out:
            yield pd.DataFrame({"group": [key[0]] * len(out), **{c: [x[k] for x in out] for k, c in enumerate(("day", "item_id", "revenue", "leads"))}})

    def _slot(self, slot: int) -> np.ndarray:
        found = self.revenues.getValue((slot,))
        return np.frombuffer(found[0], _PAIR) if found else np.zeros(0, _PAIR)

    def _cached(self) -> Cache:
        cache = Cache()
        if self.cache.exists():
            pairs, *guard = self.cache.get()
            cache.held = {int(i): int(r) for i, r in np.frombuffer(pairs, np.int64).reshape(-1, 2)}
            cache.guard = (int(guard[0]), int(guard[1]))
        return cache

    def _all(self, now: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Every item's revenue: the whole map, and over it what this batch has changed so far."""
        pairs = [np.frombuffer(v[0], _PAIR) for v in self.revenues.values()]
        kept = np.concatenate(pairs) if pairs else np.zeros(0, _PAIR)
        own = np.array(list(now), np.int64)
        kept = kept[~np.isin(kept["item"], own)]
        return np.concatenate([kept["item"], own]), np.concatenate([kept["revenue"], np.array(list(now.values()), np.int64)])

    def close(self) -> None:
        pass


def boards(rows: pd.DataFrame) -> pd.DataFrame:
    """The changes of a group's board, from the changes of its buckets' leaders (group, day, item_id, revenue, leads)."""
    changes = sorted(zip(*(rows[c].tolist() for c in ("day", "item_id", "revenue", "leads")), strict=True))
    held: dict[int, int] = {}
    ranked = lambda: {i: k + 1 for k, (_, i) in enumerate(sorted((-r, i) for i, r in held.items())[:BOARD])}
    board, out, at = ranked(), [], 0
    while at < len(changes):
        day, gone = changes[at][0], {}
        while at < len(changes) and changes[at][0] == day:
            _, item, revenue, leads = changes[at]
            if leads:
                held[item] = revenue
            else:
                held.pop(item, None)
                gone[item] = revenue
            at += 1
        last, board = board, ranked()
        for item in sorted(last.keys() | board.keys()):
            old, new = last.get(item), board.get(item)
            if old != new:
                change = "enter" if old is None else "exit" if new is None else "move"
                out.append((day, item, change, old, new, held[item] if item in held else gone[item]))
    found = pd.DataFrame(out, columns=["arrival_day", "item_id", "change", "old_rank", "new_rank", "revenue"])
    found[["old_rank", "new_rank"]] = found[["old_rank", "new_rank"]].astype("Int32")
    found.insert(0, "group", rows["group"].iloc[0])
    return found


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of a task's lines by group, item and day, so that a frequent item is exchanged as a few rows."""
    held: list[pa.Table] = []
    rows = 0

    def out() -> pa.Table:
        return pa.concat_tables(held).group_by(["group", "item_id", "day"]).aggregate([("value", "sum")]).rename_columns(["group", "item_id", "day", "value"])

    for b in batches:
        held.append(pa.Table.from_batches([b]))
        rows += b.num_rows
        if rows >= HELD:
            held[:] = [out()]
            rows = held[0].num_rows
            if 2 * rows > HELD:
                yield from held.pop().combine_chunks().to_batches()
                rows = 0
    if held:
        yield from out().combine_chunks().to_batches()


def change_feed(lines: DataFrame, late: int = 15) -> DataFrame:
    """group, arrival_day, item_id, change, old_rank, new_rank, revenue: every change of a group's board.

    ``lines`` (group int, item_id, day, value, stamp, batch from 1 on) add ``value`` to an item's revenue on arrival day ``day``; a day's lines
    are all of one batch, and later batches have later days.  After each day a group's board is its ``BOARD`` highest positive revenues,
    ties to the smaller item.  There is a row for every item whose place on the board differs from the one before, with the revenue
    that the item then has; a rank is null off the board.  Lines whose ``stamp`` is more than ``late`` below the largest of all earlier batches are
    dropped.  Those without group, item, day, value or batch change no revenue, but their stamps count; a null stamp is never late.

    Repeated lines count each.  An empty table gives no rows; other columns are not read.  Revenues are long integers.

    Lines are written by batch.  One after the other, the batches' folders are moved to where the stream reads, and the stream is started anew on
    its checkpoint.  Its own watermark would not do: Spark moves filters ahead of it, and then lines that are left out could not raise it.
    """
    spark = lines.sparkSession
    base = f"{shared_dir(spark)}/attestry-feed-{uuid.uuid4().hex}"
    columns = "group int, item_id long, day long, value long, stamp long"
    nothing = lambda schema: spark.range(0).select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])
    nothing(columns).write.parquet(f"{base}/lines/batch=0")  # so that the folder is there
    nothing(_LEADERS).write.parquet(f"{base}/none")
    write(lines.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in columns.split(", ")], F.col("batch").cast("int")), f"{base}/cut", "batch")
    cut = spark.read.schema(f"{columns}, batch int").parquet(f"{base}/cut")
    largest = {r["batch"]: r["stamp"] for r in cut.where("batch IS NOT NULL").groupBy("batch").agg(F.max("stamp").alias("stamp")).collect()}  # a row a batch
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        seen = None
        for b in sorted(largest):
            moved(spark, f"{base}/cut/batch={b}", f"{base}/lines/batch={b}")
            _start(spark, base, f"{columns}, batch int", None if seen is None else seen - late)
            seen = max((x for x in (seen, largest[b]) if x is not None), default=None)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    led = spark.read.schema(_LEADERS).parquet(f"{base}/leaders" if largest else f"{base}/none")
    return led.groupBy("group").applyInPandas(boards, _CHANGES)


_LEADERS = "group int, day long, item_id long, revenue long, leads boolean"
_CHANGES = "group int, arrival_day long, item_id long, change string, old_rank int, new_rank int, revenue long"


def _start(spark: SparkSession, base: str, schema: str, least: int | None) -> None:
    lines = spark.readStream.schema(schema).parquet(f"{base}/lines")
    counted = lines.na.drop(subset=["group", "item_id", "day", "value"])
    if least is not None:
        counted = counted.where(F.col("stamp").isNull() | (F.col("stamp") >= least))
    sums = counted.select("group", "item_id", "day", "value").mapInArrow(_summed, "group int, item_id long, day long, value long")
    sums = sums.withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(BUCKETS)).cast("int"))
    led = sums.groupBy("group", "bucket").transformWithStateInPandas(BucketLeaders(), _LEADERS, "Append", "None")
    running = led.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/leaders")
    running.awaitTermination()


def _cents(c: str) -> Column:
    """An amount in cents; null stays null, NaN is 0."""
    return F.floor(F.lit(100.0) * F.nanvl(F.col(c).cast("double"), F.lit(0.0)) + 0.5)


def vendor_nations(vendors: DataFrame) -> DataFrame:
    """vendor_id, group: a vendor's nation; of repeated vendors the smallest."""
    return vendors.where("vendor_id IS NOT NULL").groupBy("vendor_id").agg(F.min("nation_id").alias("group"))


def item_prices(items: DataFrame) -> DataFrame:
    """item_id, each (the price in cents, or null), known; of repeated items the smallest price."""
    return items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("price").alias("price")).select("item_id", _cents("price").alias("each"), F.lit(True).alias("known"))


def shop_lines(sale_lines: DataFrame, nations: DataFrame, prices: DataFrame, batches: int = 8) -> DataFrame:
    """group (the vendor's nation), item_id, day, value (cents), stamp, batch of every sale line.

    ``nations`` and ``prices`` come from the functions above, as written tables: then Spark may split a vendor's or an item's lines over several tasks.

    Day s is shipped_at's date, or by h if that is null, where h is the checksum of the line's ids; its arrival is up to six days, and every
    fifth line's twenty more, after it.  The value is the amount, or the quantity at the item's price, or 0, in cents; negative where the
    line was swapped.  Group and item are null where the vendor has no nation or there is no such item.  A NaN amount counts 0.  Arrivals before the first batch's days are in the first batch.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    h = F.crc32(F.concat(text("sale_id"), F.lit(","), text("item_id"), F.lit(","), text("vendor_id"), F.lit(","), text("line_no")).cast("binary"))
    lines = sale_lines.select("item_id", "vendor_id", "quantity", "amount", F.when(F.col("flag") == "swapped", -1).otherwise(1).alias("sign"), F.to_date("shipped_at").alias("on"), h.alias("h"))
    stamp = F.coalesce(F.unix_date("on"), F.lit(FIRST_DAY) + F.col("h") % 150).cast("int")
    day = (stamp + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)).cast("int")
    lines = lines.select(
        "item_id", "vendor_id", F.when(F.col("amount").isNull(), F.col("quantity")).alias("quantity"), _cents("amount").alias("cents"), "sign", stamp.alias("stamp"), day.alias("day")
    )
    # Both sides are exchanged at any size: neither vendors nor items have a bound.
    told = lines.join(nations.hint("shuffle_hash"), "vendor_id", "left").join(prices.hint("shuffle_hash"), "item_id", "left")
    value = F.col("sign") * F.coalesce("cents", F.col("quantity") * F.col("each"), F.lit(0))
    batch = F.least(F.lit(batches), F.greatest(F.lit(1), 1 + F.floor((F.col("day") - FIRST_DAY) * batches / F.lit(180))))
    item = F.when(F.col("known"), F.col("item_id")).alias("item_id")
    return told.select("group", item, F.col("day").cast("long").alias("day"), value.cast("long").alias("value"), F.col("stamp").cast("long").alias("stamp"), batch.cast("int").alias("batch"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, prices = written(vendor_nations(table(spark, sf_dir, "vendors"))), written(item_prices(table(spark, sf_dir, "items")))
    lines = shop_lines(table(spark, sf_dir, "sale_lines"), nations, prices)
    batch = F.least(F.lit(8), F.greatest(F.lit(1), 1 + F.floor((F.col("arrival_day") - FIRST_DAY) * 8 / F.lit(180)))).cast("int")
    changes = change_feed(lines)
    released(nations, prices)
    return changes.select(F.col("group").alias("nation_id"), "arrival_day", "item_id", batch.alias("batch"), "change", "old_rank", "new_rank", "revenue")


#: The remainders of sixteen values that a checksum of half bytes goes by, from its polynomial.
def _crc_table() -> list[int]:
    out = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


SQL = f"""
WITH t AS (
  SELECT *, concat(coalesce(CAST(sale_id AS VARCHAR), ''), ',', coalesce(CAST(item_id AS VARCHAR), ''), ',', coalesce(CAST(vendor_id AS VARCHAR), ''), ',', coalesce(CAST(line_no AS VARCHAR), '')) AS ids
  FROM sale_lines
), c AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, flatten([[CAST(ascii(x) AS BIGINT) & 15, CAST(ascii(x) AS BIGINT) >> 4] for x in string_split(ids, '')])),
    lambda c, n: xor({_crc_table()}[(xor(c, n) & 15) + 1], c >> 4)), 4294967295) AS h FROM t
), s AS (
  SELECT c.*, coalesce(date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)), 19723 + h % 150) AS stamp FROM c
), a AS (
  SELECT *, stamp + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS day FROM s
), b AS (
  SELECT a.*, v.nation_id, i.item_id IS NOT NULL AND v.nation_id IS NOT NULL AS counted, least(8, 1 + CAST(floor((day - 19723) * 8 / 180) AS BIGINT)) AS batch,
    CASE WHEN flag = 'swapped' THEN -1 ELSE 1 END * CAST(coalesce(floor(100.0 * amount + 0.5), quantity * floor(100.0 * i.price + 0.5), 0) AS BIGINT) AS cents
  FROM a LEFT JOIN vendors v USING (vendor_id) LEFT JOIN items i ON i.item_id = a.item_id
), m AS (
  SELECT batch, max(max(stamp)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b GROUP BY batch
), d AS (
  SELECT nation_id, item_id, day, CAST(sum(cents) AS BIGINT) AS cents FROM b JOIN m USING (batch) WHERE counted AND (seen IS NULL OR stamp + 15 >= seen) GROUP BY ALL
), g AS (
  SELECT p.nation_id, p.item_id, n.day, n.k, CAST(sum(coalesce(d.cents, 0)) OVER (PARTITION BY p.nation_id, p.item_id ORDER BY n.day) AS BIGINT) AS revenue
  FROM (SELECT DISTINCT nation_id, item_id FROM d) p
  JOIN (SELECT nation_id, day, row_number() OVER (PARTITION BY nation_id ORDER BY day) AS k FROM (SELECT DISTINCT nation_id, day FROM d)) n USING (nation_id)
  LEFT JOIN d USING (nation_id, item_id, day)
), r AS (
  SELECT *, CASE WHEN revenue > 0 THEN row_number() OVER (PARTITION BY nation_id, day ORDER BY revenue DESC, item_id) END AS place FROM g
), f AS (
  SELECT *, CASE WHEN place <= 10 THEN place END AS new_rank FROM r
), l AS (
  SELECT *, lag(new_rank) OVER (PARTITION BY nation_id, item_id ORDER BY k) AS old_rank FROM f
)
SELECT nation_id, day AS arrival_day, item_id, CAST(least(8, 1 + floor((day - 19723) * 8 / 180)) AS INTEGER) AS batch,
  CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change,
  CAST(old_rank AS INTEGER) AS old_rank, CAST(new_rank AS INTEGER) AS new_rank, revenue
FROM l WHERE old_rank IS DISTINCT FROM new_rank
"""
