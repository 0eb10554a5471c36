"""Fuzzy line deduplication: MinHash signatures, banding, exact Jaccard verification, distributed union-find.

A line is the set of its character shingles: every run of ``SHINGLE`` characters, at every offset, in lower case and with one space
for each run of white space.  Lines are alike from a Jaccard index of ``threshold`` (0.8) on; equal lines
are alike too.  A signature holds the smallest shingle hash in each of ``ORDERS`` bins, eight to each of four turns of the hashes.  Every band takes four of them, in a cyclic
pattern in which two bands have at most two in common: a pair at the threshold misses all thirteen bands with probability 0.0046, one at 0.85
with 0.0006.  Lines that share a band are candidates if their signatures agree in 40 of 64 places at least (smallest and largest hash of each bin, judged by four bits), which a
pair at the threshold fails with a probability of 0.0001 at most; every candidate is then compared exactly before it makes a link.  In each band all
lines are first compared with one of them; what components that leaves apart is then compared across all lines of the band.  Links go to
connected components, and of each component the line of the smallest document id and position stays.

Main path: DataFrame functions only.  A line's occurrences never meet: partial aggregation makes one row of equal lines before anything is
exchanged, so a line that a third of all documents share costs no more than another.  Shingles are rows of generated code, not elements
of arrays: partial aggregation turns them into signatures in the task that made them, and they are never exchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import SENT_BYTES, durable, released, sent, table, written
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
#: Orders of the shingle hashes, and the bands' places in the signature: band k has the places 2k + each of these, counted round.
ORDERS, BANDS, PLACES = 32, 13, (0, 1, 6, 9)
#: How many ways of turning a hash there are, and how many bins share one.
TURNS = 4
BINS = ORDERS // TURNS
#: The first of the four bits by which places are compared; the last bits of a hash are its bin.
MARK = 8
#: How many of the 64 places may differ in four bits, and the columns that hold these.
APART = 24
NEAR = ("near0", "near1", "near2", "near3")
#: Characters whose shingles one regular expression match cuts out together.
CHUNK = 24
#: Members of a band up to which candidates are handed on as pairs; beyond, they are compared where they meet, block by block.
LARGE = 256
#: Members of a band on either side of such a block.
BLOCK = 1024
#: 64-bit words of the bitmap that rules pairs out before they are compared.
BITMAP = 32
#: White space other than single spaces.
SPACES = ("  ", "\t", "\r", "\x0b", "\x0c")


def _signed(x: int) -> int:
    x %= 1 << 64
    return x - ((x >> 63) << 64)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, tag, pos, line of every line.  key and tag, 96 bits of hash, stand for a row of ``docs``; they are made before lines are."""
    id_, text = F.col(id_col), F.col(text_col)
    doc = docs.select(id_.alias("doc_id"), F.xxhash64(id_, text).alias("key"), F.hash(text, id_).alias("tag"), F.split(text, "\n").alias("lines"))
    return doc.select("doc_id", "key", "tag", F.posexplode("lines").alias("pos", "line"))


def _taking_part(lines: DataFrame) -> DataFrame:
    """``lines`` that take part, all that are not blank, in lower case and with single spaces; uid is the 64-bit hash of the line."""
    odd = reduce(lambda a, b: a | b, (F.col("line").contains(x) for x in SPACES))
    plain = F.when(odd, F.regexp_replace(F.lower("line"), r"\s+", " ")).otherwise(F.lower("line"))
    return lines.withColumn("line", F.trim(plain)).where(F.col("line") != "").withColumn("uid", F.xxhash64("line"))


def shingles(line: Column) -> Column:
    """A line's shingles; repeated ones repeat.  A line shorter than a shingle is its only one."""
    runs = F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{SHINGLE}}}))."), F.lit(1))
    return F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(runs)


def _signatures(lines: DataFrame) -> DataFrame:
    """uid, n and the columns v0, v1, ... of ``lines`` (uid, n, line), which have different uids.

    One permutation hashing: each of ``TURNS`` turns of a shingle's hash deals it, by its last bits, to one of ``BINS`` bins, which keeps its
    smallest (v0 and on) and its largest (behind them); the bins are the orders.  An empty bin takes the next full one's value of the same turn,
    changed by the distance.
    """
    chunk = F.regexp_extract_all("line", F.lit(rf"(?s)(?=(.{{{SHINGLE},{CHUNK + SHINGLE - 1}}})).{{1,{CHUNK}}}"), F.lit(1))
    parts = lines.select("uid", "n", F.explode(F.when(F.length("line") < SHINGLE, F.array("line")).otherwise(chunk)).alias("part"))
    starts = parts.select("uid", "n", "part", F.explode(F.sequence(F.lit(1), F.greatest(F.length("part") - (SHINGLE - 1), F.lit(1)))).alias("at"))
    hashed = starts.select("uid", "n", F.xxhash64(F.substring("part", F.col("at"), F.lit(SHINGLE))).alias("h0"))
    turned = lambda by: F.call_function("shiftleft", F.col("h0"), F.lit(by)).bitwiseOR(F.call_function("shiftrightunsigned", F.col("h0"), F.lit(64 - by)))
    hashed = hashed.select("uid", "n", "h0", *[turned(64 * k // TURNS).alias(f"h{k}") for k in range(1, TURNS)])
    dealt = hashed.select("*", *[F.col(f"h{k}").bitwiseAND(F.lit(BINS - 1)).cast("int").alias(f"b{k}") for k in range(TURNS)])
    bins = [(end, k, j) for end in ("min", "max") for k in range(TURNS) for j in range(BINS)]
    kept = dealt.groupBy("uid").agg(F.first("n").alias("n"), *[F.expr(f"{end}(h{k}) FILTER (WHERE b{k} = {j})").alias(f"{end}{k}_{j}") for end, k, j in bins])
    filled = lambda end, k, j: F.coalesce(*[F.col(f"{end}{k}_{(j + d) % BINS}").bitwiseXOR(F.lit(_signed(d * 0x9E3779B97F4A7C15))) for d in range(BINS)])
    return kept.select("uid", "n", *[filled(*b).alias(f"v{at}") for at, b in enumerate(bins)])


def _marks() -> list[Column]:
    """near0, near1, ...: four bits of each of the signature's places, smallest and largest hashes; bands: the bands' hashes."""
    four = [F.call_function("shiftleft", F.shiftright(f"v{j}", MARK).bitwiseAND(F.lit(15)), F.lit(4 * (j % 16))) for j in range(2 * ORDERS)]
    near = [reduce(lambda a, b: a.bitwiseOR(b), four[16 * k : 16 * k + 16]).alias(c) for k, c in enumerate(NEAR)]
    bands = [F.xxhash64(F.lit(k), *[F.col(f"v{(2 * k + p) % ORDERS}") for p in PLACES]) for k in range(BANDS)]
    return [*near, F.array(*bands).alias("bands")]


def _near(l: str, r: str) -> Column:
    """If two signatures differ in few enough places."""
    apart = []
    for c in NEAR:
        x = F.col(f"{l}.{c}").bitwiseXOR(F.col(f"{r}.{c}"))
        x = x.bitwiseOR(F.call_function("shiftrightunsigned", x, F.lit(1)))
        x = x.bitwiseOR(F.call_function("shiftrightunsigned", x, F.lit(2)))
        apart.append(F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))))
    return reduce(lambda a, b: a + b, apart) <= APART


def distinct_lines(lines: DataFrame) -> DataFrame:
    """uid, n, near0 to near3, bands: every different line of ``lines`` (line, uid), and how often it is there.

    Different lines of one 64-bit hash, told apart by 32 bits more, are left out: they stay wherever they are.
    """
    every = lines.select("uid", "line", F.hash("line").alias("other"))
    one = every.groupBy("uid").agg(F.min("line").alias("line"), F.count("*").alias("n"), F.min("other").alias("other"), F.max("other").alias("another"))
    return _signatures(one.where("other = another")).select("uid", "n", *_marks())


def _pairs(members: DataFrame) -> DataFrame:
    """a, b: candidates among the ``members`` (uid, near0 to near3, band, size) of common bands, in the larger bands with the smallest uid only."""
    few, many = members.where(F.col("size") <= LARGE), members.where(F.col("size") > LARGE)
    l, r = few.alias("l"), few.alias("r")
    small = l.join(r, (F.col("l.band") == F.col("r.band")) & (F.col("l.uid") < F.col("r.uid")) & _near("l", "r"))
    least = many.groupBy("band").agg(F.min("uid").alias("uid"), *[F.min_by(c, "uid").alias(c) for c in NEAR])
    star = least.alias("l").join(many.alias("r"), (F.col("l.band") == F.col("r.band")) & (F.col("l.uid") < F.col("r.uid")) & _near("l", "r"))
    of = [F.col("l.uid").alias("a"), F.col("r.uid").alias("b")]
    return small.select(*of).unionByName(star.select(*of)).distinct()


def _bitmaps(sets: DataFrame) -> DataFrame:
    """uid, size, map: 64-bit words of bits that say for each residue of the set members (uid, x; distinct) if an odd number of them has it.

    Two sets differ in as many members as bits, at least.
    """
    word, bit = F.col("x").bitwiseAND(F.lit(BITMAP - 1)), F.shiftright("x", BITMAP.bit_length() - 1).bitwiseAND(F.lit(63)).cast("int")
    cut = sets.select("uid", word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
    words = [F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(BITMAP)]
    return cut.groupBy("uid").agg(F.count("*").cast("int").alias("size"), *words).select("uid", "size", F.array(*[f"w{k}" for k in range(BITMAP)]).alias("map"))


def _possible(l: str, r: str, threshold: float) -> Column:
    """If sizes and bitmaps allow two sets to be alike; they never rule out an alike one."""
    differ = F.zip_with(F.col(f"{l}.map"), F.col(f"{r}.map"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(differ, F.lit(0), lambda a, x: a + x)
    # At a Jaccard index of t, sets of x and y members differ in (1 - t) / (1 + t) * (x + y) of them.
    room = (1 - threshold) * (F.col(f"{l}.size") + F.col(f"{r}.size")) + 1e-6
    return (F.abs(F.col(f"{l}.size") - F.col(f"{r}.size")) * (1 + threshold) <= room) & (apart * (1 + threshold) <= room)


def _ruled(pairs: DataFrame, maps: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b) that sizes and bitmaps do not rule out."""
    l, r = pairs.join(maps.withColumnRenamed("uid", "a"), "a").alias("l"), maps.withColumnRenamed("uid", "b").alias("r")
    return written(l.join(r, F.col("l.b") == F.col("r.b")).where(_possible("l", "r", threshold)).select("l.a", "l.b"))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b) whose lines in ``texts`` (uid, line, size) are alike, by their shingles themselves."""
    side = lambda end, line: texts.select(F.col("uid").alias(end), F.col("line").alias(line), F.col("size").alias(f"size_{end}"))
    common = F.size(F.array_intersect(shingles(F.col("x")), shingles(F.col("y"))))
    counted = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", common.alias("common"), (F.col("size_a") + F.col("size_b")).alias("both"))
    return written(counted).where(F.col("common") >= threshold * (F.col("both") - F.col("common"))).select("a", "b")


def _roots(links: DataFrame) -> DataFrame:
    """uid, root of every line that has a link."""
    return written(components(links, "a", "b").withColumnRenamed("node", "uid"))


def _alike(x: str, y: str, threshold: float) -> Column:
    # The intersection is named once: named twice, Spark would compute it before the conditions that go first.
    return F.size(F.array_intersect(x, y)) * (1 + threshold) >= threshold * (F.size(x) + F.size(y)) - 1e-9


def _rest(members: DataFrame, found: DataFrame, sets: DataFrame, threshold: float, roots: DataFrame | None = None, maps: DataFrame | None = None) -> DataFrame:
    """a, b: links between the components that ``found`` leaves in a band, so that with them no two alike lines of a band are apart.

    Of every band in which not all pairs were compared, the lines outside its most frequent component are compared with all lines of
    other components, block by block; with signatures and bands in ``members``, only candidates are.  ``maps`` are the bitmaps of ``sets``, where they are known.  A pair is first ruled out by its sizes and
    bitmaps, which never rules out an alike one, and only the components of alike pairs are handed on.
    """
    roots = _roots(found) if roots is None else roots
    known = [c for c in (*NEAR, "bands") if c in members.columns]
    placed = members.join(roots, "uid", "left").select("uid", "band", F.coalesce("root", "uid").alias("root"), *known)
    counts = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
    told = counts.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    mixed = durable(told.where("most < n"))
    if mixed.isEmpty():
        return found.limit(0)
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    here = sent(placed, mixed, "band").withColumn("across", blocks(F.col("n"))).withColumn("down", blocks(F.col("n") - F.col("most")))
    here = written(here.select("band", "uid", "root", "main", "across", "down", *known))
    part = lambda n: F.pmod(F.xxhash64("uid"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    def met(full: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame, Column]:
        few = full.where("root <> main").select("band", part(F.col("down")).alias("i"), every(F.col("across")).alias("j"), *carried)
        all_ = full.select("band", every(F.col("down")).alias("i"), part(F.col("across")).alias("j"), (F.col("root") == F.col("main")).alias("in_main"), *carried)
        same = (F.col("l.band") == F.col("r.band")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j"))
        other = (F.col("l.root") != F.col("r.root")) & (F.col("r.in_main") | (F.col("l.uid") < F.col("r.uid")))
        if known:  # only candidates, and each in the first band that it shares
            shared = F.coalesce(*[F.when(F.get("l.bands", F.lit(k)) == F.get("r.bands", F.lit(k)), F.get("l.bands", F.lit(k))) for k in range(BANDS)])
            other = other & _near("l", "r") & (shared == F.col("l.band"))
        return few.alias("l"), all_.alias("r"), same & other

    every_line = here
    if known:  # lines without a candidate in another component go before sets are sent: a set is many times as large as its marks
        few, all_, meet = met(here, ["uid", "root", *known])
        near = written(few.join(all_, meet).select(F.explode(F.array("l.uid", "r.uid")).alias("uid")).distinct())
        here = written(here.join(near, "uid", "left_semi"))
    used = sets.join(here.select("uid").distinct(), "uid", "left_semi")
    if maps is None:
        maps = _bitmaps(used.select("uid", F.explode("set").alias("x")).withColumn("x", F.col("x").cast("long")))
    mapped = written(used.join(maps, "uid"))
    full = here.join(mapped, "uid")
    few, all_, meet = met(full, ["uid", "root", "set", "size", "map", *known])
    linked = few.join(all_, meet & _possible("l", "r", threshold) & _alike("l.set", "r.set", threshold))
    out = written(linked.select(F.least("l.root", "r.root").alias("a"), F.greatest("l.root", "r.root").alias("b")).distinct())
    released(mapped, here, *([every_line, near] if known else []))
    return out


def line_roots(lines: DataFrame, marked: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """uid, root of every line that is linked to another one; and the lines of ``lines`` (places, line, uid) that are linked or repeated, as a written table."""
    held = marked.select("uid", *NEAR, F.explode("bands").alias("band"))
    shared = written(held.groupBy("band").agg(F.count("*").cast("int").alias("size")).where("size > 1"))
    members = written(sent(held, shared, "band", row=16))
    pairs = written(_pairs(members))
    large = members.where(F.col("size") > LARGE).select("uid", "band")
    tied = pairs.select(F.explode(F.array("a", "b")).alias("uid")).unionByName(large.select("uid")).distinct().withColumn("tied", F.lit(True))
    wanted = written(marked.where("n > 1").select("uid").join(tied, "uid", "full"))
    # Lines come from the texts again, those that are compared with their words: to carry them all this way would cost more.
    placed = written(sent(lines, wanted, "uid", row=16).select("doc_id", "key", "tag", "pos", "uid", F.when(F.col("tied"), F.col("line")).alias("line")))
    texts = placed.where("line IS NOT NULL").groupBy("uid").agg(F.min("line").alias("line"))
    maps = _bitmaps(texts.select("uid", F.explode(F.array_distinct(shingles(F.col("line")))).alias("s")).select("uid", F.xxhash64("s").alias("x")))
    maps = written(maps)
    texts = written(texts.join(maps.select("uid", "size"), "uid"))
    # Every line is first compared with its candidate of the smallest uid; then candidates that this leaves in different components are.
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = _verified(first, texts, threshold)
    roots = _roots(found)
    root = lambda end: roots.select(F.col("uid").alias(end), F.col("root").alias(f"root_{end}"))
    ends = sent(sent(pairs, root("a"), "a", "left"), root("b"), "b", "left").join(first.withColumn("done", F.lit(True)), ["a", "b"], "left")
    apart = ends.where((F.coalesce("root_a", "a") != F.coalesce("root_b", "b")) & F.col("done").isNull()).select("a", "b")
    possible = _ruled(apart, maps, threshold)
    more = _verified(possible, texts, threshold)
    kept = lambda: roots.where("uid <> root").select(F.col("root").alias("a"), F.col("uid").alias("b"))
    if not more.isEmpty():
        roots = _roots(kept().unionByName(more))
    if not large.isEmpty():
        of = texts.join(large.select("uid").distinct(), "uid", "left_semi")
        sets = of.select("uid", F.array_distinct(F.transform(shingles(F.col("line")), lambda x: F.xxhash64(x))).alias("set"))
        full = sent(marked.select("uid", *NEAR, "bands"), large, "uid", row=16)
        last = _rest(full, found, sets, threshold, roots, maps)
        if not last.isEmpty():
            roots = _roots(kept().unionByName(last))
    released(shared, members, pairs, wanted, maps, texts, found, possible, more)
    return roots, placed


def line_components(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, tag, pos, root: the component of every line of ``docs`` that is there more than once or may be like another one.

    The table is written; whoever has read it hands it to ``released``.
    """
    lines = _taking_part(_lines(docs, id_col, text_col))
    marked = written(distinct_lines(lines))
    roots, placed = line_roots(lines, marked, threshold)
    out = written(sent(placed.drop("line"), roots, "uid", "left", 16).select("doc_id", "key", "tag", "pos", F.coalesce("root", "uid").alias("root")))
    released(marked, placed)
    return out


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that an earlier line is like, and two columns: n_lines and n_dropped.

    Documents all stay, in the worst case with an empty text; the lines that stay keep their order.  A null text stays null and has no lines; an
    empty text has one, which takes no part.  Very long texts and lines are cut and compared whole.  Rows that agree in id and text are one
    document written twice and keep the same lines.  Of equal lines, the one of the smallest id, then place, stays; a null id comes before all
    others.  An empty table gives no rows; columns of ``docs`` named n_lines or n_dropped give way.
    """
    placed = line_components(docs, threshold, id_col, text_col)
    place = F.struct("doc_id", "key", "tag", "pos")
    again = durable(placed.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("root", "first"))
    extra = sent(placed, again, "root", row=64).where(place != F.col("first"))
    dropped = durable(extra.groupBy("key", "tag").agg(F.collect_set("pos").alias("gone")))
    released(placed)
    told = dropped.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("lines")).first()
    small = 96 * told["docs"] + 4 * told["lines"] <= SENT_BYTES
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    id_, text = F.col(id_col), F.col(text_col)
    keyed = docs.select(F.struct(*kept).alias("row"), F.xxhash64(id_, text).alias("key"), F.hash(text, id_).alias("tag"))
    out = keyed.join(F.broadcast(dropped) if small else dropped, ["key", "tag"], "left").withColumn("lines", F.split(F.col("row")[text_col], "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return out.select(
        *[F.when(F.col("gone").isNull(), F.col("row")[c]).otherwise(text).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept],
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")
