"""Secret scan: an Aho-Corasick keyword prefilter, anchored regular expressions at its hits, then embedded checksums.

A text is mapped to one byte a code point (code points above 255 become ``?``, which no pattern holds), so offsets in
the bytes are code points of the text.  One automaton over the lower-cased bytes finds every keyword; an expression is
tried only where a keyword of its kind begins, and never inside an earlier match of its kind, which is what a leftmost
non-overlapping search of the whole text gives.  Runs of hexadecimal digits have no keyword: their prefilter is the run of 16
class marks in a copy of the text in which every such digit is one mark.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

_HEX_DIGITS = b"0123456789abcdef"
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_MARKS = bytes(104 if x in _HEX_DIGITS else 46 for x in range(256))
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: The kinds in their order, the keywords that announce them and their expressions.
KEYWORDS = {
    "assign": (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"),
    "access": (b"akia",),
    "repo_token": (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"),
    "package_token": (b"npm_",),
    "service_token": (b"glsa_",),
}
EXPRESSIONS = {
    "assign": re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]+"),
    "repo_token": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "package_token": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "service_token": re.compile(rb"glsa_[A-Za-z0-9]{32}_[0-9a-f]{8}(?![A-Za-z0-9])"),
}
ORDER = ("assign", "access", "hex", "repo_token", "package_token", "service_token")
BASE = ORDER[:3]


def _crc62(body: bytes) -> bytes:
    n, out = zlib.crc32(body), ""
    while n:
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out.rjust(6, "0").encode()


def valid(kind: str, m: re.Match[bytes]) -> bool:
    """Lengths of the base kinds; the checksum that a token of the other kinds carries in its last characters."""
    if kind == "assign":
        return len(m[2]) >= 12
    if kind == "access":
        return len(m[0]) >= 18
    if kind == "hex":
        return len(m[0]) >= 16
    if kind == "service_token":
        return b"%08x" % zlib.crc32(m[0][:-9]) == m[0][-8:]
    return _crc62(m[0][4:-6]) == m[0][-6:]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            out.add_word(w.decode(), (len(w), kind))
    out.make_automaton()
    return out


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret of a whole text, by start and then kind; a null text has none."""
    if not text:
        return []
    raw = text.encode("latin-1", "replace")
    lower = raw.translate(_LOWER)
    found: list[tuple[int, int, str, int]] = []
    past = dict.fromkeys(ORDER, 0)

    def attempt(kind: str, at: int) -> None:
        if at < past[kind] or not (m := EXPRESSIONS[kind].match(raw, at)):
            return
        past[kind] = m.end()
        if valid(kind, m):
            found.append((at, ORDER.index(kind), kind, m.end()))

    hits = [(end - size + 1, kind) for end, (size, kind) in _automaton().iter(lower.decode("latin-1"))]
    for at, kind in sorted(hits):
        attempt(kind, at)
    marks = raw.translate(_MARKS)
    at = marks.find(b"h" * 16)
    while at >= 0:
        attempt("hex", at)
        at = marks.find(b"h" * 16, past["hex"])
    return [(kind, at, end) for at, _, kind, end in sorted(found)]


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) in code points, for every row of ``docs``.

    Nothing is shuffled.  Null and empty texts have no spans; very long texts are read whole; repeated rows come out each; an empty table gives no rows; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], names=["doc_id", "spans"])

    ids = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {ids}, spans array<struct<kind: string, start: long, end: long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *map(of, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
