"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature after another at a small step, on features cut into quantile
bins; a tree over one feature is only a step function over its bins, so all its rounds sum up to one lookup table.
The pairs of features whose residual gradients gain most from a joint split get tables of two dimensions in the same
way.  Scoring a batch is one bin search a feature and one table addition a term.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import table

#: Labelled rows that a fit gathers at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
FEATURES = (
    "log_chars", "upper_share", "punctuation_share", "digit_share", "symbol_share", "exclamation_share", "bar_share", "word_length", "long_word_share",
    "distinct_words", "top_word_share", "repeated_lines", "words_a_line", "stops_a_word", "open_lines", "short_word_share",
)
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOL = b"#$%&*@^~=<>{}[]\\/+_`|"
_PUNCTUATION = bytes(x for x in range(33, 127) if not chr(x).isalnum())
_IN_CLASS = np.zeros((5, 256))
for _row, _class in enumerate((_UPPER, _PUNCTUATION, _DIGIT, _SYMBOL, bytes([*range(65, 91), *range(97, 123)]))):
    _IN_CLASS[_row, list(_class)] = 1
_STOPS = re.compile(r"[.!?]+(?=\s|$)")


def features(text: str | None) -> tuple[float, ...]:
    """The numbers that a text is judged by; a null text is an empty one.  The whole text is read."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    upper, punctuation, digits, symbols, letters = _IN_CLASS @ np.bincount(raw, minlength=256)
    size = max(len(raw), 1)
    words = text.split()
    n = max(len(words), 1)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return (
        float(np.log1p(len(text))),
        upper / max(letters, 1),
        punctuation / size,
        digits / size,
        symbols / size,
        text.count("!") / n,
        text.count("|") / n,
        len(text) / n,
        float((lengths > 14).sum()) / n,
        len(seen) / n,
        max(seen.values(), default=0) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        n / max(len(lines), 1),
        len(_STOPS.findall(text)) / n,
        sum(x[-1] not in ".!?" for x in lines) / max(len(lines), 1),
        float((lengths <= 3).sum()) / n,
    )


@dataclass(frozen=True)
class Additive:
    """Intercept, bin edges of every feature, a table a feature and a table a pair of features."""

    intercept: float
    edges: tuple[np.ndarray, ...]
    main: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray], ...]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for every row of ``x``."""
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for k, lookup in enumerate(self.main):
            total += lookup[b[:, k]]
        for i, j, lookup in self.pairs:
            total += lookup[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _steps(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The step function of at most ``leaves`` levels over ordered bins that a tree on these sums would give."""
    out, parts = np.zeros(len(g)), [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            won = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            at = int(np.argmax(won))
            if won[at] > best[0]:
                best = (float(won[at]), k, a + at + 1)
        if not best[2]:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _corner(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Of the trees that cut both axes once, the one that gains most on these sums: its gain and its table."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, at = 0.0, None
    parts = []
    for c in (cg, ch):
        low, left, top = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        parts.append((low, left - low, top - low, c[-1, -1] - left - top + low))
    if parts[0][0].size:
        won = sum(_gain(a, b) for a, b in zip(*parts, strict=True)) - _gain(cg[-1, -1], ch[-1, -1])
        k = int(np.argmax(won))
        best, at = float(won.flat[k]), np.unravel_index(k, won.shape)
    out = np.zeros_like(g)
    if at is None:
        return 0.0, out
    i, j = at[0] + 1, at[1] + 1
    for rows in (slice(0, i), slice(i, None)):
        for cols in (slice(0, j), slice(j, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1.0)
    return best, out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 200, pairs: int = 6, step: float = 0.1) -> Additive:
    """Fit by cyclic boosting; rows in any order give the same model if they are sorted first.

    Without rows, or with one label only, the model says little more than the share of label 1.
    """
    width = x.shape[1]
    if not len(x):
        return Additive(0.0, tuple(np.zeros(0) for _ in range(width)), tuple(np.zeros(1) for _ in range(width)), ())
    edges = tuple(np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(width))
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    main = [np.zeros(len(e) + 1) for e in edges]
    b = Additive(start, edges, tuple(main), ()).bins(x)
    total = np.full(len(x), start)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(width):
            g, h = residual()
            add = step * _steps(np.bincount(b[:, k], g, len(main[k])), np.bincount(b[:, k], h, len(main[k])))
            main[k] += add
            total += add[b[:, k]]

    def sums(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(main[i]), len(main[j]))
        at = b[:, i] * shape[1] + b[:, j]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    g, h = residual()
    ranked = sorted(((-_corner(*sums(i, j, g, h))[0], i, j) for i, j in combinations(range(width), 2)))[:pairs]
    tables = {(i, j): np.zeros((len(main[i]), len(main[j]))) for _, i, j in ranked}
    for _ in range(rounds // 4):
        for (i, j), lookup in tables.items():
            g, h = residual()
            add = step * _corner(*sums(i, j, g, h))[1]
            lookup += add
            total += add[b[:, i], b[:, j]]
    return Additive(start, edges, tuple(main), tuple((i, j, t) for (i, j), t in tables.items()))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """True for the rows that no fit may learn from."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """Fit on at most ``sample`` labelled documents that are not held out.

    The sample is drawn from the labels before any text is read, so its ids are few enough to send to every task.  Rows of
    ``labels`` with nulls are left out; a document labelled several times counts with its mean, above one half as 1.  Of rows of ``docs`` that
    share an id, one text counts, so that the driver gets ``sample`` rows at most.
    """
    chosen = (
        labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg("quality") > 0.5).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), pa.array([features(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))], names=["label", "x"]
            )

    got = rows.mapInArrow(measure, "label double, x array<double>").toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.array(got["x"].tolist())
    order = np.lexsort((got["label"].to_numpy(), *x.T))
    return fit(x[order], got["label"].to_numpy()[order])


def scored(docs: DataFrame, model: Additive, threshold: float = 0.5, keep_text: bool = False) -> DataFrame:
    """doc_id, score and predicted for every row; with ``keep_text`` all columns of ``docs`` and these two.

    Empty, null and very long texts are scored like any other, each as a whole; an empty table gives no rows; repeated rows are scored each.
    Columns of ``docs`` named score or predicted give way to the new ones.
    """
    given = docs if keep_text else docs.select("doc_id", "text")
    kept = [f.name for f in given.schema if keep_text and f.name not in ("score", "predicted") or f.name == "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            score = model.score(np.array([features(t) for t in b.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"]
            )

    return given.mapInArrow(run, T.StructType([*given.select(*kept).schema]).add("score", "double").add("predicted", "integer"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
