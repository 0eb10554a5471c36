"""The registered queries and the pipeline on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from attestry.llm import decontaminate, registry, simhash

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_sql(spark, name):
    df = registry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(registry.oracle_sql()[name]).select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, want))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    before = docs.count()
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(DATA))
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            kept[name], docs = {r["doc_id"]: r["text"] for r in out.collect()}, out
        else:
            assert {r["doc_id"] for r in out.collect()} == set(kept["decontaminate"])
    assert 0 < len(kept["quality"]) < before and set(kept["line_dedup"]) == set(kept["quality"])
    clean = [t for t in kept["simhash"].values()]
    codes = [simhash.fingerprint(t) for t in clean]
    assert not any((a ^ b).bit_count() <= 4 for k, a in enumerate(codes) for b in codes[:k])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(str(DATA / "benchmark.parquet")).collect()]
    seeds = decontaminate.Seeds(items)
    held = lambda t: any(" ".join(decontaminate.words(x)) in " ".join(decontaminate.words(t)) for _, x in items)
    assert seeds.items and not any(held(t) for t in kept["decontaminate"].values())


def test_names():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in registry.queries()}


def _rows(df):
    return sorted(map(repr, df.collect()))


#: Every column name that an operator makes of its own.
OWN = {"score": 7.5, "predicted": 3, "label": 4, "n_lines": 11, "n_dropped": 12, "lines": "a", "leaked_items": [9], "fp": 2, "row": 3, "rest": "r", "key": "k", "tag": "t", "pos": 5, "root": 6, "all": "x", "gone": 1, "again": False, "x y": "odd"}


def _odd_documents(spark, rows):
    kinds = {float: "double", int: "int", str: "string", list: "array<int>", bool: "boolean"}
    return spark.createDataFrame([(i, t, *OWN.values()) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` {kinds[type(v)]}" for c, v in OWN.items()))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]])
def test_stages_take_anything(spark, stage):
    """Null and empty texts, null and repeated ids, repeated rows, an empty table; columns of any name keep their values and types."""
    word = " ".join(f"w{k}x" for k in range(40))
    good = spark.read.parquet(str(DATA / "documents.parquet")).join(spark.read.parquet(str(DATA / "labels.parquet")).where("quality = 1"), "doc_id").orderBy("doc_id").first()["text"]
    rows = [(1, word), (1, word), (1, "other words " * 9 + word[::-1]), (None, None), (2, None), (3, ""), (None, "only here " + word.upper()), (4, "z" * 50_000), (5, good), (5, good)]
    d = _odd_documents(spark, rows)
    out = stage(spark, d, str(DATA))
    assert out.columns == d.columns and out.schema.simpleString() == d.schema.simpleString()
    got = out.collect()
    assert got and all(r[c] == v for r in got for c, v in OWN.items()) and any(r["doc_id"] == 5 for r in got)
    assert stage(spark, d.limit(0), str(DATA)).collect() == []


def test_packing_takes_anything(spark):
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, ""), (None, "c d " * 4000)]
    got = corpus_pipeline.pack(spark, _odd_documents(spark, rows), str(DATA)).collect()
    assert sorted((r["doc_id"] or 0) for r in got if r["piece"] == 0) == [0, 0, 1, 1, 2] and {r["length"] for r in got if r["doc_id"] == 2} == {1}
    assert corpus_pipeline.pack(spark, _odd_documents(spark, []), str(DATA)).collect() == []


def test_one_document_of_each_group_stays(spark):
    """Groups go by rows, not by ids: a text is never lost because its id is another group's."""
    a, b = " ".join(f"a{k}" for k in range(300)), " ".join(f"b{k}" for k in range(300))
    rows = [(3, a), (7, a), (7, b), (9, b + " more"), (3, a), (None, b), (None, None), (5, ""), (5, "")]
    d = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, row int")
    got = corpus_pipeline.keep_one_of_a_kind(spark, d, str(DATA)).collect()
    codes = {t: simhash.fingerprint(t) for _, t in rows}
    assert (codes[b] ^ codes[b + " more"]).bit_count() <= 4 and (codes[a] ^ codes[b]).bit_count() > 4
    assert _rows(spark.createDataFrame(got, d.schema)) == _rows(spark.createDataFrame([(3, a, 0), (7, b, 0), (5, "", 0)], d.schema))
