"""Long texts and many of them: what is done once, only where it may matter, or a few rows at a time, with the same results."""

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry.functions import edits, markup, words
from attestry.operators import articles, editing, leads, library
from attestry.plans import flows

CLAIM = "In 1887 Ann Hill built the Long Tower of Paris"
PLAIN = "nothing of this is told in these words. " * 200


def test_windows_without_a_strong_unit_are_not_cut_into_words(monkeypatch):
    seen = []
    whole = words.units_in
    monkeypatch.setattr(words, "units_in", lambda text, *rest: seen.append(text) or whole(text, *rest))
    text = PLAIN + "It was in 1887 that the Long Tower of Paris was built by Ann Hill. " + PLAIN
    cut, score, keys = words.best_window(text, CLAIM, "Tower")
    assert "1887" in cut and "1887" in keys and score == 0.5
    assert 0 < len(seen) <= 4


@pytest.mark.parametrize("text", ["in 1,887 words", "Σ 1887 ΑΣ", "é 1887", "१८८७ so", "O’Neil’s 1887", "no strong one"])
def test_windows_of_odd_letters_lose_no_unit(text):
    units, about = words.claim_units("He met O'Neil in 1887, Ann Hill", "x", 5, True)
    held = words.units_in(text, units, about)
    assert not any(u.strong for u in held) or words._may_hold_strong(text, units)(text)


def test_a_claim_is_found_without_a_list_of_all_words(monkeypatch):
    monkeypatch.setattr(edits, "prose_words", None)
    text = PLAIN + "{{x|Ann Hill built it}} [[Paris|Ann]] '''Hill''' built it. " + PLAIN
    a = text.index("Ann]]")
    assert edits.locate(text, "Ann Hill built it") == (a, text.index("built it. ") + 8)
    assert edits.locate(text, "nowhere at all") is None
    assert edits.locate("İ ΑΣ βΣ. Kept on", "ας βς") == (2, 7)


def test_last_line_of_a_text_that_ends_with_a_line_break_is_empty(spark, tmp_path):
    from attestry import queries

    text = "First. Ann Hill built the Long Tower there\n"
    spark.createDataFrame([(0, text), (1, text[:-1]), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = dict(queries.queries()["claims_restated"](spark, str(tmp_path)).collect())
    assert rows == {0: False, 1: True, 2: False}


def test_whole_texts_become_python_objects_a_few_at_a_time():
    class Table:
        schema = [type("Field", (), {"name": "doc_id", "dataType": type("Kind", (), {"simpleString": staticmethod(lambda: "bigint")})})]
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    n = 3 * library.ROWS + 1
    text = "Kept. Words are gone.{{cn}}"
    batch = pa.RecordBatch.from_pandas(pd.DataFrame({"doc_id": range(n), "wikitext": text, "nth": 0, "reference": "<ref>r</ref>"}))
    out = list(editing.replaced(Table(), ["doc_id"])(iter([batch])))
    assert [b.num_rows for b in out] == [library.ROWS] * 3 + [1]
    assert [x for b in out for x in b.column("doc_id").to_pylist()] == list(range(n))
    assert set(out[0].column("edited").to_pylist()) == {"Kept. Words are gone.<ref>r</ref>"}


def test_articles_that_are_sisters_too_are_read_once(spark, monkeypatch):
    text = "== One ==\nThe Long Tower of Ann Hill was built in 1887.<ref>{{cite web|url=https://a.example/x|title=Tower}}</ref>\n\nThe Long Tower of Ann Hill was built in 1887{{cn}}"
    a = spark.createDataFrame([(1, "en", "Tower", text), (2, "de", "Turm", text)], "article_id long, lang string, title string, wikitext string")
    sisters = a.select((3 - F.col("article_id")).alias("article_id"), F.col("article_id").alias("sister_id"), "lang", "title", "wikitext")
    none = spark.createDataFrame([], "title string, lang string, foreign string")
    wanted = sorted(flows.article_leads(a, sisters, none).collect())
    refs = articles.indexed_refs(a, ["article_id"])
    monkeypatch.setattr(articles, "indexed_refs", None)
    assert sorted(flows.article_leads(a, sisters, none, refs=refs).collect()) == wanted and wanted


@pytest.mark.parametrize("source, most", [("The tower of Ann Hill, 1,887 bricks", 1), ("tower ÀNN hill", 1), ("nothing here", 0)])
def test_pairs_are_left_out_only_where_too_few_words_stand(spark, source, most):
    claims = [(1, 0, "Tower Hill 1887", "One", 500, 490, 520, 400, 600)]
    c = spark.createDataFrame(claims, "article_id long, claim_seq int, claim string, section string, offset int, own_start int, own_end int, para_start int, para_end int")
    r = spark.createDataFrame([(1, 0, None, 450, "https://a.example/x", "t", "s", "One", "raw", "paste", source)], "article_id long, ref_seq int, ref_group string, offset int, url string, title string, sentence string, section string, raw string, paste_here string, source_text string")
    a = spark.createDataFrame([(1, "About")], "article_id long, title string")
    assert leads.same_article(c, r, a).count() == most


def test_patterns_that_a_text_cannot_need_are_spared_without_changing_it():
    for text in ("a  b", "a\tb", "x\n\n y", "''a''", "* a", "= H =", "a &amp; b", "[[a|b]] c", "<!-- x -->y", "{| a\n|}", "{{nowrap|a b}}", " plain "):
        plain = text
        for _, pattern, by in markup._BEFORE_TEMPLATES:
            plain = pattern.sub(by, plain)
        plain = markup._without_templates(plain)
        for _, pattern, by in markup._AFTER_TEMPLATES:
            plain = pattern.sub(by, plain)
        assert markup.strip_markup(text) == plain.strip()


def test_a_claims_wordings_are_made_ready_once():
    words._wordings.cache_clear()
    for k in range(5):
        words.locate(f"tower {k} of stone and the hill", [["tower", "towers"], ["hill"]])
    assert words._wordings.cache_info().misses == 2


def test_words_that_come_again_are_folded_once(monkeypatch):
    words._known_content.cache_clear()
    assert list(words.token_set("Tower tower TOWER the Töwer")) == ["tower"]
    assert words._known_content.cache_info().misses == 5
    list(map(words.token_set, ["Tower the Töwer"] * 9))
    assert words._known_content.cache_info().misses == 5


def test_a_claim_is_cut_into_words_once_for_its_passages(monkeypatch):
    words._weights.cache_clear()
    seen = []
    whole = words.words
    monkeypatch.setattr(words, "words", lambda text: seen.append(text) or whole(text))
    for k in range(3):
        assert words.judge_passage(f"{k} men of 1887 and the Long Tower of Ann Hill in Paris", CLAIM, "Tower", False)[0] > 0.5
    assert seen.count(CLAIM) == 1


def test_texts_of_few_claims_are_not_sent_to_a_task_a_claim(spark):
    texts = spark.range(40).select(F.lit("en").alias("claim_id"), F.col("id").alias("doc_id"), F.lit("a tower on a hill").alias("text")).repartition(8)
    claims = spark.createDataFrame([("en", [["tower"], ["hill"]])], "claim_id string, concepts array<array<string>>")
    found = library.located(texts, claims, "doc_id")
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 40 and found.rdd.getNumPartitions() == 8
