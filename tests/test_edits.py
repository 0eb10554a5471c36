"""Edits at tags, and requests."""

import json

from pyspark.sql import functions as F

from attestry.functions import edits as E
from attestry.functions import requests as R

TEXT = "One is here.<ref name=\"a\">x</ref> Two is there.{{Citation_needed|date=x}} Three.\n<!-- {{cn}} --><nowiki>{{cn}}</nowiki>\nWrapped {{cn span|the claim|date=y}} goes on. {{box|{{cn}}}}\n"


def test_tags():
    assert [TEXT[a:b] for a, b, _ in E.tags(TEXT)] == ["{{Citation_needed|date=x}}", "{{cn span|the claim|date=y}}"]
    assert E.replace_tag(TEXT, 0, "<ref>r</ref>").split("\n")[0].endswith("Two is there.<ref>r</ref> Three.")
    assert "Wrapped the claim<ref>r</ref> goes on." in E.replace_tag(TEXT, 1, "<ref>r</ref>") and E.replace_tag(TEXT, 2, "") is None
    assert len(E.TAG_NAMES) < 200 and E.WRAPPING < E.TAG_NAMES


def test_remove():
    text = "One.\nTwo is there.<ref name=\"b\">z</ref>{{cn}} Three is. Four.{{fact}}\n\nFive{{cn}}\n\nSix."
    assert E.remove_tagged(text, 0) == ("One.\nThree is. Four.{{fact}}\n\nFive{{cn}}\n\nSix.", ["b"])
    assert E.remove_tagged(text, 1)[0].startswith("One.\nTwo is there.<ref name=\"b\">z</ref>{{cn}} Three is.\n\nFive")
    assert E.remove_tagged(text, 2)[0].endswith("Four.{{fact}}\n\nSix.") and E.remove_tagged(text, 3) is None
    a, b = E.tagged_span(text, 1)
    assert text[a:b] == "Four.{{fact}}"


def test_places():
    text = "An [[mill|old mill]] burnt.<ref>a</ref>{{sfn|B}} It was new. The old mill burnt."
    assert E.citation_point(text, text.index("burnt") + 5) == text.index(" It was")
    a, b = E.locate("A [[x|red house]] stood. A blue house.", "red house stood")
    assert "A [[x|red house]] stood. A blue house."[a:b] == "red house]] stood"
    assert E.locate(text, "old mill burnt", "It was new. The")[0] == text.rindex("old mill") and E.locate(text, "old mill burnt") is None
    assert E.locate(text, "unseen words then It was new") is None and E.locate(text, "") is None
    assert E.restates("The old mill burnt down in 1899", "In 1899 the old mill burnt down") and not E.restates("old mill", "old mill")
    assert E.last_sentence("One. Two is. three") == "Two is. three" and E.last_sentence("only one") == "only one"


def test_requests(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    lit = F.lit
    assert get(R.stream_url(lit("a b"), lit("c/d"))) == "https://archive.org/stream/a%20b/c%2Fd_djvu.txt"
    assert get(R.search_params(lit('"a" b'), lit(5))) == "service_backend=fts&user_query=%22a%22+b&hits_per_page=5"
    body = json.loads(get(R.chat_body(lit("m"), lit("s"), lit("u"), 10)))
    assert body == {"model": "m", "max_tokens": 10, "temperature": 0, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}
    assert get(R.plan_prompt(lit("A_b"), lit(None).cast("string"), lit("p  q"), lit("c"))) == "Article: A b\nSection: (lead)\nParagraph: p q\n\nClaim: c"
    books = F.array(F.struct(lit("T").alias("title"), lit(1900).alias("year"), F.array(lit("x" * 599), lit("y" * 599), lit("z" * 599), lit("w")).alias("passages")))
    told = get(R.judge_prompt(lit("A"), lit("c"), lit("p"), lit("f"), books))
    assert told.startswith("Article: A\nClaim: c\nWhat the claim says") and "B1. T (1900)\n- xxx" in told and "- yyy" in told and "zzz" not in told and "- w" not in told
    results = F.array(F.struct(lit("http://u").alias("url"), lit(None).cast("string").alias("title"), lit("a  b").alias("content"), lit("").alias("raw_content")))
    assert get(R.numbered_results(results)) == "[1] http://u\nTitle: \nExcerpts: a b"
    assert get(R.web_query(lit("A_b"), lit("c " * 400))).startswith("A b: c c") and len(get(R.web_query(lit("A"), lit("c " * 400)))) == 400
