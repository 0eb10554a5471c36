"""Completing citations from library catalogue items."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.markup import parse_template
from .joins import small

#: Item types and their templates; fields and the parameters they go to, where a wiki says nothing of its own.
TYPES = {
    "book": "Cite book", "bookSection": "Cite book", "journalArticle": "Cite journal", "magazineArticle": "Cite magazine", "newspaperArticle": "Cite news",
    "webpage": "Cite web", "blogPost": "Cite web", "forumPost": "Cite web", "thesis": "Cite thesis", "report": "Cite report", "conferencePaper": "Cite conference",
    "encyclopediaArticle": "Cite encyclopedia", "dictionaryEntry": "Cite encyclopedia", "videoRecording": "Cite AV media", "film": "Cite AV media",
    "podcast": "Cite podcast", "interview": "Cite interview", "map": "Cite map",
}


def _people(prefix: str = "") -> list[list[str]]:
    return [[f"{prefix}first{n}", f"{prefix}last{n}"] for n in ("", *range(2, 10))]


_COMMON = {
    "title": "title", "url": "url", "date": "date", "accessDate": "access-date", "language": "language", "publisher": "publisher", "archiveUrl": "archive-url",
    "archiveDate": "archive-date", "author": _people(),
}
MAPS: dict[str, dict[str, Any]] = {
    "cite book": {
        "title": "title", "bookTitle": "title", "edition": "edition", "series": "series", "volume": "volume", "publisher": "publisher", "place": "location",
        "date": "date", "language": "language", "ISBN": ["isbn"], "ISSN": ["issn"], "oclc": "oclc", "DOI": "doi", "url": "url", "author": _people(),
        "editor": _people("editor-"), "translator": _people("translator-"), "contributor": "others",
    },
    "cite web": _COMMON | {"websiteTitle": "website", "publicationTitle": "website", "blogTitle": "website", "forumTitle": "website"},
    "cite news": _COMMON | {"publicationTitle": "work", "websiteTitle": "work", "place": "location", "ISSN": ["issn"], "DOI": "doi"},
    "cite journal": _COMMON | {
        "publicationTitle": "journal", "volume": "volume", "issue": "issue", "pages": "pages", "series": "series", "DOI": "doi", "ISSN": ["issn"], "PMID": "pmid",
        "PMCID": "pmc", "editor": _people("editor-"),
    },
    "cite magazine": _COMMON | {"publicationTitle": "magazine", "volume": "volume", "issue": "issue", "pages": "pages", "ISSN": ["issn"]},
}
_PERSON = re.compile(r"(?:(editor|translator)-)?(last|first|author)([0-9]*)")


def is_cite(name: str | None) -> bool:
    return name is not None and re.fullmatch("cite .+|citation", name.strip(), re.I) is not None


def _clean(value: Any) -> str:
    if isinstance(value, bool) or not isinstance(value, str | int | float):
        return ""
    return " ".join(str(value).split()).replace("|", "{{!}}")


def isbn(raw: str) -> str | None:
    digits = re.sub("[^0-9X]", "", raw.upper())
    return digits if re.fullmatch("[0-9]{9}[0-9X]|[0-9]{13}", digits) else None


def lookup(template: str) -> str | None:
    """What the catalogue is asked for a citation: its ISBN, the DOI in its link, or the link; None for scans and other templates."""
    from urllib.parse import unquote

    t = parse_template(re.sub(r"\A\{\{|\}\}\Z", "", template))
    if not is_cite(t.name):
        return None
    number = isbn(t.named.get("isbn", ""))
    url = t.named.get("url", "")
    if number or not re.match("https?://", url, re.I) or re.search(r"(?<!\w)archive\.org/details/", url, re.I):
        return number
    m = re.search(r'(?<![0-9A-Za-z_])(10\.[0-9]{4,9}/[^\s?#&"<>]+)', unquote(url))
    if not m:
        return url
    return re.sub(r"[.,;)]+\Z", "", re.sub(r"(?i)\.pdf\Z", "", re.sub(r"(?i)/(?:full|abstract|pdf|epdf|fulltext)\Z", "", m[1])))


def parameters(item: dict[str, Any], fields: dict[str, Any]) -> dict[str, str]:
    """An item's fields as template parameters: the first value that a parameter gets stays."""
    out: dict[str, str] = {}

    def put(name: Any, value: Any) -> None:
        if isinstance(name, str) and name and (text := _clean(value)):
            out.setdefault(name, text)

    for field, target in fields.items():
        value = item.get(field)
        if value is None:
            continue
        values = value if isinstance(value, list) else [value]
        if isinstance(target, str):
            put(target, values[0] if values else None)
            continue
        for name, v in zip(target, values, strict=False):
            if isinstance(name, str):
                put(name, v)
                continue
            first, last = ([_clean(x) for x in v] + ["", ""])[:2] if isinstance(v, list) else ("", "")
            put(name[1], last or first)  # an organisation has one name
            if last:
                put(name[0], first)
    return out


def _place(param: str) -> tuple[int, int, int]:
    if m := _PERSON.fullmatch(param):
        return {None: 0, "editor": 1, "translator": 2}[m[1]], int(m[3] or 1), int(m[2] == "first")
    return 3, fixed.PARAM_ORDER.index(param) if param in fixed.PARAM_ORDER else len(fixed.PARAM_ORDER), 0


def merged(own: dict[str, str], found: dict[str, str], same_template: bool) -> dict[str, str]:
    """The catalogue's parameters with our link and access date; our other ones fill gaps if the template stays."""
    out = {k: v for k, v in found.items() if k != "url"}
    has_author = any(re.fullmatch("(?:last|author)1?", k) for k in out)
    has_work = any(out.get(k) for k in fixed.WORK_PARAMS)
    for k, v in own.items():
        taken = out.get(k) or (k == "author" and has_author) or (k == "year" and out.get("date")) or (k in fixed.WORK_PARAMS and has_work)
        if k in fixed.KEPT_PARAMS or (same_template and not taken):
            out[k] = v
    return dict(sorted(out.items(), key=lambda kv: _place(kv[0])))


def template_for(item: dict[str, Any], types: dict[str, str], current: str) -> str:
    named = types.get(item.get("itemType", "")) if isinstance(item.get("itemType"), str) else None
    if not is_cite(named):
        return current
    name = named.strip().replace("_", " ")
    return name[:1].lower() + name[1:]


def complete(template: str, items: str | None, types: dict[str, str] | None = None, maps: dict[str, dict[str, Any]] | None = None) -> str:
    """A citation rewritten from a catalogue reply (JSON text); as it was if the reply has nothing usable."""
    try:
        listed = json.loads(items) if items else None
    except ValueError:
        return template
    if not isinstance(listed, list) or not listed or not isinstance(listed[0], dict):
        return template
    t = parse_template(re.sub(r"\A\{\{|\}\}\Z", "", template))
    name = template_for(listed[0], TYPES if types is None else types, t.name)
    fields = (MAPS if maps is None else maps).get(name.lower())
    if not is_cite(t.name) or not is_cite(name) or fields is None:
        return template
    found = parameters(listed[0], fields)
    title = found.get("title", "")
    if not title or re.match("https?://", title, re.I) or title == t.named.get("url"):
        return template
    return "{{" + " |".join([name, *(f"{k}={v}" for k, v in merged(t.named, found, name.lower() == t.name).items())]) + "}}"


def completed(citations: DataFrame, items: DataFrame, column: str = "template") -> DataFrame:
    """``citations`` with ``column`` completed from recorded items (query, body); those without one stay as they are."""

    @F.pandas_udf("string")
    def asked(templates: pd.Series) -> pd.Series:
        return templates.map(lambda t: lookup(t) if t else None)

    @F.pandas_udf("string")
    def rewritten(pairs: pd.DataFrame) -> pd.Series:
        return pd.Series([complete(t, b) if t else t for t, b in pairs.itertuples(index=False)], dtype=object)

    with_query = citations.withColumn("query", asked(F.col(column)))
    joined = with_query.join(small(items.select("query", "body")), "query", "left")
    return joined.withColumn(column, rewritten(F.struct(F.col(column).alias("t"), F.col("body").alias("b")))).drop("body")

