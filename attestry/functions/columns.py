"""Text, number and address functions as Spark expressions: all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_MARKS = f"[{fixed.GROUP_MARKS}]"
_REST = rf"[0-9]{{3}}(?:{_MARKS}[0-9]{{3}})*(?![0-9A-Za-z_])"
#: The digits before each mark that groups them; a match begins at a number's first digits or where the last match ended.
_GROUPED = rf"(?:(?<![0-9A-Za-z_])([0-9]{{1,3}})|\G(?!\A)([0-9]{{3}})){_MARKS}(?={_REST})"


def js_round(x: Column, places: int = 2) -> Column:
    """Half up on the scaled double: 1.005 becomes 1.0."""
    scale = 10.0**places
    return F.floor(x * scale + 0.5) / scale


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` uses it inside its own lambdas."""
    return F.transform(F.array(value), f)[0]


def first_of_each(items: Column, key: Callable[[Column], Column]) -> Column:
    """The items whose key no earlier item has."""
    return bound(items, lambda xs: bound(F.transform(xs, key), lambda keys: F.filter(xs, lambda x, i: F.array_position(keys, key(x)) == i + 1)))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, fixed.DIGITS_FROM, fixed.DIGITS_TO)


def join_digit_groups(text: Column) -> Column:
    """1,250 and 1.250.000 as one number; lists of numbers stay apart."""
    return F.when(text.rlike(f"[0-9]{_MARKS}[0-9]"), F.regexp_replace(text, _GROUPED, "$1$2")).otherwise(text)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def fold(text: Column) -> Column:
    """Lower case without accents: precomposed letters through a table, combining marks dropped."""
    marked = F.translate(text, fixed.DIGITS_FROM + fixed.ACCENTED, fixed.DIGITS_TO + fixed.UNACCENTED)
    return F.lower(F.when(is_ascii(text), text).otherwise(F.regexp_replace(marked, "[\u0300-\u036f]", "")))


def words(text: Column) -> Column:
    """Raw words in order; grouped digits are one word."""
    plain = F.translate(join_digit_groups(ascii_digits(text)), "‘’“”", "''''")
    return _split_words(plain)


def _split_words(plain: Column) -> Column:
    parts = F.split(plain, r"[^\p{L}\p{N}'’-]+")
    return F.filter(F.transform(parts, lambda w: F.trim(w, F.lit("-'"))), lambda w: w != "")


def is_content(folded: Column) -> Column:
    return ~folded.isin(*sorted(fixed.STOPWORDS)) & (folded.rlike("[0-9]") | (F.length(folded) >= 3))


def token_weight(raw: Column, folded: Column) -> Column:
    return F.when(folded.rlike("^[0-9]{3,4}$"), 3.0).when(folded.rlike("[0-9]"), 2.5).when(raw.rlike(r"^\p{Lu}"), 1.8).otherwise(1.0)


def tokens(text: Column) -> Column:
    """Distinct folded content words, in first-use order.

    Only the words are looked at one by one, each as often as it is written in different ways; marks that combine end a word.
    """
    digits = F.when(text.rlike(r"[\p{Nd}&&[^0-9]]"), ascii_digits(text)).otherwise(text)
    raw = F.array_distinct(F.split(join_digit_groups(digits), r"[^\p{L}\p{N}'‘’“”-]+"))
    letters = "‘’“”" + fixed.DIGITS_FROM + fixed.ACCENTED, "''''" + fixed.DIGITS_TO + fixed.UNACCENTED
    plain = F.transform(raw, lambda w: F.lower(F.trim(F.when(is_ascii(w), w).otherwise(F.translate(w, *letters)), F.lit("-'"))))
    telling = F.array_except(plain, F.array(*map(F.lit, sorted(fixed.STOPWORDS))))
    return F.filter(telling, lambda t: (F.length(t) >= 3) | t.rlike("[0-9]"))


def weighted_tokens(text: Column, background: Column | None = None) -> Column:
    """Array of (token, weight) for every content word as written; a background word counts 0.3 of its weight."""
    pairs = F.transform(words(text), lambda w: F.struct(w.alias("raw"), fold(w).alias("token")))

    def weigh(p: Column) -> Column:
        weight = token_weight(p["raw"], p["token"])
        if background is not None:
            weight = F.when(F.array_contains(background, p["token"]), weight * 0.3).otherwise(weight)
        return F.struct(p["token"].alias("token"), weight.alias("weight"))

    return F.transform(F.filter(pairs, lambda p: is_content(p["token"])), weigh)


def has_number(text: Column, number: Column) -> Column:
    """Whether ``number`` stands in ``text`` with no digit on either side."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![0-9])\Q"), number, F.lit(r"\E(?![0-9])")))


def raw_numbers(text: Column) -> Column:
    """Distinct numbers of two digits or more as written, years first."""
    found = F.array_distinct(F.regexp_extract_all(ascii_digits(text), F.lit(r"[0-9](?:[0-9,.]*[0-9])?"), F.lit(0)))
    long = F.filter(found, lambda n: F.length(F.regexp_replace(n, "[,.]", "")) >= 2)
    year = lambda n: n.rlike("^(1[0-9]|20)[0-9]{2}$")
    return F.concat(F.filter(long, year), F.filter(long, lambda n: ~year(n)))


def is_latin(text: Column) -> Column:
    """More than 60 % of the letters of the first 4,000 characters are Latin, or there are fewer than 20 letters."""
    head = F.substring(text, 1, 4000)
    letters, latin = (F.length(F.regexp_replace(head, rf"\P{{{kind}}}+", "")) for kind in ("L", "IsLatin"))
    return F.when(is_ascii(head), True).otherwise(bound(letters, lambda n: (n < 20) | (latin / n > 0.6)))


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def url_key(url: Column) -> Column:
    """Host without www, path without closing slashes, query; no fragment.  What is no address is compared as lower-case text."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    query = F.coalesce(F.concat(F.lit("?"), F.try_parse_url(url, F.lit("QUERY"))), F.lit(""))
    return F.when(F.try_parse_url(url, F.lit("HOST")).isNull(), F.lower(F.trim(url))).otherwise(F.concat(host(url), path, query))


def result_key(url: Column) -> Column:
    """The second key, for comparing runs: no scheme, no www, no closing slash, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, r"^https?://(www\.)?", ""), "/+$", ""))


def under_domains(host_col: Column, domains: Sequence[str]) -> Column:
    """The host is one of the domains or below one: its suffixes, from the second last label on, are looked up."""
    labels = F.split(host_col, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.arrays_overlap(suffixes, F.array(*map(F.lit, domains)))


def is_unreliable(url: Column) -> Column:
    return under_domains(host(url), fixed.UNRELIABLE_DOMAINS)


def cite_kind(url: Column) -> Column:
    book = F.lit(False)
    for place in fixed.BOOK_PLACES:
        book = book | F.contains(F.lower(url), F.lit(place))
    return (
        F.when(under_domains(host(url), fixed.JOURNAL_DOMAINS), "cite journal")
        .when(book, "cite book")
        .when(under_domains(host(url), fixed.NEWS_DOMAINS), "cite news")
        .otherwise("cite web")
    )


def escape_pipes(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("{{!}}"))


def citation(url: Column, title: Column, today: Column) -> Column:
    """struct(template, ref, kind) for an address; ``today`` is given, so that a run can be repeated."""
    kind = cite_kind(url)
    name = F.when(kind == "cite news", F.concat(F.lit(" |work="), host(url))).when(kind == "cite web", F.concat(F.lit(" |website="), host(url))).otherwise("")
    shown = escape_pipes(F.when(F.coalesce(title, F.lit("")) == "", url).otherwise(title))
    template = F.concat(F.lit("{{"), kind, F.lit(" |url="), url, F.lit(" |title="), shown, name, F.lit(" |access-date="), today, F.lit("}}"))
    return F.struct(template.alias("template"), F.concat(F.lit("<ref>"), template, F.lit("</ref>")).alias("ref"), kind.alias("kind"))


def article_url(lang: Column, title: Column) -> Column:
    encoded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(plain))
    return F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), encoded)


def article_ref(text: Column) -> Column:
    """struct(lang, title, error) of an article's address or bare title."""
    address = text.rlike("^https?://")
    where = F.try_parse_url(text, F.lit("HOST"))
    path = F.try_parse_url(text, F.lit("PATH"))
    lang = F.regexp_extract(where, r"^([a-z-]+)\.(?:m\.)?wikipedia\.org$", 1)
    ok = (lang != "") & path.startswith("/wiki/")
    title = F.when(address, F.try_url_decode(F.substring(path, 7, 1 << 30))).otherwise(text)
    return F.struct(
        F.when(~address, "en").when(ok, lang).alias("lang"),
        F.when(~address | ok, F.trim(F.replace(title, F.lit("_"), F.lit(" ")))).alias("title"),
        F.when(address & ~F.coalesce(ok, F.lit(False)), "not an article address").alias("error"),
    )


def year_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?<![0-9A-Za-z_])(1[0-9]{3}|20[0-9]{2})(?![0-9A-Za-z_])", 1), F.lit("")).cast("int")


def strip_highlight(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\{\{\{|\}\}\}|(?i)</?em>", ""), r"(?U)\s+", " "))


def stream_text(html: Column) -> Column:
    """The text of a scanned book's page: entities read, words broken at line ends joined, one line; null without a text, empty of an empty one."""
    body = F.get(F.regexp_extract_all(html, F.lit(r"(?s)<pre[^>]*>(.*?)</pre>"), F.lit(1)), 0)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"-\s*\n\s*", ""), r"\s+", " "))


def clip(text: Column, chars: int) -> Column:
    one_line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one_line) > chars, F.concat(F.left(one_line, F.lit(chars)), F.lit("…"))).otherwise(one_line)


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("..."))).otherwise(text)


def subject_of(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(title, F.lit("_"), F.lit(" ")), r"\s*\([^)]*\)\s*$", ""))


def safe_term(term: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(term, fixed.QUERY_SYNTAX + '"', " " * (len(fixed.QUERY_SYNTAX) + 1)), r"\s+", " "))


def safe_query(query: Column) -> Column:
    """A query without syntax, its quotes in pairs (or none) and no term that begins with a dash."""
    plain = F.translate(query, fixed.QUERY_SYNTAX, " " * len(fixed.QUERY_SYNTAX))
    even = F.when(F.regexp_count(plain, F.lit('"')) % 2 == 1, F.replace(plain, F.lit('"'), F.lit(" "))).otherwise(plain)
    tight = F.regexp_replace(F.regexp_replace(even, r'"\s*"', " "), r'"\s*([^"]*?)\s*"', '"$1"')
    return F.trim(F.regexp_replace(F.regexp_replace(tight, r"(^|\s)-+", "$1"), r"\s+", " "))


def edition_key(title: Column) -> Column:
    """The main title's first eight words, folded, without articles."""
    main = F.element_at(F.split(title, r"\s*[:;]\s*"), 1)
    parts = F.split(F.regexp_replace(fold(main), r"[^\p{L}\p{N} ]+", " "), r"\s+")
    return F.array_join(F.slice(F.filter(parts, lambda w: (w != "") & ~w.isin("the", "a", "an")), 1, 8), " ")


def copy_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


def quote_key(text: Column) -> Column:
    """As ``copy_key``, words broken by a hyphen and white space joined first."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(text), r"(\p{L})-\s+(?=\p{L})", "$1"), r"[^\p{L}\p{N}]+", " "))


def quote_in_passages(quote: Column, passages: Column) -> Column:
    """Every piece between ellipses is in the passages, spaces aside, and the pieces have three words or more together."""
    pieces = F.filter(F.transform(F.split(quote, r"\[\s*\.\.\.\s*\]|\.\.\.|…"), quote_key), lambda p: p != "")
    hay = F.replace(F.array_join(F.transform(passages, quote_key), " "), F.lit(" "), F.lit(""))
    return (F.size(F.split(F.array_join(pieces, " "), " ")) >= 3) & F.forall(pieces, lambda p: F.contains(hay, F.replace(p, F.lit(" "), F.lit(""))))


def _padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def _within(padded: Column, w: Column) -> Column:
    plural = w.rlike(r"\p{L}$") & (F.contains(padded, F.concat(F.lit(" "), w, F.lit("s "))) | F.contains(padded, F.concat(F.lit(" "), w, F.lit("es "))))
    return (w != "") & (F.contains(padded, _padded(w)) | plural)


def _keys(text: Column) -> Column:
    return F.struct(_padded(quote_key(text)).alias("joined"), _padded(copy_key(text)).alias("spaced"))


def _mentioned(keys: Column, wording: Column) -> Column:
    return _within(keys["joined"], quote_key(wording)) | _within(keys["spaced"], copy_key(wording))


def mentions(text: Column, wording: Column) -> Column:
    """The wording is in the text as whole words, a plural allowed; hyphens joined or read as spaces."""
    return bound(_keys(text), lambda k: _mentioned(k, wording))


def plan_matched(text: Column, terms: Column) -> Column:
    """The first wording, folded, of each concept (an array of wordings) that the text mentions."""
    hits = bound(_keys(text), lambda k: F.filter(terms, lambda g: F.exists(g, lambda a: _mentioned(k, a))))
    return F.transform(hits, lambda g: fold(g[0]))


def plan_coverage(text: Column, terms: Column) -> Column:
    return F.size(plan_matched(text, terms))


def specificity(group: Column) -> Column:
    """0: a wording has a digit; 1: one begins with a capital; 2: neither."""
    return F.when(F.exists(group, lambda a: a.rlike("[0-9]")), 0).when(F.exists(group, lambda a: F.trim(a).rlike(r"^\p{Lu}")), 1).otherwise(2)


def name_concepts(terms: Column) -> Column:
    return F.filter(terms, lambda g: specificity(g) == 1)


def normalise_isbn(raw: Column) -> Column:
    digits = F.upper(F.regexp_replace(raw, "[^0-9Xx]", ""))
    return F.when(digits.rlike("^(?:[0-9]{9}[0-9X]|[0-9]{13})$"), digits)


def doi_in(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(F.try_url_decode(url), url), r'(?<![0-9A-Za-z_])(10\.[0-9]{4,9}/[^\s?#&"<>]+)', 1)
    bare = F.regexp_replace(F.regexp_replace(found, r"(?i)/(?:full|abstract|pdf|epdf|fulltext)$", ""), r"(?i)\.pdf$", "")
    return F.nullif(F.regexp_replace(bare, "[.,;)]+$", ""), F.lit(""))


def access_gate(mediatype: Column, collections: Column) -> Column:
    """struct(ok, access, reason): lending is looked at before print-disabled."""
    lent = F.arrays_overlap(collections, F.array(*map(F.lit, fixed.LENDING)))
    no_text = F.coalesce(mediatype, F.lit("texts")) != "texts"
    reason = F.when(no_text & (mediatype != ""), "not a text").when(~lent & F.array_contains(collections, fixed.PRINT_DISABLED), "print-disabled readers only")
    return F.struct(reason.isNull().alias("ok"), F.when(reason.isNull(), F.when(lent, "borrow").otherwise("open")).alias("access"), reason.alias("reason"))


def details_gate(dark: Column, restricted: Column, access: Column) -> Column:
    reason = F.when(dark, "withdrawn").when(restricted & (access == "open"), "access restricted")
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def wikilinks(text: Column) -> Column:
    """Distinct (whatever the case) link targets, in order; files and categories are none."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"), F.lit(1))
    names = F.transform(found, lambda t: F.trim(F.regexp_replace(F.replace(t, F.lit("_"), F.lit(" ")), r"^\s*:", "")))
    kept = F.filter(names, lambda t: (t != "") & ~t.rlike(r"(?i)^(?:File|Image|Media|Category)\s*:"))
    return first_of_each(kept, F.lower)


def section_before(starts: Column, names: Column, position: Column) -> Column:
    """The last of ``names`` whose start is before ``position``."""
    at = F.size(F.filter(starts, lambda s: s < position))
    return F.when(at > 0, F.element_at(names, at))


def compact_anchors(matched: Column) -> Column:
    phrases = F.flatten(F.transform(F.filter(matched, lambda m: F.contains(m, F.lit(" "))), lambda m: F.split(m, " ")))
    return F.filter(matched, lambda m: F.contains(m, F.lit(" ")) | ~F.array_contains(phrases, m))


def verdict(raw: Column) -> Column:
    v = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return (
        F.when(v == "SUPPORTED", v).when(v.startswith("PARTIAL"), "PARTIALLY SUPPORTED").when(F.contains(v, F.lit("UNAVAILABLE")), "SOURCE UNAVAILABLE").otherwise("NOT SUPPORTED")
    )


def bucket(verdict_col: Column, reliability: Column) -> Column:
    """Rank of a checked lead: support by a good source, support by a weak one, partial support, the rest."""
    return (
        F.when((verdict_col == "SUPPORTED") & (reliability != "low"), 0)
        .when(verdict_col == "SUPPORTED", 1)
        .when(verdict_col == "PARTIALLY SUPPORTED", 2)
        .otherwise(3)
    )
