"""SQL pieces that the queries' DuckDB equivalents share."""

from __future__ import annotations

from ..functions import fixed

_QUOTED = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
STOP = f"[{_QUOTED(sorted(fixed.STOPWORDS))}]"
BLOCKED = f"[{_QUOTED(fixed.UNRELIABLE_DOMAINS)}]"
JOURNALS = f"[{_QUOTED(fixed.JOURNAL_DOMAINS)}]"
NEWS = f"[{_QUOTED(fixed.NEWS_DOMAINS)}]"


def joined(text: str) -> str:
    """Grouped digits joined, for groups of up to three marks."""
    for n in (3, 2, 1):
        groups = "".join(rf"[,.]([0-9]{{3}})" for _ in range(n))
        pattern = rf"(^|[^0-9A-Za-z_])([0-9]{{1,3}}){groups}($|[^0-9A-Za-z_])"
        keep = "".join(f"\\{k}" for k in range(1, n + 4))
        for _ in range(2):
            text = f"regexp_replace({text}, '{pattern}', '{keep}', 'g')"
    return text


def words(text: str) -> str:
    found = f"regexp_extract_all(translate({joined(text)}, '‘’“”', ''''''''''), '[\\p{{L}}\\p{{N}}''’-]+')"
    return f"list_filter(list_transform({found}, lambda w: trim(w, '-''')), lambda w: w <> '')"


def fold(text: str) -> str:
    return f"lower(strip_accents({text}))"


def is_content(token: str) -> str:
    return f"(NOT list_contains({STOP}, {token}) AND (regexp_matches({token}, '[0-9]') OR length({token}) >= 3))"


def tokens(text: str) -> str:
    return f"list_distinct(list_filter(list_transform({words(text)}, lambda w: {fold('w')}), lambda t: {is_content('t')}))"


def weight(raw: str, token: str) -> str:
    return f"CASE WHEN regexp_full_match({token}, '[0-9]{{3,4}}') THEN 300 WHEN regexp_matches({token}, '[0-9]') THEN 250 WHEN regexp_matches({raw}, '^\\p{{Lu}}') THEN 180 ELSE 100 END"


def key(text: str) -> str:
    return f"trim(regexp_replace({fold(text)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def quote_key(text: str) -> str:
    """As ``key``, words broken by a hyphen and white space joined first (twice, as matches that share a letter cannot both be replaced at once)."""
    text = fold(text)
    for _ in range(2):
        text = f"regexp_replace({text}, '(\\p{{L}})-\\s+(\\p{{L}})', '\\1\\2', 'g')"
    return f"trim(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def host(url: str) -> str:
    return f"regexp_replace(lower(regexp_extract({url}, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '')"


def path(url: str) -> str:
    return f"regexp_extract({url}, '^[a-z]+://[^/?#]+([^?#]*)', 1)"


def query_of(url: str) -> str:
    return f"regexp_extract({url}, '^[^?#]*(\\?[^#]*)', 1)"


def url_key(url: str) -> str:
    return f"{host(url)} || regexp_replace({path(url)}, '/+$', '') || {query_of(url)}"


def under(host_sql: str, listed: str) -> str:
    return f"len(list_filter({listed}, lambda d: {host_sql} = d OR ends_with({host_sql}, '.' || d))) > 0"
