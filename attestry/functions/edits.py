"""Edits of article markup at a tag: where tags are (by the long list of their names), replacing, removing, placing citations."""

from __future__ import annotations

from itertools import islice

import regex as re

from .markup import attributes, mask, parse_template, tagged_sentence, template_spans
from .words import token_set

#: Names of templates that ask for a source, those of them that wrap the claim, and footnote templates.
TAG_NAMES = frozenset(
    (
        "citation needed", "facts", "citeneeded", "citationneeded", "cite needed", "citation required", "uncited", "cn", "needs citation",
        "reference needed", "me fact", "cb", "sourceme", "refneeded", "source needed", "citation missing", "fact", "cite missing", "proveit",
        "talkfact", "fact t", "reference necessary", "refnec", "source?", "refplease", "reference required", "needcite", "needsref", "ref?",
        "citationeeded", "are you sure?", "citesource", "cite source", "ref needed", "citation requested", "needs citations", "fake citation needed",
        "fake fact", "fcitation needed", "request citation", "prove it", "ctn", "fake cn", "citation need", "prov statement", "ciation needed",
        "fakecn", "cit", "unsourced inline", "fact?", "need citation", "no source given", "need ref", "citaiton needed", "needcitation",
        "citationrequired", "unreferenced inline", "cita requerida", "needs reference", "citn", "citazione necessaria", "cn needed", "needs cite",
        "dummy citation needed", "needs source", "citeneed", "need reference", "need a reference", "ai retrieved source", "ai retrieved",
        "citation nedded", "sourceneeded", "need source", "citation needed span", "fact span", "cn span", "citation span", "cns", "cnspan",
        "ctn span", "cit span", "cspan", "citations needed span", "refsou", "cite needed span", "citation needed inline",
        "additional citation needed", "acn", "additional citation", "additional citations needed", "another citation needed", "single source inline",
        "morecitationsneeded", "additional citation(s) needed", "additional source needed", "further citation needed", "additional", "inlinemcn",
        "more citations needed inline", "more citations inline", "medical citation needed", "medcn", "medref inline", "medcite",
        "citation needed (medicine)", "citation needed (medical)", "citation needed medical", "medical source needed", "med cn", "medrs needed",
        "better source needed", "better cite", "better citation", "better reference", "bettersource", "refimprove inline", "bsn", "better",
        "dubious source", "need better citation", "bcn", "better ref needed", "bettersourceneeded", "better citation needed", "betterfact",
        "better reference needed", "better source", "brn", "better cite needed", "primary source inline", "primary source claim", "psc",
        "primary inline", "npsn", "psi", "non primary source needed", "secondary source needed", "primary src inline", "primarysourceinline", "ssn",
        "third party inline",
    )
)
WRAPPING = frozenset(
    (
        "citation needed span", "fact span", "cn span", "citation span", "cns", "cnspan", "ctn span", "cit span", "cspan", "citations needed span",
        "refsou", "cite needed span", "citation needed inline",
    )
)
FOOTNOTES = frozenset(("sfn", "sfnp", "sfnm", "efn", "rp", "r", "refn"))
_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<nowiki\b[^>]*/>|<nowiki\b[^>]*>.*?(?:</nowiki\s*>|\Z)", re.I | re.S)
_WORD = re.compile(r"[\p{L}\p{N}]+")


def template_name(raw: str) -> str:
    """Lower case, without comments and substitution prefixes; underscores and dashes are spaces."""
    raw = re.sub(r"<!--.*?-->", "", raw, flags=re.S)
    return " ".join(re.sub(r"[_\-\s]+", " ", re.sub(r"\A\s*(?:safesubst|subst)\s*:\s*", "", raw, flags=re.I)).split()).lower()


def tags(text: str) -> list[tuple[int, int, str]]:
    """start, end and name of every tag that a reader sees: none in comments, in ``nowiki`` or inside another template."""
    unseen = [m.span() for m in _UNSEEN.finditer(text)]
    closed = {a: b for a, b in template_spans(text).items() if text[b - 2 : b] == "}}"}
    out, past = [], 0
    for start in sorted(closed):
        if start < past or any(a <= start < b for a, b in unseen):
            continue
        past = closed[start]
        name = template_name(text[start + 2 : past - 2].split("|", 1)[0])
        if name in TAG_NAMES:
            out.append((start, past, name))
    return out


def wrapped_text(body: str) -> str:
    t = parse_template(body)
    return t.named.get("text", t.named.get("1", t.positional[0] if t.positional else ""))


def replace_tag(text: str, nth: int, by: str) -> str | None:
    """The text with its ``nth`` tag (from 0) replaced; a claim that the tag wraps stays."""
    found = tags(text)
    if nth >= len(found):
        return None
    start, end, name = found[nth]
    return text[:start] + (wrapped_text(text[start + 2 : end - 2]) if name in WRAPPING else "") + by + text[end:]


def tagged_span(text: str, nth: int) -> tuple[int, int] | None:
    """The sentence of the ``nth`` tag, kept to the tag's own line, without white space around."""
    found = tags(text)
    if nth >= len(found):
        return None
    tag_start, tag_end, _ = found[nth]
    a, b = tagged_sentence(text, tag_start, tag_end)
    line = text.rfind("\n", 0, tag_start) + 1
    close = text.find("\n", tag_end)
    a, b = max(a, line), min(max(b, tag_end), len(text) if close < 0 else close)
    a += len(text[a:tag_start]) - len(text[a:tag_start].lstrip())
    return a, b - (len(text[tag_end:b]) - len(text[tag_end:b].rstrip()))


def remove_tagged(text: str, nth: int) -> tuple[str, list[str]] | None:
    """The text without the ``nth`` tag's sentence, spacing put right, and the names of references that lose their definition.

    Only the sentence's own line changes.  Of a line that it began, the rest keeps the indent; a line that it filled goes as a whole, and
    with it the blank lines that would then follow blank ones.
    """
    span = tagged_span(text, nth)
    if span is None:
        return None
    begin = text.rfind("\n", 0, span[0]) + 1
    finish = text.find("\n", span[1])
    finish = len(text) if finish < 0 else finish
    left, right = text[begin : span[0]], text[span[1] : finish]
    rest = right.lstrip(" \t")
    above, below = text[:begin], text[finish:]
    names = [r["name"] for r in map(attributes, _defined(text[slice(*span)])) if r.get("name")]
    if left.strip():
        line = left.rstrip(" \t") if not right else left + " " * (not left[-1].isspace()) + rest
    elif rest or not below:
        line = (left if rest else "") + rest
    else:
        return above + (below.lstrip("\n") if above.endswith("\n\n") else below[1:]), names
    return above + line + below, names


def _defined(text: str) -> list[str]:
    """The attributes of the reference tags in ``text`` that are no mere uses, as they are written."""
    opened = (m[1] for m in re.finditer(r"<ref(?![\w])([^>]*)>", text, re.I))
    return [x for x in opened if x and not x.endswith("/")]


_PAST = re.compile(r"""[.,;:!?)"”’']|\]\]|</[a-zA-Z]+\s*>|<!--.*?-->|<ref\b[^>]*/\s*>|<ref\b[^>]*>.*?</ref[^>]*>""", re.I | re.S)


def citation_point(text: str, end: int) -> int:
    """Where a reference for the text up to ``end`` goes: past closing marks and footnotes, never past a space."""
    spans = None
    while True:
        m = _PAST.match(text, end)
        if not m and spans is None and text.startswith("{{", end):
            spans = template_spans(text)
        if m:
            end = m.end()
        elif text.startswith("{{", end) and end in spans and text[spans[end] - 2 : spans[end]] == "}}" and template_name(text[end + 2 : spans[end] - 2].split("|", 1)[0]) in FOOTNOTES:
            end = spans[end]
        else:
            return end


#: What is no prose beyond what ``mask`` takes out: what each pattern needs in a text, and the pattern.
_UNREAD = tuple(
    (need, re.compile(pattern, re.I))
    for need, pattern in (
        ("[[", r"\[\[\s*(?:Category|File|Image|Media)\s*:[^\]]*\]\]"), ("[[", r"\[\[[^\[\]|\n]*\|"), ("[", r"\[(?:https?:)?//[^\s\]]+"), ("<", r"</?[a-zA-Z][^>]*>"), ("&", r"&[a-zA-Z0-9#]+;"),
    )
)


def prose(text: str) -> str:
    """The text with all that a reader does not see as words as NULs, one for one."""
    masked = mask(text)
    for need, pattern in _UNREAD:
        if need in masked:
            masked = pattern.sub(lambda m: "\0" * len(m[0]), masked)
    return masked


def prose_words(text: str) -> list[tuple[str, int, int]]:
    """The words a reader sees, lower case, with their places in the markup."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(prose(text))]


def locate(text: str, claim: str, before: str = "", lead: int = 6, tail: int = 6) -> tuple[int | None, int] | None:
    """Where a claim stands in the markup: its one place; of several the one that ``before`` leads to; else the end of its last words."""
    masked = prose(text)
    line = f" {' '.join(_WORD.findall(masked)).lower()} "
    words_of = lambda s: [w.lower() for w in _WORD.findall(s)]
    wanted, led = words_of(claim), words_of(before)[-lead:]

    def places(run: list[str]) -> list[int]:
        """The numbers of the words at which the prose goes on with ``run``."""
        out, want, at = [], f" {' '.join(run)} ", -1
        while run and (at := line.find(want, at + 1)) >= 0:
            out.append(line.count(" ", 0, at))
        return out

    def span(first: int, last: int) -> tuple[int, int]:
        """Where the words of these numbers begin and end in the markup: only they are looked up there."""
        found = list(islice(_WORD.finditer(masked), first, last + 1))
        return found[0].start(), found[-1].end()

    whole = places(wanted)
    if len(whole) > 1:
        # What leads to the claim may be cut short by the beginning of the text.
        whole = [k for k in whole if led and k and k - min(len(led), k) in places(led[-k:] + wanted)]
    if len(whole) == 1:
        return span(whole[0], whole[0] + len(wanted) - 1)
    last = wanted[-tail:]
    ends = places(last)
    return (None, span(ends[0], ends[0] + len(last) - 1)[1]) if len(ends) == 1 else None


def restates(sentence: str, claim: str) -> bool:
    """Nine tenths of the smaller token set are shared, if it has four tokens or more."""
    a, b = token_set(sentence), token_set(claim)
    least = min(len(a), len(b))
    return least >= 4 and len(a.keys() & b.keys()) >= 0.9 * least


#: Searched for from the end.
_LAST_STOP = re.compile(r"(?r)[.!?](?=\s+[A-Z(“\"])")


def last_sentence(text: str) -> str:
    """What follows the last stop before white space and a capital, bracket or quote."""
    stop = _LAST_STOP.search(text)
    return text[stop.end() if stop else 0 :].strip()
