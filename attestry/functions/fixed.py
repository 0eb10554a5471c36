"""Word lists, patterns and tables that results depend on.  They stand here as they must be, for all modules."""

from __future__ import annotations

import re
import unicodedata

STOPWORDS = frozenset(
    """the and for that with from this was were are has have had not but they
    his her its their our your which who whom whose been being other than
    into over under after before during between about above below such more
    most some any all can could would should might will shall must
    also however therefore because since while when where what how why
    der die das den dem des und ist sind war waren nicht auch aber oder
    les des une del las los por para con como que qui est sont pour dans
    sur avec plus mais nel della delle degli sono come anche per
    van het een voor met zijn niet ook maar
    article page site www http https com org net html pdf archived retrieved
    cite citation isbn issn doi accessed""".split()
)
PHRASE_BREAKS = frozenset(
    """a an the of in on at to by for from with as is was were be been being are it its this that these those
    and or but not no nor so than then there their they he she his him her them who whom which what when where
    while also has have had do does did can could would should may might will shall must into onto over under
    after before during about between through up down out off such some any all each other more most many much
    very only just even both either neither however although though because since if until unless whether
    one two three four five six seven eight nine ten first second third including include includes
    became become becomes took take takes taken went go goes gone made make makes led lead leads said say says
    called known used using possesses possess possessed considered consider held hold holds given give gave
    found find finds began begin begins started starts start came come comes saw seen see got get gets
    presumably originally initially usually often later still around almost nearly approximately
    contains contain contained included according reported confirmed refer refers referred""".split()
)
TITLE_SKIPS = frozenset("the and for its his her our are was who how why les des der die das und von del los las une con per".split())
ABBREVIATIONS = frozenset("mr mrs ms dr prof st jr sr vs etc ca approx no nos fig figs vol vols pp ed eds inc ltd co corp cf al dept univ mt est ave rd".split())
HARD_STOPS = "。！？؟۔।॥"
OPENERS = "A-ZÀ-ÞА-ЯΑ-Ω(“\"'0-9"

#: Zeros of the digit blocks that are read as ASCII digits.
DIGIT_ZEROS = (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50, 0xFF10)
DIGITS_FROM = "".join(chr(z + d) for z in DIGIT_ZEROS for d in range(10))
DIGITS_TO = "0123456789" * len(DIGIT_ZEROS)
GROUP_MARKS = ",.\u00a0\u2009\u202f"

#: Positional arguments that stay of an inline template; None: all of them.
INLINE_TEMPLATES = {
    "convert": (0, 1), "cvt": (0, 1), "val": (0,), "formatnum": (0,), "nowrap": None, "nobr": None, "lang": (1,), "langx": (1,),
    "transliteration": (1,), "transl": (1,), "circa": None, "c": None, "as of": (0,), "asof": (0,), "start date": None, "end date": None,
    "birth date": None, "death date": None, "sic": (0,),
}
FOREIGN_CITES = frozenset((
    "internetquelle", "literatur", "lien web", "ouvrage", "article", "périodique", "lien brisé", "cita web", "cita publicación", "cita libro",
    "cita noticia", "cita news", "cita pubblicazione", "cita testo", "citeer web", "citeer boek", "citeer nieuws", "cytuj stronę", "cytuj książkę",
    "cytuj pismo", "cytuj", "citar web", "citar livro", "citar jornal", "citar periódico", "статья", "книга", "публикация", "cite news2", "webbref",
    "bokref", "tidningsref", "citace elektronické monografie", "citace monografie", "citace periodika", "verkkoviite", "kirjaviite", "lehtiviite",
    "kilde www", "kilde bok", "kilde avis", "web kaynağı", "hivatkozás", "cite web/hu",
))
SHORT_FOOTNOTES = frozenset(("sfn", "sfnp", "sfnm", "harvnb", "harv", "harvtxt", "harvp", "r"))
FIELD_KEYS = {
    "url": ("url", "chapter-url", "article-url", "entry-url", "transcript-url", "lien", "adresse", "ссылка"),
    "title": ("title", "chapter", "article", "entry", "titel", "titre", "título", "titulo", "titolo", "tytuł", "tytul", "otsikko", "tittel", "заголовок", "название", "başlık"),
    "work": (
        "work", "website", "newspaper", "magazine", "journal", "publisher", "periodical", "encyclopedia", "site", "werk", "hrsg", "herausgeber", "verlag",
        "éditeur", "editeur", "site-web", "obra", "editorial", "editore", "opublikowany", "wydawca", "uitgever", "utgivare", "julkaisija", "издательство",
        "издание", "periódico",
    ),
    "author": ("author", "author1", "last", "last1", "authors", "first", "autor", "auteur", "autore", "författare", "forfatter", "tekijä", "автор", "авторы", "yazar"),
    "date": ("date", "year", "publication-date", "datum", "jahr", "fecha", "año", "ano", "data", "rok", "année", "vuosi", "år", "дата", "год", "tarih"),
    "quote": ("quote", "quotation", "zitat", "cita", "cytat", "цитата"),
}
NEWS_DOMAINS = (
    "nytimes.com", "washingtonpost.com", "theguardian.com", "bbc.com", "bbc.co.uk", "reuters.com", "apnews.com", "bloomberg.com", "wsj.com", "ft.com",
    "economist.com", "npr.org", "cnn.com", "aljazeera.com", "lemonde.fr",
)
JOURNAL_DOMAINS = (
    "doi.org", "ncbi.nlm.nih.gov", "pubmed.ncbi.nlm.nih.gov", "arxiv.org", "nature.com", "science.org", "springer.com", "sciencedirect.com", "jstor.org",
    "cambridge.org", "oxfordjournals.org", "wiley.com", "tandfonline.com", "academic.oup.com",
)
BOOK_PLACES = ("books.google.com", "archive.org/details")
UNRELIABLE_DOMAINS = (
    "dailymail.co.uk", "thesun.co.uk", "mirror.co.uk", "rt.com", "sputniknews.com", "breitbart.com", "infowars.com", "naturalnews.com",
    "occupydemocrats.com", "thegatewaypundit.com", "zerohedge.com", "theepochtimes.com", "presstv.com", "globalresearch.ca", "veteranstoday.com",
    "wnd.com", "newsmax.com", "oann.com", "wikipedia.org", "wikia.com", "fandom.com", "reddit.com", "quora.com", "answers.com", "medium.com", "substack.com",
)
LENDING = ("inlibrary", "lendinglibrary")
PRINT_DISABLED = "printdisabled"
QUERY_SYNTAX = "/\\~[]{}^*?:()!+&|<>="
KEPT_PARAMS = ("url", "url-access", "via", "access-date")
WORK_PARAMS = ("website", "work", "newspaper", "magazine", "journal", "periodical")
PARAM_ORDER = (
    "title", "work", "website", "newspaper", "magazine", "journal", "periodical", "edition", "series", "volume", "issue", "pages", "others", "publisher",
    "location", "date", "year", "language", "isbn", "issn", "oclc", "doi", "pmid", "pmc", "url", "url-access", "via", "access-date", "archive-url", "archive-date",
)
TAG = (
    r"\{\{\s*(?:safesubst:|subst:)?\s*(?:cn|cb|fact|citation[ _-]?needed|cite[ _-]?needed|ref[ _-]?needed|needs?[ _-]citation|citation[ _-]requested"
    r"|source[ _-]?needed|needs?[ _-]source|cn[ _-]needed)(?:\s*\|[^{}]*)?\s*\}\}"
)
SISTER_LANGUAGES = (
    "en", "de", "fr", "es", "it", "ru", "ja", "nl", "pl", "pt", "sv", "cs", "uk", "ca", "fi", "no", "da", "he", "hu", "tr", "ko", "zh", "ar", "id", "fa", "vi",
)
#: What is taken out of markup before and after its templates: pattern, flags, what stands for it.
BEFORE_TEMPLATES = (
    (r"<!--.*?-->", re.S, " "),
    (r"<ref[^>]*/\s*>", re.I, " "),
    (r"<ref.*?</ref\s*>", re.I | re.S, " "),
    (r"<references.*?</references\s*>", re.I | re.S, " "),
    (r"</?(?:references|gallery|math|score|syntaxhighlight|nowiki|poem|small|sub|sup|br|div|span|blockquote|code|pre)[^>]*>", re.I, " "),
    (r"^\s*\{\|.*?^\s*\|\}", re.M | re.S, " "),
)
AFTER_TEMPLATES = (
    (r"\[\[\s*(?:File|Image|Media|Category|Категория|Fichier|Datei|Archivo)\s*:.*?\]\]", re.I | re.S, " "),
    (r"\[\[([^\]|]*)\|([^\]]*)\]\]", 0, r"\2"),
    (r"\[\[([^\]]*)\]\]", 0, r"\1"),
    (r"\[(?:https?:)?//\S+\s+([^\]]*)\]", 0, r"\1"),
    (r"\[(?:https?:)?//\S+\]", 0, " "),
    (r"'{2,5}", 0, ""),
    (r"^[*#:;]+\s*", re.M, ""),
    (r"^=+\s*(.*?)\s*=+\s*$", re.M, r"\1."),
    (r"&nbsp;|&#160;", re.I, " "),
    (r"&amp;", re.I, "&"),
    (r"[ \t]+", 0, " "),
    (r"\s*\n\s*", 0, "\n"),
)
#: The fields of a book's template that name who wrote it, in the order in which they are looked at.
BOOK_NAMES = ("last", "last1", "author", "author1", "editor-last", "editor1-last", "editor")
#: Rendered pages: blocks, what is not read in them, the tag's class, links that are none; elements without content; where the search for an
#: open element ends; and what ends as what opens (ended, by, not past).
BLOCK_TAGS = frozenset(["p", "li", "dd", "dt", "td", "th"])
FOOTNOTE_TAGS = frozenset(["sup"])
EDIT_CLASSES = frozenset(["mw-editsection"])
UNREAD_CLASSES = frozenset(["reference", "mw-editsection", "cnfirmed-badge"])
TAG_CLASS = "Template-Fact"
NO_LINKS = frozenset(["new", "external"])
NAMESPACES = r"(?:File|Image|Category|Help|Special|Template|Wikipedia):"
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
SCOPES = frozenset("table td th caption button object template".split())
TABLE_PARTS = frozenset("table caption tr td th tbody thead tfoot".split())
TABLE_SCOPES = frozenset(["table", "template"])
_LISTS = SCOPES | {"ul", "ol"}
_P_ENDS = frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article nav header footer aside blockquote pre hr form figure main address details fieldset li dd dt menu center".split())
LEFT_OUT = (
    (frozenset(["li"]), frozenset(["li"]), _LISTS),
    (frozenset(["dd", "dt"]), frozenset(["dd", "dt"]), SCOPES | {"dl"}),
    (frozenset(["td", "th"]), frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]), TABLE_SCOPES),
    (frozenset(["tr"]), frozenset(["tr", "tbody", "thead", "tfoot"]), TABLE_SCOPES),
    (frozenset(["p"]), _P_ENDS, SCOPES),
)


def _accents() -> tuple[str, str]:
    """Letters that canonical decomposition splits into one base letter and marks of U+0300 to U+036F, and their base letters."""
    letters, bases = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x0370, 0x0530), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all("\u0300" <= c <= "\u036f" for c in parts[1:]):
            letters.append(chr(code))
            bases.append(parts[0])
    return "".join(letters), "".join(bases)


ACCENTED, UNACCENTED = _accents()
