"""Text functions. All are built-in expressions but the Arrow UDFs at the end."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from tessera.functions import markup, phrases
from tessera.lexicon import STOPWORDS


#: So many terms are looked for in the JVM one by one.
FEW = 250


def literal(term: str) -> str:
    """A term as a pattern that Java's engine and RE2 read alike."""
    return re.sub(r"([^\w\s])", r"\\\1", term)


def phrase_pattern(terms: tuple[str, ...]) -> str:
    """Any of the terms between word boundaries, letters of either case."""
    return r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(literal(t) for t in terms) + r")($|[^\p{L}\p{N}_])"


def contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    return text.rlike(phrase_pattern(terms)) if terms else F.lit(False)


def fold(term: str) -> str:
    return unicodedata.normalize("NFKC", term).casefold()


# Letters and signs beyond ASCII that NFKC leaves as they are, beside any other of these, and that case folding only makes small
# (ß and the sigma at a word's end aside): Latin, Greek, Cyrillic, Hebrew, Arabic, Chinese, Japanese, Korean, punctuation and pictures.
STEADY = (
    (0xA1, 0xA7), (0xA9, 0xA9), (0xAB, 0xAE), (0xB0, 0xB1), (0xB6, 0xB7), (0xBB, 0xBB), (0xBF, 0x12F), (0x131, 0x131), (0x134, 0x13E), (0x141, 0x148), (0x14A, 0x17E),
    (0x386, 0x386), (0x388, 0x38A), (0x38C, 0x38C), (0x38E, 0x38F), (0x391, 0x3A1), (0x3A3, 0x3AF), (0x3B1, 0x3CE), (0x400, 0x482), (0x48A, 0x52F), (0x5D0, 0x5EA), (0x621, 0x63A), (0x640, 0x64A),
    (0x200D, 0x200D), (0x2010, 0x2010), (0x2012, 0x2016), (0x2018, 0x2023), (0x2027, 0x2027), (0x2030, 0x2032), (0x2039, 0x203A), (0x20AC, 0x20AC), (0x2190, 0x222B), (0x2500, 0x27BF),
    (0x3001, 0x3029), (0x3030, 0x3035), (0x3041, 0x3096), (0x30A1, 0x30FE), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFE0F, 0xFE0F), (0x1F300, 0x1FAFF),
)
#: Any other letter beyond ASCII. ASCII is told first, by one comparison.
UNSTEADY = r"[\x{80}-\x{10FFFF}&&[^" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in STEADY) + "]]"


def _unsteady(text: Column) -> Column:
    """The text if it must be folded letter by letter, else null."""
    return F.when((F.octet_length(text) != F.char_length(text)) & text.rlike(UNSTEADY), text)


def folded(text: Column) -> Column:
    """NFKC and case folding: in the JVM where all letters are ``STEADY`` or ASCII; other texts in an Arrow UDF, to which these go as null."""
    return F.coalesce(nfkc_casefold(_unsteady(text)), F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ")))


def folded_ascii(text: Column) -> Column:
    """Lower case, null as empty: for comparison with lists of ASCII words."""
    return F.lower(F.coalesce(text, F.lit("")))


def composed(text: Column) -> Column:
    """NFKC, in the same way."""
    return F.coalesce(nfkc(_unsteady(text)), text)


def listed(terms: list[str] | tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, terms)).cast("array<string>")


def term_hits(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms (folded) that stand between word boundaries of a folded text: words by one split and a hash set, phrases where the text contains them at all; of more than ``FEW`` terms by an automaton in Arrow batches."""
    every = tuple(x for x in dict.fromkeys(map(fold, terms)) if x)
    if len(every) > FEW:
        return phrases.phrase_hits(text, every)
    single = [x for x in every if re.fullmatch(r"\w+", x)]
    found = F.array_intersect(F.split(text, r"[^\p{L}\p{N}_]+"), listed(single))
    longer = [F.when(text.contains(x) & text.rlike(phrase_pattern((x,))), x) for x in every if x not in single]
    return F.concat(found, F.array_compact(F.array(*longer))) if longer else found


def squeezed(text: Column) -> Column:
    """White space in a row becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\f]+", " "))


def without_source(title: Column, source: Column) -> Column:
    """The title without a trailing separator and source name."""
    tail = F.regexp_extract(title, r"^(.*?)[ ]+[|—–-][ ]+([^|—–]*)$", 2)
    head = F.regexp_extract(title, r"^(.*?)[ ]+[|—–-][ ]+([^|—–]*)$", 1)
    return F.when((F.length(tail) > 0) & (F.lower(tail) == F.lower(source)), head).otherwise(title)


def without_tags(text: Column) -> Column:
    return squeezed(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]*>", " "))


def canonical_url(url: Column) -> Column:
    """https only: host in lower case, "/" for an empty path, the query kept, the fragment dropped; else null."""
    u = F.trim(url)
    host, path, query = (F.try_parse_url(u, F.lit(x)) for x in ("HOST", "PATH", "QUERY"))
    made = F.concat(F.lit("https://"), F.lower(host), F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    return F.when((F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))) == "https") & host.isNotNull() & F.try_parse_url(u, F.lit("USERINFO")).isNull(), made)


def words(text: Column) -> Column:
    """The [a-z0-9]+ tokens of a folded text in order."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def title_tokens(title: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct tokens in order of value, without common words and without short ones that are not numbers."""
    each = F.array_sort(F.array_distinct(words(title)))
    return F.filter(F.array_except(each, F.array(*map(F.lit, stopwords))), lambda x: (F.length(x) > 2) | x.rlike("^[0-9]+$"))


def fingerprint(url: Column, title: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lower(F.trim(F.coalesce(url, F.lit("")))), F.lower(F.trim(F.coalesce(title, F.lit(""))))), 256)


def event_fingerprint(url: Column, title: Column, at: Column) -> Column:
    """One key for a headline within a UTC day; short headlines keep their fingerprint."""
    w = words(title)
    short = (F.size(w) < 4) | (F.length(F.concat_ws("", w)) < 20)
    return F.when(short, fingerprint(url, title)).otherwise(F.sha2(F.concat(F.lit("headline|"), F.date_format(at, "yyyy-MM-dd"), F.lit("|"), F.concat_ws(" ", w)), 256))


def short_id(prefix: str, digits: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits))


def jaccard(a: Column, b: Column) -> Column:
    """0 where both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def amounts(title: Column) -> Column:
    """The amounts in millions and billions that a title names, as numbers."""
    pattern = r"(?i)([0-9]+(?:\.[0-9]+)?)[ ]*(billion|bn|million|m)($|[^\p{L}\p{N}_])"
    numbers = F.regexp_extract_all(title, F.lit(pattern), 1)
    units = F.regexp_extract_all(title, F.lit(pattern), 2)
    return F.zip_with(numbers, units, lambda n, u: n.cast("double") * F.when(F.lower(u).isin("billion", "bn"), 1e9).otherwise(1e6))


def amounts_match(a: Column, b: Column, tolerance: float = 0.03) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) <= tolerance))


def opening(text: Column, limit: int) -> Column:
    """As much of a text as its first ``limit`` letters need when character references are decoded, marks escaped and white space squeezed; else all of it.

    The opening ends where no reference goes on, and has more than ``limit`` letters beside white space and references, which all stay.
    """
    head = F.regexp_replace(F.substring(text, 1, 2 * limit), r"&[^\t\n\f <&]*+\z", "")
    return F.when(F.char_length(F.regexp_replace(head, r"&[^\t\n\f <&]*+|[ \t\n\r\f]+", "")) > limit, head).otherwise(text)


def clipped(text: Column, limit: int) -> Column:
    """One line; an ellipsis where it was longer than ``limit``."""
    line = squeezed(text)
    return F.when(F.char_length(line) <= limit, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, limit - 1)), F.lit("…")))


def clipped_lines(text: Column, limit: int) -> Column:
    """As ``clipped``, with its lines."""
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…")))


def escaped(text: Column) -> Column:
    """Marks of the chat's markup, and mentions, lose their meaning."""
    return F.regexp_replace(text, r"([\\*_`~|>\[\]()@])", r"\\$1")


@pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else html.unescape(x))


def unescaped(text: Column) -> Column:
    """Character references decoded, in an Arrow UDF, to which only texts with a "&" go."""
    return F.coalesce(_unescaped(F.when(text.contains("&"), text)), text)


def signatures(titles: Column, summary: Column, generic: tuple[str, ...]) -> Column:
    """Exact-content keys of an event: of titles (folded) of five words or more, and of a summary of ten or more."""

    def norm(x: Column) -> Column:
        bare = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"https?://[^ \t\n\r\f]+", " ")
        return F.concat_ws(" ", F.regexp_extract_all(bare, F.lit("([a-z0-9]+)"), 1))

    long = F.filter(F.transform(titles, norm), lambda t: (F.size(F.split(t, " ")) >= 5) & ~t.isin(*generic))
    whole = norm(folded(F.coalesce(summary, F.lit(""))))
    keys = F.transform(long, lambda t: F.sha2(t, 256))
    own = F.when(F.size(F.split(whole, " ")) >= 10, F.array(F.sha2(F.concat(F.lit("event-summary:"), whole), 256))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(keys, own)))


# ------------------------------------------------------------ Arrow UDFs


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@pandas_udf(StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def ratio(x: str | None, y: str | None, least: float = 0.0) -> float:
    """Ratcliff-Obershelp similarity; the order of the arguments matters. Below ``least`` it may be given as 0: lengths and letters alone tell most pairs apart."""
    if x is None or y is None:
        return 0.0
    if x == y:
        return 1.0
    # at that similarity so many characters are inserted or deleted at most, each of which changes five trigrams at most
    edits = (1 - least) * (len(x) + len(y)) + 1e-9
    if abs(len(x) - len(y)) > edits:
        return 0.0
    if 5 * edits < len(x) + len(y) - 4:
        a, b = (Counter(map("".join, zip(z, z[1:], z[2:], strict=False))) for z in (x, y))
        if ((a - b) + (b - a)).total() > 5 * edits:
            return 0.0
    # the parts stand in both texts in one order: together they are a common subsequence
    if 2 * _in_order(x, y) < least * (len(x) + len(y)) - 1e-9:
        return 0.0
    # longest common parts first, as the measure has it; what is still open can add no more than its letters have in common
    m = SequenceMatcher(None, x, y)
    need, found, bound = least * (len(x) + len(y)) / 2 - 1e-9, 0, _common(x, y)
    rest = [(0, len(x), 0, len(y), bound)]
    while rest:
        if found + bound < need:
            return 0.0
        alo, ahi, blo, bhi, most = rest.pop()
        bound -= most
        i, j, k = m.find_longest_match(alo, ahi, blo, bhi)
        if k:
            found += k
            for part in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                most = _common(x[part[0] : part[1]], y[part[2] : part[3]])
                if most:
                    bound += most
                    rest.append((*part, most))
    return 2.0 * found / (len(x) + len(y))


def _in_order(x: str, y: str) -> int:
    """The length of the longest common subsequence: a bit for each letter of x, a step for each of y."""
    at: dict[str, int] = {}
    for k, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << k
    every = rest = (1 << len(x)) - 1
    for c in y:
        hit = rest & at.get(c, 0)
        rest = ((rest + hit) | (rest - hit)) & every
    return len(x) - rest.bit_count()


def _common(x: str, y: str) -> int:
    """How many letters two texts have in common, in any order."""
    if not x or not y:
        return 0
    if len(x) > len(y):
        x, y = y, x
    return sum(min(x.count(c), y.count(c)) for c in set(x))


def sequence_ratio(a: Column, b: Column, least: Column | float = 0.0) -> Column:
    """``ratio`` of two columns. Only for pairs that cheaper tests let pass; texts whose lengths rule the ratio out stay in the JVM."""
    least = F.lit(least) if isinstance(least, float) else least

    @pandas_udf(DoubleType())
    def of(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([ratio(*r) for r in zip(x, y, z, strict=True)], dtype="float64")

    longest = 2 * F.least(F.char_length(a), F.char_length(b)) >= least * (F.char_length(a) + F.char_length(b)) - 1e-9
    return of(F.when(longest, a), F.when(longest, b), least)


_UNSEEN = frozenset(["script", "style", "noscript", "template", "svg"])


def plain_text(source: str | None) -> str:
    parts, unseen = [], 0
    for kind, what, _ in markup.tokens(source):
        if kind == "text":
            if not unseen:
                parts.append(html.unescape(what))
        elif what in _UNSEEN:
            unseen = unseen + 1 if kind == "start" else max(0, unseen - 1)
    return " ".join(html.unescape(" ".join(parts)).split())


@pandas_udf(StringType())
def html_text(source: pd.Series) -> pd.Series:
    """The text of markup without scripts and styles, white space squeezed."""
    return source.map(plain_text)


# Words for actions that did not happen, denials of them, and speculation about them.
_NEGATIVE = r"reject(?:ed|s)?|deny|denied|withdraw(?:n|s)?|withdrew|terminat(?:e|ed|es)|cancel(?:led|ed|s)?|suspend(?:ed|s)?|halt(?:ed|s)?|revok(?:ed|es)|fail(?:ed|s)?"
_DENIAL = r"not|never|no|did not|does not|has not|have not|was not|were not|is not|are not"
_SPECULATION = r"may|might|could|would|possibly|potentially|possible|potential|risk(?:s)?(?:\s+of)?|threat(?:s)?(?:\s+of)?|hypothetical|if|unless|expected\s+to|could\s+eventually"


def confirmed_negative(text: Column) -> Column:
    """Whether a clause states such an action, neither denied (80 characters back) nor speculated about (120 back)."""
    action = rf"(?is)(.*?)\b({_NEGATIVE})\b"
    denied = rf"(?i)\b({_DENIAL})\s+(yet\s+)?(being\s+|been\s+|be\s+)?({_NEGATIVE})\b"
    speculated = rf"(?i)\b({_SPECULATION})\b"

    def stated(clause: Column) -> Column:
        # what stands before each action, and the action, in turn
        parts = F.flatten(F.zip_with(F.regexp_extract_all(clause, F.lit(action), 1), F.regexp_extract_all(clause, F.lit(action), 2), lambda before, word: F.array(before, word)))
        upto = lambda n, most: F.right(F.array_join(F.slice(parts, F.lit(1), n), ""), most)
        places = F.when(F.size(parts) > 0, F.sequence(F.lit(2), F.size(parts), F.lit(2))).otherwise(F.array().cast("array<int>"))
        word = lambda n: F.char_length(F.element_at(parts, n))
        return F.exists(places, lambda n: ~upto(n - 1, F.lit(120)).rlike(speculated) & ~upto(n, word(n) + 80).rlike(denied))

    clauses = F.split(text, r"[.!?;]\s+|,\s+|(?i:\bbut\b|\bhowever\b)")
    return F.when(text.rlike(rf"(?i)\b({_NEGATIVE})\b"), F.exists(clauses, stated)).otherwise(F.lit(False))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))
