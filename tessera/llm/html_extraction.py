"""Main-text extraction by equivalence-class template deduction.

Every page is cut into tokens: tags with their path of elements and classes and,
outside the article, texts with the path they stand in. A token's occurrence
vector is how often it stands on each page of its host. Tokens with one vector
form an equivalence class; the vector travels as a checksum, a sum over pages of
hash(page, count), so that Spark groups tokens by host and vector with map-side
combine and a host with a third of all pages costs no task more than another.
What stands on most pages of a host is then one row a host, from which the
template is deduced. A class may be valid if it has several tokens or one that
stands once a page, and it is if it nests: each of its tokens stands in a token
of a valid class, in one of its own, or in none. Tokens of valid classes that
stand exactly once are the template. Of a host with several pages, a valid class
with several occurrences a page that holds links outside the article is a menu;
blocks of a menu that say something besides their links stay.

What the page has in an element of the template is a slot. The article's slot is
the template's article or main element; where it has none, the smallest container
of the template that holds at least ``MASS`` of the host's text, links and
constant texts not counted, and a first-level heading above it. A page that has
an article element of its own is judged by that first. Text outside the
article that is itself template goes, from hosts of ``LEAST`` pages on, whatever
its element or class is named, unless the page has no other text. Slots of
navigation, headers, footers, sidebars, notices, adverts, forms, comments,
scripts and styles are known by element, role or class words, also where they
vary from page to page. Constant text in an article is not dropped: a host may
well repeat an article.

Defined results: null or empty HTML gives an empty text; a page whose host has
no template (a single page, or pages without a common part) is judged by its own
elements; repeated pages each count; a null url is a host of its own; where the
pages already have a column of the result's name it gets underscores in front.
Of a page with ``FAILED`` tags that never end, the rest is read without regard to
quotes, in time linear in its length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as c

#: Share of a host's pages on which a template token stands at least (pages may be cut off).
SUPPORT = 0.8
#: Text that repeats is template on hosts of so many pages: fewer may be copies of one another.
LEAST = 3
#: Share of a host's text that the article's slot holds at least.
MASS = 0.85
#: Elements nested deeper stand in the one at this depth, as in browsers.
DEPTH = 512
#: Tags that never end after which quotes are no longer looked at.
FAILED = 8
#: A host with this share of all pages is dealt out to so many parts.
HOT_SHARE, PARTS = 0.001, 64
# Names and attributes are possessive: what a tag has taken it does not give back, so that one that never ends is read once.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|select|title)\b(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|[^<]++|<",
    re.S | re.I,
)
PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<[!?/][^<>]*+>|[^<]++|<", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open element of the first set ends before one of the second.
ENDS = {"p": BLOCKS - {"body", "html", "head"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
OUT = frozenset("head nav footer aside form button dialog menu object audio video canvas".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
OUT_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert "
    "newsletter subscribe subscription signup login sidebar side aside menu menus nav navbar navigation topnav breadcrumb breadcrumbs pagination pager footer foot "
    "masthead topbar toolbar share sharing social related recommended popup modal overlay comment comments commentlist disqus respond replies discussion widget search skip".split()
)
MAIN_ROLES = frozenset(["main", "article"])
#: Elements in which an article's slot is looked for.
CONTAINERS = frozenset("html body div section main article table tbody tr td center".split())
#: What is known of a token: a link outside the article, a text, an article element, a first-level heading, a container.
LINK, SAID, MAIN, HEADING, CONTAINER = 1, 2, 4, 8, 16


def scanned(html: str) -> Iterator[re.Match]:
    """The comments, tags and texts of a page."""
    failed, at = 0, 0
    for m in TOKEN.finditer(html):
        yield m
        at = m.end()
        if m[0] == "<" and html[at : at + 1].isalpha():
            failed += 1
            if failed == FAILED:
                break
    else:
        return
    yield from PLAIN.finditer(html, at)


class Element:
    """An open element, with what holds for it and all it stands in: a block needs only the innermost one, however deep it is."""

    __slots__ = ("name", "path", "own_path", "above", "goes_out", "main", "in_main", "in_link", "size")

    def __init__(self, name: str, path: str, own_path: bool, out: bool, main: bool, above: Element | None) -> None:
        self.name, self.path, self.own_path, self.above, self.main, self.size = name, path, own_path, above, main, 0
        self.goes_out = out or (above is not None and above.goes_out)
        self.in_main = main or (above is not None and above.in_main)
        self.in_link = name == "a" or (above is not None and above.in_link)


def stands_in(element: Element | None, found: Callable[[Element], bool], known: dict[Element, bool]) -> bool:
    """Whether ``found`` holds for an element or one that it stands in; ``known`` keeps the answers of a page."""
    todo, at = [], element
    while at is not None and at not in known:
        todo.append(at)
        at = at.above
    is_in = at is not None and known[at]
    for x in reversed(todo):
        is_in = known[x] = is_in or found(x)
    return is_in


class Page:
    """The blocks of one page, each with the element it stands in, and its tokens."""

    def __init__(self, html: str) -> None:
        self.tokens: dict[str, int] = {}
        self.kinds: dict[str, int] = {}
        self.first: dict[str, int] = {}  # place of a token among the page's tokens
        self.in_article: set[str] = set()  # links there are no menu
        self.blocks: list[tuple[str, Element | None, bool]] = []  # text, innermost element, whether it is links alone
        self.elements: list[Element] = []
        stack: list[Element] = []
        words: list[str] = []
        holder: Element | None = None
        links = True
        open_names: Counter[str] = Counter()

        def end_from(k: int) -> None:
            open_names.subtract(x.name for x in stack[k:])
            del stack[k:]

        def close_block() -> None:
            nonlocal words, links
            if words:
                text = " ".join(entities.unescape("".join(words)).split())
                if text:
                    self.blocks.append((text, holder, links))
                words, links = [], True

        for m in scanned(html):
            name = m[3]
            if name is None:
                first = m[0][0]
                if first != "<" or m[0] == "<":
                    if not words:
                        holder = stack[-1] if stack else None
                    words.append(m[0])
                    links = links and (not m[0].strip() or bool(stack and stack[-1].in_link))
                elif m[1]:
                    words.append(" ")
                continue
            name = name.lower()
            if m[2]:
                if name in BLOCKS:
                    close_block()
                for k in range(len(stack) - 1 if open_names[name] else -1, -1, -1):
                    if stack[k].name == name:
                        end_from(k)
                        break
                    if name not in BLOCKS and stack[k].name in BLOCKS:
                        break  # a stray inline end tag closes no block
                continue
            if name == "br" or name == "img":
                words.append(" ")
            if name in BLOCKS:
                close_block()
                for k in range(len(stack) - 1, -1, -1):
                    above = stack[k].name
                    if above in ENDS and name in ENDS[above]:
                        end_from(k)
                        break
                    if above in BLOCKS:
                        break
            in_main, path = (stack[-1].in_main, stack[-1].path) if stack else (False, "")
            kind, out, main = described(name, m[4], in_main)
            path = f"{path}/{kind}" if name in BLOCKS or name == "a" else path
            if name in BLOCKS:
                self.tokens[path] = self.tokens.get(path, 0) + 1
                self.first.setdefault(path, len(self.first))
                self.kinds[path] = MAIN * main | HEADING * (name == "h1") | CONTAINER * (name in CONTAINERS and not out)
            elif name == "a":
                self.tokens[path] = self.tokens.get(path, 0) + 1
                self.first.setdefault(path, len(self.first))
                if in_main:
                    self.in_article.add(path)
            if name not in VOID and not m[4].endswith("/") and len(stack) < DEPTH:
                stack.append(Element(name, path, name in BLOCKS or name == "a", out, main, stack[-1] if stack else None))
                self.elements.append(stack[-1])
                open_names[name] += 1
        close_block()

    def text_sizes(self) -> dict[str, int]:
        """How much text, links not counted, each path holds."""
        sizes: dict[str, int] = {}
        for x in self.elements:
            x.size = 0
        for text, element, links in self.blocks:
            if not links and element is not None and not element.goes_out:
                element.size += len(text)
        for x in reversed(self.elements):  # what stands in an element was opened after it
            if x.above is not None:
                x.above.size += x.size
            if x.own_path and x.size:
                sizes[x.path] = sizes.get(x.path, 0) + x.size
        return sizes


def described(name: str, attributes: str, inside: bool) -> tuple[str, bool, bool]:
    """An element's name with its classes, whether it holds no main text, and whether it holds the article."""
    classes, words, role, prop = "", [], "", ""
    if "=" in attributes:
        for key, value in ATTRIBUTE.findall(attributes):
            value, key = value.strip("\"'"), key.lower()
            if key == "role":
                role = value.lower()
            elif key == "itemprop":
                prop = value.lower()
            else:
                words += re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
                if key == "class":
                    classes = "." + ".".join(sorted(value.split()))
    article = name in ("article", "main") or role in MAIN_ROLES or prop == "articlebody"
    out = name in OUT or role in OUT_ROLES or (name == "header" and not inside) or (name not in ("html", "body", "article", "main") and not OUT_WORDS.isdisjoint(words))
    return name + re.sub(r"\d+", "0", classes), out, article and not out


def path_of(element: Element | None) -> str:
    return element.path if element is not None else ""


def text_path(text: str, element: Element | None) -> str:
    """The token of a block of text: the path it stands in, and the text (tags have no line feed in their path)."""
    return f"{path_of(element)}\n{text}"


def main_text(html: str | None, template: set[int], menus: set[int], slots: set[int]) -> str:
    """The blocks of the main text, joined by two line feeds."""
    if not html:
        return ""
    page = Page(html)
    left, in_menu = [], {}
    for text, x, links in page.blocks:
        if x is not None and x.goes_out:
            continue
        if menus and links and x is not None and not x.in_main and stands_in(x, lambda e: token_hash(e.path) in menus, in_menu):
            continue
        left.append((text, x))
    own_article = any(x is not None and x.in_main for _, x in left)
    if template and not own_article:
        own = [(text, x) for text, x in left if token_hash(text_path(text, x)) not in template]
        left = own or left
    # the article slot: of the template's article elements, else of the page's, else by what the slots hold
    known: dict[Element, bool] = {}
    holds = [stands_in(x, lambda e: e.main and (not template or token_hash(e.path) in template), known) for _, x in left]
    if not any(holds):
        known = {}
        holds = [x is not None and x.in_main if own_article else stands_in(x, lambda e: token_hash(e.path) in slots, known) for _, x in left]
    if not any(holds):
        return "\n\n".join(text for text, _ in left)
    return "\n\n".join(text for (text, _), held in zip(left, holds, strict=True) if held)


def deduced(rows: list[dict], pages: int) -> tuple[list[int], list[int], list[int]]:
    """Template, menus and article slots of a host, from its frequent tokens."""
    by_token = {r["token"]: r for r in rows}
    classes: dict[int, list[dict]] = {}
    for r in rows:
        classes.setdefault(r["vector"], []).append(r)
    open_ = {v: own for v, own in classes.items() if len(own) > 1 or own[0]["n"] == own[0]["pages"]}
    while True:
        valid = {0} | {r["token"] for own in open_.values() for r in own}
        loose = [v for v, own in open_.items() if any(r["up"] not in valid for r in own)]
        if not loose:
            break
        for v in loose:
            del open_[v]
    valid.remove(0)
    kept = [by_token[t] for t in valid]
    template = {r["token"] for r in kept if r["n"] == r["pages"] and (not r["kind"] & SAID or pages >= LEAST)}
    # links of a class that repeats: each link's element (a list item) shares its vector
    linked = {r["vector"] for r in rows if r["kind"] & LINK}
    menus = {r["up"] for r in kept if pages > 1 and r["n"] != r["pages"] and r["kind"] & LINK and r["vector"] in linked}
    if pages < LEAST or any(by_token[t]["kind"] & MAIN for t in template):
        return sorted(template), sorted(menus), []
    # text that is template itself is no part of what the elements hold
    size = {t: r["size"] for t, r in by_token.items()}
    for t in template:
        if by_token[t]["kind"] & SAID:
            at = by_token[t]["up"]
            while at in by_token:
                size[at] -= by_token[t]["size"]
                at = by_token[at]["up"]
    at, mass = 0, sum(size[t] for t, r in by_token.items() if r["up"] == 0 and not r["kind"] & SAID)
    while mass > 0:
        inner = max((t for t in template if by_token[t]["up"] == at and by_token[t]["kind"] & CONTAINER), key=lambda t: size[t], default=None)
        if inner is None or size[inner] < MASS * mass:
            break
        at, mass = inner, size[inner]
    if not at:
        return sorted(template), sorted(menus), []
    headings = {t for t in template if by_token[t]["kind"] & HEADING and by_token[t]["at"] < by_token[at]["at"]}
    return sorted(template), sorted(menus), sorted({at} | headings)


_hashes: dict[str, int] = {}


def token_hash(path: str) -> int:
    found = _hashes.get(path)
    if found is None:
        if len(_hashes) > 20_000:
            _hashes.clear()
        raw = np.frombuffer(path.encode() or b"/", np.uint8)
        found = _hashes[path] = int(c.as_int64(c.span_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)])))[0])
    return found


def host(url: str) -> F.Column:
    return F.xxhash64(F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))))


def occurrences(pages: DataFrame, html: str) -> DataFrame:
    """One row for each page and token: host, token, page, n, the token that holds it (0: none), its kind, how much text it holds, and its place. Token 0 stands once on every page."""
    names = ["host", "page", "token", "n", "up", "kind", "size", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, _ in c.blocks(batch, "html"):
                out: list[tuple[int, ...]] = []
                for k, text in enumerate(block.column("html").to_pylist()):
                    out.append((k, 0, 1, 0, 0, 0, 0))
                    page = Page(text or "")
                    sizes = page.text_sizes()
                    for path, n in page.tokens.items():
                        up = path.rpartition("/")[0]
                        link = path not in page.in_article and (path.endswith("/a") or path.rpartition("/")[2].startswith("a."))
                        out.append((k, token_hash(path), n, token_hash(up) if up else 0, LINK if link else page.kinds.get(path, 0), sizes.get(path, 0), page.first[path]))
                    said = Counter((text_path(t, x), path_of(x), len(t), links) for t, x, links in page.blocks if x is None or not (x.goes_out or x.in_main))
                    out += [(k, token_hash(path), n, token_hash(up) if up else 0, SAID, 0 if links else n * size, 0) for (path, up, size, links), n in said.items()]
                at = pa.array([x[0] for x in out])
                columns = [block.column("host").take(at), block.column("page").take(at), *[pa.array([x[k] for x in out], pa.int64()) for k in range(1, 7)]]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = pages.select(F.col("_host").alias("host"), F.col("_page").alias("page"), F.col(html).alias("html"))
    return c.batched(rows, run, ", ".join(f"{x} bigint" for x in names))


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Per host: the number of its pages (``all``), its template (tags and texts that stand once on its pages), its menus (elements that hold the links of a repeated class) and its article slots where no element names them."""
    named = pages.select(html, host(url).alias("_host"), F.xxhash64(url, html).alias("_page"))
    vectors = occurrences(named, html).groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum(F.shiftright(F.xxhash64("page", "n"), 24)).alias("vector"), F.max("up").alias("up"), F.bit_or("kind").alias("kind"), F.sum("size").alias("size"), F.avg("at").alias("at")
    )
    vectors = c.stored(vectors, "vectors")
    total = vectors.where("token = 0").select("host", F.col("pages").alias("all"))
    rated = vectors.where("token != 0").join(total, "host").where(F.col("pages") >= SUPPORT * F.col("all"))
    # of tokens that stand on most pages a host has hardly more than a page has
    lists = rated.groupBy("host").agg(F.collect_list(F.struct("token", "pages", "n", "vector", "up", "kind", "size", "at")).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            found = [deduced(rows or [], n) for rows, n in zip(batch.column("tokens").to_pylist(), batch.column("all").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("all"), *[pa.array([x[k] for x in found], kind) for k in range(3)]], ["host", "all", "template", "menus", "slots"])

    return c.batched(total.join(lists, "host", "left"), run, "host bigint, all bigint, template array<bigint>, menus array<bigint>, slots array<bigint>")


def extract(pages: DataFrame, url: str = "url", html: str = "html", text: str = "main_text") -> DataFrame:
    """All columns and ``text``, the main text of each page."""
    columns, text = pages.columns, c.free_name(pages, text)
    h, part, parts, *lists = (c.free_name(pages, x) for x in ("_host", "_part", "_parts", "_template", "_menus", "_slots"))
    found = c.stored(templates(pages, url, html).toDF(h, "n_pages", *lists), "templates")
    # at most 1 / HOT_SHARE hosts have that share of the pages: their pages are dealt out in PARTS, their templates repeated
    grand = found.agg(F.sum("n_pages").alias("grand"))
    hot = F.broadcast(found.select(h, "n_pages").join(F.broadcast(grand), F.col("n_pages") >= HOT_SHARE * F.col("grand")).select(h, F.lit(PARTS).alias(parts)))
    found = found.join(hot, h, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts, "n_pages")
    dealt = pages.withColumn(h, host(url)).join(hot, h, "left")
    dealt = dealt.withColumn(part, F.when(F.col(parts).isNotNull(), F.pmod(F.xxhash64(url, html), F.lit(PARTS)).cast("int")).otherwise(0))
    joined = dealt.join(found.hint("merge"), [h, part], "left").select(*[F.col(f"`{x}`") for x in [*columns, *lists]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _, _ in c.blocks(batch, html):
                texts = [main_text(x, *(set(y or ()) for y in own)) for x, *own in zip(*(block.column(x).to_pylist() for x in [html, *lists]), strict=True)]
                yield pa.RecordBatch.from_arrays([*(block.column(x) for x in columns), pa.array(texts, pa.string())], [*columns, text])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return c.batched(joined, run, f"{fields}, `{text}` string")
