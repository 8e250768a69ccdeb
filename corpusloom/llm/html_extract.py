"""Main text of web pages by template deduction over a host's pages.

A page is a sequence of tokens: opening tags, told apart by their path of open elements
and first class or id (plain division elements by their number among their like, so that a
page of nothing but ``div`` has a layout too), and text runs, told apart by path and content.  Pages of a host are
grouped by layout, the containers that each has once.  Tokens that occur equally often in
the same pages of a group have the same occurrence vector and form an equivalence class,
which counts if at least half of the pages have it.  A class is valid if each of its tags
sits below a tag of its own class or of a valid one; the largest class of tags that its
pages have once is the template's skeleton.  Text of valid classes is the template's where
it stands below their tags, in the skeleton or on all pages; once-per-page tags of valid
classes are the slots.  The slot that holds most text that is not part of the template is
the main one, and extraction takes the blocks in it, without the template's text and without
regions whose element or name says that they are menus, adverts and the like.

Occurrence vectors are compared by the exclusive or of a hash of (page, count), summed up
before any shuffle, so all pages count and a host with a third of them is no heavier than
another.  Pages of a layout that is too rare use the template made of all pages of their
host, unless an article of their own lies deeper.  Hosts with fewer than ``support`` pages
with tags, and pages that lack the main slot, use the page's own article or main element,
else the element with most text.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import UPPER, LOWER, cut_lineage, look_up

#: Element and region names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
#: Rejected with all they hold, but made of tags: a start tag without any later end tag is ignored.
EMBEDDED = frozenset("svg math object template noscript".split())
FOREIGN = frozenset(("svg", "math"))
#: Start tags that end open svg and math elements.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
REJECTED = frozenset("head nav footer aside form button select option input dialog menu menuitem datalist".split()) | RAW | EMBEDDED
REJECTED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsense banner sponsor sponsored promo promotion promoted menu nav navbar navigation breadcrumb breadcrumbs sidebar "
    "footer comment comments disqus replies respond cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login social share sharing related recommended "
    "recommendations popup modal overlay widget toolbar pagination pager skip".split()
)
#: Only outside an article, where they name the page's head and not the article's.
REJECTED_OUTSIDE = frozenset(("header", "masthead", "topbar"))
REJECTED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

#: Elements of running text say nothing about a page's layout.
NO_FRAME = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th pre blockquote figure figcaption address hgroup details summary".split())
LAYOUT_DEPTH = 5
#: Without a class or id these say nothing of what they hold; siblings are numbered.
NUMBERED = frozenset("div section".split())
#: Deeper down, their number says how long a story is and not how its page is laid out.
BODY_DEPTH = 3

#: Comments and declarations; tags; tags with a broken quote or no end; text.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|([^<]+|<)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z]+")


class Page:
    """Text runs and tag tokens of one page, in order.

    ``runs`` has (path, block, text, rejected) per text run, ``tags`` has (path, text
    below it that is not rejected) per opening tag.  Unclosed, stray and misnested tags
    are put right as browsers do for paragraphs, list items and table cells.
    """

    def __init__(self, source: str):
        self.runs: list[tuple[str, int, str, bool]] = []
        self.tags: list[list] = []
        self.frame: set[str] = set()
        self.numbers: Counter = Counter()
        # open elements: (name, path, rejected, place in tags, inside an article)
        stack: list[tuple[str, str, bool, int, bool]] = [("", "", False, -1, False)]
        block, at, size = 0, 0, len(source)
        last_end: dict[str, int] = {}
        while at < size:
            m = TOKEN.match(source, at)
            if m is None:
                break
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[6] is not None:
                    self._text(m[6], stack, block)
                continue
            name = name.lower()
            if name not in INLINE:
                block += 1
            if m[1] or m[4]:
                self._close(name, stack)
                continue
            foreign = self._foreign(name, stack)
            closed = m[3] is not None and m[3].endswith("/") and (foreign or name in FOREIGN)
            if name in CLOSES_P:
                self._close_p(stack)
            elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self._close_like(name, stack)
            if name in VOID:
                if name == "br":
                    self._text(" ", stack, block)
                continue
            path, rejected, article = self._enter(name, m[3], stack[-1])
            if name in NUMBERED and path.endswith(f"/{name}") and path.count("/") <= LAYOUT_DEPTH:
                self.numbers[stack[-1][3], name] += 1
                if (n := self.numbers[stack[-1][3], name]) > 1:
                    path = f"{path}[{n}]"
            if closed:
                continue
            if name in EMBEDDED:
                if name not in last_end:
                    last_end[name] = max((e.start() for e in re.finditer(rf"</{name}\b", source, re.I)), default=-1)
                if last_end[name] < at:
                    continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = end.end() if end else size
                continue
            if not rejected and not stack[-1][4] and name not in NO_FRAME and path.count("/") <= (BODY_DEPTH if path.endswith("]") else LAYOUT_DEPTH):
                self.frame.add(path)
            self.tags.append([path, 0])
            stack.append((name, path, rejected, len(self.tags) - 1, article))

    def _enter(self, name: str, attributes: str, parent: tuple) -> tuple[str, bool, bool]:
        first, rejected = "", parent[2] or name in REJECTED
        article = parent[4] or name in ("article", "main")
        if attributes:
            for key, a, b, c in ATTRIBUTE.findall(attributes):
                value = (a or b or c).lower()
                words = NAME.findall(value)
                key = key.lower()
                if key == "role":
                    rejected |= value in REJECTED_ROLES
                    continue
                first = first or (value.split() or [""])[0]
                rejected |= not REJECTED_NAMES.isdisjoint(words) or (not article and not REJECTED_OUTSIDE.isdisjoint(words))
        rejected |= name == "header" and not article
        return f"{parent[1]}/{name}{'.' + first if first else ''}", rejected and name not in ("html", "body", "article", "main") or parent[2], article

    def _text(self, text: str, stack: list, block: int) -> None:
        _, path, rejected, _, _ = stack[-1]
        self.runs.append((path, block, text, rejected))
        if not rejected:
            n = len(text) - text.count(" ")
            for entry in stack[1:]:
                self.tags[entry[3]][1] += n

    def _foreign(self, name: str, stack: list) -> bool:
        """Whether a start tag is inside svg or math; one that cannot be there closes them."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in ("foreignobject", "annotation-xml"):
                return False
            if stack[k][0] in FOREIGN:
                if name not in BREAKOUT:
                    return True
                del stack[k:]
                return self._foreign(name, stack)
        return False

    def _close(self, name: str, stack: list) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                del stack[k:]
                return
            if name in INLINE and stack[k][0] not in INLINE:
                return

    def _close_p(self, stack: list) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == "p":
                del stack[k:]
                return
            if stack[k][0] not in INLINE:
                return

    def _close_like(self, name: str, stack: list) -> None:
        alike = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in alike:
                del stack[k:]
                return
            if stack[k][0] in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "menu", "body", "article"):
                return

    def blocks(self, inside: str, constant: frozenset[int]) -> list[str]:
        """Blocks of kept text at or below the path ``inside``; ``constant`` has template text runs to leave out."""
        out: list[list[str]] = []
        last = None
        below = inside + "/"
        for path, block, text, rejected in self.runs:
            if rejected or not (path == inside or path.startswith(below)) or (constant and run_token(path, text) in constant):
                continue
            if block != last:
                out.append([])
                last = block
            out[-1].append(text)
        joined = (" ".join(entities.unescape("".join(parts)).split()) for parts in out)
        return [x for x in joined if x]

    def own_main(self) -> str:
        """The path of the article or main element with most kept text, else of the deepest element with most of the page's."""
        for name in ("article", "main"):
            held = [(n, path) for path, n in self.tags if last_name(path) == name and n]
            if held:
                return max(held, key=lambda x: x[0])[1]
        whole = max((n for _, n in self.tags), default=0)
        enough = [path for path, n in self.tags if n >= 0.6 * whole and last_name(path) not in INLINE | {"p"}]
        return enough[-1] if enough and whole else ""


    def layout(self) -> int:
        """A hash, never 0, of the kept containers down to ``LAYOUT_DEPTH`` that the page has once, articles' insides apart."""
        often = Counter(path for path, _ in self.tags)
        once = sorted(path for path, n in often.items() if n == 1 and path in self.frame)
        return hash64("\n".join(once)) or 1


def hash64(text: str) -> int:
    """The text's XXH64, signed."""
    import xxhash

    found = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return found - (1 << 64) if found >> 63 else found


def run_token(path: str, text: str) -> int:
    return hash64(f"{path}\n{' '.join(text.split())}")


TOKENS = "host string, layout long, kind string, path string, token long, page long, count int, place int, chars long"
TOKEN_COLUMNS = [c.split()[0] for c in TOKENS.split(", ")]
#: Stands for all layouts of a host.
WHOLE = 0


def last_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".")[0].split("[")[0]


def tokens_of(pages: DataFrame, *, rows: int = 20_000) -> DataFrame:
    """Tokens per page of ``pages(host, page, html)`` that has any tag.

    Kind ``tag`` or ``text``, how often, where first, and kept characters other than
    blanks in or below it; and one of kind ``page`` to count pages by.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for batch in batches:
            for host, key, source in zip(batch["host"], batch["page"], batch["html"], strict=True):
                page, found = Page(source), {}
                if not page.tags:
                    continue
                for place, (path, chars) in enumerate(page.tags):
                    own = found.setdefault(("tag", path), [0, place, 0])
                    own[0] += 1
                    own[2] += chars
                for place, (path, _, text, rejected) in enumerate(page.runs):
                    if not rejected and not text.isspace():
                        own = found.setdefault(("text", path, run_token(path, text)), [0, place, 0])
                        own[0] += 1
                        own[2] += len(text) - text.count(" ")
                layout = page.layout()
                out.append((host, layout, "page", "", 0, key, 1, 0, 0))
                for token, (count, place, chars) in found.items():
                    out.append((host, layout, token[0], token[1], token[2] if token[0] == "text" else hash64(token[1]), key, count, place, chars))
                if len(out) >= rows:
                    yield pd.DataFrame(out, columns=TOKEN_COLUMNS)
                    out = []
        yield pd.DataFrame(out, columns=TOKEN_COLUMNS)

    return pages.mapInPandas(run, TOKENS)


class Token(NamedTuple):
    """A frequent token of a host or layout: on how many pages, and the least, most and sum of its counts there."""

    kind: str
    path: str
    token: int
    pages: int
    vector: int
    low: int
    high: int
    place: int
    chars: int
    times: int


def deduce(tokens: list[Token], *, chance: int = 20) -> tuple[str, list[int], list[int]]:
    """(path of the main slot or '', text runs of the skeleton or of all pages, text runs of nested classes) from frequent tokens.

    In an article or main element a run of under ``chance`` characters is left in, unless
    all text at its path is the template's: short runs recur there by chance.
    """
    classes: dict[tuple, list[Token]] = {}
    for t in tokens:
        classes.setdefault((t.pages, t.vector), []).append(t)
    once = {key: [t for t in ts if t.kind == "tag" and t.low == t.high == 1] for key, ts in classes.items()}
    skeleton = max(classes, key=lambda k: (k[0] * len(once[k]), k), default=None)
    if skeleton is None or not once[skeleton]:
        return "", [], []
    most_pages = max(key[0] for key in classes)
    slots: list[Token] = []
    sure: dict[int, Token] = {}
    nested: dict[int, Token] = {}
    known, left = {""}, sorted(classes, key=lambda k: (-k[0], min(t.place for t in classes[k])))
    found = True
    while found:
        found = []
        for key in left:
            tags = {t.path for t in classes[key] if t.kind == "tag"}
            everywhere = key == skeleton or key[0] >= most_pages
            if (not tags and not everywhere) or any(p.rsplit("/", 1)[0] not in known | tags for p in tags):
                continue
            found.append(key)
            known |= tags
            slots += once[key]
            for t in classes[key]:
                if t.kind == "text" and everywhere:
                    sure[t.token] = t
                elif t.kind == "text" and any(t.path == p or t.path.startswith(p + "/") for p in tags):
                    nested[t.token] = t
        left = [key for key in left if key not in found]
    texts = [*sure.values(), *nested.values()]
    fixed = lambda path: sum(t.chars for t in texts if t.path == path or t.path.startswith(path + "/"))
    free = {t.path: t.chars - fixed(t.path) for t in slots if last_name(t.path) not in INLINE | {"p", "h1", "h2", "h3"}}
    most = max(free.values(), default=0)
    if most <= 0:
        return "", [], []
    named = [p for p in free if last_name(p) in ("article", "main") and free[p] > 0]
    # The innermost slot that still has most of the host's free text.
    main = max(named, key=lambda p: (free[p], len(p))) if named else max((p for p in free if free[p] >= 0.6 * most), key=lambda p: (p.count("/"), free[p]))
    held = {t.path: t.chars for t in tokens if t.kind == "tag"}
    # Where an article is mostly the same text everywhere, its pages are near copies and not a template.
    if named and 2 * sum(t.chars for t in sure.values() if t.path == main or t.path.startswith(main + "/")) > held[main]:
        return main, [], []
    inside = lambda t: t.path == main or t.path.startswith(main + "/")
    out = lambda t: inside(t) and (not named or t.chars >= chance * t.times or held.get(t.path, 0) == fixed(t.path) > 0)
    return main, sorted(k for k, t in sure.items() if out(t)), sorted(k for k, t in nested.items() if out(t))


def templates(pages: DataFrame, *, support: int = 3, share: float = 0.02) -> DataFrame:
    """``(host, template)``: by layout, as JSON, what ``deduce`` finds.

    Layouts that have ``support`` pages and ``share`` of their host's have their own entry,
    so a host has at most ``1 / share`` of them; ``WHOLE`` is made of all its pages with tags.
    """
    each = tokens_of(pages).select("*", F.explode_outer(F.array("layout", F.lit(WHOLE).cast("long"))).alias("group"))
    vector = F.bit_xor(F.xxhash64("page", "count"))
    by = each.groupBy("host", "group", "kind", "path", "token")
    counted = by.agg(F.count(F.lit(1)).alias("pages"), vector.alias("vector"), F.min("count").alias("low"), F.max("count").alias("high"), F.min("place").alias("place"), F.sum("chars").alias("chars"), F.sum("count").alias("times"))
    # A token on fewer than half of ``support`` pages is frequent nowhere.
    kept = cut_lineage(counted.where((F.col("pages") * 2 >= support) | (F.col("kind") == "page")))
    totals = kept.where((F.col("kind") == "page") & (F.col("pages") >= support)).select("host", "group", F.col("pages").alias("total"))
    hosts = totals.where(F.col("group") == WHOLE).select("host", F.col("total").alias("all"))
    sizes = totals.join(hosts, "host").where(F.col("total") >= share * F.col("all")).select("host", "group", "total")
    # Rarer tokens of a hot host are as many as its pages are; they are told from frequent ones without meeting in one task.
    weights = kept.groupBy("host", "group").agg(F.count(F.lit(1)).alias("n"))
    known = cut_lineage(sizes.join(weights, ["host", "group"]))
    # A frequent token is on at least half of its group's pages, so a group has at most twice as many as a page.
    frequent = look_up(kept.where(F.col("kind") != "page"), known, ["host", "group"], "n").where(F.col("pages") * 2 >= F.col("total"))
    grouped = frequent.groupBy("host", "group").agg(F.collect_list(F.struct(*Token._fields)).alias("tokens"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, group, tokens in zip(batch["host"], batch["group"], batch["tokens"], strict=True):
                rows.append((host, json.dumps([group, *deduce([Token(*(t[n] for n in Token._fields)) for t in tokens])])))
            yield pd.DataFrame(rows, columns=["host", "template"])

    found = grouped.mapInPandas(run, "host string, template string")
    return found.groupBy("host").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("template")), ","), F.lit("]")).alias("template"))


@lru_cache(maxsize=256)
def read_template(template: str) -> dict[int, tuple[str, frozenset[int], frozenset[int]]]:
    return {group: (main, frozenset(sure), frozenset(sure) | frozenset(nested)) for group, main, sure, nested in json.loads(template)}


def main_text(source: str, template: str | None) -> tuple[str, bool]:
    """(the page's main text by its layout's template, else by its host's, else by its own elements; whether a template gave it).

    A page that would lose most of its main slot to the text of nested classes is taken
    for one of several copies and loses only what all pages have.
    """
    page = Page(source)
    known = read_template(template) if template else {}
    layout = page.layout() if known else WHOLE
    main, sure, every = known.get(layout) or known.get(WHOLE) or ("", frozenset(), frozenset())
    if main and layout not in known and last_name(main) not in ("article", "main"):
        # An odd page's own article says more than a slot that fits the other pages.
        own = page.own_main()
        main = "" if last_name(own) in ("article", "main") and own.startswith(main + "/") else main
    blocks = page.blocks(main, sure) if main else []
    if blocks and every != sure:
        fewer = page.blocks(main, every)
        blocks = fewer if 2 * sum(map(len, fewer)) >= sum(map(len, blocks)) else blocks
    return "\n".join(blocks or page.blocks(page.own_main(), frozenset())), bool(blocks)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: int = 3, broadcast_bytes: int = 1 << 25) -> DataFrame:
    """``(page_id, url, text, n_chars, by_template)`` per row of ``pages``; ``text`` is empty where nothing is left.

    Null and empty html gives an empty text.  Null and malformed URLs form one host, the
    empty one.  Repeated rows have a row each, and other columns of ``pages`` are not read,
    whatever their names.  ``by_template`` says whether a deduced template gave the text or
    the page's own elements.  Templates go to all executors if they are counted to have at
    most ``broadcast_bytes`` characters, else they are joined by host, where a hot host's
    pages are spread.
    """
    host = F.coalesce(F.translate(F.regexp_extract(url_col, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    known = cut_lineage(templates(own.select("host", F.xxhash64("page_id", "html").alias("page"), "html"), support=support))
    if known.agg(F.coalesce(F.sum(F.char_length("template") + F.char_length("host")), F.lit(0))).first()[0] <= broadcast_bytes:
        joined = own.join(F.broadcast(known), "host", "left")
    else:
        sizes = own.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        joined = look_up(own, cut_lineage(known.join(sizes, "host")), ["host"], "n", most_hot=1000)

    @F.pandas_udf("text string, by_template boolean")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for sources, found in batches:
            yield pd.DataFrame([main_text(source, template) for source, template in zip(sources, found, strict=True)], columns=["text", "by_template"])

    return joined.select("page_id", "url", read("html", "template").alias("found")).select("page_id", "url", "found.text", F.char_length("found.text").cast("long").alias("n_chars"), "found.by_template")
