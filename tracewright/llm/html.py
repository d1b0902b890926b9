"""Main text of web pages by site template removal.

1. Each page is parsed, and each block-level subtree hashed twice: by its tags and text, and
   by its *shape*: tags and class names without text, equal neighbours once. Comments and other
   attributes don't count, as they differ between pages. Shapes are taken of containers outside
   a marked article that have a class or role, are sectioning elements or hold at least
   ``SHAPE_ELEMENTS`` elements, and have no heading.
2. Spark counts on how many distinct contents of its host each hash stands. The content
   of a page is the text that rules alone keep, so copies count once, whatever their titles
   or menus. A hash on at least ``LEAST_PAGES`` contents belongs to the template from a share
   of the host's contents on: ``SHARE`` for text, ``SHAPE_SHARE`` for shapes. Those inside a
   marked article are counted for themselves, against the contents of pages that mark one,
   and need ``ARTICLE_SHARE``.
3. Pages are parsed again and subtrees of the template deleted, inside the article too: a
   sentence that a site repeats in fewer of its articles stays. The page, html,
   body, article and main elements, and a subtree with ``MOST`` of the text that rules keep on
   a page, are never template there; the subtrees in them may be. A shape takes less than
   ``SHAPE_MOST`` of a page's text, and all shapes together at most half of it.
4. What a rare host shows too seldom to count goes by rule: elements and class names of
   menus, headers, footers, sidebars, notices, adverts, forms and reader comments. A class name
   counts as a whole: each of its words must name such a thing or its place ("site-footer" does,
   "has-sidebar" doesn't). If the page marks its article, only that is kept. Rules and
   marks can be switched off; then counts alone decide.

Character references are decoded, white space inside a block becomes one space, blocks
are joined by one space in page order. Text directly in a block that has blocks inside is a
block of its own.

Cases: a null html is empty and gives an empty text; a null url is a host of its own;
broken markup (open elements at the end, unknown end tags, cut comments) is read as
browsers do, near enough; repeated pages count once, but each row gets its text (copies that
differ in a word of their text are contents of their own); an empty table gives an empty result; other columns are not read; pages are taken whole.
"""

from __future__ import annotations

import bisect
import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm.hashing import mixed

LEAST_PAGES = 8
SHARE = 0.2
SHAPE_SHARE = 0.5
ARTICLE_SHARE = 0.5
SHAPE_ELEMENTS = 3
SHAPE_MOST = 1 / 3
#: A subtree with this share of a page's text is its content, however often it recurs.
MOST = 0.9
#: Template subtrees that are broadcast at most; beyond it they are joined to the pages.
BROADCAST_SUBTREES = 500_000

# Element names of the HTML standard by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {
    "p": "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split(),
    "li": ["li"],
    "dt": ["dt", "dd"],
    "dd": ["dt", "dd"],
    "tr": ["tr", "tbody", "tfoot"],
    "td": ["td", "th", "tr", "tbody", "tfoot"],
    "th": ["td", "th", "tr", "tbody", "tfoot"],
    "option": ["option", "optgroup"],
}
HOLDS = {"li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"])}
#: Elements beyond which a new one closes nothing.
BOUNDS = ("div", "section", "article", "main", "body")
UNSEEN = frozenset("head script style noscript template iframe svg math button select textarea object embed audio video canvas title noembed noframes xmp".split())
DROPPED = UNSEEN | frozenset("nav footer aside form dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "comment comments reply replies disqus share sharing social related promo promotion sponsor sponsored newsletter subscribe subscription popup modal overlay widget".split()
)
#: Words that say where such a thing is, or how it looks.
PLACES = frozenset(
    "site page main global top bottom left right upper lower primary secondary first second third inner outer box bar block area list item items section container wrapper wrap holder "
    "panel group row col column unit slot header head links buttons icons post posts article blog user reader law policy privacy text content small large wide mobile desktop fixed sticky".split()
)
SECTIONS = frozenset("nav aside footer header form".split())
CONTAINERS = SECTIONS | frozenset("div section ul ol dl menu dialog center".split())
HEADINGS = frozenset("h1 h2 h3".split())
#: Class words of what pages are read for; their shapes are never template.
CONTENT_WORDS = frozenset("content article body text post entry story title headline intro lead lede summary abstract excerpt description chapter prose main".split())
ARTICLE = frozenset(["article", "main"])
NEVER = ARTICLE | {"html", "body"}

#: Kinds of hashes that are counted apart, and what turns a hash into one of its kind.
OUTSIDE, INSIDE, SHAPE = 0, 1, 2
_KIND = tuple(np.uint64(x) for x in (0, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))

#: A tag that is not closed ends where another begins, so no search runs far for nothing.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/<>]*+)((?:"[^"]*+"|'[^']*+'|(?!<[A-Za-z/!?])[^'">])*+)>|<[!?][^<>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLOSED_BY = {new: frozenset(old for old, closers in CLOSES.items() if new in closers) for new in {c for cs in CLOSES.values() for c in cs}}


class Page:
    """Elements of a page (tag, parent, dropped by rule, hashes of text and shape) and its runs of text."""

    __slots__ = ("tags", "parents", "rules", "hashes", "shapes", "runs", "marks", "inside")

    def __init__(self, source: str, rules: bool = True, marks: bool = True):
        self.tags, self.parents, self.rules, self.hashes, self.shapes = ["#page"], [0], [False], [0], [0]
        self.runs: list[tuple[int, str | None]] = []  # (element, text); None ends a block
        self.marks = marks
        self._parse(source, rules)
        #: for each element, whether it stands in an article or is one
        self.inside = [False] * len(self.tags)
        if marks:
            for e in range(1, len(self.tags)):
                self.inside[e] = self.inside[self.parents[e]] or self.tags[e] in ARTICLE

    def _parse(self, source: str, rules: bool) -> None:
        tags, runs = self.tags, self.runs
        stack, parts = [0], [["#page"]]
        # of each open element: its label and the shapes in it, elements in it, whether its shape is out of question
        outlines: list[list] = [[["#page"], 0, True]]
        opened: dict[str, list[int]] = {}  # by name, the depths of open elements
        at = 0

        def close(upto: int) -> None:
            while len(stack) > upto:
                element, part, (outline, size, barred) = stack.pop(), parts.pop(), outlines.pop()
                tag, above = tags[element], outlines[-1]
                opened[tag].pop()
                if len(part) > 1:
                    digest = xxhash.xxh3_64_hexdigest("\x1f".join(part))
                    parts[-1].append(digest)
                    if tag not in INLINE:
                        self.hashes[element] = int(digest, 16)
                above[1] += size + 1
                above[2] |= tag in HEADINGS or tag in ARTICLE
                if tag in INLINE and tag != "a":
                    seen = outline[1:]
                else:
                    shape = outline[0] if len(outline) == 1 else xxhash.xxh3_64_hexdigest("\x1f".join(outline))
                    seen = [shape]
                    if tag in CONTAINERS and not barred and len(outline) > 1 and (outline[0] != tag or tag in SECTIONS or size + 1 >= SHAPE_ELEMENTS):
                        self.shapes[element] = int(shape, 16)
                for x in seen:
                    if above[0][-1] != x:
                        above[0].append(x)
                if tag not in INLINE:
                    runs.append((stack[-1], None))

        def text(raw: str) -> None:
            if raw:
                plain = _html.unescape(raw) if "&" in raw else raw
                runs.append((stack[-1], plain))
                words = plain.split()
                if words:
                    parts[-1].append(" ".join(words))
                    if outlines[-1][0][-1] != "#":
                        outlines[-1][0].append("#")

        while True:
            m = _TAG.search(source, at)
            if m is None:
                text(source[at:])
                break
            text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if opened.get(tag):
                    close(opened[tag][-1])
                continue
            closed = _CLOSED_BY.get(tag)
            if closed:
                bounds = (opened[x][-1] for x in (*BOUNDS, *HOLDS.get(tag, ())) if opened.get(x))
                bound = max(bounds, default=0)
                ends = [d[bisect.bisect_right(d, bound)] for d in (opened.get(x) for x in closed) if d and d[-1] > bound]
                if ends:
                    close(min(ends))
            if tag in VOID:
                runs.append((stack[-1], " ") if tag in ("br", "img", "wbr") else (stack[-1], None))
                continue
            names, words = _names(m[3]) if m[3] else ((), ())
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.hashes.append(0)
            self.shapes.append(0)
            self.rules.append(tag in UNSEEN or rules and _by_rule(tag, names))
            if tag not in INLINE:
                runs.append((stack[-1], None))
            stack.append(len(tags) - 1)
            opened.setdefault(tag, []).append(len(stack) - 1)
            parts.append([tag])
            outlines.append([[".".join([tag, *words]) if words else tag], 0, not CONTENT_WORDS.isdisjoint(words)])
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                stop = end.start() if end else len(source)
                if source[at:stop]:
                    parts[-1].append(source[at:stop])
                at = stop
        close(1)
        within = [False] * len(tags)  # an article
        for e in range(1, len(tags)):
            above = self.parents[e]
            within[e] = within[above] or tags[above] in ARTICLE
            self.rules[e] |= rules and tags[e] == "header" and not within[e]

    def counted(self) -> np.ndarray:
        """Two rows, of text and shape: for each element the hash that is counted, by its kind; 0 for none."""
        never = np.array([t in NEVER for t in self.tags])
        inside = np.array(self.inside)
        hashes, shapes = np.array(self.hashes, np.uint64), np.array(self.shapes, np.uint64)
        none = np.uint64(0)
        return np.array(
            [
                np.where(never | (hashes == 0), none, np.where(inside, hashes ^ _KIND[INSIDE], hashes)),
                np.where(never | inside | (shapes == 0), none, shapes ^ _KIND[SHAPE]),
            ]
        )

    def sizes(self, kept: list[bool]) -> list[int]:
        """Characters of the text below each element that is kept."""
        sizes = [0] * len(self.tags)
        for element, run in self.runs:
            if run is not None and kept[element]:
                sizes[element] += sum(map(len, run.split()))
        for e in range(len(sizes) - 1, 0, -1):
            sizes[self.parents[e]] += sizes[e]
        return sizes

    def kept(self, template: np.ndarray | None = None) -> list[bool]:
        """For each element, whether its own text belongs to the main text; ``template`` marks the hashes that recur, in the rows of ``counted``."""
        by_rule = self._without(None)
        if template is None or not template.any():
            return by_rule
        sizes = self.sizes(by_rule)
        texts = [bool(t) and size < MOST * sizes[0] for t, size in zip(template[0], sizes, strict=True)]
        out = self._without(texts)
        if template[1].any():
            seen = self.sizes([True] * len(self.tags))
            both = self._without([x or bool(t) and size < SHAPE_MOST * seen[0] for x, t, size in zip(texts, template[1], seen, strict=True)])
            if 2 * self.sizes(both)[0] >= self.sizes(out)[0]:
                return both
        return out

    def _without(self, template: list[bool] | None) -> list[bool]:
        n = len(self.tags)
        gone, article = [False] * n, [False] * n
        for e in range(1, n):
            p, tag = self.parents[e], self.tags[e]
            if self.marks and tag in ARTICLE and not self.rules[e] and not article[p]:
                # an article is read even inside an element that was left open by mistake
                article[e], gone[e] = True, False
            else:
                article[e], gone[e] = article[p], gone[p] or self.rules[e] or (template is not None and template[e])
        if any(a and not g for a, g in zip(article, gone, strict=True)):
            return [a and not g for a, g in zip(article, gone, strict=True)]
        return [not g for g in gone]

    def text(self, template: np.ndarray | None = None) -> str:
        kept, blocks, block = self.kept(template), [], []
        for element, run in self.runs:
            if run is None:
                if block:
                    blocks.append("".join(block))
                    block = []
            elif kept[element]:
                block.append(run)
        blocks.append("".join(block))
        return " ".join([b for b in (" ".join(x.split()) for x in blocks) if b])


def _names(attributes: str) -> tuple[tuple[tuple[str, str], ...], tuple[str, ...]]:
    """(attribute, value) of class, id and role; and the words of the classes and the role, sorted."""
    found = tuple((name.lower(), next((v for v in values if v), "").lower()) for name, *values in _ATTRIBUTE.findall(attributes))
    return found, tuple(sorted({w for name, value in found if name != "id" for w in re.split(r"[\s_-]+", value) if w}))


def _by_rule(tag: str, names: tuple[tuple[str, str], ...]) -> bool:
    if tag in DROPPED:
        return True
    if tag in ("html", "body"):
        return False
    for name, value in names:
        if name == "role":
            if value in DROPPED_ROLES:
                return True
        elif name == "class" or tag not in INLINE:
            for one in value.split():
                words = {w for w in re.split(r"[_-]+", one) if w}
                if words and words <= (DROPPED_WORDS | PLACES) and words & DROPPED_WORDS:
                    return True
    return False


def _host(url: str | None) -> int:
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url or "")
    return xxhash.xxh3_64_intdigest(m[1].lower() if m else "")


def _keys(page: Page, host: int) -> np.ndarray:
    """Keys of host and hash in the rows of ``Page.counted``, as signed 64-bit integers; 0 for what isn't counted."""
    counted = page.counted()
    with np.errstate(over="ignore"):
        keys = mixed(np.uint64(host) * np.uint64(0x9E3779B97F4A7C15) + counted)
    return np.where(counted > 0, keys.astype(np.int64), np.int64(0))


def template_subtrees(
    pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE, article_share: float = ARTICLE_SHARE, shape_share: float = SHAPE_SHARE, rules: bool = True, marks: bool = True
) -> DataFrame:
    """key: each (host, subtree) that recurs on enough distinct contents of its host."""

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                hosts, kinds, keys, contents = [], [], [], []
                for url, source in zip(b["url"][at : at + 500], b["html"][at : at + 500], strict=True):
                    page, host = Page(source or "", rules, marks), _host(url)
                    (texts, shapes), inside = _keys(page, host), np.array(page.inside)
                    content = np.uint64(xxhash.xxh3_64_intdigest(page.text())).astype(np.int64)
                    for kind, found in ((OUTSIDE, texts[~inside]), (INSIDE, texts[inside]), (SHAPE, shapes)):
                        if kind != INSIDE or inside.any():
                            own = np.unique(np.append(found, np.int64(0)))  # 0 counts the contents themselves
                            keys.append(own)
                            hosts.append(np.full(len(own), np.uint64(host).astype(np.int64)))
                            kinds.append(np.full(len(own), kind))
                            contents.append(np.full(len(own), content))
                yield pd.DataFrame({"host": np.concatenate(hosts), "kind": np.concatenate(kinds), "key": np.concatenate(keys), "content": np.concatenate(contents)})

    seen = pages.select("url", "html").mapInPandas(in_task, "host long, kind int, key long, content long")
    counts = seen.groupBy("host", "kind", "key").agg(F.count_distinct("content").alias("n"))
    counts = common.stored(counts.filter((F.col("n") >= least) | (F.col("key") == 0)), "subtrees")
    least_share = F.element_at(F.array(F.lit(share), F.lit(article_share), F.lit(shape_share)), F.col("kind") + 1)
    hosts = counts.filter("key = 0").select("host", "kind", F.greatest(F.lit(float(least)), F.col("n") * least_share).alias("__least"))
    found = common.joined_by(counts.filter("key <> 0"), hosts.filter(F.col("__least") > least), ["host", "kind"], "key", "left")
    return found.filter(F.col("n") >= F.coalesce("__least", F.lit(float(least)))).select("key")


def extract(
    pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE, article_share: float = ARTICLE_SHARE, shape_share: float = SHAPE_SHARE,
    rules: bool = True, marks: bool = True, broadcast: int = BROADCAST_SUBTREES,
) -> DataFrame:
    """page_id, url, text of every page."""
    rows = pages.select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    shape = "page_id string, url string, text string"
    recurring = common.saved(template_subtrees(rows, least, share, article_share, shape_share, rules, marks))
    if recurring.limit(broadcast + 1).count() <= broadcast:
        found = np.sort(np.array([r[0] for r in recurring.collect()], np.int64))  # at most ``broadcast`` numbers
        shared = pages.sparkSession.sparkContext.broadcast(found)

        def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = shared.value
            for b in batches:
                texts = []
                for url, source in zip(b["url"], b["html"], strict=True):
                    page = Page(source or "", rules, marks)
                    keys = _keys(page, _host(url))
                    at = np.minimum(np.searchsorted(found, keys), max(len(found) - 1, 0))
                    texts.append(page.text((found[at] == keys) & (keys != 0) if len(found) else None))
                yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts})

        out = rows.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(in_task, shape)
    else:
        out = _extract_joined(rows, recurring, shape, rules, marks)
    return out.withColumn("page_id", F.col("page_id").cast(kind))


def _extract_joined(rows: DataFrame, recurring: DataFrame, shape: str, rules: bool, marks: bool) -> DataFrame:
    """The same with the template subtrees of each page joined to it; equal pages share theirs."""

    def keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = []
            for url, source in zip(b["url"], b["html"], strict=True):
                page = Page(source or "", rules, marks)
                own = np.unique(_keys(page, _host(url)))
                keys.append(own[own != 0])
            yield pd.DataFrame({"page": b["page"], "keys": keys})

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for url, source, keys in zip(b["url"], b["html"], b["keys"], strict=True):
                page = Page(source or "", rules, marks)
                texts.append(page.text(None if keys is None else np.isin(_keys(page, _host(url)), np.asarray(keys, np.int64))))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts})

    named = rows.withColumn("page", F.xxhash64("url", "html"))
    own = named.select("page", "url", "html").mapInPandas(keys_of, "page long, keys array<long>")
    met = own.select("page", F.explode("keys").alias("key")).distinct().join(recurring, "key").groupBy("page").agg(F.collect_list("key").alias("keys"))
    joined = named.join(met, "page", "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "keys")
    return joined.mapInPandas(in_task, shape)


def report(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
