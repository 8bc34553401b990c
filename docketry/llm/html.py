"""HTML main text by consensus host paths.

Every page's containers are scored on the text they hold; a page's best containers vote for their
generalised path (tags and classes from the root, digits taken out).  What is voted for is the whole
article: from the best container the vote goes up to the ``article`` (else ``main``) around it, or
where there is none as far as what a parent adds is text rather than links.  Votes are summed by host in
Spark, each host keeps its ``TOP_PATHS`` strongest paths, and every page is extracted anew from the
first of its host's paths that it has; a page that has none of them uses its own best container, and
a page without containers its body.  Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are left out: by tag and role, by hiding, or by a class or id that names them.  What
holds the article stays whatever it is called: an element with half of what the page's ``article`` and
``main`` elements hold; a form, or one that a class or id names, with three quarters of the text of a page that has
neither; a hidden one with three quarters of the whole text.  A paragraph or list of the article goes by its class only if
that says nothing but what it is (``advert``, not ``story-alert``).

Null html counts as empty and gives an empty text; a null url belongs to the host ''.  Repeated pages
and ids are extracted each for itself, extra columns are not read.  Very long pages are parsed whole, in
time that grows with their length, broken markup included.  Ties between paths go to the path that
sorts first.  An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import table, written

TOP_PATHS, VOTES = 5, 3
#: Over how many tasks the pages of one host are dealt.
SALTS = 16
#: Levels of a path; what is nested deeper shares one path.
DEPTH = 64
# Markup that begins at a "<"; attribute values may hold ">" between quotes.
_QUOTED = r"(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)"
_MARKUP = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|template|noscript|svg|math|iframe|object|canvas|textarea|select|title)\b{skip}>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*){attrs}>|<[!?/][^>]*>"
_TOKEN = re.compile(_MARKUP.format(skip=_QUOTED.replace("?P<attrs>", "?:"), attrs=_QUOTED), re.S | re.I)
#: For pages with a quote that is never closed: the next ">" ends a tag.
_BROKEN = re.compile(_MARKUP.format(skip="[^>]*", attrs="(?P<attrs>[^>]*)"), re.S | re.I)
#: One attribute after another, so that names are told from what stands in values.
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ASKED = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_CONTAINERS = frozenset("article main section div body td".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Left out whatever they hold; by tag or role, with whatever is in them that is no article; by tag or role like a name.
_NEVER = frozenset("head button input select".split())
_REGIONS = frozenset("nav header footer aside menu".split())
_REGION_ROLES = frozenset("navigation banner contentinfo complementary menu menubar".split())
_FORM_ROLES = frozenset("search form".split())
_HIDING_ROLES = frozenset("dialog alert alertdialog".split())
REGION, NAMED, HIDDEN = range(3)
#: Blocks of an article that hold its text.
_TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dd dt blockquote pre figure figcaption table tr th td".split())
# Words of class and id values that name something other than the article.
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner banners cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header masthead topbar toolbar widget widgets "
    "comment comments disqus replies respond reviews share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager".split()
)
# Words that say nothing of their own next to one of those, and words before them that turn their sense.
_PLAIN_WORDS = frozenset(
    "area bar block body bottom box button buttons column container content entry feed field form global group heading icon icons image inner item items left link links list main message middle "
    "module outer page panel post posts primary right row secondary section site slot small social stories story strip tag text thread title top unit wide wrap wrapper zone".split()
)
_TURNING = frozenset("has have no not non with without is hide show".split())
_WORDS = re.compile(r"[A-Z]*[a-z]+|[A-Z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_IN_HEAD = frozenset("base link meta noscript script style template title".split())


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if "=" in text or "hidden" in text.lower():
        for m in _ATTR.finditer(text):
            name = m[1].lower()
            if name in _ASKED:
                out.setdefault(name, m[2] or m[3] or m[4] or "")
    return out


def _apart(tag: str, attrs: dict[str, str], in_article: bool) -> int | None:
    """Whether and by what an element may be left out."""
    role = attrs.get("role", "").lower()
    if attrs.get("aria-hidden") == "true" or "hidden" in attrs or role in _HIDING_ROLES or tag == "dialog":
        return HIDDEN
    if tag in _REGIONS or role in _REGION_ROLES:
        return REGION
    if tag == "form" or role in _FORM_ROLES:
        return NAMED
    return NAMED if attrs and tag not in ("body", "html", "article", "main") and _names_other(attrs, in_article and (tag in _TEXT_BLOCKS or tag in _INLINE)) else None


def _names_other(attrs: dict[str, str], text_block: bool) -> bool:
    """Whether a class or id names something other than the article: it ends in a word for that (``site-header``), or
    holds one among words that say nothing else (``related-posts``); ``share-price`` and ``has-sidebar`` do not.  Of a
    block of the article's text all words must be such words."""
    for name in (*attrs.get("class", "").split(), attrs.get("id", "")):
        words = [w.lower() for w in _WORDS.findall(name) if not w[0].isdigit()]
        if not words or words[0] in _TURNING or _OUT_WORDS.isdisjoint(words):
            continue
        if text_block:
            if _OUT_WORDS.issuperset(words):
                return True
        elif words[-1] in _OUT_WORDS and _TURNING.isdisjoint(words) or all(w in _OUT_WORDS or w in _PLAIN_WORDS for w in words):
            return True
    return False


def _step(tag: str, attrs: dict[str, str]) -> str:
    classes = sorted({_DIGITS.sub("", c) for c in attrs.get("class", "").split()} - {""})
    return ".".join([tag, *classes])


def _tokens(page: str) -> Iterator[re.Match]:
    """Markup of a page, in order.  At most one tag is searched to the end of the page in vain."""
    pattern, at, last = _TOKEN, page.find("<"), page.rfind(">")
    while 0 <= at:
        m = pattern.match(page, at) if at < last or page.startswith(("<!--", "<![CDATA["), at) else None
        if m is None and pattern is _TOKEN and at < last and page[at + 1 : at + 2].strip(" \t\r\n0123456789=<"):
            pattern = _BROKEN
            m = pattern.match(page, at)
        if m is not None:
            yield m
        at = page.find("<", m.end() if m is not None else at + 1)


class Page:
    """The containers of a page, in order, and the pieces of text with the containers they are in."""

    def __init__(self, page: str):
        self.paths: list[str] = []
        self.parents: list[int] = []
        #: (container or -1, text, within a link); None is a break between blocks.
        self.pieces: list[tuple[int, str, bool] | None] = []
        named: list[int] = []  # of every piece, the innermost element that may be left out
        within: list[bool] = []  # and whether it is in an article or main
        above: list[int] = []  # of every such element, the next one around it
        rules: list[tuple[int, bool]] = []  # and why it may be, and whether it is a part of an article
        # Tag, innermost container, left out, path, innermost element that may be, in an article.
        stack: list[tuple[str, int, bool, str, int, bool]] = []
        outside = ("", -1, False, "", -1, False)
        here, out, path, other, inner, at, links, head = -1, False, "", -1, False, 0, 0, -1

        def text(piece: str) -> None:
            nonlocal here, out, path, other, inner
            if 0 <= head < len(stack) and piece.strip():  # text ends a head that was not closed
                del stack[head:]
                here, out, path, other, inner = (stack[-1] if stack else outside)[1:]
            if not out:
                self.pieces.append((here, piece, links > 0))
                named.append(other)
                within.append(inner)

        def gap() -> None:
            self.pieces.append(None)
            named.append(other)
            within.append(inner)

        for m in _tokens(page):
            if m.start() > at:
                text(page[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["raw"] and m["raw"].lower() != "svg" and m["raw"].lower() != "math":
                    gap()
                continue
            tag = tag.lower()
            if tag not in _INLINE:
                gap()
            if m["end"]:
                place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
                # An inline end tag does not close the blocks it stands in.
                if place < 0 or tag in _INLINE and any(s[0] not in _INLINE for s in stack[place + 1 :]):
                    continue
                del stack[place:]
            elif tag in _VOID:
                continue
            else:
                if tag == "head":
                    head = min(head, len(stack)) if 0 <= head < len(stack) else len(stack)
                elif tag not in _IN_HEAD and 0 <= head < len(stack):
                    del stack[head:]
                if len(stack) <= head and tag != "head":
                    head = -1
                if tag in _CLOSES_P:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == "p":
                            del stack[i:]
                            break
                        if stack[i][0] in _CONTAINERS or stack[i][0] in ("table", "button"):
                            break
                elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[tag]
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in same:
                            del stack[i:]
                            break
                        if stack[i][0] in ("ul", "ol", "dl", "table", "select") or stack[i][0] == "tr" and tag != "tr" or stack[i][0] in _CONTAINERS:
                            break
                around = stack[-1] if stack else outside
                attrs = _attributes(m["attrs"]) if m["attrs"] else {}
                own, gone, inside, deep = around[1], around[2] or tag in _NEVER, around[4], around[5]
                if len(stack) < DEPTH:
                    path = f"{around[3]}>{_step(tag, attrs)}" if around[3] else _step(tag, attrs)
                else:
                    path = around[3] if around[3].endswith(">*") else f"{around[3]}>*"
                if not gone and (rule := _apart(tag, attrs, deep)) is not None:
                    above.append(inside)
                    rules.append((rule, deep))
                    inside = len(above) - 1
                deep = deep or tag in ("article", "main")
                if tag in _CONTAINERS and not gone:
                    self.paths.append(path)
                    self.parents.append(around[1])
                    own = len(self.paths) - 1
                if not m["attrs"].endswith("/") or tag in _CONTAINERS:
                    stack.append((tag, own, gone, path, inside, deep))
            here, out, path, other, inner = (stack[-1] if stack else outside)[1:]
            links = sum(s[0] == "a" for s in stack) if tag == "a" or links else 0
        if at < len(page):
            text(page[at:])
        self._leave_out(named, within, above, rules)

    def _leave_out(self, named: list[int], within: list[bool], above: list[int], rules: list[tuple[int, bool]]) -> None:
        """Take out the pieces within elements that are something else, unless those hold the article."""
        if not above:
            return
        size, deep, total, articles = [0] * len(above), [0] * len(above), 0, 0
        for piece, of, inner in zip(self.pieces, named, within, strict=True):
            if piece:
                n = len(piece[1].strip())
                total += n
                articles += n * inner
                if of >= 0:
                    size[of] += n
                    deep[of] += n * inner
        for i in range(len(above) - 1, -1, -1):  # what is inside comes later
            if above[i] >= 0:
                size[above[i]] += size[i]
                deep[above[i]] += deep[i]
        gone: list[bool] = []
        for i, (up, (rule, part)) in enumerate(zip(above, rules, strict=True)):
            if rule == HIDDEN:
                stays = 4 * size[i] >= 3 * total
            elif articles:
                stays = not part and 2 * deep[i] >= articles
            else:
                stays = rule == NAMED and 4 * size[i] >= 3 * total
            gone.append(up >= 0 and gone[up] or not stays)
        self.pieces = [piece if of < 0 or not gone[of] else None for piece, of in zip(self.pieces, named, strict=True)]

    def sizes(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Per container: the text right in it, of links right in it, and both with all that is inside."""
        own, own_links = [0] * len(self.paths), [0] * len(self.paths)
        for piece in self.pieces:
            if piece and piece[0] >= 0:
                (own_links if piece[2] else own)[piece[0]] += len(piece[1].strip())
        every, every_links = own[:], own_links[:]
        for i in range(len(own) - 1, -1, -1):  # children come after their parents
            if self.parents[i] >= 0:
                every[self.parents[i]] += every[i]
                every_links[self.parents[i]] += every_links[i]
        return own, own_links, every, every_links

    def scores(self) -> list[float]:
        """Per container: the text right in it in full, less for each container between; links count against it."""
        own, links, _, _ = self.sizes()
        total = [float(a - b) for a, b in zip(own, links, strict=True)]
        for i, (a, b) in enumerate(zip(own, links, strict=True)):
            share, up = (a - b) / 2, self.parents[i]
            while up >= 0 and abs(share) >= 1:
                total[up] += share
                share, up = share / 2, self.parents[up]
        return total

    def _tag(self, i: int) -> str:
        return self.paths[i].rpartition(">")[2].split(".")[0]

    def whole(self, i: int) -> int:
        """The container of the whole article that container ``i`` belongs to."""
        around, up = [], self.parents[i]
        while up >= 0:
            around.append(up)
            up = self.parents[up]
        for tag in ("article", "main"):
            if self._tag(i) == tag:
                return i
            if held := [u for u in around if self._tag(u) == tag]:
                return held[0]
        _, _, text, links = self.sizes()
        for up in around:
            more, more_links = text[up] - text[i], links[up] - links[i]
            # Up to the body only where most text lies outside: it holds whatever else the page has.
            if more_links > more / 2 or self._tag(up) == "body" and text[i] > more:
                break
            i = up
        return i

    def best(self, n: int) -> list[tuple[str, float]]:
        """The n best paths with their shares of the page's score, strongest first."""
        by: dict[int, float] = {}
        for i, s in enumerate(self.scores()):
            if s > 0:
                by[i] = s
        if not by:
            return []
        top = self.whole(min(by, key=lambda i: (-by[i], self.paths[i])))
        inside = [False] * len(self.paths)
        for i, up in enumerate(self.parents):
            inside[i] = self.paths[i] == self.paths[top] or up >= 0 and inside[up]
        votes: dict[str, float] = {self.paths[top]: 0.0}
        for i, s in by.items():
            if inside[i]:
                votes[self.paths[top]] += s
            elif not self.paths[top].startswith(f"{self.paths[i]}>"):  # what merely surrounds the best is no rival
                votes[self.paths[i]] = votes.get(self.paths[i], 0.0) + s
        ranked = sorted(votes.items(), key=lambda x: (x[0] != self.paths[top], -x[1], x[0]))[:n]
        whole = sum(s for _, s in ranked)
        return [(p, s / whole) for p, s in ranked]

    def text(self, path: str | None) -> str:
        """The text within all containers of ``path`` (None: the whole page)."""
        inside: list[bool] = []
        for p, up in zip(self.paths, self.parents, strict=True):
            inside.append(p == path or up >= 0 and inside[up])
        out = [" " if piece is None else piece[1] for piece in self.pieces if piece is None or path is None or piece[0] >= 0 and inside[piece[0]]]
        return " ".join(entities.unescape("".join(out)).split())


def votes(pages: DataFrame) -> DataFrame:
    """host, path and share: every page's votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths, shares = [], [], []
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for path, share in Page(page).best(VOTES) if page else ():
                    hosts.append(host)
                    paths.append(path)
                    shares.append(round(share * 1e6))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.int64())], names=["host", "path", "share"])

    return pages.select(host_of("url").alias("host"), "html").mapInArrow(run, "host string, path string, share long")


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def winners(votes_of: DataFrame, top: int = TOP_PATHS) -> DataFrame:
    """host and paths: each host's strongest paths, by whole millionths of votes so sums do not depend on their order."""
    sums = votes_of.groupBy("host", "path").agg(F.sum("share").alias("share"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("share"), "path"))).where(F.col("rank") <= top)
    return ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, top: int = TOP_PATHS) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    won = written(winners(votes(pages), top), "hosts")
    # A host may have a third of all pages: its paths go to every salt, its pages to one each.
    salted = won.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(SALTS)).cast("int")
    joined = pages.select("page_id", "url", "html", host_of("url").alias("host"), salt.alias("salt")).join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for page, paths in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                parsed = Page(page or "")
                have = {p for p, s in zip(parsed.paths, parsed.scores(), strict=True) if s > 0}
                path = next((p for p in paths or () if p in have), None) or next((p for p, _ in parsed.best(1)), None)
                texts.append(parsed.text(path))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
