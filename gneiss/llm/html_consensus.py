"""Operator 10: main-text extraction by a consensus of each host's pages.

A page is read into a light tree of elements. Every element that may hold an article gets a
score: the text of its paragraph-like blocks, less what stands in links, damped for depth
above the text and for signs of boilerplate in its tag, class or id. The best element votes
for its generalised path (tags with classes, digits dropped) on its host; Spark sums the votes
per host, and each page is read again with its host's winning path, or with its own best
element where the path does not occur. Script, style, navigation, headers, footers, sidebars,
forms, notices, adverts and comments inside the chosen element are left out; of a header inside
an article its headings stay, and captions do.

Text: character references decoded, white space inside a block (line breaks included) as one
space, blocks trimmed, empty blocks dropped, joined by one newline. Null or empty html gives an
empty text. A page without any article-like element gives the text of its body without
boilerplate. Pages without a host vote together; ties between paths go to the shorter, then to
the last by name. A tag that never ends is text. Repeated rows give the same text, and columns that
clash with the new ones give way."""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import col, map_rows

#: Rows of host paths that are broadcast at most; beyond that they are joined by a shuffle.
MAX_BROADCAST_HOSTS = 50_000
#: Parts that each host's pages are dealt to in that shuffle.
SALTS = 32

# A quote opens a value only behind an equals sign; groups never give back what they took, so that
# broken tags cost linear time.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s"'<>/=][^\s<>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "select", "object")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_DROP_TAGS = frozenset("nav header footer aside form button dialog menu select input textarea head".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that no class or id takes for boilerplate.
_WHOLE = frozenset("article main body html".split()) | _HEADINGS
#: Words for boilerplate, whatever its share of the page.
_SURE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus gdpr"
    " menu menus nav navbar navigation navlinks newsletter pagination pager replies respond sponsor sponsored sponsors subscribe subscription".split()
)
#: Words for boilerplate unless the element has most of the page's text.
_LIKELY_WORDS = frozenset(
    "banner footer header masthead metainfo modal notice popup promo promos promotion promotions related share shares sharing sharebar sidebar social toolbar widget widgets".split()
)
#: Words that may stand beside those in a class or id; with any other (with-sidebar, related-work) the name says something else.
_BESIDE_WORDS = frozenset(
    "area bar block bottom box btn button buttons container desktop fixed floating form global group icons inner item items left links list main media meta mobile"
    " outer overlay page panel popular post posts primary right secondary signup site slot sticky top unit wrap wrapper info side articles stories".split()
)
_KEEP_WORDS = re.compile(r"(?:^|[^a-z])(?:article\w*|post|post-?(?:body|content)|entry\w*|content|main|story\w*|body-?text|article-?body|text)(?:$|[^a-z])")
_CONTAINERS = frozenset("article main section div body td center blockquote".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF_NEST = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_DIGITS = re.compile(r"\d+")


def boilerplate(names: str) -> int:
    """2 if a class, id or role is a name of boilerplate, 1 if it is likely one, else 0."""
    worst = 0
    for name in names.split():
        words = set(re.split(r"[^a-z]+", name)) - {""}
        if words & _SURE_WORDS and words <= _SURE_WORDS | _LIKELY_WORDS | _BESIDE_WORDS:
            return 2
        if (words & _LIKELY_WORDS or {"side", "bar"} <= words or {"meta", "info"} <= words) and words <= _LIKELY_WORDS | _BESIDE_WORDS:
            worst = 1
    return worst


class Node:
    """``drop``: left out; ``soft``: only as a header inside an article, whose headings stay."""

    __slots__ = ("tag", "name", "parent", "drop", "likely", "plus", "inside", "soft")

    def __init__(self, tag, name, parent, drop, likely, plus):
        self.tag, self.name, self.parent, self.likely, self.plus = tag, name, parent, likely, plus
        self.inside = tag == "article" or bool(parent and parent.inside)
        above = bool(parent and parent.drop)
        self.soft = (tag == "header" and self.inside and not above) or (above and parent.soft and not drop)
        self.drop = drop or above
        if self.soft and tag in _HEADINGS:
            self.drop = self.soft = False


class Page:
    """Elements of a page, and its blocks: (owner, text, characters in links)."""

    def __init__(self, source: str):
        self.nodes: list[Node] = []
        self.blocks: list[tuple[Node, str, int]] = []
        self._read(source)
        if any(n.likely for n in self.nodes):
            self._settle()

    def _settle(self) -> None:
        """Drops the likely boilerplate that has no more than half of the text."""
        sizes: dict[int, int] = {}
        total = 0
        for node, text, _ in self.blocks:
            if not node.drop:
                total += len(text)
                up = node
                while up is not None:
                    sizes[id(up)] = sizes.get(id(up), 0) + len(text)
                    up = up.parent
        for node in self.nodes:
            kept = node.tag in _HEADINGS and node.parent.soft
            node.drop = node.drop or (node.parent.drop and not kept) or (node.likely and 2 * sizes.get(id(node), 0) <= total)

    def _read(self, source: str) -> None:
        root = Node("", "", None, False, False, 0)
        at, node, parts, linked, in_link = 0, root, [], 0, 0
        skip, skip_depth = None, 0  # an inline element that is left out, and how deep it nests

        def flush():
            nonlocal parts, linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((node, text, linked))
                parts, linked = [], 0

        n = len(source)
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                piece = source[at:lt]
                piece = entities.unescape(piece) if "&" in piece else piece
                if skip is None:
                    parts.append(piece)
                    linked += len(piece) if in_link else 0
            if lt == n:
                break
            m = _TOKEN.match(source, lt)
            if m is None:
                parts.append("<")
                at = lt + 1
                continue
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["cdata"]:
                    parts.append(m["cdata"])
                continue
            tag = tag.lower()
            if m["close"]:
                if tag == "a":
                    in_link = max(0, in_link - 1)
                if tag == "br":
                    parts.append(" ")
                if tag in _INLINE:
                    if tag == skip:
                        skip_depth -= 1
                        skip = skip if skip_depth else None
                    continue
                skip = None
                up = node
                while up is not None and up.tag != tag:
                    up = up.parent
                if up is not None and up is not root:
                    flush()
                    node = up.parent
                continue
            if tag in _RAW_END:
                end = _RAW_END[tag].search(source, at)
                if not m["attrs"].rstrip().endswith("/"):
                    at = end.end() if end else n
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag == "a":
                in_link += 1
            attrs = m["attrs"]
            words, hidden, kind = "", False, 0
            if attrs and not attrs.isspace():
                for name, *values in _ATTR.findall(attrs.lower()):
                    value = values[0] or values[1] or values[2]
                    if name in ("class", "id", "role"):
                        words = f"{words} {value}" if words else value
                    elif name == "hidden":
                        hidden = hidden or value != "until-found"
                    elif name == "style":
                        hidden = hidden or bool(_NO_DISPLAY.search(value))
                    elif name == "aria-hidden":
                        hidden = hidden or value == "true"
                kind = boilerplate(words) if words and tag not in _WHOLE else 0
            # A body that is hidden at first is shown by a script.
            drop = (hidden and tag not in ("body", "html")) or tag in _DROP_TAGS or kind == 2 or (kind == 1 and tag in _INLINE)
            if tag in _INLINE:
                if skip is None and drop:
                    skip, skip_depth = tag, 1
                elif tag == skip:
                    skip_depth += 1
                continue
            if tag in _VOID:
                if tag == "hr":
                    flush()
                continue
            flush()
            skip = None
            if tag == "body":
                while node is not root and node.tag != "html":
                    node = node.parent
            if tag in _CLOSES_P:
                up = node
                while up is not None and up.tag not in ("p", *_CONTAINERS, "li", "table"):
                    up = up.parent
                if up is not None and up.tag == "p":
                    node = up.parent
            if (stops := _SELF_NEST.get(tag)) is not None:
                up = node
                while up is not None and up.tag != tag and up.tag not in stops:
                    up = up.parent
                if up is not None and up.tag == tag:
                    node = up.parent
            label = tag + "".join("." + _DIGITS.sub("", w) for w in sorted(words.split()))
            node = Node(tag, label, node, drop, kind == 1, 1 if words and _KEEP_WORDS.search(words) else 0)
            self.nodes.append(node)
            if attrs.rstrip().endswith("/") and tag not in _CONTAINERS:
                node = node.parent
        flush()

    @staticmethod
    def path(node: Node) -> str:
        names = []
        while node is not None and node.tag:
            names.append(node.name)
            node = node.parent
        return ">".join(reversed(names))

    def best(self) -> Node | None:
        """The element most likely to hold the article; ties go to the first."""
        scores: dict[int, float] = {}
        own: dict[int, Node] = {}
        for node, text, linked in self.blocks:
            if node.drop:
                continue
            worth = max(0, len(text) - 2 * linked) + 10
            up, share = node, 1.0
            while up is not None and up.tag:
                if up.tag in _CONTAINERS:
                    own[id(up)] = up
                    scores[id(up)] = scores.get(id(up), 0.0) + worth * share
                    share *= 0.85
                up = up.parent
        best, top = None, 0.0
        for node in self.nodes:
            s = scores.get(id(node), 0.0)
            s *= 2.0 if node.tag in ("article", "main") else 1.3 if node.plus else 0.6 if node.tag == "body" else 1.0
            if s > top:
                best, top = node, s
        return best

    def text(self, roots: list[Node]) -> str:
        """The blocks below the roots, in page order; with no roots, all of the page."""
        ids = {id(r) for r in roots}
        out = []
        for node, text, _ in self.blocks:
            if node.drop:
                continue
            up, inside = node, not ids
            while not inside and up is not None and up.tag:
                inside = id(up) in ids
                up = up.parent
            if inside:
                out.append(text)
        return "\n".join(out)


def vote(source: str | None) -> tuple[str | None, float]:
    """The generalised path of the page's best element, and the weight of its vote."""
    if not source:
        return None, 0.0
    page = Page(source)
    node = page.best()
    return (None, 0.0) if node is None else (page.path(node), 1.0)


def extract(source: str | None, path: str | None) -> str:
    """The main text by the host's path, else by the page's own best element."""
    if not source:
        return ""
    page = Page(source)
    roots = [n for n in page.nodes if path and not n.drop and page.path(n) == path]
    if not roots and (best := page.best()) is not None:
        roots = [best]
    return page.text(roots)


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The winning path of each host: most votes, ties to the first by name."""
    host = F.coalesce(F.lower(F.regexp_extract(col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    src = pages.select(host.alias("host"), col(html_col).alias("html"))
    voted = map_rows(
        src, ["html"], ["host"],
        [T.StructField("path", T.StringType()), T.StructField("w", T.DoubleType())],
        lambda: lambda rows: list(zip(*map(vote, rows), strict=True)) if rows else ([], []),
    )
    counted = voted.filter("path is not null").groupBy("host", "path").agg(F.sum("w").alias("votes"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct(F.col("votes"), (-F.length("path")).alias("n"), F.col("path"))).alias("path"))


def extract_main_text(
    pages: DataFrame,
    keep: tuple[str, ...] = ("page_id", "url"),
    url_col: str = "url",
    html_col: str = "html",
    max_broadcast: int = MAX_BROADCAST_HOSTS,
) -> DataFrame:
    """Columns ``keep`` with text and n_chars."""
    paths = host_paths(pages, url_col, html_col)
    host = F.coalesce(F.lower(F.regexp_extract(col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(*[col(c) for c in keep], col(html_col).alias("_html"), host.alias("_host"))
    found = paths.limit(max_broadcast + 1).collect()
    if len(found) <= max_broadcast:
        rules = pages.sparkSession.sparkContext.broadcast({r["host"]: r["path"] for r in found})

        def factory():
            known = rules.value

            def fn(hosts, sources):
                text = [extract(s, known.get(h)) for h, s in zip(hosts, sources, strict=True)]
                return text, [len(t) for t in text]

            return fn

        inputs = ["_host", "_html"]
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        spread = paths.select(F.col("host").alias("_host"), F.col("path").alias("_path"), salts.alias("_salt"))
        salt = F.pmod(F.xxhash64(*[col(c) for c in keep], F.length("_html")), F.lit(SALTS)).cast("int")
        rows = rows.withColumn("_salt", salt).join(spread, ["_host", "_salt"], "left")

        def factory():
            def fn(known, sources):
                text = [extract(s, p) for p, s in zip(known, sources, strict=True)]
                return text, [len(t) for t in text]

            return fn

        inputs = ["_path", "_html"]
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return map_rows(rows, inputs, keep, fields, factory)
