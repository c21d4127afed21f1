"""Main text of HTML pages by tag-path ratios.

Each text node belongs to a root-to-leaf tag path. Per path the page's text length and punctuation are
summed and divided by the path's number of nodes; both ratios are smoothed along the page (which raises a node to
at most ``RAISED`` times its own, so what borders on the article isn't taken for it), fused by multiplication, and held against half the standard deviation. What tags,
roles and names say is fused in as one more factor: 0 for parts that serve the page and, where article elements
hold content, for what lies outside them; ``NAMED`` for parts with a service name. Nodes at or above the threshold
are content. The smallest container that leaves no content, headline or loose paragraph beside it is the article; its
blocks in page order are the text, without nodes of score 0 and without named parts that hold no content. So short
paragraphs, headings and lists of the article stay although their own ratio is low.

Defined results: null, empty and text-free html give the empty string; markup errors are repaired as
browsers usually do (unclosed paragraphs, stray end tags, open comments); pages are read one by one, so
ties, repeated rows and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?][^>]*+>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
_FOREIGN = frozenset(("svg", "math"))  # the only ones that a slash closes
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = frozenset("html body div main article section table tbody tr td center details".split())
_ENDS_P = _BLOCK - {"option", "select", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Start tag to the open elements that it closes, and the elements that shield them.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_NOTHING: tuple[set[str], set[str]] = (set(), set())
#: Elements that serve the page rather than the article.
_SERVICE = frozenset("nav aside footer form button select dialog menu search input label object audio video canvas".split())
_SERVICE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = (
    r"(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"sidebar|side-bar|aside|rail|widget\w*|menu|nav|navbar|navigation|breadcrumbs?|toc|pagination|pager|footer|site-?header|page-?header|masthead|topbar|toolbar|skip-?link|share|sharing|social|"
    r"related|recommend\w*|more-?(?:stories|posts|links)|trending|popular|comments?|commentlist|comment-\w+|disqus|replies|respond|feedback|tags|byline-?box|copyright|legal|disclaimer)"
)
_NAMES_WITHIN = re.compile(rf"(?i)(?:^|[\s_-]){_NAMES}(?:$|[\s_-])")
_NAMES_WHOLE = re.compile(rf"(?i)(?:^|\s){_NAMES}(?:$|\s)")
#: Elements whose name may mark them as service; headings and text blocks never are. Table parts count outside the article only.
_NAMEABLE = frozenset("center details div dl fieldset figure header menu ol section table ul".split())
_NAMEABLE_OUTSIDE = _NAMEABLE | {"tbody", "td", "tr"}
#: Elements whose descendants know that they are inside.
_MARKED = frozenset(("a", "article", "h1", "main"))
#: Text beside a container that belongs to the article with it.
_LOOSE = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre".split())
#: Smoothing raises a node's ratio to so many times its own at most; factor for parts with a service name.
RAISED, NAMED = 1.0, 0.05
_PUNCT = re.compile(r"[.,;:!?…。，、！？；：]")
_DIGITS = re.compile(r"[0-9]+")


def _named(tag: str, classes: str, ids: str, inside: bool) -> bool:
    """Whether the names are those of a service part.

    Ids count as whole words only, and those of sections not at all: they are often slugs of headings
    ("related-work"). Inside the article element the same holds for classes.
    """
    if tag not in (_NAMEABLE if inside else _NAMEABLE_OUTSIDE):
        return False
    return bool((_NAMES_WHOLE if inside else _NAMES_WITHIN).search(classes) or (tag != "section" and _NAMES_WHOLE.search(ids)))


class _Element:
    __slots__ = ("depth", "holds", "inside", "named", "parent", "path", "service", "tag")

    def __init__(self, tag: str, parent: _Element | None, attrs: str = ""):
        self.tag, self.parent = tag, parent
        names = classes = ids = role = ""
        hidden = False
        if attrs:
            for name, a, b, c in _ATTR.findall(attrs):
                name = name.lower()
                if name in ("class", "id"):
                    names += " " + (a or b or c)
                    if name == "class":
                        classes += " " + (a or b or c)
                    else:
                        ids += " " + (a or b or c)
                elif name == "role":
                    role = (a or b or c).lower()
                hidden |= name == "aria-hidden" and (a or b or c) == "true"
        self.depth = parent.depth + 1 if parent else 0
        self.path = hash((parent.path if parent else 0, tag, _DIGITS.sub("", names.split()[0]) if names.split() else ""))
        above = parent.inside if parent else frozenset()
        self.service = tag in _SERVICE or (tag == "header" and not above & {"article", "main"}) or role in _SERVICE_ROLES or hidden
        self.named = bool(names) and _named(tag, classes, ids, bool(above & {"article", "main"}))
        self.inside = above | {tag} if tag in _MARKED and tag not in above else above  # itself included
        self.holds = False  # an article or main element
        if tag in ("article", "main"):
            while parent and not parent.holds:
                parent.holds = True
                parent = parent.parent


def _totals(own: dict[_Element, float]) -> dict[_Element, float]:
    """Each element's sum over itself and what it holds."""
    out: dict[_Element, float] = {}
    for e in own:
        x: _Element | None = e
        while x and x not in out:
            out[x] = own.get(x, 0.0)
            x = x.parent
    for e in sorted(out, key=lambda e: -e.depth):
        if e.parent:
            out[e.parent] += out[e]
    return out


def parse(html: str) -> list[tuple[_Element, int, str]]:
    """Text nodes in page order: element, number of the block, decoded text. A br is a line feed."""
    nodes: list[tuple[_Element, int, str]] = []
    here = _Element("#root", None)
    block = at = 0
    opened: dict[str, int] = {}

    def close(element: _Element) -> None:
        """Close ``element`` and all that is open in it."""
        nonlocal here
        while here is not element.parent:
            opened[here.tag] -= 1
            here = here.parent

    def text(raw: str) -> None:
        if raw:
            nodes.append((here, block, entities.unescape(raw)))

    size, last = len(html), html.rfind(">")
    while at < size:
        lt = html.find("<", at)
        if lt < 0 or (lt > last and not html.startswith("<!--", lt)):  # no tag begins there
            text(html[at:])
            break
        m = _TOKEN.match(html, lt)
        if not m:
            text(html[at : lt + 1])
            at = lt + 1
            continue
        text(html[at:lt])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            scope = here if opened.get(tag) else None
            while scope and scope.tag != tag:
                # an inline end tag stays in its block
                scope = None if tag not in _BLOCK and scope.tag in _BLOCK else scope.parent
            if scope:
                close(scope)
            if tag in _BLOCK:
                block += 1
            continue
        if tag in _RAW and not (tag in _FOREIGN and m[3].rstrip().endswith("/")):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            nodes.append((here, block, "\n"))
            continue
        if tag == "hr":
            block += 1
        if tag in _VOID:
            continue
        if tag in _ENDS_P and opened.get("p"):
            scope = here
            while scope.parent and scope.tag != "p" and scope.tag not in _CONTAINER:
                scope = scope.parent
            if scope.tag == "p":
                close(scope)
        closes, shield = _IMPLIED.get(tag, _NOTHING)
        while any(opened.get(x) for x in closes):
            scope = here
            while scope.parent and scope.tag not in closes and scope.tag not in shield:
                scope = scope.parent
            if scope.tag not in closes:
                break
            close(scope)
        if tag in _BLOCK:
            block += 1
        here = _Element(tag, here, m[3])
        opened[tag] = opened.get(tag, 0) + 1
    return nodes


def path_ratios(nodes: list[tuple[_Element, int, str]]) -> list[float]:
    """Fused, smoothed tag-path ratio of each node, as a multiple of the threshold."""
    length, points, count = {}, {}, {}
    for e, _, t in nodes:
        n = len(t) - t.count(" ") - t.count("\n")
        if n:
            length[e.path] = length.get(e.path, 0) + n
            points[e.path] = points.get(e.path, 0) + len(_PUNCT.findall(t))
            count[e.path] = count.get(e.path, 0) + 1
    if not count:
        return [0.0] * len(nodes)
    kernel = [0.25, 0.5, 0.25]

    def smooth(values: list[float]) -> list[float]:
        last = len(values) - 1
        return [sum(w * values[min(max(i + k - 1, 0), last)] for k, w in enumerate(kernel)) for i in range(len(values))]

    fuse = lambda by_text, by_points: [a * (b + 0.1) for a, b in zip(by_text, by_points, strict=True)]
    by_text = [length.get(e.path, 0) / count.get(e.path, 1) for e, _, _ in nodes]
    by_points = [points.get(e.path, 0) / count.get(e.path, 1) for e, _, _ in nodes]
    fused = [min(a, RAISED * own) for a, own in zip(fuse(smooth(by_text), smooth(by_points)), fuse(by_text, by_points), strict=True)]
    mean = sum(fused) / len(fused)
    spread = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    level = 0.5 * spread or min((x for x in fused if x), default=1.0)
    return [x / level for x in fused]


def _inherited(nodes: list[tuple[_Element, int, str]], holds) -> dict[_Element | None, bool]:
    """Whether ``holds`` is true of each element that has text or of one of its ancestors."""
    out: dict[_Element | None, bool] = {None: False}
    for e, _, _ in nodes:
        chain = []
        x: _Element | None = e
        while x not in out:
            chain.append(x)
            x = x.parent
        above = out[x]
        for x in reversed(chain):
            above = out[x] = above or holds(x)
    return out


def _sums(nodes: list[tuple[_Element, int, str]], value) -> dict[_Element, float]:
    """Each element's sum of ``value(k, element, text)`` over its nodes."""
    own: dict[_Element, float] = {}
    for k, (e, _, t) in enumerate(nodes):
        own[e] = own.get(e, 0.0) + value(k, e, t)
    return _totals(own)


def content_scores(nodes: list[tuple[_Element, int, str]]) -> list[float]:
    """Path ratio of each node, as a multiple of the threshold, with what tags, roles and names say fused in."""
    ratios = path_ratios(nodes)
    weight = _sums(nodes, lambda k, e, t: len(t) if ratios[k] >= 1 else 0)
    total = next((w for e, w in weight.items() if e.parent is None), 0.0)
    service = _inherited(nodes, lambda e: e.service)
    # a name alone doesn't count where its element holds the article element or most of the content (a layout may be named after its sidebar)
    named = _inherited(nodes, lambda e: e.named and not e.holds and weight.get(e, 0.0) < 0.6 * total)
    scores = [0.0 if service[e] else r * NAMED if named[e] else r for (e, _, _), r in zip(nodes, ratios, strict=True)]
    # the article or main element with most text of content, and its sibling articles that have some
    held = _sums(nodes, lambda k, e, t: len(t) if scores[k] >= 1 else 0.01 * len(t) * (scores[k] > 0))
    marked = {e: w for e, w in held.items() if e.tag in ("article", "main") and w}
    outer = {e: w for e, w in marked.items() if e.tag == "article" and "article" not in e.parent.inside} or marked
    if outer:
        best = max(outer, key=outer.get)  # the first of equals
        sure = _sums(nodes, lambda k, e, t: len(t) * ((scores[k] >= 1 or (scores[k] > 0 and "h1" in e.inside)) and "a" not in e.inside))
        chosen = {e for e in outer if e is best or (e.parent is best.parent and sure[e])}
        inside = _inherited(nodes, chosen.__contains__)
        scores = [s if inside[e] else 0.0 for (e, _, _), s in zip(nodes, scores, strict=True)]
    return scores


def _article(nodes: list[tuple[_Element, int, str]], scores: list[float]) -> _Element | None:
    """The smallest container that leaves nothing of the article beside it."""
    some = [(n, s) for n, s in zip(nodes, scores, strict=True) if s and n[2].strip()]
    if not some:
        return None
    nodes, scores = [n for n, _ in some], [s for _, s in some]
    weight = _sums(nodes, lambda k, e, t: len(t) * (1.0 if scores[k] >= 1 else 0.01))  # what is below the threshold only breaks ties
    # content nodes and headlines, links apart
    own: dict[_Element, float] = {}
    for (e, _, t), s in some:
        own[e] = own.get(e, 0.0) + (len(t) if (s >= 1 or "h1" in e.inside) and "a" not in e.inside else 0)
    held = _totals(own)
    children: dict[_Element, list[_Element]] = {}
    for e in weight:
        if e.parent:
            children.setdefault(e.parent, []).append(e)
    here = next(e for e in weight if e.parent is None)
    while here in children:
        child = max(children[here], key=weight.get)
        beside = own.get(here, 0) or any(x is not child and (held[x] or x.tag in _LOOSE) for x in children[here])
        if beside or child.tag not in _CONTAINER:
            break
        here = child
    return here


def main_text(html: str | None) -> str:
    """The article's blocks, each on a line."""
    if not html:
        return ""
    nodes = parse(html)
    scores = content_scores(nodes)
    root = _article(nodes, scores)
    if root is None:
        return ""
    within = _inherited(nodes, lambda e: e is root)
    content = _sums(nodes, lambda k, e, t: float(scores[k] >= 1))
    dropped = _inherited(nodes, lambda e: e.named and not e.holds and not content[e])
    blocks: dict[int, list[str]] = {}
    for (e, b, t), s in zip(nodes, scores, strict=True):
        if within[e] and not dropped[e] and (s or not t.strip()):
            blocks.setdefault(b, []).append(t)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    kept = [f for f in pages.schema if f.name not in (html_col, "text")]
    schema = type(pages.schema)([*kept]).add("text", "string")
    return pages.select(*[f"`{f.name}`" for f in kept], pages[html_col].cast("string").alias("text")).mapInArrow(run, schema)
