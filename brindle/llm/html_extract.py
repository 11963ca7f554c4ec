"""Main-text extraction from HTML by minimum cut.

A page becomes a row of text blocks with their chains of open elements. A linear
model over length, link density, punctuation, element names and the class, id and
role words of the elements around a block gives the natural log odds of the block
being content (``WEIGHTS``). The odds are the terminal capacities. Smoothness
edges join neighbours in page order, with a weight that falls with their distance
in the tree and at the borders of marked elements, and blocks of one parent. The
minimum cut, found by maximum flow, separates content from boilerplate: a short
or linked line inside an article stays with its neighbours, a lone sentence among
menus goes with them. Capacities that outweigh all smoothness edges of a block
settle it beforehand, which makes the flow's graph smaller and the cut no other.

Only elements that never hold article text (scripts, styles, nav, footer, aside,
dialogs, elements with the attribute hidden) are certain. Class words are odds:
the nearest marked element counts most, and a marked element (or form) that wraps
an article or main element and most of the page is a layout and says nothing. Nor does
one that holds nearly all unlinked prose of a page without an article elsewhere. Words
that texts are also about (comment, social, widget) count only where they name the part.
If nothing is left although a page has prose outside structural elements, names are
left aside. Short notices on cookies and newsletters, and what follows a heading of
readers' comments, are known by their words.

Character references are decoded; white space inside a block becomes one space;
blocks are joined by one newline. An unfinished last tag, comment or raw element
ends at the page's end.

Null and empty pages give an empty text; ids may be null or repeated, each row is
extracted by itself; long pages are extracted whole; other columns are ignored; an
empty table gives no rows. Of several minimum cuts the one with the most content
is taken.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_slices

#: Elements that start and end a block, fixed values of the HTML standard's rendering.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no block text at all.
DROPPED = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select option button head xmp noembed noframes map datalist".split())
#: Elements whose text is certainly no article text.
OUTSIDE = frozenset("nav footer aside menu dialog search".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|object|canvas|audio|video|select|xmp|noembed|noframes"

#: Words of class, id, role and itemprop that mark boilerplate wherever they stand; fixed values.
AGAINST = frozenset("ad ads advert adverts advertisement advertisements menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars masthead topbar toolbar comments commentlist disqus respondlist gdpr popup modal pagination pager taboola outbrain contentinfo complementary".split())
#: Words that do so as the last word of a name but for words that say what kind of part it is (PARTS), since they are also what texts are about; fixed values.
AGAINST_PART = frozenset("advertising sponsor sponsored sponsors promo promos banner banners widget widgets footer related recommended recommendations social sharing comment reply replies respond cookie cookies consent newsletter subscribe login signup paywall".split())
PARTS = frozenset("list lists area box boxes link links icon icons button buttons bar section form wrapper wrap container inner outer block blocks item items thread row panel region zone slot unit notice message dialog overlay media nav post posts articles stories reading content top bottom left right header title body text count meta author".split())
#: Names that begin so are a page builder's layout; of their words only those of AGAINST count; fixed values.
BUILDERS = frozenset("elementor wpb vc et fl fusion siteorigin brxe kt avia tatsu oxy".split())
#: Words that do so only as the last word of a name, and not beside a word of FOR; fixed values.
AGAINST_LAST = frozenset("header head legal notice notices alert search tags toc skip copyright disclaimer share follow discussion promotion subscription signin paging side rail overlay dialog tagcloud".split())
#: Words that speak for content; fixed values.
FOR = frozenset("article articles post entry story content main body maincontent articlebody text prose".split())
#: A word of AGAINST after one of these says that the page has such a part, not that this is it; fixed values.
BEFORE = frozenset("has with no without show".split())
#: Class names that hide an element from sight; fixed values.
UNSEEN = frozenset("hidden is-hidden visually-hidden visuallyhidden sr-only screen-reader-text".split())

#: Natural log odds of the linear model. The signs and sizes follow what is known of web pages: a block without any mark is
#: rather content (bias); odds double with each doubling of the length about 60 characters, within limits and but for
#: headings; a block that is all link text is content once in fifty times (-4); an author's own class names are wrong
#: about once in a hundred times (-4.5), an article or main element about once in twenty (3).
WEIGHTS = {"bias": 0.8, "doubling": 0.7, "shortest": -0.8, "longest": 2.1, "links": -4.0, "sentence": 0.6, "prose": 0.9, "item": -0.5, "landmark": 3.0, "for": 2.5, "against": -4.5, "against_last": -3.5, "header": -4.0, "form": -4.5, "unseen": -6.0, "rights": -5.0, "notice": -5.0, "talk": -4.5}
SURE = 1000.0
#: Smoothness: neighbours in one element, share kept by each step of tree distance, by each border of a marked element; next block of the parent.
NEAR, STEP, BORDER, SIBLING, FARTHEST = 2.6, 0.75, 0.2, 0.5, 12
WRAPS = 0.5
#: An element with this share of the page's prose is the page, whatever its name says, unless an article stands outside it.
WHOLE = 0.8
#: Unlinked prose: so many characters, linked for less than half.
PROSE_CHARS = 60

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?P<rest>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)", re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
#: What ends an open element of the same kind without its end tag.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_STOP = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_HOLDS_P = frozenset("td th article section div li blockquote main aside nav header footer form".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Short blocks that are notices by what they say, and headings that readers' comments follow, in the languages of the tables; fixed values.
_NOTICES = [
    (("cookie",), re.compile(r"\b(?:we use|uses?|accept|agree|consent|browsing|utilis|accepte|verwende|akzeptier|zustimm|usamos|utiliza|acepta)")),
    (("newsletter", "inbox", "boletín"), re.compile(r"\b(?:subscribe|sign up|e-?mail|join|abonne|inscri|anmeld|abonnier|suscr)")),
]
_NOTICE_CHARS = 400
_TALK = re.compile(r"(?:\d+\s+)?(?:readers?['’]?s?['’]?\s+)?(?:comments?|responses|replies|commentaires?|kommentare?|comentarios?)(?:\s*\(?\d+\)?)?\s*:?|(?:leave|post|write) a (?:comment|reply)\W*|join the (?:discussion|conversation)\W*|laisser un commentaire\W*|deja un comentario\W*", re.IGNORECASE)
_PROSE = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 figcaption".split())


def name_odds(names: str) -> float:
    """What the words of a class, id, role or itemprop say: below zero against content."""
    worst, best = 0.0, 0.0
    for name in names.split():
        if name.lower() in UNSEEN:
            return WEIGHTS["unseen"]
        words = [w.lower() for w in _PART.findall(name)]
        good = not FOR.isdisjoint(words)
        last = len(words) - 1
        while last > 0 and words[last] in PARTS:
            last -= 1
        if any(w in AGAINST and not (i and words[i - 1] in BEFORE) for i, w in enumerate(words)):
            worst = min(worst, WEIGHTS["against"])
        elif words and words[last] in AGAINST_PART and words[0] not in BUILDERS and not (last and words[last - 1] in BEFORE):
            worst = min(worst, WEIGHTS["against"])
        elif words and words[-1] in AGAINST_LAST and not good:
            worst = min(worst, WEIGHTS["against_last"])
        elif good:
            best = WEIGHTS["for"]
    return worst or best


class Element:
    """An open element. ``odds`` is what it and its ancestors say of a block inside, ``zone`` its nearest marked element."""

    __slots__ = ("name", "up", "depth", "number", "own", "landmark", "outside", "odds", "zone", "chars", "holds", "prose")

    def __init__(self, name: str, up: Element | None, attributes: str, number: int):
        self.name, self.up, self.number = name, up, number
        self.depth = up.depth + 1 if up else 0
        self.outside = name in OUTSIDE or bool(up and up.outside)
        self.own, self.odds, self.zone, self.chars, self.holds, self.prose = 0.0, 0.0, 0, 0, False, 0
        role = ""
        if attributes and not attributes.isspace() and name not in ("html", "body"):
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), a or b or c
                if key in ("class", "id", "role", "itemprop"):
                    said = name_odds(value)
                    self.own = min(self.own, said) if said < 0 or self.own < 0 else max(self.own, said)
                    role = value.lower() if key == "role" else role
                elif key == "hidden" and name in BLOCKS:
                    self.outside = True
                elif (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _NO_DISPLAY.search(value)):
                    self.own = WEIGHTS["unseen"]
        self.landmark = (name in ("article", "main") or role in ("main", "article")) and (self.own >= 0 or name == "main")
        if name in ("form", "fieldset"):
            self.own = min(self.own, WEIGHTS["form"])


class Block:
    __slots__ = ("text", "element", "linked", "order", "talk", "notice")

    def __init__(self, text: str, element: Element, linked: int, order: int):
        self.text, self.element, self.linked, self.order, self.talk, self.notice = text, element, linked, order, False, _is_notice(text)


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; text of dropped elements is left out."""
    root = Element("", None, "", 0)
    now, elements = root, [root]
    out: list[Block] = []
    parts: list[str] = []
    linked, in_link, dropped = 0, 0, 0
    opened: dict[str, int] = {}  # open elements by name: an end tag without one is passed over at once

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append(Block(text, now, min(linked, len(text)), len(out)))
        linked = 0

    def close_to(element: Element) -> None:
        nonlocal now, dropped
        while now is not element and now.up is not None:
            dropped -= now.name in DROPPED
            opened[now.name] -= 1
            now = now.up

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not dropped:
            text = page[at : m.start()]
            parts.append(text)
            if in_link:
                linked += len(text.strip())
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            if m["raw"] and m["raw"].lower() in ("noscript", "iframe", "object", "svg", "canvas", "video", "audio", "select"):
                parts.append(" ")
            continue
        name = name.lower()
        closing = m["close"] or m["close2"]
        if name == "br":
            parts.append("\n")
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        block = name in BLOCKS
        if not block and name not in DROPPED:
            continue
        if block:
            flush()
        if closing:
            if opened.get(name):
                e = now
                while e.name != name:
                    e = e.up
                close_to(e.up)
            in_link = 0 if block else in_link
            continue
        if name in VOID:
            continue
        for open_name in _CLOSES.get(name, ("p",) if block and name not in ("html", "body") else ()):
            if not opened.get(open_name):
                continue
            e, stop = now, _STOP.get(name, ())
            while e.up is not None and e.name != open_name and e.name not in stop and not (open_name == "p" and e.name in _HOLDS_P):
                e = e.up
            if e.name == open_name:
                close_to(e.up)
        now = Element(name, now, m["attributes"] or m["attributes2"] or "", len(elements))
        elements.append(now)
        opened[name] = opened.get(name, 0) + 1
        dropped += name in DROPPED
    if at < len(page) and not dropped:
        tail = page[at:]
        cut = tail.find("<")
        if cut >= 0 and re.match(r"<[a-zA-Z/!?]", tail[cut:]):
            tail = tail[:cut]
        parts.append(tail)
    flush()
    _mark(elements, out)
    _talk(out)
    return out


def is_prose(b: Block) -> bool:
    """Unlinked text outside structural elements that is long enough for prose and no notice."""
    return not b.element.outside and len(b.text) >= PROSE_CHARS and 2 * b.linked < len(b.text) and not b.notice


def _is_notice(text: str) -> bool:
    if len(text) > _NOTICE_CHARS:
        return False
    low = text.lower()
    return any(any(w in low for w in words) and verbs.search(low) for words, verbs in _NOTICES)


def _mark(elements: list[Element], blocks: list[Block], names: bool = True) -> None:
    """odds and zone of every element, from the page's whole tree; names=False takes no name against the text in it."""
    whole = prose = 0
    for e in elements:
        e.chars = e.prose = 0
        e.holds = False
    for b in blocks:
        if not b.element.outside:
            b.element.chars += len(b.text)
            whole += len(b.text)
            if is_prose(b):
                b.element.prose += len(b.text)
                prose += len(b.text)
    for e in reversed(elements):  # children come after their parents
        if e.up:
            e.up.chars += e.chars
            e.up.prose += e.prose
            e.up.holds |= e.holds or e.landmark
    apart = any(e.landmark and e.chars for e in elements)
    for e in elements:
        up = e.up
        e.odds, e.zone = (up.odds, up.zone) if up else (0.0, 0)
        own = e.own
        if own < 0 and e.chars > WRAPS * whole and (e.holds or e.name == "form" and own == WEIGHTS["form"]):
            own = 0.0  # a layout around the article
        if own < 0 and prose and e.prose > WHOLE * prose and (e.holds or not apart) and own != WEIGHTS["unseen"]:
            own = 0.0  # the page's text itself
        if own < 0 and not names and own != WEIGHTS["unseen"]:
            own = 0.0
        if e.name == "header" and own >= 0 and e.odds < WEIGHTS["landmark"] and not e.holds:
            own = WEIGHTS["header"]
        if own < 0:
            e.odds, e.zone = min(e.odds, 0.0) / 2 + own, e.number
        elif own or e.landmark:
            good = max(own, WEIGHTS["landmark"] if e.landmark else 0.0)
            e.odds = max(e.odds, good) if e.odds >= 0 else e.odds + good / 4
            e.zone = e.number


def _talk(blocks: list[Block]) -> None:
    """Marks what stands under a heading of readers' comments: the rest of the element that holds the heading, if prose came before."""
    under: Element | None = None
    seen = False
    for b in blocks:
        e = b.element
        while under is not None and e is not None and e is not under:
            e = e.up
        b.talk = under is not None and e is under
        if not b.talk:
            under = None
            if seen and b.element.name in _HEADINGS and len(b.text) <= 60 and _TALK.fullmatch(b.text):
                b.talk, under = True, b.element.up
                while under.name in ("header", "hgroup") and under.up is not None:
                    under = under.up
        seen = seen or is_prose(b)


def log_odds(block: Block) -> float:
    """The model's log odds: above zero speaks for content."""
    e, w = block.element, WEIGHTS
    if e.outside:
        return -SURE
    n = len(block.text)
    score = w["bias"] + min(max(w["doubling"] * math.log2(n / 60), 0.0 if e.name in _HEADINGS else w["shortest"]), w["longest"])
    score += w["links"] * block.linked / n + e.odds
    if e.name in _PROSE:
        score += w["prose"]
    elif e.name in ("li", "td", "th", "dt", "dd"):
        score += w["item"]
    if block.text[-1] in ".!?…。":
        score += w["sentence"]
    if block.text[0] in "©" or block.text[:20].lower().startswith(("copyright", "all rights reserved")):
        score += w["rights"]
    if block.notice:
        score += w["notice"]
    if block.talk:
        score += w["talk"]
    return score


def cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True for nodes on the content side of a minimum cut (of several, the one with the most content)."""
    n = len(odds)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        around[a][b] = around[a].get(b, 0.0) + w
        around[b][a] = around[b].get(a, 0.0) + w
    own = list(odds)
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # a terminal that outweighs all edges settles its node
        i = queue.popleft()
        if side[i] is None and abs(own[i]) > sum(around[i].values()):
            side[i] = own[i] > 0
            for j, w in around[i].items():
                own[j] += w if side[i] else -w
                del around[j][i]
                queue.append(j)
            around[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, content in zip(rest, _max_flow(rest, own, around), strict=True):
            side[i] = content
    return [bool(s) for s in side]


def _max_flow(nodes: list[int], odds: list[float], around: list[dict[int, float]]) -> list[bool]:
    """Blocking flows on level graphs between the two terminals; True for nodes that cannot reach the sink any more."""
    n, tiny = len(nodes), 1e-9
    place = {v: k for k, v in enumerate(nodes)}
    give = [max(odds[v], 0.0) for v in nodes]  # left from the source
    take = [max(-odds[v], 0.0) for v in nodes]  # left to the sink
    arcs: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    left: list[float] = []  # arc a and its opposite a ^ 1
    for k, v in enumerate(nodes):
        for u, w in around[v].items():
            if u > v:
                arcs[k].append(len(to))
                arcs[place[u]].append(len(to) + 1)
                to += [place[u], k]
                left += [w, w]
    while True:
        level = [-1] * n  # steps to the sink
        queue = [k for k in range(n) if take[k] > tiny]
        for k in queue:
            level[k] = 0
        for k in queue:
            for a in arcs[k]:
                if level[to[a]] < 0 and left[a ^ 1] > tiny:
                    level[to[a]] = level[k] + 1
                    queue.append(to[a])
        starts = [k for k in range(n) if give[k] > tiny and level[k] >= 0]
        if not starts:
            return [x < 0 for x in level]
        turn = [0] * n
        for s in starts:
            path, k = [], s
            while give[s] > tiny:
                if level[k] == 0 and take[k] > tiny:
                    flow = min(give[s], take[k], *(left[a] for a in path))
                    give[s] -= flow
                    take[k] -= flow
                    back = 0
                    for i, a in enumerate(path):
                        left[a] -= flow
                        left[a ^ 1] += flow
                        if left[a] <= tiny and not back:
                            back = i + 1
                    if back:  # go on from the first full arc's tail
                        k = to[path[back - 1] ^ 1]
                        del path[back - 1 :]
                    continue
                while turn[k] < len(arcs[k]):
                    a = arcs[k][turn[k]]
                    if left[a] > tiny and level[to[a]] == level[k] - 1:
                        break
                    turn[k] += 1
                if turn[k] < len(arcs[k]):
                    path.append(arcs[k][turn[k]])
                    k = to[path[-1]]
                elif path:
                    k = to[path.pop() ^ 1]
                    turn[k] += 1
                else:
                    break


def _closeness(a: Element, b: Element) -> float:
    """Falls with the steps between two elements in the tree, and where they lie in different marked elements."""
    share = BORDER if a.zone != b.zone else 1.0
    steps = 0
    while a is not b:
        if steps == FARTHEST:
            return 0.0
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return share * STEP**steps


def smoothness(blocks: list[Block]) -> dict[tuple[int, int], float]:
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges[i - 1, i] = NEAR * _closeness(blocks[i - 1].element, b.element)
        parent = b.element.up or b.element
        j = last.get(parent.number)
        if j is not None and j != i - 1 and blocks[j].element.zone == b.element.zone:
            edges[j, i] = SIBLING
        last[parent.number] = i
    return edges


def _elements(blocks: list[Block]) -> list[Element]:
    """The elements around the blocks, parents first."""
    found = {}
    for b in blocks:
        e = b.element
        while e is not None and e.number not in found:
            found[e.number] = e
            e = e.up
    return [found[n] for n in sorted(found)]


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    kept = cut([log_odds(b) for b in blocks], smoothness(blocks))
    if not any(kept) and any(is_prose(b) and not b.talk for b in blocks):  # some name was taken for more than it says
        _mark(_elements(blocks), blocks, names=False)
        kept = cut([log_odds(b) for b in blocks], smoothness(blocks))
        if not any(kept):
            kept = [is_prose(b) and not b.talk for b in blocks]
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_slices(batches, "html"):
            texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = pages.schema[page_id].dataType.simpleString(), pages.schema[url].dataType.simpleString()
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
