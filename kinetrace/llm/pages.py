"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text with the elements they stand in. A logistic
classifier gives each block the log odds of being content; these are the
capacities of the edges to the two terminals. Blocks that follow each other, and
blocks that are the next child of one parent, are tied by edges whose capacity
falls with their distance in the tree. The minimum cut (by max-flow) is the
labelling of least cost; the blocks on the content side, in page order, are the text.

The classifier is fitted on blocks whose label is known: those of pages with an
article or main element (about FIT_PAGES pages of the table, drawn by hash, and at
most FIT_BLOCKS blocks of each) and those of generated pages (made_page()). It sees
length, closing marks, links, kind of block, neighbours and place; the elements and
names that give the labels are hidden from it. What a page says of itself is added
as fixed log odds (MARKS): in the article, outside of the page's article, in a
header, in a part with a wanted or unwanted name.

Certain boilerplate is not scored: scripts, styles, navigation, footers, asides,
controls and hidden elements. A form or a part with an unwanted name counts only if
it is no wrapper of the page: one that holds the main element, or the first heading
or an article with half of the page's words, does not. Names are whole words of a
class; an id counts only if all its words are such names; both are looked up only
in these two attributes.

Before the flow, blocks whose terminal outweighs all their edges are labelled and
folded into their neighbours, which is exact and leaves little to the flow. Reading
a page takes time in proportion to its length, however deep or badly nested it is.

White space in a block becomes one space, character references are decoded, a
line break counts as a space, and blocks are joined by an empty line.

Edge cases: null or empty html and pages without content give an empty text.
Unclosed and misnested elements are closed by what follows them; an unclosed
navigation, aside or footer ends at the next part, heading or paragraph; a page that is
cut off ends there. A "<" that starts no tag is text. Each row is read by itself, so
repeats get equal texts. A table without article or main elements is read with what
the generated pages teach.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.llm.store import bounded_batches, fields

FIT_PAGES, FIT_BLOCKS = 1000, 64
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+{_VALUE}?+|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(rf"""([^\s>/=][^\s>/=]*+)(?:\s*+=\s*+({_VALUE}))?+""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Elements by how they are laid out, and names that authors give to parts of a page.
RAW = frozenset("script style textarea title noscript template iframe svg math object xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CERTAIN = frozenset("head nav footer aside menu button select option datalist dialog search audio video canvas".split()) | RAW
ENDING = frozenset("nav footer aside menu dialog search audio video canvas".split())
PARTS = frozenset("article main section div header footer form table h1 h2 h3 h4 h5 h6 p".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
LISTED = frozenset("li td th dt dd".split())
UNWANTED = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr
    popup modal overlay newsletter subscribe subscription signup social related recommended recommendations comment comments commentlist replies respond disqus sidebar widget widgets
    menu nav navbar navigation navi breadcrumb breadcrumbs footer masthead toolbar pagination pager paging contentinfo complementary outbrain taboola paywall""".split()
)
#: Names that may mean something else too: they count only on a part whose class has no other words.
DOUBTFUL = frozenset("login sharing notice notices alert alerts warning share recommend more trending popular reply discussion foot search legal copyright dialog disclaimer feedback rating ratings skip toc".split())
FILLERS = frozenset("list box wrap wrapper container area section block panel bar inner outer item items text content body form button row top bottom left right site page global main primary secondary post entry js".split())
WANTED = frozenset("content article post entry main story body text prose".split())
TEASERS = frozenset("comment comments reply ad advert advertisement sponsored promo related teaser recommended".split())
REPLIES = frozenset("comment comments commentlist replies reply respond disqus discussion".split())
#: Log odds that a page's own marks add to the classifier's. An unwanted name decides alone only over a short part or over
#: replies; a long part, a paragraph, and a name among other words weigh less than prose in an article can earn.
MARKS = {"article": 4.0, "outside": -4.0, "heading": 1.0, "wanted": 1.5, "unwanted": -12.0, "long": -6.5, "doubtful": -5.0, "partly": -3.0, "header": -7.0}
#: Words from which a part is long.
LONG_PART = 60
NEAR, DECAY = 1.2, 0.6


class _Element:
    __slots__ = ("article", "bad", "depth", "header", "main", "no", "parent", "part", "suspect", "tag", "wanted")

    def __init__(self, tag: str, parent: _Element | None, attributes: str, no: int):
        self.tag, self.parent, self.no = tag, parent, no
        self.depth = parent.depth + 1 if parent else 0
        self.bad = tag in CERTAIN or bool(parent and parent.bad)
        self.article = tag == "article" or bool(parent and parent.article)
        self.main = tag == "main" or bool(parent and parent.main)
        self.header = tag == "header" or bool(parent and parent.header)
        self.wanted = bool(parent and parent.wanted)
        self.part: _Suspect | None = parent.part if parent else None
        weight, replies = MARKS["unwanted"] if tag == "form" else 0.0, False
        if attributes and tag not in ("html", "body"):
            named, replies = self._read(attributes)
            weight = min(weight, named)
        self.suspect = weight < 0
        if self.suspect:
            self.part = _Suspect(self.part, weight, replies)

    def _read(self, attributes: str) -> tuple[float, bool]:
        """Take up what the attributes say; the weight of an unwanted name, or 0, and whether readers write here."""
        seen: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(attributes):
            value = m[2] or ""
            seen.setdefault(m[1].lower(), value[1:-1] if value[:1] in ("'", '"') else value)
        style, role = seen.get("style"), seen.get("role", "").strip().lower()
        if "hidden" in seen or seen.get("aria-hidden", "").strip().lower() == "true" or style and _HIDDEN.search(style):
            self.bad = True
        weight = 0.0
        held = self.tag in ("article", "main")
        for token in seen.get("class", "").split():
            names = [x.lower() for x in _NAME.findall(token)]
            if not names or names[0] in ("has", "with", "no", "without", "is", "not"):
                continue
            known = [x for x in names if x in UNWANTED]
            others = [x for x in names if x not in UNWANTED and x not in DOUBTFUL and x not in FILLERS]
            if held:
                weight = min(weight, MARKS["unwanted"] if not others and any(x in TEASERS for x in names) else 0.0)
            elif known and (others or self.tag == "p" or self.tag in HEADINGS):
                weight = min(weight, MARKS["partly" if others else "doubtful"])
            elif known:
                weight = min(weight, MARKS["unwanted"])
            elif not others and any(x in DOUBTFUL for x in names) and self.tag not in HEADINGS:
                weight = min(weight, MARKS["doubtful"])
            self.header |= "header" in names and not self.article
            self.wanted |= not WANTED.isdisjoint(names)
        names = [x.lower() for x in _NAME.findall(seen.get("id", ""))]
        if names:
            if not held and self.tag != "p" and self.tag not in HEADINGS and any(x in UNWANTED for x in names) and all(x in UNWANTED or x in DOUBTFUL or x in FILLERS for x in names):
                weight = MARKS["unwanted"]
            self.header |= names == ["header"] and not self.article
            self.wanted |= not WANTED.isdisjoint(names)
        self.header |= role == "banner"
        if role in ("navigation", "complementary", "contentinfo", "search", "dialog", "menu"):
            weight = MARKS["unwanted"]
        elif role == "alert":
            weight = min(weight, MARKS["doubtful"])
        return weight, not REPLIES.isdisjoint(x.lower() for x in _NAME.findall(f"{seen.get('class', '')} {seen.get('id', '')}"))


class _Suspect:
    """A form, or a part with an unwanted name, until it shows to be a wrapper of the page."""

    __slots__ = ("article", "heading", "main", "replies", "total", "up", "weight", "words")

    def __init__(self, up: _Suspect | None, weight: float, replies: bool):
        self.up, self.weight, self.words, self.total, self.replies = up, weight, 0, 0.0, replies
        self.main = self.heading = self.article = False


class Block:
    __slots__ = ("element", "in_links", "raw", "text")

    def __init__(self, text: str, raw: int, in_links: int, element: _Element):
        self.text, self.raw, self.in_links, self.element = text, raw, in_links, element


def _closed(tokens: list[tuple[int, bool, str]]) -> set[int]:
    """Which of the opening ENDING tags have a closing tag of their own."""
    out: set[int] = set()
    opened: dict[str, list[int]] = {}
    for i, close, tag in tokens:
        if close:
            if opened.get(tag):
                out.add(opened[tag].pop())
        else:
            opened.setdefault(tag, []).append(i)
    return out


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order; those in certain boilerplate too."""
    out: list[Block] = []
    top = here = _Element("#page", None, "", 0)
    texts: list[str] = []
    open_: dict[str, int] = {}
    suspects: list[_Suspect] = []
    links = linked = at = made = 0
    ends = [(m.start(), bool(m[1]), m[2].lower()) for m in re.finditer(r"<(/?)(nav|footer|aside|menu|dialog|search|audio|video|canvas)(?=[\s/>])", page, re.I)]
    closed = _closed(ends)
    loose: list[_Element] = []  # open elements that nothing closes

    def flush() -> None:
        nonlocal linked
        if texts:
            joined = "".join(texts)
            text = " ".join(html.unescape(joined).split())
            if text:
                out.append(Block(text, len(joined), linked, here))
            texts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        texts.append(piece)
        if links:
            linked += len(piece)

    def leave() -> None:
        nonlocal here
        open_[here.tag] -= 1
        here = here.parent

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        begun, at = m.start(), m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK or tag in CERTAIN:
                if open_.get(tag, 0):
                    flush()
                    while here.tag != tag:
                        leave()
                    leave()
                    links = 0
                elif tag == "p":
                    flush()
            continue
        if tag == "br":
            add(" ")
        elif tag == "a":
            links += 1
        elif tag in RAW:
            if not m[3].endswith("/") or tag in ("script", "style", "textarea", "title"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
        elif tag in VOID and tag != "hr":
            continue
        elif tag in BLOCK or tag in CERTAIN:
            flush()
            if tag == "hr":
                continue
            if loose and tag in PARTS:
                while here is not loose[0].parent:
                    leave()
                loose.clear()
            # an open paragraph ends at any block, a heading at the next, an item at the next item of its list
            if here.tag == "p" or here.tag in HEADINGS and tag in HEADINGS:
                leave()
            if tag in ITEMS and here.tag in ITEMS[tag]:
                leave()
            made += 1
            links = 0
            here = _Element(tag, here, m[3], made)
            open_[tag] = open_.get(tag, 0) + 1
            if tag in ENDING and begun not in closed:
                loose.append(here)
            if here.suspect:
                suspects.append(here.part)
            part = here.part
            if part is not None:
                part.main |= tag == "main"
                part.heading |= tag == "h1"
                part.article |= tag == "article" and not here.suspect
        if loose and here.depth < loose[0].depth:
            loose.clear()
    flush()
    _weigh(out, suspects)
    return out


def _weigh(blocks: list[Block], suspects: list[_Suspect]) -> None:
    """Sum up what each suspect part holds and give each the weight of all real ones around it."""
    total = 0
    for b in blocks:
        if not b.element.bad:
            words = b.text.count(" ") + 1
            total += words
            if b.element.part is not None:
                b.element.part.words += words
    for s in reversed(suspects):  # those inside come later
        if s.up is not None:
            s.up.words += s.words
            s.up.main |= s.main
            s.up.heading |= s.heading
            s.up.article |= s.article
    for s in suspects:
        wrapper = s.main or not s.replies and ((s.heading or s.article) and 2 * s.words > total or total > 20 and 10 * s.words > 9 * total)
        weight = max(s.weight, MARKS["long"]) if s.words >= LONG_PART and not s.replies else s.weight
        s.total = min(s.up.total if s.up else 0.0, 0.0 if wrapper else weight)


_CLOSING = frozenset(".!?…:;\"”»。！？")
FEATURES = 25


def features(blocks: list[Block]) -> np.ndarray:
    """A row per block of a page, without the marks that give labels."""
    n = len(blocks)
    words = np.array([b.text.count(" ") + 1 for b in blocks], float)
    links = np.array([b.in_links / max(1, b.raw) for b in blocks]).clip(0, 1)
    ends = np.array([b.text[-1] in _CLOSING for b in blocks], float)
    stops = np.array([sum(b.text.count(c) for c in ".,!?") for b in blocks]) / words
    tags = [b.element.tag for b in blocks]
    para = np.array([t == "p" for t in tags], float)
    head = np.array([t in HEADINGS for t in tags], float)
    item = np.array([t in LISTED for t in tags], float)
    digits = np.array([sum(c.isdigit() for c in b.text[:400]) / min(len(b.text), 400) for b in blocks])
    size = np.log1p(words) / 3
    plain = words * (1 - links)
    parent = np.array([(b.element.parent or b.element).no for b in blocks])
    _, group = np.unique(parent, return_inverse=True)
    held = np.bincount(group, plain)[group]
    whole = max(plain.sum(), 1.0)

    def shifted(a: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n)
        if by > 0:
            out[by:] = a[:-by]
        else:
            out[:by] = a[-by:]
        return out

    place = np.arange(n) / max(1, n - 1)
    rows = [
        size, size**2, ends, np.minimum(stops, 0.5) * 2, links, para, head, item, np.minimum(digits * 4, 1),
        np.minimum(size, 1) * ends, np.log1p(held) / 5, held / whole, shifted(size, 1), shifted(size, -1), shifted(links, 1), shifted(links, -1),
        shifted(ends, 1), shifted(ends, -1), shifted(para, 1), shifted(para, -1), place, place**2, shifted(np.minimum(size, 1) * ends, 2), shifted(np.minimum(size, 1) * ends, -2), np.ones(n),
    ]
    return np.stack(rows, axis=1)


def known_labels(blocks: list[Block]) -> np.ndarray | None:
    """1 for blocks of the article (or main, if there is no article), 0 for others; None if the page has neither."""
    inside = [b.element.article for b in blocks]
    if not any(inside):
        inside = [b.element.main for b in blocks]
    if not any(inside):
        return None
    return np.array([x and not b.element.bad and (b.element.part is None or b.element.part.total == 0) and not (b.element.header and b.element.tag not in HEADINGS) for x, b in zip(inside, blocks, strict=True)], float)


def learnt(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return w


def made_page(r: np.random.Generator, marked: bool) -> tuple[str, list[str]]:
    """A generated page and the texts of its content blocks; marked pages say by elements and names what is what."""

    def word() -> str:
        return "".join(r.choice(list("etaoinshrdlucmé"), r.integers(2, 9)))

    def phrase(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(r.integers(lo, hi))).capitalize()

    def prose(lo: int, hi: int) -> str:
        return " ".join(phrase(4, 16) + str(r.choice([".", ".", ".", "!", "?"])) for _ in range(r.integers(lo, hi)))

    def part(name: str, inner: str) -> str:
        if marked:
            tag = {"nav": "nav", "footer": "footer", "aside": "aside"}.get(name, "div")
            return f'<{tag} class="{name}">{inner}</{tag}>'
        return f'<div class="{word()}">{inner}</div>'

    def menu(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{phrase(1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    before, after, content = [part("nav", menu(r.integers(3, 12)))], [], []
    if r.random() < 0.3:
        before.append(part("breadcrumbs", " &gt; ".join(f'<a href="#">{phrase(1, 3)}</a>' for _ in range(3))))
    if r.random() < 0.4:
        before.append(part("ad", phrase(2, 9) + str(r.choice([".", "!", ""]))))
    if r.random() < 0.3:
        before.append(part("cookie", phrase(5, 14) + '. <button>OK</button> <a href="#">' + phrase(1, 3) + "</a>"))
    if r.random() < 0.5:
        after.append(part("related", f"<h3>{phrase(1, 4)}</h3>" + menu(r.integers(3, 7))))
    if r.random() < 0.3:
        after.append(part("aside", f"<h4>{phrase(1, 3)}</h4><p>{phrase(3, 12)}</p>" + menu(r.integers(2, 6))))
    if r.random() < 0.3:
        after.append(part("newsletter", f"<p>{phrase(3, 9)}</p><form><input><button>{word()}</button></form>"))
    after.append(part("footer", f"&copy; {r.integers(1990, 2030)} {phrase(1, 4)} &middot; " + str(r.choice([phrase(2, 8) + ".", "".join(f'<a href="#">{word()}</a> ' for _ in range(4))]))))

    def put(tag: str, text: str, shown: str | None = None) -> str:
        content.append(text)
        return f"<{tag}>{shown or text}</{tag}>"

    body = put("h1", phrase(3, 12)) if r.random() < 0.9 else ""
    for _ in range(r.integers(1, 12)):
        kind = r.random()
        if kind < 0.72:
            text = prose(1, 6)
            first, _, rest = text.partition(" ")
            body += put("p", text, f'<a href="#">{first}</a> {rest}' if rest and r.random() < 0.15 else None)
        elif kind < 0.8:
            body += put("h2", phrase(2, 7)) + put("p", prose(1, 5))
        elif kind < 0.88:
            body += "<ul>" + "".join(put("li", prose(1, 2)) for _ in range(r.integers(2, 5))) + "</ul>"
        elif kind < 0.94:
            body += "<blockquote>" + put("p", prose(1, 3)) + "</blockquote>"
        else:
            body += put("div", prose(1, 4))
    body = f"<article>{body}</article>" if marked else f'<div class="{word()}">{body}</div>'
    return f"<html><head><title>{phrase(2, 6)}</title><style>p{{}}</style></head><body>{''.join(before)}{body}{''.join(after)}</body></html>", content


@lru_cache(maxsize=2)
def _made_rows(pages: int = 200, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, content = made_page(r, False)
        blocks, left = blocks_of(page), deque(content)
        labels = np.zeros(len(blocks))
        for i, b in enumerate(blocks):
            if left and b.text == " ".join(left[0].split()):
                left.popleft()
                labels[i] = 1
        xs.append(features(blocks))
        ys.append(labels)
    return np.concatenate(xs), np.concatenate(ys)


def fit(pages: DataFrame | None = None, fit_pages: int = FIT_PAGES) -> np.ndarray:
    """Weights of the classifier, from generated pages and about fit_pages pages of the table that have an article or main element."""
    x, y = _made_rows()
    weight = np.ones(len(y))
    if pages is not None:
        marked = bounded_batches(pages).select("html").where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
        total = marked.count()
        draw = F.pmod(F.xxhash64(F.lit(23), "html"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, fit_pages / max(total, 1)))
        sample = (marked.where(draw) if total > fit_pages else marked).distinct()

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for raw in b["html"]:
                    blocks = blocks_of(raw.as_py())
                    labels = known_labels(blocks)
                    if labels is not None:
                        some = np.arange(len(blocks)) if len(blocks) <= FIT_BLOCKS else np.linspace(0, len(blocks) - 1, FIT_BLOCKS).astype(int)
                        yield pa.RecordBatch.from_arrays([pa.array([features(blocks)[some].astype(np.float32).tobytes()]), pa.array([labels[some].astype(np.int8).tobytes()])], names=["x", "y"])

        found = sorted(zip(*sample.mapInArrow(read, "x binary, y binary").toArrow().to_pydict().values(), strict=True))  # of fit_pages pages, FIT_BLOCKS rows each
        if found:
            more = np.concatenate([np.frombuffer(a, np.float32).reshape(-1, FEATURES) for a, _ in found]).astype(float)
            labels = np.concatenate([np.frombuffer(b, np.int8) for _, b in found]).astype(float)
            share = len(y) / len(labels)  # both sources count alike
            x, y, weight = np.concatenate([x, more]), np.concatenate([y, labels]), np.concatenate([weight, np.full(len(labels), min(share, 1.0))])
    return learnt(x, y, weight)


def scores(blocks: list[Block], weights: np.ndarray, marks: bool = True) -> np.ndarray:
    """Log odds of being content; minus infinity for certain boilerplate."""
    out = np.clip(features(blocks) @ weights, -6, 6)
    kinds = [b.element for b in blocks]
    free = [not e.bad and (e.part is None or e.part.total == 0) for e in kinds]
    article = any(e.article and f for e, f in zip(kinds, free, strict=True))
    main = any(e.main and f for e, f in zip(kinds, free, strict=True))
    for i, e in enumerate(kinds):
        if e.bad:
            out[i] = -np.inf
        elif marks:
            inside = e.article or e.main and not article
            if e.part is not None:
                out[i] += e.part.total
            if inside:
                out[i] += MARKS["article"] + MARKS["heading"] * (e.tag in HEADINGS)
            elif main and not e.main or article and not main:
                out[i] += MARKS["outside"]
            elif e.wanted:
                out[i] += MARKS["wanted"]
            if e.header and not (e.article and e.tag in HEADINGS):
                out[i] += MARKS["header"] + MARKS["outside"] * inside
    return out


def _distance(a: _Element, b: _Element, most: int = 12) -> int:
    """Steps between two elements in the tree, most at the most."""
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Ties between successive blocks and between successive children of one parent, weaker with distance in the tree."""
    out = [(i, i + 1, NEAR * DECAY ** _distance(blocks[i].element, blocks[i + 1].element)) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        up = b.element.parent or b.element
        if up.no in last and last[up.no] < i - 1:
            out.append((last[up.no], i, NEAR * DECAY**2))
        last[up.no] = i
    return out


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: minus the score of each content block that is negative, the score of each
    other block that is positive, and the weight of each edge whose ends differ."""
    n = len(scores)
    ties: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        ties[i][j] = ties[i].get(j, 0.0) + w
        ties[j][i] = ties[j].get(i, 0.0) + w
    s, label = list(scores), [None] * n
    queue = deque(range(n))
    while queue:  # a terminal that outweighs all ties decides its block in some minimum cut
        i = queue.popleft()
        if label[i] is None and abs(s[i]) >= sum(ties[i].values()):
            label[i] = s[i] > 0
            for j, w in ties[i].items():
                s[j] += w if label[i] else -w
                del ties[j][i]
                if label[j] is None:
                    queue.append(j)
            ties[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, content in zip(rest, _max_flow({k: i for i, k in enumerate(rest)}, s, ties), strict=True):
            label[i] = content
    return label


def _max_flow(index: dict[int, int], s: list[float], ties: list[dict[int, float]]) -> list[bool]:
    """Dinic's algorithm; True for what the content terminal still reaches."""
    n = len(index)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, i in index.items():
        if s[k] > 0:
            tie(source, i, s[k], 0.0)
        elif s[k] < 0:
            tie(i, sink, -s[k], 0.0)
        for j, w in ties[k].items():
            if k < j:
                tie(i, index[j], w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        while True:
            path, a = [], source
            while a != sink:
                while turn[a] < len(out[a]):
                    e = out[a][turn[a]]
                    if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                        break
                    turn[a] += 1
                else:
                    if not path:
                        break
                    a = to[path.pop() ^ 1]
                    turn[a] += 1
                    continue
                path.append(e)
                a = to[e]
            if a != sink:
                break
            least = min(room[e] for e in path)
            for e in path:
                room[e] -= least
                room[e ^ 1] += least


@lru_cache(maxsize=1)
def _general() -> np.ndarray:
    return fit()


def main_text(page: str | None, weights: np.ndarray | None = None, marks: bool = True) -> str:
    """The content blocks of a page, joined by an empty line; without marks only the classifier and the ties decide."""
    weights = _general() if weights is None else weights
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    scored = scores(blocks, weights, marks)
    kept = np.flatnonzero(scored > -np.inf)
    order = [blocks[i] for i in kept]
    return "\n\n".join(b.text for b, content in zip(order, min_cut(scored[kept].tolist(), edges_of(order)), strict=True) if content)


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """pages with text, the main text of the html, and without html."""
    pages = bounded_batches(pages).drop("text")
    weights = fit(pages) if weights is None else weights
    rest = pages.drop("html")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), weights) for x in b["html"]]
            names = [c for c in b.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in names], pa.array(texts, pa.string())], names=[*names, "text"])

    return pages.mapInArrow(read, fields(rest, "text string"))
