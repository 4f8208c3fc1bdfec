"""Main text of HTML pages: flat blocks, classified by a decision tree.

A page becomes a flat list of text blocks, cut wherever a block-level element begins or ends. A block has its word count and
link density, those of the blocks before and after it, and where it stands (within the article, within navigation, in an
element named like an advert or a comment, ...). A decision tree, grown on the labelled blocks of a few generated pages,
says which blocks are content."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Element names by role, and words in class, id and role attributes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr input button select textarea".split())
SKIPPED = frozenset("script style noscript template iframe object svg canvas head title select textarea button option math audio video".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
ASIDE = frozenset("nav header footer aside form menu dialog fieldset search".split())
CONTENT = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that name what isn't content, what is, and what may stand beside either in a name.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsors sponsored promo promos promoted promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer footers masthead "
    "comment comments commentlist reply replies disqus discussion respond cookie cookies consent notice notices alert alerts notification notifications gdpr popup modal overlay toast newsletter subscribe subscription signup "
    "login feedback search share sharing sharebar social related recommended recommendations toolbar pagination pager widget widgets copyright legal disclaimer skip hidden header".split()
)
MAIN = frozenset("article content main post entry story".split())
BESIDE = frozenset(
    "area bar block body bottom box button buttons card cards column container content credits entry field fields footer form global group header image info inner inline item items left line link links list "
    "main meta module nav outer page panel post posts article articles primary reader readers right row secondary section sections site slot small story text top unit user users visitor wrap wrapper".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s/>]|$)""", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "content", "aside", "named", "page_has_content", "heading", "list", "rights")
_RIGHTS = re.compile(r"^(?:copyright\s*)?(?:\(c\)|\u00a9|copyright)\s*(?:[0-9]{4}|by\b)|all rights reserved", re.I)


@lru_cache(maxsize=10_000)
def _said(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether attributes name an element of that tag as something else than content, as content, or hide it.

    Each name in class, id or role is words joined by hyphens or capitals. It counts if all its words are known ones, so
    that slugs of titles (search-methods) and modifiers (has-sidebar) don't. Ids of headings never count."""
    named = main = hidden = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name in ("class", "id", "role"):
            if name == "id" and tag in HEADINGS:
                continue
            for one in value.split():
                words = [w for w in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower().replace("side-bar", "sidebar").replace("_", "-").split("-") if w and not w.isdigit()]
                known = all(w in NAMED or w in MAIN or w in BESIDE for w in words)
                if known and any(w in NAMED for w in words):
                    named = True
                elif known and any(w in MAIN for w in words):
                    main = True
        else:
            hidden |= name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower())
    return named, main, hidden


class _Frame:
    __slots__ = ("tag", "content", "aside", "named", "skip", "heading", "list")

    def __init__(self, tag: str, up: _Frame | None, attributes: str) -> None:
        self.tag = tag
        named, main, hidden = _said(tag, attributes) if attributes else (False, False, False)
        whole = tag in ("body", "html")
        over = up or _NOWHERE
        self.named = over.named or (named and tag not in INLINE and not whole and not (main and tag in CONTENT))
        self.content = over.content or tag in CONTENT or (main and not named and not whole and tag not in INLINE)
        # a header within the article holds the article's own title
        own = tag == "header" and over.content and not over.aside
        self.aside = 0 if tag in HEADINGS and over.aside == 1 else max(over.aside, 1 if own else 2 * (tag in ASIDE))
        self.skip = over.skip or tag in SKIPPED or hidden
        self.heading = over.heading or tag in HEADINGS
        self.list = over.list or tag in ("li", "ul", "ol", "dl", "td", "th")


class _Nowhere:
    content = named = skip = heading = list = False
    aside = 0


_NOWHERE = _Nowhere()
#: Elements whose beginning ends an open one of the same kind.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table td th body html article section div main aside nav header footer form".split())


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """The text blocks of a page in order, with the features FEATURES; blocks without text don't count.

    Comments, declarations and elements that aren't shown are left out. End tags without a beginning are ignored, missing
    ones implied; a page that breaks off in a tag or a comment ends there."""
    root = _Frame("", None, "")
    stack = [root]
    out: list[list] = []
    text: list[str] = []
    linked: list[int] = []
    in_link = 0
    place = root
    opened: Counter[str] = Counter()  # elements on the stack by tag: an end tag of none needs no search

    def close(k: int) -> None:
        opened.subtract(f.tag for f in stack[k:])
        del stack[k:]

    def flush() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                n = joined.count(" ") + 1
                out.append([joined, n, min(1.0, sum(linked) / n), place])
            text, linked = [], []

    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        cut = token.start() if token else end
        if cut > at and not stack[-1].skip:
            piece = page[at:cut]
            if not text:
                place = stack[-1]
            text.append(piece)
            if in_link:
                linked.append(len(piece.split()))
        if not token:
            break
        at = token.end()
        tag = token.group(2)
        if tag is None:
            if token.group().startswith("<![CDATA[") and not stack[-1].skip:
                text.append(html.escape(token.group()[9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        closing = bool(token.group(1))
        if tag not in INLINE:
            flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    if tag not in INLINE or all(f.tag in INLINE for f in stack[k:]):
                        close(k)
                    break
            if tag == "a":
                in_link = max(0, in_link - 1)
            continue
        if tag == "br":
            flush()
        if tag in VOID:
            continue
        for other in _CLOSES.get(tag, ()):
            for k in range(len(stack) - 1, 0, -1) if opened[other] else ():
                if stack[k].tag == other:
                    close(k)
                    break
                if stack[k].tag in _SCOPE:
                    break
        attributes = token.group(3) or ""
        if attributes.rstrip().endswith("/") and tag in ("svg", "math", "path"):
            continue
        stack.append(_Frame(tag, stack[-1], attributes))
        opened[tag] += 1
        if tag == "a":
            in_link += 1
        if tag in RAW:
            closed = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(page, at)
            raw = closed.start() if closed else end
            if not stack[-1].skip:
                text.append(page[at:raw])
            at = raw
    flush()
    has_content = any(b[3].content for b in out)
    rows = []
    for i, (t, n, d, f) in enumerate(out):
        before, after = (out[i - 1] if i else (0, 0, 0.0)), (out[i + 1] if i + 1 < len(out) else (0, 0, 0.0))
        rows.append((t, [n, d, before[1], before[2], after[1], after[2], float(bool(f.content)), float(bool(f.aside)), float(bool(f.named)), float(has_content), float(bool(f.heading)), float(bool(f.list)), float(n <= 40 and bool(_RIGHTS.search(t)))]))
    return rows


#: Pages of the labelled table, the depth of the tree, and the fewest blocks of a leaf.
PAGES, DEPTH, LEAF = 300, 9, 5


def labelled_pages(seed: int, n: int = PAGES) -> list[str]:
    """Pages whose words say whether they are content: those of content begin with c, all others with z.

    Layouts vary: with or without an element around the article, menus marked up or bare, and so on."""
    r = random.Random(seed)

    def words(a: int, b: int, kind: str = "c") -> str:
        return " ".join(f"{kind}{r.randrange(1000)}" for _ in range(r.randint(a, b)))

    def links(a: int, b: int, kind: str = "z") -> str:
        return f"<a href=x>{words(a, b, kind)}</a>"

    def menu() -> str:
        items = [links(1, 3) for _ in range(r.randint(4, 9))]
        rows, divs = "<li>".join(items), "</div><div>".join(items)
        return r.choice([f"<ul><li>{rows}</ul>", f"<div>{divs}</div>", f"<nav><ul><li>{rows}</ul></nav>", f'<div class="menu"><div>{divs}</div></div>', f"<table><tr><td>{'<td>'.join(items)}</table>", f"<p>{' | '.join(items)}</p>"])

    def aside() -> str:
        short, long = words(1, 8, "z"), words(9, 70, "z")
        return r.choice([
            f"<aside><h3>{short}</h3><p>{long}</p></aside>", f'<div class="sidebar"><p>{long}</p>{menu()}</div>', f'<div class="cookie-notice">{r.choice([short, long])}</div>', f"<div class=ad>{r.choice([short, long])}</div>",
            f'<div id="ad-slot-2"><p>{short}</p></div>', f"<form><label>{short}</label></form>", f'<div class="newsletter-signup"><h3>{short}</h3><p>{long}</p></div>', f'<div class="share">{links(1, 2)} {links(1, 1)}</div>',
            f'<section class="comments"><h2>{short}</h2><p>{long}</p><p>{words(2, 40, "z")}</p></section>', f'<div class="related-posts"><h3>{short}</h3><ul><li>{links(4, 10)}<li>{links(4, 10)}</ul></div>',
        ])

    def block(within: bool) -> str:
        kind = r.randrange(12)
        if kind < 5:
            return f"<p>{words(8, 150)}</p>"
        if kind == 5:
            return f"<p>{words(1, 8)}</p>"
        if kind == 6:
            return f"<h2>{words(1, 9)}</h2><p>{words(10, 60)}</p>"
        if kind == 7:
            return "<ul><li>" + "<li>".join(words(2, 20) for _ in range(r.randint(2, 5))) + "</ul>"
        if kind == 8:
            return f"<p>{words(6, 40)} {links(1, 14, 'c')} {words(4, 40)}</p>"
        if kind == 9:
            return f"<blockquote>{words(5, 60)}</blockquote>"
        if kind == 10 and within:
            return r.choice([f"<p>{links(3, 12, 'c')}</p>", f"<ul><li>{links(1, 6, 'c')}<li>{links(1, 6, 'c')}</ul>", f"<p>{links(2, 5, 'c')}, {links(2, 5, 'c')}</p><p>{words(3, 30)}</p>", f"<p>Copyright 2020 {words(2, 20)}</p>"])
        return f"<div>{words(5, 90)}<br>{words(5, 60)}</div>"

    pages = []
    for _ in range(n):
        open_, close = r.choice([("", "")] * 4 + [("<article>", "</article>")] * 3 + [("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post-77" class="post">', "</div>")])
        body = [block(bool(open_)) for _ in range(r.randint(1, 9))]
        if r.random() < 0.8:
            body.insert(0, f"<h1>{words(1, 12)}</h1>")
        if r.random() < 0.5:
            body.insert(r.randint(0, len(body)), r.choice([aside(), aside(), f"<nav>{links(1, 4)} {links(1, 4)}</nav>", f"<aside>{links(3, 9)}</aside>", f"<footer>{links(1, 3)} {words(0, 9, 'z')}</footer>", f"<form>{links(1, 3)}</form>"]))
        top = [x for x in (f"<header><p>{words(1, 12, 'z')}</p></header>", menu(), aside(), f"<div>{links(1, 2)}</div>") if r.random() < 0.5]
        if open_ and r.random() < 0.3:
            top.append(f"<p>{words(3, 60, 'z')}</p>")
        end = [x for x in (aside(), menu(), aside()) if r.random() < 0.5]
        end += [r.choice([f"<footer>&copy; {words(1, 30, 'z')}</footer>", f"<footer><p>{words(2, 40, 'z')}</p>{menu()}</footer>", f"<div class=footer>{words(2, 30, 'z')}</div>", f"<p>Copyright 2024 {words(1, 12, 'z')}</p>", f"<div>&copy; 2020 {words(1, 12, 'z')}</div>", ""])]
        r.shuffle(end)
        if r.random() < 0.35:  # nothing but the article, maybe a short one
            top, end, body = [], [], r.choice([body, [f"<p>{words(1, 12)}</p>"], [*body, f"<p>{words(1, 6)}</p>"]])
        pages.append(f"<html><body>{''.join(top)}{open_}{''.join(body)}{close}{''.join(end)}</body></html>")
    return pages


def labelled(seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: blocks of generated pages as FEATURES, and whether they are content."""
    table = [(row, next(w[0] for w in t.split() if re.fullmatch("[cz][0-9]+", w)) == "c") for page in labelled_pages(seed) for t, row in blocks(page)]
    return np.array([row for row, _ in table]), np.array([y for _, y in table], int)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = DEPTH) -> dict | int:
    """A binary decision tree by Gini impurity, of at most `depth` splits on the way to a leaf, leaves of LEAF blocks or more:
    {"feature", "cut", "low", "high"} or a label. Of equally good splits the first feature and the least cut stand."""
    most = int(labels.mean() >= 0.5)
    if depth == 0 or len(set(labels.tolist())) == 1:
        return most
    best = None
    for f in range(rows.shape[1]):
        order = np.argsort(rows[:, f], kind="stable")
        x, y = rows[order, f], labels[order]
        n = np.arange(1, len(y))
        good = np.cumsum(y)[:-1]
        impurity = 2 * good * (1 - good / n) + 2 * (y.sum() - good) * (1 - (y.sum() - good) / (len(y) - n))
        fits = (x[1:] > x[:-1]) & (n >= LEAF) & (len(y) - n >= LEAF)
        if fits.any():
            k = int(np.where(fits, impurity, np.inf).argmin())
            if best is None or impurity[k] < best[0] - 1e-9:
                best = float(impurity[k]), f, float((x[k] + x[k + 1]) / 2)
    if best is None or best[0] > 2 * labels.sum() * (1 - labels.mean()) - 1e-9:
        return most
    _, f, cut = best
    at = rows[:, f] < cut
    low, high = grow(rows[at], labels[at], depth - 1), grow(rows[~at], labels[~at], depth - 1)
    return low if low == high else {"feature": f, "cut": cut, "low": low, "high": high}


@lru_cache(maxsize=1)
def trained() -> dict | int:
    return grow(*labelled())


def is_content(row: list[float], tree: dict | int) -> bool:
    while isinstance(tree, dict):
        tree = tree["low"] if row[tree["feature"]] < tree["cut"] else tree["high"]
    return bool(tree)


def main_text(page: str, tree: dict | int) -> str:
    return " ".join(t for t, row in blocks(page) if is_content(row, tree))


def _extract(tree: dict | int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pages in slices(batches, "html"):
            texts = [main_text(p, tree) for p in pages]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html).

    Blocks of content, white space within them made single spaces, joined in page order by one space; '' for null, empty
    and text-less pages. Null ids and urls stay null; repeated rows appear each; other columns are ignored; an empty table
    gives an empty result."""
    got = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extract(trained()), "page_id long, url string, text string")
    return got.withColumn("n_chars", F.length("text").cast("long"))
