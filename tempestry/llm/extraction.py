"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Every block-level element is a node with features of its subtree (text and link density, paragraphs, marks),
its attribute tokens, depth, place among its siblings and theirs.  Boosted trees give the probability that
it holds article text.  Decoding is joint: a node that is dropped drops all below it, a node that is kept may
still drop parts; dynamic programming from the leaves finds the likeliest consistent choice, so an ancestor
and a descendant never contradict each other.

The model is fitted on at most `sample_pages` pages of the table: those with a single <article> element say
which text is the article; some sentences of each (parameters) are also set anew in layouts drawn from common element and class names, with
menus, side columns, notices, adverts, forms and reader comments made of the sample's own sentences.

Defined results: a null or empty html, or a page without kept text, gives an empty text; unclosed and stray tags
are tolerated; repeated rows are handled one by one; an empty table gives an empty result; further columns
pass through, those named text or n_chars are replaced.

Every sample page is learned from again with its article's names taken away, so that tags and classes don't decide alone.  Of
equal scores the element is kept.  A very long page is parsed as any other, in time linear in its length.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempestry.llm import boosting
from tempestry.llm.common import bounded_sample

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
# Element names by their part in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe select option button title object canvas".split())
PLAIN = frozenset("script style noscript textarea iframe title".split())  # of these, what is read only for an end tag
_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?![a-zA-Z0-9:-])", re.I)
CLOSES_P = BLOCKS - {"body", "html"}
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
LOOSE = "#text"
WORDS = {
    "article": "article content post entry story text body main".split(),
    "menu": "nav navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip".split(),
    "edge": "header footer foot head masthead banner top bottom copyright legal imprint".split(),
    "side": "side sidebar aside rail widget related recommended trending more tags author share social".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe paywall".split(),
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promoted banner commercial".split(),
    "comment": "comment comments reply replies discussion respond disqus reader thread".split(),
    "form": "form search login signup contact input".split(),
}
TAG_GROUPS = [{"article"}, {"main"}, {"section"}, {"div"}, {"p", "blockquote", "pre"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "menu"}, {"li", "dt", "dd"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset"}, {"table", "tr", "td", "th", "tbody"}, {"figure", "figcaption"}, {"body", "html"}]


@dataclass(frozen=True)
class ExtractionParams:
    sample_pages: int = 120
    layouts: int = 5
    nameless: int = 3  # times that a sample page is learned from with its article's names taken away
    #: Of a sample page, as material for layouts: its sentences of these lengths, at most so many, and as much of a title.
    sample_sentences: int = 60
    sentence_chars: tuple[int, int] = (3, 199)
    title_chars: int = 80
    rounds: int = 60
    depth: int = 4
    seed: int = 11


class Node:
    __slots__ = ("tag", "attributes", "parent", "depth", "children", "blocks", "size", "linked", "links", "paragraphs", "marks", "number")

    def __init__(self, tag: str, attributes: str, parent):
        self.tag, self.attributes, self.parent, self.children, self.blocks = tag, attributes, parent, [], []
        self.depth = parent.depth + 1 if parent else 0


def _ends(page: str, tag: str) -> list[tuple[int, int]] | dict[int, tuple[int, int]]:
    """(start, end) of the end tags of a RAW element: all in order if PLAIN, else by the end of their start tag."""
    if tag in PLAIN:
        return [m.span() for m in re.finditer(rf"</{tag}(?![a-zA-Z0-9:-])[^>]*>", page, re.I)]
    found, opened = {}, []
    for m in re.finditer(rf"<(/?){tag}(?![a-zA-Z0-9:-])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", page, re.I):
        if m[1] and opened:
            found[opened.pop()] = m.span()
        elif not m[1] and m[0][-2] != "/":
            opened.append(m.end())
    return found


def _end(ends: list | dict, at: int) -> tuple[int, int] | None:
    if isinstance(ends, dict):
        return ends.get(at)
    k = bisect_left(ends, (at, 0))
    return ends[k] if k < len(ends) else None


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """(nodes in page order, blocks as (node, text, characters inside links)).

    A run of text directly under the root is a block of a node LOOSE of its own.  A RAW element without an end tag
    ends at the next block-level tag.
    """
    root = Node("html", "", None)
    nodes, blocks = [root], []
    here, in_link, parts = root, 0, []
    ends: dict[str, list | dict] = {}

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                holder = here
                if here is root:
                    holder = Node(LOOSE, "", root)
                    root.children.append(holder)
                    nodes.append(holder)
                blocks.append((holder, text, sum(len(t) for t, link in parts if link)))
            parts.clear()

    at = 0
    while True:
        m = _TAG.search(page, at)
        chunk = page[at : m.start()] if m else page[at:]
        if chunk:
            parts.append((chunk, in_link > 0))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                up = here
                while up.parent and up.tag != tag:
                    up = up.parent
                if up.tag == tag and up.parent:
                    flush()
                    here, in_link = up.parent, 0
            elif tag == "a":
                in_link = max(0, in_link - 1)
            continue
        if tag in RAW and not m[3].endswith("/"):
            if tag not in ends:
                ends[tag] = _ends(page, tag)
            parts.append((" ", False))
            end = _end(ends[tag], at)
            if end:
                at = end[1]
            else:  # never closed
                block = _BLOCK.search(page, at)
                at = block.start() if block else len(page) if tag in PLAIN else at
            continue
        if tag in BLOCKS:
            flush()
            if tag in ("html", "body"):
                continue
            if tag in CLOSES_P:
                up = here
                while up.parent and up.tag not in ("p", "div", "article", "section", "td", "li"):
                    up = up.parent
                if up.tag == "p":
                    here = up.parent
            if tag in ITEMS:
                same = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
                up = here
                while up.parent and up.tag not in same and up.tag not in ITEMS[tag]:
                    up = up.parent
                if up.tag in same:
                    here = up.parent
            if tag in VOID:
                continue
            in_link = 0
            node = Node(tag, m[3], here)
            here.children.append(node)
            nodes.append(node)
            here = node
        elif tag == "a":
            in_link += 1
        elif tag in VOID:
            parts.append((" ", False))
    flush()
    return nodes, blocks


def _measure(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    for k, n in enumerate(nodes):
        n.number, n.size, n.linked, n.links, n.paragraphs, n.marks, n.blocks = k, 0, 0, 0, 0, 0, []
    for k, (n, text, linked) in enumerate(blocks):
        n.blocks.append(k)
        n.size += len(text)
        n.linked += min(linked, len(text))
        n.links += linked > 0
        n.paragraphs += 1
        n.marks += text.count(". ") + text.count(", ") + (text[-1:] in ".!?")
    for n in reversed(nodes):
        if n.parent:
            for what in ("size", "linked", "links", "paragraphs", "marks"):
                setattr(n.parent, what, getattr(n.parent, what) + getattr(n, what))


def node_features(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> list[list[float]]:
    """Features of every node, in order."""
    _measure(nodes, blocks)
    whole = max(nodes[0].size, 1)
    rows, own = [], {}
    first_block = {}
    # per (parent, tag): siblings and their characters; per parent: the largest size
    alike: dict[tuple[int, str], list[int]] = {}
    largest: dict[int, int] = {}
    for n in nodes[1:]:
        same = alike.setdefault((n.parent.number, n.tag), [0, 0])
        same[0] += 1
        same[1] += n.size
        largest[n.parent.number] = max(largest.get(n.parent.number, 0), n.size)
    # what stands before and after a node under the same parent: characters and the share of links
    nothing = (0.0, 0.0)
    beside = {nodes[0].number: [*nothing, *nothing, 0]}
    for n in nodes:
        told = [(np.log1p(c.size), c.linked / max(c.size, 1)) for c in n.children]
        for k, c in enumerate(n.children):
            beside[c.number] = [*(told[k - 1] if k else nothing), *(told[k + 1] if k + 1 < len(told) else nothing), k]
    sizes = np.concatenate([[0], np.cumsum([len(b[1]) for b in blocks])]) if blocks else np.zeros(1)
    for n in reversed(nodes):
        ks = [*n.blocks[:1], *(first_block[c] for c in n.children if c in first_block)]
        if ks:
            first_block[n] = min(ks)
    for n in nodes:
        attributes = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(n.attributes)) if n.attributes else ""
        names = {t.lower() for t in _TOKEN.findall(attributes)}
        hits = [bool(names.intersection(ws)) for ws in WORDS.values()]
        up = own[n.parent.number] if n.parent else [False] * (len(WORDS) + 3)
        inherited = [a or b for a, b in zip(up, [*hits, n.tag in ("nav", "aside", "footer", "form"), n.tag in ("article", "main"), n.tag in ("header", "ul", "ol")])]
        own[n.number] = inherited
        n_alike, alike_size = alike[n.parent.number, n.tag] if n.parent else (1, n.size)
        around = n.parent.size if n.parent else n.size
        rows.append(
            [
                *[n.tag in g for g in TAG_GROUPS],
                *hits,
                *inherited,
                *beside[n.number],
                n.parent.paragraphs if n.parent else 0,
                n.depth,
                np.log1p(n.size),
                n.size / whole,
                n.size / max(around, 1),
                n.linked / max(n.size, 1),
                n.links,
                n.paragraphs,
                n.size / max(n.paragraphs, 1),
                n.marks / max(n.size / 100, 1),
                len(n.children),
                len(n.parent.children) if n.parent else 1,
                n_alike,
                alike_size / max(around, 1),
                n.size == (largest[n.parent.number] if n.parent else n.size),
                sizes[first_block.get(n, len(blocks))] / whole,
                n.parent.linked / max(n.parent.size, 1) if n.parent else 0,
            ]
        )
    return rows


def decode(nodes: list[Node], p: np.ndarray) -> np.ndarray:
    """The likeliest choice in which nothing is kept below a dropped node; the root is kept."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    keep, drop = np.log(p), np.log(1 - p)
    for n in reversed(nodes):
        for c in n.children:
            keep[n.number] += max(keep[c.number], drop[c.number])
            drop[n.number] += drop[c.number]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for n in nodes[1:]:
        kept[n.number] = kept[n.parent.number] and keep[n.number] >= drop[n.number]
    return kept


def _labels(nodes: list[Node], blocks: list, is_text) -> list[int]:
    """1 for every node that holds a block for which `is_text` holds."""
    good = np.zeros(len(nodes), int)
    for n, text, _ in blocks:
        if is_text(n, text):
            while n is not None and not good[n.number]:
                good[n.number] = 1
                n = n.parent
    return good.tolist()


def _within(n: Node, tag: str) -> bool:
    while n is not None:
        if n.tag == tag:
            return True
        n = n.parent
    return False


def layout(rng: random.Random, title: str, paragraphs: list[str], sentences: list[str]) -> str:
    """A page with `paragraphs` as its article between boilerplate; boilerplate blocks carry a leading mark."""
    say = lambda k=1: "⁠" + " ".join(rng.choice(sentences) for _ in range(k))
    word = lambda: "⁠" + rng.choice(rng.choice(sentences).split() or ["x"])
    e = html.escape

    def box(tags, names, inner):
        tag = rng.choice(tags)
        name = rng.choice(names)
        attribute = rng.choice([f' class="{name}"', f' id="{name}"', f' class="x {name}-wrap"', "" if tag not in ("div", "section") else f' class="{name}"'])
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def menu(n):
        items = "".join(f'<li><a href="/{k}">{e(word())}</a></li>' for k in range(n))
        return f"<ul>{items}</ul>" if rng.random() < 0.7 else "".join(f'<a href="/{k}">{e(word())}</a> ' for k in range(n))

    def advert():
        return box(["div", "aside", "section"], ["ad", "advert", "ads", "sponsored", "promo", "ad-banner"], rng.choice([e(say()), f"<p>{e(say(2))}</p>", f'<a href="#">{e(say())}</a>']))

    def comments():
        one = lambda: box(["div", "li", "article"], ["comment", "comment-item", "reply"], f"<p>{e(say(rng.randint(1, 4)))}</p>" + (f"<span>{e(word())}</span>" if rng.random() < 0.5 else ""))
        return box(["div", "section", "ol"], ["comments", "comment-list", "discussion", "responses", "replies"], f"<h3>{e(word())}</h3>" + "".join(one() for _ in range(rng.randint(1, 6))))

    def notice():
        return box(["div", "section", "aside"], ["cookie-notice", "consent", "alert", "newsletter", "subscribe", "popup", "notice"], rng.choice([e(say()), f"<p>{e(say(2))}</p><button>ok</button>"]))

    def side():
        return box(["div", "aside", "section"], ["sidebar", "widget", "related", "trending", "side-column", "author"], f"<h3>{e(word())}</h3>{menu(rng.randint(2, 8))}" + (f"<p>{e(say())}</p>" if rng.random() < 0.5 else ""))

    def form():
        return f'<form{rng.choice(["", " class=search", " id=contact-form"])}><label>{e(word())}</label><input><p>{e(say())}</p><button>go</button></form>'

    body = "".join(rng.choices([f"<p>{e(t)}</p>", f"<p><b>{e(t)}<br>", f"<div><p>{e(t)}</p></div>", f"<blockquote><p>{e(t)}</p></blockquote>", f"<ul><li>{e(t)}</li></ul>", f"<h2>{e(t)}</h2>" if len(t) < 90 else f"<p>{e(t)}</p>"], [12, 2, 1, 1, 1, 1])[0] + (advert() if rng.random() < 0.08 else "") for t in paragraphs)
    body = rng.choice(["<h1>{0}</h1>{1}", "<h1>{0}</h1><div class='text'>{1}</div>"]).format(e(title), body)
    main = box(["article", "main", "div", "section"], ["content", "post", "entry", "story", "article-body", "main-text", "body-text"], body)
    if rng.random() < 0.5:
        main = box(["div", "main", "section"], ["wrapper", "container", "page", "main", "columns", "row"], (side() if rng.random() < 0.3 else "") + main + (side() if rng.random() < 0.5 else "") + (comments() if rng.random() < 0.5 else ""))
    top = rng.choice([f"<nav>{menu(rng.randint(3, 9))}</nav>", box(["header", "div"], ["header", "masthead", "top", "banner"], f"<p>{e(say())}</p>{menu(5)}"), box(["div", "nav", "ul"], ["menu", "navigation", "nav", "breadcrumbs"], menu(6))])
    if rng.random() < 0.5:
        top += f"<nav>{menu(rng.randint(3, 9))}</nav>"
    parts = [top, notice() if rng.random() < 0.4 else "", advert() if rng.random() < 0.6 else "", main]
    parts += [part() for part, odds in ((comments, 0.4), (side, 0.4), (form, 0.3), (advert, 0.3), (notice, 0.2)) if rng.random() < odds]
    parts.append(box(["footer", "div"], ["footer", "site-footer", "copyright", "legal"], rng.choice([e(say()), f"<p>{e(say(2))}</p>", menu(4) + e(say())])))
    return f"<!DOCTYPE html><html><head><title>{e(title)}</title></head><body>{''.join(parts)}</body></html>"


def bare_layout(rng: random.Random, title: str, paragraphs: list[str], sentences: list[str]) -> str:
    """A page with its article as text directly under body, likewise some of its (marked) boilerplate."""
    e = html.escape
    say = lambda k=1: "⁠" + e(" ".join(rng.choice(sentences) for _ in range(k)))
    links = lambda: rng.choice([" ", " | "]).join(f'<a href="/{k}">⁠{e(rng.choice(rng.choice(sentences).split() or ["x"]))}</a>' for k in range(rng.randint(2, 8)))
    rows = rng.sample(paragraphs, rng.randint(1, len(paragraphs)))
    main = rng.choice(["<br><br>", "<br>", "<hr>"]).join(rng.choice(["{0}", "{0}", "<b>{0}</b>", "<font size=2>{0}</font>"]).format(e(t)) for t in rows)
    top = rng.choice(["", "", f"<nav><ul><li>{links()}</li></ul></nav>", f"<div class=menu>{links()}</div>", f"{links()}<hr>", f"{say()}<hr>"])
    top += f"<div class=ad>{say()}</div>" if rng.random() < 0.3 else ""
    top += f"<h1>{e(title)}</h1>" if rng.random() < 0.4 else ""
    foot = rng.choice(["", "", f"<footer>{say()}</footer>", f"<div class=footer>{say()}</div>", f"<hr>{say()}", f"<hr>{links()}", f"<hr>{links()}<br>{say()}"])
    return f"<html><head><title>{e(title)}</title></head><body>{top}{main}{foot}</body></html>"


def _unname(rng: random.Random, nodes: list[Node]) -> None:
    """Take from a page what tells its article by name: the element becomes a plain one, and the attributes of what is
    around and inside it go."""
    tag, odd, inside = rng.choice(["div", "div", "section", "td"]), rng.choice(["", f' class="x{rng.randrange(1000)}"']), set()
    for n in nodes:  # parents come first
        if n.parent is not None and n.parent in inside:
            inside.add(n)
            n.attributes = ""
        elif n.tag == "article":
            inside.add(n)
            n.tag, n.attributes, up = tag, odd, n.parent
            while up is not None:
                up.tag, up.attributes, up = "div" if up.tag == "main" else up.tag, "", up.parent


def fit(pages: DataFrame, p: ExtractionParams = ExtractionParams()) -> dict:
    """The model, from a bounded sample of pages with a single <article> element."""
    rows = bounded_sample(pages.filter(F.regexp_count("html", F.lit("<article[ >]")) == 1), "html", p.sample_pages)
    rng = random.Random(p.seed)
    x, y, sets, sentences = [], [], [], []
    for page in rows:
        nodes, blocks = parse(page)
        features, labels = node_features(nodes, blocks), _labels(nodes, blocks, lambda n, t: _within(n, "article"))
        x += [features[n.number] for n in nodes if n.tag != LOOSE]
        y += [labels[n.number] for n in nodes if n.tag != LOOSE]
        texts = [t for n, t, _ in blocks if _within(n, "article")]
        for _ in range(p.nameless):
            again, found = parse(page)
            _unname(rng, again)
            rows_ = node_features(again, found)
            x += [rows_[n.number] for n in again if n.tag != LOOSE]
            y += [labels[n.number] for n in again if n.tag != LOOSE]
        sets.append((texts[0][: p.title_chars] if texts else "", texts[1:]))
        low, high = p.sentence_chars
        sentences += [s + "." for n, t, _ in blocks for s in t.split(". ") if low <= len(s) <= high][: p.sample_sentences]
    if not sentences:  # nothing to learn from: the layouts stand alone
        sentences, sets = ["Some words of a sentence, set here.", "Other words follow"], [("A title", ["Words of a paragraph. " * 4] * 4)]
    for title, texts in sets:
        for _ in range(p.layouts):
            nodes, blocks = parse(layout(rng, title, texts or [rng.choice(sentences)], sentences))
            x += node_features(nodes, blocks)
            y += _labels(nodes, blocks, lambda n, t: "⁠" not in t)
    # text directly under body has trees of its own, so that it does not change how elements are judged
    loose_x, loose_y, rng = [], [], random.Random(p.seed + 1)
    for title, texts in sets:
        for _ in range(p.layouts):
            nodes, blocks = parse(bare_layout(rng, title, texts or [rng.choice(sentences)], sentences))
            rows, labels = node_features(nodes, blocks), _labels(nodes, blocks, lambda n, t: "⁠" not in t)
            loose_x += [rows[n.number] for n in nodes if n.tag == LOOSE]
            loose_y += [labels[n.number] for n in nodes if n.tag == LOOSE]
    fitted = boosting.fit(np.array(x, float), np.array(y), rounds=p.rounds, depth=p.depth)
    return {**fitted, LOOSE: boosting.fit(np.array(loose_x, float), np.array(loose_y), rounds=p.rounds, depth=p.depth)}


def main_texts(pages: list[str | None], model: dict) -> list[str]:
    """The main text of every page; nodes of many pages are scored together."""
    parsed = [parse(h) if h else ([], []) for h in pages]
    rows = [node_features(nodes, blocks) if blocks else [] for nodes, blocks in parsed]
    scores = boosting.predict(model, np.array([r for rs in rows for r in rs], float))
    loose = np.array([n.tag == LOOSE for (nodes, _), rs in zip(parsed, rows) if rs for n in nodes], bool)
    if loose.any():
        scores[loose] = boosting.predict(model[LOOSE], np.array([r for rs in rows for r in rs], float)[loose])
    out, at = [], 0
    for (nodes, blocks), rs in zip(parsed, rows):
        kept = decode(nodes, scores[at : at + len(rs)]) if rs else []
        out.append("\n".join(text for n, text, _ in blocks if kept[n.number]))
        at += len(rs)
    return out


def extracted(pages: DataFrame, model: dict) -> DataFrame:
    """`pages` with text and n_chars."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            values = batch.tolist()
            yield pd.Series([t for k in range(0, len(values), 64) for t in main_texts(values[k : k + 64], model)], dtype=object)

    return pages.withColumn("text", text("html")).withColumn("n_chars", F.length("text").cast("long"))
