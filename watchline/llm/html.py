"""Main-text extraction: gradient-boosted trees over DOM-node features, then a hierarchical decoding of each page.

A page is parsed leniently into element nodes (inline elements without class, id or role belong to their block). Every node
gets features: tag kinds, tokens of class, id and role (own and ancestors'), text, link and punctuation density of the
subtree, depth, and its place and share among siblings. Boosted trees of depth 4 (second-order logistic loss, 32 bins a
feature) give each node the odds that its subtree holds main text. Decoding chooses keep or drop for all nodes of a page at
once, so that the sum of the odds is largest while nothing is kept below a dropped node.

Training pages are the PAGES that come first in a hash order (the bound on the fitting sample), each also in a varied
form, in which containers change their names and marked asides come in. Labels are weak: text inside an article or main
element, or one named as content, and outside anything named or tagged as menu, advert, comment and the like. Pages without
such a container teach nothing; if none is left, the same naming rules decide instead of the trees.

Blocks are joined by one newline in page order; white space in a block becomes one space, `br` counts as white space, and
character references are decoded. Scripts, styles, heads, templates and form controls are no text. Edge cases: null and
empty html give an empty text; broken nesting is closed at the next enclosing element; text outside any markup is a block
of the page; repeated rows and ids are extracted row by row; empty tables give empty results; other columns are ignored.
"""

import random
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..ship import ship
from .words import record_batch, slices

PAGES, TREES, DEPTH, BINS, RATE = 300, 40, 4, 32, 0.3
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title".split())  # text up to the closing tag, or to the end of the page
HIDDEN = set("noscript template iframe svg select button object".split())  # left out as a whole where a closing tag matches
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i kbd label mark q s samp small span strike strong sub "
             "sup time tt u var ins del nobr".split())
CLOSED_BY = {"p": set("p div ul ol li dl dt dd table tr td th section article aside nav header footer form h1 h2 h3 h4 h5 h6 "
                      "blockquote pre main figure address fieldset hr".split()),
             "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "option": {"option"}}
CLOSED_BY |= {t: CLOSED_BY["p"] | {"li", "dt", "dd", "tr", "td", "th", "tbody"} for t in HIDDEN}
ASIDE_TAGS = set("nav header footer aside form menu dialog".split())
MAIN_TAGS = {"article", "main"}
ASIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead topbar footer sidebar aside rail widget related recommended share sharing social "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search "
    "pagination pager comment comments reply replies respond discussion disqus form skip toolbar tags copyright legal "
    "contentinfo complementary".split())
MAIN_NAMES = set("article content post entry story main body text maincontent articlebody".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def matching(html, tag):
    """Start of every opening tag that a closing one matches -> end of that one."""
    out, open_ = {}, []
    for m in re.finditer(rf"<(/?){tag}(?![a-zA-Z0-9:-])[^>]*>", html, re.I):
        if not m[1]:
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.end()
    return out


class Page:
    """Nodes in page order (0 is the page itself): parent, tag, names; events are (node, text, in a link) or None."""

    def __init__(self, html):
        self.parent, self.tag, self.names, self.events = [-1], [""], [()], []
        self._parse(html)

    def _parse(self, html):
        stack, links, at, size, closed = [(0, "")], 0, 0, len(html), {}
        events = self.events
        while at < size:
            m = TAG.search(html, at)
            stop = m.start() if m else size
            if stop > at:
                events.append((stack[-1][0], html[at:stop], links > 0))
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][1] == tag:
                        links -= sum(t == "a" for _, t in stack[i:])
                        del stack[i:]
                        break
                if tag not in INLINE:
                    events.append(None)
                continue
            if tag in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else size
                continue
            if tag in HIDDEN and not m[3].endswith("/"):
                if tag not in closed:
                    closed[tag] = matching(html, tag)
                if m.start() in closed[tag]:
                    at = closed[tag][m.start()]
                    continue
            if tag == "br":
                events.append((stack[-1][0], " ", False))
                continue
            if tag in VOID:
                if tag == "hr":
                    events.append(None)
                continue
            if tag not in INLINE:
                events.append(None)
                for i in range(len(stack) - 1, 0, -1):
                    if tag in CLOSED_BY.get(stack[i][1], ()):
                        links -= sum(t == "a" for _, t in stack[i:])
                        del stack[i:]
                        break
                    if stack[i][1] not in INLINE:
                        break
            names = ()
            if "=" in m[3]:
                found = " ".join(a or b or c for _, a, b, c in NAMED.findall(m[3]))
                names = tuple(NAME.findall(CAMEL.sub(" ", found).lower()))
            if m[3].endswith("/") and tag not in INLINE:
                continue
            if tag in INLINE and not names:
                stack.append((stack[-1][0], tag))
            else:
                self.parent.append(stack[-1][0])
                self.tag.append(tag)
                self.names.append(names)
                stack.append((len(self.parent) - 1, tag))
            links += tag == "a"
        self.in_head = self._below({i for i, t in enumerate(self.tag) if t == "head" or t in HIDDEN})

    def _below(self, tops):
        out = [False] * len(self.parent)
        for i, p in enumerate(self.parent):
            out[i] = i in tops or (p >= 0 and out[p])
        return out

    def text(self, keep):
        """The blocks of the kept nodes."""
        blocks, run = [], []
        for e in [*self.events, None]:
            if e is None:
                if run:
                    block = " ".join(unescape("".join(run)).split())
                    if block:
                        blocks.append(block)
                    run = []
            elif keep[e[0]] and not self.in_head[e[0]]:
                run.append(e[1])
        return "\n".join(blocks)


KINDS = ({"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "menu"}, {"li", "dt", "dd"}, {"div", "section", "span"},
         MAIN_TAGS, ASIDE_TAGS, {"table", "tr", "td", "th", "tbody"}, {"blockquote", "pre", "figure"}, {"", "html", "body"})
WIDTH = len(KINDS) + 26


def node_features(page):
    """One row of numbers for each node of a page."""
    n = len(page.parent)
    parent, tags, names = page.parent, page.tag, page.names
    own, linked, stops, total, links, points = ([0] * n for _ in range(6))
    for e in page.events:
        if e is not None:
            i, text, in_link = e
            size = len(text) - text.count(" ") - text.count("\n")
            own[i] += size
            if in_link:
                linked[i] += size
            stops[i] += text.count(".") + text.count(",")
    nodes, children, rank = [1] * n, [0] * n, [0] * n
    total, links, points = own[:], linked[:], stops[:]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        links[p] += links[i]
        points[p] += points[i]
        nodes[p] += nodes[i]
    depth, aside_tag, main_tag, aside_name, main_name = ([0] * n for _ in range(5))
    bad, good, before = [0] * n, [0] * n, [0] * n
    last, previous = {}, [0] * n
    following = [0] * n
    for i in range(n):
        p = parent[i]
        bad[i] = sum(x in ASIDE_NAMES for x in names[i])
        good[i] = sum(x in MAIN_NAMES for x in names[i])
        if p >= 0:
            rank[i] = children[p]
            children[p] += 1
            depth[i] = depth[p] + 1
            aside_tag[i] = aside_tag[p] or tags[p] in ASIDE_TAGS
            main_tag[i] = main_tag[p] or tags[p] in MAIN_TAGS
            aside_name[i] = aside_name[p] or bad[p] > 0
            main_name[i] = main_name[p] or good[p] > 0
            if p in last:
                previous[i] = total[last[p]]
                following[last[p]] = total[i]
            last[p] = i
    whole, seen = max(1, total[0]), 0
    out = np.zeros((n, WIDTH), np.float32)
    rows = []
    for i in range(n):
        p, t = parent[i], max(1, total[i])
        pt, pc = (max(1, total[p]), children[p]) if p >= 0 else (t, 1)
        rows.append((bad[i], good[i], aside_tag[i], main_tag[i], aside_name[i], main_name[i], len(names[i]), depth[i],
                     total[i], own[i], links[i] / t, points[i] / t, nodes[i], total[i] / nodes[i], children[i], own[i] / t,
                     pc, rank[i] / pc, total[i] / pt, total[i] * pc / pt, previous[i], following[i], total[i] / whole,
                     seen / whole, 1 if t > 80 else 0, pt / whole))
        seen += own[i]
    out[:, len(KINDS):] = rows
    for j, kind in enumerate(KINDS):
        out[:, j] = [t in kind for t in tags]
    return out


def weak_labels(page):
    """Whether each node's subtree holds main text by its names and tags; None if no container is marked."""
    n = len(page.parent)
    main, aside = [False] * n, [False] * n
    any_tag = any(t in MAIN_TAGS or "main" in x for t, x in zip(page.tag, page.names))
    for i in range(n):
        p, tag, names = page.parent[i], page.tag[i], page.names[i]
        marked = tag in MAIN_TAGS or "main" in names or (not any_tag and bool(MAIN_NAMES & set(names)) and tag not in ("body", "html"))
        main[i] = (p >= 0 and main[p]) or marked
        aside[i] = (p >= 0 and aside[p]) or tag in ASIDE_TAGS or (bool(ASIDE_NAMES & set(names)) and tag not in ("body", "html", ""))
    if not any(main):
        return None
    out = [False] * n
    for e in page.events:
        if e is not None and main[e[0]] and not aside[e[0]] and not e[1].isspace():
            out[e[0]] = True
    for i in range(n - 1, 0, -1):
        if out[i]:
            out[page.parent[i]] = True
    return out


def varied(html, rng):
    """The page with other container names, and with marked asides among its blocks."""
    opening, closing = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"),
                                   ('<div id="content">', "</div>"), ('<section class="story">', "</section>")])
    out = re.sub(r"<article[^>]*>", opening, html, flags=re.I)
    out = re.sub(r"</article>", closing, out, flags=re.I)
    words = re.findall(r"[^\W\d_]{2,}", re.sub(r"<[^>]*>", " ", html))[:400] or ["a"]
    parts = re.split(r"(?i)(?=<p[ >])", out)
    if rng.random() < 0.4 and closing in out:  # a short text
        few = [f"<p>{' '.join(rng.choice(words) for _ in range(rng.choice([1, 4, 12])))}." for _ in range(rng.randrange(3))]
        title = re.sub(r"(?is)(<h1[^>]*>).*?(</h1>)", rf"\1{rng.choice(words)}\2", parts[0])
        parts = [title, *few, out[out.rindex(closing):]]
    for _ in range(rng.randrange(1, 4)):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 40, 90])))
        inner = rng.choice([f"<p>{text}.</p>", text, f"<ul><li>{text}</li><li>{text}</li></ul>", f"<p>{text}.</p><p>{text}</p>"])
        name = rng.choice(sorted(ASIDE_NAMES))
        tag = rng.choice(["div", "section", "aside", "nav", "header", "footer", "form", "ul"])
        piece = f'<{tag} class="{name}">{inner}</{tag}>' if tag in ("div", "section", "ul") else f"<{tag}>{inner}</{tag}>"
        place = rng.randrange(len(parts))
        parts.insert(place, piece) if place else parts.insert(1, piece)
    return "".join(parts)


def boost(x, y, trees=TREES):
    """(bin edges are thresholds) list of (feature[15], threshold[15], value[16]) for depth 4."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    score, model = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2 ** DEPTH - 1, np.int64), np.full(2 ** DEPTH - 1, np.inf)
        for level in range(DEPTH):
            width, base = 2 ** level, 2 ** level - 1
            best = np.full(width, 1e-3)
            pick = np.zeros((width, 2), np.int64) - 1
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = node * (BINS + 1) + binned[:, f]
                gs = np.cumsum(np.bincount(cell, g, width * (BINS + 1)).reshape(width, -1), 1)
                hs = np.cumsum(np.bincount(cell, h, width * (BINS + 1)).reshape(width, -1), 1)
                gl, hl, gt, ht = gs[:, :len(e)], hs[:, :len(e)], gs[:, -1:], hs[:, -1:]
                gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[better, top[better]]
                pick[better] = np.stack([np.full(better.sum(), f), top[better]], 1)
            for k in range(width):
                if pick[k, 0] >= 0:
                    feature[base + k], threshold[base + k] = pick[k, 0], edges[pick[k, 0]][pick[k, 1]]
            node = node * 2 + (x[np.arange(len(y)), feature[base + node]] > threshold[base + node])
        value = -RATE * np.bincount(node, g, 2 ** DEPTH) / (np.bincount(node, h, 2 ** DEPTH) + 1)
        score += value[node]
        model.append((feature, threshold, value))
    return model


def odds(model, x):
    out, rows = np.zeros(len(x)), np.arange(len(x))
    for feature, threshold, value in model:
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            at = 2 ** level - 1 + node
            node = node * 2 + (x[rows, feature[at]] > threshold[at])
        out += value[node]
    return out


def decode(parent, score):
    """keep per node: the choice of highest total score in which a dropped node has no kept node below it."""
    n = len(parent)
    kept, dropped = list(score), [-s for s in score]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        kept[p] += max(kept[i], dropped[i])
        dropped[p] += dropped[i]
    keep = [True] * n  # the page itself
    for i in range(1, n):
        keep[i] = keep[parent[i]] and kept[i] > dropped[i]
    return keep


def train(pages: DataFrame, limit: int = PAGES):
    """Boosted trees from the bounded sample of (page_id, html), or None if nothing in it is marked."""
    hashed = pages.where("html is not null").select("html", F.xxhash64("html").alias("_h"))
    # Hashes first, so that tasks send numbers and not pages; then the pages up to the last of them.
    last = hashed.select("_h").distinct().orderBy("_h").limit(limit).agg(F.max("_h")).first()[0]
    rows = hashed.where(F.col("_h") <= F.lit(last)).select("html").distinct().orderBy("html").collect() if last is not None else []
    x, y, rng = [], [], random.Random(11)
    for html in (r.html for r in rows):
        for form in (html, varied(html, rng), varied(html, rng)):
            page = Page(form)
            labels = weak_labels(page)
            if labels is not None:
                x.append(node_features(page)[1:])
                y.append(labels[1:])
    if not x:
        return None
    return boost(np.concatenate(x), np.concatenate(y).astype(float))


def extract_texts(htmls, model):
    """The main text of each html string."""
    pages = [Page(h or "") for h in htmls]
    if model is None:
        return [p.text(weak_labels(p) or [True] * len(p.parent)) for p in pages]
    found = [node_features(p) for p in pages]
    score = np.clip(odds(model, np.concatenate(found)), -20, 20) if found else []
    out, at = [], 0
    for page, f in zip(pages, found):
        out.append(page.text(decode(page.parent, score[at:at + len(f)].tolist())))
        at += len(f)
    return out


def extract(pages: DataFrame, model) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    ship(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = extract_texts(part.column("html").to_pylist(), model)
                yield record_batch(schema, [part.column("page_id"), part.column("url"), texts, [len(t) for t in texts]])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
