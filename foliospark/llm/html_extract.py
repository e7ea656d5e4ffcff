"""Main text of web pages by a tree-structured graphical model.

Each element is a node that is content or not. Its tag, its class and id words,
its text, its links, its place and its neighbours speak for either; potentials
between parent and child carry that along the tree. Sum-product messages, up to the
root and down again, give each node's marginal. The weights are trained from the
labelled pages below. The main text is the text whose element is likelier
content than not.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
#: Elements of raw text: no markup within, and one left open takes the rest of the page.
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
#: Elements of ordinary markup that hold controls, drawings and fallbacks.
SILENT = frozenset("button select svg object template noscript".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BLOCKS = CLOSES_P | frozenset("html body li dt dd tr td th".split())
#: What an opening tag ends, and the elements beyond which it does not look.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "button": ({"button"}, BLOCKS), "select": ({"select"}, BLOCKS)}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|[^<]+|<", re.S)
#: A tag with a quote that is never closed ends at the next ``>``.
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(>|\Z)")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# --- features, fixed values -------------------------------------------------------------------------------------------
TAGS = "html head body div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav aside header footer form a span label".split()
AGAINST = frozenset("ad ads adv advert advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget comment comments reply replies disqus respond discussion footer header masthead cookie cookies consent notice alert popup modal newsletter subscribe subscription share sharing social related recommended more login signup search toolbar pagination pager tags topbar skip legal copyright".split())
FOR = frozenset("article post entry content main story body text articlebody maincontent".split())
#: What a heading, or a short text, of something beside the article begins with.
BESIDE = re.compile(r"\W*(about (us|the author|this site)|advert|all rights|comment|contact|cookie|copyright|follow|leave a|log ?in|menu|more (from|in|on|stories)|most (read|popular)|newsletter|popular|posted|privacy|read (more|next|also)|recent|recommended|related|repl(y|ies)|search|see also|share|sign (in|up)|skip to|sponsored|subscribe|tags?\b|trending|we use|you (may|might) also|©)", re.I)
LENGTHS, LINKED, PARAGRAPHS, SHARES, PLACES = (1, 20, 80, 300), (0.001, 0.3, 0.6), (1, 3), (0.03, 0.15, 0.5), (0.1, 0.8)
WIDTHS = (len(TAGS) + 1, 4, 5, 5, 3, 2, 2, 4, 4, 4, 4, 4)
OFFSETS = [sum(WIDTHS[:i]) for i in range(len(WIDTHS))]
N_FEATURES, GROUPS = sum(WIDTHS), 3  # groups of children: containers, blocks of text, inline


@dataclass
class Node:
    tag: str
    parent: int
    words: frozenset = frozenset()
    length: int = 0
    linked: int = 0
    paragraphs: int = 0
    holds_article: bool = False
    under_article: bool = False
    head: str = ""
    label: int | None = None
    features: list[int] = field(default_factory=list)


@dataclass
class Page:
    """Nodes in page order (parents first) and pieces of text: (node, block, text)."""

    nodes: list[Node]
    pieces: list[tuple[int, int, str]]


class Open(NamedTuple):
    """An element not yet ended: its node, or its parent's if it leaves no trace itself; whether text in it is left out;
    for a silent element the numbers of nodes and pieces before it, and the block it is in.
    """

    tag: str
    node: int
    hidden: bool = False
    before: tuple[int, int, int] | None = None


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def _end(source: str, at: int, *tags: str) -> re.Match | None:
    return re.compile(rf"</({'|'.join(map(re.escape, tags))})\b[^>]*>", re.I).search(source, at)


def parse(source: str) -> Page:
    """The page's tree, tolerant of what is left open or cut off; comments, scripts, styles and controls leave no trace.

    A silent element with an end goes with all it holds. One left open ends with its parent: its own text goes, and that
    of inline and unknown elements in it; block elements in it count as its parent's. What ``object`` and ``iframe``
    show where they do not work is left out too. ``places`` holds where each tag stands in the stack, so the time a tag takes does not grow
    with the elements that are open.
    """
    nodes, pieces, stack, block = [Node("#root", -1)], [], [Open("#root", 0)], 0
    places: dict[str, list[int]] = {}
    silent_at: list[int] = []

    def push(opened: Open) -> None:
        places.setdefault(opened.tag, []).append(len(stack))
        if opened.before:
            silent_at.append(len(stack))
        stack.append(opened)

    def cut(i: int) -> None:
        for gone in stack[i:]:
            places[gone.tag].pop()
            if gone.before:
                silent_at.pop()
        del stack[i:]

    at, n = 0, len(source)
    while at < n and (m := TOKEN.match(source, at)):
        if m[0] == "<":
            m = LOOSE.match(source, at) or m
        at = m.end()
        if m[2] is None:
            if m[0][0] != "<" or m[0] == "<":
                if not stack[-1].hidden:
                    pieces.append((stack[-1].node, block, html.unescape(m[0])))
            elif m[0].startswith("<!--") and not m[0].endswith("-->") and silent_at and (end := _end(source, m.start(), stack[silent_at[-1]].tag)):
                at = end.start()  # a comment left open in a silent element ends with it
            continue
        if not m[4]:  # cut off inside a tag
            break
        tag, slash = m[2].lower(), m[3].rstrip().endswith("/")
        if m[1]:
            i = places[tag][-1] if places.get(tag) else 0
            if tag not in INLINE and not stack[i].hidden:
                block += 1
            if stack[i].before:
                n_nodes, n_pieces, block = stack[i].before
                del nodes[n_nodes:], pieces[n_pieces:]
            if i:
                cut(i)
            continue
        if tag in RAW and not slash:
            inner = stack[silent_at[-1]].tag if silent_at else None
            drawn = inner == "svg" and stack[-1].hidden  # titles of drawings are ordinary markup
            end = None if drawn and tag not in ("script", "style") else _end(source, at, tag, inner or tag)
            if end or not drawn or tag in ("script", "style"):
                at = n if not end else end.end() if end[1].lower() == tag else end.start()
                continue
        if tag == "br" and not stack[-1].hidden:
            pieces.append((stack[-1].node, block, " "))
        if tag in VOID:
            block += tag not in INLINE and not stack[-1].hidden
            continue
        ends, limit = IMPLIED.get(tag, ({"p"} if tag in CLOSES_P else set(), {"table", "td", "th", "article", "section", "div", "body", "li"}))
        i = max((places[t][-1] for t in ends if places.get(t)), default=0)
        if i and i >= max(silent_at[-1:] + [places[t][-1] for t in limit if places.get(t)], default=0):
            cut(i)
        silent = tag in SILENT and not slash
        if silent or stack[-1].hidden and tag not in BLOCKS:
            if not slash:
                push(Open(tag, stack[-1].node, True, (len(nodes), len(pieces), block) if silent else None))
            continue
        if tag not in INLINE:
            block += 1
        attributes = _attributes(m[3]) if m[3].strip(" /") else {}
        words = frozenset(re.findall(r"[a-z]+", " ".join(re.sub(r"([a-z])([A-Z])", r"\1 \2", attributes.get(k, "")) for k in ("class", "id", "role", "itemprop")).lower()))
        node = Node(tag, stack[-1].node, words, label=int(attributes["data-y"]) if attributes.get("data-y", "") in ("0", "1") else None)
        nodes.append(node)
        if not m[3].endswith("/") or tag not in INLINE:
            push(Open(tag, len(nodes) - 1))
    _measure(nodes, pieces)
    return Page(nodes, pieces)


def _bucket(value: float, steps: tuple) -> int:
    return sum(value >= s for s in steps)


def _measure(nodes: list[Node], pieces: list[tuple[int, int, str]]) -> None:
    """Sums from the leaves up, then each node's features."""
    in_link = [False] * len(nodes)
    for i in range(1, len(nodes)):
        in_link[i] = in_link[nodes[i].parent] or nodes[i].tag == "a"
    total, seen = 0, [-1] * len(nodes)
    for i, _, text in pieces:
        size = len(text.strip())
        if seen[i] < 0:
            seen[i] = total
        total += size
        nodes[i].length += size
        nodes[i].linked += size * in_link[i]
        if size and len(nodes[i].head) < 40:
            nodes[i].head += text
    for i in range(len(nodes) - 1, 0, -1):
        own, up = nodes[i], nodes[nodes[i].parent]
        up.length += own.length
        up.linked += own.linked
        up.paragraphs += own.paragraphs + (own.tag == "p" and own.length >= 20)
        up.holds_article |= own.holds_article or own.tag in ("article", "main")
        if seen[i] >= 0 and (seen[own.parent] < 0 or seen[i] <= seen[own.parent]):
            seen[own.parent], up.head = seen[i], own.head  # the text it begins with
    tags = {t: i for i, t in enumerate(TAGS)}
    for i, own in enumerate(nodes[1:], 1):
        up = nodes[own.parent]
        own.under_article = up.under_article or up.tag in ("article", "main")
        against, speaks, of_parent = bool(own.words & AGAINST), bool(own.words & FOR), bool(up.words & AGAINST) + 2 * bool(up.words & FOR)
        others, beside = up.length - own.length, bool(own.length and BESIDE.match(own.head.strip()))
        around = 3 if others <= 0 else _bucket((up.linked - own.linked) / others, LINKED[1:])
        place = 3 if group(own.tag) else _bucket((max(seen[i], 0) + own.length / 2) / max(total, 1), PLACES)
        values = (
            tags.get(own.tag, len(TAGS)), against + 2 * speaks, _bucket(own.length, LENGTHS), 4 if not own.length else _bucket(own.linked / own.length, LINKED),
            _bucket(own.paragraphs, PARAGRAPHS), own.holds_article, own.under_article,
            _bucket(own.length / max(total, 1), SHARES), place, around, beside + 2 * (own.length < 80), of_parent,
        )
        own.features = [o + int(v) for o, v in zip(OFFSETS, values, strict=True)]


def group(tag: str) -> int:
    return 2 if tag in INLINE else 1 if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "dd", "pre", "blockquote", "figcaption", "tr", "ul", "ol", "table") else 0


def _sum(a: float, b: float) -> float:
    """log(e^a + e^b)"""
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def beliefs(nodes: list[Node], weights: list[float], pairs: list[list[list[float]]]) -> tuple[list[float], list[float], list[float]]:
    """Sum-product on the tree, in log odds of content: each node's belief, its own and its children's part of it, and
    its parent's belief without it. The root is never content.
    """
    n = len(nodes)
    low = [0.0] * n  # a node's own potential and the messages from its children
    up = [0.0] * n
    for i in range(1, n):
        low[i] = sum(weights[f] for f in nodes[i].features)
    for i in range(n - 1, 0, -1):
        p = pairs[group(nodes[i].tag)]
        up[i] = _sum(p[1][0], p[1][1] + low[i]) - _sum(p[0][0], p[0][1] + low[i])
        low[nodes[i].parent] += up[i]
    full, rest = [-30.0] * n, [-30.0] * n
    for i in range(1, n):
        p, parent = pairs[group(nodes[i].tag)], nodes[i].parent
        rest[i] = -30.0 if parent == 0 else full[parent] - up[i]
        full[i] = low[i] + _sum(p[0][1], p[1][1] + rest[i]) - _sum(p[0][0], p[1][0] + rest[i])
    return full, low, rest


def _odds(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


#: The labelled pages: data-y tells of an element and what it holds whether it is content.
LABELLED = (
    '<html><head><title>T</title></head><body data-y=0><nav><ul><li><a href=/a>News</a></li><li><a href=/b>Sports</a></li><li><a href=/c>Weather</a></li></ul></nav><div class=ad>Buy the best shoes of the year now.</div><article data-y=1><h1>A bridge for the town</h1><p>The council met on Tuesday to discuss the new bridge across the river and its cost.</p><p><b>Several members</b> asked how the work would be paid for, and when it could begin.<br>No date was set.</p><p>Short.</p></article><footer>&copy; Example Media. All rights reserved by the owner.</footer></body></html>',
    '<body data-y=0><header class=site-header><a href=/>Logo</a><p>The paper of record for the whole valley since 1920.</p></header><main data-y=1><h1>Spring</h1><p>A study shows that plants grow faster in the light of early spring, when days are getting longer.</p><ul><li>First finding of the authors</li><li>Second finding of the authors</li></ul><blockquote>We did not expect this, said the authors of the study on Monday.</blockquote></main><aside class=sidebar data-y=0><h2>Popular</h2><ul><li><a href=1>Ten best gardens of the region</a></li><li><a href=2>How to grow roses in the shade</a></li></ul></aside><section id=comments data-y=0><h3>Comments</h3><div class=comment><p>I do not agree with this article at all, it is quite wrong about plants.</p></div><div class=comment><p>Thank you, this was very helpful to me and my whole family.</p></div></section></body>',
    '<body data-y=0><div id=page><div class=menu><a href=1>Home</a> <a href=2>About</a> <a href=3>Contact</a></div><div class="cookie-notice"><p>We use cookies to make this site better for you. By going on you accept this.</p></div><div class="post-content" data-y=1><h2>Winter at sea</h2><p>The ship left the harbour before dawn, and for two days nobody saw land again at all.</p><p>On the third day <a href=x>the captain</a> called all men on deck to tell them the news.</p><pre>log 12: wind from the north</pre></div><form class=newsletter data-y=0><p>Sign up for our letter and never miss a story from us again.</p><label>Your mail</label></form><div id=footer><p>Imprint and legal notes of the publisher of this site.</p></div></div></body>',
    '<body data-y=0><div class=nav><a href=1>A</a><a href=2>B</a></div><h1 data-y=1>Plain page</h1><p data-y=1>This page has no containers at all, just a heading and some paragraphs of text in the body.</p><p data-y=1>They are content all the same, as a reader would say at once on seeing them.</p><p class=copyright>Copyright by the author, all rights reserved, 2020.</p></body>',
    '<body data-y=0><div class=wrapper><article data-y=1><header data-y=0><p>By a reporter, published on the fifth of May, five minutes to read</p></header><h1>Two rivers</h1><p>Both rivers rise in the same hills, but one flows north and the other one south to the sea.</p><table><tr><th>River</th><th>Length</th></tr><tr><td>North</td><td>310 km</td></tr></table><div class=advert data-y=0><p>Advertisement: visit our shop for the best maps of both rivers.</p></div><p>At their mouths stand two towns that trade with each other since the Middle Ages.</p><div class="share-buttons" data-y=0><a href=1>Share</a> <a href=2>Send</a></div><footer data-y=0><p>Filed under rivers, last changed on Friday by the editor.</p></footer></article><div class=related-posts><h3>Read more</h3><p><a href=1>The long way to the source of the river</a></p><p><a href=2>Why the mill was closed in the end</a></p></div></div></body>',
    '<body data-y=0><div role=navigation><ul><li><a href=1>Start</a></li><li><a href=2>Archive</a></li></ul></div><div id=content data-y=1><h1>On bread</h1><p>Flour, water, salt and time are all it takes to bake a loaf that keeps for a week.</p><ol><li>Mix the flour and the water.</li><li>Wait for an hour, then add the salt.</li></ol><dl><dt>Flour</dt><dd>500 g of wheat</dd></dl><section><h2>Baking</h2><p>Heat the oven well before the loaf goes in, and do not open it too early.</p></section></div><div class=widget data-y=0><p>Vote for the best bread of the year in our survey, it takes a minute.</p></div><div id=disqus_thread data-y=0><p>Join the discussion with other readers of this page below.</p></div></body>',
    '<body data-y=0><nav><a href=1>X</a><a href=2>Y</a></nav><article data-y=1><h1>Kurz</h1><p>Kurz.</p></article><footer>&copy; y</footer></body>',
    '<body data-y=0><nav><ul><li><a href=1>X</a></li></ul></nav><div class=ad>Kurz und gut, kauft mehr davon.</div><article data-y=1><h1>Lang</h1><p><b>Lang <p>Ein Absatz nach dem anderen, ohne dass einer davon geschlossen wird, wie es oft vorkommt.<p>Noch einer <i>mit</i> <a href=q>Verweis</a>.</article><footer>&copy; z &middot; Nur ein kurzer Satz.</footer></body>',
    '<body data-y=0><form action=/><div class=topbar><a href=1>Login</a></div><div class=story data-y=1><h1>In a form</h1><p>Some systems wrap the whole page in a form, so that the form alone says little about what it holds.</p><p>The text in it is content here, as anyone can see.</p><figure><figcaption>A view of the valley from the east</figcaption></figure></div></form></body>',
    '<body data-y=0><p data-y=1>A page may well be just one short paragraph and no more.</p></body>',
    '<html><body data-y=0><div data-y=1>Nothing but a line of text here.</div></body></html>',
    '<body data-y=0><h1 data-y=1>Note</h1><p data-y=1>One line, then the end of it.</p></body>',
    '<body data-y=0><div id=wrap><div class=c1><a href=1>Start</a> | <a href=2>Topics</a> | <a href=3>Help</a></div><div class=c2 data-y=1><h1>The old mill</h1><p>For three hundred years the mill stood by the brook, and its wheel turned day and night.</p><p>Then came the dry summer of the year in which the miller died, and it stood still.</p><p>Nobody has lived there since, though some say they hear the wheel at night.</p></div><div class=c3><h3>About us</h3><p>We are a small team of friends who write on old houses in our spare time.</p><h3>Popular</h3><ul><li><a href=4>Ten castles to see this year</a></li><li><a href=5>Why thatched roofs last</a></li></ul></div></div></body>',
    '<body data-y=0><table><tr><td><a href=1>Index</a><br><a href=2>Next</a></td><td data-y=1><h2>Of clocks</h2><p>The first clocks had one hand, as nobody asked for minutes in those days.</p><p>Towers told the hour to a whole town, and the town lived by it.</p></td></tr></table><p>Copyright by the keeper of this page, who may be reached by mail.</p></body>',
    '<body data-y=0><main data-y=1><article><h1>Harbour news</h1><p>The new quay will open in June, the harbour office said on Friday, after two years of work.</p><section class=related data-y=0><h2>Related</h2><p><a href=1>Old quay to be torn down</a></p><p>All our stories on the harbour in one place, from the beginning until today.</p></section><p>Ferries to the islands will then leave from there every hour, even in winter.</p><section class=comments data-y=0><h2>2 comments</h2><div><b>Ann</b><p>At last! We have waited for this for years and years.</p></div><div><b>Bob</b><p>Who pays for all of it, I should like to know.</p></div></section></article></main></body>',
    '<body data-y=0><header><h1>The Daily Leaf</h1><p>All the news that fits on a leaf</p></header><div class=layout><section class=left><h4>Most read</h4><ol><li><a href=1>Rain at last</a></li><li><a href=2>Mayor steps down</a></li></ol></section><section class=center data-y=1><h2>Frost in May</h2><p>Wine growers in the valley fear for their crop after three nights of frost in a row.</p><figure><img src=x><figcaption>Candles burn between the vines</figcaption></figure><p>Some lit hundreds of candles between the vines, others had helicopters stir the air.</p><p>The damage will be known in a week.</p></section></div><p>We use cookies. By reading on you accept them all.</p></body>',
    '<body data-y=0><div><div><span><a href=1>en</a> <a href=2>de</a> <a href=3>fr</a></span></div><div data-y=1><h1>Installing</h1><p>Unpack the archive and run the script in it.</p><pre>tar xf tool.tar\n./setup</pre><h2>Options</h2><dl><dt>prefix</dt><dd>where to put the files</dd><dt>quiet</dt><dd>say nothing unless it fails</dd></dl><p>See <a href=4>the manual</a> for the rest of them.</p></div><div><a href=5>Edit this page</a> <a href=6>Report an error</a></div></div></body>',
    '<body data-y=0><div class=top><p>Breaking: storm warning for the whole coast until midnight, stay at home.</p></div><div class=entry data-y=1><h1>Soup for ten</h1><p>It takes an hour, and most of that hour the pot looks after itself.</p><ul><li>2 kg of potatoes</li><li>1 leek</li><li>salt</li></ul><ol><li>Peel and cut.</li><li>Boil.</li><li>Serve hot.</li></ol></div><div class=signup><p>Get a recipe by mail every Friday, for free, and leave when you like.</p></div><div class=replies><h3>Leave a reply</h3><p>Your address will not be shown to anyone.</p></div></body>',
    '<body data-y=0><nav><a href=1>Home</a></nav><div role=main data-y=1><h1>Minutes</h1><p>Present: all. Absent: none.</p><p>1. The budget was passed.</p><p>2. The roof will be mended in spring.</p><blockquote>I thank you all, said the chair.</blockquote><aside data-y=0><p>Advertisement: roofs mended cheaply by the brothers down the road.</p></aside><p>3. Next meeting in May.</p></div><div><p>Share this page with your friends and neighbours.</p></div><footer><p>Contact | Imprint</p></footer></body>',
    '<body data-y=0><nav><ul><li><a href=1>Politics</a></li><li><a href=2>Economy</a></li><li><a href=3>Opinion</a></li><li><a href=4>Culture</a></li></ul></nav><div class=ad>Two for one, only this week, in all our shops.</div><article data-y=1><h1>Closed today</h1><p><b>We are closed today.<br></article><footer>&copy; Corner Shop &middot; Open from nine to five on all working days.</footer></body>',
    '<body data-y=0><nav><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></nav><article data-y=1><h1>No news</h1><p><b>There is nothing to report.</article><div class=ad>Cheap flights to the sun, book before Sunday.</div><footer>All rights reserved, and so on.</footer></body>',
    '<body data-y=0><nav><ul><li><a href=1>Markets</a></li></ul></nav><article data-y=1><h1>Markets</h1><p>Share prices fell on Monday for the third day in a row.</p><p>Related costs rose.</p><p>Search parties set out for the lost balloon of the bank.</p><p>Contact with it was lost at noon.</p><p><b>All rights were sold.<br></p></article><footer>&copy; The Ticker &middot; Prices are late by an hour.</footer></body>',
    '<body data-y=0><nav><ul><li><a href=1>Start</a></li><li><a href=2>Shop</a></li></ul></nav><div class=ad>New: shoes.</div><article data-y=1><h1>Hi.</h1><p><b>Hi.<br></article><footer>&copy; Little Page &middot; Made with love and a great deal of tea, on a hill far away from all towns. Write to us whenever you like.</footer></body>',
    '<body data-y=0><nav><a href=1>Start</a></nav><article data-y=1><h1>Test</h1><p>Test.</p></article><footer>This page is kept by a club of walkers, who meet on every first Sunday of the month at the old station. Guests are welcome.</footer></body>',
)


@lru_cache(maxsize=1)
def model(rounds: int = 120, rate: float = 0.15, decay: float = 0.03) -> tuple[list[float], list[list[list[float]]]]:
    """Weights and pair potentials fitted to LABELLED by gradient steps on the conditional likelihood. Deterministic."""
    trees = [parse(p).nodes for p in LABELLED]
    for nodes in trees:
        nodes[0].label = 0
        for own in nodes[1:]:
            own.label = nodes[own.parent].label if own.label is None else own.label
    w, pairs = np.zeros(N_FEATURES), np.zeros((GROUPS, 2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pairs), np.zeros_like(pairs)]
    for r in range(1, rounds + 1):
        gw, gp = -decay * w, -decay * pairs
        lists = w.tolist(), pairs.tolist()
        for nodes in trees:
            full, low, rest = beliefs(nodes, *lists)
            for i in range(1, len(nodes)):
                own, g = nodes[i], group(nodes[i].tag)
                gw[own.features] += own.label - _odds(full[i])
                joint = np.array([[lists[1][g][a][b] + a * rest[i] + b * low[i] for b in (0, 1)] for a in (0, 1)])
                joint = np.exp(joint - joint.max())
                gp[g] -= joint / joint.sum()
                gp[g, nodes[own.parent].label, own.label] += 1
        for k, (p, g) in enumerate(((w, gw), (pairs, gp))):
            mean, square = state[2 * k], state[2 * k + 1]
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            p += rate * (mean / (1 - 0.9**r)) / (np.sqrt(square / (1 - 0.99**r)) + 1e-8)
    return w.tolist(), pairs.tolist()


def main_text(source: str | None, fitted: tuple[list[float], list[list[list[float]]]]) -> str:
    """Blocks of content text in page order, white space in a block as one space, joined by newlines."""
    page = parse(source or "")
    if not page.pieces:
        return ""
    full, _, _ = beliefs(page.nodes, *fitted)
    blocks: dict[int, list[str]] = {}
    for i, block, text in page.pieces:
        if full[i] > 0:
            blocks.setdefault(block, []).append(text)
    joined = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(b for b in joined if b)


def extract(df: DataFrame, source: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``text``, the page's main text (empty if none), and ``n_chars``, its code points.

    A null page is empty. Repeated rows give a row each, an empty table none. Kept columns named ``text`` or ``n_chars`` are
    replaced. Pages are read whole, however long, in time that grows with their length; a task holds one page's tree at a
    time. Text whose element is as likely content as not is left out. The model is fitted once, on the driver.
    """
    names = [c for c in keep if c not in ("text", "n_chars")]
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{source}`").alias("__html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    fitted = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), fitted) for x in batch.column("__html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)
