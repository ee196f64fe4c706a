"""Main text of web pages: boosted trees over DOM nodes, and a decoding that keeps the tree consistent.

A page becomes a tree of elements (and runs of text beside block elements). Each node has features:
text, links, punctuation and elements of its subtree, depth, place and size among its siblings, and
hashed tokens of its tag, class, id and role. The trees give each node a chance of leading to main
text. A node that is dropped drops its subtree; a node that is kept may drop children. Of all such
choices the most likely one is found from the leaves up.

The trees are fitted on a bounded sample of pages. Their paragraphs and short texts are laid out anew
in random page plans, with known labels, with or without telling tags and attributes; pages with one
article or main element give labels of their own.

Edge cases: a null, empty or markup-free page is its own text or an empty one; unclosed, misnested and
truncated markup is repaired in part, and a quote that is never closed ends with its tag; pages of
any length are read whole, forward only; character references are decoded once; repeated rows are
extracted each on their own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm import boosting

SAMPLE_PAGES = 300
PLANS = 500
BUCKETS = 96
SEED = 3

# How HTML groups its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("script style template noscript head title svg iframe object canvas select textarea".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr input button "
    "math semantics annotation mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts none mtable mtr mtd mstyle mpadded mphantom mfenced menclose merror".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
BARRIER = frozenset("html body table td th caption article aside section main div nav header footer form".split())
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
MARK = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
PLAIN = re.compile(r"((?:\s++[a-zA-Z-]++(?:=\"[^\"<>]*+\")?+)*+)\s*+/?>")  # what most tags hold after their name
SKIP = re.compile(r"[\s/]*+")
ATTRIBUTE = re.compile(r"(=?[^\s/>=]*+)(\s*+=\s*+)?+")
VALUE = re.compile(r"[^\s>]*+")
NAMED = re.compile(r"(class|id|role)=(\"[^\"]*\")", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
STOP = re.compile(r"[.!?,;:]")


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "parts", "index")

    def __init__(self, tag: str, tokens: tuple[str, ...], parent):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.children: list[Node] = []
        self.parts: list = []  # texts and nodes in page order
        if parent is not None:
            parent.children.append(self)
            parent.parts.append(self)


def attributes(page: str, at: int, unclosed: set[str]) -> tuple[int, list[str]]:
    """Where the tag ends whose name ends at ``at``, and the values of its telling attributes.

    Reads forward only. A quote that is never closed does not hide the rest of the page: its value ends
    like one without quotes. ``unclosed`` holds the quotes known not to come again.
    """
    if plain := PLAIN.match(page, at):
        return plain.end(), [m[2] for m in NAMED.finditer(plain[1])] if plain[1] else []
    told = []
    while True:
        at = SKIP.match(page, at).end()
        if at >= len(page) or page[at] == ">":
            return min(at + 1, len(page)), told
        own = ATTRIBUTE.match(page, at)
        at = own.end()
        if not own[2]:
            continue
        begin, quote, close = at, page[at : at + 1], -1
        if quote in ('"', "'") and quote not in unclosed:
            close = page.find(quote, at + 1)
            if close < 0:
                unclosed.add(quote)
        at = close + 1 if close >= 0 else VALUE.match(page, at).end()
        if own[1].lower() in ("class", "id", "role"):
            told.append(page[begin:at])


class Open:
    """The open elements, and where those of each tag stand among them."""

    def __init__(self, root: "Node"):
        self.stack, self.where = [root], defaultdict(list)

    def push(self, node: "Node") -> None:
        self.where[node.tag].append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.where[self.stack.pop().tag].pop()

    def last(self, tags) -> int:
        """The place of the last open element of these tags; 0 if there is none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def close(self, tags) -> None:
        """Close the last of these tags unless a barrier or a list stands above it."""
        at = self.last(tags)
        if at and at >= self.last(BARRIER) and (at > self.last(("ul", "ol", "dl"))):
            self.cut(at)


def parse(page: str) -> Node:
    root = Node("#root", (), None)
    open_, at, unclosed = Open(root), 0, set()
    while mark := MARK.search(page, at):
        begin = mark.start()
        if begin > at:
            open_.stack[-1].parts.append(page[at:begin])
        tag = TAG.match(page, begin)
        if tag is None:
            at = OTHER.match(page, begin).end()
            continue
        at, told = attributes(page, tag.end(), unclosed)
        name = tag[2].lower()
        if tag[1]:
            own = open_.last((name,))
            if own and (name not in INLINE or own > open_.last(BARRIER)):
                open_.cut(own)
            continue
        if name in CLOSES_P:
            open_.close(("p",))
        if name in SIBLINGS:
            open_.close(SIBLINGS[name])
        tokens = tuple(w.lower() for value in told for w in WORD.findall(value))
        node = Node(name, tokens, open_.stack[-1])
        if name in VOID or page[at - 2 : at] == "/>" and name not in INLINE | CLOSES_P:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            stop = end.start() if end else len(page)
            node.parts.append(page[at:stop])
            at = end.end() if end else len(page)
            continue
        open_.push(node)
    if at < len(page):
        open_.stack[-1].parts.append(page[at:])
    return root


def listed(root: Node) -> list[Node]:
    """Nodes that can be kept, parents first. Text beside block elements becomes a node of its own."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.index = len(out)
        out.append(node)
        blocks = any(c.tag not in INLINE for c in node.children)
        if blocks:
            parts, node.parts, node.children = node.parts, [], []
            run: Node | None = None
            for p in parts:
                inline = isinstance(p, str) or p.tag in INLINE
                if not inline:
                    run = None
                    node.parts.append(p)
                    node.children.append(p)
                elif run is not None or not isinstance(p, str) or p.strip():
                    if run is None:
                        run = Node("#text", (), node)
                    run.parts.append(p)
                    if not isinstance(p, str):
                        p.parent = run
                        run.children.append(p)
        node.children = [c for c in node.children if c.tag not in NEVER]
        node.parts = [p for p in node.parts if isinstance(p, str) or p.tag not in NEVER]
        todo.extend(reversed(node.children))
    return out


KIND = {
    t: i
    for i, group in enumerate(
        ("#text", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "a", "div section", "article main",
         "nav header footer aside", "form button input label", "table tr td th tbody", "blockquote pre figure", "span b i em strong")
    )
    for t in group.split()
}
STATS = 24


def features(nodes: list[Node]) -> np.ndarray:
    """(nodes, STATS + BUCKETS)"""
    n = len(nodes)
    text, links, stops, words, count, anchors, paras, depth = (np.zeros(n) for _ in range(8))
    place, brothers, alike = np.zeros(n), np.ones(n), np.ones(n)
    hashed = np.zeros((n, BUCKETS), np.float32)
    kind = np.full(n, len(KIND) + 1.0)
    for node in nodes:
        i = node.index
        own = "".join(p for p in node.parts if isinstance(p, str))
        if own:
            w = own.split()
            text[i] = sum(map(len, w))
            words[i] = len(w)
            stops[i] = len(STOP.findall(own))
        count[i] = 1
        kind[i] = KIND.get(node.tag, len(KIND))
        if node.tag == "a":
            anchors[i], links[i] = 1, text[i]
        elif node.tag == "p":
            paras[i] = 1
        for t in (f"<{node.tag}>", *node.tokens):
            hashed[i, zlib.crc32(t.encode()) % BUCKETS] = 1
        tags = Counter(c.tag for c in node.children)
        for k, c in enumerate(node.children):
            j = c.index
            depth[j], place[j], brothers[j], alike[j] = depth[i] + 1, k, len(node.children), tags[c.tag]
    for node in reversed(nodes):
        i = node.index
        if node.parent is not None:
            p = node.parent.index
            for a in (text, stops, words, count, anchors, paras):
                a[p] += a[i]
            links[p] += links[i]
        if node.tag == "a":
            links[i] = text[i]
    up = np.array([max(0, x.parent.index) if x.parent is not None else 0 for x in nodes])
    order = np.arange(n) / max(1, n)
    one = lambda a, b: a / np.maximum(b, 1)
    stats = np.stack([
        np.log1p(text), one(links, text), one(stops, words), np.log1p(words), np.log1p(count), one(text, count),
        one(anchors, count), np.log1p(paras), depth, place, brothers, one(place, brothers), alike, one(text, text[up]),
        np.log1p(text[up]), one(links[up], text[up]), kind, kind[up], order, one(text, text[0]), one(words, paras),
        one(text, words), one(stops[up], words[up]), np.log1p(paras[up]),
    ], axis=1)
    return np.concatenate([stats.astype(np.float32), hashed], axis=1)


def decides(node: Node) -> bool:
    """Inline elements without blocks go with the element around them."""
    return node.tag not in INLINE or any(c.tag not in INLINE for c in node.children)


def decode(nodes: list[Node], chance: np.ndarray) -> np.ndarray:
    """Kept nodes of the most likely consistent choice; the root is kept."""
    free = np.array([decides(n) for n in nodes])
    p = np.where(free, np.clip(chance, 1e-4, 1 - 1e-4), 0.5)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    inside, outside = yes[:], no[:]
    for node in reversed(nodes):
        i = node.index
        for c in node.children:
            inside[i] += max(inside[c.index], outside[c.index])
            outside[i] += outside[c.index]
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for node in nodes[1:]:
        i = node.index
        top = node.tag in ("html", "body")
        keep[i] = keep[node.parent.index] and (top or not free[i] or inside[i] >= outside[i])
    return keep


def kept_text(nodes: list[Node], keep: np.ndarray) -> str:
    blocks, run = [], []

    def close():
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            blocks.append(text)
        run.clear()

    todo: list = [nodes[0]]
    while todo:
        node = todo.pop()
        if node is None:
            close()
        elif isinstance(node, str):
            run.append(node)
        elif keep[node.index]:
            block = node.tag not in INLINE
            if node.tag in ("br", "img", "input"):
                run.append(" ")
            if block:
                close()
                todo.append(None)
            todo.extend(reversed(node.parts))
    close()
    return "\n".join(blocks)


def extract(pages: list[str | None], model: boosting.Trees | None) -> list[str]:
    trees = [listed(parse(p or "")) for p in pages]
    if not trees:
        return []
    if model is None:
        return [kept_text(t, np.ones(len(t), bool)) for t in trees]
    chance = model.chance(np.concatenate([features(t) for t in trees]))
    out, at = [], 0
    for t in trees:
        out.append(kept_text(t, decode(t, chance[at : at + len(t)])))
        at += len(t)
    return out


# Words that page plans use for tags and attributes, by the part of a page they name.
NAMES = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs tabs sitenav links",
    "header": "header masthead branding logo banner site top",
    "footer": "footer copyright bottom legal colophon foot",
    "side": "sidebar aside widget related recent popular archive tags side rail more",
    "notice": "cookie notice consent alert gdpr popup modal banner message",
    "ad": "ad ads advert advertisement sponsored promo sponsor adsense commercial banner",
    "form": "form search newsletter subscribe signup login contact",
    "comments": "comments comment commentlist replies discussion disqus responses thread",
    "share": "share social sharing follow buttons tools",
    "main": "content article post entry main body story text page blog hentry articlebody postcontent",
}
TAGS = {
    "menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "side": ("aside", "div"),
    "notice": ("div", "section"), "ad": ("div", "aside"), "form": ("form",), "comments": ("section", "div", "ol"),
    "share": ("div", "ul"), "main": ("article", "main", "div", "section"),
}


def page_plan(rng: random.Random, long: list[str], short: list[str]) -> str:
    """A page of given texts; parts that are not main text carry the attribute data-out."""

    def attrs(part: str) -> str:
        if rng.random() < 0.12:
            return ""
        names = rng.choice(NAMES[part].split())
        if rng.random() < 0.3:
            names += rng.choice(["-", "_", " "]) + rng.choice(["wrap", "box", "inner", "area", "list", "block", "item"])
        return f' {rng.choice(["class", "id", "class"])}="{names}"'

    def para() -> str:
        return html.escape(rng.choice(long), quote=False)

    def bit() -> str:
        return html.escape(rng.choice(short), quote=False)

    def link_list() -> str:
        return "<ul>" + "".join(f'<li><a href="#">{bit()}</a></li>' for _ in range(rng.randint(2, 9))) + "</ul>"

    def out(part: str) -> str:
        tag = rng.choice(TAGS[part])
        if part == "form":
            inside = f"<label>{bit()}</label><input name=q><button>{bit()}</button>" + f"<p>{bit()}</p>" * rng.randint(0, 1)
        elif part == "comments":
            inside = "".join(
                f'<div{attrs("comments")}><span>{bit()}</span><p>{para()}</p></div>' for _ in range(rng.randint(1, 5))
            )
        elif part in ("ad", "notice", "footer", "header"):
            inside = rng.choice([
                lambda: f"<p>{bit()} {bit()}</p>", lambda: f"{bit()} {bit()}", lambda: f"&copy; {bit()} &middot; {bit()}.",
                lambda: f'<a href="#">{bit()}</a> {bit()}', lambda: f"{para()}", link_list, lambda: f"<h2>{bit()}</h2><p>{bit()}</p>",
            ])()
        else:
            inside = rng.choice([
                link_list, lambda: f"<h3>{bit()}</h3>{link_list()}", lambda: "".join(f'<a href="#">{bit()}</a> ' for _ in range(rng.randint(2, 7))),
            ])()
        return f'<{tag}{attrs(part)} data-out>{inside}</{tag}>'

    def body_block() -> str:
        kind = rng.random()
        if kind < 0.72:
            return f"<p>{para()}</p>"
        if kind < 0.8:
            return f"<h{(n := rng.randint(2, 4))}>{bit()}</h{n}><p>{para()}</p>"
        if kind < 0.87:
            return "<ul>" + "".join(f"<li>{rng.choice([para, bit])()}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote><p>{para()}</p></blockquote>"
        if kind < 0.96:
            return f"<p><b>{para()}</b><br><p>{para()} <a href='#'>{bit()}</a></p>"
        return f"<table><tr><td>{bit()}</td><td>{para()}</td></tr></table>"

    blocks = [body_block() for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9]))]
    title = f"<h1>{bit()}</h1>" if rng.random() < 0.8 else ""
    if not blocks and rng.random() < 0.7:
        blocks = [f"<p><b>{rng.choice([para, bit])()}<br>"]
    for part in ("ad", "share", "side", "form", "comments", "notice"):
        if rng.random() < 0.12:
            blocks.insert(rng.randint(0, len(blocks)), out(part))
    tag = rng.choice(TAGS["main"])
    if rng.random() < 0.4:
        tag = "article"
    main = f"<{tag}{attrs('main')}>{title}{''.join(blocks)}</{tag}>"
    if rng.random() < 0.3:
        main = f"<div{attrs('main')}>{main}</div>"
    before = [out(p) for p in ("header", "menu", "notice", "ad", "menu", "form") if rng.random() < 0.45]
    after = [out(p) for p in ("share", "side", "comments", "ad", "side", "form", "notice", "footer") if rng.random() < 0.4]
    rng.shuffle(before)
    page = "".join(before) + main + "".join(after)
    if rng.random() < 0.25:
        page = f"<div>{page}</div>"
    return f"<html><body>{page}</body></html>"


OUT = re.compile(r" data-out")


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a page plan's nodes with text."""
    marks = parse(OUT.sub(' role="dataout"', page))
    marked = listed(marks)
    bad = np.zeros(len(marked), bool)
    for node in marked:
        parent = bad[node.parent.index] if node.parent is not None else False
        bad[node.index] = parent or "dataout" in node.tokens
    plain = listed(parse(OUT.sub("", page)))
    return _usable(plain, features(plain), ~bad)


def _usable(nodes: list[Node], x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # A node leads to main text if it is not inside a dropped part and holds some that is not.
    leads = np.zeros(len(nodes), bool)
    for node in reversed(nodes):
        own = any(isinstance(p, str) and p.strip() for p in node.parts)
        leads[node.index] = good[node.index] and (own or any(leads[c.index] for c in node.children))
    some = (x[:, 0] > 0) & np.array([decides(n) for n in nodes])
    return x[some], leads[some].astype(float)


def self_labelled(page: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Labels from a page's own single article or main element."""
    nodes = listed(parse(page))
    mains = [n for n in nodes if n.tag in ("article", "main")]
    if len(mains) != 1:
        return None
    good, leads = np.zeros(len(nodes), bool), set()
    up = mains[0]
    while up is not None:
        leads.add(up.index)
        up = up.parent
    for node in nodes:
        inside = node.parent is not None and good[node.parent.index] and (
            node.parent.index >= mains[0].index
        ) and node.tag not in ("nav", "aside", "footer", "form")
        good[node.index] = node.index in leads or inside
    return _usable(nodes, features(nodes), good)


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, plans: int = PLANS, seed: int = SEED) -> boosting.Trees | None:
    """Fit the trees on about ``sample_pages`` pages of at most 100,000 characters, chosen by hash."""
    usable = pages.where(F.col("html").isNotNull() & (F.length("html") <= 100_000))
    share = min(1.0, sample_pages / max(1, pages.count()))
    pick = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = [r["html"] for r in usable.where(pick).orderBy("page_id", "url").select("html").collect()]
    return train(rows, plans, seed)


def train(rows: list[str], plans: int = PLANS, seed: int = SEED) -> boosting.Trees | None:
    rng, long, short, made = random.Random(seed), [], [], []
    for page in rows:
        nodes = listed(parse(page))
        for node in nodes:
            text = " ".join(html.unescape("".join(p for p in node.parts if isinstance(p, str))).split())
            if text:
                (long if len(text) >= 80 else short).append(text)
        if (own := self_labelled(page)) is not None:
            made.append(own)
    if not long and not short:
        return None
    long, short = long or short, short or [t[:40] for t in long]
    # Long texts also give short ones, so that length alone does not tell the parts apart.
    short += [" ".join(t.split()[: rng.randint(1, 8)]) for t in long]
    made += [labelled(page_plan(rng, long, short)) for _ in range(plans)]
    x, y = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
    return boosting.fit(x, y)


def main_text(pages: DataFrame, model: boosting.Trees | None = None, **bounds) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    own = model or fit(pages, **bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = extract(part.column(2).to_pylist(), own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
