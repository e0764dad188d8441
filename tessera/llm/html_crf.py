"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes the sequence of its leaf blocks (runs of text between block-level tags). A block's own
potential sums weights of its ancestors' tags, of the words in their class, id and role, and of its text's shape; the edge
potential depends on whether neighbouring blocks share their parent. Weights maximise the likelihood of
labelled pages, which are made from templates here; Viterbi decoding gives each block main or other.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

#: Element kinds of HTML.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video title select textarea datalist".split())
#: Their content is text up to the end tag.
RAW = frozenset("script style noscript iframe title textarea".split())
#: All that a head can hold; any other start tag ends an open head.
IN_HEAD = frozenset("html head base basefont bgsound link meta title script style noscript template".split())
#: A start tag of the key ends an open element of the values, up to one of SCOPE.
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())

#: Elements that begin a block; all others are part of the line that they stand in.
BLOCK = ENDS_P | HIDDEN | frozenset("html head body li dt dd tr td th thead tbody tfoot caption legend summary option button menuitem".split())

#: A quoted value ends where a blank, a slash or the tag's end follows its closing quote; any other quote is a plain character.
TOKEN = re.compile(r"<!--|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|[\"'])*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z]+")


class Path:
    """The ancestors of a block by what its potentials see of them: the set of tags and cues, the nearest kind, and the
    innermost tag. A path is made from its parent's, so depth costs nothing and is not bounded."""

    __slots__ = ("seen", "nearest", "features")

    def __init__(self, seen: frozenset[str], nearest: str | None, leaf: str):
        self.seen, self.nearest = seen, nearest
        held = {"held"} if seen & {"in:article", "in:main", "cue:content"} else set()
        self.features = sorted({"bias", f"near:{nearest}", f"leaf:{leaf}"} | seen | held)


class Paths:
    """The paths met so far. Dropping them when they are many costs time only."""

    REMEMBERED = 20_000

    def __init__(self):
        self.known: dict[tuple, Path] = {}
        self.inner: dict[tuple[Path, str, str], Path] = {}
        self.root = Path(frozenset(), None, "other")

    def child(self, above: Path, tag: str, words: str) -> Path:
        own = self.inner.get((above, tag, words))
        if own is None:
            cues = sorted({CUE_OF[w] for w in words.split() if w in CUE_OF})
            seen = above.seen | {f"cue:{c}" for c in cues} | ({f"in:{tag}"} if tag in TAGS else set())
            key = (seen, cues[-1] if cues else KIND.get(tag, above.nearest), tag if tag in TAGS else "other")
            if key not in self.known:
                self.known[key] = Path(*key)
            own = self.inner[above, tag, words] = self.known[key]
        return own


@dataclass(slots=True)
class Block:
    """A leaf block: its ancestors, its parent's number, its text, and the characters of it inside links."""

    path: Path
    parent: int
    text: str
    linked: int


@dataclass(slots=True)
class _State:
    """Open block elements as (tag, path, number, hides), the pieces of the block in work, and the blocks done."""

    paths: Paths
    stack: list[tuple[str, Path, int, bool]] = field(default_factory=list)
    open_tags: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    hidden: int = 0
    #: Depth at which the open link began, or -1.
    link: int = -1

    def text(self, raw: str) -> None:
        if raw and not self.hidden:
            plain = html.unescape(raw) if "&" in raw else raw
            self.parts.append(plain)
            if self.link >= 0:
                self.linked.append(plain)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                linked = len(" ".join("".join(self.linked).split()))
                self.blocks.append(Block(self.stack[-1][1] if self.stack else self.paths.root, self.stack[-2][2] if len(self.stack) > 1 else 0, text, linked))
            self.parts.clear()
            self.linked.clear()

    def open(self, tag: str, words: str, number: int, hides: bool) -> None:
        self.flush()
        above = self.stack[-1][1] if self.stack else self.paths.root
        self.stack.append((tag, self.paths.child(above, tag, words), number, hides))
        self.open_tags[tag] += 1
        self.hidden += hides

    def close(self, at: int) -> None:
        self.flush()
        for tag, _, _, hides in self.stack[at:]:
            self.open_tags[tag] -= 1
            self.hidden -= hides
        del self.stack[at:]
        if self.link > at:
            self.link = -1

    def end_implied(self, tag: str) -> None:
        """Closes what a start tag of this kind ends without an end tag."""
        if tag not in IN_HEAD and self.stack and self.stack[-1][0] == "head":
            self.close(len(self.stack) - 1)
        if tag in ENDS_P and self.stack and self.stack[-1][0] == "p":
            self.close(len(self.stack) - 1)
        elif tag in ENDS and any(self.open_tags[t] for t in ENDS[tag]):
            at = first = len(self.stack)
            while at and self.stack[at - 1][0] not in SCOPE[tag]:
                at -= 1
                first = at if self.stack[at][0] in ENDS[tag] else first
            if first < len(self.stack):
                self.close(first)


#: Start and end of a tag, its name, its attributes, and whether it is an end tag.
Tag = tuple[int, int, str, str, bool]


def tags_of(page: str) -> list[Tag]:
    """The tags of a page in order; comments and contents of RAW elements are left out, as one tag without a name. What
    is never closed hides no more than itself: such a comment runs to the next >, such a RAW element to the next tag."""
    found: list[Tag] = []
    end, unclosed = 0, set()
    while m := TOKEN.search(page, end):
        end = m.end()
        tag = (m[2] or "").lower()
        if m[0] == "<!--":
            close = -1 if "!" in unclosed else page.find("-->", end)
            if close < 0:
                unclosed.add("!")
                close = page.find(">", end)
                end = close + 1 if close >= 0 else len(page)
            else:
                end = close + 3
        elif tag in RAW and not m[1]:
            close = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, end)
            if close:
                end = close.end()
            else:
                unclosed.add(tag)
                after = TOKEN.search(page, end)
                end = after.start() if after else len(page)
        found.append((m.start(), end, tag, m[3] or "", bool(m[1])))
    return found


def closed(tags: list[Tag]) -> set[int]:
    """The places of start tags of HIDDEN elements that an end tag closes; all others hide nothing."""
    waiting: dict[str, list[int]] = {}
    found = set()
    for i, (_, _, tag, attributes, ends) in enumerate(tags):
        if tag in HIDDEN and tag not in RAW:
            if not ends and not attributes.endswith("/"):
                waiting.setdefault(tag, []).append(i)
            elif ends and waiting.get(tag):
                found.add(waiting[tag].pop())
    return found


def leaf_blocks(page: str, paths: Paths | None = None) -> list[Block]:
    """The blocks in page order. End tags that the source leaves out are supplied as browsers do; white space in a
    block is one space; contents of HIDDEN elements and comments are no text."""
    state = _State(paths or Paths())
    tags = tags_of(page)
    hides = closed(tags)
    at = number = 0
    for i, (start, end, tag, attributes, ends) in enumerate(tags):
        state.text(page[at:start])
        at = end
        if tag == "a":
            state.link = -1 if ends else len(state.stack)
        elif tag == "br":
            state.text(" ")
        elif tag == "hr":
            state.end_implied(tag)
            state.flush()
        elif tag not in BLOCK:
            continue
        elif ends:
            if state.open_tags[tag]:
                depth = len(state.stack) - 1
                while state.stack[depth][0] != tag:
                    depth -= 1
                state.close(depth)
            elif tag == "p":
                state.flush()
        elif tag in RAW or (tag in HIDDEN and i not in hides):
            state.flush()
        else:
            state.end_implied(tag)
            number += 1
            words = dict.fromkeys(w for n in NAMED.finditer(attributes) for w in PART.findall((n[2] or n[3] or n[4] or "").lower())) if attributes else ()
            state.open(tag, " ".join(words), number, tag in HIDDEN)
    state.text(page[at:])
    state.flush()
    return state.blocks


#: Words of class, id and role by what they tell.
CUES = {
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted adbox adslot dfp",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager tabs toc skip",
    "header": "header masthead topbar top banner branding logo site",
    "footer": "footer foot bottom colophon copyright legal",
    "side": "sidebar side aside widget widgets rail complementary related recommended popular trending tags more",
    "comment": "comment comments commentlist respond responses reply replies discussion disqus thread feedback",
    "notice": "notice notices cookie cookies consent gdpr alert popup modal overlay message warning disclaimer subscribe newsletter paywall",
    "share": "share sharing social follow like buttons tools meta byline author",
    "form": "form search login signup register contact input",
    "content": "content article post entry body story text main page prose single hentry",
}
CUE_OF = {word: cue for cue, words in CUES.items() for word in words.split()}
TAGS = frozenset("article main section nav header footer aside form table ul ol li dl p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption div button fieldset details td address menu".split())


#: What an element is by its tag alone.
KIND = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "article": "content", "main": "content"}
#: A block is about rights if one of these stands for at most so many of its words.
RIGHTS, RIGHTS_WORDS = re.compile(r"©|copyright|rights reserved", re.I), 12


def text_features(text: str, linked: int) -> list[str]:
    n = len(text)
    found = [f"size:{min(7, (n // 10).bit_length())}"]
    share = linked / n
    found.append(f"links:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}")
    if text[-1] in ".!?…:;\"'”»)":
        found.append("ends")
    rights = len(RIGHTS.findall(text))
    if rights and text.count(" ") < RIGHTS_WORDS * rights:
        found.append("rights")
    marks = text.count(",") + text.count(".")
    found.append(f"marks:{min(3, marks)}")
    return found


@dataclass(frozen=True)
class Model:
    """weights: main against other for each feature; edges[same parent][label before][label]."""

    weights: dict[str, float]
    edges: np.ndarray


def viterbi(unary: list[float], same: list[bool], edges: list) -> list[bool]:
    """The best labelling; unary is main against other, same[i] whether blocks i - 1 and i share a parent."""
    if not unary:
        return []
    a, b = 0.0, unary[0]
    back = []
    for u, s in zip(unary[1:], same[1:], strict=True):
        (oo, om), (mo, mm) = edges[s]
        to_o, to_m = (a + oo, b + mo), (a + om, b + mm)
        back.append((to_o[1] > to_o[0], to_m[1] > to_m[0]))
        a, b = max(to_o), max(to_m) + u
    label = b > a
    out = [label]
    for o, m in reversed(back):
        label = m if label else o
        out.append(label)
    return out[::-1]


def same_parent(blocks: list[Block]) -> list[bool]:
    return [i > 0 and blocks[i - 1].parent == b.parent for i, b in enumerate(blocks)]


_MARK = "\ue000"


def training_pages(n: int = 250, seed: int = 3) -> list[str]:
    """Pages from templates; main text carries a private-use mark that training takes for the label and removes."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(0, len(xs))]
    chance = lambda p: rng.random() < p
    syllables = "an ti on re the of er in ou la de ment en es ra do st nd".split()
    known = ["".join(syllables[i] for i in rng.integers(0, len(syllables), rng.integers(1, 5))) for _ in range(2_000)]
    word = lambda: known[rng.integers(0, len(known))]

    def words(low: int, high: int) -> str:
        return " ".join(word() + ("," if chance(0.08) else "." if chance(0.1) else "") for _ in range(rng.integers(low, high)))

    def sentence(low: int, high: int) -> str:
        return (words(low, high).capitalize() + pick(".", ".", ".", "", "!", "?")).replace("..", ".")

    def links(k: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/{word()}'>{words(1, 4)}</a></{tag}>" for _ in range(k))

    def main(text: str) -> str:
        return _MARK + text

    def menu() -> str:
        inner = f"<ul>{links(rng.integers(3, 9))}</ul>"
        return pick(f"<nav>{inner}</nav>", f"<div class='{pick('menu', 'navbar', 'nav-main', 'breadcrumbs')}'>{inner}</div>", f"<ul id='{pick('menu', 'nav')}'>{links(5)}</ul>", f"<nav>{links(5, 'span')}</nav>", f"<div><p>{links(4, 'span')}</p></div>")

    def header() -> str:
        inner = pick(f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>", f"<div class='logo'>{words(1, 3)}</div><p>{sentence(3, 9)}</p>", f"<a href='/'>{words(1, 4)}</a>")
        return pick(f"<header>{inner}{menu() if chance(0.5) else ''}</header>", f"<div id='{pick('header', 'masthead', 'site-header', 'topbar')}'>{inner}</div>")

    def notice() -> str:
        return f"<div class='{pick('cookie-notice', 'notice', 'alert', 'gdpr', 'consent-banner', 'popup', 'message')}'{pick('', ' role=alert')}>{pick('<p>', '')}{sentence(5, 25)}</div>"

    def advert() -> str:
        inner = pick(sentence(2, 20), f"<p>{sentence(4, 30)}</p>", f"<a href='#'>{words(2, 8)}</a>")
        return pick(f"<div class='{pick('ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-slot', 'advertisement')}'>{inner}</div>", f"<aside class='ad'>{inner}</aside>", f"<div id='ad-{rng.integers(0, 9)}'>{inner}</div>")

    def side() -> str:
        inner = pick(f"<h3>{words(1, 4)}</h3><ul>{links(5)}</ul>", f"<p>{sentence(5, 40)}</p>", f"<h4>{words(1, 3)}</h4><p>{sentence(5, 20)}</p><p>{sentence(5, 20)}</p>")
        return pick(f"<aside>{inner}</aside>", f"<div class='{pick('sidebar', 'widget', 'related', 'side-col', 'recommended')}'>{inner}</div>", f"<section class='related'>{inner}</section>")

    def form() -> str:
        inner = f"<label>{words(1, 3)}</label><input type=text>{pick('', f'<p>{sentence(3, 15)}</p>')}<button>{words(1, 2)}</button>"
        return pick(f"<form>{inner}</form>", f"<form class='{pick('search', 'newsletter', 'login')}'>{inner}</form>", f"<div class='newsletter'><form>{inner}</form></div>")

    def comments() -> str:
        one = lambda: pick(f"<div class='comment'><p>{sentence(3, 40)}</p></div>", f"<li class='comment'><b>{word()}</b><p>{sentence(3, 30)}</p></li>", f"<article class='comment'><p>{sentence(3, 30)}</p></article>", f"<p>{sentence(3, 30)}</p>")
        inner = pick("", f"<h3>{words(1, 3)}</h3>") + "".join(one() for _ in range(rng.integers(1, 6)))
        return pick(f"<section id='comments'>{inner}</section>", f"<div class='{pick('comments', 'comment-list', 'responses', 'discussion')}'>{inner}</div>", f"<ol class='commentlist'>{inner}</ol>")

    def footer() -> str:
        inner = pick(f"&copy; {words(1, 6)}", f"<p>&copy; 2024 {sentence(2, 12)}</p>", f"<p>{sentence(3, 30)}</p><ul>{links(4)}</ul>", f"{words(1, 3)} &middot; {sentence(4, 30)}")
        return pick(f"<footer>{inner}</footer>", f"<div id='{pick('footer', 'bottom', 'colophon')}'>{inner}</div>", f"<div class='{pick('footer', 'copyright', 'site-footer')}'>{inner}</div>")

    def piece() -> str:
        draw = rng.integers(0, 16)
        if draw < 9:
            return f"<p>{main(sentence(1, 6) if chance(0.25) else sentence(5, 90))}" + pick("</p>", "</p>", "<br>")
        if draw == 9:
            return f"<{(h := pick('h2', 'h3'))}>{main(words(1, 7))}</{h}>"
        if draw == 10:
            return f"<{(t := pick('ul', 'ol'))}>" + "".join(f"<li>{main(sentence(1, 15))}</li>" for _ in range(rng.integers(2, 6))) + f"</{t}>"
        if draw == 11:
            return f"<blockquote>{pick('<p>', '')}{main(sentence(5, 40))}</blockquote>"
        if draw == 12:
            return "<table>" + "".join(f"<tr><td>{main(words(1, 5))}</td><td>{main(words(1, 4))}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>"
        if draw == 13:
            return f"<pre>{main(words(3, 20))}</pre>"
        if draw == 14:
            return f"<figure><img src='x'><figcaption>{main(sentence(2, 12))}</figcaption></figure>"
        return f"<p><a href='/x'>{main(words(1, 5))}</a> {sentence(2, 30)}</p>"

    def article() -> str:
        parts = [f"<h1>{main(words(2, 12))}</h1>"] if chance(0.8) else []
        if parts and chance(0.15):
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(rng.integers(1, 14)):
            parts.append(piece())
            if chance(0.06):
                parts.append(pick(advert, side, form, notice)())
        if chance(0.15):
            parts.append(comments())
        inner = "".join(parts)
        if chance(0.2):
            inner = f"<div>{inner}</div>"
        return pick(*[f"<article>{inner}</article>"] * 4, f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f"<div class='{pick('content', 'post', 'entry-content', 'article-body', 'story', 'post-content')}'>{inner}</div>", f"<div id='{pick('content', 'main', 'article', 'page')}'>{inner}</div>", f"<div>{inner}</div>", f"<section>{inner}</section>")

    pages = []
    for _ in range(n):
        before = [f() for f in (notice, header, menu, advert, form) if chance(0.45)]
        rng.shuffle(before)
        after = [f() for f in (side, advert, comments, form, side, notice) if chance(0.35)]
        rng.shuffle(after)
        rest = footer() if chance(0.85) else ""
        left = side() if chance(0.15) else ""
        pages.append(f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(before)}{left}{article()}{''.join(after)}{rest}</body></html>")
    return pages


def train(pages: list[str], steps: int = 150) -> Model:
    """Maximises the conditional log-likelihood with a small penalty on squares; all pages at once."""
    names: dict[str, int] = {}
    sequences = []
    for page in pages:
        blocks = leaf_blocks(page)
        labels = [_MARK in b.text for b in blocks]
        ids = []
        for b in blocks:
            plain = b.text.replace(_MARK, "") or "x"
            ids.append([names.setdefault(f, len(names)) for f in b.path.features + text_features(plain, min(b.linked, len(plain)))])
        sequences.append((ids, labels, same_parent(blocks)))
    sequences = [s for s in sequences if s[0]]
    longest, count = max(len(s[0]) for s in sequences), len(sequences)
    x = np.zeros((count, longest, len(names)), dtype=np.float32)
    y, same, live = (np.zeros((count, longest), dtype=np.int64) for _ in range(3))
    for i, (ids, labels, near) in enumerate(sequences):
        for j, own in enumerate(ids):
            x[i, j, own] = 1
        y[i, : len(ids)], same[i, : len(ids)], live[i, : len(ids)] = labels, near, 1
    w, edges = np.zeros(len(names)), np.zeros((2, 2, 2))
    moment = [np.zeros_like(w), np.zeros_like(edges), np.zeros_like(w), np.zeros_like(edges)]
    rows = np.arange(count)
    add = lambda v: np.logaddexp(v[..., 0], v[..., 1])
    for step in range(1, steps + 1):
        unary = np.zeros((count, longest, 2))
        unary[..., 1] = x @ w
        table = edges[same]
        fore = np.zeros((count, longest, 2))
        rear = np.zeros((count, longest, 2))
        fore[:, 0] = unary[:, 0]
        for j in range(1, longest):
            nxt = add((fore[:, j - 1, :, None] + table[:, j]).transpose(0, 2, 1)) + unary[:, j]
            fore[:, j] = np.where(live[:, j, None] == 1, nxt, fore[:, j - 1])
        for j in range(longest - 2, -1, -1):
            prev = add(table[:, j + 1] + (unary[:, j + 1] + rear[:, j + 1])[:, None, :])
            rear[:, j] = np.where(live[:, j + 1, None] == 1, prev, 0)
        total = add(fore[:, -1])
        own = np.exp(fore + rear - total[:, None, None])[..., 1] * live
        grad_w = np.einsum("ij,ijf->f", y * live - own, x) / count - 2e-3 * w
        grad_e = np.zeros_like(edges)
        for j in range(1, longest):
            on = live[:, j] == 1
            p = np.exp(fore[:, j - 1, :, None] + table[:, j] + (unary[:, j] + rear[:, j])[:, None, :] - total[:, None, None])
            true = np.zeros_like(p)
            true[rows, y[:, j - 1], y[:, j]] = 1
            for s in (0, 1):
                grad_e[s] += (true - p)[on & (same[:, j] == s)].sum(axis=0)
        grad_e = grad_e / count - 2e-3 * edges
        for k, (g, value) in enumerate(((grad_w, w), (grad_e, edges))):
            moment[k] = 0.9 * moment[k] + 0.1 * g
            moment[k + 2] = 0.99 * moment[k + 2] + 0.01 * g * g
            value += 0.08 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(moment[k + 2] / (1 - 0.99**step)) + 1e-8)
    return Model({name: float(w[i]) for name, i in names.items()}, edges)


class Decoder:
    """Decodes pages with a model; the potentials of ancestor paths and text shapes are remembered."""

    def __init__(self, model: Model):
        self.weights, self.edges = model.weights, [[list(map(float, r)) for r in e] for e in model.edges]
        self.paths = Paths()
        self.learned: dict[Path, float] = {}

    def potential(self, block: Block) -> float:
        own = self.learned.get(block.path)
        if own is None:
            own = self.learned[block.path] = sum(self.weights.get(f, 0.0) for f in block.path.features)
        return own + sum(self.weights.get(f, 0.0) for f in text_features(block.text, block.linked))

    def main_text(self, page: str | None) -> str:
        if not page:
            return ""
        if len(self.paths.inner) > Paths.REMEMBERED:
            self.paths, self.learned = Paths(), {}
        blocks = leaf_blocks(page, self.paths)
        chosen = viterbi([self.potential(b) for b in blocks], same_parent(blocks), self.edges)
        return "\n".join(b.text for b, yes in zip(blocks, chosen, strict=True) if yes)


def with_main_text(pages: DataFrame, model: Model, source: str = "html", target: str = "text") -> DataFrame:
    """pages with the column target: the main blocks' texts in page order, joined by newlines.

    Null or empty pages, and pages without a main block, give the empty string; whole pages of any length are read;
    repeated rows get equal results; an empty table stays empty; a column with the name of target is replaced, all others stay.
    """
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extract(column: pd.Series) -> pd.Series:
        decoder = Decoder(shared.value)
        return pd.Series([decoder.main_text(p) for p in column], dtype=object)

    return pages.withColumn(target, extract(F.col(source)))
