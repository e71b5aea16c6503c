"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the document tree.

A page is read once into leaf blocks: runs of text between block-level tags, each with its open ancestors, their class and id
words, and how much of it is link text. Every block gets binary features; a two-state chain (main, other) trained on labelled
pages scores them together with their neighbours, and Viterbi decoding picks the best sequence of states. Blocks in state main,
in page order, are the text.

The labelled pages are composed by `labelled_pages` (layouts x wordings, from a seed), since the given table has no labels.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Tags of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript svg math iframe object head title canvas audio video".split())
CLOSES_P = BLOCKS - {"button", "label", "option", "optgroup", "legend", "select", "textarea", "caption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select menu article section div nav aside main form footer header body".split())
# Words of class and id names, by what they usually name.
ROLES = {
    "content": "article content post entry story main body text prose page single",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs toc pagination pager tabs skip links topbar toolbar",
    "head": "header masthead banner logo branding hero top title",
    "foot": "footer foot colophon copyright legal imprint bottom",
    "side": "sidebar side aside widget widgets related recommended more popular trending rail secondary",
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion dfp adsense teaser",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay paywall disclaimer subscribe newsletter signup",
    "form": "form login search contact input register subscribe",
    "comment": "comment comments reply replies respond discussion disqus reader readers feedback",
    "share": "share sharing social follow like tweet meta byline tags tag author",
}
# What a text says, in lower case; `\b` is a border of a word.
CUES = {
    "copyright": "©|(c)|copyright|all rights reserved",
    "cookie": r"\bcookie\b|\bcookies\b|\bconsent\b|privacy",
    "subscribe": "subscribe|newsletter|signup|sign up|login|log in|signin|sign in|password|email|e-mail",
    "advert": r"advertis|sponsor|buy now|order now|sale\b|discount|% off",
    "reply": r"\breply\b|\bcomment\b|\bcomments\b|\bsays:|\bwrote:|posted by|great post|great article|thanks for",
    "more": "read more|related|share|follow us|most read|see also|home|menu|skip to",
}
# plain words are looked for as such, and borders of words only where the word is there
CUE = {k: [(x.replace(r"\b", ""), re.compile(x) if r"\b" in x else None) for x in v.split("|")] for k, v in CUES.items()}
LIKE = str.maketrans("İıſ\u212a", "iisk")  # what else case-insensitive patterns take for i, s and k
ROLE_OF = {w: role for role, words in ROLES.items() for w in words.split()}
SAYING = frozenset("nav header footer aside form article main button select".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MAIN, OTHER = 1, 0


@dataclass
class Block:
    text: str
    tag: str
    path: frozenset[str]  # tags of the element and its ancestors
    roles: frozenset[str]
    near: frozenset[str]  # what the innermost element that says anything says
    link: float  # share of its characters inside links
    mark: str | None = None  # label of a labelled page


@dataclass
class Node:
    """An open element with what it and its ancestors say, so that a block need not look through all of them."""

    tag: str
    roles: frozenset[str] = frozenset()  # of the element and its ancestors
    mark: str | None = None  # the innermost label
    near: frozenset[str] = frozenset()  # of the innermost element that says anything
    path: frozenset[str] = frozenset({"html"})

    def inside(self, tag: str, roles: frozenset[str], mark: str | None) -> Node:
        """An element opened in this one."""
        own = roles | ({tag} & SAYING)
        return Node(tag, self.roles | roles if roles else self.roles, mark or self.mark, own or self.near, self.path if tag in self.path else self.path | {tag})


def attributes(raw: str) -> tuple[frozenset[str], str | None]:
    """What the class, id and role words of a tag name, and `hidden` if the element isn't shown; the label of a labelled page."""
    roles = set()
    if raw and raw.strip(" /"):
        for m in NAMED.finditer(raw):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                roles.update(r for w in WORDS.findall(value) if (r := ROLE_OF.get(w.lower())))
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                roles.add("hidden")
    label = re.search(r'data-label="(\w+)"', raw) if raw and "data-label" in raw else None
    return frozenset(roles), label[1] if label else None


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in page order. Tags that are never closed end with what holds them."""
    page, out, stack = page or "", [], [Node("html")]
    parts: list[str] = []
    size = linked = 0
    in_link, at, n = 0, 0, len(page)
    opened: Counter[str] = Counter()

    def close(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]

    def flush() -> None:
        nonlocal size, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                held = stack[-1]
                out.append(Block(text, held.tag, held.path, held.roles, held.near, linked / max(1, size), held.mark))
            parts.clear()
        size = linked = 0

    def take(raw: str) -> None:
        nonlocal size, linked
        parts.append(raw)
        size += len(raw)
        linked += len(raw) if in_link else 0

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            take(page[at:])
            break
        if m.start() > at:
            take(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        closing = m[1] == "/"
        if tag in SILENT and not closing:
            if tag in ("svg", "math", "object", "audio", "video", "canvas", "iframe", "template", "noscript", "script", "style", "title"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = at if m[3].endswith("/") else end.end() if end else n if tag in ("script", "style") else at
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            take(" ")
        elif tag in BLOCKS:
            flush()
            if closing:
                for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if tag in SIBLINGS and stack[i].tag in SCOPES:
                        break
            else:
                if tag in CLOSES_P and stack[-1].tag == "p":
                    close(len(stack) - 1)
                ends = SIBLINGS.get(tag, ())
                for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ends) else ():
                    if stack[i].tag in ends:
                        close(i)
                        break
                    if stack[i].tag in SCOPES:
                        break
                roles, mark = attributes(m[3])
                if tag not in VOID:
                    stack.append(stack[-1].inside(tag, roles, mark))
                    opened[tag] += 1
                    in_link = 0
    flush()
    return out


def cues(text: str) -> list[str]:
    """The names of the cues in a text, in any case."""
    low = (text if text.isascii() else text.translate(LIKE)).lower()
    found = []
    for name, said in CUE.items():
        for plain, bordered in said:
            if plain in low and (bordered is None or bordered.search(low)):
                found.append(name)
                break
    return found


def features(seq: list[Block]) -> list[list[str]]:
    """Binary features of each block: ancestors, named roles, and its text."""
    rows = []
    for i, b in enumerate(seq):
        words = b.text.count(" ") + 1
        own = [f"tag={b.tag}", *(f"in={t}" for t in b.path), *(f"role={r}" for r in b.roles), *(f"near={r}" for r in b.near)]
        own.append(f"words={min(6, words.bit_length())}")
        own.append(f"link={0 if b.link == 0 else 1 if b.link < 0.34 else 2 if b.link < 0.8 else 3}")
        own.append("ends" if b.text[-1] in ".!?…:;”\"»" else "open")
        said = cues(b.text)
        own += [f"cue={k}" for k in said]
        own += [f"short+cue={k}" for k in said if words < 25]
        if not any(r in b.roles for r in ROLES) and not b.path & {"nav", "header", "footer", "aside", "form", "article", "main"}:
            own.append("plain")
            own.append(f"plain+words={min(6, words.bit_length())}")
        if i == 0:
            own.append("first")
        if i == len(seq) - 1:
            own.append("last")
        rows.append(own)
    return rows


@dataclass
class Chain:
    """A trained chain: feature -> number, weights by feature and state, weights of transitions and of the first state."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    begin: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), 2))
        for i, row in enumerate(rows):
            known = [self.index[f] for f in row if f in self.index]
            if known:
                out[i] = self.emit[known].sum(axis=0)
        return out

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi: the states of largest joint score; ties go to `OTHER`."""
        if not rows:
            return []
        score = self.scores(rows)
        top, back = self.begin + score[0], []
        for s in score[1:]:
            through = top[:, None] + self.move
            back.append(through.argmax(axis=0))
            top = through.max(axis=0) + s
        states = [int(top.argmax())]
        for pointer in reversed(back):
            states.append(int(pointer[states[-1]]))
        return states[::-1]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 60, rate: float = 0.1, decay: float = 1e-3) -> Chain:
    """Maximum likelihood by Adam on forward-backward expectations; `pages` are features and states of labelled pages."""
    index: dict[str, int] = {}
    for rows, _ in pages:
        for row in rows:
            for f in row:
                index.setdefault(f, len(index))
    chain = Chain(index, np.zeros((len(index), 2)), np.zeros((2, 2)))
    params = [chain.emit, chain.move, chain.begin]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    coded = [([np.array([index[f] for f in row]) for row in rows], np.array(states)) for rows, states in pages if rows]
    total = sum(len(s) for _, s in coded)
    for step in range(1, rounds + 1):
        grads = [np.zeros_like(p) for p in params]
        for rows, states in coded:
            score = np.array([chain.emit[r].sum(axis=0) for r in rows])
            n = len(rows)
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = chain.begin + score[0]
            for i in range(1, n):
                ahead[i] = log_sum(ahead[i - 1][:, None] + chain.move, 0) + score[i]
            for i in range(n - 2, -1, -1):
                behind[i] = log_sum(chain.move + (score[i + 1] + behind[i + 1])[None, :], 1)
            z = log_sum(ahead[-1], 0)
            want = np.eye(2)[states]
            miss = want - np.exp(ahead + behind - z)
            for r, d in zip(rows, miss, strict=True):
                grads[0][r] += d
            for i in range(1, n):
                pair = np.exp(ahead[i - 1][:, None] + chain.move + (score[i] + behind[i])[None, :] - z)
                grads[1] += np.outer(want[i - 1], want[i]) - pair
            grads[2] += miss[0]
        for k, p in enumerate(params):
            g = grads[k] / total - decay * p
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return chain


def labelled_pages(count: int = 260, seed: int = 11) -> list[str]:
    """Labelled pages: every element that holds text of its own kind carries `data-label`, `main` or `other`."""
    r = random.Random(seed)
    sound = ["ta", "re", "on", "li", "sha", "ver", "mu", "en", "qui", "dor", "é", "ström", "ing", "the", "an", "os"]

    def word() -> str:
        return "".join(r.choice(sound) for _ in range(r.randint(1, 3)))

    def line(lo: int, hi: int, stop: str = ".") -> str:
        words = [word() for _ in range(r.randint(lo, hi))]
        return (" ".join(words)).capitalize() + stop

    def para() -> str:
        kind = r.random()
        if kind < 0.12:
            return line(1, 6)
        if kind < 0.22:
            return f"{line(6, 30)} <a href='/x'>{line(1, 4, '')}</a> {line(4, 30)}"
        return " ".join(line(3, 22) for _ in range(r.randint(1, 7)))

    def links(n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{line(1, 3, "")}</a></{tag}>' for _ in range(n))

    def main() -> str:
        out = []
        if r.random() < 0.8:
            out.append(f'<h1 data-label="main">{line(2, 12, r.choice(["", ".", ""]))}</h1>')
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.74:
                out.append(f'<p data-label="main">{r.choice(["", "<b>", "<b>"])}{para()}{r.choice(["</p>", "", "<br>"])}')
            elif kind < 0.82:
                out.append(f'<h{(k := r.randint(2, 4))} data-label="main">{line(1, 7, "")}</h{k}>')
            elif kind < 0.9:
                out.append('<ul data-label="main">' + "".join(f"<li>{line(2, 14, r.choice(['', '.']))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.95:
                out.append(f'<blockquote data-label="main">{r.choice(["", "<p>"])}{para()}</blockquote>')
            else:
                out.append(f'<table data-label="main"><tr><td>{line(1, 4, "")}</td><td>{line(1, 3, "")}</td></tr></table>')
            if r.random() < 0.07:
                out.append(f'<div class="{r.choice(["ad", "advert", "promo box", "sponsored"])}" data-label="other">{r.choice(["Advertisement", line(3, 12), "Buy now: " + line(2, 6)])}</div>')
            if r.random() < 0.04:
                out.append(f'<div class="{r.choice(["share", "social-links"])}" data-label="other">{links(3, "span")}</div>')
        return "".join(out)

    def side(kind: str) -> str:
        text = {
            "menu": lambda: f"<ul>{links(r.randint(3, 9))}</ul>",
            "head": lambda: r.choice([f"<p>{line(1, 5, '')}</p>", f"<h1>{line(1, 3, '')}</h1><p>{line(3, 8)}</p>", f"<div>{line(1, 3, '')}</div><ul>{links(4)}</ul>"]),
            "foot": lambda: r.choice([f"&copy; {word()}.example &middot; {line(3, 9)}", f"<p>Copyright 2020 {line(2, 5)} All rights reserved.</p><ul>{links(4)}</ul>", f"<p>{line(4, 20)}</p>"]),
            "side": lambda: f"<h3>{r.choice(['Related', 'Most read', line(1, 3, '')])}</h3>" + r.choice([f"<ul>{links(5)}</ul>", f"<p>{line(5, 25)}</p><p>{line(5, 20)}</p>"]),
            "ad": lambda: r.choice([line(3, 14), f"<p>{line(3, 14)}</p>", f'<a href="/buy">{line(2, 8)}</a>', "<p>Advertisement</p>"]),
            "notice": lambda: r.choice([f"<p>We use cookies. {line(4, 18)}</p><button>OK</button>", f"{line(5, 22)} <button>Accept</button>", f"<p>Subscribe to our newsletter. {line(4, 12)}</p>", f"<p>{line(4, 18)}</p>"]),
            "form": lambda: f"<label>{line(1, 3, '')}</label><input name=q><select><option>{word()}<option>{word()}</select><button>{word()}</button>" + r.choice(["", f"<p>{line(4, 14)}</p>"]),
            "comment": lambda: r.choice(["<h3>Comments</h3>", "<h2>3 comments</h2>", ""]) + "".join(
                f'<div class="comment"><{(t := r.choice(["p", "div", "span"]))}>{word()} says:</{t}><p>{para()}</p></div>' for _ in range(r.randint(1, 5))),
        }[kind]()
        names = {
            "menu": ['nav', 'div class="menu"', 'div id="navbar"', 'ul class="breadcrumbs"', 'div role="navigation"', 'nav class="toc"'],
            "head": ['header', 'div class="header"', 'div id="masthead"', 'div class="site-header"', 'header class="banner"'],
            "foot": ['footer', 'div class="footer"', 'div id="footer"', 'div class="site-footer legal"'],
            "side": ['aside', 'div class="sidebar"', 'div id="related"', 'div class="widget"', 'aside class="rail"'],
            "ad": ['div class="ad"', 'div class="ads top"', 'div id="advert"', 'section class="sponsored"', 'div class="promo"'],
            "notice": ['div class="cookie-notice"', 'div id="consent"', 'div class="popup"', 'div class="notice"', 'div role="alert"', 'div class="newsletter"'],
            "form": ['form', 'form class="search"', 'div class="login"><form'],
            "comment": ['section class="comments"', 'div id="comments"', 'div class="reader-comments"', 'ol class="replies"', 'div id="discussion"'],
        }[kind]
        opening = r.choice(names)
        close = "</form></div>" if "><form" in opening else f"</{opening.split()[0]}>"
        return f'<{opening} data-label="other">{text}{close}'

    pages = []
    for i in range(count):
        before = [k for k in ("notice", "head", "menu", "form", "ad") if r.random() < (0.75 if k == "menu" else 0.4)]
        after = [k for k in ("comment", "side", "ad", "notice", "form", "foot") if r.random() < (0.75 if k == "foot" else 0.35)]
        holder = r.choice(['article', 'article', 'article class="post"', 'main', 'div class="content"', 'div id="main"', 'div class="entry-content"', 'section class="story"', 'div class="c7 x2"', 'div', ""])
        text = main()
        if r.random() < 0.2:
            text += side("comment") if r.random() < 0.5 else side("ad")
        if r.random() < 0.15:
            text = f'<header data-label="main"><h1 data-label="main">{line(2, 9, "")}</h1></header>' + text
        body = f"<{holder}>{text}</{holder.split()[0]}>" if holder else text
        if r.random() < 0.4:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "row"])}">{body}</div>'
        r.shuffle(before)
        tail = "</body></html>" if r.random() < 0.8 else ""
        pages.append(
            f'<!DOCTYPE html><html lang="en"><head><title>{line(2, 9, "")}</title><style>p{{}}</style><script>track({i})</script></head><body>'
            + "".join(side(k) for k in before) + body + "".join(side(k) for k in after) + tail
        )
    return pages


@cache
def trained(count: int = 260, seed: int = 11) -> Chain:
    """The chain trained on the labelled pages of a seed; about 6,000 blocks, whatever the size of the table."""
    examples = []
    for page in labelled_pages(count, seed):
        seq = blocks(page)
        examples.append((features(seq), [MAIN if b.mark == "main" else OTHER for b in seq]))
    return train(examples)


def main_text(chain: Chain, page: str | None) -> str:
    seq = blocks(page)
    return "\n\n".join(b.text for b, s in zip(seq, chain.decode(features(seq)), strict=True) if s == MAIN)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", chain: Chain | None = None) -> DataFrame:
    """`pages` with the main text of each page in `text_col`, an empty text where there is none.

    A null or empty page gives an empty text. All other columns stay; a column of the result's name is replaced. Repeated rows are
    each read, and an empty table gives no rows. Pages are read whole, and each on its own: there is no shuffle.
    """
    chain = chain or trained()
    kept = [c for c in pages.columns if c != text_col]
    at = kept.index(html_col)
    out = [c for c in kept if c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(chain, x.as_py()) for x in batch.column(at)]
            columns = [c for name, c in zip(kept, batch.columns, strict=True) if name != html_col]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*out, text_col])

    base = pages.select(*kept)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != html_col]
    return base.mapInArrow(run, ", ".join([*fields, f"`{text_col}` string"]))
