"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import ship, table

TRAIN_PAGES = 500  # labelled pages that the field is trained on
# Attributes as HTML writes them, or else anything up to the next angle bracket.
_WELL = r"(?:\s++(?:[^\s=<>\"'/]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s<>\"']++))?+)?+)*+\s*+"
_ATTRIBUTES = rf"{_WELL}/?|[^<>]*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*+>"
    rf"|<(script|style|iframe|textarea|title)(?![\w:-]|{_WELL}/>)(?:{_ATTRIBUTES})>.*?(?:</\2\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRIBUTES})>",
    re.S | re.I,
)
_UNFINISHED = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
NONE: frozenset[str] = frozenset()
HIDDEN = frozenset(["svg", "template"])
# HTML elements that end an open svg.
BREAKS = frozenset("article aside b big blockquote body br center code dd div dl dt em embed footer form h1 h2 h3 h4 h5 h6 head header hr i img li main menu nav ol p pre s section small span strike strong sub sup table tt u ul".split())
# An opening tag ends an open element of these kinds, unless one of BOUNDARY is in between.
CLOSES = {x: {"p"} for x in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
CLOSES |= {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDARY = frozenset("html body ul ol table div section article aside nav header footer main form td th blockquote".split())
# Words in class, id and role, by what they tell.
KINDS = {
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs tabs pagination pager toolbar",
    "side": "sidebar aside widget related recommended complementary trending popular",
    "foot": "footer copyright legal colophon contentinfo",
    "head": "header masthead topbar logo branding",
    "comment": "comment comments reply replies disqus respond discussion reader",
    "notice": "cookie cookies notice consent gdpr alert modal popup newsletter subscribe privacy",
    "share": "social share sharing follow",
    "form": "form login search signup contact",
    "content": "article content post entry story body main text page",
}
WORDS = {w: k for k, ws in KINDS.items() for w in ws.split()}
TAGS = "nav header footer aside article main form ul ol li table h1 h2 h3 h4 p blockquote pre section div a button label select option figure figcaption dl fieldset body".split()
TEXT = "words<4 words<10 words<30 words>=30 ends comma link linked copyright bar digits first last after-heading only".split()
NAMES = [*(f"tag:{t}" for t in TAGS), *(f"kind:{k}" for k in KINDS), *TEXT, "bias"]
INDEX = {n: i for i, n in enumerate(NAMES)}


@dataclass
class Block:
    text: str
    marks: tuple[int, ...]
    linked: int  # characters inside links
    heading: bool


def _closable(page: str) -> str:
    """The page, as long as it is, with nothing in it that looks for an end that never comes: each such start would be looked at up to the page's end."""
    after = page.rfind("]]>") + 1
    page = page[:after] + re.sub(r"<!\[CDATA\[", "<!(CDATA(", page[after:], flags=re.I)
    after = page.rfind(">") + 1
    return page[:after] + re.sub(r"<(?!!--)", " ", page[after:])


def blocks_of(page: str) -> list[Block]:
    """The page's leaf blocks: runs of text between block-level tags, white space made single spaces.

    Comments, scripts, styles and other text that isn't shown are left out; what is in an svg or template, up to its end tag, that of an
    element around it or, for an svg, an HTML element.  Text in a noscript is text like any other.  Tags of objects are passed over, and what starts no
    tag is text.  Unclosed elements end where HTML ends them, and end tags without a start are ignored.
    """
    out: list[Block] = []
    stack: list[tuple[str, frozenset[int]]] = [("", frozenset())]
    opened: dict[str, list[int]] = {}  # where on the stack each tag is, where it is
    bounds, solid = [0], [0]  # where on it elements of BOUNDARY are, and those not of INLINE
    held: list[tuple[str, bool]] = []

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", "".join(t for t, _ in held)).strip()
            if text:
                linked = sum(len(t) for t, a in held if a)
                marks = stack[-1][1] | (inside[-1] if inside else frozenset())
                out.append(Block(text, tuple(marks), linked, not opened.keys().isdisjoint(HEADINGS)))
            held.clear()
            inside.clear()

    inside: list[frozenset[int]] = []
    hidden: list[str] = []  # open elements from an svg or template on
    veiled: dict[str, int] = {}  # how many of each tag these are

    def add(raw: str) -> None:
        if raw and not hidden:
            held.append((html.unescape(raw) if "&" in raw else raw, "a" in opened))
            if not raw.isspace():
                inside[:] = [stack[-1][1]]

    def close(i: int) -> None:
        for t, _ in stack[i:]:
            opened[t].pop()
            if not opened[t]:
                del opened[t]
        del stack[i:]
        for x in (bounds, solid):
            while x[-1] >= i:
                x.pop()

    def hide(tag: str) -> None:
        hidden.append(tag)
        veiled[tag] = veiled.get(tag, 0) + 1

    at = 0
    for m in _TOKEN.finditer(_closable(page)):
        add(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            add(m[1])
        if m[4] is None:
            continue
        tag = m[4].lower()
        if tag == "object":
            continue
        if hidden:
            if m[3]:
                if veiled.get(tag):
                    ended = None
                    while ended != tag:
                        ended = hidden.pop()
                        veiled[ended] -= 1
                    continue
                if tag not in opened:
                    continue
            elif hidden[0] != "svg" or tag not in BREAKS:
                if tag not in VOID and not m[5].endswith("/"):
                    hide(tag)
                continue
            hidden.clear()
            veiled.clear()
        if tag in HIDDEN:
            if not m[3] and not m[5].endswith("/"):
                hide(tag)
            continue
        if m[3]:
            if tag not in INLINE:
                flush()
            if tag in opened and (tag not in INLINE or opened[tag][-1] > solid[-1]):
                close(opened[tag][-1])
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            flush()
            last = max((opened[t][-1] for t in CLOSES.get(tag, NONE) if t in opened), default=0)
            if last and last >= bounds[-1]:
                close(last)
        if tag in VOID or m[5].endswith("/") and tag not in INLINE:
            continue
        marks = set(stack[-1][1])
        if (i := INDEX.get(f"tag:{tag}")) is not None:
            marks.add(i)
        if m[5] and tag not in ("html", "body"):
            for a in _NAMED.findall(m[5]):
                for w in _PART.findall("".join(a)):
                    if k := WORDS.get(w.lower()):
                        marks.add(INDEX[f"kind:{k}"])
        opened.setdefault(tag, []).append(len(stack))
        for x, there in ((bounds, tag in BOUNDARY), (solid, tag not in INLINE)):
            if there:
                x.append(len(stack))
        stack.append((tag, frozenset(marks)))
    add(page[at:] if not _UNFINISHED.match(page, at) else "")
    flush()
    return out


def matrix(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), len(NAMES)))
    x[:, INDEX["bias"]] = 1
    for i, b in enumerate(blocks):
        x[i, list(b.marks)] = 1
        n = b.text.count(" ") + 1
        tells = ["words<4" if n < 4 else "words<10" if n < 10 else "words<30" if n < 30 else "words>=30"]
        if b.text[-1] in ".!?:;\"'”»…":
            tells.append("ends")
        if "," in b.text:
            tells.append("comma")
        if b.linked:
            tells.append("linked" if 2 * b.linked > len(b.text) else "link")
        if "©" in b.text or "(c)" in b.text:
            tells.append("copyright")
        if "|" in b.text or "·" in b.text:
            tells.append("bar")
        if any(c.isdigit() for c in b.text):
            tells.append("digits")
        if i == 0:
            tells.append("first")
        if i == len(blocks) - 1:
            tells.append("last")
        if i and blocks[i - 1].heading:
            tells.append("after-heading")
        if len(blocks) == 1:
            tells.append("only")
        for t in tells:
            x[i, INDEX[t]] = 1
    return x


@dataclass
class Field:
    """State and transition weights of a linear-chain conditional random field with labels 0 (rest) and 1 (main text)."""

    state: np.ndarray  # features x 2
    change: np.ndarray  # 2 x 2

    def decode(self, x: np.ndarray) -> list[int]:
        """The likeliest labels (Viterbi)."""
        score = (x @ self.state).tolist()
        (aa, ab), (ba, bb) = self.change.tolist()
        back, (p, q) = [], score[0]
        for s0, s1 in score[1:]:
            a, b = p + aa >= q + ba, p + ab > q + bb
            back.append((0 if a else 1, 0 if b else 1))
            p, q = s0 + max(p + aa, q + ba), s1 + max(p + ab, q + bb)
        out = [0 if p >= q else 1]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]

    @classmethod
    def train(cls, pages: list[tuple[np.ndarray, list[int]]], rounds: int = 15, rate: float = 0.5, penalty: float = 2e-4) -> Field:
        """Ascends the conditional log-likelihood, page by page, with forward and backward sums."""
        state, change = np.zeros((len(NAMES), 2)), np.zeros((2, 2))
        for r in range(rounds):
            step = rate / (1 + r / 3)
            for x, y in pages:
                s, n = x @ state, len(y)
                f, b = np.zeros((n, 2)), np.zeros((n, 2))
                f[0] = s[0]
                for i in range(1, n):
                    f[i] = s[i] + np.logaddexp(f[i - 1, 0] + change[0], f[i - 1, 1] + change[1])
                for i in range(n - 2, -1, -1):
                    t = s[i + 1] + b[i + 1]
                    b[i] = np.logaddexp(change[:, 0] + t[0], change[:, 1] + t[1])
                z = np.logaddexp(*f[-1])
                p = np.exp(f + b - z)
                own = np.zeros((n, 2))
                own[np.arange(n), y] = 1
                move = np.zeros((2, 2))
                for i in range(1, n):
                    move[y[i - 1], y[i]] += 1
                    move -= np.exp(f[i - 1][:, None] + change + (s[i] + b[i])[None] - z)
                state += step * (x.T @ (own - p) / n - penalty * state)
                change += step * (move / n - penalty * change)
        return cls(state, change)


def labelled_page(rng: random.Random) -> str:
    """A page as sites lay them out; its main text's words are upper case, all others lower case."""
    word = lambda up: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(1, 9))).upper() if up else "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(1, 9)))
    some = lambda a, b, up=False: " ".join(word(up) + ("," if rng.random() < 0.1 else "") for _ in range(rng.randint(a, b)))
    sentence = lambda up=False: some(1, rng.choice([4, 12, 60]), up) + rng.choice([".", ".", ".", "!", "", " |", " 12."])
    links = lambda n: "".join(f'<li><a href="/{word(False)}">{some(1, 3)}</a></li>' for _ in range(n))
    pick = rng.choice

    def nav() -> str:
        return pick(["<nav><ul>%s</ul></nav>", '<div class="menu"><ul>%s</ul></div>', '<ul id="main-nav">%s</ul>']) % links(rng.randint(2, 9))

    def ad() -> str:
        return pick(['<div class="ad">%s</div>', '<div class="ad-banner"><p>%s</p></div>', '<aside class="sponsored">%s</aside>', '<section class="promo"><p>%s</p></section>']) % sentence()

    def notice() -> str:
        return pick(['<div class="cookie-notice"><p>%s</p><button>%s</button></div>', '<div id="newsletter"><p>%s</p><form><label>%s</label></form></div>', '<div class="alert" role="alert">%s %s</div>']) % (sentence(), some(1, 2))

    def side() -> str:
        return pick(['<aside><h3>%s</h3><ul>%s</ul></aside>', '<div class="sidebar"><h4>%s</h4><ul>%s</ul></div>', '<div class="related-posts"><h3>%s</h3><ul>%s</ul></div>']) % (some(1, 3), links(rng.randint(2, 6)))

    def comments() -> str:
        return pick(['<section class="comments"><h3>{0}</h3>{1}</section>', '<div id="comments"><h2>{0}</h2><ul>{1}</ul></div>']).format(
            some(1, 3), "".join(pick(['<div class="comment"><p>%s</p></div>', '<li class="comment"><p>%s</p></li>', "<article><p>%s</p></article>"]) % sentence() for _ in range(rng.randint(1, 5)))
        )

    def form() -> str:
        return f'<form action="/x"><label>{some(1, 3)}</label><input name="q"><p>{sentence()}</p><button>{word(False)}</button></form>'

    def body() -> str:
        inner = []
        for _ in range(rng.randint(1, 14)):
            t = sentence(True)
            if rng.random() < 0.15:
                t += f' <a href="/y">{some(1, 3, True)}</a> ' + some(1, 5, True)
            inner.append(pick(["<p>%s</p>", "<p>%s</p>", "<p>%s</p>", "<p><b>%s<br>", "<p>%s", "<div>%s</div>", "<blockquote>%s</blockquote>", "<h2>%s</h2>", "<ul><li>%s</li></ul>", "<pre>%s</pre>"]) % t)
            if rng.random() < 0.06:
                inner.append(pick([ad, ad, notice, side, form])())
        title = f"<h1>{some(1, 9, True)}</h1>" if rng.random() < 0.8 else ""
        return pick(["<article>%s</article>", "<article>%s</article>", "<main><article>%s</article></main>", "<main>%s</main>", '<div class="content">%s</div>', '<div id="post-body">%s</div>', '<section class="entry-content">%s</section>', "%s"]) % (title + "".join(inner))

    before = [x() for x in (nav, notice, ad, side, form) if rng.random() < 0.45]
    after = [x() for x in (ad, side, comments, notice, form) if rng.random() < 0.4]
    head = pick(["", f"<header><p>{some(1, 6)}</p></header>", f'<div class="header"><h1>{some(1, 4)}</h1><p>{some(2, 8)}</p></div>', f"<header>{nav()}</header>"])
    foot = pick(["", f"<footer>&copy; {some(1, 3)} &middot; {sentence()}</footer>", f'<div class="footer"><p>{sentence()}</p><ul>{links(3)}</ul></div>', f"<footer><p>{some(1, 6)}</p></footer>"])
    rng.shuffle(before)
    rng.shuffle(after)
    if rng.random() < 0.15:
        return pick(["<html><body>%s</body></html>", "%s"]) % pick([body(), body(), sentence(True), f"<p>{sentence(True)}", f"<article><p>{some(1, 5, True)}</article>"])
    return f"<html><head><title>{some(1, 5)}</title></head><body>{head}{''.join(before)}{body()}{''.join(after)}{foot}</body></html>"


@functools.lru_cache(maxsize=4)
def trained(pages: int = TRAIN_PAGES, seed: int = 11) -> Field:
    rng = random.Random(seed)
    rows = []
    for _ in range(pages):
        found = blocks_of(labelled_page(rng))
        if found:
            rows.append((matrix(found), [int(any(c.isupper() for c in b.text)) for b in found]))
    return Field.train(rows)


def main_text(page: str | None, field: Field) -> str:
    found = blocks_of(page) if page else []
    if not found:
        return ""
    return "\n".join(b.text for b, y in zip(found, field.decode(matrix(found))) if y)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    A page is cut into leaf blocks, each labelled main text or not by a linear-chain conditional random field on its
    ancestors' tags and names and on its text; text is the blocks labelled main text, joined by newlines.  Nothing is
    capped.  Null, empty and unparsable pages, and pages without main text, have the empty text and 0 characters.  Null ids and
    repeated rows are rows like any other; an empty table gives an empty result; other columns are ignored.

    The field is trained on train_pages labelled pages made for it, on the driver; it is a few hundred numbers.
    """
    ship(pages.sparkSession)
    field = trained(train_pages)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                text = [main_text(x, field) for x in part.column(2).to_pylist()]
                cols = [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
