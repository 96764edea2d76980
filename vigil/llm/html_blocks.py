"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks: pieces of text between block-level tags,
each with its tag path (tags, classes and ids of the open elements). A
bidirectional LSTM in numpy reads the sequence of a page's blocks, as vectors of
hashed path tokens, hashed words and a few sizes, so that every block is
classified with the whole document as context. Blocks labelled as main text are
joined in page order.

The labeller is trained on a bounded sample of pages (``TRAIN_PAGES``, the least
by a hash of the id) whose labels a teacher takes from unambiguous markup, and
on variants of them: containers renamed as sites name them, and menus, sidebars,
notices, adverts, forms and reader comments put around and into the article. In a
part of the variants all names are random letters on plain elements, so that only
lengths, links, sentences, leaves and the order of blocks tell. So the labeller
knows markup that the sample itself lacks. Pages are labelled where they lie;
only the sample and the weights pass through the driver.

Defined cases: null html counts as empty and gives an empty text; a page without
main text too; unclosed and unknown tags are read as browsers do (a new
paragraph ends the last one); an unfinished tag, comment or script at the end is
markup; a page of any length and depth is read whole, in time and memory that grow
with its length; a block with a score of exactly 0 is not main text; repeated rows get equal results; an
empty table gives an empty result; further columns are carried along.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, small_batches

TRAIN_PAGES = 240
EPOCHS = 10
PATH_DIM, WORD_DIM, SIZE_DIM = 96, 24, 6
DIM = PATH_DIM + WORD_DIM + SIZE_DIM
HIDDEN = 16

# Elements of HTML by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg math iframe object canvas".split())
BLOCK = set("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol
option p pre search section select summary table tbody td textarea tfoot th thead title tr ul""".split())
#: A start tag of the key closes an open element of the value, if nothing between bars it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "body": {"head", "title"}}
BARS = set("ul ol dl table div section article main body select".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-zA-Z]+")


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    for kind, a, b, c in _NAMES.findall(attributes):
        out += [f".{x.lower()}" for x in _PART.findall(entities.unescape(a or b or c))]
    return tuple(out)


class Path:
    """The distinct tokens of the open elements: those of the parent and own ones.
    A child without new tokens shares its parent's path."""

    __slots__ = ("parent", "own", "marks", "_vector")

    def __init__(self, parent: Path | None = None, own: tuple[str, ...] = ()):
        self.parent, self.own, self._vector = parent, own, None
        self.marks = parent.marks if parent else 0
        for t in own:
            self.marks |= _MARKS.get(t, 0)

    @classmethod
    def of(cls, tokens: tuple[str, ...]) -> Path:
        return cls(cls(), tuple(dict.fromkeys(tokens)))

    def vector(self) -> np.ndarray:
        """Hashed tokens, added to the nearest vector made above."""
        todo, at = [], self
        while at is not None and at._vector is None:
            todo.append(at)
            at = at.parent
        v = np.zeros(PATH_DIM, np.float32) if at is None else at._vector
        for node in reversed(todo):
            if node.own:
                v = v.copy()
                for t in node.own:
                    h = zlib.crc32(t.encode())
                    # Two places a token: a collision of one is told apart by the other.
                    v[h % PATH_DIM] += 1
                    v[(h // PATH_DIM) % PATH_DIM] += 0.5 if h & 1 else -0.5
            node._vector = v
        return v


def read_blocks(page: str) -> list[tuple[Path, str, int]]:
    """(path, text, characters inside links) of every leaf block."""
    out: list[tuple[Path, str, int]] = []
    stack: list[tuple[str, Path]] = []
    opened: dict[str, list[int]] = {}  # places of the open elements of a tag
    blocks: list[int] = []  # places of open block elements
    known: set[str] = set()  # tokens of the open elements
    root = Path()
    held: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((stack[-1][1] if stack else root, text, linked))
            held.clear()
        linked = 0

    def pop_to(n: int) -> None:
        nonlocal in_link
        while len(stack) > n:
            gone, path = stack.pop()
            in_link -= gone == "a"
            opened[gone].pop()
            if gone in BLOCK:
                blocks.pop()
            if path is not (stack[-1][1] if stack else root):
                known.difference_update(path.own)

    while at < len(page):
        m = _TOKEN.search(page, at)
        piece = page[at:m.start() if m else len(page)]
        if piece:
            held.append(piece)
            if in_link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if tag == "br":
            held.append(" ")
        if tag in BLOCK:
            flush()
        if m[1]:
            same = opened.get(tag)
            if same and (tag in BLOCK or not blocks or blocks[-1] < same[-1]):
                pop_to(same[-1])
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCK and any(opened.get(t) for t in ("p", *CLOSES.get(tag, ()))):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] in CLOSES.get(tag, ()):
                    pop_to(i)
                    if tag not in ("tr", "body"):
                        break
                elif stack[i][0] in BARS:
                    break
        if tag not in VOID and not m[3].endswith("/"):
            above = stack[-1][1] if stack else root
            own = tuple(t for t in dict.fromkeys(_tokens(tag, m[3])) if t not in known)
            known.update(own)
            opened.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append((tag, Path(above, own) if own else above))
            in_link += tag == "a"
    flush()
    return out


# What the teacher takes for certain, as plain values.
MAIN = {"article", "main", ".article", ".main"}
MAIN_NAMES = {".content", ".post", ".entry", ".story", ".articlebody"}
OTHER = {"nav", "aside", "footer", "form", "button", "select", "option", "label", "title", "head",
         ".nav", ".menu", ".sidebar", ".footer", ".header", ".ad", ".ads", ".advert", ".advertisement", ".sponsored",
         ".promo", ".banner", ".cookie", ".cookies", ".consent", ".notice", ".newsletter", ".subscribe",
         ".comment", ".comments", ".disqus", ".respond", ".share", ".sharing", ".social", ".related", ".recommended",
         ".breadcrumb", ".breadcrumbs", ".pagination", ".widget", ".popup", ".modal", ".login", ".search", ".tags",
         ".complementary", ".contentinfo", ".navigation"}


_IN_MAIN, _IN_OTHER, _IN_HEADER, _IN_ARTICLE = 1, 2, 4, 8
_MARKS = {t: _IN_MAIN * (t in MAIN | MAIN_NAMES) + _IN_OTHER * (t in OTHER) + _IN_HEADER * (t == "header")
          + _IN_ARTICLE * (t == "article") for t in MAIN | MAIN_NAMES | OTHER | {"header"}}


def teacher(path: Path) -> int:
    """1 inside an article and nothing else known, else 0."""
    marks = path.marks
    if marks & _IN_OTHER or marks & (_IN_HEADER | _IN_ARTICLE) == _IN_HEADER:
        return 0
    return 1 if marks & _IN_MAIN else 0


#: How variants name articles and boilerplate (tag, then class words).
_ARTICLES = ["article", "main", "main article", "div .content", "div .post", "div .entry .content", "div .article .body",
             "section .story", "div .main", "main .content article .post", "div .post .body", "article .entry"]
_ASIDE = ["nav", "nav .menu", "div .nav", "div .menu", "aside", "aside .sidebar", "div .sidebar", "div .widget",
          "footer", "div .footer", "footer .site", "header", "header .site", "div .header", "div .ad", "div .ads",
          "div .advert", "div .advertisement", "div .sponsored", "div .promo", "div .banner", "div .cookie .notice",
          "div .cookie .consent", "div .notice", "div .newsletter", "form", "form .search", "div .subscribe",
          "div .login", "div .breadcrumb", "div .breadcrumbs", "div .pagination", "div .popup", "div .modal"]
_INSIDE = ["section .comments", "div .comments", "div .comment", "ol .comment .list", "div .disqus", "div .respond",
           "aside", "div .share", "div .social", "div .related", "section .related", "div .recommended", "div .ad",
           "div .ads", "div .advert", "div .promo", "div .newsletter", "form", "div .tags", "div .sponsored"]
_LEAVES = [("p",), ("ul", "li"), ("ul", "li", "a"), ("div",), ("span",), ("h3",), ("label",), ("p", "b"), ("div", "p"), ()]
_BODY = [("p",), ("h1",), ("h2",), ("p", "b"), ("ul", "li"), ("blockquote", "p"), ("div", "p"), ("pre",), ("table", "tr", "td"),
         ("section", "p"), ("figure", "figcaption"), ()]


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_PLAIN = ["div", "div", "div", "section", "table tr td", "div div", "span"]
_SHORT = [("a",), ("a",), ("ul", "li", "a"), ("ul", "li", "a"), ("span", "a"), ("p", "a"), ("span",), ("p",), ("li",), ()]
_LONG = [("p",), ("p",), ("p",), ("p",), ("div",), ("div", "p"), ("p", "b"), ("blockquote",), ()]


def masked(pages: list[list], rng: random.Random) -> list[tuple[Path, str, int, int]]:
    """A made-up page whose names say nothing: running text under a heading is the
    article, short pieces and links before and after it are not."""
    pool = [b[1] for _ in range(4) for b in rng.choice(pages)]
    if rng.random() < 0.6:  # words of no known language
        pool = [re.sub("[^\\W\\d_]", lambda _: rng.choice(_LETTERS), t) for t in pool]
    long = [t for t in pool if len(t.split()) > 7] or pool
    out: list[tuple[Path, str, int, int]] = []

    def box() -> tuple[str, ...]:
        name = "".join(rng.choice(_LETTERS) for _ in range(rng.randint(3, 10)))
        return tuple(rng.choice(_PLAIN).split()) + (("." + name,) if rng.random() < 0.85 else ())

    def add(path: tuple[str, ...], text: str, main: int) -> None:
        out.append((Path.of(("html", "body") + path), text, len(text) if "a" in path else 0, main))

    def words(least: int, most: int) -> str:
        return " ".join(rng.choice(pool).split()[:rng.randint(least, most)]).rstrip(".!?…")

    def boiler(kinds: int) -> None:
        for _ in range(kinds):
            under, leaf = box(), rng.choice(_SHORT)
            for _ in range(rng.randint(1, 6)):
                text = words(1, 4) if "a" in leaf or rng.random() < 0.6 else words(2, 9)
                add(under + leaf, rng.choice(("© ", "")) + text if "a" not in leaf else text, 0)

    boiler(rng.randint(0, 3))
    under = box()
    if rng.random() < 0.8:
        add(under + (rng.choice(("h1", "h1", "h2")),), words(2, 14), 1)
    for _ in range(rng.randint(1, 12)):
        if rng.random() < 0.08:
            add(under + (rng.choice(("h2", "h3")),), words(1, 8), 1)
        add(under + rng.choice(_LONG), rng.choice(long), 1)
    boiler(rng.randint(0, 3))
    if rng.random() < 0.5:
        add(box() + rng.choice(((), (), ("p",), ("span",))), rng.choice(("© ", "© 2019 ", "")) + words(1, 8), 0)
    return out


def variant(pages: list[list], rng: random.Random) -> list[tuple[Path, str, int, int]]:
    """A made-up page: blocks of random pages under other containers."""
    pool = [b for _ in range(3) for b in rng.choice(pages)]
    take = lambda: rng.choice(pool)
    out: list[tuple[Path, str, int, int]] = []
    top = ("html", ".lang", "body") if rng.random() < 0.3 else ("html", "body")

    def boiler(under: tuple[str, ...], kinds: list[str]) -> None:
        box = under + tuple(rng.choice(kinds).split())
        for _ in range(rng.randint(1, 5)):
            _, text, _ = take()
            if rng.random() < 0.6:
                text = " ".join(text.split()[:rng.randint(1, 12)])
            leaf = rng.choice(_LEAVES)
            out.append((Path.of(box + leaf), text, len(text) if "a" in leaf else 0, 0))

    for _ in range(rng.randint(0, 3)):
        boiler(top, _ASIDE)
    art = top + tuple(rng.choice(_ARTICLES).split())
    for _ in range(rng.randint(1, 14)):
        _, text, _ = take()
        out.append((Path.of(art + rng.choice(_BODY)), text, 0, 1))
        if rng.random() < 0.12:
            boiler(art, _INSIDE)
    for _ in range(rng.randint(0, 3)):
        boiler(art if rng.random() < 0.3 else top, _INSIDE + _ASIDE)
    for _ in range(rng.randint(0, 2)):
        boiler(top, _ASIDE)
    return out


class Vectors:
    """Vectors of blocks, with a bounded cache of hashed words."""

    MOST = 200_000

    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def page(self, blocks: list) -> np.ndarray:
        x = np.zeros((len(blocks), DIM), np.float32)
        words = self.words
        for i, (path, text, linked, *_) in enumerate(blocks):
            x[i, :PATH_DIM] = path.vector()
            own = text.split()
            places = []
            for w in own:
                h = words.get(w)
                if h is None:
                    h = zlib.crc32(w.encode()) % WORD_DIM
                    if len(words) < self.MOST:
                        words[w] = h
                places.append(h)
            x[i, PATH_DIM:PATH_DIM + WORD_DIM] = np.sqrt(np.bincount(places, minlength=WORD_DIM) / len(own))
            x[i, PATH_DIM + WORD_DIM:] = (
                np.log1p(len(own)) / 5, linked / max(1, len(text)), text[-1] in ".!?…", i / len(blocks),
                min(1.0, len(blocks) / 50), 1.0)
        return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output over both states and the block."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {}
        for side in "fb":
            self.w[side] = (rng.standard_normal((DIM + h, 4 * h)) / np.sqrt(DIM + h)).astype(np.float32)
            self.w[side + "0"] = np.zeros(4 * h, np.float32)
            self.w[side + "0"][h:2 * h] = 1
        self.w["o"] = (rng.standard_normal(2 * h + DIM) / 10).astype(np.float32)
        self.w["o0"] = np.zeros(1, np.float32)

    def _run(self, side: str, x: np.ndarray, live: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction; x is steps x pages x DIM, live marks blocks."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        w, n = self.w[side], HIDDEN
        drive = x @ w[:DIM] + self.w[side + "0"]
        out = np.zeros((steps, pages, n), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = drive[t] + h @ w[DIM:]
            g = _sigmoid(z[:, :3 * n])
            u = np.tanh(z[:, 3 * n:])
            on = live[t][:, None]
            c2 = g[:, n:2 * n] * c + g[:, :n] * u
            s = np.tanh(c2)
            if keep is not None:
                keep.append((t, h, c, g, u, c2, s))
            h, c = np.where(on, g[:, 2 * n:] * s, h), np.where(on, c2, c)
            out[t] = h
        return out

    def scores(self, x: np.ndarray, live: np.ndarray, keep: dict | None = None) -> np.ndarray:
        both = []
        for side in "fb":
            kept: list | None = None if keep is None else []
            both.append(self._run(side, x, live, kept))
            if keep is not None:
                keep[side] = kept
        if keep is not None:
            keep["joint"] = np.concatenate([*both, x], axis=2)
        own, n = self.w["o"], HIDDEN
        return both[0] @ own[:n] + both[1] @ own[n:2 * n] + x @ own[2 * n:] + self.w["o0"][0]

    def gradient(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        keep: dict = {}
        p = _sigmoid(self.scores(x, live, keep))
        n, total = HIDDEN, max(1, live.sum())
        d = np.where(live, p - y, 0).astype(np.float32) / total
        loss = -np.sum(np.where(live, y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7), 0)) / total
        grad = {"o": np.einsum("tp,tpd->d", d, keep["joint"]), "o0": np.array([d.sum()], np.float32)}
        for k, side in enumerate("fb"):
            w = self.w[side]
            gw, g0 = np.zeros_like(w), np.zeros_like(self.w[side + "0"])
            dh, dc = np.zeros_like(keep[side][0][1]), np.zeros_like(keep[side][0][1])
            own = self.w["o"][k * n:(k + 1) * n]
            for t, h, c, g, u, c2, s in reversed(keep[side]):
                on = live[t][:, None]
                dh = dh + d[t][:, None] * own
                a, b = np.where(on, dh, 0), np.where(on, dc, 0)
                b = b + a * g[:, 2 * n:] * (1 - s * s)
                dz = np.concatenate([b * u * g[:, :n] * (1 - g[:, :n]),
                                     b * c * g[:, n:2 * n] * (1 - g[:, n:2 * n]),
                                     a * s * g[:, 2 * n:] * (1 - g[:, 2 * n:]),
                                     b * g[:, :n] * (1 - u * u)], axis=1)
                gw[:DIM] += x[t].T @ dz
                gw[DIM:] += h.T @ dz
                g0 += dz.sum(axis=0)
                dh = np.where(on, dz @ w[DIM:].T, dh)
                dc = np.where(on, b * g[:, n:2 * n], dc)
            grad[side], grad[side + "0"] = gw, g0
        return grad, float(loss)

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01,
            seed: int = 7, together: int = 24) -> list[float]:
        rng = random.Random(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        losses, step = [], 0
        for _ in range(epochs):
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i][0]) + 8 * rng.random(), i))
            groups = [order[i:i + together] for i in range(0, len(order), together)]
            rng.shuffle(groups)
            losses.append(0.0)
            for group in groups:
                x, live = pad([pages[i][0] for i in group])
                y = np.zeros(live.shape, np.float32)
                for j, i in enumerate(group):
                    y[:len(pages[i][1]), j] = pages[i][1]
                grad, loss = self.gradient(x, live, y)
                losses[-1] += loss / len(groups)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return losses

    def label(self, pages: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
        """Which blocks of each page are main text; pages of like length together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and len(pages[order[to]]) * (to + 1 - at) <= cells:
                to += 1
            x, live = pad([pages[i] for i in order[at:to]])
            s = self.scores(x, live)
            for j, i in enumerate(order[at:to]):
                out[i] = s[:len(pages[i]), j] > 0
            at = to
        return out


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(pages) == 1:
        return pages[0][:, None], np.ones((len(pages[0]), 1), bool)
    steps = max(len(p) for p in pages)
    x, live = np.zeros((steps, len(pages), DIM), np.float32), np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[:len(p), j], live[:len(p), j] = p, True
    return x, live


def train(sample: list[str], variants: int = 360, nameless: int = 480, seed: int = 7) -> Labeller:
    """A labeller from pages (html) and made-up variants of them, some nameless."""
    rng = random.Random(seed)
    blocks = [b for b in map(read_blocks, sample) if b]
    made = [[(*b, teacher(b[0])) for b in page] for page in blocks
            if any(teacher(b[0]) for b in page)]
    if blocks:
        made += [variant(blocks, rng) for _ in range(variants)]
        made += [masked(blocks, rng) for _ in range(nameless)]
    vec = Vectors()
    out = Labeller(seed)
    if made:
        out.fit([(vec.page(p), np.array([b[3] for b in p], np.float32)) for p in made], seed=seed)
    return out


def training_pages(pages: DataFrame, id_col: str, html_col: str, n: int = TRAIN_PAGES) -> list[str]:
    """At most ``n`` pages, the least by a hash of the id. Only hashes are sorted;
    of pages with one hash, the least html counts."""
    rows = pages.where(F.col(html_col).isNotNull()).select(
        F.xxhash64(F.col(id_col)).alias("h"), F.col(html_col).alias("html"))
    least = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(n).collect()]
    taken = rows.where(F.col("h").isin(least)).groupBy("h").agg(F.min("html").alias("html"))
    return [r["html"] for r in sorted(taken.collect(), key=lambda r: r["h"])] if least else []


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
            carry: list[str] | None = None, labeller: Labeller | None = None) -> DataFrame:
    """``carry`` columns (all by default) with text, n_chars, n_blocks (all of
    the page) and n_main (those labelled as main text)."""
    small_batches(pages.sparkSession)
    carry = pages.columns if carry is None else carry
    made = labeller or train(training_pages(pages, id_col, html_col))
    shared = pages.sparkSession.sparkContext.broadcast(made)  # fixed size
    inner = [T.StructField(f"c{i}_", pages.schema[c].dataType) for i, c in enumerate(carry)]
    found = [("text", T.StringType()), ("n_chars", T.LongType()), ("n_blocks", T.LongType()), ("n_main", T.LongType())]
    schema = T.StructType(inner + [T.StructField(f"x{i}_", k) for i, (_, k) in enumerate(found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec, model = Vectors(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                blocks = [read_blocks(h or "") for h in part.column(part.num_columns - 1).to_pylist()]
                keep = model.label([vec.page(b) for b in blocks])
                texts = ["\n".join(b[1] for b, k in zip(page, own) if k) for page, own in zip(blocks, keep)]
                yield pa.RecordBatch.from_arrays(
                    part.columns[:-1] + [
                        pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                        pa.array(map(len, blocks), pa.int64()),
                        pa.array([int(k.sum()) for k in keep], pa.int64())], names=schema.names)

    out = pages.select(*[F.col(c).alias(f.name) for c, f in zip(carry, inner)],
                       F.col(html_col).alias("x_html")).mapInArrow(run, schema)
    return out.toDF(*carry, *[free_name(carry, n) for n, _ in found])
