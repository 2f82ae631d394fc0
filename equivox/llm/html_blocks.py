"""HTML extraction: a recurrent labeller of blocks.

A page is cut into leaf blocks: stretches of text without a block-level tag inside.  Each block is a
vector of its tag path (hashed tag names and class and id words), its hashed words and a few measures;
a bidirectional LSTM reads the page's blocks in order, so each block is labelled in the context of the
whole page.  Blocks labelled as main text are joined in order.  Scripts, styles, comments and markup
never become text; all other elements do, if their blocks are labelled so.

The network is numpy.  It is trained on the driver, once a session, on pages that
``training_pages`` writes: varied templates with menus, headers, notices, adverts, articles, sidebars,
forms, reader comments and footers whose roles are known.

Pages of like length go through the network together, a bounded number of blocks at once; a page over that bound goes
alone, in pieces: each direction carries its state from piece to piece, so the whole page is the context, and
only a few numbers a block are held.

Nulls and edge cases: null html is empty; a page without main text gives an empty text; repeated pages
and null ids stay; very long pages and deep nesting are labelled whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH, WORDS, MEASURES = 96, 32, 8
INPUT = PATH + WORDS + MEASURES
HIDDEN = 16
SEED = 5
PAGES = 500
BLOCKS_AT_ONCE = 4096

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input svg math mi mn mo ms mrow msup msub mfrac mtext semantics annotation object iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
SCOPE = frozenset("html body div article section main aside nav header footer table ul ol dl form td th select blockquote".split())


def blocks(page: str) -> list[tuple[int, str, str, int]]:
    """(path, innermost word, text, characters inside links) of each leaf block with text, in order.  A path is the set of
    the hashed words of its tags, as bits; text is decoded and its white space is single spaces."""
    found, stack, parts, linked, at = [], [], [], 0, 0  # stack: (tag, path, innermost word)
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                _, path, last = stack[-1] if stack else ("", 0, "")
                found.append((path, last, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(names: set[str], scope: frozenset) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                opened.subtract(t for t, _, _ in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    end = page.rfind(">") + 1  # what follows the last of these holds no tag
    for m in TOKEN.finditer(page, 0, end):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if stack and any(tag == "a" for tag, _, _ in stack[-3:]):
                linked += m.start() - at
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
            continue
        if m[2]:
            if opened[tag]:
                close({tag}, frozenset())
            continue
        if tag not in INLINE:
            if tag in CLOSES:
                if any(opened[t] for t in CLOSES[tag]):
                    close(CLOSES[tag], SCOPE - CLOSES[tag])
            elif opened["p"]:
                close({"p"}, SCOPE)
        if tag not in VOID and not m[0].endswith("/>"):
            words = [f"<{tag}>"]
            if m[4]:
                for a in ATTRIBUTE.finditer(m[4]):
                    words += re.findall(r"[a-z]+", (a[1] or a[2] or a[3] or "").lower())
            path = stack[-1][1] if stack else 0
            for w in words:
                path |= 1 << crc32(w.encode()) % PATH
            stack.append((tag, path, words[-1]))
            opened[tag] += 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return found


def features(found: list[tuple[int, str, str, int]], first: int = 0, last: int | None = None) -> np.ndarray:
    """One row a block, of the blocks from first to last (without it) of a page."""
    n, own_blocks = len(found), found[first:last]
    x = np.zeros((len(own_blocks), INPUT), np.float32)
    paths, words, owner = {}, [], []
    for k, (path, innermost, text, linked) in enumerate(own_blocks):
        row = paths.get((path, innermost))
        if row is None:
            row = np.array([path >> b & 1 for b in range(PATH)], np.float32)
            if innermost:
                row[crc32(innermost.encode() + b"/") % PATH] += 0.5
            paths[path, innermost] = row
        x[k, :PATH] = row
        own = [crc32(w) % WORDS for w in text.lower().encode("utf-8", "surrogatepass").split()]
        words += own
        owner.append(len(own))
        at = first + k
        x[k, PATH + WORDS :] = (len(text) / 400 if len(text) < 2000 else 5, len(own) / 60 if len(own) < 300 else 5, linked / len(text), (text.count(".") + text.count(",")) / len(own), at / n, 1 / (1 + at), 1 / (n - at), text[-1] in ".!?")
    if words:
        counts = np.bincount(np.repeat(np.arange(len(own_blocks)), owner) * WORDS + np.array(words), minlength=len(own_blocks) * WORDS).reshape(-1, WORDS)
        x[:, PATH : PATH + WORDS] = np.sqrt(counts / counts.sum(1, keepdims=True))
    return x


# --- the network ---------------------------------------------------------------------------------


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def run_lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool, state: list | None = None):
    """x (steps, rows, inputs) -> hidden states; with keep also what the backward pass needs.  A state (h, c) is
    where the steps go on from; it is left as they end."""
    h, c = state or (np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32))
    states, kept, pre = np.zeros((*x.shape[:2], HIDDEN), np.float32), [], x @ w + b
    for t in range(len(x)):
        z = pre[t] + h @ u
        s = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        on = mask[t][:, None]
        new_c = np.where(on, f * c + i * g, c)
        tanh_c = np.tanh(new_c)
        new_h = np.where(on, o * tanh_c, h)
        if keep:
            kept.append((h, c, i, f, o, g, tanh_c, on))
        h, c = new_h, new_c
        states[t] = h
    if state is not None:
        state[:] = h, c
    return states, kept


def back_lstm(x, kept, u, grad):
    """Gradients of w, u, b for grad, that of the states."""
    dw, du, db = np.zeros((x.shape[2], 4 * HIDDEN), np.float32), np.zeros_like(u), np.zeros(4 * HIDDEN, np.float32)
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, tanh_c, on = kept[t]
        dh = dh + grad[t]
        live = np.where(on, dh, 0)
        dcell = np.where(on, dc + live * o * (1 - tanh_c**2), 0)
        dz = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), live * tanh_c * o * (1 - o), dcell * i * (1 - g**2)], 1)
        dw += x[t].T @ dz
        du += h.T @ dz
        db += dz.sum(0)
        dh = np.where(on, dz @ u.T, dh)
        dc = np.where(on, dcell * f, dc)
    return dw, du, db


def forward(x, mask, p, keep=False):
    a, kept_a = run_lstm(x, mask, p["wa"], p["ua"], p["ba"], keep)
    b, kept_b = run_lstm(x[::-1], mask[::-1], p["wb"], p["ub"], p["bb"], keep)
    both = np.concatenate([a, b[::-1]], 2)
    return both @ p["v"] + x @ p["s"] + p["d"], both, kept_a, kept_b


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), bool)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, True
    return x, mask


def train(pages: list[np.ndarray], labels: list[np.ndarray], steps: int = 350, rows: int = 24, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Adam on the mean cross entropy of blocks."""
    rng = np.random.default_rng(SEED)
    shapes = {"wa": (INPUT, 4 * HIDDEN), "ua": (HIDDEN, 4 * HIDDEN), "ba": (4 * HIDDEN,), "wb": (INPUT, 4 * HIDDEN), "ub": (HIDDEN, 4 * HIDDEN), "bb": (4 * HIDDEN,), "v": (2 * HIDDEN,), "s": (INPUT,), "d": ()}
    p = {k: (rng.standard_normal(s) * 0.15 if s and k[0] != "b" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        own = rng.choice(len(pages), rows, replace=False)
        x, mask = padded([pages[k] for k in own])
        y = np.zeros(mask.shape, np.float32)
        for k, page in enumerate(own):
            y[: len(labels[page]), k] = labels[page]
        z, both, kept_a, kept_b = forward(x, mask, p, True)
        dz = (np.where(mask, sigmoid(z) - y, 0) / mask.sum()).astype(np.float32)
        grad = dz[..., None] * p["v"]
        g = {"v": np.einsum("tr,trh->h", dz, both), "s": np.einsum("tr,tri->i", dz, x), "d": dz.sum()}
        g["wa"], g["ua"], g["ba"] = back_lstm(x, kept_a, p["ua"], grad[..., :HIDDEN])
        g["wb"], g["ub"], g["bb"] = back_lstm(x[::-1], kept_b, p["ub"], grad[::-1, :, HIDDEN:])
        for k in p:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
            p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-7) - 1e-5 * p[k]).astype(np.float32)
    return p


def label(pages: list[np.ndarray], p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Whether each block is main text; pages of like length go through together."""
    out: list = [np.zeros(0, bool)] * len(pages)
    order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if len(pages[k])]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= BLOCKS_AT_ONCE:
            end += 1
        own = order[at:end]
        z = forward(*padded([pages[k] for k in own]), p)[0]
        for k, page in enumerate(own):
            out[page] = z[: len(pages[page]), k] > 0
        at = end
    return out


def label_long(found: list, p: dict[str, np.ndarray], size: int = BLOCKS_AT_ONCE) -> np.ndarray:
    """The labels of one page's blocks, by pieces of the given size."""
    fresh = lambda: [np.zeros((1, HIDDEN), np.float32), np.zeros((1, HIDDEN), np.float32)]
    z, state = np.zeros(len(found), np.float32), fresh()
    for at in range(0, len(found), size):
        x = features(found, at, at + size)[:, None]
        a, _ = run_lstm(x, np.ones(x.shape[:2], bool), p["wa"], p["ua"], p["ba"], False, state)
        z[at : at + size] = (a @ p["v"][:HIDDEN] + x @ p["s"] + p["d"])[:, 0]
    state = fresh()
    for at in reversed(range(0, len(found), size)):
        x = features(found, at, at + size)[::-1, None]
        b, _ = run_lstm(x, np.ones(x.shape[:2], bool), p["wb"], p["ub"], p["bb"], False, state)
        z[at : at + size] += (b @ p["v"][HIDDEN:])[::-1, 0]
    return z > 0


# --- training pages --------------------------------------------------------------------------------


def training_pages(n: int, seed: int) -> list[tuple[str, list[tuple[bool, str]]]]:
    """(html, [(is main text, text)] of its blocks in order)."""
    rng = np.random.default_rng(seed)
    syllables = [a + b for a in ("", "b", "d", "st", "th", "l", "m", "r", "sch", "qu", "n", "p") for b in ("a", "e", "in", "er", "on", "ou", "ie", "ä", "é", "os")]
    pick = lambda *of: of[int(rng.integers(len(of)))]
    chance = lambda q: rng.random() < q

    def words(lo: int, hi: int) -> str:
        style = rng.random()
        n = int(rng.integers(lo, hi + 1))
        parts, lengths = rng.integers(0, len(syllables), (n, 3)).tolist(), rng.integers(1, 4, n).tolist()
        ws = ["".join(syllables[k] for k in own[:length]) for own, length in zip(parts, lengths, strict=True)]
        if style < 0.08:
            return " ".join(w.upper() + "!!" for w in ws)
        if style < 0.16:
            return " ".join(w + pick("***", "###", "$$$", "%%%") for w in ws)
        text = " ".join(w + ("," if chance(0.08) else ". " + pick("A", "In", "La", "Der") if chance(0.08) else "") for w in ws).capitalize()
        return text + (pick(".", ".", "!", "") if hi > 6 else "")

    pages = []
    for _ in range(n):
        out, roles = [], []

        def put(main: bool, text: str, before: str = "", after: str = "") -> None:
            inner = text.replace("&", "&amp;").replace("<", "&lt;")
            if chance(0.12) and " " in inner:
                a, b = inner.split(" ", 1)
                inner = f"<{pick('b', 'em', 'a href=#', 'span')}>{a}</{'x'}> {b}".replace("</x>", "") if chance(0.2) else f"<em>{a}</em> {b}"
            out.append(before + inner + after)
            roles.append((main, " ".join(text.split())))

        def links(k: int) -> None:
            out.append(pick("<ul>", '<ul class="menu">', '<ul class="links">'))
            for _ in range(k):
                put(False, words(1, 4), f'<li><a href="/{int(rng.integers(99))}">', "</a></li>")
            out.append("</ul>")

        def box(opening: str, closing: str, fill) -> None:
            out.append(opening)
            fill()
            out.append(closing)

        def article_body() -> None:
            if chance(0.85):
                put(True, words(2, 14), "<h1>", "</h1>")
            if chance(0.2):
                put(True, words(2, 6), pick('<p class="byline">', "<p>", '<div class="meta">'), pick("</p>", "</div>"))
            for _ in range(int(rng.integers(1, 9))):
                what = rng.random()
                if what < 0.72:
                    opening = pick("<p>", "<p>", "<p>", '<p class="text">')
                    if chance(0.15):
                        put(True, words(1, 50), opening + "<b>", "<br>")
                    else:
                        put(True, words(1, 80), opening, pick("</p>", "</p>", "</p>", ""))
                elif what < 0.8:
                    put(True, words(2, 8), "<h2>", "</h2>")
                elif what < 0.88:
                    out.append("<ul>")
                    for _ in range(int(rng.integers(1, 5))):
                        put(True, words(2, 20), "<li>", "</li>")
                    out.append("</ul>")
                elif what < 0.94:
                    put(True, words(5, 40), "<blockquote>", "</blockquote>")
                else:
                    put(True, words(2, 12), "<table><tr><td>", "</td>")
                    put(True, words(2, 12), "<td>", "</td></tr></table>")
                if chance(0.05):
                    put(False, words(3, 14), pick('<div class="ad">', '<div class="ad-slot">', '<aside class="advert">'), pick("</div>", "</aside>"))

        out.append("<!DOCTYPE html><html><head><meta charset=utf-8>")
        put(False, words(1, 10), "<title>", "</title>")
        out.append('<style>p{margin:0}</style><script>var t="</p>";</script></head><body>')
        if chance(0.35):
            box(pick("<header>", '<div class="header">', '<div id="banner">'), pick("</header>", "</div>", "</div>"), lambda: put(False, words(1, 8), pick("<p>", "<div>", "<h2>"), pick("</p>", "</div>", "</h2>")))
        if chance(0.85):
            kind = pick("<nav>", "<nav>", '<nav class="main-nav">', '<div class="menu">', '<div id="navigation">')
            box(kind, "</nav>" if kind.startswith("<nav") else "</div>", lambda: links(int(rng.integers(2, 9))))
        if chance(0.3):
            put(False, words(4, 25), pick('<div class="cookie">', '<div class="cookie-notice">', '<div class="notice">', '<div id="consent">', '<div role="alert" class="banner">', '<section class="notice">') + pick("", "<p>"), "</div>")
        out.append("<!-- ad 3 -->" if chance(0.5) else "")
        for _ in range(int(rng.integers(0, 3))):
            put(False, words(3, 25), pick('<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="sponsored">', '<div class="promo">', '<ins class="adsbygoogle">'), "</div>")
        if chance(0.2):
            put(False, words(2, 8), pick('<div class="breadcrumb">', '<ol class="breadcrumbs"><li>'), pick("</div>", "</ol>"))
        if chance(0.25):
            box(pick("<aside>", '<aside class="sidebar">', '<div class="sidebar">', '<div id="related">'), pick("</aside>", "</div>"), lambda: (put(False, words(1, 6), "<h3>", "</h3>"), links(int(rng.integers(1, 6))), put(False, words(4, 30), "<p>", "</p>")))
        kind = pick("article", "article", "article", "article", 'article class="post"', "main", 'div class="content"', 'div id="main"', 'div class="article-body"', 'section class="entry-content"')
        if chance(0.93):
            box(f"<{kind}>", f"</{kind.split()[0]}>", article_body)
        if chance(0.3):
            box(pick("<aside>", '<aside class="sidebar">', '<div class="sidebar">', '<div class="related">', '<div class="share">'), pick("</aside>", "</div>"), lambda: (put(False, words(1, 6), "<h3>", "</h3>"), links(int(rng.integers(1, 6))), put(False, words(4, 60), "<p>", "</p>")))
        if chance(0.3):
            box(pick("<form>", '<form class="newsletter">', '<form id="search">'), "</form>", lambda: (put(False, words(1, 6), "<label>", "</label>"), out.append('<input type="text">'), put(False, words(1, 3), "<button>", "</button>"), put(False, words(3, 20), "<p>", "</p>")))
        if chance(0.35):
            kind = pick('<section id="comments">', '<div class="comments">', '<div id="comments">', '<section class="comments">', '<ol class="comment-list">')
            out.append(kind)
            if chance(0.6):
                put(False, words(1, 5), "<h2>", "</h2>")
            for _ in range(int(rng.integers(1, 5))):
                if chance(0.4):
                    put(False, words(1, 3), '<div class="comment-author">', "</div>")
                put(False, words(2, 70), pick('<div class="comment">', '<p class="comment">', "<p>", '<div class="comment"><p>', "<article class=comment><p>"), pick("</p></div>", "</div>", "</p></article>"))
            out.append("</section></div></ol>")
        if chance(0.9):
            text, kind = "© " * chance(0.7) + words(1, 30), pick("<footer>", "<footer>", '<footer class="site-footer">', '<div class="footer">', '<div id="footer">')
            put(False, text, kind + pick("", "<p>"), "</footer>" if kind.startswith("<footer") else "</div>")
        out.append("</body></html>")
        pages.append(("".join(out), roles))
    return pages


def examples(n: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Feature rows and labels of written pages whose blocks are as they were written."""
    xs, ys = [], []
    for page, roles in training_pages(n, seed):
        found = blocks(page)
        if [t for _, _, t, _ in found] == [t for _, t in roles if t]:
            xs.append(features(found))
            ys.append(np.array([main for main, t in roles if t], np.float32))
    return xs, ys


@lru_cache(maxsize=1)
def network() -> dict[str, np.ndarray]:
    return train(*examples(PAGES, SEED))


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) -> (page_id, url, text, n_chars)."""
    p = network()

    def labelled(pages: list[tuple]) -> pd.DataFrame:
        marks = label([features(found) for _, _, found in pages if len(found) <= BLOCKS_AT_ONCE], p)
        short, texts = iter(marks), []
        for _, _, found in pages:
            main = next(short) if len(found) <= BLOCKS_AT_ONCE else label_long(found, p)
            texts.append(" ".join(b[2] for b, y in zip(found, main, strict=True) if y))
        ids = pd.array([None if pd.isna(i) else int(i) for i, _, _ in pages], dtype="Int64")
        return pd.DataFrame({"page_id": ids, "url": [u for _, u, _ in pages], "text": texts, "n_chars": [len(t) for t in texts]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for page_id, url, page in zip(batch["page_id"].astype("Int64"), batch["url"], batch["html"], strict=True):
                found = blocks(page) if page else []
                held.append((page_id, url, found))
                size += 1 + len(found)
                if size >= 8 * BLOCKS_AT_ONCE:
                    yield labelled(held)
                    held, size = [], 0
        if held:
            yield labelled(held)

    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return plain.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op3(spark, sf_dir: str) -> DataFrame:
    from equivox.llm.session import table

    return extract(table(spark, sf_dir, "pages"))
