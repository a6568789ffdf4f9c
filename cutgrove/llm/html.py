"""Main text of web pages by a recurrent block labeller.

A scanner cuts the page into leaf blocks: text between block-level tags, with the path of open tags. Each block becomes
a vector of hashed tag-path parts (names, classes, ids, roles), hashed words and a few counts; a bidirectional LSTM in
numpy reads the page's block sequence both ways and labels every block as main text or not. The network is trained
here, once a process, on pages made by rule from a seed.

Character references are decoded, white space inside a block becomes one space, empty blocks go, blocks are joined by a
line feed. The content of RAW elements is no text of the page: scripts and styles without a close tag reach to the end of
the page, of the others only the tag goes then; a self-closed one is empty. A null or empty page gives an empty text; a
page cut off in the middle is read as far as it goes; repeated rows stay; other columns are not read; an empty table gives
no rows. Very long and deeply nested pages are labelled in one sequence, whatever their length, in linear time and memory.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

#: Tags that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark object q s samp small span strike strong sub sup time tt u var wbr math mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template svg iframe textarea select title".split())
TO_THE_END = frozenset(("script", "style"))
RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
PARAGRAPH_ENDS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_ENDING = frozenset("li dt dd tr td th option".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PART = re.compile(r"[A-Za-z]+")
PATH_DIM, WORD_DIM = 96, 64
COUNTS = 6
WIDTH = PATH_DIM + WORD_DIM + COUNTS


class Path:
    """An open element: its tag name with its marks, and the path of elements around it."""

    __slots__ = ("parent", "name", "entry", "depth", "in_link", "row")

    def __init__(self, parent: Path | None, name: str, entry: str):
        self.parent, self.name, self.entry, self.row = parent, name, entry, None
        self.depth = parent.depth + 1 if parent else 0
        self.in_link = name == "a" or bool(parent and parent.in_link)


def blocks(page: str) -> list[tuple[Path, str]]:
    """(tag path, text) of every leaf block with text, in page order; linear in the page."""
    out: list[tuple[Path, str]] = []
    top = path = Path(None, "", "")  # the innermost open element, and the path of the current block
    opened: Counter = Counter()
    text: list[str] = []
    unclosed: set[str] = set()

    def end_block():
        nonlocal text
        if text:
            # references are decoded block by block; only the six ASCII spaces and other Unicode spaces separate words
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                out.append((path, joined))
            text = []

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name not in INLINE:
                end_block()
            if opened[name]:
                while top.name != name:
                    opened[top.name] -= 1
                    top = top.parent
                opened[name] -= 1
                path = top = top.parent
            continue
        empty = m.group(3).endswith("/")
        if name in RAW:
            end_block()
            if not empty and name not in unclosed:
                if close := RAW_END[name].search(page, at):
                    at = close.end()
                elif name in TO_THE_END:
                    break
                else:
                    unclosed.add(name)
            continue
        if name not in INLINE:
            end_block()
            if (name in PARAGRAPH_ENDS and top.name == "p") or (name in SELF_ENDING and top.name == name):
                opened[top.name] -= 1
                top = top.parent
        if name in VOID or empty:
            path = top
            continue
        marks = "".join(f" {p.lower()}" for _, v in ATTR.findall(m.group(3)) for p in PART.findall(v)) if "=" in m.group(3) else ""
        opened[name] += 1
        top = Path(top, name, name + marks)
        if not (name in INLINE and text and not marks):  # a plain inline element inside running text belongs to the block that has begun
            path = top
    end_block()
    return out


_hash: dict[str, int] = {}


def slot(x: str, n: int) -> int:
    if (h := _hash.get(x)) is None:
        h = zlib.crc32(x.encode())
        if len(_hash) < 50_000:
            _hash[x] = h
    return h % n


def path_row(path: Path) -> np.ndarray:
    """Marks of all entries on the path, without those of the leaf's own kind; kept on the path for its children."""
    todo = []
    while path.row is None:
        todo.append(path)
        if path.parent is None:
            path.row = np.zeros(PATH_DIM, np.float32)
            break
        path = path.parent
    row = path.row
    for path in reversed(todo):
        row = row.copy()
        for x in path.entry.split():
            row[slot("p" + x, PATH_DIM)] = 1.0
        path.row = row
    return row


def vectors(found: list[tuple[Path, str]]) -> np.ndarray:
    out = np.zeros((len(found), WIDTH), np.float32)
    for i, (path, text) in enumerate(found):
        out[i, :PATH_DIM] = path_row(path)
        if path.name:
            out[i, slot("leaf" + path.name, PATH_DIM)] = 1.0
        words = text.lower().split(" ")
        share = 1.0 / len(words)
        for w in words:
            out[i, PATH_DIM + slot(w, WORD_DIM)] += share
        out[i, -COUNTS:] = (math.log1p(len(words)) / 5, math.log1p(len(text)) / 8, "©" in text[:2], text[-1] in ".!?", min(path.depth, 50) / 10, path.in_link)
    return out


HIDDEN = 16


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """One LSTM in each direction over batches of padded sequences, and a logistic layer on both states."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, 0.15, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.p[f"h{d}"] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(4 * HIDDEN, np.float32)
        self.p["o"] = r.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)

    def _run(self, x, mask, d, tape=None):
        order = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        h = np.zeros((x.shape[0], HIDDEN), np.float32)
        c = h.copy()
        states = np.zeros((x.shape[0], x.shape[1], HIDDEN), np.float32)
        pre = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        for t in order:
            z = pre[:, t] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if tape is not None:
                tape.append((t, h, c, i, f, o, g, tc, m))
            c = m * c2 + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            states[:, t] = h
        return states

    def predict(self, x, mask):
        both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], 2)
        return _sigmoid(both @ self.p["o"] + self.p["ob"])

    def step(self, x, mask, y, adam, rate):
        tapes = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, d, tapes[d]) for d in "fb"], 2)
        p = _sigmoid(both @ self.p["o"] + self.p["ob"])
        err = (p - y) * mask / mask.sum()
        grad = {"o": np.einsum("bt,bth->h", err, both), "ob": np.array([err.sum()], np.float32)}
        dboth = err[:, :, None] * self.p["o"]
        for n, d in enumerate("fb"):
            dstates = dboth[:, :, n * HIDDEN : (n + 1) * HIDDEN]
            dh = np.zeros((x.shape[0], HIDDEN), np.float32)
            dc = dh.copy()
            dz_all = np.zeros((x.shape[0], x.shape[1], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.p[f"h{d}"])
            for t, h0, c0, i, f, o, g, tc, m in reversed(tapes[d]):
                dh = dh + dstates[:, t]
                dh2, dc_in = dh * m, dc * m
                do = dh2 * tc
                dc2 = dc_in + dh2 * o * (1 - tc**2)
                dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c0 * f * (1 - f), do * o * (1 - o), dc2 * i * (1 - g**2)], 1)
                dz_all[:, t] = dz
                gh += h0.T @ dz
                dh = dh * (1 - m) + dz @ self.p[f"h{d}"].T
                dc = dc * (1 - m) + dc2 * f
            grad[f"x{d}"] = np.einsum("bti,btj->ij", x, dz_all, optimize=True)
            grad[f"h{d}"], grad[f"c{d}"] = gh, dz_all.sum((0, 1))
        adam["t"] += 1
        for k, g in grad.items():
            m, v = adam.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            adam[k] = m, v
            self.p[k] -= (rate * (m / (1 - 0.9 ** adam["t"])) / (np.sqrt(v / (1 - 0.99 ** adam["t"])) + 1e-8)).astype(np.float32)
        q = np.clip(np.where(y > 0.5, p, 1 - p), 1e-6, 1)
        return float(-(np.log(q) * mask).sum() / mask.sum())


#: Common words of page furniture, and common words of running text in four languages.
FURNITURE = "home about contact login logout register search menu subscribe newsletter sign up cookies cookie accept privacy policy terms conditions share follow tweet related posts recommended popular read more next previous comments reply leave comment advertisement sponsored ad buy now sale offer copyright all rights reserved powered by sitemap help support careers press email password submit cancel close skip to content back top facebook twitter click here tags category archive rss".split()
RUNNING = "the of and to in is that was for it with as his on be at by had not are but from which der die und das den von zu mit sich auf nicht ein eine auch als le la les et des du que dans une pour pas sur est el los las que por con para una su del como más".split()


def made_page(r: random.Random) -> list[tuple[str, int]]:
    """Pieces of HTML with a label each: 1 main text, 0 boilerplate, -1 markup without text.

    Words are made of syllables; on most pages some of the furniture's words and of the running text's come from the
    fixed lists, on the others nothing but place and markup tells them apart.
    """
    syllables = [c + v for c in "bcdfghklmnprstvw" for v in "aeiou"]
    known = r.choice((0.0, 0.2, 0.5))  # the share of words from the lists
    speech = [RUNNING]

    def word():
        return r.choice(speech[-1]) if r.random() < known else "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    words = lambda k: " ".join(word() for _ in range(k))
    sentence = lambda: words(r.randint(2, 14)).capitalize() + r.choice((".", ".", "", "!", "%%%", " ###", " |", "*** " + word(), " ©", " | " + word() + " |"))
    para = lambda: " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 6, 9))))
    cls = lambda *names: r.choice((f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{r.choice(names)} {word()}"'))
    out: list[tuple[str, int]] = [("<!DOCTYPE html><html><head><title>x</title></head><body>", -1)]
    links = lambda k: [(f'<li><a href="/{word()}">{words(r.randint(1, 3))}</a></li>', 0) for _ in range(k)]

    def wrap(open_tag, inner, close_tag):
        out.append((open_tag, -1))
        out.extend(inner)
        out.append((close_tag, -1))

    junk = lambda label=0, most=3: [(f"<p>{para()}</p>" if r.random() < 0.6 else f"<div>{para()}</div>", label) for _ in range(r.randint(1, most))]

    def furnished(make):
        speech.append(FURNITURE)
        try:
            return make()
        finally:
            speech.pop()

    def menu():
        tag = r.choice(("nav", "div", "ul", "nav"))
        mark = cls("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav") if tag != "nav" or r.random() < 0.4 else ""
        wrap(f"<{tag}{mark}><ul>", furnished(lambda: links(r.randint(2, 9))), f"</ul></{tag}>")

    def boiler(names, tags, inner=junk):
        tag = r.choice(tags)
        wrap(f"<{tag}{cls(*names) if tag in ('div', 'section', 'p', 'ul') or r.random() < 0.4 else ''}>", furnished(inner) if r.random() < 0.8 else inner(), f"</{tag}>")

    advert = lambda: boiler(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"), ("div", "aside", "section"))
    notice = lambda: boiler(("cookie", "notice", "consent", "gdpr", "newsletter", "popup", "alert", "paywall", "subscribe"), ("div", "section"))
    side = lambda: boiler(("sidebar", "side", "related", "widget", "recommended", "share", "social"), ("aside", "div", "aside"), lambda: links(r.randint(1, 6)) if r.random() < 0.5 else junk())
    form = lambda: boiler(("search", "login", "signup", "contact"), ("form",), lambda: [(f"<label>{words(2)}</label><input><button>{word()}</button>", 0)])
    comments = lambda: boiler(("comments", "comment", "replies", "discussion", "respond", "disqus"), ("div", "section", "ul"), lambda: [(f"<div class=\"{r.choice(('comment', 'reply', 'comment-body'))}\"><p>{para()}</p></div>", 0) for _ in range(r.randint(1, 6))])
    if r.random() < 0.5:
        boiler(("header", "masthead", "site-header", "top"), ("header", "div"), lambda: [(f"<h1>{words(2)}</h1>" if r.random() < 0.4 else f"<p>{words(4)}</p>", 0), *links(r.randint(0, 4))])
    for _ in range(r.randint(0, 2)):
        menu()
    if r.random() < 0.3:
        out.append((f"<!-- {words(2)} -->", -1))
    for f, chance in ((advert, 0.5), (notice, 0.3), (side, 0.25), (form, 0.2)):
        if r.random() < chance:
            f()
    shell = r.choice((("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div{cls('content', 'main', 'article', 'post', 'entry', 'body', 'story')}>", "</div>"), ('<div role="main">', "</div>")))
    out.append((shell[0], -1))
    head = words(r.randint(2, 9)).capitalize()
    if r.random() < 0.9:
        out.append((f"<h1>{head}</h1>", 1))
    for _ in range(r.choice((0, 1, 2, 3, 5, 8, 12, 25))):
        x = r.random()
        if x < 0.62:
            out.append((f"<p>{para()}</p>", 1))
        elif x < 0.72:
            out.append((f"<p><b>{para()}<br>", 1))
        elif x < 0.78:
            out.append((f"<h{r.randint(2, 4)}>{words(r.randint(1, 6))}</h2>", 1))
        elif x < 0.84:
            out += [("<ul>", -1), *((f"<li>{sentence()}</li>", 1) for _ in range(r.randint(1, 5))), ("</ul>", -1)]
        elif x < 0.88:
            out.append((f"<blockquote>{para()}</blockquote>", 1))
        elif x < 0.92:
            out += [("<table><tr>", -1), *((f"<td>{words(2)}</td>", 1) for _ in range(r.randint(2, 6))), ("</tr></table>", -1)]
        elif x < 0.95:
            out.append((f"<div>{para()}</div>", 1))
        else:
            r.choice((advert, side, form, notice))()
    if r.random() < 0.12:
        out.append((f"<p>{para()}", 1))
        return out  # cut off before any close
    out.append((shell[1], -1))
    for f, chance in ((side, 0.3), (comments, 0.35), (advert, 0.2), (notice, 0.15), (form, 0.2), (menu, 0.1)):
        if r.random() < chance:
            f()
    if r.random() < 0.85:
        boiler(("footer", "site-footer", "bottom", "copyright"), ("footer", "footer", "div"), lambda: [(f"<p>&copy; {words(3)} &middot; {words(2)}</p>" if r.random() < 0.5 else f"&copy; {words(2)} &middot; {sentence()}", 0), *links(r.randint(0, 3))])
    out.append(("</body></html>", -1))
    return out


def made_examples(seed: int, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels: every text of a made page carries a mark that tells its label and is taken out again."""
    r, out = random.Random(seed), []
    for _ in range(n):
        parts = made_page(r)
        page = "".join(re.sub(r">([^<>]+)", lambda m, k=label: f">\x01{k}{m.group(1)}" if m.group(1).strip() else m.group(0), p) if label >= 0 else p for p, label in parts)
        page = re.sub(r"(^|>)(&copy;)", r"\1" + "\x01" + r"0\2", page)
        found = [(p, re.sub("\x01.", "", t), m) for p, t in blocks(page) if (m := re.search("\x01([01])", t))]
        if found:
            out.append((vectors([f[:2] for f in found]), np.array([int(f[2].group(1)) for f in found], np.float32)))
    return out


def padded(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(x) for x in items)
    x, mask = np.zeros((len(items), t, WIDTH), np.float32), np.zeros((len(items), t), np.float32)
    for i, v in enumerate(items):
        x[i, : len(v)], mask[i, : len(v)] = v, 1
    return x, mask


@lru_cache(maxsize=1)
def trained(pages: int = 1400, epochs: int = 6, batch: int = 24, seed: int = 11) -> dict:
    """Weights of a labeller fitted to made pages."""
    net, adam, r = Labeller(), {"t": 0}, np.random.default_rng(seed)
    data = sorted(made_examples(seed, pages), key=lambda e: len(e[1]))
    groups = [data[i : i + batch] for i in range(0, len(data), batch)]
    for epoch in range(epochs):
        for g in r.permutation(len(groups)):
            x, mask = padded([e[0] for e in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for i, e in enumerate(groups[g]):
                y[i, : len(e[1])] = e[1]
            net.step(x, mask, y, adam, 0.02 if epoch < epochs - 2 else 0.006)
    return net.p


#: Blocks times pages in one padded batch.
CELLS = 4096


def extract(pages: list[str], net: Labeller) -> list[str]:
    found = [blocks(p) if p else [] for p in pages]
    order = sorted((i for i, f in enumerate(found) if f), key=lambda i: len(found[i]))
    out = [""] * len(pages)
    while order:
        group = [order.pop()]
        while order and (len(group) + 1) * len(found[group[0]]) <= CELLS:
            group.append(order.pop())
        x, mask = padded([vectors(found[i]) for i in group])
        p = net.predict(x, mask)
        for row, i in zip(p, group):
            out[i] = "\n".join(t for (_, t), q in zip(found[i], row) if q >= 0.5)
    return out


def main_texts(pages: DataFrame, keep: tuple = ("page_id", "url"), html: str = "html") -> DataFrame:
    """keep columns, text, n_chars; a row for each row of pages."""
    weights = pages.sparkSession.sparkContext.broadcast(trained())
    source = pages.select(*keep, pages[html].cast("string").alias("__html"))
    schema = source.drop("__html").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        net = Labeller()
        net.p = weights.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = extract(part.column(len(keep)).to_pylist(), net)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return source.mapInArrow(lean(run), schema)
