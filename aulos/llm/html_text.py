"""Main text of web pages by a recurrent block labeller (numpy bidirectional LSTM).

A page is cut into leaf blocks: runs of text between block-level tags, with their path of open tags
and the words of their class, id and role attributes. Each leaf is read as a vector (hashed path
words, hashed text words, a few measures); a forward and a backward LSTM over the whole sequence
of leaves give each leaf a probability of being article text. The pages have no labels, so the
network is trained on generated layouts whose truth is known (``layout``): menus, headers, adverts,
notices, sidebars, forms, comments and footers around and inside articles of random words.

Character references are decoded, white space inside a block becomes one space, kept blocks are
joined by one line feed; nothing is capped. Scripts, styles, comments and other hidden elements
are never text. Null or empty html gives an empty text. Repeated rows are labelled one by one;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PATH, WORDS, MEASURES, HIDDEN = 160, 24, 6, 16
INPUTS = PATH + WORDS + MEASURES
PAGES, EPOCHS, RATE, SEED = 1500, 4, 0.01, 3
CELLS = 20_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style noscript template svg iframe object textarea title select head math canvas".split())
_RAW = frozenset("script style textarea title".split())
_SHUT = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


def leaves(page: str) -> list[tuple[str, tuple[str, ...], int, int]]:
    """(text, path words, characters, characters in links) of each leaf block in page order."""
    out, stack, held, links, at, anchors, hidden = [], [], [], 0, 0, 0, 0

    def close():
        nonlocal links
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, tuple(w for _, words in stack for w in words), len(text), links))
        links = 0

    def pop(to: int):
        nonlocal anchors, hidden
        for name, _ in stack[to:]:
            anchors -= name == "a"
            hidden -= name in _HIDDEN
        del stack[to:]

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at and not hidden:
            held.append(page[at:start])
            if anchors:
                links += start - at
        if not m:
            break
        at, name = m.end(), m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name not in _INLINE:
                        close()
                    pop(i)
                    break
            continue
        if name not in _INLINE:
            close()
        if name in _VOID:
            continue
        if name not in _INLINE:
            shut = _SHUT.get(name, {"p"})
            i = len(stack)
            while i and stack[i - 1][0] in _INLINE:
                i -= 1
            if i and stack[i - 1][0] in shut:
                pop(i - 1)
        if name == "body":
            pop(0)
        words = [name, *(f"{name}>{stack[-1][0]}",)] if stack else [name]
        for found in _ATTR.findall(m[3]) if m[3] else ():
            words += ["." + w for w in _NAME.findall("".join(found).lower())]
        if m[3].endswith("/") and name in ("svg", "iframe", "object", "script"):
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if name == "script" or name == "style" or end:
                at = end.end() if end else n
            continue
        stack.append((name, words))
        anchors += name == "a"
        hidden += name in _HIDDEN
    close()
    return out


@functools.lru_cache(1 << 16)
def _slot(word: str, size: int) -> tuple[int, int]:
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return h % size, (h >> 16) % size


@functools.lru_cache(1 << 14)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH, np.float32)
    for w in path:
        for s in _slot(w, PATH):
            v[s] = 1
    return v


def vectors(found: list) -> np.ndarray:
    """One row for each leaf."""
    x = np.zeros((len(found), INPUTS), np.float32)
    for i, (text, path, size, links) in enumerate(found):
        x[i, :PATH] = _path_vector(path)
        words = text.split()
        counts = np.bincount([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in words], minlength=WORDS)
        x[i, PATH : PATH + WORDS] = 0.3 * counts / max(np.sqrt((counts * counts).sum()), 1)
        x[i, PATH + WORDS :] = (np.log1p(size) / 6, min(links / size, 1), np.log1p(len(words)) / 4, text[-1] in ".!?", text.count(",") / len(words), i / len(found))
    return x


_SOUNDS = "the an re on er ing tion ed ou st ha le de la que ment ung sch keit ver zu ie es ción ado ll en it a of".split()


def layout(rng: random.Random) -> tuple[str, list[bool]]:
    """A random page and, for each of its leaf blocks, whether it belongs to the article."""
    truth: list[bool] = []

    def phrase(lo, hi):
        return " ".join("".join(rng.choice(_SOUNDS) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi)))

    def leaf(main, lo=3, hi=20):
        truth.append(main)
        return phrase(lo, hi).capitalize() + (rng.choice([".", ".", "", "!", "?", ".%%%", "&amp;"]))

    def menu():
        items = "".join(f'<li><a href="/{phrase(1, 1)}">{leaf(False, 1, 2)}</a></li>' for _ in range(rng.randint(2, 7)))
        return rng.choice(["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul id="nav">{}</ul>', '<header><nav><ul>{}</ul></nav></header>']).format(items)

    def noise(names):
        tag, name = rng.choice(["div", "div", "section", "aside"]), rng.choice(names)
        inner = rng.choice([lambda: leaf(False, 2, 14), lambda: f"<p>{leaf(False, 3, 30)}</p>", lambda: "".join(f"<p>{leaf(False, 3, 30)}</p>" for _ in range(rng.randint(1, 4))),
                            lambda: f"<h3>{leaf(False, 1, 4)}</h3><p>{leaf(False, 5, 60)}</p>", lambda: f'<ul><li><a href="#">{leaf(False, 1, 6)}</a></li><li><a href="#">{leaf(False, 1, 6)}</a></li></ul>'])()
        return f'<{tag} {rng.choice(["class", "id"])}="{name}">{inner}</{tag}>'

    ads = ["ad", "ads", "advert", "advertisement", "banner", "sponsor", "promo", "ad-box"]
    notes = ["notice", "cookie-notice", "cookie", "consent", "alert", "newsletter", "subscribe", "popup"]
    sides = ["sidebar", "related", "widget", "share", "social", "recommended", "breadcrumb", "tags"]
    comments = ["comments", "comment-list", "comment", "replies", "discussion"]

    def block():
        kind = rng.random()
        if kind < 0.72:
            long = leaf(True, 1, rng.choice([6, 25, 90]))
            return rng.choice(["<p>{}</p>"] * 5 + ["<p>{}"] * 2 + ["<p><b>{}<br>", "<p><b>{}</b></p>", "<div>{}</div>", "<p><em>{}</em></p>", "<p>{}<br>"]).format(long)
        if kind < 0.8:
            return f"<h{(k := rng.randint(2, 4))}>{leaf(True, 1, 7)}</h{k}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{leaf(True, 2, 15)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{leaf(True, 4, 30)}</p></blockquote>"
        if kind < 0.93:
            return f"<table><tr><td>{leaf(True, 1, 5)}</td><td>{leaf(True, 1, 5)}</td></tr></table>"
        if kind < 0.95:
            return f"<pre><code>{leaf(True, 2, 12)}</code></pre>"
        if kind < 0.97:
            return noise(ads)
        return noise(sides + notes)

    parts = []
    if rng.random() < 0.3:
        parts.append(f"<header><h2>{leaf(False, 1, 4)}</h2>{menu() if rng.random() < 0.5 else ''}</header>")
    if rng.random() < 0.9:
        parts.append(menu())
    for names, odds in ((ads, 0.6), (notes, 0.3), (sides, 0.2)):
        if rng.random() < odds:
            parts.append(noise(names))
    if rng.random() < 0.15:
        parts.append(f'<form action="/q"><label>{leaf(False, 1, 3)}</label><button>{phrase(1, 1)}</button></form>')
    head = f"<h1>{leaf(True, 2, 10)}</h1>" if rng.random() < 0.85 else ""
    body = head + "".join(block() for _ in range(rng.choice([0, 1, 2, 4, 8, 14])))
    if not body:
        body = f"<p>{leaf(True, 2, 40)}</p>"
    if rng.random() < 0.15:
        body += noise(comments)
    parts.append(rng.choice(["<article>{}</article>"] * 6 + ["<main><article>{}</article></main>"] * 2 + ["<main>{}</main>", '<div class="content">{}</div>', '<div id="article">{}</div>', '<div class="post-body entry">{}</div>']).format(body))
    for names, odds in ((comments, 0.35), (sides, 0.3), (ads, 0.3), (notes, 0.15)):
        if rng.random() < odds:
            parts.append(noise(names))
    if rng.random() < 0.1:
        parts.append(f'<form class="comment-form"><p>{leaf(False, 1, 6)}</p></form>')
    if rng.random() < 0.85:
        end = rng.choice(["&copy; {}", "<p>{}</p>", "&copy; www.example.net &middot; {}", "<ul><li><a>{}</a></li></ul>"]).format(leaf(False, 2, 14))
        parts.append(rng.choice(["<footer>{}</footer>"] * 4 + ['<div class="footer">{}</div>', '<div id="footer">{}</div>']).format(end))
    shell = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>%s%s'
    return shell % ("".join(parts), "</body></html>" if rng.random() < 0.8 else ""), truth


class Labeller:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = {}
        for way in "fb":
            self.w |= {f"W{way}": (rng.normal(size=(INPUTS, 4 * HIDDEN)) * 0.1).astype(np.float32), f"U{way}": (rng.normal(size=(HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32), f"c{way}": np.zeros(4 * HIDDEN, np.float32)}
            self.w[f"c{way}"][HIDDEN : 2 * HIDDEN] = 1
        self.w |= {"o": (rng.normal(size=2 * HIDDEN) * 0.3).astype(np.float32), "d": (rng.normal(size=INPUTS) * 0.05).astype(np.float32), "p": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits (pages, leaves); padded leaves leave the state as it is."""
        n, steps, _ = x.shape
        w, outs, trace = self.w, [], {}
        for way in "fb":
            given = (x.reshape(-1, INPUTS) @ w[f"W{way}"] + w[f"c{way}"]).reshape(n, steps, -1)
            h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            out, log = np.empty((n, steps, HIDDEN), np.float32), []
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                a = given[:, t] + h @ w[f"U{way}"]
                s = 0.5 + 0.5 * np.tanh(0.5 * a[:, : 3 * HIDDEN])
                i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
                g, m = np.tanh(a[:, 3 * HIDDEN :]), mask[:, t, None]
                cc = f * c + i * g
                tc = np.tanh(cc)
                if keep:
                    log.append((t, h, c, i, f, o, g, tc, m))
                h, c = np.where(m, o * tc, h), np.where(m, cc, c)
                out[:, t] = h
            outs.append(out)
            trace[way] = log
        both = np.concatenate(outs, 2)
        logit = both @ w["o"] + x @ w["d"] + w["p"][0]
        return (logit, both, trace) if keep else logit

    def gradients(self, x, mask, y):
        w = self.w
        logit, both, trace = self.forward(x, mask, keep=True)
        d = np.where(mask, 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y, 0).astype(np.float32) / mask.sum()
        g = {"o": np.einsum("nt,nth->h", d, both), "d": np.einsum("nt,nti->i", d, x), "p": np.array([d.sum()], np.float32)}
        dboth = d[:, :, None] * w["o"]
        for way, part in (("f", dboth[:, :, :HIDDEN]), ("b", dboth[:, :, HIDDEN:])):
            dh, dc = np.zeros_like(part[:, 0]), np.zeros_like(part[:, 0])
            dgiven, dU = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(w[f"U{way}"])
            for t, h, c, i, f, o, gg, tc, m in reversed(trace[way]):
                dh = dh + part[:, t]
                here, dcc = np.where(m, dh, 0), np.where(m, dc, 0)
                dcc = dcc + here * o * (1 - tc * tc)
                a = np.concatenate((dcc * gg * i * (1 - i), dcc * c * f * (1 - f), here * tc * o * (1 - o), dcc * i * (1 - gg * gg)), 1)
                dgiven[:, t] = a
                dU += h.T @ a
                dh, dc = np.where(m, a @ w[f"U{way}"].T, dh), np.where(m, dcc * f, dc)
            flat = dgiven.reshape(-1, 4 * HIDDEN)
            g |= {f"U{way}": dU, f"W{way}": x.reshape(-1, INPUTS).T @ flat, f"c{way}": flat.sum(0)}
        return g

    def kept(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """For each sequence of leaf vectors, which leaves are article text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(sequences)
        order, run, widest = sorted(range(len(sequences)), key=lambda i: len(sequences[i])), [], 0

        def close():
            if run and widest:
                x, mask = padded([sequences[i] for i in run])
                for i, row in zip(run, self.forward(x, mask), strict=True):
                    out[i] = row[: len(sequences[i])] > 0
            run.clear()

        for i in order:
            if run and (len(run) + 1) * len(sequences[i]) > CELLS:
                close()
            run.append(i)
            widest = len(sequences[i])
        close()
        return out


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(sequences), max(map(len, sequences)), INPUTS), np.float32)
    mask = np.zeros(x.shape[:2], bool)
    for i, s in enumerate(sequences):
        x[i, : len(s)], mask[i, : len(s)] = s, True
    return x, mask


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    rng, model = random.Random(seed), Labeller(seed)
    data = []
    for _ in range(pages):
        page, truth = layout(rng)
        found = leaves(page)
        if len(found) == len(truth):  # a page whose cuts differ has no truth
            data.append((vectors(found), np.array(truth)))
    data.sort(key=lambda d: len(d[0]))
    chunks = [data[i : i + 24] for i in range(0, len(data), 24)]
    moments, step = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.w.items()}, 0
    for epoch in range(epochs):
        rng.shuffle(chunks)
        for chunk in chunks:
            x, mask = padded([d[0] for d in chunk])
            y = np.zeros(mask.shape, np.float32)
            for i, (_, t) in enumerate(chunk):
                y[i, : len(t)] = t
            step += 1
            for k, grad in model.gradients(x, mask, y).items():
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                rate = RATE * (0.4 if epoch == epochs - 1 else 1)
                model.w[k] = (model.w[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def extract(pages: list[str], model: Labeller) -> list[str]:
    found = [leaves(p) for p in pages]
    kept = model.kept([vectors(f) for f in found])
    return ["\n".join(leaf[0] for leaf, k in zip(f, keep, strict=True) if k) for f, keep in zip(found, kept, strict=True)]


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_text(pages: DataFrame, model: Labeller | None = None, group: int = 256) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    model = model or train()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), group):
                part = pdf.iloc[lo : lo + group]
                texts = extract([h or "" for h in part["html"].astype(object).where(part["html"].notna(), "")], model)
                yield pd.DataFrame({"page_id": part["page_id"].to_numpy(), "url": part["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, SCHEMA)
