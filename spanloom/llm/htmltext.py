"""Main text of web pages by a recurrent block labeller.

A page is a sequence of blocks: the text between tags that break a line. A bidirectional LSTM (numpy) reads for
each block a vector of its hashed tag path (tags, ids and class names of the ancestors), of its hashed words and of
a few measures (length, share of linked characters, ...), of all its words, tags and ancestors, and labels it main text or not with the whole page as
context. The main blocks, in page order, are the text.

The model is trained here, on made pages (``make_page``) whose labels are known: articles in many layouts among
menus, headers, footers, sidebars, notices, adverts, forms and reader comments, also with tags left open. It takes
a few seconds on the driver, once a process, and always gives the same weights; its size does not depend on data.

Inside a block, character references are decoded and white space (br included) becomes one space. Comments,
scripts, styles, the head's title and other text that is never shown are no blocks.

Defined results: null, empty or text-free html gives ""; broken markup is read as far as it goes (an unclosed
comment or script hides the rest); repeated pages are reported each; all columns are kept.
"""

from __future__ import annotations

import html as html_
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, table

TAG = re.compile(r"""<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*>)""", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
NAME_PART = re.compile(r"[a-z]+", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style title template noscript svg textarea select object iframe".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BREAKS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

WORDS, MEASURES, OTHERS = 64, 8, 32
DIGIT = re.compile(r"\d")


#: Names and phrases that pages use for their parts.
NAMES = {
    "menu": "nav navbar menu navigation topnav main-menu site-nav breadcrumb breadcrumbs toc pagination pager tabs links",
    "header": "header site-header masthead page-header topbar logo branding site-title tagline",
    "footer": "footer site-footer page-footer copyright bottom colophon legal",
    "side": "sidebar side widget widgets related related-posts recommended trending popular tags tag-cloud archive author-box bio more-stories",
    "notice": "cookie cookie-banner cookie-notice consent gdpr notice alert warning disclaimer popup modal overlay paywall message banner",
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion adsbox banner-ad dfp teaser-ad commercial affiliate",
    "form": "form newsletter signup subscribe search search-form login contact-form poll survey",
    "share": "share sharing social social-links share-buttons follow tools meta byline post-meta rating",
    "comments": "comments comment comment-list comment-body responses reply discussion disqus feedback reader-comments user-comments thread",
}
MAIN = "article main content main-content post post-content entry entry-content story story-body article-body text body-text page-content single prose"
PHRASES = (
    "Home;About us;Contact;Log in;Sign up;Read more;Share this;Privacy policy;Terms of use;All rights reserved;Copyright 2023;© 2024;Subscribe to our newsletter;Enter your e-mail address;Submit;Search;"
    "We use cookies;Accept all;Advertisement;Sponsored;Related articles;Most popular;Leave a reply;Reply;Comments;Follow us;Powered by;Back to top;Next;Previous;Impressum;Datenschutz;Kontakt;Startseite;Alle Rechte vorbehalten;"
    "Accueil;Mentions légales;Tous droits réservés;Inicio;Aviso legal;Todos los derechos reservados;Kommentare;Commentaires;Comentarios;Anzeige;Publicité;Publicidad"
).split(";")
#: Tags and names that have a place of their own in the path vector; the others share OTHERS places by hash.
KNOWN = sorted({f".{x.lower()}" for group in [MAIN, *NAMES.values()] for n in group.split() for x in NAME_PART.findall(n)} | BREAKS_P | set("p li td th tr dt dd tbody body html figure figcaption label button legend center details summary hgroup time".split()))
PATH = 2 * len(KNOWN) + OTHERS
INPUT = PATH + WORDS + MEASURES


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: Path, linked: int) -> None:
        self.text, self.path, self.linked = text, path, linked


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    for m in ATTRIBUTE.finditer(attributes) if "=" in attributes else ():
        for name in (m[1] or m[2] or m[3] or "").split():
            out += [f".{x.lower()}" for x in NAME_PART.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name))]
    return tuple(out)


class Path:
    """The tokens of a block's ancestors: places in the path vector of all of them and of the two innermost.

    Each open tag has one, made from that of the tag outside it, so a block costs nothing for its depth."""

    __slots__ = ("every", "inner", "last")

    def __init__(self, outside: Path | None = None, tokens: tuple[str, ...] = ()) -> None:
        new = frozenset(_place(t) for t in tokens)
        self.last = new
        self.every = outside.every if outside and new <= outside.every else (outside.every | new if outside else new)
        self.inner = (outside.last if outside else frozenset()) | new

    def places(self) -> list[int]:
        return sorted(self.every | {len(KNOWN) + k for k in self.inner if k < len(KNOWN)})


def blocks(page: str | None) -> list[Block]:
    """The page's blocks in order."""
    out: list[Block] = []
    #: Open tags: name, path of the innermost that breaks a line, and whether a link is open.
    stack: list[tuple[str, Path, bool]] = []
    breaking: list[int] = []  # the places in stack of those that break a line
    where: dict[str, list[int]] = {}  # the places of each name
    parts: list[str] = []
    linked = at = 0
    page = page or ""
    last, root = page.rfind(">"), Path()

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, stack[-1][1] if stack else root, min(linked, len(text))))
        parts.clear()
        linked = 0

    def shut(place: int) -> None:
        """Closes all tags from place on."""
        for name, _, _ in stack[place:]:
            where[name].pop()
        del stack[place:]
        while breaking and breaking[-1] >= place:
            breaking.pop()

    while at < len(page):
        m = TAG.search(page, at) if at <= last or "<!--" in page[max(at, last) :] else None
        raw = page[at : m.start() if m else len(page)]
        if raw:
            raw = html_.unescape(raw)
            parts.append(raw)
            if stack and stack[-1][2]:
                linked += len(raw.strip())
        if not m:
            break
        at = m.end()
        if m[0] == "<!--":
            close = page.find("-->", at)
            at = close + 3 if close >= 0 else len(page)
            continue
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in INLINE:
                end()
            place = where[tag][-1] if where.get(tag) else -1
            if place >= 0 and (tag not in INLINE or not breaking or breaking[-1] < place):
                shut(place)
            continue
        if tag in HIDDEN and not m[3].endswith("/>"):
            end()
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        if tag not in INLINE:
            end()
            for ends in (CLOSES.get(tag), {"p"} if tag in BREAKS_P else None):
                if ends and breaking and stack[breaking[-1]][0] in ends:
                    shut(breaking[-1])
        if tag not in VOID and not m[3].endswith("/>"):
            path, link = (stack[-1][1], stack[-1][2]) if stack else (root, False)
            where.setdefault(tag, []).append(len(stack))
            if tag not in INLINE:
                breaking.append(len(stack))
                path = Path(path, _tokens(tag, m[3]))
            stack.append((tag, path, link or tag == "a"))
    end()
    return out


def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


PLACE = {t: i for i, t in enumerate(KNOWN)}


def _place(token: str) -> int:
    """Of a known token its own place; the others share OTHERS places behind the two sets of known ones."""
    return PLACE[token] if token in PLACE else 2 * len(KNOWN) + _slot(token, OTHERS)


class Features:
    """INPUT numbers a block; remembers the slots of words."""

    def __init__(self) -> None:
        self.word: dict[str, int] = {}

    def __call__(self, page: list[Block]) -> np.ndarray:
        x = np.zeros((len(page), INPUT), np.float32)
        path = places = None
        for n, b in enumerate(page):
            if b.path is not path:
                path, places = b.path, b.path.places()
            x[n, places] = 1
            words = b.text.lower().split()
            if len(self.word) > 100_000:
                self.word.clear()
            for w in set(words).difference(self.word):
                self.word[w] = _slot(w.strip(".,;:!?()|"), WORDS)
            slots = np.fromiter(map(self.word.__getitem__, words), np.intp, len(words))
            x[n, PATH : PATH + WORDS] = np.bincount(slots, minlength=WORDS) / len(words)
            size = len(b.text)
            x[n, PATH + WORDS :] = (np.log1p(size) / 6, b.linked / size, min(1, len(words) / 50), min(1, b.text.count(",") / 5), b.text[-1] in ".!?", min(1.0, 10 * len(DIGIT.findall(b.text)) / size), n / len(page), b.text[0] in "©|»")
        return x


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    HIDDEN = 16

    def __init__(self, seed: int = 7) -> None:
        rng, h = np.random.default_rng(seed), self.HIDDEN
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {f"{d}{k}": v for d in "fb" for k, v in (("W", init(INPUT, 4 * h) * 0.5), ("U", init(h, 4 * h)), ("c", np.repeat([0, 1, 0, 0], h).astype(np.float32)))}
        self.p |= {"V": init(2 * h, 1), "S": init(INPUT, 1) * 0.1, "s": np.zeros(1, np.float32)}

    @staticmethod
    def _flip(lengths: np.ndarray, steps: int) -> np.ndarray:
        """Indices that turn each row's own part around and leave the padding."""
        t = np.arange(steps)[None, :]
        n = lengths[:, None]
        return np.where(t < n, n - 1 - t, t)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None):
        h, (size, steps, _) = self.HIDDEN, x.shape
        gates = x @ self.p[f"{d}W"] + self.p[f"{d}c"]
        hid, cell = np.zeros((size, h), np.float32), np.zeros((size, h), np.float32)
        out = np.zeros((size, steps, h), np.float32)
        for t in range(steps):
            z = gates[:, t] + hid @ self.p[f"{d}U"]
            sig = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            i, f, o, g = sig[:, :h], sig[:, h : 2 * h], sig[:, 2 * h :], np.tanh(z[:, 3 * h :])
            new = f * cell + i * g
            th, m = np.tanh(new), mask[:, t, None]
            if keep is not None:
                keep.append((i, f, o, g, cell, th, hid, m))
            cell = new * m + cell * (1 - m)
            hid = o * th * m + hid * (1 - m)
            out[:, t] = hid
        return out

    def _forward(self, x: np.ndarray, lengths: np.ndarray, keep: dict | None = None):
        size, steps, _ = x.shape
        mask = (np.arange(steps)[None, :] < lengths[:, None]).astype(np.float32)
        flip, rows = self._flip(lengths, steps), np.arange(size)[:, None]
        f, b = ([], []) if keep is not None else (None, None)
        ahead = self._run("f", x, mask, f)
        back = self._run("b", x[rows, flip], mask, b)[rows, flip]
        both = np.concatenate([ahead, back], axis=2)
        z = (both @ self.p["V"] + x @ self.p["S"])[:, :, 0] + self.p["s"]
        if keep is not None:
            keep.update(f=f, b=b, both=both, mask=mask, flip=flip, rows=rows)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _back(self, d: str, x: np.ndarray, kept: list, dout: np.ndarray, grad: dict) -> None:
        h, (size, steps, _) = self.HIDDEN, x.shape
        dz_all = np.zeros((size, steps, 4 * h), np.float32)
        dh, dc = np.zeros((size, h), np.float32), np.zeros((size, h), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, g, cell, th, hid, m = kept[t]
            dh = dh + dout[:, t]
            live = dh * m
            dnew = dc * m + live * o * (1 - th * th)
            dz = np.concatenate([dnew * g * i * (1 - i), dnew * cell * f * (1 - f), live * th * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
            dz_all[:, t] = dz
            grad[f"{d}U"] += hid.T @ dz
            dh = dh * (1 - m) + dz @ self.p[f"{d}U"].T
            dc = dc * (1 - m) + dnew * f
        grad[f"{d}W"] += x.reshape(-1, INPUT).T @ dz_all.reshape(-1, 4 * h)
        grad[f"{d}c"] += dz_all.sum((0, 1))

    def gradient(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        keep: dict = {}
        prob = self._forward(x, lengths, keep)
        mask, total = keep["mask"], keep["mask"].sum()
        loss = -(mask * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).sum() / total
        dz = ((prob - y) * mask / total)[:, :, None].astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["V"], grad["S"], grad["s"] = keep["both"].reshape(-1, 2 * self.HIDDEN).T @ dz.reshape(-1, 1), x.reshape(-1, INPUT).T @ dz.reshape(-1, 1), dz.sum((0, 1))
        dboth = dz @ self.p["V"].T
        rows, flip = keep["rows"], keep["flip"]
        self._back("f", x, keep["f"], dboth[:, :, : self.HIDDEN], grad)
        self._back("b", x[rows, flip], keep["b"], dboth[:, :, self.HIDDEN :][rows, flip], grad)
        return float(loss), grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, batch: int = 32, rate: float = 0.01, seed: int = 11) -> list[float]:
        rng, state, step, losses = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}, 0, []
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for epoch in range(epochs):
            total = 0.0
            for k in rng.permutation(len(groups)):
                x, lengths = pad([pages[i][0] for i in groups[k]])
                y, _ = pad([pages[i][1][:, None].astype(np.float32) for i in groups[k]])
                loss, grad = self.gradient(x, lengths, y[:, :, 0])
                total, step = total + loss, step + 1
                now = rate * (1 - 0.9 * epoch / epochs)
                for name, g in grad.items():
                    m, v = state[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[name] -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            losses.append(total / len(groups))
        return losses

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page whether each block is main text; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 64 and len(pages[order[end]]) * (end - at) < 4096:
                end += 1
            x, lengths = pad([pages[i] for i in order[at:end]])
            for i, row, n in zip(order[at:end], self._forward(x, lengths), lengths, strict=True):
                out[i] = row[:n] > 0.5
            at = end
        return out


def pad(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in parts])
    x = np.zeros((len(parts), lengths.max(), parts[0].shape[1]), np.float32)
    for row, p in zip(x, parts, strict=True):
        row[: len(p)] = p
    return x, lengths


def make_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks in order, whether it is main text."""
    out, truth = [], []
    sounds = rng.choice(["the an er in re on at nd st es en of te ed or ti hi as to", "der die ein sch ung keit ver be lich ch ö ü ä ß", "le la eau ou ez é è que ment tion re", "ción os as la el que ado mente ñ í"]).split()
    word = lambda: "".join(rng.choice(sounds) for _ in range(rng.randint(1, 4)))

    def prose(low: int, high: int) -> str:
        words = [word() + ("," if rng.random() < 0.08 else "") for _ in range(rng.randint(low, high))]
        kind = rng.random()
        if kind < 0.05:
            words = [f"{w.upper()}!!" for w in words]
        elif kind < 0.1:
            words = [f"{w} |" for w in words]
        elif kind < 0.15:
            words = [w + rng.choice(["***", "###", "&amp;&amp;"]) for w in words]
        return (" ".join(words)).capitalize() + rng.choice([".", ".", ".", "", "!", "?"])

    def names(kind: str) -> str:
        chosen = rng.choice((MAIN if kind == "main" else NAMES[kind]).split())
        extra = rng.choice(["", "", "", " clearfix", " col-8", " inner", " row", " " + " ".join(f"{word()}-{rng.randint(1, 12)}" for _ in range(rng.randint(3, 15)))])
        if rng.random() < 0.1:  # utility classes before the telling one
            chosen = f"{extra.strip()} {chosen}".strip()
        how = rng.random()
        return f' class="{chosen}{extra}"' if how < 0.6 else f' id="{chosen}"' if how < 0.85 else f' id="{chosen}-{rng.randint(1, 99)}" class="{word()} {chosen}"'

    def text(tag: str, inside: str, main: bool, attributes: str = "") -> None:
        broken = rng.random()
        body = inside
        if broken < 0.1:
            body = f"<b>{inside}<br>"
        elif broken < 0.2 and " " in inside:
            a, b = inside.split(" ", 1)
            body = f'{a} <a href="/{word()}">{b[: len(b) // 3]}</a>{b[len(b) // 3 :]}' if main else f"<em>{a}</em> {b}"
        out.append(f"<{tag}{attributes}>{body}" + ("" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>"))
        truth.append(main)

    def links(kind: str) -> None:
        tag = rng.choice(["nav", "div", "ul"]) if kind == "menu" else "div"
        out.append(f"<{tag}{names(kind) if tag != 'nav' or rng.random() < 0.3 else ''}>" + ("<ul>" if tag != "ul" else ""))
        for _ in range(rng.randint(2, 8)):
            label = rng.choice(PHRASES) if rng.random() < 0.3 else prose(1, 3).rstrip(".")
            out.append(f'<li><a href="/{word()}">{label}</a></li>')
            truth.append(False)
        out.append(("</ul>" if tag != "ul" else "") + f"</{tag}>")

    def other(kind: str) -> None:
        tag = {"header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"], "form": ["form", "div"], "comments": ["section", "div", "ol"]}.get(kind, ["div", "div", "section", "aside"])
        tag = rng.choice(tag)
        bare = tag in ("header", "footer", "aside", "form") and rng.random() < 0.5
        out.append(f"<{tag}{'' if bare else names(kind)}>")
        for _ in range(rng.randint(1, 6 if kind == "comments" else 3)):
            style = rng.random()
            if kind == "comments" and style < 0.7:
                depth = rng.choice([1, 1, 1, 2, 3, 8, 16])
                for _ in range(depth):
                    out.append(f'<div class="{rng.choice(["comment", "comment-body", "reply", word()])}">')
                text("p", prose(3, 60), False)
                out.append("</div>" * depth)
            elif style < 0.3:
                text(rng.choice(["h2", "h3", "h4", "p"]), rng.choice(PHRASES), False)
            elif style < 0.8:
                text(rng.choice(["p", "div", "p"]), prose(3, 40), False)
            else:
                links("side")
        if kind == "form":
            out.append('<label>E-mail</label><input name="q"><button>Go</button>')
            truth.extend([False, False])
        if rng.random() < 0.3 and kind in ("footer", "advert", "notice"):
            out.append(f"&copy; {word()}.example.org &middot; {prose(2, 20)}")
            truth.append(False)
        out.append(f"</{tag}>")

    def article() -> None:
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        bare = tag in ("article", "main") and rng.random() < 0.6
        out.append(f"<{tag}{'' if bare else names('main')}>")
        depth = rng.random() < 0.25
        if depth:
            layers = rng.choice([1, 1, 2, 6, 14])
            out.append(f"<div{names('main') if rng.random() < 0.7 else ''}>" + "<div>" * (layers - 1))
        if rng.random() < 0.8:
            text(rng.choice(["h1", "h1", "h2"]), prose(2, 10).rstrip("."), True)
        for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20])):
            style = rng.random()
            if style < 0.72:
                text("p", prose(1, rng.choice([4, 30, 90, 300] if rng.random() < 0.3 else [4, 30, 90])), True)
            elif style < 0.78:
                text(rng.choice(["h2", "h3"]), prose(1, 6).rstrip("."), True)
            elif style < 0.83:
                out.append("<ul>")
                for _ in range(rng.randint(1, 5)):
                    text("li", prose(1, 15), True)
                out.append("</ul>")
            elif style < 0.87:
                text("blockquote", prose(4, 30), True)
            elif style < 0.9:
                out.append("<table>")
                for _ in range(rng.randint(1, 3)):
                    out.append("<tr>")
                    for _ in range(2):
                        text("td", prose(1, 4), True)
                    out.append("</tr>")
                out.append("</table>")
            elif style < 0.92:
                text("pre", prose(3, 20), True)
            else:
                other(rng.choice(["advert", "share", "side", "notice", "form"]))
        if depth:
            out.append("</div>" * layers)
        if rng.random() < 0.15:
            other(rng.choice(["comments", "share", "side"]))
        out.append(f"</{tag}>")

    out.append(f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{margin:0}}</style></head><body>")
    wrap = rng.random() < 0.35
    if wrap:
        out.append(f'<div class="{rng.choice(["page", "wrapper", "container", "site", "layout"])}">')
    for kind in ("header", "menu", "notice", "advert", "side", "form"):
        if rng.random() < (0.7 if kind == "menu" else 0.35):
            links(kind) if kind == "menu" else other(kind)
    article()
    for kind in ("share", "comments", "side", "advert", "form", "menu", "notice", "footer"):
        if rng.random() < (0.75 if kind == "footer" else 0.3):
            links(kind) if kind == "menu" else other(kind)
    out.append("</div>" * wrap + ("</body></html>" if rng.random() < 0.9 else ""))
    return "".join(out), truth


def made_pages(n: int, seed: int) -> list[tuple[str, np.ndarray]]:
    rng, out = random.Random(seed), []
    while len(out) < n:
        page, truth = make_page(rng)
        if len(blocks(page)) == len(truth):  # a tag left open may join two blocks: such a page has no labels
            out.append((page, np.array(truth)))
    return out


@lru_cache(1)
def trained(pages: int = 1200, epochs: int = 12) -> Labeller:
    features, model = Features(), Labeller()
    model.fit([(features(blocks(p)), y) for p, y in made_pages(pages, 3)], epochs)
    return model


def main_texts(pages: list[str | None], model: Labeller, features: Features) -> list[str]:
    cut = [blocks(p) for p in pages]
    keep = model.label([features(b) for b in cut])
    return ["\n".join(b.text for b, k in zip(page, kept, strict=True) if k) for page, kept in zip(cut, keep, strict=True)]


def extract(pages: DataFrame, html: str = "html", out: str = "text", model: Labeller | None = None) -> DataFrame:
    """pages with ``out``: the main text of the whole html."""
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast((model or trained()).p)  # some 40,000 numbers

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labeller, features = Labeller(), Features()
        labeller.p = shared.value
        for some in batches:
            found = []
            for i in range(0, len(some), 128):
                found += main_texts(list(some.iloc[i : i + 128]), labeller, features)
            yield pd.Series(found, dtype=object)

    (name,) = fresh(pages, out)
    df = pages.withColumn(name, text(F.col(html)))
    return df if name == out else df.withColumnRenamed(name, out)


def op5_main_text(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
