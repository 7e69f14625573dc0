"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks (text between block-level tags) with features of their ancestors' tags,
classes, ids and roles, of their text, of the blocks beside them and of how much of the page's text stands in the elements
around them. The field labels each block content or not; it is trained by gradient ascent of the exact log-likelihood on
labelled pages and decoded by Viterbi. The labelled pages are made by rule in `labelled_pages`: many layouts, random words,
every block with its known label; names of classes and ids tell, say nothing, mislead or are missing.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
#: A tag whose quotes pair up, and one up to the next >; what they have matched they never give back.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements whose content is no text of the page, and those without content.
_RAW = frozenset("script style noscript template iframe svg math object canvas title select textarea".split())
#: Raw elements whose content is not parsed; of these, script and style without an end go on to the end of the page.
_TEXT = frozenset("script style iframe title textarea".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: An opening tag of the key ends an open element of the values, up to what stops the search.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = frozenset("ul ol dl table tbody thead div section article main aside nav header footer body form".split())
#: What names of classes, ids and roles say, by the parts of such names.
KEYWORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs toc pagination pager tabs links skip",
    "head": "header masthead banner topbar logo branding hero",
    "foot": "footer foot copyright contentinfo legal colophon bottom",
    "side": "sidebar aside side widget widgets related recommended recommend rail complementary more popular trending tags author bio",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion adsense banner dfp outbrain taboola",
    "notice": "cookie cookies consent notice gdpr popup modal alert overlay warning announcement privacy subscribe newsletter paywall signup",
    "form": "form search login signin contact poll",
    "talk": "comment comments reply replies respond disqus discussion thread reactions feedback review",
    "share": "share sharing social follow toolbar tools meta byline",
    "main": "article content post entry story main text body page single prose",
}
_KIND = {w: k for k, ws in KEYWORDS.items() for w in ws.split()}
_TAG_KIND = {"nav": "menu", "menu": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "button": "form", "fieldset": "form", "dialog": "notice", "article": "main", "main": "main"}
_NOTED = frozenset("nav header footer aside form article main section div table td li ul ol h1 h2 h3 h4 h5 h6 p blockquote pre figure figcaption dl dd dt button fieldset body address details summary".split())
_SAID = re.compile(r"©|copyright|all rights reserved|cookies?\b|subscribe|newsletter|advertis|sponsored|sign up|log ?in|privacy policy|terms of", re.I)


@dataclass
class Block:
    """A leaf block: its text, the share of it in links, and the elements around it, innermost last."""

    text: str
    features: list[str]
    links: float = 0.0
    within: tuple[int, ...] = ()


def _kind(word: str) -> str | None:
    """What a word of a name says; one that is not known may begin with one of six letters or more that is."""
    return _KIND.get(word) or next((_KIND[word[:n]] for n in range(len(word) - 1, 5, -1) if word[:n] in _KIND), None)


def _kinds(tag: str, attrs: str) -> list[str]:
    out = [_TAG_KIND[tag]] if tag in _TAG_KIND else []
    if attrs and "=" in attrs:
        for _, a, b, c in _ATTR.findall(attrs):
            words = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", a or b or c).lower())
            out += [k for k in map(_kind, words) if k]
    return out


def _ends_of(page: str, tag: str) -> dict[int, int]:
    """Where the start tags of an element of _RAW outside _TEXT end, and where the element does; none for those without end."""
    t = re.escape(tag)
    out, open_ = {}, []
    page = page[:page.rfind(">") + 1]
    for m in re.finditer(rf"""<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\b|\Z)|<(/?){t}(?=[\s/>])([^>]*+)>""", page, re.I | re.S):
        if m[2] is None:
            continue
        if not m[2]:
            if not m[3].endswith("/"):
                open_.append(m.end())
        elif open_:
            out[open_.pop()] = m.end()
    return out


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, white space collapsed, empty ones left out."""
    out: list[Block] = []
    stack: list[tuple[str, list[str], int]] = []
    made = 0
    text: list[str] = []
    linked = total = 0
    at = links = 0
    n = len(page)
    ends: dict[str, dict[int, int]] = {}
    endless: set[str] = set()
    tag_of = _TAG

    def put(s: str) -> None:
        nonlocal linked, total
        text.append(s)
        total += len(s)
        if links:
            linked += len(s)

    def flush() -> None:
        nonlocal linked, total
        if text:
            joined = " ".join(html_lib.unescape("".join(text)).split())
            if joined:
                share = linked / max(total, 1)
                out.append(Block(joined, _features(joined, stack, share), share, tuple(i for t, _, i in stack if t in _HOLDS)))
            text.clear()
        linked = total = 0

    while at < n:
        m = _OPEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at:m.start()])
        at = m.start()
        if page.startswith("<!--", at) or page[at + 1] in "!?":
            stop = "-->" if page.startswith("<!--", at) else ">"
            end = page.find(stop, at + 2)
            at = end + len(stop) if end >= 0 else n
            continue
        m = tag_of.match(page, at)
        if m is None and tag_of is _TAG:  # a quote that never ends: from here on, tags go up to the next >
            tag_of = _PLAIN
            m = tag_of.match(page, at)
        if m is None:  # no tag ends any more
            put(page[at:])
            break
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if any(t == tag for t, _, _ in stack):
                if tag not in _INLINE:
                    flush()
                while stack.pop()[0] != tag:
                    pass
                links = sum(t == "a" for t, _, _ in stack)
            elif tag in ("p", "br"):
                put(" ") if tag == "br" else flush()
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in _RAW:
            if not m[3].endswith("/"):
                # without an end, only the tag is dropped
                if tag in _TEXT:
                    end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*+>?", re.I).search(page, at)
                    if end is None:
                        endless.add(tag)
                    at = end.end() if end else n if tag in ("script", "style") else at
                else:
                    if tag not in ends:
                        ends[tag] = _ends_of(page, tag)
                    at = ends[tag].get(at, at)
            continue
        if tag == "head":  # ends where something begins that cannot stand in it; what can has no text
            flush()
            continue
        if tag not in _INLINE:
            flush()
            for i in range(len(stack) - 1, -1, -1):  # what this tag ends implicitly
                if stack[i][0] == "p" or stack[i][0] in _ENDS.get(tag, ()):
                    del stack[i:]
                    links = sum(t == "a" for t, _, _ in stack)
                    break
                if stack[i][0] in _HOLDS:
                    break
        if tag not in _VOID and not m[3].endswith("/"):
            made += 1
            stack.append((tag, _kinds(tag, m[3]), made))
            links += tag == "a"
    flush()
    _in_context(out)
    return out


def _size(n: float) -> int:
    return min(int(math.log2(n + 1)), 9)


def _in_context(found: list[Block]) -> None:
    """Add what the page says of a block: its place, the blocks beside it, and the text outside links in what is around it."""
    plain = [len(b.text) * (1 - b.links) for b in found]
    held: dict[int, float] = {}
    blocks_in: dict[int, int] = {}
    for b, n in zip(found, plain):
        for i in b.within:
            held[i] = held.get(i, 0.0) + n
            blocks_in[i] = blocks_in.get(i, 0) + 1
    every = max(sum(plain), 1.0)
    longest = max(plain, default=0.0)
    # an element that holds the whole page tells nothing
    whole = {i for i, k in blocks_in.items() if k == len(found)} if len(found) > 1 else set()
    for i, b in enumerate(found):
        around = [k for k in b.within if k not in whole]
        near, far = (around[-1:] or [None])[0], (around[:1] or [None])[0]
        b.features += [
            f"near share:{int(4.999 * held.get(near, 0.0) / every) if near else 'none'}", f"far share:{int(4.999 * held.get(far, 0.0) / every) if far else 'none'}",
            f"near blocks:{min(blocks_in.get(near, 0), 6) if near else 'none'}", f"place:{int(4.999 * i / len(found))}", f"from start:{min(i, 3)}", f"from end:{min(len(found) - 1 - i, 3)}",
            f"of longest:{int(4.999 * plain[i] / longest) if longest else 'none'}"]
        for name, j in (("before", i - 1), ("after", i + 1)):
            other = found[j] if 0 <= j < len(found) else None
            b.features.append(f"{name}:{_size(len(other.text)) if other else 'none'}")
            b.features.append(f"{name} links:{int(other.links * 2.999) if other else 'none'}")
            if other:
                b.features.append(f"{name} {'with' if other.within == b.within else 'apart'}")


def _features(text: str, stack: list[tuple[str, list[str], int]], links: float) -> list[str]:
    tags = {t for t, _, _ in stack if t in _NOTED}
    kinds = [ks for _, ks, _ in stack if ks]
    noted = [t for t, _, _ in stack if t in _NOTED]
    parts = [t for t in noted if t in _TAG_KIND or t in ("section", "div")]
    f = [f"in:{t}" for t in tags] + [f"under:{k}" for k in {k for ks in kinds for k in ks}]
    f.append("nearest:" + ("+".join(sorted(set(kinds[-1]))) if kinds else "none"))
    f.append(f"leaf:{noted[-1] if noted else None}")
    f.append("path:" + ">".join(parts[-2:]))
    f.append(f"{f[-3]} {f[-2]}")
    said = {k for ks in kinds for k in ks}
    f.append("said:" + ("main" if said == {"main"} else "both" if "main" in said else "other" if said else "none") + " " + next((t for t in reversed(noted) if t in ("article", "main")), "none"))
    f.append(f"length:{_size(len(text))}")
    f.append(f"links:{int(links * 4.999)}")
    f.append("stop" if text[-1] in ".!?…。\"”" else "no stop")
    f.append("says" if len(text) < 400 and _SAID.search(text) else "says nothing")
    f.append("words:" + ("one" if " " not in text else "few" if text.count(" ") < 5 else "many"))
    return f


class Field:
    """Two labels; weights of features per label (the first label's are 0), and of starts and steps."""

    def __init__(self, weights: dict[str, float], start: list[float], step: list[list[float]]):
        self.weights, self.start, self.step = weights, start, step

    @classmethod
    def fit(cls, pages: list[tuple[list[Block], list[int]]], rounds: int = 300, rate: float = 0.1, ridge: float = 3e-4) -> Field:
        """Gradient ascent (with Adam's step sizes) of the likelihood of all pages at once."""
        index = {f: i for i, f in enumerate(sorted({f for bs, _ in pages for b in bs for f in b.features}))}
        n, t, d = len(pages), max(len(b) for b, _ in pages), len(index)
        y = np.zeros((n, t), np.int64)
        size = np.array([len(b) for b, _ in pages])
        at, which = [], []  # a block's cell in n by t, once for each of its features, and these
        for i, (bs, ys) in enumerate(pages):
            y[i, :len(ys)] = ys
            for j, b in enumerate(bs):
                at += [i * t + j] * len(b.features)
                which += [index[f] for f in b.features]
        at, which = np.array(at), np.array(which)
        real = np.arange(t) < size[:, None]
        pair = real[:, 1:]
        theta = np.zeros(d + 2 + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        eye = np.eye(2)
        seen_step = np.einsum("nta,ntb,nt->ab", eye[y[:, :-1]], eye[y[:, 1:]], pair)
        for k in range(1, rounds + 1):
            w, start, step = theta[:d], theta[d:d + 2], theta[d + 2:].reshape(2, 2)
            node = np.zeros((n, t, 2))
            node[..., 1] = np.bincount(at, w[which], n * t).reshape(n, t)
            a = np.zeros((n, t, 2))
            b = np.zeros((n, t, 2))
            a[:, 0] = node[:, 0] + start
            for j in range(1, t):
                a[:, j] = np.where(real[:, j, None], node[:, j] + _logsum(a[:, j - 1, :, None] + step, 1), a[:, j - 1])
            for j in range(t - 2, -1, -1):
                b[:, j] = np.where(real[:, j + 1, None], _logsum(step + (node[:, j + 1] + b[:, j + 1])[:, None, :], 2), 0)
            z = _logsum(a[:, -1], 1)
            p = np.exp(a + b - z[:, None, None]) * real[..., None]
            q = np.exp(a[:, :-1, :, None] + step + (node + b)[:, 1:, None, :] - z[:, None, None, None]) * pair[..., None, None]
            g = np.concatenate([np.bincount(which, ((y - p[..., 1]) * real).ravel()[at], d), (eye[y[:, 0]] - p[:, 0]).sum(0), (seen_step - q.sum((0, 1))).ravel()]) / n - ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return cls({f: float(theta[i]) for f, i in index.items()}, theta[d:d + 2].tolist(), theta[d + 2:].reshape(2, 2).tolist())

    def decode(self, found: list[Block]) -> list[int]:
        """The likeliest labels by Viterbi."""
        if not found:
            return []
        get = self.weights.get
        score = [sum(get(f, 0.0) for f in b.features) for b in found]
        s0, s1 = self.start[0], self.start[1] + score[0]
        (k00, k01), (k10, k11) = self.step
        back = []
        for e in score[1:]:
            f0, f1 = s1 + k10 > s0 + k00, s1 + k11 > s0 + k01
            back.append((f0, f1))
            s0, s1 = (s1 + k10 if f0 else s0 + k00), (s1 + k11 if f1 else s0 + k01) + e
        at = int(s1 > s0)
        labels = [at]
        for b in reversed(back):
            at = int(b[at])
            labels.append(at)
        return labels[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def labelled_pages(count: int = 1600, seed: int = 11, naming: tuple[str, ...] = ("telling", "telling", "telling", "none", "random", "misleading")) -> list[tuple[list[Block], list[int]]]:
    """Pages of random layouts whose content blocks are known: their words end in a sign that is taken off again.

    naming, drawn for each page: names of KEYWORDS on the elements they are for; no names, and often plain elements; made-up
    names; names of which some belong to another kind."""
    r = random.Random(seed)
    sign = "\u2063"
    mode = "telling"

    def words(lo: int, hi: int, good: bool = False) -> str:
        return " ".join("".join(r.choice("abcdeghilmnoprstuv") for _ in range(r.randint(1, 8))) for _ in range(r.randint(lo, hi))).capitalize() + (r.choice("....!?") if r.random() < 0.9 else "") + (sign if good else "")

    def links(k: int) -> str:
        items = "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(k))
        return f"<ul>{items}</ul>" if r.random() < 0.7 else "".join(f'<a href="/x">{words(1, 2)}</a> | ' for _ in range(k))

    def name(kind: str) -> str:
        if mode == "none":
            return r.choice(["", "", 'style="margin:0"', 'data-x="1"'])
        made_up = "".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
        w = made_up if mode == "random" else r.choice(KEYWORDS[kind].split())
        w = r.choice([w, f"{w}-box", f"site-{w}", f"{w}_1", f"the{w.capitalize()}"])
        if mode == "misleading" and r.random() < (0.6 if kind == "main" else 0.1):  # of the element's own kind and of another
            other = r.choice(KEYWORDS[r.choice(list(KEYWORDS))].split())
            w = r.choice([f"{w} {other}", f"{other}-{made_up} {w}", f"{w}__{other}", f"{other} {made_up}"])
        return f'{r.choice(["class", "class", "id"])}="{w}"'

    def box(tag: str | None, kind: str, inner: str) -> str:
        if tag and r.random() < (0.6 if mode == "telling" else 0.35):
            return f"<{tag}>{inner}</{tag}>" if r.random() < 0.6 else f"<{tag} {name(kind)}>{inner}</{tag}>"
        t = r.choice(["div", "div", "section"])
        if mode != "telling" and kind == "talk" and r.random() < 0.4:
            t = r.choice(["ol", "ul"])
        return f"<{t} {name(kind)}>{inner}</{t}>"

    def junk(kind: str) -> str:
        return {
            "menu": lambda: box("nav", kind, links(r.randint(2, 9))),
            "head": lambda: box("header", kind, f"<{r.choice(['h1', 'p', 'div', 'span'])}>{words(1, 6)}" + (links(3) if r.random() < 0.5 else "")),
            "foot": lambda: box("footer", kind, r.choice([f"&copy; {words(2, 12)}", f"<p>{words(3, 25)}</p>", links(4) + f"<p>Copyright {words(2, 8)}</p>"])),
            "side": lambda: box("aside", kind, f"<h3>{words(1, 4)}</h3>" + r.choice([links(5), f"<p>{words(5, 60)}</p>", f"<p>{words(5, 40)}</p><p>{words(5, 40)}</p>"])),
            "advert": lambda: box(None, kind, r.choice([words(3, 25), f"<p>{words(3, 25)}</p>", f'<a href="/y">{words(2, 12)}</a>'])),
            "notice": lambda: box("dialog", kind, f"<p>{r.choice(['We use cookies. ', 'Subscribe to our newsletter. ', '', ''])}{words(3, 40)}</p>" + ("<button>Accept</button>" if r.random() < 0.5 else "")),
            "form": lambda: f'<form action="/z" {name("form") if r.random() < 0.4 else ""}><label>{words(1, 4)}</label><input name="q"><p>{words(1, 15)}</p><button>{words(1, 2)}</button></form>',
            "talk": lambda: box(None, kind, f"<h3>{words(1, 3)}</h3>" + "".join(r.choice([f'<div {name("talk")}><b>{words(1, 2)}</b><p>{words(3, 60)}</p></div>', f"<p>{words(3, 60)}</p>", f"<li><p>{words(3, 60)}</p></li>", f"<article><p>{words(3, 60)}</p></article>"]) for _ in range(r.randint(1, 5)))),
            "share": lambda: box(None, kind, links(r.randint(1, 4))),
        }[kind]()

    def paragraph() -> str:
        t = words(1, r.choice([4, 20, 60, 150]), True)
        kind = r.random()
        if kind < 0.7:
            return f"<p>{t}" + ("</p>" if r.random() < 0.8 else "")
        if kind < 0.76:
            return f"<p><b>{t}<br><p>{words(3, 60, True)}</p>"
        if kind < 0.82:
            return f"<{(h := r.choice(['h2', 'h3', 'h4']))}>{words(1, 8, True)}</{h}>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{words(1, 20, True)}</li>" for _ in range(r.randint(1, 4))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote>{t}</blockquote>"
        if kind < 0.95:
            return f'<p>{words(2, 20)} <a href="/k">{words(1, 3)}</a> {words(3, 30, True)}</p>'
        return f"<div>{t}</div>" if kind < 0.98 else f"<table><tr><td>{words(1, 6, True)}</td><td>{words(1, 6, True)}</td></tr></table>"

    def page() -> str:
        body = [paragraph() for _ in range(r.choice([1, 2, r.randint(1, 14), r.randint(1, 14)]))]
        if r.random() < 0.15:  # next to nothing, less than is around it
            body = [f"<p>{r.choice(['<b>', ''])}{words(1, 3, True)}{r.choice(['<br>', '</p>'])}"]
        if r.random() < 0.7:
            body.insert(0, f"<h1>{words(2, 10, True)}</h1>")
        for kind in ("advert", "side", "share", "form", "notice"):
            if r.random() < 0.18:
                body.insert(r.randint(1, len(body)), junk(kind))
        if r.random() < 0.2:
            body.append(junk("talk"))
        if r.random() < 0.12:  # an article's own header has its headline, and who wrote it
            body.insert(0, f"<header {name('head')}><h1>{words(2, 10, True)}</h1>" + r.choice(["", f'<p class="byline">{words(1, 3)}</p>', f"<time>{r.randint(1990, 2030)}-01-02</time>"]) + "</header>")
        inner = "".join(body)
        if r.random() < 0.2:
            inner = f"<div {name('main')}>{inner}</div>"
        style = r.random() if mode == "telling" else r.uniform(0.3, 1.0)
        if style < 0.5:
            main = f"<article>{inner}</article>"
        elif style < 0.65:
            main = f"<main>{inner}</main>"
        elif style < 0.9:
            main = f'<div {name("main")}>{inner}</div>'
        else:
            main = f"<div>{inner}</div>"
        if r.random() < 0.25:
            main = f"<main>{main}{junk('talk') if r.random() < 0.5 else ''}</main>"
        if r.random() < 0.1:  # nothing else, or no element around it
            return f"<html><body>{r.choice([inner, main])}</body></html>"
        if mode != "telling" and r.random() < 0.1:
            main = inner
        top = [junk(k) for k in ("head", "menu", "advert", "notice", "form", "side") if r.random() < 0.5]
        end = [junk(k) for k in ("talk", "side", "advert", "form", "notice", "foot", "menu") if r.random() < 0.4]
        r.shuffle(top)
        return "".join(["<!DOCTYPE html><html><head><title>x</title></head><body>", *top, main, *end, "</body></html>" if r.random() < 0.8 else ""])

    out = []
    while len(out) < count:
        mode = r.choice(naming)
        signed = page()
        y = [int(sign in b.text) for b in blocks(signed)]
        if any(y):
            out.append((blocks(signed.replace(sign, "")), y))
    return out


def main_text(page: str | None, field: Field) -> str:
    """The content blocks of a page, joined by one space; null and empty pages have none."""
    found = blocks(page or "")
    return " ".join(b.text for b, y in zip(found, field.decode(found)) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """pages(page_id, url, html) -> (page_id long, url string, text string, n_chars long in code points).

    Pages are read whole, one by one, so ties and repeated rows and null ids pass as they are. Null html is empty; a page
    without content has an empty text. Other columns are ignored. An empty table gives an empty one."""
    field = field or Field.fit(labelled_pages())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = [main_text(h.as_py(), field) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
