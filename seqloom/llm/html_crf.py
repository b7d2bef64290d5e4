"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags).  Each block has binary features of its ancestor
tags, of the words in their class, id and role, and of its text.  A two-label CRF is fitted on pages whose blocks are labelled
(``training_pages`` makes them, in several layouts), and each page is decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqloom.llm._store import clean_name, map_arrow

#: Tags whose content is never text of a page.
_RAW = frozenset("script style noscript template iframe object svg canvas audio video head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that stay inside a block.
_INLINE = frozenset(
    "a abbr acronym annotation b bdi bdo big cite code data del dfn em font i ins kbd mark math mfrac mi mn mo mrow ms msqrt mstyle msub msubsup msup mtext q rp rt ruby s samp small span strike strong semantics sub sup time tt u var wbr img".split()
)
#: Start tags that end an open element of the same kind.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table body html article section div nav aside header footer main form blockquote td th select".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: What stands in a tag before its end: quoted values may have ``>`` in them.
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", re.S)
#: Times a page's length that may be read in vain for tags whose quotes never close; after that the page's tags end at the next ``>``.
_VAIN = 8
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Block:
    text: str
    #: Feature names of all elements around it, and of the innermost one.
    around: frozenset
    own: frozenset
    linked: int


def _names(tag: str, attributes: str) -> frozenset:
    """Feature names of one element: its tag, and the words of its class, id and role."""
    out = {f"tag:{tag}"}
    if attributes and not attributes.isspace():
        for key, value in _ATTR.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id", "role"):
                out.update(f"name:{part.lower()}" for part in _NAME_PARTS.findall(value))
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                out.add("hidden")
    return frozenset(out)


_short_names = lru_cache(4096)(_names)


class _Elements:
    """The open elements of a page, with where each tag and each scope was opened last, so that closing takes no search."""

    def __init__(self, known: frozenset | None) -> None:
        self.known = known
        self.stack: list[tuple[str, frozenset, frozenset]] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def open(self, tag: str, names: frozenset) -> None:
        if self.known is not None:
            names &= self.known
        around = self.stack[-1][1] if self.stack else frozenset()
        place = len(self.stack)
        self.stack.append((tag, around if names <= around else around | names, names))
        self.places.setdefault(tag, []).append(place)
        if tag in _SCOPE:
            self.scopes.append(place)

    def close(self, tag: str, inside_scope: bool) -> None:
        """Close the innermost element of a tag and all in it; with ``inside_scope`` only if no other scope has been opened in it."""
        at = self.places.get(tag)
        if at and not (inside_scope and self.scopes and self.scopes[-1] > at[-1]):
            place = at[-1]
            while len(self.stack) > place:
                name = self.stack.pop()[0]
                self.places[name].pop()
                if name in _SCOPE:
                    self.scopes.pop()


def blocks(page: str, known: frozenset | None = None) -> list[Block]:
    """The leaf blocks of a page in order, white space collapsed, character references decoded, blank ones left out.

    With ``known`` only those feature names are kept.  The time grows with the page's length, whatever is left open in it.
    """
    found: list[Block] = []
    elements = _Elements(known)
    parts: list[str] = []
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, around, own = elements.stack[-1] if elements.stack else ("", frozenset(), frozenset())
                found.append(Block(text, around, own, min(linked, len(text))))
            parts.clear()
        linked = 0

    def keep(end: int) -> None:
        nonlocal linked
        if end > at:
            parts.append(page[at:end])
            if in_link:
                linked += end - at

    at = 0
    look = 0
    last_end = page.rfind(">")
    vain = 0
    while (start := page.find("<", look)) >= 0:
        if page.startswith(("<!--", "<![CDATA["), start):
            keep(start)
            close = "-->" if page[start + 2] == "-" else "]]>"
            end = page.find(close, start + (4 if close == "-->" else 9))
            at = look = len(page) if end < 0 else end + 3
            continue
        if start > last_end:
            # no tag ends from here on; only a comment could follow
            look = start + 1
            continue
        if page.startswith(("<!", "<?"), start):
            keep(start)
            at = look = page.find(">", start) + 1
            continue
        m = _TAG.match(page, start)
        if not m:
            look = start + 1
            continue
        quoted = _QUOTED.match(page, m.end()) if vain <= _VAIN * len(page) else None
        if quoted:
            end = quoted.end()
        else:
            vain += len(page) - start
            end = page.find(">", m.end()) + 1
        keep(start)
        at = look = end
        tag, attributes = m[2].lower(), page[m.end() : end - 1]
        if m[1]:
            if tag == "a":
                in_link = False
            if tag in _INLINE:
                continue
            flush()
            elements.close(tag, tag in ("li", "p", "td", "tr"))
            continue
        ended = attributes.rstrip().endswith("/")
        if tag in _RAW:
            flush()
            if not (ended and tag == "svg"):
                at = look = _raw_end(tag).search(page, at).end()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = True
        if tag in _INLINE:
            continue
        flush()
        if tag in _VOID:
            continue
        if elements.stack and elements.stack[-1][0] == "p":
            elements.close("p", False)
        for closed in _CLOSES.get(tag, ()):
            elements.close(closed, True)
        if not ended or tag in _SCOPE:
            elements.open(tag, _short_names(tag, attributes) if len(attributes) < 1000 else _names(tag, attributes))
    keep(len(page))
    flush()
    return found


@lru_cache(32)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>|\Z" if tag != "head" else r"</head\s*>|(?=<body[\s>])|\Z", re.I)


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features of each block."""
    out = []
    for b in found:
        n = len(b.text)
        names = {"bias", f"length:{min(8, n.bit_length())}", f"links:{4 * b.linked // n}"}
        names |= b.around
        names.update("own:" + x for x in b.own)
        if b.text[-1] in ".!?:;…。":
            names.add("ends a sentence")
        if "©" in b.text or "copyright" in b.text.lower():
            names.add("copyright")
        out.append(sorted(names))
    return out


class LinearChainCRF:
    """Two labels (0 boilerplate, 1 main text), binary features, first-order transitions."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray) -> None:
        self.index, self.emit, self.move = index, emit, move
        #: Names of elements that the model knows, around a block or as its own.
        self.names = frozenset(name.removeprefix("own:") for name in index)

    @classmethod
    def fit(cls, pages: list[list[list[str]]], labels: list[list[int]], rounds: int = 120, ridge: float = 0.02, least: int = 3) -> LinearChainCRF:
        """Maximum likelihood by gradient steps (Adam), with a ridge penalty; features seen on under ``least`` blocks are left out."""
        count: dict[str, int] = {}
        for page in pages:
            for row in page:
                for name in row:
                    count[name] = count.get(name, 0) + 1
        index = {name: i for i, name in enumerate(sorted(n for n, c in count.items() if c >= least))}
        longest = max(map(len, pages))
        seq, col, pos = [], [], []
        gold = np.zeros((len(pages), longest), np.int64)
        mask = np.zeros((len(pages), longest), bool)
        for s, (page, marks) in enumerate(zip(pages, labels, strict=True)):
            mask[s, : len(page)] = True
            gold[s, : len(page)] = marks
            for t, row in enumerate(page):
                for name in row:
                    if name in index:
                        seq.append(s)
                        pos.append(t)
                        col.append(index[name])
        cell = np.array(seq) * longest + np.array(pos)
        col = np.array(col)
        emit, move = np.zeros((len(index), 2)), np.zeros((2, 2))
        rate, m, v = 0.15, [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
        hot = np.eye(2)[gold] * mask[..., None]
        pairs = mask[:, 1:] & mask[:, :-1]
        for step in range(1, rounds + 1):
            score = np.stack([np.bincount(cell, emit[col, y], len(pages) * longest) for y in (0, 1)], 1).reshape(len(pages), longest, 2)
            alpha, beta = np.zeros_like(score), np.zeros_like(score)
            alpha[:, 0] = score[:, 0]
            for t in range(1, longest):
                alpha[:, t] = np.where(mask[:, t, None], np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, axis=1) + score[:, t], alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                beta[:, t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2), beta[:, t + 1])
            whole = np.logaddexp.reduce(alpha[:, -1], axis=1)
            node = np.exp(alpha + beta - whole[:, None, None]) * mask[..., None]
            edge = np.exp(alpha[:, :-1, :, None] + move + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * pairs[..., None, None]
            wrong = (node - hot).reshape(-1, 2)
            slope = [
                np.stack([np.bincount(col, wrong[cell, y], len(index)) for y in (0, 1)], 1) / len(pages) + ridge * emit / 10,
                (edge.sum((0, 1)) - (hot[:, :-1, :, None] * hot[:, 1:, None, :]).sum((0, 1))) / len(pages) + ridge * move / 10,
            ]
            for i, w in enumerate((emit, move)):
                m[i] = 0.9 * m[i] + 0.1 * slope[i]
                v[i] = 0.99 * v[i] + 0.01 * slope[i] ** 2
                w -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        return cls(index, emit, move)

    def decode(self, page: list[list[str]]) -> list[int]:
        """The most likely labels (Viterbi); ties go to main text."""
        gain = (self.emit[:, 1] - self.emit[:, 0]).tolist() if not hasattr(self, "_gain") else self._gain
        self._gain = gain
        index = self.index
        (m00, m01), (m10, m11) = self.move.tolist()
        back: list[tuple[int, int]] = []
        s0 = s1 = 0.0
        for t, row in enumerate(page):
            score = 0.0
            for name in row:
                i = index.get(name)
                if i is not None:
                    score += gain[i]
            if t:
                to0, to1 = (s0 + m00, s1 + m10), (s0 + m01, s1 + m11)
                back.append((int(to0[1] >= to0[0]), int(to1[1] >= to1[0])))
                s0, s1 = max(to0), max(to1) + score
            else:
                s1 = score
        label = int(s1 >= s0)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1] if page else []


_SYLLABLES = "an be cha der en fa gi ho is ju ka lo mi no or pa qui re sto ti u ver wi xa yo zu é ñó ß".split()
#: Words that sites put in class and id names of what is not the article.
BOILER_NAMES = {
    "nav": "nav menu navbar topnav breadcrumb breadcrumbs pagination tabs links toc skip".split(),
    "header": "header masthead logo branding topbar tagline".split(),
    "footer": "footer foot copyright legal colophon bottom".split(),
    "aside": "sidebar side aside widget rail related recommended trending popular tags".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense".split(),
    "notice": "notice cookie cookies consent alert gdpr popup modal overlay warning announcement paywall".split(),
    "form": "form search login signup subscribe newsletter contact feedback".split(),
    "comments": "comment comments reply replies respond discussion disqus responses reader".split(),
    "share": "share sharing social follow author byline meta".split(),
}
ARTICLE_NAMES = "article content post entry story main text body page single prose hentry articlebody maincontent".split()


def _prose(rng: random.Random, low: int, high: int) -> str:
    words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    out = " ".join(words).capitalize()
    return out + rng.choice([".", ".", ".", "", "!", "?", " &amp;", "###"])


def training_pages(n: int, seed: int = 0) -> list[tuple[str, list[int]]]:
    """``n`` labelled pages: html, and 1 for each block of the article and 0 for each other block."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts: list[str] = ['<!DOCTYPE html><html lang="en"><head><title>x</title><style>p{}</style></head><body>']
        marks: list[int] = []
        inline = rng.random() < 0.5

        def text(label: int, low: int = 1, high: int = 90, link: bool = False) -> str:
            marks.append(label)
            body = _prose(rng, low, high)
            if link:
                return f'<a href="/x">{body}</a>'
            if label and inline and rng.random() < 0.3:
                return f'{_prose(rng, 1, 9)} <{(tag := rng.choice(["b", "em", "a", "span", "strong"]))}>{body}</{tag}>'
            return body

        def boiler(kind: str) -> None:
            tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
            plain = rng.random() < 0.55
            name = rng.choice(BOILER_NAMES[kind])
            attribute = "" if plain and tag not in ("div", "section") else f' {rng.choice(["class", "class", "id"])}="{name}{rng.choice(["", "", "-box", " wrap", "_1"])}"'
            if not plain and rng.random() < 0.6:
                tag = "div"
            parts.append(f"<{tag}{attribute}>")
            if kind in ("nav", "share", "aside") or (kind in ("footer", "header") and rng.random() < 0.4):
                if rng.random() < 0.3:
                    parts.append(f"<h3>{text(0, 1, 4)}</h3>")
                parts.append("<ul>" + "".join(f"<li>{text(0, 1, 6, rng.random() < 0.9)}</li>" for _ in range(rng.randint(2, 7))) + "</ul>")
            elif kind == "form":
                parts.append(f"<label>{text(0, 1, 4)}</label><input type=text><p>{text(0, 1, 20)}</p>")
            elif kind == "comments":
                parts.append(f"<h3>{text(0, 1, 4)}</h3>" + "".join(f"<{w}>{text(0, 2, 60)}</{w}>" for w in rng.choices(["p", "div", "li"], k=rng.randint(1, 5))))
            elif rng.random() < 0.5:
                parts.append(text(0, 1, 30))
            else:
                parts.append("".join(f"<p>{text(0, 1, 40)}</p>" for _ in range(rng.randint(1, 3))))
            parts.append(f"</{tag}>")

        for kind in rng.sample(["nav", "header", "ad", "notice", "form", "share", "aside"], rng.randint(0, 4)):
            boiler(kind)
        shape = rng.choice(["article", "article", "main", "div", "div", "both"])
        name = rng.choice(ARTICLE_NAMES)
        start = {
            "article": "<article>",
            "main": "<main>",
            "div": f'<div {rng.choice(["class", "id"])}="{name}{rng.choice(["", "-body", " clearfix"])}">',
            "both": f'<main id="{name}"><article class="{rng.choice(ARTICLE_NAMES)}">',
        }[shape]
        parts.append(start)
        if rng.random() < 0.9:
            parts.append(f"<h1>{text(1, 1, 15)}</h1>")
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.62:
                parts.append(f"<p>{text(1)}" + ("</p>" if rng.random() < 0.85 else "<br>"))
            elif kind < 0.72:
                parts.append(f"<h2>{text(1, 1, 8)}</h2>")
            elif kind < 0.8:
                parts.append("<ul>" + "".join(f"<li>{text(1, 1, 20, rng.random() < 0.15)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.85:
                parts.append(f"<blockquote><p>{text(1, 3, 40)}</p></blockquote>")
            elif kind < 0.88:
                parts.append(f"<table><tr><td>{text(1, 1, 5)}</td><td>{text(1, 1, 5)}</td></tr></table>")
            elif kind < 0.9:
                parts.append(f"<pre>{text(1, 2, 20)}</pre>")
            elif kind < 0.93:
                parts.append(f"<figure><figcaption>{text(1, 2, 12)}</figcaption></figure>")
            else:
                boiler(rng.choice(["ad", "ad", "share", "form", "aside", "notice"]))
        if rng.random() < 0.2:
            boiler("comments")
        parts.append({"article": "</article>", "main": "</main>", "div": "</div>", "both": "</article></main>"}[shape])
        for kind in rng.sample(["comments", "aside", "footer", "ad", "nav", "form", "share", "notice"], rng.randint(0, 4)):
            boiler(kind)
        if rng.random() < 0.8:
            parts.append("</body></html>")
        out.append(("".join(parts), marks))
    return out


@lru_cache(1)
def default_model(pages: int = 500, seed: int = 11) -> LinearChainCRF:
    """The model that queries use: fitted on ``pages`` labelled pages, once per process."""
    made = [(blocks(page), marks) for page, marks in training_pages(pages, seed)]
    made = [(found, marks) for found, marks in made if len(found) == len(marks)]
    return LinearChainCRF.fit([features(found) for found, _ in made], [marks for _, marks in made])


def main_text(page: str, model: LinearChainCRF) -> str:
    found = blocks(page, model.names)
    return "\n".join(b.text for b, keep in zip(found, model.decode(features(found)), strict=True) if keep)


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: LinearChainCRF | None = None
) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``.

    Very long pages are read whole, in time that grows with their length; tags that never end are text.  Of equally likely labellings the one with main text is taken.
    Null and empty pages, and pages without main text, have the empty text.  Text outside any tag is a block like any other.
    Repeated rows each give a row, an empty table none; other columns are ignored.
    """
    crf = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(cell.as_py() or "", crf) for cell in batch.column(2)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    source = clean_name(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    return map_arrow(source, run, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
