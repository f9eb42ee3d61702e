"""Main text of HTML pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block is read as hashed vectors of its tag path (tags, and the
words of class, id and role) and of its words, with a few sizes; a bidirectional LSTM in numpy gives each
block the probability of being article text from the whole page's sequence.

It is trained here, on a bounded sample of about `sample` pages. The text of these pages is set into
layouts that are made up from lists of usual container names, so that the true label of each block is
known, and the sampled pages themselves are added, with blocks below an article or main element as
article text. The weights (some hundred kilobytes) go to the tasks, and pages are not shuffled.

Defined cases: null or empty html, and pages without article text, give an empty text; unclosed tags,
comments and scripts end with the page; repeated rows are extracted each; without any page to sample the
model knows the made-up layouts only by their own words; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, slices
from .html_blocks import Block, blocks
from .lstm import BiLSTM, fit, padded

_PATH, _WORDS, _SIZES = 128, 64, 6
_WIDTH = _PATH + _WORDS + _SIZES
_HIDDEN = 16
#: Blocks times pages that are labelled at once.
_AT_ONCE = 40_000
_word, _digit = re.compile(r"\w+|©"), re.compile(r"\d")

#: How pages usually name what holds the article, and what does not.
_ARTICLE = ["article", "main", "section", "div"]
_ARTICLE_NAMES = ["content", "article", "main", "post", "entry", "story", "body", "text", "article body", "post content", "entry content", "main content", "page content"]
_OTHER = {
    "nav": ["nav", "menu", "navigation", "navbar", "breadcrumb", "main nav", "top menu", "links"],
    "header": ["header", "site header", "masthead", "topbar", "page header", "branding", "banner"],
    "footer": ["footer", "site footer", "copyright", "bottom", "page footer", "legal", "credits"],
    "aside": ["sidebar", "aside", "related", "widget", "popular", "recent posts", "tags", "teaser", "recommended", "more"],
    "notice": ["cookie", "notice", "consent", "alert", "gdpr", "popup", "modal", "cookie banner", "privacy notice"],
    "advert": ["ad", "ads", "advert", "sponsor", "promo", "advertisement", "sponsored", "banner ad"],
    "form": ["form", "newsletter", "search", "login", "subscribe", "signup", "contact form"],
    "comments": ["comments", "comment", "comment list", "replies", "discussion", "responses", "disqus", "reader comments"],
    "share": ["share", "social", "sharing", "meta", "byline", "pagination", "pager", "tools"],
}
#: What may stand inside an article without being its text, as made-up pages have it, and as sampled pages name it.
_INSIDE = ["aside", "advert", "form", "comments", "share"]
_APART_TAGS = frozenset("aside nav footer form".split())
_APART_NAMES = frozenset(f".{w}" for w in "comment comments replies disqus ad ads advert advertisement sponsor sponsored share social sharing newsletter subscribe related sidebar recommended".split())
_OWN_TAG = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}
_PHRASES = {
    "nav": ["Home", "About", "Contact", "News", "Archive", "Login", "Help", "Blog", "Products", "Start"],
    "header": ["Welcome to", "The site of", "News and more"],
    "footer": ["© 2024", "All rights reserved", "Privacy policy", "Terms of use", "Imprint", "Copyright"],
    "aside": ["Related", "Most read", "Popular posts", "See also", "Recent posts", "Tags"],
    "notice": ["We use cookies", "Accept all", "This site uses cookies to", "Manage consent", "Please enable JavaScript"],
    "advert": ["Advertisement", "Sponsored", "Buy now", "Special offer"],
    "form": ["Subscribe to our newsletter", "Your e-mail", "Search", "Sign up", "Send", "Password", "Name"],
    "comments": ["Comments", "Reply", "says:", "wrote on", "Leave a comment", "1 comment"],
    "share": ["Share on", "Tweet", "Posted by", "Next page", "Print", "E-mail this"],
}


@lru_cache(maxsize=200_000)
def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % size


@lru_cache(maxsize=20_000)
def _path_slots(path: tuple[tuple[str, ...], ...]) -> tuple[int, ...]:
    """The places of a path in its hashed vector: its elements, and those of the leaf once more."""
    slots = {_slot(token, _PATH) for element in path for token in element}
    return tuple(slots | {_slot(f"leaf {token}", _PATH) for token in (path[-1] if path else ("none",))})


def features(page: list[Block]) -> np.ndarray:
    """A row per block."""
    rows, columns, values, sizes = [], [], [], []
    for i, block in enumerate(page):
        slots = _path_slots(block.path)
        words = _word.findall(block.text.lower())
        rows += [i] * (len(slots) + len(words))
        columns += slots
        columns += [_slot(w, _WORDS) + _PATH for w in words]
        values += [1.0] * len(slots)
        values += [1 / len(words)] * len(words) if words else []
        n, digits = len(block.text), len(_digit.findall(block.text))
        sizes.append((min(math.log1p(n) / 7, 2), block.linked, i / len(page), block.text[-1] in ".!?:\"'", digits / n, len(page) < 4))
    found = np.bincount(np.array(rows, np.int64) * _WIDTH + np.array(columns, np.int64), values, len(page) * _WIDTH).reshape(-1, _WIDTH)
    if page:
        found[:, _PATH + _WORDS :] = sizes
    return found.astype(np.float32)


def _names(rng: random.Random, name: str) -> str:
    joined = rng.choice(["-", "_", " "]).join(name.split())
    return f"{rng.choice(['class', 'class', 'id'])}=\"{joined}\""


def _sentences(rng: random.Random, texts: list[str]) -> str:
    """A paragraph: a sampled block, or a part of one."""
    words = rng.choice(texts).split()
    if rng.random() < 0.3:
        start = rng.randrange(len(words))
        words = words[start : start + rng.choice([3, 8, 20])]
    return " ".join(words).replace("&", "&amp;").replace("<", "&lt;")


def _other_part(rng: random.Random, kind: str, texts: list[str]) -> str:
    """A part of a page that is not the article."""
    phrase = lambda: rng.choice([rng.choice(_PHRASES[kind]), " ".join(rng.choice(texts).split()[: rng.choice([1, 2, 4])])])
    shape = rng.random()
    if kind in ("nav", "share", "aside") and shape < 0.7:
        inside = "<ul>" + "".join(f'<li><a href="/x">{phrase()}</a></li>' for _ in range(rng.randrange(2, 9))) + "</ul>"
    elif kind == "form" or shape < 0.2:
        inside = f"<p>{phrase()}</p>" + (f"<button>{phrase()}</button>" if kind in ("form", "notice") else f"<p>{phrase()}</p>")
    elif kind == "comments" or shape < 0.4:
        inside = "".join(f"<div class=\"comment\"><p>{phrase()}</p><p>{_sentences(rng, texts)}</p></div>" if kind == "comments" else f"<p>{_sentences(rng, texts)}</p>" for _ in range(rng.randrange(1, 4)))
    elif kind == "footer":
        inside = f"{phrase()} &middot; {_sentences(rng, texts)}"
    else:
        inside = _sentences(rng, texts) if shape < 0.8 else f"{phrase()} {_sentences(rng, texts)}"
    own = _OWN_TAG.get(kind)
    tag = own if own and rng.random() < 0.6 else "div"
    name = "" if tag == own and rng.random() < 0.4 else " " + _names(rng, rng.choice(_OTHER[kind]))
    return f"<{tag}{name}>{inside}</{tag}>"


def made_up_page(rng: random.Random, texts: list[str]) -> tuple[str, int, int]:
    """A page, and where its article starts and ends."""
    before, after = [], []
    for kind, share, first in (("header", 0.6, 0.95), ("nav", 0.8, 0.9), ("notice", 0.3, 0.5), ("advert", 0.6, 0.6), ("share", 0.4, 0.4), ("aside", 0.5, 0.4), ("form", 0.3, 0.3), ("comments", 0.45, 0.0), ("footer", 0.9, 0.02)):
        if rng.random() < share:
            (before if rng.random() < first else after).append(_other_part(rng, kind, texts))
    if rng.random() < 0.3:
        rng.shuffle(before)
    tag = rng.choice(_ARTICLE)
    name = "" if tag in ("article", "main") and rng.random() < 0.6 else " " + _names(rng, rng.choice(_ARTICLE_NAMES))
    parts = [f"<h1>{' '.join(_sentences(rng, texts).split()[:9])}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.choice([0, 1, 2, 4, 8, 15]) if parts else rng.choice([1, 2, 4, 8, 15])):
        shape = rng.random()
        text = _sentences(rng, texts)
        if shape < 0.72:
            parts.append(f"<p>{text}</p>")
        elif shape < 0.8:
            parts.append(f"<p><b>{text}<br>")
        elif shape < 0.86:
            parts.append(f"<h2>{' '.join(text.split()[:6])}</h2>")
        elif shape < 0.92:
            parts.append("<ul>" + "".join(f"<li>{_sentences(rng, texts)}</li>" for _ in range(rng.randrange(1, 4))) + "</ul>")
        elif shape < 0.96:
            parts.append(f"<blockquote>{text}</blockquote>")
        else:
            parts.append(f'<p>{text} <a href="/y">{" ".join(text.split()[:2])}</a></p>')
    head = "<!DOCTYPE html><html><body>" + ("<div id=\"wrapper\">" if rng.random() < 0.3 else "") + "".join(before)
    article = f"<{tag}{name}>" + "".join(parts) + f"</{tag}>"
    return head + article + "".join(after) + rng.choice(["", "</body></html>"]), len(head), len(head) + len(article)


_END_OF_PART = re.compile(r"</(?:p|ul|h2|blockquote)>")


def mixed_page(rng: random.Random, texts: list[str]) -> tuple[str, np.ndarray]:
    """A made-up page with parts inside its article that are not the article's text, and the labels of its blocks."""
    page, start, end = made_up_page(rng, texts)
    places = [m.end() for m in _END_OF_PART.finditer(page, start, end)]
    cuts = [start]
    for place in sorted(rng.sample(places, min(len(places), rng.choice([1, 1, 2]))), reverse=True):
        part = _other_part(rng, rng.choice(_INSIDE), texts)
        page, end = page[:place] + part + page[place:], end + len(part)
        cuts = [cuts[0], place, place + len(part), *(c + len(part) for c in cuts[1:])]
    before = [len(blocks(page[:c])) for c in [*cuts, end]]
    labels = np.zeros(len(blocks(page)), np.float32)
    for a, b in zip(before[::2], before[1::2]):
        labels[a:b] = 1
    return page, labels


def in_article(block: Block) -> bool:
    """Whether a block stands in an article element, and in no part of it that holds something else."""
    container = next((i for i, e in enumerate(block.path) if e[0] in ("article", "main")), None)
    if container is None:
        return False
    return not any(e[0] in _APART_TAGS or _APART_NAMES.intersection(e[1:]) for e in block.path[container + 1 :])


def training_sequences(pages: list[str], made_up: int, seed: int = 0, most: int = 400) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of the sampled pages, and of made-up pages with their text; those of over `most` blocks are left out."""
    rng, parsed = random.Random(seed), [blocks(p) for p in pages]
    texts = [b.text for p in parsed for b in p if len(b.text.split()) > 4] or [" ".join(x) for x in _PHRASES.values()]
    found = []
    for page in parsed:
        inside = [in_article(b) for b in page]
        if any(inside):
            found.append((features(page), np.array(inside, np.float32)))
    for i in range(made_up):
        if i % 4 == 3:
            page, labels = mixed_page(rng, texts)
            found.append((features(blocks(page)), labels))
            continue
        page, start, end = made_up_page(rng, texts)
        first, middle = blocks(page[:start]), blocks(page[:end])
        whole = blocks(page)
        labels = np.zeros(len(whole))
        labels[len(first) : len(middle)] = 1
        found.append((features(whole), labels))
    return [(x, y) for x, y in found if 0 < len(x) <= most]


def train(pages: DataFrame, sample: int = 250, made_up: int = 700, epochs: int = 4, id_col: str = "page_id", html_col: str = "html", most: int = 400) -> BiLSTM:
    """Fit the labeller on about `sample` pages of at most 100 kB and `most` blocks; pages of any size are labelled."""
    rows = narrow(pages, id=id_col, html=html_col).where("octet_length(html) between 1 and 100000")
    total = rows.count()
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(sample / max(1, total)) * (1 << 20)
    chosen = [r["html"] for r in rows.where(drawn).sort("id", "html").collect()]
    model = BiLSTM(_WIDTH, _HIDDEN)
    fit(model, training_sequences(chosen, made_up, most=most), epochs)
    return model


def label(pages: list[list[Block]], model: BiLSTM) -> list[np.ndarray]:
    """The probability of each block of each page; pages of like length go together."""
    found: list[np.ndarray] = [np.zeros(0)] * len(pages)
    waiting = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while waiting:
        group = [waiting.pop()]
        longest = len(pages[group[0]])
        while waiting and (len(group) + 1) * longest <= _AT_ONCE and 2 * len(pages[waiting[-1]]) >= longest:
            group.append(waiting.pop())
        p = model.probabilities(*padded([(features(pages[i]), np.zeros(len(pages[i]))) for i in group])[:2])
        for k, i in enumerate(group):
            found[i] = p[: len(pages[i]), k]
    return found


def extract(pages: DataFrame, model: BiLSTM, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: page_id, url, text and labels (of each block: text, probability)."""
    rows = narrow(pages, page_id=id_col, url=url_col, html=html_col).withColumn("html", F.col("html").cast("string"))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    block = pa.struct([("text", pa.string()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            parsed = [blocks(h or "") for h in batch.column(2).to_pylist()]
            scores = label(parsed, shared.value)
            texts = ["\n".join(b.text for b, s in zip(page, own) if s >= 0.5) for page, own in zip(parsed, scores)]
            labels = pa.array([[{"text": b.text, "probability": float(s)} for b, s in zip(page, own)] for page, own in zip(parsed, scores)], pa.list_(block))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts), labels], ["page_id", "url", "text", "labels"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, labels array<struct<text string, probability double>>")
