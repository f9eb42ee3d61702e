"""Language identification of whole texts, with spans for mixed ones.

Words (runs of letters) get a score per language: log probabilities of their character trigrams. The
script of a word narrows the languages to those that use it. Viterbi over the words of a text, with a
penalty for each switch of language, labels its spans; the text's language is the one with most letters.

The model is fitted on a bounded sample: about `sample` documents per language, those with the smallest
hashes of their ids, each with its whole text. Trigrams are counted by Spark; what comes to the driver
is a row per language and trigram of that sample.

Defined cases: a text that is null or has no letter is `und` with score 0 and no span; without labelled
text everything is `und`; ties go to the language first by name; repeated rows are labelled each; words
in a script of no language are scored by all; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, slices

#: First code points of script ranges, in order. A blank name is no letter's range or any other script.
_SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, ""), (0x0750, "Arabic"), (0x0780, ""), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, ""), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, ""), (0x2C60, "Latin"), (0x2C80, ""), (0x2DE0, "Cyrillic"), (0x2E00, ""), (0x3040, "Kana"),
    (0x3100, ""), (0x3400, "Han"), (0xA000, ""), (0xA640, "Cyrillic"), (0xA6A0, ""), (0xA720, "Latin"), (0xA800, ""), (0xAC00, "Hangul"),
    (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, ""), (0xFB50, "Arabic"), (0xFE00, ""), (0x20000, "Han"),
]
_STARTS = [a for a, _ in _SCRIPTS]
#: A script counts as used by a language from this share of its letters on.
_SCRIPT_SHARE = 0.01
_OUT_OF_SCRIPT = -1000.0
_SMOOTHING = 0.1
_SLICE = 12_000_000
_words = re.compile(r"[^\W\d_]+")


def script(word: str) -> str:
    """The script of the first letter of a word."""
    first = next((c for c in word if c.isalpha()), "\0")
    return _SCRIPTS[bisect_right(_STARTS, ord(first)) - 1][1]


def _trigrams(word: str) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + 3] for i in range(len(marked) - 2)]


def _gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, kind (gram or script), name and n over labelled text (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                words[lang].update(_words.findall(text.lower()))
            found: Counter = Counter()
            for lang, counts in words.items():
                for word, n in counts.items():
                    for gram in _trigrams(word):
                        found[lang, "gram", gram] += n
                    found[lang, "script", script(word)] += n * len(word)
            langs, kinds, names = zip(*found) if found else ((), (), ())
            strings = [pa.array(x, pa.string()) for x in (langs, kinds, names)]
            yield pa.RecordBatch.from_arrays([*strings, pa.array(list(found.values()), pa.int64())], ["lang", "kind", "name", "n"])

    return labelled.mapInArrow(run, "lang string, kind string, name string, n long").groupBy("lang", "kind", "name").agg(F.sum("n").alias("n"))


def _keys(points: np.ndarray) -> np.ndarray:
    """One number for three code points each (21 bits a point)."""
    wide = points.astype(np.uint64)
    return wide[..., 0] << np.uint64(42) | wide[..., 1] << np.uint64(21) | wide[..., 2]


class Model:
    """Trigram log probabilities per language, and the languages of each script."""

    def __init__(self, rows: list[tuple[str, str, str, int]]):
        self.langs = sorted({lang for lang, kind, _, _ in rows if kind == "gram"})
        number = {lang: i for i, lang in enumerate(self.langs)}
        grams = sorted({name for _, kind, name, _ in rows if kind == "gram"})
        counts, at = np.zeros((len(grams), len(self.langs))), {g: i for i, g in enumerate(grams)}
        letters: dict[str, Counter] = defaultdict(Counter)
        for lang, kind, name, n in rows:
            if kind == "gram":
                counts[at[name], number[lang]] = n
            else:
                letters[lang][name] += n
        total = counts.sum(axis=0) + _SMOOTHING * (len(grams) + 1)
        self.unseen = np.log(_SMOOTHING / total).astype(np.float32)
        values = np.log((counts + _SMOOTHING) / total).astype(np.float32)
        points = np.array([[ord(c) for c in g] for g in grams], np.uint32).reshape(-1, 3)
        keys = _keys(points)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.scripts = {s: [number[x] for x in self.langs if letters[x][s] >= _SCRIPT_SHARE * sum(letters[x].values())] for s in {s for _, s in _SCRIPTS}}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row per word with its score in each language."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        if not words:
            return out
        marked = [f"^{w.lower()}$" for w in words]
        sizes = np.array([len(m) for m in marked], np.int64)
        points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        n = sizes - 2
        firsts = np.cumsum(sizes) - sizes
        begin = np.cumsum(n) - n
        at = np.repeat(firsts - begin, n) + np.arange(int(n.sum()))
        keys = _keys(np.stack([points[at], points[at + 1], points[at + 2]], axis=1))
        where = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        rows = np.where((self.keys[where] == keys)[:, None], self.values[where], self.unseen)
        out = np.add.reduceat(rows, begin, axis=0)
        for i, word in enumerate(words):
            own = self.scripts[script(word)]
            if own and len(own) < len(self.langs):
                others = np.ones(len(self.langs), bool)
                others[own] = False
                out[i, others] += _OUT_OF_SCRIPT
        return out


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word of many texts at once. scores: a row per word; texts lie one after the other.

    Texts go in step, the longest first, so that step t holds a prefix of them.
    """
    order = np.argsort(-sizes, kind="stable")
    first, n = starts[order], sizes[order]
    longest = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(longest), "left")  # texts with more than t words
    best = np.zeros((len(n), scores.shape[1]))
    switched, source = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    for t in range(longest):
        m = alive[t]
        at = first[:m] + t
        old = best[:m]
        top = old.max(axis=1, keepdims=True) - penalty
        if t:
            switched[at] = top > old
            source[at] = old.argmax(axis=1)
            old = np.maximum(old, top)
        best[:m] = old + scores[at]
    label, found = best.argmax(axis=1), np.zeros(len(scores), np.int16)
    for t in range(longest - 1, -1, -1):
        m = alive[t]
        at, now = first[:m] + t, label[:m]
        found[at] = now
        label[:m] = np.where(switched[at, now], source[at], now)
    return found


class Labeller:
    """Labels texts; keeps the scores of at most `most` words."""

    def __init__(self, model: Model, penalty: float, most: int = 600_000):
        self.model, self.penalty, self.most = model, penalty, most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.langs)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """(language, score, spans of (language, start, end)) of each text."""
        langs = self.model.langs
        if not langs:
            return [("und", 0.0, [])] * len(texts)
        if len(self.known) > self.most:
            self._clear()
        known, fresh, cut = self.known, [], []
        for text in texts:
            words = _words.findall(text or "")
            for w in words:
                if w not in known:
                    known[w] = len(known)
                    fresh.append(w)
            cut.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        if fresh:
            self.scores = np.concatenate([self.scores, self.model.word_scores(fresh)])
            self.letters = np.concatenate([self.letters, np.fromiter((sum(map(str.isalpha, w)) for w in fresh), np.int64, len(fresh))])
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        starts = np.cumsum(sizes) - sizes
        at = np.concatenate(cut) if cut else np.zeros(0, np.int32)
        scores = self.scores[at]
        labels = viterbi(scores, starts, sizes, self.penalty)
        letters = self.letters[at]
        own = np.repeat(np.arange(len(texts)), sizes) * len(langs) + labels
        weight = np.bincount(own, letters, len(texts) * len(langs)).reshape(len(texts), len(langs))
        found = []
        for i, text in enumerate(texts):
            total = weight[i].sum()
            if not total:
                found.append(("und", 0.0, []))
                continue
            best = int(weight[i].argmax())
            found.append((langs[best], float(weight[i, best] / total), self._spans(text, labels[starts[i] : starts[i] + sizes[i]])))
        return found

    def _spans(self, text: str, labels: np.ndarray) -> list[tuple[str, int, int]]:
        if (labels == labels[0]).all():
            first, last = _words.search(text).start(), len(text)
            while not _words.fullmatch(text[last - 1]):
                last -= 1
            return [(self.model.langs[labels[0]], first, last)]
        places = [m.span() for m in _words.finditer(text)]
        runs = groupby(zip(labels.tolist(), places), key=lambda x: x[0])
        runs = [(k, [p for _, p in own]) for k, own in runs]
        return [(self.model.langs[k], p[0][0], p[-1][1]) for k, p in runs]


def train(labelled: DataFrame, sample: int = 3000) -> Model:
    """Fit the model on labelled rows (id, lang, text); about `sample` documents per language are used."""
    rows = labelled.where("lang is not null and text is not null")
    share = rows.groupBy("lang").agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("share"))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    chosen = rows.join(F.broadcast(share), "lang").where(drawn).select("lang", "text")  # share: a row per language
    return Model([tuple(r) for r in _gram_counts(chosen).collect()])


def predict(docs: DataFrame, model: Model, penalty: float = 10.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, lang_pred, score (share of the letters) and spans of (lang, start, end)."""
    rows = narrow(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, penalty)
        for batch in slices(batches, 1, _SLICE):
            langs, scores, spans = zip(*labeller.label(batch.column(1).to_pylist()))
            listed = pa.array([[{"lang": a, "start": b, "end": c} for a, b, c in s] for s in spans], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores), listed], ["doc_id", "lang_pred", "score", "spans"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<lang string, start bigint, end bigint>>")
