"""Token ids of texts, with a tokenizer file that is only read.

White space separates what a byte-level or word-end BPE looks at: a piece that starts at a single space
or line break after a visible character is encoded alone just as it is inside the text. So each piece is
encoded once and looked up afterwards. A text with any other white space is encoded whole, and so is one that
holds the string of an added token, which the tokenizer gives its own id.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from .common import held, no_cycles

#: A word of Latin letters, with the space or line break before it, and the ASCII signs after it.
#: Left out: the apostrophe, which belongs to words, and U+0130, whose lower case has a sign in it.
_WORD_AND_SIGNS = re.compile(r"([ \n]?[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\[-`{-~]+)").fullmatch


class _Known(dict):
    """Piece to its number; a new piece gets the next one and is listed in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.size = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.data):
            more = np.zeros(2 * (self.size + len(values)), self.data.dtype)
            more[: self.size] = self.data[: self.size]
            self.data = more
        self.data[self.size : self.size + len(values)] = values
        self.size += len(values)

    def all(self) -> np.ndarray:
        return self.data[: self.size]


class Encoder:
    """Encodes batches of texts; keeps at most `most` pieces."""

    def __init__(self, path: str, end_id: int, most: int):
        from tokenizers import Tokenizer

        # a task has one core, and each thread of the tokenizer would hold memory of its own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = tuple(t.content for t in added)
        #: Added tokens that are looked for in the normalised text may be spelled otherwise in the text itself.
        self.normalised = any(t.normalized for t in added)
        self.end_id, self.most, self.signs = end_id, most, {}
        self.spaced, self.plain = self._word_forms()
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._start()

    def _word_forms(self) -> tuple[str | None, bool]:
        """How the model itself spells an ASCII word after a space: with what before it, and whether in lower case.

        None: it has neither of the spellings known here, and words take the same way as all other pieces.
        """
        words = ["the", "Zebra", "QuUx"]
        whole = [self.tokenizer.encode(" " + w, add_special_tokens=False).ids for w in words]
        for before, lower in (("Ġ", False), ("", True)):
            if whole == [self._spelled(before + (w.lower() if lower else w)) for w in words]:
                return before, lower
        return None, False

    def _spelled(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _start(self) -> None:
        """Begin without pieces; number 0 is the end of a text."""
        self.known = _Known()
        self.known["\0end"] = 0
        self.flat, self.starts, self.lengths = _Grown(np.uint32), _Grown(np.int64), _Grown(np.int64)
        self.whole, self.used = _Grown(bool), _Grown(np.int64)
        self._add([[self.end_id]], np.zeros(1, bool))

    def _add(self, ids: list[list[int]], whole: np.ndarray) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts.add(self.flat.size + np.cumsum(lengths) - lengths)
        self.flat.add(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())))
        self.lengths.add(lengths)
        self.whole.add(whole)
        self.used.add(np.zeros(len(ids), np.int64))

    def _learn(self) -> None:
        """Encode the fresh pieces. A key that starts with a space stands at the start of a text.

        A word with signs after it is the word's ids and the signs' ids.
        """
        parts = {p: m.groups() for p in self.known.fresh if (m := _WORD_AND_SIGNS(p))}
        for word, _ in parts.values():
            self.known[word]
        pieces, self.known.fresh = self.known.fresh, []
        whole, found, asked = np.zeros(len(pieces), bool), {}, {}
        for i, p in enumerate(pieces):
            if p in parts:
                continue
            raw = p[1:] if p[:1] in (" ", "\n") else p
            if self.spaced is not None and raw.isascii() and raw.isalpha():
                word = raw.lower() if self.plain else raw
                found[p] = self._spelled(word if raw is not p else self.spaced + word)
                if p[0] == "\n":
                    found[p] = self.line_break + found[p]
            elif raw.split() != [raw]:
                whole[i], found[p] = True, []
            else:
                asked[p] = raw if p[0] == " " else p if p[0] == "\n" else " " + p
        signs = sorted({s for _, s in parts.values()} - self.signs.keys())
        got = self.tokenizer.encode_batch([*asked.values(), *signs], add_special_tokens=False)
        found.update((p, e.ids) for p, e in zip(asked, got))
        self.signs.update((s, e.ids) for s, e in zip(signs, got[len(asked) :]))
        for piece, (word, sign) in parts.items():
            if word not in found:
                at = self.known[word]
                begin = int(self.starts.data[at])
                found[word] = self.flat.data[begin : begin + int(self.lengths.data[at])].tolist()
            found[piece] = found[word] + self.signs[sign]
        self._add([found[p] for p in pieces], whole)

    def _shrink(self) -> None:
        """Keep pieces that were used again."""
        keep = np.flatnonzero((self.used.all() > 1) & ~self.whole.all())
        keep = keep[keep > 0][: self.most // 2]
        names, lengths = list(self.known), self.lengths.all()[keep]
        flat = _ragged(self.flat.data, self.starts.data, self.lengths.data, keep)
        ids = [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] if len(keep) else []
        self._start()
        for i in keep.tolist():
            self.known[names[i]]
        self.known.fresh = []
        self._add(ids, np.zeros(len(keep), bool))

    def _has_added(self, text: str) -> bool:
        """Whether the text may hold an added token."""
        return self.normalised or any(a in text for a in self.added)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, an end id after each, and how many each has."""
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        with no_cycles():
            return self._encode(texts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most:
            self._shrink()
        cut, sizes = [], []
        for text in texts:
            pieces = text.replace("\n", " \n").split(" ")
            pieces[0] = " " + pieces[0]
            pieces.append("\0end")
            cut.append(pieces)
            sizes.append(len(pieces))
        sizes = np.array(sizes, np.int64)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        if self.known.fresh:
            self._learn()
        seen = np.bincount(at)
        self.used.data[: len(seen)] += seen
        firsts = np.cumsum(sizes) - sizes
        ids = _ragged(self.flat.data, self.starts.data, self.lengths.data, at)
        n = np.add.reduceat(self.lengths.data[at], firsts)
        special = np.fromiter(map(self._has_added, texts), bool, len(texts))
        odd = np.flatnonzero(np.logical_or.reduceat(self.whole.data[at], firsts) | special)
        if len(odd):
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i, e in zip(odd.tolist(), self.tokenizer.encode_batch([texts[i] for i in odd.tolist()], add_special_tokens=False)):
                parts[i] = np.array([*e.ids, self.end_id], np.uint32)
            ids, n = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, n


def _ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lengths[i]] for each i of `at`, one after the other."""
    n = lengths[at]
    before = np.cumsum(n)
    total = int(before[-1]) if len(n) else 0
    return flat[np.repeat(starts[at] - before + n, n) + np.arange(total)]


def encoder(path: str, end_id: int, most: int) -> Encoder:
    """The encoder of this worker process; its pieces serve later tasks too."""
    return held(("encoder", path, end_id, most), lambda: Encoder(path, end_id, most))
