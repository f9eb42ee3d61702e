"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is per language (and one of all languages, named "", for texts without a language of their
own). It predicts the characters of a text, each from up to four before it, also over word boundaries. A
word begins with a mark that says whether a sentence begins there, and ends with an end mark; its first three
characters are predicted from the end of the text before it too.

Training counts n-grams of all trusted words, and joins the counts by their contexts and their suffixes,
sharded by Spark: adjusted counts (raw for the highest order and for n-grams at the beginning of a word,
else the number of distinct characters before them), three discounts per language and order, back-off
weights, and interpolated probabilities. The model is stored in blocks by the two characters before the
predicted one, so that all that a place in a text needs lies in one block: sorted hashes and their values, in files
that tasks map and search in place. A block is opened once by a worker, whatever the number of blocks and texts, and the
system shares what is read among the workers of a machine. Tasks look up each distinct n-gram of some texts at once,
and remember the latest in a table of fixed size; nothing is shuffled per document.

A document's perplexity is per character. Its language's quartiles give the limit: log perplexity over the
upper quartile plus `fence` quartile distances is rejected. The distance counts more for texts shorter than
the language's median, by the root of the ratio, as a mean of fewer characters scatters more, and has a
lower bound. The quartiles are those of trusted texts, each distinct text once: a quarter of them is set
apart by digest, and the model learns from the rest. So neither copies nor the share of junk in the input
move a limit. Only a language with too few trusted texts for that (LEAST_APART set apart) learns from all of
them and takes the quartiles of all its distinct documents; there junk counts, and is found up to a quarter.

Defined cases: a text without a word (null, empty) has no perplexity and is kept; a null language and a
language without trusted text use the model of all languages, and have a limit of their own; words of over
64 characters are scored in parts of 64; repeated rows count each in training, once in quartiles; without
trusted text all perplexities are 1 and all rows stay; an empty table gives an empty result; other columns
are ignored by `judge` and carried by `drop`.
"""

from __future__ import annotations

import mmap
import shutil
import tempfile
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import by_position, held, narrow, no_cycles, position, scratch, settle, shared_files, slices, trim

ORDER = 5
FENCE = 3.0
#: Distinct trusted texts of a language that are enough to set its limit.
LEAST_APART = 20
#: The least distance of the quartiles of log perplexity.
LEAST_SPREAD = 0.05
_BLOCK_ROWS = 4_000_000
#: Files that a model is stored in, per block and at most: a worker maps them all.
_FILES, _MOST_FILES = 16, 256
_BEGIN_SENTENCE, _BEGIN, _END, _BEGIN_TEXT = "\x02", "\x03", "\x01", "\x04"
_HEAD = "\x05"
_MARKS = str.maketrans(dict.fromkeys(_BEGIN_SENTENCE + _BEGIN + _END + _BEGIN_TEXT, "\ufffd"))
_SENTENCE_ENDS = frozenset(".!?:")
_LONGEST = 64
_COUNTED_AT_ONCE = 300_000
#: Bytes of text that are scored at once.
_SCORED_AT_ONCE = 300_000


def marked_words(text: str) -> list[str]:
    """The words of a text, each after its begin mark."""
    found = []
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        found.append(_BEGIN_SENTENCE + words[0])
        found += [(_BEGIN_SENTENCE if before[-1] in _SENTENCE_ENDS else _BEGIN) + w for before, w in zip(words, words[1:])]
    if len(text) > _LONGEST and max(map(len, found), default=0) > _LONGEST:
        found = [x for w in found for x in ([w] if len(w) <= _LONGEST else [w[0] + w[i : i + _LONGEST] for i in range(1, len(w), _LONGEST)])]
    return found


def heads(words: list[str], order: int) -> list[str]:
    """Per marked word of a text: what stands before it, its mark, and the characters whose context reaches beyond the mark."""
    found, tail, most = [], _BEGIN_TEXT, order - 2
    for w in words:
        found.append(tail + (w[: most + 1] if len(w) > most else w + _END))
        tail = w[-most:] if len(w) >= most else (tail + w)[-most:]
    return found


def _mark(head: str) -> int:
    """Where the mark of the word of a head stands."""
    return max(head.rfind(_BEGIN), head.rfind(_BEGIN_SENTENCE))


def text_words(text: str) -> list[str]:
    """The marked words of a text that may hold the characters of the marks."""
    if _END in text or _BEGIN in text or _BEGIN_SENTENCE in text or _BEGIN_TEXT in text:
        text = text.translate(_MARKS)
    return marked_words(text)


def word_counts(trusted: DataFrame, order: int = ORDER, across: bool = False) -> DataFrame:
    """lang, word and n of all words of trusted text (lang, text), and the same over all languages under "".

    across: heads of words are counted besides, each after a sign of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in slices(batches, 1):
            with no_cycles():
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = text_words(text) if across else marked_words(text)
                    seen[lang].update(words)
                    if across:
                        seen[lang].update(_HEAD + h for h in heads(words, order))
            if sum(map(len, seen.values())) > _COUNTED_AT_ONCE:
                yield from _rows(seen)
                seen.clear()
        yield from _rows(seen)
        seen.clear()
        trim()

    def _rows(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    texts = trusted.selectExpr("coalesce(cast(lang as string), '') as lang", "coalesce(cast(text as string), '') as text")
    counted = settle(texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    return counted.where("lang <> ''").unionByName(counted.groupBy("word").agg(F.sum("n").alias("n")).withColumn("lang", F.lit("")))


def raw_grams(words: DataFrame, order: int, across: bool = False) -> DataFrame:
    """lang, gram and n: all n-grams of the highest order, and shorter ones at the beginning of a word.

    across: the shorter ones are at the beginning of a text; heads hold the n-grams that end near the
    beginning of a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with no_cycles():
                seen = count(batch)
                langs, grams = zip(*seen) if seen else ((), ())
                found = [pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(list(seen.values()), pa.int64())]
                del seen, langs, grams
            yield pa.RecordBatch.from_arrays(found, ["lang", "gram", "n"])
        trim()

    def count(batch: pa.RecordBatch) -> Counter:
        seen: Counter = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if across and word[0] == _HEAD:
                head = word[1:]
                for j in range(_mark(head) + 2, len(head) + 1):
                    seen[lang, head[max(0, j - order) : j]] += n
                continue
            whole = word + _END
            if not across:
                for k in range(2, min(order, len(whole) + 1)):
                    seen[lang, whole[:k]] += n
            for i in range(len(whole) - order + 1):
                seen[lang, whole[i : i + order]] += n
        return seen

    grams = words.select("lang", "word", "n").mapInArrow(run, "lang string, gram string, n long")
    return grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts from how many n-grams have an adjusted count of 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (counts.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.01), i - 0.01) for i, d in enumerate(found, 1))


def train(trusted: DataFrame, order: int = ORDER, block_rows: int = _BLOCK_ROWS, across: bool = False) -> str:
    """Train on trusted text (lang, text) and store the model; returns its folder. across: contexts go over word boundaries."""
    spark = trusted.sparkSession
    folder = scratch(spark, "kneser-ney")
    raw = settle(raw_grams(settle(word_counts(trusted, order, across), "all-words"), order, across), "grams")
    adjusted = {order: raw.where(F.length("gram") == order).withColumnRenamed("n", "a")}
    for k in range(order - 1, 0, -1):
        inner = adjusted[k + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("a"))
        begins = raw.where(F.length("gram") == k).withColumnRenamed("n", "a")
        adjusted[k] = settle(inner.unionByName(begins) if k > 1 else inner, f"adjusted-{k}")
    both = None
    for k in range(1, order + 1):
        both_k = adjusted[k].groupBy("lang", F.least("a", F.lit(5)).alias("a")).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(k))
        both = both_k if both is None else both.unionByName(both_k)
    tallies: dict[tuple[str, int], dict[int, int]] = defaultdict(dict)
    for r in both.collect():  # at most five rows per language and order
        tallies[r["lang"], r["k"]][r["a"]] = r["n"]
    cut = spark.createDataFrame(
        [(lang, k, *_discounts(t)) for (lang, k), t in tallies.items()] or [("", 1, 0.5, 1.0, 1.5)], "lang string, k int, d1 double, d2 double, d3 double"
    )
    size = F.broadcast(adjusted[1].groupBy("lang").agg((F.count(F.lit(1)) + 1).alias("size")))
    lower, model = None, None
    for k in range(1, order + 1):
        grams = adjusted[k].join(F.broadcast(cut.where(f"k = {k}").drop("k")), "lang")
        grams = grams.withColumn("d", F.expr("CASE a WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END")).withColumn("ctx", F.expr(f"substring(gram, 1, {k - 1})"))
        contexts = settle(grams.groupBy("lang", "ctx").agg(F.sum("a").alias("total"), (F.sum("d") / F.sum("a")).alias("weight")), f"contexts-{k}")
        own = grams.join(contexts, ["lang", "ctx"])
        if k == 1:
            own = own.join(size, "lang").withColumn("below", 1 / F.col("size"))
        else:
            own = own.withColumn("suffix", F.expr("substring(gram, 2)")).join(lower, ["lang", "suffix"])
        found = settle(own.select("lang", "gram", ((F.col("a") - F.col("d")) / F.col("total") + F.col("weight") * F.col("below")).alias("p")), f"p-{k}")
        lower = found.withColumnsRenamed({"gram": "suffix", "p": "below"})
        rows = found.select("lang", "gram", F.lit(False).alias("weight"), F.log("p").cast("float").alias("value")).unionByName(
            contexts.select("lang", F.col("ctx").alias("gram"), F.lit(True).alias("weight"), F.log("weight").cast("float").alias("value"))
        )
        model = rows if model is None else model.unionByName(rows)
    unknown = adjusted[1].groupBy("lang").agg(F.log(1 / (F.count(F.lit(1)) + 1)).cast("float").alias("value")).select("lang", F.lit(None).cast("string").alias("gram"), F.lit(False).alias("weight"), "value")
    model = settle(model.unionByName(unknown), "model")
    blocks = max(1, -(-model.count() // block_rows))
    stored = _blocked(model, blocks).select("lang", "gram", "weight", "value", "block")
    hashed = stored.mapInArrow(_hashed, "lang string, weight boolean, k int, hash long, value float, block int")
    table = ["block", "lang", "weight", "k"]
    dealt = hashed.repartition(min(_MOST_FILES, _FILES * blocks), *table).sortWithinPartitions(*table, "hash")
    made = dealt.mapInArrow(_tables_into(f"{folder}-tables"), "block int, lang string, weight boolean, k int, path string, start long, n long")
    made.write.partitionBy("block").parquet(folder)
    return folder


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the model with the length and the hash of the n-gram in place of the n-gram; the unknown one has length -1."""
    for batch in batches:
        lang, gram, weight, value, block = batch.columns
        k = pa.compute.utf8_length(gram).fill_null(-1).to_numpy().astype(np.int32)
        found = np.zeros(len(k), np.int64)
        for size in np.unique(k[k >= 0]).tolist():
            at = np.flatnonzero(k == size)
            points = _points("".join(gram.take(pa.array(at)).to_pylist()))
            found[at] = _hashes(points, np.arange(len(at)) * size, size).view(np.int64)
        yield pa.RecordBatch.from_arrays([lang, weight, pa.array(k), pa.array(found), value, block], ["lang", "weight", "k", "hash", "value", "block"])


def _tables_into(folder: str):
    """Write the tables of sorted rows of the model into a file per task; a row per table says where it stands.

    A table is the rows of a block, a language, a kind and a length: n hashes (int64, ascending), n values (float32), and
    zeros up to a multiple of 8 bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = shared_files(folder)
        out, found, values, path = None, [], [], f"{base}/{uuid.uuid4().hex}"

        def close() -> None:
            out.write(b"".join(values) + bytes(4 * (found[-1][-1] % 2)))
            values.clear()

        try:
            for batch in batches:
                lang, weight, k, hashes, value, block = batch.columns
                if out is None:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(path)
                codes = [lang.dictionary_encode().indices.to_numpy(), *(c.to_numpy(zero_copy_only=False) for c in (weight, k, block))]
                changes = np.flatnonzero(np.any([x[1:] != x[:-1] for x in codes], axis=0)) + 1
                hashes, value = hashes.to_numpy().astype("<i8"), value.to_numpy().astype("<f4")
                for start, end in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows]):
                    name = [c[start].as_py() for c in (block, lang, weight, k)]
                    if not found or found[-1][:4] != name:
                        if found:
                            close()
                        found.append([*name, path, out.tell(), 0])
                    out.write(hashes[start:end].tobytes())
                    values.append(value[start:end].tobytes())
                    found[-1][-1] += end - start
            if found:
                close()
        finally:
            if out is not None:
                out.close()
        types = [pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        columns = zip(*found) if found else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["block", "lang", "weight", "k", "path", "start", "n"])

    return run


def _points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def _blocked(model: DataFrame, blocks: int) -> DataFrame:
    """A block per row by the two characters before the predicted one; rows with fewer go to all blocks."""
    before = F.when(F.col("weight"), F.expr("right(gram, 2)")).otherwise(F.expr("left(right(gram, 3), 2)"))
    short = F.col("gram").isNull() | (F.length("gram") < F.when(F.col("weight"), 2).otherwise(3))
    mine = F.array(F.pmod(F.ascii(before) * 31 + F.ascii(F.substring(before, 2, 1)), F.lit(blocks)).cast("int"))
    return model.withColumn("block", F.explode(F.when(short, F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(mine)))


def _hashes(points: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """A hash of the `k` code points from each start on."""
    total = np.full(len(starts), k + 1, np.uint64)
    for i in range(k):
        total = (total ^ points[starts + i]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


class Table:
    """Sorted hashes of n-grams of each length with a value."""

    def __init__(self):
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def get(self, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash of length k is known, and its value (0 if not)."""
        have, values = self.parts.get(k, (np.empty(0, np.int64), np.empty(0, np.float32)))
        if not len(have):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        keys = keys.view(np.int64)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        known = have[at] == keys
        return known, np.where(known, values[at], 0.0).astype(np.float64)


def _mapped(files: pafs.FileSystem, path: str) -> mmap.mmap:
    """A stored file as memory that the system reads as it is looked at; one of a remote store is copied beside the task first.

    The copy has no name and goes with the worker.
    """
    if isinstance(files, pafs.LocalFileSystem):
        with open(path, "rb") as local:
            return mmap.mmap(local.fileno(), 0, access=mmap.ACCESS_READ)
    with tempfile.TemporaryFile() as copy, files.open_input_stream(path) as source:
        shutil.copyfileobj(source, copy, 1 << 20)
        copy.flush()
        return mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ)


class Block:
    """One block of the model: probabilities, back-off weights and the value of an unknown character per language.

    opened: files that are mapped already, by path.
    """

    def __init__(self, folder: str, number: int, opened: dict[str, mmap.mmap]):
        files, base = shared_files(folder)
        rows = pads.dataset(f"{base}/block={number}", format="parquet", filesystem=files).to_table(columns=["lang", "weight", "k", "path", "start", "n"])
        tables: dict[str, tuple[Table, Table]] = defaultdict(lambda: (Table(), Table()))
        for lang, weight, k, path, start, n in zip(*(c.to_pylist() for c in rows.columns)):
            if path not in opened:
                opened[path] = _mapped(files, path)
            parts = tables[lang][weight].parts
            if k in parts:
                raise ValueError(f"block {number} has two tables of length {k}")
            parts[k] = np.frombuffer(opened[path], "<i8", n, start), np.frombuffer(opened[path], "<f4", n, start + 8 * n)
        self.languages = {lang: (probabilities, weights, float(probabilities.parts[-1][1][0])) for lang, (probabilities, weights) in tables.items()}


def _block_numbers(folder: str) -> tuple[int, ...]:
    files, base = shared_files(folder)
    names = [x.base_name for x in files.get_file_info(pafs.FileSelector(base)) if x.base_name.startswith("block=")]
    return tuple(sorted(int(x[6:]) for x in names))


class Blocks:
    """The blocks of a stored model, each opened when it is first looked at."""

    def __init__(self, folder: str):
        self.folder, self.numbers = folder, _block_numbers(folder)
        self.files: dict[str, mmap.mmap] = {}
        self.opened: dict[int, Block] = {}

    def get(self, number: int) -> Block:
        if number not in self.opened:
            self.opened[number] = Block(self.folder, number, self.files)
        return self.opened[number]


def word_scores(words: list[str], lang: str, blocks: Blocks, order: int) -> np.ndarray:
    """The log probability of each marked word, from contexts in it alone."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    points = _points("".join(w + _END for w in words))
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(points)) - np.repeat(starts, sizes)
    at = np.flatnonzero(place > 0)
    total = np.zeros(len(points))
    total[at] = _at_places(points, at, place[at], np.zeros(len(at), np.int64), [lang], blocks, order)
    return np.add.reduceat(total, starts) if len(starts) else np.empty(0)


def _at_places(points: np.ndarray, at: np.ndarray, place: np.ndarray, lang: np.ndarray, langs: list[str], blocks: Blocks, order: int) -> np.ndarray:
    """The log probability of the character at each of `at`; `place` characters before it count. lang: numbers in `langs`."""
    numbers = blocks.numbers
    two = points[at - 1] + np.where(place > 1, points[np.maximum(at - 2, 0)] * np.uint64(31), 0).astype(np.uint64)
    which = np.where(place > 1, two % np.uint64(max(1, len(numbers))), 0)
    total = np.zeros(len(at))
    for number in numbers:
        here = which == number
        known = blocks.get(number).languages if here.any() else None
        if not known:
            continue
        for i in np.unique(lang[here]).tolist():
            mine = np.flatnonzero(here & (lang == i))
            probabilities, weights, unknown = known.get(langs[i]) or known[""]
            total[mine] = _log_probabilities(points, at[mine], place[mine], probabilities, weights, unknown, order)
    return total


def _log_probabilities(points, at, place, probabilities: Table, weights: Table, unknown: float, order: int) -> np.ndarray:
    """The interpolated log probability of the character at each place, longest known n-gram first."""
    total, open_ = np.zeros(len(at)), np.arange(len(at))
    for k in range(order, 0, -1):
        long = place[open_] >= k - 1
        now, waiting = open_[long], open_[~long]
        known, value = probabilities.get(_hashes(points, at[now] - (k - 1), k), k)
        total[now[known]] += value[known]
        missed = now[~known]
        total[missed] += weights.get(_hashes(points, at[missed] - (k - 1), k - 1), k - 1)[1]
        open_ = np.concatenate([missed, waiting])
    total[open_] += unknown
    return total


def _mixed(total: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes with one more code point each, as `_hashes` makes them."""
    total = (total ^ points) * np.uint64(0x9E3779B97F4A7C15)
    return total ^ (total >> np.uint64(29))


class _Recent:
    """Log probabilities by the hash of their n-gram: a slot each of a table of fixed size, where the latest stays."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits)
        self.keys[0] = 1  # belongs to another slot, so that nothing is known yet

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, look) -> np.ndarray:
        """The value of each key; look(places) gives those of places in `keys` that aren't known, a place for each such key."""
        slots = self._slots(keys)
        found = self.values[slots]
        missed = np.flatnonzero(self.keys[slots] != keys)
        if len(missed):
            fresh, first, again = np.unique(keys[missed], return_index=True, return_inverse=True)
            value = look(missed[first])
            found[missed] = value[again]
            slots = self._slots(fresh)
            # of keys that share a slot both columns keep the same one
            last = len(slots) - 1 - np.unique(slots[::-1], return_index=True)[1]
            self.keys[slots[last]], self.values[slots[last]] = fresh[last], value[last]
        return found


class Scorer:
    """Scores texts; keeps the log probabilities of up to 2 ** `bits` n-grams, 16 bytes each."""

    def __init__(self, folder: str, order: int, bits: int = 20):
        self.blocks, self.order, self.recent = Blocks(folder), order, _Recent(bits)
        self.langs: dict[str, int] = {}

    def score(self, langs: list[str | None], texts: list[str | None]) -> tuple[list[float | None], list[int]]:
        """The perplexity of each text, and how many characters were predicted."""
        with no_cycles():
            return self._score(langs, texts)

    def _score(self, langs: list[str | None], texts: list[str | None]) -> tuple[list[float | None], list[int]]:
        found: list[float | None] = [None] * len(texts)
        chars = [0] * len(texts)
        split = [text_words(t or "") for t in texts]
        filled = [i for i, words in enumerate(split) if words]
        if not filled:
            return found, chars
        counts = np.array([len(split[i]) for i in filled])
        own = np.array([self.langs.setdefault(langs[i] or "", len(self.langs)) for i in filled], np.int64)
        points = _points("".join(_BEGIN_TEXT + _END.join(split[i]) + _END for i in filled))
        del split
        total = self._characters(points, own)
        total, points = (x[points != ord(_BEGIN_TEXT)] for x in (total, points))
        # a word's head, the characters whose context reaches beyond its mark, is summed by itself
        firsts = np.append(0, np.flatnonzero(points == ord(_END))[:-1] + 1)
        size = np.diff(np.append(firsts, len(points)))
        head = np.zeros(len(firsts))
        for j in range(1, self.order - 1):
            has = np.flatnonzero(size > j)
            head[has] += total[firsts[has] + j]
            total[firsts[has] + j] = 0.0
        scores = np.add.reduceat(total, firsts) + head
        begins = np.cumsum(counts) - counts
        sums, length = np.add.reduceat(scores, begins), np.add.reduceat(size - 1, begins)  # a mark isn't predicted, an end is
        for i, p, n in zip(filled, np.exp(-sums / length).tolist(), length.tolist()):
            found[i], chars[i] = p, n
        return found, chars

    def _characters(self, points: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """The log probability of each code point of texts, 0 for marks. Ends of words are no context; lang: a number per text."""
        order, n = self.order, self.order - 1
        end, begin = points == ord(_END), points == ord(_BEGIN_TEXT)
        running = np.append(np.zeros(n, np.uint64), points[~end])
        after = np.cumsum(~end) + n - 1 + end  # where the context of each point ends
        text = np.cumsum(begin) - 1
        place = np.minimum(after - after[begin][text], n)
        at = np.flatnonzero((points < ord(_BEGIN_SENTENCE)) | (points > ord(_BEGIN_TEXT)))
        after, place, text, last = after[at], place[at], text[at], points[at]
        contexts = np.full(len(running) - n + 1, order + 1, np.uint64)
        for i in range(n):
            contexts = _mixed(contexts, running[i : len(running) - n + 1 + i])
        keys = _mixed(contexts[after - n], last)

        def windows(places: np.ndarray) -> np.ndarray:
            """The characters before each place and its own; nothing from before the text."""
            got = np.column_stack([*(running[after[places] - n + i] for i in range(n)), last[places]])
            got[np.arange(order) < n - place[places, None]] = 0
            return got

        short = np.flatnonzero(place < n)
        keys[short] = _hashes(windows(short).ravel(), np.arange(len(short)) * order, order)
        keys ^= lang[text].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)

        def look(places: np.ndarray) -> np.ndarray:
            ends = np.arange(1, len(places) + 1) * order - 1
            return _at_places(windows(places).ravel(), ends, place[places], lang[text[places]], list(self.langs), self.blocks, order)

        found = np.zeros(len(points))
        found[at] = self.recent.get(keys, look)
        return found


def perplexities(docs: DataFrame, folder: str, lang: int, text: int, order: int = ORDER) -> DataFrame:
    """All columns of `docs`, `perplexity` and `chars`. lang and text: where those columns stand."""
    schema = by_position(docs).schema.add("perplexity", "double").add("chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = held(("scorer", folder, order), lambda: Scorer(folder, order)).score
        for batch in slices(batches, text, _SCORED_AT_ONCE):
            found, chars = score(*(batch.column(i).cast(pa.string()).to_pylist() for i in (lang, text)))
            own = [pa.array(found, pa.float64()), pa.array(chars, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "perplexity", "chars"])
        trim()

    return by_position(docs).mapInArrow(run, schema)


def _quartiles(scored: DataFrame) -> DataFrame:
    """Per language `its` of scored rows (its, perplexity, chars): n distinct texts, their quartiles and median length.

    Copies have the same perplexity and length, and count once.
    """
    texts = scored.where("perplexity is not null").select("its", F.round(F.log("perplexity"), 9).alias("log"), "chars").distinct()
    return texts.groupBy("its").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("log", [0.25, 0.75], 10_000).alias("q"), F.percentile_approx("chars", 0.5, 10_000).alias("median")
    )


def _limits(apart: DataFrame) -> DataFrame:
    """Stored limits of the languages with enough scored trusted texts: its, upper, spread, median."""
    return settle(_limit_columns(_quartiles(apart).where(F.col("n") >= LEAST_APART)), "limits")


def _limit_columns(quartiles: DataFrame) -> DataFrame:
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_SPREAD))
    return quartiles.select("its", F.col("q")[1].alias("upper"), spread.alias("spread"), "median")


def _its(lang: str) -> Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit(""))


def _with_limit(scored: DataFrame, lang: str, fence: float, limits: DataFrame) -> DataFrame:
    """The scored rows with `most`, the greatest perplexity that is kept, and `kept`."""
    # a row per language
    joined = scored.withColumn("its", _its(lang)).join(F.broadcast(limits), "its", "left")
    wider = F.greatest(F.lit(1.0), F.sqrt(F.col("median") / F.greatest("chars", F.lit(1))))
    # rounded as the quartiles are, so that a text of just the limit is kept
    found = joined.withColumn("limit", F.col("upper") + fence * F.col("spread") * wider)
    return found.withColumn("most", F.exp("limit")).withColumn("kept", F.expr("coalesce(round(ln(perplexity), 9) <= limit, true)"))


def _set_apart(trusted: DataFrame) -> DataFrame:
    """Trusted texts (lang, text) with `apart`: whether a text sets limits instead of training the model.

    A quarter of the texts, by digest, in languages where that leaves enough.
    """
    texts = settle(trusted.selectExpr("coalesce(cast(lang as string), '') as lang", "cast(text as string) as text"), "trusted-texts")
    one_in_four = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    counted = texts.where(one_in_four).groupBy("lang").agg(F.countDistinct(F.xxhash64("text")).alias("n")).where(F.col("n") >= LEAST_APART)
    able = settle(counted.select("lang", F.lit(True).alias("able")), "able")
    # a row per language
    return texts.join(F.broadcast(able), "lang", "left").select("lang", "text", (F.coalesce("able", F.lit(False)) & one_in_four).alias("apart"))


def _trained(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[str, DataFrame]:
    """The folder of the model, and the limits that trusted texts set."""
    texts = narrow(docs, id=id_col, lang=lang_col, text=text_col)
    kind = texts.schema["id"].dataType
    ids = settle(trusted.toDF("id").select(F.col("id").cast(kind)).where("id is not null").distinct(), "trusted")
    # most texts that are not trusted stay where they are; only the others meet the ids in a shuffle
    likely = bloom.probe(texts, "id", bloom.build(ids, "id"), "likely").where("likely").drop("likely")
    known = _set_apart(likely.join(ids.hint("merge"), "id", "left_semi"))
    folder = train(known.where("not apart").select("lang", "text"), across=True)
    apart = perplexities(known.where("apart").select("lang", "text"), folder, 0, 1).select(F.col("c0").alias("its"), "perplexity", "chars")
    return folder, _limits(settle(apart, "apart"))


def judge(
    docs: DataFrame, trusted: DataFrame, fence: float = FENCE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per row of `docs`: doc_id, perplexity, most (the limit) and kept. trusted: one column of ids."""
    folder, limits = _trained(docs, trusted, id_col, text_col, lang_col)
    scored = perplexities(narrow(docs, id=id_col, lang=lang_col, text=text_col), folder, 1, 2)
    rows = settle(scored.select(F.col("c0").alias("doc_id"), F.col("c1").alias("lang"), "perplexity", "chars"), "perplexities")
    of_all = _quartiles(rows.select(_its("lang").alias("its"), "perplexity", "chars").join(F.broadcast(limits.select("its")), "its", "left_anti"))
    both = settle(limits.unionByName(_limit_columns(of_all)), "limits")
    return _with_limit(rows, "lang", fence, both).select("doc_id", "perplexity", "most", "kept")


def drop(
    docs: DataFrame, trusted: DataFrame, fence: float = FENCE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns.

    Limits are known before the documents are scored, so each is scored where it is kept or dropped. Only those of
    languages without enough trusted texts are scored once more before, for their quartiles.
    """
    folder, limits = _trained(docs, trusted, id_col, text_col, lang_col)
    others = narrow(docs, lang=lang_col, text=text_col).withColumn("its", _its("lang")).join(F.broadcast(limits.select("its")), "its", "left_anti")
    of_all = _quartiles(perplexities(others.select("its", "text"), folder, 0, 1).select(F.col("c0").alias("its"), "perplexity", "chars"))
    both = settle(limits.unionByName(_limit_columns(of_all)), "limits")
    lang, text = position(docs, lang_col), position(docs, text_col)
    kept = _with_limit(perplexities(docs, folder, lang, text), f"c{lang}", fence, both).where("kept")
    return kept.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
