"""Source divergence audit: how the word use of each source of a language differs from the others'.

Terms are counted per task by `term_counts` and the partial counts are added up by Spark. A language keeps the terms
that at least `least` of its documents hold. A group is a (language, source); its probability of a kept term, in
parts of 10**9, is p = 1 + floor(10**9 (count + 1) / (N + V)), with N the group's occurrences of the V kept terms. The
divergence of a term is floor((p - q)**2 / q). All of this is done in whole numbers.

Pairs of sources are not compared term by term. Most terms are absent from most sources, so the sum over all kept
terms is taken as if none were shared (from the number of terms per count, and V), plus a correction for each term
that both sources hold: numpy expands these per term, in pieces of bounded size, and adds them up before they are
shuffled. Terms are spread by their hash, so no language or source is one task's work.

Defined cases: a null text, language or source is ''; a document without terms still makes its group; a language without
kept terms has value 0 for all pairs and no terms; a source alone in its language has no pairs; repeated rows are
documents of their own; very long texts and terms are counted whole; an empty table gives an empty result; other
columns of any name are ignored; counts up to 9 * 10**13 per language are exact, and larger ones are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from . import term_counts
from .common import narrow, settle, slices, text_or_empty, texts_of

#: Bytes of text that a task counts at a time.
SLICE = 8_000_000
#: Pairs of sources that a task expands at a time.
PAIRS = 1_000_000

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 2, SLICE):
        part = part.sort_by([("lang", "ascending"), ("source", "ascending")])
        langs, sources = part.column(0).to_pylist(), part.column(1).to_pylist()
        names = list(dict.fromkeys(zip(langs, sources, strict=True)))
        number = {x: i for i, x in enumerate(names)}
        groups = np.array([number[x] for x in zip(langs, sources, strict=True)])
        group, term, n, docs = term_counts.count(texts_of(part.column(2)), groups)
        lang, source = (pa.array([x[i] for x in names], pa.string()).take(pa.array(group)) for i in (0, 1))
        whole = pa.record_batch([lang, source, term.cast(pa.string()), pa.array(n), pa.array(docs)], schema=_COUNTED)
        for at in range(0, whole.num_rows, 50_000):
            yield whole.slice(at, 50_000)


def term_frequencies(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term); one row for each that occurs.

    The rows of a language's term are in one partition.
    """
    plain = narrow(docs, lang=lang_col, source=source_col, text=text_col)
    filled = plain.select(*[text_or_empty(c).alias(c) for c in ("lang", "source", "text")])
    partial = filled.mapInArrow(_count_batches, from_arrow_schema(_COUNTED))
    return partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(n: str, size: str) -> str:
    """1 + floor(10**9 (n + 1) / size), with no number over 64 bits on the way: 10**9 is 10**5 times 10**4."""
    high = f"(({n}) + 1L) * 100000L"
    return f"(1L + ({high} div {size}) * 10000L + (({high} % {size}) * 10000L) div {size})"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


_PART = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])


def _p_numpy(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    high = (n + 1) * 100_000
    return 1 + high // size * 10_000 + high % size * 10_000 // size


def _f_numpy(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def summed(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of `value` for each pair (a, b)."""
    order = np.lexsort((b, a))
    a, b, value = a[order], b[order], value[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(fresh)
    return (a[at], b[at], np.add.reduceat(value, at)) if len(at) else (a, b, value)


def corrections(first: np.ndarray, last: np.ndarray, group: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[tuple]:
    """Sums per pair of groups over the terms that both hold; row i's term has the rows first[i] to last[i] - 1."""
    reach = np.cumsum(last - first)
    at = 0
    while at < len(group):
        done = reach[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(reach, done + PAIRS, "right")))
        rows = np.arange(at, stop)
        times = last[rows] - first[rows]
        left = np.repeat(rows, times)
        right = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[rows], times)
        left, right = left[left != right], right[left != right]
        value = _f_numpy(p[left], p[right]) - _f_numpy(p[left], p0[right]) - _f_numpy(p0[left], p[right]) + _f_numpy(p0[left], p0[right])
        yield summed(group[left], group[right], value)
        at = stop


def _whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold all rows of each of their terms, and whether a row's term differs from the one before."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        fresh = _fresh(rest)
        keep = int(np.flatnonzero(fresh)[-1]) if len(fresh) else 0
        if keep:
            yield rest.slice(0, keep), fresh[:keep]
            rest = rest.slice(keep)
    if rest is not None and rest.num_rows:
        yield rest, _fresh(rest)


def _fresh(table: pa.Table) -> np.ndarray:
    out = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        out[1:] = False
        for name in ("lang", "term"):
            column = table[name]
            out[1:] |= pa.compute.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy()
    return out


def _correct_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of a partition whose rows (lang, term, gid, n, size) come sorted by language and term."""
    found: list[tuple] = []

    def added_up() -> pa.RecordBatch:
        columns = summed(*[np.concatenate([x[i] for x in found]) for i in range(3)])
        found.clear()
        return pa.record_batch([pa.array(x) for x in columns], schema=_PART)

    for table, fresh in _whole_terms(batches):
        starts = np.append(np.flatnonzero(fresh), len(fresh))
        which = np.cumsum(fresh) - 1
        group, n, size = (table[c].to_numpy() for c in ("gid", "n", "size"))
        found.extend(corrections(starts[which], starts[which + 1], group, _p_numpy(n, size), _p_numpy(np.zeros_like(n), size)))
        if sum(len(x[0]) for x in found) > PAIRS:
            yield added_up()
    if found:
        yield added_up()


#: Parts that the rows of a language are dealt to where they meet its sources.
_SALTS = 32


def _totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row per group: gid, lang, source, terms (kept ones that it holds), v (of the language), size and lang_size (N + V)."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms"), F.sum(F.col("first").cast("long")).alias("v"))
    langs = sums.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("v").alias("v"))
    every = docs.select("lang", "source").distinct()
    joined = every.join(sums.drop("v"), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "terms", "lang_n", "v"])
    sized = joined.selectExpr("lang", "source", "terms", "v", "n + v as size", "lang_n + v as lang_size")
    return settle(sized.withColumn("gid", F.monotonically_increasing_id()), "groups")


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: every other source of the language, by divergence over all kept terms."""
    others = groups.selectExpr("lang", "gid as other", "size as other_size", "terms as other_terms").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    )

    def with_others(df: DataFrame, *spread: str) -> DataFrame:
        salted = df.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(_SALTS)).cast("int"))
        return salted.join(others, ["lang", "salt"]).where("gid <> other")

    neither = f"if(v = 0, 0L, (v - terms - other_terms) * {_f(_p('0L', 'size'), _p('0L', 'other_size'))})"
    unshared = with_others(groups, "gid").selectExpr("gid as a", "other as b", f"{neither} as value")
    counts = rows.groupBy("lang", "gid", "size", "n").agg(F.count(F.lit(1)).alias("terms"))
    here, there = _p("n", "size"), _p("0L", "other_size")
    one_sided = with_others(counts, "gid", "n").selectExpr(
        f"stack(2, gid, other, terms * {_f(here, there)}, other, gid, terms * {_f(there, here)}) as (a, b, value)"
    )
    sorted_terms = rows.select("lang", "term", "gid", "n", "size").repartition("lang", "term").sortWithinPartitions("lang", "term")
    shared = sorted_terms.mapInArrow(_correct_batches, from_arrow_schema(_PART))
    total = unshared.unionByName(one_sided).unionByName(shared).groupBy("a", "b").agg(F.sum("value").alias("value"))
    named = total.join(groups.selectExpr("gid as a", "lang", "source"), "a").join(groups.selectExpr("gid as b", "source as item"), "b")
    order = Window.partitionBy("a").orderBy(F.desc("value"), "item")
    return named.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))


def _terms(rows: DataFrame, most: int) -> DataFrame:
    """lang, source, item, value, rank: the kept terms that a source uses more than its language does."""
    chances = rows.selectExpr("gid", "lang", "source", "term as item", f"{_p('n', 'size')} as p", f"{_p('lang_n', 'lang_size')} as q")
    valued = chances.where("p > q").selectExpr("gid", "lang", "source", "item", f"{_f('p', 'q')} as value")
    order = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("gid")


def audit(docs: DataFrame, least: int = 3, most: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank; part 'pair' has all other sources, part 'term' the first `most` terms."""
    plain = narrow(docs, lang=lang_col, source=source_col, text=text_col)
    term = Window.partitionBy("lang", "term")
    counted = term_frequencies(plain).select(
        "lang", "term", "source", "n",
        F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("lang_n"), (F.min("source").over(term) == F.col("source")).alias("first"),
    )
    kept = settle(counted.where(F.col("docs") >= least).drop("docs"), "terms")
    groups = _totals(plain.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source")), kept)
    rows = settle(kept.drop("first").join(groups.select("gid", "lang", "source", "size", "lang_size"), ["lang", "source"]), "sized-terms")
    pairs = _pairs(rows, groups).withColumn("part", F.lit("pair"))
    terms = _terms(rows, most).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
