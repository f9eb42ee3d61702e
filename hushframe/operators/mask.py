"""Masking words inside text columns.

Both ways replace, in each text, the listed words that it contains: longest first, then A to Z,
anywhere in the text and respecting case. They differ only in how many words they can take.
Column labels stay.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from hushframe.fixed_values import MASK
from hushframe.functions.values import name_sql, quoted, short_key_sql
from hushframe.operators import filters
from hushframe.session import fits_broadcast, settle

# Words are found in tokens by pieces of at most this many characters.
_GRAM = 4
# A token is searched in windows of so many characters.
_WINDOW = 256
# So many hits, of two numbers each, are broadcast.
_FEW_HITS = 500_000
# What of a phrase's neighbour goes along with a hit: four characters of it, or one of a shorter neighbour.
_BESIDE = (
    "case when char_length(after) > 3 then concat('a4', left(after, 4)) when after <> '' then concat('a1', left(after, 1))"
    " when char_length(before) > 3 then concat('b4', right(before, 4)) when before <> '' then concat('b1', right(before, 1)) else '' end"
)
# A token that stands in very many texts meets its words in so many parts of the join.
_SPREAD = 16


def _checked(df: DataFrame, columns: list[str]) -> None:
    """Masking an unknown column would leave its text as it is, so it is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {', '.join(missing)}")


def _kept(df: DataFrame, value: Column, name: str) -> Column:
    """The value under the column's name and with its metadata."""
    return value.alias(name, metadata=df.schema[name].metadata)


def _masked(text: Column, words: Column, mask: str) -> Column:
    return F.aggregate(words, text, lambda done, word: F.replace(done, word, F.lit(mask)))


def _apart(text: Column, found: Column, mask: str) -> Column:
    """Whether each line may be masked by the words that were found in it, which saves searching all lines for all words.

    A word with a character of the mask could match what others have left in another line. Lines are cut by
    characters, so a text that isn't valid UTF-8 is masked as a whole.
    """
    strange = F.exists(found, lambda x: F.translate(x["w"], mask, "") != x["w"])
    return F.call_function("is_valid_utf8", text) & ~strange


def _masked_by_line(text: Column, found: Column, mask: str) -> Column:
    """found: words `w` in their order with the line `l` they are in."""
    own = lambda i: F.transform(F.filter(found, lambda x: x["l"] == i), lambda x: x["w"])
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, i: _masked(line, own(i), mask)), "\n")


def mask_words(df: DataFrame, columns: list[str], words: list[str], mask: str = MASK) -> DataFrame:
    """Mask an edited word list (a few hundred words at most): one projection, no shuffle.

    Each text is searched for each word; use `mask_found_words` for thousands of words.
    """
    _checked(df, columns)
    ordered = sorted({w for w in words if w}, key=lambda w: (-len(w), w))
    if not ordered:
        return df
    listed = F.array(*[F.lit(w) for w in ordered])

    def hidden(name: str) -> Column:
        text = quoted(name)
        inside = F.filter(listed, lambda word: F.contains(text, word))
        return _kept(df, _masked(text, inside, mask), name)

    return df.select([hidden(c) if c in columns else quoted(c) for c in df.columns])


def mask_found_words(df: DataFrame, columns: list[str], words: DataFrame, mask: str = MASK) -> DataFrame:
    """Mask any number of words, given as a DataFrame with the column `word`.

    A word without spaces lies inside one token of the text. It is filed under the four characters that the fewest words
    have; the distinct tokens of the texts are cut into runs of four characters, and those that contain a listed word are the
    hits. A phrase is filed under a joint: up to four characters on either side of one of its spaces. The texts are then read
    once for hits and for joints. Bloom filters of the listed runs, and of the hits and joints, keep all other
    runs, tokens and neighbours from the shuffles. Each text replaces the words that it may contain; one
    that it doesn't contain changes nothing.
    Texts are known by their own digest, so no key of the rows is needed, and copies fold before
    words are collected.

    Nothing in clear is stored on the way, since the steps hold personal words. `words` is read several
    times; make it a stored table if it is costly to compute.
    """
    _checked(df, columns)
    if not columns:
        return df
    filed = _filed(words)
    alone, joined = F.col("after").isNull(), F.col("after").isNotNull()
    edges = F.struct(_edge_length("part").alias("a"), _edge_length("after").alias("b"))
    octets = " + ".join(f"coalesce(octet_length({c}), 0)" for c in ("word", "part", "before", "after"))
    sizes = filed.agg(
        F.collect_set(F.when(alone, F.char_length("gram"))).alias("lengths"),  # four at most
        F.count_distinct(F.when(alone, F.col("gram"))).alias("grams"),
        F.collect_set(F.when(joined, edges)).alias("edges"),  # 25 at most
        F.count(F.lit(1)).alias("words"),
        F.expr(f"coalesce(sum(cast({octets} as bigint)), 0)").alias("octets"),
        F.expr("coalesce(bool_or(contains(word, '\\n')), false)").alias("breaks"),
    ).first()
    if not sizes.words:
        return df
    cells = ", ".join(f"struct({short_key_sql(name_sql(c))} as key, {name_sql(c)} as text)" for c in columns)
    texts = df.selectExpr(f"inline(array({cells}))").where("text <> ''")
    # no word reaches over a line break, and no mask brings one
    by_line = not sizes.breaks and mask != "" and "\n" not in mask
    pieces = F.split("text", "\n") if by_line else F.array("text")
    met = _met(texts.select("key", F.posexplode(pieces).alias("line", "text")), filed, sizes)
    by_size = F.expr("array_sort(collect_set(struct(-char_length(word) as n, word as w, line as l)))")
    found = met.groupBy(F.col("key").alias("__key")).agg(by_size.alias("__words"))
    for name in columns:
        text = quoted(name)
        joined = df.join(found, F.expr(short_key_sql(name_sql(name))) == F.col("__key"), "left")
        words_ = F.col("__words")
        value = _masked(text, F.array_distinct(F.transform(words_, lambda x: x["w"])), mask)
        if by_line:
            value = F.when(_apart(text, words_, mask), _masked_by_line(text, words_, mask)).otherwise(value)
        value = F.when(words_.isNull(), text).otherwise(value)
        df = joined.select([_kept(df, value, c) if c == name else quoted(c) for c in df.columns])
    return df


def _grams(text: str) -> str:
    """The distinct pieces of _GRAM characters of a text, or the whole of a shorter one."""
    return (
        f"array_distinct(transform(sequence(1, greatest(1, char_length({text}) - {_GRAM - 1})),"
        f" i -> substring({text}, i, {_GRAM})))"
    )


def _edge_length(part: str) -> Column:
    return F.least(F.lit(_GRAM), F.char_length(part))


def _filed(words: DataFrame) -> DataFrame:
    """Distinct words with what they are filed under, `gram`, and the part that holds it.

    A word without spaces is its own part, filed under a piece of it. A phrase is filed under a joint, the last characters of
    a part, a space and the first ones of the next part, which is `after`. `before` is the part in front, or null at the beginning of the
    phrase. A space stands between parts, so a token must end with the part (and begin with it if there is one
    before), and its neighbour must begin with `after`. What is shorter stands in more texts, so it counts as more words.
    """
    parts = (
        words.select("word")
        .where("trim(word) <> ''")
        .distinct()
        .select("word", F.split("word", " ").alias("parts"))
        .select("word", "parts", F.posexplode("parts").alias("i", "part"))
        .select("word", "part", F.expr("get(parts, i - 1)").alias("before"), F.expr("get(parts, i + 1)").alias("after"))
        .where("after is not null or before is null")  # the last part of a phrase has no joint after it
        .select("*", F.explode(F.expr(f"if(after is null, {_grams('part')}, array(concat(right(part, {_GRAM}), ' ', left(after, {_GRAM}))))")).alias("gram"))
    )
    common = parts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    most = F.when(F.col("after").isNull(), _GRAM).otherwise(2 * _GRAM + 1)
    cost = F.col("n") * F.pow(F.lit(16), most - F.char_length("gram"))
    best = F.min_by(F.struct("part", "before", "after", "gram"), F.struct(cost, "gram", "part", F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))))
    return parts.join(common, "gram").groupBy("word").agg(best.alias("best")).select("word", "best.*")


def _hits(tokens: DataFrame, filed: DataFrame, lengths: list[int], grams: int = 65_536) -> DataFrame:
    """Rows (token, word, beside): the token contains the part under which the word is filed; `beside` is what must stand next to it.

    Tokens are cut by exploding numbers, which stays in generated code; a long token is first cut into windows, as taking
    a piece of a text takes time up to its place. A Bloom filter of the listed pieces keeps the others from the shuffle.
    """
    bits = filters.bits_for(grams)
    listed = filters.build(filed.select("gram"), "gram", bits)
    n = f"get(array({', '.join(map(str, lengths))}), i % {len(lengths)})"
    place = f"cast(i div {len(lengths)} + 1 as int)"
    cut = (
        tokens.selectExpr("token", f"explode(sequence(0, (char_length(token) - 1) div {_WINDOW})) as w")
        .selectExpr("token", f"substring(token, cast(w * {_WINDOW} + 1 as int), {_WINDOW + _GRAM - 1}) as seen")
        .selectExpr("token", "seen", f"explode(sequence(0, char_length(seen) * {len(lengths)} - 1)) as i")
        .where(f"{place} + {n} - 1 <= char_length(seen)")
        .selectExpr("token", f"substring(seen, {place}, {n}) as gram")
        .where(filters.may_hold(listed, F.col("gram"), bits))
    )
    return (
        cut.join(filed, "gram")
        .where(F.contains("token", F.col("part")))
        .where("(before is null or startswith(token, part)) and (after is null or endswith(token, part))")
        .select("token", "word", F.expr(_BESIDE).alias("beside"))
    )


def _edge(salt: Column, text: Column, end: str, size: Column) -> Column:
    """A hash of the last or first `size` characters of a token, as the `right` or `left` side of a joint."""
    return F.xxhash64(salt, F.lit(end), size, (F.right if end == "right" else F.left)(text, size))


def _met(texts: DataFrame, filed: DataFrame, sizes: Row) -> DataFrame:
    """Rows (key, line, word) of texts (key, line, text): the line has a token of the word's, between the neighbours that the word asks for.

    The hits among the distinct tokens, which only words without spaces need, are found once. They are settled together with the joints
    of the phrases as pairs of salted hashes, which hold no word in clear; what hashes alike by chance is turned away when the
    words themselves are looked at. A Bloom filter of them keeps all other tokens and neighbours from the join.
    A joint covers up to four characters of both sides, so a common token doesn't meet all phrases that it is part of.
    """
    salt = F.lit(secrets.randbits(62))
    word = F.xxhash64(salt, "word").alias("w")
    listed, at_token = [], []
    if sizes.lengths:
        tokens = texts.select(F.explode(F.split("text", " ")).alias("token")).where("token <> ''").distinct()
        hits = _hits(tokens, filed.where("after is null"), sorted(sizes.lengths), sizes.grams)
        listed.append(hits.select(F.xxhash64(salt, "token").alias("h"), word))
        at_token.append(F.xxhash64(salt, "token"))
    if sizes.edges:
        sides = [_edge(salt, F.col(part), end, _edge_length(part)) for part, end in (("part", "right"), ("after", "left"))]
        listed.append(filed.where("after is not null").select(F.xxhash64(*sides).alias("h"), word))
    hits = settle(reduce(DataFrame.unionAll, listed))
    count = hits.count()
    bits = filters.bits_for(count * (4 if sizes.edges else 1))  # each space is tried for up to 25 joints
    used = (
        texts.select("key", "line", F.split("text", " ").alias("tokens"))
        .selectExpr("key", "line", "tokens", "posexplode(tokens) as (at, token)")
        .selectExpr("key", "line", "get(tokens, at - 1) as previous", "token", "get(tokens, at + 1) as following")
    )
    for end, text, side in (("right", "token", "a"), ("left", "following", "b")):
        for size in sorted({e[side] for e in sizes.edges}):
            used = used.withColumn(f"{end}{size}", _edge(salt, F.col(text), end, F.lit(size)))
    joint = [F.xxhash64(f"right{e.a}", f"left{e.b}") for e in sorted(sizes.edges)]
    used = (
        used.select("key", "line", "previous", "token", "following", F.explode(F.array(*at_token, *joint)).alias("h"))
        .where(filters.may_hold(filters.build(hits, "h", bits), F.col("h"), bits))
        .withColumn("spread", F.pmod(F.xxhash64("key"), F.lit(_SPREAD)).cast("int"))
    )
    dealt = F.explode(F.sequence(F.lit(0), F.lit(_SPREAD - 1))).alias("spread")
    found = used.join(hits.select("h", "w", dealt), ["h", "spread"]) if count > _FEW_HITS else used.join(F.broadcast(hits), "h")
    known = filed.select("word", "part", "before", "after", word)
    found = found.join(F.broadcast(known), "w") if fits_broadcast(sizes.words, sizes.octets) else found.join(known.select("*", dealt), ["w", "spread"])
    return (
        found.where(F.contains("token", F.col("part")))
        .where("before is null or (startswith(token, part) and endswith(previous, before))")
        .where("after is null or (endswith(token, part) and startswith(following, after))")
        .select("key", "line", "word")
    )
