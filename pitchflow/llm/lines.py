"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only.

A line is the set of its words. The words of each line are ordered by rarity in the corpus; two
sets with Jaccard similarity t share one of their first n - ceil(t n) + 1 words, so only these
prefixes are joined, under the length, positional and parity filters. The join asks whether there
is a partner and does not list pairs. What passes is verified on the words themselves, against
the earliest line of each of its rare words first, so a group of many similar lines makes as many
pairs as it has lines.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchflow.llm.tables import Scratch, free_name, fresh, materialize, order_of, row_id

MIN_SIMILARITY = Fraction(4, 5)
#: Words are counted in so many buckets by hash, whatever the size of the corpus; rarity is the bucket's count.
N_BUCKETS = 1 << 16
_HASH_BITS = 48
_HASH_MASK = (1 << _HASH_BITS) - 1
#: A line's place in the order of the corpus; rows of one key share places, and null keys come last.
PLACE = "struct({0}doc, {0}uid >= 0 as none, {0}line)"


def _spaced(text: Column) -> Column:
    """The text with each space character but the line feed as a plain space."""
    for c in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _words(line: Column) -> Column:
    """Words of a spaced line, with empty strings between them where several spaces meet."""
    return F.split(line, " ")


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(N_BUCKETS - 1)).cast("int")


def rarity(df: DataFrame, text: str) -> list[int]:
    """For each bucket of words the logarithm of its count, as a small whole number; always ``N_BUCKETS`` of them."""
    words = df.select(F.explode(_words(F.replace(_spaced(F.col(text)), F.lit("\n"), F.lit(" ")))).alias("word")).where("word <> ''")
    counts = words.groupBy(_bucket(F.xxhash64("word")).alias("id")).agg(F.floor(F.log2(F.count(F.lit(1)) + 1) * 4).cast("int").alias("code"))
    found = dict(counts.collect())
    return [found.get(i, 0) for i in range(N_BUCKETS)]


def code_table(codes: list[int]) -> Column:
    """The codes as one constant array."""
    return F.split(F.lit(",".join(map(str, codes))), ",").cast("array<bigint>")


def word_hashes(line: Column) -> Column:
    """64-bit hashes of the distinct words of a spaced line, in order."""
    hashes = F.array_distinct(F.transform(_words(line), lambda word: F.xxhash64(word)))
    return F.sort_array(F.array_remove(hashes, F.xxhash64(F.lit(""))))


def by_rarity(hashes: Column, codes: Column) -> Column:
    """Words as numbers in order of rarity: the bucket's code, then 48 bits of the hash."""

    def number(h: Column) -> Column:
        return F.call_function("shiftleft", codes[_bucket(h)], F.lit(_HASH_BITS)).bitwiseOR(h.bitwiseAND(F.lit(_HASH_MASK)))

    return F.sort_array(F.transform(hashes, number))


def _negative(hashes: Column) -> Column:
    """How many of the ordered hashes are negative: the place of a zero among them."""
    return F.array_position(F.sort_array(F.array_append(hashes, F.lit(0).cast("long"))), F.lit(0).cast("long")).cast("int") - 1


def _parity(hashes: Column) -> Column:
    """64 bits, each flipped by every word that falls on it: sets differ in at least as many words as bits."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))))


def _prefix(tokens: Column, n: Column, t: Fraction) -> Column:
    return F.slice(tokens, 1, (n - F.ceil(n * t.numerator / F.lit(t.denominator)) + 1).cast("int"))


def _similar(t: Fraction) -> tuple[int, int]:
    """p, q such that sets of n and m words with k in common are similar if p * k >= q * (n + m)."""
    return t.numerator + t.denominator, t.numerator


def _sketches(base: DataFrame, codes: Column, t: Fraction) -> DataFrame:
    """A row for every line with a word: place, number of words, two hashes of the set, parities, prefix, a number of its own.

    The words with negative hashes and the others are two halves, each with its own parity, so that each word is visited once.
    """
    lines = base.select("uid", "doc", F.posexplode(F.split(_spaced(F.col("text")), "\n", -1)).alias("line", "words")).where("trim(words) <> ''")
    h, n, k = F.col("hashes"), F.size("hashes"), F.col("k")
    sets = lines.select("uid", "doc", "line", word_hashes(F.col("words")).alias("hashes")).select("*", _negative(h).alias("k"))
    parities = [_parity(F.slice(h, 1, k)).alias("half"), _parity(F.slice(h, k + 1, n)).alias("whole")]
    return sets.select("uid", "doc", "line", n.alias("n"), F.xxhash64(h).alias("h1"), F.xxhash64(F.lit(1), h).alias("h2"), *parities, _prefix(by_rarity(h, codes), n, t).alias("prefix"), F.monotonically_increasing_id().alias("number"))


def duplicate_lines(df: DataFrame, key: str, text: str, similarity: Fraction = MIN_SIMILARITY) -> DataFrame:
    """``uid`` (``row_id``), ``line``: the lines (from 0) whose word set is similar to that of an earlier line.

    Earlier is a smaller key, or the same key and a smaller line. See ``line_dedup``. A written table.
    """
    t, (p, q) = similarity, _similar(similarity)
    base, scratch = _base(df, key, text), Scratch(df.sparkSession)
    lines = scratch.write(_sketches(base, code_table(rarity(base, "text")), t), "lines")

    # equal sets: all but the first place are later matches; other rows' lines at that place go if the set goes
    firsts = lines.groupBy("h1", "h2").agg(F.min(F.struct(F.expr(PLACE.format("")).alias("place"), "uid", "number")).alias("first"))
    met = lines.join(firsts, ["h1", "h2"]).withColumn("is_first", F.expr("number = first.number")).withColumn("later", F.expr(f"{PLACE.format('')} > first.place"))
    met = met.where("is_first or later or uid <> first.uid").select("uid", "doc", "line", "n", "whole", "half", "is_first", F.expr("if(is_first or later, null, first.uid)").alias("tied"), F.expr("if(is_first, prefix, null)").alias("prefix"))
    placed = scratch.write(met, "placed-lines")
    scratch.drop("lines")

    # different sets (both sides of the join have the same columns, so one exchange): the smaller of two similar ones has at least t / (1 - t) words
    least = -(-t.numerator // (t.denominator - t.numerator))
    rows = placed.where(F.col("is_first") & (F.col("n") >= least)).select("uid", "doc", "line", "n", "whole", "half", F.posexplode("prefix").alias("at", "token"))
    near = f"""a.token = b.token and (a.uid <> b.uid or a.line <> b.line or a.doc <> b.doc) and {t.denominator} * least(a.n, b.n) >= {t.numerator} * greatest(a.n, b.n)
        and {p} * (least(a.at, b.at) + least(a.n - a.at, b.n - b.at)) >= {q} * (a.n + b.n)
        and {t.denominator + t.numerator} * (bit_count(a.whole ^ b.whole) + bit_count(a.half ^ b.half)) <= {t.denominator - t.numerator} * (a.n + b.n)"""
    close = scratch.write(rows.alias("a").join(rows.alias("b"), F.expr(near), "left_semi"), "close-lines")
    copies = scratch.write(placed.where("not is_first").select("uid", "line", "tied"), "later-lines")
    scratch.drop("placed-lines")

    # the words of what is left, from the texts; rows that repeat key and text have the same, of which one is enough
    wanted = close.groupBy("uid").agg(F.collect_set("line").alias("wanted"))
    split = base.select("uid", "text").join(wanted.hint("merge"), "uid").select("uid", "wanted", F.split(_spaced(F.col("text")), "\n", -1).alias("all"))
    whole = split.select("uid", F.explode(F.transform("wanted", lambda i: F.struct(i.alias("line"), F.array_distinct(F.array_remove(_words(F.get("all", i)), "")).alias("words")))).alias("x"))
    whole = scratch.write(whole.select("uid", "x.line", "x.words").dropDuplicates(["uid", "line"]), "close-words")

    def similar(pairs: DataFrame) -> DataFrame:
        """The lines of pairs (uid, line, other) whose sets are similar to those of their others."""
        sides = pairs.join(whole, ["uid", "line"]).join(whole.select(F.struct("uid", "line").alias("other"), F.col("words").alias("others")), "other")
        return sides.where(f"{p} * size(array_intersect(words, others)) >= {q} * (size(words) + size(others))").select("uid", "line").distinct()

    def pairs(later: DataFrame, earlier: DataFrame) -> DataFrame:
        """Pairs (uid, line, other) that pass the filters and share a token; the other is the earlier line."""
        met = later.alias("a").join(earlier.alias("b"), F.expr(f"{near} and {PLACE.format('a.')} > {PLACE.format('b.')}"))
        return met.select("a.uid", "a.line", F.struct("b.uid", "b.line").alias("other")).distinct()

    # A token's earliest line is tried first: as many pairs as tokens, and in a group of similar lines one
    # does for each. Only what these leave open is tried against every earlier line that passed with it.
    columns = ["uid", "doc", "line", "at", "n", "whole", "half"]
    earliest = close.groupBy("token").agg(F.min(F.struct(F.expr(PLACE.format("")).alias("place"), *columns)).alias("x")).select("token", *[f"x.{c}" for c in columns])
    found = scratch.write(similar(pairs(close, earliest)), "verified-lines")
    open_rows = close.join(found, ["uid", "line"], "left_anti")
    rest = scratch.write(similar(pairs(open_rows, close)), "verified-rest")
    scratch.drop("close-lines", "close-words")
    near_sets = found.unionByName(rest)
    tied = copies.where("tied is not null").join(near_sets.withColumnRenamed("uid", "tied"), ["tied", "line"]).select("uid", "line")
    gone = copies.where("tied is null").select("uid", "line").unionByName(near_sets).unionByName(tied)
    out = materialize(gone, "duplicate-lines")
    scratch.drop("later-lines", "verified-lines", "verified-rest")
    return out


def _base(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(row_id(key, text).alias("uid"), order_of(key).alias("doc"), F.col(text).alias("text"))


def line_dedup(df: DataFrame, key: str, text: str, similarity: Fraction = MIN_SIMILARITY) -> DataFrame:
    """``df`` with later matching lines taken out of ``text``, and with ``n_lines`` and ``n_removed``.

    Lines end at \\n. A line is removed if its set of words has at least ``similarity`` (Jaccard)
    with that of an earlier line of the corpus, removed or not; lines without words stay. Counts
    and candidates cover the whole corpus. Similar lines are verified on their words; lines count
    as equal where the 64-bit hashes of their words are the same set (held by two 64-bit hashes).

    A null text stays null, with no lines. A null key counts as larger than all others. Among rows
    of one key, or of null keys, the smaller line is the earlier one, and lines with one number do
    not count as each other's earlier line; each row loses its own lines only. An empty table gives
    no rows; columns of ``df`` named like the new ones are replaced. ``key`` must be a whole number.
    """
    found = materialize(duplicate_lines(df, key, text, similarity).groupBy("uid").agg(F.collect_set("line").alias("gone")), "gone-lines")
    rows = fresh(df, "n_lines", "n_removed")
    uid, gone = (free_name(rows, x) for x in ("uid", "gone"))
    keyed = rows.withColumn(uid, row_id(key, text))
    # what is removed grows with the corpus, so it is not broadcast at any size
    joined = keyed.join(found.select(F.col("uid").alias(uid), F.col("gone").alias(gone)).hint("merge"), uid, "left")
    n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)
    some = F.col(gone).isNotNull() & F.col(text).isNotNull()
    left = F.filter(F.split(F.col(text), "\n", -1), lambda line, i: ~F.array_contains(F.col(gone), i))
    removed = F.when(some, F.size(F.array_intersect(F.col(gone), F.sequence(F.lit(0), n - 1)))).otherwise(0)
    return joined.withColumns({"n_lines": n.cast("long"), "n_removed": removed.cast("long"), text: F.when(some, F.array_join(left, "\n")).otherwise(F.col(text))}).drop(uid, gone)
