"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchflow.llm.tables import SPACES, WORD, free_name, fresh

SYMBOLS = "#*$%&|<>"
#: Common function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    dict.fromkeys(
        (
            "the of and to in a is was that for it with as his on be at by this are or from"
            " der die das und ist von zu den mit ein eine nicht auf im des dem sich"
            " le la les de et est un une en que du pour dans au ne ce se"
            " el los las y es una por con del su no lo al"
        ).split()
    )
)
N_WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A measure and the inclusive range in which a text is good; None leaves that side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The method's own rules, beside the base rules (``base_failed``).
RULES = (
    Rule("mean_word_chars", 3.0, 10.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_word_ratio", 0.05, None),
    Rule("dup_line_ratio", None, 0.5),
)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measured(df: DataFrame, text: str, stop_words: Sequence[str] = STOP_WORDS) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """``df`` with a struct of counts; the measures as expressions of it; the helper columns to drop."""
    t, words, lines, hashes, order, places, m = (free_name(df, f"q_{n}") for n in ("text", "words", "lines", "hashes", "order", "places", "m"))
    c = F.col
    # each column below is used several times, so Spark evaluates it once, in a projection of its own
    out = df.withColumn(t, F.coalesce(c(text), F.lit("")))
    out = out.withColumn(words, F.regexp_extract_all(c(t), F.lit(WORD), F.lit(0)))
    many = F.size(c(words))
    out = out.withColumn(lines, F.filter(F.split(c(t), "\n", -1), lambda x: F.length(_without(x, SPACES)) > 0))
    starts = F.when(many >= N_WINDOW, F.sequence(F.lit(1), many - (N_WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    window = lambda i: [F.element_at(c(words), i + k) for k in range(N_WINDOW)]
    out = out.withColumn(hashes, F.transform(starts, lambda i: F.xxhash64(*window(i))))
    # texts in which no hash repeats have no repeated window; the others are sorted by the windows themselves
    # (joined by spaces, which words don't hold), so that equal windows are neighbours
    sorted_windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("i"))))
    out = out.withColumn(order, F.when(F.size(F.array_distinct(c(hashes))) < F.size(c(hashes)), sorted_windows).otherwise(F.array().cast("array<struct<w:string,i:int>>")))
    near = lambda x, k: x["w"].eqNullSafe(F.get(c(order), k - 1)["w"]) | x["w"].eqNullSafe(F.get(c(order), k + 1)["w"])
    out = out.withColumn(places, F.array_sort(F.transform(F.filter(c(order), near), lambda x: x["i"])))
    # place p covers words p to p + 2; count what no earlier place covers
    covered = F.when(F.size(c(places)) == 0, F.lit(0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.size(c(places))), F.lit(0), lambda a, k: a + F.least(F.lit(N_WINDOW), F.coalesce(F.get(c(places), k) - F.get(c(places), k - 1), F.lit(N_WINDOW))))
    )
    n_stop = F.size(F.filter(c(words), lambda w: F.lower(w).isin(*stop_words)))
    counts = {
        "n_words": many,
        "word_chars": F.length(_without(c(t), SPACES)),
        "n_symbols": F.length(c(t)) - F.length(_without(c(t), SYMBOLS)),
        "n_lines": F.size(c(lines)),
        "n_dup_lines": F.size(c(lines)) - F.size(F.array_distinct(c(lines))),
        "n_repeat_words": covered,
        "n_stop_words": n_stop,
    }
    # an explode of one row: a later filter on the counts stays above it, and so does not work them out again
    out = out.select("*", F.explode(F.array(F.struct(*[v.cast("long").alias(k) for k, v in counts.items()]))).alias(m))
    got = {k: c(m)[k] for k in counts}
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    measures = got | {
        "mean_word_chars": ratio(got["word_chars"], got["n_words"]),
        "symbol_ratio": ratio(got["n_symbols"], got["word_chars"]),
        "stop_word_ratio": ratio(got["n_stop_words"], got["n_words"]),
        "dup_line_ratio": ratio(got["n_dup_lines"], got["n_lines"]),
        "repeat_word_ratio": ratio(got["n_repeat_words"], got["n_words"]),
    }
    return out, measures, [t, words, lines, hashes, order, places, m]


def verdict(measures: dict[str, Column], rules: Sequence[Rule]) -> Column:
    """True where every rule holds."""
    good = F.lit(True)
    for r in rules:
        if r.low is not None:
            good = good & (measures[r.measure] >= r.low)
        if r.high is not None:
            good = good & (measures[r.measure] <= r.high)
    return good


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def quality_rules(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, *, min_words: int = 50, max_repeat_pct: int = 50, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``df`` with the counts of ``OUT``, ``base_failed`` and ``kept``; no shuffle, no user function.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_pct`` percent of the
    words in repeated 3-word windows. ``kept``: not that, and all ``rules`` hold.

    A null text counts as empty: no words, so it fails the base rules. Rows are judged alone, so
    repeated rows get equal results; an empty table gives no rows; columns of ``df`` named like
    the new ones are replaced (``text`` may not be one of them).
    """
    out, m, helpers = measured(fresh(df, *OUT, "base_failed", "kept"), text, stop_words)
    base = (m["n_words"] < min_words) | (m["n_repeat_words"] * 100 > m["n_words"] * max_repeat_pct)
    good = ~base & verdict(m, rules)
    return out.withColumns({k: m[k] for k in OUT} | {"base_failed": base, "kept": good}).drop(*helpers)
