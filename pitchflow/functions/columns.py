"""Scalar functions of the match domain, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_match_date(text: Column) -> Column:
    """Day-first dates of two or four digit years, or ISO dates; another text is an error, null stays null."""
    tried = F.coalesce(*[F.try_to_date(text, f) for f in ("dd/MM/yyyy", "dd/MM/yy", "yyyy-MM-dd")])
    return F.when(text.isNull() | tried.isNotNull(), tried).otherwise(F.raise_error(F.concat(F.lit("not a date: "), text)).cast("date"))


def parse_season(text: Column) -> Column:
    """Starting year of '2012' or '2012/2013'; another length is an error."""
    year = F.when(F.length(text) == 4, text).when(F.length(text) == 9, F.split_part(text, F.lit("/"), F.lit(1)))
    return F.when(text.isNull() | year.isNotNull(), year).otherwise(F.raise_error(F.concat(F.lit("not a season: "), text)).cast("string")).cast("int")


def season_code(year: Column) -> Column:
    """2005 -> '0506'."""
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    return F.concat(two(year), two(year + 1))


def round_even(value: Column, digits: int) -> Column:
    """Rounds the scaled value half to even."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def over_under(home_goals: Column, away_goals: Column, line: float = 2.5) -> Column:
    """'O' for at least ``line`` goals, else 'U'; unknown goals count as under."""
    return F.when(F.coalesce(home_goals + away_goals >= line, F.lit(False)), "O").otherwise("U")


def result_code(result: Column) -> Column:
    """H, D, A -> 0, 1, 2; another value is an error."""
    bad = F.raise_error(F.concat(F.lit("not a result: "), result)).cast("int")
    return F.when(result == "H", 0).when(result == "D", 1).when(result == "A", 2).when(result.isNotNull(), bad)


def percent_text(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def country_key(name: Column) -> Column:
    """Lower case, letters and digits only, words joined by '-'; hyphens count as spaces."""
    plain = F.regexp_replace(F.translate(F.lower(name), "-", " "), r"[^a-z0-9\s]", "")
    return F.regexp_replace(F.trim(plain), r"\s+", "-")


def file_slug(name: Column) -> Column:
    """Lower case, runs of other characters become '_', none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def title_words(slug: Column) -> Column:
    """'-' and '_' become spaces and each word's first letter a capital; other letters stay."""
    words = F.split(F.translate(slug, "-_", "  "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**30))), " ")


def league_url(base: Column, country: Column, league: Column) -> Column:
    return F.lower(F.concat_ws("/", base, country, league))


def stage_of(header: Column) -> Column:
    """The text after the last ' - ', trimmed."""
    return F.trim(F.element_at(F.split(header, " - "), -1))


def category_key(category: Column) -> Column:
    return F.translate(F.lower(category), " ", "_")


def clean_information(text: Column) -> Column:
    """White space collapsed, every colon removed, trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[:\s]+|[:\s]+$|:", "")


def regulation_time(text: Column) -> Column:
    return F.regexp_replace(text, r"[\n()]", "")


def penalties(text: Column) -> Column:
    """What follows the label 'penalties', without white space."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(?is)penalties(.*)", 1), r"\s+", ""), F.lit(""))


def status_or_default(status: Column) -> Column:
    return F.coalesce(status, F.lit("NOT STARTED"))


def link_id(element_id: Column) -> Column:
    """The element id without the first 'g_1_'."""
    at = F.instr(element_id, "g_1_")
    return F.when(at > 0, F.concat(F.substring(element_id, F.lit(1), at - 1), F.substring(element_id, at + 4, F.lit(2**30)))).otherwise(element_id)


def statistics_url(url: Column) -> Column:
    """Origin and path of a match page, then the statistics page with the match id; null stays null."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")
    mid = F.regexp_extract(url, r"[?&]mid=([^&#]*)", 1)
    return F.concat(bare, F.lit("/summary/stats/0/?mid="), mid)


def key_values(arguments: Column) -> Column:
    """A map of 'key=value' words."""
    return F.str_to_map(arguments, F.lit(" "), F.lit("="))
