"""The registered queries of the match engine and their SQL. All run over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow import cli
from pitchflow.functions import columns as X
from pitchflow.operators import bayes, cleaning, discriminant, documents, form, lookup, metrics, models, neighbours, ranks, sampling, scaling, splits, training
from pitchflow.plans.matches import MATCHES_SQL
from pitchflow.plans.matches import matches as match_table
from pitchflow.sources import pages, seasons, stores
from pitchflow.streaming import refresh

N = 5
FORM = (*form.BASIC, *form.EXTRA)
SCALED = ("odd_1", "odd_x", "odd_2", "hc", "ac")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(df: DataFrame, *columns: str) -> DataFrame:
    """Dates as text, which every reader of the result shows alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(match_table(spark, sf_dir), "match_date")


def team_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form.team_form(match_table(spark, sf_dir), FORM, n=N).select("match_id", *FORM)


def match_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = match_table(spark, sf_dir)
    return df.select("match_id", X.over_under(F.col("hg"), F.col("ag")).alias("result_uo"), cleaning.week().alias("week"))


def odds_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = form.team_form(match_table(spark, sf_dir), ("hw", "aw"), n=N)
    return cleaning.odds_between(df, odd_1=(1.5, 4.0), odd_x=(None, 4.0), odd_2=(2.0, None)).select("match_id", "odd_1", "hw", "aw")


def odds_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaning.odds_fallback(match_table(spark, sf_dir), "odd_1", ("odd_1", "odd_x", "odd_2"), ("odd_2", "odd_2", "odd_x"))
    return df.select("match_id", "odd_1", "odd_x", "odd_2")


def season_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(match_table(spark, sf_dir).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.min("match_date").alias("first_day"), F.max("match_date").alias("last_day"), F.countDistinct("result").alias("n_results"), F.max(F.col("odd_1").isNull()).alias("has_gap")), "first_day", "last_day")


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = match_table(spark, sf_dir)
    return df.select(F.col("home").alias("team")).union(df.select("away")).distinct()


def clean_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = match_table(spark, sf_dir).select(*cleaning.BASE, *cleaning.EXTENDED)
    twice = raw.unionByName(raw.withColumn("match_date", F.when(F.col("hg") > 0, F.col("match_date"))))
    return _days(cleaning.clean(twice, 1900, extended=True), "match_date")


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaning.complete_rows(form.team_form(match_table(spark, sf_dir), ("hw", "aw", "hgd", "agd", "hw_pct"), n=N))
    return df.select("match_id", *cleaning.features_of(df))


def latest_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = form.team_form(match_table(spark, sf_dir), ("hw", "aw", "hgf", "agf", "hagf"), n=N).withColumn("week", cleaning.week())
    fixtures = df.groupBy("home", "away").agg(F.count(F.lit(1)).alias("met")).select(F.concat_ws("-", "home", "away").alias("fixture_id"), "home", "away", "met")
    out = lookup.latest_form(df, fixtures)
    return out.select("fixture_id", "met", "hw", "aw", "hgf", "agf", "hagf", "season", "week")


def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.holdout(match_table(spark, sf_dir), 20.0).select("match_id", "part")


def sliding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(splits.fold_ranges(splits.sliding_folds(match_table(spark, sf_dir), 5, 20.0)), "start_date", "end_date")


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_folds(match_table(spark, sf_dir), "result", "match_id", 5).groupBy("result", "fold").agg(F.count(F.lit(1)).alias("n"))


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("odd_1") < F.col("odd_2"), "H").when(F.col("odd_x") < F.col("odd_2"), "D").otherwise("A")
    return metrics.classification_metrics(match_table(spark, sf_dir).withColumn("said", said), "result", "said")


def scaler_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scaling.statistics(match_table(spark, sf_dir), SCALED)
    return df.select("feature", "low", "high", "largest", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def min_max_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = scaling.scale(match_table(spark, sf_dir), ("hc", "ac"), "min-max")
    return df.select("match_id", F.round("hc", 9).alias("hc"), F.round("ac", 9).alias("ac"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = match_table(spark, sf_dir)
    over = models.targets(df, "over-under").select("match_id", F.col("label").cast("int").alias("y_over"))
    hot = models.one_hot(models.targets(df)).select("match_id", F.col("label").cast("int").alias("y_result"), F.array_join("one_hot", "").alias("one_hot"))
    return hot.join(over, "match_id")


def season_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = match_table(spark, sf_dir)
    stored = df.where("season <= 1998").withColumn("origin", F.lit("stored"))
    fresh = df.where("season >= 1998").withColumn("origin", F.lit("fresh")).drop("ac")
    return cleaning.merge_seasons(stored, fresh).groupBy("season", "origin").agg(F.count(F.lit(1)).alias("n"), F.count("ac").alias("n_ac"))


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = match_table(spark, sf_dir)
    text = F.when(F.col("match_id") % 3 == 0, F.date_format("match_date", "dd/MM/yyyy")).when(F.col("match_id") % 3 == 1, F.date_format("match_date", "yyyy-MM-dd"))
    season = F.when(F.col("match_id") % 2 == 0, F.col("season").cast("string")).otherwise(F.concat_ws("/", "season", F.col("season") + 1))
    return df.select("match_id", X.parse_match_date(text).cast("string").alias("day"), X.parse_season(season).alias("season"), X.season_code(F.col("season")).alias("code"))


def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    found = neighbours.nearest(rows, rows.where("vec_id % 20 = 0"), 5, key="vec_id", vector="embedding", label="label")
    return neighbours.knn_vote(found).select("query", F.col("prediction").cast("int").alias("prediction"), F.col("votes").cast("int").alias("votes"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.links(_table(spark, sf_dir, "pages"))


def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.headings(_table(spark, sf_dir, "pages"))


def page_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", X.file_slug(url).alias("slug"), X.country_key(url).alias("country"), X.statistics_url(url).alias("stats_url"), X.category_key(url).alias("category"))


def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = documents.last_per_key(_table(spark, sf_dir, "conversations"), "conv_id", ("turn", "role", "text"))
    return last.select("conv_id", "turn", "role", F.length("text").alias("n_chars"))


def turn_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "conversations")
    roles = ("user", "assistant", "system")
    role = F.when(F.col("role").isin(*roles), F.col("role")).otherwise("other")
    return df.withColumn("role", role).groupBy("conv_id").pivot("role", [*roles, "other"]).agg(F.count(F.lit(1))).na.fill(0)


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"), F.count(k).alias("n"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/pitchflow-{name}-{uuid.uuid4().hex}"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(_table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _scratch(spark, "stream")
    refresh.upsert_stream(_event_stream(spark, sf_dir), f"{place}/table", "user_id", ("ts", "event_id"), f"{place}/checkpoint").awaitTermination()
    return refresh.latest(spark, f"{place}/table", "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type", "value")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _scratch(spark, "windows")
    stream = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    refresh.windowed_table(stream, "ts", "event_type", f"{place}/table", f"{place}/checkpoint").awaitTermination()
    newest = spark.read.parquet(f"{place}/table").groupBy("start", "event_type").agg(F.max_by("n", "seen").alias("n"))
    return newest.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def similar_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.similar_names(_table(spark, sf_dir, "supplier").select("s_name").distinct(), _table(spark, sf_dir, "nation").select("n_name"))


def as_of_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = form.team_form(match_table(spark, sf_dir), ("hgf", "agf"), n=N).withColumn("week", cleaning.week())
    fixtures = df.select(F.col("match_id").alias("fixture_id"), "match_date", "home", "away")
    return lookup.latest_form(df, fixtures, as_of=True).select("fixture_id", "hgf", "agf")


def _raw_main(df: DataFrame) -> DataFrame:
    """Matches under the names of the raw main layout, with spare odds of their own."""
    named = df.select(*[F.col(new).alias(old) for old, new in cleaning.MAIN_COLUMNS.items()])
    return named.withColumn("Date", F.date_format("Date", "dd/MM/yyyy")).withColumns({"B365H": F.lit(1.5), "B365D": F.lit(2.5), "B365A": F.lit(3.5)})


def season_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _scratch(spark, "seasons")
    raw = _raw_main(match_table(spark, sf_dir))
    raw.withColumn("year", F.col("Season")).drop("Season").write.option("header", True).partitionBy("year").csv(place)
    years = [r[0] for r in raw.select("Season").distinct().collect()]  # one file for each
    read = seasons.read_seasons(spark, {y: f"{place}/year={y}" for y in sorted(years)}, cli.MAIN_RAW)
    return _days(cleaning.clean(cleaning.from_main(read), 1990, extended=True).drop("week"), "match_date")


def stored_league(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw_main(match_table(spark, sf_dir))
    league = stores.League("X", "Y", 1990, "main", "", league_id="x", statistics=("hw", "aw"))
    store = stores.LeagueStore(spark, _scratch(spark, "leagues"))
    store.create(league, lambda one, year: raw.where(F.col("Season").between(year, 1998)))
    table = store.update("x", lambda one, year: raw.where(F.col("Season") >= year))
    return table.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("hg").alias("goals"), F.count("hw").alias("n_hw"), F.max("week").alias("weeks"))


def _page(df: DataFrame) -> DataFrame:
    """A summary and a statistics page of each match, as a browser would save them."""
    div = lambda attributes, body: F.concat(F.lit(f"<div {attributes}>"), body, F.lit("</div>"))
    text = lambda c: F.col(c).cast("string")
    side = lambda name: div(f"class='duelParticipant__{name} x'", F.concat(F.lit("<img class=\"participant__image\" src='/"), text(name), F.lit(".png'><div class='participant__participantName participant__overflow'> <a href='#'>"), text(name), F.lit("</a>\n</div>")))
    score = div("class='detailScore__wrapper'", F.concat(F.lit("<span>"), text("hg"), F.lit("</span><span class='detailScore__divider'>-</span><span>"), text("ag"), F.lit("</span>")))
    headers = F.concat(*[F.concat(F.lit('<span data-testid="wcl-scores-overline-03">'), part, F.lit("</span>")) for part in (F.lit("Football"), F.lit("X"), F.concat(F.lit("League &amp; Cup - Round "), text("season")))])
    info = div("data-testid='wcl-summaryMatchInformation'", F.concat(*[div("", x) for x in (F.lit("<b>Refe ree:</b>"), F.concat(F.lit(" Mr "), text("away")), F.lit("Attendance"), F.concat(F.lit("44 "), text("hc")))]))
    state = F.when(F.col("match_id") % 3 == 0, F.lit("")).otherwise(F.lit("<span class='fixedHeaderDuel__detailStatus'>Finished</span>"))
    summary = F.concat(F.lit("<html><body><script>var x = '<div>';</script>"), headers, div("class='duelParticipant__startTime'", text("match_date")), state, side("home"), side("away"), score, info, F.lit("</body></html>"))
    block = lambda name, a, b: div("data-testid='wcl-statistics'", F.concat(div("data-testid='wcl-statistics-category'", F.lit(name)), *[div("data-testid='wcl-statistics-value'", F.concat(F.lit("<strong>"), text(x), F.lit("</strong>"))) for x in (a, b)]))
    return df.select("match_id", summary.alias("summary"), F.concat(block("Corner Kicks", "hc", "ac"), block("Goals", "hg", "ag")).alias("statistics"))


def _saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are far larger than the rows they come from, so these are dealt to all cores first."""
    return _page(match_table(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "match_id"))


def match_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.match_documents(_saved_pages(spark, sf_dir))
    join = lambda c, *fields: F.array_join(F.transform(c, lambda e: F.concat_ws("=", *[e[f] for f in fields])), ";")
    return found.select("match_id", "stage", "date", "status", F.col("home.name").alias("home"), F.col("away.image").alias("away_image"), F.col("result.home").alias("hg"), F.col("result.away").alias("ag"), "result.penalties", join("information", "category", "value").alias("information"), join("statistics", "category", "homeValue", "awayValue").alias("statistics"))


def flat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = documents.flat_table(pages.match_documents(_saved_pages(spark, sf_dir)))
    return flat.toDF(*[c.replace(".", "_") for c in flat.columns])


def discriminant_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training.cross_validate_sliding(match_table(spark, sf_dir), k=3, algorithm="discriminant", normalizer=None, calibrate=False, features=("odd_x", "odd_2"))
    return _days(out, "start_date", "end_date")


def stratified_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-fold cross-validation of a standardised discriminant."""
    return training.cross_validate(match_table(spark, sf_dir), k=5, algorithm="discriminant", features=("odd_x", "odd_2"))


def _bayes(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    df = models.targets(match_table(spark, sf_dir)).withColumns({c: F.col(c).cast("double") for c in ("hc", "ac")})
    found = bayes.Bayes.fit(df, ("odd_x", "odd_2", "hc", "ac"), kind=kind)
    return df.select("match_id", *[F.round(found.score(c), 6).alias(f"score_{c}") for c in range(3)])


def bayes_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bayes(spark, sf_dir, "gaussian")


def bayes_multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bayes(spark, sf_dir, "multinomial")


def bayes_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bayes(spark, sf_dir, "complement")


def quadratic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = models.targets(match_table(spark, sf_dir), "over-under")
    found = discriminant.Discriminant.fit(df, ("odd_x", "odd_2"), quadratic=True)
    return df.select("match_id", *[F.round(found.score(c), 6).alias(f"score_{c}") for c in range(2)])


def extra_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extra layout: seasons as text of one or two years, closing odds, no shots or corners."""
    df = match_table(spark, sf_dir)
    raw = df.select(*[F.col(new).alias(old) for old, new in cleaning.EXTRA_COLUMNS.items()]).withColumn("Date", F.date_format("Date", "dd/MM/yyyy"))
    raw = raw.withColumn("Season", F.when(F.col("Season") % 2 == 0, F.col("Season").cast("string")).otherwise(F.concat_ws("/", "Season", F.col("Season") + 1)))
    found = cleaning.clean(cleaning.from_extra(raw, 1994).select(*cleaning.BASE), 1994)
    return _days(found, "match_date").select(*cleaning.BASE, "result_uo")


def price_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of each return flag's prices."""
    levels = ranks.quantiles(_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"A": 0.9, "N": 0.5, "R": 0.013})
    return spark.createDataFrame([(g, float(v)) for g, v in sorted(levels.items())], "l_returnflag string, level double").withColumn("level", F.round("level", 6))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest tenth of the orders."""
    orders = _table(spark, sf_dir, "orders")
    return ranks.top_rows(orders, "o_totalprice", "o_orderkey", orders.count() // 10).select("o_orderkey", "o_totalprice")


def near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("label"))
    return sampling.near_miss(df, ("c_acctbal", "c_nationkey"), key="c_custkey").select("c_custkey", F.col("label").cast("int").alias("label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        matches, team_form, match_week, odds_range, odds_fallback, season_summary, teams, clean_matches, feature_rows, latest_form, holdout, sliding_folds,
        stratified_folds, confusion_metrics, scaler_statistics, min_max_scaled, targets, season_update, date_texts, knn_vote, page_links, page_headings,
        page_slugs, last_turns, turn_pivot, event_json, stream_upsert, stream_windows, similar_suppliers, as_of_form, season_files, stored_league,
        match_documents, flat_documents, discriminant_validation, quadratic_scores, near_miss, stratified_validation,
        extra_matches, price_levels, top_orders,
        bayes_gaussian, bayes_multinomial, bayes_complement,
    )
}

# ---------------------------------------------------------------- SQL

_M = "m AS (" + MATCHES_SQL.format(orders="orders") + ")"
_O = "ORDER BY match_date, home, match_id"
_WIN, _AWAY = "CASE WHEN result = 'H' THEN 1 ELSE 0 END", "CASE WHEN result = 'A' THEN 1 ELSE 0 END"
_AHEAD, _BEHIND = "CASE WHEN hg - ag >= 2 THEN 1 ELSE 0 END", "CASE WHEN ag - hg >= 2 THEN 1 ELSE 0 END"
_ROLLED = {
    "hw": (_WIN, "h"), "aw": (_AWAY, "a"), "hl": (_AWAY, "h"), "al": (_WIN, "a"), "hgf": ("hg", "h"), "agf": ("ag", "a"), "hga": ("ag", "h"), "aga": ("hg", "a"),
    "hgd": ("hg - ag", "h"), "agd": ("ag - hg", "a"), "hwgd": (_AHEAD, "h"), "awgd": (_BEHIND, "a"), "hlgd": (_BEHIND, "h"), "algd": (_AHEAD, "a"),
    "hstf": ("hst", "h"), "astf": ("ast", "a"), "hcf": ("hc", "h"), "acf": ("ac", "a"),
}
_SHARES = {"hw_pct": (_WIN, "hc_"), "hl_pct": (_AWAY, "hc_"), "aw_pct": (_AWAY, "ac_"), "al_pct": (_WIN, "ac_")}
_FORM = (
    _M + ", f AS (SELECT *, "
    + ", ".join(f"CASE WHEN count({e}) OVER {w} >= {N} THEN CAST(sum({e}) OVER {w} AS DOUBLE) END AS {k}" for k, (e, w) in _ROLLED.items()) + ", "
    + ", ".join(f"round_even(CAST(sum({e}) OVER {w} AS DOUBLE) / NULLIF(CAST(count(*) OVER {w} AS DOUBLE), 0) * 100, 1) AS {k}" for k, (e, w) in _SHARES.items())
    + f", row_number() OVER (PARTITION BY season, home {_O}) AS week FROM m WINDOW "
    + ", ".join(f"{w} AS (PARTITION BY season, {r} {_O} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for w, r, n in (("h", "home", N), ("a", "away", N), ("hc_", "home", "UNBOUNDED"), ("ac_", "away", "UNBOUNDED")))
    + "), form AS (SELECT *, " + ", ".join(f"{a} - {b} AS {k}" for k, (a, b) in form.DIFFERENCES.items()) + " FROM f)"
)
_NEWEST = "(match_date, home, match_id)"
_UO = "CASE WHEN hg + ag >= 2.5 THEN 'O' ELSE 'U' END"
_KEY = "CAST('0x' || substr(md5(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(30))" for c in (*cleaning.BASE, *cleaning.EXTENDED)) + ")), 1, 15) AS BIGINT)"

_BAYES = """d AS (SELECT match_id, odd_x, odd_2, hc, ac, CASE result WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS y FROM m),
r AS (SELECT y AS c, ln(count(*) / (SELECT count(*) FROM d)) AS p FROM d GROUP BY y),
l AS (SELECT match_id, y, 1 AS f, odd_x AS v FROM d UNION ALL SELECT match_id, y, 2, odd_2 FROM d UNION ALL SELECT match_id, y, 3, hc FROM d UNION ALL SELECT match_id, y, 4, ac FROM d)"""
_SCORES = "SELECT match_id, " + ", ".join(f"round(max(score) FILTER (WHERE c = {c}), 6) AS score_{c}" for c in range(3)) + " FROM s GROUP BY match_id"

ORACLE_SQL: dict[str, str] = {
    "matches": f"WITH {_M} SELECT * REPLACE (CAST(match_date AS VARCHAR) AS match_date) FROM m",
    "team_form": f"WITH {_FORM} SELECT match_id, {', '.join(FORM)} FROM form",
    "match_week": f"WITH {_FORM} SELECT match_id, CASE WHEN hg + ag >= 2.5 THEN 'O' ELSE 'U' END AS result_uo, CAST(week AS INT) AS week FROM form",
    "odds_range": f"WITH {_FORM} SELECT match_id, odd_1, hw, aw FROM form WHERE odd_1 BETWEEN 1.5 AND 4.0 AND odd_x <= 4.0 AND odd_2 >= 2.0",
    "odds_fallback": f"WITH {_M} SELECT match_id, CASE WHEN odd_1 IS NULL THEN odd_2 ELSE odd_1 END AS odd_1, CASE WHEN odd_1 IS NULL THEN odd_2 ELSE odd_x END AS odd_x, CASE WHEN odd_1 IS NULL THEN odd_x ELSE odd_2 END AS odd_2 FROM m",
    "season_summary": f"WITH {_M} SELECT season, count(*) AS n, CAST(min(match_date) AS VARCHAR) AS first_day, CAST(max(match_date) AS VARCHAR) AS last_day, count(DISTINCT result) AS n_results, bool_or(odd_1 IS NULL) AS has_gap FROM m GROUP BY season",
    "teams": f"WITH {_M} SELECT home AS team FROM m UNION SELECT away FROM m",
    "clean_matches": f"""WITH {_M}, d AS (SELECT DISTINCT {', '.join((*cleaning.BASE, *cleaning.EXTENDED))} FROM m), k AS (SELECT *, {_KEY} AS match_id FROM d)
SELECT match_id, CAST(match_date AS VARCHAR) AS match_date, season, home, away, hg, ag, result, {_UO} AS result_uo, odd_1, odd_x, odd_2, hst, ast, hc, ac,
  CAST(row_number() OVER (PARTITION BY season, home {_O}) AS INT) AS week FROM k""",
    "season_files": f"""WITH {_M}, r AS (SELECT * REPLACE (CASE WHEN odd_1 IS NULL THEN 1.5 ELSE odd_1 END AS odd_1, CASE WHEN odd_1 IS NULL THEN 2.5 ELSE odd_x END AS odd_x, CASE WHEN odd_1 IS NULL THEN 3.5 ELSE odd_2 END AS odd_2) FROM m),
d AS (SELECT DISTINCT {', '.join((*cleaning.BASE, *cleaning.EXTENDED))} FROM r)
SELECT {_KEY} AS match_id, CAST(match_date AS VARCHAR) AS match_date, season, home, away, hg, ag, result, {_UO} AS result_uo, odd_1, odd_x, odd_2, hst, ast, hc, ac FROM d""",
    "stored_league": f"""WITH {_M}, d AS (SELECT DISTINCT {', '.join(c if not c.startswith('odd') else f'CASE WHEN odd_1 IS NULL THEN {v} ELSE {c} END AS {c}' for c, v in zip(cleaning.BASE, (0,) * 7 + (1.5, 2.5, 3.5)))} FROM m),
w AS (SELECT *, row_number() OVER (PARTITION BY season, home ORDER BY match_date) AS week FROM d)
SELECT season, count(*) AS n, CAST(sum(hg) AS BIGINT) AS goals, count(*) FILTER (WHERE week > 10) AS n_hw, CAST(max(week) AS INT) AS weeks FROM w GROUP BY season""",
    "stream_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "as_of_form": f"""WITH {_FORM}, c AS (SELECT * FROM form WHERE odd_1 IS NOT NULL AND hst IS NOT NULL AND ast IS NOT NULL AND hgf IS NOT NULL AND agf IS NOT NULL),
h AS (SELECT home, match_date, arg_max(hgf, {_NEWEST}) AS hgf FROM c GROUP BY ALL), a AS (SELECT away, match_date, arg_max(agf, {_NEWEST}) AS agf FROM c GROUP BY ALL)
SELECT m.match_id AS fixture_id, h.hgf, a.agf FROM m ASOF LEFT JOIN h ON m.home = h.home AND m.match_date > h.match_date ASOF LEFT JOIN a ON m.away = a.away AND m.match_date > a.match_date""",
    "match_documents": f"""WITH {_M} SELECT CAST(match_id AS VARCHAR) AS match_id, 'Round ' || season AS stage, CAST(match_date AS VARCHAR) AS date, CASE WHEN match_id % 3 = 0 THEN 'NOT STARTED' ELSE 'Finished' END AS status,
  home, '/' || away || '.png' AS away_image, CAST(hg AS VARCHAR) AS hg, CAST(ag AS VARCHAR) AS ag, CAST(NULL AS VARCHAR) AS penalties,
  'Refe ree=Mr ' || away || ';Attendance=44 ' || hc AS information, 'Corner Kicks=' || hc || '=' || ac || ';Goals=' || hg || '=' || ag AS statistics FROM m""",
    "flat_documents": f"""WITH {_M} SELECT CAST(match_id AS VARCHAR) AS match_id, 'Round ' || season AS stage, CASE WHEN match_id % 3 = 0 THEN 'NOT STARTED' ELSE 'Finished' END AS status, CAST(match_date AS VARCHAR) AS date,
  home AS home_name, '/' || home || '.png' AS home_image, away AS away_name, '/' || away || '.png' AS away_image, CAST(hg AS VARCHAR) AS result_home, CAST(ag AS VARCHAR) AS result_away,
  '44 ' || hc AS information_attendance, 'Mr ' || away AS information_refe_ree, CAST(hc AS VARCHAR) AS statistics_corner_kicks_home, CAST(ac AS VARCHAR) AS statistics_corner_kicks_away, CAST(hg AS VARCHAR) AS statistics_goals_home, CAST(ag AS VARCHAR) AS statistics_goals_away FROM m""",
    "discriminant_validation": f"""WITH {_M}, c AS (SELECT *, CAST(CAST(odd_x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(odd_2 AS FLOAT) AS DOUBLE) AS z, CASE result WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS y FROM m WHERE odd_1 IS NOT NULL AND hst IS NOT NULL AND ast IS NOT NULL),
p AS (SELECT *, row_number() OVER ({_O}) AS k, count(*) OVER () // 3 AS s FROM c),
d AS (SELECT *, CASE WHEN k > (fold + 1) * s - floor((fold + 1) * s * 20.0 / 100) THEN 'Evaluation' ELSE 'Train' END AS data FROM p, (SELECT CAST(unnest(range(3)) AS INT) AS fold) WHERE k <= (fold + 1) * s),
g AS (SELECT fold, y AS c, count(*) AS n, avg(x) AS mx, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(x, z) AS xz, covar_pop(z, z) AS zz FROM d WHERE data = 'Train' GROUP BY ALL),
t AS (SELECT fold, sum(n) AS total, sum(n * xx) / (sum(n) - count(*)) AS xx, sum(n * xz) / (sum(n) - count(*)) AS xz, sum(n * zz) / (sum(n) - count(*)) AS zz FROM g GROUP BY fold),
i AS (SELECT fold, total, zz / (xx * zz - xz * xz) AS a, -xz / (xx * zz - xz * xz) AS b, xx / (xx * zz - xz * xz) AS e FROM t),
q AS (SELECT d.fold, data, match_date, y, arg_max(g.c, (a * mx + b * mz) * x + (b * mx + e * mz) * z - (a * mx * mx + 2 * b * mx * mz + e * mz * mz) / 2 + ln(n / total)) AS said FROM d JOIN g USING (fold) JOIN i USING (fold) GROUP BY d.fold, data, match_date, match_id, y),
k AS (SELECT fold, data, c, CAST(count(*) FILTER (WHERE y = c) AS DOUBLE) AS t, CAST(count(*) FILTER (WHERE said = c) AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE y = c AND said = c) AS DOUBLE) AS h FROM q, (SELECT unnest([0, 1, 2]) AS c) GROUP BY ALL HAVING count(*) FILTER (WHERE y = c OR said = c) > 0),
r AS (SELECT fold, data, CAST(min(match_date) AS VARCHAR) AS start_date, CAST(max(match_date) AS VARCHAR) AS end_date, count(*) AS samples FROM q GROUP BY ALL)
SELECT fold, data, round_even(sum(h) / sum(t), 3) AS accuracy, round_even(avg(2 * h / (s + t)), 3) AS f1, round_even(avg(coalesce(h / nullif(s, 0), 0)), 3) AS precision, round_even(avg(coalesce(h / nullif(t, 0), 0)), 3) AS recall, start_date, end_date, samples FROM k JOIN r USING (fold, data) GROUP BY ALL""",
    "stratified_validation": f"""WITH {_M}, c AS (SELECT match_id, CAST(CAST(odd_x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(odd_2 AS FLOAT) AS DOUBLE) AS z, CASE result WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS y FROM m WHERE odd_1 IS NOT NULL AND hst IS NOT NULL AND ast IS NOT NULL),
p AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5('0:' || match_id)) - 1) % 5 AS own FROM c),
d AS (SELECT *, CASE WHEN own = fold THEN 'Evaluation' ELSE 'Train' END AS data FROM p, (SELECT CAST(unnest(range(5)) AS INT) AS fold)),
g AS (SELECT fold, y AS c, count(*) AS n, avg(x) AS mx, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(x, z) AS xz, covar_pop(z, z) AS zz FROM d WHERE data = 'Train' GROUP BY ALL),
t AS (SELECT fold, sum(n) AS total, sum(n * xx) / (sum(n) - count(*)) AS xx, sum(n * xz) / (sum(n) - count(*)) AS xz, sum(n * zz) / (sum(n) - count(*)) AS zz FROM g GROUP BY fold),
i AS (SELECT fold, total, zz / (xx * zz - xz * xz) AS a, -xz / (xx * zz - xz * xz) AS b, xx / (xx * zz - xz * xz) AS e FROM t),
q AS (SELECT d.fold, data, y, arg_max(g.c, (a * mx + b * mz) * x + (b * mx + e * mz) * z - (a * mx * mx + 2 * b * mx * mz + e * mz * mz) / 2 + ln(n / total)) AS said FROM d JOIN g USING (fold) JOIN i USING (fold) GROUP BY d.fold, data, match_id, y),
k AS (SELECT fold, data, c, CAST(count(*) FILTER (WHERE y = c) AS DOUBLE) AS t, CAST(count(*) FILTER (WHERE said = c) AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE y = c AND said = c) AS DOUBLE) AS h FROM q, (SELECT unnest([0, 1, 2]) AS c) GROUP BY ALL HAVING count(*) FILTER (WHERE y = c OR said = c) > 0)
SELECT fold, data, round_even(sum(h) / sum(t), 3) AS accuracy, round_even(avg(2 * h / (s + t)), 3) AS f1, round_even(avg(coalesce(h / nullif(s, 0), 0)), 3) AS precision, round_even(avg(coalesce(h / nullif(t, 0), 0)), 3) AS recall FROM k GROUP BY ALL""",
    "bayes_gaussian": f"""WITH {_M}, {_BAYES},
e AS (SELECT max(v) * 1e-9 AS e FROM (SELECT var_pop(v) AS v FROM l GROUP BY f)),
g AS (SELECT f, y, avg(v) AS mean, var_pop(v) + (SELECT e FROM e) AS var FROM l GROUP BY f, y),
s AS (SELECT match_id, c, max(p) + sum(-ln(2 * pi() * var) / 2 - (v - mean) * (v - mean) / (2 * var)) AS score FROM (SELECT match_id, f, v FROM l) JOIN g USING (f) JOIN r ON r.c = g.y GROUP BY match_id, c)
{_SCORES}""",
    "bayes_multinomial": f"""WITH {_M}, {_BAYES},
g AS (SELECT f, y, sum(v) + 1 AS n FROM l GROUP BY f, y), t AS (SELECT y, sum(n) AS total FROM g GROUP BY y),
s AS (SELECT match_id, c, max(p) + sum(v * ln(n / total)) AS score FROM (SELECT match_id, f, v FROM l) JOIN g USING (f) JOIN t USING (y) JOIN r ON r.c = y GROUP BY match_id, c)
{_SCORES}""",
    "bayes_complement": f"""WITH {_M}, {_BAYES},
o AS (SELECT f, y, sum(v) AS n FROM l GROUP BY f, y), g AS (SELECT f, y, sum(n) OVER (PARTITION BY f) - n + 1 AS n FROM o), t AS (SELECT y, sum(n) AS total FROM g GROUP BY y),
s AS (SELECT match_id, y AS c, sum(-v * ln(n / total)) AS score FROM (SELECT match_id, f, v FROM l) JOIN g USING (f) JOIN t USING (y) GROUP BY match_id, y)
{_SCORES}""",
    "extra_matches": f"""WITH {_M}, d AS (SELECT DISTINCT {', '.join(cleaning.BASE)} FROM m)
SELECT CAST(match_date AS VARCHAR) AS match_date, season, home, away, hg, ag, result, odd_1, odd_x, odd_2, {_UO} AS result_uo FROM d""",
    "price_levels": "SELECT l_returnflag, round(CASE l_returnflag WHEN 'A' THEN quantile_cont(l_extendedprice, 0.9) WHEN 'N' THEN quantile_cont(l_extendedprice, 0.5) ELSE quantile_cont(l_extendedprice, 0.013) END, 6) AS level FROM lineitem GROUP BY l_returnflag",
    "top_orders": "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= (SELECT count(*) // 10 FROM orders)",
    "quadratic_scores": f"""WITH {_M}, d AS (SELECT match_id, odd_x AS x, odd_2 AS z, CASE WHEN hg + ag >= 2.5 THEN 1 ELSE 0 END AS y FROM m),
g AS (SELECT y AS c, count(*) AS n, avg(x) AS mx, avg(z) AS mz, covar_samp(x, x) AS xx, covar_samp(x, z) AS xz, covar_samp(z, z) AS zz FROM d GROUP BY y),
s AS (SELECT match_id, c, -(zz * (x - mx) * (x - mx) - 2 * xz * (x - mx) * (z - mz) + xx * (z - mz) * (z - mz)) / (xx * zz - xz * xz) / 2 + ln(n / (SELECT count(*) FROM d)) - ln(xx * zz - xz * xz) / 2 AS score FROM d, g)
SELECT match_id, round(max(score) FILTER (WHERE c = 0), 6) AS score_0, round(max(score) FILTER (WHERE c = 1), 6) AS score_1 FROM s GROUP BY match_id""",
    "near_miss": """WITH d AS (SELECT c_custkey AS k, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS z, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS y FROM customer),
n AS (SELECT y, count(*) AS n FROM d GROUP BY y), s AS (SELECT arg_min(y, (n, y)) AS y, min(n) AS n FROM n),
p AS (SELECT a.k AS small, b.k AS large, sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)) AS d FROM d a JOIN d b ON a.y = (SELECT y FROM s) AND b.y <> (SELECT y FROM s)),
c AS (SELECT DISTINCT large FROM (SELECT *, row_number() OVER (PARTITION BY small ORDER BY d, large) AS r FROM p) WHERE r <= 5),
f AS (SELECT large, avg(d) AS far FROM (SELECT *, row_number() OVER (PARTITION BY large ORDER BY d, small) AS r FROM p WHERE large IN (SELECT large FROM c)) WHERE r <= 5 GROUP BY large)
SELECT k AS c_custkey, y AS label FROM d WHERE y = (SELECT y FROM s) OR k IN (SELECT large FROM f ORDER BY far DESC, large LIMIT (SELECT n FROM s))""",
    "feature_rows": f"WITH {_FORM} SELECT match_id, odd_1, odd_x, odd_2, hw, aw, hgd, agd, hw_pct FROM form WHERE odd_1 IS NOT NULL AND hst IS NOT NULL AND ast IS NOT NULL AND hw IS NOT NULL AND aw IS NOT NULL AND hw_pct IS NOT NULL",
    "latest_form": f"""WITH {_FORM}, c AS (SELECT * FROM form WHERE odd_1 IS NOT NULL AND hst IS NOT NULL AND ast IS NOT NULL AND hw IS NOT NULL AND aw IS NOT NULL),
h AS (SELECT home, arg_max(hw, {_NEWEST}) AS hw, arg_max(hgf, {_NEWEST}) AS hgf, arg_max(hagf, {_NEWEST}) AS hagf FROM c GROUP BY home),
a AS (SELECT away, arg_max(aw, {_NEWEST}) AS aw, arg_max(agf, {_NEWEST}) AS agf FROM c GROUP BY away),
l AS (SELECT arg_max(season, {_NEWEST}) AS season, CAST(arg_max(week, {_NEWEST}) + 1 AS INT) AS week FROM c),
x AS (SELECT home, away, count(*) AS met FROM m GROUP BY home, away)
SELECT x.home || '-' || x.away AS fixture_id, met, hw, aw, hgf, agf, hagf, season, week FROM x LEFT JOIN h ON x.home = h.home LEFT JOIN a ON x.away = a.away, l""",
    "holdout": f"WITH {_M} SELECT match_id, CASE WHEN row_number() OVER (ORDER BY match_date DESC, home DESC, match_id DESC) <= floor(count(*) OVER () * 20.0 / 100) THEN 'test' ELSE 'train' END AS part FROM m",
    "sliding_folds": f"""WITH {_M}, p AS (SELECT match_date, row_number() OVER ({_O}) AS k, count(*) OVER () // 5 AS s FROM m),
x AS (SELECT *, CASE WHEN k > (fold + 1) * s - floor((fold + 1) * s * 20.0 / 100) THEN 'test' ELSE 'train' END AS part FROM p, (SELECT CAST(unnest(range(5)) AS INT) AS fold) WHERE k <= (fold + 1) * s)
SELECT fold, part, CAST(min(match_date) AS VARCHAR) AS start_date, CAST(max(match_date) AS VARCHAR) AS end_date, count(*) AS samples FROM x GROUP BY fold, part""",
    "stratified_folds": f"WITH {_M}, x AS (SELECT result, CAST((row_number() OVER (PARTITION BY result ORDER BY md5('0:' || match_id)) - 1) % 5 AS INT) AS fold FROM m) SELECT result, fold, count(*) AS n FROM x GROUP BY result, fold",
    "confusion_metrics": f"""WITH {_M}, p AS (SELECT result AS y, CASE WHEN odd_1 < odd_2 THEN 'H' WHEN odd_x < odd_2 THEN 'D' ELSE 'A' END AS s FROM m),
k AS (SELECT y AS c FROM p UNION SELECT s FROM p),
t AS (SELECT c, CAST((SELECT count(*) FROM p WHERE y = c) AS DOUBLE) AS t, CAST((SELECT count(*) FROM p WHERE s = c) AS DOUBLE) AS s, CAST((SELECT count(*) FROM p WHERE y = c AND s = c) AS DOUBLE) AS h FROM k)
SELECT round_even(sum(h) / sum(t), 3) AS accuracy, round_even(avg(2 * h / (s + t)), 3) AS f1, round_even(avg(coalesce(h / nullif(s, 0), 0)), 3) AS precision, round_even(avg(coalesce(h / nullif(t, 0), 0)), 3) AS recall FROM t""",
    "scaler_statistics": f"WITH {_M} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, CAST(max(abs({c})) AS DOUBLE) AS largest, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS deviation FROM m" for c in SCALED),
    "min_max_scaled": f"WITH {_M} SELECT match_id, round((hc - min(hc) OVER ()) / CAST(max(hc) OVER () - min(hc) OVER () AS DOUBLE), 9) AS hc, round((ac - min(ac) OVER ()) / CAST(max(ac) OVER () - min(ac) OVER () AS DOUBLE), 9) AS ac FROM m",
    "targets": f"WITH {_M} SELECT match_id, CASE result WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS y_result, CASE result WHEN 'H' THEN '100' WHEN 'D' THEN '010' ELSE '001' END AS one_hot, CASE WHEN hg + ag >= 2.5 THEN 1 ELSE 0 END AS y_over FROM m",
    "season_update": f"WITH {_M} SELECT season, 'stored' AS origin, count(*) AS n, count(ac) AS n_ac FROM m WHERE season < 1998 GROUP BY season UNION ALL SELECT season, 'fresh', count(*), 0 FROM m WHERE season >= 1998 GROUP BY season",
    "date_texts": f"WITH {_M} SELECT match_id, CASE WHEN match_id % 3 < 2 THEN CAST(match_date AS VARCHAR) END AS day, season, lpad(CAST(season % 100 AS VARCHAR), 2, '0') || lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0') AS code FROM m",
    "knn_vote": """WITH d AS (SELECT q.vec_id AS query, r.vec_id, r.label, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS d FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
b AS (SELECT query, label FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS k FROM d) WHERE k <= 5),
v AS (SELECT query, label, count(*) AS votes FROM b GROUP BY query, label)
SELECT query, CAST(label AS INT) AS prediction, CAST(votes AS INT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) AS k FROM v) WHERE k = 1""",
    "page_links": f"""WITH a AS (SELECT page_id, regexp_extract_all(html, '{pages.ANCHOR}', 1) AS a, regexp_extract_all(html, '{pages.ANCHOR}', 2) AS b FROM pages),
u AS (SELECT page_id, i, regexp_extract(a[i], '{pages.HREF.replace("'", "''")}', 1) AS u, trim(regexp_replace(b[i], '<[^>]*>', '', 'g')) AS name FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM a))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS position, regexp_replace(u, '^["'']|["'']$', '', 'g') AS url, name FROM u WHERE u <> ''""",
    "page_headings": """SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, nullif(regexp_extract(html, '<html\\b[^>]*\\blang="([^"]*)"', 1), '') AS lang, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_paragraphs FROM pages""",
    "page_slugs": """SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
  regexp_replace(trim(regexp_replace(replace(lower(url), '-', ' '), '[^a-z0-9\\s]', '', 'g')), '\\s+', '-', 'g') AS country,
  regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') || '/summary/stats/0/?mid=' || regexp_extract(url, '[?&]mid=([^&#]*)', 1) AS stats_url, replace(lower(url), ' ', '_') AS category FROM pages""",
    "last_turns": "SELECT conv_id, max(turn) AS turn, arg_max(role, (turn, role, text)) AS role, CAST(length(arg_max(text, (turn, role, text))) AS INT) AS n_chars FROM conversations GROUP BY conv_id",
    "turn_pivot": "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS user, count(*) FILTER (WHERE role = 'assistant') AS assistant, count(*) FILTER (WHERE role = 'system') AS system, count(*) FILTER (WHERE role IS NULL OR role NOT IN ('user', 'assistant', 'system')) AS other FROM conversations GROUP BY conv_id",
    "event_json": "SELECT event_type, CAST(sum(CAST(props ->> '$.k' AS INT)) AS BIGINT) AS k_sum, max(CAST(props ->> '$.k' AS INT)) AS k_max, count(props ->> '$.k') AS n FROM events GROUP BY event_type",
    "stream_upsert": "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY user_id",
}
