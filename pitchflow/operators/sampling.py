"""Resampling of training rows: fewer rows of the large classes, or made rows of the small ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchflow.operators import kernels, models, neighbours
from pitchflow.operators.ranks import quantiles, top_rows
from pitchflow.operators.splits import shuffled_places, stratified_folds


def class_counts(df: DataFrame, label: str = "label") -> dict[float, int]:
    """Rows of each class; one row per class comes to the driver. Classes in order."""
    return dict(sorted((r[label], r["n"]) for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()))


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumn("_vector", F.array(*[F.col(f).cast("double") for f in features]))


def near_miss(df: DataFrame, features: Sequence[str], *, key: str = "match_id", k: int = 5, candidates: int = 5, label: str = "label", seed: int = 0) -> DataFrame:
    """Version 3: of each larger class the nearest ``candidates`` rows of every smallest-class row are candidates;
    those farthest, on average, from their k nearest smallest-class rows stay, as many as the smallest class has.

    Ties go to the smaller key.
    """
    n = class_counts(df, label)
    if len(n) < 2:
        return df
    small = min(n, key=lambda c: (n[c], c))
    packed = _vectors(df, features)
    minority = packed.where(F.col(label) == small)
    out = df.where(F.col(label) == small)
    for c in n:
        if c != small:
            mine = packed.where(F.col(label) == c)
            met = neighbours.nearest(mine, minority, candidates, key=key, vector="_vector", label=label).select(F.col("neighbour").alias(key)).distinct()
            far = neighbours.nearest(minority, mine.join(met, key, "left_semi"), k, key=key, vector="_vector", label=label)
            kept = far.groupBy(F.col("query").alias(key)).agg(F.avg("distance").alias("far"))
            kept = top_rows(models.written(kept), "far", key, n[small]).select(key)
            out = out.unionByName(df.where(F.col(label) == c).join(kept, key, "left_semi"))
    return out


def instance_hardness(df: DataFrame, features: Sequence[str], *, key: str = "match_id", folds: int = 5, n_estimators: int = 100, label: str = "label", seed: int = 0) -> DataFrame:
    """Of each larger class the rows stay that a forest, fitted without them, finds likeliest.

    The limit is the percentile of the class's probabilities that leaves as many rows as the
    smallest class has (more where probabilities tie).
    """
    n = class_counts(df, label)
    if len(n) < 2:
        return df
    small = min(n, key=lambda c: (n[c], c))
    dealt, found = stratified_folds(df, label, key, folds, seed), []
    for fold in range(folds):
        forest = models.fit(dealt.where(F.col("fold") != fold), features, "randomforest", key=key, n_estimators=n_estimators, class_weight=False, seed=seed)
        held = forest.predict_proba(dealt.where(F.col("fold") == fold))
        found.append(held.select(key, label, F.get(F.array(*[F.col(f"p_{c}") for c in range(forest.n_classes)]), F.col(label).cast("int")).alias("_p")))
    told = found[0]
    for more in found[1:]:
        told = told.unionByName(more)
    limits = {c: 1.0 - n[small] / n[c] for c in n if c != small}
    least = F.lit(None).cast("double")
    told = models.written(told)
    for c, level in quantiles(told, label, "_p", limits).items():
        least = F.when(F.col(label) == c, F.lit(level)).otherwise(least)
    stay = told.where(least.isNull() | (F.col("_p") >= least)).select(key)
    return df.join(stay, key, "left_semi")


def svm_smote(df: DataFrame, features: Sequence[str], *, key: str = "match_id", k: int = 5, label: str = "label", seed: int = 0) -> DataFrame:
    """Adds made rows to the smaller classes until all are as large as the largest.

    Seeds are a class's rows within the margin of a linear support-vector machine of it against the rest (all rows
    if there are none). Each seed makes equally many rows, and those first in an order that only key and ``seed`` decide one more; their places
    are counted by slices of the order. A made row lies between a seed and one of its k nearest rows of the class; which, and
    where, is decided by a hash of the seed's key, its turn and ``seed``, so reruns agree. Made rows
    have negative keys; columns that are neither features, key nor label are null. A class of one row makes none, as it has no neighbour.
    """
    n = class_counts(df, label)
    most, out = max(n.values(), default=0), df
    smaller = [c for c in n if n[c] < most]
    if not smaller:
        return df
    packed = models.written(_vectors(df, features))
    rows = packed.select(F.col("_vector").alias("x"), F.col(label).cast("int").alias("label"), F.lit(1.0).alias("weight"), F.lit(0).alias("fold"))
    machines = kernels.fit_machines(rows, len(features), int(max(n)) + 1, 0, 1.0, models.written)
    for taken, c in enumerate(smaller, 1):
        own = packed.where(F.col(label) == c)
        seeds = own.where(kernels.margin(F.col("_vector"), machines.weights[int(c)]) < 1.0).select(key, "_vector", label)
        n_seeds = seeds.count()
        if not n_seeds:
            seeds, n_seeds = own.select(key, "_vector", label), n[c]
        pairs = neighbours.nearest(own, seeds, k, key=key, vector="_vector", label=label)
        near = pairs.join(own.select(F.col(key).alias("neighbour"), F.col("_vector").alias("_other")), "neighbour").groupBy(F.col("query").alias(key)).agg(F.sort_array(F.collect_list(F.struct("rank", "_other"))).alias("_near"))
        each, more = divmod(most - n[c], n_seeds)
        turns = F.lit(each) + (F.col("_at") < more).cast("int")
        dealt = shuffled_places(seeds, label, key, "_at", seed).where(turns > 0).withColumn("_turn", F.explode(F.sequence(F.lit(0), turns - 1))).join(near, key)
        mixed = F.xxhash64(F.lit(seed), F.col(key), F.col("_turn"))
        at = (F.pmod(F.shiftright(mixed, 20), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("u")
        made = dealt.select(label, "_vector", F.get("_near", F.pmod(mixed, F.size("_near")).cast("int"))["_other"].alias("_other"), at, (F.col("_at") + F.col("_turn") * n_seeds).alias("_i"))
        value = lambda i: F.get("_vector", F.lit(i)) + F.col("u") * (F.get("_other", F.lit(i)) - F.get("_vector", F.lit(i)))
        columns = {f: value(i).cast(df.schema[f].dataType) for i, f in enumerate(features)} | {key: (-(F.col("_i") * len(n) + taken)).cast(df.schema[key].dataType), label: F.col(label)}
        out = out.unionByName(made.select(*[v.alias(f) for f, v in columns.items()]), allowMissingColumns=True)
    return out


SAMPLERS: dict[str, Callable[..., DataFrame]] = {"nearmiss": near_miss, "instance-hardness-threshold": instance_hardness, "svm-smote": svm_smote}


def resample(df: DataFrame, features: Sequence[str], sampler: str | None, *, key: str = "match_id", seed: int = 0) -> DataFrame:
    """For training rows only, after scaling. None does nothing; another name is an error."""
    if sampler is None:
        return df
    if sampler not in SAMPLERS:
        raise ValueError(f"no sampler {sampler}")
    return SAMPLERS[sampler](df, features, key=key, seed=seed)
