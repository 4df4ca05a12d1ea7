"""Scalers fitted by one aggregate and applied as expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("min-max", "max-abs", "standard")


@dataclass(frozen=True)
class Scaler:
    """value -> (value - shift) / scale for each column; a scale of 0 counts as 1."""

    kind: str
    shift: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(self.shift[c])) / F.lit(self.scale[c] or 1.0) for c in self.shift})

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Scaler:
        return Scaler(**json.loads(text))


def statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: minimum, maximum, largest absolute value, mean and population deviation."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns]))
    return df.select(each.alias("x")).groupBy("x.feature").agg(F.min("x.v").alias("low"), F.max("x.v").alias("high"), F.max(F.abs("x.v")).alias("largest"), F.avg("x.v").alias("mean"), F.stddev_pop("x.v").alias("deviation"))


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str) -> Scaler:
    """Reads one row per column back, whatever the number of rows."""
    if kind not in KINDS:
        raise ValueError(f"no scaler {kind}")
    rows = {r["feature"]: r for r in statistics(df, columns).collect()}
    part = {"min-max": lambda r: (r["low"], r["high"] - r["low"]), "max-abs": lambda r: (0.0, r["largest"]), "standard": lambda r: (r["mean"], r["deviation"])}[kind]
    got = {c: part(rows[c]) if c in rows and rows[c]["low"] is not None else (0.0, 1.0) for c in columns}
    return Scaler(kind, {c: v[0] for c, v in got.items()}, {c: v[1] for c, v in got.items()})


def scale(df: DataFrame, columns: Sequence[str], scaler: str | Scaler | None) -> tuple[DataFrame, Scaler | None]:
    """A name fits and applies a new scaler; a fitted one is only applied; None does nothing."""
    if scaler is None:
        return df, None
    fitted = fit_scaler(df, columns, scaler) if isinstance(scaler, str) else scaler
    return fitted.transform(df), fitted
