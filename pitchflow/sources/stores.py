"""Leagues and trained models in folders, each with an index that is kept in step with what is there."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitchflow.operators import cleaning, form, models, scaling
from pitchflow.operators.training import Trained


@dataclass(frozen=True)
class League:
    """A catalog league and the user's choices for it."""

    country: str
    name: str
    start_year: int
    category: str
    url: str
    fixture: str | None = None
    league_id: str | None = None
    history_window: int = 10
    goal_diff_margin: int = 2
    statistics: tuple[str, ...] = form.BASIC
    odd_1: tuple[float | None, float | None] = (None, None)
    odd_x: tuple[float | None, float | None] = (None, None)
    odd_2: tuple[float | None, float | None] = (None, None)

    def with_choices(self, **choices: Any) -> League:
        """A copy; a start year before the catalog's becomes the catalog's."""
        if "start_year" in choices:
            choices["start_year"] = max(int(choices["start_year"]), self.start_year)
        return replace(self, **choices)

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)

    @staticmethod
    def from_row(row: Row | dict[str, Any]) -> League:
        known = {k: v for k, v in (row.asDict() if isinstance(row, Row) else row).items() if k in League.__dataclass_fields__ and v is not None}
        return League(**{k: tuple(v) if isinstance(v, list) else v for k, v in known.items()})


class _Folder:
    """File operations on any file system that Spark reads.

    What is stored is versioned: a new version is written beside the old one and takes effect when a small file that
    names it is renamed into place, in one step. Whoever reads sees the version before or the one after. Of two
    versions of one number the rename of the second fails. What a crash leaves behind no reader sees; the next commit clears it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str) -> tuple[Any, Any]:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def exists(self, path: str) -> bool:
        system, place = self._at(path)
        return system.exists(place)

    def delete(self, path: str) -> None:
        system, place = self._at(path)
        system.delete(place, True)

    def _names(self, path: str) -> list[str]:
        system, place = self._at(path)
        return [x.getPath().getName() for x in system.listStatus(place)] if system.exists(place) else []

    def versions(self, path: str) -> list[int]:
        """Numbers of the committed versions, in order."""
        return sorted(int(x[1:]) for x in self._names(path) if x[0] == "v" and x[1:].isdigit())

    def read_json(self, path: str) -> dict[str, Any]:
        """The newest version's value; nothing if there is none."""
        found = self.versions(path)
        return json.loads(self._text(f"{path}/v{found[-1]}")) if found else {}

    def _text(self, path: str) -> str:
        system, place = self._at(path)
        stream = system.open(place)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_json(self, path: str, value: dict[str, Any], keep: int = 2) -> int:
        """Commits a small value as the next version, then clears all but the newest ``keep``; its number."""
        number = (self.versions(path) or [0])[-1] + 1
        draft = f"{path}/draft-{uuid.uuid4().hex}"
        system, place = self._at(draft)
        stream = system.create(place, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        target = self._at(f"{path}/v{number}")[1]
        if system.exists(target) or not system.rename(place, target):
            system.delete(place, False)
            raise RuntimeError(f"version {number} of {path} was committed by another writer")
        for old in self.versions(path)[:-keep]:
            self.delete(f"{path}/v{old}")
        return number


class LeagueStore(_Folder):
    """Tables of leagues below ``root``/<league id>, and an index of what each league is.

    A league's manifest names for each season the folder that holds it. Saving writes new folders and then commits a manifest:
    replaced seasons go with it, and a save that breaks off changes nothing.
    """

    INDEX = "leagues-index"

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        found = self.read_json(self.INDEX)
        self.index: dict[str, League] = {k: League.from_row(v) for k, v in found.items() if self.versions(f"{k}/manifest")}
        if len(self.index) < len(found):
            self._save_index()

    def _save_index(self) -> None:
        self.write_json(self.INDEX, {k: v.as_dict() for k, v in self.index.items()})

    def ids(self) -> list[str]:
        return sorted(self.index)

    def has(self, league_id: str) -> bool:
        return league_id in self.index

    def save(self, df: DataFrame, league: League, *, keep_older: bool = False) -> None:
        """Replaces the league's table, or with ``keep_older`` only the seasons in ``df``, then enters the league in the index."""
        at, batch = league.league_id, f"table/{uuid.uuid4().hex}"
        df.write.partitionBy("season").parquet(f"{self.root}/{at}/{batch}")
        made = {x.removeprefix("season="): f"{batch}/{x}" for x in self._names(f"{at}/{batch}") if x.startswith("season=")}
        old = self.read_json(f"{at}/manifest").get("seasons", {}) if keep_older else {}
        self.write_json(f"{at}/manifest", {"seasons": old | made, "schema": df.schema.json()})
        self._clear(at)
        self.index[at] = league
        self._save_index()

    def _clear(self, league_id: str) -> None:
        """Deletes batches that no kept manifest names: readers of the version before still find theirs."""
        kept = {folder.split("/")[1] for v in self.versions(f"{league_id}/manifest") for folder in json.loads(self._text(f"{league_id}/manifest/v{v}"))["seasons"].values()}
        for name in self._names(f"{league_id}/table"):
            if name not in kept:
                super().delete(f"{league_id}/table/{name}")

    def load(self, league_id: str) -> DataFrame | None:
        """The league's table; if it is gone its entry goes too, and None comes back."""
        manifest = self.read_json(f"{league_id}/manifest")
        if not manifest:
            if self.index.pop(league_id, None):
                self._save_index()
            return None
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        if not manifest["seasons"]:
            return self.spark.createDataFrame([], schema)
        by_batch: dict[str, list[str]] = {}
        for folder in manifest["seasons"].values():
            by_batch.setdefault(folder.rpartition("/")[0], []).append(f"{self.root}/{league_id}/{folder}")
        tables = [self.spark.read.schema(schema).option("basePath", f"{self.root}/{league_id}/{batch}").parquet(*folders) for batch, folders in by_batch.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)

    def delete(self, league_id: str) -> None:  # type: ignore[override]
        """Table, models below it, and the entry."""
        super().delete(league_id)
        if self.index.pop(league_id, None):
            self._save_index()

    def create(self, league: League, fetch: Callable[[League, int], DataFrame | None]) -> DataFrame | None:
        """Fetches all seasons, cleans, adds statistics, saves; None if nothing is there."""
        raw = fetch(league, league.start_year)
        if raw is None:
            return None
        self.save(build(raw, league, league.start_year), league)
        return self.load(league.league_id)

    def update(self, league_id: str, fetch: Callable[[League, int], DataFrame | None]) -> DataFrame | None:
        """Fetches the newest stored season and later ones again, with statistics of these only (they begin anew
        each season), and keeps what is older. If nothing can be fetched the table stays as it is."""
        history, league = self.load(league_id), self.index.get(league_id)
        if history is None or league is None:
            return None
        newest = history.agg(F.max("season")).first()[0]
        raw = fetch(league, newest)
        if raw is not None:
            self.save(build(raw, league, newest), league, keep_older=True)
        return self.load(league_id)


def check_year(league: League, start_year: int) -> None:
    if start_year < league.start_year:
        raise ValueError(f"{league.name} begins in {league.start_year}, not in {start_year}")


def build(raw: DataFrame, league: League, start_year: int) -> DataFrame:
    """Raw seasons -> cleaned matches -> statistics -> odds ranges, as one plan."""
    check_year(league, start_year)
    extended = league.category == "main" and any(s in form.EXTRA for s in league.statistics)
    columns = [*cleaning.BASE, *(cleaning.EXTENDED if extended else ())]
    projected = (cleaning.from_main(raw) if league.category == "main" else cleaning.from_extra(raw, start_year)).select(*columns)
    matches = cleaning.clean(projected, start_year, extended=extended)
    with_form = form.team_form(matches, league.statistics, n=league.history_window, margin=league.goal_diff_margin)
    return form.newest_first(cleaning.odds_between(with_form, odd_1=league.odd_1, odd_x=league.odd_x, odd_2=league.odd_2))


class ModelStore(_Folder):
    """Models below ``root``/<league id>/models/<model id>, and an index of their configurations."""

    INDEX = "models-index"

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        found = self.read_json(self.INDEX)
        self.index: dict[str, dict[str, dict[str, Any]]] = {}
        for league_id, entries in found.items():
            alive = {m: c for m, c in entries.items() if self.exists(self.path(league_id, m))}
            if alive:
                self.index[league_id] = alive
        if self.index != found:
            self.write_json(self.INDEX, self.index)

    @staticmethod
    def path(league_id: str, model_id: str) -> str:
        return f"{league_id}/models/{model_id}"

    def ids(self, league_id: str) -> list[str]:
        return sorted(self.index.get(league_id, {}))

    def has(self, league_id: str, model_id: str) -> bool:
        return model_id in self.index.get(league_id, {})

    def save(self, trained: Trained | None, league_id: str, model_id: str) -> None:
        """The model with its fitted scaler; a model that is not fitted is an error."""
        if trained is None:
            raise ValueError("the model is not fitted")
        trained.classifier.save(f"{self.root}/{self.path(league_id, model_id)}")
        config = {"league_id": league_id, "model_id": model_id, "target": trained.target, "features": trained.features, "key": trained.key, "scaler": trained.scaler and asdict(trained.scaler), **trained.classifier.config}
        self.index.setdefault(league_id, {})[model_id] = config
        self.write_json(self.INDEX, self.index)

    def load(self, league_id: str, model_id: str) -> tuple[Trained | None, dict[str, Any] | None]:
        """Model and configuration; if the folder is gone the entry goes too, and two Nones come back."""
        config = self.load_config(league_id, model_id)
        if config is None:
            return None, None
        scaler = scaling.Scaler(**config["scaler"]) if config["scaler"] else None
        return Trained(models.Classifier.load(self.spark, f"{self.root}/{self.path(league_id, model_id)}"), config["target"], config["features"], scaler, config["key"]), config

    def load_config(self, league_id: str, model_id: str) -> dict[str, Any] | None:
        if not self.exists(self.path(league_id, model_id)):
            self._forget(league_id, model_id)
            return None
        return self.index.get(league_id, {}).get(model_id)

    def update_config(self, config: dict[str, Any]) -> None:
        self.index.setdefault(config["league_id"], {})[config["model_id"]] = config
        self.write_json(self.INDEX, self.index)

    def delete_model(self, league_id: str, model_id: str) -> None:
        self.delete(self.path(league_id, model_id))
        self._forget(league_id, model_id)

    def delete_league(self, league_id: str) -> None:
        self.delete(f"{league_id}/models")
        for m in self.ids(league_id):
            self._forget(league_id, m)

    def _forget(self, league_id: str, model_id: str) -> None:
        entries = self.index.get(league_id, {})
        if entries.pop(model_id, None) is not None:
            if not entries:
                del self.index[league_id]
            self.write_json(self.INDEX, self.index)


def catalog_leagues(catalog: DataFrame) -> list[League]:
    """The catalog's leagues, a short stated list, by country and name."""
    return [League.from_row(r) for r in catalog.orderBy("country", "name").collect()]


def fixture_row(spark: SparkSession, match_date: str, home: str, away: str, odds: Sequence[float]) -> DataFrame:
    """One fixture from its values."""
    return spark.createDataFrame([(match_date, home, away, *map(float, odds))], "match_date string, home string, away string, odd_1 double, odd_x double, odd_2 double").withColumn("match_date", F.to_date("match_date"))
