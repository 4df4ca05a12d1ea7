"""Language ID by hyperdimensional profiles: letters are random vectors, n-grams bind them, texts and languages bundle n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchflow.llm.tables import fresh, materialize

#: Dimensions of a vector, letters of an n-gram, seed of the letters' vectors.
DIMENSIONS, LETTERS, SEED = 1_024, 3, 7
#: Languages whose prototypes a task holds at once; more are compared in further passes.
BLOCK = 256
#: Letters and texts bundled at once; n-grams whose vectors are held at once. They bound memory, not the work.
SYMBOLS, TEXTS, GRAMS = 1 << 19, 256, 4_096
#: N-grams of so few letters are found by a table, others by sorting; both give the same.
TABLE = 1 << 22
#: Columns of one sum of profiles, and rows that share the sums of a language before the last step.
WIDTH, SALTS = 64, 32
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=65_536)
def _letter(code: int) -> np.ndarray:
    """A letter's vector of 1 and -1, the same in every task. Code 0 stands for what lies between words."""
    return np.random.default_rng([SEED, code]).choice(np.array([-1, 1], np.int8), DIMENSIONS)


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, with one 0 for each stretch of anything else and at both ends; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.empty(0, np.uint32)
    codes = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(np.uint32)
    return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]


def _runs(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols of many texts and the text of each n-gram's start (-1: it would cross texts), in runs of bounded size.

    A long text goes through several runs that overlap by one letter less than an n-gram, so that none of its n-grams is lost.
    """
    parts, owners, held = [], [], 0

    def run() -> tuple[np.ndarray, np.ndarray]:
        owner = np.concatenate(owners)
        starts = owner[: len(owner) - LETTERS + 1]
        return np.concatenate(parts), np.where(starts == owner[LETTERS - 1 :], starts, -1)

    for i, text in enumerate(texts):
        found = symbols(text) if text else np.empty(0, np.uint32)
        for at in range(0, max(len(found) - LETTERS + 1, 0), SYMBOLS):
            part = found[at : at + SYMBOLS + LETTERS - 1]
            if parts and held + len(part) > SYMBOLS:
                yield run()
                parts, owners, held = [], [], 0
            parts.append(part)
            owners.append(np.full(len(part), i))
            held += len(part)
    if parts:
        yield run()


def bundle(texts: list[str | None], groups: np.ndarray, n_groups: int) -> np.ndarray:
    """The sums of the n-gram vectors of all texts of each group: whole numbers, so no order of the sums changes them."""
    out = np.zeros((n_groups, DIMENSIONS), np.int64)
    for codes, owner in _runs(texts):
        places = np.zeros(int(codes.max()) + 1, np.int64)
        places[codes] = 1
        known = np.flatnonzero(places)
        places[known] = np.arange(len(known))
        places = places[codes]
        base = len(known)
        n = len(owner)
        key = np.zeros(n, np.int64)
        for k in range(LETTERS):
            key = key * base + places[k : k + n]
        inside = owner >= 0
        key, group = key[inside], groups[owner[inside]]
        if base**LETTERS <= TABLE:
            seen = np.zeros(base**LETTERS, np.int64)
            seen[key] = 1
            grams = np.flatnonzero(seen)
            seen[grams] = np.arange(len(grams))
            which = seen[key]
        else:
            grams, which = np.unique(key, return_inverse=True)
        here = np.flatnonzero(np.bincount(group, minlength=n_groups))
        row = np.zeros(n_groups, np.int64)
        row[here] = np.arange(len(here))
        row = row[group]
        letters = np.stack([_letter(c) for c in known.tolist()])
        turned = [np.roll(letters, LETTERS - 1 - k, axis=1) for k in range(LETTERS)]
        for at in range(0, len(grams), GRAMS):
            some = grams[at : at + GRAMS]
            vectors = np.ones((len(some), DIMENSIONS), np.int8)
            for k in range(LETTERS):
                vectors *= turned[k][some // base ** (LETTERS - 1 - k) % base]
            cells = row * len(some) + which - at
            if len(grams) > GRAMS:
                cells = cells[(which >= at) & (which < at + len(some))]
            counts = np.bincount(cells, minlength=len(here) * len(some)).reshape(len(here), len(some))
            # sums stay below 2 ** 24, so single precision holds them exactly
            out[here] += np.rint(counts.astype(np.float32) @ vectors.astype(np.float32)).astype(np.int64)
    return out


def profiles(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang``, ``part``, ``sums``: each language's bundled profile, in parts of ``WIDTH`` numbers. Null languages are left out.

    A task sends one sum per language it has seen; these are added in two steps, so a language that
    most documents have meets in no single task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, names = batch.column(1).to_pylist(), {}
            places = np.array([names.setdefault(x, len(names)) for x in langs])
            texts = batch.column(0).to_pylist()
            for at in range(0, len(names), BLOCK):
                some = list(names)[at : at + BLOCK]
                chosen = np.flatnonzero((places >= at) & (places < at + len(some)))
                sums = bundle([texts[i] for i in chosen], places[chosen] - at, len(some))
                for name, v in zip(some, sums, strict=True):
                    held[name] = held[name] + v if name in held else v
                if len(held) > BLOCK:
                    yield _told(held)
                    held = {}
        if held:
            yield _told(held)

    sums = docs.where(F.col(lang).isNotNull()).select(text, lang).mapInArrow(run, "lang string, part int, salt int, sums array<long>")
    added = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(WIDTH)]
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(WIDTH)]
    by_salt = sums.groupBy("lang", "part", "salt").agg(*added)
    return by_salt.groupBy("lang", "part").agg(*again).select("lang", "part", F.array(*[f"s{i}" for i in range(WIDTH)]).alias("sums"))


def _told(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    parts = DIMENSIONS // WIDTH
    salt = TaskContext.get().partitionId() % SALTS
    flat = pa.array(np.concatenate(list(held.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x in held for _ in range(parts)], pa.string()), pa.array(list(range(parts)) * len(held), pa.int32()), pa.array([salt] * (parts * len(held)), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, WIDTH), pa.int32()), flat)],
        names=["lang", "part", "salt", "sums"],
    )


def _block(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and unit vectors of a block's prototypes: about ``BLOCK`` languages of ``DIMENSIONS`` numbers."""
    made: dict[str, np.ndarray] = {}
    for row in rows.collect():
        made.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["part"] * WIDTH : (row["part"] + 1) * WIDTH] = row["sums"]
    names = sorted(made)
    vectors = np.array([made[x] for x in names]).reshape(len(names), DIMENSIONS)
    return names, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def predict_language(docs: DataFrame, text: str, found: DataFrame) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the language whose prototype is nearest by cosine, and that cosine, at least 0.

    ``found`` comes from ``profiles`` and is read once per block of languages: up to ``BLOCK`` languages are one block, more are
    dealt by hash, and each further block is one more pass that keeps the better answer, so any number of languages does.
    Ties (to 12 digits) go to the language that sorts first by code point. A null text, one without a letter, and every text when
    no language was learned, get ``und`` and 0. Columns of ``docs`` that have the new names give way to them.
    """
    out = fresh(docs, "lang_pred", "score").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(-2.0)})
    n = found.select("lang").distinct().count()
    n_blocks = 1 if n <= BLOCK else -(-n // (BLOCK // 2))
    for block in range(n_blocks if n else 0):
        out = _compared(out, text, *_block(found.where(F.pmod(F.xxhash64("lang"), F.lit(n_blocks)) == block)))
    return out.withColumn("score", F.greatest("score", F.lit(0.0)))


def _compared(docs: DataFrame, text: str, names: list[str], vectors: np.ndarray) -> DataFrame:
    at_text, at_pred, at_score = (docs.columns.index(c) for c in (text, "lang_pred", "score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if names else 0, TEXTS):
                batch = whole.slice(at, TEXTS)
                made = bundle(batch.column(at_text).to_pylist(), np.arange(batch.num_rows), batch.num_rows).astype(np.float64)
                length = np.linalg.norm(made, axis=1)
                cosine = np.round(made @ vectors.T / np.maximum(length, 1e-300)[:, None], 12)
                best = np.argmax(cosine, axis=1).tolist()
                columns, told = list(batch.columns), []
                for i, (old, score) in enumerate(zip(batch.column(at_pred).to_pylist(), batch.column(at_score).to_pylist(), strict=True)):
                    name, now = names[best[i]], float(cosine[i, best[i]])
                    better = length[i] > 0 and (score < -1 or now > score or now == score and name < old)
                    told.append((name, now) if better else (old, score))
                columns[at_pred], columns[at_score] = pa.array([x for x, _ in told], pa.string()), pa.array([x for _, x in told], pa.float64())
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            if not names:
                yield whole

    return docs.mapInArrow(run, docs.schema)


def held_out(key: Column) -> Column:
    """True for the quarter of the documents whose crc32 of the key's digits leaves 2 modulo 4; never learned from. A null key counts as no digits."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def language_id(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``key``, ``held_out``, ``lang_pred``, ``score`` for every document; languages are learned from those that are not held out.

    Only text and language are learned from, and only the text is looked at to predict. Rows that repeat stay, each with the
    same answer. An empty table gives no rows. Texts of any length are read whole.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    learned = materialize(profiles(rows.where(~held_out(F.col("key"))), "text", "lang"), "profiles")
    told = predict_language(rows.select("key", "text"), "text", learned)
    return told.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "lang_pred", "score")
