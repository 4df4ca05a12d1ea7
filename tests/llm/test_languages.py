"""Language profiles against plain sums of bound letters, held-out accuracy, and edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow.llm import languages as L

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"


def plain(text):
    """The bundle of one text, n-gram by n-gram."""
    s = [0]
    for c in text.lower():
        if c.isalpha():
            s.append(ord(c))
        elif s[-1]:
            s.append(0)
    if len(s) == 1:
        return np.zeros(L.DIMENSIONS, np.int64)
    if s[-1]:
        s.append(0)
    out = np.zeros(L.DIMENSIONS, np.int64)
    for a, b, c in zip(s, s[1:], s[2:]):
        out += np.roll(L._letter(a), 2) * np.roll(L._letter(b), 1).astype(np.int64) * L._letter(c)
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    stems = {"aa": ["thon", "hed", "erin", "the"], "bb": ["ñoja", "cion", "lla", "el"], "cc": ["sch", "über", "ung", "der"]}
    out = [(i, " ".join(rnd.choices(stems[lang], k=rnd.randint(1, 60))).capitalize() + rnd.choice(".!\n,"), lang, "x", "y") for i in range(90) for lang in [rnd.choice(sorted(stems))]]
    return out + [(200, None, "aa", "x", "y"), (201, "", "aa", "x", "y"), (202, "12 .. !?", "bb", "x", "y"), (203, "The hed", None, None, None), (203, "The hed", None, None, None), (None, "ung der", "cc", "x", "y"), (204, "é", None, "x", "y"), (205, "the hed " * 9_000, "aa", "x", "y")]


def test_bundles_equal_plain_sums(monkeypatch):
    texts = ["The hed, ñoja", None, "", "x", "a1b2c3 " * 30, "ÀÉ ßü\tİ", "一二 三四", "12"]
    want = [plain(t or "") for t in texts]
    for symbols, grams, table in ((1 << 19, 4_096, 1 << 22), (16, 4_096, 1 << 22), (16, 3, 1)):
        monkeypatch.setattr(L, "SYMBOLS", symbols)
        monkeypatch.setattr(L, "GRAMS", grams)
        monkeypatch.setattr(L, "TABLE", table)
        assert (L.bundle(texts, np.arange(len(texts)), len(texts)) == np.array(want)).all()
        assert (L.bundle(texts, np.arange(len(texts)) % 2, 2) == np.array([sum(want[::2]), sum(want[1::2])])).all()


@pytest.mark.parametrize("block", [256, 2])
def test_language_id_equals_brute_force(spark, rows, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)  # 2: three languages take several passes
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 4 == 2
    proto = {}
    for i, t, lang, *_ in rows:
        if lang and not held(i):
            proto[lang] = proto.get(lang, 0) + plain(t or "")
    want = []
    for i, t, *_ in rows:
        v = plain(t or "")
        if not v.any():
            want.append((i, held(i), "und", 0.0))
            continue
        cos = {k: round(float(v @ p / np.linalg.norm(v.astype(float)) / np.linalg.norm(p.astype(float))), 9) for k, p in proto.items()}
        best = min(cos, key=lambda k: (-cos[k], k))
        want.append((i, held(i), best, max(0.0, cos[best])))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = [(r[0], r[1], r[2], round(r[3], 9)) for r in L.language_id(df, "doc_id", "text", "lang").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    right = {i: lang for i, t, lang, *_ in rows if lang}
    assert np.mean([p == right[i] for i, h, p, _ in got if h and right.get(i) and p != "und"]) >= 0.95


def test_nothing_learned_and_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = L.language_id(df.withColumn("lang", F.lit(None).cast("string")), "doc_id", "text", "lang").collect()
    assert len(got) == len(rows) and {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert L.language_id(df.limit(0), "doc_id", "text", "lang").count() == 0
    told = L.predict_language(df, "text", L.profiles(df, "text", "lang"))
    assert sorted(told.columns) == sorted(df.columns) and told.count() == len(rows)
