"""Windows, passes and parts of phrase mining: each occurrence counts once, and only frequent phrases are told."""

import random
from collections import Counter

import numpy as np
import pytest

from pitchflow.llm import phrases as P
from pitchflow.llm.tables import Scratch, materialize


def mined(r, context, least):
    at, left, right, end = P.windows(r, context)
    n = left.astype(np.int64) + right + 1
    assert len(at) <= len(r)  # at most a window for each word
    got = Counter()
    for x in P.passes(left, right, end, r[P._spread(at - left, n)]):
        for found, counts in P.mined(*x, least):
            for p, c in zip(found.tolist(), counts.tolist()):
                assert c >= least and tuple(p) not in got
                got[tuple(p)] = c
    return got


@pytest.mark.parametrize("pass_", [1 << 19, 300, 20])
@pytest.mark.parametrize("context", [0, 3])
@pytest.mark.parametrize("least", [1, 6])
def test_every_occurrence_counts_once(monkeypatch, pass_, context, least):
    monkeypatch.setattr(P, "PASS", pass_)  # small passes divide even one word's windows
    rnd = random.Random(3)
    r = np.array([rnd.choice([0, 0, 0, 0, 1, 1, 2, 3, 4, 5, 6, P.NONE]) for _ in range(2_000)], np.int64)
    r[:context] = 0
    want = Counter()
    for k in range(2, 6):
        for i in range(len(r) - k + 1):
            p = tuple(r[i : i + k].tolist())
            if P.NONE not in p and i + k - 1 >= context:
                want[p] += 1
    assert mined(r, context, least) == {p: c for p, c in want.items() if c >= least}


def test_parts_tell_frequent_phrases_only(spark, monkeypatch):
    """The rows that tasks tell are as many as the phrases asked for; nothing is told that is rare in the corpus."""
    rnd, told, counted = random.Random(1), [], P.counted
    rows = [(" ".join(rnd.choices([f"w{i}" for i in range(40)], k=200)), "en") for _ in range(60)]

    def kept(*x):
        told.append(materialize(counted(*x), "told"))
        return told[-1]

    monkeypatch.setattr(P, "counted", kept)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    phrases = P.frequent_phrases(df, "text", "lang", 5, Scratch(spark))[1]
    assert told[0].count() == phrases.count() > 1_000
    assert told[0].where("n < 5").count() == 0
