"""Phrases against brute force: whole results with shards of every size, bitmaps in pure Python, and edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pitchflow.llm import phrases as P

SCHEMA = "doc_id long, text string, lang string, score string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", low)]


def plain(rows, least, top):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f.setdefault(lang, Counter())[tuple(ws[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and counts[p[i:j]] <= a}
        told = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                told.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(told)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    words = ["The", "of", "and", "a", "é", "x\x1cy", *(f"w{i}" for i in range(25))]
    out = []
    for i in range(120):
        ws = rnd.choices(words, weights=[30, 20, 10, 10, 5, 5, *[1] * 25], k=rnd.randint(0, 60))
        text = "".join(w + rnd.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\r", "!?"]) for w in ws)
        out.append((i, text + rnd.choice(["", "One long shared passage of many words here. "]) * rnd.randint(0, 2), rnd.choice(["en", "en", "en", "de", None, "und"]), "s"))
    return out + [(500, None, "en", "s"), (501, "", None, "s"), (502, " .,\n", "fr", "s"), (503, "a " * 700, "en", "s"), (503, "a " * 700, "en", "s"), (None, "to be or not to be " * 40, "en", None)]


@pytest.mark.parametrize(("positions", "open_", "top"), [(1 << 20, 4, 2_000), (50, 4, 2_000), (11, 1, 7)])
def test_collocations_equal_brute_force(spark, rows, monkeypatch, positions, open_, top):
    monkeypatch.setattr(P, "POSITIONS", positions)  # small shards cut pieces and long texts
    monkeypatch.setattr(P, "OPEN", open_)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in P.collocations(df, "text", "lang", least=8, top=top).select(COLUMNS).collect())
    assert got == plain(rows, 8, top)


def test_popcounts_of_bitmaps(monkeypatch):
    """The miner on bitmaps of one shard, with and without context, however few blocks it extends at once."""
    rnd = random.Random(2)
    ids = np.array([rnd.choice([0, 0, 0, 1, 2, 3, 4]) for _ in range(900)], np.int64)
    starts = np.array([rnd.random() < 0.1 for _ in ids])
    for context in (0, 4):
        starts[0] = context == 0
        maps = P.bitmaps(ids, starts, context)
        want = Counter()
        for k in range(2, 6):
            for i in range(len(ids) - k + 1):
                if not starts[i + 1 : i + k].any() and i + k - 1 >= context:
                    want[tuple(ids[i : i + k].tolist())] += 1
        for at_once in (1 << 17, 40, 1):
            monkeypatch.setattr(P, "AT_ONCE", at_once)
            miner = P.Miner(np.repeat(np.arange(5), maps["blocks"]), maps["block"], maps["bits"], maps["starts"], maps["own"])
            got = Counter()
            for found, counts in miner.mine(np.arange(5)[:, None], *miner.singles, 5):
                for p, n in zip(found.tolist(), counts.tolist()):
                    assert tuple(p) not in got
                    got[tuple(p)] = n
            assert +got == want
        assert maps["counts"].tolist() == np.bincount(ids[context:], minlength=5).tolist()


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, part = 10**14, 9 * 10**15, 3 * 10**14
    score = spark.range(1).select(F.lit(a).alias("a"), F.lit(n).alias("n"), F.lit(part).alias("l"), F.lit(part + 1).alias("r")).select(P.score()).first()[0]
    assert score == 1000 * a * n // (part * (part + 1))


def test_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert P.collocations(df.limit(0), "text", "lang").count() == 0
    assert P.collocations(df, "text", "lang", least=10**6).count() == 0
