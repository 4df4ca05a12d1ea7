"""Every stage of the pipeline, and the whole of it, against plain code; empty tables and repeated rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from pitchflow.llm import quality, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def keeps(text):
    words = (text or "").split()
    chars = sum(map(len, words))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.split()]
    if len(words) < 50 or 100 * len(covered) > 50 * len(words):
        return False
    stop = sum(w.lower() in quality.STOP_WORDS for w in words)
    return 3 <= chars / len(words) <= 10 and sum(text.count(c) for c in quality.SYMBOLS) / chars <= 0.1 and stop / len(words) >= 0.05 and (len(lines) - len(set(lines))) / max(len(lines), 1) <= 0.5


def without_lines(rows):
    seen, out = [], []
    for d, text, lang, source, n in sorted(rows):
        kept = []
        for line in text.split("\n"):
            s = set(line.split())
            if not (s and any(5 * len(s & o) >= 4 * len(s | o) for o in seen)):
                kept.append(line)
            if s:
                seen.append(s)
        left = "\n".join(kept)
        if left.split():
            out.append((d, left, lang, source, n if left == text else len(left)))
    return out


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def one_of_each(rows):
    prints = {r[0]: fingerprint(r[1]) for r in rows}
    group = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return [r for r in rows if group[r[0]] == r[0]]


def mixed(rows):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_, rest = {}, set(sizes), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if rest * weight[s] >= 3 * sizes[s] * total}
        if not full:
            target |= {s: rest * weight[s] / total for s in open_}
            break
        # the excess of full sources goes to the others by weight
        first = min(full, key=lambda s: (3 * sizes[s] / weight[s], s is None, s or ""))
        target[first] = 3.0 * sizes[first]
        rest -= 3 * sizes[first]
        open_.discard(first)
    out = []
    for r in rows:
        rate = target[r[3]] / sizes[r[3]] if sizes[r[3]] else 0
        coin = int(hashlib.md5(f"42:{r[0]}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out += [r] * (math.floor(rate) + (coin < rate - math.floor(rate)))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    words = ["the", "of", "and", "to", *("".join(rnd.choices("abcdefgh", k=rnd.randint(3, 8))) for _ in range(300))]
    line = lambda k: " ".join(rnd.choices(words, weights=[20, 15, 10, 10, *[1] * 300], k=k))
    shared = [line(12) for _ in range(4)]
    out = []
    for i in range(60):
        text = "\n".join([line(rnd.randint(8, 30)) for _ in range(rnd.randint(3, 8))] + rnd.sample(shared, rnd.randint(0, 2)))
        out.append((i * 2, text, "en", f"s{i % 4}" if i % 9 else None))
    out += [(201, out[3][1] + " tail", "en", "s1"), (203, out[5][1], "en", "s2"), (205, "short", "en", "s1"), (207, None, "en", "s1"), (209, "", None, None), (211, line(3_000), "en", "s0"), (213, " ".join(["the same words"] * 60), "en", "s3"), (215, "### $$$ " * 60, "en", "s3")]
    # the same words in other lines: no line goes, but the texts are near copies
    near = line(400).split()
    broken = lambda ws, first: "\n".join([" ".join(ws[:first]), *(" ".join(ws[i : i + 20]) for i in range(first, len(ws), 20))])
    out += [(301, broken(near, 20), "en", "s0"), (303, broken(near, 10), "en", "s0")]
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in out]


def test_every_stage_and_the_whole_equal_plain_code(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = [[r for r in rows if keeps(r[1])]]
    for plain in (without_lines, one_of_each, mixed):
        want.append(plain(want[-1]))
    assert len(want[0]) < len(rows) and len(want[2]) < len(want[1])
    docs = spark.createDataFrame(rows, SCHEMA)
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = stage(spark, docs, str(tmp_path))
        assert sorted(map(tuple, docs.collect()), key=repr) == sorted(expected, key=repr), name
        docs = spark.createDataFrame(expected, SCHEMA).repartition(2)
    told = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = {r[0]: [*tok.encode(r[1], add_special_tokens=False).ids, 0] for r in want[-1]}
    crc = lambda x: zlib.crc32(np.asarray(x, "<u4").tobytes())
    whole = sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in told if len(ids[r["doc_id"]]) <= 2_048)
    assert whole == sorted((r[0], len(ids[r[0]]), crc(ids[r[0]])) for r in want[-1] if len(ids[r[0]]) <= 2_048)
    for r in told:
        assert crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
    assert sum(r["length"] for r in told) == sum(len(ids[r[0]]) for r in want[-1])
    spans = {}
    for r in told:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in map(sorted, spans.values()):
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 2_048


def test_empty_tables_and_repeated_rows(spark, rows, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    kept = next(r for r in rows if keeps(r[1]))
    spark.createDataFrame([kept] * 3 + [(None, *kept[1:])], SCHEMA).write.parquet(str(tmp_path / "twice" / "documents.parquet"))
    told = corpus_pipeline.run(spark, str(tmp_path / "twice"))
    assert {r["doc_id"] for r in told.collect()} == {kept[0]}  # of copies the one with the smallest key stays
