"""The registered queries on the smallest tables: against their SQL, or against plain code where SQL cannot express them."""

import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from pitchflow.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def plain(value):
    return round(value, 9) if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()), key=repr)
    assert got == want


def test_token_counts(spark, docs):
    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = sorted(tuple(r) for r in queries.op4_token_counts(spark, SF).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    counts = [(d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in docs]
    assert got == sorted((*c, c[2] > 512) for c in counts)


def test_packing(spark, docs):
    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs}
    rows = queries.op2_packing(spark, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in rows if r["piece"] == 0) == sorted((d, 0, next(r["length"] for r in rows if r["doc_id"] == d and r["piece"] == 0)) for d in ids)
    for r in rows:
        assert zlib.crc32(np.asarray(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))


def test_near_vectors(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding, label FROM embeddings ORDER BY vec_id").fetchall()
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([-1 - i if r[2] is None else r[2] for i, r in enumerate(rows)])
    near = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    component = np.arange(len(rows))
    for _ in rows:
        component = np.minimum(component, np.where(near, component[None, :], len(rows)).min(axis=1))
    got = sorted(tuple(r) for r in queries.op5_near_vectors(spark, SF).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == [(r[0], int(near[i].sum()), rows[component[i]][0], component[i] == i) for i, r in enumerate(rows)]


def test_simhash(spark, docs):
    prints = {}
    for d, t in docs:
        words = (t or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    component = {d: d for d in prints}
    for _ in range(20):
        component = {a: min(component[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3) for a in prints}
    got = sorted(tuple(r) for r in queries.op7_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect())
    assert got == sorted((d, f"{prints[d]:016x}", component[d]) for d in prints)


def test_substrings(spark, docs):
    seen, want = set(), []
    for d, t in docs:
        w = (t or "").encode().split()
        cover = bytearray(len(w))
        for i in range(len(w) - 19):
            if (key := tuple(w[i : i + 20])) in seen:
                cover[i : i + 20] = b"\1" * 20
            seen.add(key)
        kept = [x for x, c in zip(w, cover) if not c]
        want.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    assert sorted(tuple(r) for r in queries.op10_substring_dedup(spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == sorted(want)


def test_language_id(spark, duck):
    rows = queries.op11_language_id(spark, SF).collect()
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.95
