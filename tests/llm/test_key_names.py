"""Keys named like the columns that an operator adds."""

import pytest

from pitchflow.llm import near_vectors, packing, queries, simhash, substrings


@pytest.mark.parametrize("name", ["piece", "Offset", "fingerprint", "n_words", "doc", "text_", "kept"])
def test_a_key_may_have_any_name(spark, name):
    rows = [(i, f"some words {i} of a text " * (i + 1)) for i in range(4)] + [(None, None)]
    df = spark.createDataFrame(rows, f"`{name}` long, text string")
    packed = packing.pack_documents(df, name, "text", queries.tokenizer_path())
    made = {"packed": packed, "simhash": simhash.simhash_components(df, name, "text"), "substrings": substrings.substring_dedup(df, name, "text")}
    for out in made.values():
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        key = next(c for c in out.columns if c.lstrip("_").lower() == name.lower() and (c.startswith("_") or c == name))
        assert {r[key] for r in out.select(key).collect()} == {0, 1, 2, 3, None}
    assert ("_piece" in packed.columns) == (name == "piece") and ("_Offset" in packed.columns) == (name == "Offset")


def test_vectors_of_a_clashing_key(spark):
    df = spark.createDataFrame([(i, [1.0, float(i == 3)], 1) for i in range(4)], "kept long, v array<double>, label int")
    got = {r["_kept"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df, "kept", "v", "label").collect()}
    assert got == {0: (2, 0, True), 1: (2, 0, False), 2: (2, 0, False), 3: (0, 3, True)}
