"""Prefix tries against brute force, with every way to cut the sorted table into parts, and edge cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pitchflow.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def plain(rows):
    """The nodes of the trie of rebuilt conversations, prefix by prefix."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, tries_hash(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + ts[h:]
    nodes = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    words = lambda p: len(p[-1][1].split()) if p else 0
    out = []
    for p, cs in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = lambda q: [x for x in below if len(x) == len(q) + 1 and x[:-1] == q]
        ends = ",".join(map(str, sorted(c for c in cs if len(made[c]) == len(p))))
        out.append((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(kids(p)), sum(not kids(q) for q in below), sum((len(nodes[q]) - 1) * words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def tries_hash(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[: tries.TURN]


def nodes(spark, rows, parts):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = tries.prefix_trie(tries.rebuilt(tries.ordered_turns(df, "conv_id", "turn", "role", "text")), parts)
    return sorted((tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def random_rows(seed, n):
    rnd = random.Random(seed)
    out = []
    for c in rnd.sample(range(-30, 400), n):
        for t in range(rnd.randint(0, 7)):
            out.append((c, rnd.choice([t, t, t, None]), rnd.choice(["u", "a", None]), rnd.choice(["hi", "hi you", "", None]), "x"))
    copy = [(t, "u" if t % 2 else "a", f"turn {t} of many") for t in range(6)]
    out += [(c, *x, "y") for c in range(1_000, 1_060) for x in copy]
    return out + [(1_100, t, "u", f"turn {t}", "z") for t in range(40)] + [(1_101, t, "u", f"turn {t}", "z") for t in range(40)] + [(None, 1, "u", "lost", "z"), (1_100, 3, "u", "turn 3", "z")]


@pytest.mark.parametrize("parts", [1, 2, 5, 40])
def test_trie_equals_brute_force(spark, parts):
    rows = random_rows(parts, 60)
    assert nodes(spark, rows, parts) == plain(rows)


def test_all_parts_of_one_long_prefix(spark):
    """Every seam lies inside the prefix that all share, so its nodes are all added up from shares."""
    rows = [(c, t, "u", f"same {t}" if t < 9 else f"own {c}", "x") for c in range(0, 4_000, 20) for t in range(10)]
    assert nodes(spark, rows, 12) == plain(rows)


def test_parts_agree_without_spark():
    """The sorted sequences, cut anywhere, give whole nodes and shares that add up."""
    rnd = random.Random(9)
    keys = sorted({"".join(rnd.choice("ab") * tries.TURN for _ in range(rnd.randint(0, 6))) for _ in range(40)})
    for cut in range(1, len(keys)):
        total = 0
        for some, before, after in ((keys[:cut], -1, tries.common(keys[cut - 1], keys[cut])), (keys[cut:], tries.common(keys[cut - 1], keys[cut]), -1)):
            part = tries.Part(before, after)
            for i, k in enumerate(some):
                part.add(k, [1] * (len(k) // tries.TURN), 1, i, "x", i == 0)
            part.end()
            total += sum(r[5] for r in part.out if r[4] == 0)
            assert not part.stack[1:] and {r[4] for r in part.out if r[10]} == set(range(max(before, after) + 1))
        assert total == len(keys)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tries.prefix_trie(tries.rebuilt(tries.ordered_turns(empty, "conv_id", "turn", "role", "text"))).count() == 0
    one = [(7, None, None, None, None)]
    assert nodes(spark, one, 2) == plain(one)
    long = [(40, t, "user", "word " * 3_000, None) for t in range(3)] + [(41, t, "user", "word " * 3_000, None) for t in range(4)]
    assert nodes(spark, long, 2) == plain(long)


def test_many_equal_ids_stream_in_order(spark):
    convs = spark.range(0, 30_000).select((F.col("id") * 3 - 20_000).alias("conv_id"), F.array(F.lit("a" * tries.TURN)).alias("hashes"), F.array(F.lit(2)).cast("array<long>").alias("words"))
    got = {r["depth"]: r for r in tries.prefix_trie(convs.repartition(7), 3).collect()}
    want = hashlib.sha256(",".join(str(i * 3 - 20_000) for i in range(30_000)).encode()).hexdigest()
    assert got[1]["ends_sha256"] == want and got[1]["n_convs"] == 30_000 and got[0]["saved_tokens"] == 29_999 * 2 and got[0]["n_leaves"] == 1
