"""Every place of every template: texts put together from templates and other words, whose places are known."""

import random

from pitchflow.llm import licenses


def composed(rnd, drop):
    """A text's words and (name, first, last, words kept) of each template in it."""
    filler = [f"word{i}" for i in range(500)]
    words, placed = rnd.choices(filler, k=rnd.randint(0, 80)), []
    for _ in range(rnd.randint(0, 4)):
        name = rnd.choice([n for n in licenses.TEMPLATES if n not in ("bsd-2-clause",)])
        own = licenses.words_of(licenses.TEMPLATES[name])
        gone = set(rnd.sample(range(1, len(own) - 1), int(drop * len(own))))
        kept = [w for i, w in enumerate(own) if i not in gone]
        placed.append((name, len(words), len(words) + len(kept) - 1, len(kept)))
        words += kept + rnd.choices(filler, k=rnd.choice([0, 3, 900]))
    return words, placed


def test_every_whole_copy_is_told_where_it_is(spark):
    rnd = random.Random(5)
    made = [composed(rnd, 0) for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, (w, _) in enumerate(made)] + [(99, None), (99, None)], "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["license"], r["first_word"], r["last_word"], r["coverage"]) for r in licenses.license_scan(df, "doc_id", "text").where("license is not null").collect())
    assert got == sorted((i, name, first, last, 1.0) for i, (_, placed) in enumerate(made) for name, first, last, _ in placed)
    empty = [i for i, (_, placed) in enumerate(made) if not placed]
    assert sorted(r[0] for r in licenses.license_scan(df, "doc_id", "text").where("license is null").select("doc_id").collect()) == sorted([*empty, 99, 99])


def test_two_copies_far_apart():
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.MIN_COVERAGE).scan
    mit = licenses.words_of(licenses.TEMPLATES["mit"])
    got = scan(" ".join([*mit, *["x"] * 900, *mit]))
    assert [(g[0], g[3], g[4]) for g in got] == [("mit", 0, len(mit) - 1), ("mit", len(mit) + 900, 2 * len(mit) + 899)]


def test_copies_with_words_left_out():
    """Edited copies are found about where they are; no template is told that is not there, none twice in a place."""
    rnd = random.Random(6)
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.MIN_COVERAGE).scan
    n_placed = n_found = 0
    for _ in range(40):
        words, placed = composed(rnd, 0.05)
        got = scan(" ".join(words))
        n_placed += len(placed)
        for name, _, matched, first, last in got:
            near = [p for p in placed if p[0] == name and p[1] <= last and first <= p[2]]
            assert near and matched <= near[0][3] + sum(p[3] for p in near[1:])
            n_found += 1
    assert n_found == n_placed
