"""Findings of the third review on the training-data operators: each test failed before its change."""

import numpy as np

from bourseline.llm import lines, near_dup


def test_pairs_inside_a_shared_passage_are_all_linked(spark):
    """Copies that differ in every third of their own words: the passage that all share is all that their runs have in common."""
    rng = np.random.default_rng(3)
    draw = lambda n: [f"w{i}" for i in rng.integers(0, 50_000, n)]
    shared = draw(120)
    rows = []
    for i in range(100):
        own = draw(60)
        rows.append((2 * i, own[:30] + shared + own[30:]))
        if i < 40:
            other = [w if j % 3 else f"x{i}_{j}" for j, w in enumerate(own)]
            rows.append((2 * i + 1, other[:30] + shared + other[30:]))
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(frame, similarity=0.85, crowd=8).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_a_repeated_run_does_not_change_the_other_runs(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, *words[:5]]))]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1}


def test_similar_texts_share_a_rarest_word():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = [int(x) for x in rng.integers(0, 30, rng.integers(1, 60))]
        b = list(a)
        for _ in range(near_dup.most_edits(len(a), 0.8)):
            i = int(rng.integers(0, len(b) + 1))
            b[i : i + int(rng.integers(0, 2))] = [int(x) for x in rng.integers(0, 30, rng.integers(0, 2))]
        if near_dup.similar(" ".join(map(str, a)), " ".join(map(str, b))):
            keys = [near_dup.labelled(near_dup.WordHashes().of([str(x) for x in w])) for w in (a, b)]
            common = rng.permutation(np.union1d(*keys))[:20]
            one, two = (near_dup.rarest(k, common, 0.8) for k in keys)
            assert np.intersect1d(one, two).size


def test_lines_that_meet_do_not_depend_on_the_size_of_the_table(spark):
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    draw = lambda n: ["".join(rng.choice(letters, 6)) for _ in range(n)]
    rows, other = [], []
    for i in range(300):
        own = draw(14)
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[:4], *draw(1), *own[5:9], *draw(1), *own[10:]]))]
    other = [(1000 + i, "\n".join(" ".join(draw(3)) for _ in range(100))) for i in range(300)]

    def gone(table):
        found = lines.repeated_lines(spark.createDataFrame(table, "doc_id long, text string")).collect()
        return {r["doc_id"] for r in found if r["doc_id"] < 1000}

    alone = gone(rows)
    assert len(alone) > 200
    assert gone(rows + other) == alone
