"""Findings of the fourth review on the training-data operators: each test failed before its change."""

import random

import numpy as np
import pyarrow as pa

from bourseline.llm import alignment, lines, spelling


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    plans, real = [], spelling.stored

    def stored(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(spelling, "stored", stored)
    words = ["planting"] * 200 + ["plantings"] * 15 + ["plannting", "plannting"] + ["harvest"] * 2
    forms = spelling.spelling_forms(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string"))
    roots = {r["word"]: r["root"] for r in forms.collect()}
    assert roots["plannting"] == roots["plantings"] == "planting" and roots["harvest"] == "harvest"
    spelling.respelled(spark.createDataFrame([(1, "plannting")], "doc_id long, text string"), forms).collect()
    plans.append(spelling.respelled(spark.createDataFrame([(1, "plannting")], "doc_id long, text string"), forms)._jdf.queryExecution().executedPlan().toString())
    plans.append(forms._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and not [p for p in plans if "Broadcast" in p]


def met(key, sim, more, line):
    columns = {"key": key.astype("<u4"), "sim": sim.astype("<u8"), "more": more.astype("<u4"), "a": line.astype("<i8")}
    found = lines._met(pa.table({"share": [1], **{c: [x.tobytes()] for c, x in columns.items()}}), 0.85).to_pylist()
    return [(r["x"], r["y"]) for r in found if r["kind"] == 0], {(r["x"] & 0xFFFFFFFF, r["y"]) for r in found if r["kind"] == 1}


def test_candidates_of_a_crowded_group_do_not_grow_with_its_square():
    for n in (60, 600, 2000):
        pairs, members = met(np.full(n, 7), np.full(n, 77), np.full(n, 3), np.arange(n) + 5)
        assert {x for p in pairs for x in p} == {x for _, x in members} == set(range(5, n + 5)) and len(pairs) <= n


def test_every_pair_of_candidates_is_given_or_left_to_the_leaders():
    rng = np.random.default_rng(4)
    for size in (40, 400, 3000):
        heart = rng.integers(0, 1 << 63, size // 12 + 1, dtype=np.uint64)
        sim = heart[rng.integers(0, len(heart), size)]
        for _ in range(5):
            sim = sim ^ np.uint64(1) << rng.integers(8, 64, size).astype(np.uint64)
        sim = sim & ~np.uint64(255) | rng.integers(100, 120, size).astype(np.uint64)
        key, more, line = rng.integers(0, 3, size), np.full(size, 9, np.uint32), rng.permutation(size)
        pairs, members = met(key, sim, more, line)
        given, want = set(pairs), 0
        for k in range(3):
            own = np.flatnonzero(key == k)
            for i in own.tolist():
                near = own[lines._candidates(sim[own], sim[i])]
                for j in near[lines._sure(sim, more, i, near, 0.85)].tolist():
                    if i < j:
                        want += 1
                        u, v = sorted((int(line[i]), int(line[j])))
                        assert (u, v) in given or {(k, u), (k, v)} <= members
        assert want > size // 2


def test_leaders_leave_groups_of_one_component():
    n = 50
    table = {"share": pa.array([1] * n, pa.int32()), "x": pa.array([3] * n), "y": pa.array(range(n)), "z": pa.array([7 << 8] * n), "more": pa.array([0] * n)}
    assert lines._lead(1, 0.85)(pa.table(table | {"label": pa.array([0] * n)})).num_rows == 0
    parted = lines._lead(1, 0.85)(pa.table(table | {"label": pa.array([0] * (n - 1) + [1])})).to_pylist()
    assert [r for r in parted if r["kind"] == 0]


def test_lines_outside_the_largest_component_lead_first():
    """Of 200 lines of one component and 3 others, the 3 lead and the group is done; the large one's lines have nothing to add."""
    n = 203
    label = [0] * 200 + [1, 2, 2]
    table = {"share": pa.array([1] * n, pa.int32()), "x": pa.array([3] * n), "y": pa.array(range(n)), "z": pa.array([7 << 8] * n), "more": pa.array([0] * n), "label": pa.array(label)}
    found = lines._lead(3, 0.85)(pa.table(table)).to_pylist()
    assert {r["kind"] for r in found} == {0}
    assert {(r["x"], r["y"]) for r in found} == {(u, v) for u in range(n) for v in range(u + 1, n) if label[u] != label[v]}


def test_hashes_of_runs_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    starts = np.unique(np.concatenate([[0], rng.integers(0, 900, 60)]))
    base = 0x9E3779B97F4A7C15
    plain = [sum((int(x) + 1) * pow(base, i, 1 << 64) for i, x in enumerate(values[a:b])) % (1 << 64) for a, b in zip(starts, [*starts[1:], 900], strict=True)]
    want = lines.mixed(np.array(plain, np.uint64))
    for most in (1 << 18, 40, 3):
        monkeypatch.setattr(lines, "_MOST_POWERS", most)
        lines._powers.cache_clear()
        assert (lines.run_hashes(values, starts, base) == want).all()
    monkeypatch.undo()
    lines._powers.cache_clear()


def test_many_pairs_are_verified_as_one_by_one():
    dice = random.Random(6)
    xs, ys, limits = [], [], []
    for _ in range(500):
        letters = dice.choice(["ab ", "abcdefgh ", "\u00e4\u00f6\u00dfabcde\u4e2d\u6587\U0001f600 "])
        x = "".join(dice.choice(letters) for _ in range(dice.choice([0, 1, 3, 20, 63, 64, 65, 130, 260])))
        y = list(x)
        for _ in range(dice.randint(0, max(2, len(x) // 4))):
            k = dice.randint(0, len(y))
            y[k : k + dice.randint(0, 2)] = [dice.choice(letters) for _ in range(dice.randint(0, 2))]
        xs.append(x)
        ys.append("".join(y) if dice.random() < 0.9 else "".join(dice.choice(letters) for _ in range(len(x))))
        limits.append(int(dice.choice([0.05, 0.15, 0.3]) * max(len(x), len(y))))
    want = [alignment.by_bits(x, y) <= k for x, y, k in zip(xs, ys, limits, strict=True)]
    assert 100 < sum(want) < 400
    for few in (0, 12, 10**9):
        assert alignment.all_within(xs, ys, limits, few).tolist() == want
    assert alignment.all_within([], [], []).tolist() == []
