"""Name similarity against all pairs, the vector index against brute force."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from bourseline.operators import mapping, vector_index
from bourseline.plans import registry

SCHEMA = "id long, exchange string, name string"


def all_pairs(left, right, least=0.85, k=5):
    found = set()
    for i, x, a in left:
        near = sorted({(-r, j) for j, y, b in right if x and x == y and a and b and (r := SequenceMatcher(None, a, b).ratio()) >= least})
        found |= {(i, j, int(-r * 1e4 + 0.5) / 1e4) for r, j in near[:k]}
    return found


def both(spark, left, right, **more):
    got = mapping.similar_names(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), **more).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def damaged(dice, name):
    letters = list(name)
    for _ in range(dice.randrange(5)):
        at = dice.randrange(len(letters) + 1)
        letters[at : at + dice.randrange(2)] = dice.choice(["", "X", "A", " "])
    return "".join(letters)


@pytest.mark.parametrize("seed", range(3))
def test_no_pair_is_lost(spark, seed):
    """Names over few words, so that every word and most pairs of letters are hot; many have no whole word in common."""
    dice = random.Random(seed)
    words = ["ALPHA", "ALPINE", "BETA", "INDUSTRIES", "LIMITED", "NAMAN", "AAAA", "A", "OF"]
    right = [(i, dice.choice(["NSE", "BSE"]), " ".join(dice.choices(words, k=dice.randrange(1, 5)))) for i in range(120)]
    left = [(i, x, damaged(dice, name)) for i, x, name in right]
    want = all_pairs(left, right)
    assert len(want) > 100
    assert both(spark, left, right) == want


def test_short_names_of_all_kinds(spark):
    """Every name of up to four letters over three letters: the bound at its edge."""
    names = [""] + [a + b + c + d for a in "ABC" for b in ["", "A", "B"] for c in ["", "A", "C"] for d in ["", "B"]]
    rows = [(i, "NSE", n) for i, n in enumerate(names)]
    assert both(spark, rows, rows, k=100) == all_pairs(rows, rows, k=100)
    assert both(spark, rows, rows, least=1.0, k=100) == all_pairs(rows, rows, least=1.0, k=100)


def test_nulls_repeated_rows_ties_and_a_name_of_many_rows(spark):
    right = [(i, "NSE", "NAMAN INDUSTRIES LTD") for i in range(30, 0, -1)] + [(1, "NSE", "NAMAN INDUSTRIES LTD"), (99, None, "NAMAN INDUSTRIES LTD"), (98, "NSE", None)]
    got = both(spark, [(1, "NSE", "NAMAN INDUSTRIE LTD"), (2, None, "NAMAN"), (3, "NSE", None)], right)
    assert got == {(1, i, 0.9744) for i in range(1, 6)}


def test_empty_tables_and_a_bound_that_does_not_hold(spark):
    some = [(1, "NSE", "NAMAN")]
    assert both(spark, [], some) == both(spark, some, []) == set()
    with pytest.raises(ValueError, match="0.85"):
        both(spark, some, some, least=0.5)


def test_part_names_equal_all_pairs(spark):
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()
    right = [(p["p_partkey"], "NSE" if p["p_partkey"] % 3 == 0 else "BSE", f"{p['p_name']} {p['p_type']} {p['p_brand']}".upper()) for p in parts]
    left = [(i, x, n[: i % len(n)] + n[i % len(n) + 1 :]) for i, x, n in right]
    assert {tuple(r) for r in registry.QUERIES["similar_part_names"](spark, "/root/testdata/sf0.001").collect()} == all_pairs(left, right)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).cache()


def test_probed_cells_reach_the_recall(spark, vectors):
    exact = mapping.nearest(vectors.filter("vec_id % 100 = 0"), vectors, 10)
    found = registry.QUERIES["vector_index_search"](spark, "/root/testdata/sf0.001")
    assert found.groupBy("vec_id").count().filter("count <> 10").isEmpty()
    assert vector_index.recall(found, exact).first()["recall"] >= 0.9


def test_all_cells_are_exact_with_crowded_cells_in_blocks(spark, vectors, tmp_path, monkeypatch):
    """A third of the rows is one vector, so one cell is many blocks; queries are blocked alike."""
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    hot = vectors.filter("vec_id = 7").select(F.explode(F.expr("sequence(1000L, 1249L)")).alias("vec_id"), "e")
    rows = vectors.unionByName(hot)
    index = vector_index.build(rows, f"file://{tmp_path}/i", cells=8)
    assert index.vectors.count() == 750 and index.vectors.agg(F.max("block")).first()[0] >= 10
    queries = rows.filter("vec_id % 10 = 0")
    got = {(r["vec_id"], r["neighbour"]) for r in vector_index.search(index, queries, 5, 8).collect()}
    want = {(r["vec_id"], r["neighbour"]) for r in mapping.nearest(queries, rows, 5).collect()}
    assert len(want) == queries.count() * 5 and len(got & want) >= 0.99 * len(want) and len(got) == len(want)
    assert 1 <= vector_index.probes_for(index, queries.limit(20), 5, 0.5) <= vector_index.probes_for(index, queries.limit(20), 5, 1.0) <= 8


def test_vectors_without_direction_and_no_vectors(spark, tmp_path):
    schema = "vec_id long, e array<double>"
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None])], schema)
    index = vector_index.build(rows, f"file://{tmp_path}/a")
    assert {(r["vec_id"], r["neighbour"]) for r in vector_index.search(index, rows, 3, 9).collect()} == {(1, 2), (2, 1)}
    none = vector_index.build(rows.limit(0), f"file://{tmp_path}/b")
    assert vector_index.search(none, rows, 3, 1).collect() == [] and vector_index.probes_for(none, rows, 3) == 0
