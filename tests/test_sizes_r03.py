"""What a task holds stays bounded as tables grow (round 3)."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd

from bourseline.operators import vector_index
from bourseline.plans import matching


def _vectors(n: int, dim: int = 16) -> pd.DataFrame:
    return pd.DataFrame({"vec_id": np.arange(n), "e": list(np.random.default_rng(1).standard_normal((n, dim)))})


def test_placing_vectors_does_not_hold_all_cosines_of_a_batch():
    part, centres = _vectors(4000), np.random.default_rng(2).standard_normal((2000, 16))
    for probes in (1, 3):
        tracemalloc.start()
        got = pd.concat([x.drop(columns="e") for x in vector_index._cells(part, centres, probes)])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20e6  # all cosines of the batch are 64 MB
        order = np.argsort(-(np.stack(part["e"]) @ centres.T), axis=1, kind="stable")[:, :probes]
        assert (got["cell"].to_numpy().reshape(-1, probes) == order).all()
        assert (got["rank"].to_numpy().reshape(-1, probes) == np.arange(1, probes + 1)).all()


def test_candidates_are_joined_in_tasks_that_are_not_put_together(spark):
    found = matching.candidates_merged(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(item" in line and "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 2 and all(f", {parts})" in line for line in dealt)
