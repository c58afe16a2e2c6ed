"""Medians against plain ones."""

import random
import statistics

import pytest

from tidemark.operators import medians as module
from tidemark.operators.medians import medians


@pytest.mark.parametrize("accuracy", [50_000, 40])
def test_medians(spark, monkeypatch, accuracy):
    """Hot groups, ties, nulls and groups of one or two; with a coarse sketch the brackets are narrow beside the group."""
    monkeypatch.setattr(module, "ACCURACY", accuracy)
    rng = random.Random(accuracy)
    rows = [("hot", rng.gauss(0, 1e6)) for _ in range(6001)] + [("even", float(k)) for k in range(4000)] + [("ties", float(k % 3)) for k in range(999)]
    rows += [("one", 7.5), ("two", -1.0), ("two", 2.0), (None, 3.0), (None, 5.0), ("nothing", None), ("hot", None), ("big", 1e308), ("big", -1e308), ("big", 0.1)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "x") for r in rows], "g string, v double, n string")
    want = {g: statistics.median(v for h, v in rows if h == g and v is not None) for g in {g for g, _ in rows} - {"nothing"}}
    assert {r.g: r["median"] for r in medians(table, "g", "v").collect()} == want
    assert medians(table.limit(0), "g", "v").collect() == []
