"""Exact quantiles of histograms that are cut several times."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulse.operators import quantiles

PROBS = {"q0": 0.0, "q1": 0.01, "q50": 0.5, "q99": 0.99, "q100": 1.0}


@pytest.mark.parametrize("rows_per_range", [10, 700])
def test_ranges_of_a_few_rows(spark, monkeypatch, rows_per_range):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 4 == 0, "few").when(F.col("id") % 4 == 1, None).otherwise("many").alias("g"),
        F.when(F.col("id") % 4 == 0, F.col("id") % 40).otherwise((F.col("id") * 7919) % 10_007).cast("double").alias("v"))
    rounds = []
    real = quantiles._refined

    def counted(rows, ranges, keys):
        out = real(rows, ranges, keys)
        rounds.append((rows.count(), out[0].count()))
        return out

    monkeypatch.setattr(quantiles, "_refined", counted)
    got = {r.g: r for r in quantiles.exact_quantiles(df, "v", PROBS, ["g"], rows_per_range).collect()}
    values = df.toPandas()
    for g, name in (("few", "few"), (None, None), ("many", "many")):
        mine = values["v"][values["g"] == g] if g else values["v"][values["g"].isna()]
        assert [got[name][q] for q in PROBS] == pytest.approx([np.quantile(mine, p) for p in PROBS.values()])
    # Every round keeps a fraction of the rows only.
    assert len(rounds) >= (2 if rows_per_range == 10 else 1)
    assert all(after < before / 2 for before, after in rounds)


def test_without_keys_and_with_equal_values(spark):
    df = spark.range(5_000).select((F.col("id") % 3).alias("v"))
    row = quantiles.exact_quantiles(df, "v", PROBS, rows_per_range=1).first()
    assert [row[q] for q in PROBS] == [0, 0, 1, 2, 2]
    assert [quantiles.exact_quantiles(df.limit(0), "v", PROBS).count(),
            quantiles.exact_quantiles(df.select(F.lit(None).cast("long").alias("v")), "v", PROBS).first()["q50"]] == [0, None]
