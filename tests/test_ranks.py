"""Order statistics by histograms against sorting."""

import random

import numpy as np

from tidewright.operators.ranks import order_statistics, percentiles

R = random.Random(6)


def test_order_statistics(spark):
    n = 4000
    columns = {
        "even": [R.uniform(-5, 5) for _ in range(n)], "skewed": [10 ** R.uniform(-9, 9) for _ in range(n)], "ties": [float(R.randint(0, 3)) for _ in range(n)],
        "one": [7.0] * n, "gaps": [R.choice([None, float("nan"), R.gauss(0, 1)]) for _ in range(n)], "none": [None] * n, "wide": [R.choice([-1e308, 1e308, 0.0]) for _ in range(n)],
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(4)
    held = {c: sorted(v for v in values if v is not None and v == v) for c, values in columns.items()}
    ranks = {c: [0, len(v) // 3, len(v) // 2, len(v) - 1] for c, v in held.items() if v}
    for few in (10, 2048):
        found = order_statistics(df, ranks, bins=16, few=few)
        assert found == {(c, r): held[c][r] for c, rs in ranks.items() for r in rs}
    several = percentiles(df, ["even", "ties", "gaps", "none"], (0.2, 0.5, 0.8))
    assert set(several) == {"even", "ties", "gaps"}
    for c, values in several.items():
        assert np.allclose(values, np.percentile(held[c], [20, 50, 80]), rtol=1e-12)
