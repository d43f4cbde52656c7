"""Statistics of many columns by matrix products against one aggregate a pair."""

import numpy as np
import pytest

from calibra.operators import linear as L


@pytest.mark.parametrize("n", [400, 0])
def test_matrix_sums_are_the_sums_of_pairs(spark, monkeypatch, n):
    rng = np.random.default_rng(4)
    names = [f"f{i}" for i in range(9)]
    x = np.column_stack([1e6 + rng.normal(size=n) if i == 3 else rng.normal(size=n) * 10 ** (i % 4) for i in range(9)])
    rows = [(*map(float, r), None if i % 50 == 7 else float(r.sum())) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "y"])).repartition(3)
    assert len(names) >= L.WIDE
    plan = L.gram_stats(df, names)._jdf.queryExecution().optimizedPlan().toString()
    assert "_S0_1" not in plan  # no aggregate a pair
    wide = L.gram_stats(df, names).collect()
    monkeypatch.setattr(L, "WIDE", 100)
    pairs = L.gram_stats(df, names).select(*wide[0].__fields__).collect()
    assert len(wide) == len(pairs) == 1 and wide[0].n == pairs[0].n == n
    for a, b in zip(wide[0], pairs[0]):
        assert a == b is None or a == pytest.approx(b, rel=1e-9, abs=1e-9)
