import numpy as np
import pytest
from pyspark.sql import functions as F

from limpid.functions import quantiles as Q

RNG = np.random.default_rng(7)
CASES = {
    "normal": RNG.normal(0, 1, 20_000),
    "heavy tail": RNG.standard_cauchy(20_000) * 1e6,
    "constant": np.full(1_000, 3.25),
    "hot value": np.concatenate([np.full(9_000, -999.0), RNG.uniform(0, 1, 11_000)]),
    "huge span": np.concatenate([[-1.7e308, 1.7e308], RNG.uniform(-1, 1, 5_000)]),
    "all scales": 10.0 ** RNG.uniform(-300, 300, 5_000),
    "two values": np.array([1.0, 2.0]),
    "one value": np.array([42.0]),
    "integers": RNG.integers(0, 50, 20_000).astype(float),
}


def test_same_as_numpy(spark):
    size = max(len(v) for v in CASES.values())
    names = list(CASES)
    rows = [tuple(float(CASES[n][i]) if i < len(CASES[n]) else None for n in names) for i in range(size)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(len(names)))).repartition(7).cache()
    spans = {n: (len(v), float(v.min()), float(v.max())) for n, v in CASES.items()}
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = Q.exact_quantiles(df, {n: F.col(f"c{i}") for i, n in enumerate(names)}, spans, ps)
    for n, values in CASES.items():
        with np.errstate(over="ignore"):
            want = np.quantile(values, ps)
        for p, w in zip(ps, want):
            if np.isfinite(w):
                assert got[n][p] == pytest.approx(w, rel=1e-12), (n, p)


def test_infinite_values_take_the_end_ranks(spark):
    values = [float("-inf"), 1.0, 2.0, 3.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "c double")
    got = Q.exact_quantiles(df, {"c": F.col("c")}, {"c": (5, values[0], values[-1])}, [0.0, 0.5, 1.0])["c"]
    assert got == {0.0: float("-inf"), 0.5: 2.0, 1.0: float("inf")}


def test_long_ids_keep_every_bit(spark):
    ids = [(1 << 60) + 3 * i for i in range(5_000)]
    df = spark.createDataFrame([(v,) for v in ids], "c bigint").repartition(5)
    wanted = [0, 1, 17, 2_500, 4_998, 4_999]
    got = Q.order_statistics(df, {"c": F.col("c")}, {"c": (5_000, ids[0], ids[-1])}, {"c": wanted}, integer=True)["c"]
    assert got == {r: ids[r] for r in wanted}


def test_nothing_to_do(spark):
    df = spark.createDataFrame([(None,)], "c double")
    assert Q.exact_quantiles(df, {"c": F.col("c")}, {"c": (0, None, None)}, [0.5]) == {}
