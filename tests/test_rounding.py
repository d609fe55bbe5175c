import math
import random
from fractions import Fraction

from wattfold.functions.rounding import exact_mean, exact_total, half_even, half_up


def numbers():
    rng = random.Random(7)
    out = [0.0, -0.05, 0.25, 0.35, 1.005, 2.675, 26.25, 26.15, 26.05, 1e-9, 1e14 + 0.5, -2.5, 2.5, 3.5, 0.5, 1e300]
    out += [rng.randrange(-(10**7), 10**7) / 1000 for _ in range(4000)]
    out += [rng.randrange(0, 10**6) / 8 for _ in range(1000)]  # exact ties
    out += [(rng.randrange(0, 10**6) + 0.5) / 10 ** rng.randrange(1, 4) for _ in range(4000)]  # near ties
    out += [rng.random() * 10 ** rng.randrange(-3, 6) for _ in range(2000)]
    return out


def test_half_even_is_decimal_rounding_of_the_exact_value(spark):
    rows = spark.createDataFrame([(v,) for v in numbers()], "x double")
    for digits in (0, 1, 2, 3):
        got = rows.select("x", half_even("x", digits).alias("r")).collect()
        assert [(r["x"], r["r"]) for r in got if r["r"] != round(r["x"], digits)] == []


def test_half_up(spark):
    rows = spark.createDataFrame([(v,) for v in numbers() if abs(v) < 1e15], "x double")
    for digits in (0, 1):
        scale = 10.0**digits
        got = rows.select("x", half_up("x", digits).alias("r")).collect()
        for r in got:
            scaled = r["x"] * scale
            low = math.floor(scaled)
            assert r["r"] == (low + 1 if scaled - low >= 0.5 else low) / scale


def test_null_stays_null(spark):
    row = spark.range(1).select(half_even("CAST(NULL AS DOUBLE)", 1).alias("a"), half_up("CAST(NULL AS DOUBLE)", 1).alias("b")).first()
    assert row["a"] is None and row["b"] is None


def test_exact_total_is_the_nearest_double_to_the_exact_sum(spark):
    rng = random.Random(3)
    groups = {g: [rng.randrange(-(10**6), 10**6) / 10 ** rng.randrange(0, 4) for _ in range(n)] for g, n in enumerate((1, 2, 7, 500, 3000))}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, x double")
    for parts in (1, 7):
        out = rows.repartition(parts).groupBy("g").agg(exact_total("x").alias("t"), exact_mean("x").alias("m")).collect()
        for r in out:
            exact = float(sum(map(Fraction, groups[r["g"]])))
            assert r["t"] == exact
            assert r["m"] == exact / len(groups[r["g"]])


def test_exact_mean_without_rows_is_null(spark):
    row = spark.range(3).agg(exact_mean("id", "false").alias("m"), exact_total("id", "false").alias("t")).first()
    assert row["m"] is None and row["t"] is None
