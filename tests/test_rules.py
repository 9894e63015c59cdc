import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsynth.expr import add_formulas, compile_constraint, drop_violators, violation_rate
from tabsynth.ordered import quantiles


@pytest.fixture(scope="module")
def mixed(spark):
    day = dt.datetime(2024, 5, 1)
    rows = [(1.0, "x", 5, True, day, day.date()), (float("nan"), "5", 2**62, False, None, None), (None, None, None, None, day, day.date())]
    return spark.createDataFrame(rows, "a double, b string, c long, d boolean, e timestamp, f date")


@pytest.mark.parametrize(("rule", "kept"), [
    ("c0 == 'x'", [0, 0, 0]), ("c0 != 'x'", [1, 1, 1]), ("c1 == 5", [0, 0, 0]), ("c1 != 5", [1, 1, 1]), ("5 == c1", [0, 0, 0]),
    ("c1 in [5, 'x']", [1, 0, 0]), ("c1 not in [5, 'x']", [0, 1, 1]), ("c0 in ['x', 1]", [1, 0, 0]), ("c2 in []", [0, 0, 0]),
    ("c0 == c1", [0, 0, 0]), ("c0 != c1", [1, 1, 1]), ("c3 == 1", [1, 0, 0]), ("c3 < c2", [1, 1, 0]), ("c3 == 'True'", [0, 0, 0]),
    ("c4 > '2024-01-01'", [1, 0, 1]), ("c4 == 'never'", [0, 0, 0]), ("c4 != 'never'", [1, 1, 1]), ("c5 <= '2024-05-01'", [1, 0, 1]), ("c4 == 5", [0, 0, 0]),
    ("c2 < 99999999999999999999", [1, 1, 0]), ("c2 * 4 > 100", [0, 1, 0]), ("not (c0 == 'x') and c0 >= 1", [1, 0, 0]),
])
def test_sides_of_unlike_kinds(mixed, rule, kept):
    assert [int(r[0]) for r in mixed.select(compile_constraint(mixed, rule)).collect()] == kept


def test_no_rule_stops_a_job(mixed):
    bad = ["c1 < 5", "c0 >= 'x'", "c1 * 2 > 1", "c1 + c1 == 'xx'", "-c1 == 2", "c4 > 5", "c4 - c4 == 0", "c9 > 1", "c0 in c1", "c0 in [[1]]", "c0 ==", "c0 is None", "f(c0)"]
    assert drop_violators(mixed, bad).count() == 3
    assert violation_rate(mixed, bad).first()[0] == 0
    assert add_formulas(mixed, {"z": "c1 * 2.0", "y": "c4 / c0"}).columns == mixed.columns


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles_of_tables_of_any_size(spark, n):
    x = np.random.default_rng(n).integers(0, max(2, n // 3), n).astype(float)
    df, probs = spark.createDataFrame([(float(v),) for v in x], "x double"), [0.0, 0.25, 0.5, 0.9, 1.0]
    for rows in (10**6, 0):
        assert np.allclose(quantiles(df, "x", probs, rows), np.quantile(x, probs))
    assert quantiles(df.where(F.lit(False)), "x", probs) is None
