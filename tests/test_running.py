"""Running sums by ranges, and what rests on them."""

import itertools
import random

from marketloom.operators.health import binary_metrics
from marketloom.operators.running import running_before


def test_equal_to_a_loop(spark):
    rng = random.Random(5)
    rows = [(k, by, rng.randint(-3, 9)) for k in (None, "a", "b", "c") for by in rng.sample(range(-500, 500), 120 if k != "c" else 1)]
    got = running_before(spark.createDataFrame(rows, "k string, by int, n int"), "by", "n", ("k",)).collect()
    assert len(got) == len(rows)
    assert all(r.before == sum(n for k, by, n in rows if k == r.k and by < r.by) for r in got)
    flat = [(by, n) for k, by, n in rows if k == "a"]
    got = running_before(spark.createDataFrame(flat, "by int, n int"), "by", "n").collect()
    assert sorted((r.by, r.before) for r in got) == sorted((by, sum(n for b, n in flat if b < by)) for by, _ in flat)
    assert running_before(spark.createDataFrame([], "by int, n int"), "by", "n").collect() == []


def test_area_under_the_curve(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 1), rng.randint(0, 40) / 40) for _ in range(400)]
    pairs = [(p > q) + (p == q) / 2 for (y, p), (z, q) in itertools.product(rows, rows) if y == 1 and z == 0]
    (r,) = binary_metrics(spark.createDataFrame(rows, "y int, p double")).collect()
    assert abs(r.auc - sum(pairs) / len(pairs)) <= 0.00005
