import random

import pytest

from folioflux.operators.prefix import running_totals


@pytest.mark.parametrize("partitions", [1, 4, 11])
def test_against_brute_force(spark, partitions):
    r = random.Random(partitions)
    rows = [(r.choice(["hot"] * 5 + ["a", "z", None]), i, r.choice([None, 0, 3, 7])) for i in range(400)]
    got = {(x.k, x.i): x.before for x in running_totals(spark.createDataFrame(rows, "k string, i long, n int").repartition(6), "k", ["i"], "n", partitions=partitions).collect()}
    total, want = {}, {}
    for k, i, n in rows:
        want[k, i] = total.get(k, 0)
        total[k] = want[k, i] + (n or 0)
    assert got == want


def test_empty(spark):
    assert running_totals(spark.createDataFrame([], "k string, i long, n long, before string"), "k", ["i"], "n").columns == ["k", "i", "n", "before"]
