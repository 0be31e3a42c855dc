import pytest
from pyspark.sql import functions as F

from routeloom.functions import GridBounds, all_partition_ids, cell_id, differing_level, dominates, dot, haversine_km, normalise_preference


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_vectors(spark):
    assert one(spark, dot(arr(1, 2, 3), arr(0.5, 0.25, 0.25)), dot(arr(1, 2), [2, 1])) == (1.75, 4.0)
    assert one(spark, dominates(arr(1, 2), arr(1, 3)), dominates(arr(1, 4), arr(1, 3))) == (True, False)
    assert one(spark, normalise_preference(arr(1, 3)))[0] == [0.25, 0.75]
    assert one(spark, normalise_preference(arr(0, 0)))[0] == [0.5, 0.5]


FACTORS = [5, 2, 3]


@pytest.mark.parametrize("p", [0, 4, 5, 13, 29])
def test_partition_ids(spark, p):
    assert one(spark, all_partition_ids(F.lit(p), FACTORS))[0] == [p, p // 5, p // 10, p // 30]


@pytest.mark.parametrize("a, b", [(8, 8), (5, 9), (4, 5), (9, 10), (3, 28)])
def test_differing_level(spark, a, b):
    same = [a // n == b // n for n in (1, 5, 10, 30)]
    assert one(spark, differing_level(F.lit(a), F.lit(b), FACTORS)) == (same.index(True),)


def test_cells(spark):
    b = GridBounds(10.0, 20.0, 10.0, 20.0)
    at = lambda lat, lng: one(spark, cell_id(F.lit(lat), F.lit(lng), b))[0]
    for lat, lng in ((10.05, 12.25), (13.7, 19.95), (20.0, 10.0)):
        assert at(lat, lng) == int((lng - 10) / 10 * 99) * 136 + int((lat - 10) / 10 * 135)
    assert at(9.0, 9.0) == 0
    assert one(spark, cell_id(F.lit(1.0), F.lit(1.0), GridBounds(1.0, 1.0, 1.0, 1.0))) == (0,)


def test_haversine(spark):
    assert one(spark, haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))[0] == pytest.approx(20015.087, abs=1e-2)
