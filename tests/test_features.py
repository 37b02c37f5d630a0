import pytest
from pyspark.sql import functions as F
from trackloom.operators import features


def test_gem_pool_and_length(spark):
    df = spark.createDataFrame([([[1.0, -2.0], [3.0, 2.0]],), ([],)], "p array<array<double>>")
    a, b = df.select(features.gem_pool(F.col("p")).alias("g")).collect()
    assert abs(a.g[0] - 14 ** (1 / 3)) < 1e-9 and a.g[1] == 0.0 and b.g is None
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(features.unit_length(F.col("v")).alias("u")).collect()
    assert [r.u for r in unit] == [[0.6, 0.8], [0.0, 0.0]]


def test_producers(spark):
    picture = (4, 4, [float(i % 5) for i in range(16)])
    df = spark.createDataFrame([(1, picture), (2, None), (3, (2, 2, []))], "id int, picture struct<width:int,height:int,pixels:array<double>>")
    got = {r.id: r.d for r in features.producer("thumbnail", grid=4)(df, "picture", "d").collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-5 and got[2] is None and got[3] is None
    with pytest.raises(ValueError):
        features.producer("nothing")


def test_classes_and_verdicts(spark):
    assert features.class_ids("car, 7,car", {"car": 2}) == [2, 7]
    with pytest.raises(ValueError):
        features.class_ids("boat", {"car": 2})
    df = spark.createDataFrame([(2, 0.9, 0.1), (3, 0.9, 0.1), (2, 0.1, 0.1), (2, 0.9, 0.9)], "c int, p double, a double")
    got = [r[0] for r in df.select(features.detection_verdict("c", "p", "a", [2], 0.5, 0.01, 0.5)).collect()]
    assert got == ["accepted", "class_not_wanted", "low_confidence", "too_large"]
