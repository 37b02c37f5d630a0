"""Repeated rows in the nearest neighbour search."""

import numpy as np
from pyspark.sql import functions as F
from trackloom.llm import ann


def test_repeated_rows_do_not_push_out_neighbours(spark):
    x = np.random.default_rng(5).standard_normal((60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = []
    for copies in (1, 5):
        df = spark.createDataFrame(rows * copies, "vec_id long, embedding array<double>")
        found.append(sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.col("id") % 20 == 0).collect()))
    assert found[0] == found[1] and len(found[1]) == 15
