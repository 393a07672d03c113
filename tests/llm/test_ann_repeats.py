"""Repeated ids beside a query must not displace other neighbours."""

import numpy as np
from pyspark.sql import functions as F

from loomery.llm import ann


def test_an_id_repeated_a_hundred_times_counts_once(spark):
    r = np.random.default_rng(11)
    x = r.standard_normal((2000, 16))
    x[1] = 3 * x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1, (x[1] * (1 + k * 1e-6)).tolist()) for k in range(100)] + [(2, x[2].tolist())] * 100
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    s = x @ x[0]
    s[0] = -np.inf
    best = set(np.argsort(-s)[:20].tolist())
    assert len({g["vec_id"] for g in got}) == len(got) == 20 and got[0]["vec_id"] == 1
    assert len(best & {g["vec_id"] for g in got}) >= 18
