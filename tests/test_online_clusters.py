"""Online clusters equal the rule taken row by row, and a vector costs no pass of Python over the centroids."""

import time

import numpy as np

from quarry.operators import retrieval


def by_row(rows, threshold):
    sums, out = [], []
    for v in rows:
        x = v / max(np.linalg.norm(v), 1e-12)
        d = [1 - c @ x / max(np.linalg.norm(c), 1e-12) for c in sums]
        if d and min(d) <= threshold:
            j = int(np.argmin(d))
            sums[j] = sums[j] + x
        else:
            j = len(sums)
            sums.append(x)
        out.append(j)
    return out


def sample(rng, n, width=6):
    middles = rng.normal(size=(n // 8, width))
    rows = middles[rng.integers(0, len(middles), n)] + rng.normal(size=(n, width)) * 0.4
    rows[5] = 0
    rows[7] = rows[6] * 3
    return rows


def test_equals_the_rule_by_row(spark):
    rng = np.random.default_rng(4)
    groups = {0: sample(rng, 700), 1: sample(rng, 300), None: sample(rng, 40), 3: sample(rng, 9)}
    rows = [(g, i, v.tolist()) for g, vs in groups.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "g int, i bigint, v array<double>")
    wanted = {(g, i, j) for g, vs in groups.items() for i, j in enumerate(by_row(vs, 0.35))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        found = [tuple(r) for r in retrieval.online_clusters(table.repartition(5), "g", "i", "v", 0.35).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(rows) and set(found) == wanted
    assert retrieval.online_clusters(table.limit(0), "g", "i", "v", 0.35).collect() == []


def test_many_clusters_in_one_group(spark):
    """16,000 unlike vectors of one group: by row, with all centroids gathered anew for each, some 400 GB of copies."""
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(rng.normal(size=(16_000, 64)))], "g int, i bigint, v array<float>")
    table = table.repartition(4).cache()
    table.count()
    start = time.perf_counter()
    clusters = retrieval.online_clusters(table, "g", "i", "v", 0.35).agg({"cluster": "max"}).first()[0]
    assert clusters > 15_000 and time.perf_counter() - start < 20
