"""Cosine distances in blocks."""

import math
import random

from pyspark.sql import functions as F

from bondframe.operators import dataflow as D


def test_cosines_of_odd_vectors(spark, monkeypatch):
    """Other lengths, no length, unknown vectors, labels and values; work is in many tasks, though the table is small."""
    monkeypatch.setattr(D, "PAIRS", 50)
    r = random.Random(8)
    rows = [(k, r.choice([1, 1, 2, None]), [r.uniform(-1, 1) for _ in range(3)]) for k in range(200)]
    rows += [(200, 1, [0.0, 0.0, 0.0]), (201, 1, None), (210, 1, [1.0, None, 2.0]), (220, 1, [1.0, 2.0]), (230, 1, [2.0, 4.0]), (240, 1, []), (250, 3, [1.0, 1.0, 1.0])]
    d = spark.createDataFrame(rows, "id long, label int, v array<float>")
    norm = lambda v: math.sqrt(sum(x * x for x in v))

    def cosine(x, y):
        if not x or not y or None in x or None in y or len(x) != len(y) or not norm(x) * norm(y):
            return "nan"
        return str(round(1 - sum(p * q for p, q in zip(x, y)) / norm(x) / norm(y), 4) + 0.0)

    want = sorted((a, b, cosine(x, y)) for a, g, x in rows for b, h, y in rows if a % 10 == 0 and a != b and g is not None and g == h)
    pairs = D.cosine_pairs(d.coalesce(1), "label", "id", "v", F.col("id") % 10 == 0)
    got = sorted((p.a, p.b, "nan" if math.isnan(p.cosine) else str(round(p.cosine, 4) + 0.0)) for p in pairs.collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(p[2] == q[2] or abs(float(p[2]) - float(q[2])) < 2e-4 for p, q in zip(got, want))
    assert pairs.rdd.getNumPartitions() == 4 * D.SALTS
