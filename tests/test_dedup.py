"""Top-1 per key against brute force: descending with nulls last, a
CASE-style priority, and a unique tie-break; hot key included."""

import random

from pyspark.sql import functions as F

from arrears.operators.dedup import latest_per_key


def test_latest_per_key_random(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        k = 0 if rnd.random() < 0.35 else rnd.randrange(1, 200)
        d = None if rnd.random() < 0.1 else rnd.randrange(0, 20)
        t = rnd.choice(["Installment", "Single", None])
        rows.append((k, d, t, i))
    df = spark.createDataFrame(rows, "k int, d int, t string, id int")
    got = {r.k: r.id for r in latest_per_key(
        df, ["k"], [F.when(F.col("t") == "Installment", 1).otherwise(2).asc(),
                    F.col("d").desc_nulls_last(), F.col("id").desc()]).collect()}

    def rank(r):
        _, d, t, i = r
        return (1 if t == "Installment" else 2, 0 if d is not None else 1,
                -(d or 0), -i)

    want = {}
    for r in rows:
        if r[0] not in want or rank(r) < rank(want[r[0]]):
            want[r[0]] = r
    assert got == {k: r[3] for k, r in want.items()}
