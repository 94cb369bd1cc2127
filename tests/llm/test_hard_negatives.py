"""Hard negatives against all pairs in Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablepact.llm import hard_negatives
from tablepact.llm.hard_negatives import Packing, mine_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every, scale=256, positives=5, negatives=3, low=50, high=95):
    def whole(v):
        return [math.floor(scale * x) for x in v]

    good = [(i, whole(v), lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for k, (i, v, lab) in enumerate(good):
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for m, (j, w, other) in enumerate(good) if m != k]
        for p, pid, _ in sorted((t for t in scored if t[2] == lab), key=key)[:positives]:
            fits = sorted((t for t in scored if t[2] != lab and low * p <= 100 * t[0] <= high * p), key=key)
            out += [(i, pid, r + 1, nid, p, n) for r, (n, nid, _) in enumerate(fits[:negatives])]
    return sorted(out, key=str)


def mined(spark, rows, every, schema=SCHEMA, **settings):
    df = spark.createDataFrame(rows, schema)
    return sorted(map(tuple, mine_hard_negatives(df, F.col("vec_id") % every == 0, **settings).collect()), key=str)


def test_random_vectors_in_blocks_and_parts(spark, monkeypatch):
    """Several blocks, parts and chunks give what one does; a hot label, ties and copies."""
    rng = np.random.default_rng(3)
    values = rng.normal(size=(400, 8)).round(1)
    values[300:] = values[:100]
    rows = [(int(i), v.tolist(), 0 if i % 3 else int(i) % 5) for i, v in enumerate(values)]
    wanted = brute(rows, 7)
    assert len(wanted) > 500
    assert mined(spark, rows, 7) == wanted
    for name, size in (("BLOCK", 16), ("PART", 64), ("SCORES", 640)):
        monkeypatch.setattr(hard_negatives, name, size)
    assert mined(spark, rows, 7) == wanted


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (2, [0.9, 0.5], 1), (None, [0.8, 0.1], 2), (None, [0.8, 0.1], 2), (5, [0.8, 0.1], 2),
        (4, None, 1), (6, [nan, 1.0], 1), (8, [1.0, None], 2), (10, [inf, 1.0], 2), (12, [0.7, 0.2], None), (14, [], 3), (16, [0.6], 3),
        (18, [0.0, 0.0], 1), (-20, [-0.3, -0.7], 3), (-22, [-0.2, -0.6], 2), (21, [0.7, 0.3, 0.1], 2),
    ]
    assert mined(spark, rows, 2) == brute(rows, 2)
    clash = [(*r, 1, "x", 2) for r in rows]
    assert mined(spark, clash, 2, f"{SCHEMA}, row int, anchor string, positives int") == brute(rows, 2)
    assert mined(spark, [], 2) == mined(spark, rows[6:9], 2) == mined(spark, rows, 999_983, positives=0) == []
    assert mined(spark, rows[2:3], 2) == []
    with pytest.raises(ValueError, match="whole numbers"):
        mine_hard_negatives(spark.createDataFrame(rows, SCHEMA).withColumn("vec_id", F.col("vec_id").cast("string")), F.lit(True))


def test_fields_of_any_width(spark):
    """Scores of 18 bits share 64-bit integers; wider ones have one to themselves, or Python's integers."""
    rng = np.random.default_rng(5)
    assert (Packing(1 << 17).fields, Packing(1 << 40).fields, Packing(1 << 62).wide) == (3, 1, False)
    assert Packing(1 << 64).wide and Packing(1 << 64).fields == hard_negatives.WIDE_FIELDS
    for bound, size in ((1 << 14, 20), (1 << 20, 100), (1 << 30, 3000), (1 << 80, 1000)):
        a, c = (rng.integers(-size, size + 1, (n, 6)).astype(float) for n in (5, 11))
        packing = Packing(bound)
        packed, bias = packing.pack(c)
        found = packing.scores(packing.integers(a), packed, bias, 11)
        assert found.tolist() == (a.astype(int) @ c.astype(int).T).tolist()
    big = [(i, [1e4 * (i + 1), -3e3 * i], i % 3) for i in range(40)]
    assert mined(spark, big, 5) == brute(big, 5)
    with pytest.raises(ValueError, match="do not fit"):
        mined(spark, [(0, [1e30], 1), (1, [1.0], 1)], 1)


def test_query_against_sql(spark):
    from tablepact.llm.queries import QUERIES, SQL
    from tests.oracle import database, difference

    folder = "/root/testdata/sf0.1"
    assert difference(spark, "op11", QUERIES["op11_hard_negatives"], SQL["op11_hard_negatives"], folder, database(folder)) is None
