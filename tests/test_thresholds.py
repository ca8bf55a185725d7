import random

import pytest

from tessera.operators import thresholds


def plain(values, threshold, warm):
    """The scan of all documents in order; values by document."""
    out, lows = [], []
    for doc, v in values:
        cuts = []
        for i in range(1, len(v) - 1):
            left, right = v[i - 1] - v[i], v[i + 1] - v[i]
            if left > 0 and right > 0:
                if left >= threshold or right >= threshold:
                    cuts.append(i)
                    lows.append(min(left, right))
            elif left > 0 and right == 0 and left >= threshold:
                cuts.append(i)
                lows.append(left)
            if len(lows) >= warm:
                threshold = min(lows)
        chunk = 0
        for i in range(len(v)):
            out.append((doc, i, chunk))
            chunk += i in cuts
    return out


def test_stretches_of_minima_are_put_together():
    rnd = random.Random(1)
    for _ in range(300):
        s, events = thresholds.Steps(), []
        for _ in range(rnd.randrange(1, 30)):
            low, high = sorted((rnd.randrange(12), rnd.randrange(12)))
            s.add(high, low)
            events.append((high, low))
        assert all(a < b and c <= a for a, b, c in s.pieces) and all(x[1] <= y[0] and x[2] <= y[2] for x, y in zip(s.pieces, s.pieces[1:], strict=False))
        for k in range(27):
            t = want = k / 2
            for high, low in events:
                want = min(want, low) if high >= want else want
            assert s.of(t) == want, (events, t)


@pytest.mark.parametrize(("partitions", "warm"), [(1, 5), (7, 5), (40, 20), (5, 10_000)])
def test_chunks_against_the_scan_in_order(spark, partitions, warm):
    rnd = random.Random(partitions)
    values = [(d, [rnd.choice([1.0, 2.0, 5.0, 9.0, rnd.random() * 20]) for _ in range(rnd.randrange(0, 30))]) for d in range(60)]
    rows = [(d, i, x, "clash") for d, v in values for i, x in enumerate(v)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "doc long, place int, v double, low string").repartition(5)
        got = sorted(tuple(r) for r in thresholds.dynamic_chunks(df, "doc", "place", "v", 6.0, warm).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain(values, 6.0, warm)


def test_no_rows_and_values_that_are_none(spark):
    schema = "doc long, place int, v double"
    assert thresholds.dynamic_chunks(spark.createDataFrame([], schema), "doc", "place", "v", 1.0).count() == 0
    rows = [(1, 0, 5.0), (1, 1, None), (1, 2, 1.0), (1, 3, float("nan")), (1, 4, 4.0), (1, 5, float("inf"))]
    got = sorted(tuple(r) for r in thresholds.dynamic_chunks(spark.createDataFrame(rows, schema), "doc", "place", "v", 1.0).collect())
    assert got == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 1), (1, 5, 1)]
