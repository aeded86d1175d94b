"""Long groups in ranges, pauses, and boxes of all sizes."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from orbitile.operators import ordered, progress, tiling


def events(n, seed=1):
    """(event_id, grp, completed_at, seconds) of one single group, with ties in time."""
    rng = random.Random(seed)
    return [(k, 7, float(rng.randint(0, n // 2)), float(rng.randint(0, 9))) for k in range(n)]


@pytest.fixture(scope="module")
def one_group(spark):
    rows = events(230)
    table = spark.createDataFrame(rows, "event_id long, grp long, completed_at double, seconds double").repartition(3)
    return sorted(rows, key=lambda r: (r[2], r[0])), table


def test_rolling(one_group):
    rows, table = one_group
    got = {r.event_id: r for r in progress.rolling_mean(table, 5, kept=8, rows_per_range=10).collect()}
    assert len(got) == len(rows)
    for k, (i, _, _, _) in enumerate(rows):
        last = [r[3] for r in rows[max(0, k - 4) : k + 1]]
        assert got[i].rolling == pytest.approx(statistics.mean(last)) and (got[i].done, got[i].kept) == (k + 1, min(8, k + 1))


def test_no_task_holds_the_group(one_group):
    """Ranges are windows of their own, each with what reaches into it."""
    _, table = one_group
    rows = ordered.placed(table, "grp", "completed_at", "event_id", rows_per_range=10)
    assert rows.groupBy("range").count().agg(F.max("count"), F.count("*")).first()[:] == (10, 23)
    plan = ordered.rolling(rows, "grp", 5, {"m": lambda w: F.avg("seconds").over(w)}, rows_per_range=10)
    windows = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
    assert len(windows) == 1 and "__in" in windows[0]
    with pytest.raises(ValueError):
        ordered.rolling(rows, "grp", 11, {}, rows_per_range=10)


def test_stalled(one_group):
    rows, table = one_group
    for threshold in (2.0, 100.0):
        got = {r.event_id: r.stalled for r in progress.stalled_runs(table, threshold=threshold, rows_per_range=10).collect()}
        run = 0
        for k, (i, _, _, s) in enumerate(rows):
            run = run + 1 if k and abs(s - rows[k - 1][3]) < threshold else 0
            assert got[i] == run


def test_remaining(one_group):
    rows, table = one_group
    got = {r.event_id: r.remaining for r in progress.remaining_seconds(table, 500, last=4, rows_per_range=10).collect()}
    for k, (i, _, t, _) in enumerate(rows):
        recent = rows[max(0, k - 3) : k + 1]
        span = (t - recent[0][2]) / (len(recent) - 1) if len(recent) > 1 else 0.0
        assert got[i] == pytest.approx((500 - k - 1) * (span if span > 0 else (t - rows[0][2]) / (k + 1)))


def test_pauses(spark, one_group):
    rows, table = one_group
    rng = random.Random(4)
    pauses = [(7, float(a), float(a + rng.randint(-1, 6))) for a in (rng.randint(0, 110) for _ in range(40))] + [(8, 1.0, 2.0)]
    df = spark.createDataFrame(pauses, "grp long, paused_at double, resumed_at double")
    paused = {x for g, a, b in pauses if g == 7 for x in range(int(a), int(b))}  # seconds, each counted once
    got = {r.event_id: r for r in progress.without_pauses(table, df, rows_per_range=10).collect()}
    for i, _, t, s in rows:
        want = float(sum(x < t for x in paused))
        assert (got[i].paused, got[i].completed_at, got[i].seconds) == (want, t - want, s)
    none = progress.without_pauses(table, df.where("false"), rows_per_range=10)
    assert none.agg(F.sum("paused"), F.count("*")).first()[:] == (0.0, len(rows))


def test_boxes_of_all_sizes(spark):
    rng = random.Random(9)

    def boxes(n):
        out = []
        for k in range(n):
            side = 2.0 ** rng.randint(-16, 8)
            x, y = rng.uniform(-180, 170), rng.uniform(-90, 80)
            if k % 3 == 0:
                x, y = 35.5 + rng.uniform(0, 0.01), 31.5 + rng.uniform(0, 0.01)  # one dense place
            out.append((k, x, y, x + side, y + side * rng.uniform(0.1, 1)))
        return [*out, (n, -180.0, -90.0, 180.0, 90.0), (n + 1, 0.0, 0.0, 0.0, 0.0)]

    a, b = boxes(150), boxes(120)
    left, right = (spark.createDataFrame(x, f"{n}_id long, lon_min double, lat_min double, lon_max double, lat_max double") for x, n in ((a, "left"), (b, "right")))
    want = {(p[0], q[0]) for p in a for q in b if p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4]}
    got = [tuple(r) for r in tiling.overlapping(left, right).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 300
    # no box stands in more than four cells of its level, the world included
    cells = tiling.celled(tiling.levelled(left, "left_id").withColumn("level", F.col("own")))
    assert cells.groupBy("left_id").count().agg(F.max("count")).first()[0] <= 4
