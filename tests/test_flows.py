"""Flow fields of objects and back."""

import numpy as np

from mosaiq.operators import flows

H, W = 40, 44


def discs():
    yy, xx = np.mgrid[:H, :W]
    a = np.zeros((H, W), int)
    for k, (y, x, r) in enumerate(((9, 9, 7), (9, 23, 6), (26, 12, 8), (28, 31, 9), (9, 37, 5)), 1):
        a[((yy - y) ** 2 + (xx - x) ** 2 <= r * r) & (a == 0)] = k
    a[30, 0:3] = 9
    a[38, 40] = 8
    return a


def table(spark, a):
    return spark.createDataFrame([("i", int(y), int(x), int(a[y, x])) for y, x in np.argwhere(a)], "image string, y long, x long, label long")


def plain_heat(inside, middle):
    """Pixel by pixel."""
    heat, warmed, step = {p: 0.0 for p in inside}, set(), 0
    while True:
        heat[middle] += 1.0
        heat = {(y, x): sum(heat.get((y + j, x + i), 0.0) for j in (-1, 0, 1) for i in (-1, 0, 1)) / 9 for y, x in inside}
        if step % 10 == 0:
            warm = {p for p in inside if heat[p] > 0.00001}
            if warm == set(inside) or warm <= warmed:
                return heat
            heat = {p: heat[p] + 0.01 if p in warm else 0.0 for p in inside}
            warmed |= warm
        step += 1


def test_middles_and_fields_equal_pixel_by_pixel(spark):
    a = discs()
    labels = table(spark, a)
    middles = {r.label: (r.y, r.x) for r in flows.median_pixels(labels).collect()}
    got = {(r.y, r.x): (r.vy, r.vx) for r in flows.flow_fields(labels).collect()}
    assert len(got) == (a > 0).sum()
    for k in np.unique(a[a > 0]).tolist():
        inside = [tuple(p) for p in np.argwhere(a == k).tolist()]
        my, mx = np.median(np.array(inside), axis=0)
        assert middles[k] == min(inside, key=lambda p: ((p[0] - my) ** 2 + (p[1] - mx) ** 2, p))
        heat = plain_heat(inside, middles[k])
        for y, x in inside:
            vy, vx = (heat.get((y + 1, x), 0) - heat.get((y - 1, x), 0)) / 2, (heat.get((y, x + 1), 0) - heat.get((y, x - 1), 0)) / 2
            n = np.hypot(vy, vx)
            vy, vx, n = (0, 0, 1) if n < 1e-9 * max(heat.values()) else (vy, vx, n)
            assert abs(got[y, x][0] - vy / n) < 1e-9 and abs(got[y, x][1] - vx / n) < 1e-9


def test_labels_come_back(spark):
    a = discs()
    a[a >= 8] = 0
    labels = table(spark, a)
    back = {(r.y, r.x): r.label for r in flows.labels_of_flows(flows.flow_fields(labels), H, W).collect()}
    pairs = {(int(a[p]), v) for p, v in back.items()}
    assert len(pairs) == 5 == len({v for _, v in pairs}) and all(k > 0 for k, _ in pairs)
    assert len(back) >= 0.98 * (a > 0).sum()


def test_nothing_gives_nothing(spark):
    none = table(spark, discs()).limit(0)
    assert flows.flow_fields(none).count() == 0 == flows.labels_of_flows(flows.flow_fields(none), H, W).count()


def test_objects_of_like_boxes_go_together_in_many_tasks(spark, monkeypatch):
    """Each object was diffused alone, and all of a small table in one task."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    a = np.zeros((90, 90), int)
    for k in range(1, 82):
        y, x = (k - 1) // 9 * 10, (k - 1) % 9 * 10
        a[y : y + 3 + k % 7, x : x + 2 + k % 8] = k
    a[rng.random(a.shape) < 0.1] = 0
    labels = table(spark, a)
    want = flows.flow_fields(labels)
    assert want.select(F.spark_partition_id()).distinct().count() > 4
    want = {(r.y, r.x): (r.label, r.vy, r.vx) for r in want.collect()}
    calls = []
    monkeypatch.setattr(flows, "diffused", lambda *x, plain=flows.diffused: calls.append(1) or plain(*x))
    middles = {r.label: (r.y, r.x) for r in flows.median_pixels(labels).collect()}
    own, y, x = (c[np.argsort(a[a > 0], kind="stable")] for c in (a[a > 0], *np.nonzero(a)))
    number = np.unique(own, return_inverse=True)[1]
    middle = np.array([middles[k] for k in own.tolist()])
    together = flows._directions(y, x, number, middle, flows.Diffusion())
    assert len(calls) <= 4
    for k in np.unique(own).tolist():  # alone it is the same to the last bit
        one = own == k
        assert np.array_equal(together[one], flows._directions(y[one], x[one], number[one] * 0, middle[one], flows.Diffusion()))
    assert want == {(int(j), int(i)): (int(k), *map(float, v)) for j, i, k, v in zip(y, x, own, together, strict=True)}
    # frames that end within an object
    monkeypatch.undo()
    monkeypatch.setattr(flows, "GATHERED", 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert want == {(r.y, r.x): (r.label, r.vy, r.vx) for r in flows.flow_fields(labels).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pixels_are_not_sent_to_the_driver(spark, monkeypatch):
    """Files of a few bytes are many pixels, which all came to the driver to be sent to all tasks."""
    from mosaiq.operators import objects

    plans = []

    def seen(plain):
        return lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df)

    monkeypatch.setattr(flows, "saved", seen(flows.saved))
    monkeypatch.setattr(objects, "written", seen(objects.written))
    back = flows.labels_of_flows(flows.flow_fields(table(spark, discs())), H, W)
    plans.append(back._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) > 8 and not any("Broadcast" in p for p in plans)
