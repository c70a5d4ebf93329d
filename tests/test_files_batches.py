"""Image files of a few pixels share batches; images may spread over batches."""

import random

from pixelloom.sources import formats


def test_many_small_and_spread_images(spark, monkeypatch):
    monkeypatch.setattr(formats, "BATCH", 40)
    rng = random.Random(8)
    px = {}
    for i in range(60):
        w, h = rng.choice([(1, 1), (3, 2), (8, 8), (40, 30)])
        px |= {(i, x, y): tuple(rng.randrange(256) for _ in range(4)) for x in range(w) for y in range(h) if rng.random() < 0.8 or (x, y) == (w - 1, h - 1)}
    rows = [(*k, *v) for k, v in px.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        files = formats.encoded(df, None)
        assert "FlatMapGroupsInPandas" not in files._jdf.queryExecution().executedPlan().toString()  # a call for each image
        files = spark.createDataFrame([(str(r.image_id), bytes(r.content)) for r in files.collect()], "path string, content binary")
        back = formats.decoded(files).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = {i: (max(x for j, x, _ in px if j == i) + 1, max(y for j, _, y in px if j == i) + 1) for i in range(60)}
    assert {(int(r.path), r.x, r.y): (r.r, r.g, r.b, r.a) for r in back} == {(i, x, y): px.get((i, x, y), (0, 0, 0, 0)) for i, (w, h) in sizes.items() for x in range(w) for y in range(h)}
    assert len(back) == sum(w * h for w, h in sizes.values())
