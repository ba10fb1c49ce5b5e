"""Operators against array code and hand-made cases."""

import io
import struct
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimark.operators import benchmarks, clusters, evaluation, events, frames, images, models, stats, temporal, windows
from regimark.sources import avi, store, tables
from regimark.streaming import frames as streaming


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def video(images_, nested=False, odd=False):
    body = b"".join(chunk(b"00db", np.repeat(i[::-1, :, None], 3, axis=2).tobytes()) for i in images_)
    if nested:
        body = chunk(b"LIST", b"rec " + body)
    if odd:
        body = chunk(b"JUNK", b"xyz") + body
    return b"RIFF" + struct.pack("<I", 0) + b"AVI " + chunk(b"LIST", b"movi" + body)


IMAGES = [np.random.default_rng(k).integers(0, 256, (8, 8)).astype(np.uint8) for k in range(3)] + [np.zeros((8, 8), np.uint8)]


@pytest.mark.parametrize("shape", [{}, {"nested": True}, {"odd": True}])
def test_video_decoding(spark, shape):
    v = spark.createDataFrame([("a", bytearray(video(IMAGES, **shape)))], "video_id string, content binary")
    got = avi.decode_frames(v, 8, 8).orderBy("frame_index").collect()
    assert [bytes(r["pixels"]) for r in got] == [i.tobytes() for i in IMAGES]


def test_short_frame_raises():
    with pytest.raises(ValueError):
        avi.frame_planes(b"1234", 0, 8, 8)
    with pytest.raises(ValueError):
        avi.movie_list(b"RIFF0000AVI ")


def test_image_paths_agree(spark):
    rows = [(k, x, y, int(i[y, x])) for k, i in enumerate(IMAGES) for y in range(8) for x in range(8)]
    p = spark.createDataFrame(rows, "frame_id int, x int, y int, level int")
    h = {r["frame_id"]: r for r in images.histogram_features(images.histogram(p)).collect()}
    b = {r["frame_id"]: r for r in images.mask_box(p, images.histogram_features(images.histogram(p))).collect()}
    m = {r["frame_id"]: r for r in images.moments(p).collect()}
    for k, image in enumerate(IMAGES):
        fast = images.frame_features(image)
        for table in (h, b, m):
            for name, value in (table[k].asDict() if k in table else {}).items():
                if name in fast:
                    assert value == pytest.approx(fast[name], abs=1e-6) if fast[name] is not None else value is None, name


def test_archives(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("DAQ_RHF_P1.csv", "﻿" + "a,b,c,d,e,f,g,h,i,j\n" + ",".join(["1"] * 10) + "\n\n" + ",".join(["2"] * 9) + "\n" + ",".join(["3"] * 11) + "\nnan" + ",4" * 9 + "\n")
    (tmp_path / "X.ZIP").write_bytes(raw.getvalue())
    a = tables.read_archives(spark, str(tmp_path))
    got = tables.measured_rows(tables.archive_numbers(a, "P1")).orderBy("frame_index").collect()
    assert [(r["frame_index"], r["x_mm"], r["y_mm"]) for r in got] == [(0, 1.0, 1.0), (1, 3.0, 3.0), (2, None, 4.0)]
    assert tables.archive_members(a).first()["kind"] == "analysis_results"


def test_feature_csvs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("video_id,frame_index,x\nv,0,1.5\nv,1,inf\n")
    got = tables.read_features(spark, str(tmp_path), ["video_id", "x"]).orderBy("frame_index").collect()
    assert [r["x"] for r in got] == [1.5, None]
    with pytest.raises(ValueError, match="lacks y"):
        tables.read_features(spark, str(tmp_path), ["y"])
    assert tables.read_report(spark, str(tmp_path / "none.csv"), "a int").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("v", 1, 2.0), ("w", 1, 3.0)], "video_id string, frame_index int, x double")
    store.write_features(df, str(tmp_path / "f"))
    store.write_features(df.filter("video_id = 'v'").withColumn("x", F.lit(9.0)), str(tmp_path / "f"))
    assert sorted((r["video_id"], r["x"]) for r in spark.read.parquet(str(tmp_path / "f")).collect()) == [("v", 9.0), ("w", 3.0)]
    assert "| v | 1 | 2 |" in store.markdown(df.orderBy("video_id"), "t")
    assert store.pgm_bytes(b"\0" * 4, 2, 2).startswith(b"P5\n2 2\n255\n")
    assert store.missing_keys(df, df.filter("x > 2"), ["video_id"]).collect()[0][0] == "v"


def test_feature_files_follow_from_bytes_not_keys(spark, tmp_path):
    path = tmp_path / "f"
    df = spark.range(3000).selectExpr("CASE WHEN id % 600 = 0 THEN NULL ELSE concat('v', id % 600) END AS video_id", "CAST(id AS INT) AS frame_index", "CAST(id AS DOUBLE) AS x")
    store.write_features(df, str(path))
    again = df.filter("video_id IS NULL OR video_id IN ('v7', 'v8')").filter("frame_index < 600").selectExpr("video_id", "frame_index", "-1.0D AS x", "1 AS more")
    store.write_features(again, str(path))
    assert sum(1 for _ in path.rglob("*.parquet")) <= 2 * store.KEY_PARTS
    got = {(r["video_id"], r["frame_index"]): (r["x"], r["more"]) for r in spark.read.option("mergeSchema", True).parquet(str(path)).collect()}
    want = {(r["video_id"], r["frame_index"]): (r["x"], None) for r in df.collect() if r["video_id"] not in (None, "v7", "v8")}
    assert got == want | {(None, 0): (-1.0, 1), ("v7", 7): (-1.0, 1), ("v8", 8): (-1.0, 1)}


def test_images_are_worked_on_in_batches_of_frames(spark):
    import struct

    import pandas as pd

    from regimark.operators import images
    from regimark.sources import avi

    class Table:  # holds what a task would run
        def mapInPandas(self, run, schema):
            self.run = run
            return self

        def select(self, *names):
            return self

        def withColumns(self, columns):
            return self

    body = bytes(range(48))
    chunk = b"00db" + struct.pack("<I", 48) + body
    movi = b"LIST" + struct.pack("<I", 4 + len(chunk)) + b"movi" + chunk
    content = b"RIFF" + struct.pack("<I", 4 + len(movi)) + b"AVI " + movi
    videos = pd.DataFrame({"video_id": [str(k) for k in range(600)], "content": [content] * 600})
    for made in (avi.decode_frames, avi.audit_frames):  # videos of a frame each share batches
        assert [len(b) for b in made(Table(), 4, 4).run(iter([videos[:300], videos[300:]]))] == [256, 256, 88]
    frames = pd.concat(avi.decode_frames(Table(), 4, 4).run(iter([videos])), ignore_index=True)
    assert [len(b) for b in images.extract_features(Table(), 4, 4).run(iter([frames]))] == [256, 256, 88]


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(1)
    step, start = np.log(temporal.TRANSITION), np.log(temporal.INITIAL)
    for n in (0, 1, 2, 6):
        p = rng.dirichlet([1, 1, 1], n)
        got = temporal.viterbi(p)
        if not n:
            assert len(got) == 0
            continue
        score = lambda s: start[s[0]] + sum(np.log(max(p[i, k], 1e-12)) for i, k in enumerate(s)) + sum(step[a, b] for a, b in zip(s, s[1:], strict=False))  # noqa: B023, E731
        best = max(score(s) for s in np.ndindex(*[3] * n))
        assert score(tuple(got)) == pytest.approx(best)
    assert list(temporal.viterbi(np.array([[0, 1, 0], [0, 0, 1], [0, 1, 0]], float) * 0.6 + 0.4 / 3)) == [1, 1, 1]


def test_events(spark):
    rows = [("a", i, i in {1, 2, 3, 7, 9, 10}, i in {3, 4, 9, 10, 14, 15}) for i in range(20)]
    f = spark.createDataFrame(rows, "video_id string, frame_index int, t boolean, p boolean")
    t, p = events.events(f, F.col("t")), events.events(f, F.col("p"))
    assert sorted((r["start"], r["end"]) for r in t.collect()) == [(1, 3), (9, 10)]
    m = events.event_metrics(t, p, 1).first()
    assert (m["true_events"], m["predicted_events"], m["detected_events"], m["false_alarm_events"], m["mean_delay_frames"]) == (2, 3, 2, 1, 1.0)
    none = events.event_metrics(t.filter("false"), p.filter("false"), 1).first()
    assert (none["event_recall"], none["mean_delay_frames"]) == (0.0, None)


def test_ranks_and_correlations(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, 200).astype(float), rng.normal(size=200)
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, x double, y double")
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    got = [r["r"] for r in stats.average_rank(d, "x", "r").orderBy("i").collect()]
    assert got == list(rank(x))
    assert stats.spearman(d, "x", "y").first()["spearman"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    assert d.agg(stats.pearson(F.lit(1.0), F.col("x")).alias("p")).first()["p"] is None


def test_mixture_finds_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(float(v),) for c in (-5, 0, 6) for v in rng.normal(c, 0.3, 150)]
    d = spark.createDataFrame(rows, "z double").cache()
    for start in (models.anchored_start(d, ["z"], "z"), models.Mixture(np.full(3, 1 / 3), models.kmeans(d, ["z"]), np.ones((3, 1)))):
        m, _ = models.fit_mixture(d, ["z"], start)
        assert sorted(m.means.ravel()) == pytest.approx([-5, 0, 6], abs=0.15)


def test_fits_have_the_starts_and_iterations_of_the_reference(spark):
    import inspect

    of = lambda f: {k: p.default for k, p in inspect.signature(f).parameters.items()}
    assert (of(models.kmeans)["seeds"], of(models.kmeans)["iterations"]) == (20, 500)
    assert (of(models.gmm)["starts"], of(models.gmm)["iterations"], of(models.fit_mixture)["iterations"]) == (5, 500, 500)
    df = spark.createDataFrame([(float(k % 7),) for k in range(50)], "z double")
    start = models.Mixture(np.array([0.5, 0.5]), np.array([[0.0], [6.0]]), np.ones((2, 1)))
    with pytest.warns(UserWarning, match="not converged"):
        models.fit_mixture(df, ["z"], start, 1)


def test_several_fits_of_one_pass_are_those_made_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(float(v), float(w), k % 3) for k, (v, w) in enumerate(zip(np.concatenate([rng.normal(c, 1, 80) for c in (-4, 0, 5)]), rng.normal(0, 1, 240), strict=True))]
    points = spark.createDataFrame(rows, "a double, b double, __fold int").cache()
    jobs = [models.Job(seed=1), models.Job(left_out=2, seed=5), models.Job(shift=np.array([1.0, 0.0]), scale=np.array([2.0, 3.0]), seed=9)]
    together = models.kmeans_fits(points, ["a", "b"], jobs)
    soft = models.mixture_fits(points, ["a", "b"], jobs, [m for _, _, m in together])
    for job, (centres, cost, begun), (mixture, _) in zip(jobs, together, soft, strict=True):
        alone = models.kmeans_fits(points, ["a", "b"], [job])[0]
        assert np.allclose(centres, alone[0]) and cost == pytest.approx(alone[1])
        x = job.rows(np.array([r[:2] for r in rows]), np.array([r[2] for r in rows]))
        label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)  # a fixed point of plain k-means
        assert np.allclose(centres, [x[label == k].mean(0) for k in range(3)], atol=1e-2)
        m, last = begun, -np.inf  # plain expectation maximisation
        for _ in range(500):
            logs = np.stack([np.log(w) - 0.5 * np.log(2 * np.pi * v).sum() - ((x - mu) ** 2 / (2 * v)).sum(1) for w, mu, v in zip(m.weights, m.means, m.variances, strict=True)], 1)
            norm = np.logaddexp.reduce(logs, axis=1)
            r = np.exp(logs - norm[:, None])
            mu = (r.T @ x) / r.sum(0)[:, None]
            m = models.Mixture(r.mean(0), mu, np.maximum((r.T @ (x * x)) / r.sum(0)[:, None] - mu * mu, 0) + models.REG)
            if abs(norm.mean() - last) < 1e-3:
                break
            last = norm.mean()
        assert np.allclose(m.means, mixture.means, atol=1e-6) and np.allclose(m.variances, mixture.variances, atol=1e-6)


def test_rows_are_judged_without_their_fold(spark):
    rng = np.random.default_rng(5)
    made = [(k, float(c + v), float(c - v) if k % 11 else None, k % 5) for k, (c, v) in enumerate(zip(np.tile([0.0, 10.0, 20.0], 60), rng.normal(0, 0.5, 180), strict=True))]
    ask = lambda rows: {(r["model"], r["seed"], r["id"]): (r["p_low"], r["p_nominal"], r["p_high"], r["label"]) for r in models.out_of_fold(spark.createDataFrame(rows, "id int, a double, b double, f int"), ["a", "b"], "f", ["id"], seeds=(42,), starts={"kmeans": 3, "gmm": 2}).collect()}
    got = ask(made)
    assert len(got) == 2 * 180 and all(v[3] == k[2] % 3 for k, v in got.items() if k[2] % 11)
    other = ask(made + [(1000 + k, 1e4 * k, -1e4, 0) for k in range(1, 9)])  # junk in fold 0 changes nothing for fold 0
    assert all(other[k] == pytest.approx(v) for k, v in got.items() if k[2] % 5 == 0)
    assert any(other[k] != pytest.approx(v) for k, v in got.items() if k[2] % 5)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(6)
    x, y = np.round(rng.normal(size=3000), 2), np.where(rng.random(3000) < 0.5, 7.0, rng.normal(size=3000) * 1e6)
    d = spark.createDataFrame([(float(a), float(b) if k % 3 else None, None) for k, (a, b) in enumerate(zip(x, y, strict=True))], "a double, b double, c double")
    some = y[np.arange(3000) % 3 > 0]
    for keep in (1, 40, 5000):
        got = stats.quantiles(d, [("a", 0.5), ("b", 0.0), ("b", 0.37), ("a", 1.0), ("c", 0.5), ("b", 0.9)], keep=keep)
        assert got[4] is None
        assert got[:4] + got[5:] == pytest.approx([np.quantile(x, 0.5), some.min(), np.quantile(some, 0.37), x.max(), np.quantile(some, 0.9)])


def test_decoding_in_blocks_is_decoding_by_segment(spark, monkeypatch):
    from regimark.operators import temporal

    rng = np.random.default_rng(7)
    p = rng.dirichlet([1, 1, 1], 400)
    starts = np.unique(np.concatenate([[0], rng.integers(0, 400, 60)]))
    emit = temporal.fixed(p)
    best, back = temporal.forward(emit, starts, (temporal.START + emit[starts])[:, None, :])
    assert (temporal.backward(back, starts, best[:, 0].argmax(axis=1)[:, None])[:, 0] == np.concatenate([temporal.viterbi(part) for part in np.split(p, starts[1:])])).all()
    rows = [(v if v else None, int(i), *map(float, q)) for v in range(6) for i, q in zip(np.cumsum(rng.integers(1, 3, 50)), rng.dirichlet([1, 1, 1], 50), strict=True)]
    d = spark.createDataFrame(rows, "video_id long, frame_index long, p_low double, p_nominal double, p_high double")
    want = {}
    for v in range(6):
        own = [r for r in rows if r[0] == (v or None)]
        cuts = [k for k in range(1, len(own)) if own[k][1] - own[k - 1][1] > 1]
        for s, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(own)], strict=True)):
            for r, state in zip(own[a:b], temporal.viterbi(np.array([r[2:] for r in own[a:b]])), strict=True):
                want[r[:2]] = (s, int(state))
    for block in (1, 7, 70, 20_000):
        monkeypatch.setattr(temporal, "BLOCK", block)
        assert {(r["video_id"], r["frame_index"]): (r["segment"], r["temporal_label"]) for r in temporal.decode(d).collect()} == want


def test_blank_frames_have_moments(spark):
    pixels = [("blank", x, y, 0) for x in range(4) for y in range(4)] + [("lit", x, y, 9 * (x == y)) for x in range(4) for y in range(4)]
    got = {r["frame_id"]: r for r in images.moments(spark.createDataFrame(pixels, "frame_id string, x int, y int, level int")).collect()}
    assert got["blank"]["centroid_x"] is None and got["blank"]["major_sigma"] == got["blank"]["outer_intensity_fraction"] == 0
    assert got["lit"]["centroid_x"] == 1.5 and images.frame_features(np.zeros((4, 4), np.uint8))["major_sigma"] == 0


def test_every_broken_member_is_told(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for n in "abc":
            z.writestr(f"{n}.csv", f"{n},1,2\n" * 50)
    raw = bytearray(path.read_bytes())
    for n in b"ac":
        raw[raw.index(bytes([n]) + b",1,2")] = ord("z")
    path.write_bytes(raw)
    got = {r["member"]: r["crc_ok"] for r in tables.archive_members(tables.read_archives(spark, str(tmp_path))).collect()}
    assert got == {"a.csv": False, "b.csv": True, "c.csv": False}


def test_silhouette(spark):
    rows = [(i, float(v), int(v > 2)) for i, v in enumerate([0, 0.1, 0.2, 5, 5.1, 5.2])]
    d = spark.createDataFrame(rows, "i int, z double, label int")
    s = clusters.silhouette(d, ["z"], "label", "i").first()["silhouette"]
    x, c = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    want = []
    for i in range(6):
        a = np.abs(x[(c == c[i])] - x[i]).sum() / 2
        b = np.abs(x[c != c[i]] - x[i]).mean()
        want.append((b - a) / max(a, b))
    assert s == pytest.approx(np.mean(want))


def test_positions_must_agree(spark):
    a = spark.createDataFrame([("v", 0), ("v", 1)], "video_id string, frame_index int")
    with pytest.raises(ValueError):
        frames.zipped(a, a.filter("frame_index = 0").withColumn("q", F.lit(1)))


def test_streams_equal_batches(spark, tmp_path):
    rows = [("a", i, float((i * 7) % 5), i % 4 > 1) for i in range(30)]
    schema = "video_id string, frame_index long, intensity double, hit boolean"
    d = spark.createDataFrame(rows, schema)
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, make in (("features", lambda s: streaming.stream_features(s)), ("events", lambda s: streaming.stream_events(s, "hit"))):
        q = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    got = {r["frame_index"]: (r["delta"], r["rolling_mean"]) for r in spark.table("features").collect()}
    want = d.withColumns({"delta": windows.delta("intensity"), "m": windows.trailing_mean("intensity")}).collect()
    assert all(got[r["frame_index"]] == pytest.approx((r["delta"], r["m"])) for r in want)
    batch = {(r["start"], r["end"]) for r in events.events(d, F.col("hit")).collect()}
    closed = {(r["start"], r["end"]) for r in spark.table("events").collect()}
    assert closed == {e for e in batch if e[1] < 29}


def test_overlaps_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    made = [[(v, int(a), int(a + n)) for v in "ab" for a, n in zip(np.cumsum(rng.integers(3, 40, 30)), rng.integers(0, 90, 30), strict=True)] for _ in range(2)]
    true, predicted = (spark.createDataFrame(m, "video_id string, start long, end long") for m in made)
    want = {(v, a, b, c, d) for v, a, b in made[0] for w, c, d in made[1] if v == w and a <= d and c <= b}
    for width in (1, 7, 1024):
        got = [tuple(r) for r in events.matches(true, predicted, width).collect()]
        assert len(got) == len(want) and set(got) == want
    assert events.detected(true, predicted).count() == len({w[:3] for w in want})
    assert {tuple(r) for r in events.false_alarms(true, predicted).collect()} == set(made[1]) - {(w[0], w[3], w[4]) for w in want}
    none = true.limit(0)
    assert events.matches(true, none).count() == 0 and events.false_alarms(none, predicted).count() == len(made[1])


def test_unequal_planes_are_told(spark):
    planes = np.full((2, 2, 3), 10, np.uint8)
    planes[0, 1] = (10, 11, 13)
    body = b"".join(r.tobytes().ljust(8, b"\0") for r in planes[::-1])
    movi = chunk(b"LIST", b"movi" + chunk(b"00db", body))
    data = chunk(b"RIFF", b"AVI " + movi)
    got = avi.audit_frames(spark.createDataFrame([("v", bytearray(data))], "video_id string, content binary"), 2, 2).collect()
    assert [(bytes(r["grey"]), r["unequal"], r["unequal_fraction"]) for r in got] == [(bytes([10, 11, 10, 10]), 1, 0.25)]


def test_streamed_features_over_several_batches(spark, tmp_path):
    rows = [("a", i, (i * 7) % 5, float((i * 3) % 11), (i * 5) % 13, None if i == 9 else float(i % 4), float(i % 3)) for i in range(30)]
    schema = "video_id string, frame_index long, threshold_area long, mean_intensity double, total_intensity long, centroid_x double, centroid_y double"
    d = spark.createDataFrame(rows, schema)
    for k in range(3):
        d.filter(F.col("frame_index").between(10 * k, 10 * k + 9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.stream_temporal(stream).writeStream.format("memory").queryName("temporal").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["frame_index"]: r for r in spark.table("temporal").collect()}
    want = windows.with_temporal(d).collect()
    names = [c for c in spark.table("temporal").columns if c not in ("video_id", "frame_index")]
    assert len(got) == 30
    for r in want:
        assert [got[r["frame_index"]][n] for n in names] == pytest.approx([r[n] for n in names], abs=1e-9)


def test_a_quiet_stream_gives_its_last_event(spark, tmp_path):
    schema = "video_id string, frame_index long, hit boolean"
    spark.createDataFrame([("a", i, i > 2) for i in range(6)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streaming.stream_events(stream, "hit", quiet_ms=1000).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            if spark.table("quiet").count():
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert [tuple(r) for r in spark.table("quiet").collect()] == [("a", 3, 5)]


def test_latency(spark):
    ran = []
    samples = benchmarks.timed(spark, "x", 10, lambda: ran.append(1), 4)
    row = benchmarks.latency_table(samples).first()
    assert len(ran) == 5 and row["repetitions"] == 4 and row["median_us_per_frame"] == pytest.approx(100 * row["median_total_ms"])


def test_points_and_bars(spark):
    m = spark.createDataFrame([("d", "p_0.9", 0.5), ("d", "raw", 0.1), ("d", "p_0.3", 0.2)], "definition string, method string, precision double").withColumns({c: F.lit(0.0) for c in ("recall", "f1", "false_positive_rate")})
    assert [(r["threshold"], r["precision"]) for r in evaluation.precision_recall_points(m).collect()] == [(0.3, 0.2), (0.9, 0.5)]
    assert [tuple(r) for r in evaluation.bars(m, "method", {"definition": "d"}, ["precision"]).collect()][0] == ("method", "p_0.9", "precision", 0.5)


def test_stored_tables_are_dropped(spark):
    kept = store.stored(spark.range(3), "short-lived")
    assert kept.count() == 3
    store.drop_stored(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|NOT_FOUND|does not exist"):
        kept.count()


def test_decoding_of_a_long_video_with_ties(spark, monkeypatch):
    """One video, equal probabilities and flicker in stretches, so that many paths tie over the borders of blocks."""
    from regimark.operators import temporal

    rng = np.random.default_rng(8)
    few = np.array([[1 / 3] * 3, [0.5, 0, 0.5], [0, 0, 1], [1, 0, 0], [0.0] * 3, [0.4, 0.6, 0.0]])
    p = few[np.repeat(rng.integers(0, len(few), 300), rng.integers(1, 12, 300))]
    frame = np.arange(len(p)) - 500  # negative numbers too
    frame[900:] += 3
    d = spark.createDataFrame([("hot", int(i), *map(float, q)) for i, q in zip(frame, p, strict=True)], "video_id string, frame_index int, p_low double, p_nominal double, p_high double")
    want = np.concatenate([temporal.viterbi(p[:900]), temporal.viterbi(p[900:])])
    for block in (7, 64):
        monkeypatch.setattr(temporal, "BLOCK", block)
        got = temporal.decode(d.repartition(5)).orderBy("frame_index").collect()
        assert [r["temporal_label"] for r in got] == want.tolist()
        assert [r["segment"] for r in got] == [0] * 900 + [1] * (len(p) - 900)
    assert temporal.decode(d.filter("false")).count() == 0


def test_arrays_of_all_types_come_back(spark, tmp_path):
    from regimark.sources import arrays

    spark.dataSource.register(arrays.ArrayFiles)
    rng = np.random.default_rng(9)
    n = 1000
    made = {k: rng.integers(0, 2, n).astype(k) for k in ("?", "i1", "u1", "i2", "u2", "i4", "u4", "i8", "f2", "f4", "f8", ">i4", ">f8")} | {"text": np.array(["é" * (k % 4) for k in range(n)]), "two": rng.random((n, 3)).astype("f4")}
    made = {f"c{k}": v for k, v in enumerate(made.values())}
    np.savez(tmp_path / "plain.npz", **made)
    np.savez_compressed(tmp_path / "small.npz", **made)
    for name, parts in (("plain", 10), ("small", 1)):
        back = spark.read.format("array_files").option("path", str(tmp_path / f"{name}.npz")).option("rowsPerPartition", 100).option("fileColumns", "true").load()
        assert back.rdd.getNumPartitions() == parts  # tasks share what isn't compressed
        pdf = back.toPandas().sort_values("row")
        for c, v in made.items():
            got = np.stack(pdf[c].to_numpy()) if v.ndim == 2 else pdf[c].to_numpy()
            assert (got == v).all(), c
    np.save(tmp_path / "one.npy", made["c10"])
    one = spark.read.format("array_files").option("path", str(tmp_path / "one.npy")).load()
    assert one.columns == ["one"] and one.count() == n
    rows = spark.createDataFrame([(k, float(k) if k % 2 else None, "x" * k, [1.0, 2.0 * k], k % 3 == 0) for k in range(25)], "k long, f float, s string, a array<double>, b boolean")
    rows.repartition(2).write.format("array_files").mode("append").option("path", str(tmp_path / "out")).option("rowsPerFile", 4).save()
    again = spark.read.format("array_files").option("path", str(tmp_path / "out")).load()
    plain = lambda r: (r["k"], None if r["f"] is None or r["f"] != r["f"] else r["f"], r["s"], r["a"], r["b"])
    assert sorted(map(plain, again.collect())) == sorted(map(plain, rows.collect()))
    assert max(len(np.load(f)["k"]) for f in (tmp_path / "out").glob("*.npz")) == 4
    with pytest.raises(Exception, match="has no NULL"):
        spark.createDataFrame([(None,)], "k long").write.format("array_files").mode("append").option("path", str(tmp_path / "bad")).save()
    assert not list((tmp_path / "bad").glob("*.npz")) if (tmp_path / "bad").exists() else True
    np.savez(tmp_path / "fortran.npz", a=np.asfortranarray(np.ones((3, 2))))
    with pytest.raises(Exception, match="by columns"):
        spark.read.format("array_files").option("path", str(tmp_path / "fortran.npz")).load().count()


def test_a_large_video_is_read_by_several_tasks(spark, tmp_path):
    from regimark.plans import source_queries
    from regimark.sources import avi, ranges

    rng = np.random.default_rng(10)
    vectors = spark.createDataFrame([(k, rng.random(64).tolist()) for k in range(64)], "vec_id long, embedding array<double>")
    files = source_queries._video_files(vectors)
    ranges.write_files(files, str(tmp_path))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["v0.avi"]
    index = avi.frame_index(avi.list_videos(spark, str(tmp_path)))
    got = avi.read_frames(index, 8, 8, stretch=1500)
    dealt = got.withColumn("part", F.spark_partition_id()).select("part").distinct().count()
    assert dealt > 1
    whole = avi.decode_frames(files.select(F.lit("v0").alias("video_id"), "content"), 8, 8)
    key = lambda r: (r["frame_index"], bytes(r["pixels"]), r["unequal"])
    assert sorted(map(key, got.collect())) == sorted(map(key, whole.collect()))
    with pytest.raises(Exception, match="shorter than its image"):
        avi.read_frames(index, 9, 9).collect()
    (tmp_path / "none.avi").write_bytes(b"RIFF\4\0\0\0AVI ")
    with pytest.raises(Exception, match="no list of frames"):
        avi.frame_index(avi.list_videos(spark, str(tmp_path))).collect()


def test_small_files_share_tasks(spark, tmp_path):
    from regimark.plans import source_queries
    from regimark.sources import avi, ranges

    cores = spark.sparkContext.defaultParallelism
    most = ranges.TASKS_A_CORE * cores
    rng = np.random.default_rng(13)
    vectors = spark.createDataFrame([(64 * k + j, rng.random(64).tolist()) for k in range(10 * most) for j in range(3)], "vec_id long, embedding array<double>")
    files = source_queries._video_files(vectors)
    ranges.write_files(files, str(tmp_path))
    index = avi.frame_index(avi.list_videos(spark, str(tmp_path)))
    assert len(index.inputFiles()) <= most
    assert avi.frame_index(avi.list_videos(spark, str(tmp_path)).select("path")).count() == index.count()
    got = avi.read_frames(index, 8, 8, stretch=200)
    assert got.rdd.getNumPartitions() <= most
    whole = avi.decode_frames(files.select(F.regexp_extract("name", "(.*)[.]avi", 1).alias("video_id"), "content"), 8, 8)
    key = lambda r: (r["video_id"], r["frame_index"], bytes(r["pixels"]), r["unequal"])
    assert sorted(map(key, got.collect())) == sorted(map(key, whole.collect()))
    for k in range(5 * most):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr("m.csv", str(k))
    archives = tables.archive_index(tables.list_archives(spark, str(tmp_path)))
    assert archives.count() == 5 * most and len(archives.inputFiles()) <= most
    # All files where they are few; bytes decide where there are many, and pieces a little.
    assert [ranges.task_count(spark, *of) for of in ((0, None), (3, 1 << 40), (most + 1, 1), (1_000_000, 1 << 40))] == [0, 3, most, (1 << 14) + 1000]


def test_members_are_read_as_streams(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "Big.ZIP", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/m.csv", "﻿h,i\r\n" + "".join(f"{k},{k / 2}\r\n" for k in range(25_000)) + 'x,1\r\n"7","8",9\r\n')
        z.writestr("n.csv", b"1,2\n\xff,3\n4,5,6\n")
        z.writestr("empty.csv", "")
        z.writestr("dir/", "")
    a = tables.list_archives(spark, str(tmp_path))
    assert sorted((r["member"], r["size"] > 0) for r in tables.archive_index(a).collect()) == [("a/m.csv", True), ("empty.csv", False), ("n.csv", True)]
    got = tables.archive_numbers(a, "csv$", 2).orderBy("member", "row").collect()
    assert [r["numbers"] for r in got if r["member"] == "n.csv"] == [[1.0, 2.0], [4.0, 5.0]]
    big = [r for r in got if r["member"] == "a/m.csv"]
    assert [r["row"] for r in big] == list(range(25_001)) and big[-1]["numbers"] == [7.0, 8.0] and big[9]["numbers"] == [9.0, 4.5]
    assert {tuple(r["numbers"]) for r in tables.archive_numbers(a, "^n", None).collect()} == {(1.0, 2.0), (4.0, 5.0)}
    assert all(r["crc_ok"] for r in tables.archive_members(a).collect())


def test_long_videos_in_stretches(spark):
    from regimark.operators import spread

    rng = np.random.default_rng(11)
    rows = []
    for video, n, step in (("dense", 300, 2), ("sparse", 60, 90), (None, 40, 3), ("one", 1, 2)):
        numbers = np.cumsum(rng.integers(1, step, n)) - 50
        rows += [(video, int(k), *map(float, rng.normal(0, 1, 5)), bool(rng.random() < 0.7)) for k in numbers]
    names = ["threshold_area", "mean_intensity", "total_intensity", "centroid_x", "centroid_y"]
    d = spark.createDataFrame(rows, "video_id string, frame_index int, " + ", ".join(f"{c} double" for c in names) + ", hit boolean").repartition(6)
    key = lambda r: (repr(r["video_id"]), r["frame_index"])
    whole = sorted(windows.with_temporal(d).collect(), key=key)
    segments = sorted(map(tuple, windows.gap_segments(d).select("video_id", "frame_index", "segment").collect()), key=repr)
    found = sorted(map(tuple, events.events(d, F.col("hit")).collect()), key=repr)
    for stretch in (1, 7, 64, 100_000):
        got = sorted(spread.temporal_features(d, stretch=stretch).collect(), key=key)
        assert len(got) == len(rows)
        for a, b in zip(got, whole, strict=True):
            assert a["video_id"] == b["video_id"] and a["hit"] == b["hit"]
            assert list(a)[1:] == pytest.approx(list(b)[1:], rel=1e-9, abs=1e-9)
        assert sorted(map(tuple, spread.gap_segments(d, stretch=stretch).select("video_id", "frame_index", "segment").collect()), key=repr) == segments
        assert sorted(map(tuple, spread.events(d, F.col("hit"), stretch=stretch).select("video_id", "start", "end").collect()), key=repr) == found
    # One frame a stretch of 1: every task has a frame and its halo.
    most = spread.with_halo(d, 10, 64).groupBy("video_id", "__stretch").count().agg(F.max("count")).first()[0]
    assert most <= 64 + 10


def test_quantiles_end_on_any_values(spark):
    rng = np.random.default_rng(12)
    columns = {
        "far": np.append(rng.random(999), 1e300), "wide": np.append(rng.choice([-1.7e308, 1.7e308], 998), [0.0, 5e-324]), "equal": np.full(1000, 3.25),
        "ratios": 10.0 ** rng.uniform(-300, 300, 1000) * rng.choice([-1, 1], 1000), "close": 1 + np.arange(1000) * 2.0**-50, "tiny": rng.integers(0, 5, 1000) * 5e-324,
        "odd": np.concatenate([rng.normal(0, 1, 900), [np.inf] * 40, [-np.inf] * 30, [np.nan] * 30]), "none": np.full(1000, np.nan),
    }
    d = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values(), strict=True)], ", ".join(f"{c} double" for c in columns))
    wanted = [(c, q) for c in columns for q in (0.0, 0.25, 0.9, 1.0)]
    for (c, q), got in zip(wanted, stats.quantiles(d, wanted, keep=5), strict=True):
        x = np.sort(columns[c][np.isfinite(columns[c])])
        if not len(x):
            assert got is None
            continue
        low = x[int((len(x) - 1) * q)]
        high = x[min(int((len(x) - 1) * q) + 1, len(x) - 1)]
        assert low <= got <= high, (c, q)


def test_starts_from_all_rows_find_small_clusters(spark):
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(0, 1, (6000, 2)), rng.normal(60, 0.2, (12, 2)), rng.normal((-50, 70), 0.2, (8, 2))])
    points = spark.createDataFrame([(*map(float, r), -1) for r in x[rng.permutation(len(x))]], "a double, b double, __fold int").repartition(5).cache()
    jobs = [models.Job(seed=s) for s in range(4)]
    starts = models._starts(points, ["a", "b"], jobs, 3, 2)
    cost = lambda c: ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()
    best = cost(np.array([[0, 0], [60, 60], [-50, 70]]))
    few = x[rng.choice(len(x), 200, replace=False)]  # starts from a sample miss the small ones
    sample = [models._weighted_centres(few, np.ones(200), 3, s) for s in range(4)]
    for c, other in zip(starts, sample, strict=True):
        assert cost(c) < 1.1 * best and cost(c) <= cost(other)
    again = models._starts(points, ["a", "b"], jobs[1:2], 3, 2)[0]
    assert np.allclose(again, starts[1])  # whatever other jobs share the passes
    assert models._starts(points.filter("false"), ["a", "b"], jobs[:1], 3, 2)[0].shape == (3, 2)


def test_bootstrap_of_groups_of_any_size(spark):
    rng = np.random.default_rng(14)
    groups = {"small": rng.normal(5, 2, 40), "large": rng.exponential(3, 20_000).round(2), "one": np.array([7.0]), "same": np.full(1000, 2.0), "none": np.array([np.nan])}
    d = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("small", None)], "g string, v double")
    got = {r["g"]: r for r in stats.bootstrap_interval(d.repartition(5), "g", "v", 1000).collect()}
    for k in ("small", "large"):
        x = groups[k]
        means = np.array([rng.choice(x, len(x)).mean() for _ in range(1000)])
        assert got[k]["mean"] == pytest.approx(x.mean())
        for end, q in (("low", 0.025), ("high", 0.975)):  # four errors of the two simulations
            assert got[k][end] == pytest.approx(np.quantile(means, q), abs=8 * means.std() / np.sqrt(1000) * 2.7)
    assert (got["one"]["low"], got["one"]["high"]) == (7.0, 7.0) and got["same"]["low"] == pytest.approx(2.0)
    assert got["none"]["mean"] is None and got["none"]["low"] is None
    other = {r["g"]: r for r in stats.bootstrap_interval(d.repartition(2), "g", "v", 1000, held_keys=1).collect()}
    assert other["large"]["low"] == pytest.approx(got["large"]["low"], rel=1e-12)  # however rows are dealt


def test_runs_are_evaluated_apart(spark):
    from regimark.operators import evaluation

    rng = np.random.default_rng(15)
    rows = [(m, s, v, i, float(rng.normal()), float(rng.random()), int(rng.integers(3)), int(rng.integers(3))) for m in ("gmm", "kmeans") for s in (1, 2) for v in range(2) for i in range(30)]
    d = spark.createDataFrame(rows, "model string, seed int, video_id long, frame_index long, power double, p_high double, label int, temporal_label int").cache()
    runs = evaluation.evaluate_runs(d, ["model", "seed"], intervals=False).cache()
    got = {(r["model"], r["seed"]): r for r in runs.collect()}
    assert sorted(got) == [("gmm", 1), ("gmm", 2), ("kmeans", 1), ("kmeans", 2)]
    for key, r in got.items():
        own = np.array([x[4:] for x in rows if x[:2] == key])
        high = own[:, 0] >= np.quantile(own[:, 0], 0.9)
        assert r["active_frames"] == 60 and r["top_10pct_power_high_regime_recall_raw"] == pytest.approx((own[high, 2] == 2).mean())
    summary = {r["model"]: r for r in evaluation.runs_summary(runs, ["model"]).collect()}
    for m in ("gmm", "kmeans"):
        x = [got[m, s]["p_high_power_spearman_frame"] for s in (1, 2)]
        assert summary[m]["runs"] == 2 and summary[m]["p_high_power_spearman_frame_mean"] == pytest.approx(np.mean(x)) and summary[m]["p_high_power_spearman_frame_std"] == pytest.approx(np.std(x))


def test_quantiles_of_large_and_small_groups(spark):
    rng = np.random.default_rng(16)
    groups = {"hot": rng.normal(0, 1, 2000).round(2), None: rng.random(7), "one": np.array([4.0]), "same": np.full(50, -1.0), "none": np.array([np.nan])}
    d = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("one", None)], "g string, v double").repartition(4)
    got = {r["g"]: r for r in stats.quantiles_by(d, ["g"], "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        want = [None] * 4 if np.isnan(x).any() else list(np.quantile(x, [0, 0.37, 0.5, 1]))
        assert [got[k][c] for c in "abcd"] == (want if want[0] is None else pytest.approx(want)), k


def test_average_rank_of_frequent_values(spark, monkeypatch):
    x = [1.0] * 50 + [2.0, 3.0, 3.0, None] + [0.5] * 20
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double")
    for most in (1, 10_000):
        monkeypatch.setattr(stats, "FREQUENT", most)
        got = {r["i"]: r["r"] for r in stats.average_rank(d, "v", "r").collect()}
        values = [v for v in x if v is not None]
        assert got == {i: None if v is None else sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for i, v in enumerate(x)}


def test_equal_rows_are_one_row_with_their_number(spark):
    rows = spark.createDataFrame([(float(k % 7), float(k % 3)) for k in range(840)], "a double, b double")
    points = models._points(rows, ["a", "b"])
    assert points.count() == 21 and points.agg(F.sum("__n")).first()[0] == 840
    begin = [np.array([[0.0, 0.0], [3.0, 1.0], [6.0, 2.0]])]
    plain = rows.withColumn("__fold", F.lit(-1))
    a, b = (models.kmeans_fits(p, ["a", "b"], [models.Job()], begin=begin)[0] for p in (points, plain))
    assert np.allclose(a[0], b[0]) and a[1] == pytest.approx(b[1])


def _jobs(spark, tag, work):
    spark.sparkContext.setJobGroup(tag, tag)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_all_runs_are_evaluated_in_the_same_passes(spark):
    rng = np.random.default_rng(17)
    rows = [(None if s == 3 else "m", s, v, 2 * i if i > 20 else i, float(rng.integers(9)) if i % 7 else None, float(rng.integers(5)) if i % 5 else None, int(rng.integers(3)), int(rng.integers(3))) for s in range(6) for v in range(2) for i in range(30)]
    d = spark.createDataFrame(rows, "model string, seed int, video_id long, frame_index long, power double, p_high double, label int, temporal_label int").cache()
    d.count()
    ask = lambda runs: evaluation.evaluate_runs(d.filter(F.col("seed") < runs), ["model", "seed"]).collect()
    (two, few), (six, many) = _jobs(spark, "two", lambda: ask(2)), _jobs(spark, "six", lambda: ask(6))
    assert {(r["model"], r["seed"]) for r in six} == {(None if k == 3 else "m", k) for k in range(6)}
    assert len(two) == 2 and many <= few + 10  # each run had some dozens of its own
    for r in [r for r in six if r["seed"] in (3, 4)]:
        alone = evaluation.evaluate_run(d.filter(F.col("seed") == r["seed"]).drop("model", "seed")).first()
        assert r["active_frames"] == 60
        assert [r[c] for c in alone.__fields__] == pytest.approx([alone[c] for c in alone.__fields__], nan_ok=True)
        parts = evaluation.part_table(d.filter(F.col("seed") == r["seed"]).drop("model", "seed")).collect()
        within = {w["video_id"]: w["spearman"] for w in stats.spearman_within(d.filter(F.col("seed") == r["seed"]), "p_high", "power", ["video_id"]).collect()}
        assert {p["video_id"]: p["p_high_power_spearman"] for p in parts} == pytest.approx(within)
    none = evaluation.evaluate_run(d.filter("false").drop("model", "seed"), intervals=False).first()
    assert none["active_frames"] == 0 and none["monotonic_part_fraction"] is None
    with pytest.raises(ValueError):
        evaluation.evaluate_runs(d.filter("false"), ["model", "seed"])


def test_correlations_of_groups(spark, monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(18)
    rows = [(g, float(x), float(x + y)) for g in (None, "a", "b") for x, y in zip(rng.integers(0, 9, 80), rng.integers(0, 9, 80), strict=True)] + [("c", 1.0, 2.0)] * 5
    d = spark.createDataFrame(rows, "g string, x double, y double")
    for most in (3, 10_000):  # ranks that are broadcast
        monkeypatch.setattr(stats, "FREQUENT", most)
        got = {r["g"]: (r["n"], r["spearman"]) for r in stats.spearman(d, "x", "y", ("g",)).collect()}
        assert got.pop("c") == (5, None)
        for g, found in got.items():
            own = pd.DataFrame([r[1:] for r in rows if r[0] == g])
            assert found == (80, pytest.approx(own.corr("spearman").iloc[0, 1]))
    assert len(got) == 3 and stats.spearman(d.filter("false"), "x", "y").first().asDict() == {"n": 0, "spearman": None}


def test_runs_are_decoded_together_with_their_columns(spark, monkeypatch):
    rng = np.random.default_rng(19)
    rows = [(m, v, int(i), *map(float, q), f"{m}{i}") for m in ("a", None) for v in (0, 1) for i, q in zip(np.cumsum(rng.integers(1, 3, 40)), rng.dirichlet([1, 1, 1], 40), strict=True)]
    d = spark.createDataFrame(rows, "m string, video_id long, frame_index int, p_low double, p_nominal double, p_high double, note string")
    for block in (7, 20_000):
        monkeypatch.setattr(temporal, "BLOCK", block)
        got = {(r["m"], r["video_id"], r["frame_index"]): (r["segment"], r["temporal_label"], r["p_high"], r["note"]) for r in temporal.decode(d, by=("m",), keep=("p_high", "note")).collect()}
        want = {}
        for m in ("a", None):
            kept = {r[1:3]: r[5:] for r in rows if r[0] == m}
            for r in temporal.decode(d.filter(F.col("m").eqNullSafe(m))).collect():
                want[m, r["video_id"], r["frame_index"]] = (r["segment"], r["temporal_label"], *kept[r["video_id"], r["frame_index"]])
        assert got == want and len(got) == 160


def test_medians_by_bits_and_draws_by_tables(spark):
    rng = np.random.default_rng(20)
    x = np.concatenate([rng.normal(0, 1e3, 300).round(1), rng.choice([0.0, -0.0, 5e-324, -7.0], 101), [np.nan, np.inf]])
    fold = rng.integers(0, 3, len(x))
    d = spark.createDataFrame([(float(v), int(f), float(1 + f)) for v, f in zip(x, fold, strict=True)], "a double, __fold int, __n double").repartition(3)
    got = models._medians(d, ["a"], [models.Job(k) for k in (0, 1, 2, 9)], 2, lambda j, rows: np.column_stack([rows[:, 0], rows[:, 0] ** 2]))
    for k, (median, of_squares) in zip((0, 1, 2, 9), got, strict=True):
        own = np.repeat(x, 1 + fold)[np.repeat(fold != k, 1 + fold)]
        own = own[np.isfinite(own)]
        assert (median, of_squares) == (np.median(own), np.median(own**2))
    assert models._medians(d.filter("false"), ["a"], [models.Job()], 1, lambda j, rows: rows) == [[None]]
    for mean in (1, 3, stats.TABLED, stats.TABLED + 1):
        drawn = stats._weights(np.random.default_rng(np.random.Philox(key=[1, mean])), mean, 200_001)
        assert drawn.mean() == pytest.approx(mean, abs=5 * np.sqrt(mean / 200_000)) and drawn.var() == pytest.approx(mean, rel=0.03)
        assert (drawn == 0).mean() == pytest.approx(np.exp(-mean), abs=0.006)
