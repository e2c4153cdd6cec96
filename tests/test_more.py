"""Readers, writers, registries, hashes, splits and small operators by hand; detections and shrinkage by brute force."""

import json
import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline import session
from wakeline.functions import tables
from wakeline.operators import decisions, encounters, images, models, provenance, reports, splits, tracks
from wakeline.plans import flows, model_queries
from wakeline.sources import readers, writers

DIR = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


# --- sources and sinks ----------------------------------------------------------------------------------------------


def test_corner_csv_and_curated_s6_s9(spark, tmp_path):
    (tmp_path / "b.csv").write_text("filename,class,xmin,ymin,xmax,ymax\na.jpg,boat,10,20,30,50\nb.jpg,buoy,0,0,5,5\n")
    boxes = readers.corner_csv(spark, str(tmp_path / "b.csv"))
    assert rows(boxes) == [("a.jpg", "boat", 10.0, 20.0, 20.0, 30.0), ("b.jpg", "buoy", 0.0, 0.0, 5.0, 5.0)]
    manifest = spark.createDataFrame([("x/a.jpg", 1), ("y/c.jpg", 2)], "path string, n int")
    assert rows(readers.curated(manifest, boxes), "image", "n") == [("a.jpg", 1)]


def test_days_s11(spark):
    assert [str(r.day) for r in readers.day_range(spark, "2023-05-30", "2023-06-02").collect()] == ["2023-05-30", "2023-05-31", "2023-06-01", "2023-06-02"]


@pytest.mark.parametrize("name", ["t.yaml", "t.json"])
def test_taxonomy_and_policy_s12_s13(spark, tmp_path, name):
    data = {"by_code": {"30": "fishing", "60-69": "passenger"}, "roles": {"fishing": "benign"}, "classes": {"fishing": {"policy": "score", "envelope": "e"}, "tug": {"policy": "abstain", "reason": "few"}}}
    yaml = pytest.importorskip("yaml") if name.endswith("yaml") else None
    (tmp_path / name).write_text(yaml.safe_dump(data) if yaml else json.dumps(data))
    found = readers.config(spark, str(tmp_path / name))
    assert readers.taxonomy(found) == ({30: "fishing"}, [(60, 69, "passenger")], {"fishing": "benign"})
    assert rows(readers.policy(spark, found)) == [("fishing", "score", "e", None), ("tug", "abstain", None, "few")]


def test_csv_and_summary_k2_k3(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "a")], "x int, mmsi int, s string")
    writers.csv(df, str(tmp_path / "c"), drop=["mmsi"])
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "c"))) == [("1", "a")]
    writers.json_summary(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().mmsi == 2
    with pytest.raises(ValueError, match="more than one row"):
        writers.json_summary(df.union(df), str(tmp_path / "k"))


def test_coco_export_k5(spark):
    im = spark.createDataFrame([(1, "train"), (2, "val")], "id long, split string")
    boxes = spark.createDataFrame([(7, 1, 3, 0.0, 0.0, 9.0, 9.0), (8, 1, 3, 0.0, 0.0, 2.0, 9.0), (9, 2, 3, 0.0, 0.0, 9.0, 9.0)], "id long, image_id long, category_id int, x double, y double, w double, h double")
    kept, ann = writers.coco_export(im, boxes, 8.0, "train")
    assert rows(kept) == [(1, "train")] and [(r.id, r.image_id, list(r.bbox), r.area, r.iscrowd) for r in ann.collect()] == [(7, 1, [0.0, 0.0, 9.0, 9.0], 81.0, 0)]


def test_image_sizes_s10(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big"))
    (tmp_path / "b.txt").write_bytes(b"no image")
    assert sorted((r.path.rsplit("/", 1)[1], r.width, r.height) for r in readers.image_sizes(spark, str(tmp_path)).collect()) == [("a.png", 640, 480), ("b.txt", None, None)]


def test_duplicate_messages_keep_the_first_of_the_files(spark, tmp_path):
    head = "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselType,TransceiverClass\n"
    for name, sog in (("b.csv", 9.0), ("a.csv", 1.0)):
        lines = [f"5,2023-06-01T00:{i:02}:00,25.{i:02},-80.0,{sog + i / 100},10,10,30,A" for i in range(40)]
        (tmp_path / name).write_text(head + "\n".join(lines + lines[:1]) + "\n")
    raw = readers.positions_csv(spark, str(tmp_path))
    for shuffled in (raw, raw.repartition(5)):
        t = flows.ingest(shuffled, {30: "fishing"}, [], {"fishing": "benign"}, tracks.Limits(teleport_kn=500.0))
        assert t.points.count() == 40 and t.points.agg(F.max("sog")).first()[0] < 2


# --- models ---------------------------------------------------------------------------------------------------------


def test_registry_is_saved_and_checked_k7_h3_h2(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = [(i, "ab"[i % 2], "train", *map(float, rng.normal(size=3))) for i in range(200)]
    df = spark.createDataFrame(data, "row_id long, cls string, split string, a double, b double, c double")
    reg = models.fit_models(df, ["cls"], ["a", "b", "c"], ["mahalanobis"])
    digest = models.save_registry(reg, str(tmp_path / "r"), "note")
    back = models.load_registry(spark, str(tmp_path / "r"), digest)
    score = lambda r: rows(models.score_rows(df, r, ["cls"], ["a", "b", "c"], "mahalanobis"), "row_id", "score")
    assert np.allclose(score(back), score(reg))
    with pytest.raises(ValueError, match="digest"):
        models.load_registry(spark, str(tmp_path / "r"), "0" * 64)
    back.limit(1).withColumn("n_train", F.lit(1).cast("long")).write.mode("append").parquet(str(tmp_path / "r/models"))
    with pytest.raises(ValueError, match="digest"):
        models.load_registry(spark, str(tmp_path / "r"))
    extra = reg.where("cls = 'a'").withColumn("cls", F.lit("z"))
    assert rows(models.attach_registry(reg, extra, ["cls"]), "cls") == [("a",), ("b",), ("z",)]
    with pytest.raises(ValueError, match="both registries"):
        models.attach_registry(reg, reg.limit(1), ["cls"]).count()


def test_pooled_envelope_m13_d10(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], "train", float(i % 7), float(i % 5)) for i in range(300)], "row_id long, cls string, split string, x double, y double")
    pooled = models.with_pools(df, "cls", {"all_but_c": ["a", "b"]})
    reg = models.fit_models(pooled, ["cls"], ["x", "y"], ["mahalanobis"])
    assert rows(reg, "cls", "n_train") == [("a", 100), ("all_but_c", 200), ("b", 100), ("c", 100)]
    policy = spark.createDataFrame([("a", "score", "a", None), ("c", "abstain", None, "few")], "class string, policy string, envelope string, reason string")
    out = decisions.resolve(spark.createDataFrame([("a",), ("c",), ("new",)], "asserted_class string"), policy, override="all_but_c")
    # an override changes the envelope of scoreable classes and keeps abstentions and unknown classes as they are
    assert rows(out, "asserted_class", "policy", "envelope_used") == [("a", "score", "all_but_c"), ("c", "abstain", None), ("new", "unknown_class", None)]


def test_shrinkage_by_definition_m5():
    x = np.random.default_rng(5).normal(size=(60, 4)) @ np.diag([1.0, 2.0, 0.5, 1.5])
    x = x - x.mean(axis=0)
    s = sum(np.outer(v, v) for v in x) / len(x)
    mu = np.trace(s) / 4
    delta = ((s - mu * np.eye(4)) ** 2).sum()
    beta = min(sum(((np.outer(v, v) - s) ** 2).sum() for v in x) / len(x) ** 2, delta)
    cov, shrinkage = models.ledoit_wolf(x)
    assert math.isclose(shrinkage, beta / delta, rel_tol=1e-9) and np.allclose(cov, (1 - shrinkage) * s + shrinkage * mu * np.eye(4))


def test_mahalanobis_query_by_brute_force(spark):
    r = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    got = {x.row_id: x.score for x in model_queries.mahalanobis_score(spark, DIR).collect()}
    for e in (0, 1):
        part = [x for x in r if x.label % 2 == e]
        train = np.array([x.embedding for x in part if x.vec_id % 10 < 7], float)
        mean, std = train.mean(axis=0), train.std(axis=0)
        z = (train - mean) / std
        s = z.T @ z / len(z)
        mu, d = np.trace(s) / 64, 64
        delta = ((s - mu * np.eye(d)) ** 2).sum()
        beta = min(sum(((np.outer(v, v) - s) ** 2).sum() for v in z) / len(z) ** 2, delta)
        inverse = np.linalg.inv((1 - beta / delta) * s + beta / delta * mu * np.eye(d))
        for x in part[:60]:
            v = (np.array(x.embedding, float) - mean) / std
            assert math.isclose(got[x.vec_id], v @ inverse @ v, rel_tol=1e-5)


# --- quantiles, numbers, hashes, splits -------------------------------------------------------------------------------


def test_quantiles_by_ranges_equal_the_aggregate(spark):
    rng = random.Random(1)
    data = [("hot", float(rng.randrange(5)) if i % 3 else 7.0) for i in range(3000)] + [("cold", rng.random()) for _ in range(37)] + [("one", 1.5), ("none", None), (None, 2.0), (None, 4.0), ("hot", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double")
    shares = [0.0, 0.01, 0.5, 0.731, 0.95, 1.0]
    near = {r.g: r.cuts for r in tables.exact_quantiles(df, ["g"], "v", shares).collect()}
    far = {r.g: r.cuts for r in tables.exact_quantiles(df, ["g"], "v", shares, group_rows=10).collect()}
    assert near.keys() == far.keys() == {"hot", "cold", "one", None} and all(np.allclose(near[k], far[k]) for k in near)
    by = {k: [v for g, v in data if g == k and v is not None and not math.isnan(v)] for k in near}
    assert all(np.allclose(near[k], np.percentile(by[k], [100 * s for s in shares])) for k in near)


def test_numbers_and_trips_in_ranges(spark):
    df = spark.createDataFrame([((i * 7919) % 1000, i % 3) for i in range(1000)], "k long, g int")
    assert [r.global_id for r in splits.numbered(df, ["k"], rows_per_range=90).orderBy("k").collect()] == list(range(1, 1001))
    t = spark.createDataFrame([(m, s) for m in range(50) for s in range(1, 1 + m % 4)], "mmsi long, trip_seq long")
    got = [tuple(r) for r in tracks.global_trip_id(t, vessels_per_range=7).orderBy("mmsi", "trip_seq").select("trip_id").collect()]
    assert got == [(i,) for i in range(len(got))]


def test_blocks_of_a_hot_track_change_nothing(spark):
    rng, data = random.Random(8), []
    for m in range(4):
        t, lat = 0.0, 25.0
        for i in range(900 if m == 0 else 60):
            t += rng.choice([20, 61, 300, 1801, 7000])
            lat += rng.uniform(-0.02, 0.02) + (2.0 if i % 29 == 0 else 0.0)
            data.append((m, t, lat, -80.0, rng.uniform(0, 20), rng.uniform(0, 360), i))
    df = spark.createDataFrame(data, "mmsi long, t double, lat double, lon double, sog double, cog double, n long")
    one, cut = (tracks.segment(df, ["n"], block_s=b) for b in (None, 3_600.0))
    assert rows(cut, "mmsi", "t", "trip_seq") == rows(one, "mmsi", "t", "trip_seq") and one.agg(F.max("trip_seq")).first()[0] > 50
    a, b = (tracks.trip_features(one, ("mmsi", "trip_seq"), block_s=x).orderBy("mmsi", "trip_seq").toPandas() for x in (None, 700.0))
    assert list(a.columns) == list(b.columns) and np.allclose(a.to_numpy(float), b.to_numpy(float), equal_nan=True)
    assert tracks.hot_blocks(df) is None and tracks.hot_blocks(df, most=100) == 86_400.0


def test_near_hashes_are_whole_p2(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(60)]
    data = [(i, b) for i, b in enumerate(base)]
    for b in base[:40]:
        v = b
        for bit in rng.sample(range(63), rng.randrange(8)):
            v ^= 1 << bit
        data.append((len(data), v))
    got = rows(splits.near_duplicate_hashes(spark.createDataFrame(data, "id long, h long"), "h", "id"))
    first = {}
    for i, h in data:
        first.setdefault(h, i)
    want = [(first[h], i, 0) for i, h in data if first[h] != i]
    want += [(min(a, b), max(a, b), (x ^ y).bit_count()) for (x, a), (y, b) in combinations(first.items(), 2) if (x ^ y).bit_count() <= 5]
    assert got == sorted(want) and len(got) > 20


def test_dhash_g17(spark):
    rng = random.Random(7)
    flat = [rng.randrange(256) for _ in range(72)]
    bits = 0
    for r in range(8):
        for c in range(8):
            bits = bits << 1 | (flat[9 * r + c + 1] > flat[9 * r + c])
    out = [r.h for r in spark.createDataFrame([(flat,), (flat[:5],), (None,)], "p array<int>").select(images.dhash("p").alias("h")).collect()]
    assert out == [bits - (1 << 64) if bits >> 63 else bits, None, None]


def test_sources_are_split_by_themselves_p6(spark):
    data = [(f"{s}{g}", s, f"c{g % 2}" if g else "rare") for s in "xy" for g in range(30) for _ in range(1 + g % 3)]
    out, report = splits.assign_by_source(spark.createDataFrame(data, "g string, source string, c string"), "g", "source", classes="c")
    assert out.count() == len(data) and out.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    for s in "xy":
        n = {r.split: r["count"] for r in out.where(F.col("source") == s).groupBy("split").count().collect()}
        assert set(n) == {"train", "val", "test"} and abs(n["train"] / sum(n.values()) - 0.7) < 0.1
    assert rows(report) == [("x", "rare", 1), ("y", "rare", 1)]


# --- small operators --------------------------------------------------------------------------------------------------


def test_band_f10(spark):
    df = spark.createDataFrame([(31.0, 0.96, True, "benign"), (29.0, 0.96, True, "benign"), (31.0, 0.94, True, "benign"), (31.0, 0.96, False, "benign"), (31.0, 0.96, True, "hostile"), (None, 0.96, True, "benign")], "sog_p95 double, straightness double, window_complete boolean, role string")
    assert [r[0] for r in df.select(decisions.fast_and_straight()).collect()] == [True] + [False] * 5


def test_windows_and_backends_d3_d7(spark):
    df = spark.createDataFrame([([300, 600], [600, 900]), ([100], [600]), (None, [600])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(decisions.resolve_window("a", "b", 900)).collect()] == [600, 900, 900]
    with pytest.raises(ValueError, match="unknown backend"):
        decisions.decide(df, "other")


def test_observations_h1(spark):
    truth = spark.createDataFrame([(i, 0.0) for i in range(4)], "image_id long, x double")
    det = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.9), (1, 2, 0.9), (2, 1, 0.1)], "image_id long, category_id int, score double")
    assert rows(decisions.observations(truth, det, 1)) == [(0, "detected"), (1, "mislabeled"), (2, "missed"), (3, "missed")]


def test_rosters_defaults_and_categories_h5_h9_h17(spark):
    reg = spark.createDataFrame([("e", "mixture", 90, "{}"), ("e", "forest", 80, "{1}")], "cls string, family string, n_train long, model string")
    r = reports.roster(reg, ["cls"]).first()
    assert (r.n_models, r.n_train, len(r.digest)) == (2, 90, 64)
    assert rows(reports.operating_far(spark.createDataFrame([(0.1,), (None,)], "far double"), "full", 0.035), "operating_far") == [(0.035,), (0.1,)]
    assert rows(images.map_categories(spark.createDataFrame([("Boat",), ("bird",)], "category string"), {"Boat": "vessel"})) == [("vessel",)]


def test_files_p13_p17_p18_h16(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    for n in "abc":
        (folder / f"{n}.bin").write_bytes(n.encode() * 10)
    found = session.checkpoint(provenance.file_digests(spark, str(folder)))
    cache = found.where("path LIKE '%a.bin'").withColumn("sha256", F.lit("from the cache"))
    again = {r.path[-5:]: r.sha256 for r in provenance.cached_digests(spark, str(folder), cache).collect()}
    assert again["a.bin"] == "from the cache" and again["b.bin"] == next(r.sha256 for r in found.collect() if r.path.endswith("b.bin")) and len(again) == 3
    assert provenance.cached_digests(spark, str(folder), found).count() == 3
    one = provenance.inventory(found, "v1").first()
    assert (one.n_files, one.bytes, one.release) == (3, 30, "v1") and one.digest == provenance.inventory(found.repartition(3), "v1").first().digest
    manifest = found.select(F.lit(1).alias("item_id"), F.lit("eo").alias("channel"), "path", F.when(F.col("path").endswith("b.bin"), "old").otherwise(F.col("sha256")).alias("sha256"))
    gone = spark.createDataFrame([(2, "odd", "nowhere", "x")], "item_id int, channel string, path string, sha256 string")
    assert provenance.manifest_state(manifest.unionByName(gone), found, ["eo"]).first().asDict() == {"n_repeated": 1, "n_bad_channel": 1, "n_missing": 1, "n_changed": 1}
    trained = spark.createDataFrame([("benign",), (" Benign",)], "role string")
    state = lambda f: provenance.reattest(f.select("path", "sha256"), found, trained).first()
    assert state(found).holds and not state(manifest).holds and state(manifest).n_changed == 1


def test_coverage_and_chips_a28_p9(spark):
    e = spark.createDataFrame([("a", i % 20) for i in range(40)] + [("b", 1)], "k string, trip_id int")
    assert rows(encounters.coverage(e, ["k"])) == [("a", 40, 20, False), ("b", 1, 1, True)]
    im = spark.createDataFrame([(100, 90, 1, 0.6), (100, 90, 2, 0.6), (100, 90, 1, 0.4), (300, 90, 1, 0.6)], "w int, h int, n int, f double")
    assert [r[0] for r in im.select(images.chip_like(F.col("w"), F.col("h"), F.col("n"), F.col("f"))).collect()] == [True, False, False, False]


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


# --- detections by brute force ----------------------------------------------------------------------------------------


def iou(a, b):
    i = max(min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), 0) * max(min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]), 0)
    return i / (a[2] * a[3] + b[2] * b[3] - i) if i else 0.0


def matched(dets, truth, least):
    """For detections by descending score (then id): whether each finds a free truth, the best one (the last on a tie)."""
    free, out = list(range(len(truth))), []
    for d in dets:
        best = max(((iou(d[2], truth[j]), j) for j in free), default=(0, -1))
        hit = best[0] >= least
        if hit:
            free.remove(best[1])
        out.append(hit)
    return out


def unique(df, key):
    """Rows of which no two share an id, as a table of their own."""
    return df.sparkSession.createDataFrame(list({r[key]: r for r in df.orderBy(*df.columns).collect()}.values()), df.schema)


def frames(boxes, detections):
    truth, dets = {}, {}
    for r in boxes.orderBy("ann_id").collect():
        truth.setdefault(r.image_id, []).append((r.category_id, (r.x, r.y, float(r.w), r.h)))
    for r in detections.collect():
        dets.setdefault(r.image_id, []).append((-r.score, r.det_id, (r.x, r.y, float(r.w), r.h), r.category_id))
    return truth, {k: sorted(v) for k, v in dets.items()}


def test_recall_query_by_brute_force_a17(spark):
    boxes, detections = unique(model_queries.boxes(spark, DIR), "ann_id"), unique(model_queries._detections(spark, DIR), "det_id")
    truth, dets = frames(boxes, detections)
    n = any_ = mine = target = 0
    for k, found in truth.items():
        there = [b for _, b in found]
        d = [x for x in dets.get(k, []) if -x[0] >= 0.25]
        n, any_ = n + len(there), any_ + sum(matched(d, there, 0.5))
        t = [x for x in d if x[3] == 65]
        mine, target = mine + sum(matched(t, there, 0.5)), target + len(t)
    r = images.recall_at(boxes, detections, 65).first()
    assert (r.n_gt, r.n_target) == (n, target) and np.allclose([r.presence_recall, r.class_recall, r.class_precision], [any_ / n, mine / n, mine / target], atol=1e-6)


def test_ap_query_by_brute_force_a18(spark):
    boxes, detections = unique(model_queries.boxes(spark, DIR), "ann_id"), unique(model_queries._detections(spark, DIR), "det_id")
    truth, dets = frames(boxes, detections)
    got = {(r.category_id, r.iou): (r.ap, r.ar) for r in images.average_precision(boxes, detections, ious=(0.5, 0.75)).collect()}
    for cat in sorted({c for v in truth.values() for c, _ in v}):
        for least in (0.5, 0.75):
            hits, n = [], 0
            for k in truth.keys() | dets.keys():
                there = [b for c, b in truth.get(k, []) if c == cat]
                n += len(there)
                d = [x for x in dets.get(k, []) if x[3] == cat][:100]
                hits += [(x[0], x[1], h) for x, h in zip(d, matched(d, there, least), strict=True)]
            tp, curve = 0, []
            for rank, (_, _, h) in enumerate(sorted(hits), 1):
                tp += h
                curve.append((tp / n, tp / rank))
            ap = sum(max((p for r, p in curve if r >= s / 100 - 1e-12), default=0.0) for s in range(101)) / 101
            assert math.isclose(got[cat, least][0], ap, abs_tol=1e-9) and math.isclose(got[cat, least][1], tp / n, abs_tol=1e-9)


def test_slices_h12(spark):
    truth, det = model_queries.boxes(spark, DIR), model_queries._detections(spark, DIR)
    im = truth.groupBy("image_id").agg(F.min("source").alias("source"), F.max("is_shore").alias("is_shore"))
    box = truth.drop("source", "is_shore")
    out = images.evaluate_slices(box, det, im, ious=(0.5,))
    whole = rows(images.average_precision(box, det, ious=(0.5,)), "category_id", "ap")
    assert rows(out.where("slice = 'overall'"), "category_id", "ap") == whole and {r.slice for r in out.collect()} >= {"overall", "shore"}


def test_splits_of_a_coco_export_s7(spark, tmp_path):
    for s, n in (("train", 2), ("valid", 1), ("test", 1)):
        (tmp_path / s).mkdir()
        data = {"images": [{"id": i, "file_name": f"{s}{i}.jpg"} for i in range(n)], "annotations": [{"id": i, "image_id": i, "category_id": 1, "bbox": [1, 2, 3, 4]} for i in range(n)], "categories": [{"id": 1, "name": "boat"}]}
        (tmp_path / s / "_annotations.coco.json").write_text(json.dumps(data))
    im, ann, cat = readers.coco_splits(spark, str(tmp_path))
    assert rows(im, "split", "id") == [("test", 0), ("train", 0), ("train", 1), ("valid", 0)] and rows(ann, "split", "w") == [("test", 3.0), ("train", 3.0), ("train", 3.0), ("valid", 3.0)] and rows(cat, "name") == [("boat",)]


def test_headlines_h19():
    assert provenance.headline({"eval": {"ap": 0.5, "n": 3}}, {"ap": "eval.ap", "ar": "eval.ar", "x": "a.b.c"}) == {"ap": 0.5, "ar": None, "x": None}
