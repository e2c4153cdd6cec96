"""Models, decisions, rates, encounters, images, splits and provenance, by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import decisions, encounters, images, models, provenance, rates, splits
from wakeline.sources import readers, writers


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def straight(ranges):
    """A track straight toward (25.77, -80.15) from the north, 60 s apart, at the given ranges in nm."""
    return [(1, 60.0 * i, 25.77 + r * 1.852 / 6371.0088 * 180 / math.pi, -80.15) for i, r in enumerate(ranges)]


@pytest.mark.parametrize(("ranges", "usable"), [((5, 4, 3, 2, 1), True), ((10, 9.5, 9, 8.5, 8), False), ((3, 2, 1), False), ((2, 1, 3, 4, 5), False)])
def test_encounter_g5(spark, ranges, usable):
    df = spark.createDataFrame(straight(ranges), "trip_id long, t double, lat double, lon double").withColumns({"a": F.lit(25.77), "b": F.lit(-80.15)})
    out = encounters.encounter_features(df, ["trip_id"], "a", "b").collect()
    assert bool(out) == usable
    if usable:
        r = out[0]
        assert r.n_points_in_annulus == 5 and math.isclose(r.cpa_range_nm, 1.0, abs_tol=1e-6) and r.closing_frac == 1.0 and r.inbound_leg_persistence_s == 240 and math.isclose(r.closing_rate_med_kn, 60, rel_tol=1e-6)


def test_encounter_leg_breaks_outside_the_annulus(spark):
    df = spark.createDataFrame(straight((5, 4, 7, 3, 2, 1.5, 1)), "trip_id long, t double, lat double, lon double").withColumns({"a": F.lit(25.77), "b": F.lit(-80.15)})
    assert encounters.encounter_features(df, ["trip_id"], "a", "b").first().inbound_leg_persistence_s == 180


def test_port_cloud_g10_g11(spark):
    rng, pts = np.random.default_rng(0), []
    for i in range(200):
        pts.append((1000, 60.0 * i, 25.75 + rng.normal(0, 0.004), -80.05 + rng.normal(0, 0.004), 8.0))
    for k in range(10):
        pts += [(2000 + k, 60.0 * i, 25.77 + rng.normal(0, 0.0005), -80.18 + rng.normal(0, 0.0005), 0.1) for i in range(400)]
    for k in range(8):
        pts += [(3000 + k, 60.0 * i, 25.72 + rng.normal(0, 0.0005), -79.97 + rng.normal(0, 0.0005), 0.1) for i in range(400)]
    for k in range(60):
        pts += [(4000 + k, 60.0 * i, 25.75, -79.95 - 0.02 * i, 8.0) for i in range(6)]
    df = spark.createDataFrame(pts, "trip_id long, t double, lat double, lon double, sog double")
    seed = spark.createDataFrame([("miami", 25.77, -80.17)], "port_region string, seed_lat double, seed_lon double")
    out = encounters.placement_validity(df, encounters.derive_placements(df, seed))
    got = {r.placement_class: r for r in out.collect()}
    assert len(out.columns) == 10 and sorted(got) == ["anchorage", "berth_approach", "fairway_stress", "offshore_terminal"]
    assert abs(got["anchorage"].lon + 79.97) < 0.02 and got["fairway_stress"].n_inbound_legs_in_annulus >= 50 and got["fairway_stress"].valid


def test_models_m1_m7(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (300, 3)), rng.normal(6, 1, (300, 3))])
    m = models.select_mixture(x[::2], x[1::2], (1, 2, 3))
    assert m["k"] == 2
    far = np.array([[20.0, 20, 20]])
    for family in ("mixture", "mahalanobis", "forest"):
        f = models.fit_family(family, x[::2], x[1::2])
        assert models.score_family(far, f)[0] > np.quantile(models.score_family(x, f), 0.99)
    data = [(i, "e", "train" if i % 3 else "val", *map(float, r)) for i, r in enumerate(x)] + [(9999, "e", "train", None, 1.0, 1.0), (10000, "other", "train", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "row_id long, env string, split string, a double, b double, c double")
    reg = models.fit_models(df, ["env"], ["a", "b", "c"], ["mahalanobis"])
    assert rows(reg, "env", "family") == [("e", "mahalanobis")]
    out = models.score_rows(df, reg, ["env"], ["a", "b", "c"], "mahalanobis")
    assert out.where("score is null").count() == 2
    t = {r.far_target: r.threshold for r in models.thresholds(out, ["env"]).where("env = 'e'").collect()}
    val = [r.score for r in out.where("split = 'val'").collect()]
    assert math.isclose(t[0.05], np.percentile(val, 95))


def test_population_scaling_m1(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert rows(models.standardized(df, ["a", "b"]), "a", "b") == [(-1.0, 0.0), (1.0, 0.0)]


def test_status_machine_d1_d5(spark):
    policy = spark.createDataFrame([("cargo", "score", "e", None), ("tug", "abstain", None, "few"), ("ferry", "score", "gone", None)], "class string, policy string, envelope string, reason string")
    c = spark.createDataFrame([("cargo", 2.0, True), ("cargo", 1.0, True), ("cargo", None, True), ("cargo", 2.0, False), ("tug", 2.0, True), ("ferry", 2.0, True), ("ufo", 2.0, True)], "asserted_class string, score double, has_window boolean")
    c = decisions.resolve(c, policy).withColumn("envelope_known", F.col("envelope_used") == "e").withColumn("threshold", F.lit(1.0)).withColumn("status", decisions.status())
    out = [(r.asserted_class, r.status, r.action) for r in c.withColumn("action", decisions.action()).collect()]
    assert out == [("cargo", "scored", "flag"), ("cargo", "scored", "pass"), ("cargo", "nan_features", "abstain"), ("cargo", "no_window", "abstain"), ("tug", "abstain", "abstain"), ("ferry", "missing_envelope", "abstain"), ("ufo", "unknown_class", "abstain")]
    over = decisions.resolve(spark.createDataFrame([("cargo",), ("tug",)], "asserted_class string"), policy, override="pooled")
    assert rows(over, "asserted_class", "policy", "note") == [("cargo", "score", "envelope_override"), ("tug", "abstain", "few")]


def test_presence_d6(spark):
    df = spark.createDataFrame([(True, "missed"), (True, "detected"), (False, "mislabeled")], "t boolean, o string")
    assert [r.a.action for r in df.select(decisions.presence("t", "o").alias("a")).collect()] == ["flag", "pass", "abstain"]
    with pytest.raises(Exception, match="unknown outcome"):
        spark.createDataFrame([(False, "odd")], "t boolean, o string").select(decisions.presence("t", "o").alias("a")).collect()


def test_firewall_f8_f9(spark):
    df = spark.createDataFrame([("benign",), (None,), ("hostile",)], "role string")
    assert decisions.benign_only(df).count() == 1
    with pytest.raises(Exception, match="not allowed"):
        decisions.benign_only(df, strict=True).collect()


def test_rates_a11_a12_a29(spark):
    df = spark.createDataFrame([("c", "flag", False), ("c", "flag", False), ("c", "pass", False), ("c", "flag", True), ("c", "abstain", None), ("d", "abstain", False)], "k string, action string, negative_control boolean")
    got = {r.k: r for r in rates.flag_rates(df, ["k"]).collect()}
    assert got["c"].n == 3 and math.isclose(got["c"].rate, 2 / 3) and got["c"].thin_n == "thin-n" and got["d"].rate is None
    far = spark.createDataFrame([("a", True), ("a", False), ("f", True), ("f", None)], "p string, flag boolean")
    assert rows(rates.far_by(far, ["p"]), "p", "far") == [("a", 0.5), ("f", 1.0)]


def test_ceiling_a29(spark):
    df = spark.createDataFrame([(1 / 3,), (0.1,), (None,)], "r double")
    assert [r[0] for r in df.select(rates.control_ceiling("r", 0.035)).collect()] == [False, True, True]


def test_splits_p1_p6(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (9, 8), (5, 5)], "a long, b long")
    assert rows(splits.components(edges), "id", "group_id") == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    items = spark.createDataFrame([(i, f"g{i % 40}", i % 40 == 0) for i in range(400)], "id long, g string, fixed boolean")
    out = splits.assign_splits(items, "g", train_only=F.col("fixed"))
    assert splits.leaks(out, "g").count() == 0 and out.count() == 400
    n = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert abs(n["train"] / 400 - 0.7) < 0.06 and out.where("fixed and split <> 'train'").count() == 0
    got = splits.greedy_split({i: 10 for i in range(9)}, classes={0: ["rare"], 1: ["rare"], 2: ["rare"]})
    assert {got[0], got[1], got[2]} == {"train", "val", "test"}


def test_near_hashes_p2(spark):
    h = spark.createDataFrame([(1, 0), (2, 0b11111), (3, 0b111111), (4, 0), (5, -1), (6, None)], "id long, h long")
    assert rows(splits.near_duplicate_hashes(h, "h", "id"), "a", "b", "distance") == [(1, 2, 5), (1, 4, 0), (2, 3, 1)]


def test_matching_a17_a18(spark):
    gt = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 20.0, 0.0, 10.0, 10.0), (2, 0, 0.0, 0.0, 5.0, 5.0)], "image_id long, category_id int, x double, y double, w double, h double")
    det = spark.createDataFrame([(1, 1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0, 0.8, 20.0, 0.0, 10.0, 10.0), (3, 3, 0, 0.9, 0.0, 0.0, 5.0, 5.0), (1, 4, 0, 0.1, 0.0, 0.0, 9.0, 9.0)], "image_id long, det_id long, category_id int, score double, x double, y double, w double, h double")
    r = images.recall_at(gt, det, 0).first()
    assert (r.n_gt, r.n_target) == (3, 2) and math.isclose(r.presence_recall, 2 / 3) and math.isclose(r.class_recall, 2 / 3) and r.class_precision == 1.0
    ap = images.average_precision(gt, det).where("iou = 0.5")
    assert math.isclose({r.category_id: r.ap for r in ap.collect()}[0], 51 / 101, abs_tol=0.01) and {r.category_id: r.ap for r in ap.collect()}[1] == 0


def test_provenance_p10_p17_f18(spark):
    assert provenance.find_keys({"a": [{"score": 1}], "score": 2}, ["score"]) == ["$.a[0].score", "$.score"]
    assert provenance.check_policy({"a": {"policy": "score", "envelope": "x"}, "b": {"policy": "abstain"}}, ["y"], ["a", "b", "c"]) == ["class c has no policy", "class a: unknown envelope x", "class b: abstains without a reason"]
    img = spark.createDataFrame([(1, "ok"), (2, "bad")], "id long, source string")
    ann = spark.createDataFrame([(10, 1), (11, 2)], "id long, image_id long")
    kept, boxes = provenance.without_source(img, ann, "bad")
    assert kept.count() == 1 and rows(boxes, "id") == [(10,)]
    assert provenance.for_release(spark.createDataFrame([(1, 2)], "trip_id long, mmsi long")).columns == ["trip_id"]
    e = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    f = spark.createDataFrame([("a", "1"), ("b", "x")], "path string, sha256 string")
    assert rows(provenance.verify(e, f), "path", "state") == [("a", "ok"), ("b", "changed"), ("c", "missing")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"images": [{"id": 1, "file_name": "a.png"}],\n "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [1.0, 2.0, 3.0, 4.0]}], "categories": [{"id": 2, "name": "x"}]}')
    images_, boxes, cats = readers.coco(spark, str(tmp_path / "c.json"))
    assert images_.count() == 1 and rows(boxes, "x", "h") == [(1.0, 4.0)] and cats.first().name == "x"
    (tmp_path / "v.xml").write_text("<annotation><filename>a.png</filename><size><width>10</width><height>20</height></size><object><name>boat</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>5</xmax><ymax>9</ymax></bndbox></object></annotation>")
    assert rows(readers.voc(spark, str(tmp_path / "v.xml")), "category", "w", "h") == [("boat", 4.0, 7.0)]
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    assert readers.image_size(png) == (7, 9) and readers.image_size(b"GIF") is None
    jpg = b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x11\x08\x00\x05\x00\x06\x03\x00\x00"
    assert readers.image_size(jpg) == (6, 5)
    df = spark.createDataFrame([(1, 10, 0, 25.0, 25.0, 50.0, 50.0, 100.0, 100.0)], "image_id long, ann_id long, class_id int, x double, y double, w double, h double, width double, height double")
    assert writers.yolo(df).first().label == "0 0.500000 0.500000 0.500000 0.500000"
    writers.parquet(spark.createDataFrame([(1.0, 2), (3.0, 4)], "window_s double, k int"), str(tmp_path / "out"), ["window_s"], ["k"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert writers.markdown(spark.createDataFrame([("a", None)], "x string, y double")).endswith("| a | - |")
    with pytest.raises(ValueError, match="more than"):
        writers.markdown(spark.range(5), 3)


def test_admissible_splits_d8(spark):
    policy = spark.createDataFrame([("a", "score", "ea"), ("s", "score", "proxy"), ("n", "abstain", None)], "class string, policy string, envelope string")
    members = spark.createDataFrame([("ea", "b")], "envelope string, member_class string")
    pairs = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("c", "s"), ("a", "n")], "source_class string, asserted_class string")
    out = {(r.source_class, r.asserted_class): r.splits for r in decisions.admissible_splits(pairs, policy, members, "proxy", ["c"]).collect()}
    held = ["test", "val"]
    assert out == {("a", "a"): held, ("b", "a"): held, ("c", "a"): ["test", "train", "val"], ("c", "s"): held, ("a", "n"): []}
