"""Model, decision, rate, image, split and provenance queries over the driver's tables, with their SQL.

``lineitem`` stands in for scored contacts (a score per row, return flag as class, line status as region), ``embeddings``
for feature vectors, ``events`` for decisions, ``part`` and ``lineitem`` for images and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, tables
from ..operators import decisions, images, models, provenance, rates, splits
from ..session import ship
from ..sources import writers
from .track_queries import PTS, points, rounded

#: Components of a vector of the driver's table, for the SQL; the queries take as many as there are.
DIMENSIONS = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- models ---------------------------------------------------------------------------------------------------------


def vectors(spark, sf_dir):
    """Embeddings as rows of features f0, f1, ..., one per component, with a group (label) and a split by id; and the features."""
    e = read(spark, sf_dir, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    features = [f"f{i}" for i in range(size)]
    split = F.when(F.col("vec_id") % 10 < 7, "train").when(F.col("vec_id") % 10 < 9, "val").otherwise("test")
    return e.select(F.col("vec_id").alias("row_id"), "label", split.alias("split"), *[F.get("embedding", F.lit(i)).cast("double").alias(f) for i, f in enumerate(features)]), features


def _fit_score(spark, sf_dir, family):
    v, features = vectors(spark, sf_dir)
    v = v.withColumn("envelope", F.concat(F.lit("e"), (F.col("label") % 2).cast("string")))
    registry = models.fit_models(v, ["envelope"], features, [family], min_rows=20)
    return rounded(models.score_rows(v, registry, ["envelope"], features, family).select("row_id", "envelope", "split", "score"))


def mahalanobis_score(spark, sf_dir):
    """Ledoit-Wolf covariance, squared distances."""
    return _fit_score(spark, sf_dir, "mahalanobis")


def gmm_score(spark, sf_dir):
    return _fit_score(spark, sf_dir, "mixture")


def isolation_forest(spark, sf_dir):
    return _fit_score(spark, sf_dir, "forest")


def diagonal_score(spark, sf_dir):
    """Sum of squared standardised features: the diagonal variant, within the plan alone."""
    v, features = vectors(spark, sf_dir)
    v = models.standardized(v, features)
    return rounded(v.select("row_id", sum((F.col(f) * F.col(f) for f in features), F.lit(0.0)).alias("score")), 5)


def standardize(spark, sf_dir):
    v, features = vectors(spark, sf_dir)
    v = models.standardized(v, features, ["label"])
    return rounded(v.select("row_id", "label", *features), 5)


def scored(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    split = F.when(F.col("l_orderkey") % 10 < 7, "train").when(F.col("l_orderkey") % 10 < 9, "val").otherwise("test")
    return l.select(F.col("l_returnflag").alias("envelope"), F.col("l_linestatus").alias("region"), split.alias("split"), F.col("l_extendedprice").alias("score"), "l_orderkey", "l_linenumber")


def calibrate_thresholds(spark, sf_dir):
    return rounded(models.thresholds(scored(spark, sf_dir), ["envelope"]))


def far_by_stratum(spark, sf_dir):
    """False alarms of test rows against the validation threshold at 5 %, by class and region, flags strictly above."""
    s = scored(spark, sf_dir)
    t = models.thresholds(s, ["envelope"], (0.05,)).select("envelope", "threshold")
    rows = s.where("split = 'test'").join(tables.small(t), "envelope").withColumn("flag", F.col("score") > F.col("threshold"))
    return rounded(rates.far_by(rows, ["envelope", "region"]))


def far_overall(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("flag", F.when(F.col("l_linenumber") < 6, F.col("score") > 50_000))
    return rounded(rates.overall(rates.far_by(s, ["envelope", "region"]), excluded=F.col("envelope") == "N"))


def far_curve(spark, sf_dir):
    return rounded(rates.far_curve(scored(spark, sf_dir), ["envelope"], (0.01, 0.02, 0.05, 0.1, 0.15, 0.2)))


def far_gate(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("flag", F.when(F.col("l_linenumber") < 7, F.col("score") > 60_000))
    r = rates.far_by(s, ["envelope", "region"]).withColumn("complete", F.col("n") >= 500)
    return r.select("envelope", "region", rates.gate("far", 0.16, "complete").alias("gate"))


# --- decisions ------------------------------------------------------------------------------------------------------

POLICY = (("view", "score", "e_view", None), ("click", "score", "e_click", None), ("purchase", "abstain", None, "too few tracks"), ("signup", "score", None, None))


def _policy(spark):
    return spark.createDataFrame(list(POLICY), "class string, policy string, envelope string, reason string")


def contacts(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("event_id", F.col("cls").alias("asserted_class"), F.when(F.col("event_id") % 7 != 0, F.col("sog")).alias("score"), (F.col("event_id") % 13 != 0).alias("has_window"), (F.col("event_id") % 10 == 3).alias("negative_control"), F.when(F.col("mmsi") % 3 == 0, "core_course").otherwise("core").alias("subspace"), F.lit(600).alias("window_s"), (F.col("mmsi") % 4).alias("arm"))


def decision_status(spark, sf_dir):
    c = decisions.resolve(contacts(spark, sf_dir), _policy(spark)).withColumn("envelope_known", F.col("envelope_used") == "e_view")
    c = c.withColumn("status", decisions.status())
    t = spark.createDataFrame([("e_view", 600, "core", 0.05, 60.0), ("e_view", 600, "core_course", 0.05, 80.0), ("e_view", 600, "core", 0.01, 99.0)], "envelope_used string, window_s int, subspace string, far_target double, threshold double")
    c = decisions.with_threshold(c, t, 0.05)
    return c.select("event_id", "policy", "envelope_used", "status", decisions.action().alias("action"))


STATUS = """policy(class, policy, envelope) AS (VALUES ('view', 'score', 'e_view'), ('click', 'score', 'e_click'), ('purchase', 'abstain', NULL), ('signup', 'score', NULL)),
c AS (SELECT event_id, mmsi, CASE WHEN event_id % 7 <> 0 THEN sog END AS score, event_id % 13 <> 0 AS has_window, event_id % 10 = 3 AS negative_control, mmsi % 4 AS arm, cls,
 CASE WHEN p.class IS NULL THEN 'unknown_class' WHEN p.policy = 'score' AND envelope IS NOT NULL THEN 'score' ELSE 'abstain' END AS policy, envelope FROM points LEFT JOIN policy p ON cls = p.class),
d AS (SELECT *, CASE WHEN policy = 'score' THEN envelope END AS envelope_used, CASE WHEN policy IN ('unknown_class', 'abstain') THEN policy WHEN envelope <> 'e_view' THEN 'missing_envelope' WHEN NOT has_window THEN 'no_window' WHEN score IS NULL THEN 'nan_features' ELSE 'scored' END AS status FROM c),
a AS (SELECT *, CASE WHEN status <> 'scored' THEN 'abstain' WHEN score > CASE WHEN mmsi % 3 = 0 THEN 80 ELSE 60 END THEN 'flag' ELSE 'pass' END AS action FROM d)"""


def acted(spark, sf_dir):
    return decision_status(spark, sf_dir).join(contacts(spark, sf_dir).select("event_id", "asserted_class", "negative_control", "arm"), "event_id")


def flag_rates(spark, sf_dir):
    return rounded(rates.flag_rates(acted(spark, sf_dir), ["asserted_class", "arm"]))


def rate_gaps(spark, sf_dir):
    """Rates by class and arm against the class's rate over all arms."""
    rows = acted(spark, sf_dir)
    r = rates.gaps(rates.flag_rates(rows, ["asserted_class", "arm"]), rates.flag_rates(rows, ["asserted_class"]), ["asserted_class"])
    return rounded(r.select("asserted_class", "arm", "rate", "comparator_rate", "comparator_n", "gap"))


def control_check(spark, sf_dir):
    """Negative controls against their ceiling."""
    rows = acted(spark, sf_dir).where("negative_control")
    r = rates.flag_rates(rows, ["arm"], control=None)
    return rounded(r.select("arm", "n", "rate", rates.control_ceiling("rate", 0.035).alias("within")))


def presence_rule(spark, sf_dir):
    p = points(spark, sf_dir).select("event_id", (F.col("event_id") % 4 != 0).alias("track_present"), F.when(F.col("cls") == "view", "detected").when(F.col("cls") == "click", "missed").otherwise("mislabeled").alias("outcome"))
    return p.withColumn("_p", decisions.presence("track_present", "outcome")).select("event_id", "_p.action", "_p.status")


def label_swap_matrix(spark, sf_dir):
    """Rows of one class scored under another: flag rates of all ordered pairs, as a matrix."""
    s = scored(spark, sf_dir)
    t = models.thresholds(s, ["envelope"], (0.05,)).select(F.col("envelope").alias("asserted_class"), "threshold")
    pairs = decisions.swap_pairs(s.select(F.col("envelope").alias("class")).distinct())
    rows = s.where("split <> 'train'").withColumnRenamed("envelope", "source_class").join(tables.small(pairs), "source_class").join(tables.small(t), "asserted_class")
    r = rows.groupBy("source_class", "asserted_class").agg(F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("flag_rate"))
    return rounded(rates.matrix(r, "source_class", "asserted_class", ["A", "N", "R"], "flag_rate"))


def admissible_splits(spark, sf_dir):
    classes = points(spark, sf_dir).select(F.col("cls").alias("class")).distinct()
    members = spark.createDataFrame([("e_view", "view"), ("e_view", "signup"), ("e_click", "click")], "envelope string, member_class string")
    out = decisions.admissible_splits(decisions.swap_pairs(classes), _policy(spark), members, "e_click", ["signup"])
    return out.select("source_class", "asserted_class", F.array_join("splits", ",").alias("splits"))


def benign_rows(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("role", F.when(F.col("event_id") % 6 == 0, " Hostile").when(F.col("event_id") % 6 == 1, F.lit(None)).otherwise(" Benign "))
    return decisions.benign_only(p, classes="cls", blocked_classes=["purchase"]).groupBy("cls").agg(F.count("*").alias("n"))


def subspace_routing(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select(models.subspace(["heading", "cog"]).alias("subspace")).groupBy("subspace").agg(F.count("*").alias("n"))


def code_range_map(spark, sf_dir):
    o = read(spark, sf_dir, "part")
    c = tables.code_class("p_size", {7: "seven", 30: "thirty"}, ((1, 9, "low"), (25, 39, "middle")), "other")
    return o.groupBy(c.alias("class")).agg(F.count("*").alias("n"))


def success_rates(spark, sf_dir):
    p = points(spark, sf_dir).select("cls", (F.col("event_id") % 3 != 0).alias("eligible"), (F.col("sog") > 50).alias("success"), (F.col("heading") > 180).alias("attributable"))
    return rounded(rates.success_rates(p, ["cls"], "eligible", "success", "attributable"))


# --- images ---------------------------------------------------------------------------------------------------------


def boxes(spark, sf_dir):
    """Line items as boxes: the part is the image, sides from quantity and price."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    d = lambda c: c.cast("double")
    return l.select(
        n.alias("ann_id"), F.col("l_partkey").alias("image_id"), F.col("l_returnflag").alias("category"), F.ascii("l_returnflag").alias("category_id"), d(n % 97).alias("x"), d(n % 89).alias("y"),
        (F.col("l_quantity") * 2).alias("w"), d(n % 61 + 1).alias("h"), F.lit(120.0).alias("width"), F.lit(100.0).alias("height"), F.col("l_linestatus").alias("source"), (F.col("l_linenumber") == 1).alias("is_shore"),
    )


BOX = """boxes AS (SELECT l_orderkey * 7 + l_linenumber AS ann_id, l_partkey AS image_id, l_returnflag AS category, ((l_orderkey * 7 + l_linenumber) % 97)::DOUBLE AS x, ((l_orderkey * 7 + l_linenumber) % 89)::DOUBLE AS y,
 l_quantity * 2 AS w, ((l_orderkey * 7 + l_linenumber) % 61 + 1)::DOUBLE AS h, 120::DOUBLE AS width, 100::DOUBLE AS height, l_linestatus AS source, l_linenumber = 1 AS is_shore FROM lineitem)"""


def box_clamp(spark, sf_dir):
    return images.clamp_annotations(boxes(spark, sf_dir)).select("ann_id", "x", "y", "w", "h")


def annotation_geometry(spark, sf_dir):
    g = images.annotation_geometry(boxes(spark, sf_dir))
    return rounded(g.groupBy("size_bin").agg(F.count("*").alias("n"), F.avg("area_frac").alias("area_frac"), F.avg("aspect").alias("aspect"), F.avg("centre_offset").alias("centre_offset"), F.avg("letterboxed_side").alias("letterboxed_side")))


def image_rollup(spark, sf_dir):
    return rounded(images.image_rollup(boxes(spark, sf_dir)))


def side_sweep(spark, sf_dir):
    return images.sweep(boxes(spark, sf_dir), (4, 8, 16, 32), ["category"])


def evaluation_slices(spark, sf_dir):
    return images.slices(boxes(spark, sf_dir)).groupBy("slice").agg(F.count("*").alias("n"))


def letterbox_boxes(spark, sf_dir):
    """Images of many sizes, among them such whose scaled side ends in a half; boxes under 40 pixels there are dropped."""
    b = boxes(spark, sf_dir).withColumns({"width": (100 + F.col("ann_id") % 57 * 4).cast("double"), "height": (90 + F.col("ann_id") % 43 * 5).cast("double")})
    out = images.letterboxed(b, 256, 40.0)
    return rounded(out.select("ann_id", *[F.col(f"fit.{c}").alias(c) for c in ("new_w", "new_h", "pad_x", "pad_y")], "x", "y", "w", "h"), 4)


def yolo_labels(spark, sf_dir):
    return boxes(spark, sf_dir).select("ann_id", writers.yolo_lines("x", "y", "w", "h", "width", "height", "category_id").alias("line"))


def box_overlaps(spark, sf_dir):
    """Overlaps of boxes of one image, over all images."""
    return rounded(images.overlaps(boxes(spark, sf_dir), 0.3))


def _detections(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return b.select("image_id", F.col("ann_id").alias("det_id"), F.when(F.col("ann_id") % 5 == 0, 65).otherwise(F.col("category_id")).alias("category_id"), ((F.col("ann_id") % 100) / 100).alias("score"), (F.col("x") + F.col("ann_id") % 4).alias("x"), "y", "w", "h")


def detection_recall(spark, sf_dir):
    return rounded(images.recall_at(boxes(spark, sf_dir).select("image_id", "ann_id", "x", "y", "w", "h"), _detections(spark, sf_dir), 65))


def detection_ap(spark, sf_dir):
    ap = images.average_precision(boxes(spark, sf_dir), _detections(spark, sf_dir))
    return rounded(ap.groupBy("category_id").agg(F.avg("ap").alias("ap"), F.max(F.when(F.col("iou") == 0.5, F.col("ap"))).alias("ap50")))


# --- splits and provenance ------------------------------------------------------------------------------------------


def text_hashes(spark, sf_dir):
    """64-bit hashes of documents as a stand-in for image hashes: 60 bits of an md5 with the lowest bits of the id."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5("text").alias("digest"), F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("h"))


def exact_dup(spark, sf_dir):
    return splits.exact_duplicates(text_hashes(spark, sf_dir), "digest", "doc_id").select("doc_id", "first_id", "n")


def near_dup_lsh(spark, sf_dir):
    return splits.near_duplicate_hashes(text_hashes(spark, sf_dir), "h", "doc_id")


def components(spark, sf_dir):
    """Leakage groups of documents by digest and by length and source, and the sizes of the groups."""
    d = read(spark, sf_dir, "documents").withColumn("digest", F.md5("text")).withColumn("length_key", F.when(F.col("n_chars").isNotNull(), F.concat_ws(":", "source", "n_chars")))
    g = splits.leakage_groups(d, ["digest", "length_key"], "doc_id")
    return g.select("doc_id", "group_id")


def grouping_stats(spark, sf_dir):
    return splits.grouping_stats(text_hashes(spark, sf_dir), "digest")


def semi_join_prune(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    return l.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def anti_join_integrity(spark, sf_dir):
    return provenance.integrity(read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").where("c_custkey % 9 <> 0"), "o_custkey", "c_custkey")


def row_digests(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", F.sha2("n_name", 256).alias("sha256"), F.md5("n_name").alias("md5"))


def redaction_gate(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("release/"), F.lower(F.regexp_replace("s_name", "#", "/"))).alias("path"))
    return provenance.refused_paths(s, [r"0000000[1-3]", r"\.pt$"])


def attestation(spark, sf_dir):
    p = points(spark, sf_dir).select(F.when(F.col("event_id") % 50 == 0, "Hostile").otherwise("benign").alias("role"))
    return provenance.attest(p)


def numbered_ids(spark, sf_dir):
    return splits.numbered(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name"), ["s_name"], ["s_nationkey"]).select("s_suppkey", "global_id")


def _w(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


ENV = "s AS (SELECT l_returnflag AS envelope, l_linestatus AS region, l_extendedprice AS score, l_linenumber, CASE WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM lineitem)"
THR = "thr AS (SELECT envelope, quantile_cont(score, 0.95) AS threshold FROM s WHERE split = 'val' GROUP BY envelope)"
V = "v AS (SELECT vec_id AS row_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(DIMENSIONS)) + " FROM embeddings)"
RATE = "count(*) FILTER (action IN ('flag', 'pass')) AS n, count(*) FILTER (action = 'flag') AS n_flag, count(*) FILTER (action = 'abstain') AS n_abstain, count(*) AS n_total"
DIGEST = "hashed AS (SELECT doc_id, md5(text) AS digest, ('0x' || substr(md5(text), 1, 15))::BIGINT AS h FROM documents)"

ORACLE = {
    "diagonal_score": _w(V, "m AS (SELECT " + ", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS d{i}" for i in range(DIMENSIONS)) + " FROM v)") + "SELECT row_id, round(" + " + ".join(f"pow((f{i} - m{i}) / d{i}, 2)" for i in range(DIMENSIONS)) + ", 5) AS score FROM v, m",
    "standardize": _w(V, "m AS (SELECT label, " + ", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS d{i}" for i in range(DIMENSIONS)) + " FROM v GROUP BY label)") + "SELECT row_id, label, " + ", ".join(f"round((f{i} - m{i}) / CASE WHEN d{i} > 0 THEN d{i} ELSE 1 END, 5) AS f{i}" for i in range(DIMENSIONS)) + " FROM v JOIN m USING (label)",
    "calibrate_thresholds": _w(ENV) + "SELECT envelope, far_target::DOUBLE AS far_target, round(CASE far_target WHEN 0.01 THEN q[1] WHEN 0.05 THEN q[2] ELSE q[3] END, 6) AS threshold FROM (SELECT envelope, quantile_cont(score, [0.99, 0.95, 0.9]) AS q FROM s WHERE split = 'val' GROUP BY envelope), (VALUES (0.01), (0.05), (0.1)) f(far_target)",
    "far_by_stratum": _w(ENV, THR) + "SELECT envelope, region, count(*) AS n, count(*) FILTER (score > threshold) AS n_flag, round(count(*) FILTER (score > threshold)::DOUBLE / count(*), 6) AS far FROM s JOIN thr USING (envelope) WHERE split = 'test' GROUP BY envelope, region",
    "far_overall": _w(ENV) + "SELECT count(*) AS n, round(count(*) FILTER (score > 50000)::DOUBLE / count(*), 6) AS far FROM s WHERE l_linenumber < 6 AND envelope <> 'N'",
    "far_curve": _w(ENV, "q AS (SELECT envelope, f AS far_target, quantile_cont(score, [0.99, 0.98, 0.95, 0.9, 0.85, 0.8])[i] AS threshold FROM s, (VALUES (1, 0.01::DOUBLE), (2, 0.02::DOUBLE), (3, 0.05::DOUBLE), (4, 0.1::DOUBLE), (5, 0.15::DOUBLE), (6, 0.2::DOUBLE)) t(i, f) GROUP BY envelope, i, f)") + "SELECT envelope, count(*) AS n, far_target, round(threshold, 6) AS threshold, round(count(*) FILTER (score > threshold)::DOUBLE / count(*), 6) AS realized FROM s JOIN q USING (envelope) GROUP BY envelope, far_target, q.threshold",
    "far_gate": _w(ENV, "r AS (SELECT envelope, region, count(*) FILTER (l_linenumber < 7) AS n, count(*) FILTER (l_linenumber < 7 AND score > 60000)::DOUBLE / count(*) FILTER (l_linenumber < 7) AS far FROM s GROUP BY envelope, region)") + "SELECT envelope, region, CASE WHEN n < 500 OR far IS NULL THEN 'INCOMPLETE' WHEN far <= 0.16 THEN 'PASS' ELSE 'FAIL' END AS gate FROM r",
    "decision_status": _w(PTS, STATUS) + "SELECT event_id, policy, envelope_used, status, action FROM a",
    "flag_rates": _w(PTS, STATUS) + f"SELECT *, round(n_flag::DOUBLE / nullif(n, 0), 6) AS rate, CASE WHEN n < 20 THEN 'thin-n' END AS thin_n FROM (SELECT cls AS asserted_class, arm, {RATE} FROM a WHERE NOT negative_control GROUP BY cls, arm)",
    "rate_gaps": _w(PTS, STATUS, f"x AS (SELECT cls AS asserted_class, arm, {RATE} FROM a WHERE NOT negative_control GROUP BY cls, arm)", f"y AS (SELECT cls AS asserted_class, {RATE} FROM a WHERE NOT negative_control GROUP BY cls)") + "SELECT asserted_class, arm, round(x.n_flag::DOUBLE / nullif(x.n, 0), 6) AS rate, round(y.n_flag::DOUBLE / nullif(y.n, 0), 6) AS comparator_rate, y.n AS comparator_n, round(x.n_flag::DOUBLE / nullif(x.n, 0) - y.n_flag::DOUBLE / nullif(y.n, 0), 6) AS gap FROM x LEFT JOIN y USING (asserted_class)",
    "control_check": _w(PTS, STATUS) + f"SELECT arm, n, round(n_flag::DOUBLE / nullif(n, 0), 6) AS rate, coalesce(n_flag::DOUBLE / nullif(n, 0) <= 0.035 * 2 + 0.05, true) AS within FROM (SELECT arm, {RATE} FROM a WHERE negative_control GROUP BY arm)",
    "presence_rule": _w(PTS) + "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'abstain' WHEN cls = 'view' THEN 'pass' ELSE 'flag' END AS action, CASE WHEN event_id % 4 = 0 THEN 'abstain_no_track' ELSE 'scored' END AS status FROM points",
    "label_swap_matrix": _w(ENV, THR, "r AS (SELECT s.envelope AS source_class, t.envelope AS asserted_class, avg(CASE WHEN score > threshold THEN 1.0 ELSE 0.0 END) AS flag_rate FROM s, thr t WHERE s.envelope <> t.envelope AND split <> 'train' GROUP BY ALL)") + "SELECT source_class, " + ", ".join(f"round(max(CASE WHEN asserted_class = '{k}' THEN flag_rate END), 6) AS \"{k}\"" for k in "ANR") + " FROM r GROUP BY source_class",
    "admissible_splits": _w(PTS, STATUS, "k AS (SELECT DISTINCT cls FROM points)", "mem(envelope, member_class) AS (VALUES ('e_view', 'view'), ('e_view', 'signup'), ('e_click', 'click'))") + "SELECT x.cls AS source_class, y.cls AS asserted_class, CASE WHEN p.envelope = 'e_click' AND x.cls = 'signup' THEN 'test,val' WHEN p.envelope IS NULL THEN '' WHEN m.envelope IS NOT NULL THEN 'test,val' ELSE 'test,train,val' END AS splits FROM k x JOIN k y ON x.cls <> y.cls LEFT JOIN (SELECT * FROM policy WHERE policy = 'score') p ON p.class = y.cls LEFT JOIN mem m ON m.envelope = p.envelope AND m.member_class = x.cls",
    "benign_rows": _w(PTS) + "SELECT cls, count(*) AS n FROM points WHERE event_id % 6 > 1 AND cls <> 'purchase' GROUP BY cls",
    "subspace_routing": _w(PTS) + "SELECT CASE WHEN heading IS NOT NULL AND cog IS NOT NULL THEN 'core_course' ELSE 'core' END AS subspace, count(*) AS n FROM points GROUP BY subspace",
    "code_range_map": "SELECT CASE WHEN p_size = 7 THEN 'seven' WHEN p_size = 30 THEN 'thirty' WHEN p_size BETWEEN 1 AND 9 THEN 'low' WHEN p_size BETWEEN 25 AND 39 THEN 'middle' ELSE 'other' END AS class, count(*) AS n FROM part GROUP BY class",
    "success_rates": _w(PTS, "e AS (SELECT cls, event_id % 3 <> 0 AS eligible, sog > 50 AS success, coalesce(heading > 180, false) AS attributable FROM points)") + "SELECT cls, count(*) FILTER (eligible) AS n_eligible, count(*) FILTER (eligible AND success) AS n_success, count(*) FILTER (eligible AND attributable) AS n_attributable, count(*) FILTER (eligible AND attributable AND success) AS n_attributable_success, round(count(*) FILTER (eligible AND success)::DOUBLE / count(*) FILTER (eligible), 6) AS rate, round(count(*) FILTER (eligible AND attributable AND success)::DOUBLE / count(*) FILTER (eligible AND attributable), 6) AS attributable_rate FROM e GROUP BY cls",
    "box_clamp": _w(BOX, "k AS (SELECT ann_id, x, y, least(x + w, width) - x AS w, least(y + h, height) - y AS h FROM boxes)") + "SELECT ann_id, round(x, 2) AS x, round(y, 2) AS y, round(w, 2) AS w, round(h, 2) AS h FROM k WHERE w >= 1 AND h >= 1",
    "annotation_geometry": _w(BOX) + "SELECT CASE WHEN least(w, h) < 8 THEN 'tiny' WHEN least(w, h) < 32 THEN 'small' WHEN least(w, h) < 96 THEN 'medium' ELSE 'large' END AS size_bin, count(*) AS n, round(avg(w * h / (width * height)), 6) AS area_frac, round(avg(w / h), 6) AS aspect, round(avg(sqrt(pow((x + w / 2) / width - 0.5, 2) + pow((y + h / 2) / height - 0.5, 2))), 6) AS centre_offset, round(avg(least(w, h) * 640 / 120), 6) AS letterboxed_side FROM boxes GROUP BY size_bin",
    "image_rollup": _w(BOX) + "SELECT image_id, count(*) AS n_boxes, count(*) FILTER (least(w, h) >= 8) AS n_eligible, max(w * h) AS largest_area, arg_max(category, (w * h, category)) AS largest_class, string_agg(DISTINCT category, ',' ORDER BY category) AS classes FROM boxes GROUP BY image_id",
    "side_sweep": _w(BOX) + "SELECT category, s AS min_side, count(*) FILTER (least(w, h) >= s) AS n FROM boxes, (VALUES (4::DOUBLE), (8::DOUBLE), (16::DOUBLE), (32::DOUBLE)) t(s) GROUP BY category, s",
    "evaluation_slices": _w(BOX) + "SELECT 'overall' AS slice, count(*) AS n FROM boxes UNION ALL SELECT 'shore', count(*) FROM boxes WHERE is_shore UNION ALL SELECT 'source:' || source, count(*) FROM boxes GROUP BY source",
    "letterbox_boxes": _w(BOX, "z AS (SELECT *, 100 + ann_id % 57 * 4 AS iw, 90 + ann_id % 43 * 5 AS ih FROM boxes)", "f AS (SELECT *, least(256::DOUBLE / iw, 256::DOUBLE / ih) AS s FROM z)", "g AS (SELECT *, CAST(round_even(iw * s, 0) AS INTEGER) AS new_w, CAST(round_even(ih * s, 0) AS INTEGER) AS new_h FROM f)") + "SELECT ann_id, new_w, new_h, CAST(floor((256 - new_w) / 2) AS INTEGER) AS pad_x, CAST(floor((256 - new_h) / 2) AS INTEGER) AS pad_y, round(x * s + floor((256 - new_w) / 2), 4) AS x, round(y * s + floor((256 - new_h) / 2), 4) AS y, round(w * s, 4) AS w, round(h * s, 4) AS h FROM g WHERE least(w * s, h * s) >= 40",
    "yolo_labels": _w(BOX) + "SELECT ann_id, printf('%d %.6f %.6f %.6f %.6f', ascii(category), (x + w / 2) / width, (y + h / 2) / height, w / width, h / height) AS line FROM boxes",
    "box_overlaps": _w(BOX, "p AS (SELECT a.ann_id AS a, b.ann_id AS b, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i, a.w * a.h + b.w * b.h AS s FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.ann_id < b.ann_id)") + "SELECT a, b, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) >= 0.3",
    "exact_dup": _w(DIGEST) + "SELECT doc_id, first_id, n FROM hashed JOIN (SELECT digest, min(doc_id) AS first_id, count(*) AS n FROM hashed GROUP BY digest HAVING count(*) > 1) USING (digest)",
    "near_dup_lsh": _w(DIGEST, "k AS (SELECT h, min(doc_id) AS id FROM hashed GROUP BY h)") + "SELECT id AS a, doc_id AS b, 0 AS distance FROM hashed JOIN k USING (h) WHERE doc_id <> id UNION ALL SELECT x.id, y.id, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) FROM k x JOIN k y ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= 5",
    "components": """WITH RECURSIVE e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY md5(text)) AS b FROM documents WHERE text IS NOT NULL UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY concat_ws(':', source, n_chars)) FROM documents WHERE n_chars IS NOT NULL),
edges AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT doc_id, least(doc_id, coalesce(min(b), doc_id)) AS group_id FROM documents LEFT JOIN reach ON a = doc_id GROUP BY doc_id""",
    "grouping_stats": _w(DIGEST) + "SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_items, count(*) FILTER (n = 1) AS n_singletons, max(n) AS largest, sum(n - 1)::BIGINT AS n_collapsed FROM (SELECT count(*) AS n FROM hashed GROUP BY digest)",
    "semi_join_prune": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_returnflag",
    "anti_join_integrity": "SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0 GROUP BY c_custkey HAVING count(*) > 1)) AS n_repeated, (SELECT count(*) FROM orders) AS n_child, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)) AS n_orphans",
    "row_digests": "SELECT n_nationkey, sha256(n_name) AS sha256, md5(n_name) AS md5 FROM nation",
    "redaction_gate": "SELECT * FROM (SELECT s_suppkey, 'release/' || lower(replace(s_name, '#', '/')) AS path FROM supplier) WHERE regexp_matches(path, '0000000[1-3]|\\.pt$')",
    "attestation": "SELECT count(*) AS n, count(*) FILTER (role <> 'benign') AS n_blocked, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM (SELECT CASE WHEN event_id % 50 = 0 THEN 'hostile' ELSE 'benign' END AS role FROM events)",
    "numbered_ids": "SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS INTEGER) AS global_id FROM supplier",
}
QUERIES = {f.__name__: f for f in (
    mahalanobis_score, gmm_score, isolation_forest, diagonal_score, standardize, calibrate_thresholds, far_by_stratum, far_overall, far_curve, far_gate, decision_status, flag_rates, rate_gaps,
    control_check, presence_rule, label_swap_matrix, admissible_splits, benign_rows, subspace_routing, code_range_map, success_rates, box_clamp, annotation_geometry, image_rollup, side_sweep,
    evaluation_slices, letterbox_boxes, yolo_labels, box_overlaps, detection_recall, detection_ap, exact_dup, near_dup_lsh, components, grouping_stats, semi_join_prune, anti_join_integrity,
    row_digests, redaction_gate, attestation, numbered_ids,
)}
