"""Report queries and further joins over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, tables
from ..operators import decisions, images, provenance, rates, reports, tracks
from .model_queries import BOX, STATUS, _policy, _w, acted, boxes, read
from .track_queries import LAST, LIMITS, NUM, PTS, WINDOWS, points, rounded

ENVELOPES = {"shoppers": {"cls": ("purchase", "view")}, "north": {"band": ("north",), "cls": ("view", "click")}, "all_clicks": {"cls": ("click",)}}


def envelope_coverage(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("band", geo.bands("lat", ((25.5, "south"),), "north"))
    return reports.envelope_coverage(p, ENVELOPES, by="cls")


def window_coverage(spark, sf_dir):
    w = tracks.last_windows(tracks.trip_sequence(points(spark, sf_dir), limits=LIMITS), WINDOWS, ("mmsi", "trip_seq"))
    return rounded(reports.window_coverage(w, [], ["mmsi", "trip_seq"]))


def eligibility(spark, sf_dir):
    return rounded(reports.eligibility(boxes(spark, sf_dir), ["source", "category"]))


def annotation_filter(spark, sf_dir):
    b = boxes(spark, sf_dir)
    kept = reports.filter_annotations(b, b.where("ann_id % 50 = 0").select("image_id"), ["A", "R"], 8.0, (8.0, 32.0), (100.0, 1024.0))
    return kept.groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("w"), 2).alias("sum_w"))


def sequence_keys(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("img/"), F.lower("p_brand"), F.lit("/f_"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"), F.when(F.col("p_size") < 15, "video").when(F.col("p_size") < 30, "set").otherwise("single").alias("source"))
    return p.select("p_partkey", reports.sequence_key("path", "source", ["video"], ["set"]).alias("sequence"))


def one_to_one_join(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    n = read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return tables.join_one_to_one(o, n, ["o_orderkey"]).groupBy("y").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def static_attributes(spark, sf_dir):
    """Line items with the customer segment of their order, which they lack: left joins with a fill."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, "first").alias("tag"))  # noqa: E741
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("tag"), "o_custkey")
    return tables.attach(l, o, ["l_orderkey"], ["tag"]).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_customers"))


def smoke_sample(spark, sf_dir):
    return tables.smoke(points(spark, sf_dir), 50, "event_id").select("event_id")


def first_flags(spark, sf_dir):
    """Causal scan: the first checkpoint of each vessel at which its mean speed so far is above a threshold."""
    p = points(spark, sf_dir)
    c = tracks.prefixes(p, ["mmsi"], 86_400, 604_800)
    score = tracks.at_checkpoints(p, c, ["mmsi"], "sog", "lon").withColumnRenamed("lon", "range_nm")
    score = score.withColumn("action", F.when(F.col("score") > 51, "flag").otherwise("pass"))
    return rounded(decisions.first_flag(score, ["mmsi"]))


def cell_kinds(spark, sf_dir):
    rows = acted(spark, sf_dir).withColumn("swap", F.col("asserted_class") == "click")
    return rows.groupBy(reports.cell_kind("negative_control", "swap").alias("kind")).agg(F.count("*").alias("n"))


def pooled_gaps(spark, sf_dir):
    rows = acted(spark, sf_dir)
    r = reports.pooled_gap(rates.flag_rates(rows, ["arm"]), rates.flag_rates(rows.withColumn("action", F.when(F.col("event_id") % 2 == 0, "flag").otherwise("pass")), ["arm"]), ["arm"])
    return rounded(r.select("arm", "rate", "pooled_rate", "pooled_n", "pooled_gap"))


def overlay_bands(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", geo.overlay_bands(F.col("p_size") * 25).alias("b"))
    return p.select("p_partkey", "b.y0", "b.y1")


def percent_texts(spark, sf_dir):
    r = rates.flag_rates(acted(spark, sf_dir), ["asserted_class"])
    return r.select("asserted_class", tables.percent_text("rate").alias("text"))


def class_shares(spark, sf_dir):
    p = points(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("n"), F.count_if(F.col("sog") > 50).alias("n_fast"))
    return rounded(p.select("cls", "n", tables.share(F.col("n_fast"), F.col("n")).alias("share")))


def slugs(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", tables.slug("p_type").alias("slug"))


def fast_straight(spark, sf_dir):
    """Windows in the fast-and-straight band, of features rounded as they are given out: a speed of 60 stays 60 where its
    interpolation falls short of it by rounding."""
    w = tracks.last_windows(tracks.trip_sequence(points(spark, sf_dir), limits=LIMITS), WINDOWS, ("mmsi", "trip_seq"))
    w = w.withColumn("role", F.when(F.col("mmsi") % 2 == 0, "benign").otherwise("other"))
    return rounded(w).where(decisions.fast_and_straight(60.0, 0.3)).select("mmsi", "trip_seq", "window_s")


def window_choice(spark, sf_dir):
    """The longest requested window that has a model, else the primary one."""
    p = points(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 == 0, F.array(F.lit(600), F.lit(1200))).when(F.col("event_id") % 3 == 1, F.array(F.lit(300))).alias("asked"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit(600), F.lit(300))).otherwise(F.array(F.lit(900))).alias("there"))
    return p.select("event_id", decisions.resolve_window("asked", "there", 900).cast("long").alias("window_s"))


def backends(spark, sf_dir):
    """Both decision backends through one surface."""
    a = decisions.decide(acted(spark, sf_dir).select("event_id").join(_scored_status(spark, sf_dir), "event_id"), "consistency")
    o = F.when(F.col("cls") == "view", "detected").when(F.col("cls") == "click", "missed").otherwise("mislabeled")
    b = decisions.decide(points(spark, sf_dir).select("event_id", (F.col("event_id") % 4 != 0).alias("track_present"), o.alias("outcome")), "presence_only", track_present="track_present", outcome="outcome")
    both = a.select(F.lit("consistency").alias("backend"), "action").unionByName(b.select(F.lit("presence_only").alias("backend"), "action"))
    return both.groupBy("backend", "action").agg(F.count("*").alias("n"))


def class_lists(spark, sf_dir):
    return decisions.class_lists(_policy(spark))


def props_values(spark, sf_dir):
    """Nested lookup with a default."""
    p = read(spark, sf_dir, "events").withColumn("j", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a":{"b":'), F.col("event_id").cast("string"), F.lit("}}"))).otherwise(F.col("props")))
    return p.select("event_id", tables.json_value("j", "$.a.b", "none").alias("b"), tables.json_value("j", "$.k", "-").alias("k"))


def image_annotations(spark, sf_dir):
    """All images, those without annotations too."""
    im = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"))
    return images.with_annotations(im, boxes(spark, sf_dir).where("image_id % 7 <> 0")).select("image_id", "n_boxes", "n_eligible", "largest_class")


def slice_context(spark, sf_dir):
    """Boxes by the context of the image: shore and source come from the image table."""
    im = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.col("p_brand").alias("source"), (F.col("p_size") > 25).alias("is_shore"))
    return images.in_context(boxes(spark, sf_dir), im, ["image_id"]).groupBy("slice").agg(F.count("*").alias("n"))


def target_trips(spark, sf_dir):
    """Trips of classes with a role; the others are no targets."""
    t = tracks.trip_sequence(points(spark, sf_dir), limits=LIMITS)
    c = tracks.modal("cls", ["mmsi"], t).withColumn("role", F.when(F.col("cls") == "view", "benign").when(F.col("cls") == "click", "held_out").otherwise("non_target"))
    t = tables.attach(t.groupBy("mmsi", "trip_seq").agg(F.count("*").alias("n")), c, ["mmsi"])
    return t.where("role <> 'non_target'").groupBy("role").agg(F.count("*").alias("n_trips"), F.sum("n").alias("n_points"))


def fact_checks(spark, sf_dir):
    """What a caption says against the tables."""
    facts = read(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.countDistinct("l_returnflag").alias("classes"), F.max("l_discount").alias("top"))
    return provenance.fact_checks(facts, {"three classes": F.col("classes") == 3, "more than a million": F.col("n") > 1_000_000, "no discount above 0.5": F.col("top") <= 0.5})


def _scored_status(spark, sf_dir):
    return points(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("sog")).alias("score"), F.lit(60.0).alias("threshold"), F.when(F.col("event_id") % 13 != 0, "scored").otherwise("no_window").alias("status"))


def trip_starts_by_day(spark, sf_dir):
    p = tracks.trip_sequence(points(spark, sf_dir), limits=LIMITS).groupBy("mmsi", "trip_seq").agg(F.min("t").alias("t0"))
    return p.groupBy(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("t0") / 86_400).cast("int")), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


RATES = "count(*) FILTER (action = 'flag')::DOUBLE / nullif(count(*) FILTER (action IN ('flag', 'pass')), 0)"
ORACLE = {
    "envelope_coverage": _w(PTS, "e AS (SELECT 'shoppers' AS envelope, * FROM points WHERE cls IN ('purchase', 'view') UNION ALL SELECT 'north', * FROM points WHERE lat >= 25.5::DOUBLE AND cls IN ('view', 'click') UNION ALL SELECT 'all_clicks', * FROM points WHERE cls = 'click')") + "SELECT envelope, cls, count(*) AS n_tracks, count(DISTINCT mmsi) AS n_vessels FROM e GROUP BY envelope, cls",
    "window_coverage": LAST + "SELECT window_s, count(*) AS n, count(*) FILTER (window_complete) AS n_complete, count(*) FILTER (window_complete AND window_s = longest) AS n_longest, round(count(*) FILTER (window_complete)::DOUBLE / count(*), 6) AS share FROM (SELECT *, max(CASE WHEN window_complete THEN window_s END) OVER (PARTITION BY mmsi, trip_seq) AS longest FROM feats) GROUP BY window_s",
    "eligibility": _w(BOX) + "SELECT source, category, count(*) AS n_boxes, count(*) FILTER (least(w, h) >= 8) AS n_eligible, count(DISTINCT CASE WHEN least(w, h) >= 8 THEN image_id END) AS n_images, round(avg(CASE WHEN least(w, h) >= 8 THEN 1.0 ELSE 0.0 END), 6) AS share FROM boxes GROUP BY source, category",
    "annotation_filter": _w(BOX) + "SELECT category, count(*) AS n, round(sum(w), 2) AS sum_w FROM boxes WHERE category IN ('A', 'R') AND least(w, h) >= 8 AND least(w, h) < 32 AND w * h >= 100 AND w * h < 1024 AND image_id IN (SELECT image_id FROM boxes WHERE ann_id % 50 = 0) GROUP BY category",
    "sequence_keys": "SELECT p_partkey, CASE WHEN p_size < 15 THEN 'video:f' WHEN p_size < 30 THEN 'set:img/' || lower(p_brand) ELSE 'single:img/' || lower(p_brand) || '/f_' || p_partkey || '.png' END AS sequence FROM part",
    "one_to_one_join": "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY y",
    "static_attributes": "SELECT CASE WHEN l_linenumber = 1 THEN 'first' ELSE o_orderstatus END AS tag, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY tag",
    "first_flags": _w(PTS, "ends AS (SELECT mmsi, min(t) AS t0, max(t) AS t1 FROM points GROUP BY mmsi HAVING min(t) + 86400 <= max(t) + 1e-9)", "checks AS (SELECT mmsi, t0 + 86400 + i * 604800.0::DOUBLE AS t_check FROM ends, range(100000) r(i) WHERE i <= floor((t1 - t0 - 86400 + 1e-9) / 604800) UNION SELECT mmsi, t1 FROM ends)", "s AS (SELECT c.mmsi, t_check, avg(sog) AS score, arg_max(lon, t) AS range_nm FROM checks c JOIN points p ON p.mmsi = c.mmsi AND p.t <= t_check + 1e-9 GROUP BY c.mmsi, t_check)") + "SELECT mmsi, bool_or(score > 51) AS flagged, round(min(t_check) FILTER (score > 51), 6) AS t_flag, round(arg_min(range_nm, t_check) FILTER (score > 51), 6) AS range_flag_nm, count(*) AS n_checkpoints FROM s GROUP BY mmsi",
    "cell_kinds": _w(PTS, STATUS) + "SELECT CASE WHEN negative_control THEN 'nc' WHEN cls = 'click' THEN 'swp' ELSE 'unc' END AS kind, count(*) AS n FROM a GROUP BY kind",
    "pooled_gaps": _w(PTS, STATUS) + f"SELECT arm, round({RATES}, 6) AS rate, round(count(*) FILTER (event_id % 2 = 0)::DOUBLE / count(*), 6) AS pooled_rate, count(*) AS pooled_n, round({RATES} - count(*) FILTER (event_id % 2 = 0)::DOUBLE / count(*), 6) AS pooled_gap FROM a WHERE NOT negative_control GROUP BY arm",
    "overlay_bands": "SELECT p_partkey, CAST(round_even(p_size * 25 * 0.06::DOUBLE, 0) AS INTEGER) AS y0, CAST(p_size * 25 - round_even(p_size * 25 * 0.06::DOUBLE, 0) AS INTEGER) AS y1 FROM part",
    "percent_texts": _w(PTS, STATUS) + f"SELECT cls AS asserted_class, coalesce(printf('%.1f%%', 100 * {RATES}), '-') AS text FROM a WHERE NOT negative_control GROUP BY cls",
    "class_shares": _w(PTS) + "SELECT cls, count(*) AS n, round(count(*) FILTER (sog > 50)::DOUBLE / greatest(count(*), 1), 6) AS share FROM points GROUP BY cls",
    "slugs": "SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part",
    "fast_straight": LAST + "SELECT mmsi, trip_seq, window_s FROM feats WHERE sog_p95 >= 60 AND straightness >= 0.3 AND window_complete AND mmsi % 2 = 0",
    "window_choice": "SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 600 WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN 300 ELSE 900 END AS BIGINT) AS window_s FROM events",
    "backends": _w(PTS) + "SELECT 'consistency' AS backend, CASE WHEN event_id % 13 = 0 OR event_id % 7 = 0 THEN 'abstain' WHEN sog > 60 THEN 'flag' ELSE 'pass' END AS action, count(*) AS n FROM points GROUP BY ALL UNION ALL SELECT 'presence_only', CASE WHEN event_id % 4 = 0 THEN 'abstain' WHEN cls = 'view' THEN 'pass' ELSE 'flag' END AS action, count(*) FROM points GROUP BY ALL",
    "class_lists": "SELECT CASE WHEN policy = 'score' AND envelope IS NOT NULL THEN 'scoreable' ELSE 'abstain' END AS list, string_agg(class, ',' ORDER BY class) AS classes FROM (VALUES ('view', 'score', 'e_view'), ('click', 'score', 'e_click'), ('purchase', 'abstain', NULL), ('signup', 'score', NULL)) p(class, policy, envelope) GROUP BY list",
    "props_values": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'none' END AS b, CASE WHEN event_id % 2 = 0 THEN '-' ELSE coalesce(json_extract_string(props, '$.k'), '-') END AS k FROM events",
    "image_annotations": _w(BOX, "kept AS (SELECT * FROM boxes WHERE image_id % 7 <> 0)") + "SELECT p_partkey AS image_id, count(ann_id) AS n_boxes, count(*) FILTER (least(w, h) >= 8) AS n_eligible, arg_max(category, (w * h, category)) AS largest_class FROM part LEFT JOIN kept ON image_id = p_partkey GROUP BY p_partkey",
    "slice_context": _w(BOX, "c AS (SELECT p_brand, p_size > 25 AS shore FROM boxes JOIN part ON p_partkey = image_id)") + "SELECT 'overall' AS slice, count(*) AS n FROM c UNION ALL SELECT 'shore', count(*) FROM c WHERE shore UNION ALL SELECT 'source:' || p_brand, count(*) FROM c GROUP BY p_brand",
    "target_trips": _w(PTS, NUM, "modal AS (SELECT mmsi, cls FROM (SELECT mmsi, cls, count(*) AS n FROM points GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY n DESC, cls) = 1)") + "SELECT CASE cls WHEN 'view' THEN 'benign' ELSE 'held_out' END AS role, count(DISTINCT (mmsi, trip_seq)) AS n_trips, count(*) AS n_points FROM (SELECT n.mmsi, n.trip_seq, m.cls FROM numbered n JOIN modal m USING (mmsi)) WHERE cls IN ('view', 'click') GROUP BY role",
    "fact_checks": "SELECT unnest(['three classes', 'more than a million', 'no discount above 0.5']) AS \"check\", unnest([count(DISTINCT l_returnflag) = 3, count(*) > 1000000, max(l_discount) <= 0.5]) AS holds FROM lineitem",
    "smoke_sample": "SELECT event_id FROM events ORDER BY md5('0:' || CAST(event_id AS VARCHAR)), event_id LIMIT 50",
    "trip_starts_by_day": _w(PTS, NUM) + "SELECT strftime(DATE '1970-01-01' + CAST(floor(t0 / 86400) AS INTEGER), '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT min(t) AS t0 FROM numbered GROUP BY mmsi, trip_seq) GROUP BY day",
}
QUERIES = {f.__name__: f for f in (
    envelope_coverage, window_coverage, eligibility, annotation_filter, sequence_keys, one_to_one_join, static_attributes, smoke_sample, first_flags, cell_kinds, pooled_gaps, overlay_bands, percent_texts, trip_starts_by_day,
    class_shares, slugs, fast_straight, window_choice, backends, class_lists, props_values, image_annotations, slice_context, target_trips, fact_checks,
)}
