"""Sources: position messages, annotations, images, taxonomies."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tracks

POSITIONS = "MMSI long, BaseDateTime string, LAT float, LON float, SOG float, COG float, Heading float, VesselType float, TransceiverClass string"
VOC = "filename string, size struct<width:int,height:int>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
COCO = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,area:double,iscrowd:int>>, categories array<struct<id:long,name:string,supercategory:string>>"
BOXES = "image string, width int, height int, category string, x double, y double, w double, h double"


def positions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Position messages as CSV with a header; columns are taken by name, others are never parsed."""
    wanted = [c.split() for c in POSITIONS.split(", ")]
    # the place of a row in its input: file, where the read part begins, and the number within it
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return spark.read.option("header", True).csv(path).select(*[F.expr(f"try_cast(`{name}` AS {kind})").alias(name) for name, kind in wanted], place.alias("_place"))


def positions_zip(spark: SparkSession, path: str, chunk: int = 200_000) -> DataFrame:
    """Position messages in zip archives: the first CSV of each, in chunks. An archive is one task; it is not splittable."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = [c.split()[0] for c in POSITIONS.split(", ")]
    kinds = {c.split()[0]: {"long": "float64", "float": "float32", "string": "str"}[c.split()[1]] for c in POSITIONS.split(", ")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    first = next((n for n in sorted(z.namelist()) if n.lower().endswith(".csv")), None)
                    if first:
                        with z.open(first) as f:
                            for part in pd.read_csv(f, usecols=names, dtype=kinds, chunksize=chunk):
                                part["MMSI"] = part["MMSI"].astype("Int64")
                                yield part[names].astype(object).where(part[names].notna(), None)

    return files.mapInPandas(run, POSITIONS)


def points(raw: DataFrame) -> DataFrame:
    """Messages as a point stream: mmsi, t, lat, lon, sog, cog, heading, vessel_type, transceiver; unusable fixes dropped,
    sentinels NULL, coordinates as doubles."""
    d = lambda c: F.col(c).cast("double")
    out = raw.select(F.col("MMSI").alias("mmsi"), tracks.parse_time("BaseDateTime").alias("t"), d("LAT").alias("lat"), d("LON").alias("lon"), d("SOG").alias("sog"), d("COG").alias("cog"), d("Heading").alias("heading"), F.col("VesselType").alias("vessel_type"), F.col("TransceiverClass").alias("transceiver"), *([F.col("_place").alias("_order")] if "_place" in raw.columns else []))
    out = tracks.sentinels_to_null(tracks.valid_fixes(out))
    return out.withColumn("sog", F.when(~F.isnan("sog"), F.col("sog")))


def _coco_tables(whole: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    images = whole.select(F.explode("images").alias("r")).select("r.*")
    boxes = whole.select(F.explode("annotations").alias("r")).select("r.*")
    boxes = boxes.withColumns({c: F.col("bbox").getItem(i).cast("double") for i, c in enumerate("xywh")})
    return images, boxes, whole.select(F.explode("categories").alias("r")).select("r.*")


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations (with x, y, w, h) and categories of a COCO file."""
    return _coco_tables(spark.read.option("multiLine", True).json(path))


def coco_splits(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "valid", "test"), name: str = "_annotations.coco.json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of an export with a folder and a file per split; images and annotations carry their split. Ids are those of
    each split's file, so (split, id) is the key. Spark's readers pass over names with a leading underscore, so the driver
    reads these files, one JSON document each."""

    def text(path: str) -> str:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    rows = spark.createDataFrame([(s, text(f"{root}/{s}/{name}")) for s in splits], "split string, text string")
    whole = rows.select("split", F.from_json("text", COCO).alias("c")).select("split", "c.*")
    parts = [(s, _coco_tables(whole.where(F.col("split") == s))) for s in splits]
    tag = lambda i: reduce(DataFrame.unionByName, [p[i].withColumn("split", F.lit(s)) for s, p in parts])
    return tag(0), tag(1), reduce(DataFrame.unionByName, [p[2] for _, p in parts]).distinct()


def voc(spark: SparkSession, path: str) -> DataFrame:
    """One row per object of Pascal-VOC XML files."""
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(VOC).load(path)
    b = F.col("o.bndbox")
    return rows.select(F.col("filename").alias("image"), F.col("size.width").alias("width"), F.col("size.height").alias("height"), F.explode("object").alias("o")).select(
        "image", "width", "height", F.col("o.name").alias("category"), b["xmin"].alias("x"), b["ymin"].alias("y"), (b["xmax"] - b["xmin"]).alias("w"), (b["ymax"] - b["ymin"]).alias("h")
    )


def corner_csv(spark: SparkSession, path: str) -> DataFrame:
    """Boxes given by corners: filename, class, xmin, ymin, xmax, ymax."""
    rows = spark.read.option("header", True).schema("filename string, class string, xmin double, ymin double, xmax double, ymax double").csv(path)
    return rows.select(F.col("filename").alias("image"), F.col("class").alias("category"), F.col("xmin").alias("x"), F.col("ymin").alias("y"), (F.col("xmax") - F.col("xmin")).alias("w"), (F.col("ymax") - F.col("ymin")).alias("h"))


def curated(manifest: DataFrame, boxes: DataFrame, path_col: str = "path") -> DataFrame:
    """Manifest rows whose image (by base name) has a box."""
    name = F.substring_index(F.col(path_col), "/", -1)
    return manifest.withColumn("image", name).join(boxes.select("image").distinct(), "image", "left_semi")


def image_size(head: bytes) -> tuple[int, int] | None:
    """Width and height from a PNG or JPEG header, without decoding pixels."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(head):
        if head[at] != 0xFF:
            return None
        kind = head[at + 1]
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", head[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
    return None


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height of image files (NULL for other formats)."""

    @F.pandas_udf("struct<width:int,height:int>")
    def size(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image_size(bytes(c)) or (None, None) for c in content], columns=["width", "height"]).astype("Int32")

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", size("content").alias("s")).select("path", "s.width", "s.height")


def config(spark: SparkSession, path: str) -> dict:
    """A configuration file from any store that Spark reads: YAML (where the yaml package is installed) or JSON."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if path.lower().endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError(f"{path}: reading YAML needs the yaml package; JSON does not") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)


def taxonomy(data: Mapping) -> tuple[dict[int, str], list[tuple[int, int, str]], dict[str, str]]:
    """Exact codes, ranges and roles of a taxonomy, as ``config`` reads it: {"by_code": {30: c, "60-69": c}, "roles": {c: role}}."""
    exact, ranges = {}, []
    for k, v in (data.get("by_code") or {}).items():
        low, _, high = str(k).partition("-")
        if high:
            ranges.append((int(low), int(high), v))
        else:
            exact[int(low)] = v
    return exact, ranges, dict(data.get("roles") or {})


def policy(spark: SparkSession, data: Mapping) -> DataFrame:
    """The class policy of a configuration as a table: class, policy, envelope, reason."""
    rows = [(c, e.get("policy"), e.get("envelope"), e.get("reason")) for c, e in sorted((data.get("classes") or {}).items())]
    return spark.createDataFrame(rows, "class string, policy string, envelope string, reason string")


def day_range(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Days from first to last, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
