"""GeoJSON in, JSON lines out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions.coords import degrees
from placeweave.session import materialize

# Ordinates are read as text: some exports write them as degrees, minutes and seconds.
FEATURE = "type string, geometry struct<type:string,coordinates:array<string>>, properties map<string,string>"


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``raw, type, geometry, properties``: one Feature per line; .bz2 and .gz are read by their extension. Lines that are no
    JSON object, and blank lines, are dropped; the raw line is kept byte for byte.

    ``geometry.coordinates`` are doubles: ordinates that are text are read by the grammar of :func:`degrees`; what is neither
    a number nor a coordinate (the nested lists of lines and areas) is null."""
    lines = spark.read.text(paths).withColumnRenamed("value", "raw")
    return _features(lines.filter(F.trim("raw").startswith("{")))


def read_collections(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The columns of :func:`read_lines` of FeatureCollections that are one JSON value over a whole file; without ``features`` a
    file gives no rows. Such a file is read by one task; :func:`read_any` splits those that hold a Feature per line."""
    files = spark.read.text(paths, wholetext=True)
    return _features(files.select(F.explode(F.from_json("value", "features array<string>")["features"]).alias("raw")))


def file_forms(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, form`` of each file that is not blank: ``lines`` if its first line is a JSON object of its own that is no
    collection; ``rows`` if it is a collection with each Feature on one line, as most exports are; else ``whole``."""
    v = F.trim("value")
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), v.alias("v")).filter("v <> ''")
    row = F.get_json_object(_row("v"), "$.type") == "Feature"
    # What may stand around Features that have a line each: brackets, and the collection's own members, complete on their line.
    frame = F.col("v").isin("{", "[", "]", "}", "]}") | F.col("v").rlike(r'^\{?[^{}]*"features"\s*:\s*\[$|^"[^"]+"\s*:.*[^\[{]$|^\]\s*,.*\}$')
    kind = F.get_json_object("v", "$.type")
    own = F.coalesce(kind != "FeatureCollection", F.try_parse_json("v").isNotNull() & F.get_json_object("v", "$.features").isNull())
    seen = lines.groupBy("path").agg(
        F.min_by(own, F.when(F.col("at") == 0, F.col("i"))).alias("own"),
        F.count_if(F.coalesce(row, F.lit(False))).alias("rows"), F.count_if(~F.coalesce(row, F.lit(False)) & ~frame).alias("other"), F.count_if(F.col("v") == "{").alias("opened"),
    )
    return seen.select("path", F.when(F.col("own"), "lines").when((F.col("rows") > 0) & (F.col("other") == 0) & (F.col("opened") <= 1), "rows").otherwise("whole").alias("form"))


def read_any(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files of either form, each read as :func:`file_forms` says. The driver holds a path and a form a file, as its own
    listing of the files does."""
    forms: dict[str, list[str]] = {}
    for path, form in file_forms(spark, paths).collect():
        forms.setdefault(form, []).append(path)
    parts = [read_lines(spark, sorted(forms["lines"]))] if "lines" in forms else []
    if "rows" in forms:
        rows = spark.read.text(sorted(forms["rows"])).select(_row("value").alias("raw"))
        parts.append(_features(rows.filter(F.get_json_object("raw", "$.type") == "Feature")))
    if "whole" in forms:
        parts.append(read_collections(spark, sorted(forms["whole"])))
    if not parts:
        return read_lines(spark, paths)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _row(line: str) -> Column:
    """A Feature's line without the comma that parts it from the next."""
    return F.regexp_replace(F.trim(line), r"\s*,$", "")


def _features(lines: DataFrame) -> DataFrame:
    read = lines.select("raw", F.from_json("raw", FEATURE).alias("feature")).filter(F.col("feature").isNotNull()).select("raw", "feature.*")
    number = lambda x: F.coalesce(x.try_cast("double"), F.when(~x.startswith("["), degrees(x)))
    geometry = F.struct(F.col("geometry.type").alias("type"), F.transform("geometry.coordinates", number).alias("coordinates"))
    return read.withColumn("geometry", F.when(F.col("geometry").isNotNull(), geometry))


def with_uid(features: DataFrame, key: str | None = None) -> DataFrame:
    """``uid`` from a column, or else numbered once and written, so that it never changes when it is computed again."""
    if key:
        return features.withColumn("uid", F.col(key).cast("bigint"))
    return materialize(features.withColumn("uid", F.monotonically_increasing_id()), "features")


def with_guid(features: DataFrame) -> DataFrame:
    """``guid``: the property ``lieu:guid``, or one derived from uid and content, the same in every run."""
    made = F.sha1(F.concat_ws("|", F.col("uid").cast("string"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("properties"))))))
    return features.withColumn("guid", F.coalesce(F.nullif(F.col("properties")["lieu:guid"], F.lit("")), F.substring(made, 1, 32)))


def write_json_lines(responses: DataFrame, path: str, json: str = "response", order: str = "uid") -> None:
    """One JSON text per line, ordered by uid over the part files."""
    responses.orderBy(order).select(F.col(json).alias("value")).write.text(path)
