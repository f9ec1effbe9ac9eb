"""Readers: label files in their dialects, manifests, ground truth, predictions, logs and query lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dialect:
    """How a label file is read.

    parts: 2 splits at the first tab, -1 at every tab; no_tab: skip, empty or null (what a line without a tab becomes);
    exact: only lines with exactly two parts; strip: none, path, both or line; field: which part is the label.
    """

    parts: int = 2
    no_tab: str = "skip"
    exact: bool = False
    strip: str = "none"
    field: int = 2


DIALECTS = {
    "eda": Dialect(no_tab="empty"),
    "prep": Dialect(strip="path"),
    "train": Dialect(strip="both"),
    "compare": Dialect(parts=-1, exact=True, strip="path"),
    "eval": Dialect(no_tab="empty"),
    "experiment": Dialect(no_tab="null"),
    "stage2": Dialect(strip="line"),
    "lexicon": Dialect(parts=-1),
}


def parse_labels(lines: DataFrame, dialect: str, value: str = "value") -> DataFrame:
    """(image_path, transcription) of label lines."""
    d = DIALECTS[dialect]
    line = F.regexp_replace(value, r"\r$", "")
    if d.strip == "line":
        line = F.trim(line)
    rows = lines.select(line.alias("v"))
    rows = rows.where("v <> ''") if dialect == "eda" else rows.where("trim(v) <> ''")
    parts = F.split("v", "\t", d.parts)
    rows = rows.select("v", parts.alias("p"))
    if d.exact:
        rows = rows.where(F.size("p") == 2)
    elif d.no_tab == "skip":
        rows = rows.where(F.size("p") >= 2)
    missing = F.lit("") if d.no_tab == "empty" else F.lit(None).cast("string")
    path, label = F.get("p", F.lit(0)), F.coalesce(F.get("p", F.lit(d.field - 1)), missing)
    if d.strip in ("path", "both"):
        path = F.trim(path)
    if d.strip == "both":
        label = F.trim(label)
    return rows.select(path.alias("image_path"), label.alias("transcription"))


def read_labels(spark: SparkSession, path: str, dialect: str) -> DataFrame:
    return parse_labels(spark.read.text(path), dialect)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Training lines of a language model: the last field of each line, white space collapsed, empty ones dropped."""
    text = F.trim(F.regexp_replace(F.element_at(F.split("value", "\t"), -1), r"(?U)\s+", " "))
    return spark.read.text(path).select(text.alias("text")).where("text <> ''")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(stem, quality, line_no, text) of ground-truth files; malformed ones are skipped."""
    schema = "image string, ground_truth_quality string, notes string, lines array<struct<text:string>>"
    files = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    stem = F.regexp_replace(F.element_at(F.split("image", "/"), -1), r"\.[^.]*$", "")
    rows = files.where("image is not null").select(stem.alias("stem"), F.col("ground_truth_quality").alias("quality"), F.posexplode("lines").alias("line_no", "l"))
    return rows.select("stem", "quality", "line_no", F.col("l.text").alias("text"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(experiment, stem, line) of run folders: <run>/<experiment>/debug/<id>/text.txt; blank lines are dropped."""
    at = F.regexp_extract(F.input_file_name(), r"([^/]+)/debug/([^/]+)/text\.txt$", 1)
    stem = F.regexp_replace(F.regexp_extract(F.input_file_name(), r"/debug/([^/]+)/text\.txt$", 1), r"^\d+_", "")
    return spark.read.text(path).select(at.alias("experiment"), stem.alias("stem"), F.trim("value").alias("line")).where("line <> ''")


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Fixtures of a manifest: id, image_path (or path), expected lines (a range becomes its middle, half to even)."""
    count = "struct<min:int,max:int>"
    schema = f"fixtures array<struct<id:string,image_path:string,path:string,expected_line_count:{count},curved_lines:boolean,fallback_rate_max:double,blank_margin_gain_min:double>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("fixtures").alias("f")).select("f.*")
    middle = F.bround((F.col("expected_line_count.min") + F.col("expected_line_count.max")) / 2, 0).cast("int")
    return rows.select("id", F.coalesce("image_path", "path").alias("image_path"), middle.alias("expected_lines"), F.col("expected_line_count.min").alias("min_lines"), F.col("expected_line_count.max").alias("max_lines"), "curved_lines", "fallback_rate_max", "blank_margin_gain_min")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a query list, without blank ones and comments."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query <> '' and query not like '#%'")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of image and document files below a folder, for pluggable decoders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.lower("path").rlike(r"\.(png|jpe?g|bmp|tiff?|webp|pdf)$")).select("path", "content")


def resolve_paths(df: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """df with `found`: the path if it is a known file, else the one without data/ before it, else the path as it is."""
    known = files.select(F.col("path").alias("_f")).distinct()
    bare = F.regexp_replace(path, "^data/", "")
    out = df.withColumn("_bare", bare).join(known, F.col(path) == F.col("_f"), "left").withColumnRenamed("_f", "_a")
    out = out.join(known.withColumnRenamed("_f", "_b"), F.col("_bare") == F.col("_b"), "left")
    return out.withColumn("found", F.coalesce("_a", "_b", path)).drop("_a", "_b", "_bare")


def detector_payload(df: DataFrame, payload: str) -> DataFrame:
    """df with `boxes` from detector JSON (dt_polys, dt_scores): points and score (1.0 where missing), four points at least."""
    schema = "struct<dt_polys:array<array<array<double>>>,dt_scores:array<double>>"
    parsed = F.from_json(payload, schema)
    pairs = F.transform(parsed["dt_polys"], lambda p, i: F.struct(p.alias("points"), F.coalesce(F.get(parsed["dt_scores"], i), F.lit(1.0)).alias("score")))
    return df.withColumn("boxes", F.filter(pairs, lambda x: F.size(x["points"]) >= 4))
