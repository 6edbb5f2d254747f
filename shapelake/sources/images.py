"""Image, mask and manifest sources as DataFrames."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.kernels import codec

IMAGES = "image_id string, width int, height int, n_channels int, data binary, error string"


def read_files(spark: SparkSession, path: str, glob: str = "*", most_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Files as (path, length, content, sha256), and those refused for their length (path, length, reason)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    big = F.col("length") > most_bytes if most_bytes is not None else F.lit(False)
    good = files.filter(~big).select("path", "length", "content", F.sha2("content", 256).alias("sha256"))
    return good, files.filter(big).select("path", "length", F.lit("too large").alias("reason"))


def decode(files: DataFrame, name: str = "path", most_pixels: int = 64_000_000) -> DataFrame:
    """Decoded images: image_id, size, channels, data in BGR(A) or gray order; or why not, in ``error``.

    8-bit PNG without interlace is read. JPEG and WEBP have no decoder here and are refused by name. A broken
    file gives an error row, never a failed job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw, row = data.as_py(), (key, None, None, None, None, "empty")
                if raw:
                    try:
                        if raw[:2] == b"\xff\xd8" or raw[8:12] == b"WEBP":
                            raise ValueError("format without decoder")
                        if len(raw) > 24 and int.from_bytes(raw[16:20], "big") * int.from_bytes(raw[20:24], "big") > most_pixels:
                            raise ValueError("too many pixels")
                        a = codec.decode_png(raw)
                        a = a[:, :, [0, 0, 0, 1]] if a.shape[2] == 2 else a
                        a = a[:, :, [2, 1, 0, 3][: a.shape[2]]] if a.shape[2] > 1 else a
                        row = (key, a.shape[1], a.shape[0], a.shape[2], np.ascontiguousarray(a).tobytes(), None)
                    except ValueError as e:
                        row = (key, None, None, None, None, str(e))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)], names=["image_id", "width", "height", "n_channels", "data", "error"])

    return files.select(F.col(name).cast("string").alias("k"), "content").mapInArrow(run, IMAGES)


def read_images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """Images of a folder by Spark's own image source (BGR(A) bytes), keyed by file path; what it can't decode
    has an error."""
    raw = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", glob).load(path)
    i = F.col("image")
    bad = i["height"] < 0
    return raw.select(
        i["origin"].alias("image_id"),
        F.when(~bad, i["width"]).alias("width"),
        F.when(~bad, i["height"]).alias("height"),
        F.when(~bad, i["nChannels"]).alias("n_channels"),
        F.when(~bad, i["data"]).alias("data"),
        F.when(bad, "not decoded").alias("error"),
    )


def read_confidence_maps(files: DataFrame, key: str = "path") -> DataFrame:
    """Rows (image_id, label, y, x, confidence) of NPZ files that hold an (h, w) float map per label; zeros and
    entries of other shapes give nothing, unreadable files neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    maps = np.load(io.BytesIO(data.as_py() or b""), allow_pickle=False)
                    names = maps.files
                except (ValueError, OSError, EOFError, AttributeError):
                    continue
                for label in sorted(names):
                    a = maps[label]
                    if a.ndim != 2 or a.dtype.kind not in "fiub":
                        continue
                    y, x = np.nonzero(a)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(y), pa.string()), pa.array([label] * len(y), pa.string()), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(a[y, x].astype(np.float64))], names=["image_id", "label", "y", "x", "confidence"])

    return files.select(F.col(key).cast("string").alias("k"), "content").mapInArrow(run, "image_id string, label string, y int, x int, confidence double")


GOLDEN_CASE = "schema_version string, case_id string, assets struct<source:struct<file_name:string,drive_file_id:string,sha256:string,media_type:string>,golden:struct<file_name:string,drive_file_id:string,sha256:string,media_type:string>,current:struct<file_name:string,drive_file_id:string,sha256:string,media_type:string>>"
SEMANTIC_MANIFEST = "schema_version string, case_id string, features array<struct<id:string,semantic_role:string,disposition:string,importance:string,palette_role:string,compression_policy:string>>, relations array<struct<subject:string,predicate:string,object:string>>, evaluation_regions array<struct<id:string,feature_ids:array<string>>>"
# What the manifest's enumerations allow.
DISPOSITIONS = ["required", "optional", "forbidden"]
IMPORTANCES = ["identity_critical", "important", "supporting", "compressible"]
POLICIES = ["preserve", "symbolic", "omit"]


def read_documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON documents, one per file, with an explicit schema; and those that aren't JSON (path, text)."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    readable = F.try_parse_json("value").isNotNull()
    good = raw.filter(readable).withColumn("d", F.from_json("value", schema)).select("path", "d.*")
    return good, raw.filter(~readable).select("path", F.col("value").alias("text"))


def manifest_errors(manifests: DataFrame) -> DataFrame:
    """What makes semantic manifests invalid: values outside the enumerations, repeated ids, relations and
    regions of unknown features. Rows: case_id, error, value."""
    f = manifests.select("case_id", F.explode("features").alias("f")).select("case_id", "f.*")
    ids = f.select("case_id", F.col("id").alias("value")).distinct()
    row = lambda df, error: df.select("case_id", F.lit(error).alias("error"), "value")
    enum = lambda c, allowed: row(f.filter(F.col(c).isNotNull() & ~F.col(c).isin(allowed)).select("case_id", F.col(c).alias("value")), c)
    ends = manifests.select("case_id", F.explode("relations").alias("r")).select("case_id", F.explode(F.array("r.subject", "r.object")).alias("value")).distinct()
    members = manifests.select("case_id", F.explode("evaluation_regions").alias("r")).select("case_id", F.explode("r.feature_ids").alias("value")).distinct()
    twice = f.groupBy("case_id", F.col("id").alias("value")).count().filter("count > 1")
    parts = [
        enum("disposition", DISPOSITIONS),
        enum("importance", IMPORTANCES),
        enum("compression_policy", POLICIES),
        row(twice, "repeated feature"),
        row(ends.join(ids, ["case_id", "value"], "left_anti"), "unknown feature in relation"),
        row(members.join(ids, ["case_id", "value"], "left_anti"), "unknown feature in region"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verify_assets(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Assets of golden cases against the files found by name: expected and actual digest, PASS or FAIL.

    ``files``: path, sha256. An asset without digest is left out; a file that isn't there fails."""
    assets = F.array(*[F.struct(F.lit(n).alias("asset"), F.col(f"assets.{n}.file_name").alias("file_name"), F.col(f"assets.{n}.sha256").alias("expected")) for n in ("source", "golden", "current")])
    a = cases.select("case_id", F.explode(assets).alias("a")).select("case_id", "a.*").filter("expected is not null")
    f = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("sha256").alias("actual"))
    j = a.join(f, "file_name", "left")
    return j.withColumn("status", F.when(F.col("actual") == F.lower("expected"), "PASS").otherwise("FAIL"))
