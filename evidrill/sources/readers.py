"""Readers: labelled-pair JSON, id-keyed JSON, strict CSV, arrays, archives, files."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrill.functions import predicates as P

ANNOTATION = "id long, image_id long, similarity_score double, source_dataset int, falsified boolean"
RECORD = (
    "id long, caption string, image_path string, article_path string, full_article_path string, caption_entities_spacy array<string>, caption_entities_rel array<string>, "
    "image_has_person boolean, topic string, source string, timestamp string, title string, title_entities_spacy array<string>"
)


def pair_json(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Rows of ``annotations`` of one split's object, with its ``source_datasets`` names; another structure is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"annotations array<struct<{_struct(ANNOTATION)}>>, source_datasets map<string,string>").alias("o"))
    ok = F.when(F.col("o.annotations").isNull() | F.col("o.source_datasets").isNull(), F.raise_error(F.lit(f"{path}: no annotations or source_datasets"))).otherwise(F.col("o.annotations"))
    return raw.select(F.posexplode(ok).alias("row", "a"), F.col("o.source_datasets").alias("source_names")).select(F.lit(split).alias("split"), "row", "a.*", "source_names")


def pair_json_raw(spark: SparkSession, path: str, split: str) -> DataFrame:
    """S1 for audits: (split, row, json) with each annotation as it stands, so types and missing keys show."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "annotations array<string>").alias("o"))
    return raw.select(F.lit(split).alias("split"), F.posexplode("o.annotations").alias("row", "json"))


def _struct(ddl: str) -> str:
    return ",".join(":".join(x.strip().split(" ", 1)) for x in ddl.split(", "))


def keyed_json(spark: SparkSession, path: str) -> DataFrame:
    """(key, record json) of an object keyed by decimal ids; the object is read as a map, never as a schema."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("o"))
    return raw.select(F.explode("o").alias("key", "json"))


def records(spark: SparkSession, path: str, split: str, schema: str = RECORD) -> DataFrame:
    """Typed records of an id-keyed object; ``key_ok`` says whether the key is decimal and the record's own id."""
    rows = keyed_json(spark, path).select("key", F.from_json("json", schema).alias("r"), F.col("json").startswith("{").alias("is_object"))
    key_ok = F.coalesce(F.col("key").rlike("^[0-9]+$") & (F.try_to_number("key", F.lit("99999999999999999999")).cast("long") == F.col("r.id")), F.lit(False))
    return rows.select("key", (key_ok & F.col("is_object")).alias("key_ok"), "r.*", F.lit(split).alias("split"))


def train_table(spark: SparkSession, path: str, optional: list[str], split: str = "train") -> DataFrame:
    """S3: records in one table by id, required and optional columns; a bad key or row is an error."""
    rows = records(spark, path, split)
    bad = ~F.col("key_ok") | ~P.valid_id(F.col("id")) | ~P.has_text(F.col("caption")) | P.unsafe_path_reason(F.col("image_path")).isNotNull()
    fail = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("bad record at key "), F.col("key"))).cast("long")).otherwise(F.col("id"))
    return rows.select(fail.alias("id"), "image_path", "caption", "source", *optional, "split").orderBy("id")


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Every column a string; blank cells are empty strings, never null."""
    found = spark.read.csv(path, header=True, inferSchema=False, nullValue="\0", emptyValue="", multiLine=True, escape='"')
    return found.na.fill("")


def csv_typed(spark: SparkSession, path: str, schema: str, blank_as_null: list[str]) -> DataFrame:
    """Typed columns; blanks are null only in the columns named."""
    rows = csv_strings(spark, path)
    kinds = {n: t for n, t in (x.strip().split(" ", 1) for x in schema.split(","))}
    return rows.select(*[(F.nullif(F.col(c), F.lit("")) if c in blank_as_null or t != "string" else F.col(c)).cast(t).alias(c) for c, t in kinds.items()])


def file_probe(spark: SparkSession, folder: str, expected: list[str]) -> DataFrame:
    """Which of the expected files are there, with their size in MB."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    want = spark.createDataFrame([(x,) for x in expected], "name string")
    return F.broadcast(want).join(found, "name", "left").select("name", F.col("length").isNotNull().alias("exists"), F.round(F.col("length") / 1e6, 3).alias("size_mb"))


def npy(spark: SparkSession, path: str) -> DataFrame:
    """(row, vec) of the two-dimensional arrays of ``.npy`` files, rows numbered within a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                for k in range(0, len(a), 4096):
                    yield pd.DataFrame({"path": p, "row": np.arange(k, min(k + 4096, len(a))), "vec": list(a[k : k + 4096])})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, vec array<float>")


def tar_members(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Members of tar files of any compression, in order; ``safe`` by the rules of relative paths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                rows, size = [], 0
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
                    for i, m in enumerate(archive):
                        data = archive.extractfile(m).read() if payload and m.isfile() else None
                        rows.append((p, i, m.name, m.size, m.isfile(), data))
                        size += m.size
                        if size > 32 << 20:
                            yield pd.DataFrame(rows, columns=["archive", "member", "name", "size", "is_file", "content"])
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "member", "name", "size", "is_file", "content"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member long, name string, size long, is_file boolean, content binary")
    name = P.member_name(F.col("name"))
    return found.withColumn("name", name).withColumn("safe", F.col("is_file") & P.unsafe_path_reason(name).isNull())


def requested(members: DataFrame, wanted: DataFrame, strip: str = "", prefix: str = "") -> DataFrame:
    """Wanted paths beside the archive's members: found, missing, duplicate."""
    names = wanted.select("image_path", P.requested_member(F.col("image_path"), strip, prefix).alias("name"))
    per = members.where("safe").groupBy("name").agg(F.count("*").alias("n"))
    return names.join(per, "name", "left").select("image_path", "name", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("found").alias("status"))


def image_check(rows: DataFrame, path: str = "image_path", content: str = "content") -> DataFrame:
    """Status, format, size and SHA-256 of image payloads; decoded only if Pillow is there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from PIL import Image
        except ImportError:
            Image = None  # noqa: N806
        for b in batches:
            out = []
            for p, data in zip(b[path], b[content], strict=True):
                if data is None:
                    out.append((p, False, "missing", None, None, None))
                elif not len(data):
                    out.append((p, True, "zero_byte", None, None, None))
                elif Image is None:
                    kind = "JPEG" if bytes(data[:3]) == b"\xff\xd8\xff" else "PNG" if bytes(data[:8]) == b"\x89PNG\r\n\x1a\n" else None
                    out.append((p, True, "ok" if kind == "JPEG" else "unexpected_format" if kind else "unreadable", kind, None, None))
                else:
                    try:
                        with Image.open(io.BytesIO(data)) as image:
                            image.load()
                            out.append((p, True, "ok" if image.format == "JPEG" else "unexpected_format", image.format, *image.size))
                    except Exception:  # noqa: BLE001 - any decoder error makes the file unreadable
                        out.append((p, True, "unreadable", None, None, None))
            found = pd.DataFrame(out, columns=[path, "file_found", "status", "format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})
            found["size_bytes"] = pd.array([None if x is None else len(x) for x in b[content]], "Int64")
            found["sha256"] = [None if x is None else hashlib.sha256(x).hexdigest() for x in b[content]]
            yield found

    return rows.select(path, content).mapInPandas(run, f"{path} string, file_found boolean, status string, format string, width int, height int, size_bytes long, sha256 string")


def config(path: str) -> dict:
    """A JSON or YAML file of the driver."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)
