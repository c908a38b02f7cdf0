"""Sinks: written aside, read back, checked, and only then put in place."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidrill.operators import contracts


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def publish(df: DataFrame, path: str, rules: dict | None = None, codec: str = "zstd") -> DataFrame:
    """K2, K3, K4, K6, K7: a parquet table at ``path``, checked after it was read back; an old one stays until then."""
    spark = df.sparkSession
    aside = f"{path}.{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(aside)
    back = spark.read.schema(df.schema).parquet(aside)
    fs, source = _fs(spark, aside)
    try:
        if rules:
            contracts.enforce(contracts.checks(back, rules))
    except contracts.ContractError:
        fs.delete(source, True)
        raise
    _put_in_place(spark, aside, path)
    return spark.read.schema(df.schema).parquet(path)


def _put_in_place(spark: SparkSession, aside: str, path: str) -> None:
    """The old one is moved away, not deleted, until the new one is in place; ``recovered`` finds it after a crash in between."""
    fs, source = _fs(spark, aside)
    _, target = _fs(spark, path)
    _, old = _fs(spark, f"{path}.old")
    recovered(spark, path)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved away")
    if not fs.rename(source, target):
        if fs.exists(old):
            fs.rename(old, target)
        raise OSError(f"{aside} can't be put in place")
    fs.delete(old, True)


def recovered(spark: SparkSession, path: str) -> bool:
    """Moves what a crash has left aside back to ``path``; whether anything is there."""
    fs, target = _fs(spark, path)
    _, old = _fs(spark, f"{path}.old")
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        elif not fs.rename(old, target):
            raise OSError(f"{path}.old can't be moved back")
    return fs.exists(target)


def write_file(path: str, writer, validator) -> None:
    """E5: a file of the driver: ``writer`` fills it aside, ``validator`` raises if it isn't right, then it takes its place."""
    import os

    aside = f"{path}.{uuid.uuid4().hex}"
    try:
        writer(aside)
        validator(aside)
        os.replace(aside, path)
    finally:
        if os.path.exists(aside):
            os.unlink(aside)


def freeze_or_verify(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """K1: writes all tables if none is there; verifies them if all are; a part of them is an error."""
    spark = next(iter(tables.values())).sparkSession
    there = [n for n in tables if exists(spark, f"{folder}/{n}")]
    if there and len(there) < len(tables):
        raise contracts.ContractError(f"only {sorted(there)} of {sorted(tables)} are frozen")
    if not there:
        return {n: publish(t, f"{folder}/{n}") for n, t in tables.items()}
    frozen = {n: spark.read.parquet(f"{folder}/{n}") for n in tables}
    for n, t in tables.items():
        contracts.enforce(contracts.same_table(t, frozen[n].select(*t.columns)))
    return frozen


def clean(x):
    """K5: ``x`` with NaN and infinities as null, for strict JSON."""
    if isinstance(x, dict):
        return {str(k): clean(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [clean(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def write_json(spark: SparkSession, x, path: str) -> None:
    """K5: strict JSON, put in place whole; its round trip is checked."""
    text = json.dumps(clean(x), allow_nan=False, sort_keys=True, indent=1)
    if json.loads(text) != clean(x):
        raise contracts.ContractError("JSON doesn't read back as it was")
    aside = f"{path}.{uuid.uuid4().hex}"
    fs, source = _fs(spark, aside)
    out = fs.create(source)
    out.write(text.encode())
    out.close()
    _put_in_place(spark, aside, path)


def read_json(spark: SparkSession, path: str):
    """What ``write_json`` has put at ``path``; None if nothing is there."""
    if not recovered(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """K8: one CSV with a header, for a report's few rows; its round trip by ``csv_strings`` is checked."""
    from evidrill.sources.readers import csv_strings

    df.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    contracts.enforce(contracts.same_table(text, csv_strings(df.sparkSession, path)))


def append_failures(df: DataFrame, path: str) -> None:
    """K9: adds rows to a log."""
    df.write.mode("append").json(path)


def frozen_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below a path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


class Frozen:
    """``with Frozen(spark, path):`` raises if a file below the path is another one after a stage than before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _now(self) -> list:
        return sorted(map(tuple, frozen_hashes(self.spark, self.path).collect()))

    def __enter__(self) -> Frozen:
        self.before = self._now()
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and self._now() != self.before:
            raise contracts.ContractError(f"files below {self.path} have changed")


def duplicate_files(hashes: DataFrame, path: str = "image_path") -> DataFrame:
    """Files that share their bytes: a group's first path and its size."""
    return hashes.groupBy("sha256").agg(F.count("*").alias("n_files"), F.min(path).alias("first_path")).where("n_files > 1")


def asset_summary(checked: DataFrame) -> DataFrame:
    """Counts by status of an asset check, and of equal files."""
    s = F.col("status")
    c = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    groups = checked.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.count("*").alias("c")).agg(F.count("*").alias("unique_hashes"), c(F.col("c") > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("files_in_groups"))
    counts = checked.agg(F.count("*").alias("n_assets"), c(F.col("file_found")).alias("found"), c(~F.col("file_found")).alias("missing"), (c(F.col("file_found")) * 100.0 / F.count("*")).alias("available_pct"), c(s == "ok").alias("readable"), c(s == "unreadable").alias("corrupt"), c(s == "zero_byte").alias("zero_byte"), c(s == "unexpected_format").alias("unexpected_format"), c(s == "unsafe_staged_path").alias("unsafe"), c(s == "not_regular_file").alias("not_regular"), F.count("sha256").alias("hashed"))
    return counts.crossJoin(groups)


def merge_chunks(chunks: DataFrame, expected: DataFrame, key: str = "metadata_id") -> DataFrame:
    """Rows of all chunks by ascending key, numbered from 0; a missing, unknown or repeated key is an error.

    Rows are numbered within ranges of the key with fixed bounds, from the counts of the ranges
    before, so no window sees all of them and numbers don't depend on how tasks are dealt.
    """
    contracts.enforce(contracts.unique(chunks, [key]).unionByName(contracts.contained(expected, chunks, [key])).unionByName(contracts.contained(chunks, expected, [key])))
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in chunks.approxQuantile(key, [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []  # n - 1 numbers
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    placed = chunks.withColumn("part", part)
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "start")  # one row a range
    w = Window.partitionBy("part").orderBy(key)
    return placed.join(F.broadcast(starts), "part").withColumn("embedding_row", F.col("start") + F.row_number().over(w) - 1).drop("part", "start")


def extract_members(members: DataFrame, root: str) -> DataFrame:
    """Writes safe members below ``root`` of a folder that executors share; a file that is there stays."""
    import os
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, data in zip(b["name"], b["content"], strict=True):
                target = os.path.join(root, name)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                aside = f"{target}.{uuid.uuid4().hex}"
                with open(aside, "wb") as f:
                    f.write(data)
                try:
                    os.link(aside, target)
                    out.append((name, "extracted"))
                except FileExistsError:
                    out.append((name, "kept"))
                finally:
                    os.unlink(aside)
            yield pd.DataFrame(out, columns=["name", "result"])

    return members.where("safe").select("name", "content").mapInPandas(run, "name string, result string")
