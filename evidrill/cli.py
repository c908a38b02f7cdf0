"""Commands: build-manifest, check-assets, extract.  Exit codes: 0 done, 1 a contract or some assets fail, 2 wrong usage or no input."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrill.functions import predicates as P
from evidrill.operators import contracts
from evidrill.plans import publish
from evidrill.sources import readers
from evidrill.streaming import archive


def build_manifest(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = readers.train_table(spark, a.metadata, ["article_path", "full_article_path", "timestamp", "topic"])
    found = publish.publish(rows, a.output, {"id": ~P.valid_id(F.col("id")), "caption": ~P.has_text(F.col("caption"))})
    contracts.enforce(contracts.record_manifest(found, ["falsified"]))
    print(json.dumps({"rows": found.count(), "output": a.output}))
    return 0


def check_assets(spark: SparkSession, a: argparse.Namespace) -> int:
    wanted = spark.read.parquet(a.manifest).select("image_path").distinct()
    unsafe = P.unsafe_path_reason(F.col("image_path")).isNotNull()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(a.root)
    root = spark._jvm.org.apache.hadoop.fs.Path(a.root).makeQualified(spark._jvm.java.net.URI("file:///"), spark._jvm.org.apache.hadoop.fs.Path("/")).toUri().getPath()
    path = F.substring(F.regexp_replace("path", "^[a-z]+:/*", "/"), len(root.rstrip("/")) + 2, 1 << 30)
    rows = wanted.join(files.select(path.alias("image_path"), "content"), "image_path", "left")
    checked = readers.image_check(rows).withColumn("status", F.when(unsafe, "unsafe_staged_path").otherwise(F.col("status")))
    summary = publish.asset_summary(checked).first().asDict()
    publish.write_json(spark, summary, a.output)
    print(json.dumps(summary))
    return 0 if summary["readable"] == summary["n_assets"] else 1


def _places(spark: SparkSession, source: str, limit: int | None) -> DataFrame:
    """The archive's regular members (name, size, data_offset, identity), from its headers alone; ``limit``: the first ones."""
    ranges = archive.ranges_of(source)
    out = []
    for name, size, at, _, _ in archive.members(ranges, 0, limit if limit is not None else 1 << 62):
        out.append((name, size, at, json.dumps(ranges.identity)))
    return spark.createDataFrame(out, "name string, size long, data_offset long, identity string").where("size IS NOT NULL").withColumn("name", P.member_name(F.col("name")))


def extract(spark: SparkSession, a: argparse.Namespace) -> int:
    source = a.archive or a.archive_url
    if a.list_first is not None:
        for r in _places(spark, source, a.list_first).collect():  # as many as asked for
            print(r["name"], r["size"])
        return 0
    if not a.manifest or not a.output:
        print("extract needs --manifest and --output, or --list-first", file=sys.stderr)
        return 2
    members = _places(spark, source, None).withColumn("safe", P.unsafe_path_reason(F.col("name")).isNull())
    wanted = spark.read.parquet(a.manifest).select("image_path").distinct()
    asked = readers.requested(members, wanted, a.strip_prefix, a.member_prefix)
    counts = {r["status"]: r["count"] for r in asked.groupBy("status").count().collect()}
    if not a.dry_run:
        rows = members.join(asked.where("status = 'found'").select("name", "image_path"), "name")
        rows = archive.fetched(rows, source).where("content IS NOT NULL").drop("name").withColumnRenamed("image_path", "name")
        counts |= {r["result"]: r["count"] for r in publish.extract_members(rows, a.output).groupBy("result").count().collect()}
    print(json.dumps(counts, sort_keys=True))
    return 1 if counts.get("missing") or counts.get("duplicate") else 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m evidrill.cli", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build-manifest", help="id-keyed JSON to a checked Parquet table")
    b.add_argument("--metadata", required=True)
    b.add_argument("--output", required=True)
    b.set_defaults(run=build_manifest)
    c = sub.add_parser("check-assets", help="which of a manifest's images are there and readable")
    c.add_argument("--manifest", required=True)
    c.add_argument("--root", required=True)
    c.add_argument("--output", required=True)
    c.set_defaults(run=check_assets)
    e = sub.add_parser("extract", help="a manifest's images from an archive")
    where = e.add_mutually_exclusive_group(required=True)
    where.add_argument("--archive")
    where.add_argument("--archive-url")
    e.add_argument("--list-first", type=int)
    e.add_argument("--manifest")
    e.add_argument("--output")
    e.add_argument("--strip-prefix", default="")
    e.add_argument("--member-prefix", default="")
    e.add_argument("--dry-run", action="store_true")
    e.set_defaults(run=extract)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or SparkSession.builder.appName("evidrill").getOrCreate()
    try:
        return args.run(spark, args)
    except contracts.ContractError as e:
        print(e, file=sys.stderr)
        return 1
    except Exception as e:  # noqa: BLE001 - whatever stops a command is its exit code 2
        print(f"{type(e).__name__}: {str(e)[:500]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
