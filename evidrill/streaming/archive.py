"""Resumable stream of an archive's members: byte ranges in, checked chunks of vectors out.

The source reads the headers of an uncompressed tar by ranges and is one ordered partition;
its offset is the logical boundary after the last member read, a multiple of 512, with the
global headers and the source's identity, so a restart goes on at a header of the same bytes.
It emits places, not payloads: executors fetch those by ranges of their own, and fail if the
source is another one by then.  The sink writes one chunk a batch with a marker of its rows and
their hash, and skips ids that other chunks hold, so a batch that comes twice changes nothing.
One writer at a time holds the lock of an output.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import re
import urllib.request
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SIZE_LIMIT = 32 << 20
_EXTENDED = 1 << 20


class ArchiveError(OSError):
    """The transport or the archive is at fault, never one record."""


class FileRanges:
    """Byte ranges of a file."""

    def __init__(self, path: str, identity: tuple | None = None):
        self.path, self.identity = path, identity

    def size(self) -> int:
        found = os.stat(self.path)
        identity = (found.st_size, None, str(found.st_mtime_ns))
        if self.identity not in (None, identity):
            raise ArchiveError("the source has changed")
        self.identity = identity
        return found.st_size

    def read(self, start: int, n: int) -> bytes:
        self.size()
        with open(self.path, "rb") as f:
            f.seek(start)
            return f.read(n)


class HttpRanges:
    """T5: byte ranges by HTTP: status 206, the range asked for, no encoding, one identity of the source all along."""

    def __init__(self, url: str, get=None, timeout: tuple[float, float] = (10, 60), identity: tuple | None = None):
        self.url, self.timeout, self.identity = url, timeout, identity
        self.get = get or self._get

    def _get(self, url: str, headers: dict) -> tuple[int, dict, bytes]:
        try:
            import requests
        except ImportError:
            requests = None
        if requests is not None:
            r = requests.get(url, headers=headers, timeout=self.timeout)
            return r.status_code, dict(r.headers), r.content
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=self.timeout[1]) as r:  # noqa: S310
            return r.status, dict(r.headers), r.read()

    def _range(self, start: int, n: int) -> tuple[bytes, int]:
        headers = {"Range": f"bytes={start}-{start + n - 1}", "Accept-Encoding": "identity"}
        if self.identity is not None:  # another source answers with all of itself, which isn't status 206
            headers["If-Range"] = self.identity[1] or self.identity[2]
        status, answer, body = self.get(self.url, headers)
        h = {k.lower(): v for k, v in answer.items()}
        if self.identity is not None and status in (200, 412):
            raise ArchiveError("the source has changed")
        m = re.fullmatch(r"bytes (\d+)-(\d+)/(\d+)", h.get("content-range", ""))
        if status != 206 or not m:
            raise ArchiveError(f"no range: status {status}, Content-Range {h.get('content-range')!r}")
        first, last, total = map(int, m.groups())
        if first != start or last != min(start + n, total) - 1:
            raise ArchiveError("another range than asked for")
        if h.get("content-encoding", "identity") != "identity":
            raise ArchiveError("the source encodes ranges")
        if len(body) != last - first + 1 or int(h.get("content-length", len(body))) != len(body):
            raise ArchiveError("a range is cut short")
        etag = h.get("etag")
        identity = (total, etag if etag and not etag.startswith("W/") else None, h.get("last-modified"))
        if identity[1] is None and identity[2] is None:
            raise ArchiveError("the source has no strong identity")
        if self.identity not in (None, identity):
            raise ArchiveError("the source has changed")
        self.identity = identity
        return body, total

    def size(self) -> int:
        return self.identity[0] if self.identity is not None else self._range(0, 512)[1]

    def read(self, start: int, n: int) -> bytes:
        return self._range(start, n)[0] if n else b""


def getter(name: str | None):
    """The function ``module:name`` that answers (url, headers) with (status, headers, body); None stands for the usual one."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def ranges_of(path: str, get=None, identity: tuple | list | None = None):
    identity = tuple(identity) if identity else None
    return HttpRanges(path, get, identity=identity) if path.startswith(("http://", "https://")) else FileRanges(path, identity)


def blocks_of(size: int) -> int:
    """Bytes that a member's payload takes up."""
    return -(-size // 512) * 512


def _number(raw: bytes) -> int:
    if raw[:1] == b"\x80":
        return int.from_bytes(raw[1:], "big")
    text = raw.strip(b" \0")
    try:
        return int(text or b"0", 8)
    except ValueError as e:
        raise ArchiveError("a header holds no number") from e


def _pax(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(data):
        m = re.match(rb"(\d+) ([^=\n]+)=", data[at : at + 1024])
        if not m or at + int(m[1]) > len(data) or data[at + int(m[1]) - 1 : at + int(m[1])] != b"\n":
            raise ArchiveError("a PAX record is malformed")
        out[m[2].decode()] = data[at + m.end() : at + int(m[1]) - 1].decode("utf-8", "replace")
        at += int(m[1])
    return out


def members(source, start: int, limit: int, pax: dict[str, str] | None = None) -> Iterator[tuple[str, int | None, int, int, dict]]:
    """(name, size or None, data offset, boundary after it, global PAX headers) of up to ``limit`` members from a boundary on.

    Regular files give their size, other plain members None.  The archive ends with two
    zero blocks; a checksum, type or extension that isn't plain tar is an error.
    """
    if start % 512:
        raise ArchiveError("a boundary is a multiple of 512")
    total, at, n = source.size(), start, 0
    if total % 512:
        raise ArchiveError("an archive's size is a multiple of 512")
    shared, own, long_name = dict(pax or {}), {}, None
    while n < limit:
        head = source.read(at, 512) if at < total else b""
        if len(head) < 512:
            raise ArchiveError("the archive ends without its end mark")
        if not any(head):
            if any(source.read(at + 512, 512) or b"x"):
                raise ArchiveError("a single zero block")
            if own or long_name:
                raise ArchiveError("an extended header without its member")
            return
        if sum(head[:148]) + 32 * 8 + sum(head[156:]) != _number(head[148:156]):
            raise ArchiveError("a header's checksum is wrong")
        kind, size = head[156:157], _number(head[124:136])
        if kind in (b"x", b"g", b"L", b"K"):
            if size > _EXTENDED:
                raise ArchiveError("an extended header is too large")
            data = source.read(at + 512, size)
            if kind == b"L":
                long_name = data.rstrip(b"\0").decode("utf-8", "replace")
            elif kind != b"K":
                got = _pax(data)
                if any(k.startswith("GNU.sparse") for k in got) or (kind == b"g" and "size" in got):
                    raise ArchiveError("sparse members and global sizes aren't read")
                (shared if kind == b"g" else own).update(got)
            at += 512 + blocks_of(size)
            continue
        if kind not in (b"0", b"\0", b"1", b"2", b"5", b"7"):
            raise ArchiveError(f"a member of type {kind!r}")
        merged = shared | own
        if "size" in own:
            if not own["size"].isdecimal():
                raise ArchiveError("a PAX size is no number")
            size = int(own["size"])
        prefix = head[345:500].rstrip(b"\0") if head[257:262] == b"ustar" and head[263:265] == b"00" else b""
        plain = (prefix + b"/" if prefix else b"") + head[:100].split(b"\0")[0]
        name = merged.get("path") or long_name or plain.decode("utf-8", "replace")
        own, long_name = {}, None
        file = kind in (b"0", b"\0", b"7")
        size = size if file else 0
        after = at + 512 + blocks_of(size)
        if after > total:
            raise ArchiveError("a member is cut short")
        yield name, size if file else None, at + 512, after, dict(shared)
        at, n = after, n + 1


class ArchiveReader(SimpleDataSourceStreamReader):
    """One bounded batch of places a read; the offset is the boundary, the global headers and the source's identity."""

    def __init__(self, options: dict):
        self.path, self.limit, self.get = options["path"], int(options.get("membersPerBatch", "64")), getter(options.get("getter"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": 0, "pax": {}, "identity": None}

    def _rows(self, start: dict, stop: int | None) -> tuple[list[tuple], dict]:
        source = ranges_of(self.path, self.get, start["identity"])
        rows, at = [], dict(start)
        for name, size, offset, after, pax in members(source, start["next"], self.limit if stop is None else 1 << 62, start["pax"]):
            if stop is not None and after > stop:
                break
            rows.append((re.sub(r"^(\./)+", "", name), size, offset, after, json.dumps(source.identity)))
            at = {"next": after, "pax": pax, "identity": list(source.identity)}
            if after == stop:
                break
        return rows, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = self._rows(start, None)
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._rows(start | {"identity": end["identity"]}, end["next"])[0])


class ArchiveSource(DataSource):
    """``spark.readStream.format("tar_members").option("path", file or URL)``; option getter: see ``getter``."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "name string, size long, data_offset long, boundary long, identity string"

    def simpleStreamReader(self, schema) -> ArchiveReader:  # noqa: N802
        return ArchiveReader(self.options)


def fetched(rows: DataFrame, archive: str, get: str | None = None, limit: int = SIZE_LIMIT) -> DataFrame:
    """``rows`` (size, data_offset, identity, ...) with content, read by ranges where the task runs; null if it is over ``limit``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sources: dict[str, object] = {}
        for b in batches:
            for k in range(0, len(b), 8):  # a few payloads at a time
                part = b.iloc[k : k + 8].copy()
                content = []
                for identity, size, at in zip(part["identity"], part["size"], part["data_offset"], strict=True):
                    if identity not in sources:
                        sources[identity] = ranges_of(archive, getter(get), json.loads(identity))
                    data = sources[identity].read(int(at), int(size)) if size <= limit else None
                    if data is not None and len(data) != size:
                        raise ArchiveError("a payload is cut short")
                    content.append(data)
                part["content"] = content
                yield part

    from pyspark.sql import types as T

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())]))


@dataclass(frozen=True)
class EncoderContract:
    """What a frozen encoder is known by; chunks of different contracts don't mix."""

    model: str
    dimension: int
    preprocessing: str = ""
    tokenizer_length: int | None = None
    version: str = ""

    def signature(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    def check(self, vectors) -> None:
        if vectors.shape[1] != self.dimension:
            raise ValueError(f"{self.model} gave {vectors.shape[1]} dimensions instead of {self.dimension}")


def decode_and_encode(rows: DataFrame, decode, encoder, batch: int = 64, contract: EncoderContract | None = None) -> DataFrame:
    """(metadata_id, image_path, size, data_offset, identity, vec, error): a payload that is too large or doesn't decode is a failure of its own; the encoder's errors end the query."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                items, good, failed = [], [], []
                for i, data in zip(part.index, part["content"], strict=True):
                    try:
                        if data is None:
                            raise ValueError(f"over {SIZE_LIMIT} bytes")  # noqa: TRY301
                        items.append(decode(bytes(data)))
                        good.append(i)
                    except Exception as e:  # noqa: BLE001 - a record's own failure
                        failed.append((i, f"{type(e).__name__}: {e}"))
                if good:
                    v = np.asarray(encoder(items), np.float64).reshape(len(good), -1)
                    if contract is not None:
                        contract.check(v)
                    n = np.linalg.norm(v, axis=1)
                    if not (np.isfinite(n) & (n > 0)).all():
                        raise ValueError("encoder gave a zero or infinite vector")
                    yield part.loc[good, kept].rename(columns={"id": "metadata_id"}).assign(vec=list((v / n[:, None]).astype(np.float32)), error=None)
                if failed:
                    at = [i for i, _ in failed]
                    yield part.loc[at, kept].rename(columns={"id": "metadata_id"}).assign(vec=None, error=[e for _, e in failed])

    kept = ["id", "image_path", "size", "data_offset", "identity"]
    return rows.select(*kept, "content").mapInPandas(run, "metadata_id long, image_path string, size long, data_offset long, identity string, vec array<float>, error string")


class TooManyFailures(RuntimeError):
    """Decoding fails so often that records can't be at fault."""


class MissingTargets(RuntimeError):
    """The archive has ended and targets have neither come nor failed."""


@contextmanager
def writer_lock(spark: SparkSession, out: str):
    """One writer at a time; a lock that a crash has left is removed by hand."""
    from evidrill.plans.publish import _fs

    fs, path = _fs(spark, f"{out}/writer.lock")
    if not fs.createNewFile(path):
        raise RuntimeError(f"another writer holds {out}/writer.lock")
    try:
        yield
    finally:
        fs.delete(path, False)


class State:
    """What goes from batch to batch: failures in a row, members seen and matched; with a signature and a checksum."""

    def __init__(self, spark: SparkSession, out: str, signature: dict):
        self.spark, self.path, self.signature = spark, f"{out}/state.json", signature
        self.stored = self._load()
        self.value = self.stored["value"] if self.stored else {"batch": -1, "streak": 0, "members": 0, "matched": 0}

    @staticmethod
    def _checksum(x: dict) -> str:
        return hashlib.sha256(json.dumps({k: v for k, v in x.items() if k != "checksum"}, sort_keys=True).encode()).hexdigest()

    def _load(self) -> dict | None:
        from evidrill.operators.contracts import ContractError
        from evidrill.plans.publish import read_json

        found = read_json(self.spark, self.path)
        if found is not None and found.get("checksum") != self._checksum(found):
            raise ContractError("the state's checksum is wrong")
        if found is not None and found["signature"] != self.signature:
            raise ContractError("the output belongs to another archive, encoder or naming")
        return found

    def save(self, **value) -> None:
        from evidrill.operators.contracts import ContractError
        from evidrill.plans.publish import write_json

        if self._load() != self.stored:
            raise ContractError("the state has changed under this writer")
        new = {"signature": self.signature, "value": value}
        new["checksum"] = self._checksum(new)
        write_json(self.spark, new, self.path)
        self.stored, self.value = new, value


_FAILURE = "metadata_id long, image_path string, size long, data_offset long, identity string, error string"


def _store(made: DataFrame, out: str, number: int) -> tuple[int, int]:
    """A chunk with its marker, and its failures; -> (rows, failures)."""
    from evidrill.plans.publish import write_json

    spark = made.sparkSession
    aside = f"{out}/batches/{number}"
    made.write.mode("overwrite").parquet(aside)
    made = spark.read.schema(made.schema).parquet(aside)
    good = made.where("error IS NULL").select("metadata_id", "image_path", "vec")
    good.write.mode("overwrite").parquet(f"{out}/chunks/chunk={number}")
    made.where("error IS NOT NULL").select(*[x.split()[0] for x in _FAILURE.split(", ")]).write.mode("overwrite").json(f"{out}/failures/chunk={number}")
    n, bad = made.agg(F.count("*"), F.count("error")).first()
    rows, check = _digest(good).first()
    write_json(spark, {"chunk": number, "rows": rows, "hash": check}, f"{out}/markers/{number}.json")
    return n, bad


def _digest(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64("metadata_id", "image_path", F.transform("vec", lambda x: x.cast("string")))), F.lit(0)).cast("string").alias("hash"))


def validated_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all chunks, once markers and chunks are the same, batches are numbered without a gap, contents are as marked, and no id comes twice."""
    from evidrill.operators import contracts
    from evidrill.plans.publish import exists

    if not exists(spark, f"{out}/markers"):
        raise contracts.ContractError("no chunk is marked")
    marks = spark.read.schema("chunk long, rows long, hash string").json(f"{out}/markers", multiLine=True)
    chunks = spark.read.parquet(f"{out}/chunks")
    found = _digest(chunks, [F.col("chunk").cast("long").alias("chunk")])
    both = marks.select("chunk", F.col("rows").alias("m"), F.col("hash").alias("h"), F.lit(True).alias("marked")).join(found, "chunk", "full")
    numbers = marks.where("chunk >= 0").agg(F.count("*").alias("n"), F.max("chunk").alias("last"), F.count_distinct("chunk").alias("d"))
    gaps = numbers.select(F.lit("gaps").alias("check"), (F.coalesce(F.col("last") + 1, F.lit(0)) - F.col("d") + F.col("n") - F.col("d")).alias("n"))
    rules = {"unknown_chunk": F.col("marked").isNull(), "not_as_marked": F.col("marked").isNotNull() & ((F.coalesce("rows", F.lit(0)) != F.col("m")) | (F.coalesce("hash", F.lit("0")) != F.col("h")))}
    contracts.enforce(contracts.checks(both, rules).unionByName(gaps).unionByName(contracts.unique(chunks, ["metadata_id"])))
    return chunks


def embed_archive(
    spark: SparkSession, archive: str, targets: DataFrame, out: str, decode, encoder, members_per_batch: int = 64, strip: str = "", failure_share: float = 0.1, least_attempts: int = 20, once: bool = False,
    streak: int = 5, layout_limit: int = 1000, get: str | None = None, contract: EncoderContract | None = None, require_all: bool = True,
) -> None:
    """Streams an archive's members into chunks of unit vectors at ``out``/chunks, failures at ``out``/failures.

    ``targets`` has (id, image_path).  Failures of earlier runs are tried again first.  Ends at
    the end of the archive, where missing targets are an error if ``require_all``, or after one
    batch if ``once``; a further call goes on where this one has ended.  TooManyFailures: more
    than ``failure_share`` of a batch of ``least_attempts`` or more, or ``streak`` in a row.
    ArchiveError: after ``layout_limit`` members none was a target, or a target comes twice.
    """
    from evidrill.functions import predicates as P
    from evidrill.plans.publish import exists

    spark.dataSource.register(ArchiveSource)
    wanted = targets.select(F.col("id").cast("long").alias("id"), "image_path", P.requested_member(F.col("image_path"), strip).alias("name"))
    signature = {"archive": archive, "strip": strip, "encoder": contract.signature() if contract else None}

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = State(spark, out, signature)
        seen = batch.agg(F.count("*")).first()[0]
        rows = batch.where(F.col("size").isNotNull() & P.unsafe_path_reason(F.col("name")).isNull()).join(wanted, "name")
        if (twice := rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").first()) is not None:
            raise ArchiveError(f"target {twice['id']} comes twice")
        matched = rows.count()
        before = state.value
        if number > before["batch"]:
            members_, matched_ = before["members"] + seen, before["matched"] + matched
        else:  # a batch that is written again
            members_, matched_ = before["members"], before["matched"]
        if not matched_ and members_ >= layout_limit:
            raise ArchiveError(f"none of {members_} members is a target; the archive's layout is another")
        if exists(spark, f"{out}/chunks"):
            rows = rows.join(spark.read.parquet(f"{out}/chunks").where(F.col("chunk") != number).select(F.col("metadata_id").alias("id")), "id", "left_anti")
        rows = rows.select("id", "image_path", "size", "data_offset", "identity").repartition("id")
        n, bad = _store(decode_and_encode(fetched(rows, archive, get), decode, encoder, contract=contract), out, number)
        run, longest = before["streak"], 0
        for (error,) in spark.read.parquet(f"{out}/batches/{number}").orderBy("data_offset").select("error").collect():  # one batch
            run = run + 1 if error is not None else 0
            longest = max(longest, run)
        if longest >= streak or (n >= least_attempts and bad > failure_share * n):
            raise TooManyFailures(f"{bad} of {n} payloads don't decode, {longest} in a row")
        state.save(batch=max(number, before["batch"]), streak=run, members=members_, matched=matched_)

    with writer_lock(spark, out):
        State(spark, out, signature)
        retry_failures(spark, archive, out, decode, encoder, get, contract)
        stream = spark.readStream.format("tar_members").option("path", archive).option("membersPerBatch", str(members_per_batch))
        stream = (stream.option("getter", get) if get else stream).load()
        writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint")
        if once:
            writer.trigger(availableNow=True).start().awaitTermination()
            return
        query = writer.trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        if require_all and (missing := status(spark, out, targets).first()["n_missing"]):
            raise MissingTargets(f"the archive has ended without {missing} targets")


def retry_failures(spark: SparkSession, archive: str, out: str, decode, encoder, get: str | None = None, contract: EncoderContract | None = None) -> int:
    """Reads failed records again by their ranges; what decodes now is a chunk of its own (numbered below 0).  -> how many do."""
    from evidrill.plans.publish import exists

    if not exists(spark, f"{out}/failures"):
        return 0
    rows = spark.read.schema(_FAILURE).json(f"{out}/failures").where("data_offset IS NOT NULL").withColumnRenamed("metadata_id", "id").drop("error").dropDuplicates(["id"])
    chunks = spark.read.parquet(f"{out}/chunks")
    rows = rows.join(chunks.select(F.col("metadata_id").alias("id")), "id", "left_anti").select("id", "image_path", "size", "data_offset", "identity")
    if rows.isEmpty():
        return 0
    lowest = chunks.agg(F.min("chunk")).first()[0]
    n, bad = _store(decode_and_encode(fetched(rows, archive, get), decode, encoder, contract=contract), out, min(lowest if lowest is not None else 0, 0) - 1)
    return n - bad


def status(spark: SparkSession, out: str, targets: DataFrame) -> DataFrame:
    """Targets done, failed (and not done since) and missing, with the share that is done."""
    from evidrill.plans.publish import exists

    done = spark.read.parquet(f"{out}/chunks").select(F.col("metadata_id").alias("id")) if exists(spark, f"{out}/chunks") else targets.select("id").limit(0)
    failed = spark.read.schema("metadata_id long, image_path string, error string").json(f"{out}/failures").select(F.col("metadata_id").alias("id")).distinct() if exists(spark, f"{out}/failures") else targets.select("id").limit(0)
    state = targets.select("id").join(done.withColumn("done", F.lit(True)), "id", "left").join(failed.withColumn("failed", F.lit(True)), "id", "left")
    c = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    return state.agg(F.count("*").alias("targets"), c(F.col("done")).alias("n_done"), c(F.col("failed") & F.col("done").isNull()).alias("n_failed"), c(F.col("failed").isNull() & F.col("done").isNull()).alias("n_missing"), (c(F.col("done")) * 100.0 / F.count("*")).alias("pct_done"))
