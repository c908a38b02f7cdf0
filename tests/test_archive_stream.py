import io
import tarfile

import pytest
from pyspark.sql import functions as F

from evidrill.operators.contracts import ContractError
from evidrill.streaming import archive


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read(self, start, n):
        return self.data[start : start + n]


def tar(names, form=tarfile.GNU_FORMAT, payload=None, **pax):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=form, **pax) as t:
        for i, n in enumerate(names):
            data = (payload or (lambda i: b"p%d" % i * (300 * i + 1)))(i)
            info = tarfile.TarInfo(n)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.mark.parametrize("form", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_members_resume_at_every_boundary(form):
    names = ["a/1", "x" * 150 + "/2", "a/é"]
    data = tar(names, form, **({"pax_headers": {"comment": "c"}} if form == tarfile.PAX_FORMAT else {}))
    whole = list(archive.members(Bytes(data), 0, 99))
    assert [m[0] for m in whole] == names and [m[1] for m in whole] == [2 * (300 * i + 1) for i in range(3)] and all(m[3] % 512 == 0 for m in whole)
    at, pax, again = 0, {}, []
    for _ in names:
        (m,) = archive.members(Bytes(data), at, 1, pax)
        again.append(m)
        at, pax = m[3], m[4]
    assert again == whole and list(archive.members(Bytes(data), at, 1, pax)) == []


def broken(kind):
    data = bytearray(tar(["a", "b"]))
    if kind == "checksum":
        data[0] ^= 1
    elif kind == "type":
        data[156:157] = b"Z"
        data[148:156] = b"%06o\0 " % (sum(data[:148]) + 256 + sum(data[156:512]))
    elif kind == "cut":
        data = data[:700]
    elif kind == "compressed":
        import gzip

        data = gzip.compress(bytes(data))
    elif kind == "single_zero":
        data[512 * 2 : 512 * 3] = bytes(512)
    return bytes(data)


@pytest.mark.parametrize("kind", ["checksum", "type", "cut", "compressed", "single_zero"])
def test_malformed_archives_are_errors(kind):
    with pytest.raises(archive.ArchiveError):
        list(archive.members(Bytes(broken(kind)), 0, 99))


def served(data, **change):
    def get(url, headers):
        a, b = map(int, headers["Range"][6:].split("-"))
        b = min(b, len(data) - 1)
        h = {"Content-Range": f"bytes {a}-{b}/{len(data)}", "Content-Length": str(b - a + 1), "ETag": '"v1"'} | change.get("headers", {})
        return change.get("status", 206), {k: v for k, v in h.items() if v is not None}, data[a : b + 1][: change.get("cut")]

    return get


def test_http_ranges():
    data = tar(["a", "b"])
    source = archive.HttpRanges("http://x", served(data))
    assert [m[0] for m in archive.members(source, 0, 9)] == ["a", "b"]


@pytest.mark.parametrize("change", [{"status": 200}, {"headers": {"Content-Range": "x"}}, {"headers": {"Content-Range": "bytes 5-9/99"}}, {"headers": {"Content-Encoding": "gzip"}}, {"headers": {"Content-Length": "3"}}, {"headers": {"ETag": None}}, {"headers": {"ETag": 'W/"v1"'}}, {"cut": 100}])
def test_bad_http_answers_are_errors(change):
    with pytest.raises(archive.ArchiveError):
        archive.HttpRanges("http://x", served(tar(["a"]), **change)).read(0, 512)


def test_changed_source_is_an_error():
    data, tag = tar(["a"]), ['"1"']
    source = archive.HttpRanges("http://x", lambda u, h: served(data, headers={"ETag": tag[0]})(u, h))
    source.read(0, 512)
    tag[0] = '"2"'
    with pytest.raises(archive.ArchiveError, match="changed"):
        source.read(0, 512)


def decode(data):
    if data == b"broken":
        raise ValueError("no image")
    return len(data)


def encoder(items):
    return [[float(x), 1.0] for x in items]


def targets(spark, n):
    return spark.createDataFrame([(i, f"root/a/{i}.jpg") for i in range(n)], "id long, image_path string")


def test_stream_chunks_resume_and_failures(spark, tmp_path):
    names = ["../escape.jpg", *[f"./a/{i}.jpg" for i in range(5)]]
    (tmp_path / "a.tar").write_bytes(tar(names, payload=lambda i: b"broken" if i == 3 else b"x" * (i + 1)))
    want, out = targets(spark, 6), str(tmp_path / "out")
    archive.embed_archive(spark, str(tmp_path / "a.tar"), want, out, decode, encoder, members_per_batch=2, strip="root/", once=True)
    first = archive.status(spark, out, want).first()
    assert (first["n_done"], first["n_missing"]) == (1, 5)
    for _ in range(2):  # the second call has nothing left to do
        with pytest.raises(archive.MissingTargets, match="without 1 targets"):
            archive.embed_archive(spark, str(tmp_path / "a.tar"), want, out, decode, encoder, members_per_batch=2, strip="root/")
        s = archive.status(spark, out, want).first()
        assert (s["n_done"], s["n_failed"], s["n_missing"]) == (4, 1, 1)
    rows = spark.read.parquet(f"{out}/chunks").collect()
    assert sorted(r["metadata_id"] for r in rows) == [0, 1, 3, 4]
    assert all(abs(sum(x * x for x in r["vec"]) - 1) < 1e-5 for r in rows)
    assert archive.validated_chunks(spark, out).count() == 4
    # a record that failed is read again by its range once it decodes
    archive.embed_archive(spark, str(tmp_path / "a.tar"), want, out, lambda data: 1.0, encoder, members_per_batch=2, strip="root/", require_all=False)
    s = archive.status(spark, out, want).first()
    assert (s["n_done"], s["n_failed"]) == (5, 0) and archive.validated_chunks(spark, out).count() == 5
    spark.read.parquet(f"{out}/chunks/chunk=0").unionByName(spark.read.parquet(f"{out}/chunks/chunk=1")).write.mode("append").parquet(f"{out}/chunks/chunk=0")
    with pytest.raises(ContractError, match="not_as_marked"):
        archive.validated_chunks(spark, out)


def test_a_source_that_changes_between_sessions_stops_the_stream(spark, tmp_path):
    names, out, path = [f"a/{i}.jpg" for i in range(6)], str(tmp_path / "out"), tmp_path / "a.tar"
    path.write_bytes(tar(names))
    run = lambda **how: archive.embed_archive(spark, str(path), targets(spark, 6), out, decode, encoder, members_per_batch=2, strip="root/", **how)
    run(once=True)
    path.write_bytes(tar(names, payload=lambda i: b"other"))
    with pytest.raises(Exception, match="has changed"):
        run()


def test_lock_state_layout_and_repeats(spark, tmp_path):
    out, path = str(tmp_path / "out"), tmp_path / "a.tar"
    path.write_bytes(tar(["a/0.jpg", "a/1.jpg"]))
    run = lambda o=out, **how: archive.embed_archive(spark, str(path), targets(spark, 2), o, decode, encoder, **({"strip": "root/"} | how))
    with archive.writer_lock(spark, out), pytest.raises(RuntimeError, match="another writer"):
        run()
    run()
    with pytest.raises(ContractError, match="another archive, encoder"):
        run(contract=archive.EncoderContract("m", 2))
    state = tmp_path / "out/state.json"
    (tmp_path / "out/.state.json.crc").unlink(missing_ok=True)
    state.write_text(state.read_text().replace('"streak": 0', '"streak": 1'))
    with pytest.raises(ContractError, match="checksum"):
        run()
    with pytest.raises(Exception, match="layout"):
        run(str(tmp_path / "other"), strip="", layout_limit=2)
    path.write_bytes(tar(["a/0.jpg", "a/1.jpg", "./a/0.jpg"]))
    with pytest.raises(Exception, match="comes twice"):
        run(str(tmp_path / "twice"))
    path.write_bytes(tar(["a/0.jpg", "a/1.jpg"]))
    with pytest.raises(Exception, match="2 dimensions instead of 3"):
        run(str(tmp_path / "dim"), contract=archive.EncoderContract("m", 3))


def test_failures_in_a_row_stop_the_stream(spark, tmp_path):
    (tmp_path / "a.tar").write_bytes(tar([f"a/{i}.jpg" for i in range(9)], payload=lambda i: b"broken" if 2 <= i < 7 else b"x"))
    with pytest.raises(Exception, match="5 in a row"):  # over three batches
        archive.embed_archive(spark, str(tmp_path / "a.tar"), targets(spark, 9), str(tmp_path / "out"), decode, encoder, members_per_batch=2, strip="root/")


def test_oversize_members_are_failures(spark, tmp_path):
    from unittest import mock

    (tmp_path / "a.tar").write_bytes(tar(["a/0.jpg"], payload=lambda i: b"x" * 100))
    rows = spark.createDataFrame([(0, "p", 100, 512, None)], "id long, image_path string, size long, data_offset long, identity string").na.fill("null")
    with mock.patch.object(archive, "SIZE_LIMIT", 10):
        got = archive.decode_and_encode(archive.fetched(rows, str(tmp_path / "a.tar"), limit=10), decode, encoder).first()
    assert got["vec"] is None and "bytes" in got["error"]


def test_many_failures_stop_the_stream(spark, tmp_path):
    (tmp_path / "a.tar").write_bytes(tar([f"a/{i}.jpg" for i in range(6)], payload=lambda i: b"broken"))
    with pytest.raises(Exception, match="don't decode"):
        archive.embed_archive(spark, str(tmp_path / "a.tar"), targets(spark, 6), str(tmp_path / "out"), decode, encoder, strip="root/", least_attempts=5)
