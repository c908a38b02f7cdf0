import json

from evidrill import cli
from tests.test_archive_stream import tar


def test_commands_and_exit_codes(spark, tmp_path, capsys):
    record = {"caption": "a", "article_path": "x/1.txt", "full_article_path": "x/1.txt", "caption_entities_spacy": [], "caption_entities_rel": [], "image_has_person": True, "topic": "t", "source": "bbc", "timestamp": "2020-01-01", "title": "", "title_entities_spacy": []}
    (tmp_path / "m.json").write_text(json.dumps({str(i): record | {"id": i, "image_path": f"root/a/{i}.jpg"} for i in range(3)}))
    assert cli.main(["build-manifest", "--metadata", str(tmp_path / "m.json"), "--output", str(tmp_path / "m")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3
    (tmp_path / "bad.json").write_text(json.dumps({"1": record | {"id": 2, "image_path": "x.jpg"}}))
    assert cli.main(["build-manifest", "--metadata", str(tmp_path / "bad.json"), "--output", str(tmp_path / "bad")], spark) == 2
    (tmp_path / "a.tar").write_bytes(tar([f"a/{i}.jpg" for i in range(3)], payload=lambda i: b"\xff\xd8\xff" + bytes(i + 1)))
    run = lambda *more: cli.main(["extract", "--archive", str(tmp_path / "a.tar"), *more], spark)
    capsys.readouterr()
    assert run("--list-first", "2") == 0 and capsys.readouterr().out.splitlines() == ["a/0.jpg 4", "a/1.jpg 5"]
    how = ("--manifest", str(tmp_path / "m"), "--output", str(tmp_path / "out"), "--strip-prefix", "root/")
    assert run(*how, "--dry-run") == 0 and not (tmp_path / "out").exists()
    assert run(*how) == 0 and (tmp_path / "out/root/a/2.jpg").read_bytes() == b"\xff\xd8\xff\0\0\0"
    assert run(*how[:-2]) == 1 and run() == 2 and cli.main(["extract"], spark) == 2
    check = ["check-assets", "--manifest", str(tmp_path / "m"), "--root", str(tmp_path / "out"), "--output", str(tmp_path / "s.json")]
    assert cli.main(check, spark) in (0, 1)
    (tmp_path / "out/root/a/1.jpg").unlink()
    assert cli.main(check, spark) == 1 and json.loads((tmp_path / "s.json").read_text())["missing"] == 1
