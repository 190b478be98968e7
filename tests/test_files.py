import hashlib
import json

import pytest

from cadenza.sources import files


def test_manifests_round_trip(spark, tmp_path):
    s = [{"start": 0.5, "end": 2.0, "text": "a", "accepted": True, "diagnostics": {"k": "1"}}, {"start": 3.0, "end": 4.0, "accepted": False, "reject_reason": ""}]
    for folder, name, batch in (("one", "manifest.json", "old"), ("one", "batch_manifest.json", "new"), ("two", "manifest.json", "b")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps({"batch_id": batch, "target": "t", "sentences": s}, indent=1))
    got = files.read_manifests(spark, str(tmp_path))
    assert sorted((r.batch_id, r.ordinal, r.start) for r in got.collect()) == [("b", 1, 0.5), ("b", 2, 3.0), ("new", 1, 0.5), ("new", 2, 3.0)]
    files.write_manifests(got.drop("target", "folder"), str(tmp_path / "out"))
    out = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted((r["batch_id"], r["accepted"], r["rejected"], r["reject_summary"]) for r in out) == [("b", 1, 1, {"unknown": 1}), ("new", 1, 1, {"unknown": 1})]
    files.write_csv(got, str(tmp_path / "csv"), ["ordinal", "text", "missing"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["ordinal", "text", "missing"]


def test_captions(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\r\n00:00:01,000 --> 00:00:02,500\r\nHello <i>you</i>\r\nthere\r\n\r\n2\n00:00:03,000 --> 00:00:02,000\nback\n\n3\n00:00:01,000 --> 00:00:02,500\nHello you\nthere\n")
    (tmp_path / "b.vtt").write_text("WEBVTT\n\nNOTE x\n\n01:02.500 --> 01:03.000 align:start\nhi\n")
    (tmp_path / "c.ass").write_text(
        "[Events]\nComment: 0,0:00:00.00,0:00:01.00,D,,0,0,0,,no\nDialogue: 0,0:00:01.00,0:00:02.50,Default,,0,0,0,,{\\an8}one, two\\Nthree\n"
        "Dialogue: 0,0:00:03.00,0:00:04.00,Song JP,,0,0,0,,la\nDialogue: 0,0:00:05.00,0:00:06.00,Default,,0,0,0,,{\\pos(1,2)}sign\n"
    )
    got = [(r.file[-5:], r.cue, r.start_ms, r.end_ms, r.text, r.kind) for r in files.read_cues(spark, str(tmp_path)).collect()]
    assert sorted(got) == [
        ("a.srt", 1, 1000, 2500, "Hello you\nthere", "speech"), ("b.vtt", 1, 62500, 63000, "hi", "speech"),
        ("c.ass", 1, 1000, 2500, "one, two\nthree", "speech"), ("c.ass", 2, 3000, 4000, "la", "lyrics"), ("c.ass", 3, 5000, 6000, "sign", "screen_text"),
    ]


def test_sidecars_inventory_and_stores(spark, tmp_path):
    names = ["x/ep1.mkv", "x/ep1.srt", "x/ep1.jp.ass", "x/ep1.en.ass", "x/ep10.srt", "x/ep2.mp4"]
    got = files.discover_sidecars(spark.createDataFrame([(n,) for n in names], "path string")).collect()
    assert [tuple(r) for r in got] == [("x/ep1.mkv", "x/ep1.jp.ass")]
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert [r.sha256 for r in files.inventory(spark, str(tmp_path)).collect()] == [hashlib.sha256(b"abc").hexdigest()]
    store, new = spark.createDataFrame([(1, "a"), (2, "b")], "key int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "key int, v string")
    assert sorted(map(tuple, files.upsert(store, new).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.key for r in files.missing_features(new, store).collect()] == [3]
    clean, bad = files.import_packages(spark.createDataFrame([("s", "r", "o", "x"), ("s", "r", "o", "x"), ("t", "r", "o", "x"), ("t", "r", "o", "y")], "sha string, reference_key string, role_key string, label string"))
    assert [r.sha for r in clean.collect()] == ["s"] and [r.sha for r in bad.collect()] == ["t"]
    bank = spark.createDataFrame([(1, [1.0, 0.0])], "id int, primary array<double>")
    files.save_bank(bank, str(tmp_path / "bank"))
    assert files.load_bank(spark, str(tmp_path / "bank")).count() == 1
    bank.unionByName(spark.createDataFrame([(2, [1.0])], "id int, primary array<double>")).write.mode("overwrite").parquet(str(tmp_path / "bank/vectors"))
    with pytest.raises(ValueError):
        files.load_bank(spark, str(tmp_path / "bank"))
    files.write_srt(spark.createDataFrame([(1, 0.5, 1.25, "hi")], "n int, start double, stop double, text string"), str(tmp_path / "srt"))
    assert "00:00:00,500 --> 00:00:01,250" in "".join(p.read_text() for p in (tmp_path / "srt").glob("*.txt"))
