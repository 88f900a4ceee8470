import json

import pytest
from pyspark.sql import functions as F

from laminar import schemas
from laminar.plans import pipeline as P
from laminar.plans import stages  # noqa: F401
from laminar.sources import io

CONFIG = """
stages:
  panel_detection: {backend: magi, device: cpu, options: {reading_direction: ltr}}
  bubble_detection: {backend: magi}
  vlm_extraction: {backend: qwen_vl_ollama}
  character_embedding: {backend: dinov2, options: {similarity_threshold: 0.9}}
  tts: {backend: none_yet}
"""


def inputs(spark):
    det = []
    for p in ("p1", "p2"):
        det += [("c", p, "panel", 0, 0.0, 0.0, 100.0, 100.0, 0.9), ("c", p, "panel", 1, 100.0, 0.0, 200.0, 100.0, 0.9), ("c", p, "panel", 2, 0.0, 0.0, 5.0, 5.0, 0.1)]
        det += [("c", p, "text", 0, 10.0, 10.0, 40.0, 30.0, 0.9), ("c", p, "text", 1, 110.0, 10.0, 140.0, 30.0, 0.9), ("c", p, "tail", 0, 20.0, 30.0, 30.0, 40.0, 0.9)]
        det += [("c", p, "character", 0, 10.0, 50.0, 40.0, 95.0, 0.9), ("c", p, "character", 1, 110.0, 50.0, 140.0, 95.0, 0.9)]
    answer = json.dumps({"action_description": "runs", "setting": "street", "mood": "tense", "onomatopoeia": ["BAM"]})
    hist = [0.0] * 16
    return {
        "detections": spark.createDataFrame(det, "comic_id string, page_id string, kind string, idx int, x1 double, y1 double, x2 double, y2 double, score double"),
        "tail_pairs": spark.createDataFrame([("c", p, 0, 0, 0) for p in ("p1", "p2")], "comic_id string, page_id string, ord int, text_idx int, tail_idx int"),
        "readings": spark.createDataFrame([("c", p, i, "ab", "abcd", 0.5) for p in ("p1", "p2") for i in (0, 1)], "comic_id string, page_id string, idx int, first string, second string, second_confidence double"),
        "answers": spark.createDataFrame([("c", p, i, answer if i == 0 else "no") for p in ("p1", "p2") for i in (0, 1)], "comic_id string, page_id string, panel_idx int, raw string"),
        "embeddings": spark.createDataFrame([("c", p, i, [1.0, 0.0] if i == 0 else [0.0, 1.0 if p == "p1" else -1.0], hist, f"{p}_{i}.png") for p in ("p1", "p2") for i in (0, 1)], "comic_id string, page_id string, idx int, v array<double>, hist array<double>, crop string"),
        "names": spark.createDataFrame([("char_000", "Ann")], "character_id string, name string"),
    }


def pages(spark, second=b"two"):
    return spark.createDataFrame([("c", "p1", "/p1.jpg", b"one"), ("c", "p2", "/p2.jpg", second)], "comic_id string, page_id string, path string, content binary")


def test_four_stages(spark):
    out = P.Pipeline(P.Settings.parsed(CONFIG), inputs=inputs(spark)).run(pages(spark), last="character_embedding")
    first = {r["page_id"]: r for r in out["panel_detection"].collect()}
    assert [(p["panel_id"], p["reading_order_index"]) for p in first["p1"]["panels"]] == [("p1_p000", 0), ("p1_p001", 1)] and first["p1"]["image_path"] == "/p1.jpg"
    bubbles = {r["page_id"]: r for r in out["bubble_detection"].collect()}["p1"]["panels"]
    b = bubbles[0]["bubbles"][0]
    assert (b["bubble_id"], b["type"], b["tail_point"], b["attributed_character_bbox"]) == ("p1_b000", "speech", [25.0, 35.0], [10.0, 50.0, 30.0, 45.0])
    assert bubbles[1]["bubbles"][0]["type"] == "narration"
    read = {r["page_id"]: r for r in out["vlm_extraction"].collect()}["p2"]["panels"]
    assert read[0]["onomatopoeia"] == ["BAM"] and read[0]["bubbles"][0]["dialogue_text"] == "abcd" and read[1]["mood"] == ""
    who = {r["page_id"]: r for r in out["character_embedding"].collect()}
    assert [c["character_id"] for c in who["p1"]["characters"]] == ["char_000", "char_001"] and len(who["p2"]["characters"]) == 3
    assert who["p1"]["characters"][0]["name"] == "Ann" and who["p1"]["characters"][1]["name"] is None and who["p2"]["panel_assignments"][0]["similarity"] == pytest.approx(1)
    for stage in P.STAGES[:4]:
        cols = [f.name for f in schemas.artifact(stage).fields]
        assert schemas.violations(stage, out[stage].select(*[c for c in cols if c in out[stage].columns])).count() == 0, stage


def test_cache_serves_unchanged_pages_only(spark, tmp_path):
    runs = []

    class Counting(P.Stage):
        def transform(self, i):
            runs.append(sorted(r["page_id"] for r in i["_input"].collect()))
            return i["_input"].select("comic_id", "page_id", F.length("content").alias("n"))

    config = P.Settings({"tts": P.Choice("x")})
    cache = P.Cache(spark, str(tmp_path))
    run = lambda content, force=False: sorted((r["page_id"], r["n"]) for r in P.Pipeline(config, cache, {"tts": Counting()}).run(pages(spark, content), "tts", "tts", force)["tts"].collect())
    assert run(b"two") == [("p1", 3), ("p2", 3)]
    runs.clear()
    assert run(b"two") == [("p1", 3), ("p2", 3)] and ["p1", "p2"] not in runs[1:]
    runs.clear()
    assert run(b"three") == [("p1", 3), ("p2", 5)] and runs[-1] == ["p2"]


def test_ranges_and_registry(spark):
    assert P.chosen_range("bubble_detection", "vlm_extraction") == ["bubble_detection", "vlm_extraction"]
    assert P.chosen_range(None, None) == schemas.STAGES
    with pytest.raises(ValueError, match="unknown stage"):
        P.chosen_range("x", None)
    config = P.Settings.parsed(CONFIG)
    assert config.checked() is config and config.problems == []
    assert config.of("panel_detection").options == {"reading_direction": "ltr"} and config.of("tts").device == "auto"
    assert {r["stage"]: (r["device"], r["available"]) for r in config.doctor(spark).collect()}["tts"] == ("cpu", False)
    with pytest.raises(ValueError, match="no backend 'none_yet'"):
        P.Pipeline(config).stage("tts")
    wrong = P.Settings({"bubble_detection": P.Choice("unheard", "tpu"), "panel_detection": P.Choice("magi", options=[1])})
    assert len(wrong.problems) == 3
    with pytest.raises(ValueError, match="tpu.*unheard.*no mapping"):
        wrong.checked()
    assert P.Settings.parsed("").choices == {} and P.known_for("character_embedding") == ["clip", "dinov2"]
    assert P.resolved_device("auto", lambda d: d == "mps") == "mps" and P.resolved_device("cuda") == "cuda"

    class Later(P.Stage, of="animation", backend="later"):
        def __init__(self, options=None, device="cpu"):
            super().__init__(options)
            self.device = device

    assert P.Settings({"animation": P.Choice("later", "mps", {"a": 1})}).make("animation").device == "mps"


def test_violations(spark):
    bad = spark.createDataFrame([(None, "i", [("p", [1.0], [], 5)])], schemas.ARTIFACTS["panel_detection"])
    assert {r["violation"] for r in schemas.violations("panel_detection", bad).collect()} == {"page_id is missing", "a box has not four numbers", "reading order is no permutation"}
    lines = spark.createDataFrame([("p", [("a", None, None, "dialogue", "t", "joy", 9)])], schemas.ARTIFACTS["script_generation"])
    assert [r["violation"] for r in schemas.violations("script_generation", lines).collect()] == ["intensity out of 1 to 5"]
    with pytest.raises(ValueError, match="unknown stage"):
        schemas.violations("x", lines)


def test_sources(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for name in ("a.png", "a.jpg", "b.webp", "char_000__a_c001.png"):
        (tmp_path / "c" / name).write_bytes(b"x")
    got = {r["page_id"]: r["path"].rpartition("/")[2] for r in io.page_images(spark, str(tmp_path)).collect()}
    assert got["a"] == "a.jpg" and got["b"] == "b.webp"
    wanted = spark.createDataFrame([("c", "a"), ("c", "z")], "comic_id string, page_id string")
    assert [r["page_id"] for r in io.missing_pages(wanted, io.page_images(spark, str(tmp_path))).collect()] == ["z"]
    assert [r["character_id"] for r in io.crops(spark, str(tmp_path / "c")).collect()] == ["char_000"]
    assert io.read_store(spark, str(tmp_path / "none")).count() == 0 and io.read_names(spark, str(tmp_path / "none.yaml")).count() == 0
    (tmp_path / "names.yaml").write_text("char_000: Ann\nchar_001: Bob\n")
    assert io.read_names(spark, str(tmp_path / "names.yaml")).count() == 2
    m = spark.createDataFrame([("char_000", 0, [1.0], "x.png", "c", "clip"), ("char_000", 0, [2.0], "y.png", "c", "dinov2")], "character_id string, pos bigint, v array<double>, crop string, comic_id string, backend string")
    io.write_store(m, str(tmp_path / "store"))
    io.write_store(m.where("backend = 'clip'").withColumn("crop", F.lit("z.png")), str(tmp_path / "store"))
    assert {(r["backend"], r["crop"]) for r in io.read_store(spark, str(tmp_path / "store")).collect()} == {("clip", "z.png"), ("dinov2", "y.png")}


def test_artifacts_and_reports(spark, tmp_path):
    doc = {"page_id": "p", "panels": [{"panel_id": "p_p000", "action_description": "a", "setting": "s", "mood": "m", "onomatopoeia": ["BAM"], "bubbles": [{"bubble_id": "p_b000", "dialogue_text": "it's", "ocr_confidence": 0.85}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2))
    df = io.read_artifacts(spark, str(tmp_path / "a.json"), "vlm_extraction")
    report = io.panel_report(df).first()["report"]
    assert report.split("\n")[:2] == ["=== p_p000 ===", "  action:   a"] and "[0.85]" in report and "['BAM']" in report
    assert json.loads(io.as_json(df).first()["json"])["panels"][0]["bubbles"][0]["dialogue_text"] == "it's"
    assert io.read_text(spark, str(tmp_path / "a.json")).first()["value"] == json.dumps(doc, indent=2)
    io.write_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    (tmp_path / "log.json").write_text(json.dumps([{"type": "split_applied", "from": "a", "to": "b", "sizes": [1, 2]}]))
    assert io.read_log(spark, str(tmp_path / "log.json")).first()["sizes"] == [1, 2]
    index = spark.createDataFrame([("p", [("char_000", "x", None)], [("p_p000", None, "char_000", 0.5)])], "page_id string, characters array<struct<character_id:string,representative_crop:string,name:string>>, panel_assignments array<struct<panel_id:string,bubble_id:string,character_id:string,similarity:double>>")
    assert io.character_report(index).first()["report"].split("\n") == ["=== known characters so far: 1 ===", "  char_000  name=None", "", "=== p assignments ===", "  p_p000: char_000 (similarity=0.50)"]


def test_model_seams(spark):
    from laminar.operators import refine
    from laminar.plans import models

    found = models.detect(pages(spark), lambda: 2, lambda m, data: {"panel": [(0, 0, m, len(data), 0.9)], "text": []})
    assert sorted((r["page_id"], r["kind"], r["idx"], r["x2"], r["y2"]) for r in found.collect()) == [("p1", "panel", 0, 2.0, 3.0), ("p2", "panel", 0, 2.0, 3.0)]
    vec = models.mapped(pages(spark), ["content"], "v", "array<double>", lambda: 1.5, lambda m, c: [m, float(len(c))], ("embed",))
    assert [r["v"] for r in vec.collect()] == [[1.5, 3.0]] * 2
    rows = [("c", k, 0, v, f"{k}") for k, v in enumerate(([1.0, 0.0], [0.9, 0.1], [0.0, 1.0]))]
    m = spark.createDataFrame(rows, "comic string, cluster int, pos long, v array<double>, crop string")
    out, _ = refine.refine(m, models.verdicts(lambda: None, lambda _, a, b: True, ("v",)))
    assert out.select("cluster").distinct().count() == 2
    known = spark.createDataFrame([("0", "1", False)], "crop_a string, crop_b string, same boolean")
    out, _ = refine.refine(m, models.stored_verdicts(known))
    assert out.select("cluster").distinct().count() == 3
    nested = spark.createDataFrame([("p", [("a", [("x", "t", 0.5)]), ("b", [])])], "page_id string, panels array<struct<panel_id:string,bubbles:array<struct<bubble_id:string,dialogue_text:string,ocr_confidence:double>>>>")
    assert tuple(models.panel_counts(nested).first()) == ("p", 2, 1)


def test_command_line(spark, tmp_path, capsys):
    from laminar import cli

    (tmp_path / "c.yaml").write_text(CONFIG)
    (tmp_path / "pages" / "c").mkdir(parents=True)
    for p in ("p1", "p2"):
        (tmp_path / "pages" / "c" / f"{p}.jpg").write_bytes(p.encode())
    tables = []
    for name, df in inputs(spark).items():
        df.write.parquet(str(tmp_path / name))
        tables += ["--table", f"{name}={tmp_path / name}"]
    common = ["--config", str(tmp_path / "c.yaml"), "--images", str(tmp_path / "pages"), "--cache", str(tmp_path / "cache"), *tables]
    for _ in range(2):
        assert cli.main(["run-stage", "panel_detection", *common]) == 0
        lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
        assert sorted(x["page_id"] for x in lines) == ["p1", "p2"]
    assert cli.main(["run", "--to", "bubble_detection", *common]) == 0
    assert "p1_b000" in capsys.readouterr().out
    assert cli.main(["doctor", "--config", str(tmp_path / "c.yaml")]) == 0 and "magi" in capsys.readouterr().out
    (tmp_path / "x.json").write_text("{raw}")
    assert cli.main(["inspect", "--path", str(tmp_path / "x.json")]) == 0 and "{raw}" in capsys.readouterr().out


def test_entry_contract(spark):
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 40
    assert entry.entry(spark).limit(5).count() == 5


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 30)"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=120, check=True)
    assert out.stdout.strip() == "True"


def test_images_are_read_cut_and_written(spark):
    import struct
    import zlib

    import numpy as np

    from laminar.sources import images

    r = np.random.default_rng(5)
    a = r.integers(0, 256, (9, 7, 3), dtype=np.uint8)
    assert (images.decoded(images.png(a)) == a).all() and (images.decoded(b"P6\n# note\n7 9\n255\n" + a.tobytes()) == a).all()
    flat = a.reshape(9, -1).astype(int)
    rows = []
    for y in range(9):  # every filter of the format, by its definition
        kind, line = y % 5, []
        for i in range(21):
            left, up, corner = (flat[y][i - 3] if i > 2 else 0), (flat[y - 1][i] if y else 0), (flat[y - 1][i - 3] if y and i > 2 else 0)
            p = left + up - corner
            near = sorted((abs(p - v), k, v) for k, v in enumerate((left, up, corner)))[0][2]
            line.append((flat[y][i] - (0, left, up, (left + up) // 2, near)[kind]) % 256)
        rows.append(bytes([kind, *line]))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    filtered = images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (images.decoded(filtered) == a).all()
    assert images.decoded(b"no image") is None and images.decoded(None) is None
    pages_ = spark.createDataFrame([("c", "p1", images.png(a)), ("c", "p2", b"x")], "comic_id string, page_id string, content binary")
    got = {x["page_id"]: x for x in images.rasters(pages_).collect()}
    assert (got["p1"]["height"], got["p1"]["width"], got["p2"]["gray"]) == (9, 7, None) and bytes(got["p1"]["gray"]) == images.gray(a).tobytes()
    boxes = spark.createDataFrame([("c", "p1", "k", -1, 2, 4, 3), ("c", "p1", "gone", 50, 50, 4, 4)], "comic_id string, page_id string, name string, x int, y int, w int, h int")
    cut = images.crops(pages_, boxes).collect()
    assert [x["name"] for x in cut] == ["k"] and (images.decoded(bytes(cut[0]["png"])) == a[2:5, 0:3]).all()


def test_readings_must_match_the_text_boxes(spark):
    for extra in ([("c", "p1", 7, "a", "b", 0.5)], None):
        given = inputs(spark)
        read = given["readings"]
        given["readings"] = read.unionByName(spark.createDataFrame(extra, read.schema)) if extra else read.where("not (page_id = 'p2' and idx = 1)")
        with pytest.raises(Exception, match="readings and text boxes differ on page p"):
            P.Pipeline(P.Settings.parsed(CONFIG), inputs=given).run(pages(spark), last="vlm_extraction")["vlm_extraction"].collect()


def test_weak_pairs_of_text_and_tail_go(spark):
    given = inputs(spark)
    given["tail_pairs"] = given["tail_pairs"].withColumn("score", F.when(F.col("page_id") == "p1", 0.3).otherwise(0.29))
    out = P.Pipeline(P.Settings.parsed(CONFIG), inputs=given).run(pages(spark), last="bubble_detection")["bubble_detection"]
    assert {r["page_id"]: r["panels"][0]["bubbles"][0]["type"] for r in out.collect()} == {"p1": "speech", "p2": "narration"}


def test_strict_answers_and_json_artifacts(spark, tmp_path):
    from laminar.functions import text as X

    good = json.dumps({"action_description": " runs ", "setting": "s", "mood": "m", "onomatopoeia": ["BAM", " "]})
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(X.strict_answer(F.col("t")).alias("a")).first()["a"]
    assert (one(good)["action_description"], one(good)["onomatopoeia"]) == ("runs", ["BAM"])
    for bad in ("so: " + good, good.replace('"s"', "1"), "{}", None):
        with pytest.raises(Exception, match="no such answer"):
            one(bad)
    table = spark.createDataFrame([("c", "p", "h1", [1, 2])], "comic_id string, page_id string, input_hash string, n array<int>")
    io.write_hashed_artifacts(table, str(tmp_path / "a"), "tts")
    io.write_hashed_artifacts(table.withColumn("input_hash", F.lit("h2")), str(tmp_path / "a"), "tts")
    io.write_hashed_artifacts(table, str(tmp_path / "a"), "other")
    back = io.read_hashed_artifacts(spark, str(tmp_path / "a"), "tts", "n array<int>").collect()
    assert sorted((r["input_hash"], tuple(r["n"])) for r in back) == [("h1", (1, 2)), ("h2", (1, 2))]
    from laminar.plans import models

    assert models.page_counts(table).first().asDict() == {"page_id": "p", "n": 2}
