import math
import random

import pytest
from pyspark.sql import functions as F

from laminar.functions import color, geometry as G, text as X, vectors as V
from laminar.operators import attribution, identity, layout, raster, refine

BOX = "page_id long, kind string, idx long, x double, y double, w double, h double"


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def lit_box(x, y, w, h):
    return G.box(*(F.lit(float(v)) for v in (x, y, w, h)))


def test_geometry_scalars(spark):
    b = lit_box(10, 20, 30, 40)
    assert tuple(one(spark, G.center(b))) == (25, 40)
    assert tuple(one(spark, G.head_crop(b))) == pytest.approx((14.5, 20, 21, 18))
    assert one(spark, G.contains(b, G.point(F.lit(10), F.lit(60)))) and not one(spark, G.contains(b, G.point(F.lit(9.9), F.lit(30))))
    f = lambda *v: G.angle(*(F.lit(float(x)) for x in v))
    assert one(spark, f(1, 0, 0, 1)) == pytest.approx(90) and one(spark, f(0, 0, 1, 1)) == 180 and one(spark, f(1, 1, 2, 2)) == pytest.approx(0, abs=1e-5)
    assert one(spark, G.y_overlap(lit_box(0, 0, 1, 10), lit_box(0, 5, 1, 20))) == 0.5 and one(spark, G.y_overlap(b, lit_box(0, 0, 1, 0))) == 0
    assert tuple(one(spark, G.int_box(lit_box(-1.7, 2.9, 3.5, 4.2)))) == (-1, 2, 2, 6)
    assert tuple(one(spark, G.upscaled(F.lit(10), F.lit(25)))) == (28, 70) and tuple(one(spark, G.upscaled(F.lit(40), F.lit(30)))) == (40, 30)
    assert one(spark, G.decay(F.lit(15.0), F.lit(60.0))) == 0.75 and one(spark, G.decay(F.lit(90.0), F.lit(60.0))) == 0


def test_reading_order_of_rows_of_any_width(spark):
    r = random.Random(4)
    scene, ltr, rtl, top = [], [], [], 0.0
    for _ in range(9):  # rows from the top; a row's panels share its height and differ in width, so the order follows from how they are made
        height, left, row = r.choice([40.0, 90.0, 130.0]), 0.0, []
        for _ in range(r.randrange(1, 5)):
            width = r.choice([25.0, 60.0, 110.0])
            row.append(len(scene))
            scene.append((1, "panel", len(scene), left, top, width, height))
            left += width + 6
        ltr, rtl, top = ltr + row, rtl + row[::-1], top + height + 6
    scene = [(*s[:2], i, *s[3:]) for i, s in enumerate(scene)]
    df = spark.createDataFrame(r.sample(scene, len(scene)), BOX)
    for way, want in (("ltr", ltr), ("auto", ltr), ("rtl", rtl)):
        rows = layout.reading_order(df, way).orderBy("reading_order_index").collect()
        assert [x["idx"] for x in rows] == want and [x["reading_order_index"] for x in rows] == list(range(len(scene)))


def test_rows_tolerate_a_shifted_panel(spark):
    df = spark.createDataFrame([(1, "panel", 0, 0.0, 0.0, 100.0, 100.0), (1, "panel", 1, 100.0, 8.0, 100.0, 92.0), (1, "panel", 2, 0.0, 100.0, 200.0, 50.0)], BOX)
    assert [r["idx"] for r in layout.reading_order(df).orderBy("reading_order_index").collect()] == [0, 1, 2]
    with pytest.raises(ValueError, match="direction"):
        layout.row_order(F.lit(None), "up")


def test_items_meet_panels(spark):
    panels = spark.createDataFrame([(1, "panel", 0, 0.0, 0.0, 10.0, 10.0), (1, "panel", 1, 5.0, 5.0, 10.0, 10.0), (1, "panel", 2, 100.0, 0.0, 10.0, 10.0)], BOX)
    items = spark.createDataFrame([(1, "text", 0, 6.0, 6.0, 2.0, 2.0), (1, "text", 1, 60.0, 4.0, 2.0, 2.0), (1, "text", 2, 52.0, 4.0, 2.0, 2.0), (2, "text", 0, 0.0, 0.0, 1.0, 1.0)], BOX)
    got = {(r["page_id"], r["idx"]): (r["panel_idx"], r["inside"]) for r in layout.assign_to_panel(items, panels).collect()}
    assert got == {(1, 0): (0, True), (1, 1): (2, False), (1, 2): (1, False), (2, 0): (None, None)}
    assert layout.assign_to_panel(items.limit(0), panels).count() == 0


def scene(spark, tail=(50.0, 60.0), figures=((20.0, 100.0, 60.0, 100.0), (400.0, 90.0, 60.0, 100.0))):
    rows = [(1, "panel", 0, 0.0, 0.0, 500.0, 300.0), (1, "text", 0, 0.0, 0.0, 100.0, 60.0)] + [(1, "character", i, *f) for i, f in enumerate(figures)]
    tails = spark.createDataFrame([(1, 0, *(tail or (None, None)))], "page_id long, idx long, tx double, ty double").select("page_id", "idx", F.when(F.col("tx").isNotNull(), G.point(F.col("tx"), F.col("ty"))).alias("tail"))
    return spark.createDataFrame(rows, BOX), tails


def test_speaker_by_tail_and_by_distance(spark):
    r = attribution.speakers(*scene(spark)).first()
    assert (r["type"], r["character_idx"]) == ("speech", 0) and r["confidence"] > 0.9
    r = attribution.speakers(*scene(spark, None)).first()
    assert (r["type"], r["character_idx"], r["tail_idx"]) == ("narration", 0, None)
    r = attribution.speakers(*scene(spark, (50.0, 0.0)), limit=30.0).first()
    assert r["tail_idx"] is None and r["near_idx"] == 0
    r = attribution.speakers(*scene(spark, None, ())).first()
    assert r["character_idx"] is None and r["confidence"] == 0


def test_ties_by_tail_last_by_distance_first(spark):
    same = ((20.0, 100.0, 60.0, 100.0), (20.0, 100.0, 60.0, 100.0))
    r = attribution.speakers(*scene(spark, (50.0, 60.0), same)).first()
    assert r["tail_idx"] == 1 and r["near_idx"] == 0


def test_pages_without_panels_keep_their_bubbles(spark):
    b, tails = scene(spark)
    b = b.where("kind <> 'panel'")
    r = attribution.speakers(b, tails).first()
    assert r["panel_idx"] is None and r["character_idx"] == 0
    nested = attribution.bubbles_by_panel(b.where("kind = 'panel'"), attribution.speakers(b, tails), ["type"]).collect()
    assert [(n["panel_idx"], len(n["bubbles"])) for n in nested] == [(None, 1)]


def test_last_pair_of_a_text_counts(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 1)], "page_id long, ord int, text_idx long, tail_idx long")
    tails = spark.createDataFrame([(1, "tail", 0, 0.0, 0.0, 2.0, 2.0), (1, "tail", 1, 10.0, 10.0, 2.0, 2.0)], BOX)
    assert [tuple(r["tail"]) for r in attribution.tails_of(pairs, tails).collect()] == [(11.0, 11.0)]


# ---- rasters


def page(blocks, size):
    import numpy as np

    a = np.full((size, size), 255, np.uint8)
    for x, y, w, h in blocks:
        a[y : y + h, x : x + w] = 120
    return a


def one_raster(spark, a):
    return spark.createDataFrame([(1, *a.shape, a.tobytes())], "page_id int, height int, width int, gray binary")


@pytest.mark.parametrize(
    ("blocks", "n"),
    [([(20, 20, 160, 160), (220, 20, 160, 160), (20, 220, 160, 160), (220, 220, 160, 160)], 4), ([(20, 20, 360, 160), (20, 220, 160, 160), (220, 220, 160, 160)], 3), ([(20, 20, 179, 360), (201, 20, 179, 360)], 1), ([], 0)],
)
def test_xy_cut(spark, blocks, n):
    assert raster.xy_cut(one_raster(spark, page(blocks, 400))).count() == n


def test_snapping():
    blank = page([(50, 50, 200, 200)], 300) > 200
    x, y, w, h = raster.snapped(blank, (60.0, 60.0, 170.0, 170.0), reach=0.1)
    assert (x, y) == (50, 50) and abs(x + w - 250) <= 1 and abs(y + h - 250) <= 1
    assert raster.snapped(blank, (50.0, 50.0, 200.0, 200.0)) == (50, 50, 200, 200)
    assert raster.snapped(page([(0, 0, 300, 300)], 300) > 200, (50.0, 50.0, 100.0, 100.0)) == (50, 50, 100, 100)
    a = page([(0, 0, 300, 300)], 300)
    a[40:43] = 255
    assert raster.snapped(a > 200, (50.0, 50.0, 100.0, 100.0)) == (50, 50, 100, 100)


def test_an_empty_box_and_a_page_without_pixels(spark):
    import numpy as np

    blank = page([(0, 0, 60, 60)], 60) > 200
    assert raster.snapped(blank, (10.0, 10.0, 0.0, 0.0)) == (10, 10, 0, 0) and raster.snapped(blank, (70.0, 70.0, 5.0, 5.0)) == (70, 70, 5, 5)
    assert raster.xy_cut(one_raster(spark, np.zeros((0, 0), np.uint8))).count() == 0


def test_bands_and_segments(spark):
    p = spark.createDataFrame([("a", i, f) for i, f in enumerate([0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0])], "k string, i int, frac double")
    assert sorted((r["a"], r["b"]) for r in raster.bands(p, ["k"], 0.9, 2).collect()) == [(2, 4), (9, 10)]
    ends = spark.createDataFrame([("a", 0, 11, 3)], "k string, lo int, hi int, least int")
    assert sorted((r["start"], r["stop"]) for r in raster.segments(p, ["k"], ends, 0.9, 2).collect()) == [(0, 3), (3, 9)]


# ---- colour and vectors


def test_colours(spark):
    df = spark.createDataFrame([("red", 255, 20, 20), ("blue", 20, 20, 255), ("gray", 128, 128, 128), ("white", 255, 255, 255)], "img string, r int, g int, b int")
    hsv = df.select("img", color.hsv(F.col("r"), F.col("g"), F.col("b")).alias("c")).select("img", "c.*").withColumn("v", F.least("v", F.lit(200)))
    h = {r["img"]: r["hist"] for r in color.histogram(hsv, ["img"]).collect()}
    assert sum(h["red"]) == sum(h["blue"]) == 1 and sum(h["gray"]) == sum(h["white"]) == 0
    assert sum(map(min, h["red"], h["blue"])) == 0


def test_vectors(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, V.cosine(a(1, 0, 0), a(0, 0, 0))) == 0 and one(spark, V.cosine(a(1, 0, 0), a(2, 0, 0))) == 1
    assert one(spark, V.fused(a(3, 4), a(0, 2), 0.25)) == pytest.approx([0.6 * math.sqrt(0.75), 0.8 * math.sqrt(0.75), 0, 0.5])
    assert one(spark, V.fused(a(3, 4), a(0, 2), 0)) == [3, 4]
    assert one(spark, V.running_mean(a(1, 1), F.lit(1), a(3, 5))) == [2, 3]


# ---- identities


A, A2, D, B = [1.0, 0.0, 0.0], [0.9, 0.1, 0.0], [0.5, 0.5, 0.0], [0.0, 1.0, 0.0]


def run(spark, vectors, threshold, mode):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(vectors)], "comic string, seq long, v array<double>")
    return [(r["cluster"], r["is_new"], round(r["similarity"], 6)) for r in identity.assign(df, ["comic"], ["seq"], threshold, mode).orderBy("seq").collect()]


def test_identities_in_order(spark):
    got = run(spark, [A, A2, B], 0.75, "complete_linkage")
    assert [g[:2] for g in got] == [(0, True), (0, False), (1, True)] and got[0][2] == 0 and 0 <= got[2][2] < 0.2
    zero = run(spark, [[0.0, 0.0, 0.0], A], 0.5, "complete_linkage")
    assert zero == [(0, True, 0.0), (1, True, 0.0)]


def test_linkage_is_stricter_than_the_mean(spark):
    store = identity.Store()
    for v in (A, B):
        store.assign(v, -1.0, "complete_linkage")
    assert store.assign(D, 0.8, "complete_linkage")[2]
    store = identity.Store()
    for v in (A, B):
        store.assign(v, -1.0, "centroid")
    assert not store.assign(D, 0.8, "centroid")[2]


def test_stream_agrees_with_batch(spark, tmp_path):
    import numpy as np

    from laminar.streaming.identity import assign_stream

    r = np.random.default_rng(4)
    rows = [(f"c{i % 2}", i, [float(x) for x in r.normal(size=6)]) for i in range(60)]
    kind = "comic string, seq long, v array<double>"
    batch = {(x["comic"], x["seq"]): (x["cluster"], round(x["similarity"], 9)) for x in identity.assign(spark.createDataFrame(rows, kind), ["comic"], ["seq"], 0.2).collect()}
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = assign_stream(stream, "comic", "seq", 0.2).writeStream.format("memory").queryName("ids").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(x["comic"], x["seq"]): (x["cluster"], round(x["similarity"], 9)) for x in spark.table("ids").collect()}
    assert len(got) == 60 and got == batch


def members(spark, clusters):
    rows = [("c", k, p, v, f"{k}-{p}") for k, vs in enumerate(clusters) for p, v in enumerate(vs)]
    return spark.createDataFrame(rows, "comic string, cluster int, pos long, v array<double>, crop string")


def same_when(test):
    return lambda pairs: pairs.withColumn("same", test(pairs))


def sizes(out):
    return sorted(r["count"] for r in out.groupBy("cluster").count().collect())


def test_split_at_the_weakest_link(spark):
    out, log = refine.refine(members(spark, [[A, [0.95, 0.05, 0.0], B]]), same_when(lambda p: F.lit(False)))
    assert sizes(out) == [1, 2]
    assert [r["type"] for r in log.orderBy("seq").collect()][:2] == ["split_check", "split_applied"]
    out, _ = refine.refine(members(spark, [[A, A2]]), same_when(lambda p: F.lit(False)))
    assert sizes(out) == [2]


def test_merges_never_chain(spark):
    three = members(spark, [[A], [[0.95, 0.05, 0.0]], [B]])
    out, log = refine.refine(three, same_when(lambda p: F.lit(True)), merge_min=-1.0)
    assert sizes(out) == [1, 2] and refine.log_summary(log).first().asDict() == {"comic": "c", "checks": 1, "splits": 0, "merges": 1}
    out, _ = refine.refine(three, same_when(lambda p: ~(p["crop_a"].startswith("2") | p["crop_b"].startswith("2"))), merge_min=0.1)
    assert sizes(out) == [1, 2]
    out, _ = refine.refine(three, same_when(lambda p: F.lit(True)), merge_min=1.1)
    assert sizes(out) == [1, 1, 1]


def test_extreme_pairs_over_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(refine, "BLOCK", 3)
    r = np.random.default_rng(1)
    vs = [[[float(x) for x in r.normal(size=4)] for _ in range(n)] for n in (10, 7, 1)]
    m = members(spark, vs)
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = {k: min((round(cos(v[i], v[j]), 9), i, j) for i in range(len(v)) for j in range(i + 1, len(v))) for k, v in enumerate(vs) if len(v) > 1}
    assert {x["cluster"]: (round(x["sim"], 9), x["i"], x["j"]) for x in refine.weakest_pairs(m).collect()} == want
    best = {(a, b): max((round(cos(x, y), 9), -i, -j) for i, x in enumerate(vs[a]) for j, y in enumerate(vs[b])) for a in range(3) for b in range(a + 1, 3)}
    assert {(x["a"], x["b"]): (round(x["sim"], 9), -x["i"], -x["j"]) for x in refine.strongest_pairs(m).collect()} == best
    gate = sorted(v[0] for v in best.values())[1]
    assert {(x["a"], x["b"]) for x in refine.strongest_pairs(m, gate - 1e-6).collect()} == {k for k, v in best.items() if v[0] >= gate}
    gate = sorted(v[0] for v in want.values())[0]
    assert {x["cluster"] for x in refine.weakest_pairs(m, gate + 1e-6).collect()} == {k for k, v in want.items() if v[0] <= gate}


def test_equal_vectors_in_many_blocks_give_the_first_pair(spark, monkeypatch):
    monkeypatch.setattr(refine, "BLOCK", 4)
    m = members(spark, [[A] * 30, [A] * 30, [B]])
    assert {(x["cluster"], x["i"], x["j"]) for x in refine.weakest_pairs(m).collect()} == {(0, 0, 1), (1, 0, 1)}
    assert {(x["a"], x["b"], x["i"], x["j"]) for x in refine.strongest_pairs(m, 0.9).collect()} == {(0, 1, 0, 0)}
    assert refine.strongest_pairs(m.limit(0)).count() == refine.weakest_pairs(m.limit(0)).count() == 0


def test_best_match_in_blocks(spark):
    import numpy as np

    r = np.random.default_rng(2)
    vs, cs = r.normal(size=(90, 5)), r.normal(size=(23, 5))
    cs[7] = cs[3]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = (unit(vs) @ unit(cs).T).round(12)
    rows = [("x", i, v.tolist()) for i, v in enumerate(vs)] + [("x", 0, vs[0].tolist()), ("none", 5, vs[0].tolist()), ("x", 100, [0.0] * 5)]
    targets = spark.createDataFrame([("x", k, c.tolist()) for k, c in enumerate(cs)], "g string, cluster int, centroid array<double>")
    d = spark.createDataFrame(rows, "g string, id int, v array<double>").repartition(3)
    for block in (4, 2_000):
        got = {(x["g"], x["id"]): (x["best"], round(x["similarity"], 9)) for x in identity.best_match(d, targets, ["g"], block=block).collect()}
        want = {("x", i): (int(s[i].argmax()), round(float(s[i].max()), 9)) for i in range(90)} | {("none", 5): (None, 0.0), ("x", 100): (0, 0.0)}
        assert got == want
    assert identity.best_match(d.limit(0), targets, ["g"]).count() == 0


# ---- text


@pytest.mark.parametrize(
    ("first", "second", "want"),
    [("Helo wrld", "Hello world", "Hello world"), ("", "HI", "HI"), ("same", "four", "same"), ("HELLO THERE", "#$%^ 1234567890123456", "HELLO THERE"), (None, "x", "x"), ("a", None, "a")],
)
def test_reading_with_more_letters_wins(spark, first, second, want):
    r = one(spark, X.chosen_reading(F.lit(first).cast("string"), F.lit(second).cast("string"), F.lit(0.4)))
    assert r["text"] == want and r["confidence"] == (0.4 if want == second else 0.85)


GOOD = '{"action_description": " a ", "setting": "s", "mood": "m", "onomatopoeia": ["POW", " ", "bam "]}'


@pytest.mark.parametrize(
    ("raw", "status", "sounds"),
    [
        (GOOD, "ok", ["POW", "bam"]), (f"Sure!\n```json\n{GOOD}\n```", "ok", ["POW", "bam"]), ('{"action_description": "a", "setting": "s", "mood": "m"}', "ok", []),
        ('{"action_description": "a", "setting": "s", "mood": "m", "onomatopoeia": "POW"}', "ok", []), ("nothing", "no_object", None), ('{"action_description": }', "malformed", None), ('{"mood": "m"}', "missing_field", None),
    ],
)
def test_answers(spark, raw, status, sounds):
    r = one(spark, X.answer(F.lit(raw)))
    assert r["status"] == status and r["onomatopoeia"] == sounds
    if status == "ok":
        assert r["action_description"] == "a" and r["mood"] == "m"


def test_verdicts(spark):
    for raw, want in (('{"same_character": true}', True), ('x {"same_character": false} y', False), ('{"same_character": "false"}', True), ('{"same_character": ""}', False), ('{"same_character": 0}', False), ("{}", None), ("none", None)):
        assert one(spark, X.verdict(F.lit(raw))) == want, raw


def test_small_text_functions(spark):
    assert one(spark, X.strip(F.lit("  a b \n"))) == "a b"
    assert one(spark, X.numbered_id(F.lit("page_04"), "p", F.lit(7))) == "page_04_p007" and one(spark, X.numbered_id(F.lit("p"), "b", F.lit(1234))) == "p_b1234"
    words, conf = F.array(*map(F.lit, ["a", " ", "b", "c"])), F.array(*[F.lit(float(x)) for x in (90, 10, -1, 50)])
    assert one(spark, X.joined_words(words)) == "a b c" and one(spark, X.word_confidence(words, conf)) == pytest.approx(0.7)
    assert one(spark, X.content_hash(F.lit(b"abc"), {"b": 1, "a": [2]})) == X.content_hash_of(b"abc", {"a": [2], "b": 1})
    assert X.content_hash_of(b"abc", {}) == X.content_hash_of(b"abc")
