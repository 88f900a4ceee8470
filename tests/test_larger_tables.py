"""Cases that larger or odd tables bring: pages without panels, and work that must be dealt to many tasks."""

import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from laminar.operators import attribution, pages, refine
from laminar.plans import catalogue

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def with_lines(spark, folder, lines):
    """A folder with a `lineitem` of (order, line number, part); the other columns are the same everywhere."""
    rows = [(o, p, 3, n, 5.0, 1.0, 0.0, 0.0, "N", "O", datetime.datetime(2020, 1, 1)) for o, n, p in lines]
    spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def by_sql(name, folder, table):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        return sorted(c.execute(catalogue.ORACLE_SQL[name]).fetchall())


def by_spark(name, spark, folder):
    return sorted(tuple(r) for r in catalogue.QUERIES[name](spark, folder).collect())


def test_bubbles_of_a_page_without_panels_are_in_no_panel(spark, tmp_path):
    # page 0: a panel and two texts; page 1: texts only; page 2: a panel only
    folder = with_lines(spark, tmp_path, [(1, 3, 5), (2, 1, 6), (3, 1, 7), (11, 1, 8), (12, 4, 9), (25, 6, 2)])
    assert by_spark("bubbles_per_panel", spark, folder) == by_sql("bubbles_per_panel", folder, "lineitem") == [(0, 0, 2), (2, 0, 0)]


def figures(spark, n, clusters, seed=1, comics=1, decimals=6):
    r = np.random.default_rng(seed)
    rows, seen = [], {}
    for _ in range(n):
        key = (int(r.integers(comics)), int(r.integers(clusters)))
        seen[key] = seen.get(key, -1) + 1
        rows.append((*key, seen[key], r.normal(size=8).round(decimals).tolist()))
    return rows, spark.createDataFrame(rows, "comic int, cluster int, pos long, v array<double>").repartition(4)


def test_meetings_of_one_comic_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(refine, "BLOCK", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        met = refine._meetings(refine._members(figures(spark, 400, 2)[1]), ["comic"], False, None)
        assert met.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("clusters", "decimals", "known"), [(3, 6, 1 << 20), (3, 0, 1 << 20), (40, 6, 1 << 20), (40, 0, 0)])
def test_extreme_pairs_over_tiles_and_comics(spark, monkeypatch, clusters, decimals, known):
    monkeypatch.setattr(refine, "BLOCK", 20)
    monkeypatch.setattr(refine, "TILE", 16)
    monkeypatch.setattr(refine, "KNOWN", known)
    rows, df = figures(spark, 240, clusters, comics=2, decimals=decimals)
    units = [np.array(x[3]) / (np.linalg.norm(x[3]) or 1.0) for x in rows]
    strong, weak = {}, {}
    for x, (c, k, i, _) in enumerate(rows):
        for y, (d, m, j, _) in enumerate(rows):
            if c == d and (k, i) < (m, j):
                sim = round(float(units[x] @ units[y]), 12)
                if k == m:
                    weak[c, k] = min(weak.get((c, k), (9,)), (sim, i, j))
                else:
                    strong[c, k, m] = min(strong.get((c, k, m), (9,)), (-sim, i, j))
    assert {(r["comic"], r["cluster"]): (round(r["sim"], 9), r["i"], r["j"]) for r in refine.weakest_pairs(df).collect()} == {k: (round(s, 9), i, j) for k, (s, i, j) in weak.items()}
    for gate in (None, 0.5):
        want = {k: (round(-s, 9), i, j) for k, (s, i, j) in strong.items() if gate is None or -s >= gate}
        assert {(r["comic"], r["a"], r["b"]): (round(r["sim"], 9), r["i"], r["j"]) for r in refine.strongest_pairs(df, gate).collect()} == want


@pytest.mark.parametrize("name", ["xy_cut", "snap_boxes"])
def test_pages_of_one_file_are_dealt_to_many_tasks(spark, tmp_path, name):
    spark.range(100).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert catalogue.QUERIES[name](spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() == tasks
    assert by_spark(name, spark, str(tmp_path)) == by_sql(name, str(tmp_path), "part")


@pytest.mark.parametrize("name", ["speaker_attribution", "nearest_attribution", "tail_angle_attribution", "bubble_type_counts"])
def test_speakers_read_and_order_the_boxes_once(spark, tmp_path, name):
    # page 0: panels, texts and figures; page 1: no panels; page 2: texts only; page 3: no texts
    lines = [(o, n, 7 * o + 31 * n) for o in range(6) for n in range(1, 8)] + [(11, n, 5 * n) for n in (1, 2, 4, 5)] + [(25, 1, 6), (26, 4, 8), (31, 2, 3), (31, 3, 3)]
    folder = with_lines(spark, tmp_path, lines)
    df = catalogue.QUERIES[name](spark, folder)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    assert by_spark(name, spark, folder) == by_sql(name, folder, "lineitem")


@pytest.mark.parametrize("name", ["speaker_attribution", "nearest_attribution", "tail_angle_attribution"])
def test_speakers_place_boxes_without_a_call_for_each_pair(spark, tmp_path, name):
    folder = with_lines(spark, tmp_path, [(o, n, 7 * o + 31 * n) for o in range(40) for n in range(1, 8)])
    plan = catalogue.QUERIES[name](spark, folder)._jdf.queryExecution()
    # boxes are dealt and sorted once, with no column that boxes are not made of; panels and nearest figures are found in arrays, not by lambdas over pairs
    assert plan.executedPlan().toString().count("Exchange ") == 1 and plan.executedPlan().toString().count("Sort [") == 1
    assert "l_extendedprice" not in plan.executedPlan().toString() and "MapInArrow" in plan.optimizedPlan().toString()
    assert ("lambda" in plan.optimizedPlan().toString()) == (name != "nearest_attribution")
    assert by_spark(name, spark, folder) == by_sql(name, folder, "lineitem")


@pytest.mark.parametrize(("rows", "pairs", "listed"), [(10_000, 1 << 14, 1 << 20), (3, 1, 1), (7, 5, 4)])
def test_pages_and_pairs_are_cut_anywhere(spark, tmp_path, monkeypatch, rows, pairs, listed):
    # pages of a hundred boxes and of one, pages without panels or figures, equal boxes
    lines = [(o, n, (7 * o + 31 * n) % 40) for o in range(30) for n in range(1, 8)] + [(45, 1, 3), (51, 1, 5), (52, 2, 5), (53, 2, 5), (61, 3, 2), (62, 4, 2), (71, 2, 1), (72, 3, 1)]
    folder = with_lines(spark, tmp_path, lines)
    real = pages.near_texts

    def cut(names):
        def run(batches):
            pages.PAIRS, pages.LISTED = pairs, listed
            yield from real(names)(batches)

        return run

    monkeypatch.setattr(attribution.pages, "near_texts", cut)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        for name in ("speaker_attribution", "nearest_attribution", "tail_angle_attribution"):
            assert by_spark(name, spark, folder) == by_sql(name, folder, "lineitem")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nearest_with_nulls_and_nan_as_in_sql(spark, tmp_path):
    nan, rows, r = float("nan"), [], np.random.default_rng(3)
    for o in range(400):
        for n in range(1, 8):
            part, size = (None if r.random() < 0.15 else int(r.integers(40))), [None, nan, float("inf"), -400.0, 5.0, 9.0, 30.0][int(r.integers(7))]
            rows.append((o, part, None if r.random() < 0.1 else int(r.integers(9)), n, size, 1.0, 0.0, 0.0, "N", "O", datetime.datetime(2020, 1, 1)))
    spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    same = lambda found: sorted([str(v) for v in r] for r in found)
    assert same(by_spark_rows("nearest_attribution", spark, tmp_path)) == same(by_sql_rows("nearest_attribution", tmp_path))


def by_spark_rows(name, spark, folder):
    return [tuple(r) for r in catalogue.QUERIES[name](spark, str(folder)).collect()]


def by_sql_rows(name, folder):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
        return c.execute(catalogue.ORACLE_SQL[name]).fetchall()
