"""Readers, record structure, catalogue checks, and the run from CSV to published tables."""

import csv
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from rows import EDGES, edge_frame

from ratewright.plans.publish import establishment_study, load_raw, loaded, publish, submitted_once
from ratewright.plans.study import EXPORT_COLUMNS
from ratewright.sources import catalog, contract, files, records


@pytest.fixture(scope="module")
def nasty(tmp_path_factory):
    """A CSV with quotes, commas and line breaks inside fields, records of wrong width, and
    several scan blocks."""
    dice = random.Random(2)
    words = ["plain", "a,b", 'say "hi"', "two\nlines", 'q"\n,"', "", "x" * 300]
    rows = []
    for i in range(3000):
        width = 4 if i % 500 else 6
        rows.append([str(i) if i % 700 else ""] + [dice.choice(words) for _ in range(width - 2)] + [str(i * 2) if i % 11 else ""])
    path = tmp_path_factory.mktemp("csv") / "nasty.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["id", "a", "b", "c"])
        out.writerows(rows)
    return str(path), rows


def test_records_agree_with_a_sequential_reader(spark, nasty):
    path, rows = nasty
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = records.records(spark, path).orderBy("record").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert len(found) == len(rows)
    line = 2
    for got, row in zip(found, rows):
        n_lines = 1 + sum(v.count("\n") for v in row)
        assert got["n_fields"] == len(row), row
        assert (got["first_line"], got["n_lines"]) == (line, n_lines)
        assert (got["empty_first"], got["empty_last"]) == (row[0] == "", row[-1] == "")
        line += n_lines


def test_structure_and_suspects(spark, nasty):
    path, rows = nasty
    found = records.records(spark, path)
    table = {r["n_fields"]: r for r in records.record_structure(found).collect()}
    assert {k: r["n_records"] for k, r in table.items()} == {4: 2994, 6: 6}
    wanted = sum(r[0] == "" or r[-1] == "" for r in rows)
    assert records.suspect_records(found).count() == wanted
    assert sum(r["n_suspect"] for r in table.values()) == wanted


def test_bare_lines_and_quoted_empties(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n"",1\n\n2,""\n"3",","\n')
    found = records.records(spark, str(tmp_path / "x.csv")).orderBy("record").collect()
    assert [(r["n_fields"], r["empty_first"], r["empty_last"]) for r in found] == [
        (2, True, False), (2, False, True), (2, False, False),
    ]


@pytest.fixture(scope="module")
def raw_csv(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "raw")
    files.write_csv(edge_frame(spark).coalesce(1), path)
    return path


def test_load_is_faithful(spark, raw_csv):
    loaded = load_raw(spark, raw_csv)
    assert loaded.schema == contract.RAW_SCHEMA
    assert loaded.exceptAll(edge_frame(spark)).count() == 0 and loaded.count() == len(EDGES)
    assert loaded.filter("total_other_illnesses = '06854'").count() == 1
    counted = records.records(spark, raw_csv).agg(F.count(F.lit(1)).alias("n"))
    assert catalog.load_check(loaded, counted).collect()[0]["matches"]


def test_bad_value_raises(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("sector_code,n\n11,1\n12,many\n")
    schema = T.StructType([T.StructField("sector_code", T.StringType()), T.StructField("n", T.LongType())])
    with pytest.raises(Exception, match="many"):
        files.read_csv(spark, str(tmp_path / "bad.csv"), schema).collect()


def test_inference_reads_the_whole_file(spark, tmp_path):
    (tmp_path / "late.csv").write_text("a,b\n" + "1,2\n" * 5000 + "1,late\n")
    got = dict(files.infer_csv(spark, str(tmp_path / "late.csv")).dtypes)
    assert got == {"a": "int", "b": "string"}


def test_schema_check(spark):
    df = spark.createDataFrame([(1, "x", None)], "b long, a string, extra string")
    wanted = T.StructType(
        [T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("gone", T.LongType())]
    )
    got = {r["column_name"]: (r["verdict"], r["n_values"]) for r in catalog.schema_check(df, wanted).collect()}
    assert got == {"a": ("moved", 1), "b": ("retyped", 1), "gone": ("missing", None), "extra": ("extra", 0)}
    assert [r["column_name"] for r in catalog.describe(df).orderBy("ordinal").collect()] == ["b", "a", "extra"]


def test_sample_is_the_same_every_time(spark):
    df = spark.range(500).withColumn("x", F.col("id") % 7)
    first = files.inspection_sample(df, ["id"], 10).collect()
    again = files.inspection_sample(df.repartition(9), ["id"], 10).collect()
    assert first == again and len(first) == 10
    assert first != files.inspection_sample(df, ["id"], 10, seed=7).collect()


def test_export_splits_a_large_combination(spark, tmp_path):
    df = spark.range(20_000).select(F.lit("same").alias("sector"), F.col("id").cast("string").alias("unit"))
    path = str(tmp_path / "export")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # 20,000 rows are few
    try:
        files.write_export(df, path, ["sector"], ["unit"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [p for p in (tmp_path / "export").glob("part-*.csv")]
    assert len(parts) > 1
    assert spark.read.option("header", True).csv(path).count() == 20_000


def test_publish(spark, raw_csv, tmp_path):
    written = publish(spark, raw_csv, str(tmp_path / "out"))
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(written[name])
    falls = read("drop_waterfall").collect()
    assert [r["step"] for r in falls] == [1, 2, 3, 4, 5, 6, 7, 8, 99]
    assert sum(r["rows_dropped"] for r in falls) == len(EDGES)
    kept = sum(step is None for _, step in EDGES.values())
    export = read("clean_export")
    assert export.columns == EXPORT_COLUMNS and export.count() == kept
    assert read("overall").collect()[0]["n_establishments"] == kept
    assert read("pivot_source").agg(F.sum("n_establishments")).collect()[0][0] == kept
    assert read("sector_by_rate").columns == [
        "sector", "n_establishments", "employees", "total_hours", "total_cases", "deaths", "trir", "dart",
        "rank_by_rate", "rank_by_count", "note",
    ]
    assert read("model_stats").count() == 9 and read("audit").count() == 12


@pytest.mark.parametrize(
    "wanted, message",
    [({"expected_rows": len(EDGES) + 1}, "rows loaded"), ({"expect_single_submissions": True}, "older submissions")],
)
def test_publish_stops(spark, raw_csv, tmp_path, wanted, message):
    with pytest.raises(Exception, match=f"does not reconcile: {message}"):
        publish(spark, raw_csv, str(tmp_path / "out"), **wanted)
    assert not (tmp_path / "out" / "tables").exists()


def test_publish_gates_let_a_whole_file_pass(spark, raw_csv):
    raw = load_raw(spark, raw_csv)
    assert loaded(raw, len(EDGES)).collect()[0]["matches"]
    staged = establishment_study(spark).stage(raw)
    assert submitted_once(staged.where("submission_rank = 1")).collect()[0]["matches"]


def test_moved_column_stops_the_load(spark, raw_csv, tmp_path):
    raw = spark.read.option("header", True).csv(raw_csv)
    moved = raw.select(*raw.columns[1:], raw.columns[0])
    files.write_csv(moved, str(tmp_path / "moved"))
    with pytest.raises(Exception, match="(?i)header does not conform"):
        load_raw(spark, str(tmp_path / "moved")).collect()


def test_torn_pairs(spark, tmp_path):
    lines = ["a,b,c,d", "1,2,3,4", "1,2", "3,4", "1,2,3,4", "1,2,x", "y,4", '"1', '1",2', "3,4", "1,2,3,4", "9,9,9",
             "1,2,3,4", "1,2", "3,4", "5,6", "7,8"]
    (tmp_path / "torn.csv").write_text("\n".join(lines) + "\n")
    found = records.torn_pairs(records.records(spark, str(tmp_path / "torn.csv")), 4)
    got = sorted((r["left_line"], r["right_line"], r["left_fields"], r["right_fields"], r["sure"]) for r in found.collect())
    assert got == [
        (3, 4, 2, 2, True),
        (6, 7, 3, 2, False),  # cut inside a field; its second half also fits the record after
        (7, 8, 2, 2, False),
        (8, 10, 2, 2, False),  # the left half is of two lines
        (14, 15, 2, 2, False),
        (15, 16, 2, 2, False),
        (16, 17, 2, 2, False),
    ]
