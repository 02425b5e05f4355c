"""What a step moves and writes, read off its plan or its files."""

import glob

from pyspark.sql import functions as F

from ratewright.functions.ranking import numbered_in_group
from ratewright.session import land, shared_dir
from ratewright.sources import files, records


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_without_a_large_group_move_the_rows_once(spark):
    rows = [(1, "a", 3), (1, "a", 5), (1, None, 5), (1, None, 7), (2, "a", None), (2, "a", 1)]
    df = spark.createDataFrame(rows, "unit int, period string, filed int")
    found = numbered_in_group(df, ["unit", "period"], [F.col("filed")], "place")
    assert plan(found).count("Exchange") == 1 and "Generate" not in plan(found)
    assert {(r["unit"], r["period"], r["filed"], r["place"]) for r in found.collect()} == {
        (1, "a", 5, 1), (1, "a", 3, 2), (1, None, 7, 1), (1, None, 5, 2), (2, "a", 1, 1), (2, "a", None, 2),
    }


def test_landed_tables_are_zstd(spark):
    land(spark.range(10).toDF("id"), "zstd-probe")
    found = glob.glob(f"{shared_dir(spark).removeprefix('file:')}/ratewright/zstd-probe-*/*.parquet")
    assert found and all(name.endswith(".zstd.parquet") for name in found)


def test_records_of_one_line_are_neither_sorted_nor_moved(spark, tmp_path):
    path = str(tmp_path / "plain.csv")
    spark.range(1000).select(F.concat_ws(",", "id", F.lit("x"), F.lit(""))).coalesce(2).write.text(path)
    found = records.records(spark, path)
    assert "SortMergeJoin" not in plan(found) and "even_upto" not in plan(found)
    assert found.groupBy("n_fields", "n_lines", "empty_last").count().collect()[0]["count"] == 998


def test_running_counts_cross_batches_blocks_and_files(spark, tmp_path):
    """Records of two lines, cut by small batches and blocks, in two files."""
    for name in ("one", "two"):
        with open(tmp_path / f"{name}.csv", "w") as f:
            f.write("h1,h2\n" + "".join(f'{i},"left\n\nright, {i}"\n{i},\n\n' for i in range(300)))
    settings = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = records.records(spark, str(tmp_path / "*.csv")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(found) == 1200
    by_file = {}
    for r in found:
        by_file.setdefault(r["file"], []).append(r)
    for rows in by_file.values():
        rows.sort(key=lambda r: r["record"])
        assert [r["first_line"] for r in rows] == [at for i in range(300) for at in (2 + 5 * i, 5 + 5 * i)]
        assert {(r["n_lines"], r["n_fields"], r["empty_last"]) for r in rows} == {(3, 2, False), (1, 2, True)}


def test_compressed_export_reads_back(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "cast(id % 3 as string) grp")
    files.write_export(df, str(tmp_path / "out"), ["grp"], ["id"], compression="gzip")
    assert glob.glob(str(tmp_path / "out/*.csv.gz"))
    assert sorted(files.read_csv(spark, str(tmp_path / "out"), df.schema).collect()) == sorted(df.collect())
