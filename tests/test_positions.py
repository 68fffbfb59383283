import duckdb
import pytest
from pyspark.sql import functions as F

from assayloom.operators import positions
from assayloom.operators.positions import UnequalLengths, joined_by_position, read_side_by_side, read_with_positions


def written(df, path, files):
    df.repartitionByRange(files, "id").sortWithinPartitions("id").write.parquet(path)
    return path


@pytest.mark.parametrize("most", [positions.BROADCAST_FILES, 0])
def test_positions_follow_files_and_rows(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(positions, "BROADCAST_FILES", most)
    rows = spark.range(5000).withColumn("position_", F.lit("x"))
    path = written(rows, f"{tmp_path}/many", 7)
    found = read_with_positions(spark, path, ["id"]).collect()
    assert sorted((r["position"], r["id"]) for r in found) == [(i, i) for i in range(5000)]
    assert read_with_positions(spark, written(rows.limit(0), f"{tmp_path}/none", 2)).count() == 0


def test_row_groups_read_by_several_tasks_keep_their_places(spark, tmp_path):
    path = f"{tmp_path}/one"
    one = spark.range(200_000).select((F.col("id") * 7 % 200_003).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
    one.coalesce(1).write.option("parquet.block.size", 1 << 20).parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    found = read_with_positions(spark, path)
    assert found.rdd.getNumPartitions() > 3
    got = sorted((r["position"], r["v"]) for r in found.select("position", "v").collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    sql = f"SELECT file_row_number, v FROM read_parquet('{path}/*.parquet', file_row_number=true) ORDER BY 1"
    assert got == duckdb.connect().execute(sql).fetchall()


def test_names_that_grow_longer_come_later(spark):
    names = [f"file:/x/b/part-{n}-u.parquet" for n in (99999, 100000, 2)] + ["file:/x/a/part-5.parquet"]
    rows = spark.createDataFrame([(n,) for n in names for _ in range(3)], "_file string")
    order = [r["_file"] for r in positions.file_offsets(rows).orderBy("before").collect()]
    assert order == [names[3], names[2], names[0], names[1]]


def test_tables_of_other_lengths_are_refused(spark, tmp_path):
    left = written(spark.range(100), f"{tmp_path}/l", 3)
    right = written(spark.range(100).select("id", (F.col("id") * 2).alias("twice")), f"{tmp_path}/r", 4)
    short = written(spark.range(99).withColumn("twice", F.lit(1)), f"{tmp_path}/s", 4)
    one, two = read_with_positions(spark, left), read_with_positions(spark, right, ["twice"])
    assert joined_by_position(one, two).where("twice <> 2 * id OR position <> id").count() == 0
    with pytest.raises(UnequalLengths):
        joined_by_position(one, read_with_positions(spark, short, ["twice"]))
    with pytest.raises(ValueError, match="both tables"):
        read_side_by_side(spark, left, right)
    holes = two.withColumn("position", F.col("position") + 1)
    with pytest.raises(UnequalLengths):
        joined_by_position(one, holes)
