import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.sources.npy import chosen_columns, read_npy, write_npy


@pytest.mark.parametrize("kind", ["<f4", "<f8", ">f8", "|i1", "<i2", "<i4", "<i8", "|b1"])
def test_files_of_numpy_are_read_by_many_tasks(spark, tmp_path, kind):
    matrix = (np.arange(3000).reshape(500, 6) % 120).astype(kind)
    np.save(f"{tmp_path}/m.npy", matrix)
    np.save(f"{tmp_path}/v.npy", matrix[:, 1])
    found = read_npy(spark, f"{tmp_path}/m.npy", task_bytes=1000)
    assert found.rdd.getNumPartitions() > 2
    rows = sorted(found.collect())
    assert [r["row"] for r in rows] == list(range(500)) and [r["values"] for r in rows] == matrix.tolist()
    assert [r["value"] for r in sorted(read_npy(spark, f"{tmp_path}/v.npy").collect())] == matrix[:, 1].tolist()
    picked = sorted(read_npy(spark, f"{tmp_path}/m.npy", columns="5,0:2", task_bytes=999).collect())
    assert [r["values"] for r in picked] == matrix[:, [5, 0, 1]].tolist()


@pytest.mark.parametrize("kind,cast", [("float", "f4"), ("double", "f8"), ("bigint", "i8"), ("boolean", "b1"), ("tinyint", "i1")])
def test_numpy_reads_what_is_written(spark, tmp_path, kind, cast):
    rows = spark.range(1000).repartition(5).select(
        "id", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((F.col("id") + i) % 2).cast(kind)).alias("m"), (F.col("id") % 2).cast(kind).alias("v")
    )
    wanted = (np.arange(1000)[:, None] + np.arange(5)) % 2
    for _ in range(2):
        write_npy(rows, f"{tmp_path}/m", "m", ["id"], parts=4)
        write_npy(rows, f"{tmp_path}/v", "v", ["id"], parts=3)
    files = sorted(glob.glob(f"{tmp_path}/m/*"))
    assert len(files) == 4 and all(f.endswith(".npy") for f in files)
    parts = [np.load(f) for f in files]
    assert {p.dtype.str[1:] for p in parts} == {cast}
    assert (np.concatenate(parts) == wanted.astype(cast)).all()
    assert (np.concatenate([np.load(f) for f in sorted(glob.glob(f"{tmp_path}/v/*"))]) == (np.arange(1000) % 2).astype(cast)).all()
    back = sorted(read_npy(spark, f"{tmp_path}/m", task_bytes=100).collect())
    assert [r["row"] for r in back] == list(range(1000)) and [r["values"] for r in back] == wanted.astype(cast).tolist()


def test_empty_and_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 3.0), (2, [1.0], None)], "id int, m array<double>, v double")
    write_npy(rows.limit(0), f"{tmp_path}/none", "m", ["id"])
    assert read_npy(spark, f"{tmp_path}/none").count() == 0
    write_npy(rows.limit(0), f"{tmp_path}/nothing", "v", ["id"])
    assert read_npy(spark, f"{tmp_path}/nothing").dtypes == [("row", "bigint"), ("value", "double")]
    for column in ("m", "v"):
        with pytest.raises(Exception, match="different lengths|null row"):
            write_npy(rows, f"{tmp_path}/{column}", column, ["id"])
    assert not glob.glob(f"{tmp_path}/m/**/*.npy", recursive=True)
    with pytest.raises(Exception, match="could not find"):
        read_npy(spark, f"{tmp_path}/missing").count()
    np.save(f"{tmp_path}/f.npy", np.asfortranarray(np.ones((3, 2))))
    with pytest.raises(Exception, match="by columns"):
        read_npy(spark, f"{tmp_path}/f.npy").count()
    np.save(f"{tmp_path}/t.npy", np.ones((3, 2, 2)))
    with pytest.raises(Exception, match="axes"):
        read_npy(spark, f"{tmp_path}/t.npy").count()
    assert chosen_columns(None, 3) is None and chosen_columns("1,:2", 3) == [1, 0, 1]
    with pytest.raises(ValueError):
        chosen_columns("3", 3)
