import pytest
from pyspark.sql import functions as F

from burdenflow.sources import tables


def test_csv_keeps_missing_values(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1.5D, true), (NULL, NULL, NULL), ('NAB', 0.1D, false) AS t(s, x, b)")
    path = tables.write_table(df, tables.new_path(spark, "t"), "csv")
    back = tables.read_table(spark, path, "s STRING, x DOUBLE, b BOOLEAN", "csv")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError):
        tables.read_table(spark, path, fmt="csv")


def test_parts_carry_their_name(spark, tmp_path):
    for name, rows in {"Site A 2006-07": "3m-11m,10\n1y,NA\n", "Site B 2007-08": "2y,5\n"}.items():
        (tmp_path / f"{name}.csv").write_text("age,pyor\n" + rows)
    got = tables.read_parts(spark, f"{tmp_path}/*.csv", "age STRING, pyor DOUBLE")
    assert sorted(map(tuple, got.select("file_id", "age", "pyor").collect()), key=str) == sorted(
        [("Site A 2006-07", "3m-11m", 10.0), ("Site A 2006-07", "1y", None), ("Site B 2007-08", "2y", 5.0)], key=str
    )


def test_one_model_is_read_from_its_folder(spark):
    df = spark.range(10).withColumn("model", F.concat(F.lit("m"), F.col("id") % 3))
    path = tables.write_table(df, tables.new_path(spark, "draws"), partition_by=["model"])
    one = tables.read_table(spark, path, "id BIGINT, model STRING").where("model = 'm1'")
    assert one.count() == 3
    assert "PartitionFilters: [isnotnull(model" in one._jdf.queryExecution().executedPlan().toString()


def test_shared_folder_is_the_configured_one(spark):
    assert tables.new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_nothing_is_overwritten(spark):
    path = tables.write_table(spark.range(1), tables.new_path(spark, "x"))
    with pytest.raises(Exception, match="already exists"):
        tables.write_table(spark.range(1), path)


def test_sheets_are_read_by_header(spark, tmp_path):
    from burdenflow.sources import schemas

    headers = list(reversed(schemas.LOCATION_HEADERS)) + ["Remarks"]
    cells = {"Site": "Junju (Kilifi B)", "Dates": "2006-07", "Number examined": "120", "HbAS": "n/a", "IRS": "[N]", "Remarks": "x"}
    path = tmp_path / "locations.csv"
    path.write_text(",".join(headers) + "\n" + ",".join(cells.get(h, "NA") for h in headers) + "\n")
    df = tables.read_sheet(spark, str(path), schemas.LOCATION_HEADERS, schemas.LOCATIONS_RAW)
    row = df.first()
    assert (row.site, row.period, row.n_examined, row.hbas, row.irs, row.country) == (
        "Junju (Kilifi B)", "2006-07", 120, None, "[N]", None,
    )
    assert dict(df.dtypes)["n_examined"] == "bigint" and len(df.columns) == 17
    assert list(schemas.ADMISSION_HEADERS.values()) == [p.split()[0] for p in schemas.ADMISSIONS_RAW.split(",")]


def test_one_partition_is_replaced(spark):
    path = tables.new_path(spark, "replaced")
    tables.write_table(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "m string, x int"), path, partition_by=["m"])
    tables.replace_partitions(spark.createDataFrame([("a", 9), ("c", 4)], "m string, x int"), path, ["m"])
    assert sorted(tuple(r) for r in tables.read_table(spark, path).select("m", "x").collect()) == [("a", 9), ("b", 3), ("c", 4)]


def test_compressed_csv_reads_back_like_plain(spark):
    df = spark.sql("SELECT * FROM VALUES ('a\"b,c', 1.5D, true), (NULL, NULL, NULL), ('NAB', 0.1D, false) AS t(s, x, b)")
    back = []
    for compression in (None, "gzip"):
        path = tables.write_table(df, tables.new_path(spark, "t"), "csv", compression=compression)
        read = tables.read_table(spark, path, "s STRING, x DOUBLE, b BOOLEAN", "csv")
        assert all(name.endswith(".csv.gz" if compression else ".csv") for name in read.inputFiles())
        back.append(sorted(map(str, read.collect())))
    assert back[0] == back[1] == sorted(map(str, df.collect()))
