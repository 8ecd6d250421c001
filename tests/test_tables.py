from pyspark.sql.types import StructType

from codeassay.sources import tables


def test_tables_keep_their_schema(spark, tmp_path):
    rows = spark.createDataFrame([(7, "x", 3, "no column of it")], "Project_ID int, name string, scan_schedule int, other string")
    for fmt in ("parquet", "json", "orc"):
        tables.write_table(rows, str(tmp_path / fmt), "projects", fmt)
        tables.write_table(rows.limit(0), str(tmp_path / fmt), "projects", fmt)
        back = tables.read_table(spark, str(tmp_path / fmt), "projects", fmt)
        assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in StructType.fromDDL(tables.SCHEMAS["projects"])]
        assert [tuple(r) for r in back.collect()] == [(7, None, "x", None, "3", None, None)]
