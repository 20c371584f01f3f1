from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.plans.gold import GOLD
from ledgerloom.plans.build import build
from ledgerloom.sources.lake import Lake
from ledgerloom.sources.warehouse import Warehouse, read_json_lines, write_json_lines
from tests.conftest import SMALL


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_refresh_keeps_schema_and_append_fills(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    table = f"t_{uuid.uuid4().hex[:8]}"
    w.replace("ledgerloom_test", table, spark.createDataFrame([(1, "a")], "id int, name string"))
    spark.sql(f"ALTER TABLE ledgerloom_test.{table} ALTER COLUMN name COMMENT 'kept'")
    w.refresh("ledgerloom_test", table, spark.createDataFrame([("b", 2)], "name string, id int"))
    assert rows(w.append("ledgerloom_test", table, spark.createDataFrame([(3,)], "id int"))) == [(2, "b"), (3, None)]
    comment = spark.sql(f"DESCRIBE ledgerloom_test.{table}").where("col_name = 'name'").first().comment
    assert comment == "kept"
    w.view("named", w.read("ledgerloom_test", table))
    assert spark.table("named").count() == 2
    spark.sql(f"DROP TABLE ledgerloom_test.{table}")
    spark.sql("DROP DATABASE ledgerloom_test")


def test_build_gives_the_lazy_results(spark, lake, tmp_path):
    names = ("account_summary", "branch_performance")
    stored = Lake(spark, SMALL)
    warehouse = Warehouse(spark, str(tmp_path))
    written = build(stored, warehouse, names)
    try:
        assert "silver.transactions" in written and "gold.account_summary" in written
        for name in names:
            assert rows(stored.gold(name)) == rows(GOLD[name](lake))
        recent = warehouse.read("silver", "transactions").where(F.col("event_month") >= "2001-06-01")
        assert len(recent.inputFiles()) > 0
    finally:
        for table in written:
            spark.sql(f"DROP TABLE {table}")
        for layer in ("silver", "gold"):
            spark.sql(f"DROP DATABASE {layer}")


def test_json_lines_skip_what_cannot_be_read(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"case": 1, "score": 0.5}\n{"case": 2, "sc\n\n{"case": 3, "score": 1.0}\n')
    good = read_json_lines(spark, str(path), "case bigint, score double")
    assert rows(good) == [(1, 0.5), (3, 1.0)]
    write_json_lines(good, str(tmp_path / "out"))
    assert rows(spark.read.schema("case bigint, score double").json(str(tmp_path / "out"))) == rows(good)
