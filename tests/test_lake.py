"""Table management, catalog, event logs, console."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from loam.operators import metering
from loam.operators.console import Console, clean_sql
from loam.session import scratch
from loam.sources import catalog, event_log, lake
from loam.streaming import ingest
from tests.test_streams import fresh_lake, message
from loam import schemas


def day_message(offset, day):
    return message("s-1", offset, timestamp=f"2026-01-{day:02d}T10:00:00Z")


def test_create_is_idempotent_and_columns_can_be_added(spark):
    target = fresh_lake(spark)
    ingest.write_batch(target)(spark.createDataFrame([message("s-1", 0)], schemas.MESSAGE), 0)
    target.create()
    assert spark.table(target.readings).count() == 1
    for _ in range(2):
        target.add_column(target.readings, "calibration", "string")
    assert spark.table(target.readings).columns.count("calibration") == 1
    assert spark.table(target.readings).filter("calibration IS NULL").count() == 1
    assert spark.table(f"{target.database}.soil_data").columns == [n for n, _ in schemas.LAKE_COLUMNS]
    assert spark.table(f"{target.database}.sensor_data").columns == ["timestamp", "payload", "sensor_id", "tenant_id"]


def test_expiry_drops_whole_old_days(spark):
    target = fresh_lake(spark)
    ingest.write_batch(target)(spark.createDataFrame([day_message(i, i + 1) for i in range(20)], schemas.MESSAGE), 0)
    assert target.expire("2026-01-20 00:00:00") == 12
    assert spark.table(target.readings).agg(F.min("event_date").cast("string")).first()[0] == "2026-01-13"
    assert target.expire("2026-01-20 00:00:00") == 0


def test_rows_without_a_time_and_dead_letters_expire_by_arrival(spark):
    target = fresh_lake(spark)
    data = [message("s-1", 0, timestamp="yesterday"), ("iot.x", bytearray(b"{}"), 0, 1, message("s-1", 0)[4])]
    ingest.write_batch(target)(spark.createDataFrame(data, schemas.MESSAGE), 0)
    assert spark.table(target.readings).filter("event_time IS NULL").count() == spark.table(target.dead_letters).count() == 1
    assert target.expire("2026-01-05 00:00:00") == 0
    assert target.expire("2026-01-20 00:00:00") == 2
    assert spark.table(target.readings).count() == spark.table(target.dead_letters).count() == 0


def test_time_and_type_prune_folders(spark, plan):
    target = fresh_lake(spark)
    ingest.write_batch(target)(spark.createDataFrame([day_message(i, i + 1) for i in range(5)], schemas.MESSAGE), 0)
    rows = lake.retained(spark.table(target.readings), "2026-01-10 00:00:00").filter("sensor_type = 'soil'")
    text = plan(rows)
    partitions = text.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "event_date" in partitions and "sensor_type" in partitions
    assert rows.count() == 3


def test_catalog_tree_of_a_database(spark):
    target = fresh_lake(spark)
    found = catalog.tree(spark, target.database, search="DEAD").collect()
    mine = [r for r in found if r.schema_name.endswith(target.database)]
    assert [r.table_name for r in mine] == ["dead_letters"]
    assert [c["name"] for c in mine[0].columns][:3] == ["raw_topic", "_partition", "_offset"]


def test_query_stats_from_an_event_log(spark):
    ui = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecution"
    lines = [
        {"Event": ui + "Start", "executionId": 4, "time": 1_000, "description": "q"},
        {"Event": "SparkListenerJobStart", "Stage IDs": [1, 2], "Properties": {"spark.sql.execution.id": "4"}},
        {"Event": "SparkListenerJobStart", "Stage IDs": [9], "Properties": {}},
        *[{"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Task Metrics": {
            "Executor CPU Time": 1_500_000_000, "Peak Execution Memory": peak,
            "Input Metrics": {"Bytes Read": 1024 ** 3}}} for stage, peak in [(1, 5), (2, 1024 ** 3), (9, 7)]],
        {"Event": ui + "End", "executionId": 4, "time": 5_000},
    ]
    path = scratch(spark, "log")
    spark.createDataFrame([(json.dumps(line),) for line in lines], "value string").write.text(path)
    row = metering.with_query_cost(event_log.query_stats(spark, path)).collect()
    assert len(row) == 1
    assert (row[0].processed_bytes, row[0].cpu_ms, row[0].wall_ms) == (2 * 1024 ** 3, 3000, 4000)
    assert (row[0].qu, row[0].cost) == (10.0, 0.1)


def own_tables(session):
    frame = session.createDataFrame([("1", 10), ("2", 20), ("2", 30)], "tenant_id string, v int")
    return {"readings": frame, "shared": session.range(3).toDF("x")}


def test_console_shows_one_tenant_only(spark, rows):
    console = Console(spark, 2, own_tables)
    assert rows(console.query("SELECT v FROM readings")) == [(20,), (30,)]
    assert rows(console.query("SELECT v FROM readings WHERE tenant_id = '1'")) == []
    assert rows(console.run("SELECT Current_User_Tenant() AS t, count(*) AS n FROM readings;")) == [("2", "2")]
    assert rows(console.query("SELECT count(*) FROM shared")) == [(3,)]
    assert rows(Console(spark, 1, own_tables).query("SELECT v FROM readings")) == [(10,)]


def test_console_refuses(spark):
    with pytest.raises(ValueError):
        clean_sql(" ;; ")
    with pytest.raises(ValueError):
        Console(spark, "1' OR '1' = '1", own_tables)
    console = Console(spark, 1, own_tables)
    with pytest.raises(ValueError):
        console.query("SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`")
    with pytest.raises(AnalysisException):
        console.query("SELECT nothing FROM readings")


@pytest.mark.parametrize("text", [
    "SELECT * FROM {db}.readings", "SELECT (SELECT max(_offset) FROM {db}.readings) AS m",
    "WITH c AS (SELECT * FROM {db}.dead_letters) SELECT * FROM c", "TABLE {db}.readings",
    "SELECT 1 WHERE EXISTS (SELECT 1 FROM spark_catalog.{db}.readings)", "USE {db}", "SHOW TABLES IN {db}",
    "SELECT v FROM readings WHERE v IN (SELECT _offset FROM {db}.readings)",
    "FROM readings INSERT INTO {db}.dead_letters SELECT *", "DROP VIEW readings",
    "SELECT * FROM IDENTIFIER('{db}.readings')", "SELECT * FROM IDENTIFIER('{db}' || '.readings')",
    "SELECT (SELECT max(_offset) FROM IDENTIFIER('{db}.readings')) AS m",
    "WITH x AS (SELECT 1 a) INSERT OVERWRITE DIRECTORY '/tmp/loam-refused' USING parquet SELECT * FROM x",
    "FROM readings INSERT OVERWRITE DIRECTORY '/tmp/loam-refused' USING parquet SELECT *",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.dir')", "SELECT reflect('java.lang.System', 'nanoTime')",
    "SELECT upper(try_reflect('java.lang.System', 'getProperty', 'user.dir')) FROM readings",
    "SELECT v FROM readings WHERE EXISTS (WITH dead_letters AS (SELECT 1) SELECT * FROM dead_letters) AND v IN (SELECT _offset FROM {db}.dead_letters)"])
def test_console_cannot_leave_the_tenants_views(spark, text):
    console = Console(spark, 1, own_tables)
    with pytest.raises(ValueError):
        console.query(text.format(db=fresh_lake(spark).database))


def test_console_refuses_tables_of_the_current_database(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS other_tenants (v int) USING parquet")
    console = Console(spark, 1, own_tables)
    with pytest.raises(ValueError):
        console.query("SELECT * FROM other_tenants")


def test_console_allows_cte_names_parameters_and_set_operations(spark, rows):
    console = Console(spark, 2, own_tables)
    assert rows(console.query("WITH c AS (SELECT v FROM readings WHERE v > :low) SELECT * FROM c", {"low": 20})) == [(30,)]
    assert rows(console.query("(SELECT v FROM READINGS) EXCEPT (SELECT 20)")) == [(30,)]


def test_console_result_limit_and_nulls(spark):
    console = Console(spark, 1, lambda s: {"n": s.range(3000)})
    assert console.run("SELECT id FROM n").count() == 1000
    assert console.run("SELECT CAST(NULL AS INT) AS a, 1.5D AS b").first() == (None, "1.5")
