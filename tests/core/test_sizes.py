"""What the supplied tables are too small to show: long numbers, large groups, and plans that grow with the input only."""

import duckdb
from pyspark.sql import Row

from trussline.plans import registry
from trussline.sources import dxf


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_component_merge_carries_no_lists_of_notes(spark):
    for name in ("component_merge", "annotation_bind"):
        assert "collect_list" not in plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_fragment_storeys_of_over_a_hundred_assets_equal_sql(spark, tmp_path):
    asset = spark.range(20 * 120)
    e = asset.selectExpr("id AS event_id", "timestamp'2024-01-01' AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value", "'{\"k\": 1}' AS props")
    e.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["fragment_storeys"]).df()
    got = registry.QUERIES["fragment_storeys"](spark, str(tmp_path)).toPandas()
    assert sorted(map(tuple, got[want.columns].values)) == sorted(map(tuple, want.values))
    assert want.fragment_id.str.contains("default").sum() == 1200


def test_header_values_broadcast_nothing_and_hold_over_cells(spark, monkeypatch):
    monkeypatch.setattr(dxf, "CELL", 3)
    con = duckdb.connect()
    con.execute("CREATE VIEW orders AS SELECT * FROM '/root/testdata/sf0.001/orders.parquet'")
    got = registry.QUERIES["header_values"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()
    assert sorted(map(repr, got.collect())) == sorted(repr(Row(**dict(zip(got.columns, r, strict=True)))) for r in con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES['header_values']})").fetchall())


def test_request_queries_read_the_orders_once_a_branch_and_exchange_no_texts(spark):
    # Before: 4, 4, 7, 2 and 3 readings, and twice as many exchanges as now.
    for name, readings in {"rule_trace": 3, "rule_status": 3, "strategy_steps": 4, "clarifications": 1, "clarification_texts": 2}.items():
        text = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert text.count("FileScan parquet") <= readings, name
