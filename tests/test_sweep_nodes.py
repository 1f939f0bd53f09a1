from probeline.plans import load


def test_query_pairs_nodes_not_users(spark, tmp_path):
    spark.sql("select 74L o_orderkey, 59L o_custkey").union(spark.sql("select 37L * 1168, 59L")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1, 9).selectExpr("id event_id", f"timestampadd(MINUTE, cast(id as int), timestamp_ntz'2024-01-02 21:00:00') ts", "id user_id", "'view' event_type", "1.0D value", "'{}' props").write.parquet(f"{tmp_path}/events.parquet")
    found = load()[0]["samples_in_sweeps"](spark, str(tmp_path))
    assert {r["event_id"] for r in found.where("run_id = 74").collect()} == {e for e in range(1, 9) if e % 3 == 59 % 3 and 2700 + e >= 74 * 37 + 1 and 2700 + e <= 74 * 37 + 59}
