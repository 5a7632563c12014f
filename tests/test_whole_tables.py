"""Catalogue queries over whole tables, on small tables of their own."""

from datetime import datetime

import pytest

from quillon.catalogue import QUERIES


@pytest.fixture
def tables(spark, tmp_path):
    """Writes a table where the catalogue reads it; returns the writer and the folder."""

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    return put, str(tmp_path)


def orders(put, dates, priorities=None):
    schema = "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate timestamp_ntz"
    put("orders", [(k, k, (priorities or {}).get(k, "5-LOW"), "F", d) for k, d in dates.items()], schema)


def lineitem(put, pairs):
    put("lineitem", [(o, p, 1, n, "N", "O") for n, (o, p) in enumerate(pairs)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string")


def test_orphans_are_sought_in_the_whole_table(spark, tables):
    put, folder = tables
    orders(put, {100: datetime(1995, 1, 1), 101: datetime(2000, 1, 1), 900: datetime(2000, 1, 1)})
    put("part", [(p, "b", "t", "n", 1) for p in (1, 2, 3, 4)], "p_partkey long, p_brand string, p_type string, p_name string, p_size int")
    put("conversations", [], "conv_id long, turn long, role string, text string")
    lineitem(put, [(900, 1), (100, 2), (100, 3), (101, 3)])
    assert sorted(r["id"] for r in QUERIES["orphan_devices"](spark, folder).collect()) == [2, 4]


def test_cascade_takes_the_links_along(spark, tables):
    put, folder = tables
    orders(put, {k: datetime(2000, 1, 1) for k in (1, 2, 3)}, {2: "1-URGENT"})
    lineitem(put, [(1, 1), (2, 1), (3, 1)])
    put("conversations", [(c, n, "user", "x") for c in (1, 2, 3) for n in range(3)], "conv_id long, turn long, role string, text string")
    left = {r["name"]: r["count"] for r in QUERIES["delete_cascade"](spark, folder).collect()}
    assert left == {"submission": 2, "attribution_submission": 2, "attribution_device": 2, "attribution_permutation": 2, "attribution_set": 2, "attribution_link": 4}


def test_cycles_of_every_conversation_are_found(spark, tables):
    put, folder = tables
    roles = ["system", "user", "system", "system", "system"]
    put("conversations", [(c, n, r, "x") for c in range(40) for n, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, QUERIES["link_cycles"](spark, folder).collect()))
    assert got == sorted((c, f"{c}:{n}") for c in range(40) for n in (1, 2, 3))


def test_a_reconstructed_device_is_dealt_by_submission_once(spark, tables):
    """Each exchange holds every device on disk until the query ends: attributions, sets and
    contents by set, instances and permutations by permutation, permutations and devices by
    device, and whole devices by submission."""
    put, folder = tables
    put("part", [(p, "b", "t", "n", 1) for p in (1, 2, 3)], "p_partkey long, p_brand string, p_type string, p_name string, p_size int")
    lineitem(put, [(1, 1), (1, 2), (2, 1), (2, 1), (3, 3)])
    found = QUERIES["reconstructed"](spark, folder)
    plan = found._jdf.queryExecution().optimizedPlan()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = spark._jsparkSession.sessionState().executePlan(plan, found._jdf.queryExecution().mode()).executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one more by entity, which is broadcast where the few entities are
    assert spread.count("Exchange hashpartitioning") <= 11
    assert spread.count("Exchange hashpartitioning(submission_id") == 1
    assert found.count() == 5
