import hashlib

import pytest
from pyspark.sql import functions as F

from quillon.functions.expressions import ascii_ilike, connectivity, contains_term, content_id, floor_second, has_version, search_pattern, tri_state, unordered_between, unquoted
from quillon.functions.hashing import commutative_hash, deserialised, device_hash, digest_of_sum, serialised, set_identity
from quillon.schemas import DEVICE

#: Known digest of integration a with manufacturer Manufacturer, model Model and nothing else.
TEMPLATE = "585f08900fbdcd5e9362b2768535174101652a8bddc25cbddbf3ab03accb5d90"


def device(entities=(), **values):
    row = {"entities": list(entities), "entry_type": None, "has_configuration_url": False, "sw_version": None, "hw_version": None, "manufacturer": "Manufacturer", "model_id": None, "model": "Model", "via_device": None}
    return row | values


def entity(**values):
    return {"assumed_state": False, "domain": "sensor", "entity_category": None, "has_entity_name": True, "original_device_class": None, "unit_of_measurement": None} | values


def hashes(spark, *devices):
    df = spark.createDataFrame([(d,) for d in devices], f"d {DEVICE}")
    return [r[0] for r in df.select(device_hash(F.lit("a"), F.col("d"))).collect()]


def test_device_hash_vector_and_order(spark):
    a, b = entity(domain="light"), entity(domain="fan", assumed_state=None)
    plain, one, other, twice = hashes(spark, device(), device([a, b]), device([b, a]), device([a, a, b]))
    assert plain == TEMPLATE and one == other and len({plain, one, twice}) == 3


def reference_sum(members):
    total = sum(int(hashlib.sha256(m).hexdigest(), 16) for m in members)
    text = f"{total:x}"
    return hashlib.sha256(bytes.fromhex("0" * (len(text) % 2) + text)).hexdigest()


def test_commutative_hash_equals_big_integers(spark):
    groups = {k: [f"{k}/{i}".encode() for i in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 700))}
    rows = [(k, hashlib.sha256(m).hexdigest()) for k, ms in groups.items() for m in reversed(ms)]
    got = {r["k"]: r["hash"] for r in commutative_hash(spark.createDataFrame(rows, "k string, d string"), ["k"], "d").collect()}
    assert got == {k: reference_sum(ms) for k, ms in groups.items()}


def test_commutative_hash_of_nothing(spark):
    got = spark.range(1).select(digest_of_sum([F.lit(0).cast("long")] * 8).alias("h")).first()["h"]
    assert got == hashlib.sha256(b"\0").hexdigest()


def test_hash_round_trip_and_unknown_versions(spark):
    df = spark.createDataFrame([(TEMPLATE,)], "h string").select(serialised(F.col("h")).alias("s"))
    text = df.first()["s"]
    rows = spark.createDataFrame([(text,), ("2-" + text[2:],), ("1-AAAA",), ("1-*",), (None,)], "s string").select(deserialised(F.col("s")).alias("r")).collect()
    assert (rows[0]["r"]["version"], rows[0]["r"]["hash"]) == (1, TEMPLATE) and all(r["r"] is None for r in rows[1:])


def test_set_identity_ignores_order(spark):
    rows = spark.createDataFrame([(["a", "b"],), (["b", "a"],), ([],), (["ab"],)], "m array<string>").select(set_identity(F.col("m")).alias("i")).collect()
    assert rows[0] == rows[1] and rows[0]["i"] == rows[3]["i"] and rows[2] != rows[0]


def values(spark, schema, rows, expression):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expression).collect()]


def test_pattern_underscore_is_a_wildcard_and_case_is_ascii(spark):
    assert values(spark, "c string", ["Stiebel", "Atlantic", "_TZ3000", "Tuya", "T", None], ascii_ilike("c", "_T%")) == [True, True, True, False, False, None]
    assert values(spark, "c string", ["É", "é"], ascii_ilike("c", "é")) == [False, True]


@pytest.mark.parametrize("term,hits", [("50%", ["50% off"]), ("a_b", ["a_b"]), ("HUE", ["Hue lamp"]), ("", ["50% off", "50 off", "a_b", "axb", "Hue lamp"]), (None, ["50% off", "50 off", "a_b", "axb", "Hue lamp"]), ("nothing", [])])
def test_search_terms(spark, term, hits):
    rows = ["50% off", "50 off", "a_b", "axb", "Hue lamp"]
    assert [r for r, hit in zip(rows, values(spark, "c string", rows, contains_term("c", term))) if hit] == hits


def test_search_pattern():
    assert search_pattern("a%b_c\\") == "%a\\%b\\_c\\%"


def test_versions(spark):
    rows = ['"1.2"', '"', "1", '""', '"None"', '"0"', " ", None]
    assert values(spark, "c string", rows, unquoted("c"))[:3] == ["1.2", '"', "1"]
    assert [bool(x) for x in values(spark, "c string", rows, has_version("c"))] == [True, True, True, False, False, False, False, False]


def test_ranges_and_states(spark):
    assert values(spark, "c long", [1, 5, 9, None], unordered_between("c", 8, 2)) == [False, True, False, None]
    assert values(spark, "c long", [1], unordered_between("c", None, 2)) == [None]
    assert [values(spark, "c long", [1, None], tri_state("c", x)) for x in (None, True, False)] == [[True, True], [True, False], [False, True]]


def test_null_and_empty_are_one_key(spark):
    a, b, c = values(spark, "c string", [None, "", "x"], content_id("k", "c"))
    assert a == b != c


def test_floor_and_connectivity(spark):
    assert spark.sql("select timestamp'1970-01-01 00:00:01.9' a, timestamp'1969-12-31 23:59:59.5' b").select(floor_second("a"), floor_second("b")).first() == (1, -1)
    assert values(spark, "c string", ["Local Push", "Cloud Polling", "Calculated", None], connectivity("c")) == ["offline", "online", None, None]
