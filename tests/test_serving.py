import pytest
from pyspark.sql import functions as F

from quillon.operators import categories, classify, serving
from quillon.operators.reads import one
from quillon.operators.serving import DeviceFilter

TREE = {"home": {"name": "Home", "children": {"light": {"name": "Light", "children": {}}, "climate": {"name": "Climate", "children": {"fan": {"name": "Fan"}}}}}, "car": {"name": "Car"}}


@pytest.fixture(scope="module")
def world(spark):
    catalogue = spark.createDataFrame([("1", "hue", "Signify", "Hue lamp", None, 10, 9), ("2", "fans", "Acme", None, "F%1", 10, 5), ("3", "both", "Acme", "Mixed", "B_1", None, 5), ("4", "gone", "Other", "x", "y", 10, 1)], "id string, integration string, manufacturer string, model string, model_id string, first_encountered_at long, count long")
    dimension = spark.createDataFrame([("hue", "Hue", ["light"], "offline"), ("fans", "Fans", ["fan"], "online"), ("both", "Both", ["light", "fan"], "offline")], "integration string, title string, categories array<string>, connectivity string")
    return catalogue, dimension, categories.closure(spark, TREE)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_filters_and_search(world):
    c = world[0]
    assert ids(serving.devices(c)) == ["1", "2", "3", "4"]
    assert ids(serving.devices(c, DeviceFilter(term="acme"), limit=1, offset=1)) == ["3"]
    assert ids(serving.devices(c, DeviceFilter(term="f%1"))) == ["2"] and ids(serving.devices(c, DeviceFilter(term="b_"))) == ["3"]
    assert ids(serving.devices(c, DeviceFilter(include_manufacturers=[]))) == []
    assert ids(serving.devices(c, DeviceFilter(exclude_manufacturers=["Acme"], exclude_integrations=["gone"]))) == ["1"]
    assert one(serving.devices_count(c, DeviceFilter(term="acme")))["count"] == 2


def test_categories_and_connectivity_expand(world):
    c, dimension, tree = world
    found = lambda **k: ids(serving.devices(c, serving.resolved(DeviceFilter(), tree, dimension, **k)))
    assert found(include_categories=["climate"]) == ["2", "3"]
    assert found(include_categories=["home"], include_connectivity=["online"]) == ["2"]
    assert found(exclude_categories=["climate"], exclude_connectivity=["offline"]) == ["1", "2", "4"]  # only integrations of both
    assert found(include_categories=["car"]) == []


def test_facets_count_siblings_twice_above(world):
    c, dimension, tree = world
    got = {(r["facet"], r["value"]): r["count"] for r in serving.dimensions(serving.facets(c), dimension, tree).collect()}
    assert got[("category", "home")] == 4 and got[("category", "climate")] == 2 and got[("category", "light")] == 2
    assert got[("manufacturer", "Acme")] == 2 and got[("connectivity", "offline")] == 2 and ("category", "car") not in got


def test_enriched_rows_and_json(world):
    c, dimension, _ = world
    rows = serving.enriched(c, dimension)
    assert sorted(ids(rows)) == ["1", "2", "4"]
    assert '"model":null' in one(serving.as_json(c.where("id = '2'")))["body"]
    with pytest.raises(ValueError):
        one(c)


@pytest.mark.parametrize("page,rows,span,rels", [(0, 10, "0-9", {"first", "last", "next"}), (1, 10, "10-19", {"first", "last", "next", "prev"}), (2, 5, "20-24", {"first", "last", "prev"}), (9, 0, "*", {"first", "last", "prev"})])
def test_pagination(spark, page, rows, span, rels):
    p = serving.paginate(spark.range(25).orderBy("id"), page, 10, "/devices", {"term": "a b"})
    assert (len(p.rows), p.total, p.content_range, set(p.links)) == (rows, 25, f"items {span}/25", rels)
    assert p.links["last"] == "/devices?term=a+b&page=2&size=10"


def test_pagination_of_nothing_and_bounds(spark):
    p = serving.paginate(spark.range(0), 0)
    assert (p.rows, p.total, set(p.links)) == ([], 0, {"first", "last"})
    for bad in ({"page": -1}, {"size": 9}, {"size": 51}):
        with pytest.raises(ValueError):
            serving.paginate(spark.range(1), **bad)


def test_manifest(spark):
    def front(name, categories, **more):
        return (name, "\n".join([f"title: '{name.title()}'", f"ha_domain: {more.pop('domain', name)}", *(f"{k}: {v}" for k, v in more.items()), "ha_category:", *(f"  - {c}" for c in categories)]), f"See [x](https://a.example/{name}) and [y](http://b.example) [x](https://a.example/{name}) https://plain.example")

    rows = [front("lamp", ["light", "Sensor"], ha_iot_class="Local Push"), front("media", ["Media source", "Remote"], ha_iot_class="Cloud Push"), front("child", ["Light"], ha_supporting_domain="lamp"), front("odd", ["Light"], domain="even"), front("virtual", ["Light"], ha_integration_type="virtual"), front("manual", ["Hub"]), ("bare", "title: Bare\nha_domain: bare", "")]
    got = {r["name"]: r for r in classify.manifest(spark.createDataFrame(rows, "name string, front string, content string"), manual={"manual": ["car", "fan"]}, excluded_types=["virtual"]).collect()}
    assert set(got) == {"lamp", "media", "virtual", "manual"}
    assert (got["lamp"]["title"], got["lamp"]["classified"], got["lamp"]["inferred"], got["lamp"]["connectivity"], got["lamp"]["aliases"]) == ("Lamp", ["lighting"], True, "offline", ["child"])
    assert got["media"]["classified"] == ["entertainment"] and got["media"]["categories"] == ["Media Player", "Remote"]
    assert got["virtual"]["classified"] is None and (got["manual"]["classified"], got["manual"]["inferred"]) == (["car", "fan"], False)
    assert got["lamp"]["references"] == ["https://a.example/lamp", "http://b.example"]
