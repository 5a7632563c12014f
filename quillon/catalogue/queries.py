"""One entry per operator: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import content_id
from ..functions.hashing import commutative_hash, set_identity
from ..operators import backfill, categories, classify, links, reads, serving, writes
from ..operators.reconstruct import reconstruct
from ..plans import device as plan
from ..plans.latency import running_means
from ..plans.subject import bounded_streak, derived_subject
from ..plans.submission import derived_submission
from ..sources.catalog import Catalog
from ..storage import cut, forget, shared
from .standins import EVENT_WINDOW, PERMUTATION_PART, RULES, SUBJECT_WINDOW, SUBMISSION, StandIns

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(StandIns(spark, sf_dir))
    return f


def subjects(t: StandIns) -> DataFrame:
    return derived_subject(t, t.now(), SUBJECT_WINDOW)


def _joined(array: str, *fields: str):
    """An array of structs as one string."""
    text = lambda x: F.concat_ws(":", *(F.coalesce(x[f].cast("string"), F.lit("null")) for f in fields))
    return F.array_join(F.array_sort(F.transform(array, text)), ",").alias(array)


@query
def subject_streak(t):
    e = t.events()
    return derived_subject(e, e["attribution_submission"].agg(F.max("created_at")).first()[0], EVENT_WINDOW)


@query
def subject_streak_bounded(t):
    e = t.events()
    return bounded_streak(e, e["attribution_submission"].agg(F.max("created_at")).first()[0], EVENT_WINDOW, 3600)


@query
def submission_faulty(t):
    return derived_submission(t, t.now())


@query
def device_filtered(t):
    return plan.filtered_devices(t, RULES)


@query
def device_counted(t):
    return plan.counted_devices(t, plan.attributions(t, subjects(t)), plan.filtered_devices(t, RULES), RULES)


@query
def latest_submission_popularity(t):
    return plan.latest_popularity(t, subjects(t))


@query
def active_permutation(t):
    return plan.active_permutations(t, plan.latest_popularity(t, subjects(t)), t["permutation"])


@query
def first_encountered(t):
    s = plan.attributions(t, subjects(t))
    return plan.first_encountered(t, plan.dated_submissions(t, s), plan.counted_devices(t, s, plan.filtered_devices(t, RULES), RULES))


def _versions(t, column):
    active_subjects = cut(subjects(t))
    dates = plan.permutation_dates(t, plan.dated_submissions(t, plan.attributions(t, active_subjects)), t["permutation"])
    active = plan.active_permutations(t, plan.latest_popularity(t, active_subjects), t["permutation"]) if column == "version_sw" else None
    return plan.versions(t["permutation"], dates, column, active)


@query
def versions_software(t):
    return _versions(t, "version_sw")


@query
def versions_hardware(t):
    return _versions(t, "version_hw")


@query
def device_entities(t):
    return plan.device_entities(t, plan.attributions(t, subjects(t)), t["permutation"], RULES)


def catalogue(t) -> DataFrame:
    return plan.derived_device(t, cut(subjects(t)), RULES)


@query
def derived_device(t):
    d = catalogue(t)
    return d.select("id", "integration", "manufacturer", "model", "model_id", "first_encountered_at", _joined("versions_software", "version", "active", "first_encountered_at"), _joined("versions_hardware", "version", "first_encountered_at"), _joined("entities", "domain", "original_device_class"), "count")


FILTER = serving.DeviceFilter(term="E", exclude_manufacturers=["PROMO"], include_integrations=[f"Brand#{k}" for k in range(1, 20)], exclude_integrations=["Brand#3"])


def _plain(t) -> DataFrame:
    """Every device with a count, as the catalogue that is served."""
    counts = t["attribution_device"].groupBy(F.col("device_id").alias("id")).agg(F.count("*").alias("count"))
    return t["device"].join(counts, "id")


@query
def devices_search(t):
    return serving.devices(_plain(t), FILTER, limit=50, offset=20)


@query
def devices_search_all(t):
    return serving.devices(_plain(t), FILTER)


@query
def device_by_id(t):
    return serving.device(_plain(t), PERMUTATION_PART)


@query
def devices_count(t):
    return serving.devices_count(_plain(t), FILTER)


@query
def devices_facets(t):
    return serving.facets(_plain(t), FILTER)


def _tree(t) -> DataFrame:
    """Regions over nations as a closure table."""
    nation, region = t.raw("nation"), t.raw("region")
    both = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    self_ = nation.select(F.col("n_name").alias("ancestor"), F.col("n_name").alias("descendant"), F.lit(0).alias("depth"))
    top = region.select(F.col("r_name").alias("ancestor"), F.col("r_name").alias("descendant"), F.lit(0).alias("depth"))
    return self_.unionByName(top).unionByName(both.select(F.col("r_name").alias("ancestor"), F.col("n_name").alias("descendant"), F.lit(1).alias("depth")))


@query
def category_rollup(t):
    counts = t.raw("customer").groupBy(F.col("c_nationkey").alias("integration")).agg(F.count("*").alias("count"))
    nation = t.raw("nation")
    second = nation.select((F.col("n_nationkey") + 1).alias("integration"), F.col("n_name").alias("category"))  # a second membership each
    return categories.rollup(counts, nation.select(F.col("n_nationkey").alias("integration"), F.col("n_name").alias("category")).unionByName(second), _tree(t))


@query
def dimension_facets(t):
    counts = t.raw("customer").groupBy(F.col("c_mktsegment").alias("manufacturer"), F.col("c_nationkey").cast("string").alias("integration")).agg(F.count("*").alias("count"))
    dimension = t.raw("nation").select(F.col("n_nationkey").cast("string").alias("integration"), F.array("n_name").alias("categories"), F.when(F.col("n_nationkey") % 3 != 0, F.when(F.col("n_nationkey") % 3 == 1, "online").otherwise("offline")).alias("connectivity"))
    return serving.dimensions(counts, dimension, _tree(t))


@query
def submissions_range(t):
    now = t.now()
    return reads.submissions_by_range(t, now, now - 30 * 86400, True)


@query
def submissions_range_incomplete(t):
    now = t.now()
    return reads.submissions_by_range(t, now - 30 * 86400, now, False)


@query
def attributions_range(t):
    now = t.now()
    return reads.attributions_by_range(t, now, now - 30 * 86400)


@query
def device_by_submission(t):
    return reads.devices_of(t, SUBMISSION)


@query
def permutation_by_submission(t):
    return reads.permutations_of(t, SUBMISSION)


@query
def link_by_submission(t):
    return reads.links_of(t, 1)


def _some_permutation(t) -> str:
    return t["permutation"].where(F.col("device_id") == PERMUTATION_PART).agg(F.min("id")).first()[0]


@query
def entity_by_submission_permutation(t):
    p = _some_permutation(t)
    s = t["attribution_permutation"].where(F.col("permutation_id") == p).agg(F.min("submission_id")).first()[0]
    return reads.entities_of(t, s, p)


@query
def entity_composition(t):
    c = reads.compositions_of(t, _some_permutation(t))
    return c.select("set_id", "count", _joined("entities", "id", "domain", "original_device_class"))


@query
def submission_by_hash(t):
    return reads.by_key(t, "submission", "hash", "7902699be42c8a8e46fbbb4501726517e86b22c56a189f7625a6da49081b2451")


@query
def attribution_by_subject(t):
    return reads.by_key(t, "attribution_submission", "subject", 7)


@query
def attribution_by_id(t):
    return reads.by_key(t, "attribution_submission", "id", SUBMISSION)


for _name, _table in {"count_submission": "submission", "count_attribution": "attribution_submission", "count_device": "device", "count_permutation": "permutation", "count_entity": "entity"}.items():
    QUERIES[_name] = lambda spark, sf_dir, table=_table: reads.count_of(StandIns(spark, sf_dir), table)
for _name, (_table, _column) in {"count_subject": ("attribution_submission", "subject"), "count_integration": ("device", "integration")}.items():
    QUERIES[_name] = lambda spark, sf_dir, table=_table, column=_column: reads.distinct_count_of(StandIns(spark, sf_dir), table, column)
for _name, (_table, *_columns) in {"manufacturer_integration_count": ("device", "manufacturer", "integration"), "entity_domain_class_count": ("entity", "domain", "original_device_class"), "version_count": ("attribution_submission", "version"), "model_count": ("device", "model")}.items():
    QUERIES[_name] = lambda spark, sf_dir, table=_table, columns=tuple(_columns): reads.grouped_count(StandIns(spark, sf_dir), table, *columns)


@query
def gauge_model(t):
    return reads.labelled_gauge(t, "device", "integration", "model")


@query
def dedup_upsert(t):
    """Devices of the catalogue's first half exist; all are inserted again by their key."""
    rows = t["device"].select(F.col("id").alias("arrival"), "integration", "manufacturer", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("model")).alias("model"), F.lit(None).cast("string").alias("model_id"))
    existing = writes.with_id(rows.where("arrival % 2 = 0"), "device").groupBy("id").agg(F.min_by(F.struct("integration", "manufacturer", "model", "model_id"), "arrival").alias("r")).select("id", "r.*")
    return writes.upsert(existing, rows, "device", "arrival").select("integration", "manufacturer", F.coalesce("model", F.lit("")).alias("model"), F.coalesce("model_id", F.lit("")).alias("model_id"))


@query
def content_ids(t):
    return t["device"].select("integration", "manufacturer", "model", content_id("device", "integration", "manufacturer", "model").alias("content_id"))


@query
def set_identities(t):
    members = t["sets"].groupBy(F.col("l_orderkey").alias("submission_id")).agg(F.collect_set("entity_id").alias("m"))
    return members.select("submission_id", set_identity(F.col("m")).alias("hash"))


@query
def version0_hashes(t):
    return backfill.version0_hashes(t)


@query
def legacy_entity_sets(t):
    pairs = t["sets"].select(F.col("l_orderkey").alias("submission_id"), F.concat_ws("-", F.lit("p"), (F.col("l_orderkey") % 50).cast("string")).alias("permutation_id"), "entity_id")
    sets, content, attributed = backfill.sets_from_pairs(pairs)
    sizes = content.groupBy(F.col("set_id").alias("id")).agg(F.count("*").alias("entities"))
    uses = attributed.groupBy(F.col("set_id").alias("id")).agg(F.count("*").alias("uses"))
    return sets.join(sizes, "id").join(uses, "id").select("permutation_id", "hash", "entities", "uses")


@query
def delete_cascade(t):
    """Rows left of each of the six tables after the submissions of one priority go."""
    names = ("submission", "attribution_submission", "attribution_device", "attribution_permutation", "attribution_set", "attribution_link")
    left = writes.delete_submissions({n: t[n] for n in names}, t["attribution_submission"].where("version = '1-URGENT'").select("id"))
    out = None
    for name in names:
        n = left[name].agg(F.count("*").alias("count")).select(F.lit(name).alias("name"), "count")
        out = n if out is None else out.unionByName(n)
    return out


@query
def orphan_devices(t):
    """Devices that no submission of the whole table uses once those before the subject window go."""
    names = ("submission", "attribution_submission", "attribution_device", "attribution_permutation", "attribution_set", "attribution_link")
    expired = t["attribution_submission"].where(F.col("created_at") < t.now() - SUBJECT_WINDOW).select("id")
    left = writes.delete_submissions({n: t[n] for n in names}, expired)
    kept = writes.delete_orphans(t["device"], "id", left["attribution_device"], "device_id")
    return t["device"].join(kept.select("id"), "id", "left_anti").select("id")


@query
def late_window(t):
    rows = t["attribution_submission"].select("id", "subject", (F.col("created_at") + 23 * 3600).alias("expected_at"))
    return writes.arrived_in_window(rows, t.now() - 86400, 10 * 86400)


@query
def finished_submissions(t):
    done = t["submission"].where("completed_at is null and id % 3 = 0").select("id", F.lit("h").alias("hash"), (F.col("created_at") + 5).alias("completed_at"))
    return writes.finish(t["submission"], done)


@query
def swapped_columns(t):
    return writes.swap_misplaced(t["device"].select("id", "model", "manufacturer"), "model", "manufacturer", "%A%")


@query
def commutative_hash_by_subject(t):
    rows = t["attribution_submission"].select("subject", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    return commutative_hash(rows, ["subject"], "digest")


@query
def limb_sums_by_subject(t):
    from ..functions.hashing import limb_sums

    rows = t["attribution_submission"].select("subject", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    return rows.groupBy("subject").agg(*limb_sums(F.col("digest")))


@query
def link_dangling(t):
    """Every turn refers to the second turn after the next, counted from the start or the end."""
    turns = t.raw("conversations").select("conv_id", "turn").distinct()
    devices = turns.select(F.col("conv_id").alias("submission_id"), F.lit("c").alias("integration"), F.col("turn").alias("position"), F.col("turn").cast("string").alias("hash"))
    children = turns.select(F.col("conv_id").alias("submission_id"), F.col("turn").cast("string").alias("child"), F.lit("c").alias("parent_integration"), F.when(F.col("turn") % 2 == 0, F.col("turn") + 3).otherwise(-F.col("turn") - 3).alias("parent_offset"))
    return links.dereference(children, devices)[1]


def _turn_edges(t) -> DataFrame:
    """Every turn refers to the one before, a user's also to the one after the next."""
    name = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), n.cast("string"))
    turns = t.raw("conversations").select("conv_id", "turn").distinct()
    ahead = t.raw("conversations").where("role = 'user'").select("conv_id", (F.col("turn") + 2).alias("turn")).distinct().join(turns, ["conv_id", "turn"], "left_semi")
    back = t["turns"].select(F.col("conv_id").alias("submission_id"), F.col("child_id").alias("child"), F.col("parent_id").alias("parent"))
    return back.unionByName(ahead.select(F.col("conv_id").alias("submission_id"), name(F.col("turn") - 2).alias("child"), name(F.col("turn")).alias("parent")))


@query
def link_cycles(t):
    """Turns on a cycle."""
    return links.cyclic_nodes(_turn_edges(t))


@query
def link_uncircular(t):
    """Edges of the turns that are on no cycle."""
    return links.without_cycles(_turn_edges(t))[0].select("submission_id", "child", "parent")


@query
def json_explode(t):
    return t.raw("events").select("event_id", F.explode(F.from_json("props", "map<string,long>")).alias("key", "value"))


@query
def link_extract(t):
    return t.raw("pages").select("page_id", F.explode(classify.references(F.col("html"), r'href="([^"]*)"')).alias("reference"))


@query
def classify_integration(t):
    words = F.create_map(*(F.lit(x) for x in ("BUILDING", "Light", "AUTOMOBILE", "Car", "MACHINERY", "Sensor", "HOUSEHOLD", "Media player", "FURNITURE", "Remote")))
    sets = t.raw("customer").groupBy("c_nationkey", (F.col("c_custkey") % 40).alias("k")).agg(F.collect_set(F.coalesce(F.element_at(words, F.col("c_mktsegment")), F.lit("Hub"))).alias("c"))
    return sets.select("c_nationkey", "k", F.array_join(F.array_sort(classify.canonical(F.col("c"))), ",").alias("categories"), classify.classified(classify.canonical(F.col("c"))).alias("classified"))


SPECIAL_TERMS = ["%", "_", "\\", "a%", "b_", "a\\s", "\\%"]


@query
def devices_search_special(t):
    """Searches for terms of wildcards and backslashes, in models that hold some of them."""
    at = F.col("id") % 4
    odd = F.when(at == 0, F.regexp_replace("model", " ", "%")).when(at == 1, F.regexp_replace("model", " ", "_")).when(at == 2, F.concat("model", F.lit("\\%"))).otherwise(F.col("model"))
    served, out = _plain(t).withColumn("model", odd), None
    for k, term in enumerate(SPECIAL_TERMS):
        one = serving.devices(served, serving.DeviceFilter(term=term)).select(F.lit(k).alias("term"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def _device_documents(t) -> DataFrame:
    """Each part as a device with two entities."""
    entity = lambda domain, kind, named: F.struct(F.lit(False).alias("assumed_state"), domain.alias("domain"), F.lit(None).cast("string").alias("entity_category"), named.alias("has_entity_name"), kind.alias("original_device_class"), F.lit(None).cast("string").alias("unit_of_measurement"))
    entities = F.array(entity(F.col("manufacturer"), F.lit(None).cast("string"), F.lit(True)), entity(F.col("integration"), F.col("model_id"), F.col("id") % 2 == 0))
    return t["device"].select("id", "integration", F.struct(entities.alias("entities"), F.lit("service").alias("entry_type"), (F.col("id") % 3 == 0).alias("has_configuration_url"), F.lit(None).cast("string").alias("sw_version"), F.lit("1.0").alias("hw_version"), "manufacturer", "model_id", "model", F.lit(None).cast("array<string>").alias("via_device")).alias("device"))


@query
def device_hash(t):
    from ..functions.hashing import device_hash as hash_of

    return _device_documents(t).select("id", hash_of(F.col("integration"), F.col("device")).alias("hash"))


@query
def hash_texts(t):
    """Serialised submission hashes and what is read back from them."""
    from ..functions.hashing import deserialised, hmac_sha256, serialised

    text = serialised(F.col("hash"), 1)
    return t["submission"].select("id", text.alias("text"), deserialised(text)["hash"].alias("hash"), deserialised(F.concat(F.lit("7"), text)).isNull().alias("unknown"), hmac_sha256(b"key", F.col("id").cast("string")).alias("keyed"))


@query
def reconstructed(t):
    """Submission documents from the normalised tables: a row for each device in one."""
    body = reconstruct(t).select("submission_id", F.explode("body").alias("integration", "part"))
    devices = body.select("submission_id", "integration", F.explode("part.devices").alias("d"))
    names = F.array_join(F.array_sort(F.transform("d.entities", lambda e: F.concat_ws(":", e["domain"], e["original_device_class"]))), ",")
    return devices.select("submission_id", "integration", F.col("d.manufacturer").alias("manufacturer"), F.col("d.model").alias("model"), F.col("d.sw_version").alias("sw_version"), F.col("d.hw_version").alias("hw_version"), names.alias("entities"))


@query
def repointed_links(t):
    """Links that exist twice become one, and their attributions follow."""
    twice = t["link"].unionByName(t["link"].withColumn("id", F.concat(F.lit("#"), "id")))
    used = t["attribution_link"].unionByName(t["attribution_link"].withColumn("link_id", F.concat(F.lit("#"), "link_id")))
    return writes.repoint_links(twice, used)[1]


@query
def once_each(t):
    """The first order of each customer without an urgent one."""
    rows = t.raw("orders").select(F.col("o_custkey").alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_at"), "o_orderkey")
    return writes.once_each(rows, t.raw("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).distinct())


@query
def inserted_pairs(t):
    """Pairs of the returned lines are there; all lines are inserted."""
    pairs = lambda rows: rows.select(F.col("l_orderkey").alias("submission_id"), F.col("l_partkey").alias("device_id"))
    return writes.insert_pairs(pairs(t.raw("lineitem").where("l_returnflag = 'R'")).distinct(), pairs(t.raw("lineitem")))


@query
def arrivals(t):
    """How each order arrives that was expected 23 hours after the customer's one before."""
    seen = t["attribution_submission"]
    before = F.lag("created_at").over(W.partitionBy("subject").orderBy("created_at", "id"))
    return seen.select("id", "created_at", (before + 23 * 3600).alias("expected_at")).select("id", writes.arrival(F.col("created_at"), F.col("expected_at"), 30 * 86400).alias("arrival"))


@query
def next_expected(t):
    return writes.next_expected(t["attribution_submission"])


def _dimension(t) -> DataFrame:
    return t.raw("nation").select(F.col("n_name").alias("integration"), F.array("n_name", F.concat(F.lit("x"), "n_name")).alias("categories"), F.when(F.col("n_nationkey") % 3 != 0, F.when(F.col("n_nationkey") % 3 == 1, "online").otherwise("offline")).alias("connectivity"))


@query
def category_integrations(t):
    some = [r[0] for r in t.raw("region").select("r_name").orderBy("r_name").limit(3).collect()]  # the request's argument
    return categories.integrations(some, ["online"], _tree(t), _dimension(t))


@query
def integration_manifest(t):
    """Front matter made from customers, read back and classified."""
    word = F.element_at(F.array(*map(F.lit, ("Light", "Car", "Sensor", "Media player", "Hub"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    iot = F.element_at(F.array(*map(F.lit, ("Local Push", "Cloud Polling", "Calculated"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    front = F.concat(F.lit("title: \""), "c_name", F.lit("\"\nha_category:\n  - "), word, F.lit("\n  - Hub\nha_iot_class: "), iot, F.lit("\nha_domain: "), F.col("c_custkey").cast("string"))
    content = F.concat(F.lit("See [one](https://a.b/"), F.col("c_custkey").cast("string"), F.lit(") and [two](https://c.d) and [again](https://c.d)."))
    m = classify.manifest(t.raw("customer").select(F.col("c_custkey").cast("string").alias("name"), front.alias("front"), content.alias("content")))
    return m.select("name", "title", "url", F.array_join("categories", ",").alias("categories"), F.array_join("classified", ",").alias("classified"), "inferred", "connectivity", F.array_join("references", ",").alias("references"))


def _catalog(t) -> Catalog:
    return Catalog(t.spark, shared(t.spark, "catalog"))


@query
def catalog_sizes(t):
    """Stand-ins written to a catalog: tables and whether they take the bytes that their files have."""
    catalog = _catalog(t)
    rows = {"staging.attribution_device": t["attribution_device"].select(F.col("submission_id").cast("string").alias("submission_id"), F.col("device_id").cast("string").alias("device_id")), "staging.submission": t["submission"].withColumn("id", F.col("id").cast("string")), "staging.link": t["link"].limit(0)}
    catalog.commit(append=rows)
    sizes = t.spark.createDataFrame(catalog.sizes(), "name string, bytes long")
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(catalog.root).where("path like '%.parquet'").select(F.regexp_extract("path", r"/(staging\.\w+)/p-", 1).alias("name"), "length").groupBy("name").agg(F.sum("length").alias("length"))
    return sizes.join(files, "name", "left").select("name", (F.col("bytes") >= F.coalesce("length", F.lit(0))).alias("whole"), (F.col("bytes") > 0).alias("filled"))


@query
def catalog_columns(t):
    """The declared columns and what they refer to."""
    return _catalog(t).columns()


#: Bytes of compressed deliveries in a batch of the stream: about 350,000 orders. What a batch
#: holds on disk beside the catalog is bounded by them.
DELIVERED = 16 << 20


@query
def streaming_ingest(t):
    """Every order as a delivered document of its parts, followed by the stream in batches of
    bounded size into an empty catalog; rows of its tables."""
    from ..streaming.ingest import stream

    d = t["device"].withColumnRenamed("id", "device_id")
    part = F.struct(F.array().cast("array<string>").alias("entities"), F.lit(True).alias("has_configuration_url"), "manufacturer", "model", "model_id")
    # dealt by submission once, for both groupings and the join
    parts = t["attribution_device"].join(d, "device_id").repartition("submission_id").groupBy("submission_id", "integration").agg(F.collect_list(part).alias("devices"))
    bodies = parts.groupBy("submission_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("integration", F.struct("devices", F.array().cast("array<string>").alias("entities")))))).alias("body"))
    orders = t["attribution_submission"].join(bodies, "submission_id")
    source, catalog = shared(t.spark, "deliveries"), _catalog(t)
    orders.select(F.col("id").cast("string").alias("id"), F.col("subject").cast("string").alias("subject"), "version", "created_at", "body").write.option("maxRecordsPerFile", 50_000).json(source, compression="gzip")
    forget(t.spark)
    query = stream(t.spark, source, catalog, shared(t.spark, "progress"), bytes_per_trigger=DELIVERED, once=True)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    out = None
    for name in ("device", "permutation", "submission", "attribution_submission", "attribution_device", "entity"):
        n = catalog.read(f"staging.{name}").agg(F.count("*").alias("count")).select(F.lit(name).alias("name"), "count")
        out = n if out is None else out.unionByName(n)
    return out


@query
def latency_means(t):
    """Gaps between a user's events stand for seconds of one query."""
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - F.lag(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    runs = t.raw("events").select(F.col("user_id").alias("name"), F.col("event_id").alias("at"), F.round(gap).cast("long").alias("seconds")).where("seconds is not null")
    return running_means(runs).select("name", "at", "seconds", F.round(F.col("mean"), 3).alias("mean"), "slow")


@query
def table_sizes(t):
    """Row counts stand for sizes of tables here."""
    out = None
    for name in ("device", "submission", "entity"):
        n = t[name].agg(F.count("*").alias("pgsize")).select(F.lit(name).alias("name"), "pgsize")
        out = n if out is None else out.unionByName(n)
    return out


@query
def health(t):
    return t.spark.range(1).select(F.lit(1).alias("one"))
