"""The staging relations as views of the star schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import floor_second
from ..plans.device import DeviceRules

#: Parameters that leave every stage something to do and something to drop.
SUBJECT_WINDOW = 90 * 86400
EVENT_WINDOW = 25 * 3600
RULES = DeviceRules(blocked_integrations=["Brand#1", "Brand#7"], model_unlike="% ring", least_subjects=10, device_classes=["A", "N"])
SUBMISSION, PERMUTATION_PART = 7, 77


class StandIns(dict):
    """Tables by name, made when they are first asked for. What is reduced to distinct rows is
    dealt by the column that it is joined by, so that the join needn't deal it again."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.dir, self._now = spark, sf_dir, None

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __missing__(self, name: str) -> DataFrame:
        self[name] = found = getattr(self, f"_{name}")()
        return found

    def _attribution_submission(self):
        return self.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("submission_id"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("version"), floor_second("o_orderdate").alias("created_at"))

    def _submission(self):
        at = floor_second("o_orderdate")
        return self.raw("orders").select(F.col("o_orderkey").alias("id"), at.alias("created_at"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"), F.when(F.col("o_orderstatus") != "O", at + 60).alias("completed_at"))

    def _device(self):
        model = F.when(F.col("p_name") != "red plate", F.col("p_name"))
        return self.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("integration"), F.col("p_type").alias("manufacturer"), model.alias("model"), F.col("p_size").cast("string").alias("model_id"))

    def _attribution_device(self):
        return self.raw("lineitem").select(F.col("l_orderkey").alias("submission_id"), F.col("l_partkey").alias("device_id")).distinct()

    def _permutation(self):
        rows = self.raw("lineitem").select("l_partkey", "l_suppkey", "l_linenumber").repartition("l_partkey").distinct()
        quote = lambda *c: F.concat(F.lit('"'), *c, F.lit('"'))
        return rows.select(
            _permutation_id().alias("id"), F.col("l_partkey").alias("device_id"), F.when(F.col("l_suppkey") % 2 == 0, "service").alias("entry_type"), (F.col("l_linenumber") % 2 == 0).alias("has_configuration_url"),
            quote(F.col("l_linenumber").cast("string")).alias("version_sw"), F.when(F.col("l_suppkey") % 3 == 1, "None").when(F.col("l_suppkey") % 3 == 2, quote(F.lit("h"), (F.col("l_suppkey") % 7).cast("string"))).alias("version_hw"),
        )

    def _attribution_permutation(self):
        return self.raw("lineitem").select(F.col("l_orderkey").alias("submission_id"), _permutation_id().alias("permutation_id")).distinct()

    def _entity(self):
        rows = self.raw("lineitem").select("l_returnflag", "l_linestatus").distinct()
        return rows.select(F.concat("l_returnflag", "l_linestatus").alias("id"), F.col("l_linestatus").alias("domain"), F.lit(False).alias("assumed_state"), F.lit(True).alias("has_name"), F.lit(None).cast("string").alias("category"), F.col("l_returnflag").alias("original_device_class"), F.lit(None).cast("string").alias("unit_of_measurement"))

    def _sets(self):
        entity = F.concat("l_returnflag", "l_linestatus")
        return self.raw("lineitem").select("l_orderkey", "l_linenumber", _permutation_id().alias("permutation_id"), entity.alias("entity_id"), F.concat_ws("|", _permutation_id(), entity).alias("set_id"))

    def _entity_set(self):
        rows = self["sets"].select("set_id", "entity_id", "permutation_id").repartition("set_id").distinct()
        return rows.select(F.col("set_id").alias("id"), F.sha2("entity_id", 256).alias("hash"), "permutation_id")

    def _entity_set_content(self):
        return self["sets"].select("set_id", "entity_id").repartition("set_id").distinct()

    def _attribution_set(self):
        return self["sets"].select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_orderkey").alias("submission_id"), "set_id")

    def _link(self):
        return self["turns"].select(F.concat_ws("-", "parent_id", "child_id").alias("id"), "parent_id", "child_id")

    def _attribution_link(self):
        return self["turns"].select(F.col("conv_id").alias("submission_id"), F.concat_ws("-", "parent_id", "child_id").alias("link_id"))

    def _turns(self):
        name = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), n.cast("string"))
        turns = self.raw("conversations").select("conv_id", "turn").distinct()
        before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"))
        return turns.join(before, ["conv_id", "turn"], "left_semi").select("conv_id", name(F.col("turn") - 1).alias("parent_id"), name(F.col("turn")).alias("child_id"))

    def events(self):
        """The time series relation: a subject's events."""
        rows = self.raw("events").select(F.col("event_id").alias("id"), F.col("event_id").alias("submission_id"), F.col("user_id").alias("subject"), F.col("event_type").alias("version"), floor_second("ts").alias("created_at"))
        return {"attribution_submission": rows}

    def now(self) -> int:
        if self._now is None:
            self._now = self["attribution_submission"].agg(F.max("created_at")).first()[0]
        return self._now


def _permutation_id():
    return F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber")))
