"""The device catalogue: devices of enough subjects with versions and entities.

One function per stage, so that each can be used and tested by itself; ``derived_device``
puts them together. Correlated lookups are aggregations that are joined once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ascii_ilike, ascii_lower, blank, has_version, unquoted
from ..storage import cut

# Integrations whose devices aren't listed.
BLOCKED_INTEGRATIONS = [
    "apple_tv", "braviatv", "epson", "home_connect", "homekit_controller", "hue_ble", "husqvarna_automower_ble", "insteon", "iotawatt", "isy944", "lg_netcast", "lg_thinq",
    "litterrobot", "neato", "phillips_js", "roborock", "roon", "samsungtv", "squeezebox", "system_bridge", "tplink_omada", "tuya", "unifiiprotect", "webmin", "xiaomi_miio",
]
# Words that stand for no manufacturer.
NO_MANUFACTURER = ["unknown", "unknown manufacturer", "undefined", "(unknown)", "?", "--"]
# Device classes that are shown; others become null.
DEVICE_CLASSES = [
    "absolute_humidity", "apparent_power", "aqi", "area", "atmospheric_pressure", "awning", "battery", "battery_charging", "blind", "blood_glucose_concentration", "button",
    "carbon_dioxide", "carbon_monoxide", "cold", "conductivity", "connectivity", "current", "curtain", "damper", "data_rate", "data_size", "date", "daylight", "dehumidifier",
    "distance", "door", "doorbell", "duration", "emitter", "energy", "energy_storage", "enum", "firmware", "frequency", "garage", "garage_door", "gas", "gate", "heat",
    "humidifier", "humidity", "identify", "illuminance", "input", "irradiance", "light", "lock", "min", "moisture", "monetary", "motion", "moving", "nitrogen_dioxide",
    "occupancy", "opening", "outlet", "output", "ozone", "ph", "plug", "pm1", "pm10", "pm25", "pm4", "power", "power_factor", "precipitation", "precipitation_intensity",
    "presence", "pressure", "reactive_energy", "reactive_power", "receiver", "restart", "running", "sabotage", "safety", "shade", "shutter", "signal_strength", "sirene",
    "smoke", "sound", "sound_pressure", "speaker", "speed", "sulphur_dioxide", "switch", "tamper", "temperature", "temperature_delta", "timestamp", "tv", "update", "uptime",
    "vibration", "volatile_organic_compounds", "volatile_organic_compounds_parts", "voltage", "volume", "volume_flow_rate", "volume_storage", "water", "weight",
    "wind_direction", "wind_speed", "window",
]


@dataclass(frozen=True)
class DeviceRules:
    blocked_integrations: list[str] = field(default_factory=lambda: list(BLOCKED_INTEGRATIONS))
    no_manufacturer: list[str] = field(default_factory=lambda: list(NO_MANUFACTURER))
    #: In these patterns _ is any character and ASCII case doesn't matter.
    manufacturer_unlike: str = "_T%"
    model_unlike: str = "% Tracked device"
    least_subjects: int = 5
    device_classes: list[str] = field(default_factory=lambda: list(DEVICE_CLASSES))


Tables = Mapping[str, DataFrame]


def attributions(t: Tables, subjects: DataFrame) -> DataFrame:
    """Distinct (submission_id, subject) of active subjects."""
    return t["attribution_submission"].join(subjects.select("subject"), "subject", "left_semi").select("submission_id", "subject").distinct()


def filtered_devices(t: Tables, rules: DeviceRules) -> DataFrame:
    """Three-valued: a null model fails the last condition and so its device goes."""
    named = ~blank("manufacturer") & ~ascii_lower("manufacturer").isin(rules.no_manufacturer) & ~ascii_ilike("manufacturer", rules.manufacturer_unlike)
    modelled = ~(blank("model") & blank("model_id")) & ~ascii_ilike("model", rules.model_unlike)
    return t["device"].where(~F.col("integration").isin(rules.blocked_integrations) & named & modelled)


def counted_devices(t: Tables, attributed: DataFrame, filtered: DataFrame, rules: DeviceRules) -> DataFrame:
    """device_id, count: distinct subjects, where there are enough of them."""
    of_devices = t["attribution_device"].join(filtered.select(F.col("id").alias("device_id")), "device_id", "left_semi")
    return attributed.join(of_devices, "submission_id").groupBy("device_id").agg(F.countDistinct("subject").alias("count")).where(F.col("count") >= rules.least_subjects)


def latest_popularity(t: Tables, subjects: DataFrame) -> DataFrame:
    """submission_id, count: how many active subjects have it as their latest submission. Of
    several at the same second the largest id is the latest."""
    latest = t["attribution_submission"].groupBy("subject").agg(F.max_by("submission_id", F.struct("created_at", "submission_id")).alias("submission_id"))
    return latest.join(subjects.select("subject"), "subject", "left_semi").groupBy("submission_id").agg(F.count(F.lit(1)).alias("count"))


def active_permutations(t: Tables, popularity: DataFrame, permutations: DataFrame) -> DataFrame:
    """permutation_id, count: subjects whose latest submission has the permutation."""
    own = t["attribution_permutation"].join(permutations.select(F.col("id").alias("permutation_id")), "permutation_id", "left_semi")
    return popularity.join(own, "submission_id").groupBy("permutation_id").agg(F.sum("count").alias("count"))


def dated_submissions(t: Tables, attributed: DataFrame) -> DataFrame:
    """submission_id, created_at of attributed, completed submissions."""
    done = t["submission"].where(F.col("completed_at").isNotNull()).select(F.col("id").alias("submission_id"), "created_at")
    return done.join(attributed.select("submission_id").distinct(), "submission_id", "left_semi")


def first_encountered(t: Tables, dated: DataFrame, devices: DataFrame) -> DataFrame:
    """device_id, first_encountered_at."""
    own = t["attribution_device"].join(devices.select("device_id"), "device_id", "left_semi")
    return own.join(dated, "submission_id").groupBy("device_id").agg(F.min("created_at").alias("first_encountered_at"))


def permutation_dates(t: Tables, dated: DataFrame, permutations: DataFrame) -> DataFrame:
    own = t["attribution_permutation"].join(permutations.select(F.col("id").alias("permutation_id")), "permutation_id", "left_semi")
    return own.join(dated, "submission_id").groupBy("permutation_id").agg(F.min("created_at").alias("seen_at"))


def versions(permutations: DataFrame, dates: DataFrame, column: str, active: DataFrame | None = None) -> DataFrame:
    """device_id, version, (active,) first_encountered_at, one row per unquoted version; with
    ``active``, versions that no latest submission has are left out."""
    rows = permutations.where(has_version(column)).select(F.col("id").alias("permutation_id"), "device_id", unquoted(column).alias("version")).join(dates, "permutation_id", "left")
    seen = F.min("seen_at").alias("first_encountered_at")
    if active is None:
        out = rows.groupBy("device_id", "version").agg(seen)
    else:
        out = rows.join(active.select("permutation_id", F.col("count").alias("n")), "permutation_id", "left").groupBy("device_id", "version").agg(F.sum("n").alias("active"), seen).where(F.col("active").isNotNull())
    return out.where(F.col("first_encountered_at").isNotNull())


def device_entities(t: Tables, attributed: DataFrame, permutations: DataFrame, rules: DeviceRules) -> DataFrame:
    """device_id, domain, original_device_class: distinct entities of the devices' attributed sets."""
    used = t["attribution_set"].join(attributed.select("submission_id").distinct(), "submission_id", "left_semi").select(F.col("set_id").alias("id"))
    sets = t["entity_set"].join(used, "id", "left_semi").join(permutations.select(F.col("id").alias("permutation_id"), "device_id"), "permutation_id")
    members = sets.select(F.col("id").alias("set_id"), "device_id").join(t["entity_set_content"], "set_id").select("device_id", F.col("entity_id").alias("id")).distinct()
    shown = F.when(F.col("original_device_class").isin(rules.device_classes), F.col("original_device_class"))
    return members.join(t["entity"], "id").select("device_id", "domain", shown.alias("original_device_class")).distinct()


def gathered(rows: DataFrame, name: str, *fields: str) -> DataFrame:
    """device_id and a sorted array of structs; a device has few versions and entities."""
    return rows.groupBy("device_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def derived_device(t: Tables, subjects: DataFrame, rules: DeviceRules = DeviceRules(), shared: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """One row per device of enough subjects; arrays are empty, never null. ``shared`` is applied
    to the stages that several others read; by default they are checkpointed, so each is
    computed once and survives lost executors."""
    attributed = shared(attributions(t, subjects))
    counted = shared(counted_devices(t, attributed, filtered_devices(t, rules), rules))
    permutations = shared(t["permutation"].join(counted.select("device_id"), "device_id", "left_semi"))
    dated = shared(dated_submissions(t, attributed))
    dates = permutation_dates(t, dated, permutations)
    active = active_permutations(t, latest_popularity(t, subjects), permutations)
    software = gathered(versions(permutations, dates, "version_sw", active), "versions_software", "version", "active", "first_encountered_at")
    hardware = gathered(versions(permutations, dates, "version_hw"), "versions_hardware", "version", "first_encountered_at")
    entities = gathered(device_entities(t, attributed, permutations, rules), "entities", "domain", "original_device_class")
    out = counted.join(t["device"].withColumnRenamed("id", "device_id"), "device_id").join(first_encountered(t, dated, counted), "device_id", "left")
    for arrays in (software, hardware, entities):
        out = out.join(arrays, "device_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select(F.col("device_id").alias("id"), "integration", "manufacturer", "model", "model_id", "first_encountered_at", empty("versions_software"), empty("versions_hardware"), empty("entities"), "count")
