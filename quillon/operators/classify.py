"""Classification of integrations from their front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import connectivity

# Spellings of categories and what they are brought to, in order.
REWRITE = {
    "3D printing": "3D Printing", "Binary sensor": "Binary Sensor", "Device tracker": "Device Tracker", "Lawn mower": "Lawn Mower", "Media player": "Media Player",
    "Postal service": "Postal Service", "To-do list": "To-do List", "Water heater": "Water Heater", "Water management": "Water Management",
    "Device automation": "Device Automation", "Date/Time": "Date", "Tag scanner": "Tag Scanner", "light": "Light", "Presence detection": "Presence Detection",
    "Media Source": "Media Player", "Media source": "Media Player", "Multimedia": "Media Player",
}
# Categories that don't help to classify.
IGNORED = [
    "Alarm Control Panel", "AI", "Automation", "Backup", "Device Automation", "Downloading", "Front end", "Geolocation", "History", "Image processing", "Mailbox",
    "Organization", "Postal Service", "Social", "Speech-to-text", "Tag Scanner", "Text-to-speech", "To-do List", "Transport", "Utility", "Voice", "Calendar",
    "Finance", "Helper", "Notifications", "System monitor", "Radio Frequency", "Binary Sensor", "Button", "Date", "Hub", "Intent", "Number", "Other", "Scene",
    "Sensor", "Switch", "Text", "Time", "Update", "Select",
]
# Sets of categories that name a class, the first match wins.
PATTERNS: list[tuple[list[str], str]] = [
    (["3D Printing"], "3d-printer"), (["Camera"], "camera"), (["Car"], "car"), (["Climate"], "climate-control"), (["Cover"], "cover"), (["Device Tracker"], "device-tracker"),
    (["Presence Detection"], "motion-and-presence-sensor"), (["Doorbell"], "doorbell"), (["Energy"], "power-and-energy"), (["Fan"], "fan"), (["Humidifier"], "humidifier"),
    (["Irrigation"], "irrigation"), (["Lawn Mower"], "lawn-mower"), (["Light"], "lighting"), (["Media Player"], "entertainment"), (["Media Player", "Remote"], "entertainment"),
    (["Network"], "networking"), (["Plug"], "plug-and-outlet"), (["Siren"], "alarm-and-siren"), (["Vacuum"], "vacuum"), (["Water Heater"], "water-heater"),
    (["Water Management"], "water-management"), (["Weather"], "weather"), (["Alarm"], "alarm-and-siren"), (["Alarm", "Lock"], "security-and-access-control"),
]
# Fixed value: a link's target in the documents' markup.
LINK = r"\[[^\]]*\]\((https?://[^)\s]+)"


def canonical(categories: Column, rewrite: dict[str, str] = REWRITE, ignored: list[str] = IGNORED) -> Column:
    """Distinct, rewritten, without those that are ignored."""
    spelling = F.create_map(*(F.lit(x) for pair in rewrite.items() for x in pair))
    same = F.transform(categories, lambda c: F.coalesce(F.element_at(spelling, c), c))
    return F.array_except(F.array_distinct(same), F.array(*map(F.lit, ignored)))


def classified(categories: Column, patterns: list[tuple[list[str], str]] = PATTERNS) -> Column:
    """The class of the first pattern that is exactly this set; null if there is none."""
    ordered, out = F.array_sort(categories), F.lit(None).cast("string")
    for members, name in reversed(patterns):
        out = F.when(ordered == F.array(*map(F.lit, sorted(members))), F.lit(name)).otherwise(out)
    return out


def references(content: Column, pattern: str = LINK) -> Column:
    """Distinct targets of links, in the order of their first use."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)))


def front_field(front: Column, name: str) -> Column:
    """A scalar of simple front matter; quotes taken off."""
    raw = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*(.+?)[ \t]*$", 1)
    return F.nullif(F.regexp_replace(raw, "^([\"'])(.*)\\1$", "$2"), F.lit(""))


def front_list(front: Column, name: str) -> Column:
    """A block list of simple front matter; null if there is none."""
    block = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\r?\n((?:[ \t]*-[ \t]+.*(?:\r?\n|$))+)", 1)
    items = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]+[\"']?(.*?)[\"']?[ \t]*\r?$"), F.lit(1))
    return F.when(block != "", items)


def manifest(files: DataFrame, manual: dict[str, list[str]] | None = None, excluded: list[str] = (), excluded_types: list[str] = (), url: str = "integrations/") -> DataFrame:
    """``files``: name, front, content. One row per integration whose domain is its file's name:
    title, url, categories, classified, inferred, connectivity, aliases, references."""
    f = F.col("front")
    read = files.select("name", "content", front_field(f, "title").alias("title"), front_field(f, "ha_domain").alias("domain"), front_field(f, "ha_supporting_domain").alias("supporting"), front_field(f, "ha_integration_type").alias("kind"), front_field(f, "ha_iot_class").alias("iot"), front_list(f, "ha_category").alias("listed"))
    own = read.where(F.col("domain") == F.col("name"))
    alias = F.coalesce(F.col("supporting") != F.col("name"), F.lit(False))
    aliases = own.where(alias).groupBy(F.col("supporting").alias("name")).agg(F.array_sort(F.collect_set("name")).alias("aliases"))
    rows = own.where(~alias & F.col("title").isNotNull() & F.col("listed").isNotNull()).withColumn("categories", canonical(F.col("listed")))
    by_hand = F.element_at(F.create_map(*(x for k, v in manual.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("name")) if manual else F.lit(None).cast("array<string>")
    skip = F.col("name").isin(list(excluded)) | F.coalesce(F.col("kind").isin(list(excluded_types)), F.lit(False))
    found = F.when(skip, F.lit(None)).otherwise(F.coalesce(by_hand, F.when(classified(F.col("categories")).isNotNull(), F.array(classified(F.col("categories"))))))
    rows = rows.select("name", "title", F.concat(F.lit(url), "name").alias("url"), "categories", found.alias("classified"), F.when(~skip & by_hand.isNotNull(), False).when(found.isNotNull(), True).alias("inferred"), connectivity("iot").alias("connectivity"), references(F.col("content")).alias("references"))
    return rows.join(aliases, "name", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
