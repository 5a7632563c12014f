"""Filtered, searched, counted, paginated and faceted reads of the device catalogue."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import contains_term
from .categories import integrations_of, rollup

DEFAULT_SIZE, LEAST_SIZE, MOST_SIZE = 20, 10, 50


@dataclass(frozen=True)
class DeviceFilter:
    """None doesn't filter; an empty list to include matches nothing."""

    term: str | None = None
    include_manufacturers: list[str] | None = None
    exclude_manufacturers: list[str] | None = None
    include_integrations: list[str] | None = None
    exclude_integrations: list[str] | None = None

    def column(self) -> Column:
        out = F.lit(True)
        for name, include, exclude in (("manufacturer", self.include_manufacturers, self.exclude_manufacturers), ("integration", self.include_integrations, self.exclude_integrations)):
            if include is not None:
                out = out & F.col(name).isin(include)
            if exclude is not None:
                out = out & ~F.col(name).isin(exclude)
        search = F.lit(False)
        for name in ("manufacturer", "model", "model_id"):
            search = search | F.coalesce(contains_term(name, self.term), F.lit(False))
        return out & search


def _union(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    return None if a is None and b is None else sorted({*(a or []), *(b or [])})


def resolved(device_filter: DeviceFilter, tree: DataFrame, dimension: DataFrame, include_categories=None, include_connectivity=None, exclude_categories=None, exclude_connectivity=None) -> DeviceFilter:
    """Categories and connectivities become integrations. Both together mean integrations of
    both, for exclusion as well."""
    inc = integrations_of(include_categories, include_connectivity, tree, dimension)
    exc = integrations_of(exclude_categories, exclude_connectivity, tree, dimension)
    return DeviceFilter(device_filter.term, device_filter.include_manufacturers, device_filter.exclude_manufacturers, _union(device_filter.include_integrations, inc), _union(device_filter.exclude_integrations, exc))


def devices(catalogue: DataFrame, device_filter: DeviceFilter = DeviceFilter(), limit: int | None = None, offset: int | None = None) -> DataFrame:
    """The most common first; the id breaks ties. Negative limits don't limit."""
    out = catalogue.where(device_filter.column()).orderBy(F.desc("count"), "id")
    out = out.offset(offset) if offset else out
    return out if limit is None or limit < 0 else out.limit(limit)


def device(catalogue: DataFrame, device_id) -> DataFrame:
    return catalogue.where(F.col("id") == device_id)


def devices_count(catalogue: DataFrame, device_filter: DeviceFilter = DeviceFilter()) -> DataFrame:
    return catalogue.where(device_filter.column()).agg(F.count(F.lit(1)).alias("count"))


def facets(catalogue: DataFrame, device_filter: DeviceFilter = DeviceFilter()) -> DataFrame:
    """manufacturer, integration, count of devices."""
    return catalogue.where(device_filter.column()).groupBy("manufacturer", "integration").agg(F.count(F.lit(1)).alias("count"))


def dimensions(counts: DataFrame, dimension: DataFrame, tree: DataFrame) -> DataFrame:
    """facet, value, count from ``facets``: manufacturers, integrations, connectivities and
    categories with all that is below them, the largest of each first."""
    n = F.sum("count").cast("long").alias("count")
    of = lambda rows, name: rows.select(F.lit(name).alias("facet"), F.col(name).alias("value"), "count")
    per_integration = counts.groupBy("integration").agg(n)
    known = per_integration.join(dimension, "integration")
    membership = dimension.select("integration", F.explode("categories").alias("category"))
    out = of(counts.groupBy("manufacturer").agg(n), "manufacturer").unionByName(of(per_integration, "integration"))
    out = out.unionByName(of(known.where(F.col("connectivity").isNotNull()).groupBy("connectivity").agg(n), "connectivity"))
    return out.unionByName(of(rollup(per_integration, membership, tree), "category")).orderBy("facet", F.desc("count"), "value")


def enriched(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """title, categories and connectivity of each device's integration; rows that can't be shown
    (never encountered) are left out."""
    own = dimension.select("integration", "title", "categories", "connectivity")
    return rows.where(F.col("first_encountered_at").isNotNull()).join(own, "integration", "left")


@dataclass(frozen=True)
class Page:
    rows: list
    total: int
    content_range: str
    links: dict[str, str]


def paginate(df: DataFrame, page: int = 0, size: int = DEFAULT_SIZE, url: str = "", parameters: dict | None = None) -> Page:
    """Page ``page`` (from 0) of an ordered frame; rows are read only if there are any."""
    if page < 0 or not LEAST_SIZE <= size <= MOST_SIZE:
        raise ValueError(f"page from 0, size from {LEAST_SIZE} to {MOST_SIZE}")
    total = df.count()
    rows = df.offset(page * size).limit(size).collect() if total > page * size else []
    last = max(0, -(-total // size) - 1)
    at = {"first": 0, "last": last} | ({"prev": min(page - 1, last)} if page else {}) | ({"next": page + 1} if page < last else {})
    links = {rel: f"{url}?{urlencode({**(parameters or {}), 'page': n, 'size': size})}" for rel, n in at.items()}
    span = f"{page * size}-{page * size + len(rows) - 1}" if rows else "*"
    return Page(rows, total, f"items {span}/{total}", links)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text per row, null fields included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("body"))
