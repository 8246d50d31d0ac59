"""A paged API as a Spark data source: one partition a date window, pages fetched by the task that reads it.

The transport is any callable of (start, end, index) that returns a page as a dict; an HTTP client on a cluster, files or
literals in tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cinderfold.functions.text import clean_text, cve_year, english_or_first
from cinderfold.operators.corpus import cap, first_wins
from cinderfold.sources.files import atom_records

WINDOW_DAYS = 119
PAGE = 2000


def year_windows(first: int, last: int) -> list[tuple[str, str, int]]:
    """(start, end, year) of windows of at most 119 days that never cross a year's end."""
    out = []
    for year in range(first, last + 1):
        start = date(year, 1, 1)
        while start.year == year:
            end = min(start + timedelta(days=WINDOW_DAYS - 1), date(year, 12, 31))
            out.append((f"{start}T00:00:00.000", f"{end}T23:59:59.999", year))
            start = end + timedelta(days=1)
    return out


def window_number(day: Column) -> Column:
    """Which of its year's windows (from 0) a day falls into."""
    return F.floor((F.dayofyear(day) - 1) / WINDOW_DAYS).cast("int")


@dataclass
class DateWindow(InputPartition):
    start: str
    end: str
    year: int


class _Reader(DataSourceReader):
    def __init__(self, windows: list[tuple[str, str, int]], fetch: Callable[[str, str, int], dict]):
        self.windows, self.fetch = windows, fetch

    def partitions(self) -> list[DateWindow]:
        return [DateWindow(*w) for w in self.windows]

    def read(self, partition: DateWindow) -> Iterator[tuple]:
        index = 0
        while True:
            page = self.fetch(partition.start, partition.end, index)
            found = page.get("vulnerabilities", [])
            for i, v in enumerate(found):
                item = v.get("cve", {})
                yield (partition.year, partition.start, index + i, item.get("id"), [(d.get("lang"), d.get("value")) for d in item.get("descriptions", [])])
            index += len(found)
            if not found or index >= page.get("totalResults", 0):
                return


def paged_source(name: str, windows: list[tuple[str, str, int]], fetch: Callable[[str, str, int], dict]) -> type[DataSource]:
    """A data source class to register with spark.dataSource; a page that can't be fetched fails its task, which is retried."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "year int, window string, place int, id string, descriptions array<struct<lang: string, value: string>>"

        def reader(self, schema) -> _Reader:
            return _Reader(windows, fetch)

    return Paged


@dataclass
class Batch(InputPartition):
    start: int


class _Feed(DataSourceReader):
    def __init__(self, total: int, batch: int, fetch: Callable[[int, int], str]):
        self.total, self.batch, self.fetch = total, batch, fetch

    def partitions(self) -> list[Batch]:
        return [Batch(i) for i in range(0, self.total, self.batch)] or [Batch(0)]

    def read(self, partition: Batch) -> Iterator[tuple]:
        most = min(self.batch, self.total - partition.start)
        if most > 0:
            yield (partition.start, self.fetch(partition.start, most))


def feed_source(name: str, total: int, fetch: Callable[[int, int], str], batch: int = 200) -> type[DataSource]:
    """A data source of Atom pages, one partition a batch of entries: start, page. fetch(start, n) returns a feed."""

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "start int, page string"

        def reader(self, schema) -> _Feed:
            return _Feed(total, batch, fetch)

    return Feed


def read_feed(spark: SparkSession, name: str, least: int = 100) -> DataFrame:
    """Records of a registered feed source."""
    pages = spark.read.format(name).load()
    entries = pages.select(F.inline(F.from_xml("page", "entry array<struct<id: string, title: string, summary: string>>")["entry"]))
    return atom_records(entries, least)


def read_paged(spark: SparkSession, name: str, existing: DataFrame | None = None, least: int = 50, per_year: int | None = None) -> DataFrame:
    """Records of a registered source: English description if there is one, `least` characters once cleaned, first of
    each id; ids that are in `existing` are left out; at most per_year of each year of the id."""
    rows = spark.read.format(name).load().withColumn("text", clean_text(english_or_first(F.col("descriptions"))))
    rows = first_wins(rows.where(F.length("text") >= least).drop("descriptions"), ["id"], ["year", "window", "place"])
    if existing is not None:
        rows = rows.join(existing.select("id").distinct(), "id", "left_anti")
    rows = rows.withColumn("year", F.coalesce(cve_year(F.col("id")), F.col("year")))
    if per_year is not None:
        rows = cap(rows, "year", ["window", "place"], per_year).drop("rn")
    return rows.select("id", "text", F.lit("nvd").alias("source"), "year")


def with_fallback(primary: Callable[[], DataFrame], *others: Callable[[], DataFrame]) -> DataFrame:
    """The first source that can be planned and has a row."""
    for i, source in enumerate((primary, *others)):
        try:
            df = source()
            if i == len(others) or df.limit(1).count():
                return df
        except Exception:
            if i == len(others):
                raise
    raise AssertionError
