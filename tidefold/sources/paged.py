"""Paged listings as a source of their own: the pages of a listing, stored as the service answered them, read in batch or as a stream.

``write_pages`` stores a table as JSON responses (``sources.listings``), a file each, with an index of the least and the largest key on every page. The source reads a page a task, or, of many pages, a run of them. Conditions on the
key are pushed down to it: pages that cannot hold such a key are not opened; of many pages the tasks look into the index. As a stream, an offset is the number of pages that are there, so that pages that are added come once.

Register it with ``spark.dataSource.register(Listing)``; ``spark.sql.python.filterPushdown.enabled`` lets Spark hand conditions over.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidefold.sources.blobs import store
from tidefold.sources.listings import ITEMS

#: The key that each listing is paged by.
PAGED_BY = {"agents": "agent_id", "users": "id", "invites": "invite_id"}


def _system(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


def write_pages(df: DataFrame, name: str, root: str, page: str) -> int:
    """Store items (columns of the listing ``name``; moments as ISO texts) as pages: ``page`` numbers them from 0, in the order of the key. Gives how many there are. A page is a group of Spark's, and its
    task writes its file."""
    field, item = ITEMS[name]
    columns = T.StructType.fromDDL(item).names
    key = PAGED_BY[name]
    items = F.struct(*(F.col(c) for c in columns))
    # the key first, to sort a page by it
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), items.alias("i")))), lambda x: x["i"])
    pages = df.groupBy(F.col(page).alias("page")).agg(listed.alias(field), F.min(key).alias("least"), F.max(key).alias("most"))
    name_of = F.concat(F.lit("page-"), F.lpad(F.col("page").cast("string"), 9, "0"))
    file = lambda kind, *columns: F.struct(F.concat(name_of, F.lit(kind)).alias("path"), F.to_json(F.struct(*columns)).cast("binary").alias("content"))
    both = pages.select(F.explode(F.array(file(".json", field), file(".key", "least", "most"))).alias("f")).select("f.*")
    written = store(both, root).filter(F.col("path").endswith(".json"))
    return written.count()


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Listing)


#: So many pages at most have a task each, and are held against pushed conditions before there are tasks.
SINGLE = 64
#: So many tasks read more of them.
TASKS = 256


@dataclass
class Pages(InputPartition):
    files: list[str]


def runs(files: list[str]) -> list[Pages]:
    """Pages for tasks, in their order."""
    n = len(files) if len(files) <= SINGLE else min(TASKS, -(-len(files) // 16))
    return [Pages(files[len(files) * k // n : len(files) * (k + 1) // n]) for k in range(n)]


class Listing(DataSource):
    """Options: ``path`` of the pages, ``listing`` (agents, users or invites)."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return ITEMS[self.options["listing"]][1].replace("_at string", "_at timestamp")

    def reader(self, schema: T.StructType) -> ListingReader:
        return ListingReader(self.options["path"], self.options["listing"], schema)

    def streamReader(self, schema: T.StructType) -> ListingStream:  # noqa: N802
        return ListingStream(self.options["path"], self.options["listing"], schema)


def _moment(text: object) -> datetime | None:
    try:
        return datetime.fromisoformat(text) if isinstance(text, str) else None
    except ValueError:
        return None


class _Pages:
    def __init__(self, root: str, listing: str, schema: T.StructType):
        self.root, self.field, self.key = root, ITEMS[listing][0], PAGED_BY[listing]
        self.columns = [(f.name, isinstance(f.dataType, T.TimestampType)) for f in schema]

    def files(self, kind: str) -> list[str]:
        system, base = _system(self.root)
        found = system.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return sorted(x.base_name for x in found if x.is_file and x.base_name.startswith("page-") and x.base_name.endswith(kind))

    def text(self, file: str) -> str:
        system, base = _system(self.root)
        with system.open_input_stream(f"{base}/{file}") as f:
            return f.read().decode()

    def rows(self, file: str) -> Iterator[tuple]:
        """The items of a page; a page that is no JSON has none, and a moment that is none is null."""
        try:
            items = json.loads(self.text(file)).get(self.field) or []
        except (ValueError, AttributeError):
            return
        for item in items:
            yield tuple(_moment(item.get(c)) if timed else item.get(c) for c, timed in self.columns)


class ListingReader(DataSourceReader, _Pages):
    def __init__(self, root: str, listing: str, schema: T.StructType):
        _Pages.__init__(self, root, listing, schema)
        self.wanted: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes conditions on the key as far as pages go, and hands all back: rows of a page that is opened are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == (self.key,):
                self.wanted.append((type(f), f.value))
            yield f

    def _may_hold(self, least: object, most: object) -> bool:
        tests = {
            EqualTo: lambda v: least <= v <= most, In: lambda v: any(least <= x <= most for x in v if x is not None), GreaterThan: lambda v: most > v, GreaterThanOrEqual: lambda v: most >= v,
            LessThan: lambda v: least < v, LessThanOrEqual: lambda v: least <= v,
        }
        return all(v is not None and tests[kind](v) for kind, v in self.wanted)

    def _wanted(self, file: str) -> bool:
        """Whether the page may hold what is asked for; one without an index may."""
        try:
            ends = json.loads(self.text(f"{file[:-5]}.key"))
        except FileNotFoundError:
            return True
        return "least" in ends and self._may_hold(ends["least"], ends["most"])

    def partitions(self) -> list[Pages]:
        kept = self.files(".json")
        if self.wanted and len(kept) <= SINGLE:
            kept = [f for f in kept if self._wanted(f)]
        return runs(kept) or [Pages([])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for file in partition.files:
            if not self.wanted or self._wanted(file):
                yield from self.rows(file)


class ListingStream(DataSourceStreamReader, _Pages):
    def __init__(self, root: str, listing: str, schema: T.StructType):
        _Pages.__init__(self, root, listing, schema)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"pages": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"pages": len(self.files(".json"))}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return runs(self.files(".json")[start["pages"] : end["pages"]])

    def read(self, partition: Pages) -> Iterator[tuple]:
        for file in partition.files:
            yield from self.rows(file)

    def commit(self, end: dict) -> None:
        pass
