"""Paged results of a bibliographic service, replayed from JSON pages; a page is a partition."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class PagedJson(DataSource):
    """``spark.read.format("paged_json").schema(...).option("path", folder).load()``: rows of the list ``results`` of each page.

    Option ``field`` names another list, ``most`` takes so many pages in the order of their names.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "id string, title string"

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(schema, self.options)


class PagedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.field, self.most = options.get("field", "results"), int(options.get("most", "0"))

    def partitions(self) -> list[PagePartition]:
        import pyarrow.fs as fs

        system, root = fs.FileSystem.from_uri(self.path)
        pages = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".json"))
        return [PagePartition(p) for p in (pages[: self.most] if self.most else pages)]

    def read(self, partition: PagePartition) -> Iterator[tuple]:
        import pyarrow.fs as fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_stream(partition.path) as stream:
            page = json.loads(stream.readall())
        for record in page.get(self.field, []):
            yield tuple(record.get(f.name) for f in self.schema.fields)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
