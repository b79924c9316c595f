"""A paged source: format ``pages`` asks a fetch function for numbered pages, one partition per range of pages."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class PageRange(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class PagesReader(DataSourceReader):
    """Options: fetch ("module:function"), pages, step, and all others go to the function."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def _fetch(self) -> Callable[[int, dict], list | dict]:
        module, _, name = self.options["fetch"].partition(":")
        return getattr(importlib.import_module(module), name)

    def partitions(self) -> list[PageRange]:
        pages, step = int(self.options.get("pages", 1)), int(self.options.get("step", 10))
        return [PageRange(k, min(pages, k + step)) for k in range(0, pages, step)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        fetch = self._fetch()
        for page in range(partition.start, partition.stop):
            payload = fetch(page, self.options)
            yield page, json.dumps(payload, ensure_ascii=False)
            if not payload:
                return


class PagesDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page int, payload string"

    def reader(self, schema: StructType) -> PagesReader:
        return PagesReader(self.options)
