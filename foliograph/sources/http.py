"""A data source that fetches documents: ``spark.read.format("foliograph_http").option("urls", "http://a http://b").load()``.

Addresses are dealt over tasks; each row is what one address gave. A failed request is a row with an error, not a failed job.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "url string, status int, content_type string, disposition string, content binary, error string"


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "foliograph_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return HttpReader(self.options)


class HttpReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = options.get("urls", "").split()
        self.parts = max(1, min(int(options.get("partitions", "8")), len(self.urls) or 1))
        self.seconds, self.most = float(options.get("timeout", "30")), int(options.get("maxBytes", str(256 << 20)))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.urls[k :: self.parts]) for k in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url in partition.value:
            try:
                with urlopen(Request(url, headers={"Accept": "application/pdf,*/*"}), timeout=self.seconds) as answer:
                    body = answer.read(self.most + 1)
                    facts = answer.status, answer.headers.get("Content-Type"), answer.headers.get("Content-Disposition")
                    yield (url, *facts, body, None) if len(body) <= self.most else (url, *facts, None, "too large")
            except HTTPError as e:
                yield url, e.code, None, None, None, str(e.reason)
            except (URLError, OSError, ValueError) as e:
                yield url, None, None, None, None, str(getattr(e, "reason", e))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpSource)
