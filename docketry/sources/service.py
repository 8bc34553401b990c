"""Answers of a case-law service as rows: a data source with one request a key, in parallel, failures as rows of their own.

    spark.dataSource.register(ServiceSource)
    spark.read.format("docketry_service").option("keys", folder).option("base", "https://host/api").option("path", "/clusters/{key}/").load()

``keys`` is a folder of text files that all executors share, one key a line; every file is a partition, so only file names pass
through the driver.  A key is a JSON object where ``method`` is POST: its members are the form that is sent.  What was not found is
a failure of its own class, apart from requests that timed out, were turned away or gave what is no JSON.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docketry.tables import shared_dir

SCHEMA = "key string, status int, failure string, can_retry boolean, payload string, detail string"
#: Seconds a request may take, and characters of an error that are kept.
TIMEOUT, DETAIL = 45.0, 500
AGENT = "docketry"


def settings() -> dict[str, str]:
    """Options from the environment: DOCKETRY_BASE, DOCKETRY_TOKEN and DOCKETRY_TIMEOUT, those that are set."""
    found = {name: os.environ.get(f"DOCKETRY_{name.upper()}") for name in ("base", "token", "timeout")}
    return {k: v for k, v in found.items() if v}


class Client:
    """Sends requests; every outcome is a row."""

    def __init__(self, base: str, path: str, method: str = "GET", token: str | None = None, timeout: float = TIMEOUT, agent: str = AGENT):
        if not base:
            raise ValueError("the option base must name the service")
        if timeout <= 0:
            raise ValueError("the timeout must be positive")
        self.base, self.path, self.method, self.timeout = base.rstrip("/"), path, method.upper(), timeout
        self.headers = {"User-Agent": agent, "Accept": "application/json"} | ({"Authorization": f"Token {token}"} if token else {})

    def request(self, key: str) -> urllib.request.Request:
        if self.method == "POST":
            return urllib.request.Request(self.base + self.path, urllib.parse.urlencode(json.loads(key)).encode(), self.headers, method="POST")
        return urllib.request.Request(self.base + self.path.replace("{key}", urllib.parse.quote(key, safe="")), headers=self.headers)

    def fetch(self, key: str) -> tuple:
        """key, status, failure, can_retry, payload, detail."""
        try:
            with urllib.request.urlopen(self.request(key), timeout=self.timeout) as response:
                status, body = response.status or 200, response.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return self._failed(key, e.code, failure_of(e.code), e.read().decode("utf-8", "replace"))
        except TimeoutError as e:
            return self._failed(key, None, "timeout", str(e))
        except urllib.error.URLError as e:
            if isinstance(e.reason, FileNotFoundError):
                return self._failed(key, 404, "not_found", str(e.reason))
            return self._failed(key, None, "timeout" if isinstance(e.reason, TimeoutError) else "transport", str(e.reason))
        except (OSError, ValueError) as e:
            return self._failed(key, None, "transport", str(e))
        try:
            json.loads(body)
        except ValueError as e:
            return self._failed(key, status, "invalid_response", str(e))
        return key, status, None, None, body, None

    @staticmethod
    def _failed(key: str, status: int | None, failure: str, detail: str) -> tuple:
        return key, status, failure, failure in ("api_limit", "upstream_error", "timeout", "transport"), None, detail[:DETAIL]


def failure_of(status: int) -> str:
    if status == 429:
        return "api_limit"
    if status in (401, 403):
        return "authentication"
    return "not_found" if status == 404 else "request_rejected" if status < 500 else "upstream_error"


class Keys(InputPartition):
    def __init__(self, file: str):
        self.file = file


class ServiceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        if "keys" not in options:
            raise ValueError("the option keys must name a folder of keys")
        self.client()  # options that do not hold are found before a task starts

    def client(self) -> Client:
        o = self.options
        return Client(o.get("base", ""), o.get("path", "/{key}"), o.get("method", "GET"), o.get("token"), float(o.get("timeout", TIMEOUT)), o.get("agent", AGENT))

    def partitions(self) -> list[InputPartition]:
        folder = Path(urllib.parse.urlparse(self.options["keys"]).path if self.options["keys"].startswith("file:") else self.options["keys"])
        return [Keys(str(f)) for f in sorted(folder.iterdir()) if f.is_file() and f.name[0] not in "._"]

    def read(self, partition: Keys) -> Iterator[tuple]:
        client = self.client()
        with open(partition.file, encoding="utf-8") as f:
            for line in f:
                if key := line.rstrip("\n"):
                    yield client.fetch(key)


class ServiceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docketry_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ServiceReader(dict(self.options))


def responses(keys: DataFrame, parallel: int = 8, **options: str) -> DataFrame:
    """Rows of ``SCHEMA`` for the distinct keys of a one-column table, over ``parallel`` connections; ``options`` as in the module's
    text, :func:`settings` where they are not given."""
    spark = keys.sparkSession
    spark.dataSource.register(ServiceSource)
    folder = f"{shared_dir(spark)}/keys-{uuid.uuid4().hex}"
    keys.toDF("key").where("key IS NOT NULL").distinct().repartition(parallel).write.text(folder)
    reader = spark.read.format("docketry_service").option("keys", folder.removeprefix("file://"))
    for name, value in (settings() | options).items():
        reader = reader.option(name, value)
    return reader.load()
