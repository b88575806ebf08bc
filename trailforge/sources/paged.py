"""Records from web services that answer in pages, as a data source for batch and stream reads."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "file string, page bigint, pos bigint, record string"


class _Pages:
    """One page at a time of a service: ``url`` with the query ``param`` = token; a page is a JSON object with a list at
    ``items`` and the next token at ``next`` (names joined by dots; missing, null and empty: the last page)."""

    def __init__(self, options) -> None:
        self.url, self.param = options["url"], options.get("param", "cursor")
        self.items, self.next = options.get("items", "items"), options.get("next", "next")
        self.retries, self.wait = int(options.get("retries", "3")), float(options.get("wait", "1"))
        self.timeout = float(options.get("timeout", "60"))
        self.headers = json.loads(options.get("headers", "{}"))

    @staticmethod
    def _at(data, dotted: str):
        for part in dotted.split("."):
            data = data.get(part) if isinstance(data, dict) else None
        return data

    def page(self, query: dict[str, str], token: str | None) -> tuple[list[str], str | None]:
        """(JSON texts of the records, next token). Refusals that may pass (429, 5xx, no connection) are tried again."""
        asked = query | ({self.param: token} if token else {})
        address = self.url + ("&" if "?" in self.url else "?") + urllib.parse.urlencode(asked) if asked else self.url
        for left in range(self.retries, -1, -1):
            try:
                with urllib.request.urlopen(urllib.request.Request(address, headers=self.headers), timeout=self.timeout) as answer:
                    data = json.loads(answer.read())
                break
            except urllib.error.HTTPError as e:
                if not left or not (e.code == 429 or e.code >= 500):
                    raise
            except (urllib.error.URLError, TimeoutError):
                if not left:
                    raise
            time.sleep(self.wait * 2 ** (self.retries - left))
        found = self._at(data, self.items)
        if found is not None and not isinstance(found, list):
            raise ValueError(f"no list at {self.items!r}")
        token = self._at(data, self.next)
        return [json.dumps(x) for x in found or []], str(token) if token not in (None, "") else None


class _Chain(InputPartition):
    def __init__(self, name: str, query: dict[str, str], token: str | None) -> None:
        self.name, self.query, self.token = name, query, token


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.pages, self.chains = _Pages(options), json.loads(options.get("chains", "{}")) or {"": {}}

    def partitions(self) -> list[InputPartition]:
        return [_Chain(name, {k: str(v) for k, v in query.items() if k != "token"}, query.get("token")) for name, query in self.chains.items()]

    def read(self, partition: _Chain) -> Iterator[tuple]:
        token, seen, number, pos = partition.token, set(), 0, 0
        while True:
            if token in seen:
                raise ValueError(f"pages of {partition.name!r} turn in a circle at token {token!r}")
            seen.add(token)
            records, token = self.pages.page(partition.query, token)
            for record in records:
                yield partition.name, number, pos, record
                pos += 1
            number += 1
            if token is None:
                return


class _StreamReader(SimpleDataSourceStreamReader):
    """A page of each chain a batch; an offset holds each chain's token, so a restart goes on from there. The last page's token stays until the
    service names a next one: that page is asked again, and its records beyond those already given come out."""

    def __init__(self, options) -> None:
        self.pages, self.chains = _Pages(options), json.loads(options.get("chains", "{}")) or {"": {}}

    def initialOffset(self) -> dict:
        return {name: {"token": query.get("token"), "page": 0, "given": 0, "pos": 0} for name, query in self.chains.items()}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, after = [], {}
        for name, at in start.items():
            query = {k: str(v) for k, v in self.chains[name].items() if k != "token"}
            records, token = self.pages.page(query, at["token"])
            new = records[at["given"] :]
            rows += [(name, at["page"], at["pos"] + i, record) for i, record in enumerate(new)]
            if token is not None and token == at["token"]:
                raise ValueError(f"pages of {name!r} turn in a circle at token {token!r}")
            stays = token is None
            after[name] = {"token": at["token"] if stays else token, "page": at["page"] + (not stays), "given": max(at["given"], len(records)) if stays else 0, "pos": at["pos"] + len(new)}
        return iter(rows), after

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The rows of a batch again: of each chain no more than it gave."""
        rows, _ = self.read(start)
        return iter([r for r in rows if r[2] < end[r[0]]["pos"]])


class PagedJson(DataSource):
    """``spark.read.format("paged_json")``: (file, page, pos, record), the JSON texts of a service's records, as adapters take them.

    Options: ``url``; ``chains``, a JSON object of names to query parameters (projects, log streams, spans of time), each walked by a
    task of its own from page to page, as a token is known only from the page before (``token`` among them: where to begin; default: one
    chain named ""); ``param``, ``items``, ``next``, ``headers`` (JSON), ``retries``, ``wait`` (seconds, doubled each time), ``timeout``.
    ``file`` is the chain's name, ``page`` and ``pos`` count from 0 in it. A token that comes again is an error. A page without records is
    passed; a chain without any has no rows. In a stream, ``pos`` goes on over restarts.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
