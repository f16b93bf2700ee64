"""Discovery pages and entities of a remote knowledge base as Spark data sources.

Nothing is fetched unless a ``transport`` is given: a picklable function from a URL and
its parameters to decoded JSON.  ``Paced`` wraps one with intervals and retries.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

QID = re.compile(r"Q[1-9][0-9]*")
RETRIED = (429, 500, 502, 503, 504)
PAGE_LIMIT = 1000
ENTITY_LIMIT = 50

# The parameters of an entity request besides its ids.
ENTITY_PARAMS = {
    "action": "wbgetentities",
    "format": "json",
    "formatversion": "2",
    "props": "labels|descriptions|aliases|claims",
    "languages": "en|vi",
    "languagefallback": "0",
    "maxlag": "5",
}

Transport = Callable[[str, dict], dict]


class HttpStatus(Exception):
    """An answer that is no success, with the server's wish to wait."""

    def __init__(self, code: int, retry_after: float | None = None):
        super().__init__(f"HTTP {code}")
        self.code, self.retry_after = code, retry_after


class Paced:
    """A transport that keeps ``least`` seconds between requests and repeats busy answers, network and decoding errors.

    Other statuses fail at once.  A wait the server asks for is kept, else waits double up to half a minute.
    """

    def __init__(self, get: Transport, attempts: int = 5, least: float = 0.0, sleep: Callable[[float], None] = time.sleep,
                 clock: Callable[[], float] = time.monotonic):
        if attempts < 1 or least < 0:
            raise ValueError("attempts must be positive and the interval not negative")
        self.get, self.attempts, self.least, self.sleep, self.clock = get, attempts, least, sleep, clock
        self.free_at = float("-inf")

    def _once(self, url: str, params: dict) -> tuple[dict | None, Exception | None, float | None]:
        """An answer, or what went wrong and how long the server wants to be left alone."""
        early = self.free_at - self.clock()
        if early > 0:
            self.sleep(early)
        try:
            answer = self.get(url, params)
        except HttpStatus as e:
            if e.code not in RETRIED:
                raise
            return None, e, e.retry_after
        except (OSError, ValueError) as e:
            return None, e, None
        finally:
            self.free_at = self.clock() + self.least
        if not isinstance(answer, dict):
            return None, ValueError("no JSON object"), None
        lagging = (answer.get("error") or {}).get("code") == "maxlag"
        return (None, RuntimeError("server lag"), None) if lagging else (answer, None, None)

    def __call__(self, url: str, params: dict) -> dict:
        problem: Exception | None = None
        for wait in [*(min(30.0, 2.0**n) for n in range(self.attempts - 1)), None]:
            answer, problem, asked = self._once(url, params)
            if answer is not None:
                return answer
            if wait is not None:
                self.sleep(max(self.least, wait if asked is None else asked))
        raise RuntimeError(f"request failed after {self.attempts} attempts: {problem}") from problem


def page_query(seed: str, offset: int, limit: int) -> str:
    """The query for one page of a class's items, in their order."""
    if not QID.fullmatch(seed):
        raise ValueError(f"invalid seed id: {seed}")
    if offset < 0 or not 1 <= limit <= PAGE_LIMIT:
        raise ValueError(f"offset must not be negative, limit in 1..{PAGE_LIMIT}")
    return f"SELECT ?item WHERE {{ ?item wdt:P31 wd:{seed} . }} ORDER BY ?item LIMIT {limit} OFFSET {offset}"


def listed(pages: DataFrame) -> DataFrame:
    """``seed_qid, page_offset, item_pos, qid``: the valid ids of the answers in ``body``, in their order."""
    body = F.from_json("body", "results struct<bindings: array<struct<item: struct<value: string>>>>")
    ids = F.transform(body["results"]["bindings"], lambda b: F.substring_index(b["item"]["value"], "/", -1))
    valid = F.filter(ids, lambda i: i.rlike(f"^{QID.pattern}$"))
    return pages.select("seed_qid", "page_offset", F.posexplode(valid).alias("item_pos", "qid"))


def in_order(ids: Column, body: Column) -> Column:
    """The entities of an answer, as JSON, in the order asked; ids that are missing are left out.

    ``entities`` of an answer is a list or a map by id.
    """
    as_list = F.from_json(body, "entities array<string>")["entities"]
    as_map = F.from_json(body, "entities map<string, string>")["entities"]

    def entity(i: Column) -> Column:
        return F.coalesce(F.try_element_at(F.filter(as_list, lambda e: F.get_json_object(e, "$.id") == i), F.lit(-1)), F.try_element_at(as_map, i))

    there = F.filter(F.transform(ids, entity), lambda e: e.isNotNull() & e.startswith("{"))
    return F.filter(there, lambda e: F.coalesce(F.get_json_object(e, "$.missing"), F.lit("false")) != "true")


class _Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


class DiscoverySource(DataSource):
    """``spark.dataSource.register(...)``, then ``format("discovery")`` with options seed, pages, page_size, endpoint.

    A row for each page, to be parsed with ``listed``.
    """

    transport: Transport | None = None

    @classmethod
    def name(cls) -> str:
        return "discovery"

    def schema(self) -> str:
        return "seed_qid string, page_offset bigint, body string"

    def reader(self, schema) -> DataSourceReader:
        if self.transport is None:
            raise ValueError("discovery is offline: subclass it with a transport")
        return _DiscoveryReader(self.options, type(self).transport)


class _DiscoveryReader(DataSourceReader):
    def __init__(self, options: dict, transport: Transport):
        self.seed = options["seed"]
        self.size = int(options.get("page_size", 500))
        self.count = int(options.get("pages", 1))
        self.start = int(options.get("offset", 0))
        self.endpoint = options.get("endpoint", "")
        self.transport = transport
        page_query(self.seed, self.start, self.size)

    def partitions(self) -> list[InputPartition]:
        return [_Page(self.start + i * self.size, self.size) for i in range(self.count)]

    def read(self, part: _Page) -> Iterator[tuple]:
        answer = self.transport(self.endpoint, {"query": page_query(self.seed, part.offset, part.limit), "format": "json"})
        yield self.seed, part.offset, json.dumps(answer, ensure_ascii=False)


def entity_body(ids: list[str], transport: Transport, endpoint: str) -> str:
    """The answer for up to ENTITY_LIMIT ids as JSON, to be parsed with ``in_order``."""
    if len(ids) > ENTITY_LIMIT or not all(QID.fullmatch(i) for i in ids):
        raise ValueError(f"at most {ENTITY_LIMIT} valid ids a request")
    return json.dumps(transport(endpoint, {**ENTITY_PARAMS, "ids": "|".join(ids)}), ensure_ascii=False) if ids else "{}"
