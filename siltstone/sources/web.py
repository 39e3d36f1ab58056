"""A Spark data source for cursor-paged literature search, with bounded retries and pages that later attempts find again.

`spark.dataSource.register(Literature)`, then `spark.read.format("literature").options(query=..., most=...)`. A cursor's
pages follow one another, so one query is one task; cut by days of publication, it is a task for each part. The
transport is a parameter, so that everything but the network itself can be tested without one.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The service, statuses tried again, retries, and waits in seconds.
SERVICE = "https://www.ebi.ac.uk/europepmc/webservices/rest/search"
RETRYABLE, RETRIES, HEADER_CAP, BACKOFF_CAP, PAGE = (429, 500, 502, 503, 504), 5, 30.0, 20.0, 100
ROW = "pmcid string, title string, abstractText string, pubYear string, doi string, license string"
Answer = tuple[int, dict, bytes]


def fetched(url: str) -> Answer:
    try:
        with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


def wait_seconds(attempt: int, headers: dict | None) -> float:
    """What the service asks for, between 0 and HEADER_CAP, or else a doubling wait."""
    try:
        return min(HEADER_CAP, max(0.0, float((headers or {})["Retry-After"])))
    except (KeyError, ValueError):
        return min(float(2**attempt), BACKOFF_CAP)


def with_retries(url: str, fetch: Callable[[str], Answer], sleep: Callable[[float], None] = time.sleep, retries: int = RETRIES) -> bytes:
    """The body of a successful answer; transport errors and retryable statuses are tried again."""
    for attempt in range(retries + 1):
        try:
            status, headers, body = fetch(url)
        except OSError:
            if attempt == retries:
                raise
            sleep(wait_seconds(attempt, None))
            continue
        if status == 200:
            return body
        if status not in RETRYABLE or attempt == retries:
            raise OSError(f"{url}: status {status}")
        sleep(wait_seconds(attempt, headers))
    raise AssertionError


def pages(query: str, most: int, fetch: Callable[[str], Answer] = fetched, sleep: Callable[[float], None] = time.sleep, *, service: str = SERVICE, kept: Cursors | None = None) -> Iterator[dict]:
    """Results until there are `most`, a page is empty, or the cursor repeats. Pages that `kept` has aren't asked for again."""
    cursor, seen, found = "*", set(), 0
    while cursor not in seen:
        answer = kept.page(len(seen)) if kept else None
        if answer is None:
            args = urllib.parse.urlencode({"query": query, "format": "json", "resultType": "core", "pageSize": PAGE, "cursorMark": cursor})
            answer = json.loads(with_retries(f"{service}?{args}", fetch, sleep))
            if kept:
                kept.keep(len(seen), answer)
        seen.add(cursor)
        rows = answer.get("resultList", {}).get("result", [])
        if not rows:
            return
        for row in rows:
            yield row
            found += 1
            if found == most:
                return
        cursor = answer.get("nextCursorMark") or cursor


def hit_count(query: str, fetch: Callable[[str], Answer] = fetched, sleep: Callable[[float], None] = time.sleep, service: str = SERVICE) -> int:
    args = urllib.parse.urlencode({"query": query, "format": "json", "resultType": "idlist", "pageSize": 1, "cursorMark": "*"})
    return int(json.loads(with_retries(f"{service}?{args}", fetch, sleep)).get("hitCount") or 0)


def parts_of(query: str, first_year: int, last_year: int, most: int, count: Callable[[str], int]) -> list[str]:
    """The query cut into ranges of days of publication that have at most `most` hits each, and none without hits.

    Ranges are halved until they are small enough or a day, so there are about as many counts as parts.
    """
    out: list[str] = []
    todo = [(datetime.date(first_year, 1, 1), datetime.date(last_year, 12, 31))]
    while todo:
        start, end = todo.pop()
        own = f"({query}) AND FIRST_PDATE:[{start} TO {end}]"
        n = count(own)
        if n > most and start < end:
            middle = start + (end - start) // 2
            todo += [(middle + datetime.timedelta(days=1), end), (start, middle)]
        elif n:
            out.append(own)
    return out


class Literature(DataSource):
    """Options: query (several by line); most, results of each part; service. With first_year and last_year a query is cut
    by days of publication into parts of part_size hits, a partition each. With cursors, a shared folder, a part that
    fails is taken up again from the page it had come to."""

    @classmethod
    def name(cls) -> str:
        return "literature"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.queries, self.most = [q for q in options["query"].split("\n") if q.strip()], int(options.get("most", 1000))
        self.service, self.cursors = options.get("service", SERVICE), options.get("cursors")
        self.years = (int(options["first_year"]), int(options["last_year"])) if "first_year" in options else None
        self.part_size = int(options.get("part_size", 1000))

    def partitions(self) -> list[InputPartition]:
        if not self.years:
            return [InputPartition(q) for q in self.queries]
        count = lambda q: hit_count(q, service=self.service)
        return [InputPartition(p) for q in self.queries for p in parts_of(q, *self.years, self.part_size, count)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = [x.split()[0] for x in ROW.split(", ")]
        kept = Cursors(self.cursors, partition.value) if self.cursors else None
        for row in pages(partition.value, self.most, service=self.service, kept=kept):
            yield tuple(None if row.get(n) is None else str(row[n]) for n in names)


class Cursors:
    """The pages that a part has had, each a file of the shared folder by its number, so a new attempt asks only for the rest."""

    def __init__(self, folder: str, query: str):
        from siltstone.sources.remote import file_system

        self.system, root = file_system(folder)
        self.path = f"{root.rstrip('/')}/{hashlib.sha256(query.encode()).hexdigest()}"
        self.system.create_dir(self.path)

    def page(self, k: int) -> dict | None:
        try:
            with self.system.open_input_stream(f"{self.path}/{k:08d}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def keep(self, k: int, answer: dict) -> None:
        """Under another name first: a page is there whole or not at all."""
        staged = f"{self.path}/_{k:08d}-{uuid.uuid4().hex}"
        with self.system.open_output_stream(staged) as f:
            f.write(json.dumps(answer).encode())
        self.system.move(staged, f"{self.path}/{k:08d}.json")
