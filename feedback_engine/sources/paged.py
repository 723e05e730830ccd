"""Paged sources as a Spark data source, in batches and as a stream.

A page comes from a fetcher(cursor) -> (records, next cursor). The registered
source reads pages kept as JSON files, <folder>/<language>/<n>.json: a list of
records, or an object {"reviews": [...], "cursor": ..., "query_summary": {...}}.
Any file system that pyarrow knows by its URI can hold the folder, which driver
and executors must share; a network fetcher is a subclass of Pages away and never
runs at query time here.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").load(folder)                          # every record once a language
    spark.read.format("paged").option("what", "totals").load(folder)  # what the first pages say
    spark.readStream.format("paged").load(folder)                    # pages that are new since the offset

The stream's offset is {language: cursor}: the next page to read. A batch is read
again from its offsets alone, so a replay gives the same rows; partitions are
(language, run of pages), so a language with many pages is divided. Pages may
overlap; streaming.incremental.once_each drops ids that were seen.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RECORD = "id string, language string, text string, created long"
TOTALS = "language string, total long, positive long, negative long"


def paged(fetch: Callable[[str], tuple[list[dict], str | None]], most: int | None = None, retries: int = 5, wait: float = 0.0) -> Iterator[dict]:
    """Records page by page until a page is empty or brings nothing new, there is no next cursor, or `most` are read. Failing pages are tried again."""
    seen: set[str] = set()
    cursor: str | None = "*"
    while cursor is not None:
        records, following = tried(fetch, cursor, retries, wait)
        new = [r for r in records if str(r["id"]) not in seen]
        if not new:
            return
        for r in new:
            if str(r["id"]) in seen:
                continue
            seen.add(str(r["id"]))
            yield r
            if most is not None and len(seen) >= most:
                return
        cursor = following


def tried(fetch: Callable[[str], tuple], cursor: str, retries: int = 5, wait: float = 0.0) -> tuple:
    for attempt in range(retries):
        try:
            return fetch(cursor)
        except OSError:
            if attempt == retries - 1:
                raise
            time.sleep(wait)
    raise ValueError("retries must be positive")


class Pages:
    """Pages in a folder. Cursors are page numbers as text; "*" is the first."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _names(self, folder: str = "") -> list[str]:
        from pyarrow import fs

        system, root = self._files()
        return [f.base_name for f in system.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/")))]

    def languages(self) -> list[str]:
        return sorted(self._names())

    def page(self, language: str, cursor: str) -> dict:
        """{"reviews", "cursor", "query_summary"} of a page; none of them beyond the last."""
        from pyarrow import fs

        n = 0 if cursor == "*" else int(cursor)
        system, root = self._files()
        path = f"{root}/{language}/{n}.json"
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return {}
        with system.open_input_stream(path) as f:
            found = json.loads(f.read())
        return {"reviews": found, "cursor": str(n + 1)} if isinstance(found, list) else {"cursor": str(n + 1)} | found

    def fetch(self, language: str, cursor: str) -> tuple[list[dict], str | None]:
        found = self.page(language, cursor)
        return found.get("reviews", []), found.get("cursor")

    def end(self, language: str) -> str:
        """The cursor after the last page that is there: pages without a gap."""
        have = {n for n in self._names(language) if n.endswith(".json")}
        n = 0
        while f"{n}.json" in have:
            n += 1
        return str(n)


def _row(record: dict, language: str) -> tuple:
    return str(record["id"]), language, record.get("text"), record.get("created")


class Language(InputPartition):
    def __init__(self, language: str) -> None:
        super().__init__(language)
        self.language = language


class PageReader(DataSourceReader):
    """Every record of each language once, a partition for each."""

    def __init__(self, options: dict[str, str]) -> None:
        self.pages, self.most = Pages(options["path"]), int(options["limit"]) if "limit" in options else None

    def partitions(self) -> list[InputPartition]:
        return [Language(x) for x in self.pages.languages()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for r in paged(lambda cursor: self.pages.fetch(partition.language, cursor), self.most):
            yield _row(r, partition.language)


class TotalsReader(PageReader):
    """What each language's first page says of all of them."""

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        summary = tried(lambda cursor: (self.pages.page(partition.language, cursor),), "*")[0].get("query_summary") or {}
        yield (partition.language, *(summary.get(f"total_{x}") for x in ("reviews", "positive", "negative")))


class Run(InputPartition):
    """Pages of a language from one cursor up to another."""

    def __init__(self, language: str, start: str, end: str) -> None:
        super().__init__((language, start, end))
        self.language, self.start, self.end = language, start, end


class PageStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.pages, self.run = Pages(options["path"]), int(options.get("pagesPerPartition", 100))

    def initialOffset(self) -> dict:
        return {}  # languages are found as they appear

    def latestOffset(self) -> dict:
        return {x: self.pages.end(x) for x in self.pages.languages()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        spans = [(x, int(start.get(x, 0)), int(stop)) for x, stop in sorted(end.items())]
        return [Run(x, str(a), str(min(a + self.run, b))) for x, low, b in spans for a in range(low, b, self.run)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        seen: set[str] = set()
        cursor: str | None = partition.start
        while cursor is not None and cursor != partition.end:
            records, cursor = tried(lambda c: self.pages.fetch(partition.language, c), cursor)
            for r in records:
                if str(r["id"]) not in seen:
                    seen.add(str(r["id"]))
                    yield _row(r, partition.language)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return TOTALS if self.options.get("what") == "totals" else RECORD

    def reader(self, schema) -> PageReader:
        return (TotalsReader if self.options.get("what") == "totals" else PageReader)(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)
