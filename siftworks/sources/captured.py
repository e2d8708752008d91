"""A store of captured pages as a Spark data source: `captured_payloads`.

The store is a folder, local or on any file system that pyarrow reads: <path>/<platform>/<day>/<board>/<page>.<ext>, names percent-encoded,
pages numbered from 0. Each board of a day is a partition of its own, so a board that can't be read leaves the others whole. Pages
are read in order up to where the platform's rule says that a live reader would have stopped.

    spark.dataSource.register(CapturedPayloads)
    spark.read.format("captured_payloads").option("rules", "kinds as JSON, platform to rule").load(path)
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "platform string, day string, board string, page int, payload string, error string"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path.rstrip("/"))


# --- when a reader of pages stops ------------------------------------------------------------------------------------

#: The most pages of a board, the postings of a page, and how many are posted in an hour.
MOST_PAGES = {"cursor": 60, "token": 20, "new_links": 40}
PER_PAGE, PER_HOUR, LEAST_PAGES, GAP_PAGES = 20, 100, 50, 1300


def pages_for_gap(hours: float) -> int:
    """Pages that hold what came in the hours since the last scan, and half as much again, within bounds."""
    return max(LEAST_PAGES, min(GAP_PAGES, -(-int(hours * PER_HOUR * 1.5) // PER_PAGE)))


def _cursor() -> Callable[[int, str], bool]:
    """On while the page names a next cursor behind which there are items."""

    def more(page: int, payload: str) -> bool:
        following = (json.loads(payload).get("meta") or {}).get("next") or {}
        return following.get("cursor") is not None and bool(following.get("itemsCount")) and page + 1 < MOST_PAGES["cursor"]

    return more


def _offset(hours: float = 24.0) -> Callable[[int, str], bool]:
    """On while pages hold jobs, as many pages as the gap since the last scan asks for."""
    most = pages_for_gap(hours)
    return lambda page, payload: bool(json.loads(payload).get("jobs")) and page + 1 < most


def _token() -> Callable[[int, str], bool]:
    """On while the page carries a token of the next one."""
    return lambda page, payload: bool(json.loads(payload).get("nextPage")) and page + 1 < MOST_PAGES["token"]


def _new_links(href: str) -> Callable[[int, str], bool]:
    """On while a page holds links of postings, at least one of them not seen on an earlier page."""
    seen: set[str] = set()
    link = re.compile(rf'\bhref="((?:https?://[^/"]+)?{href})(?:\?[^"]*)?"')

    def more(page: int, payload: str) -> bool:
        found = {re.sub(r"^https?://[^/]+", "", m[1]) for m in link.finditer(payload)}
        new = found - seen
        seen.update(new)
        return bool(new) and page + 1 < MOST_PAGES["new_links"]

    return more


#: name: (what is made anew for each board, from the rule's arguments) -> more(page, payload). A rule is a name or [name, argument ...].
RULES: dict[str, Callable] = {"cursor": _cursor, "offset": _offset, "token": _token, "new_links": _new_links, "all": lambda: lambda page, payload: True}


# --- reading ---------------------------------------------------------------------------------------------------------

@dataclass
class Board(InputPartition):
    """Pages first (inclusive) to last (exclusive, None: all) of a board of a day, by the names of their folders."""

    platform: str
    day: str
    board: str
    first: int = 0
    last: int | None = None


def remove(path: str, folder: str, tries: int = 20) -> None:
    """Delete a folder of a store if it is there. Tasks that are being stopped may still write into it, so it may take more than one try."""
    from pyarrow import fs

    store, root = _store(path)
    for left in reversed(range(tries)):
        try:
            if store.get_file_info(f"{root}/{folder}").type != fs.FileType.NotFound:
                store.delete_dir(f"{root}/{folder}")
            return
        except OSError:
            if not left:
                raise
            time.sleep(0.25)


def _children(store, path: str, files: bool) -> list[str]:
    from pyarrow import fs

    kind = fs.FileType.File if files else fs.FileType.Directory
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == kind and not f.base_name.startswith(("_", ".")))


def _pages(store, root: str, at: Board) -> list[tuple[int, str]]:
    folder = f"{root}/{at.platform}/{at.day}/{at.board}"
    named = [(int(n.split(".")[0]), f"{folder}/{n}") for n in _children(store, folder, True) if n.split(".")[0].isdigit()]
    return [x for x in sorted(named) if x[0] >= at.first and (at.last is None or x[0] < at.last)]


def _holds(f: Filter, value: str) -> bool:
    if isinstance(f, In):
        return value in f.value
    return {EqualTo: value == f.value, GreaterThan: value > f.value, GreaterThanOrEqual: value >= f.value, LessThan: value < f.value, LessThanOrEqual: value <= f.value}[type(f)]


class _Reading:
    def __init__(self, options: dict):
        self.path, self.rules = options["path"], json.loads(options.get("rules", "{}"))
        self.platforms, self.days = json.loads(options.get("platforms", "null")), json.loads(options.get("days", "[null, null]"))
        self.filters: list[Filter] = []

    def wanted(self, column: str, value: str) -> bool:
        if column == "platform" and self.platforms is not None and value not in self.platforms:
            return False
        if column == "day" and not (self.days[0] or "") <= value <= (self.days[1] or value):
            return False
        return all(_holds(f, value) for f in self.filters if f.attribute == (column,))

    def boards(self) -> Iterator[Board]:
        """Names alone are listed, level by level; folders that the filters rule out are not opened."""
        store, root = _store(self.path)
        for platform in filter(lambda p: self.wanted("platform", unquote(p)), _children(store, root, False)):
            for day in filter(lambda d: self.wanted("day", unquote(d)), _children(store, f"{root}/{platform}", False)):
                for board in _children(store, f"{root}/{platform}/{day}", False):
                    yield Board(platform, day, board)

    def read(self, at: Board | None) -> Iterator[tuple]:
        """A board's pages. One that can't be read, or of which the rule can't make anything, ends its board and no other: its row
        says why. A page that is missing between others ends it too."""
        if at is None:  # no board is wanted
            return
        store, root = _store(self.path)
        key = tuple(map(unquote, (at.platform, at.day, at.board)))
        rule = self.rules.get(key[0], "all")
        name, *arguments = [rule] if isinstance(rule, str) else rule
        more = RULES[name](*arguments)
        expected = at.first
        for page, file in _pages(store, root, at):
            if page != expected:
                yield *key, expected, None, "missing page"
                return
            expected += 1
            try:
                with store.open_input_stream(file) as stream:
                    payload = stream.readall().decode()
            except (OSError, UnicodeDecodeError) as e:
                yield *key, page, None, f"{type(e).__name__}: {e}"[:500]
                return
            try:
                on = more(page, payload)
            except (ValueError, AttributeError, TypeError) as e:
                yield *key, page, payload, f"{type(e).__name__}: {e}"[:500]
                return
            yield *key, page, payload, None
            if not on:
                return


class _BatchReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Board]:
        return list(self.boards())


class _FilteringReader(_BatchReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of platform and day choose folders; all others are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("platform",), ("day",)):
                self.filters.append(f)
            else:
                yield f


class _StreamReader(_Reading, DataSourceStreamReader):
    """The offset is the next page of each board, so a page that comes later is read by the next batch alone. Rules that compare
    pages (new_links) begin anew with each batch; a captured page that is there is wanted, so "all" is what a stream asks for."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = _store(self.path)
        out = {}
        for at in self.boards():
            pages = [p for p, _ in _pages(store, root, at)]
            # Up to the first gap: what is behind a page that has not come yet waits for it.
            out[f"{at.platform}/{at.day}/{at.board}"] = next((i for i, p in enumerate(pages) if p != i), len(pages))
        return out

    def partitions(self, start: dict, end: dict) -> list[Board]:
        return [Board(*key.split("/"), first=start.get(key, 0), last=last) for key, last in sorted(end.items()) if last > start.get(key, 0)]


# --- capturing -------------------------------------------------------------------------------------------------------

@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Capture(DataSourceWriter):
    """Pages are written beside the store and moved in when all tasks are done; a job that fails leaves none."""

    def __init__(self, path: str):
        import uuid

        self.path, self.staging = path, f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> _Written:
        import uuid

        store, root = _store(self.path)
        store.create_dir(f"{root}/{self.staging}")
        files = []
        for row in rows:
            part = f"{root}/{self.staging}/{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write((row["payload"] or "").encode())
            files.append((part, "/".join([root, *(quote(str(row[c]), safe="") for c in ("platform", "day", "board")), f"{row['page']}.txt"])))
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            for part, to in m.files if m else ():
                store.create_dir(to.rsplit("/", 1)[0])
                store.move(part, to)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        remove(self.path, self.staging)


class CapturedPayloads(DataSource):
    """platform, day, board, page, payload, error. Options, as JSON: rules (platform to rule), platforms (a list), days (first, last)."""

    @classmethod
    def name(cls) -> str:
        return "captured_payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_FilteringReader if self.options.get("pushdown") == "true" else _BatchReader)(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Capture(self.options["path"])


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(CapturedPayloads)
    return spark


def read_captured(spark: SparkSession, path: str, rules: dict | None = None, platforms: list[str] | None = None, days: tuple[str | None, str | None] = (None, None), pushdown: bool = False) -> DataFrame:
    """Pages of a store; platforms and days (first and last, both included) choose the folders that are opened.

    With pushdown, filters on platform and day do so too; the session must have spark.sql.python.filterPushdown.enabled. Spark keeps what
    was pushed down with the loaded frame, so such a frame is for one filter: load anew for each, and don't join it with itself."""
    reader = _registered(spark).read.format("captured_payloads").option("rules", json.dumps(rules or {})).option("days", json.dumps(days)).option("pushdown", str(pushdown).lower())
    return (reader if platforms is None else reader.option("platforms", json.dumps(platforms))).load(path)


def stream_captured(spark: SparkSession, path: str) -> DataFrame:
    return _registered(spark).readStream.format("captured_payloads").load(path)


def write_captured(pages: DataFrame, path: str) -> None:
    """Add pages (platform, day, board, page, payload) to a store; a page that is there is replaced."""
    _registered(pages.sparkSession)
    pages.select("platform", "day", "board", "page", "payload").write.format("captured_payloads").mode("append").save(path)


def board_status(pages: DataFrame) -> DataFrame:
    """What reading a board came to: platform, day, board, pages that were read, and note (null if all is well; what broke it otherwise,
    with "partial" where pages came before)."""
    from pyspark.sql import functions as F

    read = F.count_if(F.col("error").isNull())
    return pages.groupBy("platform", "day", "board").agg(read.alias("pages"), F.max("error").alias("note")).withColumn("note", F.when(F.col("note").isNotNull() & (F.col("pages") > 0), F.concat(F.lit("partial: "), "note")).otherwise(F.col("note")))
