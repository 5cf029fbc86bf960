"""Picture files as a data source, for batches and streams: ``spark.read.format("pictures")``, ``spark.readStream.format("pictures")``.

A partition is some sub-folders, which a task lists itself, so neither the driver nor a job's description holds the files. Of a file its first bytes are read, more
only if its header goes on, up to a limit. Filters on path and mtime are settled before a file is opened (``spark.sql.python.filterPushdown.enabled``).

As a stream, a file's place is the time of its last change (of its content or, where the file system tells, of its entry, so that
a copy with an old time counts as new). A trigger takes what changed after the last one; with ``maxFilesPerTrigger`` about so many files, the oldest changes
first, where ``progress`` names a folder of the stream's own for how far it has planned. One listing plans batches for up to PLANNED files, and a planned batch
lists only the folders that hold its files. A batch that runs again reads the same stretch of time; after a restart it lists all folders for it.

Options: path, recursive (true), dataDir (the catalog's own folder, left out), headers (true; false reads no file), headerBytes (1 MB), partitions (32), settleSeconds (0: how
long a file must be unchanged before a stream takes it), maxFilesPerTrigger, progress."""

from __future__ import annotations

import heapq
import json
import os
import time
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)

from ..functions.media import described
from .files import DATA_DIR, EXTENSIONS

FORMAT = "pictures"
SCHEMA = "path string, mtime timestamp, length long, width int, height int, format string, exif_text string, error string"
#: Bytes of a file that are read first, and at most; sub-folders that are enough to deal out, and partitions they are dealt to.
FIRST, MOST, ENOUGH, PARTS = 16_384, 1 << 20, 512, 32
#: Files of a stream that one listing plans batches for; the driver holds the folder and time of so many.
PLANNED = 200_000


@dataclass(frozen=True)
class File:
    path: str
    length: int
    mtime_ns: int
    changed_ns: int


class Store:
    """Listing and reading ranges of files: the local system's, or any that Arrow knows by a path's scheme."""

    def __init__(self, path: str):
        if "://" in path and not path.startswith("file://"):
            from pyarrow import fs

            self.remote, self.root = fs.FileSystem.from_uri(path)
        else:
            self.remote, self.root = None, path.removeprefix("file://")

    def entries(self, folder: str) -> tuple[list[str], list[File]]:
        """Sub-folders and files of a folder, by name; a folder that went since has none."""
        folders, files = [], []
        if self.remote is not None:
            from pyarrow import fs

            for e in self.remote.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if e.type == fs.FileType.Directory:
                    folders.append(e.path)
                elif e.type == fs.FileType.File:
                    files.append(File(e.path, e.size, e.mtime_ns or 0, e.mtime_ns or 0))
        else:
            try:
                with os.scandir(folder) as found:
                    for e in found:
                        if e.is_dir(follow_symlinks=False):
                            folders.append(e.path)
                        elif e.is_file():
                            s = e.stat()
                            files.append(File(e.path, s.st_size, s.st_mtime_ns, max(s.st_mtime_ns, s.st_ctime_ns)))
            except FileNotFoundError:
                pass
        return sorted(folders), sorted(files, key=lambda f: f.path)

    def header(self, path: str, most: int = MOST) -> dict:
        """What a file's first bytes say of its picture; more are read until they give the size."""
        data = self.range(path, 0, min(FIRST, most))
        while True:
            found = described(data)
            more = b"" if found["width"] or len(data) >= most else self.range(path, len(data), min(3 * len(data), most - len(data)))
            if not more:
                return found
            data += more

    def put(self, path: str, data: bytes) -> None:
        """Writes a file, with its folders."""
        if self.remote is not None:
            with self.remote.open_output_stream(path) as f:
                f.write(data)
        else:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(data)

    def size(self, path: str) -> int:
        if self.remote is not None:
            return self.remote.get_file_info(path).size
        return os.stat(path).st_size

    def range(self, path: str, start: int, n: int) -> bytes:
        if self.remote is not None:
            with self.remote.open_input_file(path) as f:
                f.seek(start)
                return f.read(n)
        with open(path, "rb", buffering=0) as f:
            f.seek(start)
            return f.read(n)


@dataclass(frozen=True)
class Folders(InputPartition):
    """Folders, each with whether all below it is meant, and the stretch of changes."""

    folders: tuple[tuple[str, bool], ...]
    after: int = -1
    until: int = 1 << 62


@dataclass
class Wanted:
    """Filters that were pushed: paths or their beginning, and bounds of mtime in nanoseconds, both inclusive."""

    paths: frozenset[str] | None = None
    starts: tuple[str, ...] = ()
    low: int = -1
    high: int = 1 << 62
    shown: list[str] = field(default_factory=list)

    def may_hold(self, folder: str) -> bool:
        """Whether a folder may hold a wanted path."""
        inside = folder.rstrip("/") + "/"
        if self.paths is not None and not any(p.startswith(inside) for p in self.paths):
            return False
        return all(inside.startswith(s) or s.startswith(inside) for s in self.starts)

    def takes(self, f: File) -> bool:
        return (self.paths is None or f.path in self.paths) and all(f.path.startswith(s) for s in self.starts) and self.low <= f.mtime_ns // 1000 * 1000 <= self.high


def nanoseconds(t: datetime) -> int:
    t = t if t.tzinfo else t.astimezone()  # as Spark hands out timestamps: in the system's zone
    delta = t - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return ((delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds) * 1000


class _Files:
    """What both readers share."""

    def __init__(self, options: dict[str, str]):
        path = options.get("path")
        if not path:
            raise ValueError("pictures need a path")
        self.root = path if "://" in path and not path.startswith("file:") else os.path.abspath(path.removeprefix("file://").removeprefix("file:"))
        flag = lambda name, default: str(options.get(name, default)).lower() == "true"
        self.recursive, self.headers = flag("recursive", "true"), flag("headers", "true")
        self.data_dir, self.most = options.get("dataDir", DATA_DIR), int(options.get("headerBytes", MOST))
        self.parts = max(1, int(options.get("partitions", PARTS)))
        self.wanted = Wanted()

    def folders(self, after: int = -1, until: int = 1 << 62) -> list[Folders]:
        """Folders by breadth until there are enough, the last ones with all below them."""
        store = Store(self.root)
        found, waiting = [], deque([store.root])
        if not self.recursive:
            found, waiting = [(store.root, False)], deque()
        while waiting and len(found) + len(waiting) < ENOUGH:
            folder = waiting.popleft()
            found.append((folder, False))
            waiting += [d for d in store.entries(folder)[0] if os.path.basename(d) != self.data_dir and self.wanted.may_hold(d)]
        found += [(d, True) for d in waiting]
        return [Folders(tuple(found[k : : self.parts]), after, until) for k in range(min(self.parts, len(found)))]

    def listed(self, part: Folders) -> Iterator[File]:
        store, waiting = Store(self.root), list(part.folders)
        while waiting:
            folder, deep = waiting.pop()
            folders, files = store.entries(folder)
            yield from (f for f in files if f.path.rpartition(".")[2].lower() in EXTENSIONS and part.after < f.changed_ns <= part.until and self.wanted.takes(f))
            if deep:
                waiting += [(d, True) for d in folders if os.path.basename(d) != self.data_dir]

    def rows(self, part: Folders) -> Iterator[tuple]:
        store = Store(self.root)
        for f in self.listed(part):
            found, error = {}, None
            if self.headers:
                try:
                    found = store.header(f.path, self.most)
                except Exception as e:  # noqa: BLE001  one bad file must not end a scan
                    error = f"{type(e).__name__}: {e}"
            yield f.path, datetime.fromtimestamp(f.mtime_ns // 1000 / 1_000_000, timezone.utc), f.length, found.get("width"), found.get("height"), found.get("format"), found.get("exif_text"), error


class PictureReader(_Files, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        w = self.wanted
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("path",) and isinstance(f, (EqualTo, In)):
                paths = frozenset([value] if isinstance(f, EqualTo) else value)
                w.paths = paths if w.paths is None else w.paths & paths
            elif column == ("path",) and isinstance(f, StringStartsWith):
                w.starts = (*w.starts, value)
            elif column == ("mtime",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                w.low = max(w.low, nanoseconds(value) + isinstance(f, GreaterThan))
            elif column == ("mtime",) and isinstance(f, (LessThan, LessThanOrEqual)):
                w.high = min(w.high, nanoseconds(value) - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Folders]:
        return self.folders()

    def read(self, partition: Folders) -> Iterator[tuple]:
        return self.rows(partition)


class PictureStreamReader(_Files, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.settle = int(float(options.get("settleSeconds", 0)) * 1e9)
        self.limit, self.progress = int(options.get("maxFilesPerTrigger", 0)), options.get("progress", "").removeprefix("file://").removeprefix("file:")
        if self.limit and not self.progress:
            raise ValueError("maxFilesPerTrigger needs a folder for progress")
        self.planned, self.plans = -1, deque()

    def _far(self) -> int:
        """How far batches are planned; Spark doesn't tell it after a restart."""
        try:
            with open(os.path.join(self.progress, "until")) as f:
                return max(self.planned, int(json.load(f)))
        except FileNotFoundError:
            return self.planned

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        now = time.time_ns() - self.settle
        if not self.limit:
            return {"until": now}
        far = self._far()
        while self.plans and self.plans[0][1] <= far:
            self.plans.popleft()
        if not self.plans or self.plans[0][0] != far:
            self._plan(far, now)
        return {"until": self.plans[0][1] if self.plans else max(far, -1)}

    def _plan(self, far: int, now: int) -> None:
        """Batches of what changed after ``far``: (after, until, folders). Files of one time are in one batch."""
        self.plans.clear()
        most = max(PLANNED, self.limit)
        changes = heapq.nsmallest(most, ((f.changed_ns, os.path.dirname(f.path)) for part in self.folders(far, now) for f in self.listed(part)))
        whole, k, after = len(changes) < most, 0, far
        while k < len(changes):
            end = min(k + self.limit, len(changes))
            until = changes[end - 1][0]
            while end < len(changes) and changes[end][0] == until:
                end += 1
            if end == len(changes) and not whole:  # more files of the last time may be left
                if not self.plans:
                    self.plans.append((after, until, None))
                return
            self.plans.append((after, until, tuple(sorted({folder for _, folder in changes[k:end]}))))
            k, after = end, until

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        if end["until"] <= start["until"]:
            return []
        if self.progress and end["until"] > self._far():
            os.makedirs(self.progress, exist_ok=True)
            new = os.path.join(self.progress, f"until-{os.getpid()}")
            with open(new, "w") as f:
                json.dump(end["until"], f)
            os.replace(new, os.path.join(self.progress, "until"))
        self.planned = max(self.planned, end["until"])
        for after, until, folders in self.plans:
            if (after, until) == (start["until"], end["until"]) and folders is not None:
                found = [(d, False) for d in folders]
                return [Folders(tuple(found[k :: self.parts]), after, until) for k in range(min(self.parts, len(found)))]
        return self.folders(start["until"], end["until"])

    def read(self, partition: Folders) -> Iterator[tuple]:
        return self.rows(partition)


class PictureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PictureReader:
        return PictureReader(self.options)

    def streamReader(self, schema) -> PictureStreamReader:
        return PictureStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PictureSource)


def pictures(spark: SparkSession, folder: str, recursive: bool = True, headers: bool = True):
    """The pictures of a folder, with what their headers say or, without ``headers``, as they are listed."""
    register(spark)
    return spark.read.format(FORMAT).option("recursive", str(recursive)).option("headers", str(headers)).load(folder)
