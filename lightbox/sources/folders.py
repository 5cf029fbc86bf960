"""Folders of pictures as a sink: ``plan.write.format("picture_folders")`` copies or links what a plan (cluster_id, folder, src, file_name) names.

Tasks copy to a folder of their own under a hidden one; only when all have ended, ``commit`` gives the files their names, and ``abort`` removes what there is. So
a task that dies or runs twice leaves nothing behind, and no folder is half there while a job runs. Files that are there are never overwritten: a name that was taken meanwhile gets
the first free number. Sources that are gone are skipped and not counted.

Options: path, symlink (false), report (a folder for how many pictures of each entity there are)."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "picture_folders"
#: Names that are given at a time.
THREADS = 16


@dataclass
class Copied(WriterCommitMessage):
    staged: str
    counts: dict[int, int]


def numbered_name(name: str, k: int) -> str:
    stem, ext = os.path.splitext(name)
    return f"{stem}_{k}{ext}" if k else name


class FolderWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema):
        self.path = os.path.abspath(options["path"].removeprefix("file:").replace("///", "/"))
        self.symlink = options.get("symlink", "false").lower() == "true"
        self.report = options.get("report", "").removeprefix("file://").removeprefix("file:")
        self.place = {f.name: k for k, f in enumerate(schema.fields)}
        self.staging = os.path.join(self.path, f".export-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Copied:
        task = TaskContext.get()
        staged = os.path.join(self.staging, f"{task.partitionId()}-{task.taskAttemptId()}")
        counts: Counter[int] = Counter()
        os.makedirs(staged, exist_ok=True)  # only here: a task that goes on after abort finds no place any more
        made: set[str] = set()
        for row in iterator:
            cluster, folder, src, name = (row[self.place[c]] for c in ("cluster_id", "folder", "src", "file_name"))
            if not os.path.exists(src):
                continue
            if folder not in made:
                os.mkdir(os.path.join(staged, folder))
                made.add(folder)
            target = os.path.join(staged, folder, name)
            if self.symlink:
                os.symlink(src, target)
            else:
                shutil.copy2(src, target)
            counts[cluster] += 1
        return Copied(staged, dict(counts))

    def commit(self, messages: list[Copied | None]) -> None:
        def named(staged: str, folder: str, name: str) -> None:
            target = os.path.join(self.path, folder)
            k = 0
            while True:
                try:  # a link never takes the place of a file
                    os.link(os.path.join(staged, folder, name), os.path.join(target, numbered_name(name, k)), follow_symlinks=False)
                    return
                except FileExistsError:
                    k += 1

        done = [m for m in messages if m is not None]
        with ThreadPoolExecutor(THREADS) as pool:
            for m in done:
                for folder in sorted(os.listdir(m.staged)) if os.path.isdir(m.staged) else []:
                    os.makedirs(os.path.join(self.path, folder), exist_ok=True)
                    list(pool.map(lambda name, m=m, folder=folder: named(m.staged, folder, name), sorted(os.listdir(os.path.join(m.staged, folder)))))
        if self.report:
            os.makedirs(self.report, exist_ok=True)
            with open(os.path.join(self.report, "counts.json"), "w") as f:
                f.writelines(json.dumps({"cluster_id": c, "n": n}) + "\n" for m in done for c, n in m.counts.items())
        shutil.rmtree(self.staging, ignore_errors=True)  # with what tasks left that died or ran twice

    def abort(self, messages: list[Copied | None]) -> None:
        gone = f"{self.staging}-aborted"
        try:
            os.rename(self.staging, gone)  # first out of the way of tasks that still run
        except FileNotFoundError:
            return
        shutil.rmtree(gone, ignore_errors=True)


class FolderSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSink)
