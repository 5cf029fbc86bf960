"""Files as tables: discovery of pictures, pixels, logs, folders, settings."""

from __future__ import annotations

import json
import os
import re
import shutil
import time
from dataclasses import asdict, dataclass, field, fields
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File extensions of pictures.
EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp", "heic", "heif"]
DATA_DIR = ".lightbox"


#: The same as a file name pattern in any case, so that other files aren't even listed.
PICTURES = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in EXTENSIONS) + "}"


def plain_path(column):
    """Paths as the local system writes them."""
    return F.regexp_replace(column, "^file:/+", "/")


def as_it_is(path: str) -> str:
    """A path as a pattern that fits only itself."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def discover(spark: SparkSession, root: str, recursive: bool = True, data_dir: str = DATA_DIR, content: bool = False) -> DataFrame:
    """(path, mtime, length[, content]) of pictures under ``root`` in order of path; the catalog's own folder
    is left out. Extensions match in any case. Without ``content`` no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", PICTURES).load(root)
    wanted = files.select(plain_path("path").alias("path"), F.col("modificationTime").alias("mtime"), "length", *(["content"] if content else []))
    return wanted.where(~F.contains("path", F.lit(f"/{data_dir}/"))).orderBy("path")


def contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of the files."""
    return spark.read.format("binaryFile").load(list(map(as_it_is, paths))).select(plain_path("path").alias("path"), "content")


def readable(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    return [p for p in paths if there(p)]


def pixels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, height, width, channels, data) of the pictures in a folder or a list of files that Spark's image source can decode."""
    image = spark.read.format("image").option("dropInvalid", True)
    image = image.load(paths if isinstance(paths, str) else list(map(as_it_is, paths)))
    origin = F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))
    return image.select(plain_path(origin).alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def log_tail(spark: SparkSession, path: str, n: int = 200) -> DataFrame:
    """The last n lines (10 to 2000) of a log, in order."""
    n = max(10, min(2000, n))
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return lines.orderBy(F.col("at").desc()).limit(n).orderBy("at").select(F.col("value").alias("line"))


def truncate_log(path: str) -> None:
    with open(path, "w"):
        pass


def recycle(path: str, bin_: str | None = None) -> str:
    """Moves a file to the user's recycle bin as desktops know it, with a note of where it was; its path there. OSError if
    it can't be moved, FileNotFoundError if it isn't there."""
    home = bin_ or os.path.join(os.environ.get("XDG_DATA_HOME") or os.path.expanduser("~/.local/share"), "Trash")
    if not os.path.lexists(path):
        raise FileNotFoundError(path)
    for folder in ("files", "info"):
        os.makedirs(os.path.join(home, folder), exist_ok=True)
    stem, ext = os.path.splitext(os.path.basename(path))
    k = 0
    while True:
        name = f"{stem}_{k}{ext}" if k else stem + ext
        note = os.path.join(home, "info", name + ".trashinfo")
        try:
            with open(note, "x") as f:  # whoever makes the note owns the name
                f.write(f"[Trash Info]\nPath={quote(os.path.abspath(path))}\nDeletionDate={time.strftime('%Y-%m-%dT%H:%M:%S')}\n")
            break
        except FileExistsError:
            k += 1
    target = os.path.join(home, "files", name)
    try:
        shutil.move(path, target)
    except OSError:
        os.remove(note)
        raise
    return target


def browse(path: str) -> dict:
    """Folders in a folder by name in any case, and the one above."""
    with os.scandir(path) as it:
        found = sorted((e.name for e in it if e.is_dir() and not e.name.startswith(".")), key=str.lower)
    parent = os.path.dirname(os.path.abspath(path))
    return {"path": os.path.abspath(path), "parent": parent if parent != os.path.abspath(path) else None, "dirs": found}


@dataclass
class Settings:
    """Thresholds and folders; values out of range are refused by ``checked``."""

    cluster_eps: float = 0.55
    min_cluster_size: int = 3
    confidence: float = 0.9
    min_face: int = 40
    workers: int = 4
    hamming: int = 10
    recent_folders: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Settings:
        """Unknown keys are ignored; a file that is missing or broken gives the defaults."""
        try:
            with open(path) as f:
                data = json.load(f)
            return cls(**{k: v for k, v in data.items() if k in {x.name for x in fields(cls)}})
        except (OSError, ValueError, AttributeError, TypeError):
            return cls()

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2)

    def checked(self) -> Settings:
        if not 0.1 <= self.confidence <= 1.0:
            raise ValueError("confidence must be between 0.1 and 1.0")
        if not 5 <= self.min_face <= 500:
            raise ValueError("min_face must be between 5 and 500")
        self.workers = max(1, min(16, self.workers))
        return self

    def remember(self, folder: str, most: int = 10) -> None:
        """The folder first in the recent ones, once, at most ``most`` of them."""
        self.recent_folders = [folder, *(f for f in self.recent_folders if f != folder)][:most]
