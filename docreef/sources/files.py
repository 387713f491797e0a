"""Local folders and configuration files as tables."""

from __future__ import annotations

import hashlib
import os
import time
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition

from docreef.functions.scalars import base_name

_SCHEMA = "container string, name string, path string, size bigint, modified timestamp_ntz, hash string"


def plain_path(path: str) -> str:
    """The path of a folder that every machine has mounted; other schemes raise (read those with ``inventory``)."""
    if "://" in path or path.startswith("file:"):
        if not path.startswith("file:"):
            raise ValueError(f"{path} is not a mounted folder")
        return "/" + path.removeprefix("file:").lstrip("/")
    return path


def _md5(path: str) -> str | None:
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "md5").hexdigest()
    except OSError:
        return None


#: Files, and bytes of files, that a task reads at most; a larger file has a task of its own. A task costs as much as
#: some thousands of small files.
TASK_FILES, TASK_BYTES = 8_000, 1 << 28


def _walk(root: str) -> Iterator[os.DirEntry]:
    """Regular files below a folder, in order of their paths, folder by folder."""
    below = []
    for e in sorted(os.scandir(root), key=lambda e: e.name):
        if e.is_dir(follow_symlinks=False):
            below.append(e.path)
        elif e.is_file():
            yield e
    for folder in below:
        yield from _walk(folder)


def _when(stat: os.stat_result) -> datetime:
    """Time of the last change, in UTC, so that all executors agree; without zone."""
    return datetime.fromtimestamp(stat.st_mtime, UTC).replace(tzinfo=None)


class FolderReader(DataSourceReader):
    """Paths are listed up front and dealt to tasks by number and bytes, however they lie in folders; content is read by
    the tasks, a block at a time."""

    def __init__(self, options: dict):
        self.root = plain_path(options["path"])
        self.container = options.get("container", os.path.basename(self.root.rstrip("/")))
        self.hashes = options.get("hash", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        out, own, held = [], [], 0
        for e in _walk(self.root):
            size = e.stat().st_size
            if own and (len(own) >= TASK_FILES or held + size > TASK_BYTES):
                out.append(InputPartition(own))
                own, held = [], 0
            own.append(e.path)
            held += size
        return [*out, InputPartition(own)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            stat = os.stat(path)
            yield self.container, os.path.basename(path), path, stat.st_size, _when(stat), _md5(path) if self.hashes else None


class FolderSource(DataSource):
    """``spark.read.format("docreef_folder").load(path)``: every regular file, hidden and empty ones included.

    Options: container (default: the folder's name), hash (default true). For folders that all executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "docreef_folder"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)


class ListingReader(DataSourceReader):
    """Folders of a paged listing, a task some pages; every page is read, and an error fails the plan instead of looking
    empty. A filter on the container reaches the listing: other folders are not listed."""

    def __init__(self, options: dict):
        self.path, self.page = plain_path(options["path"]), int(options.get("pagesize", "1000"))
        self.folder = options.get("folder")

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("container",) and self.folder in (None, f.value):
                self.folder = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        folders = [self.folder] if self.folder else sorted(d.name for d in os.scandir(self.path) if d.is_dir())
        pages = []
        for folder in folders:
            names = sorted(e.name for e in os.scandir(os.path.join(self.path, folder)) if e.is_file() and not e.name.startswith(".trash"))
            step = self.page * max(1, TASK_FILES // self.page)
            pages += [InputPartition((folder, names[at : at + step])) for at in range(0, len(names), step)]
        return pages or [InputPartition((None, []))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        folder, names = partition.value
        for name in names:
            path = os.path.join(self.path, folder, name)
            stat = os.stat(path)
            yield folder, f"{folder}/{name}", name, _when(stat).isoformat(), _md5(path), str(stat.st_size)


class ListingSource(DataSource):
    """``spark.read.format("docreef_listing").load(path)``: remote folders, here stood in for by folders below a path.

    Direct children of each folder, not those trashed; an id is the path below the root, which ``FolderBackend`` takes.
    Options: folder (one of them), pagesize.
    """

    @classmethod
    def name(cls) -> str:
        return "docreef_listing"

    def schema(self) -> str:
        return "container string, id string, name string, modifiedTime string, md5Checksum string, size string"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)


#: Names that a task of a watched folder looks at, and tasks that one folder is dealt to at most: each scans its names.
TASK_NAMES, FOLDER_TASKS = 20_000, 64


def _hidden(name: str) -> bool:
    """Names that Spark's readers skip."""
    out = name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    return out and not name.startswith(("_common_metadata", "_metadata"))


def _counted(root: str) -> Iterator[tuple[str, int]]:
    """Folders below a folder, itself included, and how many files each has; names are counted, not kept."""
    below = [root]
    while below:
        folder, n = below.pop(), 0
        with os.scandir(folder) as entries:
            for e in entries:
                if _hidden(e.name):
                    continue
                if e.is_dir():
                    below.append(e.path)
                else:
                    n += 1
        yield folder, n


class WatchReader(DataSourceStreamReader):
    """Looks at a whole folder, again and again: an offset is the time of a look. The driver counts the names in the
    folders; tasks look at the files, shares of a large folder by a hash of the name, so no list passes the driver."""

    def __init__(self, options: dict):
        self.root = os.path.abspath(plain_path(options["path"]))

    def initialOffset(self) -> dict:
        return {"look": 0}

    def latestOffset(self) -> dict:
        return {"look": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, own, held = [], [], 0
        for folder, n in _counted(self.root):
            shares = min(-(-n // TASK_NAMES), FOLDER_TASKS)
            if shares > 1:
                out += [InputPartition([(folder, i, shares)]) for i in range(shares)]
            elif n:
                if own and held + n > TASK_NAMES:
                    out.append(InputPartition(own))
                    own, held = [], 0
                own.append((folder, 0, 1))
                held += n
        return [*out, InputPartition(own)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for folder, share, shares in partition.value:
            with os.scandir(folder) as entries:
                for e in entries:
                    if _hidden(e.name) or (shares > 1 and zlib.crc32(os.fsencode(e.name)) % shares != share):
                        continue
                    try:
                        if e.is_file():
                            yield "file:" + e.path, e.stat().st_size
                    except FileNotFoundError:  # gone since its name was read
                        continue


class WatchSource(DataSource):
    """``spark.readStream.format("docreef_watch").load(path)``: (path, length) of every file in every batch, hidden ones
    left out; which are new is for the stream's state to say."""

    @classmethod
    def name(cls) -> str:
        return "docreef_watch"

    def schema(self) -> str:
        return "path string, length bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return WatchReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the sources known, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FolderSource, ListingSource, WatchSource):
        spark.dataSource.register(source)


def inventory(spark: SparkSession, path: str, container: str, most_bytes: int | None = None, pattern: str | None = None) -> DataFrame:
    """A folder of any file system by Spark's own reader, recursively. It skips hidden and empty files; for those too,
    use the folder source. Filters on length reach the scan, and content is not read unless the hash is asked for; then
    a file is held whole in memory, at most 2 GB (beyond it Spark raises). For larger files give most_bytes, or use the
    folder source, which reads by blocks."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    return files.select(
        F.lit(container).alias("container"), base_name(F.col("path")).alias("name"), "path", F.col("length").alias("size"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modified"), F.md5("content").alias("hash"),
    )


def load_domains(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """(domain, keywords, aliases, folder_id, color, priority) of a JSON configuration.

    section: its key; by default the one top-level key that ends with ``domains``. Whatever a domain leaves out is null
    or empty. A file that is no JSON gives no rows.
    """
    text = spark.read.text(path, wholetext=True)
    kind = "map<string, struct<keywords: array<string>, aliases: array<string>, folder_id: string, color: string, priority: int>>"
    keys = F.filter(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), lambda k: k == section if section else k.endswith("domains"))
    body = F.from_json("value", "map<string, string>")[keys[0]]
    rows = text.where(F.size(keys) > 0).select(F.explode(F.from_json(body, kind)).alias("domain", "d"))
    empty = F.array().cast("array<string>")
    return rows.select("domain", F.coalesce("d.keywords", empty).alias("keywords"), F.coalesce("d.aliases", empty).alias("aliases"), "d.folder_id", "d.color", "d.priority")


def save_config(path: str, folder_map: dict[str, str], domains: dict, section: str = "domains") -> None:
    """Writes a configuration that load_domains reads, each domain with its folder's id, indented, not escaped."""
    import json

    body = {"folder_map": folder_map, section: {d: {**x, "folder_id": folder_map.get(d)} for d, x in domains.items()}}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(body, f, ensure_ascii=False, indent=2)


def config_text(domains: DataFrame, section: str = "domains") -> DataFrame:
    """(value): one configuration, of rows (domain, keywords, aliases, folder_id, color, priority); for any file system.
    A configuration is one row: a catalogue of themes is small by nature."""
    entry = F.struct("domain", F.struct("keywords", "aliases", "folder_id", "color", "priority"))
    return domains.agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(entry), lambda x, y: F.when(x["domain"] < y["domain"], -1).otherwise(1))).alias(section))).alias("value"))


def sections(spark: SparkSession, path: str, wanted: tuple[str, ...]) -> DataFrame:
    """(section, present): the wanted top-level keys of a JSON configuration; a file that is no JSON has none."""
    text = spark.read.text(path, wholetext=True)
    have = text.select(F.explode(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))).alias("section")).withColumn("present", F.lit(True))
    return spark.createDataFrame([(x,) for x in wanted], "section string").join(F.broadcast(have), "section", "left").select("section", F.coalesce("present", F.lit(False)).alias("present"))


def store_texts(rows: DataFrame, root: str, text: str = "text", path: str = "path", seconds: str = "seconds") -> DataFrame:
    """Writes each row's text as a file below a mounted folder, with that time of change (seconds since 1970), and
    returns (n_files), one row a task. Null texts are empty files. Files are renamed into place from a
    folder beside it, so tasks may run again."""
    import pandas as pd

    base = plain_path(root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, known = 0, set()
        own = f"{base.rstrip('/')}.parts/{uuid.uuid4().hex}"  # a task's own: others do not wait for the folder's lock
        os.makedirs(own)
        part = f"{own}/part"
        for pdf in frames:
            for body, below, at in zip(pdf[text], pdf[path], pdf[seconds], strict=True):
                target = os.path.join(base, below)
                folder = os.path.dirname(target)
                if folder not in known:
                    os.makedirs(folder, exist_ok=True)
                    known.add(folder)
                with open(part, "w", encoding="utf-8", newline="", errors="surrogatepass") as f:
                    f.write(body or "")
                os.utime(part, (int(at), int(at)))
                os.replace(part, target)
                n += 1
        os.rmdir(own)
        yield pd.DataFrame({"n_files": [n]})

    return rows.select(text, path, seconds).mapInPandas(run, "n_files long")
