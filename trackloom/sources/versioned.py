"""Documents that are saved whole or not at all, each save a version that can be gone back to.

Below a path:

    data/<save>/part-*.json     lines of {"key": ..., "body": ...}, written by tasks
    versions/<number>.json      {"contentVersion": number, "full": ..., "files": [...]}

A save writes its files beside those of others, and its version file last, under another
name that is then renamed; only what a version file names is ever read.  So a save that is
killed at any point leaves the version before it as it was, failed and repeated tasks
leave files that nobody names, and what was there before is the backup.  A version
that is not full goes on from the one before it, key by key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "versioned_documents"


@dataclass
class Written(WriterCommitMessage):
    file: str | None


def _store(path: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    return store, root.rstrip("/")


def _versions(path: str) -> dict[int, dict]:
    """All finished versions, by number."""
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/versions", allow_not_found=True))
    names = [x.path for x in found if x.base_name.endswith(".json") and x.base_name[:-5].isdigit()]
    out = {}
    for name in names:
        with store.open_input_file(name) as file:
            made = json.loads(file.read())
        out[made["contentVersion"]] = made
    return out


def _publish(path: str, files: list[str], full: bool) -> int:
    """The number of the new version, one above the last; it counts once it has its own name."""
    store, root = _store(path)
    number = max(_versions(path), default=0) + 1
    store.create_dir(f"{root}/versions")
    draft = f"{root}/versions/{number}.json.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as file:
        file.write(json.dumps({"contentVersion": number, "full": full, "files": files}).encode())
    store.move(draft, f"{root}/versions/{number}.json")
    return number


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, full: bool):
        self.path, self.full, self.save = path, full, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        store, root = _store(self.path)
        name = f"data/{self.save}/part-{uuid.uuid4().hex}.json"
        file = None
        for row in iterator:
            if file is None:
                store.create_dir(f"{root}/data/{self.save}")
                file = store.open_output_stream(f"{root}/{name}")
            file.write(json.dumps({"key": row["key"], "body": row["body"]}, ensure_ascii=False).encode() + b"\n")
        if file is not None:
            file.close()
        return Written(name if file is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        _publish(self.path, sorted(m.file for m in messages if m and m.file), self.full)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/data/{self.save}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/data/{self.save}")


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], overwrite)


def save(docs: DataFrame, path: str, key: str, full: bool = False) -> None:
    """Save rows as one version: documents of their keys are replaced, others stay, unless the version is full.

    Rows with a null key are left out; of several rows of one key the one with the greatest body holds.
    """
    docs.sparkSession.dataSource.register(DocumentSource)
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*docs.columns)).alias("body"))
    rows.write.format(FORMAT).mode("overwrite" if full else "append").option("path", path).save()


def _named(path: str, version: int | None) -> list[tuple[int, str]]:
    """(version, file) of what makes up a version: back to the last full one."""
    found = _versions(path)
    last = max(found, default=0) if version is None else version
    if version is not None and version not in found:
        raise ValueError(f"there is no version {version}")
    out = []
    for number in range(last, 0, -1):
        out += [(number, file) for file in found[number]["files"]]
        if found[number]["full"]:
            break
    return out


def content_version(path: str) -> int:
    return max(_versions(path), default=0)


def read(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The documents of a version, the last if none is given: key, content_version (of its last change), and the columns of schema."""
    named = _named(path, version)
    empty = spark.createDataFrame([], "key string, body string, number long")
    rows = empty
    for number in sorted({n for n, _ in named}):
        files = [f"{path}/{file}" for n, file in named if n == number]
        rows = rows.unionByName(spark.read.schema("key string, body string").json(files).withColumn("number", F.lit(number).cast("long")))
    last = rows.groupBy("key").agg(F.max(F.struct("number", "body")).alias("last"))
    return last.select("key", F.col("last.number").alias("content_version"), F.from_json("last.body", schema).alias("d")).select("key", "content_version", "d.*")


def restore(path: str, version: int) -> int:
    """Go back to a version: a new one that names the same files.  Its number goes on rising."""
    named = _named(path, version)
    return _publish(path, [file for _, file in named], True) if len({n for n, _ in named}) <= 1 else _restored(path, version)


def _restored(path: str, version: int) -> int:
    """Of several versions: each is published again, in order, the first as full."""
    named, last = _named(path, version), 0
    for k, number in enumerate(sorted({n for n, _ in named})):
        last = _publish(path, [file for n, file in named if n == number], k == 0)
    return last
