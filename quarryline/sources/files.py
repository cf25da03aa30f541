"""File sources: walks, texts, nested repositories, the registry."""

from __future__ import annotations

import json
import os
import re
import stat
import time
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.code_text import short_hash
from quarryline.operators.ignore import PROJECT_IGNORE, should_skip_directory, skip_reason
from quarryline.session import ship


def _plain(root: str) -> str | None:
    """The path of a folder of the local file system, none for other stores."""
    at = re.sub(r"^file:/*(?=/)", "", root)
    return None if "://" in at else at


def _local_tree(root: str) -> Iterator[tuple]:
    for folder, dirs, names in os.walk(root):  # unreadable folders give nothing
        dirs[:] = [d for d in dirs if not should_skip_directory(d)]
        for name in names:
            at = Path(folder, name)
            try:
                found = at.stat()
            except OSError:
                continue
            if stat.S_ISREG(found.st_mode):
                yield at.relative_to(root).as_posix(), str(at), found.st_mtime * 1000, found.st_size


def _stored_tree(spark: SparkSession, root: str) -> Iterator[tuple]:
    """The same by Spark's own file systems."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    todo = [("", top)]
    while todo:
        above, folder = todo.pop()
        for found in fs.listStatus(folder):
            name = found.getPath().getName()
            if not found.isDirectory():
                yield above + name, found.getPath().toString(), float(found.getModificationTime()), found.getLen()
            elif not should_skip_directory(name):
                todo.append((f"{above}{name}/", found.getPath()))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Names of all files below a folder: path, disk_path, disk_mtime (ms),
    disk_size.  Denied directories are not entered.  The names of one
    workspace are listed on the driver; nothing is read."""
    plain = _plain(root)
    rows = list(_local_tree(plain) if plain else _stored_tree(spark, root))
    return ship(spark).createDataFrame(rows, "path string, disk_path string, disk_mtime double, disk_size long")


def _read_local(batches: Iterator) -> Iterator:
    """Reads listed files where their tasks run."""
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            try:
                content = Path(row["disk_path"]).read_bytes()
            except OSError:
                continue  # gone or unreadable since it was listed
            yield pa.RecordBatch.from_pylist([{**row, "content": content}], schema=pa.schema([*batch.schema, ("content", pa.binary())]))


def walk(spark: SparkSession, root: str, *, ignore_files: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Files below a folder that path rules keep: path (relative), disk_path,
    disk_mtime (ms), disk_size."""
    rows = listing(spark, root).filter(skip_reason(F.col("path"), ignore_files).isNull())
    return rows.orderBy("path").limit(limit) if limit is not None else rows


def read_texts(spark: SparkSession, root: str, *, ignore_files: dict[str, str] | None = None, paths: Iterable[str] | None = None) -> DataFrame:
    """Kept files with their text (UTF-8) and hash: path, source, hash, size,
    mtime.  Files are listed, filtered and only then read; with ``paths`` only
    these are looked at."""
    plain = _plain(root)
    if paths is None:
        kept = walk(spark, root, ignore_files=ignore_files)
    else:
        named = []
        for path in dict.fromkeys(paths):
            at = Path(plain or "/", path)
            if plain and at.is_file():
                named.append((path, str(at), at.stat().st_mtime * 1000, at.stat().st_size))
            elif not plain:
                named.append((path, f"{root.rstrip('/')}/{path}", None, None))
        kept = ship(spark).createDataFrame(named, "path string, disk_path string, disk_mtime double, disk_size long").filter(skip_reason(F.col("path"), ignore_files).isNull())
    if plain:
        rows = kept.mapInArrow(_read_local, "path string, disk_path string, disk_mtime double, disk_size long, content binary")
    else:
        there = [(r.path, r.disk_path) for r in kept.select("path", "disk_path").collect()]  # names of one workspace
        raw = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load([d for _, d in there]) if there else None
        names = spark.createDataFrame(there, "path string, disk_path string")
        rows = names.withColumns({"content": F.lit(None).cast("binary"), "disk_mtime": F.lit(0.0), "disk_size": F.lit(0)}).limit(0)
        if raw is not None:
            raw = raw.select(F.col("path").alias("_at"), "content", (F.unix_micros("modificationTime") / 1000.0).alias("disk_mtime"), F.col("length").alias("disk_size"))
            rows = names.join(raw, F.col("disk_path") == F.col("_at"))
    text = F.expr("try_validate_utf8(decode(content, 'UTF-8'))")
    return rows.select("path", text.alias("source"), short_hash(F.col("content")).alias("hash"), F.col("disk_size").alias("size"), F.col("disk_mtime").alias("mtime"))


def ignore_files(root: str) -> dict[str, str]:
    """Texts of all ignore files below a local folder, by relative path."""
    out = {}
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if not should_skip_directory(d)]
        for name in names:
            if name in (".gitignore", PROJECT_IGNORE):
                p = Path(folder, name)
                out[p.relative_to(root).as_posix()] = p.read_text(errors="replace")
    return out


def nested_repos(root: str, most: int = 20) -> list[str]:
    """Child folders that are repositories, unless the root is one itself."""
    if Path(root, ".git").exists():
        return []
    found = sorted(p.name for p in Path(root).iterdir() if p.is_dir() and not p.name.startswith(".") and (p / ".git").exists())
    return found[:most]


class Registry:
    """Known workspaces in one small JSON file."""

    def __init__(self, path: str, clock=lambda: int(time.time() * 1000)):
        self.path, self.clock = Path(path), clock

    def _load(self) -> dict[str, dict]:
        try:
            return json.loads(self.path.read_text())
        except (OSError, ValueError):
            return {}

    def _store(self, entries: dict) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        scratch = self.path.with_suffix(".new")
        scratch.write_text(json.dumps(entries, indent=1, sort_keys=True))
        scratch.replace(self.path)

    def list(self) -> list[dict]:
        """Entries, the last used first."""
        return sorted(({"workspace": k, **v} for k, v in self._load().items()), key=lambda e: (-e["last_used"], e["workspace"]))

    def remember(self, workspace: str, index: str) -> None:
        entries, now = self._load(), self.clock()
        old = entries.get(workspace, {"created_at": now})
        entries[workspace] = {**old, "index": index, "last_used": now}
        self._store(entries)

    def forget(self, workspace: str) -> int:
        """Drop an entry and its index; bytes that were freed."""
        entries = self._load()
        entry = entries.pop(workspace, None)
        if entry is None:
            return 0
        freed, folder = 0, Path(entry["index"])
        for p in sorted(folder.rglob("*"), reverse=True) if folder.is_dir() else ():
            if p.is_dir():
                p.rmdir()
            else:
                freed += p.stat().st_size
                p.unlink()
        if folder.is_dir():
            folder.rmdir()
        self._store(entries)
        return freed
