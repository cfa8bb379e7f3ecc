"""Files of local and remote stores, through Arrow's file systems."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from fnmatch import fnmatch
from functools import cache
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tessella-files-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that names none gets one of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"file://{_own_folder()}").rstrip("/")


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@contextmanager
def opened(path: str) -> Iterator[BinaryIO]:
    store, name = located(path)
    with store.open_input_file(name) as file:
        yield file


def listed(paths: Iterable[str], extensions: Iterable[str], missing_ok: bool = False, pattern: str = "*") -> list[str]:
    """Files at or below ``paths`` with one of the extensions, without regard to case, sorted."""
    endings = tuple(f".{e.lower().lstrip('.')}" for e in extensions)
    out = []
    for path in paths:
        store, name = located(path)
        prefix = path[: len(path) - len(name)] if "://" in path else ""
        info = store.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            if missing_ok:
                continue
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(name, recursive=True))
        out += [prefix + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(endings) and fnmatch(f.path.rsplit("/", 1)[-1], pattern)]
    return sorted(set(out))


def below(path: str) -> tuple[list[str], list[str]]:
    """Folders and files directly in a folder, each sorted."""
    store, name = located(path)
    prefix = path[: len(path) - len(name)] if "://" in path else ""
    info = store.get_file_info(fs.FileSelector(name))
    return tuple(sorted(prefix + f.path for f in info if f.type == kind) for kind in (fs.FileType.Directory, fs.FileType.File))


def written(path: str, data: bytes) -> None:
    store, name = located(path)
    try:
        file = store.open_output_stream(name)
    except FileNotFoundError:
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        file = store.open_output_stream(name)
    with file:
        file.write(data)


def removed(path: str) -> None:
    store, name = located(path)
    if store.get_file_info(name).type == fs.FileType.File:
        store.delete_file(name)
