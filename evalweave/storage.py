"""Shared storage: where intermediate tables go and which versions exist."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _single_machine_dir() -> str:
    path = tempfile.mkdtemp(prefix="evalweave-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


# Intermediate tables by application.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors can reach.

    A local-mode session without that setting, where driver and executors are one
    process, gets a folder of its own, which is deleted when the process ends; any other
    session must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _single_machine_dir()
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; ``discard`` deletes what is written there."""
    path = f"{shared_dir(spark)}/evalweave/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used after costly steps that several later steps read (model calls above all): a
    written table survives the loss of executors and is never computed twice.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Delete all intermediate tables of this session.

    They are needed as long as a result that was derived from them is still to be read.
    """
    for path in _made.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def _file_system(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system; a path of this machine's disks as it is."""
    fs, location = _file_system(spark, path)
    if fs.getScheme() == "file":
        return location.toUri().getPath()
    return fs.makeQualified(location).toString()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on the path's file system."""
    fs, location = _file_system(spark, path)
    return fs.exists(location)


def children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of all folders and files under a path with a prefix."""
    fs, location = _file_system(spark, path)
    if not fs.exists(location):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(location)]
    return sorted(name for name in names if name.startswith(prefix))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder and all it holds, if it exists."""
    fs, location = _file_system(spark, path)
    fs.delete(location, True)


_VERSION = "version-"


def newest_version(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and content of the newest published version; ``(0, None)`` before the first."""
    names = children(spark, path, _VERSION)
    if not names:
        return 0, None
    content = spark.read.text(f"{path}/{names[-1]}", wholetext=True).first()[0]
    return int(names[-1].removeprefix(_VERSION)), content


def versions(spark: SparkSession, path: str, newest: int | None = None) -> list[tuple[int, str]]:
    """Numbers and contents of the published versions, the newest first."""
    names = children(spark, path, _VERSION)[::-1][:newest]
    if not names:
        return []
    files = spark.read.text([f"{path}/{n}" for n in names], wholetext=True)
    rows = files.select("value", "_metadata.file_name").collect()
    return sorted(((int(r[1].removeprefix(_VERSION)), r[0]) for r in rows), reverse=True)


# A folder that was begun on one of this many newest versions may still be published.
PROTECTED = 10


def attempt_name(version: int) -> str:
    """A new name for a folder of files that are to be published after ``version``."""
    return f"{version}-{uuid.uuid4().hex}"


def vacuum(
    spark: SparkSession,
    path: str,
    keep: int,
    prefix: str,
    named_by: Callable[[str], set[str]],
) -> list[str]:
    """Delete old and lost folders of a versioned table; returns their names.

    ``prefix`` begins the folders' names, an ``attempt_name`` follows, and ``named_by`` lists
    the folders that a version's content names. Kept are those of the newest ``keep`` versions
    and, as their writer may not have finished, those that were begun on one of the newest
    ``max(keep, PROTECTED)``: a writer must not publish what it began on an older one. Files
    of older versions are deleted after their folders, so that a version whose folders are
    gone is not left behind; the newest version always stays.
    """
    if keep < 1:
        raise ValueError("the newest version is always kept")
    folders = children(spark, path, prefix)
    found = versions(spark, path)
    if not found:
        return []
    newest = found[0][0]
    needed = {name for _, content in found[:keep] for name in named_by(content)}
    oldest_writer = newest - max(keep, PROTECTED)

    def begun(folder: str) -> int:
        number = folder.removeprefix(prefix).partition("-")[0]
        return int(number) if number.isdecimal() else newest

    gone = [f for f in folders if f not in needed and begun(f) < oldest_writer]
    lost = {*gone}
    for folder in gone:
        delete(spark, f"{path}/{folder}")
    for number, content in found[keep:]:
        if named_by(content) & lost:
            delete(spark, f"{path}/{_VERSION}{number:010d}")
    return gone


def publish_version(spark: SparkSession, path: str, number: int, content: str) -> bool:
    """Create version ``number`` with its content in one step; False if it already exists.

    The content is complete before the name appears: it is written under another name,
    which then becomes the version's by a link (local files) or a rename (others, where
    renaming onto an existing file fails, as in HDFS).
    """
    fs, location = _file_system(spark, path)
    target = f"{location.toUri().getPath()}/{_VERSION}{number:010d}"
    # Names that begin with "_" are not read as data.
    draft = f"{location.toUri().getPath()}/_draft-{uuid.uuid4().hex}"
    fs.mkdirs(location)
    if fs.getScheme() == "file":
        Path(draft).write_text(content)
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    out = fs.create(new_path(draft), False)
    out.write(bytearray(content.encode()))
    out.close()
    if not fs.exists(new_path(target)) and fs.rename(new_path(draft), new_path(target)):
        return True
    fs.delete(new_path(draft), False)
    return False
