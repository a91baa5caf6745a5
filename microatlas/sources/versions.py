"""Tables that are replaced whole or not at all.

A new state of a table is written beside the one that is served, in a folder of its own, and
takes effect when a pointer with the next number appears, by one rename that fails if
another writer was first. A write that fails or is killed leaves no pointer, so readers
never see it; a reader that has opened a version keeps it until it is cleared away.

    <path>/_published/00000003      the name of a folder
    <path>/version-00000003-1f0c... its files
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTERS = "_published"


class LostRace(RuntimeError):
    """Another writer has published the same number first."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def published(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the published versions, in order. Lists pointers only."""
    files, pointers = _files(spark, path), _path(spark, path, POINTERS)
    if not files.exists(pointers):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(pointers) if s.getPath().getName().isdigit())
    out = []
    for name in names:
        stream = files.open(_path(spark, path, POINTERS, name))
        try:
            folder = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        out.append((int(name), f"{path.rstrip('/')}/{folder}"))
    return out


def current(spark: SparkSession, path: str) -> str:
    """The folder that is served: the last published one, or the path itself of a table
    without versions."""
    versions = published(spark, path)
    return versions[-1][1] if versions else path


def replace(spark: SparkSession, path: str, write: Callable[[str], None], last: str = "") -> str:
    """Write a new version with ``write(folder)`` and publish it; returns the folder.

    Whatever ``write`` raises comes through, and the table stays as it was. ``last`` is the
    subfolder that is written last, if the version has several.
    """
    versions = published(spark, path)
    number = versions[-1][0] + 1 if versions else 1
    folder = f"version-{number:08d}-{uuid.uuid4().hex}"
    write(f"{path.rstrip('/')}/{folder}")
    files = _files(spark, path)
    if not files.exists(_path(spark, path, folder, *([last] if last else []), "_SUCCESS")):
        raise RuntimeError(f"{folder} was not committed")
    _publish(spark, path, number, folder)
    return f"{path.rstrip('/')}/{folder}"


def _publish(spark: SparkSession, path: str, number: int, folder: str) -> None:
    jvm, files = spark._jvm, _files(spark, path)
    files.mkdirs(_path(spark, path, POINTERS))
    draft = _path(spark, path, POINTERS, f".{folder}")
    stream = files.create(draft, True)
    try:
        stream.write(bytearray(folder.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    target = files.makeQualified(_path(spark, path, POINTERS, f"{number:08d}"))
    try:
        context.rename(files.makeQualified(draft), target, no_options)
    except Exception as error:
        files.delete(draft, False)
        if files.exists(target):
            raise LostRace(f"version {number} of {path} is published already") from error
        raise


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a folder inside a version that is being written."""
    if not _files(spark, path).rename(_path(spark, path), _path(spark, to)):
        raise RuntimeError(f"{path} was not renamed to {to}")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder inside a version that is being written."""
    _files(spark, path).delete(_path(spark, path), True)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The served version of a Parquet table, or one of its published numbers."""
    if version is None:
        return spark.read.parquet(current(spark, path))
    return spark.read.parquet(dict(published(spark, path))[version])


def clear(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the last ``keep`` published versions, and folders that no pointer names
    and that are older than the oldest kept one; returns the deleted folders' names.

    Pointers go first, so no reader finds a version that is being deleted. Folders with
    later numbers may still be written and stay.
    """
    files, versions = _files(spark, path), published(spark, path)
    if keep < 1 or not versions:
        return []
    kept = versions[-keep:]
    for number, _ in versions[:-keep]:
        files.delete(_path(spark, path, POINTERS, f"{number:08d}"), False)
    names = {folder.rsplit("/", 1)[1] for _, folder in kept}
    gone = []
    for status in files.listStatus(_path(spark, path)):
        name = status.getPath().getName()
        if name.startswith("version-") and name not in names and int(name.split("-")[1]) <= kept[-1][0]:
            files.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
