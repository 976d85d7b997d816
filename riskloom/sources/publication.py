"""Versions of tables that belong together, published by one small file that is written last.

Everything of a version lies under ``path/<name>/<version>``. Nothing is ever overwritten. A version exists for
readers from the moment its file appears under ``path/published``; creating one file happens or does not, on
file systems and object stores alike. So a reader sees all of a version or all of the one before, and a
writer that dies leaves the published version as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

POINTERS = "published"


class NothingPublished(ValueError):
    """No version has been published under a path."""


def file_system(spark: SparkSession, path: str):
    """The file system of ``path`` and the path as it knows it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies directly under ``path``, sorted; nothing where it does not exist."""
    system, folder = file_system(spark, path)
    if not system.exists(folder):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(folder))


def versions(spark: SparkSession, path: str) -> list[str]:
    """The published versions, oldest first."""
    return [name for name in names(spark, f"{path}/{POINTERS}") if not name.startswith((".", "_"))]


def new_version(spark: SparkSession, path: str) -> str:
    """A name that no other writer uses and that follows all published ones."""
    known = versions(spark, path)
    number = int(known[-1].split("-")[0]) + 1 if known else 1
    return f"{number:010d}-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Make ``version`` the current one. All of it must have been written."""
    system, pointer = file_system(spark, f"{path}/{POINTERS}/{version}")
    system.create(pointer, False).close()


def current(spark: SparkSession, path: str) -> str:
    """The version that was published last."""
    known = versions(spark, path)
    if not known:
        raise NothingPublished(f"nothing has been published under {path}")
    return known[-1]


def retire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove all but the last ``keep`` published versions and what dead writers left before them.

    A version loses its file first. Readers that hold an old version must be done with it; versions that are
    still being written come after the current one and stay.
    """
    if keep < 1:
        raise ValueError("the current version cannot be retired")
    known = versions(spark, path)
    if not known:
        return []
    oldest = known[-keep:][0]
    gone = [version for version in known if version < oldest]
    for version in gone:
        system, pointer = file_system(spark, f"{path}/{POINTERS}/{version}")
        system.delete(pointer, False)
    for name in names(spark, path):
        for version in names(spark, f"{path}/{name}") if name != POINTERS else []:
            number = version.split("-")[0]
            if number.isdigit() and version < oldest:
                system, folder = file_system(spark, f"{path}/{name}/{version}")
                system.delete(folder, True)
    return gone
