"""Places and small files that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class NoSharedFolder(RuntimeError):
    """A cluster session names no folder that its machines share."""


def _file(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system; a path without scheme belongs to the session's default one."""
    system, made = _file(spark, path)
    return system.makeQualified(made).toString()


def base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which is also made the checkpoint directory if there is none yet.

    Only a session of one machine (as in tests) may leave it unset; it gets a temporary folder.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="canopy-")
    found = qualified(spark, found)
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def folder(spark: SparkSession, purpose: str) -> str:
    """A new name below the shared folder."""
    return f"{base(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that isn't there yet; False, and nothing is changed, if it is.

    The text is written to a draft beside it and published in one step that doesn't
    replace: a hard link on local file systems, else a rename.  So a reader sees the
    whole file or none, and a writer that dies leaves only a draft, which no reader
    looks at.  HDFS renames so; plain object stores don't, they need a connector whose
    rename is atomic and refuses a name that exists.
    """
    system, made = _file(spark, path)
    jvm, folder, name = spark._jvm, *path.rsplit("/", 1)
    draft = system.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{folder}/.{name}.{uuid.uuid4().hex}"))
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if system.getScheme() == "file":
            ends = [jvm.java.io.File(system.makeQualified(x).toUri().getPath()).toPath() for x in (made, draft)]
            jvm.java.nio.file.Files.createLink(*ends)
        else:
            keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, system.makeQualified(made), keep)
    except Py4JJavaError as error:
        if system.exists(made):
            return False
        raise error
    finally:
        if system.exists(draft):
            system.delete(draft, False)
    return True


def read(spark: SparkSession, path: str) -> str:
    system, made = _file(spark, path)
    stream = system.open(made)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, ascending, without drafts; none if there is no folder."""
    system, made = _file(spark, path)
    found = sorted(s.getPath().getName() for s in system.listStatus(made)) if system.exists(made) else []
    return [n for n in found if not n.startswith(".")]


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Length and time of change of a file."""
    system, made = _file(spark, path)
    status = system.getFileStatus(made)
    return status.getLen(), status.getModificationTime()
