"""Small files in a folder that Spark's file systems reach."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import SparkSession


class Folder:
    """A folder and the small files in it; each is there as a whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        context = self.spark.sparkContext
        p = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return p.getFileSystem(context._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(name)
        return fs.exists(p)

    def names(self, name: str = "") -> list[str]:
        """What is in a folder."""
        fs, p = self._fs(name)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def numbers(self, name: str, before: str = "") -> list[int]:
        """The numbers that follow ``before`` in the names within a folder."""
        return [int(n[len(before) :]) for n in self.names(name) if n.startswith(before) and n[len(before) :].isdigit()]

    def read(self, name: str) -> str:
        fs, p = self._fs(name)
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        fs, p = self._fs(name)
        fs.delete(p, True)

    def _new(self, name: str, text: str):
        """A file of another name in the same folder."""
        fs, new = self._fs(f"{name.rpartition('/')[0]}/.new-{uuid.uuid4().hex}".lstrip("/"))
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        return fs, new

    def _rename(self, new, name: str, how: str) -> None:
        _, last = self._fs(name)
        context = self.spark.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs
        options = context._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = getattr(hadoop.Options.Rename, how)
        hadoop.FileContext.getFileContext(last.toUri(), context._jsc.hadoopConfiguration()).rename(new, last, options)

    def write(self, name: str, text: str) -> None:
        """Make or replace a file."""
        self._rename(self._new(name, text)[1], name, "OVERWRITE")

    def claim(self, name: str, text: str) -> bool:
        """Make a file unless there is one; of several that try at once one succeeds.

        On a local disk a second name is linked to the written file, elsewhere it is renamed; both fail if the
        name is taken. A store has to have such a renaming, as HDFS has.
        """
        if self.exists(name):
            return False
        fs, new = self._new(name, text)
        _, last = self._fs(name)
        try:
            if fs.makeQualified(new).toUri().getScheme() == "file":
                nio = self.spark.sparkContext._jvm.java.nio.file
                at = lambda p: nio.Path.of(fs.makeQualified(p).toUri())
                nio.Files.createLink(at(last), at(new))
            else:
                self._rename(new, name, "NONE")
        except (Py4JJavaError, CapturedException):
            if self.exists(name):
                return False
            raise
        finally:
            fs.delete(new, True)
        return True
