"""A commit log for table versions: prepare, then publish by one exclusive rename.

A version is one small JSON file ``_commits/<number>.json`` that names the data folders
of the table (``parts``) and its parent.  Data is written to fresh folders first, so a
writer that dies leaves nothing that a reader can see.  Publishing renames a finished
file onto the next number; the rename fails if the number is taken, so of two writers
that start from one parent only one can publish (atomic where the file system's
rename without overwrite is, as on HDFS).  Files are reached through Hadoop's API, so
the log can be wherever Spark can write.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

COMMITS = "_commits"


class CommitConflict(RuntimeError):
    """Another writer has published a version since the parent was read."""


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs_of = self._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._fs_of.Path(self.path).getFileSystem(self._conf)

    def _at(self, name: str):
        return self._fs_of.Path(f"{self.path}/{COMMITS}/{name}")

    def last_version(self) -> int:
        """The newest version, -1 if there is none.  A log with a gap, or one that does not begin at 0, is refused."""
        if not self._fs.exists(self._at(".")):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("."))]
        found = sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))
        if found != list(range(len(found))):
            raise RuntimeError(f"{self.path}/{COMMITS} is truncated or incomplete: a version is missing")
        return len(found) - 1

    def entry(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"{version:020d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> dict | None:
        version = self.last_version()
        return None if version < 0 else self.entry(version)

    def fresh_part(self) -> str:
        """A folder for new data, unseen until a published version names it."""
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def publish(self, parent: int, parts: list[str], **more) -> int:
        """Make ``parts`` the next version after ``parent``; raises ``CommitConflict`` if there is one already."""
        version = parent + 1
        text = json.dumps({"version": version, "parent": parent, "parts": parts, **more})
        ready = self._at(f".{uuid.uuid4().hex}.ready")
        out = self._fs.create(ready, False)
        out.write(bytearray(text.encode()))
        out.close()
        files = self._fs_of.FileContext.getFileContext(ready.getFileSystem(self._conf).getUri(), self._conf)
        none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.org.apache.hadoop.fs.Options.Rename.NONE.getDeclaringClass(), 0)
        try:
            files.rename(self._fs.makeQualified(ready), self._fs.makeQualified(self._at(f"{version:020d}.json")), none)
        except Exception as e:
            self._fs.delete(ready, False)
            if "FileAlreadyExistsException" in str(e):
                raise CommitConflict(f"version {version} of {self.path} is published already") from e
            raise
        return version
