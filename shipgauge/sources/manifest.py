"""Tables that change by whole versions.

Data is written to folders that no writer shares and nobody overwrites. A version is
one small file that lists the folders which make up the table, with the numbers that
writers need. It is put under the next number only if no version has that number, so
it is there whole or not at all: readers see the table before a change or after it,
and of two writers who started from one version the later starts again from the
other's. What a stopped writer leaves behind is in no version.

Needs a file system whose rename does not overwrite (HDFS, local files).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"(\d{20})\.json")


class Manifest:
    """``parts``: name -> facts of one folder or two, ``path`` and ``facts`` below ``root`` among them; ``notes``: the writers' own numbers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._versions = f"{self.root}/versions"

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def _numbers(self) -> list[int]:
        folder = self._path(self._versions)
        if not self._fs().exists(folder):
            return []
        names = (_NAME.fullmatch(s.getPath().getName()) for s in self._fs().listStatus(folder))
        return sorted(int(m.group(1)) for m in names if m)

    def _load(self, number: int) -> dict:
        stream = self._fs().open(self._path(f"{self._versions}/{number:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def current(self) -> tuple[int, dict]:
        """Number and content of the last version; 0 and nothing before the first."""
        numbers = self._numbers()
        return (numbers[-1], self._load(numbers[-1])) if numbers else (0, {"parts": {}, "notes": {}})

    def parts(self) -> dict[str, dict]:
        return self.current()[1]["parts"]

    def new_folder(self, name: str) -> str:
        """A folder below ``root`` that nobody else writes to."""
        return f"data/part={name}-{uuid.uuid4().hex}"

    def absolute(self, path: str) -> str:
        return f"{self.root}/{path}"

    def _put(self, number: int, content: dict) -> bool:
        """Whether this became version ``number``."""
        draft = self._path(f"{self._versions}/.{uuid.uuid4().hex}.tmp")
        out = self._fs().create(draft, True)
        out.write(json.dumps(content, sort_keys=True).encode())
        out.close()
        kinds = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        try:
            files.rename(self._fs().makeQualified(draft), self._fs().makeQualified(self._path(f"{self._versions}/{number:020d}.json")), options)
            return True
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            self._fs().delete(draft, False)
            return False

    def change(self, edit: Callable[[dict, dict], bool | None]) -> bool:
        """Commits what ``edit(parts, notes)`` makes of the last version; False if it declines by returning False.

        Where another writer was faster, ``edit`` is called again on that one's version.
        """
        while True:
            number, content = self.current()
            if edit(content["parts"], content["notes"]) is False:
                return False
            if self._put(number + 1, content):
                return True

    def read(self, paths: list[str], schema: str, partitioned: bool = False) -> DataFrame:
        """Folders of the table together, with folders by column values in them if ``partitioned``; none give an empty table."""
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        if partitioned:
            reader = reader.option("basePath", self.absolute("data"))
        return reader.parquet(*map(self.absolute, paths)).drop("part")

    def drop(self, path: str) -> None:
        self._fs().delete(self._path(self.absolute(path)), True)

    def _folders(self, numbers: list[int]) -> set[str]:
        return {p[k] for n in numbers for p in self._load(n)["parts"].values() for k in ("path", "facts") if k in p}

    def vacuum(self, keep: int = 2) -> None:
        """Removes versions before the last ``keep``, and folders that only those list.

        Folders in no version may be a running writer's, so they stay.
        """
        numbers = self._numbers()
        old = numbers[:-keep]
        for path in self._folders(old) - self._folders(numbers[-keep:]):
            self.drop(path)
        for number in old:
            self._fs().delete(self._path(f"{self._versions}/{number:020d}.json"), False)
