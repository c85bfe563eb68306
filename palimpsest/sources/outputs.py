"""Outputs as files, one for each merged group: a writer that Spark commits or aborts as a whole.

    results.write.format("annotated").mode("append").option("path", root).save()

Rows are (source, batch, doc, content); each becomes ``{root}/{source}/{batch}/{doc}_merged.json``.
Tasks write below a folder of the job's own, each attempt in its own place.  Once all
have ended, the files of the attempts that count are moved to where they belong; if one
fails, the folder goes and nothing else has been touched; an object store may keep what a
task writes there after that.  A file that is there already is
replaced.  Moving is the driver's work, a file a time, as with Spark's own files.

The folder is reached through ``pyarrow.fs``, so any file system that it knows will do.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "source string, batch string, doc string, content string"
STAGING = "_staging"


def safe(name: str | None) -> str:
    """A name as one part of a path: letters, digits and ``._-``; others are escaped, so that different names stay different."""
    own = re.sub(r"[^A-Za-z0-9._-]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), name if name is not None else "unknown")
    return {"": "%", ".": "%2E", "..": "%2E%2E"}.get(own, own)


@dataclass
class Written(WriterCommitMessage):
    """The files of a task's attempt, numbered in its folder: the name that each gets."""

    folder: str
    names: list[str]


class OutputWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.files, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
        self.root = root.rstrip("/")
        self.job = f"{self.root}/{STAGING}-{uuid.uuid4().hex}"
        self.files.create_dir(self.job, recursive=True)

    def write(self, rows: Iterator[Row]) -> Written:
        folder, names = f"{self.job}/{uuid.uuid4().hex}", []
        # Not with its parents: a task that is still at work when the job is aborted finds no folder to write to.
        self.files.create_dir(folder, recursive=False)
        for row in rows:
            with self.files.open_output_stream(f"{folder}/{len(names)}") as out:
                out.write((row.content or "").encode())
            names.append(f"{safe(row.source)}/{safe(row.batch)}/{safe(row.doc)}_merged.json")
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for i, name in enumerate(m.names if m else ()):
                self.files.create_dir(f"{self.root}/{name}".rpartition("/")[0], recursive=True)
                self.files.move(f"{m.folder}/{i}", f"{self.root}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        if self.files.get_file_info(self.job).type != fs.FileType.NotFound:
            self.files.delete_dir(self.job)


class AnnotatedOutputs(DataSource):
    """Registered as ``annotated``; for writing only."""

    @classmethod
    def name(cls) -> str:
        return "annotated"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> OutputWriter:
        if overwrite:
            raise ValueError("outputs are added to what is there: use mode append")
        return OutputWriter(self.options["path"])


def write_outputs(outputs: DataFrame, docs: DataFrame, root: str) -> None:
    """The annotated texts (group_id, base_id, merged_text, spans) as files, by source and batch of their base (id, source, release_batch)."""
    outputs.sparkSession.dataSource.register(AnnotatedOutputs)
    own = outputs.join(docs.select(F.col("id").alias("base_id"), "source", F.col("release_batch").alias("batch")), "base_id")
    content = F.to_json(F.struct("group_id", "base_id", "merged_text", "spans"))
    own.select("source", "batch", F.col("base_id").alias("doc"), content.alias("content")).write.format("annotated").mode("append").option("path", root).save()
