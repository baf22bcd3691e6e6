"""A sink that commits or refuses: documents and diagnostics are written in one job, and losses are counted as they pass.

Each task writes files of its own into a staging folder and tells the driver their names and its losses by code. The
commit moves the files of the tasks that succeeded into place, or, if anything was lost, deletes all and fails.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from docweft.plans.session import ship_package
from docweft.sources.sinks import LOSSES, LossError

FOLDERS = ("documents", "diagnostics")
_REFUSED = "refused, as this would be lost: "


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: (folder, file) pairs, and its losses by code, of which there are as many as rules."""

    files: list[tuple[str, str]] = field(default_factory=list)
    lost: Counter = field(default_factory=Counter)


class GatedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, allow_loss: bool):
        self.path, self.allow_loss, self.staging = path, allow_loss, f"_staging-{uuid.uuid4()}"

    def _at(self, *parts: str) -> tuple[fs.FileSystem, str]:
        if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", self.path):
            system, root = fs.FileSystem.from_uri(self.path)
        else:
            system, root = fs.LocalFileSystem(), self.path
        return system, "/".join([root.rstrip("/"), *parts])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, open_ = Written(), {}
        system, folder = self._at(self.staging)
        try:
            for batch in iterator:
                kinds, values, codes, severities = (batch.column(c).to_pylist() for c in ("kind", "value", "code", "severity"))
                done.lost.update(c or "unknown" for c, s in zip(codes, severities, strict=True) if s in LOSSES)
                for kind, value in zip(kinds, values, strict=True):
                    if kind not in open_:
                        system.create_dir(folder, recursive=True)
                        name = f"part-{uuid.uuid4()}.json"
                        open_[kind] = system.open_output_stream(f"{folder}/{name}")
                        done.files.append((kind, name))
                    open_[kind].write(value.encode() + b"\n")
        finally:
            for stream in open_.values():
                stream.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        lost = sum((m.lost for m in messages if m), Counter())
        if lost and not self.allow_loss:
            self._clear()
            raise LossError(_REFUSED + ", ".join(f"{c}: {n}" for c, n in sorted(lost.items())) + ";")
        system, folder = self._at(self.staging)
        for name in FOLDERS:
            system.create_dir(self._at(name)[1], recursive=True)
        for m in messages:
            for kind, name in m.files if m else ():
                system.move(f"{folder}/{name}", self._at(kind, name)[1])
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, folder = self._at(self.staging)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class GatedSink(DataSource):
    """(kind, value, code, severity): lines for one of FOLDERS; option allowLoss."""

    @classmethod
    def name(cls) -> str:
        return "gated-documents"

    def writer(self, schema, overwrite: bool) -> GatedWriter:
        return GatedWriter(self.options["path"], self.options.get("allowloss", "false") == "true")


def write_gated(documents: DataFrame, diagnostics: DataFrame, path: str, json: str = "json", allow_loss: bool = False) -> None:
    """Write documents and diagnostics below path in one job, or nothing and LossError, which names the losses by code.

    path is a folder that driver and executors share; it gets documents/ and diagnostics/, a line each, beside what is there
    already. Losses are diagnostics whose severity is lossy or unsupported; allow_loss writes them too. Null documents are
    left out; repeated rows are written as often as they come; of empty tables the two folders remain. A task that is run
    again writes new files, and those of lost attempts go with the staging folder.
    """
    spark = ship_package(documents.sparkSession)
    spark.dataSource.register(GatedSink)
    none = F.lit(None).cast("string")
    docs = documents.where(F.col(json).isNotNull()).select(F.lit(FOLDERS[0]).alias("kind"), F.col(json).alias("value"), none.alias("code"), none.alias("severity"))
    said = diagnostics.select(F.lit(FOLDERS[1]).alias("kind"), F.to_json(F.struct("*")).alias("value"), "code", "severity")
    try:
        docs.union(said).write.format(GatedSink.name()).mode("append").option("allowLoss", str(allow_loss).lower()).save(path)
    except PySparkException as e:
        found = re.search(re.escape(_REFUSED) + "([^;]*);", str(e))
        if found:
            raise LossError(found[1]) from None
        raise
