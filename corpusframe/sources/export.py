"""A sink of audio files with their manifest that commits: df.write.format("clip_export")."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .ordered import reached

ENCODED = (b"fLaC", b"RIFF")
ERRORS = "name string, error string"


@dataclass
class Attempt(WriterCommitMessage):
    """What one task has written: its own folder under the job's, and its files and errors."""

    folder: str
    files: int
    errors: int


class ClipWriter(DataSourceArrowWriter):
    """Rows (id, blob, text) as files <root>/<name>/<id>.flac and JSON lines.

    A task writes all to a folder of its own, notes the names that it is about to give, and then
    gives the files their names. The manifest's parts appear at the commit, by one rename a task, and
    earlier parts go after that; a job that fails, whatever attempts were lost on the way, takes back
    every name that one of its attempts noted. A file that was there before stays, and is not
    written again."""

    def __init__(self, options: dict, encode: Callable[[bytes], bytes] | None):
        self.root, self.name, self.manifest, self.prefix = (options[k] for k in ("root", "name", "manifest", "prefix"))
        self.job, self.encode = options["job"], encode

    def folders(self) -> tuple[tuple[fs.FileSystem, str], tuple[fs.FileSystem, str]]:
        """Where attempts keep lists, and files that have no name yet."""
        where, base = reached(self.manifest)
        there, root = reached(self.root)
        return (where, f"{base}/_staging-{self.job}"), (there, f"{root}/_staging-{self.job}")

    def begin(self) -> None:
        for where, folder in self.folders():
            where.create_dir(folder, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        (where, lists), (there, held) = self.folders()
        root = reached(self.root)[1]
        attempt = uuid.uuid4().hex
        own, put = f"{lists}/{attempt}", f"{held}/{attempt}"
        # an attempt that outlives its job finds the job's folders gone, and fails
        for at, folder in ((where, own), (there, put)):
            at.create_dir(folder, recursive=False)
        made, bad = [], 0
        with where.open_output_stream(f"{own}/rows") as rows, where.open_output_stream(f"{own}/errors") as errors:
            for batch in iterator:
                for i, blob, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    name = f"{self.name}/{i}.flac"
                    info = there.get_file_info(f"{root}/{name}")
                    if info.type != fs.FileType.File or not info.size:
                        try:
                            raw = blob if blob[:4] in ENCODED else self.encode(blob)
                        except Exception as e:  # noqa: BLE001 - the row says what went wrong
                            errors.write(json.dumps({"name": name, "error": f"{type(e).__name__}: {e}"}, ensure_ascii=False).encode() + b"\n")
                            bad += 1
                            continue
                        with there.open_output_stream(f"{put}/{len(made)}") as f:
                            f.write(raw)
                        made.append(name)
                    row = {"audio": f"{self.root}/{name}", "text": f"{self.prefix}{text}" if text is not None else None, "dialect": self.name}
                    rows.write(json.dumps(row, ensure_ascii=False).encode() + b"\n")
        with where.open_output_stream(f"{own}/names") as f:
            f.write("".join(f"{n}\n" for n in made).encode())
        for folder in {f"{root}/{n}".rpartition("/")[0] for n in made}:
            there.create_dir(folder, recursive=True)
        for k, name in enumerate(made):
            there.move(f"{put}/{k}", f"{root}/{name}")
        return Attempt(own, len(made), bad)

    def commit(self, messages: list[Attempt | None]) -> None:
        (where, lists), (there, held) = self.folders()
        base = reached(self.manifest)[1]
        for kind, folder in (("rows", base), ("errors", f"{base}-errors")):
            where.create_dir(folder, recursive=True)
            old = [f.path for f in where.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-")]
            for k, m in enumerate(m for m in messages if m is not None):
                where.move(f"{m.folder}/{kind}", f"{folder}/part-{k:05d}-{self.job}.json")
            for path in old:
                where.delete_file(path)
        where.delete_dir(lists)
        there.delete_dir(held)

    def abort(self, messages: list[Attempt | None]) -> None:
        (where, lists), (there, held) = self.folders()
        root = reached(self.root)[1]
        # attempts that still run find their folders renamed: from here on none can give a name
        there.move(held, f"{held}-gone")
        there.delete_dir(f"{held}-gone")
        where.move(lists, f"{lists}-gone")
        for f in where.get_file_info(fs.FileSelector(f"{lists}-gone", recursive=True)):
            if f.base_name == "names":
                with where.open_input_stream(f.path) as names:
                    for name in names.read().decode().splitlines():
                        if there.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                            there.delete_file(f"{root}/{name}")
        where.delete_dir(f"{lists}-gone")


class ClipExport(DataSource):
    """Options: root, name, manifest, prefix, job. Rows are (id, blob, text)."""

    encode: Callable[[bytes], bytes] | None = None

    @classmethod
    def name(cls):
        return "clip_export"

    def schema(self):
        return "id string, blob binary, text string"

    def writer(self, schema, overwrite):
        out = ClipWriter(dict(self.options), type(self).encode)
        out.begin()
        return out


def export_clips(clips: DataFrame, name: str, root: str, manifest: str, prefix: str = "", encode: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """Write clips (id, blob, text) once, now; gives the errors (name, error), which are kept beside
    the manifest. root and manifest are URIs or paths that the driver and every executor reach. Bytes that are
    FLAC or WAV stay as they are; others go through encode(). An id that comes twice is one file
    with two rows."""
    spark = clips.sparkSession

    class Export(ClipExport):
        pass

    Export.encode = staticmethod(encode) if encode else None
    spark.dataSource.register(Export)
    told = {"root": root, "name": name, "manifest": manifest, "prefix": prefix, "job": uuid.uuid4().hex}
    clips.select("id", "blob", "text").write.format("clip_export").options(**told).mode("append").save()
    return spark.read.schema(ERRORS).json(f"{manifest}-errors")
