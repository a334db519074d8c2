"""Files under exact names, written in two phases.

Spark names the files of its own writers; readers of run folders and result
tables look for fixed names. Here tasks stage files below the root, in a folder
per attempt, and the driver moves what the attempts that count have staged to
the final names. A failing job leaves nothing but its root; if the driver is lost
amid the moves, the job is to be run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FORMAT = "spanloom_named_files"


def _named_files() -> type:
    """The data source; a class made here travels to tasks by value."""
    import re
    import time
    import uuid
    from dataclasses import dataclass

    from pyarrow import fs
    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

    @dataclass
    class Staged(WriterCommitMessage):
        folder: str | None

    def merge(place, source: str, target: str) -> None:
        """Move a file or tree to its place; whole folders where none is there yet."""
        kind = place.get_file_info(target).type
        if kind == fs.FileType.Directory:
            for child in place.get_file_info(fs.FileSelector(source)):
                merge(place, child.path, f"{target}/{child.base_name}")
            return
        if kind == fs.FileType.File:
            place.delete_file(target)
        place.move(source, target)

    class Writer(DataSourceArrowWriter):
        def __init__(self, root: str, header: str) -> None:
            self.root, self.header = root, header.encode()
            self.staging = f"_staging-{uuid.uuid4().hex}"
            # Made here only: a task that outlives its job finds it gone and ends.
            place, base = self._open()
            place.create_dir(f"{base}/{self.staging}", recursive=True)

        def _open(self):
            place, base = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.root))
            return place, base.rstrip("/")

        def write(self, iterator):
            place, base = self._open()
            folder = f"{base}/{self.staging}/{uuid.uuid4().hex}"
            current, out = None, None
            try:
                for batch in iterator:
                    # contents may be large: written out of the batch, never as a list of strings beside it
                    for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                        if name is None:
                            raise ValueError("a file has no path")
                        if name != current:
                            if out is not None:
                                out.close()
                            target = f"{folder}/{name}"
                            if place.get_file_info(target).type != fs.FileType.NotFound:
                                raise ValueError(f"rows of {name} are not together")
                            if place.get_file_info(f"{base}/{self.staging}").type == fs.FileType.NotFound:
                                raise RuntimeError("the job has ended")
                            step = folder
                            place.create_dir(step, recursive=False)
                            for part in name.split("/")[:-1]:
                                step = f"{step}/{part}"
                                place.create_dir(step, recursive=False)
                            out, current = place.open_output_stream(target), name
                            out.write(self.header)
                        if content.is_valid:
                            out.write(content.as_buffer())
            finally:
                if out is not None:
                    out.close()
            return Staged(folder if current is not None else None)

        def commit(self, messages) -> None:
            place, base = self._open()
            place.create_dir(base, recursive=True)
            for message in messages:
                if message is not None and message.folder is not None:
                    merge(place, message.folder, base)
            self._clear(place, base)

        def abort(self, messages) -> None:
            self._clear(*self._open())

        def _clear(self, place, base: str) -> None:
            # attempts that failed or came second are in there too, some still writing
            staged = f"{base}/{self.staging}"
            for wait in (0.1, 0.5, 2.0, None):
                try:
                    if place.get_file_info(staged).type == fs.FileType.Directory:
                        place.delete_dir(staged)
                    return
                except OSError:
                    if wait is None:
                        raise
                    time.sleep(wait)

    class NamedFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT_NAME

        def schema(self) -> str:
            return "path string, content string"

        def writer(self, schema, overwrite: bool) -> Writer:
            return Writer(self.options["root"], self.options.get("header", ""))

    FORMAT_NAME = FORMAT
    return NamedFiles


def write_files(df: DataFrame, root: str, *, header: str = "") -> None:
    """Write the ``content`` of each row to ``path`` below ``root``.

    Rows of one path that follow each other in a task make one file, begun by
    ``header``; a path must not be spread over tasks. A file that is there
    already is replaced. Null content is empty; a null path is an error.
    """
    df.sparkSession.dataSource.register(_named_files())
    files = df.select(F.col("path").cast("string"), F.col("content").cast("string"))
    files.write.format(FORMAT).mode("append").options(root=root, header=header).save()


def write_csv_parts(df: DataFrame, root: str, stem: str) -> None:
    """A table as CSV files ``<stem>-<part>.csv`` with a header, one per task."""
    part = F.format_string(f"{stem}-%05d.csv", F.spark_partition_id()).alias("path")
    line = F.concat(F.to_csv(F.struct(*df.columns)), F.lit("\n")).alias("content")
    write_files(df.select(part, line), root, header=",".join(df.columns) + "\n")
