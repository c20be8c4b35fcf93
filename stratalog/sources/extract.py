"""Data sink `files`: a file for each row (path, content), below a folder and with mode bits where there are any."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceWriter
from pyspark.sql.types import StructType

from stratalog.model import ARCHIVE_ENTRIES
from stratalog.sources.archives import Written
from stratalog.sources.files import below, opened, publish


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = path, names, overwrite

    def write(self, rows: Iterator) -> Written:
        files, own = opened(self.path)
        folder = f"{own}/_{uuid.uuid4().hex}"
        files.create_dir(folder, recursive=True)
        place = {n: i for i, n in enumerate(self.names)}
        for row in rows:
            name, body = row[place["path"]], row[place["content"]]
            if ".." in name or name.startswith("/"):
                raise ValueError(f"a path may not leave the folder: {name}")
            target = f"{folder}/{name}"
            files.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with files.open_output_stream(target, compression=None) as f:
                f.write(body.encode() if isinstance(body, str) else bytes(body or b""))
            mode = row[place["permissions"]] if "permissions" in place else None
            if mode and isinstance(files, fs.LocalFileSystem):
                os.chmod(target, mode & 0o777)
        return Written(folder, own)

    def commit(self, messages: list) -> None:
        files, _ = opened(self.path)
        done = [m for m in messages if m]
        publish(self.path, [(x, f"{m.final}/{name}") for m in done for x, name in below(self.path, m.temporary)], self.overwrite)
        for m in done:
            files.delete_dir(m.temporary)

    def abort(self, messages: list) -> None:
        files, _ = opened(self.path)
        for m in messages:
            if m:
                files.delete_dir(m.temporary)


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> StructType:
        return ARCHIVE_ENTRIES

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], schema.names, overwrite)
