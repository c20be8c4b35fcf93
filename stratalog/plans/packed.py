"""Files made of rows and read again inside a plan: containers, volumes, log rails and zip archives as binary columns.

A file is made in one task, so the caller's key decides how large it may get.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.model import ARCHIVE_ENTRIES, COMPRESSED, LOG_ENTRIES, VOLUME_ASSETS
from stratalog.sources.archives import zip_entries
from stratalog.sources.containers import read_container, read_volume, write_container, write_volume
from stratalog.sources.logs import read_rail, write_rail


@F.pandas_udf(T.BinaryType())
def containers(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda x: None if x is None else write_container(x.encode() if isinstance(x, str) else bytes(x), layers=COMPRESSED))


@F.pandas_udf(T.BinaryType())
def payloads(files: pd.Series) -> pd.Series:
    """The payload, null where it is not intact."""
    return files.map(lambda x: None if x is None else read_container(bytes(x))[-2])


def volumes(assets: DataFrame) -> DataFrame:
    """volume, file from assets (volume, idx, path, content, wrap_type), in the order of idx."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        found = [(p, bytes(c), True, int(w), 0) for p, c, w in zip(rows.path, rows.content, rows.wrap_type, strict=True)]
        return pd.DataFrame({"volume": [rows.volume.iloc[0]], "file": [write_volume(found, created=0)]})

    return assets.groupBy("volume").applyInPandas(one, "volume string, file binary")


def _opened(files: DataFrame, name: str, read, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, data in zip(b[name], b["file"], strict=True):
                rows = [(key, *row) for row in read(bytes(data))]
                if rows:
                    yield pd.DataFrame(rows, columns=schema.names)

    fields = [T.StructField(name, files.schema[name].dataType), *schema.fields[1:]]
    return files.select(name, "file").mapInPandas(run, T.StructType(fields))


def mounted(files: DataFrame) -> DataFrame:
    return _opened(files, "volume", read_volume, VOLUME_ASSETS)


def rails(entries: DataFrame) -> DataFrame:
    """log, file from entries (log, sequence, type, timestamp, stored_size)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sequence")
        found = [(int(t), 1, 0, int(s), int(at), 0, 0, 0, 0, int(n), bytes(16), 0, bytes(32), bytes(8)) for t, s, at, n in zip(rows.type, rows.sequence, rows.timestamp, rows.stored_size, strict=True)]
        return pd.DataFrame({"log": [rows["log"].iloc[0]], "file": [write_rail(found)]})

    rows = entries.select("log", "sequence", "type", "timestamp", "stored_size")
    return rows.groupBy("log").applyInPandas(one, T.StructType([entries.schema["log"], T.StructField("file", T.BinaryType())]))


def opened_rails(files: DataFrame) -> DataFrame:
    return _opened(files, "log", read_rail, LOG_ENTRIES)


def archives(entries: DataFrame) -> DataFrame:
    """archive, file from entries (archive, path, content)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in sorted(zip(rows.path, rows.content, strict=True)):
                z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), bytes(content))
        return pd.DataFrame({"archive": [rows.archive.iloc[0]], "file": [out.getvalue()]})

    return entries.groupBy("archive").applyInPandas(one, T.StructType([entries.schema["archive"], T.StructField("file", T.BinaryType())]))


def opened_archives(files: DataFrame) -> DataFrame:
    return _opened(files, "archive", lambda data: zip_entries(io.BytesIO(data), lambda path: True, True), ARCHIVE_ENTRIES)
