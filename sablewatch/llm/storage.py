"""Files and tables that operators keep in the folder all machines share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from sablewatch.session import cut_lineage as write_table
from sablewatch.session import shared_folder

__all__ = ["cut_lineage", "filesystem", "new_file", "read_range", "shared_folder"]

#: Bytes of rows that go to a Python worker at a time, about. Rows of some operators hold
#: blocks of whole texts, so a batch counted in rows alone could outgrow an executor.
BATCH_BYTES = 4 << 20


def cut_lineage(df: DataFrame) -> DataFrame:
    """``session.cut_lineage`` with Arrow batches of ``BATCH_BYTES``."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name)
    conf.set(name, str(BATCH_BYTES))
    try:
        return write_table(df)
    finally:
        conf.set(name, before)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    if uri.startswith("file:/"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def new_file(uri: str) -> Iterator:
    """A stream to a file that appears only when it is whole.

    Each attempt of a task writes under a name of its own; a repeated task
    replaces the file by the same bytes.
    """
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        yield out
    fs.move(own, path)


def read_range(uri: str, start: int = 0, length: int | None = None) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read(length) if length is not None else f.read()
