"""Files of the shared folder that tasks write and read in ranges, in any store that Arrow opens.

Spark has no reader for a byte range of a binary file, so tasks open such files themselves: `file:`,
`hdfs:`, `s3:` (also spelled `s3a:`), `gs:` and `abfss:` paths.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession

from .shared import drop_at_exit, shared_path

_SPELLED = {"s3a": "s3", "s3n": "s3"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    scheme, colon, rest = path.partition(":")
    if not colon:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{_SPELLED.get(scheme, scheme)}:{rest}")


def new_name(folder: str, name: str) -> str:
    """A path that no other attempt of a task uses: what a lost attempt wrote is never read."""
    start, dot, end = name.partition(".")
    return f"{folder}/{start}-{uuid.uuid4().hex}{dot}{end}"


def create_folder(folder: str) -> None:
    store, inner = opened(folder)
    store.create_dir(inner, recursive=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, dropped when the process ends with its session alive."""
    path = drop_at_exit(spark, shared_path(spark, name))
    create_folder(path)
    return path


def write_arrays(path: str, **arrays: np.ndarray) -> None:
    packed = io.BytesIO()
    np.savez(packed, **arrays)
    store, inner = opened(path)
    with store.open_output_stream(inner) as out:
        out.write(packed.getbuffer())


def read_arrays(path: str) -> dict[str, np.ndarray]:
    store, inner = opened(path)
    with store.open_input_file(inner) as file:
        with np.load(io.BytesIO(file.read())) as arrays:
            return dict(arrays)
