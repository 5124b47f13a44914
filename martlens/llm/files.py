"""Files that tasks write themselves, in the folder all executors share."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from martlens.session import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared folder, as a URI or absolute path."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    return folder.replace("file:///", "/").removeprefix("file:")


def open_output(folder: str, name: str):
    """A new file of a task attempt, and its path.

    The name is unique to the attempt: a retried or speculative task never
    touches the file of another, and only files of the attempt that succeeded
    are listed in the table that the tasks return.
    """
    system, root = pafs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}"
    return system.open_output_stream(f"{root}/{file}"), f"{folder}/{file}"


def open_input(path: str):
    system, place = pafs.FileSystem.from_uri(path)
    return system.open_input_file(place)
