"""Files that tasks write into the shared folder and read again.

The folder is an address that pyarrow's file systems open (file, hdfs, s3, gs). A file is
written under the name of the attempt and reported by the row that the task returns, so a
lost or repeated attempt leaves an unused file and never a half-written one in use.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import threading
import uuid

import numpy as np
from pyarrow import fs

_LOCK = threading.Lock()


def open_folder(address: str) -> tuple[fs.FileSystem, str]:
    if "://" not in address and not address.startswith("file:"):
        address = "file://" + os.path.abspath(address)
    elif address.startswith("file:/") and not address.startswith("file://"):
        address = "file://" + address.removeprefix("file:")
    return fs.FileSystem.from_uri(address)


def write_file(folder: str, label: str, parts: list) -> str:
    """Write the byte parts one after another into a new file; its name within the folder."""
    system, root = open_folder(folder)
    system.create_dir(root, recursive=True)
    name = f"{label}-{uuid.uuid4().hex}.bin"
    with system.open_output_stream(f"{root}/{name}") as out:
        for part in parts:
            out.write(part)
    return name


def read_file(folder: str, name: str) -> bytes:
    system, root = open_folder(folder)
    with system.open_input_stream(f"{root}/{name}") as source:
        return source.read()


def local_path(folder: str, name: str) -> str:
    """A path that can be memory-mapped: the file itself if the folder is mounted here.

    From a store that is not mounted the file is copied once per machine and process tree.
    """
    system, root = open_folder(folder)
    if isinstance(system, fs.LocalFileSystem):
        return f"{root}/{name}"
    key = hashlib.sha256(f"{folder}/{name}".encode()).hexdigest()
    target = os.path.join(tempfile.gettempdir(), f"model-{key}.bin")
    with _LOCK:
        if not os.path.exists(target):
            part = f"{target}.{uuid.uuid4().hex}"
            with open(part, "wb") as out, system.open_input_stream(f"{root}/{name}") as source:
                while chunk := source.read(1 << 22):
                    out.write(chunk)
            os.replace(part, target)
    return target


def mapped(folder: str, name: str, dtype: np.dtype) -> np.ndarray:
    path = local_path(folder, name)
    if os.path.getsize(path) == 0:
        return np.zeros(0, dtype=dtype)
    return np.memmap(path, dtype=dtype, mode="r")
