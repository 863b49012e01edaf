"""Binary files in a folder that driver and executors share: written under another name, renamed, memory-mapped."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np


def filesystem(uri: str):
    """(file system, path, local?) of a folder that all executors see."""
    from pyarrow import fs

    kind = urlparse(uri).scheme
    if kind in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path, True
    found, path = fs.FileSystem.from_uri(uri)
    return found, path, False


def put(uri: str, name: str, *parts: bytes | np.ndarray) -> None:
    store, path, _ = filesystem(uri)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{uuid.uuid4().hex}"  # a second attempt of a task writes beside the first
    with store.open_output_stream(part) as f:
        for x in parts:
            if len(x):
                f.write(x if isinstance(x, bytes) else memoryview(np.ascontiguousarray(x)).cast("B"))
    store.move(part, f"{path}/{name}")


def get(uri: str, name: str, dtype) -> np.ndarray:
    """A file as an array; memory-mapped where the folder is mounted."""
    store, path, local = filesystem(uri)
    if local:
        at = f"{path}/{name}"
        return np.memmap(at, dtype=dtype, mode="r") if os.path.getsize(at) else np.zeros(0, dtype)
    with store.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def exists(uri: str, name: str) -> bool:
    from pyarrow import fs

    store, path, _ = filesystem(uri)
    return store.get_file_info(f"{path}/{name}").type == fs.FileType.File
