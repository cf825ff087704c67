"""Array files in the shared folder: written whole or not at all, read by memory mapping."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import BinaryIO
from urllib.parse import urlparse

import numpy as np
from pyarrow import fs


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


@contextmanager
def _writing(uri: str) -> Iterator[BinaryIO]:
    """A task that runs again writes the same file again."""
    path = _local(uri)
    if path is None:
        store, at = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(at) as out:
            yield out
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        yield out
    os.replace(part, path)


def save(uri: str, array: np.ndarray) -> None:
    with _writing(uri) as out:
        np.save(out, array)


def save_joined(uri: str, kind: np.dtype, n: int, pieces: Iterable[np.ndarray]) -> None:
    """One array of n values of a type from its pieces, of which one is held at a time."""
    with _writing(uri) as out:
        np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(np.dtype(kind)), "fortran_order": False, "shape": (n,)})
        for piece in pieces:
            out.write(np.ascontiguousarray(piece, kind).tobytes())


def there(uri: str) -> bool:
    path = _local(uri)
    if path is not None:
        return os.path.exists(path)
    store, at = fs.FileSystem.from_uri(uri)
    return store.get_file_info(at).type != fs.FileType.NotFound


def remove(uri: str) -> None:
    """Gone afterwards, also if it was before."""
    if not there(uri):
        return
    path = _local(uri)
    if path is not None:
        os.remove(path)
    else:
        store, at = fs.FileSystem.from_uri(uri)
        store.delete_file(at)


def opened(uri: str) -> np.ndarray:
    """The array, mapped; from a store that can't be mapped it is copied to a local file first."""
    path = _local(uri)
    if path is not None:
        return np.load(path, mmap_mode="r")
    store, at = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(at) as src, tempfile.NamedTemporaryFile(suffix=".npy") as to:
        while block := src.read(1 << 24):
            to.write(block)
        to.flush()
        return np.load(to.name, mmap_mode="r")  # stays mapped after the name is gone


@lru_cache(maxsize=4096)
def load(uri: str) -> np.ndarray:
    """:func:`opened`, which stays mapped."""
    return opened(uri)


def forget() -> None:
    """Unmap what :func:`load` has mapped. A removed file keeps its disk space as long as a worker, which outlives its task, maps it."""
    load.cache_clear()
