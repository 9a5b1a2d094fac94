"""Opening files by path or address, on the driver and on executors: local ones, and those of the stores that pyarrow knows
(hdfs, s3, gs, abfs). A retried task writes its file anew, and a reader never sees half of one."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyarrow import NativeFile, fs


def _found(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def known(path: str) -> bool:
    """Whether the path is one of a store that is opened here, and a single file rather than a pattern."""
    try:
        where, name = _found(path)
        return where.get_file_info(name).type == fs.FileType.File
    except (OSError, ValueError):  # a scheme that pyarrow lacks, or a store without its client here
        return False


def files(path: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of the files of a folder whose names begin with neither . nor _; none where the path can't be opened here."""
    try:
        where, name = _found(path)
        info = where.get_file_info(name)
        if info.type == fs.FileType.File:
            return [(path, info.size)]
        if info.type != fs.FileType.Directory:
            return []
        own = where.get_file_info(fs.FileSelector(name))
    except (OSError, ValueError):
        return []
    return sorted((f"{path.rstrip('/')}/{x.base_name}", x.size) for x in own if x.type == fs.FileType.File and x.base_name[0] not in "._")


def open_input(path: str) -> NativeFile:
    """For reading, with seek."""
    where, name = _found(path)
    return where.open_input_file(name)


def save(path: str, parts: Iterable[bytes]) -> None:
    """Writes a whole file from its parts, folders included; it stands under its name only once it is complete."""
    where, name = _found(path)
    folder, _, base = name.rpartition("/")
    where.create_dir(folder, recursive=True)
    if isinstance(where, (fs.LocalFileSystem, fs.HadoopFileSystem)):
        part = f"{folder}/.{base}.{os.getpid()}.part"
        with where.open_output_stream(part) as f:
            for x in parts:
                f.write(x)
        where.move(part, name)
    else:  # object stores show a file when it is closed
        with where.open_output_stream(name) as f:
            for x in parts:
                f.write(x)


BLOCK = 8 << 20


def blocks(path: str) -> Iterable[bytes]:
    """The bytes of a file, a block at a time."""
    with open_input(path) as f:
        while data := f.read(BLOCK):
            yield data


def lines(path: str) -> list[str]:
    """The lines of a small text file that are not empty."""
    return [x for x in b"".join(blocks(path)).decode().split("\n") if x]


def remove(path: str) -> None:
    """A folder with all that is in it, if it is there."""
    where, name = _found(path)
    if where.get_file_info(name).type == fs.FileType.Directory:
        where.delete_dir(name)
