"""Files and folders by path or URI, through the file system that the URI names."""

from __future__ import annotations

import posixpath
import re
import uuid

from pyarrow import fs


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it); paths without a scheme and file: URIs are local."""
    if re.match(r"\w[\w+.-]*://", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


def kind(path: str) -> fs.FileType:
    where, inner = filesystem(path)
    return where.get_file_info(inner).type


def exists(path: str) -> bool:
    return kind(path) != fs.FileType.NotFound


def is_folder(path: str) -> bool:
    return kind(path) == fs.FileType.Directory


def names(folder: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    where, inner = filesystem(folder)
    return sorted(x.base_name for x in where.get_file_info(fs.FileSelector(inner, allow_not_found=True)))


def make_folder(path: str) -> None:
    where, inner = filesystem(path)
    where.create_dir(inner, recursive=True)


def read_bytes(path: str, most: int | None = None) -> bytes:
    where, inner = filesystem(path)
    with where.open_input_stream(inner, compression=None) as f:
        return f.read() if most is None else f.read(most)


def write_bytes(path: str, data: bytes) -> None:
    """The file gets its name when it is whole."""
    where, inner = filesystem(path)
    where.create_dir(posixpath.dirname(inner) or ".", recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(part, compression=None) as f:
        f.write(data)
    where.move(part, inner)


def remove(path: str) -> None:
    where, inner = filesystem(path)
    if where.get_file_info(inner).type == fs.FileType.File:
        where.delete_file(inner)
