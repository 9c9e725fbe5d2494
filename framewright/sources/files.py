"""Files as Python data sources see them, wherever they are: local ones, and what pyarrow's file systems can open."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote, unquote

from pyarrow import fs

LISTED = 16  # files that are opened, moved or looked at side by side in the driver


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files below a folder, by path; hidden ones, with a dot or an underscore before their name, aren't there."""
    where, at = located(path)
    info = where.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    below = where.get_file_info(fs.FileSelector(at, recursive=True))
    own = lambda p: p[len(at) :].strip("/").split("/")
    return sorted((f.path, f.size) for f in below if f.type == fs.FileType.File and not any(x[0] in "._" for x in own(f.path)))


def ranges(size: int, split: int, start: int = 0) -> Iterator[tuple[int, int]]:
    """[start, size) in parts of `split` bytes, or whole if that is 0."""
    step = split or max(size - start, 1)
    for a in range(start, size, step):
        yield a, min(a + step, size)


def named(stream) -> str:
    """The folder of a stream's files: its name, escaped."""
    return "__null__" if stream is None else quote(str(stream), safe="") or "__empty__"


def stream_of(path: str) -> str | None:
    """The stream whose folder a file is in."""
    name = path.rsplit("/", 2)[-2]
    return {"__null__": None, "__empty__": ""}.get(name, unquote(name))


class Staged:
    """Files of a job that are there only once it is committed.

    Each task attempt writes into a folder of its own; the driver moves what the attempts that succeeded have written, and deletes the rest.
    """

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{located(self.path)[1].rstrip('/')}/_staging-{self.job}"

    def open(self, attempt: str, name: str):
        """A file of an attempt, and (where it is, the name it gets)."""
        where, _ = located(self.path)
        at = f"{self.staging}/{attempt}/{name}"
        where.create_dir(at.rsplit("/", 1)[0], recursive=True)
        return where.open_output_stream(at), (at, name)

    def commit(self, files: list[tuple[str, str]], replace: bool = False) -> None:
        where, root = located(self.path)
        where.create_dir(root, recursive=True)
        if replace:
            for old, _ in listed(self.path):
                where.delete_file(old)

        def move(one: tuple[str, str]) -> None:
            to = f"{root.rstrip('/')}/{one[1]}"
            where.create_dir(to.rsplit("/", 1)[0], recursive=True)
            where.move(one[0], to)

        with ThreadPoolExecutor(LISTED) as pool:
            list(pool.map(move, files))
        self.abort()

    def abort(self) -> None:
        where, _ = located(self.path)
        if where.get_file_info(self.staging).type == fs.FileType.Directory:
            where.delete_dir(self.staging)
