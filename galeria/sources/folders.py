"""Folders of files that Python data sources read and write: local paths or URIs that pyarrow knows."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def files(system: fs.FileSystem, path: str, suffix: str = "", recursive: bool = True) -> list[fs.FileInfo]:
    """The files under a folder in the order of their paths; none if it is not there. Hidden ones and Spark's own (_, .) are left out."""
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=recursive))
    shown = lambda i: not any(part[:1] in "._" for part in i.path[len(path) :].strip("/").split("/"))
    return sorted((i for i in found if i.type == fs.FileType.File and i.path.endswith(suffix) and shown(i)), key=lambda i: i.path)
