"""Listing and opening files by URI on the driver and in tasks."""

from __future__ import annotations

import re
from fnmatch import fnmatch

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def list_files(uri: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of the files under a folder or of those a glob names, in name order.

    Names starting with ``_`` or ``.`` are skipped, folders too, as Spark does.
    """
    if any(c in uri for c in "*?["):
        fixed = re.match(r"[^*?\[]*/", uri)[0].rstrip("/")
        return [f for f in list_files(fixed) if fnmatch(f[0], uri)]
    system, path = resolve(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(uri)
    base = uri.rstrip("/")
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    inside = {f.path[len(path.rstrip("/")) + 1 :]: f.size for f in found if f.type == fs.FileType.File}
    shown = sorted(name for name in inside if all(part[0] not in "_." for part in name.split("/")))
    return [(f"{base}/{name}", inside[name]) for name in shown]
