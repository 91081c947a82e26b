"""File systems as Python tasks see them: local and mounted paths, and stores that Arrow opens by their URI."""

from __future__ import annotations

import posixpath
import re

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; `file:` with any number of slashes, or none, is the machine's own (or mounted) one."""
    if m := re.match(r"file:/*(/.*)", uri):
        return fs.LocalFileSystem(), m[1]
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", uri):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), posixpath.abspath(uri)


def is_local(uri: str) -> bool:
    return uri.startswith("file:") or not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", uri)
