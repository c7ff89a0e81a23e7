"""Files by URI, so that stores may lie in any file system pyarrow knows."""

from __future__ import annotations

import os
import re

from ..model import LARGEST_SEGMENT, SUFFIX, LogError


def filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


def segment_name(segment: int) -> str:
    if not 0 <= segment <= LARGEST_SEGMENT:
        raise LogError(f"segment {segment} has no eight-digit name")
    return f"{segment:08d}{SUFFIX}"


def parse_segment_name(name: str) -> int | None:
    m = re.fullmatch(r"([0-9]{8})" + re.escape(SUFFIX), name)
    return int(m[1]) if m else None


def list_segments(uri: str) -> list[tuple[int, str, int]]:
    """(segment, path, bytes) of the regular files that are segments, ascending."""
    from pyarrow import fs

    files, base = filesystem(uri)
    kind = files.get_file_info(base).type
    if kind == fs.FileType.NotFound:
        raise LogError(f"no such store: {uri}")
    if kind != fs.FileType.Directory:
        raise LogError(f"not a directory: {uri}")
    found = []
    for f in files.get_file_info(fs.FileSelector(base)):
        n = parse_segment_name(f.base_name) if f.type == fs.FileType.File else None
        if n is not None:
            found.append((n, f.path, f.size))
    return sorted(found)


def next_segment(segments: list[int]) -> int:
    n = segments[-1] + 1 if segments else 1
    if n > LARGEST_SEGMENT:
        raise LogError("no segment number is left")
    return n


def read_bytes(uri: str, path: str, at: int = 0) -> bytes:
    files, _ = filesystem(uri)
    with files.open_input_file(path) as f:
        f.seek(at)
        return f.read()
