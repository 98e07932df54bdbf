"""Files as bytes: names, codecs by content, and ranges of lines."""

from __future__ import annotations

import glob
import gzip
import hashlib
import os
from collections.abc import Iterator


def local_paths(path: str) -> list[str]:
    """The files of a path, a folder or a pattern, in order of their names."""
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(os.path.join(path, "*")) if os.path.isfile(p) and not os.path.basename(p).startswith(("_", ".")))
    return sorted(glob.glob(path)) or [path]


def is_gzip(path: str) -> bool:
    """By content, not by name; nothing of three bytes or less is."""
    with open(path, "rb") as f:
        return f.read(2) == b"\x1f\x8b" and os.path.getsize(path) > 3


def lines(path: str, start: int = 0, keep_cr: bool = False) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) from ``start`` on; all members of a gzip file are read. Blank lines are lines."""
    with (gzip.open(path, "rb") if is_gzip(path) else open(path, "rb")) as f:
        if start:
            f.seek(start)
        at = start
        for line in f:
            own = line.rstrip(b"\n")
            yield at, own if keep_cr else own.removesuffix(b"\r")
            at += len(line)


def content_md5(path: str) -> tuple[str, int]:
    """MD5 and length of a file's content, gzip or not, read in pieces."""
    sum_, n = hashlib.md5(), 0
    with (gzip.open(path, "rb") if is_gzip(path) else open(path, "rb")) as f:
        while part := f.read(1 << 20):
            sum_.update(part)
            n += len(part)
    return sum_.hexdigest(), n


def output_name(path: str, folder: str | None = None, suffix: str = ".rla") -> str:
    """Name of the archive of a file: without .gz, with the archive's suffix, in ``folder`` if given."""
    name = path.removesuffix(".gz") + suffix
    return os.path.join(folder, os.path.basename(name)) if folder else name


def restored_name(path: str, folder: str | None = None, zipped: bool = False, suffix: str = ".rla") -> str:
    name = path.removesuffix("/").removesuffix(suffix) + ".gz" * zipped
    return os.path.join(folder, os.path.basename(name)) if folder else name
