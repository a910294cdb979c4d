"""Random access to the bytes of a container: local and Hadoop-style file systems, and HTTP range requests."""

from __future__ import annotations

import urllib.request
from collections.abc import Iterator

import pyarrow.fs as pafs

AHEAD = 1 << 20  # read-ahead while walking through records


class ContainerError(ValueError):
    """A container, or what is to become one, breaks the format."""


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path or URI and the path there. A path without a scheme is local."""
    for hadoop, arrow in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if path.startswith(hadoop):
            path = arrow + path[len(hadoop) :]
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class FileBytes:
    """``requests`` and ``fetched`` count the reads and their bytes."""

    def __init__(self, path: str):
        self.fs, self.path = filesystem(path)
        self.file = self.fs.open_input_file(self.path)
        self.size = self.file.size()
        self.requests = self.fetched = 0

    def read(self, start: int, length: int) -> bytes:
        data = self.file.read_at(max(0, min(length, self.size - start)), start) if start < self.size else b""
        self.requests += 1
        self.fetched += len(data)
        return data


class HttpBytes:
    """One range request per read. A server that answers with the whole body instead is understood, one that gives less than was asked for is asked for the rest; ``requests`` and ``fetched`` count."""

    def __init__(self, url: str, headers: dict[str, str] | None = None, nocache: bool = False):
        self.url = url
        self.headers = {**(headers or {}), **({"Cache-Control": "no-cache, no-store"} if nocache else {})}
        self.size = None
        self.requests = self.fetched = 0
        self.read(0, 1)

    def read(self, start: int, length: int) -> bytes:
        data = self._ask(start, length)
        while len(data) < length and (self.size is None or start + len(data) < self.size):
            more = self._ask(start + len(data), length - len(data))
            if not more:
                if self.size is not None:
                    raise ContainerError(f"{self.url} gives {len(data)} of {length} bytes from byte {start}")
                break
            data += more
        return data

    def _ask(self, start: int, length: int) -> bytes:
        if length <= 0 or (self.size is not None and start >= self.size):
            return b""
        request = urllib.request.Request(self.url, headers={**self.headers, "Range": f"bytes={start}-{start + length - 1}"})
        with urllib.request.urlopen(request) as answer:
            if answer.status == 206:
                data = answer.read()
                total = answer.headers.get("Content-Range", "").rpartition("/")[2]
                if total.isdigit():
                    self.size = int(total)
            else:
                whole = answer.read()
                self.size = len(whole)
                data = whole[start : start + length]
        self.requests += 1
        self.fetched += len(data)
        return data


def open_bytes(path: str, options: dict[str, str] | None = None) -> FileBytes | HttpBytes:
    """Options ``header.<name>`` and ``nocache`` are for HTTP."""
    options = options or {}
    if path.startswith(("http://", "https://")):
        headers = {k[7:]: v for k, v in options.items() if k.startswith("header.")}
        return HttpBytes(path, headers, str(options.get("nocache", "false")).lower() == "true")
    return FileBytes(path)


def list_containers(path: str) -> list[str]:
    """A URL or file for itself; of a directory its files, hidden ones aside, by name."""
    if path.startswith(("http://", "https://")):
        return [path]
    fs, inner = filesystem(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    found = fs.get_file_info(pafs.FileSelector(inner))
    return sorted(prefix + f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))


class Walker:
    """Reads forward through length-prefixed records with read-ahead. A source that ends within a record, or before ``count`` records, is an error."""

    def __init__(self, source, start: int, end: int | None = None):
        self.source, self.at, self.end = source, start, end
        self.buffer, self.begin = b"", start

    def _short(self, n: int, count: int | None, within: bool = False) -> None:
        within = within or self.begin + len(self.buffer) > self.at  # something is left
        if count is not None or within:
            raise ContainerError(f"{getattr(self.source, 'path', None) or self.source.url} is cut short: {n} records of {'an unknown number' if count is None else count} at byte {self.at}")

    def _need(self, n: int) -> bool:
        have = self.begin + len(self.buffer)
        if self.at + n > have:
            keep = self.buffer[self.at - self.begin :] if self.at < have else b""
            more = max(n - len(keep), AHEAD if self.end is None else min(AHEAD, self.end - self.at - len(keep)))
            self.buffer = keep + self.source.read(self.at + len(keep), more)
            self.begin = self.at
        return self.at + n <= self.begin + len(self.buffer)

    def records(self, count: int | None = None) -> Iterator[tuple[int, bytes]]:
        """(position, record with its prefix), at most ``count``, until the end."""
        n = 0
        while (count is None or n < count) and (self.end is None or self.at < self.end):
            if not self._need(4):
                return self._short(n, count)
            i = self.at - self.begin
            size = 4 + int.from_bytes(self.buffer[i : i + 4], "little")
            if not self._need(size):
                return self._short(n, count)
            i = self.at - self.begin
            yield self.at, self.buffer[i : i + size]
            self.at += size
            n += 1

    def hop(self, count: int | None = None) -> Iterator[int]:
        """The positions only; long records are jumped over unread."""
        n = 0
        while (count is None or n < count) and (self.end is None or self.at < self.end):
            if not self._need(4):
                return self._short(n, count)
            i = self.at - self.begin
            here = self.at
            self.at += 4 + int.from_bytes(self.buffer[i : i + 4], "little")
            if self.source.size is not None and self.at > self.source.size:
                self.at = here
                return self._short(n, count, True)
            yield here
            n += 1
