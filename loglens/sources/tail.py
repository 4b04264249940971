"""Stream source that follows growing and replaced text files."""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

CHUNK_BYTES = 8 * 1024 * 1024
BLOCK_BYTES = 1024 * 1024
PRINT_BYTES = 256
# Files that the driver looks into at the same time.
OPEN_FILES = 32
_GONE = object()
START = {"pos": 0, "print": ""}


class ByteRange(InputPartition):
    """Bytes of one file; lines that begin in [start, stop) belong to it. ``mark`` is the print at ``end``."""

    def __init__(self, path: str, start: int, stop: int, end: int, aligned: bool, mark: str):
        self.path, self.start, self.stop, self.end = path, start, stop, end
        self.aligned, self.mark = aligned, mark


def _locate(path: str) -> tuple[fs.FileSystem, str]:
    """A path without a scheme is a local one; ``streams`` passes paths that Hadoop has qualified."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(quote(path, safe="/:@=&,+$!*'()~"))
    return fs.LocalFileSystem(), path


def _print(source: pa.NativeFile, position: int) -> str:
    """Fingerprint of the file's first bytes and of those just before ``position``."""
    if position == 0:
        return ""
    size = min(PRINT_BYTES, position)
    source.seek(0)
    head = source.read(size)
    source.seek(position - size)
    return hashlib.blake2b(head + source.read(size), digest_size=12).hexdigest()


def _continues(source: pa.NativeFile, old: dict, size: int) -> bool:
    """Whether the file is still the one that was read up to ``old``."""
    return old["pos"] <= size and _print(source, old["pos"]) == old["print"]


def _complete_size(source: pa.NativeFile, size: int, floor: int) -> int:
    """Offset behind the last newline in [floor, size); ``floor`` when there is none."""
    upper = size
    while upper > floor:
        lower = max(floor, upper - BLOCK_BYTES)
        source.seek(lower)
        at = source.read(upper - lower).rfind(b"\n")
        if at >= 0:
            return lower + at + 1
        upper = lower
    return floor


def _infos(paths: list[str]) -> dict[str, fs.FileInfo]:
    """The paths that are files, asked for in one call per file system."""
    found = {}
    systems: dict[tuple[str, str], tuple[fs.FileSystem, list]] = {}
    for path in paths:
        system, name = _locate(path)
        store = path.split("/", 3)[2] if "://" in path and not path.startswith("file:") else ""
        systems.setdefault((system.type_name, store), (system, []))[1].append((path, name))
    for system, names in systems.values():
        for (path, _), info in zip(names, system.get_file_info([n for _, n in names])):
            if info.type == fs.FileType.File:
                found[path] = info
    return found


def _each(paths: Iterable[str], look: Callable[[pa.NativeFile, str], object]) -> dict[str, object]:
    """What ``look`` finds in each file, many opened at a time; files that are gone since they were listed are left out."""
    def one(path: str) -> object:
        system, name = _locate(path)
        try:
            with system.open_input_file(name) as source:
                return look(source, path)
        except FileNotFoundError:
            return _GONE

    with ThreadPoolExecutor(OPEN_FILES) as pool:
        found = dict(zip(paths, pool.map(one, paths)))
    return {path: x for path, x in found.items() if x is not _GONE}


def missing(paths: list[str]) -> list[str]:
    """The paths that are no files just now."""
    found = _infos(paths)
    return [path for path in paths if path not in found]


class TailReader(DataSourceStreamReader):
    """Offset: per path the position behind the last whole line seen and a fingerprint of what is before it.

    A file whose bytes before that position are no longer the same was replaced or truncated and is read
    from its beginning, whatever its size; one that vanishes keeps its place in the offset and goes on
    there if it comes back unchanged. Lines that a file held when it was deleted unread are lost, and a file
    replaced by one that begins with all that was read counts as grown. A half-written line waits for its newline.
    """

    def __init__(self, options: dict[str, str]):
        options = {name.lower(): value for name, value in options.items()}  # as Spark hands them over
        self.paths = json.loads(options["paths"]) if "paths" in options else []
        self.directory = options.get("directory")
        self.pattern = options.get("pattern", "*.log")
        self.start = options.get("start", "latest")
        self.chunk = int(options.get("chunkbytes", CHUNK_BYTES))
        self.most = int(options.get("maxbytespertrigger", 0))
        self.last_line = options.get("lastline", "false").lower() == "true"
        if self.start not in ("latest", "earliest") and not self.start.startswith("{"):
            raise ValueError(f"start is latest, earliest or an offset, not {self.start!r}")
        if not self.paths and not self.directory:
            raise ValueError("give paths or a directory to follow")
        # The last offset given out. None before the first: after a restart Spark doesn't tell it, so who starts the query may.
        self._given: dict[str, dict] | None = json.loads(options["resume"]) if "resume" in options else None
        # Places in a checkpoint's offset of files that were away at the restart.
        self._away: dict[str, dict] = {}
        # Size and time of files that were seen whole: these need not be opened again.
        self._whole: dict[str, tuple[int, int]] = {}

    def _files(self) -> dict[str, fs.FileInfo]:
        found = _infos(self.paths)
        if self.directory:
            system, name = _locate(self.directory)
            # Regular files of the folder itself, not of folders below it.
            for info in system.get_file_info(fs.FileSelector(name, allow_not_found=True)):
                if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.pattern):
                    found[f"{self.directory.rstrip('/')}/{info.base_name}"] = info
        return dict(sorted(found.items()))

    def initialOffset(self) -> dict:
        if self.start == "latest":
            self.latestOffset()
        else:
            self._given = {} if self.start == "earliest" else json.loads(self.start)
        return self._given

    def latestOffset(self) -> dict:
        """The ends of all files, or of as much as ``maxBytesPerTrigger`` allows, dealt evenly to the files that
        changed. The first offset of a reader that goes on from a checkpoint is bounded only with ``resume``."""
        files = self._files()
        changed = {p: i for p, i in files.items() if self._whole.get(p) != (i.size, i.mtime_ns)}
        share = max(self.most // len(changed), 1) if self.most and changed and self._given is not None else None
        offset = {**self._away, **(self._given or {})}
        before = dict(offset)
        reached = _each(changed, lambda source, path: self._reached(
            source, changed[path].size, before.get(path, START), share))
        for path, (place, whole) in reached.items():
            offset[path] = place
            if whole:
                self._whole[path] = (changed[path].size, changed[path].mtime_ns)
        self._given = offset
        return offset

    def _reached(self, source: pa.NativeFile, size: int, old: dict, share: int | None) -> tuple[dict, bool]:
        floor = old["pos"] if _continues(source, old, size) else 0
        upper = size if share is None else min(size, floor + share)
        while True:
            at = upper if self.last_line and upper == size else _complete_size(source, upper, floor)
            if at > floor or upper == size:
                return {"pos": at, "print": _print(source, at)}, upper == size
            upper = min(size, upper + share)  # a line longer than the share

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        self._away.update({p: old for p, old in start.items() if p not in end})
        before = {path: start.get(path) or self._away.get(path) or START for path in end}
        moved = [path for path, new in end.items() if before[path] != new]
        goes_on = _each(moved, lambda source, path: _continues(source, before[path], end[path]["pos"]))
        ranges = []
        for path, same in goes_on.items():
            new, stop = end[path], end[path]["pos"]
            begin = before[path]["pos"] if same else 0
            for at in range(begin, stop, self.chunk):
                ranges.append(ByteRange(path, at, min(at + self.chunk, stop), stop, at == begin, new["print"]))
        return ranges

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        """Lines as whole blocks. A file replaced or deleted since the batch was planned gives none of its former lines;
        the next batch reads the new one from its beginning."""
        system, name = _locate(part.path)
        try:
            with system.open_input_file(name) as source:
                if _print(source, part.end) == part.mark:
                    yield from self._lines(source, part)
        except FileNotFoundError:
            return

    def _lines(self, source: pa.NativeFile, part: ByteRange) -> Iterator[pa.RecordBatch]:
        # A range that does not begin a batch may begin inside a line. That line belongs to
        # the range before, so skip to the first line that begins here.
        skipping = not part.aligned
        position = begin = part.start - skipping
        source.seek(position)
        rest: list[bytes] = []
        while position < part.end and (begin < part.stop or skipping):
            block = source.read(min(BLOCK_BYTES, part.end - position))
            if not block:
                return
            position += len(block)
            cut = block.rfind(b"\n") + 1
            if position == part.end and cut < len(block):  # ends in a line without newline, by ``lastLine``
                block, cut = block + b"\n", len(block) + 1
            if not cut:
                rest.append(block)
                continue
            data = b"".join([*rest, block[:cut]])
            rest = [block[cut:]]
            ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0A)
            starts = np.concatenate([[0], ends[:-1] + 1])
            if skipping:
                starts, ends, skipping = starts[1:], ends[1:], False
            n = int(np.searchsorted(starts + begin, part.stop))
            if n:
                yield _batch(part.path, data, starts[:n], ends[:n], begin)
            begin += len(data)


def _batch(path: str, data: bytes, starts: np.ndarray, ends: np.ndarray, begin: int) -> pa.RecordBatch:
    """Consecutive lines of ``data``, which stands at ``begin`` in its file; bytes that are no UTF-8 stay as they are."""
    n = len(starts)
    text = data[starts[0]:ends[-1]].replace(b"\n", b"")
    offsets = np.concatenate([[0], ends - starts[0] - np.arange(n)]).astype(np.int32)
    value = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(text))
    shown = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
    return pa.RecordBatch.from_arrays(
        [pa.array([shown] * n, pa.string()), pa.array(starts + begin, pa.int64()), value],
        ["source", "position", "value"])


class TailBatchReader(DataSourceReader):
    """The same files once, from their beginnings up to the offset ``until``."""

    def __init__(self, options: dict[str, str]):
        self.until = json.loads(options["until"])
        self.files = TailReader(options)

    def partitions(self) -> list[ByteRange]:
        return self.files.partitions({}, self.until)

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        return self.files.read(part)


class TailSource(DataSource):
    """``spark.readStream.format("loglens_tail")``: rows ``(source, position, value)``.

    Options: ``paths`` (JSON list) or ``directory`` with ``pattern`` (default ``*.log``);
    ``start``: ``latest`` (default) begins at the end of the files present at the start and at
    the beginning of later ones, ``earliest`` at the beginning of all, a JSON offset where it says; ``chunkBytes``: size
    of a read task; ``maxBytesPerTrigger``: bound of a micro-batch, none by default; ``resume``: the last offset of the checkpoint that
    the query goes on from, which bounds its first micro-batch too;
    ``lastLine``: ``true`` also takes a last line without newline, for finished files. ``position`` is the line's first
    byte in its file. As a batch source it reads up to the offset ``until``.
    """

    @classmethod
    def name(cls) -> str:
        return "loglens_tail"

    def schema(self) -> StructType | str:
        return "source string, position bigint, value string"

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(dict(self.options))

    def reader(self, schema: StructType) -> TailBatchReader:
        return TailBatchReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)
