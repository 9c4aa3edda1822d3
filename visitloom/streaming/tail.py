"""A streaming source that tails growing text files by byte offset.

Offsets are {file: [bytes read, hash of the head, bytes hashed, hash of the first line]}. A
half-written last line waits for its end; another first line, or another head of equal length, means
another file under the same name, read from its start. What a batch reads follows from its two
offsets alone, and a replay that finds another file under the name reads nothing instead of other
bytes. A batch's bytes of a file are cut in pieces of about ``piece`` bytes, each of which is a task: a
piece holds the lines that begin in it (a line ends with a line feed), and is read line by line.
``budget`` bounds the bytes a batch admits over all files, oldest files first; option
``cursor`` names a file that keeps the committed offsets, so that a restarted stream counts its
budget from there (what was read is decided by the stream's checkpoint alone).
Register with ``spark.dataSource.register(TailSource)`` and read format ``tail``; the folder
must be one that the executors can open.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD = 4096
BUDGET = 64 << 20
PIECE = 8 << 20


def head_hash(path: str, n: int) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read(n)).hexdigest()


def first_line_hash(path: str, n: int) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read(n).split(b"\n", 1)[0]).hexdigest()


def same_file(seen: list | None, now: list) -> bool:
    """Whether two offsets speak of one file that at most grew."""
    return seen is not None and seen[3] == now[3] and (seen[2] != now[2] or seen[1] == now[1])


def resume_at(path: str, seen: list | None) -> int:
    """Where to go on in a file: 0 if it is new, shorter than before, or begins otherwise."""
    if not seen or os.path.getsize(path) < seen[0] or head_hash(path, seen[2]) != seen[1]:
        return 0
    return seen[0]


STEP = 1 << 16


def whole_lines_end(path: str, start: int, most: int) -> int:
    """End of the last complete line within ``most`` bytes from ``start``; at least one line if it is complete.

    Looks backwards from the end of what may be read, then forwards for the end of one long line.
    """
    end = min(os.path.getsize(path), start + most)
    with open(path, "rb") as f:
        hi = end
        while hi > start:
            lo = max(start, hi - STEP)
            f.seek(lo)
            cut = f.read(hi - lo).rfind(b"\n")
            if cut >= 0:
                return lo + cut + 1
            hi = lo
        f.seek(end)
        while more := f.read(STEP):
            found = more.find(b"\n")
            if found >= 0:
                return end + found + 1
            end += len(more)
    return start


class Piece(InputPartition):
    """The lines that begin between two bytes of a file that begins with a known head.

    ``whole``: how long the file must be at least; ``first``: where the batch's bytes begin, a line's start.
    """

    def __init__(self, path: str, start: int, end: int, first: int, whole: int, head: str, hashed: int):
        self.path, self.start, self.end, self.first, self.whole, self.head, self.hashed = path, start, end, first, whole, head, hashed


def lines_between(path: str, start: int, end: int, first: int):
    """(byte, line with its end) of the lines that begin in [start, end); ``first`` begins a line."""
    with open(path, "rb") as f:
        if start > first:
            f.seek(start - 1)  # a line that begins at start follows a line feed there
            while (step := f.readline(STEP)) and not step.endswith(b"\n"):
                pass
        else:
            f.seek(start)
        at = f.tell()
        while at < end and (raw := f.readline()):
            yield at, raw
            at += len(raw)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.prefix = options.get("prefix", "").lower()
        self.budget = int(options.get("budget", BUDGET))
        self.piece = max(1, int(options.get("piece", PIECE)))
        self.cursor = options.get("cursor")
        self.last: dict = {}
        if self.cursor and os.path.exists(self.cursor):
            with open(self.cursor) as f:
                self.last = json.load(f)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        left, out = self.budget, dict(self.last)
        names = [n for n in os.listdir(self.folder) if n.lower().startswith(self.prefix)]
        paths = sorted((os.path.getmtime(p), n, p) for n in names if os.path.isfile(p := os.path.join(self.folder, n)))
        for _, name, path in paths:
            if left <= 0:
                break
            seen = out.get(name)
            start = resume_at(path, seen)
            end = whole_lines_end(path, start, left)
            if end > start:
                n = min(HEAD, end)
                out[name] = [end, head_hash(path, n), n, first_line_hash(path, n)]
                left -= end - start
        self.last = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces = []
        for name, now in end.items():
            seen = start.get(name)
            begin = seen[0] if same_file(seen, now) else 0
            for at in range(begin, now[0], self.piece):
                pieces.append(Piece(os.path.join(self.folder, name), at, min(at + self.piece, now[0]), begin, now[0], now[1], now[2]))
        return pieces

    def read(self, piece: Piece):
        if os.path.getsize(piece.path) < piece.whole or head_hash(piece.path, piece.hashed) != piece.head:
            return  # another file by now; what the offsets name is gone
        log = os.path.basename(piece.path)
        for at, raw in lines_between(piece.path, piece.start, piece.end, piece.first):
            yield (log, at, raw.decode("utf-8", "replace").rstrip("\r\n"))

    def commit(self, end: dict) -> None:
        if self.cursor:
            with open(f"{self.cursor}.new", "w") as f:
                json.dump(end, f)
            os.replace(f"{self.cursor}.new", self.cursor)


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "log string, line_no bigint, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))
