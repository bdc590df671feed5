"""Text files as a stream with positions: the `meter_lines` data source.

A line's position is its file and the byte it starts at, so every line has one offset, and a stream can start at the latest
one: what the files held before it started never comes. Files may grow and new ones appear; a line counts once it is
ended. The checkpoint keeps how far each file was read, so a restart goes on there, and a batch that is run again reads the
same bytes.

Positions of all files of the folder are in each offset; move old files away once they are done (a file that is gone is
left out). The driver only looks at sizes and at the last bytes of files that have grown; tasks read stretches of at most
`bytesPerPartition`. Files are reached through Arrow's file systems, by path or URI.

Options: `path`, a folder; `startingOffsets`, `latest` (the default) or `earliest`; `bytesPerPartition`; `topic`.
"""

import json
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from kilowatch.vocabulary import RAW_TOPIC

SCHEMA = "value string, topic string, partition int, offset bigint, timestamp timestamp, file string"
STRETCH = 64 << 20
TAIL = 64 << 10
PIECE = 1 << 20
LINES = 10_000


class Stretch(InputPartition):
    def __init__(self, file, start, stop, modified):
        self.file, self.start, self.stop, self.modified = file, start, stop, modified


def _opened(path):
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _last_end(system, file, since, size):
    """Where the last ended line of a file stops, at or after `since`; read backwards, a bounded piece at a time."""
    with system.open_input_file(file) as opened:
        stop = size
        while stop > since:
            start = max(since, stop - TAIL)
            opened.seek(start)
            place = opened.read(stop - start).rfind(b"\n")
            if place >= 0:
                return start + place + 1
            stop = start
    return since


def _lines(opened, start, stop):
    """(offset, bytes) of the ended lines that start at `start` or later and before `stop`; the last may end beyond it."""
    at = max(start - 1, 0)
    opened.seek(at)
    # The line of the byte before the first one belongs to the stretch before; it is empty if that byte ends a line.
    others, held = start > 0, []
    while piece := opened.read(PIECE):
        if b"\n" not in piece:
            held.append(piece)
            continue
        ended = b"".join([*held, piece]).split(b"\n")
        held = [ended.pop()]
        for line in ended:
            if at >= stop:
                return
            if not others:
                yield at, line
            at, others = at + len(line) + 1, False
        if at >= stop:
            return


class LineReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.earliest = options.get("startingOffsets", "latest") == "earliest"
        self.stretch = int(options.get("bytesPerPartition", STRETCH))
        self.topic = options.get("topic", RAW_TOPIC)
        self.ends = {}

    def _files(self):
        system, folder = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        names = ((f.base_name, f) for f in found if f.type == fs.FileType.File)
        return system, {name: f for name, f in names if not name.startswith(("_", "."))}

    def _ends(self):
        system, files = self._files()
        for name, info in files.items():
            known = self.ends.get(name, (0, 0))
            # Sizes of a file that has not grown since it was looked at need no second look.
            if info.size > known[1]:
                self.ends[name] = (_last_end(system, info.path, known[0], info.size), info.size)
        return {name: self.ends[name][0] for name in sorted(files) if name in self.ends}

    def initialOffset(self):
        return {} if self.earliest else self._ends()

    def latestOffset(self):
        return self._ends()

    def partitions(self, start, end):
        _, files = self._files()
        found = []
        for name, stop in end.items():
            info = files.get(name)
            for low in range(start.get(name, 0), stop if info else 0, self.stretch):
                modified = info.mtime or datetime.fromtimestamp(0, timezone.utc)
                found.append(Stretch(info.path, low, min(low + self.stretch, stop), modified))
        return found

    def read(self, partition):
        """Lines that start within the stretch; the last one may end beyond it."""
        system, _ = _opened(self.path)
        name = partition.file.rsplit("/", 1)[-1]
        number = zlib.crc32(name.encode()) & 0x7FFFFFFF
        modified = partition.modified.astimezone(timezone.utc)
        lines, offsets = [], []

        def batch():
            n = len(lines)
            columns = [
                pa.array(lines, pa.string()), pa.array([self.topic] * n, pa.string()), pa.array([number] * n, pa.int32()), pa.array(offsets, pa.int64()),
                pa.array([modified] * n, pa.timestamp("us", "UTC")), pa.array([name] * n, pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["value", "topic", "partition", "offset", "timestamp", "file"])

        with system.open_input_file(partition.file) as opened:
            for offset, line in _lines(opened, partition.start, partition.stop):
                offsets.append(offset)
                lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                if len(lines) == LINES:
                    yield batch()
                    lines, offsets = [], []
        yield batch()


class LineSource(DataSource):
    @classmethod
    def name(cls):
        return "meter_lines"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return LineReader(self.options)


def line_messages(spark, path, starting="latest", **options):
    """Stream of the lines of a folder's files as raw messages, with the file each is from."""
    spark.dataSource.register(LineSource)
    return spark.readStream.format("meter_lines").options(path=path, startingOffsets=starting, **options).load()
