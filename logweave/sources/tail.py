"""A growing log file as a streaming data source: lines with their arrival number, in batches of bounded size.

spark.dataSource.register(TailSource), then readStream.format("logtail") with path, batch_lines (20) and start
("begin" or "end"). Offsets are bytes and lines read, so a restart from a checkpoint goes on after the last line that
was committed. A line counts when its end has been written; blank lines are skipped and not numbered. The file is
read by one task per batch of at most LARGEST_LINES lines, as it is one writer's; more files are more streams. A file
that became shorter was begun anew and is read from its beginning. The path must be one that all executors can read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "seq long, raw string"
BATCH_LINES, LARGEST_LINES, CHUNK = 20, 100_000, 1 << 20


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return TailReader(self.options)


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("logtail needs a path")
        self.path = options["path"].removeprefix("file://")
        self.batch_lines = min(LARGEST_LINES, max(1, int(options.get("batch_lines", BATCH_LINES))))
        self.start = options.get("start", "begin")

    def initialOffset(self) -> dict:
        size = os.path.getsize(self.path) if self.start == "end" and os.path.exists(self.path) else 0
        return {"byte": size, "seq": 0}

    def _lines(self, byte: int, seq: int, most: int | None, end: int | None) -> tuple[list[tuple[int, str]], int, int]:
        """Whole lines from a byte on, at most so many or up to the byte end; the byte and number after them."""
        out: list[tuple[int, str]] = []
        with open(self.path, "rb") as f:
            f.seek(byte)
            rest = b""
            while (most is None or len(out) < most) and (end is None or byte < end):
                chunk = f.read(CHUNK)
                if not chunk:
                    break
                *whole, rest = (rest + chunk).split(b"\n")
                for line in whole:
                    if (most is not None and len(out) >= most) or (end is not None and byte >= end):
                        break
                    byte += len(line) + 1
                    text = line.rstrip(b"\r").decode("utf-8", "replace")
                    if text.strip():
                        out.append((seq, text))
                        seq += 1
        return out, byte, seq

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if not os.path.exists(self.path):
            return iter(()), start
        byte = start["byte"] if start["byte"] <= os.path.getsize(self.path) else 0
        lines, byte, seq = self._lines(byte, start["seq"], self.batch_lines, None)
        return iter(lines), {"byte": byte, "seq": seq}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same lines once more, after a failure."""
        byte = start["byte"] if start["byte"] <= end["byte"] else 0
        return iter(self._lines(byte, start["seq"], None, end["byte"])[0])

    def commit(self, end: dict) -> None:
        pass
