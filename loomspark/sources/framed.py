"""Session logs in one or more Zstandard frames, or plain; a torn last frame or line is tolerated."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"\x28\xb5\x2f\xfd"
#: Bytes handed to a frame's decoder at once.
PIECE = 1 << 16


def frames(data: bytes) -> Iterator[bytes]:
    """Contents of the whole frames; one cut short by the end is left out, anything else that is no frame is a ValueError."""
    import zstandard

    view, at = memoryview(data), 0
    while at < len(view):
        start, frame, out = at, zstandard.ZstdDecompressor().decompressobj(), []
        try:
            while at < len(view) and not frame.eof:
                piece = view[at : at + PIECE]
                out.append(frame.decompress(piece))
                at += len(piece)
        except zstandard.ZstdError as error:
            raise ValueError(f"no valid frame at byte {start}") from error
        if not frame.eof:
            return
        at -= len(frame.unused_data)
        yield b"".join(out)


def decoded(data: bytes) -> bytes:
    """All that can be decoded of a log."""
    if not data.startswith(MAGIC):
        return data
    out = []
    try:
        for frame in frames(data):
            out.append(frame)  # noqa: PERF402
    except ValueError:
        pass
    return b"".join(out)


def read_framed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, line, value) for the whole lines of all logs below path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                whole, _, _ = decoded(bytes(data)).rpartition(b"\n")
                lines = [x for x in whole.decode("utf-8", "replace").split("\n") if x.strip()]
                yield pd.DataFrame({"file": name, "line": range(len(lines)), "value": lines})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(run, "file string, line long, value string")
