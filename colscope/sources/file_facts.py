"""Size, hash, header and lines of files as stored, each read once as a stream in constant memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "file_name string, path string, bytes bigint, sha256 string, header string, rows bigint"
#: Bytes that are read, and at most unpacked, at a time.
STEP_BYTES = 4 << 20
#: A header longer than this is cut: it equals no declared one.
HEADER_BYTES = 1 << 20


def file_facts(spark: SparkSession, paths: Sequence[str], step: int = STEP_BYTES) -> DataFrame:
    """One row a file: its name, path, size and sha256 as stored, its first line, and its later lines that hold text.

    A ``.gz`` file's lines are those of its unpacked text, whatever the number of members in it. Each file is one
    partition of its own, read front to back in steps of ``step`` bytes: a sha256 has no other order. No
    file is held, so its size has no limit. An empty file has no header (null) and no rows. Paths are opened
    through Arrow's file systems; a scheme it doesn't know fails the read.
    """
    spark.dataSource.register(_source())
    reader = spark.read.format("colscope_file_facts").option("step", str(step)).option("paths", "\n".join(paths))
    return reader.load()


def _source():
    """The data source's class. Made in a function, it travels to the workers by value."""
    import re
    import zlib
    from hashlib import sha256

    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    schema, longest = SCHEMA, HEADER_BYTES

    def opened(path: str):
        from pyarrow import fs

        if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path):
            system, inner = fs.FileSystem.from_uri(path)
        else:
            system, inner = fs.LocalFileSystem(), path
        return system.open_input_stream(inner, compression=None, buffer_size=0)

    def unpacked(packed: bytes, state: list, step: int):
        """The unpacked bytes of a piece of a gzip file, at most ``step`` at a time; members follow one another."""
        while packed:
            if state[0] is None:
                state[0] = zlib.decompressobj(zlib.MAX_WBITS | 16)
            yield state[0].decompress(packed, step)
            packed = state[0].unconsumed_tail
            if state[0].eof:
                packed, state[0] = state[0].unused_data, None

    class Lines:
        """Counts lines with text, and keeps the first, over pieces cut anywhere."""

        def __init__(self):
            self.header, self.in_header, self.rows, self.text = b"", True, 0, False

        def add(self, piece: bytes) -> None:
            if self.in_header:
                head, end, piece = piece.partition(b"\n")
                self.header = (self.header + head)[:longest]
                if not end:
                    return
                self.in_header = False
            first, *rest = piece.split(b"\n")
            self.text = self.text or bool(first.strip())
            if rest:
                self.rows += self.text + sum(1 for line in rest[:-1] if line and not line.isspace())
                self.text = bool(rest[-1].strip())

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.paths = [p for p in options.get("paths", "").split("\n") if p]
            self.step = int(options["step"])

        def partitions(self):
            return [InputPartition(p) for p in self.paths]

        def read(self, partition):
            path = partition.value
            digest, size, lines, state = sha256(), 0, Lines(), [None]
            with opened(path) as stream:
                while piece := stream.read(self.step):
                    digest.update(piece)
                    size += len(piece)
                    for text in unpacked(piece, state, self.step) if path.endswith(".gz") else [piece]:
                        lines.add(text)
            if state[0] is not None:
                raise EOFError(f"{path} ends within a gzip member")
            header = lines.header.decode("utf-8", "replace").removesuffix("\r") if size else None
            yield (path.rsplit("/", 1)[-1], path, size, digest.hexdigest(), header, lines.rows + lines.text)

    class FileFacts(DataSource):
        @classmethod
        def name(cls):
            return "colscope_file_facts"

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options)

    return FileFacts
