"""A FASTQ sink that commits: ``df.write.format("fastq_samples").mode("append").save(path)``.

Each task writes the reads of a sample to files of its own under a hidden folder and reports them; when all tasks are done, the driver moves
the reported files into the samples' folders. A task that fails, or is run again, leaves nothing in them, and what it wrote is removed. So a
sample is a set of finished files, each of whole records.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Files that a task keeps open; bytes of text that are gathered for one before they are compressed.
MOST_OPEN, BUFFER = 200, 1 << 20
COLUMNS = ("read_id", "sequence", "quality", "sample_name")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)  # (where a file is, where it belongs)


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


class FastqSamples(DataSource):
    """Columns read_id, sequence, quality and sample_name; others are ignored. Options: ``compress`` (true), ``suffix`` (fastq)."""

    @classmethod
    def name(cls) -> str:
        return "fastq_samples"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in COLUMNS)

    def writer(self, schema, overwrite: bool) -> SampleWriter:
        return SampleWriter(self.options, overwrite)


class SampleWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.compress = options.get("compress", "true").lower() == "true"
        self.suffix = options.get("suffix", "fastq") + (".gz" if self.compress else "")
        self.hidden = f"{self.path}/_unfinished-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, hidden = store(self.hidden)
        _, top = store(self.path)
        system.create_dir(hidden, recursive=True)
        attempt, message = uuid.uuid4().hex, Written()
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        files: dict[str, pa.NativeFile] = {}

        def flush(name: str) -> None:
            if name not in files:
                if len(files) >= MOST_OPEN:
                    close(next(iter(files)))
                folder = "sample=" + re.sub(r"[^\w.-]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), name)
                leaf = f"part-{attempt}-{len(message.files):05d}.{self.suffix}"
                files[name] = system.open_output_stream(f"{hidden}/{leaf}", compression=None)
                message.files.append((f"{hidden}/{leaf}", f"{top}/{folder}/{leaf}"))
            data = b"".join(held.pop(name))
            sizes[name] = 0
            files[name].write(gzip.compress(data, 6) if self.compress else data)  # members of a gzip file add up

        def close(name: str) -> None:
            if held.get(name):
                flush(name)
            if name in files:
                files.pop(name).close()

        try:
            for batch in iterator:
                for read, seq, quality, sample in zip(*(batch.column(c).cast(pa.string()).to_pylist() for c in COLUMNS)):
                    if None in (read, seq, quality) or len(seq) != len(quality):
                        raise ValueError(f"not a FASTQ record: {read!r}")
                    name = "undetermined" if sample is None else sample
                    record = f"@{read}\n{seq}\n+\n{quality}\n".encode()
                    held.setdefault(name, []).append(record)
                    sizes[name] = sizes.get(name, 0) + len(record)
                    if sizes[name] >= BUFFER:
                        flush(name)
            for name in [*held]:
                close(name)
            for name in [*files]:
                close(name)
        except BaseException:
            for file in files.values():
                file.close()
            for place, _ in message.files:
                system.delete_file(place)
            raise
        return message

    def commit(self, messages: list[Written | None]) -> None:
        """Moves every finished file to its sample; files that no message names (of attempts that failed) go with the hidden folder."""
        system, top = store(self.path)
        _, hidden = store(self.hidden)
        files = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            for info in system.get_file_info(pafs.FileSelector(top, allow_not_found=True)):
                if info.type == pafs.FileType.Directory and info.base_name.startswith("sample="):
                    system.delete_dir(info.path)
        for folder in {place.rsplit("/", 1)[0] for _, place in files}:
            system.create_dir(folder, recursive=True)
        for source, place in files:
            system.move(source, place)
        self._clear(system, hidden)
        with system.open_output_stream(f"{top}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        system, hidden = store(self.hidden)
        self._clear(system, hidden)

    @staticmethod
    def _clear(system: pafs.FileSystem, hidden: str) -> None:
        if system.get_file_info(hidden).type == pafs.FileType.Directory:
            system.delete_dir(hidden)
