"""Byte streams outside tables: a file system for executors, streamed hashing, and a sink that downloads files.

`spark.dataSource.register(Downloads)`, then `df.write.format("downloads").option("path", folder).mode("append").save()`
for rows of url and filename (and role, retrieval_command). Each task streams its rows' files into a folder of its own
that readers don't see, with their hashes and sizes; the commit drops what failed attempts left and makes all visible by one rename,
so the folder must be in a file system that renames folders.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from siltstone.sources.web import RETRIES, RETRYABLE, wait_seconds

BLOCK = 1 << 20
#: Fixed value: the size beyond which a download is refused.
MAX_BYTES = 2_000_000_000
MANIFEST = "role string, filename string, source_uri string, local_path string, byte_size long, sha256 string, content_type string, retrieval_command string"


def file_system(path: str):
    """The pyarrow file system of a path and the path within it; paths without a scheme are local."""
    from pyarrow import fs

    if local := re.match(r"^file:(?://)?(/.*)$", path) or re.match(r"^(/.*)$", path):
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(path)


def blocks(path: str, size: int = BLOCK) -> Iterator[bytes]:
    system, inner = file_system(path)
    with system.open_input_stream(inner) as f:
        while block := f.read(size):
            yield block


def hashed_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes and sha256 of a folder's files, of any size: only names and sizes are listed, and executors read the
    files in blocks."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                for block in blocks(path):
                    digest.update(block)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], ["path", "bytes", "sha256"])

    listed = spark.read.format("binaryFile").load(folder).selectExpr("path", "length AS bytes")
    return listed.mapInArrow(digests, "path string, bytes long, sha256 string")


def _opened(url: str, timeout: float, sleep: Callable[[float], None]):
    for attempt in range(RETRIES + 1):
        try:
            return urllib.request.urlopen(url, timeout=timeout)  # noqa: S310
        except urllib.error.HTTPError as e:
            if e.code not in RETRYABLE or attempt == RETRIES:
                raise
            sleep(wait_seconds(attempt, dict(e.headers)))
        except OSError:
            if attempt == RETRIES:
                raise
            sleep(wait_seconds(attempt, None))
    raise AssertionError


def streamed(url: str, system, to: str, *, max_bytes: int = MAX_BYTES, timeout: float = 60, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str, str | None]:
    """Stream an answer into a file: its size, hash and content type. Nothing is left of one that fails or is too large."""
    digest, size = hashlib.sha256(), 0
    try:
        with _opened(url, timeout, sleep) as answer, system.open_output_stream(to) as out:
            expected = answer.headers.get("Content-Length")
            while block := answer.read(BLOCK):
                size += len(block)
                if size > max_bytes:
                    raise ValueError(f"download exceeds max_bytes for {url}")
                digest.update(block)
                out.write(block)
        if expected is not None and size != int(expected):
            raise OSError(f"{url}: {size} of {expected} bytes")
    except Exception:
        from pyarrow import fs

        if system.get_file_info(to).type != fs.FileType.NotFound:
            system.delete_file(to)
        raise
    return size, digest.hexdigest(), answer.headers.get("Content-Type")


@dataclass
class _Written(WriterCommitMessage):
    part: str | None


class Downloads(DataSource):
    """The sink's options: path, max_bytes (of each file), timeout (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "downloads"

    def schema(self) -> str:
        return "url string, filename string, role string, retrieval_command string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("downloads are only appended")
        return _Writer(self.options, schema.fieldNames())


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, names: list[str]):
        if missing := {"url", "filename"} - set(names):
            raise ValueError(f"columns missing: {sorted(missing)}")
        self.path, self.job = options["path"].rstrip("/"), f"job-{uuid.uuid4().hex}"
        self.max_bytes, self.timeout = int(options.get("max_bytes", MAX_BYTES)), float(options.get("timeout", 60))
        system, root = file_system(self.path)
        system.create_dir(self._hidden(root))  # tasks only make folders in it, so none can write once the job is aborted

    def _hidden(self, root: str) -> str:
        return f"{root}/_temporary/{self.job}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyarrow import fs

        system, root = file_system(self.path)
        part = f"part-{uuid.uuid4().hex}"
        folder = f"{self._hidden(root)}/{part}"
        rows = []
        try:
            for row in iterator:
                own = row.asDict()
                name = own["filename"]
                if not name or "/" in name or name in (".", "..") or "\x00" in name:
                    raise ValueError(f"not a file name: {name!r}")
                within = f"{hashlib.sha256(own['url'].encode()).hexdigest()[:16]}/{name}"  # names may repeat, sources don't
                for inner in (folder, f"{folder}/{within.split('/')[0]}"):
                    if system.get_file_info(inner).type == fs.FileType.NotFound:
                        system.create_dir(inner, recursive=False)
                size, sha256, kind = streamed(own["url"], system, f"{folder}/{within}", max_bytes=self.max_bytes, timeout=self.timeout)
                rows.append({"role": own.get("role"), "filename": name, "source_uri": own["url"], "local_path": f"{self.path}/{self.job}/{part}/{within}", "byte_size": size, "sha256": sha256, "content_type": kind, "retrieval_command": own.get("retrieval_command")})
            if not rows:
                return _Written(None)
            with system.open_output_stream(f"{folder}/manifest.jsonl") as out:
                out.write("".join(json.dumps(r, sort_keys=True) + "\n" for r in rows).encode())
        except Exception:
            self._drop(system, folder)
            raise
        return _Written(part)

    @staticmethod
    def _drop(system, folder: str) -> None:
        from pyarrow import fs

        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        kept = {m.part for m in messages if m is not None and m.part}
        hidden = self._hidden(root)
        if kept:
            for info in system.get_file_info(fs.FileSelector(hidden)):  # a folder for each task, and for each lost attempt
                if info.base_name not in kept:
                    system.delete_dir(info.path)
            system.move(hidden, f"{root}/{self.job}")
        else:
            self._drop(system, hidden)
        self._drop_if_empty(system, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Tasks may still be writing: their folder gets another name first, so that they find it no more."""
        system, root = file_system(self.path)
        dropped = f"{root}/_temporary/dropped-{self.job}"
        system.move(self._hidden(root), dropped)
        for _ in range(5):
            try:
                self._drop(system, dropped)
                break
            except OSError:  # a file was just being made
                time.sleep(0.1)
        self._drop_if_empty(system, root)

    @staticmethod
    def _drop_if_empty(system, root: str) -> None:
        from pyarrow import fs

        if not system.get_file_info(fs.FileSelector(f"{root}/_temporary", allow_not_found=True)):
            _Writer._drop(system, f"{root}/_temporary")


def read_downloads(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of all committed downloads of a folder."""
    return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/job-*/part-*/manifest.jsonl")


def damaged(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Rows of a manifest whose file isn't there or differs from its size or hash."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                try:
                    for block in blocks(path):
                        digest.update(block)
                    found.append(digest.hexdigest())
                except FileNotFoundError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["_path", "_sha256"])

    now = manifest.select("local_path").mapInArrow(check, "_path string, _sha256 string")
    return manifest.join(now, manifest["local_path"] == now["_path"]).filter("NOT (_sha256 <=> sha256)").drop("_path", "_sha256")
