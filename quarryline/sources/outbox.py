"""Deliveries as a data source: an outbox that writes whole batches or nothing, and a stream of what is in it.

``format("outbox")`` writes rows (delivery_id, url, payload). Each task writes
a file of its own attempt; the commit names the files in a manifest, and
only files that a manifest names are ever read. A task that fails or is aborted
removes its file. A streaming batch that is run again finds its manifest and
removes what it wrote in vain. As a stream, the outbox hands on its manifests in
order, with the number of the last one as its offset.

A delivery's id follows from what is delivered (``delivery_id``), so a
receiver, or ``undelivered``, knows a second attempt.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "delivery_id string, url string, payload string"


def delivery_id(job: Column, url: Column, payload: Column) -> Column:
    """The same for the same delivery, whichever attempt it is."""
    part = lambda c: F.coalesce(F.sha2(c.cast("string"), 256), F.lit(""))
    return F.sha2(F.concat(part(job), part(url), part(payload)), 256)


def undelivered(rows: DataFrame, outbox: DataFrame) -> DataFrame:
    """Rows whose delivery is not in the outbox yet, each once."""
    return rows.join(outbox.select("delivery_id"), "delivery_id", "left_anti").dropDuplicates(["delivery_id"])


RESULT = "delivery_id string, error string, transient boolean"


def deliver(rows: DataFrame, send: Callable[[str, str, str], None], *, passing: tuple[type[Exception], ...] = (OSError,), seconds: float = 5.0) -> DataFrame:
    """delivery_id, error, transient: each row (delivery_id, url, payload) sent once by ``send(delivery_id, url, payload)`` within a task.

    An error of the kinds ``passing`` (no connection, no answer in time) may
    go by and is transient, any other is not; neither stops the others.
    A task that is run again sends again, with the same id. ``seconds`` is set
    as the default time limit of connections while a task sends.
    """

    def run(batches):
        import socket

        import pyarrow as pa

        before = socket.getdefaulttimeout()
        socket.setdefaulttimeout(seconds)
        try:
            for batch in batches:
                errors, transient = [], []
                for row in batch.to_pylist():
                    try:
                        send(row["delivery_id"], row["url"], row["payload"])
                        errors.append(None)
                        transient.append(False)
                    except Exception as error:  # goes into the row
                        errors.append(f"{type(error).__name__}: {error}"[:500])
                        transient.append(isinstance(error, passing))
                yield pa.RecordBatch.from_arrays([batch.column("delivery_id"), pa.array(errors, pa.string()), pa.array(transient, pa.bool_())], names=["delivery_id", "error", "transient"])
        finally:
            socket.setdefaulttimeout(before)

    return rows.select("delivery_id", "url", "payload").mapInArrow(run, RESULT)


def post(delivery: str, url: str, payload: str) -> None:
    """Send one delivery as JSON over HTTP, its id as a header by which a receiver knows a second attempt. A refusal (4xx) is no passing error."""
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, data=json.dumps({"content": payload}).encode(), headers={"Content-Type": "application/json", "Idempotency-Key": delivery}, method="POST")
    try:
        with urllib.request.urlopen(request) as answer:
            answer.read()
    except urllib.error.HTTPError as error:
        if error.code < 500:
            raise ValueError(f"refused with {error.code}") from error
        raise


def opened(uri: str):
    """(file system, path) of pyarrow for a URI or a plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


@dataclass
class Part(InputPartition):
    file: str


def manifests(path: str) -> dict[int, list[str]]:
    """The files of each committed batch."""
    from pyarrow import fs as pafs

    fs, where = opened(path)
    found = {}
    for info in fs.get_file_info(pafs.FileSelector(where, allow_not_found=True)):
        name = info.path.rpartition("/")[2]
        if name.startswith("batch-") and name.endswith(".json"):
            with fs.open_input_stream(info.path) as f:
                found[int(name[6:-5])] = json.loads(f.read())
    return found


class _Attempts:
    """What the batch and the stream writer share."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        fs, where = opened(self.path)
        fs.create_dir(f"{where}/files", recursive=True)
        file, n = f"files/{uuid.uuid4().hex}.jsonl", 0
        try:
            with fs.open_output_stream(f"{where}/{file}") as out:
                for row in iterator:
                    out.write((json.dumps([row["delivery_id"], row["url"], row["payload"]]) + "\n").encode())
                    n += 1
        except BaseException:
            fs.delete_file(f"{where}/{file}")
            raise
        return Written(file, n)

    def remove(self, messages) -> None:
        fs, where = opened(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{where}/{m.file}")

    def name(self, messages, number: int) -> None:
        fs, where = opened(self.path)
        fs.create_dir(where, recursive=True)
        new = f"{where}/new-{uuid.uuid4().hex}"
        with fs.open_output_stream(new) as out:
            out.write(json.dumps([m.file for m in messages if m is not None and m.rows]).encode())
        fs.move(new, f"{where}/batch-{number}.json")
        self.remove([m for m in messages if m is not None and not m.rows])


class BatchWriter(_Attempts, DataSourceWriter):
    def commit(self, messages) -> None:
        self.name(messages, max(manifests(self.path), default=-1) + 1)

    def abort(self, messages) -> None:
        self.remove(messages)


class StreamWriter(_Attempts, DataSourceStreamWriter):
    def commit(self, messages, batchId) -> None:
        if batchId in manifests(self.path):
            self.remove(messages)
        else:
            self.name(messages, batchId)

    def abort(self, messages, batchId) -> None:
        self.remove(messages)


def rows_of(path: str, file: str):
    fs, where = opened(path)
    with fs.open_input_stream(f"{where}/{file}") as f:
        for line in f.read().splitlines():
            yield tuple(json.loads(line))


class BatchReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [Part(f) for _, files in sorted(manifests(self.path).items()) for f in files] or [Part("")]

    def read(self, partition):
        return rows_of(self.path, partition.file) if partition.file else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self):
        return {"batch": -1}

    def latestOffset(self):
        return {"batch": max(manifests(self.path), default=-1)}

    def partitions(self, start, end):
        return [Part(f) for n, files in sorted(manifests(self.path).items()) if start["batch"] < n <= end["batch"] for f in files]

    def read(self, partition):
        return rows_of(self.path, partition.file)

    def commit(self, end) -> None:
        pass


class Outbox(DataSource):
    """``spark.dataSource.register(Outbox)``, then ``format("outbox").option("path", folder)``; the folder is one that executors and driver share."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return BatchReader(self.options["path"])

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("an outbox is only added to")
        return BatchWriter(self.options["path"])

    def streamReader(self, schema):
        return StreamReader(self.options["path"])

    def streamWriter(self, schema, overwrite):
        return StreamWriter(self.options["path"])
