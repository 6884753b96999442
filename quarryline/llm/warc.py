"""Operator 2: WARC archives, a normaliser for monolithic gzip, and a reader by offset index.

``write_archives`` writes one WARC record for each page into archives that are
one gzip stream each, as crawlers that compress whole files leave them: nothing
in such a file can be reached without inflating all before it.

``normalise`` inflates each whole-file stream once, in pieces, cuts it into
records, and rewrites every record as a gzip member of its own beside a
sidecar ``.idx`` file (JSON lines: offset, length, record id, type, page,
digest). While it rewrites, a record whose payload another page also has turns
into a revisit of that page: its payload goes, its HTTP header stays.

``read_archives`` follows the sidecars: it seeks to a record, inflates that
member alone, and checks the payload against its digest. A gzip stream that is not
finished, or an archive with fewer or more records than were written, is an
error, wherever the file ends.

Payload equality is equality of SHA-1 and length. The page with the largest id
keeps the payload; which pages are copies is decided on (digest, page id) rows,
never on the payloads, which stay where they were read. Files are named by the
attempt that wrote them and count only if the written manifest names them.

Defined results: a null html is an empty payload; a null url has no target
header; null page ids stand below all others; of rows with equal page id and
payload, the one in the last file and place is the response; payloads below
``min_bytes`` are all responses; an empty table gives no archives and no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.shared import new_folder, open_fs, written

#: An archive is closed when it has had so many payload bytes or records.
ARCHIVE_BYTES = 64 << 20
ARCHIVE_RECORDS = 50_000
LEVEL = 6
CHUNK = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages have no fetch time

RECORDS = "file string, record int, page_id long, payload_bytes long, payload_digest string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(file: str, record: int) -> str:
    return f"<urn:quarryline:{file}:{record}>"


def _header(fields: dict[str, str | None]) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace")


def _http(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def _one_line(url: str | None) -> str | None:
    return None if url is None else "".join(c if c.isprintable() and c != " " else "%%%02X" % ord(c) for c in url)


def _raw_writer(folder: str):
    """Rows of pages to monolithic archives; yields a row for each record."""

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, where = open_fs(folder)
        task, state, number = TaskContext.get(), None, 0
        for batch in batches:
            rows = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None:
                    file = f"raw-{task.partitionId():07d}-{task.taskAttemptId()}-{number:05d}"
                    fs.create_dir(where, recursive=True)
                    state, number, held, count = (fs.open_output_stream(f"{where}/{file}.warc.gz", compression=None), zlib.compressobj(LEVEL, wbits=31)), number + 1, 0, 0
                payload = (html or "").encode("utf-8", "replace")
                digest, http = digest_of(payload), _http(len(payload))
                head = _header(
                    {
                        "WARC-Type": "response",
                        "WARC-Record-ID": _id(file, count),
                        "WARC-Date": DATE,
                        "WARC-Target-URI": _one_line(url),
                        "WARC-Payload-Digest": f"sha1:{digest}",
                        "X-Page-ID": None if page is None else str(page),
                        "Content-Type": "application/http; msgtype=response",
                        "Content-Length": str(len(http) + len(payload)),
                    }
                )
                for piece in (head, http, payload, b"\r\n\r\n"):
                    state[0].write(state[1].compress(piece))
                rows.append((file, count, page, len(payload), digest))
                held, count = held + len(payload), count + 1
                if held >= ARCHIVE_BYTES or count >= ARCHIVE_RECORDS:
                    state[0].write(state[1].flush())
                    state[0].close()
                    state = None
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=["file", "record", "page_id", "payload_bytes", "payload_digest"])
        if state is not None:
            state[0].write(state[1].flush())
            state[0].close()

    return write


def write_archives(pages: DataFrame, folder: str, *, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """Write monolithic archives to ``folder``; returns one row for each record."""
    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(payload_col).cast("string"))
    return written(rows.mapInArrow(_raw_writer(folder), RECORDS), "warc-records")


class Inflated:
    """The inflated bytes of one whole-file gzip stream, in pieces; members that follow one another are one stream too."""

    def __init__(self, source):
        self.source, self.buffer, self.left = source, bytearray(), b""
        self.zip, self.begun = zlib.decompressobj(wbits=31), False

    def _more(self) -> bool:
        """Inflate another piece. False at the end of the file; an unfinished stream is an error."""
        data = self.left or self.source.read(CHUNK)
        if not data:
            if self.begun and not self.zip.eof:
                raise EOFError("the file ends within a gzip stream")
            return False
        self.left, self.begun = b"", True
        if self.zip.eof:
            self.zip = zlib.decompressobj(wbits=31)
        self.buffer += self.zip.decompress(data, CHUNK)
        self.left = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with the mark, None if the file ends before any."""
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                if self.buffer.strip():
                    raise EOFError("the file ends within a header")
                return None
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise EOFError("the file ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(source):
    """(header fields, block) of each WARC record of a gzip source, in order."""
    stream = Inflated(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").lstrip("\r\n").split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        block = stream.exactly(int(fields["Content-Length"]))
        stream.exactly(4)
        yield fields, block


def _normaliser(folder: str):
    """Rows (file, n records, copies: those records that become revisits) to archives with a member for each record."""

    def rewrite(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, where = open_fs(folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for i in range(batch.num_rows):  # one archive's copies at a time
                row = batch.slice(i, 1).to_pylist()[0]
                refers, file = {c["record"]: c for c in row["copies"] or ()}, f"{row['file'].replace('raw-', 'warc-')}-{attempt}"
                offset = count = 0
                with fs.open_input_stream(f"{where}/{row['file']}.warc.gz", compression=None) as source, fs.open_output_stream(f"{where}/{file}.warc.gz", compression=None) as out, fs.open_output_stream(f"{where}/{file}.idx") as index:
                    for n, (fields, block) in enumerate(records(source)):
                        if n in refers:
                            block = block[: block.index(b"\r\n\r\n") + 4]
                            fields |= {
                                "WARC-Type": "revisit",
                                "WARC-Profile": REVISIT_PROFILE,
                                "WARC-Refers-To": _id(refers[n]["to_file"], refers[n]["to_record"]),
                                "X-Refers-To-Page-ID": None if refers[n]["to_page"] is None else str(refers[n]["to_page"]),
                                "Content-Length": str(len(block)),
                            }
                        zipper = zlib.compressobj(LEVEL, wbits=31)
                        member = zipper.compress(_header(fields)) + zipper.compress(block + b"\r\n\r\n") + zipper.flush()
                        out.write(member)
                        entry = {"offset": offset, "length": len(member), "id": fields["WARC-Record-ID"], "type": fields["WARC-Type"], "page": fields.get("X-Page-ID"), "digest": fields.get("WARC-Payload-Digest")}
                        index.write((json.dumps(entry) + "\n").encode())
                        offset, count = offset + len(member), count + 1
                    if count != row["n"]:
                        raise ValueError(f"{row['file']} has {count} of {row['n']} records")
                yield pa.RecordBatch.from_pydict({"file": [file], "records": pa.array([count], pa.int64()), "bytes": pa.array([offset], pa.int64())})

    return rewrite


def copies(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """file, record, to_file, to_record, to_page for each record that another one stands for."""
    key = ["payload_digest", "payload_bytes"]
    place = F.struct(F.col("page_id"), F.col("file"), F.col("record"))
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy(*key).agg(F.max(place).alias("best"), F.count("*").alias("n")).where("n > 1")
    # written, so that both sides of the join are plain shuffles: Spark splits the one of a payload that very many pages have
    return (
        rows.select("file", "record", *key)
        .join(written(groups.select(*key, "best"), "warc-groups"), key)
        .where((F.col("file") != F.col("best.file")) | (F.col("record") != F.col("best.record")))
        .select("file", "record", F.col("best.file").alias("to_file"), F.col("best.record").alias("to_record"), F.col("best.page_id").alias("to_page"))
    )


def normalise(rows: DataFrame, folder: str, *, min_bytes: int = 0) -> DataFrame:
    """Rewrite every archive that ``rows`` (of write_archives) name; returns one row for each new archive.

    An archive has ARCHIVE_RECORDS records at most, and so has what is gathered for it.
    """
    slots = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    known = copies(rows, min_bytes).groupBy("file").agg(F.collect_list(F.struct("record", "to_file", "to_record", "to_page")).alias("copies"))
    sizes = rows.groupBy("file").agg(F.count("*").alias("n"))
    jobs = sizes.join(known, "file", "left").repartition(4 * slots, "file").select("file", "n", "copies")
    return written(jobs.mapInArrow(_normaliser(folder), "file string, records long, bytes long"), "warc-manifest")


def _reader(folder: str):
    def read(batches):
        import pyarrow as pa

        fs, where = open_fs(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{where}/{file}.idx") as f:
                    index = [json.loads(line) for line in f.read().splitlines()]
                with fs.open_input_file(f"{where}/{file}.warc.gz") as source:
                    for a in range(0, len(index), 500):
                        out = []
                        for entry in index[a : a + 500]:
                            source.seek(entry["offset"])
                            data = zlib.decompress(source.read(entry["length"]), wbits=31)
                            head, _, rest = data.partition(b"\r\n\r\n")
                            fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
                            block = rest[: int(fields["Content-Length"])]
                            http, _, payload = block.partition(b"\r\n\r\n")
                            size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
                            digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                            if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
                                raise ValueError(f"{file}: the payload at {entry['offset']} does not match its digest")
                            whole = lambda k: int(fields[k]) if k in fields else None
                            out.append((whole("X-Page-ID"), size, digest, kind, whole("X-Refers-To-Page-ID"), fields.get("WARC-Target-URI"), file, entry["offset"], entry["length"]))
                        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=NAMES)

    return read


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "archive", "record_offset", "record_length"]
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, archive string, record_offset long, record_length long"


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each record, read through the sidecar indexes."""
    slots = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("file").repartition(4 * slots, "file").mapInArrow(_reader(folder), READ)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    rows = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(normalise(rows, folder, min_bytes=0), folder)
