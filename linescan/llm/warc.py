"""Web archives in Zstandard: one frame for each record, behind a dictionary of the archive's own.

An archive begins with a skippable frame that holds a dictionary, itself
compressed, fitted to the first records of that archive. Every record is a frame
by itself, so a reader can begin at any of them and a damaged one costs no
other. Tasks write archives under hidden names, the commit puts them in place;
tasks read them frame by frame and hold one record at a time.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from linescan.sources.manifest import file_system

from .tables import keep, new_path, table

# Fixed values of the formats: frames of Zstandard, the dictionary's frame, a dictionary, and a profile of revisits.
FRAME = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY_FRAME = 0x184D2A5D
RAW_DICTIONARY = 0xEC30A437
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEVEL = 3
#: A dictionary of so many bytes at most is fitted to the first records of an archive, about so many bytes of them.
DICTIONARY_BYTES, SAMPLE_BYTES = 1 << 15, 1 << 20
#: A task goes on to another archive when one holds so many bytes.
ARCHIVE_BYTES = 1 << 28
#: Payloads below this are written out, however often they occur.
LEAST_REVISIT_BYTES = 100
#: So many payloads that occur more than once may be broadcast.
BROADCAST_ROWS = 50_000
CHUNK = 1 << 20


def sha256(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record: version, headers, block and its end."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", sha256(block)), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def header_safe(uri: str) -> str:
    """The URI with white space and control characters as percent codes, so that it stays on its line."""
    return re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri)


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def page_record(page_id: int | None, uri: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """A page as a response, or, without a payload, as a revisit of the page that it refers to.

    Both hold the head of the HTTP answer, which says how long the whole payload is.
    """
    kind = "response" if payload is not None else "revisit"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", page_urn(page_id)), ("WARC-Date", date)]
    if uri is not None:
        headers.append(("WARC-Target-URI", header_safe(uri)))
    headers.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if payload is None:
        headers += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", page_urn(refers_to))]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    return record(headers, http + (payload or b""))


def fitted_dictionary(records: list[bytes]):
    """A dictionary for records like these; None where there is too little to fit one to."""
    import zstandard

    samples = [r[: SAMPLE_BYTES // 8] for r in records]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * DICTIONARY_BYTES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # the samples have nothing in common
        return None


@dataclass
class Archives(WriterCommitMessage):
    hidden: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str):
        self.path, self.date, self.run = path, date, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        import zstandard

        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        hidden: list[str] = []
        sink, packer, waiting, size = None, None, [], 0

        def begin() -> None:
            nonlocal sink, packer
            hidden.append(f"{root}/.{self.run}.{uuid.uuid4().hex}.tmp")
            sink = system.open_output_stream(hidden[-1])
            dictionary = fitted_dictionary(waiting)
            if dictionary is not None:
                body = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
                sink.write(struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
            packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
            about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")]
            for r in (record(about, b"format: WARC File Format 1.1\r\n"), *waiting):
                sink.write(packer.compress(r))
            waiting.clear()

        try:
            for batch in iterator:
                columns = (batch.column(c) for c in ("page_id", "uri", "payload", "n_bytes", "digest", "refers_to"))
                for row in zip(*columns):
                    made = page_record(*(v.as_py() for v in row), self.date)
                    size += len(made)
                    if sink is not None:
                        sink.write(packer.compress(made))
                    else:
                        waiting.append(made)
                        if size >= SAMPLE_BYTES:
                            begin()
                    if sink is not None and sink.tell() >= ARCHIVE_BYTES:
                        sink.close()
                        sink, size = None, 0
            if waiting:
                begin()
            if sink is not None:
                sink.close()
        except BaseException:
            for f in hidden:
                _remove(system, f)
            raise
        return Archives(hidden)

    def commit(self, messages: list[Archives | None]) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        names = sorted(f for m in messages if m for f in m.hidden)
        for k, f in enumerate(names):
            system.move(f, f"{root}/{self.run}-{k:06d}.warc.zst")
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(f".{self.run}."):  # of attempts that failed
                _remove(system, info.path)

    def abort(self, messages: list[Archives | None]) -> None:
        self.commit([])


def _remove(system, path: str) -> None:
    try:
        system.delete_file(path)
    except OSError:  # gone already
        pass


class Damaged(ValueError):
    """What is wrong with a frame or a record."""


def frames(stream) -> Iterator[tuple[int, bytes | Damaged]]:
    """(position, record or what is wrong) of each frame of an archive; ``stream`` has read(n).

    The dictionary of a leading skippable frame serves all that follow, other
    skippable frames are passed over. Behind a damaged frame reading goes on at the
    next place that looks like a frame.
    """
    import zstandard

    held, at = b"", 0  # bytes that were read but not used, and where they lie
    dictionary = None

    def more() -> bool:
        nonlocal held
        new = stream.read(CHUNK)
        held += new
        return bool(new)

    def have(n: int) -> bool:
        while len(held) < n:
            if not more():
                return False
        return True

    def use(n: int) -> None:
        nonlocal held, at
        held, at = held[n:], at + n

    while have(1):
        if not have(4):
            yield at, Damaged("cut short")
            return
        (magic,) = struct.unpack_from("<I", held)
        if magic in SKIPPABLE:
            if not have(8):
                yield at, Damaged("cut short")
                return
            (size,) = struct.unpack_from("<I", held, 4)
            if at == 0 and magic == DICTIONARY_FRAME:
                if not have(8 + size):
                    yield at, Damaged("the dictionary is cut short")
                    return
                try:
                    dictionary = dictionary_of(held[8 : 8 + size])
                except (zstandard.ZstdError, Damaged) as error:
                    yield at, Damaged(f"bad dictionary: {error}")
            left = 8 + size
            while left and have(1):
                n = min(left, len(held))
                use(n)
                left -= n
            if left:
                yield at, Damaged("cut short")
            continue
        start, problem, parts = at, None, []
        if magic != FRAME:
            problem = Damaged("no frame")
        else:
            unpacked = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            try:
                while True:
                    parts.append(unpacked.decompress(held))
                    if unpacked.eof:
                        use(len(held) - len(unpacked.unused_data))
                        break
                    use(len(held))
                    if not more():
                        yield start, Damaged("cut short")
                        return
            except zstandard.ZstdError as error:
                problem = Damaged(f"bad frame: {error}")
        if problem is None:
            yield start, b"".join(parts)
            continue
        yield start, problem
        use(min(1, len(held)) if at == start else 0)
        while (found := held.find(struct.pack("<I", FRAME))) < 0:
            use(max(0, len(held) - 3))
            if not more():
                return
        use(found)


def dictionary_of(body: bytes):
    """The dictionary of a leading frame, stored as it is or compressed."""
    import zstandard

    (magic,) = struct.unpack_from("<I", body) if len(body) >= 4 else (0,)
    if magic == FRAME:
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    elif magic != RAW_DICTIONARY:
        raise Damaged("neither a dictionary nor a frame that holds one")
    return zstandard.ZstdCompressionDict(body)


FIELDS = "file string, position long, record_type string, record_id string, refers_to string, date string, uri string, payload_digest string, payload_bytes long, payload binary, problem string"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
KINDS = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary(), pa.string()]


def parsed(raw: bytes) -> dict:
    """The fields of a record, after its headers, lengths and digests were found to be right; else Damaged."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise Damaged("no WARC header")
    headers: dict[str, str] = {}
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise Damaged(f"not a header: {line[:80]!r}")
        if name.lower() in headers and name.lower() != "warc-concurrent-to":
            raise Damaged(f"repeated header {name}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(name):
            raise Damaged(f"no {name}")
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z", headers["warc-date"]):
        raise Damaged("bad WARC-Date")
    if not re.fullmatch(r"<[^<>\s]+>", headers["warc-record-id"]):
        raise Damaged("bad WARC-Record-ID")
    if not re.fullmatch(r"[0-9]+", headers["content-length"]) or len(rest) != int(headers["content-length"]) + 4:
        raise Damaged("Content-Length is not the block's")
    block, end = rest[:-4], rest[-4:]
    if end != b"\r\n\r\n":
        raise Damaged("the record does not end with two empty lines")
    _check(headers, "warc-block-digest", block)
    kind = headers["warc-type"]
    out = {
        "record_type": kind, "record_id": headers["warc-record-id"], "refers_to": headers.get("warc-refers-to"), "date": headers["warc-date"], "uri": headers.get("warc-target-uri"),
        "payload_digest": headers.get("warc-payload-digest"), "payload_bytes": None, "payload": None,
    }
    if kind in ("response", "revisit") and headers.get("content-type", "").startswith("application/http"):
        http, gap, body = block.partition(b"\r\n\r\n")
        if not gap or not http.startswith(b"HTTP/"):
            raise Damaged("no HTTP header")
        said = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)[ \t]*(?:\r\n|$)", http)
        if said and kind == "response" and int(said[1]) != len(body):
            raise Damaged("HTTP Content-Length is not the payload's")
        if kind == "response":
            _check(headers, "warc-payload-digest", body)
            out |= {"payload": body, "payload_bytes": len(body)}
        else:
            if not out["refers_to"]:
                raise Damaged("a revisit of nothing")
            out["payload_bytes"] = int(said[1]) if said else None
    elif kind != "revisit":
        out |= {"payload": block, "payload_bytes": len(block)}
    return out


def _check(headers: dict[str, str], name: str, data: bytes) -> None:
    """Digests of other kinds than SHA-256 are taken on trust."""
    said = headers.get(name, "")
    if said.startswith("sha256:") and said != sha256(data):
        raise Damaged(f"{name} is not that of the data")


@dataclass
class Archive(InputPartition):
    file: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool, strict: bool):
        self.path, self.payloads, self.strict = path, payloads, strict

    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        system, root = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = [f.path for f in found if f.base_name.endswith(".warc.zst") and not f.base_name.startswith((".", "_"))]
        return [Archive(f) for f in sorted(files)] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, root = file_system(self.path)
        name = partition.file.removeprefix(root).lstrip("/")
        rows, size = [], 0
        with system.open_input_stream(partition.file, compression=None) as stream:  # else the suffix would have it unpacked
            for at, raw in frames(stream):
                row = dict.fromkeys(NAMES) | {"file": name, "position": at}
                try:
                    if isinstance(raw, Damaged):
                        raise raw
                    row |= parsed(raw)
                except Damaged as error:
                    if self.strict:
                        raise Damaged(f"{name} at {at}: {error}") from None
                    row["problem"] = str(error)
                if not self.payloads:
                    row["payload"] = None
                rows.append(row)
                size += 200 + len(row["payload"] or b"")
                if size >= 4 * CHUNK:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(NAMES, KINDS)], NAMES)


class WarcArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc_zst"

    def schema(self) -> str:
        return FIELDS

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options["date"])

    def reader(self, schema: StructType) -> WarcReader:
        flag = lambda k: self.options.get(k, "true").lower() == "true"
        return WarcReader(self.options["path"], flag("payloads"), flag("strict"))


def with_first(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(page_id, uri, payload, n_bytes, digest, refers_to): ``pages`` with the page that each is a revisit of, or its payload."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").alias("uri"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("n_bytes"), F.sha2(payload, 256).alias("digest"))
    seen = rows.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    seen = keep(seen.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "repeated")
    if seen.count() <= BROADCAST_ROWS:
        seen = F.broadcast(seen)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    refers_to = F.when(again, F.col("first"))
    return rows.join(seen, "digest", "left").select("page_id", "uri", F.when(~again, F.col("payload")).alias("payload"), "n_bytes", "digest", refers_to.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, date: datetime | None = None) -> None:
    """A record for each row of ``pages`` (page_id, url, html), in new archives below ``path``.

    The payload is the html in UTF-8, a null html an empty one; of equal payloads of
    100 bytes and more that of the smallest page_id is a response, all rows of that
    page_id are, if it repeats, and the others are revisits of it. A null page_id is a
    revisit where another page has the payload, else a response. A null url has no
    header; white space in a url is written as percent codes. No pages give no archives.
    Other columns are ignored. Records may have any length; a task holds one at a time,
    and about 1 MB of them to fit a dictionary to.
    """
    pages.sparkSession.dataSource.register(WarcArchives)
    when = (date or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    with_first(pages).write.format("warc_zst").option("date", when).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True, strict: bool = True) -> DataFrame:
    """The records of all archives (``*.warc.zst``) below ``path``, other writers' too: (file, position, record_type, record_id,
    refers_to, date, uri, payload_digest, payload_bytes, payload, problem).

    A damaged frame or record is an error; unless ``strict``, it is a row that says
    what the problem is, and all others are read. Without ``payloads`` they are checked
    but not returned. A folder without archives, or none, gives no rows.
    """
    spark.dataSource.register(WarcArchives)
    return spark.read.format("warc_zst").options(payloads=str(payloads), strict=str(strict)).load(path)


def pages_of(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the pages among the records."""
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    found = records.where(F.col("record_type").isin("response", "revisit"))
    digest = F.regexp_replace("payload_digest", "^sha256:", "")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return pages_of(read_archives(spark, path, payloads=False))


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
r AS (SELECT *, n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r
"""
