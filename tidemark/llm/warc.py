"""Web archives in ZIP packages: written from pages, and read back in ranges without extraction.

A package holds a stored member `archive/data.warc.gz`, one gzip member a record, and a stored
index `indexes/index.cdxj` with the place of every record. A reader finds both in the central
directory, cuts the archive at places that the index names into ranges of about RANGE_BYTES and
deals these out, so that the size of a package bounds neither tasks nor memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_arrow
from .stored import new_name, opened, scratch_folder
from .zip_members import STORED, Member, members, read_at

ARCHIVE, INDEX, LISTING = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
ARCHIVES = re.compile(r"archive/.*\.warc(\.gz)?")
INDEXES = re.compile(r"indexes/.*\.cdxj?")
# Bytes and records after which a task begins another package; bytes of one range, and of the ranges
# that one task reads; bytes that are read and inflated at a time.
PACKAGE_BYTES, PACKAGE_RECORDS = 256 << 20, 1 << 18
RANGE_BYTES, TASK_BYTES, CHUNK_BYTES = 1 << 20, 16 << 20, 1 << 18
COPIES_A_ROW = 10_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PACKAGES = "package string, n_records long, n_bytes long"
RECORDS = ("package string, member string, offset long, record_id string, record_type string, "
           "target_uri string, payload binary, payload_bytes long, payload_digest string, "
           "refers_to_id string")
_UNSAFE = re.compile("[\x00-\x20\x7f]")


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page_id: int | None, digest: str, *more) -> str:
    return f"<urn:page:{':'.join(map(str, ('' if page_id is None else page_id, digest, *more)))}>"


def page_of(id_column: str):
    """The page id that a record id of `write_packages` holds."""
    return F.regexp_extract(id_column, "^<urn:page:(-?[0-9]*):", 1).try_cast("long")


def record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\n{lines}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _uri(url: str | None) -> str | None:
    """The url without characters that would end a header line."""
    return None if url is None else _UNSAFE.sub(lambda c: f"%{ord(c[0]):02X}", url)


class _Package:
    """One package that is being written, record by record."""

    def __init__(self, folder: str):
        self.path = new_name(folder, "pages.wacz")
        self.id = uuid.uuid4().hex
        store, inner = opened(self.path)
        self.out = store.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.size, self.lines, self.hash = 0, [], hashlib.sha256()

    def add(self, url: str | None, digest: str, content: bytes) -> None:
        packed = gzip.compress(content, 6, mtime=0)
        self.member.write(packed)
        self.hash.update(packed)
        place = {"url": url, "digest": f"sha1:{digest}", "offset": str(self.size),
                 "length": str(len(packed)), "filename": ARCHIVE.rpartition("/")[2]}
        self.lines.append(f"{url or '-'} {re.sub('[^0-9]', '', DATE)} {json.dumps(place)}\n")
        self.size += len(packed)

    def close(self) -> pa.RecordBatch:
        self.member.close()
        index = "".join(sorted(self.lines)).encode()
        self.zip.writestr(zipfile.ZipInfo(INDEX), index)
        resources = [
            {"name": path.rpartition("/")[2], "path": path, "hash": f"sha256:{digest}", "bytes": n}
            for path, digest, n in ((ARCHIVE, self.hash.hexdigest(), self.size),
                                    (INDEX, hashlib.sha256(index).hexdigest(), len(index)))]
        self.zip.writestr(zipfile.ZipInfo(LISTING), json.dumps(
            {"profile": "data-package", "wacz_version": "1.1.1", "resources": resources}))
        self.zip.close()
        self.out.close()
        return pa.RecordBatch.from_pydict(
            {"package": [self.path], "n_records": [len(self.lines)], "n_bytes": [self.size]})

    def abandon(self) -> None:
        self.out.close()


def _with_roles(rows: DataFrame, folder: str, least_bytes: int) -> DataFrame:
    """Every row as a record: payloads of responses only, and what a revisit refers to.

    Payloads are told apart by their SHA-256. Of equal ones, the greatest (page_id, url) is the
    response, nulls least; if that row itself repeats, one of its copies is, and the others
    are made from their number, so that no group is gathered. The payloads that repeat are
    written out first: their measured size decides how they are joined.
    """
    spark = rows.sparkSession
    key = F.unhex(F.sha2("payload", 256)).alias("key")
    keyed = rows.select("page_id", "url", "payload", key, F.octet_length("payload").cast(
        "long").alias("payload_bytes"), F.sha1("payload").alias("sha1"))
    counted = keyed.where(F.col("payload_bytes") >= least_bytes).groupBy(
        "key", "page_id", "url", "payload_bytes", "sha1").agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("page_id").isNotNull().alias("has_id"), "page_id",
                     F.col("url").isNotNull().alias("has_url"), "url", "copies")
    repeats = counted.groupBy("key", "payload_bytes", "sha1").agg(
        F.max(order).alias("top"), F.sum("copies").alias("n")).where("n > 1")
    repeats.select("key", "payload_bytes", "sha1", "top.page_id", "top.url", "top.copies").write.parquet(
        f"{folder}/repeats")
    repeats = spark.read.parquet(f"{folder}/repeats")
    tops = repeats.select("key", F.struct("page_id", "url", "copies").alias("top"))
    joined = keyed.join(tops, "key", "left")
    is_top = F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(
        F.col("top.url"))
    repeated = F.col("top").isNotNull()
    columns = ("page_id", "url", "payload", "payload_bytes", "sha1")

    def records(df, revisit, cited):
        payload = F.when(~revisit, F.col("payload")).alias("payload")
        return df.select(
            "page_id", "url", payload, "payload_bytes", "sha1", revisit.alias("revisit"),
            cited.alias("cited"), F.col("top.page_id").alias("of_page"),
            F.col("top.url").alias("of_url"))

    tied = repeated & is_top & (F.col("top.copies") > 1)
    single = records(joined.where(~tied), repeated & ~is_top, repeated & is_top)
    one = joined.where(tied).groupBy("key").agg(
        *(F.first(c).alias(c) for c in (*columns, "top")))
    # further copies of the response, in rows that stand for some thousand each and spread
    more = repeats.where("copies > 1").withColumn("left", F.explode(F.sequence(
        F.lit(1), F.col("copies") - 1, F.lit(COPIES_A_ROW))))
    more = more.repartition("key", "left").withColumn("copy", F.explode(F.sequence(
        F.col("left"), F.least(F.col("left") + COPIES_A_ROW - 1, F.col("copies") - 1))))
    more = more.withColumns({"payload": F.lit(None).cast("binary"),
                             "top": F.struct("page_id", "url", "copies")})
    return single.unionByName(records(one, F.lit(False), F.lit(True))).unionByName(
        records(more, F.lit(True), F.lit(False)))


def write_packages(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
    html_column: str = "html", least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES,
) -> DataFrame:
    """Write a record for every page and return the packages: (package, n_records, n_bytes).

    The payload is the html in UTF-8, empty if null. Of pages with equal payloads of at least
    `least_bytes`, the one with the greatest id (then url) is a response and the others are
    revisits that refer to it; smaller payloads are all responses. Rows that repeat have a record
    each; null ids and urls are allowed, an empty table gives no package, and other columns are not
    read. Control characters and blanks of a url are percent-encoded. The packages and their
    list lie in the shared folder; what a lost task attempt wrote is on no list.
    """
    spark = pages.sparkSession
    folder = scratch_folder(spark, "packages")
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(html_column), F.lit("")).cast("binary").alias("payload"))

    def run(batches):
        package = None
        try:
            for batch in batches:
                for page_id, url, payload, n, sha1, revisit, cited, of_page, of_url in zip(
                        *(column.to_pylist() for column in batch.columns)):
                    if package is None:
                        package = _Package(folder)
                    digest, url = base32(sha1), _uri(url)
                    own = () if cited else (package.id, len(package.lines))
                    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                            f"Content-Length: {n}\r\n\r\n").encode()
                    package.add(url, digest, record("revisit" if revisit else "response", {
                        "WARC-Record-ID": record_id(page_id, digest, *own), "WARC-Date": DATE,
                        "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}",
                        "WARC-Profile": PROFILE if revisit else None,
                        "WARC-Refers-To": record_id(of_page, digest) if revisit else None,
                        "WARC-Refers-To-Target-URI": _uri(of_url) if revisit else None,
                        "Content-Type": "application/http; msgtype=response",
                    }, http if revisit else http + payload))
                    if package.size >= package_bytes or len(package.lines) >= PACKAGE_RECORDS:
                        yield package.close()
                        package = None
            if package is not None:
                yield package.close()
                package = None
        finally:
            if package is not None:
                package.abandon()

    in_arrow(_with_roles(rows, folder, least_bytes), run, PACKAGES).write.parquet(f"{folder}/list")
    return spark.read.schema(PACKAGES).parquet(f"{folder}/list")


def find_packages(spark: SparkSession, folder: str, names: str = "*.wacz") -> DataFrame:
    """(package, n_bytes) of all files below a folder; their contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", names).load(folder)
            .select(F.col("path").alias("package"), F.col("length").alias("n_bytes")))


def _cuts(file, archive: Member, found: list[Member], range_bytes: int) -> list[int]:
    """Places in a stored archive at which a range may begin: its start, and records of the index."""
    places = set()
    for index in found:
        if not INDEXES.fullmatch(index.name):
            continue
        if index.method != STORED:
            raise ValueError(f"member {index.name} is compressed")
        for line in read_at(file, index.start, index.size).splitlines():
            place = json.loads(line[line.index(b"{"):])
            if place["filename"] == archive.name.rpartition("/")[2]:
                places.add(int(place["offset"]))
    cuts = [0]
    for place in sorted(places):
        if place - cuts[-1] >= range_bytes and place < archive.size:
            cuts.append(place)
    return cuts


def archive_ranges(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(package, member, base, first, stop): ranges that hold whole records, together all of them.

    `first` and `stop` count from the archive member's start `base`. An archive without an
    index is one range. An archive member that is compressed in its package can't be read in
    ranges and is an error, as are encrypted and torn packages.
    """
    schema = "package string, member string, base long, first long, stop long"

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = opened(path)
                with store.open_input_file(inner) as file:
                    found = members(file, file.size())
                    rows = []
                    for archive in found:
                        if not ARCHIVES.fullmatch(archive.name):
                            continue
                        if archive.method != STORED:
                            raise ValueError(f"member {archive.name} of {path} is compressed")
                        cuts = _cuts(file, archive, found, range_bytes)
                        rows += [(path, archive.name, archive.start, first, stop)
                                 for first, stop in zip(cuts, [*cuts[1:], archive.size])]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column) for column in zip(*rows)],
                        ["package", "member", "base", "first", "stop"])

    return in_arrow(packages.select("package"), run, schema)


def _pieces(file, base: int, first: int, stop: int, packed: bool) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of a range, inflated if packed; the place is that of the gzip member."""
    file.seek(base + first)
    at, unpack, begun = first, None, first
    while at < stop:
        data = file.read(min(CHUNK_BYTES, stop - at))
        if not data:
            raise ValueError(f"the package ends before {base + stop}")
        at += len(data)
        if not packed:
            yield at - len(data), data
            continue
        while data:
            if unpack is None:
                begun, unpack = at - len(data), zlib.decompressobj(wbits=31)
            yield begun, unpack.decompress(data)
            data = unpack.unused_data
            if unpack.eof:
                unpack = None
            elif not data:
                break
    if unpack is not None:
        raise ValueError(f"a record is cut off at {stop}")


def records_of(pieces: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, dict, bytes]]:
    """(place, headers, block) of each record; header names are in lower case."""
    held, place = bytearray(), 0
    wanted, headers, start = None, None, 0
    for at, data in pieces:
        if not held:
            place = at
        held += data
        while True:
            if headers is None:
                end = held.find(b"\r\n\r\n", start)
                if end < 0:
                    start = max(0, len(held) - 3)
                    break
                lines = held[:end].decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no record at {place}")
                headers = {k.strip().lower(): v.strip()
                           for k, _, v in (line.partition(":") for line in lines[1:])}
                wanted, start = (end + 4, end + 4 + int(headers["content-length"])), 0
            if len(held) < wanted[1] + 4:
                break
            yield place, headers, bytes(held[wanted[0]: wanted[1]])
            if held[wanted[1]: wanted[1] + 4] != b"\r\n\r\n":
                raise ValueError(f"the record at {place} has no end")
            del held[: wanted[1] + 4]
            headers, place = None, at
    if held:
        raise ValueError(f"the record at {place} is cut off")


def _payload(headers: dict, block: bytes) -> tuple[bytes | None, int]:
    """The payload and its size; a revisit has only the size, from its HTTP headers."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block, len(block)
    head, _, body = block.partition(b"\r\n\r\n")
    if headers["warc-type"] != "revisit":
        return body, len(body)
    length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    return None, int(length[1]) if length else 0


def read_packages(
    packages: DataFrame, range_bytes: int = RANGE_BYTES, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """One row per record of the packages' archives, whatever wrote them.

    package, member, offset (of its gzip member in the archive), record_id, record_type, target_uri,
    payload (null for revisits), payload_bytes, payload_digest (bare base32 SHA-1; computed from
    the payload, and of a revisit as the record says) and refers_to_id. Headers that are missing
    are null. A payload that is not the one its record names is an error. Packages of a list that
    repeat are read once; `packages` needs `package` and `n_bytes`.
    """
    listed = packages.select("package", "n_bytes").distinct()
    total = listed.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = archive_ranges(listed, range_bytes).repartition(max(1, -(-total // task_bytes)))
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def rows(path, member, base, first, stop):
        store, inner = opened(path)
        with store.open_input_file(inner) as file:
            pieces = _pieces(file, base, first, stop, member.endswith(".gz"))
            for place, headers, block in records_of(pieces):
                payload, n = _payload(headers, block)
                named = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                digest = named
                if payload is not None:
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if named not in (None, digest) and ":" not in named:
                        raise ValueError(f"{path}: the payload at {place} of {member} is damaged")
                yield (path, member, place, headers.get("warc-record-id"),
                       headers.get("warc-type"), headers.get("warc-target-uri"), payload, n,
                       digest, headers.get("warc-refers-to"))

    schema = pa.schema([
        (name, {"long": pa.int64(), "binary": pa.binary()}.get(kind, pa.string()))
        for name, kind in (c.split() for c in RECORDS.split(", "))])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for place in zip(*(column.to_pylist() for column in batch.columns)):
                for row in rows(*place):
                    held.append(row)
                    size += 500 + row[names.index("payload_bytes")]
                    if size >= range_bytes:
                        yield _batch(held, schema)
                        held, size = [], 0
        if held:
            yield _batch(held, schema)

    return in_arrow(ranges, run, RECORDS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), schema.types)], schema=schema)


def page_records(records: DataFrame) -> DataFrame:
    """One row per page of the records that `write_packages` made: ids instead of record ids."""
    return records.select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of("refers_to_id").alias("refers_to"))
