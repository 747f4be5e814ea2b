"""Archives in ZIP packages: round trips, the directory's forms, and damaged files."""

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile

import duckdb
import pytest

from tidemark.llm import warc, zip_members
from tidemark.llm.queries import QUERIES

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain_records(rows, least=0):
    """(page_id, html) -> the contract's rows, by a dictionary."""
    groups = {}
    for page_id, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out = []
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        for at, page_id in enumerate(ids):
            response = at == len(ids) - 1 or len(payload) < least
            out.append((page_id, len(payload), digest(payload),
                        "response" if response else "revisit", None if response else ids[-1]))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x or 0) for x in r))


def through(pages, **options):
    return warc.page_records(warc.read_packages(warc.write_packages(pages, **options)))


def test_query(spark, sf_dir):
    found = QUERIES["op11_warc"](spark, sf_dir)
    pages = duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall()
    assert found.columns == COLUMNS
    assert ordered(found.collect()) == ordered(plain_records(pages))


AWKWARD = [
    (1, "http://a/", "same"), (2, "http://b/", "same"), (9, "http://c/", "same"),
    (9, "http://c/", "same"), (9, "http://c/", "same"), (9, "http://d/", "other"),
    (None, None, "same"), (None, "http://e/\r\nWARC-Type: x", None), (4, "", ""), (5, None, ""),
    (6, "http://f/ é", "é\r\n\r\nWARC/1.1\r\n\r\n"), (7, "http://g/", "x" * 3_000_000),
    (-8, "http://h/", "same"), (10, "u", "\x00\x01"), (10, "u", "\x00\x01"),
]


@pytest.mark.parametrize("least", [0, 1, 5])
def test_awkward_pages(spark, least):
    pages = spark.createDataFrame(
        [(*r, "x", 3) for r in AWKWARD],
        "page_id long, url string, html string, key string, payload int").repartition(3)
    found = through(pages, least_bytes=least)
    assert ordered(found.collect()) == ordered(plain_records([(i, h) for i, _, h in AWKWARD], least))


def test_copies_beyond_one_row(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES_A_ROW", 7)
    rows = [(3, "u", "copy")] * 50 + [(2, "u", "copy")]
    found = through(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert ordered(found.collect()) == ordered(plain_records([(i, h) for i, _, h in rows]))


def test_empty_table(spark):
    assert through(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_records_and_small_ranges(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    packages = warc.write_packages(pages, package_bytes=20_000)
    assert packages.count() > 3
    whole = warc.read_packages(packages)
    for row in whole.collect():
        store, inner = warc.opened(row.package)
        with store.open_input_file(inner) as file:
            member = next(m for m in zip_members.members(file, file.size()) if m.name == row.member)
            content = gzip.decompress(zip_members.read_at(
                file, member.start + row.offset, member.size - row.offset)[:1 << 20])
        assert f"WARC-Record-ID: {row.record_id}".encode() in content
    small = warc.read_packages(packages, range_bytes=500, task_bytes=1000)
    assert warc.archive_ranges(packages, 500).count() > 20
    assert ordered(small.drop("payload").collect()) == ordered(whole.drop("payload").collect())
    html = {r.page_id: r.html for r in pages.collect()}
    read = whole.withColumn("page_id", warc.page_of("record_id")).collect()
    assert {r.page_id: r.payload.decode() for r in read if r.payload} == {
        k: v for k, v in html.items() if v}


def test_other_readers_understand_the_packages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    package = warc.write_packages(pages).first().package
    with zipfile.ZipFile(package.removeprefix("file:")) as found:
        assert found.testzip() is None
        listing = json.loads(found.read(warc.LISTING))
        for resource in listing["resources"]:
            content = found.read(resource["path"])
            assert resource["hash"] == "sha256:" + hashlib.sha256(content).hexdigest()
        lines = found.read(warc.INDEX).decode().splitlines()
        assert lines == sorted(lines)
        archive = found.read(warc.ARCHIVE)
    for line in lines[:5]:
        place = json.loads(line[line.index("{"):])
        start = int(place["offset"])
        one = gzip.decompress(archive[start: start + int(place["length"])])
        assert one.startswith(b"WARC/1.1\r\n") and place["url"].encode() in one


def _package(tmp_path, name, files, method=zipfile.ZIP_STORED, comment=b""):
    path = tmp_path / name
    with open(path, "wb") as out:
        with zipfile.ZipFile(out, "w", method) as package:
            for member, content in files:
                package.writestr(member, content)
            package.comment = comment
    return str(path)


def _listed(spark, *paths):
    return spark.createDataFrame([(p, 1) for p in paths], "package string, n_bytes long")


RECORDS = [
    warc.record("warcinfo", {"WARC-Record-ID": "<urn:a>", "Content-Type": "text/plain"}, b"about"),
    warc.record("response", {"WARC-Record-ID": "<urn:b>", "Content-Type": "application/http"},
                b"HTTP/1.1 200 OK\r\n\r\nbody"),
    warc.record("resource", {"WARC-Record-ID": "<urn:c>"}, b""),
]


def test_foreign_packages(spark, tmp_path):
    """Plain and packed archives, several in a package, with and without an index, one gzip member."""
    packed = [gzip.compress(r) for r in RECORDS]
    line = json.dumps({"filename": "two.warc.gz", "offset": len(packed[0])})
    files = [
        ("archive/one.warc", b"".join(RECORDS)), ("archive/two.warc.gz", b"".join(packed)),
        ("archive/three.warc.gz", gzip.compress(b"".join(RECORDS))), ("pages/pages.jsonl", b"{}"),
        ("indexes/index.cdxj", f"key 1970 {line}\n".encode()), ("archive/four.warc", b""),
    ]
    path = _package(tmp_path, "a.wacz", files, comment=b"PK\x05\x06 in a comment" * 9)
    packages = warc.find_packages(spark, str(tmp_path))
    assert packages.count() == 1
    rows = warc.read_packages(packages, range_bytes=1).collect()
    assert len(rows) == 9
    for member in ("one.warc", "two.warc.gz", "three.warc.gz"):
        of = sorted((r.record_id, r.record_type, bytes(r.payload), r.payload_bytes, r.payload_digest)
                    for r in rows if r.member == f"archive/{member}")
        assert of == [("<urn:a>", "warcinfo", b"about", 5, digest(b"about")),
                      ("<urn:b>", "response", b"body", 4, digest(b"body")),
                      ("<urn:c>", "resource", b"", 0, digest(b""))]
    assert warc.archive_ranges(_listed(spark, path), 1).count() == 5


def _as_zip64(path):
    """The same package with all numbers of the directory in ZIP64 records."""
    with open(path, "rb") as file:
        data = file.read()
        with io.BytesIO(data) as whole:
            start, length, entries = zip_members._directory(whole, len(data))
    out, at = bytearray(data[:start]), start
    for _ in range(entries):
        entry = bytearray(data[at: at + 46])
        packed, plain = struct.unpack_from("<2L", entry, 20)
        n_name, n_extra, n_comment = struct.unpack_from("<3H", entry, 28)
        local, = struct.unpack_from("<L", entry, 42)
        rest = data[at + 46: at + 46 + n_name + n_extra + n_comment]
        wide = struct.pack("<2H3s", 0x9999, 3, b"any") + struct.pack("<2H3Q", 1, 24, plain, packed, local)
        struct.pack_into("<2L", entry, 20, 0xFFFFFFFF, 0xFFFFFFFF)
        struct.pack_into("<H", entry, 30, n_extra + len(wide))
        struct.pack_into("<L", entry, 42, 0xFFFFFFFF)
        out += entry + rest[: n_name + n_extra] + wide + rest[n_name + n_extra:]
        at += 46 + len(rest)
    end64 = len(out)
    out += struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, entries, entries,
                       end64 - start, start)
    out += struct.pack("<4sLQL", b"PK\x06\x07", 0, end64, 1)
    out += struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    with open(path, "wb") as file:
        file.write(out)


def test_zip64(tmp_path):
    files = [("archive/one.warc", b"".join(RECORDS)), ("indexes/é.cdxj", b"x")]
    path = _package(tmp_path, "a.wacz", files)
    with open(path, "rb") as file:
        size = file.seek(0, 2)
        plain = zip_members.members(file, size)
    _as_zip64(path)
    with zipfile.ZipFile(path) as check:
        assert check.testzip() is None
    with open(path, "rb") as file:
        assert zip_members.members(file, file.seek(0, 2)) == plain
        assert zip_members.read_at(file, plain[0].start, plain[0].size) == files[0][1]


def test_more_members_than_16_bits(tmp_path):
    path = _package(tmp_path, "a.zip", [(f"m{i}", b"") for i in range(66_000)])
    with open(path, "rb") as file:
        found = zip_members.members(file, file.seek(0, 2))
    assert len(found) == 66_000 and found[-1].name == "m65999"


def test_beyond_four_gigabytes():
    """A sparse package: the archive begins past what 32 bits can say."""
    class Sparse(io.RawIOBase):
        parts, size, at = {}, 0, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            for start, data in self.parts.items():
                if start <= self.at < start + len(data):
                    return data[self.at - start: self.at - start + n]
            raise AssertionError("read outside of the directory")

    far, name = 5 << 30, b"archive/one.warc"
    local = struct.pack("<4s5H3L2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0, 0, len(name), 0) + name
    entry = struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF,
                        len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF)
    entry += name + struct.pack("<2H3Q", 1, 24, 6 << 30, 6 << 30, far)
    start = 12 << 30
    end64 = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), start)
    locator = struct.pack("<4sLQL", b"PK\x06\x07", 0, start + len(entry), 1)
    end = struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 1, 1, len(entry), 0xFFFFFFFF, 0)
    tail = bytes(1 << 17) + entry + end64 + locator + end
    file = Sparse()
    file.parts = {far: local, start - (1 << 17): tail}
    found, = zip_members.members(file, start - (1 << 17) + len(tail))
    assert (found.start, found.size) == (far + len(local), 6 << 30)


def test_damaged_packages(spark, tmp_path):
    good = b"".join(RECORDS)
    cases = {
        "compressed": _package(tmp_path, "a.zip", [("archive/a.warc", good)], zipfile.ZIP_DEFLATED),
        "not a whole ZIP": _package(tmp_path, "b.zip", [("archive/a.warc", good)]),
        "cut off": _package(tmp_path, "c.zip", [("archive/a.warc", good[:-9])]),
        "no record": _package(tmp_path, "d.zip", [("archive/a.warc", b"x" + good)]),
        "is damaged": _package(tmp_path, "e.zip", [("archive/a.warc", warc.record(
            "resource", {"WARC-Payload-Digest": "sha1:" + digest(b"other")}, b"one"))]),
    }
    with open(cases["not a whole ZIP"], "r+b") as file:
        file.truncate(40)
    for message, path in cases.items():
        with pytest.raises(Exception, match=message):
            warc.read_packages(_listed(spark, path)).collect()


def test_a_lost_attempt_is_not_read(spark):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    packages = warc.write_packages(pages)
    folder = packages.first().package.removeprefix("file:").rpartition("/")[0]
    with open(f"{folder}/pages-lost.wacz", "wb") as file:
        file.write(b"PK")
    assert warc.read_packages(packages).count() == 1
