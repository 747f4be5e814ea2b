"""Where the stored members of a ZIP package lie, from its central directory alone.

The directory is found from the file's end. Packages beyond 4 GB or 65535 members say so with
all bits set in the fields that are too small; the ZIP64 records then hold the numbers.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

# Signatures and sizes of the format's records.
END, END64_LOCATOR, END64 = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06"
ENTRY, LOCAL = b"PK\x01\x02", b"PK\x03\x04"
END_BYTES, LOCATOR_BYTES, END64_BYTES, ENTRY_BYTES, LOCAL_BYTES = 22, 20, 56, 46, 30
LONGEST_COMMENT = 65535
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
ZIP64_EXTRA = 1
STORED = 0
ENCRYPTED = 1


@dataclass(frozen=True)
class Member:
    name: str
    start: int  # first byte of its content in the package
    size: int
    method: int


def read_at(file, start: int, n: int) -> bytes:
    file.seek(start)
    data = file.read(n)
    if len(data) != n:
        raise ValueError(f"the package ends within {n} bytes from {start}")
    return data


def _directory(file, size: int) -> tuple[int, int, int]:
    """Start and size of the central directory and its number of entries."""
    tail_start = max(0, size - END_BYTES - LONGEST_COMMENT)
    tail = read_at(file, tail_start, size - tail_start)
    at = len(tail)
    while (at := tail.rfind(END, 0, at)) >= 0:
        # the signature may also occur in the comment: its length must reach the file's end
        if at + END_BYTES <= len(tail):
            fields = struct.unpack("<4s4H2LH", tail[at: at + END_BYTES])
            if at + END_BYTES + fields[7] == len(tail):
                break
    else:
        raise ValueError("no end of a central directory: not a whole ZIP package")
    disk, entries, length, start = fields[1], fields[4], fields[5], fields[6]
    end = tail_start + at
    if FULL16 in (disk, entries) or FULL32 in (length, start):
        locator = read_at(file, end - LOCATOR_BYTES, LOCATOR_BYTES) if end >= LOCATOR_BYTES else b""
        if locator[:4] == END64_LOCATOR:
            end64 = struct.unpack("<4sLQL", locator)[2]
            record = struct.unpack("<4sQ2H2L4Q", read_at(file, end64, END64_BYTES))
            if record[0] != END64:
                raise ValueError("the ZIP64 locator points to no ZIP64 end record")
            disk, entries, length, start = record[4], record[7], record[8], record[9]
    if disk:
        raise ValueError("packages in several parts are not read")
    return start, length, entries


def _wide(extra: bytes, full: list[bool]) -> list[int]:
    """The 64-bit numbers of an entry, in the order of the fields that are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<2H", extra, at)
        if kind == ZIP64_EXTRA:
            if length < 8 * sum(full):
                break
            return list(struct.unpack_from(f"<{sum(full)}Q", extra, at + 4))
        at += 4 + length
    raise ValueError("a directory entry has no ZIP64 numbers")


def members(file, size: int) -> list[Member]:
    """All members in the order of the directory; only the directory and local headers are read."""
    start, length, entries = _directory(file, size)
    directory, at, found = read_at(file, start, length), 0, []
    for _ in range(entries):
        if directory[at: at + 4] != ENTRY:
            raise ValueError(f"no directory entry at {start + at}")
        (flags, method, packed, plain, n_name, n_extra, n_comment, local) = (
            struct.unpack_from("<8x2H8x2L3H8xL", directory, at))
        name_at = at + ENTRY_BYTES
        name = directory[name_at: name_at + n_name]
        extra = directory[name_at + n_name: name_at + n_name + n_extra]
        numbers = [plain, packed, local]
        full = [n == FULL32 for n in numbers]
        if any(full):
            wide = iter(_wide(extra, full))
            numbers = [next(wide) if f else n for n, f in zip(numbers, full)]
        plain, packed, local = numbers
        if flags & ENCRYPTED:
            raise ValueError(f"member {name!r} is encrypted")
        header = read_at(file, local, LOCAL_BYTES)
        if header[:4] != LOCAL:
            raise ValueError(f"member {name!r} has no local header at {local}")
        # name and extra field of the local header have lengths of their own
        content = local + LOCAL_BYTES + sum(struct.unpack_from("<2H", header, 26))
        found.append(Member(name.decode("utf-8", "replace"), content, packed, method))
        at += ENTRY_BYTES + n_name + n_extra + n_comment
    return found
