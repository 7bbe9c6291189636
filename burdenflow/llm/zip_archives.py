"""ZIP packages that are read by ranges: the directory is parsed, and stored members are read in place.

A package is anything that gives the bytes of a range, so nothing is extracted and nothing but the directory, the
index and the wanted records is read. Both directories are understood, that of the original format and ZIP64.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

#: Signatures and fixed parts of the records, as the format's description has them.
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64, LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
LOCAL_HEAD = struct.Struct("<4sHHHHHIIIHH")
CENTRAL_HEAD = struct.Struct("<4sHHHHHHIIIHHHHHII")
END_HEAD = struct.Struct("<4sHHHHIIH")
END64_HEAD = struct.Struct("<4sQHHIIQQQQ")
LOCATOR64_HEAD = struct.Struct("<4sIQI")
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
ZIP64_FIELD, UTF8_NAMES, ENCRYPTED, STORED, VERSION64, FIRST_DAY = 1, 0x800, 1, 0, 45, 0x21


@dataclass
class Member:
    name: str
    method: int
    flags: int
    size: int
    packed: int
    header_at: int
    crc32: int


class Package:
    """Members of a ZIP package, given a function that reads `n` bytes from a place, and the package's size."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size = read, size
        self.members = {m.name: m for m in self._directory()}

    def _end(self) -> tuple[int, int, int]:
        """Entries of the directory, its size and its place."""
        reach = min(self.size, END_HEAD.size + FULL16)
        tail, at = self.read(self.size - reach, reach), reach
        while True:
            at = tail.rfind(END, 0, at + len(END) - 1) if at else -1
            if at < 0:
                raise ValueError("not a ZIP package: it has no end record")
            # the signature may also stand in the comment: that of the record has a comment up to the end
            if at + END_HEAD.size <= reach:
                *_, entries, length, start, comment = END_HEAD.unpack_from(tail, at)
                if at + END_HEAD.size + comment == reach:
                    break
        place = self.size - reach + at
        if FULL16 != entries and FULL32 not in (length, start) or place < LOCATOR64_HEAD.size:
            return entries, length, start
        mark, _, end64, _ = LOCATOR64_HEAD.unpack(self.read(place - LOCATOR64_HEAD.size, LOCATOR64_HEAD.size))
        if mark != LOCATOR64:
            return entries, length, start
        head = END64_HEAD.unpack(self.read(end64, END64_HEAD.size))
        if head[0] != END64:
            raise ValueError("the ZIP64 locator doesn't lead to an end record")
        return head[7], head[8], head[9]

    def _directory(self) -> list[Member]:
        entries, length, start = self._end()
        table, at, out = self.read(start, length), 0, []
        for _ in range(entries):
            if at + CENTRAL_HEAD.size > len(table) or table[at : at + 4] != CENTRAL:
                raise ValueError("the directory ends before its last entry")
            head = CENTRAL_HEAD.unpack_from(table, at)
            flags, method, crc32, packed, size, n_name, n_extra, n_comment, header_at = *head[3:5], *head[7:13], head[16]
            name_at = at + CENTRAL_HEAD.size
            extra = table[name_at + n_name : name_at + n_name + n_extra]
            size, packed, header_at = _wide(extra, size, packed, header_at)
            name = table[name_at : name_at + n_name].decode("utf-8" if flags & UTF8_NAMES else "cp437")
            out.append(Member(name, method, flags, size, packed, header_at, crc32))
            at = name_at + n_name + n_extra + n_comment
        return out

    def place(self, name: str) -> int:
        """Where the bytes of a stored member begin."""
        member = self.members[name]
        if member.method != STORED or member.flags & ENCRYPTED:
            raise ValueError(f"{name} is not stored as it is, so it can't be read by ranges")
        head = LOCAL_HEAD.unpack(self.read(member.header_at, LOCAL_HEAD.size))
        if head[0] != LOCAL:
            raise ValueError(f"the directory doesn't lead to {name}")
        return member.header_at + LOCAL_HEAD.size + head[9] + head[10]

    def range(self, name: str, offset: int, length: int) -> bytes:
        """Bytes of a stored member."""
        if offset < 0 or length < 0 or offset + length > self.members[name].size:
            raise ValueError(f"{name} has no such range")
        return self.read(self.place(name) + offset, length)

    def whole(self, name: str) -> bytes:
        data = self.range(name, 0, self.members[name].size)
        if zlib.crc32(data) != self.members[name].crc32:
            raise ValueError(f"{name} is damaged")
        return data


def _wide(extra: bytes, *fields: int) -> tuple[int, ...]:
    """Sizes and place, each from the ZIP64 field where the directory has no room for it."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == ZIP64_FIELD:
            given = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return tuple(next(given) if f == FULL32 else f for f in fields)
        at += 4 + n
    return fields


def package_bytes(members: dict[str, bytes], zip64: bool | None = None, comment: int = 0) -> bytes:
    """A package of stored members whose last `comment` bytes (a comment) are left to the caller.

    ZIP64 records are written where they are needed, or always or never.
    """
    out, entries, at = [], [], 0
    for name, data in members.items():
        label, crc32, n = name.encode(), zlib.crc32(data), len(data)
        wide = zip64 if zip64 is not None else max(n, at) >= FULL32
        version, shown = (VERSION64, FULL32) if wide else (20, n)
        extra = struct.pack("<HHQQ", ZIP64_FIELD, 16, n, n) if wide else b""
        head = LOCAL_HEAD.pack(LOCAL, version, UTF8_NAMES, STORED, 0, FIRST_DAY, crc32, shown, shown, len(label), len(extra))
        extra64 = struct.pack("<HHQQQ", ZIP64_FIELD, 24, n, n, at) if wide else b""
        entry = CENTRAL_HEAD.pack(CENTRAL, version, version, UTF8_NAMES, STORED, 0, FIRST_DAY, crc32, shown, shown, len(label), len(extra64), 0, 0, 0, 0, FULL32 if wide else at)
        out += [head, label, extra, data]
        entries.append(entry + label + extra64)
        at += len(head) + len(label) + len(extra) + n
    table, n = b"".join(entries), len(entries)
    wide = zip64 if zip64 is not None else n >= FULL16 or max(len(table), at) >= FULL32
    if wide:
        out64 = END64_HEAD.pack(END64, END64_HEAD.size - 12, VERSION64, VERSION64, 0, 0, n, n, len(table), at)
        end = out64 + LOCATOR64_HEAD.pack(LOCATOR64, 0, at + len(table), 1)
        end += END_HEAD.pack(END, 0, 0, FULL16, FULL16, FULL32, FULL32, comment)
    else:
        end = END_HEAD.pack(END, 0, 0, n, n, len(table), at, comment)
    return b"".join([*out, table, end])
