"""Range reads in ZIP packages: the directory is parsed from the end of the file, stored
members are located, and byte ranges of them are read without extracting anything."""

from __future__ import annotations

import struct
from typing import NamedTuple

END, END64, END64_LOCATOR, ENTRY, LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50
#: The end record is 22 bytes and a comment of at most 65,535; the ZIP64 locator before it has 20.
TAIL = 22 + 65_535 + 20
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


class Member(NamedTuple):
    name: str
    method: int
    size: int
    packed_size: int
    header_at: int


def _directory_span(reader) -> tuple[int, int, int]:
    """Start and length of the central directory, and its number of entries."""
    tail_at = max(0, reader.size - TAIL)
    tail = reader.read(tail_at, reader.size - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    locator = at - 20
    if locator >= 0 and struct.unpack_from("<I", tail, locator)[0] == END64_LOCATOR:
        end64_at = struct.unpack_from("<Q", tail, locator + 8)[0]
        end64 = reader.read(end64_at, 56)
        if struct.unpack_from("<I", end64)[0] != END64:
            raise ValueError("broken ZIP64 end record")
        entries, length, start = struct.unpack_from("<QQQ", end64, 32)
    elif FULL32 in (length, start) or entries == FULL16:
        raise ValueError("ZIP64 fields without a ZIP64 end record")
    return start, length, entries


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Replace 32-bit fields that are full by their 64-bit values of the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            inside = at + 4
            for i, v in enumerate(values):
                if v == FULL32:
                    values[i] = struct.unpack_from("<Q", extra, inside)[0]
                    inside += 8
            return values
        at += 4 + size
    return values


def members(reader) -> dict[str, Member]:
    """The members listed in the central directory, by name."""
    start, length, entries = _directory_span(reader)
    directory, found, at = reader.read(start, length), {}, 0
    for _ in range(entries):
        fields = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if fields[0] != ENTRY:
            raise ValueError("broken central directory")
        flags, method, packed, size = fields[3], fields[4], fields[8], fields[9]
        name_len, extra_len, comment_len, header_at = fields[10], fields[11], fields[12], fields[16]
        name = directory[at + 46:at + 46 + name_len].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + name_len:at + 46 + name_len + extra_len]
        size, packed, header_at = _wide(extra, [size, packed, header_at])
        found[name] = Member(name, method, size, packed, header_at)
        at += 46 + name_len + extra_len + comment_len
    return found


def data_start(reader, member: Member) -> int:
    """Where a stored member's bytes begin in the file."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed inside the package; only stored members are read")
    header = reader.read(member.header_at, 30)
    if struct.unpack_from("<I", header)[0] != LOCAL:
        raise ValueError(f"broken local header of {member.name}")
    return member.header_at + 30 + sum(struct.unpack_from("<HH", header, 26))


def read_member(reader, member: Member) -> bytes:
    return reader.read(data_start(reader, member), member.size)
