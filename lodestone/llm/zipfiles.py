"""The parts of the ZIP format that stored archive members need: writing them, and finding them by range reads.

Fixed values of the format: record signatures, the marks for sizes that are in the ZIP64 fields, field orders.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MARK16, MARK32 = 0xFFFF, 0xFFFFFFFF
STORED, UTF8_NAME, EARLIEST_DATE = 0, 0x800, 0x21


class ZipWriter:
    """Writes stored members one after the other to a stream that cannot seek; sizes follow in the central directory.

    A member's size is known before it is written or, for the member that grows, it is written behind a header with
    ZIP64 fields and a data descriptor. ``zip64`` forces the ZIP64 end records also where the archive is small.
    """

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.entries, self.zip64, self.open = out, 0, [], zip64, None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def start(self, name: str) -> None:
        raw = name.encode()
        self.open = [raw, self.at, 0, 0]
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, UTF8_NAME | 8, STORED, 0, EARLIEST_DATE, 0, MARK32, MARK32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> int:
        """Offset in the member at which ``data`` begins."""
        begins = self.open[3]
        self.open[2], self.open[3] = zlib.crc32(data, self.open[2]), begins + len(data)
        self._put(data)
        return begins

    def finish(self) -> None:
        _, _, crc, size = self.open
        self._put(b"PK\x07\x08" + struct.pack("<IQQ", crc, size, size))
        self.entries.append(tuple(self.open))
        self.open = None

    def close(self) -> None:
        begins = self.at
        for raw, offset, crc, size in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, UTF8_NAME | 8, STORED, 0, EARLIEST_DATE, crc, MARK32, MARK32, len(raw), len(extra), 0, 0, 0, 0, MARK32) + raw + extra)
        size, n = self.at - begins, len(self.entries)
        if self.zip64 or n >= MARK16 or begins + size >= MARK32:
            ends = self.at
            self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, begins))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, ends, 1))
            self._put(END + struct.pack("<HHHHIIH", 0, 0, MARK16, MARK16, MARK32, MARK32, 0))
        else:
            self._put(END + struct.pack("<HHHHIIH", 0, 0, n, n, size, begins, 0))


def members(f, length: int) -> Iterator[tuple[str, int, int, int]]:
    """name, method, offset of the data, size for each member of the archive in ``f`` (seek and read), of ``length`` bytes.

    Reads the end record (with a comment of up to 64 KB), the ZIP64 end record where there is one, the central
    directory, and of each member its local header, as only that gives where the data begins.
    """
    back = min(length, 65557)
    f.seek(length - back)
    tail = f.read(back)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("not a ZIP archive: no end of central directory")
    n, size, begins = struct.unpack_from("<HII", tail, at + 10)
    locator = tail.rfind(LOCATOR64, 0, at)
    if locator >= 0 and locator + 20 == at:
        f.seek(struct.unpack_from("<Q", tail, locator + 8)[0])
        record = f.read(56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of central directory where the locator points")
        n, size, begins = struct.unpack_from("<QQQ", record, 32)
    f.seek(begins)
    directory, p = f.read(size), 0
    for _ in range(n):
        if directory[p : p + 4] != CENTRAL:
            raise ValueError("the central directory is broken off")
        method, = struct.unpack_from("<H", directory, p + 10)
        packed, plain, names, extras, comments = struct.unpack_from("<IIHHH", directory, p + 20)
        offset, = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46 : p + 46 + names].decode()
        q, stop = p + 46 + names, p + 46 + names + extras
        while q + 4 <= stop:
            kind, held = struct.unpack_from("<HH", directory, q)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{held // 8}Q", directory, q + 4))
                plain = next(wide) if plain == MARK32 else plain
                packed = next(wide) if packed == MARK32 else packed
                offset = next(wide) if offset == MARK32 else offset
            q += 4 + held
        f.seek(offset + 26)
        name_len, extra_len = struct.unpack("<HH", f.read(4))
        yield name, method, offset + 30 + name_len + extra_len, packed
        p = stop + comments
