"""Parquet footers as data: read, shift and write them, so that encoded blocks can be moved whole.

The footer is Thrift in its compact encoding. It is decoded into a generic tree that keeps every
field, also ones unknown here, so writing it back loses nothing.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from typing import Any, BinaryIO

MAGIC = b"PAR1"

# Fixed values of the Thrift compact protocol: its type codes.
STOP, TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(13)

# Fixed values of parquet.thrift: the field numbers used here.
FILE_SCHEMA, FILE_ROWS, FILE_GROUPS = 2, 3, 4
GROUP_COLUMNS, GROUP_ROWS, GROUP_OFFSET, GROUP_ORDINAL = 1, 3, 5, 7
CHUNK_OFFSET, CHUNK_META, CHUNK_INDEXES = 2, 3, (4, 5, 6, 7)
META_SIZE, META_DATA_PAGE, META_INDEX_PAGE, META_DICTIONARY_PAGE, META_BLOOMS = 7, 9, 10, 11, (14, 15)


@dataclass
class Listed:
    """A list with the type of its elements."""

    kind: int
    items: list


class _Source:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.data):
            raise ValueError("the footer ends too early")
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int, in_list: bool = False) -> Any:
        if kind in (TRUE, FALSE):
            return self.byte() == TRUE if in_list else kind == TRUE
        if kind == BYTE:
            return self.byte()
        if kind in (I16, I32, I64):
            return self.zigzag()
        if kind == DOUBLE:
            return self.take(8)
        if kind == BINARY:
            return self.take(self.varint())
        if kind in (LIST, SET):
            head = self.byte()
            n = head >> 4 if head >> 4 < 15 else self.varint()
            return Listed(head & 15, [self.value(head & 15, True) for _ in range(n)])
        if kind == STRUCT:
            return self.struct()
        raise ValueError(f"Thrift type {kind} in a footer")

    def struct(self) -> dict[int, tuple[int, Any]]:
        out, number = {}, 0
        while (head := self.byte()) != STOP:
            number = number + (head >> 4) if head >> 4 else self.zigzag()
            out[number] = (head & 15, self.value(head & 15))
        return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _zigzag(n: int) -> bytes:
    return _varint(n << 1 if n >= 0 else (-n << 1) - 1)


def _encode(kind: int, value: Any) -> bytes:
    if kind in (TRUE, FALSE):
        return bytes([TRUE if value else FALSE])
    if kind == BYTE:
        return bytes([value])
    if kind in (I16, I32, I64):
        return _zigzag(value)
    if kind == DOUBLE:
        return value
    if kind == BINARY:
        return _varint(len(value)) + value
    if kind in (LIST, SET):
        n = len(value.items)
        head = bytes([n << 4 | value.kind]) if n < 15 else bytes([0xF0 | value.kind]) + _varint(n)
        return head + b"".join(_encode(value.kind, x) for x in value.items)
    return encode_struct(value)


def encode_struct(fields: dict[int, tuple[int, Any]]) -> bytes:
    out, last = bytearray(), 0
    for number, (kind, value) in sorted(fields.items()):
        kind = (TRUE if value else FALSE) if kind in (TRUE, FALSE) else kind
        step = number - last
        out += bytes([step << 4 | kind]) if 0 < step < 16 else bytes([kind]) + _zigzag(number)
        if kind not in (TRUE, FALSE):
            out += _encode(kind, value)
        last = number
    return bytes(out) + bytes([STOP])


def read_footer(f: BinaryIO, size: int) -> dict[int, tuple[int, Any]]:
    """The footer of an open Parquet file of ``size`` bytes; ValueError if it is none."""
    if size < 12:
        raise ValueError("too short for a Parquet file")
    f.seek(size - 8)
    tail = f.read(8)
    if tail[4:] != MAGIC:
        raise ValueError("not a Parquet file")
    length = struct.unpack("<I", tail[:4])[0]
    f.seek(size - 8 - length)
    return _Source(f.read(length)).struct()


def schema_key(footer: dict) -> bytes:
    """What two files must share for their blocks to go into one file."""
    return _encode(*footer[FILE_SCHEMA])


def blocks_of(footer: dict) -> list[dict]:
    return footer[FILE_GROUPS][1].items


def _span(group: dict) -> tuple[int, int]:
    """First and last byte of a block's column chunks."""
    starts, ends = [], []
    for chunk in group[GROUP_COLUMNS][1].items:
        meta = chunk[CHUNK_META][1]
        pages = [meta[k][1] for k in (META_DATA_PAGE, META_INDEX_PAGE, META_DICTIONARY_PAGE) if k in meta and meta[k][1] > 0]
        starts.append(min(pages))
        ends.append(min(pages) + meta[META_SIZE][1])
    return min(starts), max(ends)


def _moved(group: dict, shift: int, ordinal: int) -> dict:
    """The block's footer entry after its bytes were moved; page indexes and blooms are left behind."""
    chunks = []
    for chunk in group[GROUP_COLUMNS][1].items:
        meta = {k: v for k, v in chunk[CHUNK_META][1].items() if k not in META_BLOOMS}
        for k in (META_DATA_PAGE, META_INDEX_PAGE, META_DICTIONARY_PAGE):
            if k in meta and meta[k][1] > 0:
                meta[k] = (meta[k][0], meta[k][1] + shift)
        new = {k: v for k, v in chunk.items() if k not in CHUNK_INDEXES} | {CHUNK_META: (STRUCT, meta)}
        if new.get(CHUNK_OFFSET, (I64, 0))[1] > 0:
            new[CHUNK_OFFSET] = (I64, new[CHUNK_OFFSET][1] + shift)
        chunks.append(new)
    out = group | {GROUP_COLUMNS: (LIST, Listed(STRUCT, chunks)), GROUP_ORDINAL: (I16, ordinal)}
    if GROUP_OFFSET in out:
        out[GROUP_OFFSET] = (I64, out[GROUP_OFFSET][1] + shift)
    if ordinal > 32767:
        out.pop(GROUP_ORDINAL)
    return out


@dataclass
class BlockWriter:
    """Appends the encoded blocks of Parquet files to one file and writes a common footer."""

    out: BinaryIO
    at: int = 0
    rows: int = 0
    groups: list = field(default_factory=list)
    footer: dict | None = None

    def __post_init__(self) -> None:
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def append(self, f: BinaryIO, size: int) -> tuple[int, int]:
        """Copies every block of ``f``; gives its numbers of blocks and rows."""
        footer = read_footer(f, size)
        if self.footer is None:
            self.footer = footer
        elif schema_key(footer) != schema_key(self.footer):
            raise ValueError("the blocks' schemas differ")
        groups, total = blocks_of(footer), 0
        for group in groups:
            low, high = _span(group)
            shift = self.at - low
            f.seek(low)
            left = high - low
            while left:
                data = f.read(min(left, 8 << 20))
                if not data:
                    raise ValueError("a block ends too early")
                self._write(data)
                left -= len(data)
            self.groups.append(_moved(group, shift, len(self.groups)))
            total += group[GROUP_ROWS][1]
        if total != footer[FILE_ROWS][1]:
            raise ValueError(f"blocks hold {total} rows, the footer says {footer[FILE_ROWS][1]}")
        self.rows += total
        return len(groups), total

    def close(self) -> int:
        """Writes the footer; gives the file's size."""
        if self.footer is None:
            raise ValueError("no file to take a schema from")
        data = encode_struct(self.footer | {FILE_ROWS: (I64, self.rows), FILE_GROUPS: (LIST, Listed(STRUCT, self.groups))})
        self._write(data + struct.pack("<I", len(data)) + MAGIC)
        return self.at
