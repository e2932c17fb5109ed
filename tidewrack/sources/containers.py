"""Files that a standalone executable carries behind its code, from binary rows.

A container ends with a record of offsets and a trailer. Before the record lies
the payload, with a table of files in one of two layouts. Whatever precedes the
payload, and follows the trailer, does not matter.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The trailer, the bytes of the offsets record, and per layout the bytes of a file's record, where its two later pointers are, and where its kinds are.
TRAILER = b"\n---- Bun! ----\n"
OFFSETS = 32
LAYOUTS = {52: ((32, 40), 48), 36: ((), 32)}
ENCODINGS = ("binary", "latin1", "utf8")
FORMATS = ("none", "esm", "cjs")
SIDES = ("server", "client")

FILE = "file_index int, name string, contents binary, source_map binary, encoding string, loader int, format string, side string, is_entry boolean, start long, stop long, error string"


class Broken(ValueError):
    """A trailer without a payload that makes sense."""


def _span(data: bytes, pointer: tuple[int, int], what: str, ended: bool = False) -> bytes:
    offset, length = pointer
    if offset + length > len(data):
        raise Broken(f"{what} lies beyond the payload")
    if ended and length and data[offset + length : offset + length + 1] != b"\0":
        raise Broken(f"{what} has no end mark")
    return data[offset : offset + length]


def _files(data: bytes, before: int, records: bytes, entry: int, size: int) -> list[tuple]:
    """The rows of a table whose records have ``size`` bytes."""
    later, kinds = LAYOUTS[size]
    count = len(records) // size
    if entry >= count:
        raise Broken(f"entry {entry} of {count} files")
    rows = []
    for i in range(count):
        record = records[i * size : (i + 1) * size]
        name, contents, source_map, code, *more = (struct.unpack_from("<II", record, at) for at in (0, 8, 16, 24, *later))
        encoding, loader, kind, side = record[kinds : kinds + 4]
        if encoding >= len(ENCODINGS) or kind >= len(FORMATS) or side >= len(SIDES):
            raise Broken(f"file {i} is of an unknown kind")
        text = _span(data, name, f"name of file {i}", True).decode(errors="replace")
        body, mapped = _span(data, contents, f"contents of file {i}", True), _span(data, source_map, f"map of file {i}")
        for pointer, what, ended in zip([code, *more], ("code", "facts", "origin"), (False, False, True), strict=False):
            _span(data, pointer, f"{what} of file {i}", ended)
        start = before + contents[0]
        rows.append((i, text, body, mapped, ENCODINGS[encoding], loader, FORMATS[kind], SIDES[side], i == entry, start, start + len(body), None))
    return rows


def _payload(content: bytes, trailer: int) -> list[tuple]:
    """The files of the payload that ends at a trailer's place."""
    at = trailer - OFFSETS
    if at < 0:
        raise Broken("no offsets before the trailer")
    size, table, table_size, entry, argv, argv_size, _ = struct.unpack_from("<QIIIIII", content, at)
    if size > at:
        raise Broken("the payload is larger than what precedes it")
    data = content[at - size : at]
    records = _span(data, (table, table_size), "file table")
    _span(data, (argv, argv_size), "arguments", True)
    fitting = [n for n in LAYOUTS if records and len(records) % n == 0]
    if not fitting:
        raise Broken(f"a file table of {len(records)} bytes")
    found, faults = [], []
    for n in fitting:
        try:
            found.append(_files(data, at - size, records, entry, n))
        except Broken as fault:
            faults.append(f"{n}: {fault}")
    if len(found) > 1:
        raise Broken(f"a file table of {len(records)} bytes is right in both layouts")
    if not found:
        raise Broken("; ".join(faults))
    return found[0]


def decode(content: bytes | None) -> list[tuple]:
    """Rows of FILE: the files of a container, from the last trailer that has a payload; one row with an error where none has, and no row without a trailer."""
    content = content or b""
    end, fault = len(content), None
    while (at := content.rfind(TRAILER, 0, end)) >= 0:
        try:
            return _payload(content, at)
        except Broken as why:
            fault = fault or str(why)
        end = at + len(TRAILER) - 1
    return [(*[None] * 11, fault)] if fault else []


class _Decoder:
    def eval(self, content: bytes) -> Iterator[tuple]:
        yield from decode(content)


def container_files(containers: DataFrame, content: str = "content") -> DataFrame:
    """The columns of ``containers`` but for ``content``, with a row per file (see FILE); a container that cannot be read is one row with its error.

    A row is a whole container, such as ``binaryFile`` reads; rows without a
    trailer, and null ones, give nothing.
    """
    kept = [c for c in containers.columns if c != content]
    decoder = F.udtf(_Decoder, returnType=FILE)
    files = containers.lateralJoin(decoder(F.col(content).outer()))
    return files.select(*kept, *(c.split()[0] for c in FILE.split(", ")))


def u32(number: Column) -> Column:
    """A number as four bytes, the lowest first."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(number.cast("long"), 8 * i).bitwiseAND(255)), 2, "0")) for i in range(4)])


def pack(rows: DataFrame, files: list[tuple[Column, Column]], size: Column, out: str = "content") -> DataFrame:
    """``rows`` with a container of the given (name, contents) files each, the first one the entry; ``size`` picks the layout, 52 or 36.

    Contents are UTF-8 modules of the server side without maps or code.
    """
    end, data, records = F.unhex(F.lit("00")), None, None
    offset = F.lit(0).cast("long")
    for name, contents in files:
        parts = [F.coalesce(name, F.lit("")).cast("binary"), end, F.coalesce(contents, F.lit("")).cast("binary"), end]
        sizes = [F.octet_length(p).cast("long") for p in parts]
        pointers = [u32(offset), u32(sizes[0]), u32(offset + sizes[0] + 1), u32(sizes[2])]
        nothing = F.when(size == 52, F.unhex(F.lit("00" * 32))).otherwise(F.unhex(F.lit("00" * 16)))
        record = F.concat(*pointers, nothing, F.unhex(F.lit("02010100")))
        data, records = (F.concat(*parts), record) if data is None else (F.concat(data, *parts), F.concat(records, record))
        offset = offset + sizes[0] + sizes[2] + 2
    table = len(files) * size.cast("long")
    offsets = F.concat(u32(offset + table), u32(F.lit(0)), u32(offset), u32(table), *[u32(F.lit(0))] * 4)
    return rows.withColumn(out, F.concat(F.lit("code before").cast("binary"), data, records, offsets, F.lit(TRAILER.decode()).cast("binary")))
