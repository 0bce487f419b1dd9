"""Delimited files in byte ranges (S2, S3): one file is read by many tasks.

A range owns the lines that begin in it.  Whether a line begins inside quotes
depends on everything before it, so each range first tells for both cases in
which state the next range begins and how many records begin in it: a function
of two states.  Composing these functions in the order of the ranges (a row per
range, no text) gives each range its first state and row number, and every
range is then read on its own.  A record belongs to the range in which it
begins, however far it goes on.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator

import numpy as np

#: Bytes of a range.
RANGE_BYTES = 32 << 20
#: Bytes read at once when the next line's start is looked for.
LOOK_BYTES = 1 << 16


class _Limited(io.RawIOBase):
    """The bytes [start, stop) of a stream."""

    def __init__(self, stream, start: int, stop: int):
        stream.seek(start)
        self.stream, self.left = stream, max(0, stop - start)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(min(len(buffer), self.left))
        buffer[: len(data)] = data
        self.left -= len(data)
        return len(data)


def exact_codec(stream, codec: str, start: int) -> str:
    """The codec for text that begins at a byte other than the first: without a byte order mark of its own."""
    if codec == "utf-16" and start:
        stream.seek(0)
        return "utf-16-be" if stream.read(2) == codecs.BOM_UTF16_BE else "utf-16-le"
    return "utf-8" if codec == "utf-8-sig" and start else codec


def line_start(stream, codec: str, at: int, length: int) -> int:
    """The first byte from ``at`` on at which a line begins; lines end with a line feed, a carriage return or both."""
    kind = {"utf-16-le": "<u2", "utf-16-be": ">u2"}.get(exact_codec(stream, codec, at), "u1")
    unit = np.dtype(kind).itemsize
    at -= at % unit
    if at <= 0:
        return 0
    while at < length:
        stream.seek(at - unit)
        raw = stream.read(LOOK_BYTES)
        sign = np.frombuffer(raw[: len(raw) - len(raw) % unit], dtype=kind)
        if len(sign) < 2:
            return length
        begins = np.flatnonzero((sign[:-1] == 10) | ((sign[:-1] == 13) & (sign[1:] != 10)))
        if len(begins):
            return at + unit * int(begins[0])
        at += unit * (len(sign) - 1)
    return length


def decodes(stream, codec: str, start: int, stop: int) -> bool:
    """Whether the lines that begin in the range decode without an error."""
    decoder = codecs.getincrementaldecoder(exact_codec(stream, codec, start))("strict")
    raw = _Limited(stream, start, stop)
    try:
        while data := raw.read(1 << 20):
            decoder.decode(data)
        decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        return False
    return True


def _lines(stream, codec: str, start: int, stop: int) -> Iterator[str]:
    own = exact_codec(stream, codec, start)  # before the stream is placed
    return io.TextIOWrapper(io.BufferedReader(_Limited(stream, start, stop), 1 << 18), encoding=own, errors="replace", newline="")


def _records(lines: Iterator[str], following, delimiter: str, quoted: bool) -> Iterator[tuple[list[str], bool]]:
    """(cells, whole) of the records of ``lines``; a record that is open at their end goes on with ``following()``.

    ``quoted``: the first line begins inside quotes, so the first record is the rest of an earlier one.
    ``whole`` is False for a last record that ends with the text inside quotes."""
    csv.field_size_limit(2**31 - 1)
    is_open = at_end = False

    def fed():
        nonlocal is_open, at_end
        first = quoted
        for line in lines:
            is_open = True
            yield '"' + line if first else line
            first = False
        if is_open and following is not None:
            for line in following():
                yield line
                if not is_open:
                    return
        at_end = True

    for cells in csv.reader(fed(), delimiter=delimiter):
        yield cells, not at_end
        is_open = False


def transition(stream, codec: str, delimiter: str, start: int, stop: int, quoted: bool) -> tuple[bool, int]:
    """(whether the next range begins inside quotes, records that begin in this one), if this one begins in ``quoted``."""
    if start >= stop:
        return quoted, 0
    n, whole = 0, True
    for _, whole in _records(_lines(stream, codec, start, stop), None, delimiter, quoted):
        n += 1
    return not whole, n - quoted


def rows(stream, codec: str, delimiter: str, start: int, stop: int, length: int, quoted: bool) -> Iterator[list[str]]:
    """The records that begin in the range, to their ends."""
    if start >= stop:
        return
    found = _records(_lines(stream, codec, start, stop), lambda: _lines(stream, codec, stop, length), delimiter, quoted)
    if quoted:
        next(found, None)
    for cells, _ in found:
        yield cells
