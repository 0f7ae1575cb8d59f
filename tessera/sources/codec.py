"""Byte forms of a stripe's streams: run-length codes, packed bits, compressed chunks, and the tags of footers.

Vectorised where values are many; loops go over runs.  An encoder returns a ``Coded`` stream, which also knows where each
of its runs begins, so that any value can be addressed.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np

LONGEST_RUN, SHORTEST_RUN, LONGEST_LITERAL = 130, 3, 128


# --- variable-length integers -----------------------------------------------------------------------------------


def zigzag(v: np.ndarray) -> np.ndarray:
    """Signed to unsigned with small magnitudes small."""
    v = v.astype(np.int64)
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def unzigzag(u: np.ndarray) -> np.ndarray:
    """The inverse of ``zigzag``."""
    return (u >> np.uint64(1)).view(np.int64) ^ -((u & np.uint64(1)).view(np.int64))


def varints(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of unsigned values in groups of seven bits, lowest first, and where each value begins (one place more)."""
    size = np.ones(len(u), dtype=np.int64)
    for k in range(1, 10):
        size += u >= (np.uint64(1) << np.uint64(7 * k))
    at = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(int(at[-1])) - np.repeat(at[:-1], size)
    b = (np.repeat(u, size) >> (np.uint64(7) * place.astype(np.uint64))) & np.uint64(127)
    b[place < np.repeat(size, size) - 1] |= np.uint64(128)
    return b.astype(np.uint8), at


def read_varints(b: np.ndarray) -> np.ndarray:
    """The values whose bytes follow one another."""
    if not len(b):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.bitwise_or.reduceat((b & 127).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64)), first)


# --- run-length codes -------------------------------------------------------------------------------------------


@dataclass
class Coded:
    """A stream's bytes; which value and byte each run begins with; how many positions address a value."""

    data: bytes
    values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bytes_: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    kind: str = "raw"  # raw (values are bytes), run, bit

    def place(self, value: int) -> tuple[int, list[int]]:
        """Byte to begin with, and what to pass over from there, for a value (raw: a byte)."""
        if self.kind == "raw":
            return value, []
        bits = [value % 8] if self.kind == "bit" else []
        value = value // 8 if self.kind == "bit" else value
        k = int(np.searchsorted(self.values, value, "right")) - 1
        if k < 0:
            return 0, [0, *bits]
        return int(self.bytes_[k]), [value - int(self.values[k]), *bits]


def _greedy(n: int, same: np.ndarray, end: np.ndarray):
    """(start, length, is a run) of each run and literal: runs are taken where ``same`` says that three values fit."""
    starts, i = np.flatnonzero(same), 0
    while i < n:
        k = np.searchsorted(starts, i)
        run = int(starts[k]) if k < len(starts) else n
        while i < run:
            m = min(LONGEST_LITERAL, run - i)
            yield i, m, False
            i += m
        if run < n:
            m = min(LONGEST_RUN, int(end[run]) - run)
            yield run, m, True
            i = run + m


def _stretches(d: np.ndarray, n: int) -> np.ndarray:
    """For each value, the end of the stretch of equal differences (or of equal values, d = 0) that begins with it."""
    end = np.arange(1, n + 1)
    if len(d):
        change = np.flatnonzero(d[1:] != d[:-1]) + 1
        stop = np.append(change, len(d))
        end[:-1] = np.repeat(stop, np.diff(np.concatenate([[0], stop]))) + 1
    return end


def integer_code(v: np.ndarray, signed: bool = True) -> Coded:
    """Runs of 3 to 130 values with one difference from -128 to 127 as (length - 3, difference, first value); up to 128
    others as (-length, values ...).
    """
    v = v.astype(np.int64)
    n = len(v)
    b, at = varints(zigzag(v) if signed else v.view(np.uint64))
    with np.errstate(over="ignore"):
        d = v[1:] - v[:-1]
    small = (d >= -128) & (d <= 127) & ((v[1:] >= v[:-1]) == (d >= 0))
    same = np.zeros(n, dtype=bool)
    if n > 2:
        same[: n - 2] = (d[:-1] == d[1:]) & small[:-1] & small[1:]
    end = _stretches(np.where(small, d, np.int64(1 << 62)), n)
    out, values, bytes_ = bytearray(), [], []
    for i, m, run in _greedy(n, same, end):
        values.append(i)
        bytes_.append(len(out))
        if run:
            out += bytes((m - SHORTEST_RUN, int(d[i]) & 0xFF)) + b[at[i] : at[i + 1]].tobytes()
        else:
            out.append(-m & 0xFF)
            out += b[at[i] : at[i + m]].tobytes()
    return Coded(bytes(out), np.array(values, np.int64), np.array(bytes_, np.int64), "run")


def read_integers(code: bytes, signed: bool = True) -> np.ndarray:
    """The values of an integer run-length code."""
    b = np.frombuffer(code, np.uint8)
    last = np.flatnonzero(b < 128)
    parts, lengths, deltas, i = [], [], [], 0
    while i < len(b):
        n = int(b[i])
        if n < 128:
            stop = int(last[np.searchsorted(last, i + 2)]) + 1
            parts.append(b[i + 2 : stop])
            lengths.append(np.array([n + SHORTEST_RUN]))
            deltas.append(np.array([int(b[i + 1].view(np.int8))]))
        else:
            m = 256 - n
            stop = int(last[np.searchsorted(last, i + 1) + m - 1]) + 1
            parts.append(b[i + 1 : stop])
            lengths.append(np.ones(m, np.int64))
            deltas.append(np.zeros(m, np.int64))
        i = stop
    if not parts:
        return np.zeros(0, np.int64)
    u = read_varints(np.concatenate(parts))
    base = unzigzag(u) if signed else u.view(np.int64)
    size, delta = np.concatenate(lengths), np.concatenate(deltas)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(base, size) + np.repeat(delta, size) * place


def byte_code(v: np.ndarray, kind: str = "run") -> Coded:
    """Runs of 3 to 130 equal bytes as (length - 3, byte); up to 128 others as (-length, bytes ...)."""
    v = np.ascontiguousarray(v).view(np.uint8)
    n = len(v)
    d = (v[1:] != v[:-1]).astype(np.int64)
    same = np.zeros(n, dtype=bool)
    if n > 2:
        same[: n - 2] = (d[:-1] == 0) & (d[1:] == 0)
    d = np.where(d == 0, 0, np.arange(1, len(d) + 1))  # stretches of equal values only
    out, values, bytes_ = bytearray(), [], []
    for i, m, run in _greedy(n, same, _stretches(d, n)):
        values.append(i)
        bytes_.append(len(out))
        out += bytes((m - SHORTEST_RUN, int(v[i]))) if run else bytes((-m & 0xFF,)) + v[i : i + m].tobytes()
    return Coded(bytes(out), np.array(values, np.int64), np.array(bytes_, np.int64), kind)


def read_bytes(code: bytes) -> np.ndarray:
    """The bytes of a byte run-length code."""
    parts, i = [], 0
    while i < len(code):
        n = code[i]
        if n < 128:
            parts.append(code[i + 1 : i + 2] * (n + SHORTEST_RUN))
            i += 2
        else:
            parts.append(code[i + 1 : i + 1 + 256 - n])
            i += 1 + 256 - n
    return np.frombuffer(b"".join(parts), np.uint8)


def bit_code(v: np.ndarray) -> Coded:
    """Bits, the first one highest, eight to a byte, run-length coded."""
    return byte_code(np.packbits(v.astype(bool)), "bit")


def read_bits(code: bytes, n: int) -> np.ndarray:
    """The first n bits of a bit code."""
    return np.unpackbits(read_bytes(code))[:n].astype(bool)


# --- compressed chunks ------------------------------------------------------------------------------------------

CODECS = ("NONE", "ZLIB", "SNAPPY", "LZO", "LZ4", "ZSTD")


def _press(codec: str, raw: bytes, level: int) -> bytes:
    if codec == "ZLIB":
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        return c.compress(raw) + c.flush()
    import pyarrow as pa

    return bytes(pa.Codec(codec.lower()).compress(raw))


def _unpress(codec: str, raw: bytes, most: int) -> bytes:
    if codec == "ZLIB":
        return zlib.decompressobj(-15).decompress(raw)
    if codec == "ZSTD":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=most)
    import pyarrow as pa

    size = int(read_varints(np.frombuffer(raw[:10], np.uint8)[: next(i for i, x in enumerate(raw) if x < 128) + 1])[0])
    return bytes(pa.Codec("snappy").decompress(raw, size))


class Chunks:
    """A stream cut into chunks of ``block`` bytes, each behind three bytes (2 * size, + 1 if it didn't shrink)."""

    def __init__(self, raw: bytes, codec: str, block: int, level: int = 4):
        self.codec, self.block = codec, block
        if codec == "NONE":
            self.data, self.starts = raw, [0]
            return
        if codec not in ("ZLIB", "SNAPPY", "ZSTD"):
            raise ValueError(f"no codec {codec}")
        out, self.starts = bytearray(), []
        for at in range(0, len(raw), block):
            self.starts.append(len(out))
            part = raw[at : at + block]
            small = _press(codec, part, level)
            kept = len(small) >= len(part)
            body = part if kept else small
            out += (len(body) * 2 + kept).to_bytes(3, "little") + body
        self.data = bytes(out)

    def place(self, at: int) -> list[int]:
        """Where a byte of the raw stream is: chunk and byte within it (without compression only the byte)."""
        if self.codec == "NONE":
            return [at]
        k = min(at // self.block, max(len(self.starts) - 1, 0))
        return [self.starts[k] if self.starts else 0, at - k * self.block]


def read_chunks(data: bytes, codec: str, block: int) -> bytes:
    """The raw stream."""
    if codec == "NONE":
        return bytes(data)
    out, i = [], 0
    while i < len(data):
        head = int.from_bytes(data[i : i + 3], "little")
        body = bytes(data[i + 3 : i + 3 + head // 2])
        out.append(body if head & 1 else _unpress(codec, body, block))
        i += 3 + head // 2
    return b"".join(out)


# --- tagged messages --------------------------------------------------------------------------------------------


def number(u: int) -> bytes:
    """A variable-length integer."""
    out = bytearray()
    while u > 127:
        out.append(u & 127 | 128)
        u >>= 7
    return bytes([*out, u])


def tagged(*fields: tuple[int, int | float | bytes | str | list[int] | None]) -> bytes:
    """A message of (tag, value): integers as variable-length, floats as eight bytes, bytes and text with their length,
    lists of integers packed; None is left out.  A repeated tag is given repeatedly.
    """
    out = bytearray()
    for tag, v in fields:
        if v is None:
            continue
        if isinstance(v, float):
            out += number(tag << 3 | 1) + np.array([v], "<f8").tobytes()
        elif isinstance(v, int):
            out += number(tag << 3) + number(v)
        else:
            body = v.encode() if isinstance(v, str) else b"".join(map(number, v)) if isinstance(v, list) else v
            out += number(tag << 3 | 2) + number(len(body)) + body
    return bytes(out)


def untagged(raw: bytes) -> dict[int, list]:
    """tag -> values in order: integers, floats or bytes."""
    out: dict[int, list] = {}
    i = 0

    def varint() -> int:
        nonlocal i
        u = shift = 0
        while True:
            b = raw[i]
            i += 1
            u |= (b & 127) << shift
            shift += 7
            if b < 128:
                return u

    while i < len(raw):
        key = varint()
        if key & 7 == 0:
            v: int | float | bytes = varint()
        elif key & 7 == 1:
            v, i = float(np.frombuffer(raw[i : i + 8], "<f8")[0]), i + 8
        elif key & 7 == 2:
            n = varint()
            v, i = raw[i : i + n], i + n
        else:
            raise ValueError("unknown wire type")
        out.setdefault(key >> 3, []).append(v)
    return out


def sint(v: int) -> int:
    """A signed integer as an unsigned one."""
    return 2 * v if v >= 0 else -2 * v - 1


def unsint(u: int) -> int:
    """The inverse of ``sint``."""
    return (u >> 1) ^ -(u & 1)
