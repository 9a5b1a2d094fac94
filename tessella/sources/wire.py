"""Byte-level helpers that the binary readers and writers share."""

from __future__ import annotations


def put_varint(v: int) -> bytes:
    """Unsigned, seven bits to a byte, low bits first; negative numbers as 64-bit two's complement."""
    v &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while v > 0x7F:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    v = data[at]
    at += 1
    if v < 0x80:
        return v, at
    v, shift = v & 0x7F, 7
    while True:
        b = data[at]
        at += 1
        if b < 0x80:
            return v | b << shift, at
        v |= (b & 0x7F) << shift
        shift += 7


def varints(data: bytes) -> list[int]:
    """All varints that bytes consist of."""
    if data.isascii():  # each byte is one
        return list(data)
    out, v, shift = [], 0, 0
    for b in data:
        if b < 0x80:
            out.append(v | b << shift)
            v = shift = 0
        else:
            v |= (b & 0x7F) << shift
            shift += 7
    if shift:
        raise IndexError("bytes end within a varint")
    return out


def zigzag(v: int) -> int:
    return v << 1 if v >= 0 else (-v << 1) - 1


def unzigzag(v: int) -> int:
    return v >> 1 if not v & 1 else -(v + 1 >> 1)


def signed(v: int) -> int:
    """A 64-bit field read as two's complement."""
    return v - (1 << 64) if v >= 1 << 63 else v


def field(number: int, payload: int | bytes) -> bytes:
    """A protocol-buffer field: a varint or a length-delimited value."""
    if isinstance(payload, int):
        return put_varint(number << 3) + put_varint(payload)
    return put_varint(number << 3 | 2) + put_varint(len(payload)) + payload


def packed(number: int, values: list[int]) -> bytes:
    return field(number, b"".join(map(put_varint, values))) if values else b""


def fields(data: bytes) -> list[tuple[int, int | bytes]]:
    out, at = [], 0
    while at < len(data):
        key, at = get_varint(data, at)
        kind = key & 7
        if kind == 0:
            v, at = get_varint(data, at)
        elif kind == 2:
            n, at = get_varint(data, at)
            v, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            v, at = data[at : at + n], at + n
        else:
            raise ValueError(f"unknown wire type {kind}")
        out.append((key >> 3, v))
    return out


def unpacked(values: list[int | bytes]) -> list[int]:
    """A repeated varint field, packed or not."""
    if len(values) == 1 and isinstance(values[0], bytes):
        return varints(values[0])
    out = []
    for v in values:
        out += [v] if isinstance(v, int) else varints(v)
    return out
