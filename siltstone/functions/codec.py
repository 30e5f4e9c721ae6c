"""Keys of any type in one binary column, ordered as the values are.

A type byte orders kinds: numbers, then null, false and true among the symbols, then tuples, lists,
strings and bytes.  Whole numbers and floats share a kind and compare by value; equal ones encode alike.
Spark compares binary columns byte by byte, so ranges and sorting work on the encoded form.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

_NUMBER, _NULL, _FALSE, _TRUE, _TUPLE, _LIST, _TEXT, _BYTES, _END = 0x10, 0x21, 0x20, 0x22, 0x30, 0x38, 0x40, 0x41, 0x01


def _number(x: int | float) -> bytes:
    """Sign, number of bits, then the bits from the top; negative numbers complemented."""
    if isinstance(x, float):
        if math.isnan(x):
            raise ValueError("not a number has no place in an order of keys")
        if math.isinf(x):
            return b"\xff" if x > 0 else b"\x00"
        top, below = x.as_integer_ratio()
    else:
        top, below = x, 1
    if not top:
        return b"\x80"
    low = below.bit_length() - 1  # below is a power of two
    size = abs(top).bit_length() - low  # the place of the highest bit
    bits = abs(top)
    pad = -bits.bit_length() % 7
    digits, groups = bits << pad, []
    n = digits.bit_length() // 7
    for i in range(n):
        groups.append(((digits >> 7 * (n - 1 - i)) & 0x7F) << 1 | 1)
    while len(groups) > 1 and groups[-1] == 1:
        groups.pop()
    body = struct.pack(">I", size + (1 << 31)) + bytes(groups) + b"\x00"
    return b"\x81" + body if top > 0 else b"\x7f" + bytes(255 - b for b in body)


def _text(data: bytes) -> bytes:
    return data.replace(b"\x00", b"\x00\xff") + b"\x00\x00"


def encode(key: object) -> bytes:
    """The binary form of None, bool, int, float, str, bytes, and tuples and lists of those."""
    match key:
        case None:
            return bytes([_NULL])
        case bool():
            return bytes([_TRUE if key else _FALSE])
        case int() | float():
            return bytes([_NUMBER]) + _number(key)
        case str():
            return bytes([_TEXT]) + _text(key.encode())
        case bytes() | bytearray():
            return bytes([_BYTES]) + _text(bytes(key))
        case tuple():
            return bytes([_TUPLE]) + struct.pack(">I", len(key)) + b"".join(map(encode, key))
        case list():
            return bytes([_LIST]) + b"".join(map(encode, key)) + bytes([_END])
    raise TypeError(f"no key: {type(key).__name__}")


def decode(data: bytes) -> object:
    value, at = _read(data, 0)
    if at != len(data):
        raise ValueError("more than one key")
    return value


def _untext(data: bytes, at: int) -> tuple[bytes, int]:
    out = bytearray()
    while True:
        end = data.index(b"\x00", at)
        out += data[at:end]
        if data[end + 1] == 0:
            return bytes(out), end + 2
        out.append(0)
        at = end + 2


def _unnumber(data: bytes, at: int) -> tuple[int | float, int]:
    sign = data[at]
    if sign in (0, 0xFF):
        return math.inf if sign else -math.inf, at + 1
    if sign == 0x80:
        return 0, at + 1
    flip = 255 if sign == 0x7F else 0
    size = struct.unpack(">I", bytes(b ^ flip for b in data[at + 1 : at + 5]))[0] - (1 << 31)
    bits, n, at = 0, 0, at + 5
    while (b := data[at] ^ flip) != 0:
        bits, n, at = bits << 7 | b >> 1, n + 7, at + 1
    shift = size - n
    low = bits & -bits
    value: int | float = bits << shift if shift >= 0 else bits >> -shift if not low or low.bit_length() > -shift else math.ldexp(bits, shift)
    return -value if flip else value, at + 1


def _read(data: bytes, at: int) -> tuple[object, int]:
    kind, at = data[at], at + 1
    if kind in (_NULL, _TRUE, _FALSE):
        return {_NULL: None, _TRUE: True, _FALSE: False}[kind], at
    if kind == _NUMBER:
        return _unnumber(data, at)
    if kind in (_TEXT, _BYTES):
        raw, at = _untext(data, at)
        return raw.decode() if kind == _TEXT else raw, at
    if kind == _TUPLE:
        n, out = struct.unpack(">I", data[at : at + 4])[0], []
        at += 4
        for _ in range(n):
            x, at = _read(data, at)
            out.append(x)
        return tuple(out), at
    if kind == _LIST:
        out = []
        while data[at] != _END:
            x, at = _read(data, at)
            out.append(x)
        return out, at + 1
    raise ValueError(f"unknown kind {kind}")


def sorted_keys(keys: Iterator[object]) -> list[object]:
    return sorted(keys, key=encode)
