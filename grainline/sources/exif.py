"""EXIF blocks in their containers: JPEG, TIFF (camera files among them), PNG, WebP, HEIF and Canon's ISO files.

A container gives the bytes of one or more TIFF structures; the tags of the first image and of its Exif directory are
read from them. Anything malformed raises ValueError (or what its bytes lead to), which callers turn into nulls or an error.
"""

from __future__ import annotations

import struct

from . import tiff, webp

MODEL, LENS, ISO, APERTURE, EXPOSURE, FOCAL, TAKEN, SUBSECOND, SUB = 0x0110, 0xA434, 0x8827, 0x829D, 0x829A, 0x920A, 0x9003, 0x9291, 0x8769
CANON = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")
MARK = b"Exif\0\0"


def boxes(raw: bytes, at: int = 0, end: int | None = None):
    """(name, first byte of the body, end) of the boxes of an ISO file."""
    end = len(raw) if end is None else end
    while at + 8 <= end:
        size, name = struct.unpack_from(">I4s", raw, at)
        head = 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", raw, at + 8)
            head = 16
        size = size or end - at
        if size < head or at + size > end:
            raise ValueError("damaged box")
        yield name, at + head, at + size
        at += size


def _number(raw: bytes, at: int, size: int) -> tuple[int, int]:
    return int.from_bytes(raw[at : at + size], "big"), at + size


def _heif(raw: bytes, at: int, end: int) -> bytes:
    """The Exif item that a meta box names and places, from its byte ranges."""
    inside = {n: (a, b) for n, a, b in boxes(raw, at + 4, end)}
    a, b = inside[b"iinf"]
    item = None
    for _, x, _ in boxes(raw, a + (6 if raw[a] == 0 else 8), b):
        version = raw[x]
        if version >= 2:
            wide = 2 if version == 2 else 4
            number, _ = _number(raw, x + 4, wide)
            if raw[x + 4 + wide + 2 : x + 4 + wide + 6] == b"Exif":
                item = number
    if item is None:
        raise ValueError("no Exif item")
    a, _ = inside[b"iloc"]
    version, sizes = raw[a], raw[a + 4] << 8 | raw[a + 5]
    offset_size, length_size, base_size, index_size = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
    wide = 4 if version == 2 else 2
    n, at = _number(raw, a + 6, wide)
    for _ in range(n):
        number, at = _number(raw, at, wide)
        method, at = (raw[at + 1] & 15, at + 2) if version else (0, at)
        base, at = _number(raw, at + 2, base_size)
        extents, at = _number(raw, at, 2)
        body = b""
        start = inside[b"idat"][0] if method == 1 and number == item else 0
        for _ in range(extents):
            _, at = _number(raw, at, index_size)
            offset, at = _number(raw, at, offset_size)
            length, at = _number(raw, at, length_size)
            if number == item:
                a = start + base + offset
                if a + length > len(raw):
                    raise ValueError("an extent lies beyond the end of the file")
                body += raw[a : a + length]
        if number == item:
            if method > 1 or len(body) < 4:
                raise ValueError("an Exif item that cannot be read")
            return body[4 + int.from_bytes(body[:4], "big") :]
    raise ValueError("an Exif item without a place")


def blocks(raw: bytes) -> list[bytes]:
    """The TIFF structures of a file, that of the image first."""
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] != 0xDA:
            n = int.from_bytes(raw[at + 2 : at + 4], "big")
            if raw[at + 1] == 0xE1 and raw[at + 4 : at + 10] == MARK:
                return [raw[at + 10 : at + 2 + n]]
            at += 2 + n
        raise ValueError("no EXIF segment")
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 12 <= len(raw):
            (n,) = struct.unpack_from(">I", raw, at)
            if raw[at + 4 : at + 8] == b"eXIf":
                return [raw[at + 8 : at + 8 + n]]
            at += 12 + n
        raise ValueError("no EXIF chunk")
    if raw[:4] == b"RIFF":
        for name, body in webp.chunks(raw):
            if name == b"EXIF":
                return [body.removeprefix(MARK)]
        raise ValueError("no EXIF chunk")
    if raw[4:8] == b"ftyp":
        for name, a, b in boxes(raw):
            if name == b"meta":
                return [_heif(raw, a, b)]
            if name == b"moov":
                for inner, c, d in boxes(raw, a, b):
                    if inner == b"uuid" and raw[c : c + 16] == CANON:
                        own = {n: raw[x:y] for n, x, y in boxes(raw, c + 16, d)}
                        return [own[n] for n in (b"CMT1", b"CMT2") if n in own]
        raise ValueError("no EXIF box")
    return [raw]


def tags(raw: bytes) -> dict[int, tuple]:
    """Tags of the first directory and of the Exif directory, those that come first where both have one; rationals are pairs."""
    out: dict[int, tuple] = {}
    for block in blocks(raw):
        order = tiff.order_of(block)
        own, _ = tiff.directory(block, struct.unpack_from(order + "I", block, 4)[0], order, True)
        out = own | out
        if SUB in own:
            out = tiff.directory(block, own[SUB][0], order, True)[0] | out
    return out


def text(t: dict[int, tuple], tag: int) -> str | None:
    """The first string of a text tag, without NULs and blanks around; none if it is no text or no UTF-8."""
    v = t.get(tag, (None,))[0]
    if not isinstance(v, bytes):
        return None
    try:
        return v.split(b"\0")[0].decode().strip()
    except UnicodeDecodeError:
        return None


def quoted(t: dict[int, tuple], tag: int) -> str | None:
    """The strings of a text tag for display: each in quotes, with quotes, backslashes and other bytes escaped."""
    v = t.get(tag, (None,))[0]
    if not isinstance(v, bytes):
        return None
    show = lambda b: "".join("\\" + chr(c) if c in b'"\\' else chr(c) if 32 <= c < 127 else f"\\x{c:02x}" for c in b)
    return ", ".join(f'"{show(b)}"' for b in (v[:-1] if v.endswith(b"\0") else v).split(b"\0"))


def plain(x: float) -> str:
    """A number in its shortest form, whole ones without a point."""
    return str(int(x)) if x == int(x) else repr(float(x))


def ratio(t: dict[int, tuple], tag: int) -> tuple[int, int] | None:
    v = t.get(tag, (None,))[0]
    return v if isinstance(v, tuple) and v[1] else None


def settings(t: dict[int, tuple]) -> list[str | None]:
    """Model, lens, ISO, aperture, shutter and focal length as they are shown, with their units."""
    f, e, mm = ratio(t, APERTURE), ratio(t, EXPOSURE), ratio(t, FOCAL)
    shutter = None if e is None else (f"{plain(e[0] / e[1])} s" if e[0] >= e[1] or not e[0] else f"1/{plain(e[1] / e[0])} s")
    iso = ", ".join(str(x) for x in t[ISO]) if ISO in t and all(isinstance(x, int) for x in t[ISO]) else None
    return [quoted(t, MODEL), quoted(t, LENS), iso, f and f"f/{plain(f[0] / f[1])}", shutter, mm and f"{plain(mm[0] / mm[1])} mm"]
