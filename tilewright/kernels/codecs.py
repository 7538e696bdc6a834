"""Decoding of image files in NumPy: PNG, BMP, TIFF and baseline JPEG. Colour comes as blue, green, red."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def decode(content: bytes) -> np.ndarray:
    """Pixels (8 bits) of an image file.

    PNG: 8 bits, grey, colour or palette, not interlaced. BMP: 8 or 24 bits. TIFF: 8 or 16 bits, strips or
    tiles, without compression or with PackBits, LZW or Deflate; 16 bits are shown by their upper byte.
    JPEG: baseline or extended sequential, 8 bits, grey or colour. All else is a ValueError.
    """
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(content)
    if content[:2] == b"BM":
        return _bmp(content)
    if content[:4] in (b"II*\0", b"MM\0*"):
        return _tiff(content)
    if content[:2] == b"\xff\xd8":
        return _Jpeg(content).pixels()
    raise ValueError("not a PNG, BMP, TIFF or JPEG image")


# --- PNG and BMP ---------------------------------------------------------------------------------


def _png(b: bytes) -> np.ndarray:
    at, data, palette, head = 8, [], None, None
    while at < len(b):
        size, kind = struct.unpack(">I4s", b[at : at + 8])
        body = b[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    w, h, depth, color, _, _, lace = head
    if depth != 8 or lace:
        raise ValueError("only 8-bit PNG without interlace")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h + 1, w * n), np.int64)
    for y in range(h):
        kind, line, up = raw[y, 0], raw[y, 1:].astype(np.int64), out[y]
        if kind == 1 or kind > 2:
            out[y + 1] = _unfilter(int(kind), line, up, n)
        else:
            out[y + 1] = (line + up) & 255 if kind == 2 else line
    px = out[1:].astype(np.uint8).reshape(h, w, n)
    if color == 3:
        return palette[px[:, :, 0]][:, :, ::-1]
    if n < 3:
        return px[:, :, 0]
    return px[:, :, 2::-1]


def _unfilter(kind: int, line: np.ndarray, up: np.ndarray, n: int) -> np.ndarray:
    if kind == 1:
        return (np.cumsum(line.reshape(-1, n), 0) & 255).reshape(-1)
    x, u, out = line.tolist(), up.tolist(), [0] * len(line)
    for i, v in enumerate(x):
        a, b, c = (out[i - n], u[i], u[i - n]) if i >= n else (0, u[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            da, db, dc = abs(p - a), abs(p - b), abs(p - c)
            guess = a if da <= db and da <= dc else b if db <= dc else c
        out[i] = (v + guess) & 255
    return np.array(out)


def _bmp(b: bytes) -> np.ndarray:
    start = struct.unpack("<I", b[10:14])[0]
    size, w, h, _, bits = struct.unpack("<IiiHH", b[14:30])
    if bits not in (8, 24):
        raise ValueError("only BMP of 8 or 24 bits")
    n = bits // 8
    pad = (w * n + 3) // 4 * 4
    rows = np.frombuffer(b[start : start + pad * abs(h)], np.uint8).reshape(abs(h), pad)[:, : w * n]
    rows = rows[::-1] if h > 0 else rows
    if n == 3:
        return rows.reshape(abs(h), w, 3).copy()
    table = np.frombuffer(b[14 + size : start], np.uint8).reshape(-1, 4)[:, :3]
    px = table[rows]
    return px[:, :, 0] if (px[:, :, :1] == px).all() else px


# --- TIFF ----------------------------------------------------------------------------------------

# Tags of the format.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _INK, _STRIPS, _SAMPLES, _ROWS, _STRIP_SIZES, _PLANAR, _PREDICTOR, _PALETTE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320
_TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_SIZES = 322, 323, 324, 325


def _tiff(b: bytes) -> np.ndarray:
    e = "<" if b[:2] == b"II" else ">"
    at = struct.unpack(e + "I", b[4:8])[0]
    tags: dict[int, list[int]] = {}
    for i in range(struct.unpack(e + "H", b[at : at + 2])[0]):
        entry = b[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, n = struct.unpack(e + "HHI", entry[:8])
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code is None:
            continue
        size = n * struct.calcsize(code)
        where = struct.unpack(e + "I", entry[8:])[0]
        raw = entry[8 : 8 + size] if size <= 4 else b[where : where + size]
        tags[tag] = list(struct.unpack(f"{e}{n}{code}", raw))
    one = lambda t, default=None: tags[t][0] if t in tags else default
    w, h, bits, n = one(_WIDTH), one(_HEIGHT), one(_BITS, 1), one(_SAMPLES, 1)
    if bits not in (8, 16) or one(_PLANAR, 1) != 1 and n > 1:
        raise ValueError("only TIFF of 8 or 16 bits with interleaved samples")
    unpack = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}.get(one(_COMPRESSION, 1))
    if unpack is None:
        raise ValueError(f"TIFF compression {one(_COMPRESSION)} is not read")
    predictor, kind = one(_PREDICTOR, 1), np.dtype(np.uint8 if bits == 8 else e + "u2")

    def part(offset: int, size: int, height: int, width: int) -> np.ndarray:
        px = np.frombuffer(unpack(b[offset : offset + size])[: height * width * n * kind.itemsize], kind).reshape(height, width, n)
        return np.cumsum(px, 1, dtype=kind.newbyteorder("=")) if predictor == 2 else px

    out = np.zeros((h, w, n), kind.newbyteorder("="))
    if _TILES in tags:
        tw, th = one(_TILE_WIDTH), one(_TILE_HEIGHT)
        across = -(-w // tw)
        for i, (o, s) in enumerate(zip(tags[_TILES], tags[_TILE_SIZES], strict=True)):
            y, x = i // across * th, i % across * tw
            out[y : y + th, x : x + tw] = part(o, s, th, tw)[: h - y, : w - x]
    else:
        rows = min(one(_ROWS, h), h)
        for i, (o, s) in enumerate(zip(tags[_STRIPS], tags[_STRIP_SIZES], strict=True)):
            out[i * rows : (i + 1) * rows] = part(o, s, min(rows, h - i * rows), w)
    px = out if bits == 8 else (out >> 8).astype(np.uint8)
    ink = one(_INK, 1)
    if ink == 3:
        table = (np.array(tags[_PALETTE]).reshape(3, -1) >> 8).astype(np.uint8)
        return table[::-1, px[:, :, 0]].transpose(1, 2, 0)
    if n < 3:
        return 255 - px[:, :, 0] if ink == 0 else px[:, :, 0]
    return px[:, :, 2::-1]


def _packbits(b: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(b):
        n = b[i]
        i += 1
        if n < 128:
            out += b[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += b[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def _lzw(b: bytes) -> bytes:
    """Codes of 9 to 12 bits, the first bit first; 256 empties the table, 257 ends; codes get longer one entry early."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last = list(base), [], b""
    width, held, n = 9, 0, 0
    for byte in b:
        held = held << 8 | byte
        n += 8
        if n < width:
            continue
        n -= width
        code = held >> n
        held &= (1 << n) - 1
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if code == 257:
            break
        if not last:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


# --- JPEG ----------------------------------------------------------------------------------------


def _zigzag() -> np.ndarray:
    """Place (row * 8 + column) of each of the 64 coefficients in the order they are stored: diagonals, each turned against the one before."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    c = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return c


_PLACE, _COSINE = _zigzag(), _cosines()


class _Jpeg:
    """Sequential JPEG with Huffman codes."""

    def __init__(self, b: bytes):
        self.scales: dict[int, np.ndarray] = {}
        self.codes: dict[int, list[tuple[int, int]]] = {}
        self.restart, self.parts, self.data, self.transform = 0, [], b"", None
        at = 2
        while at + 4 <= len(b):
            if b[at] != 0xFF:
                raise ValueError("damaged JPEG")
            kind, size = b[at + 1], struct.unpack(">H", b[at + 2 : at + 4])[0]
            if kind == 0xFF:
                at += 1
                continue
            body = b[at + 4 : at + 2 + size]
            if kind == 0xDB:
                self._scale(body)
            elif kind == 0xC4:
                self._code(body)
            elif kind in (0xC0, 0xC1):
                self.height, self.width, n = struct.unpack(">HHB", body[1:6])
                if body[0] != 8:
                    raise ValueError("only JPEG of 8 bits")
                self.parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(n)]
            elif 0xC2 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
                raise ValueError("only sequential JPEG is read")
            elif kind == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif kind == 0xEE and body[:5] == b"Adobe":
                self.transform = body[11]
            elif kind == 0xDA:
                for i in range(body[0]):
                    own = next(p for p in self.parts if p[0] == body[1 + 2 * i])
                    own[4], own[5] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                self.data = b[at + 2 + size :]
                break
            at += 2 + size
        if not self.parts or not self.data:
            raise ValueError("JPEG without an image")

    def _scale(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, k = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            self.scales[k] = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
            at += 1 + n

    def _code(self, body: bytes) -> None:
        """For each code a table over the next 16 bits: (length, symbol)."""
        at = 0
        while at < len(body):
            name, counts = body[at], body[at + 1 : at + 17]
            at += 17
            table: list[tuple[int, int]] = []
            for length, n in enumerate(counts, 1):
                for symbol in body[at : at + n]:
                    table += [(length, symbol)] * (1 << 16 - length)
                at += n
            self.codes[name] = table + [(0, 0)] * ((1 << 16) - len(table))

    def _segments(self) -> list[bytes]:
        """The coded data between restart marks, without stuffing."""
        d, out, start, at = self.data, [], 0, 0
        while True:
            at = d.find(b"\xff", at)
            if at < 0 or at + 1 >= len(d):
                end = len(d) if at < 0 else at
                out.append(d[start:end])
                break
            if d[at + 1] == 0:
                at += 2
            elif 0xD0 <= d[at + 1] <= 0xD7:
                out.append(d[start:at])
                at += 2
                start = at
            elif d[at + 1] == 0xFF:
                at += 1
            else:
                out.append(d[start:at])
                break
        return [s.replace(b"\xff\x00", b"\xff") for s in out]

    def pixels(self) -> np.ndarray:
        top, left = max(p[2] for p in self.parts), max(p[1] for p in self.parts)
        if len(self.parts) == 1:  # a lone component is not interleaved
            top = left = 1
            self.parts[0][1] = self.parts[0][2] = 1
        across, down = -(-self.width // (8 * left)), -(-self.height // (8 * top))
        blocks = [np.zeros((down * p[2], across * p[1], 64)) for p in self.parts]
        total, segments, done = across * down, self._segments(), 0
        for segment in segments:
            bits = _Bits(segment)
            last = [0] * len(self.parts)
            for _ in range(min(self.restart or total, total - done)):
                my, mx = divmod(done, across)
                for i, (_, h, v, _, dc, ac) in enumerate(self.parts):
                    for y in range(v):
                        for x in range(h):
                            last[i] = self._block(bits, self.codes[dc], self.codes[16 + ac], last[i], blocks[i][my * v + y, mx * h + x])
                done += 1
        planes = []
        for (_, h, v, q, _, _), c in zip(self.parts, blocks, strict=True):
            px = np.zeros_like(c)
            px[:, :, _PLACE] = c * self.scales[q]
            px = np.einsum("ky,rckl,lx->rcyx", _COSINE, px.reshape(*c.shape[:2], 8, 8), _COSINE)
            plane = px.transpose(0, 2, 1, 3).reshape(c.shape[0] * 8, c.shape[1] * 8) + 128
            planes.append(np.repeat(np.repeat(plane, top // v, 0), left // h, 1)[: self.height, : self.width])
        whole = lambda x: np.clip(np.rint(x), 0, 255).astype(np.uint8)
        if len(planes) == 1:
            return whole(planes[0])
        if len(planes) != 3:
            raise ValueError("only JPEG of one or three components")
        if self.transform == 0:
            return whole(np.stack(planes[::-1], -1))
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        return whole(np.stack([y + 1.772 * cb, y - 0.344136 * cb - 0.714136 * cr, y + 1.402 * cr], -1))

    @staticmethod
    def _block(bits: _Bits, dc: list, ac: list, last: int, out: np.ndarray) -> int:
        n = bits.symbol(dc)
        last += bits.number(n)
        out[0] = last
        k = 1
        while k < 64:
            s = bits.symbol(ac)
            run, n = s >> 4, s & 15
            if not n:
                if run != 15:
                    break
                k += 16
                continue
            k += run
            if k > 63:
                raise ValueError("damaged JPEG")
            out[k] = bits.number(n)
            k += 1
        return last


class _Bits:
    def __init__(self, b: bytes):
        self.b, self.at, self.held, self.n = b, 0, 0, 0

    def _need(self, n: int) -> None:
        while self.n < n:
            chunk = self.b[self.at : self.at + 6]
            self.at += 6
            # Beyond the end the data is read as ones.
            self.held = self.held << 48 | int.from_bytes(chunk + b"\xff" * (6 - len(chunk)), "big")
            self.n += 48

    def symbol(self, table: list[tuple[int, int]]) -> int:
        self._need(16)
        length, symbol = table[self.held >> self.n - 16]
        if not length:
            raise ValueError("damaged JPEG")
        self.n -= length
        self.held &= (1 << self.n) - 1
        return symbol

    def number(self, n: int) -> int:
        if not n:
            return 0
        self._need(n)
        self.n -= n
        v = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return v if v >> n - 1 else v - (1 << n) + 1
