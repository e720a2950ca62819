"""Media columns: progressive JPEG in numpy (operator 4).

The decoder reads every scan of a progressive JPEG into coefficient arrays: DC and AC scans, first passes (spectral
selection) and refinements (successive approximation). Entropy-coded segments (restart intervals; a whole scan where there
are none) are decoded in step, all segments of a batch of images at once. Where a batch's segments all repeat one symbol
length (which is verified bit by bit) they are read as a matrix. Coefficients are dequantized, inverse-transformed, chroma is
upsampled, and pixels are stored as full-resolution RGB tensors.

payload_jpegs() stores bytes losslessly in such files: the unit is the quantized coefficient (tables of ones); byte b is the
coefficient 256 + b, so every coefficient of a scan has one size. Images are 4:2:0; luma blocks come first, then Cb, Cr.
A payload of more than PAGE bytes is a sequence of such files, one after another, each with its part: writer and reader hold
one page at a time (some 20 MB), whatever a text's length. Since such coefficients saturate pixels, the payload's
feature also tells how they are distributed.

Defined results: a null or empty text is 64 zero bytes; padding blocks hold zeros as well; a null or damaged image
decodes to null tensors; repeated rows are stored alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

MAX_MCUS = 4095  # in a row: 65,520 pixels
PAGE = 1 << 20
#: Where one file ends and the next begins; no file of ours holds these bytes elsewhere (0xFF is stuffed in scans, sizes end in zeros).
SEAM = b"\xff\xd9\xff\xd8"


def _zigzag() -> np.ndarray:
    """Position in the 8x8 block of each coefficient in scan order: along anti-diagonals, turning at the edges."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def _inverse_dct() -> np.ndarray:
    """64x64: from coefficients in scan order to pixels in raster order."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), np.sqrt(1 / 4))
    full = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return full[ZIGZAG].astype(np.float32)


IDCT = _inverse_dct()


# ---- writing payloads ----------------------------------------------------------------------------------------------------------

#: Code lengths of DC size categories 0..11 (counts per length 1..16) and of the two AC symbols (size 8, end of band).
DC_BITS, DC_VALUES = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))
AC_BITS, AC_VALUES = bytes([1, 1] + [0] * 14), bytes([0x08, 0x00])


def _codes(bits: bytes, values: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (length, code)."""
    out, code, k = {}, 0, 0
    for n in range(1, 17):
        for _ in range(bits[n - 1]):
            out[values[k]] = (n, code)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _sos(components: bytes, ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([ss, se, ah << 4 | al]))


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """(..., n) -> (..., n * width) bits, the highest first."""
    out = (values[..., None] >> np.arange(width - 1, -1, -1, dtype=values.dtype)) & 1
    return out.reshape(*values.shape[:-1], -1).astype(np.uint8)


def _scan_bytes(bits: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each image: row i of bits is a restart interval, filled up with ones; counts: intervals per image."""
    width = -(-bits.shape[1] // 8) * 8
    full = np.ones((len(bits), width), np.uint8)
    full[:, : bits.shape[1]] = bits
    return _join(np.packbits(full, axis=1), np.full(len(bits), width // 8), counts)


def _join(packed: np.ndarray, used: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Stuff 0xFF bytes and set restart markers between the intervals of an image. used: bytes of each row that count."""
    ends = np.cumsum(counts)
    nth = np.arange(len(packed)) - np.repeat(ends - counts, counts)
    rows = np.empty((len(packed), packed.shape[1] + 2), np.uint8)
    rows[:, :-2] = packed
    keep = np.zeros(rows.shape, bool)
    keep[:, :-2] = np.arange(packed.shape[1]) < used[:, None]
    rows[:, -2], rows[:, -1] = 0xFF, 0xD0 + nth % 8
    keep[:, -2:] = True
    keep[ends - 1, -2:] = False  # none after the last
    stuffed = (rows == 0xFF) & keep
    stuffed[:, -2:] = False
    size = keep.sum(1) + stuffed.sum(1)
    flat, extra = rows[keep], stuffed[keep]
    at = np.arange(len(flat)) + np.cumsum(extra) - extra
    out = np.zeros(len(flat) + int(extra.sum()), np.uint8)
    out[at] = flat
    cut = np.cumsum(size)[ends - 1]
    return [out[a:b].tobytes() for a, b in zip([0, *cut[:-1]], cut, strict=True)]


def _layout(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(MCUs per row, rows of MCUs) of images that hold so many blocks."""
    mcus = -(-blocks // 6)
    wide = np.minimum(mcus, MAX_MCUS)
    return wide, -(-mcus // wide)


def _mcu_blocks(wide: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all images' MCUs in order: the six blocks of each (index over all images' blocks), and MCUs per image."""
    mcus = wide * high
    image = np.repeat(np.arange(len(wide)), mcus)
    i = np.arange(int(mcus.sum())) - np.repeat(np.cumsum(mcus) - mcus, mcus)
    first = 6 * (np.cumsum(mcus) - mcus)[image]
    w, total = wide[image], mcus[image]
    r, c = i // w, i % w
    luma = [first + (2 * r + dy) * 2 * w + 2 * c + dx for dy in (0, 1) for dx in (0, 1)]
    return np.stack([*luma, first + 4 * total + i, first + 5 * total + i], 1), mcus


def payload_jpegs(sizes: np.ndarray, data: np.ndarray) -> list[bytes]:
    """One progressive JPEG for each payload of sizes bytes (positive multiples of 64) in data."""
    blocks = sizes // 64
    wide, high = _layout(blocks)
    room = 6 * wide * high
    coef = np.full((int(room.sum()), 64), 256, np.int16)
    place = np.arange(int(blocks.sum())) + np.repeat(np.cumsum(room) - room - (np.cumsum(blocks) - blocks), blocks)
    coef[place] += data.reshape(-1, 64)
    units, mcus = _mcu_blocks(wide, high)
    dc = _codes(DC_BITS, DC_VALUES)
    # DC first pass: differences inside an MCU, one MCU per interval; codes of differing length, so bits are put one by one
    first = coef[:, 0][units].astype(np.int64) >> 1
    diff = first.copy()
    diff[:, 1:4] -= first[:, 0:3]
    cat = np.zeros(diff.shape, np.int64)
    size = np.abs(diff)
    while size.any():
        cat += size > 0
        size >>= 1
    code_len = np.array([dc[s][0] for s in range(12)])
    code = np.array([dc[s][1] for s in range(12)])
    word = (code[cat] << cat) | np.where(diff < 0, diff + (1 << cat) - 1, diff)
    length = code_len[cat] + cat
    total = length.sum(1)
    bytes_used = -(-total // 8)
    dc_bits = np.ones((len(units), int(bytes_used.max()) * 8), np.uint8)
    start = np.cumsum(length, 1) - length
    for u in range(6):
        for b in range(int(length[:, u].max())):
            has = b < length[:, u]
            dc_bits[np.flatnonzero(has), (start[:, u] + b)[has]] = (word[has, u] >> (length[has, u] - 1 - b)) & 1
    scans = [(b"\x01\x02\x03", 0, 0, 0, 1, _join(np.packbits(dc_bits, axis=1), bytes_used, mcus))]
    scans.append((b"\x01\x02\x03", 0, 0, 1, 0, _scan_bytes((coef[:, 0][units] & 1).astype(np.uint8), mcus)))
    starts = np.cumsum(room) - room
    end_of_band = _codes(AC_BITS, AC_VALUES)[0]
    for component, skip, take in ((1, 0, 4), (2, 4, 1), (3, 5, 1)):
        n = take * wide * high
        own = np.arange(int(n.sum())) + np.repeat(starts + skip * wide * high - (np.cumsum(n) - n), n)
        ac = coef[own]
        for ss, se in ((1, 5), (6, 63)):
            # the code of "size 8" is a single 0, then come the 8 bits of the value
            scans.append((bytes([component]), ss, se, 0, 1, _scan_bytes(_bits(ac[:, ss : se + 1].astype(np.uint16) >> 1, 9), n)))
        head = np.broadcast_to(_bits(np.array([end_of_band[1]], np.uint16), end_of_band[0]), (len(ac), end_of_band[0]))
        scans.append((bytes([component]), 1, 63, 1, 0, _scan_bytes(np.concatenate([head, (ac[:, 1:] & 1).astype(np.uint8)], 1), n)))
    tables = _segment(0xDB, bytes([0]) + bytes([1]) * 64)
    huffman = _segment(0xC4, bytes([0x00]) + DC_BITS + DC_VALUES) + _segment(0xC4, bytes([0x10]) + AC_BITS + AC_VALUES) + _segment(0xDD, struct.pack(">H", 1))
    out = []
    for i in range(len(sizes)):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * int(high[i]), 16 * int(wide[i]), 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        note = _segment(0xFE, b"payload " + struct.pack(">Q", int(sizes[i])))
        out.append(b"".join([b"\xff\xd8", note, tables, frame, huffman, *(x for c, ss, se, ah, al, d in scans for x in (_sos(c, ss, se, ah, al), d[i])), b"\xff\xd9"]))
    return out


# ---- reading -------------------------------------------------------------------------------------------------------------------


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks a row, padded to whole MCUs
    high: int = 0
    own_wide: int = 0  # blocks a row in a scan of this component alone
    own_high: int = 0
    coef: np.ndarray | None = None
    base: int = 0


@dataclass
class Image:
    height: int = 0
    width: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)
    scans: list[tuple] = field(default_factory=list)  # (key, components, begin, end of data)


def _parse(data: bytes, raw: np.ndarray, marks: np.ndarray) -> Image:
    """Frame, tables and the places of the scans. marks: places of 0xFF before a byte that is neither 0 nor a restart."""
    image, huff, restart, at = Image(), {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("no image")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
            mw, mh = -(-image.width // (8 * hm)), -(-image.height // (8 * vm))
            for c in image.components:
                c.wide, c.high = mw * c.h, mh * c.v
                c.own_wide, c.own_high = -(-(-(-image.width * c.h // hm)) // 8), -(-(-(-image.height * c.v // vm)) // 8)
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a progressive Huffman image")
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 << wide
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xFE:
            image.comments.append(body)
        elif kind == 0xDA:
            n = body[0]
            chosen = [next(i for i, c in enumerate(image.components) if c.ident == body[1 + 2 * j]) for j in range(n)]
            ss, se, a = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
            k = np.searchsorted(marks, at)
            end = int(marks[k]) if k < len(marks) else len(data)
            tables = tuple(huff.get(body[2 + 2 * j] >> 4 if ss == 0 else 0x10 | body[2 + 2 * j] & 15) for j in range(n))
            shape = tuple((image.components[i].h, image.components[i].v) for i in chosen)
            image.scans.append(((len(chosen) > 1, shape, ss, se, a >> 4, a & 15, restart, tables), chosen, at, end))
            at = end
    if not image.components:
        raise ValueError("no frame")
    return image


_luts: dict[bytes, np.ndarray] = {}


def _lut(table: bytes) -> np.ndarray:
    """16 bits -> length << 8 | symbol."""
    if table not in _luts:
        out = np.zeros(1 << 16, np.int32)
        for symbol, (n, code) in _codes(table[:16], table[16:]).items():
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
        _luts[table] = out
    return _luts[table]


class _Segments:
    """Restart intervals of many scans as one buffer without stuffing and markers."""

    def __init__(self, parts: list[np.ndarray]):
        sizes = np.array([len(p) for p in parts])
        raw = np.concatenate([*parts, np.zeros(1, np.uint8)])
        ff = raw[:-1] == 0xFF
        rst = np.flatnonzero(ff & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
        stuffed = np.flatnonzero(ff & (raw[1:] == 0)) + 1
        ends = np.cumsum(sizes)
        stuffed = stuffed[~np.isin(stuffed, ends)]
        keep = np.ones(len(raw) - 1, bool)
        keep[rst], keep[rst + 1], keep[stuffed] = False, False, False
        kept = np.concatenate([[0], np.cumsum(keep)])
        bounds = np.sort(np.concatenate([ends - sizes, rst + 2, [len(raw) - 1]]))
        self.begin, self.end = kept[bounds[:-1]], kept[bounds[1:]]
        self.per_image = np.searchsorted(rst, ends) - np.searchsorted(rst, ends - sizes) + 1
        self.data = np.concatenate([raw[:-1][keep], np.zeros(8, np.uint8)]).astype(np.uint64)
        self.bytes = self.data.astype(np.uint8)

    def matrix(self) -> np.ndarray | None:
        """Bits of all segments if these are equally long."""
        n = self.end - self.begin
        if not len(n) or (n != n[0]).any():
            return None
        return np.unpackbits(self.bytes[self.begin[0] : self.end[-1]].reshape(len(n), -1), axis=1)

    def peek(self, p: np.ndarray) -> np.ndarray:
        """32 bits from bit p on."""
        at = np.minimum(p >> 3, len(self.data) - 5)
        d = self.data
        word = d[at] << np.uint64(32) | d[at + 1] << np.uint64(24) | d[at + 2] << np.uint64(16) | d[at + 3] << np.uint64(8) | d[at + 4]
        return ((word >> (8 - (p & 7)).astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits) * (size > 0)


def _dc(seg: _Segments, coef: np.ndarray, unit: np.ndarray, comp: np.ndarray, first: np.ndarray, count: np.ndarray, ah: int, al: int, tables: tuple) -> None:
    """unit: block of each coded unit in order; comp: its component; first, count: the units of each segment."""
    p = seg.begin * 8
    if ah:
        for j in range(int(count.max())):
            live = np.flatnonzero(j < count)
            bit = seg.peek(p[live] + j) >> 31
            coef[unit[first[live] + j], 0] |= (bit << al).astype(coef.dtype)
        return
    luts = np.stack([_lut(t) for t in tables])
    pred = np.zeros((len(first), len(tables)), np.int64)
    for j in range(int(count.max())):
        live = np.flatnonzero(j < count)
        c = comp[first[live] + j]
        word = seg.peek(p[live])
        hit = luts[c, word >> 16]
        n, s = hit >> 8, hit & 255
        value = seg.peek(p[live] + n) >> (32 - s)
        pred[live, c] += _extend(value, s)
        p[live] += n + s
        coef[unit[first[live] + j], 0] = pred[live, c] << al


def _ac_first(seg: _Segments, coef: np.ndarray, unit: np.ndarray, first: np.ndarray, count: np.ndarray, ss: int, se: int, al: int, table: bytes) -> None:
    lut, k = _lut(table), se - ss + 1
    bits = seg.matrix() if (count == 1).all() else None
    if bits is not None:
        head = int(lut[int(seg.peek(seg.begin[:1] * 8)[0]) >> 16])
        n, run, s = head >> 8, head >> 4 & 15, head & 15
        if n and s and not run and k * (n + s) <= bits.shape[1]:
            groups = bits[:, : k * (n + s)].reshape(len(bits), k, n + s)
            if (groups[:, :, :n] == groups[0, 0, :n]).all():  # every symbol of every block is the first one
                value = groups[:, :, n:].astype(np.float32) @ (1 << np.arange(s - 1, -1, -1)).astype(np.float32)
                coef[unit[first], ss : se + 1] = _extend(value.astype(np.int64), np.int64(s)) << al
                return
    p, b, k = seg.begin * 8, np.zeros(len(first), np.int64), np.full(len(first), ss)
    live = np.flatnonzero(b < count)
    while len(live):
        q = p[live]
        hit = lut[seg.peek(q) >> 16]
        n, r, s = hit >> 8, hit >> 4 & 15, hit & 15
        if not n.all():
            raise ValueError("bad code")
        q = q + n
        extra = np.where(s > 0, s, np.where(r < 15, r, 0))
        value = np.where(extra > 0, seg.peek(q) >> (32 - extra), 0)
        p[live] = q + extra
        put = s > 0
        at = k[live] + np.where(put, r, np.where(r == 15, 16, 0))
        who = np.flatnonzero(put & (at <= se))
        coef[unit[first[live[who]] + b[live[who]]], at[who]] = _extend(value[who], s[who]) << al
        at = at + put
        band = ~put & (r < 15)
        jump = np.where(band, (1 << r) + value, (at > se).astype(np.int64))
        b[live] += jump
        k[live] = np.where(jump > 0, ss, at)
        live = live[b[live] < count[live]]


def _ac_refine(seg: _Segments, coef: np.ndarray, unit: np.ndarray, first: np.ndarray, count: np.ndarray, ss: int, se: int, al: int, table: bytes) -> None:
    lut, one = _lut(table), 1 << al
    if (count == 1).all() and (bits := seg.matrix()) is not None:
        head = int(lut[int(seg.peek(seg.begin[:1] * 8)[0]) >> 16])
        n, k = head >> 8, se - ss + 1
        now = coef[unit[first], ss : se + 1]
        if n and head & 255 == 0 and n + k <= bits.shape[1] and (bits[:, :n] == bits[0, :n]).all() and now.all():
            coef[unit[first], ss : se + 1] = now + np.sign(now) * (bits[:, n : n + k].astype(now.dtype) << al)
            return
    lanes = len(first)
    p, b, k = seg.begin * 8, np.zeros(lanes, np.int64), np.full(lanes, ss)
    band, zeros, value = np.zeros(lanes, np.int64), np.full(lanes, -1), np.zeros(lanes, np.int64)  # zeros: left to skip, -1: a symbol is due
    live = np.flatnonzero(b < count)
    while len(live):
        due = live[(band[live] == 0) & (zeros[live] < 0)]
        if len(due):
            hit = lut[seg.peek(p[due]) >> 16]
            n, r, s = hit >> 8, hit >> 4 & 15, hit & 15
            if not n.all():
                raise ValueError("bad code")
            extra = np.where(s > 0, 1, np.where(r < 15, r, 0))
            bits = np.where(extra > 0, seg.peek(p[due] + n) >> (32 - extra), 0)
            p[due] += n + extra
            ends = (s == 0) & (r < 15)
            band[due[ends]] = ((1 << r) + bits)[ends]
            zeros[due[~ends]] = r[~ends]
            value[due[~ends]] = np.where(s > 0, np.where(bits > 0, one, -one), 0)[~ends]
        at = unit[first[live] + b[live]]
        now = coef[at, k[live]]
        old = now != 0
        bit = seg.peek(p[live[old]]) >> 31
        p[live[old]] += 1
        coef[at[old], k[live[old]]] = now[old] + np.sign(now[old]) * (bit << al)
        fresh = live[~old]
        fresh = fresh[band[fresh] == 0]
        put = fresh[zeros[fresh] == 0]
        coef[unit[first[put] + b[put]], k[put]] = value[put]
        zeros[fresh] -= 1
        k[live] += 1
        over = live[k[live] > se]
        k[over], zeros[over] = ss, -1
        b[over] += 1
        band[over] = np.maximum(0, band[over] - 1)
        live = live[b[live] < count[live]]


def decode_coefficients(files: list[bytes | None]) -> list[Image | None]:
    """Images with coefficient arrays (blocks x 64, in scan order) per component; None for what is damaged."""
    images: list[Image | None] = []
    for data in files:
        try:
            raw = np.frombuffer(data, np.uint8)
            ff = np.flatnonzero(raw[:-1] == 0xFF)
            after = raw[ff + 1]
            images.append(_parse(data, raw, ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]))
        except (ValueError, IndexError, StopIteration, struct.error, TypeError):
            images.append(None)
    total = 0
    for image in images:
        for c in image.components if image else ():
            c.base, total = total, total + c.wide * c.high
    coef = np.zeros((total, 64), np.int32)
    for step in range(max((len(i.scans) for i in images if i), default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, image in enumerate(images):
            if image and step < len(image.scans):
                groups.setdefault(image.scans[step][0], []).append(i)
        for key, members in groups.items():
            try:
                _decode_scan(key, [images[i] for i in members], [files[i] for i in members], step, coef)
            except (ValueError, IndexError):
                if len(members) == 1:
                    images[members[0]] = None
                    continue
                for i in members:  # find the damaged one; what the others had of this scan is set anew
                    try:
                        _decode_scan(key, [images[i]], [files[i]], step, coef)
                    except (ValueError, IndexError):
                        images[i] = None
    for image in images:
        for c in image.components if image else ():
            c.coef = coef[c.base : c.base + c.wide * c.high]
    return images


def _decode_scan(key: tuple, images: list[Image], files: list[bytes], step: int, coef: np.ndarray) -> None:
    interleaved, _, ss, se, ah, al, restart, tables = key
    parts, units, comps, counts = [], [], [], []
    for image, data in zip(images, files, strict=True):
        _, chosen, begin, end = image.scans[step]
        parts.append(np.frombuffer(data, np.uint8)[begin:end])
        own = [image.components[i] for i in chosen]
        if interleaved:
            mh, mw = own[0].high // own[0].v, own[0].wide // own[0].h
            r, c = np.divmod(np.arange(mh * mw), mw)
            cols = [(x.base + (r * x.v + dy) * x.wide + c * x.h + dx, j) for j, x in enumerate(own) for dy in range(x.v) for dx in range(x.h)]
            units.append(np.stack([u for u, _ in cols], 1).ravel())
            comps.append(np.tile(np.array([j for _, j in cols]), mh * mw))
            each = len(cols)
        else:
            x, each = own[0], 1
            r, c = np.divmod(np.arange(x.own_wide * x.own_high), x.own_wide)
            units.append(x.base + r * x.wide + c)
            comps.append(np.zeros(len(r), np.int64))
        n = len(units[-1])
        per = restart * each if restart else n
        counts.append(np.minimum(per, n - np.arange(0, n, per)))
    seg = _Segments(parts)
    if any(len(c) != k for c, k in zip(counts, seg.per_image, strict=True)):
        raise ValueError("intervals are missing")
    unit, comp, count = np.concatenate(units), np.concatenate(comps), np.concatenate(counts)
    first = np.cumsum(count) - count
    if ss == 0:
        _dc(seg, coef, unit, comp, first, count, ah, al, tables)
    else:
        (_ac_refine if ah else _ac_first)(seg, coef, unit, first, count, ss, se, al, tables[0])


def rgb(image: Image) -> np.ndarray:
    """height x width x 3, uint8: dequantize, invert the transform, upsample chroma to full resolution, convert."""
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        pixels = (c.coef.astype(np.float32) * image.quant[c.table]) @ IDCT + 128
        plane = pixels.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(c.high * 8, c.wide * 8)
        plane = np.clip(np.rint(plane), 0, 255)
        planes.append(np.repeat(np.repeat(plane, vm // c.v, 0), hm // c.h, 1)[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def feature(tensor: np.ndarray) -> str:
    """Mean and spread of each channel and a coarse 4 x 4 brightness map, from the whole tensor."""
    h, w, _ = tensor.shape
    flat = tensor.reshape(-1, 3)
    total = flat.sum(0, dtype=np.int64)
    square = np.einsum("ij,ij->j", flat, flat, dtype=np.int64, casting="unsafe") if len(flat) < 1 << 20 else sum(np.einsum("ij,ij->j", x, x, dtype=np.int64, casting="unsafe") for x in np.array_split(flat, len(flat) >> 19))
    mean = total / len(flat)
    spread = np.sqrt(np.maximum(0, square / len(flat) - mean**2))
    rows, cols = np.arange(4) * h // 4, np.arange(4) * w // 4
    cells = np.add.reduceat(np.add.reduceat(tensor.sum(2, dtype=np.int64), rows, 0), cols, 1)
    bright = "".join("1" if x else "0" for x in (cells >= np.median(cells)).ravel())
    return " ".join([*(f"{x:.2f}" for x in mean), *(f"{x:.2f}" for x in spread), f"{int(bright, 2):04x}"])


def distribution(image: Image) -> np.ndarray:
    """How many coefficients of a payload's image lie in each of 16 equal bins."""
    return np.bincount(np.concatenate([(c.coef.ravel() - 256).clip(0, 255) >> 4 for c in image.components]), minlength=16)


def pages(media: bytes) -> list[bytes]:
    """The files of a stored payload."""
    parts = media.split(SEAM)
    return [(b"\xff\xd8" if i else b"") + p + (b"\xff\xd9" if i < len(parts) - 1 else b"") for i, p in enumerate(parts)]


def payload_of(image: Image) -> bytes:
    """The bytes that payload_jpegs stored."""
    size = struct.unpack(">Q", next(c for c in image.comments if c.startswith(b"payload "))[8:])[0]
    blocks = np.concatenate([c.coef for c in image.components])
    return (blocks - 256).astype(np.uint8).tobytes()[:size]


def decode_images(df: DataFrame, column: str = "media") -> DataFrame:
    """df with height, width (int) and tensor (binary, height x width x 3 bytes of RGB) instead of the column."""
    C.bound_batches(df.sparkSession, 64)
    kept = [f for f in df.schema.fields if f.name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = decode_coefficients(batch.column(column).to_pylist())
            tensors = [rgb(i) if i else None for i in images]
            yield C.arrow_rows(
                **{f.name: batch.column(f.name) for f in kept}, height=pa.array([None if t is None else t.shape[0] for t in tensors], pa.int32()),
                width=pa.array([None if t is None else t.shape[1] for t in tensors], pa.int32()), tensor=pa.array([None if t is None else t.tobytes() for t in tensors], pa.binary()),
            )

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "height int", "width int", "tensor binary"]))


def _padded(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lens = np.diff(offsets)
    sizes = np.maximum(64, -(-lens // 64) * 64)
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[np.arange(len(data)) + np.repeat(np.cumsum(sizes) - sizes - offsets[:-1], lens)] = data
    return sizes, out


def paged_jpegs(sizes: np.ndarray, data: np.ndarray, page: int | None = None) -> list[bytes]:
    """The stored form of each payload: files of at most `page` bytes of it, written a page's worth at a time."""
    page = page or PAGE
    owner = np.repeat(np.arange(len(sizes)), -(-sizes // page))
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    part = np.minimum(page, sizes[owner] - nth * page)
    at = np.concatenate([[0], np.cumsum(part)])
    out: list[list[bytes]] = [[] for _ in sizes]
    first = 0
    while first < len(part):
        end = max(first + 1, int(np.searchsorted(at, at[first] + page, "right")) - 1)
        for i, f in zip(owner[first:end].tolist(), payload_jpegs(part[first:end], data[at[first] : at[end]]), strict=True):
            out[i].append(f)
        first = end
    return [b"".join(x) for x in out]


def stored(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary) of texts: each text's padded bytes as progressive JPEGs."""
    C.bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, offsets, data in C.text_blocks(batch.column("text"), PAGE):
                yield C.arrow_rows(doc_id=batch.column("doc_id").slice(first, rows), n_bytes=pa.array(np.diff(offsets)), media=pa.array(paged_jpegs(*_padded(offsets, data)), pa.binary()))

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


class Told:
    """What a stored payload's files say, read one after another."""

    def __init__(self):
        self.digest, self.size, self.tail, self.bins, self.first, self.more = hashlib.sha256(), 0, b"", np.zeros(16, np.int64), "", 0

    def add(self, image: Image) -> None:
        payload = payload_of(image)
        self.digest.update(payload)
        self.size += len(payload)
        self.tail = payload[-64:]
        self.bins += distribution(image)
        told = feature(rgb(image))
        self.more = zlib.crc32(told.encode(), self.more) if self.first else 0
        self.first = self.first or told

    def feature(self) -> str:
        shares = " ".join(f"{x:.3f}" for x in self.bins / max(1, self.bins.sum()))
        return f"{self.first} {shares} {self.more:08x}"


def digests(df: DataFrame) -> DataFrame:
    """What the stored bytes of df (doc_id, n_bytes, media) hold, read back, and features of their pixels and coefficients."""
    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [Told() for _ in range(batch.num_rows)]
            size, whole, waiting, held = [], [], [], 0

            def flush() -> None:
                for (row, _), image in zip(waiting, decode_coefficients([f for _, f in waiting]), strict=True):
                    told[row].add(image)
                waiting.clear()

            for row in range(batch.num_rows):
                media = batch.column("media")[row].as_py()
                size.append(len(media))
                whole.append(hashlib.sha256(media).hexdigest())
                for f in pages(media):
                    waiting.append((row, f))
                    held += len(f)
                    if held > C.BLOCK_BYTES:
                        flush()
                        held = 0
            flush()
            yield C.arrow_rows(
                doc_id=batch.column("doc_id"), n_bytes=batch.column("n_bytes"), payload_bytes=pa.array([t.size for t in told], pa.int64()), payload_sha256=pa.array([t.digest.hexdigest() for t in told], pa.string()),
                tail_crc32=pa.array([zlib.crc32(t.tail) for t in told], pa.int64()), media_bytes=pa.array(size, pa.int64()), media_sha256=pa.array(whole, pa.string()), feature=pa.array([t.feature() for t in told], pa.string()),
            )

    return df.mapInArrow(run, kind)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(stored(C.pick(C.table(spark, sf_dir, "documents"), doc_id="long", text="string")))


QUERIES = {"op4_media": op4_media}
