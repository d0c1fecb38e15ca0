"""Media columns: baseline JPEG parsed and Huffman-decoded in numpy, DC-only luminance thumbnails and their hashes.

The decoder reads any baseline (SOF0) file of one to four components, in one scan or several: markers, quantisation and
Huffman tables, the first component's scan, restart markers. Bits are not walked one symbol at a time: all restart
intervals of TOGETHER images step together, one symbol a step, by tables over 16 bits. Files without restart markers work
the same way, with one interval each. AC symbols are decoded to be skipped (or kept, for :func:`unpack`); a thumbnail pixel
is its block's DC / 8 + 128. A stream that holds no code or runs past its interval makes its own image unreadable only.

:func:`pack` stores bytes losslessly as a baseline JPEG: 64 bytes are the 64 coefficients (byte - 128) of one 8 x 8
block in zigzag order, the quantisation table is all ones, each block is a restart interval, and a comment holds the
number of blocks; :func:`unpack` reads them back through the same decoder. So the unit of storage is the quantised
coefficient, which baseline JPEG keeps exactly, and not the pixel, which it rounds.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ..session import ship
from .common import beside, free_name, packed, table
from .textkit import utf8

#: Blocks that are coded at once (64 bytes each), and the most blocks along a side of an image.
BLOCKS, SIDE = 1 << 14, 8191


# Huffman tables ------------------------------------------------------------------------------------------------------


def canonical(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(DHT body: 16 counts and the symbols, code by symbol, length by symbol) of a canonical code."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(1 for s in order if lengths[s] == n) for n in range(1, 17)]
    code_of, length_of, code, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        code_of[s], length_of[s] = code, last
        code += 1
    return bytes(counts) + bytes(order), code_of, length_of


def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits: length << 8 | symbol of the code that they begin with; length 0 for none."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[k]
            code += 1
            k += 1
        code <<= 1
    return out


# The packer's own codes. DC: categories 0 to 8. AC: no run and sizes 1 to 8 in 3 to 7 bits, the rest in 14 to 16.
_DC = {s: (2 if s in (5, 6) else 3 if s == 7 else 4 if s == 4 else 6) for s in range(9)}
_AC = {0x05: 2, 0x06: 2, 0x07: 3, 0x04: 4, 0x08: 5, 0x03: 6, 0x02: 7, 0x01: 8, 0x00: 9} | {r << 4 | s: 14 for r in range(1, 16) for s in range(1, 9)} | {0xF0: 14}
_DC_BODY, _DC_CODE, _DC_LENGTH = canonical(_DC)
_AC_BODY, _AC_CODE, _AC_LENGTH = canonical(_AC)


# Encoder -------------------------------------------------------------------------------------------------------------


def _categories(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits needed, the bits) of each coefficient, in the standard's one's-complement form."""
    size = _BIT_LENGTH[np.abs(v)]
    return size, np.where(v < 0, v + (1 << size) - 1, v)


_BIT_LENGTH = np.array([i.bit_length() for i in range(1 << 11)], np.int64)


def _tokens(coefs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, code bits, length) of all symbols of blocks of 64 coefficients, in order."""
    n = len(coefs)
    size, bits = _categories(coefs[:, 0])
    dc = (_DC_CODE[size] << size) | bits
    dc_length = _DC_LENGTH[size] + size
    block, at = np.nonzero(coefs[:, 1:])
    value = coefs[block, at + 1]
    last = np.full(len(block), -1)
    last[1:] = np.where(block[1:] == block[:-1], at[:-1], -1)
    run = at - last - 1
    size, bits = _categories(value)
    symbol = (run & 15) << 4 | size
    ac, ac_length = (_AC_CODE[symbol] << size) | bits, _AC_LENGTH[symbol] + size
    final = np.full(n, -1)
    final[block] = at  # the last nonzero place wins
    open_end = np.flatnonzero(final < 62)
    long_runs = np.flatnonzero(run >= 16)
    zrl = np.repeat(long_runs, run[long_runs] >> 4)
    # Order by block, then place: DC, then each coefficient with its ZRLs before it, then the end of block.
    key = np.concatenate([np.arange(n) * 256, block * 256 + 2 * at + 3, block[zrl] * 256 + 2 * at[zrl] + 2, open_end * 256 + 255])
    code = np.concatenate([dc, ac, np.full(len(zrl), _AC_CODE[0xF0]), np.full(len(open_end), _AC_CODE[0])])
    length = np.concatenate([dc_length, ac_length, np.full(len(zrl), _AC_LENGTH[0xF0]), np.full(len(open_end), _AC_LENGTH[0])])
    order = np.argsort(key, kind="stable")
    return key[order] >> 8, code[order], length[order]


def _by_value(code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code with its bits, length) of each coefficient -128 to 127 that no zero precedes; AC zeros have no code."""
    size, bits = _categories(np.arange(-128, 128))
    return (code[size] << size) | bits, length[size] + size


_DC_BY_VALUE = _by_value(_DC_CODE, _DC_LENGTH)
_AC_BY_VALUE = _by_value(_AC_CODE[:16], _AC_LENGTH[:16])
_AC_BY_VALUE[1][128] = 0
_AC_BY_VALUE[0][128] = 0


def _dense(coefs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code bits, length) of each place of each block and of its end; places without a code have length 0."""
    n = len(coefs)
    value = coefs.astype(np.int64) + 128
    code, length = np.zeros((n, 65), np.int64), np.zeros((n, 65), np.int64)
    code[:, 0], length[:, 0] = _DC_BY_VALUE[0][value[:, 0]], _DC_BY_VALUE[1][value[:, 0]]
    code[:, 1:64], length[:, 1:64] = _AC_BY_VALUE[0][value[:, 1:]], _AC_BY_VALUE[1][value[:, 1:]]
    open_end = coefs[:, 63] == 0
    code[open_end, 64], length[open_end, 64] = _AC_CODE[0], _AC_LENGTH[0]
    return code, length


def encode_blocks(coefs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entropy-coded bytes, end of each block in them): byte-aligned, padded with ones, FF stuffed; no markers."""
    code, length = _dense(coefs)
    zero = np.flatnonzero((coefs[:, 1:] == 0).any(1))
    if len(zero):  # blocks with runs of zeros, one code list for all of them
        block, some, wide = _tokens(coefs[zero])
        rank = np.arange(len(block)) - np.searchsorted(block, np.arange(len(zero)))[block]
        code[zero] = length[zero] = 0
        code[zero[block], rank], length[zero[block], rank] = some, wide
    bits = length.sum(1)
    whole = -(-bits // 8)
    base = np.concatenate([[0], np.cumsum(whole)])
    bit = np.cumsum(length, 1) - length + base[:-1, None] * 8
    code, length, bit = code.ravel(), length.ravel(), bit.ravel()
    pad = whole * 8 - bits
    bit = np.concatenate([bit, base[:-1] * 8 + bits])
    code = np.concatenate([code, (1 << pad) - 1])
    length = np.concatenate([length, pad])
    # A code of up to 24 bits lies in two 32-bit words at most; codes fill distinct bits, so sums are unions.
    shift = 64 - (bit & 31) - length
    wide = code.astype(np.uint64) << shift.astype(np.uint64)
    words = int(base[-1] // 4 + 2)
    word = bit >> 5
    total = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), words)
    total += np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), words + 1)[:words]
    data = total.astype(np.uint32).astype(">u4").view(np.uint8)[: base[-1]]
    full = data == 0xFF
    if full.any():
        stuffed = np.cumsum(full)
        out = np.zeros(len(data) + int(stuffed[-1]), np.uint8)
        out[np.arange(len(data)) + stuffed - full] = data
        ends = base[1:] + stuffed[base[1:] - 1]
        return out, ends
    return data, base[1:]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(blocks: int) -> tuple[bytes, int]:
    """The file up to its scan, and how many blocks the image has (whole rows)."""
    wide = min(blocks, max(64, -(-blocks // SIDE)))
    high = -(-blocks // wide)
    if wide > SIDE or high > SIDE:
        raise ValueError("a payload over 4 GB doesn't fit one baseline image")
    return (
        b"\xff\xd8"
        + _segment(0xFE, struct.pack(">I", blocks))
        + _segment(0xDB, bytes([0]) + bytes([1]) * 64)
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, high * 8, wide * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + _DC_BODY)
        + _segment(0xC4, b"\x10" + _AC_BODY)
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    ), wide * high


def pack(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A JPEG for each row's bytes; their number must be a positive multiple of 64."""
    n_blocks = np.diff(offsets) // 64
    coefs = raw.reshape(-1, 64)
    starts = offsets[:-1] // 64
    ends = np.concatenate([[0], np.cumsum(n_blocks)])
    # The scan of all rows' blocks, slice by slice, so that work memory does not grow with a text.
    parts: list[list[bytes]] = [[] for _ in n_blocks]
    for b in range(0, int(ends[-1]), BLOCKS):
        e = min(int(ends[-1]), b + BLOCKS)
        data, stop = encode_blocks(coefs[b:e].astype(np.int64) - 128)
        local = np.arange(b, e) - np.repeat(starts, n_blocks)[b:e]
        # After each block its restart marker, numbered within the row.
        out = np.empty(len(data) + 2 * (e - b), np.uint8)
        begin = np.concatenate([[0], stop[:-1]])
        width = stop - begin
        out[np.arange(len(data)) + 2 * np.repeat(np.arange(e - b), width)] = data
        mark = stop + 2 * np.arange(e - b)
        out[mark], out[mark + 1] = 0xFF, 0xD0 + (local & 7)
        r0, r1 = int(np.searchsorted(ends, b, "right")) - 1, int(np.searchsorted(ends, e, "left"))
        for r in range(r0, r1):
            lo, hi = max(b, int(ends[r])) - b, min(e, int(ends[r + 1])) - b
            if hi > lo:
                parts[r].append(out[(mark[lo - 1] + 2 if lo else 0) : mark[hi - 1] + 2].tobytes())
    grey, _ = encode_blocks(np.zeros((1, 64), np.int64))
    files = []
    for r, n in enumerate(n_blocks):
        head, area = header(int(n))
        scan = b"".join(parts[r]) + b"".join(grey.tobytes() + bytes([0xFF, 0xD0 + (i & 7)]) for i in range(int(n), area))
        files.append(head + scan[:-2] + b"\xff\xd9")  # the last interval has no marker
    return files


# Decoder -------------------------------------------------------------------------------------------------------------


@dataclass
class Image:
    """What the markers say, and where the scan is."""

    width: int = 0
    height: int = 0
    interval: int = 0
    comment: bytes = b""
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component's place, DC table, AC table
    start: int = 0


def parse(data: bytes) -> Image:
    """The markers of a baseline file up to the scan of its first component, past others; ValueError for anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI")
    im, at = Image(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker")
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                im.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n:
                    raise ValueError("half a table")
                im.huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            _, im.height, im.width, n = struct.unpack_from(">BHHB", body)
            im.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not baseline")
        elif marker == 0xDD:
            im.interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            im.comment = body
        elif marker == 0xDA:
            ids = [c[0] for c in im.components]
            im.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            im.start = at
            if not im.scan or not im.width or not im.height:
                raise ValueError("no picture")
            if any(c == 0 for c, _, _ in im.scan):
                return im
            at += _scan_bytes(np.frombuffer(data, np.uint8, offset=at))
    raise ValueError("no scan")


def _scan_bytes(data: np.ndarray) -> int:
    """How many bytes of data, from a scan's first on, come before the next marker that is no restart."""
    full = np.flatnonzero(data[:-1] == 0xFF)
    after = data[full + 1]
    stops = full[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    return int(stops[0]) if len(stops) else len(data)


def _intervals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes without stuffing and markers, start of each restart interval in them) of a scan."""
    end = _scan_bytes(data)
    full = np.flatnonzero(data[: end - 1] == 0xFF) if end else np.zeros(0, int)
    after = data[full + 1]
    marks = full[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.zeros(end, bool)
    drop[full[after == 0] + 1] = True
    drop[marks] = drop[marks + 1] = True
    starts = np.concatenate([[0], np.cumsum(~drop)[marks]])
    return data[:end][~drop], starts


class Bits:
    """The bit positions of many streams in one buffer; bad: those that held no code or ran past their end."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        padded = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.uint32)
        self.words = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]  # 32 bits from each byte on
        self.last = len(self.words) - 1
        self.at, self.end = starts.astype(np.int64) * 8, ends.astype(np.int64) * 8
        self.bad = np.zeros(len(starts), bool)

    def symbol(self, who: np.ndarray, tables: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, its extra bits as a coefficient) for the streams in who, each by its row of the lookup tables."""
        at = self.at[who]
        seen = (self.words[np.minimum(at >> 3, self.last)] << (at & 7).astype(np.uint32)) >> np.uint32(16)
        found = tables[row, seen]
        at = at + (found >> 8)
        size = found & 15
        value = (self.words[np.minimum(at >> 3, self.last)] << (at & 7).astype(np.uint32)).astype(np.int64) >> (32 - size)
        value = np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)
        self.at[who] = at + size
        self.bad[who] |= (found >> 8 == 0) | (at + size > self.end[who])
        return found & 255, np.where(size > 0, value, 0)


def _block(bits: Bits, who: np.ndarray, tables: np.ndarray, dc: np.ndarray, ac: np.ndarray, into: np.ndarray | None = None) -> np.ndarray:
    """Decodes one block of each stream in who; returns DC differences and writes ACs to into (rows as in who).

    dc and ac: each stream's rows of tables. A bad stream stops where it is.
    """
    _, diff = bits.symbol(who, tables, dc)
    place = np.zeros(len(who), np.int64)
    rest = np.flatnonzero(~bits.bad[who])
    while len(rest):
        symbol, value = bits.symbol(who[rest], tables, ac[rest])
        run = symbol >> 4
        more = (symbol & 15) > 0
        place[rest] += np.where(more, run + 1, np.where(symbol == 0xF0, 16, 64))
        if into is not None:
            put = rest[more]
            into[put, np.minimum(place[put], 63)] = value[more]
        bits.bad[who[rest[more & (place[rest] > 63)]]] = True
        rest = rest[(place[rest] < 63) & ~bits.bad[who[rest]]]
    return diff


def _tables(images: list[Image]) -> tuple[np.ndarray, dict[tuple[bytes, bytes], int]]:
    """The distinct Huffman tables of images, as rows of one lookup, and each one's row."""
    rows: dict[tuple[bytes, bytes], int] = {}
    for im in images:
        for t in im.huffman.values():
            rows.setdefault(t, len(rows))
    return np.stack([lookup(*t) for t in rows]), rows


def decode(images: list[Image], files: list[bytes]) -> list[np.ndarray | None]:
    """The DC thumbnail of each image's first component as uint8, or None where its scan can't be read.

    The restart intervals of all images step together, one block at a time.
    """
    out: list[np.ndarray | None] = [None] * len(images)
    laid = []
    for n, (im, data) in enumerate(zip(images, files, strict=True)):
        try:
            laid.append(_layout(n, im, data))
        except (ValueError, KeyError, IndexError):
            continue
    if not laid:
        return out
    tables, row_of = _tables([images[p["n"]] for p in laid])
    most = max(len(p["blocks"]) for p in laid)
    shape = (len(laid), most)
    part, dc_row, ac_row, dy, dx = (np.zeros(shape, np.int64) for _ in range(5))
    for k, p in enumerate(laid):
        im = images[p["n"]]
        for b, (c, dc, ac, y, x) in enumerate(p["blocks"]):
            part[k, b], dc_row[k, b], ac_row[k, b], dy[k, b], dx[k, b] = c, row_of[im.huffman[dc]], row_of[im.huffman[16 | ac]], y, x
    each = lambda name: np.array([p[name] for p in laid], np.int64)
    streams, per_mcu, step, mcus, across, hh, vv, grid = each("streams"), np.array([len(p["blocks"]) for p in laid]), each("step"), each("mcus"), each("across"), each("h"), each("v"), each("grid")
    base = np.concatenate([[0], np.cumsum([p["raw"].size for p in laid])])
    starts = np.concatenate([p["starts"] + o for p, o in zip(laid, base[:-1], strict=True)])
    ends = np.concatenate([p["ends"] + o for p, o in zip(laid, base[:-1], strict=True)])
    bits = Bits(np.concatenate([p["raw"] for p in laid]), starts, ends)
    image = np.repeat(np.arange(len(laid)), streams)
    first = (np.arange(len(image)) - np.repeat(np.cumsum(streams) - streams, streams)) * step[image]  # its first MCU
    blocks = np.minimum(step[image], mcus[image] - first) * per_mcu[image]
    put = np.concatenate([[0], np.cumsum(grid)])
    values, before = np.zeros(int(put[-1]), np.int64), np.zeros((len(image), 4), np.int64)
    who, t = np.arange(len(image)), 0
    while len(who):
        im, slot = image[who], t % per_mcu[image[who]]
        c = part[im, slot]
        before[who, c] += _block(bits, who, tables, dc_row[im, slot], ac_row[im, slot])
        own = c == 0
        w, k, s = who[own], im[own], slot[own]
        mcu = first[w] + t // per_mcu[k]
        values[put[k] + (mcu // across[k] * vv[k] + dy[k, s]) * (across[k] * hh[k]) + mcu % across[k] * hh[k] + dx[k, s]] = before[w, 0]
        t += 1
        who = who[(blocks[who] > t) & ~bits.bad[who]]
    spoilt = set(image[bits.bad].tolist())
    for k, p in enumerate(laid):
        if k not in spoilt:
            dc = values[put[k] : put[k + 1]].reshape(-1, p["across"] * p["h"])[: p["down_blocks"], : p["across_blocks"]]
            out[p["n"]] = np.clip(dc * int(p["scale"]) // 8 + 128, 0, 255).astype(np.uint8)
    return out


def _layout(n: int, im: Image, data: bytes) -> dict:
    """Where the blocks of an image's scan are: its streams, and the blocks of an MCU in order."""
    raw, starts = _intervals(np.frombuffer(data, np.uint8, offset=im.start))
    most_h, most_v = max(c[1] for c in im.components), max(c[2] for c in im.components)
    _, h, v, q = im.components[0]
    if not 1 <= len(im.scan) <= 4 or len(im.components) > 4 or not h or not v:
        raise ValueError("no sampling")
    wide, high = -(-im.width * h // most_h), -(-im.height * v // most_v)  # the first component's samples
    if len(im.scan) == 1:  # by itself: one block for each MCU, only those that it has
        h, v, across, down = 1, 1, -(-wide // 8), -(-high // 8)
    else:
        across, down = -(-im.width // (8 * most_h)), -(-im.height // (8 * most_v))
    blocks = []
    for c, dc, ac in im.scan:
        hc, vc = (1, 1) if len(im.scan) == 1 else im.components[c][1:3]
        if dc not in im.huffman or (16 | ac) not in im.huffman:
            raise ValueError("no table")
        blocks += [(c, dc, ac, y, x) for y in range(vc) for x in range(hc)]
    mcus = across * down
    if mcus * len(blocks) * 2 > 8 * len(raw):  # a block takes two bits at least
        raise ValueError("too few bytes")
    step = im.interval or mcus
    streams = -(-mcus // step)
    if len(starts) < streams:
        raise ValueError("restart markers are missing")
    ends = np.concatenate([starts[1:], [len(raw)]])[:streams]
    return {
        "n": n, "raw": raw, "starts": starts[:streams], "ends": ends, "streams": streams, "step": step, "mcus": mcus, "across": across, "h": h, "v": v, "grid": mcus * h * v, "blocks": blocks,
        "down_blocks": -(-high // 8), "across_blocks": -(-wide // 8), "scale": im.quant[q][0],
    }


def unpack(files: list[bytes]) -> list[tuple[Image, np.ndarray, np.ndarray]]:
    """(image, thumbnail, the packed bytes) of each file of :func:`pack`, decoded side by side."""
    images = [parse(f) for f in files]
    parts, starts, base = [], [], 0
    for im, f in zip(images, files, strict=True):
        raw, begin = _intervals(np.frombuffer(f, np.uint8, offset=im.start))
        parts.append(raw)
        starts.append(begin + base)
        base += len(raw)
    coefs = np.empty((sum(len(s) for s in starts), 64), np.int16)
    tables, row = _tables(images[:1])
    dc, ac = (row[images[0].huffman[k]] for k in (0, 16))
    data, begin = np.concatenate(parts), np.concatenate(starts)
    ends = np.concatenate([begin[1:], [base]])
    for b in range(0, len(begin), BLOCKS):
        e = min(len(begin), b + BLOCKS)
        some = np.zeros((e - b, 64), np.int16)
        bits = Bits(data[begin[b] : ends[e - 1]], begin[b:e] - begin[b], ends[b:e] - begin[b])
        some[:, 0] = _block(bits, np.arange(e - b), tables, np.full(e - b, dc), np.full(e - b, ac), some)
        if bits.bad.any():
            raise ValueError("a stored file can't be read")
        coefs[b:e] = some
    out, at = [], 0
    for im, own in zip(images, starts, strict=True):
        n = struct.unpack(">I", im.comment)[0]
        mine = coefs[at : at + len(own)]
        at += len(own)
        thumb = np.clip(mine[:, 0].astype(np.int64) // 8 + 128, 0, 255).astype(np.uint8).reshape(im.height // 8, im.width // 8)
        out.append((im, thumb, (mine[:n] + 128).astype(np.uint8).reshape(-1)))
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits, one for each cell of an 8 x 8 grid: is its mean over the mean of all? As 16 hex digits."""
    rows = np.linspace(0, thumb.shape[0], 9)
    columns = np.linspace(0, thumb.shape[1], 9)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    r0, c0 = np.floor(rows[:-1]).astype(int), np.floor(columns[:-1]).astype(int)
    r1, c1 = np.maximum(r0 + 1, np.ceil(rows[1:]).astype(int)), np.maximum(c0 + 1, np.ceil(columns[1:]).astype(int))
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    mean = (total[r1][:, c1] - total[r0][:, c1] - total[r1][:, c0] + total[r0][:, c0]) / area
    return f"{int(''.join('1' if b else '0' for b in (mean > thumb.mean()).ravel()), 2):016x}"


# Operators -----------------------------------------------------------------------------------------------------------


#: Images that are decoded side by side; each brings four tables of 65,536 codes at most.
TOGETHER = 32


def media_columns(rows: DataFrame, image: str = "image") -> DataFrame:
    """rows with width, height, thumbnail (row-major bytes, one for each 8 x 8 block) and thumbnail_hash.

    image: a binary column of JPEG files. Nulls, empty values and files that are not readable as baseline JPEG get
    nulls in all four, truncated ones too. Components may come in one scan or in several. Names that rows has get an
    underscore before them.
    """
    ship(rows.sparkSession)
    names = [free_name(rows, n) for n in ("width", "height", "thumbnail", "thumbnail_hash")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = [(None, None, None, None)] * len(batch)
            for at in range(0, len(batch), TOGETHER):
                places, images, files = [], [], []
                for place, data in enumerate(batch.column(image).slice(at, TOGETHER).to_pylist(), at):
                    try:
                        images.append(parse(data))
                    except (ValueError, KeyError, IndexError, TypeError, struct.error):
                        continue
                    places.append(place)
                    files.append(data)
                for place, im, thumb in zip(places, images, decode(images, files), strict=True):
                    if thumb is not None:
                        found[place] = (im.width, im.height, thumb.tobytes(), thumbnail_hash(thumb))
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

    kinds = (IntegerType(), IntegerType(), BinaryType(), StringType())
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *[StructField(n, k) for n, k in zip(names, kinds, strict=True)]]))


#: Payload bytes that are stored and read back at once; a longer text is a group of its own.
GROUP = 2 << 20


def stored_texts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the text's bytes padded with 0 to a positive multiple of 64 and stored as a JPEG, and what reading it gives.

    n_bytes (of the text), media (the file), payload_bytes, payload_sha256, tail_crc32 (last 64 bytes), width, height,
    thumbnail_hash; an underscore before a name that keep has. Null and empty texts are 64 zero bytes. Equal texts give
    equal files. No rows give no rows.
    """
    ship(docs.sparkSession)
    rows = packed(docs, keep, text)
    names = ["n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "width", "height", "thumbnail_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("_text"))
            size = np.diff(offsets)
            padded = np.maximum(64, -(-size // 64) * 64)
            at = 0
            while at < len(size):
                to = max(at + 1, at + int(np.searchsorted(np.cumsum(padded[at:]), GROUP, "right")))
                ends = np.concatenate([[0], np.cumsum(padded[at:to])])
                payload = np.zeros(int(ends[-1]), np.uint8)
                part = raw[offsets[at] : offsets[to]]
                payload[np.arange(len(part)) + np.repeat(ends[:-1] - (offsets[at:to] - offsets[at]), size[at:to])] = part
                files = pack(payload, ends)
                found = []
                for f, (im, thumb, back) in zip(files, unpack(files), strict=True):
                    data = back.tobytes()
                    found.append((f, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), im.width, im.height, thumbnail_hash(thumb)))
                kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string())
                columns = [pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(at, to - at), pa.array(size[at:to], pa.int64()), *columns], ["_row", *names])
                at = to

    types = (LongType(), BinaryType(), LongType(), StringType(), LongType(), IntegerType(), IntegerType(), StringType())
    out = StructType([rows.schema["_row"], *[StructField(n, t) for n, t in zip(names, types, strict=True)]])
    return beside(rows.mapInArrow(run, out), *names)


def op10_media(spark, sf_dir: str) -> DataFrame:
    """One row for each document, by :func:`stored_texts`: null and empty texts are 64 zero bytes, equal rows give equal rows."""
    stored = stored_texts(table(spark, sf_dir, "documents"))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash")
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
