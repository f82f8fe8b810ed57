"""GIF media columns: write payloads as animated GIF files, decode GIF files into timed frames.

The encoder writes LZW code streams with growing code widths and a clear code where the table is full. The decoder handles
streams of any kind, global and local palettes, transparency, frame offsets, interlacing and the four disposal rules.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

SIDE = 24
FRAME = SIDE * SIDE
DELAY = 4  # hundredths of a second
BITS = 8
#: Files with a larger canvas or frame aren't decoded: 192 MB of memory.
MOST_PIXELS = 1 << 26

# 3 bits of red, 3 of green, 2 of blue make a palette index.
_PALETTE = bytes(v for i in range(256) for v in ((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85))
_HEAD = b"GIF89a" + SIDE.to_bytes(2, "little") * 2 + bytes([0xF7, 0, 0]) + _PALETTE
_FRAME_HEAD = bytes([0x21, 0xF9, 4, 0, *DELAY.to_bytes(2, "little"), 0, 0, 0x2C, 0, 0, 0, 0, SIDE, 0, SIDE, 0, 0, BITS])
_TABLE = 4096
#: Frames that are encoded or decoded at once, about 1 MB of samples.
TOGETHER = 2048


def pad(data: bytes, to: int = FRAME, fill: int = 255) -> bytes:
    """Bytes `fill` appended up to a positive multiple of `to`."""
    return data + bytes([fill]) * (max(1, -(-len(data) // to)) * to - len(data))


def lzw_codes(pixels: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(codes, numbers of codes) of the LZW streams of many frames (rows of indices below 2**bits), pixel by pixel for all frames at once.

    Every stream begins with a clear code and closes with an end code. Frames are too short to fill the code table.
    """
    count, n = pixels.shape
    clear = 1 << bits
    assert 0 < n <= _TABLE - clear - 2
    spread = np.uint32(2654435769)
    slot_bits = int(np.ceil(np.log2(2 * n + 2))) + 1
    keys, values = np.full(count << slot_bits, -1, np.int32), np.zeros(count << slot_bits, np.int16)  # a hash table a frame
    base = np.arange(count) << slot_bits
    codes, at, every = np.zeros((count, n + 2), np.int16), np.ones(count, np.int64), np.arange(count)
    codes[:, 0] = clear
    word, free = pixels[:, 0].astype(np.int32), np.full(count, clear + 2, np.int16)
    for k in range(1, n):
        value = pixels[:, k].astype(np.int32)
        key = word << 8 | value
        slot = (key.astype(np.uint32) * spread >> np.uint32(32 - slot_bits)).astype(np.int64)
        place = base + slot
        found = keys[place]
        off = np.flatnonzero((found != key) & (found >= 0))
        while len(off):  # taken by another key: the next slot
            slot[off] = slot[off] + 1 & (1 << slot_bits) - 1
            place[off] = base[off] + slot[off]
            found[off] = keys[place[off]]
            off = off[(found[off] != key[off]) & (found[off] >= 0)]
        new = np.flatnonzero(found < 0)
        known = values[place]
        codes[new, at[new]] = word[new]
        at[new] += 1
        keys[place[new]], values[place[new]] = key[new], free[new]
        free[new] += 1
        word = known.astype(np.int32)
        word[new] = value[new]
    codes[every, at] = word
    codes[every, at + 1] = clear + 1
    return codes, at + 2


def _widths(n: int, bits: int) -> np.ndarray:
    """Widths of the first n codes behind a clear code."""
    return np.minimum(12, np.frexp((1 << bits) + 1 + np.arange(n))[1])


def _packed(codes: np.ndarray, counts: np.ndarray, bits: int) -> list[bytes]:
    """Streams of codes (rows) as bytes, lowest bit first."""
    width = np.concatenate([[bits + 1], _widths(codes.shape[1] - 1, bits)])
    ends = np.cumsum(width)
    size = -(-ends[counts - 1] // 8)
    start = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(len(codes)), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    bit = 8 * start[row] + (ends - width)[at]
    value, byte, n = codes[row, at].astype(np.int64) << (bit & 7), bit >> 3, int(start[-1])
    raw = sum(np.bincount(byte + k, value >> (8 * k) & 0xFF, n + 3) for k in range(3)).astype(np.uint8).tobytes()
    return [raw[i:j] for i, j in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """Animated GIFs of 24 x 24 frames, one palette index per payload byte; lengths must be positive multiples of 576."""
    pixels = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    raws = [r for i in range(0, len(pixels), TOGETHER) for r in _packed(*lzw_codes(pixels[i : i + TOGETHER]), BITS)]
    out, at = [], 0
    for p in payloads:
        parts = [_HEAD]
        for raw in raws[at : at + len(p) // FRAME]:
            parts.append(_FRAME_HEAD)
            for i in range(0, len(raw), 255):
                part = raw[i : i + 255]
                parts += [bytes([len(part)]), part]
            parts.append(b"\0")
        at += len(p) // FRAME
        out.append(b"".join([*parts, b"\x3b"]))
    return out


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    palette: bytes
    transparent: int | None
    disposal: int
    delay: int
    interlaced: bool
    min_bits: int
    codes: bytes
    pixels: np.ndarray | None = None


@dataclass
class Gif:
    width: int
    height: int
    background: int
    frames: list[Frame] = field(default_factory=list)


def parse(data: bytes) -> Gif:
    """The blocks of a GIF file. Anything that isn't a GIF, or is larger than MOST_PIXELS, raises ValueError; a cut file keeps the frames before the cut."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF file")
    u16 = lambda i: data[i] | data[i + 1] << 8
    gif, flags, at = Gif(u16(6), u16(8), data[11]), data[10], 13
    if gif.width * gif.height > MOST_PIXELS:
        raise ValueError("too large a GIF file")
    shared = b""
    if flags & 0x80:
        shared = data[at : at + 3 * (2 << (flags & 7))]
        at += len(shared)
    transparent, disposal, delay = None, 0, 0
    try:
        while True:
            kind = data[at]
            if kind == 0x21:
                if data[at + 1] == 0xF9:
                    transparent = data[at + 6] if data[at + 3] & 1 else None
                    disposal, delay = data[at + 3] >> 2 & 7, u16(at + 4)
                at += 2
                while data[at]:
                    at += 1 + data[at]
                at += 1
            elif kind == 0x2C:
                left, top, width, height, own = u16(at + 1), u16(at + 3), u16(at + 5), u16(at + 7), data[at + 9]
                at += 10
                palette = shared
                if own & 0x80:
                    palette = data[at : at + 3 * (2 << (own & 7))]
                    at += len(palette)
                bits, at = data[at], at + 1
                if not 1 <= bits <= 8 or width * height > MOST_PIXELS:
                    raise ValueError("not a frame of a GIF file")
                parts = []
                while size := data[at]:
                    parts.append(data[at + 1 : at + 1 + size])
                    at += 1 + size
                at += 1
                gif.frames.append(Frame(left, top, width, height, palette, transparent, disposal, delay, bool(own & 0x40), bits, b"".join(parts)))
                transparent, disposal, delay = None, 0, 0
            else:
                return gif
    except IndexError:
        return gif


def _runs(raws: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, owner of each run, length of each run): the codes between the clear codes of some streams, up to an end code or one that can't be."""
    clear = 1 << bits
    data = np.frombuffer(b"".join(raws) + b"\0\0\0", np.uint8).astype(np.int64)
    size = np.array([len(r) for r in raws])
    end = 8 * np.cumsum(size)
    at = end - 8 * size
    opens = (data[at >> 3] | data[(at >> 3) + 1] << 8) & (2 << bits) - 1
    at = at + np.where((opens == clear) & (size > 0), bits + 1, 0)
    width = _widths(int((8 * size).max(initial=0)) // (bits + 1) + 1, bits)
    ends = np.cumsum(width)
    owner, codes, owners, lengths = np.arange(len(raws)), [], [], []
    while len(owner):
        count = np.searchsorted(ends, end[owner] - at, "right")
        some = count > 0
        owner, at, count = owner[some], at[some], count[some]
        if not len(owner):
            break
        first = np.cumsum(count) - count
        run = np.repeat(np.arange(len(owner)), count)
        j = np.arange(len(run)) - first[run]
        bit = at[run] + (ends - width)[j]
        byte = bit >> 3
        code = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (bit & 7) & (1 << width[j]) - 1
        stop = (code == clear) | (code == clear + 1) | (code > clear + 1 + j)
        used = np.minimum(np.minimum.reduceat(np.where(stop, j, len(run)), first), count)
        codes.append(code[j < used[run]])
        owners.append(owner)
        lengths.append(used)
        more = np.flatnonzero(used < count)
        more = more[code[first[more] + used[more]] == clear]
        at, owner = at[more] + ends[used[more]], owner[more]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, owners, lengths))


def _expanded(codes: np.ndarray, lengths: np.ndarray, clear: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, how many of them each run gives) of runs of codes.

    The k-th code behind a clear code adds an entry: its own word and the index that follows. So a later code for that entry repeats
    the output from the k-th code's place on, one index more than that code's word. Word lengths and then the
    indices themselves are found by following such references, twice as far in every round.
    """
    every = np.arange(len(codes), dtype=np.int32)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    parent = np.where(codes < clear, -1, first + codes - (clear + 2)).astype(np.int32)
    long, to, at = np.ones(len(codes), np.int32), parent.copy(), every[parent >= 0]
    while len(at):
        back = to[at]
        more, further = long[back], to[back]
        long[at] += more
        to[at] = further
        at = at[further >= 0]
    ends = np.cumsum(long, dtype=np.int64)
    starts = (ends - long).astype(np.int32)
    code = np.repeat(every, long)
    place = np.arange(len(code), dtype=np.int32)
    known = parent[code] < 0
    to = np.where(known, place, starts[parent[code]] + place - starts[code]).astype(np.int32)
    at = place[~known]
    while len(at):
        further = to[to[at]]
        to[at] = further
        at = at[~known[further]]
    run_ends = np.concatenate([[0], ends])[np.cumsum(lengths)]
    return codes[code[to]].astype(np.uint8), np.diff(np.concatenate([[0], run_ends]))


def lzw(raws: list[bytes], bits: int) -> list[bytes]:
    """The indices of LZW code streams; of a broken one those before the first code that can't be."""
    parts: list[list[bytes]] = [[] for _ in raws]
    codes, owners, lengths = _runs(raws, bits)
    flat, sizes = _expanded(codes, lengths, 1 << bits)
    flat, at = flat.tobytes(), 0
    for owner, size in zip(owners.tolist(), sizes.tolist(), strict=True):
        parts[owner].append(flat[at : at + size])
        at += size
    return [b"".join(p) for p in parts]


def read(files: list[bytes]) -> list[Gif | None]:
    """Parsed files with the palette indices of their frames; None for what is no GIF file. Indices that a stream doesn't give are 0."""
    out: list[Gif | None] = []
    for data in files:
        try:
            out.append(parse(data))
        except ValueError:
            out.append(None)
    every = [f for g in out if g for f in g.frames]
    for bits in {f.min_bits for f in every}:
        own, group, held = [f for f in every if f.min_bits == bits], [], 0
        for k, f in enumerate(own):
            group.append(f)
            held += f.width * f.height
            if held >= TOGETHER * FRAME or k == len(own) - 1:
                for g, flat in zip(group, lzw([g.codes for g in group], bits), strict=True):
                    g.pixels = _image(g, flat)
                group, held = [], 0
    return out


def _image(frame: Frame, flat: bytes) -> np.ndarray:
    """Palette indices of a frame as (height, width)."""
    n = frame.width * frame.height
    img = np.frombuffer(flat[:n] + bytes(max(0, n - len(flat))), np.uint8).reshape(frame.height, frame.width)
    if frame.interlaced:
        rows = np.concatenate([np.arange(a, frame.height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
        plain = np.empty_like(img)
        plain[rows] = img
        return plain
    return img


def _colours(palette: bytes) -> np.ndarray:
    out = np.zeros((256, 3), np.uint8)
    given = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)
    out[: len(given)] = given
    return out


def compose(gif: Gif) -> Iterator[tuple[int, Frame, np.ndarray]]:
    """(start in hundredths of a second, frame, RGB canvas) of each frame of a read() file, after palettes, transparency and disposal."""
    canvas = np.zeros((gif.height, gif.width, 3), np.uint8)
    time, given, colours = 0, None, None
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        if f.palette is not given:
            given, colours = f.palette, _colours(f.palette)
        h, w = min(f.height, gif.height - f.top), min(f.width, gif.width - f.left)
        if h > 0 and w > 0:
            part, area = f.pixels[:h, :w], canvas[f.top : f.top + h, f.left : f.left + w]
            if f.transparent is None:
                area[...] = colours[part]
            else:
                shown = part != f.transparent
                area[shown] = colours[part[shown]]
        yield time, f, canvas.copy()
        time += f.delay
        if f.disposal == 2:
            canvas[f.top : f.top + max(h, 0), f.left : f.left + max(w, 0)] = 0
        elif f.disposal == 3:
            canvas = before


def histograms(rgb: np.ndarray) -> np.ndarray:
    """Counts of 64 colour boxes, four levels of each channel, of each of some images (n, height, width, 3)."""
    q = rgb.reshape(len(rgb), -1, 3) >> 6
    box = ((q[:, :, 0] << 4) | (q[:, :, 1] << 2) | q[:, :, 2]) + 64 * np.arange(len(rgb))[:, None]
    return np.bincount(box.reshape(-1), minlength=64 * len(rgb)).reshape(-1, 64)
