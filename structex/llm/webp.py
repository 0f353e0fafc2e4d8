"""Lossless WebP: a complete VP8L decoder, many images at once where they allow it, and a writer.

The decoder reads prefix codes (simple and normal, one group or an entropy image of groups), back
references with the two-dimensional distance map and the colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms. Images without colour cache and entropy
image, whose red, blue and alpha codes have one symbol, are decoded side by side: each step takes
one symbol of every image from lookup tables, which costs some 20 ns a symbol in numpy. All other
images go through the scalar decoder.

The writer stores samples as the green channel: prefix codes limited to 11 bits, runs and repeated
lines as back references, and a palette with bundled pixels for at most 16 different samples.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
MAX_SIDE = 1 << 14
N_LITERALS, N_LENGTHS, N_DISTANCES = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD

#: Neighbours by distance code: nearest first, then by column, the right one before the left one.
NEIGHBOURS = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0),
    key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0),
)


class WebPError(ValueError):
    """The bytes aren't a lossless WebP image that can be read."""


# ---------------------------------------------------------------- reading


class Bits:
    """Bits of a stream, least significant first; zeros follow its end."""

    def __init__(self, data: bytes):
        self.value, self.at, self.end = int.from_bytes(data[:4096], "little"), 0, 8 * len(data)
        self.data, self.base = data, 0

    def peek(self, n: int) -> int:
        local = self.at - self.base
        if local + n > 8 * 4096 - 64:
            self.base = self.at & ~7
            self.value = int.from_bytes(self.data[self.base >> 3 : (self.base >> 3) + 4096], "little")
            local = self.at - self.base
        return (self.value >> local) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        got = self.peek(n)
        self.at += n
        return got


def _reversed(bits: int) -> np.ndarray:
    """The numbers below 2**bits with their bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate((2 * out, 2 * out + 1))
    return out


_REVERSED = {n: _reversed(n) for n in range(16)}


class Code:
    """A prefix code as a table of symbol << 4 | length over the next bits of the stream."""

    __slots__ = ("bits", "table", "single")

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.single = int(used[0]) if len(used) == 1 else None
        if len(used) <= 1:
            self.bits, self.table = 0, np.array([(self.single or 0) << 4], np.int64)
            return
        own = lengths[used]
        self.bits = int(own.max())
        order = np.argsort(own, kind="stable")
        spans = 1 << (self.bits - own[order])
        if spans.sum() != 1 << self.bits:
            raise WebPError("a prefix code isn't complete")
        self.table = np.repeat((used[order] << 4) | own[order], spans)[_REVERSED[self.bits]]

    def read(self, bits: Bits) -> int:
        entry = int(self.table[bits.peek(self.bits)])
        bits.at += entry & 15
        return entry >> 4


def _read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(max(size, 256), np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    meta = np.zeros(19, np.int64)
    for place in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        meta[place] = bits.read(3)
    code = Code(meta)
    table, width = code.table.tolist(), code.bits
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        entry = table[bits.peek(width)]
        bits.at += entry & 15
        symbol = entry >> 4
        if symbol < 16:
            lengths[at] = symbol
            at += 1
            before = symbol or before
        elif symbol == 16:
            n = 3 + bits.read(2)
            lengths[at : at + n] = before
            at += n
        else:
            at += 3 + bits.read(3) if symbol == 17 else 11 + bits.read(7)
    if at > size:
        raise WebPError("code lengths run over")
    return Code(lengths)


def _value(prefix: int, bits: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEIGHBOURS):
        return code - len(NEIGHBOURS)
    x, y = NEIGHBOURS[code - 1]
    return max(1, x + y * width)


def _groups(bits: Bits, n: int, cache_bits: int) -> list[tuple[Code, ...]]:
    sizes = (N_LITERALS + N_LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, N_DISTANCES)
    return [tuple(_read_code(bits, s) for s in sizes) for _ in range(n)]


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB integers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("the colour cache is too large")
    which, block, across, n_groups = None, 0, 0, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        down = (height + (1 << block) - 1) >> block
        which = ((_pixels(bits, across, down, False) >> 8) & 0xFFFF).tolist()
        n_groups = max(which) + 1
    groups = _groups(bits, n_groups, cache_bits)
    total = width * height
    out, cache, cached, at = [0] * total, [0] * (1 << cache_bits), 0, 0
    group = groups[0]
    shift = 32 - cache_bits
    while at < total:
        if which is not None:
            y, x = divmod(at, width)
            group = groups[which[(y >> block) * across + (x >> block)]]
        symbol = group[0].read(bits)
        if symbol < N_LITERALS:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = (alpha << 24) | (red << 16) | (symbol << 8) | blue
            at += 1
        elif symbol < N_LITERALS + N_LENGTHS:
            length = _value(symbol - N_LITERALS, bits)
            back = _distance(_value(group[4].read(bits), bits), width)
            if back > at or length > total - at:
                raise WebPError("a back reference leaves the image")
            for at in range(at, at + length):
                out[at] = out[at - back]
            at += 1
        else:
            while cached < at:
                argb = out[cached]
                cache[((CACHE_FACTOR * argb) & 0xFFFFFFFF) >> shift] = argb
                cached += 1
            out[at] = cache[symbol - N_LITERALS - N_LENGTHS]
            at += 1
        if bits.at > bits.end + 64:
            raise WebPError("the stream ends early")
    return np.array(out, np.int64)


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The prediction of a pixel (channels in the last axis) from its neighbours."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([255, 0, 0, 0]), top.shape)
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _half(_half(left, right), top)
    if mode in (6, 7):
        return _half(left, corner if mode == 6 else top)
    if mode in (8, 9):
        return _half(top, corner if mode == 8 else right)
    if mode == 10:
        return _half(_half(left, corner), _half(top, right))
    if mode == 11:
        near_left = np.abs(top - corner).sum(axis=-1, keepdims=True)
        near_top = np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(near_left < near_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = _half(left, top)
    half = np.trunc((mean - corner) / 2).astype(mean.dtype)
    return np.clip(mean + half, 0, 255)


#: Modes that don't look at the pixel to the left: a row's stretch can be done at once.
_ROWWISE = {0, 2, 3, 4, 8, 9}


def _unpredict(image: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    """image: (height, width, 4) as ARGB channels."""
    height, width, _ = image.shape
    out = image.astype(np.int64)
    out[0, 0] = (out[0, 0] + [255, 0, 0, 0]) & 255
    if width > 1:
        out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        # the pixel right of the last column is the first of this row
        beyond = np.concatenate((above[1:], row[:1]))
        x = 1
        while x < width:
            mode = int(modes[y >> block, x >> block])
            end = min(width, ((x >> block) + 1) << block)
            if mode in _ROWWISE or mode > 13:
                row[x:end] = (row[x:end] + _predict(mode, above[x:end], above[x:end], beyond[x:end], above[x - 1 : end - 1])) & 255
            elif mode == 1:
                row[x:end] = np.cumsum(np.concatenate((row[x - 1 : x], row[x:end])), axis=0)[1:] & 255
            else:
                for i in range(x, end):
                    row[i] = (row[i] + _predict(mode, row[i - 1], above[i], beyond[i], above[i - 1])) & 255
            x = end
    return out


def _uncross(image: np.ndarray, codes: np.ndarray, block: int) -> np.ndarray:
    signed = lambda v: (v.astype(np.int64) ^ 128) - 128
    height, width, _ = image.shape
    full = codes[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block]
    red_to_blue, green_to_blue, green_to_red = signed(full[..., 1]), signed(full[..., 2]), signed(full[..., 3])
    out = image.astype(np.int64)
    green = signed(out[..., 2])
    out[..., 1] = (out[..., 1] + ((green_to_red * green) >> 5)) & 255
    out[..., 3] = (out[..., 3] + ((green_to_blue * green) >> 5) + ((red_to_blue * signed(out[..., 1])) >> 5)) & 255
    return out


def _channels(argb: np.ndarray, width: int, height: int) -> np.ndarray:
    return np.stack([(argb >> s) & 255 for s in (24, 16, 8, 0)], axis=-1).reshape(height, width, 4)


class _Header:
    """What stands before the main image: its size and the transforms in the order of the stream."""

    def __init__(self, data: bytes):
        if len(data) < 21 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
            raise WebPError("not a lossless WebP file")
        size = struct.unpack("<I", data[16:20])[0]
        if data[20] != 0x2F or 20 + size > len(data):
            raise WebPError("not a whole VP8L chunk")
        self.stream = data[21 : 20 + size]
        self.bits = bits = Bits(self.stream)
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        self.alpha = bits.read(1)
        if bits.read(3):
            raise WebPError("unknown version")
        self.coded_width, self.transforms, seen = self.width, [], set()
        while bits.read(1):
            kind = bits.read(2)
            if kind in seen:
                raise WebPError("a transform comes twice")
            seen.add(kind)
            width, height = self.coded_width, self.height
            if kind in (0, 1):
                block = bits.read(3) + 2
                w, h = (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
                self.transforms.append((kind, _channels(_pixels(bits, w, h, False), w, h), block, width))
            elif kind == 2:
                self.transforms.append((kind, None, 0, width))
            else:
                n = bits.read(8) + 1
                table = np.cumsum(_channels(_pixels(bits, n, 1, False), n, 1)[0], axis=0) & 255
                bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.transforms.append((kind, table, bundle, width))
                self.coded_width = (width + (1 << bundle) - 1) >> bundle

    def finish(self, image: np.ndarray) -> np.ndarray:
        """The main image's channels with all transforms inverted, last one first."""
        for kind, data, block, width in reversed(self.transforms):
            if kind == 0:
                image = _unpredict(image, data[..., 2], block)
            elif kind == 1:
                image = _uncross(image, data, block)
            elif kind == 2:
                image = image.copy()
                image[..., 1] = (image[..., 1] + image[..., 2]) & 255
                image[..., 3] = (image[..., 3] + image[..., 2]) & 255
            else:
                index = image[..., 2]
                if block:
                    each = 8 >> block
                    index = (index[..., None] >> (each * np.arange(1 << block))) & ((1 << each) - 1)
                    index = index.reshape(image.shape[0], -1)[:, :width]
                table = np.zeros((256, 4), np.int64)
                table[: len(data)] = data
                image = table[index]
        return image


def decode(data: bytes) -> np.ndarray:
    """The image as (height, width, 4) bytes in the order red, green, blue, alpha."""
    head = _Header(data)
    image = head.finish(_channels(_pixels(head.bits, head.coded_width, head.height, True), head.coded_width, head.height))
    if not head.alpha:
        image = image.copy()
        image[..., 0] = 255
    return image[..., [1, 2, 3, 0]].astype(np.uint8)


#: Images of one group that go side by side, and below how many the rest goes one by one.
LANES, FEW_LANES = 1024, 40


class _Lane:
    """An image of which only green and distances have more than one symbol."""

    __slots__ = ("head", "green", "far", "at", "total", "fixed", "number")

    def __init__(self, head: _Header, codes: tuple[Code, ...], number: int):
        self.head, self.green, self.far, self.number = head, codes[0], codes[4], number
        self.fixed = tuple(c.single or 0 for c in codes[1:4])
        self.at, self.total = head.bits.at, head.coded_width * head.height

    def one_by_one(self, out: np.ndarray, done: int, at: int) -> None:
        """Decode from pixel done and bit at on."""
        bits, table, width, total = self.head.bits, self.green.table.tolist(), self.green.bits, self.total
        bits.at, bits.base = at, at & ~7
        bits.value = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 4096], "little")
        literals, begin, mask = bytearray(), done, (1 << width) - 1
        limit, near = 8 * 4096 - 64, (1 << 256) - 1
        while done < total:
            local = bits.at - bits.base
            if local > limit - 300:
                bits.peek(400)  # loads the next part
                local = bits.at - bits.base
            value = (bits.value >> local) & near
            used = 0
            while used < 240 and done < total:
                entry = table[value & mask]
                symbol = entry >> 4
                if symbol > 255:
                    break
                value >>= entry & 15
                used += entry & 15
                literals.append(symbol)
                done += 1
            bits.at += used
            if done < total and used < 240:
                out[begin:done] = np.frombuffer(bytes(literals), np.uint8)
                literals.clear()
                bits.at += entry & 15
                done = begin = self.copy(out, done, symbol)
            elif bits.at > bits.end + 512:
                raise WebPError("the stream ends early")
        out[begin:done] = np.frombuffer(bytes(literals), np.uint8)

    def copy(self, out: np.ndarray, done: int, symbol: int) -> int:
        """Apply the back reference whose length symbol was read; bits stand behind the symbol."""
        bits = self.head.bits
        length = _value(symbol - N_LITERALS, bits)
        back = _distance(_value(self.far.read(bits), bits), self.head.coded_width)
        if back > done or done + length > self.total:
            raise WebPError("a back reference leaves the image")
        if back >= length:
            out[done : done + length] = out[done - back : done - back + length]
        else:
            out[done : done + length] = np.resize(out[done - back : done], length)
        return done + length


def _side_by_side(lanes: list[_Lane]) -> list[np.ndarray]:
    """The green samples of each lane's main image."""
    spare = 80
    streams = b"".join(lane.head.stream + b"\0" * 8 for lane in lanes)
    data = np.frombuffer(streams + b"\0" * 64, np.uint8).astype(np.uint32)
    word = data[:-3] | (data[1:-2] << 8) | (data[2:-1] << 16) | (data[3:] << 24)
    lengths = np.array([len(lane.head.stream) + 8 for lane in lanes], np.int64)
    base = 8 * (np.cumsum(lengths) - lengths)
    place = base + [lane.at for lane in lanes]
    width = max(lane.green.bits for lane in lanes)
    tables = np.concatenate([np.tile(lane.green.table, 1 << (width - lane.green.bits)) for lane in lanes]).astype(np.int32)
    room = np.array([lane.total for lane in lanes], np.int64)
    start = np.cumsum(room + spare) - (room + spare)
    out = np.zeros(int((room + spare).sum()), np.uint8)
    end, at = start + room, start.copy()
    first = np.arange(len(lanes), dtype=np.int64) << width
    who, mask, last = np.arange(len(lanes)), np.uint32((1 << width) - 1), len(word) - 1
    while len(who) > FEW_LANES:
        for _ in range(spare // 2):
            entry = tables[first + ((word[place >> 3] >> (place & 7).astype(np.uint32)) & mask)]
            place += entry & 15
            symbol = entry >> 4
            if symbol.max() > 255:
                for i in np.flatnonzero(symbol > 255):
                    if at[i] < end[i]:
                        lane = lanes[who[i]]
                        own = int(start[i])
                        lane.head.bits.at = int(place[i] - base[i])
                        at[i] = own + lane.copy(out[own : own + lane.total], int(at[i]) - own, int(symbol[i]))
                        place[i] = base[i] + lane.head.bits.at
                    else:
                        at[i] += 1
                literal = symbol < 256
                out[at[literal]] = symbol[literal]
                at += literal
            else:
                out[at] = symbol
                at += 1
            np.minimum(place, 8 * last, out=place)
        going = at < end
        if not going.all():
            who, at, end, start, place, base, first = (v[going] for v in (who, at, end, start, place, base, first))
    for i, number in enumerate(who):
        own, lane = int(start[i]), lanes[number]
        lane.one_by_one(out[own : own + lane.total], int(at[i]) - own, int(place[i] - base[i]))
    offsets = np.cumsum(room + spare) - (room + spare)
    return [out[o : o + n] for o, n in zip(offsets.tolist(), room.tolist(), strict=True)]


def decode_green(images: list[bytes]) -> list[np.ndarray]:
    """The green samples of each image, flat; the whole decoder runs for any kind of image."""
    out: list = [None] * len(images)
    lanes: list[_Lane] = []
    for number, data in enumerate(images):
        head = _Header(data)
        mark = head.bits.at
        if not head.bits.read(2):  # neither colour cache nor entropy image
            codes = _groups(head.bits, 1, 0)[0]
            # codes of one symbol have no bits: the stream is green symbols alone
            if codes[0].bits and all(c.bits == 0 for c in codes[1:4]):
                lanes.append(_Lane(head, codes, number))
                continue
        head.bits.at = mark
        image = _channels(_pixels(head.bits, head.coded_width, head.height, True), head.coded_width, head.height)
        out[number] = head.finish(image)[..., 2].astype(np.uint8).ravel()
    lanes.sort(key=lambda lane: lane.total)
    for at in range(0, len(lanes), LANES):
        group = lanes[at : at + LANES]
        for lane, green in zip(group, _side_by_side(group), strict=True):
            head = lane.head
            if head.transforms:
                image = np.empty((head.height, head.coded_width, 4), np.int64)
                image[..., 0], image[..., 1], image[..., 3] = lane.fixed[2], lane.fixed[0], lane.fixed[1]
                image[..., 2] = green.reshape(head.height, head.coded_width)
                green = head.finish(image)[..., 2].astype(np.uint8).ravel()
            out[lane.number] = green
    return out


# ---------------------------------------------------------------- writing

MAX_CODE_BITS = 11
#: A complete code for code lengths: 0 to 11 in 4 bits, the two runs of zeros in 3 bits.
_META = np.array([4] * 12 + [0] * 5 + [3, 3], np.int64)
MIN_RUN, MIN_LINE, MAX_COPY = 8, 24, 4096


def code_lengths(counts: np.ndarray, limit: int = MAX_CODE_BITS) -> np.ndarray:
    """Huffman lengths of at most limit bits; rare symbols are raised until they fit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].tolist()
    floor = 1
    while True:
        heap = [(max(w, floor), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, fresh = [0] * (2 * len(weights) - 1), len(weights)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = fresh
            heapq.heapreplace(heap, (a + b, fresh))
            fresh += 1
        depth = [0] * fresh
        for i in range(fresh - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(weights)]) <= limit:
            lengths[used] = depth[: len(weights)]
            return lengths
        floor = 2 * floor if floor > 1 else max(2, sum(weights) >> (limit + 1))


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, as they stand in the stream (first bit lowest)."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return out
    order = used[np.argsort(lengths[used], kind="stable")]
    own = lengths[order]
    top = int(own.max())
    spans = 1 << (top - own)
    first = (np.cumsum(spans) - spans) >> (top - own)
    for n in np.unique(own):
        at = own == n
        out[order[at]] = _REVERSED[int(n)][first[at]]
    return out


_META_CODES = codes(_META)


class Writer:
    """Values with their numbers of bits, packed at the end."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.v: list[int] = []
        self.n: list[int] = []

    def put(self, value: int, n: int) -> None:
        while n > 16:
            self.v.append(value & 0xFFFF)
            self.n.append(16)
            value, n = value >> 16, n - 16
        self.v.append(value)
        self.n.append(n)

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._close()
        self.values.append(values)
        self.sizes.append(sizes)

    def _close(self) -> None:
        if self.v:
            self.values.append(np.array(self.v, np.int64))
            self.sizes.append(np.array(self.n, np.int64))
            self.v, self.n = [], []

    def bytes(self) -> bytes:
        self._close()
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        ends = np.cumsum(sizes)
        at = ends - sizes
        shifted = values << (at & 7)
        at >>= 3
        n = (int(ends[-1]) + 7) // 8 + 3
        out = np.bincount(at, shifted & 255, n)
        out += np.bincount(at + 1, (shifted >> 8) & 255, n)
        out += np.bincount(at + 2, shifted >> 16, n)
        return out.astype(np.uint8).tobytes()[:-3]


def put_code(w: Writer, lengths: np.ndarray) -> None:
    """A prefix code; nothing but its one symbol for codes of one symbol."""
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        symbol = int(used[0]) if len(used) else 0
        if symbol < 256:
            wide = symbol > 1
            w.put(1 | (wide << 2) | (symbol << 3), 3 + (8 if wide else 1))
            return
    w.put(0, 1)
    w.put(15, 4)
    for place in CODE_LENGTH_ORDER:
        w.put(int(_META[place]), 3)
    w.put(0, 1)
    at, size, own = 0, len(lengths), lengths.tolist()
    while at < size:
        run = at
        while run < size and run - at < 138 and own[run] == 0:
            run += 1
        run -= at
        if run >= 11:
            w.put(int(_META_CODES[18]) | ((run - 11) << 3), 10)
        elif run >= 3:
            w.put(int(_META_CODES[17]) | ((run - 3) << 3), 6)
        else:
            run = 1
            w.put(int(_META_CODES[own[at]]), 4)
        at += run


def prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their number) of a length or a distance code."""
    value -= 1
    if value < 4:
        return value, 0, 0
    extra = value.bit_length() - 2
    return 2 * extra + 2 + ((value >> extra) & 1), value & ((1 << extra) - 1), extra


def _copies(samples: bytes) -> list[tuple[int, int, int]]:
    """(begin, length, back): runs of one sample, and lines that an earlier line equals."""
    found = []
    array = np.frombuffer(samples, np.uint8)
    change = np.flatnonzero(array[1:] != array[:-1]) + 1
    begins = np.concatenate(([0], change))
    lengths = np.diff(np.concatenate((begins, [len(array)])))
    for i in np.flatnonzero(lengths > MIN_RUN):
        found.append((int(begins[i]) + 1, int(lengths[i]) - 1, 1))
    at, seen = 0, {}
    for line in samples.split(b"\n"):
        n = len(line)
        if n >= MIN_LINE:
            before = seen.get(line)
            if before is not None:
                found.append((at, n, at - before))
            seen[line] = at
        at += n + 1
    found.sort()
    out, end = [], 0
    for begin, length, back in found:
        if begin >= end:
            out += [(b, min(MAX_COPY, begin + length - b), back) for b in range(begin, begin + length, MAX_COPY)]
            end = begin + length
    return out


def _put_pixels(w: Writer, samples: bytes, width: int, main: bool, alpha: int = 255) -> None:
    """Green samples as an entropy-coded image without colour cache; all other channels are fixed."""
    w.put(0, 2 if main else 1)
    array = np.frombuffer(samples, np.uint8)
    copies = _copies(samples) if main else []
    counts, far = np.zeros(N_LITERALS + N_LENGTHS, np.int64), np.zeros(N_DISTANCES, np.int64)
    parts, at, tokens = [], 0, []
    for begin, length, back in copies:
        parts.append(array[at:begin])
        # the neighbour to the left has a short code, all others their plain distance
        token = (prefix(length), prefix(2 if back == 1 else back + len(NEIGHBOURS)))
        tokens.append(token)
        counts[N_LITERALS + token[0][0]] += 1
        far[token[1][0]] += 1
        at = begin + length
    parts.append(array[at:])
    for part in parts:
        counts[:256] += np.bincount(part, minlength=256)
    if np.count_nonzero(counts) < 2:  # keep two symbols, so that the code has bits
        counts[1 if counts[0] else 0] += 1
    lengths, far_lengths = code_lengths(counts), code_lengths(far)
    put_code(w, lengths)
    for fixed in (0, 0, alpha):
        one = np.zeros(256, np.int64)
        one[fixed] = 1
        put_code(w, one)
    put_code(w, far_lengths)
    own, far_codes = codes(lengths), codes(far_lengths)
    far_bits = far_lengths if np.count_nonzero(far_lengths) > 1 else np.zeros_like(far_lengths)
    for i, part in enumerate(parts):
        w.many(own[part], lengths[part])
        if i < len(tokens):
            (s, extra, n), (d, d_extra, d_n) = tokens[i]
            w.put(int(own[N_LITERALS + s]), int(lengths[N_LITERALS + s]))
            w.put(extra, n)
            w.put(int(far_codes[d]), int(far_bits[d]))
            w.put(d_extra, d_n)


def _table_pixels(w: Writer, table: list[int]) -> None:
    """A palette of opaque greys, as differences."""
    w.put(0, 1)
    steps = np.diff([0, *table]) & 255
    alpha = np.array([255] + [0] * (len(table) - 1))
    every = [code_lengths(np.bincount(v, minlength=s)) for v, s in ((steps, N_LITERALS + N_LENGTHS), (steps, 256), (steps, 256), (alpha, 256))]
    for lengths in every:
        put_code(w, lengths)
    put_code(w, np.zeros(N_DISTANCES, np.int64))
    bits = [x if np.count_nonzero(x) > 1 else np.zeros_like(x) for x in every]
    values = [codes(x) for x in every]
    for step, a in zip(steps.tolist(), alpha.tolist(), strict=True):
        for k, v in enumerate((step, step, step, a)):
            w.put(int(values[k][v]), int(bits[k][v]))


def shape(n: int, row: int) -> tuple[int, int]:
    """(width, height) for n samples, rows of a multiple of row samples."""
    width = row * max(1, -(-n // (row * MAX_SIDE)))
    while n % width:
        width += row
    if width > MAX_SIDE:
        raise ValueError(f"{n} samples don't fit into one image")
    return width, n // width


def _entropy(samples: np.ndarray) -> float:
    """Bits of a sample, coded one by one."""
    share = np.bincount(samples, minlength=256) / max(1, len(samples))
    share = share[share > 0]
    return float(-(share * np.log2(share)).sum())


def _put_left_predictor(w: Writer) -> None:
    """The predictor transform with one mode for all blocks, the sample to the left."""
    w.put(1 | (0 << 1) | (7 << 3), 6)
    w.put(0, 1)
    for symbol, size in ((1, N_LITERALS + N_LENGTHS), (0, 256), (0, 256), (255, 256), (0, N_DISTANCES)):
        one = np.zeros(size, np.int64)
        one[symbol] = 1
        put_code(w, one)


def encode(samples: bytes, row: int) -> bytes:
    """Samples as the green channel of a lossless WebP image.

    Few distinct samples become a palette of bundled indices; others are predicted from the left
    where what is left to say takes fewer bits.
    """
    width, height = shape(len(samples), row)
    w = Writer()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    distinct = np.flatnonzero(np.bincount(np.frombuffer(samples, np.uint8), minlength=256)).tolist()
    if len(distinct) <= 16:
        w.put(1 | (3 << 1) | ((len(distinct) - 1) << 3), 11)
        _table_pixels(w, distinct)
        bundle = 3 if len(distinct) <= 2 else 2 if len(distinct) <= 4 else 1
        each, coded = 8 >> bundle, (width + (1 << bundle) - 1) >> bundle
        index = np.zeros(256, np.int64)
        index[distinct] = np.arange(len(distinct))
        rows = np.zeros((height, coded << bundle), np.int64)
        rows[:, :width] = index[np.frombuffer(samples, np.uint8)].reshape(height, width)
        packed = (rows.reshape(height, coded, -1) << (each * np.arange(1 << bundle))).sum(axis=2)
        samples, width = packed.astype(np.uint8).tobytes(), coded
        alpha = 255
    else:
        image = np.frombuffer(samples, np.uint8).reshape(height, width)
        rest = image.copy()
        rest[:, 1:] -= image[:, :-1]
        rest[1:, 0] -= image[:-1, 0]
        alpha = 255
        if _entropy(rest.ravel()) < 0.9 * _entropy(image.ravel()):
            _put_left_predictor(w)
            # the first prediction is opaque black, so nothing is left of the other channels
            samples, alpha = rest.tobytes(), 0
    w.put(0, 1)
    _put_pixels(w, samples, width, True, alpha)
    stream = b"\x2f" + w.bytes()
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad
