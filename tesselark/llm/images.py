"""Copies of images, cropped or edited ones too, by local descriptors.

Corners are found at several scales; each gets the direction of its surroundings and a
string of binary intensity tests turned to that direction. Descriptors that agree in one of
the bands of their bits meet in a table; those of few differing bits are matches. Matches of two
images vote for a turn, a zoom and a shift, and images are linked when enough matches
agree on one.

Images are gray arrays, PGM or PPM files (binary Netpbm): formats that need no decoder.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, discard, map_text, stored
from .components import components

LEVELS = 3
ZOOM = 1.5
#: Corners of a level are this far apart (pixels of the level).
APART = 12
#: Half the side of the patch that is described.
PATCH = 12
BITS, BANDS = 128, 4
#: Matches differ in at most so many bits.
MOST_BITS = 16
#: Pairs of descriptors that are compared in one step.
BLOCK = 1 << 16
#: Matches whose shifts are counted in one step.
MATCHES = 1 << 20
#: Images of at most about so many corners are a block; pairs of images are looked for in a pair of blocks at a time.
BLOCK_CORNERS = 1 << 19
#: Smaller tables are cut in up to so many blocks of this many corners, for several tasks to work on.
LEAST_BLOCKS, LEAST_CORNERS = 6, 1 << 16
#: Corners that are sent to tasks in one step, if that is more than each of them twice.
SENT = 1 << 22
#: Meetings of images in buckets that are counted in one step.
MEETINGS = 1 << 20
#: Images whose comparisons with others are counted together, at most.
MOST_CALLS = 1 << 12
#: Pairs of images with more pairs of corners are compared alone.
LONG = 1 << 19
#: Images are linked at this many agreeing matches, and this share of the corners of the one with fewer.
LEAST_VOTES, LEAST_SHARE = 5, 0.25
#: Images with a side under this get an edge around them and closer corners, so that short ones have enough.
SMALL = 6 * PATCH
#: Bins of the shift in pixels and of the turn in degrees.
SHIFT_BIN, TURN_BIN = 12.0, 30.0
#: Characters of a line when text is drawn.
LINE = 72

_rng = np.random.default_rng(5)
_TESTS = np.clip(np.round(_rng.normal(0, PATCH / 2.5, (BITS, 4))), -PATCH * 0.7, PATCH * 0.7)
_GRID = np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1]
_DISC = (_GRID[0] ** 2 + _GRID[1] ** 2 <= PATCH**2).astype(float)


def read_netpbm(data: bytes | None) -> np.ndarray | None:
    """Gray values of a binary PGM or PPM (P5, P6; 8 bits); None for anything else."""
    m = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d{1,6})\s+(\d{1,6})\s+(\d{1,3})\s", data or b"")
    if not m:
        return None
    width, height, planes = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
    raw = data[m.end() :]
    if not width or not height or len(raw) < width * height * planes:
        return None
    pixels = np.frombuffer(raw, np.uint8, width * height * planes)
    return pixels.reshape(height, width) if planes == 1 else pixels.reshape(height, width, planes).mean(axis=2)


def write_pgm(gray: np.ndarray) -> bytes:
    shades = gray if gray.dtype == np.uint8 else np.clip(np.round(gray), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % gray.shape[::-1] + shades.tobytes()


def drawn(text: str) -> bytes:
    """Text as an image: a cell of 2 x 2 pixels for each character, shaded by the character."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    rows = max(1, -(-len(code) // LINE))
    cells = np.zeros(rows * LINE, np.int64)
    cells[: len(code)] = code * 2654435761 >> 8
    cells = cells.astype(np.uint16).reshape(rows, LINE)
    image = np.empty((rows, 2, LINE, 2), np.uint8)
    for k, shift in enumerate((0, 3, 6, 9)):
        image[:, k // 2, :, k % 2] = (cells >> shift & 3) * 85
    return write_pgm(image.reshape(rows * 2, LINE * 2))


def _box(a: np.ndarray, width: int) -> np.ndarray:
    """Sums over squares of side 5 that begin at each pixel; ``a`` holds rows of this width after one another."""
    for step in (1, width):
        two = a[:-step] + a[step:]
        total = two[: len(a) - 4 * step] + two[2 * step : len(a) - 2 * step]
        total += a[4 * step :]
        a = total
    return a


def _highest(a: np.ndarray, side: int, width: int) -> np.ndarray:
    """Maxima over squares of the given side that begin at each pixel; by maxima over sides of powers of two."""
    for pixel in (1, width):
        have = 1
        while have < side:
            step = min(have, side - have)
            a = np.maximum(a[: -step * pixel], a[step * pixel :])
            have += step
    return a


def _true(flags: np.ndarray) -> np.ndarray:
    """Where few of many flags are true: eight are looked at together."""
    if len(flags) < 1 << 13:
        return flags.nonzero()[0]
    whole = len(flags) // 8 * 8
    words = flags[:whole].view(np.uint64)
    word = (words != 0).nonzero()[0]
    at = words[word].view(bool).nonzero()[0]
    eighth = at >> 3
    at += (word[eighth] - eighth) << 3
    return at if whole == len(flags) else np.concatenate([at, flags[whole:].nonzero()[0] + whole])


#: Images of one width are stacked, so many pixels at a time (or one image).
STACK = 1 << 18


class _Stack:
    """Images of one width under each other, as one row of pixels; each with ``pad`` more pixels on every side, like the edge's.

    A step adds or compares stretches of that row, so it is a few operations for all images at once. What it makes of
    pixels of two images or of two ends of a line is not used.
    """

    def __init__(self, lines: np.ndarray, which: np.ndarray, heights: np.ndarray, columns: np.ndarray | None, pad: int):
        """Of an array of lines, those numbered ``which``: ``heights`` tells how many are each image's. Of lines, ``columns`` or all."""
        self.heights, self.pad = heights + 2 * pad, pad
        self.first = np.cumsum(self.heights) - self.heights
        inside = np.arange(self.heights.sum()) - np.repeat(self.first + pad, self.heights)
        inside = np.clip(inside, 0, np.repeat(heights - 1, self.heights)) + np.repeat(np.cumsum(heights) - heights, self.heights)
        inside = which[inside]
        self.width = (lines.shape[1] if columns is None else len(columns)) + 2 * pad
        pixels = np.empty((len(inside), self.width), np.float32)
        pixels[:, pad:-pad] = lines[inside] if columns is None else lines[inside].take(columns, axis=1)
        pixels[:, :pad], pixels[:, -pad:] = pixels[:, pad, None], pixels[:, -pad - 1, None]
        self.pixels = pixels.ravel()

    def smoothed(self) -> np.ndarray:
        """Means over squares of side 3, as lines without pads."""
        a, w, pad = self.pixels, self.width, self.pad
        p = a[: -2 * w] + a[w:-w]
        p += a[2 * w :]
        out = np.empty(len(a), np.float32)
        mean = out[w + 1 : -w - 1]
        np.add(p[:-2], p[1:-1], out=mean)
        mean += p[2:]
        mean /= np.float32(9)
        own = np.concatenate([np.arange(b + pad, b + h - pad) for b, h in zip(self.first, self.heights)])
        return out.reshape(-1, w)[own, pad:-pad]

    def corners(self, apart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Means over squares of side 5, and of every corner its image's number, its row and its column; these leave out two pixels of the pad."""
        w, margin = self.width, PATCH - 3
        s = _box(self.pixels, w)
        s /= np.float32(25)
        gy, gx = s[2 * w + 1 : -1] - s[1 : -2 * w - 1], s[w + 2 : -w] - s[w : -w - 2]
        sums = []
        for u, v in ((gx, gx), (gy, gy), (gx, gy)):
            product = u * v
            product /= np.float32(100)
            sums.append(_box(product, w))
        xx, yy, xy = sums
        # Around the places that have a neighbourhood (they begin three pixels in) nothing is higher than any corner.
        reach = apart * (w + 1)
        rivals = np.full(len(self.pixels) + 2 * reach, -np.inf, np.float32)
        corner = rivals[reach : reach + len(xx)]
        np.multiply(xx, yy, out=corner)
        xy *= xy
        corner -= xy
        xx += yy
        np.multiply(xx, np.float32(0.05), out=yy)
        yy *= xx
        corner -= yy
        lines = rivals[reach:-reach].reshape(-1, w)
        lines[:, -10:] = -np.inf
        ends = self.first + self.heights
        lines[(ends[:, None] - np.arange(1, 11)).ravel()] = -np.inf
        found = corner >= _highest(rivals, 2 * apart + 1, w)[: len(corner)]
        found &= corner > 1.0
        y, x = np.divmod(_true(found), w)
        image = np.searchsorted(self.first, y, "right") - 1
        y -= self.first[image]
        # A corner has a whole patch around it; its rivals lie up to ``apart`` away, as far as corners can lie.
        inner = (y >= margin) & (y < self.heights[image] - 10 - margin) & (x >= margin) & (x < w - 10 - margin)
        return s, image[inner], y[inner] + 3, x[inner] + 3


def _corners(grays: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of images of one width, small or not: each level, its smoothed pixels in lines of a width, and of its corners the image, the place among the pixels, the row and the column (outside of the image in an edge put around it).

    A small image has corners up to its sides, and closer ones: those of a larger image of the same content are among them.
    """
    heights, width = np.array([len(g) for g in grays]), grays[0].shape[1]
    small = min(*grays[0].shape) < SMALL
    edge, apart = (PATCH, APART // 2) if small else (0, APART)
    lines = np.concatenate(grays)
    stack = _Stack(lines, np.arange(len(lines)), heights, None, edge + 2)
    smooth = stack.smoothed()
    begin = np.cumsum(heights) - heights
    members = np.arange(len(grays))
    for level in range(LEVELS):
        if level:
            by = ZOOM**level
            rows, columns = (np.minimum((np.arange(max(1, int(n / by))) * by).astype(int), n - 1) for n in (int(heights.max()), width))
            lower = np.maximum(1, (heights[members] / by).astype(int))
            enough = np.minimum(lower, len(columns)) + 2 * edge >= 2 * PATCH + 2
            members, lower = members[enough], lower[enough]
            if not len(members):
                return
            which = np.concatenate([b + np.minimum(rows[:n], h - 1) for b, n, h in zip(begin[members], lower, heights[members])])
            stack = _Stack(smooth, which, lower, columns, edge + 2)
        elif min(*grays[0].shape) + 2 * edge < 2 * PATCH + 2:
            return
        s, image, y, x = stack.corners(apart)
        yield level, s, stack.width, members[image], (stack.first[image] + y) * stack.width + x, y - edge, x - edge


_LINES = np.arange(-PATCH, PATCH + 1)
_MOMENTS = (np.stack([_GRID[0], _GRID[1]]) * _DISC).reshape(2, -1).T.astype(np.float32)
#: Corners are described in groups of at most so many.
GROUP = 2000


def _strings(pixels: np.ndarray, base: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles and descriptors of the corners at places ``base`` of concatenated images of these widths."""
    # A patch is so many stretches of pixels.
    stretches = np.lib.stride_tricks.sliding_window_view(pixels, 2 * PATCH + 1)
    patch = stretches[base[:, None] + width[:, None] * _LINES - PATCH]
    moment = patch.reshape(len(base), -1) @ _MOMENTS
    angle = np.arctan2(moment[:, 0], moment[:, 1])
    c, n = np.cos(angle)[:, None], np.sin(angle)[:, None]
    dy, dx = (np.concatenate([_TESTS[:, k], _TESTS[:, k + 2]]).astype(np.float32) for k in (0, 1))
    down, right = n * dx, c * dx
    down += c * dy
    right -= n * dy
    at = np.rint(down, out=down).astype(np.int64)
    at *= width[:, None]
    at += np.rint(right, out=right).astype(np.int32)
    at += base[:, None]
    value = pixels.take(at)
    bits = value[:, :BITS] < value[:, BITS:]
    return np.degrees(angle), np.packbits(bits, axis=1, bitorder="little").view("<u4")


def describe(images: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All images' corners: which image, their place as one number, and their descriptors (BANDS numbers of 32 bits).

    A place holds the row and column in pixels of the level, the angle in twelfths of a degree and the level.
    """
    owners, places, strings = [[np.zeros(0, np.int64)] for _ in range(2)] + [[np.zeros((0, BANDS), np.uint32)]]
    parts: list[tuple] = []

    def work() -> None:
        pixels = np.concatenate([p[0] for p in parts])
        starts = np.cumsum([0] + [len(p[0]) for p in parts])
        owner, level, base, width, y, x = (
            np.concatenate(v) for v in zip(*((owner, np.full(len(y), level), at + base, np.full(len(y), width), y, x) for (_, owner, level, base, width, y, x), at in zip(parts, starts)))
        )
        for b in range(0, len(base), GROUP):
            g = slice(b, b + GROUP)
            angle, d = _strings(pixels, base[g], width[g])
            turn = np.rint(angle * 12).astype(np.int64) % 4320
            owners.append(owner[g])
            places.append(((level[g] << 13 | turn) << 20 | y[g]) << 20 | x[g])
            strings.append(d)
        parts.clear()

    alike: dict[tuple[int, bool], list[int]] = {}
    for i, gray in enumerate(images):
        if gray is not None:
            alike.setdefault((gray.shape[1], min(gray.shape) < SMALL), []).append(i)
    held = 0
    for numbers in alike.values():
        ends = np.cumsum([images[i].size for i in numbers])
        cut = 0
        while cut < len(numbers):
            begin, cut = cut, max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + STACK, "right")))
            stacked = np.array(numbers[begin:cut])
            for level, s, width, image, base, y, x in _corners([images[i] for i in stacked]):
                if len(y):
                    parts.append((s, stacked[image], level, base, width, y, x))
                    held += len(y)
            if held >= GROUP:
                work()
                held = 0
    if parts:
        work()
    owner, place, d = np.concatenate(owners), np.concatenate(places), np.concatenate(strings)
    order = np.argsort(owner, kind="stable")
    return owner[order], place[order], d[order]


#: Images are described so many bytes at a time.
SLICE = 2 << 20


def descriptors(images: DataFrame, key: str, image: str, as_bytes: bool = False, draw: bool = False) -> DataFrame:
    """Rows (image, same, points): a digest of every file and its described corners, (at, lo, hi) each; (image, same, n, data) as ``packed`` has them.

    One pass, in which no image is moved; to ``draw``, the column holds texts, each drawn in this pass. Corners are none for what can't be read; the digest of null is null.
    """
    kind = images.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = _drawings(batch.column(1)) if draw else batch.column(1).to_pylist()
        same = [None if f is None else hashlib.sha256(f).digest() for f in files]
        first: dict[bytes, int] = {}
        which = [first.setdefault(d, i) if d is not None else i for i, d in enumerate(same)]
        owner, place, d = describe([read_netpbm(f) if which[i] == i else None for i, f in enumerate(files)])
        begin, end = np.searchsorted(owner, which), np.searchsorted(owner, which, "right")
        if as_bytes:
            pairs = d.view("<i8")
            data = [_pack(place[b:e], pairs[b:e]) for b, e in zip(begin, end)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(end - begin, pa.int64()), pa.array(data, pa.binary())], names=["image", "same", "n", "data"])
        take = np.concatenate([np.arange(b, e) for b, e in zip(begin, end)]) if len(which) else np.zeros(0, int)
        halves = np.ascontiguousarray(d).view("<i8").reshape(-1, 2)[take]
        point = pa.StructArray.from_arrays([pa.array(place[take]), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["at", "lo", "hi"])
        points = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)), point)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), points], names=["image", "same", "points"])

    return map_text(images.select(col(key), col(image)), run, f"image {kind}, same binary, " + ("n long, data binary" if as_bytes else "points array<struct<at:bigint,lo:bigint,hi:bigint>>"), limit=SLICE // 4 if draw else SLICE)


def _places(at: np.ndarray) -> tuple[np.ndarray, ...]:
    """What places hold: x and y in pixels of the image, the angle in degrees, the level."""
    level = at >> 53
    zoom = ZOOM ** level.astype(float)
    return (at & 0xFFFFF) * zoom, (at >> 20 & 0xFFFFF) * zoom, (at >> 40 & 0x1FFF) / 12, level


def _same(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct descriptors, and the rows that have each: rows in order, and where those of a descriptor begin."""
    order = np.lexsort((d[:, 1], d[:, 0]))
    new = np.r_[True, (d[order[1:]] != d[order[:-1]]).any(axis=1)]
    begin = np.flatnonzero(new)
    return d[order[begin]], order, np.r_[begin, len(order)]


def _votes(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> int:
    """The most descriptors of one image (places, and descriptors as pairs of 64 bits) whose matches on the other agree on a turn, a zoom and a shift.

    Equal descriptors of an image are compared once. Matches are counted in steps of at most MATCHES (and those of one descriptor),
    so an image that repeats itself takes time but no more memory.
    """
    if min(len(one[0]), len(two[0])) == 0:
        return 0
    rows, columns = [], []
    # A signed number's bits would be counted after its sign is dropped.
    (mine, left, at1), (other, right, at2) = (_same(d.view(np.uint64)) for _, d in (one, two))
    # Blocks that stay in a processor's cache. Descriptors that differ in few bits do so in their first halves, which settle almost all.
    step = max(1, BLOCK // len(other))
    first = other[:, 0].copy()
    for begin in range(0, len(mine), step):
        near = np.bitwise_count(mine[begin : begin + step, :1] ^ first) <= MOST_BITS
        i, k = np.divmod(np.flatnonzero(near), len(first))
        rows.append(i + begin)
        columns.append(k)
    i, k = np.concatenate(rows), np.concatenate(columns)
    differ = np.bitwise_count(mine[i, 0] ^ other[k, 0]) + np.bitwise_count(mine[i, 1] ^ other[k, 1])
    i, k = i[differ <= MOST_BITS], k[differ <= MOST_BITS]
    many = np.diff(at1)
    if many[np.unique(i)].sum() < LEAST_VOTES:
        return 0
    # Every row of ``one`` with a match, and its matches: those of its descriptor (i is in order).
    size = np.diff(at2)[k]
    total = np.bincount(i, weights=size, minlength=len(mine)).astype(np.int64)
    of = np.repeat(np.arange(len(mine)), many)  # descriptor of each of ``left``
    keep = total[of] > 0
    rows_of, of = left[keep], of[keep]
    cuts = [0]
    ends = np.cumsum(total[of])
    while cuts[-1] < len(of):
        done = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, done + MATCHES, "right"))))
    begin = np.searchsorted(i, np.arange(len(mine) + 1))
    found: list[dict] = [{}, {}]
    for b, e in zip(cuts, cuts[1:]):
        # Pairs of descriptors of these rows, then their rows in ``two``.
        n = np.diff(begin)[of[b:e]]
        pair = np.repeat(begin[of[b:e]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(rows_of[b:e], n)
        m = size[pair]
        q = right[np.repeat(at2[k[pair]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        for half, counts in enumerate(_shifts(one[0], two[0], np.repeat(p, m), q)):
            if e == len(of) and not b:
                found[half] = {0: int(counts[1].max())}
            else:
                for x, v in zip(*map(np.ndarray.tolist, counts)):
                    found[half][x] = found[half].get(x, 0) + v
    return max(max(f.values()) for f in found)


def _shifts(here: np.ndarray, there: np.ndarray, i: np.ndarray, k: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bins of turn, zoom and shift of matches (i of one image, k of the other), each with the number of rows i that vote for it; on two grids."""
    (px, py, pa, pl), (qx, qy, qa, ql) = _places(here[i]), _places(there[k])
    out = []
    for bins in _bins(px, py, qx, qy, _turns(pa, qa), pl - ql):
        bins, at = np.unique(bins, return_inverse=True)
        votes = np.unique(at * len(here) + i) // len(here)  # a descriptor votes once for a bin
        out.append((bins, np.bincount(votes)))
    return out


def _turns(pa: np.ndarray, qa: np.ndarray) -> np.ndarray:
    """Bins of the turn between two angles in degrees."""
    return np.rint((pa - qa) / TURN_BIN) % round(360 / TURN_BIN)


def _bins(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray, turn: np.ndarray, zoom: np.ndarray) -> Iterator[np.ndarray]:
    """Bins of turn, zoom and shift of matches between places, as numbers; of two grids."""
    # Where the image's origin lies on the other, for the match's turn (as its bin) and zoom.
    scale, a = ZOOM**-zoom.astype(float), np.radians(turn * -TURN_BIN)
    ox = qx - scale * (np.cos(a) * px - np.sin(a) * py)
    oy = qy - scale * (np.sin(a) * px + np.cos(a) * py)
    kind = (turn * (2 * LEVELS) + zoom + LEVELS).astype(np.int64) << 48
    for half in (0.0, 0.5):  # half a bin apart, so that a shift near an edge of one is inside the other
        bx, by = (np.floor(o / SHIFT_BIN + half).astype(np.int64) + (1 << 23) for o in (ox, oy))
        yield kind | bx << 24 | by


def _pack(at: np.ndarray, d: np.ndarray) -> bytes:
    """An image's corners: 24 bytes each, all first bytes first, so that those of places, mostly zero, lie together."""
    return np.column_stack([at, d]).astype("<i8").view(np.uint8).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    """Rows (at, lo, hi) of an image's corners."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(24, -1).T).view("<i8")


def packed(points: DataFrame) -> DataFrame:
    """Rows (image, n, data) of images' (image, points): the number of their corners, and these as bytes; without images that have none."""
    kind = points.schema["image"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("points")
            ends = column.offsets.to_numpy()
            at, lo, hi = (column.values.field(c).to_numpy() for c in ("at", "lo", "hi"))
            d = np.stack([lo, hi], axis=1)
            data = [_pack(at[b:e], d[b:e]) for b, e in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("image"), pa.array(np.diff(ends), pa.int64()), pa.array(data, pa.binary())], names=["image", "n", "data"])

    return points.where(F.size("points") > 0).select("image", "points").mapInArrow(run, f"image {kind}, n long, data binary")


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)


def _lengths(starts: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.r_[starts, total])


class _Task:
    """The images of a block, or of two (side 0 and 1), numbered in the order of side and key; their classes as far as known.

    Of two blocks, only images of different ones make pairs. The first image of a pair has the greater number.
    """

    def __init__(self, table: pa.Table):
        there = pc.is_valid(table["data"])
        rows = table.filter(there)
        keys, sides, data = (rows[c].to_pylist() for c in ("image", "side", "data"))
        first: dict = {}
        for i, key in enumerate(keys):
            first.setdefault(key, i)
        order = sorted(first.values(), key=lambda i: (sides[i], keys[i]))
        self.images = rows["image"].combine_chunks().take(pa.array(order, pa.int64()))
        number = {keys[i]: k for k, i in enumerate(order)}
        self.rank = np.empty(len(order), np.int64)
        self.rank[sorted(range(len(order)), key=lambda k: keys[order[k]])] = np.arange(len(order))
        self.crossed = pc.max(table["side"]).as_py() == 1
        self.second = sum(sides[i] == 0 for i in order)
        self.size = np.array([len(data[i]) // 24 for i in order], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        corners = np.concatenate([_unpack(data[i]) for i in order])
        self.at, self.d = corners[:, 0].copy(), corners[:, 1:].copy()
        self.lo, self.hi = (np.ascontiguousarray(self.d[:, c]).view(np.uint64) for c in (0, 1))
        # Where two descriptors' bits differ in one half only, their folded ones differ too; those of a match differ in no more bits than it, those of few others do.
        self.folded = self.lo ^ self.hi
        self.x, self.y, self.angle, self.level = _places(self.at)
        # A class is named by its first image here.
        self.root = np.arange(len(order))
        known, name = table.filter(pc.invert(there)), {}
        for image, root in zip(*(known[c].to_pylist() for c in ("image", "root"))):
            self.root[number[image]] = name.setdefault(root, number[image])

    def buckets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Images, bucket after bucket, how often each is in it, and where buckets begin; those that hold a pair."""
        owner = np.repeat(np.arange(len(self.size)), self.size)
        found = []
        for word in ((c >> np.uint64(shift)) & np.uint64(0xFFFFFFFF) for c in (self.lo, self.hi) for shift in (0, 32)):
            both = np.sort((word << np.uint64(31) | np.arange(len(owner), dtype=np.uint64)).view(np.int64))
            bits, image = both >> 31, owner[both & ((1 << 31) - 1)]
            at = np.flatnonzero(np.r_[True, (bits[1:] != bits[:-1]) | (image[1:] != image[:-1])])
            n, bits, image = _lengths(at, len(bits)), bits[at], image[at]
            starts = _starts(bits)
            size = _lengths(starts, len(bits))
            several = size > 1
            if self.crossed:
                several = (image[starts] < self.second) & (image[starts + size - 1] >= self.second)
            keep = np.repeat(several, size)
            found.append((image[keep], n[keep], size[several]))
        image, n, size = (np.concatenate(x) for x in zip(*found))
        return image, n, np.cumsum(size) - size

    def still_open(self, image: np.ndarray, n: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of several classes."""
        if not len(image):
            return image, n, starts
        size, root = _lengths(starts, len(image)), self.root[image]
        several = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        keep, size = np.repeat(several, size), size[several]
        return image[keep], n[keep], np.cumsum(size) - size

    def enough(self, row: np.ndarray, other: np.ndarray, n: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs whose ``n`` add up to as many bands as a link needs; of different classes, or every one."""
        keep = np.flatnonzero(row != other if every else self.root[row] != self.root[other])
        pair, n = row[keep].astype(np.int64), n[keep]
        pair *= len(self.size)
        pair += other[keep]
        more = np.flatnonzero(n > 1)
        pair = np.concatenate([pair, np.repeat(pair[more], np.minimum(n[more], LEAST_VOTES) - 1)])
        pair.sort()
        last = pair[LEAST_VOTES - 1 :]
        last = last[last == pair[: len(last)]]
        return np.divmod(last[_starts(last)], len(self.size))

    def stars(self, image: np.ndarray, n: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a bucket's images with its first one; of two blocks, with the first one of the other block."""
        size = _lengths(starts, len(image))
        centre = np.repeat(starts, size)
        keep = np.arange(len(image)) != centre  # a pair of both first ones counts once
        if self.crossed:
            middle = starts + np.add.reduceat((image < self.second).astype(np.int64), starts) if len(starts) else starts
            centre = np.where(image < self.second, np.repeat(middle, size), centre)
        image, centre, n = image[keep], image[centre[keep]], np.maximum(n[keep], n[centre[keep]])
        return self.enough(np.maximum(image, centre), np.minimum(image, centre), n, False)

    def meetings(self, image: np.ndarray, n: np.ndarray, starts: np.ndarray, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs that share enough bands, step by step: those of some first images, with at most MEETINGS meetings (or one image's)."""
        if not len(image):
            return
        size = _lengths(starts, len(image))
        begin = np.repeat(starts, size)
        if self.crossed:  # the second block's images meet the first block's
            before = np.repeat(np.add.reduceat((image < self.second).astype(np.int64), starts), size)
            many = np.where(image < self.second, 0, before)
        else:
            many = np.arange(len(image)) - begin
        rows = np.argsort(image, kind="stable")
        rows = rows[many[rows] > 0]
        done = np.cumsum(many[rows])
        ends = np.r_[_starts(image[rows])[1:], len(rows)]  # of an image's rows
        cut = 0
        while cut < len(rows):
            least = np.searchsorted(ends, cut, "right")
            most = np.searchsorted(done[ends - 1], (done[cut - 1] if cut else 0) + MEETINGS, "right") - 1
            r = rows[cut : (cut := ends[max(least, most)])]
            one = np.repeat(r, many[r])
            two = np.arange(len(one)) + np.repeat(begin[r] - np.cumsum(many[r]) + many[r], many[r])
            yield self.enough(image[one], image[two], np.maximum(n[one], n[two]), every)

    def links(self, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Links (a, b, votes) by number: all, or as many as join the images into their classes; a copy is then compared with few others."""
        found = self.buckets()
        if not every:
            yield from self.joined(*self.stars(*found))
            found = self.still_open(*found)
        for row, other in self.meetings(*found, every):
            if every:
                yield self.judged(row, other)
                continue
            # An image's first pair, then two more, four more: those within a class that was found meanwhile drop out.
            starts = _starts(row)
            turn = np.arange(len(row)) - np.repeat(starts, _lengths(starts, len(row)))
            turn = np.frexp(turn + 1)[1]
            for k in range(1, turn.max(initial=0) + 1):
                now = (turn == k) & (self.root[row] != self.root[other])
                yield from self.joined(row[now], other[now])

    def joined(self, row: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        a, b, votes = self.judged(row, other)
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.root[x], self.root[y]
            if x != y:
                self.root[self.root == max(x, y)] = min(x, y)
        yield a, b, votes

    def judged(self, row: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The links among pairs: the image of the greater key, the other, and ``_votes`` of these."""
        swap = self.rank[row] < self.rank[other]
        need = np.maximum(LEAST_VOTES, np.ceil(LEAST_SHARE * np.minimum(self.size[row], self.size[other]))).astype(np.int64)
        votes = np.zeros(len(row), np.int64)
        area = self.size[row] * self.size[other]
        for p in np.flatnonzero(area > LONG).tolist():
            one, two = (slice(self.begin[x], self.begin[x] + self.size[x]) for x in ((other[p], row[p]) if swap[p] else (row[p], other[p])))
            if self.may_vote(one, two, need[p]):
                votes[p] = _votes((self.at[one], self.d[one]), (self.at[two], self.d[two]))
        # The other pairs come in the order of ``row``: an image is compared with several at once.
        short = np.flatnonzero(area <= LONG)
        starts = _starts(row[short])
        held, parts = 0, []
        for b, e in zip(starts.tolist(), [*starts.tolist()[1:], len(short)]):
            last = e == len(short)
            while b < e:
                few = short[b:e]
                if len(few) > 1:
                    few = few[: max(1, int(np.searchsorted(np.cumsum(area[few]), 2 * LONG, "right")))]
                parts.append((few, *self.near(int(row[few[0]]), other[few].tolist())))
                held += len(parts[-1][1])
                b += len(few)
            if held > MATCHES // 4 or len(parts) > MOST_CALLS or last:
                pair, i, k = self.matched(parts, row, other)
                self.count(pair, np.where(swap[pair], k, i), np.where(swap[pair], i, k), need, votes)
                held, parts = 0, []
        keep = votes >= need
        return np.where(swap, other, row)[keep], np.where(swap, row, other)[keep], votes[keep]

    def near(self, row: int, others: list[int]) -> tuple[np.ndarray, int, bool]:
        """Where an image's folded descriptors, and those of others after one another, differ in few bits: places in a table, its width, and whether its lines are the others'."""
        mine = self.folded[self.begin[row] : self.begin[row] + self.size[row]]
        theirs = [self.folded[self.begin[x] : self.begin[x] + self.size[x]] for x in others]
        theirs = np.concatenate(theirs) if len(theirs) > 1 else theirs[0]
        turned = len(mine) > len(theirs)  # long lines are compared faster
        return *self.close(*((theirs, mine) if turned else (mine, theirs))), turned

    def matched(self, parts: list[tuple[np.ndarray, np.ndarray, int, bool]], row: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches of what ``near`` found for pairs: the pairs, the rows' corners and the others'."""
        pairs, found, width, turned = zip(*parts)
        many = [len(x) for x in found]
        line, column = np.divmod(np.concatenate(found), np.repeat(width, many))
        turned = np.repeat(turned, many)
        i, of = np.where(turned, column, line), np.where(turned, line, column)
        pairs = np.concatenate(pairs)
        size = self.size[other[pairs]]
        ends = np.cumsum(size)
        calls = np.cumsum([len(x[0]) for x in parts])
        before = np.r_[0, ends[calls[:-1] - 1]]
        of += np.repeat(before, many)
        which = np.searchsorted(ends, of, "right")
        pair = pairs[which]
        i += self.begin[row[pair]]
        k = of + (self.begin[other[pairs]] + size - ends)[which]
        keep = self.alike(i, k)
        return pair[keep], i[keep], k[keep]

    @staticmethod
    def close(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, int]:
        """Where folded descriptors differ in few bits: places in a table of one by two, and its width. In blocks that stay in a processor's cache."""
        found = []
        step = max(1, BLOCK // len(two))
        for b in range(0, len(one), step):
            found.append(_true((np.bitwise_count(one[b : b + step, None] ^ two) <= MOST_BITS).ravel()))
            if b:
                found[-1] += b * len(two)
        return np.concatenate(found) if len(found) > 1 else found[0], len(two)

    def alike(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Which of these pairs of corners match."""
        return np.bitwise_count(self.lo[i] ^ self.lo[k]) + np.bitwise_count(self.hi[i] ^ self.hi[k]) <= MOST_BITS

    def may_vote(self, one: slice, two: slice, need: int) -> bool:
        """Whether so many corners of the first image have a match on the other at all; it ends as soon as that is settled."""
        voted = np.zeros(one.stop - one.start, bool)
        step = max(1, LONG // len(voted))
        for b in range(two.start, two.stop, step):
            k, i = np.divmod(*self.close(self.folded[b : min(b + step, two.stop)], self.folded[one]))
            voted[i[self.alike(i + one.start, k + b)]] = True
            if np.count_nonzero(voted) >= need:
                return True
        return False

    def count(self, pair: np.ndarray, i: np.ndarray, k: np.ndarray, need: np.ndarray, votes: np.ndarray) -> None:
        """Puts the pairs' votes, where they are as many as needed: corners i of one image, the voters, with matches k on the other."""

        def may(group: np.ndarray) -> np.ndarray:
            """Whether each match's group (of its pair) has as many voters as the pair needs."""
            order = np.lexsort((i, group))
            starts = _starts(group[order])
            new = np.r_[True, np.diff(i[order]) != 0]
            new[starts] = True
            out = np.empty(len(group), np.int64)
            out[order] = np.repeat(np.add.reduceat(new.astype(np.int64), starts), _lengths(starts, len(group)))
            return out >= need[pair]

        # A pair has no more voters than matches.
        keep = np.bincount(pair, minlength=len(need))[pair] >= need[pair]
        pair, i, k = pair[keep], i[keep], k[keep]
        for by_turn in (False, True):
            if not len(pair):
                return
            group = pair
            if by_turn:
                group = (pair << 16) + (_turns(self.angle[i], self.angle[k]) * (2 * LEVELS)).astype(np.int64) + self.level[i] - self.level[k] + LEVELS
            keep = may(group)
            pair, i, k = pair[keep], i[keep], k[keep]
        if not len(pair):
            return
        for bins in _bins(self.x[i], self.y[i], self.x[k], self.y[k], _turns(self.angle[i], self.angle[k]), self.level[i] - self.level[k]):
            order = np.lexsort((i, bins, pair))
            p, b, v = pair[order], bins[order], i[order]
            bin_ = np.r_[True, (p[1:] != p[:-1]) | (b[1:] != b[:-1])]
            new = bin_ | np.r_[True, v[1:] != v[:-1]]
            np.maximum.at(votes, p[bin_], np.add.reduceat(new.astype(np.int64), np.flatnonzero(bin_)))


def _in_blocks(images: DataFrame, every: bool) -> tuple[DataFrame | None, DataFrame]:
    """Classes (node, root), unless ``every`` link is wanted, and links (a, b, votes) of ``packed`` images.

    Images are dealt to blocks of bounded size by their keys' hashes. Each block meets itself, then every other one, in a task
    that holds the two; a step of this takes each block twice, or as often as SENT allows, and its shuffle goes when its links are written. So
    memory and disk do not follow the number of pairs, though time does. Links of earlier steps tell later ones which images are of one class.
    """
    corners = images.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-corners // BLOCK_CORNERS), min(LEAST_BLOCKS, -(-corners // LEAST_CORNERS)))
    kind = images.schema["image"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        task = _Task(table)
        found = list(zip(*task.links(every)))
        a, b, votes = (np.concatenate(x) for x in found) if found else np.zeros((3, 0), np.int64)
        made = pa.table([*(task.images.take(pa.array(x)) for x in (a, b)), pa.array(votes)], names=["a", "b", "votes"])
        del task
        pa.default_memory_pool().release_unused()  # the worker lives on
        return made

    links = roots = None
    at, told = 0, 1
    while at <= blocks // 2:
        # A task for each block and distance to the other block; the half way round would come twice.
        steps = max(1, SENT // max(1, 2 * corners)) if at else 1
        far = range(at, min(at + steps, blocks // 2 + 1))
        places = []
        for k in far:
            here, there = F.col("block") + k * blocks, F.pmod(F.col("block") - k, F.lit(blocks)) + k * blocks
            half = 2 * k == blocks
            places.append(F.struct(F.when(F.lit(not half) | (F.col("block") < k), here).alias("task"), F.lit(0).alias("side")))
            if k:
                places.append(F.struct(F.when(F.lit(not half) | (F.col("block") >= k), there).alias("task"), F.lit(1).alias("side")))
        rows = images.select("image", F.lit(None).cast(kind).alias("root"), "data")
        if roots is not None:
            rows = rows.union(roots.select(F.col("node").alias("image"), "root", F.lit(None).cast("binary").alias("data")))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("image"), F.lit(blocks))).withColumn("place", F.explode(F.array(*places))).where("place.task IS NOT NULL")
        rows = rows.select("place.task", "place.side", "image", "root", "data").repartition(4 * blocks * len(far), "task")
        found = stored(rows.groupBy("task").applyInArrow(run, f"a {kind}, b {kind}, votes long"), "links")
        links = found if links is None else links.union(found)
        at = far[-1] + 1
        if not every and (at > blocks // 2 or at >= told):  # seldom, as this takes many small jobs
            told = 4 * at
            roots = components(links.select("a", "b"))
    return roots, links


def matches(points: DataFrame) -> DataFrame:
    """All links (a, b, votes): images of which enough descriptors agree on one turn, zoom and shift.

    Images are compared if they share at least as many bands as a link needs. The links of many copies are as many as their
    pairs, which is why ``classes`` doesn't call this.
    """
    return _in_blocks(stored(packed(points), "packed"), True)[1]


def classes(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (node, root) of the images linked by ``matches``' links, root the least image of a class, and the links found.

    Of a bucket in a task, every image is compared with the first one first, so that copies of one image are compared with
    one of them, not with each other. Then all images of a bucket that are still of different classes are compared,
    so that no link between classes is lost.
    """
    return _in_blocks(stored(packed(points), "packed"), False)


def image_copies(df: DataFrame, key: str = "page_id", image: str = "image", draw: bool = False) -> DataFrame:
    """One row per row of ``df``: key, n_corners, n_links (found on the way to its class, between different images), class_id.

    To ``draw``, the column holds texts, which are drawn where they are described.

    class_id is the least key of the images reachable over links. Equal files are one image: they share class and
    links, and are compared with others once. Null and unreadable images, and ones
    of one shade, have no corners and are linked with equal files only (nulls with nothing: their own key).
    A null key is passed on; equal keys of different images are one image for links (that of the least digest). An empty table gives an empty result.
    """
    described = stored(descriptors(df, key, image, True, draw), "described")
    files = stored(described.select(F.col("image").alias("key"), "same", "n"), "files")
    # The least key of equal files stands for them.
    one = files.where("same IS NOT NULL AND key IS NOT NULL").groupBy("same").agg(F.min("key").alias("rep"))
    chosen = one.groupBy("rep").agg(F.min("same").alias("same"))
    kept = described.where("n > 0").join(chosen, (described.same == chosen.same) & (described.image == chosen.rep), "left_semi")
    points = stored(kept.select("image", "n", "data"), "packed")
    discard(described)
    roots, links = _in_blocks(points, False)
    discard(points)
    degree = links.select("a").union(links.select("b")).groupBy("a").count()
    facts = chosen.join(files.groupBy("same").agg(F.max("n").alias("n_corners")), "same").select("rep", "n_corners")
    facts = facts.join(roots, facts.rep == roots.node, "left").join(degree, facts.rep == degree.a, "left")
    facts = facts.select("rep", "n_corners", F.coalesce("count", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "rep").alias("class"))
    known = files.join(one, "same", "left").join(facts, "rep", "left")
    return known.select(
        F.col("key").alias(key), F.coalesce("n_corners", F.lit(0)).cast("long").alias("n_corners"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class", "key").alias("class_id")
    )


def shown(html: Column) -> Column:
    """Pages without their tags, scripts and styles; white space is left."""
    return F.regexp_replace(html, r"(?is)<(?:(script|style)\b.*?</\1>|[^>]*>)", " ")


def _drawings(texts: pa.Array) -> list[bytes | None]:
    """Texts drawn, with single spaces between words; of bytes, ``split`` takes the white space of ASCII alone."""
    return [None if t is None else drawn(b" ".join(t.split()).decode()) for t in texts.cast(pa.binary()).to_pylist()]


def with_drawings(df: DataFrame, html: Column, key: str = "page_id") -> DataFrame:
    """Rows (key, image): the visible text of pages, drawn; a null page has a null image."""
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(_drawings(batch.column(1)), pa.binary())], names=[key, "image"])

    return map_text(df.select(col(key), shown(html).alias("text")), run, f"`{key}` {kind}, image binary")
