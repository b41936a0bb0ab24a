"""Local image descriptors: find cropped or edited copies in a media column.

An image becomes a set of keypoints, multiscale corners (Harris response over a
Gaussian pyramid), each with a 256-bit descriptor of binary brightness tests
that are turned by the corner's orientation. Two descriptors match within 32
bits. Candidates come from multi-index Hamming tables: each table keys a descriptor by
some of its bits, chosen to be balanced and little correlated on a bounded sample of
pictures (SAMPLE). Keys have as many bits as keep a slot small (they grow with the number
of keypoints), and there are as many tables as make two images with eight matches, all of
exactly 32 differing bits, meet in two of them with probability 0.9 (see tables_for).

A slot entry is (key, image, point, 128 bits of the descriptor): the Hamming distance of those
bits decides before anything wider moves, and two different points of both images must come
near. Links join images into classes, in two steps:

1. Entries of the first few tables are compared with the first of their slot. Each image is
   then compared in full with the one first image that it meets most often. This joins large
   groups of copies at the cost of one comparison an image.
2. Of every class, one entry a slot is left; entries of different classes in a slot are
   compared with each other (very common slots are dealt over several tasks), and all
   image pairs that come near are compared in full.

A full comparison takes all keypoints of both images, whether they share a key or not; the
matches vote for a similarity transform (scale, turn, shift), and enough votes for one
make a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.scratch import map_arrow, settle

#: Corners of a picture of SIDE x SIDE pixels; larger ones have more, in proportion to area.
POINTS, SIDE = 24, 64
SCALES, FACTOR, PATCH, TURNS = 3, 1.5, 12, 64
#: Matches lie within DISTANCE bits; CONSENSUS of them make a link. Keys have KEY_BITS at least;
#: tables are made for images with MATCHES matches to meet with probability RECALL.
DISTANCE, CONSENSUS, KEY_BITS, MATCHES, RECALL = 32, 6, 20, 8, 0.9
#: Bits of 128 and of 64 that the first comparisons allow: a pair at DISTANCE exceeds them with
#: probability 0.01. Tables of step 1. Pictures that keys are fitted on, at most.
NEAR, NEAR_FIRST, FIRST_TABLES, SAMPLE = 22, 14, 4, 1000
#: A slot with more than this share of all entries is dealt over PARTS tasks; first entries are
#: taken in each of PARTS parts of a slot.
COMMON, PARTS = 1e-4, 16
#: Pixels, and keypoints, that are worked on at once; rows that are decoded at once.
PIXELS, AT_ONCE, DECODED = 1 << 18, 1024, 64
#: An inlier lies within this part of the picture's longer side, and LOCAL pixels of its own
#: scale, of where the transform puts it; a match's own turn and zoom may be off by so much.
TOLERANCE, LOCAL, TURN, ZOOM = 0.02, 1.5, np.pi / 6, np.log(1.7)
CHANCE = 0.01
_rng = np.random.Generator(np.random.PCG64(41))
_SPECTRUM = 16
_PROJECT = _rng.normal(size=(64, _SPECTRUM, _SPECTRUM))
_TESTS = np.clip(_rng.normal(0, PATCH / 2.2, (256, 2, 2)), -PATCH + 1, PATCH - 1)

KEYPOINTS = "image long, key string, point int, side int, x float, y float, scale float, angle float, chunks array<long>, s0 long, s1 long, d0 long, d1 long, d2 long, d3 long"


class Tables(NamedTuple):
    """The descriptor bits of each table's key (tables, bits), and those of a sketch (128)."""

    keys: np.ndarray
    sketch: np.ndarray


def apart(bits: np.ndarray, n: int, rng: np.random.Generator, like: np.ndarray) -> np.ndarray:
    """``n`` of the columns of ``bits`` that are balanced and little correlated (``like``),
    in random order; the bounds give way until enough are found."""
    chosen, bound = [], 0.1
    share = bits.mean(0)
    while len(chosen) < n:
        for c in rng.permutation(bits.shape[1]).tolist():
            if len(chosen) < n and c not in chosen and abs(share[c] - 0.5) <= 0.2 + bound and (not chosen or like[c, chosen].max() <= bound):
                chosen.append(c)
        bound += 0.05
    return np.array(chosen)


def tables_for(points: int, sample: np.ndarray | None = None) -> Tables:
    """Tables for a number of keypoints: about one entry a slot by chance, and so many that two
    of MATCHES matches at DISTANCE share a slot with probability RECALL. ``sample``:
    descriptors that the bits are fitted on; without it all bits are alike."""
    n_bits = max(KEY_BITS, int(np.ceil(np.log2(max(points, 1)))))
    meet = np.prod([(256 - DISTANCE - i) / (256 - i) for i in range(n_bits)])
    tables, found = 0, 0.0
    while found < RECALL:
        tables += 1
        each = 1 - (1 - meet) ** tables
        found = 1 - (1 - each) ** MATCHES - MATCHES * each * (1 - each) ** (MATCHES - 1)
    rng = np.random.Generator(np.random.PCG64(n_bits))
    bits = np.zeros((0, 256)) if sample is None else np.unpackbits(np.ascontiguousarray(sample).view(np.uint8).reshape(len(sample), 32), axis=1).astype(float)
    if len(bits) < 256:
        return Tables(np.stack([rng.permutation(256)[:n_bits] for _ in range(tables)]), rng.permutation(256)[:128])
    with np.errstate(invalid="ignore", divide="ignore"):
        like = np.abs(np.nan_to_num(np.corrcoef(bits.T), nan=1.0))
    return Tables(np.stack([apart(bits, n_bits, rng, like) for _ in range(tables)]), apart(bits, 128, rng, like))


def slot_keys(bits: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """(points, tables) slot numbers and (points, 2) sketches of (points, 4) descriptors."""
    one = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(len(bits), 32), axis=1)
    n_tables, n_bits = tables.keys.shape
    keys = np.empty((len(bits), n_tables), np.int64)
    weights = 1 << np.arange(n_bits, dtype=np.int64)
    for t, columns in enumerate(tables.keys):
        keys[:, t] = one[:, columns] @ weights + (t << n_bits)
    return keys, np.ascontiguousarray(np.packbits(one[:, tables.sketch], axis=1)).view(np.int64).reshape(len(bits), 2)


def render(vectors: np.ndarray, side: int = 64) -> np.ndarray:
    """Textured pictures of 64-dimensional vectors, uint8, side x side: a fixed
    projection of the vector is the picture's cosine spectrum, so near vectors make
    near pictures."""
    basis = np.cos(np.pi * (np.arange(side)[:, None] + 0.5) * np.arange(_SPECTRUM)[None, :] / side)
    spectrum = np.tensordot(vectors.astype(float), _PROJECT, 1)
    spectrum[:, 0, 0] = 0
    field = basis @ spectrum @ basis.T
    spread = np.maximum(field.std(axis=(1, 2), keepdims=True), 1e-12)
    return np.clip(np.rint(field / spread * 48 + 128), 0, 255).astype(np.uint8)


def blur(n: int, sigma: float) -> np.ndarray:
    """(n, n): Gaussian smoothing of a line of n pixels, its ends repeated."""
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    out = np.zeros((n, n))
    for step, weight in zip(range(-r, r + 1), k / k.sum(), strict=True):
        np.add.at(out, (np.arange(n), np.clip(np.arange(n) + step, 0, n - 1)), weight)
    return out


def stretch(n: int, m: int) -> np.ndarray:
    """(m, n): linear resampling of a line of n pixels to m."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    out = np.zeros((m, n))
    np.add.at(out, (np.arange(m), low), 1 - (at - low))
    np.add.at(out, (np.arange(m), np.minimum(low + 1, n - 1)), at - low)
    return out


def smooth(img: np.ndarray, sigma: float) -> np.ndarray:
    return blur(img.shape[0], sigma) @ img @ blur(img.shape[1], sigma).T


def resize(img: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return stretch(img.shape[0], shape[0]) @ img @ stretch(img.shape[1], shape[1]).T


@lru_cache(64)
def _line(n: int, level: int) -> tuple[np.ndarray, ...]:
    """Matrices of one side of a pyramid level: to the level, its slope, and the
    smoothing of the corner response. All linear filters of a level are such products."""
    factor = FACTOR**level
    m = round(n / factor)
    to = blur(m, 1.2) @ (stretch(n, m) @ blur(n, 0.5 * factor) if level else np.eye(n))
    slope = np.gradient(to, axis=0) if m > 1 else to * 0
    return tuple(x.astype(np.float32) for x in (to, slope, blur(m, 1.6)))


@lru_cache(8)
def _test_offsets(width: int) -> np.ndarray:
    """(TURNS, 2, 256) offsets in a flat picture of the tests' two pixels at every turn."""
    angle = np.arange(TURNS) * 2 * np.pi / TURNS
    c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    x, y = _TESTS[:, :, 0].T[None], _TESTS[:, :, 1].T[None]
    return np.rint(s * x + c * y).astype(np.int64) * width + np.rint(c * x - s * y).astype(np.int64)


def describe_all(pictures: np.ndarray, points: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pictures (n, height, width) of one shape: picture number, (k, 4) x, y, scale,
    angle and (k, 4) uint64 descriptors of each one's ``points`` strongest corners over all
    scales; their number grows with the area where it is not given. Pictures too small
    or flat have none."""
    n, height, width = pictures.shape
    if points is None:
        points = max(POINTS, round(POINTS * height * width / SIDE**2))
    base, levels, found = pictures.astype(np.float32), [], []
    for level in range(SCALES):
        factor = FACTOR**level
        if min(round(height / factor), round(width / factor)) < 2 * PATCH + 4:
            break
        (ty, sy, by), (tx, sx, bx) = _line(height, level), _line(width, level)
        half = ty @ base
        at, gx, gy = half @ tx.T, half @ sx.T, (sy @ base) @ tx.T
        xx, yy, xy = (by @ g @ bx.T for g in (gx * gx, gy * gy, gx * gy))
        corner = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        column = np.maximum(np.maximum(corner[:, :-2], corner[:, 2:]), corner[:, 1:-1])
        around = np.maximum(column[:, :, :-2], column[:, :, 2:])
        np.maximum(around, np.maximum(corner[:, :-2, 1:-1], corner[:, 2:, 1:-1]), out=around)
        edge = PATCH // 2
        inner = corner[:, edge:-edge, edge:-edge]
        i, y, x = np.nonzero((inner > around[:, edge - 1 : 1 - edge, edge - 1 : 1 - edge]) & (inner > 1.0))
        levels.append(at)
        found.append(np.stack([i, np.full(len(i), level), y + edge, x + edge], 1))
        levels[-1] = (at, inner[i, y, x])
    if not found:
        return np.zeros(0, np.int64), np.zeros((0, 4)), np.zeros((0, 4), np.uint64)
    rows, strength = np.concatenate(found), np.concatenate([s for _, s in levels])
    factor = FACTOR ** rows[:, 1]
    place = (rows[:, :1:-1] + 0.5) * factor[:, None]
    order = np.lexsort((place[:, 1], place[:, 0], -strength, rows[:, 0]))
    rows, place, factor = rows[order], place[order], factor[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
    rows, place, factor = rows[nth < points], place[nth < points], factor[nth < points]
    angle, bits = np.zeros(len(rows)), np.zeros((len(rows), 4), np.uint64)
    pad = int(PATCH * 1.5)
    dy, dx = np.mgrid[-(PATCH // 2) : PATCH // 2 + 1, -(PATCH // 2) : PATCH // 2 + 1]
    disc = dy * dy + dx * dx <= (PATCH // 2) ** 2
    dy, dx = dy[disc], dx[disc]
    for level, (at, _) in enumerate(levels):
        own = np.flatnonzero(rows[:, 1] == level)
        wide = np.pad(at, ((0, 0), (pad, pad), (pad, pad)), mode="edge")
        flat = wide.reshape(-1)
        for begin in range(0, len(own), AT_ONCE):
            part = own[begin : begin + AT_ONCE]
            i, _, y, x = rows[part].T
            middle = (i * wide.shape[1] + y + pad) * wide.shape[2] + x + pad
            # orientation: direction of the brightness centre of the patch
            patch = flat[middle[:, None] + (dy * wide.shape[2] + dx)[None]]
            angle[part] = np.arctan2(patch @ dy.astype(np.float32), patch @ dx.astype(np.float32))
            turn = np.rint(angle[part] * TURNS / (2 * np.pi)).astype(np.int64) % TURNS
            offsets = _test_offsets(wide.shape[2])[turn]
            less = flat[middle[:, None] + offsets[:, 0]] < flat[middle[:, None] + offsets[:, 1]]
            bits[part] = np.packbits(less, axis=1).view(np.uint64)
    return rows[:, 0], np.column_stack([place, factor, angle]), bits


def describe(img: np.ndarray, points: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) x, y, scale, angle and (n, 4) uint64 descriptors of one picture."""
    return describe_all(img[None], points)[1:]


def keypoints(media: DataFrame, decode: Callable[[pa.Array], Iterator[np.ndarray | None]], id_col: str, media_col: str | Column, tables: Tables) -> DataFrame:
    """All keypoints (see KEYPOINTS) of a media column. ``decode`` turns an Arrow
    column into grey pictures, None for what is no picture. An image without
    keypoints has one row with a null point; ``key`` is the hash of its pixels, ``chunks``
    are its slots in ``tables``."""
    names = ["image", "key", "point", "side", "x", "y", "scale", "angle", "chunks", "s0", "s1", "d0", "d1", "d2", "d3"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.float32()] * 4, pa.list_(pa.int64()), *[pa.int64()] * 6]

    def rows_of(ids: list, pictures: list[np.ndarray]) -> pa.RecordBatch:
        side = max(pictures[0].shape)
        i, at, bits = describe_all(np.stack(pictures))
        keys = pa.array([hashlib.sha256(str(x.shape).encode() + x.tobytes()).hexdigest() for x in pictures])
        bare = np.setdiff1d(np.arange(len(ids)), i)
        owner = np.concatenate([i, bare])
        gap = lambda values, kind: pa.concat_arrays([pa.array(values, kind), pa.nulls(len(bare), kind)])
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        slots, sketch = slot_keys(bits, tables)
        chunks = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * slots.shape[1], pa.int32()), pa.array(slots.reshape(-1)))
        columns = [pa.array(ids, pa.int64()).take(pa.array(owner)), keys.take(pa.array(owner)), gap(nth.astype(np.int32), pa.int32()), gap(np.full(len(i), side, np.int32), pa.int32())]
        columns += [gap(at[:, c].astype(np.float32), pa.float32()) for c in range(4)] + [pa.concat_arrays([chunks, pa.nulls(len(bare), chunks.type)])]
        columns += [gap(sketch[:, c], pa.int64()) for c in range(2)]
        return pa.RecordBatch.from_arrays(columns + [gap(np.ascontiguousarray(bits[:, c]).view(np.int64), pa.int64()) for c in range(4)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, tuple[list, list]] = {}
            # a decoder gets few rows at a time: pictures are much larger than what they come from
            slices = (batch.slice(at, DECODED) for at in range(0, batch.num_rows, DECODED))
            decoded = (pair for part in slices for pair in zip(part.column(0).to_pylist(), decode(part.column(1)), strict=True))
            for image, picture in decoded:
                if picture is None or picture.size == 0:
                    yield pa.RecordBatch.from_arrays([pa.array([image if n == "image" else None], t) for n, t in zip(names, kinds, strict=True)], names)
                    continue
                ids, pictures = held.setdefault(picture.shape, ([], []))
                ids.append(image)
                pictures.append(picture)
                if len(ids) * picture.size >= PIXELS:
                    yield rows_of(*held.pop(picture.shape))
                elif sum(len(g[0]) * g[1][0].size for g in held.values()) >= 4 * PIXELS:
                    yield rows_of(*held.pop(max(held, key=lambda k: len(held[k][0]) * k[0] * k[1])))
            for group in held.values():
                yield rows_of(*group)

    column = F.col(media_col) if isinstance(media_col, str) else media_col
    return map_arrow(media.select(F.col(id_col).cast("long").alias("image"), column.alias("media")), run, KEYPOINTS)


class Points(NamedTuple):
    """The keypoints of one image: positions as complex numbers."""

    side: float
    at: np.ndarray
    scale: np.ndarray
    angle: np.ndarray
    bits: np.ndarray


def beyond_chance(matches: int, share: float) -> int:
    """The fewest inliers that ``matches`` accidental matches, each an inlier with
    probability ``share``, reach in one of all proposals with probability below CHANCE."""
    mean = matches * share
    term, tail, k = np.exp(-mean), 1.0, 0
    while tail * matches * (matches - 1) / 2 > CHANCE and k < matches:
        tail, k = tail - term, k + 1
        term *= mean / k
    return k + 2


def consents(a: Points, b: Points, consensus: int) -> bool:
    """Whether ``consensus`` different matched points of both agree on a similarity
    transform. Every two matches propose the one that maps both, if it turns and
    zooms about as each match does by itself. A match is the nearest of both its
    points (ties count); many matches must agree beyond what chance gives."""
    gap = np.concatenate([np.bitwise_count(a.bits[begin : begin + 256, None] ^ b.bits[None]).sum(2, dtype=np.int16) for begin in range(0, len(a.at), 256)])
    i, j = np.nonzero((gap <= DISTANCE) & (gap == gap.min(1, keepdims=True)) & (gap == gap.min(0)))
    if min(len(np.unique(i)), len(np.unique(j))) < consensus:
        return False
    p, q, turn, zoom = a.at[i], b.at[j], b.angle[j] - a.angle[i], np.log(b.scale[j] / a.scale[i])
    near = TOLERANCE * b.side + LOCAL * b.scale[j]
    consensus = max(consensus, beyond_chance(len(i), np.pi * float(np.max(near) / b.side) ** 2 * TURN / np.pi))
    turned = lambda x, y: np.abs(np.angle(np.exp(1j * (x - y)))) <= TURN
    for m in range(len(p) - 1):
        dp, dq = p[m + 1 :] - p[m], q[m + 1 :] - q[m]
        apart = np.flatnonzero((np.abs(dp) >= 4) & (np.abs(dq) >= 4))
        move = dq[apart] / dp[apart]
        by, size = np.angle(move), np.log(np.abs(move))
        fits = turned(by, turn[m]) & turned(by, turn[m + 1 + apart]) & (np.abs(size - zoom[m]) <= ZOOM) & (np.abs(size - zoom[m + 1 + apart]) <= ZOOM)
        move, by = move[fits], by[fits]
        for begin in range(0, len(move), 256):
            step, angle = move[begin : begin + 256, None], by[begin : begin + 256, None]
            inlier = (np.abs(step * (p - p[m]) + q[m] - q) <= near) & turned(angle, turn)
            for one in inlier[inlier.sum(1) >= consensus]:
                if min(len(np.unique(i[one])), len(np.unique(j[one]))) >= consensus:
                    return True
    return False


def agreed(pairs: DataFrame, points: DataFrame, consensus: int) -> DataFrame:
    """(a, b) of candidate image pairs whose matched points agree on a similarity
    transform. ``pairs``: a, b, all different; all their keypoints are compared."""
    names = ("side", "x", "y", "scale", "angle", "d0", "d1", "d2", "d3")
    named = pairs.select(F.col("a").alias("image")).union(pairs.select("b")).distinct()
    packed = points.select("image", "point", *names).join(named, "image", "left_semi")
    packed = packed.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("point", *names))).alias("points"))

    def unpack(column: pa.ListArray) -> list[Points]:
        ends = np.cumsum(np.r_[0, np.asarray(column.value_lengths())])
        flat = column.flatten()
        side, x, y, scale, angle, *words = (flat.field(flat.type.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names)
        at, bits = x.astype(float) + 1j * y, np.stack(words, 1).view(np.uint64)
        return [Points(float(side[i]), at[i:j], scale[i:j], angle[i:j], bits[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                good = [consents(a, b, consensus) for a, b in zip(unpack(part.column(2)), unpack(part.column(3)), strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda n: packed.select(F.col("image").alias(n), F.col("points").alias(f"{n}_points"))
    return map_arrow(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_points", "b_points"), run, "a long, b long")


def _met(rows: DataFrame) -> DataFrame:
    """(a, b, n) of image pairs that come near in two different points of both. ``rows``: a,
    b, a_point, b_point."""
    ends = [f(f"{side}_point").alias(f"{side}_{name}") for side in "ab" for name, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"), *ends).where("a_lo < a_hi and b_lo < b_hi").select("a", "b", "n")


def first_links(points: DataFrame, consensus: int) -> DataFrame:
    """(a, b): each image with the first image of a slot's part that it comes near
    most often, if they agree. A running first value needs no group in memory."""
    entries = points.select(F.explode(F.slice("chunks", 1, FIRST_TABLES)).alias("slot"), "image", "point", "s0")
    part = Window.partitionBy("slot", F.pmod(F.xxhash64("image"), F.lit(PARTS))).orderBy("image", "point").rowsBetween(Window.unboundedPreceding, 0)
    first = entries.withColumn("lead", F.first(F.struct("image", "point", "s0")).over(part))
    close = first.where((F.col("lead.image") < F.col("image")) & (F.bit_count(F.col("s0").bitwiseXOR(F.col("lead.s0"))) <= NEAR_FIRST))
    votes = _met(close.select(F.col("lead.image").alias("a"), F.col("image").alias("b"), F.col("lead.point").alias("a_point"), F.col("point").alias("b_point")))
    best = votes.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a")))["a"].alias("a")).select((-F.col("a")).alias("a"), "b")
    return settle(agreed(settle(best, "first-pairs"), points, consensus), "first-links")


def class_links(classes: DataFrame, points: DataFrame, consensus: int) -> DataFrame:
    """(a, b) of images of different classes that come near in a slot and agree.
    ``classes``: node, component of images that have a link."""
    entries = points.select(F.explode("chunks").alias("slot"), "image", "point", "s0", "s1")
    known = classes.select(F.col("node").alias("image"), "component")
    columns = ["component", "image", "point", "s0", "s1"]
    alone = entries.join(known, "image", "left_anti").withColumn("component", F.col("image")).select("slot", *columns)
    one = entries.join(known, "image").groupBy("slot", "component").agg(F.min(F.struct("image", "point", "s0", "s1")).alias("e"))
    rows = alone.union(one.select("slot", "component", "e.image", "e.point", "e.s0", "e.s1"))
    # at most 1 / COMMON slots, whatever the input
    common = entries.freqItems(["slot"], COMMON).select(F.explode("slot_freqItems").alias("slot"), F.lit(PARTS).alias("parts"))
    rows = rows.join(F.broadcast(common), "slot", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    x = rows.select("slot", F.pmod(F.xxhash64("image"), "parts").cast("int").alias("part"), *[F.col(c).alias(f"x_{c}") for c in columns])
    y = rows.select("slot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"y_{c}") for c in columns])
    near = x.join(y, ["slot", "part"]).where(F.expr(f"x_component < y_component and bit_count(x_s0 ^ y_s0) + bit_count(x_s1 ^ y_s1) <= {NEAR}"))
    ahead = F.col("x_image") < F.col("y_image")
    side = lambda c, name, other: F.when(ahead, F.col(f"{name}_{c}")).otherwise(F.col(f"{other}_{c}"))
    met = _met(near.select(side("image", "x", "y").alias("a"), side("image", "y", "x").alias("b"), side("point", "x", "y").alias("a_point"), side("point", "y", "x").alias("b_point")))
    return settle(agreed(settle(met.select("a", "b"), "class-pairs"), points, consensus), "class-links")


def image_links(points: DataFrame, consensus: int = CONSENSUS) -> DataFrame:
    """(a, b) links that connect every class of linked images; not all links."""
    points = points.where("point is not null")
    first = first_links(points, consensus)
    return first.union(class_links(components(first), points, consensus))


def copies(media: DataFrame, decode: Callable, id_col: str, media_col: str | Column, consensus: int = CONSENSUS) -> DataFrame:
    """One row per row of ``media``: id_col, n_points and component_id (smallest id
    reachable over links, itself included).

    Defined cases: null or undecodable media have no points and no links; equal
    pictures are one class even without points; a null id has component_id null
    and links with nothing; repeated ids count as one node; an empty table gives an
    empty result; other columns are ignored."""
    some = media.orderBy(F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)).limit(SAMPLE)
    bits = keypoints(some, decode, id_col, media_col, tables_for(0)).where("point is not null").select("d0", "d1", "d2", "d3").toArrow()  # of SAMPLE pictures
    tables = tables_for(POINTS * media.count(), np.stack([bits[c].to_numpy() for c in bits.column_names], 1))
    points = settle(keypoints(media, decode, id_col, media_col, tables), "keypoints")
    images = points.groupBy("image", "key").agg(F.coalesce(F.max("point") + 1, F.lit(0)).alias("n_points"), F.count_if(F.coalesce("point", F.lit(0)) == 0).alias("times"))
    images = settle(images, "images")
    lead = settle(images.where("image is not null and key is not null").groupBy("key").agg(F.min("image").alias("lead")), "pictures")
    # one image a picture; only rows that come repeatedly have keypoints to drop
    leads = settle(images.join(lead, "key").where("image = lead").select("image", "key", "times"), "leading-images")
    own = points.where("point is not null").join(leads, ["image", "key"])
    own = own.where("times = 1").union(own.where("times > 1").dropDuplicates(["image", "key", "point"])).drop("key", "times")
    own = settle(own, "own-keypoints", replaces=points)
    links = image_links(own, consensus)
    equal = images.join(lead, "key").where("image > lead").select(F.col("lead").alias("a"), F.col("image").alias("b"))
    reach = components(links.union(equal))
    classes = images.groupBy("image").agg(F.max("n_points").alias("n_points")).join(reach.withColumnRenamed("node", "image"), "image", "left")
    rows = media.select(F.col(id_col).cast("long").alias(id_col))
    return rows.join(classes, F.col(id_col).eqNullSafe(F.col("image")), "left").select(
        id_col, F.coalesce("n_points", F.lit(0)).cast("long").alias("n_points"), F.when(F.col(id_col).isNotNull(), F.coalesce("component", id_col)).alias("component_id"))


def vector_pictures(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Decoder for 64-dimensional vectors; other lengths, nulls and vectors with
    nulls are no picture."""
    values = column.to_pylist()
    good = [i for i, v in enumerate(values) if v is not None and len(v) == 64 and None not in v and np.all(np.isfinite(v))]
    pictures = dict(zip(good, render(np.array([values[i] for i in good])), strict=True)) if good else {}
    for i in range(len(values)):
        yield pictures.get(i)
