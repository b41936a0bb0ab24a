import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm.media import CONSENSUS, DISTANCE, copies, describe, image_links, render, resize, slot_keys, smooth, tables_for, vector_pictures


def raw_pictures():
    """A decoder of grey pictures: rows of bytes with height and width in front.
    Made in a function, so that workers need not import this module."""

    def decode(column):
        for v in column.to_pylist():
            yield None if v is None or len(v) < 2 else np.frombuffer(v, np.uint8, offset=2).reshape(v[0], v[1])

    return decode


def packed(img):
    return bytes(img.shape) + img.tobytes()


def found(df, col):
    return {r[col]: (r.component_id, r.n_points) for r in df.collect()}


def test_edited_and_cropped_copies(spark):
    rng = np.random.default_rng(2)
    base = render(rng.normal(size=(30, 64)), 90)
    rows = [(i, packed(img)) for i, img in enumerate(base)]
    edits = [
        lambda x: np.clip(x * 0.8 + 20.0, 0, 255).astype(np.uint8), lambda x: np.ascontiguousarray(x[8:84, 6:86]), lambda x: np.ascontiguousarray(np.rot90(x)),
        lambda x: np.clip(x + rng.normal(0, 3, x.shape), 0, 255).astype(np.uint8), lambda x: x.copy(),
    ]
    for k, edit in enumerate(edits):
        rows += [(100 * (k + 1) + i, packed(edit(base[i]))) for i in range(8)]
    got = found(copies(spark.createDataFrame(rows, "id long, img binary"), raw_pictures(), "id", "img"), "id")
    hits = [got[100 * (k + 1) + i][0] == i for k in range(len(edits)) for i in range(8)]
    assert sum(hits) >= 0.9 * len(hits)
    assert all(got[i][0] == i for i in range(30))


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 64))
    near = v[:30] + rng.normal(size=(30, 64)) * 0.08
    pics = render(np.concatenate([v, near]))
    bits = [describe(p)[1] for p in pics]
    links = {(i, j) for i in range(90) for j in range(i + 1, 90) if np.sum(np.bitwise_count(bits[i][:, None] ^ bits[j][None]).sum(2).min(1) <= DISTANCE) >= 8}
    assert len(links) >= 25
    rows = [(i, [float(x) for x in y]) for i, y in enumerate(np.concatenate([v, near]))]
    got = found(copies(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), vector_pictures, "vec_id", "embedding"), "vec_id")
    same = sum(got[a][0] == got[b][0] for a, b in links)
    assert same >= 0.9 * len(links)
    roots = {i: min([i, *(a for a, b in links if b == i)]) for i in range(90)}
    assert all(c == i or (c, i) in links or roots[i] == c for i, (c, _) in got.items())


def test_defined_cases(spark):
    v = [float(x) for x in np.random.default_rng(1).normal(size=64)]
    rows = [(1, None), (2, []), (3, [1.0] * 63), (4, [None] * 64), (5, [0.0] * 64), (6, v), (7, v), (7, v), (None, v), (9, [float("nan")] * 64)]
    media = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, image int")
    got = copies(media, vector_pictures, "vec_id", "embedding")
    assert got.count() == len(rows)
    by = found(got, "vec_id")
    assert all(by[i][0] == i and by[i][1] == 0 for i in (1, 2, 3, 4, 5, 9))
    assert by[6][0] == by[7][0] == 6 and by[None][0] is None
    assert copies(media.where(F.lit(False)), vector_pictures, "vec_id", "embedding").count() == 0
    assert list(vector_pictures(pa.array([None], pa.list_(pa.float32())))) == [None]


def test_tables_cover_the_accepted_distance(spark):
    # pairs of pictures with 8 common points whose descriptors differ in exactly 24 bits or as many as are accepted
    rng = np.random.default_rng(6)
    rows, n = [], 60
    for pair in range(n):
        base = rng.integers(0, 2, (8, 256))
        for image, flips in ((2 * pair, 0), (2 * pair + 1, DISTANCE if pair % 2 else 24)):
            bits = base.copy()
            for p in range(8):
                at = rng.permutation(256)[:flips]
                bits[p, at] ^= 1
            words = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
            chunks, sketch = slot_keys(words.view(np.uint64), tables_for(1000))
            rows += [(image, "k", p, 64, 7.0 * p, float(p * p), 1.0, 0.0, chunks[p].tolist(), *sketch[p].tolist(), *words[p].tolist()) for p in range(8)]
    schema = "image long, key string, point int, side int, x float, y float, scale float, angle float, chunks array<long>, s0 long, s1 long, d0 long, d1 long, d2 long, d3 long"
    got = {(r.a, r.b) for r in image_links(spark.createDataFrame(rows, schema), CONSENSUS).collect()}
    assert got <= {(2 * i, 2 * i + 1) for i in range(n)}
    assert len(got) >= 0.9 * n


def wide():
    """As raw_pictures, with height and width as two bytes each."""

    def decode(column):
        for v in column.to_pylist():
            h, w = np.frombuffer(v, np.uint16, 2)
            yield np.frombuffer(v, np.uint8, offset=4).reshape(h, w)

    return decode


def textured(rng, side):
    grain = sum(smooth(rng.normal(size=(side, side)), s) * s for s in (2.0, 4.0, 8.0))
    return np.clip(grain / grain.std() * 48 + 128, 0, 255)


def turned(img, degrees):
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    mid = (np.array(img.shape) - 1) / 2
    y, x = np.mgrid[: img.shape[0], : img.shape[1]] - mid[:, None, None]
    sy, sx = c * y - s * x + mid[0], s * y + c * x + mid[1]
    y0, x0 = (np.clip(np.floor(v).astype(int), 0, n - 2) for v, n in ((sy, img.shape[0]), (sx, img.shape[1])))
    fy, fx = np.clip(sy - y0, 0, 1), np.clip(sx - x0, 0, 1)
    return (img[y0, x0] * (1 - fx) + img[y0, x0 + 1] * fx) * (1 - fy) + (img[y0 + 1, x0] * (1 - fx) + img[y0 + 1, x0 + 1] * fx) * fy


def test_edits_of_large_pictures(spark):
    rng = np.random.default_rng(8)
    base = [textured(rng, 400) for _ in range(3)]
    edits = [lambda x: resize(x, (480, 480)), lambda x: turned(x, 10), lambda x: x[100:300, 150:350], lambda x: turned(resize(x, (480, 480)), 25)]
    packed = lambda x: np.array(x.shape, np.uint16).tobytes() + np.rint(x).astype(np.uint8).tobytes()
    rows = [(i, packed(x)) for i, x in enumerate(base)] + [(10 * (k + 1) + i, packed(edit(x))) for k, edit in enumerate(edits) for i, x in enumerate(base)]
    got = found(copies(spark.createDataFrame(rows, "id long, img binary"), wide(), "id", "img"), "id")
    assert all(component == i % 10 for i, (component, _) in got.items())


def test_a_large_group_is_one_class(spark):
    rng = np.random.default_rng(9)
    base = textured(rng, 64)
    rows = [(i, packed(np.clip(base + rng.normal(0, 2, base.shape), 0, 255).astype(np.uint8))) for i in range(200)]
    rows += [(1000 + i, packed(textured(rng, 64).astype(np.uint8))) for i in range(20)]
    got = found(copies(spark.createDataFrame(rows, "id long, img binary"), raw_pictures(), "id", "img"), "id")
    assert sum(got[i][0] == 0 for i in range(200)) >= 199
    assert all(got[1000 + i][0] == 1000 + i for i in range(20))


def test_recall_by_strength_of_the_edit(spark):
    """Against the comparison of all pairs, at several strengths."""
    from tidemark.llm.media import Points, consents

    rng = np.random.default_rng(12)
    base = [textured(rng, 96) for _ in range(25)]
    whole = lambda x: np.clip(np.rint(x), 0, 255).astype(np.uint8)
    points = lambda x: (lambda at, bits: Points(float(max(x.shape)), at[:, 0] + 1j * at[:, 1], at[:, 2], at[:, 3], bits))(*describe(x))
    for edit in (lambda x: x + rng.normal(0, 4, x.shape), lambda x: x + rng.normal(0, 10, x.shape), lambda x: smooth(x, 0.8), lambda x: x[10:86, 6:90], lambda x: turned(x, 8), lambda x: resize(x, (112, 112))):
        pictures = [whole(x) for x in base] + [whole(edit(x)) for x in base]
        own = [points(x) for x in pictures]
        want = [i for i in range(25) if consents(own[i], own[25 + i], CONSENSUS)]
        rows = [(i, packed(np.ascontiguousarray(x))) for i, x in enumerate(pictures)]
        got = found(copies(spark.createDataFrame(rows, "id long, img binary"), raw_pictures(), "id", "img"), "id")
        assert len(want) >= 15
        assert sum(got[25 + i][0] == i for i in want) >= 0.9 * len(want)
