import time

import numpy as np

from kindred.operators import images, sift


def tiles(n, side=8, each=12):
    return np.kron(np.random.default_rng(3).integers(0, 256, (n, side, side)), np.ones((1, each, each)))


def test_a_feature_costs_less_than_the_plain_sum_of_its_descriptor():
    """All of describe() for each feature, against eight corners added one by one over a patch of 36 x 36."""
    cell, weight = np.random.default_rng(4).integers(0, 288, (8, 36 * 36)), np.random.default_rng(5).random(36 * 36)

    def plain():
        out = np.zeros(288)
        for at in cell:
            np.add.at(out, at, weight * weight * weight * weight)
        return out

    def least(f):
        spent = []
        for _ in range(4):
            began = time.perf_counter()
            n = f()
            spent.append((time.perf_counter() - began) / n)
        return min(spent)
    stack = tiles(12)
    slow = least(lambda: len([plain() for _ in range(200)]))
    fast = least(lambda: sum(len(list(sift.describe(image))) for image in stack))
    assert fast < 6 * slow


def test_a_stack_gives_the_features_of_each_image():
    stack = np.concatenate([tiles(5), np.zeros((1, 96, 96)), tiles(2)[:, ::-1]])
    of, *columns = sift.describe_stack(stack)
    assert (np.diff(of) >= 0).all() and 5 not in of
    for k, image in enumerate(stack):
        alone = list(sift.describe(image))
        assert len(alone) == (of == k).sum()
        for c, column in enumerate(columns):
            assert np.allclose(np.array([f[c] for f in alone]).reshape(column[of == k].shape), column[of == k], atol=1e-9)


def test_peaks_against_all_neighbours_with_ties():
    dog = np.random.default_rng(6).integers(-9, 10, (3, 5, 9, 11)).astype(float)
    want = []
    for image, s, y, x in np.ndindex(3, 5, 9, 11):
        if 0 < s < 4 and 0 < y < 8 and 0 < x < 10:
            rest = np.delete(dog[image, s - 1:s + 2, y - 1:y + 2, x - 1:x + 2].ravel(), 13)
            mid = dog[image, s, y, x]
            if abs(mid) > 2.4 and (mid > rest.max() or mid < rest.min()):
                want.append((image, s, y, x))
    assert list(zip(*(z.tolist() for z in np.unravel_index(sift._peaks(dog), dog.shape)))) == want and want


def test_long_sides_are_blurred_like_short_ones():
    image = np.random.default_rng(7).random((2, 20, sift.MATRIX_SIDE + 1))
    got = sift._smooth(image, 1.3)
    assert np.allclose(got[:, :, :60], sift._smooth(image[:, :, :100], 1.3)[:, :, :60])
    assert np.allclose(got[1], sift._smooth(image[1], 1.3))


def test_features_of_images_of_several_sizes(spark):
    rows = [(k, i.shape[1], i.shape[0], 1, i.astype(np.uint8).tobytes()) for k, i in enumerate([*tiles(20), *tiles(3, each=11), *tiles(2, each=16), *tiles(2, each=5)])]
    got = {}
    for r in images.features(spark.createDataFrame(rows, "image_id bigint, width int, height int, channels int, data binary").coalesce(1)).collect():
        got.setdefault(r.image_id, []).append(r)
    for k, w, h, _, data in rows:
        image, (nw, nh) = np.frombuffer(data, np.uint8).reshape(h, w), images.fit_size(w, h)
        want = list(sift.describe(images.area_resize(image, nw, nh).astype(float))) if nw >= 50 else []
        mine = sorted(got.get(k, []), key=lambda r: r.ord)
        assert [r.ord for r in mine] == list(range(len(want)))
        for r, (x, y, size, turn, desc) in zip(mine, want):
            assert np.allclose([r.x, r.y, r.size, r.dir], [x * w / nw, y * w / nw, size * w / nw, turn], atol=1e-9) and np.allclose(r.desc, desc, atol=1e-9)
    assert len(got) == 25
