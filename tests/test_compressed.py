"""Files with JPEG planes that the test writes: predicted from one another, made exact by corrections."""

import numpy as np
import pytest

from lumastack.sources import compressed, images


def _jpeg(spark, px):
    """(bytes, what a decoder makes of them) of a gray image, by the JVM's own encoder."""
    jvm = spark._jvm
    h, w = px.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 10)  # gray bytes
    for y in range(h):
        for x in range(w):
            image.getRaster().setSample(x, y, 0, int(px[y, x]))
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data)).getRaster()
    return data, np.array([[back.getSample(x, y, 0) for x in range(w)] for y in range(h)])


def write(spark, planes, base, rank, kind):
    """A file of ``planes`` (n, h, w), in the order in which files hold them."""
    n, h, w = planes.shape
    parts = []
    for p in range(n):
        want, ref = planes[p], planes[base[p]] if base[p] >= 0 else None
        data, seen = _jpeg(spark, want if ref is None else np.clip(want - ref + 128, 0, 255))
        got = seen if ref is None else (seen - 128 + ref) % 256
        fixes = b"".join(int(i).to_bytes(4, "big") + bytes([want.flat[i]]) for i in np.flatnonzero(got != want))
        parts.append((data, fixes))
    head = f"PTM_1.2\n{kind}\n{w}\n{h}\n1 2 3 4 5 6\n0 51 102 153 204 255\n90\n"
    for values in ([0] * n, [0] * n, [0] * n, rank, base, [len(d) for d, _ in parts], [len(f) for _, f in parts]):
        head += " ".join(map(str, values)) + "\n"
    return head.encode() + b"".join(d + f for d, f in parts)


@pytest.mark.parametrize("band_rows", [None, 2])
def test_round_trips(spark, tmp_path, band_rows):
    rng = np.random.default_rng(4)
    h, w = 5, 6
    smooth = lambda n: (np.add.outer(np.arange(n) * 9, np.add.outer(np.arange(h) * 7, np.arange(w) * 5)) + rng.integers(0, 9, (n, h, w))) % 256
    lrgb, rgb = smooth(9), smooth(18)
    files = {
        "lrgb": write(spark, lrgb, [-1, 0, 0, 4, -1, 0, -1, 6, 7], [1, 2, 3, 5, 4, 0 + 6, 0, 7, 8], "PTM_FORMAT_JPEG_LRGB"),
        "rgb": write(spark, rgb, [-1, *range(17)], list(range(18)), "PTM_FORMAT_JPEG_RGB"),
    }
    rows = spark.createDataFrame(list(files.items()), "dataset string, content binary")
    heads, pixels = compressed.compressed_tables(rows, band_rows=band_rows)
    got = {(r["dataset"], r["x"], r["y"]): r["q"] for r in pixels.collect()}
    assert len(got) == 2 * h * w
    for y in range(h):
        for x in range(w):
            up = h - 1 - y  # files run upwards
            assert got["lrgb", x, y] == [*lrgb[6:, up, x], *(lrgb[t, up, x] for t in images.FILE_TERMS)]
            assert got["rgb", x, y] == [rgb[6 * c + t, up, x] for t in images.FILE_TERMS for c in range(3)]
    facts = {r["dataset"]: r for r in heads.collect()}
    assert facts["rgb"]["colorspace"] == "rgb" and facts["lrgb"]["scale"] == [6.0, 4.0, 5.0, 1.0, 3.0, 2.0] and facts["lrgb"]["bias"][0] == 1.0


def test_damaged_files(spark):
    data = write(spark, np.full((9, 4, 4), 7), [-1] * 9, list(range(9)), "PTM_FORMAT_JPEG_LRGB")
    assert len(compressed.parse_compressed(data)[1]) == 9
    for bad in (data[:-1], data.replace(b"JPEG_LRGB", b"JPEG_MRGB"), data.replace(b"0 1 2 3 4 5 6 7 8", b"0 1 2 3 4 5 6 7 7"), data.replace(b"-1 -1", b"0 -1", 1), data.replace(b"0 0 0", b"0 1 0", 1)):
        with pytest.raises(ValueError):
            compressed.parse_compressed(bad)
