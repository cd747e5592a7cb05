"""Metadata of photographs that the tests write in both byte orders, whole and damaged."""

import struct

import pytest

from lumastack.operators import prepare
from lumastack.sources import formats, photos

MAIN = {0x010F: (2, b"Maker\0"), 0x0110: (2, b"Model with a long name\0"), 0x0112: (3, [6])}
SUB = {0x829A: (5, [1, 250]), 0x829D: (5, [28, 10]), 0x8827: (3, [400]), 0x9003: (2, b"2020:01:02 03:04:05\0"), 0x920A: (5, [50, 1]), 0xA002: (4, [6000]), 0xA003: (4, [4000]), 0xA20E: (5, [2000, 1]), 0xA20F: (5, [2000, 1]), 0xA210: (3, [3]), 0xA405: (3, [75])}


def block(order, main=MAIN, sub=SUB):
    """A block of tags: header, main directory, the one below it, and the values that do not fit."""
    main = {**main, photos.SUBDIRECTORY: (4, [0])}
    at_sub = 8 + 2 + 12 * len(main) + 4
    heap = at_sub + 2 + 12 * len(sub) + 4
    main[photos.SUBDIRECTORY] = (4, [at_sub])
    out, tail = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8), b""
    for entries in (main, sub):
        out += struct.pack(order + "H", len(entries))
        for tag, (kind, v) in sorted(entries.items()):
            body = v if kind == 2 else struct.pack(f"{order}{len(v)}{'H' if kind == 3 else 'I'}", *v)
            count = len(v) if kind != 5 else len(v) // 2
            value = body.ljust(4, b"\0") if len(body) <= 4 else struct.pack(order + "I", heap + len(tail))
            tail += body if len(body) > 4 else b""
            out += struct.pack(order + "HHI", tag, kind, count) + value
        out += struct.pack(order + "I", 0)
    return out + tail


def jpeg(tags, w=1500, h=1000):
    segment = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes(9)) + segment(0xE1, b"Exif\0\0" + tags) + segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes(9)) + segment(0xDA, bytes(10)) + b"\x00" * 50


@pytest.mark.parametrize("order", ["<", ">"])
def test_tags(order):
    got = photos.photo(jpeg(block(order)))
    assert got == {
        "format": "jpeg", "width": 1500, "height": 1000, "orig_width": 6000, "orig_height": 4000, "make": "Maker", "model": "Model with a long name", "orientation": 6, "taken": "2020:01:02 03:04:05",
        "exposure": 0.004, "aperture": 2.8, "iso": 400, "focal": 50.0, "focal35": 75.0, "plane_res_x": 2000.0, "plane_res_y": 2000.0, "plane_unit": 3,
    }
    tiff = photos.photo(block(order, {**MAIN, 0x0100: (4, [640]), 0x0101: (4, [480])}))
    assert (tiff["format"], tiff["width"], tiff["height"], tiff["focal35"]) == ("tiff", 640, 480, 75.0)


@pytest.mark.parametrize("order", ["<", ">"])
def test_damaged_files(order):
    whole = jpeg(block(order))
    for n in range(len(whole)):  # cut off anywhere
        photos.photo(whole[:n])
    for n in range(4, len(whole)):  # any byte spoilt
        photos.photo(whole[:n] + bytes([whole[n] ^ 0xFF]) + whole[n + 1 :])
    far = block(order)
    at = far.index(struct.pack(order + "HHI", 0x0110, 2, 23)) + 8
    got = photos.photo(jpeg(far[:at] + struct.pack(order + "I", 2**31) + far[at + 4 :]))
    assert got["model"] is None and got["make"] == "Maker" and got["focal"] == 50.0
    loop = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IHHHII", 8, 1, photos.SUBDIRECTORY, 4, 1, 8)
    assert photos.tags_of(loop) == {}
    zero = photos.photo(jpeg(block(order, sub={0x920A: (5, [50, 0])})))
    assert zero["focal"] is None and zero["make"] == "Maker"
    for other in (b"", b"GIF89a", b"\x89PNG\r\n\x1a\n" + bytes(40), b"\xff\xd8"):
        assert photos.photo(other)["make"] is None


def test_focal_lengths_from_files(spark, tmp_path):
    formats.register(spark)
    sub = {k: v for k, v in SUB.items() if k != 0xA405}
    for name, data in (("a", jpeg(block("<"))), ("b", jpeg(block(">", sub=sub))), ("c", b"no photograph")):
        (tmp_path / f"{name}.jpg").write_bytes(data + bytes(400_000))
    df = spark.read.format("photo_metadata").load(str(tmp_path))
    got = {r["dataset"]: r for r in prepare.normalize_focal(df).collect()}
    assert got["a"]["focal_eq"] == 75.0 and got["a"]["iso"] == 400
    diagonal = (30.0**2 + 20.0**2) ** 0.5  # 6000 x 4000 pixels, 2000 a centimetre
    assert abs(got["b"]["focal_eq"] - 50 * prepare.DIAGONAL / diagonal) < 1e-9
    assert got["c"]["format"] is None and got["c"]["focal_eq"] is None
    assert df.where("dataset = 'b'").select("make").collect()[0][0] == "Maker"
