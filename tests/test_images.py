"""PNG files to grey pages: round trips, every filter, colours, sizes, and files that are no pages."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.operators import pixels
from partita.sources import images


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(header, rows, *more):
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", *header)) + b"".join(more) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def filtered(image, kinds):
    """Rows of an image of bytes, each under the filter of its number, a byte at a time."""
    height, width, channels = image.shape
    flat, out = image.reshape(height, -1).astype(int), bytearray()
    for y in range(height):
        kind = kinds[y % len(kinds)]
        out.append(kind)
        for i in range(width * channels):
            a = flat[y, i - channels] if i >= channels else 0
            b = flat[y - 1, i] if y else 0
            c = flat[y - 1, i - channels] if y and i >= channels else 0
            p = a + b - c
            near = sorted([(abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)])[0][2]
            out.append((flat[y, i] - (0, a, b, (a + b) // 2, near)[kind]) % 256)
    return bytes(out)


@pytest.mark.parametrize(("kind", "channels"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_every_filter_and_colour_type(kind, channels):
    image = np.random.default_rng(kind).integers(0, 256, (11, 7, channels)).astype(np.uint8)
    got = images.decode_png(png((7, 11, 8, kind, 0, 0, 0), filtered(image, [0, 1, 2, 3, 4, 4, 3])))
    assert (got == image[:, :, : 3 if channels > 2 else 1]).all()


def test_palettes_and_round_trips():
    palette = np.array([[0, 0, 0], [250, 10, 30], [255, 255, 255]], np.uint8)
    index = np.array([[0, 1, 2], [2, 1, 0]], np.uint8)
    got = images.decode_png(png((3, 2, 8, 3, 0, 0, 0), filtered(index[:, :, None], [0]), chunk(b"PLTE", palette.tobytes())))
    assert (got == palette[index]).all()
    for shape in ((5, 9), (4, 3, 3)):
        image = np.arange(np.prod(shape)).reshape(shape).astype(np.uint8)
        assert (images.decode_png(images.encode_png(image)).reshape(shape) == image).all()


def test_files_that_are_no_pages_keep_their_rows(spark):
    whole = images.encode_png(np.zeros((4, 5), np.uint8))
    bad = {
        "empty": b"", "null": None, "text": b"no image at all", "cut": whole[:-20], "damaged": whole[:45] + b"\0" + whole[46:],
        "deep": png((1, 1, 16, 0, 0, 0, 0), b"\0\0\0"), "laced": png((1, 1, 8, 0, 0, 0, 1), b"\0\0"), "short": png((9, 9, 8, 0, 0, 0, 0), b"\0\0"), "filter": png((1, 1, 8, 0, 0, 0, 0), b"\7\0"),
    }
    frame = spark.createDataFrame([*bad.items(), ("good", whole)], "page_id string, content binary")
    got = {r["page_id"]: r for r in images.decoded(frame).collect()}
    assert set(got) == {*bad, "good"}
    assert all(got[k]["problem"] and got[k]["grey"] is None for k in bad)
    assert got["good"]["problem"] is None and (got["good"]["width"], got["good"]["height"], got["good"]["grey"]) == (5, 4, bytearray(20))


def test_downscaling_equals_the_pixel_relation(spark):
    rng = np.random.default_rng(5)
    rows, files = [], []
    for k, (w, h) in {1: (50, 31), 2: (20, 77), 3: (12, 9)}.items():
        image = rng.integers(0, 256, (h, w)).astype(np.uint8)
        files.append((k, images.encode_png(image)))
        rows += [(k, x, y, int(v), w, h) for (y, x), v in np.ndenumerate(image)]
    pixel = spark.createDataFrame(rows, "page_id long, x int, y int, g int, width int, height int")
    want, sizes = pixels.downscaled(pixel.drop("width", "height"), pixel.select("page_id", "width", "height").distinct(), 23)
    got = images.decoded(spark.createDataFrame(files, "page_id long, content binary"), 23)
    assert sorted(map(tuple, sizes.collect())) == sorted((r["page_id"], r["width"], r["height"]) for r in got.collect())
    for r in got.collect():
        page = np.frombuffer(r["grey"], np.uint8).reshape(r["height"], r["width"])
        assert all(page[q["y"], q["x"]] == q["g"] for q in want.where(F.col("page_id") == r["page_id"]).collect())


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "more").mkdir()
    for name in ("a.png", "more/b.png", "c.txt"):
        (tmp_path / name).write_bytes(images.encode_png(np.full((3, 3, 3), 100, np.uint8)))
    got = images.decoded(images.files(spark, str(tmp_path))).collect()
    assert sorted(r["page_id"].rsplit("/", 1)[1] for r in got) == ["a.png", "b.png"] and all(set(r["grey"]) == {100} for r in got)
