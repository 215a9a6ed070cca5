"""Queries of small pages at sizes where plans by pixel fail: whole pages as rows, and the same results as by pixel."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from partita.operators import components, kernels, noteheads, pixels, staves
from partita.plans import queries, views

SF_DIR = "/root/testdata/sf0.001"
PAGES = 130


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """A folder with suppliers of scattered keys."""
    path = tmp_path_factory.mktemp("pages")
    pq.write_table(pa.table({"s_suppkey": pa.array([3 * i * i + i + 1 for i in range(PAGES)], pa.int64())}), path / "supplier.parquet")
    return str(path)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def no_pixels(df):
    """Nothing is broadcast, and no pixels are opened or joined: pages are dealt once, each as a row."""
    text = plan(df)
    return not any(n in text for n in ("Broadcast", "Generate", "Join", "Window")) and text.count("Exchange") == 1


def test_pages_as_rows_hold_the_pixels(spark, many):
    pages = views.page_rows(spark, many)
    for value, name in (("ink", "ink"), ("grey", "g")):
        whole = kernels.to_pixels(pages.select("page_id", "width", "height", F.col(value).alias("grey"))).withColumnRenamed("g", "v")
        assert rows(whole) == rows(views.pixels(spark, many).select("page_id", "x", "y", F.col(name).alias("v")))


def test_dots_of_whole_pages(spark, many):
    page, pages = F.col("page_id"), views.page_images(spark, many)
    heads = pages.select("page_id", page.alias("head_id"), (2.0 + page % 16).alias("cx"), (12 + page * 3 % 20).alias("cy"), F.lit(12.0).alias("space"))
    got = queries.QUERIES["dot_find"](spark, many)
    want = rows(noteheads.dotted(heads, pixels.integral(views.pixels(spark, many).select("page_id", "x", "y", "ink"), "ink"), pages))
    assert rows(got) == want and 0 < len(want) < PAGES
    assert no_pixels(got)


def ink_of(spark, many):
    bitmap, pages = views.pixels(spark, many).select("page_id", "x", "y", "ink"), views.page_images(spark, many)
    return bitmap, bitmap.where("ink = 1").drop("ink"), pages


def by_pixel(spark, many):
    bitmap, ink, pages = ink_of(spark, many)
    scale = pixels.scale(bitmap, pages)
    return ink, scale, staves.bands(staves.row_projection(ink, scale), pages)


def test_bands_of_whole_pages(spark, many):
    got = queries.QUERIES["line_bands"](spark, many)
    _, _, bands = by_pixel(spark, many)
    want = queries.rounded(bands.drop("band"), center=6, ink=6)
    assert rows(got) == rows(want) and got.count() >= 5 * PAGES - PAGES
    assert no_pixels(got)


def test_staves_of_whole_pages(spark, many):
    got = queries.QUERIES["stave_groups"](spark, many)
    _, scale, bands = by_pixel(spark, many)
    want = staves.systems(staves.five_lines(bands, scale)).drop("lines")
    assert rows(got) == rows(queries.rounded(want, top=6, bottom=6, space=6))
    assert no_pixels(got)


def test_groups_and_systems_of_lines(spark):
    """Lists of bands as the windows and folds of ``staves`` read them."""
    evens = lambda top, space, n: [top + space * i for i in range(n)]
    pages = [
        [*evens(10, 10, 5), *evens(90, 10, 5)], [*evens(10, 10, 5), *evens(80, 10, 5), *evens(300, 10, 5), *evens(370, 10, 5)], [*evens(10, 10, 7), *evens(300, 10, 6)],
        [*evens(5, 3, 2), *evens(40, 11, 5), *evens(400, 12, 5)], [*evens(10, 10, 4)], [*evens(10, 10, 5), *evens(80, 10, 5), *evens(150, 10, 5)], [], [*evens(10, 40, 5)],
    ]
    flat = [(p, b, float(c), 2, 30.0, 5 + b, 90 + b) for p, centres in enumerate(pages) for b, c in enumerate(centres)]
    found = spark.createDataFrame(flat, "page_id long, band int, center double, thickness int, ink double, left int, right int")
    scale = spark.createDataFrame([(p, 2, 9) for p in range(len(pages))], "page_id long, line_thickness int, staff_space int")
    want = staves.systems(staves.five_lines(found, scale)).collect()
    names = "staff", "lines", "top", "bottom", "left", "right", "space", "system", "index_in_system"
    got = {(p, *(repr(s[c]) for c in names)) for p in range(len(pages)) for s in kernels.systems(kernels.five_lines([r[2:] for r in flat if r[0] == p], 9))}
    assert got == {(r["page_id"], *(repr(r[c]) for c in names)) for r in want} and len(want) == 13


def test_line_erasure_on_whole_pages(spark, many):
    got = queries.QUERIES["line_erase"](spark, many)
    ink, scale, bands = by_pixel(spark, many)
    assert rows(got) == rows(staves.without_lines(ink, staves.five_lines(bands, scale), scale))
    assert no_pixels(got)


def test_straightening_of_whole_pages(spark, many):
    got = queries.QUERIES["deskew_apply"](spark, many)
    _, ink, pages = ink_of(spark, many)
    angles = pixels.skew(ink, pages)
    assert rows(got) == rows(pixels.deskewed(ink, pages, angles)) and angles.where("angle <> 0").count() > 0
    assert no_pixels(got)


def test_stems_on_whole_pages(spark, many):
    got = queries.QUERIES["stem_find"](spark, many)
    _, ink, pages = ink_of(spark, many)
    page = F.col("page_id")
    heads = pages.select("page_id", page.alias("head_id"), (8.0 + page % 20).alias("cx"), (12 + page * 7 % 20).alias("cy"), F.lit(2.0).alias("space"))
    want = noteheads.stems(heads, ink)
    assert rows(got) == rows(queries.doubles(want, "stem_x", "tip")) and want.where("stem is not null").count() > 0
    assert no_pixels(got)


def test_smaller_whole_pages(spark, many):
    got = queries.QUERIES["page_downscale"](spark, many)
    want, _ = pixels.downscaled(views.pixels(spark, many).select("page_id", "x", "y", "g"), views.page_images(spark, many), 24)
    assert rows(got) == rows(want)
    assert no_pixels(got)


@pytest.mark.parametrize(("width", "height", "longest"), [(40, 48, 31), (7, 5, 3), (50, 3, 7), (13, 29, 28), (9, 9, 40)])
def test_cells_of_odd_sizes(spark, width, height, longest):
    grey = np.random.default_rng(width).integers(0, 256, (height, width))
    pixel = spark.createDataFrame([(1, int(x), int(y), int(v)) for (y, x), v in np.ndenumerate(grey)], "page_id long, x int, y int, g int")
    want, _ = pixels.downscaled(pixel, spark.createDataFrame([(1, width, height)], "page_id long, width int, height int"), longest)
    assert sorted(zip(*(v.tolist() for v in kernels.downscaled(grey.astype(np.uint8), longest)), strict=True)) == sorted((r["x"], r["y"], r["g"]) for r in want.collect())


def test_windows_on_whole_pages(spark, many):
    got = queries.QUERIES["window_fill"](spark, many)
    bitmap, _, pages = ink_of(spark, many)
    number = F.col("window_id")
    grid = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("window_id"))
    box = {"wx0": number % 5 * 8, "wx1": number % 5 * 8 + 8, "wy0": (F.floor(number / 5) * 12).cast("int"), "wy1": (F.floor(number / 5) * 12 + 12).cast("int")}
    want = components.window_fill(grid.withColumns(box), pixels.integral(bitmap, "ink")).select(*got.columns)
    assert rows(got) == rows(queries.rounded(want, fill=6))
    assert no_pixels(got)
