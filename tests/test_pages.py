"""Drawn pages through the pixel, staff and symbol operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from partita.operators import components, noteheads, pixels, staves, symbols

SPACE, WIDTH, HEIGHT = 14, 400, 300


def drawn(tops=(40, 166), blank=False):
    page = np.zeros((HEIGHT, WIDTH), int)
    if not blank:
        for top in tops:
            for i in range(5):
                page[top + i * SPACE : top + i * SPACE + 2, 30:370] = 1
        page[60:72, 200:214] = 1
    return page


def frames(spark, page, page_id=1):
    rows = [(page_id, int(x), int(y), int(v)) for (y, x), v in np.ndenumerate(page)]
    bitmap = spark.createDataFrame(rows, "page_id long, x int, y int, ink int").cache()
    pages = spark.createDataFrame([(page_id, page.shape[1], page.shape[0])], "page_id long, width int, height int")
    return bitmap, bitmap.where("ink = 1").drop("ink"), pages


@pytest.fixture(scope="module")
def page(spark):
    return frames(spark, drawn())


def test_scale_staves_and_systems(page):
    bitmap, ink, pages = page
    scale = pixels.scale(bitmap, pages)
    assert tuple(scale.first())[1:] == (2, 12)
    found = staves.systems(staves.five_lines(staves.bands(staves.row_projection(ink, scale), pages), scale)).orderBy("staff").collect()
    assert [(r["staff"], r["top"], r["bottom"], r["left"], r["right"], r["system"], r["index_in_system"]) for r in found] == [
        (0, 40.5, 96.5, 30, 369, 0, 0), (1, 166.5, 222.5, 30, 369, 0, 1),
    ]
    clean = staves.without_lines(ink, staves.five_lines(staves.bands(staves.row_projection(ink, scale), pages), scale), scale)
    got = {(r["x"], r["y"]) for r in clean.collect()}
    assert {(x, y) for x in range(200, 214) for y in range(60, 72)} <= got and (100, 40) not in got
    skew = pixels.skew(ink, pages).first()
    assert skew["angle"] == 0.0
    blobs = components.blobs(components.labelled_runs(clean, pages), components.smallest_area(F.lit(14.0))).collect()
    assert len(blobs) == 1 and (blobs[0]["x0"], blobs[0]["x1"]) == (200, 213)


def test_blank_page(spark):
    bitmap, ink, pages = frames(spark, np.zeros((30, 40), int))
    assert tuple(pixels.scale(bitmap, pages).first())[1:] == (1, 3)
    skew = pixels.skew(ink, pages).first()
    assert (skew["angle"], skew["score"]) == (-6.0, 0.0)
    scale = pixels.scale(bitmap, pages)
    assert staves.five_lines(staves.bands(staves.row_projection(ink, scale), pages), scale).count() == 0


def test_components_match_a_flood_fill(spark):
    rng = np.random.default_rng(3)
    page = (rng.random((24, 30)) < 0.35).astype(int)
    _, ink, pages = frames(spark, page)
    seen, want = np.zeros_like(page), []
    for (y, x), v in np.ndenumerate(page):
        if v and not seen[y, x]:
            stack, cells = [(y, x)], []
            seen[y, x] = 1
            while stack:
                a, b = stack.pop()
                cells.append((a, b))
                for c in range(max(0, a - 1), min(24, a + 2)):
                    for d in range(max(0, b - 1), min(30, b + 2)):
                        if page[c, d] and not seen[c, d]:
                            seen[c, d] = 1
                            stack.append((c, d))
            ys, xs = zip(*cells, strict=True)
            want.append((min(xs), min(ys), max(xs), max(ys), len(cells)))
    got = components.blobs(components.labelled_runs(ink, pages)).orderBy("blob_id").collect()
    assert [(r["x0"], r["y0"], r["x1"], r["y1"], r["area"]) for r in got] == want


def test_moving_and_prefix_sums_match_numpy(spark):
    rng = np.random.default_rng(5)
    page = rng.integers(0, 2, (17, 23))
    bitmap, _, pages = frames(spark, page)
    want = page.cumsum(axis=0).cumsum(axis=1)
    assert all(r["total"] == want[r["y"], r["x"]] for r in pixels.integral(bitmap, "ink").collect())
    for r in pixels.moving_sum(bitmap, "ink", 2, "n").collect():
        assert r["n"] == page[max(0, r["y"] - 2) : r["y"] + 3, max(0, r["x"] - 2) : r["x"] + 3].sum()


def test_suppression_blocks_by_kept_hits_only(spark):
    rows = [(1, 1, 0.0, 0.0, 0.9, True), (1, 1, 9.0, 0.0, 0.8, True), (1, 1, 18.0, 0.0, 0.7, True), (1, 1, 40.0, 0.0, 0.6, False), (1, 1, 45.0, 0.0, 0.5, True)]
    hits = spark.createDataFrame(rows, "page_id long, blob_id long, cx double, cy double, score double, shaped boolean").withColumn("space", F.lit(14.0))
    assert [r["cx"] for r in noteheads.suppressed(hits).orderBy("rank").collect()] == [0.0, 18.0, 45.0]


def test_equidistant_blob_stays_with_both_staves(spark):
    s = "page_id long, staff int, top double, bottom double, left double, right double"
    two = spark.createDataFrame([(1, 0, 0.0, 40.0, 0.0, 100.0), (1, 1, 80.0, 120.0, 0.0, 100.0)], s)
    b = spark.createDataFrame([(1, 0, 10, 55, 20, 65, 10.0), (1, 1, 10, 50, 20, 60, 10.0)], "page_id long, blob_id long, x0 int, y0 int, x1 int, y1 int, space double")
    got = sorted((r["blob_id"], r["staff"]) for r in symbols.nearest_staff(b, two).collect())
    assert got == [(0, 0), (0, 1), (1, 0)]


def test_three_systems(spark):
    rows = [(1, i, top, top + 40.0, 10.0) for i, top in enumerate((0.0, 80.0, 300.0, 380.0, 600.0, 680.0))]
    got = staves.systems(spark.createDataFrame(rows, "page_id long, staff int, top double, bottom double, space double")).orderBy("staff").collect()
    assert [(r["system"], r["index_in_system"]) for r in got] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)]
