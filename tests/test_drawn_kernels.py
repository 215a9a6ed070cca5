"""Drawing and levelling of pages by kernel against the relations of ``engraver``, and plans that hold at larger sizes."""

import random

import numpy as np
from pyspark.sql import functions as F

from partita.operators import engraver, kernels
from partita.plans import queries

SF_DIR = "/root/testdata/sf0.001"
SHAPES = "page_id long, kind string, a double, b double, c double, d double, w double"


def shapes_and_pages(spark, n=40):
    rng, rows = random.Random(11), []
    for page in range(n):
        for _ in range(rng.choice([0, 1, 5, 30])):
            kind = rng.choice(["rect", "disc", "ring", "ring", "stroke"])
            place = [rng.choice([rng.uniform(-9, 95), float(rng.randrange(-5, 80)), rng.randrange(160) / 2]) for _ in range(2)]
            size = [rng.uniform(-9, 9), rng.choice([0.0, rng.uniform(-9, 9)]), rng.uniform(0.3, 5)] if kind == "stroke" else [rng.choice([rng.uniform(0.2, 14), 3.0]), rng.uniform(0.2, 9), 0.0]
            rows.append((page, kind, *place, *size))
    shapes = spark.createDataFrame(rows, SHAPES).select("page_id", F.struct("kind", "a", "b", "c", "d", "w").alias("shape"))
    pages = spark.createDataFrame([(p, 40 + 7 * (p % 9), 35 + 11 * (p % 5)) for p in range(1, n + 1)], "page_id long, width int, height int")
    return shapes, pages


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_engraving_by_kernel(spark):
    shapes, pages = shapes_and_pages(spark)
    want = rows(engraver.drawn(shapes, pages))
    assert rows(kernels.engraved(shapes, pages)) == want and len(want) > 1000
    assert rows(kernels.engraved(shapes.limit(0), pages)) == []


def test_spans_are_merged_without_a_window_or_join(spark):
    """Only the order of a user's events is a window; spans are no rows."""
    text = plan(queries.QUERIES["engraved_pages"](spark, SF_DIR))
    assert text.count("Window") == 1 and "Join" not in text


def test_levelling_of_drawn_pages_by_one_task(spark):
    shapes, pages = shapes_and_pages(spark)
    grey = kernels.painted(engraver.drawn(shapes, pages), pages)
    want = kernels.levelled(grey)
    got = kernels.engraved_levelled(shapes, pages)
    assert rows(got.select(*want.columns)) == rows(want) and got.count() == pages.count()
    # No grey page is written, and no run is gathered.
    text = plan(queries.QUERIES["level_runs"](spark, SF_DIR))
    assert "grey" not in text and text.count("Window") == 1 and "Join" not in text


def test_threshold_and_cleaning_as_written_out():
    rng = np.random.default_rng(4)
    for height, width in ((1, 1), (2, 9), (17, 40), (90, 70), (200, 260)):
        for paper, spread in ((250, 5), (128, 128), (60, 60)):
            grey = np.clip(paper + rng.integers(-spread, spread + 1, (height, width)), 0, 255).astype(np.uint8)
            sums, area = kernels.window_sums(grey, max(15, int(min(width, height) / 12 + 0.5) | 1) // 2)
            ink = kernels.adaptive_threshold(grey)
            assert (ink == (grey < sums / area - 9)).all()
            near, _ = kernels.window_sums(ink, 1)
            odd = ink[1:-1:2, 1:-1:2]
            noisy = odd.any() and (near[1:-1:2, 1:-1:2][odd] <= 2).mean() >= 0.06
            want = ink
            if noisy:
                want = np.zeros_like(ink)
                want[1:-1, 1:-1] = near[1:-1, 1:-1] >= 5
            assert (kernels.denoised(ink) == want).all()
