"""Scores, symbols and page images derived from the given tables by formula, row by row.

The tables hold no music, so each view spreads a table's rows over the shapes the operators need: events
become notes, order lines become symbols on pages, suppliers become small page images. Every row counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.music import midi_to_name
from ..operators import engraver, kernels

DURATIONS = [0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0]
WIDTH, HEIGHT = 40, 48
SPACE = 14.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("page_id"))
    duration = F.get(F.array(*(F.lit(d) for d in DURATIONS)), (F.col("event_id") % 7).cast("int"))
    return e.withColumns({"duration": duration, "midi": (21 + F.col("event_id") % 88).cast("int")})


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, id, emit_seq, midi, start, duration, hand, confidence, measure, diatonic, explicit_alter."""
    order = Window.partitionBy("page_id").orderBy("ts", "event_id")
    start = F.coalesce(F.sum("duration").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) * 0.5
    e = _events(spark, sf_dir).withColumns({"emit_seq": (F.row_number().over(order) - 1).cast("long"), "start": start})
    n = F.col("event_id")
    return e.select(
        "page_id", F.concat(F.lit("n"), n.cast("string")).alias("id"), "emit_seq", "midi", "start", "duration",
        F.when(F.col("midi") < 60, "left").otherwise("right").alias("hand"), ((n % 101) / 100.0).alias("confidence"),
        F.floor(F.col("start") / 4).cast("int").alias("measure"),
        F.when(n % 5 != 0, 20 + n % 30).cast("int").alias("diatonic"), F.when(n % 4 == 0, n % 3 - 1).cast("int").alias("explicit_alter"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, title, measures, beats, beat_type, tempo, fifths: one score for each page of notes."""
    found = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page_id")).agg(F.count("*").alias("n"))
    page = F.col("page_id")
    return found.select(
        "page_id", F.concat(F.lit("Piece No. "), page.cast("string"), F.lit(" (draft)")).alias("title"), (F.floor(F.col("n") / 4) + 1).cast("long").alias("measures"),
        F.lit(4).alias("beats"), F.lit(4).alias("beat_type"), (60 + page % 100).cast("int").alias("tempo"), (page % 15 - 7).cast("int").alias("fifths"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, hand, spec: each page's events as compact text, odd events for the left hand."""
    n = F.col("event_id")
    second = midi_to_name((21 + (n * 7) % 88).cast("int"))
    pitches = F.when(n % 11 == 0, "r").otherwise(F.concat(midi_to_name(F.col("midi")), F.when(n % 5 == 0, F.concat(F.lit("+"), second)).otherwise("")))
    token = F.concat(pitches, F.when(F.col("duration") == 1, "").otherwise(F.concat(F.lit("/"), F.col("duration").cast("string"))))
    e = _events(spark, sf_dir).select("page_id", F.when(n % 2 == 0, "right").otherwise("left").alias("hand"), F.struct("ts", n.alias("event_id"), token.alias("token")).alias("t"))
    return e.groupBy("page_id", "hand").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["token"]), " ").alias("spec"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, blob_id, x0, y0, x1, y1, width, height, area, space, and the order line's part and supplier."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part, supplier, i = F.col("l_partkey"), F.col("l_suppkey"), F.col("blob_id")
    b = table(spark, sf_dir, "lineitem").withColumn("blob_id", (F.row_number().over(order) - 1).cast("long")).select(
        F.col("l_orderkey").alias("page_id"), "blob_id", part.alias("part"), supplier.alias("supplier"), ((part * 7 + i * 53) % 600).alias("x0"), ((supplier * 13 + i * 37) % 300).alias("y0"),
        (2 + (F.col("l_quantity").cast("long") * 3 + part) % 30).alias("width"), (2 + (part * 5 + supplier) % 75).alias("height"),
    )
    area = (1 + F.floor(F.col("width") * F.col("height") * ((F.col("supplier") + i) % 10) / 10)).cast("long")
    return b.withColumns({"x1": F.col("x0") + F.col("width") - 1, "y1": F.col("y0") + F.col("height") - 1, "area": area, "space": F.lit(SPACE)})


def staves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, staff, top, bottom, left, right, lines, system, index_in_system: two staves for each order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_custkey"), F.explode(F.array(F.lit(0), F.lit(1))).alias("staff"))
    top = (60 + F.col("staff") * 130 + F.col("o_custkey") % 20).cast("double")
    return o.select(
        "page_id", "staff", top.alias("top"), (top + 4 * SPACE).alias("bottom"), F.lit(20.0).alias("left"), F.lit(580.0).alias("right"),
        F.array(*(top + i * SPACE for i in range(5))).alias("lines"), F.lit(0).alias("system"), F.col("staff").alias("index_in_system"),
    )


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, head_id, cx, cy, space, filled, stem, beams, dotted: a head beside each symbol."""
    b = blobs(spark, sf_dir)
    part, supplier, i = F.col("part"), F.col("supplier"), F.col("blob_id")
    return b.select(
        "page_id", i.alias("head_id"), (F.col("x1") + 2 + part % 30).cast("double").alias("cx"), ((F.col("y0") + F.col("y1")) / 2 + supplier % 31 - 15).alias("cy"), "space",
        (part % 3 != 0).alias("filled"), F.when(supplier % 4 == 0, F.lit(None).cast("string")).when(supplier % 4 == 1, "down").otherwise("up").alias("stem"),
        (part % 5).cast("int").alias("beams"), (supplier % 7 == 0).alias("dotted"),
    )


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, width, height: a small page for each supplier."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, x, y, ink, g of every pixel: five lines, a block, and specks on three pages of four."""
    p = page_images(spark, sf_dir).select("page_id", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))))
    k, x, y = F.col("page_id"), F.col("x"), F.col("y")
    from_top = y - 8 - k % 3
    line = from_top.between(0, 24) & (F.pmod(from_top, F.lit(6)) == 0) & x.between(2, 37)
    block = x.between(5 + k % 20, 11 + k % 20) & y.between(10 + (k * 7) % 20, 14 + (k * 7) % 20)
    speck = (x * 73 + y * 151 + k * 31) % 97 < k % 4
    ink = (line | block | speck).cast("int")
    return p.select("page_id", "x", "y", ink.alias("ink"), (250 - 180 * ink - (x * 5 + y * 3 + k) % 20).cast("int").alias("g"))


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, width, height, ink, grey: the pages of ``pixels`` as a row each, their bytes in row-major order."""
    x, y = np.arange(WIDTH), np.arange(HEIGHT)[:, None]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, kernels.TOGETHER):
                part = batch.slice(at, kernels.TOGETHER)
                k = part.column("page_id").to_numpy()[:, None, None]
                rest = lambda v, n: np.fmod(v, n)  # noqa: E731  the sign is that of v, as in SQL
                from_top = y - 8 - rest(k, 3)
                line = (from_top >= 0) & (from_top <= 24) & (from_top % 6 == 0) & (x >= 2) & (x <= 37)
                left, top = 5 + rest(k, 20), 10 + rest(k * 7, 20)
                block = (x >= left) & (x <= left + 6) & (y >= top) & (y <= top + 4)
                ink = (line | block | (rest(x * 73 + y * 151 + k * 31, 97) < rest(k, 4))).astype(np.uint8)
                grey = (250 - 180 * ink.astype(np.int64) - rest(x * 5 + y * 3 + k, 20)).astype(np.uint8)
                whole = lambda pages: pa.array([p.tobytes() for p in pages], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "width", "height")), whole(ink), whole(grey)], names=["page_id", "width", "height", "ink", "grey"])

    pages = kernels.dealt(page_images(spark, sf_dir))
    return pages.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, width int, height int, ink binary, grey binary")


#: Drawn pages: events of a page, its size, its staves' space, and where systems, bars and notes are put.
PER_PAGE, PAGE_WIDTH, PAGE_HEIGHT, PAGE_SPACE = 24, 1500, 760, 22.0
PAGE_LEFT, PAGE_RIGHT = 70.0, 1430.0


def drawn_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, system, bar, hand, top (of the staff), step, x, value, dotted, kind: every event as a note on a page.

    A user's events fill pages of two systems with four bars of three places each; odd events stand on the lower staff."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    # Events are few bytes and each a note to draw, so they are dealt by number, not by size.
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id")
    e = events.select("event_id", "user_id", (F.row_number().over(order) - 1).alias("i"))
    n, i = F.col("event_id"), F.col("i") % PER_PAGE
    system, bar = F.floor(i / 12).cast("int"), (F.floor(i / 3) % 4).cast("int")
    value = F.get(F.array(*(F.lit(v) for v in (1.0, 2.0, 0.5, 4.0))), (F.floor(n / 2) % 4).cast("int"))
    kind = F.get(F.array(F.lit("sharp"), F.lit("flat"), F.lit("natural")), (n % 7).cast("int"))
    lower = n % 2 == 1
    return e.select(
        (F.col("user_id") * 1000 + F.floor(F.col("i") / PER_PAGE)).alias("page_id"), system.alias("system"), bar.alias("bar"), F.when(lower, "left").otherwise("right").alias("hand"),
        (80 + system * 400 + F.when(lower, 7 * PAGE_SPACE).otherwise(0)).cast("double").alias("top"), (n * 5 % 9).cast("int").alias("step"),
        (240 + bar * 305 + i % 3 * 85).cast("double").alias("x"), value.alias("value"), ((value == 2) & (n % 3 == 0)).alias("dotted"), kind.alias("kind"),
    )


def drawn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, width, height of the pages of ``drawn_notes``."""
    of_user = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    each = of_user.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PER_PAGE))).alias("k"), "user_id")
    return each.select((F.col("user_id") * 1000 + F.col("k")).alias("page_id"), F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height"))


def drawn_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, shape: the staves, clefs, barlines and notes of every drawn page."""
    space, left, right = F.lit(PAGE_SPACE), F.lit(PAGE_LEFT), F.lit(PAGE_RIGHT)
    note = drawn_notes(spark, sf_dir)
    top, step, x = F.col("top"), F.col("step"), F.col("x")
    signs = engraver.accidental(top, space, step, x - space * 1.6, F.col("kind"))
    notes = note.select("page_id", F.explode(F.concat(engraver.note(top, space, step, x, F.col("value"), F.col("dotted")), signs)).alias("shape"))
    parts = []
    for system in (0, 1):
        for treble in (True, False):
            at = F.lit(80.0 + system * 400 + (0 if treble else 7 * PAGE_SPACE))
            bars = [engraver.barline(at, space, F.lit(210.0 + bar * 305 + 285)) for bar in range(3)]
            parts += [engraver.staff(at, left, right, space), engraver.clef(at, left, space, F.lit(treble)), *bars]
    furniture = drawn_pages(spark, sf_dir).select("page_id", F.explode(F.concat(*parts)).alias("shape"))
    return furniture.unionByName(notes)
