import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from partita.operators import transport
from partita.plans.recognize import recognize_pages
from partita.sources import images
from partita.streaming import pages
from partita.streaming import pages as read_pages


def test_files_arrive_and_ticks_book_notes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.png").write_bytes(b"x" * (i + 1))
    (tmp_path / "in" / "note.txt").write_bytes(b"no page")
    query = pages.arriving_files(spark, str(tmp_path / "in")).select("page_id", "size").writeStream.format("memory").queryName("arrived").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["size"] for r in spark.table("arrived").collect()) == [1, 2, 3]

    notes = spark.createDataFrame([(1, "a", 0.0, 1.0, "right"), (1, "b", 1.0, 1.0, "right")], "page_id long, id string, start double, duration double, hand string")
    plan = transport.schedule(notes, F.lit(60), F.lit(0.0), F.lit(9.0), [])
    assert {r["id"]: r["batch"] for r in plan.collect()} == {"a": 0, "b": 37}
    ticks = [(1, t) for t in range(60)]
    spark.createDataFrame(ticks, "page_id long, tick long").write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema("page_id long, tick long").parquet(str(tmp_path / "ticks"))
    query = pages.due(stream, plan).select("id", "tick").writeStream.format("memory").queryName("booked").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("booked").collect())) == [("a", 0), ("b", 37)]


def drawn_page(steps):
    """A page of one staff with a treble clef and quarter notes, as grey bytes."""
    page = np.full((230, 420), 255, np.uint8)
    y, x = np.mgrid[:230, :420]
    for i in range(5):
        page[90 + 14 * i : 92 + 14 * i, 30:390] = 20
    page[68:169, 37:50] = 20
    for i, step in enumerate(steps):
        cx, cy = 150 + 60 * i, 146 - 7 * step
        page[((x - cx) / 9.1) ** 2 + ((y - cy) / 6.72) ** 2 <= 1] = 20
        page[cy - 46 : cy, cx + 7 : cx + 9] = 20
    return page


def test_arriving_files_are_read_once_each_though_a_batch_fails(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()
    for i, steps in enumerate(([0, 2], [1])):
        (folder / f"{i}.png").write_bytes(images.encode_png(drawn_page(steps)))
    (folder / "bad.png").write_bytes(images.encode_png(drawn_page([0]))[:200])

    def fails_late(pages):
        notes, results = recognize_pages(pages)
        notes.write.mode("overwrite").parquet(f"{out}/notes/batch=0")  # as if the driver was lost after the first write
        raise RuntimeError("lost")

    def run(read):
        query = read_pages.read_arrivals(read_pages.arriving_files(spark, str(folder)), out, checkpoint, read).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(StreamingQueryException):
        run(fails_late)
    run(recognize_pages)
    names = lambda df: df.withColumn("file", F.element_at(F.split("page_id", "/"), -1))
    notes = names(spark.read.parquet(f"{out}/notes")).orderBy("file", "start")
    assert [(r["file"], r["midi"], r["start"]) for r in notes.collect()] == [("0.png", 64, 0.0), ("0.png", 67, 1.0), ("1.png", 65, 0.0)]
    pages = names(spark.read.parquet(f"{out}/pages")).orderBy("file")
    assert [(r["file"], r["n_notes"], r["problem"]) for r in pages.collect()] == [("0.png", 2, None), ("1.png", 1, None), ("bad.png", None, "cut short or damaged")]
    # A file that arrives later is the next batch's alone.
    (folder / "late.png").write_bytes(images.encode_png(drawn_page([4])))
    run(recognize_pages)
    assert sorted(r["file"] for r in names(spark.read.parquet(f"{out}/pages")).collect()) == ["0.png", "1.png", "bad.png", "late.png"]
    assert names(spark.read.parquet(f"{out}/notes")).where("file = 'late.png'").first()["midi"] == 71
