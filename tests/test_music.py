import struct

from pyspark.sql import functions as F

from partita.functions import folds, music, rounding
from partita.operators import score, transport
from partita.sources import library, midi, shorthand


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rounding(spark):
    rows = spark.createDataFrame([(x,) for x in (-2.5, -1.5, -0.5, 0.5, 1.5, 2.5)], "x double")
    assert [r[0] for r in rows.select(rounding.half_up(F.col("x"))).collect()] == [-2, -1, 0, 1, 2, 3]
    assert [r[0] for r in rows.select(rounding.byte_clamped(F.col("x"))).collect()] == [0, 0, 0, 0, 2, 2]
    assert one(spark, rounding.byte_clamped(F.lit(300.0)))[0] == 255


def test_pitch(spark):
    got = one(
        spark, music.diatonic_to_midi(F.lit(28), F.lit(0)), music.diatonic_to_midi(F.lit(-1), F.lit(0)), music.name_to_midi(F.lit("F#3")), music.name_to_midi(F.lit("Bb5")),
        music.name_to_midi(F.lit("H2")), music.midi_to_name(F.lit(61)), music.midi_to_name(F.lit(61), flats=True), music.midi_to_hz(F.lit(69)),
    )
    assert tuple(got) == (60, 11, 54, 82, None, "C#4", "Db4", 440.0)


def test_key_alteration(spark):
    f = lambda n, letter: one(spark, music.key_alteration(F.lit(n), F.lit(letter)))[0]
    assert [f(1, 3), f(1, 0), f(-1, 6), f(-2, 2), f(9, 6), f(-9, 3), f(0, 3)] == [1, 0, -1, -1, 1, -1, 0]


def test_variable_length(spark):
    cases = {0: "00", 127: "7F", 128: "8100", 16383: "FF7F", 16384: "818000", 2097151: "FFFF7F", 2097152: "81808000"}
    rows = spark.createDataFrame([(k,) for k in cases], "n long").select("n", midi.variable_length(F.col("n")).alias("h")).collect()
    assert {r["n"]: r["h"] for r in rows} == cases

    def back(h):
        n = 0
        for b in bytes.fromhex(h):
            n = n << 7 | b & 127
        return n

    assert all(back(r["h"]) == r["n"] for r in rows)


def test_anchored_groups_differ_from_chains(spark):
    xs = F.array(*(F.struct(F.lit(float(v)).alias("x")) for v in (0, 5, 9, 11, 30)))
    got = one(spark, folds.anchored_groups(xs, "x", F.lit(8.0), "struct<x:double>"))[0]
    assert [r["g"] for r in got] == [0, 0, 1, 1, 2]
    assert one(spark, folds.spaced(F.array(*(F.lit(float(v)) for v in (0, 11, 22))), F.lit(16.8)))[0] == [0.0, 22.0]


def test_shorthand(spark):
    lines = spark.createDataFrame([(1, "right", " E4 E4+C4/2  r/0.5 F#4 "), (1, "left", "C3/4")], "page_id long, hand string, spec string")
    notes, pieces = shorthand.build(lines)
    got = [(r["hand"], r["midi"], r["start"], r["duration"]) for r in notes.orderBy("position").collect()]
    assert got == [("left", 48, 0.0, 4.0), ("right", 64, 0.0, 1.0), ("right", 60, 1.0, 2.0), ("right", 64, 1.0, 2.0), ("right", 66, 3.5, 1.0)]
    assert [(r["length"], list(r["measures"])) for r in pieces.collect()] == [(4.5, [0, 4])]


def test_midi_order_of_a_repeated_pitch(spark):
    notes = spark.createDataFrame([(1, "a", 0, 60, 0.0, 1.0, "right"), (1, "b", 1, 60, 1.0, 1.0, "left")], "page_id long, id string, emit_seq long, midi int, start double, duration double, hand string")
    scores = spark.createDataFrame([(1, 120, 4, 4)], "page_id long, tempo int, beats int, beat_type int")
    e = midi.events(score.ordered(notes), scores)
    assert [(r["tick"], r["delta"], r["data"]) for r in e.orderBy("seq").collect()] == [
        (0, 0, "FF510307A120"), (0, 0, "FF580404021808"), (0, 0, "903C58"), (480, 480, "803C00"), (480, 0, "913C48"), (960, 480, "813C00"),
    ]
    data = bytes(midi.files(e).first()["bytes"])
    assert data[:4] == b"MThd" and struct.unpack(">IHHH", data[4:14]) == (6, 0, 1, 480)
    assert struct.unpack(">I", data[18:22])[0] == len(data) - 22 and data.endswith(b"\x00\xff\x2f\x00")


NOTE = "page_id long, id string, midi int, start double, duration double, hand string, confidence double, measure int, diatonic int, explicit_alter int"


def test_editing(spark):
    notes = spark.createDataFrame(
        [(1, "plain", 65, 0.0, 1.0, "right", 0.5, 0, 31, None), (1, "sharp", 66, 1.0, 1.0, "right", 0.5, 0, 31, 1), (1, "edited", 107, 2.0, 1.0, "right", 1.0, 0, None, None)], NOTE
    )
    keyed = {r["id"]: r["midi"] for r in score.rekey(notes, F.lit(1)).collect()}
    assert keyed == {"plain": 66, "sharp": 66, "edited": 107}
    moved = spark.createDataFrame([(1, "edited", 5), (1, "nobody", 1)], "page_id long, id string, semitones int")
    assert {r["id"]: r["midi"] for r in score.nudge(notes, moved).collect()}["edited"] == 108
    patched = score.patch(notes, spark.createDataFrame([(1, "plain", 9.0)], "page_id long, id string, start double"))
    r = patched.where("id = 'plain'").first()
    assert (r["start"], r["measure"], r["confidence"], r["midi"]) == (9.0, 0, 1.0, 65)
    left, boxes = score.delete(notes, notes.select("page_id", F.col("id").alias("note_id")), notes.select("page_id", "id").where("id = 'sharp'"))
    assert left.count() == boxes.count() == 2
    none = score.pitch_range(notes.limit(0), spark.createDataFrame([(1,)], "page_id long")).first()
    assert (none["low"], none["high"]) == (48, 84)
    same = score.ordered(notes.withColumn("emit_seq", F.lit(0)))
    again = score.ordered(same.drop("position"))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, again.collect()))


def test_sounding_has_an_epsilon_at_the_start(spark):
    notes = spark.createDataFrame([(1, "a", 1.0, 1.0), (1, "b", 2.0, 0.5)], "page_id long, id string, start double, duration double")
    beats = spark.createDataFrame([(1, b) for b in (0.9999995, 0.99, 1.9999995, 2.0, 2.5)], "page_id long, beat double")
    got = sorted((r["beat"], r["id"]) for r in transport.sounding_at(notes, beats).collect())
    assert got == [(0.9999995, "a"), (1.9999995, "a"), (1.9999995, "b"), (2.0, "b")]


def test_loop_with_a_fractional_start(spark):
    notes = spark.createDataFrame([(1, "a", 0.5, 1.0), (1, "b", 1.0, 1.0), (1, "c", 2.0, 1.0)], "page_id long, id string, start double, duration double")
    got = sorted((r["at"], r["id"]) for r in transport.looped(notes, F.lit(0.75), F.lit(2.25), 2).collect())
    assert got == [(0.25, "b"), (1.25, "c"), (1.75, "b"), (2.75, "c")]


def test_library(spark):
    schema = "owner long, id string, title string, created_at long, notes long"
    for n in (24, 25):
        pieces = spark.createDataFrame([(1, f"p{i:02}", "t", i, 0) for i in range(n)], schema)
        got = library.upsert(pieces, spark.createDataFrame([(1, "p03", "again", 99, 1)], schema)).orderBy("place").collect()
        assert len(got) == 24 and got[0]["id"] == "p03" and got[0]["title"] == "again" and got[-1]["id"] == ("p00" if n == 24 else "p01")
    texts = spark.createDataFrame([(None,), ("",), ("{}",), ("[broken",), ('[{"id":"a","title":null}]',)], "t string")
    assert [len(r[0]) for r in texts.select(library.read(F.col("t"))).collect()] == [0, 0, 0, 0, 1]
    assert (library.over_quota(24), library.over_quota(1)) == (12, 1)
    js = library.written_json(library.limited(spark.createDataFrame([(1, "a", None, 1, 0)], schema))).first()["json"]
    assert '"title":null' in js
