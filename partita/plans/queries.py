"""One query for each operator or small family, over the views of ``plans.views``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import music
from ..operators import assembly, components, display, kernels, noteheads, pixels, score, symbols, synthesis, transport
from ..operators.tables import written
from ..sources import images, library, midi, shorthand
from . import views
from .recognize import recognize_drawn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def event_number() -> Column:
    """The event that a note of the view was made of."""
    return F.substring("id", 2, 20).cast("long")


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in names})


def doubles(df: DataFrame, *names: str) -> DataFrame:
    """Whole numbers that may be null, as doubles."""
    return df.withColumns({c: F.col(c).cast("double") for c in names})


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), n) for c, n in digits.items()})


@query
def music_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.notes(spark, sf_dir)
    fifths = (F.col("emit_seq") % 15 - 7).cast("int")
    step = F.coalesce("diatonic", F.lit(28))
    letter = music.letter_of(step)
    sharp = music.midi_to_name(F.col("midi"))
    named = n.join(F.broadcast(music.key_names(spark)), F.col("fifths") == fifths)
    name = F.get(F.array(*(F.lit(x) for x in music.LETTERS)), letter)
    return longs(
        named.select(
            "id", sharp.alias("sharp_name"), music.midi_to_name(F.col("midi"), flats=True).alias("flat_name"), music.name_to_midi(sharp).alias("back"),
            F.round(music.midi_to_hz(F.col("midi")), 6).alias("hz"), music.is_black(F.col("midi")).alias("black"), music.key_alteration(fifths, letter).alias("alteration"),
            music.diatonic_to_midi(step, F.coalesce("explicit_alter", F.lit(0))).alias("from_diatonic"), name.alias("letter"),
            music.diatonic_of(name, music.octave_of(step)).alias("diatonic_again"),
            music.clef_bottom(F.when(F.col("hand") == "left", "bass").otherwise("treble")).alias("bottom_line"), F.col("label").alias("key_name"),
        ),
        "back", "alteration", "from_diatonic", "diatonic_again", "bottom_line",
    )


@query
def shorthand_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(shorthand.parse(views.lines(spark, sf_dir)), "token", "voice", "midi", "measure")


@query
def piece_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes, pieces = shorthand.build(views.lines(spark, sf_dir))
    counted = notes.groupBy("page_id").agg(F.count("*").alias("n_notes"), F.min_by("midi", "position").cast("long").alias("first_midi"))
    return pieces.join(counted, "page_id", "left").select(
        "page_id", "length", F.size("measures").cast("long").alias("n_measures"), F.element_at("measures", -1).cast("long").alias("last_measure"), "n_notes", "first_midi"
    )


@query
def measure_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.notes(spark, sf_dir).withColumns({"staff": F.col("emit_seq") % 2, "measure": F.floor(F.col("emit_seq") / 8), "x": F.col("emit_seq") * 10.0})
    return assembly.onsets(e, F.lit(4.0)).select("page_id", "id", "staff", "measure", "onset")


@query
def system_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.blobs(spark, sf_dir).select("page_id", (F.col("blob_id") % 2).cast("int").alias("staff"), F.col("x0").alias("x"))
    found = assembly.measures_in_system(bars, views.staves(spark, sf_dir))
    return assembly.measure_bases(found).select("page_id", "measures", "base")


@query
def chord_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = views.heads(spark, sf_dir).select("page_id", F.col("head_id").alias("id"), "cx", ((F.col("beams") + 1) * 0.5).alias("duration"), "space")
    return longs(rounded(assembly.chords(h, F.col("space") * 0.6, ["page_id"]), x=6), "chord", "members")


@query
def barline_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = symbols.centre(views.blobs(spark, sf_dir)).select("page_id", (F.col("blob_id") % 2).alias("staff"), F.col("cx").alias("x"), "space")
    return symbols.merged(lines)


@query
def barline_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(symbols.barlines(views.blobs(spark, sf_dir), views.staves(spark, sf_dir)), "staff")


@query
def event_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = views.blobs(spark, sf_dir).select("page_id", F.col("x0").alias("bound")).distinct()
    events = views.heads(spark, sf_dir).select("page_id", "head_id", F.col("cx").alias("x"))
    return longs(assembly.bucketed(events, bounds), "bucket")


@query
def nearest_staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = symbols.nearest_staff(views.blobs(spark, sf_dir), views.staves(spark, sf_dir))
    return longs(near.select("page_id", "blob_id", "staff", "distance", assembly.staff_step(F.col("cy"), F.col("top"), F.col("bottom")).alias("step")), "staff", "step")


@query
def accidental_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.blobs(spark, sf_dir)
    kind = symbols.accidental_kind(F.col("width"), F.col("height"), F.col("part") % 10 / 10.0, F.col("supplier") % 10 / 10.0, F.col("blob_id") % 3 / 3.0)
    found = symbols.accidentals(views.heads(spark, sf_dir), b.withColumn("kind", kind))
    return doubles(found.select("page_id", "head_id", "blob_id", "kind"), "blob_id")


@query
def rest_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.blobs(spark, sf_dir)
    used = b.where(F.col("blob_id") % 4 == 0).select("page_id", "blob_id")
    return longs(symbols.rests(b, views.staves(spark, sf_dir), used), "staff")


@query
def clef_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.staves(spark, sf_dir).withColumn("space", F.lit(views.SPACE))
    return longs(doubles(symbols.clefs(views.blobs(spark, sf_dir).drop("space"), s), "clef_blob"), "staff")


@query
def header_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, s = views.blobs(spark, sf_dir).drop("space"), views.staves(spark, sf_dir).withColumn("space", F.lit(views.SPACE))
    return longs(rounded(symbols.header_ends(b, s, symbols.clefs(b, s)), header_end=6), "staff")


@query
def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"))
    return longs(rounded(assembly.page_confidence(views.notes(spark, sf_dir), pages), confidence=6), "n_notes")


@query
def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of pages with notes, with staves alone, without staves, and of those that were straightened."""
    page, notes = F.col("page_id"), views.notes(spark, sf_dir)
    pages = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"))
    ends = notes.groupBy("page_id").agg(F.max(F.col("start") + F.col("duration")).alias("end"))
    counted = pages.where(page % 4 != 0).join(ends, "page_id", "left").select("page_id", (page % 4).alias("n_staves"), (1 + page % 23).alias("n_measures"), "end")
    angles = pages.select("page_id", (page % 49 * 0.25 - 6).alias("angle"))
    kept = notes.join(pages.where(page % 4 != 0), "page_id", "left_semi")
    found = assembly.page_results(kept, counted, pages, angles, F.lit(4)).withColumns({"measures": F.size("measures").cast("long"), "last": F.element_at("measures", -1), "messages": F.array_join("messages", " ")})
    return rounded(found, confidence=6)


@query
def head_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = assembly.base_duration(F.col("stem"), F.col("filled"), F.col("beams"))
    return views.heads(spark, sf_dir).select("page_id", "head_id", assembly.note_duration(base, F.col("dotted")).alias("duration"))


def _edited(notes: DataFrame) -> DataFrame:
    return longs(doubles(notes.select(*score.NOTE), "diatonic", "explicit_alter"), "midi", "measure")


@query
def score_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = score.ordered(views.notes(spark, sf_dir))
    found = notes.groupBy("page_id").agg(F.min_by("id", "position").alias("first_id"), F.count("*").alias("n_notes"))
    return score.lengths(notes, views.scores(spark, sf_dir)).join(found, "page_id").select("page_id", "length", "first_id", "n_notes")


@query
def score_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = views.notes(spark, sf_dir)
    patches = notes.where(event_number() % 10 == 3).select("page_id", "id", (F.col("start") + 1.5).alias("start"), F.when(event_number() % 20 == 3, 2.0).alias("duration"))
    return _edited(score.patch(notes, patches))


def _detections(notes: DataFrame) -> DataFrame:
    box = assembly.detection_box(F.col("emit_seq") * 20.0, F.col("midi") * 3.0, F.lit(views.SPACE))
    return notes.select("page_id", F.col("id").alias("note_id"), *box)


@query
def score_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = views.notes(spark, sf_dir)
    left, boxes = score.delete(notes, _detections(notes), notes.where(event_number() % 7 == 2).select("page_id", "id"))
    boxes = boxes.groupBy("page_id").agg(F.count("*").alias("n_detections"))
    return left.groupBy("page_id").agg(F.count("*").alias("n_notes"), F.sum("midi").alias("midi_sum")).join(boxes, "page_id")


@query
def score_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = views.scores(spark, sf_dir).select("page_id", F.concat(F.lit("e"), F.col("page_id").cast("string")).alias("id"), F.lit(60).alias("midi"), (F.col("measures") * 2.5).alias("start"), F.lit("right").alias("hand"))
    return _edited(score.add(views.notes(spark, sf_dir), added, F.lit(4)))


@query
def score_nudge(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = views.notes(spark, sf_dir)
    moves = notes.where(event_number() % 6 == 1).select("page_id", "id", (event_number() % 25 - 12).alias("semitones"))
    return _edited(score.nudge(notes, moves))


@query
def score_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = views.scores(spark, sf_dir).select("page_id", "fifths")
    return _edited(score.rekey(views.notes(spark, sf_dir).join(keys, "page_id"), F.col("fifths")))


@query
def pitch_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"))
    return longs(score.pitch_range(views.notes(spark, sf_dir), pages), "low", "high")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return views.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("owner"), F.concat(F.lit("p"), key.cast("string")).alias("id"), F.concat(F.lit("T"), key.cast("string")).alias("title"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at"), (key % 90).alias("notes"),
    )


@query
def library_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _pieces(spark, sf_dir)
    saved = pieces.where("notes % 9 = 0").withColumns({"title": F.concat("title", F.lit(" again")), "created_at": F.lit(2_000_000_000_000) + F.col("notes")})
    return longs(library.upsert(pieces, saved), "place")


@query
def library_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _pieces(spark, sf_dir)
    ids = pieces.where(F.substring("id", 2, 20).cast("long") % 13 == 4).select("owner", "id")
    return library.delete(pieces, ids).groupBy("owner").agg(F.count("*").alias("n"))


@query
def library_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of every kind: one piece, no JSON, no array, two pieces."""
    n = F.col("event_id")
    piece = lambda c: F.concat(F.lit(f'{{"id":"{c}'), n.cast("string"), F.lit('","title":null,"created_at":1,"notes":3}'))
    text = F.element_at(F.array(F.concat(F.lit("["), piece("a"), F.lit("]")), F.lit("[{oops"), piece("a"), F.concat(F.lit("["), piece("b"), F.lit(","), piece("c"), F.lit("]"))), (n % 4 + 1).cast("int"))
    found = views.table(spark, sf_dir, "events").select("event_id", library.read(text).alias("p"))
    return found.select("event_id", F.size("p").cast("long").alias("n_pieces"), F.get("p", F.lit(0))["id"].alias("first_id"))


@query
def library_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.written_json(library.limited(_pieces(spark, sf_dir)))


def _midi_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return midi.events(score.ordered(views.notes(spark, sf_dir)), views.scores(spark, sf_dir))


@query
def midi_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _midi_events(spark, sf_dir)


@query
def midi_vlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = views.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7919 % 2_500_000).alias("value"))
    return values.withColumn("hex", midi.variable_length(F.col("value")))


@query
def midi_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return midi.files(_midi_events(spark, sf_dir)).select("page_id", F.hex("bytes").alias("hex"))


@query
def sounding_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = views.notes(spark, sf_dir)
    return longs(transport.sounding_at(notes, transport.beats_of(notes)).select("page_id", "beat", "id", "midi"), "midi")


@query
def sounding_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = views.notes(spark, sf_dir)
    return transport.sounding_changes(transport.sounding_at(notes, transport.beats_of(notes)))


@query
def hit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = views.notes(spark, sf_dir)
    clicks = notes.select("page_id", event_number().alias("click_id"), "midi", (F.col("start") + event_number() % 5 - 1).alias("beat"))
    return display.hit_test(notes, clicks).select("page_id", "click_id", "id")


@query
def detection_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = views.notes(spark, sf_dir)
    found = display.overlay(_detections(notes), notes.where(event_number() % 9 != 0), F.lit(10.25))
    return longs(rounded(found.select("page_id", "note_id", "midi", "x", "y", "w", "h", "live"), x=6, y=6, w=6, h=6), "midi")


@query
def schedule_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = views.notes(spark, sf_dir).join(views.scores(spark, sf_dir).select("page_id", "tempo"), "page_id")
    found = transport.schedule(notes, F.col("tempo"), F.lit(2.0), F.lit(34.0), ["left"])
    return rounded(found.select("page_id", "id", "when", "until", "velocity", "batch"), when=9, until=9)


@query
def play_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where playing is, and its bar, half a note's beats in seconds after each note's start."""
    n = views.notes(spark, sf_dir).join(views.scores(spark, sf_dir).select("page_id", "tempo"), "page_id")
    at = transport.position(F.col("start"), F.col("duration") / 2, F.col("tempo"))
    return n.select("page_id", "id", F.round(at, 6).alias("beat"), F.floor(at / 4).cast("long").alias("bar"))


@query
def metronome(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.scores(spark, sf_dir).withColumn("end", (F.col("measures") * 4).cast("double"))
    return rounded(transport.clicks(pages, F.col("tempo"), F.lit(1.5), F.col("end"), F.lit(4), F.lit(4)), at=6)


@query
def loop_unroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(transport.looped(views.notes(spark, sf_dir), F.lit(1.5), F.lit(8.0), 3).select("page_id", "id", "pass", "at"), "pass")


@query
def partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    velocity = F.when(F.col("hand") == "left", 0.62).otherwise(0.78)
    found = synthesis.partials(views.notes(spark, sf_dir), velocity).select("id", "n", "hz", "level", "decay", "cents")
    return longs(rounded(found, hz=4, level=6, decay=6, cents=6), "n")


@query
def keyboard_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = views.notes(spark, sf_dir).groupBy("page_id").agg(F.min("midi").alias("low"), F.max("midi").alias("high"))
    return longs(display.keyboard(ranges), "midi")


@query
def key_tints(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.when(event_number() % 7 != 0, F.col("hand"))
    black = music.is_black(F.col("midi"))
    return views.notes(spark, sf_dir).select("page_id", "id", display.key_tint(black, held, event_number() % 3 == 0).alias("tint"))


@query
def roll_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"))
    return longs(display.roll_bounds(views.notes(spark, sf_dir), pages), "low", "high")


@query
def beat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.notes(spark, sf_dir).groupBy("page_id").agg(F.max(F.col("start") + F.col("duration")).alias("length"))
    return display.beat_grid(pages, F.col("length"), 3 + F.col("page_id") % 2)


@query
def library_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(display.library_list(library.limited(_pieces(spark, sf_dir))), "place")


@query
def library_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = library.within_quota(_pieces(spark, sf_dir), F.col("owner") % 3 == 0)
    return longs(kept.select("owner", "id", "place"), "place")


@query
def strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = views.notes(spark, sf_dir).join(views.scores(spark, sf_dir).select("page_id", "tempo"), "page_id")
    when = F.col("start") * 60 / F.col("tempo")
    found = synthesis.strikes(notes, when, when + F.col("duration") / 100, F.when(F.col("hand") == "left", 0.62).otherwise(0.78))
    names = ["attack_until", "release_at", "release", "stop_at", "hammer_hz", "hammer_level", "hammer_until"]
    return rounded(found.select("id", *names), **dict.fromkeys(names, 9))


@query
def click_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.scores(spark, sf_dir).withColumn("end", (F.col("measures") * 4).cast("double"))
    clicks = transport.clicks(pages, F.col("tempo"), F.lit(1.5), F.col("end"), F.lit(4), F.lit(0))
    return longs(rounded(synthesis.click_sounds(clicks).select("page_id", "n", "hz", "level", "until"), until=6), "n", "hz")


@query
def loop_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At every note: the loop switched on there, its bars set by steppers, where playing starts, and a start that is moved."""
    notes = views.notes(spark, sf_dir)
    ends = notes.groupBy("page_id").agg(F.max(F.col("start") + F.col("duration")).alias("length"))
    n = notes.join(views.scores(spark, sf_dir).select("page_id", F.col("measures").alias("bars"), "beats"), "page_id").join(ends, "page_id")
    start, end = transport.loop_at(F.col("measure"), F.col("bars"), F.col("beats"), F.col("length"))
    n = n.withColumns({"loop_start": start.cast("double"), "loop_end": end.cast("double"), "bar": F.col("emit_seq") % F.col("bars") + 1})
    first, last = transport.loop_from(F.col("bar"), F.col("beats"), F.col("loop_end")), transport.loop_to(F.col("bar"), F.col("beats"), F.col("loop_start"))
    begin = transport.starts_from(F.col("start") + F.col("duration"), F.col("loop_end"), F.when(event_number() % 2 == 0, F.col("loop_start")))
    found = n.select("page_id", "id", "loop_start", "loop_end", first[0].alias("first_start"), first[1].alias("first_end"), last[0].alias("last_start"), last[1].alias("last_end"), begin.alias("begin"), display.start_moved(F.col("start"), event_number() % 9 - 4).alias("moved"))
    return doubles(found, *found.columns[2:])


@query
def playing_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = views.notes(spark, sf_dir).join(views.scores(spark, sf_dir).select("page_id", "tempo"), "page_id")
    return rounded(transport.stops_at(notes, F.col("tempo"), F.lit(1.5)), at=6)


@query
def roll_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.roll(views.notes(spark, sf_dir), F.lit(8.0), F.lit(24.0), F.lit(12.5)).select("page_id", "id", "live", "unsure")


@query
def transport_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = views.notes(spark, sf_dir).join(views.scores(spark, sf_dir), "page_id")
    snapped, hand = display.at_playhead(F.col("midi"), F.col("start"))
    return longs(
        both.select(
            "page_id", "id", display.effective_tempo(F.col("tempo"), 50 + event_number() % 100).alias("tempo"), display.bar_label(F.col("start"), F.lit(4), F.col("measures")).alias("bar"),
            snapped.alias("snapped"), hand.alias("hand"), display.tempo_clamped(F.col("tempo") * (event_number() % 5)).alias("clamped"), midi.file_name(F.col("title")).alias("file"),
        ),
        "tempo", "bar", "clamped",
    )


def _bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pixels(spark, sf_dir).select("page_id", "x", "y", "ink")


def _ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bitmap(spark, sf_dir).where("ink = 1").drop("ink")


@query
def integral_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(pixels.integral(_bitmap(spark, sf_dir), "ink").select("page_id", "x", "y", "total"), "x", "y", "total")


@query
def page_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(kernels.page_downscaled(views.page_rows(spark, sf_dir), 24), "x", "y", "g")


@query
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = views.pixels(spark, sf_dir).select("page_id", "x", "y", "g")
    return longs(pixels.adaptive_threshold(grey, views.page_images(spark, sf_dir), views.WIDTH, views.HEIGHT), "x", "y", "ink")


@query
def denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(pixels.denoised(_bitmap(spark, sf_dir), views.page_images(spark, sf_dir)), "x", "y", "ink")


@query
def run_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(pixels.scale(_bitmap(spark, sf_dir), views.page_images(spark, sf_dir)), "line_thickness", "staff_space")


@query
def deskew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.skew(_ink(spark, sf_dir), views.page_images(spark, sf_dir))


@query
def deskew_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(kernels.page_straightened(views.page_rows(spark, sf_dir)), "x", "y")


@query
def line_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(rounded(kernels.page_bands(views.page_rows(spark, sf_dir)), center=6, ink=6), "thickness", "left", "right")


@query
def stave_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kernels.page_staves(views.page_rows(spark, sf_dir))
    return longs(rounded(found, top=6, bottom=6, space=6), "staff", "left", "right", "system", "index_in_system")


@query
def line_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(kernels.page_without_lines(views.page_rows(spark, sf_dir)), "x", "y")


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.blobs(components.labelled_runs(_ink(spark, sf_dir), views.page_images(spark, sf_dir)))


@query
def connected_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_blobs(spark, sf_dir).select("page_id", "blob_id", "x0", "y0", "x1", "y1", "area"), "x0", "y0", "x1", "y1", "area")


@query
def window_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ink of a fixed grid of windows on every page."""
    grid = [(i, i % 5 * 8, i // 5 * 12, i % 5 * 8 + 8, i // 5 * 12 + 12) for i in range(20)]
    found = kernels.page_window_fill(views.page_rows(spark, sf_dir), grid)
    return longs(rounded(found, fill=6), "window_id", "sum", "area")


@query
def head_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = views.heads(spark, sf_dir)
    hits = h.select("page_id", F.lit(0).cast("long").alias("blob_id"), "cx", F.col("cy").cast("double").alias("cy"), "space", "filled", (1 - F.col("beams") / 10.0).alias("score"))
    found = noteheads.suppressed(hits.withColumn("shaped", F.col("filled")))
    return longs(rounded(found.select("page_id", "cx", "cy", "score", "rank"), score=6), "rank")


@query
def stem_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    head = F.struct(page.alias("head_id"), (8.0 + page % 20).alias("cx"), (12 + page * 7 % 20).alias("cy"), F.lit(2.0).alias("space"))
    return kernels.page_stems(views.page_rows(spark, sf_dir).withColumn("heads", F.array(head)))


def _masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The symbols of every page and the summed-area tables of their own ink."""
    runs = written(components.labelled_runs(_ink(spark, sf_dir), views.page_images(spark, sf_dir)), "labelled")
    blobs = components.blobs(runs)
    return blobs, components.mask_totals(components.symbol_ink(runs, blobs), blobs)


@query
def symbol_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, totals = _masks(spark, sf_dir)
    return longs(totals, "blob_id", "x", "y", "total")


@query
def head_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every centre with an inked ring in every symbol of every page, and whether a head's shape is around it."""
    blobs, totals = _masks(spark, sf_dir)
    asked = blobs.withColumns({"space": F.lit(6.0), "y_min": F.lit(0.0), "y_max": F.lit(views.HEIGHT - 1.0)})
    found = noteheads.shaped(noteheads.candidates(asked, totals), totals)
    return longs(rounded(found.select("page_id", "blob_id", "px", "py", "score", "filled", "shaped"), score=6), "blob_id", "px", "py")


@query
def beam_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beams beside a stem of either direction, or none, on every page."""
    page = F.col("page_id")
    stem = F.when(page % 3 == 1, "down").when(page % 3 == 2, "up")
    tips = views.page_images(spark, sf_dir).select("page_id", page.alias("head_id"), F.lit(4.0).alias("space"), stem.alias("stem"), (4 + page % 20).alias("stem_x"), (10 + page * 7 % 20).alias("tip"))
    return longs(noteheads.beams(tips, _ink(spark, sf_dir)), "beams")


@query
def dot_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    head = F.struct(page.alias("head_id"), (2.0 + page % 16).alias("cx"), (12 + page * 3 % 20).alias("cy"), F.lit(12.0).alias("space"))
    return kernels.page_dots(views.page_rows(spark, sf_dir).withColumn("heads", F.array(head)))


def drawn_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.engraved(views.drawn_shapes(spark, sf_dir), views.drawn_pages(spark, sf_dir))


def drawn_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn pages, painted grey and levelled."""
    return kernels.engraved_levelled(views.drawn_shapes(spark, sf_dir), views.drawn_pages(spark, sf_dir))


def drawn_read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Notes and summaries of the drawn pages, from grey pages on."""
    return recognize_drawn(views.drawn_shapes(spark, sf_dir), views.drawn_pages(spark, sf_dir))


@query
def engraved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of ink of all events, drawn as notes on pages."""
    return longs(drawn_runs(spark, sf_dir), "fixed", "from", "to", "length")


@query
def level_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of the drawn pages after they were painted, thresholded, cleaned and straightened as whole pages."""
    found = kernels.opened(drawn_level(spark, sf_dir), "across")
    return longs(found.select("page_id", "fixed", "from", "to", "length"), "fixed", "from", "to", "length")


@query
def grey_shear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every small page straightened by an angle of its own, paper coming in from outside."""
    pages = kernels.from_pixels(views.pixels(spark, sf_dir).select("page_id", "x", "y", "g"), views.page_images(spark, sf_dir))
    angles = views.page_images(spark, sf_dir).select("page_id", ((F.col("page_id") % 9 - 4) * 0.75).alias("angle"))
    return longs(kernels.to_pixels(kernels.straightened_grey(pages, angles)), "x", "y", "g")


@query
def image_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every small page as a PNG file in colour, decoded to grey; each fifth file is cut short."""
    g = F.col("g")
    colours = views.pixels(spark, sf_dir).select("page_id", "x", "y", g.alias("red"), ((g * 7 + F.col("x")) % 256).alias("green"), (255 - g).alias("blue"))
    files = images.encoded(kernels.from_pixels(colours, views.page_images(spark, sf_dir), "red", "green", "blue"), 3)
    cut = F.expr("substring(content, 1, case when page_id % 5 = 0 then 40 else length(content) end)")
    found = images.decoded(files.withColumn("content", cut))
    good = kernels.to_pixels(found.where("problem is null"))
    bad = found.where("problem is not null").select("page_id", *(F.lit(None).cast("int").alias(c) for c in ("x", "y", "g")), "problem")
    return doubles(good.withColumn("problem", F.lit(None).cast("string")).unionByName(bad), "x", "y", "g")


@query
def recognize_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes read from the drawn pages, from grey pages on."""
    notes, _ = drawn_read(spark, sf_dir)
    return longs(notes.select("page_id", "staff", "hand", "measure", "start", "duration", "midi", "diatonic", "explicit_alter"), "staff", "measure", "midi", "diatonic", "explicit_alter")


@query
def recognize_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of each drawn page, from grey pages on."""
    _, results = drawn_read(spark, sf_dir)
    # A head scores 0.72 at least; pages of under eight notes are held to 0.7.
    sure = (F.col("confidence") > 0.7).alias("sure")
    return results.select("page_id", "n_notes", "n_staves", F.size("measures").cast("long").alias("measures"), "length", sure, F.array_join("messages", " ").alias("messages"))
