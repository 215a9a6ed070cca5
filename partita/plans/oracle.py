"""DuckDB SQL that gives the same rows as the queries of ``plans.queries``."""

from __future__ import annotations

EVENT = """
ev AS (SELECT event_id, ts, user_id AS page_id, [0.25, 0.5, 1, 1.5, 2, 3, 4][event_id % 7 + 1]::DOUBLE AS duration,
              21 + event_id % 88 AS midi FROM events)"""
NOTE = EVENT + """,
note AS (
  SELECT page_id, 'n' || event_id AS id, row_number() OVER w - 1 AS emit_seq, midi, event_id,
         0.5 * coalesce(sum(duration) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, duration,
         CASE WHEN midi < 60 THEN 'left' ELSE 'right' END AS hand, (event_id % 101) / 100.0 AS confidence,
         CASE WHEN event_id % 5 <> 0 THEN 20 + event_id % 30 END AS diatonic,
         CASE WHEN event_id % 4 = 0 THEN event_id % 3 - 1 END AS explicit_alter
  FROM ev WINDOW w AS (PARTITION BY page_id ORDER BY ts, event_id)),
score AS (SELECT user_id AS page_id, count(*) // 4 + 1 AS measures, 60 + user_id % 100 AS tempo, user_id % 15 - 7 AS fifths
          FROM events GROUP BY user_id)"""
BLOB = """
blob0 AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS i FROM lineitem),
blob1 AS (
  SELECT l_orderkey AS page_id, i AS blob_id, l_partkey AS part, l_suppkey AS supplier, (l_partkey * 7 + i * 53) % 600 AS x0,
         (l_suppkey * 13 + i * 37) % 300 AS y0, 2 + (l_quantity::BIGINT * 3 + l_partkey) % 30 AS width, 2 + (l_partkey * 5 + l_suppkey) % 75 AS height
  FROM blob0),
blob AS (
  SELECT *, x0 + width - 1 AS x1, y0 + height - 1 AS y1, 1 + floor(width * height * ((supplier + blob_id) % 10) / 10)::BIGINT AS area,
         (x0 + x0 + width - 1) / 2.0 AS cx, (y0 + y0 + height - 1) / 2.0 AS cy FROM blob1),
staff AS (
  SELECT o_orderkey AS page_id, s AS staff, (60 + s * 130 + o_custkey % 20)::DOUBLE AS top, (116 + s * 130 + o_custkey % 20)::DOUBLE AS bottom,
         20.0 AS l, 580.0 AS r FROM orders, (VALUES (0), (1)) t(s)),
head AS (
  SELECT page_id, blob_id AS head_id, (x1 + 2 + part % 30)::DOUBLE AS cx, (y0 + y1) / 2.0 + supplier % 31 - 15 AS cy, part % 3 <> 0 AS filled,
         CASE supplier % 4 WHEN 0 THEN NULL WHEN 1 THEN 'down' ELSE 'up' END AS stem, part % 5 AS beams, supplier % 7 = 0 AS dotted FROM blob)"""
PIXEL = """
pixel AS (
  SELECT page_id, x, y, ink, 250 - 180 * ink - (x * 5 + y * 3 + page_id) % 20 AS g FROM (
    SELECT s_suppkey AS page_id, x, y,
      (((y - 8 - s_suppkey % 3 BETWEEN 0 AND 24) AND (y - 8 - s_suppkey % 3) % 6 = 0 AND x BETWEEN 2 AND 37)
        OR (x BETWEEN 5 + s_suppkey % 20 AND 11 + s_suppkey % 20 AND y BETWEEN 10 + (s_suppkey * 7) % 20 AND 14 + (s_suppkey * 7) % 20)
        OR (x * 73 + y * 151 + s_suppkey * 31) % 97 < s_suppkey % 4)::INT AS ink
    FROM supplier, range(40) a(x), range(48) b(y)))"""
SHARPS = "['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B']"
FLATS = "['C', 'Db', 'D', 'Eb', 'E', 'F', 'Gb', 'G', 'Ab', 'A', 'Bb', 'B']"


def name(midi: str, names: str = SHARPS) -> str:
    return f"{names}[({midi}) % 12 + 1] || (({midi}) // 12 - 1)"


def pitch(diatonic: str, alter: str) -> str:
    return f"12 * (({diatonic}) // 7 + 1) + [0, 2, 4, 5, 7, 9, 11][({diatonic}) % 7 + 1] + ({alter})"


def altered(fifths: str, letter: str) -> str:
    return f"""CASE WHEN {fifths} > 0 AND list_position([3, 0, 4, 1, 5, 2, 6], {letter}) <= {fifths} THEN 1
      WHEN {fifths} < 0 AND list_position([6, 2, 5, 1, 4, 0, 3], {letter}) <= -({fifths}) THEN -1 ELSE 0 END"""


EDIT = "SELECT page_id, id, midi::BIGINT AS midi, start, duration, hand, confidence, measure::BIGINT AS measure, diatonic::DOUBLE AS diatonic, explicit_alter::DOUBLE AS explicit_alter FROM "
PLAIN = "SELECT page_id, id, midi, start, duration, hand, confidence, floor(start / 4) AS measure, diatonic, explicit_alter, event_id FROM note"
LINE = EVENT + f""",
tok AS (
  SELECT page_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'right' ELSE 'left' END AS hand, duration, midi,
         row_number() OVER w - 1 AS token, coalesce(sum(duration) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM ev WINDOW w AS (PARTITION BY page_id, event_id % 2 ORDER BY ts, event_id)),
parsed AS (
  SELECT page_id, hand, token, 0 AS voice, midi, start, duration FROM tok WHERE event_id % 11 <> 0
  UNION ALL
  SELECT page_id, hand, token, 1, 21 + (event_id * 7) % 88, start, duration FROM tok WHERE event_id % 11 <> 0 AND event_id % 5 = 0)"""
MIDI = NOTE + """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY start, midi, emit_seq) - 1 AS position FROM note),
midi0 AS (
  SELECT page_id, 0 AS tick, 0 AS seq, 'FF5103' || lpad(printf('%X', floor(60000000.0 / tempo + 0.5)::BIGINT), 6, '0') AS data FROM score
  UNION ALL SELECT page_id, 0, 1, 'FF580404021808' FROM score
  UNION ALL SELECT page_id, floor(start * 480 + 0.5)::BIGINT, 2 + 2 * position,
    printf('%02X%02X%02X', CASE hand WHEN 'left' THEN 145 ELSE 144 END, midi, CASE hand WHEN 'left' THEN 72 ELSE 88 END) FROM ordered
  UNION ALL SELECT page_id, floor((start + duration) * 480 + 0.5)::BIGINT, 3 + 2 * position,
    printf('%02X%02X00', CASE hand WHEN 'left' THEN 129 ELSE 128 END, midi) FROM ordered),
midi1 AS (SELECT page_id, tick::BIGINT AS tick, seq::BIGINT AS seq, data, (tick - coalesce(lag(tick) OVER (PARTITION BY page_id ORDER BY tick, seq), 0))::BIGINT AS delta FROM midi0)"""


def vlq(n: str) -> str:
    byte = lambda k: f"printf('%02X', (({n}) >> {7 * k}) & 127 | {128 if k else 0})"
    return f"""CASE WHEN {n} < 128 THEN {byte(0)} WHEN {n} < 16384 THEN {byte(1)} || {byte(0)}
      WHEN {n} < 2097152 THEN {byte(2)} || {byte(1)} || {byte(0)} ELSE {byte(3)} || {byte(2)} || {byte(1)} || {byte(0)} END"""


RUN = """
runs AS (
  SELECT page_id, x, ink, min(y) AS f, max(y) AS t, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, x ORDER BY y) - row_number() OVER (PARTITION BY page_id, x, ink ORDER BY y) AS island FROM pixel)
  GROUP BY page_id, x, ink, island)"""
SCALE = RUN + """,
hist AS (SELECT page_id, ink, n, count(*) AS c FROM runs WHERE (ink = 1 AND n < 64) OR (ink = 0 AND n < 128 AND t < 47) GROUP BY ALL),
thick AS (SELECT page_id, n AS th FROM hist WHERE ink = 1 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY c DESC, n) = 1),
scale AS (
  SELECT s_suppkey AS page_id, coalesce(th, 1) AS th, coalesce(sp, greatest(3, coalesce(th, 1) + 1)) AS sp
  FROM supplier LEFT JOIN thick ON thick.page_id = s_suppkey
  LEFT JOIN (SELECT hist.page_id, n AS sp FROM hist LEFT JOIN thick USING (page_id) WHERE ink = 0 AND n >= greatest(3, coalesce(th, 1) + 1)
             QUALIFY row_number() OVER (PARTITION BY hist.page_id ORDER BY c DESC, n) = 1) w ON w.page_id = s_suppkey)"""
HRUN = """
hrun AS (
  SELECT page_id, y, min(x) AS f, max(x) AS t FROM (
    SELECT *, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS island FROM pixel WHERE ink = 1) GROUP BY page_id, y, island)"""
SYMBOL = HRUN + """,
touch AS (SELECT a.page_id, a.y * 40 + a.f AS a, b.y * 40 + b.f AS b FROM hrun a JOIN hrun b ON a.page_id = b.page_id AND abs(a.y - b.y) = 1 AND a.f <= b.t + 1 AND b.f <= a.t + 1),
reach AS (SELECT page_id, y * 40 + f AS a, y * 40 + f AS b FROM hrun UNION SELECT reach.page_id, reach.a, touch.b FROM reach JOIN touch ON touch.page_id = reach.page_id AND touch.a = reach.b),
root AS (SELECT page_id, a, min(b) AS first FROM reach GROUP BY page_id, a),
symbol AS (
  SELECT page_id, first, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS blob_id, min(f) AS x0, min(y) AS y0, max(t) AS x1, max(y) AS y1, sum(t - f + 1) AS area
  FROM hrun JOIN root USING (page_id) WHERE root.a = y * 40 + f GROUP BY page_id, first),
own AS (SELECT hrun.page_id, blob_id, unnest(range(f, t + 1)) AS x, y FROM hrun JOIN root ON root.page_id = hrun.page_id AND root.a = y * 40 + f JOIN symbol ON symbol.page_id = hrun.page_id AND symbol.first = root.first)"""
BAND = SCALE + """,
thin AS (
  SELECT pixel.page_id, pixel.x, pixel.y, runs.n, th FROM pixel JOIN runs ON runs.page_id = pixel.page_id AND runs.x = pixel.x AND pixel.y BETWEEN f AND t AND runs.ink = 1
  JOIN scale ON scale.page_id = pixel.page_id WHERE pixel.ink = 1),
proj AS (SELECT page_id, y, count(*) AS c, min(x) AS l, max(x) AS r FROM thin WHERE n <= th * 2.5 GROUP BY page_id, y),
full_rows AS (SELECT *, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS g FROM (
  SELECT * FROM proj QUALIFY c >= greatest(max(c) OVER (PARTITION BY page_id) * 0.33, 40 * 0.15))),
band AS (SELECT page_id, sum(y * c) / sum(c) AS center, count(*) AS thickness, avg(c) AS ink, min(l) AS l, max(r) AS r FROM full_rows GROUP BY page_id, g)"""

DRAWN = """
place AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
drawn AS (SELECT i, user_id * 1000 + i // 24 AS page_id, i % 24 // 12 AS system, i % 24 // 3 % 4 AS bar, event_id % 2 AS lower, event_id * 5 % 9 AS step, 240 + i % 24 // 3 % 4 * 305 + i % 3 * 85 AS x,
  [1.0, 2.0, 0.5, 4.0][event_id // 2 % 4 + 1]::DOUBLE AS value, event_id // 2 % 4 = 1 AND event_id % 3 = 0 AS dotted, CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 0 END AS alter FROM place),
sung AS (SELECT *, value * CASE WHEN dotted THEN 1.5 ELSE 1 END AS duration, 30 - lower * 12 + step AS diatonic, system * 4 + bar AS measure FROM drawn),
-- A flat or natural has the size and fill of a quarter rest as well, and the rules for rests don't pass over accidentals.
told AS (SELECT page_id, lower, measure, x::DOUBLE AS x, duration, i FROM sung UNION ALL SELECT page_id, lower, measure, x - 30, 1, NULL FROM sung WHERE alter < 1),
begun AS (SELECT page_id, i, measure * 4 + coalesce(sum(duration) OVER (PARTITION BY page_id, lower, measure ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM told),
timed AS (SELECT sung.*, start FROM sung JOIN begun USING (page_id, i))"""

# Shapes of the drawn pages: rectangles (left, top, width, height) and ellipses (centre, radii, filled).
SHAPES = DRAWN + """,
page AS (SELECT DISTINCT page_id FROM drawn),
stave AS (SELECT page_id, system, lower, 80 + system * 400 + lower * 154 AS top FROM page, range(2) a(system), range(2) b(lower)),
n AS (SELECT page_id, x, step, value, dotted, alter, 80 + system * 400 + lower * 154 + 88 - step * 11.0 AS cy, step < 4 AS up FROM drawn),
stem AS (SELECT *, CASE WHEN up THEN x + 22 * 0.65::DOUBLE - 3 ELSE x - 22 * 0.65::DOUBLE END AS sx, CASE WHEN up THEN cy - 22 * 3.3::DOUBLE ELSE cy + 22 * 3.3::DOUBLE END AS tip FROM n WHERE value < 4),
sign AS (SELECT page_id, x - 22 * 1.6::DOUBLE AS x, cy, alter FROM n WHERE alter IS NOT NULL),
rect AS (
  SELECT page_id, 70::DOUBLE AS l, (top + 22 * i)::DOUBLE AS t, 1360::DOUBLE AS w, 2::DOUBLE AS h FROM stave, range(5) r(i)
  UNION ALL SELECT page_id, 81, CASE lower WHEN 0 THEN top - 22 * 1.6::DOUBLE ELSE top END, 22 * 0.9::DOUBLE, CASE lower WHEN 0 THEN 22 * 7.2::DOUBLE ELSE 22 * 2.6::DOUBLE END FROM stave
  UNION ALL SELECT page_id, 495 + 305 * i, top, 4, 90 FROM stave, range(3) r(i)
  UNION ALL SELECT page_id, sx, least(cy, tip), 3, 22 * 3.3::DOUBLE FROM stem
  UNION ALL SELECT page_id, CASE WHEN up THEN sx + 3 ELSE sx - 22 * 0.9::DOUBLE END, CASE WHEN up THEN tip ELSE tip - 22 * 0.45::DOUBLE END, 22 * 0.9::DOUBLE, 22 * 0.45::DOUBLE FROM stem WHERE value <= 0.5
  UNION ALL SELECT page_id, x + 22 * dx, cy + 22 * dy, CASE WHEN w > 0 THEN 22 * w WHEN w < 0 THEN 22 * 0.36::DOUBLE + 4 ELSE 4 END, CASE WHEN h > 0 THEN 22 * h ELSE 4 END FROM sign JOIN (VALUES
    (1, 0::DOUBLE, -1::DOUBLE, 0::DOUBLE, 2::DOUBLE), (1, 0.38, -1, 0, 2), (1, 0, -0.35, 0.5, 0), (1, 0, 0.3, 0.5, 0),
    (-1, 0, -1.3, 0, 2.1), (-1, 0, 0.2, 0.45, 0), (-1, 0.35, -0.3, 0, 0.6), (-1, 0, -0.35, 0.4, 0),
    (0, 0, -1.1, 0, 1.7), (0, 0.36, -0.6, 0, 1.7), (0, 0, -0.5, -1, 0), (0, 0, 0.2, -1, 0)) v(kind, dx, dy, w, h) ON kind = alter),
oval AS (
  SELECT page_id, x::DOUBLE AS cx, cy::DOUBLE AS cy, 22 * 0.65::DOUBLE AS rx, 22 * 0.48::DOUBLE AS ry, value <= 1 AS filled FROM n
  UNION ALL SELECT page_id, x + 22 * 1.15::DOUBLE, CASE WHEN step % 2 = 0 THEN cy - 11 ELSE cy END, 22 * 0.2::DOUBLE, 22 * 0.2::DOUBLE, true FROM n WHERE dotted),
pixel AS (SELECT page_id, unnest(range(floor(cx - rx + 0.5)::BIGINT, floor(cx + rx)::BIGINT + 1)) AS x, y, cx, cy, rx, ry, filled
  FROM (SELECT *, unnest(range(floor(cy - ry + 0.5)::BIGINT, floor(cy + ry)::BIGINT + 1)) AS y FROM oval)),
span AS (
  SELECT page_id, unnest(range(floor(t + 0.5)::BIGINT, floor(t + h + 0.5)::BIGINT)) AS y, floor(l + 0.5)::BIGINT AS a, floor(l + w + 0.5)::BIGINT - 1 AS b FROM rect
  UNION ALL SELECT page_id, y, x, x FROM pixel WHERE (x - cx) / rx * ((x - cx) / rx) + (y - cy) / ry * ((y - cy) / ry) <= 1
    AND (filled OR (x - cx) / rx / 0.5 * ((x - cx) / rx / 0.5) + (y - cy) / ry / 0.45 * ((y - cy) / ry / 0.45) >= 1)),
island AS (SELECT *, sum(CASE WHEN a <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY page_id, y ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i
  FROM (SELECT page_id, y, a, b, max(b) OVER (PARTITION BY page_id, y ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM span))"""

ORACLE = {
    "music_scalars": f"""WITH {NOTE} SELECT id, {name('midi')} AS sharp_name, {name('midi', FLATS)} AS flat_name, midi::BIGINT AS back,
      round(440 * pow(2, (midi - 69) / 12.0), 6) AS hz, midi % 12 IN (1, 3, 6, 8, 10) AS black,
      ({altered('(emit_seq % 15 - 7)', '(coalesce(diatonic, 28) % 7)')})::BIGINT AS alteration,
      ({pitch('coalesce(diatonic, 28)', 'coalesce(explicit_alter, 0)')})::BIGINT AS from_diatonic,
      ['C', 'D', 'E', 'F', 'G', 'A', 'B'][coalesce(diatonic, 28) % 7 + 1] AS letter, coalesce(diatonic, 28)::BIGINT AS diatonic_again,
      (CASE hand WHEN 'left' THEN 18 ELSE 30 END)::BIGINT AS bottom_line,
      ['Cb', 'Gb', 'Db', 'Ab', 'Eb', 'Bb', 'F', 'C', 'G', 'D', 'A', 'E', 'B', 'F#', 'C#'][emit_seq % 15 + 1] || ' major / ' ||
      ['Ab', 'Eb', 'Bb', 'F', 'C', 'G', 'D', 'A', 'E', 'B', 'F#', 'C#', 'G#', 'D#', 'A#'][emit_seq % 15 + 1] || ' minor' AS key_name FROM note""",
    "shorthand_parse": f"WITH {LINE} SELECT page_id, hand, token::BIGINT AS token, voice::BIGINT AS voice, midi::BIGINT AS midi, start, duration, floor(start / 4)::BIGINT AS measure FROM parsed",
    "piece_build": f"""WITH {LINE}, clock AS (SELECT page_id, max(start + duration) AS length FROM tok GROUP BY page_id)
      SELECT page_id, length, ceil(length / 4)::BIGINT AS n_measures, (ceil(length / 4)::BIGINT - 1) * 4 AS last_measure, n_notes::BIGINT AS n_notes, first_midi::BIGINT AS first_midi
      FROM clock LEFT JOIN (SELECT page_id, count(*) AS n_notes, arg_min(midi, start * 1000 + midi) AS first_midi FROM parsed GROUP BY page_id) USING (page_id)""",
    "measure_timeline": f"""WITH {NOTE} SELECT page_id, id, emit_seq % 2 AS staff, emit_seq // 8 AS measure,
      (emit_seq // 8) * 4.0 + coalesce(sum(duration) OVER (PARTITION BY page_id, emit_seq % 2, emit_seq // 8 ORDER BY emit_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS onset FROM note""",
    "chord_group": f"""WITH RECURSIVE {BLOB}, h AS (SELECT page_id, cx, head_id, part_d AS duration, row_number() OVER (PARTITION BY page_id ORDER BY cx, head_id) AS n
        FROM (SELECT page_id, cx, head_id, (beams + 1) * 0.5 AS part_d FROM head)),
      walk AS (SELECT page_id, n, cx, duration, cx AS anchor, 0 AS g FROM h WHERE n = 1
        UNION ALL SELECT h.page_id, h.n, h.cx, h.duration, CASE WHEN h.cx - anchor >= 14.0 * 0.6 THEN h.cx ELSE anchor END, g + (h.cx - anchor >= 14.0 * 0.6)::INT
        FROM walk JOIN h ON h.page_id = walk.page_id AND h.n = walk.n + 1)
      SELECT page_id, g::BIGINT AS chord, round(avg(cx), 6) AS x, max(duration) AS duration, count(*)::BIGINT AS members FROM walk GROUP BY page_id, g""",
    "barline_merge": f"""WITH RECURSIVE {BLOB}, h AS (SELECT page_id, staff, x, row_number() OVER (PARTITION BY page_id, staff ORDER BY x) AS n
        FROM (SELECT page_id, blob_id % 2 AS staff, cx AS x FROM blob)),
      walk AS (SELECT page_id, staff, n, x, x AS kept, true AS here FROM h WHERE n = 1
        UNION ALL SELECT h.page_id, h.staff, h.n, h.x, CASE WHEN h.x - kept < 14.0 * 1.2 THEN kept ELSE h.x END, NOT h.x - kept < 14.0 * 1.2
        FROM walk JOIN h ON h.page_id = walk.page_id AND h.staff = walk.staff AND h.n = walk.n + 1)
      SELECT page_id, staff::BIGINT AS staff, x FROM walk WHERE here""",
    "event_bucket": f"""WITH {BLOB}, bound AS (SELECT page_id, row_number() OVER w - 1 AS bucket, b, lead(b) OVER w AS nxt FROM (SELECT DISTINCT page_id, x0 AS b FROM blob) WINDOW w AS (PARTITION BY page_id ORDER BY b))
      SELECT page_id, head_id, cx AS x, bucket::BIGINT AS bucket FROM head JOIN bound USING (page_id) WHERE cx >= b AND cx < nxt""",
    "nearest_staff": f"""WITH {BLOB}, d AS (SELECT blob.page_id, blob_id, staff, cx, CASE WHEN cy < top THEN top - cy WHEN cy > bottom THEN cy - bottom ELSE 0 END AS distance, l, r, cy, top, bottom
        FROM blob JOIN staff ON staff.page_id = blob.page_id), k AS (SELECT *, rank() OVER (PARTITION BY page_id, blob_id ORDER BY distance) AS n FROM d)
      SELECT page_id, blob_id, staff::BIGINT AS staff, distance, floor((bottom - cy) / ((bottom - top) / 8) + 0.5)::BIGINT AS step
      FROM k WHERE n = 1 AND distance <= 63 AND cx BETWEEN l - 28 AND r + 28""",
    "accidental_nearest": f"""WITH {BLOB}, k AS (SELECT page_id, head_id, blob_id, CASE WHEN width / height BETWEEN 0.12 AND 0.75 THEN
          CASE WHEN (part % 10) / 10.0 > 0.7 AND (supplier % 10) / 10.0 > 0.7 THEN 'sharp' WHEN (blob_id % 3) / 3.0 < 0.5 THEN 'flat' ELSE 'natural' END END AS kind, head.cx - x1 AS gap, abs((y0 + y1) / 2.0 - head.cy) AS off, width, height
        FROM head JOIN blob USING (page_id)),
      b AS (SELECT * FROM k WHERE kind IS NOT NULL AND gap BETWEEN 14.0 * 0.1 AND 14.0 * 1.9 AND height BETWEEN 14.0 * 1.2 AND 14.0 * 3.2 AND width <= 14.0 * 1.05 AND off <= 14.0 * 1.2
        QUALIFY row_number() OVER (PARTITION BY page_id, head_id ORDER BY gap, blob_id) = 1)
      SELECT head.page_id, head.head_id, b.blob_id::DOUBLE AS blob_id, b.kind FROM head LEFT JOIN b USING (page_id, head_id)""",
    "rest_classify": f"""WITH {BLOB}, c AS (SELECT blob.page_id, staff, blob_id, cx, cy, width / 14.0 AS w, height / 14.0 AS h, area / (width * height) AS f, top FROM blob JOIN staff ON staff.page_id = blob.page_id
        WHERE blob_id % 4 <> 0 AND cy BETWEEN top - 14 AND bottom + 14),
      k AS (SELECT *, CASE WHEN w > 0.7 AND w < 2.2 AND h > 0.22 AND h < 0.8 AND f > 0.7 THEN CASE WHEN abs(cy - (top + 14 + 14.0 * 0.25)) <= abs(cy - (top + 28 - 14.0 * 0.25)) THEN 4.0 ELSE 2.0 END
        WHEN w > 0.4 AND w < 1.5 AND h > 1.9 AND h < 3.4 AND f > 0.2 AND f < 0.7 THEN 1.0 WHEN w > 0.4 AND w < 1.4 AND h > 0.9 AND h < 1.9 AND f > 0.3 THEN 0.5 END AS base FROM c)
      SELECT page_id, staff::BIGINT AS staff, blob_id, cx, cy, base::DOUBLE AS base FROM k WHERE base IS NOT NULL""",
    "clef_pick": f"""WITH {BLOB}, c AS (SELECT staff.page_id, staff, blob_id, height, x0, x1, y0 FROM staff JOIN blob ON staff.page_id = blob.page_id
        WHERE x0 >= l - 14 AND x0 < l + 63 AND height > 14.0 * 1.8 AND least(y1, bottom) - greatest(y0, top) > 14.0 * 1.4
        QUALIFY row_number() OVER (PARTITION BY staff.page_id, staff ORDER BY height DESC, x0, blob_id) = 1)
      SELECT staff.page_id, staff.staff::BIGINT AS staff, coalesce(CASE WHEN height > 70 THEN 'treble' WHEN height < 14 * 4.4 AND y0 < top + 21 THEN 'bass' END, CASE staff.staff WHEN 0 THEN 'treble' ELSE 'bass' END) AS clef,
        blob_id::DOUBLE AS clef_blob, coalesce(x1, l + 14)::DOUBLE AS clef_end FROM staff LEFT JOIN c ON c.page_id = staff.page_id AND c.staff = staff.staff""",
    "page_confidence": f"""WITH {NOTE}, c AS (SELECT page_id, count(*) AS n, avg(confidence) AS m FROM note GROUP BY page_id)
      SELECT c_custkey AS page_id, coalesce(n, 0)::BIGINT AS n_notes, round(CASE WHEN n > 0 THEN least(1.0, m * CASE WHEN n >= 8 THEN 1 ELSE 0.7 END) ELSE 0 END, 6) AS confidence,
        coalesce(n, 0) || ' note' || CASE WHEN n = 1 THEN '' ELSE 's' END AS label FROM customer LEFT JOIN c ON page_id = c_custkey""",
    "score_normalize": f"""WITH {NOTE}, e AS (SELECT page_id, max(start + duration) AS e, min(start * 100000000 + midi * 100000 + emit_seq) AS f FROM note GROUP BY page_id)
      SELECT page_id, greatest(e, measures * 4)::DOUBLE AS length, id AS first_id, (SELECT count(*) FROM note n WHERE n.page_id = score.page_id)::BIGINT AS n_notes
      FROM score JOIN e USING (page_id) JOIN note USING (page_id) WHERE start * 100000000 + midi * 100000 + emit_seq = f""",
    "score_patch": f"""WITH {NOTE}, p AS ({PLAIN}) {EDIT} (SELECT * REPLACE (CASE WHEN event_id % 10 = 3 THEN start + 1.5 ELSE start END AS start, CASE WHEN event_id % 20 = 3 THEN 2.0 ELSE duration END AS duration,
      CASE WHEN event_id % 10 = 3 THEN 1.0 ELSE confidence END AS confidence) FROM p)""",
    "score_delete": f"""WITH {NOTE} SELECT page_id, count(*)::BIGINT AS n_notes, count(*)::BIGINT AS n_detections, sum(midi)::BIGINT AS midi_sum FROM note WHERE event_id % 7 <> 2 GROUP BY page_id""",
    "score_add": f"""WITH {NOTE} {EDIT} ({PLAIN} UNION ALL SELECT page_id, 'e' || page_id, 60, measures * 2.5, 1.0, 'right', 1.0, floor(measures * 2.5 / 4), NULL, NULL, NULL FROM score)""",
    "score_nudge": f"""WITH {NOTE}, p AS ({PLAIN}) {EDIT} (SELECT * REPLACE (CASE WHEN event_id % 6 = 1 THEN least(108, greatest(21, midi + event_id % 25 - 12)) ELSE midi END AS midi,
      CASE WHEN event_id % 6 = 1 THEN NULL ELSE diatonic END AS diatonic, CASE WHEN event_id % 6 = 1 THEN NULL ELSE explicit_alter END AS explicit_alter,
      CASE WHEN event_id % 6 = 1 THEN 1.0 ELSE confidence END AS confidence) FROM p)""",
    "score_rekey": f"""WITH {NOTE}, p AS ({PLAIN}) {EDIT} (SELECT p.* REPLACE (CASE WHEN diatonic IS NOT NULL AND explicit_alter IS NULL THEN {pitch('diatonic', altered('fifths', '(diatonic % 7)'))} ELSE midi END AS midi) FROM p JOIN score USING (page_id))""",
    "pitch_range": f"""WITH {NOTE}, r AS (SELECT page_id, min(midi) AS lo, max(midi) AS hi FROM note GROUP BY page_id)
      SELECT c_custkey AS page_id, (CASE WHEN lo IS NULL THEN 48 ELSE greatest(21, floor(lo - greatest(0, 24 - (hi - lo)) / 2.0 - 2 + 0.5)) END)::BIGINT AS low,
        (CASE WHEN lo IS NULL THEN 84 ELSE least(108, floor(hi + greatest(0, 24 - (hi - lo)) / 2.0 + 2 + 0.5)) END)::BIGINT AS high FROM customer LEFT JOIN r ON page_id = c_custkey""",
    "library_upsert": """WITH p AS (SELECT o_custkey AS owner, 'p' || o_orderkey AS id, 'T' || o_orderkey AS title, epoch_ms(o_orderdate) AS created_at, o_orderkey % 90 AS notes FROM orders),
      s AS (SELECT owner, id, title || ' again' AS title, 2000000000000 + notes AS created_at, notes FROM p WHERE notes % 9 = 0),
      u AS (SELECT * FROM p ANTI JOIN s USING (owner, id) UNION ALL SELECT * FROM s)
      SELECT owner, id, title, created_at::BIGINT AS created_at, notes, (row_number() OVER w - 1)::BIGINT AS place FROM u WINDOW w AS (PARTITION BY owner ORDER BY created_at DESC, id) QUALIFY row_number() OVER w <= 24""",
    "library_delete": "SELECT o_custkey AS owner, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 13 <> 4 GROUP BY o_custkey",
    "library_read": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 0 END::BIGINT AS n_pieces, CASE event_id % 4 WHEN 0 THEN 'a' || event_id WHEN 3 THEN 'b' || event_id END AS first_id FROM events""",
    "midi_events": f"WITH {MIDI} SELECT page_id, tick, seq, delta, data FROM midi1",
    "midi_vlq": f"""WITH v AS (SELECT event_id, event_id * 7919 % 2500000 AS value FROM events) SELECT event_id, value, {vlq('value')} AS hex FROM v""",
    "midi_file": f"""WITH {MIDI}, t AS (SELECT page_id, string_agg({vlq('delta')} || data, '' ORDER BY tick, seq) || '00FF2F00' AS track FROM midi1 GROUP BY page_id)
      SELECT page_id, '4D546864000000060000000101E04D54726B' || printf('%08X', length(track) // 2) || track AS hex FROM t""",
    "sounding_at": f"""WITH {NOTE}, b AS (SELECT page_id, unnest(range(0, ceil(max(start + duration) * 2)::BIGINT + 1)) * 0.5 AS beat FROM note GROUP BY page_id)
      SELECT page_id, beat::DOUBLE AS beat, id, midi::BIGINT AS midi FROM b JOIN note USING (page_id) WHERE beat >= start - 1e-6 AND beat < start + duration""",
    "sounding_changes": f"""WITH {NOTE}, b AS (SELECT page_id, unnest(range(0, ceil(max(start + duration) * 2)::BIGINT + 1)) * 0.5 AS beat FROM note GROUP BY page_id),
      s AS (SELECT page_id, beat, string_agg(DISTINCT midi, ',' ORDER BY midi) AS keys FROM b JOIN note USING (page_id) WHERE beat >= start - 1e-6 AND beat < start + duration GROUP BY page_id, beat)
      SELECT page_id, beat::DOUBLE AS beat, keys FROM s QUALIFY keys IS DISTINCT FROM lag(keys) OVER (PARTITION BY page_id ORDER BY beat)""",
    "hit_test": f"""WITH {NOTE}, c AS (SELECT page_id, event_id AS click_id, midi, start + event_id % 5 - 1 AS beat FROM note),
      h AS (SELECT c.page_id, click_id, id FROM c JOIN note USING (page_id, midi) WHERE start - 0.1 <= beat AND beat <= start + duration QUALIFY row_number() OVER (PARTITION BY c.page_id, click_id ORDER BY start, emit_seq) = 1)
      SELECT c.page_id, c.click_id, h.id FROM c LEFT JOIN h USING (page_id, click_id)""",
    "detection_join": f"""WITH {NOTE} SELECT page_id, id AS note_id, midi::BIGINT AS midi, round(emit_seq * 20 - 14.0 * 0.7, 6) AS x, round(midi * 3 - 14.0 * 0.55, 6) AS y, round(14.0 * 1.4, 6) AS w, round(14.0 * 1.1, 6) AS h,
      start <= 10.25 AND 10.25 < start + duration AS live FROM note WHERE event_id % 9 <> 0""",
    "schedule_batches": f"""WITH {NOTE}, s AS (SELECT note.*, tempo, 0.06 + (start - 2) * (60 / tempo) AS due FROM note JOIN score USING (page_id) WHERE start >= 2 - 1e-6 AND start < 34 AND hand <> 'left')
      SELECT page_id, id, round(due, 9) AS "when", round(due + greatest(0.12, duration * (60 / tempo) * 0.94), 9) AS until, 0.78 AS velocity, greatest(0, ceil(round((due - 0.15) / 0.025, 6)))::BIGINT AS batch FROM s""",
    "metronome": f"""WITH {NOTE} SELECT page_id, 'count-in' AS kind, x AS n, round(0.06 + 4 * (60 / tempo) - (4 - x) * (60 / tempo), 6) AS at, x = 0 AS accent FROM score, range(4) r(x)
      UNION ALL SELECT page_id, 'beat', x, round(0.06 + 4 * (60 / tempo) + (x - 1.5) * (60 / tempo), 6), x % 4 = 0 FROM (SELECT page_id, tempo, unnest(range(2, measures * 4)) AS x FROM score)""",
    "loop_unroll": f"WITH {NOTE} SELECT page_id, id, x AS pass, x * 6.5 + start - 1.5 AS at FROM note, range(3) r(x) WHERE start >= 1.5 - 1e-6 AND start < 8",
    "partials": f"""WITH {NOTE}, b AS (SELECT id, midi, k AS n, least(1, greatest(0.25, 1.1 - (midi - 21) / 120.0)) AS bright, k * sqrt(1 + 0.00035 * k * k) * 440 * pow(2, (midi - 69) / 12.0) AS hz,
        CASE hand WHEN 'left' THEN 0.62 ELSE 0.78 END AS v FROM note, range(1, 8) r(k))
      SELECT id, n, round(hz, 4) AS hz, round(v * pow(n, -1.6) * CASE WHEN n = 1 THEN 1 ELSE bright END / 1.6, 6) AS level,
        round((1.2 + 26 * pow(2, -(midi - 21) / 16.0)) / pow(n, 0.62), 6) AS decay, round(CASE WHEN n = 1 THEN 0 WHEN n % 2 = 1 THEN 1.5 * bright ELSE -1.5 * bright END, 6) AS cents FROM b WHERE hz <= 44100 / 2.2""",
    "keyboard_layout": f"""WITH {NOTE}, r AS (SELECT page_id, min(midi) AS lo, max(midi) AS hi FROM note GROUP BY page_id),
      w AS (SELECT page_id, CASE WHEN lo % 12 IN (1, 3, 6, 8, 10) AND lo > 21 THEN lo - 1 ELSE lo END AS lo, CASE WHEN hi % 12 IN (1, 3, 6, 8, 10) AND hi < 108 THEN hi + 1 ELSE hi END AS hi FROM r),
      k AS (SELECT page_id, unnest(range(lo, hi + 1)) AS midi FROM w)
      SELECT page_id, midi::BIGINT AS midi, midi % 12 IN (1, 3, 6, 8, 10) AS black, (coalesce(sum((midi % 12 NOT IN (1, 3, 6, 8, 10))::INT) OVER (PARTITION BY page_id ORDER BY midi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 100
        - CASE WHEN midi % 12 IN (1, 3, 6, 8, 10) THEN 30 ELSE 0 END)::DOUBLE AS x FROM k""",
    # The same fixed values as in operators.display.
    "key_tints": f"""WITH {NOTE}, k AS (SELECT *, midi % 12 IN (1, 3, 6, 8, 10) AS black FROM note)
      SELECT page_id, id, CASE WHEN event_id % 7 = 0 THEN CASE WHEN black THEN '#1b2029' ELSE '#e9ecf1' END
        WHEN event_id % 3 = 0 THEN CASE hand WHEN 'right' THEN '#7dd3fc' ELSE '#38bdf8' END
        WHEN black THEN CASE hand WHEN 'right' THEN '#fcd34d' ELSE '#b07a12' END
        ELSE CASE hand WHEN 'right' THEN '#fbbf24' ELSE '#d99a1f' END END AS tint FROM k""",
    "roll_bounds": f"""WITH {NOTE}, r AS (SELECT page_id, min(midi) AS lo, max(midi) AS hi FROM note GROUP BY page_id)
      SELECT c_custkey AS page_id, (CASE WHEN lo IS NULL THEN 48 ELSE greatest(21, lo - 2) END)::BIGINT AS low, (CASE WHEN hi IS NULL THEN 72 ELSE least(108, hi + 2) END)::BIGINT AS high
      FROM customer LEFT JOIN r ON page_id = c_custkey""",
    "beat_grid": f"""WITH {NOTE}, e AS (SELECT page_id, max(start + duration) AS length, 3 + page_id % 2 AS beats FROM note GROUP BY page_id),
      g AS (SELECT page_id, beats, unnest(range(0, (ceil(length / beats)::BIGINT + 1) * beats + 1)) AS beat FROM e)
      SELECT page_id, beat::BIGINT AS beat, beat % beats = 0 AS bar FROM g""",
    "library_list": """WITH p AS (SELECT o_custkey AS owner, 'p' || o_orderkey AS id, 'T' || o_orderkey AS title, epoch_ms(o_orderdate) AS created_at, o_orderkey % 90 AS notes FROM orders)
      SELECT owner, (row_number() OVER w - 1)::BIGINT AS place, title, notes || ' notes' AS label, strftime(make_timestamp(created_at * 1000), '%Y-%m-%d') AS saved FROM p
      WINDOW w AS (PARTITION BY owner ORDER BY created_at DESC, id) QUALIFY row_number() OVER w <= 24""",
    "library_quota": """WITH p AS (SELECT o_custkey AS owner, 'p' || o_orderkey AS id, epoch_ms(o_orderdate) AS created_at FROM orders),
      k AS (SELECT owner, id, row_number() OVER w - 1 AS place FROM p WINDOW w AS (PARTITION BY owner ORDER BY created_at DESC, id) QUALIFY row_number() OVER w <= 24)
      SELECT owner, id, place::BIGINT AS place FROM (SELECT *, count(*) OVER (PARTITION BY owner) AS n FROM k) WHERE owner % 3 <> 0 OR place < greatest(1, n // 2)""",
    "strikes": f"""WITH {NOTE}, s AS (SELECT id, midi, start * 60 / tempo AS t, duration / 100 AS held, CASE hand WHEN 'left' THEN 0.62 ELSE 0.78 END AS v,
        least(1, greatest(0.25, 1.1 - (midi - 21) / 120.0)) AS bright FROM note JOIN score USING (page_id))
      SELECT id, round(t + 0.004, 9) AS attack_until, round(greatest(t + held, t + 0.03), 9) AS release_at, 0.08::DOUBLE AS release, round(t + 1.2 + 26 * pow(2, -(midi - 21) / 16.0) + 0.4, 9) AS stop_at,
        round(least(4 * 440 * pow(2, (midi - 69) / 12.0), 5200), 9) AS hammer_hz, round(v * 0.09 * bright, 9)::DOUBLE AS hammer_level, round(t + 0.07, 9) AS hammer_until FROM s""",
    "click_sounds": f"""WITH {NOTE}, c AS (SELECT page_id, tempo, unnest(range(2, measures * 4)) AS n FROM score)
      SELECT page_id, n::BIGINT AS n, CASE WHEN n % 4 = 0 THEN 1600 ELSE 1100 END::BIGINT AS hz, CASE WHEN n % 4 = 0 THEN 0.13 ELSE 0.07 END::DOUBLE AS level, round(0.06 + (n - 1.5) * (60 / tempo) + 0.045, 6)::DOUBLE AS "until" FROM c""",
    "playing_ends": f"""WITH {NOTE} SELECT page_id, round(max(0.06 + (start + duration - 1.5) * 60 / tempo) + 0.35, 6)::DOUBLE AS at FROM note JOIN score USING (page_id) GROUP BY page_id""",
    "roll_view": f"""WITH {NOTE} SELECT page_id, id, start <= 12.5 AND 12.5 < start + duration AS live, confidence > 0 AND confidence < 0.8 AS unsure FROM note WHERE start + duration >= 8 AND start <= 24""",
    "transport_labels": f"""WITH {NOTE} SELECT page_id, id, floor(tempo * (50 + event_id % 100) / 100.0 + 0.5)::BIGINT AS tempo, least(floor(start / 4) + 1, measures)::BIGINT AS bar, floor(start * 4 + 0.5) / 4 AS snapped,
      CASE WHEN midi < 60 THEN 'left' ELSE 'right' END AS hand, least(220, greatest(30, tempo * (event_id % 5)))::BIGINT AS clamped, 'piece-no-' || page_id || '-draft-.mid' AS file FROM note JOIN score USING (page_id)""",
    "head_duration": f"""WITH {BLOB} SELECT page_id, head_id, CASE WHEN stem IS NULL THEN CASE WHEN filled THEN 1.0 ELSE 4.0 END WHEN NOT filled THEN 2.0 ELSE pow(0.5, least(beams, 3)) END * CASE WHEN dotted THEN 1.5 ELSE 1.0 END AS duration FROM head""",
    "system_measures": f"""WITH {BLOB}, n AS (SELECT staff.page_id, staff, count(x) AS n FROM staff LEFT JOIN (SELECT page_id, blob_id % 2 AS s, x0 AS x FROM blob) b ON b.page_id = staff.page_id AND s = staff GROUP BY ALL)
      SELECT page_id, greatest(1, max(n) + 1)::BIGINT AS measures, 0::BIGINT AS base FROM n GROUP BY page_id""",
    "integral_image": f"WITH {PIXEL} SELECT page_id, x::BIGINT AS x, y::BIGINT AS y, (sum(r) OVER (PARTITION BY page_id, x ORDER BY y))::BIGINT AS total FROM (SELECT *, sum(ink) OVER (PARTITION BY page_id, y ORDER BY x) AS r FROM pixel)",
    "adaptive_threshold": f"""WITH {PIXEL}, a AS (SELECT *, sum(g) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS r, count(*) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS n FROM pixel),
      b AS (SELECT *, sum(r) OVER w AS s, sum(n) OVER w AS m FROM a WINDOW w AS (PARTITION BY page_id, x ORDER BY y ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)) SELECT page_id, x::BIGINT AS x, y::BIGINT AS y, (g < s / m - 9)::BIGINT AS ink FROM b""",
    "denoise": f"""WITH {PIXEL}, b AS (SELECT p.page_id, p.x, p.y, p.ink, sum(q.ink) AS n FROM pixel p JOIN pixel q ON p.page_id = q.page_id AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY ALL),
      s AS (SELECT page_id, avg(CASE WHEN n <= 2 THEN 1.0 ELSE 0.0 END) AS share FROM b WHERE ink = 1 AND x % 2 = 1 AND y % 2 = 1 AND x < 39 AND y < 47 GROUP BY page_id)
      SELECT page_id, x::BIGINT AS x, y::BIGINT AS y, (CASE WHEN share >= 0.06 THEN (x > 0 AND y > 0 AND x < 39 AND y < 47 AND n >= 5)::INT ELSE ink END)::BIGINT AS ink FROM b LEFT JOIN s USING (page_id)""",
    "run_scale": f"WITH {PIXEL}, {SCALE} SELECT page_id, th::BIGINT AS line_thickness, sp::BIGINT AS staff_space FROM scale",
    "deskew": f"""WITH {PIXEL}, a AS (SELECT i * 0.25 - 6 AS angle FROM range(49) r(i)),
      p AS (SELECT page_id, angle, y - floor(tan(radians(angle)) * (x - 20) + 0.5)::BIGINT AS row, count(*) AS n FROM pixel, a WHERE ink = 1 AND x % 3 = 0 GROUP BY ALL),
      d AS (SELECT s.page_id, a.angle, r.y, coalesce(n, 0) AS n FROM (SELECT s_suppkey AS page_id FROM supplier) s, a, range(48) r(y) LEFT JOIN p ON p.page_id = s.page_id AND p.angle = a.angle AND row = r.y),
      c AS (SELECT page_id, angle, pow(n - lag(n) OVER (PARTITION BY page_id, angle ORDER BY y), 2) AS v FROM d)
      SELECT page_id, angle::DOUBLE AS angle, sum(v)::DOUBLE AS score FROM c GROUP BY page_id, angle QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY sum(v) DESC, angle) = 1""",
    "line_bands": f"WITH {PIXEL}, {BAND} SELECT page_id, round(center, 6) AS center, thickness::BIGINT AS thickness, round(ink, 6) AS ink, l::BIGINT AS \"left\", r::BIGINT AS \"right\" FROM band",
}
ORACLE["connected_symbols"] = f"""WITH RECURSIVE {PIXEL}, {SYMBOL} SELECT page_id, blob_id, x0::BIGINT AS x0, y0::BIGINT AS y0, x1::BIGINT AS x1, y1::BIGINT AS y1, area::BIGINT AS area FROM symbol"""
ORACLE["symbol_masks"] = f"""WITH RECURSIVE {PIXEL}, {SYMBOL},
  grid AS (SELECT page_id, blob_id, x0, y0, gx, unnest(range(y1 - y0 + 1)) AS gy FROM (SELECT *, unnest(range(x1 - x0 + 1)) AS gx FROM symbol)),
  across AS (SELECT grid.page_id, grid.blob_id, gx, gy, count(o.x) OVER (PARTITION BY grid.page_id, grid.blob_id, gy ORDER BY gx) AS n
    FROM grid LEFT JOIN own o ON o.page_id = grid.page_id AND o.blob_id = grid.blob_id AND o.x = x0 + gx AND o.y = y0 + gy)
  SELECT page_id, blob_id, gx::BIGINT AS x, gy::BIGINT AS y, (sum(n) OVER (PARTITION BY page_id, blob_id, gx ORDER BY gy))::BIGINT AS total FROM across"""
# A staff space of 6 pixels: outer windows are 6 x 4, inner 3 x 2, side columns 1 x 3, rims 1 x 2.
ORACLE["head_search"] = f"""WITH RECURSIVE {PIXEL}, {SYMBOL},
  centre AS (SELECT page_id, blob_id, px, unnest(range(y0 + 2, y1 - 1)) AS py FROM (SELECT *, unnest(range(x0 + 3, x1 - 2)) AS px FROM symbol)),
  ring AS (SELECT c.page_id, c.blob_id, px, py, count(*) AS outside, count(*) FILTER (o.x BETWEEN px - 1 AND px + 1 AND o.y BETWEEN py - 1 AND py) AS inside
    FROM centre c JOIN own o ON o.page_id = c.page_id AND o.blob_id = c.blob_id AND o.x BETWEEN px - 3 AND px + 2 AND o.y BETWEEN py - 2 AND py + 1 GROUP BY ALL),
  found AS (SELECT page_id, blob_id, px, py, (outside - inside) / 18 AS score, inside / 6 > 0.6 AS filled FROM ring WHERE (outside - inside) / 18 >= 0.72),
  side AS (SELECT page_id, blob_id, px, py, s, d FROM found, (VALUES (-1), (1)) a(s), range(1, 15) b(d)),
  step AS (SELECT side.page_id, side.blob_id, px, py, s, d, count(o.x) AS n FROM side LEFT JOIN own o ON o.page_id = side.page_id AND o.blob_id = side.blob_id AND o.x = px + s * d AND o.y BETWEEN py - 1 AND py + 1 GROUP BY ALL),
  stop AS (SELECT page_id, blob_id, px, py, s, coalesce(min(d) FILTER (n / 3 < 0.6), 15) - 1 AS d FROM step GROUP BY ALL),
  wide AS (SELECT page_id, blob_id, px, py, 1 + sum(d) BETWEEN 5.1 AND 12 AS wide FROM stop GROUP BY page_id, blob_id, px, py),
  rim AS (SELECT found.page_id, found.blob_id, px, py, count(*) FILTER (o.x = px - 3) = 2 AND count(*) FILTER (o.x = px + 2) = 2 AS rim
    FROM found LEFT JOIN own o ON o.page_id = found.page_id AND o.blob_id = found.blob_id AND o.y BETWEEN py - 1 AND py GROUP BY found.page_id, found.blob_id, px, py)
  SELECT page_id, blob_id, px::BIGINT AS px, py::BIGINT AS py, round(score, 6) AS score, filled, CASE WHEN filled THEN wide ELSE rim END AS shaped
  FROM found JOIN wide USING (page_id, blob_id, px, py) JOIN rim USING (page_id, blob_id, px, py)"""
ORACLE["head_nms"] = f"""WITH RECURSIVE {BLOB}, h AS (SELECT page_id, cx, cy, 1 - beams / 10 AS score, filled, row_number() OVER (PARTITION BY page_id ORDER BY beams, cy, cx, filled) AS n FROM head),
  walk AS (SELECT page_id, 0::BIGINT AS n, []::STRUCT(x DOUBLE, y DOUBLE)[] AS kept, false AS here FROM head GROUP BY page_id
    UNION ALL SELECT page_id, n, CASE WHEN here THEN list_append(kept, {{'x': cx::DOUBLE, 'y': cy::DOUBLE}}) ELSE kept END, here FROM (
      SELECT h.page_id, h.n, kept, cx, cy, filled AND len(list_filter(kept, lambda k: abs(k.x - cx) < 14 * 0.8 AND abs(k.y - cy) < 14 * 0.6)) = 0 AS here
      FROM walk JOIN h ON h.page_id = walk.page_id AND h.n = walk.n + 1))
  SELECT h.page_id, cx, cy, round(score, 6) AS score, len(kept) - 1 AS rank FROM walk JOIN h ON h.page_id = walk.page_id AND h.n = walk.n WHERE here"""
ORACLE["header_end"] = f"""WITH RECURSIVE {BLOB}, clef AS ({ORACLE['clef_pick']}),
  h AS (SELECT clef.page_id, clef.staff, x0, x1, height, row_number() OVER (PARTITION BY clef.page_id, clef.staff ORDER BY x0, blob_id) AS n
    FROM clef JOIN blob ON blob.page_id = clef.page_id WHERE clef_blob IS NOT NULL AND x0 > clef_end AND x0 < 165.6),
  walk AS (SELECT page_id, staff, 0::BIGINT AS n, clef_end AS reach FROM clef
    UNION ALL SELECT h.page_id, h.staff, h.n, CASE WHEN height >= 14 * 1.2 THEN greatest(reach, x1) ELSE reach END
    FROM walk JOIN h ON h.page_id = walk.page_id AND h.staff = walk.staff AND h.n = walk.n + 1 WHERE x0 - reach <= 14 * 1.1)
  SELECT page_id, staff, round(CASE WHEN any_value(clef_blob) IS NULL THEN max(reach) ELSE least(max(reach) + 4.2, 165.6) END, 6)::DOUBLE AS header_end
  FROM walk JOIN clef USING (page_id, staff) GROUP BY page_id, staff"""
# A staff space of 2 pixels: stems stand 1 or 2 columns off the centre, 1 to 8 rows away, and bridge gaps of 2.
ORACLE["stem_find"] = f"""WITH {PIXEL}, h AS (SELECT s_suppkey AS page_id, 8 + s_suppkey % 20 AS cx, 12 + s_suppkey * 7 % 20 AS cy FROM supplier),
  w AS (SELECT *, 'up' AS stem, -1 AS step, cx + 1 AS xa, cx + 2 AS xb FROM h UNION ALL SELECT *, 'down', 1, cx - 2, cx FROM h),
  best AS (SELECT w.page_id, stem, step, cy, x FROM w JOIN pixel p ON p.page_id = w.page_id AND ink = 1 AND x BETWEEN xa AND xb AND (y - cy) * step BETWEEN 1 AND 8
    GROUP BY w.page_id, stem, step, cy, x HAVING count(*) >= 3.8 QUALIFY row_number() OVER (PARTITION BY w.page_id, stem ORDER BY count(*) DESC, x) = 1),
  along AS (SELECT best.page_id, stem, (y - cy) * step AS d, (y - cy) * step - coalesce(lag((y - cy) * step) OVER v, -1) - 1 AS gap FROM best JOIN pixel p ON p.page_id = best.page_id AND p.x = best.x AND ink = 1 AND (y - cy) * step >= 0
    WINDOW v AS (PARTITION BY best.page_id, stem ORDER BY (y - cy) * step)),
  tip AS (SELECT page_id, stem, max(d) AS d FROM (SELECT *, max(gap) OVER (PARTITION BY page_id, stem ORDER BY d) AS worst FROM along) WHERE worst <= 2 GROUP BY ALL),
  chosen AS (SELECT best.page_id, best.stem, x, cy + step * coalesce(d, 0) AS tip FROM best LEFT JOIN tip ON tip.page_id = best.page_id AND tip.stem = best.stem
    QUALIFY row_number() OVER (PARTITION BY best.page_id ORDER BY coalesce(d, 0) DESC, step) = 1)
  SELECT h.page_id, h.page_id AS head_id, stem, x::DOUBLE AS stem_x, tip::DOUBLE AS tip FROM h LEFT JOIN chosen ON chosen.page_id = h.page_id"""
# A staff space of 4 pixels: beams are sought 1 to 4 columns beside the stem, from 1 row behind its tip to 10 rows along it.
ORACLE["beam_count"] = f"""WITH {PIXEL}, h AS (SELECT s_suppkey AS page_id, s_suppkey % 3 AS kind, 4 + s_suppkey % 20 AS stem_x, 10 + s_suppkey * 7 % 20 AS tip FROM supplier),
  beside AS (SELECT h.page_id, s, y FROM h, (VALUES (1), (-1)) a(s), pixel p WHERE kind > 0 AND p.page_id = h.page_id AND ink = 1 AND (x - stem_x) * s BETWEEN 1 AND 4 AND (y - tip) * CASE kind WHEN 2 THEN 1 ELSE -1 END BETWEEN -1 AND 10),
  side AS (SELECT page_id, s FROM beside GROUP BY page_id, s QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, s DESC) = 1),
  inked AS (SELECT page_id, y FROM beside JOIN side USING (page_id, s) GROUP BY ALL HAVING count(*) >= 2.2),
  band AS (SELECT DISTINCT page_id, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS island FROM inked)
  SELECT h.page_id, h.page_id AS head_id, least(4, count(island))::BIGINT AS beams FROM h LEFT JOIN band USING (page_id) GROUP BY h.page_id"""
# A staff space of 12 pixels: points 8 to 22 columns right and up to 7 rows off; windows of 5 x 5 and 11 x 11.
ORACLE["dot_find"] = f"""WITH {PIXEL}, point AS (SELECT s_suppkey AS page_id, 2 + s_suppkey % 16 + dx AS px, 12 + s_suppkey * 3 % 20 + dy AS py FROM supplier, range(8, 23) a(dx), range(-7, 8) b(dy)),
  share AS (SELECT point.page_id, px, py, count(*) FILTER (abs(x - px) <= 2 AND abs(y - py) <= 2) / 25 AS small, count(*) / 121 AS large
    FROM point JOIN pixel p ON p.page_id = point.page_id AND ink = 1 AND abs(x - px) <= 5 AND abs(y - py) <= 5 GROUP BY ALL)
  SELECT DISTINCT page_id, page_id AS head_id FROM share WHERE small >= 0.75 AND large < 0.5"""
ORACLE["barline_find"] = f"""WITH RECURSIVE {BLOB}, h AS (SELECT page_id, staff, x, row_number() OVER (PARTITION BY page_id, staff ORDER BY x) AS n
    FROM (SELECT blob.page_id, staff, cx AS x FROM blob JOIN staff ON staff.page_id = blob.page_id WHERE width <= 7 AND height >= 56 * 0.82 AND y0 <= top + 14 AND y1 >= bottom - 14 AND area / (width * height) >= 0.6)),
  walk AS (SELECT page_id, staff, n, x, x AS kept, true AS here FROM h WHERE n = 1
    UNION ALL SELECT h.page_id, h.staff, h.n, h.x, CASE WHEN h.x - kept < 14.0 * 1.2 THEN kept ELSE h.x END, NOT h.x - kept < 14.0 * 1.2
    FROM walk JOIN h ON h.page_id = walk.page_id AND h.staff = walk.staff AND h.n = walk.n + 1)
  SELECT page_id, staff::BIGINT AS staff, x FROM walk WHERE here"""
ORACLE["window_fill"] = f"""WITH {PIXEL} SELECT page_id, x // 8 + y // 12 * 5 AS window_id, sum(ink)::BIGINT AS sum, 96::BIGINT AS area, round(sum(ink) / 96, 6) AS fill FROM pixel GROUP BY ALL"""
ORACLE["library_json"] = """WITH p AS (SELECT o_custkey AS owner, 'p' || o_orderkey AS id, 'T' || o_orderkey AS title, epoch_ms(o_orderdate) AS t, o_orderkey % 90 AS notes FROM orders),
  k AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY t DESC, id) AS n FROM p QUALIFY n <= 24)
  SELECT owner, '[' || string_agg('{"id":"' || id || '","title":"' || title || '","created_at":' || t::BIGINT || ',"notes":' || notes || '}', ',' ORDER BY n) || ']' AS json FROM k GROUP BY owner"""
ORACLE["page_downscale"] = f"WITH {PIXEL} SELECT page_id, x // 2 AS x, y // 2 AS y, round_even(avg(g), 0)::BIGINT AS g FROM pixel GROUP BY ALL"
ORACLE["deskew_apply"] = f"""WITH best AS ({ORACLE['deskew']}), {PIXEL},
  moved AS (SELECT page_id, x, CASE WHEN abs(tan(radians(angle))) < 1e-4 THEN y ELSE y - floor(tan(radians(angle)) * (x - 20) + 0.5)::BIGINT END AS y FROM pixel JOIN best USING (page_id) WHERE ink = 1)
  SELECT page_id, x::BIGINT AS x, y::BIGINT AS y FROM moved WHERE y BETWEEN 0 AND 47"""
ORACLE["stave_groups"] = f"""WITH {PIXEL}, {BAND} SELECT page_id, 0::BIGINT AS staff, round(min(center), 6) AS top, round(max(center), 6) AS bottom, min(l)::BIGINT AS "left", max(r)::BIGINT AS "right",
  round((max(center) - min(center)) / 4, 6) AS space, 0::BIGINT AS system, 0::BIGINT AS index_in_system FROM band GROUP BY page_id HAVING count(*) = 5"""
ORACLE["line_erase"] = f"""WITH {PIXEL}, {BAND}, {HRUN}, staff AS (SELECT page_id, (max(center) - min(center)) / 4 AS space FROM band GROUP BY page_id HAVING count(*) = 5),
  rows AS (SELECT DISTINCT page_id, unnest(range(floor(center - reach + 0.5)::BIGINT, floor(center + reach + 0.5)::BIGINT + 1)) AS y, space FROM (
    SELECT band.page_id, center, space, greatest(1, floor(th * 0.8 + 0.5)) AS reach FROM band JOIN staff USING (page_id) JOIN scale USING (page_id))),
  gone AS (SELECT thin.page_id, x, thin.y FROM thin JOIN rows ON rows.page_id = thin.page_id AND rows.y = thin.y
    JOIN hrun ON hrun.page_id = thin.page_id AND hrun.y = thin.y AND x BETWEEN hrun.f AND hrun.t WHERE n <= th * 2 + 1 AND hrun.t - hrun.f + 1 >= space * 1.2)
  SELECT page_id, x::BIGINT AS x, y::BIGINT AS y FROM pixel ANTI JOIN gone USING (page_id, x, y) WHERE ink = 1"""
# The messages' wording is fixed.
ORACLE["page_results"] = f"""WITH {NOTE}, c AS (SELECT page_id, count(*) AS n, avg(confidence) AS m, max(start + duration) AS e FROM note GROUP BY page_id),
  p AS (SELECT c_custkey AS page_id, coalesce(n, 0) AS n, m, e, c_custkey % 4 AS staves, 1 + c_custkey % 23 AS bars, c_custkey % 49 * 0.25 - 6 AS angle FROM customer LEFT JOIN c ON page_id = c_custkey)
  SELECT page_id, (CASE WHEN staves = 0 THEN 0 ELSE n END)::BIGINT AS n_notes, staves::BIGINT AS n_staves, (CASE WHEN staves = 0 THEN 1 ELSE bars END)::BIGINT AS measures,
    (CASE WHEN staves = 0 THEN 0 ELSE 4 * (bars - 1) END)::DOUBLE AS last, (CASE WHEN staves = 0 THEN 0 ELSE greatest(coalesce(e, 0), bars * 4) END)::DOUBLE AS length,
    round(CASE WHEN staves = 0 OR n = 0 THEN 0 ELSE least(1.0, m * CASE WHEN n >= 8 THEN 1 ELSE 0.7 END) END, 6)::DOUBLE AS confidence,
    CASE WHEN abs(angle) > 0.4 THEN 'Straightened by ' || CASE WHEN angle < 0 THEN '-' ELSE '' END || floor(abs(angle) * 10 + 0.5)::BIGINT // 10 || '.' || floor(abs(angle) * 10 + 0.5)::BIGINT % 10 || '°. ' ELSE '' END ||
    CASE WHEN staves = 0 THEN 'No staves found. Fill the frame with the music and keep the page flat.' WHEN n = 0 THEN 'Found staves but no notes. Try more light, or move closer.'
      ELSE staves || CASE WHEN staves = 1 THEN ' stave, ' ELSE ' staves, ' END || bars || CASE WHEN bars = 1 THEN ' measure, ' ELSE ' measures, ' END || n || ' notes.' END AS messages FROM p"""
ORACLE["loop_controls"] = f"""WITH {NOTE}, a AS (SELECT note.*, measures, max(start + duration) OVER (PARTITION BY note.page_id) AS length FROM note JOIN score ON score.page_id = note.page_id),
  b AS (SELECT *, least(floor(start / 4), measures - 1) * 4 AS s, emit_seq % measures + 1 AS bar FROM a), c AS (SELECT *, least(s + 8, length) AS e FROM b)
  SELECT page_id, id, s::DOUBLE AS loop_start, e::DOUBLE AS loop_end, ((bar - 1) * 4)::DOUBLE AS first_start, greatest(e, bar * 4)::DOUBLE AS first_end, least(s, bar * 4 - 4)::DOUBLE AS last_start, (bar * 4)::DOUBLE AS last_end,
    (CASE WHEN start + duration >= e - 1e-6 THEN CASE WHEN event_id % 2 = 0 THEN s ELSE 0 END ELSE start + duration END)::DOUBLE AS begin, greatest(0, start + (event_id % 9 - 4) * 0.25)::DOUBLE AS moved FROM c"""
ORACLE["engraved_pages"] = f"""WITH {SHAPES} SELECT page_id, y AS fixed, min(a) AS "from", max(b) AS "to", max(b) - min(a) + 1 AS length FROM island GROUP BY page_id, y, i"""
ORACLE["recognize_page"] = f"""WITH {DRAWN} SELECT page_id, (system * 2 + lower)::BIGINT AS staff, CASE lower WHEN 0 THEN 'right' ELSE 'left' END AS hand, measure::BIGINT AS measure, start::DOUBLE AS start, duration::DOUBLE AS duration,
  (12 * (diatonic // 7 + 1) + [0, 2, 4, 5, 7, 9, 11][diatonic % 7 + 1] + coalesce(alter, 0))::BIGINT AS midi, diatonic::BIGINT AS diatonic, alter::BIGINT AS explicit_alter FROM timed"""
ORACLE["recognize_scores"] = f"""WITH {DRAWN} SELECT page_id, count(*) AS n_notes, 4::BIGINT AS n_staves, 8::BIGINT AS measures, greatest(32, max(start + duration))::DOUBLE AS length, count(*) >= 8 AS sure,
  '4 staves, 8 measures, ' || count(*) || ' notes.' AS messages FROM timed GROUP BY page_id"""
ORACLE["level_runs"] = ORACLE["engraved_pages"]
ORACLE["grey_shear"] = f"""WITH {PIXEL}, t AS (SELECT *, floor(tan(radians((page_id % 9 - 4) * 0.75::DOUBLE)) * (x - 20) + 0.5)::BIGINT AS shift FROM pixel)
  SELECT t.page_id, t.x::BIGINT AS x, t.y::BIGINT AS y, coalesce(s.g, 255)::BIGINT AS g FROM t LEFT JOIN pixel s ON s.page_id = t.page_id AND s.x = t.x AND s.y = t.y + shift"""
ORACLE["image_decode"] = f"""WITH {PIXEL} SELECT page_id, x::DOUBLE AS x, y::DOUBLE AS y, round_even(g * 0.299::DOUBLE + (g * 7 + x) % 256 * 0.587::DOUBLE + (255 - g) * 0.114::DOUBLE, 0)::DOUBLE AS g, NULL::VARCHAR AS problem FROM pixel WHERE page_id % 5 <> 0
  UNION ALL SELECT s_suppkey, NULL, NULL, NULL, 'cut short or damaged' FROM supplier WHERE s_suppkey % 5 = 0"""
ORACLE["play_position"] = f"""WITH {NOTE}, p AS (SELECT page_id, id, start + duration / 2 * tempo / 60 AS b FROM note JOIN score USING (page_id)) SELECT page_id, id, round(b, 6)::DOUBLE AS beat, floor(b / 4)::BIGINT AS bar FROM p"""
