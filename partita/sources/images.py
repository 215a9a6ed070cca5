"""Image files as pages: PNG bytes are decoded a file at a time, brought to grey and down to a longest edge.

A file that is no image, is cut short or is of a kind not read keeps its row, with what is wrong and no page.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST = 1600
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a pixel by colour type (grey, colour, palette, grey with alpha, colour with alpha).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PAGE = "width int, height int, grey binary, problem string"


def files(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """page_id (the file's path), content of all files under ``path``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select(F.col("path").alias("page_id"), "content")


def encode_png(image: np.ndarray) -> bytes:
    """A grey (height, width) or colour (height, width, 3) image of bytes as PNG."""
    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    header = struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def _unfiltered(raw: np.ndarray, channels: int) -> np.ndarray:
    """Rows of bytes from filtered rows, each with its filter's number before it."""
    out = np.zeros((raw.shape[0] + 1, raw.shape[1] - 1), np.uint8)
    for y, (kind, line) in enumerate(zip(raw[:, 0].tolist(), raw[:, 1:], strict=True)):
        above = out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 2:
            out[y + 1] = line + above
        elif kind == 1:
            # Each byte adds the one a pixel before: a running sum for each channel.
            out[y + 1] = line.reshape(-1, channels).cumsum(axis=0, dtype=np.uint64).astype(np.uint8).reshape(-1)
        elif kind in (3, 4):
            row, up, now = line.tolist(), above.tolist(), [0] * len(line)
            for i, v in enumerate(row):
                a, c = (now[i - channels], up[i - channels]) if i >= channels else (0, 0)
                if kind == 3:
                    guess = (a + up[i]) // 2
                else:
                    p = a + up[i] - c
                    guess = min((a, up[i], c), key=lambda v: abs(p - v))  # noqa: B023 (used at once)
                now[i] = (v + guess) & 255
            out[y + 1] = now
        else:
            raise ValueError(f"filter {kind}")
    return out[1:]


def decode_png(content: bytes) -> np.ndarray:
    """Height x width x channels (grey, or red, green, blue; alpha is left out) of an 8-bit PNG without interlacing."""
    if content[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, header, palette, data, ended = 8, None, None, [], False
    while at + 12 <= len(content) and not ended:
        (size,), name = struct.unpack(">I", content[at : at + 4]), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(name + body) != int.from_bytes(content[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("cut short or damaged")
        if name == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            data.append(body)
        ended, at = name == b"IEND", at + 12 + size
    if header is None or not ended:
        raise ValueError("cut short or damaged")
    width, height, depth, kind, _, _, interlaced = header
    if depth != 8 or kind not in CHANNELS or interlaced or (kind == 3 and palette is None):
        raise ValueError("a kind of PNG that is not read")
    channels = CHANNELS[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) != height * (width * channels + 1):
        raise ValueError("cut short or damaged")
    image = _unfiltered(raw.reshape(height, -1), channels).reshape(height, width, channels)
    if kind == 3:
        return palette[image[:, :, 0]]
    return image[:, :, :1] if channels < 3 else image[:, :, :3]


def luma(image: np.ndarray) -> np.ndarray:
    """Grey of an image, not yet rounded."""
    v = image.astype(float)
    return v[:, :, 0] if v.shape[2] == 1 else v[:, :, 0] * 0.299 + v[:, :, 1] * 0.587 + v[:, :, 2] * 0.114


def to_grey(image: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Grey bytes with the long edge at most ``longest``: means over source cells of a pixel at least, halves to even
    (``pixels.downscaled`` says the same for pixels)."""
    height, width = image.shape[:2]
    scale = min(1.0, longest / max(width, height))
    grey = luma(image)
    if scale < 1:
        w, h = (max(1, int(np.floor(v * scale + 0.5))) for v in (width, height))

        def cells(n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
            start = np.minimum(np.floor(np.arange(n) / scale).astype(int), most - 1)
            return start, np.minimum(np.maximum(np.floor(np.arange(1, n + 1) / scale).astype(int), start + 1), most)

        (y0, y1), (x0, x1) = cells(h, height), cells(w, width)
        table = np.pad(grey.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        total = table[y1[:, None], x1] - table[y0[:, None], x1] - table[y1[:, None], x0] + table[y0[:, None], x0]
        grey = total / ((y1 - y0)[:, None] * (x1 - x0))
    return np.clip(np.rint(grey), 0, 255).astype(np.uint8)


def decoded(images: DataFrame, longest: int = LONGEST) -> DataFrame:
    """page_id, width, height, grey, problem of image files (page_id, content); a page, or what is wrong with the file."""
    id_type = images.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for page_id, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    grey = to_grey(decode_png(content.as_py() or b""), longest)
                    row = (grey.shape[1], grey.shape[0], grey.tobytes(), None)
                except (ValueError, zlib.error, struct.error) as e:
                    row = (None, None, None, str(e))
                types = (pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([page_id.as_py()], batch.column(0).type), *(pa.array([v], t) for v, t in zip(row, types, strict=True))], names=["page_id", "width", "height", "grey", "problem"])

    return images.select("page_id", "content").mapInArrow(run, f"page_id {id_type}, {PAGE}")


def encoded(pages: DataFrame, channels: int = 1) -> DataFrame:
    """page_id, content: pages (page_id, width, height, grey) as PNG files; ``grey`` holds colours if ``channels`` is 3."""
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            shape = lambda r: (r["height"], r["width"]) if channels == 1 else (r["height"], r["width"], channels)
            made = [encode_png(np.frombuffer(r["grey"], np.uint8).reshape(shape(r))) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["page_id", "content"])

    return pages.select("page_id", "width", "height", "grey").mapInArrow(run, f"page_id {id_type}, content binary")
