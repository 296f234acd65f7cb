"""PNG images without an imaging library: decoding to RGBA pixels, encoding, size bounds."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an image that a request may carry; larger ones are encoded again, and halved until they fit.
LARGEST = 7 << 20
#: Pixels that are decoded at most: a few bytes can claim any size.
PIXELS = 1 << 26
# The signature of a file, and the channels of its colour types.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(data[at + 4 : at + 8 + size]) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a chunk is cut or damaged")
        yield data[at + 4 : at + 8], body
        at += 12 + size


def _unfiltered(raw: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    """The scan lines without their filters; ``step``: bytes of a pixel, one at least."""
    out = np.zeros((len(raw) + 1, raw.shape[1] + step), np.uint8)  # a line and a pixel of zeros before the image
    for y in range(len(raw)):
        line, above, kind = out[y + 1], out[y], filters[y]
        if kind == 0:
            line[step:] = raw[y]
        elif kind == 2:
            line[step:] = raw[y] + above[step:]
        elif kind == 1:  # a running sum for each byte of a pixel
            for b in range(step):
                line[step + b :: step] = np.cumsum(raw[y, b::step], dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            for x in range(0, raw.shape[1], step):  # each pixel needs the one before it
                n = min(step, raw.shape[1] - x)
                left, up, corner = (z.astype(np.int16) for z in (line[x : x + n], above[x + step : x + step + n], above[x : x + n]))
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    far = [np.abs(left + up - corner - z) for z in (left, up, corner)]
                    guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
                line[x + step : x + step + n] = raw[y, x : x + n] + guess.astype(np.uint8)
        else:
            raise ValueError(f"unknown filter {kind}")
    return out[1:, step:]


def decode(data: bytes) -> np.ndarray:
    """The height x width x 4 pixels of a PNG file; ValueError for what is none, is damaged, interlaced or too large.

    16-bit samples keep their high byte; smaller ones are stretched to 8 bits.
    """
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    head, packed, palette, clear = None, [], None, None
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, laced = head
    if colour not in CHANNELS or depth not in (1, 2, 4, 8, 16) or laced or not 0 < width * height <= PIXELS:
        raise ValueError("unsupported")
    channels = CHANNELS[colour]
    size = -(-width * channels * depth // 8)
    try:
        whole = zlib.decompressobj().decompress(b"".join(packed), height * (size + 1) + 1)
    except zlib.error as e:
        raise ValueError(str(e)) from None
    if len(whole) < height * (size + 1):
        raise ValueError("the image is cut")
    rows = np.frombuffer(whole[: height * (size + 1)], np.uint8).reshape(height, size + 1)
    lines = _unfiltered(rows[:, 1:], rows[:, 0], max(1, channels * depth // 8))
    if depth == 16:
        lines = lines[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
        lines = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[:, : width * channels]
        lines = lines if colour == 3 else lines * (255 // ((1 << depth) - 1))
    values = lines[:, : width * channels].reshape(height, width, channels)
    out = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        if palette is None or values.max() >= len(palette):
            raise ValueError("no such colour in the palette")
        out[..., :3] = palette[values[..., 0]]
        if clear is not None:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            out[..., 3] = alpha[values[..., 0]]
    else:
        out[..., :3] = values[..., :3] if channels >= 3 else values[..., :1]
        if channels in (2, 4):
            out[..., 3] = values[..., -1]
        elif clear is not None and depth == 8:  # one colour is clear
            out[..., 3] = np.where((values == np.frombuffer(clear, ">u2")[:channels]).all(axis=-1), 0, 255)
    return out


def encode(pixels: np.ndarray, kind: int = 0, level: int = 6) -> bytes:
    """A PNG file of height x width x 4 pixels; ``kind``: 0, no filter, 1, differences to the pixel before, 2, to the line above."""
    height, width = pixels.shape[:2]
    lines = np.ascontiguousarray(pixels, np.uint8).reshape(height, -1)
    if kind == 1:
        lines = lines - np.concatenate([np.zeros((height, 4), np.uint8), lines[:, :-4]], axis=1)
    elif kind == 2:
        lines = lines - np.concatenate([np.zeros((1, lines.shape[1]), np.uint8), lines[:-1]])
    body = zlib.compress(np.concatenate([np.full((height, 1), kind, np.uint8), lines], axis=1).tobytes(), level)
    chunk = lambda name, x: struct.pack(">I", len(x)) + name + x + struct.pack(">I", zlib.crc32(name + x))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def bounded(data: bytes, largest: int = LARGEST) -> bytes:
    """``data`` if it is no larger than that; else encoded again at the highest level, and halved in both directions until it fits."""
    if len(data) <= largest:
        return data
    pixels = decode(data)
    while len(made := encode(pixels, 2, 9)) > largest and min(pixels.shape[:2]) > 1:
        h, w = pixels.shape[0] // 2, pixels.shape[1] // 2
        pixels = pixels[: 2 * h, : 2 * w].reshape(h, 2, w, 2, 4).mean(axis=(1, 3)).astype(np.uint8)
    if len(made) > largest:
        raise ValueError("the image does not fit")
    return made


def pixel_hashes(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, size, pixels): width x height and the SHA-256 of each image's RGBA pixels; null for what is no PNG image that can be read, or null."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for data in b.column(1).to_pylist():
                try:
                    p = decode(data or b"")
                    out.append((f"{p.shape[1]}x{p.shape[0]}", hashlib.sha256(p.tobytes()).hexdigest()))
                except ValueError:
                    out.append((None, None))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], pa.string()) for i in (0, 1))], ["k", "size", "pixels"])

    return rows.select(key, content).mapInArrow(run, f"k {kind}, size string, pixels string").withColumnRenamed("k", key)
