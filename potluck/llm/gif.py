"""GIF as a media column: LZW decoding, palettes, disposal and transparency, timed frames with colour histograms.

An LZW table entry is never stored as a string: the entry made at a step is the string written
at the step before plus one more symbol, so it is a slice of the output that already exists.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8

#: Levels per channel of the colour histogram: 4 x 4 x 4 = 64 cells of visible pixels.
LEVELS = 4
#: A screen or picture of more pixels is answered by an error row: 16 million take 64 MB as RGBA.
MOST_PIXELS = 1 << 24
#: Bytes of canvases that about leave a worker together.
BATCH_BYTES = 8 << 20


class BadGif(ValueError):
    """The bytes are no GIF or break off before the first whole frame."""


@cache
def _code_places(min_size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bit, size) of up to n codes after a clear code: a code's size follows from how many came before it."""
    made = (1 << min_size) + 2 + np.maximum(0, np.arange(n) - 1)
    size = np.minimum(12, np.floor(np.log2(made)).astype(np.int64) + 1)
    size = np.maximum(size, min_size + 1)
    return np.cumsum(size) - size, size


def lzw_decode(data: bytes, min_size: int, pixels: int) -> bytes:
    """Up to `pixels` symbols of a code stream; a stream that breaks off gives what it has.

    The codes up to the next clear code are cut out of the stream together.
    """
    clear, stop = 1 << min_size, (1 << min_size) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total, at = 8 * len(data), 0
    out = bytearray()
    while len(out) < pixels:
        most = max(0, (total - at) // (min_size + 1))
        first, size = _code_places(min_size, 1 << max(4, int(most).bit_length()))
        first = first[: np.searchsorted(first + size, total - at, side="right")] + at
        if not len(first):
            break
        size = size[: len(first)]
        byte = first >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (first & 7) & ((1 << size) - 1)
        end = np.flatnonzero((codes == clear) | (codes == stop))
        done = not len(end) or codes[end[0]] == stop
        if len(end):
            at = int(first[end[0]] + size[end[0]])
            codes = codes[: end[0]]
        begin: list[int] = []
        for i, code in enumerate(codes.tolist()):
            here = len(out)
            begin.append(here)
            if code < clear:
                out.append(code)
                continue
            entry = code - stop - 1  # what was written at this step, and one symbol of the next
            if entry >= i:
                raise BadGif("code beyond the table")
            a, b = begin[entry], begin[entry + 1]
            out += out[a : b + 1]
            if b == here:
                out.append(out[a])
            if here > pixels:
                break
        if done:
            break
    return bytes(out[:pixels])


def lzw_encode(pixels: bytes, min_size: int) -> bytes:
    """A code stream that lzw_decode turns back into pixels."""
    clear, stop = 1 << min_size, (1 << min_size) + 1
    size, free = min_size + 1, stop + 1
    table: dict[tuple[int, int], int] = {}
    out, buffer, bits = bytearray(), clear, min_size + 1
    prefix = -1
    for p in pixels:
        if prefix < 0:
            prefix = p
            continue
        code = table.get((prefix, p))
        if code is not None:
            prefix = code
            continue
        buffer |= prefix << bits
        bits += size
        if free < 4096:
            table[prefix, p] = free
            if free == 1 << size and size < 12:
                size += 1
            free += 1
        else:
            buffer |= clear << bits
            bits += size
            table.clear()
            size, free = min_size + 1, stop + 1
        while bits >= 8:
            out.append(buffer & 255)
            buffer >>= 8
            bits -= 8
        prefix = p
    if prefix >= 0:
        buffer |= prefix << bits
        bits += size
        # a decoder makes one more entry here; its code size may grow before the stop code
        if free == 1 << size and size < 12 and len(pixels) > 1:
            size += 1
    buffer |= stop << bits
    bits += size
    while bits > 0:
        out.append(buffer & 255)
        buffer >>= 8
        bits -= 8
    return bytes(out)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise BadGif("breaks off in a block")
        n = data[at]
        at += 1
        if not n:
            return b"".join(parts), at
        parts.append(data[at : at + n])
        at += n


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    raw = data[at : at + 3 * n]
    if len(raw) < 3 * n:
        raise BadGif("breaks off in a palette")
    return np.frombuffer(raw, np.uint8).reshape(n, 3), at + 3 * n


def _rows(height: int, interlaced: bool) -> np.ndarray:
    if not interlaced:
        return np.arange(height)
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def _walk(data: bytes) -> Iterator[tuple[str, tuple]]:
    """The blocks of a file in order: ("control", (delay, disposal, transparent index)), ("loops", (n,)) and ("picture", (x, y, w, h, flags, palette, code size, stream)).

    Ends at the trailer and raises BadGif, struct.error or IndexError where the file breaks off. No picture is decoded.
    """
    at, everywhere = 13, None
    flags = data[10]
    if flags & 0x80:
        everywhere, at = _palette(data, at, flags)
    while True:
        if at >= len(data):
            raise BadGif("breaks off between blocks")
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            body, at = _blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                yield "control", (10 * struct.unpack("<H", body[1:3])[0], body[0] >> 2 & 7, body[3] if body[0] & 1 else -1)
            elif label == 0xFF and body[:11] in (b"NETSCAPE2.0", b"ANIMEXTS1.0") and len(body) >= 14 and body[11] == 1:
                yield "loops", struct.unpack("<H", body[12:14])
            continue
        if kind != 0x2C:
            raise BadGif("unknown block")
        x, y, w, h, own = struct.unpack("<HHHHB", data[at : at + 9])
        at += 9
        palette = everywhere
        if own & 0x80:
            palette, at = _palette(data, at, own)
        if palette is None:
            raise BadGif("no palette")
        size = data[at]
        if not 1 <= size <= 8:
            raise BadGif("bad code size")
        stream, at = _blocks(data, at + 1)
        yield "picture", (x, y, w, h, own, palette, size, stream)


def header(data: bytes, most_pixels: int = MOST_PIXELS) -> tuple[int, int, int]:
    """(width, height, loops) of a file, read without decoding a picture; loops: -1 without a loop extension, 0 for ever."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise BadGif("no GIF header")
    width, height = struct.unpack("<HH", data[6:10])
    if not width or not height:
        raise BadGif("empty screen")
    if width * height > most_pixels:
        raise BadGif(f"screen of more than {most_pixels} pixels")
    loops = -1
    try:
        for kind, value in _walk(data):
            if kind == "loops":
                (loops,) = value
    except (BadGif, struct.error, IndexError):
        pass  # what comes before the break counts
    return width, height, loops


def frames_of(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[tuple[int, np.ndarray, str]]:
    """(delay in ms, RGBA canvas after drawing the frame, disposal) of each frame; a canvas is valid until the next is asked for.

    A canvas starts transparent. Disposal "background" clears the frame's rectangle to transparent before the next frame,
    "previous" restores what was there. Two canvases at most are held, and the part a frame covers.
    """
    width, height, _ = header(data, most_pixels)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, -1
    some = False
    try:
        for kind, value in _walk(data):
            if kind == "control":
                delay, disposal, clear_index = value
            if kind != "picture":
                continue
            x, y, w, h, own, palette, size, stream = value
            if w * h > most_pixels:
                raise BadGif(f"picture of more than {most_pixels} pixels")
            raw = np.frombuffer(lzw_decode(stream, size, w * h), np.uint8)
            if len(raw) < w * h:
                raise BadGif("breaks off in a picture")
            index = np.empty((h, w), np.uint8)
            index[_rows(h, bool(own & 0x40))] = raw.reshape(h, w)
            # a frame may stick out of the screen: only what lies on it is drawn
            vw, vh = max(0, min(w, width - x)), max(0, min(h, height - y))
            target = canvas[y : y + vh, x : x + vw]
            saved = target.copy() if disposal == 3 else None
            shown = index[:vh, :vw]
            opaque = (shown != clear_index) & (shown < len(palette))
            colours = np.full((256, 4), 255, np.uint8)
            colours[: len(palette), :3] = palette
            np.copyto(target, colours[shown], where=opaque[..., None])
            some = True
            yield delay, canvas, {2: "background", 3: "previous"}.get(disposal, "keep")
            if disposal == 2:
                target[:] = 0
            elif disposal == 3:
                target[:] = saved
            delay, disposal, clear_index = 0, 0, -1
    except (BadGif, struct.error, IndexError) as e:
        if not some:
            raise BadGif(str(e)) from e
    else:
        if not some:
            raise BadGif("no picture")


def decode(data: bytes, most_pixels: int = MOST_PIXELS) -> tuple[int, int, int, list[tuple[int, np.ndarray, str]]]:
    """(width, height, loops, frames) with a canvas of its own for every frame.

    A file that breaks off keeps its whole frames and raises BadGif only if there is none.
    """
    frames = [(delay, canvas.copy(), disposal) for delay, canvas, disposal in frames_of(data, most_pixels)]
    return *header(data, most_pixels), frames


def histogram(canvas: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Visible pixels per cell of levels ** 3 colours, red slowest."""
    level = np.arange(256) * levels >> 8
    cell = (level[canvas[..., 0]] * levels + level[canvas[..., 1]]) * levels + level[canvas[..., 2]]
    return np.bincount(cell[canvas[..., 3] > 0], minlength=levels**3)


def encode(width: int, height: int, frames: list[dict], palette: np.ndarray | None = None, loops: int = 0) -> bytes:
    """A GIF89a; a frame has index (h x w), and may have x, y, delay (ms), disposal, clear (index), palette, interlaced."""

    def table(p: np.ndarray) -> tuple[int, bytes]:
        bits = max(1, int(np.ceil(np.log2(len(p)))))
        return bits - 1, p.astype(np.uint8).tobytes() + b"\0" * (3 * (1 << bits) - 3 * len(p))

    out = bytearray(b"GIF89a")
    if palette is not None:
        bits, raw = table(palette)
        out += struct.pack("<HHBBB", width, height, 0x80 | bits, 0, 0) + raw
    else:
        out += struct.pack("<HHBBB", width, height, 0, 0, 0)
    if loops >= 0:
        out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0"
    for f in frames:
        index = f["index"]
        h, w = index.shape
        clear = f.get("clear", -1)
        out += b"\x21\xf9\x04" + struct.pack("<BHB", f.get("disposal", 0) << 2 | (clear >= 0), f.get("delay", 0) // 10, max(0, clear)) + b"\0"
        own = f.get("palette")
        flags, raw = (0, b"") if own is None else (lambda t: (0x80 | t[0], t[1]))(table(own))
        if f.get("interlaced"):
            flags |= 0x40
        out += b"\x2c" + struct.pack("<HHHHB", f.get("x", 0), f.get("y", 0), w, h, flags) + raw
        size = max(2, int(np.ceil(np.log2(max(2, int(index.max(initial=0)) + 1)))))
        stream = lzw_encode(index[_rows(h, bool(f.get("interlaced")))].astype(np.uint8).tobytes(), size)
        out.append(size)
        for lo in range(0, len(stream), 255):
            part = stream[lo : lo + 255]
            out.append(len(part))
            out += part
        out.append(0)
    return bytes(out + b"\x3b")


FRAMES = (
    "media_id long, frame int, start_ms long, delay_ms int, width int, height int, loops int, disposal string, "
    "visible long, histogram array<int>, rgba binary, error string"
)


def _decoder(levels: int, most_pixels: int):
    names = ["media_id", "frame", "start_ms", "delay_ms", "width", "height", "loops", "disposal", "visible", "histogram", "rgba", "error"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.string()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = value.as_py()
                if data is None:
                    continue
                start = 0
                try:
                    width, height, loops = header(data, most_pixels)
                    for i, (delay, canvas, disposal) in enumerate(frames_of(data, most_pixels)):
                        rows.append((key, i, start, delay, width, height, loops, disposal, int(np.count_nonzero(canvas[..., 3])), histogram(canvas, levels), canvas.tobytes(), None))
                        start += delay
                        held += canvas.nbytes
                        if held >= BATCH_BYTES:
                            yield packed(rows)
                            rows, held = [], 0
                except BadGif as e:
                    rows.append((key, *[None] * 10, str(e)))
                held += 1000
        if rows:
            yield packed(rows)

    return run


def decode_frames(media: DataFrame, id_col: str = "media_id", gif_col: str = "gif", levels: int = LEVELS, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """One row per frame: when it starts and how long it stays, the whole canvas as RGBA and its colour histogram.

    A null picture gives no row; bytes that are no GIF, have no whole frame (empty ones too), or a
    screen or first picture of more than `most_pixels`, give one row with only media_id and error; a file that breaks off later keeps its whole frames; a
    null id stays null; repeated rows are decoded each; other columns are not read. The media
    stay where they are: nothing is shuffled.
    """
    return media.select(F.col(id_col).cast("long").alias("media_id"), F.col(gif_col).alias("gif")).mapInArrow(_decoder(levels, most_pixels), FRAMES)


def _renderer(side: int):
    palette = np.array([[32 * i, 255 - 32 * i, 37 * i % 256] for i in range(8)], np.uint8)

    def picture(text: bytes) -> bytes:
        pixels = np.frombuffer(text, np.uint8) >> 5
        per = side * side
        n = max(1, -(-len(pixels) // per))
        sheet = np.zeros(n * per, np.uint8)
        sheet[: len(pixels)] = pixels
        frames = []
        for i, index in enumerate(sheet.reshape(n, side, side)):
            frames.append({"index": index, "delay": 40 + 10 * (i % 5), "disposal": (1, 2, 3)[i % 3], "clear": 1 if i % 2 else -1, "interlaced": i % 4 == 3})
        return encode(side, side, frames, palette)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for lo, hi in chunks(offsets, BATCH_BYTES):
                texts = (t.as_py() for t in batch.column(1).slice(lo, hi - lo))
                gifs = [None if t is None else picture(t.encode("utf-8")) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(gifs, pa.binary())], names=["media_id", "gif"])

    return render


def render_text(rows: DataFrame, id_col: str, text_col: str, side: int = 48) -> DataFrame:
    """(media_id, gif): each text drawn as an animated GIF, one pixel per UTF-8 byte (its upper three bits). Gives a media column where a table has none.

    A null text gives a null picture, an empty one a single frame; a null id stays null; repeated rows are drawn each; a text of
    any length is drawn whole, in as many frames as it takes; an empty table stays empty; other columns are not read.
    """
    return rows.select(F.col(id_col).cast("long").alias("media_id"), F.col(text_col).alias("text")).mapInArrow(_renderer(side), "media_id long, gif binary")
