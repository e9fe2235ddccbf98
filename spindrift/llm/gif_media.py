"""GIF media: lossless storage of 8-bit samples, decoding, timed frames and colour histograms.

``encode`` writes rows of samples as an animated GIF (LZW, one grey palette, so that a sample is its
palette index); ``read`` decodes any GIF, one frame at a time: LZW code streams, global and local
palettes, interlacing, transparency and disposal. The frame table has one row per frame with its time
and histograms, and the digests of stored texts carry those columns as an array.

Memory is that of one frame and one canvas, which is as large as the frames' areas reach, whatever the
header says; a frame needs all its samples, so a small file can't claim a large one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_arrow, texts

WIDTH = 64
ROWS = 256  # of a frame, at most
DELAY = 4  # hundredths of a second
GREY = bytes(v for i in range(256) for v in (i, i, i))
HISTOGRAM = 16  # bins of a channel
MOST_PIXELS = 1 << 26  # of a canvas; a GIF whose frames reach over more is not read


@lru_cache
def _run(least: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and first bits of the ``n`` codes after a clear code: the k-th is read with k - 1 entries made."""
    free = (1 << least) + 2 + np.maximum(np.arange(n) - 1, 0)
    widths = np.full(n, least + 1, np.int64)
    for w in range(least + 1, 12):
        widths += free >= 1 << w
    ends = np.cumsum(widths)
    return widths, ends - widths


#: Codes between two clear codes when the table is emptied as soon as it is full.
_FULL = 4096 - 258 + 1
_AHEAD = 4096  # codes that are unpacked at a time


def lzw_encode(samples: bytes) -> bytes:
    """GIF LZW with minimum code size 8; the table is cleared when it is full."""
    codes: list[int] = [256]
    append, table, free, code = codes.append, {}, 258, samples[0]
    for b in memoryview(samples)[1:]:
        key = code << 8 | b
        if key in table:
            code = table[key]
        else:
            append(code)
            if free < 4096:
                table[key] = free
                free += 1
            else:
                append(256)
                table, free = {}, 258
            code = b
    append(code)
    append(257)
    values = np.array(codes, np.uint32)
    clears = np.flatnonzero(values == 256)
    widths = np.empty(len(values), np.int64)
    for a, b in zip(clears.tolist(), [*clears[1:].tolist(), len(values)], strict=True):
        widths[a + 1 : b] = _run(8, _FULL + 2)[0][: b - a - 1]
        widths[a] = 12
    widths[0] = 9
    ends = np.cumsum(widths)
    starts = ends - widths
    values <<= (starts & 7).astype(np.uint32)
    # A code is wider than a byte, so no two codes begin in the same one.
    at, size = starts >> 3, int(ends[-1] + 7) // 8
    out = np.zeros(size + 3, np.uint8)
    for k in range(3):
        out[at + k] |= (values >> np.uint32(8 * k)).astype(np.uint8)
    return out[:size].tobytes()


def _codes(raw: np.ndarray, bit: int, widths: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    """The codes of these widths from ``bit`` on, as many as are whole."""
    at = starts + bit
    n = int(np.searchsorted(at + widths, total, side="right"))
    at, widths = at[:n], widths[:n]
    byte = at >> 3
    value = raw[byte] | raw[byte + 1] << np.uint32(8) | raw[byte + 2] << np.uint32(16)
    return (value >> (at & 7).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)


def lzw_decode(data: bytes, least: int, size: int) -> bytes:
    """Samples of a GIF LZW stream, at most ``size``; a broken stream gives what it holds so far."""
    if not 1 <= least <= 11:
        return b""
    clear, stop = 1 << least, (1 << least) + 1
    base = [bytes((i & 255,)) for i in range(clear)] + [b"", b""]
    raw, total, bit = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32), 8 * len(data), 0
    widths, starts = _run(least, _AHEAD + 1)
    out: list[bytes] = []
    append, made, done = out.append, 0, 0  # done: codes since the last clear code
    table, last = list(base), b""
    while True:
        if done < _AHEAD:
            w, s = widths[done:_AHEAD], starts[done:_AHEAD] - starts[done]
        else:
            w, s = np.full(_AHEAD, 12, np.int64), np.arange(_AHEAD, dtype=np.int64) * 12
        codes = _codes(raw, bit, w, s, total)
        if not len(codes):
            break
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        n = int(marks[0]) if len(marks) else len(codes)
        add, run = table.append, codes[:n].tolist()
        if run and not last:
            if run[0] >= clear:
                break
            last = table[run[0]]
            append(last)
            del run[0]
        room = 4096 - len(table)
        try:
            for code in run[:room]:
                try:
                    now = table[code]
                except IndexError:
                    if code != len(table):
                        raise
                    now = last + last[:1]
                add(last + now[:1])
                append(now)
                last = now
            for code in run[room:]:
                last = table[code]
                append(last)
        except IndexError:
            break
        if not len(marks):
            done += n
            bit += int(s[n - 1] + w[n - 1])
            made = sum(map(len, out)) if done > 4 * _AHEAD else made
            if made >= size:
                break
            continue
        if codes[n] == stop:
            break
        bit += int(s[n] + w[n])
        table, last, done = list(base), b"", 0
        if not n and total - bit < least + 1:
            break
    return b"".join(out)[:size]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(p),)) + p for i in range(0, len(data), 255) if (p := data[i : i + 255])) + b"\0"


def encode(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """An animated GIF of the samples, row by row; their number must be a positive multiple of ``width``."""
    if not samples or len(samples) % width:
        raise ValueError("samples must fill whole rows")
    height = min(rows, len(samples) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), GREY]
    for at in range(0, len(samples), width * height):
        part = samples[at : at + width * height]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    number: int
    start: int  # hundredths of a second
    delay: int
    left: int
    top: int
    canvas: np.ndarray  # height x width x 4, what is shown
    indices: np.ndarray  # the frame's own rows x columns


@dataclass
class _Part:
    """A frame as it stands in the file."""

    left: int
    top: int
    width: int
    height: int
    interlaced: bool
    palette: np.ndarray | None
    least: int
    stream: bytes
    delay: int
    clear: int | None
    disposal: int


def _palette(data: bytes, at: int, flags: int) -> np.ndarray | None:
    n = 3 * (2 << (flags & 7))
    return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3) if at + n <= len(data) else None


def _parts(data: bytes) -> list[_Part]:
    """The frames of a GIF without their pixels; what breaks off ends the list."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        shared = _palette(data, at, flags)
        at += 3 * (2 << (flags & 7))
    out: list[_Part] = []
    delay, clear, disposal = 0, None, 0

    def gather(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1] if at + 1 < len(data) else 0
            body, at = gather(at + 2)
            if kind == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                clear = body[3] if body[0] & 1 else None
        elif data[at] == 0x2C and at + 11 <= len(data):
            left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if local & 0x80:
                palette = _palette(data, at, local)
                at += 3 * (2 << (local & 7))
                if palette is None or at >= len(data):
                    break
            least = data[at]
            stream, at = gather(at + 1)
            out.append(_Part(left, top, w, h, bool(local & 0x40), palette, least, stream, delay, clear, disposal))
            delay, clear, disposal = 0, None, 0
        else:
            break
    reach = [min(limit, max((x + y for x, y in areas), default=0)) for limit, areas in ((width, [(p.left, p.width) for p in out]), (height, [(p.top, p.height) for p in out]))]
    if reach[0] * reach[1] > MOST_PIXELS:
        raise ValueError(f"the frames reach over {reach[0]} x {reach[1]} pixels")
    for p in out:
        p.left, p.top = min(p.left, reach[0]), min(p.top, reach[1])
    return [_Part(0, 0, *reach, False, None, 0, b"", 0, None, 0), *out]


def read(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF one after the other; a file that breaks off gives those before the break.

    A frame whose stream has not all its samples is a break. The canvas reaches as far as the frames do,
    inside the header's screen. It is one array that the next frame draws on: copy it to keep it.
    """
    screen, *parts = _parts(data)
    canvas, start = None, 0
    for number, p in enumerate(parts):
        got = lzw_decode(p.stream, p.least, p.width * p.height)
        if len(got) < p.width * p.height:
            return
        if canvas is None:
            canvas = np.zeros((screen.height, screen.width, 4), np.uint8)
        indices = np.frombuffer(got, np.uint8).reshape(p.height, p.width)
        if p.interlaced:
            order = np.concatenate([np.arange(a, p.height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            indices = indices[np.argsort(order)]
        area = canvas[p.top : p.top + p.height, p.left : p.left + p.width]
        before = area.copy() if p.disposal == 3 else None
        if p.palette is not None:
            own = indices[: area.shape[0], : area.shape[1]]
            shown = own < len(p.palette)
            if p.clear is not None:
                shown &= own != p.clear
            area[shown, :3] = p.palette[own[shown]]
            area[shown, 3] = 255
        yield Frame(number, start, p.delay, p.left, p.top, canvas, indices)
        start += p.delay
        if p.disposal == 2:
            area[:] = 0
        elif p.disposal == 3:
            area[:] = before


def decode(data: bytes) -> list[Frame]:
    """All frames of a GIF, each with a canvas of its own."""
    return [replace(f, canvas=f.canvas.copy()) for f in read(data)]


def histogram(frame: Frame) -> np.ndarray:
    """Counts of the shown pixels of each channel in 16 bins: 48 numbers."""
    own = frame.canvas[frame.top : frame.top + frame.indices.shape[0], frame.left : frame.left + frame.indices.shape[1]]
    seen = own[own[..., 3] > 0][:, :3]
    return np.concatenate([np.bincount(seen[:, c] >> 4, minlength=HISTOGRAM) for c in range(3)])


def samples_of(frame: Frame) -> bytes:
    """The stored samples of a frame, read from the decoded picture (red channel of the shown rows)."""
    return frame.canvas[frame.top : frame.top + frame.indices.shape[0], frame.left : frame.left + frame.indices.shape[1], 0].tobytes()


def pad(raw: bytes, unit: int = WIDTH) -> bytes:
    return raw + bytes(-len(raw) % unit if raw else unit)


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("gif", pa.binary())])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts(rows.column("text"))]
        yield batch(_STORED, doc_id=rows.column("doc_id"), n_bytes=[len(r) for r in raw], gif=[encode(pad(r)) for r in raw])


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, gif): every text's bytes, zero-padded to whole rows, as an animated GIF.

    A null or empty text is one row of zeros; repeated rows come back repeated; no rows, no rows.
    """
    return map_arrow(docs.select("doc_id", "text"), _store, "doc_id long, n_bytes long, gif binary")


def frames(media: DataFrame, column: str = "gif", key: str = "doc_id") -> DataFrame:
    """One row per frame of every GIF: key, frame, start_ms, delay_ms, width, height, pixels (RGBA), red, green, blue.

    A null value and one that is no GIF, or whose frames reach over more than MOST_PIXELS, has no rows.
    """
    schema = "key long, frame int, start_ms int, delay_ms int, width int, height int, pixels binary, red array<int>, green array<int>, blue array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k, data in zip(rows.column("key").to_pylist(), rows.column("media").to_pylist(), strict=True):
                try:
                    found = read(data or b"")
                    first = next(found, None)
                except ValueError:
                    continue
                for f in chain([first] if first else [], found):
                    h = histogram(f).tolist()
                    values = [[k], [f.number], [10 * f.start], [10 * f.delay], [f.canvas.shape[1]], [f.canvas.shape[0]], [f.canvas.tobytes()], [h[:16]], [h[16:32]], [h[32:]]]
                    kinds = [pa.int64(), *[pa.int32()] * 5, pa.binary(), *[pa.list_(pa.int32())] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["key", "frame", "start_ms", "delay_ms", "width", "height", "pixels", "red", "green", "blue"])

    return map_arrow(media.select(F.col(key).alias("key"), F.col(column).alias("media")), run, schema).withColumnRenamed("key", key)


_FRAME = pa.struct([("start_ms", pa.int32()), ("delay_ms", pa.int32()), ("red", pa.list_(pa.int32())), ("green", pa.list_(pa.int32())), ("blue", pa.list_(pa.int32()))])
_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
    + [("feature", pa.string()), ("n_frames", pa.int32()), ("duration_ms", pa.int32()), ("frames", pa.list_(_FRAME))]
)


def digest(data: bytes) -> tuple:
    """What the digest table says of a stored text, read from its GIF frame by frame."""
    size, hashed, tail, red, timed = 0, hashlib.sha256(), b"", np.zeros(HISTOGRAM, np.int64), []
    for f in read(data):
        payload, h = samples_of(f), histogram(f)
        size += len(payload)
        hashed.update(payload)
        tail = (tail + payload)[-64:]
        red += h[:HISTOGRAM]
        timed.append({"start_ms": 10 * f.start, "delay_ms": 10 * f.delay, "red": h[:16], "green": h[16:32], "blue": h[32:]})
    return size, hashed.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), ",".join(map(str, red.tolist())), len(timed), sum(t["delay_ms"] for t in timed), timed


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        columns = [list(c) for c in zip(*map(digest, rows.column("gif").to_pylist()), strict=True)] or [[]] * 9
        yield batch(_DIGEST, doc_id=rows.column("doc_id"), n_bytes=rows.column("n_bytes"), **dict(zip(_DIGEST.names[2:], columns, strict=True)))


def media_digests(stored: DataFrame) -> DataFrame:
    """Digest columns and timed frames with their histograms, read back from the stored GIFs of ``store_texts``."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms int"
    frame = "struct<start_ms: int, delay_ms: int, red: array<int>, green: array<int>, blue: array<int>>"
    return map_arrow(stored, _digest, f"{schema}, frames array<{frame}>")
