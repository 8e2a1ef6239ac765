"""AVI motion-JPEG columns: bytes to film and back, and its shots as timed clips.

A film is a RIFF AVI file with one video stream of intra frames and an
``idx1`` index. Frames are lossless JPEG (SOF3, 8-bit samples, predictor 1,
one restart interval a line), 24 x 24 grey samples, so the stored samples are
the payload's bytes. All lines of all frames of a batch are coded and decoded
side by side, sample by sample.

Shots: grey histograms of neighbouring frames are compared; a frame begins a
shot if its difference exceeds the recent mean by three deviations, and at
least ``LEAST_CUT``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quarry.llm import kernels as K
from quarry.llm.common import fresh

SIDE = 24
FRAME = SIDE * SIDE
#: Frames a second.
RATE = 25
#: Differences that the adaptive threshold looks back on, and the least difference of a cut, in hundredths.
RECENT, LEAST_CUT = 12, 35
BINS = 16
#: Payload bytes handled at once.
SLICE = 500_000
#: Frames coded at once, also of one long text.
AT_ONCE = 1024

#: Code lengths of difference categories 0 to 8; canonical codes follow from them.
_LENGTH = np.array([4, 4, 3, 3, 3, 3, 3, 3, 4])
_BY_LENGTH = [int((_LENGTH == n).sum()) for n in range(1, 17)]
_SYMBOLS = [int(s) for n in range(1, 17) for s in np.flatnonzero(_LENGTH == n)]


def _codes(by_length: list[int], symbols: list[int]) -> Iterator[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical table."""
    code, at = 0, 0
    for length, count in enumerate(by_length, 1):
        for _ in range(count):
            yield symbols[at], code, length
            code, at = code + 1, at + 1
        code <<= 1


_CODE = np.zeros(9, dtype=np.int64)
for _s, _c, _n in _codes(_BY_LENGTH, _SYMBOLS):
    _CODE[_s] = _c
#: Category of each difference -255 .. 255.
_CATEGORY = np.array([abs(d).bit_length() for d in range(-255, 256)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEADER = (
    b"\xff\xd8"
    + _segment(0xC3, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, bytes([0, *_BY_LENGTH, *_SYMBOLS]))
    + _segment(0xDD, struct.pack(">H", SIDE))
    + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
)


def _scans(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded data, end of image included, of frames [frames, SIDE, SIDE]."""
    frames = len(samples)
    lines = frames * SIDE
    value = samples.reshape(lines, SIDE).astype(np.int64)
    before = np.full((lines, SIDE), 128, dtype=np.int64)
    before[:, 1:] = value[:, :-1]
    difference = value - before
    category = _CATEGORY[difference + 255]
    extra = np.where(difference < 0, difference + (1 << category) - 1, difference)
    bits = _LENGTH[category] + category
    word = (_CODE[category] << category) | extra
    end = np.cumsum(bits, axis=1)
    start = end - bits
    shifted = word << (24 - (start & 7) - bits)
    width = SIDE * 12 // 8 + 6
    data = np.zeros((lines, width), dtype=np.uint8)
    flat = data.reshape(-1)
    base = np.arange(lines) * width
    for c in range(SIDE):
        at, v = base + (start[:, c] >> 3), shifted[:, c]
        flat[at] |= (v >> 16).astype(np.uint8)
        flat[at + 1] |= ((v >> 8) & 255).astype(np.uint8)
        flat[at + 2] |= (v & 255).astype(np.uint8)
    total = end[:, -1]
    size = (total + 7) >> 3
    # Ones fill the last byte; a marker follows each line.
    row = np.arange(lines)
    data[row, size - 1] |= ((1 << (-total & 7)) - 1).astype(np.uint8)
    data[row, size] = 0xFF
    line = row % SIDE
    data[row, size + 1] = np.where(line == SIDE - 1, 0xD9, 0xD0 + (line & 7))
    column = np.arange(width)
    kept = column < (size + 2)[:, None]
    stuffed = kept & (data == 0xFF) & (column < size[:, None])
    room = kept.astype(np.int64) + stuffed
    place = np.cumsum(room[kept])
    out = np.zeros(int(place[-1]) if len(place) else 0, dtype=np.uint8)
    out[place - room[kept]] = data[kept]
    edges = np.concatenate(([0], np.cumsum(room.sum(axis=1).reshape(frames, SIDE).sum(axis=1)))).tolist()
    blob = out.tobytes()
    return [blob[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def avi(images: list[bytes]) -> bytes:
    """An AVI file of JPEG images."""
    largest = max(map(len, images), default=0)
    header = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, len(images), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4h", 0, 0, 0, 0, 1, RATE, 0, len(images), largest, -1, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = _list(b"hdrl", _chunk(b"avih", header) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", form)))
    parts, index, at = [], [], 4
    for image in images:
        parts.append(_chunk(b"00dc", image))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        at += len(parts[-1])
    return _chunk(b"RIFF", b"AVI " + hdrl + _list(b"movi", b"".join(parts)) + _chunk(b"idx1", b"".join(index)))


def frames_of(film: bytes) -> list[tuple[int, int]]:
    """(begin, size) of every video frame, from the RIFF index."""
    if film[:4] != b"RIFF" or film[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    at, movi, index = 12, -1, b""
    end = min(len(film), 8 + struct.unpack_from("<I", film, 4)[0])
    while at + 8 <= end:
        name, size = film[at : at + 4], struct.unpack_from("<I", film, at + 4)[0]
        if name == b"LIST" and film[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = film[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi < 0:
        raise ValueError("no frames list")
    entries = np.frombuffer(index[: len(index) // 16 * 16], dtype=np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    entries = entries[(entries["id"] == b"00dc") | (entries["id"] == b"00db")]
    # Offsets count from the list's name, or in some files from the file's start.
    origin = movi if not len(entries) or film[movi + int(entries["at"][0]) :][:4] == bytes(entries["id"][0]) else 0
    return [(origin + a + 8, n) for a, n in zip(entries["at"].tolist(), entries["size"].tolist(), strict=True)]


class _Header:
    """What stands before the entropy-coded data of a lossless JPEG."""

    def __init__(self, image: bytes):
        at, self.restart = 2, 0
        if image[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG image")
        table = None
        while True:
            if image[at] != 0xFF:
                raise ValueError("a JPEG marker is missing")
            marker, size = image[at + 1], struct.unpack_from(">H", image, at + 2)[0]
            body = image[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC3:
                bits, self.height, self.width, components = struct.unpack(">BHHB", body[:6])
                if bits != 8 or components != 1:
                    raise ValueError("only grey 8-bit frames are supported")
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only lossless frames (SOF3) are supported")
            elif marker == 0xC4:
                table = ([*body[1:17]], [*body[17:]])
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                if body[3] != 1:
                    raise ValueError("only predictor 1 is supported")
                break
        if table is None or self.restart != self.width:
            raise ValueError("a table and one restart interval a line are needed")
        self.bytes = image[:at]
        self.symbol, self.length = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        for symbol, code, length in _codes(*table):
            first = code << (16 - length)
            self.symbol[first : first + (1 << (16 - length))] = symbol
            self.length[first : first + (1 << (16 - length))] = length


_headers: list[_Header] = []


def _header(image: bytes) -> _Header:
    for h in _headers:
        if image.startswith(h.bytes):
            return h
    _headers.append(_Header(image))
    del _headers[:-16]
    return _headers[-1]


def _decoded(header: _Header, scans: list[bytes]) -> np.ndarray:
    """Samples [lines, width] of frames with one header."""
    raw = np.frombuffer(b"".join(scans), dtype=np.uint8)
    marked = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[marked + 1]
    drop = np.zeros(len(raw), dtype=bool)
    drop[marked[after == 0] + 1] = True
    stops = marked[after != 0]
    drop[stops] = drop[stops + 1] = True
    kept = np.cumsum(~drop)
    data = np.concatenate((raw[~drop], np.zeros(8, dtype=np.uint8))).astype(np.int64)
    begin = np.concatenate(([0], kept[stops[:-1] + 1])) if len(stops) else np.zeros(0, np.int64)
    if len(stops) != len(scans) * header.height:
        raise ValueError("a frame's lines are damaged")
    window = (data[:-4] << 32) | (data[1:-3] << 24) | (data[2:-2] << 16) | (data[3:-1] << 8) | data[4:]
    bit = begin * 8
    out = np.zeros((len(begin), header.width), dtype=np.uint8)
    before = np.full(len(begin), 128, dtype=np.int64)
    for c in range(header.width):
        w, shift = window[bit >> 3], bit & 7
        peek = (w >> (24 - shift)) & 0xFFFF
        category, length = header.symbol[peek], header.length[peek]
        used = length + category
        extra = (w >> (40 - shift - used)) & ((1 << category) - 1)
        before = (before + np.where(extra < ((1 << category) >> 1), extra - (1 << category) + 1, extra)) & 0xFF
        out[:, c] = before
        bit = bit + used
    return out


def film(payloads: list[bytes]) -> list[bytes]:
    """AVI files of payloads, whose lengths are positive multiples of FRAME."""
    samples = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, SIDE, SIDE)
    images = [_HEADER + s for a in range(0, len(samples), AT_ONCE) for s in _scans(samples[a : a + AT_ONCE])]
    out, at = [], 0
    for p in payloads:
        n = len(p) // FRAME
        out.append(avi(images[at : at + n]))
        at += n
    return out


def samples_of(films: list[bytes]) -> list[np.ndarray]:
    """Samples of each film, [frames, height * width], decoded from its frames."""
    spots: dict[int, tuple[_Header, list[bytes]]] = {}
    order = []
    for f in films:
        own = []
        for a, n in frames_of(f):
            header = _header(f[a : a + n])
            _, scans = spots.setdefault(id(header), (header, []))
            own.append((id(header), len(scans)))
            scans.append(f[a + len(header.bytes) : a + n])
        order.append(own)
    pixels = {k: np.concatenate([_decoded(h, s[a : a + AT_ONCE]).reshape(len(s[a : a + AT_ONCE]), -1) for a in range(0, len(s), AT_ONCE)]) for k, (h, s) in spots.items()}
    out = []
    for own in order:
        if len({k for k, _ in own}) > 1:
            raise ValueError("frames of one film differ in form")
        out.append(pixels[own[0][0]][own[0][1] : own[-1][1] + 1] if own else np.zeros((0, FRAME), np.uint8))
    return out


def _read(films: list[bytes]) -> list[np.ndarray | None]:
    """:func:`samples_of`; None for films that can't be read, whatever is wrong with them."""
    try:
        return list(samples_of(films))
    except (ValueError, IndexError, struct.error):
        if len(films) == 1:
            return [None]
        return [own for f in films for own in _read([f])]


def shots(samples: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot."""
    n = len(samples)
    if not n:
        return []
    histogram = np.bincount((np.arange(n)[:, None] * BINS + (samples >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    # Hundredths of the samples that moved to another bin.
    change = np.abs(np.diff(histogram, axis=0)).sum(axis=1) * 50 // samples.shape[1]
    total = np.concatenate(([0], np.cumsum(change)))
    square = np.concatenate(([0], np.cumsum(change * change)))
    i = np.arange(len(change))
    a = np.maximum(i - RECENT, 0)
    count = np.maximum(i - a, 1)
    mean = (total[i] - total[a]) / count
    deviation = np.sqrt(np.maximum((square[i] - square[a]) / count - mean * mean, 0))
    cuts = np.flatnonzero((change >= LEAST_CUT) & (change > mean + 3 * deviation)) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _sliced(values: list[bytes]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, v in enumerate(values):
        if size and size + len(v) > SLICE:
            yield begin, i
            begin, size = i, 0
        size += len(v)
    if begin < len(values):
        yield begin, len(values)


def padded(text: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of FRAME."""
    return text + b"\xff" * (-len(text) % FRAME if text else FRAME)


def film_column(text: str | Column) -> Column:
    """The film of each text's UTF-8 bytes, padded; null counts as empty. Equal texts give equal films."""

    @arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        K.trim()
        payloads = [padded(t or b"") for t in values.cast(pa.binary()).to_pylist()]
        return pa.array([f for a, b in _sliced(payloads) for f in film(payloads[a:b])], pa.binary())

    return run(text)


def read_column(media: str | Column) -> Column:
    """Struct read from each film: payload, and clips (first and last frame, start and end in ms). A null film and a malformed one give null."""

    @arrow_udf("struct<payload:binary,clips:array<struct<first:int,last:int,start_ms:bigint,end_ms:bigint>>>")
    def run(values: pa.Array) -> pa.Array:
        K.trim()
        films = values.to_pylist()
        there = [f for f in films if f is not None]
        payloads, clips = [], []
        for a, b in _sliced(there):
            for own in _read(there[a:b]):
                payloads.append(None if own is None else own.tobytes())
                if own is None:
                    clips.append(None)
                    continue
                clips.append([{"first": x, "last": y - 1, "start_ms": x * 1000 // RATE, "end_ms": y * 1000 // RATE} for x, y in shots(own)])
        found = iter(zip(payloads, clips, strict=True))
        both = [next(found) if f is not None else (None, None) for f in films]
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array([p for p, _ in both], pa.binary()), pa.array([c for _, c in both], kind)], names=["payload", "clips"], mask=pa.array([p is None for p, _ in both], pa.bool_()))

    return run(media)


def clip_rows(films: DataFrame, media: str = "media") -> DataFrame:
    """``films`` without ``media``, a row for each clip: clip (from 0), first and last frame, start_ms and end_ms.

    Null and malformed films have no clips.
    """
    back = fresh(films, "back")
    rest = [c for c in films.columns if c != media]
    rows = films.withColumn(back, read_column(media)).select(*rest, F.posexplode(F.col(back)["clips"]).alias("clip", back))
    return rows.select(*rest, "clip", *[F.col(back)[n].alias(n) for n in ("first", "last", "start_ms", "end_ms")])
