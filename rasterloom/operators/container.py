"""The container of a compressed image: reading its marker segments into records, writing records as bytes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from . import batch, scan
from .errors import ArgumentError, Code, StreamError
from .scan import NONE, Preset

# Fixed values of the format: marker codes, kinds of files, fields of the file header, the size of a segment
SOI, EOI, SOS, DNL, DRI, SOF, LSE, COM, APP0, APP8, RST0 = 0xD8, 0xD9, 0xDA, 0xDC, 0xDD, 0xF7, 0xF8, 0xFE, 0xE0, 0xE8, 0xD0
#: Frames of other codecs of the same family.
FOREIGN = frozenset((0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xF9))
UNKNOWN, INTERCHANGE, IMAGE_ONLY, TABLES_ONLY = 0, 1, 2, 3
SPIFF_FIELDS = ("profile", "component_count", "height", "width", "colour_space", "bits_per_sample", "compression", "resolution_unit", "vertical_resolution", "horizontal_resolution")
SEGMENT_MOST = 65_533


@dataclass
class Component:
    id: int
    near: int = 0
    mode: int = 0
    table_id: int = 0


@dataclass
class Table:
    id: int
    entry_size: int
    parts: list[bytes] = field(default_factory=list)

    @property
    def data(self) -> bytes:
        return b"".join(self.parts)


@dataclass
class Scan:
    component_ids: list[int]
    near: int
    mode: int
    offset: int
    preset: Preset
    interval: int


class Reader:
    """Reads segments in order; what a step finds is in the attributes, `segments` has (offset, marker, data's offset, size)."""

    def __init__(self, data: bytes, spiff: bool = True) -> None:
        self.data, self.at, self.want_spiff = data, 0, spiff
        self.width = self.height = self.bits = self.count = self.interval = self.transform = self.seen = 0
        self.components: list[Component] = []
        self.tables: list[Table] = []
        self.scans: list[Scan] = []
        self.segments: list[tuple[int, int, int, int]] = []
        self.spiff: dict[str, int] | None = None
        self.preset = Preset()
        self.format, self.frame, self.in_spiff, self.after_spiff = UNKNOWN, False, False, False

    def _bytes(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise StreamError(Code.NEED_MORE_DATA)
        self.at += n
        return self.data[self.at - n : self.at]

    def _number(self, n: int) -> int:
        v = int.from_bytes(self._bytes(n), "big")
        if v > 0x7FFFFFFF:
            raise StreamError(Code.VALUE_NOT_SUPPORTED)
        return v

    def marker(self) -> int:
        if self._bytes(1) != b"\xff":
            raise StreamError(Code.MARKER_START_NOT_FOUND)
        code = 0xFF
        while code == 0xFF:
            code = self._bytes(1)[0]
        return code

    def _segment(self, marker: int, start: int) -> None:
        size = self._number(2)
        if size < 2 or self.at + size - 2 > len(self.data):
            raise StreamError(Code.BAD_SEGMENT_SIZE)
        self.first, self.size, self.end = self.at, size - 2, self.at + size - 2
        self.segments.append((start, marker, self.at, self.size))

    def _sized(self, *sizes: int) -> None:
        if self.size not in sizes:
            raise StreamError(Code.BAD_SEGMENT_SIZE)

    def _least(self, size: int) -> None:
        if self.size < size:
            raise StreamError(Code.BAD_SEGMENT_SIZE)

    def _set_size(self, height: int, width: int) -> None:
        for name, value, code in (("height", height, Code.BAD_HEIGHT), ("width", width, Code.BAD_WIDTH)):
            if value:
                if getattr(self, name):
                    raise StreamError(code)
                setattr(self, name, value)

    def _legal(self, marker: int) -> None:
        if marker == SOS:
            if not self.frame:
                raise StreamError(Code.UNEXPECTED_SOS)
        elif marker == SOF:
            if self.frame:
                raise StreamError(Code.DUPLICATE_SOF)
        elif marker == DNL:
            raise StreamError(Code.UNEXPECTED_DNL)
        elif marker == SOI:
            raise StreamError(Code.DUPLICATE_SOI)
        elif marker in FOREIGN:
            raise StreamError(Code.ENCODING_NOT_SUPPORTED)
        elif RST0 <= marker < RST0 + 8:
            raise StreamError(Code.UNEXPECTED_RESTART)
        elif marker not in (DRI, LSE, COM) and not APP0 <= marker < APP0 + 16:
            raise StreamError(Code.UNKNOWN_MARKER)

    def header(self) -> Reader:
        """Up to the bits of the first scan, or to the end of a stream of tables."""
        start = self.at
        if self.marker() != SOI:
            raise StreamError(Code.SOI_NOT_FOUND)
        self.segments.append((start, SOI, self.at, 0))
        while not self.scans:
            start = self.at
            marker = self.marker()
            if marker == EOI:
                if self.tables and not self.frame and self.after_spiff:
                    raise StreamError(Code.TABLES_WITH_SPIFF)
                if not self.tables or self.frame or self.in_spiff:
                    raise StreamError(Code.UNEXPECTED_EOI)
                self.segments.append((start, EOI, self.at, 0))
                self.format = TABLES_ONLY
                return self
            self._legal(marker)
            self._segment(marker, start)
            if self.in_spiff:
                self._directory(marker)
            else:
                self._read(marker)
            self.at = self.end
        if not self.height:
            self._number_of_lines()
        if self.width < 1:
            raise StreamError(Code.BAD_WIDTH)
        if self.transform and not (self.count == 3 and self.bits in (8, 16)):
            raise StreamError(Code.BAD_COLOUR_TRANSFORM)
        return self

    def _directory(self, marker: int) -> None:
        if marker != APP8:
            raise StreamError(Code.SPIFF_DIRECTORY_NOT_ENDED)
        self._least(4)
        if self._number(4) == 1:
            self._sized(6)
            self.in_spiff, self.after_spiff = False, True

    def _read(self, marker: int) -> None:
        if marker == SOF:
            self._frame()
        elif marker == SOS:
            self._scan()
        elif marker == LSE:
            self._preset()
        elif marker == DRI:
            self._sized(2, 3, 4)
            self.interval = self._number(self.size)
        elif marker == APP8:
            self._app8()

    def _frame(self) -> None:
        self._least(6)
        self.bits = self._number(1)
        if not 2 <= self.bits <= 16:
            raise StreamError(Code.BAD_BITS)
        height = self._number(2)
        self._set_size(height, self._number(2))
        self.count = self._number(1)
        if not self.count:
            raise StreamError(Code.BAD_COMPONENT_COUNT)
        self._sized(6 + 3 * self.count)
        for _ in range(self.count):
            number, sampling, _ = self._bytes(3)
            if any(c.id == number for c in self.components):
                raise StreamError(Code.DUPLICATE_COMPONENT)
            self.components.append(Component(number))
            if sampling != 0x11:
                raise StreamError(Code.VALUE_NOT_SUPPORTED)
        self.frame = True

    def _scan(self) -> None:
        self._least(1)
        n = self._number(1)
        if not 1 <= n <= 4 or n > self.count - self.seen:
            raise StreamError(Code.BAD_COMPONENT_COUNT)
        self.seen += n
        self._sized(4 + 2 * n)
        listed = [tuple(self._bytes(2)) for _ in range(n)]
        near, mode, point = self._bytes(3)
        if near > min(255, (self.preset.maxval or (1 << self.bits) - 1) // 2):
            raise StreamError(Code.BAD_NEAR)
        if mode > 2 or (mode and n == 1):
            raise StreamError(Code.BAD_INTERLEAVE)
        for number, table in listed:
            if table or near or mode:
                own = next((c for c in self.components if c.id == number), None)
                if own is None:
                    raise StreamError(Code.UNKNOWN_COMPONENT)
                own.near, own.mode, own.table_id = near, mode, table
        if point & 15:
            raise StreamError(Code.VALUE_NOT_SUPPORTED)
        self.scans.append(Scan([x for x, _ in listed], near, mode, self.end, self.preset, self.interval))

    def _preset(self) -> None:
        self._least(1)
        kind = self._number(1)
        if kind == 1:
            self._sized(11)
            self.preset = Preset(*(self._number(2) for _ in range(5)))
        elif kind in (2, 3):
            self._least(3)
            number, entry = self._bytes(2)
            old = next((t for t in self.tables if t.id == number), None)
            part = self._bytes(self.end - self.at)
            if kind == 2:
                if not number or old:
                    raise StreamError(Code.BAD_TABLE_ID)
                self.tables.append(Table(number, entry, [part]))
            elif old is None or old.entry_size != entry:
                raise StreamError(Code.BAD_TABLE_CONTINUATION)
            else:
                old.parts.append(part)
        elif kind == 4:
            self._least(3)
            wide = self._number(1)
            if wide not in (2, 3, 4):
                raise StreamError(Code.BAD_PRESET)
            self._sized(2 + 2 * wide)
            height = self._number(wide)
            self._set_size(height, self._number(wide))
        else:
            raise StreamError(Code.EXTENDED_PRESET_NOT_SUPPORTED if kind <= 0xD else Code.BAD_PRESET_TYPE)

    def _app8(self) -> None:
        if self.size == 5 and self._bytes(4) == b"mrfx":
            code = self._number(1)
            if code > 5:
                raise StreamError(Code.BAD_COLOUR_TRANSFORM)
            if code > 3:
                raise StreamError(Code.COLOUR_TRANSFORM_NOT_SUPPORTED)
            self.transform = code
        elif self.want_spiff and self.spiff is None and not self.frame and self.size >= 30 and self._bytes(6) == b"SPIFF\0" and self._bytes(2)[0] <= 2:
            self.spiff = dict(zip(SPIFF_FIELDS, (self._number(n) for n in (1, 1, 4, 4, 1, 1, 1, 1, 4, 4)), strict=True))
            self.in_spiff = True

    def _number_of_lines(self) -> None:
        at = self.at
        while True:
            at = scan.marker_at(self.data, at)
            if at < 0:
                raise StreamError(Code.DNL_NOT_FOUND)
            if self.data[at + 1] == 0xFF or RST0 <= self.data[at + 1] < RST0 + 8:
                at += 1
                continue
            break
        if self.data[at + 1] != DNL:
            raise StreamError(Code.DNL_NOT_FOUND)
        held, self.at = self.at, at + 2
        size = self._number(2) - 2
        if size not in (2, 3, 4):
            raise StreamError(Code.BAD_SEGMENT_SIZE)
        self.height, self.at = self._number(size), held
        if not self.height:
            raise StreamError(Code.BAD_HEIGHT)
        self.dnl = at

    dnl = -1

    def next_scan(self) -> None:
        n = len(self.scans)
        while len(self.scans) == n:
            start = self.at
            marker = self.marker()
            if marker == DNL and start == self.dnl:
                self._segment(marker, start)
            else:
                self._legal(marker)
                self._segment(marker, start)
                self._read(marker)
            self.at = self.end

    def finish(self) -> None:
        start = self.at
        if self.marker() != EOI:
            raise StreamError(Code.EOI_NOT_FOUND)
        self.segments.append((start, EOI, self.at, 0))
        known = {t.id for t in self.tables}
        self.format = IMAGE_ONLY if any(c.table_id and c.table_id not in known for c in self.components) else INTERCHANGE

    def explicit(self, s: Scan) -> Preset:
        out = scan.explicit_preset(s.preset, self.bits, s.near)
        if out is None:
            raise StreamError(Code.BAD_PRESET)
        return out

    def all_segments(self) -> Reader:
        """Reads everything but the samples: from scan to scan by markers alone."""
        self.header()
        if self.format == TABLES_ONLY:
            return self
        while True:
            at = scan.marker_at(self.data, self.at)
            while at >= 0 and (RST0 <= self.data[at + 1] < RST0 + 8 or self.data[at + 1] == 0xFF):
                at = scan.marker_at(self.data, at + 1)
            if at < 0:
                raise StreamError(Code.NEED_MORE_DATA)
            self.at = at
            if self.seen == self.count:
                if at == self.dnl:
                    self.at = at + 2
                    self._segment(DNL, at)
                    self.at = self.end
                self.finish()
                return self
            self.next_scan()

    def spiff_is_valid(self) -> bool:
        s = self.spiff
        if s is None:
            return False
        spaces = {1: (8,), 3: (1, 3, 4, 10, 14), 4: (9, 13)}.get(self.count, ())
        spaces = {*spaces, 2, 11, 12} if self.count in (3, 4) else {*spaces, 2}
        return s["compression"] == 6 and s["profile"] == 0 and s["resolution_unit"] <= 2 and min(s["vertical_resolution"], s["horizontal_resolution"]) > 0 and (s["component_count"], s["height"], s["width"], s["bits_per_sample"]) == (self.count, self.height, self.width, self.bits) and s["colour_space"] in spaces and s["colour_space"] != 0


# Samples and their layout


def transform_forward(rgb: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """rgb: three planes of int32."""
    m, h = (1 << bits) - 1, 1 << (bits - 1)
    r, g, b = rgb
    if kind == 1:
        return np.stack(((r - g + h) & m, g, (b - g + h) & m))
    if kind == 2:
        return np.stack(((r - g + h) & m, g, (b - ((r + g) >> 1) - h) & m))
    v2, v3 = (b - g + h) & m, (r - g + h) & m
    return np.stack(((g + ((v2 + v3) >> 2) - (h >> 1)) & m, v2, v3))


def transform_inverse(v: np.ndarray, kind: int, bits: int) -> np.ndarray:
    m, h = (1 << bits) - 1, 1 << (bits - 1)
    a, b, c = v
    if kind == 1:
        return np.stack(((a + b - h) & m, b, (c + b - h) & m))
    if kind == 2:
        r = (a + b - h) & m
        return np.stack((r, b, (c + ((r + b) >> 1) - h) & m))
    g = a - ((c + b) >> 2) + (h >> 1)
    return np.stack(((c + g - h) & m, g & m, (b + g - h) & m))


def planes_to_bytes(planes: np.ndarray, bits: int, interleaved: bool, stride: int = 0) -> bytes:
    """planes: components x height x width. stride: bytes from row to row, 0 for no padding."""
    kind = "u1" if bits <= 8 else "<u2"
    rows = np.moveaxis(planes, 0, 2).reshape(planes.shape[1], -1) if interleaved else planes.reshape(-1, planes.shape[2])
    data = np.ascontiguousarray(rows.astype(kind))
    wide = data.shape[1] * data.itemsize
    if stride and stride < wide:
        raise ArgumentError(Code.ARGUMENT_STRIDE)
    if not stride or stride == wide:
        return data.tobytes()
    out = np.zeros((len(data), stride), np.uint8)
    out[:, :wide] = data.view(np.uint8).reshape(len(data), wide)
    return out.tobytes()[: (len(data) - 1) * stride + wide]


def bytes_to_planes(data: bytes, width: int, height: int, bits: int, components: int, interleaved: bool, stride: int = 0) -> np.ndarray:
    """Samples as int32, with bits above the sample's size dropped; the last row may go without its padding."""
    size = 1 if bits <= 8 else 2
    rows, wide = (height, width * components * size) if interleaved else (height * components, width * size)
    stride = stride or wide
    if stride < wide:
        raise ArgumentError(Code.ARGUMENT_STRIDE)
    if len(data) < (rows - 1) * stride + wide:
        raise ArgumentError(Code.ARGUMENT_SIZE)
    if stride == wide:
        block = np.frombuffer(data, np.uint8, rows * wide).reshape(rows, wide)
    else:
        block = np.frombuffer(data.ljust(rows * stride, b"\0"), np.uint8, rows * stride).reshape(rows, stride)[:, :wide]
    v = np.ascontiguousarray(block).view("u1" if size == 1 else "<u2").astype(np.int32) & ((1 << bits) - 1)
    return np.moveaxis(v.reshape(height, width, components), 2, 0) if interleaved else v.reshape(components, height, width)


def decode_scan(reader: Reader, s: Scan) -> tuple[np.ndarray, int]:
    """Samples of a scan's components, transformed back; and where the next marker stands."""
    n = len(s.component_ids)
    if s.mode == NONE and n > 1:
        raise StreamError(Code.BAD_INTERLEAVE)
    planes, at = scan.decode(reader.data, s.offset, (reader.height, reader.width), reader.bits, n, s.mode, s.near, reader.explicit(s), s.interval)
    if reader.transform and s.mode != NONE and n == 3:
        planes = transform_inverse(planes, reader.transform, reader.bits)
    return planes, at


def decode(data: bytes, stride: int = 0) -> tuple[Reader, bytes]:
    """The header, and all samples in the layout of each scan: planes or pixels, one scan after the other."""
    reader = Reader(data).header()
    if reader.format == TABLES_ONLY:
        return reader, b""
    out = []
    while True:
        s = reader.scans[-1]
        planes, reader.at = decode_scan(reader, s)
        out.append(planes_to_bytes(planes, reader.bits, s.mode != NONE, stride))
        if stride and reader.seen < reader.count:
            rows = reader.height * (1 if s.mode != NONE else len(planes))
            out[-1] = out[-1].ljust(rows * stride, b"\0")
        if reader.seen == reader.count:
            break
        reader.next_scan()
    if reader.data[reader.at : reader.at + 2] == bytes((0xFF, DNL)) and reader.at == reader.dnl:
        start = reader.at
        reader.at += 2
        reader._segment(DNL, start)
        reader.at = reader.end
    reader.finish()
    return reader, b"".join(out)


def split_intervals(reader: Reader, s: Scan) -> list[batch.Part]:
    """The restart intervals of a scan, found by their markers."""
    data, at, out = reader.data, s.offset, []
    kind = batch.Kind(reader.bits, len(s.component_ids), s.mode, s.near, reader.explicit(s))
    step = min(s.interval or reader.height, reader.height)
    for j, y in enumerate(range(0, reader.height, step)):
        end = scan.marker_at(data, at)
        if end < 0:
            raise StreamError(Code.NEED_MORE_DATA)
        out.append(batch.Part(data[at:end], min(step, reader.height - y), reader.width, kind))
        at = end
        if y + step < reader.height:
            while data[at + 1 : at + 2] == b"\xff":
                at += 1
            if data[at + 1] != RST0 + j % 8:
                raise StreamError(Code.RESTART_NOT_FOUND)
            at += 2
    if RST0 <= data[at + 1] < RST0 + 8:
        raise StreamError(Code.UNEXPECTED_RESTART)
    return out


def decode_many(files: list[bytes]) -> list[tuple[Reader, bytes] | StreamError]:
    """What `decode` gives for each file, or its error. Intervals of all files are decoded together, as far as memory allows."""
    out: list[tuple[Reader, bytes] | StreamError | None] = [None] * len(files)
    held: list[tuple[int, Reader, list[list[batch.Part]]]] = []
    size = 0

    def one(i: int) -> None:
        try:
            out[i] = decode(files[i])
        except StreamError as e:
            out[i] = e

    def flush() -> None:
        nonlocal size
        found = batch.decode_intervals([p for _, _, scans in held for own in scans for p in own], strict=False)
        for i, reader, scans in held:
            parts = []
            for s, own in zip(reader.scans, scans, strict=True):
                rows, found = found[: len(own)], found[len(own) :]
                if any(v is None for v in rows):
                    break
                planes = np.concatenate(rows, axis=1)
                if reader.transform and s.mode != NONE and len(planes) == 3:
                    planes = transform_inverse(planes, reader.transform, reader.bits)
                parts.append(planes_to_bytes(planes, reader.bits, s.mode != NONE))
            else:
                out[i] = reader, b"".join(parts)
        held.clear()
        size = 0

    for i, data in enumerate(files):
        try:
            reader = Reader(data).all_segments()
            if reader.format == TABLES_ONLY or any(s.mode == NONE and len(s.component_ids) > 1 for s in reader.scans):
                continue
            held.append((i, reader, [split_intervals(reader, s) for s in reader.scans]))
        except StreamError:
            continue
        size += reader.width * reader.height * reader.count
        if size >= batch.MOST_DECODED:
            flush()
    if held:
        flush()
    for i, got in enumerate(out):
        if got is None:  # something is wrong, or special: read from the start, in order, so that the first error is the one told
            one(i)
    return out


# Writing


@dataclass(frozen=True)
class Options:
    """How to encode. `tables`: (id, entry size, data); `table_ids`: of components, 0 for none; `spiff`: fields, or {} for the usual ones."""

    near: int = 0
    mode: int = NONE
    preset: Preset = Preset()
    transform: int = 0
    even_size: bool = False
    presets_for_wide: bool = False
    version_comment: bool = False
    comments: tuple[bytes, ...] = ()
    app_data: tuple[tuple[int, bytes], ...] = ()
    tables: tuple[tuple[int, int, bytes], ...] = ()
    table_ids: tuple[int, ...] = ()
    spiff: dict | None = None
    spiff_entries: tuple[tuple[int, bytes], ...] = ()
    restart_interval: int = 0


def segment(marker: int, data: bytes) -> bytes:
    if len(data) > SEGMENT_MOST:
        raise ArgumentError(Code.ARGUMENT_SIZE)
    return bytes((0xFF, marker)) + (len(data) + 2).to_bytes(2, "big") + data


def table_segments(number: int, entry: int, data: bytes) -> bytes:
    if not 1 <= number <= 255 or not 1 <= entry <= 255 or len(data) < entry:
        raise ArgumentError(Code.ARGUMENT)
    most, out = SEGMENT_MOST - 3, b""
    for at in range(0, len(data), most):
        out += segment(LSE, bytes((3 if at else 2, number, entry)) + data[at : at + most])
    return out


def spiff_segments(fields: dict, entries: tuple[tuple[int, bytes], ...] = ()) -> bytes:
    sizes = (1, 1, 4, 4, 1, 1, 1, 1, 4, 4)
    out = segment(APP8, b"SPIFF\0\x02\0" + b"".join(fields[k].to_bytes(n, "big") for k, n in zip(SPIFF_FIELDS, sizes, strict=True)))
    for tag, data in entries:
        if tag == 1 or len(data) > 65_528:
            raise ArgumentError(Code.ARGUMENT)
        out += segment(APP8, tag.to_bytes(4, "big") + data)
    return out + segment(APP8, b"\0\0\0\x01\xff\xd8")


def usual_spiff(width: int, height: int, bits: int, components: int) -> dict:
    return dict(zip(SPIFF_FIELDS, (0, components, height, width, {1: 8, 3: 10}.get(components, 2), bits, 6, 0, 1, 1), strict=True))


def tables_only(tables: tuple[tuple[int, int, bytes], ...]) -> bytes:
    return b"\xff\xd8" + b"".join(table_segments(*t) for t in tables) + b"\xff\xd9"


def estimated_size(width: int, height: int, bits: int, components: int) -> int:
    return width * height * components * ((bits + 7) // 8) + 1024 + 34


def encode(data: bytes, width: int, height: int, bits: int, components: int, options: Options | list[tuple[int, Options]] | None = None, stride: int = 0) -> bytes:
    """Compressed bytes. A list gives (number of components, options) for each group of components, in turn.

    data holds the groups one after the other, each in planes for mode 0 and in pixels otherwise.
    """
    return encode_many([(data, width, height, bits, components, options, stride)])[0]


def encode_many(images: list[tuple]) -> list[bytes]:
    """Compressed bytes of images, given as the arguments of `encode`; what is coded without loss goes together."""
    parts, units, places = [], [], []
    for i, image in enumerate(images):
        parts.append(own := _parts(*image))
        for j, part in enumerate(own):
            if not isinstance(part, bytes):
                planes, kind = part
                if kind.near:
                    own[j] = scan.encode(list(planes), kind.bits, kind.mode, kind.near, kind.preset)
                else:
                    units.append(part)
                    places.append((i, j))
    for (i, j), coded in zip(places, batch.encode_intervals(units), strict=True):
        parts[i][j] = coded
    out = []
    for (*_, options, _), own in zip(images, parts, strict=True):
        first = options[0][1] if isinstance(options, list) else options
        whole = b"".join(own)
        out.append(whole + (b"\xff\xff\xd9" if first and first.even_size and len(whole) % 2 else b"\xff\xd9"))
    return out


def _parts(data: bytes, width: int, height: int, bits: int, components: int, options: Options | list[tuple[int, Options]] | None, stride: int) -> list:
    """A file but its end, in pieces: bytes, or samples and how to code them."""
    groups = options if isinstance(options, list) else [(components, options or Options())]
    if width < 1:
        raise ArgumentError(Code.ARGUMENT_WIDTH)
    if height < 1:
        raise ArgumentError(Code.ARGUMENT_HEIGHT)
    if not 2 <= bits <= 16:
        raise ArgumentError(Code.ARGUMENT_BITS)
    if not 1 <= components <= 255 or sum(n for n, _ in groups) != components:
        raise ArgumentError(Code.ARGUMENT_COMPONENT_COUNT)
    o = groups[0][1]
    out = bytearray(b"\xff\xd8")
    if o.spiff is not None:
        out += spiff_segments(usual_spiff(width, height, bits, components) | o.spiff, o.spiff_entries)
    if o.version_comment:
        out += segment(COM, b"rasterloom 0.1\0")
    for comment in o.comments:
        out += segment(COM, comment)
    for number, own in o.app_data:
        if not 0 <= number <= 15:
            raise ArgumentError(Code.ARGUMENT)
        out += segment(APP0 + number, own)
    for table in o.tables:
        out += table_segments(*table)
    if o.transform:
        if not (components == 3 and bits in (8, 16)):
            raise ArgumentError(Code.ARGUMENT_COLOUR_TRANSFORM)
        out += segment(APP8, b"mrfx" + bytes((o.transform,)))
    big = max(width, height) > 65535
    out += segment(SOF, bytes((bits,)) + (0 if big else height).to_bytes(2, "big") + (0 if big else width).to_bytes(2, "big") + bytes((components,)) + b"".join(bytes((c + 1, 0x11, 0)) for c in range(components)))
    if big:
        out += segment(LSE, b"\x04\x04" + height.to_bytes(4, "big") + width.to_bytes(4, "big"))
    if o.restart_interval:
        out += segment(DRI, o.restart_interval.to_bytes(4, "big"))
    size, at, number, pieces = 1 if bits <= 8 else 2, 0, 0, []
    for n, g in groups:
        if g.mode not in (0, 1, 2) or (g.mode and not 2 <= n <= 4):
            raise ArgumentError(Code.ARGUMENT_INTERLEAVE)
        if not 0 <= g.near <= min(255, (g.preset.maxval or (1 << bits) - 1) // 2):
            raise ArgumentError(Code.ARGUMENT_NEAR)
        preset = scan.explicit_preset(g.preset, bits, g.near)
        if preset is None:
            raise ArgumentError(Code.ARGUMENT_PRESET)
        if not scan.is_default(g.preset, bits, g.near) or (g.presets_for_wide and bits > 12):
            out += segment(LSE, b"\x01" + b"".join(getattr(preset, k).to_bytes(2, "big") for k in ("maxval", "t1", "t2", "t3", "reset")))
        wide = (stride or width * size * (n if g.mode else 1)) * height * (1 if g.mode else n)
        planes = bytes_to_planes(data[at : at + wide], width, height, bits, n, g.mode != NONE, stride)
        at += wide
        if o.transform and g.mode != NONE and n == 3:
            planes = transform_forward(planes, o.transform, bits)
        for part in ([planes] if g.mode else [planes[i : i + 1] for i in range(n)]):
            ids = [(number + i + 1, (g.table_ids or o.table_ids)[number + i] if number + i < len(g.table_ids or o.table_ids) else 0) for i in range(len(part))]
            number += len(part)
            out += segment(SOS, bytes((len(part),)) + b"".join(map(bytes, ids)) + bytes((g.near, g.mode, 0)))
            step = min(o.restart_interval or height, height)
            for k, y in enumerate(range(0, height, step)):
                if k:
                    out += bytes((0xFF, RST0 + (k - 1) % 8))
                pieces += [bytes(out), (part[:, y : y + step], batch.Kind(bits, len(part), g.mode, g.near, preset))]
                out.clear()
    return pieces


def with_options(options: Options, **changes) -> Options:
    return replace(options, **changes)
