import numpy as np
import pytest

from rasterloom.operators import container as c
from rasterloom.operators import scan
from rasterloom.operators.errors import ArgumentError, Code, StreamError
from rasterloom.operators.scan import Preset

H45 = bytes.fromhex("ffd8 fff7000b 02 0004 0003 01 01 11 00 fff80011 02 05 03 ffffff ff0000 00ff00 0000ff ffda0008 01 01 05 00 00 00 db95f0 ffd9".replace(" ", ""))


def test_standard_example():
    reader, data = c.decode(H45)
    assert list(data) == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 3]
    assert reader.tables[0].data.hex() == "ffffffff000000ff000000ff" and reader.format == c.INTERCHANGE
    o = c.Options(tables=((5, 3, reader.tables[0].data),), table_ids=(5,))
    again = c.encode(data, 3, 4, 2, 1, o)
    assert bytes.fromhex("db95f0") in again and c.decode(again)[1] == data


def test_stuffing():
    w = scan.Writer()
    for v, n in ((0, 24), (255, 8), (65535, 16), (65535, 16), (3, 31)):
        w.put(v, n)
    assert w.end().hex() == "000000ff7fff7fff60000000c0"


A4, B2 = bytes(range(10, 50, 10)), bytes((10, 1, 20, 1, 30, 1, 40, 1, 50, 1, 60, 1, 70, 1, 80, 1))
SIZES = [
    ((2, 2, 8, 2), bytes(range(10, 90, 10)), {0: 53, 1: 43, 2: 43}, 0), ((2, 2, 16, 2), B2, {0: 52, 1: 44, 2: 44}, 0), ((2, 2, 16, 1), bytes((0, 10, 0, 20, 0, 30, 0, 40)), {0: 36}, 0),
    ((1, 1, 16, 3), bytes(range(10, 70, 10)), {0: 66, 1: 45}, 0), ((2, 2, 16, 3), bytes(12) + bytes((1, 10, 1, 20, 1, 30, 1, 40, 1, 50, 1, 60)), {2: 51}, 0),
    ((1, 1, 16, 3), bytes(range(10, 70, 10)), {1: 59, 2: 59}, 1), ((1, 1, 16, 3), bytes(range(10, 70, 10)), {1: 59, 2: 59}, 2), ((1, 1, 16, 3), bytes(range(10, 70, 10)), {1: 55, 2: 55}, 3),
    ((1, 1, 8, 4), A4, {0: 75, 1: 47, 2: 47}, 0), ((1, 1, 16, 4), bytes(range(10, 90, 10)), {0: 86, 1: 52}, 0),
    ((2, 2, 16, 4), bytes(16) + bytes((1, 10, 1, 20, 1, 30, 1, 40, 1, 50, 1, 60, 1, 70, 1, 80)), {2: 61}, 0),
]


@pytest.mark.parametrize("frame,data,sizes,transform", SIZES)
def test_known_sizes(frame, data, sizes, transform):
    for mode, size in sizes.items():
        out = c.encode(data, *frame, c.Options(mode=mode, transform=transform))
        assert len(out) == size and c.decode(out)[1] == data


@pytest.mark.parametrize("options,size", [({}, 99), ({"even_size": True}, 100), ({"preset": Preset(255, 3, 7, 21, 64)}, 99), ({"preset": Preset(255, 3, 7, 21, 65)}, 114), ({"preset": Preset(100)}, 114)])
def test_blank_image_sizes(options, size):
    assert len(c.encode(bytes(512 * 512), 512, 512, 8, 1, c.Options(**options))) == size


def test_wide_and_oversize():
    assert len(c.encode(bytes(2), 1, 1, 16, 1)) == 28
    assert len(c.encode(bytes(2), 1, 1, 16, 1, c.Options(presets_for_wide=True))) == 43
    out = c.encode(bytes(131072), 65536, 1, 16, 1)
    assert len(out) == 46 and c.decode(out)[1] == bytes(131072)


def picture(rng, shape, bits):
    y, x = np.mgrid[: shape[1], : shape[2]]
    base = (np.sin(x / 5) + np.cos(y / 7) + 2) / 4 * ((1 << bits) - 1)
    v = np.stack([base + rng.integers(-3, 4, shape[1:]) * (rng.random(shape[1:]) < 0.4) for _ in range(shape[0])])
    v[:, shape[1] // 2 :, : shape[2] // 2] = 1
    return np.clip(v, 0, (1 << bits) - 1).astype(np.int32)


@pytest.mark.parametrize("bits", [2, 5, 8, 12, 16])
@pytest.mark.parametrize("components,mode", [(1, 0), (3, 0), (3, 1), (3, 2), (2, 1), (2, 2), (4, 1), (4, 2)])
def test_round_trips(bits, components, mode):
    rng = np.random.default_rng(bits * 10 + components)
    planes = picture(rng, (components, 17, 23), bits)
    data = c.planes_to_bytes(planes, bits, mode != 0)
    for near in {0, 1, min(3, ((1 << bits) - 1) // 2)}:
        for interval in (0, 5):
            for transform in (0, 1, 2, 3) if components == 3 and bits in (8, 16) and not near else (0,):
                out = c.encode(data, 23, 17, bits, components, c.Options(mode=mode, near=near, transform=transform, restart_interval=interval))
                back = c.bytes_to_planes(c.decode(out)[1], 23, 17, bits, components, mode != 0)
                assert np.abs(back - planes).max() <= near


def test_noise_and_small_reset():
    rng = np.random.default_rng(4)
    for bits in (8, 16):
        data = rng.integers(0, 256, 40 * 30 * (2 if bits == 16 else 1)).astype(np.uint8).tobytes()
        for preset in (Preset(), Preset(reset=3), Preset(0, 9, 9, 9, 31)):
            assert c.decode(c.encode(data, 40, 30, bits, 1, c.Options(preset=preset)))[1] == data


def test_groups_of_components():
    data = bytes((24, 23, 22, 21)) * 3
    out = c.encode(data, 2, 2, 8, 3, [(1, c.Options(near=n)) for n in (0, 2, 10)])
    reader, back = c.decode(out)
    assert [s.near for s in reader.scans] == [0, 2, 10] and max(abs(a - b) for a, b in zip(data, back, strict=True)) <= 10
    mixed = bytes(range(64))
    for groups in ([(1, c.Options()), (3, c.Options(mode=2))], [(3, c.Options(mode=2)), (1, c.Options())]):
        assert c.decode(c.encode(mixed, 8, 2, 8, 4, groups))[1] == mixed


def test_strides_and_dirty_bits():
    out = c.encode(bytes((100, 99, 0, 0, 101, 98)), 2, 2, 8, 1, stride=4)
    assert c.decode(out)[1] == bytes((100, 99, 101, 98)) and c.decode(out, 4)[1] == bytes((100, 99, 0, 0, 101, 98))
    assert c.decode(c.encode(b"\xff" * 4, 2, 2, 4, 1))[1] == b"\x0f" * 4
    assert np.frombuffer(c.decode(c.encode(b"\xff" * 8, 2, 2, 12, 1))[1], "<u2").tolist() == [4095] * 4


def test_segments_of_tables():
    out = c.table_segments(6, 1, bytes(65531))
    assert out[65530 + 7 : 65530 + 15].hex() == "fff800060306" + "0100"
    big = bytes(range(250)) * 800
    assert c.Reader(c.tables_only(((7, 1, big),))).header().tables[0].data == big


def test_spiff_and_comments():
    o = c.Options(spiff={}, spiff_entries=((2, b"abcd"),), comments=(b"hi\0",), app_data=((3, b"x"),), version_comment=True)
    reader, data = c.decode(c.encode(bytes(12), 2, 2, 8, 3, o))
    assert reader.spiff_is_valid() and data == bytes(12)
    assert [m for _, m, _, _ in reader.segments][:6] == [c.SOI, c.APP8, c.APP8, c.APP8, c.COM, c.COM]


def fails(code, data):
    with pytest.raises(StreamError) as e:
        c.decode(data)
    assert e.value.code == code


def test_error_codes():
    sof = lambda bits=8, h=1, w=1, parts=((1, 0x11),): c.segment(c.SOF, bytes((bits, 0, h, 0, w, len(parts))) + b"".join(bytes((i, s, 0)) for i, s in parts))
    sos = lambda *ids, near=0, mode=0, point=0, table=0: c.segment(c.SOS, bytes((len(ids),)) + b"".join(bytes((i, table)) for i in ids) + bytes((near, mode, point)))
    soi, eoi = b"\xff\xd8", b"\xff\xd9"
    fails(Code.NEED_MORE_DATA, b"")
    fails(Code.MARKER_START_NOT_FOUND, b"abc")
    fails(Code.SOI_NOT_FOUND, b"\xff\xd9")
    fails(Code.UNEXPECTED_EOI, soi + eoi)
    fails(Code.DUPLICATE_SOI, soi + soi)
    fails(Code.ENCODING_NOT_SUPPORTED, soi + b"\xff\xc0")
    fails(Code.UNEXPECTED_RESTART, soi + b"\xff\xd3")
    fails(Code.UNKNOWN_MARKER, soi + b"\xff\x01")
    fails(Code.UNEXPECTED_SOS, soi + sos(1))
    fails(Code.UNEXPECTED_DNL, soi + c.segment(c.DNL, b"\0\1"))
    fails(Code.BAD_SEGMENT_SIZE, soi + b"\xff\xf7\x00\x01")
    fails(Code.BAD_SEGMENT_SIZE, soi + b"\xff\xf7\x00\x20")
    fails(Code.BAD_BITS, soi + sof(1))
    fails(Code.BAD_COMPONENT_COUNT, soi + sof(parts=()))
    fails(Code.DUPLICATE_COMPONENT, soi + sof(parts=((1, 0x11), (1, 0x11))))
    fails(Code.VALUE_NOT_SUPPORTED, soi + sof(parts=((1, 0x22),)))
    fails(Code.DUPLICATE_SOF, soi + sof() + sof())
    fails(Code.BAD_COMPONENT_COUNT, soi + sof() + sos(1, 2))
    fails(Code.BAD_NEAR, soi + sof() + sos(1, near=128))
    fails(Code.BAD_INTERLEAVE, soi + sof() + sos(1, mode=1))
    fails(Code.UNKNOWN_COMPONENT, soi + sof() + sos(9, near=1))
    fails(Code.VALUE_NOT_SUPPORTED, soi + sof() + sos(1, point=1))
    fails(Code.BAD_WIDTH, soi + sof(w=0) + sos(1))
    fails(Code.DNL_NOT_FOUND, soi + sof(h=0) + sos(1) + b"\0" + eoi)
    fails(Code.BAD_PRESET_TYPE, soi + c.segment(c.LSE, b"\x0e"))
    fails(Code.EXTENDED_PRESET_NOT_SUPPORTED, soi + c.segment(c.LSE, b"\x05"))
    fails(Code.BAD_TABLE_ID, soi + c.segment(c.LSE, b"\x02\x00\x01a"))
    fails(Code.BAD_TABLE_CONTINUATION, soi + c.segment(c.LSE, b"\x03\x01\x01a"))
    fails(Code.BAD_PRESET, soi + c.segment(c.LSE, b"\x04\x05" + bytes(10)))
    fails(Code.BAD_WIDTH, soi + sof() + c.segment(c.LSE, b"\x04\x02\0\0\0\1"))
    fails(Code.COLOUR_TRANSFORM_NOT_SUPPORTED, soi + c.segment(c.APP8, b"mrfx\x04"))
    fails(Code.BAD_COLOUR_TRANSFORM, soi + c.segment(c.APP8, b"mrfx\x06"))
    fails(Code.BAD_COLOUR_TRANSFORM, soi + c.segment(c.APP8, b"mrfx\x01") + sof() + sos(1))
    fails(Code.SPIFF_DIRECTORY_NOT_ENDED, soi + c.spiff_segments(c.usual_spiff(1, 1, 8, 1))[:34] + sof())
    fails(Code.TABLES_WITH_SPIFF, soi + c.spiff_segments(c.usual_spiff(1, 1, 8, 1)) + c.table_segments(1, 1, b"a") + eoi)
    good = c.encode(bytes(range(16)), 4, 4, 8, 1)
    fails(Code.EOI_NOT_FOUND, good[:-2] + c.segment(c.COM, b""))
    fails(Code.INVALID_DATA, good[:-2])
    fails(Code.RESTART_NOT_FOUND, c.encode(bytes(range(16)), 4, 4, 8, 1, c.Options(restart_interval=2)).replace(b"\xff\xd0", b"\xff\xd1"))
    for frame, options, code in (((0, 1, 8, 1), {}, Code.ARGUMENT_WIDTH), ((1, 1, 17, 1), {}, Code.ARGUMENT_BITS), ((1, 1, 8, 1), {"mode": 1}, Code.ARGUMENT_INTERLEAVE), ((1, 1, 2, 1), {"near": 2}, Code.ARGUMENT_NEAR), ((1, 1, 8, 1), {"preset": Preset(t1=300)}, Code.ARGUMENT_PRESET), ((9, 9, 8, 1), {}, Code.ARGUMENT_SIZE)):
        with pytest.raises(ArgumentError) as e:
            c.encode(b"\0", *frame, c.Options(**options))
        assert e.value.code == code


def test_number_of_lines_after_the_scan():
    good = c.encode(bytes(range(12)), 3, 4, 8, 1)
    at = good.index(b"\xff\xf7")
    late = good[: at + 5] + b"\0\0" + good[at + 7 : -2] + c.segment(c.DNL, b"\0\x04") + b"\xff\xd9"
    assert c.decode(late)[1] == bytes(range(12)) and c.Reader(late).all_segments().height == 4


def test_any_bytes_end_in_an_answer_or_a_code():
    rng = np.random.default_rng(1)
    good = c.encode(rng.integers(0, 256, 300).astype(np.uint8).tobytes(), 10, 10, 8, 3, c.Options(mode=2))
    for _ in range(300):
        bad = bytearray(good)
        for _ in range(rng.integers(1, 4)):
            bad[rng.integers(2, len(bad))] = rng.integers(0, 256)
        try:
            c.decode(bytes(bad))
        except StreamError:
            pass


def test_segments_between_scans_and_repeated_ones():
    data = bytes(np.random.default_rng(2).integers(0, 256, 60).astype(np.uint8))
    both = lambda x: (c.decode(x)[1], c.decode_many([x])[0][1])
    parts = c.encode(data, 5, 4, 8, 3)
    second = parts.index(b"\xff\xda", parts.index(b"\xff\xda") + 2)
    late = parts[:second] + c.table_segments(3, 2, b"abcd") + c.segment(c.COM, b"x") + parts[second:]
    assert both(late) == (data, data) and c.Reader(late).all_segments().tables[0].data == b"abcd"
    presets = c.encode(data, 5, 4, 8, 3, [(1, c.Options(preset=Preset(255, 4, 8, 22, 31 + i))) for i in range(3)])
    assert presets.count(b"\xff\xf8") == 3 and both(presets) == (data, data)
    restarts = c.encode(data, 5, 12, 8, 1, c.Options(restart_interval=2))
    at = restarts.index(b"\xff\xdd")
    twice = restarts[:at] + c.segment(c.DRI, b"\0\x09") + restarts[at:]
    assert both(twice) == (data, data)
    filled = restarts.replace(b"\xff\xd1", b"\xff\xff\xff\xd1")
    assert len(filled) > len(restarts) and both(filled) == (data, data)
    more = restarts[:-2] + b"\xff\xd5\xff\xd9"
    with pytest.raises(StreamError) as e:
        c.decode(more)
    assert c.decode_many([more])[0].code == e.value.code
