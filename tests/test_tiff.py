"""TIFF pages in all supported forms, against files that are put together here."""

import struct
import zlib

import numpy as np
import pytest

from cellplan.sources import arrays


def lzw(data: bytes) -> bytes:
    """TIFF's LZW with a clear code first; codes are written highest bit first and widen one entry early."""
    out = bits = 0
    n = 0

    def put(code, width):
        nonlocal out, n
        out, n = out << width | code, n + width

    table, width, last = {bytes([k]): k for k in range(256)}, 9, b""
    put(256, 9)
    following = 258
    for k in range(len(data)):
        one = data[k : k + 1]
        if last + one in table:
            last += one
            continue
        put(table[last], width)
        table[last + one] = following
        following += 1
        width = 12 if following > 2047 else 11 if following > 1023 else 10 if following > 511 else 9
        if following == 4094:
            put(256, width)
            table, width, following = {bytes([k]): k for k in range(256)}, 9, 258
        last = one
    if last:
        put(table[last], width)
        following += 1
        width = 12 if following > 2047 else 11 if following > 1023 else 10 if following > 511 else 9
    put(257, width)
    bits = -n % 8
    return (out << bits).to_bytes((n + bits) // 8, "big")


def packbits(data: bytes) -> bytes:
    out = bytearray()
    for k in range(0, len(data), 100):
        part = data[k : k + 100]
        out += bytes([257 - len(part)]) + part[:1] if len(set(part)) == 1 and len(part) > 1 else bytes([len(part) - 1]) + part
    return bytes(out)


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}


def tiff(stack: np.ndarray, order="<", big=False, compression=1, predictor=False, tile=None, rows=7, planar=False) -> bytes:
    """(page, y, x, sample) as a file."""
    word, size = ("Q", 8) if big else ("I", 4)
    out = bytearray({"<": b"II", ">": b"MM"}[order] + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4
    bits, form = {v: k for k, v in arrays.SAMPLES.items()}[stack.dtype.str[1:]]
    for page in stack:
        height, width, samples = page.shape
        parts = [page[:, :, s : s + 1] for s in range(samples)] if planar else [page]
        blocks = []
        for part in parts:
            tall, wide = tile or (rows, width)
            for top in range(0, height, tall):
                for left in range(0, width, wide):
                    block = part[top : top + tall, left : left + wide]
                    if tile:
                        block = np.pad(block, ((0, tall - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                    if predictor:
                        block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1).astype(block.dtype)
                    blocks.append(PACK[compression](block.astype(block.dtype.newbyteorder(order)).tobytes()))
        places = []
        for b in blocks:
            places.append(len(out))
            out += b
        text = b"ImageJ=1.5\nchannels=2\n\0"
        tags = {256: (4, [width]), 257: (4, [height]), 258: (3, [bits]), 259: (3, [compression]), 270: (2, text), 277: (3, [samples]), 284: (3, [2 if planar else 1]), 317: (3, [2 if predictor else 1]), 339: (3, [form])}
        tags |= {322: (4, [tile[1]]), 323: (4, [tile[0]]), 324: (16 if big else 4, places), 325: (4, [len(b) for b in blocks])} if tile else {273: (16 if big else 4, places), 278: (4, [rows]), 279: (4, [len(b) for b in blocks])}
        entries = []
        for code, (kind, values) in sorted(tags.items()):
            raw = values if kind == 2 else struct.pack(order + {3: "H", 4: "I", 16: "Q"}[kind] * len(values), *values)
            if len(raw) > size:
                where = len(out)
                out += raw
                raw = struct.pack(order + word, where)
            entries.append(struct.pack(order + "HH" + word, code, kind, len(values)) + raw.ljust(size, b"\0"))
        struct.pack_into(order + word, out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + word, 0)
    return bytes(out)


def picture(kind="u2", samples=1):
    r = np.random.default_rng(4)
    smooth = np.add.outer(np.arange(33) * 3, np.arange(50) * 2)[None, :, :, None] + r.integers(0, 4, (3, 33, 50, samples))
    return smooth.astype(kind)


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
def test_forms(compression):
    for kind in ("u1", "u2", "f4", "i4"):
        for options in ({}, {"order": ">"}, {"big": True}, {"tile": (16, 16)}, {"big": True, "order": ">", "tile": (32, 16)}, *([{"predictor": True}, {"predictor": True, "tile": (16, 32)}] if kind != "f4" else [])):
            stack = picture(kind)
            got, tags = arrays.decode_tiff(tiff(stack, compression=compression, **options))
            assert (got == stack).all() and got.dtype == stack.dtype and len(tags) == 3, (kind, options)
    for planar in (False, True):
        stack = picture("u2", 3)
        assert (arrays.decode_tiff(tiff(stack, compression=compression, planar=planar))[0] == stack).all()


def test_lzw_of_long_data():
    r = np.random.default_rng(1)
    for data in (b"", b"a", bytes(range(256)) * 90, r.integers(0, 256, 30_000, dtype=np.uint8).tobytes(), b"ab" * 20_000):
        assert arrays.unpack_lzw(lzw(data)) == data


def test_errors():
    with pytest.raises(ValueError):
        arrays.decode_tiff(b"nothing")
    broken = bytearray(tiff(picture()))
    with pytest.raises(ValueError):
        arrays.decode_tiff(bytes(broken).replace(struct.pack("<HHIHH", 259, 3, 1, 1, 0), struct.pack("<HHIHH", 259, 3, 1, 7, 0)))


def test_sources(spark, tmp_path):
    """Page by page from an open file gives what the whole file gives."""
    stack = picture("u2")
    (tmp_path / "a.tif").write_bytes(tiff(stack, compression=8, tile=(16, 16), big=True))
    whole = sorted(map(tuple, arrays.read_tiff(spark, f"{tmp_path}/a.tif", 3).collect()))
    spark.dataSource.register(arrays.TiffStack)
    paged = spark.read.format("tiffstack").option("path", f"{tmp_path}/a.tif").option("channels", 3).load()
    assert paged.rdd.getNumPartitions() == 3 and sorted(map(tuple, paged.collect())) == whole and len(whole) == np.count_nonzero(stack)
    m = arrays.tiff_metadata(spark, f"{tmp_path}/a.tif").first()
    assert (m.pages, m.height, m.width, m.description) == (3, 33, 50, "ImageJ=1.5\nchannels=2\n")
