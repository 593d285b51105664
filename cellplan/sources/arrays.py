"""Images and masks in binary files: raw arrays without a header, and plain TIFF stacks, read through Spark's file source."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: TIFF sample types by (bits, format) with format 1 unsigned, 2 signed, 3 float. Fixed values.
SAMPLES = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (8, 2): "i1", (16, 2): "i2", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8"}
#: Bytes of a TIFF value by its type number. Fixed values.
WIDTH = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}

#: Gives so many bytes from an offset on: of a file's content in memory, or of an open file.
Reader = Callable[[int, int], bytes]


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, highest bit first; 256 clears the table, 257 ends."""
    out, table, width, last = bytearray(), [], 9, b""
    held = bits = 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            table = [bytes([k]) for k in range(256)] + [b"", b""]
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    """PackBits: n >= 0 copies n + 1 bytes, n < 0 repeats the next one 1 - n times, -128 does nothing."""
    out, k = bytearray(), 0
    while k < len(data):
        n, k = data[k], k + 1
        if n < 128:
            out += data[k : k + n + 1]
            k += n + 1
        elif n > 128:
            out += data[k : k + 1] * (257 - n)
            k += 1
    return bytes(out)


#: How a strip or tile is unpacked, by TIFF's compression number. Fixed values.
UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def directories(read: Reader) -> tuple[str, list[dict[int, tuple]]]:
    """The byte order of a TIFF or BigTIFF and each page's tags, without its pixels."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack(order + "H", head[2:4])[0] if order and len(head) >= 8 else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    word, size, entry, counter = ("Q", 8, 20, 8) if kind == 43 else ("I", 4, 12, 2)
    at = struct.unpack(order + word, head[8:16] if kind == 43 else head[4:8])[0]
    pages = []
    while at:
        n = struct.unpack(order + ("Q" if kind == 43 else "H"), read(at, counter))[0]
        block = read(at + counter, entry * n + size)
        tag: dict[int, tuple] = {}
        for k in range(0, entry * n, entry):
            code, form, count = struct.unpack(order + "HH" + word, block[k : k + 4 + size])
            if form not in WIDTH:
                continue
            letter, width = WIDTH[form]
            raw = block[k + 4 + size : k + entry]
            if width * count > size:
                raw = read(struct.unpack(order + word, raw)[0], width * count)
            tag[code] = (raw[:count],) if form == 2 else struct.unpack(order + letter * count, raw[: width * count])
        pages.append(tag)
        at = struct.unpack(order + word, block[entry * n :])[0]
    return order, pages


def page_pixels(read: Reader, order: str, tag: dict[int, tuple]) -> np.ndarray:
    """A page as (y, x, sample), from strips or tiles, packed or not. Samples in planes of their own are put side by side."""
    unpack = UNPACK.get(tag.get(259, (1,))[0])
    if unpack is None:
        raise ValueError(f"TIFF compression {tag[259][0]} is not supported")
    form, samples, height, width = tag.get(339, (1,))[0], tag.get(277, (1,))[0], tag[257][0], tag[256][0]
    kind = np.dtype(order + SAMPLES[tag.get(258, (1,))[0], form])
    planes = samples if tag.get(284, (1,))[0] == 2 else 1
    each = samples // planes
    tiled = 322 in tag
    tall, wide = (tag[323][0], tag[322][0]) if tiled else (min(height, tag.get(278, (height,))[0]), width)
    places, sizes = (tag[324], tag[325]) if tiled else (tag[273], tag[279])
    across, down = -(-width // wide), -(-height // tall)
    out = np.zeros((planes, height, width, each), kind.newbyteorder("="))
    for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
        plane, rest = divmod(k, across * down)
        top, left = rest // across * tall, rest % across * wide
        rows = tall if tiled else min(tall, height - top)
        data = unpack(read(place, size))[: rows * wide * each * kind.itemsize]
        block = np.frombuffer(data, kind).reshape(-1, wide, each).astype(kind.newbyteorder("="))
        if tag.get(317, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)  # differences along a row
        out[plane, top : top + len(block), left : left + wide] = block[: height - top, : width - left]
    return np.concatenate(list(out), axis=2)


def in_memory(content: bytes) -> Reader:
    return lambda at, n: content[at : at + n]


def decode_tiff(content: bytes) -> tuple[np.ndarray, list[dict[int, tuple]]]:
    """The pages of a TIFF as (page, y, x, sample) and their tags."""
    read = in_memory(content)
    order, tags = directories(read)
    return np.stack([page_pixels(read, order, t) for t in tags]), tags


def encode_tiff(stack: np.ndarray, micrometres: float | None = None) -> bytes:
    """A (page, y, x) array as an uncompressed little-endian TIFF; the pixel size goes in as a resolution per centimetre."""
    kinds = {v: k for k, v in SAMPLES.items()}
    bits, form = kinds[stack.dtype.str[1:]]
    out = bytearray(b"II" + struct.pack("<HI", 42, 0))
    link = 4
    for page in stack:
        data = page.astype(page.dtype.newbyteorder("<")).tobytes()
        entries = [(256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, bits), (259, 3, 1), (262, 3, 1), (273, 4, len(out)), (277, 3, 1), (278, 4, page.shape[0]), (279, 4, len(data)), (339, 3, form)]
        out += data
        if micrometres:
            where = len(out)
            out += struct.pack("<II", round(10_000_000 / micrometres), 1000)
            entries += [(282, 5, where), (283, 5, where), (296, 3, 3)]
        if len(out) % 2:
            out += b"\0"
        struct.pack_into("<I", out, link, len(out))
        entries.sort()
        out += struct.pack("<H", len(entries))
        for code, kind, value in entries:
            out += struct.pack("<HHI", code, kind, 1) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def _voxels(name: str, number: int, page: np.ndarray, channels: int):
    for s in range(page.shape[2]):
        y, x = np.nonzero(page[:, :, s])
        yield pd.DataFrame({"image_id": name, "channel": (number % channels) * page.shape[2] + s, "z": number // channels, "y": y, "x": x, "intensity": page[y, x, s].astype(float)})


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def read_tiff(spark: SparkSession, path: str, channels: int = 1) -> DataFrame:
    """Voxels (image_id, channel, z, y, x, intensity) of the TIFF files at a path; zeros are left out.

    image_id is the file's name without extension. With several channels pages take turns. A file is one row of Spark's
    file source, of at most 2 GB, and one page at a time is decoded from it; for larger stacks see TiffStack.
    """

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                read = in_memory(bytes(content))
                order, tags = directories(read)
                for k, tag in enumerate(tags):
                    yield from _voxels(_stem(file), k, page_pixels(read, order, tag), channels)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "image_id string, channel int, z int, y int, x int, intensity double")


class TiffStack(DataSource):
    """spark.read.format("tiffstack").option("path", "a.tif,b.tif").option("channels", 1): voxels as read_tiff() gives.

    One partition a page: only its strips or tiles are read, so a stack may be larger than any memory. Needs
    spark.dataSource.register(TiffStack), and a path that driver and executors read as a file system; use read_tiff() for
    stores that only Spark reads.
    """

    @classmethod
    def name(cls) -> str:
        return "tiffstack"

    def schema(self) -> str:
        return "image_id string, channel int, z int, y int, x int, intensity double"

    def reader(self, schema) -> DataSourceReader:
        return _TiffReader(self.options)


class _TiffReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.channels = options["path"].split(","), int(options.get("channels", "1"))

    def partitions(self):
        out = []
        for path in self.paths:
            with open(path, "rb") as file:
                order, tags = directories(_from_file(file))
            out += [InputPartition((path, order, k, tag)) for k, tag in enumerate(tags)]
        return out

    def read(self, partition):
        path, order, k, tag = partition.value
        with open(path, "rb") as file:
            page = page_pixels(_from_file(file), order, tag)
        for part in _voxels(_stem(path), k, page, self.channels):
            yield from part.astype({"y": object, "x": object, "intensity": object}).itertuples(index=False, name=None)


def _from_file(file) -> Reader:
    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return read


def tiff_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, pages, height, width, samples, unit_code, density, description): what channel counts and pixel sizes are read from."""

    def run(batches):
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                _, tags = directories(in_memory(bytes(content)))
                r, first = tags[0].get(282), tags[0]
                text = first.get(270, (b"",))[0].rstrip(b"\0").decode("utf-8", "replace")
                rows.append((file, len(tags), first[257][0], first[256][0], first.get(277, (1,))[0], first.get(296, (0,))[0], r[0] / r[1] if r and r[1] else None, text))
            yield pd.DataFrame(rows, columns=["path", "pages", "height", "width", "samples", "unit_code", "density", "description"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, pages int, height int, width int, samples int, unit_code int, density double, description string")


class RawArraySource(DataSource):
    """spark.read.format("rawarray").options(path=..., shape="nz,ny,nx", dtype="i4"): labels of a headerless array.

    One partition a slice; zeros are left out. The path must be readable by the executors' own file system; use
    read_raw() for stores that only Spark reads.
    """

    @classmethod
    def name(cls) -> str:
        return "rawarray"

    def schema(self) -> str:
        return "z int, y int, x int, label long"

    def reader(self, schema) -> DataSourceReader:
        return _RawReader(self.options)


class _RawReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.dtype = options["path"], options.get("dtype", "i4")
        self.shape = tuple(int(n) for n in options["shape"].split(","))

    def partitions(self):
        return [InputPartition(z) for z in range(self.shape[0])]

    def read(self, partition):
        z, (_, ny, nx) = partition.value, self.shape
        plane = np.memmap(self.path, dtype=self.dtype, mode="r", shape=self.shape)[z]
        for y, x in zip(*np.nonzero(plane), strict=True):
            yield z, int(y), int(x), int(plane[y, x])


def read_raw(spark: SparkSession, path: str, shape: tuple[int, int, int], dtype: str = "i4") -> DataFrame:
    """Labels (z, y, x, label) of headerless arrays, through Spark's file source; a file of another size fails."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                cube = np.frombuffer(bytes(content), dtype).reshape(shape)
                z, y, x = np.nonzero(cube)
                yield pd.DataFrame({"z": z, "y": y, "x": x, "label": cube[z, y, x].astype("int64")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "z int, y int, x int, label long")


def to_raw(labels: DataFrame, shape: tuple[int, int, int], dtype: str = "i4") -> DataFrame:
    """Rows (z, data): each slice as the bytes of a headerless array; slices in order make up the file."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros(shape[1:], dtype)
        known = pdf.dropna(subset=["label"])
        plane[known["y"].to_numpy(int), known["x"].to_numpy(int)] = known["label"].to_numpy()
        return pd.DataFrame({"z": [pdf["z"].iloc[0]], "data": [plane.tobytes()]})

    spark = labels.sparkSession
    every = spark.range(shape[0]).select(F.col("id").cast("int").alias("z"))
    return every.join(labels.select(F.col("z").cast("int").alias("z"), "y", "x", "label"), "z", "left").groupBy("z").applyInPandas(run, "z int, data binary")


def numeric_export(df: DataFrame, label: str = "label") -> DataFrame:
    """What a cytometry export holds: numeric columns as doubles without undefined numbers, and the label."""
    from ..functions.columns import finite_or_zero

    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal")]
    return df.select(F.col(label), *(finite_or_zero(F.col(c)).alias(c) for c in numeric if c != label))
