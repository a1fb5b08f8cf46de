"""Image stacks in TIFF files as rows of pixels, and masks back into TIFF files.

Reads classic TIFF of either byte order with grey planes in strips, stored as they are or deflated; the order of planes and the
pixel sizes come from an OME description where there is one, otherwise all planes are slices of one channel. The unit of
work is one file, as its planes share one directory.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

LINES = "path string, channel int, z int, y int, v array<float>"

# Fixed values of the TIFF format: bytes of each field type, and numbers of the tags that are read.
_FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _DESCRIPTION, _STRIPS, _ROWS, _COUNTS, _FORMAT = 256, 257, 258, 259, 270, 273, 278, 279, 339


def planes(data: bytes) -> tuple[list[np.ndarray], str]:
    """All planes of a file in their order, and the first one's description."""
    made, text = directory(data)
    return [one() for one in made], text


def directory(data: bytes) -> tuple[list[Callable[[], np.ndarray]], str]:
    """What decodes each plane of a file when it is called, and the first one's description."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no classic TIFF file")
    at, out, text = struct.unpack_from(order + "I", data, 4)[0], [], ""
    while at:
        tags = {}
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = _FIELD_BYTES.get(kind, 0) * n
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            tags[tag] = data[place : place + n] if kind == 2 else struct.unpack_from(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I'}.get(kind, 'B')}", data, place) if kind in (1, 3, 4) else ()
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * struct.unpack_from(order + "H", data, at)[0])[0]
        text = text or bytes(tags.get(_DESCRIPTION, b"")).rstrip(b"\0").decode("utf-8", "replace")
        packed, bits, form = tags.get(_COMPRESSION, (1,))[0], tags.get(_BITS, (1,))[0], tags.get(_FORMAT, (1,))[0]
        if packed not in (1, 8, 32946) or bits % 8:
            raise ValueError(f"TIFF compression {packed} with {bits} bits isn't supported")
        kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8))

        def decoded(tags=tags, packed=packed, kind=kind) -> np.ndarray:
            raw = b"".join(data[o : o + c] if packed == 1 else zlib.decompress(data[o : o + c]) for o, c in zip(tags[_STRIPS], tags[_COUNTS], strict=True))
            return np.frombuffer(raw, kind).reshape(tags[_HEIGHT][0], tags[_WIDTH][0])

        out.append(decoded)
    return out, text


def layout(text: str, n: int) -> tuple[str, dict[str, int]]:
    """Order and number of the axes C, Z and T, the fastest first."""
    found = {k: int(v) for k, v in re.findall(r'\bSize([CZT])="(\d+)"', text)}
    order = re.search(r'DimensionOrder="XY([CZT]{3})"', text)
    if not order or np.prod([found.get(k, 1) for k in "CZT"]) != n:
        return "ZCT", {"Z": n, "C": 1, "T": 1}
    return order[1], {k: found.get(k, 1) for k in "CZT"}


def pixel_sizes(text: str) -> tuple[float | None, float | None]:
    """Sizes in x and z out of a description, None where there is none."""
    def one(name: str) -> float | None:
        hit = re.search(rf'PhysicalSize{name}="([^"]*)"', text)
        try:
            return float(hit[1]) if hit else None
        except ValueError:
            return None

    return one("X"), one("Z")


def read_lines(spark: SparkSession, paths: list[str] | str, channels: list[int] | None = None) -> DataFrame:
    """``path, channel, z, y, v``: every pixel row of the files' first time point; with ``channels`` only those are decoded."""
    wanted = None if channels is None else set(channels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                stack, text = directory(bytes(data))
                order, size = layout(text, len(stack))
                for k, decoded in enumerate(stack):
                    at, rest = {}, k
                    for axis in order:
                        at[axis], rest = rest % size[axis], rest // size[axis]
                    if at["T"] == 0 and (wanted is None or at["C"] in wanted):
                        plane = decoded()
                        h = len(plane)
                        yield pd.DataFrame({"path": path, "channel": np.int32(at["C"]), "z": np.int32(at["Z"]), "y": np.arange(h, dtype="int32"), "v": list(plane.astype("float32"))})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, LINES)


def written_bytes(stack: np.ndarray, description: str = "") -> bytes:
    """A classic TIFF file of grey planes [n, y, x], stored as they are."""
    text = description.encode() + b"\0"
    kind = {"u": 1, "i": 2, "f": 3}[stack.dtype.kind]
    body, n = bytearray(b"II" + struct.pack("<HI", 42, 8)), len(stack)
    start, each = 8 + n * (2 + 9 * 12 + 4), stack[0].nbytes
    for i, plane in enumerate(stack):
        fields = [
            (_WIDTH, 4, 1, plane.shape[1]), (_HEIGHT, 4, 1, plane.shape[0]), (_BITS, 3, 1, 8 * stack.itemsize), (_COMPRESSION, 3, 1, 1), (_DESCRIPTION, 2, len(text), start),
            (_STRIPS, 4, 1, start + len(text) + i * each), (_ROWS, 4, 1, plane.shape[0]), (_COUNTS, 4, 1, each), (_FORMAT, 3, 1, kind),
        ]
        body += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields) + struct.pack("<I", 8 + (i + 1) * (2 + 9 * 12 + 4) if i + 1 < n else 0)
    return bytes(body + text) + b"".join(np.ascontiguousarray(p).astype(stack.dtype.newbyteorder("<")).tobytes() for p in stack)
