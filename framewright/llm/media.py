"""Netpbm and BMP images in binary columns: decoding, area resizing, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import arrow_map, saved, texts_of

#: Samples in a row of a stored payload.
ROW = 64


def _header(data: bytes, count: int, at: int) -> tuple[list[int], int]:
    """`count` numbers of a Netpbm header from `at` on, and where the raster begins; # starts a comment."""
    out = []
    while len(out) < count:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a number is missing in the header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 or uint16, height x width (x 3); bitmaps as 1 for black."""
    kind = data[1:2]
    if data[:1] != b"P" or kind not in (b"1", b"2", b"3", b"4", b"5", b"6"):
        raise ValueError("not a Netpbm file")
    bitmap, channels = kind in (b"1", b"4"), 3 if kind in (b"3", b"6") else 1
    numbers, at = _header(data, 2 if bitmap else 3, 2)
    width, height, top = (*numbers, 1)[:3]
    if not bitmap and not 0 < top < 65536:
        raise ValueError("the largest sample is out of range")
    shape = (height, width, 3) if channels == 3 else (height, width)
    if kind == b"4":
        rows = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at).reshape(height, -1)
        return np.unpackbits(rows, axis=1)[:, :width]
    if kind in (b"5", b"6"):
        raster = np.frombuffer(data, ">u2" if top > 255 else np.uint8, height * width * channels, at)
        return raster.astype(np.uint16 if top > 255 else np.uint8).reshape(shape)
    body = b"\n".join(line.split(b"#")[0] for line in data[at - 1 :].split(b"\n"))
    values = [v for v in body if v in b"01"] if bitmap else body.split()
    samples = [v - 48 for v in values] if bitmap else list(map(int, values))
    return np.array(samples[: height * width * channels], np.uint16 if top > 255 else np.uint8).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits as uint8 height x width x 3, red first."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    at, head, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if bits not in (8, 24, 32) or packed not in (0, 3 if bits == 32 else 0):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    raster = np.frombuffer(data, np.uint8, rows * stride, at).reshape(rows, stride)[:, : width * bits // 8]
    raster = raster if height < 0 else raster[::-1]
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)
        return palette[raster][..., 2::-1]
    return raster.reshape(rows, width, bits // 8)[..., 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Height x width x 3 uint8, red first, as a 24-bit BMP."""
    height, width = pixels.shape[:2]
    stride = (width * 3 + 3) // 4 * 4
    raster = np.zeros((height, stride), np.uint8)
    raster[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + raster.size, 0, 0, 54, 40, width, height, 1, 24, 0, raster.size, 2835, 2835, 0, 0) + raster.tobytes()


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of red, green and blue by the weights of BT.601; grey images stay."""
    return pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])


def light(data: bytes) -> np.ndarray:
    """The file's grey values from 0 (dark) to 255, scaled by the largest sample that its header names; in bitmaps 1 is black."""
    image = grey(decode(data))
    if data[:2] in (b"P1", b"P4"):
        return 255 * (1 - image.astype(np.int16))
    top = 255 if data[:2] == b"BM" else _header(data, 3, 2)[0][2]
    return image if top == 255 else image * (255 / top)


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, fractions of samples included.

    The integral image, read at fractional places by interpolation, is the exact integral of the
    image of constant samples; each cell is then four reads of it. One axis is done after the other,
    so only the sums at the wanted rows are kept.
    """

    def sums(a: np.ndarray, cells: int) -> np.ndarray:
        whole = np.zeros((a.shape[0] + 1, *a.shape[1:]))
        np.cumsum(a, axis=0, dtype=np.float64, out=whole[1:])
        edge = np.arange(cells + 1) * (a.shape[0] / cells)
        low = np.minimum(edge.astype(np.int64), a.shape[0] - 1)
        part = (edge - low).reshape(-1, *[1] * (a.ndim - 1))
        return np.diff(whole[low] * (1 - part) + whole[low + 1] * part, axis=0)

    rows = sums(samples, height)
    cells = sums(rows.swapaxes(0, 1), width).swapaxes(0, 1)
    return cells * (height * width / (samples.shape[0] * samples.shape[1]))


def difference_hash(samples: np.ndarray, side: int = 8) -> str:
    """Hex of side x side bits: whether a cell is darker than the cell to its right."""
    cells = area_resize(samples, side, side + 1)
    return np.packbits(cells[:, 1:] > cells[:, :-1] + 1e-9).tobytes().hex()


def npy_tile(samples: np.ndarray, side: int = 16) -> bytes:
    """NPY file of the image resized to side x side, rounded to uint8."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(samples, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def tiles(df: DataFrame, id_col: str, media_col: str, side: int = 16) -> DataFrame:
    """(id, height, width, tile, hash, error) of a column of image files.

    Samples of any depth are scaled to 8 bits. A null, empty or broken file (BMP of 1, 4 or 16 bits counts as such) keeps its row, with the reason in `error` and the other columns null.
    Repeated rows stay; other columns are left out.
    """

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {id_col: batch.column(0), "height": [], "width": [], "tile": [], "hash": [], "error": []}
        for data in batch.column(1).to_pylist():
            row: tuple = (None, None, None, None, "no file")
            if data:
                try:
                    image = light(data)
                    row = (*image.shape, npy_tile(image, side), difference_hash(image), None)
                except (ValueError, IndexError, ZeroDivisionError, struct.error) as e:
                    row = (None, None, None, None, str(e) or type(e).__name__)
            for name, value in zip(("height", "width", "tile", "hash", "error"), row, strict=True):
                out[name].append(value)
        return out

    return arrow_map(df.select(id_col, media_col), run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, height int, width int, tile binary, hash string, error string")


def store(text: str) -> bytes:
    """The text's UTF-8 bytes and zeros up to a positive multiple of ROW, as the samples of a PGM file."""
    data = text.encode()
    return encode_pgm(np.frombuffer(data.ljust(max(1, -(-len(data) // ROW)) * ROW, b"\0"), np.uint8).reshape(-1, ROW))


def stored_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text stored as a PGM file. A null text is stored like an empty one."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch, text_col)
        return {id_col: batch.column(0), "n_bytes": [len(x.encode()) for x in texts], "media": [store(x) for x in texts]}

    return arrow_map(df.select(id_col, text_col), run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary")


def media_digest(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is read back from each row's stored file: sizes, digests, the feature and the tile.

    Files are written to the shared folder (`stored_media`) and everything else comes from what is read
    there. The feature is the 64-bit difference hash of the decoded samples; tile is their NPY file and tile_sha256 its
    digest. Equal texts give equal values; null texts count as empty; repeated rows stay; an empty table gives no rows.
    """
    media = saved(stored_media(df.select(F.col("doc_id").cast("long"), "text")), "media")

    def run(batch: pa.RecordBatch) -> dict:
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile", "tile_sha256")
        out: dict = {"doc_id": batch.column(0), "n_bytes": batch.column(1)} | {n: [] for n in names}
        for cell in batch.column(2):
            data = cell.as_py()
            image = decode(data)
            back, tile = image.tobytes(), npy_tile(image)
            row = (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image), tile, hashlib.sha256(tile).hexdigest())
            for name, value in zip(names, row, strict=True):
                out[name].append(value)
        return out

    return arrow_map(media, run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tile binary, tile_sha256 string")
