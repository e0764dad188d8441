"""Page images as rasters of grey values, cut into lines by the ink of their rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

from tessera.functions import batches

# Grey below which a pixel is ink, share of a row that is a line's, least height of a line, margin of a crop.
INK, ROW_SHARE, LEAST_HEIGHT, MARGIN = 200, 0.015, 15, 4
#: Bytes of images, and of texts to be set, that a worker has in hand at once: a page can take some 10,000 bytes for a byte of text.
IMAGES, SET = 16 << 20, 32 << 10
#: Lines of a page that are set at once.
BAND = 32


def read(data: bytes) -> np.ndarray:
    """The grey values of a binary portable grey map."""
    head = re.match(rb"P5\s+(?:#.*\n)*(\d+)\s+(\d+)\s+255\s", data)
    if not head:
        raise ValueError("no portable grey map of 255 values")
    width, height = map(int, head.groups())
    return np.frombuffer(data, np.uint8, width * height, head.end()).reshape(height, width)


def write(page: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (page.shape[1], page.shape[0]) + np.ascontiguousarray(page, dtype=np.uint8).tobytes()


def crops(page: np.ndarray, least: int = LEAST_HEIGHT) -> list[tuple[int, int]]:
    """(first row, row after the last) of the lines: runs of rows with ink in enough of their pixels, high enough, with a margin
    to both sides. A page without a line is one crop."""
    return runs(inked(page), page.shape[1], least)


def inked(page: np.ndarray) -> np.ndarray:
    """Pixels of ink of each row."""
    return np.add.reduce((page < INK).view(np.uint8), axis=1, dtype=np.uint32)


def runs(ink: np.ndarray, width: int, least: int = LEAST_HEIGHT) -> list[tuple[int, int]]:
    """The lines of a page by the ink of its rows."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (ink > ROW_SHARE * width).astype(np.int8), [0]])))
    found = [(max(0, int(a) - MARGIN), min(len(ink), int(b) + MARGIN)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least]
    return found or [(0, len(ink))]


def cut(images: list[bytes | None]) -> pa.Array:
    pages = [None if data is None else read(data) for data in images]
    found = [None if p is None else [(a, b, write(p[a:b])) for a, b in crops(p)] for p in pages]
    return batches.lists(found, {"top": pa.int32(), "bottom": pa.int32(), "image": pa.binary()})


def line_crops(image: Column) -> Column:
    """An array of (top, bottom, image) of a page's lines, images as grey maps again."""
    return batches.column(cut, "array<struct<top:int,bottom:int,image:binary>>", IMAGES)(image)


def greys(lines: list[str], columns: int) -> np.ndarray:
    """The greys of a page's characters, a row for each of its lines. A line with more characters than columns goes on in the next
    ones, in parts of even lengths, so that it does not end in one of a single character, too little ink for a line."""
    found = []
    for line in lines:
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
        n = max(1, -(-len(codes) // columns))
        edges = np.arange(n + 1) * len(codes) // n
        row = np.repeat(np.arange(n), np.diff(edges))
        blank = (codes == 32) | ((codes >= 9) & (codes <= 13) & (codes != 11))
        own = np.full((n, columns), 255, np.uint8)
        own[row, np.arange(len(codes)) - edges[row]] = np.where(blank, 255, 40 + codes % 100)
        found.append(own)
    return np.concatenate(found)


def bands(lines: list[str], columns: int = 60, height: int = 20, gap: int = 10) -> Iterator[np.ndarray]:
    """A page, some lines at a time, so that one of any length takes little memory."""
    found = greys(lines, columns)
    yield np.full((gap, columns * 6), 255, np.uint8)
    for k in range(0, len(found), BAND):
        own = found[k : k + BAND]
        bars = np.full((*own.shape, 6), 255, np.uint8)
        bars[:, :, :4] = own[:, :, None]
        rows = np.full((len(own), height + gap, columns * 6), 255, np.uint8)
        rows[:, :height] = bars.reshape(len(own), 1, -1)
        yield rows.reshape(-1, columns * 6)


def set_page(lines: list[str], columns: int = 60, height: int = 20, gap: int = 10) -> np.ndarray:
    """A page with a bar of ink for each character of each line but white space, for tests and sources made from texts: 6 pixels a
    character."""
    return np.concatenate(list(bands(lines, columns, height, gap)))


def set_pages(text: Column, columns: int = 60) -> Column:
    """Texts as page images, each line of the text on lines of its own."""

    return batches.on_values(lambda t: write(set_page(t.split("\n"), columns)), "binary", SET)(text)


def lines_set(text: str, columns: int = 60) -> list[tuple[int, int, int]]:
    """(first row, row after the last, pixels of ink) of the lines that a text's page is cut into."""
    ink = np.concatenate([inked(band) for band in bands(text.split("\n"), columns)])
    before = np.concatenate([[0], np.cumsum(ink, dtype=np.int64)])
    return [(a, b, int(before[b] - before[a])) for a, b in runs(ink, columns * 6)]


def set_lines(text: Column, columns: int = 60) -> Column:
    """An array of (top, bottom, ink) of the lines of a text's page, which is set and cut a band at a time and leaves no task."""
    fields = {"top": pa.int32(), "bottom": pa.int32(), "ink": pa.int64()}
    cut_ = lambda texts: batches.lists([None if t is None else lines_set(t, columns) for t in texts], fields)
    return batches.column(cut_, "array<struct<top:int,bottom:int,ink:bigint>>")(text)
