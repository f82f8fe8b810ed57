"""Media columns over DataFrames: texts stored as GIF files, GIF files as timed frames with colour histograms."""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import gif

BATCH_BYTES = 1 << 20


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with up to BATCH_BYTES in a column, one row at least."""
    at, held = 0, 0
    for i, x in enumerate(batch.column(column)):
        held += x.as_buffer().size if x.is_valid else 0
        if held > BATCH_BYTES and i > at:
            yield batch.slice(at, i - at)
            at, held = i, x.as_buffer().size if x.is_valid else 0
    if batch.num_rows > at:
        yield batch.slice(at)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch, 1):
            raws = [(t or "").encode() for t in part.column(1).to_pylist()]
            stored = gif.encode([gif.pad(r) for r in raws])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array(stored, pa.binary())], ["doc_id", "n_bytes", "media"])


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, as a GIF file.

    Null and empty texts give one frame of 255. Repeated rows and ids stay; other columns are dropped.
    """
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _shown(parsed: gif.Gif) -> Iterator[tuple[list, np.ndarray]]:
    """([(start, frame)], canvases) of a file's frames, some at a time."""
    held, canvases = [], []
    for start, frame, rgb in gif.compose(parsed):
        held.append((start, frame))
        canvases.append(rgb)
        if len(held) * rgb.nbytes > BATCH_BYTES:
            yield held, np.stack(canvases)
            held, canvases = [], []
    if held:
        yield held, np.stack(canvases)


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    names = ["id", "frame", "start_ms", "delay_ms", "width", "height", "rgb", "histogram"]
    for batch in batches:
        for part in _slices(batch, 1):
            for key, parsed in zip(part.column(0).to_pylist(), gif.read([x or b"" for x in part.column(1).to_pylist()]), strict=True):
                at = 0
                for held, rgb in _shown(parsed) if parsed else ():
                    counts = gif.histograms(rgb).tolist()
                    rows = [(key, at + i, t * 10, f.delay * 10, parsed.width, parsed.height, rgb[i].tobytes(), counts[i]) for i, (t, f) in enumerate(held)]
                    at += len(held)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def gif_frames(media: DataFrame, key: str = "doc_id", data: str = "media") -> DataFrame:
    """One row per frame: id, frame, start_ms, delay_ms, width, height, rgb, histogram (64 colour boxes).

    Null data, data that is no GIF and files beyond gif.MOST_PIXELS give no rows; a file cut short gives the frames before the cut,
    and indices that a broken code stream doesn't give are 0. Repeated rows give their frames again.
    """
    return media.select(F.col(key).cast("long"), data).mapInArrow(_frames, "id long, frame int, start_ms long, delay_ms long, width int, height int, rgb binary, histogram array<long>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        for part in _slices(batch, 2):
            files, rows = part.column(2).to_pylist(), []
            for data, parsed in zip(files, gif.read(files), strict=True):
                samples, colours, end = [], np.zeros(64, np.int64), 0
                for held, rgb in _shown(parsed):
                    samples += [f.pixels.tobytes() for _, f in held]
                    colours += gif.histograms(rgb).sum(0)
                    end = held[-1][0] + held[-1][1].delay
                back = b"".join(samples)
                said = f"frames={len(parsed.frames)};size={parsed.width}x{parsed.height};ms={end * 10};colours={','.join(map(str, colours.tolist()))}"
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), said))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_digests(media: DataFrame) -> DataFrame:
    """What the files of text_media() hold when they are decoded frame by frame: sizes, digests, and a feature line (frames, size, time, the frames' colour histograms summed)."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
