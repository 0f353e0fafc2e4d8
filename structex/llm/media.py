"""Media columns of lossless WebP: write samples as images, read images back as pixel arrays.

store() appends bytes 255 to each text's UTF-8 up to a positive multiple of 576 and writes them as
the 8-bit samples of an image with rows of a multiple of 576 samples; read() decodes images of any
writer. Both are narrow: a row never leaves its task, and a batch's images are decoded side by side.

Defined cases: a null or empty text is stored as 576 bytes 255; equal texts give equal images;
an empty table gives no rows; a null image gives null samples. status is "ok", or says why a row
has no image (a text of more samples than an image holds, 16,128 x 16,384 or 264 MB) or no samples
(a broken image): such a row never ends the job. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = 576
#: Images are handled in parts of a batch with about so many bytes, so that memory stays bounded.
PART_BYTES = 10_000_000


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % ROW if data else ROW)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from structex.llm import webp

    for batch in batches:
        texts = batch.column(1)
        for a, b in parts(texts):
            media, sizes, states = [], [], []
            for text in texts.slice(a, b - a).to_pylist():
                sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
                try:
                    media.append(webp.encode(payload_of(text), ROW))
                    states.append("ok")
                except ValueError as e:
                    media.append(None)
                    states.append(f"not stored: {e}")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(states)],
                names=["doc_id", "n_bytes", "media", "status"],
            )


def decoded(images: list[bytes | None], states: list[str]) -> tuple[list, list[str]]:
    """Samples of each image, and the states; decoded side by side, one by one where one is broken."""
    from structex.llm import webp

    have = [i for i, x in enumerate(images) if x is not None]
    samples: list = [None] * len(images)
    try:
        found = list(webp.decode_green([images[i] for i in have]))
    except Exception:  # noqa: BLE001  any damage may show as any error
        found = []
        for i in have:
            try:
                found += webp.decode_green([images[i]])
            except Exception as e:  # noqa: BLE001
                found.append(None)
                states = [*states[:i], f"broken: {e}", *states[i + 1 :]]
    for i, green in zip(have, found, strict=True):
        samples[i] = green
    return samples, states


def parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, value in enumerate(column):
        n = len(value.as_buffer()) if value.is_valid else 0
        if size and size + n > PART_BYTES:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(column):
        yield begin, len(column)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and a 64-bit sketch: which of 64 equal stretches are above the mean."""
    values = samples.astype(np.int64)
    total, n = int(values.sum()), len(values)
    bounds = np.arange(64) * n // 64
    sums, sizes = np.add.reduceat(values, bounds), np.diff(np.append(bounds, n))
    above = sums * n > total * sizes
    sketch = int(np.packbits(above).tobytes().hex(), 16)
    variance = (n * int((values * values).sum()) - total * total) // (n * n)
    return f"{total // n}:{variance}:{sketch:016x}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column(2)
        for a, b in parts(media):
            samples, states = decoded(media.slice(a, b - a).to_pylist(), batch.column(3).slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).slice(a, b - a) for i in range(3)),
                    pa.array([None if x is None else x.tobytes() for x in samples], pa.binary()),
                    pa.array(states, pa.string()),
                ],
                names=["doc_id", "n_bytes", "media", "samples", "status"],
            )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column(2)
        for a, b in parts(media):
            images = media.slice(a, b - a).to_pylist()
            all_samples, states = decoded(images, batch.column(3).slice(a, b - a).to_pylist())
            rows: list[tuple] = []
            for image, samples in zip(images, all_samples, strict=True):
                if samples is None:
                    rows.append((None,) * 6)
                    continue
                payload = samples.tobytes()
                rows.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples))
                )
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    batch.column(1).slice(a, b - a),
                    *(pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)),
                    pa.array(states, pa.string()),
                ],
                names=["doc_id", "n_bytes", *names, "status"],
            )


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text), media, the image file, and status."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary, status string")


def read(media: DataFrame) -> DataFrame:
    """The rows of store() with samples, the decoded pixel array in row order."""
    return media.mapInArrow(_read, "doc_id long, n_bytes long, media binary, samples binary, status string")


def digest(media: DataFrame) -> DataFrame:
    """Checksums and features of what the images hold when read back."""
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, status string"
    )
    return media.mapInArrow(_digest, schema)
