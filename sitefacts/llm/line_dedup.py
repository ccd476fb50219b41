"""Line dedup: a line that a smaller document also holds is dropped, by per-document keep bitmaps.

Rules for odd input: a null or empty text is one empty line; lines whose key is shorter than
``min_chars`` stay; all lines of a key in its smallest document stay, repeats included. Rows without a
doc_id stay as they are. Rows of one doc_id are one holder of lines; each row gets its own bitmap.
An empty table gives an empty result, and extra columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.llm.common import KEYED, columns, land, later_occurrences, slices, utf8

MIN_CHARS = 10


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped, ASCII-lower-cased line, or None if it has too few code points."""
    key = line.strip().lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return key


def text_tag(text: str = "text"):
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, ids, tags, places = [], [], [], []
            for doc, text, tag in zip(*columns(batch, "doc_id", "text", "tag")):
                n = len(places)
                for pos, line in enumerate(utf8(text).split(b"\n")):
                    if (key := line_key(line, min_chars)) is not None:
                        digests.append(xxhash.xxh3_128_digest(key))
                        places.append(pos)
                ids.extend([doc] * (len(places) - n))
                tags.extend([tag] * (len(places) - n))
            h = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(places, pa.int32())], ["h1", "h2", "doc", "tag", "pos"])

    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_tag().alias("tag"))
    return known.mapInArrow(rows, KEYED)


def pack_keep(dropped: list[int]) -> bytes:
    """One bit per line up to the byte of the last dropped one, 1 for a line that stays; compressed."""
    keep = np.ones(max(dropped) // 8 * 8 + 8, dtype=bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def unpack_keep(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """The keep flags of all lines; lines beyond the bitmap stay."""
    keep = np.ones(n_lines, dtype=bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n_lines]
        keep[: len(bits)] = bits == 1
    return keep


def line_keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, tag, n_dropped, keep) for each row that loses lines; ``tag`` is ``text_tag``, ``keep`` a bitmap."""
    dropped = later_occurrences(land(line_rows(docs, min_chars), "lines"), "late-lines")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, tag, places = columns(batch, "doc", "tag", "places")
            places = [sorted(set(p)) for p in places]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array([len(p) for p in places], pa.int64()), pa.array([pack_keep(p) for p in places], pa.binary())], ["doc", "tag", "n_dropped", "keep"])

    return dropped.groupBy("doc", "tag").agg(F.collect_list("pos").alias("places")).mapInArrow(pack, "doc long, tag long, n_dropped long, keep binary")


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns of ``docs``, as a struct ``row``, with n_lines, n_dropped and the text that stays (``kept_text``)."""
    bitmaps = line_keep_bitmaps(docs, min_chars)
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_tag().alias("its_tag"))

    def apply(text: pa.Array, keep: pa.Array) -> pa.Array:
        out = []
        for t, bitmap in zip(text.to_pylist(), keep.to_pylist()):
            lines = (t or "").split("\n")
            flags = unpack_keep(bitmap, len(lines))
            out.append({"n_lines": len(lines), "kept_text": t or "" if flags.all() else "\n".join(x for x, k in zip(lines, flags) if k)})
        return pa.array(out, pa.struct([("n_lines", pa.int64()), ("kept_text", pa.string())]))

    apply_udf = F.arrow_udf(apply, "n_lines long, kept_text string")
    joined = tagged.join(bitmaps, (F.col("row.doc_id").cast("long") == F.col("doc")) & (F.col("its_tag") == F.col("tag")), "left")
    return joined.select("row", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), apply_udf(F.col("row.text").cast("string"), "keep").alias("done")).select("row", "n_dropped", "done.*")
