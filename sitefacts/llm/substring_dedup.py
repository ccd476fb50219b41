"""Substring dedup: words of a 50-word window that also starts in a smaller document are removed.

Pass 1 counts, in a count-min sketch, in how many documents a window may stand. A window is counted by
its anchor, the least hash of the 16-word runs inside it: equal windows have equal anchors, so a
window's count is never more than its anchor's, and neighbouring windows mostly share one, which makes
about one count per 18 words. Every partition sketches its own documents and the sketches are added up.
Pass 2 hashes (to 128 bits) only windows whose anchor is estimated to stand in two documents or more,
and settles them exactly by streaming the sorted keys, first document first. Nothing is lost: too small
a sketch only lets more windows through.

The sketch has a cell per fourth part of an anchor, by the corpus' characters, up to 2^MAX_BITS cells
in each of two rows (one bit each when merged, 64 MB a row at most); beyond that size it filters less
and less, and pass 2 goes on exactly.

Rules for odd input: a null or empty text has no words; texts of fewer than 50 words stay; windows of
one document do not repeat each other, nor do rows of one doc_id; rows without a doc_id stay as they
are. An empty table gives an empty result, and extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.llm.common import BASE, KEYED, SECOND_BASE, SKETCH, CellCounts, WordHash, columns, in_sketch, land, later_occurrences, merged_sketch, mix, ngram_hashes, signed, sketch_bits, slices, utf8, window_min, word_hashes
from sitefacts.llm.line_dedup import text_tag

WINDOW, ANCHOR = 50, 16
DEPTH, MAX_BITS = 2, 29
CHARS_PER_ANCHOR = 100


def anchors(values: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The anchor of each window."""
    return window_min(mix(ngram_hashes(values, anchor, BASE)), window - anchor + 1)


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc, tag, pos): the windows, by their first word, that also start in a smaller document."""
    anchor = min(anchor, window)
    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_tag().alias("tag"))
    chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = sketch_bits(chars / CHARS_PER_ANCHOR, 4, max_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts = WordHash(), CellCounts(bits, DEPTH, 2)
        for batch in slices(batches):
            for text in columns(batch, "text")[0]:
                words = utf8(text).split()
                if len(words) >= window:
                    yield from counts.add(np.unique(anchors(word_hashes(words, memo), window, anchor)))
        yield from counts.rows()

    sketch = merged_sketch(known.select("text").mapInArrow(count, SKETCH), bits, DEPTH, 2)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in slices(batches):
            h1, h2, ids, tags, places = [], [], [], [], []
            for doc, text, tag in zip(*columns(batch, "doc_id", "text", "tag")):
                words = utf8(text).split()
                if len(words) < window:
                    continue
                values = word_hashes(words, memo)
                at = np.flatnonzero(in_sketch(sketch.value, anchors(values, window, anchor), bits, DEPTH))
                if len(at):
                    h1.append(ngram_hashes(values, window, BASE)[at])
                    h2.append(mix(ngram_hashes(values, window, SECOND_BASE)[at]))
                    ids.append(np.full(len(at), doc, dtype=np.int64))
                    tags.append(np.full(len(at), tag, dtype=np.int64))
                    places.append(at.astype(np.int32))
            cat = lambda v, t: np.concatenate(v) if v else np.empty(0, dtype=t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(mix(cat(h1, np.uint64)))), pa.array(signed(cat(h2, np.uint64))), pa.array(cat(ids, np.int64)), pa.array(cat(tags, np.int64)), pa.array(cat(places, np.int32))],
                ["h1", "h2", "doc", "tag", "pos"],
            )

    return later_occurrences(land(known.mapInArrow(keys, KEYED), "windows"), "late-windows")


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, max_bits: int = MAX_BITS) -> DataFrame:
    """All rows of ``docs`` as a struct ``row``, with n_words, n_removed and ``kept_text`` (kept words joined by a space)."""
    places = repeated_windows(docs, window, anchor, max_bits).groupBy("doc", "tag").agg(F.collect_list("pos").alias("places"))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_tag().alias("its_tag"))

    def apply(text: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for t, of_one in zip(text.to_pylist(), places):
            words = utf8(t).split()
            kept = words
            if of_one.is_valid:
                at = of_one.values.to_numpy()
                edges = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + window, -1)
                gone = np.cumsum(edges)[:-1] > 0
                kept = [w for w, g in zip(words, gone) if not g]
            out.append({"n_words": len(words), "n_removed": len(words) - len(kept), "kept_text": b" ".join(kept).decode("utf-8", "surrogatepass")})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]))

    apply_udf = F.arrow_udf(apply, "n_words long, n_removed long, kept_text string")
    joined = tagged.join(places, (F.col("row.doc_id").cast("long") == F.col("doc")) & (F.col("its_tag") == F.col("tag")), "left")
    return joined.select("row", apply_udf(F.col("row.text").cast("string"), "places").alias("done")).select("row", "done.*")
