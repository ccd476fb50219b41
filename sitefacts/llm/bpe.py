"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash of the last bytes cuts texts into chunks wherever its low bits are zero, so passages that
documents share fall into equal chunks. A fixed-size sketch of the chunks' document counts tells which
chunks may be shared. A document without such a chunk is encoded where it is read. Of the others the
chunks become rows: a shared chunk is encoded once, its ids are joined to all its places, and the
document is put together again. Ids at a join of two chunks may differ from those of the whole text, so
each join is re-encoded between two places near it where the tokenizer always splits; the window widens
until its outer ids agree with those of the chunks.

Such a place is a single space or line break between two characters that are not white space, or a
full-width comma or stop after an ideograph or kana: no token reaches over its left side, and what
follows does not depend on what came before. Where chunks have too few of them, they are joined as text
and encoded as one. The work for a document is linear in its length in either case.

Rules for odd input: a null or empty text has no ids; the special token's string in a text becomes the
special id; rows without a doc_id and repeated rows are encoded like any other. An empty table gives an
empty result, and extra columns are left alone.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.llm.common import SKETCH, CellCounts, columns, in_sketch, merged_sketch, sketch_bits, slices, utf8
from sitefacts.llm.line_dedup import text_tag

ROLL, CHUNK_BITS = 16, 9
ROLL_BASE = 0x9E3779B1
DEPTH, MAX_BITS = 2, 29
#: Fixed: white space beyond ASCII in UTF-8, by its number of bytes.
SPACES = {2: rb"\xC2[\x85\xA0]", 3: rb"\xE1\x9A\x80|\xE2\x80[\x80-\x8A\xA8\xA9\xAF]|\xE2\x81\x9F|\xE3\x80\x80"}
#: Fixed: ideographs U+5000 to U+8FFF, hiragana and katakana, all of them letters; comma and stops that follow them.
CJK = rb"[\xE5-\xE8][\x80-\xBF][\x80-\xBF]|\xE3\x81[\x81-\xBF]|\xE3\x82[\x80-\x96\xA1-\xBF]|\xE3\x83[\x80-\xBA]"
CJK_STOP = rb"\xE3\x80[\x81\x82]|\xEF\xBC\x8C"
SPLIT = re.compile(rb"(?<=[!-~\x80-\xBF])(?<!%b)(?<!%b)[ \n](?=[!-~\x80-\xFF])(?!%b|%b)|(?<=%b)(?:%b)" % (SPACES[2], SPACES[3], SPACES[2], SPACES[3], CJK, CJK_STOP))
#: A place and what decides on it lie within so many bytes to either side.
AROUND = 4
#: Fixed: the pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The tokenizer of a tokenizers-library file of byte-level BPE: its vocabulary as byte ranks, its added tokens as special ones.

    Ids of such a vocabulary follow the order of merges, so they serve as ranks.
    """
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    added = {t["content"]: t["id"] for t in said["added_tokens"]}
    letter = byte_letters()
    ranks = {bytes(letter[c] for c in token): i for token, i in said.pop("model")["vocab"].items() if token not in added}
    return tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(other)}


def encode(tokenizer: tiktoken.Encoding, data: bytes) -> np.ndarray:
    return np.array(tokenizer.encode(data.decode("utf-8", "surrogatepass"), allowed_special="all"), dtype=np.int32)


def chunks(data: bytes, bits: int = CHUNK_BITS) -> list[bytes]:
    """Pieces of a text, cut after each ``ROLL`` bytes whose hash begins with ``bits`` zeros, at the next character."""
    if len(data) <= ROLL:
        return [data] if data else []
    rolled, span, power = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1), 1, ROLL_BASE
    while span < ROLL:  # runs of 1, 2, 4, ... bytes, modulo 2^32
        rolled = rolled[:-span] * np.uint32(power) + rolled[span:]
        power, span = power * power & 0xFFFFFFFF, span * 2
    edges = [0]
    for cut in (np.flatnonzero(rolled < np.uint32(1 << (32 - bits))) + ROLL).tolist():
        while cut < len(data) and data[cut] & 0xC0 == 0x80:
            cut += 1
        if cut > edges[-1]:
            edges.append(cut)
    if edges[-1] < len(data):
        edges.append(len(data))
    return [data[a:b] for a, b in zip(edges, edges[1:])]


def chunk_key(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def low_keys(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype="<u8")[::2]


class Joiner:
    """Puts a document's chunks together; ``tail`` is text whose ids may still change at its end."""

    def __init__(self, tokenizer: tiktoken.Encoding, lengths: np.ndarray):
        self.tokenizer, self.lengths = tokenizer, lengths
        self.splits = all(t.isascii() and not re.search(r"\s", t) for t in tokenizer.special_tokens_set)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.lengths[ids])

    def ids_between(self, ids: np.ndarray, ends: np.ndarray, start: int, stop: int | None = None) -> np.ndarray:
        """Ids of the bytes from start to stop, both of which must be ends of ids."""
        a = np.searchsorted(ends, start, side="right") if start else 0
        return ids[a:] if stop is None else ids[a : np.searchsorted(ends, stop, side="right")]

    def places(self, data: bytes, start: int = 0) -> list[int]:
        """Where the tokenizer always splits, from ``start`` on; nowhere, if special tokens may reach over such a place."""
        return [m.start() for m in SPLIT.finditer(data, start)] if self.splits else []

    def document(self, parts: list[tuple[bytes, np.ndarray | None]]) -> np.ndarray:
        """Ids of the whole text; each part has its bytes and, where known, its ids."""
        done, tail, ids, before = [], bytearray(), np.empty(0, dtype=np.int32), []
        for data, own in parts:
            if not data:
                continue
            after = self.places(data)
            joined = self.join(tail, ids, before, data, own, after) if tail else None
            if joined:
                settled, start, ids = joined
                done.append(settled)
                del tail[:start]
                before = [p - start for p in before if p >= start]
            else:
                ids = None if tail else own
            seam = max(0, len(tail) - AROUND)
            tail += data
            # a part may end before what makes its last characters a place, or no place
            while before and before[-1] >= seam:
                before.pop()
            before += self.places(tail, seam)
        done.append(encode(self.tokenizer, bytes(tail)) if ids is None else ids)
        return np.concatenate(done)

    def join(self, left: bytearray, left_ids, before: list[int], right: bytes, right_ids, after: list[int]):
        """(ids that stand, where they end in left, ids from there to the end of right), or None if the two have no places to re-encode between."""
        if len(before) < 2 or len(after) < 2:
            return None
        left_ids = encode(self.tokenizer, bytes(left)) if left_ids is None else left_ids
        right_ids = encode(self.tokenizer, right) if right_ids is None else right_ids
        left_ends, right_ends = self.ends(left_ids), self.ends(right_ids)
        most = min(len(before), len(after))
        width = 2
        while True:
            a, a_in, b_in, b = before[-width], before[-width + 1], after[width - 2], after[width - 1]
            window = encode(self.tokenizer, bytes(left[a:]) + right[:b])
            ends, gap = self.ends(window), len(left) - a
            same = np.array_equal(self.ids_between(window, ends, 0, a_in - a), self.ids_between(left_ids, left_ends, a, a_in))
            same &= np.array_equal(self.ids_between(window, ends, gap + b_in), self.ids_between(right_ids, right_ends, b_in, b))
            if same:
                return self.ids_between(left_ids, left_ends, 0, a), a, np.concatenate([window, self.ids_between(right_ids, right_ends, b)])
            if width == most:
                return None
            width = min(2 * width, most)


def packed_type(tokenizer: tiktoken.Encoding) -> str:
    """The least width that holds every id, for ids on their way."""
    return "<u2" if tokenizer.n_vocab <= 1 << 16 else "<u4"


def token_lengths(tokenizer: tiktoken.Encoding) -> np.ndarray:
    return np.array([len(tokenizer.decode_single_token_bytes(i)) for i in range(tokenizer.n_vocab)], dtype=np.int64)


def encode_documents(docs: DataFrame, vocabulary: str, chunk_bits: int = CHUNK_BITS, max_bits: int = MAX_BITS, decode: bool = False) -> DataFrame:
    """(doc_id, tag, ids) for each row of ``docs``; ``tag`` tells rows of one doc_id apart.

    ``decode`` adds ``text``, what the ids decode to, in the same Python worker: a second one for the
    column function ``decoded`` costs each task its own tokenizer.

    ``vocabulary`` is the path of a byte-level BPE file of the tokenizers library, at the same place on
    all machines.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), text_tag().alias("tag"), F.col("text").cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(size / (1 << chunk_bits), 8, max_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = CellCounts(bits, DEPTH, 2)
        for batch in slices(batches):
            for text in columns(batch, "text")[0]:
                if keys := list({chunk_key(c) for c in chunks(utf8(text), chunk_bits)}):
                    yield from counts.add(low_keys(keys))
        yield from counts.rows()

    sketch = merged_sketch(own.select("text").mapInArrow(count, SKETCH), bits, DEPTH, 2)

    def split(texts: list[str | None]) -> Iterator[tuple[list[bytes], list[bytes], list[bool]]]:
        """Of each text its chunks, their keys, and which of them may be shared."""
        parts = [chunks(utf8(t), chunk_bits) for t in texts]
        keys = [chunk_key(c) for of_one in parts for c in of_one]
        shared = in_sketch(sketch.value, low_keys(keys), bits, DEPTH).tolist() if keys else []
        at = 0
        for of_one in parts:
            yield of_one, keys[at : at + len(of_one)], shared[at : at + len(of_one)]
            at += len(of_one)

    kinds = "doc long, tag long, ids array<int>" + ", text string" * decode

    def encoded(tokenizer: tiktoken.Encoding, docs_: list, tags: list, found: list[np.ndarray]) -> pa.RecordBatch:
        arrays = [pa.array(docs_, pa.int64()), pa.array(tags, pa.int64()), pa.array(found, pa.list_(pa.int32()))]
        if decode:
            arrays.append(pa.array([tokenizer.decode(ids.tolist()) for ids in found], pa.string()))
        return pa.RecordBatch.from_arrays(arrays, ["doc", "tag", "ids", "text"][: len(arrays)])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(vocabulary)
        for batch in slices(batches):
            ids, tags, found = [], [], []
            texts = columns(batch, "text")[0]
            for doc, tag, text, (_, _, shared) in zip(*columns(batch, "doc", "tag"), texts, split(texts)):
                if not any(shared):
                    ids.append(doc)
                    tags.append(tag)
                    found.append(encode(tokenizer, utf8(text)))
            yield encoded(tokenizer, ids, tags, found)

    def pieces(of_shared: bool, with_text: bool):
        """Chunks of documents that have a shared one: the shared ones, or the text between them as one part."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                out = {"doc": [], "tag": [], "seq": [], "key": [], "text": []}
                texts = columns(batch, "text")[0]
                for doc, tag, (parts, keys, shared) in zip(*columns(batch, "doc", "tag"), split(texts)):
                    if not any(shared):
                        continue
                    at = 0
                    while at < len(parts):
                        end = at + 1
                        while not shared[at] and end < len(parts) and not shared[end]:
                            end += 1
                        if shared[at] == of_shared:
                            values = (doc, tag, at, keys[at] if of_shared else None, b"".join(parts[at:end]) if with_text else None)
                            for name, value in zip(out, values):
                                out[name].append(value)
                        at = end
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], list(out))

        return own.mapInArrow(rows, "doc long, tag long, seq int, key binary, text binary")

    def encode_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(vocabulary)
        for batch in slices(batches):
            keys, texts = columns(batch, "key", "text")
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([encode(tokenizer, t).astype(packed_type(tokenizer)).tobytes() for t in texts], pa.binary())], ["key", "its_ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(vocabulary)
        joiner = Joiner(tokenizer, token_lengths(tokenizer))
        for batch in slices(batches):
            ids, tags, parts = columns(batch, "doc", "tag", "parts")
            found, times = [], []
            for of_one in parts:
                each = {p["seq"]: p for p in of_one}
                times.append(len(of_one) // len(each))  # rows that repeat bring each part again
                listed = []
                for i in sorted(each):
                    if each[i]["its_ids"] is None:
                        listed.append((each[i]["text"], None))
                    else:
                        known = np.frombuffer(each[i]["its_ids"], packed_type(tokenizer)).astype(np.int32)
                        listed.append((tokenizer.decode_bytes(known.tolist()), known))
                found.append(joiner.document(listed))
            again = np.repeat(np.arange(len(found)), times)
            made = encoded(tokenizer, ids, tags, found)
            yield made if len(again) == len(found) else made.take(pa.array(again))

    once = pieces(True, True).groupBy("key").agg(F.first("text").alias("text")).mapInArrow(encode_once, "key binary, its_ids binary")
    lent = pieces(True, False).select("doc", "tag", "seq", "key").join(once, "key").select("doc", "tag", "seq", F.lit(None).cast("binary").alias("text"), "its_ids")
    kept = pieces(False, True).select("doc", "tag", "seq", "text", F.lit(None).cast("binary").alias("its_ids"))
    whole = lent.unionByName(kept).groupBy("doc", "tag").agg(F.collect_list(F.struct("seq", "text", "its_ids")).alias("parts")).mapInArrow(assemble, kinds)
    return own.mapInArrow(alone, kinds).unionByName(whole).withColumnRenamed("doc", "doc_id")


def decoded(ids, vocabulary: str):
    """A column of texts from a column of ids, special tokens included."""

    def decode(values: pa.Array) -> pa.Array:
        tokenizer = encoding(vocabulary)
        # one text at a time: as Python numbers, ids take ten times their room
        return pa.array([tokenizer.decode(v.values.to_pylist()) if v.is_valid else None for v in values], pa.string())

    return F.arrow_udf(decode, "string")(ids)
