"""Quality rules: how far a document's characters and common words diverge from its language.

Language references are histograms counted over all documents that pass the base rule: of character
classes, and of each language's most common words. A language has a reference if MIN_DOCUMENTS different
texts or more were counted for it; each such language has one. A document is compared with every reference
by Jensen-Shannon distance (base 2, 0 to 1) and takes both distances from the one whose words are nearest
(whose classes are, if it has too few words). In its own language's reference a document's own counts are
left out, so that no text speaks for itself. Texts meet LANGUAGES_AT_ONCE references or a few more at a
time; if there are more, the rows are landed and read again for each further part, with the nearest so far.
A text shorter than the minimum lengths has too few counts for a verdict and passes that part.

Documents of a language without a reference are judged like those without a lang: by the nearest of all
references. A handful of texts is no evidence of a language, so a new name in ``lang`` keeps no text.

Rules for odd input: a null or empty text has no words and fails the base rule; documents without a
lang count for no reference; repeated rows are judged alike, and are one text among the different ones;
if no reference can be made (an empty table, no lang, few texts), the base rule alone decides. Extra
columns are kept as they are.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitefacts.llm.common import columns, land, slices, utf8

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
COMMON_WORDS = 100
MIN_DOCUMENTS = 10
LANGUAGES_AT_ONCE = 4096
CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "mark", "symbol", "control", "two", "three", "four")
MIN_CLASS_CHARS, MAX_CLASS_DISTANCE = 250, 0.30
MIN_COMMON_WORDS, MAX_WORD_DISTANCE = 40, 0.53
FLUSH_WORDS = 1 << 18
PUNCTUATION = b" \t\n\r\x0b\x0c.,;:!?()[]{}\"'"


def class_of_byte() -> np.ndarray:
    """The class of each byte; letters beyond ASCII count by the length of their code, once, by their first byte."""
    kind = np.full(256, CLASSES.index("symbol"), dtype=np.int64)
    kind[:32] = kind[127] = CLASSES.index("control")
    for name, chars in (("blank", b" \t\r\x0b\x0c"), ("line", b"\n"), ("stop", b".,"), ("mark", b";:!?'\"()-"), ("digit", b"0123456789")):
        kind[list(chars)] = CLASSES.index(name)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1] = CLASSES.index("lower"), CLASSES.index("upper")
    kind[0x80:0xC0] = len(CLASSES)  # continuations are not counted
    kind[0xC0:0xE0], kind[0xE0:0xF0], kind[0xF0:] = CLASSES.index("two"), CLASSES.index("three"), CLASSES.index("four")
    return kind


CLASS_OF_BYTE = class_of_byte()


def class_counts(data: bytes) -> np.ndarray:
    """Characters per class, from the count of each byte value."""
    bytes_seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return np.bincount(CLASS_OF_BYTE, weights=bytes_seen, minlength=len(CLASSES) + 1)[: len(CLASSES)].astype(np.int64)


def bare(words: list[bytes]) -> list[bytes]:
    """Lower-cased words without punctuation at their ends."""
    return [w.strip(PUNCTUATION).lower() for w in words]


def bare_counts(counts: Counter) -> Counter:
    """Counts of bare words from counts of words as they stand: each different word is stripped once."""
    out: Counter = Counter()
    for word, n in counts.items():
        out[word.strip(PUNCTUATION).lower()] += n
    return out


def base_counts(data: bytes, words: list[bytes]) -> dict:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    joined = data.translate(None, BLANKS)
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line.translate(None, BLANKS):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": len(joined.decode("utf-8", "surrogatepass")),
        "n_symbols": len(joined) - len(joined.translate(None, SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": repeat_words(words),
    }


def repeat_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows that occur twice or more in the text; window ranks are exact, doubled from word ranks."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(number) == len(words):
        return 0
    span = 1
    while span < window:
        rank = np.unique(rank[: len(rank) - span] * (int(rank.max()) + 1) + rank[span:], return_inverse=True)[1]
        span *= 2
        if int(rank.max()) + 1 == len(rank):  # no shorter window occurs twice, so no longer one does
            return 0
    twice = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def js_distance(counts: np.ndarray, shares: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence (base 2) of counts from reference shares."""
    total = counts.sum()
    if not total:
        return 0.0
    p, q = counts / total, shares
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0.0).sum()
        return float(np.sqrt(max(0.0, (kl(p) + kl(q)) / 2)))


def base_fails(words: list[bytes], n_repeat_words: int) -> bool:
    return len(words) < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * len(words)


def counted_words(data: bytes) -> list[bytes] | None:
    """The words of a text that counts for its language's reference, or None if the base rule rejects it."""
    words = data.split()
    return None if len(words) < MIN_WORDS or base_fails(words, repeat_words(words)) else words


def reference_parts(docs: DataFrame, common_words: int = COMMON_WORDS, at_once: int = LANGUAGES_AT_ONCE, min_documents: int = MIN_DOCUMENTS) -> Iterator[dict[str, dict]]:
    """Per language the counts of its character classes, its most common words with theirs, and all its words, in parts by a hash of the language.

    All documents that pass the base rule are counted: per task first, then per (lang, word). One part at
    a time comes back to the driver; there is one part at least, be it empty.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        texts: set[tuple[str, str]] = set()

        def rows() -> pa.RecordBatch:
            found = [(lang, word.decode("utf-8", "replace"), -1, n) for lang, counts in words.items() for word, n in bare_counts(counts).items()]
            found += [(lang, None, i, int(n)) for lang, counts in classes.items() for i, n in enumerate(counts)]
            found += [(lang, text, -2, 1) for lang, text in texts]
            words.clear()
            classes.clear()
            texts.clear()
            lang, word, kind, n = zip(*found) if found else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(kind, pa.int32()), pa.array(n, pa.int64())], ["lang", "word", "kind", "n"])

        for batch in slices(batches):
            for lang, text in zip(*columns(batch, "lang", "text")):
                data = utf8(text)
                found = counted_words(data)
                if found is None:
                    continue
                classes[lang] = classes.get(lang, 0) + class_counts(data)
                texts.add((lang, xxhash.xxh3_64_hexdigest(data)))
                words.setdefault(lang, Counter()).update(found)
                if sum(map(len, words.values())) + len(texts) + len(CLASSES) * len(classes) >= FLUSH_WORDS:
                    yield rows()
        yield rows()

    known = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # long-tail words are most of the rows; they are summed where they are counted and again per key
    counted = land(known.mapInArrow(count, "lang string, word string, kind int, n long").groupBy("lang", "word", "kind").agg(F.sum("n").alias("n")), "word-counts")
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    common = counted.where("kind = -1").withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= common_words)
    common = common.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("common"))
    totals = counted.groupBy("lang").agg(F.sum(F.when(F.col("kind") == -1, F.col("n"))).alias("words"), F.count_if(F.col("kind") == -2).alias("texts"))
    kinds = counted.where("kind >= 0").groupBy("lang").agg(F.collect_list(F.struct("kind", "n")).alias("classes"))
    made = land(totals.where(F.col("texts") >= min_documents).join(kinds, "lang").join(common, "lang"), "references")
    n_parts = max(1, -(-made.count() // at_once))
    for part in range(n_parts):
        out = {}
        for row in made.where(F.pmod(F.xxhash64("lang"), F.lit(n_parts)) == part).collect():
            classes = [0] * len(CLASSES)
            for kind, n in row.classes:
                classes[kind] = n
            out[row.lang] = {"classes": classes, "words": [x.word for x in row.common], "counts": [x.n for x in row.common], "total": row.words}
        yield out


def language_references(docs: DataFrame, common_words: int = COMMON_WORDS, min_documents: int = MIN_DOCUMENTS) -> dict[str, dict]:
    """All parts as one, for small numbers of languages."""
    return {lang: found for part in reference_parts(docs, common_words, min_documents=min_documents) for lang, found in part.items()}


def divergence_terms(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Each pair's share of twice the Jensen-Shannon divergence; zeros give what the other side leaves."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log2(2 * p / (p + q)), 0.0) + np.where(q > 0, q * np.log2(2 * q / (p + q)), 0.0)


class Judge:
    """Distances of a text from the nearest language reference, with their length guards.

    Common words lead to the languages that have them, so a text touches no words but its own.
    """

    def __init__(self, references: dict[str, dict]):
        self.languages = sorted(references)
        self.number = {x: i for i, x in enumerate(self.languages)}
        self.class_counts = np.array([references[x]["classes"] for x in self.languages], dtype=np.float64).reshape(-1, len(CLASSES))
        self.classes = self.class_counts / self.class_counts.sum(axis=1, keepdims=True)
        self.totals = np.array([references[x]["total"] for x in self.languages], dtype=np.float64)
        self.common = np.array([sum(references[x]["counts"]) for x in self.languages], dtype=np.float64) / self.totals
        self.rest = np.maximum(0.0, 1 - self.common)
        self.words = [[w.encode() for w in references[x]["words"]] for x in self.languages]
        self.counts = [np.array(references[x]["counts"], dtype=np.float64) for x in self.languages]
        held: dict[bytes, list[tuple[int, float]]] = {}
        for i, words in enumerate(self.words):
            for word, n in zip(words, self.counts[i]):
                held.setdefault(word, []).append((i, n / self.totals[i]))
        self.place = {w: i for i, w in enumerate(held)}
        self.sizes = np.array([len(v) for v in held.values()], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.lang = np.array([i for v in held.values() for i, _ in v], dtype=np.int64)
        self.share = np.array([q for v in held.values() for _, q in v])

    def word_distances(self, own: Counter, n_words: int) -> np.ndarray:
        """The distance from each language over its common words and the rest; ``own`` counts the text's bare words."""
        found = [(self.place[w], n) for w, n in own.items() if w in self.place]
        slots, times = np.array(found, dtype=np.int64).reshape(-1, 2).T
        sizes = self.sizes[slots]
        at = np.repeat(self.starts[slots] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        lang, q, p = self.lang[at], self.share[at], np.repeat(times / n_words, sizes)
        of_lang = lambda x: np.bincount(lang, weights=x, minlength=len(self.languages))
        left = np.maximum(0.0, n_words - of_lang(np.repeat(times, sizes))) / n_words
        # a common word that the text lacks adds its whole share
        both = of_lang(divergence_terms(p, q)) + np.maximum(0.0, self.common - of_lang(q)) + divergence_terms(left, self.rest)
        return np.sqrt(np.maximum(0.0, both / 2))

    def distances(self, data: bytes, words: list[bytes], min_chars: int, min_words: int, counted_in: str | None = None) -> dict:
        """``counted_in`` names the language whose reference holds the text's own counts; they are left out there."""
        out = {"class_distance": None, "word_distance": None, "nearest": None}
        if not self.languages:
            return out
        kinds, home = class_counts(data), self.number.get(counted_in)
        total, by_class, by_word = kinds.sum(), None, None
        if total and total >= min_chars:
            by_class = np.sqrt(np.maximum(0.0, divergence_terms((kinds / total)[None, :], self.classes).sum(axis=1) / 2))
            if home is not None:
                others = self.class_counts[home] - kinds
                by_class[home] = js_distance(kinds, others / others.sum()) if others.sum() > 0 else 1.0
        if words and len(words) >= min_words:
            own = bare_counts(Counter(words))
            by_word = self.word_distances(own, len(words))
            if home is not None:
                mine = np.array([own[w] for w in self.words[home]], dtype=np.float64)
                others, n_others = self.counts[home] - mine, self.totals[home] - len(words)
                shares = np.append(others, max(0.0, n_others - others.sum())) / max(1.0, n_others)
                by_word[home] = js_distance(np.append(mine, max(0.0, len(words) - mine.sum())), shares) if n_others > 0 else 1.0
        if by_word is not None:
            best = int(by_word.argmin())
        elif by_class is not None:
            best = int(by_class.argmin())
        else:
            return out
        pick = lambda of: None if of is None else float(of[best])
        return {"class_distance": pick(by_class), "word_distance": pick(by_word), "nearest": self.languages[best]}


def nearer(a: dict, b: dict) -> dict:
    """Of the distances from two parts of the languages those from the nearer one."""
    rank = lambda x: (x["nearest"] is None, x["word_distance"] if x["word_distance"] is not None else x["class_distance"] or 0.0, x["nearest"] or "")
    best = min(a, b, key=rank)
    return {k: best[k] for k in ("class_distance", "word_distance", "nearest")}


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, nearest string, kept boolean"


AS_STRUCT = VERDICT.replace(", ", ",").replace(" ", ":")


def verdict_of(spark: SparkSession, references: dict[str, dict], min_class_chars: int, max_class_distance: float, min_common_words: int, max_word_distance: float):
    """A function of (text, lang, verdict so far or null) that gives the verdict with these references too."""
    packed = spark.sparkContext.broadcast(json.dumps(references))
    held: list[Judge] = []

    def judge(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        if not held:
            held.append(Judge(json.loads(packed.value)))
        for texts, langs, earlier in batches:
            out = []
            for text, lang, before in zip(texts.to_pylist(), langs.to_pylist(), earlier.to_pylist()):
                data = utf8(text)
                words = data.split()
                row = before or base_counts(data, words)
                row["base_failed"] = base_fails(words, row["n_repeat_words"])
                own = held[0].distances(data, words, min_class_chars, min_common_words, None if row["base_failed"] else lang)
                row |= nearer(before, own) if before else own
                far = (row["class_distance"] or 0) > max_class_distance or (row["word_distance"] or 0) > max_word_distance
                row["kept"] = not row["base_failed"] and not far
                out.append(row)
            yield pa.array(out, pa.struct([(k, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}[t]) for k, t in (x.split() for x in VERDICT.split(", "))]))

    return F.arrow_udf(judge, VERDICT)


def judge_quality(
    docs: DataFrame, references: dict[str, dict] | None = None, min_class_chars: int = MIN_CLASS_CHARS, max_class_distance: float = MAX_CLASS_DISTANCE, min_common_words: int = MIN_COMMON_WORDS, max_word_distance: float = MAX_WORD_DISTANCE
) -> DataFrame:
    """Each row of ``docs`` as a struct ``row``, with the base counts, both distances and ``kept``. No shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # with references from elsewhere no text is counted in one of them
    lang = F.col("row.lang").cast("string") if references is None else F.lit(None).cast("string")
    done = docs.select(row.alias("row"), F.lit(None).cast(f"struct<{AS_STRUCT}>").alias("verdict"))
    for i, part in enumerate(reference_parts(docs) if references is None else [references]):
        verdict = verdict_of(docs.sparkSession, part, min_class_chars, max_class_distance, min_common_words, max_word_distance)
        done = (land(done, "judged") if i else done).select("row", verdict(F.col("row.text").cast("string"), lang, "verdict").alias("verdict"))
    return done.select("row", "verdict.*")
