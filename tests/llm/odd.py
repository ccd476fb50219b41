"""Small inputs with everything that tables may hold, and brute-force helpers."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from sitefacts.llm import quality_rules

EXTRA = ["row", "tag", "doc", "pos", "key", "keep", "kept", "n", "label", "node", "text_a", "n_words", "ids", "h1", "places", "its_tag"]


def sentences(rng: random.Random, n: int, lang: str = "") -> list[str]:
    return [" ".join(lang + "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(6, 14))).capitalize() + "." for _ in range(n)]


def odd_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(7)
    base = sentences(rng, 40)
    shared = sentences(rng, 8)
    rows = [(10, "\n".join(base[:20])), (3, "\n".join(base[:20])), (3, "\n".join(base[:20])), (11, "\n".join(base[20:30] + shared)), (12, "\n".join(shared + base[30:]))]
    near = "\n".join(base[:20]).split()
    for i in range(30, 42):
        words = list(near)
        words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((i, " ".join(words)))
    rows += [(50, None), (51, ""), (52, " \n\t \x0b\x0c\r"), (53, "one two"), (54, "ONE two"), (None, "\n".join(base[:20])), (None, None), (55, "É x " * 70), (56, "\n".join(sentences(rng, 4000))), (57, "日本語のテキスト" * 300), (58, "<|endoftext|> a <|endoftext|>b"), (-5, "  Padded LINE of text here \nother\n  padded line of TEXT here")]
    return rows


def odd_documents(spark, extra: bool = True):
    docs = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None, len(t or "")) for i, t in odd_texts()], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(1) for c in EXTRA}) if extra else docs


def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def bare_numbers(text):
    """The bare words of a text as numbers."""
    return [int.from_bytes(hashlib.md5(w).digest()[:8], "little") for w in quality_rules.bare((text or "").encode().split()) if w]
