"""Price lines of pages and their amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.functions import text as T
from sitefacts.operators.first import first_per_key


def range_pattern(currency: str = vocab.CURRENCY_PATTERN, amount: str = vocab.AMOUNT_PATTERN) -> str:
    return rf"(?iu)({amount})\s*[-–—]\s*({amount})\s*{currency}"


def single_pattern(currency: str = vocab.CURRENCY_PATTERN, amount: str = vocab.AMOUNT_PATTERN) -> str:
    prefix = rf"(?:{T.WORD_START}(от|до){T.WORD_END})?"
    return rf"(?iu){prefix}\s*({amount})\s*{currency}"


def has_price(line: Column, currency: str = vocab.CURRENCY_PATTERN) -> Column:
    # a range ends with a price of its own
    return line.rlike(single_pattern(currency))


def price_lines(pages: DataFrame, elements: DataFrame | None = None, key: str = "page_id", markdown: str | None = None, currency: str = vocab.CURRENCY_PATTERN, line_chars: tuple[int, int] = (6, 220), item_chars: tuple[int, int] = (8, 220)) -> DataFrame:
    """(page, place, line): lines that hold a price, distinct per page without regard to case.

    Markdown lines come first, then table rows of two or more cells, then list items and paragraphs.
    Only lines and items of these lengths count as price lines: shorter ones are labels, longer ones prose.
    """
    sources = []
    if markdown is not None:
        lines = pages.select(key, F.posexplode(F.split(T.text_of(markdown), r"\r\n|[\n\r\x{0B}\x{0C}\x{85}\x{2028}\x{2029}]")).alias("pos", "raw"))
        lines = lines.select(key, F.lit(0).alias("source"), "pos", T.compact(F.col("raw")).alias("line"))
        sources.append(lines.filter(F.length("line").between(*line_chars)))
    if elements is not None:
        # cells and rows meet by (page, position of the row); a page's rows are never gathered as one
        rows = elements.filter("tag = 'tr'").select(key, F.col("pos").alias("_row"))
        cells = (
            elements.filter(F.col("tag").isin("th", "td"))
            .select(key, "pos", T.compact(F.col("text")).alias("cell"), F.explode("ancestors").alias("_row"))
            .filter("cell <> ''")
            .join(rows, [key, "_row"])
            .groupBy(key, "_row")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "cell"))).alias("cells"))
            .filter(F.size("cells") >= 2)
            .select(key, F.lit(1).alias("source"), F.col("_row").alias("pos"), F.array_join(F.transform("cells", lambda c: c["cell"]), " | ").alias("line"))
        )
        items = (
            # no amount is without a digit, and that is seen before the text is made compact
            elements.filter(F.col("tag").isin("li", "p") & F.col("text").rlike("[0-9]"))
            .select(key, F.lit(2).alias("source"), "pos", T.compact(F.col("text")).alias("line"))
            .filter(F.length("line").between(*item_chars))
        )
        sources += [cells, items]
    found = sources[0]
    for other in sources[1:]:
        found = found.unionByName(other)
    return first_per_key(found.filter(has_price(F.col("line"), currency)), [key, F.lower("line")], ["source", "pos"])


def parse_prices(lines: DataFrame, line: str = "line", currency: str = vocab.CURRENCY_PATTERN, code: str = "RUB") -> DataFrame:
    """Adds service, price_raw, price_min, price_max and currency; lines without a price are dropped.

    A range sets both bounds. A single price sets both as well, except after the prefix for "up to",
    which leaves the lower bound open.
    """
    spread, single = range_pattern(currency), single_pattern(currency)
    df = lines.withColumn("_l", T.plain_markdown(T.text_of(line))).filter(F.length("_l") >= 4)
    df = df.withColumns({"_range": F.regexp_extract("_l", spread, 0), "_single": F.regexp_extract("_l", single, 0)})
    df = df.filter("_range <> '' OR _single <> ''")
    bare = F.regexp_replace(F.regexp_replace("_l", spread, ""), single, "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[\-–—:|/•*]+\s*", ""), r"\s*[\-–—:|/•*]+\s*$", "")
    is_range = F.col("_range") != ""
    value = T.to_int(F.regexp_extract("_l", single, 2))
    upto = F.lower(F.regexp_extract("_l", single, 1)) == "до"
    return df.withColumns(
        {
            "service": F.coalesce(T.empty_to_null(T.plain_markdown(bare)), F.col("_l")),
            "price_raw": F.when(is_range, F.col("_range")).otherwise(F.col("_single")),
            "price_min": F.when(is_range, T.to_int(F.regexp_extract("_l", spread, 1))).when(~upto, value),
            "price_max": F.when(is_range, T.to_int(F.regexp_extract("_l", spread, 2))).otherwise(value),
            "currency": F.lit(code),
        }
    ).drop("_l", "_range", "_single")


def extract_prices(lines: DataFrame, url: str = "url", order: tuple[str, ...] = ("page_id", "source", "pos"), **options) -> DataFrame:
    """Prices of all lines; of equal (URL, service, price text) the first is kept."""
    prices = parse_prices(lines, **options)
    return first_per_key(prices, [url, F.lower("service"), F.lower("price_raw")], list(order))
