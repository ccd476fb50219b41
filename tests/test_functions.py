"""Column functions, elements and block windows against plain Python."""

import random

from pyspark.sql import functions as F

from sitefacts.functions import blocks
from sitefacts.functions import text as T
from sitefacts.functions.html import _Elements, anchor_hrefs, html_elements, visible_text
from sitefacts.operators import urls as O


def values(spark, rows, column, name="v", kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_text_forms(spark):
    assert values(spark, ["a  b\n c", " x ", None], T.compact(T.text_of("v"))) == ["a b c", "x", ""]
    assert values(spark, ["8 (383) 255-10-11", "+7 913 555 10 20", "+1 (555) 555-0100", " 12  3 "], T.phone(F.col("v"))) == [
        "+73832551011", "+79135551020", "+1 (555) 555-0100", "12 3",
    ]
    assert values(spark, ["1 234,5", "−5", "—", "x", "-7", ""], T.to_number(F.col("v"))) == [1234.5, None, None, None, -7.0, None]
    assert values(spark, ["12 руб. 5", "none", None], T.to_int(F.col("v"))) == [125, None, None]
    assert values(spark, ["7701234567", "77-0123456 789", "123"], T.tax_id(F.col("v"))) == ["7701234567", "770123456789", ""]


def test_entities(spark):
    rows = ["<p>Build &quot;APIs&quot;</p>", "a&#1078;b&#x436;c &#39;q&#39;", "1 &lt; 2 &amp;lt; 3", "no", "&nbsp;x&#160;y"]
    assert values(spark, rows, T.plain_text(F.col("v"))) == ['Build "APIs"', "aжbжc 'q'", "1 < 2 &lt; 3", "no", "x y"]


def test_every_entity(spark):
    from html import unescape
    from html.entities import html5

    rows = [f"a&{n}b &{n}" for n in html5] + [
        "&rarr; &alpha; &frac12; &nbsp x", "&#x000027;", "&#0000039;", "&#x10FFFD;", "&#38;lt;", "&#x80; &#150; &#x81;", "&#0; &#xD800; &#x110000; &#99999999;", "&#x1; &#11; &#xFFFE; &#xfdd0;x",
        "&notit; &notin; &ampx &am &; & &# &#x; &#xg; &#12a; &amp;amp; &ltgt;", "", "&", "&&lt;&", "&unknownword; &CounterClockwiseContourIntegral; &" + "x" * 50 + ";",
    ]
    assert values(spark, rows, T.unescape(F.col("v"))) == [unescape(r) for r in rows]


def test_closed_entities(spark):
    rows = ["Fish &amp; Chips&amp", "&ampx; &copy &copy; &#39 &#39; &amp;lt; &notit;", "&&amp;&amp", "no", "&middot;&unknown;"]
    want = ["Fish & Chips&amp", "&ampx; &copy © &#39 ' &lt; &notit;", "&&&amp", "no", "·&unknown;"]
    assert values(spark, rows, T.unescape(F.col("v"), closed=True)) == want
    assert values(spark, rows, T.plain_text(F.col("v"), closed=True)) == want


def test_closed_entities_of_pages(spark):
    rows = ["<title>Fish &amp</title><p>a &lt;b &copy</p>"]
    assert values(spark, rows, visible_text(F.col("v"))) == ["Fish & a <b ©"]
    assert values(spark, rows, visible_text(F.col("v"), closed=True)) == ["Fish &amp a <b &copy"]


def test_hosts_outside_ascii(spark):
    df = spark.createDataFrame([("https://www.Клиника.рф/путь#x",), ("http://xn--80apgfc0a.xn--p1ai:8080/",)], "u string")
    rows = O.explode_domain_keys(O.with_display_url(O.with_site_origin(df, "u"), "u"), "u").collect()
    ascii_host = "клиника.рф".encode("idna").decode()
    assert {r["site"] for r in rows if "Клиника" in r["u"]} == {f"https://{ascii_host}/"}
    assert {r["domain_key"] for r in rows if "Клиника" in r["u"]} == {"клиника.рф", ascii_host}
    shown = {r["u"]: r["display_url"] for r in rows}["http://xn--80apgfc0a.xn--p1ai:8080/"]
    assert shown == "http://" + b"xn--80apgfc0a.xn--p1ai".decode("idna") + ":8080/"


def test_http_urls(spark):
    rows = ["https://WWW.A.com:443/x/#f", "http://a.com:99999/", "http://a.com:x/", "http://sub.reg.ru/", "a.com", "http://u:p@a.com:81?q=1", "ftp://a.com/"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, u string")
    got = [r["http_url"] for r in O.with_http_url(df, "u").orderBy("i").collect()]
    assert got == ["https://a.com/x", None, None, None, None, "http://a.com:81/?q=1", None]


def test_relative_links(spark):
    from urllib.parse import urljoin

    base = "https://a.com/x/y/z.html?q=1"
    hrefs = ["", "b", "./b", "../b/", "../../../b", "/r/./s", "//c.com/p", "?k=2", "#top", "mailto:a@b.c", "https://d.com", "a/../b?x=../y", "..", "."]
    df = spark.createDataFrame([(i, base, h) for i, h in enumerate(hrefs)], "i int, u string, h string")
    from sitefacts.functions import urls as U

    got = [r["r"] for r in U.split_url(df, F.col("u"), "_b").withColumn("r", U.resolve("_b", F.col("h"))).orderBy("i").collect()]
    want = [urljoin(base, h) for h in hrefs]
    assert got == want


def test_elements(spark):
    html = (
        "<html><head><title>T &amp; x</title><script>var a='<p>no</p>';</script></head><body><!-- <a href='/c'>c</a> -->"
        "<div class='Team card' id=d1><p>One<p>Two <b>bold</b></div><a href='/x?a=1&amp;b=2'>X</a><br/><input name=q></body></html>"
    )
    df = spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")
    rows = {r["pos"]: r for r in html_elements(df, strings=True).collect()}
    by_tag = {}
    for r in rows.values():
        by_tag.setdefault(r["tag"], []).append(r)
    assert by_tag["div"][0]["text"] == "One Two bold" and by_tag["div"][0]["attrs"] == {"class": "Team card", "id": "d1"}
    assert by_tag["script"][0]["text"].startswith("var a") and "var a" not in by_tag["html"][0]["text"]
    # an open paragraph holds the next one
    assert [p["text"] for p in by_tag["p"]] == ["One Two bold", "Two bold"]
    assert rows[by_tag["b"][0]["ancestors"][-1]]["tag"] == "p" and by_tag["b"][0]["strings"] == ["bold"]
    assert by_tag["div"][0]["children"] == 1 and len(by_tag["a"]) == 1
    assert df.select(anchor_hrefs(F.col("html"))).first()[0] == ["/x?a=1&b=2"]
    assert df.select(visible_text(F.col("html"))).first()[0] == "T & x One Two bold X"


def test_blocks_match_plain_scans(spark):
    rng = random.Random(3)
    rows = []
    for key in ("hot", "b", None):
        for pos in sorted(rng.sample(range(400), 150 if key == "hot" else 40)):
            rows.append((key, pos, rng.choice([None, "h1", "h2", None, None]), rng.randint(0, 3)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, p int, h string, n int")
    for width in (7, 1000):
        got = blocks.scan(df, ["k"], "p", {"s": F.col("n")}, {"l": F.col("h")}, {"f": F.col("h")}, width)
        got = blocks.neighbours(blocks.numbered(got, ["k"], "p", "r", width), ["k"], "p", "h", "a", "z", width)
        found = {(r["k"], r["p"]): (r["s"], r["l"], r["f"], r["r"], r["a"], r["z"]) for r in got.collect()}
        want = {}
        for key in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
            total, last, first = 0, None, None
            for i, (k, p, h, n) in enumerate(mine):
                total, last, first = total + n, h or last, first or h
                want[k, p] = (total, last, first, i + 1, mine[i - 1][2] if i else None, mine[i + 1][2] if i + 1 < len(mine) else None)
        assert found == want


def read(page, plain):
    parser = _Elements()
    if plain:
        if not parser.read_plain(page):
            return None
    else:
        parser.feed(page)
        parser.close()
    parser._flush()
    return parser.found, parser.strings


def test_plain_pages_are_read_as_the_full_parser_reads_them():
    page = '<!DOCTYPE html><title>A &amp; B</title><script>var t="</p>";x(1 & 2);</script><!-- ad --><p class="x"\n id="y">a&ampb<br/>c<P>d</i></P> e &lt'
    assert read(page, True) == read(page, False)
    pieces = ["<p>", "</p>", '<a href="/x" class="b c">', "</a>", "<br>", "<br/>", "<b/>", "x &amp; y", "&copy", " > ", "<", "< p", "<!-- c -->", "<!-->", "<!--a--b-->", "<!x>", "<?x>", "</", "</ p>", "</>",
        "<script>", "</script>", "</SCRIPT >", "<style>", "</style>", "<title>", "</title>", "<textarea>", "</textarea>", "<svg>", "<iframe>", "</iframe>", "<p a=1>", "<p a='<'>", '<p a="&lt;">', "<p a>", '<p a=">">', "</p x>", "</p/>", "\0", "\r\n", "<![CDATA[x]]>", "<!DOCTYPE html>"]
    rng, taken = random.Random(3), 0
    for _ in range(20_000):
        page = "".join(rng.choices(pieces, k=rng.randrange(1, 9)))
        got = read(page, True)
        taken += got is not None
        assert got is None or got == read(page, False), page
    assert taken > 2_000
