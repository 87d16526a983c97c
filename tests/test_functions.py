"""Column functions on hand-made rows."""

import math
from html.parser import HTMLParser
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tickertide.functions import dates, scores, text
from tickertide.functions.markup import visible_text
from tickertide.operators.daily import contrarian_rows, null_audit

NOW = "2026-03-01T00:00:00Z"


def apply(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


KEYWORDS = [
    ("oxygen air", "gen ai", True),
    ("xai", "ai", False),
    ("ai-driven", "AI", True),
    ("ai_x", "ai", False),
    ("éai", "ai", False),
    ("anything", "  ", False),
    ("the gpt-4 model", "gpt-4", True),
    ("the gpt-40 model", "gpt-4", False),
    ("use c++ now", "c++", False),
    ("use c++x now", "c++", True),
    ("a.b*c", "b*", True),
    ("end \\e here", "\\E", False),
]


def test_contains_keyword_text_and_column_agree(spark):
    rows = spark.createDataFrame([(t, k) for t, k, _ in KEYWORDS], "t string, k string")
    by_column = [r[0] for r in rows.select(text.contains_keyword(F.col("t"), F.col("k"))).collect()]
    by_text = [
        rows.where((F.col("t") == t) & (F.col("k") == k)).select(text.contains_keyword(F.col("t"), k)).first()[0]
        for t, k, _ in KEYWORDS
    ]
    present = [
        rows.where((F.col("t") == t) & (F.col("k") == k))
        .select(F.size(text.keywords_present(F.col("t"), [k.lower().strip()])) > 0)
        .first()[0]
        for t, k, _ in KEYWORDS
    ]
    want = [w for _, _, w in KEYWORDS]
    # A pattern like "b*" ends in punctuation, so a word character must follow it.
    assert by_column == want
    assert by_text == want
    assert present == want


def test_normalize_headline(spark):
    got = apply(spark, ["A B   C\t\nD", "  x\x1cy ", "\u0085"], text.normalize_headline)
    assert got == ["a b c d", "x y", ""]


def test_normalize_url(spark):
    assert apply(spark, [" http://a/b// ", "/"], text.normalize_url) == ["http://a/b", ""]


def test_strip_html_snippet(spark):
    values = [
        "<p>a</p>\n<p>b &amp; c</p>",
        "x<b><i>y</i></b> &#8217;&#x41;&nbsp;",
        "<script>var t='</p>';</script><!-- no --><p>text</p>",
        " plain &amp; kept ",
        "<p>1 < 2 &amp;lt;</p>",
    ]
    got = apply(spark, values, text.strip_html_snippet)
    assert got == ["a \n b & c", "x y  ’A", "text", "plain &amp; kept", "1 < 2 &lt;"]
    assert apply(spark, ["abcdef"], lambda c: text.strip_html_snippet(c, 3)) == ["abc"]


def test_build_prompt(spark):
    rows = spark.createDataFrame(
        [(" Nvidia up ", "note"), ("x", " "), ("x", None), (" ", "note")], "h string, c string"
    )
    got = [r[0] for r in rows.select(text.build_prompt(F.col("h"), F.col("c"))).collect()]
    assert 'TASK ###\nContext: note\n\nHeadline: "Nvidia up"\nScore:\n\nResponse must' in got[0]
    assert 'TASK ###\nHeadline: "x"\n' in got[1] and got[1] == got[2]
    assert got[3] is None


def test_parse_feed_date(spark):
    cases = {
        "Thu, 26 Feb 2026 17:00:00 +0500": "2026-02-26T17:00:00Z",
        "thu, 6 feb 2026 7:00:00 GMT": "2026-02-06T07:00:00Z",
        "2026-02-26T10:00:00.5Z": "2026-02-26T00:00:00Z",
        "2026-02-26T10:00:00Z": "2026-02-26T10:00:00Z",
        "2026-02-26 10:00:00": "2026-02-26T10:00:00Z",
        "2026-02-26": "2026-02-26T00:00:00Z",
        "junk": NOW,
        "": NOW,
        "26 Feb 2026 17:00:00": NOW,
    }
    assert apply(spark, list(cases), lambda c: dates.parse_feed_date(c, NOW)) == list(cases.values())


def test_normalize_ts(spark):
    cases = {
        "2026-02-26 10:00:00": "2026-02-26T12:00:00Z",
        "2026-02-26 10:00:00+02:00": "2026-02-26T10:00:00+02:00Z",
        "2026-02-26T10:00:00": "2026-02-26T10:00:00Z",
        "2026-02-26T10:00:00Z": "2026-02-26T10:00:00Z",
        " ": NOW,
    }
    assert apply(spark, list(cases), lambda c: dates.normalize_ts(c, NOW)) == list(cases.values())


def test_parse_posted_at(spark):
    values = [
        "2026-02-26T17:00:00Z", "2026-02-26T10:00:00.123Z", "2026-02-26",
        "2026-02-26T17:00:00+02:00Z", "", "bad", None,
    ]
    got = apply(spark, values, dates.parse_posted_at)
    assert got[0].isoformat() == "2026-02-26T17:00:00"
    assert got[1:] == [None] * 6


def test_file_date_key(spark):
    values = ["headlines_20260317_15", "headlines_20260317", "headlines_x", "other_20260317"]
    assert apply(spark, values, dates.file_date_key) == ["20260317", "20260317", None, None]


def test_parse_score(spark):
    cases = {"think 3 steps\nScore: -0.75.": -0.75, "no": None, ".5": 1.0, "1-2": -1.0, "5.": 1.0, " ": None}
    assert apply(spark, list(cases), scores.parse_score) == list(cases.values())


def test_prob_score(spark):
    values = [[1.0, 2.0, 0.5], [1000.0, 0.0, 0.0], None]
    got = apply(spark, values, lambda c: scores.prob_score(c, ["Positive", "negative", "x"]), "array<double>")
    weights = [math.exp(v) for v in values[0]]
    assert got[0] == pytest.approx((weights[0] - weights[1]) / sum(weights))
    assert got[1] == pytest.approx(1.0) and got[2] is None
    blank = apply(spark, [[1.0, 2.0]], lambda c: scores.prob_score(c, ["positive", "b"], F.lit(" ")), "array<double>")
    assert blank == [0.0]


def test_llm_spread_and_row_mean(spark):
    rows = spark.createDataFrame(
        [(1.0, 2.0, 4.0), (1.0, None, 3.0), (1.0, None, None), (None, None, None)], "a double, b double, c double"
    )
    cols = [F.col(c) for c in "abc"]
    got = rows.select(scores.llm_spread(*cols).alias("s"), scores.row_mean(*cols).alias("m")).collect()
    assert got[0].s == pytest.approx(1.5275252316519465)
    assert got[1].s == pytest.approx(1.4142135623730951)
    assert got[2].s is None and got[3].s is None
    assert [r.m for r in got] == [pytest.approx(7 / 3), 2.0, 1.0, None]


def test_hit_flag(spark):
    rows = spark.createDataFrame(
        [(0.2, None), (0.0, 0.1), (-0.1, -0.2), (0.1, -0.2)], "s double, r double"
    )
    s, r = F.col("s"), F.col("r")
    assert [x[0] for x in rows.select(scores.hit_flag(s, r)).collect()] == [0, 0, 1, 0]
    assert [x[0] for x in rows.select(scores.hit_flag(s, r, strict=True)).collect()] == [None, 0, 1, 0]


def test_contrarian_keeps_missing_scores(spark):
    rows = spark.createDataFrame(
        [("a", None, 0.3), ("b", 0.2, 0.3), ("c", -0.2, 0.3), ("d", 0.0, 0.0)], "h string, m double, o double"
    )
    assert [r.h for r in contrarian_rows(rows, "m", ["o"]).orderBy("h").collect()] == ["a", "c"]


def test_model_deltas_null_propagates(spark):
    rows = spark.createDataFrame([(0.1, 0.3, 0.0), (0.1, None, 0.2)], "base double, x double, y double")
    got = scores.model_deltas(rows, "base", {"dx": "x", "dy": "y"}).collect()
    assert got[0].delta_sum == pytest.approx(0.3) and got[0].delta_mean_signed == pytest.approx(0.05)
    assert got[1].delta_sum is None and got[1].delta_mean_signed is None and got[1].dy == pytest.approx(0.1)


def test_null_audit(spark):
    rows = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert {r["column"]: r.nulls for r in null_audit(rows).collect()} == {"a": 1, "b": 2}


class Nodes(HTMLParser):
    """Text nodes outside scripts, styles and comments, by Python's own parser."""

    def __init__(self):
        super().__init__()
        self.nodes, self.hidden, self.fresh = [], 0, True

    def handle_starttag(self, tag, attrs):
        self.fresh, self.hidden = True, self.hidden + (tag in ("script", "style", "template"))

    def handle_endtag(self, tag):
        self.fresh, self.hidden = True, self.hidden - (tag in ("script", "style", "template"))

    def handle_comment(self, data):
        self.fresh = True

    def handle_decl(self, decl):
        self.fresh = True

    def handle_data(self, data):
        if not self.hidden:
            self.nodes[len(self.nodes) if self.fresh else -1 :] = [data if self.fresh else self.nodes[-1] + data]
            self.fresh = False


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="given tables absent")
def test_visible_text_equals_pythons_parser_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for page in pages:
        parser = Nodes()
        parser.feed(page.html)
        parser.close()
        assert visible_text(page.html).strip() == " ".join(parser.nodes).strip(), page.page_id
    assert pages


def test_visible_text_of_malformed_markup(spark):
    cases = {
        '<a title="1 > 2">x</a>': "x",
        "<a title='>' href=it's>x</a> y": "x  y",
        "<p>a<!-- b > c --->d": "a d",
        "a<!-->b<!--->c": "a b c",
        "a<!-- never closed <p>b</p>": "a",
        "a<script>if (x < 3) '</p>'": "a",
        "a<SCRIPT>x</scripty></Script >b": "a b",
        "<style>p{}</style><title>A &amp; <b></title>c": "A & <b> c",
        "<template><p>no</p><template>no</template>no</template>yes": "yes",
        "</template>yes": "yes",
        "1 < 2 <3 a<": "1 < 2 <3 a<",
        "cut <a href='http://": "cut ",
        "<?php x ?>a<!DOCTYPE html>b</ bogus>c": "a b c",
        "&eacute;&Auml &notin; &#8217;&#x41; &#0; &nosuch; &ampamp;<br>": "éÄ ∉ ’A � &nosuch; &amp;",
        "<": "<",
        "<>": "<>",
        "": "",
    }
    for html, want in cases.items():
        assert visible_text(html) == want, html
    # Linear: nothing is searched again from every "<".
    assert visible_text("<a " * 200_000) == ""
    assert len(visible_text("< " * 200_000)) == 400_000
    assert visible_text("<b>x</b>" * 50_000).count("x") == 50_000
    got = apply(spark, [None, "", " <p> a ", "<b> </b>", "x &amp; y"], text.strip_html_snippet)
    assert got == [None, "", "a", "", "x &amp; y"]
