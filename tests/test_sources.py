"""Files in and out, feeds, prices and the score table."""

import csv
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tickertide.schemas import FEED_ENTRIES, PROCESSED, RAW, RAW_COLUMNS
from tickertide.sources import feeds, headlines, prices, writers

HEADER = ",".join(RAW_COLUMNS)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_quotes_blanks_and_missing_files(spark, tmp_path):
    body = (
        f"{HEADER}\n"
        's,f,"Says ""Computer,"" an agent",p,NA,u1\n'
        's,f,"two\nlines",,,u2\n'
    )
    paths = [write(tmp_path / "a.csv", body), write(tmp_path / "empty.csv", ""), str(tmp_path / "none.csv")]
    rows = headlines.read_headlines_csv(spark, paths).orderBy("url").collect()
    assert rows[0].headline == 'Says "Computer," an agent' and rows[0].reporter == "NA"
    assert rows[1].headline == "two\nlines" and rows[1].posted_at == "" and len(rows) == 2


def test_csv_columns_follow_the_header(spark, tmp_path):
    full = write(tmp_path / "a.csv", f"{HEADER}\ns,f,h1,p,r,u1\n")
    short = write(tmp_path / "b.csv", "url,headline\nu2,h2\n")
    rows = headlines.read_headlines_csv(spark, [full, short]).orderBy("url").collect()
    assert [tuple(r) for r in rows] == [("s", "f", "h1", "p", "r", "u1"), ("", "", "h2", "", "", "u2")]
    filed = headlines.read_headlines_csv(spark, [full, short], with_file=True)
    assert filed.where("headline = 'h2' and reporter = ''").count() == 1


def test_csv_headers_differ_within_a_folder_and_a_glob(spark, tmp_path):
    folder = tmp_path / "my raw"
    folder.mkdir()
    write(folder / "headlines_20260101.csv", "source,fetched_at,headline,posted_at,reporter,url\ns,f,six,p,r,u\n")
    write(folder / "headlines_20260102.csv", 'headline,url\n"two\nlines",v\n')
    write(folder / "headlines_20260103.csv", "")
    want = [("", "", "two\nlines", "", "", "v"), ("s", "f", "six", "p", "r", "u")]
    singles = [str(p) for p in sorted(folder.iterdir())]
    for paths in (str(folder), f"{folder}/*.csv", singles):
        assert sorted(tuple(r) for r in headlines.read_headlines_csv(spark, paths).collect()) == want
    ordered = headlines.read_headlines_csv(spark, str(folder), with_file=True, recursive=True)
    assert sorted(r.headline for r in ordered.collect()) == ["six", "two\nlines"]


def test_jsonl_skips_bad_lines(spark, tmp_path):
    lines = ['{"headline": "a", "url": "u"}', "", "{broken", '{"headline": "b", "source": null}']
    path = write(tmp_path / "a.jsonl", "\n".join(lines))
    df = headlines.read_headlines_jsonl(spark, path)
    assert df.count() == 2
    assert {(r.headline, r.url, r.source) for r in df.collect()} == {("a", "u", ""), ("b", "", "")}


def test_union_rejects_other_formats(spark, tmp_path):
    csv = write(tmp_path / "a.csv", f"{HEADER}\ns,f,h1,p,r,u1\n")
    jsonl = write(tmp_path / "a.jsonl", '{"headline": "h2"}')
    assert headlines.union_headline_files(spark, [jsonl, csv]).count() == 2
    with pytest.raises(ValueError):
        headlines.union_headline_files(spark, [csv, str(tmp_path / "a.txt")])
    assert headlines.union_headline_files(spark, []).columns == RAW_COLUMNS


def test_write_jsonl_keeps_nulls(spark, tmp_path):
    writers.write_jsonl(spark.createDataFrame([("a", None)], "x string, y string"), str(tmp_path / "o"))
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("*.json"))
    assert json.loads(text) == {"x": "a", "y": None}


def test_jsonl_to_csv_orders_columns(spark, tmp_path):
    src = write(tmp_path / "a.jsonl", '{"zeta": 1, "url": "u", "alpha": true, "headline": "h"}\nbad\n')
    writers.jsonl_to_csv(spark, src, str(tmp_path / "o"))
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("*.csv"))
    assert text.splitlines() == [f"{HEADER},alpha,zeta", ",,h,,,u,true,1"]


def raw(spark, rows):
    return spark.createDataFrame([(*r[:6], r[6]) for r in rows], "source string, fetched_at string, headline string, "
                                 "posted_at string, reporter string, url string, ord int")


def test_daily_merge_keeps_old_rows_and_sorts(spark):
    old = raw(spark, [("old", "f", "b", "2", "r", "u", 0)])
    new = raw(spark, [("n1", "f", "b", "1", "r", "u", 0), ("n3", "f", "a", "2", "r", "u", 2), ("n2", "f", "a", "2", "r", "u", 1)])
    rows = writers.daily_merge(old, new, "ord").collect()
    assert [(r.source, r.posted_at, r.headline) for r in rows] == [("n2", "2", "a"), ("old", "2", "b")]


def test_merge_into_day_touches_one_day(spark, tmp_path):
    path = str(tmp_path / "t")
    first = raw(spark, [("a", "f", "h", "1", "r", "u", 0)])
    writers.merge_into_day(spark, path, first, "20260101", "ord")
    writers.merge_into_day(spark, path, first, "20260102", "ord")
    more = raw(spark, [("b", "f", "h", "1", "r", "u", 0), ("b", "f", "h2", "1", "r", "u", 1)])
    writers.merge_into_day(spark, path, more, "20260102", "ord")
    writers.merge_into_day(spark, path, more.limit(0), "20260101", "ord")
    rows = spark.read.parquet(path).select("day", "source", "headline").collect()
    assert sorted((str(r.day), r.source, r.headline) for r in rows) == [
        ("20260101", "a", "h"), ("20260102", "a", "h"), ("20260102", "b", "h2"),
    ]


def test_compact_daily_passes_finished_days_through(spark, tmp_path):
    src = tmp_path / "raw"
    src.mkdir()
    twice = "s,f,h,p,r,u\ns2,f,h,p,r,u\n"
    write(src / "headlines_20260101.csv", f"{HEADER}\n{twice}")
    write(src / "headlines_20260102.csv", f"{HEADER}\nday,f,h,p2,r,u\nday,f,g,p2,r,u\n")
    write(src / "headlines_20260102_15.csv", f"{HEADER}\nrun,f,h,p0,r,u\nrun,f,z,p1,r,u\n")
    write(src / "headlines_odd.csv", f"{HEADER}\n{twice}")
    writers.compact_daily(spark, str(src), str(tmp_path / "out"))
    out = headlines.read_headlines_csv(spark, str(tmp_path / "out" / "day=20260101"))
    assert out.count() == 2
    out = headlines.read_headlines_csv(spark, str(tmp_path / "out" / "day=20260102"), with_file=True)
    rows = [(r.source, r.headline) for r in out.orderBy("file_path", "file_row").collect()]
    assert rows == [("run", "z"), ("day", "g"), ("day", "h")]
    assert sorted(p.name for p in (tmp_path / "out").glob("day=*")) == ["day=20260101", "day=20260102"]


def test_insert_or_ignore_twice_is_once(spark, tmp_path):
    values = ("p", "f", None, None, "s", "r", "T", True, None, 0.5, None, None, None)
    other = ("p", "f", "h", "u", "s", "r", "T", False, True, 0.1, None, None, None)
    schema = "ord int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PROCESSED.fields)
    batch = spark.createDataFrame([(1, *values), (0, *other), (2, *other[:4], "late", *other[5:])], schema)
    table = str(tmp_path / "scores")
    assert writers.insert_or_ignore(spark, table, batch) == 2
    assert writers.insert_or_ignore(spark, table, batch) == 0
    rows = writers.read_scores_ordered(spark, table).orderBy("headline").collect()
    assert [(r.headline, r.url, r.source, r.is_ai_related, r.is_proxy_partnership) for r in rows] == [
        ("", "", "s", 1, None), ("h", "u", "s", 0, 1),
    ]


def test_prices_long(spark):
    wide = spark.createDataFrame(
        [("2026-01-02", 1.0, 10, 2.0)], "Date string, `A|Close` double, `A|Volume` int, `B.X|Close` double"
    )
    rows = prices.prices_long(wide).orderBy("ticker").collect()
    assert [(r.ticker, str(r.trade_date), r.close, r.volume, r.open) for r in rows] == [
        ("A", "2026-01-02", 1.0, 10, None), ("B.X", "2026-01-02", 2.0, None, None),
    ]


def test_price_range_excludes_upper_bound(spark):
    events = spark.sql("select date'2026-01-10' as date")
    days = spark.sql("select explode(sequence(date'2026-01-01', date'2026-01-31')) as trade_date")
    got = prices.price_range(events, days).agg(F.min("trade_date"), F.max("trade_date")).first()
    assert (str(got[0]), str(got[1])) == ("2026-01-05", "2026-01-14")


def entry(system, position, title="t", link="l", summary="", published="", updated="", created="", name=""):
    return (system, position, title, link, summary, published, updated, created, name)


def test_normalize_feed_limits_and_defaults(spark):
    entries = spark.createDataFrame(
        [
            entry("techcrunch", 0, title=" "),
            entry("techcrunch", 1, title=" one ", summary="<b>x</b>", updated="2026-01-01", name="other"),
            entry("techcrunch", 2),
            entry("newsapi", 0, link=""),
            entry("newsapi", 1, published="2026-01-01 09:00:00", name=" Site "),
            entry("newsapi", 2, name=" "),
            entry("newsapi", 3),
            entry("google_news", 0, name="Outlet"),
            entry("google_news", 1, link=None),
        ],
        FEED_ENTRIES,
    )

    def rows(system, limit):
        df = feeds.normalize_feed(entries, system, limit, "NOW").orderBy("position")
        return [(r.position, r.headline, r.timestamp, r.source, r.snippet, r.pipeline_source) for r in df.collect()]

    assert rows("techcrunch", 2) == [(1, "one", "2026-01-01T00:00:00Z", "TechCrunch", "x", "TechCrunch")]
    assert rows("newsapi", 2) == [
        (1, "t", "2026-01-01T12:00:00Z", "Site", "", "NewsAPI Tech"),
        (2, "t", "NOW", "newsapi_tech", "", "NewsAPI Tech"),
    ]
    assert rows("google_news", 5) == [(0, "t", "NOW", "Outlet", "", "Google News RSS")]
    got = feeds.articles_to_raw(feeds.normalize_feed(entries, "google_news", 5, "NOW"), "F").first()
    assert got.asDict() == {
        "source": "Google News RSS", "fetched_at": "F", "headline": "t", "posted_at": "NOW", "reporter": "Outlet", "url": "l",
    }
    assert RAW.names == RAW_COLUMNS


def test_jsonl_files_keep_their_own_columns_and_order(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    first = [{"url": f"u{i}", "headline": 'a "q"\nb', "zeta": i, "file": "x"} for i in range(50)]
    second = [{"source": "s", "url": None}, {"beta": "b", "source": "t"}]
    (src / "one.jsonl").write_text("".join(json.dumps(r) + "\n" for r in first) + "\n[1]\nbad\n")
    (src / "two.jsonl").write_text("".join(json.dumps(r) + "\n" for r in second))
    (src / "none.jsonl").write_text("\n")
    writers.jsonl_files_to_csv(spark, str(src), str(out))

    def read(name):
        rows = []
        for part in sorted((out / f"source_file={name}.csv").glob("part-*")):
            with open(part, newline="") as handle:
                head, *more = csv.reader(handle)
            rows += more
        return head, rows

    assert sorted(p.name for p in out.glob("source_file=*")) == ["source_file=one.csv", "source_file=two.csv"]
    assert read("one") == (["headline", "url", "file", "zeta"], [['a "q"\nb', f"u{i}", "x", str(i)] for i in range(50)])
    assert read("two") == (["source", "url", "beta"], [["s", "", ""], ["t", "", "b"]])


def test_jsonl_files_of_one_name_are_refused(spark, tmp_path):
    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.jsonl").write_text('{"url": "u"}\n')
    with pytest.raises(ValueError, match="called x"):
        writers.jsonl_files_to_csv(spark, [str(tmp_path / "a"), str(tmp_path / "b")], str(tmp_path / "out"))


def test_csv_heads_are_read_alone(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in [1] a b"
    folder.mkdir()
    # Quoted line breaks in the header, also across the first read; blank lines and a mark before it.
    long_name = "x" * 20_000
    (folder / "a.csv").write_text('﻿\n\nheadline,"note\nmore",url\none,n,u1\n')
    (folder / "b.csv").write_text(f'headline,"{long_name}\nend",url\ntwo,n,u2\n')
    (folder / "c.csv").write_text("headline,url")
    (folder / "d.csv").write_text("\n \n")
    with gzip.open(folder / "e.csv.gz", "wt") as f:
        f.write("url,headline\nu3,three\n")
    path = str(folder).replace("[", "\\[").replace("]", "\\]")
    groups = headlines._files_by_header(spark, [path], False)
    assert set(groups) == {("headline", "note\nmore", "url"), ("headline", f"{long_name}\nend", "url"), ("headline", "url"), ("url", "headline")}
    got = headlines.read_headlines_csv(spark, path).orderBy("url").collect()
    assert [(r.headline, r.url) for r in got] == [("one", "u1"), ("two", "u2"), ("three", "u3")]
    # No job of Spark's own looks for headers.
    monkeypatch.setattr(headlines, "HEAD_BYTES", 16)
    spark.sparkContext.setJobGroup("heads", "")
    assert headlines._files_by_header(spark, [path], False) == groups
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("heads")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
