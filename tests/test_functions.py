"""Golden values of the functions."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewire.functions import hashing, text, tsv, url, vectors
from tidewire.operators import search
from tidewire.queries import ORACLES, QUERIES


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, (kind(v) for v in values.values()))))
    return row.select(column.alias("x")).first()["x"]


def kind(v):
    return {str: "STRING", int: "INT", float: "DOUBLE", list: "ARRAY<DOUBLE>", datetime: "TIMESTAMP", bytes: "BINARY", type(None): "STRING"}[type(v)]


@pytest.mark.parametrize(
    ("raw", "canonical", "error"),
    [
        (" HTTPS://Example.ORG:443/news/a/?b=2&utm_source=x&a=1#comments ", "https://example.org/news/a?a=1&b=2", None),
        ("http://example.org/%20a%2B", "http://example.org/%20a%2B", None),
        ("http://example.org/a?GCLID=1&UTM_medium=2&x=3", "http://example.org/a?x=3", None),
        ("http://u:p@example.org:8080///", "http://example.org:8080/", None),
        ("https://example.org", "https://example.org", None),
        ("http://example.org/ü", "http://example.org/%C3%BC", None),
        (" ", None, "EMPTY_URL"),
        (None, None, "EMPTY_URL"),
        ("not a url", None, "INVALID_URL"),
        ("ftp://example.org/a", None, "UNSUPPORTED_SCHEME"),
        ("http://ex_a.org/", None, "MISSING_HOST"),
    ],
)
def test_urls(spark, raw, canonical, error):
    c = F.col("v")
    assert one(spark, F.struct(url.canonical_url(c), url.url_error(c)), v=raw) == (canonical, error)


def test_names_places_and_tone(spark):
    assert one(spark, text.name_list(F.col("v")), v=" CLIMATE ; ;ENERGY;CLIMATE;CLIMATE_CHANGE ") == ["CLIMATE", "ENERGY", "CLIMATE_CHANGE"]
    assert one(spark, text.name_list(F.col("v")), v=None) == []
    found = one(spark, text.locations(F.col("v")), v="1#Berlin#GM#GM16#52.5#13.4#-1746443;2##US##  ##;x#bad#US#US1#1#2#3;1#Nan#US#US1#NaN#2#3")
    assert len(found["items"]) == 2 and found["discarded"] == 2
    assert found["items"][0]["name"] == "Berlin" and found["items"][1]["name"] is None
    t = one(spark, text.tone(F.col("v")), v="-1.5,2,NaN,Infinity,,x,12.5")
    assert (t["tone_value"], t["tone_positive_score"], t["tone_negative_score"], t["tone_polarity"], t["tone_word_count"]) == (-1.5, 2.0, None, None, None)


def test_titles(spark):
    v = "  Ｎｅｗｓ &amp;\tAnalysis!  "
    assert one(spark, text.title_input(F.col("v")), v=v) == "News & Analysis!"
    assert one(spark, text.title_usability(F.col("v")), v="NPR News") == "TITLE_GENERIC"
    assert one(spark, text.title_usability(F.col("v")), v=None) == "TITLE_MISSING"
    raw = "<PAGE_TITLE> </PAGE_TITLE><page_title>Second &#x20B9;</page_title>"
    titles = text.tag_titles(F.col("v"))
    assert one(spark, text.first_title(titles), v=raw) == "Second &#x20B9;"
    assert one(spark, text.word_key(F.col("v")), v="Café -- Update! Straße ΣΟΦΟΣ Ｎ") == "Café -- Update! Straße ΣΟΦΟΣ N".casefold().replace(" -- ", " ").replace("! ", " ")
    assert sorted(one(spark, text.token_set(F.col("v")), v="Straße STRASSE ΣΟΦΟΣ σοφος")) == sorted({"strasse", "ΣΟΦΟΣ".casefold()})
    for v in ("x" * 1500, "\U0001f600" * 700, "a" + "\U0001f600" * 600, "short"):
        cut = one(spark, text.first_title(F.array("v")), v=v)
        assert v.startswith(cut) and len(cut.encode("utf-16-le")) // 2 <= 1000 and (cut == v or len((cut + v[len(cut)]).encode("utf-16-le")) // 2 > 1000)


def test_html_titles_say_what_their_sql_says(spark, tmp_path):
    titles = ["R&amp;D", "cut off &amp", "a &quot;b&quot; &#65; &amp;quot;", "Ｎｅｗｓ ﬁ", "\u00a0 a\u00a0b \u3000", "x\u00a0\u2028", " a\t\n\fb\x0bc ", "&amp;amp;", "\u2003", "", "ß İ \U0001f600"]
    pages = [(i, f"<html><TITLE>{t}</title><title>no</title></html>") for i, t in enumerate(titles)] + [(97, None), (98, "no title"), (99, "<title>open")]
    spark.createDataFrame([(i, f"http://a.org/{i}", h) for i, h in pages], "page_id LONG, url STRING, html STRING").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r["page_id"], r["title"]) for r in QUERIES["html_titles"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(con.execute(ORACLES["html_titles"]).fetchall())
    assert got[:2] == [(0, "R&D"), (1, "cut off &amp")] and len(got) == len(pages)


def test_publication_times(spark):
    tag = "<PAGE_PRECISEPUBTIMESTAMP>{}</PAGE_PRECISEPUBTIMESTAMP>"
    at = datetime(2026, 7, 5, 12)
    c = text.publication_time(F.col("v"), F.col("d"))
    many = tag.format("20260230120000") + tag.format("20260705121600") + tag.format("20260705121500")
    assert one(spark, c, v=many, d=at) == datetime(2026, 7, 5, 12, 15)
    assert one(spark, c, v=tag.format("bad"), d=at) is None


@pytest.mark.parametrize(("raw", "good"), [("https://a.example/x.jpg", True), ("/x.jpg", False), ("ftp://a.example/x", False), ("http:///x", False), ("http://a.example/a b", False), ("http://a.example/" + "x" * 2048, False)])
def test_images(spark, raw, good):
    assert one(spark, text.image_url(F.col("v")), v=raw) == (raw if good else None)


def test_lenient_times_and_casts(spark):
    assert one(spark, tsv.lenient_timestamp(F.col("v")), v="20260230101112") == datetime(2026, 2, 28, 10, 11, 12)
    assert one(spark, tsv.lenient_timestamp(F.col("v")), v="20260232101112") is None
    assert one(spark, tsv.value(F.col("v"), "int"), v=" 5 ") is None
    doubles = {" 1.5 ": 1.5, "1d": 1.0, "2.5F": 2.5, "-.5e1": -5.0, "0x1.8p1": 3.0, "-0X.4P2d": -1.0, "0xffp0": 255.0, "Infinity": float("inf"), "1_0": None, "x": None, "0x1.8": None, "0xp1": None, "d": None}
    for v, found in doubles.items():
        assert one(spark, tsv.value(F.col("v"), "double"), v=v) == found, v
    for v, good in {"20260705": True, "20260705Z": True, "20260705+0130": True, "20260705-180000": True, "20260705+1900": False, "20260705+01": False, "2026-07-05": False, "20260230": False}.items():
        assert (one(spark, tsv.value(F.col("v"), "date"), v=v) is not None) == good, v


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    e = spark.range(1).select(vectors.encoded(v, F.lit(2)).alias("e")).select("e.*", vectors.decoded("e.bytes", F.lit(2), "e.hash").alias("d")).first()
    assert e["norm"] == 5.0 and e["error"] is None and [round(x, 6) for x in e["d"]["vector"]] == [0.6, 0.8]
    bad = spark.range(1).select(vectors.encoded(F.array(F.lit(0.0)), F.lit(1)).alias("z"), vectors.encoded(v, F.lit(3)).alias("m"), vectors.decoded(F.lit(b"abcd"), F.lit(1), F.lit("x")).alias("h")).first()
    assert (bad["z"]["error"], bad["m"]["error"], bad["h"]["error"]) == ("ZERO_NORM", "DIMENSION_MISMATCH", "VECTOR_HASH")
    for a, b, c in (([1.0, 0.0], [1.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1)):
        assert float(one(spark, vectors.quantised(vectors.cosine(F.col("a"), F.col("b"))), a=a, b=b)) == c


def test_backoff_and_instants(spark):
    at = datetime(2026, 1, 1)
    waits = [one(spark, hashing.next_retry_at(F.col("n"), F.col("t")), n=n, t=at) for n in range(1, 6)]
    assert [None if w is None else int((w - at).total_seconds() // 60) for w in waits] == [1, 5, 15, 60, None]
    assert one(spark, hashing.next_retry_at(F.lit(1), F.col("t"), F.lit(120)), t=at) == datetime(2026, 1, 1, 0, 2)
    assert one(spark, hashing.instant_text(F.col("t")), t=datetime(2026, 7, 5, 12, 0, 0, 120000)) == "2026-07-05T12:00:00.120Z"
    assert one(spark, hashing.framed("a", F.col("v")), v="é") == "a=2:é\n"


def test_criteria():
    for bad in (search.Criteria(direction="DESC"), search.Criteria(signal_type="X"), search.Criteria(first_seen_from=datetime(2026, 1, 2), first_seen_to=datetime(2026, 1, 2))):
        with pytest.raises(search.InvalidRequest):
            search.validate(bad)
    for offset, limit in ((-1, 1), (0, 0), (0, 101)):
        with pytest.raises(search.InvalidRequest):
            search.validate(search.Criteria(), offset, limit)
    with pytest.raises(search.InvalidRequest):
        search.parse_instant("yesterday")
