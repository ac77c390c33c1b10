"""Files written by hand and by the sinks."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from pricetrace.keyword_sets import sections_df
from pricetrace.operators import pages
from pricetrace.schemas import ARTICLE_COLUMNS, TRADE_AMOUNT, TRADE_AREA, TRADE_MONTH
from pricetrace.sinks import datasets, reports
from pricetrace.sources import articles as source
from pricetrace.sources import reports as parse
from pricetrace.sources.trades import read_policy_map, read_trades


def article(i, title="t", body='body, with "quotes"\nand lines  '):
    return [f"{i:010d}", "101", "260", "011", "p", title, None, "2020-01-01 00:00:00", None, "<b>x</b>", body]


def write(path, rows, header=ARTICLE_COLUMNS, extra=""):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        if header:
            out.writerow(header)
        out.writerows(rows)
        f.write(extra)


def test_directory_scan_keeps_text_and_ids(spark, tmp_path):
    write(tmp_path / "merged_202001.csv", [article(1), article(2, title='"x", y')])
    write(tmp_path / "merged_202002.csv", [article(3)])
    write(tmp_path / "other.csv", [article(4)])
    df = source.with_month_from_file(source.read_articles(spark, str(tmp_path)))
    got = {r.article_id: r for r in df.collect()}
    assert {k: r.month for k, r in got.items()} == {"0000000001": "202001", "0000000002": "202001", "0000000003": "202002", "0000000004": "Unknown"}
    assert got["0000000001"].content_text == 'body, with "quotes"\nand lines  '
    assert got["0000000002"].title == '"x", y' and got["0000000001"].journalist_name is None
    assert source.with_month_from_file(source.read_articles(spark, str(tmp_path)), fallback=None).count() == 3


@pytest.mark.parametrize(
    ("name", "key", "month"),
    [
        ("merged_202001.csv", "six_digits", "202001"),
        ("merged_20200115.csv", "digits", "20200115"),
        ("x202003y.csv", "first_six", "202003"),
        ("score_202004.txt", "score_report", "202004"),
        ("article_101_260_20200505_0.csv", "day", "20200505"),
        ("nothing.csv", "six_digits", None),
    ],
)
def test_month_patterns(spark, name, key, month):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(source.month_from_name(F.col("n"), source.MONTH_PATTERNS[key], None)).first()[0] == month


def test_bad_lines(spark, tmp_path):
    short = "0000000009,101,260\r\n"
    long = "0000000008,1,2,3,4,5,6,7,8,9,10,11,12,13\r\n"
    write(tmp_path / "merged_202001.csv", [article(1)], extra=short + long)
    path = str(tmp_path)
    assert source.read_articles(spark, path).count() == 3
    dropped = source.read_articles(spark, path, on_bad="drop")
    assert {r.article_id for r in dropped.select("article_id").collect()} == {"0000000001", "0000000009"}
    marked = source.read_articles(spark, path, on_bad="quarantine")
    assert {r.article_id: r.is_bad for r in marked.collect()} == {"0000000001": False, "0000000009": False, "0000000008": True}


def test_headerless_and_dirty_headers(spark, tmp_path):
    write(tmp_path / "a.csv", [article(1)], header=None)
    assert source.read_headerless(spark, str(tmp_path / "a.csv")).first().article_id == "0000000001"
    dirty = spark.createDataFrame([("1", "2")], [" title\r", "content_text\n "])
    assert source.clean_columns(dirty).columns == ["title", "content_text"]


def test_trades_in_korean_charset(spark, tmp_path):
    for i, rows in enumerate([[("a", "82,500", "84.9", "202001")], [("b", "x", "0", "202002")]]):
        with open(tmp_path / f"{i}.csv", "w", encoding="cp949", newline="") as f:
            csv.writer(f).writerows([["시군구", TRADE_AMOUNT, TRADE_AREA, TRADE_MONTH], *rows])
    got = {tuple(r) for r in read_trades(spark, [str(tmp_path / "0.csv"), str(tmp_path / "1.csv")], keep=("시군구",)).collect()}
    assert got == {("82,500", 84.9, "202001", "a"), ("x", 0.0, "202002", "b")}


def test_policy_map(spark, tmp_path):
    (tmp_path / "m.csv").write_text("월,정책 1,정책type\n202001,3,정책 1\n202002,0,None\n", encoding="utf-8")
    assert {tuple(r) for r in read_policy_map(spark, str(tmp_path / "m.csv")).collect()} == {("202001", 1), ("202002", None)}


def test_compaction_reads_only_the_months_asked_for(spark, tmp_path):
    daily = tmp_path / "daily"
    daily.mkdir()
    for day, ids in {"20200131": [1, 2], "20200105": [3], "20200201": [4], "20191231": [5]}.items():
        write(daily / f"article_101_260_{day}_0.csv", [article(i) for i in ids])
    done = datasets.compact_by_month(spark, str(daily), str(tmp_path / "out"), "202001", "202002")
    assert {(r.month, r.article_id) for r in done.collect()} == {("202001", f"{i:010d}") for i in (1, 2, 3)} | {("202002", "0000000004")}
    january = [r.article_id for r in done.where("month = '202001'").collect()]
    assert january == ["0000000001", "0000000002", "0000000003"]  # later day first, lines in file order
    with pytest.raises(ValueError):
        datasets.compact_by_month(spark, str(daily), str(tmp_path / "o2"), "202002", "202001")
    as_csv = datasets.compact_by_month(spark, str(daily), str(tmp_path / "csv"), "202001", "202001", "csv")
    assert as_csv.count() == 3 and as_csv.first().content_text == article(1)[-1]


def test_counts_and_scores_reports(spark, tmp_path):
    rows = [("202001", 1, 5), ("202001", 2, 5), ("202002", 1, 0), ("202002", 2, 3)]
    counts = spark.createDataFrame(rows, "month string, policy int, cnt long")
    blocks = reports.counts_report(counts)
    first = blocks.where("month = '202001'").first().block.split("\n")
    assert first == ["파일: merged_202001.csv", "  정책 1: 5개 단어 발견", "  정책 2: 5개 단어 발견", "-" * 22, "최다 단어 정책: 정책 1", ""]
    reports.write_report(blocks, str(tmp_path / "c"))
    assert {tuple(r)[1:] for r in parse.parse_counts_report(spark, str(tmp_path / "c")).collect()} == set(rows)
    scores = counts.withColumn("score", F.col("cnt") + 0.12344)
    reports.write_report(reports.scores_report(scores), str(tmp_path / "s"))
    got = {tuple(r) for r in parse.parse_scores_report(spark, str(tmp_path / "s")).collect()}
    assert got == {(f"merged_{m}.csv", m, p, round(c + 0.1234, 4)) for m, p, c in rows}


def test_article_score_report_edge_lines(spark, tmp_path):
    (tmp_path / "score_202001.txt").write_text(
        "ID: 0001, 제목: a, b: c 제목: d\n  정책 1 TF-IDF 총합: 1.5000\n  정책 2 TF-IDF 총합: nan\n\n"
        "ID: 0002, 제목: two ID: 7\n  정책 1 TF-IDF 총합: 1.0000\n  정책 3 TF-IDF 총합: 0.2500\n\n"
        "전체 파일 기준 정책별 TF-IDF 총합:\n  정책 1 총합 TF-IDF: 2.5000\n",
        encoding="utf-8",
    )
    got = {tuple(r) for r in parse.parse_article_scores(spark, str(tmp_path)).collect()}
    assert got == {
        ("202001", "0001", "a, b: c 제목: d", 1, 1.5),
        ("202001", "0002", "two ID: 7", 1, 1.0),
        ("202001", "0002", "two ID: 7", 3, 0.25),
    }


def test_term_and_label_lines(spark):
    lines = spark.createDataFrame([("1. red plate: 0.1234",), ("no rank",), ("2. a:b: 1",)], "value string")
    assert [r.term for r in parse.parse_ranked_terms(lines).collect()] == ["red plate", "a"]
    labels = ["#comment 20 -> 15", "", "1. 가격 1", "2. 전매 제한 1  ", "32. 계약 2", "33. 계약 0", "42. 분양가 상한 3    "]
    got = [tuple(r) for r in parse.parse_labelled_words(spark.createDataFrame([(x,) for x in labels], "value string")).collect()]
    assert got == [(1, "가격", 1), (2, "전매 제한", 1), (32, "계약", 2), (42, "분양가 상한", 3)]


def test_unpivot_drops_absent_policies(spark):
    wide = spark.createDataFrame([("m", "1", 1.5, None, 2.0)], "month string, article_id string, `정책 1 x` double, `정책 2 x` double, other double")
    got = parse.unpivot_scores(wide, ["month", "article_id"], ["정책 1 x", "정책 2 x", "other"])
    assert {tuple(r) for r in got.collect()} == {("m", "1", 1, 1.5), ("m", "1", 0, 2.0)}


def test_month_documents_have_one_shape(spark):
    names = [*ARTICLE_COLUMNS, "article_url"]
    rows = [("202001", *[str(i)] * len(names)) for i in range(3000)] + [("202002", *["x"] * len(names))] * 3
    got = reports.month_documents(spark.createDataFrame(rows, ["month", *names])).collect()
    parsed = [(r.month, json.loads(r.document)) for r in got]
    assert all(list(d) == names for _, d in parsed)
    assert sorted(int(d["article_id"]) for m, d in parsed if m == "202001") == list(range(3000))
    assert sum(m == "202002" for m, _ in parsed) == 3


PAGE = """<html><head><meta content="Paper &amp; Co" name="twitter:creator"></head><body>
<h2 class="x" id="title_area"><span> A &lt;b&gt; title </span></h2>
<span class="media_end_head_info_datestamp_time _ARTICLE_DATE_TIME" data-date-time="2024-07-31 07:31:09">x</span>
<a href="https://n.news.naver.com/mnews/article/011/0004373862">1</a>
<a class="c" href='https://n.news.naver.com/mnews/article/011/0004373862'>2</a>
<a href=\\"https://n.news.naver.com/mnews/article/001/2\\">3</a><a href="/other">4</a>
<article id="dic_area">one<script>var a = "</p>";</script><br> <article>two</article> three</article></body></html>"""


def test_page_fields_links_and_ids(spark):
    df = spark.createDataFrame([(1, "https://x/article/011/0004373862?a=1", PAGE), (2, "https://x/none", "<p>nothing</p>")], "page_id long, url string, html string")
    links = [(r.page_id, r.position, r.link) for r in pages.extract_links(df).orderBy("position").collect()]
    assert links == [(1, 1, "https://n.news.naver.com/mnews/article/001/2"), (1, 2, "https://n.news.naver.com/mnews/article/011/0004373862")]
    ids = [tuple(r) for r in df.select(*pages.url_ids(F.col("url"))).collect()]
    assert ids == [("011", "0004373862"), (None, None)]
    for engine in ("native", "parser"):
        got = {r.page_id: r for r in pages.extract_fields(df, engine=engine).collect()}
        full = got[1]
        assert (full.newspaper_name, full.title, full.created_at) == ("Paper & Co", "A <b> title", "2024-07-31 07:31:09")
        assert full.updated_at is None and full.journalist_name is None
        assert all(v is None for v in got[2][2:])
        assert full.content_text == "one two three"  # nested articles are kept in balance
        assert full.content_origin.startswith('<article id="dic_area">') and full.content_origin.endswith("three</article>")


HARD = """<meta name='twitter:creator' content="L'Equipe &hellip; &#8220;x&#8221;"><h2 id=title_area>It&#x27;s &middot; L&#39;A &amp;lt; &bogus; &#xD800;x</h2>
<article class='a' id='dic_area'>a<article>b<article>c</article></article>d &copy;</article> <article>e</article>
<a href="https://n.news.naver.com/mnews/article/001/2?q=l'eau&amp;z=1">x</a><a href=https://n.news.naver.com/mnews/article/001/3>y</a>"""


def test_engines_agree_on_quotes_entities_and_nesting(spark):
    table = [(1, "u", HARD), (2, "u", None), (3, "u", "<article id='dic_area'>open <b>end")]
    df = spark.createDataFrame(table, "page_id long, url string, html string")
    native, parsed = (pages.extract_fields(df, engine=e).orderBy("page_id").collect() for e in ("native", "parser"))
    assert native == parsed
    first = native[0]
    assert first.newspaper_name == "L'Equipe … “x”" and first.title.startswith("It's · L'A &lt; &bogus;")
    assert first.content_text == "abcd ©" and first.content_origin.count("<article") == 3
    assert native[1].title is None and native[2].content_text == "open end"
    links = [r.link for r in pages.extract_links(df).collect()]
    assert links == ["https://n.news.naver.com/mnews/article/001/2?q=l'eau&z=1", "https://n.news.naver.com/mnews/article/001/3"]


def test_very_long_links(spark):
    long = "https://n.news.naver.com/mnews/article/001/2?" + "x" * 100_000
    html = f"""<a href="data:{'y' * 200_000}">z</a> <a href="{long}">t</a> <a href=\\"{long}\\">t</a>"""
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert [r.link for r in pages.extract_links(df).collect()] == [long]


def test_trades_with_other_column_orders(spark, tmp_path):
    from pricetrace.sources.trades import read_trades

    for name, text in {"a": "거래금액(만원),전용면적(㎡),계약년월\n\"50,000\",59.9,202001\n", "b": "계약년월,전용면적(㎡),거래금액(만원)\r\n202002,60.5,\"70,000\"\r\n"}.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode("cp949"))
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    got = read_trades(spark, str(tmp_path), keep=("none",)).orderBy("month").collect()
    assert [tuple(r) for r in got] == [("50,000", 59.9, "202001", None), ("70,000", 60.5, "202002", None)]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before


def test_sections(spark):
    df = spark.createDataFrame([("부동산",), ("없는 이름",)], "section string")
    got = {tuple(r) for r in pages.with_section_ids(df, sections_df(spark)).collect()}
    assert got == {("부동산", "101", "260"), ("없는 이름", None, None)}


def test_header_lines_are_compared_without_sorting_lines(spark, tmp_path):
    from pricetrace.sources import trades

    for name, text in (("a", "x,y\r\n1,2\r\n"), ("b", "y,x\n1,2\n"), ("c", "x,y\n3,4\n"), ("d", ""), ("e", "x,y")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    groups = trades.header_groups(spark, str(tmp_path))
    assert [[path[-5] for path in group] for group in groups] == [["a", "c", "e"], ["b"]]
    plan = trades.header_marks(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan
