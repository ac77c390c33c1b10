"""The node table of a page against a plain parser, and what its fields rest on."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from pricetrace.functions import markup
from pricetrace.operators import pages

TAGS = ("div", "article", "p", "img")


class Reader(HTMLParser):
    """Elements of TAGS as (tag, depth, text up to the closing tag) in the order they open."""

    def __init__(self):
        super().__init__()
        self.open, self.found, self.script = [], [], False

    def handle_starttag(self, tag, attrs):
        self.script = tag == "script"
        if tag in TAGS:
            node = [tag, len(self.open), ""]
            self.found.append(node)
            if tag not in markup.VOID_TAGS:
                self.open.append(node)

    def handle_endtag(self, tag):
        self.script = False
        for at in reversed(range(len(self.open))):
            if self.open[at][0] == tag:
                del self.open[at]
                break

    def handle_data(self, data):
        for node in [] if self.script else self.open:
            node[2] += data


def random_page(rng):
    parts = ["text ", "<b>bold</b>", "<!-- <div> -->", "<script>var x = '<p>';</script>", "<img src='a'>", "<P class=x>", "</p>", "<DIV>", "</div >", "<article id='n'>", "</article>", "<divider>"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(40)))


def test_node_table_equals_a_parser(spark):
    rng = random.Random(8)
    table = [(i, random_page(rng)) for i in range(300)] + [(300, ""), (301, "<"), (302, "a < b <article>c"), (303, None)]
    df = spark.createDataFrame(table, "page_id long, html string").withColumn("pieces", markup.page_pieces(F.col("html")))
    for row in df.select("*", markup.node_table("pieces", TAGS).alias("nodes")).collect():
        if row.html is None:
            assert row.nodes is None
            continue
        assert "".join(row.pieces) == row.html
        reader = Reader()
        reader.feed(row.html)
        reader.close()
        texts = []
        for node in row.nodes:
            inside = row.pieces[node.start : len(row.pieces) if node.end is None else node.end + 1]
            texts.append("".join(x for x in inside if x == "<" or not x.startswith("<")))
        assert [(n.tag, n.depth) for n in row.nodes] == [(tag, depth) for tag, depth, _ in reader.found]
        assert texts == [text for _, _, text in reader.found]
        assert all(row.pieces[n.start] == n.opening and (n.end is None or n.tag == "img" or row.pieces[n.end].startswith("</")) for n in row.nodes)


def test_pages_are_read_by_one_pattern(spark):
    df = spark.createDataFrame([(1, "u", "<article>x</article>")], "page_id long, url string, html string")
    fields = pages.extract_fields(df)
    plan = fields._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(html") == 1 and "html" not in plan.split("regexp_extract_all(html", 1)[1].split("_pieces", 1)[0].replace("html", "", 1)


def test_entities_are_decoded_once(spark):
    texts = ["&amp;lt; &lt;b&gt; &amp;amp; &nbsp;x&#65;&#x42;&#128;&bogus; & &am x", "none", "", None, "&amp;" * 50, "&copy;&copy;&hellip;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(markup.decode_entities(F.col("t"))).collect()]
    assert got == [t and markup.decoded(t) for t in texts]
    assert got[0] == "&lt; <b> &amp; \xa0xAB€&bogus; & &am x"


def test_attributes_with_quotes_and_missing_nodes(spark):
    html = """<html lang='k"o'><meta name="a" content='it&#39;s'><meta content=plain name=b><div class="it's">in</div>"""
    rules = (
        markup.FieldRule("lang", "HTML", (), "lang"),
        markup.FieldRule("a", "meta", (("name", "a"),), "content"),
        markup.FieldRule("b", "meta", (("name", "b"),), "content"),
        markup.FieldRule("gone", "meta", (("name", "c"),), "content"),
        markup.FieldRule("div", "div", (("class", "it's"),)),
        markup.FieldRule("raw", "div", (), "raw"),
    )
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    row = pages.extract_fields(df, rules).head()
    assert tuple(row)[2:] == ('k"o', "it's", "plain", None, "in", """<div class="it's">in</div>""")
