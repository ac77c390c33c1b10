import hashlib
import re

import pytest

from pricetrace.llm import secret_scan
from pricetrace.llm.queries import QUERIES, documents

SF = "/root/testdata/sf0.01"


def brute(text):
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            spans.append((m.start(), 0, m.end()))
    for order, pattern, least in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        spans += [(m.start(), order, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(spans)


def test_query_matches_plain_search(spark):
    got = {r["doc_id"]: r for r in QUERIES["op5_secret_scan"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents(spark, SF).collect()}
    assert got.keys() == texts.keys()
    kinds = ["assign", "access", "hex"]
    for key, text in texts.items():
        spans = brute(text)
        assert [got[key][f"n_{k}"] for k in kinds] == [sum(o == i for _, o, _ in spans) for i in range(3)]
        digest = ",".join(f"{kinds[o]}:{s}:{e}" for s, o, e in spans)
        assert got[key]["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()
    assert sum(r["n_assign"] for r in got.values()) and sum(r["n_hex"] for r in got.values())


@pytest.mark.parametrize("text", [
    "", None, "é" * 40, "tOKen = 'abcdefgh12' token=short token: \"ABCD.efgh=12\"", "secret=token:abcdefgh12", "ſecret=abcdefghij",
    "AKIA" + "A" * 12 + "akia" + "B" * 20, "0123456789abcdef" * 2 + "g" + "f" * 31, "é token=" + "x" * 9 + " " + "AKIAX" * 9,
    "a" * 5_000_000 + " apikey=zzzzzzzz", "api_key:'aaaaaaaa'", "apikey : a.password=longvalue123",
])
def test_edges(spark, text):
    table = spark.createDataFrame([(1, text, "x"), (1, text, "y")], "doc_id bigint, text string, spans string")
    rows = secret_scan.scan(table, secret_scan.BASE).collect()
    want = [("assign access hex".split()[o], s, e) for s, o, e in brute(text or "")]
    assert [[(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in rows] == [want, want]


def test_more_rules_and_empty_table(spark):
    text = "see https://me:pass@host/ and ghp_" + "Z1" * 18 + " -----BEGIN RSA PRIVATE KEY-----"
    table = spark.createDataFrame([(7, text)], "doc_id bigint, text string")
    assert [x["kind"] for x in secret_scan.scan(table).head()["spans"]] == ["url_login", "code_host", "private_key"]
    assert secret_scan.scan(table.limit(0)).count() == 0


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]+") is None
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    assert secret_scan.trigram_query("(abc|xyz)d?") == {frozenset({"abc"}), frozenset({"xyz"})}
    assert secret_scan.trigram_query("a.b") is None
