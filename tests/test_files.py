"""Files read in splits, and files that are not whole."""

import gzip
import random

import pytest

from pricetrace import schemas
from pricetrace.scratch import setting
from pricetrace.sinks import datasets
from pricetrace.sources import archives, articles, quoted


def wild_text(rng):
    return "".join(rng.choice(['"', '""', "\n", "\r\n", ",", "word ", "가나", "\\", "'", " "]) for _ in range(rng.randrange(30))).strip()


@pytest.fixture(scope="module")
def wild(spark, tmp_path_factory):
    """Two CSV files, one of them large, whose fields hold quotes, commas and line breaks."""
    rng, path = random.Random(9), str(tmp_path_factory.mktemp("wild"))
    rows = [[str(i), *[wild_text(rng) or None for _ in schemas.ARTICLE_COLUMNS[1:]]] for i in range(1500)]
    rows.append(["long", *["line\n" * 3000 + '"'] * 10])
    datasets.write_articles(spark.createDataFrame(rows[:1400] + rows[1500:], schemas.ARTICLES).coalesce(1), f"{path}/a")
    datasets.write_articles(spark.createDataFrame(rows[1400:1500], schemas.ARTICLES).coalesce(1), f"{path}/b")
    return path


def ordered(df):
    return sorted(tuple(x or "" for x in r) for r in df.collect())


@pytest.mark.parametrize("size", [100, 1000, 65536])
def test_splits_give_what_the_multi_line_reader_gives(spark, wild, size):
    with setting(spark, "spark.sql.files.maxPartitionBytes", str(size if size > 100 else 1000)), setting(spark, "spark.sql.files.openCostInBytes", "1"):
        split = articles.read_articles(spark, wild, splits=True)
        lines = quoted.split_lines(spark, wild)
        assert lines.select("file", "split").distinct().count() > (3 if size == 65536 else 100)
        assert quoted.open_splits(lines).where("inside").count() > 0 or size == 65536
        got = ordered(split)
    assert got == ordered(articles.read_articles(spark, wild)) and len(got) == 1501


def test_records_of_small_files(spark, tmp_path):
    cases = {"a": "h\r\n1\r\n\r\n2\n", "b": "h", "c": "", "d": 'h\n"x\ny"\n"open\nend', "e": "h\n3", "f": '"he\nad"\n4\n', "g": 'h\n"a""b\r\nc",x\r\n'}
    for name, text in cases.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(b'h\n"p\nq"\n5\n'))
    got = {}
    for r in quoted.quoted_records(spark, str(tmp_path)).collect():
        got.setdefault(r["file"].rsplit("/", 1)[1][0], []).append(r["record"])
    assert {k: sorted(v) for k, v in got.items()} == {"a": ["1", "2"], "d": ['"open\nend', '"x\ny"'], "e": ["3"], "f": ["4"], "g": ['"a""b\r\nc",x'], "z": ['"p\nq"', "5"]}
    assert quoted.quoted_records(spark, str(tmp_path), header=False).where("record = 'h'").count() == 6


def test_states_of_archives(spark, tmp_path):
    rng = random.Random(1)
    text = "".join(f"{i},{rng.random()}\n" for i in range(20_000)).encode()
    packed = gzip.compress(text)
    wrong = bytearray(packed)
    wrong[-6] ^= 1
    files = {
        "whole.csv.gz": packed, "two.csv.gz": packed + gzip.compress(b"x\n"), "padded.csv.gz": packed + b"\0" * 20, "half.csv.gz": packed[: len(packed) // 2],
        "trailer.csv.gz": packed[:-3], "sum.csv.gz": bytes(wrong), "text.csv.gz": b"plain text", "plain.csv": text,
        "bomb.csv.gz": gzip.compress(b"\n" * 20_000_000),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r["file"].rsplit("/", 1)[1]: r for r in archives.archive_states(spark, str(tmp_path)).collect()}
    assert {name: r["state"] for name, r in got.items()} == {
        "whole.csv.gz": "whole", "two.csv.gz": "whole", "padded.csv.gz": "whole", "half.csv.gz": "cut off", "trailer.csv.gz": "cut off",
        "sum.csv.gz": "damaged", "text.csv.gz": "damaged", "plain.csv": "whole", "bomb.csv.gz": "whole",
    }
    assert got["whole.csv.gz"]["line_ends"] == 20_000 and got["two.csv.gz"]["line_ends"] == 20_001 and got["bomb.csv.gz"]["line_ends"] == 20_000_000
    assert 5_000 < got["half.csv.gz"]["line_ends"] < 15_000 and got["half.csv.gz"]["bytes_read"] == got["half.csv.gz"]["length"]
    assert {r["file"].rsplit("/", 1)[1] for r in archives.damaged_files(spark, str(tmp_path)).collect()} == {n for n, r in got.items() if r["state"] != "whole"}


def test_nothing_of_a_cut_archive_is_read_when_skipping(spark, tmp_path):
    rng = random.Random(2)
    lines = ["\t".join(schemas.ARTICLE_COLUMNS).replace("\t", ",")] + [f"{i},{rng.random()}" for i in range(20_000)]
    packed = gzip.compress("\n".join(lines).encode())
    (tmp_path / "merged_202001.csv.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "merged_202002.csv.gz").write_bytes(packed)
    rows = articles.with_month_from_file(articles.read_articles(spark, str(tmp_path), skip_unreadable=True))
    assert [tuple(r) for r in rows.groupBy("month").count().collect()] == [("202002", 20_000)]
    with pytest.raises(Exception):
        articles.read_articles(spark, str(tmp_path)).count()


def test_only_months_of_changed_files_are_opened(spark, tmp_path):
    def write(day, *ids):
        lines = [",".join(schemas.ARTICLE_COLUMNS)] + [f"{i}" + "," * 10 for i in ids]
        (tmp_path / "daily").mkdir(exist_ok=True)
        (tmp_path / "daily" / f"article_101_260_{day}_0.csv").write_text("\n".join(lines) + "\n")

    source, target = str(tmp_path / "daily"), str(tmp_path / "compacted")

    def run():
        months = datasets.compact_new_files(spark, source, target, "202001", "202012")
        rows = sorted((r["month"], r["article_id"]) for r in datasets.read_months(spark, target).collect())
        full = datasets.compact_by_month(spark, source, str(tmp_path / f"full{len(list(tmp_path.iterdir()))}"), "202001", "202012")
        assert rows == sorted((r["month"], r["article_id"]) for r in full.collect())
        return months

    write("20200105", 1, 2)
    write("20200210", 3)
    write("20191231", 9)
    assert run() == ["202001", "202002"]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "compacted" / "month=202002").iterdir()}
    assert run() == []
    write("20200120", 4, 5)
    write("20200301", 6)
    assert run() == ["202001", "202003"]
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "compacted" / "month=202002").iterdir()}
    (tmp_path / "daily" / "article_101_260_20200105_0.csv").unlink()
    write("20200210", 3, 7, 8)
    assert run() == ["202001", "202002"]


def test_results_of_other_months_are_kept(spark, tmp_path):
    table = spark.createDataFrame([("202001", 1), ("202002", 2), ("202003", 3)], "month string, n int")
    path = str(tmp_path / "result")
    datasets.update_months(table, path, ["202001", "202002"])
    datasets.update_months(table.withColumn("n", table["n"] * 10), path, ["202002", "202003"])
    assert sorted(tuple(r) for r in spark.read.schema("n int, month string").parquet(path).select("month", "n").collect()) == [("202001", 1), ("202002", 20), ("202003", 30)]
