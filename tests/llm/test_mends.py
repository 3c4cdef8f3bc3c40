"""Pages within their limit whatever rows share; hosts and list entries as they are written."""

from conftest import COLUMNS
from pyspark.sql import functions as F

from terrakit.llm import quality_rules
from terrakit.llm.sharding import write_shards
from terrakit.llm.url_filters import host_of, judged_captures


def test_written_pages_keep_the_limit(spark, tmp_path):
    rows = [(None, f"{i:03d}" + "x" * 597, "en", "s", 1) for i in range(20)]
    rows += [(5, "y" * 700, "en", "s", 1)] * 9 + [(6, "z" * 5000, "en", "s", 1), (7, None, "en", "s", 1), (8, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4).withColumns({"shard": F.lit(1), "page": F.lit("clash")})
    write_shards(docs, str(tmp_path / "out"), 2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    sizes = back.groupBy("shard", "page").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert all((r.b or 0) <= 2000 or r.n == 1 for r in sizes)
    assert sorted((r.doc_id or -1, r.text or "") for r in back.collect()) == sorted((r[0] or -1, r[1] or "") for r in rows)
    write_shards(docs.limit(0), str(tmp_path / "none"), 2000)
    assert spark.read.schema(docs.schema).parquet(str(tmp_path / "none")).count() == 0


def test_hosts_and_entries_are_compared_alike(spark):
    urls = ["http://A.com./x", "https://b.a.COM:80/", "http://[::1]:8080/p", "http://u@c.org", "http://./", "nothing", None]
    rows = spark.createDataFrame([(i, u, 10) for i, u in enumerate(urls)], "page_id int, url string, day long")
    assert [r.h for r in rows.select(host_of(F.col("url")).alias("h")).collect()] == [
        "a.com", "b.a.com", "::1", "c.org", None, None, None]
    entries = spark.createDataFrame(
        [("A.com", "block", 1, "add"), ("C.ORG.", "block", 2, "add"), ("c.org", "block", 5, "remove"), (" . ", "block", 1, "add")],
        "domain string, list string, day long, action string")
    got = {r.page_id: (r.verdict, r.matched) for r in judged_captures(rows, entries).collect()}
    assert got[0] == got[1] == ("block", "a.com") and {got[i] for i in range(2, 7)} == {("none", None)}


def posterior(share, table, votes):
    good, bad = share, 1 - share
    for rule, vote in zip(table, votes):
        good, bad = good * rule[vote][0], bad * rule[vote][1]
    return good / (good + bad)


def test_label_model_keeps_good_good_whatever_the_share_of_junk():
    n = len(quality_rules.RULES)
    junk = [tuple(-1 if k in (i, (i + 1) % 4) else 0 for k in range(n)) for i in range(4)]
    clean = [tuple(1 if k in (5, i) else 0 for k in range(n)) for i in (8, 9)]
    for tenths in range(9):
        patterns = [(v, 25 * tenths) for v in junk if tenths] + [(v, 50 * (10 - tenths)) for v in clean]
        share, table = quality_rules.fit_label_model(patterns)
        assert all(posterior(share, table, v) > 0.5 for v in clean)
        assert not tenths or all(posterior(share, table, v) < 0.5 for v in junk)
        assert all(rule[-1][0] <= quality_rules.MOST_FALSE + 1e-12 for rule in table)
