from __future__ import annotations

import duckdb

from stratagrid.llm import linededup as D


def test_site_relative_frequency(spark):
    menu = "<ul><li>Home</li><li>About  us</li></ul><script>x='<p>no</p>'</script><!-- c -->"
    pages = [(i, f"https://A.example.com/{i}", f"<html><body>{menu}<p>story {i} &amp; more</p>Home</body></html>") for i in range(10)]
    pages += [(20 + i, f"http://u@b.example.com:80/{i}", "<p>Home</p>" if i < 2 else f"<p>own {i}</p>") for i in range(10)]
    pages += [(50, None, "<p>x</p>"), (51, "no url", None), (50, None, "<p>x</p>"), (None, "https://a.example.com/z", "")]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, host string, lines int")
    for size in (500_000, 0):
        got = {}
        for r in D.clean_pages(df, broadcast_lines=size).collect():
            got.setdefault(r["page_id"], []).append(r)
        assert got[3][0]["text"] == "story 3 & more" and got[3][0]["n_dropped"] == 3 and got[3][0]["host"] == "a.example.com"
        assert got[20][0]["text"] == "Home" and got[20][0]["host"] == "b.example.com"
        assert len(got[50]) == 2 and got[50][0]["text"] == "x" and got[51][0]["text"] == "" and got[None][0]["n_lines"] == 0
    assert D.page_report(df.limit(0)).collect() == []


def test_report_equals_sql(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    want = duckdb.sql(D.report_sql().replace("FROM pages", f"FROM '{path}'")).fetchall()
    got = [tuple(r) for r in D.page_report(spark.read.parquet(path)).collect()]
    assert sorted(got) == sorted(want)
