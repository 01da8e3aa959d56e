"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
from pathlib import Path

import duckdb
import pytest

from sitelens.plans import catalogue

SF = "/root/testdata/sf0.001"
CATALOGUE = catalogue()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def rounded(rows, columns):
    return sorted(repr([round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns]) for r in rows)


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_same_rows(spark, duck, name):
    query, sql = CATALOGUE[name]
    df = query(spark, SF)
    result = duck.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    assert rounded([r.asDict() for r in df.collect()], columns) == rounded([dict(zip(result.columns, r)) for r in result.fetchall()], columns)


#: Snippets that pages get in turn, so that every signal occurs.
SNIPPETS = [
    '<form action="https://collect.example.org/in"><input type="email"><input type="password"><input type="submit"></form>', '<form action="/login"><input type="password"><button>Log in</button></form>', '<meta http-equiv="refresh" content="0; url=https://other.example.org/">',
    '<script>window.location.href = "https://other.example.org/";</script>', '<script>eval("1 + 1"); atob("eA==")</script><script>' + "x" * 10_001 + "</script>", "<div><p>Generated by AI with webflow. Lorem ipsum. Only 3 left in stock. Hahaha-round neck. Very good quality.</p></div>",
    '<script src="https://cdn1.example.org/a.js"></script><script src="https://cdn2.example.org/b.js"></script><script src="/own.js"></script>', "<p>Hurry, limited time! 50% off, free shipping and clearance sale. Order now: checkout by PayPal or credit card, authorized dealer.</p>",
    '<footer><a href="/privacy-policy">Privacy Policy</a><a href="/terms">Terms of Service</a></footer><h2>Shared heading</h2>', '<div class="product"><a href="/products/red-shoe">Red shoe</a><del>$50.00</del></div><h2>Shared heading</h2><h3></h3>',
    '<address>Mail sales@shop.example or SALES@shop.example or noreply@shop.example, call +1 (706) 555-3138, <a href="https://www.linkedin.com/company/x">LinkedIn</a> <a href="https://facebook.com/x">F</a> <a href="https://x.com/y">X</a></address>',
    '<meta name="generator" content="WordPress"><h2>About us</h2><h3>Team</h3><img src="/a.png"><button>Go</button><table><tr><td>1</td></tr></table><link rel="icon" href="/f">',
]
#: Queries whose SQL reads the supplied pages only.
PLAIN = {"page_links", "policy_candidates", "policy_verification", "policy_cascade", "policy_summary", "link_list", "sku_extract", "sku_summary", "page_readings", "internal_links", "contact_links", "policy_run", "resolved_links"}


@pytest.fixture(scope="module")
def rich(spark, tmp_path_factory):
    """The smallest tables with every signal in its pages, and some pages that are empty or null."""
    path = tmp_path_factory.mktemp("rich")
    for f in glob.glob(f"{SF}/*.parquet"):
        if Path(f).stem != "pages":
            (path / Path(f).name).symlink_to(f)
    rows = [(r.page_id, r.url, r.html.replace("</body>", SNIPPETS[r.page_id % 12] + "</body>")) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows += [(1001, "https://empty.example/", ""), (1002, "https://null.example/", None), (1003, "HTTP://www.Upper.Example/A", "<TITLE></TITLE>plain")]
    pq.write_table(pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": [r[1] for r in rows], "html": [r[2] for r in rows]}), path / "pages.parquet")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in path.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return str(path), con


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in CATALOGUE.items() if sql and "pages" in sql and k not in PLAIN))
def test_same_rows_of_rich_pages(spark, rich, name):
    path, con = rich
    query, sql = CATALOGUE[name]
    df, result = query(spark, path), con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    assert rounded([r.asDict() for r in df.collect()], columns) == rounded([dict(zip(result.columns, r)) for r in result.fetchall()], columns)
