"""Tables that a collector writes for each scan, and stand-ins for them where there are none.

A scan has the id of its home page (page_id). `read` takes `<sf_dir>/<name>.parquet` where the collector wrote
it; else the stand-in, which gives each page of `pages` a fetch, records and answers that follow from its id. A
stand-in is one SQL text over `pages` that Spark and DuckDB both run.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.values import COMMON_PATHS, PROBED_PATHS

#: The moment that ages are counted from, and as seconds.
AS_OF, AS_OF_SECONDS = "2024-01-31 00:00:00", 1706659200
DAY = 86400
#: Headers of a page as text, a line each; names in any case.
HEADERS = "concat('Server: web', CAST(page_id % 3 AS {text}), chr(10), CASE page_id % 4 WHEN 0 THEN concat('Strict-Transport-Security: max-age=1', chr(10), 'X-Frame-Options: DENY') WHEN 1 THEN 'content-security-policy: default-src' WHEN 2 THEN concat('X-Content-Type-Options: nosniff', chr(10), 'REFERRER-POLICY: origin') ELSE 'X-Powered-By: Next.js' END)"

# Robots files that the stand-in hands out in turn; tests hold what the parsers make of each.
ROBOTS = [
    "User-agent: *\nDisallow: /private\nDisallow:\nAllow: /Private/Open\nCrawl-delay: 2\nSitemap: https://a.example.org/one.xml",
    "# all may come\nUser-agent: OtherBot\nDisallow: /\nUser-agent: *\nDisallow: /EN # not this\nCrawl-delay: 0.5",
    "User-agent: SitelensBot\nDisallow: /tmp\nUser-agent: *\nDisallow:\nSitemap: https://a.example.org/one.xml\nsitemap: https://a.example.org/one.xml",
    "<html><title>404</title></html>",
    "User-agent: *\n" + "\n".join(f"Disallow: /d{k}" for k in range(12)),
]

TABLES = {
    "fetches": """SELECT page_id, CAST(CASE page_id % 17 WHEN 5 THEN 404 WHEN 11 THEN 503 WHEN 13 THEN 403 ELSE 200 END AS INT) AS status_code,
        CASE page_id % 9 WHEN 4 THEN 'https://www.landing.example.org/start' ELSE url END AS final_url,
        CASE page_id % 19 WHEN 7 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
        CAST(page_id % 6 AS INT) AS hops, CAST(100 + page_id % 700 AS INT) AS latency_ms, HEADERS AS headers, page_id % 23 <> 9 AS favicon_ok,
        page_id % 34 = 5 AS seen_active, CAST(CASE page_id % 34 WHEN 5 THEN page_id % 2 * 200 END AS INT) AS seen_status FROM pages""",
    "dns": """SELECT page_id, CASE page_id % 13 WHEN 6 THEN '' ELSE '192.0.2.7,192.0.2.9' END AS a_records, CASE page_id % 4 WHEN 1 THEN '2001:db8::7' ELSE '' END AS aaaa_records,
        'ns1.example.org,ns2.example.org' AS ns_records, page_id % 5 <> 2 AS mx_present FROM pages""",
    "tls": """SELECT page_id, page_id % 8 <> 3 AS https_ok, CASE WHEN page_id % 8 <> 3 THEN 'Example CA' END AS cert_issuer,
        CASE WHEN page_id % 8 <> 3 THEN AS_OF - 30 * 86400 END AS valid_from, CASE WHEN page_id % 8 <> 3 THEN AS_OF + (page_id % 40 - 5) * 86400 + 3600 END AS valid_to FROM pages""",
    "registration": """SELECT page_id, CASE WHEN page_id % 7 <> 2 THEN AS_OF - (page_id * 37 % 1500) * 86400 - 60 END AS registered_at, CASE WHEN page_id % 7 <> 2 THEN AS_OF + 90 * 86400 END AS expires_at,
        CASE WHEN page_id % 7 <> 2 THEN 'Example Registrar' END AS registrar, CASE page_id % 7 WHEN 2 THEN 'Could not parse dates from WHOIS output' END AS error, CASE page_id % 7 WHEN 2 THEN NULL WHEN 3 THEN 'whois' ELSE 'rdap' END AS source FROM pages""",
    "robots": "SELECT page_id, CAST(CASE page_id % 11 WHEN 3 THEN 404 ELSE 200 END AS INT) AS status_code, CASE page_id % {n} {files} END AS content FROM pages",
    "sitemaps": """SELECT page_id, CAST(k AS INT) AS pos, CASE k WHEN 0 THEN concat(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1), '/sitemap.xml') WHEN 2 THEN concat(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1), '/sitemap_index.xml') ELSE concat('https://a.example.org/', CAST(page_id AS {text}), '/sitemap', CAST(k AS {text}), '.xml') END AS url, CAST(CASE (page_id + k) % 4 WHEN 1 THEN 404 ELSE 200 END AS INT) AS status_code,
        CASE k WHEN 0 THEN concat('<sitemapindex><sitemap><loc> https://a.example.org/', CAST(page_id AS {text}), '/sitemap1.xml </loc></sitemap><sitemap><loc>https://a.example.org/', CAST(page_id AS {text}), '/sitemap3.xml</loc></sitemap><sitemap><loc>https://a.example.org/', CAST(page_id AS {text}), '/sitemap4.xml</loc></sitemap></sitemapindex>')
        ELSE concat('<urlset><url><loc>', url, '</loc></url><url><loc>https://a.example.org/contact/', CAST(page_id AS {text}), '</loc></url><url><loc>https://a.example.org/Contact-Us</loc></url></urlset>') END AS content
        FROM pages CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) v(k) WHERE k <= page_id % 8""",
    "policy_links": """SELECT page_id, policy_type, concat('https://a.example.org/', policy_type) AS url, (page_id + k) % 5 = 0 AS verified_ok FROM pages CROSS JOIN (VALUES (0, 'privacy'), (1, 'refund'), (2, 'terms')) v(k, policy_type)""",
    "renders": "SELECT page_id, url, concat(html, '<p>Drawn by a script.</p>') AS html FROM pages",
    "hops": """SELECT page_id, CAST(k AS INT) AS hop, concat(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1), '/hop', CAST(k AS {text})) AS url, CAST(CASE WHEN k < page_id % 13 THEN 302 WHEN page_id % 4 = 3 THEN 500 ELSE 200 END AS INT) AS status_code,
        CASE WHEN k >= page_id % 13 THEN NULL WHEN page_id % 11 = 5 AND k = 1 THEN 'https://far.example.net/' ELSE concat(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1), '/hop', CAST(k + 1 AS {text})) END AS location
        FROM pages CROSS JOIN (VALUES {hops}) v(k) WHERE k <= page_id % 13""",
    "policy_fetches": """SELECT page_id, concat(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1), path) AS url, CAST(CASE (page_id * 5 + k) % 8 WHEN 0 THEN 200 WHEN 2 THEN 403 WHEN 3 THEN 200 WHEN 4 THEN 500 WHEN 5 THEN 200 ELSE 404 END AS INT) AS status_code,
        CASE (page_id + k) % 9 WHEN 4 THEN 'application/pdf' ELSE 'text/html' END AS content_type, CASE (page_id + k) % 10 WHEN 7 THEN 'https://elsewhere.example.org/' ELSE concat(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1), path) END AS final_url,
        CASE (page_id + k) % 3 WHEN 0 THEN '<title>Policy</title><body><p>Our privacy policy, refund policy and terms of service.' WHEN 1 THEN '<body><h1>Page</h1><p>Just a moment...' ELSE '<body><h2>About</h2><p>Nothing here' END AS body, CAST(NULL AS {text}) AS rendered
        FROM pages CROSS JOIN (VALUES {common}) v(k, path)""",
    "probes": """SELECT page_id, CAST(pos AS INT) AS pos, path, CAST(CASE (page_id + pos * 3) % 7 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 403 WHEN 3 THEN 500 ELSE 404 END AS INT) AS status_code,
        CASE WHEN (page_id + pos * 3) % 7 < 2 THEN concat('About ', path, ' of ', url) END AS text FROM pages CROSS JOIN (VALUES {paths}) v(pos, path)""",
}


def sql(name: str, engine: str) -> str:
    """The stand-in of a table, for 'spark' or 'duck'."""
    text = TABLES[name].replace("HEADERS", HEADERS).replace("AS_OF", str(AS_OF_SECONDS))
    if engine == "spark":
        quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("\n", "\\n") + "'"
    else:
        quoted = lambda s: "'" + s.replace("\n", "' || chr(10) || '") + "'"
    text = (
        text.replace("{text}", "STRING" if engine == "spark" else "VARCHAR").replace("{n}", str(len(ROBOTS)))
        .replace("{files}", " ".join(f"WHEN {k} THEN {quoted(x)}" for k, x in enumerate(ROBOTS)))
        .replace("{hops}", ", ".join(f"({k})" for k in range(13)))
        .replace("{common}", ", ".join(f"({k}, '{p}')" for k, p in enumerate(p for x in COMMON_PATHS.values() for p in x)))
        .replace("{paths}", ", ".join(f"({k}, '{p}')" for k, p in enumerate(PROBED_PATHS)))
    )
    if engine == "spark":  # literal rows beside each page, without a join
        text = re.sub(r"CROSS JOIN \(VALUES (.*?)\) v\(([^)]*)\)", lambda m: f"LATERAL VIEW inline(array({m[1].replace('(', 'struct(')})) v AS {m[2]}", text, flags=re.S)
    return text


def exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if exists(spark, f"{sf_dir}/{name}.parquet"):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(sql(name, "spark").replace("FROM pages", "FROM {pages}"), pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))
