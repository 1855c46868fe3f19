"""Queries: pages and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import html as H
from quern.functions import text as T
from quern.operators import web as W
from quern.plans.registry import query
from quern.session import materialise, table
from quern.sources.adapters import AS_OF, now

STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"


def decode(x: str, entities=H.NAMED) -> str:
    for a, b in entities:
        a, b = a.replace("'", "''"), b.replace("'", "''")
        x = f"replace({x}, '{a}', '{b}')"
    return x


def steps(x: str, chain) -> str:
    for p, r in chain:
        flags = "g" + "".join(c for c in "is" if p.startswith("(?") and c in p[2 : p.index(")")])
        body = p[p.index(")") + 1 :] if p.startswith("(?i") or p.startswith("(?s") else p
        body, r = body.replace("'", "''"), r.replace("$", "\\").replace("'", "''")
        rep = "'" + r + "'" if "\n" not in r else " || chr(10) || ".join(f"'{s}'" for s in r.split("\n"))
        x = f"regexp_replace({x}, '{body}', {rep}, '{flags}')"
    return x


TITLE = STRIP.format(decode(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
RAW = STRIP.format(steps(decode(steps("html", H.RAW)), ((r"[ \t]+", " "), (r"\n{3,}", "\n\n"))))
HREFS = """regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']+)["'']', 1)"""
ABSOLUTE = r"""CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^(https?:)', 1) || href
 WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href END"""
HOST = "lower(regexp_extract({}, '^https?://(?:[^/?#@]*@)?([^/:?#]+)', 1))"


@query("h01_title", f"SELECT page_id, {TITLE} AS title FROM pages")
def h01(spark, d):
    return table(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"))


@query("h02_raw_text", f"SELECT page_id, {RAW} AS text FROM pages")
def h02(spark, d):
    return table(spark, d, "pages").select("page_id", H.raw_text(F.col("html")).alias("text"))


@query("h03_extract", f"""SELECT page_id, {TITLE} AS title, '' AS description, len({HREFS}) AS n_links, list_transform(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda h: {STRIP.format(decode("regexp_replace(h, '<[^>]+>', '', 'g')"))}) AS headings FROM pages""")
def h03(spark, d):
    return W.extract(table(spark, d, "pages")).select("page_id", "title", "description", F.col("n_links").cast("long").alias("n_links"), "headings")


def raw_text(x: str) -> str:
    return STRIP.format(steps(decode(steps(x, H.RAW)), ((r"[ \t]+", " "), (r"\n{3,}", "\n\n"))))


def plain(x: str) -> str:
    return decode(STRIP.format(steps(x, ((r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), ("<[^>]+>", " "), (r"\s+", " ")))), H.FILE_ENTITIES)


READABLE = f"""t AS (SELECT page_id, url, length(html) AS content_length, {raw_text("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)")} AS a, {plain("regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1)")} AS b, {raw_text("html")} AS r FROM pages),
 u AS (SELECT *, CASE WHEN length(a) > 50 THEN 'article' WHEN length(b) > 50 THEN 'body' ELSE 'raw' END AS extractor, CASE WHEN length(a) > 50 THEN a WHEN length(b) > 50 THEN b ELSE r END AS found FROM t)"""


@query("h04_readable", f"WITH {READABLE} SELECT page_id, url, content_length, extractor, length(found) AS extracted_length, substr(found, 1, 50000) AS text, length(found) > 50000 AS truncated FROM u")
def h04(spark, d):
    return W.readable(table(spark, d, "pages"))


@query("h05_invisible", "SELECT page_id, length(html) AS before, length(html) - len(regexp_extract_all(html, '[\\x{200b}-\\x{200f}\\x{feff}\\x{ad}]')) AS after FROM pages")
def h05(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", F.length(html).cast("long").alias("before"), F.length(F.regexp_replace(html, T.INVISIBLE, "")).cast("long").alias("after"))


@query("h08_links", f"SELECT page_id, pos, {ABSOLUTE} AS link FROM (SELECT page_id, url, unnest({HREFS}) AS href, unnest(range(0, len({HREFS}))) AS pos FROM pages) WHERE {ABSOLUTE} IS NOT NULL AND (href LIKE '/%' OR href LIKE 'http%')")
def h08(spark, d):
    pages = table(spark, d, "pages")
    kept = pages.select("page_id", "url", "html")
    found = W.links(kept)
    return found.where(F.col("link").isNotNull())


#: Hosts and the paths that their pages link to, both ways: the sites that share a path are two steps apart.
EDGES = f"""l AS (SELECT DISTINCT {HOST.format('url')} AS host, href FROM (SELECT url, unnest({HREFS}) AS href FROM pages) WHERE starts_with(href, '/')), e AS (SELECT host AS src, href AS dst FROM l UNION SELECT href, host FROM l)"""


@query("h06_crawl", f"""WITH RECURSIVE {EDGES}, b(node, depth) AS (SELECT (SELECT min(host) FROM l), 0 UNION SELECT e.dst, depth + 1 FROM b JOIN e ON e.src = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM b GROUP BY node""")
def h06(spark, d):
    links = table(spark, d, "pages").select(H.host(F.col("url")).alias("src"), F.explode(H.hrefs(F.col("html"))).alias("dst")).where(F.col("dst").startswith("/"))
    edges = materialise(links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    return W.crawl(edges, edges.where(~F.col("src").startswith("/")).agg(F.min("src").alias("node")), 3)


@query("h07_robots", """WITH l AS (SELECT p_brand AS site, p_partkey AS pos, p_size % 4 AS k, p_size FROM part), a AS (SELECT *, last_value(CASE k WHEN 0 THEN '*' WHEN 1 THEN 'bot' END IGNORE NULLS) OVER (PARTITION BY site ORDER BY pos ROWS UNBOUNDED PRECEDING) AS agent FROM l)
 SELECT site, '/p' || p_size AS path FROM a WHERE k >= 2 AND agent = '*'""")
def h07(spark, d):
    k = F.col("p_size") % 4
    line = F.when(k == 0, "User-agent: *").when(k == 1, "User-Agent: bot").otherwise(F.concat(F.lit("Disallow: /p"), F.col("p_size").cast("string"), F.lit(" # note")))
    return W.robots(table(spark, d, "part").select(F.col("p_brand").alias("site"), F.col("p_partkey").alias("pos"), line.alias("line")))


@query("h09_cache_fresh", f"""SELECT user_id AS key, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY user_id HAVING max(ts) + INTERVAL 36000 SECOND > TIMESTAMP '{AS_OF}'""")
def h09(spark, d):
    e = table(spark, d, "events").where(F.col("ts") <= now()).select(F.col("user_id").alias("key"), "value", "ts", F.col("event_id").alias("seq"))
    return W.fresh(e, now(), 36_000)


@query("h11_fetch_record", f"SELECT page_id, length(html) AS content_length, length({RAW}) AS extracted_length, substr(md5(html), 1, 12) AS short_hash FROM pages")
def h11(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", F.length(html).cast("long").alias("content_length"), F.length(H.raw_text(html)).cast("long").alias("extracted_length"), F.substring(F.md5("html"), 1, 12).alias("short_hash"))


@query("p08_domain_policy", f"SELECT page_id, {HOST.format('url')} AS host, NOT ({HOST.format('url')} = 'example.net' OR ends_with({HOST.format('url')}, '.example.net')) AS allowed FROM pages")
def p08(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", H.host(url).alias("host"), H.allowed(url, block=["example.net"]).alias("allowed"))


@query("p09_private_addresses", """WITH h AS (SELECT event_id, [10, 172, 192, 127, 8, 169][CAST(event_id % 6 AS INT) + 1] AS a, user_id % 256 AS b FROM events)
 SELECT event_id, a || '.' || b || '.1.2' AS host, a IN (10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) AS private FROM h""")
def p09(spark, d):
    first = F.element_at(F.array(*map(F.lit, (10, 172, 192, 127, 8, 169))), (F.col("event_id") % 6 + 1).cast("int"))
    h = F.concat_ws(".", first.cast("string"), (F.col("user_id") % 256).cast("string"), F.lit("1"), F.lit("2"))
    return table(spark, d, "events").select("event_id", h.alias("host"), H.private_address(h).alias("private"))


PLAIN = STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')")


@query("s02_html_strip", f"SELECT page_id, {decode(PLAIN, H.FILE_ENTITIES)} AS text FROM pages")
def s02(spark, d):
    return table(spark, d, "pages").select("page_id", H.stripped(F.col("html")).alias("text"))
