"""Pages: structured extraction, links, crawl over a link relation, robots rules, cache freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import html as H
from quern.functions.text import strip
from quern.session import materialise


def extract(pages: DataFrame) -> DataFrame:
    """page_id, title, description, og (map), headings, images, n_links of each page."""
    html = F.col("html")
    tag = F.regexp_extract_all(html, F.lit(r"""(?i)<meta[^>]+property=["']og:([^"']+)["'][^>]+content=["'][^"']*["']"""), F.lit(1))
    value = F.regexp_extract_all(html, F.lit(r"""(?i)<meta[^>]+property=["']og:[^"']+["'][^>]+content=["']([^"']*)["']"""), F.lit(1))
    heads = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return pages.select(
        "page_id", H.title(html).alias("title"), F.regexp_extract(html, r"""(?i)<meta[^>]+name=["']description["'][^>]+content=["']([^"']*)["']""", 1).alias("description"),
        F.map_from_entries(F.array_distinct(F.arrays_zip(tag.alias("k"), value.alias("v")))).alias("og"), F.transform(heads, lambda h: strip(H.decode(F.regexp_replace(h, "<[^>]+>", "")))).alias("headings"),
        F.regexp_extract_all(html, F.lit(r"""(?i)<img[^>]+src=["']([^"']+)["']"""), F.lit(1)).alias("images"), F.size(H.hrefs(html)).alias("n_links"),
    )


def tables(pages: DataFrame) -> DataFrame:
    """(page_id, pos, rows) of the tables of each page, cells as text."""
    bodies = F.regexp_extract_all("html", F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))
    cell = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: strip(H.decode(F.regexp_replace(c, "<[^>]+>", ""))))
    rows = F.transform(F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), cell)
    return pages.select("page_id", F.posexplode(bodies).alias("pos", "t")).select("page_id", "pos", rows.alias("rows"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, link): absolute http(s) links in page order."""
    found = pages.select("page_id", "url", F.posexplode(H.hrefs(F.col("html"))).alias("pos", "href"))
    return found.select("page_id", "pos", H.absolute(F.col("url"), F.col("href")).alias("link")).where("link IS NOT NULL")


def readable(pages: DataFrame, least: int = 50, most: int = 50_000) -> DataFrame:
    """The first extractor whose text is long enough: the article, the body, the raw text; cut at ``most``."""
    html = F.col("html")
    tries = {"article": H.raw_text(F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)), "body": H.stripped(F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1)), "raw": H.raw_text(html)}
    wide = pages.select("page_id", "url", F.length("html").alias("content_length"), *(t.alias(f"_{k}") for k, t in tries.items()))
    used = F.coalesce(*(F.when(F.length(f"_{k}") > least, F.struct(F.lit(k).alias("by"), F.col(f"_{k}").alias("text"))) for k in tries), F.struct(F.lit("raw").alias("by"), F.col("_raw").alias("text")))
    return wide.select("page_id", "url", "content_length", used.alias("u")).select("page_id", "url", "content_length", F.col("u.by").alias("extractor"), F.length("u.text").alias("extracted_length"), F.substring("u.text", 1, most).alias("text"), (F.length("u.text") > most).alias("truncated"))


def crawl(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(node, depth): breadth-first over (src, dst) from the seeds; one join a level, at most ``depth`` levels."""
    seen = materialise(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "crawl")
    for level in range(1, depth + 1):
        frontier = seen.where(F.col("depth") == level - 1).select(F.col("node").alias("src"))
        fresh = edges.join(frontier, "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        grown = materialise(fresh.withColumn("depth", F.lit(level)), "crawl")
        seen = seen.unionByName(grown)
    return seen


def robots(lines: DataFrame) -> DataFrame:
    """(site, path): what robots.txt lines (site, pos, line) disallow for every agent."""
    key, value = F.lower(strip(F.split("line", ":", 2)[0])), strip(F.regexp_replace(F.split("line", ":", 2)[1], "#.*$", ""))
    w = Window.partitionBy("site").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    agent = F.last(F.when(F.col("k") == "user-agent", F.col("v")), ignorenulls=True).over(w)
    return lines.select("site", "pos", key.alias("k"), value.alias("v")).withColumn("agent", agent).where("k = 'disallow' AND agent = '*' AND v <> ''").select("site", F.col("v").alias("path"))


def fresh(writes: DataFrame, as_of, ttl: int) -> DataFrame:
    """Latest write a key (key, value, ts, seq) that hasn't expired."""
    last = writes.groupBy("key").agg(F.max_by(F.struct("value", "ts"), F.struct("ts", "seq")).alias("w")).select("key", "w.*")
    return last.where(F.col("ts") + F.make_dt_interval(secs=F.lit(ttl)) > as_of)
