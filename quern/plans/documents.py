"""Queries: the document pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import files as FF
from quern.functions import text as T
from quern.operators import documents as D
from quern.operators import retrieval as R
from quern.plans.registry import query
from quern.plans.retrieval import OVERLAP, asked, cut
from quern.session import table
from quern.sources import adapters as S
from quern.sources.adapters import FILES_SQL


def docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"


@query("d01_chunks")
def d01(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("md", "py", "js", ""))), (F.col("id") % 4 + 1).cast("int"))
    return D.chunks(docs(spark, d).withColumn("kind", kind))


#: A fold over the paragraphs with what is held and what is done; white space at the ends is cut where two are joined.
FOLD = "list_transform(ps, lambda x: {'now': '', 'done': []::VARCHAR[], 'p': x})"
JOINED = "CASE WHEN a.now = '' THEN b.p ELSE " + STRIP.format("a.now || chr(10) || b.p") + " END"
FULL = f"(length({JOINED}) > 1000 AND a.now <> '')"
TAIL = "CASE WHEN length(a.now) > 100 THEN right(a.now, 100) || chr(10) || b.p ELSE b.p END"
PACKED = f"""p AS (SELECT doc_id AS id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n|\\n'), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS ps FROM documents),
 f AS (SELECT id, list_reduce(list_prepend({{'now': '', 'done': []::VARCHAR[], 'p': ''}}, {FOLD}), lambda a, b: {{'now': CASE WHEN {FULL} THEN {TAIL} ELSE {JOINED} END, 'done': CASE WHEN {FULL} THEN list_append(a.done, {STRIP.format('a.now')}) ELSE a.done END, 'p': ''}}) AS r FROM p),
 c AS (SELECT id, CASE WHEN {STRIP.format('r.now')} = '' THEN r.done ELSE list_append(r.done, {STRIP.format('r.now')}) END AS c FROM f)"""


@query("d03_packed_paragraphs", f"WITH {PACKED} SELECT id, CAST(k AS INT) AS chunk_index, c[k + 1] AS content FROM (SELECT id, c, unnest(range(0, len(c))) AS k FROM c)")
def d03(spark, d):
    return docs(spark, d).select("id", F.posexplode(D.packed(F.col("text"))).alias("chunk_index", "content"))


#: Whole texts below two headings; each 50th line of a text is a heading as well, at a level that follows from its place.
HEADED = r"""p AS (SELECT doc_id AS id, string_split('# ' || source || chr(10) || 'intro' || chr(10) || '## ' || lang || chr(10) || text, '. ') AS s FROM documents),
 t AS (SELECT id, array_to_string(list_transform(s, lambda x, i: CASE WHEN i % 9 = 0 THEN chr(10) || repeat('#', 1 + i % 5) || ' ' || x || chr(10) ELSE x END), '. ') AS t FROM p),
 l AS (SELECT id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS n FROM t),
 h AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INT) AS pos, CAST(length(regexp_extract(line, '^#+')) AS INT) AS level, regexp_replace(regexp_replace(line, '^#+\s+', ''), '\s+$', '') AS title FROM l WHERE regexp_matches(line, '^#{1,6}\s+\S'))"""


@query("d04_sections", f"""WITH {HEADED}, up AS (SELECT a.id, a.pos, string_agg(b.title, ' > ' ORDER BY b.pos) AS path FROM h a JOIN h b ON b.id = a.id AND b.pos < a.pos AND b.level < a.level
  WHERE NOT EXISTS (SELECT 1 FROM h m WHERE m.id = a.id AND m.pos > b.pos AND m.pos < a.pos AND m.level <= b.level) GROUP BY a.id, a.pos)
 SELECT h.id, h.pos, level, title, coalesce(path || ' > ', '') || title AS section_path FROM h LEFT JOIN up ON up.id = h.id AND up.pos = h.pos""")
def d04(spark, d):
    parts = F.split(F.concat(F.lit("# "), "source", F.lit("\nintro\n## "), "lang", F.lit("\n"), "text"), r"\. ", -1)
    headed = F.transform(parts, lambda x, i: F.when((i + 1) % 9 == 0, F.concat(F.lit("\n"), F.repeat(F.lit("#"), 1 + (i + 1) % 5), F.lit(" "), x, F.lit("\n"))).otherwise(x))
    return D.markdown_sections(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(headed, ". ").alias("text"))).where(F.col("title") != "").drop("body")


@query("d05_child_windows", f"""WITH w AS (SELECT doc_id AS id, unnest(list_filter(list_transform(range(0, CASE WHEN length(text) <= 600 THEN 1 ELSE length(text) END, 500), lambda s: CASE WHEN length(text) <= 600 THEN text ELSE {STRIP.format('substr(text, s + 1, 600)')} END), lambda x: x <> '')) AS content,
 unnest(range(0, 100000)) AS i FROM documents WHERE length(text) > 0) SELECT id, id * 100 + i AS child_index, content FROM w WHERE content IS NOT NULL""")
def d05(spark, d):
    return D.child_windows(docs(spark, d))


@query("d08_paragraphs", f"""SELECT id, content, pos FROM (SELECT doc_id AS id, unnest(p) AS content, unnest(range(0, len(p))) AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n'), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS p FROM documents))""")
def d08(spark, d):
    return docs(spark, d).select("id", F.posexplode(D.paragraphs(F.col("text"), "\n")).alias("pos", "content"))


@query("d10_change_set", """WITH b AS (SELECT doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN text || ' edited' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE doc_id % 11 = 0)
 SELECT coalesce(a.doc_id, b.path) AS path, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.path IS NULL THEN 'removed' WHEN md5(a.text) = md5(b.text) THEN 'unchanged' ELSE 'changed' END AS change FROM documents a FULL JOIN b ON a.doc_id = b.path""")
def d10(spark, d):
    old = docs(spark, d).withColumnRenamed("id", "path")
    edited = F.when(F.col("path") % 5 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    new = old.where("path % 7 <> 0").select("path", edited.alias("text")).union(old.where("path % 11 = 0").select(F.col("path") + 1_000_000_000, "text"))
    return D.change_set(old, new)


@query("e25_file_changes", """WITH o AS (SELECT doc_id AS path, doc_id % 90 AS m, sha256(text) AS h FROM documents WHERE doc_id % 13 <> 0),
 n AS (SELECT doc_id AS path, doc_id % 90 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS m, sha256(CASE WHEN doc_id % 6 = 0 THEN text || ' edited' ELSE text END) AS h FROM documents WHERE doc_id % 17 <> 0)
 SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN o.m = n.m THEN 'unchanged' WHEN o.h = n.h THEN 'touched' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.path = n.path""")
def e25(spark, d):
    path, text = F.col("id"), F.when(F.col("id") % 6 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    listed = lambda rows, modified, content: rows.select(path.alias("path"), modified.alias("modified"), F.sha2(content, 256).alias("digest"))
    old = listed(docs(spark, d).where("id % 13 <> 0"), path % 90, F.col("text"))
    new = listed(docs(spark, d).where("id % 17 <> 0"), path % 90 + F.when(path % 3 == 0, 1).otherwise(0), text)
    return D.file_changes(old, new)


@query("d16_merged_entities", """WITH f AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS name, 'name' AS kind FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]{9,}')), 'term' FROM documents)
 SELECT id, min(name) AS name, min(kind) AS kind, count(*) AS n FROM f GROUP BY id, lower(name)""")
def d16(spark, d):
    each = lambda pattern, kind: docs(spark, d).select("id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("name"), F.lit(kind).alias("kind"))
    return D.merged_entities(each("[A-Z][a-z]{3,}", "name").unionByName(each("[a-z]{9,}", "term")))


@query("d11_content_dedup", "SELECT md5(text) AS hash, min(doc_id) AS id, count(*) AS n FROM documents GROUP BY 1")
def d11(spark, d):
    return D.distinct_contents(docs(spark, d))


@query("d12_cascade_delete", "SELECT 'documents' AS relation, count(*) AS n FROM documents WHERE source <> 'src3' UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def d12(spark, d):
    both = {"documents": table(spark, d, "documents").select("doc_id", "source"), "labels": table(spark, d, "labels").select("doc_id")}
    left = D.drop_documents(both, both["documents"].where("source = 'src3'"))
    one = [df.agg(F.lit(name).alias("relation"), F.count("*").alias("n")) for name, df in left.items()]
    return one[0].union(one[1])


@query("d13_embeddings")
def d13(spark, d):
    return docs(spark, d).select("id", D.hashed_embedding(F.col("text")).alias("embedding"))


@query("d15_entities", r"""WITH e AS (SELECT doc_id AS id, unnest(list_distinct(list_transform(regexp_extract_all(text, '(\d+(?:[.,]\d+)?)\s*%', 1), lambda x: x || '%'))) AS name, 'percentage' AS kind FROM documents
 UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b(\d{2}\.\d{2}\.\d{4})\b', 1))), 'date' FROM documents) SELECT * FROM e""")
def d15(spark, d):
    return D.entity_counts(docs(spark, d))


@query("a21_entity_counts", r"""WITH e AS (SELECT doc_id % 100 AS bucket, unnest(list_distinct(regexp_extract_all(text, '(\d+)\.', 1))) AS name FROM documents) SELECT bucket, name, count(*) AS n FROM e GROUP BY ALL""")
def a21(spark, d):
    found = docs(spark, d).select((F.col("id") % 100).alias("bucket"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\d+)\."), F.lit(1)))).alias("name"))
    return found.groupBy("bucket", "name").agg(F.count("*").alias("n"))


@query("a22_context", f"""WITH {OVERLAP}, h AS ({cut('ov', 5)}), f AS (SELECT query_id, source AS doc, lang AS section, text AS content, min(rank) AS rank FROM h JOIN documents ON doc_id = id GROUP BY ALL),
 g AS (SELECT query_id, min(rank) AS rank, '## Источник: "' || doc || '"' || chr(10) || string_agg(chr(10) || '[, раздел "' || section || '"]' || chr(10) || content, chr(10) ORDER BY rank) || chr(10) AS body FROM f GROUP BY query_id, doc)
 SELECT query_id, string_agg(body, chr(10) ORDER BY rank) AS context FROM g GROUP BY query_id""")
def a22(spark, d):
    hits = R.word_overlap(docs(spark, d), asked(spark, d), 5)
    own = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc"), F.lit(None).cast("int").alias("page"), F.col("lang").alias("section"), F.col("text").alias("content"))
    return D.context(hits.join(own, "id").select("query_id", "rank", "doc", "page", "section", "content"))


@query("d17_file_key", f"""WITH {FILES_SQL} SELECT id, 'files/' || source || '/' || substr(sha256(name), 1, 16) || '_' || substr(regexp_replace(name, '\\.[^./]+$', ''), 1, 60) || '.' || ext AS storage_key FROM files""")
def d17(spark, d):
    f = S.files(spark, d)
    return f.select("id", FF.storage_key(F.col("source"), F.sha2("name", 256), F.col("name")).alias("storage_key"))


@query("d19_table_text", "SELECT o_custkey, string_agg(o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS content FROM orders GROUP BY o_custkey")
def d19(spark, d):
    row = F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("rows"))
    return rows.select("o_custkey", D.pipe_table(F.transform("rows", lambda x: x["r"])).alias("content"))


@query("d09_heading_levels", "SELECT p_partkey, CASE WHEN p_size / 20.0 >= 1.5 THEN 1 WHEN p_size / 20.0 >= 1.3 THEN 2 WHEN p_size / 20.0 >= 1.15 THEN 3 ELSE 0 END AS level FROM part")
def d09(spark, d):
    return table(spark, d, "part").select("p_partkey", D.heading_level(F.col("p_size"), F.lit(20.0)).alias("level"))


@query("s14_blocks", f"""WITH {FILES_SQL} SELECT id, CASE WHEN starts_with(mime_type, 'image/') THEN 'image' WHEN mime_type = 'application/pdf' THEN 'document' WHEN size_bytes > 10485760 THEN NULL WHEN ext = 'bin' THEN 'binary' ELSE 'text' END AS kind FROM files""".replace("SELECT id, CASE WHEN", "SELECT id, CASE WHEN size_bytes > 10485760 THEN 'too large' WHEN"))
def s14(spark, d):
    f = S.files(spark, d)
    text = F.when(FF.extension(F.col("name")) != ".bin", F.col("name"))
    return f.select("id", FF.block_type(F.col("mime_type"), F.col("name"), text, F.col("size_bytes")).alias("kind"))


@query("f15_key_preview", "SELECT p_partkey, CASE WHEN length(k) > 12 THEN left(k, 6) || '...' || right(k, 4) ELSE left(k, 3) || '...' || right(k, 2) END AS preview FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE md5(p_name) END AS k FROM part)")
def f15(spark, d):
    key = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.md5("p_name"))
    return table(spark, d, "part").select("p_partkey", FF.key_preview(key).alias("preview"))


@query("p12_secret_flags", """SELECT doc_id, CASE WHEN regexp_matches(text, '(?:sk-|sk-proj-)[A-Za-z0-9_-]{20,}') THEN 'OpenAI API key' WHEN regexp_matches(text, 'AKIA[A-Z0-9]{16}') THEN 'AWS Access Key ID' WHEN regexp_matches(text, 'ghp_[A-Za-z0-9]{36,}') THEN 'GitHub personal access token' END AS label,
 regexp_matches(text, '(?i)(password|passwd|secret|token|api_?key) = ') AS assigned FROM documents""")
def p12(spark, d):
    return table(spark, d, "documents").select("doc_id", T.secret(F.col("text")).alias("label"), F.col("text").rlike("(?i)(password|passwd|secret|token|api_?key) = ").alias("assigned"))
