"""Registered queries over corpus ingest and retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import corpus, retrieval, vectorpages
from tessella.sources.tables import read_table, scratch_path

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_PATH = """CASE WHEN doc_id % 17 = 0 THEN 'misc/' ELSE 'books/Class ' || (6 + doc_id % 7) || ' ' || lang || ' Part ' || (1 + doc_id % 2) || '/' END
 || CASE WHEN doc_id % 13 = 0 THEN source || '-Answers-' || doc_id ELSE (doc_id % 20) || '-' || source || '_' || doc_id END || '.pdf'"""
_PATHS = f"""paths AS (SELECT doc_id, text, {_PATH} AS path FROM documents),
meta AS (SELECT doc_id, text, path, regexp_extract(path, 'Class ([0-9]+)', 1) AS class_level, regexp_extract(path, 'Class [0-9]+ (.*) Part', 1) AS subject, regexp_extract(path, '(Part [0-9]+)', 1) AS part,
  coalesce(TRY_CAST(regexp_extract(stem, '^([0-9]+)-', 1) AS INT), 0) AS chapter_number,
  CASE WHEN regexp_matches(stem, '^[0-9]+-') THEN replace(replace(regexp_extract(stem, '^[0-9]+-(.*)', 1), '_', ' '), '-', ' ') ELSE stem END AS chapter_name, stem AS pdf_name
  FROM (SELECT *, regexp_extract(path, '([^/]*)[.]pdf$', 1) AS stem FROM paths))"""


def _paths(s: SparkSession, d: str) -> DataFrame:
    return corpus.path_metadata(read_table(s, d, "documents").select("doc_id", "text", F.expr(_PATH).alias("path")))


@query("path_metadata", f"WITH {_PATHS} SELECT doc_id, class_level, subject, part, chapter_number, chapter_name, pdf_name FROM meta")
def _(s, d):
    return _paths(s, d).select("doc_id", "class_level", "subject", "part", "chapter_number", "chapter_name", "pdf_name")


@query("skip_documents", f"WITH {_PATHS} SELECT doc_id, pdf_name FROM meta WHERE NOT contains(lower(pdf_name), 'answer')")
def _(s, d):
    return corpus.skip_documents(_paths(s, d)).select("doc_id", "pdf_name")


@query("incremental_ingest", f"WITH {_PATHS} SELECT doc_id, pdf_name FROM meta WHERE pdf_name NOT IN (SELECT pdf_name FROM meta WHERE doc_id % 3 = 0)")
def _(s, d):
    rows = _paths(s, d)
    return corpus.incremental_ingest(rows, rows.where("doc_id % 3 = 0")).select("doc_id", "pdf_name")


@query("low_yield_route", "SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 5000 THEN 'extract_again' ELSE 'chunk' END AS route FROM documents")
def _(s, d):
    return corpus.low_yield_route(read_table(s, d, "documents")).select("doc_id", "route")


_TAIL = """CASE doc_id % 4 WHEN 0 THEN '{n}| name | lang | n |{n}| --- | --- | --- |{n}| ' || source || ' | ' || lang || ' | ' || n_chars || ' |{n}| x |  | 7 |{n}after it' WHEN 1 THEN '{n}| a | b |{n}| c | d |' WHEN 2 THEN '{n}| - | - |' ELSE '' END"""
_MD = "md AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i : CASE WHEN i > 1 AND (i - 1) % 5 = 0 THEN '## Section ' || ((i - 1) // 5) || chr(10) || l ELSE l END), chr(10)) || " + _TAIL.replace("'{n}", "chr(10) || '").replace("{n}", "' || chr(10) || '") + " AS text FROM documents)"
_SECTIONS = _MD + r""", pieces AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS section_pos FROM (SELECT doc_id, string_split(regexp_replace(chr(10) || text, '\n## ', chr(1), 'g'), chr(1)) AS ps FROM md)),
sections AS (SELECT * FROM (SELECT doc_id, section_pos::INT AS section_pos, CASE WHEN section_pos = 0 THEN '' ELSE trim(regexp_extract(p, '^([^\n]*)', 1)) END AS section, CASE WHEN section_pos = 0 THEN p ELSE regexp_replace(p, '^[^\n]*\n?', '') END AS body FROM pieces) WHERE regexp_matches(body, '\S'))"""
_BLOCKS = _SECTIONS + r""", ln AS (SELECT doc_id, section_pos, section, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_pos FROM (SELECT *, string_split(body, chr(10)) AS ls FROM sections)),
turned AS (SELECT *, CASE WHEN is_table <> lag(is_table) OVER (PARTITION BY doc_id, section_pos ORDER BY line_pos) THEN 1 ELSE 0 END AS turn FROM (SELECT *, regexp_matches(line, '^\s*\|') AS is_table FROM ln)),
blocks AS (SELECT doc_id, section_pos, section, block_pos, is_table, list(line ORDER BY line_pos) AS lines FROM (SELECT *, sum(turn) OVER (PARTITION BY doc_id, section_pos ORDER BY line_pos) AS block_pos FROM turned) GROUP BY ALL)"""
_CHUNKS = _BLOCKS + r""", pk AS (SELECT doc_id, section_pos, section, block_pos, list_reduce(list_concat([{'buf': '', 'out': []::VARCHAR[]}], list_transform(list_filter(list_transform(lines, lambda l : regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l : l <> ''),
    lambda l : {'buf': l || CASE WHEN right(l, 1) IN ('.', '!', '?', ':', ';', ',') THEN ' ' ELSE '. ' END, 'out': []::VARCHAR[]})),
    lambda acc, x : CASE WHEN length(acc.buf) + length(x.buf) >= 5000 THEN {'buf': '', 'out': list_append(acc.out, acc.buf || x.buf)} ELSE {'buf': acc.buf || x.buf, 'out': acc.out} END) AS r FROM blocks WHERE NOT is_table),
pieces2 AS (SELECT doc_id, section_pos, section, block_pos, CASE WHEN r.buf = '' THEN r.out ELSE list_append(r.out, r.buf) END AS o FROM pk),
texts AS (SELECT doc_id, section_pos, section, block_pos, generate_subscripts(o, 1) - 1 AS row_pos, chr(10) || unnest(o) AS content, 'text' AS chunk_type FROM pieces2),
tb AS (SELECT *, CASE WHEN second THEN 2 WHEN plain THEN 1 ELSE 0 END AS skip, CASE WHEN second OR plain THEN cells[1] END AS header FROM (
  SELECT doc_id, section_pos, section, block_pos, lines, list_transform(lines, lambda l : list_transform(string_split(regexp_replace(trim(l), '^\|+|\|+$', '', 'g'), '|'), lambda c : trim(c))) AS cells,
    coalesce(regexp_matches(lines[2], '^\s*\|[\s:\-|]+\|?\s*$'), false) AS second,
    NOT regexp_matches(lines[1], '^\s*\|[\s:\-|]+\|?\s*$') AND len(string_split(regexp_replace(trim(lines[1]), '^\|+|\|+$', '', 'g'), '|')) > 2 AS plain FROM blocks WHERE is_table)),
trow AS (SELECT doc_id, section_pos, section, block_pos, header, unnest(lines) AS line, unnest(cells) AS cells, generate_subscripts(lines, 1) AS pos, skip FROM tb),
tcell AS (SELECT *, list_transform(list_filter(range(1, len(cells) + 1), lambda i : header IS NOT NULL AND len(header) = len(cells) AND header[i] <> '' AND cells[i] <> ''), lambda i : header[i] || ': ' || cells[i]) AS named FROM trow WHERE pos > skip AND NOT regexp_matches(line, '^\s*\|[\s:\-|]+\|?\s*$')),
tcont AS (SELECT * FROM (SELECT *, CASE WHEN len(named) > 0 THEN array_to_string(named, ' | ') ELSE array_to_string(list_filter(cells, lambda c : c <> ''), ' | ') END AS content FROM tcell) WHERE trim(content) <> ''),
trows AS (SELECT doc_id, section_pos, section, block_pos, row_number() OVER (PARTITION BY doc_id, section_pos, block_pos ORDER BY pos) - 1 AS row_pos, content, 'table_row' AS chunk_type FROM tcont),
twhole AS (SELECT doc_id, section_pos, section, block_pos, 0 AS row_pos, array_to_string(lines, chr(10)) AS content, 'table' AS chunk_type FROM tb t WHERE NOT EXISTS (SELECT 1 FROM tcont c WHERE c.doc_id = t.doc_id AND c.section_pos = t.section_pos AND c.block_pos = t.block_pos)),
allc AS (SELECT * FROM texts UNION ALL SELECT * FROM trows UNION ALL SELECT * FROM twhole),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_pos, block_pos, row_pos)::INT AS chunk_id FROM allc),
chunks AS (SELECT *, coalesce(right(lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_id), 500), '') AS previous_text FROM numbered)"""


def md_docs(s: SparkSession, d: str, *also: Column) -> DataFrame:
    text = "array_join(transform(split(text, '\\n'), (l, i) -> CASE WHEN i > 0 AND i % 5 = 0 THEN '## Section ' || (i div 5) || '\\n' || l ELSE l END), '\\n') || " + _TAIL.replace("{n}", "\\n")
    return read_table(s, d, "documents").select("doc_id", F.expr(text).alias("text"), *also)


def _blocks(s, d):
    return corpus.line_blocks(corpus.split_sections(md_docs(s, d)))


def _md5(*cols: str) -> list:
    return [F.md5(c).alias(f"{c}_md5") for c in cols]


@query("split_sections", f"WITH {_SECTIONS} SELECT doc_id, section_pos, section, md5(body) AS body_md5 FROM sections")
def _(s, d):
    return corpus.split_sections(md_docs(s, d)).select("doc_id", "section_pos", "section", *_md5("body"))


@query("explode_table_rows", f"WITH {_CHUNKS} SELECT doc_id, section_pos, block_pos::BIGINT AS block_pos, row_pos::INT AS row_pos, content, chunk_type FROM (SELECT * FROM trows UNION ALL SELECT * FROM twhole)")
def _(s, d):
    return corpus.explode_table_rows(_blocks(s, d)).select("doc_id", "section_pos", "block_pos", "row_pos", "content", "chunk_type")


@query("pack_text_chunks", f"WITH {_CHUNKS} SELECT doc_id, section_pos, block_pos::BIGINT AS block_pos, row_pos::INT AS row_pos, length(content) AS chars, md5(content) AS content_md5 FROM texts")
def _(s, d):
    return corpus.pack_text_chunks(_blocks(s, d)).select("doc_id", "section_pos", "block_pos", "row_pos", F.length("content").cast("long").alias("chars"), *_md5("content"))


@query("number_chunks", f"WITH {_CHUNKS} SELECT doc_id, chunk_id, chunk_type, section FROM numbered")
def _(s, d):
    return corpus.chunk_documents(md_docs(s, d)).select("doc_id", "chunk_id", "chunk_type", "section")


@query("previous_context", f"WITH {_CHUNKS} SELECT doc_id, chunk_id, previous_text FROM chunks")
def _(s, d):
    return corpus.chunk_documents(md_docs(s, d)).select("doc_id", "chunk_id", "previous_text")


@query("embedding_text", f"WITH {_CHUNKS} SELECT doc_id, chunk_id, md5('Section: ' || section || chr(10) || chr(10) || 'Content: ' || content) AS embedding_text_md5 FROM chunks")
def _(s, d):
    return corpus.embedding_text(corpus.chunk_documents(md_docs(s, d))).select("doc_id", "chunk_id", *_md5("embedding_text"))


_HASHED = """, tk AS (SELECT doc_id, chunk_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS slot FROM (SELECT doc_id, chunk_id, unnest(regexp_extract_all(lower('Section: ' || section || chr(10) || chr(10) || 'Content: ' || content), '[a-z0-9]+')) AS t FROM chunks)),
sl AS (SELECT doc_id, chunk_id, slot, count(*) AS n FROM tk GROUP BY ALL), nm AS (SELECT doc_id, chunk_id, map_from_entries(list((slot, n))) AS m, sqrt(sum(n * n)) AS norm FROM sl GROUP BY 1, 2)"""


@query("embed_batch", f"WITH {_CHUNKS}{_HASHED} SELECT doc_id, chunk_id, list_transform(range(0, 64), lambda i : round((coalesce(m[i], 0) / norm)::FLOAT::DOUBLE, 4)) AS embedding FROM nm")
def _(s, d):
    chunks = corpus.embedding_text(corpus.chunk_documents(md_docs(s, d))).select("doc_id", "chunk_id", "embedding_text")
    return corpus.embed_batch(chunks, corpus.hash_encoder).select("doc_id", "chunk_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("embedding"))


def _stored(s, d):
    chunks = corpus.chunk_documents(md_docs(s, d)).join(_paths(s, d).drop("text"), "doc_id")
    return chunks.withColumn("embedding", F.when(F.col("doc_id") % 10 != 9, F.array(F.lit(1.0))))


@query("write_chunks", f"WITH {_CHUNKS}, {_PATHS} SELECT sha256(m.pdf_name || ':' || c.chunk_id) AS point_id, nullif(m.subject, '') AS subject, nullif(m.class_level, '') AS class_level FROM chunks c JOIN meta m USING (doc_id) WHERE doc_id % 10 <> 9")
def _(s, d):
    """Stored twice and read back: first with a third of the documents under another subject and with a chunk too many, some of them with embeddings that they lose."""
    path, now = scratch_path(s, "chunks"), _stored(s, d)
    changed = F.col("doc_id") % 3 == 0
    before = now.withColumns({"subject": F.when(changed, "elsewhere").otherwise(F.col("subject")), "embedding": F.when(changed | (F.col("doc_id") % 10 != 9), F.array(F.lit(1.0)))})
    numbers = F.when(changed & (F.col("chunk_id") == 1), F.array("chunk_id", F.lit(-1))).otherwise(F.array("chunk_id"))
    corpus.write_chunks(before.withColumn("chunk_id", F.explode(numbers)), path)
    corpus.write_chunks(now.where(changed), path)
    return corpus.read_chunks(s, path).select("point_id", "subject", F.col("class_level").cast("string").alias("class_level"))


@query("collection_info", f"WITH {_CHUNKS}, {_PATHS} SELECT coalesce(subject, 'All') AS subject, count(*) AS chunks, count(DISTINCT pdf_name) AS documents FROM chunks JOIN meta USING (doc_id) GROUP BY ROLLUP (subject)")
def _(s, d):
    return corpus.collection_info(_stored(s, d))


@query("collection_status", f"WITH {_CHUNKS}, {_PATHS}, n AS (SELECT ['textbook_chunks', 'textbook_notes'] AS all_collections) SELECT 'textbook_chunks' AS collection, true AS exists, count(*) AS points, any_value(all_collections) AS all_collections FROM chunks JOIN meta USING (doc_id), n UNION ALL SELECT 'textbook_none', false, 0, all_collections FROM n")
def _(s, d):
    _stored(s, d).createOrReplaceTempView("textbook_chunks")
    s.range(0).createOrReplaceTempView("textbook_notes")
    return corpus.collection_status(s, "textbook_chunks", "textbook_").union(corpus.collection_status(s, "textbook_none", "textbook_"))


_VECTORS = """vec AS (SELECT e.vec_id, e.embedding::DOUBLE[] AS v, CAST(e.label AS VARCHAR) AS subject, CAST(6 + vec_id % 7 AS VARCHAR) AS class_level, CAST(vec_id % 10 AS VARCHAR) AS chapter_number, 'v' || (vec_id % 25) AS pdf_name, d.text AS content, d.source AS section FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id),
q AS (SELECT vec_id AS query_id, v, 'like ' || vec_id AS query FROM vec WHERE vec_id % 20 = 0), c AS (SELECT * FROM vec)"""
_SCORED = _VECTORS + ", sc AS (SELECT query_id, c.*, list_cosine_similarity(q.v, c.v) AS score FROM q, c WHERE {test})"
_TOP = _SCORED + ", hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM sc {least}) WHERE rank <= 5)"


def _vectors(s, d):
    docs = read_table(s, d, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("section"))
    e = read_table(s, d, "embeddings").selectExpr("vec_id AS chunk_id", "embedding", "cast(label AS string) AS subject", "cast(6 + vec_id % 7 AS string) AS class_level", "cast(vec_id % 10 AS string) AS chapter_number", "'v' || (vec_id % 25) AS pdf_name")
    return e.join(docs, F.col("chunk_id") == F.col("doc_id"), "left").drop("doc_id"), read_table(s, d, "embeddings").where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding", "'like ' || vec_id AS query")


def _hits(s, d, test=None, least=None):
    chunks, queries = _vectors(s, d)
    kept = chunks if test is None else chunks.where(test)
    hits = retrieval.vector_topk(kept.select("chunk_id", "embedding"), queries, 5, least)
    return queries, hits.join(chunks.drop("embedding").withColumn("chapter_name", F.lit(None).cast("string")), "chunk_id")


_TEST = {"subject": "3", "class_level": "all"}


@query("metadata_filter", f"WITH {_VECTORS} SELECT vec_id AS chunk_id, subject, pdf_name FROM c WHERE subject = '3' AND TRY_CAST(chapter_number AS INT) = 2")
def _(s, d):
    return _vectors(s, d)[0].where(retrieval.metadata_filter(" 3 ", "All", "2")).select("chunk_id", "subject", "pdf_name")


@query("vector_topk", "WITH " + _TOP.format(test="subject = '3'", least="") + " SELECT query_id, vec_id AS chunk_id, rank, round(score, 4) AS score FROM hits")
def _(s, d):
    return _hits(s, d, retrieval.metadata_filter(**_TEST))[1].select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query("vector_topk_threshold", "WITH " + _TOP.format(test="true", least="WHERE score >= 0.2") + " SELECT query_id, vec_id AS chunk_id, rank, round(score, 4) AS score FROM hits")
def _(s, d):
    return _hits(s, d, None, 0.2)[1].select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query("vector_topk_paged", "WITH " + _TOP.format(test="c.class_level = '7'", least="WHERE score >= 0.1") + " SELECT query_id, vec_id AS chunk_id, rank, round(score, 4) AS score FROM hits")
def _(s, d):
    """Over an index of pages, with a filter on a stored column and a threshold."""
    chunks, queries = _vectors(s, d)
    index = vectorpages.build(chunks.select("chunk_id", "class_level", "embedding"), scratch_path(s, "pages"), pivots=32)
    return vectorpages.search(index, queries, 5, 0.1, retrieval.metadata_filter(class_level="7")).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query("scroll_chunks", f"WITH {_VECTORS} SELECT vec_id AS chunk_id, pdf_name FROM c WHERE subject = '1' ORDER BY vec_id LIMIT 5")
def _(s, d):
    return retrieval.scroll_chunks(_vectors(s, d)[0], retrieval.metadata_filter("1")).select("chunk_id", "pdf_name")


@query(
    "assemble_context",
    "WITH " + _TOP.format(test="true", least="WHERE score >= 0.2") + """, t AS (SELECT query_id, string_agg('[Source ' || rank || ': Class ' || class_level || ' ' || CASE WHEN subject = '0' THEN 'N/A' ELSE subject END || ' - Ch ' || CASE WHEN chapter_number = '0' THEN 'N/A' ELSE chapter_number END || ' (N/A) | Section: ' || coalesce(section, 'General') || ']' || chr(10) || trim(coalesce(content, '')), chr(10) || chr(10) ORDER BY rank) AS x FROM hits GROUP BY 1)
SELECT q.query_id, md5(coalesce(x, '')) AS context_md5 FROM q LEFT JOIN t USING (query_id)""",
)
def _(s, d):
    return retrieval.assemble_context(*_hits(s, d, None, 0.2)).select("query_id", *_md5("context"))


@query("retrieval_summary", "WITH " + _TOP.format(test="subject = '3'", least="WHERE score >= 0.2") + " SELECT q.query_id, count(h.vec_id) AS total, round(coalesce(max(score), 0), 4) AS top_score, round(coalesce(min(score), 0), 4) AS low_score, 'subject=3' AS filters FROM q LEFT JOIN hits h USING (query_id) GROUP BY 1")
def _(s, d):
    queries, hits = _hits(s, d, retrieval.metadata_filter("3"), 0.2)
    out = retrieval.retrieval_summary(queries, hits, {"subject": "3", "class_level": None})
    return out.select("query_id", "total", F.round("top_score", 4).alias("top_score"), F.round("low_score", 4).alias("low_score"), F.array_join(F.transform(F.map_entries("filters"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("filters"))


@query("retrieval_log", "WITH " + _TOP.format(test="subject = '3'", least="WHERE score >= 0.2") + " SELECT q.query_id, '2025-01-01 00:00:00' AS logged_at, 'search' AS caller, any_value(query) AS query, 'subject=3' AS filters, count(h.vec_id)::INT AS total, round(coalesce(max(score), 0), 4) AS top_score, round(coalesce(min(score), 0), 4) AS low_score, coalesce(string_agg(vec_id || ' ' || printf('%.3f', score), ',' ORDER BY rank), '') AS hits FROM q LEFT JOIN hits h USING (query_id) GROUP BY 1")
def _(s, d):
    queries, hits = _hits(s, d, retrieval.metadata_filter("3"), 0.2)
    out = retrieval.retrieval_log(queries, hits, "search", {"subject": "3", "class_level": None}, F.lit("2025-01-01 00:00:00"))
    shown = F.array_join(F.transform("hits", lambda h: F.format_string("%d %.3f", h["chunk_id"], h["score"])), ",")
    return out.withColumns({"hits": shown, "top_score": F.round("top_score", 4), "low_score": F.round("low_score", 4)})


@query("recent_log", "SELECT event_id, used::BIGINT AS used FROM (SELECT event_id, sum(strlen(props)) OVER (ORDER BY ts DESC, event_id DESC) AS used FROM events) WHERE used <= 32768")
def _(s, d):
    return retrieval.recent_log(read_table(s, d, "events"), 32768, "props", "ts", "event_id").select("event_id", "used")


@query(
    "hit_preview",
    f"WITH {_CHUNKS} SELECT doc_id, chunk_id, CASE WHEN length(previous_text) > 200 THEN '...' ELSE '' END || right(replace(previous_text, chr(10), ' '), 200) AS before_preview, left(content, 200) || CASE WHEN length(content) > 200 THEN '...' ELSE '' END AS content_preview FROM chunks",
)
def _(s, d):
    return retrieval.hit_preview(corpus.chunk_documents(md_docs(s, d))).select("doc_id", "chunk_id", "before_preview", "content_preview")
