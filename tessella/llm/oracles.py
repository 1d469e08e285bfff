"""DuckDB SQL with the same results as the queries of this subpackage, where SQL can express them."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 by its generator polynomial, one byte at a time; the 256-entry table comes from the rule.
OP3 = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
      lambda c, z : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256))::UBIGINT AS b))),
texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
bytes AS (
  SELECT text, [4294967295::UBIGINT] || list_transform(range(strlen(text)),
      lambda i : ('0x' || substr(h, (2 * i + 1)::INT, 2))::UBIGINT) AS bs
  FROM (SELECT text, hex(encode(text)) AS h FROM texts)),
crcs AS (
  SELECT text, xor(list_reduce(bs, lambda c, b : xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS crc
  FROM bytes, crc_table),
base AS (
  SELECT d.doc_id, strlen(coalesce(d.text, '')) + 1 AS size, c.crc, coalesce('=' || d.source, 'null') AS stratum,
         md5('7:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || c.crc) AS k
  FROM documents d JOIN crcs c ON c.text = coalesce(d.text, '')),
ranked AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY stratum ORDER BY k, doc_id, crc, size) - 1) + 1)::DOUBLE
            / (2 * count(*) OVER (PARTITION BY stratum))::DOUBLE AS f FROM base),
placed AS (SELECT *, row_number() OVER (ORDER BY f, k, doc_id, crc, size) - 1 AS p, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, ((p * 8) // n)::INT AS shard,
       (p - ((p * 8) // n * n + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard, stratum
FROM placed
"""

OP4 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i : array_to_string(w[i:i+3], ' '))
                               ELSE [array_to_string(w, ' ')] END) AS s
    FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, t.y FROM reach r JOIN sides t ON t.x = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN comp c USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i+l-1], ' ') AS g FROM (
    SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
placed AS (
  SELECT doc_id, l, i, array_to_string(w[i:i+l-1], ' ') AS g FROM (
    SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM wins) WHERE len(w) >= l)),
hits AS (SELECT doc_id, i, l, item_id FROM placed JOIN wins USING (l, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM hits) GROUP BY 1),
placings AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
counts AS (SELECT word, count(*) AS n FROM placings GROUP BY 1),
need AS (SELECT DISTINCT l, g, ceil(0.8 * l) AS need FROM wins),
terms AS (SELECT l, g, need, unnest(string_split(g, ' ')) AS word, unnest(range(l)) AS off FROM need),
anchors AS (SELECT g, off, word FROM terms JOIN counts USING (word) QUALIFY row_number() OVER (PARTITION BY g ORDER BY n, off) <= l - need + 1),
starts AS (SELECT DISTINCT doc_id, g, p - off AS s FROM anchors JOIN placings USING (word)),
close AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT s.doc_id, s.g, s.s FROM starts s JOIN terms t ON t.g = s.g JOIN placings a ON a.doc_id = s.doc_id AND a.word = t.word AND a.p BETWEEN s.s + t.off - 2 AND s.s + t.off + 2
    GROUP BY 1, 2, 3, t.need HAVING count(DISTINCT t.off) >= t.need)),
nearby AS (SELECT doc_id, count(DISTINCT item_id::VARCHAR) AS n FROM close JOIN wins USING (g) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated,
       coalesce(nearby.n, 0)::BIGINT AS n_near
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN nearby USING (doc_id)
"""

OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x : floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INT AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

OP11 = r"""
WITH p AS (
  SELECT page_id, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS url, coalesce(html, '') AS payload, (((coalesce(page_id, 0) % 3155760000) + 3155760000) % 3155760000)::BIGINT AS s FROM pages),
d AS (
  SELECT page_id, url, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS h,
         strftime(TIMESTAMP '2024-01-01' + to_seconds(s), '%Y-%m-%dT%H:%M:%SZ') AS captured_at,
         regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '^[a-z][a-z0-9+.-]*://([^/?@]*@)?', '') AS bare FROM p),
k AS (
  SELECT *, array_to_string(list_transform(range(0, 8), lambda i : array_to_string(list_transform([15, 10, 5, 0],
           lambda b : substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * i + 1)::INT, 5))::INT >> b) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
         regexp_replace(regexp_extract(bare, '^[^/?]*'), '^www[0-9]*[.]|:(80|443)$', '', 'g') AS host, regexp_replace(bare, '^[^/?]*', '') AS rest FROM d),
u AS (SELECT *, CASE WHEN bare = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END END AS url_key FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id, url) AS nth, first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id, url) AS first_id FROM u)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN first_id END AS refers_to,
       url_key, captured_at, row_number() OVER (ORDER BY url_key, captured_at, page_id) - 1 AS slot, row_number() OVER (PARTITION BY url_key ORDER BY captured_at, page_id) - 1 AS capture, true AS intact
FROM f
"""


def _product_codes(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd rounds written out one by one; all sums of whole numbers are exact in DOUBLE."""
    near = """a{r} AS MATERIALIZED (SELECT vec_id, k, x, min([xx + cc - 2 * list_inner_product(x, c), e]) AS m FROM p JOIN c{r} USING (k) GROUP BY ALL)"""
    mean = ", ".join(f"floor(sum(x[{j + 1}]) / count(*))" for j in range(width))
    step = f"""n{{r}} AS (SELECT k, m[2] AS e, [{mean}] AS c FROM a{{r}} GROUP BY 1, 2),
c{{s}} AS MATERIALIZED (SELECT k, e, c, list_inner_product(c, c) AS cc FROM (SELECT k, e, coalesce(n{{r}}.c, c{{r}}.c) AS c FROM c{{r}} LEFT JOIN n{{r}} USING (k, e)))"""
    each = ",\n".join(f"{near.format(r=r)},\n{step.format(r=r, s=r + 1)}" for r in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x : floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, k, x, list_inner_product(x, x) AS xx FROM (SELECT vec_id, k, v[k * {width} + 1 : k * {width} + {width}] AS x FROM v, range({parts}) r(k))),
c0 AS MATERIALIZED (
  SELECT k, (row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1)::DOUBLE AS e, x AS c, xx AS cc FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries})),
{each},
{near.format(r=rounds)},
coded AS (SELECT vec_id, string_agg(printf('%02x', m[2]::INT), '' ORDER BY k) AS code, sum(m[1])::BIGINT AS error FROM a{rounds} GROUP BY 1),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x : x::BIGINT), ','), ',' ORDER BY k, e)) AS h FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded JOIN v USING (vec_id), book
"""


SQL = {"op11_capture_history": OP11, "op13_vector_codes": _product_codes(), "op9_exact_top_k": OP9, "op10_decontaminate": OP10, "op3_interleave": OP3, "op4_near_duplicates": OP4}
