"""SQL of the numbered operators that SQL can express, by plain definitions over whole tables.

Whole numbers that may be NULL are doubles here, the form they take in a frame of the query's rows.
"""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_UPPER.lower()}')"


def _reachable(links: str, nodes: str) -> str:
    """Tables ``reach(a, root)`` over ``links(a, b)``, given both ways: the smallest node reachable."""
    return f"""reach(a, b) AS (
  SELECT a, b FROM {links} UNION SELECT reach.a, {links}.b FROM reach JOIN {links} ON reach.b = {links}.a),
roots AS (
  SELECT n AS a, LEAST(n, COALESCE(MIN(b), n)) AS root FROM {nodes} LEFT JOIN reach ON reach.a = n GROUP BY n)"""


_BUCKETS = 8


def _bucket_step(k: int) -> str:
    """The least padding of the j shortest lengths in k buckets, and where the last one starts."""
    return f"""least{k} AS MATERIALIZED (
  SELECT j, best.cost AS cost, best.i AS i FROM (
    SELECT q.j, MIN({{'cost': p.cost + q.x * (q.upto - s.upto) - (q.mass - s.mass), 'i': p.j}}) AS best
    FROM least{k - 1} p JOIN sums s ON s.j = p.j JOIN sums q ON q.j > p.j GROUP BY q.j))"""


OP1 = (
    """WITH lengths AS (
  SELECT doc_id, len(list_filter(regexp_split_to_array(COALESCE(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS words
  FROM documents),
pieces AS MATERIALIZED (
  SELECT doc_id, piece, LEAST(2048, words - piece * 2048) AS n_words
  FROM lengths, unnest(range(0, GREATEST(1, (words + 2047) // 2048))) AS t(piece)),
histogram AS (SELECT n_words AS x, COUNT(*) AS c FROM pieces GROUP BY n_words),
sums AS MATERIALIZED (
  SELECT 0::BIGINT AS j, 0::BIGINT AS x, 0::HUGEINT AS upto, 0::HUGEINT AS mass
  UNION ALL SELECT row_number() OVER (ORDER BY x), x, SUM(c) OVER (ORDER BY x), SUM(c * x) OVER (ORDER BY x) FROM histogram),
least0 AS (SELECT 0::BIGINT AS j, 0::HUGEINT AS cost),
"""
    + ",\n".join(_bucket_step(k) for k in range(1, _BUCKETS + 1))
    + f""",
end{_BUCKETS} AS (SELECT MAX(j) AS j FROM sums),
"""
    + ",\n".join(
        f"end{k - 1} AS (SELECT i AS j FROM least{k} WHERE j = (SELECT j FROM end{k}))" for k in range(_BUCKETS, 1, -1)
    )
    + """,
ends AS MATERIALIZED (SELECT x FROM sums WHERE j IN ("""
    + " UNION ALL ".join(f"SELECT j FROM end{k}" for k in range(1, _BUCKETS + 1))
    + """)),
placed AS (
  SELECT doc_id, piece, n_words, (SELECT MIN(x) FROM ends WHERE x >= n_words) AS bucket_length FROM pieces)
SELECT doc_id, piece, n_words, bucket_length,
       (row_number() OVER (PARTITION BY bucket_length ORDER BY md5(concat(COALESCE(doc_id::VARCHAR, 'null'), '#', piece)),
          doc_id NULLS FIRST, piece, n_words) - 1) // GREATEST(1, 16384 // GREATEST(1, bucket_length)) AS batch
FROM placed"""
)

# Words of items and documents; every run of as many words as some window has is looked up.
OP2 = f"""WITH item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array({_lower('text')}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'),
         lambda w: w <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id::VARCHAR AS item, array_to_string(w[s:s + 12], ' ') AS win, len(w[s:s + 12]) AS size
  FROM item_words, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(s) WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_lower("COALESCE(text, '')")},
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
places AS (
  SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS win
  FROM doc_words, (SELECT DISTINCT size FROM windows), unnest(range(1, len(w) - size + 2)) AS t(s)),
hits AS (SELECT doc_id, s, places.size, item FROM places JOIN windows USING (win)),
covered AS (
  SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (
    SELECT doc_id, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT doc_id, s, size FROM hits)) GROUP BY doc_id),
named AS (
  SELECT doc_id, COUNT(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
       COALESCE(items_sha256, sha256('')) AS items_sha256,
       COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM doc_words d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id"""

OP3 = f"""WITH rules(rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parsed AS (
  SELECT page_id, {_lower("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM (SELECT page_id, CASE WHEN strpos(COALESCE(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3)
        ELSE '' END AS rest FROM pages)),
fits AS (
  SELECT page_id, arg_max(verdict, length(rule_host || rule_path)) AS verdict,
         arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule
  FROM parsed JOIN rules ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT p.page_id, host, path, rule, COALESCE(verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fits ON fits.page_id = p.page_id"""

# Sets that are alike share one of their rarest words; the rest is plain counting.
OP4 = """WITH lines AS MATERIALIZED (
  SELECT doc_id, i - 1 AS line_no, list_sort(list_distinct(list_filter(
           string_split(replace(replace(lower(parts[i]), chr(9), ' '), chr(13), ' '), ' '), lambda w: w <> ''))) AS words
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
       unnest(range(1, len(parts) + 1)) AS t(i)),
sets AS MATERIALIZED (
  SELECT row_number() OVER () AS id, words, n, first FROM (
    SELECT words, len(words) AS n, MIN({'d': doc_id, 'l': line_no}) AS first FROM lines WHERE len(words) > 0 GROUP BY words)),
held AS MATERIALIZED (SELECT id, n, unnest(words) AS word FROM sets),
ranked AS (
  SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY times, word) AS place
  FROM held JOIN (SELECT word, COUNT(*) AS times FROM held GROUP BY word) USING (word)),
rare AS MATERIALIZED (SELECT id, n, word FROM ranked WHERE place <= n - (4 * n + 4) // 5 + 1),
alike AS MATERIALIZED (
  SELECT p.id AS a, q.id AS b FROM (
    SELECT DISTINCT p.id AS i, q.id AS j FROM rare p JOIN rare q ON p.word = q.word AND p.id <> q.id
    WHERE 5 * LEAST(p.n, q.n) >= 4 * GREATEST(p.n, q.n)) JOIN sets p ON p.id = i JOIN sets q ON q.id = j
  WHERE 9 * len(list_intersect(p.words, q.words)) >= 4 * (p.n + q.n)
  UNION ALL SELECT id, id FROM sets),
earliest AS (SELECT p.words, MIN(q.first) AS first FROM alike JOIN sets p ON p.id = a JOIN sets q ON q.id = b GROUP BY p.words),
gone AS (
  SELECT doc_id, COUNT(*) AS n_removed, sha256(string_agg(line_no::VARCHAR, ',' ORDER BY line_no)) AS removed_sha256
  FROM lines JOIN earliest USING (words) WHERE {'d': doc_id, 'l': line_no} > first GROUP BY doc_id)
SELECT d.doc_id, COALESCE(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, COALESCE(n_removed, 0) AS n_removed,
       COALESCE(removed_sha256, sha256('')) AS removed_sha256
FROM documents d LEFT JOIN gone ON gone.doc_id = d.doc_id"""

OP6 = """WITH bodies AS (
  SELECT page_id, COALESCE(html, '') AS body, strlen(COALESCE(html, '')) AS payload_bytes FROM pages),
originals AS (SELECT body, MAX(page_id) AS original FROM bodies WHERE payload_bytes >= 1000 GROUP BY body)
SELECT page_id, payload_bytes, sha1(b.body) AS payload_digest,
       CASE WHEN original > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original > page_id THEN original END::DOUBLE AS refers_to, TRUE AS complete
FROM bodies b LEFT JOIN originals o ON o.body = b.body"""

OP9 = f"""WITH RECURSIVE good AS MATERIALIZED (
  SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links(a, b) AS MATERIALIZED (
  SELECT p.vec_id, q.vec_id FROM good p JOIN good q ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
  WHERE list_dot_product(p.v, q.v) / (p.norm * q.norm) >= 0.9),
nodes AS (SELECT vec_id AS n FROM embeddings),
{_reachable('links', 'nodes')}
SELECT n AS vec_id, (SELECT COUNT(*) FROM links WHERE links.a = n) AS n_links, root AS component_id, n = root AS kept
FROM nodes JOIN roots ON roots.a = n"""

# Two sets' common shingles are counted through the shingles; sets are compared by distinct text.
OP10 = f"""WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_lower("COALESCE(text, '')")}, '[\\x20\\x09-\\x0D]+'),
         lambda w: w <> '') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[s:s + 4], ' ')) AS x
  FROM words, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS t(s) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT p.doc_id AS a, q.doc_id AS b, COUNT(*) AS shared
  FROM shingles p JOIN shingles q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY p.doc_id, q.doc_id),
links(a, b) AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes na ON na.doc_id = a JOIN sizes nb ON nb.doc_id = b
  WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
nodes AS (SELECT doc_id AS n FROM documents),
{_reachable('links', 'nodes')}
SELECT nodes.n AS doc_id, COALESCE(sizes.n, 0) AS n_shingles, root AS component_id
FROM nodes JOIN roots ON roots.a = nodes.n LEFT JOIN sizes ON sizes.doc_id = nodes.n"""

# crc32 by its table of 256 entries, made from the polynomial; near words share what one edit leaves.
OP12 = f"""WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8),
         lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS MATERIALIZED (
  SELECT doc_id, run, COUNT(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all({_lower('text')}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run),
hexed AS (SELECT doc_id, run, k, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM runs),
summed AS MATERIALIZED (
  SELECT run, k, xor(4294967295, list_reduce([4294967295] || list_transform(range(0, length(x), 2),
           lambda i: (strpos('0123456789ABCDEF', substr(x, i + 1, 1)) - 1) * 16
                     + strpos('0123456789ABCDEF', substr(x, i + 2, 1)) - 1),
         lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8))) AS h
  FROM hexed, crc_table),
vocabulary AS MATERIALIZED (
  SELECT word, SUM(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
           ELSE run END AS word, k FROM summed)
  WHERE length(word) >= 6 GROUP BY word HAVING SUM(k) >= 5),
without AS MATERIALIZED (
  SELECT word, n, i, left(word, i) AS before, substr(word, i + 2) AS behind
  FROM vocabulary, unnest(range(0, length(word))) AS t(i)),
near AS MATERIALIZED (
  SELECT p.word, q.word AS other, q.n AS m FROM without p JOIN without q
    ON p.i = q.i AND p.before = q.before AND p.behind = q.behind AND p.word <> q.word
  UNION SELECT p.word, v.word, v.n FROM without p JOIN vocabulary v ON v.word = p.before || p.behind
  UNION SELECT v.word, p.word, p.n FROM without p JOIN vocabulary v ON v.word = p.before || p.behind),
best AS (
  SELECT word, COUNT(*) AS n_near, MAX(m) AS m FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT v.word, v.n, COALESCE(n_near, 0) AS n_near, CASE WHEN best.m >= 5 * v.n THEN best.m END AS form_n,
         CASE WHEN best.m >= 5 * v.n THEN (SELECT MIN(encode(other)) FROM near WHERE near.word = v.word AND near.m = best.m) END AS form
  FROM vocabulary v LEFT JOIN best ON best.word = v.word),
chain(word, here, step) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL SELECT chain.word, decode(form), step + 1 FROM chain JOIN forms ON forms.word = chain.here WHERE form IS NOT NULL)
SELECT f.word, decode(form) AS form, (SELECT arg_max(here, step) FROM chain WHERE chain.word = f.word) AS root, n, n_near, form_n::DOUBLE AS form_n
FROM forms f"""

ORACLE: dict[str, str] = {
    "op1_packing": OP1,
    "op2_decontamination": OP2,
    "op3_url_filters": OP3,
    "op4_line_dedup": OP4,
    "op6_warc": OP6,
    "op9_embedding_dedup": OP9,
    "op10_ngram_join": OP10,
    "op12_spelling": OP12,
}
