"""DuckDB statements for the queries that SQL can express."""

OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)),
w AS (SELECT r, doc_id, i, list_sort(list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'))) AS words FROM l),
c AS (SELECT row_number() OVER (ORDER BY min(struct_pack(doc_id, i))) AS c, words, min(struct_pack(doc_id, i)) AS first FROM w WHERE len(words) > 0 GROUP BY words),
t AS (SELECT c, len(words) AS n, unnest(words) AS word FROM c),
f AS (SELECT word, count(*) AS f FROM t GROUP BY word),
p AS (SELECT c, n, word FROM (SELECT c, n, word, row_number() OVER (PARTITION BY c ORDER BY f, word) AS k FROM t JOIN f USING (word)) WHERE k <= n - (n * 4 + 4) // 5 + 1),
pairs AS (SELECT DISTINCT a.c AS a, b.c AS b FROM p a JOIN p b ON a.word = b.word AND a.c > b.c AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4),
later AS (
    SELECT DISTINCT a FROM pairs JOIN c x ON x.c = a JOIN c y ON y.c = b
    WHERE len(list_intersect(x.words, y.words)) * 9 >= (len(x.words) + len(y.words)) * 4
), gone AS (
    SELECT w.r, w.i FROM w JOIN c ON w.words = c.words LEFT JOIN later ON later.a = c.c
    WHERE later.a IS NOT NULL OR struct_pack(w.doc_id, w.i) <> c.first
), kept AS (
    SELECT l.r, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN gone ON gone.r = l.r AND gone.i = l.i GROUP BY l.r
)
SELECT doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept USING (r) LEFT JOIN (SELECT r, count(*) AS n_removed FROM gone GROUP BY r) USING (r)
"""

OP3 = r"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0),
s AS (
    SELECT q.vec_id AS query_id, q.v AS qv, v.vec_id, CAST(list_sum(list_transform(list_zip(q.v, v.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.v) = len(v.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

OP4 = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS window_words
    FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), runs AS (
    SELECT r, n, i, list_slice(w, i, i + n - 1) AS window_words
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (SELECT r, i, runs.n, item FROM runs JOIN windows USING (n, window_words)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY r),
marks AS (
    SELECT r, i, n, max(i + n) OVER (PARTITION BY r ORDER BY i, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
    FROM (SELECT DISTINCT r, i, n FROM hits)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

OP10 = r"""
WITH s AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 1, 15) AS h
    FROM documents
), t AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s GROUP BY source
), w AS (SELECT *, [3, 1, 2][place % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM t),
l AS (
    SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM w
), g AS (
    SELECT source, source_size,
           CASE WHEN cap / weight > level THEN weight * max(CASE WHEN cap / weight > level THEN level END) OVER () ELSE cap END AS target
    FROM l
), r AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM g
), c AS (
    SELECT s.*, source_size, target, rounds,
           sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
           sum(size) OVER (PARTITION BY s.source, h) AS same
    FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * copies AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies
FROM (SELECT *, rounds + CASE WHEN source_size > 0 AND upto - same / 2.0 <= target - rounds * source_size THEN 1 ELSE 0 END AS copies FROM c)
"""

OP9 = r"""
WITH r AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), c AS (
    SELECT *, length(role || text) + length(regexp_replace(role || text, '[^\\<>"#]', '', 'g')) + length('<turn role="">') + length('</turn>') + 1 AS chars FROM r
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP11 = r"""
WITH tab AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS step
), d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), runs AS (
    SELECT r, array_to_string(list_slice(w, i, i + n - 1), ' ') AS f
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT r, w FROM d UNION ALL SELECT -1, w FROM b), (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)
), counted AS (SELECT r, f, count(*) AS n FROM runs GROUP BY r, f),
bytes AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM counted)),
crcs AS (
    SELECT f, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
        lambda a, y: xor(a >> 8, step[(xor(a, y) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM bytes, tab
), hits AS (SELECT r, bucket, sum(n) AS n FROM counted JOIN crcs USING (f) GROUP BY r, bucket),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (r >= 0), 0) AS s, coalesce(sum(n) FILTER (r < 0), 0) AS t FROM hits GROUP BY bucket),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS BIGINT) AS gain
    FROM sums
), weighed AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM hits JOIN gains USING (bucket) WHERE r >= 0 GROUP BY r),
noise AS (
    SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
    FROM d LEFT JOIN weighed USING (r)
), scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM noise),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features DESC) AS place,
           count(*) FILTER (n_words >= 20) OVER () * 5 // 100 AS drawn
    FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN n_words >= 20 AND place <= drawn THEN CAST(place AS BIGINT) END AS rank
FROM placed
"""

# The exact neighbours: the search may miss some of them, which it does not on the small tables.
OP13 = r"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0),
s AS (
    SELECT q.vec_id AS query_id, q.v AS qv, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, v.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
    FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.v) = len(v.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, qv ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

STATEMENTS = {
    "op1_line_dedup": OP1,
    "op3_topk_search": OP3,
    "op4_benchmark_decontamination": OP4,
    "op9_chat_formatting": OP9,
    "op10_source_mixing": OP10,
    "op11_importance_resampling": OP11,
    "op13_vantage_neighbours": OP13,
}
