"""SQL of the training-data operators' queries that DuckDB runs on the given tables."""

_OP11 = r"""
WITH octets AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS steps
), texts AS (
  SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), cut AS (
  SELECT side, doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), counted AS (
  SELECT side, row, word, count(*) AS n FROM (SELECT side, row, unnest(words) AS word FROM cut) GROUP BY ALL
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::INT + 1, 2))::UBIGINT)), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counted)), octets
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 1), 0)::BIGINT AS t FROM counted JOIN hashed USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000)::DOUBLE) / ((s + 1) * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM sums, (SELECT sum(s) AS s_all, sum(t) AS t_all FROM sums)
), weights AS (
  SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN hashed USING (word) JOIN gain USING (bucket) WHERE side = 0 GROUP BY row
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM cut LEFT JOIN weights USING (row) WHERE side = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, 10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM placed
"""

_OP13 = """
WITH taken AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM taken a JOIN taken r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, n.vec_id AS negative_id, positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
) WHERE rank <= 3
"""

ORACLE = {"op11_resampling": _OP11, "op13_hard_negatives": _OP13}
