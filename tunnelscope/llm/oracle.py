"""SQL for the queries of this package that SQL can express."""

OP1 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
  FROM d GROUP BY source),
w AS (SELECT *, CASE turn WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM s),
-- The level at which the sources hold the whole share, found between the levels at which sources are full.
l AS (
  SELECT DISTINCT cap / weight AS x FROM w),
f AS (
  SELECT l.x, sum(least(w.cap, l.x * w.weight)) AS held FROM l, w GROUP BY l.x),
g AS (SELECT 1.5 * sum(source_size) AS share FROM w),
b AS (SELECT coalesce((SELECT max(x) FROM f, g WHERE held <= share), 0) AS x),
lv AS (
  SELECT ((SELECT share FROM g) - coalesce(sum(CASE WHEN cap / weight <= b.x THEN cap END), 0))
         / nullif(sum(CASE WHEN cap / weight <= b.x THEN 0 ELSE weight END), 0) AS x
  FROM w, b),
t AS (
  SELECT w.source, w.source_size, CASE WHEN w.cap / w.weight <= b.x OR lv.x IS NULL THEN CAST(w.cap AS DOUBLE) ELSE lv.x * w.weight END AS target
  FROM w, b, lv),
p AS (
  SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d),
q AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, p.source, p.before, CAST(round(t.target) AS BIGINT) AS budget,
         CASE WHEN t.source_size > 0 THEN CAST(floor(round(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken,
       source, epochs, CAST(greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS partial
FROM q
"""


OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

# A turn is "### role: text</turn>" and a newline: 14 characters beside role and text, and one per escape.
OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + length(text) + length(text) - length(replace(text, '\', ''))
      + len(regexp_extract_all(text, '### |</turn>'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


OP11 = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.t) AS text_sha256 FROM t JOIN g USING (t)
"""


def oracle() -> dict[str, str]:
    return {"op1_mixing": OP1, "op6_topk": OP6, "op7_chat": OP7, "op11_exact_dedup": OP11}
