"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from tidewise.llm import chat, sharding

_KEY = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT"

OP1 = f"""
WITH sized AS (SELECT doc_id, source, {_KEY} AS h, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
w AS (SELECT *, 3.0::DOUBLE * source_size AS cap, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
f AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT arg_min(rate, cap / weight) FROM f WHERE rate * weight < cap), 1e300)) AS target FROM f),
d AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS mid
    FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
    (size * ((mid <= target)::INT + (mid + source_size <= target)::INT + (mid + 2 * source_size <= target)::INT))::BIGINT AS taken FROM d
"""

OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, {_KEY} AS k FROM documents),
each AS (SELECT d.*, depth, k >> (60 - depth) AS prefix, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_docs
    FROM d, (SELECT range AS depth FROM range(0, 41)) WINDOW w AS (PARTITION BY depth, k >> (60 - depth)))
SELECT doc_id, n_bytes, 's' || right((prefix::BIGINT::BIT)::VARCHAR, depth::INT) AS shard_id, depth::INT AS depth,
    shard_bytes::BIGINT AS shard_bytes, shard_docs, shard_bytes > {sharding.MAX_BYTES} AS oversize
FROM each WHERE shard_bytes <= {sharding.MAX_BYTES} OR shard_docs = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""

OP6 = f"""
WITH c AS (SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS who, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, who, text) - 1) // {chat.MAX_TURNS} AS part FROM c),
s AS (SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who <> 'system'),
p AS (SELECT DISTINCT s.conv_id, part, speaker FROM s JOIN t ON s.conv_id IS NOT DISTINCT FROM t.conv_id),
r AS (SELECT p.conv_id, p.part, speaker, turn, who, t.text, speaker = who AS own,
    CASE WHEN speaker = who THEN '<|assistant|>' || chr(10) WHEN who = 'system' THEN '<|system|>' || chr(10) ELSE '<|user name=' || who || '|>' || chr(10) END AS head
    FROM p JOIN t ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.part = t.part),
o AS (SELECT *, row_number() OVER w AS n, coalesce(sum(length(head) + length(text) + 8) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto, upto + length(head) AS pos
    FROM r WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, who, text))
SELECT conv_id, part::BIGINT AS part, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_own, min(upto)::BIGINT AS begin, string_agg(head || text || '{chat.END}' || chr(10), '' ORDER BY n) AS rendered,
    coalesce(string_agg(pos::BIGINT || ':' || (pos + length(text) + 7)::BIGINT, ',' ORDER BY n) FILTER (own), '') AS mask
FROM o GROUP BY 1, 2, 3
"""

OP8 = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP10 = """
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(lower_az, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
    FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
bw AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, list_slice(w, i, i + least(10, len(w)) - 1) AS words FROM bw, (SELECT unnest(range(1, (SELECT coalesce(max(len(w)), 0) + 1 FROM bw))) AS i) WHERE len(w) > 0 AND i <= len(w) - least(10, len(w)) + 1),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM dw),
hits AS (SELECT doc_id, p, win.k, item_id FROM (SELECT doc_id, p, ks.k, list_slice(w, p, p + ks.k - 1) AS words FROM pos, (SELECT DISTINCT k FROM win) ks WHERE p + ks.k - 1 <= len(w)) x JOIN win ON x.k = win.k AND x.words = win.words),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n ON n.doc_id = dw.doc_id LEFT JOIN items ON items.doc_id = dw.doc_id
"""

_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP11 = f"""
WITH dt AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, t, len(t)::BIGINT AS n FROM dt WHERE len(t) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM d),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, d.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * docs) // words)))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d ON tf.r = d.r, total GROUP BY 1, 2, 3),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1, "op3_sharding": OP3, "op6_chat": OP6, "op8_exact_dedup": OP8, "op10_decontaminate": OP10, "op11_lexical_search": OP11}
