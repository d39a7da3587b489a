"""DuckDB SQL for the opN_ queries that SQL can express."""

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}

ORACLES["op4_ngram_jaccard_join"] = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) END AS sh
    FROM w
), e AS (
    SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
    FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
    SELECT x, y FROM p WHERE 100 * c >= 90 * (nx + ny - c)
), both_ways AS (
    SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reach AS (
    SELECT doc_id AS id, doc_id AS root FROM s
    UNION
    SELECT b.y, r.root FROM reach r JOIN both_ways b ON b.x = r.id
), c AS (
    SELECT id, min(root) AS root FROM reach GROUP BY id
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.root AS component_id FROM s JOIN c ON c.id = s.doc_id
"""

ORACLES["op3_exact_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
           CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""

ORACLES["op2_benchmark_decontamination"] = r"""
WITH words AS (
    SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents
    UNION ALL
    SELECT 'i', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') FROM benchmark
), items AS (
    SELECT id AS item_id, least(5, len(ws)) AS width, ws FROM words WHERE side = 'i' AND len(ws) > 0
), item_sets AS (
    SELECT DISTINCT item_id, width, unnest(list_transform(range(1, len(ws) - width + 2), lambda i: array_to_string(ws[i:i + width - 1], ' '))) AS g FROM items
), doc_sets AS (
    SELECT DISTINCT id AS doc_id, width, unnest(list_transform(range(1, len(ws) - width + 2), lambda i: array_to_string(ws[i:i + width - 1], ' '))) AS g
    FROM words, (SELECT DISTINCT width FROM items) WHERE side = 'd' AND len(ws) >= width
), n AS (
    SELECT item_id, count(*) AS n_item FROM item_sets GROUP BY 1
)
SELECT item_id, doc_id, CAST(n_item AS INTEGER) AS n_item, count(*) AS n_shared, round(count(*) / n_item, 6) AS containment
FROM item_sets JOIN doc_sets USING (width, g) JOIN n USING (item_id)
GROUP BY item_id, doc_id, n_item HAVING count(*) * 100 >= n_item * 80
"""

ORACLES["op11_hard_negatives"] = """
WITH v AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same,
           CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.q) = len(b.q)
), p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""

#: crc32 by its definition: the table of 256 entries from the reversed polynomial, then a byte at a time.
ORACLES["op12_importance_resampling"] = rf"""
WITH RECURSIVE steps AS (
    SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i)
    UNION ALL
    SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
    SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8
), texts AS (
    SELECT 'd' AS side, doc_id, row_number() OVER () AS row, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
    UNION ALL
    SELECT 'b', NULL, row_number() OVER (), regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), places AS (
    SELECT side, row, unnest(ws) AS w FROM texts
), distinct_words AS (
    SELECT DISTINCT w, hex(encode(w)) AS h FROM places
), hashed AS (
    SELECT w, xor(list_reduce(list_transform(range(1, len(h) + 1, 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
        lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
    FROM distinct_words, crc
), counts AS (
    SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM places JOIN hashed USING (w) GROUP BY bucket
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts
), weights AS (
    SELECT row, count(*) AS n, sum(gain) AS g FROM places JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row
), scored AS (
    SELECT doc_id, row, coalesce(n, 0) AS n_features, CAST(coalesce(floor((g - ((g % n) + n) % n) / n), 0) AS BIGINT) AS weight,
           CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
    FROM texts LEFT JOIN weights USING (row) WHERE side = 'd'
), final AS (
    SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored
), ranks AS (
    SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM final WHERE n_features >= 20 AND doc_id IS NOT NULL
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * total // 100 THEN rank END AS rank FROM final LEFT JOIN ranks USING (row)
"""

ORACLES["op13_line_dedup"] = rf"""
WITH lines AS (
    SELECT doc_id, row, unnest(l) AS line, generate_subscripts(l, 1) AS pos
    FROM (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
    SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), flagged AS (
    SELECT doc_id, row, line, pos, coalesce(doc_id <> top, false) AS gone FROM keyed LEFT JOIN often USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id, row
"""
