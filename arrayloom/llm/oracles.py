"""DuckDB SQL of the text queries that SQL can express."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY source),
shares AS (
  SELECT source, n_rows, greatest(1, round(pow(n_rows::DOUBLE, 0.5) / (SELECT sum(pow(n_rows::DOUBLE, 0.5)) FROM sizes) * 1024))::BIGINT AS quota FROM sizes),
lists AS (
  SELECT list(source ORDER BY source) AS names, list(quota ORDER BY source) AS q, list(n_rows ORDER BY source) AS n, sum(quota)::BIGINT AS frame FROM shares),
picks AS (
  SELECT 0::BIGINT AS slot, list_transform(q, lambda a: 0::BIGINT) AS c,
         (SELECT 1::BIGINT) AS ready, names, q, n, frame,
         list_transform(q, lambda a, i: CASE WHEN TRUE THEN (frame + a - 1) // a END * 100000 + i) AS due
  FROM lists
  UNION ALL
  SELECT slot + 1, c2, 1::BIGINT, names, q, n, frame,
         list_transform(q, lambda a, i: CASE WHEN (c2[i] * frame) // a <= slot + 1 THEN ((c2[i] + 1) * frame + a - 1) // a * 100000 + i ELSE 4000000000000000000 END)
  FROM (SELECT *, list_transform(c, lambda x, i: x + CASE WHEN i = list_position(due, list_min(due)) THEN 1 ELSE 0 END) AS c2 FROM picks)
  WHERE slot + 1 < frame),
frame AS (
  SELECT slot, list_position(due, list_min(due)) AS i, c, names, q, n, frame FROM picks),
slots AS (SELECT slot, names[i] AS source, c[i] AS j, q[i] AS quota, c, q, n, frame FROM frame),
placed AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || ':mix'), doc_id) - 1 AS at FROM documents),
blocks AS (SELECT p.doc_id, p.source, p.at, p.at // 32 AS block_no, s.quota FROM placed p JOIN shares s ON p.source IS NOT DISTINCT FROM s.source)
SELECT b.doc_id, b.source, b.quota, f.frame, b.block_no::BIGINT AS block_no,
       ((b.block_no * f.frame) // b.quota)::BIGINT AS release,
       (((b.block_no + 1) * f.frame + b.quota - 1) // b.quota)::BIGINT AS deadline,
       ((b.block_no // b.quota) * f.frame + f.slot)::BIGINT AS slot,
       (list_sum(list_transform(f.q, lambda a, i: least(f.n[i], ((b.block_no // b.quota) * a + f.c[i]) * 32))) + b.at % 32)::BIGINT AS position
FROM blocks b JOIN slots f ON b.source IS NOT DISTINCT FROM f.source AND b.block_no % b.quota = f.j
"""

OP6 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM t JOIN g USING (text)
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM win),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM dup, (SELECT unnest(range(0, 8)) AS o) GROUP BY doc_id),
m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d) d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS bad FROM f GROUP BY source),
mv AS (SELECT avg(bad / n) AS m, var_samp(bad / n) AS v FROM h),
p AS (SELECT m, CASE WHEN v > 0 AND m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1 ELSE 100.0 END AS k FROM mv),
r AS (SELECT source, (bad + m * k) / (n + k) AS host_rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_rate <= 0.5 AS kept, round(host_rate, 6) AS host_rate
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""

OP3 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '<(\\*)\|', '<\\\1|', 'g')) + 1
           + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
d AS (SELECT p.*, first, sha1(p.h) AS hex FROM p JOIN g USING (h)),
v AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(hex, (1 + 5 * k)::INT, 5))::BIGINT) AS q FROM d)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q[k // 4 + 1] >> (15 - 5 * (k % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       TRUE AS digest_ok
FROM v
"""

OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
f AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS e
  FROM d),
g AS (
  SELECT f.doc_id, part, [a, b, c, d, e] AS fails, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic
  FROM f LEFT JOIN (SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id) l ON f.doc_id = l.doc_id),
one AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM one a, one b, one c, one d, one e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
met AS (
  SELECT part, o, s.i AS step, fails[o[s.i]] AS now, list_bool_or([fails[o[k]] FOR k IN range(1, s.i)]) AS before,
         list_sum([k::INT FOR k IN fails]) AS n_fails, good, toxic
  FROM g, orders, one s),
sums AS (
  SELECT part, o, step,
         count(*) FILTER (NOT now AND NOT coalesce(before, FALSE)) AS kept, count(*) FILTER (now AND NOT coalesce(before, FALSE)) AS removed,
         count(*) FILTER (now AND before) AS redundant, count(*) FILTER (now AND n_fails = 1) AS unique_fails,
         count(*) FILTER (now AND NOT coalesce(before, FALSE) AND good) AS good_lost, count(*) FILTER (now AND NOT coalesce(before, FALSE) AND toxic) AS toxic_lost
  FROM met GROUP BY part, o, step)
SELECT part, array_to_string([substr('ABCDE', k::INT, 1) FOR k IN o], '') AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley
FROM sums
"""

# Six rounds, each a pair of common table expressions: who is nearest to what, and the entries' new means.
OP13 = """
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT r, (i - 1) // w AS part, (i - 1) % w AS pos, floor(4096 * v::DOUBLE)::BIGINT AS x
  FROM (SELECT r, len(embedding) // 8 AS w, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM k)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x AS c FROM x WHERE r <= 16)
""" + "".join(
    f""", a{i} AS MATERIALIZED (
  SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT r, part, entry, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{i} USING (part, pos) GROUP BY r, part, entry) GROUP BY r, part)"""
    + (
        f""", c{i + 1} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(m, c) AS c
  FROM c{i} LEFT JOIN (
    SELECT part, entry, pos, ((s - ((s % n) + n) % n) // n)::BIGINT AS m
    FROM (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM x JOIN a{i} USING (r, part) GROUP BY part, entry, pos)) USING (part, entry, pos))"""
        if i < 6
        else ""
    )
    for i in range(7)
) + """
, v AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c6) AS codebooks_sha256
FROM v JOIN k USING (r)
"""

ORACLES = {"op12_filter_audit": OP12, "op13_vector_codes": OP13, "op2_mix": OP2, "op3_chat_format": OP3, "op4_warc": OP4, "op6_exact_dedup": OP6, "op7_quality_rules": OP7}
