"""Queries of the operators in this package, and their SQL where it can express them."""

from __future__ import annotations

from quernel.llm import chat, decontamination, embeddings, importance, jaccard, lines, mixing, periods, repeats, secrets, sharding, tokens, toxicity

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_embeddings": embeddings.op2_embeddings,
    "op3_tokens": tokens.op3_tokens,
    "op4_secrets": secrets.op4_secrets,
    "op5_repeats": repeats.op5_repeats,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_shard": sharding.op7_shard,
    "op8_decontaminate": decontamination.op8_decontaminate,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_chat": chat.op10_chat,
    "op11_periods": periods.op11_periods,
    "op12_lines": lines.op12_lines,
    "op13_importance": importance.op13_importance,
}

#: CRC-32 of bytes in SQL: ``crc`` is its table of 256 numbers; CRC folds a text's bytes.
CRC_TABLE = """step(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8)"""
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"

#: DuckDB SQL over the whole tables.
SQL = {
    "op1_mix": r"""
WITH keyed AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('1|' || coalesce(doc_id::VARCHAR, '\N') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM keyed GROUP BY source),
weighed AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap FROM named),
filled AS (
  SELECT *, (SELECT sum(source_size) FROM named) AS all_sizes,
         coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM weighed),
levelled AS (SELECT *, max((1.5::DOUBLE * all_sizes::DOUBLE - cap_before::DOUBLE) / weight_left::DOUBLE) OVER () AS level FROM filled),
targets AS (SELECT source, source_size, least(cap::DOUBLE, weight * level) AS target FROM levelled),
placed AS (
  SELECT k.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM cut""",
    "op10_chat": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, lag(role, 1, 'start') OVER w AS prev, lead(role) OVER w AS next,
         length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + 15 AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text))
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       (count(*) FILTER (NOT ((role = 'system' AND prev = 'start') OR (role = 'user' AND prev IN ('start', 'system', 'assistant')) OR (role = 'assistant' AND prev = 'user')))
        + count(*) FILTER (next IS NULL AND role <> 'assistant'))::BIGINT AS n_errors
FROM marked GROUP BY conv_id""",
    "op4_secrets": r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
patterns(kind, rank, re, grp, least) AS (VALUES
  ('assign', 0, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 20), ('hex', 2, '[0-9a-f]+', 0, 24), ('entropy', 3, '[A-Za-z0-9+/_=-]{20,}', 0, 20)),
parts AS (
  SELECT doc_id, 'assign' AS kind, 0 AS rank, 6 AS least, regexp_extract_all(text, (SELECT re FROM patterns WHERE rank = 0)) AS found,
         regexp_extract_all(text, (SELECT re FROM patterns WHERE rank = 0), 2) AS vals, string_split_regex(text, (SELECT re FROM patterns WHERE rank = 0)) AS gaps FROM texts
  UNION ALL SELECT doc_id, 'access', 1, 20, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM texts
  UNION ALL SELECT doc_id, 'hex', 2, 24, regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), string_split_regex(text, '[0-9a-f]+') FROM texts
  UNION ALL SELECT doc_id, 'entropy', 3, 20, regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}'), string_split_regex(text, '[A-Za-z0-9+/_=-]{20,}') FROM texts),
each AS (
  SELECT doc_id, kind, rank, least, unnest(found) AS s, unnest(vals) AS v, unnest(gaps[1:len(found)]) AS gap, unnest(range(len(found))) AS i FROM parts WHERE len(found) > 0),
placed AS (
  SELECT *, sum(length(gap) + length(s)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM each),
parted AS (
  SELECT doc_id, stop - length(s) AS start, stop, unnest(string_split_regex(s, '(?i)example|placeholder|changeme|your[_-]?(?:api[_-]?)?key|dummy|xxxx+|abcdefghijklm|0123456789abcdef')) AS s FROM placed WHERE rank = 3),
candidates AS (
  SELECT doc_id, s, start, stop, row_number() OVER () AS part, CASE WHEN regexp_matches(s, '^[0-9a-fA-F]+$') THEN 3.2 ELSE 3.8 END AS bits
  FROM parted WHERE length(s) >= 20 AND NOT regexp_matches(s, '^[0-9]+$') AND NOT regexp_matches(s, '^[A-Za-z/_=+-]+$')
    AND NOT regexp_matches(s, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')),
windows AS (SELECT doc_id, start, stop, part, bits, w, unnest(string_split(substr(s, w, 20), '')) AS c FROM (SELECT *, unnest(range(1, length(s) - 18)) AS w FROM candidates)),
counts AS (SELECT doc_id, start, stop, part, bits, w, c, count(*) AS n FROM windows GROUP BY ALL),
entropies AS (SELECT doc_id, start, stop, part, bits, w, sum(-n / 20.0 * log2(n / 20.0)) AS h FROM counts GROUP BY ALL),
spans AS (
  SELECT doc_id, kind, rank, stop - length(s) AS start, stop FROM placed WHERE rank < 3 AND length(v) >= least
  UNION ALL SELECT DISTINCT doc_id, 'entropy', 3, start, stop FROM entropies WHERE h >= bits - 1e-9),
marks AS (SELECT *, kind || ':' || start || ':' || stop AS mark FROM spans)
SELECT t.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (rank = 3) AS n_entropy,
       sha256(coalesce(string_agg(mark, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(mark, ',' ORDER BY start, rank) FILTER (rank IS NOT NULL), '') AS spans
FROM texts t LEFT JOIN marks m ON t.doc_id = m.doc_id GROUP BY t.doc_id""",
    "op8_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
items AS (SELECT item_id, least(len(w), 16) AS win, CASE WHEN len(w) < 8 THEN len(w) ELSE ceil(0.8 * least(len(w), 16) - 1e-9) END AS need, unnest(w) AS word, unnest(range(len(w))) AS item_at FROM b),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS doc_at FROM d),
same AS (SELECT doc_id, item_id, doc_at - item_at AS start, item_at, win, need FROM places JOIN items USING (word)),
often AS (SELECT doc_id, item_id, start FROM same GROUP BY ALL HAVING count(*) >= min(need)),
windows AS (
  SELECT doc_id, item_id, start, win, need,
         count(*) OVER (PARTITION BY doc_id, item_id, start ORDER BY item_at RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS hits
  FROM same JOIN often USING (doc_id, item_id, start)),
best AS (SELECT doc_id, item_id, start, max(hits) AS best FROM windows GROUP BY doc_id, item_id, start, need HAVING max(hits) >= need)
SELECT doc_id, item_id, max(best)::BIGINT AS best, count(*) AS n_places FROM best GROUP BY doc_id, item_id""",
    "op11_periods": rf"""
WITH RECURSIVE {CRC_TABLE},
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
hashed AS (SELECT r, doc_id, w, len(w) AS n, {CRC.format("doc_id::VARCHAR")} AS h FROM docs, crc),
tails AS (SELECT r, doc_id, w, n, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, 3 + (h // 10) % 8 AS d FROM hashed),
given AS (SELECT r, unnest(w) AS word, unnest(range(n)) AS i FROM tails),
places AS (SELECT r, i, CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // d) END AS source FROM given JOIN tails USING (r)),
words AS MATERIALIZED (SELECT p.r, p.i, g.word FROM places p JOIN given g ON p.r = g.r AND p.source = g.i),
sizes AS (SELECT r, n FROM tails),
periods AS (SELECT r, n, unnest(range(1, n // 4 + 1)) AS q FROM sizes),
grid AS (SELECT r, q, unnest(range(0, (n - 1) // q - 2)) * q AS at FROM periods),
one AS MATERIALIZED (SELECT g.r, g.q, g.at, word FROM grid g JOIN words a ON a.r = g.r AND a.i = g.at),
two AS MATERIALIZED (SELECT t.* FROM one t JOIN words b ON b.r = t.r AND b.i = t.at + t.q AND b.word = t.word),
three AS MATERIALIZED (SELECT t.* FROM two t JOIN words b ON b.r = t.r AND b.i = t.at + 2 * t.q AND b.word = t.word),
four AS MATERIALIZED (SELECT DISTINCT t.r, t.q FROM three t JOIN words b ON b.r = t.r AND b.i = t.at + 3 * t.q AND b.word = t.word),
every AS MATERIALIZED (SELECT f.r, f.q, i, word FROM four f JOIN words USING (r)),
equal AS (SELECT e.r, e.q, e.i FROM every e JOIN words b ON b.r = e.r AND b.i = e.i + e.q AND b.word = e.word),
island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM equal),
stretch AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretch GROUP BY r, start, length),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) = 1),
said AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS s FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(said.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (r) LEFT JOIN said USING (r) LEFT JOIN kept USING (r)""",
    "op12_lines": r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
each AS (SELECT r, doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM texts),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
repeated AS (SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT r, doc_id, i, line, holder IS NOT NULL AND holder <> doc_id AS gone FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id""",
    "op13_importance": rf"""
WITH RECURSIVE {CRC_TABLE},
texts AS (SELECT row_number() OVER () AS r, doc_id, text, false AS target FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, true FROM benchmark),
worded AS (SELECT r, doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
each AS (
  SELECT r, target, unnest(w) AS f FROM worded
  UNION ALL SELECT r, target, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded
  UNION ALL SELECT r, target, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM worded),
distinct_ AS (SELECT DISTINCT f FROM each),
placed AS (SELECT f, {CRC.format("f")} % 10000 AS bucket FROM distinct_, crc),
counted AS (SELECT r, target, bucket, count(*) AS n FROM each JOIN placed USING (f) GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (NOT target), 0)::DOUBLE AS all_s, coalesce(sum(n) FILTER (target), 0)::DOUBLE AS all_t FROM counted),
sides AS (SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target), 0)::DOUBLE AS t FROM counted GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM sides, totals),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM worded LEFT JOIN weights USING (r) WHERE NOT target),
ordered AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS of FROM scored WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * of // 100 THEN place END::BIGINT AS rank FROM scored LEFT JOIN ordered USING (r)""",
    "op2_embeddings": r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL),
unit AS (SELECT vec_id, x FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT a AS vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(b) AS component_id, a = min(b) AS kept FROM reach LEFT JOIN n USING (a) GROUP BY a""",
    "op6_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY 1),
class AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h) AS class_id FROM n),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, y.class_id AS class_b, x.class_id AS class_a FROM i JOIN class x ON x.doc_id = a JOIN class y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
links AS (SELECT a, count(*) AS n_links, count(DISTINCT class_b) FILTER (class_b <> class_a) AS n_linked_classes FROM l GROUP BY a),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
part AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT p.a AS doc_id, coalesce(class_id, p.a) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_linked_classes, 0)::BIGINT AS n_linked_classes, component_id, p.a = component_id AS kept
FROM part p LEFT JOIN class ON class.doc_id = p.a LEFT JOIN links ON links.a = p.a""",
    "op7_shard": r"""
WITH RECURSIVE step(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
hexed AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h, (octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS size FROM documents),
bytes AS (SELECT doc_id, text, size, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM hexed),
summed AS (SELECT doc_id, text, size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM bytes, crc),
placed AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '\N') || '|' || md5(text)), 1, 15))::BIGINT, doc_id, text_crc32, size) - 1 AS row, count(*) OVER () AS n FROM summed),
sides AS (SELECT *, ceil(sqrt(n))::BIGINT AS a, (n + ceil(sqrt(n))::BIGINT - 1) // ceil(sqrt(n))::BIGINT AS b FROM placed),
walk(doc_id, size, text_crc32, n, a, b, l, r, j) AS (
  SELECT doc_id, size, text_crc32, n, a, b, row % a, row // a, 1 FROM sides
  UNION ALL
  SELECT doc_id, size, text_crc32, n, a, b,
         CASE WHEN j = 7 THEN (r * a + l) % a ELSE r END,
         CASE WHEN j = 7 THEN (r * a + l) // a ELSE (l + ('0x' || substr(md5('7:' || j || ':' || r), 1, 12))::BIGINT) % CASE WHEN j % 2 = 1 THEN a ELSE b END END,
         CASE WHEN j = 7 THEN 1 ELSE j + 1 END
  FROM walk WHERE j < 7 OR r * a + l >= n),
done AS (SELECT *, r * a + l AS place FROM walk WHERE j = 7 AND r * a + l < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % 40)::INT AS shard, place // 40 AS slot, NULL::INT AS grown_shard FROM done""",
}
