"""DuckDB SQL for the results of the text operators that SQL can express."""

from rallypoint.llm.decontaminate import UNITS

OP2 = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), p AS (
    SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), g AS (
    SELECT rid, i, word, lead(word, 1) OVER s AS w2, lead(word, 2) OVER s AS w3 FROM p WINDOW s AS (PARTITION BY rid ORDER BY i)
), rep AS (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, word, w2, w3) AS n FROM g WHERE w3 IS NOT NULL
), cov AS (
    SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) t(k) WHERE n >= 2 GROUP BY rid
), l AS (
    SELECT rid, line, count(*) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line
), dl AS (
    SELECT rid, sum(n - 1)::BIGINT AS n_dup_lines, sum(n)::BIGINT AS n_lines FROM l GROUP BY rid
), m AS (
    SELECT d.rid, d.doc_id, d.source, len(w.ws) AS n_words,
        coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(dl.n_dup_lines, 0) AS n_dup_lines, coalesce(dl.n_lines, 0) AS n_lines, coalesce(cov.n_repeat_words, 0) AS n_repeat_words
    FROM d JOIN w USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN cov USING (rid)
), f AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), r AS (
    SELECT rid, source, unnest([base_failed, 100 * n_symbols > 50 * n_words, 100 * n_dup_lines > 30 * n_lines]) AS failed, unnest([1, 2, 3]) AS rule FROM f
), h AS (
    SELECT rule, source, count(*)::DOUBLE AS n, (count(*) FILTER (failed))::DOUBLE AS k FROM r WHERE source IS NOT NULL GROUP BY rule, source
), s AS (
    SELECT rule, count(*) AS hosts, sum(n) AS n, sum(k) / sum(n) AS mu, (sum(k * k / n) - sum(k) ** 2 / sum(n)) / sum(n) AS spread, sum(n * n) AS nn FROM h GROUP BY rule
), v AS (
    SELECT rule, mu, mu * (1 - mu) * (1 - nn / n ** 2 - (hosts - 1) / n) AS room, spread - mu * (1 - mu) * (hosts - 1) / n AS between_ FROM s
), pw AS (
    SELECT rule, mu, CASE WHEN between_ <= 0 OR room <= 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0, room / between_ - 1)) END AS weight FROM v
), bad AS (
    SELECT DISTINCT source FROM h JOIN pw USING (rule) WHERE (k + mu * weight) / (n + weight) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(source IN (SELECT source FROM bad), false) AS kept
FROM f
"""

OP1 = r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (
    SELECT conv_id, turn AS last_turn, text AS last_text, row_number() OVER (ORDER BY conv_id) AS i, count(*) OVER () AS n FROM (
        SELECT * FROM t WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC NULLS LAST) = 1
    )
), twin AS (
    SELECT a.conv_id, a.last_turn, a.last_text, b.last_text AS reply FROM last a JOIN last b ON b.i = a.i % a.n + 1
), s AS (
    SELECT t.conv_id, t.turn, t.role, t.text AS c,
        CASE WHEN t.role = 'assistant' AND t.turn IS NOT DISTINCT FROM w.last_turn AND t.text IS NOT DISTINCT FROM w.last_text THEN w.reply ELSE t.text END AS r
    FROM t JOIN twin w USING (conv_id)
), chosen AS (
    SELECT conv_id, role, c AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, c NULLS FIRST) AS i FROM s
), rejected AS (
    SELECT conv_id, role, r AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, r NULLS FIRST) AS i FROM s
), cmp AS (
    SELECT a.conv_id, coalesce(min(a.i) FILTER (WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text) - 1, count(*))::INTEGER AS n
    FROM chosen a JOIN rejected b USING (conv_id, i) GROUP BY a.conv_id
), parts AS (
    SELECT conv_id, 'c' AS side, i, role, text FROM chosen UNION ALL SELECT conv_id, 'r', i, role, text FROM rejected
), sized AS (
    SELECT p.*, n, '<|' || regexp_replace(coalesce(role, ''), '<(\\*)\|', '<\\\1|', 'g') || '|>' || chr(10) AS head,
        regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS body FROM parts p JOIN cmp USING (conv_id)
), placed AS (
    SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, side, i > n ORDER BY i) AS stop FROM sized
)
SELECT conv_id AS pair_id, any_value(n) AS n_common,
    coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 'c' AND i <= n), '') AS prompt,
    coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 'c' AND i > n), '') AS chosen,
    coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 'r' AND i > n), '') AS rejected,
    coalesce(string_agg((stop - length(body))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY i) FILTER (WHERE side = 'c' AND i > n AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg((stop - length(body))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY i) FILTER (WHERE side = 'r' AND i > n AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""

#: Base32 of the 20 digest bytes, eight characters for every five bytes.
OP8 = r"""
WITH p AS (
    SELECT page_id, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages
), m AS (
    SELECT *, min(page_id) OVER (PARTITION BY digest) AS original FROM p
)
SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(digest, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = original OR original IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM m
"""

_UNITS = "|".join(UNITS)
OP10 = rf"""
WITH docs AS (
    SELECT doc_id, row_number() OVER () AS rid, text FROM (SELECT DISTINCT doc_id, text FROM documents)
), items AS (
    SELECT item_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM benchmark
), src AS (
    SELECT 'doc' AS kind, rid, coalesce(text, '') AS text FROM docs
    UNION ALL SELECT 'item', rid, text FROM items
), joined AS (
    SELECT kind, rid, regexp_replace(regexp_replace(translate(text, '@', ' '), '([0-9])[.,]([0-9])', '\1\2', 'g'), '([0-9])[.,]([0-9])', '\1\2', 'g') AS text FROM src
), cleaned AS (
    SELECT kind, rid, lower(trim(regexp_replace(regexp_replace(text, '(^|[^\p{{L}}\p{{N}}])(\p{{Lu}})', '\1@\2', 'g'), '[^\p{{L}}\p{{N}}@]+', ' ', 'g'))) AS c FROM joined
), templated AS (
    SELECT kind, rid, c, rtrim(regexp_replace(regexp_replace(c || ' ', '[^ ]*[0-9][^ ]*', '#', 'g'), '# @?({_UNITS}) ', '# ~ ', 'g')) AS s FROM cleaned WHERE c <> ''
), split AS (
    SELECT kind, rid, string_split(replace(c, '@', ''), ' ') AS o, string_split(regexp_replace(s, '@[^ ]+', '@', 'g'), ' ') AS t, 0 AS r FROM templated
    UNION ALL SELECT kind, rid, string_split(replace(c, '@', ''), ' '), string_split(replace(s, '@', ''), ' '), 1 FROM templated
), cut AS (
    SELECT kind, rid, pos, r, o[pos + 1 : pos + 5] AS own, t[pos + 1 : pos + 5] AS likes
    FROM (SELECT *, unnest(range(0, greatest(len(t) - 5, 0) + 1)) AS pos FROM split)
), typed AS (
    SELECT *, own AS plain, len(likes) >= 5 AND len(list_filter(likes, lambda x: x NOT IN ('#', '@', '~'))) >= 2 AS typed FROM cut
), keyed AS (
    SELECT kind, rid, pos, plain, likes, typed, key, min(r) AS r FROM (SELECT *,
        CASE WHEN len(likes) < 5 THEN 'short ' WHEN typed THEN 't ' ELSE 'o ' END || array_to_string(CASE WHEN typed THEN likes ELSE plain END, ' ') AS key
    FROM typed) GROUP BY ALL
), counts AS (
    SELECT rid, count(DISTINCT pos) AS n FROM keyed WHERE kind = 'item' GROUP BY rid
), every AS (
    SELECT rid, pos, key, plain, likes, typed, min(r) OVER (PARTITION BY rid, pos, key) AS r FROM keyed WHERE kind = 'item'
), spots AS (
    SELECT DISTINCT rid, pos, key, k, plain[k] AS value FROM every, range(1, 6) t(k) WHERE r = 0 AND typed AND likes[k] IN ('#', '@', '~')
), patterns AS (
    SELECT rid, pos, key, list((k, first) ORDER BY k) AS pattern FROM (SELECT *, min((pos, key, k)) OVER (PARTITION BY rid, value) AS first FROM spots) GROUP BY rid, pos, key
), signatures AS (
    SELECT rid, list((pos, key, pattern)::VARCHAR ORDER BY pos, key) AS signature FROM (SELECT DISTINCT rid, pos, key FROM every WHERE r = 0) LEFT JOIN patterns USING (rid, pos, key) GROUP BY rid
), classes AS (
    SELECT rid, item_id, first_value(rid) OVER w AS class_rid, first_value(item_id) OVER w AS class_item FROM signatures JOIN items USING (rid)
    WINDOW w AS (PARTITION BY signature ORDER BY item_id NULLS LAST, rid)
), filed AS (
    SELECT every.*, class_rid, class_item FROM every JOIN classes USING (rid)
), met AS (
    SELECT d.rid AS doc, i.rid AS item, class_rid, class_item, max(i.r) OVER (PARTITION BY d.rid, i.rid) AS r, c.n, i.pos, d.pos - i.pos AS shift, d.plain AS b, i.plain AS a, i.likes, i.typed
    FROM keyed d JOIN filed i ON d.kind = 'doc' AND d.key = i.key JOIN counts c ON c.rid = i.rid
), slots AS (
    SELECT DISTINCT doc, item, shift, a[k] AS a, b[k] AS b FROM met, range(1, 6) r(k) WHERE typed AND likes[k] IN ('#', '@', '~')
), whole AS (
    SELECT doc, item, n, count(DISTINCT pos) AS found FROM met GROUP BY doc, item, n HAVING count(DISTINCT pos) >= ceil(n * 80 / 100)
), aligned AS (
    SELECT doc, item, n, shift, count(DISTINCT pos) AS found FROM met GROUP BY doc, item, n, shift HAVING count(DISTINCT pos) >= ceil(n * 80 / 100)
), torn AS (
    SELECT DISTINCT doc, item FROM (SELECT doc, item, a FROM slots GROUP BY doc, item, a HAVING count(DISTINCT b) > 1)
), torn_shift AS (
    SELECT DISTINCT doc, item, shift FROM (SELECT doc, item, shift, a FROM slots GROUP BY doc, item, shift, a HAVING count(DISTINCT b) > 1)
), passed AS (
    SELECT doc, item, n, found FROM whole ANTI JOIN torn USING (doc, item)
    UNION ALL SELECT doc, item, n, found FROM aligned ANTI JOIN torn_shift USING (doc, item, shift)
)
SELECT doc_id, item_id, n AS n_windows, found AS n_found, class_item AS class_item_id FROM (
    SELECT p.*, class_rid, class_item, max((item = class_rid)::INTEGER) OVER (PARTITION BY doc, class_rid) AS by_class
    FROM (SELECT doc, item, n, max(found) AS found FROM passed WHERE (doc, item) IN (SELECT (doc, item) FROM met WHERE item = class_rid OR r = 1) GROUP BY ALL) p JOIN classes ON rid = item
) q JOIN docs d ON d.rid = doc JOIN items i ON i.rid = item WHERE item = class_rid OR by_class = 0
UNION ALL SELECT NULL, item_id, NULL, NULL, class_item FROM classes WHERE rid <> class_rid
"""

OP12 = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
fails AS (SELECT doc_id, part,
  CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > first OR (doc_id IS NULL AND first IS NOT NULL) THEN 'E' ELSE '' END AS mask FROM words),
known AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM fails LEFT JOIN known USING (doc_id) GROUP BY part, mask),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier FROM orders, range(1, 6) s(step)),
met AS (SELECT c.*, s.*, contains(mask, own) AS fails, len(mask) > 0 AND regexp_matches(mask, '[' || earlier || '0]') AS gone FROM cells c, steps s),
summed AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT fails AND NOT gone) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed,
  sum(n) FILTER (fails AND gone) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
  sum(good) FILTER (fails AND NOT gone) AS good_lost, sum(toxic) FILTER (fails AND NOT gone) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM summed
"""


#: A round of OP11: every part's nearest entry of books c{i}, then the books c{i + 1} of floored means.
_OP11_NEAREST = """
a{i} AS MATERIALIZED (SELECT r, part, CAST(min(CAST(far AS HUGEINT) * 16 + entry) % 16 AS INT) AS entry, CAST(min(CAST(far AS HUGEINT) * 16 + entry) // 16 AS BIGINT) AS far
  FROM (SELECT r, v.part, entry, sum((x - c) * (x - c)) AS far FROM v JOIN c{i} USING (part, pos) GROUP BY r, v.part, entry) GROUP BY r, part)"""
_OP11_MEANS = """
c{j} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, CASE WHEN n IS NULL THEN c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c
  FROM c{i} c LEFT JOIN (SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM a{i} JOIN v USING (r, part) GROUP BY part, entry, pos) USING (part, entry, pos))"""

OP11 = (
    """
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding, label NULLS FIRST) AS r, vec_id, label, embedding, len(embedding) // 8 AS d
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, (i - 1) // d AS part, (i - 1) % d AS pos, CAST(floor(4096 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT r, d, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
c0 AS MATERIALIZED (SELECT part, CAST(r - 1 AS INT) AS entry, pos, x AS c FROM v WHERE r <= 16)"""
    + "".join("," + _OP11_NEAREST.format(i=i) + "," + _OP11_MEANS.format(i=i, j=i + 1) for i in range(6))
    + ","
    + _OP11_NEAREST.format(i=6)
    + """,
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a6 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c6) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""
)
