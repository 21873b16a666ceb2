"""SQL of the training-data queries, written apart from them."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_sharding"] = r"""
WITH RECURSIVE jump(doc_id, state, bucket, next) AS (
    SELECT doc_id, (coalesce(doc_id, -1)::HUGEINT & 18446744073709551615::HUGEINT)::UHUGEINT, -1::BIGINT, 0::BIGINT
    FROM (SELECT DISTINCT doc_id FROM documents)
    UNION ALL
    SELECT doc_id, moved, next, floor((next + 1)::DOUBLE * (2147483648.0::DOUBLE / ((moved >> 33)::DOUBLE + 1)))::BIGINT
    FROM (
        SELECT doc_id, next, (state * 2862933555777941757::UHUGEINT + 1::UHUGEINT) & 18446744073709551615::UHUGEINT AS moved
        FROM jump WHERE next < 16)
),
ends AS (SELECT doc_id, bucket::INT AS shard, CASE WHEN next = 16 THEN 16 ELSE bucket END::INT AS grown_shard FROM jump WHERE next >= 16),
steps AS (
    SELECT b AS byte, list_reduce(list_prepend(b::BIGINT, [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS entry
    FROM range(256) t(b)),
crc_table AS (SELECT list(entry ORDER BY byte) AS entries FROM steps),
sums AS (
    SELECT text, CASE WHEN octet_length(encode(text)) = 0 THEN 0 ELSE xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(text))),
            lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) END AS text_crc32
    FROM (SELECT text, hex(encode(text)) AS digits FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)), crc_table)
SELECT d.doc_id, coalesce(octet_length(encode(d.text)), 0)::BIGINT + 1 AS size, s.text_crc32::BIGINT AS text_crc32, 'key' AS law,
    e.shard, row_number() OVER (PARTITION BY e.shard ORDER BY d.doc_id NULLS FIRST, s.text_crc32 NULLS FIRST) - 1 AS slot, e.grown_shard
FROM documents d JOIN ends e ON d.doc_id IS NOT DISTINCT FROM e.doc_id LEFT JOIN sums s ON d.text = s.text
"""

ORACLE_SQL["op4_mixing"] = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        md5(CASE WHEN doc_id IS NULL THEN 'mix' ELSE 'mix:' || doc_id END) AS mixed, row_number() OVER () AS id
    FROM documents),
totals AS (
    SELECT source, sum(size)::BIGINT AS source_size, sum(size)::BIGINT * 2 AS cap,
        [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM sized GROUP BY source),
levels AS (  -- the level at which the sources reach their target, tried at every limit
    SELECT *, (sum(source_size) OVER ()) * 3 - 2 * coalesce(sum(cap) OVER before, 0) AS rest,
        (sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0) AS others
    FROM totals
    WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest, others FROM levels WHERE cap * 2 * others > rest * weight ORDER BY others DESC LIMIT 1),
targets AS (
    SELECT source, source_size, CASE WHEN cap * 2 * others <= rest * weight THEN cap::DOUBLE
        ELSE (SELECT rest FROM level)::DOUBLE * weight / ((SELECT others FROM level) * 2)::DOUBLE END AS target
    FROM levels),
laid AS (
    SELECT s.*, t.source_size, t.target, coalesce(sum(size) OVER (
        PARTITION BY s.source ORDER BY mixed, doc_id NULLS FIRST, size, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    (greatest(0, least(start + size, floor(target)::BIGINT) - start)
     + greatest(0, least(source_size + start + size, floor(target)::BIGINT) - source_size - start))::BIGINT AS taken
FROM laid
"""

ORACLE_SQL["op9_decontamination"] = r"""
WITH lowered AS (
    SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents),
items AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
phrases AS (
    SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k : k + 12], ' ') AS phrase
    FROM items, unnest(range(1, greatest(1, len(w) - 12) + 1)) t(k) WHERE len(w) > 0),
places AS (
    SELECT id, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase
    FROM lowered, (SELECT DISTINCT n FROM phrases), unnest(range(1, len(w) - n + 2)) t(k)),
hits AS (SELECT p.id, p.n, p.k, q.item FROM places p JOIN phrases q ON p.phrase = q.phrase AND p.n = q.n),
words AS (SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT id, n, k FROM hits), unnest(range(k, k + n)) t(j) GROUP BY id),
found AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lowered LEFT JOIN words USING (id) LEFT JOIN found USING (id)
"""

ORACLE_SQL["op5_topk"] = r"""
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM usable q JOIN usable c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

ORACLE_SQL["op3_lines"] = r"""
WITH numbered AS (
    SELECT doc_id, text, k AS raw, string_split(text, chr(10))[k] AS line
    FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(k)),
counted AS (
    SELECT doc_id, raw, trim(line, E' \t\n\r\x0b\x0c') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY raw) AS p,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
    FROM numbered WHERE trim(line, E' \t\n\r\x0b\x0c') <> ''),
grown AS (
    SELECT *, lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3,
        n + lead(n, 1) OVER w AS n2
    FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
spans AS (
    SELECT doc_id, p, 1 AS size, line AS body FROM grown WHERE n >= 50
    UNION ALL SELECT doc_id, p, 2, line || chr(10) || line2 FROM grown WHERE line2 IS NOT NULL AND n2 >= 50
    UNION ALL SELECT doc_id, p, 3, line || chr(10) || line2 || chr(10) || line3 FROM grown WHERE line3 IS NOT NULL),
later AS (SELECT doc_id, p, size FROM spans QUALIFY row_number() OVER (PARTITION BY size, body ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, j AS p FROM later, unnest(range(p, p + size)) t(j)),
states AS (
    SELECT m.doc_id, m.raw, m.line, c.p, g.p IS NOT NULL AS dropped
    FROM numbered m LEFT JOIN counted c ON m.doc_id = c.doc_id AND m.raw = c.raw LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.p = c.p),
around AS (
    SELECT *, last_value(CASE WHEN p IS NOT NULL THEN dropped END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY raw) AS before,
        first_value(CASE WHEN p IS NOT NULL THEN dropped END IGNORE NULLS) OVER (
            PARTITION BY doc_id ORDER BY raw ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
    FROM states),
kept AS (SELECT doc_id, raw, line FROM around WHERE CASE WHEN p IS NULL THEN NOT (coalesce(before, false) AND coalesce(after, false)) ELSE NOT dropped END),
texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY raw) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text,
    (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed
FROM documents d LEFT JOIN texts t ON d.doc_id = t.doc_id
"""

ORACLE_SQL["op11_resampling"] = r"""
WITH steps AS (
    SELECT b AS byte, list_reduce(list_prepend(b::BIGINT, [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS entry
    FROM range(256) t(b)),
crc_table AS (SELECT list(entry ORDER BY byte) AS entries FROM steps),
docs AS (
    SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents),
held AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(w) AS word FROM docs) GROUP BY id, word),
asked AS (
    SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark)
    GROUP BY word),
buckets AS (
    SELECT word, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(word))),
            lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
    FROM (SELECT word FROM held UNION SELECT word FROM asked), crc_table),
s AS (SELECT bucket, sum(n) AS s FROM held JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM asked JOIN buckets USING (word) GROUP BY bucket),
sizes AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t_all),
gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((s::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain
    FROM s LEFT JOIN t USING (bucket), sizes),
summed AS (SELECT id, sum(n * gain)::BIGINT AS total FROM held JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY id),
weighed AS (
    SELECT id, doc_id, len(w)::BIGINT AS n_features,
        CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END::BIGINT AS weight,
        ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM docs LEFT JOIN summed USING (id)),
scored AS (
    SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place,
        count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS wanted
    FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= wanted THEN place END::BIGINT AS rank FROM placed
"""
