"""The registered queries as plain SQL over the same tables, written apart from the operators."""

from __future__ import annotations

VOCABULARY = """
bench_words AS (
    SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos
    FROM (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark)),
vocabulary AS (
    SELECT w AS card_name, count(*) AS seen,
           row_number() OVER (ORDER BY min(item_id * 4294967296 + pos)) AS id
    FROM bench_words WHERE w <> '' GROUP BY w)"""

DOC_WORDS = """
doc_words AS (
    SELECT doc_id, n_chars, pos, w, length(w) - 4 AS quantity,
           CASE lang WHEN 'en' THEN 'commander' WHEN 'fr' THEN 'highlanderCanadian'
                     WHEN 'de' THEN 'modern' ELSE 'pauper' END AS format,
           CASE WHEN substr(w, 1, 1) BETWEEN 'A' AND 'Z' THEN 'commanders'
                WHEN w LIKE '%.' THEN 'sideboard' ELSE 'mainboard' END AS board
    FROM (SELECT doc_id, lang, n_chars, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos
          FROM (SELECT doc_id, lang, n_chars, string_split(text, ' ') AS ws FROM documents))),
deck_words AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY
                  CASE board WHEN 'commanders' THEN 1 WHEN 'mainboard' THEN 2 ELSE 3 END, pos) - 1 AS place
    FROM doc_words)"""


def _mask(text: str) -> str:
    bits = {"W": 1, "U": 2, "B": 4, "R": 8, "G": 16}
    return "(" + " + ".join(f"CASE WHEN contains(upper({text}), '{c}') THEN {b} ELSE 0 END" for c, b in bits.items()) + ")"


PARTS = f"""
parts AS (
    SELECT p_partkey, p_type, p_size,
           CASE WHEN p_size IN (1, 2) THEN '' WHEN p_size > 40 THEN replace(p_name, ' ', ' // ') ELSE p_name END AS card_name,
           CAST(p_partkey AS VARCHAR) AS scryfall_id, p_brand AS oracle_id, p_type AS layout,
           CAST(p_size AS VARCHAR) AS power, {_mask('p_name')} AS color_mask,
           CASE WHEN p_type = 'PROMO' THEN 0 ELSE {_mask('p_type')} END AS ci_mask,
           CASE WHEN p_size <= 10 OR p_size BETWEEN 16 AND 20 OR p_size BETWEEN 31 AND 35 THEN 1 ELSE 0 END AS reserved,
           CASE p_type WHEN 'PROMO' THEN 'n' || p_partkey WHEN 'SMALL' THEN 's' WHEN 'LARGE' THEN 'l' WHEN 'MEDIUM' THEN 'p' END AS image_uri,
           CASE WHEN p_type = 'ECONOMY' THEN '[]' ELSE '["' || replace(p_name, ' ', '", "') || '"]' END AS keywords_json,
           CASE WHEN p_size > 25 THEN 'legal' ELSE 'banned' END AS legal_commander,
           CASE WHEN p_brand < 'Brand#2' THEN 'legal' END AS legal_pauper,
           CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'legal' ELSE 'not_legal' END AS legal_modern,
           CASE WHEN p_type = 'PROMO' THEN 'restricted' ELSE 'legal' END AS legal_vintage,
           CASE WHEN p_size = 3 THEN 0 ELSE p_size / 2.0 END AS cmc
    FROM part)"""

FANOUT = """
fanout AS (
    SELECT p_partkey AS card_id, 'highlanderCanadian' AS format, legal_commander FROM parts
    UNION ALL SELECT p_partkey, 'commander', legal_commander FROM parts WHERE legal_commander = 'legal'
    UNION ALL SELECT p_partkey, 'pauper', legal_commander FROM parts WHERE legal_pauper = 'legal'
    UNION ALL SELECT p_partkey, 'modern', legal_commander FROM parts WHERE legal_modern = 'legal'
    UNION ALL SELECT p_partkey, 'vintage', legal_commander FROM parts WHERE legal_vintage = 'legal')"""

INCOMING = """
incoming AS (
    SELECT w AS card_name, count(*) AS seen, min(doc_id * 4294967296 + pos) AS ordinal
    FROM doc_words WHERE w <> '' GROUP BY w),
merged AS (
    SELECT v.id, v.card_name, coalesce(i.seen, v.seen) AS seen,
           CASE WHEN i.card_name IS NULL THEN 'kept' ELSE 'updated' END AS change
    FROM vocabulary v LEFT JOIN incoming i ON v.card_name = i.card_name
    UNION ALL
    SELECT (SELECT max(id) FROM vocabulary) + row_number() OVER (ORDER BY ordinal), card_name, seen, 'inserted'
    FROM incoming WHERE card_name NOT IN (SELECT card_name FROM vocabulary))"""

LINES = f"""
turn_lines AS (
    SELECT conv_id, turn, role, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos
    FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS ls FROM conversations)),
stubs AS (
    SELECT CASE WHEN length(line) > 60 THEN md5(line) ELSE 'id-' || md5(line) END AS moxfield_id,
           line AS name,
           CASE WHEN line LIKE 'L%' THEN 'pauper' WHEN line LIKE 'E%' THEN 'brawl' ELSE 'modern' END AS format,
           CASE WHEN line LIKE '%.' THEN role || ' ' || turn ELSE role END AS author,
           CAST(CASE WHEN line LIKE '%,%' THEN 24 ELSE {_mask('line')} END AS INTEGER) AS color_mask,
           CAST(conv_id AS VARCHAR) AS sweep_card, CAST(turn + 1 AS INTEGER) AS page, CAST(pos AS INTEGER) AS pos,
           1704067200 + turn * 86400 AS created_s,
           CASE WHEN line LIKE '%.' THEN 1706745600 + turn * 86400 END AS updated_s
    FROM turn_lines WHERE length(line) > 20)"""

ORDER_STUBS = """
o AS (
    SELECT o_orderpriority AS format, CAST(o_custkey AS VARCHAR) AS moxfield_id, o_orderstatus AS name, o_orderkey AS seq,
           o_orderdate >= TIMESTAMP '1998-01-01' AS late,
           CASE WHEN o_orderstatus <> 'P' THEN CAST(trunc(o_totalprice) AS BIGINT) END AS stamp
    FROM orders),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY format, moxfield_id, late ORDER BY seq) AS up,
           row_number() OVER (PARTITION BY format, moxfield_id, late ORDER BY seq DESC) AS down
    FROM o),
steps AS (
    SELECT *, lag(stamp) OVER (PARTITION BY format, moxfield_id ORDER BY late, seq) AS prev,
           lag(seq) OVER (PARTITION BY format, moxfield_id ORDER BY late, seq) IS NOT NULL AS has_prev
    FROM numbered WHERE late OR down = 1),
decks AS (
    SELECT format, moxfield_id, bool_and(late) AS is_new, count(*) FILTER (late) AS n_stubs,
           coalesce(bool_or(late AND has_prev AND stamp IS NOT NULL AND (prev IS NULL OR stamp > prev)), FALSE) AS rose
    FROM steps GROUP BY ALL),
merged AS (
    SELECT d.*, d.rose AND NOT d.is_new AS requeued,
           coalesce(l.name, s.name) AS name, s.name AS stored_name,
           CASE WHEN l.seq IS NOT NULL THEN l.stamp ELSE s.stamp END AS updated_s,
           CASE WHEN d.is_new THEN lf.stamp ELSE sf.stamp END AS created_s
    FROM decks d
    LEFT JOIN numbered l ON l.format = d.format AND l.moxfield_id = d.moxfield_id AND l.late AND l.down = 1
    LEFT JOIN numbered lf ON lf.format = d.format AND lf.moxfield_id = d.moxfield_id AND lf.late AND lf.up = 1
    LEFT JOIN numbered s ON s.format = d.format AND s.moxfield_id = d.moxfield_id AND NOT s.late AND s.down = 1
    LEFT JOIN numbered sf ON sf.format = d.format AND sf.moxfield_id = d.moxfield_id AND NOT sf.late AND sf.up = 1)"""

PAGES = """
page_lines AS (
    SELECT doc_id, lang, len(ls) AS total_pages, unnest(ls) AS line, generate_subscripts(ls, 1) AS page
    FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents)),
page_words AS (SELECT doc_id, page, unnest(string_split(line, ' ')) AS w FROM page_lines),
counted AS (SELECT doc_id, page, count(*) AS raw_count FROM page_words WHERE w <> '' GROUP BY ALL),
firsts AS (
    SELECT doc_id, page FROM (
        SELECT doc_id, page, w, row_number() OVER (PARTITION BY doc_id, w ORDER BY page) AS rn FROM page_words WHERE w <> '')
    WHERE rn = 1 AND w NOT IN (SELECT card_name FROM vocabulary)),
fresh AS (SELECT doc_id, page, count(*) AS new_decks FROM firsts GROUP BY ALL),
flagged AS (
    SELECT l.doc_id, l.page, coalesce(raw_count, 0) AS raw_count, coalesce(new_decks, 0) AS new_decks,
           CAST(l.page >= total_pages OR coalesce(raw_count, 0) < 3
                OR (lang = 'en' AND coalesce(new_decks, 0) = 0) AS INTEGER) AS stops
    FROM page_lines l LEFT JOIN counted c ON l.doc_id = c.doc_id AND l.page = c.page
    LEFT JOIN fresh f ON l.doc_id = f.doc_id AND l.page = f.page),
kept AS (
    SELECT * FROM (
        SELECT *, coalesce(max(stops) OVER (PARTITION BY doc_id ORDER BY page
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM flagged)
    WHERE past = 0)"""

TURNS = """
turns AS (
    SELECT conv_id, turn, role = 'user' AS error, toxic, quality,
           row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) AS nth
    FROM conversations LEFT JOIN labels ON conv_id = doc_id),
turn_words AS (
    SELECT conv_id, turn, w, id, CASE WHEN substr(w, 1, 1) BETWEEN 'A' AND 'Z' THEN 'commanders'
                WHEN w LIKE '%.' THEN 'sideboard' ELSE 'mainboard' END AS board
    FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations WHERE role <> 'user')
    LEFT JOIN vocabulary ON w = card_name WHERE w <> ''),
contents AS (
    SELECT conv_id, turn, count(DISTINCT id || ' ' || board) AS n_rows, count(*) FILTER (id IS NULL) AS n_unresolved
    FROM turn_words GROUP BY ALL),
outcomes AS (
    SELECT CAST(t.conv_id AS VARCHAR) AS moxfield_id, t.turn AS seq,
           CAST(CASE WHEN toxic IS NULL THEN -1 WHEN NOT error AND toxic <> 1 AND nth = 1 THEN coalesce(n_rows, 0) ELSE 0 END AS INTEGER) AS written,
           CAST(CASE WHEN error THEN 0 ELSE coalesce(n_unresolved, 0) END AS INTEGER) AS n_unresolved,
           toxic IS NOT NULL AND NOT error AND NOT (toxic <> 1 AND nth = 1) AS collision,
           toxic IS NOT NULL AND error AS errored
    FROM turns t LEFT JOIN contents c ON t.conv_id = c.conv_id AND t.turn = c.turn)"""

DECKS = """
decks AS (
    SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'legacy' WHEN '2-HIGH' THEN 'modern' WHEN '3-MEDIUM' THEN 'pauper'
               WHEN '4-NOT SPECIFIED' THEN 'highlanderCanadian' ELSE 'vintage' END AS format,
           CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3
               WHEN '5-LOW' THEN 4 ELSE 5 END AS prio,
           CAST(o_orderkey AS VARCHAR) AS moxfield_id, o_orderstatus, o_orderdate AS scraped_at
    FROM orders),
waiting AS (
    SELECT * FROM decks WHERE o_orderstatus = 'O'
       OR (o_orderstatus = 'P' AND scraped_at < TIMESTAMP '{as_of}' - INTERVAL 30 MINUTE)),
batch AS (
    SELECT format, moxfield_id FROM waiting WHERE prio = (SELECT min(prio) FROM waiting)
    ORDER BY scraped_at, moxfield_id LIMIT 50)"""

UNITS = """
units AS (
    SELECT o_orderkey AS card_id, o_orderpriority AS format, o_orderstatus = 'O' AS swept, o_totalprice > 100000 AS ever_swept,
           CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS claimed_at
    FROM orders)"""

LIFECYCLE = """
WITH RECURSIVE log AS (
    SELECT user_id, CAST(k // 10 AS INTEGER) AS tens, kind, event_id, ts, value, CASE WHEN k >= 15 THEN value END AS stamp,
           row_number() OVER (PARTITION BY user_id, k // 10 ORDER BY event_id) AS n
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                 CASE event_type WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'err' ELSE 'discover' END AS kind
          FROM events)),
state AS (
    SELECT DISTINCT user_id, tens, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS DOUBLE) AS updated_at,
           CAST(NULL AS DOUBLE) AS created_at, CAST(NULL AS TIMESTAMP) AS cards_fetched_at FROM log
    UNION ALL
    SELECT s.user_id, s.tens, l.n,
           CASE WHEN kind = 'discover' THEN CASE WHEN status IS NULL OR (stamp IS NOT NULL AND (updated_at IS NULL OR stamp > updated_at))
                                                 THEN 'discovered' ELSE status END
                WHEN status IS NULL OR status = 'done' THEN status
                WHEN kind = 'ok' THEN 'done' WHEN kind = 'err' THEN 'error'
                WHEN status = 'discovered' THEN 'claimed' ELSE status END,
           CASE WHEN kind = 'discover' THEN stamp ELSE updated_at END,
           CASE WHEN status IS NULL AND kind = 'discover' THEN value ELSE created_at END,
           CASE WHEN kind = 'ok' AND status IS NOT NULL AND status <> 'done' THEN ts ELSE cards_fetched_at END
    FROM state s JOIN log l ON s.user_id = l.user_id AND s.tens = l.tens AND l.n = s.n + 1)
SELECT user_id, tens, status, updated_at, created_at, cards_fetched_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, tens ORDER BY n DESC) AS back FROM state)
WHERE back = 1 AND status IS NOT NULL"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


LIFECYCLE_EPOCHS = LIFECYCLE.replace(
    "CAST(NULL AS TIMESTAMP) AS cards_fetched_at FROM log", "CAST(NULL AS TIMESTAMP) AS cards_fetched_at, 0 AS epoch FROM log"
).replace(
    "ELSE cards_fetched_at END\n", """ELSE cards_fetched_at END,
           CASE WHEN kind = 'discover' AND (status IS NULL OR (stamp IS NOT NULL AND (updated_at IS NULL OR stamp > updated_at)))
                THEN epoch + 1 ELSE epoch END
"""
).replace("SELECT user_id, tens, status, updated_at, created_at, cards_fetched_at\n", "SELECT user_id, tens, status, updated_at, created_at, cards_fetched_at, epoch\n")

ORACLE_SQL = {
    "card_usage": _with(VOCABULARY, DOC_WORDS) + """
        SELECT format, card_name, count(*) AS entries, CAST(sum(quantity) AS BIGINT) AS copies, CAST(id AS INTEGER) AS card_id
        FROM doc_words JOIN vocabulary ON w = card_name GROUP BY format, card_name, id""",
    "card_parse": _with(PARTS) + """
        SELECT card_name, scryfall_id, oracle_id, layout, CAST(NULL AS VARCHAR) AS mana_cost, CAST(NULL AS VARCHAR) AS type_line,
               CAST(NULL AS VARCHAR) AS oracle_text, power, CAST(NULL AS VARCHAR) AS toughness, CAST(NULL AS VARCHAR) AS loyalty,
               CAST(NULL AS VARCHAR) AS defense, CAST(color_mask AS INTEGER) AS color_mask, CAST(ci_mask AS INTEGER) AS ci_mask,
               CAST(NULL AS VARCHAR) AS rarity, CAST(reserved AS INTEGER) AS reserved, CAST(0 AS INTEGER) AS textless,
               CAST(0 AS INTEGER) AS game_changer, p_size AS edhrec_rank, image_uri, keywords_json, legal_commander, legal_pauper,
               legal_modern, legal_vintage, CAST(NULL AS VARCHAR) AS legal_legacy, CAST(cmc AS DOUBLE) AS cmc,
               split_part(card_name, ' // ', 1) AS search_name
        FROM parts""",
    "first_card_of_name": _with(PARTS) + """
        SELECT p.card_name, scryfall_id, layout FROM parts p
        WHERE p.card_name <> '' AND NOT EXISTS (
            SELECT 1 FROM parts q WHERE q.card_name = p.card_name AND q.p_partkey < p.p_partkey)""",
    "dedupe_first_wins": """
        SELECT doc_id, lang, source, n_chars FROM documents
        WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)""",
    "collision_count": _with(PARTS) + """
        SELECT 'documents' AS source, count(*) - count(DISTINCT text) AS collisions FROM documents WHERE text <> ''
        UNION ALL SELECT 'part', count(*) - count(DISTINCT card_name) FROM parts WHERE card_name <> ''""",
    "color_masks": f"""
        SELECT p_partkey, CAST({_mask('p_name')} AS INTEGER) AS name_mask, CAST({_mask('p_type')} AS INTEGER) AS type_mask FROM part""",
    "color_mask_rows": f"""
        SELECT c_nationkey, CAST(bit_or({_mask('c_mktsegment')}) AS INTEGER) AS mask FROM customer GROUP BY c_nationkey""",
    "format_fanout": _with(PARTS, FANOUT) + " SELECT card_id, format FROM fanout",
    "format_stats": _with(PARTS, FANOUT) + " SELECT format, count(*) AS n FROM fanout GROUP BY format",
    "card_total": "SELECT count(*) AS total, count(*) = 0 AS empty FROM part",
    "status_extension": _with(PARTS, FANOUT) + """
        SELECT format, count(*) AS units, count(*) FILTER (legal_commander = 'legal') AS swept_units FROM fanout GROUP BY format""",
    "insert_anti": _with(VOCABULARY, DOC_WORDS) + """
        SELECT w AS card_name, count(*) AS seen FROM doc_words
        WHERE w <> '' AND NOT EXISTS (SELECT 1 FROM vocabulary WHERE card_name = w) GROUP BY w""",
    "dimension_upsert": _with(VOCABULARY, DOC_WORDS, INCOMING) + """
        SELECT CAST(id AS INTEGER) AS id, card_name, seen, change FROM merged""",
    "upsert_change_counts": _with(VOCABULARY, DOC_WORDS, INCOMING) + """
        SELECT count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'inserted') AS inserted FROM merged""",
    "name_resolve": """
        SELECT p_brand AS brand, count(*) AS lines, sum(l_quantity) AS pieces
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
    "unresolved_names": _with(VOCABULARY, DOC_WORDS) + """
        SELECT format, CAST(doc_id AS VARCHAR) AS moxfield_id, w AS card_name, count(*) AS times FROM doc_words
        WHERE w <> '' AND w NOT IN (SELECT card_name FROM vocabulary) GROUP BY ALL""",
    "stub_parse": _with(LINES) + " SELECT * FROM stubs WHERE format <> 'brawl'",
    "unknown_formats": _with(LINES) + " SELECT DISTINCT format FROM stubs WHERE format = 'brawl'",
    "stub_upsert": _with(ORDER_STUBS) + """
        SELECT format, moxfield_id, name, is_new, requeued, n_stubs, created_s, updated_s,
               CASE WHEN is_new OR requeued THEN 'discovered' WHEN stored_name = 'F' THEN 'done'
                    WHEN stored_name = 'O' THEN 'claimed' ELSE 'error' END AS status
        FROM merged""",
    "stub_upsert_counts": """
        SELECT count(*) AS upserted, count(DISTINCT CASE WHEN fresh THEN k END) AS new, count(*) - count(DISTINCT CASE WHEN fresh THEN k END) AS existing
        FROM (SELECT a.o_orderpriority || ' ' || a.o_custkey AS k, NOT EXISTS (
                  SELECT 1 FROM orders b WHERE b.o_orderpriority = a.o_orderpriority AND b.o_custkey = a.o_custkey
                  AND b.o_orderdate < TIMESTAMP '1998-01-01') AS fresh
              FROM orders a WHERE a.o_orderdate >= TIMESTAMP '1998-01-01')""",
    "early_exit_pages": _with(VOCABULARY, PAGES) + """
        SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(raw_count AS INTEGER) AS raw_count, new_decks FROM kept WHERE raw_count > 0""",
    "sweep_totals": _with(VOCABULARY, PAGES) + """
        SELECT doc_id, CAST(sum(new_decks) AS BIGINT) AS new_decks, CAST(max(page) AS INTEGER) AS pages, max(stops) = 1 AS complete
        FROM kept GROUP BY doc_id""",
    "deck_flatten": _with(DOC_WORDS) + """
        SELECT format, CAST(doc_id AS VARCHAR) AS moxfield_id, board, count(*) AS entries, CAST(sum(quantity) AS BIGINT) AS copies,
               CAST(min(place) AS INTEGER) AS first_pos, CAST(max(place) AS INTEGER) AS last_pos,
               arg_min(w, place) AS first_name, arg_max(w, place) AS last_name
        FROM deck_words WHERE w <> '' GROUP BY ALL""",
    "array_pack": _with(VOCABULARY, DOC_WORDS) + """,
        named AS (
            SELECT d.*, id, rtrim(repeat(id || ',', greatest(quantity, 1)), ',') AS copies
            FROM deck_words d LEFT JOIN vocabulary ON w = card_name WHERE w <> ''),
        packed AS (
            SELECT doc_id, string_agg(copies, ',' ORDER BY place) FILTER (id IS NOT NULL AND board <> 'sideboard') AS card_ids,
                   string_agg(copies, ',' ORDER BY place) FILTER (id IS NOT NULL AND board = 'commanders') AS commander_ids,
                   sum(greatest(quantity, 1)) FILTER (id IS NOT NULL AND board <> 'sideboard') AS n_rows,
                   string_agg(w, '|' ORDER BY place) FILTER (id IS NULL) AS lost
            FROM named GROUP BY doc_id)
        SELECT CASE lang WHEN 'en' THEN 'commander' ELSE 'highlanderCanadian' END AS format, CAST(d.doc_id AS VARCHAR) AS moxfield_id,
               CAST(coalesce(n_rows, 0) AS INTEGER) AS n_rows, coalesce(card_ids, '') AS card_ids,
               CASE WHEN lang = 'en' THEN coalesce(commander_ids, '') ELSE '' END AS commander_ids, md5(coalesce(lost, '')) AS unresolved_md5
        FROM documents d LEFT JOIN packed p ON d.doc_id = p.doc_id WHERE lang IN ('en', 'fr')""",
    "bridge_of_documents": _with(VOCABULARY, DOC_WORDS) + """
        SELECT format, CAST(doc_id AS VARCHAR) AS moxfield_id, CAST(id AS INTEGER) AS card_id, board,
               CAST(arg_max(quantity, place) AS INTEGER) AS quantity
        FROM deck_words JOIN vocabulary ON w = card_name WHERE format IN ('modern', 'pauper') GROUP BY ALL""",
    "bridge_replace": """
        WITH ranked AS (
            SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_linestatus, l_shipdate >= TIMESTAMP '1998-01-01'
                ORDER BY l_shipdate DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC,
                         l_discount DESC, l_tax DESC, l_returnflag DESC) AS rn,
                bool_or(l_shipdate >= TIMESTAMP '1998-01-01') OVER (PARTITION BY l_orderkey) AS replaced
            FROM lineitem)
        SELECT l_orderkey AS moxfield_id, l_partkey AS card_id, l_linestatus AS board, l_quantity AS quantity
        FROM ranked WHERE rn = 1 AND (l_shipdate >= TIMESTAMP '1998-01-01' OR NOT replaced)""",
    "outcome_table": _with(VOCABULARY, TURNS) + " SELECT * FROM outcomes",
    "outcome_counts": _with(VOCABULARY, TURNS) + """
        SELECT count(*) AS submitted, count(*) FILTER (NOT errored AND NOT collision AND written >= 0) AS ok,
               count(*) FILTER (errored) AS errored, count(*) FILTER (collision) AS collisions FROM outcomes""",
    "settled_decks": """
        SELECT CAST(l.doc_id AS VARCHAR) AS moxfield_id,
               CASE WHEN toxic = 1 THEN 'done'
                    WHEN EXISTS (SELECT 1 FROM conversations WHERE conv_id = l.doc_id AND role <> 'user') THEN 'done'
                    WHEN EXISTS (SELECT 1 FROM conversations WHERE conv_id = l.doc_id) THEN 'error'
                    WHEN quality = 1 THEN 'claimed' ELSE 'discovered' END AS status,
               CASE WHEN toxic <> 1 AND EXISTS (SELECT 1 FROM conversations WHERE conv_id = l.doc_id AND role <> 'user')
                    THEN TIMESTAMP '2024-01-15' END AS cards_fetched_at
        FROM labels l""",
    "attempt_verdict": """
        WITH a AS (
            SELECT user_id, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS INTEGER) AS tens, event_id, event_type = 'purchase' AS ok
            FROM events WHERE event_type IN ('error', 'purchase')),
        c AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY user_id, tens ORDER BY event_id) AS fails FROM a)
        SELECT user_id, tens, CASE WHEN bool_or(ok AND fails < 3) THEN 'ok' WHEN max(fails) >= 3 THEN 'error' ELSE 'pending' END AS verdict
        FROM c GROUP BY ALL""",
    "sweep_worklist": _with(UNITS) + """
        SELECT card_id, format, claimed_at, CASE WHEN ever_swept THEN 'incremental' ELSE 'full' END AS mode
        FROM units WHERE NOT swept AND (claimed_at IS NULL OR claimed_at < TIMESTAMP '1999-01-01' - INTERVAL 30 MINUTE)
        ORDER BY ever_swept, claimed_at NULLS FIRST, card_id, format LIMIT 50""",
    "deck_worklist": _with(DECKS.format(as_of="2024-01-15")) + " SELECT * FROM batch",
    "batch_assignment": _with(DECKS.format(as_of="1997-06-01")) + """
        SELECT format, moxfield_id, (row_number() OVER (PARTITION BY format ORDER BY scraped_at, moxfield_id) - 1) // 50 AS batch FROM waiting""",
    "lease_stamps": _with(DECKS.format(as_of="2024-01-15")) + """
        SELECT format, CASE WHEN hit OR o_orderstatus = 'P' THEN 'claimed' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'discovered' END AS status,
               count(*) AS decks, count(*) FILTER (hit) AS stamped
        FROM (SELECT *, moxfield_id IN (SELECT moxfield_id FROM batch) AS hit FROM decks) GROUP BY ALL""",
    "stale_leases": """
        SELECT user_id AS claimed_by, count(*) AS stale, min(ts) AS oldest FROM events
        WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 30 MINUTE GROUP BY user_id""",
    "queue_drained": """
        SELECT o_custkey AS format, count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice >= 250000) AS pending,
               count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice >= 250000) = 0 AS drained
        FROM orders GROUP BY o_custkey""",
    "sweep_completion": _with(UNITS) + """,
        hit AS (SELECT *, card_id IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') AS done FROM units)
        SELECT format, count(*) FILTER (swept OR done) AS swept, count(*) FILTER (ever_swept OR done) AS ever_swept, count(*) AS units
        FROM hit GROUP BY format""",
    "lost_completions": """
        SELECT doc_id AS card_id, CASE WHEN quality = 1 THEN 'en' ELSE 'fr' END AS format FROM labels l
        WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id
                          AND d.lang = CASE WHEN quality = 1 THEN 'en' ELSE 'fr' END)""",
    "cycle_reset": _with(UNITS) + """,
        placed AS (
            SELECT *, claimed_at IS NULL AS open, row_number() OVER (PARTITION BY claimed_at IS NULL ORDER BY ever_swept, card_id) AS nth FROM units),
        again AS (
            SELECT *, row_number() OVER (PARTITION BY open AND nth > 50 ORDER BY card_id) AS next FROM placed)
        SELECT 'leased' AS phase, format, count(*) FILTER (swept) AS swept, count(*) FILTER (ever_swept) AS ever_swept,
               count(*) FILTER (open AND nth <= 50) AS leased FROM placed GROUP BY format
        UNION ALL
        SELECT 'completed', format, count(*) FILTER (swept OR open), count(*) FILTER (ever_swept OR open),
               count(*) FILTER (open AND nth <= 50) FROM placed GROUP BY format
        UNION ALL
        SELECT 'turned', format, 0, count(*) FILTER (ever_swept OR open), count(*) FILTER (open AND (nth <= 50 OR next <= 50)) FROM again GROUP BY format""",
    "stored_claims": _with(DECKS.format(as_of="2024-01-15")) + """,
        placed AS (
            SELECT d.*, o_custkey, CASE WHEN w.moxfield_id IS NOT NULL THEN row_number() OVER (
                PARTITION BY w.moxfield_id IS NOT NULL ORDER BY d.scraped_at, d.moxfield_id) END AS nth
            FROM decks d JOIN orders ON CAST(o_orderkey AS VARCHAR) = d.moxfield_id LEFT JOIN (
                SELECT moxfield_id FROM waiting WHERE prio = (SELECT min(prio) FROM waiting)) w ON d.moxfield_id = w.moxfield_id)
        SELECT format, moxfield_id,
               CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' OR nth <= 100 THEN 'claimed' ELSE 'discovered' END AS status,
               CASE WHEN nth <= 50 THEN 'third' WHEN nth <= 100 THEN 'second' WHEN o_orderstatus = 'P' THEN 'c' || o_custkey END AS claimed_by,
               CASE WHEN nth <= 50 THEN TIMESTAMP '2024-01-15 00:31:00' WHEN nth <= 100 THEN TIMESTAMP '2024-01-15 00:10:00'
                    WHEN o_orderstatus = 'P' THEN scraped_at END AS claimed_at
        FROM placed""",
    "stream_lifecycle": LIFECYCLE_EPOCHS,
    "added_column": _with(UNITS) + """
        SELECT CAST(card_id AS INTEGER) AS card_id, format, claimed_at, false AS ever_swept, 'full' AS mode FROM units
        WHERE NOT swept AND (claimed_at IS NULL OR claimed_at < TIMESTAMP '1999-01-01' - INTERVAL 30 MINUTE)
        ORDER BY claimed_at NULLS FIRST, card_id, format LIMIT 50""",
    "attempt_stream": """
        WITH a AS (
            SELECT user_id, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS INTEGER) AS tens, event_id, event_type = 'purchase' AS ok
            FROM events WHERE event_type IN ('error', 'purchase')),
        runs AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY user_id, tens ORDER BY event_id) AS run FROM a),
        per_run AS (SELECT user_id, tens, run, count(*) FILTER (NOT ok) AS fails, count(*) FILTER (ok) AS wins FROM runs GROUP BY ALL)
        SELECT user_id, tens, CAST(sum(wins) AS BIGINT) AS ok, CAST(sum(fails // 3) AS BIGINT) AS errors,
               CAST(arg_max(fails, run) % 3 AS INTEGER) AS failures
        FROM per_run GROUP BY user_id, tens""",
    "lifecycle_state": LIFECYCLE,
    "constraint_report": """
        SELECT 'orders key' AS "check", count(*) AS violations FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'lineitem key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
        UNION ALL SELECT 'part name', count(*) FROM (SELECT 1 FROM part GROUP BY p_name HAVING count(*) > 1)
        UNION ALL SELECT 'document text', count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*) > 1)
        UNION ALL SELECT 'customer required', count(*) FROM customer WHERE c_name IS NULL OR c_acctbal IS NULL
        UNION ALL SELECT 'order status', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
        UNION ALL SELECT 'line has order', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
        UNION ALL SELECT 'order has line', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey)
        UNION ALL SELECT 'document has label', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "cascade_delete": """
        WITH kept AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)),
        lines AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM kept)
                  OR l_orderkey NOT IN (SELECT o_orderkey FROM orders))
        SELECT 'orders' AS t, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM kept
        UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lines""",
    "seeded_status": _with(PARTS, FANOUT) + """,
        firsts AS (SELECT card_name, min(p_partkey) AS p FROM parts WHERE card_name <> '' GROUP BY card_name),
        ids AS (SELECT card_name, p, row_number() OVER (ORDER BY p) AS id FROM firsts)
        SELECT CAST(id AS INTEGER) AS card_id, card_name, format, FALSE AS swept FROM ids JOIN fanout ON p = card_id""",
    "unknown_log": _with(VOCABULARY) + """,
        clean AS (
            SELECT CASE lang WHEN 'en' THEN 'commander' WHEN 'fr' THEN 'highlanderCanadian' WHEN 'de' THEN 'modern' ELSE 'pauper' END AS format,
                   unnest(string_split(translate(text, chr(10) || chr(9) || chr(13), '   '), ' ')) AS w FROM documents)
        SELECT format, count(*) AS lines, count(DISTINCT w) AS names FROM clean
        WHERE w <> '' AND NOT EXISTS (SELECT 1 FROM vocabulary WHERE card_name = w) GROUP BY format""",
    "stream_corpus": _with(VOCABULARY, DOC_WORDS) + """,
        cards AS (
            SELECT doc_id, CAST(coalesce(sum(greatest(quantity, 1)) FILTER (board <> 'sideboard'), 0) AS INTEGER) AS n_cards,
                   count(DISTINCT id || board) AS n_rows,
                   CAST(count(DISTINCT id) FILTER (board = 'commanders') AS INTEGER) AS n_commanders
            FROM deck_words JOIN vocabulary ON w = card_name GROUP BY doc_id),
        d AS (
            SELECT CASE lang WHEN 'en' THEN 'commander' WHEN 'fr' THEN 'highlanderCanadian' WHEN 'de' THEN 'modern' ELSE 'pauper' END AS format,
                   doc_id, n_chars >= 300 AS ok, doc_id IN (SELECT doc_id FROM labels) AS changed FROM documents)
        SELECT format, CAST(d.doc_id AS VARCHAR) AS moxfield_id, CASE WHEN changed THEN 'discovered' WHEN ok THEN 'done' ELSE 'error' END AS status,
               CASE WHEN ok AND format IN ('commander', 'highlanderCanadian') THEN coalesce(n_cards, 0) END AS n_cards,
               CASE WHEN ok AND format IN ('modern', 'pauper') THEN coalesce(n_rows, 0) ELSE 0 END AS n_rows,
               CASE WHEN ok AND format = 'commander' THEN coalesce(n_commanders, 0) END AS n_commanders,
               CAST(CASE WHEN NOT ok THEN 0 WHEN format IN ('commander', 'highlanderCanadian') THEN coalesce(n_cards, 0) ELSE coalesce(n_rows, 0) END AS INTEGER) AS written, NOT ok AS errored
        FROM d LEFT JOIN cards ON d.doc_id = cards.doc_id""",
    "stream_upsert": """
        WITH fetched AS (
            SELECT o_custkey || '-' || (o_orderkey % 100) AS moxfield_id, CAST(trunc(max(o_totalprice) / 5000 * 100) AS BIGINT) AS stamp
            FROM orders GROUP BY ALL),
        found AS (
            SELECT user_id || '-' || json_extract_string(props, '$.k') AS moxfield_id, event_id, event_type, props,
                   CAST(trunc(value * 100) AS BIGINT) AS created, CASE WHEN event_type <> 'error' THEN CAST(trunc(value * 100) AS BIGINT) END AS stamp
            FROM events),
        stepped AS (
            SELECT f.*, o.stamp AS stored, o.moxfield_id IS NOT NULL AS known, row_number() OVER w AS nth,
                   CASE WHEN row_number() OVER w = 1 THEN o.stamp ELSE lag(f.stamp) OVER w END AS previous
            FROM found f LEFT JOIN fetched o ON f.moxfield_id = o.moxfield_id WINDOW w AS (PARTITION BY f.moxfield_id ORDER BY event_id))
        SELECT moxfield_id, arg_max(event_type, event_id) AS name, arg_max(props, event_id) AS author,
               CASE WHEN bool_and(known) AND NOT bool_or(stamp IS NOT NULL AND (previous IS NULL OR stamp > previous)) THEN 'done' ELSE 'discovered' END AS status,
               coalesce(any_value(stored), arg_min(created, event_id)) AS created_s,
               CASE WHEN arg_max(event_type, event_id) <> 'error' THEN arg_max(created, event_id) END AS updated_s
        FROM stepped GROUP BY moxfield_id
        UNION ALL
        SELECT moxfield_id, NULL, NULL, 'done', stamp, stamp FROM fetched f WHERE NOT EXISTS (SELECT 1 FROM found WHERE found.moxfield_id = f.moxfield_id)""",
}
# Packed again when all names are known, decks are what one packing with all of them gives.
ORACLE_SQL["names_resolved_later"] = ORACLE_SQL["array_pack"]
