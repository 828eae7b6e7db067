"""DuckDB statements for the operators that SQL can express, over whole tables."""

OP8 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM docs),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY array_to_string(words[i:i + 34], ' ')) AS n FROM starts),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM windows WHERE n > 1),
placed AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM placed ANTI JOIN gone USING (r, p) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Proximity: a stretch of at most two words more than the window has that has all its words and begins with one.
OP9 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
benchmark_items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words FROM benchmark WHERE item_id IS NOT NULL),
item_starts AS (SELECT item, words, unnest(range(1, greatest(2, len(words) - 8))) AS i FROM benchmark_items WHERE len(words) > 0),
item_windows AS (SELECT DISTINCT item, words[i:i + 9] AS terms FROM item_starts),
windows AS (SELECT terms, row_number() OVER () AS w, len(terms) AS n, array_to_string(terms, ' ') AS phrase FROM (SELECT DISTINCT terms FROM item_windows)),
owners AS (SELECT w, item FROM item_windows JOIN windows USING (terms)),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, sizes),
found AS (SELECT r, i, w, n FROM (SELECT r, i, n, array_to_string(words[i:i + n - 1], ' ') AS phrase FROM starts) JOIN windows USING (n, phrase)),
hits AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
matched AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found JOIN owners USING (w)) GROUP BY r),
terms AS (SELECT DISTINCT w, n, unnest(terms) AS word, len(list_distinct(terms)) AS wanted FROM windows),
placed AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM docs),
present AS (SELECT r, w FROM (SELECT DISTINCT r, word FROM placed) JOIN terms USING (word) GROUP BY r, w, wanted HAVING count(*) = wanted),
places AS (SELECT r, w, p, word, n, wanted FROM present JOIN terms USING (w) JOIN placed USING (r, word)),
close AS (SELECT a.r, a.w, a.p FROM places a JOIN places b ON a.r = b.r AND a.w = b.w AND b.p BETWEEN a.p AND a.p + a.n + 1 GROUP BY a.r, a.w, a.p, a.wanted HAVING count(DISTINCT b.word) = a.wanted),
near AS (SELECT r, count(DISTINCT p) AS n FROM close GROUP BY r),
nearby AS (SELECT r, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM close JOIN owners USING (w)) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(matched.n, 0) AS n_items, sha256(coalesce(matched.items, '')) AS items_sha256,
    hits.n IS NOT NULL AS contaminated, coalesce(near.n, 0) AS n_near, coalesce(nearby.items, '') AS near_items
FROM docs LEFT JOIN hits USING (r) LEFT JOIN matched USING (r) LEFT JOIN near USING (r) LEFT JOIN nearby USING (r)
"""
