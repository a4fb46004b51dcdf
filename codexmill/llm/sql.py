"""DuckDB SQL for the contracts that SQL can express."""

OP1_STATS = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_number() OVER () AS rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words,
  coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
  (len(words) < 50 OR 100 * coalesce(p.n, 0) > 50 * len(words)) AS base_failed
FROM w LEFT JOIN p USING (rid) LEFT JOIN l USING (rid)
"""

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT DISTINCT item_id, least(8, len(words)) AS n, array_to_string(words[i : i + 7], ' ') AS gram
      FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 7) + 1)) AS i FROM b WHERE len(words) > 0)),
lens AS (SELECT DISTINCT n FROM q),
g AS (SELECT rid, n, i, array_to_string(words[i : i + n - 1], ' ') AS gram
      FROM (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, lens)),
h AS (SELECT g.rid, g.i, g.n, q.item_id FROM g JOIN q ON g.gram = q.gram AND g.n = q.n),
hit AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT rid, i, unnest(range(0, n)) AS k FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS names FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM h) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""


def _op2() -> str:
    from codexmill.llm.licenses import CUES, MIN_COSINE, TEMPLATES

    rows = ", ".join(f"({n}, '{name}', '{text}')" for n, (name, text) in enumerate(TEMPLATES))
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    return f"""
WITH t(template, name, text) AS (VALUES {rows}),
tt AS (SELECT template, name, term, count(*) AS n FROM (SELECT template, name, unnest(regexp_extract_all({lower("text")}, '[a-z0-9]+')) AS term FROM t) GROUP BY ALL),
idf AS (SELECT term, ln({1 + len(TEMPLATES)}::DOUBLE / (1 + count(DISTINCT template))) + 1 AS idf FROM tt GROUP BY term),
tw AS (SELECT template, name, term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY template)) AS weight FROM tt JOIN idf USING (term)),
f AS (SELECT doc_id, coalesce(source, '_') || '/' || coalesce(lang, '_') AS folder, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || doc_id AS path, coalesce(source, '_') AS top,
  coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, path, i, lines[i] AS value FROM (SELECT doc_id, path, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS lines FROM f))
  WHERE regexp_matches(lower(lines[i]), '{CUES}')),
w AS (SELECT value, term, count(*) * coalesce(any_value(idf), ln({1 + len(TEMPLATES)}::DOUBLE) + 1) AS w
  FROM (SELECT value, unnest(regexp_extract_all({lower("value")}, '[a-z0-9]+')) AS term FROM (SELECT DISTINCT value FROM l)) LEFT JOIN idf USING (term) GROUP BY value, term),
s AS (SELECT value, template, name, round(sum(w * weight) / any_value(norm), 6) AS cosine FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY value)) AS norm FROM w) JOIN tw USING (term) GROUP BY ALL),
b AS (SELECT value, name, cosine FROM s WHERE cosine >= {MIN_COSINE} QUALIFY row_number() OVER (PARTITION BY value ORDER BY cosine DESC, name, template) = 1),
own AS (SELECT path, name, cosine FROM l JOIN b USING (value) QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, i, name) = 1),
m AS (SELECT f.*, own.name AS own_license, own.cosine AS own_cosine,
  regexp_matches(lower(string_split(text, chr(10))[1] || ' ' || string_split(text, chr(10))[-1]), '{CUES}') AS is_file FROM f LEFT JOIN own USING (path)),
d AS (SELECT folder, arg_min(own_license, path) AS inherited FROM m WHERE is_file AND own_license IS NOT NULL GROUP BY folder)
SELECT doc_id, path, own_license, round(own_cosine, 4) AS own_cosine, coalesce(own_license, inherited) AS license,
  CASE WHEN own_license IS NULL AND inherited IS NOT NULL THEN m.folder END AS license_from
FROM m LEFT JOIN d ON m.folder = d.folder
"""


OP2 = _op2()

OP11 = r"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM t WINDOW g AS (PARTITION BY text)
"""

#: Words are looked up by their CRC-32, worked out byte by byte for each distinct word.
OP13 = r"""
WITH t AS (SELECT true AS own, doc_id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark),
d AS (SELECT row_number() OVER () AS rid, own, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM t),
w AS (SELECT rid, own, unnest(words) AS word FROM d),
crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT) ORDER BY n) AS steps FROM range(256) AS r(n)),
b AS (SELECT word, xor(list_reduce(list_transform(range(0, length(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
        lambda c, x: xor(steps[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
      FROM (SELECT DISTINCT word FROM w), crc),
f AS (SELECT rid, own, bucket FROM w JOIN b USING (word)),
n AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM f GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM n),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM n, total),
m AS (SELECT rid, sum(gain)::BIGINT AS gains FROM f JOIN gain USING (bucket) WHERE own GROUP BY rid),
x AS (SELECT rid, doc_id, len(words)::BIGINT AS n_features, coalesce((gains - (((gains % len(words)) + len(words)) % len(words))) // len(words), 0)::BIGINT AS weight,
        ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (rid) WHERE own),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM z
"""
