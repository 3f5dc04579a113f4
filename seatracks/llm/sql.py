"""DuckDB SQL of the queries that SQL can express, over whole tables and texts.

The others need a tokenizer, a fingerprint, a model, archives or a search; tests hold them against
brute force, round trips or held-out labels.
"""

from __future__ import annotations

from . import licenses
from .quality_rules import MIN_LEFT, MOST_DOCS, STATS

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def license_sql() -> str:
    """Each passage's cosine to each template, by joins of terms; weights from the templates' own texts."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({t}, {text(name)}, {text(notice)})" for t, (name, notice) in enumerate(licenses.TEMPLATES))
    common = ", ".join(f"'{w}'" for w in sorted(licenses.COMMON))
    blank, end = (x.replace("'", "''") for x in (licenses.BLANK, licenses.SENTENCE_END))
    return f"""
WITH templates(template, license, notice) AS (VALUES {templates}
), bag AS (SELECT template, word, count(*) AS tf FROM (SELECT template, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+')) AS word FROM templates) WHERE word NOT IN ({common}) GROUP BY ALL
), idf AS (SELECT word, ln((1 + (SELECT count(*) FROM templates)) / (1 + count(*))::double) + 1 AS idf FROM bag GROUP BY word
), raw AS (SELECT template, word, tf * idf AS x FROM bag JOIN idf USING (word)
), weights AS (SELECT template, word, x / sqrt(sum(x * x) OVER (PARTITION BY template)) AS weight FROM raw
), docs AS (
  SELECT doc_id, text, concat_ws('/', source, CASE WHEN doc_id % 10 <> 0 THEN (doc_id % 10)::varchar END) AS dir, coalesce(source, '') AS top FROM documents
), passages AS (
  SELECT doc_id, {licenses.LINE} AS kind, unnest(string_split(lower(text), chr(10))) AS passage FROM docs
  UNION ALL SELECT doc_id, {licenses.SENTENCE}, unnest(string_split_regex(lower(text), '{end}')) FROM docs
  UNION ALL SELECT * FROM (SELECT doc_id, {licenses.PARAGRAPH}, unnest(string_split_regex(lower(text), '{blank}')) AS passage FROM docs) WHERE contains(passage, chr(10))
), terms AS (SELECT doc_id, kind, row_number() OVER () AS pos, regexp_extract_all(passage, '[a-z0-9]+') AS words FROM passages
), bags AS (SELECT doc_id, kind, pos, len(words) AS n_terms, word, count(*) AS tf FROM (SELECT *, unnest(words) AS word FROM terms) WHERE word NOT IN ({common}) GROUP BY ALL
), weighed AS (SELECT b.*, tf * coalesce(idf, ln(1 + (SELECT count(*) FROM templates)::double) + 1) AS x FROM bags b LEFT JOIN idf USING (word)
), norms AS (SELECT pos, sqrt(sum(x * x)) AS norm FROM weighed GROUP BY pos
), dots AS (SELECT doc_id, kind, pos, any_value(n_terms) AS n_terms, template, sum(x * weight) AS dot FROM weighed JOIN weights USING (word) GROUP BY doc_id, kind, pos, template
), scored AS (
  SELECT d.*, round(dot / norm, 6) AS score, license, license = '{licenses.WEAK}' AS weak FROM dots d JOIN norms USING (pos) JOIN templates USING (template) WHERE round(dot / norm, 6) >= {licenses.THRESHOLD}
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY pos ORDER BY weak, score DESC, template) = 1
), own AS (SELECT doc_id, license, score FROM best QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weak, score DESC, template) = 1
), share AS (SELECT doc_id, max(n) AS licence_words FROM (SELECT doc_id, kind, sum(n_terms) AS n FROM best GROUP BY ALL) GROUP BY doc_id
), known AS (
  SELECT d.doc_id, d.dir, d.top, own.license, own.score, share.licence_words, len({WORDS.format("d.text")}) AS n_words FROM docs d LEFT JOIN own USING (doc_id) LEFT JOIN share USING (doc_id)
), dirs AS (
  SELECT dir, score, license FROM known WHERE license IS NOT NULL AND licence_words >= {licenses.FILE_SHARE} * n_words
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license DESC) = 1
)
SELECT k.doc_id, concat_ws('/', nullif(k.dir, ''), k.doc_id || '.txt') AS path, coalesce(k.license, a.license, b.license, c.license) AS license,
       CASE WHEN k.license IS NOT NULL THEN k.score WHEN a.license IS NOT NULL THEN a.score WHEN b.license IS NOT NULL THEN b.score ELSE c.score END AS score,
       CASE WHEN k.license IS NOT NULL THEN 'header' WHEN coalesce(a.license, b.license, c.license) IS NOT NULL THEN 'inherited' END AS found,
       CASE WHEN k.license IS NOT NULL OR a.license IS NOT NULL THEN k.dir WHEN b.license IS NOT NULL THEN k.top WHEN c.license IS NOT NULL THEN '' END AS license_dir
FROM known k LEFT JOIN dirs a ON a.dir = k.dir LEFT JOIN dirs b ON b.dir = k.top LEFT JOIN dirs c ON c.dir = ''
"""


#: Lines are compared as texts, not by hash; windows and their words by joins.
OP5_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), base AS (
  SELECT doc_id, host, {WORDS.format("text")} AS words, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, string_split(text, chr(10)) AS parts FROM docs
), lines AS (
  SELECT doc_id, host, line, array_to_string({WORDS.format("regexp_replace(lower(line), '[0-9]', '0', 'g')")}, ' ') AS plain, len({WORDS.format("line")}) AS w
  FROM (SELECT doc_id, host, unnest(parts) AS line FROM base) WHERE len({WORDS.format("line")}) > 0
), dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY 1
), bodies AS (SELECT doc_id, host, plain, sum(w) AS w FROM lines GROUP BY ALL
), often AS (SELECT b.host, b.plain FROM bodies b JOIN docs d USING (doc_id) GROUP BY b.host, b.plain HAVING count(DISTINCT d.text) > {MOST_DOCS}
), gone AS (SELECT doc_id, sum(w)::BIGINT AS words_removed FROM bodies JOIN often USING (host, plain) GROUP BY 1
), windows AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base)
), twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1
), inside AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(3) r(k) GROUP BY 1
), stats AS (
  SELECT b.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(words_removed, 0) AS words_removed
  FROM base b LEFT JOIN dup USING (doc_id) LEFT JOIN inside USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, {", ".join(STATS)}, words_removed, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - words_removed >= {MIN_LEFT}::double * n_words AS kept
FROM stats
"""

#: The level is found among the levels at which each source reaches its cap.
OP7_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM per
), levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS full_at FROM weighed
), tried AS (
  SELECT a.full_at, sum(CASE WHEN b.full_at < a.full_at THEN b.cap ELSE 0 END) AS capped,
         sum(CASE WHEN b.full_at < a.full_at THEN 0 ELSE b.weight END) AS open_weight
  FROM levels a, levels b GROUP BY a.full_at
), level AS (
  SELECT arg_min((1.5::DOUBLE * (SELECT sum(source_size) FROM per)::DOUBLE - capped) / open_weight, full_at) AS level
  FROM tried WHERE (1.5::DOUBLE * (SELECT sum(source_size) FROM per)::DOUBLE - capped) / open_weight <= full_at
), targets AS (
  SELECT source, source_size, CASE WHEN level * weight >= cap THEN cap ELSE level * weight END AS target FROM levels, level
), split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets
), ordered AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.whole,
         round_even(s.target - s.whole * s.source_size, 0)::BIGINT AS extra,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('17:' || d.doc_id), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs d JOIN split s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target,
       (whole * size + least(size, greatest(0, extra - (upto - size))))::BIGINT AS taken
FROM ordered
"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit: 0xEDB88320 is the reversed polynomial."""
    byte = "list_reduce(range(0, 8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, b))"
    return f"xor(4294967295::BIGINT, list_reduce(list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: {byte}, 4294967295::BIGINT))"


#: Lines as texts, their documents counted in one grouping.
OP11_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.keeper AS dropped FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Nodes are the lists of turns themselves; sums over subtrees go by each node's own prefixes.
OP12_SQL = r"""
WITH own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT conv_id, conv_id - conv_id % 5 AS donor, (CRC % 9)::BIGINT AS h, turns FROM own
), built AS (
  SELECT c.conv_id, list_concat(coalesce(d.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns FROM heads c LEFT JOIN own d ON d.conv_id = c.donor
), prefixes AS (
  SELECT conv_id, d, turns[1:d] AS node, d = len(turns) AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM built)
), nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node, d
), children AS (
  SELECT node[1:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), full_nodes AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n.n_convs - 1) * strlen(n.node[n.d].t) ELSE 0 END AS own_saved FROM nodes n LEFT JOIN children c ON n.node = c.node
), sums AS (
  SELECT node[1:k] AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own_saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_nodes) GROUP BY 1
)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s ON f.node = s.node LEFT JOIN nodes p ON f.d > 0 AND p.node = f.node[1:f.d - 1]
""".replace("CRC", crc32("conv_id::VARCHAR"))

#: Each order's steps from the rows' flags: a filter removes what fails it and none before it.
OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN docs.doc_id > min(docs.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM docs LEFT JOIN said ON docs.doc_id = said.doc_id
), cells AS (SELECT part, fails, sum(1) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before FROM orders, range(1, 6) r(step)
), tried AS (
  SELECT c.*, s.*, contains(fails, letter) AS fails_here, length(translate(before, fails, '')) < length(before) AS gone FROM cells c, steps s
), counted AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails_here), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails_here), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE gone AND fails_here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = letter), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE NOT gone AND fails_here), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails_here), 0)::BIGINT AS toxic_lost
  FROM tried GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_sql(),
        "op5_quality_rules": OP5_SQL,
        "op7_mixing": OP7_SQL,
        "op11_line_dedup": OP11_SQL,
        "op12_prefix_trie": OP12_SQL,
        "op13_filter_audit": OP13_SQL,
    }
