"""DuckDB forms of the operators that SQL can express, written apart from them: plain joins instead of hashes and bands.

Expected for documents with a doc_id of their own; they compare all pairs that share a shingle, so they are for
small tables.
"""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Windows of 20 words by their text; every one but the first of its text marks the words below it.
SUBSTRINGS = f"""
    WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
    runs AS (SELECT doc_id, list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i : i + 19], ' ')) AS g FROM d WHERE len(w) >= 20),
    starts AS (SELECT doc_id, unnest(g) AS g, unnest(range(len(g))) AS p FROM runs),
    later AS (SELECT doc_id, p FROM starts QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
    judged AS (
        SELECT words.doc_id, words.p, words.word,
               max(CASE WHEN later.p IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY words.doc_id ORDER BY words.p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
        FROM words LEFT JOIN later ON words.doc_id = later.doc_id AND words.p = later.p),
    sums AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM judged GROUP BY doc_id)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN sums ON d.doc_id = sums.doc_id
"""

#: Distinct sets of word 5-grams, their links at four fifths, and what links reach.
DOCUMENTS = f"""
    WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("text", "lower(text)", 1)} AS w FROM documents),
    sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' ')))) AS g FROM d WHERE len(w) > 0),
    keyed AS (SELECT doc_id, md5(array_to_string(g, chr(10))) AS k, g FROM sets),
    classes AS (SELECT k, min(doc_id) AS first, count(*) AS n_copies, any_value(g) AS g FROM keyed GROUP BY k),
    grams AS MATERIALIZED (SELECT k, len(g) AS n, unnest(g) AS g FROM classes),
    links AS MATERIALIZED (
        SELECT a.k AS a, b.k AS b FROM grams a JOIN grams b ON a.g = b.g AND a.k <> b.k
        GROUP BY a.k, b.k, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
    reach(k, r) AS (SELECT k, k FROM classes UNION SELECT reach.k, links.b FROM reach JOIN links ON reach.r = links.a),
    ids AS (SELECT reach.k, min(c.first) AS class_id FROM reach JOIN classes c ON reach.r = c.k GROUP BY reach.k),
    linked AS (SELECT links.a AS k, sum(c.n_copies) AS n FROM links JOIN classes c ON links.b = c.k GROUP BY links.a)
    SELECT d.doc_id, coalesce(ids.class_id, d.doc_id) AS class_id,
           coalesce(linked.n + c.n_copies - 1, c.n_copies - 1, 0)::BIGINT AS n_links, coalesce(c.n_copies, 1)::BIGINT AS n_copies
    FROM d LEFT JOIN keyed ON d.doc_id = keyed.doc_id LEFT JOIN classes c ON keyed.k = c.k LEFT JOIN ids ON keyed.k = ids.k LEFT JOIN linked ON keyed.k = linked.k
"""

#: Distinct lines, their links by shingles of eight characters at four fifths, and the first line of what links reach.
LINES = r"""
    WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
    places AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS p FROM d WHERE text IS NOT NULL),
    lines AS MATERIALIZED (SELECT doc_id, p, part, trim(part, E' \t\n\x0b\f\r') AS line FROM places),
    distinct_lines AS MATERIALIZED (SELECT line, min({'d': doc_id, 'p': p}) AS first FROM lines WHERE line <> '' GROUP BY line),
    shingled AS (SELECT line, list_distinct(list_transform(range(1, length(line) - 6), lambda i: array_slice(line, i, i + 7))) AS g FROM distinct_lines WHERE length(line) >= 8),
    shingles AS MATERIALIZED (SELECT line, len(g) AS n, unnest(g) AS g FROM shingled),
    links AS MATERIALIZED (
        SELECT a.line AS a, b.line AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.line <> b.line
        GROUP BY a.line, b.line, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
    reach(line, r) AS (SELECT line, line FROM distinct_lines UNION SELECT reach.line, links.b FROM reach JOIN links ON reach.r = links.a),
    firsts AS (SELECT reach.line, min(x.first) AS first FROM reach JOIN distinct_lines x ON reach.r = x.line GROUP BY reach.line),
    kept AS (
        SELECT lines.doc_id, count(*) AS n, string_agg(part, chr(10) ORDER BY p) AS text
        FROM lines LEFT JOIN firsts ON lines.line = firsts.line
        WHERE lines.line = '' OR (firsts.first.d = lines.doc_id AND firsts.first.p = lines.p) GROUP BY lines.doc_id)
    SELECT d.doc_id, coalesce(len(d.parts), 0)::BIGINT AS n_lines, coalesce(kept.n, 0)::BIGINT AS n_kept,
           CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
    FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op2_line_dedup": LINES, "op5_substring_dedup": SUBSTRINGS, "op7_ngram_jaccard_join": DOCUMENTS}
