"""The queries that SQL can express against their DuckDB form."""

import duckdb
import pytest

from partloom.llm import queries

BASE = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    phrases(phrase, n, label) AS (VALUES ('gnu general public license', 4, 'gpl'), ('apache license', 2, 'apache'), ('cc by', 2, 'cc-by'), ('mit license', 2, 'mit')),
    runs AS (SELECT doc_id, n, label, phrase, list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' ')) AS g FROM d, phrases),
    places AS (SELECT doc_id, label, phrase, unnest(g) AS g, unnest(range(len(g))) AS p FROM runs),
    hits AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places WHERE g = phrase GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels
    FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id
"""


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_duckdb(spark, sf_dir, duck, name):
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_base_of_licences_same_as_duckdb(spark, sf_dir, duck):
    want = duck.execute(BASE)
    names = [c[0] for c in want.description]
    got = queries.op10_license_scan(spark, sf_dir).select(*names).collect()
    rows = want.fetchall()
    assert any(r[2] for r in rows)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))
