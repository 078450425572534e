"""Plain SQL of those queries that SQL can express."""

from __future__ import annotations

# The word pattern of the contracts.
_WORD = r"[^\x20\x09-\x0D]+"


def _quality() -> str:
    windows = "\n".join(
        f"""
, w{n} AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + {n - 1}], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {n - 2})) AS i FROM t WHERE len(words) >= {n})
)
, r{n} AS (
  SELECT doc_id, i FROM w{n} QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1
)
, c{n} AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {n})) AS p FROM r{n}) GROUP BY 1
)"""
        for n in (3, 8, 200)
    )
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
){windows}
, l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY 1
)
, f AS (
  SELECT t.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c3.n, 0)::BIGINT AS n_repeat_words,
    coalesce(c8.n, 0)::BIGINT AS covered_words, c200.n IS NOT NULL AS has_long_repeat
  FROM t LEFT JOIN l USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c8 USING (doc_id) LEFT JOIN c200 USING (doc_id)
)
, b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, has_long_repeat, base_failed,
  NOT base_failed AND 100 * covered_words <= 50 * n_words AND NOT has_long_repeat AS kept
FROM b"""


def _jaccard() -> str:
    return rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words
  FROM documents
)
, s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM t WHERE len(words) > 0)
)
, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1)
, p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2)
, e AS (
  SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * shared >= 75 * (x.n + y.n - shared)
)
, r AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT e.b, r.root FROM r JOIN e ON r.node = e.a
)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(root) AS component_id
FROM t LEFT JOIN n ON t.doc_id = n.doc_id JOIN r ON t.doc_id = r.node GROUP BY 1, 2"""


def _line_templates() -> str:
    return r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line, lines[i] AS raw FROM (
    SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
  )
)
, m AS (
  SELECT doc_id, line, list_transform(regexp_extract_all(raw, '[^\x20\x09-\x0D]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
  FROM l
)
, f AS (
  SELECT doc_id, line, tokens, len(tokens)::VARCHAR || ' ' || array_to_string(tokens[1:3], ' ') AS leaf FROM m WHERE len(tokens) >= 3
)
, d AS (SELECT leaf, tokens, count(DISTINCT doc_id) AS docs FROM f GROUP BY 1, 2)
, e AS (SELECT leaf, tokens, docs, i, tokens[i] AS token FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM d))
, p AS (SELECT leaf, i, token, sum(docs) AS n FROM e GROUP BY 1, 2, 3)
, c AS (
  SELECT e.leaf, e.tokens, any_value(e.docs) AS docs, list_sort(list(p.n), 'DESC')[ceil(count(*) / 2)::INTEGER] AS least,
    list({'i': e.i, 'token': e.token, 'n': p.n} ORDER BY e.i) AS places
  FROM e JOIN p ON e.leaf = p.leaf AND e.i = p.i AND e.token = p.token GROUP BY 1, 2
)
, s AS (
  SELECT leaf, tokens, docs, CASE WHEN least >= 10 THEN list_transform(places, lambda x: CASE WHEN x.n >= least THEN x.token ELSE '<*>' END) END AS template
  FROM c
)
, g AS (SELECT f.*, s.docs, s.template FROM f JOIN s ON f.leaf = s.leaf AND f.tokens = s.tokens)
, u AS (SELECT leaf, template, count(DISTINCT doc_id) AS support FROM g WHERE template IS NOT NULL GROUP BY 1, 2)
, x AS (
  SELECT DISTINCT doc_id, line FROM g LEFT JOIN u ON g.leaf = u.leaf AND g.template = u.template WHERE docs >= 10 OR support >= 10
)
, k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(x.line) AS n_dropped,
    coalesce(string_agg(raw, chr(10) ORDER BY l.line) FILTER (x.line IS NULL), '') AS kept
  FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.line = x.line GROUP BY 1
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM k"""


def _mixing() -> str:
    return r"""
WITH RECURSIVE s AS (
  SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY 1
)
, r AS (
  SELECT source, CASE WHEN size > 0 THEN (1.0::DOUBLE / sum(CASE WHEN size > 0 THEN 1 END) OVER ()) * sum(size) OVER () / size ELSE 0 END AS rate
  FROM s
)
, d AS (
  SELECT doc_id, documents.source, text, rate,
    (('0x' || md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':1')[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source
)
, p AS (
  SELECT doc_id, source, text, rate, u, 0 AS k, exp(-rate) AS term, exp(-rate) AS total FROM d
  UNION ALL
  SELECT doc_id, source, text, rate, u, k + 1, term * rate / (k + 1), total + term * rate / (k + 1) FROM p
  WHERE total < u AND k < ceil(rate + 12 * sqrt(rate) + 20)
)
SELECT doc_id, source, k AS copy, md5('order 17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || k) AS shuffle_key,
  length(text)::BIGINT AS n_chars, md5(text) AS text_md5
FROM p WHERE k > 0"""


def _repeated_words() -> str:
    return rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents)
, w AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM t WHERE len(words) >= 13)
)
, r AS (SELECT doc_id, i FROM w QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id)
, c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM r)
, k AS (SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM t))
, g AS (
  SELECT k.doc_id, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY k.i) FILTER (c.i IS NULL) AS kept
  FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.i = c.i GROUP BY 1
)
SELECT t.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN g ON t.doc_id = g.doc_id"""


def _lexical_search() -> str:
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT * FROM (SELECT doc_id, {terms} AS terms FROM documents) WHERE len(terms) > 0)
, s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d)
, p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL)
, f AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
, q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark) GROUP BY 1, 2)
, r AS (
  SELECT item_id, doc_id, sum(times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY 1, 2
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r WHERE score > 0
) WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": _quality(),
        "op4_jaccard_join": _jaccard(),
        "op5_line_templates": _line_templates(),
        "op6_mixing": _mixing(),
        "op9_repeated_words": _repeated_words(),
        "op13_lexical_search": _lexical_search(),
    }
