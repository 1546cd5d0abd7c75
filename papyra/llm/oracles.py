"""DuckDB SQL for the queries of ``queries.py`` that SQL can express."""

from __future__ import annotations


def _unit(*parts: str) -> str:
    text = " || ':' || ".join(f"coalesce(CAST({p} AS VARCHAR), 'null')" for p in parts)
    return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def _translate(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP3 = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, {_translate("regexp_extract(r, '^[^/?#]*', 0)")} AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(rhost, rpath, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost) * 100000 + length(rpath)) AS rule,
         arg_max(rv, length(rhost) * 100000 + length(rpath)) AS rv
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1, 2)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM parts LEFT JOIN fits USING (host, path)"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20"""

OP8 = f"""
WITH sizes AS (
  SELECT source, sum(strlen(coalesce(text, '')) + 1) AS bytes FROM documents GROUP BY 1),
rates AS (
  SELECT source, 1.0 * (pow(CAST(bytes AS DOUBLE), 0.5) / sum(pow(CAST(bytes AS DOUBLE), 0.5)) OVER ())
                 * CAST(sum(bytes) OVER () AS DOUBLE) / bytes AS rate FROM sizes),
terms AS (
  SELECT source, rate, k, exp(k * ln(rate) - rate - sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END)
    OVER (PARTITION BY source ORDER BY k)) AS p
  FROM (SELECT source, rate, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rates)),
cdf AS (SELECT source, rate, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
laws AS (SELECT source, any_value(rate) AS rate, list(c) AS cdf FROM cdf GROUP BY source),
drawn AS (
  SELECT doc_id, d.source, text, rate, len([c for c in cdf if c < u]) AS n_copies
  FROM (SELECT *, {_unit("'count8'", 'doc_id')} AS u FROM documents) d JOIN laws
    ON d.source IS NOT DISTINCT FROM laws.source)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS copy, CAST(n_copies AS INTEGER) AS n_copies, rate,
  {_unit("'order8'", 'doc_id', 'copy')} AS order_key
FROM (SELECT *, unnest(range(n_copies)) AS copy FROM drawn)"""

OP11 = f"""
WITH pieces AS (
  SELECT lang, doc, unnest(p) AS piece, generate_subscripts(p, 1) AS nth FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
      regexp_split_to_array({_translate("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]') AS p FROM documents)),
words AS (SELECT lang, doc, nth, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY 1),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (VALUES (1), (2), (3)) t(m))),
f AS (SELECT lang, m, phrase, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= 10),
inside AS (
  SELECT lang, phrase, max(c) AS most FROM (
    SELECT lang, c, unnest([regexp_extract(phrase, '^([^ ]+ [^ ]+) ', 1), regexp_extract(phrase, ' ([^ ]+ [^ ]+)$', 1)]) AS phrase
    FROM f WHERE m = 3) GROUP BY ALL),
cuts AS (
  SELECT lang, phrase, c AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
    array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f LEFT JOIN inside USING (lang, phrase)
        WHERE m > 1 AND (most IS NULL OR 100 * most < 50 * c))),
scored AS (
  SELECT lang, cuts.phrase, a, k, x.c AS l, y.c AS r,
    CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.c AS HUGEINT) * y.c) AS BIGINT) AS score
  FROM cuts JOIN f x USING (lang) JOIN f y USING (lang) WHERE x.phrase = head AND y.phrase = rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest JOIN sizes USING (lang) QUALIFY rank <= 2000"""

_TERMS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')".format(_translate("coalesce(text, '')"))

OP12 = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS t FROM documents),
lens AS (SELECT row, doc_id, len(t) AS n FROM docs WHERE len(t) > 0),
total AS (SELECT count(*) AS bn, sum(n) AS bl FROM lens),
tfs AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM docs) GROUP BY ALL),
wanted AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(bn) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tfs, total WHERE term IN (SELECT term FROM wanted) GROUP BY term),
scored AS (
  SELECT item_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * bn) // bl))))) AS score
  FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN lens USING (row), total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id,
  CAST(score AS BIGINT) AS score
FROM scored JOIN lens USING (row) WHERE score > 0 QUALIFY rank <= 50"""

OP13 = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_TERMS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS gram, least(len(w), 10) AS size FROM (
    SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0)),
found AS (
  SELECT row, i, size, item FROM (
    SELECT row, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (
      SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows)))
  JOIN windows USING (gram, size)),
hits AS (
  SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS place FROM found) GROUP BY row),
named AS (SELECT row, list_sort(list(DISTINCT item)) AS own FROM found GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(own), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(own, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (row) LEFT JOIN named USING (row)"""

ORACLES = {"op11_collocations": OP11, "op12_ranked_search": OP12, "op13_decontaminate": OP13, "op5_block_topk": OP5, "op3_url_filter": OP3, "op8_poisson_mix": OP8}
