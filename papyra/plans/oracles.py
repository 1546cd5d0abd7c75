r"""DuckDB SQL oracles, one per registered query key.

The driver registers the parquet tables as views (documents, pages, ...).
RE2 is ASCII for ``\b \w \d \s``, so the oracle spells out the Unicode sets
Python ``re`` uses: word = ``[\p{L}\p{N}_]``, digit = ``\p{Nd}``, space =
``[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]``.
"""

from __future__ import annotations

from papyra import lexicons as L
from papyra.plans import fixtures as X

ORACLES: dict[str, str] = {}

NW = r"[^\p{L}\p{N}_]"                      # Python non-word character
SPACE = r"[\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]"


def _words_re(words) -> str:
    return rf"(^|{NW})(" + "|".join(words) + rf")({NW}|$)"


def _sq(s: str) -> str:
    return s.replace("'", "''")


def clean_sql(col: str) -> str:
    return (rf"trim(regexp_replace(regexp_replace({col}, '\\u[\p{{L}}\p{{N}}_]{{4}}', ' ', 'g'), "
            rf"'{SPACE}+', ' ', 'g'))")


def is_resume_sql(col: str, keywords, sections, titles, company=None) -> str:
    subs = " OR ".join(f"contains(lower({col}), '{_sq(w)}')" for w in dict.fromkeys(list(keywords) + list(sections)))
    year = rf"regexp_matches({col}, '(^|{NW})\p{{Nd}}{{4}}({NW}|$)')"
    title = f"regexp_matches({col}, '{_words_re(titles)}', 'i')"
    ev = f"{year} OR {title}"
    if company:
        ev += f" OR regexp_matches({col}, '{_words_re(company)}', 'i')"
    return f"(({subs}) AND ({ev}))"


IS_RESUME_V1 = is_resume_sql("content", L.RESUME_V1_KEYWORDS, L.RESUME_V1_SECTIONS,
                             L.RESUME_V1_TITLES, L.RESUME_V1_COMPANY_WORDS)
IS_RESUME_V2 = is_resume_sql("content", L.RESUME_V2_KEYWORDS, L.RESUME_V2_SECTIONS, L.RESUME_V2_TITLES)


def _list_str(expr: str) -> str:
    return f"array_to_string({expr}, '|')"


def phones_sql(col: str) -> str:
    p = _sq(L.PHONE_PATTERN)
    g = [f"regexp_extract_all({col}, '{p}', {i})" for i in (1, 2, 3, 4)]
    return (f"array_to_string(list_transform(range(len({g[3]})), lambda i: concat_ws('|', "
            f"coalesce(({g[0]})[i + 1], ''), coalesce(({g[1]})[i + 1], ''), "
            f"coalesce(({g[2]})[i + 1], ''), coalesce(({g[3]})[i + 1], ''))), ';')")


def contact_cols(col: str) -> str:
    return ", ".join([
        f"{_list_str(f'regexp_extract_all({col}, {chr(39)}{_sq(L.EMAIL_PATTERN)}{chr(39)})')} AS emails",
        f"{phones_sql(col)} AS phone_numbers",
        f"{_list_str(f'regexp_extract_all({col}, {chr(39)}{_sq(L.LINKEDIN_PATTERN)}{chr(39)})')} AS linkedin",
        f"{_list_str(f'regexp_extract_all({col}, {chr(39)}{_sq(L.GITHUB_PATTERN)}{chr(39)})')} AS github",
        f"{_list_str(f'regexp_extract_all({col}, {chr(39)}{_sq(L.URL_PATTERN)}{chr(39)})')} AS urls",
    ])


PLANTED = f"planted AS ({X.planted_sql()})"
CLEANED = f"cl AS (SELECT doc_id, file_name, {clean_sql('text')} AS content FROM planted)"
NAMED = f"named AS (SELECT doc_id, lang, source, {X.PLANTED_FILE_NAME} AS file_name, text FROM documents)"

ORACLES["content_hash"] = "SELECT doc_id, md5(text) AS hash_id FROM documents"
ORACLES["clean_text"] = f"WITH {PLANTED}, {CLEANED} SELECT doc_id, content FROM cl"
ORACLES["is_resume_v1"] = f"WITH {PLANTED}, {CLEANED} SELECT doc_id, {IS_RESUME_V1} AS is_resume FROM cl"
ORACLES["is_resume_v2"] = f"WITH {PLANTED}, {CLEANED} SELECT doc_id, {IS_RESUME_V2} AS is_resume FROM cl"
for _k, _pat, _out in [("extract_emails", L.EMAIL_PATTERN, "emails"),
                       ("extract_linkedin", L.LINKEDIN_PATTERN, "linkedin"),
                       ("extract_github", L.GITHUB_PATTERN, "github"),
                       ("extract_urls", L.URL_PATTERN, "urls")]:
    ORACLES[_k] = (f"WITH {PLANTED}, {CLEANED} SELECT doc_id, "
                   f"{_list_str(f'regexp_extract_all(content, {chr(39)}{_sq(_pat)}{chr(39)})')} AS {_out} FROM cl")
ORACLES["extract_phones"] = f"WITH {PLANTED}, {CLEANED} SELECT doc_id, {phones_sql('content')} AS phone_numbers FROM cl"
ORACLES["contact_info"] = f"WITH {PLANTED}, {CLEANED} SELECT doc_id, {contact_cols('content')} FROM cl"

# D3: the five substitutions with Python's Unicode whitespace, then trim.
def re2_space(p: str) -> str:
    """Python ``\\s`` (Unicode) for RE2, inside or outside a character class."""
    inner = r"\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}"
    out, in_class, i = [], False, 0
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            out.append(inner if (p[i + 1] == "s" and in_class) else
                       f"[{inner}]" if p[i + 1] == "s" else p[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


_D3 = "html"
for _pat, _rep in L.HTML_CLEAN_STEPS:
    _D3 = f"regexp_replace({_D3}, '{_sq(re2_space(_pat))}', '{_sq(_rep)}', 'g')"
ORACLES["clean_html_text"] = f"SELECT page_id, trim({_D3}) AS text FROM pages"

# Drop comments/doctype/script/style, tags -> newline, entities, split lines, trim, drop blanks.
_D4 = (r"regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<script\b[^>]*>.*?</script\s*>|"
       r"<style\b[^>]*>.*?</style\s*>', chr(10), 'g')")
_D4 = rf"""regexp_replace({_D4}, '(?s)<[a-zA-Z/!?](?:[^>"'']|"[^"]*"|''[^'']*'')*>|<[a-zA-Z/!?][^>]*>', chr(10), 'g')"""
for _ent, _ch in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", "\u00a0"), ("amp", "&")):
    _D4 = f"regexp_replace({_D4}, '&{_ent};?', chr({ord(_ch)}), 'g')"
ORACLES["html_to_text"] = (
    "SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array("
    + _D4 + r", '\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]'), "
    r"lambda x: regexp_replace(x, '^[\s\p{Z}\x{85}\x{1c}-\x{1f}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}]+$', '', 'g')), "
    "lambda x: x <> ''), chr(10)) AS text FROM pages")

# C1
ORACLES["route_by_extension"] = (
    f"WITH {NAMED} SELECT doc_id, file_name, CASE WHEN lower(file_name) LIKE '%.pdf' THEN 'pdf' "
    "WHEN lower(file_name) LIKE '%.doc' OR lower(file_name) LIKE '%.docx' THEN 'doc' "
    "WHEN lower(file_name) LIKE '%.html' THEN 'html' ELSE 'unsupported' END AS kind FROM named")

# Raw documents against the ledger of labelled documents.
ORACLES["dedup_vs_ledger"] = (
    "WITH led AS (" + X.PRIOR_LEDGER_SQL.format(t="documents") + ") "
    "SELECT doc_id, md5(text) AS hash_id, md5(text) IN (SELECT hash_id FROM led) AS is_duplicate FROM documents")

# Planted files, ledger of labelled planted documents.
_OUTCOME = (
    f"WITH {PLANTED}, led AS (" + X.PRIOR_LEDGER_SQL.format(t="planted") + "), "
    "r AS (SELECT doc_id, file_name, text, CASE WHEN lower(file_name) LIKE '%.pdf' THEN 'pdf' "
    "WHEN lower(file_name) LIKE '%.doc' OR lower(file_name) LIKE '%.docx' THEN 'doc' "
    "WHEN lower(file_name) LIKE '%.html' THEN 'html' ELSE 'unsupported' END AS kind FROM planted), "
    "h AS (SELECT *, CASE WHEN kind <> 'unsupported' AND text IS NOT NULL THEN md5(text) END AS hash_id FROM r), "
    "o AS (SELECT *, CASE WHEN hash_id IS NULL THEN 'unprocessed' "
    "WHEN hash_id IN (SELECT hash_id FROM led) THEN 'duplicate' ELSE 'kept' END AS outcome FROM h), "
    f"k AS (SELECT *, CASE WHEN outcome = 'kept' THEN {clean_sql('text')} END AS content FROM o) "
)
ORACLES["outcome_routing"] = (
    _OUTCOME + f"SELECT doc_id, file_name, kind, outcome, hash_id, "
    f"CASE WHEN outcome = 'kept' THEN {IS_RESUME_V1} END AS is_resume, "
    + ", ".join(f"CASE WHEN outcome = 'kept' THEN {expr} END AS {name}" for expr, name in [
        (_list_str(f"regexp_extract_all(content, '{_sq(L.EMAIL_PATTERN)}')"), "emails"),
        (phones_sql("content"), "phone_numbers"),
        (_list_str(f"regexp_extract_all(content, '{_sq(L.LINKEDIN_PATTERN)}')"), "linkedin"),
        (_list_str(f"regexp_extract_all(content, '{_sq(L.GITHUB_PATTERN)}')"), "github"),
        (_list_str(f"regexp_extract_all(content, '{_sq(L.URL_PATTERN)}')"), "urls")])
    + " FROM k")
ORACLES["run_summary"] = (
    _OUTCOME + "SELECT count(*) AS total_files_processed, "
    "count(*) FILTER (WHERE outcome = 'duplicate') AS total_duplicates_count, "
    f"count(*) FILTER (WHERE outcome = 'kept' AND {IS_RESUME_V1}) AS total_resumes_detected, "
    "count(*) FILTER (WHERE outcome = 'unprocessed') AS unprocessed_documents_count FROM k "
    "WHERE regexp_matches(lower(file_name), '\\.(pdf|doc|docx|html)$')")

# F8
ORACLES["duplicate_groups"] = (
    "SELECT md5(text) AS hash_id, count(*) AS copies, min(doc_id) AS keeper FROM documents "
    "GROUP BY 1 HAVING count(*) >= 2")

# B12 / F2
ORACLES["batched_flush"] = (
    f"WITH {NAMED} SELECT doc_id, file_name, "
    "CAST(floor((row_number() OVER (ORDER BY file_name) - 1) / 100) + 1 AS BIGINT) AS batch_index FROM named")
ORACLES["batch_counters"] = (
    _OUTCOME + ", b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY file_name) - 1) / 100) + 1 AS BIGINT) "
    f"AS batch_index, CASE WHEN outcome = 'kept' THEN {IS_RESUME_V1} END AS is_resume FROM k), "
    "per AS (SELECT batch_index, count(*) AS files, "
    "count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates, "
    "count(*) FILTER (WHERE outcome = 'kept' AND is_resume) AS resumes, "
    "count(*) FILTER (WHERE outcome = 'unprocessed') AS unprocessed FROM b GROUP BY 1) "
    "SELECT *, CAST(sum(files) OVER w AS BIGINT) AS total_files, "
    "CAST(sum(duplicates) OVER w AS BIGINT) AS total_duplicates, "
    "CAST(sum(resumes) OVER w AS BIGINT) AS total_resumes, "
    "CAST(sum(unprocessed) OVER w AS BIGINT) AS total_unprocessed FROM per "
    "WINDOW w AS (ORDER BY batch_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")

# D14-D19
ORACLES["file_basename"] = (
    f"WITH {NAMED} SELECT doc_id, split_part(concat_ws('/', 'input', source, file_name), '/', -1) AS base_name FROM named")
ORACLES["strip_suffix"] = (
    f"WITH {NAMED} SELECT doc_id, left(file_name || '.npz', greatest(length(file_name || '.npz') - 4, 0)) "
    "AS document_name, replace(file_name || '.npz', '.npz', '') AS without_npz FROM named")
ORACLES["swap_extension"] = (
    "WITH b AS (SELECT page_id, split_part(url, '/', -1) AS n FROM pages) "
    r"SELECT page_id, CASE WHEN regexp_matches(n, '[^./]\.[^./]*$') "
    r"THEN regexp_replace(n, '\.[^./]*$', '') ELSE n END || '.parquet' AS parquet_name FROM b")
ORACLES["iso_timestamps"] = (
    "SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') "
    "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS created_time, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
ORACLES["request_key"] = "SELECT item_id, sha256(concat_ws('|', text, '5')) AS cache_key FROM benchmark"

# Recursive-CTE chunker over cleaned planted text (prefix sums + as-of joins).
ORACLES["chunk_text"] = f"""WITH RECURSIVE {PLANTED},
cl AS (SELECT doc_id, {clean_sql('text')} AS c FROM planted),
w AS MATERIALIZED (SELECT doc_id, unnest(string_split(c, ' ')) t, generate_subscripts(string_split(c, ' '), 1) - 1 i
                   FROM cl WHERE c <> ''),
p AS MATERIALIZED (SELECT doc_id, i, t, sum(length(t) + CASE WHEN i > 0 THEN 1 ELSE 0 END)
                   OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) hi FROM w),
b AS MATERIALIZED (SELECT doc_id, i, hi, hi - length(t) - CASE WHEN i > 0 THEN 1 ELSE 0 END lo FROM p),
ends AS MATERIALIZED (SELECT a.doc_id, a.i s, a.lo, x.i + 1 e, x.hi cum_e FROM b a
                      ASOF JOIN b x ON a.doc_id = x.doc_id AND a.lo + {L.CHUNK_SIZE} >= x.hi),
nxt AS MATERIALIZED (SELECT n.doc_id, n.s, n.e, greatest(n.s, f.i) s2 FROM (
    SELECT m.doc_id, m.s, m.e, greatest(m.cum_e - {L.CHUNK_OVERLAP}, q.hi - {L.CHUNK_SIZE}) thr FROM ends m
    JOIN b q ON q.doc_id = m.doc_id AND q.i = m.e) n
    ASOF JOIN b f ON n.doc_id = f.doc_id AND n.thr <= f.lo),
r AS (SELECT doc_id, 0 ci, 0::BIGINT s FROM cl WHERE c <> ''
      UNION ALL SELECT r.doc_id, ci + 1, s2 FROM r JOIN nxt USING (doc_id, s))
SELECT r.doc_id, ci AS chunk_index, string_agg(p.t, ' ' ORDER BY p.i) AS chunk_text
FROM r JOIN ends USING (doc_id, s) JOIN p ON p.doc_id = r.doc_id AND p.i >= r.s AND p.i < ends.e
GROUP BY 1, 2"""

# C2 / C3
_CAND = ("cand AS (SELECT doc_id, CASE lang WHEN 'de' THEN NULL WHEN 'fr' THEN '' ELSE text END AS c1, "
         "concat('[2] ', text) AS c2 FROM documents)")
ORACLES["first_success_nonempty"] = f"WITH {_CAND} SELECT doc_id, coalesce(nullif(c1, ''), c2) AS text FROM cand"
ORACLES["first_success"] = f"WITH {_CAND} SELECT doc_id, coalesce(c1, c2) AS text FROM cand"

# Run artifacts: the prior run ingested the labelled documents with an empty ledger.
_KIND = ("CASE WHEN lower(file_name) LIKE '%.pdf' THEN 'pdf' WHEN lower(file_name) LIKE '%.doc' "
         "OR lower(file_name) LIKE '%.docx' THEN 'doc' WHEN lower(file_name) LIKE '%.html' THEN 'html' "
         "ELSE 'unsupported' END")
_PRIOR = (f"{PLANTED}, prior AS (SELECT doc_id, file_name, text, {_KIND} AS kind FROM planted "
          "WHERE doc_id IN (SELECT doc_id FROM labels)), "
          f"prior_kept AS (SELECT doc_id, file_name, md5(text) AS hash_id, {clean_sql('text')} AS content "
          "FROM prior WHERE kind <> 'unsupported' AND text IS NOT NULL)")
_CUR = ("led AS (SELECT DISTINCT md5(text) AS hash_id FROM planted WHERE doc_id IN (SELECT doc_id FROM labels)), "
        f"cur AS (SELECT doc_id, file_name, text, {_KIND} AS kind, "
        f"CASE WHEN {_KIND} <> 'unsupported' AND text IS NOT NULL THEN md5(text) END AS hash_id FROM planted), "
        "cur_o AS (SELECT *, CASE WHEN hash_id IS NULL THEN 'unprocessed' WHEN hash_id IN (SELECT hash_id FROM led) "
        "THEN 'duplicate' ELSE 'kept' END AS outcome FROM cur), "
        f"kept AS (SELECT file_name AS key, hash_id, {clean_sql('text')} AS content FROM cur_o WHERE outcome = 'kept')")
ORACLES["read_docmap"] = (
    f"WITH {PLANTED}, {_CUR} SELECT key, content, hash_id, {IS_RESUME_V1} AS is_resume, "
    f"{_list_str(f'regexp_extract_all(content, {chr(39)}{_sq(L.EMAIL_PATTERN)}{chr(39)})')} AS emails, "
    f"{phones_sql('content')} AS phone_numbers FROM kept")
ORACLES["exclude_html_keys"] = f"WITH {PLANTED}, {_CUR} SELECT key FROM kept WHERE NOT contains(key, '.html')"
ORACLES["project_defaults"] = (f"WITH {PLANTED}, {_CUR} SELECT key, coalesce(content, '') AS content, "
                               "coalesce(hash_id, '') AS hash_id FROM kept WHERE NOT contains(key, '.html')")
ORACLES["resume_only"] = (f"WITH {PLANTED}, {_CUR} SELECT key, hash_id FROM kept "
                          f"WHERE NOT contains(key, '.html') AND {IS_RESUME_V1}")
ORACLES["read_hash_ledger"] = (
    f"WITH {_PRIOR} SELECT file_name, hash_id, CASE WHEN {IS_RESUME_V1} THEN 'True' ELSE 'False' END "
    "AS is_resume FROM prior_kept")
ORACLES["distinct_hashes"] = f"WITH {_PRIOR} SELECT DISTINCT hash_id FROM prior_kept"
ORACLES["union_ledgers"] = (f"WITH {_PRIOR}, {_CUR} SELECT hash_id FROM prior_kept UNION "
                            "SELECT hash_id FROM kept")
_SUCCESS = (f"{NAMED}, ok AS (SELECT DISTINCT file_name AS document_name FROM named JOIN labels USING (doc_id) "
            "WHERE quality = 1)")
ORACLES["read_success_ledger"] = f"WITH {_SUCCESS} SELECT document_name FROM ok"
ORACLES["pending_documents"] = (f"WITH {_SUCCESS} SELECT doc_id, file_name AS document_name FROM named "
                                "WHERE file_name NOT IN (SELECT document_name FROM ok)")
ORACLES["pending_files"] = (
    f"WITH {NAMED} SELECT doc_id, file_name || '.npz' AS file_name FROM named WHERE doc_id NOT IN "
    "(SELECT doc_id FROM labels WHERE toxic = 0)")
ORACLES["merge_duplicates"] = (
    f"WITH {PLANTED}, {_CUR}, bo AS (SELECT file_name, outcome, CAST(floor((row_number() OVER "
    "(ORDER BY file_name) - 1) / 100) + 1 AS BIGINT) AS batch_index FROM cur_o) "
    "SELECT file_name, batch_index, outcome AS list FROM bo WHERE outcome IN ('duplicate', 'unprocessed')")
ORACLES["row_counts_per_file"] = (
    f"WITH {_PRIOR}, pb AS (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY file_name) - 1) / 100) + 1 "
    "AS BIGINT) AS batch_index FROM prior), "
    "per AS (SELECT batch_index, count(*) AS rows FROM prior_kept JOIN pb USING (doc_id) GROUP BY 1) "
    "SELECT batch_index, CAST(rows AS BIGINT) AS rows, CAST(1 AS BIGINT) AS files FROM per "
    "UNION ALL SELECT NULL, CAST(sum(rows) AS BIGINT), CAST(count(*) AS BIGINT) FROM per")
ORACLES["scan_allowlist"] = (f"WITH {NAMED} SELECT doc_id, file_name FROM named "
                             "WHERE doc_id IN (SELECT doc_id FROM labels)")
ORACLES["assemble_pages"] = ("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text "
                             "FROM conversations GROUP BY conv_id")

# Vectors: label centroids are the query set; cosine in double, rounded to 6.
_CENT = ("c AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, "
         "generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i), "
         "q AS (SELECT label AS query_id, list(m ORDER BY i) AS qv FROM c GROUP BY label)")
ORACLES["cosine_similarity"] = (
    f"WITH {_CENT} SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.qv), 6) AS score "
    "FROM embeddings e JOIN q ON e.label = q.query_id")
ORACLES["l2_normalize"] = (
    "SELECT vec_id, CASE WHEN sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) > 0 "
    "THEN list_transform(embedding, lambda x: round(((x::DOUBLE / sqrt(list_sum(list_transform(embedding, "
    "lambda y: y::DOUBLE * y::DOUBLE))))::FLOAT)::DOUBLE, 6)) END AS vector FROM embeddings")
ORACLES["validate_vector_dim"] = (
    "SELECT vec_id, (embedding IS NOT NULL AND len(embedding) = 64 AND "
    "len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0) AS valid FROM embeddings")
ORACLES["vector_topk"] = (
    "WITH c AS (SELECT i, avg(x::DOUBLE) AS m FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) "
    "AS i FROM embeddings) GROUP BY i), q AS (SELECT list(m ORDER BY i) AS qv FROM c), "
    "s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.qv), 6) AS score FROM embeddings, q) "
    "SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 5")
_TOPK = (f"WITH {_CENT}, s AS (SELECT q.query_id, e.vec_id, "
         "round(list_cosine_similarity(e.embedding::DOUBLE[], q.qv), 6) AS score FROM embeddings e, q), "
         "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) ")
ORACLES["vector_topk_batch"] = _TOPK + "SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5"
_PTS = (f"{NAMED}, pts AS (SELECT e.vec_id, e.label, e.embedding, n.file_name || '.npz' AS document_name, "
        "sha256(concat_ws(chr(1), n.file_name || '.npz', '0')) AS id FROM embeddings e "
        "JOIN named n ON e.vec_id = n.doc_id)")
ORACLES["project_hits"] = (
    f"WITH {_PTS}, c AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, "
    "generate_subscripts(embedding, 1) AS i FROM pts) GROUP BY label, i), "
    "q AS (SELECT label AS query_id, list(m ORDER BY i) AS qv FROM c GROUP BY label), "
    "s AS (SELECT q.query_id, p.id, p.document_name, round(list_cosine_similarity(p.embedding::DOUBLE[], q.qv), 6) "
    "AS score FROM pts p, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) "
    "AS rank FROM s) SELECT query_id, id AS text_id, CAST(NULL AS VARCHAR) AS text, document_name, score "
    "FROM r WHERE rank <= 5")
_NORMV = ("list_transform(embedding, lambda x: round(((x::DOUBLE / sqrt(list_sum(list_transform(embedding, "
          "lambda y: y::DOUBLE * y::DOUBLE))))::FLOAT)::DOUBLE, 6))")
ORACLES["upsert_points"] = (
    f"WITH {_PTS} SELECT vec_id, CASE WHEN vec_id IN (SELECT doc_id FROM labels) THEN {_NORMV} "
    "ELSE list_transform(embedding, lambda x: round(x::DOUBLE, 6)) END AS vector FROM pts")
ORACLES["delete_points"] = (f"WITH {_PTS} SELECT vec_id FROM pts WHERE vec_id NOT IN "
                            "(SELECT doc_id FROM labels WHERE toxic = 1)")
_MD5_32 = "CAST('0x' || substr(md5(id), 1, 8) AS BIGINT)"
ORACLES["shard_layout"] = f"WITH {_PTS} SELECT vec_id, CAST({_MD5_32} % 4 AS INTEGER) AS shard FROM pts"
ORACLES["collection_versions"] = (
    f"WITH {_PTS}, b AS (SELECT vec_id, CAST({_MD5_32} % 16 AS INTEGER) AS bucket FROM pts), "
    "v AS (SELECT bucket, unnest([1, 2] || CASE WHEN vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN [] ELSE [3] END) "
    "AS version FROM b) SELECT CAST(version AS BIGINT) AS version, bucket, count(*) AS points FROM v GROUP BY ALL")
ORACLES["collection_quarantine"] = (
    f"WITH {_PTS} SELECT vec_id, CASE label WHEN 1 THEN 'dimension' WHEN 2 THEN 'no vector' WHEN 3 THEN 'no id' "
    "WHEN 4 THEN 'component' END AS reason FROM pts")
ORACLES["read_vectors"] = (f"WITH {_PTS} SELECT document_name, list_transform(embedding, lambda x: "
                           "round(x::DOUBLE, 6)) AS vector FROM pts")

# ------------------------------------------------------------------ search
def _emb(bk: str, dim: int = 64) -> str:
    return f"list_transform(range({dim}), lambda i: len(list_filter({bk}, lambda b: b = i))::FLOAT)"


def _buckets(text: str, dim: int = 64) -> str:
    return (f"list_transform(string_split(lower({text}), ' '), "
            f"lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim})")


_TERMS = r"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}]+'))"


def _cov(q: str, d: str) -> str:
    return f"(CASE WHEN len({q}) > 0 THEN len(list_intersect({q}, {d})) / len({q}) ELSE 0.0 END)"


def _turn(r: int) -> str:
    """Every fourth sentence, from the one whose number leaves ``r``."""
    return f"array_to_string(list_filter(sents, lambda x, j: j % 4 = {r}), ' ')"


_RES_CHUNKS = f"""res AS (SELECT key, content FROM kept WHERE NOT contains(key, '.html') AND {IS_RESUME_V1}),
w AS MATERIALIZED (SELECT key AS doc_id, unnest(string_split(content, ' ')) t,
                   generate_subscripts(string_split(content, ' '), 1) - 1 i FROM res WHERE content <> ''),
p AS MATERIALIZED (SELECT doc_id, i, t, sum(length(t) + CASE WHEN i > 0 THEN 1 ELSE 0 END)
                   OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) hi FROM w),
b AS MATERIALIZED (SELECT doc_id, i, hi, hi - length(t) - CASE WHEN i > 0 THEN 1 ELSE 0 END lo FROM p),
ends AS MATERIALIZED (SELECT a.doc_id, a.i s, a.lo, x.i + 1 e, x.hi cum_e FROM b a
                      ASOF JOIN b x ON a.doc_id = x.doc_id AND a.lo + {L.CHUNK_SIZE} >= x.hi),
nxt AS MATERIALIZED (SELECT n.doc_id, n.s, n.e, greatest(n.s, f.i) s2 FROM (
    SELECT m.doc_id, m.s, m.e, greatest(m.cum_e - {L.CHUNK_OVERLAP}, q.hi - {L.CHUNK_SIZE}) thr FROM ends m
    JOIN b q ON q.doc_id = m.doc_id AND q.i = m.e) n
    ASOF JOIN b f ON n.doc_id = f.doc_id AND n.thr <= f.lo),
r AS (SELECT key AS doc_id, 0 ci, 0::BIGINT s FROM res WHERE content <> ''
      UNION ALL SELECT r.doc_id, ci + 1, s2 FROM r JOIN nxt USING (doc_id, s)),
ch AS (SELECT r.doc_id AS key, ci AS chunk_index, string_agg(p.t, ' ' ORDER BY p.i) AS chunk_text
       FROM r JOIN ends USING (doc_id, s) JOIN p ON p.doc_id = r.doc_id AND p.i >= r.s AND p.i < ends.e
       GROUP BY 1, 2),
pv AS (SELECT key, chunk_index, sha256(concat_ws(chr(1), key || '.npz', CAST(chunk_index AS VARCHAR))) AS text_id,
       {_buckets('chunk_text')} AS bk FROM ch)"""

_SEARCH = f"""WITH RECURSIVE {PLANTED}, {_CUR}, {_RES_CHUNKS},
jq AS (SELECT item_id AS query_id, {clean_sql('text')} AS jt FROM benchmark),
qv AS (SELECT query_id, jt, {_buckets('jt')} AS bk FROM jq),
s AS (SELECT qv.query_id, pv.key, pv.text_id,
      round(list_cosine_similarity({_emb('pv.bk')}::DOUBLE[], {_emb('qv.bk')}::DOUBLE[]), 6) AS score FROM pv, qv),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, text_id) AS rank
        FROM s WHERE score IS NOT NULL AND NOT isnan(score)) WHERE rank <= 5),
req AS (SELECT query_id, jt, regexp_split_to_array(jt, '[.!?]') AS sents FROM jq),
reqt AS (SELECT query_id, jt, {_TERMS.format(x=_turn(1))} AS sk, {_TERMS.format(x=_turn(2))} AS ex,
         {_TERMS.format(x=_turn(3))} AS pr, {_TERMS.format(x=_turn(0))} AS ed FROM req),
hit AS (SELECT top.*, res.content, {_TERMS.format(x='res.content')} AS dt FROM top JOIN res USING (key)),
sc AS (SELECT hit.*, reqt.jt, reqt.sk, reqt.ex, reqt.pr, reqt.ed,
       {_cov('reqt.sk', 'dt')} AS c_sk, {_cov('reqt.ex', 'dt')} AS c_ex,
       {_cov('reqt.pr', 'dt')} AS c_pr, {_cov('reqt.ed', 'dt')} AS c_ed FROM hit JOIN reqt USING (query_id)),
sc2 AS (SELECT *, (0.4::DOUBLE * c_sk + 0.3::DOUBLE * c_ex + 0.2::DOUBLE * c_pr + 0.1::DOUBLE * c_ed) * 100.0::DOUBLE
        AS raw_score FROM sc),
fin AS (SELECT *, round(raw_score, 6) AS match_score FROM sc2)"""

ORACLES["embed_text"] = (f"WITH RECURSIVE {PLANTED}, {_CUR}, {_RES_CHUNKS} "
                         f"SELECT key, chunk_index, {_emb('bk')} AS vector FROM pv")
ORACLES["vectors_per_document"] = (
    f"WITH RECURSIVE {PLANTED}, {_CUR}, {_RES_CHUNKS} SELECT key || '.npz' AS document_name, "
    f"CAST(count(*) AS BIGINT) AS n_vectors, list(list_transform({_emb('bk')}, lambda x: round(x::DOUBLE, 6)) "
    "ORDER BY chunk_index) AS vectors FROM pv GROUP BY key")
_RES = f"WITH RECURSIVE {PLANTED}, {_CUR}, {_RES_CHUNKS}"
ORACLES["embed_job"] = (
    f"{_RES} SELECT key AS document_name, 'success' AS status, '' AS error_message FROM res UNION ALL "
    "SELECT key, 'fail', 'ValueError: no content' FROM res WHERE length(key) % 2 = 1")
ORACLES["embed_job_points"] = (
    f"{_RES} SELECT key || '.npz' AS document_name, count(*) AS n_vectors FROM pv GROUP BY key")
# Index over both runs: the prior run's kept files (batches over all its files) and the current run's.
ORACLES["build_index"] = (
    f"WITH {_PRIOR}, {_CUR}, pb AS (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY file_name) - 1) / 100) "
    "+ 1 AS BIGINT) AS batch_index FROM prior), "
    "l1 AS (SELECT file_name AS document_name, 1 AS run, batch_index FROM prior_kept JOIN pb USING (doc_id)), "
    "l2 AS (SELECT key AS document_name, 2 AS run, CAST(floor((row_number() OVER (ORDER BY key) - 1) / 100) + 1 "
    "AS BIGINT) AS batch_index FROM kept), u AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2) "
    "SELECT document_name, CAST(max(run) AS BIGINT) AS run, "
    "CAST(arg_max(batch_index, run * 1000000 + batch_index) AS BIGINT) AS batch_index FROM u GROUP BY 1")
_B2 = ("kb AS (SELECT key, CAST(floor((row_number() OVER (ORDER BY key) - 1) / 100) + 1 AS BIGINT) AS batch_index "
       "FROM kept)")
ORACLES["hits_to_index"] = (
    _SEARCH + f", {_B2} SELECT query_id, key AS document_name, text_id, score, CAST(rank AS BIGINT) AS rank, "
    "CAST(2 AS BIGINT) AS run, batch_index FROM top JOIN kb USING (key)")
ORACLES["index_to_content"] = (
    _SEARCH + " SELECT query_id, key AS document_name, text_id, score, length(content) AS content_chars, "
    "md5(content) AS content_md5 FROM hit WHERE content IS NOT NULL AND length(content) > 0")
ORACLES["existing_files_semi"] = _SEARCH + " SELECT query_id, key AS document_name, text_id FROM hit"
ORACLES["weighted_match_score"] = _SEARCH + " SELECT query_id, text_id, match_score FROM fin"
ORACLES["search_ranked"] = (
    _SEARCH + " SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, "
    "score DESC, text_id) AS BIGINT) AS match_rank, key AS document_name, text_id, score, match_score FROM fin")
_PROMPT = ("printf('Analyze and quantify the relevance between the provided job description and candidate''s "
           "resume.' || chr(10) || chr(10) || 'Job Description: %s' || chr(10) || 'Resume: %s' || chr(10), "
           "jt, content)")
ORACLES["build_prompts"] = (_SEARCH + f" SELECT query_id, text_id, length({_PROMPT}) AS prompt_chars, "
                            f"md5({_PROMPT}) AS prompt_md5 FROM fin")
_ANA = (_SEARCH + f", an AS (SELECT *, false AS parse_error, "
        "printf('%d%%', CAST(round(raw_score) AS INTEGER)) AS overall, "
        "CASE WHEN c_ex >= 0.5 THEN 'High' WHEN c_ex >= 0.2 THEN 'Medium' ELSE 'Low' END AS quality FROM fin)")
ORACLES["parse_match_json"] = (
    _ANA + " SELECT query_id, text_id, parse_error, CASE WHEN NOT parse_error THEN overall END AS overall_match_score, "
    "CASE WHEN NOT parse_error THEN quality END AS experience_quality FROM an")
ORACLES["overall_score_numeric"] = (
    _ANA + " SELECT query_id, text_id, CASE WHEN parse_error THEN 0.0 ELSE CAST(round(raw_score) AS INTEGER)::DOUBLE "
    "END AS overall_score FROM an")
ORACLES["rank_by_match"] = (
    _ANA + ", o AS (SELECT *, CASE WHEN parse_error THEN 0.0 ELSE CAST(round(raw_score) AS INTEGER)::DOUBLE END "
    "AS overall_score FROM an) SELECT query_id, text_id, overall_score, CAST(row_number() OVER (PARTITION BY query_id "
    "ORDER BY overall_score DESC, score DESC, text_id) AS BIGINT) AS match_rank FROM o")
_PCT = "printf('%d%%', CAST(round({x} * 100) AS INTEGER))"
ORACLES["skill_rows"] = (
    _ANA + " SELECT query_id, text_id, 'Technical Skills' AS skill_type, " + _PCT.format(x="c_sk") + " AS match "
    "FROM an WHERE NOT parse_error UNION ALL SELECT query_id, text_id, 'Soft Skills', " + _PCT.format(x="c_ex")
    + " FROM an WHERE NOT parse_error UNION ALL SELECT query_id, text_id, 'Certifications', "
    + _PCT.format(x="c_ed") + " FROM an WHERE NOT parse_error")
ORACLES["project_rows"] = (
    _ANA + ", pj AS (SELECT query_id, text_id, c_pr, unnest(list_sort(list_intersect(pr, dt))) AS t FROM an "
    "WHERE NOT parse_error) SELECT query_id, text_id, t AS Project_Name, 'uses ' || t AS Description, "
    "round(c_pr, 4) AS Relevance_Score FROM pj")
ORACLES["strength_gap_rows"] = (
    _ANA + " SELECT query_id, text_id, 'strength' AS kind, CAST(NULL AS VARCHAR) AS key, unnest(list_sort("
    "list_intersect(sk, dt))) AS value FROM an WHERE NOT parse_error "
    "UNION ALL SELECT query_id, text_id, 'gap', NULL, unnest(list_sort(list_filter(sk, lambda x: NOT list_contains("
    "dt, x)))) FROM an WHERE NOT parse_error "
    "UNION ALL SELECT query_id, text_id, 'recommendation', 'next_step', CASE WHEN raw_score >= 50 THEN 'interview' "
    "ELSE 'review' END FROM an WHERE NOT parse_error")
ORACLES["memo_lookup"] = (
    _SEARCH + " SELECT sha256(concat_ws('|', jt, '5')) AS request_key, query_id, text_id, match_score, "
    "CAST(row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, score DESC, text_id) AS BIGINT) "
    "AS match_rank FROM fin")

# ------------------------------------------------------------------ features
_STOP = "[" + ", ".join("'" + _sq(w) + "'" for w in L.ENGLISH_STOP_WORDS) + "]"


def _feat_sql(view: str, name: str) -> str:
    return (f"WITH {view}, corp AS (SELECT file_name AS key, coalesce({clean_sql('text')}, '') AS content FROM {name}), "
            "tok AS (SELECT key, string_split(lower(content), ' ') AS words FROM corp), "
            f"flt AS (SELECT key, words, list_filter(words, lambda w: NOT list_contains({_STOP}, w)) AS f FROM tok), "
            "ng AS (SELECT key, words, f, list_transform(range(len(f) - 1), lambda i: f[i + 1] || ' ' || f[i + 2]) AS bi, "
            "list_transform(range(len(f) - 2), lambda i: f[i + 1] || ' ' || f[i + 2] || ' ' || f[i + 3]) AS tri FROM flt)")


_FEAT = _feat_sql(NAMED, "named")
ORACLES["tokenize"] = _FEAT + (" SELECT key, CAST(len(words) AS BIGINT) AS n_words, "
                               "array_to_string(words, '|') AS words FROM ng")
ORACLES["remove_stopwords"] = _FEAT + " SELECT key, array_to_string(f, '|') AS filtered_words FROM ng"
# All documents, with the planted part of their texts; concat takes a null text as empty.
ORACLES["bigrams"] = _feat_sql(PLANTED, "planted") + " SELECT key, array_to_string(bi, '|') AS bigrams FROM ng"
ORACLES["trigrams"] = _FEAT + " SELECT key, array_to_string(tri, '|') AS trigrams FROM ng"
ORACLES["combined_terms"] = _FEAT + (" SELECT key, concat_ws(' ', nullif(array_to_string(f, ' '), ''), "
                                     "nullif(array_to_string(bi, ' '), ''), nullif(array_to_string(tri, ' '), '')) "
                                     "AS combined FROM ng")
ORACLES["tfidf_terms"] = _FEAT + (
    ", t AS (SELECT key, unnest(tri) AS term FROM ng), tf AS (SELECT key, term, count(*) AS tf FROM t GROUP BY 1, 2), "
    "dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM corp) "
    "SELECT key, term, tf, df, round(tf * ln((n + 1.0) / (df + 1.0)), 6) AS tfidf FROM tf JOIN dfq USING (term), n")

# ------------------------------------------------------------------ streaming
ORACLES["stream_dedup"] = "SELECT DISTINCT md5(text) AS hash_id FROM documents"

# ------------------------------------------------------------------ remaining keyed rows
ORACLES["write_hash_ledger"] = (
    f"WITH {PLANTED}, {_CUR} SELECT key AS file_name, hash_id, CASE WHEN {IS_RESUME_V1} THEN 'True' "
    "ELSE 'False' END AS is_resume FROM kept")
ORACLES["point_ids"] = ORACLES["chunk_text"].replace(
    "cl AS (SELECT doc_id, ", "cl AS (SELECT doc_id, file_name, ").replace(
    "SELECT r.doc_id, ci AS chunk_index, string_agg(p.t, ' ' ORDER BY p.i) AS chunk_text\n"
    "FROM r JOIN ends USING (doc_id, s) JOIN p ON p.doc_id = r.doc_id AND p.i >= r.s AND p.i < ends.e\n"
    "GROUP BY 1, 2",
    "SELECT r.doc_id, ci AS chunk_index, sha256(concat_ws(chr(1), cl.file_name || '.npz', CAST(ci AS VARCHAR))) "
    "AS id FROM r JOIN cl USING (doc_id)")
ORACLES["join_paths_by_name"] = (
    f"WITH {NAMED}, done AS (SELECT file_name AS filenames FROM named WHERE doc_id IN "
    "(SELECT doc_id FROM labels WHERE toxic = 0)) SELECT d.filenames, concat_ws('/', 'bucket', n.source, n.file_name) "
    "AS filepaths FROM done d JOIN named n ON n.file_name = d.filenames")
ORACLES["query_corpus_scores"] = (
    "WITH c AS (SELECT i, avg(x::DOUBLE) AS m FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) "
    "AS i FROM embeddings) GROUP BY i), q AS (SELECT list(m ORDER BY i) AS qv FROM c) "
    "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.qv), 6) AS score FROM embeddings, q")
ORACLES["idf"] = _FEAT + (
    ", t AS (SELECT key, unnest(tri) AS term FROM ng), tf AS (SELECT key, term, count(*) AS tf FROM t GROUP BY 1, 2), "
    "dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM corp) "
    "SELECT term, df, round(ln((n + 1.0) / (df + 1.0)), 6) AS idf FROM dfq, n")
