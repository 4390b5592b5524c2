"""SQL twins of the registered queries, for DuckDB over the same parquet tables."""

from __future__ import annotations

from ..functions.text import LINE_BREAKS, UNICODE_WHITESPACE, WHITESPACE
from ..operators.intents import DESCRIPTION_MESSAGE, FIELD_MESSAGES, FILE_MESSAGE
from .queries import CATEGORIES, FIELD_TEMPLATES, QUERY_TEMPLATES

# Distances that pass the threshold: 1 - d/64 > 0.65 and 1 - d/384 > 0.65.
PASS_64, PASS_384 = 22, 134


def _chars(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(value: str, chars: str) -> str:
    return f"regexp_replace(regexp_replace({value}, '^{_chars(chars)}+', ''), '{_chars(chars)}+$', '')"


def _normalized(value: str) -> str:
    return f"trim(regexp_replace(replace({value}, ',', ' '), '{_chars(WHITESPACE)}+', ' ', 'g'))"


def _clean(value: str) -> str:
    return f"replace(replace({value}, chr(10), ' '), chr(34), chr(39))"


FIXED = "floor({0} * 4294967296.0 + 0.5)::BIGINT"

# ---------------------------------------------------------------- embeddings
CELLS = """
cells AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x
          FROM embeddings),
flags AS (SELECT vec_id, pos, x * count(*) OVER w > sum(x) OVER w AS b FROM cells WINDOW w AS (PARTITION BY vec_id))
"""
LABELS = f"""
sums AS (SELECT label, pos, sum({FIXED.format("x")}) AS total FROM cells GROUP BY label, pos),
label_flags AS (SELECT label AS ord, 'label_' || label AS category, pos,
                       total * count(*) OVER w > sum(total) OVER w AS b
                FROM sums WINDOW w AS (PARTITION BY label))
"""
DISTANCES = """
dists AS (SELECT f.vec_id, l.ord, l.category, count(*) FILTER (WHERE f.b <> l.b) AS dist
          FROM flags f JOIN label_flags l USING (pos) GROUP BY f.vec_id, l.ord, l.category),
nearest AS (SELECT * FROM dists QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, ord) = 1)
"""
EMBEDDINGS = f"WITH {CELLS}, {LABELS}, {DISTANCES}"
MATCH_64 = "ord::BIGINT AS ord, category, dist::INTEGER AS dist, round(1 - dist / 64.0::DOUBLE, 6) AS score"

NEAREST_LABEL = f"{EMBEDDINGS} SELECT vec_id, {MATCH_64} FROM nearest"
TRIM_EMBEDDINGS = f"{EMBEDDINGS} SELECT vec_id, {MATCH_64} FROM nearest WHERE dist <= {PASS_64}"

# ---------------------------------------------------------------- hash encoder
HASHED = f"""
anchors AS (SELECT item_id, text FROM benchmark),
anchor_tokens AS (SELECT item_id, token, count(*) AS n FROM (
    SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM anchors)
    GROUP BY item_id, token),
corpus_tokens AS (SELECT key, token, count(*) AS n FROM (
    SELECT key, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM corpus)
    GROUP BY key, token),
vocabulary AS (SELECT token, md5(token || '#0') || md5(token || '#1') || md5(token || '#2') AS h FROM (
    SELECT token FROM anchor_tokens UNION SELECT token FROM corpus_tokens)),
signs AS (SELECT token, pos,
    ((('0x' || h[(pos // 4 + 1):(pos // 4 + 1)])::INTEGER >> (3 - pos % 4)) & 1) * 2 - 1 AS s
    FROM vocabulary, (SELECT unnest(range(384)) AS pos)),
anchor_sums AS (SELECT item_id, pos, sum(n * s)::DOUBLE AS x FROM anchor_tokens JOIN signs USING (token) GROUP BY item_id, pos),
anchor_units AS (SELECT item_id, pos, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS x FROM anchor_sums),
topic_sums AS (SELECT item_id % {CATEGORIES} AS ord, pos, sum({FIXED.format("x")}) AS total
    FROM anchor_units GROUP BY ord, pos),
topics AS (SELECT ord, 'topic_' || ord AS category, pos, total * count(*) OVER w > sum(total) OVER w AS b
    FROM topic_sums WINDOW w AS (PARTITION BY ord)),
corpus_sums AS (SELECT key, pos, sum(n * s) AS x FROM corpus_tokens JOIN signs USING (token) GROUP BY key, pos),
corpus_flags AS (SELECT key, pos, x * count(*) OVER w > sum(x) OVER w AS b FROM corpus_sums WINDOW w AS (PARTITION BY key)),
topic_ones AS (SELECT ord, category, count(*) FILTER (WHERE b) AS n FROM topics GROUP BY ord, category),
corpus_ones AS (SELECT key, count(*) FILTER (WHERE b) AS n FROM corpus_flags GROUP BY key),
shared AS (SELECT c.key, t.ord, count(*) AS n FROM corpus_flags c JOIN topics t USING (pos)
    WHERE c.b AND t.b GROUP BY c.key, t.ord),
dists AS (SELECT d.key, t.ord, t.category, coalesce(o.n, 0) + t.n - 2 * coalesce(s.n, 0) AS dist
    FROM corpus d CROSS JOIN topic_ones t LEFT JOIN corpus_ones o ON o.key = d.key
    LEFT JOIN shared s ON s.key = d.key AND s.ord = t.ord),
nearest AS (SELECT * FROM dists QUALIFY row_number() OVER (PARTITION BY key ORDER BY dist, ord) = 1)
"""
MATCH_384 = "ord::BIGINT AS ord, category, dist::INTEGER AS dist, round(1 - dist / 384.0::DOUBLE, 6) AS score"


def _hashed(corpus: str, select: str) -> str:
    return f"WITH corpus AS ({corpus}), {HASHED} {select}"


NO_CORPUS = "SELECT item_id AS key, text FROM benchmark"


# ---------------------------------------------------------------- intents
def _filled(template: str, values: dict[str, str]) -> str:
    result = _literal(template)
    for name, value in values.items():
        result = f"replace({result}, '{{{name}}}', {value})"
    return result


def _field_anchor_list(base: dict[str, str], extras: dict[str, str]) -> str:
    """SQL list of the sentences: all with the first values, then the further values."""
    sentences = [_filled(t, base) for t in FIELD_TEMPLATES]
    for name, value in extras.items():
        sentences += [_filled(t, {**base, name: value}) for t in FIELD_TEMPLATES]
    return "[" + ", ".join(sentences) + "]"


NATION_FIELDS = {
    "desiredOutcome": "'trade'",
    "importantDate": "'N/A'",
    "importantPeople": "'N/A'",
    "importantEvents": "r_name",
    "importantLocation": "n_name",
}
REQUESTS = """
requests AS (SELECT c_custkey AS request_id,
    CASE WHEN c_nationkey > 2 THEN c_nationkey > 12 END AS nl,
    CASE WHEN c_acctbal > 1000 THEN c_mktsegment || ' ' || c_name END AS description,
    c_mktsegment AS outcome, CASE WHEN c_acctbal > 9000 THEN '  ' ELSE '12/2/23' END AS date,
    CASE WHEN c_acctbal > 0 THEN c_name END AS people, 'audit, ' || lower(c_mktsegment) AS events,
    'N' || c_nationkey AS location, CASE WHEN c_acctbal < 8000 THEN 'in.zip' END AS file FROM customer)
"""
REQUEST_FIELDS = {
    "desiredOutcome": "outcome",
    "importantDate": "coalesce(nullif(trim(date), ''), 'N/A')",
    "importantPeople": "coalesce(people, 'N/A')",
    "importantEvents": "'audit'",
    "importantLocation": "location",
}
REQUEST_COLUMNS = dict(zip(FIELD_MESSAGES, ("outcome", "date", "people", "events", "location")))


def _missing(condition: str, message: str) -> str:
    return f"CASE WHEN {condition} THEN {_literal(message + ', ')} ELSE '' END"


MESSAGE = " || ".join(
    [_missing("trim(coalesce(file, '')) = ''", FILE_MESSAGE)]
    + [
        _missing(f"NOT coalesce(nl, false) AND trim(coalesce({REQUEST_COLUMNS[name]}, '')) = ''", text)
        for name, text in FIELD_MESSAGES.items()
    ]
    + [_missing("coalesce(nl, false) AND trim(coalesce(description, '')) = ''", DESCRIPTION_MESSAGE)]
)

# ---------------------------------------------------------------- lines of documents
LINES = f"""
lines AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS row_no, unnest(parts) AS line
          FROM (SELECT doc_id, regexp_split_to_array(text, '{_chars(LINE_BREAKS)}') AS parts FROM documents))
"""
NUMBERED = """
lines AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS row_no, unnest(parts) AS line
          FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
firsts AS (SELECT doc_id, length(line) AS size FROM lines WHERE row_no = 0)
"""
# The longest of (n, body) in the first row: n is '0', so body wins when it has more than one character.
PICKED = f"""
WITH {NUMBERED}
SELECT doc_id::VARCHAR AS filename, row_no::BIGINT AS row_no,
       CASE WHEN size > 1 THEN {_normalized("line")} ELSE row_no::VARCHAR END AS content
FROM lines JOIN firsts USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "binarize_vectors": f"""
        WITH {CELLS} SELECT vec_id, string_agg(CASE WHEN b THEN '1' ELSE '0' END, '' ORDER BY pos) AS bit_string,
        count(*) FILTER (WHERE b)::INTEGER AS ones FROM flags GROUP BY vec_id""",
    "unit_vectors": f"""
        WITH {CELLS} SELECT vec_id, pos::INTEGER AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x
        FROM cells""",
    "label_centroids": f"""
        WITH {CELLS}, {LABELS} SELECT label, pos::INTEGER AS pos, round(total::DOUBLE / 4294967296.0::DOUBLE, 6) AS total
        FROM sums""",
    "masked_pool": f"""
        WITH cells AS (SELECT label, embedding[1] > 0 AS keep, generate_subscripts(embedding, 1) - 1 AS pos,
                              unnest(embedding)::DOUBLE AS x FROM embeddings)
        SELECT label, pos::INTEGER AS pos, round(
            coalesce(sum({FIXED.format("x")}) FILTER (WHERE keep), 0)::DOUBLE / 4294967296.0::DOUBLE
            / greatest(count(*) FILTER (WHERE keep)::DOUBLE, 1e-9), 6) AS mean
        FROM cells GROUP BY label, pos""",
    "nearest_label": NEAREST_LABEL,
    "nearest_label_from_bits": NEAREST_LABEL,
    "tie_break": NEAREST_LABEL,
    "trim_embeddings": TRIM_EMBEDDINGS,
    "trim_stream_embeddings": TRIM_EMBEDDINGS,
    "score_matrix": f"{EMBEDDINGS} SELECT vec_id, {MATCH_64} FROM dists",
    "match_summary": f"""
        {EMBEDDINGS} SELECT category, count(*) AS n_rows, round(avg(1 - dist / 64.0::DOUBLE), 6) AS avg_score,
        round(max(1 - dist / 64.0::DOUBLE), 6) AS max_score FROM nearest WHERE dist <= {PASS_64} GROUP BY category""",
    "reduction": f"""
        {EMBEDDINGS} SELECT count(*)::BIGINT AS rows_in, count(*) FILTER (WHERE dist <= {PASS_64})::BIGINT AS rows_out,
        round(count(*) FILTER (WHERE dist <= {PASS_64})::DOUBLE / count(*), 6) AS kept FROM nearest""",
    "top_matches": f"""
        {EMBEDDINGS} SELECT category, row_number() OVER (PARTITION BY category ORDER BY dist, vec_id)::INTEGER AS rank,
        vec_id, dist::INTEGER AS dist FROM nearest WHERE dist <= {PASS_64} QUALIFY rank <= 3""",
    "precomputed_matches": f"""
        {EMBEDDINGS} SELECT item_id, {MATCH_64} FROM benchmark JOIN nearest ON item_id = vec_id""",
    "normalize_docs": f"SELECT doc_id, {_normalized('text')} AS content FROM documents",
    "doc_lines": f"""
        WITH {LINES} SELECT doc_id::VARCHAR AS filename, row_no::BIGINT AS row_no, {_normalized("line")} AS content
        FROM lines WHERE {_strip("line", WHITESPACE)} <> ''""",
    "text_bundle": f"""
        WITH {LINES} SELECT {_normalized("line")} AS content FROM lines WHERE {_strip("line", WHITESPACE)} <> ''""",
    "archive_bundle": f"""
        WITH {LINES} SELECT doc_id || '.txt' AS filename, {_normalized("line")} AS content FROM lines WHERE {_strip("line", WHITESPACE)} <> ''
        UNION ALL SELECT conv_id || '-' || turn || k, {_normalized("text")} FROM conversations, (VALUES ('.csv'), ('.json')) kinds(k)
        WHERE text IS NOT NULL""",
    "data_csv": f"SELECT doc_id::VARCHAR AS filename, {_normalized('text')} AS content FROM documents",
    "match_table": f"""
        SELECT fmt, ' ' || lang || ' ' AS category, round(1 - (doc_id % 64) / 64.0::DOUBLE, 6) AS score, {_clean("text")} AS data,
        source AS filename, (doc_id % 64)::INT AS dist FROM documents, (VALUES ('parquet'), ('csv')) f(fmt)""",
    "line_files": f"""
        SELECT source || ' :  ' || lang || '  : "' || {_clean("text")} || '"' AS line FROM documents""",
    "decode_docs": "SELECT doc_id, text || chr(65533) || lang AS content FROM documents",
    "clean_lines": f"""
        SELECT doc_id, source || ' : ' || lang || ' : "' || {_clean("text")} || '"' AS line FROM documents""",
    "scored_lines": f"""
        SELECT doc_id, lang || ' : ' || printf('%.4f', 1 - (n_chars % 384) / 384.0::DOUBLE) || ' : "' || {_clean("text")}
        || '"' AS line FROM documents""",
    "union_corpus": f"""
        SELECT 'documents' AS filename, doc_id AS row_no, {_normalized("text")} AS content FROM documents
        UNION ALL SELECT 'conversations', conv_id, {_normalized("text")} FROM conversations
        UNION ALL SELECT 'pages', page_id, {_normalized("html")} FROM pages""",
    "longest_prop": """
        SELECT event_id::VARCHAR AS filename, json_extract_string(props, '$.k') AS content FROM events""",
    "json_turns": f"""
        SELECT conv_id || '/' || turn AS filename,
        {_normalized("CASE WHEN length(text) > length(role) THEN text ELSE role END")} AS content FROM conversations""",
    "json_lines": PICKED,
    "csv_lines": PICKED,
    "longest_part_column": """
        WITH cells AS (SELECT p_partkey, [p_name, p_brand, p_type, p_size::VARCHAR] AS c FROM part),
        first AS (SELECT list_transform(c, lambda x: length(x)) AS sizes FROM cells ORDER BY p_partkey LIMIT 1)
        SELECT p_partkey, c[list_position(sizes, list_max(sizes))] AS content FROM cells, first""",
    "column_index": """
        WITH names AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages),
        stems AS (SELECT page_id, CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_replace(name, '\\.[^.]*$', '')
                  ELSE name END AS stem FROM names)
        SELECT page_id, coalesce(try_cast(nullif(regexp_extract(stem, '[0-9]$'), '') AS INTEGER), 0) AS column_index
        FROM stems""",
    "column_index_of_parts": """
        WITH names AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages),
        stems AS (SELECT page_id, CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_replace(name, '\\.[^.]*$', '')
                  ELSE name END AS stem FROM names),
        digits AS (SELECT page_id, try_cast(nullif(regexp_extract(stem, '[0-9]$'), '') AS INTEGER) AS i FROM stems)
        SELECT coalesce(arg_max(i, page_id) FILTER (WHERE i IS NOT NULL), 0)::INTEGER AS column_index FROM digits""",
    "input_roles": """
        SELECT p_partkey, p_brand || '/' || p_name || CASE p_type WHEN 'SMALL' THEN '_Keywords.CSV' ELSE '.csv' END AS path,
        CASE p_type WHEN 'SMALL' THEN 'filters' ELSE 'data' END AS role FROM part WHERE p_type IN ('SMALL', 'LARGE')""",
    "fallback_filters": """
        SELECT item_id AS ord, left(lower(replace(text, ' ', '_')), 20) AS category, 5 AS n_anchors,
        text || '|' || text || '|' || text || '|' || text || '|' || text AS anchors FROM benchmark""",
    "anchor_counts": f"""
        SELECT item_id AS ord, left(lower(replace(text, ' ', '_')), 20) AS category, {len(QUERY_TEMPLATES)} AS n_anchors
        FROM benchmark""",
    "template_filters": f"""
        SELECT item_id AS ord, left(lower(replace(text, ' ', '_')), 20) AS category, i::INTEGER AS anchor_no,
        replace([{", ".join(map(_literal, QUERY_TEMPLATES))}][i + 1], '{{query}}', text) AS anchor
        FROM benchmark, range({len(QUERY_TEMPLATES)}) r(i)""",
    "answered_filters": """
        WITH q AS (SELECT *, c_mktsegment || ' ' || c_name AS query, c_mktsegment <> 'MACHINERY' AS answered FROM customer)
        SELECT c_custkey AS ord, CASE WHEN NOT answered THEN left(lower(replace(query, ' ', '_')), 20)
            WHEN c_acctbal > 0 THEN 'nation_' || c_nationkey ELSE 'general_query' END AS category,
        CASE WHEN answered AND c_acctbal < 5000 THEN c_name || '|' || c_mktsegment
            ELSE query || '|' || query || '|' || query || '|' || query || '|' || query END AS anchors FROM q""",
    "split_queries": f"""
        WITH parts AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[.;\\n]'),
            lambda p: {_strip("p", WHITESPACE)}), lambda p: p <> '') AS ps FROM benchmark)
        SELECT item_id, (generate_subscripts(ps, 1) - 1)::INTEGER AS sub, unnest(ps) AS query FROM parts""",
    "field_anchors": f"""
        WITH lists AS (SELECT n_nationkey, {_field_anchor_list(NATION_FIELDS, {"importantEvents": "'summit'"})} AS a
            FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT n_nationkey, 'structured_query' AS category, (generate_subscripts(a, 1) - 1)::INTEGER AS anchor_no,
        unnest(a) AS anchor FROM lists""",
    "validated_requests": f"""
        WITH {REQUESTS}, messages AS (SELECT request_id, {MESSAGE} AS message FROM requests)
        SELECT request_id, message = '' AS valid, message FROM messages""",
    "routed_requests": f"""
        WITH {REQUESTS} SELECT request_id, 0::BIGINT AS ord,
        CASE WHEN coalesce(nl, false) THEN left(lower(replace(coalesce(description, ''), ' ', '_')), 20)
            ELSE 'structured_query' END AS category,
        CASE WHEN coalesce(nl, false) THEN list_aggregate(list_transform(range(5), lambda i: coalesce(description, '')), 'string_agg', '|')
            ELSE list_aggregate({_field_anchor_list(REQUEST_FIELDS, {"importantEvents": "lower(outcome)"})}, 'string_agg', '|')
            END AS anchors FROM requests""",
    "request_filters": f"""
        WITH {REQUESTS} SELECT request_id, (row_number() OVER (ORDER BY request_id) - 1) * 4294967296 AS ord,
        CASE WHEN coalesce(nl, false) THEN left(lower(replace(coalesce(description, ''), ' ', '_')), 20)
            ELSE 'structured_query' END AS category,
        CASE WHEN coalesce(nl, false) THEN list_aggregate(list_transform(range(5), lambda i: coalesce(description, '')), 'string_agg', '|')
            ELSE list_aggregate({_field_anchor_list(REQUEST_FIELDS, {"importantEvents": "lower(outcome)"})}, 'string_agg', '|')
            END AS anchors FROM requests""",
    "defaulted_fields": f"""
        WITH {REQUESTS} SELECT request_id, outcome AS "desiredOutcome", date AS "importantDate",
        coalesce(people, 'N/A') AS "importantPeople", events AS "importantEvents", location AS "importantLocation"
        FROM requests""",
    "filter_rows": f"""
        WITH cells AS (SELECT item_id, string_split(text, '.') AS c FROM benchmark),
        kept AS (SELECT item_id, c[1] AS category, list_filter(list_transform(c[2:],
            lambda x: {_strip("x", UNICODE_WHITESPACE)}), lambda x: x <> '') AS a FROM cells)
        SELECT item_id::VARCHAR AS filename, 1::BIGINT AS ord, category, len(a)::INTEGER AS n_anchors,
        list_aggregate(a, 'string_agg', '|') AS anchors FROM kept WHERE len(a) > 0""",
    "hash_tokens": """
        WITH tokens AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents),
        hashed AS (SELECT token, md5(token || '#0') || md5(token || '#1') || md5(token || '#2') AS h FROM tokens)
        SELECT token, list_aggregate(list_transform(string_split(h, ''), lambda d: right(bin(('0x' || d)::INTEGER + 16), 4)),
            'string_agg', '') AS signs FROM hashed""",
    "embed_benchmark": _hashed(NO_CORPUS, "SELECT item_id, pos::INTEGER AS pos, round(x, 6) AS x FROM anchor_units"),
    "filter_bits": _hashed(
        NO_CORPUS,
        """SELECT ord::BIGINT AS ord, category, 384 AS dim,
        string_agg(CASE WHEN b THEN '1' ELSE '0' END, '' ORDER BY pos) AS bit_string FROM topics GROUP BY ord, category""",
    ),
    "trim_documents": _hashed(
        "SELECT doc_id AS key, text FROM documents",
        f"SELECT key AS doc_id, {MATCH_384} FROM nearest WHERE dist <= {PASS_384}",
    ),
    "trim_conversations": _hashed(
        "SELECT conv_id || '/' || turn AS key, text FROM conversations",
        f"""SELECT string_split(key, '/')[1]::BIGINT AS conv_id, string_split(key, '/')[2]::BIGINT AS turn, {MATCH_384}
        FROM nearest WHERE dist <= {PASS_384}""",
    ),
    "trimmed_lines": _hashed(
        "SELECT doc_id AS key, text FROM documents",
        f"""SELECT source || ' : ' || category || ' : "' || {_clean(_normalized("text"))} || '"' AS line
        FROM nearest JOIN documents ON doc_id = key WHERE dist <= {PASS_384}""",
    ),
    "csv_files": f"SELECT {_normalized('text')} AS content FROM documents",
    "json_list_files": f"SELECT 'docs.json' AS filename, {_normalized('text')} AS content FROM documents",
    "bundle_run": f"""
        WITH turns AS (SELECT conv_id || '-' || turn || '.json' AS filename, turn % 3 = 1 AS broken,
                              {_normalized("coalesce(text, '')")} AS content FROM conversations),
        counts AS (SELECT count(*) FILTER (WHERE NOT broken) AS rows, count(*) FILTER (WHERE broken) AS errors,
                          coalesce(sum(length(content)) FILTER (WHERE NOT broken), 0)::BIGINT AS characters FROM turns)
        SELECT filename, CASE WHEN broken THEN 'error' ELSE 'row' END AS kind,
        CASE WHEN broken THEN 'no value can be taken from this JSON document' ELSE content END AS content,
        rows, errors, characters FROM turns, counts""",
    "filter_files_read": f"""
        WITH cells AS (SELECT item_id, list_filter(list_transform(string_split(text, '.'),
            lambda x: {_strip("x", UNICODE_WHITESPACE)}), lambda x: x <> '') AS a FROM benchmark)
        SELECT item_id || '.csv' AS filename, 0::BIGINT AS ord, 'first' AS category, list_aggregate(a, 'string_agg', '|') AS anchors,
               NULL::VARCHAR AS error FROM cells WHERE len(a) > 0
        UNION ALL SELECT item_id || '.csv', 1, CASE WHEN item_id % 3 <> 0 THEN 'whole' END,
               CASE WHEN item_id % 3 <> 0 THEN 'closed' END, CASE WHEN item_id % 3 = 0 THEN 'a quote is not closed' END FROM cells
        UNION ALL SELECT item_id || '.csv', 2, 'last', 'item ' || item_id, NULL FROM cells""",
    "match_table_by_category": f"""
        SELECT ' ' || lang || ' ' AS category, round(1 - (doc_id % 64) / 64.0::DOUBLE, 6) AS score, {_clean("text")} AS data,
        source AS filename, (doc_id % 64)::INT AS dist, ' ' || lang || ' ' AS folder FROM documents""",
    "bundle_format": f"""
        WITH turns AS (SELECT conv_id || '-' || turn || CASE turn % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.json' ELSE '.csv' END AS filename,
                              turn % 3 = 0 AS is_txt, text FROM conversations WHERE text IS NOT NULL),
        lines AS (SELECT filename, unnest(string_split(text, chr(10))) AS line FROM turns WHERE is_txt),
        found AS (SELECT filename, {_normalized("line")} AS content FROM lines WHERE {_strip("line", WHITESPACE)} <> ''
                  UNION ALL SELECT filename, {_normalized("text")} FROM turns WHERE NOT is_txt)
        SELECT how, filename, content FROM found, (VALUES ('batch'), ('stream')) h(how)""",
    "model_vectors": """
        WITH counts AS (SELECT doc_id, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''),
                               lambda c: length(text) - length(replace(text, c, ''))) AS v FROM documents),
        sized AS (SELECT doc_id, v, list_sum(v)::BIGINT AS s, sqrt(list_sum(list_transform(v, lambda x: x * x))::DOUBLE) AS n FROM counts)
        SELECT doc_id, list_aggregate(list_transform(v, lambda x: CASE WHEN x * 26 > s THEN '1' ELSE '0' END), 'string_agg', '') AS bit_string,
        CASE WHEN n = 0 THEN 0 ELSE round(v[1] / n, 6) END AS of_a, CASE WHEN n = 0 THEN 0 ELSE round(v[5] / n, 6) END AS of_e FROM sized""",
}

ORACLES["archive_match"] = ORACLES["trimmed_lines"]
