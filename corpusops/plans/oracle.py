"""The registered queries restated in SQL over the same tables, for checking results."""

from __future__ import annotations

RAW_LINES = """
raw_lines AS (
  SELECT doc_id, CASE doc_id % 50
    WHEN 0 THEN '{' || meta || ',' || task || ',' || body || '}'
    WHEN 1 THEN '{' || ident || ',' || meta_open || '},' || task || ',' || body || '}'
    WHEN 2 THEN '{' || ident || ',"meta":[1],' || task || ',' || body || '}'
    WHEN 3 THEN '{' || ident || ',' || meta || ',"task":"lm_error",' || body || '}'
    WHEN 4 THEN '{"id":null,' || meta || ',' || task || ',' || body || '}'
    WHEN 5 THEN '{bad'
    WHEN 6 THEN '   '
    WHEN 7 THEN '{' || ident || ',' || meta || ',' || body || '}'
    WHEN 8 THEN '[1,2]'
    ELSE '{' || ident || ',' || meta || ',' || task || ',' || body || '}'
  END AS value
  FROM (
    SELECT doc_id, '"id":"doc-' || doc_id || '"' AS ident, '"task":"lm"' AS task,
      '"text":' || CAST(to_json(text) AS VARCHAR) AS body, meta_open,
      meta_open || ',"template_index":' || (doc_id % 7) || '}' AS meta
    FROM (
      SELECT *, '"meta":{"grammar_rev":' || CAST(to_json(source) AS VARCHAR)
        || ',"seed":42,"split":' || CAST(to_json(lang) AS VARCHAR) AS meta_open
      FROM documents
    )
  )
),
lines AS (
  SELECT doc_id, value, row_number() OVER (ORDER BY doc_id) AS "row",
    json_valid(value) AS is_json,
    CASE WHEN json_valid(value) THEN json_type(value) END AS kind
  FROM raw_lines WHERE trim(value) <> ''
),
objects AS (
  SELECT *, CASE WHEN json_type(value, '$.task') = 'VARCHAR' THEN json_extract_string(value, '$.task') END AS task_name
  FROM lines WHERE kind = 'OBJECT'
)"""

_FIELDS = ("id", "meta", "task")
_META = ("grammar_rev", "seed", "split", "template_index")
_MISSING_FIELDS = ", ".join(f"CASE WHEN NOT json_exists(value, '$.{f}') THEN '{f}' END" for f in _FIELDS)
_META_OK = "coalesce(json_type(value, '$.meta') = 'OBJECT', false)"
_MISSING_META = ", ".join(
    f"CASE WHEN {_META_OK} AND NOT json_exists(value, '$.meta.{k}') THEN '{k}' END" for k in _META
)
_TASK_OUTSIDE = "NOT coalesce(task_name IN ('lm', 'seq2seq', 'cls'), false)"

CHECKED = f"""{RAW_LINES},
checked AS (
  SELECT *, list_filter([
    {", ".join(f"CASE WHEN NOT json_exists(value, '$.{f}') THEN 'Missing required field ''{f}''' END" for f in _FIELDS)},
    CASE WHEN NOT {_META_OK} THEN '''meta'' must be a mapping' END,
    {", ".join(f"CASE WHEN {_META_OK} AND NOT json_exists(value, '$.meta.{k}') THEN 'Missing meta field ''{k}''' END" for k in _META)},
    CASE WHEN {_TASK_OUTSIDE} THEN 'Missing task field ''' || coalesce(task_name, 'None')
      || ''', it must be ''[''lm'', ''seq2seq'', ''cls'']''' END
  ], lambda x: x IS NOT NULL) AS errors
  FROM objects
)"""

# Lines that hold no object have that as their only message.
ALL_CHECKED = f"""{CHECKED},
all_checked AS (
  SELECT doc_id, errors FROM checked
  UNION ALL
  SELECT doc_id, [CASE WHEN is_json THEN 'not a JSON object' ELSE 'malformed JSON' END] FROM lines
  WHERE kind IS DISTINCT FROM 'OBJECT'
)"""

RECORDS = """
records AS (
  SELECT 'doc-' || doc_id AS id, CASE WHEN quality IS NOT NULL THEN 'cls' ELSE 'lm' END AS task, text,
    CAST(NULL AS VARCHAR) AS src, CAST(NULL AS VARCHAR) AS tgt, CAST(quality AS VARCHAR) AS label,
    source AS grammar_rev, 42 AS seed, lang AS meta_split, doc_id % 7 AS template_index, toxic = 1 AS is_noisy
  FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL
  SELECT 'conv-' || u.conv_id || '-' || u.turn, 'seq2seq', NULL, u.text, a.text, NULL,
    'conv', 42, u.role, u.turn, NULL
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""

# Texts of a mapping task: its type and label count as texts too.
TASK_TEXTS = f"""{RECORDS},
task_texts AS (
  SELECT id, task, payload FROM (
    SELECT id, task, unnest([task, label, text, src, tgt]) AS payload FROM records
  ) WHERE payload IS NOT NULL
)"""

_SPLIT_RANKED = f"""{RECORDS},
ranked AS (
  SELECT id, task, row_number() OVER (ORDER BY md5('42:' || id), id) AS rank, count(*) OVER () AS total FROM records
),
shares AS (
  SELECT name, ratio * total AS share, floor(ratio * total) AS base, total
  FROM (VALUES ('train', 0.8::DOUBLE), ('dev', 0.1::DOUBLE), ('test', 0.1::DOUBLE)) s(name, ratio), (SELECT count(*) AS total FROM records)
),
allocated AS (
  SELECT name, base + CASE WHEN row_number() OVER (ORDER BY share - base DESC, name DESC)
    <= total - sum(base) OVER () THEN 1 ELSE 0 END AS n FROM shares
),
sized AS (
  SELECT max(CASE WHEN name = 'train' THEN n END) AS n_train, max(CASE WHEN name = 'dev' THEN n END) AS n_dev FROM allocated
),
assigned AS (
  SELECT id, task, CASE WHEN rank <= n_train THEN 'train' WHEN rank <= n_train + n_dev THEN 'dev' ELSE 'test' END AS split
  FROM ranked, sized
)"""

_TOKENS = f"""{TASK_TEXTS},
task_tokens AS (
  SELECT task, unnest(regexp_extract_all(payload, '\\S+')) AS token FROM task_texts
)"""

_LENGTH_STATS = """
  coalesce(round_even(avg(length(payload)), 6), 0) AS mean,
  coalesce(round_even(stddev_pop(length(payload)), 6), 0) AS stdev,
  CAST(min(length(payload)) AS DOUBLE) AS min, CAST(max(length(payload)) AS DOUBLE) AS max"""


def _rate(count: str) -> str:
    return f"round_even({count} / count(*)::DOUBLE, 6)"


_COVERED_META = {
    "grammar_rev": "count(*) FILTER (grammar_rev IS NOT NULL AND grammar_rev <> '')",
    "seed": "count(seed)",
    "split": "count(*) FILTER (meta_split IS NOT NULL AND meta_split <> '')",
    "template_index": "count(template_index)",
}


ORACLE: dict[str, str] = {
    "s01_strict_scan": f"""WITH {RAW_LINES}
        SELECT doc_id, value, CASE WHEN is_json THEN 'not a JSON object' ELSE 'malformed JSON' END AS problem
        FROM lines WHERE coalesce(kind, '') <> 'OBJECT'""",
    "s02_parquet_scan": """SELECT source, lang, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars
        FROM documents GROUP BY source, lang""",
    "s04_text_scan": f"""WITH {RAW_LINES}
        SELECT doc_id, 'text' AS field, md5(json_extract_string(value, '$.text')) AS payload_md5
        FROM objects WHERE json_exists(value, '$.text')""",
    "s05_task_samples": f"""WITH {RAW_LINES}
        SELECT coalesce(task_name, 'unknown') AS task, count(*) AS samples,
          CAST(sum(length(json_extract_string(value, '$.text'))) AS BIGINT) AS chars
        FROM objects WHERE json_exists(value, '$.text') GROUP BY 1""",
    "p01_missing_fields": f"""WITH {RAW_LINES}
        SELECT doc_id, field FROM (SELECT doc_id, unnest([{_MISSING_FIELDS}]) AS field FROM objects)
        WHERE field IS NOT NULL""",
    "p02_meta_mapping": f"""WITH {RAW_LINES}
        SELECT doc_id, '''meta'' must be a mapping' AS message FROM objects WHERE NOT {_META_OK}""",
    "p03_missing_meta": f"""WITH {RAW_LINES}
        SELECT doc_id, field FROM (SELECT doc_id, unnest([{_MISSING_META}]) AS field FROM objects)
        WHERE field IS NOT NULL""",
    "p04_task_domain": f"WITH {RAW_LINES} SELECT doc_id, task_name AS task FROM objects WHERE {_TASK_OUTSIDE}",
    "p05_row_errors": f"""WITH {CHECKED}
        SELECT "row", doc_id, CAST(ord - 1 AS INTEGER) AS ord, message FROM (
          SELECT "row", doc_id, unnest(errors) AS message, unnest(range(1, len(errors) + 1)) AS ord FROM checked
        )""",
    "p09_quarantine": f"""WITH {ALL_CHECKED}
        SELECT doc_id, CASE WHEN len(errors) = 0 THEN 'valid' ELSE 'quarantine' END AS side,
          array_to_string(errors, '; ') AS messages FROM all_checked""",
    "p11_row_number": f'WITH {RAW_LINES} SELECT doc_id, "row" FROM lines',
    "a01_validation_summary": f"""WITH {ALL_CHECKED}
        SELECT count(*) AS rows_total, count(*) FILTER (len(errors) = 0) AS rows_valid,
          count(*) FILTER (len(errors) > 0) AS rows_invalid FROM all_checked""",
    "k07_row_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "a02_unique_ids": f"""WITH {RECORDS}
        SELECT count(DISTINCT id) + coalesce(max(CASE WHEN id IS NULL THEN 1 ELSE 0 END), 0) AS unique_ids FROM records""",
    "a03_task_distribution": f"WITH {RECORDS} SELECT task AS task_type, count(*) AS n FROM records GROUP BY task",
    "a04_label_distribution": f"""WITH {RECORDS}
        SELECT task AS task_type, label AS task_label, count(*) AS n FROM records
        WHERE label IS NOT NULL GROUP BY task, label""",
    "a05_field_coverage": f"""WITH {RECORDS}
        SELECT {_rate("count(*) FILTER (id <> '')")} AS id, {_rate("count(*)")} AS meta,
          {_rate("count(*) FILTER (task <> '')")} AS task FROM records""",
    "a06_meta_coverage": f"""WITH {RECORDS}
        SELECT {", ".join(f'{_rate(c)} AS {k}' for k, c in _COVERED_META.items())} FROM records""",
    "a07_vocab_size": f"""WITH {_TOKENS}
        SELECT task AS task_type, count(DISTINCT token) AS vocab_size FROM task_tokens GROUP BY task""",
    "a08_text_length": f"WITH {TASK_TEXTS} SELECT {_LENGTH_STATS} FROM task_texts",
    "a09_noise_rate": f"""WITH {RECORDS}
        SELECT {_rate("count(*) FILTER (coalesce(is_noisy, false))")} AS noise_rate FROM records""",
    "a10_first_rev": f"""WITH {RAW_LINES}
        SELECT arg_min(rev, "row") AS grammar_rev FROM (
          SELECT "row", json_extract_string(value, '$.meta.grammar_rev') AS rev FROM objects
        ) WHERE rev IS NOT NULL""",
    "a11_profile": f"""WITH {_TOKENS},
        lengths AS (SELECT {_LENGTH_STATS} FROM task_texts)
        SELECT 'rows_total' AS stat, '' AS key, '' AS subkey, CAST(count(*) AS DOUBLE) AS value FROM records
        UNION ALL SELECT 'unique_ids', '', '', CAST(count(DISTINCT id) AS DOUBLE) FROM records
        UNION ALL SELECT 'noise_rate', '', '', {_rate("count(*) FILTER (coalesce(is_noisy, false))")} FROM records
        UNION ALL SELECT 'text_length', k, '', v FROM (
          SELECT unnest(['mean', 'stdev', 'min', 'max']) AS k, unnest([mean, stdev, min, max]) AS v FROM lengths)
        UNION ALL SELECT 'task_distribution', task, '', CAST(count(*) AS DOUBLE) FROM records GROUP BY task
        UNION ALL SELECT 'label_distribution', task, label, CAST(count(*) AS DOUBLE) FROM records
          WHERE label IS NOT NULL GROUP BY task, label
        UNION ALL SELECT 'field_coverage', unnest(['id', 'meta', 'task']), '',
          unnest([{_rate("count(id)")}, {_rate("count(*)")}, {_rate("count(task)")}]) FROM records
        UNION ALL SELECT 'meta_field_coverage', unnest({list(_COVERED_META)}), '',
          unnest([{", ".join(_rate(c) for c in _COVERED_META.values())}]) FROM records
        UNION ALL SELECT 'ngram_vocab', task, '', CAST(count(DISTINCT token) AS DOUBLE) FROM task_tokens GROUP BY task""",
    "o01_split_assign": f"WITH {_SPLIT_RANKED} SELECT id, split FROM assigned",
    "o02_allocation": """
        WITH totals AS (SELECT lang, source, count(*) AS total FROM documents GROUP BY lang, source),
        shares AS (
          SELECT lang, source, total, name AS split, ratio * total AS share, floor(ratio * total) AS base
          FROM totals, (VALUES ('train', 0.8::DOUBLE), ('dev', 0.1::DOUBLE), ('test', 0.1::DOUBLE)) s(name, ratio)
        )
        SELECT lang, source, total, split, CAST(base + CASE
          WHEN row_number() OVER (PARTITION BY lang, source ORDER BY share - base DESC, split DESC)
            <= total - sum(base) OVER (PARTITION BY lang, source) THEN 1 ELSE 0 END AS BIGINT) AS rows
        FROM shares""",
    "a12_split_rows": f"WITH {_SPLIT_RANKED} SELECT split, task, count(*) AS rows FROM assigned GROUP BY split, task",
    "o07_epoch_order": f"""WITH {RECORDS}
        SELECT id, row_number() OVER (ORDER BY md5('42:3:' || id), id) AS ordinal FROM records""",
}

# Text, vocabulary and token reports

_WORD = "[\\p{L}\\p{M}\\p{N}_]+|[^\\s\\p{L}\\p{M}\\p{N}_]+"
_PIECE = "''s|''t|''re|''ve|''m|''ll|''d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+"


def _normal(column: str) -> str:
    """Composed, lower case, whitespace collapsed."""
    return f"trim(regexp_replace(lower(nfc_normalize({column})), '\\s+', ' ', 'g'))"


_SPACED = "trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '\\p{P}+', ' ', 'g'), '\\s+', ' ', 'g'))"

WORDS = f"""
words AS (
  SELECT word, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all({_normal("text")}, '{_WORD}')) AS word FROM documents
  ) GROUP BY word
),
top_words AS (
  SELECT word AS token, n, row_number() OVER (ORDER BY n DESC, word) + 4 AS id
  FROM words QUALIFY row_number() OVER (ORDER BY n DESC, word) <= 1995
)"""

def _merges(size: int) -> str:
    """BPE one merge at a time. A symbol is one character, 19968 plus its id; a step keeps the
    token table, the words as symbols, and the merge it made."""
    return f"""WITH RECURSIVE {WORDS.strip().rstrip(",")},
letters AS (
  SELECT c, 4 + row_number() OVER (ORDER BY c) AS id FROM (SELECT DISTINCT unnest(string_split(word, '')) AS c FROM words)
),
spelling AS (SELECT map_from_entries(list((c, chr((19968 + id)::INTEGER)))) AS ids FROM letters),
learned AS (
  SELECT 0 AS step, 'token' AS kind, id, c AS "left", NULL::VARCHAR AS "right", 0::BIGINT AS n FROM letters
  UNION ALL
  SELECT 0, 'word', NULL, array_to_string(list_transform(string_split(word, ''), lambda c: ids[c]), ''), word, n
  FROM words, spelling
  UNION ALL (
    WITH pairs AS (
      SELECT substr("left", i, 2) AS pair, sum(n) AS uses FROM (
        SELECT "left", n, unnest(range(1, length("left"))) AS i FROM learned WHERE kind = 'word'
      ) GROUP BY 1
    ),
    best AS (SELECT pair FROM pairs ORDER BY uses DESC, pair LIMIT 1),
    merged AS (
      SELECT pair, l."left" AS l, r."left" AS r, k.id IS NULL AS is_new,
        coalesce(k.id, (SELECT max(id) + 1 FROM learned WHERE kind = 'token')) AS id
      FROM best JOIN learned l ON l.kind = 'token' AND l.id = ord(pair[1]) - 19968
      JOIN learned r ON r.kind = 'token' AND r.id = ord(pair[2]) - 19968
      LEFT JOIN learned k ON k.kind = 'token' AND k."left" = l."left" || r."left"
      WHERE (SELECT count(*) + 5 FROM learned WHERE kind = 'token') < {size}
    )
    SELECT t.step + 1, t.kind, t.id, CASE WHEN t.kind = 'word' THEN replace(t."left", m.pair, chr((19968 + m.id)::INTEGER))
      ELSE t."left" END, t."right", t.n
    FROM learned t, merged m WHERE t.kind <> 'merge'
    UNION ALL
    SELECT (SELECT max(step) + 1 FROM learned), 'token', id, l || r, NULL, 0 FROM merged WHERE is_new
    UNION ALL
    SELECT (SELECT max(step) + 1 FROM learned), 'merge', id, l, r, 0 FROM merged
  )
)"""


_BPE_ENCODED = f"""{_merges(128)},
final AS (
  SELECT "right" AS word, list_transform(string_split("left", ''), lambda c: ord(c) - 19968) AS ids FROM learned
  WHERE kind = 'word' AND step = (SELECT max(step) FROM learned)
),
pieces AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, regexp_extract_all({_normal("text")}, '{_WORD}') AS w FROM documents)
)"""


BYTES = f"""
byte_counts AS (
  SELECT token, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(hex(encode({_normal("text")})), '..')) AS token FROM documents
  ) GROUP BY token
),
byte_vocab AS (
  SELECT token, n, ln(n / sum(n) OVER ()) AS score, row_number() OVER (ORDER BY n DESC, token) + 4 AS id
  FROM byte_counts
),
byte_map AS (SELECT map(list(token), list(id)) AS ids FROM byte_vocab WHERE id < 64)"""


def _encoded(source: str, key: str, column: str) -> str:
    """Byte ids of each text: unknown bytes in a row within a piece are one unknown token."""
    return f"""{BYTES},
pieces AS (
  SELECT {key}, pos, list_transform(regexp_extract_all(hex(encode(piece)), '..'), lambda b: coalesce(ids[b], 3)) AS raw
  FROM (
    SELECT {key}, unnest(p) AS piece, unnest(range(len(p))) AS pos
    FROM (SELECT {key}, regexp_extract_all({_normal(column)}, '{_PIECE}') AS p FROM {source})
  ), byte_map
),
fused AS (
  SELECT {key}, pos, list_filter(raw, lambda x, i: x <> 3 OR i = 1 OR raw[i - 1] <> 3) AS ids FROM pieces
)"""


_SAMPLES = f"""{RECORDS},
payloads AS (
  SELECT row_number() OVER (ORDER BY id, field) AS sample, split, task, payload FROM (
    SELECT id, task, unnest(['text', 'src', 'tgt']) AS field, unnest([text, src, tgt]) AS payload,
      CASE WHEN meta_split IN ('en', 'user') THEN 'train' WHEN meta_split = 'fr' THEN 'dev' ELSE 'test' END AS split
    FROM records
  ) WHERE payload IS NOT NULL
),
{_encoded("payloads", "sample", "payload").lstrip()},
samples AS (
  SELECT any_value(split) AS split, any_value(task) AS task, coalesce(sum(len(ids)), 0) AS n_tokens,
    coalesce(sum(len(list_filter(ids, lambda x: x = 3))), 0) AS n_unk
  FROM payloads LEFT JOIN fused USING (sample) GROUP BY sample
)"""

_NUM = "count(*) AS num_samples, CAST(sum(n_tokens) AS BIGINT) AS num_tokens"
_OOV = "round(coalesce(sum(n_unk) / nullif(sum(n_tokens), 0), 0), 6) AS oov_rate"
_AVG = "round(coalesce(sum(n_tokens) / count(*), 0), 6) AS avg_tokens_per_sample"
_P50 = "round(quantile_cont(n_tokens, 0.5), 6) AS tokens_len_p50"
_P95 = "round(quantile_cont(n_tokens, 0.95), 6) AS tokens_len_p95"
_COVERAGE = "coalesce(1 - sum(n_unk) / nullif(sum(n_tokens), 0), 0)"

SEQUENCES = f"""
sequences AS (
  SELECT doc_id AS seq_id, row_number() OVER (ORDER BY doc_id) AS "row", ids,
    CASE WHEN doc_id % 2 <> 0 THEN list_transform(ids, lambda x: CASE WHEN x > 8 THEN 0 ELSE 1 END) END AS mask,
    coalesce(CASE WHEN doc_id % 2 <> 0 THEN list_transform(ids, lambda x: CASE WHEN x > 8 THEN 0 ELSE 1 END) END,
      list_transform(ids, lambda x: 1)) AS full_mask
  FROM (
    SELECT doc_id, list_transform(regexp_extract_all(text, '{_WORD}'), lambda t: CAST(length(t) AS INTEGER)) AS ids
    FROM documents
  )
),
tokens AS (
  SELECT seq_id, unnest(ids) AS id, unnest(full_mask) AS mask, unnest(range(len(ids))) AS pos, len(ids) AS size
  FROM sequences
)"""

_LOG = """
eval_log AS (
  SELECT user_id % 4 AS run, event_id AS step, value AS loss, 1 + event_id % 13 AS n_tokens FROM events
)"""

_DIGEST = """
  SELECT seq_id, count(*) AS positions, min(mean) AS low, max(mean) AS high,
    CAST(sum(CAST(floor(mean * 1000) AS BIGINT) * (pos % 1000 + 1)) AS BIGINT) AS digest
  FROM means GROUP BY seq_id"""


def _mean(frame: str) -> str:
    return f"""means AS (
  SELECT seq_id, pos, coalesce(CAST(sum(id) FILTER (mask <> 0) OVER w AS DOUBLE)
    / nullif(count(*) FILTER (mask <> 0) OVER w, 0), 0) AS mean
  FROM tokens WINDOW w AS (PARTITION BY seq_id ORDER BY pos {frame})
)"""


def _joined(lists: str) -> str:
    return f"md5(array_to_string({lists}, ' '))"


def _lengths(column: str) -> str:
    return f"list_transform(regexp_extract_all({column}, '{_WORD}'), lambda t: length(t) + 4)"


def _registry(condition: str, state: str) -> str:
    return f"""SELECT 'tok-' || user_id AS tokenizer_id, max(event_id) AS created_at, '{state}' AS state
  FROM events WHERE {condition} GROUP BY user_id"""


ORACLE |= {
    "f01_normalize": f"SELECT doc_id, CAST(length({_SPACED}) AS INTEGER) AS chars, md5({_SPACED}) AS text_md5 FROM documents",
    "f02_normalize_encode": f"""SELECT doc_id, CAST(length({_normal("text")}) AS INTEGER) AS chars,
        md5({_normal("text")}) AS text_md5 FROM documents""",
    "f04_pretokenize": f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, {_joined("t")} AS tokens_md5
        FROM (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS t FROM documents)""",
    "f05_bytes": """SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes, md5(hex(encode(text))) AS bytes_md5
        FROM documents""",
    "f08_tags": """SELECT event_id, unnest(['kind', 'user', 'props']) AS tag,
        unnest([event_type, CAST(user_id AS VARCHAR), 'a=' || props]) AS value FROM events""",
    "f09_flatten": """SELECT doc_id, CAST(to_json({'doc_id': doc_id, 'meta.source': source, 'meta.lang': lang,
        'meta.size.n_chars': n_chars}) AS VARCHAR) AS flat FROM documents""",
    "f10_tokenizer_id": """SELECT doc_id, ['char', 'bpe', 'unigram'][doc_id % 3 + 1] || '-' || n_chars || '-'
        || CASE WHEN doc_id % 2 = 0 THEN 'nfc' ELSE 'none' END || '-' || CASE WHEN lang = 'en' THEN 'lower' ELSE 'nolower' END
        || '-' || ['keep', 'strip', 'space'][doc_id % 3 + 1] || '-s' || doc_id AS tokenizer_id FROM documents""",
    "t01_word_freq": f"WITH {WORDS} SELECT word, n FROM words",
    "o05_topk_vocab": f"WITH {WORDS} SELECT token, n, id FROM top_words",
    "j03_vocab_lookup": f"""WITH {WORDS}
        SELECT coalesce(id, 3) AS id, count(*) AS words, CAST(sum(words.n) AS BIGINT) AS uses
        FROM words LEFT JOIN top_words ON token = word GROUP BY 1""",
    "u03_missing_specials": f"""WITH {WORDS}
        SELECT token FROM (SELECT unnest(['<pad>', '<bos>', '<eos>', '<unk>', '<sep>']) AS token)
        EXCEPT SELECT token FROM top_words""",
    "t02_bpe_merges": f"""{_merges(256)}
        SELECT CAST(step - 1 AS BIGINT) AS rank, "left", "right" FROM learned WHERE kind = 'merge'""",
    "t05_encode": f"""{_BPE_ENCODED}
        SELECT doc_id, CAST(coalesce(sum(len(ids)), 0) AS INTEGER) AS n_tokens,
          md5(coalesce(string_agg(array_to_string(ids, ' '), ' ' ORDER BY pos), '')) AS ids_md5
        FROM documents LEFT JOIN (SELECT doc_id, pos, ids FROM pieces JOIN final USING (word)) USING (doc_id) GROUP BY doc_id""",
    "t04_char_vocab": f"""WITH {BYTES}
        SELECT token, n, id, round(score, 6) AS score FROM byte_vocab WHERE id < 64""",
    "t05_encode_char": f"""WITH {_encoded("documents", "doc_id", "text")}
        SELECT doc_id, CAST(coalesce(sum(len(ids)), 0) AS INTEGER) AS n_tokens,
          md5(coalesce(string_agg(array_to_string(ids, ' '), ' ' ORDER BY pos), '')) AS ids_md5
        FROM documents LEFT JOIN fused USING (doc_id) GROUP BY doc_id""",
    "t07_encode_words": f"""WITH {WORDS}, ids AS (
          SELECT doc_id, pos, coalesce(id, 3) AS id
          FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos
            FROM (SELECT doc_id, regexp_extract_all({_normal("text")}, '{_WORD}') AS w FROM documents))
          LEFT JOIN top_words ON token = word
        )
        SELECT doc_id, CAST(count(id) AS INTEGER) AS n_tokens, md5(coalesce(string_agg(id, ' ' ORDER BY pos), '')) AS ids_md5
        FROM documents LEFT JOIN ids USING (doc_id) GROUP BY doc_id""",
    "t11_decode_pieces": f"""SELECT doc_id, md5(array_to_string(
          list_filter(regexp_extract_all({_normal("text")}, '{_WORD}'), lambda w: length(w) <= 100), ' ')) AS text_md5
        FROM documents""",
    "t11_decode_char": f"SELECT doc_id, md5({_normal('text')}) AS text_md5 FROM documents",
    "a13_token_metrics": f"WITH {_SAMPLES} SELECT {_NUM}, {_OOV}, {_AVG} FROM samples",
    "a14_length_percentiles": f"WITH {_SAMPLES} SELECT split, {_P50}, {_P95} FROM samples GROUP BY split",
    "a15_task_coverage": f"""WITH {_SAMPLES}
        SELECT split, task, round({_COVERAGE}, 6) AS coverage FROM samples GROUP BY split, task""",
    "a16_token_report": f"""WITH {_SAMPLES}
        SELECT split, task, CASE grouping(split) * 2 + grouping(task) WHEN 0 THEN 'split_task' WHEN 1 THEN 'split'
          WHEN 2 THEN 'task' ELSE 'all' END AS grain,
          {_NUM}, {_OOV}, {_AVG}, {_P50}, {_P95}, round({_COVERAGE}, 6) AS coverage
        FROM samples GROUP BY GROUPING SETS ((split), (split, task), (task), ())""",
    "a17_macro_coverage": f"""WITH {_SAMPLES}
        SELECT round(avg(coverage), 6) AS macro_coverage
        FROM (SELECT task, {_COVERAGE} AS coverage FROM samples GROUP BY task)""",
    "j01_split_semi": """
        SELECT source AS name, count(*) AS rows FROM documents WHERE source IN (
          SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
        ) GROUP BY source""",
    "j02_registry_upsert": f"""
        WITH fresh AS ({_registry("event_type = 'purchase'", "new")}), stale AS ({_registry("event_type <> 'purchase'", "old")})
        SELECT * FROM stale WHERE tokenizer_id NOT IN (SELECT tokenizer_id FROM fresh) UNION ALL SELECT * FROM fresh""",
    "s06_sequence_scan": f"""WITH {SEQUENCES}
        SELECT seq_id, {_joined("ids")} AS ids_md5, {_joined("full_mask")} AS mask_md5 FROM sequences""",
    "p12_max_len": f"WITH {SEQUENCES} SELECT seq_id, CAST(len(ids) AS INTEGER) AS n_tokens FROM sequences WHERE len(ids) > 512",
    "j04_context_pairs": f"""WITH {SEQUENCES}
        SELECT q.id AS query, k.id AS key, count(*) AS pairs
        FROM (SELECT *, unnest(range(-3, 4)) AS d FROM tokens) q JOIN tokens k ON k.seq_id = q.seq_id AND k.pos = q.pos + d
        GROUP BY 1, 2""",
    "j05_global_pairs": f"""WITH {SEQUENCES},
        pairs AS (
          SELECT seq_id, pos AS q, pos + d AS k FROM (SELECT *, unnest(range(-2, 1)) AS d FROM tokens) WHERE pos + d >= 0
          UNION SELECT seq_id, pos, g FROM (SELECT *, unnest(range(0, 2)) AS g FROM tokens) WHERE g < size
          UNION SELECT seq_id, g, pos FROM (SELECT *, unnest(range(0, 2)) AS g FROM tokens) WHERE g < size
        ),
        queried AS MATERIALIZED (
          SELECT p.seq_id, p.k, t.id AS query FROM pairs p JOIN tokens t ON t.seq_id = p.seq_id AND t.pos = p.q
        )
        SELECT query, t.id AS key, count(*) AS pairs
        FROM queried p JOIN tokens t ON t.seq_id = p.seq_id AND t.pos = p.k GROUP BY 1, 2""",
    "w02_prefix_mean": f"""WITH {SEQUENCES},
        {_mean("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")} {_DIGEST}""",
    "w03_sliding_mean": f"WITH {SEQUENCES}, {_mean('ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING')} {_DIGEST}",
    "f12_pad_batch": f"""WITH {SEQUENCES},
        batched AS (
          SELECT *, ("row" - 1) // 8 AS batch, max(len(ids)) OVER (PARTITION BY ("row" - 1) // 8) AS width FROM sequences
        )
        SELECT seq_id, batch, CAST(width AS INTEGER) AS width,
          {_joined("list_concat(ids, list_transform(range(width - len(ids)), lambda x: 0))")} AS ids_md5,
          {_joined("list_concat(full_mask, list_transform(range(width - len(ids)), lambda x: 0))")} AS mask_md5
        FROM batched""",
    "f14_shift_labels": f"""WITH {SEQUENCES},
        labels AS (
          SELECT seq_id, CASE WHEN mask IS NULL THEN ids[2:] ELSE
            list_transform(ids[2:], lambda x, i: CASE WHEN mask[i + 1] = 0 THEN -100 ELSE x END) END AS labels FROM sequences
        )
        SELECT seq_id, CAST(len(labels) AS INTEGER) AS n_labels, {_joined("labels")} AS labels_md5 FROM labels""",
    "f15_template": f"""WITH {RECORDS}
        SELECT id, {_joined(f'''CASE WHEN text IS NOT NULL THEN [1] || {_lengths("text")} || [2]
          ELSE [1] || {_lengths("src")} || [4] || {_lengths("tgt")} || [2] END''')} AS ids_md5 FROM records""",
    "a19_batch_tokens": f"""WITH {SEQUENCES}
        SELECT ("row" - 1) // 8 AS batch, CAST(sum(coalesce(list_sum(mask), len(ids))) AS BIGINT) AS tokens
        FROM sequences GROUP BY 1""",
    "a18_eval_summary": f"""WITH {_LOG}
        SELECT run, round(loss, 6) AS loss, round(exp(least(20.0, loss)), 3) AS ppl FROM (
          SELECT run, sum(loss * n_tokens) / greatest(1, sum(n_tokens)) AS loss FROM eval_log GROUP BY run)""",
    "a20_throughput": f"""WITH {_LOG}
        SELECT run, CAST(ceil(step / 50) AS BIGINT) AS "interval", CAST(sum(n_tokens) AS BIGINT) AS tokens,
          round(sum(n_tokens) / sum(loss), 6) AS tokens_per_s, round(sum(loss) / 50 * 1000, 6) AS step_ms,
          bool_or(step % 50 = 0) AS complete FROM eval_log GROUP BY 1, 2""",
    "w01_best_so_far": f"""WITH {_LOG}
        SELECT run, step, min(loss) OVER (PARTITION BY run ORDER BY step) AS best FROM eval_log""",
    "o06_latest_run": "SELECT event_id AS run_id, event_type AS kind FROM events ORDER BY ts DESC, event_id DESC LIMIT 1",
    "r01_params_long": f"""WITH {RECORDS}
        SELECT id, unnest(['task', 'meta.grammar_rev', 'meta.seed', 'meta.split', 'meta.template_index', 'meta.is_noisy']) AS param,
          unnest([task, grammar_rev, CAST(seed AS VARCHAR), meta_split, CAST(template_index AS VARCHAR),
            CAST(is_noisy AS VARCHAR)]) AS value FROM records""",
    "r02_metrics_long": f"""WITH {_LOG}
        SELECT run, step, unnest(['loss', 'n_tokens']) AS metric, unnest([loss, CAST(n_tokens AS DOUBLE)]) AS value FROM eval_log""",
    "r04_nested_runs": """
        SELECT c.event_id AS run_id, p.event_id AS parent_run_id, c.ts >= p.ts AS in_order
        FROM events c JOIN events p ON p.event_id = c.event_id - c.event_id % 5 WHERE c.event_id % 5 <> 0""",
    "st1_metrics_tail": """SELECT event_type AS metric, count(*) AS n, round(sum(value), 6) AS total,
        min(value) AS low, max(value) AS high FROM events GROUP BY event_type""",
    "st2_stream_validate": f"""WITH {ALL_CHECKED}
        SELECT doc_id, CASE WHEN len(errors) = 0 THEN 'valid' ELSE 'quarantine' END AS side,
          array_to_string(errors, '; ') AS messages FROM all_checked""",
}
