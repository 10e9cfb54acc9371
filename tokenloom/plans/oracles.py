"""DuckDB SQL that says what the queries say: pre-tokenization by DuckDB's regex, and the merge loop as a recursive query over the
vocabulary's file."""

from __future__ import annotations

import os

from tokenloom.sources.vocabulary import candidates

# White space of the patterns, for a regex engine whose \s is ASCII; N: without line breaks.
_W = r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_N = _W.replace(r"\n", "", 1).replace(r"\r", "", 1)
_S = chr(0xE000)  # a private-use mark, before the last white space of a run with something visible after it
_X = r"(?i:'s|'t|'re|'ve|'m|'ll|'d|'\x{17F})?"
_SQL_PATTERNS = {
    "gpt2": (rf"([{_W}])([{_W}][^{_W}])", rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}{_S}\p{{L}}\p{{N}}]+|[{_W}]+|{_S}"),
    "cl100k": (rf"([{_W}])([{_N}][^{_W}])", rf"'(?i:[sdmt\x{{17F}}]|ll|ve|re)|[^\r\n{_S}\p{{L}}\p{{N}}]?\p{{L}}+|\p{{N}}{{1,3}}| ?[^{_W}{_S}\p{{L}}\p{{N}}]+[\r\n]*|[{_W}]+\z|[{_W}]*[\r\n]|[{_W}]+|{_S}"),
    "o200k": (
        rf"([{_W}])([{_N}][^{_W}])",
        rf"[^\r\n{_S}\p{{L}}\p{{N}}]?[\p{{Lu}}\p{{Lt}}\p{{Lm}}\p{{Lo}}\p{{M}}]*[\p{{Ll}}\p{{Lm}}\p{{Lo}}\p{{M}}]+{_X}|[^\r\n{_S}\p{{L}}\p{{N}}]?[\p{{Lu}}\p{{Lt}}\p{{Lm}}\p{{Lo}}\p{{M}}]+[\p{{Ll}}\p{{Lm}}\p{{Lo}}\p{{M}}]*{_X}"
        rf"|\p{{N}}{{1,3}}| ?[^{_W}{_S}\p{{L}}\p{{N}}]+[\r\n/]*|[{_W}]*[\r\n]+|[{_W}]+|{_S}",
    ),
}


def _pieces_sql(pattern: str) -> str:
    mark, split = (x.replace("'", "''") for x in _SQL_PATTERNS[pattern])
    return rf"list_filter(regexp_extract_all(regexp_replace(text, '{mark}', '\1{_S}\2', 'g'), '{split}'), lambda s: s <> '{_S}')"


def _pretokenize_sql(pattern: str) -> str:
    return f"""WITH p AS (SELECT doc_id, text, {_pieces_sql(pattern)} AS p FROM documents)
SELECT doc_id, CAST(len(p) AS BIGINT) AS n_pieces, md5(array_to_string(p, chr(1))) AS pieces_md5, CAST(strlen(text) AS BIGINT) AS n_bytes FROM p"""


PIECE_ENDS_SQL = f"""WITH p AS (SELECT doc_id, {_pieces_sql("gpt2")} AS p FROM documents),
x AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS piece_ix FROM p)
SELECT doc_id, CAST(piece_ix AS BIGINT) AS piece_ix, CAST(sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY piece_ix) AS BIGINT) AS end_byte FROM x"""
PIECE_FREQUENCY_SQL = f"SELECT piece, count(*) AS n FROM (SELECT unnest({_pieces_sql('gpt2')}) AS piece FROM documents) GROUP BY piece"
_MARKED_SQL = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || '<|endoftext|>' || text[1:20] ELSE text END AS text FROM documents)"
SEGMENT_SPLIT_SQL = rf"""WITH p AS (SELECT doc_id, list_filter(string_split_regex(replace(text, '<|endoftext|>', chr(57345) || '<|endoftext|>' || chr(57345)), chr(57345)), lambda s: s <> '') AS p FROM {_MARKED_SQL}),
x AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS ix FROM p)
SELECT doc_id, CAST(ix AS BIGINT) AS seg_ix, md5(s) AS segment_md5, CASE WHEN s = '<|endoftext|>' THEN 50256::BIGINT END AS special_id FROM x"""
HAS_DISALLOWED_SQL = f"SELECT doc_id, contains(text, '<|endoftext|>') AS disallowed FROM {_MARKED_SQL}"
CACHE_STATS_SQL = f"""WITH f AS ({PIECE_FREQUENCY_SQL}), s AS (SELECT CAST(sum(n) AS BIGINT) AS pieces, CAST(sum(CASE WHEN strlen(piece) <= 64 THEN 1 ELSE n END) AS BIGINT) AS misses FROM f)
SELECT pieces, misses, pieces - misses AS hits, (pieces - misses) / pieces::DOUBLE AS hit_rate FROM s"""
PARSE_IDS_SQL = "SELECT doc_id, doc_id || ',1,5,' || n_chars AS ids FROM documents"

_PATHS = candidates("r50k_base")
_FILE = next((p for p in _PATHS if os.path.isfile(p)), _PATHS[0])
#: token (hex digits) and id of the two 50k vocabularies.
_R50K = f"SELECT hex(from_base64(token)) AS token, id FROM read_csv('{_FILE}', delim = ' ', header = false, quote = '', escape = '', columns = {{'token': 'VARCHAR', 'id': 'BIGINT'}})"
_P50K = f"{_R50K} UNION ALL SELECT repeat('20', n), 50255 + n FROM range(2, 26) r(n)"


def merging(pieces: str, ranks: str = "ranks", name: str = "known") -> str:
    """CTEs: ``name`` (piece, ids, hexes) of the distinct pieces of the table ``pieces``. In each step the lowest-ranked adjacent pair
    of each piece merges, the leftmost of equals; a piece that is a token starts merged."""
    return rf"""{name}_0 AS MATERIALIZED (SELECT DISTINCT piece, hex(encode(piece)) AS h FROM {pieces} WHERE piece <> ''),
{name}_1(piece, step, t) AS (
  SELECT piece, 0, CASE WHEN h IN (SELECT token FROM {ranks}) THEN [h] ELSE regexp_extract_all(h, '..') END FROM {name}_0
  UNION ALL
  SELECT piece, step + 1, list_concat(t[1:i - 1], [t[i] || t[i + 1]], t[i + 2:]) FROM (
    SELECT piece, any_value(step) AS step, any_value(t) AS t, arg_min(i, id * 1048576 + i) AS i
    FROM (SELECT piece, step, t, unnest(range(1, len(t))) AS i FROM {name}_1 WHERE len(t) > 1) JOIN {ranks} r ON r.token = t[i] || t[i + 1] GROUP BY piece)),
{name}_2 AS MATERIALIZED (SELECT piece, arg_max(t, step) AS t FROM {name}_1 GROUP BY piece),
{name} AS MATERIALIZED (SELECT piece, list(id ORDER BY ix) AS ids, list(token ORDER BY ix) AS hexes
  FROM (SELECT piece, unnest(t) AS token, generate_subscripts(t, 1) AS ix FROM {name}_2) JOIN {ranks} USING (token) GROUP BY piece)"""


def encoding(texts: str = "documents", ranks: str = _R50K, prefix: str = "") -> str:
    """CTEs (after WITH RECURSIVE): ranks, cut (doc_id, piece, ix) and coded (doc_id, ids, counts, ends) of a table of doc_id, text."""
    return f"""{prefix}ranks AS MATERIALIZED ({ranks}), {prefix}src AS MATERIALIZED (SELECT doc_id, text FROM {texts}),
{prefix}p AS MATERIALIZED (SELECT doc_id, {_pieces_sql("gpt2")} AS p FROM {prefix}src),
{prefix}cut AS MATERIALIZED (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS ix FROM {prefix}p),
{merging(f"{prefix}cut", f"{prefix}ranks", f"{prefix}known")},
{prefix}sums AS MATERIALIZED (SELECT doc_id, flatten(list(ids ORDER BY ix)) AS ids, list(len(ids) ORDER BY ix) AS counts, list(strlen(piece) ORDER BY ix) AS sizes FROM {prefix}cut JOIN {prefix}known USING (piece) GROUP BY doc_id),
{prefix}coded AS MATERIALIZED (SELECT doc_id, coalesce(ids, []) AS ids, coalesce(counts, []) AS counts, coalesce(sizes, []) AS sizes FROM {prefix}src LEFT JOIN {prefix}sums USING (doc_id))"""


_CODED = f"WITH RECURSIVE {encoding()}"
_N = "CAST(len(ids) AS BIGINT)"
_SHOWN = "array_to_string(ids, ' ')"


def count_sql(ranks: str) -> str:
    return f"WITH RECURSIVE {encoding(ranks=ranks)} SELECT doc_id, {_N} AS n_tokens FROM coded"


#: Segments between special tokens are texts of their own; the special token's id stands between them.
_SEGMENTS = f"""(SELECT {{doc: doc_id, ix: ix}} AS doc_id, text FROM (SELECT doc_id, unnest(s) AS text, generate_subscripts(s, 1) AS ix FROM (SELECT doc_id, string_split(text, '<|endoftext|>') AS s FROM {_MARKED_SQL})))"""
_ALLOWED = f"""WITH RECURSIVE {encoding(_SEGMENTS)}, marked AS (SELECT doc_id.doc AS doc_id, flatten(list(CASE WHEN doc_id.ix > 1 THEN [50256::BIGINT] || ids ELSE ids END ORDER BY doc_id.ix)) AS ids FROM coded GROUP BY doc_id.doc)"""


def windows_cte(most: int, overlap: int, prefix: str = "") -> str:
    """CTE: w (doc_id, sums, first, stop): greedy windows of whole pieces; sums[k + 1] is what the first k pieces have."""
    return f"""{prefix}ws AS MATERIALIZED (SELECT doc_id, [0::HUGEINT] || list(s ORDER BY ix) AS sums FROM (SELECT doc_id, ix, sum(len(ids)) OVER (PARTITION BY doc_id ORDER BY ix) AS s FROM cut JOIN known USING (piece)) GROUP BY doc_id),
{prefix}w(doc_id, sums, first, stop) AS (
  SELECT doc_id, sums, 0::BIGINT, greatest(len(list_filter(sums, lambda x: x <= {most})) - 1, 1) FROM {prefix}ws
  UNION ALL
  SELECT doc_id, sums, next, greatest(len(list_filter(sums, lambda x: x - sums[next + 1] <= {most})) - 1, next + 1) FROM (
    SELECT doc_id, sums, greatest(first + 1, len(list_filter(sums, lambda x: x < sums[stop + 1] - {overlap}))) AS next FROM {prefix}w WHERE stop < len(sums) - 1))"""


def _windows(most: int, overlap: int) -> str:
    return f"""{_CODED}, {windows_cte(most, overlap)},
e AS MATERIALIZED (SELECT doc_id, [0::HUGEINT] || list(s ORDER BY ix) AS ends FROM (SELECT doc_id, ix, sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY ix) AS s FROM cut) GROUP BY doc_id),
o AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS ix, CAST(ends[first + 1] AS BIGINT) AS "start", CAST(ends[stop + 1] AS BIGINT) AS "end", CAST(sums[stop + 1] - sums[first + 1] AS INTEGER) AS tokens FROM w JOIN e USING (doc_id))"""


_CUT = """cuts AS (SELECT doc_id, CAST(max(CASE WHEN s <= 512 THEN e ELSE 0 END) AS BIGINT) AS cut FROM (
  SELECT doc_id, sum(len(ids)) OVER o AS s, sum(strlen(piece)) OVER o AS e FROM cut JOIN known USING (piece) WINDOW o AS (PARTITION BY doc_id ORDER BY ix)) GROUP BY doc_id)"""
_END = "len(ids[1:256])"
_SPECIALS = """(VALUES ('gpt2', 'r', 0, '<|endoftext|>', 50256), ('r50k_base', 'r', 0, '<|endoftext|>', 50256), ('p50k_base', 'p', 0, '<|endoftext|>', 50256),
  ('p50k_edit', 'p', 0, '<|endoftext|>', 50256), ('p50k_edit', 'p', 1, '<|fim_prefix|>', 50281), ('p50k_edit', 'p', 2, '<|fim_middle|>', 50282), ('p50k_edit', 'p', 3, '<|fim_suffix|>', 50283),
  ('cl100k_base', 'c', 0, '<|endoftext|>', 100257), ('cl100k_base', 'c', 1, '<|fim_prefix|>', 100258), ('cl100k_base', 'c', 2, '<|fim_middle|>', 100259), ('cl100k_base', 'c', 3, '<|fim_suffix|>', 100260), ('cl100k_base', 'c', 4, '<|endofprompt|>', 100276),
  ('o200k_base', 'o', 0, '<|endoftext|>', 199999), ('o200k_base', 'o', 1, '<|endofprompt|>', 200018),
  ('o200k_harmony', 'o', 0, '<|startoftext|>', 199998), ('o200k_harmony', 'o', 1, '<|endoftext|>', 199999), ('o200k_harmony', 'o', 2, '<|return|>', 200002), ('o200k_harmony', 'o', 3, '<|constrain|>', 200003),
  ('o200k_harmony', 'o', 4, '<|channel|>', 200005), ('o200k_harmony', 'o', 5, '<|start|>', 200006), ('o200k_harmony', 'o', 6, '<|end|>', 200007), ('o200k_harmony', 'o', 7, '<|message|>', 200008),
  ('o200k_harmony', 'o', 8, '<|call|>', 200012), ('o200k_harmony', 'o', 9, '<|endofprompt|>', 200018)) s(encoding, file, ord, name, id)"""
_ORDINARY_ID = "coalesce(id, -1)"

ORACLES = {
    **{f"pretokenize_{p}": _pretokenize_sql(p) for p in _SQL_PATTERNS},
    "piece_ends": PIECE_ENDS_SQL, "piece_frequency": PIECE_FREQUENCY_SQL, "segment_split": SEGMENT_SPLIT_SQL, "has_disallowed_special": HAS_DISALLOWED_SQL,
    "cache_stats": CACHE_STATS_SQL, "parse_ids": PARSE_IDS_SQL,
    "estimated_tokens": "SELECT doc_id, CAST(strlen(text) // 3 + 16 AS BIGINT) AS estimate FROM documents",
    "tokens_by_lang_source": f"{_CODED} SELECT lang, source, count(*) AS n_docs, CAST(sum(len(ids)) AS BIGINT) AS n_tokens FROM coded JOIN documents USING (doc_id) GROUP BY ALL",
    **{f"count_ordinary_{n}": count_sql(r) for n, r in (("gpt2", _R50K), ("r50k_base", _R50K), ("p50k_base", _P50K), ("p50k_edit", _P50K))},
    "encode_ordinary": f"{_CODED} SELECT doc_id, {_SHOWN} AS ids, {_N} AS n_tokens FROM coded",
    "encode_onto": f"{_CODED} SELECT doc_id, array_to_string([50256] || ids, ' ') AS ids FROM coded",
    "flat_batch": f"{_CODED}, s AS (SELECT *, sum(len(ids)) OVER (ORDER BY doc_id) - len(ids) AS base FROM coded) SELECT CAST(base + k AS BIGINT) AS place, CAST(id AS INTEGER) AS id FROM (SELECT base, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS k FROM s)",
    "count_special": f"{_ALLOWED} SELECT doc_id, {_N} AS n_tokens FROM marked",
    "encode_allowed": f"{_ALLOWED} SELECT doc_id, {_SHOWN} AS ids FROM marked",
    "decode_roundtrip": f"{_CODED}, h AS (SELECT doc_id, string_agg(array_to_string(hexes, ''), '' ORDER BY ix) AS h FROM cut JOIN known USING (piece) GROUP BY doc_id) SELECT doc_id, decode(unhex(coalesce(h, ''))) AS text, md5({_SHOWN}) AS ids_md5 FROM coded LEFT JOIN h USING (doc_id)",
    "token_id_of": f"WITH r AS ({_R50K}), w AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM documents) SELECT word, CAST({_ORDINARY_ID} AS INTEGER) AS id FROM w LEFT JOIN r ON token = hex(encode(word))",
    "token_bytes": f"WITH r AS ({_P50K} UNION ALL SELECT hex(encode(name)), id FROM {_SPECIALS} WHERE encoding = 'p50k_edit') SELECT CAST(i AS INTEGER) AS token_id, token, CAST(coalesce(length(token) // 2, 0) AS INTEGER) AS length, token IS NOT NULL AS assigned FROM range(50300) t(i) LEFT JOIN r ON id = i",
    "fits_ordinary": f"{_CODED} SELECT doc_id, len(ids) <= 512 AS fits FROM coded",
    "truncate_ordinary": f"{_CODED}, {_CUT} SELECT doc_id, coalesce(cut, 0) AS cut FROM coded LEFT JOIN cuts USING (doc_id)",
    "budget_report": f"{_CODED}, {_CUT} SELECT doc_id, {_N} AS total, len(ids) <= 512 AS fits, greatest(0, {_N} - 512) AS overflow, coalesce(cut, 0) AS cut FROM coded LEFT JOIN cuts USING (doc_id)",
    **{n: f"""{_windows(256, o)} SELECT *, '[' || "start" || ', ' || "end" || ') ' || tokens || ' tokens' AS shown FROM o""" for n, o in (("windows", 0), ("windows_overlap", 32))},
    "chunk_and_pad": f"""{_windows(256, 32)}, chunks AS MATERIALIZED (SELECT {{doc: doc_id, ix: ix}} AS doc_id, decode(unhex(substr(hex(encode(text)), 2 * "start" + 1, 2 * ("end" - "start")))) AS text FROM o JOIN documents USING (doc_id)),
{encoding("chunks", prefix="c_")} SELECT doc_id.doc AS doc_id, count(*) AS chunks, CAST(sum(len(ids)) AS BIGINT) AS real, CAST(sum((SELECT max(len(ids)) FROM c_coded) - len(ids)) AS BIGINT) AS padding FROM c_coded GROUP BY doc_id.doc""",
    "batch_offsets": f'{_CODED} SELECT doc_id, CAST(sum(len(ids)) OVER o - len(ids) AS BIGINT) AS "start", CAST(sum(len(ids)) OVER o AS BIGINT) AS "end" FROM coded WINDOW o AS (ORDER BY doc_id)',
    "pad_batch": f"""{_CODED}, b AS (SELECT doc_id, CAST(floor(doc_id / 64) AS BIGINT) AS batch, ids[1:256] AS ids, len(ids[1:256]) AS n FROM coded), x AS (SELECT *, max(n) OVER (PARTITION BY batch) AS width FROM b)
SELECT doc_id, batch, array_to_string(list_concat(ids, list_transform(range(width - n), lambda k: 50256)), ' ') AS ids, repeat('1', n) || repeat('0', width - n) AS mask, CAST(n AS INTEGER) AS length, CAST(width AS INTEGER) AS width FROM x""",
    "pad_mask_totals": f"{_CODED} SELECT count(*) AS rows, CAST(max(len(ids)) AS INTEGER) AS width, CAST(sum(len(ids)) AS BIGINT) AS real, CAST(count(*) * max(len(ids)) - sum(len(ids)) AS BIGINT) AS padding FROM coded",
    "padded_at": f"""WITH RECURSIVE {encoding("(SELECT doc_id, text || repeat(' a', 256) AS text FROM documents)")} SELECT doc_id, CAST(ids[1] AS INTEGER) AS ids_0, CAST(ids[256] AS INTEGER) AS ids_255, 1 AS mask_0, 1 AS mask_255 FROM coded""",
    "format_json": f"{_CODED} SELECT doc_id, {_SHOWN} AS space, array_to_string(ids, chr(10)) AS lines, '[' || array_to_string(ids, ',') || ']' AS json FROM coded",
    "vocab_summary": f"""WITH r AS (SELECT 'r' AS file, * FROM ({_R50K}) UNION ALL SELECT 'p', * FROM ({_P50K})), f AS (SELECT file, max(id) + 1 AS merge_count, count(*) AS ranks FROM r GROUP BY file)
SELECT encoding, greatest(any_value(merge_count) - 1, max(id)) + 1 AS n_vocab, any_value(merge_count) AS merge_count, any_value(ranks) AS ranks, count(*) AS specials FROM {_SPECIALS} JOIN f USING (file) GROUP BY encoding""",
    "special_registry": f"""WITH named AS (SELECT encoding, ord, name, id FROM {_SPECIALS}),
every AS (SELECT * FROM named UNION ALL SELECT 'o200k_harmony', 10 + i - 200000, '<|reserved_' || i || '|>', i FROM range(200000, 201088) r(i) WHERE i NOT IN (SELECT id FROM named WHERE encoding = 'o200k_harmony' AND name <> '<|endofprompt|>'))
SELECT encoding, count(*) AS names, count(DISTINCT id) AS ids, CAST(max(id) AS BIGINT) AS highest, arg_min(name, ord) AS first_name FROM every GROUP BY encoding""",
    "vocab_diff": f"""SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.id IS NULL THEN 'right' WHEN b.id IS NULL THEN 'left' WHEN a.id = b.id THEN 'shared' ELSE 'moved' END AS change
FROM ({_R50K}) a FULL JOIN ({_P50K}) b USING (token)) GROUP BY change""",
}
