"""SQL twins of the registered queries, for a plain SQL engine on the same tables.

They are written independently of the Spark plans: strings are folded where Spark packs
offsets, windows of long sentences come from a recursive query, and nearest neighbours from
a sparse product over all pairs.
"""

from __future__ import annotations

from chunkloom.functions.text import WS, WS_IN_LINE
from chunkloom.model import EXTENSIONS, SEMANTIC, TEMPLATES, WHITESPACE, Template, get_template

STAMP = "2026-01-01 00:00:00"
ORACLE: dict[str, str] = {}

_STRIP = "'" + WHITESPACE + "'"


def strip(x: str) -> str:
    return f"trim({x}, {_STRIP})"


def with_(*ctes: str, recursive: bool = True) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


# --- corpora ------------------------------------------------------------------------------

FILES = """files AS (
  SELECT *, '/data/docs/' || source || '/' || doc_id || '.txt' AS path FROM documents)"""


def corpus_cte(name: str = "corpus", source: str = "files", text: str = "text") -> str:
    return f"""{name} AS (
  SELECT path, '[文件名: ' || doc_id || ']' || chr(10) || {text} AS text
  FROM {source} WHERE {strip('text')} <> '')"""


LABELLED = """labelled AS (
  SELECT f.*, l.quality, l.toxic FROM files f LEFT JOIN labels l USING (doc_id))"""
BEFORE = f"""before_files AS (SELECT * FROM labelled WHERE quality IS DISTINCT FROM 0),
{corpus_cte('corpus_before', 'before_files')}"""
NOW = f"""now_files AS (SELECT * FROM labelled WHERE toxic IS DISTINCT FROM 1),
{corpus_cte('corpus_now', 'now_files', "CASE WHEN quality = 1 THEN text || ' reviewed' ELSE text END")}"""
TOXIC = "toxic AS (SELECT path AS source FROM labelled WHERE toxic = 1)"
WEB_PATHS = "web_paths AS (SELECT '/data/web/' || substr(md5(url), 1, 12) || '.txt' AS path FROM pages)"

_MARKUP = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|</?[a-z!?][^>]*>"


def _unescape(x: str) -> str:
    """Character references that occur in the pages; the closing semicolon may be missing."""
    for name, char in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", "\xa0"),
                       ("copy", "©"), ("middot", "·"), ("amp", "&")]:
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return x


PAGES = f"""page_titles AS (
  SELECT *, {_unescape(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)")} AS t FROM pages),
page_rows AS (
  SELECT page_id, url, CASE WHEN t = '' THEN url ELSE t END AS title,
    {strip(f"regexp_replace({_unescape(f"regexp_replace(html, '{_MARKUP}', '', 'g')")}, '[{WS}]+', ' ', 'g')")} AS text
  FROM page_titles),
page_docs AS (
  SELECT '/data/web/' || substr(md5(url), 1, 12) || '.txt' AS path, title,
    '[网页标题: ' || title || ']' || chr(10) || '[来源: ' || url || ']' || chr(10)
    || '[爬取时间: {STAMP}]' || chr(10) || chr(10) || text AS text
  FROM page_rows WHERE text <> ''),
web_corpus AS (
  SELECT path, title, '[文件名: ' || replace(replace(path, '/data/web/', ''), '.txt', '') || ']' || chr(10) || text AS text
  FROM page_docs)"""


# --- chunking ------------------------------------------------------------------------------


def _trimmed(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda x: {strip('x')}), lambda x: x <> '')"


def _regex_of(marks: list[str]) -> str:
    special = {"\n": r"\n", "\r": r"\r", ".": r"\.", "?": r"\?"}
    return "|".join("".join(special.get(c, c) for c in m) for m in sorted(marks, key=len, reverse=True))


def _finish(n: str, t: Template, out: str) -> str:
    """Trim, cut what is above one and a half sizes, number the chunks."""
    s = t.chunk_size
    return f"""{n}_cut AS (
  SELECT path, flatten(list_transform({_trimmed(out)},
    lambda c: CASE WHEN length(c) <= {1.5 * s} THEN [c]
      ELSE {_trimmed(f"list_transform(range(0, length(c), {s}), lambda i: substr(c, (i + 1)::BIGINT, {s}))")} END)) AS cs
  FROM {n}_fold),
{n} AS (
  SELECT path, (unnest(range(len(cs))))::INTEGER AS chunk_index, unnest(cs) AS text FROM {n}_cut)"""


def _pack_step(t: Template, long_rule: str = "") -> str:
    carry = f"right(a.cur, {t.overlap}) || ' ' || x.s" if t.overlap else "x.s"
    return f"""lambda a, x: CASE {long_rule}
      WHEN a.cur = '' THEN {{'out': a.out, 'cur': x.s}}
      WHEN length(a.cur) + length(x.s) > {t.chunk_size} THEN {{'out': list_append(a.out, a.cur),
        'cur': CASE WHEN length(a.cur) > {t.overlap} THEN {carry} ELSE x.s END}}
      ELSE {{'out': a.out, 'cur': a.cur || ' ' || x.s}} END"""


_START = "{'out': []::VARCHAR[], 'cur': ''}"


def _flat(n: str, src: str, t: Template) -> str:
    segs = _trimmed(f"regexp_split_to_array(text, '{_regex_of([m for m in t.separators if m])}')")
    return f"""{n}_fold AS (
  SELECT path, list_append(f.out, f.cur) AS o FROM (
    SELECT path, list_reduce(list_transform({segs}, lambda s: {{'s': s}}), {_pack_step(t)}, {_START}) AS f FROM {src})),
{_finish(n, t, 'o')}"""


def _recursive(n: str, src: str, t: Template) -> str:
    size, half, overlap = t.chunk_size, t.chunk_size // 2, t.overlap
    paras = [m for m in ("\n\n", "\r\n\r\n", "\r\n") if m in t.separators] or ["\n\n"]
    marks = [m for m in t.separators if m and m not in ("\n\n", "\r\n\r\n", "\r\n", " ", "\n")]
    kept = "".join(m for m in marks if len(m) == 1 and m in "。!！?？;；")
    dropped = "".join(m for m in marks if m in "，,、")
    x = "para"
    if kept:
        x = f"regexp_replace({x}, '[{WS}]*([{kept}])', '\\1' || chr(2) || chr(1), 'g')"
    if ". " in marks:
        x = f"regexp_replace({x}, '[{WS}]*\\. ', '.' || chr(2) || chr(1), 'g')"
    if dropped:
        x = f"regexp_replace({x}, '[{dropped}]', chr(1), 'g')"
    pieces = f"list_filter({_trimmed(f'string_split({x}, chr(1))')}, lambda y: NOT (length(y) = 2 AND contains(y, chr(2))))"
    pieces = f"list_transform({pieces}, lambda y: replace(y, chr(2), ''))"
    if not marks:
        pieces = "[para]"
    long_rule = f"""WHEN x.hard IS NOT NULL THEN {{'out': list_concat(a.out,
        CASE WHEN a.cur = '' THEN []::VARCHAR[] ELSE [a.cur] END, x.hard), 'cur': ''}}"""
    return f"""{n}_paras AS (
  SELECT path, unnest(range(len(ps))) AS p, unnest(ps) AS para FROM (
    SELECT path, {_trimmed(f"regexp_split_to_array(text, '{_regex_of(paras)}')")} AS ps FROM {src})),
{n}_lists AS (
  SELECT path, p, CASE WHEN length(para) <= {size} THEN [para] ELSE {pieces} END AS ss FROM {n}_paras),
{n}_segs AS (
  SELECT path, p, unnest(range(len(ss))) AS q, unnest(ss) AS s FROM {n}_lists),
{n}_windows(path, p, q, s, i, piece) AS (
  SELECT path, p, q, s, 0::BIGINT, NULL::VARCHAR FROM {n}_segs WHERE length(s) > {size}
  UNION ALL
  SELECT path, p, q, s,
    CASE WHEN length(s) - i <= {size} THEN length(s) + 1 ELSE i + cut - {overlap} END,
    CASE WHEN length(s) - i <= {size} THEN substr(s, i + 1) ELSE substr(s, i + 1, cut) END
  FROM (
    SELECT *, CASE WHEN sp > {half} THEN sp ELSE {size} END AS cut FROM (
      SELECT *, CASE WHEN contains(substr(s, i + 1, {size}), ' ')
        THEN length(regexp_extract(substr(s, i + 1, {size}), '(?s)^(.*) ', 1)) ELSE -1 END AS sp
      FROM {n}_windows WHERE i < length(s)))),
{n}_hard AS (
  SELECT path, p, q, list(piece ORDER BY i) AS hard FROM {n}_windows WHERE piece IS NOT NULL GROUP BY path, p, q),
{n}_items AS (
  SELECT path, list({{'s': s, 'hard': hard}} ORDER BY p, q) AS xs
  FROM {n}_segs LEFT JOIN {n}_hard USING (path, p, q) GROUP BY path),
{n}_fold AS (
  SELECT path, list_append(f.out, f.cur) AS o FROM (
    SELECT path, list_reduce(xs, {_pack_step(t, long_rule)}, {_START}) AS f FROM {n}_items)),
{_finish(n, t, 'o')}"""


def _sentence_list(text: str = "text") -> str:
    w = r"[\p{L}\p{N}_]"
    dotted = f"regexp_replace(regexp_replace({text}, '({w})\\.({w})', '\\1' || chr(2) || '\\2', 'g'), '({w})\\.({w})', '\\1' || chr(2) || '\\2', 'g')"
    marked = f"regexp_replace({dotted}, '([。！？；.!?;\\n])', '\\1' || chr(1), 'g')"
    return f"list_transform({_trimmed(f'string_split({marked}, chr(1))')}, lambda x: replace(x, chr(2), '.'))"


def _sentence(n: str, src: str, t: Template) -> str:
    sents = _sentence_list()
    keep = t.overlap_sentences
    return f"""{n}_fold AS (
  SELECT path, list_append(f.out, array_to_string(f.cur, '')) AS o FROM (
    SELECT path, list_reduce({sents}, lambda a, x: CASE
        WHEN len(a.cur) > 0 AND length(array_to_string(a.cur, '')) + length(x) > {t.chunk_size}
        THEN {{'out': list_append(a.out, array_to_string(a.cur, '')), 'cur': list_append(a.cur[-{keep}:], x)}}
        ELSE {{'out': a.out, 'cur': list_append(a.cur, x)}} END,
      {{'out': []::VARCHAR[], 'cur': []::VARCHAR[]}}) AS f FROM {src})),
{n} AS (
  SELECT path, (unnest(range(len(cs))))::INTEGER AS chunk_index, unnest(cs) AS text
  FROM (SELECT path, {_trimmed('o')} AS cs FROM {n}_fold))"""


def _semantic(n: str, src: str, t: Template) -> str:
    return f"""{n}_sents AS (
  SELECT path, unnest(range(len(ss))) AS i, unnest(ss) AS s FROM (SELECT path, {_sentence_list()} AS ss FROM {src})),
{n}_bags AS (
  SELECT path, i, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b, count(*) AS k FROM (
    SELECT path, i, unnest(regexp_split_to_array(lower(s), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {n}_sents) WHERE w <> '' GROUP BY ALL),
{n}_norms AS (SELECT path, i, sum(k * k)::DOUBLE AS q FROM {n}_bags GROUP BY ALL),
{n}_dots AS (
  SELECT x.path, x.i, sum(x.k * y.k)::DOUBLE AS d FROM {n}_bags x JOIN {n}_bags y ON x.path = y.path AND y.i = x.i + 1 AND x.b = y.b GROUP BY ALL),
{n}_edges AS (
  SELECT x.path, y.i, coalesce(d / sqrt(p.q * q.q), 0) AS c FROM {n}_sents x JOIN {n}_sents y ON x.path = y.path AND y.i = x.i + 1
  LEFT JOIN {n}_dots e ON e.path = x.path AND e.i = x.i LEFT JOIN {n}_norms p ON p.path = x.path AND p.i = x.i
  LEFT JOIN {n}_norms q ON q.path = x.path AND q.i = y.i),
{n}_ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY c) AS r, count(*) OVER (PARTITION BY path) AS m FROM {n}_edges),
{n}_marked AS (SELECT *, c < min(c) FILTER (r * 100 >= m * 20) OVER (PARTITION BY path) AS cut FROM {n}_ranked),
{n}_items AS (
  SELECT path, list({{'s': s, 'cut': coalesce(cut, false)}} ORDER BY i) AS xs FROM {n}_sents LEFT JOIN {n}_marked USING (path, i) GROUP BY path),
{n}_fold AS (
  SELECT path, list_append(f.out, f.cur) AS o FROM (
    SELECT path, list_reduce(xs, lambda a, x: CASE
        WHEN a.cur = '' THEN {{'out': a.out, 'cur': x.s}}
        WHEN x.cut OR length(a.cur) + 1 + length(x.s) > {t.chunk_size} THEN {{'out': list_append(a.out, a.cur), 'cur': x.s}}
        ELSE {{'out': a.out, 'cur': a.cur || ' ' || x.s}} END, {_START}) AS f FROM {n}_items)),
{_finish(n, t, 'o')}"""


def _headers(n: str, src: str, t: Template) -> str:
    size = t.chunk_size
    return f"""{n}_lines AS (
  SELECT path, i, line, regexp_matches(line, '^#{{1,6}}[{WS_IN_LINE}]') AS is_header FROM (
    SELECT path, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (
      SELECT path, list_transform(string_split(text, chr(10)), lambda x: {strip('x')}) AS ls FROM {src}))
  WHERE line <> ''),
{n}_numbered AS (
  SELECT *, sum(is_header::INTEGER) OVER (PARTITION BY path ORDER BY i) AS section FROM {n}_lines),
{n}_bodies AS (
  SELECT path, section, max(line) FILTER (is_header) AS head,
    list({{'s': line}} ORDER BY i) FILTER (NOT is_header) AS body
  FROM {n}_numbered GROUP BY path, section),
{n}_parts AS (
  SELECT path, section, head, list_append(f.out, f.cur) AS o FROM (
    SELECT path, section, head, list_reduce(body, lambda a, x: CASE
        WHEN a.n + length(x.s) <= {size}
        THEN {{'out': a.out, 'cur': CASE WHEN a.cur = '' THEN x.s ELSE a.cur || chr(10) || x.s END,
               'n': (a.n + length(x.s))::BIGINT}}
        ELSE list_transform([list_reduce(
            range((length(a.cur) + 1 + length(x.s)) // {size}),
            lambda b, i: CASE WHEN length(b.rest) <= {size} THEN b
              ELSE {{'out': list_append(b.out, {strip(f'substr(b.rest, 1, {size})')}),
                     'rest': {strip(f'substr(b.rest, {size + 1})')}}} END,
            {{'out': a.out, 'rest': CASE WHEN a.cur = '' THEN x.s ELSE a.cur || chr(10) || x.s END}})],
          lambda b: {{'out': b.out, 'cur': b.rest, 'n': length(b.rest)::BIGINT}})[1] END,
      {{'out': []::VARCHAR[], 'cur': '', 'n': 0::BIGINT}}) AS f
    FROM {n}_bodies WHERE body IS NOT NULL)),
{n}_flat AS (
  SELECT path, section, unnest(range(len(o))) AS j,
    CASE WHEN head IS NULL THEN '' ELSE head || chr(10) END || unnest(o) AS text FROM {n}_parts),
{n} AS (
  SELECT path, (row_number() OVER (PARTITION BY path ORDER BY section, j) - 1)::INTEGER AS chunk_index, text FROM {n}_flat)"""


def chunks_cte(name: str, source: str, template: str | Template = "academic") -> str:
    """CTEs that end in ``name(path, chunk_index, text)``."""
    t = get_template(template)
    build = {"recursive": _recursive, "sentence": _sentence, "semantic": _semantic, "markdown_header": _headers}.get(t.strategy, _flat)
    return build(name, source, t)


def records_cte(name: str, chunks: str, source: str) -> str:
    return f"""{name} AS (
  SELECT substr(md5(c.path), 1, 12) || '-' || c.chunk_index AS id, c.text, c.path AS source, 'local_file' AS source_type,
    split_part(c.path, '/', -1) AS source_name, c.chunk_index, md5(d.text) AS content_hash, '{STAMP}' AS created_at
  FROM {chunks} c JOIN {source} d USING (path))"""


def docs_cte(name: str, records: str) -> str:
    return f"""{name} AS (
  SELECT source, any_value(source_name) AS source_name, any_value(source_type) AS source_type,
    any_value(content_hash) AS content_hash, any_value(created_at) AS created_at, count(*) AS chunks
  FROM {records} GROUP BY source)"""


CHUNKS = [FILES, corpus_cte(), chunks_cte("cut", "corpus"), records_cte("chunks", "cut", "corpus")]
STORED = [*CHUNKS, docs_cte("stored", "chunks")]
CHUNKS_BEFORE = [FILES, LABELLED, BEFORE, chunks_cte("cut_before", "corpus_before"),
                 records_cte("chunks_before", "cut_before", "corpus_before")]
DIFF = [*CHUNKS_BEFORE, docs_cte("was", "chunks_before"), NOW,
        "cur AS (SELECT path AS source, md5(text) AS current_hash FROM corpus_now)"]
PLAN = [*DIFF, """plan AS (
  SELECT source, CASE WHEN cur.current_hash IS NULL THEN 'delete' WHEN was.content_hash IS NULL THEN 'add'
      WHEN was.content_hash = cur.current_hash THEN 'unchanged' ELSE 'update' END AS action,
    was.content_hash AS stored_hash, cur.current_hash, was.chunks AS stored_chunks
  FROM cur FULL JOIN was USING (source))"""]
CHUNK_COLS = "id, text, source, source_type, source_name, chunk_index, content_hash, created_at"


# --- sources ---------------------------------------------------------------------------------

IMPORT_FILES = """disk AS (
  SELECT path, text FROM files
  UNION ALL SELECT '/data/docs/tools/' || doc_id || '.EXE', 'MZ' FROM labels
  UNION ALL SELECT '/data/docs/blank/' || item_id || '.md', ' ' || chr(10) || chr(12288) FROM benchmark)"""
_EXT = "lower(regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]+)$', 1))"
_EXT_LIST = ", ".join(f"'{e}'" for e in EXTENSIONS)

ORACLE["load_corpus"] = with_(FILES, corpus_cte()) + "SELECT path, text FROM corpus"
ORACLE["ext_support"] = with_(FILES, IMPORT_FILES) + f"""
SELECT path, {_EXT} AS ext, {_EXT} IN ({_EXT_LIST}) AS supported
FROM (SELECT path FROM disk UNION ALL SELECT url FROM pages)"""
_IMPORT = [*CHUNKS, IMPORT_FILES, WEB_PATHS,
           "requests AS (SELECT path AS file FROM disk UNION ALL SELECT path FROM web_paths)",
           f"""checked AS (
  SELECT file, CASE WHEN d.path IS NULL THEN '文件不存在'
    WHEN {_EXT.replace('path', 'file')} NOT IN ({_EXT_LIST}) THEN '不支持的格式: .' || {_EXT.replace('path', 'file')}
    WHEN {strip('d.text')} = '' THEN '文件内容为空' END AS message
  FROM requests LEFT JOIN disk d ON d.path = file)""",
           """status AS (
  SELECT file, CASE WHEN message IS NULL THEN 'success' ELSE 'error' END AS status,
    CASE WHEN message IS NULL THEN coalesce(n, 0) END AS chunks, message
  FROM checked LEFT JOIN (SELECT source, count(*) AS n FROM chunks GROUP BY source) ON source = file)"""]
ORACLE["import_status"] = with_(*_IMPORT) + "SELECT file, status, chunks, message FROM status"
ORACLE["import_summary"] = with_(*_IMPORT) + """
SELECT count(*) FILTER (status = 'success') AS imported, coalesce(sum(chunks), 0)::BIGINT AS total_chunks,
  count(*) AS total_files FROM status"""
ORACLE["decode_files"] = r"""
WITH plain AS (SELECT doc_id, doc_id % 3 AS kind, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS t FROM documents)
SELECT doc_id, CASE kind WHEN 0 THEN 'utf-8' WHEN 1 THEN 'gbk' ELSE 'latin-1' END AS charset,
  md5(regexp_replace(t || CASE WHEN kind = 2 THEN chr(13) || 'ÿÿ' ELSE chr(13) || chr(10) || '文件' END, '\r\n?', chr(10), 'g')) AS text_hash FROM plain"""
ORACLE["page_text"] = with_(PAGES) + "SELECT page_id, url, title, text FROM page_rows WHERE text <> ''"
ORACLE["page_document"] = with_(PAGES) + "SELECT path, title, text FROM page_docs"
ORACLE["dedup_name_size"] = with_(FILES) + """
SELECT source AS name, n_chars AS size, path FROM (
  SELECT *, row_number() OVER (PARTITION BY source, n_chars ORDER BY path) AS rn FROM files) WHERE rn = 1"""
ORACLE["corpus_union"] = with_(FILES, corpus_cte(), PAGES) + """
SELECT path, text FROM corpus UNION SELECT path, text FROM web_corpus"""

# --- projections and filters --------------------------------------------------------------------

ORACLE["content_hash"] = "SELECT doc_id, md5(text) AS content_hash FROM documents"
ORACLE["chunk_records"] = with_(*CHUNKS) + f"SELECT {CHUNK_COLS} FROM chunks"
ORACLE["source_name"] = with_(FILES, PAGES) + """
SELECT path, 'local_file' AS kind, split_part(path, '/', -1) AS source_name FROM files
UNION ALL SELECT path, 'web_crawl', coalesce(title, path) FROM web_corpus"""
ORACLE["source_class"] = with_(FILES, WEB_PATHS) + """
SELECT path, CASE WHEN contains(replace(path, '\\', '/'), '/data/web/') THEN 'web' ELSE 'docs' END AS source_class
FROM (SELECT path FROM files UNION ALL SELECT path FROM web_paths)"""
ORACLE["scope_filter"] = with_(FILES, WEB_PATHS) + """
SELECT 'docs' AS scope, path AS source FROM files UNION ALL SELECT 'web', path FROM web_paths"""
ORACLE["filter_source"] = with_(*CHUNKS) + f"SELECT {CHUNK_COLS} FROM chunks WHERE source = '/data/docs/src3/3.txt'"
ORACLE["name_lookup"] = with_(*STORED) + """
SELECT source, source_name, CASE WHEN source_name = '12.TXT' THEN 0 ELSE 1 END::INTEGER AS match_rank, chunks
FROM stored WHERE contains(lower(source_name), '12.txt') ORDER BY 3, 1 LIMIT 1"""
ORACLE["name_match_batch"] = with_(*STORED) + """
SELECT DISTINCT source, source_name, chunks FROM stored
JOIN benchmark ON contains(lower(source_name), lower(item_id || '.T'))"""
_MICRO = "array_to_string(list_transform({}, lambda x: (round(x::DOUBLE * 1e6))::BIGINT), ',')"
ORACLE["vector_resize"] = f"""
SELECT vec_id, {_MICRO.format('embedding[1:48]')} AS shorter,
  {_MICRO.format('list_concat(embedding, list_transform(range(16), lambda i: 0.0::FLOAT))')} AS longer FROM embeddings"""
ORACLE["token_usage"] = f"""
SELECT lang, source, sum(CASE WHEN {strip('text')} = '' THEN 0
  ELSE len(regexp_split_to_array({strip('text')}, '[{WS}]+')) END)::BIGINT AS prompt_tokens
FROM documents GROUP BY lang, source"""
ORACLE["catalog_page"] = with_(*STORED) + """
SELECT path, split_part(path, '/', -1) AS name, CASE WHEN chunks IS NULL THEN 'local' ELSE 'imported' END AS status,
  coalesce(chunks, 0) AS chunks
FROM files LEFT JOIN (SELECT source AS path, chunks FROM stored) USING (path) ORDER BY path LIMIT 20 OFFSET 20"""

# --- chunking ---------------------------------------------------------------------------------------

_ROWS = "SELECT substr(md5(path), 1, 12) || '-' || chunk_index AS id, path AS source, chunk_index, text FROM cut"
ORACLE["chunk_flat"] = with_(FILES, corpus_cte(), chunks_cte("cut", "corpus", "code")) + _ROWS
ORACLE["chunk_recursive"] = with_(
    FILES, corpus_cte(), "paras AS (SELECT path, replace(text, chr(10), chr(10) || chr(10)) AS text FROM corpus)",
    chunks_cte("cut", "paras")) + _ROWS
ORACLE["chunk_hard_split"] = with_(FILES, corpus_cte(), chunks_cte("cut", "corpus", "custom")) + _ROWS
ORACLE["chunk_sentence"] = with_(FILES, corpus_cte(), chunks_cte("cut", "corpus", "sentence")) + _ROWS
ORACLE["chunk_semantic"] = with_(FILES, corpus_cte(), chunks_cte("cut", "corpus", SEMANTIC)) + _ROWS
ORACLE["chunk_markdown"] = with_(
    FILES, corpus_cte(),
    """md AS (SELECT path, array_to_string(list_transform(string_split(text, chr(10)),
    lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN '# ' || x ELSE x END), chr(10)) AS text FROM corpus)""",
    chunks_cte("cut", "md", "markdown_header")) + _ROWS
ORACLE["chunk_stats_by_template"] = with_(
    FILES, corpus_cte(), *[chunks_cte(f"t_{n}", "corpus", n) for n in TEMPLATES]) + "\nUNION ALL ".join(
    f"""SELECT '{n}' AS template, count(*) AS chunks, max(length(text))::INTEGER AS max_len,
  min(length(text))::INTEGER AS min_len, round(sum(length(text)) / count(*), 6) AS avg_len FROM t_{n}""" for n in TEMPLATES)

_SHARES = "(VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) shares(p)"
ORACLE["chunk_percentiles"] = with_(
    FILES, corpus_cte(), *[chunks_cte(f"t_{n}", "corpus", n) for n in TEMPLATES],
    "counts AS (" + " UNION ALL ".join(f"SELECT '{n}' AS template, count(*) AS n FROM t_{n}" for n in TEMPLATES) + ")") + f"""
SELECT template, p, n, TRUE AS inside FROM counts, {_SHARES}"""

# --- diffs ------------------------------------------------------------------------------------------

ORACLE["sync_new"] = with_(*DIFF) + "SELECT source FROM cur EXCEPT SELECT source FROM was"
ORACLE["sync_deleted"] = with_(*DIFF) + "SELECT source FROM was EXCEPT SELECT source FROM cur"
ORACLE["sync_common"] = with_(*DIFF) + "SELECT source FROM cur INTERSECT SELECT source FROM was"
ORACLE["sync_changed"] = with_(*DIFF) + """
SELECT source, current_hash, content_hash AS stored_hash FROM cur JOIN was USING (source)
WHERE content_hash <> current_hash"""
ORACLE["sync_plan"] = with_(*PLAN) + "SELECT source, action, stored_hash, current_hash, stored_chunks FROM plan"
_SYNCED = [*PLAN, chunks_cte("cut_now", "corpus_now"), records_cte("chunks_now", "cut_now", "corpus_now")]
ORACLE["sync_stats"] = with_(*_SYNCED) + """
SELECT count(*) FILTER (action = 'add') AS added, count(*) FILTER (action = 'update') AS updated,
  count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action = 'delete') AS deleted,
  (SELECT count(*) FROM chunks_now JOIN plan USING (source) WHERE action = 'add') AS added_chunks FROM plan"""
_CATALOG = [*DIFF, """catalog AS (
  SELECT source AS path, CASE WHEN cur.current_hash IS NOT NULL THEN split_part(source, '/', -1) ELSE source_name END AS name,
    CASE WHEN contains(source, '/data/web/') THEN 'web' ELSE 'local' END AS source_type,
    CASE WHEN chunks IS NULL THEN 'local' WHEN cur.current_hash IS NULL THEN 'orphan' ELSE 'imported' END AS status,
    coalesce(chunks, 0) AS chunks, coalesce(content_hash, '') AS content_hash, coalesce(created_at, '') AS created_at
  FROM cur FULL JOIN was USING (source))"""]
ORACLE["document_catalog"] = with_(*_CATALOG) + """
SELECT path, name, source_type, status, chunks, content_hash, created_at FROM catalog"""
ORACLE["status_counts"] = with_(*_CATALOG) + """
SELECT count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'local') AS local,
  count(*) FILTER (status = 'orphan') AS orphan FROM catalog"""
_WITH_WEB = [*CHUNKS_BEFORE, docs_cte("was_docs", "chunks_before"), NOW, PAGES,
    """numbered AS (SELECT w.path, w.text, p.page_id FROM web_corpus w JOIN pages p ON w.path = '/data/web/' || substr(md5(p.url), 1, 12) || '.txt')""",
    "stored_pages AS (SELECT path, text FROM numbered WHERE page_id % 4 <> 0)", chunks_cte("cut_pages", "stored_pages"),
    records_cte("chunks_pages", "cut_pages", "stored_pages"), docs_cte("was_pages", "chunks_pages"),
    """sides AS (
  SELECT path, f.path IS NOT NULL AS here, w.source_name, w.chunks
  FROM (SELECT path FROM corpus_now UNION ALL SELECT path FROM numbered WHERE page_id % 3 <> 0) f
  FULL JOIN (SELECT source AS path, source_name, chunks FROM was_docs UNION ALL SELECT source, source_name, chunks FROM was_pages) w USING (path))""",
    """listing AS (
  SELECT path, split_part(path, '/', -1) AS name, CASE WHEN contains(path, '/data/web/') THEN 'web' ELSE 'local' END AS source_type,
    CASE WHEN here AND chunks IS NOT NULL THEN 'imported' WHEN here THEN 'local' ELSE 'orphan' END AS status, coalesce(chunks, 0) AS chunks FROM sides)"""]
ORACLE["document_catalog_web"] = with_(*_WITH_WEB) + """
SELECT scope, path, name, source_type, status, chunks FROM listing, (VALUES ('all'), ('docs'), ('web')) s(scope)
WHERE scope = 'all' OR (scope = 'web') = (source_type = 'web')"""
ORACLE["status_counts_web"] = with_(*_WITH_WEB) + """
SELECT source_type, count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'local') AS local,
  count(*) FILTER (status = 'orphan') AS orphan FROM listing GROUP BY source_type"""
ORACLE["orphans"] = with_(*DIFF) + """
SELECT source, source_name, chunks FROM was WHERE source NOT IN (SELECT source FROM cur)"""

# --- collection aggregates -----------------------------------------------------------------------------

ORACLE["chunk_count"] = with_(*CHUNKS) + "SELECT count(*) AS chunks FROM chunks"
ORACLE["exists_batch"] = with_(*CHUNKS_BEFORE, WEB_PATHS) + """
SELECT path AS source, path IN (SELECT source FROM chunks_before) AS stored
FROM (SELECT path FROM files UNION ALL SELECT path FROM web_paths)"""
ORACLE["source_hash"] = with_(*CHUNKS) + """
SELECT source, arg_min(content_hash, chunk_index) AS content_hash FROM chunks GROUP BY source"""
ORACLE["list_sources"] = with_(*CHUNKS) + "SELECT DISTINCT source FROM chunks"
ORACLE["list_documents"] = with_(*STORED) + """
SELECT source, source_name, source_type, content_hash, created_at, chunks FROM stored"""
ORACLE["corpus_stats"] = with_(*STORED) + """
SELECT (SELECT count(*) FROM files) AS docs_count, (SELECT count(*) FROM pages) AS web_count,
  count(*) AS vector_docs, sum(chunks)::BIGINT AS chunks FROM stored"""
ORACLE["collection_stats"] = with_(*STORED) + """
SELECT 'default_collection' AS collection, count(*) AS documents, sum(chunks)::BIGINT AS chunks FROM stored"""
ORACLE["delete_totals"] = with_(*STORED) + "SELECT count(*) AS documents, sum(chunks)::BIGINT AS chunks FROM stored"
ORACLE["embed_metrics"] = with_(*CHUNKS) + """
SELECT source, (chunk_index // 50)::INTEGER AS call, count(*) AS texts, sum(length(text))::BIGINT AS chars,
  CASE WHEN regexp_extract(source, '(\\d+)\\.txt$', 1)::BIGINT % 2 = 1 THEN 32 ELSE 64 END::INTEGER AS dim FROM chunks GROUP BY ALL"""

# --- vectors and search ------------------------------------------------------------------------------------


def sparse_cte(name: str, rows: str, key: str, dim: int = 64) -> str:
    """``name(key, b, v)``: the non-zero places of the hashed bag of words, unit length, as floats."""
    return f"""{name}_n AS (
  SELECT {key}, b, count(*) AS n FROM (
    SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} AS b FROM (
      SELECT {key}, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {rows}) WHERE w <> '')
  GROUP BY {key}, b),
{name} AS (
  SELECT {key}, b, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS v FROM {name}_n)"""


def _dense(key: str, sparse: str, rows: str, dim: int) -> str:
    return f"""SELECT {key}, array_to_string(list((round(coalesce(v, 0) * 1e6))::BIGINT ORDER BY b), ',') AS vector
FROM (SELECT {key}, b FROM {rows}, range({dim}) t(b)) LEFT JOIN {sparse} USING ({key}, b) GROUP BY {key}"""


ORACLE["embed_hash"] = with_(*CHUNKS, sparse_cte("cv", "chunks", "id")) + _dense("id", "cv", "chunks", 64)
ORACLE["reembed"] = with_(*CHUNKS, sparse_cte("cv", "chunks", "id", 32)) + _dense("id", "cv", "chunks", 32)
ORACLE["dim_check"] = """
SELECT min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim, count(*) AS vectors,
  min(len(embedding)) = max(len(embedding)) AS single_dim FROM embeddings"""

_CENTRES = """flat AS (
  SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
centres AS (SELECT label AS query_id, pos, avg(v) AS m FROM flat GROUP BY label, pos)"""


def _knn(space: str, where: str = "TRUE") -> str:
    d = {
        "cosine": "1 - sum(m * v) / (sqrt(sum(m * m)) * sqrt(sum(v * v)))",
        "l2": "sum((m - v) * (m - v))",
        "ip": "1 - sum(m * v)",
    }[space]
    return with_(_CENTRES, f"""pairs AS (
  SELECT query_id, vec_id, round({d}, 6) AS distance FROM flat JOIN centres USING (pos) WHERE {where}
  GROUP BY query_id, vec_id)""") + """
SELECT query_id, rank::INTEGER AS rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= 10"""


ORACLE["knn_cosine"] = ORACLE["knn_ivf_all_cells"] = _knn("cosine")
ORACLE["knn_l2"] = _knn("l2")
ORACLE["knn_ip"] = _knn("ip")
ORACLE["knn_filtered"] = _knn("cosine", "label = 3")

_TOP_NEAR = """
SELECT query_id, rank::INTEGER AS rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= 10"""
_COSINES = """cosines AS (
  SELECT query_id, vec_id, round(1 - sum(m * v) / (sqrt(sum(m * m)) * sqrt(sum(v * v))), 6) AS distance
  FROM flat JOIN centres USING (pos) GROUP BY query_id, vec_id)"""
ORACLE["knn_ivf_given"] = ORACLE["knn_ivf_join"] = with_(_CENTRES, _COSINES, """cells AS (
  SELECT query_id AS cell, pos, m AS c, sum(m * m) OVER (PARTITION BY query_id) / 2 AS half FROM centres),
homes AS (
  SELECT vec_id, arg_min(cell, d) AS cell FROM (
    SELECT vec_id, cell, any_value(half) - sum(v * c) / sqrt(sum(v * v)) AS d FROM flat JOIN cells USING (pos) GROUP BY vec_id, cell) GROUP BY vec_id),
probes AS (
  SELECT query_id, cell FROM (
    SELECT query_id, cell, any_value(half) - sum(m * c) / sqrt(sum(m * m)) AS d FROM centres JOIN cells USING (pos) GROUP BY query_id, cell)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, cell) <= 3),
pairs AS (SELECT * FROM cosines SEMI JOIN (SELECT query_id, vec_id FROM probes JOIN homes USING (cell)) USING (query_id, vec_id))""") + _TOP_NEAR


def _projected(name: str, rows: str, key: str, value: str) -> str:
    return f"""{name} AS (
  SELECT {key}, t, b, sum(sign * (round({value} * 1e6))::BIGINT) AS p FROM {rows} JOIN planes USING (pos) GROUP BY {key}, t, b),
{name}_own AS (SELECT {key}, t, sum(CASE WHEN p >= 0 THEN 1 << b::INTEGER ELSE 0 END)::BIGINT AS bucket FROM {name} GROUP BY {key}, t)"""


ORACLE["knn_lsh"] = with_(_CENTRES, _COSINES, """planes AS (
  SELECT t, b, pos, 1 - 2 * (('0x' || substr(md5(t || ':' || b || ':' || pos), 1, 8))::BIGINT % 2) AS sign
  FROM range(20) x(t), range(6) y(b), range(64) z(pos))""",
    _projected("rows", "flat", "vec_id", "v"), _projected("asks", "centres", "query_id", "m"), """near_bits AS (
  SELECT query_id, t, b FROM asks QUALIFY row_number() OVER (PARTITION BY query_id, t ORDER BY abs(p), b) <= 3),
probes AS (
  SELECT query_id, t, bucket FROM asks_own
  UNION ALL SELECT query_id, t, xor(bucket, (1 << b::INTEGER)::BIGINT) FROM asks_own JOIN near_bits USING (query_id, t)),
pairs AS (SELECT * FROM cosines SEMI JOIN (SELECT query_id, vec_id FROM probes JOIN rows_own USING (t, bucket)) USING (query_id, vec_id))""") + _TOP_NEAR

_ASKED = "asked AS (SELECT item_id AS query_id, text FROM benchmark)"


def _search_ctes(k: int, fetch: int | None = None, where: str = "true") -> list[str]:
    """CTEs that end in ``hits``; with ``fetch`` the candidates are scored and re-ranked."""
    depth = fetch or k
    ctes = [*CHUNKS, _ASKED, sparse_cte("cv", f"(SELECT * FROM chunks WHERE {where})", "id"), sparse_cte("qv", "asked", "query_id"),
            """dots AS (SELECT query_id, id, sum(qv.v * cv.v) AS dot FROM qv JOIN cv USING (b) GROUP BY query_id, id),
dists AS (
  SELECT query_id, id, round(1 - dot / (sqrt(qn) * sqrt(cn)), 6) AS distance FROM dots
  JOIN (SELECT query_id, sum(v * v) AS qn FROM qv GROUP BY query_id) USING (query_id)
  JOIN (SELECT id, sum(v * v) AS cn FROM cv GROUP BY id) USING (id))""",
            f"""near AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dists)
  WHERE rank <= {depth})""",
            f"""found AS (
  SELECT query_id, rank, id, {strip('c.text')} AS text, source, split_part(source, '/', -1) AS filename, chunk_index,
    distance, greatest(0.0::DOUBLE, 1 - distance) AS similarity FROM near JOIN chunks c USING (id))"""]
    if not fetch:
        return [*ctes, "hits AS (SELECT *, NULL::DOUBLE AS rerank_score FROM found)"]
    toks = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"
    return [*ctes, f"""token_sets AS (
  SELECT f.*, {toks.format('a.text')} AS qt, {toks.format('f.text')} AS dt FROM found f JOIN asked a USING (query_id)),
scored AS (
  SELECT *, round(len(list_intersect(qt, dt)) / sqrt(len(qt) * len(dt)), 6) AS rerank_score FROM token_sets),
reranked AS (
  SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rank) FROM scored),
hits AS (SELECT * FROM reranked WHERE rank <= {k})"""]


_HIT = """
SELECT query_id, rank::INTEGER AS rank, id, text, source, filename, chunk_index, distance, similarity, rerank_score
FROM hits"""
ORACLE["search_vector"] = with_(*_search_ctes(5)) + _HIT
ORACLE["search_source_contains"] = with_(*_search_ctes(5, where="contains(lower(source), 'src3')")) + _HIT
ORACLE["search_rerank"] = ORACLE["search_stored"] = with_(*_search_ctes(5, 15)) + _HIT
ORACLE["rerank_topn"] = with_(*_search_ctes(3, 8)) + "SELECT query_id, rank::INTEGER AS rank, id, rerank_score FROM hits"
ORACLE["search_totals"] = with_(*_search_ctes(5)) + """
SELECT query_id, count(id) AS total FROM asked LEFT JOIN hits USING (query_id) GROUP BY query_id"""
ORACLE["similarity_band"] = with_(*_search_ctes(5)) + """
SELECT query_id, rank::INTEGER AS rank, id, CASE WHEN similarity * 100 >= 80 THEN 'success'
  WHEN similarity * 100 >= 60 THEN 'warning' ELSE 'info' END AS band FROM hits"""


def _two_places(x: str, scale: int) -> str:
    """Rounded to 2 places, from an integer count of millionths."""
    n = f"(((round({x} * 1e6))::BIGINT * {scale} + 5000) // 10000)"
    return f"({n} // 100) || '.' || lpad(({n} % 100)::VARCHAR, 2, '0')"


def _answers(head: str, *ctes: str) -> str:
    return with_(*ctes) + f"""
SELECT query_id, '找到 ' || count(*) || ' 条相关文档' || {head} || repeat(chr(10), 3) || string_agg(
  '[' || rank || '] 来源: ' || filename || ' | 相似度: ' || {_two_places('similarity', 100)} || '%' || chr(10) || text,
  repeat(chr(10), 2) ORDER BY rank) AS answer FROM hits GROUP BY query_id"""


ORACLE["answer_block"] = _answers("''", *_search_ctes(5))
ORACLE["answer_block_reranked"] = _answers(
    f"'（已重排）| 分数: ' || string_agg({_two_places('rerank_score', 1)}, ', ' ORDER BY rank)", *_search_ctes(5, 15))
ORACLE["retrieval_eval"] = with_(*_search_ctes(15), """truth AS (
  SELECT query_id, path AS source FROM corpus JOIN asked ON contains(corpus.text, asked.text)),
firsts AS (
  SELECT query_id, min(rank) AS first FROM (SELECT DISTINCT query_id FROM truth)
  LEFT JOIN (SELECT query_id, rank FROM hits JOIN truth USING (query_id, source)) USING (query_id) GROUP BY query_id)""") + """
SELECT count(*) AS queries, round(avg((first IS NOT NULL)::INTEGER), 6) AS hit_rate,
  round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM firsts"""



def _terms_of(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


_POSTINGS = [f"""counted AS (SELECT id, source, chunk_index, {_terms_of('text')} AS words FROM chunks)""",
             "stats AS (SELECT count(*) AS total, avg(len(words)) AS mean FROM counted)",
             """postings AS (
  SELECT id, term, count(*) AS n, any_value(size) AS size FROM (SELECT id, unnest(words) AS term, len(words) AS size FROM counted) GROUP BY id, term)""",
             "terms AS (SELECT term, ln(1 + (total - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, stats GROUP BY term, total)"]


def _bm25(name: str, terms: str, k: int) -> str:
    """``name`` with the k best chunks for weighted query terms."""
    return f"""{name}_scores AS (
  SELECT query_id, id, round(sum(weight * idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
  FROM {terms} JOIN terms USING (term) JOIN postings USING (term), stats GROUP BY query_id, id),
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_scores QUALIFY rank <= {k})"""


_OWN = f"own AS (SELECT query_id, unnest(list_distinct({_terms_of('text')})) AS term, 1.0::DOUBLE AS weight FROM asked)"
_FEEDBACK = [_bm25("first", "own", 5), """seen AS (
  SELECT query_id, term, round(sum(n * idf / size), 6) AS value FROM first JOIN postings USING (id) JOIN terms USING (term)
  WHERE (query_id, term) NOT IN (SELECT query_id, term FROM own) GROUP BY query_id, term),
rewritten AS (
  SELECT query_id, term, weight FROM own UNION ALL SELECT query_id, term, 0.3::DOUBLE FROM seen
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY value DESC, term) <= 10)"""]


def _fused(name: str, k: int, weight: float = 1.0, constant: int = 60) -> str:
    return f"""{name}_scores AS (
  SELECT query_id, id, n.rank AS vector_rank, w.rank AS word_rank,
    round(coalesce(1.0::DOUBLE / ({constant} + n.rank), 0) + coalesce({weight}::DOUBLE / ({constant} + w.rank), 0), 6) AS score
  FROM near n FULL JOIN words w USING (query_id, id)),
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_scores QUALIFY rank <= {k})"""


_LEXICAL = [*_search_ctes(15), *_POSTINGS, _OWN]
ORACLE["search_bm25"] = with_(*_LEXICAL, _bm25("words", "own", 5)) + """
SELECT query_id, rank::INTEGER AS rank, id, score, source, chunk_index FROM words JOIN chunks USING (id)"""
ORACLE["search_hybrid"] = with_(*_LEXICAL, _bm25("words", "own", 15), _fused("fused", 5)) + """
SELECT query_id, rank::INTEGER AS rank, id, source, chunk_index, score, vector_rank::INTEGER AS vector_rank, word_rank::INTEGER AS word_rank
FROM fused JOIN chunks USING (id)"""
ORACLE["search_feedback"] = with_(*_LEXICAL, *_FEEDBACK, _bm25("words", "rewritten", 5)) + """
SELECT query_id, rank::INTEGER AS rank, id, score, source, chunk_index FROM words JOIN chunks USING (id)"""
ORACLE["retrieval_eval_hybrid"] = with_(*_LEXICAL, *_FEEDBACK, _bm25("words", "own", 15), _bm25("more", "rewritten", 15), _fused("fused", 15), _fused("by_words", 15, 4.0, 1), """
truth AS (SELECT query_id, path AS source FROM corpus JOIN asked ON contains(corpus.text, asked.text)),
lists AS (
  SELECT 'vector' AS method, query_id, rank, id FROM near UNION ALL SELECT 'bm25', query_id, rank, id FROM words
  UNION ALL SELECT 'hybrid', query_id, rank, id FROM fused UNION ALL SELECT 'hybrid_words', query_id, rank, id FROM by_words UNION ALL SELECT 'feedback', query_id, rank, id FROM more),
firsts AS (
  SELECT method, query_id, min(rank) AS first FROM lists JOIN chunks USING (id) JOIN truth USING (query_id, source) GROUP BY method, query_id)""") + """
SELECT method, count(*) AS queries, round(avg((first IS NOT NULL)::INTEGER), 6) AS hit_rate,
  round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr
FROM (SELECT DISTINCT query_id FROM truth) CROSS JOIN (VALUES ('vector'), ('bm25'), ('hybrid'), ('hybrid_words'), ('feedback')) m(method)
LEFT JOIN firsts USING (method, query_id) GROUP BY method"""

# --- collection lifecycle --------------------------------------------------------------------------------------

ORACLE["upsert_documents"] = with_(
    *CHUNKS_BEFORE, NOW, PAGES,
    "fresh_docs AS (SELECT path, text FROM corpus_now UNION ALL SELECT path, text FROM web_corpus)",
    chunks_cte("cut_fresh", "fresh_docs"), records_cte("chunks_fresh", "cut_fresh", "fresh_docs")) + f"""
SELECT {CHUNK_COLS} FROM chunks_before WHERE source NOT IN (SELECT path FROM fresh_docs)
UNION ALL SELECT {CHUNK_COLS} FROM chunks_fresh"""
ORACLE["delete_sources"] = with_(*CHUNKS, LABELLED, TOXIC) + """
SELECT id, source, content_hash FROM chunks WHERE source NOT IN (SELECT source FROM toxic)"""
ORACLE["sync_result"] = ORACLE["sync_applied"] = with_(*_SYNCED) + f"SELECT {CHUNK_COLS} FROM chunks_now"
ORACLE["sync_listed"] = with_(*DIFF, """listed AS (SELECT path AS source FROM labelled WHERE toxic IS DISTINCT FROM 1 OR doc_id % 2 = 0)""") + """
SELECT source, CASE WHEN was.content_hash IS NULL THEN 'add' WHEN cur.current_hash IS NOT NULL AND cur.current_hash <> was.content_hash THEN 'update'
    WHEN cur.current_hash IS NOT NULL OR source IN (SELECT source FROM listed) THEN 'unchanged' ELSE 'delete' END AS action
FROM cur FULL JOIN was USING (source)"""
ORACLE["import_stored"] = with_(*_IMPORT, LABELLED) + """
SELECT file, status, s.chunks, message, coalesce(s.chunks, 0) AS stored FROM status s"""
ORACLE["delete_scope"] = with_(FILES, corpus_cte(), PAGES, "both_docs AS (SELECT path, text FROM corpus UNION ALL SELECT path, text FROM web_corpus)",
    chunks_cte("cut_both", "both_docs"), """totals AS (
  SELECT path, contains(path, '/data/web/') AS web, count(*) AS n FROM cut_both GROUP BY path)""") + """
SELECT scope, count(*) FILTER (taken) AS documents, coalesce(sum(n) FILTER (taken), 0)::BIGINT AS chunks,
  count(*) FILTER (NOT taken) AS left_documents, coalesce(sum(n) FILTER (NOT taken), 0)::BIGINT AS left_chunks
FROM (SELECT scope, n, scope = 'all' OR web = (scope = 'web') AS taken FROM totals, (VALUES ('docs'), ('web'), ('all')) s(scope)) GROUP BY scope"""
ORACLE["rebuild_result"] = ORACLE["stream_ingest"] = ORACLE["chunk_records"]
ORACLE["snapshot_checks"] = with_(*CHUNKS) + """
SELECT count(*) AS chunks, count(*) = count(DISTINCT id) AS unique_ids, TRUE AS single_dim,
  count(*) FILTER (id IS NULL) AS null_vectors, count(*) = count(DISTINCT id) AS valid FROM chunks"""
ORACLE["snapshot_checks_mixed"] = """
WITH kinds AS (
  SELECT 'good' AS kind, vec_id AS id, embedding FROM embeddings
  UNION ALL SELECT 'repeated', vec_id // 2, embedding FROM embeddings
  UNION ALL SELECT 'uneven', vec_id, CASE WHEN vec_id % 7 = 0 THEN embedding[1:48] ELSE embedding END FROM embeddings
  UNION ALL SELECT 'missing', vec_id, CASE WHEN vec_id % 11 <> 0 THEN embedding END FROM embeddings),
checks AS (
  SELECT kind, count(*) AS chunks, count(*) = count(DISTINCT id) AS unique_ids, min(len(embedding)) = max(len(embedding)) AS single_dim,
    count(*) FILTER (embedding IS NULL) AS null_vectors FROM kinds GROUP BY kind)
SELECT *, unique_ids AND single_dim AND null_vectors = 0 AS valid FROM checks"""
ORACLE["clean_orphans"] = with_(*DIFF) + """
SELECT id, source, content_hash FROM chunks_before WHERE source IN (SELECT source FROM cur)"""

# --- streams ------------------------------------------------------------------------------------------------------

ORACLE["stream_progress"] = """
SELECT event_type AS op, count(*) AS messages, max(k) + 1 AS idx, 100::INTEGER AS total, (max(k) + 1) * 100 / 100 AS percent
FROM (SELECT event_type, (props->>'k')::INTEGER AS k FROM events) GROUP BY event_type"""
_STAMP_SQL = "strftime({}, '%Y-%m-%d %H:%M:%S')"
ORACLE["stream_tumbling"] = f"""
SELECT {_STAMP_SQL.format('w')} AS start, {_STAMP_SQL.format("w + INTERVAL 1 DAY")} AS "end", event_type, count(*) AS n,
  round(sum(value), 4) AS total
FROM (SELECT *, date_trunc('day', ts) AS w FROM events)
WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY w, event_type"""
# What comes late is dropped if it lies behind the watermark of what came before.
_ARRIVED = """arrived AS (
  SELECT * FROM events, (SELECT max(ts) FILTER (event_id % 50 <> 0) - INTERVAL 1 HOUR AS late_mark, max(ts) - INTERVAL 1 HOUR AS mark FROM events)
  WHERE event_id % 50 <> 0 OR ts >= late_mark)"""
ORACLE["stream_tumbling_late"] = with_(_ARRIVED) + f"""
SELECT {_STAMP_SQL.format('w')} AS start, {_STAMP_SQL.format("w + INTERVAL 1 DAY")} AS "end", event_type, count(*) AS n,
  round(sum(value), 4) AS total
FROM (SELECT *, date_trunc('day', ts) AS w FROM arrived) WHERE w + INTERVAL 1 DAY <= mark GROUP BY w, event_type"""
ORACLE["stream_expired"] = with_(_ARRIVED, """asked AS (
  SELECT *, ts + to_hours((props->>'k')::INTEGER + 1) AS due FROM arrived WHERE event_type = 'view')""") + """
SELECT user_id::VARCHAR AS channel, event_id, strftime(due, '%Y-%m-%d %H:%M:%S.%f') AS due FROM asked a
WHERE due < mark AND NOT EXISTS (
  SELECT 1 FROM arrived b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.ts BETWEEN a.ts AND a.due)"""
ORACLE["stream_health_state"] = """
WITH counted AS (
  SELECT user_id, event_id, sum((event_type = 'error')::INTEGER) OVER (own ROWS 9 PRECEDING) AS failures,
    sum((event_type = 'error')::INTEGER) OVER (own ROWS 4 PRECEDING) AS recent, count(*) OVER (own ROWS 4 PRECEDING) AS seen
  FROM events WINDOW own AS (PARTITION BY user_id ORDER BY event_id)),
told AS (SELECT *, CASE WHEN seen = 5 AND recent = 0 THEN 'online' WHEN failures >= 3 THEN 'degraded' END AS flag FROM counted),
states AS (
  SELECT *, coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 'online') AS state FROM told)
SELECT user_id, event_id, state, failures::INTEGER AS failures FROM states
QUALIFY state <> lag(state, 1, 'online') OVER (PARTITION BY user_id ORDER BY event_id)"""
ORACLE["stream_health"] = f"""
WITH bounds AS (SELECT date_trunc('day', min(ts)) AS lo, max(ts) AS hi FROM events),
windows AS (SELECT unnest(generate_series(lo - INTERVAL 12 HOUR, hi, INTERVAL 12 HOUR)) AS w FROM bounds),
counted AS (
  SELECT w, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, quantile_disc(value, 0.99) AS p99
  FROM windows JOIN events ON ts >= w AND ts < w + INTERVAL 1 DAY GROUP BY w)
SELECT {_STAMP_SQL.format('w')} AS start, {_STAMP_SQL.format("w + INTERVAL 1 DAY")} AS "end", n, errors, p99,
  CASE WHEN errors * 10 >= n * 3 OR p99 > 30 THEN 'degraded' ELSE 'online' END AS state
FROM counted, bounds WHERE w + INTERVAL 1 DAY <= hi - INTERVAL 1 HOUR"""
ORACLE["health_quantiles"] = f"""
WITH closed AS (
  SELECT event_type, {_STAMP_SQL.format("date_trunc('day', ts)")} AS start FROM events
  WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
counts AS (
  SELECT 'type' AS level, event_type AS key, count(*) AS n FROM closed GROUP BY ALL
  UNION ALL SELECT 'day', start, count(*) FROM closed GROUP BY ALL)
SELECT level, key, p, n, TRUE AS inside FROM counts, {_SHARES} WHERE p > 0.1"""
ORACLE["stream_dedup"] = "SELECT event_id, event_type, value FROM events"
ORACLE["stream_last_n"] = ORACLE["last_n_events"] = """
SELECT event_type, event_id, age::INTEGER AS age FROM (
  SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS age,
    count(*) OVER (PARTITION BY event_type) AS n FROM events)
WHERE age <= CASE WHEN n <= 100 THEN n ELSE 50 + (n - 101) % 51 END"""

# --- file table ---------------------------------------------------------------------------------------------------

ORACLE["dedup_by_hash"] = with_(FILES) + """
SELECT file_hash, path, n_chars, copies FROM (
  SELECT md5(text) AS file_hash, path, n_chars, count(*) OVER (PARTITION BY text) AS copies,
    row_number() OVER (PARTITION BY text ORDER BY path) AS rn FROM files) WHERE rn = 1"""
ORACLE["cascade_delete"] = with_(*CHUNKS, LABELLED, TOXIC) + """
SELECT id, source, text FROM chunks WHERE source NOT IN (SELECT source FROM toxic)"""
ORACLE["cascade_delete_files"] = with_(*CHUNKS, LABELLED, TOXIC, """counted AS (SELECT source, count(*) AS n FROM chunks GROUP BY source),
gone AS (SELECT source FROM toxic UNION SELECT source FROM counted WHERE n = 1),
left_files AS (SELECT path, substr(md5(path), 1, 12) AS file_id FROM files WHERE path NOT IN (SELECT source FROM gone))""") + """
SELECT 'file' AS kind, file_id AS id, file_id FROM left_files
UNION ALL SELECT 'chunk', id, file_id FROM chunks JOIN left_files ON path = source"""
ORACLE["files_newest"] = """
SELECT event_id AS file_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM events
ORDER BY ts DESC, event_id DESC LIMIT 20"""
ORACLE["files_rollup"] = with_(*CHUNKS, IMPORT_FILES) + """
SELECT path, count(id) AS chunk_count, coalesce(sum(length(c.text)), 0)::BIGINT AS chars,
  CASE WHEN count(id) > 0 THEN 'done' ELSE 'pending' END AS status
FROM disk LEFT JOIN chunks c ON c.source = path GROUP BY path"""
