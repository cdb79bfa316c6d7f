"""SQL for DuckDB, written apart from the operators."""


def _secrets() -> str:
    kinds = [
        (
            "assign",
            0,
            r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
            2,
            6,
        ),
        ("access", 1, "AKIA[A-Z0-9]+", 0, 20),
        ("hex", 2, "[0-9a-f]+", 0, 24),
        ("pem", 3, "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0),
        ("forge", 4, "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
        ("jwt", 5, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
    ]
    parts = [
        f"""select doc_id, '{kind}' as kind, {rank} as rank, {least} as least,
          unnest(range(1, len(m) + 1)) as i, unnest(g[:len(m)]) as gap, unnest(m) as hit, unnest(p) as part
        from (select doc_id, string_split_regex(body, '{pattern}') as g,
          regexp_extract_all(body, '{pattern}', 0) as m, regexp_extract_all(body, '{pattern}', {group}) as p
          from d)"""
        for kind, rank, pattern, group, least in kinds
    ]
    return f"""
    with d as (select doc_id, coalesce(text, '') as body from documents),
    hits as ({" union all ".join(parts)}),
    ends as (select *, sum(length(gap) + length(hit)) over (partition by doc_id, kind order by i) as stop from hits),
    spans as (select doc_id, kind, rank, stop - length(hit) as start,
      kind || ':' || cast(stop - length(hit) as bigint) || ':' || cast(stop as bigint) as span
      from ends where length(part) >= least),
    listed as (select doc_id,
      count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access,
      count(*) filter (rank = 2) as n_hex,
      string_agg(span, ',' order by start, rank) filter (rank < 3) as base,
      string_agg(span, ',' order by start, rank) as spans from spans group by doc_id)
    select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access,
      coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from d left join listed on d.doc_id = listed.doc_id
    """


DEDUP = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
  from documents),
ranked as (
  select doc_id, text_sha256, count(*) over (partition by text_sha256) as group_size,
    first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id) as keep_id
  from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from ranked
"""

RULES = r"""
with d as (select doc_id, coalesce(text, '') as body from documents),
w as (select doc_id, unnest(range(1, len(t) + 1)) as pos, unnest(t) as word from
  (select doc_id, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as t from d)),
per_word as (select doc_id, count(*) as n_words, sum(length(word)) as word_chars,
  sum(case when regexp_matches(word, '\p{L}') then 1 else 0 end) as lettered,
  sum(case when lower(word) in ('the','be','to','of','and','that','have','with','is','in','it','for','on',
    'was','a','an','are','by','this','at','der','die','das','und','ist','zu','den','von','mit','im','sich',
    'auf','ein','eine','le','la','les','de','et','un','une','est','que','en','du','des','qui','pour','dans',
    'au','el','los','las','y','es','una','por','con','para','se','del') then 1 else 0 end) as stops
  from w group by doc_id),
tri as (select doc_id, pos, word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o as t
  from w window o as (partition by doc_id order by pos)),
again as (select doc_id, pos from
  (select doc_id, pos, count(*) over (partition by doc_id, t) as n from tri where t is not null) where n > 1),
repeats as (select doc_id, count(distinct pos + k) as n_repeat_words
  from again, (values (0), (1), (2)) as o(k) group by doc_id),
lines as (select doc_id, unnest(string_split(body, chr(10))) as line from d),
per_line as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines,
  sum(case when regexp_matches(line, '^\s*[-*•‣–]\s') then 1 else 0 end) as bullets,
  sum(case when regexp_matches(line, '(\.\.\.|…)\s*$') then 1 else 0 end) as dots
  from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (select d.doc_id, coalesce(n_words, 0) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
  length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  coalesce(stops, 0) as stops, coalesce(lettered, 0) as lettered, coalesce(n_lines, 0) as n_lines,
  coalesce(bullets, 0) as bullets, coalesce(dots, 0) as dots
  from d left join per_word using (doc_id) left join per_line using (doc_id) left join repeats using (doc_id)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars >= 2 * n_words and word_chars <= 20 * n_words
  and n_symbols <= 0.25 * word_chars and stops >= 2 and n_dup_lines <= 0.5 * n_lines
  and lettered >= 0.6 * n_words and bullets <= 0.9 * n_lines and dots <= 0.5 * n_lines as kept
from v
"""

TOP_K = """
with parts as (select vec_id, len(embedding) as dims, unnest(embedding) as x, unnest(range(len(embedding))) as i
  from embeddings where embedding is not null and not list_contains(list_transform(embedding,
    lambda x: x is null or isnan(x) or isinf(x)), true)),
whole as (select vec_id, dims, i, cast(floor(1024 * cast(x as double)) as bigint) as x from parts),
scored as (select q.vec_id as query_id, c.vec_id as vec_id, cast(sum(q.x * c.x) as bigint) as score
  from whole q join whole c on q.i = c.i and q.dims = c.dims and q.vec_id <> c.vec_id
  where q.vec_id % 100 = 0 group by q.vec_id, c.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from scored)
select query_id, cast(place as integer) as rank, vec_id, score from ranked where place <= 10
"""

RANKED = r"""
with d as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
tf as (select doc_id, term, count(*) as tf from d group by all),
n as (select doc_id, count(*) as n from d group by all),
whole as (select count(*) as docs, cast(sum(n) as bigint) as len from n),
i as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
q as (select item_id, term, count(*) as times from i group by all),
w as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w
  from tf, whole where term in (select term from q) group by term, docs),
m as (select doc_id, 75 + (25 * n * docs) // len as m from n, whole),
scored as (select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
  from q join w using (term) join tf using (term) join m using (doc_id) group by item_id, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place
  from scored where score > 0)
select item_id, cast(place as integer) as rank, doc_id, score from ranked where place <= 20
"""

ORACLES = {
    "op3_secrets": _secrets(),
    "op4_exact_dedup": DEDUP,
    "op7_quality_rules": RULES,
    "op12_top_k": TOP_K,
    "op13_ranked_search": RANKED,
}
