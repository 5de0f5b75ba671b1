"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from sparkloom.llm.quality_rules import BEGINNINGS, INSULT_SHARE, INSULTS, LEAST_DOCUMENTS, LEAST_HITS, LIFT, MORE_DOCUMENTS, MOST_DENSE, TOXIC_SHARE

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONTROLS = r"(<\||\[/?INST\]|</?s>|<</?SYS>>)"

WARC = f"""
with d as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x from pages),
m as (select h, min(page_id) as first_id from d group by h)
select page_id, strlen(d.h) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}', cast(((('0x' || substr(x, cast(5 * (i // 4) + 1 as bigint), 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1 as bigint), 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to, true as sound
from d join m on m.h = d.h
"""

CHAT = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
r as (select *, coalesce(lag(role) over (partition by conv_id order by turn, role, text) = role, false) as goes_on,
  length(replace(text, '\\', '\\\\')) + len(regexp_extract_all(text, '{_CONTROLS}')) as body from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(case when goes_on then 8 + body else 23 + length(role) + body end) as bigint) as formatted_chars
from r group by conv_id
"""

_LOW = "trim(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?\"''()[]')"
_LENGTHS = ", ".join(f"({k})" for k in BEGINNINGS)
_INSULTS = ", ".join(f"'{w.decode()}'" for w in sorted(INSULTS))

QUALITY = rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
win as (select doc_id, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
g as (select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as n from win),
rep as (select doc_id, count(distinct i + k) as n_repeat_words from g, (values (0), (1), (2)) o(k) where n >= 2 group by doc_id),
b as (select w.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
  cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
  len(list_filter(words, lambda x: ends_with(x, '!!'))) as shouts, len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) as lettered,
  len(list_filter(words, lambda x: trim(lower(x), '.,;:!?"''()[]') in ({_INSULTS}))) as insults from w left join rep using (doc_id)),
known as (select doc_id, max(toxic) as toxic from labels where doc_id is not null and toxic is not null group by doc_id),
lab as (select row_number() over () as d, toxic <> 0 as bad, n_words, words from b join known using (doc_id) join w using (doc_id) where n_words > 0),
tot as (select count(*) filter (bad) as n1, count(*) filter (not bad) as n0 from lab),
pre as (select d, bad, n_words, x[:k] as p, count(*) as n from (select d, bad, n_words, {_LOW.format("unnest(words)")} as x from lab), (values {_LENGTHS}) o(k) where length(x) >= k group by d, bad, n_words, x[:k]),
den as (select p, bad, least({MOST_DENSE}, n * 1000000 // n_words) as dense from pre),
lex as (select p from (select p, count(*) filter (bad) as h1, count(*) filter (not bad) as h0, coalesce(sum(dense) filter (bad), 0) as d1, coalesce(sum(dense) filter (not bad), 0) as d0 from den group by p), tot
  where h1 >= {LEAST_DOCUMENTS} and d1 * n0 >= d0 * n1 * {LIFT} and h1 * n0 >= h0 * n1 * {MORE_DOCUMENTS}),
hit as (select x.i as d, count(*) as hits from (select doc_id as i, unnest(words) as v from w) x where exists (select 1 from lex where starts_with({_LOW.format("x.v")}, p)) group by x.i),
f as (select *, coalesce(hits, 0) as toxic_hits, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b left join hit on hit.d = b.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > word_chars or word_chars < 2 * n_words or word_chars > 20 * n_words or 10 * n_dup_lines > 5 * n_lines or 100 * n_repeat_words > 45 * n_words or 10 * shouts > n_words or 2 * lettered < n_words
  or (insults > 0 and {INSULT_SHARE} * insults >= n_words) or (toxic_hits >= {LEAST_HITS} and {TOXIC_SHARE} * toxic_hits >= n_words)) as kept
from f
"""

ORACLES = {"op4_warc_chain": WARC, "op8_chat_format": CHAT, "op9_quality_rules": QUALITY}
