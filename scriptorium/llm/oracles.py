"""DuckDB SQL of the queries that SQL can express: the same results by other ways, over whole tables."""

from __future__ import annotations

from scriptorium.llm.conversation_repair import COSTS, TRUNCATED_STAYS
from scriptorium.llm.line_cleaning import CELL, MARK_RUN, SENTENCE_END, SENTENCE_INSIDE, STOCK_PHRASES, Rules

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
SPLIT = "unnest(string_split({0}, chr(10))) as line, generate_subscripts(string_split({0}, chr(10)), 1) as i"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: One row with ``tbl``, the table of crc32; a string is summed up byte by byte.
CRC_TABLE = "crc as (select list(list_reduce(list_prepend(n, range(8)), lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) as tbl from range(256) t(n))"
LATIN_BYTES = "flatten(list_transform(string_split({}, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end))"


def crc32(text: str) -> str:
    """Of text in Latin-1 letters and ASCII; ``tbl`` is in scope."""
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {LATIN_BYTES.format(text)}), lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295::bigint)"


NEAR_DUPLICATES = rf"""with recursive w as (select doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
 s as (select distinct doc_id, shingle from (select doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle from w)),
 n as (select w.doc_id, count(shingle) as n from w left join s on s.doc_id = w.doc_id group by 1),
 p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
 e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
 r as (select doc_id as a, doc_id as b from n union select r.a, e.b from r join e on e.a = r.b)
 select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from n join (select a, min(b) as component_id from r group by 1) on a = doc_id"""

SPELLING = rf"""with recursive {CRC_TABLE}, run as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents),
 one as (select doc_id, run, count(*) as k from run where length(run) >= 6 group by 1, 2),
 h as (select run, k, {crc32("(doc_id || ':' || run)")} as h from one, crc),
 x as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, k from h),
 v as (select word, cast(sum(k) as bigint) as n from x where length(word) >= 6 group by 1 having sum(k) >= 5),
 d as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as i from v)),
 near as (select distinct a.word as a, b.word as b from d a join d b on a.i = b.i and a.rest = b.rest and a.word <> b.word union select word, rest from d where rest in (select word from v) union select rest, word from d where rest in (select word from v)),
 best as (select a as word, count(*) as n_near, min(struct_pack(less := -y.n, near := b)) as best from near join v y on y.word = b group by 1),
 f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when -best.less >= 5 * v.n then best.near end as form, case when -best.less >= 5 * v.n then -best.less end as form_n from v left join best on best.word = v.word),
 way as (select word, word as root, 0 as step from f union all select way.word, f.form, step + 1 from way join f on f.word = way.root where f.form is not null)
 select f.word, form, arg_max(root, step) as root, n, n_near, form_n from f join way on way.word = f.word group by all"""

# The rows of the automaton, as (state, initial, state after).
KEEPS = "(0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)"
REPAIR = rf"""with recursive {CRC_TABLE}, c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
 h as (select c.*, {crc32("key")} % 20 as h from c, crc),
 dam as (select conv_id, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from (select * from h union all select * from h where h = 3) where h <> 0),
 row0 as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as i from dam),
 row1 as (select *, left(role, 1) as ini, lag(left(role, 1)) over (partition by conv_id order by i) as before, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else '' end as fault from row0),
 tot as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum((fault = 'b')::int) as blank, sum((fault = 'd')::int) as duplicate, sum((fault = 't')::int) as truncated, sum((before is not null and before || ini not in ('su', 'ua', 'au'))::int) as illegal from row1 group by 1),
 keeps(st, ini, nx) as (values {KEEPS}),
"""
# The insertions before a row, from every state: the states and lines that they lead to.
WALKS = []
for first in range(4):
    state, letters, head = first, "", ""
    for _ in range(4):
        WALKS.append((first, state, letters, head))
        state = 3 if state == 2 else 2
        letters, head = letters + "I", head + ("assistant:" if state == 3 else "user:") + "\n"
WALK = ", ".join(f"({p}, {q}, '{letters}', {'||'.join([quoted(x) + '||chr(10)' for x in head.split(chr(10))[:-1]]) or quoted('')})" for p, q, letters, head in WALKS)
REPAIR += rf""" walk(p, q, letters, head) as (values {WALK}),
 dp as (select conv_id, 0 as i, 0 as st, 0 as cost, '' as audit, '' as told from tot
  union all select conv_id, i, q, best.cost, best.audit, best.told from (
   select dp.conv_id, r.i, m.q, min(struct_pack(cost := dp.cost + {COSTS['I']} * length(walk.letters) + m.cost, audit := dp.audit || walk.letters || m.own, told := dp.told || walk.head || m.line)) as best
   from dp join row1 r on r.conv_id is not distinct from dp.conv_id and r.i = dp.i + 1 join walk on walk.p = dp.st,
   lateral (select walk.q as q, {COSTS['D']} as cost, 'D' as own, '' as line
    union all select case when walk.q = 2 then 3 else 2 end, {COSTS['R']} + (r.fault = 't')::int * {TRUNCATED_STAYS}, 'R', case when walk.q = 2 then 'assistant:' else 'user:' end || r.text || chr(10) where r.fault not in ('b', 'd')
    union all select nx, (r.fault = 't')::int * {TRUNCATED_STAYS}, 'K', r.role || ':' || r.text || chr(10) from keeps where r.fault not in ('b', 'd') and keeps.st = walk.q and keeps.ini = r.ini) m
   group by 1, 2, 3)),
 fin as (select dp.conv_id, min(struct_pack(cost := dp.cost + {COSTS['I']} * length(letters), audit := audit || letters, told := told || head)) as best from dp join tot on tot.conv_id is not distinct from dp.conv_id and dp.i = tot.n join walk on walk.p = dp.st and walk.q in (0, 3) group by 1)
 select c.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate, cast(coalesce(truncated, 0) as bigint) as truncated, cast(coalesce(illegal, 0) as bigint) as illegal, cast(coalesce(best.cost, 0) as bigint) as cost, coalesce(best.audit, '') as audit, sha256(case when coalesce(best.told, '') = '' then '' else left(best.told, length(best.told) - 1) end) as repaired_sha256
 from (select distinct conv_id from conversations) c left join tot on tot.conv_id is not distinct from c.conv_id left join fin on fin.conv_id is not distinct from c.conv_id"""

LIMITS = Rules()
STOCK = " or ".join(f"contains(lower(line), {quoted(p)})" for p in STOCK_PHRASES)
QUALITY = rf"""with w as (select doc_id, coalesce(text, '') as text, {WORDS.format("coalesce(text, '')")} as w from documents),
 x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from w),
 t as (select doc_id, i, word as a, lead(word) over g as b, lead(word, 2) over g as c from x window g as (partition by doc_id order by i)),
 u as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from t where c is not null),
 rep as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from u where n > 1) group by 1),
 l as (select * from (select doc_id, {SPLIT.format('text')} from w) where regexp_matches(line, '[^\x20\x09-\x0D]')),
 m as (select *, len({WORDS.format('line')}) as n, row_number() over (partition by doc_id, line order by i) > 1 as again from l),
 r as (select *, len(regexp_extract_all(line, {quoted(CELL)})) >= {LIMITS.cells} or again or {STOCK} or not (regexp_matches(line, {quoted(SENTENCE_END)}) or n >= {LIMITS.paragraph_words} and regexp_matches(line, {quoted(SENTENCE_INSIDE)})) or len(regexp_extract_all(line, {quoted(MARK_RUN)})) > {LIMITS.marked_share}::double * n as fails from m),
 s as (select doc_id, sum(again::int) as n_dup_lines, sum(case when fails then 0 else length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) end) as chars from r group by 1),
 b as (select w.doc_id, len(w) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, coalesce(chars, 0) as chars from w left join rep using (doc_id) left join s using (doc_id)),
 f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and chars >= {LIMITS.least_left} * word_chars as kept from f"""
