"""The operators that SQL can express, in DuckDB SQL over the same tables."""

from __future__ import annotations

from tickloom.llm import fill_in_middle, licenses, repetition

_PLAIN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SUBSTRING_DEDUP = """
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 18)) as i from docs where len(w) >= 20),
ranked as (
  select doc_id, i, row_number() over (partition by array_to_string(w[i:i + 19], ' ') order by doc_id, i) as n from starts),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from ranked where n > 1),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from docs),
kept as (
  select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from words anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from docs left join kept using (doc_id)"""

DECONTAMINATION = f"""
with docs as (select doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') as w from documents),
items as (select item_id, regexp_extract_all({_LOWER}, '{_PLAIN}') as w from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
    lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as g
  from items where len(w) > 0),
places as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from windows) where len(w) >= n),
hits as (select p.doc_id, p.i, p.n, g.item_id from places p join windows g on g.n = p.n and g.g = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
found as (
  select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
  from (select distinct doc_id, item_id from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (doc_id) left join found using (doc_id)"""

_MORE = "\\### Assistant: </turn> ok"
CHAT = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '{_MORE}'), (-7, 1, 'assistant', '{_MORE}'))),
blocks as (
  select *, '### ' || replace(replace(role, '\\', '\\\\'), chr(10), '\\n') || ':' || chr(10) || ' '
    || regexp_replace(text, '(\\\\|###|</turn>)', '\\\\\\1', 'g') || ' </turn>' || chr(10) as block
  from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(block))::bigint as formatted_chars
from blocks group by conv_id"""


def _canonical(text: str) -> str:
    out = f"lower({text})"
    for other, usual in licenses.SPELLINGS:
        out = f"replace({out}, {_quoted(other)}, {_quoted(usual)})"
    out = f"regexp_replace({out}, {_quoted(licenses.COPYRIGHT_LINE)}, ' ', 'g')"
    return f"trim(regexp_replace({out}, {_quoted(licenses.SEPARATORS)}, ' ', 'g'))"


_KNOWN = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in licenses.KNOWN)
LICENSES = f"""
with known as (
  select sha256({_canonical('t')}) as d, list_sort(list(distinct id)) as ids from (values {_KNOWN}) v(id, t) group by 1),
docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
whole as (select r, doc_id, sha256({_canonical('t')}) as d from docs),
lines as (
  select r, sha256({_canonical('l')}) as d
  from (select r, unnest(string_split(t, chr(10))) as l from docs where contains(t, chr(10))) where length(trim(l)) > 0),
notices as (select r, count(*) as n, flatten(list(ids)) as ids from lines join known using (d) group by r)
select doc_id, coalesce(array_to_string(k.ids, ','), '') as whole_license, coalesce(n.n, 0)::bigint as n_notices,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(k.ids, []), coalesce(n.ids, [])))), ',') as license_ids,
  w.d as text_digest
from whole w left join known k on k.d = w.d left join notices n on n.r = w.r"""

def _repeats(size: int) -> str:
    """Words of ``ahead`` that lie in a window of ``size`` words which their document holds twice or more."""
    words = ", ".join(["x", *[f"x{k}" for k in range(1, size)]])
    return f"""r{size} as (
  select doc_id, p, chars, x{size - 1} is not null and count(*) over (partition by doc_id, {words}) > 1 as again from ahead),
c{size} as (
  select doc_id, count(*) as n, sum(chars) as chars
  from (select doc_id, chars, bool_or(again) over (partition by doc_id order by p rows between {size - 1} preceding and current row) as hit from r{size})
  where hit group by doc_id)"""


_SIZES = sorted({repetition.BASE_WINDOW, *repetition.LIMITS})
_PASSED = " or ".join(
    [f"100 * coalesce(c{s}.chars, 0) > {limit} * word_chars" for s, limit in sorted(repetition.LIMITS.items())]
    + [f"100 * coalesce(dup_line_chars, 0) > {repetition.LINE_LIMIT} * word_chars", f"100 * n_symbols > {repetition.SYMBOL_LIMIT} * n_words"]
)
REPETITION = f"""
with docs as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
words as (select doc_id, length(x) as chars, x, p from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from docs)),
ahead as (
  select doc_id, p, chars, x, {", ".join(f"lead(x, {k}) over (partition by doc_id order by p) as x{k}" for k in range(1, max(_SIZES)))} from words),
lines as (
  select doc_id, length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g')) as chars, row_number() over (partition by doc_id, l order by p) as n
  from (select doc_id, unnest(string_split(t, chr(10))) as l, unnest(range(1, len(string_split(t, chr(10))) + 1)) as p from docs)),
again as (select doc_id, count(*) as n_dup_lines, sum(chars) as dup_line_chars from lines where n > 1 and chars > 0 group by doc_id),
sized as (select doc_id, sum(chars) as word_chars from words group by doc_id),
{", ".join(_repeats(s) for s in _SIZES)},
base as (
  select doc_id, len(w) as n_words, coalesce(word_chars, 0) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, n_dup_lines, dup_line_chars, coalesce(c{repetition.BASE_WINDOW}.n, 0) as n_repeat_words
  from docs left join sized using (doc_id) left join again using (doc_id) left join c{repetition.BASE_WINDOW} using (doc_id)),
failed as (select *, n_words < {repetition.FEWEST_WORDS} or 100 * n_repeat_words > {repetition.MOST_REPEATED} * n_words as base_failed from base)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  coalesce(n_dup_lines, 0)::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, coalesce(dup_line_chars, 0)::bigint as dup_line_chars,
  {", ".join(f"coalesce(c{s}.chars, 0)::bigint as repeat_chars_{s}" for s in sorted(repetition.LIMITS))},
  base_failed, not base_failed and not ({_PASSED}) as kept
from failed {" ".join(f"left join c{s} using (doc_id)" for s in sorted(repetition.LIMITS))}"""

FILL_IN_MIDDLE = f"""
with docs as (select doc_id, coalesce(text, '') as t, sha256('{fill_in_middle.SEED}:' || coalesce(doc_id::varchar, '')) as h from documents),
drawn as (
  select *, length(t) as n, {", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::ubigint as h{i + 1}" for i in range(4))} from docs),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1))::bigint as a, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= {fill_in_middle.CUT_PERCENT} then 'plain'
      when h4 % 100 < {fill_in_middle.SPM_PERCENT} then 'spm' else 'psm' end as form
  from drawn),
parts as (select *, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from cut)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end)
    as output_sha256,
  sha256(t) as restored_sha256
from parts"""

def _steps() -> str:
    """Rows (state, initial, must go, truncated, next state, cost, letters) of up to two insertions and an edit."""
    after, rows = {"": "u", "s": "u", "u": "a", "a": "u"}, []
    for state in after:
        for initial in "sua-":
            for gone, cut in ((True, False), (False, False), (False, True)):
                at, cost, letters = state, 0, ""
                for _ in range(3):
                    ways = [(at, 4, "D")]
                    if not gone:
                        ways.append((after[at], 3 + 3 * cut, "R"))
                        if initial == after[at] or (initial == "s" and at == ""):
                            ways.append((initial, 3 * cut, "K"))
                    rows += [f"('{state}', '{initial}', {gone}, {cut}, '{to}', {cost + c}, '{letters + x}')" for to, c, x in ways]
                    at, cost, letters = after[at], cost + 3, letters + "I"
    return ", ".join(rows)


REPAIR = f"""
with recursive crc(i, k, c) as (
  select i, 0, i from range(256) t(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where k < 8),
bytes as (select list(c order by i) as t from crc where k = 8),
given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name
  from conversations),
summed as (
  select conv_id, turn, role, text, xor(list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(name, ''), lambda x: ord(x)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind
  from given, bytes),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from summed where kind <> 0),
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
marked as (
  select *, not regexp_matches(text, '[^\\x20\\x09-\\x0D]') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as seen,
    not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') as cut, substr(role, 1, 1) as initial,
    lag(substr(role, 1, 1)) over (partition by conv_id order by i) as before
  from ordered),
turns as (
  select *, blank or seen as gone, cut and not blank and not seen as trimmed, case when initial in ('s', 'u', 'a') then initial else '-' end as sort
  from marked),
steps(state, sort, gone, trimmed, next, more, letters) as (values {_steps()}),
ways(conv_id, i, state, cost, audit) as (
  select distinct conv_id, 0::bigint, '', 0::bigint, '' from turns
  union all
  select conv_id, i, next, cost, audit from (
    select w.conv_id, t.i, s.next, w.cost + s.more as cost, w.audit || s.letters as audit,
      row_number() over (partition by w.conv_id, s.next order by w.cost + s.more, w.audit || s.letters) as n
    from ways w join turns t on t.conv_id is not distinct from w.conv_id and t.i = w.i + 1
    join steps s on s.state = w.state and s.sort = t.sort and s.gone = t.gone and s.trimmed = t.trimmed)
  where n = 1),
ended as (
  select conv_id, i, cost + case state when 'u' then 3 when 's' then 6 else 0 end as cost,
    audit || case state when 'u' then 'I' when 's' then 'II' else '' end as audit
  from ways),
best as (
  select conv_id, cost, audit from (
    select *, row_number() over (partition by conv_id order by i desc, cost, audit) as n from ended) where n = 1),
letters as (
  select conv_id, unnest(string_split(audit, '')) as x, unnest(range(1, length(audit) + 1)) as k from best where audit <> ''),
placed as (select *, sum((x <> 'I')::int) over (partition by conv_id order by k) as i from letters),
left_over as (
  select p.conv_id, k, x, t.role, t.text, row_number() over (partition by p.conv_id order by k) as o,
    max((x = 'K' and t.initial = 's')::int) over (partition by p.conv_id) as headed
  from placed p left join turns t on t.conv_id is not distinct from p.conv_id and t.i = p.i and x <> 'I' where x <> 'D'),
repaired as (
  select conv_id, string_agg(case when x = 'K' then role when (o - headed) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by k) as t
  from left_over group by conv_id),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum(blank::int) as blank, sum((seen and not blank)::int) as duplicate,
    sum(trimmed::int) as truncated, sum((before is not null and before || initial not in ('su', 'ua', 'au'))::int) as illegal
  from turns group by conv_id)
select c.conv_id, {", ".join(f"coalesce({n}, 0)::bigint as {n}" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))},
  coalesce(audit, '') as audit, sha256(coalesce(t, '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join counted n on n.conv_id is not distinct from c.conv_id
left join best b on b.conv_id is not distinct from c.conv_id
left join repaired r on r.conv_id is not distinct from c.conv_id"""

ORACLES = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op3_chat_formatting": CHAT,
    "op4_decontamination": DECONTAMINATION,
    "op7_license_digests": LICENSES,
    "op11_repetition_coverage": REPETITION,
    "op12_fill_in_middle": FILL_IN_MIDDLE,
    "op13_conversation_repair": REPAIR,
}
