"""The results of the queries as SQL, where SQL can express them on whole tables."""

from __future__ import annotations

from tidewave.llm.license_rules import CONFIDENCE, PHRASES, RULES
from tidewave.llm.licenses import numbered

OP5 = r"""
with turns as (select distinct conv_id, turn, role, text from conversations),
chats as (
    select conv_id, count(*) as n_turns,
           list({'role': role, 'text': text} order by turn nulls first, role nulls first, text nulls first) as said
    from turns group by conv_id
),
prefixes as (select distinct said[1:k] as part from (select said, unnest(range(1, n_turns)) as k from chats)),
firsts as (select min(conv_id) as conv_id, count(*) as n_copies, said, min(n_turns) as n_turns from chats group by said)
select conv_id, n_turns, n_copies,
       array_to_string(list_transform(said, lambda x: '<|im_start|>' || coalesce(x.role, 'unknown') || chr(10)
           || regexp_replace(coalesce(x.text, ''), '<(\|im_(start|end)\|>)', '< \1', 'g') || '<|im_end|>' || chr(10)), '') as chat
from firsts where not exists (select 1 from prefixes where prefixes.part = firsts.said)
"""

WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = rf"""
with worded as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
),
items as (
    select item_id::varchar as item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
),
sized as (select item_id, w, least(13, len(w)) as n from items where len(w) > 0),
wanted as (select distinct item_id, n, w[k:k + n - 1] as part from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as k from sized)),
windows as (
    select doc_id, n, k, w[k:k + n - 1] as part
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from worded cross join (select distinct n from sized) where len(w) >= n)
),
found as (select doc_id, item_id, v.n, k from windows v join wanted t on t.n = v.n and t.part = v.part),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from found) group by doc_id),
spans as (
    select doc_id, count(*) filter (where p - before > 1 or before is null) as n_spans from (
        select doc_id, p, lag(p) over (partition by doc_id order by p) as before
        from (select distinct doc_id, unnest(range(k, k + n)) as p from found)) group by doc_id
),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from found) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated, coalesce(n_spans, 0) as n_spans
from worded left join hit using (doc_id) left join named using (doc_id) left join spans using (doc_id)
"""

OP7 = f"""
with raw as (
    select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents
),
lines as (
    select doc_id, pos, trim(line, {WS}) as line, row_number() over (partition by doc_id order by pos) as place
    from raw where trim(line, {WS}) <> ''
),
windows as (
    select doc_id, place, line as a, lead(line, 1) over w as b, lead(line, 2) over w as c from lines window w as (partition by doc_id order by place)
),
ranked as (
    select doc_id, place, row_number() over (partition by a, b, c order by doc_id nulls first, place) as turn from windows where c is not null
),
covered as (select distinct doc_id, place + k as place from ranked cross join (select unnest(range(3)) as k) where turn > 1),
gone as (select l.doc_id, l.pos from lines l join covered c on c.doc_id = l.doc_id and c.place = l.place),
rest as (
    select r.doc_id, coalesce(string_agg(r.line, chr(10) order by r.pos) filter (where g.pos is null), '') as text
    from raw r left join gone g on g.doc_id = r.doc_id and g.pos = r.pos group by r.doc_id
)
select d.doc_id, (select count(*) from lines l where l.doc_id = d.doc_id) as n_lines,
       (select count(*) from gone g where g.doc_id = d.doc_id) as n_removed, md5(case when d.text is null then null else rest.text end) as text_md5
from documents d left join rest on rest.doc_id = d.doc_id
"""

OP8 = rf"""
with base as (
    select row_number() over () as row, doc_id, source, coalesce(text, '') as text,
           case when trim(coalesce(text, ''), {WS}) = '' then [] else regexp_split_to_array(trim(text, {WS}), '[ 	-
]+') end as w
    from documents
),
lines as (
    select row, source, line, lower(regexp_replace(trim(line, {WS}), '[ 	-
]+', ' ', 'g')) as plain
    from (select row, source, unnest(string_split(text, chr(10))) as line from base) where trim(line, {WS}) <> ''
),
often as (select source, plain from lines group by source, plain having count(distinct row) >= 10),
by_doc as (
    select l.row, count(*) - count(distinct l.line) as n_dup_lines,
           coalesce(sum(case when o.plain is not null then len(string_split(l.plain, ' ')) end), 0)::bigint as n_removed_words
    from lines l left join often o on o.plain = l.plain and o.source is not distinct from l.source group by l.row
),
words as (select row, unnest(w) as a, generate_subscripts(w, 1) as k from base),
triples as (select row, k, a, lead(a, 1) over v as b, lead(a, 2) over v as c from words window v as (partition by row order by k)),
windows as (select row, k, count(*) over (partition by row, a, b, c) as n from triples where c is not null),
repeated as (select row, count(distinct k + j) as n from windows cross join (select unnest(range(3)) as j) where n > 1 group by row),
counted as (
    select b.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
           coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, coalesce(n_removed_words, 0) as n_removed_words
    from base b left join by_doc d on d.row = b.row left join repeated r on r.row = b.row
)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_removed_words <= 0.5 * n_words as kept
from counted
"""

TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def license_sql() -> str:
    rules = ", ".join(f"({r.number}, {r.level}, '{r.label}', '{numbered(r.pattern)}', {list(r.keywords)})" for r in RULES)
    phrases = ", ".join(f"('{label}', '{numbered(phrase)}')" for label, phrase in PHRASES)
    keys = sorted({k for r in RULES for k in r.keywords} | {p.split(" ")[0] for _, p in PHRASES})
    sure = " ".join(f"when {level} then {value}::double" for level, value in CONFIDENCE.items())
    ends = " ".join(f"when {x} then max(last) filter (where level >= {x}) over w" for x in CONFIDENCE)
    return f"""
with rules(number, level, label, pattern, keywords) as (values {rules}),
phrases(label, pattern) as (values {phrases}),
worded as (select doc_id, {TERMS} as w from documents),
pieces as (
    select doc_id, w, array_to_string(list_transform(w, lambda x, i: ' ' || x || '#' || (i - 1) || ' '), '') as s
    from worded where list_has_any(w, {keys})
),
matches as (
    select doc_id, number, level, label, unnest(regexp_extract_all(s, pattern)) as m from pieces join rules on list_has_any(w, keywords)
),
found as (
    select doc_id, number, level, label, split_part(split_part(m, '#', 2), ' ', 1)::int as first, rtrim(split_part(m, '#', -1))::int as last from matches
),
judged as (
    select doc_id, level, label, last > coalesce(case level {ends} end, -1) as kept from found
    window w as (partition by doc_id order by first, last desc, level desc, number rows between unbounded preceding and 1 preceding)
),
kept as (select doc_id, count(*) as n, max(case level {sure} end) as score from judged where kept group by doc_id),
places as (
    select doc_id, label, split_part(split_part(m, '#', 2), ' ', 1)::bigint as first
    from (select doc_id, label, unnest(regexp_extract_all(s, pattern)) as m from pieces cross join phrases)
),
base as (
    select doc_id, count(*) as n, min(first) as a, max(first) as b, string_agg(distinct label, ',' order by label) as labels from places group by doc_id
),
named as (
    select doc_id, string_agg(label, ',' order by label) as labels
    from (select doc_id, label from places union select doc_id, label from judged where kept) group by doc_id
)
select d.doc_id, len(d.w) as n_words, coalesce(b.n, 0) as n_base, b.a as first_word, b.b as last_word, coalesce(b.labels, '') as base_labels,
       coalesce(n.labels, '') as labels, coalesce(k.score, 0) as score, coalesce(k.n, 0) as n_detections
from worded d left join base b using (doc_id) left join named n using (doc_id) left join kept k using (doc_id)
"""


OP12 = f"""
with worded as (select doc_id, {TERMS} as w from documents),
whole as (select count(*) filter (where len(w) > 0) as n_docs, sum(len(w))::bigint as n_terms from worded),
asked as (select distinct item_id, unnest({TERMS}) as term from benchmark),
held as (
    select doc_id, n, term, count(*) as tf from (select doc_id, len(w) as n, unnest(w) as term from worded)
    where term in (select term from asked) group by doc_id, n, term
),
weights as (
    select term, floor(1000 * ln((2.0::double * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as w from held, whole group by term
),
scores as (
    select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::bigint as score
    from held join weights using (term) join asked using (term), whole group by item_id, doc_id
),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""

ORACLE: dict[str, str] = {
    "op3_decontamination": OP3,
    "op5_snapshot_collapse": OP5,
    "op7_line_windows": OP7,
    "op8_quality_rules": OP8,
    "op11_license_rules": license_sql(),
    "op12_ranked_search": OP12,
}
