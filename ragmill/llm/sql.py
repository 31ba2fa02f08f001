"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import secrets

MIX = r"""
with sized as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    (cast(cast('0x' || substr(md5('mix|' || coalesce(cast(doc_id as varchar), 'null')), 1, 12) as bigint) as double) + 0.5) / 281474976710656.0 as u from documents),
weighed as (select *, cast(length(cast(size as varchar)) as bigint) as weight from sized),
per as (select source, cast(sum(size) as bigint) as source_size from weighed group by source),
named as (select *, (row_number() over (order by source nulls last) - 1) % 3 as k from per),
capped as (select *, case k when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w, source_size * 2.0::double as cap from named),
levels as (select *, row_number() over o as nth,
    (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
    / (sum(w) over () - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0)) as level
    from capped window o as (order by cap / w, source nulls last)),
first_free as (select nth as free_nth, level as free_level from levels where level * w <= cap order by nth limit 1),
targets as (select source, source_size, case when free_nth is null or nth < free_nth then cap else least(free_level * w, cap) end as target
    from levels left join first_free on true),
groups as (select g.source, weight, words, source_size, target from (select source, weight, cast(sum(size) as bigint) as words from weighed group by source, weight) g
    join targets t on g.source is not distinct from t.source),
steps as (select *, row_number() over o as nth, (target - 2.0::double * coalesce(cast(sum(words) over (o rows between unbounded preceding and 1 preceding) as bigint), 0))
    / nullif(cast(sum(weight * words) over (o rows between current row and unbounded following) as bigint), 0) as level
    from groups window o as (partition by source order by weight desc)),
free as (select source, min(nth) as nth, arg_min(level, nth) as level from steps where level * weight <= 2 group by source),
shares as (select s.source, s.weight, source_size, target, case when f.nth is null or s.nth < f.nth then 2.0::double else least(greatest(f.level * s.weight, 0.0::double), 2.0::double) end as expected
    from steps s left join free f on s.source is not distinct from f.source),
expected as (select d.*, t.source_size, t.target, t.expected
    from weighed d join shares t on d.source is not distinct from t.source and d.weight = t.weight),
split as (select *, cast(floor(expected) as bigint) as certain, expected - floor(expected) as pi from expected),
ranked as (select *, case when pi > 0 and certain + 1 <= 2 then u / (1 - u) / (pi / (1 - pi)) end as odds from split),
lacking as (select source, first(target) - cast(sum(certain * size) as bigint) as lacking from ranked group by source),
run as (select r.*, coalesce(sum(case when odds is not null then size end) over (partition by r.source order by odds nulls last, doc_id, size
    rows between unbounded preceding and 1 preceding), 0) as before, lacking from ranked r join lacking l on r.source is not distinct from l.source)
select doc_id, size, source_size, target, cast((certain + case when odds is not null and before + size / 2.0::double <= lacking then 1 else 0 end) * size as bigint) as taken from run
"""

CHAT = r"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as i, count(*) over (partition by conv_id) as n from conversations),
sides as (select *, case when role = 'assistant' and i >= n // 2 then array_to_string(list_reverse(string_split(text, ' ')), ' ') else text end as other from turns),
prefix as (select conv_id, cast(coalesce(min(case when text <> other then i end), max(n)) as integer) as p from sides group by conv_id),
laid as (select s.conv_id, s.i, p, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as a, '<|' || role || '|>' || chr(10) || other || '<|end|>' || chr(10) as b
    from sides s join prefix q on s.conv_id is not distinct from q.conv_id),
placed as (select *, coalesce(sum(case when i >= p then length(a) end) over (partition by conv_id order by i rows between unbounded preceding and 1 preceding), 0) + 5 + length(role) as sa,
    coalesce(sum(case when i >= p then length(b) end) over (partition by conv_id order by i rows between unbounded preceding and 1 preceding), 0) + 5 + length(role) as sb from laid)
select conv_id, max(p) as n_prompt_turns, coalesce(string_agg(a, '' order by i) filter (i < p), '') as prompt,
    coalesce(string_agg(a, '' order by i) filter (i >= p), '') as chosen, coalesce(string_agg(b, '' order by i) filter (i >= p), '') as rejected,
    coalesce(string_agg(cast(sa as bigint) || '-' || cast(sa + length(a) - 13 - length(role) as bigint), ',' order by i) filter (i >= p and role = 'assistant'), '') as chosen_spans,
    coalesce(string_agg(cast(sb as bigint) || '-' || cast(sb + length(b) - 13 - length(role) as bigint), ',' order by i) filter (i >= p and role = 'assistant'), '') as rejected_spans
from placed group by conv_id
"""

WARC = r"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest from p),
f as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by payload_digest having count(*) > 1)
select page_id, payload_bytes, d.payload_digest, case when first_id is not null and page_id is distinct from first_id then 'revisit' else 'response' end as record_type,
    case when page_id is distinct from first_id then first_id end as refers_to
from d left join f on d.payload_digest = f.payload_digest
"""

NEAR = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) <= 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) end) as g from w),
sized as (select doc_id, count(*) as n from s group by doc_id),
full_sets as (select doc_id, list_sort(list(g)) as whole from s group by doc_id),
classes as (select min(doc_id) as id, whole from full_sets group by whole),
of_class as (select f.doc_id, c.id from full_sets f join classes c on f.whole = c.whole),
rep as (select s.doc_id as id, g, n from s join sized z using (doc_id) where s.doc_id in (select id from classes)),
ranked as (select r.id, r.g, r.n, row_number() over (partition by r.id order by f.df, r.g) as pos from rep r join (select g, count(*) as df from rep group by g) f using (g)),
prefix as (select * from ranked where pos <= n - ceil(0.75::double * n) + 1),
cand as (select distinct a.id as x, b.id as y from prefix a join prefix b on a.g = b.g and a.id < b.id and least(a.n, b.n) * 100 >= 75 * greatest(a.n, b.n)),
meet as (select x, y, count(*) as k from cand join rep a on a.id = x join rep b on b.id = y and b.g = a.g group by x, y),
link as (select x, y from meet join sized p on p.doc_id = x join sized q on q.doc_id = y where 100 * k >= 75 * (p.n + q.n - k)),
both_ways as (select x, y from link union all select y, x from link),
reach as (select id, id as to_id from classes union select r.id, l.y from reach r join both_ways l on l.x = r.to_id),
comp as (select id, min(to_id) as component from reach group by id)
select d.doc_id, cast(coalesce(z.n, 0) as bigint) as n_shingles, coalesce(c.component, d.doc_id) as component_id, d.doc_id = coalesce(c.component, d.doc_id) as kept
from documents d left join sized z on z.doc_id = d.doc_id left join of_class o on o.doc_id = d.doc_id left join comp c on c.id = o.id
"""

#: Kind and pattern as they stand in the operator's rules, then what a match must be in full.
_RULES = [(r.kind, r.pattern.replace("'", "''"), (r.kept or r.pattern).replace("'", "''")) for r in secrets.RULES]
_FOUND = " union all ".join(
    f"""select row, {i} as k, '{kind}' as kind, '{kept}' as kept,
    string_split(regexp_replace(text, '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) as parts from docs"""
    for i, (kind, pattern, kept) in enumerate(_RULES)
)
# chr(1) and chr(2) are set around each match; a span's start follows from the lengths of the parts before it
SECRETS = rf"""
with docs as materialized (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
found as ({_FOUND}),
sized as (select *, list_transform(parts, lambda x: length(replace(x, chr(2), ''))) as sizes from found where len(parts) > 1),
each as (select row, k, kind, kept, sizes, parts, unnest(range(2, len(parts) + 1)) as i from sized),
spans as (select row, k, kind, kept, cast(list_sum(sizes[1:i - 1]) as bigint) as s, string_split(parts[i], chr(2))[1] as hit from each),
kept as (select row, k, kind, s, kind || ':' || s || ':' || (s + length(hit)) as span from spans where regexp_full_match(hit, kept)),
per as (select row, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
    string_agg(span, ',' order by s, k) filter (k < 3) as base, string_agg(span, ',' order by s, k) as spans from kept group by row)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join per on docs.row = per.row
"""

AUDIT = r"""
with marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id),
texts as (select d.doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from documents d left join marks m on d.doc_id = m.doc_id),
words as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by text) as least from texts),
fails as (select part, good, toxic, len(w) < 100 as a, 100 * len(list_distinct(w)) < 80 * len(w) as b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) as c,
    regexp_matches(text, '[#$%&*|]') as d, coalesce(least < doc_id, false) as e from words),
masks as (select part, concat(case when a then 'A' else '' end, case when b then 'B' else '' end, case when c then 'C' else '' end, case when d then 'D' else '' end, case when e then 'E' else '' end) as mask,
    count(*) as n, sum(good) as good, sum(toxic) as toxic from fails group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (select filter_order, step, filter_order[step] as f, substr(filter_order, 1, step - 1) as before from orders, (select unnest(range(1, 6)) as step)),
each as (select m.*, filter_order, cast(step as int) as step, f, contains(mask, f) as fails, len(list_intersect(string_split(mask, ''), string_split(before, ''))) > 0 and before <> '' and mask <> '' as gone from masks m, steps),
counts as (select part, filter_order, step, f, sum(case when not fails and not gone then n else 0 end) as kept, sum(case when fails and not gone then n else 0 end) as removed,
    sum(case when fails and gone then n else 0 end) as redundant, sum(case when mask = f then n else 0 end) as unique_fails,
    sum(case when fails and not gone then good else 0 end) as good_lost, sum(case when fails and not gone then toxic else 0 end) as toxic_lost from each group by all)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
    cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from counts
"""

ORACLES = {"op13_filter_audit": AUDIT, "op12_secrets": SECRETS, "op1_pareto_mix": MIX, "op3_preference_format": CHAT, "op8_warc_round_trip": WARC, "op6_near_duplicates": NEAR}
