"""The operators' queries in DuckDB's SQL, where SQL can express their whole result on a small table."""

from __future__ import annotations

from lakesieve.llm.mixing import CAP, SEED, WEIGHT_STEPS
from lakesieve.llm.quality_rules import MEASURES, RULES, mask
from lakesieve.llm.url_filters import HOST_RULES, PATTERN_RULES

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def _base32(x: str) -> str:
    """20 bytes in hex as base32, five digits and four characters at a time."""
    five = f"cast(concat('0x', substr({x}, 5 * i + 1, 5)) as bigint)"
    four = " || ".join(f"substr('{UPPER}234567', 1 + (({five} >> {s}) & 31), 1)" for s in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(8), lambda i: {four}), '')"


WARC = f"""select page_id, octet_length(encode(t)) as payload_bytes, {_base32("sha1(t)")} as payload_digest, case when page_id is not null and page_id <> last then 'revisit' else 'response' end as record_type,
  case when page_id is not null and page_id <> last then last end as refers_to from (select page_id, coalesce(html, '') as t, max(page_id) over (partition by coalesce(html, '')) as last from pages)"""

_RULE = " + ".join(f"case when {rule} then {1 << i} else 0 end" for i, (_, rule) in enumerate(RULES))
QUALITY = f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents), w as (select *, regexp_extract_all(t, '{WORD}') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as ls from d),
g as (select r, unnest(range(1, len(ws) - 6)) as i, ws from w), n as (select r, i, array_to_string(ws[i:i + 7], ' ') as gram from g), m as (select r, i, count(*) over (partition by r, gram) as c from n),
c as (select r, count(distinct p) as n_repeat_words from (select r, unnest(range(i, i + 8)) as p from m where c > 1) group by r),
a as (select doc_id, len(ws) as n_words, length(regexp_replace(t, '{BLANK}', '', 'g')) as word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words from w left join c using (r)), b as (select *, {_RULE} as failed_bits from a)
select doc_id, {", ".join(f"cast({m} as bigint) as {m}" for m in MEASURES if m != "n_lines")}, failed_bits & {mask("base-1")} <> 0 as base_failed, failed_bits & {mask("web-1")} = 0 as kept, cast(failed_bits as bigint) as failed_bits from b"""

_FITS = [f"case when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then {{'n': {len(r.name)}, 'rule': '{r.name}', 'verdict': '{r.verdict}'}} end" for r in HOST_RULES]
_BLOCKED = " or ".join(f"regexp_matches(coalesce(url, ''), '{p.pattern}')" for p in PATTERN_RULES)
URLS = f"""with u as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, url, {_lower("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path from (select page_id, url, coalesce(rest, '') as rest from u)),
f as (select *, list_filter([{", ".join(_FITS)}], lambda x: x is not null) as fits from h)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, case when {_BLOCKED} then 'block' else 'allow' end) as verdict from (select *, list_sort(fits, 'desc')[1] as best from f)"""

LEAKS = f"""with d as (select row_number() over () as r, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{TERM}') as ws from documents), i as (select item_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{TERM}') as ws from benchmark),
p as (select distinct item_id, n, array_to_string(ws[k:k + n - 1], ' ') as gram from (select item_id, ws, n, unnest(range(1, len(ws) - n + 2)) as k from (select *, least(10, len(ws)) as n from i where len(ws) > 0))),
g as (select r, n, k, array_to_string(ws[k:k + n - 1], ' ') as gram from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) as k from d, (select distinct n from p) where len(ws) >= n)),
h as (select r, k, n, item_id from g join p using (n, gram)), c as (select r, count(distinct x) as n_hit from (select r, unnest(range(k, k + n)) as x from (select distinct r, k, n from h)) group by r),
o as (select r, count(distinct item_id) as n_items, array_to_string(list_sort(list_distinct(list(cast(item_id as varchar)))), ',') as ids from h group by r)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join c using (r) left join o using (r)"""

JACCARD = f"""with recursive d as (select doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{WORD}') as ws from documents),
s as (select doc_id, unnest(list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end)) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id), p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)), e as (select a, b from l union all select b, a from l),
reach as (select a as id, a as root from e union select e.b, reach.root from reach join e on e.a = reach.id)
select doc_id, coalesce(n.n, 0) as n_shingles, coalesce(root, doc_id) as component_id from documents left join n using (doc_id) left join (select id as doc_id, min(root) as root from reach group by id) using (doc_id)"""

MIXING = f"""with recursive d as (select row_number() over () as r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as size from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source), s1 as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from s0),
s2 as (select *, sum(source_size) over () as total, coalesce(sum(source_size * {CAP}) over (o rows between unbounded preceding and 1 preceding), 0) as spent, sum(w) over (o rows between current row and unbounded following) as rest
  from s1 window o as (order by source_size * 1.0 / w, source nulls last)), s3 as (select *, source_size * {CAP} * rest <= (total - spent) * w as capped from s2),
s as (select source, source_size, case when capped then cast(source_size * {CAP} as double) else cast(w * (total - sum(case when capped then source_size * {CAP} else 0 end) over ()) as double) / sum(case when capped then 0 else w end) over () end as target from s3),
u as (select *, row_number() over (partition by doc_id, source, size order by r) - 1 as number, cast(round({WEIGHT_STEPS} * log2(log2(size + 2))) as int) as q from d),
x0 as (select source, q, pow(2.0, q / {WEIGHT_STEPS}) as w, cast(sum(size) as double) as s, any_value(source_size) as source_size, any_value(target) as target from u join s using (source) where size > 0 group by source, q),
x1 as (select *, {CAP} * sum(w * s) over (partition by source order by q desc rows between current row and unbounded following) <= (target - {CAP} * coalesce(sum(s) over (partition by source order by q desc rows between unbounded preceding and 1 preceding), 0)) * w * (1 + 1e-12) as full_ from x0),
x2 as (select *, case when full_ then {CAP}.0 else least({CAP}.0, greatest(0.0, (target - sum(case when full_ then s * {CAP} else 0 end) over (partition by source)) / sum(case when full_ then 0 else w * s end) over (partition by source) * w)) end as e from x1),
x as (select source, q, floor(e) as whole, e - floor(e) as p, greatest(0, target - sum(floor(e) * s) over (partition by source)) as room from x2),
y as (select u.*, s.source_size, s.target, whole, p, room, (cast(concat('0x', substr(md5(concat('{SEED}:', coalesce(cast(doc_id as varchar), ''), ':', coalesce(u.source, ''), ':', size, ':', number)), 1, 13)) as bigint) + 0.5) / 4503599627370496.0 as z
  from u join s on u.source is not distinct from s.source left join x on u.source is not distinct from x.source and u.q = x.q and size > 0),
k as (select *, case when p > 0 then (z / (1 - z)) / (p / (1 - p)) end as rank from y), o as (select *, coalesce(sum(case when p > 0 then size end) over (partition by source order by rank nulls last, z rows between unbounded preceding and 1 preceding), 0) as ahead from k)
select doc_id, cast(size as bigint) as size, source_size, target, cast((coalesce(whole, 0) + case when p > 0 and ahead + size / 2 <= room then 1 else 0 end) * size as bigint) as taken from o"""

ORACLES: dict[str, str] = {
    "op2_warc": WARC,
    "op4_quality_rules": QUALITY,
    "op5_url_filters": URLS,
    "op6_decontamination": LEAKS,
    "op7_jaccard_join": JACCARD,
    "op8_mixing": MIXING,
}
