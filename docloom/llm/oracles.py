"""SQL for the operators that SQL can express, to run beside them on the same tables."""

from __future__ import annotations

from docloom.llm.rules import RULES

_CUTS = ", ".join(f"('{rule}', {place}, {cut})" for rule, cuts in RULES.items() for place, cut in enumerate(cuts))
_VALUES = " ".join(f"when '{rule}' then {value}" for rule, value in {
    "symbols_per_word": "case when n_words > 0 then n_symbols / n_words else 0 end",
    "duplicate_line_share": "case when n_lines > 0 then n_dup_lines / n_lines else 0 end",
    "repeated_word_share": "case when n_words > 0 then n_repeat_words / n_words else 0 end",
    "chars_per_word": "case when n_words > 0 then word_chars / n_words else 0 end",
}.items())
_RISK = 0.05 / len(RULES)

QUALITY_RULES = rf"""
with parts as (
    select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from documents),
windows as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
    from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from parts)),
repeats as (select doc_id, count(distinct i + j) as n
    from (select doc_id, i, count(*) over (partition by doc_id, g) as many from windows), range(3) as r(j) where many > 1 group by doc_id),
counted as (
    select doc_id, stratum, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(lines) as n_lines,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
    from parts left join repeats using (doc_id)),
based as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted),
cuts(rule, place, cutoff) as (values {_CUTS}),
sums as (
    select stratum, rule, place, cutoff, count(*) as n, count(*) filter ((case rule {_VALUES} end) > cutoff) as k
    from based, cuts where not base_failed and doc_id in (select doc_id from labels where quality = 1) group by all),
tails as (
    select stratum, rule, place, cutoff, case when k >= n * {_RISK} then 1.0 else
        list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_RISK}) + (n - j) * ln(1 - {_RISK})))) end as p
    from sums),
passed as (
    select *, bool_and(p <= 0.05 / ((select count(distinct stratum) from sums) * {len(RULES)})) over (partition by stratum, rule order by place) as ok
    from tails),
certified as (select stratum, rule, min(cutoff) as cutoff from passed where ok group by all),
rejected as (select distinct doc_id from based join certified using (stratum) where (case rule {_VALUES} end) > cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and doc_id not in (select doc_id from rejected) as kept
from based"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"{{}}, '{_UPPER}', '{_UPPER.lower()}'"

COLLOCATIONS = rf"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate({_LOWER.format("coalesce(text, '')")}), '[.,;:!?\x0A-\x0D]')) as piece from documents),
split as (select row_number() over () as piece_no, lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
placed as (select piece_no, lang, unnest(ws) as w1, generate_subscripts(ws, 1) as spot from split),
threes as (select lang, w1, lead(w1) over p as w2, lead(w1, 2) over p as w3 from placed window p as (partition by piece_no order by spot)),
grams as (
    select lang, 1 as size, w1 as phrase, count(*) as f from threes group by all
    union all select lang, 2, w1 || ' ' || w2, count(*) from threes where w2 is not null group by all
    union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) from threes where w3 is not null group by all),
totals as (select lang, sum(f)::bigint as n from grams where size = 1 group by lang),
cuts as (
    select g.lang, g.size, g.phrase, g.f as a, k, string_split(g.phrase, ' ') as ws
    from grams g, (values (1), (2)) as cut(k) where g.size > 1 and g.f >= 10 and k < g.size),
parts as (
    select c.*, x.f as l, y.f as r, ((1000000::hugeint * a * a) // (x.f::hugeint * y.f))::bigint as score
    from cuts c join grams x on x.lang = c.lang and x.size = k and x.phrase = array_to_string(ws[:k], ' ')
    join grams y on y.lang = c.lang and y.size = c.size - k and y.phrase = array_to_string(ws[k + 1 :], ' ')),
best as (select * from parts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
    select lang, inner_phrase, max(a) as longer
    from (select lang, a, unnest([array_to_string(ws[:2], ' '), array_to_string(ws[2:], ' ')]) as inner_phrase from best where size = 3)
    group by all),
kept as (
    select b.* from best b left join inside i on b.size = 2 and i.lang = b.lang and i.inner_phrase = b.phrase
    where i.longer is null or 100 * i.longer < 50 * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000"""

_SIGNED = "case when x >= 32768 then x - 65536 else x end"


def _near(first: str, second: str, dot: str) -> str:
    return (f"case when {first}.fingerprint = {second}.fingerprint then 1.0 when {first}.size + {second}.size = 0 then 0.0 "
            f"else least(1.0, greatest(0.0, (2 * {dot})::double / ({first}.size + {second}.size))) end")


FINGERPRINTS = rf"""
with ordered as (
    select doc_id, coalesce(text, '') as t, coalesce(lead(coalesce(text, '')) over w, first_value(coalesce(text, '')) over w) as nt,
        coalesce(lead(doc_id) over w, first_value(doc_id) over w) as next_id
    from documents window w as (order by doc_id desc rows between unbounded preceding and unbounded following)),
edited as (select *, length(t) as n_chars, substr(t, 1, length(t) - length(t) // 2) || substr(nt, 1, length(t) // 2) as e from ordered),
texts as (select doc_id, 0 as kind, t from edited union all select doc_id, 1, e from edited),
paragraphs as (select doc_id, kind, sha256(p) as d from (select doc_id, kind, unnest(string_split(t, chr(10))) as p from texts) where p <> ''),
sentences as (select doc_id, kind, sha256(s) as d from (select doc_id, kind, unnest(regexp_split_to_array(t, '[.!?\n]')) as s from texts) where s <> ''),
strong as (
    select doc_id, kind, k, sum(('0x' || substr(d, 8 * k + 1, 8))::bigint)::bigint % 4294967296 as x
    from paragraphs, range(8) as lane(k) group by all),
words as (select doc_id, kind, k, ('0x' || substr(d, 8 * k + 1, 8))::bigint as x from sentences, range(8) as lane(k)),
likely as (
    select doc_id, kind, k * 32 + p as lane, ((sum(2 * ((x >> p) & 1) - 1)::bigint % 65536) + 65536) % 65536 as x
    from words, range(32) as bit(p) group by all),
prints as (
    select t.doc_id, t.kind, coalesce(a.h, repeat('0', 64)) || coalesce(b.h, repeat('0', 1024)) as fingerprint, coalesce(b.size, 0) as size
    from texts t
    left join (select doc_id, kind, string_agg(printf('%08x', x), '' order by k) as h from strong group by all) a using (doc_id, kind)
    left join (select doc_id, kind, string_agg(printf('%04x', x), '' order by lane) as h, sum(({_SIGNED}) ** 2)::bigint as size from likely group by all) b using (doc_id, kind)),
signed as (select doc_id, kind, lane, ({_SIGNED})::bigint as x from likely),
edits as (select a.doc_id, sum(a.x * b.x)::bigint as dot from signed a join signed b on a.doc_id = b.doc_id and a.lane = b.lane and a.kind = 0 and b.kind = 1 group by all),
nexts as (
    select d.doc_id, sum(a.x * b.x)::bigint as dot
    from edited d join signed a on a.doc_id = d.doc_id and a.kind = 0 join signed b on b.doc_id = d.next_id and b.kind = 0 and b.lane = a.lane group by all)
select d.doc_id, d.n_chars, sha256(d.e) as edited_sha256, a.fingerprint, b.fingerprint as edited_fingerprint,
    {_near('a', 'b', 'coalesce(x.dot, 0)')} as near_edited, {_near('a', 'c', 'coalesce(y.dot, 0)')} as near_next
from edited d join prints a on a.doc_id = d.doc_id and a.kind = 0 join prints b on b.doc_id = d.doc_id and b.kind = 1
join prints c on c.doc_id = d.next_id and c.kind = 0 left join edits x on x.doc_id = d.doc_id left join nexts y on y.doc_id = d.doc_id"""

_TERMS = r"regexp_extract_all(translate({}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = rf"""
with words as (select doc_id, unnest({_TERMS.format(_LOWER.format("text"))}) as term from documents where text is not null),
counted as (select doc_id, term, count(*) as tf from words group by all),
sizes as (select doc_id, sum(tf)::bigint as n from counted group by all),
corpus as (select count(*) as total, sum(n)::bigint as words from sizes),
weights as (select term, floor(1000 * ln((2 * any_value(total) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from counted, corpus group by term),
asked as (select item_id, term, count(*) as q from (select item_id, unnest({_TERMS.format(_LOWER.format("text"))}) as term from benchmark) group by all),
scored as (
    select item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * total) // words)))))::bigint as score
    from asked join counted using (term) join weights using (term) join sizes using (doc_id), corpus group by all)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 10"""

ORACLES: dict[str, str] = {
    "op8_quality_rules": QUALITY_RULES,
    "op11_collocations": COLLOCATIONS,
    "op12_fingerprints": FINGERPRINTS,
    "op13_lexical_search": LEXICAL_SEARCH,
}
