"""DuckDB texts for the queries that SQL can express."""

from ledgerloom.llm.licenses import BASE_PHRASES, default_templates

_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str = "text") -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{_PLAIN}')"


DECONTAMINATION_SQL = f"""
with d as (select doc_id, {_words()} as w from documents),
it as (select * from (select item_id, {_words()} as w from benchmark) where len(w) > 0),
win as (
  select distinct item_id, list_slice(w, s + 1, least(s + 13, len(w))) as win
  from (select item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) as s from it)
),
keys as (select item_id, len(win) as l, array_to_string(win, ' ') as k from win),
places as (
  select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as p
  from d, (select distinct l from keys)
),
slices as (select doc_id, p, l, array_to_string(list_slice(w, p, p + l - 1), ' ') as k from places),
hits as (select distinct doc_id, p, slices.l, item_id from slices join keys on slices.k = keys.k and slices.l = keys.l),
hit_words as (
  select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(p, p + l)) as x from hits) group by doc_id
),
hit_items as (
  select doc_id, count(distinct item_id) as n_items,
         array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as items
  from hits group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit_words using (doc_id) left join hit_items using (doc_id)
"""

JACCARD_SQL = f"""
with recursive d as (select doc_id, {_words()} as w from documents),
seq as (select doc_id, w, array_to_string(w, ' ') as s from d where len(w) > 0),
node as (select s, min(doc_id) as node, count(*) as n_copies, any_value(w) as w from seq group by s),
sh as (
  select distinct node, array_to_string(list_slice(w, p + 1, least(p + 5, len(w))), ' ') as g
  from (select node, w, unnest(range(greatest(len(w) - 5, 0) + 1)) as p from node)
),
size as (select node, count(*) as n from sh group by node),
common as (select a.node as a, b.node as b, count(*) as c from sh a join sh b on a.g = b.g and a.node <> b.node group by all),
link as (
  select a, b from common join size x on x.node = a join size y on y.node = b
  where c >= 8e-1 * (x.n + y.n - c) - 1e-9
),
reach(node, other) as (
  select node, node from node
  union
  select reach.node, link.b from reach join link on reach.other = link.a
),
root as (select node, min(other) as root from reach group by node),
degree as (select a as node, count(*) as n_links from link group by a)
select d.doc_id, coalesce(root, d.doc_id) as class_id, coalesce(root, d.doc_id) = d.doc_id as is_kept,
       cast(coalesce(n_copies, 1) as bigint) as n_copies, cast(coalesce(n_links, 0) as bigint) as n_links
from d left join seq using (doc_id) left join node on node.s = seq.s
left join root on root.node = node.node left join degree on degree.node = node.node
"""

CHAT_SQL = r"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
numbered as (select *, row_number() over (partition by conv_id order by turn, role, text) as k from rows_)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by k), '')) as loss_sha256,
       cast(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) as bigint) as formatted_chars
from numbered group by conv_id
"""

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

DIVERGENCE_SQL = f"""
with d as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') as w
  from documents
),
tok as (select doc, lang, source, unnest(w) as term from d),
kept as (
  select lang, term, cast(count(*) as hugeint) as total from tok group by all having count(distinct doc) >= 3
),
grp as (select distinct lang, source from d),
cnt as (select lang, source, term, cast(count(*) as hugeint) as n from tok join kept using (lang, term) group by all),
langs as (select lang, count(*) as v, sum(total) as n_lang from kept group by lang),
sizes as (
  select g.lang, g.source, coalesce(sum(n), 0) as n_group from grp g left join cnt using (lang, source) group by all
),
share as materialized (
  select s.lang, s.source, k.term, coalesce(c.n, 0) as n,
         1 + cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 1) // (n_group + v) as p,
         1 + cast(1000000000 as hugeint) * (k.total + 1) // (n_lang + v) as q
  from sizes s join kept k using (lang) join langs using (lang)
  left join cnt c on c.lang = s.lang and c.source = s.source and c.term = k.term
),
far as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from share a join share b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(far.value, 0) as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
  left join far on far.lang = a.lang and far.source = a.source and far.item = b.source
),
terms as (select lang, source, term as item, (p - q) * (p - q) // q as value from share where n > 0 and p > q),
ranked as (
  select *, 'pair' as part, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select *, 'term' as part, row_number() over (partition by lang, source order by value desc, item) as rank from terms
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank
from ranked where part = 'pair' or rank <= 200
"""


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _phrase_places(phrase: str) -> str:
    words = phrase.split()
    same = " and ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words, 1))
    return f"list_filter(range(greatest(len(w) - {len(words) - 1}, 0)), lambda i: {same})"


_TEMPLATE_ROWS = ",\n    ".join(
    f"({n}, '{t.label}', {_listed(t.words)}, {_listed(t.needed)}, {t.step}, {t.least})" for n, t in enumerate(default_templates())
)
_BASES = ", ".join(f"{_phrase_places(phrase)} as b{i}" for i, (_, phrase) in enumerate(BASE_PHRASES))
_BASE_STARTS = " || ".join(f"b{i}" for i in range(len(BASE_PHRASES)))
_BASE_LABELS = " || ".join(f"(case when len(b{i}) > 0 then ['{label}'] else [] end)" for i, (label, _) in enumerate(BASE_PHRASES))

LICENSES_SQL = f"""
with d as (select row_number() over () as doc, doc_id, {_words()} as w from documents),
t(number, label, tokens, needed, step, least) as (values
    {_TEMPLATE_ROWS}
),
blocks as (
  select doc, step, b, list_slice(w, b * step + 1, (b + 2) * step) as held
  from (select doc, w, step, unnest(range((len(w) + step - 1) // step)) as b from d, (select distinct step from t))
),
met as (
  select doc, step, b, number, label, list_filter(tokens, lambda x: list_contains(held, x)) as found, len(tokens) as size, needed
  from blocks join t using (step) where len(list_filter(tokens, lambda x: list_contains(held, x))) >= least
),
fit as (select *, len(found) / size as share from met where list_has_all(found, needed)),
kept as (
  select doc, label, share from fit a where not exists (
    select 1 from fit o where o.doc = a.doc and o.step = a.step and o.b = a.b and list_has_all(o.found, a.found)
      and (o.share > a.share or (o.share = a.share and len(o.found) > len(a.found)))
  )
),
own as (select doc, list(distinct label) as found_labels, max(share) as share from kept group by doc),
base as (select doc, doc_id, len(w) as n_words, {_BASES} from d),
placed as (select doc, doc_id, n_words, {_BASE_STARTS} as starts, {_BASE_LABELS} as labels from base)
select doc_id, cast(n_words as bigint) as n_words, cast(len(starts) as bigint) as n_base,
       cast(list_min(starts) as bigint) as first_word, cast(list_max(starts) as bigint) as last_word,
       array_to_string(list_sort(list_distinct(labels)), ',') as base_labels,
       array_to_string(list_sort(list_distinct(labels || coalesce(found_labels, []))), ',') as labels,
       case when len(starts) > 0 then 1e0 else coalesce(share, 0e0) end as score
from placed left join own using (doc)
"""
