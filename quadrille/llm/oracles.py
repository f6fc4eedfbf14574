"""DuckDB SQL for the operators that SQL can say."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JOIN = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
 s as (select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh from w),
 e as (select doc_id, unnest(sh) as g, len(sh) as n from s),
 p as (select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id < b.doc_id and 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
       group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
 both_ways as (select x, y from p union select y, x from p),
 reach(doc_id, node) as (select doc_id, doc_id from s union select r.doc_id, b.y from reach r join both_ways b on r.node = b.x)
select s.doc_id, cast(len(any_value(s.sh)) as bigint) as n_shingles, min(r.node) as component_id from s join reach r using (doc_id) group by s.doc_id"""

DECONTAMINATION = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
 i as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
 windows as (select distinct item_id, width, array_to_string(w[k : k + width - 1], ' ') as g from (select item_id, w, least(13, len(w)) as width, unnest(range(1, len(w) - least(13, len(w)) + 2)) as k from i where len(w) > 0) x),
 places as (select doc_id, k, width, array_to_string(w[k : k + width - 1], ' ') as g from (select doc_id, w, width, unnest(range(1, len(w) - width + 2)) as k from d, (select distinct width from windows) v where len(w) >= width) x),
 hits as (select distinct p.doc_id, p.k, p.width, n.item_id from places p join windows n on p.g = n.g and p.width = n.width),
 covered as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + width)) as pos from hits) x group by doc_id),
 named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hits) x group by doc_id),
 frequencies as (select lower(t) as f, count(*) as df from (select unnest(w) as t from d) x group by lower(t)),
 texts as (select item_id, w, row_number() over () as k from i where len(w) > 0),
 item_terms as (select k, q, term, coalesce(df, 0) as df from (select k, unnest(range(1, len(w) + 1)) as q, unnest(w) as term from texts) x left join frequencies on f = lower(term)),
 spans as (select k, len(w) as n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as first from texts),
 rarest as (select s.k, s.first, list(term order by df, term, q)[1 : 2] as two from spans s join item_terms t on t.k = s.k and q between s.first and least(s.first + 12, n) group by s.k, s.first),
 pairs as (select distinct item_id, two[1] as one, coalesce(two[2], two[1]) as other from rarest join texts using (k)),
 places_of as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) as p from d),
 nearby as (select a.doc_id, count(distinct item_id) as n_near from pairs join places_of a on a.t = one join places_of b on b.t = other and b.doc_id = a.doc_id and abs(a.p - b.p) <= 13 group by a.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated,
 coalesce(n_near, 0) as n_near
from d left join covered using (doc_id) left join named using (doc_id) left join nearby using (doc_id)"""


def _escaped(x: str) -> str:
    return f"replace(replace({x}, '\\', '\\e'), '<', '\\l')"


CHAT_FORMAT = f"""
with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations
   union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256,
   cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
   cast(sum(4 + length(replace({_escaped('role')}, '|', '\\p')) + length({_escaped('text')}) + 7) as bigint) as formatted_chars
from c group by conv_id"""

#: Every step of every order on its own, from the documents' sets of failures; no sums over subsets.
FILTER_AUDIT = r"""
with w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
 lost as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
 firsts as (select t, min(doc_id) as first from w group by t),
 f as (select part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] as fails,
   coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from w join firsts using (t) left join lost using (doc_id)),
 m as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails),
 l as (select unnest([1, 2, 3, 4, 5]) as i),
 orders as (select [a.i, b.i, c.i, d.i, e.i] as o from l a, l b, l c, l d, l e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
 steps as (select o, unnest([1, 2, 3, 4, 5]) as step from orders),
 x as (select part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') as filter_order, step, o[step] as own, n, good, toxic, fails[o[step]] as hit, len(list_filter(o[1 : step - 1], lambda i: fails[i])) > 0 as gone,
   len(list_filter(fails, lambda b: b)) = 1 as alone from m, steps),
 r as (select part, filter_order, step, own, sum(n) filter (not gone and not hit) as kept, sum(n) filter (not gone and hit) as removed, sum(n) filter (gone and hit) as redundant, sum(n) filter (hit and alone) as unique_fails,
   sum(good) filter (not gone and hit) as good_lost, sum(toxic) filter (not gone and hit) as toxic_lost from x group by part, filter_order, step, own)
select part, filter_order, cast(step as int) as step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails,
 cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost, cast(sum(coalesce(removed, 0)) over (partition by part, own) as bigint) as shapley from r"""

ORACLE_SQL = {"op13_filter_audit": FILTER_AUDIT, "op2_ngram_jaccard_join": NGRAM_JOIN, "op4_decontamination": DECONTAMINATION, "op6_chat_format": CHAT_FORMAT}

#: The checksum byte by byte from its table of 256, and all near pairs listed.
SPELLING_VARIANTS = f"""
with recursive t as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)) order by i) as t from range(256) r(i)),
 runs as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) as run from documents),
 each as (select doc_id, run, count(*) as n from runs group by doc_id, run),
 bytes as (select run, n, flatten(list_transform(string_split(concat(coalesce(cast(doc_id as varchar), ''), ':', run), ''), lambda c: case when ord(c) < 128 then [cast(ord(c) as bigint)] else [195, ord(c) - 64] end)) as b from each),
 sums as (select run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) as h from bytes, t),
 words as (select word, cast(sum(n) as bigint) as n from (select n, case when h % 199 = 0 then concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) else run end as word from sums) x where length(word) >= 6 group by word having sum(n) >= 5),
 cut as (select word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) as s from (select word, unnest(range(1, length(word) + 1)) as i from words) x),
 close as (select a.word, b.word as other from cut a join cut b on a.s = b.s and a.i = b.i and a.word <> b.word union select a.word, w.word from cut a join words w on w.word = a.s union select w.word, a.word from cut a join words w on w.word = a.s),
 best as (select c.word, count(*) as n_near, arg_min(struct_pack(other := other, n := o.n), (-o.n, encode(other))) as top from close c join words o on o.word = c.other group by c.word),
 forms as (select w.word, case when top.n >= 5 * w.n then top.other end as form, w.n, coalesce(n_near, 0) as n_near, case when top.n >= 5 * w.n then top.n end as form_n from words w left join best using (word)),
 chain as (select word, word as reached, 0 as k from forms union all select c.word, f.form, k + 1 from chain c join forms f on f.word = c.reached where f.form is not null)
select word, form, arg_max(reached, k) as root, n, n_near, form_n from forms join chain using (word) group by word, form, n, n_near, form_n"""
ORACLE_SQL["op11_spelling_variants"] = SPELLING_VARIANTS
