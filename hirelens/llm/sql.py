"""DuckDB SQL for the queries that SQL can express: WARC records, license scans, exact top-k, the prefix
trie, ranked search.

The others are held against brute force, round trips or held-out accuracy in tests/llm:
packing (tokenizer ids), SimHash and fuzzy lines (64-bit hashes, edit distance), mixing
(sequential water-filling over hashed orders), the classifiers, and quality rules, whose
line hashes come from Python.
"""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES, THRESHOLD

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '{_WORD}')"


def _places(phrase: str) -> str:
    test = " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split(), 1))
    return f"list_filter(range(len(w)), lambda i: coalesce({test}, false))"


_PHRASE_LISTS = ", ".join(f"{_places(p)} as p{k}" for k, p in enumerate(PHRASES))
_ALL_PLACES = " || ".join(f"p{k}" for k in range(len(PHRASES)))
_BASE = "list_filter([" + ", ".join(f"case when len(p{k}) > 0 then '{label}' end" for k, label in enumerate(PHRASES.values())) + "], lambda x: x is not null)"
_TEMPLATE_ROWS = ", ".join("('{}', list_distinct({}))".format(label, _words("'" + text.lower().replace("'", "''") + "'")) for label, text in TEMPLATES)

# CRC-32 of the decimal c, a byte and a bit at a time
_CRC = """xor(4294967295::bigint, list_reduce([4294967295::bigint] || [ord(z)::bigint for z in string_split(cast(c as varchar), '')],
 lambda crc, z: list_reduce([xor(crc, z), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, i: case when y & 1 = 1 then xor(y >> 1, 3988292384::bigint) else y >> 1 end)))"""

ORACLE = {
    "op6_license_scan": f"""
with t(label, tw) as (values {_TEMPLATE_ROWS}),
d as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as x from documents),
w as (select r, doc_id, x, {_words('x')} as w from d),
p as (select r, doc_id, len(w) as n, {_PHRASE_LISTS} from w),
b as (select r, doc_id, n, {_ALL_PLACES} as places, {_BASE} as base from p),
blocks as (select r, list_distinct({_words('block')}) as bw from (select r, unnest(string_split(x, chr(10))) as block from d)),
m as (select r, label, len(list_intersect(bw, tw)) / len(tw) as s from blocks join t on len(list_intersect(bw, tw)) >= {THRESHOLD} * len(tw) - 1e-9),
g as (select r, list(distinct label) as more, max(s) as best from m group by r)
select doc_id, cast(n as bigint) as n_words, cast(len(places) as bigint) as n_base, list_min(places) as first_word,
 list_max(places) as last_word, array_to_string(list_sort(base), ',') as base_labels,
 array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') as labels,
 case when len(places) > 0 then 1.0::double else coalesce(best, 0.0)::double end as score
from b left join g using (r)""",
    "op7_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
w as (select d, max(page_id) as best from p where n >= 1000 group by d)
select page_id, cast(n as bigint) as payload_bytes, p.d as payload_digest,
 case when best is null or best = page_id then 'response' else 'revisit' end as record_type,
 case when best <> page_id then best end as refers_to
from p left join w on p.d = w.d and p.n >= 1000""",
    "op10_exact_top_k": """
with v as (select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
           where vec_id is not null and embedding is not null
           and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum([a[1] * a[2] for a in list_zip(q.e, c.e)]) as bigint) as score
      from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5""",
    "op12_prefix_trie": f"""
with t as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
d as (select c, turn, md5(octet_length(encode(role)) || ':' || role || text) as x, octet_length(encode(text)) as b from t),
own as (select c, list(struct_pack(x := x, b := b) order by turn nulls first, x) as w from d group by c),
h as (select c, w, {_CRC} % 9 as h from own),
r as (select h.c, coalesce(base.w[1:h], []) || h.w[h + 1:len(h.w)] as w from h left join own base on base.c = h.c - h.c % 5),
m as (select c, len(w) as n, u.d as depth, md5(array_to_string([z.x for z in w[1:u.d]], '')) as k,
       case when u.d > 0 then md5(array_to_string([z.x for z in w[1:u.d - 1]], '')) end as up, case when u.d > 0 then w[u.d].b else 0 end as b
      from r, unnest(range(len(w) + 1)) as u(d)),
nodes as (select k, depth, min(c) as conv_id, any_value(up) as up, count(*) as n_convs, any_value(b) as b,
           string_agg(cast(c as varchar), ',' order by c) filter (where n = depth) as ends from m group by k, depth),
kids as (select up as k, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by up, depth),
every as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (k, depth)),
sub as (select m.k, m.depth, count(*) filter (where u.n_children = 0) as n_leaves, sum((u.n_convs - 1) * u.b) as saved_tokens
        from every u join m on m.c = u.conv_id and m.depth <= u.depth group by m.k, m.depth)
select v.conv_id, v.depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens,
 sha256(coalesce(v.ends, '')) as ends_sha256
from every v join sub using (k, depth) left join every p on p.k = v.up and p.depth = v.depth - 1""",
    "op13_ranked_search": f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') as w from documents),
size as (select count(*) as docs, sum(len(w)) as terms from d where len(w) > 0),
tf as (select r, any_value(doc_id) as doc_id, any_value(len(w)) as n, term, count(*) as tf from (select r, doc_id, w, unnest(w) as term from d) group by r, term),
weights as (select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * count(*) + 1))) as bigint) as weight from tf, size group by term, docs),
i as (select item_id, unnest(regexp_extract_all(translate(coalesce(min(text), ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) as term from benchmark group by item_id),
s as (select item_id, r, any_value(doc_id) as doc_id,
       sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + cast((75 * n * docs) // terms as bigint))))) as score
      from i join tf using (term) join weights using (term), size group by item_id, r),
k as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from k where rank <= 10""",
}
