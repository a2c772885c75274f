"""SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from engrama.llm.chat_trie import CONTROL, MARKS
from engrama.llm.feistel_sharding import PRIME, ROUNDS, Permutation
from engrama.llm.quality_ledger import POLICIES, RULE_BITS

PLAIN = r"[^\x20\x09-\x0D]+"
NORMAL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _count(characters: str) -> str:
    return f"length(t) - length(translate(t, '{characters}', ''))"


_RULES = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbol_heavy": "10 * n_symbols > 3 * n_words",
    "shouting_marks": "10 * n_marks > 3 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "few_letters": "10 * n_letters < 4 * word_chars",
    "stuttered_words": "10 * n_stutters > 3 * n_words",
}
_LEDGER = rf"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{PLAIN}') as w from documents),
win as (select doc_id, i, count(*) over (partition by doc_id, k) as c from (select doc_id, i, list_slice(w, i, i + 7) as k from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8))),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from win where c > 1) group by 1),
st as (select doc_id, count(*) as n from (select doc_id, w, unnest(range(2, len(w) + 1)) as i from d) where w[i] = w[i - 1] group by 1),
li as (select doc_id, count(*) as n, count(*) - count(distinct l) as dup from (select doc_id, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '{PLAIN}') group by 1),
m as (select d.doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars, {_count('#*$%&|<>')} as n_symbols, {_count('!?')} as n_marks, length(t) - length(regexp_replace(t, '\p{{L}}+', '', 'g')) as n_letters,
  coalesce(li.n, 0) as n_lines, coalesce(li.dup, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, coalesce(st.n, 0) as n_stutters from d left join rep on rep.doc_id = d.doc_id left join st on st.doc_id = d.doc_id left join li on li.doc_id = d.doc_id),
b as (select *, cast({' + '.join(f'case when {_RULES[r]} then {1 << bit} else 0 end' for r, bit in RULE_BITS.items())} as bigint) as failure_bits from m)"""
OP4 = rf"""{_LEDGER}
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, failure_bits = 0 as kept, failure_bits from b"""

_RULES_OF = ", ".join(f"('{p.name}', {p.version}, {p.mask}::bigint, '{r}', {1 << RULE_BITS[r]}::bigint)" for p in POLICIES for r in p.rules)
ABLATIONS = rf"""{_LEDGER}, p as (select * from (values {_RULES_OF}) v(policy, version, mask, rule, bit))
select policy, version, rule, count(*) as documents, count(*) filter (where failure_bits & mask = 0) as kept, count(*) filter (where failure_bits & bit <> 0) as failing, count(*) filter (where failure_bits & mask = bit) as failing_alone,
  count(*) filter (where failure_bits & mask & ~bit = 0) as kept_without, bit_or(case when failure_bits & mask <> 0 then failure_bits else 0 end) as bits_seen from b cross join p group by policy, version, rule"""

_NORMAL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '{NORMAL}')"
OP5 = rf"""
with b as (select cast(item_id as varchar) as item, {_NORMAL_WORDS} as w from benchmark),
win as (select item, list_slice(w, i, i + 9) as k from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
lens as (select distinct len(k) as n from win),
d as (select doc_id, {_NORMAL_WORDS} as w from documents),
dw as (select doc_id, i, n, list_slice(w, i, i + n - 1) as k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d join lens on len(w) >= n)),
hits as (select dw.doc_id, dw.i, dw.n, win.item from dw join win on dw.k = win.k),
words as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + n)) as p from hits) group by 1),
items as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as l from (select distinct doc_id, item from hits) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(words.n, 0) as bigint) as n_hit, cast(coalesce(items.n, 0) as bigint) as n_items, sha256(coalesce(items.l, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
from d left join words on words.doc_id = d.doc_id left join items on items.doc_id = d.doc_id"""

OP6 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
win as (select doc_id, i, count(*) over (partition by k) as c from (select doc_id, i, md5(substr(h, 2 * i - 1, 800)) as k from (select doc_id, h, unnest(range(1, n - 398)) as i from d where n >= 400))),
fresh as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > 400, true) as f from win where c > 1),
numbered as (select doc_id, i, sum(case when f then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) as run from fresh),
runs as (select doc_id, min(i) as a, max(i) + 399 as b from numbered group by doc_id, run),
pieces as (select r.doc_id, coalesce(lag(r.b) over (partition by r.doc_id order by r.a), 0) + 1 as a, r.a - 1 as b from runs r union all select d.doc_id, coalesce(max(r.b), 0) + 1, max(d.n) from d left join runs r on r.doc_id = d.doc_id group by 1),
kept as (select p.doc_id, string_agg(substr(d.h, cast(2 * p.a - 1 as bigint), cast(2 * (p.b - p.a + 1) as bigint)), '' order by p.a) as l from pieces p join d on d.doc_id = p.doc_id where p.b >= p.a group by 1),
n as (select doc_id, sum(b - a + 1) as gone, count(*) as spans from runs group by 1)
select d.doc_id, cast(d.n as bigint) as n_bytes, cast(coalesce(n.gone, 0) as bigint) as n_removed, cast(coalesce(n.spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept.l, ''))) as kept_sha256 from d left join n on n.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id"""

OP7 = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{PLAIN}') as w from documents),
win as (select doc_id, i, count(*) over (partition by k) as c from (select doc_id, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) as k from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35))),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 35)) as p from win where c > 1)),
words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
kept as (select words.doc_id, string_agg(x, ' ' order by words.p) as l from words left join gone on gone.doc_id = words.doc_id and gone.p = words.p where gone.p is null group by 1),
n as (select doc_id, count(*) as n, count(*) filter (where f) as spans from (select doc_id, p, p - lag(p, 1, -1) over (partition by doc_id order by p) <> 1 as f from gone) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n.n, 0) as bigint) as n_removed, cast(coalesce(n.spans, 0) as bigint) as n_spans, sha256(coalesce(kept.l, '')) as kept_sha256 from d left join n on n.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id"""


def _escaped() -> str:
    out = r"replace(text, '\', '\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP2 = f"""
with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn)) as turns_sha256, cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256, cast(sum(length({_escaped()}) + case role {' '.join(f"when '{r}' then {len(a) + len(b)}" for r, (a, b) in MARKS.items())} end) as bigint) as formatted_chars
from c group by conv_id"""


def _sharding(shards: int = 8, key: int = 0) -> str:
    """Row numbers by id; the network and its walk as a recursive query; CRC-32 byte by byte."""

    def mixed(x: str, r: int) -> str:
        p, q, c = Permutation(1, key).constants(r)
        return f"((({x} * {p} + {c}) % {PRIME}) * (({x} * {q} + {p}) % {PRIME})) % {PRIME}"

    def network(source: str) -> str:
        out = f"select id, l, r, a, b, n from {source}"
        for k in range(ROUNDS):
            if k % 2 == 0:
                out = f"select id, (l + {mixed('r', k)}) % a as l, r, a, b, n from ({out})"
            else:
                out = f"select id, l, (r + {mixed('l', k)}) % b as r, a, b, n from ({out})"
        return out

    bit = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    table = "select i, cast(i as bigint) as x from range(256) t(i)"
    for _ in range(8):
        table = f"select i, {bit} as x from ({table})"
    return f"""
with recursive s as (select count(*) as n, cast(floor(sqrt(count(*) - 1)) as bigint) + 1 as a from documents),
walk(id, y, a, b, n) as (
  select id, l * b + r, a, b, n from ({network("(select doc_id as id, cast(k // b as bigint) as l, cast(k % b as bigint) as r, a, b, n from (select doc_id, row_number() over (order by doc_id) - 1 as k from documents) cross join (select n, a, cast(ceil(n / a) as bigint) as b from s))")})
  union all
  select id, l * b + r, a, b, n from ({network("(select id, cast(y // b as bigint) as l, cast(y % b as bigint) as r, a, b, n from walk where y >= n)")})),
crc as (select list(x order by i) as t from ({table})),
bytes as (select doc_id, string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ') as h from documents),
sums as (select doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(list_filter(h, lambda x: x <> ''), lambda x: cast(concat('0x', x) as bigint))), lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1])), 4294967295) as c from bytes cross join crc)
select d.doc_id, cast(strlen(coalesce(text, '')) + 1 as bigint) as size, cast(c as bigint) as text_crc32, 'rows' as law, cast(y % {shards} as integer) as shard, cast(y // {shards} as bigint) as slot, cast(null as integer) as grown_shard
from documents d join walk on walk.id = d.doc_id and walk.y < walk.n join sums on sums.doc_id = d.doc_id"""


def _crc_table() -> str:
    """CRC-32 of each byte, as a query with columns i and x."""
    out = "select i, cast(i as bigint) as x from range(256) t(i)"
    for _ in range(8):
        out = f"select i, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end as x from ({out})"
    return out


OP12 = rf"""
with crc as (select list(x order by i) as t from ({_crc_table()})),
h as (select doc_id, regexp_extract_all(coalesce(text, ''), '{PLAIN}') as w, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))), lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1])), 4294967295) as h from documents cross join crc),
a as (select doc_id, w, len(w) as n, h, h // 10 as g, case when len(w) > 0 then (h // 10) % len(w) else 0 end as a from h),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
d as (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: w[case when i < a then i else a + (i - a) % p end + 1]) else w end as w from p),
periods as (select doc_id, n, w, unnest(range(1, n // 4 + 1)) as q from d where n >= 6),
probes as (select doc_id, q, w, unnest(range(0, (n - 1) // q)) as j from periods),
hits as (select doc_id, q, j from probes where w[j * q + 1] = w[(j + 1) * q + 1]),
threes as (select distinct doc_id, q from (select doc_id, q, j, lead(j, 2) over (partition by doc_id, q order by j) as k from hits) where k = j + 2),
same as (select doc_id, q, i from (select doc_id, q, w, unnest(range(0, n - q)) as i from threes join d using (doc_id)) where w[i + 1] = w[i + q + 1]),
islands as (select doc_id, q, min(i) as s, count(*) + q as l from (select *, i - row_number() over (partition by doc_id, q order by i) as f from same) group by doc_id, q, f),
runs as (select doc_id, s, l, min(q) as q from islands where l >= greatest(6, 4 * q) group by doc_id, s, l),
gone as (select distinct doc_id, unnest(range(s + q, s + l)) as i from runs),
words as (select doc_id, unnest(w) as x, unnest(range(n)) as i from d),
kept as (select doc_id, string_agg(x, ' ' order by i) as c from (select words.* from words anti join gone on gone.doc_id = words.doc_id and gone.i = words.i) group by 1),
told as (select doc_id, count(*) as n, string_agg(concat(s, ',', l, ',', q, chr(10)), '' order by s, q) as t from runs group by 1),
best as (select * from runs qualify row_number() over (partition by doc_id order by l desc, s, q) = 1)
select d.doc_id, cast(coalesce(told.n, 0) as bigint) as n_runs, cast(best.s as bigint) as start, cast(best.l as bigint) as length, cast(best.q as bigint) as period, cast(1000 * best.l // best.q as bigint) as exponent_milli, sha256(coalesce(told.t, '')) as runs_sha256, sha256(coalesce(kept.c, '')) as collapsed_sha256
from d left join told on told.doc_id = d.doc_id left join best on best.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id"""

def _codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Every part against every entry, in each round."""

    def assigned(r: int) -> str:
        return f"""n{r} as materialized (select vec_id, part, entry, d from (select x.vec_id, x.part, b.entry, sum((x.c - b.c) * (x.c - b.c)) as d from x join b{r} b on b.part = x.part and b.pos = x.pos group by 1, 2, 3) qualify row_number() over (partition by vec_id, part order by d, entry) = 1)"""

    def moved(r: int) -> str:
        return f"""b{r + 1} as materialized (select b.part, b.entry, b.pos, coalesce(m.c, b.c) as c from b{r} b left join (select n.part, n.entry, x.pos, cast(floor(sum(x.c) / count(*)) as bigint) as c from n{r} n join x on x.vec_id = n.vec_id and x.part = n.part group by 1, 2, 3) m on m.part = b.part and m.entry = b.entry and m.pos = b.pos)"""

    steps = ",\n".join(f"{assigned(r)},\n{moved(r)}" for r in range(rounds))
    return f"""
with k as (select vec_id, label, embedding as e, len(embedding) // {parts} as w from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
x as materialized (select vec_id, (i // w) as part, i % w as pos, cast(floor(cast(e[i + 1] as double) * {scale}) as bigint) as c from (select vec_id, e, w, unnest(range(len(e))) as i from k)),
f as (select vec_id, row_number() over (order by vec_id) - 1 as entry from k qualify row_number() over (order by vec_id) <= {entries}),
b0 as materialized (select x.part, f.entry, x.pos, x.c from x join f on f.vec_id = x.vec_id),
{steps},
{assigned(rounds)},
c as (select vec_id, string_agg(printf('%02x', cast(entry as integer)), '' order by part) as code, cast(sum(d) as bigint) as error from n{rounds} group by 1),
h as (select sha256(string_agg(cast(c as varchar), ',' order by part, entry, pos)) as codebooks_sha256 from b{rounds})
select c.vec_id, c.code, c.error, cast(sum(c.error) over (partition by k.label) as bigint) as label_error, h.codebooks_sha256 from c join k on k.vec_id = c.vec_id cross join h"""


OP13 = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '{PLAIN}') as w from documents),
s as materialized (select doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')))) as t from d where len(w) > 0),
n as materialized (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.t = b.t and a.doc_id <> b.doc_id group by 1, 2),
l as materialized (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on l.a = r.b),
m as (select a, min(b) as b from r group by 1)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) as component_id from d left join n on n.doc_id = d.doc_id left join m on m.a = d.doc_id"""

OP8 = _sharding()
OP11 = _codes()
ORACLES = {"op2_prefix_forest": OP2, "op4_rule_ledger": OP4, "rule_ablations": ABLATIONS, "op5_prefix_join": OP5, "op6_bwt_merge": OP6, "op7_suffix_automata": OP7, "op8_feistel_shards": OP8, "op11_vafile_codes": OP11, "op12_periodic_runs": OP12, "op13_ngram_join": OP13}
