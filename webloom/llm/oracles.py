"""DuckDB SQL for the queries of this subpackage."""

from __future__ import annotations

from itertools import permutations

OP9 = r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
), g as (
  select norm, min(doc_id) as keep_id, count(*) as group_size from n group by norm
)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.norm) as text_sha256
from n join g using (norm)
"""


_HEX = "('0x' || substr(md5({text}), 1, 13))::bigint"


def _mix_sql(slots: int = 131072) -> str:
    """Targets by water-filling and words taken by the golden-ratio schedule, over whole tables."""
    h = _HEX.format(text="'mix:' || coalesce(doc_id::varchar, 'null')")
    return rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, {h} as h from documents
), src as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source
), c as (
  select *, [3.0, 1.0, 2.0][1 + (place % 3)::int]::double as w, source_size * 2.0::double as cap from src
), l as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by cap / w, place rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, place rows between current row and unbounded following) as level from c
), t as (
  select source, place, source_size, least(cap, max(case when level * w <= cap then level end) over () * w) as target from l
), k as (
  select greatest(1, ceil(sum(target) / {slots}))::bigint as block, sum(target) as total from t
), n as (
  select block, greatest(1, ceil(total / block))::bigint as slots from k
), b as (
  select place, coalesce(lag(hi) over (order by place), 0) as lo, case when row_number() over (order by place desc) = 1 then 1.0 else hi end as hi
  from (select place, sum(target) over (order by place rows unbounded preceding) / sum(target) over () as hi from t where target > 0)
), u as (
  select i, i * 0.6180339887498949::double - floor(i * 0.6180339887498949::double) as u from (select unnest(range(n.slots)) as i from n)
), z as (
  select place, row_number() over (partition by place order by i) - 1 as k, i from u join b on u >= lo and u < hi
), e as (
  select place, floor(target + 0.5)::bigint as words from t
), have as (
  select e.place, words, count(z.k) as have from e left join z using (place) group by all
), s as (
  select z.place, k, i from z join have using (place), n where k * block < words
  union all
  select place, k, n.slots + k - have from (select place, have, unnest(range(have, (words + block - 1) // block)) as k from have, n), n
), p as (
  select d.doc_id, d.size, d.h, t.place, t.source_size, t.target,
    coalesce(sum(d.size) over (partition by t.place order by d.h, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d join t on d.source is not distinct from t.source
), r as (
  select place, start, lo, least(lo + size, words) as hi, unnest(range(lo // block, (lo + size - 1) // block + 1)) as k, block
  from (select p.*, start + pass * source_size as lo from p, (values (0), (1)) v(pass) where size > 0) join e using (place), n where lo < words
), g as (
  select place, start, sum(greatest(0, least(hi, (k + 1) * block) - greatest(lo, k * block)))::bigint as taken, min(i) as first_slot from r join s using (place, k) where k * block < hi group by all
)
select doc_id, size, source_size, target, case when size > 0 then coalesce(taken, 0) else 0 end::bigint as taken, case when size > 0 then first_slot end as first_slot
from p left join g using (place, start)
"""


def _draws(names: list[tuple[str, float, int]]) -> str:
    return ", ".join(
        "{'d': -ln((" + _HEX.format(text=f"id || ':{name}'") + f"::double + 0.5) / 4503599627370496) / {weight}, 'place': {place}" + "}" for name, weight, place in names
    )


def _tree_sql(shards: int, laid_out: int, out: str, source: str) -> str:
    from webloom.llm.sharding import levels, tree

    sql, at = source, "0"
    for depth, families in enumerate(levels(tree([1.0] * shards, laid_out=laid_out))):
        place, cases = 0, []
        for parent, children in enumerate(families):
            names = [(c.name, c.weight, place + i) for i, c in enumerate(children)]
            place += len(children)
            cases.append(f"when {parent} then list_sort([{_draws(names)}])[1].place")
        column = f"{out}_{depth}" if depth < 2 else out
        sql = f"select *, case {at} {' '.join(cases)} end as {column} from ({sql})"
        at = column
    return sql


def _crc_sql(hx: str) -> str:
    """CRC-32 of the bytes whose hexadecimal digits are the column ``hx``, four bits at a time."""
    table = list(range(16))
    for _ in range(4):
        table = [(v >> 1) ^ 0xEDB88320 if v & 1 else v >> 1 for v in table]
    half = lambda v: f"xor({v} >> 4, ({table}::bigint[])[1 + ({v} & 15)])"
    step = half(half("xor(c, x)"))
    return f"""xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length({hx}) // 2), lambda i: ('0x' || substr({hx}, 1 + 2 * i::int, 2))::bigint)),
          lambda c, x: {step}), 4294967295::bigint)"""


def _shard_sql(shards: int = 40) -> str:
    base = rf"""
      select doc_id, coalesce(doc_id::varchar, 'null') as id, coalesce(text, '') as t,
        hex(encode(coalesce(text, ''))) as hx from documents"""
    sized = rf"""
      select doc_id, id, (length(hx) // 2 + 16)::bigint as size,
        {_crc_sql("hx")} as text_crc32,
        {_HEX.format(text="'slot:' || id")} as h
      from ({base})"""
    placed = _tree_sql(shards + 1, shards, "grown_shard", f"select * from ({_tree_sql(shards, shards, 'shard', sized)})")
    return f"""
select doc_id, size, text_crc32, 'key' as law, shard::int as shard,
  row_number() over (partition by shard order by h, doc_id) - 1 as slot, grown_shard::int as grown_shard
from ({placed})
"""


_FOLDED = r"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5 = f"""
with d as (
  select row_number() over () as r, doc_id, {_FOLDED.format(t="text")} as w from documents
), b as (
  select item_id::varchar as item, {_FOLDED.format(t="text")} as w from benchmark
), bw as (
  select distinct item, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as win, least(13, len(w)) as n
  from (select item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from b where len(w) > 0)
), k as (
  select distinct n from bw
), dw as (
  select r, i, k.n, array_to_string(w[i : i + k.n - 1], ' ') as win from (select r, w, unnest(range(1, len(w) + 1)) as i from d), k where i + k.n - 1 <= len(w)
), m as (
  select dw.r, dw.i, dw.n, bw.item from dw join bw using (n, win)
), h as (
  select r, count(distinct p) as n_hit from (select distinct r, unnest(range(i, i + n)) as p from m) group by r
), t as (
  select r, count(distinct item) as n_items, sha256(string_agg(distinct item, ',' order by item)) as items_sha256 from m group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (r) left join t using (r)
"""

OP4 = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), x as (
  select r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as h from (select r, doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)
), f as (
  select h, min(coalesce(doc_id, 9223372036854775807)) as owner from x group by h
), g as (
  select r, list(distinct p) as gone from (
    select r, unnest(range(i, i + 50)) as p from x join f using (h) where coalesce(doc_id, 9223372036854775807) > owner) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(array_to_string(case when gone is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda k: not list_contains(gone, k)), lambda k: w[k]) end, ' ')) as kept_sha256
from d left join g using (r)
"""

OP1 = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, md5(array_to_string(w[i : i + 2], ' ')) as g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) as i from d where len(w) > 0)
), n as (
  select doc_id, count(*) as n, md5(string_agg(g, '' order by g)) as k from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all
), e as (
  select a, b, x.k as ka, y.k as kb from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)
), r as (
  select doc_id as a, doc_id as b from d union select r.a, e.b from r join e on r.b = e.a
), t as (
  select a as doc_id, count(distinct kb) as n_links from e where ka <> kb group by a
), c as (
  select d.doc_id, n.n, n.k, coalesce(t.n_links, 0) as n_links, min(r.b) as component_id
  from d left join n using (doc_id) left join t using (doc_id) join r on r.a = d.doc_id group by all
), l as (
  select component_id, sum(n_links) // 2 as component_links from (select distinct component_id, k, n_links from c) group by component_id
)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, n_links::bigint as n_links, component_links::bigint as component_links from c join l using (component_id)
"""

def _audit_sql(names: str = "ABCDE") -> str:
    """Every order and step meets every cell of a part: (filters failed as bits) and its counts."""
    steps = []
    for order in permutations(range(len(names))):
        label = "".join(names[k] for k in order)
        steps += [f"('{label}', {step + 1}, {1 << k}, {sum(1 << j for j in order[:step])})" for step, k in enumerate(order)]
    return rf"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), l as (
  select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels where doc_id is not null group by doc_id
), f as (
  select doc_id, part,
    (len(w) < 50)::int + 2 * (100 * list_unique(w) < 65 * len(w))::int + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) over (partition by t), false)::int as bits
  from d
), c as (
  select part, bits, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f left join l using (doc_id) group by all
), s(filter_order, step, this, earlier) as (
  values {", ".join(steps)}
), r as (
  select part, filter_order, step, this,
    sum(case when bits & (earlier | this) = 0 then n else 0 end)::bigint as kept,
    sum(case when bits & this > 0 and bits & earlier = 0 then n else 0 end)::bigint as removed,
    sum(case when bits & this > 0 and bits & earlier > 0 then n else 0 end)::bigint as redundant,
    sum(case when bits = this then n else 0 end)::bigint as unique_fails,
    sum(case when bits & this > 0 and bits & earlier = 0 then good else 0 end)::bigint as good_lost,
    sum(case when bits & this > 0 and bits & earlier = 0 then toxic else 0 end)::bigint as toxic_lost
  from c, s group by all
)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, this)::bigint as shapley
from r
"""


def _merkle_sql() -> str:
    """Levels of the runs by recursion, for langs and then over their roots; each row's proof climbs level by level."""
    text = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
    digest = lambda n: "sha256(" + " || ".join(map(text, ("doc_id", "source", "lang", n, "text"))) + ")"
    return f"""
with recursive d as (
  select doc_id, lang, {digest("n_chars")} as leaf,
    case when {_crc_sql("hex(encode(coalesce(doc_id::varchar, '')))")} % 7 = 0 then {digest("(n_chars + 1)")} else {digest("n_chars")} end as changed
  from documents
), p as (
  select *, row_number() over (partition by lang order by doc_id nulls last, leaf) - 1 as i, count(*) over (partition by lang) as n from d
), t as (
  select lang, 0 as level, i, n, leaf as h from p
  union all
  select lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from t where n > 1 group by lang, level, i // 2, (n + 1) // 2
), s as (
  select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as g, count(*) over () as n from t where n = 1
), u as (
  select 0 as level, g as i, n, subroot as h from s
  union all
  select level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from u where n > 1 group by level, i // 2, (n + 1) // 2
), x as (
  select coalesce(lang, '-') || (lang is null) as k, level, i, n, h from t union all select 'over', level, i, n, h from u
), c as (
  select row_number() over () as r, doc_id, leaf, subroot, coalesce(p.lang, '-') || (p.lang is null) as k, g, 0 as level, p.i, p.n, changed as f, '' as path
  from p join s on p.lang is not distinct from s.lang
), w as (
  select r, k, g, level, i, n, f, path from c
  union all
  select w.r, case when w.n = 1 then 'over' else w.k end, case when w.n = 1 then null else w.g end, case when w.n = 1 then 0 else w.level + 1 end,
    case when w.n = 1 then w.g else w.i // 2 end, case when w.n = 1 then (select max(n) from s) else (w.n + 1) // 2 end,
    case when w.n = 1 then w.f when x.h is null then sha256(w.f) when w.i % 2 = 0 then sha256(w.f || x.h) else sha256(x.h || w.f) end,
    w.path || case when w.n = 1 then '' else coalesce(x.h, '') end
  from w left join x on x.k = w.k and x.level = w.level and x.i = xor(w.i, 1)
  where w.n > 1 or w.g is not null
)
select doc_id, leaf, subroot, root, sha256(w.path) as proof_sha256, w.f as folded_root, w.f = root as verified
from c join (select r, f, path from w where k = 'over' and n = 1) w using (r), (select h as root from u where n = 1)
"""


SQL = {"op12_audit_filters": _audit_sql(), "op13_prove_documents": _merkle_sql(), "op1_join_similar": OP1, "op4_remove_repeats": OP4, "op5_find_contamination": OP5, "op3_mix_sources": _mix_sql(), "op6_shard_documents": _shard_sql(), "op9_exact_duplicates": OP9}
