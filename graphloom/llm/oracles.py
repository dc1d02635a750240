"""SQL (DuckDB) with the same results as the operators' queries, where SQL can express them.

Brute force over whole tables: all pairs, all windows, recursive reachability.
"""

from __future__ import annotations

from . import licenses

#: A-Z to a-z and nothing else.
_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(links: str, nodes: str) -> str:
    """CTEs ``reach(id, low)`` from ``links(a, b)`` (both directions) and ``nodes(id)``: the smallest id reachable."""
    return f"""
    walk(id, node) as (select id, id from ({nodes}) union select w.id, l.b from walk w join ({links}) l on l.a = w.node),
    reach as (select id, min(node) as low from walk group by id)"""


JACCARD = f"""
with recursive
words as (select doc_id, list_filter(regexp_split_to_array({_LOWER.format(x="coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
grams as (
  select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from words),
sets as (select distinct doc_id, g from grams),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select c.a, c.b from common c join sizes x on x.doc_id = c.a join sizes y on y.doc_id = c.b where 100 * c.c >= 80 * (x.n + y.n - c.c)),
{_components("select a, b from links", "select doc_id as id from documents")}
select d.doc_id, coalesce(s.n, 0) as n_shingles, r.low as component_id
from documents d left join sizes s on s.doc_id = d.doc_id join reach r on r.id = d.doc_id
"""

EMBEDDINGS = f"""
with recursive
good as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.98),
{_components("select a, b from links", "select vec_id as id from embeddings")}
select e.vec_id, (select count(*) from links l where l.a = e.vec_id) as n_links, r.low as component_id, e.vec_id = r.low as kept
from embeddings e join reach r on r.id = e.vec_id
"""


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def license_sql() -> str:
    """Base counts, votes, merged diagonals and labels."""
    k, gap = licenses.K, licenses.GAP
    separators = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    split = lambda x: f"list_filter(regexp_split_to_array({_LOWER.format(x=x)}, '{separators}'), lambda x: x <> '')"
    templates = ", ".join(f"({_text(n)}, {_text(b)})" for n, b in sorted(licenses.TEMPLATES.items()))
    phrases = " union all ".join(
        f"select doc_id, p - 1 as place, '{label}' as label from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from words where list_has_all(w, {phrase.split()!r})) where " + " and ".join(f"w[p + {j}] = '{x}'" for j, x in enumerate(phrase.split()))
        for phrase, label in licenses.PHRASES.items()
    )
    return f"""
with words as (select doc_id, {split("coalesce(text, '')")} as w from documents),
base as ({phrases}),
places as (select doc_id, count(*) as n, min(place) as low, max(place) as high, list(distinct label) as labels from base group by doc_id),
t_words as (select name, {split("body")} as w from (values {templates}) as t(name, body)),
t_grams as (select name, len(w) as size, i - 1 as t_pos, array_to_string(w[i:i + {k - 1}], ' ') as g from (select name, w, unnest(range(1, len(w) - {k - 2})) as i from t_words)),
d_grams as (select doc_id, i - 1 as pos, array_to_string(w[i:i + {k - 1}], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - {k - 2})) as i from words)),
votes as (select doc_id, name, size, t_pos, pos - t_pos as diagonal from d_grams join t_grams using (g)),
steps as (select *, case when diagonal - lag(diagonal) over (partition by doc_id, name order by diagonal) <= {gap} then 0 else 1 end as step from (select distinct doc_id, name, diagonal from votes)),
clusters as (select doc_id, name, diagonal, sum(step) over (partition by doc_id, name order by diagonal) as cluster from steps),
covered as (select distinct doc_id, name, size, cluster, unnest(range(t_pos, t_pos + {k})) as p from votes join clusters using (doc_id, name, diagonal)),
shares as (select doc_id, name, count(*) / size as share from covered group by doc_id, name, size, cluster),
best as (select doc_id, max(share) as score, list(distinct name) filter (share >= {licenses.COVERAGE}) as found from shares group by doc_id)
select w.doc_id, len(w.w) as n_words, coalesce(p.n, 0) as n_base, p.low as first_word, p.high as last_word,
  coalesce(array_to_string(list_sort(p.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(p.labels, []), coalesce(b.found, [])))), ','), '') as labels,
  cast(coalesce(b.score, 0) as double) as score
from words w left join places p on p.doc_id = w.doc_id left join best b on b.doc_id = w.doc_id
"""


def mixing_sql(period: int, block: int) -> str:
    """Numbering by doc_id, quanta, phases, and earliest deadline first slot by slot in a recursive query."""
    return f"""
with recursive
numbered as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as index from documents),
counts as (select source, count(*) as n from documents group by source),
sources as (
  select source, greatest(1, cast(round(sqrt(n) / (select sum(sqrt(n)) from counts) * {period}) as int)) as quanta, n from counts),
ended as (select source, quanta, cast(ceil(ceil(n / {block}) / quanta) as bigint) as periods from sources),
phases as (
  select row_number() over (order by until) - 1 as phase, coalesce(lag(until) over (order by until), 0) as since, until from (select distinct periods as until from ended)),
active as (select phase, since, until, source, quanta, row_number() over (partition by phase order by source) - 1 as i from phases join ended on periods > since),
slots as (select phase, since, until, sum(quanta) as slots from active group by all),
starts as (select *, coalesce(sum((until - since) * slots) over (order by phase rows between unbounded preceding and 1 preceding), 0) as before from slots),
lists as (select phase, any_value(slots) as total, list(quanta order by i) as q, list(source order by i) as names from active join slots using (phase) group by phase),
run(phase, total, q, names, t, c, picked, k) as (
  select phase, total, q, names, 0, list_transform(q, lambda x: 0), -1, -1 from lists
  union all
  select phase, total, q, names, t + 1, list_transform(range(1, len(q) + 1), lambda j: c[j] + case when j = p then 1 else 0 end), p, c[p]
  from (
    select *, list_sort(list_transform(list_filter(range(1, len(q) + 1), lambda j: c[j] < q[j] and (c[j] * total) // q[j] <= t), lambda j: {{'d': ((c[j] + 1) * total + q[j] - 1) // q[j], 'j': j}}))[1].j as p
    from run where t < total)),
template as (select phase, total, names[picked] as source, k as nth, t - 1 as at from run where picked > 0),
blocks as (select n.doc_id, n.source, n.index, n.index // {block} as block, n.index % {block} as "offset", e.quanta from numbered n join ended e on n.source is not distinct from e.source),
placed as (select b.*, b.block // b.quanta as p, b.block % b.quanta as nth from blocks b)
select p.doc_id, p.source, p.index, p.block, p."offset", s.phase, s.before + (p.p - s.since) * s.slots + t.at as slot, p.quanta, s.slots as phase_slots,
  s.before + (p.p - s.since) * s.slots + (p.nth * s.slots) // p.quanta as release, s.before + (p.p - s.since) * s.slots + ((p.nth + 1) * s.slots + p.quanta - 1) // p.quanta as deadline
from placed p join starts s on p.p >= s.since and p.p < s.until join template t on t.phase = s.phase and t.source is not distinct from p.source and t.nth = p.nth
"""
