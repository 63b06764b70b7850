"""SQL twins of the queries that SQL can express, over the same tables (DuckDB)."""

from __future__ import annotations

from grantstar.llm.curriculum import MAX_REPEATS, SCHEDULES, Schedule, integral
from grantstar.llm.line_quality import STRICT, LineLimits

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _line_frequency(limits: LineLimits = LineLimits()) -> str:
    norm = r"trim(lower(regexp_replace(line, '[\x09-\x0D]', ' ', 'g')), ' ')"
    return f"""
with d as (select doc_id, source, coalesce(text, '') as text, {_WORDS} as w from documents),
l as (
  select doc_id, source, text, line, {norm} as norm
  from (select doc_id, source, text, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]')
),
hosts as (select source, count(*) as of from d group by source),
frequent as (
  select source, norm from (
    select source, norm, count(distinct doc_id) as docs, count(distinct text) as texts from l group by source, norm)
  join hosts using (source)
  where texts >= {limits.least} and (docs > {limits.share} * hosts.of or docs >= {limits.most})
),
dup as (
  select doc_id, count(*) - count(distinct line) as n_dup_lines from l group by doc_id
),
gone as (
  select doc_id, sum(len(regexp_extract_all(norm, '[^ ]+'))) as removed_words
  from l join frequent using (source, norm) group by doc_id
),
windows as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)
),
places as (
  select doc_id, i, lead(i) over (partition by doc_id order by i) as follower
  from (select doc_id, i, count(*) over (partition by doc_id, g) as times from windows) where times > 1
),
covered as (
  select doc_id, sum(least(3, coalesce(follower - i, 3))) as n_repeat_words from places group by doc_id
),
m as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    coalesce(removed_words, 0)::bigint as removed_words
  from d left join dup using (doc_id) left join gone using (doc_id) left join covered using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
    and n_words - removed_words >= {limits.left_words}
    and n_words - removed_words >= {limits.left_share} * n_words as kept,
  removed_words
from m"""


_BLOOM_DEDUP = f"""
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')) as text_sha256
  from documents
),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)"""


def _time(schedule: Schedule, share: str) -> str:
    whole, below, cases = integral(schedule), 0.0, ""
    for (a, v), (b, w) in zip(schedule, schedule[1:]):
        piece = (b - a) * (v + w) / 2 / whole
        g, slope = v / whole, (w - v) / whole / (b - a)
        rest = f"({share} - {below!r})"
        cases += (
            f" when {share} < {below + piece!r} then {a!r} + 2 * {rest}"
            f" / ({g!r} + sqrt(greatest({g * g!r} + 2 * {slope!r} * {rest}, 0)))"
        )
        below += piece
    return f"case{cases} else 1.0 end"


def _curriculum() -> str:
    n = len(SCHEDULES)
    weights = ", ".join(repr(float(integral(s))) for s in SCHEDULES)
    times = " ".join(f"when {k} then {_time(s, 'share')}" for k, s in enumerate(SCHEDULES))
    return f"""
with d as (
  select doc_id, source, len({_WORDS})::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as turned
  from documents
),
s as (
  select source, sum(size)::bigint as source_size,
    ((row_number() over (order by source nulls last) - 1) % {n})::int as turn
  from d group by source
),
w as (select *, [{weights}][turn + 1] as weight, {MAX_REPEATS}.0 * source_size as most from s),
v as (
  select *, (sum(source_size) over () - coalesce(sum(most) over (
      order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
    / sum(weight) over (
      order by most / weight, source nulls last rows between current row and unbounded following) as level
  from w
),
t as (
  select source, source_size, turn, case when most < weight * level then most
    else weight * (select arg_min(level, most / weight) from v where not most < weight * level) end as target
  from v
),
p as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as passes from t
),
o as (
  select d.doc_id, d.size, p.source_size, p.target, p.turn, p.passes, p.target - p.passes * p.source_size as rest,
    coalesce(sum(d.size) over (partition by d.source order by turned, doc_id, size
      rows between unbounded preceding and 1 preceding), 0) as ahead
  from d join p on d.source is not distinct from p.source
),
c as (
  select *, passes + (ahead + size / 2 < rest)::bigint as copies,
    case when target > 0 then least(ahead / target, 1.0) else 0.0 end as share
  from o
)
select doc_id, size, source_size, round(target, 6) as target, copies, copies * size as taken,
  round(case when copies > 0 then case turn {times} end end, 6) as position
from c"""


def _crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    byte = "list_reduce([xor(acc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {codes}), lambda acc, c: {byte}), 4294967295)"


def _counted(column: str) -> str:
    return f"coalesce(strlen({column}::varchar) || ':' || {column}::varchar, '-')"


def _merkle() -> str:
    def leaf(text: str) -> str:
        parts = [_counted(c) for c in ("doc_id", "source", "lang", "n_chars")]
        return f"sha256({' || '.join(parts)} || {_counted(text)})"

    up = """list_transform(range(0, (len(d) + 2) // 3),
      lambda j: sha256(array_to_string(list_slice(d, 3 * j + 1, 3 * j + 3), '')))"""
    return f"""
with recursive leaves as (
  select doc_id, source, {leaf("text")} as leaf, {leaf("replace(text, chr(10), '')")} as without,
    {_crc32("doc_id::varchar")} % 2 = 0 as changed
  from documents
),
p as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from leaves
),
g as (select source, list(leaf order by i) as d from p group by source),
t as (
  select source, 0 as level, d from g
  union all
  select source, level + 1, {up} from t where len(d) > 1
),
subroots as (select source, level as height, d[1] as subroot from t where len(d) = 1),
ranked as (select *, row_number() over (order by source nulls first) - 1 as r from subroots),
u as (
  select 0 as level, (select list(subroot order by r) from ranked) as d
  union all
  select level + 1, {up} from u where len(d) > 1
),
steps as (
  select p.doc_id, p.leaf, p.i, t.level as step, p.i // (3::bigint ** t.level)::bigint as j, t.d
  from p join t on p.source is not distinct from t.source where len(t.d) > 1
  union all
  select p.doc_id, p.leaf, p.i, ranked.height + u.level, ranked.r // (3::bigint ** u.level)::bigint, u.d
  from p join ranked on p.source is not distinct from ranked.source, u where len(u.d) > 1
),
sided as (
  select doc_id, leaf, i, step, array_to_string(list_slice(d, j // 3 * 3 + 1, j), '') as a,
    array_to_string(list_slice(d, j + 2, j // 3 * 3 + 3), '') as b
  from steps
),
paths as (
  select doc_id, leaf, i, list([a, b] order by step) as path from sided group by all
),
folded as (
  select p.*, coalesce(path, []) as path,
    list_reduce(list_concat([[case when changed then without else p.leaf end]], coalesce(path, [])),
      lambda x, s: [sha256(s[1] || x[1] || s[2])])[1] as folded_root
  from p left join paths on p.doc_id is not distinct from paths.doc_id and p.leaf = paths.leaf and p.i = paths.i
)
select doc_id, leaf, subroot, (select d[1] from u where len(d) = 1) as root,
  sha256(array_to_string(flatten(path), '')) as proof_sha256, folded_root,
  folded_root = (select d[1] from u where len(d) = 1) as verified
from folded join ranked on folded.source is not distinct from ranked.source"""


def _periodic_runs() -> str:
    return f"""
with d as (select doc_id, {_WORDS} as w, {_crc32("doc_id::varchar")} as h from documents),
a as (select *, len(w) as n, h // 10 as g, case when len(w) > 0 then (h // 10) % len(w) end as a from d),
q as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
x as (
  select doc_id, n, case when h % 10 = 0 and n > 0
    then list_transform(range(0, n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end])
    else w end as w
  from q
),
grams as (
  select doc_id, n, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] as gram
  from (select doc_id, n, w, unnest(range(0, n - 3)) as i from x)
),
pairs as (
  select l.doc_id, l.i, r.i - l.i as period from grams l join grams r
  on l.doc_id = r.doc_id and l.gram = r.gram and r.i > l.i and 4 * (r.i - l.i) <= l.n
),
islands as (
  select doc_id, period, min(i) as start, count(*) + 3 + period as length
  from (select *, i - row_number() over (partition by doc_id, period order by i) as island from pairs)
  group by doc_id, period, island
),
runs as (
  select doc_id, start, length, min(period) as period from islands
  where length >= greatest(6, 4 * period) group by doc_id, start, length
),
per as (
  select doc_id, count(*) as n_runs, string_agg(concat_ws(',', start, length, period) || chr(10), '' order by start, period) as text,
    list([start + period, start + length]) as gone
  from runs group by doc_id
),
best as (
  select distinct on (doc_id) doc_id, start, length, period from runs r where not exists (
    select 1 from runs o where o.doc_id = r.doc_id and o.length * r.period > r.length * o.period
  ) order by doc_id, start, period
)
select x.doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli,
  sha256(coalesce(text, '')) as runs_sha256,
  sha256(array_to_string(case when gone is null then w else list_transform(
    list_filter(range(0, n), lambda i: len(list_filter(gone, lambda s: i >= s[1] and i < s[2])) = 0),
    lambda i: w[i + 1]) end, ' ')) as collapsed_sha256
from x left join per using (doc_id) left join best using (doc_id)"""


ORACLES: dict[str, str] = {
    "op1_line_frequency": _line_frequency(),
    "strict_line_frequency": _line_frequency(STRICT),
    "op4_bloom_dedup": _BLOOM_DEDUP,
    "op7_curriculum": _curriculum(),
    "op11_merkle_proofs": _merkle(),
    "op12_periodic_runs": _periodic_runs(),
}
