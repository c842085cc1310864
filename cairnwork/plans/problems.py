"""Problems 1 to 5 in the catalogue, with the SQL that tells the same."""

from __future__ import annotations

from cairnwork.plans import campaign, capability
from cairnwork.plans.registry import register
from cairnwork.plans.registry import sql_normal_form as nf


def _live(t: str) -> str:
    return f"""select k as cap_key, v.status as status, v.crate as crate from (
      select {nf("key")} k, max({{'s': synced_at, 'status': {nf("status")}, 'crate': {nf("target_crate")}, 'd': deleted_at}}) v from {t} group by 1)
      where k is not null and v.d is null"""


_P1 = f"""
with a as ({_live("canonical_capability")}), b as ({_live("canonical_capability_replica")}),
j as (select coalesce(a.cap_key, b.cap_key) cap_key, a.cap_key ka, b.cap_key kb, a.status sa, b.status sb, a.crate ca, b.crate cb from a full join b on a.cap_key = b.cap_key)
select cap_key, 'only_primary' as finding from j where kb is null
union all select cap_key, 'only_replica' from j where ka is null
union all select cap_key, 'status' from j where ka is not null and kb is not null and sa is distinct from sb
union all select cap_key, 'target_crate' from j where ka is not null and kb is not null and ca is distinct from cb
"""

_P2 = f"""
with raw as (select {nf("canonical_key")} k, override_id o, {nf("status")} s, {nf("blocker")} b, trim(set_at) t from canonical_status_override),
shaped as (select *, case
    when regexp_matches(t, '^\\d{{13}}$') then make_timestamp(t::bigint * 1000)
    when regexp_matches(t, '^\\d{{10}}$') then make_timestamp(t::bigint * 1000000)
    when regexp_matches(t, '^[A-Z][a-z]{{2}}, ') then try_strptime(t, '%a, %d %b %Y %H:%M:%S GMT')
    else try_cast(regexp_replace(replace(regexp_extract(t, '^[0-9/-]{{10}}([T ][0-9:.]+)?'), '/', '-'), 'T', ' ') as timestamp)
      - coalesce(try_cast(regexp_extract(t, 'T.*([+-])\\d\\d:?\\d\\d$', 1) || '1' as int), 1)
        * (coalesce(try_cast(regexp_extract(t, 'T.*[+-](\\d\\d):?\\d\\d$', 1) as int), 0) * interval 1 hour + coalesce(try_cast(regexp_extract(t, 'T.*[+-]\\d\\d:?(\\d\\d)$', 1) as int), 0) * interval 1 minute)
  end as ts from raw where k is not null),
one as (select k, epoch_us(ts) us, s, b from shaped where ts is not null qualify row_number() over (partition by k, ts order by o desc) = 1),
stepped as (select *, row_number() over w as rn, lag(s) over w ps, lag(b) over w pb from one window w as (partition by k order by us)),
changed as (select * from stepped where case when s is null then ps is not null when rn = 1 or ps is null then true else s <> ps or b is distinct from pb end),
ended as (select k, us, s, b, lead(us) over (partition by k order by us) nxt from changed)
select k as cap_key, us as valid_from_us, coalesce(nxt, -1) as valid_to_us from ended where s is not null
"""

_P4_BASE = """
with recursive files as (select feed, file_no, lead(file_no) over (partition by feed order by file_no) nxt from (select distinct feed, file_no from campaign_record)),
ok as (select feed, file_no, payload::json p from campaign_record where json_valid(payload) and json_type(payload) = 'OBJECT'),
keyed as (select feed, file_no, p->>'donor' donor, p, unnest(json_keys(p)) field from ok),
val as (select feed, file_no, donor, field, json_extract(p, '$."' || field || '"') v from keyed),
typed as (select *, case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end t from val where json_type(v) <> 'NULL'),
sch as (select feed, file_no, field, string_agg(distinct t, '+' order by t) t from typed group by all),
old as (select s.feed, f.nxt file_no, s.field, s.t from sch s join files f using (feed, file_no) where f.nxt is not null),
fst as (select feed, min(file_no) m from files group by 1),
side as (select coalesce(n.feed, o.feed) feed, coalesce(n.file_no, o.file_no) file_no, coalesce(n.field, o.field) field, o.t ot, n.t nt from sch n full join old o on n.feed = o.feed and n.file_no = o.file_no and n.field = o.field),
ch as (select side.* from side join fst using (feed) where file_no > m),
gv as (select c.feed, c.file_no, c.field, t.donor, t.v::varchar v from ch c join files f on f.feed = c.feed and f.nxt = c.file_no join typed t on t.feed = c.feed and t.file_no = f.file_no and t.field = c.field where c.nt is null),
cv as (select c.feed, c.file_no, c.field, t.donor, t.v::varchar v from ch c join typed t using (feed, file_no, field) where c.ot is null),
ren as (select g.feed, g.file_no, g.field o, c.field n from gv g join cv c using (feed, file_no, donor) group by all having bool_and(g.v = c.v))"""
_P4 = _P4_BASE + """
select feed, file_no::int as file_no, o || '>' || n as field, 'renamed' as change from ren
union all select feed, file_no::int, field, 'retyped' from ch where ot <> nt
union all select feed, file_no::int, field, 'removed' from ch where nt is null and not exists (select 1 from ren where ren.feed = ch.feed and ren.file_no = ch.file_no and ren.o = ch.field)
union all select feed, file_no::int, field, 'added' from ch where ot is null and not exists (select 1 from ren where ren.feed = ch.feed and ren.file_no = ch.file_no and ren.n = ch.field)
"""

_P4_COLUMNS = _P4_BASE + """,
r1 as (select feed, file_no, min(o) o, n from (select feed, file_no, o, min(n) n from ren group by all) group by feed, file_no, n),
came as (select feed, file_no, n field from r1 union select feed, file_no, field from ch where ot is null and not exists (select 1 from ren where ren.feed = ch.feed and ren.file_no = ch.file_no and ren.n = ch.field)),
run as (select r1.feed, r1.o, (select max(c.file_no) from came c where c.feed = r1.feed and c.field = r1.o and c.file_no < r1.file_no) since, r1.n, r1.file_no upto from r1),
way as (select feed, o, since, n label, upto, 1 d from run union all select w.feed, w.o, w.since, r.n, r.upto, d + 1 from way w join run r on r.feed = w.feed and r.o = w.label and r.since = w.upto),
last as (select feed, o, since, arg_max(label, d) label from way group by all),
here as (select s.feed, s.file_no, s.field, max(c.file_no) since from sch s left join came c on c.feed = s.feed and c.field = s.field and c.file_no <= s.file_no group by all),
lab as (select h.feed, h.file_no, h.field, coalesce(l.label, h.field) label from here h left join last l on l.feed = h.feed and l.o = h.field and l.since is not distinct from h.since),
num as (select *, row_number() over (partition by feed, file_no, label order by field <> label, field) rn from lab)
select feed, file_no::int as file_no, field, case when rn = 1 then label end as column_name from num where field <> label or rn > 1
"""


def _parent(t: str, key: str, ident: str) -> str:
    return f"(select v.i as ref, v.d as d, v.c as created from (select {key} k, arg_max({{'i': {ident}, 'd': deleted_at is not null, 'c': created_at}}, synced_at) v from {t} group by 1))"


def _child(t: str, key: str, ref: str, at: str, typed: str) -> str:
    return f"(select {key} k, {typed} as {ref}, {at}, synced_at from {t})"


def _p5_part(child: str, key: str, ref: str, at: str, parent: str, pkey: str, ident: str, text: bool) -> str:
    typed = nf(ref) if text else f"case when {ref} > 0 then {ref} end"
    pident = nf(ident) if text else ident
    return f"""select '{child}' as child_table, c.k as row_id, '{ref}' as ref_field, case when p.ref is null then 'missing' when p.d then 'deleted' else 'late' end as defect, strftime(c.v.t, '%Y-%m') as period
      from (select k, arg_max({{'r': {ref}, 't': {at}}}, synced_at) v from {_child(child, key, ref, at, typed)} group by 1) c
      left join {_parent(parent, pkey, pident)} p on p.ref = c.v.r where c.v.r is not null and (p.ref is null or p.d or p.created > c.v.t)"""


_P5 = " union all ".join((
    _p5_part("provenance", "link_id", "source_id", "linked_at", "source_capability", "id", "id", False),
    _p5_part("provenance", "link_id", "canonical_id", "linked_at", "canonical_capability", nf("key"), "id", False),
    _p5_part("evolution_score", "score_id", "opportunity_id", "scored_at", "opportunity", nf("id"), "id", True),
    _p5_part("architecture_edge", "id", "to_node", "observed_at", "architecture_node", nf("id"), "id", True),
))

_P2_CHANGES = f"""
with o as ({_live("canonical_capability_replica")}), n as ({_live("canonical_capability")})
select coalesce(o.cap_key, n.cap_key) as cap_key, case when o.cap_key is null then 'added' when n.cap_key is null then 'removed' else 'changed' end as change,
  o.status as old_status, n.status as new_status, o.crate as old_crate, n.crate as new_crate
from o full join n on o.cap_key = n.cap_key where o.cap_key is null or n.cap_key is null or o.status is distinct from n.status or o.crate is distinct from n.crate
"""

_P1_ROWS = f"""
with b as (select {nf("key")} k, {nf("status")} s, {nf("target_crate")} c, 1 w from canonical_capability union all select {nf("key")}, {nf("status")}, {nf("target_crate")}, -1 from canonical_capability_replica),
net as (select k, s, c, sum(w) n from b group by all having sum(w) <> 0),
side as (select k, coalesce(sum(n) filter (n > 0), 0)::bigint l, coalesce(-sum(n) filter (n < 0), 0)::bigint r from net group by 1)
select k as cap_key, l as n_primary, r as n_replica, least(l, r) as n_paired from side
"""

_P2_APPENDED = f"""
with days as (select unnest({list(capability.SNAPSHOTS)!r}::timestamp[]) d, generate_subscripts({list(capability.SNAPSHOTS)!r}, 1) - 1 n),
v as (select d.n, {nf("key")} k, max({{'s': synced_at, 'status': {nf("status")}, 'crate': {nf("target_crate")}, 'x': deleted_at}}) v from canonical_capability c join days d on c.synced_at <= d.d group by all),
alive as (select n, k, v.status st, v.crate cr from v where k is not null and v.x is null),
grid as (select k, days.n, a.k is not null here, a.st, a.cr from (select distinct k from alive) ks cross join days left join alive a using (k, n)),
step as (select *, lag(here) over w ph, lag(st) over w ps, lag(cr) over w pc from grid window w as (partition by k order by n)),
chg as (select *, lead(n) over (partition by k order by n) nxt from step where here is distinct from coalesce(ph, false) or (here and (st is distinct from ps or cr is distinct from pc)))
select k as cap_key, st as status, cr as target_crate, n::bigint as from_snapshot, coalesce(nxt, -1)::bigint as to_snapshot from chg where here
"""

register("p1_found", capability.p1_found, _P1)
register("p1_row_differences", capability.p1_row_differences)
register("p1_row_counts", capability.p1_row_counts, _P1_ROWS)
register("p2_found", capability.p2_found, _P2)
register("p2_history", capability.p2_history, _P2.replace("select k as cap_key, us as", "select k as cap_key, s as status, b as blocker, us as"))
register("p2_snapshot_changes", capability.p2_snapshot_changes, _P2_CHANGES)
register("p2_appended", capability.p2_appended, _P2_APPENDED)
register("p3_found", capability.p3_found)
register("p4_found", campaign.p4_found, _P4)
register("p4_scripts", campaign.p4_scripts)
register("p4_columns", campaign.p4_columns, _P4_COLUMNS)
register("p4_table", campaign.p4_table)
register("p5_found", capability.p5_found, _P5)
register("p5_counts", capability.p5_counts, f"select child_table, ref_field, defect, period, count(*) as n_rows from ({_P5}) group by all")
