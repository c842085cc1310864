"""Normal forms, duplicates, snapshot differences, constraints, fronts and quantities over the stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.functions import quantity as Q
from cairnwork.functions import ranks as R
from cairnwork.functions.text import normal_form
from cairnwork.operators import constraints as C
from cairnwork.operators import diff as D
from cairnwork.operators import normalise as N
from cairnwork.operators import skyline as Y
from cairnwork.operators.versions import latest_version
from cairnwork.plans import store as S
from cairnwork.plans.registry import query
from cairnwork.plans.registry import sql_normal_form as nf
from cairnwork.session import table

_PRED = "lower(trim(regexp_replace(trim({}), '[^A-Za-z0-9]+', '_', 'g'), '_'))"


@query(f"with {S.ARCH} select kind, {_PRED.format('kind || evidence_ref')} as predicate, count(*) as n_rows from aedge where evidence_ref is not null group by all")
def normalised_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as facts, their predicates in canonical form."""
    edges = S.architecture(spark, sf_dir)[1].where("evidence_ref is not null")
    facts = N.normalise_facts(edges.select(F.col("id").cast("string").alias("id"), "kind", F.col("src").alias("subject"), F.concat("kind", "evidence_ref").alias("predicate"), F.col("dst").alias("object")))
    return facts.groupBy("kind", "predicate").agg(F.count("*").alias("n_rows"))


@query("select key, count(*) as n_rows from (select distinct * from canonical_capability) where key is not null group by 1 having count(*) > 1")
def exact_duplicates_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows equal in all columns count once; what is left of a key are its versions."""
    return N.drop_exact_duplicates(table(spark, sf_dir, "canonical_capability")).where("key is not null").groupBy("key").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


@query(f"with c as (select {nf('key')} k, {nf('status')} s, {nf('target_crate')} t, count(*) n from canonical_capability where key is not null group by all) select k as cap_key, sum(n)::bigint as n_rows, count(*) filter (s is not null) as n_claims from c where k is not null group by 1 having count(*) filter (s is not null) > 1")
def conflicting_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose versions claim different things; a version without status makes no claim."""
    rows = table(spark, sf_dir, "canonical_capability").select(normal_form(F.col("key")).alias("cap_key"), normal_form(F.col("status")).alias("s"), normal_form(F.col("target_crate")).alias("t"))
    return N.conflicting_claims(rows, "cap_key", ["s", "t"], F.col("s").isNull())


_STEM = "list_aggregate(list_sort(list_transform(list_filter(regexp_split_to_array(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '' and w not in ('the', 'a', 'small')), lambda w: case when length(w) > 3 and ends_with(w, 's') and not ends_with(w, 'ss') then w[:-2] else w end)), 'string_agg', ' ')"


@query(f"select coalesce({_STEM.format('p_name')}, '') as cluster, min(p_partkey) as head, count(*) as n_members, min(p_name) as p_name from part group by 1")
def token_stem_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose names differ only in order, plural and small words."""
    return N.duplicate_clusters(table(spark, sf_dir, "part"), "p_partkey", N.token_stem(F.col("p_name"), ("the", "a", "small")), [], "p_name")


_SYN = {"drop": "remove", "void": "remove", "cancel": "remove", "close": "end", "lock": "end", "archive": "end", "post": "send", "publish": "send", "notify": "send"}
_SYN_SQL = "case w " + " ".join(f"when '{k}' then '{v}'" for k, v in _SYN.items()) + " else w end"


@query(f"with {S.SRC_SQL} select list_aggregate(list_sort(list_transform(list_filter(regexp_split_to_array(trim(regexp_replace(lower(canonical_name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: {_SYN_SQL})), 'string_agg', ' ') as cluster, min(id) as head, count(*) as n_members, max(coalesce(moves_money, 0)) as moves_money, min(canonical_name) as canonical_name from src where canonical_name is not null group by 1")
def synonym_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose names mean the same under a table of verbs."""
    return N.duplicate_clusters(S.sources(spark, sf_dir, "canonical_name", "moves_money"), "id", N.synonym_key(F.col("canonical_name"), _SYN), ["moves_money"], "canonical_name")


_CLASSES = [("(?i)invoice|price|tax|budget|payment", "finance"), ("(?i)ticket|survey|mail", "contact"), ("(?i)api|web|cache|index", "platform")]


@query(f"with {S.SRC_SQL} select case when regexp_matches(canonical_name, '(?i)invoice|price|tax|budget|payment') then 'finance' when regexp_matches(canonical_name, '(?i)ticket|survey|mail') then 'contact' when regexp_matches(canonical_name, '(?i)api|web|cache|index') then 'platform' else 'other' end as class, count(*) as n_rows from src group by 1")
def domain_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pattern that matches gives the class."""
    return S.sources(spark, sf_dir, "canonical_name").groupBy(N.classify(F.col("canonical_name"), _CLASSES, "other").alias("class")).agg(F.count("*").alias("n_rows"))


# ---- snapshots

_CUT = "2025-07-01"
_SNAP = "select file_id, kind, sha256, classification, read_status from (select * from donor_file_census {} qualify row_number() over (partition by file_id order by synced_at desc) = 1)"


@query(f"""with a as ({_SNAP.format(f"where synced_at < timestamp '{_CUT}'")}), b as ({_SNAP.format('')}), j as (select coalesce(a.file_id, b.file_id) file_id, case when a.file_id is null then 'appeared' when b.file_id is null then 'disappeared' when a.kind is distinct from b.kind then 'kind_changed' when b.kind = 'vendor_dir' then null
    when a.sha256 is null or b.sha256 is null then 'content_identity_unavailable' when a.sha256 <> b.sha256 then 'content_digest_differs' end cause, a.classification is distinct from b.classification or a.read_status is distinct from b.read_status drift from a full join b on a.file_id = b.file_id)
  select file_id, case when cause = 'appeared' then 'created' when cause = 'disappeared' then 'deleted' when cause is not null then 'modified' else 'unchanged' end as change, cause, (cause is null and drift) as drift from j where cause is not null or drift""")
def inventory_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file census as it was known half way, and as it is."""
    t = table(spark, sf_dir, "donor_file_census")
    keep = ["kind", "sha256", "classification", "read_status"]
    snap = lambda df: latest_version(df, ["file_id"], "synced_at", keep)
    return D.inventory_delta(snap(t.where(F.col("synced_at") < F.lit(_CUT).cast("timestamp_ntz"))), snap(t), "file_id", "kind", "sha256", "vendor_dir", ["classification", "read_status"])


@query("with a as (select user_id, count(*) n from events where ts < timestamp '2024-01-15' group by 1), b as (select user_id, count(*) n from events where ts >= timestamp '2024-01-15' group by 1) select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.n, 0) as before, coalesce(b.n, 0) as after, coalesce(b.n, 0) - coalesce(a.n, 0) as delta from a full join b on a.user_id = b.user_id where coalesce(b.n, 0) <> coalesce(a.n, 0)")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by user, before and after."""
    t, cut = table(spark, sf_dir, "events"), F.lit("2024-01-15").cast("timestamp_ntz")
    return D.count_delta(t.where(F.col("ts") < cut), t.where(F.col("ts") >= cut), "user_id")


def _entities(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    t = table(spark, sf_dir, name).select(normal_form(F.col("key")).alias("k"), normal_form(F.col("target_crate")).alias("crate"), "canonical_name", normal_form(F.col("status")).alias("visibility"), "deleted_at", "synced_at")
    live = latest_version(t, ["k"], "synced_at", ["crate", "canonical_name", "visibility", "deleted_at"]).where("deleted_at is null")
    return live.select(F.concat(F.coalesce("crate", F.lit("none")), F.lit("::"), F.substring_index("k", ".", -2)).alias("descriptor"), F.substring_index("k", ".", 1).alias("signature"), F.coalesce("canonical_name", F.lit("-")).alias("body"), F.coalesce("visibility", F.lit("-")).alias("visibility"))


def _entities_sql(name: str) -> str:
    return f"""(select coalesce({nf("target_crate")}, 'none') || '::' || split_part({nf("key")}, '.', 2) || '.' || split_part({nf("key")}, '.', 3) as d, split_part({nf("key")}, '.', 1) as s, coalesce(canonical_name, '-') as b, coalesce({nf("status")}, '-') as v
      from (select * from {name} qualify row_number() over (partition by {nf("key")} order by synced_at desc) = 1) where deleted_at is null and {nf("key")} is not null)"""


@query(f"""with a as {_entities_sql("canonical_capability_replica")}, b as {_entities_sql("canonical_capability")},
  ga as (select d, count(*) n, min(s) s, min(b) b, min(v) v, list_sort(list({{'s': s, 'b': b, 'v': v}})) l from a group by 1), gb as (select d, count(*) n, min(s) s, min(b) b, min(v) v, list_sort(list({{'s': s, 'b': b, 'v': v}})) l from b group by 1),
  m as (select ga.d, ga.n na, gb.n nb, ga.l la, gb.l lb, concat_ws(',', case when ga.s <> gb.s then 'signature' end, case when ga.b <> gb.b then 'body' end, case when ga.v <> gb.v then 'visibility' end) e from ga join gb using (d)),
  oa as (select * from a where d not in (select d from b)), ob as (select * from b where d not in (select d from a)),
  fa as (select s, b, count(*) n, min(d) d, min(v) v from oa where b <> '-' group by all), fb as (select s, b, count(*) n, min(d) d, min(v) v from ob where b <> '-' group by all),
  p as (select fa.s, fa.b, fa.n na, fb.n nb, fa.d da, fb.d db, fa.v va, fb.v vb from fa join fb using (s, b))
  select 'changed' as change, d as before, d as after, e as evidence from m where na = 1 and nb = 1 and e <> ''
  union all select 'ambiguous', d, d, 'descriptor declared ' || na || ' -> ' || nb || ' times' from m where not (na = 1 and nb = 1) and (na <> nb or la <> lb)
  union all select case when split_part(da, '::', 1) = split_part(db, '::', 1) then 'renamed' when split_part(da, '::', 2) = split_part(db, '::', 2) then 'moved' else 'moved_renamed' end, da, db, case when va = vb then 'identical signature and body' else 'identical signature and body; visibility ' || va || ' -> ' || vb end from p where na = 1 and nb = 1
  union all select 'ambiguous', da, db, na || ' -> ' || nb || ' entities share one signature and body' from p where na > 1 or nb > 1
  union all select 'deleted', d, null, '' from oa where not exists (select 1 from p where p.s = oa.s and p.b = oa.b)
  union all select 'created', null, d, '' from ob where not exists (select 1 from p where p.s = ob.s and p.b = ob.b)""")
def entity_correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which capability of the replica became which of the primary list."""
    return D.correspond(_entities(spark, sf_dir, "canonical_capability_replica"), _entities(spark, sf_dir, "canonical_capability"))


_RANK_SQL = "case {} when 'verified' then 0 when 'implemented_unverified' then 1 when 'unimplemented' then 2 when 'blocked' then 3 when 'excluded' then 4 else 5 end"


@query(f"""with {S.CAP_SQL}, rep as ({S.CAP_SQL[8:-1].replace("canonical_capability", "canonical_capability_replica")}) select coalesce(rep.cap_key, cap.cap_key) as cap_key, rep.status as before, cap.status as after, case when rep.cap_key is null then 'new' when cap.cap_key is null then 'dropped' when {_RANK_SQL.format('cap.status')} < {_RANK_SQL.format('rep.status')} then 'strengthened' else 'weakened' end as change
  from rep full join cap on rep.cap_key = cap.cap_key where rep.cap_key is null or cap.cap_key is null or {_RANK_SQL.format('cap.status')} <> {_RANK_SQL.format('rep.status')}""")
def status_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairnwork.plans.capability import live_capabilities

    old, new = (live_capabilities(table(spark, sf_dir, t)) for t in ("canonical_capability_replica", "canonical_capability"))
    return D.status_delta(old, new, "cap_key", "status", R.PROGRESS)


@query("with a as (select l_partkey, round(avg(l_extendedprice / l_quantity), 6) v from lineitem where l_shipdate < timestamp '1998-01-01' group by 1), b as (select l_partkey, round(avg(l_extendedprice / l_quantity), 6) v from lineitem where l_shipdate >= timestamp '1998-01-01' group by 1) select coalesce(a.l_partkey, b.l_partkey) as l_partkey, case when a.l_partkey is null then 'missing_a' when b.l_partkey is null then 'missing_b' when abs(a.v - b.v) <= 100.0 then 'agree' else 'differ' end as verdict from a full join b on a.l_partkey = b.l_partkey")
def tolerance_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit prices of two periods, agreeing within both uncertainties."""
    li, cut = table(spark, sf_dir, "lineitem"), F.lit("1998-01-01").cast("timestamp_ntz")
    mean = lambda df: df.groupBy("l_partkey").agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("v")).withColumn("u", F.lit(50.0))
    return D.within_tolerance(mean(li.where(F.col("l_shipdate") < cut)), mean(li.where(F.col("l_shipdate") >= cut)), ["l_partkey"], "v", "u")


@query()
def intent_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed status changes against what was meant: blocked capabilities were to be strengthened, and none
    may be dropped."""
    seen = status_delta(spark, sf_dir)
    blocked = S.capabilities(spark, sf_dir, "status").where("status = 'blocked'").select(F.col("cap_key").alias("item"), F.lit("strengthened").alias("change"), F.lit(False).alias("forbidden"))
    ruled = seen.where("change = 'dropped'").select(F.col("cap_key").alias("item"), "change", F.lit(True).alias("forbidden"))
    return D.check_intent(seen.select(F.col("cap_key").alias("item"), "change"), blocked.unionByName(ruled))


# ---- constraints

def capability_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = S.capabilities(spark, sf_dir, "domain", "side_effect_class", "donor_count", "target_crate", "status", "blocker")
    attributes = F.map_filter(F.create_map(*(x for c in ("status", "target_crate", "blocker", "domain", "donor_count") for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull())
    return cap.select(F.col("cap_key").alias("name"), F.col("side_effect_class").alias("kind"), attributes.alias("attributes"))


RULES = (
    ("money-has-crate", "forall c: money require target_crate != vantor-store"),
    ("money-few-donors", "forall c: money require donor_count <= 40"),
    ("blocked-says-why", "forall c: external_write where status == blocked require blocker != \"\""),
    ("none-is-verified", "forall c: none where domain == ledger require status == verified"),
    ("core-built", "require materialized vantor-core"),
    ("attic-built", "require materialized vantor-attic"),
    ("unreadable", "every capability should be nice"),
)


@query(f"""with {S.CAP_SQL}, f as (
  select 'money-has-crate' r, cap_key, case when target_crate is null then 'U' when target_crate <> 'vantor-store' then 'S' else 'V' end v from cap where side_effect_class = 'money'
  union all select 'money-few-donors', cap_key, case when donor_count is null then 'U' when donor_count <= 40 then 'S' else 'V' end from cap where side_effect_class = 'money'
  union all select 'blocked-says-why', cap_key, case when blocker is null then 'U' when blocker <> '' then 'S' else 'V' end from cap where side_effect_class = 'external_write' and status = 'blocked'
  union all select 'none-is-verified', cap_key, case when status is null then 'U' when status = 'verified' then 'S' else 'V' end from cap where side_effect_class = 'none' and domain = 'ledger'
  union all select 'core-built', 'vantor-core', case when exists (select 1 from cap where target_crate = 'vantor-core') then 'S' else 'V' end union all select 'attic-built', 'vantor-attic', 'V' union all select 'unreadable', null, 'U' union all select r, null, 'S' from (values ('money-has-crate'), ('money-few-donors'), ('blocked-says-why'), ('none-is-verified')) t(r)),
  k as (select *, row_number() over (partition by r, v order by cap_key) rn from f)
  select r as rule, case when bool_or(v = 'V') then 'VIOLATED' when bool_or(v = 'U') then 'UNKNOWN' else 'SATISFIED' end as verdict, count(cap_key) as n_facts, count(*) filter (v = 'V') as n_violations, count(*) filter (v = 'U') as n_unknown, coalesce(string_agg(case when v = 'V' and rn <= 12 then cap_key end, ',' order by rn), '') as counterexamples from k group by 1""")
def kleene_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules read from text, over capabilities, with their verdicts and counterexamples."""
    built = S.capabilities(spark, sf_dir, "target_crate").where("target_crate is not null").select(F.col("target_crate").alias("target"))
    return C.evaluate([C.parse_rule(n, t) for n, t in RULES], capability_nodes(spark, sf_dir), materialized=built)


@query("with s as (select l_suppkey, sum(l_extendedprice * (1 - l_discount)) lo, sum(l_extendedprice * (1 + l_tax)) hi from lineitem group by 1) select l_suppkey, case when hi <= 23000000 then 'SATISFIED' when lo > 23000000 then 'VIOLATED' else 'UNKNOWN' end as verdict from s")
def interval_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit against each supplier's interval of revenue."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("lo"), F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("hi"))
    return s.select("l_suppkey", C.interval_requirement(F.col("lo"), F.col("hi"), "<=", 23000000).alias("verdict"))


# ---- fronts

@query("select p_brand, p_partkey, p_retailprice, p_size from part a where not exists (select 1 from part b where b.p_brand = a.p_brand and b.p_retailprice >= a.p_retailprice and b.p_size <= a.p_size and (b.p_retailprice > a.p_retailprice or b.p_size < a.p_size))")
def skyline_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand that no other beats in price (more) and size (less)."""
    return Y.front_of_two(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_size").select("p_brand", "p_partkey", "p_retailprice", "p_size")


@query(f"with {S.OPP_SQL}, o as (select opp_id, category, impact, reach, effort from opp where impact is not null and reach is not null and effort is not null) select category, opp_id from o a where not exists (select 1 from o b where b.category = a.category and b.impact >= a.impact and b.reach >= a.reach and b.effort <= a.effort and (b.impact > a.impact or b.reach > a.reach or b.effort < a.effort))")
def pareto_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunities undominated in impact, reach and effort."""
    return Y.pareto_front(S.opportunities(spark, sf_dir, "category", "impact", "reach", "effort"), ["category"], [("impact", True), ("reach", True), ("effort", False)]).select("category", "opp_id")


@query(f"with {S.OPP_SQL}, o as (select opp_id, category, impact, leverage from opp where impact is not null and leverage is not null and status in ('validated', 'implemented')) select category, opp_id from o a where not exists (select 1 from o b where b.category = a.category and b.impact >= a.impact and b.leverage >= a.leverage and (b.impact > a.impact or b.leverage > a.leverage))")
def verified_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only verified and measured candidates compete."""
    rows = S.opportunities(spark, sf_dir, "category", "impact", "leverage", "status").withColumn("verdict", F.when(F.col("status").isin("validated", "implemented"), "SATISFIED").otherwise("UNKNOWN"))
    return Y.verified_front(rows, ["category"], [("impact", True), ("leverage", True)], "verdict").select("category", "opp_id")


# ---- quantities

@query("select p_partkey, round(p_size / 1000.0, 9) as metres, round(p_retailprice / 1000.0 * 9.81, 6) as newtons, '1,1,-2,0,0,0,0,0' as force_dimension from part")
def quantity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in mm and masses in g, brought to SI; a weight as a product of quantities."""
    part = table(spark, sf_dir, "part")
    size, mass = Q.parse_quantity(F.concat(F.col("p_size").cast("string"), F.lit(" mm"))), Q.parse_quantity(F.concat(F.col("p_retailprice").cast("string"), F.lit(" g")))
    force = Q.multiply_quantities(mass, Q.parse_quantity(F.lit("9.81 m/s^2")))
    return part.select("p_partkey", F.round(size["value"], 9).alias("metres"), F.round(force["value"], 6).alias("newtons"), force["dimension"].alias("force_dimension"))


@query("with q as (select n_nationkey, (n_nationkey * 6 + 2)::bigint n, (n_regionkey * 4 + 4)::bigint d from nation) select n_nationkey, (n // gcd(n, d))::bigint as num, (d // gcd(n, d))::bigint as den, ((n * 3 + d * 2) // gcd(n * 3 + d * 2, d * 3))::bigint as sum_num, ((d * 3) // gcd(n * 3 + d * 2, d * 3))::bigint as sum_den from q")
def exact_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions in lowest terms, and their sums with two thirds."""
    r = Q.rational(F.col("n_nationkey") * 6 + 2, F.col("n_regionkey") * 4 + 4)
    s = Q.rational_add(r, Q.rational(F.lit(2), F.lit(3)))
    as_long = lambda c: c.cast("long")
    return table(spark, sf_dir, "nation").select("n_nationkey", as_long(r["num"]).alias("num"), as_long(r["den"]).alias("den"), as_long(s["num"]).alias("sum_num"), as_long(s["den"]).alias("sum_den"))


@query("select p_brand, round(min(p_size - 1.0) * 2, 6) as low, round(max(p_size + 1.0) * 3, 6) as high, 'EUR' as currency from part group by 1")
def interval_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls of intervals, times an interval; money read from text."""
    p = Q.parse_money(F.concat((F.col("p_size") - 1).cast("string"), F.lit(".."), (F.col("p_size") + 1).cast("string"), F.lit(" EUR/unit")))
    rows = table(spark, sf_dir, "part").select("p_brand", p.alias("p"))
    hull = rows.groupBy("p_brand").agg(F.min("p.low").alias("low"), F.max("p.high").alias("high"), F.min("p.currency").alias("currency"))
    times = Q.interval_multiply(F.struct("low", "high"), Q.parse_interval(F.lit("2..3")))
    return hull.select("p_brand", F.round(times["low"], 6).alias("low"), F.round(times["high"], 6).alias("high"), "currency")


@query("select label, count(*) as n_vectors, sum(len(embedding) * (label + 1) * 32 // 8)::bigint as n_bytes from embeddings group by 1")
def tensor_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of tensors by shape and width."""
    bytes_ = Q.element_count(F.array(F.size("embedding").cast("long"), F.col("label").cast("long") + 1)) * 32 / 8
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n_vectors"), F.sum(bytes_.cast("long")).alias("n_bytes"))
