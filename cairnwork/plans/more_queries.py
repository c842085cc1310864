"""Smaller forms: text patterns, ratios, rankings, listings, audits, and two releases of a contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnwork.functions import quantity as Q
from cairnwork.functions import ranks as R
from cairnwork.operators import evidence as E
from cairnwork.operators import joins as J
from cairnwork.plans import store as S
from cairnwork.plans import evidence_queries  # noqa: F401 (its queries are used by name)
from cairnwork.plans.registry import ORACLES, QUERIES, query
from cairnwork.session import table


@query(f"with {S.FILE_SQL} select file_id, path from fil where path like 'src/%' and path like '%.rs'")
def path_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix and a suffix."""
    return S.files(spark, sf_dir, "path").where(F.col("path").startswith("src/") & F.col("path").endswith(".rs")).select("file_id", "path")


@query(f"with {S.FILE_SQL}, t as (select donor, count(*) n, coalesce(sum(size_bytes), 0)::bigint b from fil where donor is not null group by 1) select donor, n as n_files, b as n_bytes, ((b + n // 2) // n)::bigint as bytes_a_file from t")
def size_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes for each file, rounded half up in whole numbers."""
    t = S.files(spark, sf_dir, "donor", "size_bytes").where("donor is not null").groupBy("donor").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"))
    return t.withColumn("bytes_a_file", F.expr("(n_bytes + n_files div 2) div n_files"))


@query(f"with {S.FILE_SQL} select kind as area, count(*) filter (read_status = 'reviewed') as n_passed, count(*) as n_total, round(count(*) filter (read_status = 'reviewed') * 100.0 / count(*), 1)::double as percent from fil where kind is not null group by 1")
def review_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = S.files(spark, sf_dir, "kind", "read_status").where("kind is not null").select(F.col("kind").alias("area"), (F.col("read_status") == "reviewed").alias("ok"))
    return E.scorecard(checks, "area", "ok").withColumn("percent", F.col("percent").cast("double"))


@query(f"with {S.CAP_SQL}, r as (select *, row_number() over (partition by status order by cap_key) rn from cap) select coalesce(status, '<none>') as status, count(*) as n_rows, string_agg(case when rn <= 20 then cap_key end, ',' order by cap_key) as first_keys, count(*) > 20 as truncated from r group by 1")
def status_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with the first keys of each, and whether there are more."""
    rows = S.capabilities(spark, sf_dir, "status").select("cap_key", F.coalesce("status", F.lit("<none>")).alias("status"))
    few = rows.withColumn("_rn", F.row_number().over(W.partitionBy("status").orderBy("cap_key"))).where("_rn <= 20")
    keys = few.groupBy("status").agg(F.array_join(F.array_sort(F.collect_list("cap_key")), ",").alias("first_keys"))
    return rows.groupBy("status").agg(F.count("*").alias("n_rows")).join(keys, "status").withColumn("truncated", F.col("n_rows") > 20)


@query(f"with {S.ARCH} select e.id, row_number() over (order by coalesce(kind, ''), coalesce(src, ''), coalesce(dst, ''), coalesce(evidence_ref, ''), id)::bigint as place from aedge e order by place limit 500")
def fact_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first facts in a total order of five keys. Places are told within the rows kept alone."""
    keys = [F.coalesce(c, F.lit("")) for c in ("kind", "src", "dst", "evidence_ref")]
    head = S.architecture(spark, sf_dir)[1].orderBy(*keys, "id").limit(500)
    return head.select("id", F.row_number().over(W.orderBy(*keys, "id")).cast("bigint").alias("place"))


@query(f"with {S.ARCH}, k as (select crate, case status when 'verified' then 0 when 'implemented_unverified' then 1 when 'unimplemented' then 2 when 'blocked' then 3 when 'excluded' then 4 else 5 end r, status from anode where crate is not null) select crate, max({{'r': r, 's': status}}).s as weakest, count(*) as n_nodes from k group by 1")
def weakest_of_crate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standing of a crate is that of its weakest node."""
    nodes = S.architecture(spark, sf_dir)[0].where("crate is not null")
    return nodes.groupBy("crate").agg(R.weakest(R.PROGRESS, F.col("status")).alias("weakest"), F.count("*").alias("n_nodes"))


_ALLOWED = {"status": ("verified", "implemented_unverified", "unimplemented", "blocked"), "side_effect_class": ("none", "read", "write")}


@query(f"with {S.CAP_SQL} " + " union all ".join(f"select '{c}' as field, {c} as stated, count(*) as n_rows from cap where {c} is not null and {c} not in {v!r} group by 2" for c, v in _ALLOWED.items()))
def enum_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that the list of a field does not have, all fields in one pass."""
    rows = S.capabilities(spark, sf_dir, *_ALLOWED)
    wrong = F.array_compact(F.array(*(F.when(~F.col(c).isin(*v), F.struct(F.lit(c).alias("field"), F.col(c).alias("stated"))) for c, v in _ALLOWED.items())))
    return rows.select(F.explode(wrong).alias("w")).groupBy("w.field", "w.stated").agg(F.count("*").alias("n_rows"))


@query(f"with {S.CAP_SQL}, {S.OVR_SQL} select o.cap_key, o.o_status as stated from ovr o left join cap c using (cap_key) where o.o_status = 'verified' and o.set_by is null or (o.o_status is not null and c.cap_key is null)")
def invented_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses that nobody can have found: set by no one as verified, or for a capability that is not there."""
    cap = S.capabilities(spark, sf_dir, "id").select("cap_key", F.lit(True).alias("_there"))
    rows = S.overrides(spark, sf_dir).join(cap, "cap_key", "left")
    return rows.where("(o_status = 'verified' and set_by is null) or (o_status is not null and _there is null)").select("cap_key", F.col("o_status").alias("stated"))


@query("""with c as (select feed, file_no, payload::json p from campaign_record where json_valid(payload) and json_type(payload) = 'OBJECT'), k as (select file_no, unnest(json_keys(p)) f, p from c), v as (select file_no, f, case json_type(json_extract(p, '$."' || f || '"')) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then null else 'number' end t from k),
  r as (select file_no, f, string_agg(distinct t, '+' order by t) t from v where t is not null and file_no in (1, 4) group by all), a as (select f, t from r where file_no = 1), b as (select f, t from r where file_no = 4)
  select coalesce(a.f, b.f) as field, case when b.f is null then 'REMOVED' when a.f is null then 'ADDED' else 'RETYPED' end as change, (b.f is null or (a.f is not null and a.t <> b.t)) as breaking from a full join b on a.f = b.f where a.t is distinct from b.t""")
def contract_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of two releases of the record contract, first and fourth files: what changed, and whether readers break."""
    from cairnwork.operators.drift import fields_of

    rows = table(spark, sf_dir, "campaign_record").where("file_no in (1, 4)").select("file_no", "payload")
    kind = F.regexp_extract(F.schema_of_variant("value"), "^([A-Z]+)", 1)
    named = F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "OBJECT", "object").when(kind == "ARRAY", "array").otherwise("number")
    types = lambda n: F.array_join(F.array_sort(F.collect_set(F.when(F.col("file_no") == n, F.col("t")))), "+")
    both = fields_of(rows, "payload").select("file_no", "field", named.alias("t")).groupBy("field").agg(types(1).alias("a"), types(4).alias("b")).where("a <> b")
    return both.select("field", F.when(F.col("b") == "", "REMOVED").when(F.col("a") == "", "ADDED").otherwise("RETYPED").alias("change"), (F.col("a") != "").alias("breaking"))


@query("with q as (select n_nationkey k, (n_nationkey * 6 + 2)::bigint n, (n_regionkey * 4 + 4)::bigint d from nation) select k as n_nationkey, (-n // gcd(n, d))::bigint as neg_num, sign(n * 2 - d * 5)::int as against, ((n * 3) // gcd(n * 3, d * 7))::bigint as mul_num, ((d * 7) // gcd(n * 3, d * 7))::bigint as mul_den from q")
def fraction_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negative of a fraction, how it compares with five halves, and its product with three sevenths."""
    r = Q.rational(F.col("n_nationkey") * 6 + 2, F.col("n_regionkey") * 4 + 4)
    m = Q.rational_multiply(r, Q.rational(F.lit(3), F.lit(7)))
    return table(spark, sf_dir, "nation").select("n_nationkey", Q.rational_negate(r)["num"].cast("long").alias("neg_num"), Q.rational_compare(r, Q.rational(F.lit(5), F.lit(2))).alias("against"), m["num"].cast("long").alias("mul_num"), m["den"].cast("long").alias("mul_den"))


@query("with p as (select s_suppkey, s_acctbal / 977.0 x from supplier), t as (select s_suppkey, x, unnest(range(1, 17)) q from p) select s_suppkey, arg_min(round(x * q)::bigint, {'o': abs(x - round(x * q) / q), 'q': q}) as num, arg_min(q, {'o': abs(x - round(x * q) / q), 'q': q})::int as den from t group by 1")
def nearest_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as fractions with small denominators."""
    f = Q.nearest_fraction(F.col("s_acctbal") / 977.0, 16)
    return table(spark, sf_dir, "supplier").select("s_suppkey", f["num"].alias("num"), f["den"].alias("den"))


_WORDS = "array_to_string(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), ' ')"


@query(f"with {S.SRC_SQL}, n as (select distinct module, {_WORDS.format('module')} p from src where module is not null), t as (select doc_id, {_WORDS.format('text')} w from documents where text is not null) select distinct doc_id, module from t join n on p <> '' and contains(' ' || w || ' ', ' ' || p || ' ')")
def phrase_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents name which modules, by all the words of the name."""
    return J.phrase_mentions(table(spark, sf_dir, "documents"), "doc_id", "text", S.sources(spark, sf_dir, "module"), "module")


@query("with l as (select o_custkey task, max({'e': o_orderdate, 'i': o_orderkey, 's': o_orderstatus}) v from orders group by 1) select task, v.i as lease_id, case when v.s = 'O' and v.e + interval 90 day <= timestamp '1998-01-01' then 'EXPIRED' when v.s = 'O' then 'ACTIVE' else v.s end as state from l")
def latest_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest lease of each task, and its state now; orders of a customer seen as leases of ninety days."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("task")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("v"))
    out = (F.col("v.o_orderdate") + F.expr("interval 90 days")) <= F.lit("1998-01-01").cast("timestamp_ntz")
    open_ = F.col("v.o_orderstatus") == "O"
    return o.select("task", F.col("v.o_orderkey").alias("lease_id"), F.when(open_ & out, "EXPIRED").when(open_, "ACTIVE").otherwise(F.col("v.o_orderstatus")).alias("state"))


@query(f"with {S.SRC_SQL} select 'PROVIDES' as kind, 'donor:' || donor as src, 'module:' || module as dst, count(*) as weight, min(id) as first_fact from src where donor is not null and module is not null group by all union all select 'TARGETS', 'module:' || module, 'crate:' || target_crate, count(*), min(id) from src where module is not null and target_crate is not null group by all")
def facts_to_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed weighted edges made of facts in one pass; the least fact stands as evidence."""
    named = lambda k, c: F.concat(F.lit(f"{k}:"), F.col(c))
    edges = F.array_compact(F.array(*(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.lit(kind).alias("kind"), named(x, a).alias("src"), named(y, b).alias("dst"))) for kind, x, a, y, b in (("PROVIDES", "donor", "donor", "module", "module"), ("TARGETS", "module", "module", "crate", "target_crate")))))
    facts = S.sources(spark, sf_dir, "donor", "module", "target_crate").select("id", F.explode(edges).alias("e"))
    return facts.groupBy("e.kind", "e.src", "e.dst").agg(F.count("*").alias("weight"), F.min("id").alias("first_fact"))


@query(ORACLES["gate_report"].join(("select cap_key, case when blockers = '' then 'SEALED' else 'BLOCKED' end as state, case when blockers = '' then 0 else length(blockers) - length(replace(blockers, ',', '')) + 1 end::int as n_blockers from (", ")")))
def seal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capability is sealed when no gate blocks it."""
    return QUERIES["gate_report"](spark, sf_dir).select("cap_key", F.when(F.col("blockers") == "", "SEALED").otherwise("BLOCKED").alias("state"), F.when(F.col("blockers") == "", 0).otherwise(F.size(F.split("blockers", ","))).cast("int").alias("n_blockers"))


@query(f"with {S.FILE_SQL}, e as (select kind, min(size_bytes) lo, max(size_bytes) hi from fil where read_status = 'reviewed' and size_bytes is not null and kind is not null group by 1) select fil.kind, e.lo as low, e.hi as high, count(*) filter (size_bytes < e.lo or size_bytes > e.hi) as n_outside, count(*) as n_files from fil join e using (kind) group by all")
def size_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes that reviewed files of a kind have, and how many files of the kind lie outside of them."""
    fil = S.files(spark, sf_dir, "kind", "read_status", "size_bytes").where("kind is not null")
    seen = fil.where("read_status = 'reviewed' and size_bytes is not null").groupBy("kind").agg(F.min("size_bytes").alias("low"), F.max("size_bytes").alias("high"))
    return fil.join(seen, "kind").groupBy("kind", "low", "high").agg(F.count_if((F.col("size_bytes") < F.col("low")) | (F.col("size_bytes") > F.col("high"))).alias("n_outside"), F.count("*").alias("n_files"))
