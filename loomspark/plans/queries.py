"""Queries over the driver tables, one or more for each operator, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import cycles as C
from loomspark.operators import findings as O
from loomspark.operators import graph as G
from loomspark.operators import intervals as I
from loomspark.operators import ranking as R
from loomspark.plans import line_rules
from loomspark.sources import ignore

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("rel_path"), F.col("text").alias("source_text"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.findings(_texts(spark, sf_dir))


LINES = r"""
l as (select 'doc/' || doc_id as rel_path, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1)::int as line_start from documents),
m as (select *, length(line) as n, coalesce(lag(line) over (partition by rel_path order by line_start) = line and length(line) > 0, false) as again from l),
found as (
  select 'eslint' as source, 'text/repeated-line' as rule_id, 'low' as severity, 'maintainability' as category, 'Line repeats the one before' as message, rel_path, line_start, 1 as emit_ord from m where again
  union all select 'complexity', 'text/long-line', case when n >= 400 then 'high' else 'medium' end, 'maintainability', 'Line has ' || n || ' characters', rel_path, line_start, 2 from m where n > 200
  union all select 'react', 'text/shouting', 'critical', 'correctness', 'Line is in capitals', rel_path, line_start, 3 from m where n >= 20 and upper(line) = line and lower(line) <> line)
"""
WEIGHT = "case severity when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 4 end"


@query(f"with {LINES} select s.severity, count(found.severity)::bigint as n from (values ('low'), ('medium'), ('high'), ('critical')) s(severity) left join found using (severity) group by 1")
def severity_counts(spark, d):
    return O.dense_counts(_found(spark, d), "severity", list(T.SEVERITIES), strict=True)


@query(f"with {LINES} select s.source, count(found.source)::bigint as n from (values ('eslint'), ('complexity'), ('react'), ('ai')) s(source) left join found using (source) group by 1")
def findings_by_source(spark, d):
    return O.dense_counts(_found(spark, d), "source", T.SOURCES)


@query(f"with {LINES} select rel_path, line_start, rule_id, severity from found where {WEIGHT} >= 3")
def severity_filter(spark, d):
    return O.at_least(_found(spark, d), "high").select("rel_path", "line_start", "rule_id", "severity")


@query(f"with {LINES} select coalesce(bool_or({WEIGHT} >= 4), false) as hit from found")
def threshold_exists(spark, d):
    return O.any_at_least(_found(spark, d), "critical")


@query(f"""with {LINES}, every as (select *, 0 as pass from found union all select *, 0 from found union all select source, rule_id, severity, category, '  ' || replace(message, ' ', '   '), rel_path, line_start, emit_ord, 1 from found),
r as (select *, row_number() over (partition by source, rule_id, rel_path, line_start, trim(regexp_replace(message, '\\s+', ' ', 'g')) order by pass, emit_ord) as k from every)
select rel_path, line_start, rule_id, pass, sha256(concat_ws(':', source, rule_id, rel_path, line_start, 1, trim(regexp_replace(message, '\\s+', ' ', 'g')))) as fingerprint from r where k = 1""")
def finding_dedupe(spark, d):
    """Every finding twice, and once more with other white space: one of each is left."""
    f = _found(spark, d)
    again = f.withColumn("message", F.concat(F.lit("  "), F.replace(F.col("message"), F.lit(" "), F.lit("   "))))
    every = f.unionByName(f).withColumn("pass", F.lit(0)).unionByName(again.withColumn("pass", F.lit(1)))
    return O.first_of_each(every, "pass", "emit_ord").select("rel_path", "line_start", "rule_id", "pass", T.sha(F.col("fingerprint")).alias("fingerprint"))


@query(f"with {LINES} select rel_path, line_start, rule_id, row_number() over (order by rel_path, line_start, {WEIGHT} desc, rule_id) as rank from found order by rank limit 100")
def finding_sort_topk(spark, d):
    top = O.ordered(_found(spark, d)).limit(100)
    by = Window.orderBy("rel_path", "line_start", F.desc(T.severity_weight(F.col("severity"))), "rule_id")
    return top.select("rel_path", "line_start", "rule_id", F.row_number().over(by).cast("long").alias("rank"))


@query("select doc_id, source, row_number() over (order by doc_id) as rank, greatest((select count(*) from documents) - 100, 0) as left_out from documents order by doc_id limit 100")
def limit_with_remainder(spark, d):
    out = O.limit_with_rest(_t(spark, d, "documents").select("doc_id", "source"), "doc_id", 100)
    return out.select("doc_id", "source", F.col("rank").cast("long").alias("rank"), "left_out")


@query(f"""with {LINES}, f as (select count(*) as n_findings, count(distinct rel_path) as n_files_with_findings, count(*) filter ({WEIGHT} >= 3) as n_errors, count(*) filter ({WEIGHT} < 3) as n_warnings from found)
select (select count(*) from documents)::bigint as discovered, (select count(*) from documents where strlen(text) > 10240)::bigint as too_large, f.* from f""")
def review_summary(spark, d):
    docs = _t(spark, d, "documents").agg(F.count("*").alias("discovered"), F.count_if(F.octet_length("text") > 10 * 1024).alias("too_large"))
    w = T.severity_weight(F.col("severity"))
    out = _found(spark, d).agg(F.count("*").alias("n_findings"), F.count_distinct("rel_path").alias("n_files_with_findings"), F.count_if(w >= 3).alias("n_errors"), F.count_if(w < 3).alias("n_warnings"))
    return docs.join(F.broadcast(out))


RANGES = "r as (select 'doc/' || doc_id as rel_path, 1 + quality as start, 3 + toxic * 5 as \"end\" from labels)"


@query(f'with {LINES}, {RANGES} select rel_path, line_start, rule_id from found where exists (select 1 from r where r.rel_path = found.rel_path and found.line_start <= r."end" and found.line_start >= r.start)')
def scope_semi_join(spark, d):
    return I.in_scope(_found(spark, d), _ranges(spark, d)).select("rel_path", "line_start", "rule_id")


def _ranges(spark, d):
    return _t(spark, d, "labels").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("rel_path"), (1 + F.col("quality")).alias("start"), (3 + F.col("toxic") * 5).alias("end"))


CHUNKS = "c as (select rel_path, (line_start - 1) // 3 as part, min(line_start) as line_start, max(line_start) as line_end, string_agg(line, chr(10) order by line_start) as code from l group by 1, 2), k as (select rel_path || ':part' || part || ':' || line_start || '-' || line_end as chunk_id, *, ceil(length(code) / 3)::bigint + 150 as tokens from c)"


def _chunks(spark, d):
    part = F.expr("(line_start - 1) div 3")
    out = line_rules.lines(_texts(spark, d)).groupBy("rel_path", part.alias("part")).agg(F.min("line_start").alias("line_start"), F.max("line_start").alias("line_end"), F.array_sort(F.collect_list(F.struct("line_start", "line"))).alias("x"))
    code = F.array_join(F.transform("x", lambda s: s["line"]), "\n")
    name = F.concat(F.col("rel_path"), F.lit(":part"), F.col("part").cast("string"), F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))
    return out.select(name.alias("chunk_id"), "rel_path", "line_start", "line_end", (T.token_estimate(code) + 150).alias("tokens"))


@query(f'with {LINES}, {RANGES}, {CHUNKS} select chunk_id, tokens, tokens > 400 as token_limit from k where exists (select 1 from r where r.rel_path = k.rel_path and k.line_start <= r."end" and k.line_end >= r.start)')
def chunk_scope(spark, d):
    return I.in_scope(_chunks(spark, d), _ranges(spark, d)).select("chunk_id", "tokens", (F.col("tokens") > 400).alias("token_limit"))


@query(f"with {LINES}, {CHUNKS} select chunk_id, count(*) as n_findings, string_agg(distinct rule_id, ',' order by rule_id) as rules from k join found on k.rel_path = found.rel_path and k.line_start <= found.line_start and k.line_end >= found.line_start group by 1")
def chunk_context(spark, d):
    return I.context(_chunks(spark, d), _found(spark, d))


META = {"click": ("low", "maintainability"), "error": ("high", "correctness"), "purchase": ("medium", "security")}


@query("select event_id, event_type as rule_id, case event_type when 'click' then 'low' when 'error' then 'high' else 'medium' end as severity, case event_type when 'click' then 'maintainability' when 'purchase' then 'security' else 'correctness' end as category from events")
def rule_meta_lookup(spark, d):
    meta = spark.createDataFrame([(k, *v) for k, v in META.items()], "event_type string, severity string, category string")
    out = _t(spark, d, "events").join(F.broadcast(meta), "event_type", "left")  # a fixed table
    return out.select("event_id", F.col("event_type").alias("rule_id"), F.coalesce("severity", F.lit("medium")).alias("severity"), F.coalesce("category", F.lit("correctness")).alias("category"))


@query("select doc_id, sha256(text) as key from documents where doc_id not in (select d.doc_id from documents d join benchmark b on sha256(d.text) = sha256(b.text)) and text is not null")
def cache_delta(spark, d):
    have = _t(spark, d, "benchmark").select(T.sha(F.col("text")).alias("key"))
    return _t(spark, d, "documents").where("text is not null").select("doc_id", T.sha(F.col("text")).alias("key")).join(have, "key", "left_anti")


COSTS = "m as (select conv_id, turn, role, ceil(length(text) / 3)::bigint as tokens, case role when 'user' then 0.2 when 'assistant' then 1.2 end::double as price from conversations)"


@query(f"with {COSTS} select conv_id, turn, role, tokens, round(tokens / 1e6::double * price, 6) as usd from m")
def model_cost(spark, d):
    price = spark.createDataFrame([("user", 0.2, 0.0), ("assistant", 1.2, 0.0)], "role string, p_in double, p_out double")
    out = _t(spark, d, "conversations").withColumn("tokens", T.token_estimate(F.col("text"))).join(F.broadcast(price), "role", "left")
    return out.select("conv_id", "turn", "role", "tokens", T.cost(F.col("tokens"), F.lit(0), F.col("p_in"), F.col("p_out")).alias("usd"))


@query("""with recursive m as (select conv_id, turn, ceil(length(text) / 3)::bigint as tokens, case when role <> 'system' then ceil(length(text) / 3)::double end as cost, row_number() over (partition by conv_id order by turn) as k from conversations),
s(conv_id, turn, k, n, c, stop, decision) as (
  select conv_id, turn, 0::bigint, 0, 0::double, null::varchar, null::varchar from m where k = 1
  union all
  select m.conv_id, m.turn, m.k, s.n + (x.said = 'accepted')::int, s.c + case when x.said = 'accepted' then coalesce(m.cost, 0) else 0 end, case when x.said in ('max-requests-reached', 'max-cost-exceeded') then x.said else s.stop end, x.said
  from s join m on m.conv_id = s.conv_id and m.k = s.k + 1, lateral (select case when s.stop is not null then s.stop when s.n >= 3 then 'max-requests-reached' when m.tokens > 300 then 'chunk-exceeds-max-tokens' when s.c + m.cost > 500 then 'max-cost-exceeded' else 'accepted' end as said) x)
select conv_id, turn, decision from s where k > 0""")
def budget_gate(spark, d):
    tokens = T.token_estimate(F.col("text"))
    rows = _t(spark, d, "conversations").withColumn("tokens", tokens).withColumn("cost", F.when(F.col("role") != "system", F.col("tokens").cast("double")))
    return R.budget_gate(rows, "conv_id", "turn", max_requests=3, max_cost=500.0, max_tokens=300, tokens="tokens", cost="cost")


SPANS = 's as (select l_orderkey, l_linenumber as start, l_linenumber + floor(l_quantity / 25)::int as "end" from lineitem)'


@query(f"""with {SPANS}, f as (select *, case when start > max("end") over (partition by l_orderkey order by start, "end" rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as new from s),
i as (select *, sum(new) over (partition by l_orderkey order by start, "end" rows unbounded preceding) as island from f)
select l_orderkey, min(start) as start, max("end") as "end" from i group by l_orderkey, island""")
def interval_merge(spark, d):
    spans = _t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.floor(F.col("l_quantity") / 25).cast("int")).alias("end"))
    return I.merged(spans, ["l_orderkey"])


@query("""with f as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 30 minute then 1 else 0 end as new from events),
i as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session from f)
select user_id, session, count(*) as n_events, min(ts) as first_ts, max(ts) as last_ts from i group by 1, 2""")
def session_islands(spark, d):
    return I.sessions(_t(spark, d, "events"), "user_id", "ts", 1800)


@query("select p_partkey, case when row_number() over w = 1 then p_name else p_name || '-' || row_number() over w end as unique_id from part window w as (partition by p_name order by p_partkey)")
def id_suffix(spark, d):
    return R.suffixed(_t(spark, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "unique_id")


@query("select c_nationkey, c_mktsegment, c_custkey, c_name from customer qualify row_number() over (partition by c_nationkey, c_mktsegment order by c_acctbal, c_custkey) = 1")
def first_per_range(spark, d):
    c = _t(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_name", "c_acctbal")
    return R.first_per(c, ["c_nationkey", "c_mktsegment"], "c_acctbal", "c_custkey").drop("c_acctbal")


@query("select o_orderkey from orders qualify row_number() over (order by o_orderdate desc, o_orderkey) > 500")
def cache_eviction(spark, d):
    return R.evicted(_t(spark, d, "orders").select("o_orderkey", "o_orderdate"), 500, "o_orderkey", "o_orderdate").select("o_orderkey")


EDGES = "e as (select distinct l_partkey as src, l_suppkey as dst from lineitem)"


def _edges(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


@query(f"with {EDGES} select dst as node, array_to_string(list_sort(list(distinct src)), ',') as dependents from (select distinct src, dst from e) group by 1")
def reverse_dependents(spark, d):
    return G.reverse_dependents(_edges(spark, d))


@query(f"with {EDGES} select a.src, a.dst from e a join e b on a.src = b.dst and a.dst = b.src where a.src < a.dst")
def mutual_edges(spark, d):
    return G.mutual(_edges(spark, d))


OWNERS = """e as (select o_orderkey * 4 as src, o_custkey * 4 + 1 as dst from orders union select c_custkey * 4 + 1, c_nationkey * 4 + 2 from customer union select n_nationkey * 4 + 2, n_regionkey * 4 + 3 from nation)"""


def _owners(spark, d):
    """Orders depend on customers, these on nations, these on regions; ids of one kind are congruent modulo 4."""
    o, c, n = (_t(spark, d, t) for t in ("orders", "customer", "nation"))
    edge = lambda df, a, i, b, k: df.select((F.col(a).cast("long") * 4 + i).alias("src"), (F.col(b).cast("long") * 4 + k).alias("dst"))
    return edge(o, "o_orderkey", 0, "o_custkey", 1).unionByName(edge(c, "c_custkey", 1, "c_nationkey", 2)).unionByName(edge(n, "n_nationkey", 2, "n_regionkey", 3))


@query(f"with recursive {OWNERS}, c(start, node) as (select src, dst from e union select c.start, e.dst from c join e on c.node = e.src) select start, node from c")
def module_closure(spark, d):
    return G.closure(_owners(spark, d))


@query(f"with recursive {EDGES}, c(start, node) as (select src, dst from e union select c.start, e.dst from c join e on c.node = e.src) select start as node from c where start = node")
def cycle_nodes(spark, d):
    return G.on_cycles(_edges(spark, d))


RINGS = """o as (select o_orderkey as node, o_custkey as cust, o_orderstatus = 'F' as back, row_number() over w as pos, count(*) over (partition by o_custkey) as n, min(o_orderkey) over (partition by o_custkey) as first from orders window w as (partition by o_custkey order by o_orderkey))"""


def _rings(spark, d):
    """Each order points to the customer's next one, the last to the first; finished orders point to the first as well. Each also points to its customer, and that one nowhere."""
    by = Window.partitionBy("o_custkey")
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("src"), (-F.col("o_custkey")).alias("cust"), (F.col("o_orderstatus") == "F").alias("back"), F.lead("o_orderkey").over(by.orderBy("o_orderkey")).alias("next"), F.min("o_orderkey").over(by).alias("first"))
    more = F.array_compact(F.array(F.coalesce("next", "first"), "cust", F.when(F.col("back"), F.col("first"))))
    return o.select("src", F.explode(more).alias("dst"))


@query(f"with {RINGS} select node, first as component from o")
def strong_components(spark, d):
    return C.strong_components(_rings(spark, d))


@query(f"with {RINGS}, s as (select cust, coalesce(min(pos) filter (back), max(pos)) as stop, min(node) as first from o group by 1) select first as component, pos - 1 as step, node from o join s using (cust, first) where pos <= stop union all select first, stop, first from s")
def cycle_walks(spark, d):
    return C.cycle_walks(_rings(spark, d))



@query(r"""with t as (select doc_id, coalesce(text, '') || case doc_id % 5 when 0 then ' key=abc.12-' || doc_id when 1 then ' Authorization: BEARER  a.b-c_' || doc_id when 2 then ' sk-' || repeat('aB3_-', 4) when 3 then ' gsk_' || repeat('x9', 10) else ' sk-short api_key: none' end as text from documents)
select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[a-zA-Z0-9_-]{20,}', '[REDACTED_API_KEY]', 'g'), 'gsk_[a-zA-Z0-9_-]{20,}', '[REDACTED_API_KEY]', 'g'), '(?i)bearer\s+[a-zA-Z0-9_\-.]+', '[REDACTED_API_KEY]', 'g'), '(?i)key=[a-zA-Z0-9_\-.]+', '[REDACTED_API_KEY]', 'g')) as redacted from t""")
def redact_secrets(spark, d):
    i, k = F.col("doc_id"), F.col("doc_id") % 5
    more = F.when(k == 0, F.concat(F.lit(" key=abc.12-"), i.cast("string"))).when(k == 1, F.concat(F.lit(" Authorization: BEARER  a.b-c_"), i.cast("string"))).when(k == 2, " sk-" + "aB3_-" * 4).when(k == 3, " gsk_" + "x9" * 10).otherwise(" sk-short api_key: none")
    return _t(spark, d, "documents").select("doc_id", T.sha(T.redact(F.concat(F.coalesce("text", F.lit("")), more))).alias("redacted"))


NAMES = ["UserCard", "useHTTPServer2Client", "PRODUCT_STATUS", "$store", "ABC1", "XMLHttpRequest", "a.b c", "_private_", "$$", "", "__"]


@query(rf"""with a as (select p_partkey, case when p_partkey % 12 < 11 then {NAMES}[p_partkey % 12 + 1] else p_type || 'X' || p_name end as x from part)
select p_partkey, case when x = '' then 'candidate' else regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\1-\2', 'g'), '([A-Z]+)([A-Z][a-z0-9])', '\1-\2', 'g'), '[_\s.]+', '-', 'g')), '^-+|-+$', '', 'g') end as kebab from a""")
def kebab_id(spark, d):
    at = (F.col("p_partkey") % 12).cast("int")
    name = F.when(at < 11, F.get(F.array(*map(F.lit, NAMES)), at)).otherwise(F.concat("p_type", F.lit("X"), "p_name"))
    return _t(spark, d, "part").select("p_partkey", T.kebab(name).alias("kebab"))


@query(r"select page_id, regexp_replace(regexp_replace('./' || url, '\\', '/', 'g'), '^(\./|/)+', '') as path from pages")
def path_normalise(spark, d):
    return _t(spark, d, "pages").select("page_id", T.normal_path(F.concat(F.lit("./"), F.col("url"))).alias("path"))


@query("""with h as (select l_orderkey, l_linenumber, l_quantity::int as n from lineitem)
select l_orderkey, l_linenumber, l_orderkey as start, l_orderkey + n - 1 as "end" from h where n > 0""")
def hunk_parse(spark, d):
    n = F.col("l_quantity").cast("int").cast("string")
    diff = F.concat(F.lit("diff --git\n@@ -1,3 +"), F.col("l_orderkey").cast("string"), F.when(n != "1", F.concat(F.lit(","), n)).otherwise(""), F.lit(" @@ x\n-a\n@@ -9 +8,0 @@\n"))
    out = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(T.hunks(diff)).alias("h"))
    return out.select("l_orderkey", "l_linenumber", F.col("h.start").cast("long").alias("start"), F.col("h.end").cast("long").alias("end"))


@query("select doc_id, greatest(len(string_split(text, chr(10))) - case when text like '%' || chr(10) then 1 else 0 end, 1)::bigint as n_lines, ceil(length(text) / 3)::bigint as tokens from documents")
def line_and_token_counts(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.line_count(F.col("text")).alias("n_lines"), T.token_estimate(F.col("text")).alias("tokens"))


RAW = r"""raw as (select event_id as row_id, event_id % 7 as m, event_type, (props->>'$.k')::int as k from events),
r as (select row_id, m, k, case m when 0 then 'ai-null-deref' when 1 then 'AI/Race Condition' when 2 then '' when 3 then null when 4 then '--x' else event_type end as rule_id, case when m = 3 and k % 2 = 0 then 'Old:Rule' end as rule, case m when 3 then 'kind' end as type,
  case event_type when 'error' then 'critical' when 'click' then 'low' else 'high' end as severity, case when m < 4 then 'security' else event_type end as category, case m when 0 then '  Title  ' when 1 then ' ' end as title,
  case m when 2 then '   ' when 5 then null else '  Value is ' || k || repeat(' and on', 12) || ' ' end as message, case when k % 2 = 1 then ' said otherwise ' end as description,
  case when m = 4 then 0 when m = 5 then k end as line, case when m < 3 then k end as line_start, case when m = 0 then k + 2 end as line_end, case when m = 1 then ' fix it ' when m = 2 then '' end as suggestion, case when m = 6 then null else k::double / 80 end as confidence from raw),
t as (select *, lower(coalesce(rule_id, rule, type, 'ai/code-issue')) as low from r), u as (select *, regexp_replace(low, '[^a-z0-9/-]', '-', 'g') as slug from t),
s as (select row_id, case when slug like 'ai/%' then slug else 'ai/' || coalesce(nullif(regexp_replace(regexp_replace(slug, '^ai-?', ''), '^-+', ''), ''), 'issue') end as rule_id, case when severity in ('low', 'medium', 'high') then severity else 'medium' end as severity,
  case when category = 'security' then category else 'correctness' end as category, coalesce(nullif(trim(title), ''), nullif(trim(message), '')[:60], 'Code Issue') as title, coalesce(nullif(trim(message), ''), nullif(trim(description), ''), 'Potential issue identified in code.') as message,
  coalesce(line_start, nullif(line, 0), 1) as line_start, coalesce(line_end, line_start, nullif(line, 0), 1) as line_end, coalesce(nullif(trim(suggestion), ''), 'Review and update the code.') as suggestion, least(greatest(coalesce(confidence, 0.85), 0), 1) as confidence from u)"""


def _raw(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").alias("row_id"), (F.col("event_id") % 7).alias("m"), F.col("event_type").alias("e"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    m, k, kind = F.col("m"), F.col("k"), F.col("e")
    message = F.when(m == 2, "   ").when(m == 5, None).otherwise(F.concat(F.lit("  Value is "), k.cast("string"), F.lit(" and on" * 12 + " ")))
    return e.select(
        "row_id", F.when(m == 0, "ai-null-deref").when(m == 1, "AI/Race Condition").when(m == 2, "").when(m == 3, None).when(m == 4, "--x").otherwise(kind).alias("rule_id"), F.when((m == 3) & (k % 2 == 0), "Old:Rule").alias("rule"), F.when(m == 3, "kind").alias("type"),
        F.when(kind == "error", "critical").when(kind == "click", "low").otherwise("high").alias("severity"), F.when(m < 4, "security").otherwise(kind).alias("category"), F.when(m == 0, "  Title  ").when(m == 1, " ").alias("title"), message.alias("message"),
        F.when(k % 2 == 1, " said otherwise ").alias("description"), F.when(m == 4, 0).when(m == 5, k).alias("line"), F.when(m < 3, k).alias("line_start"), F.when(m == 0, k + 2).alias("line_end"), F.when(m == 1, " fix it ").when(m == 2, "").alias("suggestion"),
        F.when(m == 6, None).otherwise(k / 80).alias("confidence"),
    )


@query(f"with {RAW} select * replace (round(confidence, 6) as confidence) from s")
def ai_sanitise(spark, d):
    return O.sanitised(_raw(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query(f"with {RAW} select row_id, rule_id from s where confidence >= 0.65")
def confidence_filter(spark, d):
    return O.confident(O.sanitised(_raw(spark, d))).select("row_id", "rule_id")


@query(f"with {RAW} select row_id, 'ai' as source, rule_id, severity, category, trim(title) as title, message, 'f' || row_id % 9 as rel_path, line_start, 1 as column_start, line_end, 1 as column_end, suggestion, false as fixable, round(confidence, 6) as confidence from s where confidence >= 0.65 and line_start >= 1 + row_id % 30 and line_end <= 60 + row_id % 30 and line_end >= line_start")
def ai_normalise(spark, d):
    i = F.col("row_id")
    placed = O.sanitised(_raw(spark, d)).withColumns({"rel_path": F.concat(F.lit("f"), (i % 9).cast("string")), "chunk_line_start": 1 + i % 30, "chunk_line_end": 60 + i % 30})
    return O.normalised(placed).withColumn("confidence", F.round("confidence", 6))


IGNORE = ["/en/*", "!/en/6*", "FR/", "!fr/7*", "de/**", "!de/8*", "*.html", "es/?[0-4]*"]


@query(r"""with p as (select page_id, regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '') as path from pages)
select page_id, case when regexp_matches(path, '(^|/)fr/') then true when regexp_matches(path, '(?i)\.html/?$') or regexp_matches(path, '\.html/') then true when regexp_matches(path, '^de/8[^/]*/?$') then false when regexp_matches(path, '^de/.') then true
  when regexp_matches(path, '^en/6[^/]*(/.*)?$') then false when regexp_matches(path, '^en/[^/]') then true when regexp_matches(path, '^es/[^/][0-4][^/]*(/.*)?$') then true else false end as ignored from p""")
def gitignore_match(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/", ""), "[?#].*$", "")
    pages = _t(spark, d, "pages").select("page_id", F.concat(F.when(F.col("page_id") % 2 == 0, "./").otherwise("/"), path).alias("path"))
    return pages.select("page_id", ignore.is_ignored(F.col("path"), IGNORE).alias("ignored"))


@query(r"""with p as (select page_id, regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '/?([?#].*)?$', '') as path from pages),
s as (select page_id, string_split(lower(path), '/') as names from p),
u as (select page_id, unnest(range(1, len(names) + 1)) as k, names from s), f as (select page_id, array_to_string(names[1:k], '/') as step from u),
r as (select lower(path) as step, arg_max(page_id % 3 = 0, page_id) as negated from p group by 1),
g as (select distinct page_id from f join r using (step) where not negated)
select p.page_id, g.page_id is not null as ignored from p left join g using (page_id)""")
def gitignore_table(spark, d):
    """A rule for each page, in order of page_id: its path is left out, or brought back by every third."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/", ""), "/?([?#].*)?$", "")
    pages = _t(spark, d, "pages").select("page_id", path.alias("path"))
    lines = pages.select(F.col("page_id").alias("no"), F.concat(F.when(F.col("page_id") % 3 == 0, "!/").otherwise("/"), F.upper("path")).alias("line"))
    bad = ignore.ignored_by(pages, lines).withColumn("ignored", F.lit(True))
    return pages.join(bad, "path", "left").select("page_id", F.coalesce("ignored", F.lit(False)).alias("ignored"))


@query("""with b as (select doc_id, quality, toxic, doc_id % 11 as m from labels)
select doc_id, coalesce(m <> 0 and m <> 1 and m <> 2 and m <> 3 and m <> 4 and m <> 5 and m <> 6, false) as is_valid from b""")
def finding_validation(spark, d):
    """Rows of which each of seven kinds breaks one rule: category, severity, title, order of lines, order of columns, confidence, a null."""
    m = F.col("doc_id") % 11
    line = (F.col("doc_id") + 1 + F.col("quality")).cast("int")
    raw = _t(spark, d, "labels").select(
        "doc_id", F.lit("ai").alias("source"), F.lit("rule").alias("rule_id"), F.when(m == 1, "info").otherwise("low").alias("severity"), F.when(m == 0, "style").otherwise("security").alias("category"), F.when(m == 2, "").otherwise("t").alias("title"), F.lit("m").alias("message"), F.when(m == 6, None).otherwise("p").alias("rel_path"),
        line.alias("line_start"), F.when(m == 4, 5).otherwise(1).alias("column_start"), F.when(m == 3, line - 1).otherwise(line).alias("line_end"), F.lit(2).alias("column_end"), F.lit(False).alias("fixable"), F.when(m == 5, 1.5).when(m == 7, None).otherwise(0.5).alias("confidence"),
    )
    return raw.select("doc_id", O.is_valid().alias("is_valid"))


SAID = ["Incorrect API key provided", "Quota exceeded for org", "Too Many Requests", "request TIME OUT", "socket hang up", "fetch failed", "did not match schema", "Failed to parse", "bad JSON", "getaddrinfo ENOTFOUND", "timed out", "api key", "rate limit"]
NAMED = ["ZodError", "APIConnectionError", "TimeoutError", "RateLimitError", "PermissionDeniedError", "Error"]


@query(f"""with r as (select conv_id, turn, {SAID}[(conv_id + turn) % 13 + 1] as said, case when (conv_id + 3 * turn) % 11 < 6 then {NAMED}[(conv_id + 3 * turn) % 11 + 1] end as named, case (conv_id + 5 * turn) % 17 when 0 then 401 when 1 then 403 when 2 then 429 when 3 then 408 when 4 then 500 end as status from conversations)
select conv_id, turn, case when coalesce(status in (401, 403), false) or coalesce(named = 'PermissionDeniedError', false) or said = 'Incorrect API key provided' then 'authentication'
  when coalesce(status = 429, false) or coalesce(named = 'RateLimitError', false) or said in ('Quota exceeded for org', 'Too Many Requests', 'rate limit') then 'rate-limit' when coalesce(named = 'TimeoutError', false) or said in ('request TIME OUT', 'timed out') then 'timeout'
  when coalesce(named = 'APIConnectionError', false) or said in ('socket hang up', 'fetch failed', 'getaddrinfo ENOTFOUND') then 'network' when coalesce(named = 'ZodError', false) or said in ('did not match schema', 'Failed to parse') then 'invalid-response' else 'provider-error' end as kind from r""")
def error_kinds(spark, d):
    i, t = F.col("conv_id"), F.col("turn")
    said = F.get(F.array(*map(F.lit, SAID)), ((i + t) % 13).cast("int"))
    named = F.get(F.array(*map(F.lit, NAMED)), ((i + 3 * t) % 11).cast("int"))
    status = F.get(F.array(*map(F.lit, (401, 403, 429, 408, 500))), ((i + 5 * t) % 17).cast("int"))
    return _t(spark, d, "conversations").select("conv_id", "turn", T.error_kind(status, named, said).alias("kind"))


@query("select o_orderstatus, o_orderpriority, count(*) as n from (select o_orderstatus, o_orderpriority from orders where o_totalprice > 100000 union all select o_orderstatus, o_orderpriority from orders where o_orderdate < '1995-01-01') group by 1, 2")
def union_all_groups(spark, d):
    o = _t(spark, d, "orders")
    both = o.where("o_totalprice > 100000").select("o_orderstatus", "o_orderpriority").unionByName(o.where("o_orderdate < timestamp_ntz'1995-01-01'").select("o_orderstatus", "o_orderpriority"))
    return both.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("with a as (select distinct l_suppkey as node from lineitem), b as (select distinct c_nationkey::bigint as node from customer) select node, 'except' as kind from (select node from a except select node from b) union all select node, 'both' from (select node from a intersect select node from b)")
def difference_and_intersection(spark, d):
    a = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"))
    b = _t(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("node"))
    return a.subtract(b).withColumn("kind", F.lit("except")).unionByName(a.intersect(b).withColumn("kind", F.lit("both")))


@query("select page_id, regexp_extract(html, '<script>(.*?)</script>', 1) as script, len(regexp_extract_all(regexp_extract(html, '<script>(.*?)</script>', 1), '\\b[A-Za-z_$][A-Za-z0-9_$]*\\(')) as n_calls from pages")
def inline_scripts(spark, d):
    script = F.regexp_extract("html", "<script>(.*?)</script>", 1)
    return _t(spark, d, "pages").select("page_id", script.alias("script")).select("page_id", "script", F.size(F.regexp_extract_all("script", F.lit(r"\b[A-Za-z_$][A-Za-z0-9_$]*\("), F.lit(0))).cast("long").alias("n_calls"))


@query(f"""with {LINES}, {RANGES}, scoped as (select * from found where exists (select 1 from r where r.rel_path = found.rel_path and found.line_start <= r."end" and found.line_start >= r.start))
select rel_path, line_start, rule_id, severity, message from scoped qualify row_number() over (partition by source, rule_id, rel_path, line_start, message order by emit_ord) = 1""")
def review(spark, d):
    """Findings, scope, deduplication and order, as a review runs them."""
    scoped = I.in_scope(_found(spark, d), _ranges(spark, d))
    return O.ordered(O.first_of_each(scoped, "emit_ord")).select("rel_path", "line_start", "rule_id", "severity", "message")
