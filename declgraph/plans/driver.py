"""Each kernel on ordinary tables, with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from declgraph.functions.signatures import loose_slots_equal, slot_counts
from declgraph.functions.text import build_matches, excludes_folder, excludes_substring
from declgraph.operators import kernels as K

#: Parts up to which lines meet them by a broadcast, which is exchanged in place of the lines.
FEW_PARTS = 3 << 19
#: Names that surely fit the dictionary of a Parquet column (1 MB, 4 bytes each beside the text).
NAMES = 1 << 16

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _need_have(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All orders' kinds of parts, all suppliers' kinds of parts; a line that was not returned counts as by value."""
    part = _t(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    part = F.broadcast(part) if part.count() <= FEW_PARTS else part
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", (F.col("l_returnflag") == "N").alias("by_value"))
    kinds = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return kinds.select(F.col("l_orderkey").alias("o_orderkey"), "p_brand", "p_size"), kinds.select("l_suppkey", "p_brand", "p_size", "by_value")


_NEED = """
req as (select distinct l_orderkey as o_orderkey, p_brand, p_size from lineitem join part on l_partkey = p_partkey),
have as (select distinct l_suppkey, p_brand, p_size, l_returnflag from lineitem join part on l_partkey = p_partkey),
need as (select o_orderkey, count(*) as n from req group by 1)"""
_DIVIDED = "select req.o_orderkey, h.l_suppkey, any_value(need.n) as n_required from req join (select distinct l_suppkey, p_brand, p_size from have{0}) h using (p_brand, p_size) join need on need.o_orderkey = req.o_orderkey group by 1, 2 having count(*) = any_value(need.n)"


@query(f"with {_NEED} {_DIVIDED.format('')}")
def implements_division(spark, d):
    req, have = _need_have(spark, d)
    return K.divide(req, have, "o_orderkey", "l_suppkey", ["p_brand", "p_size"])


@query(f"""with {_NEED}, v as ({_DIVIDED.format(" where l_returnflag = 'N'")}), p as ({_DIVIDED.format('')})
select p.o_orderkey, case when v.l_suppkey is null then '*' else '' end || cast(p.l_suppkey as varchar) as name from p left join v using (o_orderkey, l_suppkey)""")
def implements_modes(spark, d):
    req, have = _need_have(spark, d)
    names = [F.col("l_suppkey").cast("string").alias("name"), F.concat(F.lit("*"), F.col("l_suppkey").cast("string")).alias("starred")]
    shown = [F.when(F.col("by_value"), F.col("name")).otherwise(F.col("starred")).alias("name")]
    return K.divide(req, have, "o_orderkey", "l_suppkey", ["p_brand", "p_size"], flag="by_value", about=names, at_once=NAMES // 2, shown=shown).select("o_orderkey", "name")


@query("""with have as (select distinct n_regionkey, p_brand, p_size % 4 as s from supplier join nation on n_nationkey = s_nationkey join lineitem on l_suppkey = s_suppkey join part on p_partkey = l_partkey where l_quantity >= 50),
need as (select distinct c_nationkey, p_brand, p_size % 4 as s from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where l_quantity >= 50 and o_orderpriority = '1-URGENT')
select c_nationkey, h.n_regionkey from need n join have h using (p_brand, s) group by 1, 2 having count(*) = (select count(*) from need n2 where n2.c_nationkey = n.c_nationkey)""")
def nation_division(spark, d):
    """Regions that offer in bulk every brand, in the size class, that a nation orders urgently in bulk."""
    bulk = _t(spark, d, "lineitem").where("l_quantity >= 50").join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_suppkey", "p_brand", (F.col("p_size") % 4).alias("s"))
    homes = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    urgent = _t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    req = bulk.join(urgent, F.col("l_orderkey") == F.col("o_orderkey"))
    return K.divide(req, bulk.join(homes, F.col("l_suppkey") == F.col("s_suppkey")), "c_nationkey", "n_regionkey", ["p_brand", "s"]).select("c_nationkey", "n_regionkey")


@query(f"""with {_NEED}, p as ({_DIVIDED.format('')}), l as (select l_suppkey, min(l_orderkey * 10 + l_linenumber) as location from lineitem group by 1)
select p.o_orderkey, p.l_suppkey, l.location from p join l using (l_suppkey)""")
def method_impl_locations(spark, d):
    req, have = _need_have(spark, d)
    first = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("location"))
    return K.divide(req, have, "o_orderkey", "l_suppkey", ["p_brand", "p_size"], about=first).select("o_orderkey", "l_suppkey", "location")


@query("select p_brand, string_agg(distinct cast(l_suppkey as varchar), ',' order by cast(l_suppkey as varchar)) as members from lineitem join part on l_partkey = p_partkey group by 1")
def inverted_index(spark, d):
    rows = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(_t(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return K.inverted_index(rows.withColumn("m", F.col("l_suppkey").cast("string")), "p_brand", "m").select("p_brand", F.array_join("members", ",").alias("members"))


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def exists_semi(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select p_partkey, p_name from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 49 and l_returnflag = 'R')")
def not_loaded_anti(spark, d):
    """Parts without a returned bulk line: most, not all."""
    loaded = _t(spark, d, "lineitem").where("l_quantity >= 49 and l_returnflag = 'R'").select("l_partkey")
    return _t(spark, d, "part").join(loaded, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


def _edges(part: DataFrame) -> DataFrame:
    p = part.select(F.col("p_partkey").alias("src"))
    both = p.select("src", F.expr("src div 2").alias("dst"), F.lit(0).alias("ord")).union(p.select("src", F.expr("src div 3").alias("dst"), F.lit(1).alias("ord")))
    return both.where("dst >= 1 and dst <> src")


_PATHS = """recursive n as (select p_partkey as src from part),
e as (select * from (select src, src // 2 as dst, 0 as ord from n union all select src, src // 3, 1 from n) where dst >= 1 and dst <> src),
r as (select src as root, src as node, 0 as depth, cast([] as integer[]) as path from n
      union all select r.root, e.dst, r.depth + 1, list_append(r.path, e.ord) from r join e on r.node = e.src),
f as (select root, p_type, depth, path, p_name from r join part on node = p_partkey)"""


@query(f"""with {_PATHS}, m as (select root, p_type, min(depth) as depth from f group by 1, 2)
select f.root, f.p_type, any_value(f.depth) as depth, count(*) as n, count(*) = 1 as callable from f join m on f.root = m.root and f.p_type = m.p_type and f.depth = m.depth group by 1, 2""")
def promotion_min_depth(spark, d):
    part = _t(spark, d, "part")
    nodes = K.reach(_edges(part), part.select(F.col("p_partkey").alias("root")))
    found = nodes.join(part.select(F.col("p_partkey").alias("node"), "p_type"), "node").withColumn("kind", F.lit("method"))
    return K.min_depth_unique(found, ["root"], "p_type").select("root", "p_type", "depth", "n", "callable")


@query(f"with {_PATHS} select root, p_type, arg_min(p_name, path) as p_name from f group by 1, 2")
def embed_first_wins(spark, d):
    part = _t(spark, d, "part")
    return K.closed_first_wins(_edges(part), part.select(F.col("p_partkey").alias("node"), "p_type", "p_name"), "p_type", "p_name")


@query("""with recursive r as (select p_partkey as name, p_partkey as cur from part where p_partkey >= 1
union all select name, cur // 2 from r where cur >= 4) select name, min(cur) as terminal from r group by 1""")
def alias_fixpoint(spark, d):
    p = _t(spark, d, "part").where("p_partkey >= 1").select(F.col("p_partkey").alias("name"))
    ends = K.fixpoint(p.where("name >= 4").select("name", F.expr("name div 2").alias("target")))
    return ends.union(p.where("name < 4").select("name", F.col("name").alias("terminal")))


@query(r"""with t as (select event_id, event_type as l, case when event_id % 3 = 0 then '' when event_id % 3 = 1 then event_type else 'view' end as r from events)
select event_id, l = r or r = '' as equal from t""")
def loose_equal(spark, d):
    """Slots with, without and with another qualifier: equal without it, and by it where both have one."""
    left = F.concat("event_type", F.lit(".T"))
    right = F.when(F.col("event_id") % 3 == 0, "T").when(F.col("event_id") % 3 == 1, left).otherwise("view.T")
    return _t(spark, d, "events").select("event_id", loose_slots_equal(F.array(left), F.array(right)).alias("equal"))


@query("select p_brand, p_size, count(distinct p_type) as n_slots from part group by 1, 2 having count(distinct p_type) >= 2")
def slot_divergence(spark, d):
    return K.slot_divergence(_t(spark, d, "part"), ["p_brand", "p_size"], "p_type")


@query("select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def dedupe_first_seen(spark, d):
    return K.dedupe_first(_t(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_overlay(spark, d):
    return K.latest_per_key(_t(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select page_id, case when url like '%/fr/%' or url like '%/de/%' then true else false end as excluded from pages")
def wildcard_exclude(spark, d):
    return _t(spark, d, "pages").select("page_id", excludes_folder(F.col("url"), ["fr", "d?"]).alias("excluded"))


@query("select c_custkey from customer where not (contains(c_name, '7') or contains(c_name, '13'))")
def substring_exclude(spark, d):
    return _t(spark, d, "customer").where(~excludes_substring(F.col("c_name"), ["7", "13"])).select("c_custkey")


@query("select event_id from events where coalesce((event_type = 'click' and (case when value > 50 then null else value > 10 end)) or event_type = 'view', true)")
def build_3vl(spark, d):
    e = _t(spark, d, "events")
    unknown = F.when(F.col("value") <= 50, F.col("value") > 10)
    return e.where(build_matches(((F.col("event_type") == "click") & unknown) | (F.col("event_type") == "view"))).select("event_id")


@query(r"select doc_id from documents where regexp_matches(text, '(?m)^\s*The\b') or regexp_matches(text, '\bof\s+the\b')")
def text_candidates(spark, d):
    return _t(spark, d, "documents").where(F.col("text").rlike(r"(?m)^\s*The\b") | F.col("text").rlike(r"\bof\s+the\b")).select("doc_id")


@query(r"""select token, count(*) as n_docs from (select distinct doc_id, unnest(regexp_extract_all(text, '(?:^|\s)([A-Za-z_][A-Za-z0-9_]*),', 1)) as token from documents)
where token not in ('the', 'of', 'and') group by 1""")
def token_index(spark, d):
    found = F.array_except(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:^|\s)([A-Za-z_][A-Za-z0-9_]*),"), 1)), F.array(*map(F.lit, ("the", "of", "and"))))
    return _t(spark, d, "documents").select(F.explode(found).alias("token")).groupBy("token").agg(F.count("*").alias("n_docs"))


@query("select doc_id, len(string_split(text, ',')) as arity from documents where text not like '%(%' and text not like '%[%' and text not like '%{%' and text not like '%)%' and text not like '%]%' and text not like '%}%'")
def arity_count(spark, d):
    """Slots of texts without brackets, by the splitter that minds brackets; empty slots count here."""
    plain = _t(spark, d, "documents").where(~F.col("text").rlike(r"[()\[\]{}]"))
    return slot_counts(plain, "doc_id", "text")


@query("select p_brand, p_name from part qualify row_number() over (partition by p_brand order by length(p_name) desc, p_name) = 1")
def anchor_top1(spark, d):
    return K.top1(_t(spark, d, "part"), ["p_brand"], "p_name", F.struct(-F.length("p_name"), "p_name"))


@query("select p_partkey from part where p_size < 10 union select p_partkey from part where p_type = 'ECONOMY'")
def union_strict_loose(spark, d):
    p = _t(spark, d, "part")
    return p.where("p_size < 10").select("p_partkey").union(p.where("p_type = 'ECONOMY'").select("p_partkey")).distinct()


@query("select doc_id, n_chars from documents except select doc_id, n_chars from documents where doc_id % 3 = 0")
def cache_anti_join(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "n_chars")
    return docs.join(docs.where("doc_id % 3 = 0"), ["doc_id", "n_chars"], "left_anti")


@query("select doc_id, n_chars from (select doc_id, n_chars, sum(n_chars) over (order by doc_id desc) as run, row_number() over (order by doc_id desc) as rn from documents) where run <= 1000000 and rn <= 4096")
def budget_evict(spark, d):
    return K.budget_evict(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 4096, 1_000_000)


@query("select cast((rn - 1) % 16 as integer) as shard, count(*) as n from (select row_number() over (order by o_orderkey) as rn from orders) group by 1")
def shard_round_robin(spark, d):
    ids = _t(spark, d, "orders").select("o_orderkey")
    ranged = ids.repartitionByRange("o_orderkey").withColumn("p", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("p").count()
    before = F.broadcast(sizes.select("p", F.coalesce(F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    rank = F.row_number().over(Window.partitionBy("p").orderBy("o_orderkey")) - 1
    return ranged.withColumn("r", rank).join(before, "p").groupBy(((F.col("before") + F.col("r")) % 16).cast("int").alias("shard")).agg(F.count("*").alias("n"))


@query(r"""with p as (select distinct regexp_extract(url, '^([a-z]+://[^/]*/[^/]*)', 1) as prefix from pages where page_id % 5 = 0 union select distinct regexp_extract(url, '^([a-z]+://[^/]*)', 1) from pages where page_id % 2 = 0)
select page_id, prefix from pages join p on prefix <> '' and (url = prefix or starts_with(url, prefix || '/')) qualify row_number() over (partition by page_id order by length(prefix) desc) = 1""")
def longest_prefix(spark, d):
    pages = _t(spark, d, "pages").select("page_id", "url")
    take = lambda rows, r: rows.select(F.regexp_extract("url", r, 1).alias("prefix"))
    prefixes = take(pages.where("page_id % 5 = 0"), r"^([a-z]+://[^/]*/[^/]*)").union(take(pages.where("page_id % 2 = 0"), r"^([a-z]+://[^/]*)")).where("prefix <> ''")
    return K.longest_prefix(pages, "url", prefixes, "prefix", ["page_id"])


@query(r"""with h as (select distinct regexp_extract(url, '^([a-z]+://[^/]*)', 1) as home from pages where page_id % 2 = 0 union select distinct regexp_extract(url, '^([a-z]+://[^/]*/[a-z]+)', 1) from pages where page_id % 3 = 0)
select page_id, home from pages join h on home <> '' and (url = home or starts_with(url, home || '/')) qualify row_number() over (partition by page_id order by length(home) desc) = 1""")
def nearest_ancestor(spark, d):
    pages = _t(spark, d, "pages").select("page_id", "url")
    home = lambda rows, r: rows.select(F.regexp_extract("url", r, 1).alias("home"))
    homes = home(pages.where("page_id % 2 = 0"), r"^([a-z]+://[^/]*)").union(home(pages.where("page_id % 3 = 0"), r"^([a-z]+://[^/]*/[a-z]+)")).where("home <> ''")
    return K.nearest_ancestor(pages, "url", homes, "home", ["page_id"])
