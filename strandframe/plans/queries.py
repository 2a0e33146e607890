"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import clustering, filters, joins, nested, sinks
from ..session import shared_folder, table
from ..sources import formats
from . import composites

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Rules and keywords for part names, whose words are colours and materials.
PART_RULES = [("almond", "G_Almond"), ("blush", "G_Blush"), ("steel", "G_Steel"), ("green", "G_Green"), ("red", "G_Red"), ("widget", "G_Widget")]
PART_KEYWORDS = ["steel", "widget", "green"]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _round(c, n: int = 4):
    return F.round(c, n)


@query("""SELECT event_type, count(*) AS total_gene, round(sum(value), 4) AS total_r, round(sum(value) / count(*), 4) AS average_r,
  round(sum(1.0 / (abs(value) + 1)) * count(*) * count(*) / (SELECT count(*) FROM events) * 100, 4) AS score FROM events GROUP BY 1""")
def proximity_score(spark, d):
    e = A.proximity_score(table(spark, d, "events"), "event_type", "value")
    return e.select("event_type", "total_gene", *[_round(F.col(c)).alias(c) for c in ("total_r", "average_r", "score")])


@query("""SELECT event_type, round(count(*) / (sum(value) + 1e-6) * count(*) * count(*) / (SELECT count(*) FROM events) * 100, 4) AS readme_score FROM events GROUP BY 1""")
def readme_score(spark, d):
    return A.proximity_score(table(spark, d, "events"), "event_type", "value").select("event_type", _round(F.col("readme_score")).alias("readme_score"))


@query("""SELECT event_type, user_id, count(*) AS total_gene, string_agg(event_id::VARCHAR, ',' ORDER BY event_id::VARCHAR) AS products FROM events GROUP BY 1, 2""")
def group_stats(spark, d):
    e = table(spark, d, "events").withColumn("product", F.col("event_id").cast("string"))
    s = A.proximity_score(e, "event_type", "value", ["user_id"], "product")
    return s.select("event_type", "user_id", "total_gene", F.array_join("products", ",").alias("products"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1""")
def best_hit(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return A.best_hit(li, ["l_orderkey"], [F.col(c) for c in ("l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey")])


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount FROM lineitem WHERE l_discount < 0.02")
def threshold_lt(spark, d):
    return filters.threshold(table(spark, d, "lineitem"), "l_discount", 0.02, False).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <= 2")
def threshold_le(spark, d):
    return filters.threshold(table(spark, d, "lineitem"), "l_quantity", 2.0, True).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <= 5 AND l_shipdate IS NOT NULL AND l_tax IS NOT NULL""")
def conjunctive_filter(spark, d):
    return filters.conjunctive(table(spark, d, "lineitem"), {"l_returnflag": "R"}, {"l_quantity": 5.0}, ["l_shipdate", "l_tax"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT count(*) AS n FROM lineitem")
def count_all(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def not_equal_list(spark, d):
    return filters.not_in(table(spark, d, "orders"), "o_orderstatus", ["F", "P"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%'")
def prefix_filter(spark, d):
    return filters.starts_with(table(spark, d, "orders"), "o_orderpriority", "1").select("o_orderkey")


@query("SELECT p_partkey, CASE WHEN starts_with(p_type, 'A') THEN 'a' ELSE 'other' END AS route FROM part")
def route_by_content(spark, d):
    yes, no = filters.route(table(spark, d, "part"), F.col("p_type").startswith("A"))
    return yes.select("p_partkey", F.lit("a").alias("route")).unionByName(no.select("p_partkey", F.lit("other").alias("route")))


@query("SELECT d.doc_id, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels USING (doc_id)")
def default_value(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return filters.with_defaults(joined, {"quality": -1})


def _case(rules, column="lower(p_name)"):
    return "CASE " + " ".join(f"WHEN contains({column}, '{k}') THEN '{g}'" for k, g in rules)


@query(f"SELECT g AS product_group, count(*) AS n FROM (SELECT {_case(PART_RULES)} ELSE p_name END AS g FROM part) GROUP BY 1")
def keyword_classify(spark, d):
    return table(spark, d, "part").select(S.keyword_classify(F.col("p_name"), PART_RULES, F.col("p_name")).alias("product_group")).groupBy("product_group").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, {' OR '.join(f'''contains(lower(p_name), '{k}')''' for k in PART_KEYWORDS)} AS hit FROM part")
def any_keyword_contains(spark, d):
    return table(spark, d, "part").select("p_partkey", S.any_keyword(F.col("p_name"), PART_KEYWORDS).alias("hit"))


@query("SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1")
def frequency_desc(spark, d):
    return A.frequency_desc(table(spark, d, "part"), F.lower("p_name"), "name")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(p_name, '\\s+')) AS word FROM part) WHERE word <> '' GROUP BY 1")
def word_frequency(spark, d):
    return A.word_frequency(table(spark, d, "part"), F.col("p_name"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2")
def group_size(spark, d):
    return A.group_size(table(spark, d, "part"), ["p_brand", "p_type"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def semi_join_in_list(spark, d):
    return joins.semi_join(table(spark, d, "orders"), table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_existing(spark, d):
    return joins.anti_join(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).select("doc_id", "n_chars")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_if_absent(spark, d):
    return sinks.insert_if_absent(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id", [F.col("source")])


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def dict_join(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.lookup_join(table(spark, d, "customer"), nation, ["c_nationkey"], "inner").select("c_custkey", "n_name")


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def distinct_lookup_join(spark, d):
    keys = table(spark, d, "supplier").select("s_nationkey").distinct()
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    found = keys.join(n, keys.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_nationkey", "n_name", "r_name")
    return joins.lookup_join(table(spark, d, "supplier"), found, ["s_nationkey"]).select("s_suppkey", "n_name", "r_name")


@query("SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def nested_loop_equi(spark, d):
    o = filters.conjunctive(table(spark, d, "orders"), {"o_orderstatus": "P"}, {}, [])
    return o.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""WITH p AS (SELECT a.event_id, a.user_id, b.event_id AS error_id, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS dist FROM events a JOIN events b
  ON a.user_id = b.user_id WHERE a.event_type = 'purchase' AND b.event_type = 'error' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000)
  SELECT user_id, event_id, error_id, dist AS distance FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, error_id) AS n FROM p) WHERE n = 1""")
def nearest_join(spark, d):
    e = table(spark, d, "events").withColumn("at", _micros("ts"))
    left = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("at").alias("p_at"))
    right = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("at").alias("e_at"))
    hour = 3_600_000_000
    near = joins.nearest_join(left, right, ["user_id"], ["event_id", "p_at"], F.abs(F.col("p_at") - F.col("e_at")), ["error_id"], hour, ("p_at", "e_at", hour))
    return near.select("user_id", "event_id", "error_id", "distance")


@query("""SELECT a.user_id, a.event_id, b.event_id AS near_id, CASE WHEN b.ts < a.ts THEN 'left' ELSE 'right' END AS side,
  CASE WHEN b.ts < a.ts THEN epoch_us(a.ts) - epoch_us(b.ts) ELSE epoch_us(b.ts) - epoch_us(a.ts) END AS gap FROM events a JOIN events b ON a.user_id = b.user_id
  WHERE a.event_type = 'purchase' AND b.event_type NOT IN ('view', 'purchase') AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 7200000000""")
def window_proximity(spark, d):
    e = table(spark, d, "events").withColumn("at", _micros("ts"))
    targets = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("at").alias("t_at"), F.col("at").alias("t_end"))
    features = e.where("event_type NOT IN ('view', 'purchase')").select("user_id", F.col("event_id").alias("near_id"), F.col("at").alias("f_at"), F.col("at").alias("f_end"))
    return joins.window_proximity(targets, features, ["user_id"], ("t_at", "t_end"), ("f_at", "f_end"), 7_200_000_000).select("user_id", "event_id", "near_id", "side", "gap")


@query("SELECT p_partkey, greatest(0, p_size - 10) AS low, least(50, p_size + 20 + 10) AS high FROM part")
def clamp_window(spark, d):
    low, high = S.clamp_window(F.col("p_size"), F.col("p_size") + 20, F.lit(50), 10)
    return table(spark, d, "part").select("p_partkey", low.alias("low"), high.alias("high"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, round(greatest(0, least(a.p_size, b.p_size) + 20 - greatest(a.p_size, b.p_size)) * 100.0 /
  (greatest(a.p_size, b.p_size) + 20 - least(a.p_size, b.p_size)), 4)::DOUBLE AS overlap FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey""")
def overlap_pct(spark, d):
    """All pairs of a block, as its SQL: parts of one size are a class."""
    start, other = F.col("p_size_a"), F.col("p_size_b")
    # As in SQL, two unknown sizes have no overlap; of one size alone greatest and least make the hull.
    values = {"overlap": F.when(F.coalesce(start, other).isNotNull(), _round(S.overlap_percent(start, start + 20, other, other + 20)))}
    p = joins.pairs_by_class(table(spark, d, "part"), "p_partkey", ["p_brand", "p_type"], ["p_size"], values)
    return p.select(F.col("p_partkey_a").alias("a"), F.col("p_partkey_b").alias("b"), *values)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2, 3""")
def interval_exact_join(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    left = li.select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    return joins.interval_exact_join(left, li, ["l_orderkey", "l_linenumber", "l_partkey"], [], ["l_suppkey"])


@query("SELECT user_id, round(count(*) FILTER (WHERE event_type = 'purchase') * 100.0 / count(*), 4)::DOUBLE AS percent FROM events GROUP BY 1")
def category_percentage(spark, d):
    return A.category_percentage(table(spark, d, "events"), ["user_id"], F.col("event_type") == "purchase").select("user_id", _round(F.col("percent")).alias("percent"))


@query("""WITH c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS u, count(*) FILTER (WHERE length(text) > 200) AS l, count(*) AS n FROM conversations GROUP BY 1)
  SELECT count(*) AS documents, count(*) FILTER (WHERE n > 0) AS non_empty, count(*) FILTER (WHERE u > 0) AS user_documents, sum(u)::BIGINT AS user_items,
  count(*) FILTER (WHERE l > 0) AS long_documents, sum(l)::BIGINT AS long_items FROM c""")
def doc_flag_counts(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.length("text").alias("n"))).alias("turns"))
    return A.document_flags(c, "turns", {"user": lambda t: t["role"] == "user", "long": lambda t: t["n"] > 200})


@query("""SELECT sum(s)::BIGINT AS matching_items, count(*) FILTER (WHERE s > 0) AS matching_documents FROM
  (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS s FROM conversations GROUP BY 1)""")
def item_vs_doc_counts(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    out = A.document_flags(c, "roles", {"m": lambda r: r == "assistant"})
    return out.select(F.col("m_items").alias("matching_items"), F.col("m_documents").alias("matching_documents"))


@query("SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS position, round(unnest(embedding)::DOUBLE, 5) + 0.0::DOUBLE AS value FROM embeddings")
def explode_array(spark, d):
    return nested.explode_array(table(spark, d, "embeddings"), "embedding", ["vec_id"]).select("vec_id", "position", (F.round(F.col("value").cast("double"), 5) + F.lit(0.0)).alias("value"))


@query("SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM conversations WHERE role = 'user' GROUP BY 1")
def array_filter_then_flatten(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    flat = nested.filter_flatten(F.col("t"), lambda x: x["role"] == "user", lambda x: F.array(x["turn"].cast("string")))
    return c.select("conv_id", F.array_join(flat, ",").alias("turns")).where("turns <> ''")


@query("""SELECT c.conv_id, coalesce(min(text) FILTER (WHERE turn = 2), min(text) FILTER (WHERE turn = 0), 'N/A') AS text FROM conversations c GROUP BY 1""")
def nested_get_default(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("turn", "text"))).alias("m"))
    return c.select("conv_id", nested.get_or("N/A", F.try_element_at("m", F.lit(2).cast("long")), F.try_element_at("m", F.lit(0).cast("long"))).alias("text"))


_SHARE = """WITH g AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2), s AS (SELECT p_type,
  CASE WHEN n / sum(n) OVER (PARTITION BY p_type) >= 0.04 THEN p_brand ELSE 'Other' END AS p_brand, n FROM g), r AS (SELECT p_type, p_brand, sum(n)::BIGINT AS n FROM s GROUP BY 1, 2)"""


@query(_SHARE + " SELECT * FROM r")
def share_bucket(spark, d):
    return A.share_bucket(A.group_size(table(spark, d, "part"), ["p_type", "p_brand"]), ["p_type"], "p_brand", "n", 0.04)


@query(_SHARE + " SELECT p_brand, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def regroup_sum(spark, d):
    return share_bucket(spark, d).groupBy("p_brand").agg(F.sum("n").alias("n"))


@query(_SHARE + """, nodes AS (SELECT side, label, row_number() OVER (ORDER BY side, label) - 1 AS node FROM (SELECT DISTINCT 0 AS side, p_type AS label FROM r UNION SELECT DISTINCT 1, p_brand FROM r))
  SELECT a.node::INTEGER AS source_id, b.node::INTEGER AS target_id, p_type, p_brand, n AS value FROM r JOIN nodes a ON a.side = 0 AND a.label = p_type JOIN nodes b ON b.side = 1 AND b.label = p_brand""")
def sankey_links(spark, d):
    return A.sankey(table(spark, d, "part"), "p_type", "p_brand", 0.04, ["p_type"])


@query("""WITH l AS (SELECT p_partkey, p_brand, log10(p_retailprice + 1e-6) AS v FROM part) SELECT p_partkey, round(coalesce((v - min(v) OVER w) /
  nullif(max(v) OVER w - min(v) OVER w, 0), 0), 6) AS scaled FROM l WINDOW w AS (PARTITION BY p_brand)""")
def minmax_scale(spark, d):
    return A.minmax_scale(table(spark, d, "part"), ["p_brand"], S.log10_eps(F.col("p_retailprice")), "scaled").select("p_partkey", F.round("scaled", 6).alias("scaled"))


@query("SELECT p_partkey, round(log10(p_retailprice + 1e-6), 6) AS logged FROM part")
def log10_eps(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(S.log10_eps(F.col("p_retailprice")), 6).alias("logged"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in _TYPES) + " FROM events GROUP BY 1")
def pivot(spark, d):
    return nested.pivot_matrix(table(spark, d, "events"), "user_id", "event_type", F.count(F.lit(1)), _TYPES)


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x - list_max(embedding::DOUBLE[]))), 3) AS centred FROM embeddings")
def row_max_center(spark, d):
    v = nested.array_max_center(F.col("embedding").cast("array<double>"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda t, x: t + x), 3).alias("centred"))


def _names(spark, d):
    return joins.self_pairs(table(spark, d, "part").select("p_name").distinct(), "p_name")


_NAMES = "WITH n AS (SELECT DISTINCT p_name FROM part), q AS (SELECT a.p_name AS a, b.p_name AS b FROM n a JOIN n b ON a.p_name < b.p_name) "
_PDIST = "round(list_sum(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: CASE WHEN substr(a, i, 1) <> substr(b, i, 1) THEN 1 ELSE 0 END)) / least(length(a), length(b)), 6)::DOUBLE"


@query(_NAMES + f"SELECT a, b, {_PDIST} AS distance FROM q")
def p_distance(spark, d):
    return _names(spark, d).select(F.col("p_name_a").alias("a"), F.col("p_name_b").alias("b"), F.round(S.p_distance(F.col("p_name_a"), F.col("p_name_b")), 6).alias("distance"))


@query(_NAMES + f"SELECT round(avg({_PDIST}), 4) AS mean_distance, count(*) AS pairs FROM q")
def mean_pairwise(spark, d):
    """Counts of letters instead of pairs."""
    return A.mean_p_distance(table(spark, d, "part").select("p_name").distinct(), "p_name").select(_round(F.col("mean_distance")).alias("mean_distance"), "pairs")


@query(_NAMES + "SELECT a, b FROM q")
def self_pairs(spark, d):
    return _names(spark, d).select(F.col("p_name_a").alias("a"), F.col("p_name_b").alias("b"))


@query(_NAMES + "SELECT a, b, round(1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b)), 6)::DOUBLE AS similarity FROM q")
def fuzzy_similarity(spark, d):
    return _names(spark, d).select(F.col("p_name_a").alias("a"), F.col("p_name_b").alias("b"), F.round(S.levenshtein_similarity(F.col("p_name_a"), F.col("p_name_b")), 6).alias("similarity"))


@query("SELECT p_partkey, nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS brand_no FROM part")
def regex_extract(spark, d):
    return table(spark, d, "part").select("p_partkey", S.regex_extract(F.col("p_brand"), r"(\d+)").alias("brand_no"))


@query("SELECT c_custkey, nullif(split_part(c_name, '#', 2), '') AS part2 FROM customer")
def split_part(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.split_part(F.col("c_name"), "#", 2).alias("part2"))


@query("SELECT p_partkey, string_split_regex(p_name, '[-/ ]')[1] AS token FROM part")
def first_token(spark, d):
    return table(spark, d, "part").select("p_partkey", S.first_token(F.col("p_name")).alias("token"))


@query("SELECT p_partkey, replace(replace(p_name, 'e', '-'), 'a', '-') AS name FROM part")
def char_replace(spark, d):
    return table(spark, d, "part").select("p_partkey", S.char_replace(F.col("p_name"), "ea", "--").alias("name"))


@query("SELECT page_id, nullif(split_part(url, '/', 3), '') AS host FROM pages")
def header_parse(spark, d):
    """The host as the contig of a record header."""
    header = F.concat(F.lit("PAGE | x | 1-2 | "), F.coalesce(S.split_part(F.col("url"), "/", 3), F.lit("")))
    return table(spark, d, "pages").select("page_id", S.absent_to_null(S.header_parse(header)["contig"]).alias("host"))


@query("""SELECT page_id, CASE WHEN len(string_split(url, '/')) > 3 THEN array_to_string(string_split(url, '/')[1:3], '/') END AS base FROM pages""")
def prefix_join(spark, d):
    return table(spark, d, "pages").select("page_id", S.prefix_join(F.col("url"), "/", 3).alias("base"))


@query("SELECT page_id, coalesce(string_split(url, '/')[1], '') AS l1, coalesce(string_split(url, '/')[3], '') AS l2, coalesce(string_split(url, '/')[7], '') AS l3 FROM pages")
def lineage_levels(spark, d):
    parts = S.lineage_levels(F.col("url"), [f"x{i}" for i in range(1, 8)], "/")
    return table(spark, d, "pages").select("page_id", *parts).select("page_id", F.col("x1").alias("l1"), F.col("x3").alias("l2"), F.col("x7").alias("l3"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Final' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS status FROM orders")
def map_replace(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.map_replace(F.col("o_orderstatus"), {"F": "Final", "O": "Open"}).alias("status"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ((l_orderkey + l_partkey) // 2)::BIGINT AS middle FROM lineitem")
def midpoint(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.midpoint(F.col("l_orderkey"), F.col("l_partkey")).alias("middle"))


@query("""WITH c AS (SELECT o_orderkey, max(o_totalprice) * 2 AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
  SELECT o_orderkey, coalesce(p, o_totalprice) AS o_totalprice FROM orders LEFT JOIN c USING (o_orderkey)
  UNION ALL SELECT -o_orderkey - 1, max(o_totalprice) FROM orders WHERE o_orderstatus = 'P' GROUP BY 1""")
def upsert_subdocument(spark, d):
    """Into all orders: new prices for the keys of one status, and new orders made of those of another; changes have unique keys."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    highest = lambda status, factor: o.where(F.col("o_orderstatus") == status).groupBy("o_orderkey").agg((F.max("o_totalprice") * factor).alias("o_totalprice"))
    changed, added = highest("F", 2), highest("P", 1).withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return sinks.upsert(o.select("o_orderkey", "o_totalprice"), changed.unionByName(added), "o_orderkey", ["o_totalprice"])


@query("SELECT coalesce(nullif(split_part(c_name, '#', 2), ''), c_name) AS c_name, c_acctbal FROM customer")
def rekey(spark, d):
    return sinks.rekey(table(spark, d, "customer").select("c_name", "c_acctbal"), "c_name", S.split_part(F.col("c_name"), "#", 2))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_decode(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit(spark, d):
    return filters.first_rows(table(spark, d, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def top1(spark, d):
    return filters.first_rows(table(spark, d, "orders"), ["o_totalprice", "o_orderkey"], 1).select("o_orderkey", "o_totalprice")


@query("SELECT DISTINCT p_type FROM part")
def distinct_values(spark, d):
    return table(spark, d, "part").select("p_type").distinct()


@query("SELECT sum(length(p_name))::BIGINT AS total FROM part")
def sum_length(spark, d):
    return table(spark, d, "part").agg(F.sum(F.length("p_name")).alias("total"))


@query("SELECT min(p_retailprice) AS low, max(p_retailprice) AS high FROM part")
def min_max(spark, d):
    return table(spark, d, "part").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


@query("""SELECT user_id, CASE WHEN a > b THEN 'first' WHEN b > a THEN 'second' ELSE 'equal' END AS verdict FROM (SELECT user_id,
  coalesce(avg(value) FILTER (WHERE event_type = 'click'), 0) AS a, coalesce(avg(value) FILTER (WHERE event_type = 'view'), 0) AS b FROM events GROUP BY 1)""")
def compare_two_means(spark, d):
    mean = lambda kind: F.coalesce(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0))
    return table(spark, d, "events").groupBy("user_id").agg(mean("click").alias("a"), mean("view").alias("b")).select("user_id", A.compare_means(F.col("a"), F.col("b")).alias("verdict"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_all(spark, d):
    named = lambda t, k, n: table(spark, d, t).select(F.col(k).alias("id"), F.col(n).alias("name"))
    return named("customer", "c_custkey", "c_name").unionByName(named("supplier", "s_suppkey", "s_name"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' THEN 'main' ELSE 'rest' END AS part FROM lineitem")
def partition_by_tag(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    a, b = filters.route(table(spark, d, "lineitem"), F.col("l_returnflag") == "A")
    return a.select(*keys, F.lit("main").alias("part")).unionByName(b.select(*keys, F.lit("rest").alias("part")))


@query("SELECT d.doc_id, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def merge_structs(spark, d):
    base = table(spark, d, "documents").select("doc_id", F.lit(0).alias("quality"))
    return joins.merge_structs(base, table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"])


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def map_group_build(spark, d):
    return nested.map_group_last(table(spark, d, "events"), ["user_id", "event_type"], "event_id", [F.col("ts"), F.col("event_id")])


@query("SELECT page_id, concat('>', page_id, ' | ', url, chr(10), length(html)) AS record FROM pages")
def sink_fasta(spark, d):
    """Written as a file, and put together again from what its reader finds."""
    path, header = shared_folder(spark), F.concat_ws(" | ", F.col("page_id").cast("string"), "url")
    sinks.write_fasta(table(spark, d, "pages").select("page_id", header.alias("h"), F.length("html").cast("string").alias("s")), path, "h", "s", ["page_id"])
    back = formats.scan_fasta(spark, path)
    return back.select(F.split_part("header", F.lit(" | "), F.lit(1)).cast("long").alias("page_id"), sinks.fasta_lines(F.col("header"), F.col("seq")).alias("record"))


@query("SELECT p_type, p_brand, p_partkey, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS n FROM part")
def running_number(spark, d):
    n = F.row_number().over(Window.partitionBy("p_type", "p_brand").orderBy("p_partkey"))
    return table(spark, d, "part").select("p_type", "p_brand", "p_partkey", n.cast("long").alias("n"))


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name NULLS FIRST, p_partkey NULLS FIRST) - 1 AS place FROM part")
def number_rows(spark, d):
    """The place of every part in the order of names, over sorted ranges."""
    return A.numbered(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], "place")


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view') AND props IS NOT NULL")
def type_in(spark, d):
    present = filters.conjunctive(table(spark, d, "events"), {}, {}, ["props"])
    return present.where(F.col("event_type").isin("click", "view")).select("event_id", "user_id")


@query("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size + 5 <= 30")
def within_window(spark, d):
    ranges = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_size") + 5).alias("p_end"))
    return filters.within(ranges, "p_size", "p_end", 10, 30).select("p_partkey")


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN b.p_size < a.p_size THEN 'left' ELSE 'right' END AS side,
  CASE WHEN b.p_size < a.p_size THEN a.p_size - (b.p_size + 20) ELSE b.p_size - (a.p_size + 20) END AS gap
  FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey""")
def signed_gap(spark, d):
    """All pairs of a block, as its SQL: parts of one size are a class."""
    start, other = F.col("p_size_a"), F.col("p_size_b")
    values = {"side": S.side(start, other), "gap": S.signed_gap(start, start + 20, other, other + 20)}
    p = joins.pairs_by_class(table(spark, d, "part"), "p_partkey", ["p_brand", "p_type"], ["p_size"], values)
    return p.select(F.col("p_partkey_a").alias("a"), F.col("p_partkey_b").alias("b"), *values)


@query("SELECT p_partkey, concat(p_brand, '_', p_partkey, '_', split_part(p_name, ' ', 1)) AS header FROM part")
def rename_header(spark, d):
    return table(spark, d, "part").select("p_partkey", S.rename_header(F.col("p_name"), F.col("p_brand"), F.col("p_partkey")).alias("header"))


@query("SELECT p_partkey, concat(p_brand, ' | ', p_name, ' | ', p_size, '-', p_size + 20, ' | ', p_type) AS header FROM part")
def header_compose(spark, d):
    return table(spark, d, "part").select("p_partkey", S.header_compose(F.col("p_brand"), F.col("p_name"), F.col("p_size"), F.col("p_size") + 20, F.col("p_type")).alias("header"))


@query("SELECT c_custkey, c_name AS stem FROM customer")
def strip_extension(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.strip_extension(F.concat("c_name", F.lit(".fasta"))).alias("stem"))


@query("SELECT p_partkey, p_brand AS dim_group, p_type AS dim_value FROM part")
def filename_to_dims(spark, d):
    dims = S.filename_to_dims(F.concat_ws("_", "p_brand", "p_type", F.lit("rest.csv")))
    return table(spark, d, "part").select("p_partkey", dims["group"].alias("dim_group"), dims["value"].alias("dim_value"))


@query("SELECT conv_id, max(turn) FILTER (WHERE turn = m) AS turn FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY 1")
def first_element(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return c.select("conv_id", F.try_element_at("turns", F.lit(1)).alias("turn"))


@query("SELECT conv_id, string_agg(upper(role), ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def array_project(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return c.select("conv_id", F.array_join(F.transform("t", lambda x: F.upper(x["role"])), ",").alias("roles"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def transpose(spark, d):
    """The matrix of `pivot` as rows again; cells without events were 0."""
    return pivot(spark, d).unpivot("user_id", _TYPES, "event_type", "n").where("n > 0")


@query("SELECT p_partkey, printf('%.2f', p_retailprice) AS price FROM part")
def sink_csv_float2(spark, d):
    path = shared_folder(spark)
    sinks.write_csv(table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price")), path, two_decimals=["price"])
    return formats.scan_csv(spark, path, "p_partkey bigint, price string")


def _likeness_sql(a: str, b: str) -> str:
    return f"(1 - levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b}))::DOUBLE)"


def _grouped_sql(table_: str, scope: str, name: str, position: str, rule: str) -> str:
    """CTEs that end in grouped(scope, name, group): greedy leaders in one pass over the names, then the best leader of each."""
    return f"""WITH RECURSIVE stats AS (SELECT {scope} AS s, {name} AS t, min({position}) AS f, max({position}) AS l FROM {table_} WHERE {name} IS NOT NULL GROUP BY 1, 2),
      ruled AS (SELECT *, {rule} AS r FROM stats),
      free AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY f, t) AS n FROM ruled WHERE r IS NULL),
      walk(s, n, founders) AS (
        SELECT s, n, [t] FROM free WHERE n = 1
        UNION ALL
        SELECT w.s, f.n, CASE WHEN len(list_filter(w.founders, lambda x: {_likeness_sql('x', 'f.t')} >= 0.9::DOUBLE)) > 0 THEN w.founders ELSE list_append(w.founders, f.t) END
        FROM walk w JOIN free f ON f.s = w.s AND f.n = w.n + 1),
      founders AS (SELECT s, unnest(fs) AS t FROM (SELECT s, arg_max(founders, n) AS fs FROM walk GROUP BY s)),
      led AS (SELECT v.s, v.t, u.t AS g, row_number() OVER (PARTITION BY v.s, v.t ORDER BY {_likeness_sql('v.t', 'u.t')} DESC, u.f, u.t) AS k
        FROM free v JOIN (SELECT f.* FROM free f SEMI JOIN founders USING (s, t)) u ON u.s = v.s AND (u.f < v.l OR u.f = v.l AND u.t < v.t) AND {_likeness_sql('v.t', 'u.t')} >= 0.9::DOUBLE
        WHERE NOT EXISTS (SELECT 1 FROM founders o WHERE o.s = v.s AND o.t = v.t)),
      grouped AS (SELECT x.s, x.t, coalesce(x.r, led.g, x.t) AS g FROM ruled x LEFT JOIN led ON led.s = x.s AND led.t = x.t AND led.k = 1)
    """


_PART_GROUPS = _grouped_sql("part", "p_type", "p_name", "p_partkey", f"{_case(PART_RULES, 'lower(t)')} END")


@query(_PART_GROUPS + 'SELECT s AS p_type, t AS p_name, g AS "group" FROM grouped')
def fuzzy_group(spark, d):
    return composites.fuzzy_group(table(spark, d, "part").select("p_type", "p_name", "p_partkey"), ["p_type"], "p_name", "p_partkey", PART_RULES)


@query(_grouped_sql("customer", "c_nationkey", "c_name", "c_custkey", "NULL::VARCHAR") + 'SELECT s AS c_nationkey, t AS c_name, g AS "group" FROM grouped')
def fuzzy_group_of_customers(spark, d):
    """Names that differ in one letter: many resemble several founders, and chains of them are long."""
    return composites.fuzzy_group(table(spark, d, "customer").select("c_nationkey", "c_name", "c_custkey"), ["c_nationkey"], "c_name", "c_custkey", [])


@query()
def fuzzy_group_weighted(spark, d):
    """Groups of part names of each brand by the weighted likeness: no SQL has it; held against plain programs in the tests."""
    return composites.fuzzy_group(table(spark, d, "part").select("p_brand", "p_name", "p_partkey"), ["p_brand"], "p_name", "p_partkey", PART_RULES, scorer="weighted")


@query(_grouped_sql("part", "p_type", "p_name", "p_partkey", f"{_case(composites.PRODUCT_RULES, 'lower(t)')} END") + """SELECT s AS cluster, g AS "group", count(*) AS total_gene, round(sum(1.0 / (abs(p_size) + 1)) * count(*) * count(*) / any_value(n) * 100, 4) AS score
  FROM part JOIN grouped ON s = p_type AND t = p_name JOIN (SELECT p_type AS c, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1) ON c = p_type GROUP BY 1, 2""")
def enrichment(spark, d):
    """Fuzzy groups of part names of each type, scored by size as the distance."""
    flanks = table(spark, d, "part").select(F.col("p_type").alias("cluster"), F.col("p_name").alias("product"), F.col("p_size").alias("relative"), F.col("p_partkey").alias("position"))
    return composites.enrichment(flanks).select("cluster", "group", "total_gene", _round(F.col("score")).alias("score"))


def _alignment(spark, d):
    """All part names as an alignment: their letters, with gaps up to the longest."""
    names = table(spark, d, "part").where("p_name IS NOT NULL").select("p_name").distinct()
    return A.with_totals(names, [], [F.max(F.length("p_name")).alias("longest")]).select(F.col("p_name").alias("id"), F.rpad("p_name", F.col("longest"), F.lit("-")).alias("aligned"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL), l AS (SELECT max(length(p_name)) AS n FROM n),
  draws AS (SELECT r, i, (15485863 + r * 7919 + i * 104729) % 2147483647 AS x, n FROM l, range(1, 101) a(r), range(1, l.n + 1) b(i)),
  one AS (SELECT r, i, n, (x * x + 12345) % 2147483647 AS x FROM draws), two AS (SELECT r, i, n, (x * x + 12345) % 2147483647 AS x FROM one),
  three AS (SELECT r, n, ((x * x + 12345) % 2147483647) % n + 1 AS place FROM two), picks AS (SELECT r, n, place, count(*) AS times FROM three GROUP BY 1, 2, 3),
  pairs AS (SELECT a.p_name AS id_a, b.p_name AS id_b FROM n a JOIN n b ON a.p_name < b.p_name),
  differ AS (SELECT id_a, id_b, place FROM pairs, range(1, (SELECT n FROM l) + 1) t(place) WHERE rpad(id_a, (SELECT n FROM l)::INTEGER, '-')[place] <> rpad(id_b, (SELECT n FROM l)::INTEGER, '-')[place]),
  hit AS (SELECT r, id_a, id_b, sum(times) AS s FROM differ JOIN picks USING (place) GROUP BY 1, 2, 3)
  SELECT t.r::INTEGER AS replicate, p.id_a, p.id_b, coalesce(s, 0)::DOUBLE / (SELECT n FROM l) AS distance FROM pairs p CROSS JOIN range(1, 101) t(r) LEFT JOIN hit h ON h.r = t.r AND h.id_a = p.id_a AND h.id_b = p.id_b""")
def bootstrap_distance(spark, d):
    """All names, 100 replicates."""
    return composites.bootstrap_distances(_alignment(spark, d))


@query()
def nj_tree(spark, d):
    return composites.split_support(composites.neighbour_joining(bootstrap_distance(spark, d)))


@query()
def consensus_splits(spark, d):
    """The nested splits of the majority of bootstrap trees, with their parents: trees are built in Python; held against a plain program
    in the tests."""
    trees = composites.neighbour_joining(bootstrap_distance(spark, d))
    return composites.consensus_splits(trees).select("split", "support", "size", "parent")


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, round((least(a.p_size, b.p_size) + 20 - greatest(a.p_size, b.p_size)) * 100.0 / (greatest(a.p_size, b.p_size) + 20 - least(a.p_size, b.p_size)), 4) AS overlap,
  CASE WHEN b.p_size < a.p_size THEN 'left' ELSE 'right' END AS side, (CASE WHEN b.p_size < a.p_size THEN a.p_size - b.p_size - 20 ELSE b.p_size - a.p_size - 20 END)::INTEGER AS gap
  FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey AND abs(a.p_size - b.p_size) < 20""")
def overlapping_pairs(spark, d):
    """Parts of a brand and type whose ranges overlap: parts of one size are a class, and classes meet in bins."""
    p = table(spark, d, "part").select("p_brand", "p_type", "p_partkey", F.col("p_size").alias("s"), (F.col("p_size") + 20).alias("e"))
    ends = [F.col(c) for c in ("s_a", "e_a", "s_b", "e_b")]
    values = {"overlap": _round(S.overlap_percent(*ends)), "side": S.side(ends[0], ends[2]), "gap": S.signed_gap(*ends)}
    block = ["p_brand", "p_type"]
    met = joins.pairs_by_class(p, "p_partkey", block, ["s", "e"], values, lambda x, y: joins.overlap_join(x, y, block, ("s_a", "e_a"), ("s_b", "e_b"), finest=3))
    return met.select(F.col("p_partkey_a").alias("a"), F.col("p_partkey_b").alias("b"), *values)


@query()
def heat_clusters(spark, d):
    """Brands clustered by their scaled prices in each type: merges in rounds, held against a plain program in the tests."""
    scores = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.sum("p_retailprice").alias("t"))
    scaled = A.minmax_scale(scores, ["p_type"], S.log10_eps(F.col("t")), "x")
    merges = clustering.average_linkage(clustering.row_distances(scaled, "p_brand", "p_type", "x"))
    return merges.select("a", "b", _round(F.col("height"), 9).alias("height"), "size", "round")
