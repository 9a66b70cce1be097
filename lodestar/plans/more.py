"""More relational queries: null-aware joins, rankings, text and time, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .relational import register

_WORDS = r"[^a-z0-9]+"


@register("SELECT doc_id, md5(lower(text)) AS digest FROM documents")
def text_digest(t):
    return t("documents").select("doc_id", F.md5(F.lower("text")).alias("digest"))


@register("SELECT md5(text) AS digest, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1")
def text_copies(t):
    # Texts are hashed where they lie; the shuffle carries digests and partial counts.
    return t("documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@register("SELECT DISTINCT CAST(value AS VARCHAR) AS written FROM events")
def double_text(t):
    return t("events").select(F.col("value").cast("string").alias("written")).distinct()


@register("SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda x: length(x) > 7)) AS INTEGER) AS long_words FROM documents WHERE lang = 'en'")
def long_words(t):
    words = F.filter(F.split("text", " "), lambda w: F.length(w) > 7)
    return t("documents").where("lang = 'en'").select("doc_id", F.size(words).alias("long_words"))


@register(r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark), g AS (SELECT item_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
s AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS gram FROM g) SELECT a.item_id AS a, b.item_id AS b, count(*) AS grams FROM s a JOIN s b ON a.gram = b.gram AND a.item_id < b.item_id GROUP BY 1, 2""")
def shared_grams(t):
    words = F.filter(F.split(F.lower("text"), _WORDS), lambda w: w != "")
    own = t("benchmark").select("item_id", words.alias("w")).where(F.size("w") >= 8)
    places = F.sequence(F.lit(1), F.size("w") - 7)
    grams = own.select("item_id", F.explode(F.transform(places, lambda i: F.array_join(F.slice("w", i, 8), " "))).alias("gram")).distinct()
    a, b = grams.alias("a"), grams.alias("b")
    met = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.item_id") < F.col("b.item_id")))
    return met.groupBy(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b")).agg(F.count("*").alias("grams"))


@register(r"""WITH w AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM w WHERE w <> '' GROUP BY 1),
p AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS both FROM w a JOIN w b ON a.w = b.w AND a.item_id < b.item_id WHERE a.w <> '' GROUP BY 1, 2)
SELECT p.a, p.b FROM p JOIN n x ON p.a = x.item_id JOIN n y ON p.b = y.item_id WHERE 10 * p.both >= 3 * (x.n + y.n - p.both)""")
def token_jaccard(t):
    # Two sets of similarity 0.3 share one of the rarest 70 % of either's words: common words make no pairs.
    words = t("benchmark").select("item_id", F.array_remove(F.array_distinct(F.split(F.lower("text"), _WORDS)), "").alias("words")).withColumn("n", F.size("words"))
    each = words.select("item_id", "n", F.explode("words").alias("w"))
    ranked = each.join(each.groupBy("w").agg(F.count("*").alias("in_items")), "w").withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("in_items", "w")))
    rare = ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 3 / 10) + 1).select("item_id", "n", "w")
    a, b = rare.alias("a"), rare.alias("b")
    near = (10 * F.least("a.n", "b.n") >= 3 * F.greatest("a.n", "b.n")) & (F.col("a.item_id") < F.col("b.item_id"))
    pairs = a.join(b, (F.col("a.w") == F.col("b.w")) & near).select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b")).distinct()
    x, y = (words.select(F.col("item_id").alias(c), F.col("words").alias(f"words_{c}")) for c in ("a", "b"))
    shared = F.size(F.array_intersect("words_a", "words_b"))
    return pairs.join(x, "a").join(y, "b").where(10 * shared >= 3 * (F.size("words_a") + F.size("words_b") - shared)).select("a", "b")


@register(r"SELECT w AS token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM benchmark) WHERE w <> '' GROUP BY 1")
def token_counts(t):
    return t("benchmark").select(F.explode(F.split(F.lower("text"), _WORDS)).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


@register("SELECT doc_id, CAST(len(regexp_extract_all(text, '(?:the|and)')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, 'the|and')")
def keyword_counts(t):
    return t("documents").where(F.col("text").rlike("the|and")).select("doc_id", F.regexp_count("text", F.lit("the|and")).cast("long").alias("n"))


@register(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]{2,}')")
def with_email(t):
    return t("documents").where(F.col("text").rlike(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]{2,}")).select("doc_id")


@register("""SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS written, CAST(day(o_orderdate) AS INTEGER) AS d, o_orderdate - INTERVAL 5 HOUR AS west, o_orderpriority || ':' || o_orderstatus AS both FROM orders""")
def date_texts(t):
    west = F.from_utc_timestamp(F.col("o_orderdate").cast("timestamp"), "Etc/GMT+5").cast("timestamp_ntz")
    return t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("written"), F.day("o_orderdate").alias("d"), west.alias("west"), F.concat_ws(":", "o_orderpriority", "o_orderstatus").alias("both"))


@register("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1")
def status_map(t):
    counts = t("orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    of = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0).cast("long"))
    return counts.select("o_custkey", of("F").alias("f"), of("O").alias("o"))


@register("SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a CROSS JOIN region b")
def join_cross(t):
    # Two tables of fixed size.
    return t("nation").select(F.col("n_nationkey").alias("a")).crossJoin(t("region").select(F.col("r_regionkey").alias("b")))


@register("SELECT p_partkey FROM part WHERE nullif(p_size % 7, 3) NOT IN (SELECT CASE WHEN n_nationkey < 3 THEN n_nationkey END FROM nation WHERE n_nationkey < 3)")
def join_not_in(t):
    # A null on the left is in no answer; the right side has none here, and one null there would empty the result.
    return t("part").sparkSession.sql(
        "SELECT p_partkey FROM {part} WHERE nullif(p_size % 7, 3) NOT IN (SELECT CASE WHEN n_nationkey < 3 THEN n_nationkey END FROM {nation} WHERE n_nationkey < 3)", part=t("part"), nation=t("nation")
    )


@register("SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_exists_or(t):
    return t("customer").sparkSession.sql("SELECT c_custkey FROM {c} WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM {o} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", c=t("customer"), o=t("orders"))


@register("SELECT e.event_id FROM events e WHERE e.event_type = 'purchase' AND EXISTS (SELECT 1 FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.ts <= e.ts)")
def asof_exists(t):
    # Whether any click came before is whether the first one did: one row per user enters the join.
    first = t("events").where("event_type = 'click'").groupBy("user_id").agg(F.min("ts").alias("first_click"))
    return t("events").where("event_type = 'purchase'").join(first, "user_id").where("first_click <= ts").select("event_id")


@register("SELECT r_regionkey, count(*) AS n FROM region JOIN nation ON n_nationkey > 4 * r_regionkey AND n_nationkey < 7 * r_regionkey + 3 GROUP BY 1")
def join_inequality(t):
    met = t("nation").join(F.broadcast(t("region")), F.expr("n_nationkey > 4 * r_regionkey AND n_nationkey < 7 * r_regionkey + 3"))
    return met.groupBy("r_regionkey").agg(F.count("*").alias("n"))


@register("""SELECT event_id, first_value(value) OVER w AS a, last_value(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def window_ends(t):
    w = Window.partitionBy("user_id").orderBy("ts")
    return t("events").select("event_id", F.first_value("value").over(w).alias("a"), F.last_value("value").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("z"))


@register("SELECT c_custkey, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS d FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)")
def window_shares(t):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal")
    return t("customer").select("c_custkey", F.round(F.percent_rank().over(w), 6).alias("p"), F.round(F.cume_dist().over(w), 6).alias("d"))


@register("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@register("""WITH s AS (SELECT event_type, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts) AS us FROM events) SELECT event_type, max(us) AS longest_us FROM s GROUP BY 1""")
def longest_dwell(t):
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    following = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts"))
    spent = t("events").select("event_type", (micros(following) - micros(F.col("ts"))).alias("us"))
    return spent.groupBy("event_type").agg(F.max("us").alias("longest_us"))


@register()
def quantile_sketch(t):
    sketch = F.kll_sketch_agg_double("l_extendedprice")
    found = t("lineitem").groupBy("l_returnflag").agg(sketch.alias("s"))
    return found.select("l_returnflag", F.kll_sketch_get_quantile_double("s", F.lit(0.5)).alias("median"))
