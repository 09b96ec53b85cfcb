"""Queries for arithmetic, comparison, strings, regular expressions, times, lists, dictionaries, JSON and codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna import semantics as Q
from kolumna.functions import nested as N
from kolumna.functions import strings as T
from kolumna.functions import temporal as D
from kolumna.queries.registry import Tables, query
from kolumna.sources import files


@query(
    "SELECT p_partkey, CASE WHEN p_size - 25 = 0 THEN NULL ELSE floor(p_partkey / (p_size - 25))::BIGINT END AS d,"
    " CASE WHEN p_size - 25 = 0 THEN NULL ELSE (p_partkey - (p_size - 25) * floor(p_partkey / (p_size - 25)))::BIGINT END AS m FROM part"
)
def floor_div_mod(t: Tables) -> DataFrame:
    y = F.col("p_size") - 25
    return t.part.select("p_partkey", Q.floor_div("p_partkey", y).cast("long").alias("d"), Q.floor_mod("p_partkey", y).cast("long").alias("m"))


@query("SELECT p_partkey, CASE WHEN p_size = 10 THEN 'inf' ELSE round(p_retailprice / (p_size - 10), 6)::VARCHAR END IS NOT NULL AS finite, CASE WHEN p_size <> 10 THEN round(p_retailprice / (p_size - 10), 6) END AS q FROM part")
def ieee_divide(t: Tables) -> DataFrame:
    q = Q.divide("p_retailprice", F.col("p_size") - 10)
    return t.part.select("p_partkey", q.isNotNull().alias("finite"), F.when(F.col("p_size") != 10, F.round(q, 6)).alias("q"))


NULLABLE = "(SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size END AS x, CASE WHEN p_size % 4 <> 0 THEN 25 END AS y FROM part)"


def _nullable(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("x"), F.when(F.col("p_size") % 4 != 0, F.lit(25)).alias("y"))


@query(
    "SELECT p_partkey, x IS NOT DISTINCT FROM y AS eq, x IS DISTINCT FROM y AS ne, CASE WHEN y IS NULL THEN false WHEN x IS NULL THEN true ELSE x < y END AS lt,"
    " CASE WHEN x IS NULL THEN true WHEN y IS NULL THEN false ELSE x <= y END AS le, CASE WHEN x IS NULL THEN false WHEN y IS NULL THEN true ELSE x > y END AS gt FROM " + NULLABLE
)
def null_compare(t: Tables) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return _nullable(t).select("p_partkey", Q.eq(x, y).alias("eq"), Q.ne(x, y).alias("ne"), Q.lt(x, y).alias("lt"), Q.le(x, y).alias("le"), Q.gt(x, y).alias("gt"))


@query(
    "SELECT p_partkey, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN least(x, y) END AS lo, greatest(x, y) AS hi, coalesce(x, -1) AS filled, x IS NULL AS isnull,"
    " CASE WHEN x > 20 THEN 'a' ELSE 'b' END AS pick FROM " + NULLABLE
)
def null_min_max_fill(t: Tables) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return _nullable(t).select("p_partkey", Q.lesser(x, y).alias("lo"), Q.greater(x, y).alias("hi"), Q.fill(x, -1).alias("filled"), Q.is_null(x).alias("isnull"), Q.ifelse(x > 20, F.lit("a"), F.lit("b")).alias("pick"))


@query("SELECT p_partkey, round_even(p_retailprice * 10 / 4, 0)::BIGINT AS j, (7 * floor(p_partkey / 7))::BIGINT AS bar, sign(p_size - 25)::INTEGER AS sg, abs(p_size - 25) AS ab, ceil(p_retailprice)::BIGINT AS up, floor(p_retailprice)::BIGINT AS dn FROM part")
def casts_and_bars(t: Tables) -> DataFrame:
    d = F.col("p_size") - 25
    return t.part.select(
        "p_partkey", Q.to_long(F.col("p_retailprice") * 10 / 4).alias("j"), Q.xbar(7, "p_partkey").cast("long").alias("bar"), Q.signum(d).alias("sg"), F.abs(d).alias("ab"),
        F.ceil("p_retailprice").alias("up"), F.floor("p_retailprice").alias("dn"),
    )


@query(
    "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS sq, round(exp(p_size / 10.0), 4) AS ex, round(ln(p_retailprice), 6) AS lg, round(pow(p_size, 1.5), 4) AS pw,"
    " round(ln(p_retailprice) / ln(2), 6) AS xlog, round(sin(p_size), 6) AS sn, round(cos(p_size), 6) AS cs, round(atan(p_size), 6) AS at, round(1 / p_retailprice, 9) AS rc FROM part"
)
def float_math(t: Tables) -> DataFrame:
    p, s = F.col("p_retailprice"), F.col("p_size")
    r = lambda c, d, n: F.round(c, d).alias(n)
    return t.part.select(
        "p_partkey", r(F.sqrt(p), 6, "sq"), r(F.exp(s / 10.0), 4, "ex"), r(F.log(p), 6, "lg"), r(F.pow(s, F.lit(1.5)), 4, "pw"), r(F.log(p) / F.log(F.lit(2.0)), 6, "xlog"),
        r(F.sin(s), 6, "sn"), r(F.cos(s), 6, "cs"), r(F.atan(s), 6, "at"), r(1 / p, 9, "rc"),
    )


# strings
@query("SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, '(?s)Brand.[1-3][^45]') OR p_name LIKE '%green%'")
def like_glob(t: Tables) -> DataFrame:
    return t.part.where(T.like("p_brand", "Brand?[1-3][^45]") | T.like("p_name", "*green*")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'auto%'")
def ilike_glob(t: Tables) -> DataFrame:
    return t.customer.where(T.ilike("c_mktsegment", "AUTO*")).select("c_custkey")


@query("SELECT p_partkey, regexp_matches(p_type, '^[A-M]') AS hit, regexp_full_match(p_brand, 'Brand#\\d+') AS whole, regexp_extract(p_brand, '(\\d)(\\d)', 2) AS second, replace(p_type, 'S', 'z') AS ssr FROM part")
def regex_and_replace(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.rlike("p_type", "^[A-M]").alias("hit"), T.full_match("p_brand", r"Brand#\d+").alias("whole"), T.extract("p_brand", r"(\d)(\d)", 2).alias("second"), T.ssr("p_type", "S", "z").alias("ssr"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+'))::BIGINT AS n, array_to_string(regexp_extract_all(text, '([A-Z])[a-z]+', 1), '') AS caps FROM documents")
def regex_extract_all(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(T.extract_all("text", "[A-Z][a-z]+")).cast("long").alias("n"), F.array_join(T.extract_all("text", "([A-Z])[a-z]+", 1), "").alias("caps"))


@query("SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '_') AS one, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS every, len(regexp_split_to_array(p_type, ' +'))::BIGINT AS parts FROM part")
def regex_replace_split(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.replace_first("p_type", "[AEIOU]", "_").alias("one"), T.replace_all("p_type", "[AEIOU]", "_").alias("every"), F.size(T.split_regex("p_type", " +")).cast("long").alias("parts"))


@query(
    "SELECT c_custkey, rpad(c_mktsegment, 12, ' ') AS r, lpad(c_mktsegment, 12, ' ') AS l, upper(c_name) AS up, length(c_name)::BIGINT AS n, trim('  ' || c_name || ' ') AS tr,"
    " substr(c_name, 3, 5) AS mid, array_to_string(string_split(c_name, '#'), '/') AS sv, starts_with(c_name, 'Cust') AS st, CASE WHEN starts_with(c_name, 'Cust') THEN substr(c_name, 5) ELSE c_name END AS rp FROM customer"
)
def string_verbs(t: Tables) -> DataFrame:
    n = F.col("c_name")
    return t.customer.select(
        "c_custkey", T.pad(12, "c_mktsegment").alias("r"), T.pad(-12, "c_mktsegment").alias("l"), F.upper(n).alias("up"), F.length(n).cast("long").alias("n"),
        F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("tr"), F.substring(n, 3, 5).alias("mid"), T.sv("/", T.vs("#", n)).alias("sv"), F.startswith(n, F.lit("Cust")).alias("st"),
        T.remove_prefix(n, "Cust").alias("rp"),
    )


@query("SELECT p_partkey, regexp_full_match(p_brand, '[A-Za-z]+') AS alpha, regexp_full_match(right(p_brand, 2), '[0-9]+') AS digit, regexp_full_match(split_part(p_type, ' ', 1), '[A-Z]+') AS up FROM part")
def string_classes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.is_class("p_brand", "alpha").alias("alpha"), T.is_class(F.right("p_brand", F.lit(2)), "digit").alias("digit"), T.is_class(F.get(T.vs(" ", "p_type"), F.lit(0)), "upper").alias("up"))


@query("SELECT n_nationkey, list_filter(range(greatest(length(n_name), 1)), lambda i: substr(n_name, (i + 1)::BIGINT, 1) = 'A') AS at FROM nation")
def string_search(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.transform(T.ss("n_name", "A"), lambda i: i.cast("long")).alias("at"))


# times
@query(
    "SELECT event_id, year(ts)::INTEGER AS yyyy, month(ts)::INTEGER AS mm, day(ts)::INTEGER AS dd, hour(ts)::INTEGER AS hh, minute(ts)::INTEGER AS mi, second(ts)::INTEGER AS ss,"
    " isodow(ts)::INTEGER AS dow, dayofyear(ts)::INTEGER AS doy FROM events"
)
def date_parts(t: Tables) -> DataFrame:
    names = {"yyyy": "year", "mm": "mm", "dd": "dd", "hh": "hh", "mi": "minute", "ss": "ss", "dow": "dow", "doy": "doy"}
    return t.events.select("event_id", *[D.field("ts", f).alias(n) for n, f in names.items()])


@query("SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY ALL")
def xbar_time_bucket(t: Tables) -> DataFrame:
    b = F.unix_micros(Q.xbar_time(300, "ts")).alias("bucket")
    return t.events.groupBy(b, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("v"))


@query("SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, strftime((date_trunc('month', o_orderdate) + INTERVAL 5 MONTH + INTERVAL (day(o_orderdate) - 1) DAY), '%Y-%m-%d') AS plus5, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') AS gap FROM orders")
def date_arithmetic(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.orders.select("o_orderkey", iso(D.trunc(d, "month")).alias("m"), iso(D.add_months(d.cast("date"), 5)).alias("plus5"), D.days_between(F.lit("2000-01-01").cast("date"), d).cast("long").alias("gap"))


@query("SELECT event_type, epoch_us(date_trunc('day', ts)) AS d, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close FROM events GROUP BY ALL")
def ohlc_bars(t: Tables) -> DataFrame:
    bars = D.ohlc("value", "event_id")
    return t.events.groupBy("event_type", F.unix_micros(D.trunc("ts", "day").cast("timestamp")).alias("d")).agg(*[c.alias(n) for n, c in bars.items()])


@query("SELECT event_id, TRY_CAST(split_part(props, ':', 2)[1:1] AS BIGINT) AS j FROM events")
def tok_parse(t: Tables) -> DataFrame:
    return t.events.select("event_id", D.tok("j", F.substring(F.get(F.split("props", ":"), F.lit(1)), 1, 1)).alias("j"))


# lists, dictionaries, JSON, codecs
BRANDS = "(SELECT p_brand, list(p_size ORDER BY p_partkey) AS l FROM part GROUP BY 1)"


def _lists(t: Tables) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("p_partkey", "p_size")))
    return t.part.groupBy("p_brand").agg(F.transform(rows, lambda r: r["p_size"]).alias("l"))


@query(
    "SELECT p_brand, len(l) AS n, l[1] AS head, l[-1] AS tail, coalesce(list_position(l, 7) - 1, len(l)) AS find, list_sum(list_transform(l, lambda x: x * 2))::BIGINT AS dbl, len(list_filter(l, lambda x: x > 25)) AS big,"
    " l[3] AS third, list_reverse(l)[1] AS rev, len(list_distinct(l)) AS uniq FROM " + BRANDS
)
def list_verbs(t: Tables) -> DataFrame:
    long = lambda c, n: c.cast("long").alias(n)
    return _lists(t).select(
        "p_brand", long(F.size("l"), "n"), N.index("l", 0).alias("head"), F.element_at("l", -1).alias("tail"), long(N.find("l", F.lit(7)), "find"),
        long(N.over(lambda a, x: a + x, F.lit(0).cast("int"), N.each(lambda v: v * 2, "l")), "dbl"), long(F.size(F.filter("l", lambda v: v > 25)), "big"), N.index("l", 2).alias("third"),
        N.index(N.reverse("l"), 0).alias("rev"), long(F.size(F.array_distinct("l")), "uniq"),
    )


@query("SELECT p_brand, unnest(list_transform(range(1, len(l) + 1), lambda i: list_sum(l[1:i])))::BIGINT AS s FROM " + BRANDS)
def list_scan(t: Tables) -> DataFrame:
    sums = N.scan(lambda a, x: a + x, F.lit(0).cast("long"), "l", "bigint")
    return _lists(t).select("p_brand", F.explode(sums).alias("s"))


@query("SELECT p_brand, unnest([l[i + 1] - l[i] for i in range(1, len(l))]) AS d FROM " + BRANDS)
def list_prior(t: Tables) -> DataFrame:
    d = N.prior(lambda a, b: a - b, "l")
    return _lists(t).select("p_brand", F.explode(N.drop(1, d)).alias("d"))


@query("SELECT p_brand, len(l[1:5]) AS a, coalesce(list_sum(l[6:]), 0)::BIGINT AS b, ceil(len(l) / 4.0)::BIGINT AS chunks, l[1 + (7 % len(l))] AS rot FROM " + BRANDS)
def list_take_drop_cut(t: Tables) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return _lists(t).select("p_brand", F.size(F.slice("l", 1, 5)).cast("long").alias("a"), total(N.drop(5, "l")).alias("b"), F.size(N.cut(4, "l")).cast("long").alias("chunks"), N.index(N.rotate(7, "l"), 0).alias("rot"))


@query("SELECT p_brand, len(list_filter(list_sort(l), lambda x: x <= 20)) - 1 AS bin, len(list_filter(l, lambda x: x < 20)) AS binr FROM " + BRANDS)
def list_bin(t: Tables) -> DataFrame:
    s = F.sort_array("l")
    return _lists(t).select("p_brand", N.bin_(s, 20).cast("long").alias("bin"), N.binr(s, 20).cast("long").alias("binr"))


@query("SELECT p_brand, sum(p_size)::BIGINT AS total FROM part GROUP BY 1")
def dict_add(t: Tables) -> DataFrame:
    half = lambda k: t.part.where(F.col("p_partkey") % 2 == k).groupBy("p_brand").agg(F.sum("p_size").alias(f"s{k}"))
    both = half(0).join(half(1), "p_brand", "full")
    dicts = both.select("p_brand", F.create_map(F.lit("s"), F.col("s0")).alias("a"), F.create_map(F.lit("s"), F.col("s1")).alias("b"))
    return dicts.select("p_brand", N.dict_add("a", "b")["s"].alias("total"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS ok FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", N.json_field("props", "$.k").alias("k"), F.expr("try_parse_json(props) is not null").alias("ok"))


@query("SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS j FROM region")
def to_json_rows(t: Tables) -> DataFrame:
    return t.region.select("r_regionkey", N.json_of("r_regionkey", "r_name").alias("j"))


@query("SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s, base64(c_name::BLOB) AS b, c_name AS back FROM customer")
def digests_codecs(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", N.digest("c_name", "md5").alias("m"), N.digest("c_name", "sha1").alias("s"), N.btoa("c_name").alias("b"), N.atob(N.btoa("c_name")).alias("back"))


@query("SELECT c_custkey, c_name AS back FROM customer")
def gzip_round_trip(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", N.gunzip(N.gz(F.col("c_name").cast("binary"))).alias("back"))


@query("SELECT p_partkey, round(p_size * p_size + p_partkey % 7, 6)::DOUBLE AS corner FROM part")
def matrix_multiply(t: Tables) -> DataFrame:
    a = F.array(F.array(F.col("p_size").cast("double"), F.lit(1.0)), F.array(F.lit(0.0), F.lit(1.0)))
    b = F.array(F.array(F.col("p_size").cast("double"), F.lit(0.0)), F.array((F.col("p_partkey") % 7).cast("double"), F.lit(1.0)))
    return t.part.select("p_partkey", F.round(N.mmu(a, b)[0][0], 6).alias("corner"))


@query("SELECT n_nationkey, 'k' AS key, (n_nationkey * 2)::VARCHAR AS value FROM nation")
def key_value_text(t: Tables) -> DataFrame:
    text = F.concat(F.lit("k="), (F.col("n_nationkey") * 2).cast("string"))
    return t.nation.select("n_nationkey", F.explode(files.key_values(text, ";", "=")))


@query("SELECT r_regionkey || ',' || r_name AS value FROM region")
def csv_text(t: Tables) -> DataFrame:
    return files.prepare_text(t.region)
