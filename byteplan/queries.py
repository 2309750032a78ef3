"""Queries over the standard tables, one per operator, each with the SQL that says the same.

Three kinds of SQL: the same quantity computed in SQL; for what only a kernel can make, an invariant (the decoded
bytes are the input's); and none, where the result depends on a library or an order SQL cannot follow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import builtin as B
from .functions.udfs import functions
from .goldens import GOLDENS
from .kernels import containers, dictionary, vm
from .operators import benefit, mining, profiling, snapshots
from .plans import pack
from .schema import as_blobs, render_rows

_K = functions()
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(function):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Kernels take far longer than moving a row: give all cores some where the input has few splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_blobs(_table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), F.col("source"))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_blobs(_table(spark, sf_dir, "benchmark"), F.col("item_id"), F.col("text"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_blobs(_table(spark, sf_dir, "pages"), F.col("page_id"), F.col("html"))


# ---- profiles -------------------------------------------------------------------------------------------------

_ENTROPY_SQL = """
  bytes AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents),
  counts AS (SELECT doc_id, b, count(*) AS c FROM bytes GROUP BY ALL),
  totals AS (SELECT doc_id, sum(c) AS n FROM counts GROUP BY ALL),
  h AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS h FROM counts JOIN totals USING (doc_id) GROUP BY ALL)"""


@_query(f"""WITH {_ENTROPY_SQL}
SELECT source AS corpus, count(*) AS n_blobs, sum(octet_length(encode(text)))::BIGINT AS n_bytes,
  sum(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END)::BIGINT AS n_lines,
  round(avg(abs(coalesce(h, 0))), 6) AS mean_entropy
FROM documents LEFT JOIN h USING (doc_id) GROUP BY ALL""")
def corpus_profile(spark, sf_dir):
    out = profiling.corpus_profile(_documents(spark, sf_dir))
    return out.select("corpus", "n_blobs", "n_bytes", "n_lines", F.round("mean_entropy", 6).alias("mean_entropy"))


@_query(f"WITH {_ENTROPY_SQL} SELECT doc_id, round(abs(coalesce(h, 0)), 6) AS entropy FROM documents LEFT JOIN h USING (doc_id)")
def byte_entropy(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(_K["byte_entropy"](F.col("text").cast("binary")), 6).alias("entropy"))


@_query(f"WITH {_ENTROPY_SQL} SELECT doc_id, round(octet_length(encode(text)) * (1 - abs(coalesce(h, 0)) / 8), 4) AS redundancy FROM documents LEFT JOIN h USING (doc_id)")
def blob_redundancy(spark, sf_dir):
    data = F.col("text").cast("binary")
    return _table(spark, sf_dir, "documents").select("doc_id", F.round(B.redundancy(F.octet_length(data), _K["byte_entropy"](data)), 4).alias("redundancy"))


@_query("""SELECT n, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576)
  WHEN n >= 1024 THEN printf('%.1f KB', n / 1024) ELSE n || ' B' END AS shown FROM (SELECT DISTINCT (n_chars * k)::BIGINT AS n FROM documents, (VALUES (1), (1000), (4096), (1048576)) v(k)
  UNION SELECT unnest([0, 1023, 1024, 1280, 1408, 1536, 1048575, 1048576, 1310720, 1073741823, 1073741824]))""")
def human_sizes(spark, sf_dir):
    grid = _table(spark, sf_dir, "documents").select(F.explode(F.array(*[F.col("n_chars") * k for k in (1, 1000, 4096, 1048576)])).alias("n"))
    more = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1280, 1408, 1536, 1048575, 1048576, 1310720, 1073741823, 1073741824)], "n long")
    return grid.union(more).distinct().select("n", B.human_size(F.col("n")).alias("shown"))


@_query("""WITH b AS (SELECT source AS corpus, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents)
SELECT corpus, h, count(*) AS n FROM b GROUP BY ALL""")
def byte_histogram(spark, sf_dir):
    out = profiling.byte_histogram(_documents(spark, sf_dir))
    return out.select("corpus", F.lpad(F.hex("byte"), 2, "0").alias("h"), "n")


_PREFIXES = [bytes.fromhex(h) for h in ("FFD8FF00", "1F8B0800", "504B0304", "5249464600000000574542501111", "000000186674797000000000", "4D5A", "50", "")]


@_query("""WITH p(k, prefix) AS (VALUES (0, 'FFD8FF00'), (1, '1F8B0800'), (2, '504B0304'), (3, '5249464600000000574542501111'),
  (4, '000000186674797000000000'), (5, '4D5A'), (6, '50'), (7, '')),
b AS (SELECT doc_id, k, prefix || hex(encode(text)) AS h FROM documents JOIN p ON k = doc_id % 8)
SELECT doc_id, (h LIKE 'FFD8FF%' OR h LIKE '1F8B%' OR h LIKE '504B0304%' OR h LIKE '4D5A%'
  OR h LIKE '89504E470D0A1A0A%' OR h LIKE '47494638%' OR h LIKE '377ABCAF271C%' OR h LIKE '526172211A07%' OR h LIKE '425A68%'
  OR h LIKE '28B52FFD%' OR h LIKE 'FD377A585A00%' OR h LIKE '4F676753%' OR h LIKE '664C6143%' OR h LIKE '0000002066747970%' OR h LIKE '5041434B%'
  OR (length(h) >= 24 AND ((h LIKE '52494646%' AND h[17:24] = '57454250') OR h[9:16] = '66747970'))) AS compressed FROM b""")
def magic_class(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    prefix = F.element_at(F.array(*map(F.lit, _PREFIXES)), (F.col("doc_id") % 8 + 1).cast("int"))
    return docs.select("doc_id", B.apply_magic(F.concat(prefix, F.col("text").cast("binary"))).alias("compressed"))


@_query("""WITH lines AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i,
  list_distinct(list_transform(range(1, length(l) - 2), lambda k: substr(l, k, 4))) AS g FROM lines WHERE length(l) >= 4),
pairs AS (SELECT doc_id, g, lag(g) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM kept)
SELECT doc_id, round(coalesce(s, 0), 6) AS similarity FROM documents LEFT JOIN (
  SELECT doc_id, avg(len(list_intersect(p, g)) / len(list_distinct(list_concat(p, g)))) AS s FROM pairs WHERE p IS NOT NULL GROUP BY ALL) USING (doc_id)""")
def line_similarity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(B.mean_line_similarity("text"), 6).alias("similarity"))


@_query("""SELECT 'event' AS kind, event_id AS id, coalesce(regexp_matches(props, '^[ \\t\\r\\n]*(\\{|\\[\\{)'), false) AS json FROM events
UNION ALL SELECT 'page', page_id, coalesce(regexp_matches(html, '^[ \\t\\r\\n]*(\\{|\\[\\{)'), false) FROM pages""")
def looks_json(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), B.looks_json(F.col("props")).alias("json"))
    pages = _table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), B.looks_json(F.col("html")).alias("json"))
    return events.unionByName(pages)


@_query("SELECT doc_id, 1.0::DOUBLE AS ratio FROM documents")
def utf8_valid_ratio(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", _K["utf8_valid_ratio"](F.col("text").cast("binary")).alias("ratio"))


@_query()
def classify(spark, sf_dir):
    return profiling.classify(_spread(_documents(spark, sf_dir)))


# ---- numbers and transforms -------------------------------------------------------------------------------------

_LEB_SQL = """CASE WHEN {n} < 128 THEN 1 WHEN {n} < 16384 THEN 2 WHEN {n} < 2097152 THEN 3 WHEN {n} < 268435456 THEN 4 ELSE 5 END"""


@_query(f"""SELECT o_orderkey AS n, {_LEB_SQL.format(n="o_orderkey")} AS size,
  array_to_string(list_transform(range({_LEB_SQL.format(n="o_orderkey")}), lambda k: printf('%02X', (o_orderkey >> (7 * k)) % 128
    + CASE WHEN k + 1 < {_LEB_SQL.format(n="o_orderkey")} THEN 128 ELSE 0 END)), '') AS code, o_orderkey AS decoded FROM orders""")
def leb128(spark, sf_dir):
    n = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(n.alias("n"), B.leb_size(n).alias("size"), B.leb_encode(n).alias("code"))
    return rows.withColumn("decoded", _K["leb_decode"](F.unhex("code")))


@_query("""SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey,
  printf('%08X', (l_partkey + 1) % 4294967296) AS inc_u32, printf('%08X', (l_partkey - 1 + 4294967296) % 4294967296) AS dec_u32,
  printf('%08X', (l_partkey % 256) * 16777216 + (l_partkey >> 8) % 256 * 65536 + (l_partkey >> 16) % 256 * 256 + (l_partkey >> 24) % 256) AS byteswap,
  CASE WHEN l_partkey % 2 = 0 THEN l_partkey // 2 ELSE 4294967295 - l_partkey // 2 END AS zigzag FROM lineitem""")
def transforms_u32(spark, sf_dir):
    big = F.lpad(F.hex("l_partkey"), 8, "0")
    little = lambda h: F.concat(*[F.substring(h, 7 - 2 * k, 2) for k in range(4)])
    word = F.unhex(little(big))
    as_number = lambda t: little(F.hex(_K["apply_transform"](word, F.lit(t))))
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", as_number(2).alias("inc_u32"), as_number(3).alias("dec_u32"),
        as_number(6).alias("byteswap"), F.conv(as_number(7), 16, 10).cast("bigint").alias("zigzag"),
    )


@_query("""WITH b AS (SELECT p_partkey, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT p_partkey, regexp_extract_all(hex(encode(p_name)), '..') AS a FROM part)),
v AS (SELECT p_partkey, i, ('0x' || x)::INT AS v FROM b),
s AS (SELECT p_partkey, i, v, sum(v) OVER (PARTITION BY p_partkey ORDER BY i) % 256 AS s FROM v)
SELECT p_partkey, string_agg(printf('%02X', (v + 1) % 256), '' ORDER BY i) AS inc_u8, string_agg(printf('%02X', (v + 255) % 256), '' ORDER BY i) AS dec_u8,
  string_agg(printf('%02X', s::INT), '' ORDER BY i) AS delta_u8 FROM s GROUP BY ALL""")
def transforms_u8(spark, sf_dir):
    data = F.col("p_name").cast("binary")
    apply = lambda t: F.hex(_K["apply_transform"](data, F.lit(t)))
    return _table(spark, sf_dir, "part").select("p_partkey", apply(0).alias("inc_u8"), apply(1).alias("dec_u8"), apply(4).alias("delta_u8"))


@_query(f"""WITH b AS (SELECT item_id, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT item_id, regexp_extract_all(hex(encode(text)), '..') AS a FROM benchmark)),
v AS (SELECT item_id, i, ('0x' || x)::INT AS v FROM b),
d AS (SELECT item_id, v, (v - coalesce(lag(v) OVER (PARTITION BY item_id ORDER BY i), 0) + 256) % 256 AS d FROM v),
c AS (SELECT item_id, 'v' AS k, v AS x, count(*) AS c FROM d GROUP BY ALL UNION ALL SELECT item_id, 'd', d, count(*) FROM d GROUP BY ALL),
h AS (SELECT item_id, n, sum(CASE WHEN k = 'v' THEN -c / n * log2(c / n) ELSE 0 END) - sum(CASE WHEN k = 'd' THEN -c / n * log2(c / n) ELSE 0 END) AS g
  FROM c JOIN (SELECT item_id, count(*) AS n FROM v GROUP BY ALL) USING (item_id) GROUP BY ALL)
SELECT item_id, greatest(0, trunc(g * n / 8)::BIGINT - 2 - {_LEB_SQL.format(n="n")})::BIGINT AS gain FROM h""")
def delta_entropy_gain(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", _K["delta_entropy_gain"](F.col("text").cast("binary")).alias("gain"))


# ---- loops and macros -------------------------------------------------------------------------------------------


@_query(f"""WITH b AS (SELECT p_partkey, repeat(p_name, (1 + p_partkey % 6)::INT) AS t FROM part),
p AS (SELECT p_partkey, t, length(t) AS n, (SELECT min(k) FROM range(4, length(t) // 3 + 1) r(k)
  WHERE length(t) % k = 0 AND repeat(left(t, k), length(t) // k) = t) AS period FROM b),
q AS (SELECT p_partkey, period, n, n // period AS c, 1 + {_LEB_SQL.format(n="period")} + period AS body FROM p)
SELECT p_partkey, period::INT AS period, CASE WHEN period IS NOT NULL THEN (1 + {_LEB_SQL.format(n="n")} + n) - (1 + {_LEB_SQL.format(n="c")} + {_LEB_SQL.format(n="body")} + body) END::BIGINT AS gain FROM q""")
def loops(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.expr("repeat(p_name, cast(1 + p_partkey % 6 as int))").alias("t"))
    rows = rows.withColumn("period", B.smallest_period("t"))
    gain = B.loop_gain(F.length("t"), F.col("period"), F.expr("length(t) div period"))
    return rows.select("p_partkey", "period", F.when(F.col("period").isNotNull(), gain).cast("bigint").alias("gain"))


@_query(f"""WITH g AS (SELECT l, u, m FROM range(4, 300, 7) a(l), range(2, 12) b(u), (VALUES (0), (127), (128), (20000)) c(m))
SELECT l AS length, u AS uses, m AS macro, u * (1 + {_LEB_SQL.format(n="l")} + l - 1 - {_LEB_SQL.format(n="m")}) - 4 - (1 + {_LEB_SQL.format(n="l")} + l) AS gain FROM g""")
def macro_gains(spark, sf_dir):
    grid = spark.range(4, 300, 7).withColumnRenamed("id", "length")
    grid = grid.withColumn("uses", F.explode(F.sequence(F.lit(2).cast("bigint"), F.lit(11).cast("bigint"))))
    grid = grid.withColumn("macro", F.explode(F.array(*map(F.lit, (0, 127, 128, 20000)))))
    return grid.withColumn("gain", B.macro_gain(F.col("length"), F.col("uses"), F.col("macro")).cast("bigint"))


@_query("""WITH h AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark),
g AS (SELECT item_id, h, substr(h, (2 * i + 1)::INT, 16) AS p FROM h, range(0, 100000) r(i) WHERE 2 * i + 16 <= length(h))
SELECT item_id, p AS pattern, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 2""")
def ngram_candidates(spark, sf_dir):
    found = mining.file_patterns(_benchmark(spark, sf_dir), 8, 8)
    return found.select(F.col("path").cast("bigint").alias("item_id"), F.hex("pattern").alias("pattern"), "n")


@_query("""WITH b AS (SELECT item_id, text AS t, length(text) AS n FROM benchmark WHERE length(text) = octet_length(encode(text))),
g AS (SELECT DISTINCT item_id, t, w, substr(t, i::INT, w::INT) AS p FROM b, range(8, 65) v(w), range(1, 1000) r(i) WHERE w <= n // 2 AND i + w - 1 <= n),
u AS (SELECT item_id, w, (length(t) - length(replace(t, p, ''))) // w AS u FROM g)
SELECT item_id, coalesce(max(u * w - w - 6) FILTER (u >= 2 AND u * w - w - 6 > 0), 0)::BIGINT AS gain FROM b LEFT JOIN u USING (item_id) GROUP BY ALL""")
def best_macros(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark").filter(F.length("text") == F.octet_length("text"))
    return rows.select("item_id", F.coalesce(_K["best_macro"](F.col("text").cast("binary"))["gain"], F.lit(0)).cast("bigint").alias("gain"))


#: Every byte is a character of its own (U+0100 and up), so character functions count bytes.
@_query("""WITH x AS (SELECT item_id, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT item_id, regexp_extract_all(hex(encode(text)), '..') AS a FROM benchmark)),
b AS (SELECT item_id, string_agg(chr(('0x' || x)::INT + 256), '' ORDER BY i) AS t, count(*) AS n FROM x GROUP BY ALL),
g AS (SELECT DISTINCT item_id, t, w, substr(t, i::INT, w::INT) AS p FROM (SELECT item_id, t, w, unnest(range(1, n - w + 2)) AS i FROM b, range(8, 65) v(w) WHERE w <= n // 2)),
u AS (SELECT item_id, w, (length(t) - length(replace(t, p, ''))) // w AS u FROM g)
SELECT item_id, coalesce(max(u * w - w - 6) FILTER (u >= 2 AND u * w - w - 6 > 0), 0)::BIGINT AS gain FROM benchmark LEFT JOIN u USING (item_id) GROUP BY ALL""")
def best_macros_bytes(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark")
    return rows.select("item_id", F.coalesce(_K["best_macro"](F.col("text").cast("binary"))["gain"], F.lit(0)).cast("bigint").alias("gain"))


@_query("""SELECT doc_id, ((length(text) - length(replace(text, 'ing', ''))) // 3)::BIGINT AS n,
  (length(text) - length(replace(text, chr(10), '')))::BIGINT AS newlines, instr(text, 'tion')::INT AS first FROM documents""")
def nonoverlap_count(spark, sf_dir):
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select(
        "doc_id", F.expr("(length(text) - length(replace(text, 'ing', ''))) div 3").alias("n"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint").alias("newlines"),
        F.instr(text, "tion").alias("first"),
    )


@_query("SELECT item_id, md5(text) AS digest, true AS sorted FROM benchmark")
def suffix_arrays(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark").select("item_id", "text", F.col("text").cast("binary").alias("b"))
    rows = rows.withColumn("sa", _K["suffix_order"]("b"))
    suffixes = F.expr("transform(sa, p -> hex(substring(b, cast(p as int) + 1)))")
    return rows.select("item_id", F.md5("text").alias("digest"), (suffixes == F.array_sort(suffixes)).alias("sorted"))


# ---- rows ---------------------------------------------------------------------------------------------------------

_ORDER_LINES_SQL = """lines AS (SELECT f, row_number() OVER (PARTITION BY f ORDER BY o_orderkey) AS n, l FROM (SELECT o_custkey % 20 AS f, o_orderkey,
  CASE WHEN o_orderkey % 11 = 0 THEN '"a, b"' ELSE o_orderkey::VARCHAR END || ',' || o_orderstatus || CASE WHEN o_orderkey % 37 = 0 THEN ',x' ELSE '' END || ',' || o_orderpriority AS l FROM orders))"""


def _order_lines(spark, sf_dir):
    from pyspark.sql import Window

    orders = _table(spark, sf_dir, "orders")
    first = F.when(F.col("o_orderkey") % 11 == 0, F.lit('"a, b"')).otherwise(F.col("o_orderkey").cast("string"))
    line = F.concat(first, F.lit(","), "o_orderstatus", F.when(F.col("o_orderkey") % 37 == 0, ",x").otherwise(""), F.lit(","), "o_orderpriority")
    rows = orders.select((F.col("o_custkey") % 20).alias("path"), "o_orderkey", line.alias("line"))
    return rows.select("path", F.row_number().over(Window.partitionBy("path").orderBy("o_orderkey")).alias("line_no"), "line")


@_query(f"""WITH {_ORDER_LINES_SQL},
c AS (SELECT f, n, length(regexp_replace(l, '"[^"]*("|$)', '', 'g')) - length(replace(regexp_replace(l, '"[^"]*("|$)', '', 'g'), ',', '')) AS c FROM lines),
i AS (SELECT f, c, n, n - row_number() OVER (PARTITION BY f, c ORDER BY n) AS g FROM c),
r AS (SELECT f, c, g, min(n) AS first, count(*) AS len FROM i GROUP BY ALL)
SELECT f AS path, c::INT AS n_delimiters, first::INT AS first_line, len AS n_rows FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY len DESC, first) AS k FROM r) WHERE k = 1""")
def delimiter_runs(spark, sf_dir):
    return profiling.delimiter_runs(_order_lines(spark, sf_dir), ",")


@_query(f"""WITH {_ORDER_LINES_SQL} SELECT f AS path, n::INT AS line_no, len(x)::INT AS n_fields, array_to_string(x, ';') AS fields
FROM (SELECT f, n, regexp_extract_all(l, '((?:"[^"]*"|[^,"])+)', 1) AS x FROM lines)""")
def quoted_fields(spark, sf_dir):
    rows = _order_lines(spark, sf_dir).withColumn("x", _K["split_fields"](F.col("line").cast("binary")))
    joined = F.array_join(F.transform("x", lambda b: b.cast("string")), ";")
    return rows.select("path", "line_no", F.size("x").alias("n_fields"), joined.alias("fields"))


@_query("""SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS n_values, count(DISTINCT o_orderstatus) <= 1 AS fixed FROM orders
UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(DISTINCT o_orderpriority) <= 1 FROM orders
UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), count(DISTINCT o_custkey) <= 1 FROM orders""")
def fixed_columns(spark, sf_dir):
    return profiling.fixed_columns(_table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


def _order_blobs(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    fields = [F.col("o_orderkey").cast("string"), F.lit("fixed"), F.col("o_orderstatus"), F.col("o_custkey").cast("string")]
    return render_rows(orders, F.col("o_custkey") % 20, ["o_orderkey"], fields)


_ORDER_BLOBS_SQL = """blobs AS (SELECT (o_custkey % 20)::VARCHAR AS path, string_agg(o_orderkey || ',fixed,' || o_orderstatus || ',' || o_custkey || chr(10), '' ORDER BY o_orderkey) AS t, count(*) AS n FROM orders GROUP BY ALL)"""


@_query(f"WITH {_ORDER_BLOBS_SQL} SELECT path, n::INT AS n_rows, md5(t) AS digest, (2 * n + n)::INT AS n_params FROM blobs")
def row_templates(spark, sf_dir):
    rows = _order_blobs(spark, sf_dir).withColumn("r", _K["find_rows"](F.col("content").cast("binary")))
    return rows.select("path", "r.n_rows", F.md5(_scan_again("r")).alias("digest"), F.size("r.params").alias("n_params"))


def _scan_again(column: str):
    """Prefix, rows made by the template, suffix: what a template reproduces."""
    from .functions.udfs import kernel

    def again(r: dict) -> bytes:
        b = vm.ProgramBuilder().lit(r["prefix"]).add_macro(0, r["template"]).scan(r["n_rows"], 0, r["params"]).lit(r["suffix"])
        return vm.run(b.build(), b.macros)

    return kernel(again, "binary")(column)


@_query("""SELECT event_id, array_to_string(json_keys(props), ',') AS keys, json_extract_string(props, '$.k') AS value FROM events""")
def json_members(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    keys = F.array_join(_K["json_member_keys"](F.col("props").cast("binary")), ",")
    return events.select("event_id", keys.alias("keys"), F.get_json_object("props", "$.k").alias("value"))


@_query("""WITH b AS (SELECT (event_id % 10)::VARCHAR AS path, string_agg('{"id":' || event_id || ',"type":"' || event_type || '","user":' || user_id || '}' || chr(10), '' ORDER BY event_id) AS t, count(*) AS n FROM events GROUP BY ALL)
SELECT path, n::INT AS n_rows, md5(t) AS digest FROM b""")
def json_templates(spark, sf_dir):
    line = F.format_string('{"id":%d,"type":"%s","user":%d}', "event_id", "event_type", "user_id")
    rows = render_rows(_table(spark, sf_dir, "events"), F.col("event_id") % 10, ["event_id"], [line])
    rows = rows.withColumn("r", _K["find_rows"](F.col("content").cast("binary")))
    return rows.select("path", "r.n_rows", F.md5(_scan_again("r")).alias("digest"))


# ---- dictionaries -------------------------------------------------------------------------------------------------

_STRIDED_SQL = """h AS (SELECT page_id AS item_id, hex(encode(html)) AS h FROM pages),
g AS (SELECT DISTINCT item_id, substr(h, (2 * i + 1)::INT, (2 * w)::INT) AS p, w FROM h, (VALUES (8), (16), (32), (64)) v(w), range(0, 100000, 4) r(i)
  WHERE i % (w // 2) = 0 AND 2 * (i + w) <= length(h)),
c AS (SELECT p, count(*) AS files FROM g GROUP BY ALL)"""
_PATTERN_ENTROPY_SQL = """(SELECT -sum(n / t * log2(n / t)) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM (SELECT unnest(regexp_extract_all({p}, '..')) AS b) GROUP BY b))"""


@_query(f"WITH {_STRIDED_SQL} SELECT p AS pattern, files FROM c WHERE files >= 2")
def strided_counts(spark, sf_dir):
    counts = mining.strided_counts(_pages(spark, sf_dir))
    return counts.filter("files >= 2").select(F.hex("pattern").alias("pattern"), "files")


_TOP_SQL = f"""{_STRIDED_SQL}, e AS (SELECT p, files, {_PATTERN_ENTROPY_SQL.format(p="p")} AS h FROM c WHERE files >= greatest(2, (SELECT count(*) FROM pages WHERE html <> '') // 10)),
top AS (SELECT p, files, row_number() OVER (ORDER BY files DESC, length(p) DESC, p) - 1 AS rank FROM e WHERE h >= 2.5 QUALIFY row_number() OVER (ORDER BY files DESC, length(p) DESC, p) <= 50)"""


@_query(f"WITH {_TOP_SQL} SELECT rank::INT AS rank, printf('%02X', rank) AS key, p AS pattern, files FROM top")
def strided_dictionary(spark, sf_dir):
    found = mining.strided_dictionary(_pages(spark, sf_dir))
    return found.select("rank", F.hex("key").alias("key"), F.hex("pattern").alias("pattern"), "files")


@_query(f"""WITH {_TOP_SQL}, s AS (SELECT sum(greatest(0, length(p) // 2 - 3)) * (SELECT count(*) FROM pages WHERE html <> '') - 8 - sum(6 + length(p) // 2) AS gain FROM top)
SELECT gain::BIGINT AS gain, gain >= 1024 AS worthwhile FROM s WHERE gain IS NOT NULL""")
def dictionary_net_gain(spark, sf_dir):
    return mining.net_gain(mining.strided_dictionary(_pages(spark, sf_dir))).select("gain", "worthwhile")


_CROSS_SQL = f"""h AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark),
g AS (SELECT item_id, substr(h, (2 * i + 1)::INT, (2 * w)::INT) AS p FROM h, range(6, 13) v(w), range(0, 100000) r(i) WHERE 2 * (i + w) <= length(h) AND 2 * w < length(h)),
f AS (SELECT item_id, p, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 2),
x AS (SELECT p, count(*) AS files, sum(n)::BIGINT AS total FROM f GROUP BY ALL HAVING count(*) >= 2),
k AS (SELECT p, files, total, total * (length(p) // 2 - 3) AS score FROM x WHERE {_PATTERN_ENTROPY_SQL.format(p="p")} >= 2.5)"""


def _cross(spark, sf_dir):
    return mining.cross_file_candidates(mining.file_patterns(_benchmark(spark, sf_dir)))


@_query(f"WITH {_CROSS_SQL} SELECT p AS pattern, files, total, score::BIGINT AS score FROM k")
def cross_file_candidates(spark, sf_dir):
    return _cross(spark, sf_dir).select(F.hex("pattern").alias("pattern"), "files", "total", F.col("score").cast("bigint").alias("score"))


@_query(f"""WITH {_CROSS_SQL} SELECT t AS min_files, count(*) AS n_patterns, round(avg(length(p) // 2), 6) AS avg_len, max(score)::BIGINT AS best_score
FROM k, (VALUES (2), (3), (5)) v(t) WHERE files >= t GROUP BY ALL""")
def pattern_sweep(spark, sf_dir):
    out = mining.pattern_sweep(_cross(spark, sf_dir), (2, 3, 5))
    return out.select("min_files", "n_patterns", F.round("avg_len", 6).alias("avg_len"), F.col("best_score").cast("bigint").alias("best_score"))


@_query()
def cross_file_dictionary(spark, sf_dir):
    chosen = mining.select_patterns(_cross(spark, sf_dir), 50)
    return spark.createDataFrame([(k, p) for k, p in enumerate(chosen)], "rank int, pattern binary").select("rank", F.hex("pattern").alias("pattern"))


_WORDS = [b" and ", b"tion", b" the ", b" de la ", b"ing"]
_WORDS_SQL = "regexp_extract_all(text, ' de la | and | the |tion|ing')"


@_query(f"""SELECT doc_id, octet_length(encode(text)) AS length, coalesce(list_sum(list_transform({_WORDS_SQL}, lambda m: length(m))), 0)::BIGINT AS covered FROM documents""")
def dictionary_coverage(spark, sf_dir):
    out = mining.dictionary_coverage(_documents(spark, sf_dir), _WORDS)
    return out.select(F.col("path").cast("bigint").alias("doc_id"), "length", "covered")


@_query(f"""SELECT doc_id, CASE WHEN text = '' THEN false ELSE coalesce(list_sum(list_transform({_WORDS_SQL}, lambda m: length(m))), 0) / octet_length(encode(text)) > 0.1 END AS predicts_benefit FROM documents""")
def predict_benefit(spark, sf_dir):
    out = mining.predict(_documents(spark, sf_dir), _WORDS)
    return out.select(F.col("path").cast("bigint").alias("doc_id"), "predicts_benefit")


@_query("""SELECT n::INT AS n, coalesce(sum(list_sum(list_transform(regexp_extract_all(text, p), lambda m: length(m)))), 0)::BIGINT AS covered, sum(octet_length(encode(text)))::BIGINT AS total
FROM documents, (VALUES (1, ' and '), (2, ' and |tion'), (3, ' and | the |tion'), (5, ' de la | and | the |tion|ing')) v(n, p) GROUP BY n""")
def coverage_curve(spark, sf_dir):
    return mining.coverage_curve(_documents(spark, sf_dir), _WORDS, (1, 2, 3, 5))


@_query()
def leave_one_out(spark, sf_dir):
    blobs = as_blobs(_order_blobs(spark, sf_dir), F.col("path"), F.col("content"))
    return mining.leave_one_out(blobs)


@_query(f"""WITH {_TOP_SQL}, b AS (SELECT rank, printf('%08X', rank) AS r, printf('%08X', length(p) // 2) AS l, p FROM top)
SELECT count(*)::INT AS n, sha256(unhex(string_agg(r[7:8] || r[5:6] || r[3:4] || r[1:2] || l[7:8] || l[5:6] || l[3:4] || l[1:2] || p, '' ORDER BY rank))) AS hash FROM b HAVING count(*) > 0""")
def snapshot_hash(spark, sf_dir):
    return mining.snapshot_hash(mining.strided_dictionary(_pages(spark, sf_dir))).select("n", "hash")


@_query(f"""WITH {_TOP_SQL} SELECT count(*) AS n, round(avg(length(p) // 2), 6) AS avg_len, round({_PATTERN_ENTROPY_SQL.format(p="string_agg(p, '')")}, 6) AS h_pattern FROM top HAVING count(*) > 0""")
def snapshot_statistics(spark, sf_dir):
    out = snapshots.snapshot_statistics(mining.strided_dictionary(_pages(spark, sf_dir)))
    return out.select("n", F.round("avg_len", 6).alias("avg_len"), F.round("h_pattern", 6).alias("h_pattern"))


@_query(f"WITH {_TOP_SQL} SELECT rank AS id, p AS pattern, sha256(unhex(p)) AS entry_hash FROM top")
def snapshot_patterns(spark, sf_dir):
    files = snapshots.publish(mining.strided_dictionary(_pages(spark, sf_dir)))
    return snapshots.snapshot_patterns(snapshots.snapshot_table(files)).select("id", F.hex("pattern").alias("pattern"), "entry_hash")


_DELTA = [(0, b"put in the place of the first"), (900, b"added")]


@_query(f"""WITH {_TOP_SQL}, d(rank, p) AS (VALUES {", ".join(f"({k}, '{p.hex().upper()}')" for k, p in _DELTA)}),
m AS (SELECT rank, p FROM d UNION ALL SELECT rank, p FROM top WHERE rank NOT IN (SELECT rank FROM d)),
b AS (SELECT rank, printf('%08X', rank) AS r, printf('%08X', length(p) // 2) AS l, p FROM m)
SELECT count(*)::INT AS n, sha256(unhex(string_agg(r[7:8] || r[5:6] || r[3:4] || r[1:2] || l[7:8] || l[5:6] || l[3:4] || l[1:2] || p, '' ORDER BY rank))) AS hash FROM b""")
def snapshot_delta(spark, sf_dir):
    delta = spark.createDataFrame([("all", k, p) for k, p in _DELTA], "corpus string, rank int, pattern binary")
    return mining.snapshot_hash(snapshots.with_delta(mining.strided_dictionary(_pages(spark, sf_dir)), delta)).select("n", "hash")


_TAGS = [b"<div", b"</div>", b"class=", b"<p>", b"</p>", b"href="]


@_query(f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'EMBEDDED' WHEN 2 THEN 'HYBRID' ELSE 'EXTERNAL' END AS source, page_id % 4 <> 3 AS ok,
  CASE WHEN page_id % 4 = 3 THEN 9 ELSE 0 END AS code, CASE WHEN page_id % 4 <> 3 THEN md5(html) END AS digest,
  len(regexp_extract_all(html, '{"|".join(t.decode() for t in _TAGS)}')) AS n_references FROM pages WHERE html IS NOT NULL""")
def program_by_snapshot(spark, sf_dir):
    """Programs with their dictionary inline, in a snapshot, in both, and in a snapshot that nobody published."""
    from .functions.udfs import kernel
    from .kernels import leb

    published = containers.Snapshot(dict(enumerate(_TAGS)))
    keyed = {leb.encode(k): t for k, t in enumerate(_TAGS)}
    named = {0: ({}, None), 1: (None, published.hash), 2: ({leb.encode(0): _TAGS[0]}, published.hash), 3: (None, containers.Snapshot({0: b"lost"}).hash)}

    def made(html: bytes, kind: int) -> bytes:
        inline, snapshot = named[kind]
        program = dictionary.compress_with_references(html, dict(enumerate(_TAGS)))
        return containers.ProgramFile(program, dictionary=keyed if kind == 0 else inline or {}, snapshot=snapshot, deflate=kind == 1).encode()

    pages = _table(spark, sf_dir, "pages").filter("html IS NOT NULL").withColumn("kind", (F.col("page_id") % 4).cast("int"))
    files = pages.select(F.col("page_id").cast("string").alias("path"), kernel(lambda html, kind: made(html, kind), "binary")(F.col("html").cast("binary"), "kind").alias("content"))
    references = kernel(lambda content: sum(i.name == "REF" for i in vm.instructions(containers.ProgramFile.decode(content).program)), "bigint")
    table = snapshots.snapshot_table(spark.createDataFrame([(published.encode(),)], "content binary"))
    out = snapshots.run_program_files(files, table).select(F.col("path").cast("bigint").alias("page_id"), "source", "ok", "code", F.md5("output").alias("digest"))
    return out.join(files.select(F.col("path").cast("bigint").alias("page_id"), references("content").alias("n_references")), "page_id")


@_query()
def single_blob_benefit(spark, sf_dir):
    rows = _benchmark(spark, sf_dir).withColumn("patterns", _K["mine_patterns"]("content"))
    return benefit.measured(rows).withColumnRenamed("path", "item_id")


@_query()
def leave_one_out_measured(spark, sf_dir):
    blobs = as_blobs(_order_blobs(spark, sf_dir), F.col("path"), F.col("content"))
    return benefit.measured(mining.held_out_dictionaries(blobs))


#: A list of its own, best first, of more words than the curve has points.
_RANKED = [b" the ", b" and ", b"tion", b" de la ", b"ing", b"ment", b" que ", b" der ", b" und ", b"ent", b" les ", b" con "]
_RANKED_SQL = ", ".join(f"({n}, '{'|'.join(sorted((w.decode() for w in _RANKED[:n]), key=len, reverse=True))}', '{b''.join(_RANKED[:n]).hex().upper()}')" for n in (1, 2, 3, 5, 8, 12))


@_query(f"""SELECT n::INT AS n, coalesce(sum(list_sum(list_transform(regexp_extract_all(text, p), lambda m: length(m)))), 0)::BIGINT AS covered, sum(octet_length(encode(text)))::BIGINT AS total,
  round(any_value(h), 6) AS h_pattern FROM documents, (SELECT n, p, {_PATTERN_ENTROPY_SQL.format(p="j")} AS h FROM (VALUES {_RANKED_SQL}) v(n, p, j)) GROUP BY n""")
def benefit_curve(spark, sf_dir):
    """Coverage and entropy, which SQL can give; sizes and crossings are held against brute force."""
    out = benefit.benefit_curve(_spread(_documents(spark, sf_dir)), _RANKED)
    return out.select("n", "covered", "total", F.round("h_pattern", 6).alias("h_pattern"))


@_query()
def sweep_coverage(spark, sf_dir):
    return benefit.sweep_coverage(_benchmark(spark, sf_dir), _cross(spark, sf_dir))


@_query()
def applicability(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", _K["applicability"](F.col("text").cast("binary")).alias("r")).select("item_id", "r.*")


# ---- programs: what comes back must be what went in --------------------------------------------------------------

_DOC_DIGEST = "SELECT doc_id, md5(text) AS digest, octet_length(encode(text)) AS length FROM documents"


def _back(spark, sf_dir, decoded) -> DataFrame:
    rows = _spread(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))).withColumn("d", decoded)
    return rows.select("doc_id", F.md5("d").alias("digest"), F.octet_length("d").cast("bigint").alias("length"))


@_query(_DOC_DIGEST)
def program_lz(spark, sf_dir):
    return _back(spark, sf_dir, _K["run_program"](_K["lz_encode"]("b")))


@_query(_DOC_DIGEST)
def program_naive(spark, sf_dir):
    return _back(spark, sf_dir, _K["run_program"](_K["compress_naive"]("b")))


@_query(_DOC_DIGEST)
def program_smart(spark, sf_dir):
    return _back(spark, sf_dir, _K["run_program"](_K["compress_smart"]("b")))


@_query(_DOC_DIGEST)
def program_synthesized(spark, sf_dir):
    rows = _spread(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))).withColumn("s", _K["synthesize"]("b"))
    rows = rows.withColumn("d", _K["run_with_macros"]("s.program", "s.macros"))
    return rows.select("doc_id", F.md5("d").alias("digest"), F.octet_length("d").cast("bigint").alias("length"))


@_query("SELECT doc_id, md5(text) AS digest, false AS structure_first FROM documents")
def program_lz_first(spark, sf_dir):
    rows = _spread(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))).withColumn("s", _K["synthesize_lz_first"]("b"))
    return rows.select("doc_id", F.md5(_K["run_with_macros"]("s.program", "s.macros")).alias("digest"), "s.structure_first")


@_query(_DOC_DIGEST)
def container_blob(spark, sf_dir):
    return _back(spark, sf_dir, _K["decode_blob"](_K["encode_blob"]("b")))


@_query(_DOC_DIGEST)
def container_program_file(spark, sf_dir):
    return _back(spark, sf_dir, _K["decode_program_file"](_K["encode_program_file"]("b")))


@_query("""SELECT page_id, md5(html) AS digest FROM pages""")
def program_references(spark, sf_dir):
    from .functions.udfs import kernel

    words = dict(enumerate([b"<div", b"</div>", b"class=", b"<p>", b"</p>", b"href="]))
    again = kernel(lambda data: dictionary.decompress_with_references(dictionary.compress_with_references(data, words), words), "binary")
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(again(F.col("html").cast("binary"))).alias("digest"))


@_query("SELECT doc_id, octet_length(encode(text)) AS length, true AS contiguous FROM documents")
def lz_token_cover(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", _K["lz_tokens"](F.col("text").cast("binary")).alias("t"))
    total = F.aggregate("t", F.lit(0).cast("bigint"), lambda s, x: s + x["len"])
    joined = F.expr("forall(t, x -> x.ord = 0 OR x.start = t[x.ord - 1].start + t[x.ord - 1].len)")
    return rows.select("doc_id", total.alias("length"), joined.alias("contiguous"))


@_query()
def lz_statistics(spark, sf_dir):
    return profiling.lz_statistics(_documents(spark, sf_dir))


_BAD_PROGRAMS = [
    ("unknown opcode", vm.ProgramBuilder().build() + b"\xab", 0x01),
    ("copy from nothing", vm.ProgramBuilder().cpy(1, 1).build(), 0x02),
    ("loop body overruns", bytes([3, 2, 9]), 0x03),
    ("macro that is not there", vm.ProgramBuilder().call(7).build(), 0x07),
    ("reference that is not there", vm.ProgramBuilder().ref(b"x").build(), 0x07),
    ("unknown transform", bytes([2, 99, 0]), 0x0A),
    ("next outside a scan", vm.ProgramBuilder().next().build(), 0x0B),
    ("literal cut off", bytes([0, 5, 65]), 0xFF),
    ("number cut off", bytes([0, 0x80]), 0xFF),
    ("fine", vm.ProgramBuilder().lit(b"ok").halt().build(), 0),
]


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', {code == 0}, {code})" for name, _, code in _BAD_PROGRAMS) + ") v(name, ok, code)")
def machine_errors(spark, sf_dir):
    rows = spark.createDataFrame([(n, p) for n, p, _ in _BAD_PROGRAMS], "name string, program binary")
    return rows.select("name", _K["try_run_program"]("program").alias("r")).select("name", "r.ok", "r.code")


@_query("SELECT doc_id, true AS valid, true AS described FROM documents")
def disassembly(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("b"), _K["compress_naive"](F.col("text").cast("binary")).alias("p"))
    end = F.aggregate(_K["program_tokens"]("p"), F.lit(0).cast("bigint"), lambda s, x: s + x["len"])
    covered = F.aggregate(_K["program_spans"]("p"), F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return rows.select("doc_id", (_K["validate_program"]("p") == 0).alias("valid"), ((end == F.octet_length("p")) & (covered == F.octet_length("b"))).alias("described"))


# ---- archives -------------------------------------------------------------------------------------------------------


def _packed(spark, sf_dir, force=False) -> DataFrame:
    entries = pack.encode_entries(_spread(_documents(spark, sf_dir)), force_programs=force)
    return pack.archives(entries).select(F.col("first_path").alias("path"), F.col("data").alias("content"))


@_query("SELECT doc_id, octet_length(encode(text)) AS original_size FROM documents")
def archive_list(spark, sf_dir):
    return pack.archive_entries(_packed(spark, sf_dir)).select(F.col("path").cast("bigint").alias("doc_id"), "original_size")


@_query("SELECT doc_id, md5(text) AS digest, true AS ok FROM documents")
def archive_round_trip(spark, sf_dir):
    rows = pack.archive_entries(_packed(spark, sf_dir, force=True), with_content=True)
    return rows.select(F.col("path").cast("bigint").alias("doc_id"), F.md5("content").alias("digest"), "ok")


@_query("SELECT count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS original_size FROM documents")
def archive_summary(spark, sf_dir):
    return pack.summary(pack.archive_entries(_packed(spark, sf_dir))).filter("method IS NULL").select("n", "original_size")


@_query("""WITH b AS (SELECT (o_custkey % 20)::VARCHAR AS path, string_agg(o_orderkey || ',fixed,' || o_orderstatus || ',' || o_custkey || chr(10), '' ORDER BY o_orderkey) AS t FROM orders GROUP BY ALL)
SELECT path, md5(t) AS digest FROM b""")
def archive_deep(spark, sf_dir):
    # A kernel to a stage: an executor then holds one worker for each core, not one for each kernel and core.
    tasks = 4 * spark.sparkContext.defaultParallelism
    blobs = as_blobs(_order_blobs(spark, sf_dir), F.col("path"), F.col("content")).repartition(tasks)
    found = pack.mine_dictionary(blobs, min_size=1024)
    entries = pack.encode_entries(blobs, found, force_programs=True).repartition(tasks)
    return pack.decode_entries(entries, found).select("path", F.md5("content").alias("digest"))


@_query("""SELECT printf('logs/%04d.csv', f) AS path, md5(string_agg(r || ',' || (1700000000000 + f * 1000000 + r * 137) || ',INFO,gateway,eu-west,v2.4.1,GET,/api/items,200,ok' || chr(10), '' ORDER BY r)) AS digest, true AS deep
FROM range(12) a(f), range(300) b(r) GROUP BY f""")
def log_corpus(spark, sf_dir):
    from .plans.corpora import log_corpus as make

    blobs = make(spark, files=12, rows=300)
    found = pack.mine_dictionary(blobs, min_size=1024)
    entries = pack.encode_entries(blobs, found, force_programs=True)
    back = pack.decode_entries(entries, found).join(entries.select("path", "method", "compressed_size"), "path")
    body = F.substring("content", 641, F.octet_length("content"))
    return back.select("path", F.md5(body).alias("digest"), ((F.col("method") == "program") & (F.col("compressed_size") < 2000)).alias("deep"))


@_query("SELECT page_id::VARCHAR AS path, octet_length(encode(html)) AS length, true AS round_trip FROM pages")
def pack_bench(spark, sf_dir):
    return pack.bench(_pages(spark, sf_dir)).select("path", "length", "round_trip")


for _made, _expected in GOLDENS.items():
    _query(_expected)(_made)
