"""Queries over the driver's tables: each binds rows to document-shaped relations by a stated rule and applies one operator.

The tables hold no document trees, so every binding is a choice made here; `ORACLES` has the same rule as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from docweft.functions import attributes, text
from docweft.operators import corpus, counters, diagnostics, quotes, resolve, runs, tables
from docweft.plans import trees
from docweft.plans.registry import ORACLES, QUERIES, query, read

__all__ = ["ORACLES", "QUERIES", "trees"]

#: The order of line items within a document; together these columns identify one.
LI = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def count_of(tokens: Column, kind: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x["t"] == kind))


@query("""
SELECT lang, count(*) AS n_docs, sum(len(regexp_extract_all(text, '[^ ]+')))::BIGINT AS n_str,
  sum(len(regexp_extract_all(text, ' +')))::BIGINT AS n_space, sum(len(string_split(text, chr(10))))::BIGINT AS n_blocks
FROM documents GROUP BY lang
""")
def tokens_by_lang(spark, d):
    runs_of = lambda p: F.regexp_count("text", F.lit(p))
    counted = read(spark, d, "documents").select("lang", runs_of("[^ ]+").alias("s"), runs_of(" +").alias("p"), F.size(F.split("text", "\n")).alias("b"))
    return counted.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("s").alias("n_str"), F.sum("p").alias("n_space"), F.sum("b").alias("n_blocks"))


@query("""
WITH wide AS (SELECT doc_id, replace(text, '. ', '.  ') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, ' +')) AS by_run, len(regexp_extract_all(t, ' ')) AS by_space FROM wide
""")
def verbatim_spaces(spark, d):
    wide = F.replace("text", F.lit(". "), F.lit(".  "))
    runs_, each = count_of(text.inline_tokens(wide), "Space"), count_of(text.verbatim_tokens(wide), "Space")
    return read(spark, d, "documents").select("doc_id", runs_.cast("long").alias("by_run"), each.cast("long").alias("by_space"))


@query("""
SELECT p_partkey,
  regexp_replace(regexp_replace(trim(p_name), '[^\\p{L}\\p{N} _-]', '', 'g'), ' +', '-', 'g') AS slug_name,
  regexp_replace(regexp_replace(trim(p_brand), '[^\\p{L}\\p{N} _-]', '', 'g'), ' +', '-', 'g') AS slug_brand
FROM part
""")
def slugify_parts(spark, d):
    slug = lambda c: text.slugify(F.col(c))
    return read(spark, d, "part").select("p_partkey", slug("p_name").alias("slug_name"), slug("p_brand").alias("slug_brand"))


@query("""
WITH flat AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 77) || '...' ELSE t END AS warning FROM flat
""")
def truncate_warning(spark, d):
    return read(spark, d, "documents").select("doc_id", text.shortened(F.col("text")).alias("warning"))


@query("""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
numbered AS (SELECT *, coalesce(sum(CASE WHEN length(line) < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stanza FROM lines)
SELECT doc_id, stanza, count(*) AS n_lines, min(i)::INTEGER AS first_line FROM numbered GROUP BY doc_id, stanza
""")
def line_block_lines(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    numbered = runs.number_stanzas(lines, ["doc_id"], ["i"], F.length("line") < 20)
    return numbered.groupBy("doc_id", "stanza").agg(F.count("*").alias("n_lines"), (F.min("i") + 1).alias("first_line"))


@query("""
WITH items AS (SELECT conv_id, turn, role <> 'assistant' AS term FROM conversations),
marked AS (SELECT *, CASE WHEN term AND lag(term) OVER w = false THEN 1 ELSE 0 END AS n FROM items WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
entries AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS entry FROM marked)
SELECT conv_id, entry, count(*) FILTER (term) AS n_terms, count(*) FILTER (NOT term) AS n_descriptions FROM entries GROUP BY conv_id, entry
""")
def definition_groups(spark, d):
    items = read(spark, d, "conversations").withColumn("term", F.col("role") != "assistant")
    entries = runs.number_entries(items, ["conv_id"], ["turn"], F.col("term"))
    return entries.groupBy("conv_id", "entry").agg(F.count_if("term").alias("n_terms"), F.count_if(~F.col("term")).alias("n_descriptions"))


@query("""
WITH marked AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
numbered AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM marked)
SELECT user_id, run, min(event_type) AS event_type, count(*) AS n, string_agg(event_id::VARCHAR, '' ORDER BY event_id) AS merged
FROM numbered GROUP BY user_id, run
""")
def merge_adjacent(spark, d):
    numbered = runs.number_runs(read(spark, d, "events"), ["user_id"], ["event_id"], F.col("event_type"))
    ids = F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string"))
    return numbered.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.array_join(ids, "").alias("merged"))


@query("""
WITH slugs AS (SELECT p_partkey, p_name, regexp_replace(regexp_replace(trim(p_name), '[^\\p{L}\\p{N} _-]', '', 'g'), ' +', '-', 'g') AS id FROM part)
SELECT id, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM slugs WHERE id <> '' GROUP BY id
""")
def heading_targets(spark, d):
    return resolve.heading_targets(read(spark, d, "part"), [], ["p_partkey"], "p_name")


_CROSS_SQL = """
WITH spelled AS (
  SELECT upper(n_name) AS id, 10 * n_nationkey + 1 AS pos FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT lower(n_name), 10 * n_nationkey + 2 FROM nation WHERE n_nationkey % 3 = 0
  UNION ALL SELECT upper(n_name[1:1]) || lower(n_name[2:]), 10 * n_nationkey FROM nation WHERE n_nationkey % 5 = 0),
targets AS (SELECT id, min(pos) AS pos FROM spelled GROUP BY id),
refs AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN upper(n_name) WHEN 1 THEN lower(n_name)
  WHEN 2 THEN upper(n_name[1:1]) || lower(n_name[2:]) ELSE lower(n_name[1:1]) || upper(n_name[2:]) END AS target
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def crossref_sides(spark, d):
    """Nations under up to three spellings that differ by case alone, and references to them in four."""
    nations = read(spark, d, "nation")
    name, k = F.col("n_name"), F.col("n_nationkey")
    title = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1000)))
    other = F.concat(F.lower(F.substring(name, 1, 1)), F.upper(F.substring(name, 2, 1000)))
    spelled = F.array(F.when(k % 2 == 0, F.struct(F.upper(name).alias("id"), (10 * k + 1).alias("at"))), F.when(k % 3 == 0, F.struct(F.lower(name).alias("id"), (10 * k + 2).alias("at"))), F.when(k % 5 == 0, F.struct(title.alias("id"), (10 * k).alias("at"))))
    targets = resolve.first_of_each(nations.select(F.explode(F.array_compact(spelled)).alias("x")).select("x.*"), ["id"], ["at"])
    at = F.col("c_custkey") % 4
    refs = read(spark, d, "customer").join(nations, F.col("c_nationkey") == k)
    return refs.select("c_custkey", F.when(at == 0, F.upper(name)).when(at == 1, F.lower(name)).when(at == 2, title).otherwise(other).alias("target")), targets


@query(_CROSS_SQL + """
SELECT c_custkey, target, coalesce(e.id, l.id, (SELECT arg_min(t.id, t.pos) FROM targets t WHERE lower(t.id) = lower(target))) AS id
FROM refs LEFT JOIN targets e ON e.id = target LEFT JOIN targets l ON l.id = lower(target)
WHERE lower(target) IN (SELECT lower(id) FROM targets)
""")
def crossref_resolved(spark, d):
    refs, targets = crossref_sides(spark, d)
    return resolve.resolve(refs, targets, "target", "id", order=["at"]).where("id IS NOT NULL").select("c_custkey", "target", "id")


@query(_CROSS_SQL + "SELECT c_custkey, target FROM refs WHERE lower(target) NOT IN (SELECT lower(id) FROM targets)")
def crossref_unresolved(spark, d):
    return resolve.unresolved(*crossref_sides(spark, d), "target", "id")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1
""")
def footnote_first_wins(spark, d):
    return resolve.first_of_each(read(spark, d, "lineitem").select(*LI), ["l_orderkey"], LI[1:])


@query("""
SELECT o_orderkey, coalesce(CASE o_orderstatus WHEN 'O' THEN '☼' WHEN 'F' THEN '✓' END, ':' || o_orderstatus || ':') AS symbol FROM orders
""")
def symbols_lookup(spark, d):
    found = resolve.look_up(read(spark, d, "orders"), "o_orderstatus", {"O": "☼", "F": "✓"}, "found")
    return found.select("o_orderkey", F.coalesce("found", F.concat(F.lit(":"), "o_orderstatus", F.lit(":"))).alias("symbol"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag,
  row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)::INTEGER AS n FROM lineitem
""")
def caption_numbers(spark, d):
    return counters.caption_numbers(read(spark, d, "lineitem").select(*LI, "l_returnflag"), ["l_suppkey"], "l_returnflag", LI)


@query("""
WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN k < 26 THEN chr((97 + k)::INTEGER)
       WHEN k < 702 THEN chr((97 + (k - 26) // 26)::INTEGER) || chr((97 + (k - 26) % 26)::INTEGER)
       ELSE chr((97 + (k - 702) // 676)::INTEGER) || chr((97 + (k - 702) // 26 % 26)::INTEGER) || chr((97 + (k - 702) % 26)::INTEGER) END AS letter
FROM k
""")
def panel_letters(spark, d):
    return counters.panel_letters(read(spark, d, "lineitem").select(*LI), ["l_suppkey"], LI)


@query("""
WITH n AS (SELECT event_id, user_id, event_type, coalesce(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS note FROM events)
SELECT event_id, user_id, note FROM n WHERE event_type = 'purchase'
""")
def note_counter(spark, d):
    numbered = counters.note_numbers(read(spark, d, "events"), ["user_id"], ["event_id"], F.col("event_type") == "click")
    return numbered.where("event_type = 'purchase'").select("event_id", "user_id", "note")


LENGTHS_SQL = """
WITH lens AS (SELECT o_custkey, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders),
w AS (SELECT o_custkey, max(n) AS width, count(*)::BIGINT AS n_rows FROM lens GROUP BY o_custkey)
"""


def order_lengths(spark, d):
    return tables.row_lengths(read(spark, d, "orders"), read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query(LENGTHS_SQL + "SELECT o_custkey, width, n_rows FROM w")
def table_width(spark, d):
    return tables.widths(order_lengths(spark, d), "o_custkey").select("o_custkey", "width", "n_rows")


@query(LENGTHS_SQL + """
SELECT o_custkey, width, count(*) FILTER (n < width)::BIGINT AS short_rows FROM lens JOIN w USING (o_custkey)
GROUP BY o_custkey, width HAVING count(*) FILTER (n < width) > 0
""")
def short_rows(spark, d):
    return tables.widths(order_lengths(spark, d), "o_custkey").where("short_rows > 0").select("o_custkey", "width", "short_rows")


CELLS_SQL = """
WITH cells AS (SELECT l_orderkey AS o_orderkey, l_returnflag, l_linestatus,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS c FROM lineitem),
ord AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders),
leads AS (SELECT o_orderkey, coalesce(min(c) FILTER (l_returnflag <> 'N'), count(*))::BIGINT AS lead, bool_and(l_returnflag = 'N') AS headed FROM cells GROUP BY o_orderkey)
"""


def order_cells(spark, d):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LI[1:])) - 1
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linestatus", at.alias("c"))


def order_rows(spark, d):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", at.alias("r"))


def is_header() -> Column:
    return F.col("l_returnflag") == "N"


@query(CELLS_SQL + "SELECT o_orderkey, lead FROM leads")
def row_head_lead(spark, d):
    return tables.leading_headers(order_cells(spark, d), "o_orderkey", is_header())


@query(CELLS_SQL + """
SELECT o_custkey, coalesce(min(r) FILTER (NOT coalesce(headed, false)), count(*))::BIGINT AS head_rows
FROM ord LEFT JOIN leads USING (o_orderkey) GROUP BY o_custkey
""")
def head_rows(spark, d):
    headed = order_cells(spark, d).groupBy("o_orderkey").agg(F.bool_and(is_header()).alias("headed"))
    rows = order_rows(spark, d).join(headed, "o_orderkey", "left")
    return tables.head_rows(rows, "o_custkey", F.coalesce("headed", F.lit(False)))


@query(CELLS_SQL + """
, lead_rows AS (SELECT o_custkey, r, coalesce(lead, 0) AS lead FROM ord LEFT JOIN leads USING (o_orderkey)),
marked AS (SELECT *, CASE WHEN lead = lag(lead) OVER w THEN 0 ELSE 1 END AS n FROM lead_rows WINDOW w AS (PARTITION BY o_custkey ORDER BY r)),
numbered AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey ORDER BY r ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM marked)
SELECT o_custkey, run, min(lead)::BIGINT AS lead, count(*) AS n_rows, min(r)::INTEGER AS first_row FROM numbered GROUP BY o_custkey, run
""")
def body_runs(spark, d):
    leads = tables.leading_headers(order_cells(spark, d), "o_orderkey", is_header())
    rows = order_rows(spark, d).join(leads, "o_orderkey", "left")
    return tables.body_runs(rows, "o_custkey", F.coalesce("lead", F.lit(0)).cast("long"))


@query("""
SELECT o_custkey, count(*) AS n_rows,
  count(*) FILTER (o_orderstatus = 'O') + count(*) FILTER (o_orderstatus = 'F') + count(*) FILTER (o_orderstatus = 'P' AND o_totalprice < 250000) = count(*) AS fits
FROM orders GROUP BY o_custkey
""")
def partition_check(spark, d):
    when = lambda s: F.count_if(F.col("o_orderstatus") == s)
    counted = read(spark, d, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n_rows"), when("O").alias("head"), when("F").alias("body"), F.count_if((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 250000)).alias("foot")
    )
    bodies = F.array(F.struct(F.lit(0).cast("long").alias("head"), F.col("body").alias("body")))
    return counted.select("o_custkey", "n_rows", tables.partition_fits(F.col("head"), bodies, F.col("foot"), F.col("n_rows")).alias("fits"))


@query("""
WITH RECURSIVE cells AS (SELECT l_orderkey, l_returnflag AS k,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS c FROM lineitem),
ord AS (SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS r,
  CASE WHEN o_orderstatus IS NOT DISTINCT FROM lag(o_orderstatus) OVER w THEN 0 ELSE 1 END AS ch FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
sec AS (SELECT *, sum(ch) OVER (PARTITION BY o_custkey ORDER BY r ROWS UNBOUNDED PRECEDING) AS section FROM ord),
grid AS (SELECT o_custkey, r, c, k, section FROM sec JOIN cells ON l_orderkey = o_orderkey),
ptr AS (SELECT g.*, CASE WHEN g.k = 'R' AND a.r IS NOT NULL THEN g.r - 1 ELSE g.r END AS pr,
    CASE WHEN g.k = 'A' AND g.c > 0 THEN g.c - 1 ELSE g.c END AS pc
  FROM grid g LEFT JOIN grid a ON a.o_custkey = g.o_custkey AND a.r = g.r - 1 AND a.c = g.c AND a.section = g.section),
walk(o_custkey, r, c, k, ar, ac) AS (
  SELECT o_custkey, r, c, k, r, c FROM ptr
  UNION ALL SELECT w.o_custkey, w.r, w.c, w.k, p.pr, p.pc FROM walk w JOIN ptr p ON p.o_custkey = w.o_custkey AND p.r = w.ar AND p.c = w.ac WHERE p.pr <> p.r OR p.pc <> p.c),
roots AS (SELECT w.* FROM walk w JOIN ptr p ON p.o_custkey = w.o_custkey AND p.r = w.ar AND p.c = w.ac WHERE p.pr = p.r AND p.pc = p.c)
SELECT o_custkey, ar::INTEGER AS r, ac::INTEGER AS c,
  coalesce(max(CASE WHEN k = 'R' AND (r <> ar OR c <> ac) THEN r - ar + 1 END), 1)::INTEGER AS row_span,
  coalesce(max(CASE WHEN k = 'A' AND c <> ac AND r = ar THEN c - ac + 1 END), 1)::INTEGER AS col_span
FROM roots GROUP BY o_custkey, ar, ac
""")
def span_inversion(spark, d):
    sections = runs.number_runs(order_rows(spark, d), ["o_custkey"], ["r"], F.col("o_orderstatus"), "section")
    cells = sections.join(order_cells(spark, d), "o_orderkey")
    span = F.when(F.col("l_returnflag") == "R", "row").when(F.col("l_returnflag") == "A", "col")
    out = tables.invert_spans(cells, "o_custkey", span, "section")
    return out.select("o_custkey", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("row_span").cast("int").alias("row_span"), F.col("col_span").cast("int").alias("col_span"))


@query("SELECT n_regionkey, min(n_nationkey) AS first_row, count(*) AS row_span FROM nation GROUP BY n_regionkey")
def region_rowspans(spark, d):
    one = read(spark, d, "nation").withColumn("t", F.lit(0))
    spans = tables.run_spans(one, ["t"], ["n_regionkey", "n_nationkey"], "n_regionkey")
    first = resolve.first_of_each(one.select("n_regionkey", "n_nationkey"), ["n_regionkey"], ["n_nationkey"])
    return spans.select("n_regionkey", "row_span").join(first.withColumnRenamed("n_nationkey", "first_row"), "n_regionkey")


@query(CELLS_SQL + """
SELECT o_custkey, c::INTEGER AS c, CASE WHEN bool_and(l_returnflag = 'N') OVER (PARTITION BY o_custkey) THEN
  CASE l_linestatus WHEN 'O' THEN 'left' ELSE 'right' END ELSE 'default' END AS align
FROM ord JOIN cells USING (o_orderkey) WHERE r = 0
""")
def column_alignment(spark, d):
    cells = order_rows(spark, d).join(order_cells(spark, d), "o_orderkey")
    align = F.when(F.col("l_linestatus") == "O", "left").otherwise("right")
    return tables.column_alignment(cells, "o_custkey", F.lit(None).cast("string"), is_header(), align)


@query("""
WITH outer_ AS (SELECT s_nationkey, min(s_suppkey) AS k FROM supplier GROUP BY s_nationkey)
SELECT c_custkey, CASE WHEN k % 2 = 1 THEN 's' || k ELSE c_name END AS id,
  array_to_string(CASE WHEN k IS NULL THEN [c_mktsegment, 'n' || c_nationkey] ELSE [c_mktsegment, 'n' || c_nationkey, 'supplied'] END, ' ') AS classes,
  CASE WHEN k IS NULL THEN 'kind=c;nation=' || c_nationkey ELSE 'kind=s;nation=' || c_nationkey || ';key=' || k END AS kv
FROM customer LEFT JOIN outer_ ON s_nationkey = c_nationkey
""")
def attr_merge(spark, d):
    suppliers = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k"))
    rows = read(spark, d, "customer").join(suppliers, F.col("c_nationkey") == F.col("s_nationkey"), "left")
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    inner = attributes.attributes(F.col("c_name"), F.array("c_mktsegment", nation), F.array(pair("kind", F.lit("c")), pair("nation", F.col("c_nationkey"))))
    has = F.col("k").isNotNull()
    outer = attributes.attributes(
        F.when(F.col("k") % 2 == 1, F.concat(F.lit("s"), F.col("k").cast("string"))),
        F.when(has, F.array(nation, F.lit("supplied"))),
        F.when(has, F.array(pair("kind", F.lit("s")), pair("key", F.col("k")))),
    )
    both = rows.select("c_custkey", attributes.merged(inner, outer).alias("a"))
    kv = F.array_join(F.transform("a.kv", lambda p: F.concat(p["k"], F.lit("="), p["v"])), ";")
    return both.select("c_custkey", F.col("a.id").alias("id"), F.array_join("a.classes", " ").alias("classes"), kv.alias("kv"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '☒ ' WHEN 'O' THEN '☐ ' ELSE '' END || o_orderpriority AS item FROM orders")
def task_markers(spark, d):
    checked = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return read(spark, d, "orders").select("o_orderkey", F.concat(text.task_marker(checked), "o_orderpriority").alias("item"))


@query(r"""
WITH links AS (SELECT url AS href FROM pages UNION ALL
  SELECT 'mailto:' || unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+[.][A-Za-z0-9]+')) FROM documents)
SELECT href, CASE WHEN starts_with(href, 'mailto:') THEN 'email' ELSE 'uri' END AS class, count(*) AS n FROM links GROUP BY href
""")
def autolink_class(spark, d):
    mails = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._]+@[A-Za-z0-9]+[.][A-Za-z0-9]+"), F.lit(0)))
    found = read(spark, d, "documents").select(mails.alias("m")).select(F.concat(F.lit("mailto:"), "m").alias("href"))
    links = read(spark, d, "pages").select(F.col("url").alias("href")).union(found)
    return links.groupBy("href").agg(F.count("*").alias("n")).select("href", text.autolink_class(F.col("href")).alias("class"), "n")


@query(r"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  array_to_string([regexp_replace(k, '[.,;:]+$', '') FOR k IN regexp_extract_all('[see @p' || l_partkey || '.; -@s' || l_suppkey || ' \@x]', '(^|[^\\])@([^\s;,\]]+)', 2)], ' ') AS keys
FROM lineitem
""")
def cited_keys(spark, d):
    raw = F.concat(F.lit("[see @p"), F.col("l_partkey").cast("string"), F.lit(".; -@s"), F.col("l_suppkey").cast("string"), F.lit(r" \@x]"))
    return read(spark, d, "lineitem").select(*LI, F.array_join(text.cited_keys(raw), " ").alias("keys"))


@query("""
WITH RECURSIVE marks AS (
  SELECT user_id, event_id AS pos, CASE WHEN event_type IN ('view', 'click') THEN 'DoubleQuote' ELSE 'SingleQuote' END AS kind, event_type IN ('view', 'signup') AS opens,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i
  FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase')),
walk AS (
  SELECT user_id, 0::BIGINT AS i, []::STRUCT(p BIGINT, kind VARCHAR)[] AS stack, NULL::BIGINT AS open_at, NULL::BIGINT AS close_at, NULL::VARCHAR AS kind FROM (SELECT DISTINCT user_id FROM marks)
  UNION ALL
  SELECT user_id, i, CASE WHEN opens THEN list_append(stack, struct_pack(p := pos, kind := kind)) WHEN hit IS NULL THEN stack ELSE stack[1:hit - 1] END, CASE WHEN NOT opens THEN stack[hit].p END, pos, kind
  FROM (SELECT w.user_id, m.i, m.pos, m.kind, m.opens, w.stack, list_max([j FOR j IN range(1, len(w.stack) + 1) IF w.stack[j].kind = m.kind]) AS hit
    FROM walk w JOIN marks m ON m.user_id = w.user_id AND m.i = w.i + 1))
SELECT user_id, open_at, close_at, kind FROM walk WHERE open_at IS NOT NULL
""")
def quote_pairs(spark, d):
    marks = read(spark, d, "events").where("event_type IN ('view', 'click', 'signup', 'purchase')")
    kind = F.when(F.col("event_type").isin("view", "click"), "DoubleQuote").otherwise("SingleQuote")
    return quotes.quote_pairs(marks, ["user_id"], "event_id", kind, F.col("event_type").isin("view", "signup"))


SPELLINGS = ["yes", "No", "on", "OFF", "y", "null", "~", "{}", "{ }", "[a, b]", "[]", "12", "'yes'", "plain text", "True", "tRue", ""]


@query(f"""
WITH raw AS (SELECT unnest({SPELLINGS!r}::VARCHAR[]) AS raw), """.replace("\"'yes'\"", "'''yes'''") + r"""kinds AS (SELECT DISTINCT event_type FROM events),
typed AS (SELECT raw, CASE WHEN replace(raw, ' ', '') = '{}' THEN 'MetaMap' WHEN raw LIKE '[%]' THEN 'MetaList'
  WHEN regexp_full_match(raw, 'y|Y|yes|Yes|YES|true|True|TRUE|on|On|ON|n|N|no|No|NO|false|False|FALSE|off|Off|OFF') THEN 'MetaBool'
  WHEN raw IN ('~', 'null', 'Null', 'NULL') THEN 'MetaString' ELSE 'MetaInlines' END AS kind,
  CASE WHEN length(raw) > 1 AND raw LIKE '''%''' THEN substr(raw, 2, length(raw) - 2) ELSE raw END AS value FROM raw)
SELECT event_type, raw, kind, value FROM typed CROSS JOIN kinds
""")
def yaml_scalars(spark, d):
    kinds = read(spark, d, "events").select("event_type").distinct()
    raws = kinds.select("event_type", F.explode(F.array(*map(F.lit, SPELLINGS))).alias("raw"))
    return raws.select("event_type", "raw", text.yaml_kind(F.col("raw")).alias("kind"), text.unquoted(F.col("raw")).alias("value"))


#: A warning for each rule, with the code it should get, and one that no rule knows.
MESSAGES = [
    ("comment: dropped", "comment-dropped"), ('inline: unknown node type "x"', "unknown-carve-inline"), ('block: unknown node type "y"', "unknown-carve-block"), ('inline: pandoc node "Z"', "unsupported-pandoc-inline"),
    ('block: pandoc node "Null"', "unsupported-pandoc-block"), ("citation: the typed locator", "citation-locator-flattened"), ("citation: @k suppresses its author", "citation-mode-normalized"), ("Cite mixes modes", "citation-mode-normalized"),
    ("Cite mapped to a group", "citation-bibliography-not-emitted"), ("SmallCaps becomes a span", "smallcaps-degraded"), ("short caption: lost", "short-caption-source-unavailable"), ("figure: unwrapped", "figure-unwrapped"),
    ("figure group: short caption lost", "figure-group-short-caption-dropped"), ('frontmatter: format "toml"', "frontmatter-format-unsupported"), ("frontmatter: line 3", "frontmatter-line-skipped"), ("frontmatter: value of k", "frontmatter-value-skipped"),
    ("meta: k is empty", "metadata-empty-blocks-skipped"), ("meta: k", "metadata-value-skipped"), ("definition list: an entry", "definition-entry-skipped"), ("ordered list: a marker", "ordered-list-marker-normalized"),
    ("symbol: :x:", "symbol-unresolved"), ("extension: :k:", "inline-extension-degraded"), ("link: missing definition for [r]", "reference-unresolved"), ('crossref: "t"', "crossref-unresolved"),
    ("list-table: structure", "list-table-structure-degraded"), ("list-table: the short caption", "list-table-short-caption-dropped"), ("list-table: a body group's attributes", "list-table-body-attributes-dropped"),
    ("list-table: the table's 2 body groups", "list-table-body-groups-merged"), ("list-table: the body groups disagree", "list-table-row-heads-normalized"), ("list-table: rowspan", "list-table-rowspan-clipped"),
    ('table: block-level cell content "Div"', "table-cell-blocks-flattened"), ("table: attributes on a cell at row 3, col 2", "table-continuation-attributes-dropped"), ("table: colspan continuation at row 1, col 4", "table-colspan-origin-missing"),
    ("table: rowspan crossing at row 2, col 2", "table-rowspan-clipped"), ("table: rowspan continuation at row 3, col 2", "table-rowspan-origin-missing"), ("table: rows", "table-groups-normalized"), ("nothing like that", None),
]
_LOSSES = ("comment-dropped", "unsupported-pandoc-inline", "unsupported-pandoc-block", "short-caption-source-unavailable", "figure-group-short-caption-dropped", "frontmatter-format-unsupported",
    "frontmatter-line-skipped", "frontmatter-value-skipped", "metadata-empty-blocks-skipped", "metadata-value-skipped", "definition-entry-skipped", "list-table-short-caption-dropped",
    "list-table-body-attributes-dropped", "list-table-rowspan-clipped", "table-cell-blocks-flattened", "table-continuation-attributes-dropped", "table-rowspan-clipped")


def _listed(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


_CLASS_SQL = f"""
WITH c AS (SELECT event_id, user_id, ({_listed(m for m, _ in MESSAGES)})[event_id % {len(MESSAGES)} + 1] AS message, ({_listed(c for _, c in MESSAGES)})[event_id % {len(MESSAGES)} + 1] AS code FROM events)
"""


def event_warnings(spark, d):
    message = F.get(F.array(*[F.lit(m) for m, _ in MESSAGES]), (F.col("event_id") % len(MESSAGES)).cast("int"))
    return diagnostics.classify(read(spark, d, "events").select("event_id", "user_id", message.alias("message")), "message", "forward")


@query(_CLASS_SQL + r"""
SELECT event_id, code, nullif(regexp_extract(message, 'node(?: type)? "([^"]+)"', 1), '') AS node_type,
  nullif(regexp_extract(message, '\brow (\d+)', 1), '')::INTEGER AS row_, nullif(regexp_extract(message, '\bcol (\d+)', 1), '')::INTEGER AS col_ FROM c
""")
def diagnostic_class(spark, d):
    out = event_warnings(spark, d)
    return out.select("event_id", "code", "details.node_type", F.col("details.row").alias("row_"), F.col("details.column").alias("col_"))


@query(_CLASS_SQL + f"SELECT user_id, coalesce(bool_or(code IN ({_listed(_LOSSES)[1:-1]})), false) AS has_loss FROM c GROUP BY user_id")
def loss_gate(spark, d):
    return diagnostics.loss_gate(event_warnings(spark, d), ["user_id"])


@query("""
WITH e AS (SELECT event_id, '{"v":1,"kind":"comment","node":' || props || '}' AS payload FROM events)
SELECT event_id, rtrim(translate(base64(payload::BLOB), '+/', '-_'), '=') AS envelope, payload FROM e
""")
def provenance_envelope(spark, d):
    payload = F.concat(F.lit('{"v":1,"kind":"comment","node":'), "props", F.lit("}"))
    packed = read(spark, d, "events").select("event_id", text.base64url(payload).alias("envelope"))
    return packed.select("event_id", "envelope", text.from_base64url(F.col("envelope")).cast("string").alias("payload"))


def ledger_sides(spark, d):
    lossy = read(spark, d, "documents").where("n_chars > 3000").select("doc_id")
    return resolve.ledger(lossy, read(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id")


@query("SELECT doc_id FROM documents WHERE n_chars > 3000 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def ledger_new(spark, d):
    return ledger_sides(spark, d)[0]


@query("SELECT doc_id FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 3000)")
def ledger_fixed(spark, d):
    return ledger_sides(spark, d)[1]


@query("""
SELECT page_id, len(regexp_extract_all(html, '<h1[ >]'))::INTEGER AS h1, len(regexp_extract_all(html, '<p[ >]'))::INTEGER AS p,
  len(regexp_extract_all(html, '<li[ >]'))::INTEGER AS li, len(regexp_extract_all(html, '<a[ >]'))::INTEGER AS a FROM pages
""")
def html_outline(spark, d):
    count = lambda tag: F.regexp_count("html", F.lit(f"<{tag}[ >]")).alias(tag)
    return read(spark, d, "pages").select("page_id", *[count(t) for t in ("h1", "p", "li", "a")])


HTML_SQL = r"""
WITH tagged AS (SELECT page_id, string_split(regexp_replace(replace(html, chr(1), ''), '(<[A-Za-z0-9_]+(?:[\s\x0B\x{A0}]+[A-Za-z0-9_:-]+(?:="[^"]*")?)+[\s\x0B\x{A0}]*/?>)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts FROM pages),
whole AS (SELECT page_id, array_to_string(list_transform(parts, lambda p, i: CASE WHEN i % 2 = 0 THEN '<' || regexp_extract(p, '^<([A-Za-z0-9_]+)', 1) || ' '
  || array_to_string(list_sort(regexp_extract_all(regexp_extract(p, '^<[A-Za-z0-9_]+(.*?)/?>$', 1, 's'), '[A-Za-z0-9_:-]+(?:="[^"]*")?')), ' ') || CASE WHEN p LIKE '%/>' THEN '/' ELSE '' END || '>' ELSE p END), '') AS h FROM tagged)
SELECT page_id, md5(trim(regexp_replace(h, '[\s\x0B\x{A0}]+', ' ', 'g'))) AS digest FROM whole
"""


@query(HTML_SQL)
def html_normalised(spark, d):
    """Pages with the attributes of each tag in order and runs of white space as one space."""
    return read(spark, d, "pages").select("page_id", F.md5(corpus.normal_html(F.col("html"))).alias("digest"))


@query(r"""
WITH RECURSIVE lines AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
    CASE event_type WHEN 'view' THEN '::: compare' WHEN 'click' THEN ' :::: compare as ' || event_id WHEN 'purchase' THEN ':::' WHEN 'signup' THEN '::::' ELSE event_type END AS line FROM events),
walk AS (
  SELECT user_id, 0::BIGINT AS i, '' AS marker, 0::BIGINT AS declared FROM (SELECT DISTINCT user_id FROM lines)
  UNION ALL
  SELECT w.user_id, l.i, CASE WHEN marker <> '' THEN CASE WHEN trim(line) = marker THEN '' ELSE marker END WHEN regexp_full_match(trim(line), ':{3,}\s+compare(\s+\S.*)?') THEN regexp_extract(trim(line), '^:+') ELSE '' END,
    declared + CASE WHEN marker = '' AND regexp_full_match(trim(line), ':{3,}\s+compare(\s+\S.*)?') THEN 1 ELSE 0 END
  FROM walk w JOIN lines l ON l.user_id IS NOT DISTINCT FROM w.user_id AND l.i = w.i + 1)
SELECT user_id, max(declared)::BIGINT AS declared FROM walk GROUP BY user_id
""")
def declared_blocks(spark, d):
    """How many example blocks the lines of each user's events open, a line an event."""
    t, n = F.col("event_type"), F.col("event_id").cast("string")
    line = F.when(t == "view", "::: compare").when(t == "click", F.concat(F.lit(" :::: compare as "), n)).when(t == "purchase", ":::").when(t == "signup", "::::").otherwise(t)
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return corpus.declared_blocks(read(spark, d, "events").select("user_id", at.alias("at"), line.alias("line")), "user_id", "at", "line", size=64)
