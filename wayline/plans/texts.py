"""Names, pages, alerts, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayline.functions import codec, words
from wayline.operators import alerts, search
from wayline.plans import transit as t
from wayline.registry import query
from wayline.sources import news_lists


@query("""SELECT p_partkey AS id, translate(lower(trim(p_name)), 'ąćęłńóśźżáàâäãåčďéèêëěíìîïňòôöõřšťúùûüůýÿçñ', 'acelnoszzaaaaaacdeeeeeiiiinoooorstuuuuuyycn') AS norm, regexp_replace(regexp_replace(translate(lower(trim(p_name)), 'ąćęłńóśźż', 'acelnoszz'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part""")
def normalized_names(spark, sf_dir):
    n = F.col("p_name")
    return t.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), words.normalized(n).alias("norm"), words.slug(n).alias("slug"))


#: Letters with marks, as one character or two, and one with a stroke and one that isn't a mark.
LETTERS = ["\u017e", "\u011f", "\u0150", "\u0101", "e\u0301", "\u0141", "\u00f8", "\u1ec7", "\u0439", "\u03ac", "a\u0323\u0302", "\u00c5"]


@query(f"""SELECT p_partkey AS id, trim(replace(strip_accents(lower(p_name || ' ' || (['{"', '".join(LETTERS)}'])[1 + p_partkey % {len(LETTERS)}] || 'x')), 'ł', 'l')) AS norm FROM part""")
def unmarked_names(spark, sf_dir):
    """Names with a letter of other alphabets and marks of their own."""
    letter = F.element_at(F.array(*map(F.lit, LETTERS)), (F.col("p_partkey") % len(LETTERS) + 1).cast("int"))
    return t.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), words.normalized(F.concat("p_name", F.lit(" "), letter, F.lit("x"))).alias("norm"))


@query("""SELECT p_partkey AS id, p_name AS name FROM part WHERE (lower(p_name) LIKE '%red%' AND lower(p_name) LIKE '%bo%') OR replace(lower(p_name), ' ', '') LIKE '%redbo%'""")
def name_prefilter(spark, sf_dir):
    return search.prefiltered(t.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "red bo")


@query("""SELECT p_partkey AS id, p_name AS name, p_size AS weight, greatest(92, 98 - (len(p_name) - 5))::DOUBLE AS score FROM part WHERE lower(p_name) LIKE 'red b%' ORDER BY score DESC, weight DESC, id LIMIT 15""")
def name_search(spark, sf_dir):
    """The best 15 of the names that hold all that was typed (a top list by design), as on a device; ``typo_search`` scores every name."""
    p = t.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("weight"))
    return search.search(search.prefiltered(p, "red b"), "red b").select("id", "name", "weight", "score")


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(script|style)\\b.*?</(script|style)>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""".replace("\\\\", "\\"))
def page_texts(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", words.page_text(F.col("html")).alias("text"))


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(upper(html), '\\b([A-Z]?[0-9]{1,3}|[A-Z])\\b', 1), lambda x: x IN ('A', 'B2', '7', '10', '145')))), ',') AS lines FROM pages""".replace("\\\\", "\\"))
def lines_in_pages(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", F.array_join(words.named_lines(F.col("html"), ["A", "B2", "7", "10", "145"]), ",").alias("lines"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INT) BETWEEN 10 AND 60""")
def json_numbers(spark, sf_dir):
    """Numbers of an allow-list of keys out of a JSON column, within bounds."""
    m = F.map_filter(F.from_json("props", "map<string,int>"), lambda k, v: k.isin("k", "n") & v.between(10, 60))
    return t.read(spark, sf_dir, "events").select("event_id", m["k"].alias("k")).where("k is not null")


@query("""SELECT event_id FROM (SELECT event_id, ts AS a, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts + INTERVAL 2 DAY END AS b, event_type = 'error' AS r FROM events) WHERE a <= TIMESTAMP '2024-01-20' AND (b IS NULL OR b + INTERVAL 12 HOUR >= TIMESTAMP '2024-01-20') AND NOT r""")
def alerts_in_force(spark, sf_dir):
    end = F.when(F.col("event_id") % 4 != 0, F.col("ts") + F.expr("interval 2 days"))
    return t.read(spark, sf_dir, "events").where(alerts.in_force(F.lit("2024-01-20").cast("timestamp"), F.col("ts"), end, F.col("event_type") == "error")).select("event_id")


@query("""SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'a' ELSE 'b' END || ':' || array_to_string(list_sort(list_distinct([lower(o_orderstatus), lower(o_orderpriority)])), '|') AS names FROM orders""")
def alert_names(spark, sf_dir):
    """Names out of a nested record, each once whatever its case."""
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    record = F.struct(F.array(F.struct(s.alias("line"), F.array(p, F.upper(p)).alias("stops"))).alias("lines"), F.array(s, F.lit(" ")).alias("stops"), F.array(F.struct(F.array(F.lower(s)).alias("stops"))).alias("phases")).cast(alerts.ALERT)
    names = F.array_sort(F.transform(alerts.names_in(record), F.lower))
    return t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.when(p == "1-URGENT", "a").otherwise("b"), F.lit(":"), F.array_join(names, "|")).alias("names"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE 0 END AS bits,
  concat_ws(',', CASE WHEN o_orderkey % 10 = 0 THEN 'lift' END, CASE WHEN o_orderkey % 3 = 0 THEN 'ramp' END, CASE WHEN o_orderkey % 7 = 0 THEN 'wc' END) AS names FROM orders""")
def feature_bits(spark, sf_dir):
    order = ["lift", "ramp", "wc"]
    k = F.col("o_orderkey")
    have = F.array_compact(F.array(F.when(k % 7 == 0, "wc"), F.when(k % 10 == 0, "lift"), F.when(k % 3 == 0, "ramp"), F.lit("other")))
    bits = codec.bits_of(have, order)
    return t.read(spark, sf_dir, "orders").select(k.alias("id"), bits.alias("bits"), F.array_join(codec.names_of(bits, order), ",").alias("names"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> o_orderkey % 9 AND o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR || ',' || substr(o_orderkey::VARCHAR, 1, len(o_orderkey::VARCHAR) - 1) || (o_orderkey % 9)::VARCHAR ELSE o_orderkey::VARCHAR END AS numbers FROM orders""")
def train_numbers(spark, sf_dir):
    """What a number like 8308/9 stands for."""
    k = F.col("o_orderkey")
    text = F.when(k % 2 == 0, F.concat_ws("/", k.cast("string"), (k % 9).cast("string"))).otherwise(k.cast("string"))
    return t.read(spark, sf_dir, "orders").select(k.alias("id"), F.array_join(words.number_variants(text), ",").alias("numbers"))


@query("""SELECT page_id, len(html) < 2500 AND regexp_matches(html, '(?i)(facebook|twitter|href)') AS junk FROM pages""")
def junk_pages(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", ((F.length("html") < 2500) & F.col("html").rlike("(?i)(facebook|twitter|href)")).alias("junk"))


@query("""SELECT doc_id, rtrim(substr(array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> '')[1:3], ' '), 1, 26)) AS label FROM documents""".replace("\\\\", "\\"))
def short_labels(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").select("doc_id", words.short_label(F.col("text")).alias("label"))


@query("""SELECT url, count(*) AS n, (hash_of % 256)::BIGINT AS shard FROM (SELECT url, page_id % 256 AS hash_of FROM pages) GROUP BY 1, 3""")
def shard_counts(spark, sf_dir):
    """Rows by shard of their key, as a partitioned write deals them."""
    return t.read(spark, sf_dir, "pages").groupBy("url", F.pmod("page_id", F.lit(256)).alias("shard")).agg(F.count("*").alias("n")).select("url", "n", "shard")


#: Shown text: references of HTML stand with or without their semicolon, as where a text was cut off.
SHOWN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'gs'), '&nbsp;?', ' ', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#39(;|$|([^0-9;]))', '''\2', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))"""


@query(f"""WITH l AS (SELECT page_id AS page, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li>(.*?)</li>', 1) AS x FROM pages WHERE page_id % 2 = 0),
  m AS (SELECT page, 'menu' AS source, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS n FROM l),
  a AS (SELECT page_id AS page, 'article' AS source, 0 AS n, regexp_extract(html, '<article>.*?<h1>(.*?)</h1>', 1, 's') AS title, regexp_extract(html, '<article>.*?<p>(.*?)(<p>|</p>|</article>)', 1, 's') AS lead FROM pages WHERE page_id % 2 = 1)
  SELECT page, source, n::INT AS n, {SHOWN.format(x="x")} AS title, regexp_extract(x, 'href="([^"]*)"', 1) AS link, NULL::VARCHAR AS lead FROM m WHERE {SHOWN.format(x="x")} <> ''
  UNION ALL SELECT page, source, n::INT, {SHOWN.format(x="title")}, NULL::VARCHAR, {SHOWN.format(x="lead")} FROM a WHERE {SHOWN.format(x="title")} <> ''""")
def news_in_pages(spark, sf_dir):
    """Items of two kinds of list pages by their rules: menus with links, and articles with a lead."""
    rules = spark.createDataFrame([("menu", "nav ul li", "a", None, "a@href", None), ("article", "article", "h1", None, None, "p")], "source string, item string, title string, date string, link string, lead string")
    pages = t.read(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.when(F.col("page_id") % 2 == 0, "menu").otherwise("article").alias("source"), "html")
    return news_lists.list_items(pages, rules).drop("date")
