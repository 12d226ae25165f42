"""Functions over lines of help, answers and titles, on lines made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as fx
from tallyloom.operators import models, tables
from tallyloom.plans.registry import query, table

_S = lambda c: F.col(c).cast("string")

_LINE = """(select page_id, case page_id % 4 when 0 then 'no dot ' || page_id when 1 then url || ' opened page ' || page_id when 2 then 'notes v1.' || page_id || '.txt -  saved, 2' else 'ends in a dot.' end line from pages)"""


@query(f"select page_id, case when regexp_matches(line, '\\.\\s*\\S') then regexp_replace(line, '^(.*\\.)\\s*(\\S*)[^.]*$', '\\1\\2') else line end line from {_LINE}")
def extension_trim(spark, d):
    i, n = F.col("page_id") % 4, _S("page_id")
    line = F.when(i == 0, F.concat(F.lit("no dot "), n)).when(i == 1, F.concat("url", F.lit(" opened page "), n)).when(i == 2, F.concat(F.lit("notes v1."), n, F.lit(".txt -  saved, 2"))).otherwise("ends in a dot.")
    return table(spark, d, "pages").select("page_id", fx.trim_after_extension(line).alias("line"))


@query("""with w as (select c_custkey, string_split('0x' || c_custkey || ' ' || c_nationkey || case when c_custkey % 5 = 0 then ' other' else ' host-' || lower(c_mktsegment) end || ' ' || c_name || ' host-x page', ' ') w from customer),
p as (select *, list_position(list_transform(w, lambda x: starts_with(x, 'host-')), true) p from w) select c_custkey, array_to_string(w[p + 1:], ' ') title from p""")
def host_title(spark, d):
    host = F.when(F.col("c_custkey") % 5 == 0, " other").otherwise(F.concat(F.lit(" host-"), F.lower("c_mktsegment")))
    line = F.concat(F.lit("0x"), _S("c_custkey"), F.lit(" "), _S("c_nationkey"), host, F.lit(" "), "c_name", F.lit(" host-x page"))
    return table(spark, d, "customer").select("c_custkey", fx.title_after_host(F.split(line, " "), "host-").alias("title"))


@query("""with t as (select o_orderkey, '"' || o_orderpriority || '",' || chr(10) || ' "' || o_orderstatus || ', and' || chr(10) || 'more", "", "' || (o_orderkey % 9) || '" ' t from orders)
select o_orderkey, array_to_string(list_filter(list_transform(string_split(replace(trim(trim(t), '"'), chr(10), ' '), '",'), lambda x: trim(trim(trim(x), '"'))), lambda x: x <> ''), '|') items from t""")
def answer_items(spark, d):
    text = F.concat(F.lit('"'), "o_orderpriority", F.lit('",\n "'), "o_orderstatus", F.lit(', and\nmore", "", "'), (F.col("o_orderkey") % 9).cast("string"), F.lit('" '))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(fx.response_items(text), "|").alias("items"))


@query("""with t as (select o_orderkey, case o_orderkey % 3 when 0 then 'nothing here' when 1 then 'intro' || chr(10) || 'desc_0: ' || o_orderpriority || chr(10) || '  desc_1: a: b' || chr(10) || 'desc_2:' else 'desc_cmd ' || o_orderkey end t from orders),
l as (select o_orderkey, list_filter(list_transform(list_filter(string_split(t, chr(10)), lambda x: starts_with(trim(x), 'desc_')), lambda x: trim(regexp_replace(x, '^[^:]*:?', ''))), lambda x: x <> '') l from t)
select o_orderkey, case when len(l) > 0 then array_to_string(l, '|') else 'No description was found.' end lines from l""")
def answer_descriptions(spark, d):
    i, n = F.col("o_orderkey") % 3, _S("o_orderkey")
    text = F.when(i == 0, "nothing here").when(i == 1, F.concat(F.lit("intro\ndesc_0: "), "o_orderpriority", F.lit("\n  desc_1: a: b\ndesc_2:"))).otherwise(F.concat(F.lit("desc_cmd "), n))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(fx.description_lines(text), "|").alias("lines"))


_HELP = """(select p_partkey, case p_partkey % 5 when 0 then '-s, --size <' || p_size || '>  ' || p_type when 1 then '(-b: --brand;) - ' || p_name when 2 then '--' || lower(replace(p_brand, '#', '-')) || ', -x,y - z - number of ' || p_name
when 3 then '-q' else p_name || '   a - b  user' end block from part)"""


def _help(spark, d):
    i = F.col("p_partkey") % 5
    block = (
        F.when(i == 0, F.concat(F.lit("-s, --size <"), _S("p_size"), F.lit(">  "), "p_type")).when(i == 1, F.concat(F.lit("(-b: --brand;) - "), "p_name"))
        .when(i == 2, F.concat(F.lit("--"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit(", -x,y - z - number of "), "p_name")).when(i == 3, "-q").otherwise(F.concat("p_name", F.lit("   a - b  user")))
    )
    return table(spark, d, "part").select("p_partkey", fx.left_and_description(block).alias("h"))


_SPLIT = f"""(select p_partkey, case when regexp_matches(block, '\\s{{2}}') then regexp_extract(block, '(?s)^(.*?)\\s{{2,}}(.*)$', 1) when regexp_matches(block, '(?s)^(.+?)\\s+-\\s+(.*)$') then regexp_extract(block, '(?s)^(.+?)\\s+-\\s+(.*)$', 1) else block end l,
case when regexp_matches(block, '\\s{{2}}') then regexp_extract(block, '(?s)^(.*?)\\s{{2,}}(.*)$', 2) when regexp_matches(block, '(?s)^(.+?)\\s+-\\s+(.*)$') then regexp_extract(block, '(?s)^(.+?)\\s+-\\s+(.*)$', 2) else '' end d from {_HELP})"""


@query(f"select p_partkey, trim(l) \"left\", trim(d) description from {_SPLIT}")
def help_split(spark, d):
    return _help(spark, d).select("p_partkey", "h.left", "h.description")


@query(f"""select p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(trim(trim(trim(l)), '()'), '[,\\s]'), lambda x: starts_with(x, '-')), lambda x: regexp_replace(x, '[:;]$', '')), '|') options from {_SPLIT}""")
def help_option_tokens(spark, d):
    return _help(spark, d).select("p_partkey", F.array_join(fx.option_tokens(F.col("h.left")), "|").alias("options"))


_WORDS = " ".join(f"when contains(lower(t), '{w}') then '{m}'" for w, m in fx.ARGUMENT_WORDS.items())


@query(f"select doc_id, case {_WORDS} else '<arg>' end mark, doc_id % 3 = 0 or ({' or '.join(f'''contains(lower(t), '{w}')''' for w in fx.ARGUMENT_WORDS)}) needs from (select doc_id, text t from documents)")
def option_placeholders(spark, d):
    """What stands for an option's value, and whether it takes one, by the words of a description."""
    options = F.array(F.lit("-a"), F.when(F.col("doc_id") % 3 == 0, "--all").otherwise("-b"))
    return table(spark, d, "documents").select("doc_id", fx.placeholder_for(F.col("text")).alias("mark"), fx.needs_argument(F.col("text"), options).alias("needs"))


@query("""with v as (select vec_id, embedding::double[] a, list_transform(embedding::double[], lambda x, i: case when vec_id % 3 = 0 and i <= 8 then -x when vec_id % 3 = 1 then 2 * x else x end) b from embeddings)
select vec_id, round(list_cosine_similarity(a, b), 6) cosine, list_cosine_similarity(a, b) >= 0.99 agrees from v""")
def stored_against_fresh(spark, d):
    """Stored vectors against ones made anew: a third is longer, a third has some signs turned."""
    e = table(spark, d, "embeddings")
    k = F.col("vec_id") % 3
    fresh = e.select("vec_id", F.transform("embedding", lambda x, i: F.when((k == 0) & (i < 8), -x).when(k == 1, 2 * x).otherwise(x)).alias("embedding"))
    return models.stored_vectors_agree(e.select("vec_id", "embedding"), fresh, "vec_id").withColumn("cosine", F.round("cosine", 6))


@query("select * from documents order by md5('7:' || doc_id), doc_id limit 200")
def sample200(spark, d):
    """The first 200 documents of a seeded order."""
    return tables.sampled(table(spark, d, "documents"), "doc_id", 7, 200)
