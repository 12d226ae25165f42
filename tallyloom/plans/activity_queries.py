"""Shell commands over a table of them, and small operators over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as fx
from tallyloom.operators import commands, tables
from tallyloom.plans.registry import query, table

DICTIONARY = [
    ("a.json", "tar", 0, 0, "tar {{[-x|--extract]}} {{[-v|--verbose]}} {{[-z|--gzip]}} {{path}}", "Extract a compressed archive"),
    ("a.json", "ls", 0, 0, "ls -l", "Long listing"), ("a.json", "ls", 1, 0, "ls -a", "List hidden entries"), ("b.json", "git", 0, 0, "git commit {{[-m|--message]}} {{text}}", "Commit with a message"),
    ("b.json", "ping", 0, 0, "ping {{host}}", "Ping a host"),
]
_FIELDS = "file string, cmd_name string, entry_ord int, pattern_ord int, pattern string, description string"


def _commands(spark, d):
    """A command a page: an archive and a listing, a download, a commit and a filter, or a host."""
    p, i = table(spark, d, "pages"), F.col("page_id").cast("string")
    text = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("sudo tar -xvz /tmp/a"), i, F.lit(".tar && ls -la /home/u"), i)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("curl -s  "), "url"))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("git commit -m 'msg "), i, F.lit("' | grep x"), i)).otherwise(F.concat(F.lit("ping host"), i, F.lit(".example.com")))
    )
    return p.select(F.col("page_id").alias("id"), text.alias("command"))


@query("""select page_id id, 0::bigint part, 'tar -x -v -z /tmp/a' || page_id || '.tar' as text, 'tar|tar -x|tar -v|tar -z|/tmp/a' || page_id || '.tar' elems from pages where page_id % 4 = 0
union all select page_id, 1, 'ls -l -a /home/u' || page_id, 'ls|ls -l|ls -a|/home/u' || page_id from pages where page_id % 4 = 0 union all select page_id, 0, 'curl -s ' || url, 'curl|curl -s|' || url from pages where page_id % 4 = 1
union all select page_id, 0, 'git commit -m ''msg ' || page_id || '''', 'git|git commit|git commit -m|''msg ' || page_id || '''' from pages where page_id % 4 = 2 union all select page_id, 1, 'grep x' || page_id, 'grep|x' || page_id from pages where page_id % 4 = 2
union all select page_id, 0, 'ping host' || page_id || '.example.com', 'ping|host' || page_id || '.example.com' from pages where page_id % 4 = 3""")
def cmd_elements(spark, d):
    return commands.command_parts(_commands(spark, d)).select("id", F.col("part").cast("bigint").alias("part"), "text", F.array_join("elems", "|").alias("elems"))


@query("""select page_id id, 0::bigint part, 'with sudo desc_cmd: Extract a compressed archive|desc_arg_4: File ''/tmp/a' || page_id || '.tar''' descriptions from pages where page_id % 4 = 0
union all select page_id, 1, 'with sudo desc_0: Command ''ls''|desc_1: Long listing|desc_2: List hidden entries|desc_3: Folder ''/home/u' || page_id || '''' from pages where page_id % 4 = 0
union all select page_id, 0, 'desc_0: Command ''curl''|desc_1: Argument ''curl -s''|desc_2: URL ''' || url || '''' from pages where page_id % 4 = 1
union all select page_id, 0, 'desc_cmd: Commit with a message|desc_arg_3: String ''''msg ' || page_id || '''''' from pages where page_id % 4 = 2
union all select page_id, 1, 'desc_0: Command ''grep''|desc_1: Argument ''x' || page_id || '''' from pages where page_id % 4 = 2
union all select page_id, 0, 'desc_0: Command ''ping''|desc_1: Website / Domain ''host' || page_id || '.example.com''' from pages where page_id % 4 = 3""")
def cmd_describe(spark, d):
    found = commands.describe_commands(_commands(spark, d), spark.createDataFrame(DICTIONARY, _FIELDS))
    return found.select("id", F.col("part").cast("bigint").alias("part"), F.array_join("descriptions", "|").alias("descriptions"))


def _dictionary(spark, d):
    """An entry a supplier, with a choice of option and a place for a path."""
    s, i = table(spark, d, "supplier"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string"))
    return s.select(F.lit("a.json").alias("file"), i.alias("cmd_name"), F.lit(0).alias("entry_ord"), F.lit(0).alias("pattern_ord"), F.concat(i, F.lit(" {{[-a|--all]}} {{path}}")).alias("pattern"), F.concat(F.lit("about "), i).alias("description"))


@query("select c cmd_name, c || '|' || c || o as key, 'about ' || c description from (select 'c' || s_suppkey c from supplier), (values (' -a'), (' --all')) t(o)")
def cmd_patterns(spark, d):
    """What the patterns of each command say for its name with either option, and for one that they don't have."""
    known = _dictionary(spark, d)
    keys = known.select("cmd_name", F.lit("loose").alias("form"), F.explode(F.transform(F.array(F.lit(" -a"), F.lit(" --all"), F.lit(" -b")), lambda o: F.array("cmd_name", F.concat("cmd_name", o)))).alias("key"))
    return commands.match_keys(known, keys).select("cmd_name", F.array_join("key", "|").alias("key"), "description")


@query("select 'c' || p_partkey command, case when p_partkey in (select s_suppkey from supplier) then 'OK' else 'MISSING' end status from part")
def cmd_availability(spark, d):
    c = table(spark, d, "part").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("command"))
    return commands.availability(c, _dictionary(spark, d))


@query("select 'c' || s_suppkey cmd_name, 'c' || s_suppkey || ' sub' pattern, 'd' description from supplier")
def cmd_new_subcommands(spark, d):
    """Subcommands that the dictionary has not: of two named, one is a pattern already."""
    own = _dictionary(spark, d)
    old = own.withColumn("pattern", F.concat("cmd_name", F.lit(" old")))
    found = own.select("cmd_name", F.explode(F.array(F.lit("sub"), F.lit("sub"), F.lit("old"))).alias("subcommand"), F.lit("d").alias("description"))
    return commands.new_subcommands(old, found)


@query("""select 'c' || s_suppkey cmd_name, 0 entry_ord, 'About ' || s_suppkey || ' things' description, 'c' || s_suppkey || ' --new,c' || s_suppkey || ' -a' cmds from supplier
union all select 'c' || s_suppkey, 1, 'quite other', 'c' || s_suppkey || ' -q' from supplier""")
def cmd_merge_options(spark, d):
    """One option whose description an entry holds, and one of its own."""
    c = _dictionary(spark, d).select("cmd_name", "entry_ord", F.concat(F.lit("About "), F.substr("cmd_name", F.lit(2)), F.lit(" things")).alias("description"), F.concat("cmd_name", F.lit(" -a")).alias("pattern"))
    near = c.select("cmd_name", F.concat(F.lit(" about "), F.substr("cmd_name", F.lit(2))).alias("description"), F.array(F.concat("cmd_name", F.lit(" --new"))).alias("variants"))
    other = c.select("cmd_name", F.lit("quite other").alias("description"), F.array(F.concat("cmd_name", F.lit(" -q"))).alias("variants"))
    return commands.merge_options(c, near.unionByName(other)).select("cmd_name", "entry_ord", "description", F.array_join("cmds", ",").alias("cmds"))


@query("""with a as (select r_name, row_number() over (order by r_regionkey) k from region), b as (select n_name, row_number() over (order by n_nationkey) k from nation), c as (select item_id, row_number() over (order by item_id) k from benchmark)
select coalesce(a.k, b.k, c.k) - 1 n, r_name one, n_name two, item_id three from a full join b on a.k = b.k full join c on coalesce(a.k, b.k) = c.k""")
def zip_streams(spark, d):
    t = lambda n: table(spark, d, n)
    return tables.zip_by_place({"one": (t("region"), "r_regionkey", "r_name"), "two": (t("nation"), "n_nationkey", "n_name"), "three": (t("benchmark"), "item_id", "item_id")})


@query("select *, row_number() over (order by o_orderdate, o_orderkey) - 1 as number from orders")
def renumber_orders(spark, d):
    return tables.renumber(table(spark, d, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")], 0, "number")


@query("select *, row_number() over (order by source, doc_id) number from documents")
def renumber_documents(spark, d):
    return tables.renumber(table(spark, d, "documents"), [F.col("source"), F.col("doc_id")], 1, "number")


@query("""with n as (select *, row_number() over (order by doc_id) - 1 n, count(*) over () total from documents)
select * exclude (total), case when n < cast(floor(total * 0.85) as bigint) then 'train' when n < cast(floor(total * 0.95) as bigint) then 'validation' else 'test' end split from n""")
def split_documents(spark, d):
    docs = table(spark, d, "documents")
    return tables.positional_split(tables.renumber(docs, [F.col("doc_id")]), "n", docs.count(), {"train": 0.85, "validation": 0.1, "test": 0.05})


@query("select *, row_number() over (order by md5('7:' || doc_id), doc_id) - 1 place from documents")
def shuffle_documents(spark, d):
    return tables.seeded_shuffle(table(spark, d, "documents"), "doc_id", 7)


@query("""with a as (select text, row_number() over (order by doc_id) k from documents), b as (select o_totalprice, row_number() over (order by o_orderkey) k from orders), c as (select url, row_number() over (order by page_id) k from pages)
select coalesce(a.k, b.k, c.k) - 1 n, text, o_totalprice price, url from a full join b on a.k = b.k full join c on coalesce(a.k, b.k) = c.k""")
def zip_tables(spark, d):
    t = lambda n: table(spark, d, n)
    return tables.zip_by_place({"text": (t("documents"), "doc_id", "text"), "price": (t("orders"), "o_orderkey", "o_totalprice"), "url": (t("pages"), "page_id", "url")})


@query("with a as (select conv_id, count(*)::double n from conversations group by 1) select min(n) lo, max(n) hi, round(avg(n), 6) mean, median(n) med from a")
def array_sizes(spark, d):
    """Least, largest, mean and median number of turns of the conversations' arrays."""
    n = F.col("n")
    sizes = table(spark, d, "conversations").groupBy("conv_id").agg(F.size(F.collect_list("turn")).cast("double").alias("n"))
    return sizes.agg(F.min(n).alias("lo"), F.max(n).alias("hi"), F.round(F.avg(n), 6).alias("mean"), F.median(n).alias("med"))


@query("select conv_id, turn, coalesce(list_sum(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w))), 0)::bigint letters from conversations")
def token_lengths(spark, d):
    total = F.aggregate(fx.word_tokens(F.col("text")), F.lit(0).cast("bigint"), lambda s, w: s + F.length(w))
    return table(spark, d, "conversations").select("conv_id", "turn", total.alias("letters"))


@query("select event_id, row_number() over (order by md5('7:' || event_id), event_id) - 1 place from events")
def seeded_shuffle(spark, d):
    return tables.seeded_shuffle(table(spark, d, "events").select("event_id"), "event_id", 7)


@query("""with w as (select item_id, i, w[i] x from (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') w from benchmark), unnest(range(1, len(w) + 1)) t(i)), f as (select item_id, x, min(i) i from w group by all)
select item_id, string_agg(x, ' ' order by i) words from f group by item_id""")
def ordered_distinct(spark, d):
    """The distinct words of a text in the order of their first places."""
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_distinct(fx.word_tokens(F.col("text"))), " ").alias("words")).filter("words <> ''")


@query("select event_type, count(distinct user_id) users from events group by event_type")
def distinct_count(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("select event_id, event_type from events where event_type in ('view', 'click') and user_id in (select s_suppkey from supplier)")
def type_and_id_filter(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("view", "click"))
    return e.join(table(spark, d, "supplier"), F.col("user_id") == F.col("s_suppkey"), "left_semi").select("event_id", "event_type")


@query("select o_orderkey, printf('%.2f', o_totalprice) price from orders")
def two_decimals(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.format_string("%.2f", F.col("o_totalprice").cast("double")).alias("price"))


@query("select conv_id from conversations group by conv_id having count(*) = 3")
def arrays_of_three(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("turns")).filter(F.size("turns") == 3).select("conv_id")


@query("select (doc_id - 1)::varchar id, 'name' || doc_id filename from documents")
def shifted_records(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("name"), F.col("doc_id").cast("string"), F.lit(".txt - "), "lang", F.lit(" - "), "source").alias("t"))
    return tables.file_records(t, "t", F.col("doc_id"), 1).select("id", "filename")


_TITLE = "case doc_id % 3 when 0 then '● ' else '' end || '● ' || source || '●' || doc_id"


@query(f"select doc_id, case when t[1:2] = '● ' then t[3:] else t end first_mode, trim(replace(t, '●', '')) all_mode from (select doc_id, {_TITLE} t from documents)")
def title_modes(spark, d):
    t = F.concat(F.when(F.col("doc_id") % 3 == 0, "● ").otherwise(""), F.lit("● "), F.col("source"), F.lit("●"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", fx.normalize_title(t, "first").alias("first_mode"), fx.normalize_title(t, "all").alias("all_mode"))
