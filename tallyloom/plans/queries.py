"""The queries over the tables, by name, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as fx
from tallyloom.functions.token_types import HTTP_METHODS, NETWORK_COMMANDS, PATTERNS, PORT_AFTER, TCPDUMP_VALUES, token_type, type_label, word_type
from tallyloom.operators import clustering, events, linkage, models, percentiles, rouge, similarity, tables, tasks
from tallyloom.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401  read from here
from tallyloom.plans.registry import table as _t

def _numbered(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """The events of a kind, numbered by time within their user."""
    e = _t(spark, d, "events").filter(F.col("event_type") == kind).select("event_id", "ts", "user_id")
    return e.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return events.pair_intervals(_numbered(spark, d, "view"), _numbered(spark, d, "purchase"), ["user_id"])


_PAIRS = """o as (select event_id, ts, user_id, row_number() over (partition by user_id order by ts, event_id) pos from events where event_type='view'),
c as (select event_id, ts, user_id, row_number() over (partition by user_id order by ts, event_id) pos from events where event_type='purchase'),
ok as (select o.*, row_number() over (partition by user_id order by pos) k, 1 + (select count(*) from c where c.user_id=o.user_id and c.pos < o.pos) l from o),
orr as (select *, k + max(l - k) over (partition by user_id order by k rows unbounded preceding) r from ok),
cr as (select *, row_number() over (partition by user_id order by pos) r from c),
p as (select orr.user_id, orr.event_id open_id, cr.event_id close_id, orr.ts open_ts, cr.ts close_ts, orr.pos pos from orr join cr using (user_id, r))"""


@query(f"with {_PAIRS} select user_id, open_id, close_id, open_ts, close_ts from p")
def pair_open_close(spark, d):
    return _pairs(spark, d).select("user_id", F.col("open_event_id").alias("open_id"), F.col("close_event_id").alias("close_id"), "open_ts", "close_ts")


def _intervals(spark, d) -> DataFrame:
    p = _pairs(spark, d)
    return p.select(
        F.concat(F.lit("● title - "), F.col("user_id").cast("string")).alias("title"), F.to_date("open_ts").alias("date"), F.date_format("open_ts", "HH:mm:ss").alias("open"),
        F.date_format("close_ts", "HH:mm:ss").alias("close"), F.col("open_event_id").alias("pos"),
    )


def _totals_sql(minutes: str, where: str = "true") -> str:
    return f"""with {_PAIRS}, i as (select 'title - ' || user_id title, cast(open_ts as date) date, strftime(open_ts, '%H:%M:%S') open, strftime(close_ts, '%H:%M:%S') "close", open_id pos,
(epoch(date_trunc('second', close_ts)::time) - epoch(date_trunc('second', open_ts)::time)) / 60.0 m0 from p), m as (select *, {minutes} m from i)
select arg_max(date, pos) date, arg_max(open, pos) open, arg_max("close", pos) "close", round(sum(m), 6) as "minutes", 'file-directory-App' as type, title from m where {where} group by title"""


def _totals(spark, d, mode):
    return events.totals(_intervals(spark, d), mode).withColumn("minutes", F.round("minutes", 6))


@query(_totals_sql("m0"))
def activity_totals(spark, d):
    return _totals(spark, d, "raw")


@query(_totals_sql("m0", "m > 0"))
def durations_drop(spark, d):
    return _totals(spark, d, "drop")


@query(_totals_sql("case when m0 < 0 then m0 + 1440 else m0 end"))
def durations_wrap(spark, d):
    return _totals(spark, d, "wrap")


@query("""with s as (select *, sum(case when event_type in ('signup','error') then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) seg from events)
select event_id, user_id, first_value(case when event_type='signup' then event_id end) over (partition by user_id, seg order by ts, event_id) carried from s""")
def carry_forward(spark, d):
    """The last signup before each event of a user; an error resets it."""
    along = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = _t(spark, d, "events").withColumn("seg", F.sum(F.col("event_type").isin("signup", "error").cast("int")).over(along))
    return s.select("event_id", "user_id", F.first(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(Window.partitionBy("user_id", "seg").orderBy("ts", "event_id")).alias("carried"))


def _snapshots(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_type", F.dayofyear("ts").alias("day"))
    return (e.filter("day % 2 = 0").drop("day"), e.filter("day % 2 = 1").drop("day"))


_SNAP = "(select user_id, event_type from events where dayofyear(ts) % 2 = {})"


@query(f"select * from {_SNAP.format(0)} except all select * from {_SNAP.format(1)}")
def snapshot_added(spark, d):
    return events.snapshot_changes(*_snapshots(spark, d))[0]


@query(f"select * from {_SNAP.format(1)} except all select * from {_SNAP.format(0)}")
def snapshot_closed(spark, d):
    return events.snapshot_changes(*_snapshots(spark, d))[1]


@query(f"""select date, open, "close", "minutes", type, title as name from ({_totals_sql('m0')}) union all
select cast(o_orderdate as date), '00:00:00', '00:00:02', 0.033, 'Command', o_orderpriority from orders""")
def union_activity(spark, d):
    c = _t(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.lit("00:00:00").alias("open"), F.lit("00:00:02").alias("close"), F.round(F.lit(2 / 60), 3).alias("minutes"), F.lit("Command").alias("type"), F.col("o_orderpriority").alias("name"))
    return events.unify(_totals(spark, d, "raw"), c)


@query("""select epoch, cast(to_timestamp(epoch) at time zone 'UTC' as date) date, strftime(to_timestamp(epoch) at time zone 'UTC', '%H:%M:%S') open, strftime(to_timestamp(epoch + 2) at time zone 'UTC', '%H:%M:%S') "close", 0.033::double as "minutes", 'Command' as type, event_type as name
from (select cast(floor(epoch(ts)) as bigint) epoch, event_type, ts from events) where cast(ts as date) = (select max(cast(ts as date)) from events)""")
def history_day(spark, d):
    e = _t(spark, d, "events").select(F.unix_timestamp("ts").alias("epoch"), F.col("event_id").alias("pos"), F.col("event_type").alias("command"))
    day = _t(spark, d, "events").agg(F.max(F.to_date("ts")).cast("string").alias("m")).first()["m"]
    return events.command_activity(e, day)


_NAMES = "(select doc_id, 'name' || doc_id || case doc_id % 4 when 0 then '.TXT' when 1 then '.md' when 2 then '.zzz' else '' end file from documents)"


def _files(spark, d):
    i = F.col("doc_id")
    ext = F.when(i % 4 == 0, ".TXT").when(i % 4 == 1, ".md").when(i % 4 == 2, ".zzz").otherwise("")
    return _t(spark, d, "documents").select("doc_id", F.concat(F.lit("name"), i.cast("string"), ext).alias("file"))


@query(f"select doc_id, file, case doc_id % 4 when 0 then 'plain text' when 1 then 'Markdown' when 2 then null else 'file' end ext_def from {_NAMES}")
def ext_lookup(spark, d):
    mime = spark.createDataFrame([("txt", "plain text"), ("md", "Markdown")], "ext string, comment string")
    return tables.extension_lookup(_files(spark, d), mime)


@query("select d.doc_id, coalesce('q' || l.quality, 'unknown') quality from documents d left join labels l using (doc_id)")
def left_default(spark, d):
    l = _t(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("quality"))  # noqa: E741
    return tables.backfill(_t(spark, d, "documents").select("doc_id"), l, "doc_id", "quality", ["quality"])


@query("select d.doc_id, d.lang, l.quality::bigint quality, length(b.text)::bigint bench_chars from documents d left join labels l using (doc_id) left join benchmark b on d.doc_id = b.item_id")
def merge3(spark, d):
    l = _t(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"))  # noqa: E741
    b = _t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").cast("bigint").alias("bench_chars"))
    return tables.merge_three(_t(spark, d, "documents").select("doc_id", "lang"), l, b, "doc_id")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def anti_new(spark, d):
    return tables.anti_new(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels").select("doc_id"), "doc_id")


@query("select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1)")
def semi_known(spark, d):
    return _t(spark, d, "documents").select("doc_id", "source").join(_t(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi")


@query("select user_id, arg_max(event_type, (ts, event_id)) event_type, round(arg_max(value, (ts, event_id)), 6) \"value\", max((ts, event_id))[2] event_id from events group by user_id")
def last_wins(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_type", F.round("value", 6).alias("value"), "ts", "event_id")
    return tables.last_wins(e, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""with n as (select doc_id, row_number() over (order by doc_id) - 1 n, count(*) over () total from documents)
select doc_id, case when n < cast(floor(total * 0.85) as bigint) then 'train' when n < cast(floor(total * 0.95) as bigint) then 'validation' else 'test' end split from n""")
def positional_split(spark, d):
    docs = _t(spark, d, "documents").select("doc_id")
    n = tables.renumber(docs, [F.col("doc_id")])
    return tables.positional_split(n, "n", docs.count(), {"train": 0.85, "validation": 0.1, "test": 0.05}).select("doc_id", "split")


@query("select doc_id, row_number() over (order by doc_id) number from documents")
def renumber(spark, d):
    return tables.renumber(_t(spark, d, "documents").select("doc_id"), [F.col("doc_id")], 1, "number")


_TOKENS = "(select unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) token from documents)"


@query(f"select token, count(*) n from {_TOKENS} group by token")
def token_freq(spark, d):
    return tables.token_frequency(_t(spark, d, "documents"), fx.space_tokens(F.col("text")))


@query(f"select token, count(*) n from {_TOKENS} group by token order by n desc, token limit 50")
def topk_tokens(spark, d):
    return tables.most_common(token_freq(spark, d), 50)


@query("""select conv_id, turn, round(case when len(t) > 0 then len(list_distinct(t)) / len(t)::double else 0 end, 6) diversity, len(t)::bigint n
from (select conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') t from conversations)""")
def lexical_diversity(spark, d):
    t = fx.word_tokens(F.col("text"))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.round(fx.lexical_diversity(t), 6).alias("diversity"), F.size(t).cast("bigint").alias("n"))


@query("select round(min(n), 6)::double lo, round(max(n), 6)::double hi, round(avg(n), 6) mean, round(quantile_cont(n, 0.5), 6) p50, round(quantile_cont(n, 0.75), 6) p75, round(quantile_cont(n, 0.9), 6) p90, round(quantile_cont(n, 0.95), 6) p95, round(quantile_cont(n, 0.99), 6) p99, round(stddev_pop(n), 6) sd from (select length(text)::double n from documents)")
def len_percentiles(spark, d):
    n = F.length("text").cast("double")
    q = {f"p{p}": F.round(F.percentile(n, p / 100), 6).alias(f"p{p}") for p in (50, 75, 90, 95, 99)}
    return _t(spark, d, "documents").agg(F.min(n).alias("lo"), F.max(n).alias("hi"), F.round(F.avg(n), 6).alias("mean"), *q.values(), F.round(F.stddev_pop(n), 6).alias("sd"))


_SHARES = (0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999)


@query(" union all ".join(f"select {s}::double as \"share\", round(quantile_cont(l_extendedprice * (1 - l_discount) * (1 + l_tax), {s}), 6) as \"value\" from lineitem" for s in _SHARES))
def exact_percentiles(spark, d):
    """Percentiles of a value that is different in almost every row."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return percentiles.exact_percentiles(_t(spark, d, "lineitem"), price, list(_SHARES)).withColumn("value", F.round("value", 6))


@query("""with l as (select length(text)::double x from documents where text is not null), m as (select min(x) a, max(x) b from l)
select case when a = b then 1 else least(cast(floor(30 * (x - a) / (b - a)) as bigint) + 1, 30) end bin, count(*) n from l, m group by 1""")
def len_hist(spark, d):
    """30 bins from the shortest to the longest text."""
    return tables.histogram(_t(spark, d, "documents"), F.length("text"), 30)


@query("select count(*) filter (n > m) / count(*)::double as share from (select length(text) n, avg(length(text)) over () m from documents)")
def share_above_mean(spark, d):
    docs = _t(spark, d, "documents").select(F.length("text").alias("n"))
    mean = docs.agg(F.avg("n").alias("m"))
    return docs.join(F.broadcast(mean), F.lit(True)).agg(F.avg((F.col("n") > F.col("m")).cast("double")).alias("share"))


def _groups(spark, d):
    return tasks.structure(_t(spark, d, "conversations"), "conv_id", "turn", "text")


@query("select conv_id, count(*)::bigint n, md5(string_agg(text, ' ' order by turn)) block from conversations group by conv_id")
def structure_tasks(spark, d):
    return _groups(spark, d).select("conv_id", F.size("small_tasks").cast("bigint").alias("n"), F.md5("global_block").alias("block"))


_GROUP = "g as (select conv_id, list(text order by turn) t, string_agg(text, ' ' order by turn) b from conversations group by conv_id)"


@query(f"""with {_GROUP}, p as (select conv_id, text, row_number() over (partition by conv_id order by turn) i from conversations), x as (select conv_id, 'task_block' kind, unnest(t) a, b from g union all
select conv_id, 'task_task', p.text, q.text from p join p q using (conv_id) where p.i < q.i union all
select conv_id, 'part_block', array_to_string(t[1:cast(floor(len(t) * 0.7) as int)], ' '), b from g where len(t) > 1)
select conv_id, kind, md5(a) a, md5(b) b from x""")
def task_pairs(spark, d):
    return tasks.contrastive_pairs(_t(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "kind", F.md5("a").alias("a"), F.md5("b").alias("b"))


@query("select conv_id, turn, md5(text) a, md5(nxt) b from (select *, lead(text) over (partition by conv_id order by turn) nxt from conversations) where nxt is not null")
def consecutive_pairs(spark, d):
    return tasks.consecutive(_t(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.md5("a").alias("a"), F.md5("b").alias("b"))


@query("select a.item_id, b.item_id as next_item_id from benchmark a join benchmark b on (a.item_id + 1) % (select count(*) from benchmark) = b.item_id")
def ring_pairs(spark, d):
    b = _t(spark, d, "benchmark").select("item_id")
    return tasks.ring(b, "item_id", b.count(), ["item_id"])


def _type_sql(main: str, previous: str = "null::varchar", index: str = "1") -> str:
    """The rules of token types as SQL over a column tok; the patterns and words are those of the column expression."""
    like = lambda kind, t="t": f"regexp_matches({t}, '{PATTERNS[kind]}')"
    words = lambda ws: ", ".join(f"'{w}'" for w in ws)
    t, last = "trim(tok, ' ' || chr(9) || chr(10) || chr(13))", f"regexp_extract(trim({previous}), '([^ ]+)$', 1)"
    port = "try_cast(string_split(t, '-')[{}] as int) <= 65535"
    rules = [("t = ''", "arg"), (f"{index} = 0", "cmd"), (f"t = {main}", "cmd"), (f"starts_with(t, {main} || ' ')", "cmdopt"), ("contains(t, ' ') and len(list_filter(string_split(t, ' ')[2:], lambda w: starts_with(w, '-'))) > 0", "cmdopt")]
    quoted = "len(t) > 0 and ((t[1] = chr(39) and t[-1] = chr(39)) or (t[1] = chr(34) and t[-1] = chr(34)))"
    rules += [(f"{quoted} and {like('json', 't[2:-2]')}", "json"), (f"{quoted} and {like('url', 't[2:-2]')}", "url"), (quoted, "string"), (f"{main} = 'python' and {previous} = '-m'", "python_module")]
    rules += [(like(k), k) for k in ("remote_target", "domain", "ip", "ipv6", "url", "cidr")]
    rules += [(f"{like('port_range')} and {port.format(1)} and {port.format(2)}", "port_range"), (f"{like('port')} and (coalesce({previous} in ({words(PORT_AFTER)}), false) or ({main} in ({words(NETWORK_COMMANDS)}) and try_cast(t as int) between 1 and 65535))", "port")]
    rules += [(like("port"), "number"), (like("number"), "number"), (f"{main} = 'tcpdump' and {last} = 'port'", "arg"), *[(f"{main} = 'tcpdump' and {last} = '{o}'", k) for o, k in TCPDUMP_VALUES.items()]]
    rules += [("lower(t) = 'gw'", "gateway"), (f"{main} = 'hydra' and {last} = '-l'", "username"), (f"upper(t) in ({words(HTTP_METHODS)})", "http_method"), (f"{main} = 'python' and trim({previous}) like '%-m'", "python_module"), ("lower(t) in ('nginx', 'apache')", "server")]
    rules += [(f"{like('word')} and not {like('dns_type')}", "arg"), *[(like(k), k) for k in ("folder", "file", "device", "envfile", "script", "archive")], ("starts_with(t, '-')", "option")]
    cases = " ".join(f"when {c} then '{k}'" for c, k in rules)
    return f"(select any_value(case {cases} else 'arg' end) from (select {t} t))"


_TOK = """(select 'd' || doc_id || ':' || (i - 1) id, w[i] tok from (select doc_id, regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+') w from documents), unnest(range(1, len(w) + 1)) t(i) union all select 'u' || page_id, url from pages
union all select 'h' || page_id, split_part(split_part(url, '://', 2), '/', 1) from pages union all select 'p' || page_id, '/' || split_part(split_part(url, '://', 2), '/', 2) from pages union all select 'n' || o_orderkey, cast(o_orderkey as varchar) from orders)"""


@query(f"""with k as (select id, tok from {_TOK}), y as (select tok, {_type_sql("'curl'")} as type from (select distinct tok from k)) select id, k.tok, type from k join y on k.tok is not distinct from y.tok""")
def token_types(spark, d):
    """Tokens are typed where they stand, as there are so many distinct ones that bringing equal ones together moves more than it saves."""
    p = _t(spark, d, "pages")
    rest = F.split_part("url", F.lit("://"), F.lit(2))
    one = lambda df, mark, key, c: df.select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), c.alias("tok"))
    words = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("i", "tok"))
    rows = words.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(":"), F.col("i").cast("string")).alias("id"), "tok").unionByName(one(p, "u", "page_id", F.col("url")))
    rows = rows.unionByName(one(p, "h", "page_id", F.split_part(rest, F.lit("/"), F.lit(1)))).unionByName(one(p, "p", "page_id", F.concat(F.lit("/"), F.split_part(rest, F.lit("/"), F.lit(2)))))
    rows = rows.unionByName(one(_t(spark, d, "orders"), "n", "o_orderkey", F.col("o_orderkey").cast("string")))
    return rows.withColumn("type", word_type(F.col("tok"), F.lit("curl"), F.lit(None).cast("string"), F.lit(1)))


_MAINS = ("tcpdump", "hydra", "python", "curl", "ls", "host", "ssh", "git")
_BEFORE = (None, "-i", "tcpdump -i", "tcpdump -w", "port", "tcpdump port", "-l", "hydra -l", "-m", "python -m", "-p", "--port", "http.server", "redis-cli -p")
_SHAPES = (
    "eth{n}", "{n}", "bob{n}", "json.tool", "cap{n}.pcap", "A", "nginx", "GW", "u{n}@host:/tmp/{n}", "10.0.{m}.{m}", "10.0.0.0/{m}", "{n}-{n}", "-{m}.5", "/etc/d{n}/", "./run{n}.sh", "a{n}.tar.gz", "-x", "'text {n}'", "\"http://a{n}.b\"", "'{{\"a\":{n}}}'",
    "get", "web{n}.example.org", "https://x.y/{n}", "::{m}", "a -{n}", "ls -l", "", "curl run", "/dev/tty{n}", ".env{n}.conf", "99999", "mx",
)


def _context(spark, d):
    """A token an order, with a command and what stands before it, so that all rules are met."""
    n = F.col("o_orderkey")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))
    shape = F.replace(F.replace(pick(_SHAPES, n), F.lit("{n}"), n.cast("string")), F.lit("{m}"), (n % 40).cast("string"))
    return _t(spark, d, "orders").select("o_orderkey", shape.alias("tok"), pick(_MAINS, F.floor(n / 3)).alias("main"), pick(_BEFORE, F.floor(n / 7)).alias("previous"), (n % 5).alias("i"))


def _list(values) -> str:
    quote = "'"
    return "[" + ", ".join("null" if v is None else quote + v.replace(quote, 2 * quote) + quote for v in values) + "]"


@query(f"""with c as (select o_orderkey, replace(replace(({_list(_SHAPES)})[o_orderkey % {len(_SHAPES)} + 1], '{{n}}', o_orderkey::varchar), '{{m}}', (o_orderkey % 40)::varchar) tok, ({_list(_MAINS)})[(o_orderkey // 3) % {len(_MAINS)} + 1] main,
({_list(_BEFORE)})[(o_orderkey // 7) % {len(_BEFORE)} + 1] previous, o_orderkey % 5 i from orders) select o_orderkey, tok, main, previous, i, {_type_sql("main", "previous", "i")} as type from c""")
def token_types_in_context(spark, d):
    c = _context(spark, d)
    return c.withColumn("type", token_type(F.col("tok"), F.col("main"), F.col("previous"), F.col("i")))


_U = "u as (select vec_id, label, embedding::double[] v from embeddings)"
_PAIR = f"{_U}, p as (select a.label, a.vec_id i, b.vec_id j, greatest(1 - list_cosine_similarity(a.v, b.v), 0) dist from u a join u b on a.label = b.label and a.vec_id < b.vec_id)"


def _emb(spark, d):
    return _t(spark, d, "embeddings")


@query(f"with {_PAIR} select label, i, j, round(dist, 6) dist from p")
def cos_pairs(spark, d):
    # six digits by arithmetic: round() goes by way of a decimal for each of the many pairs
    return similarity.group_pairs(_emb(spark, d), "label", "vec_id").withColumn("dist", F.floor(F.col("dist") * 1e6 + 0.5) / 1e6)


_BLOCKS = "k as (select label g, list(m order by dim) v from (select label, dim, avg(x) m from (select label, unnest(range(0, 64)) dim, unnest(embedding)::double x from embeddings) group by all) group by label)"


@query(f"with {_BLOCKS} select a.g a, b.g b, round(list_cosine_similarity(a.v, b.v), 6) sim from k a join k b on a.g < b.g where list_cosine_similarity(a.v, b.v) > 0.1")
def dangerous_pairs(spark, d):
    """Pairs of groups whose blocks are closer than a limit; the limit here is one that some of these blocks pass."""
    return similarity.close_blocks(_emb(spark, d), "label", least=0.1).withColumn("sim", F.round("sim", 6))


@query(f"with {_PAIR}, c as (select label, avg(dist) c from p group by label) select round(avg(c), 6) mean_cohesion from c")
def mean_cohesion(spark, d):
    return similarity.mean_cohesion(similarity.cohesion(_emb(spark, d), "label")).select(F.round("mean_cohesion", 6).alias("mean_cohesion"))


@query(f"""with {_U}, s as (select a.vec_id q, b.vec_id vec_id, list_cosine_similarity(a.v, b.v) sim from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
r as (select *, row_number() over (partition by q order by round(sim, 9) desc, vec_id) rank from s) select q, vec_id, rank, round(sim, 6) sim from r where rank <= 10""")
def nearest10(spark, d):
    """The ten nearest vectors of every query against all rows; queries are the vectors whose id is divisible by 100."""
    e = _emb(spark, d)
    return similarity.nearest(e.filter("vec_id % 100 = 0"), e, "vec_id", 10).withColumn("sim", F.round("sim", 6))


@query("select label, dim::bigint dim, round(avg(x), 6) mean from (select label, unnest(range(0, 64)) dim, unnest(embedding)::double x from embeddings) group by all")
def mean_vector(spark, d):
    return similarity.mean_vectors(_emb(spark, d), "label").select("label", F.col("dim").cast("bigint").alias("dim"), F.round("mean", 6).alias("mean"))


_CENT = "c as (select label target, list(m order by dim) v from (select label, dim, avg(x) m from (select label, unnest(range(0, 64)) dim, unnest(embedding)::double x from embeddings) group by all) group by label)"


@query(f"with {_U}, {_CENT}, r as (select vec_id, label, target, row_number() over (partition by vec_id order by list_cosine_similarity(u.v, c.v) desc, target) rnk from u, c) select round(avg((rnk <= 3)::int), 6) accuracy from r where target = label")
def retrieval_at_k(spark, d):
    e = _emb(spark, d)
    return similarity.retrieval_accuracy(e, similarity.centroids(e, "label"), "vec_id", "label", 3).select(F.round("accuracy", 6).alias("accuracy"))


@query(f"with {_PAIR} select label, round(avg(1 - dist), 6) mean_sim, round(min(1 - dist), 6) min_sim, round(max(1 - dist), 6) max_sim, round(stddev_pop(1 - dist), 6) std_sim from p group by label")
def intra_similarity(spark, d):
    g = similarity.group_similarity(_emb(spark, d), "label", "vec_id")
    return g.select("label", *[F.round(c, 6).alias(c) for c in ("mean_sim", "min_sim", "max_sim", "std_sim")])


@query(f"with {_U} select a.label a, b.label b, round(avg(list_cosine_similarity(a.v, b.v)), 6) mean_sim from u a join u b on a.label < b.label group by all")
def inter_overlap(spark, d):
    return similarity.group_overlap(_emb(spark, d), "label").withColumn("mean_sim", F.round("mean_sim", 6))


@query(f"with {_U} select a.label a, b.label b, round(avg(list_cosine_similarity(a.v, b.v)), 6) mean_sim, round(max(list_cosine_similarity(a.v, b.v)), 6) max_sim from u a join u b on a.label < b.label group by all")
def block_overlap(spark, d):
    """Mean and largest cosine between the items of two groups."""
    found = similarity.group_overlap(_emb(spark, d), "label", largest=True)
    return found.select("a", "b", F.round("mean_sim", 6).alias("mean_sim"), F.round("max_sim", 6).alias("max_sim"))


@query(f"with {_U} select a.vec_id a, b.vec_id b, round(list_cosine_similarity(a.v, b.v), 6) sim from u a join u b on a.vec_id < b.vec_id where list_cosine_similarity(a.v, b.v) > 0.75")
def close_vectors(spark, d):
    """All pairs of vectors, each a group of its own, above the usual limit."""
    return similarity.close_blocks(_emb(spark, d), "vec_id", least=0.75).withColumn("sim", F.round("sim", 6))


@query(f"with {_PAIR}, n as (select label, count(*) n from u group by label) select n.label, n.n, round(coalesce(avg(dist), 0), 6) cohesion, round(coalesce(2 * sum(dist) / (any_value(n.n) * any_value(n.n)), 0), 6) cohesion_diag from n left join p using (label) group by n.label, n.n")
def cohesion(spark, d):
    e = _emb(spark, d)
    c = similarity.cohesion(e, "label")
    return c.select("label", "n", F.round("cohesion", 6).alias("cohesion"), F.round("cohesion_diag", 6).alias("cohesion_diag"))


@query(f"""with {_U}, d as (select a.vec_id, a.label, b.label k, sum(1 - list_cosine_similarity(a.v, b.v)) s, count(*) n from u a, u b where a.vec_id <> b.vec_id group by all),
m as (select vec_id, label, max(case when k = label then s / n end) a, min(case when k <> label then s / n end) b from d group by all)
select vec_id, round(case when a is null or b is null then 0 else (b - a) / greatest(a, b) end, 6) silhouette from m""")
def silhouette_by_label(spark, d):
    return similarity.silhouette(_emb(spark, d), "label", "vec_id").select("vec_id", F.round("silhouette", 6).alias("silhouette"))


@query()
def cluster_stage1(spark, d):
    return clustering.cluster_groups(_emb(spark, d), "label", "vec_id", stage="first")


@query()
def linkage_rounds(spark, d):
    """All vectors as one group, which needs no task of its own."""
    m = linkage.linkage(_emb(spark, d), "vec_id")
    return m.select(F.round("height", 6).alias("height"), "a", "b")


@query()
def cluster_full(spark, d):
    return clustering.cluster_groups(_emb(spark, d), "label", "vec_id")


def _answers(spark, d):
    c = _t(spark, d, "conversations")
    nxt = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.withColumn("ref", F.lead("text").over(nxt)).filter("ref is not null")
    return rows.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("pred"), "ref")


def _rouge_sql(n: int) -> str:
    grams = lambda t: t if n == 1 else f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"
    return f"""with a as (select conv_id || ':' || turn id, text pred, lead(text) over (partition by conv_id order by turn) ref from conversations),
t as (select id, regexp_extract_all(lower(pred), '[a-z0-9]+') p, regexp_extract_all(lower(ref), '[a-z0-9]+') r from a where ref is not null),
x as (select id, unnest({grams('p')}) g, 1 p, 0 r from t union all select id, unnest({grams('r')}), 0, 1 from t), s as (select id, g, sum(p) p, sum(r) r from x group by all),
f as (select id, sum(least(p, r)) h, sum(p) p, sum(r) r from s group by id) select t.id, round(coalesce(case when h > 0 then 2.0 * h / (f.p + f.r) else 0 end, 0), 6) rouge from t left join f using (id)"""


@query(_rouge_sql(1))
def rouge1(spark, d):
    return rouge.rouge_n(_answers(spark, d), "id", "pred", "ref", 1).withColumn("rouge", F.round("rouge", 6))


@query(_rouge_sql(2))
def rouge2(spark, d):
    return rouge.rouge_n(_answers(spark, d), "id", "pred", "ref", 2).withColumn("rouge", F.round("rouge", 6))


@query("""with recursive a as (select conv_id || ':' || turn id, text pred, lead(text) over (partition by conv_id order by turn) ref from conversations),
t as (select id, regexp_extract_all(lower(pred), '[a-z0-9]+') p, regexp_extract_all(lower(ref), '[a-z0-9]+') r from a where ref is not null),
m as (select p.id, p.i, r.j from (select id, i, p[i] w from t, unnest(range(1, len(p) + 1)) x(i)) p join (select id, j, r[j] w from t, unnest(range(1, len(r) + 1)) x(j)) r on p.id = r.id and p.w = r.w),
f as (select id, i, min(j) j, 1 k from m group by id, i union all select id, i, min(j) j, k from (select m.id, m.i, m.j, f.k + 1 k from f join m on f.id = m.id and m.i > f.i and m.j > f.j) group by id, i, k),
s as (select id, max(k) k from f group by id) select t.id, round(coalesce(2.0 * k / (len(p) + len(r)), 0), 6) rouge from t left join s using (id)""")
def rouge_l(spark, d):
    return rouge.rouge_l(_answers(spark, d), "id", "pred", "ref").withColumn("rouge", F.round("rouge", 6))


@query()
def rouge_lsum(spark, d):
    return rouge.rouge_lsum(_answers(spark, d), "id", "pred", "ref").withColumn("rouge", F.round("rouge", 6))


@query()
def rouge1_stemmed(spark, d):
    return rouge.rouge_n(_answers(spark, d), "id", "pred", "ref", 1, stemmed=True).withColumn("rouge", F.round("rouge", 6))


@query()
def rouge_means(spark, d):
    """The four scores, stemmed, on average."""
    a = _answers(spark, d)
    arg = (a, "id", "pred", "ref")
    found = {"rouge1": rouge.rouge_n(*arg, 1, stemmed=True), "rouge2": rouge.rouge_n(*arg, 2, stemmed=True), "rougeL": rouge.rouge_l(*arg, stemmed=True), "rougeLsum": rouge.rouge_lsum(*arg)}
    return rouge.rouge_means(found).withColumn("mean", F.round("mean", 6))


@query()
def cluster_metrics(spark, d):
    """Of each label's clusters: their number, those of two or more, the mean cohesion of these, and the mean silhouette."""
    e = _emb(spark, d)
    found = clustering.cluster_groups(e, "label", "vec_id").select(F.col("id").alias("vec_id"), F.concat_ws(":", "label", "cluster").alias("c"))
    v = e.join(found, "vec_id").select("vec_id", "c", "embedding")
    sizes = similarity.cohesion(v, "c").withColumn("label", F.split_part("c", F.lit(":"), F.lit(1)).cast("int"))
    per = sizes.groupBy("label").agg(F.count("*").alias("clusters"), F.count_if(F.col("n") >= 2).alias("clusters2"), F.round(F.avg(F.when(F.col("n") >= 2, F.col("cohesion"))), 6).alias("mean_cohesion"))
    # A silhouette compares clusters of the same label only, so every label is taken as a table of its own.
    s = similarity.silhouette(v, "c", "vec_id", within=F.split_part("c", F.lit(":"), F.lit(1)))
    sil = s.groupBy(F.split_part("c", F.lit(":"), F.lit(1)).cast("int").alias("label")).agg(F.round(F.avg("silhouette"), 6).alias("silhouette"))
    return per.join(sil, "label")


@query()
def described_activity(spark, d):
    return models.describe_activity(union_activity(spark, d)).select("type", "name", "description").distinct()


_KIND = "case doc_id % 4 when 0 then 'file-directory-App' when 1 then 'Command' when 2 then 'Commande' else 'directory/App' end"
_NAME = "case doc_id % 3 when 0 then lang || ' - ' || source || ' - app' when 1 then source else lang || ' ' || source end"


@query(f"""select doc_id, case when kind = 'file-directory-App' then case when len(string_split(name, ' - ')) = 3 then 'Describe the file ''' || string_split(name, ' - ')[1] || ''' in folder ''' || string_split(name, ' - ')[2] || ''', opened with ' || string_split(name, ' - ')[3] || '.'
when regexp_matches(name, '^[\\p{{L}}\\p{{N}}_]+$') then 'The user worked inside the folder named ' || name || '.' else 'Briefly describe the file or folder ''' || name || '''.' end
when lower(kind) in ('commande', 'command') then 'Describe the shell command: ' || name else 'Briefly describe: ' || name end prompt from (select doc_id, {_KIND} kind, {_NAME} name from documents)""")
def prompt_case(spark, d):
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, "file-directory-App").when(i % 4 == 1, "Command").when(i % 4 == 2, "Commande").otherwise("directory/App")
    name = F.when(i % 3 == 0, F.concat("lang", F.lit(" - "), "source", F.lit(" - app"))).when(i % 3 == 1, F.col("source")).otherwise(F.concat_ws(" ", "lang", "source"))
    return _t(spark, d, "documents").select("doc_id", kind.alias("kind"), name.alias("name")).select("doc_id", fx.prompt(F.col("name"), F.col("kind")).alias("prompt"))


@query("select doc_id, doc_id::varchar id, 'name' || doc_id filename, case when doc_id % 2 = 0 then 'txt' else '' end extension, lang directory, source application from documents")
def file_records(spark, d):
    i = F.col("doc_id").cast("string")
    title = F.concat(F.lit("name"), i, F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(""), F.lit(" - "), "lang", F.lit(" - "), "source")
    rows = tables.file_records(_t(spark, d, "documents").select("doc_id", title.alias("t")), "t", F.col("doc_id"))
    return rows.withColumn("doc_id", F.col("id").cast("bigint"))


@query("select arg_max(event_id, (ts, event_id)) last_number from events")
def resume_point(spark, d):
    e = _t(spark, d, "events").select("event_id", F.struct("ts", "event_id").alias("pos"))
    return tables.resume_point(e, "event_id", "pos")


@query("select doc_id, min(kw) as kw from (select doc_id, kw from (select doc_id, lower(text) t from documents) join (select unnest(['license', 'token', 'trash']) kw) on contains(t, kw)) group by doc_id")
def first_containing(spark, d):
    known = spark.createDataFrame([(0, "license"), (1, "token"), (2, "trash")], "ord int, kw string")
    return tables.first_containing(_t(spark, d, "documents").select("doc_id", "text"), known, "text", "kw", "ord").filter("kw is not null").select("doc_id", "kw")


@query("select doc_id, md5(trim(replace(lower(text), '\"', ''))) task, case when contains(text, ' - ') then 'file-directory-App' else 'directory/App' end as type from documents")
def normalised_tasks(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(fx.normalize_task(F.col("text"))).alias("task"), fx.entry_type(F.col("text")).alias("type"))


@query("select user_id, event_type, count(*) n, round(sum(value), 4) total from events group by user_id, event_type having count(*) >= 2")
def cluster_sizes(spark, d):
    return _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).filter("n >= 2")


@query()
def type_labels(spark, d):
    return token_types(spark, d).select("type", type_label(F.col("type")).alias("label")).distinct()


from tallyloom.plans import activity_queries, format_queries, text_queries  # noqa: E402, F401  they register their queries
