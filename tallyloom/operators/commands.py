"""Shell commands: parts, tokens, elements, and descriptions by a dictionary of patterns.

The command elements that are asked for, each distinct sequence once, meet the patterns of their command, which are walked as a
trie (`pattern_trie.py`), so no pattern is expanded into all its texts. Describing is two equi joins with what was found.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import collapse_spaces
from tallyloom.functions.token_types import looks, token_type, type_label
from tallyloom.operators.pattern_trie import Trie, rows_of
from tallyloom.operators.tables import find_patterns
from tallyloom.sources.sinks import written

#: Commands whose joined flags are one option.
WHOLE_FLAGS = ("nmap", "openssl", "ntlmrelayx")
#: Words of descriptions.
RUN_SCRIPT, COMMAND, NO_DESCRIPTION, WITH_SUDO = "Run the script '", "Command '", "No description", "with sudo "

#: A word: a quote that begins one runs to its partner and stays, one inside a word is a letter.
WORD = r"""(?U)"[^"]*"|'[^']*'|[^\s"'][^\s]*"""
_TOKEN = re.compile(WORD.removeprefix("(?U)"))
#: Quoted text, plain text, and what parts commands.
_PIECE = r"""("[^"]*(?:"|$)|'[^']*(?:'|$)|[^"'&|;]+|&&|\|\||[|;&])"""


def words(text: Column) -> Column:
    """Words parted by white space, quoted ones whole; with a quote left open, all that white space parts."""
    found = F.regexp_extract_all(text, F.lit(f"({WORD.replace('(?U)', '(?U)', 1)})"), F.lit(1))
    left_open = F.regexp_like(F.regexp_replace(text, WORD, ""), F.lit(r"(?U)\S"))
    return F.when(left_open, F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).otherwise(found)


def split_words(text: str) -> list[str]:
    """The same of one text."""
    return text.split() if _TOKEN.sub("", text).strip() else _TOKEN.findall(text)


def split_outside_quotes(text: str, marks: tuple[str, ...]) -> list[str]:
    out, quote, piece, at = [], "", "", 0
    while at < len(text):
        mark = next((m for m in marks if text.startswith(m, at)), "") if not quote else ""
        if mark:
            out.append(piece)
            piece, at = "", at + len(mark)
            continue
        ch = text[at]
        quote = "" if ch == quote else ch if not quote and ch in "\"'" else quote
        piece, at = piece + ch, at + 1
    return [p.strip() for p in [*out, piece]]


def parts(text: Column) -> Column:
    """The commands of a line, parted by && || | ; outside quotes."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(1))
    marked = F.array_join(F.transform(pieces, lambda p: F.when(p.isin("&&", "||", "|", ";"), "\x00").otherwise(p)), "")
    return F.filter(F.transform(F.split(marked, "\x00"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def split_flags(words: Column) -> Column:
    """-xvz becomes -x -v -z, unless the command's flags are whole."""
    one = lambda w: F.when(w.startswith("-") & ~w.startswith("--") & (F.length(w) > 2), F.transform(F.array_remove(F.split(F.substr(w, F.lit(2)), ""), ""), lambda c: F.concat(F.lit("-"), c))).otherwise(F.array(w))
    return F.when(F.lower(words[0]).isin(*WHOLE_FLAGS), words).otherwise(F.flatten(F.transform(words, one)))


def elements(words: Column) -> Column:
    """The command, then each word with the command it belongs to: an alphabetic second word is a subcommand, options
    carry command and subcommand, the rest stands alone."""
    quoted = lambda w: (w.startswith("'") & w.endswith("'")) | (w.startswith('"') & w.endswith('"'))
    second = F.get(words, F.lit(1))
    sub = F.when(F.regexp_like(second, F.lit("^[a-zA-Z]+$")), second)
    prefix = F.concat_ws(" ", words[0], sub)
    rest = F.transform(
        F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
        lambda w, i: F.when(quoted(w), w).when(w.startswith("-"), F.concat_ws(" ", prefix, w)).when((i == 0) & sub.isNotNull(), prefix).otherwise(w),
    )
    return F.when(F.size(words) > 0, F.concat(F.slice(words, 1, 1), rest)).otherwise(words)


def match_form(element: Column) -> Column:
    """Spaces collapsed, and what follows the first = of no interest."""
    return F.regexp_replace(collapse_spaces(element), r"^(.*?)=\S+", r"$1={{}}")


def command_key(elems: Column, main: Column, form=collapse_spaces) -> Column:
    """The command elements in order, each in the given form."""
    typed = F.transform(elems, lambda e, i: F.struct(token_type(e, main, F.lit(None).cast("string"), i).alias("t"), form(e).alias("e")))
    return F.transform(F.filter(typed, lambda x: x["t"].isin("cmd", "cmdopt")), lambda x: x["e"])


def _element(head: list[str], place: int, word: str, main: str) -> str | None:
    """The command element of a pattern's word, as elements() and command_key() make it; head: the first two words."""
    sub = head[1] if len(head) > 1 and re.fullmatch("[a-zA-Z]+", head[1]) else None
    prefix = f"{head[0]} {sub}" if sub else head[0]
    if place == 0:
        return word
    quoted = (word.startswith("'") and word.endswith("'")) or (word.startswith('"') and word.endswith('"'))
    e = word if quoted else f"{prefix} {word}" if word.startswith("-") else prefix if place == 1 and sub else word
    t = e.strip()
    if t and (t == main or t.startswith(main + " ") or " " in t and any(w.startswith("-") for w in t.split()[1:])):
        return " ".join(t.split())
    return None


def _loose(element: str) -> str:
    return re.sub(r"^(.*?)=\S+", r"\1={}", " ".join(element.split()))


def _tries(patterns: Iterable) -> dict[str, Trie]:
    exact, loose = Trie(), Trie()
    for r in patterns:
        order = (r.file, r.entry_ord, r.pattern_ord)
        for row in rows_of(r.pattern, split_outside_quotes, split_words, lambda head, i, w: _element(head, i, w, r.cmd_name)):
            exact.add(order, row)
            loose.add(order, [tuple(tuple(map(_loose, c)) for c in slot) for slot in row])
    return {"exact": exact, "loose": loose}


def tries(patterns: pd.DataFrame) -> dict[str, Trie]:
    """The patterns of one command (pattern and order) as two tries, of exact elements and of those without values."""
    return _tries(patterns.itertuples())


#: Distinct keys of one command that a task looks up.
KEYS_AT_ONCE = 50_000
#: Rows of all commands that make a bucket, on average.
BUCKET_ROWS = 10_000


def _buckets(df: DataFrame, rows: int) -> int:
    """How many buckets commands are dealt to, so that a bucket has many small commands, and all cores have buckets."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / BUCKET_ROWS))


def _in_buckets(df: DataFrame, buckets: int):
    """df grouped by _bucket. The number of partitions is set, as buckets are small in bytes but not in work, and would be put into one task."""
    return df.repartition(buckets, "_bucket").groupBy("_bucket")


def match_keys(dictionary: DataFrame, keys: DataFrame, at_once: int = KEYS_AT_ONCE) -> DataFrame:
    """cmd_name, form, key and description: for each distinct key (cmd_name, form, key; form is exact or loose) the first pattern of its
    command, by file, entry and place, with the same command elements. Keys that none matches are left out, so are patterns
    without command elements. A command with many keys is dealt to several tasks, each with its patterns; commands with few share one."""
    keys = written(keys.filter("cmd_name is not null and size(key) > 0").distinct(), "keys")
    salts = keys.groupBy("cmd_name").agg(F.count(F.lit(1)).alias("n")).select("cmd_name", F.ceil(F.col("n") / at_once).alias("_salts"))
    # names of their own, as both sides may come from one frame
    rows = dictionary.select(F.col("cmd_name").alias("_name"), "pattern", "file", "entry_ord", "pattern_ord").join(salts.select(F.col("cmd_name").alias("_name"), F.col("_salts").alias("_of")), "_name")
    buckets = _buckets(keys, keys.count() + (rows.agg(F.sum("_of")).first()[0] or 0))
    bucket = lambda name, salt: F.pmod(F.xxhash64(name, salt), F.lit(buckets))
    held = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_of") - 1), lambda salt: bucket(F.col("_name"), salt)))
    rows = rows.select(F.col("_name").alias("_c"), F.explode(held).alias("_bucket"), *[F.col(c).alias(f"_{c}") for c in ("pattern", "file", "entry_ord", "pattern_ord")])
    dealt = keys.join(salts, "cmd_name").withColumn("_bucket", bucket(F.col("cmd_name"), F.pmod(F.xxhash64("key"), F.col("_salts"))))

    def look(key: tuple, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        patterns, places = defaultdict(list), defaultdict(list)
        for r in known.rename(columns={"_c": "cmd_name"} | {f"_{c}": c for c in ("pattern", "file", "entry_ord", "pattern_ord")}).itertuples():
            patterns[r.cmd_name].append(r)
        for i, name in enumerate(asked["cmd_name"]):
            places[name].append(i)
        forms, texts, hit, found = list(asked["form"]), list(asked["key"]), [], []
        for name, at in places.items():
            if name not in patterns:
                continue
            both = _tries(patterns.pop(name))
            for i in at:
                if (x := both[forms[i]].find(tuple(texts[i]))) is not None:
                    hit.append(i)
                    found.append(x)
        out = asked.iloc[hit][["cmd_name", "form", "key"]].reset_index(drop=True)
        return pd.concat([out, pd.DataFrame(found, columns=["file", "entry_ord", "pattern_ord"])], axis=1)

    kinds = rows.schema
    met = _in_buckets(dealt, buckets).cogroup(_in_buckets(rows, buckets)).applyInPandas(
        look, f"cmd_name string, form string, key array<string>, file {kinds['_file'].dataType.simpleString()}, entry_ord {kinds['_entry_ord'].dataType.simpleString()}, pattern_ord {kinds['_pattern_ord'].dataType.simpleString()}"
    )
    place = ["cmd_name", "file", "entry_ord", "pattern_ord"]
    texts = dictionary.groupBy(*[F.col(c).alias(f"_{c}") for c in place]).agg(F.min("description").alias("description"))
    same = [F.col(c) == F.col(f"_{c}") for c in place]
    return met.join(texts, same).select("cmd_name", "form", "key", "description")


def command_parts(df: DataFrame, col: str = "command") -> DataFrame:
    """Rows of df by part: part (from 0), sudo, text with flags repaired, elems."""
    text = F.trim(col)
    sudo = text.startswith("sudo ")
    rows = df.withColumn("sudo", sudo).select("*", F.posexplode(parts(F.when(sudo, F.trim(F.substr(text, F.lit(6)))).otherwise(text))).alias("part", "_text"))
    rows = rows.withColumn("_words", words(F.col("_text"))).withColumn("text", F.array_join(split_flags(F.col("_words")), " "))
    return rows.withColumn("_words", words(F.col("text"))).withColumn("elems", elements(F.col("_words"))).drop("_text", "_words")


def describe_commands(df: DataFrame, dictionary: DataFrame, id_col: str = "id", col: str = "command") -> DataFrame:
    """id, part and descriptions (lines `desc_...: text`) of every part of every command.

    If a pattern has the same command elements in order, its description stands for all of them, with a line for every
    other element. Otherwise each element is looked up on its own, and labelled by its type where nothing is found."""
    rows = command_parts(df.select(F.col(id_col).alias("id"), F.col(col).alias("command"))).withColumn("main", F.get("elems", F.lit(0))).filter(F.col("main").isNotNull())
    rows = rows.withColumn("key", command_key(F.col("elems"), F.col("main"), match_form))
    el = rows.select("id", "part", "sudo", "main", "key", "elems", F.posexplode("elems").alias("i", "el"))
    previous = F.when(F.col("i") > 0, F.get("elems", F.col("i") - 1))
    el = el.withColumn("type", token_type(F.col("el"), F.col("main"), previous, F.col("i"))).withColumn("plain", token_type(F.col("el"), F.col("main"), F.lit(None).cast("string"), F.col("i")))
    el = el.withColumn("_words", words(F.col("el"))).withColumn("sub", elements(F.col("_words"))).drop("_words").withColumn("sub_exact", command_key(F.col("sub"), F.col("main"))).withColumn("sub_loose", command_key(F.col("sub"), F.col("main"), match_form))
    el = written(el.withColumn("single", F.size("sub_exact") == 1), "elements")
    asked = lambda df, form, key: df.select(F.col("main").alias("cmd_name"), F.lit(form).alias("form"), F.col(key).alias("key"))
    found = match_keys(dictionary, asked(el.filter("i = 0"), "loose", "key").unionByName(asked(el.filter("single"), "loose", "sub_loose")).unionByName(asked(el.filter("not single"), "exact", "sub_exact")))
    found = written(found, "descriptions")
    of = lambda form, key, name: found.filter(F.col("form") == form).select(F.col("cmd_name").alias("main"), F.col("key").alias(key), F.col("description").alias(name), F.lit(True).alias(f"_{name}"))
    el = el.join(of("loose", "key", "full_text").withColumnRenamed("_full_text", "hit"), ["main", "key"], "left")
    el = el.join(of("loose", "sub_loose", "d1"), ["main", "sub_loose"], "left").join(of("exact", "sub_exact", "d2"), ["main", "sub_exact"], "left")
    label = F.concat(type_label(F.col("type")), F.lit(" '"), F.col("el"), F.lit("'"))
    command = F.col("plain").isin("cmd", "cmdopt")
    line = F.when(F.col("hit"), F.when(command, F.concat(F.lit("desc_cmd: "), F.coalesce("full_text", F.lit(NO_DESCRIPTION)))).otherwise(F.concat(F.lit("desc_arg_"), F.col("i"), F.lit(": "), label)))
    alone = (
        F.when(looks(F.col("el"), "script"), F.concat(F.lit(RUN_SCRIPT), F.col("el"), F.lit("'"))).when(F.col("i") == 0, F.concat(F.lit(COMMAND), F.col("el"), F.lit("'")))
        .otherwise(F.coalesce(F.when(F.col("single"), F.col("d1")).otherwise(F.col("d2")), label))
    )
    line = F.coalesce(line, F.concat(F.lit("desc_"), F.col("i"), F.lit(": "), alone))
    # All command elements of a full match share one line, at the first one's place.
    first = F.row_number().over(Window.partitionBy("id", "part", F.when(F.col("hit") & command, F.lit(-1)).otherwise(F.col("i"))).orderBy("i")) == 1
    lines = el.withColumn("line", line).withColumn("first", first).filter("first")
    out = lines.groupBy("id", "part", "sudo").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("ls"))
    texts = F.transform("ls", lambda x, k: F.when(F.col("sudo") & (k == 0), F.concat(F.lit(WITH_SUDO), x["line"])).otherwise(x["line"]))
    return out.select("id", "part", texts.alias("descriptions"))


def availability(commands: DataFrame, dictionary: DataFrame) -> DataFrame:
    """command and OK or MISSING."""
    known = dictionary.select(F.col("cmd_name").alias("command")).distinct().withColumn("_there", F.lit(True))
    return commands.join(known, "command", "left").select("command", F.when(F.col("_there"), "OK").otherwise("MISSING").alias("status"))


def new_subcommands(dictionary: DataFrame, found: DataFrame) -> DataFrame:
    """Subcommands (cmd_name, subcommand, description) that no pattern of their command has, as dictionary rows."""
    pattern = F.concat_ws(" ", "cmd_name", "subcommand")
    return found.dropDuplicates(["cmd_name", "subcommand"]).withColumn("pattern", pattern).join(dictionary.select("cmd_name", "pattern"), ["cmd_name", "pattern"], "left_anti").select("cmd_name", "pattern", "description")


def _nearest(options: list[tuple[str, str | None]], entries: list[tuple[str | None, int]]) -> list[tuple[str, int]]:
    """odesc and entry_ord of one command: its options as odesc and text, its entries as text and entry_ord."""
    best: dict[str, int] = {}
    texts = [t if t else None for _, t in options]
    own = {t: int(n) for t, n in sorted(entries, key=lambda x: -x[1]) if t}
    for t, hit in zip(texts, find_patterns(texts, own), strict=True):
        if hit is not None:
            best[t] = hit
    # the other way every option that an entry holds counts
    names = list(dict.fromkeys(t for t in texts if t))
    held = find_patterns([t for t in own], {t: k for k, t in enumerate(names)}, every=True)
    for n, hits in zip(own.values(), held, strict=True):
        for k in hits:
            best[names[k]] = min(best.get(names[k], n), n)
    return [(d, best[t]) for d, t in dict(zip((d for d, _ in options), texts, strict=True)).items() if t in best]


def _near(options: DataFrame, entries: DataFrame, rows: int) -> DataFrame:
    """cmd_name, odesc and entry_ord: the first entry of its command whose text holds an option's text, or is held by it. One pass
    over the texts of a command each way; no pair is tried. rows: how many rows both have at most."""
    kind = entries.schema["entry_ord"].dataType.simpleString()

    def look(key: tuple, o: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        asked, known = defaultdict(list), defaultdict(list)
        for name, d, t in zip(o["cmd_name"], o["odesc"], o["text"], strict=True):
            asked[name].append((d, t))
        for name, t, n in zip(e["_name"], e["_text"], e["_ord"], strict=True):
            known[name].append((t, n))
        return pd.DataFrame([(name, d, n) for name in asked for d, n in _nearest(asked[name], known[name])], columns=["cmd_name", "odesc", "entry_ord"])

    buckets = _buckets(options, rows)
    dealt = lambda df, name: _in_buckets(df.withColumn("_bucket", F.pmod(F.xxhash64(name), F.lit(buckets))), buckets)
    # names of their own, as both sides may come from one frame
    entries = entries.select(F.col("cmd_name").alias("_name"), F.col("text").alias("_text"), F.col("entry_ord").alias("_ord"))
    return dealt(options.distinct(), "cmd_name").cogroup(dealt(entries, "_name")).applyInPandas(look, f"cmd_name string, odesc string, entry_ord {kind}")


def merge_options(dictionary: DataFrame, options: DataFrame) -> DataFrame:
    """Entries (cmd_name, entry_ord, description, cmds) with options (cmd_name, description, variants) merged in: an option
    whose description holds, or is held by, an entry's extends the first such entry's cmds, sorted; one that is all
    known is left; others become new entries after the last. The comparison is within a command."""
    entries = dictionary.groupBy("cmd_name", "entry_ord").agg(F.min("description").alias("description"), F.array_sort(F.collect_set("pattern")).alias("cmds"))
    o = options.select("cmd_name", F.col("description").alias("odesc"), "variants")
    low = lambda c: F.lower(F.trim(c))
    pairs = o.join(_near(o.select("cmd_name", "odesc", low(F.col("odesc")).alias("text")), entries.select("cmd_name", "entry_ord", low(F.col("description")).alias("text")), dictionary.count() + options.count()), ["cmd_name", "odesc"])
    grown = pairs.groupBy("cmd_name", "entry_ord").agg(F.array_distinct(F.flatten(F.collect_list("variants"))).alias("more"))
    kept = entries.join(grown, ["cmd_name", "entry_ord"], "left").withColumn("cmds", F.array_sort(F.array_union("cmds", F.coalesce("more", F.array().cast("array<string>"))))).drop("more")
    known = entries.groupBy("cmd_name").agg(F.array_distinct(F.flatten(F.collect_list("cmds"))).alias("all"), F.max("entry_ord").alias("top"))
    rest = o.join(pairs, ["cmd_name", "odesc", "variants"], "left_anti").join(known, "cmd_name", "left")
    rest = rest.filter(F.size(F.array_except("variants", F.coalesce("all", F.array().cast("array<string>")))) > 0)
    n = F.row_number().over(Window.partitionBy("cmd_name").orderBy("odesc")) + F.coalesce("top", F.lit(-1))
    return kept.unionByName(rest.select("cmd_name", n.alias("entry_ord"), F.col("odesc").alias("description"), F.array_sort("variants").alias("cmds")))
