import random
import re
import time
from itertools import product

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import text as fx
from tallyloom.functions.token_types import token_type, word_type
from tallyloom.operators import commands, tables
from tallyloom.operators.pattern_trie import choices
from tallyloom.plans.queries import QUERIES


@pytest.mark.parametrize("text,want", [("a 'b c' d", ["a", "'b c'", "d"]), ('--f="x y" z', ['--f="x', 'y"', "z"]), ("a 'open", ["a", "'open"]), ("", []), ("  x  ", ["x"])])
def test_split_words(text, want):
    assert commands.split_words(text) == want


def expanded(pattern):
    """All texts of a pattern: every place by each of its choices."""
    holes = re.findall(r"\{\{(.*?)\}\}", pattern, re.S)
    pieces = re.split(r"\{\{.*?\}\}", pattern, flags=re.S)
    for picked in product(*[choices(h, commands.split_outside_quotes) for h in holes]):
        yield "".join(x for pair in zip(pieces, [*picked, ""]) for x in pair)


def plain_key(text, main, loose):
    """The command elements of a text, each rule on its own."""
    words = commands.split_words(text)
    sub = words[1] if len(words) > 1 and re.fullmatch("[a-zA-Z]+", words[1]) else None
    prefix = " ".join([words[0], sub] if sub else words[:1]) if words else ""
    out = []
    for i, w in enumerate(words):
        quoted = w[0] in "'\"" and w.startswith(w[0]) and w.endswith(w[0])
        e = w if i == 0 or quoted else f"{prefix} {w}" if w.startswith("-") else prefix if i == 1 and sub else w
        if i == 0 or e == main or e.startswith(main + " ") or " " in e and any(x.startswith("-") for x in e.split()[1:]):
            e = " ".join(e.split())
            out.append(re.sub(r"^(.*?)=\S+", r"\1={}", e) if loose else e)
    return tuple(out)


PARTS = st.sampled_from(["x", "-a", "--long", "--v=1", "--v={{n}}", "{{[-a|--all]}}", "{{-b|-c d}}", "{{path}}", "{{sub|-a}}", "'q -z'", "'{{a|b}} -w'", "{{|-e}}", "p{{1|2}}-q", "{{on|off}}{{-|=}}x", '"open'])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=5).map(lambda ps: " ".join(["x", *ps])), min_size=1, max_size=6), st.randoms(use_true_random=False))
def test_trie_equals_all_texts(patterns, rng):
    """The first pattern that one of a key's texts comes from, with all texts written out."""
    both = commands.tries(pd.DataFrame([("x", "f", i, 0, p) for i, p in enumerate(patterns)], columns=["cmd_name", "file", "entry_ord", "pattern_ord", "pattern"]))
    for form in ("exact", "loose"):
        keys = {}
        for i, p in enumerate(patterns):
            for t in expanded(p):
                keys.setdefault(plain_key(t, "x", form == "loose"), i)
        others = [tuple(k[:-1]) for k in keys] + [(*k, "x -a") for k in keys]
        for k in [*keys, *others]:
            if k:
                got = both[form].find(k)
                assert (got and got[1]) == keys.get(k), (form, k, patterns)


def test_places_are_not_multiplied():
    """Forty places of two choices each: 2 ** 40 texts, forty steps."""
    both = commands.tries(pd.DataFrame([("x", "f", 0, 0, "x " + " ".join("{{[-%s%d|--%s%d]}}" % (c, i, c, i) for i in range(20) for c in "ab"))], columns=["cmd_name", "file", "entry_ord", "pattern_ord", "pattern"]))
    key = tuple(["x", *[f"x {'-' * (1 + i % 2)}{c}{i}" for i in range(20) for c in "ab"]])
    assert both["exact"].find(key) and not both["exact"].find(key[:-1])


def test_large_dictionary(spark):
    """700 patterns and commands of all of them, dealt to several tasks, against all texts."""
    rng = random.Random(8)
    opts = [f"-{c}" for c in "abcdefgh"] + ["--force", "--name={{n}}", "{{[-o|--out]}}", "{{[-v|--verbose]}}", "{{path}}", "run", "{{up|down}}"]
    d = [(f"f{i % 3}", f"c{i % 40}", i, 0, f"c{i % 40} " + " ".join(rng.choices(opts, k=rng.randint(0, 4))), f"text {i}") for i in range(700)]
    keys, asked = {}, []
    for f, c, e, n, p, text in sorted(d):
        for t in expanded(p):
            asked.append((c, t))
            for form in ("loose", "exact"):
                keys.setdefault((c, form, plain_key(t, c, form == "loose")), text)
    asked += [(c, f"{c} -z"), ("c99", "c99 -a")]
    want = {(c, form, k): keys[c, form, k] for c, t in asked for form in ("loose", "exact") if (k := plain_key(t, c, form == "loose")) and (c, form, k) in keys}
    rows = [(c, form, list(plain_key(t, c, form == "loose"))) for c, t in asked for form in ("loose", "exact")]
    dictionary = spark.createDataFrame(d, "file string, cmd_name string, entry_ord int, pattern_ord int, pattern string, description string")
    found = commands.match_keys(dictionary, spark.createDataFrame(rows, "cmd_name string, form string, key array<string>"), at_once=20)
    assert {(r["cmd_name"], r["form"], tuple(r["key"])): r["description"] for r in found.collect()} == want


def test_many_small_commands(spark):
    """4,000 commands with a pattern each share calls, and more than one task has some; a call for each of them took over 20 s."""
    took = []
    for n in (40, 4000):
        d = spark.range(n).select(F.lit("f").alias("file"), F.concat(F.lit("c"), "id").alias("cmd_name"), F.lit(0).alias("entry_ord"), F.lit(0).alias("pattern_ord"), F.concat(F.lit("c"), "id", F.lit(" {{[-a|--all]}}")).alias("pattern"), F.concat(F.lit("about "), "id").alias("description"))
        keys = d.select("cmd_name", F.lit("exact").alias("form"), F.explode(F.array(*[F.array("cmd_name", F.concat("cmd_name", F.lit(o))) for o in (" -a", " --all", " -b")])).alias("key"))
        options = d.select("cmd_name", F.concat(F.lit("About "), F.substr("cmd_name", F.lit(2)), F.lit(" and more")).alias("description"), F.array(F.concat("cmd_name", F.lit(" -n"))).alias("variants"))
        start = time.time()
        found = commands.match_keys(d, keys).collect()
        merged = commands.merge_options(d, options).collect()
        took.append(time.time() - start)
        assert sorted((r["cmd_name"], *r["key"], r["description"]) for r in found) == sorted((f"c{i}", f"c{i}", f"c{i} {o}", f"about {i}") for i in range(n) for o in ("-a", "--all"))
        assert sorted((r["cmd_name"], r["entry_ord"], *r["cmds"]) for r in merged) == sorted((f"c{i}", 0, f"c{i} -n", f"c{i} {{{{[-a|--all]}}}}") for i in range(n))
    assert took[1] < took[0] + 15


@pytest.mark.parametrize("text", ["a && b || c", "a&&b", "echo 'x && y' | z;;w", 'say "it; is', "a & b &&& c", "x|y||z", "", "  ;  ", "it's; ok' | b"])
def test_parts(spark, text):
    want = [p for p in commands.split_outside_quotes(text, ("&&", "||", "|", ";")) if p]
    assert spark.createDataFrame([(text,)], "t string").select(commands.parts(F.col("t")).alias("p")).first()["p"] == want


@pytest.mark.parametrize("text", ["a 'b c' d", '--f="x y" z', "a 'open", "", "  x  ", "a\tb\u2003c", "'q'r \"s t\"", "don't stop"])
def test_words(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(commands.words(F.col("t")).alias("w")).first()["w"] == commands.split_words(text)


def plain_first(text, patterns):
    return next((p for _, p in sorted(x for x in patterns if x[1] is not None) if p.lower() in text.lower()), None) if text is not None else None


@pytest.mark.parametrize("at_once", [3, 50_000])
def test_first_containing(spark, at_once):
    rng = random.Random(3)
    known = [(rng.randint(0, 30), "".join(rng.choices("abAB", k=rng.randint(1, 5)))) for _ in range(40)] + [(2, None)]
    texts = ["".join(rng.choices("abc ", k=rng.randint(0, 12))) for _ in range(60)] + [None, "", "zzz"]
    items = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "id int, t string")
    df = spark.createDataFrame(known, "o int, p string")
    got = tables.first_containing(items, df, "t", "p", "o", at_once)
    assert sorted(map(repr, ((r["t"], r["p"]) for r in got.collect()))) == sorted(map(repr, ((t, plain_first(t, known)) for t in texts)))
    everything = tables.first_containing(items, df.unionByName(spark.createDataFrame([(99, "")], "o int, p string")), "t", "p", "o", at_once)
    assert {r["t"]: r["p"] for r in everything.collect()}["zzz"] == ""
    assert tables.first_containing(items, df.limit(0), "t", "p", "o").filter("p is not null").count() == 0


def test_time_is_flat_in_the_number_of_patterns():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghij ", k=2000)) for _ in range(300)]
    took = []
    for n in (50, 5000):
        patterns = {"".join(rng.choices("klmnop", k=9)): i for i in range(n)}
        start = time.process_time()
        assert not any(x is not None for x in tables.find_patterns(texts, patterns))
        took.append(time.process_time() - start)
    assert took[1] < 20 * took[0] + 0.2


@pytest.mark.parametrize("token,main,prev,i,want", [
    ("", "x", None, 3, "arg"), ("ls", "ls", None, 0, "cmd"), ("ls -a", "ls", None, 1, "cmdopt"), ("'{\"a\":1}'", "x", None, 1, "json"), ('"http://a.b"', "x", None, 1, "url"), ('"', "x", None, 1, "string"),
    ("u@h:/p", "x", None, 1, "remote_target"), ("notes.tech", "x", None, 1, "domain"), ("10.0.0.1", "x", None, 1, "ip"), ("12:30:45", "x", None, 1, "ipv6"), ("10.0.0.0/24", "x", None, 1, "cidr"),
    ("1-1024", "x", None, 1, "port_range"), ("80", "nmap", None, 1, "port"), ("80", "x", None, 1, "number"), ("80", "x", "port", 2, "port"), ("-3.5", "x", None, 1, "number"), ("eth0", "tcpdump", "tcpdump -i", 2, "network_interface"),
    ("get", "x", None, 1, "http_method"), ("gw", "x", None, 1, "gateway"), ("bob", "hydra", "hydra -l", 2, "username"), ("json", "python", "python -m", 2, "python_module"), ("nginx", "x", None, 1, "server"), ("foo", "x", None, 1, "arg"),
    ("/etc/", "x", None, 1, "folder"), ("./run.sh", "x", None, 1, "file"), ("./a.b.sh", "x", None, 1, "script"), ("a.tar.gz", "x", None, 1, "file"), ("/dev/sda", "x", None, 1, "folder"), (".", "x", None, 1, "arg"), ("-x", "x", None, 1, "option"),
])
def test_token_type(spark, token, main, prev, i, want):
    df = spark.createDataFrame([(token, main, prev, i)], "t string, m string, p string, i int")
    assert df.select(token_type(F.col("t"), F.col("m"), F.col("p"), F.col("i")).alias("x")).first()["x"] == want


def test_plain_words_are_typed_by_the_rules(spark):
    """What is typed by one pattern has the type that the rules give, for all texts of few signs and for words that rules name."""
    rng = random.Random(4)
    signs = "aG9-_.:/@~'\"{}|!&,$ \tàÿſſK"
    tokens = ["".join(t) for n in (0, 1, 2) for t in product(signs, repeat=n)] + ["".join(rng.choices(signs, k=rng.randint(3, 8))) for _ in range(3000)]
    named = ["gw", "nginx", "apache", "get", "post", "pſt", "poſt", "po\ufb06", "head", "options", "patch", "mx", "aaaa", "srv", "a", "curl", "python", "ls", "ab12", "999999", "0123456", "65536", "80", "1-2", "a" * 21, "x\n", "x\u0085"]
    tokens += [p + f(w) + e for w in named for f in (str.lower, str.upper, str.title) for p in ("", "-", "|") for e in ("", ".", ",", ".!!", ".a", "&&&", " ")]
    df = spark.createDataFrame([(t, m, p, i) for t in [*dict.fromkeys(tokens), None] for m, p, i in (("curl", None, 1), ("python", "-m", 2), ("tcpdump", "tcpdump -i", 2), ("hydra", "hydra -l", 2), ("a", "port", 0), (None, None, 1))], "t string, m string, p string, i int")
    args = [F.col("m"), F.col("p"), F.col("i")]
    wrong = df.filter(~word_type(F.col("t"), *args).eqNullSafe(token_type(F.col("t"), *args))).collect()
    assert not wrong


def test_token_types_move_no_rows(spark, sf_dir):
    """Tokens are typed where they stand, so there is no shuffle, broadcast or sort of them."""
    plan = QUERIES["token_types"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Scan" in plan and not re.search("Exchange|Join|Aggregate|Sort", plan)


def test_elements_and_descriptions(spark):
    df = spark.createDataFrame([(0, "sudo tar -xv a.txt | git commit -m 'x y'"), (1, "ls -l"), (2, "nope ./go.b.sh 5")], "id long, command string")
    parts = {(r["id"], r["part"]): r["elems"] for r in commands.command_parts(df).collect()}
    assert parts == {(0, 0): ["tar", "tar -x", "tar -v", "a.txt"], (0, 1): ["git", "git commit", "git commit -m", "'x y'"], (1, 0): ["ls", "ls -l"], (2, 0): ["nope", "./go.b.sh", "5"]}
    d = spark.createDataFrame([("a", "tar", 0, 0, "tar {{[-x|--extract]}} {{[-v|--verbose]}} {{path}}", "Extract"), ("a", "git", 0, 0, "git commit", "Commit"), ("a", "ls", 1, 0, "ls -l", "Second"), ("a", "ls", 0, 0, "ls -l", "First")], "file string, cmd_name string, entry_ord int, pattern_ord int, pattern string, description string")
    got = {(r["id"], r["part"]): r["descriptions"] for r in commands.describe_commands(df, d).collect()}
    # The path of the pattern for tar stands for no command element, so both sides are tar, -x, -v.
    assert got[0, 0] == ["with sudo desc_cmd: Extract", "desc_arg_3: File 'a.txt'"]
    assert got[0, 1] == ["with sudo desc_0: Command 'git'", "desc_1: Commit", "desc_2: Argument 'git commit -m'", "desc_3: String 'x y'"] or got[0, 1][1] == "desc_1: Commit"
    assert got[1, 0] == ["desc_cmd: First"]
    assert got[2, 0] == ["desc_0: Command 'nope'", "desc_1: Run the script './go.b.sh'", "desc_2: Number '5'"]


def test_dictionary_growth(spark):
    d = spark.createDataFrame([("a", "x", 0, 0, "x -a", "Show all files"), ("a", "x", 1, 0, "x -b", "Be brief")], "file string, cmd_name string, entry_ord int, pattern_ord int, pattern string, description string")
    o = spark.createDataFrame([("x", "show all", ["x --all"]), ("x", "quiet", ["x -b"]), ("x", "new one", ["x -n"])], "cmd_name string, description string, variants array<string>")
    got = {r["entry_ord"]: (r["description"], r["cmds"]) for r in commands.merge_options(d, o).collect()}
    assert got == {0: ("Show all files", ["x --all", "x -a"]), 1: ("Be brief", ["x -b"]), 2: ("new one", ["x -n"])}
    found = spark.createDataFrame([("x", "run", "d"), ("x", "run", "d")], "cmd_name string, subcommand string, description string")
    assert commands.new_subcommands(d, found).count() == 1
    assert {tuple(r) for r in commands.availability(spark.createDataFrame([("x",), ("y",)], "command string"), d).collect()} == {("x", "OK"), ("y", "MISSING")}


def test_text_functions(spark):
    row = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    lit = F.lit
    assert row(fx.normalize_title(lit("● ● a"))) == "a" and row(fx.normalize_title(lit("● ● a"), "first")) == "● a" and row(fx.normalize_title(lit("a●b"), "all")) == "ab"
    assert tuple(row(fx.split_extension(lit("a.tar.gz")))) == ("a.tar", "gz") and tuple(row(fx.split_extension(lit(".bashrc")))) == (".bashrc", "")
    assert row(fx.split_triple(lit("a - b"))) is None and tuple(row(fx.split_triple(lit("a - b - c")))) == ("a", "b", "c")
    assert row(fx.trim_after_extension(lit("x a.py more words"))) == "x a.py" and row(fx.trim_after_extension(lit("ends."))) == "ends."
    assert row(fx.title_after_host(F.split(lit("0x1 0 host-a my title"), " "), "host-")) == "my title"
    assert row(fx.response_items(lit('"a", "b\nc","d"'))) == ["a", "b c", "d"]
    assert row(fx.description_lines(lit("x\ndesc_0: one: two\ndesc_1: three"))) == ["one: two", "three"] and row(fx.description_lines(lit("x"))) == ["No description was found."]
    assert row(fx.option_tokens(lit("-d, --delimiter <string>"))) == ["-d", "--delimiter"]
    assert tuple(row(fx.left_and_description(lit("-d, --del  text here")))) == ("-d, --del", "text here") and tuple(row(fx.left_and_description(lit("-d - text")))) == ("-d", "text")
    assert row(fx.option_tokens(lit("(-a, --b: -c;d x -)"))) == ["-a", "--b", "-c;d", "-"] and row(fx.option_tokens(lit("plain"))) == []
    assert tuple(row(fx.left_and_description(lit("-x")))) == ("-x", "") and tuple(row(fx.left_and_description(lit("-a - b  c - d")))) == ("-a - b", "c - d")
    assert row(fx.placeholder_for(lit("number of things"))) == "<id>" and row(fx.placeholder_for(lit("zzz"))) == "<arg>"
    assert row(fx.needs_argument(lit("zzz"), F.array(lit("-q")))) is False and row(fx.needs_argument(lit("zzz"), F.array(lit("--q")))) is True
