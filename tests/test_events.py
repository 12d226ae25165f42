import random
from datetime import date

from tallyloom.operators import events
from tallyloom.sources import readers


def brute_pairs(opens, closes):
    used, out = set(), []
    for i, t in opens:
        for j, u in closes:
            if j >= i and u == t and j not in used:
                used.add(j)
                out.append((t, i, j))
                break
    return sorted(out)


def test_pairing_matches_brute_force(spark):
    rng = random.Random(4)
    for _ in range(6):
        opens = [(i, rng.choice("abc")) for i in range(rng.randint(0, 30))]
        closes = [(i, rng.choice("abcd")) for i in range(rng.randint(0, 30))]
        o, c = (spark.createDataFrame(x, "pos long, title string") for x in (opens, closes))
        got = events.pair_intervals(o, c, ["title"]).select("title", "open_pos", "close_pos").collect()
        assert sorted(map(tuple, got)) == brute_pairs(opens, closes)


def lines(spark, text):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "source string, pos int, value string")


def test_totals_and_midnight(spark):
    rows = readers.intervals(lines(spark, "2024-01-01 10:00:00 10:30:00 ● a - d - app\n2024-01-02 23:50:00 00:10:00 b\n2024-01-03 10:00:00 10:30:00 a - d -  app\nbad line"))
    raw = [tuple(r) for r in events.totals(rows).collect()]
    assert raw == [(date(2024, 1, 3), "10:00:00", "10:30:00", 60.0, "file-directory-App", "a - d - app"), (date(2024, 1, 2), "23:50:00", "00:10:00", -1420.0, "directory/App", "b")]
    assert [r["minutes"] for r in events.totals(rows, "wrap").collect()] == [60.0, 20.0]
    assert [r["title"] for r in events.totals(rows, "drop").collect()] == ["a - d - app"]


def test_equal_totals_keep_first_seen_order(spark):
    rows = readers.intervals(lines(spark, "2024-01-01 10:00:00 10:01:00 z\n2024-01-01 10:00:00 10:01:00 a"))
    assert [r["title"] for r in events.totals(rows).collect()] == ["z", "a"]


def test_event_log(spark):
    log = "2024-01-01 10:00:00 - Nouvelles fenêtres ajoutées :\n0x01  0 host-pc a - b - c\n0x02  0 host-pc d\n-----\n2024-01-01 10:00:02 - Fenêtres fermées :\n0x01  0 host-pc a - b - c\n----"
    rows = readers.event_log(lines(spark, log), "host-").orderBy("pos").collect()
    assert [(r["kind"], r["window_id"], r["title"]) for r in rows] == [("opened", "0x01", "a - b - c"), ("opened", "0x02", "d"), ("closed", "0x01", "a - b - c")]
    assert readers.event_log(lines(spark, log), "host-", first_only=True).count() == 2


def test_history_and_commas(spark):
    rows = readers.history(lines(spark, "#1700000000\nls -l\ncd /\n# note\npwd\n#1700000005\n\ngit log"))
    assert [(r["epoch"], r["command"]) for r in rows.orderBy("pos").collect()] == [(1700000000, "ls -l"), (1700000000, "cd /"), (1700000005, "git log")]
    day = events.command_activity(rows, "2023-11-14").collect()
    assert [(r["open"], r["close"], r["minutes"]) for r in day] == [("22:13:20", "22:13:22", 0.033)] * 2 + [("22:13:25", "22:13:27", 0.033)]
    text = "2024-01-01, 10:00:00, 10:00:02, 0.033, Commande, echo a, b\nshort, line"
    assert [(r["type"], r["name"]) for r in readers.activity_commas(lines(spark, text)).collect()] == [("Command", "echo a, b")]
    assert readers.activity_commas(lines(spark, text), legacy=True).first()["name"] == "echo a b"


def test_readers_of_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ls": [{"description": "d", "cmd": "ls -l"}, {"description": "e", "cmds": ["ls -a", "ls --all"]}]}')
    (tmp_path / "b.json").write_text("not json")
    rows = readers.dictionary(spark, str(tmp_path)).orderBy("entry_ord", "pattern_ord").collect()
    assert [(r["cmd_name"], r["entry_ord"], r["pattern_ord"], r["pattern"]) for r in rows] == [("ls", 0, 0, "ls -l"), ("ls", 1, 0, "ls -a"), ("ls", 1, 1, "ls --all")]
    (tmp_path / "m.xml").write_text('<mime-info><mime-type type="text/plain"><comment>plain text</comment><comment xml:lang="fr">texte</comment><glob pattern="*.txt"/><glob pattern="*.asc"/></mime-type></mime-info>')
    assert sorted(map(tuple, readers.mime_types(spark, str(tmp_path / "m.xml")).collect())) == [("asc", "text/plain", "plain text"), ("txt", "text/plain", "plain text")]
    (tmp_path / "o.txt").write_text("2024-01-01 10:00:00 title one \n\n2024-01-01 10:00:01 two\nbad")
    assert [(r["pos"], r["title"]) for r in readers.events(readers.ordered_lines(spark, str(tmp_path / "o.txt"))).orderBy("pos").collect()] == [(0, "title one"), (2, "two")]


def test_help_and_pages(spark):
    text = "Usage: x\n  -a, --all <n>  show all\n      the rest\n  -b   be brief\n\nCommands:\n  start   begin it\n  stop    end it"
    assert [r["block"] for r in readers.help_blocks(lines(spark, text)).orderBy("pos").collect()] == ["-a, --all <n>  show all the rest", "-b   be brief"]
    assert [r["subcommand"] for r in readers.help_subcommands(lines(spark, text)).orderBy("pos").collect()] == ["start", "stop"]
    page = readers.tldr_pages(lines(spark, "# tar\n\n- Make an archive:\n\n`tar cf {{a}}`\n- List:\n`tar tf {{a}}`")).orderBy("pos").collect()
    assert [(r["description"], r["command"]) for r in page] == [("Make an archive", "tar cf {{a}}"), ("List", "tar tf {{a}}")]
