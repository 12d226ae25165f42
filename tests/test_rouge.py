import random
import time
import tracemalloc

import pytest

from pyspark.sql import functions as F

from tallyloom.operators import rouge


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t


def plain_places(a, b):
    """The way back through the whole table."""
    t, out, i, j = table(a, b), [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def test_subsequences_equal_the_table():
    rng = random.Random(1)
    for n in range(600):
        a, b = ([rng.choice("abcde"[: 2 + n % 4]) for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert rouge.common_length(a, b) == table(a, b)[-1][-1]
        assert rouge.common_places(a, b) == plain_places(a, b)


def test_long_texts_take_little():
    rng = random.Random(2)
    a, b = ([str(int(rng.paretovariate(0.7))) for _ in range(20_000)] for _ in range(2))
    start = time.process_time()
    n = rouge.common_length(a, b)
    assert time.process_time() - start < 1
    tracemalloc.start()
    places = rouge.common_places(a, b)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert len(places) == n


@pytest.mark.parametrize(("word", "want"), [
    ("dying", "die"), ("skies", "sky"), ("ties", "tie"), ("news", "news"), ("innings", "inning"), ("proceed", "proceed"), ("enjoy", "enjoy"), ("happy", "happi"), ("died", "die"), ("cried", "cri"), ("flies", "fli"), ("caresses", "caress"),
    ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("relational", "relat"), ("conditional", "condit"), ("rationally", "ration"), ("hopefully", "hope"),
    ("biology", "biolog"), ("sensibly", "sensibl"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controlling", "control"), ("cat", "cat"), ("electricity", "electr"), ("oed", "oed"), ("being", "be"), ("user", "user"), ("use", "use"),
])
def test_stems(word, want):
    assert rouge.stem(word) == want


def test_union_of_lines(spark):
    df = spark.createDataFrame([(1, "the cats sat\non the mat", "a cat sat\nthe mat was on"), (2, None, "x"), (3, "", ""), (4, "same\nline", "same\nline")], "id int, p string, r string")
    assert {r["id"]: round(r["rouge"], 4) for r in rouge.rouge_lsum(df, "id", "p", "r").collect()} == {1: 0.6154, 2: 0.0, 3: 0.0, 4: 1.0}
    assert {r["id"]: round(r["rouge"], 4) for r in rouge.rouge_lsum(df, "id", "p", "r", stemmed=False).collect()} == {1: 0.4615, 2: 0.0, 3: 0.0, 4: 1.0}


def test_python_gets_texts_not_lists_of_words(spark):
    """Lists of words of a whole batch took the executors' Python memory; a batch is texts, and words exist for a row."""
    df = spark.createDataFrame([(1, "Running dogs\nwere jumping", "the dogs ran\njumping"), (2, None, "a"), (3, "", "")], "id int, p string, r string")
    sends = lambda q: [line for line in q._jdf.queryExecution().executedPlan().toString().splitlines() if "ArrowEvalPython" in line]
    for f, arg in ((rouge.rouge_n, (1, True)), (rouge.rouge_l, (True,)), (rouge.rouge_lsum, ())):
        q = f(df, "id", "p", "r", *arg)
        assert sends(q) and not [1 for u in q._jdf.queryExecution().analyzed().toString().splitlines() if "_udf(" in u]
        assert {r["id"]: r["rouge"] > 0 for r in q.collect()} == {1: True, 2: False, 3: False}
    words = df.select(rouge.stem_words(rouge.tokens(F.col("p"))).alias("w")).collect()
    assert [r["w"] for r in words] == [[rouge.stem(w) for w in ("running", "dogs", "were", "jumping")], [], []]
