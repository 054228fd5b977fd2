"""Commands by their words, and stems by the published examples."""

import pytest
from pyspark.sql import functions as F

from loomlog.functions import commands, stem
from loomlog.operators import search

CASES = [
    # command, program, host, git operations
    ("make -j4 all", "make", None, []),
    ("FOO=1 sudo /usr/bin/apt update", "apt", None, []),
    ("ssh -p 2222 -o X=y dev@box.example.org 'git push'", "ssh", "box.example.org", []),
    ("cd /x && git -C /y commit -m 'git push; rm' && git push origin main", "cd", None, ["commit", "push"]),
    ("git push --dry-run; git log | cat", "git", None, []),
    ("scp a.txt me@host7:/tmp/ ; echo done", "scp", "host7", []),
    ("(cd a; git -c user.name=x cherry-pick abc)", "cd", None, ["cherry-pick"]),
    ('echo "ssh nowhere"', "echo", None, []),
    ("rsync -a build/ web1:/srv", "rsync", "web1", []),
    ("", None, None, []),
    (None, None, None, None),
]


def test_commands(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, c string")
    c = F.col("c")
    got = {r.i: (r.p, r.h, r.g) for r in rows.select("i", commands.program(c).alias("p"), commands.remote_host(c).alias("h"), commands.git_operations(c).alias("g")).collect()}
    assert got == {i: x[1:] for i, x in enumerate(CASES)}


# Pairs from the paper's own examples.
PAIRS = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit radically radic triplicate triplic formalize formal electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust irritant irrit replacement replac adoption adopt homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()


def test_stems(spark):
    words = PAIRS[::2] + ["yes", "a", "is", "über", "x86"]
    got = spark.createDataFrame([(words,)], "w array<string>").select(stem.stems(F.col("w")).alias("s")).first().s
    assert got == PAIRS[1::2] + ["ye", "a", "is", "über", "x86"]


@pytest.mark.parametrize("mode,found", [("all", [1]), ("any", [1, 2])])
def test_stemmed_search(spark, mode, found):
    docs = spark.createDataFrame([(1, "the failing migrations"), (2, "a success that failed"), (3, None)], "id int, t string")
    q = spark.createDataFrame([(1, "failed migration")], "query_id int, query string")
    assert sorted(r.id for r in search.bm25(docs, "id", "t", q, stem.stemmed_tokens, mode).collect()) == found


def test_fields(spark):
    docs = spark.createDataFrame([(1, "red fox", "blue"), (2, "blue", "red red fox"), (3, "none", None)], "id int, head string, body string")
    q = spark.createDataFrame([(1, "red fox")], "query_id int, query string")
    got = {r.id: r for r in search.over_fields(docs, "id", ["head", "body"], q).collect()}
    assert set(got) == {1, 2} and got[1].field == "head" and got[2].field == "body" and got[1].best == got[1].total
