import hashlib
import itertools
import random
import re

import duckdb
from pyspark.sql import functions as F

from canlake.llm import q_turns, turn_repair

GRAMMAR = re.compile("(s?(ua)+)?")


def every_repair(turns, gone):
    """(cost, audit, roles) of all edit strings with at most two insertions in a row; capitals are truncated, x must go."""
    rows = []
    for i, t in enumerate(turns):
        rows += ["x"] * gone[i] + [t]
    rows += ["x"] * gone[len(turns)]
    found = []
    inserts = ["", "I", "II"]
    options = [["D"] if t == "x" else ["D", "E"] for t in rows]
    for edits in itertools.product(*options):
        for extra in itertools.product(inserts, repeat=len(rows) + 1):
            audit = extra[0] + "".join(e + x for e, x in zip(edits, extra[1:]))
            for system in (False, True):  # an edited system turn may stay one, if nothing comes before
                cost, out, i, roles = 0, "", 0, ""
                for e in audit:
                    want = "a" if roles[-1:] == "u" else "u"
                    if e == "I":
                        cost, out, roles = cost + 5, out + "I", roles + want
                        continue
                    t, i = rows[i], i + 1
                    if e == "D":
                        cost, out = cost + 2, out + "D"
                    elif t.lower() == "s" and not roles and system:
                        cost, out, roles = cost + 5 * (t == "S"), out + "K", "s"
                    else:
                        keep = t.lower() == want
                        cost, out, roles = cost + (not keep) + 5 * t.isupper(), out + ("K" if keep else "R"), roles + want
                if GRAMMAR.fullmatch(roles):
                    found.append((cost, out, roles))
    return found


def test_against_every_repair():
    dice = random.Random(5)
    for _ in range(120):
        n = dice.randrange(4)
        turns = "".join(dice.choice("suaoSUAOuaua") for _ in range(n))
        gone = tuple(dice.choice((0, 0, 0, 1)) for _ in range(n + 1))
        cost, audit, _ = min(every_repair(turns, gone))
        part = turn_repair.Block()
        part.shape, part.gone, part.part.turns = turns, list(gone), 1
        found = part.close().result()
        assert (found["cost"], found["audit"]) == (cost, audit), (turns, gone)


def automaton(turns, gone):
    """The least (cost, audit) by states of the grammar, for conversations of any length."""
    now = {0: (0, "")}

    def grown(ways):
        for _ in range(3):
            for s, (c, a) in list(ways.items()):
                to = 3 if s == 2 else 2
                ways[to] = min(ways.get(to, (1 << 40, "")), (c + 5, a + "I"))
        return ways

    now = grown(now)
    for i in range(len(turns) + 1):
        for _ in range(gone[i]):
            now = grown({s: (c + 2, a + "D") for s, (c, a) in now.items()})
        if i < len(turns):
            t, new = turns[i], {}
            for s, (c, a) in now.items():
                want, to = ("a", 3) if s == 2 else ("u", 2)
                more = [(s, c + 2, a + "D"), (to, c + (t.lower() != want) + 5 * t.isupper(), a + ("K" if t.lower() == want else "R"))]
                if s == 0 and t.lower() == "s":
                    more.append((1, c + 5 * t.isupper(), a + "K"))
                for to, cost, audit in more:
                    new[to] = min(new.get(to, (1 << 40, "")), (cost, audit))
            now = grown(new)
    return min(now[s] for s in (0, 3) if s in now)


def split(turns, gone, size):
    joiner = turn_repair.Joiner()
    for at in range(0, max(len(turns), 1), size):
        b = turn_repair.Block()
        b.shape, b.part.turns = turns[at : at + size], max(len(turns[at : at + size]), 1)
        b.gone = [gone[at] if at == 0 else 0, *gone[at + 1 : at + size + 1]]
        joiner.add(b.close())
    return joiner.total().result()


def test_long_conversations_in_blocks():
    dice = random.Random(6)
    for n in (1, 7, 40, 130, 400):
        for letters in ("ua", "suaoSUAO", "uuuuA", "uauauauaS"):
            turns = "".join(dice.choice(letters) for _ in range(n))
            gone = [dice.choice((0, 0, 0, 2)) for _ in range(n + 1)]
            want = automaton(turns, gone)
            for size in (1, 3, 64, n):
                found = split(turns, gone, size)
                assert (found["cost"], found["audit"]) == want, (turns, gone, size)


ODD = [
    *[(None, t, r, x) for t, r, x in [(None, None, None), (1, "user", "Hi."), (1, "user", "Hi."), (3, "", "Yes"), (None, "assistant", "\x0b \n")]],
    *[(7, t, r, x) for t, r, x in [(0, "system", "Be good."), (0, "user", "b."), (0, "user", "a."), (0, "assistant", ""), (0, "assistant", "ok?"), (5, "assistant", "ok?")]],
    *[(8, 0, "user", "Same words.")] * 40, (9, None, "tool", "é…"), (9, -4, "User", "x !"), (10, 2, "s", "Only."), *[(11, i, "user", "Again.") for i in range(300)],
    *[(12, i, "user" if i % 2 == 0 else "assistant", f"turn {i}{'.' if i % 7 else ''}") for i in range(700)], (13, 0, "user", "y" * 100000), (14, 3, "ünner", "Ja. \x1c"),
]



def compare(table, sql_table):
    con = duckdb.connect()
    con.register("conversations", sql_table)
    con.sql("SET threads=4")
    want = con.sql(q_turns.ORACLES["op11_conversation_repair"])
    digests, _ = turn_repair.repair(turn_repair.damaged(table))
    names = want.columns
    assert sorted(names) == sorted(digests.columns)
    got = [tuple(r[c] for c in names) for r in digests.collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str)


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    compare(df.withColumn("n", F.lit("clash")).withColumn("part", F.lit("clash")), df.toArrow())


def test_given_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    compare(df, df.toArrow())


def test_lines(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet").union(spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string"))
    digests, made = turn_repair.repair(turn_repair.damaged(df), with_lines=True)
    text = {}
    for r in made.orderBy("conv_id", "part", "block").collect():
        text.setdefault(r.conv_id, []).extend(r.lines)
    for r in digests.collect():
        lines = text.get(r.conv_id, [])
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == r.repaired_sha256
        assert len(lines) == len(r.audit) - r.audit.count("D")


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair(turn_repair.damaged(empty))[0].count() == 0
    gone = spark.createDataFrame([(i, 0, "user", "x.") for i in range(100)], "conv_id long, turn long, role string, text string")
    dropped = turn_repair.damaged(gone).where("n = 0").select("conv_id").distinct()
    rows = turn_repair.repair(turn_repair.damaged(gone))[0].join(dropped, "conv_id").collect()
    assert rows and all((r.gaps, r.cost, r.audit, r.repaired_sha256) == (0, 0, "", hashlib.sha256().hexdigest()) for r in rows)
