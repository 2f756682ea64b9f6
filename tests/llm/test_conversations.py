import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from mediasift.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
FORM = re.compile(r"(s?(ua)+)?")


def brute(turns):
    """The least (cost, audit) over all ways to edit, by trying them all."""
    best = [(10**9, "~")]

    def go(i, roles, cost, audit, inserted):
        if cost > best[0][0]:
            return
        if i == len(turns) and FORM.fullmatch(roles):
            best[0] = min(best[0], (cost, audit))
        if i < len(turns):
            initial, fault = turns[i]
            go(i + 1, roles, cost + 4, audit + "D", 0)
            if fault not in (C.BLANK, C.DUPLICATE):
                extra = 3 * (fault == C.CUT)
                go(i + 1, roles + (initial or "?"), cost + extra, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 3 + extra, audit + "R", 0)
        if inserted < 2:
            for r in "ua":
                go(i, roles + r, cost + 3, audit + "I", inserted + 1)

    go(0, "", 0, "", 0)
    return best[0]


def made(rng, n):
    return [(rng.choice(["u", "a", "u", "a", "s", "x", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]


def found(turns):
    search = C.Search()
    for t in turns:
        search.add(*t)
    return search.best()


@pytest.mark.parametrize("seed", range(60))
def test_search_equals_all_ways(seed):
    turns = made(random.Random(seed), 1 + seed % 5)
    assert found(turns) == brute(turns)


@pytest.mark.parametrize("leg", [1, 2, 3, 7, 50])
def test_legs_change_nothing(monkeypatch, leg):
    rng = random.Random(leg)
    cases = [made(rng, rng.randint(0, 40)) for _ in range(150)] + [[("x", 0)] * 30, [("a", 0), ("u", 0)] * 15, [("u", 3)] * 25]
    whole = [found(t) for t in cases]
    monkeypatch.setattr(C, "LEG", leg)
    assert [found(t) for t in cases] == whole


def test_search_stays_quick_on_long_conversations():
    rng = random.Random(5)
    for turns in (made(rng, 20_000), [("x", 0)] * 20_000, [("u", 0)] * 20_000, [("a", 3)] * 20_000):
        began = time.time()
        cost, audit = found(turns)
        assert time.time() - began < 20 and len(audit.replace("I", "")) == 20_000 and cost > 0


def test_edits_give_a_well_formed_conversation():
    rng = random.Random(9)
    for _ in range(300):
        turns = made(rng, rng.randint(0, 12))
        _, audit = found(turns)
        out, at = "", 0
        for edit, role in C.edits_of(audit, [i for i, _ in turns]):
            out += "" if edit == "D" else role[0] if role else turns[at][0]
            at += edit != "I"
        assert FORM.fullmatch(out) and at == len(turns)


def sha(*said):
    return hashlib.sha256("\n".join(said).encode()).hexdigest()


def test_odd_conversations(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"),
        (2, 0, "user", None), (2, None, None, "Is it?"),  # blank; a role that has to change, first by its turn
        (3, 5, "user", "A."), (3, 5, "user", "A."), (3, 9, "assistant", "B."), (3, 9, "assistant", "B."),
        (4, 0, "assistant", "no end"), (5, 0, " \n", " \t\n"),
        (None, 0, "user", "Q?"), (None, 1, "user", "Q? "), (None, 2, "assistant", "漢字。. "),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "place": F.lit("x"), "fault": F.lit(None)}).repartition(4)
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repair(df).collect()}
    none = sha("")
    assert got[1] == (0, 0, 0, 0, 0, 0, "KK", sha("user:Hi.", "assistant:Yes!"))
    assert got[2] == (0, 1, 0, 0, 1, 8, "DD", none)
    assert got[3] == (3, 0, 2, 0, 2, 8, "KDKD", sha("user:A.", "assistant:B."))
    assert got[4] == (0, 0, 0, 1, 0, 4, "D", none) and got[5] == (0, 1, 0, 0, 0, 4, "D", none)
    assert got[None][5:] == (3, "KIKK", sha("user:Q?", "assistant:", "user:Q? ", "assistant:漢字。. ")) and got[None][:5] == (0, 0, 0, 0, 1)
    assert C.repair(df.where("false")).count() == 0


def test_conversations_without_turns_and_long_texts(spark):
    long = "word. " * 200_000
    df = spark.createDataFrame([(1, 0, "user", "x.", False), (2, 0, "user", long, True), (2, 1, "assistant", long, True), (2, 2, "user", long, True)], SCHEMA + ", here boolean")
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repair(df, present=F.col("here")).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert got[2] == (0, 0, 1, 0, 0, 4, "KKD", sha("user:" + long, "assistant:" + long))


def test_a_conversation_with_a_third_of_all_turns(spark):
    n = 6000
    rows = spark.range(3 * n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 6 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), (F.col("id") % 4000).cast("string"), F.lit(".")).alias("text"))
    got = {r["conv_id"]: r for r in C.repair(rows).collect()}
    mine = [(r["role"], r["text"]) for r in rows.where("conv_id = 0").orderBy("turn").collect()]
    seen, turns = set(), []
    for t in mine:
        turns.append((t[0][0], C.DUPLICATE if t in seen else C.FINE))
        seen.add(t)
    cost, audit = found(turns)
    assert (got[0]["cost"], got[0]["audit"]) == (cost, audit) and got[0]["duplicate"] == sum(f == C.DUPLICATE for _, f in turns) > 0
    said, at = [], 0
    for edit, role in C.edits_of(audit, [i for i, _ in turns]):
        if edit != "D":
            said.append(f"{role or mine[at][0]}:{'' if edit == 'I' else mine[at][1]}")
        at += edit != "I"
    assert got[0]["repaired_sha256"] == sha(*said)
