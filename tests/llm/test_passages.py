"""Line dedup of whole passages: against all common runs of lines, and planted ones."""

import random
import re
from collections import defaultdict

from mediasift.llm import linededup
from mediasift.sources.tables import table

CUT = re.compile(linededup.LINE_END)


def counts(lines):
    weight = sum(max(len(x), 6 * len(x.strip(" ").split(" "))) for x in lines)
    return weight >= 150 and len(lines) > 1 or len(lines) == 1 and (len(lines[0]) >= 250 or len(lines[0].split()) >= 50)


def removed(rows):
    """{id: sorted line numbers} in a run of lines that counts and starts at an earlier (id, place) too."""
    texts = {i: [x for x in CUT.split(t or "") if x] for i, t in rows}
    places, out = defaultdict(list), {}
    for i in sorted(texts):
        lines, gone = texts[i], set()
        for k, line in enumerate(lines):
            for j, m in places[line]:
                n = 0
                while k + n < len(lines) and m + n < len(texts[j]) and lines[k + n] == texts[j][m + n]:
                    n += 1
                if counts(lines[k : k + n]):
                    gone.update(range(k, k + n))
                elif counts([line]):
                    gone.add(k)
            places[line].append((i, k))
        out[i] = sorted(gone)
    return out


def rows_of(spark, rows):
    return {r["doc_id"]: r for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_all_common_runs(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    rnd = random.Random(4)
    verse = ["Ah. ", "So it goes on.\n", "A line of verse, rather short\n", "b\n", "Which of the two is it then? "]
    rows += [(10_000 + k, "".join(rnd.choice(verse) for _ in range(rnd.randrange(40)))) for k in range(60)]
    got = {i: list(r["removed_lines"]) for i, r in rows_of(spark, rows).items()}
    assert got == removed(rows) and any(got.values())


def test_short_passages_between_other_lines(spark):
    rnd = random.Random(1)
    own = lambda n: [" ".join(f"n{rnd.randrange(10**9)}" for _ in range(8)) + ".\n" for _ in range(n)]
    passages = [["".join(" ".join(f"p{k}{n}{x}{w}" for w in range(-(-51 // n))) + "\n") for x in range(n)] for n in (1, 2, 3) for k in range(30)]
    passages += [[" ".join("abcde"[(k + w) % 5] for w in range(50 + k)) + ".\n"] for k in range(3)]  # many short words
    rows, planted = [], {}
    for k, passage in enumerate(passages):
        for copy in range(3):
            before = own(rnd.randrange(5))
            planted[3 * k + copy] = list(range(len(before), len(before) + len(passage))) if copy else []
            rows.append((3 * k + copy, "".join(before + passage + own(rnd.randrange(5)))))
    assert {i: list(r["removed_lines"]) for i, r in rows_of(spark, rows).items()} == planted


def test_odd_cases(odd):
    assert linededup.dedup(odd).count() == 12 and linededup.dedup(odd.where("false")).count() == 0


def test_short_lines_that_many_texts_share_stay(spark):
    """Headers and footers of a few words are no passages; a passage whose edge lines run into others is, as far as lines are equal."""
    rnd = random.Random(3)
    own = lambda n: " ".join(f"n{rnd.randrange(10**9)}" for _ in range(n))
    passage = " ".join(f"Sentence {k} of the passage has a few words of its own." for k in range(5))
    rows = [(k, f"A header of this source, of a dozen words or so at most.\n{own(20)}.\nSee there. And so on. The end.\n") for k in range(30)]
    rows += [(100 + k, f"{own(6)}. {own(3)} {passage} {own(4)}. {own(9)}.") for k in range(3)]
    got = {i: list(r["removed_lines"]) for i, r in rows_of(spark, rows).items()}
    assert not any(got[k] for k in range(30)) and got[100] == [] and got[101] == got[102] == [2, 3, 4, 5]


def test_matches_reach_as_far_as_lines_are_equal(spark):
    """Passages of 4 to 9 lines between different neighbours, where an edge chunk can run over into other lines."""
    rnd = random.Random(7)
    own = lambda n: [" ".join(f"n{rnd.randrange(10**9)}" for _ in range(8)) + ".\n" for _ in range(n)]
    rows, planted = [], {}
    for k in range(60):
        passage = own(4 + k % 6)
        for copy in range(3):
            before = own(1 + rnd.randrange(4))
            planted[3 * k + copy] = list(range(len(before), len(before) + len(passage))) if copy else []
            rows.append((3 * k + copy, "".join(before + passage + own(2))))
    assert {i: list(r["removed_lines"]) for i, r in rows_of(spark, rows).items()} == planted
