"""Repair of the structure of conversations: which turns to keep, to give another role, to delete or to insert, at least cost.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. Blank turns and repeats have to go; a truncated
turn that stays costs extra. The cheapest edits are found by depth-first branch-and-bound: an explicit stack of partial edits,
the incumbent (cost, audit), lower bounds for what the remaining turns cost from each state, and a dominance table that
holds the best prefix met at each turn and state. A branch ends if it cannot beat the incumbent or a prefix at its node; an
empty stack proves that the incumbent is the best. Equal costs are settled by the audit, least in ASCII.

Spark deals turns by conversation and sorts them; the search reads role initials and faults only, as a stream, and
gives one row for each edit, which fetches its turn's text by a join. A conversation may have any number of turns: it is
searched in legs of bounded length, between which the best edits to each of the four states are carried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.operators.joins import with_one
from mediasift.sources.shared import stored

BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FINE, BLANK, DUPLICATE, CUT = range(4)
#: What the output so far ends with: nothing, s, u or a. It is well formed after nothing and after a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (EMPTY, ASSISTANT)
#: From each state the one that u or a leads to.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Turns of a leg.
LEG = 1024
#: Short conversations whose search is remembered by a task.
REMEMBERED = 1 << 16


def _kept(initial: str, state: int) -> int | None:
    """The state after a turn that is kept as it is; None if it may not stand there."""
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    return NEXT[state] if initial == ("u" if NEXT[state] == USER else "a") else None


def _bounds(turns: list[tuple[str, int]], ends: tuple[int, ...], last: bool) -> list[list[float]]:
    """For each turn and state, what the turns from there on cost at least, if the edits are to end in one of ``ends``."""
    at = [0 if s in ends else math.inf for s in range(4)]
    inserted = lambda at: [min(at[s], INSERT + at[NEXT[s]], 2 * INSERT + at[NEXT[NEXT[s]]]) for s in range(4)]
    low = [inserted(at) if last else at]
    for initial, fault in reversed(turns):
        after = low[-1]
        extra = TRUNCATED if fault == CUT else 0
        at = [DELETE + after[s] for s in range(4)]
        if fault not in (BLANK, DUPLICATE):
            for s in range(4):
                at[s] = min(at[s], REROLE + extra + after[NEXT[s]])
                if (kept := _kept(initial, s)) is not None:
                    at[s] = min(at[s], extra + after[kept])
        low.append(inserted(at))
    return low[::-1]


def search(turns: list[tuple[str, int]], starts: dict[int, tuple[int, int]], ends: tuple[int, ...], last: bool = True) -> tuple[int, int, str, int] | None:
    """The best edits of a leg that end in one of ``ends``: (cost, rank of the start, audit, end); None if there are none.

    ``starts`` are (cost, rank among the starts' audits) of the states in which the leg may begin. In the last leg turns may be
    inserted behind the last one.

    Two prefixes at one node have consumed the same turns, so at equal cost neither audit begins with the other (inserted turns
    cost), and the lesser one stays so whatever follows.
    """
    n, low = len(turns), _bounds(turns, ends, last)
    table: dict[tuple[int, int], tuple[int, int, str]] = {}  # dominance: the best prefix at each node
    best: tuple[int, int, str, int] | None = None
    stack = [(cost + low[0][s], rank, "", cost, 0, s) for s, (cost, rank) in starts.items()]
    stack.sort(reverse=True)
    while stack:
        hope, rank, audit, cost, i, s = stack.pop()
        if hope == math.inf or best is not None and (hope, rank, audit) > best[:3]:
            continue  # the bound
        if (i, s) in table and table[i, s] <= (cost, rank, audit):
            continue  # dominated
        table[i, s] = (cost, rank, audit)
        if i == n and s in ends and (best is None or (cost, rank, audit) < best[:3]):
            best = (cost, rank, audit, s)
        branches = []
        if i < n:
            initial, fault = turns[i]
            branches.append((cost + DELETE + low[i + 1][s], rank, audit + "D", cost + DELETE, i + 1, s))
            if fault not in (BLANK, DUPLICATE):
                there, paid = NEXT[s], cost + (TRUNCATED if fault == CUT else 0)
                branches.append((paid + REROLE + low[i + 1][there], rank, audit + "R", paid + REROLE, i + 1, there))
                if (kept := _kept(initial, s)) is not None:
                    branches.append((paid + low[i + 1][kept], rank, audit + "K", paid, i + 1, kept))
        if i < n or last:
            branches.append((cost + INSERT + low[i][NEXT[s]], rank, audit + "I", cost + INSERT, i, NEXT[s]))
        stack += sorted(branches, reverse=True)  # the most promising branch is taken first, so it goes on last
    return best


@lru_cache(maxsize=REMEMBERED)
def _short(turns: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    cost, _, audit, _ = search(list(turns), {EMPTY: (0, 0)}, ENDS)
    return cost, audit


class Search:
    """The cheapest edits of one conversation, turn by turn. Holds one leg, and the audits of the best edits to each state."""

    def __init__(self):
        self.turns: list[tuple[str, int]] = []
        #: State -> (cost, rank among the audits, (what came before, the audit of the leg)).
        self.ahead: dict[int, tuple[int, int, tuple | None]] = {EMPTY: (0, 0, None)}
        self.legs = 0

    def add(self, initial: str, fault: int) -> None:
        if len(self.turns) == LEG:
            before = {rank: parts for _, rank, parts in self.ahead.values()}
            found = sorted((x for e in range(4) if (x := self._leg((e,), False))), key=lambda x: x[1:3])  # as the whole audits are ordered
            self.ahead = {e: (cost, k, (before[rank], audit)) for k, (cost, rank, audit, e) in enumerate(found)}
            self.turns, self.legs = [], self.legs + 1
        self.turns.append((initial, fault))

    def _leg(self, ends: tuple[int, ...], last: bool):
        return search(self.turns, {s: (cost, rank) for s, (cost, rank, _) in self.ahead.items()}, ends, last)

    def best(self) -> tuple[int, str]:
        if not self.legs:
            return _short(tuple(self.turns))
        cost, start, audit, _ = self._leg(ENDS, True)
        parts, chain = [audit], next(parts for _, rank, parts in self.ahead.values() if rank == start)
        while chain:
            chain, audit = chain
            parts.append(audit)
        return cost, "".join(reversed(parts))


def edits_of(audit: str, initials: Iterable[str]) -> Iterator[tuple[str, str | None]]:
    """(edit, role) along an audit; the role is None for turns that are kept or deleted."""
    state, given = EMPTY, iter(initials)
    for edit in audit:
        initial = None if edit == "I" else next(given)
        if edit == "K":
            state = _kept(initial, state)
        elif edit != "D":
            state = NEXT[state]
        yield edit, ROLES[state] if edit in "RI" else None


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """(key, place, turn, role, text, present), stored: ``place`` counts from 1 in each conversation, by turn (nulls first), then role,
    then text. A null role or text reads as one space.

    Rows that are not ``present`` name a conversation, but are no turn of it. ``key`` is the conversation in a struct, so that
    nulls are joined as well.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    here = F.lit(True) if present is None else present
    rows = turns.select(F.struct(F.col(conv).alias("id")).alias("key"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"), here.alias("present"))
    order = [F.desc("present"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    return stored(rows.repartition("key").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order)).cast("long")), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """(key, place, turn, present, initial, fault) of :func:`numbered` turns. The first fault of a turn counts: blank, a role and text
    that an earlier turn has, or an end without ``.``, ``!`` or ``?``. An empty role has no initial and may not stand. Repeats are found by digests, from the first of each, around hot ones."""
    solid = F.rtrim("text", F.lit(BLANKS))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    signs = rows.select("key", "place", "turn", "present", F.left("role", F.lit(1)).alias("initial"), F.right(solid, F.lit(1)).alias("end"), digest.alias("digest"))
    signs = stored(signs, "signs")
    firsts = stored(signs.where("present").groupBy("key", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-turns")
    later = with_one(signs.where("present").select("key", "digest", "place"), firsts, ["key", "digest"]).where("place > first").select("key", "place", F.lit(True).alias("seen"))
    fault = F.when(F.col("end") == "", BLANK).when(F.coalesce("seen", F.lit(False)), DUPLICATE).when(~F.col("end").isin(".", "!", "?"), CUT).otherwise(FINE)
    return signs.join(later.hint("merge"), ["key", "place"], "left").select("key", "place", "turn", "present", "initial", fault.alias("fault"))


def repairs(marked: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation of :func:`faults`, stored: a row (key, summary) each, and one (key, edit) for each letter of
    the audit. ``edit`` is (number, letter, place of the turn or null, role or null)."""

    def run(batches):
        key, out = None, []
        state: dict = {}

        def ended():
            if key is None:
                return
            cost, audit = state["search"].best()
            turns = state["turns"]
            summary = {**{f: state[f] for f in ("blank", "duplicate", "truncated", "illegal")}, "gaps": turns[1] - turns[0] + 1 - turns[2] if turns else 0, "cost": cost, "audit": audit}
            out.append((key, summary, None))
            place, steps = 0, edits_of(audit, state["initials"])
            for number, (letter, role) in enumerate(steps):
                place += letter != "I"
                out.append((key, None, {"number": number, "letter": letter, "place": None if letter == "I" else place, "role": role}))
                if len(out) >= 8192:
                    yield flushed()

        def flushed():
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=fields)

        whole = [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "gaps", "cost")]
        fields = None
        for batch in batches:
            if fields is None:
                kinds = pa.struct([*whole, ("audit", pa.string())]), pa.struct([("number", pa.int64()), ("letter", pa.string()), ("place", pa.int64()), ("role", pa.string())])
                fields = pa.schema([("key", batch.schema.field("key").type), ("summary", kinds[0]), ("edit", kinds[1])])
            for new, turn, present, initial, fault in zip(*(batch[c].to_pylist() for c in ("key", "turn", "present", "initial", "fault")), strict=True):
                if key is None or new != key:
                    yield from ended()
                    key, state = new, {"search": Search(), "turns": None, "initials": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                if not present:
                    continue
                if state["initials"] and state["initials"][-1] + initial not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["initials"].append(initial)
                if fault != FINE:
                    state[(None, "blank", "duplicate", "truncated")[fault]] += 1
                if turn is not None:  # turns come in order
                    low, high, n = state["turns"] or (turn, None, 0)
                    state["turns"] = (low, turn, n + (turn != high))
                state["search"].add(initial, fault)
            if len(out) >= 8192:
                yield flushed()
        yield from ended()
        if out:
            yield flushed()

    kind = marked.schema["key"].dataType.simpleString()
    summary = "struct<blank: long, duplicate: long, truncated: long, illegal: long, gaps: long, cost: long, audit: string>"
    dealt = marked.repartition("key").sortWithinPartitions("key", "place")
    return stored(dealt.mapInArrow(run, f"key {kind}, summary {summary}, edit struct<number: long, letter: string, place: long, role: string>"), "repairs")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, number, letter, role, text) of the turns of :func:`numbered` as the edits of :func:`repairs` leave them; inserted ones are empty."""
    steps = found.where("edit is not null and edit.letter <> 'D'").select("key", "edit.*")
    texts = rows.where("present").select("key", "place", F.col("role").alias("own"), "text")
    joined = steps.join(texts.hint("merge"), ["key", "place"], "left")
    return joined.select("key", "number", "letter", F.coalesce("role", "own").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """(key, sha256) of each conversation's ``role:text``, joined by newlines. A hash reads in order, so a conversation passes through one
    task, as a stream."""

    def run(batches):
        key, hashed, schema = None, None, None
        for batch in batches:
            schema = schema or pa.schema([("key", batch.schema.field("key").type), ("sha256", pa.string())])
            done = []
            for new, role, text in zip(batch["key"].to_pylist(), batch["role"], batch["text"], strict=True):
                if key is None or new != key:
                    if key is not None:
                        done.append((key, hashed.hexdigest()))
                    key, hashed = new, hashlib.sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(f"{role.as_py()}:{text.as_py()}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], schema[0].type), pa.array([hashed.hexdigest()])], schema=schema)

    kind = rows.schema["key"].dataType.simpleString()
    dealt = rows.select("key", "number", "role", "text").repartition("key").sortWithinPartitions("key", "number")
    return dealt.mapInArrow(run, f"key {kind}, sha256 string")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation, a null one included.

    Nulls read as :func:`numbered` says; turn numbers are whole numbers; rows that repeat are duplicates; a conversation without turns
    has zeros, an empty audit and the hash of nothing; an empty table gives an empty one; further columns play no part.
    """
    rows = numbered(turns, conv, turn, role, text, present)
    found = repairs(faults(rows))
    sums = found.where("summary is not null").select("key", "summary.*")
    hashed = digests(repaired(rows, found))
    out = sums.join(hashed.hint("merge"), "key", "left")
    nothing = hashlib.sha256().hexdigest()
    return out.select(F.col("key.id").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with faults by a hash of (conv_id, turn), and ``present``, false for a turn that is dropped."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), F.explode(times).alias("time")).drop("time")


def query(spark, sf_dir: str) -> DataFrame:
    from mediasift.sources.tables import table

    return repair(damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))


SQL = """
WITH RECURSIVE bits AS (SELECT range AS i, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
hashed AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda x: unicode(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc),
damaged AS (SELECT cid, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, (SELECT unnest([1, 2]) AS time) WHERE kind <> 0 AND (time = 1 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS solid FROM damaged),
turns AS MATERIALIZED (SELECT *, left(role, 1) AS r, CASE WHEN solid = '' THEN 1 WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 2 WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) AS was FROM placed),
ins AS (SELECT * FROM (VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (2, '', 2), (2, 'I', 3), (3, '', 3), (3, 'I', 2)) v(s0, ii, s1)),
edit AS (SELECT * FROM (VALUES (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2), (0, 'R', NULL, 2), (1, 'R', NULL, 2), (2, 'R', NULL, 3), (3, 'R', NULL, 2), (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3)) v(s1, e, need, s2)),
best AS (SELECT DISTINCT cid, 0::BIGINT AS i, 0 AS s, {'cost': 0::BIGINT, 'audit': ''} AS b FROM hashed
  UNION ALL SELECT p.cid, p.i + 1, e.s2, min({'cost': p.b.cost + 3 * len(ii) + CASE e.e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.e <> 'D' AND t.fault = 3 THEN 3 ELSE 0 END, 'audit': p.b.audit || ii || e.e})
    FROM best p JOIN turns t ON t.cid = p.cid AND t.i = p.i + 1 JOIN ins ON ins.s0 = p.s JOIN edit e ON e.s1 = ins.s1 AND (e.need IS NULL OR e.need = t.r) AND (e.e = 'D' OR t.fault NOT IN (1, 2)) GROUP BY p.cid, p.i + 1, e.s2),
final AS (SELECT cid, min({'cost': b.cost + 3 * len(ii), 'audit': b.audit || ii}) AS b FROM best JOIN ins ON ins.s0 = best.s
  WHERE ins.s1 IN (0, 3) AND i = (SELECT count(*) FROM turns t WHERE t.cid = best.cid) GROUP BY cid),
letters AS (SELECT cid, unnest(range(1, len(b.audit) + 1)) AS j, string_split(b.audit, '')[j] AS e FROM final WHERE b.audit <> ''),
steps AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS o FROM letters WINDOW w AS (PARTITION BY cid ORDER BY j)),
left_over AS (SELECT s.cid, s.j, s.o, s.e, t.role, t.text, max(CASE WHEN s.o = 1 AND s.e = 'K' AND t.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.cid) AS sys
  FROM steps s LEFT JOIN turns t ON t.cid = s.cid AND t.i = s.i AND s.e <> 'I' WHERE s.e <> 'D'),
text AS (SELECT cid, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS t FROM left_over GROUP BY cid),
counts AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (i > 1 AND was || r NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY cid)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  b.cost::BIGINT AS cost, b.audit AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, cid FROM hashed) JOIN final USING (cid) LEFT JOIN counts USING (cid) LEFT JOIN text USING (cid)
"""
