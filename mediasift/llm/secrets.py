"""Secret scans with a trigram inverted index, in DataFrame operations alone.

1. Every rule's regular expression gives a Boolean query over trigrams that a match must hold (see ``trigrams``).
2. The index has, for each block of documents and each trigram of any query, the keys of the documents that hold it.
   Blocks bound every postings list, however common a trigram is.
3. Postings are intersected for each alternative of a rule and united over its alternatives: its candidates.
4. The candidates of a rule are verified by its regular expression on the whole text; rules without a mandatory trigram
   look at every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.llm.trigrams import trigram_query
from mediasift.sources.shared import stored

#: Documents of a block of the index, on average.
BLOCK_ROWS = 20_000
#: Candidate documents up to which their keys are broadcast (some 24 bytes each); more are joined by sorting.
BROADCAST_ROWS = 200_000


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key")


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    group: int = 0  # of which
    least: int = 0  # characters are asked for; a shorter match is dropped, and what it took stays taken


#: Runs of one class are matched at their least length at once: a shorter run holds no longer match.
BASE = (
    Rule("assign", rf"({_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Formats of further keys.
ADDED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._-]{20,}"),
    Rule("basic", r"[a-z]{2,12}://[A-Za-z0-9._-]+:[^\x00-\x20/@:]+@"),
)
RULES = BASE + ADDED


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the leftmost non-overlapping matches, in code points: the gaps between matches and the
    matches take turns, so their lengths add up to places."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern), F.length)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(s: Column, m: Column) -> Column:
        start = s["at"] + m["gap"]
        end = start + F.length(m["match"])
        good = F.lit(True) if not rule.least else F.length(F.regexp_extract(m["match"], rule.pattern, rule.group)) >= rule.least
        new = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(good, F.concat(s["spans"], new)).otherwise(s["spans"]).alias("spans"))

    turns = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"))
    return F.aggregate(turns, state, step, lambda s: s["spans"])


def index(keyed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(block, gram, keys) of the rows (key, text): the postings of all trigrams that a rule asks for."""
    grams = sorted({g for r in rules for alternative in trigram_query(r.pattern) for g in alternative})
    low = keyed.select("key", F.lower("text").alias("low"))
    held = low.select("key", F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))).alias("gram"))
    blocks = -(-keyed.count() // BLOCK_ROWS) or 1
    return held.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "gram").agg(F.collect_set("key").alias("keys"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): the documents that fulfil the query of a rule, and which."""
    block = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("of"))
    none = F.array().cast("array<bigint>")
    found = []
    for r in rules:
        ways = [reduce(F.array_intersect, [F.coalesce(F.col("of")[g], none) for g in sorted(way)]) for way in trigram_query(r.pattern)]
        if ways:
            found.append(F.struct(F.lit(r.name).alias("rule"), reduce(F.array_union, ways).alias("keys")))
    each = block.select(F.explode(F.array(*found)).alias("f")).select("f.rule", F.explode("f.keys").alias("key"))
    return each.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def find(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans) for every row: an array of (start, rank, end, kind) in order of start, then of the rules.

    A null text is empty and has no spans. Rows that are equal repeat; a null id is a value like any other. Columns
    other than id and text are not touched, whatever their names; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.xxhash64("id", "text"))  # should two keys meet, both are verified
    asked = stored(candidates(stored(index(keyed), "postings")), "candidates")
    small = asked.count() <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(asked) if small else asked.hint("merge"), "key", "left")
    all_spans = []
    for rank, r in enumerate(RULES):
        there = F.col("text").rlike(r.pattern)
        if trigram_query(r.pattern):
            there = F.coalesce(F.array_contains("rules", r.name), F.lit(False)) & there
        named = F.transform(_spans(F.col("text"), r), _named(rank, r.name))
        all_spans.append(F.when(there, named).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")))
    return joined.select(F.col("id").alias(id), F.array_sort(F.concat(*all_spans)).alias("spans"))


def _named(rank: int, name: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(name).alias("kind"))


def query(spark, sf_dir: str) -> DataFrame:
    from mediasift.sources.tables import table

    found = find(table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    numbers = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{r.name}") for k, r in enumerate(BASE)]
    return found.select("doc_id", *numbers, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _is(rank: int):
    return lambda s: s["rank"] == rank


def sql() -> str:
    """DuckDB: all rules on every text."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    one = []
    for rank, r in enumerate(RULES):
        good = f"AND length(regexp_extract(m[i], {quoted(r.pattern)}, {r.group})) >= {r.least}" if r.least else ""
        one.append(f"""SELECT r, {rank} AS rank, '{r.name}' AS kind, s, s + length(m[i]) AS e FROM (
  SELECT r, m, i, list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS s
  FROM (SELECT r, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, {quoted(r.pattern)}) AS m, string_split_regex(t, {quoted(r.pattern)}) AS g FROM d WHERE regexp_matches(t, {quoted(r.pattern)})))
) WHERE true {good}""")
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), spans AS ({' UNION ALL '.join(one)}),
of AS (SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN of USING (r)"""
