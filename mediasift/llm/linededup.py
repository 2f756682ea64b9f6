"""Line dedup by content-defined chunks of lines, in DataFrame operators alone.

1. Texts are cut into lines (also after sentence ends, as texts come with very long lines). Lines are counted by hash over
   all documents: only lines that occur twice can be part of a repeated passage, so the others end a run.
2. Every run of repeated lines is cut into chunks: a rolling hash over the last two line hashes says after which lines a
   chunk ends, so the boundaries depend on their own neighbourhood only and a passage that has moved is cut as before. A
   long line is a chunk of its own.
3. All occurrences of a repeated line are compared byte by byte (the smallest is the largest), so equal line hashes stand
   for equal bytes; lines that fail are never removed. Chunks are counted by two 64-bit hashes of their lines.
4. The occurrence of a chunk in the smallest id, at the smallest place, stays; the lines of all others go.
5. Where a passage ends inside a chunk, its first and last lines are left by that. So the lines that no removed chunk holds
   are looked up once more, with the fewest lines beside them that count as a passage. The first occurrence of anything
   never lies in a removed chunk, as the chunk's own first occurrence would come before, so nothing is missed: what goes are
   all runs of lines that count (:data:`LEAST_MATCH`, :data:`LONG_LINE`) and occur before, and of each one stays.

Counts are summed before the shuffle, a passage that very many documents share is one row of the table of first
occurrences, which is broadcast if it is small and joined around hot keys if not, and texts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.operators.joins import with_one
from mediasift.sources.shared import stored

#: A sentence ends at a single mark before a blank, a line at its newline.
LINE_END = r"(?<=\n)|(?<=[.!?] )(?<!\.\. )(?<!!! )(?<!\?\? )"
ENDINGS, NOT_ENDINGS = ("\n", ". ", "! ", "? "), (".. ", "!! ", "?? ")
#: Put after each ending to split at, which is faster; a text that holds it is split by the expression.
MARK = "\x01"
#: A chunk ends after one of so many lines.
ENDS_OF = 4
#: A line weighs as many as its characters, or as this for each of its words if that is more.
WORD = 6
#: A passage that counts has two lines or more of so much weight together (25 words or 150 characters, half of what is to be
#: found whole, as a passage may begin and end inside a line; shorter lines that many texts share stay)...
LEAST_MATCH = 25 * WORD
#: ... or is one line of so many characters or words.
LONG_LINE, LONG_WORDS = 250, 50
#: A window is its first line times this plus its number of lines, which is 25 at most, as a line weighs a word or more.
WINDOW, WIDEST = 64, LEAST_MATCH // WORD
#: Rows up to which a table of repeated hashes is broadcast (some 80 bytes each in memory, so 160 MB); more are joined around hot keys.
BROADCAST_ROWS = 2_000_000


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, also where ``then`` uses it inside another lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _cut(text: Column) -> Column:
    """The lines of a text with their ends; an empty one may come last."""
    marked = text
    for e in ENDINGS:
        marked = F.replace(marked, F.lit(e), F.lit(e + MARK))
    for e in NOT_ENDINGS:
        marked = F.replace(marked, F.lit(e + MARK), F.lit(e))
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, LINE_END)).otherwise(F.split(marked, MARK))


def lines_of(text: Column) -> Column:
    """The lines of a text with their ends, so that together they are the text."""
    return F.filter(_cut(text), lambda line: line != "")


def _words(line: Column) -> Column:
    return F.length(F.trim(line)) - F.length(F.replace(F.trim(line), F.lit(" "), F.lit(""))) + 1


def _weight(line: Column) -> Column:
    return F.greatest(F.length(line), WORD * _words(line))


def _is_long(line: Column) -> Column:
    return (F.length(line) >= LONG_LINE) | (F.length(line) >= 2 * LONG_WORDS - 1) & (_words(line) >= LONG_WORDS)


def _joined(rows: DataFrame, repeated: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` (stored, or cheap) with the columns of ``repeated`` (one row a key, ``n`` of ``rows`` each)."""
    if repeated.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(repeated.drop("n")), on)
    return with_one(rows, repeated, on)


def repeated_lines(packed: DataFrame) -> DataFrame:
    """(id, th, pos, h, h2, weight, long) of the lines of ``packed`` (id, th, text) that occur more than once, bytes compared."""
    lines = packed.select("id", "th", F.posexplode(_cut(F.col("text"))).alias("pos", "line")).where("line <> ''").withColumn("h", F.xxhash64("line"))
    counted = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = _joined(lines, stored(counted, "repeated-lines"), ["h"])
    held = stored(held.select("id", "th", "pos", "h", F.xxhash64(F.lit(1), "line").alias("h2"), _weight(F.col("line")).alias("weight"), _is_long(F.col("line")).alias("long"), "line"), "held-lines")
    unlike = stored(held.groupBy("h", "h2").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low <> high").select("h", "h2"), "unlike-lines")
    held = held.drop("line")
    return held if unlike.isEmpty() else held.join(unlike.hint("merge"), ["h", "h2"], "left_anti")


def runs_of(held: DataFrame) -> DataFrame:
    """(id, th, lines): runs of neighbouring repeated lines, as arrays of (pos, h, h2, weight, long), that can hold a passage."""
    w = Window.partitionBy("id", "th").orderBy("pos")
    run = held.withColumn("run", F.col("pos") - F.dense_rank().over(w))  # equal rows have equal ranks
    runs = run.groupBy("id", "th", "run").agg(F.sort_array(F.collect_set(F.struct("pos", "h", "h2", "weight", "long"))).alias("lines"))
    return runs.where((F.size("lines") > 1) | F.get("lines", F.lit(0))["long"]).drop("run")


def _unit(lines: Column, first: Column, size: Column) -> Column:
    """(h, h2, first line of the text, number of lines) of lines from ``first`` on, counted within the run."""
    return _let(F.slice(lines, first + 1, size), lambda own: F.struct(F.xxhash64(F.transform(own, lambda x: x["h"])).alias("h"), F.xxhash64(F.transform(own, lambda x: x["h2"])).alias("h2"), F.get(own, F.lit(0))["pos"].alias("first"), F.size(own).alias("size")))


def _sum(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda n, x: n + x["weight"])


def chunks_of(lines: Column) -> Column:
    """Array of the content-defined chunks of a run that count as a passage."""
    last = F.size(lines) - 1
    rolling = lambda x, i: F.pmod(F.xxhash64(F.coalesce(F.get(lines, i - 1)["h"], F.lit(0).cast("long")), x["h"]), F.lit(ENDS_OF)) == 0
    ends_here = F.transform(lines, lambda x, i: F.when((i == last) | x["long"] | F.coalesce(F.get(lines, i + 1)["long"], F.lit(False)) | rolling(x, i), i))
    cut = lambda ends: F.transform(ends, lambda e, k: _let(F.coalesce(F.get(ends, k - 1) + 1, F.lit(0)), lambda first: F.struct(first.alias("first"), (e - first + 1).alias("size"))))
    counts = lambda c: _let(F.slice(lines, c["first"] + 1, c["size"]), lambda own: F.get(own, F.lit(0))["long"] | (F.size(own) > 1) & (_sum(own) >= LEAST_MATCH))
    return F.transform(F.filter(_let(F.array_compact(ends_here), cut), counts), lambda c: _unit(lines, c["first"], c["size"]))


def windows_of(lines: Column, covered: Column) -> Column:
    """Array of the windows of a run with a line that is not ``covered`` (line numbers): from each line on and up to each
    line, the fewest lines that count as a passage, and each long line alone."""

    def enough(sizes: Column) -> Column:
        """How many of the first lines count as a passage, null if even all are too little."""
        done = lambda a: (a["weight"] >= LEAST_MATCH) & (a["n"] >= 2)
        start = F.struct(F.lit(0).alias("weight"), F.lit(0).alias("n"))
        add = lambda a, x: F.when(done(a), a).otherwise(F.struct((a["weight"] + x).alias("weight"), (a["n"] + 1).alias("n")))
        return F.aggregate(sizes, start, add, lambda a: F.when(done(a), a["n"]))

    def code(first: Column, size: Column) -> Column:
        return first.cast("long") * WINDOW + size

    def codes(sizes: Column) -> Column:
        pair = lambda x, i: x + F.coalesce(F.get(sizes, i + 1), F.lit(-LEAST_MATCH - x)) >= LEAST_MATCH
        onward = lambda x, i: code(i, F.when(pair(x, i), F.lit(2)).otherwise(enough(F.slice(sizes, i + 1, F.lit(WIDEST)))))
        near = lambda i: F.least(i + 1, F.lit(WIDEST))
        back = lambda x, i: F.when((i > 0) & (F.get(sizes, F.greatest(i - 1, F.lit(0))) + x < LEAST_MATCH), _let(enough(F.reverse(F.slice(sizes, i - near(i) + 2, near(i)))), lambda n: code(i - n + 1, n)))
        alone = lambda x, i: F.when(F.get(lines, i)["long"], code(i, F.lit(1)))
        return F.array_distinct(F.array_compact(F.concat(*[F.transform(sizes, f) for f in (onward, back, alone)])))

    first, size = (lambda c: F.floor(c / WINDOW).cast("int")), (lambda c: F.pmod(c, F.lit(WINDOW)).cast("int"))
    unit = lambda c: _unit(lines, first(c), size(c))
    units = F.transform(_let(F.transform(lines, lambda x: x["weight"]), codes), unit)
    left = lambda u: F.size(F.array_except(F.sequence(u["first"], u["first"] + u["size"] - 1), covered)) > 0
    return F.when(F.size(covered) == 0, units).otherwise(F.filter(units, left))


def _later(units: DataFrame, name: str) -> DataFrame:
    """(id, th, first, size) of the units (id, th, u) that occur before, in the order of (id, th, first line)."""
    units = stored(units.select("id", "th", "u.*"), name)
    place = F.struct("id", "th", "first")
    counted = units.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("kept")).where("n > 1")
    return _joined(units, stored(counted, f"repeated-{name}"), ["h", "h2"]).where(place > F.col("kept")).select("id", "th", "first", "size")


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", removed: str = "removed_lines") -> DataFrame:
    """``docs`` with the repeated passages taken out of ``text``, and the lines that went as ``removed`` (array of line
    numbers, from 0), which replaces a column of that name.

    A null text stays null, an empty one empty, and both have no lines. Ids may be of any type that can be sorted; null ids
    come before all others. Rows that share an id count as different documents if their texts differ, in an order of
    their own, and as one if they are equal: what they have in common with themselves alone stays in all of them. Other
    columns are kept as they are. An empty table gives an empty one.
    """
    names = [c for c in docs.columns if c != removed]
    rest = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in names if c != text])
    packed = docs.select(rest.alias("row"), F.struct(F.col(f"`{id}`")).alias("id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    runs = stored(runs_of(repeated_lines(packed.select("id", "th", "text"))), "runs")

    chunks = stored(_later(runs.select("id", "th", F.explode(chunks_of(F.col("lines"))).alias("u")), "chunks"), "removed-chunks")
    numbers = F.array_distinct(F.flatten(F.collect_list(F.sequence("first", F.col("first") + F.col("size") - 1))))
    covered = chunks.groupBy("id", "th").agg(numbers.alias("covered"))  # a text's own lines
    beside = runs.join(covered.hint("merge"), ["id", "th"], "left").withColumn("covered", F.coalesce("covered", _none()))
    edges = _later(beside.select("id", "th", F.explode(windows_of(F.col("lines"), F.col("covered"))).alias("u")), "windows")

    gone = chunks.unionByName(edges).groupBy("id", "th").agg(F.array_sort(numbers).alias("gone"))
    joined = packed.join(gone.hint("merge"), ["id", "th"], "left")
    return _without(joined.select("row", "text", F.coalesce("gone", _none()).alias("gone")), names, text, removed)


def _none() -> Column:
    return F.array().cast("array<int>")


def _without(marked: DataFrame, names: list[str], text: str, removed: str) -> DataFrame:
    """Rows (row, text, gone) as they were, without those lines."""
    kept = lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i)), "")
    cleaned = F.when(F.size("gone") == 0, F.col("text")).otherwise(_let(lines_of(F.col("text")), kept))
    out = [cleaned.alias(c) if c == text else F.col("row")[c].alias(c) for c in names]
    return marked.select(*out, F.col("gone").alias(removed))


def query(spark, sf_dir: str) -> DataFrame:
    from mediasift.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").cast("long").alias("n_chars"))
    out = dedup(docs)
    return out.select("doc_id", "n_chars", F.length("text").cast("long").alias("n_kept"), F.size("removed_lines").cast("long").alias("n_removed"), F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"), F.sha2("text", 256).alias("kept_sha256"))
