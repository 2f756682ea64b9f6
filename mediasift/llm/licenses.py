"""License scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance along paths.

1. Units (lines, or sentences of long lines) with a licence cue are cut from every whole text, as term counts. A licence
   file gives two more: its header (the first two lines, as titles run over two) and its whole.
2. Terms are weighted by inverse document frequency over all units and templates; the cosine of a unit to every template
   is a sum over the terms that they share. A file has the licence of its best unit, if the cosine is high enough.
3. A file without a licence of its own has that of the licence file in the nearest ancestor directory: directories are
   resolved first (each once, however many files it holds), then files are joined to their directory.

DataFrame operators alone. The templates are a fixed table of a few rows, and so broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.operators.joins import with_one
from mediasift.sources.shared import stored

#: Licence names and the sentences that announce them, and the full texts of short licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    (
        "MIT",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
#: Words without which no unit of a known corpus came near a template (see the tests); a unit without any is not looked at.
CUE = "[Ll][Ii][Cc][Ee][Nn][SsCc][Ee]|[Pp]ublic domain|[Pp]ermission|[Rr]edistribution|[Cc]opyright|COPYRIGHT|(?:AS|as) (?:IS|is)\\b|CC BY"
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)?"
UNIT_END = "\n|[.;!?] "
#: A text of no more words, with a cue, is a licence file in the registered query.
SHORT_WORDS = 60
LEAST = 0.6
#: Directories up to which their licences are broadcast.
BROADCAST_ROWS = 500_000


def _counts(units: DataFrame, keys: list[str], text: str) -> DataFrame:
    terms = F.explode(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))
    return units.select(*keys, terms.alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def cosines(units: DataFrame, key: str = "unit", text: str = "text") -> DataFrame:
    """(key, template, cosine) of every unit and every template that it shares a term with."""
    spark = units.sparkSession
    named = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(TEMPLATES)], "template int, text string")
    mine = stored(_counts(units.select(F.col(key).alias("unit"), F.col(text).alias("text")), ["unit"], "text"), "terms")
    theirs = stored(_counts(named, ["template"], "text"), "template-terms")
    count = mine.select("unit").distinct().count() + len(TEMPLATES)
    frequency = mine.select("term").union(theirs.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = stored(frequency.select("term", (F.log(F.lit(1.0 + count) / (1.0 + F.col("df"))) + 1.0).alias("idf"), F.col("df").alias("n")), "terms-of-all")
    weigh = lambda rows: with_one(rows, idf, ["term"]).withColumn("w", F.col("tf") * F.col("idf"))
    mine = stored(weigh(mine), "weights")
    theirs = weigh(theirs)
    size = mine.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    template_size = theirs.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("template_size"))
    table = stored(theirs.join(template_size.hint("merge"), "template").select("term", "template", F.col("w").alias("tw"), "template_size"), "templates")
    dots = mine.join(F.broadcast(table), "term").groupBy("unit", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"), F.first("template_size").alias("template_size"))
    return dots.join(size.hint("merge"), "unit").select(F.col("unit").alias(key), "template", (F.col("dot") / (F.col("size") * F.col("template_size"))).alias("cosine"))


def _directory(path: Column) -> Column:
    """Everything before the last slash."""
    return F.regexp_replace(path, "/[^/]*$", "")


def scan(files: DataFrame, path: str = "path", text: str = "text", licence_file: Column | None = None, least: float = LEAST) -> DataFrame:
    """(path, own, score, inherited, license) for every row.

    ``own``: licence of the best unit with a cosine of ``least`` or more (null if none); ``score``: that cosine, rounded
    to six places; ties go to the first template. ``inherited``: of the nearest ancestor directory with a licence file;
    if a directory has several the best match counts, then the last name. ``license``: own, or else inherited.
    ``licence_file`` says which rows are licence files (default: base names LICENSE, COPYING and NOTICE).

    Null texts are empty and have no licence of their own; a null path has no ancestors. Rows that repeat a path share
    what is found in any of them. Other columns are not touched; an empty table gives an empty one.
    """
    licence_file = F.lit(False) if licence_file is None else licence_file
    base = F.regexp_extract(F.col(path), "[^/]*$", 0)
    rows = files.select(F.col(path).alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), (base.rlike("^(?:LICEN[SC]E|COPYING|NOTICE)") | licence_file).alias("is_file"))
    cued = rows.where(F.col("text").rlike(CUE))
    whole = F.coalesce(F.col("is_file"), F.lit(False))
    cut = F.filter(F.split("text", UNIT_END), lambda u: u.rlike(CUE))
    title = F.array_join(F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1, 2), " ")
    header = F.filter(F.array(title), lambda u: u.rlike(CUE))
    units = cued.select("path", whole.alias("is_file"), F.posexplode(F.when(whole, F.concat(F.array("text"), header, cut)).otherwise(cut)).alias("n", "text"))
    units = stored(units.select(F.struct("path", "n", F.xxhash64("text").alias("h")).alias("unit"), "path", "is_file", "text"), "units")
    best = F.max(F.struct("cosine", (-F.col("template")).alias("t")))
    found = cosines(units.select("unit", "text").dropDuplicates(["unit"])).withColumn("cosine", F.round("cosine", 6))
    is_file = units.select("unit", "is_file").dropDuplicates(["unit"])
    of_file = found.join(is_file.hint("merge"), "unit").groupBy("unit.path").agg(best.alias("b"), F.max("is_file").alias("is_file")).where(F.col("b.cosine") >= least)
    names = F.array(*[F.lit(n) for n, _ in TEMPLATES])
    own = stored(of_file.select("path", F.element_at(names, (1 - F.col("b.t")).cast("int")).alias("own"), F.col("b.cosine").alias("score"), "is_file"), "own")

    of_directory = own.where("is_file and path is not null").groupBy(_directory(F.col("path")).alias("ancestor")).agg(F.max_by("own", F.struct("score", F.col("own"))).alias("inherited"))
    directories = rows.where("path is not null").select(_directory(F.col("path")).alias("directory")).distinct()
    parts = F.split("directory", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("ancestor")))
    above = directories.select("directory", F.explode(ancestors).alias("a")).select("directory", "a.depth", "a.ancestor")
    below = above.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"))
    holders = stored(of_directory.join(below.hint("merge"), "ancestor"), "licence-directories")
    resolved = stored(with_one(stored(above, "ancestors"), holders, ["ancestor"]).groupBy("directory").agg(F.max_by("inherited", "depth").alias("inherited")), "directories")

    left = rows.select("path", _directory(F.col("path")).alias("directory"))
    out = left.join(own.select("path", "own", "score").hint("merge"), "path", "left")
    few = resolved.count() <= BROADCAST_ROWS  # a directory may hold very many files; beyond that Spark splits such partitions
    out = out.join(F.broadcast(resolved) if few else resolved.hint("merge"), "directory", "left")
    return out.select(F.col("path").alias(path), "own", "score", "inherited", F.coalesce("own", "inherited").alias("license"))


def query(spark, sf_dir: str) -> DataFrame:
    """Licences of the documents, each a file in the directory of its thousand ids, language and source, some in one of the
    directories above; texts of a few words are taken as licence files."""
    from mediasift.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    shelf = F.floor(F.col("doc_id") / 1000).cast("string")
    above = F.when(F.col("doc_id") % 50 == 0, F.array("source")).when(F.col("doc_id") % 10 == 1, F.array("source", "lang")).otherwise(F.array(F.col("source"), F.col("lang"), shelf))
    files = docs.select(F.concat_ws("/", F.lit(""), above, F.col("doc_id").cast("string")).alias("path"), "text")
    found = scan(files, licence_file=F.size(F.split(F.trim("text"), "[ \n]+")) <= SHORT_WORDS)
    return found.select(F.regexp_extract("path", "[^/]*$", 0).cast("long").alias("doc_id"), "path", "own", "score", "inherited", "license")


def sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quoted(n)}, {quoted(t)})" for k, (n, t) in enumerate(TEMPLATES))
    return rf"""
WITH t AS (SELECT * FROM (VALUES {values}) AS v(template, name, text)),
f AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '/' || source WHEN doc_id % 10 = 1 THEN '/' || source || '/' || lang ELSE '/' || source || '/' || lang || '/' || CAST(floor(doc_id / 1000.0) AS BIGINT) END AS dir, coalesce(text, '') AS text,
  len(string_split_regex(trim(coalesce(text, ''), ' '), '[ \n]+')) <= {SHORT_WORDS} AS is_file FROM documents),
u AS (SELECT doc_id, dir, is_file, n, parts[n] AS unit
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT * REPLACE (CASE WHEN is_file THEN list_prepend(text, list_prepend(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:2], ' '), parts)) ELSE parts END AS parts) FROM (SELECT *, string_split_regex(text, {quoted(UNIT_END)}) AS parts FROM f WHERE regexp_matches(text, {quoted(CUE)}))))
  WHERE regexp_matches(parts[n], {quoted(CUE)})),
mine AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(regexp_extract_all(lower(unit), {quoted(TERM)})) AS term FROM u) GROUP BY ALL),
theirs AS (SELECT template, term, count(*) AS tf FROM (SELECT template, unnest(regexp_extract_all(lower(text), {quoted(TERM)})) AS term FROM t) GROUP BY ALL),
total AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id, n FROM mine)) + {len(TEMPLATES)} AS n),
idf AS (SELECT term, ln((1.0 + (SELECT n FROM total)) / (1.0 + count(*))) + 1.0 AS idf FROM (SELECT term FROM mine UNION ALL SELECT term FROM theirs) GROUP BY term),
mw AS (SELECT doc_id, n, term, tf * idf AS w FROM mine JOIN idf USING (term)),
tw AS (SELECT template, term, tf * idf AS w FROM theirs JOIN idf USING (term)),
ms AS (SELECT doc_id, n, sqrt(sum(w * w)) AS s FROM mw GROUP BY ALL), ts AS (SELECT template, sqrt(sum(w * w)) AS s FROM tw GROUP BY ALL),
c AS (SELECT doc_id, template, round(dot / (ms.s * ts.s), 6) AS cosine FROM (SELECT doc_id, n, template, sum(mw.w * tw.w) AS dot FROM mw JOIN tw USING (term) GROUP BY ALL) JOIN ms USING (doc_id, n) JOIN ts USING (template)),
own AS (SELECT doc_id, name AS own, cosine AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, template) AS k FROM c) JOIN t USING (template) WHERE k = 1 AND cosine >= {LEAST}),
lic AS (SELECT dir AS ancestor, own AS inherited FROM (SELECT dir, own, row_number() OVER (PARTITION BY dir ORDER BY score DESC, own DESC) AS k FROM own JOIN f USING (doc_id) WHERE is_file) WHERE k = 1),
up AS (SELECT dir, k, array_to_string(string_split(dir, '/')[1:k], '/') AS ancestor FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS k FROM (SELECT DISTINCT dir FROM f))),
res AS (SELECT dir, arg_max(inherited, k) AS inherited FROM up JOIN lic USING (ancestor) GROUP BY dir)
SELECT doc_id, dir || '/' || doc_id AS path, own, score, inherited, coalesce(own, inherited) AS license
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN res USING (dir)"""
