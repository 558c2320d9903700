"""Line dedup by winnowing over line hashes.

The unit is the line that is not blank, by the words on it (lower-cased, single spaces). What is deleted is exactly this: every run of consecutive lines that also starts earlier in the corpus (smaller document, then line) and has RUN lines or LONG words, whichever it reaches first.

Fingerprints of a document are hashes of GRAM consecutive lines; of every WINDOW consecutive ones the least is selected, the rightmost if several are, so that any RUN = GRAM + WINDOW - 1 lines that two places share have a fingerprint selected in both. Of fingerprints that occur more than once, the RUN lines of their windows go on by the hashes of all of them, as do single lines and pairs of lines with LONG words or more. Each of these is joined with its own first place in the corpus, so that a longer match with a later place isn't missed for a shorter one with the first; from there the match is extended both ways along the two documents for as long as lines agree in two 64-bit hashes, and the run is deleted in the later place.

First places come from groupings with partial aggregation, so a line that millions of documents share costs each task one row. All of it is column expressions, joins and groupings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, delete, numbered, shared_dir, table, written

GRAM, WINDOW, LONG = 2, 2, 50
RUN = GRAM + WINDOW - 1


def lined(docs: DataFrame, text: str) -> DataFrame:
    """(doc, at: numbers from 0 of the lines not blank, two hashes and the words of each). Lambdas use nothing but their own line, so a text is gone through once."""
    d = docs.select(F.col("__doc").alias("doc"), F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1).alias("lines"))
    words = F.transform("lines", lambda x: F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)))
    entries = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), F.xxhash64(w).alias("h"), F.xxhash64(F.lit(1), w).alias("c"), F.size(w).alias("n"))), lambda e: e["n"] > 0)
    return d.select("doc", entries.alias("e")).select("doc", F.col("e.at").alias("at"), F.col("e.h").alias("hashes"), F.col("e.c").alias("checks"), F.col("e.n").alias("words"))


def grams() -> Column:
    """Hashes of GRAM consecutive lines of a document."""
    n = F.size("hashes")
    return F.when(n >= GRAM, F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*(F.get("hashes", i + j) for j in range(GRAM))))).otherwise(F.array().cast("array<bigint>"))


def run_of(at: Column, n: int) -> Column:
    """n lines from at on, by two hashes of all of them; n is part of the second."""
    return F.struct(F.xxhash64(*(F.get("hashes", at + j) for j in range(n))).alias("a"), F.xxhash64(F.lit(n), *(F.get("checks", at + j) for j in range(n))).alias("b"), at.cast("int").alias("at"), F.lit(n).alias("n"))


RUNS = "array<struct<a:bigint,b:bigint,at:int,n:int>>"


def selected(d: DataFrame) -> DataFrame:
    """(doc, h, p, a, b, at, n): of every window the least gram, the rightmost if several are, with its place p, and the run of RUN lines that the window spans."""
    d = d.withColumn("grams", grams())
    starts = F.when(F.size("grams") >= WINDOW, F.sequence(F.lit(0), F.size("grams") - WINDOW)).otherwise(F.array().cast("array<int>"))

    def window(s: Column) -> Column:
        held = [F.get("grams", s + j) for j in range(WINDOW)]
        least = F.least(*held) if WINDOW > 1 else held[0]
        place = reduce(lambda x, j: x.when(held[j] == least, s + j), range(WINDOW - 2, -1, -1), F.when(held[-1] == least, s + WINDOW - 1))
        return F.struct(least.alias("h"), place.cast("int").alias("p"), run_of(s, RUN).alias("run"))

    return d.select("doc", F.explode(F.transform(starts, window)).alias("x")).select("doc", "x.h", "x.p", "x.run.*")


def long_runs(d: DataFrame) -> DataFrame:
    """(doc, a, b, at, n): lines of LONG words or more, and fewer than RUN consecutive lines with as many in all."""
    def each(n: int) -> Column:
        enough = lambda i: sum((F.get("words", i + j) for j in range(1, n)), F.get("words", i)) >= LONG
        starts = F.when(F.size("hashes") >= n, F.sequence(F.lit(0), F.size("hashes") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(starts, enough), lambda i: run_of(i, n)).cast(RUNS)

    return d.select("doc", F.inline(F.concat(*(each(n) for n in range(1, RUN)))))


def repeated_runs(docs: DataFrame, text: str, base: str) -> DataFrame:
    """(doc, source, shift, lo, hi): runs of lines (numbers among those not blank) of docs (__doc, text) that also stand shift lines before in source, extended both ways; at: numbers of the lines in the text."""
    d = written(lined(docs.where("__doc IS NOT NULL"), text).where("size(hashes) > 0"), f"{base}/lines")
    prints = written(selected(d), f"{base}/prints")
    place = F.struct("doc", "p")
    again = prints.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h")
    three = prints.join(again, "h").select("doc", "a", "b", "at", "n")
    entries = written(three.unionByName(long_runs(d)), f"{base}/entries")
    first = entries.groupBy("a", "b").agg(F.min(F.struct("doc", "at")).alias("f"), F.count("*").alias("c")).where("c > 1").select("a", "b", F.col("f.doc").alias("source"), F.col("f.at").alias("from"))
    later = entries.join(first, ["a", "b"]).where("doc != source OR at != from")
    # matches along one diagonal of two documents are extended together
    diagonals = later.groupBy("doc", "source", (F.col("at") - F.col("from")).alias("shift")).agg(F.collect_set(F.struct("at", "n")).alias("seeds"))
    other = d.select(F.col("doc").alias("source"), F.col("hashes").alias("their_hashes"), F.col("checks").alias("their_checks"))
    pairs = written(diagonals.join(other, "source").join(d.select("doc", "hashes", "checks", "at"), "doc"), f"{base}/pairs")
    low, high = F.greatest(F.lit(0), F.col("shift")), F.least(F.size("hashes"), F.size("their_hashes") + F.col("shift")) - 1
    same = lambda i: (F.get("hashes", i) == F.get("their_hashes", i - F.col("shift"))) & (F.get("checks", i) == F.get("their_checks", i - F.col("shift")))
    breaks = F.concat(F.array(low - 1), F.filter(F.sequence(low, high), lambda i: ~same(i)), F.array(high + 1))
    runs = pairs.withColumn("breaks", breaks)
    # runs of equal lines between two breaks, those that hold a seed
    spans = runs.select("doc", "source", "shift", "at", "seeds", F.explode(F.transform(F.sequence(F.lit(0), F.size("breaks") - 2), lambda k: F.struct((F.get("breaks", k) + 1).alias("lo"), (F.get("breaks", k + 1) - 1).alias("hi")))).alias("s"))
    spans = spans.where("s.lo <= s.hi").where(F.exists("seeds", lambda x: (x["at"] >= F.col("s.lo")) & (x["at"] + x["n"] - 1 <= F.col("s.hi"))))
    return spans.select("doc", "source", "shift", "s.lo", "s.hi", "at")


def repeated_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, gone: sorted numbers from 0 of lines to delete) for the documents of docs (__doc, text) that have any."""
    base = shared_dir(docs.sparkSession)
    spans = repeated_runs(docs, text, base)
    lines = spans.select("doc", F.explode(F.slice("at", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1)).alias("line")).distinct()
    out = written(lines.groupBy("doc").agg(F.array_sort(F.collect_list("line")).alias("gone")), f"{base}/gone")
    delete(docs.sparkSession, *(f"{base}/{x}" for x in ("lines", "prints", "entries", "pairs")))
    return out


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text rid of repeated runs of lines, and n_lines, n_removed.

    Null texts stay null and count as one blank line; blank lines are never matched or deleted. Rows equal in key and text are one document, each with its whole result; rows of one key with different texts are documents in the order of hashes of their texts. Rows with a null key stay as they are and are no source of repeats. A document's lines are compared in one row, as hashes, however long its text. An empty table gives an empty one. Columns named n_lines or n_removed are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    d = numbered(docs.select(*names), key, text, f"{shared_dir(docs.sparkSession)}/numbers")
    gone = repeated_lines(d.select("__doc", text), text).withColumnRenamed("doc", "__doc")
    # at every size texts meet what is to be deleted by a shuffle: the table of deleted lines grows with the corpus
    none = d.where("__doc IS NULL").withColumn("gone", F.lit(None).cast("array<int>"))
    d = d.where("__doc IS NOT NULL").join(gone.hint("merge"), "__doc", "left").unionByName(none)
    d = d.withColumn("__lines", F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)).withColumn("__map", F.map_from_arrays(F.coalesce("gone", F.array().cast("array<int>")), F.coalesce("gone", F.array().cast("array<int>"))))
    rest = F.filter("__lines", lambda x, i: ~F.map_contains_key("__map", i))
    kept = F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(rest, "\n"))
    return d.select(*(kept.alias(c) if c == text else F.col(c) for c in names), F.size("__lines").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated runs of lines."""
    found = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS t, unnest(range(len(l))) AS line FROM d),
n AS (SELECT doc_id, line, regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+') AS w FROM e),
s AS (SELECT doc_id, line, array_to_string(w, ' ') AS t, len(w) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos FROM n WHERE len(w) > 0),
r AS (SELECT a.doc_id, a.pos, 1 AS len, a.t AS t FROM s AS a WHERE a.n >= 50
  UNION ALL SELECT a.doc_id, a.pos, 2, a.t || chr(10) || b.t FROM s AS a JOIN s AS b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.n + b.n >= 50
  UNION ALL SELECT a.doc_id, a.pos, 3, a.t || chr(10) || b.t || chr(10) || c.t FROM s AS a JOIN s AS b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN s AS c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2),
o AS (SELECT doc_id, pos, len, row_number() OVER (PARTITION BY len, t ORDER BY doc_id, pos) AS nth FROM r),
g AS (SELECT DISTINCT s.doc_id, s.line FROM o JOIN s ON s.doc_id = o.doc_id AND s.pos BETWEEN o.pos AND o.pos + o.len - 1 WHERE o.nth > 1),
k AS (SELECT e.doc_id, count(*) AS n_lines, count(g.line) AS n_removed, coalesce(string_agg(e.t, chr(10) ORDER BY e.line) FILTER (WHERE g.line IS NULL), '') AS kept FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.line = e.line GROUP BY e.doc_id)
SELECT doc_id, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_removed AS INTEGER) AS n_removed, sha256(kept) AS kept_sha256 FROM k
"""
