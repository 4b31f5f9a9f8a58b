"""Line dedup by a deletion-neighbourhood join; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemove.llm.common import join_small, materialise

#: Lines of fewer code points without outer blanks ("Yes.", a brace) have no near copies, and equal ones go only if asked for.
SHORTEST = 16
#: Width of the stretches that the second sieve deletes at once.
CELL = 16


def _lines(docs: DataFrame, id_col: str, text: str, shortest: int, short_exact: bool = False) -> DataFrame:
    """Lines that count: id, text hash, number, line, whether it is long, and two 64-bit hashes that together name the line."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(whole).alias("of"), F.posexplode(F.split(whole, "\n")).alias("line_no", "line"))
    rows = rows.withColumn("long", F.char_length(F.trim("line")) >= shortest)
    rows = rows.where(F.col("long") | F.col("line").rlike(r"(?U)\S")) if short_exact else rows.where("long")
    return rows.withColumn("a", F.xxhash64("line")).withColumn("b", F.xxhash64(F.lit(1), "line"))


def _part(kind: str, *sizes: Column, left: Column, right: Column) -> Column:
    """Hash of a line's first ``left`` and last ``right`` code points."""
    head = F.substring(F.col("line"), F.lit(1), left)
    tail = F.substring(F.col("line"), F.col("n") - right + 1, right)
    return F.xxhash64(F.lit(kind), *sizes, head, tail)


def _halves() -> Column:
    """Three keys of which two lines within one edit share at least one.

    One edit leaves the first or the last half as it is. Of a line of n, the
    first floor(n/2) and the last ceil(n/2) code points are keys, and that half of n - 1 which is
    not among them, for a partner that is shorter by one.
    """
    n, low = F.col("n"), F.floor(F.col("n") / 2).cast("int")
    none = F.lit(0)
    first = _part("p", low, left=low, right=none)
    last = _part("s", n - low, left=none, right=n - low)
    third = F.when(n % 2 == 0, _part("p", low - 1, left=low - 1, right=none)).otherwise(_part("s", low, left=none, right=low))
    return F.array(first, last, third)


def near_lines(spark: SparkSession, docs: DataFrame, firsts: DataFrame, *, id_col: str, text: str, shortest: int) -> DataFrame:
    """(a, b) of the distinct lines that are one edit away from a line that first occurs earlier.

    Sieve 1: lines that share a half (see :func:`_halves`) with another line.
    Sieve 2: deleting a whole cell of ``CELL`` code points leaves the same rest as for
    another line. Both only remove lines that can have no partner. What is left, mostly lines
    that have one, emits its deletion neighbourhood within the cells that remain: for a substitution, the line
    without code point i, keyed by i and length, so that all lines of a key are one substitution apart; for
    an insertion, the longer line without a code point, which meets the whole shorter line. Of
    a key only its earliest lines are compared with the others: no pairs are listed, and minima
    combine map-side. Every candidate's edit distance is then verified.
    """
    keys = firsts.select("a", "b", F.explode("halves").alias("key"))
    shared = keys.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("key")
    shared = materialise(spark, shared, "line-halves")
    some = join_small(keys, shared, ["key"], "left_semi").select("a", "b").distinct()
    some = materialise(spark, some.join(firsts.select("a", "b", "first"), ["a", "b"]), "line-sieved")
    texts = join_small(_lines(docs, id_col, text, shortest), some, ["a", "b"], "inner")
    texts = texts.where(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("line_no") == F.col("first.line_no")))
    texts = texts.select("a", "b", "first", "line", F.char_length("line").alias("n")).dropDuplicates(["a", "b"])
    texts = materialise(spark, texts, "line-texts")

    def cells(kind: str, size: Column, role: int) -> DataFrame:
        rows = texts.select("a", "b", "line", "n", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(size - (0 if kind == "I" else 1), F.lit(0)) / CELL).cast("int"))).alias("cell"))
        left, right = F.col("cell") * CELL, F.greatest(size - (F.col("cell") + 1) * CELL, F.lit(0))
        return rows.select("a", "b", "cell", F.lit(role).alias("role"), _part(kind, size, F.col("cell"), left=left, right=right).alias("key"))

    n = F.col("n")
    emitted = cells("S", n, 2).unionByName(cells("I", n, 0)).unionByName(cells("I", n - 1, 1))
    emitted = materialise(spark, emitted, "line-cells")
    meet = emitted.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("key")
    left = join_small(emitted, materialise(spark, meet, "line-cell-keys"), ["key"], "left_semi").select("a", "b", "cell", "role").distinct()
    left = left.join(texts, ["a", "b"])

    at = F.explode(F.sequence(F.col("cell") * CELL + 1, F.least((F.col("cell") + 1) * CELL, n))).alias("at")
    order = F.struct("first", "a", "b").alias("own")
    cut = left.where("role > 0").where(F.col("cell") * CELL < n).select("a", "b", "first", "line", "n", "role", at)
    head, tail = F.substring(F.col("line"), F.lit(1), F.col("at") - 1), F.substring(F.col("line"), F.col("at") + 1, n)
    subst = F.xxhash64(F.lit("S"), "n", "at", head, tail)
    insert = F.xxhash64(F.lit("I"), F.concat(head, tail))
    deleted = cut.select("a", "b", order, "role", F.when(F.col("role") == 2, subst).otherwise(insert).alias("key"))
    whole = left.where("role = 0").select("a", "b", order, "role", F.xxhash64(F.lit("I"), "line").alias("key"))
    variants = materialise(spark, deleted.unionByName(whole).distinct(), "line-variants")
    first = [F.min(F.when(F.col("role") == r, F.col("own"))).alias(f"r{r}") for r in range(3)]
    earliest = materialise(spark, variants.groupBy("key").agg(*first), "line-earliest")
    partner = F.when(F.col("role") == 2, F.col("r2")).when(F.col("role") == 1, F.col("r0")).otherwise(F.col("r1"))
    met = variants.join(earliest, "key").withColumn("partner", partner).where("partner.first < own.first")
    met = met.select("a", "b", F.col("partner.a").alias("pa"), F.col("partner.b").alias("pb")).distinct()
    other = texts.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("line").alias("earlier"))
    met = met.join(texts.select("a", "b", "line"), ["a", "b"]).join(other, ["pa", "pb"])
    return materialise(spark, met.where(F.levenshtein("line", "earlier", 1) >= 0).select("a", "b").distinct(), "line-near")


def dropped_lines(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", max_edits: int = 1, shortest: int = SHORTEST, short_exact: bool = False) -> DataFrame:
    """(id, of, dropped): numbers of the lines that go, from 0, per document that loses any; ``of`` is the text's XXH64."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1: a deletion neighbourhood of two edits grows with the square of the line")
    rows = _lines(docs, id_col, text, shortest, short_exact)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "line_no")
    none = F.array().cast("array<bigint>")
    halves = rows.withColumn("n", F.char_length("line")).withColumn("halves", F.when(F.col("long"), _halves()).otherwise(none) if max_edits else none)
    firsts = halves.groupBy("a", "b", "halves").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
    firsts = materialise(spark, firsts, "line-firsts")
    again = firsts.where("times > 1").select("a", "b", "first", F.lit(False).alias("near"))
    if max_edits:
        near = near_lines(spark, docs, firsts, id_col=id_col, text=text, shortest=shortest)
        hit = join_small(firsts.select("a", "b", "first"), near, ["a", "b"], "left_semi").withColumn("near", F.lit(True))
        again = join_small(again, near, ["a", "b"], "left_anti").unionByName(hit)
    again = materialise(spark, again, "line-again")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("line_no") == F.col("first.line_no"))
    gone = rows.select("id", "of", "line_no", "a", "b").join(again, ["a", "b"]).where(F.col("near") | ~same).select("id", "of", "line_no")
    return materialise(spark, gone.groupBy("id", "of").agg(F.array_sort(F.collect_set("line_no")).alias("dropped")), "line-dropped")


def dedup_lines(
    spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", max_edits: int = 1, shortest: int = SHORTEST, short_exact: bool = False
) -> DataFrame:
    """``docs`` with repeated lines taken out of the texts, and ``n_lines``, ``n_dropped``.

    Over the whole corpus, a line is dropped if an equal line occurs earlier (by id, then line
    number; null ids last), or if its text is within ``max_edits`` (0 or 1: one code point
    inserted, deleted or replaced) of a line whose first occurrence is earlier. Lines of fewer than ``shortest`` code points without outer blanks
    have no near copies, and equal ones of them go only with ``short_exact``; without it they stay. Lines of white space
    only always stay. Lines end at line feeds; the others are joined again by them.

    A text that loses nothing comes back as it was, a null text as null (0
    lines). A text all of whose lines go becomes empty; its row stays. Repeated
    rows (id and text equal) are one document and come back alike. Rows of one
    id with different texts are ordered by line number only, and a tie keeps both. Input columns named ``n_lines`` or
    ``n_dropped`` are replaced, all others stay. An empty table gives no rows.
    """
    gone = dropped_lines(spark, docs, id_col=id_col, text=text, max_edits=max_edits, shortest=shortest, short_exact=short_exact)
    gone = gone.select(F.col("id").alias("_id"), F.col("of").alias("_of"), F.col("dropped").alias("_dropped"))
    rows = docs.drop("n_lines", "n_dropped").withColumn("_lines", F.split(F.col(text).cast("string"), "\n"))
    same = rows[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(F.coalesce(rows[text].cast("string"), F.lit(""))) == gone["_of"])
    rows = rows.join(gone, same, "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_dropped"))
    kept = F.array_join(F.transform(stays, lambda i: F.get(F.col("_lines"), i)), "\n")
    rows = rows.withColumn(text, F.when(F.col("_dropped").isNull(), F.col(text)).otherwise(kept))
    for name, of in (("n_lines", "_lines"), ("n_dropped", "_dropped")):
        rows = rows.withColumn(name, F.coalesce(F.greatest(F.size(of), F.lit(0)), F.lit(0)))
    return rows.drop("_lines", "_dropped", "_id", "_of")


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
f AS (
  SELECT line, length(line) AS n, length(trim(line, ' ')) >= 16 AS long, min({'d': doc_id, 'i': line_no}) AS first FROM l
  WHERE regexp_matches(line, '[^\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]') GROUP BY line),
g AS (SELECT * FROM f WHERE long),
near AS (
  SELECT DISTINCT x.line FROM g x JOIN g y ON y.n = x.n WHERE y.first < x.first AND levenshtein(x.line, y.line) <= 1
  UNION SELECT DISTINCT x.line FROM g x JOIN g y ON y.n = x.n + 1 WHERE y.first < x.first AND levenshtein(x.line, y.line) <= 1
  UNION SELECT DISTINCT x.line FROM g x JOIN g y ON y.n + 1 = x.n WHERE y.first < x.first AND levenshtein(x.line, y.line) <= 1),
marked AS (
  SELECT l.doc_id, l.line_no, l.line,
    coalesce(near.line IS NOT NULL OR f.first <> {'d': l.doc_id, 'i': l.line_no}, false) AS gone
  FROM l LEFT JOIN f ON l.line = f.line LEFT JOIN near ON l.line = near.line)
SELECT doc_id, count(*)::INTEGER AS n_lines, count(*) FILTER (WHERE gone)::INTEGER AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""
