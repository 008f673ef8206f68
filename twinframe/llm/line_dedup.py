"""Line dedup: a suffix array over line-ID sequences, by distributed prefix doubling.

Lines that hold a word are the symbols. A symbol's first rank is the place in sorted
order where its suffixes begin; only symbols that occur twice matter, as any other ends
a repeat. Doubling refines ranks: suffixes of one rank are ordered by the rank of what
follows 2**k lines on, so rank k + 1 is the start of the interval of suffixes that share
2**(k + 1) lines. Two overlapping ranks name the interval of any shared prefix of m lines.

A repeated run counts if it holds min_words words. For each line, the shortest run that
starts (and the shortest that ends) there with min_words words is looked up: its interval of
suffixes is the set of its copies. Every run with an earlier copy is the union of such
shortest runs with earlier copies: a line of it either starts one inside the run, or stands
within the one that ends where the run ends. So all lines of runs that have an earlier copy
are found, however long the runs are, with ranks for no more than min_words lines, which is
log2(min_words) rounds. Copies that come later, by doc_id and line, lose these lines.

Scale: DataFrame operations only. Rounds work on lines of runs that can still count.
Ranks are summed up over cells of the sorted order, and within cells of an interval's distinct pairs,
never over all rows in one task; a line that a third of all documents share is one row there,
and meets its lines in a join, which Spark may split. Classes are written out between rounds.

Defined cases: null texts stay null and empty texts empty; lines without a word are never
removed and don't interrupt a run; documents without doc_id come last in order; rows
with equal doc_id and text count as one document and give equal results; an empty table gives
an empty table; in `dedup` other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import OWN, stash

MIN_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"
#: Sorted order is cut into 2**CELL_BITS cells by the leading bits of a line's hash.
CELL_BITS = 12
#: What follows the suffixes of one rank is numbered in so many cells.
RANK_CELLS = 64
_KEY = ["d", "h"]


def _key() -> list[Column]:
    """A document's place in order, and what tells documents of one doc_id apart."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("d"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("h")]


def _lines(docs: DataFrame) -> DataFrame:
    """(d, h, i, pos, id, w): the lines with a word; i counts them, pos counts all lines."""
    every = F.transform(F.split(F.col("text").cast("string"), "\n", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    lines = docs.select(*_key(), F.posexplode(F.filter(every, lambda x: x["line"].rlike(_WORD))).alias("i", "l"))
    return lines.select("d", "h", "i", "l.pos", F.unhex(F.md5("l.line")).alias("id"), F.regexp_count("l.line", F.lit(_WORD)).alias("w"))


def _before(*by: str):
    return Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)


def _first_ranks(lines: DataFrame) -> DataFrame:
    """(id, r) of the lines that occur twice: r is where their suffixes begin in sorted order."""
    classes = lines.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    cell = F.shiftright(F.conv(F.hex(F.substring("id", 1, 2)), 16, 10).cast("int"), 16 - CELL_BITS)
    classes = stash(classes.withColumn("cell", cell), "line-classes")
    cells = classes.groupBy("cell").agg(F.sum("c").alias("n"))
    starts = cells.select("cell", F.coalesce(F.sum("n").over(_before().orderBy("cell")), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum("c").over(_before("cell").orderBy("id")), F.lit(0))
    return classes.withColumn("within", within).join(F.broadcast(starts), "cell").select("id", (F.col("start") + F.col("within")).alias("r"))  # 2**CELL_BITS rows


def _doubled(ranks: DataFrame, step: int, most: int) -> DataFrame:
    """Ranks of runs of 2 * step lines from those of step lines, which are `most` at most; runs that occur once go.

    A rank's pairs are numbered in cells of the second rank, and cells by their sums: a line that
    very many different lines follow isn't one task's work.
    """
    ahead = F.first("r").over(Window.partitionBy(*_KEY).orderBy("i").rangeBetween(step, step))
    pairs = ranks.withColumn("next", ahead).where("next IS NOT NULL")
    classes = pairs.groupBy("r", "next").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    classes = stash(classes.withColumn("cell", F.floor(F.col("next") * RANK_CELLS / (most + 1)).cast("int")), "line-pairs")
    starts = classes.groupBy("r", "cell").agg(F.sum("c").alias("n")).select("r", "cell", F.coalesce(F.sum("n").over(_before("r").orderBy("cell")), F.lit(0)).alias("start"))
    within = classes.withColumn("within", F.coalesce(F.sum("c").over(_before("r", "cell").orderBy("next")), F.lit(0)))
    placed = within.join(starts, ["r", "cell"]).select("r", "next", (F.col("r") + F.col("start") + F.col("within")).alias("to"))
    return pairs.join(placed, ["r", "next"]).select(*_KEY, "i", F.col("to").alias("r"))


def _shortest(words: Column, min_words: int) -> Column:
    """How many values it takes to reach min_words; null if there are too few."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("s"))
    got = F.aggregate(words, start, lambda a, x: F.when(a["s"] >= min_words, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"))), lambda a: F.when(a["s"] >= min_words, a["n"]))
    return got


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, h, pos, w) of every line that stands in a run of min_words words with an earlier copy."""
    lines = _lines(docs)
    ranks = stash(_first_ranks(lines), "line-ranks")
    known = lines.join(ranks, "id").select(*_KEY, "i", "pos", "w", "r")
    # runs of neighbouring lines that all occur elsewhere, and hold enough words
    order = Window.partitionBy(*_KEY).orderBy("i")
    runs = known.withColumn("run", F.col("i") - F.dense_rank().over(order))
    held = Window.partitionBy(*_KEY, "run")
    runs = runs.withColumn("held", F.sum("w").over(held)).where(F.col("held") >= min_words).drop("held")
    seen = Observation()
    runs = stash(runs.observe(seen, F.max("r").alias("most")), "line-runs")
    most = seen.get["most"] or 0

    along = Window.partitionBy(*_KEY, "run").orderBy("i")
    reach = min_words - 1
    ahead = F.transform(F.array_sort(F.collect_set(F.struct("i", "w")).over(along.rangeBetween(0, reach))), lambda x: x["w"])
    behind = F.reverse(F.transform(F.array_sort(F.collect_set(F.struct("i", "w")).over(along.rangeBetween(-reach, 0))), lambda x: x["w"]))
    sized = runs.select(*_KEY, "i", _shortest(ahead, min_words).alias("ahead"), _shortest(behind, min_words).alias("behind"))
    windows = sized.where("ahead IS NOT NULL").select(*_KEY, "i", F.col("ahead").alias("m")).union(sized.where("behind IS NOT NULL").select(*_KEY, (F.col("i") - F.col("behind") + 1).alias("i"), F.col("behind").alias("m"))).distinct()
    level = F.floor(F.log2("m")).cast("int")
    windows = stash(windows.withColumn("k", level), "line-windows")
    top = windows.agg(F.max("k")).first()[0]
    if top is None:
        return runs.select(*_KEY, "pos", "w").limit(0)

    rank, levels = runs.select(*_KEY, "i", "r"), []
    for k in range(top + 1):
        levels.append(rank.withColumn("k", F.lit(k)))
        if k < top:
            rank = stash(_doubled(rank, 2**k, most), "line-level")
    table = levels[0]
    for more in levels[1:]:
        table = table.union(more)
    table = table.distinct()
    # an interval of suffixes that share m lines: the rank of the first 2**k and of the last 2**k of them
    length = F.pow(F.lit(2), F.col("k")).cast("int")
    named = windows.withColumn("j", F.col("i") + F.col("m") - length).join(table.withColumnRenamed("r", "ra"), [*_KEY, "i", "k"])
    named = named.join(table.select(*_KEY, F.col("i").alias("j"), "k", F.col("r").alias("rb")), [*_KEY, "j", "k"]).select(*_KEY, "i", "m", "ra", "rb")
    named = stash(named, "line-intervals")
    place = F.struct("d", "h", "i")
    first = stash(named.groupBy("m", "ra", "rb").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "line-firsts")
    later = named.join(first, ["m", "ra", "rb"]).where(place > F.col("first"))
    gone = later.select(*_KEY, F.explode(F.sequence("i", F.col("i") + F.col("m") - 1)).alias("i")).distinct()
    return gone.join(runs.select(*_KEY, "i", "pos", "w").distinct(), [*_KEY, "i"]).select(*_KEY, "pos", "w")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated runs cut out of text, and `__tf_` columns n_lines, n_removed and removed_words."""
    gone = removed_lines(docs.select("doc_id", "text"), min_words)
    per_doc = gone.groupBy(*_KEY).agg(F.collect_set("pos").alias("pos"), F.sum("w").cast("long").alias("words"))
    per_doc = stash(per_doc.select(F.col("d").alias(f"{OWN}d"), F.col("h").alias(f"{OWN}h"), F.col("pos").alias(f"{OWN}pos"), F.col("words").alias(f"{OWN}words")), "line-removed")
    d, h = _key()
    # what was removed grows with the documents: a merge join at every size, never a broadcast
    rows = docs.withColumns({f"{OWN}d": d, f"{OWN}h": h}).join(per_doc.hint("merge"), [f"{OWN}d", f"{OWN}h"], "left")
    parts, pos = F.split(F.col("text").cast("string"), "\n", -1), F.col(f"{OWN}pos")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), pos)  # by hash: linear in the lines
    kept = F.transform(F.array(F.struct(parts.alias("parts"), left.alias("left"))), lambda s: F.array_join(F.transform(s["left"], lambda i: s["parts"][i]), "\n"))[0]
    count = F.coalesce(F.size(parts), F.lit(0))
    return rows.select(
        *(F.when(pos.isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.when(F.col("text").isNull(), 0).otherwise(count).cast("long").alias(f"{OWN}n_lines"),
        F.when(pos.isNull(), 0).otherwise(F.size(pos)).cast("long").alias(f"{OWN}n_removed"),
        F.coalesce(F.col(f"{OWN}words"), F.lit(0)).alias(f"{OWN}removed_words"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its lines, how many went, and the text that stays."""
    got = dedup(docs.select("doc_id", "text"))
    return got.select("doc_id", *(F.col(OWN + c).alias(c) for c in ("n_lines", "n_removed", "removed_words")), "text")


ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents
), every_line AS (
  SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line FROM split
), word_line AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
  FROM every_line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), summed AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM word_line
), spans AS (
  SELECT a.doc_id, a.i AS s, b.i AS e, b.upto - a.upto + a.w AS words
  FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49
  WHERE b.upto - a.upto + a.w >= 50
), shortest AS (
  SELECT doc_id, s, min(e) AS e FROM spans GROUP BY doc_id, s
  UNION
  SELECT doc_id, max(s), e FROM spans GROUP BY doc_id, e
), named AS (
  SELECT x.doc_id, x.s, x.e, string_agg(l.line, chr(10) ORDER BY l.i) AS content
  FROM shortest x JOIN word_line l ON l.doc_id = x.doc_id AND l.i BETWEEN x.s AND x.e
  GROUP BY x.doc_id, x.s, x.e
), later AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS copy FROM named
), gone AS (
  SELECT DISTINCT l.doc_id, l.pos, l.w FROM later x JOIN word_line l ON l.doc_id = x.doc_id AND l.i BETWEEN x.s AND x.e
  WHERE x.copy > 1
)
SELECT e.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, CAST(coalesce(sum(g.w), 0) AS BIGINT) AS removed_words,
       coalesce(string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (WHERE g.pos IS NULL), '') AS text
FROM every_line e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos
GROUP BY e.doc_id
"""
