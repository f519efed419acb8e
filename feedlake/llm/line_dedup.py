"""Line dedup: a suffix array over line ids by prefix doubling, with DataFrame functions only.

Each document is a sequence of its non-blank lines. ``rank`` of a position at level k is
where the suffixes that begin there start in the suffix array sorted by 2^k lines: all
suffixes that share 2^k lines have one rank, which is an interval of the array whose
longest common prefix is at least 2^k lines. A level comes from the one below by sorting
the pairs (rank here, rank 2^k lines on). A line or block that occurs once has no rank and
leaves the work. A block of any length is named by the ranks of the two blocks of 2^k lines
that cover it, so each maximal repeated run is known from its shortest blocks of
``min_chars`` characters, forward from each start and backward from each end.

A line is removed if it lies in a run of at least ``min_chars`` characters (line breaks not
counted) that also starts earlier: in a smaller doc_id, or earlier in the same document.
The first copy of a run stays. Runs are judged on the input, not on what is left. Blank
lines inside a removed run go with it.

A hot line costs no task more than its share: ranks and first positions are aggregates with
partial results, prefix sums run over distinct pairs cut into chunks, and the rows meet
them in equi-joins that adaptive execution may split.

Defined cases: a null text is empty and stays null; a null doc_id sorts first; documents with
one doc_id are ordered by the hash of their text; repeated rows are one document and are
treated alike; other columns are kept as they are; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from feedlake.llm.common import doc_key, documents, staged, whole_text

MIN_CHARS = 40
LINE = ["id", "check", "chars"]
AT = ["doc", "copy", "at"]
BUCKETS = 4096  # of line hashes, and at most as many chunks of one rank's successors


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row per non-blank line, with the shortest long enough blocks that begin and end there.

    ``at`` counts non-blank lines, ``no`` all lines. A block is its first ``at``, its length
    in lines, and its first and last ``no``.
    """
    lines = F.transform(
        F.split(whole_text(), "\n", -1),
        lambda line, no: F.struct(
            no.alias("no"),
            F.xxhash64(line).alias("id"),
            F.hash(line).alias("check"),
            F.length(line).alias("chars"),
            (F.trim(line) != "").alias("filled"),
        ),
    )
    rows = (
        docs.select(doc_key().alias("doc"), F.xxhash64(whole_text()).alias("copy"), lines.alias("lines"))
        .withColumn("lines", F.filter("lines", lambda line: line["filled"]))
        .groupBy("doc", "copy")
        .agg(F.first("lines").alias("lines"))
        .select("doc", "copy", F.posexplode("lines").alias("at", "line"))
        .select("doc", "copy", "at", "line.no", *(f"line.{name}" for name in LINE))
    )
    sequence = Window.partitionBy("doc", "copy")
    whole = Window.unboundedPreceding
    rows = rows.withColumn(
        "end", F.sum(F.col("chars").cast("long")).over(sequence.orderBy("at").rowsBetween(whole, 0))
    ).withColumn("begin", F.col("end") - F.col("chars"))
    ahead = sequence.orderBy("begin").rangeBetween(0, min_chars - 1)
    behind = sequence.orderBy("end").rangeBetween(-(min_chars - 1), 0)

    def block(frame, first, last, at):
        long_enough = F.sum("chars").over(frame) >= min_chars
        fields = F.struct(at.alias("at"), F.count("*").over(frame).cast("int").alias("n"), first.alias("first"), last.alias("last"))
        return F.when(long_enough, fields)

    return rows.select(
        *AT,
        *LINE,
        block(ahead, F.col("no"), F.max("no").over(ahead), F.col("at")).alias("ahead"),
        block(behind, F.min("no").over(behind), F.col("no"), F.min("at").over(behind)).alias("behind"),
    )


def starts(groups: DataFrame, keys: list[str], chunk: str, order: list[str]) -> DataFrame:
    """Add ``before``: how many suffixes of the same keys sort before each group.

    The running total is taken per chunk, and over the totals of the chunks.
    """
    whole = Window.unboundedPreceding
    totals = groups.groupBy(*keys, chunk).agg(F.sum("n").alias("total"))
    over = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(whole, -1)
    offsets = totals.select(*keys, chunk, F.coalesce(F.sum("total").over(over), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(whole, -1)
    return (
        groups.withColumn("here", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(offsets, [*keys, chunk])
        .withColumn("before", F.col("offset") + F.col("here"))
    )


def first_level(lines: DataFrame) -> DataFrame:
    """Rank of each repeated line, as sorted by line hash."""
    groups = lines.groupBy(*LINE).agg(F.count("*").alias("n")).filter("n > 1")
    groups = groups.withColumn("chunk", F.shiftrightunsigned("id", 52))
    ranked = starts(groups, [], "chunk", LINE).select(*LINE, F.col("before").alias("rank"))
    return lines.select(*AT, *LINE).join(ranked, LINE).select(*AT, "rank")


def next_level(level: DataFrame, step: int, n_suffixes: int) -> DataFrame:
    """Ranks by twice as many lines; positions whose block occurs once drop out."""
    after = level.select("doc", "copy", (F.col("at") - step).alias("at"), F.col("rank").alias("next"))
    pairs = level.join(after, AT)
    groups = pairs.groupBy("rank", "next").agg(F.count("*").alias("n"))
    width = max(1, -(-n_suffixes // BUCKETS))
    groups = groups.withColumn("chunk", F.floor(F.col("next") / width))
    ranked = starts(groups, ["rank"], "chunk", ["next"]).filter("n > 1")
    ranked = ranked.select("rank", "next", (F.col("rank") + F.col("before")).alias("new"))
    return pairs.join(ranked, ["rank", "next"]).select(*AT, F.col("new").alias("rank"))


def named_blocks(blocks: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Add the two ranks that name a block; blocks that occur once drop out."""

    def of(k: int) -> DataFrame:
        own = blocks.filter(F.floor(F.log2("n")) == k)
        head = levels[k].withColumnRenamed("rank", "head")
        if k == 0:
            return own.join(head, AT).withColumn("tail", F.col("head"))
        tail = levels[k].select("doc", "copy", F.col("at").alias("upto"), F.col("rank").alias("tail"))
        return (
            own.join(head, AT)
            .withColumn("upto", F.col("at") + F.col("n") - (1 << k))
            .join(tail, ["doc", "copy", "upto"])
            .drop("upto")
        )

    return reduce(DataFrame.unionByName, map(of, range(len(levels))))


def repeated_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, copy and ``runs``: the line numbers (first, last) of all later copies, disjoint."""
    lines = staged(lines_of(docs, min_chars), "lines")
    levels = [staged(first_level(lines), "line-ranks")]
    n_suffixes = levels[0].count()
    while (1 << len(levels)) <= min_chars:
        levels.append(staged(next_level(levels[-1], 1 << (len(levels) - 1), n_suffixes), "line-ranks"))

    both = F.explode(F.array_distinct(F.array_compact(F.array("ahead", "behind"))))
    blocks = lines.select("doc", "copy", both.alias("block")).select("doc", "copy", "block.*")
    named = staged(named_blocks(blocks, levels), "line-blocks")
    name = ["n", "head", "tail"]
    # Positions are distinct within a document, so a block that both ends found counts once.
    first = named.groupBy(*name).agg(F.min(F.struct(*AT)).alias("origin"))
    later = named.join(first, name).filter(F.struct(*AT) > F.col("origin"))

    whole = Window.unboundedPreceding
    ordered = Window.partitionBy("doc", "copy").orderBy("first", "last")
    reach = F.max("last").over(ordered.rowsBetween(whole, -1))
    opens = F.when(F.col("first") > reach + 1, 1).when(reach.isNull(), 1).otherwise(0)
    runs = (
        later.select("doc", "copy", "first", "last")
        .withColumn("opens", opens)
        .withColumn("run", F.sum("opens").over(ordered.rowsBetween(whole, 0)))
        .groupBy("doc", "copy", "run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
    )
    return runs.groupBy("doc", "copy").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, counts: bool = True) -> DataFrame:
    """Documents with later copies of repeated runs removed; with ``counts`` also ``_n_lines`` and ``_n_removed``.

    The counts take the place of columns of these names.
    """
    # The row travels as one value, so that no name of its columns can clash.
    keyed = docs.select(F.struct("*").alias("row"), doc_key().alias("doc"), F.xxhash64(whole_text()).alias("copy"))
    lines = F.split(F.col("row.text"), "\n", -1)
    stays = F.filter(
        lines, lambda line, no: ~F.exists("runs", lambda run: no.between(run["first"], run["last"]))
    )
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, run: n + run["last"] - run["first"] + 1)
    found = {
        "_n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
        "_n_removed": F.coalesce(removed, F.lit(0).cast("long")),
    }
    kept = F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.array_join(stays, "\n"))
    new = F.struct(kept.alias("text"), *(value.alias(name) for name, value in found.items() if counts))
    done = keyed.join(repeated_runs(docs, min_chars), ["doc", "copy"], "left").select("row", new.alias("new"))
    given = [name for name in docs.columns if name not in done.schema["new"].dataType.names]
    return done.select(*(F.col("row")[name].alias(name) for name in given), "new.*")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with their lines after dedup."""
    found = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed")
    )


OP8_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS no
  FROM documents WHERE text IS NOT NULL
), filled AS (
  SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY no) AS upto FROM lines WHERE trim(line, ' ') <> ''
), offsets AS (SELECT *, upto - length(line) AS since FROM filled),
blocks AS (
  SELECT doc_id, no AS first, max(no) OVER w AS last, sum(length(line)) OVER w AS n, list(line) OVER w AS block
  FROM offsets
  WINDOW w AS (PARTITION BY doc_id ORDER BY since RANGE BETWEEN CURRENT ROW AND {MIN_CHARS - 1} FOLLOWING)
  UNION
  SELECT doc_id, min(no) OVER w, no, sum(length(line)) OVER w, list(line) OVER w
  FROM offsets
  WINDOW w AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {MIN_CHARS - 1} PRECEDING AND CURRENT ROW)
), long AS (
  SELECT *, min((doc_id, first)) OVER (PARTITION BY md5(block::VARCHAR), len(block)) AS origin
  FROM blocks WHERE n >= {MIN_CHARS}
), gone AS (SELECT doc_id, first, last FROM long WHERE (doc_id, first) > origin),
flagged AS (
  SELECT l.*, EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND l.no BETWEEN g.first AND g.last) AS out
  FROM lines l
), kept AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT out), '') AS text,
         count(*) AS n_lines, count(*) FILTER (out) AS n_removed
  FROM flagged GROUP BY doc_id
)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
