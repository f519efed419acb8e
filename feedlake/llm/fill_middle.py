"""Fill-in-middle: a text is cut at two line ends and its parts are put in another order.

A unit is a line with its line feed, or a last line without one. One match of the whole text
against a repeated group keeps the end of every repetition (the regex library's captures),
so the number of units and both cuts are read from one list. Which units are cut, whether a text is
cut at all and in which form follows from a digest of its doc_id, the same in every run.

Forms: ``psm`` puts prefix, suffix, middle, ``spm`` suffix, prefix, middle, each after its
mark. A text that holds a mark stays ``plain``, so a form can always be read back.

Defined cases: a null text is empty; an empty text is plain with no units; a null doc_id has
the digest of the seed alone; rows of one doc_id draw the same numbers, each for its own text; equal
rows give equal rows; a text is one row of any length; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from feedlake.llm import bytescan
from feedlake.llm.common import documents, whole_text

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Repetitions are possessive: what a unit has taken is never given back, so no match backtracks.
UNITS = regex.compile(r"((?>[^\n]*+\n|[^\n]++))*+")
DRAWS = ["h1", "h2", "h3", "h4"]


def draws(seed: int) -> list[Column]:
    """Four numbers below 2^32 from the digest of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(name) for i, name in enumerate(DRAWS)]


def arranged(text: str, draw: tuple[int, int, int, int], percent: int, spm_percent: int) -> tuple:
    """n, form, characters of prefix and of middle, and the output for one text."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    if not n or draw[2] % 100 >= percent or any(mark in text for mark in MARKS):
        return n, "plain", None, None, text
    low, high = sorted((draw[0] % (n + 1), draw[1] % (n + 1)))
    at, upto = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:at], text[at:upto], text[upto:]
    if draw[3] % 100 < spm_percent:
        return n, "spm", at, upto - at, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", at, upto - at, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, percent: int = 100, spm_percent: int = 50, seed: int = 7) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row.

    ``percent`` of the texts are cut, ``spm_percent`` of these in the form spm.
    """
    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.large_string()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bytescan.slices(whole)):
            texts = batch.column("text").to_pylist()
            drawn = zip(*(batch.column(name).to_pylist() for name in DRAWS))
            rows = [arranged(text, draw, percent, spm_percent) for text, draw in zip(texts, drawn)]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *kinds])

    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), *draws(seed))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return drawn.mapInArrow(read, schema)


def restored() -> Column:
    """The text that ``output`` was made of, read from output and form alone."""
    part = F.split(F.col("output"), "<[PSM]>", -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("output"))


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    return fill_in_middle(documents(spark, sf_dir)).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS digest,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n,
         ('0x' || substr(digest, 1, 8))::BIGINT AS h1, ('0x' || substr(digest, 9, 8))::BIGINT AS h2,
         ('0x' || substr(digest, 17, 8))::BIGINT AS h3, ('0x' || substr(digest, 25, 8))::BIGINT AS h4
  FROM cut
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parted AS (
  SELECT *, coalesce(array_to_string(units[1:low], ''), '') AS prefix,
         coalesce(array_to_string(units[low + 1:high], ''), '') AS middle,
         coalesce(array_to_string(units[high + 1:], ''), '') AS suffix
  FROM formed
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parted
"""
