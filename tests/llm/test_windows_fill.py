"""Window dedup and fill-in-middle against plain code."""

import hashlib
import random
import re

from feedlake.llm import fill_middle, window_dedup

SCHEMA = "doc_id long, text string, doc string, copy int, n int, places string, output string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "d", 1, 2, "p", "o") for i, t in rows], SCHEMA)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_covers_hold_every_difference():
    for period, cover in window_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert window_dedup.period_for(35) == 21 and window_dedup.period_for(2) == 1


def windows(spark, rows, length):
    found = window_dedup.dedup_windows(table(spark, rows), length).collect()
    assert len(found) == len(rows)
    mine = sorted((str(r.doc_id), r.n_words, r.n_removed, digest(r.kept)) for r in found)
    plain = window_dedup.plain_windows(rows, length)
    assert mine == sorted((str(row[0]), *plain[row]) for row in rows)


def test_windows_equal_brute_force(spark):
    random.seed(11)
    runs = [" ".join(random.choice("abcdefgh") for _ in range(n)) for n in (6, 9, 14, 30)]
    rows = []
    for i in range(60):
        parts = [random.choice(runs) if random.random() < 0.4 else random.choice("abcdefgh") for _ in range(random.randint(0, 12))]
        rows.append((i, random.choice([" ", "\n", "\t "]).join(parts)))
    for length in (2, 5, 12, 35):
        windows(spark, rows, length)


def test_shifted_copies_and_one_text_that_repeats_itself(spark):
    random.seed(12)
    words = [f"w{random.randrange(10**6)}" for _ in range(400)]
    passage = words[:50]
    rows = [(i, " ".join(words[60 + 3 * i : 60 + 4 * i] + passage[i % 16 :] + [f"x{i}"])) for i in range(40)]
    rows += [(100, " ".join(passage[:35] + ["y"] + passage[:35])), (101, " ".join(["z"] * 36)), (102, " ".join(["q"] * 35))]
    windows(spark, rows, 35)


def test_windows_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(None, long), (None, other), (None, None), (3, other + " é"), (3, "short"), (4, ""), (5, " \n "), (6, None)]
    windows(spark, rows, 35)
    windows(spark, rows + [(7, "7 " + long)] * 2, 35)
    assert window_dedup.dedup_windows(table(spark, [])).count() == 0


def units(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def plain_fill(doc, text, percent, spm_percent):
    text, lines = text or "", units(text or "")
    hexed = digest(f"7:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(hexed[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(lines)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(part) for part in (lines[:low], lines[low:high], lines[high:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    if h4 % 100 < spm_percent:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_equals_plain_code_and_reads_back(spark):
    random.seed(13)
    pool = ["a", "\n", "é", "𝄞", "<", "S>", "<M", ">", "\r", "\x0b", " "]
    rows = [(i, "".join(random.choice(pool) for _ in range(random.randint(0, 30)))) for i in range(300)]
    rows += [(None, None), (None, "a\nb"), (301, ""), (302, "x<P>y\n"), (302, "\n\n\n"), (302, "\n\n\n"), (303, "line é\n" * 200_000 + "end")]
    for percent, spm_percent in ((100, 50), (40, 0), (100, 100)):
        found = fill_middle.fill_in_middle(table(spark, rows), percent, spm_percent)
        found = found.withColumn("again", fill_middle.restored()).collect()
        mine = sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.again) for r in found)
        plain = []
        for doc, text in rows:
            n, form, prefix, middle, output = plain_fill(doc, text, percent, spm_percent)
            plain.append((str(doc), n, form, str(prefix), str(middle), output, text or ""))
        assert mine == sorted(plain)
    assert fill_middle.fill_in_middle(table(spark, [])).count() == 0


def test_all_repetitions_of_a_unit_come_from_one_match():
    ends = fill_middle.UNITS.fullmatch("ab\n\n" + "c").ends(1)
    assert ends == [3, 4, 5] and fill_middle.UNITS.fullmatch("").ends(1) == []


def test_staged_results_leave_no_shuffle_files(spark):
    import re
    import time

    from feedlake.llm import common

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return set(re.findall(r"shuffle_\d+_\d+_0\.data", files))

    former, before = spark.conf.get(common.SHUFFLE_CLEANUP), shuffles()
    staged = common.staged(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "test")
    wanted = time.monotonic() + 10
    while shuffles() - before and time.monotonic() < wanted:
        time.sleep(0.2)
    assert not shuffles() - before
    assert staged.count() == 7 and spark.conf.get(common.SHUFFLE_CLEANUP) == former
