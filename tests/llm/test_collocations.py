"""Count automata, and collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np

from feedlake.llm import automata, collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, n int, words string, first string, shard string"


def some_counts(size):
    labels = [3, 7, 9, (1 << 63) + 5]
    return Counter({tuple(random.choice(labels) for _ in range(random.randint(1, 4))): random.randint(1, 2) for _ in range(size)})


def rows_of(counts, depth=4):
    rows = np.zeros((len(counts), depth), dtype=np.uint64)
    for i, words in enumerate(counts):
        rows[i, : len(words)] = words
    return automata.summed(rows, np.array(list(counts.values()), dtype=np.int64))


def read_back(found):
    return {tuple(int(x) for x in row if x): int(count) for row, count in zip(*found)}


def states_by_depth(counts):
    """All states of a plain trie as nested tuples, equal ones once."""
    found = set()

    def state(words):
        following = sorted({k[len(words)] for k in counts if len(k) > len(words) and k[: len(words)] == words})
        own = tuple((x, counts.get((*words, x), 0), state((*words, x))) for x in following)
        found.add((len(words) if own else None, own))
        return own

    state(())
    return found | {(None, ())}


def test_automata_keep_counts_and_share_states():
    random.seed(21)
    for size in [0, 1, 2, 5, 60, 200] * 10:
        counts = some_counts(size)
        made = automata.build(*rows_of(counts))
        assert read_back(automata.entries(made, 4)) == counts
        assert len(made.ends) == len(states_by_depth(counts))
    tails = {(a, *rest): 2 for a in (1, 2, 3) for rest in ((4,), (4, 5), (6,))}
    assert len(automata.build(*rows_of(tails)).ends) == 4  # nothing, after 4, after 1 or 2 or 3, the start


def test_union_adds_and_compose_looks_up():
    random.seed(22)
    parts = [some_counts(random.randint(0, 30)) for _ in range(11)]
    total = sum(parts, Counter())
    together = automata.build(*automata.union([automata.build(*rows_of(c)) for c in parts], 4))
    assert read_back(automata.entries(together, 4)) == total
    asked = some_counts(60)
    found = automata.compose(automata.build(*rows_of(asked)), together, 4)
    assert read_back(found) == {w: total[w] for w in asked if w in total}


def plain(rows, least, longest):
    """All of it by one counter per language."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    found = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    inner = {}
    for (lang, *words), a in found.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                part = (lang, *words[i : i + size])
                inner[part] = max(inner.get(part, 0), a)
    out = []
    for (lang, *words), a in found.items():
        if inner.get((lang, *words), 0) < a:
            cuts = [(f[(lang, *words[:k])], f[(lang, *words[k:])], k) for k in range(1, len(words))]
            score, _, left, right = min((1000 * a * n[lang] // (x * y), k, x, y) for x, y, k in cuts)
            out.append((lang, " ".join(words), a, left, right, n[lang], score))
    return sorted(out)


def mine(spark, rows, least, longest):
    table = spark.createDataFrame([(i, t, lang, 1, "w", "f", "s") for i, t, lang in rows], SCHEMA)
    found = collocations.collocations(table.repartition(5), least, longest).collect()
    return sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, int(r.score)) for r in found)


def test_collocations_equal_brute_force(spark, monkeypatch):
    random.seed(23)
    # Many shards of short slices, so that unions have work.
    for name, small in (("SHARD", 50), ("FAN", 2)):
        monkeypatch.setattr(collocations, name, small)
    pool = ["New", "york", "the", "of", "é", "ß", "a-b", "x\x01", "THE"]
    ends = [" ", "  ", "\t", ". ", "\n", ","]
    rows = []
    for i in range(80):
        words = [random.choice(pool) for _ in range(random.randint(0, 40))] + ["in", "New", "York", "city"] * random.randint(0, 2)
        rows.append((i, "".join(w + random.choices(ends, [8, 1, 1, 1, 1, 1])[0] for w in words), random.choice(["en", "fr", None])))
    for least, longest in ((4, 5), (12, 3)):
        assert mine(spark, rows, least, longest) == plain(rows, least, longest)


def test_collocations_of_odd_rows(spark):
    rows = [(None, None, None), (None, "", "en"), (1, " .,\n", "en"), (1, "a b " * 300, "en"), (1, "a b " * 300, "en"), (2, "w" * 100_000, "de")]
    rows += [(3, "und same und same", None), (4, "und same", "und"), (5, "und same", "")]
    found = mine(spark, rows, 3, 5)
    assert found == plain(rows, 3, 5) and ("und", "und same", 3, 3, 3, 6, 2000) in found
    assert mine(spark, [], 1, 5) == [] and mine(spark, rows[:3], 1, 5) == []


def test_scores_whose_products_pass_64_bits(spark):
    found = spark.sql(
        "SELECT (cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) AS s "
        "FROM VALUES (9000000000000L, 90000000000007L, 9000000000001L, 9000000000003L) AS t(a, n, l, r)"
    ).first()["s"]
    assert found == 1000 * 9000000000000 * 90000000000007 // (9000000000001 * 9000000000003)
