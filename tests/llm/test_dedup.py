"""Line dedup, suffix dedup, the Jaccard join and fingerprints against plain code."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from feedlake.llm import fingerprints, jaccard, line_dedup, suffix_dedup
from feedlake.llm.components import components
from feedlake.llm.suffix_sort import suffix_array

SCHEMA = "doc_id long, text string, lang string, n int, doc string, runs int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "d", 2) for i, t in rows], SCHEMA)


def plain_lines(rows, least):
    """Lines that lie in a run of ``least`` characters or more that starts earlier."""
    lines = {i: [(n, x) for n, x in enumerate(t.split("\n")) if x.strip(" ")] for i, t in rows}
    seen, gone = set(), set()
    for i in sorted(lines):
        own = lines[i]
        runs = [(a, b) for a in range(len(own)) for b in range(a + 1, len(own) + 1)]
        # All runs in order of their start: those that begin earlier are known by then.
        for a in range(len(own)):
            added = []
            for b in (b for x, b in runs if x == a):
                run = tuple(x for _, x in own[a:b])
                if sum(map(len, run)) >= least and run in seen:
                    gone.update((i, n) for n in range(own[a][0], own[b - 1][0] + 1))
                added.append(run)
            seen.update(added)
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def test_later_copies_of_line_runs_go(spark):
    random.seed(5)
    pool = ["a", "bb", "ccc dd", "eeee", "", " ", "f" * 12]
    rows = [(i, "\n".join(random.choice(pool) for _ in range(random.randint(0, 9)))) for i in range(40)]
    found = line_dedup.dedup_lines(table(spark, rows), min_chars=10).collect()
    assert {r.doc_id: r.text for r in found} == plain_lines(rows, 10)
    assert all(r.lang == "en" and r.runs == 2 for r in found)


def test_line_dedup_of_odd_rows(spark):
    long = "x" * 60
    rows = [(None, long), (2, long), (2, long), (3, None), (4, ""), (5, f"{long}\nown"), (7, f"{long}\nown")]
    found = line_dedup.dedup_lines(table(spark, rows)).collect()
    by_id = {r.doc_id: r.text for r in found}
    assert len(found) == 7 and by_id == {None: long, 2: "", 3: None, 4: "", 5: "own", 7: ""}
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_suffix_array_is_sorted():
    random.seed(6)
    for _ in range(500):
        text = bytes(random.choice(b"\0abc"[: random.randint(1, 4)]) for _ in range(random.randint(0, 40)))
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_ascending_contexts_takes_linear_memory():
    def peak(n):
        text = b"\0".join(i.to_bytes(2, "big") + b"m" * 50 + i.to_bytes(2, "big") for i in range(257, 257 + n))
        tracemalloc.start()
        order = suffix_array(text)
        used = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert order == sorted(range(len(text)), key=lambda i: text[i:])
        return used

    assert peak(800) < 2.5 * peak(400)


def test_equal_parts_of_contexts_are_collapsed():
    shared = bytes(range(65, 65 + 110))
    group = [(3, 40, 20, b"x" + shared), (1, 7, 20, b"x" + shared), (2, 9, 20, b"y" + shared + b"?"), (5, 0, 0, shared[:70])]
    parts, copies = suffix_dedup.trimmed(group, 100)
    assert sorted(parts) == [(1, 7, b"x" + shared), (2, 10, shared)] and copies == [(3, 40, 40 + 111)]


def mixed_texts(n, seed, length):
    random.seed(seed)
    parts = ["".join(random.choice("ab é\n") for _ in range(random.randint(1, length))) for _ in range(8)]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 5)))) for i in range(n)]
    return rows + [(n, "a" * 500), (n + 1, "ab" * 300), (n + 2, None), (n + 3, "\0" * 150 + "x" + "\0" * 120)]


@pytest.mark.parametrize("most", [1, 2048])
def test_suffix_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    rows = mixed_texts(40, 7, 90)
    found = suffix_dedup.dedup(table(spark, rows)).collect()
    mine = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found}
    assert mine == suffix_dedup.plain_dedup({i: (t or "").encode() for i, t in rows})


def test_crowded_anchors_are_narrowed_to_longer_ones(spark):
    random.seed(8)
    hot, schema = b"h" * 20 + bytes(range(30)), "doc long, first long, at long, bytes binary"
    sides = [(bytes(random.choices(b"ab", k=random.choice([0, 9, 50]))), bytes(random.choices(b"ab", k=50))) for _ in range(40)]
    rows = [(n, 7, len(a), a + hot + b) for n, (a, b) in enumerate(sides)]
    strings = {(n, 7 + i, part[i : i + 100]) for n, _, _, part in rows for i in range(len(part) - 99)}
    gram = suffix_dedup.GRAM
    while gram < 100:
        more = (100 - gram + 1) // 2
        found = suffix_dedup.narrowed(spark.createDataFrame(rows, schema), 100, gram, more).collect()
        gram += more
        # No string is lost, and a context becomes two at most, not a row for each string.
        assert {(r.doc, r.first + i, bytes(r.bytes[i : i + 100])) for r in found for i in range(r.size - 99)} == strings
        assert len(found) <= 2 * len(rows)
        grams = {(r.anchor, bytes(r.bytes[r.at : r.at + gram])) for r in found}
        assert len(grams) == len({g for g, _ in grams}) == len({g for _, g in grams})
        rows = [(r.doc, r.first, r.at, bytes(r.bytes)) for r in found]
    assert len({(r.anchor, r.context) for r in found}) == len({r.anchor for r in found}) == len({s for *_, s in strings})


@pytest.mark.parametrize("most", [3, 12])
def test_a_passage_in_many_contexts_is_divided_exactly(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    random.seed(9)
    passage = "".join(random.choice("abcdefgh ") for _ in range(130))
    cuts = [passage[random.choice([0, 10, 30]) : random.choice([95, 110, 130])] for _ in range(40)]
    rows = [(n, "".join(random.choices("xyz", k=random.choice([0, 20, 70]))) + cut + random.choice("pq") * random.choice([0, 5, 60])) for n, cut in enumerate(cuts)]
    found = suffix_dedup.dedup(table(spark, rows)).collect()
    mine = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found}
    assert mine == suffix_dedup.plain_dedup({i: t.encode() for i, t in rows})
    assert sum(r.n_removed for r in found) > 1000


def test_suffix_dedup_of_odd_rows(spark):
    text = "".join(map(str, range(100)))
    rows = [(None, text), (1, text), (1, text), (2, "short"), (3, None), (4, text), (4, text + "!")]
    found = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.dedup(table(spark, rows)).collect())
    assert found == [(0, 0), (1, len(text)), (1, len(text)), (2, 0), (3, 0), (4, 0), (4, 0)]
    assert suffix_dedup.dedup(table(spark, [])).count() == 0


def plain_components(rows, size, percent):
    sets = {}
    for i, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        last = max(1, len(words) - size + 1)
        sets[i] = {tuple(words[k : k + size]) for k in range(last)} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            same = len(sets[a] & sets[b])
            if a < b and same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(n, seed):
    random.seed(seed)
    bases = [[random.choice("abcdefgh") * random.randint(1, 3) for _ in range(random.randint(1, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
            words[random.randrange(len(words))] = random.choice(["NEW", "x", "Y" + str(i)])
        rows.append((i, random.choice([" ", "\n", "\t "]).join(words)))
    return rows


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_components(spark, size, percent):
    rows = near_copies(90, size) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE")]
    found = jaccard.jaccard_components(table(spark, rows), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_components(rows, size, percent)


def test_jaccard_of_odd_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "q r s t"), (5, "q r s t"), (6, "a b c d e")]
    found = sorted((r.doc_id or 0, r.component_id) for r in jaccard.jaccard_components(table(spark, rows)).collect())
    assert found == [(0, None), (1, 1), (1, 1), (5, None), (6, 1)]
    assert jaccard.jaccard_components(table(spark, [])).count() == 0
    kept = jaccard.one_of_each(table(spark, [(3, "x y z"), (2, "x y z"), (9, "")]))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9] and kept.columns == table(spark, []).columns


def test_one_of_each_with_null_and_repeated_ids(spark):
    rng = random.Random(11)
    texts = [t for _, t in near_copies(120, 12)] + [None, "", " ", "one", "one"]
    rows = [(rng.choice([None, None, i, i, 7]), t) for i, t in enumerate(texts)]
    rows += rng.sample(rows, 30) + [(None, "p q r s t")] * 40 + [(3, "p q r s t")] * 2
    linked = plain_components(list(enumerate(t for _, t in rows)), 5, 80)
    groups = {}
    for i, (n, root) in linked.items():
        groups.setdefault(root if n else ("none", i), []).append(i)
    # One row of each group stays, with its smallest id.
    least = [min((rows[i][0] is not None, rows[i][0] or 0) for i in own) for own in groups.values()]
    kept = jaccard.one_of_each(table(spark, rows)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept) == sorted(least)
    places = {}
    for i, row in enumerate(rows):
        places.setdefault(row, set()).add(linked[i][1] if linked[i][0] else "none")
    roots = [root for r in kept for root in places[r.doc_id, r.text] if root != "none"]
    assert len(roots) == len(set(roots)) == sum(isinstance(g, int) for g in groups)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_fingerprints(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    texts = [" ".join(rng.sample(words, 200)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, texts[0]), (51, texts[0]), (60, None), (61, ""), (70, "é"), (None, "zz")]
    found = {r.doc_id: r for r in fingerprints.fingerprint(table(spark, rows)).collect()}
    order = sorted((i for i, _ in rows if i is not None), reverse=True) + [None]
    by_id = dict(rows)
    for here, after in zip(order, order[1:] + order[:1]):
        own, following = by_id[here] or "", by_id[after] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        assert found[here].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert found[here].n_chars == len(own)
    assert found[0].fingerprint == found[50].fingerprint == found[51].fingerprint
    assert found[51].near_next == 1.0 and found[3].near_next < 0.1
    assert 0.2 < found[3].near_edited < 0.6
    assert found[61].near_next == 1.0 and found[70].near_next == 0.0
    assert fingerprints.fingerprint(table(spark, [])).count() == 0
    single = fingerprints.fingerprint(table(spark, [(1, "abc")])).first()
    assert single.near_next == 1.0


def test_equal_substrings_share_phrases():
    rng = random.Random(9)
    shared = bytes(rng.randrange(256) for _ in range(2000))

    def level(text, n):
        names, head = np.frombuffer(text, np.uint8).astype(np.uint64), np.zeros(len(text), bool)
        head[0] = True
        for _ in range(n):
            names, head = fingerprints.phrases(names, head)
        return set(names.tolist())

    left, right = level(b"x" * 37 + shared, 2), level(shared + b"abc" * 11, 2)
    assert len(left & right) >= 0.9 * min(len(left), len(right))


def test_columns_of_any_name_stay_as_they_are(spark):
    names = ["_id", "_text", "id", "doc", "copy", "row", "runs", "_doc", "_copy", "_runs", "_n_lines"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    line = "a line of more than fifty characters that stands in two documents of this table"
    rows = [(1, f"{line}\none two three four five six", *names), (2, f"{line}\nseven eight nine ten eleven twelve", *names), (2, None, *names)]
    docs = spark.createDataFrame(rows, schema)
    for found in (jaccard.one_of_each(docs, 5, 80), line_dedup.dedup_lines(docs, counts=False)):
        assert sorted(found.columns) == sorted(docs.columns)
        assert all(tuple(r[n] for n in names) == tuple(names) for r in found.collect()) and found.count() == 3
    counted = line_dedup.dedup_lines(docs)
    assert sorted(counted.columns) == sorted({*docs.columns, "_n_removed"})
    assert {(r.doc_id, r._n_removed) for r in counted.collect()} == {(1, 0), (2, 1), (2, 0)}


def test_texts_are_hashed_in_small_slices(spark, monkeypatch):
    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, function, _):
            self.function = function
            return self

    hashed, hash_ = [], jaccard.distinct_shingles
    monkeypatch.setattr(jaccard, "distinct_shingles", lambda texts, size: hashed.append(pa.compute.sum(pa.compute.binary_length(texts)).as_py()) or hash_(texts, size))
    texts = [f"{n} " + "some words of a text " * 500 for n in range(400)]
    batch = pa.record_batch([pa.array(range(400), pa.int64()), pa.array(texts)], names=["doc", "text"])
    rows = jaccard.set_rows(Rows(), np.empty(0, dtype=np.uint64), 5, 80)
    assert sum(part.num_rows for part in rows.function(iter([batch]))) == 400
    assert sum(hashed) == sum(map(len, texts)) and max(hashed) <= 1 << 19
