"""Toxicity by a linear-chain conditional random field over words.

Labels are per document, so words of training documents get theirs first: a word is a toxic token
if its document is toxic and the word occurs in toxic documents far more often than chance and
than in clean ones, each pair of neighbours counted once, so that copies of one document do not
make its words toxic. These labelled tokens train a chain of two states (clean, toxic). A
word's score is that of its own hash, of its left and of its right neighbour, and the
chain's weights score each pair of states. Chains are lines of text, cut after ``CHAIN`` words
with ``CONTEXT`` words of the neighbouring parts on both sides. Training maximises the
likelihood by forward-backward marginals; scoring runs forward-backward over all
chains of a slice in step and gives each word's probability of being toxic.

A document's score is a logistic curve of the log-odds of 1 - Π(1 - p) over the marginals of its words, and
of its length. The curve is fitted to training rows that the chain has not seen, a quarter of the sample. Its spans are the runs
of words of p ≥ 0.5, as (begin, end) in characters of the text.

Training takes at most ``SAMPLE`` labelled rows of each label, those with the least hash of
their id and text and with texts of LONGEST characters at most; a row may train if crc32(doc_id as text) mod 5 is not 0. Every row is scored, on its
whole text. Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null and empty texts have no words and the score of a text without toxic words;
a null doc_id is held out of training; repeated rows get equal scores; without training rows of
both labels every score is 0 and nothing is rejected; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedlake.llm import bytescan
from feedlake.llm.common import documents
from feedlake.llm.quality import fold, least_hashed

SAMPLE = 2_500
LONGEST = 50_000  # characters of a row that may train; any length is scored
FOLDS, HELD_OUT = 5, 0
LEAST_DOCS = 4  # pairs of neighbours a toxic token must occur between in toxic training documents
LEAST_LIFT = 4.0  # how much likelier a toxic document has it
COPIES_SHARE = 0.1  # of the toxic training documents, for words of copies that no other word explains
CURVE_SHARE = 4  # every fourth row of the sample fits the curve, the others the chain
MAX_WORDS = 1 << 15  # weights of words
CHAIN, CONTEXT = 64, 4
STEPS, RATE, DECAY = 60, 0.3, 1e-3
SLICE = 1 << 20


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the first word of each; marks end words as blanks do."""
    data, offsets = bytescan.utf8(texts)
    _, _, hashes, first = bytescan.words(_MARKS_TO_BLANKS[data], offsets)
    return hashes, first


_MARKS_TO_BLANKS = np.arange(256, dtype=np.uint8)
for _b in range(0x21, 0x7F):
    if not chr(_b).isalnum():
        _MARKS_TO_BLANKS[_b] = 0x20


def chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of overlapping chains of words, and the part of each that counts."""
    n = np.diff(first)
    parts = -(-n // CHAIN)
    row = np.repeat(np.arange(len(n)), parts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    own = first[row] + nth * CHAIN
    upto = np.minimum(own + CHAIN, first[row + 1])
    return np.maximum(own - CONTEXT, first[row]), np.minimum(upto + CONTEXT, first[row + 1]), own, upto


class Field:
    """Weights of known words and of pairs of states."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float, pairs: np.ndarray):
        self.words, self.weights, self.bias, self.pairs = words, weights, bias, pairs

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each known word from 1 on, 0 for all others."""
        if not len(self.words) or not len(hashes):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0)

    def scores(self, numbers: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Score of the toxic state of each word; ``inside`` tells chains' neighbours apart."""
        own = self.bias + self.weights[0][numbers]
        own[1:] += np.where(inside[1:], self.weights[1][numbers[:-1]], 0)
        own[:-1] += np.where(inside[1:], self.weights[2][numbers[1:]], 0)
        return own


def forward_backward(
    scores: np.ndarray, lengths: np.ndarray, pairs: np.ndarray, counts_for: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state, sums of pair marginals (each chain as often as it counts for), and log partition sums.

    ``scores`` has a row per chain; a chain's first ``lengths`` columns count. Chains are in
    descending order of length and each step takes those that reach it.
    """
    n, width = scores.shape
    reach = n - np.searchsorted(lengths[::-1], np.arange(width), side="right")
    alpha = np.zeros((n, width, 2))
    local = np.stack([np.zeros_like(scores), scores], axis=2)
    weight = np.exp(local - local.max(axis=2, keepdims=True))
    shift = local.max(axis=2)
    step = np.exp(pairs)
    log_z = np.zeros(n)
    for t in range(width):
        k = reach[t]
        if not k:
            break
        now = weight[:k, t] if t == 0 else (alpha[:k, t - 1] @ step) * weight[:k, t]
        size = now.sum(axis=1)
        alpha[:k, t] = now / size[:, None]
        log_z[:k] += np.log(size) + shift[:k, t]
    beta = np.ones((n, 2))
    p = np.zeros((n, width))
    both = np.zeros((2, 2))
    for t in range(width - 1, -1, -1):
        k = reach[t]
        if not k:
            continue
        own = alpha[:k, t] * beta[:k]
        p[:k, t] = own[:, 1] / own.sum(axis=1)
        if t:
            right = weight[:k, t] * beta[:k]
            joint = alpha[:k, t - 1, :, None] * step[None] * right[:, None, :]
            joint = joint / joint.sum(axis=(1, 2), keepdims=True)
            both += joint.sum(axis=0) if counts_for is None else np.tensordot(counts_for[:k], joint, axes=1)
            before = right @ step.T
            beta[:k] = before / before.sum(axis=1, keepdims=True)
    return p, both, log_z


def padded(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains as rows in descending order of length, their lengths, and the order."""
    lengths = end - begin
    order = np.argsort(-lengths, kind="stable")
    lengths, begin = lengths[order], begin[order]
    width = int(lengths[0]) if len(lengths) else 0
    at = begin[:, None] + np.arange(width)
    rows = values[np.minimum(at, max(len(values) - 1, 0))] if len(values) else np.zeros((len(order), 0))
    return rows, lengths, order


def marginals(field: Field, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability of being toxic for each word of the texts."""
    out = np.zeros(len(hashes))
    if not len(hashes):
        return out
    inside = np.ones(len(hashes), dtype=bool)
    inside[first[:-1][np.diff(first) > 0]] = False
    numbers = field.numbers(hashes)
    scores = field.scores(numbers, inside)
    begin, end, own, upto = chains(first)
    for at in range(0, len(begin), 4096):
        part = slice(at, at + 4096)
        rows, lengths, order = padded(scores, begin[part], end[part])
        p, _, _ = forward_backward(rows, lengths, field.pairs)
        place = begin[part][order][:, None] + np.arange(p.shape[1])
        counts = (place >= own[part][order][:, None]) & (place < upto[part][order][:, None])
        out[place[counts]] = p[counts]
    return out


def distinct_uses(number: np.ndarray, inside: np.ndarray, at: np.ndarray, n_words: int) -> np.ndarray:
    """Between how many pairs of neighbours each word stands, over the positions ``at``."""
    last = len(number) - 1
    before = np.where(inside[at], number[np.maximum(at - 1, 0)], -1)
    after = np.where((at < last) & inside[np.minimum(at + 1, last)], number[np.minimum(at + 1, last)], -1)
    found = np.unique(np.stack([number[at], before, after], axis=1), axis=0)
    return np.bincount(found[:, 0], minlength=n_words).astype(float)


def train_field(hashes: np.ndarray, first: np.ndarray, toxic_rows: np.ndarray) -> Field | None:
    """Label the tokens of the sampled rows and fit the chain to them by its marginals."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    words, number = np.unique(hashes, return_inverse=True)
    inside = np.ones(len(hashes), dtype=bool)
    inside[first[:-1][np.diff(first) > 0]] = False
    of_word, of_row = np.divmod(np.unique(number * len(toxic_rows) + row), len(toxic_rows))
    in_toxic = np.bincount(of_word[toxic_rows[of_row]], minlength=len(words)).astype(float)
    in_clean = np.bincount(of_word[~toxic_rows[of_row]], minlength=len(words)).astype(float)
    n_toxic, n_clean = max(toxic_rows.sum(), 1), max((~toxic_rows).sum(), 1)
    chance = n_toxic * (in_clean + 1) / n_clean

    def tells(in_toxic: np.ndarray) -> np.ndarray:
        lift = ((in_toxic + 0.1) / n_toxic) / ((in_clean + 1) / n_clean)
        return (in_toxic >= LEAST_DOCS) & (lift >= LEAST_LIFT) & (in_toxic - chance >= 4 * np.sqrt(chance))

    likely = tells(in_toxic)
    uses = distinct_uses(number, inside, np.flatnonzero(likely[number] & toxic_rows[row]), len(words))
    marked = likely & tells(np.minimum(in_toxic, uses))
    # Copies tell too where nothing else does and they are many: words of rows without a marked one.
    open_rows = toxic_rows & (np.bincount(row, weights=marked[number], minlength=len(toxic_rows)) == 0)
    in_open = np.bincount(of_word[open_rows[of_row]], minlength=len(words)).astype(float)
    marked |= tells(in_open) & (in_open >= COPIES_SHARE * n_toxic)
    if not marked.any():
        return None
    label = (marked[number] & toxic_rows[row]).astype(float)
    # Weights go to marked words and to the most frequent others.
    use = np.argsort(-(marked * 1e12 + in_toxic + in_clean), kind="stable")[:MAX_WORDS]
    use = np.sort(use[(in_toxic + in_clean)[use] >= 3])
    known = words[use]
    # Chains with marked words, and every eighth of the others, which counts for eight.
    begin, end, _, _ = chains(first)
    sums = np.concatenate([[0], np.cumsum(label)])
    held = np.concatenate([[0], np.cumsum(marked[number])])
    told = (sums[end] > sums[begin]) | (held[end] > held[begin])
    keep = told | (np.arange(len(begin)) % 8 == 0)
    counts_for = np.where(told, 1.0, 8.0)[keep]
    begin, end = begin[keep], end[keep]
    size = len(known) + 1
    theta = {"weights": np.zeros((3, size)), "bias": np.array([-4.0]), "pairs": np.zeros((2, 2))}
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in theta.items()}
    field = Field(known, theta["weights"], -4.0, theta["pairs"])
    numbers = field.numbers(hashes)
    number_rows, lengths, order = padded(numbers, begin, end)
    number_rows = number_rows.astype(np.int64)
    label_rows, _, _ = padded(label, begin, end)
    valid = np.arange(number_rows.shape[1]) < lengths[:, None]
    previous = np.where(valid, np.pad(number_rows, ((0, 0), (1, 0)))[:, :-1], 0)
    following = np.where(np.pad(valid, ((0, 0), (0, 1)))[:, 1:], np.pad(number_rows, ((0, 0), (0, 1)))[:, 1:], 0)
    counts_for = counts_for[order]
    n_tokens = (valid * counts_for[:, None]).sum()
    true = label_rows.astype(np.int64)
    steps = valid[:, 1:]
    true_pairs = np.zeros((2, 2))
    np.add.at(true_pairs, (true[:, :-1][steps], true[:, 1:][steps]), np.broadcast_to(counts_for[:, None], steps.shape)[steps])
    for step in range(1, STEPS + 1):
        w = theta["weights"]
        scores = theta["bias"][0] + w[0][number_rows] + w[1][previous] + w[2][following]
        p, both, _ = forward_backward(scores, lengths, theta["pairs"], counts_for)
        miss = np.where(valid, p - label_rows, 0) * counts_for[:, None] / n_tokens
        g = np.stack([np.bincount(f.ravel(), miss.ravel(), minlength=size) for f in (number_rows, previous, following)])
        g[1:, 0] = 0
        g[0, 0] = 0
        grads = {"weights": g + DECAY * w / size, "bias": np.array([miss.sum()]), "pairs": (both - true_pairs) / n_tokens}
        for k, grad in grads.items():
            m, v = moments[k]
            m[:], v[:] = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return Field(known, theta["weights"], float(theta["bias"][0]), theta["pairs"])


def raw_scores(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-odds that some word of each text is toxic."""
    sums = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)))])
    none = sums[first[1:]] - sums[first[:-1]]
    return np.log(np.maximum(-np.expm1(none), 1e-12)) - none


def features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What the curve is drawn over: the log-odds, the logarithm of the number of words, and 1."""
    raw = np.clip(raw_scores(p, first), -30, 30)
    return np.stack([raw, np.log1p(np.diff(first)), np.ones(len(raw))], axis=1)


class Model:
    def __init__(self, field: Field, curve: np.ndarray):
        self.field, self.curve = field, curve

    def score(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text and marginal of each word."""
        p = marginals(self.field, hashes, first)
        z = features(p, first) @ self.curve
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), p


def calibrate(x: np.ndarray, toxic: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic curve by Newton steps with a ridge; a step is halved until the loss falls.

    The ridge draws towards the log-odds as they are. The weight of the log-odds is not negative.
    """
    start = np.zeros(x.shape[1])
    start[0] = 1.0
    pull = np.full(len(start), ridge)
    pull[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - toxic * z)).sum() + 0.5 * (pull * (w - start) ** 2).sum())

    w = start
    for _ in range(100):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (s - toxic)) + pull * (w - start)
        curvature = (x * (weight * s * (1 - s))[:, None]).T @ x + np.diag(pull)
        step, now = np.linalg.solve(curvature, gradient), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        w = w - step
    w[0] = max(w[0], 0.05)
    return w


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    allowed = F.coalesce(fold(FOLDS) != HELD_OUT, F.lit(False))
    known = labels.filter(allowed & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fits = docs.filter(F.length("text") <= LONGEST)
    known = known.join(fits.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = least_hashed(known.filter("toxic = 1"), SAMPLE).unionByName(least_hashed(known.filter("toxic = 0"), SAMPLE))
    totals = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bytescan.slices(whole)):
            hashes, first = word_hashes(batch.column("text"))
            rows = pa.LargeListArray.from_arrays(pa.array(first), bytescan.longs(hashes)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("toxic"), rows], names=["place", "toxic", "words"])

    # Rows, not ids, are bounded: an id may have any number of rows.
    met = fits.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text", F.xxhash64("doc_id", "text").alias("place"))
    rows = [met.filter(F.col("toxic") == label).orderBy("place", "text").limit(SAMPLE) for label in (0, 1)]
    if len(totals) < 2:
        return None

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sampled = None, list(batches)
        if sum(batch.num_rows for batch in sampled):
            found = pa.Table.from_batches(sampled).sort_by([("place", "ascending"), ("toxic", "ascending")])
            model = fitted(found.combine_chunks(), totals)
        if model is not None:
            field = model.field
            parts = (field.words, field.weights, field.bias, field.pairs, model.curve)
            yield pa.record_batch([pa.array([pickle.dumps(parts)], pa.binary())], names=["model"])

    # Two bounded samples: one task fits the model to them, and only the model reaches the driver.
    sample = rows[0].unionByName(rows[1]).mapInArrow(read, "place long, toxic int, words array<long>")
    found = sample.repartition(1).mapInArrow(fit, "model binary").first()
    if found is None:
        return None
    *parts, curve = pickle.loads(found["model"])
    return Model(Field(*parts), curve)


def fitted(found: pa.Table, totals: dict[int, int]) -> Model | None:
    """The model of the sampled rows; ``totals`` are the rows of each label that they stand for."""
    words = found.column("words").combine_chunks()
    sizes = words.value_lengths().fill_null(0).to_numpy()
    toxic = found.column("toxic").to_numpy() == 1
    for_curve = np.arange(len(toxic)) % CURVE_SHARE == 0

    def part(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        taken = words.filter(pa.array(use)).flatten().to_numpy().view(np.uint64)
        return taken, np.concatenate([[0], np.cumsum(sizes[use])])

    field = train_field(*part(~for_curve), toxic[~for_curve])
    if field is None:
        return None
    hashes, first = part(for_curve)
    told = toxic[for_curve]
    # The samples are drawn by label; weights restore the share of each label.
    weight = np.where(told, totals[1] / max(told.sum(), 1), totals[0] / max((~told).sum(), 1))
    x = features(marginals(field, hashes, first), first)
    return Model(field, calibrate(x, told.astype(float), weight / weight.sum() * len(weight)))


SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])


def toxic_spans(texts: pa.Array, hot: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """Runs of tagged words of each text, from the first character of the first to the end of the last."""
    data, offsets = bytescan.utf8(texts)
    start, end, _, _ = bytescan.words(_MARKS_TO_BLANKS[data], offsets)
    # Characters before each byte: all bytes but those that continue one.
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    opens = hot.copy()
    opens[1:] &= ~hot[:-1]
    closes = hot.copy()
    closes[:-1] &= ~hot[1:]
    border = first[(first > 0) & (first < len(hot))]  # a run does not pass from text to text
    opens[border] |= hot[border]
    closes[border - 1] |= hot[border - 1]
    opens, closes = np.flatnonzero(opens), np.flatnonzero(closes)
    row = np.searchsorted(first, opens, side="right") - 1
    base = characters[offsets[row]]
    begin, until = characters[start[opens]] - base, characters[end[closes]] - base
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for r, a, b in zip(row.tolist(), begin.tolist(), until.tolist()):
        out[r].append({"begin": a, "end": b})
    return out


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, and ``offending``: (begin, end) in characters of each run of words that are tagged toxic."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bytescan.slices(whole, size=SLICE)):
            if model is None:
                scores, spans = np.zeros(batch.num_rows), [[]] * batch.num_rows
            else:
                hashes, first = word_hashes(batch.column("text"))
                scores, p = model.score(hashes, first)
                spans = toxic_spans(batch.column("text"), p >= 0.5, first)
            offending = pa.array(spans, pa.list_(SPAN))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), offending], names=["doc_id", "score", "offending"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, "doc_id long, score double, offending array<struct<begin: long, end: long>>")


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows whose own text has a score below ``least``, whatever their doc_id."""
    model = train(docs, labels)
    if model is None:
        return docs

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bytescan.slices(whole, size=SLICE)):
            scores, _ = model.score(*word_hashes(batch.column("text")))
            yield batch.filter(pa.array(scores < least))

    return docs.mapInArrow(read, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select(
        "doc_id",
        F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "offending",
    )
