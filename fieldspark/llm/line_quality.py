"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. What a line looks like, and what its two neighbours look
like, votes for either label; a pair weight says how likely labels follow each other.
Forward and backward sums give each line's probability of being good, and a
document's quality is their mean, weighted by the lines' lengths, put on a
probability scale by a logistic fit.

The model is fitted on a bounded sample of labelled rows, whose lines all take the
document's label; every document is scored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.llm.common import (
    bound_batches,
    ids_and_texts,
    iterate_batches,
    map_batches,
    mix,
    text_bytes,
)

# At most so many labelled documents are learned from, those with the smallest hash
# of their id, with all their lines.
SAMPLE_DOCS = 4000
BATCH = 2 << 20
STEPS = 120
FEATURES = (
    "one upper digit point symbol space repeat repeat_two length ending marked lone shout "
    "short"
).split()
GOOD = 1
BASE = np.uint64(0xBF58476D1CE4E5B9)
CLASSES = ("upper", "letter", "digit", "point", "symbol", "space")


def _byte_classes():
    classes = np.zeros((len(CLASSES), 256), dtype=bool)
    for b in range(256):
        c = chr(b)
        classes[0, b] = b < 128 and c.isupper()
        classes[1, b] = b >= 128 or c.isalpha()
        classes[2, b] = b < 128 and c.isdigit()
        classes[3, b] = c in ".,;:?'\"()-"
        classes[4, b] = b < 128 and 32 < b and not c.isalnum() and c not in ".,;:?'\"()-"
        classes[5, b] = b in (9, 10, 11, 12, 13, 32)
    return classes


BYTE_CLASSES = _byte_classes()


def line_features(column):
    """Features of all lines of an Arrow column of texts, the number of lines of each
    text, and the lines' lengths. A text has one line more than it has line feeds."""
    data, starts = text_bytes(column)
    n_texts = len(starts) - 1
    # Lines: cut behind every text and at every line feed.
    feeds = np.flatnonzero(data == 10)
    per_text = np.searchsorted(feeds, starts[1:]) - np.searchsorted(feeds, starts[:-1]) + 1
    begins = np.sort(np.concatenate([feeds + 1, starts[:-1]]), kind="stable")
    line_text = np.repeat(np.arange(n_texts), per_text)
    ends = np.concatenate([begins[1:], starts[-1:]])
    last = np.cumsum(per_text) - 1
    ends[last] = starts[1:]
    inner = np.ones(len(begins), dtype=bool)
    inner[last] = False
    ends[inner] -= 1

    def between(flags):
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[ends] - sums[begins]).astype(np.float64)

    size = (ends - begins).astype(np.float64)
    counts = {name: between(BYTE_CLASSES[i][data]) for i, name in enumerate(CLASSES)}
    # Words: runs of other bytes than white space, cut at the ends of texts.
    solid = ~BYTE_CLASSES[5][data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = True
    head = solid & np.concatenate([[True], ~solid[:-1]]) if len(data) else solid
    head |= solid & edge[:-1]
    tail = solid & np.concatenate([~solid[1:], [True]]) if len(data) else solid
    tail |= solid & edge[1:]
    first, after = np.flatnonzero(head), np.flatnonzero(tail) + 1
    hashes = _word_hashes(data, first, after)
    in_line = np.searchsorted(begins, first, side="right") - 1
    words = np.bincount(in_line, minlength=len(begins)).astype(np.float64)

    def share(flags):
        return np.bincount(in_line, weights=flags, minlength=len(begins)) / np.maximum(words, 1)

    def same_as(back):
        flags = np.zeros(len(first))
        flags[back:] = (hashes[back:] == hashes[:-back]) & (in_line[back:] == in_line[:-back])
        return flags

    final = data[after - 1] if len(first) else np.zeros(0, np.uint8)
    letters = np.concatenate([[0], np.cumsum(BYTE_CLASSES[1][data])])
    some_letter = letters[after] > letters[first]
    at_end = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(len(begins), np.uint8)
    ending = np.isin(at_end, np.frombuffer(b".?!:;", np.uint8)) & (size > 0)
    whole = np.maximum(size, 1)
    columns = {
        "one": np.ones(len(begins)),
        "upper": counts["upper"] / np.maximum(counts["letter"], 1),
        "digit": counts["digit"] / whole,
        "point": 10 * counts["point"] / whole,
        "symbol": 5 * counts["symbol"] / whole,
        "space": 5 * counts["space"] / whole,
        "repeat": share(same_as(1)),
        "repeat_two": share(same_as(2)),
        "length": np.log1p(size) / 5,
        "ending": ending.astype(float),
        "marked": share(BYTE_CLASSES[4][final]),
        "lone": share(~some_letter),
        "shout": (counts["upper"] > 0.5 * np.maximum(counts["letter"], 1)).astype(float),
        "short": (size < 20).astype(float),
    }
    return np.stack([columns[f] for f in FEATURES], axis=1), per_text, size, line_text


def _word_hashes(data, first, after):
    """A hash of each word; arithmetic wraps at 64 bits."""
    if not len(first):
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(len(data) + 1, BASE, dtype=np.uint64))
    sums = np.concatenate(
        [np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])]
    )
    inverse = np.cumprod(np.full(len(data) + 1, pow(int(BASE), -1, 1 << 64), dtype=np.uint64))
    return mix((sums[after] - sums[first]) * inverse[first])


def with_neighbours(features, per_text):
    """Each line's features beside those of the line before and the line after it in
    the same text, zeros where there is none."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    ends = np.cumsum(per_text)
    before[ends[:-1]] = 0
    before[:1] = 0
    after[ends - 1] = 0
    return np.concatenate([features, before, after], axis=1)


class Chains:
    """Lines of many texts laid out so that one step handles a line of every text.

    Texts are ordered by length, longest first: the texts that still have a line at
    step t are the first ``alive[t]``.
    """

    def __init__(self, per_text):
        self.order = np.argsort(-per_text, kind="stable")
        self.n = per_text[self.order]
        self.steps = int(self.n[0]) if len(self.n) else 0
        self.alive = np.searchsorted(-self.n, -np.arange(1, self.steps + 1), side="right")
        self.start = (np.cumsum(per_text) - per_text)[self.order]

    def sums(self, votes, pair):
        """Log probability of both labels per line, of both labels of neighbouring
        lines (at the later line), and each text's log normaliser, by text order."""
        forward, backward = np.zeros_like(votes), np.zeros_like(votes)
        for t in range(self.steps):
            here = self.start[: self.alive[t]] + t
            forward[here] = votes[here]
            if t:
                came = forward[here - 1][:, :, None] + pair[None]
                forward[here] += np.logaddexp(came[:, 0], came[:, 1])
        for t in range(self.steps - 2, -1, -1):
            here = self.start[: self.alive[t + 1]] + t
            goes = (backward[here + 1] + votes[here + 1])[:, None, :] + pair[None]
            backward[here] = np.logaddexp(goes[:, :, 0], goes[:, :, 1])
        total = forward + backward
        norm = np.logaddexp(total[:, 0], total[:, 1])
        return forward, backward, total - norm[:, None], norm


def fit(features, per_text, labels, steps=STEPS, penalty=1e-3):
    """Weights of the field: maximum likelihood of the line labels, by Adam steps."""
    x = with_neighbours(features, per_text)
    centre = x.mean(axis=0)
    spread = x.std(axis=0)
    centre[spread < 1e-9], spread[spread < 1e-9] = 0, 1
    x = (x - centre) / spread
    line_label = np.repeat(labels, per_text)
    chains = Chains(per_text)
    first_line = np.cumsum(per_text) - per_text
    later = np.ones(len(x), dtype=bool)
    later[first_line] = False
    later = np.flatnonzero(later)
    weight = np.repeat(1 / per_text, per_text)
    params = np.zeros(x.shape[1] + 4)
    truth = np.eye(2)[line_label]
    pair_truth = np.zeros((2, 2))
    np.add.at(pair_truth, (line_label[later - 1], line_label[later]), weight[later])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        pair = params[-4:].reshape(2, 2)
        score = x @ params[:-4]
        votes = np.stack([np.zeros_like(score), score], axis=1)
        forward, backward, marginal, norm = chains.sums(votes, pair)
        slope = x.T @ (weight * (truth[:, 1] - np.exp(marginal[:, 1])))
        both = (
            forward[later - 1][:, :, None]
            + pair[None]
            + (votes[later] + backward[later])[:, None, :]
            - norm[later][:, None, None]
        )
        pair_slope = pair_truth - (weight[later][:, None, None] * np.exp(both)).sum(axis=0)
        gradient = np.concatenate([slope, pair_slope.ravel()]) / len(per_text) - penalty * params
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        params += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {"centre": centre, "spread": spread, "weights": params[:-4], "pair": params[-4:].reshape(2, 2)}


def line_marginals(model, features, per_text):
    """Probability of being good, per line."""
    x = (with_neighbours(features, per_text) - model["centre"]) / model["spread"]
    score = x @ model["weights"]
    _, _, marginal, _ = Chains(per_text).sums(
        np.stack([np.zeros_like(score), score], axis=1), model["pair"]
    )
    return np.exp(marginal[:, GOOD])


def text_quality(marginals, per_text, sizes):
    """Mean of the lines' marginals weighted by length; empty lines weigh a byte."""
    ends = np.cumsum(per_text)
    weight = sizes + 1
    total = np.concatenate([[0], np.cumsum(weight * marginals)])
    whole = np.concatenate([[0], np.cumsum(weight)])
    return (total[ends] - total[ends - per_text]) / (whole[ends] - whole[ends - per_text])


def fit_scale(quality, labels):
    """Intercept and slope of a logistic fit of labels to quality, slightly penalised
    so that separable or one-sided labels give finite numbers."""
    z = np.stack([np.ones(len(quality)), quality - 0.5], axis=1)
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(z @ beta)))
        hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag([0.01, 0.05])
        beta += np.linalg.solve(hessian, z.T @ (labels - p) - np.array([0.01, 0.05]) * beta)
    return beta


def train(docs, labels, sample_docs=SAMPLE_DOCS, steps=STEPS):
    """A model from labelled documents, None if there are none.

    ``labels`` holds ``doc_id`` and ``quality``; rows with a null in either, or with
    a quality other than 0 and 1, do not count, and of several labels of one id the
    smallest does. At most ``sample_docs`` documents reach the driver, as features of
    all their lines; of rows that share an id one does, chosen by a hash of its text.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_docs)
    )
    texts = ids_and_texts(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality")
    # Each task cuts its rows to one an id before they are shuffled.
    turn = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    texts = texts.withColumn("_turn", turn).where("_turn = 1").drop("_turn")

    def extract(batch):
        features, per_text, size, _ = line_features(batch.column(1))
        ends = np.cumsum(per_text)
        kept = [slice(e - n, e) for e, n in zip(ends, per_text, strict=True)]
        return {
            "doc_id": batch.column(0),
            "quality": batch.column(2),
            "features": [features[k].astype(np.float32).tobytes() for k in kept],
            "sizes": [size[k].tobytes() for k in kept],
        }

    rows = map_batches(texts, extract, "doc_id long, quality int, features binary, sizes binary", BATCH)
    rows = sorted(rows.collect(), key=lambda r: r.doc_id)
    if not rows:
        return None
    parts = [np.frombuffer(r.features, np.float32).reshape(-1, len(FEATURES)) for r in rows]
    features = np.concatenate(parts).astype(np.float64)
    per_text = np.array([len(p) for p in parts])
    sizes = np.concatenate([np.frombuffer(r.sizes, np.float64) for r in rows])
    target = np.array([r.quality for r in rows])
    model = fit(features, per_text, target, steps)
    model["scale"] = fit_scale(text_quality(line_marginals(model, features, per_text), per_text, sizes), target)
    return model


def _scores(model, column):
    features, per_text, size, _ = line_features(column)
    if model is None:
        return np.full(len(per_text), 0.5)
    quality = text_quality(line_marginals(model, features, per_text), per_text, size)
    intercept, slope = model["scale"]
    return 1 / (1 + np.exp(-(intercept + slope * (quality - 0.5))))


def score(docs, model):
    """``doc_id, score`` of every row: how likely its label is 1.

    One pass, no shuffle. A null text scores as an empty one: a single empty line.
    Without a model (no labelled rows) every score is 0.5. Null ids and repeated
    rows stay as they are; an empty table gives an empty result.
    """
    return map_batches(
        ids_and_texts(docs),
        lambda batch: {"doc_id": batch.column(0), "score": _scores(model, batch.column(1))},
        "doc_id long, score double",
        BATCH,
    )


def keep_good(docs, model, threshold=0.5, text_col="text"):
    """The rows of ``docs``, all their columns, whose score reaches ``threshold``."""
    place = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(place).fill_null("")
                yield batch.filter(pa.array(_scores(model, texts) >= threshold))

    bound_batches(docs.sparkSession, BATCH)
    return docs.mapInArrow(keep, docs.schema)


def line_labels(docs, model):
    """``doc_id, line, good`` for every line: the marginal of label good."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                features, per_text, _, text = line_features(batch.column(1))
                first = np.cumsum(per_text) - per_text
                ids = np.array(batch.column(0).to_pylist(), dtype=object)
                good = line_marginals(model, features, per_text)
                yield {
                    "doc_id": ids[text].tolist(),
                    "line": np.arange(len(text)) - first[text],
                    "good": good,
                }

    return iterate_batches(ids_and_texts(docs), run, "doc_id long, line long, good double", BATCH)
