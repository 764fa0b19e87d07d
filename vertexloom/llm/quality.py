"""Quality by weak labels: overlapping heuristics, expectation-maximisation, and a hashed linear scorer.

Heuristic labellers vote good (1), bad (0) or abstain (-1) on each text. What they vote over the whole corpus is counted
by pattern; from these counts expectation-maximisation estimates, without any true label, how often each labeller gives
each vote to good texts and to each kind of bad ones, and how many texts are good. The posterior of a pattern is the label
that the scorer learns: a logistic model over hashed byte 4-grams, as shares of the text, and hashed votes. It is trained
on a bounded sample and scores every whole text.

The decision is on the score: a text is kept at `threshold` or more. Null and empty texts, and texts of white space only,
get no votes, score 0 and are not kept. Equal texts get equal scores, ids aren't looked at but for the sample's hash, in
which the text takes part, so null, equal and repeated ids are as good as any. With no texts at all there is nothing to
learn from and no row. Columns of the input pass through; one that has the name of a new column is kept with underscores
before its name.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, release, table

#: Hash buckets; texts the scorer is trained on at most, half of them of each posterior; rounds of either estimation.
BUCKETS, SAMPLE, EM_ROUNDS, FIT_ROUNDS = 4096, 3000, 200, 300
#: What estimation begins with: the share of good texts, and how often a labeller calls one of them bad.
GOOD_SHARE, FALSE_ALARMS = 0.8, 0.01
#: Bytes of a text that are hashed at a time.
STRETCH = 1 << 18

MARKS = np.array([i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"-?()|!"])
ENDS = re.compile(r"[.!?](?=\s|$)")

LABELLERS = ("marks", "upper", "bars", "shouts", "repeats", "variety", "runs", "short_words", "sentences", "lines", "digits")


def votes(text: str) -> str:
    """A character for each labeller: g for good, b for bad, - for none."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    words = text.split()
    if not words:
        return "-" * len(LABELLERS)
    n = len(words)
    counts = np.bincount(data, minlength=256)
    visible = max(1, int(counts[33:].sum()))
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    letters = max(1, upper + lower)
    by_word: dict[str, int] = {}
    for w in words:
        by_word[w] = by_word.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    tops = max(by_word.values()) / n
    # different words grow about as the root of all words
    variety = len(by_word) / n**0.5
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    ends = len(ENDS.findall(text))
    shorts = sum(c for w, c in by_word.items() if len(w.strip(".,;:!?")) <= 3) / n

    def vote(good: bool, bad: bool, least: int) -> str:
        return "-" if n < least else "b" if bad else "g" if good else "-"

    share = int(counts[MARKS].sum()) / visible
    digits = int(counts[48:58].sum()) / visible
    caps = upper / letters
    bars = text.count("|") / n
    shouts = text.count("!") / n
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    return "".join(
        (
            vote(share < 0.03, share > 0.15, 1),
            vote(caps < 0.25, caps > 0.6, 1),
            vote(bars < 0.02, bars > 0.3, 1),
            vote(shouts < 0.1, shouts > 0.4, 1),
            vote(tops < 0.2, tops > 0.4, 20),
            vote(variety > 2.5, variety < 1.5, 20),
            vote(runs < 0.05, runs > 0.15, 10),
            vote(0.1 < shorts < 0.7, shorts < 0.02, 30),
            vote(ends > n / 80, ends == 0, 60),
            vote(repeated < 0.2, repeated > 0.6 and len(lines) > 5, 1),
            vote(digits < 0.1, digits > 0.35, 1),
        )
    )


def labeller_rates(counts: dict[str, int], rounds: int = EM_ROUNDS) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """The posterior of good for each pattern of votes, the shares of the kinds of text, and the labellers' rates by kind.

    counts: of patterns over the corpus. Bad texts are bad in different ways that exclude one another, so that labellers
    aren't independent among them: there is a kind for good texts, and one for each labeller, which begins with the texts
    that this labeller calls bad and learns what the others say of them. Within a kind labellers are independent. rates:
    kinds x labellers x (bad, good).
    """
    patterns = [p for p in counts if set(p) != {"-"}]
    many = len(patterns[0]) if patterns else len(LABELLERS)
    shares = np.array([GOOD_SHARE] + [(1 - GOOD_SHARE) / many] * many)
    begin = np.empty((many + 1, many, 2))
    begin[0], begin[1:] = (FALSE_ALARMS, 1 - FALSE_ALARMS), (0.1, 0.9)
    begin[np.arange(1, many + 1), np.arange(many)] = (0.95, 0.05)
    rates = begin.copy()
    if not patterns:
        return dict.fromkeys(counts, 0.0), shares, rates
    n = np.array([counts[p] for p in patterns], float)
    # patterns x labellers x votes; who abstains says nothing, else short texts would be a kind of their own
    cast = np.eye(3)[np.array([["bg-".index(c) for c in p] for p in patterns])][:, :, :2]
    # that labellers seldom call a good text bad is what good means here, so it weighs more than a few texts
    firm = np.array([2.0 + n.sum() / 300] + [2.0] * many)[:, None, None]
    floor = shares.copy()
    for _ in range(rounds):
        odds = np.log(shares) + np.einsum("pjv,kjv->pk", cast, np.log(rates))
        belongs = np.exp(odds - odds.max(1, keepdims=True))
        belongs /= belongs.sum(1, keepdims=True)
        weight = belongs * n[:, None]
        total = np.einsum("pk,pjv->kjv", weight, cast) + begin * firm
        rates = total / total.sum(2, keepdims=True)
        shares = (weight.sum(0) + floor) / (n.sum() + 1)
    return dict.fromkeys(counts, 0.0) | dict(zip(patterns, belongs[:, 0].tolist(), strict=True)), shares, rates


def fit_labellers(counts: dict[str, int], rounds: int = EM_ROUNDS) -> dict[str, float]:
    """The posterior of good for each pattern of votes; counts: of patterns over the corpus."""
    return labeller_rates(counts, rounds)[0]


def accuracies(counts: dict[str, int]) -> dict[str, tuple[float, float]]:
    """For each labeller the estimated shares of bad texts that it calls bad and of good ones that it calls good, of its
    votes."""
    _, shares, rates = labeller_rates(counts)
    bad = shares[1:] / shares[1:].sum()
    return {name: (float(bad @ rates[1:, i, 0]), float(rates[0, i, 1])) for i, name in enumerate(LABELLERS)}


def shares(text: str) -> np.ndarray:
    """The shares of a text's byte 4-grams by hash bucket, less for short texts, of which a few grams say little."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = np.zeros(BUCKETS)
    for at in range(0, len(data), STRETCH):
        h = grams(data[at : at + STRETCH + 3])
        out += np.bincount(h, minlength=BUCKETS)
    return out / (out.sum() + SHRINK)


def grams(data: np.ndarray) -> np.ndarray:
    """Hash buckets of all byte 4-grams."""
    if len(data) < 4:
        return np.empty(0, np.int64)
    x = data.astype(np.uint32)
    h = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24
    return ((h * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)


def vote_buckets(pattern: str) -> np.ndarray:
    """Buckets of the votes, behind those of the grams."""
    return np.array([BUCKETS + 2 * i + (c == "g") for i, c in enumerate(pattern) if c != "-"], np.int64)


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = FIT_ROUNDS, step: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights, the last the intercept, of a logistic model with soft labels; both labels count as much."""
    w, first, second = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    weight = np.where(y >= 0.5, 0.5 / max(1, (y >= 0.5).sum()), 0.5 / max(1, (y < 0.5).sum()))
    for t in range(1, rounds + 1):
        z = x @ w[:-1].astype(x.dtype) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        grad = np.concatenate([x.T @ error.astype(x.dtype), [error.sum()]]) + decay * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8) * (0.1 if t < 20 else 0.3)
    return w


#: Gram shares are small numbers; this brings them near the votes' ones. Grams that are added to a text's number of them.
GRAM_SCALE, SHRINK = 20.0, 200


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """Votes' posteriors and the scorer's weights. Votes are counted over all rows; the scorer sees at most `sample`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text)

    def count(batches):
        found: dict[str, int] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                p = votes(t)
                found[p] = found.get(p, 0) + 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["p", "n"])

    # at most 3 ** len(LABELLERS) patterns
    counted = rows.select("text").mapInArrow(count, "p string, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()
    counts = {r["p"]: r["n"] for r in counted}
    posterior = fit_labellers(counts)
    good = sum(n for p, n in counts.items() if posterior[p] >= 0.5)
    bad = sum(n for p, n in counts.items() if posterior[p] < 0.5 and set(p) != {"-"})
    if not good or not bad:
        return {"posterior": posterior, "w": None}
    share = {True: min(1.0, sample / 2 / good), False: min(1.0, sample / 2 / bad)}

    def pick(batches):
        for batch in batches:
            kept = []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # most rows go by their hash alone, without their votes
                if h >= max(share.values()):
                    continue
                p = votes(t)
                y = posterior.get(p, 0.0)
                if set(p) != {"-"} and h < share[y >= 0.5]:
                    # most shares are zero or one of a few values, so what the driver gets is a small part of them
                    kept.append((h / share[y >= 0.5], p, y, zlib.compress(shares(t).astype(np.float32).tobytes(), 1)))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], t) for i, t in enumerate((pa.float64(), pa.string(), pa.float64(), pa.binary()))], names=["h", "p", "y", "x"])

    # by a hash of the text too, so that rows with equal or null ids are drawn one by one; of each label about sample / 2 are
    # drawn, and what is beyond `sample` goes by the same hash
    u = (F.pmod(F.xxhash64("id", "text", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    taken = rows.select(u, "text").mapInArrow(pick, "h double, p string, y double, x binary").orderBy("h", "p", "x").limit(sample).toArrow()
    x = np.zeros((len(taken), BUCKETS + 2 * len(LABELLERS)), np.float32)
    for i, (p, features) in enumerate(zip(taken["p"].to_pylist(), taken["x"], strict=True)):
        x[i, :BUCKETS] = np.frombuffer(zlib.decompress(features.as_buffer()), np.float32) * GRAM_SCALE
        x[i, vote_buckets(p)] = 1.0
    y = taken["y"].to_numpy()
    del taken
    w = fit_scorer(x, y)
    del x
    release()
    return {"posterior": posterior, "w": w}


def classify(docs: DataFrame, model: dict, threshold: float = 0.5, text_col: str = "text", names=("quality_score", "weak_label", "keep")) -> DataFrame:
    """The rows with the scorer's probability of good, the weak label's posterior, and the decision."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns):
        posterior, w = shared.value["posterior"], shared.value["w"]
        scores, weak = [], []
        for text in columns[0].to_pylist():
            p = votes(text or "")
            label = posterior.get(p, 0.0)
            blank = not (text or "").strip()
            if blank or w is None:
                scores.append(0.0 if blank else label)
            else:
                data, total, n = np.frombuffer(text.encode("utf-8", "replace"), np.uint8), 0.0, 0
                for at in range(0, len(data), STRETCH):
                    h = grams(data[at : at + STRETCH + 3])
                    total, n = total + float(w.take(h).sum()), n + len(h)
                z = w[-1] + GRAM_SCALE * total / (n + SHRINK) + float(w[vote_buckets(p)].sum())
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -50, 50)))))
            weak.append(float(label))
        return [pa.array(scores, pa.float64()), pa.array(weak, pa.float64()), pa.array([s >= threshold for s in scores], pa.bool_())]

    return appended(docs, [text_col], f"`{names[0]}` double, `{names[1]}` double, `{names[2]}` boolean", run)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, learn(docs)).drop("text")
