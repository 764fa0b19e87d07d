"""Language identification by unigram pieces, summed over all segmentations.

The pieces are a fixed public vocabulary. Each language gives every piece a probability, estimated by expectation-
maximisation on all words of all labelled texts: a forward-backward pass over the lattice of all segmentations of a word yields
expected counts. Words are counted first; many different ones stay in a table, over which each round is an aggregation. A text's likelihood in a language is the product over its words of the sum over all
segmentations, by the forward algorithm; the prediction is the language with the largest posterior. Words are runs of
letters, in lower case; they are scored once per worker and kept, within a bound, and lattices of many words are worked
on together in numpy.

Null texts and texts without a letter are `und` with score 0. Rows with a null language are never learned from. If
nothing can be learned from, every text is `und`. Any other column may hold nulls; ids may repeat or be null. An empty
table gives no rows. A column of the input that has the name of a new one is kept with underscores before its name.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, drop_written, held, release, slices, table, written

LETTERS = re.compile(r"[^\W\d_]+")
#: Rounds of estimation; pseudo-count.
ROUNDS, PSEUDO = 4, 0.05
#: Different words (by language) that the driver estimates from by itself; words that a task counts before it passes them on.
DRIVER_WORDS, COUNTED = 200_000, 200_000
#: Values that the driver sorts for a quantile; ranges that it counts in at once.
SORTED, RANGES = 10_000, 1024
#: Words that a worker keeps, and the length up to which words are worked on together.
CACHE_WORDS, SHORT = 250_000, 48
#: Words whose lattices are in memory together while probabilities are estimated.
WORDS_AT_ONCE = 10_000
#: The fit of a text: nats added for short texts; the quantile of fits of labelled texts, and nats a letter below it, at which
#: texts count as explained by no language.
ALLOWANCE, LOW_FIT, FIT_MARGIN = 20.0, 0.01, 2.0
#: Probabilities are scaled by this for each letter, so that products over a short word stay in range.
SCALE = 24.0


class Pieces:
    """Finds the vocabulary's pieces in words; letters that no piece covers are pieces of their own, all alike."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        kept = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.names = [model.id_to_piece(i) for i in kept]
        self.size = len(self.names) + 1
        self.longest = max(map(len, self.names))
        self.lengths = np.array([*map(len, self.names), 1], np.int64)
        self.shifts = self.longest.bit_length(), self.size.bit_length()
        # a tree of the pieces' letters: node 0 is none, letter 0 is in no piece
        letters = {c: k for k, c in enumerate(sorted(set().union(*self.names)), 1)}
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        tree: dict[tuple[int, int], int] = {}
        ends = {}
        for i, name in enumerate(self.names):
            node = 0
            for c in name:
                node = tree.setdefault((node, letters[c]), len(tree) + 1)
            ends[node] = i
        self.piece = np.full(len(tree) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        above, by = np.array(list(tree), np.int64).reshape(-1, 2).T
        below = np.arange(1, len(tree) + 1, dtype=np.int32)
        self.first = np.zeros(len(letters) + 1, np.int32)
        self.first[by[above == 0]] = below[above == 0]
        self.inner = np.zeros(len(tree) + 1, bool)
        self.inner[above] = True
        self.inner[0] = False
        # its steps from the second level on, by hash: each at the first slot that is free
        keys, below = (above * len(self.first) + by)[above > 0], below[above > 0]
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.below = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at = self.slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.below[at[free]] = keys[free], below[free]
            keys, below, at = (np.delete(x, free) for x in (keys, below, at))
            at = at + 1 & (1 << self.bits) - 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where a step is looked for first."""
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def down(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes below by these letters, 0 for none."""
        keys = nodes * np.int64(len(self.first)) + letters
        at = self.slots(keys)
        found = self.keys[at]
        same = found == keys
        out = np.where(same, self.below[at], 0)
        rest = np.flatnonzero(~same & (found >= 0))
        while len(rest):
            at[rest] = at[rest] + 1 & (1 << self.bits) - 1
            found = self.keys[at[rest]]
            same = found == keys[rest]
            out[rest[same]] = self.below[at[rest[same]]]
            rest = rest[~same & (found >= 0)]
        return out

    def arcs(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """End, start and piece of every match in a text of words between line ends, which no piece holds, by end, then start."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.append(self.letter[codes], np.int32(0))
        by_length, by_piece = self.shifts
        starts, node = np.arange(len(codes)), self.first[letters[:-1]]
        found, length = [], 0
        bare = np.flatnonzero((codes != 10) & (self.piece[node] < 0))
        found.append((bare + 1 << by_length | self.longest - 1) << by_piece | self.size - 1)
        # all starts go down the tree together, a letter at a time
        while len(starts):
            length += 1
            piece = self.piece[node]
            hit = np.flatnonzero(piece >= 0)
            found.append((starts[hit] + length << by_length | self.longest - length) << by_piece | piece[hit])
            on = np.flatnonzero(self.inner[node])
            starts = starts[on]
            following = letters[starts + length]
            node = self.down(node[on], following)
            on = np.flatnonzero(node)
            starts, node = starts[on], node[on]
        arcs = np.concatenate(found)
        arcs.sort()
        ids = arcs & (1 << by_piece) - 1
        arcs >>= by_piece
        ends = arcs >> by_length
        return ends, ends + (arcs & (1 << by_length) - 1) - self.longest, ids


class Lattices:
    """The lattices of many short words, as arrays: a node before each letter, and one at the line end behind a word."""

    def __init__(self, pieces: Pieces, words: list[str]):
        self.lengths = np.array([len(w) + 1 for w in words], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        self.last = self.base[:-1] + self.lengths
        self.ends, self.starts, self.ids = pieces.arcs("".join([f"▁{w}\n" for w in words]))
        place = np.arange(self.base[-1]) - np.repeat(self.base[:-1], self.lengths + 1)
        self.place = place
        self.forward_steps = self.steps(self.ends, place)

    @staticmethod
    def steps(nodes: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each place in a word in turn: its arcs by node, where each node's arcs begin, and the nodes."""
        if not len(nodes):
            return []
        order = np.lexsort((nodes, place[nodes]))
        sorted_nodes = nodes[order]
        cuts = np.flatnonzero(np.diff(place[sorted_nodes])) + 1
        out = []
        for arcs in np.split(order, cuts):
            own = nodes[arcs]
            begins = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
            out.append((arcs, begins, own[begins]))
        return out

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """Sums over the ways to each node; weights: pieces x languages."""
        alpha = np.zeros((self.base[-1], weights.shape[1]))
        alpha[self.base[:-1]] = 1.0
        for arcs, begins, nodes in self.forward_steps:
            alpha[nodes] = np.add.reduceat(alpha[self.starts[arcs]] * weights[self.ids[arcs]], begins, axis=0)
        return alpha

    def backward(self, weights: np.ndarray) -> np.ndarray:
        beta = np.zeros((self.base[-1], weights.shape[1]))
        beta[self.last] = 1.0
        for arcs, begins, nodes in self.steps(self.starts, self.place)[::-1]:
            beta[nodes] = np.add.reduceat(beta[self.ends[arcs]] * weights[self.ids[arcs]], begins, axis=0)
        return beta


class Scorer:
    """Log-likelihoods of words in each language."""

    def __init__(self, pieces: Pieces, probabilities: np.ndarray):
        self.pieces, self.p = pieces, probabilities
        self.scaled = probabilities * SCALE ** pieces.lengths[:, None]
        self.index: dict[str, int] = {}
        self.known = np.zeros((CACHE_WORDS, probabilities.shape[1]))

    def short(self, words: list[str]) -> np.ndarray:
        lattices = Lattices(self.pieces, words)
        sums = lattices.forward(self.scaled)[lattices.last]
        return np.log(sums) - (lattices.lengths * np.log(SCALE))[:, None]

    def long(self, word: str) -> np.ndarray:
        """One word of any length: sums are scaled down as they go, so they neither vanish nor overflow."""
        word, back = "▁" + word, self.pieces.longest
        alpha, logs = np.zeros((len(word) + 1, self.p.shape[1])), np.zeros(self.p.shape[1])
        alpha[0] = 1.0
        done = 0
        for e, s, i in zip(*(x.tolist() for x in self.pieces.arcs(word)), strict=True):
            if e > done and done and done % 32 == 0:
                window = alpha[max(0, done - back) : done + 1]
                top = window.max(0)
                window /= top
                logs += np.log(top)
            done = e
            alpha[e] += alpha[s] * self.p[i]
        return np.log(alpha[len(word)]) + logs

    def scores(self, texts: list[str]) -> list[np.ndarray | None]:
        """For each text the sum over its words and, last, its letters; None for texts without any. Words are learned for
        many texts at a time."""
        out: list[np.ndarray | None] = []
        letters: list[int] = []
        waiting: list[tuple[int, list[str]]] = []
        room = at_once = CACHE_WORDS // 4

        def settle() -> None:
            if not waiting:
                return
            places = self.learn([w for _, words in waiting for w in words])
            begins = np.cumsum([0, *(len(words) for _, words in waiting[:-1])])
            for (k, _), total in zip(waiting, np.add.reduceat(self.known[places], begins), strict=True):
                out[k] = out[k] + total
            waiting.clear()

        for k, text in enumerate(texts):
            words = LETTERS.findall(text.lower())
            letters.append(sum(map(len, words)))
            out.append(np.zeros(self.p.shape[1]) if words else None)
            if words and max(map(len, words)) > SHORT:
                for w in words:
                    if len(w) > SHORT:
                        out[k] = out[k] + self.long(w)
                words = [w for w in words if len(w) <= SHORT]
            for at in range(0, len(words), at_once):
                part = words[at : at + at_once]
                if len(part) > room:
                    settle()
                    room = at_once
                waiting.append((k, part))
                room -= len(part)
        settle()
        return [None if x is None else np.append(x, n) for x, n in zip(out, letters, strict=True)]

    def learn(self, words: list[str]) -> np.ndarray:
        """Makes the words known, and says where; all that were known before go if there is no room."""
        places = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(places < 0)
        lost = [words[i] for i in missing.tolist()]
        new = list(set(lost))
        if len(self.index) + len(new) > CACHE_WORDS:
            self.index.clear()
            missing, lost, new = np.arange(len(words)), words, list(set(words))
        if new:
            at = len(self.index)
            self.known[at : at + len(new)] = self.short(new)
            self.index.update(zip(new, range(at, at + len(new)), strict=True))
            places[missing] = np.fromiter(map(self.index.__getitem__, lost), np.int64, len(lost))
        return places


def pieces_of(path: str) -> Pieces:
    return held(("pieces", path), lambda: Pieces(path))


def expected_counts(pieces: Pieces, p: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Pieces x languages: how often each is expected in words that are there so many times; counts: words x languages."""
    weights, expected = p * SCALE ** pieces.lengths[:, None], np.zeros_like(p)
    # lattices of some words at a time, made anew each round, so that memory doesn't follow the words
    for at in range(0, len(words), WORDS_AT_ONCE):
        lattices = Lattices(pieces, words[at : at + WORDS_AT_ONCE])
        alpha, beta = lattices.forward(weights), lattices.backward(weights)
        share = counts[at : at + WORDS_AT_ONCE] / alpha[lattices.last]
        owner = np.searchsorted(lattices.base, lattices.ends, "right") - 1
        for k in range(p.shape[1]):
            arcs = alpha[lattices.starts, k] * weights[lattices.ids, k] * beta[lattices.ends, k] * share[owner, k]
            expected[:, k] += np.bincount(lattices.ids, arcs, pieces.size)
    return expected


def smoothed(expected: np.ndarray) -> np.ndarray:
    return (expected + PSEUDO) / (expected.sum(0) + PSEUDO * len(expected))


def estimate(pieces: Pieces, counts: dict[str, Counter], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities, a column for each language, from the languages' word counts."""
    langs, words = list(counts), list({w for c in counts.values() for w in c if len(w) <= SHORT})
    p = np.full((pieces.size, len(langs)), 1.0 / pieces.size)
    matrix = np.array([[c.get(w, 0) for c in counts.values()] for w in words], float)
    for _ in range(rounds if words else 0):
        p = smoothed(expected_counts(pieces, p, words, matrix))
    return p


def estimate_from_table(words: DataFrame, vocabulary: str, langs: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """The same from a table lang, word, n; each round is an aggregation, of which a row for each piece and language comes back."""
    spark, size = words.sparkSession, pieces_of(vocabulary).size
    place = {k: i for i, k in enumerate(langs)}
    p = np.full((size, len(langs)), 1.0 / size)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(p)

        def run(batches, shared=shared):
            total = np.zeros_like(shared.value)
            # each language's words by themselves: few words are in several
            for batch in slices(batches, len(langs) * WORDS_AT_ONCE, holding=("pieces", vocabulary)):
                for lang, k in place.items():
                    own = batch.filter(pc.equal(batch.column(0), lang))
                    counts = own.column(2).to_numpy().astype(float)[:, None]
                    if len(counts):
                        total[:, k] += expected_counts(pieces_of(vocabulary), shared.value[:, k : k + 1], own.column(1).to_pylist(), counts)[:, 0]
            piece, k = total.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(k), pa.array(total[piece, k])], names=["piece", "k", "x"])

        found = words.mapInArrow(run, "piece long, k long, x double").groupBy("piece", "k").agg(F.sum("x").alias("x")).toArrow()
        expected = np.zeros_like(p)
        expected[found["piece"].to_numpy(), found["k"].to_numpy()] = found["x"].to_numpy()
        p = smoothed(expected)
        shared.destroy()
    return p


def labelled_rows(docs: DataFrame, where, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.where(where).where("lang is not null and text is not null")


def learn(docs: DataFrame, vocabulary: str, where, id_col="doc_id", text_col="text", lang_col="lang") -> dict:
    """The model: languages, their shares, piece probabilities, from all rows that may be learned from, which are `where`."""
    rows = labelled_rows(docs, where, id_col, text_col, lang_col)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "vocabulary": vocabulary}

    def count(batches):
        found: dict[str, Counter] = {}

        def flat():
            flat = [(k, w, n) for k, c in found.items() for w, n in c.items()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = LETTERS.findall(text.lower())
                # longer words by stretches, so that scripts without spaces are learned from as well
                if words and max(map(len, words)) > SHORT:
                    words = [w[at : at + SHORT] for w in words for at in range(0, len(w), SHORT)]
                found.setdefault(lang, Counter()).update(words)
                if sum(map(len, found.values())) > COUNTED:
                    yield flat()
        yield flat()

    words = rows.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(words, "language-words")
    if words.count() > DRIVER_WORDS:
        p = estimate_from_table(words, vocabulary, langs)
    else:
        counts = {k: Counter() for k in langs}
        few = words.toArrow()
        for lang, word, n in zip(*(few[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
            counts[lang][word] = n
        p = estimate(pieces_of(vocabulary), counts)
        del few, counts
    drop_written(words)
    total = sum(sizes.values())
    release()
    return {"langs": langs, "prior": np.array([sizes[k] / total for k in langs]), "p": p, "vocabulary": vocabulary}


def predict(docs: DataFrame, model: dict, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score", fit_name: str | None = None) -> DataFrame:
    """The rows with the predicted language and its posterior probability, and, if it has a name, the fit.

    The fit is the text's log-likelihood a letter in the predicted language, after an allowance for short texts: unlike the
    posterior it is low where no language explains the text. It is null without letters or languages. Columns of the input
    that have one of these names are kept with underscores before it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: list[Scorer] = []

    def run(columns):
        model = shared.value
        langs = model["langs"]
        if langs and not state:
            state.append(Scorer(pieces_of(model["vocabulary"]), model["p"]))
        names, scores, fits = [], [], []
        for total in state[0].scores([x or "" for x in columns[0].to_pylist()]) if langs else [None] * len(columns[0]):
            if total is None:
                names.append("und")
                scores.append(0.0)
                fits.append(None)
            else:
                total, letters = total[:-1], total[-1]
                fits.append(float((total.max() + ALLOWANCE) / letters))
                total = total + np.log(model["prior"])
                odds = np.exp(total - total.max())
                k = int(total.argmax())
                names.append(langs[k])
                scores.append(float(odds[k] / odds.sum()))
        made = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
        return [*made, pa.array(fits, pa.float64())] if fit_name else made

    fields = f"`{lang_name}` string, `{score_name}` double" + (f", `{fit_name}` double" if fit_name else "")
    return appended(docs, [text_col], fields, run, holding=("pieces", model["vocabulary"]))


def exact_quantile(values: DataFrame, quantile: float) -> float | None:
    """The quantile of the one column, between neighbours as `percentile` has it; None without values. Values are counted in
    ever narrower ranges, so neither a task nor the driver holds them all."""
    x = F.col(values.columns[0])
    values = values.where(x.isNotNull())
    n, low, high = values.agg(F.count("*"), F.min(x), F.max(x)).first()
    if not n:
        return None
    rank = int(quantile * (n - 1))
    part = quantile * (n - 1) - rank
    before = 0
    while low < high:
        inside = values.where((x >= low) & (x <= high))
        if n <= SORTED:
            low = sorted(r[0] for r in inside.collect())[rank - before]
            break
        cell = F.least(F.lit(RANGES - 1), F.floor((x - low) / (high - low) * RANGES))
        for _, count, least, most in sorted(map(tuple, inside.groupBy(cell.alias("cell")).agg(F.count("*"), F.min(x), F.max(x)).collect())):
            if before + count > rank:
                n, low, high = count, least, most
                break
            before += count
    if not part:
        return low
    up_to, after = values.agg(F.count_if(x <= low), F.min(F.when(x > low, x))).first()
    return low if up_to > rank + 1 else low + part * (after - low)


def least_fit(docs: DataFrame, model: dict, where, id_col="doc_id", text_col="text", lang_col="lang", quantile: float = LOW_FIT, margin: float = FIT_MARGIN, fit_col: str | None = None) -> float | None:
    """The fit below which no learned language explains a text: a margin under what nearly all labelled texts reach; None
    if there are no languages. fit_col: the column of fits, if `predict` has made it already."""
    if not model["langs"]:
        return None
    if fit_col is None:
        fits = written(predict(labelled_rows(docs, where, id_col, text_col, lang_col).select("text"), model, fit_name="fit").select("fit"), "language-fits")
    else:
        fits = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(fit_col).alias("fit"))
        fits = fits.where(where).where("lang is not null and text is not null").select("fit")
    low = exact_quantile(fits, quantile)
    return None if low is None else low - margin


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def op10_language(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs, public_tokenizers.path("piece_bpe_32k.model"), F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1, F.lit(False)))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
