"""BPE, fingerprints, language ID, quality: one row for each row, whatever the text."""

import hashlib
import random
import re
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vertexloom.llm import bpe, common, language, merkle, quality

from .conftest import CLASHING, DE, EN, FR, rows_of

VOCABULARY, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_the_library(library):
    own, rng = bpe.WordTokenizer(VOCABULARY), random.Random(1)
    texts = ["", " ", "Hello, World!!", "it's we'll 'd x's", "<|endoftext|>a<|startoftext|> <|endoftext|", "a" * 3000, "ab" * 999, "the" * 700, "́a \x85 \x1c b", "ΑΣ ẞ İ ǅ ª² Ⅷ", "don't,stop.now;ok:", "x<y <|", "word### word,&&& a.b. 'tis"]
    texts += ["".join(rng.choice("abcdeéthnixyz'’s12! \n<|>") for _ in range(150)) for _ in range(150)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0xAC00, 0xD000), rng.randrange(0x10000, 0x20000)])) for _ in range(60)) for _ in range(150)]
    for text in texts:
        ids, by_ids, by_text = expected(library, text)
        packed = own.encode(text)
        assert packed == np.asarray(ids, "<u4").tobytes(), text
        assert hashlib.sha256(own.decode(packed)).hexdigest() == by_text, text


def test_backtracking_equals_merging():
    """Against the plain way: apply the earliest rule that fits until none does, over random rules."""
    rng = random.Random(3)
    for _ in range(60):
        strings = list("abc")
        pairs = {}
        for _ in range(rng.randrange(1, 12)):
            a, b = rng.randrange(len(strings)), rng.randrange(len(strings))
            if strings[a] + strings[b] not in strings:
                pairs[a, b] = len(strings)
                strings.append(strings[a] + strings[b])
        coder = bpe.BacktrackEncoder(strings, pairs)
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 25)))
            ids = ["abc".index(c) for c in word]
            while found := [(pairs[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]:
                made, k = min(found)
                ids[k : k + 2] = [made]
            assert coder.encode(word) == ids, (word, pairs)


def test_caches_turn_over(monkeypatch, library):
    monkeypatch.setattr(bpe, "KNOWN_PAIRS", 3)
    monkeypatch.setattr(bpe, "STRETCH", 7)
    own = bpe.WordTokenizer(VOCABULARY)
    own.recent = bpe.Recent(2000)
    text = EN + DE + FR
    for _ in range(2):
        ids, _, by_text = expected(library, text)
        assert own.encode(text) == np.asarray(ids, "<u4").tobytes()
        assert hashlib.sha256(own.decode(own.encode(text))).hexdigest() == by_text
    kept = [*own.recent.young.items(), *own.recent.old.items()]
    assert own.recent.old and sum(sys.getsizeof(k) + sys.getsizeof(v) + bpe.SLOT for k, v in kept) <= 2000 + 500


def test_a_worker_holds_one_state():
    made = common.held("a", lambda: [1])
    assert common.held("a", lambda: [2]) is made and common.held("b", lambda: [3]) == [3] and common.held("a", lambda: [4]) == [4]
    list(common.slices([], holding="a"))
    assert common.held("a", lambda: [5]) == [4]
    list(common.slices([]))
    assert common.held("a", lambda: [6]) == [6]


def test_offset_table():
    t = bpe.OffsetTable(["a", "bc", ""], " ")
    assert t.decode([1, 0, 2]) == "bc a " and t.decode([]) == ""


def test_bpe_rows(odd, crowded, empty, library):
    out = bpe.encode_documents(odd, VOCABULARY)
    found = {r["doc_id"]: r for r in out.collect()}
    for r in odd.collect():
        ids, by_ids, by_text = expected(library, r["text"])
        assert (found[r["doc_id"]]["ids"], found[r["doc_id"]]["ids_sha256"], found[r["doc_id"]]["decoded_sha256"]) == (ids, by_ids, by_text)
    assert out.count() == odd.count() and bpe.encode_documents(empty, VOCABULARY).count() == 0
    assert rows_of(bpe.encode_documents(crowded, VOCABULARY)) == rows_of(out)


def edits(rows):
    out = []
    for i, (_, text) in enumerate(rows):
        q = len(text) // 4
        out.append(text[: len(text) - q] + rows[(i + 1) % len(rows)][1][:q])
    return out


def test_neighbours_and_edits(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 2)
    monkeypatch.setattr(merkle, "CROWDED", 1)
    ids = [5, 6, 7, 8, 30, 31, 900, 901, 905, 10**7, -4, *range(2000, 2040), 9 * 10**18, -(1 << 63), (1 << 63) - 1]
    rows = sorted((i, f"{i} é\U0001f600" * (abs(i) % 7 + 1)) for i in ids)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = merkle.with_next(df, "doc_id", "text").withColumn("e", merkle.edited(F.col("text"), F.col("next"))).orderBy("id").collect()
    assert [r["next"] for r in out] == [t for _, t in rows[1:] + rows[:1]]
    assert [r["e"] for r in out] == edits(rows)


def test_no_range_is_crowded(spark, monkeypatch):
    """Ids far apart and close together, one id with many texts, no id with many texts, and equal rows."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", 4)
    monkeypatch.setattr(merkle, "CROWDED", 2)
    rows = [(i, f"t{i}") for i in range(200)] + [(9 * 10**18, "far"), (-(10**18), "low")] + [(77, f"x{k}") for k in range(60)] + [(None, f"n{k}") for k in range(60)] + [(500, "same")] * 30
    df = spark.createDataFrame(rows, "id long, text string").withColumn("tie", F.xxhash64("text"))
    parts = merkle.dealt(df)
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("id", "tie").alias("d")).collect()
    assert sum(r["n"] for r in sizes) == len(rows) and max(r["d"] for r in sizes) <= 8
    # ranges are in order as their rows are
    by_part = [(r["id"] is not None, r["id"] or 0, r["tie"]) for r in parts.orderBy("part", F.col("id").asc_nulls_first(), "tie").collect()]
    assert by_part == sorted(by_part)
    out = merkle.with_next(df, "id", "text")
    following = out.select("text", "next").collect()
    assert Counter(r["text"] for r in following) == Counter(r["next"] for r in following)


def test_odd_neighbours(odd, empty, spark):
    out = merkle.with_next(odd, "doc_id", "text")
    assert out.count() == odd.count() and out.where("next is null").count() == 0
    assert merkle.with_next(empty, "doc_id", "text").count() == 0
    alone = merkle.with_next(spark.createDataFrame([(3, "abcd")], "doc_id long, text string"), "doc_id", "text").first()
    assert alone["next"] == "abcd"


def prints(spark, *texts):
    return [r["f"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", merkle.fingerprint(F.col("text")).alias("f")).orderBy("i").collect()]


def likeness(spark, one, two):
    df = spark.createDataFrame([tuple(prints(spark, one, two))], "a string, b string")
    return df.select(merkle.likeness(F.col("a"), F.col("b"), merkle.leaves("a"), merkle.leaves("b")).alias("x")).first()["x"]


def test_fingerprints(spark):
    a, b, c = prints(spark, EN * 3 + "\n\n" + DE, EN * 3 + "\n\n" + DE, EN * 3 + "\n\n" + FR)
    assert a == b != c
    df = spark.createDataFrame([(a, c)], "a string, c string")
    # the first section is untouched, so only the second is named
    changed = df.select(merkle.changed_sections(F.col("a"), F.col("c")).alias("s"), merkle.changed_paragraphs(F.col("a"), F.col("c")).alias("p"), merkle.changed_leaves(F.col("a"), F.col("c")).alias("l")).first()
    # the blank line before the second section is a paragraph of both
    assert len(changed["s"]) == 1 and len(changed["p"]) == 1 and 1 <= len(changed["l"]) <= 3
    assert likeness(spark, EN * 3, EN * 3) == 1 and likeness(spark, EN, DE) == 0 and likeness(spark, "", "") == 1 and likeness(spark, "", EN) == 0
    parts = [f"Sentence number {i} says something else. " for i in range(40)]
    assert likeness(spark, "".join(parts), "".join(parts[:30]) + DE * 4) > 0.6
    assert 0 < likeness(spark, "ab. ab.", "ab. ab. ab.") < 1
    # very long stretches without a sentence end, and texts of marks only
    assert likeness(spark, "word " * 20_000, "word " * 19_999 + "end") > 0.7 and len(prints(spark, "...\n\n\n...")) == 1


def test_likeness_counts_repeats(spark):
    """Likeness is a share of the texts, not of the different passages in them."""
    again = "It says the same again. "
    assert likeness(spark, again * 90 + EN, again * 90 + DE) > 0.9
    # 10 and 40 passages of 24 code points, of which 10 are in both
    assert likeness(spark, again * 10, again * 40) == pytest.approx(0.4)
    found = spark.createDataFrame([(f,) for f in prints(spark, again * 3 + EN, "")], "f string").select(merkle.leaves("f").alias("x")).collect()
    assert [len(set(r["x"])) for r in found] == [len(r["x"]) for r in found] and [x.split("*")[0] for x in found[0]["x"]].count("3") == 1 and found[1]["x"] == []


def test_trees_against_brute_force(spark):
    """The tree, its top and the likeness, built again in Python over the tree's definition."""
    short = lambda b: hashlib.sha256(b.encode()).hexdigest()[:32]

    def passages(text, size):
        return re.findall(r"(?s)[^.!?]{1,%d}[.!?]*\s*|[.!?]+\s*|\s+" % size, text)

    def tree(text):
        sections, every = [], Counter()
        for section in re.split(r"\n(?=\n)", text):
            paragraphs = []
            for line in section.split("\n"):
                found = [f"{short(p)}:{len(p)}" for p in passages(line, 48)]
                every.update((x, int(x.split(":")[1])) for x in found)
                paragraphs.append(f"{short(','.join(found))}[{','.join(found)}]")
            sections.append(short(";".join(paragraphs)))
        fine = Counter((short(p), len(p)) for p in passages(text, 8)) if len(text) < 256 else None
        return "|".join([hashlib.sha256(",".join(sections).encode()).hexdigest(), *sections]), every, fine

    rng = random.Random(5)
    texts = ["", "a", EN, EN + DE, "\n\n\n", EN * 9 + "\n\n" + DE * 4 + "\n" + FR, "x y " * 90, "😀é. " * 70]
    texts += ["".join(rng.choice(["ab ", "c. ", "d! ", "\n", "é"]) for _ in range(rng.randrange(400))) for _ in range(12)]
    rows = spark.createDataFrame([(i, t, texts[i - 1]) for i, t in enumerate(texts)], "i int, t string, u string")
    rows = rows.select("i", merkle.fingerprint(F.col("t")).alias("a"), merkle.fingerprint(F.col("u")).alias("b"))
    for r in rows.select("i", merkle.summary(F.col("a")).alias("top"), merkle.likeness(F.col("a"), F.col("b"), merkle.leaves("a"), merkle.leaves("b")).alias("near")).collect():
        (top, one, fine), (other, two, finer) = tree(texts[r["i"]]), tree(texts[r["i"] - 1])
        one, two = (fine, finer) if fine is not None and finer is not None else (one, two)
        size = sum(n * k for c in (one, two) for (_, n), k in c.items())
        near = 1.0 if top == other else min(0.999999, 2 * sum(n * k for (_, n), k in (one & two).items()) / size)
        assert r["top"] == top and r["near"] == pytest.approx(near), texts[r["i"]]
    assert len({r["a"] for r in rows.collect()}) == len({tree(t)[0] for t in texts})


def test_short_texts_are_like_their_edits(spark):
    text = "Short words here now"
    assert likeness(spark, text, text[:15] + "xxxxx") >= 0.4


def test_paragraphs_are_cut_without_loss(spark):
    for text in (EN + DE, "a" * 1000, "?!... x", "1.5 and 2.5", " lead", "trail "):
        got = spark.createDataFrame([(text,)], "t string").select(F.filter(F.regexp_extract_all("t", F.lit(merkle.PASSAGE), 0), lambda x: x != "").alias("p")).first()["p"]
        assert "".join(got) == text and max(map(len, got)) < 1000


def test_language(spark, empty, odd, crowded):
    texts = [(i, t * 2, k) for i, (t, k) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr")] * 4)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = language.learn(docs, PIECES, F.lit(True))
    assert model["langs"] == ["de", "en", "fr"] and np.allclose(model["p"].sum(0), 1)
    out = language.predict(odd, model)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}
    assert [found[i][0] for i in (1, 3, 7)] == ["en", "de", "fr"] and all(found[i] == ("und", 0.0) for i in (4, 5, 6))
    assert all(0 <= s <= 1 for _, s in found.values()) and out.count() == odd.count()
    left = language.predict(crowded, model)
    assert left.count() == odd.count() and {"_lang_pred", "_score", "lang_pred", "score"} <= set(left.columns)
    assert left.select(F.col("_score")).distinct().first()[0] == "extra score"
    # null and equal ids are as good as any
    for same in (None, 50):
        again = language.learn(docs.withColumn("doc_id", F.lit(same).cast("long")), PIECES, F.lit(True))
        assert np.allclose(again["p"], model["p"])
    assert language.predict(empty, model).count() == 0
    none = language.learn(empty, PIECES, F.lit(True))
    assert {r["lang_pred"] for r in language.predict(odd, none).collect()} == {"und"}


def test_texts_in_no_language_that_is_taught(spark):
    texts = [(i, t * 2, k) for i, (t, k) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr")] * 4)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = language.learn(docs, PIECES, F.lit(True))
    least = language.least_fit(docs, model, F.lit(True))
    others = ["The lower fields", "La rivière", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. " * 3, "qzx wvk jjq xxz pqv kkzw qqj " * 9, "Все люди рождаются свободными и равными " * 3]
    found = language.predict(spark.createDataFrame([(i, t) for i, t in enumerate([*others, "12", None])], "i int, text string"), model, fit_name="fit").orderBy("i").collect()
    assert [r["fit"] is not None and r["fit"] >= least for r in found] == [True, True, False, False, False, False, False]
    assert found[5]["fit"] is None and language.least_fit(docs, {"langs": []}, F.lit(True)) is None


def test_all_words_are_learned_from(spark, monkeypatch):
    """Rare words of a language with few texts, beside many frequent ones of another, and words of any length."""
    seen = {}

    def kept(pieces, counts):
        seen.update(counts)
        return np.full((pieces.size, len(counts)), 1.0 / pieces.size)

    monkeypatch.setattr(language, "estimate", kept)
    many = ["".join(chr(97 + k // 26**p % 26) for p in range(4)) for k in range(150_001)]
    docs = spark.createDataFrame([(1, " ".join(many * 2), "en"), (2, "wort " + "漢" * 60, "zz")], "doc_id long, text string, lang string")
    language.learn(docs, PIECES, F.lit(True))
    assert len(seen["en"]) == 150_001 and seen["zz"] == {"wort": 1, "漢" * 48: 1, "漢" * 12: 1}


def test_no_labelled_text_is_left_out(spark, monkeypatch):
    """Far more texts of a language than a sample would have: all words count, on the driver or from a table, and all fits."""
    from collections import Counter

    seen = {}
    whole = language.estimate
    monkeypatch.setattr(language, "estimate", lambda pieces, counts: seen.update(counts) or whole(pieces, counts))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, DE).otherwise(EN).alias("text"), F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"))
    model = language.learn(docs, PIECES, F.lit(True))
    one = Counter(language.LETTERS.findall(EN.lower()))
    assert seen["en"] == {w: 2000 * n for w, n in one.items()}
    monkeypatch.setattr(language, "DRIVER_WORDS", 0)
    assert np.allclose(language.learn(docs, PIECES, F.lit(True))["p"], model["p"])
    # one text of 1,001 at the low end decides between neighbours, by fits that are there and by fits that are made
    odd = docs.limit(1).select("doc_id", F.lit("zzq xkv").alias("text"), "lang")
    some = docs.where("doc_id < 100").unionByName(odd)
    fits = language.predict(some, model, fit_name="fit")
    exact = fits.agg(F.percentile("fit", F.lit(0.005))).first()[0]
    assert language.least_fit(some, model, F.lit(True), quantile=0.005) == pytest.approx(exact - language.FIT_MARGIN)
    assert language.least_fit(fits, model, F.lit(True), quantile=0.005, fit_col="fit") == pytest.approx(exact - language.FIT_MARGIN)


def test_quantiles_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(language, "SORTED", 5)
    monkeypatch.setattr(language, "RANGES", 4)
    random = np.random.default_rng(3)
    for values in ([2.5], [1.0] * 30, random.normal(size=200).tolist(), [*random.integers(0, 4, 50).astype(float).tolist(), None, -1e9]):
        rows = spark.createDataFrame([(v,) for v in values], "x double")
        kept = [v for v in values if v is not None]
        for q in (0.0, 0.01, 0.5, 1.0):
            assert language.exact_quantile(rows, q) == pytest.approx(np.quantile(kept, q))
    assert language.exact_quantile(rows.where("x is null"), 0.5) is None


def test_forward_sums_all_segmentations():
    pieces = language.pieces_of(PIECES)
    p = np.random.default_rng(0).dirichlet(np.ones(pieces.size), 2).T
    scorer = language.Scorer(pieces, p)

    def brute(word):
        ends, starts, ids = (x.tolist() for x in pieces.arcs(word))
        total = [np.ones(2)] + [np.zeros(2) for _ in word]
        for e, s, i in zip(ends, starts, ids, strict=True):
            total[e] = total[e] + total[s] * p[i]
        return np.log(total[-1])

    words = ["theatre", "a", "ß", "漢字", "éa", "x" * 40]
    assert np.allclose(scorer.short(words), [brute("▁" + w) for w in words])
    assert np.allclose(scorer.long("theatre" * 5), scorer.short(["theatre" * 5])[0])
    # texts in one go, word by word, and with words of any length
    text = "theatre a ß theatre " + "y" * 300
    assert np.allclose(scorer.scores([text, "", "12"])[0][:-1], scorer.short(["theatre", "a", "ß", "theatre"]).sum(0) + scorer.long("y" * 300))
    assert scorer.scores(["", "12"]) == [None, None] and scorer.scores([text])[0][-1] == 16 + 300


def test_arcs_are_all_pieces_in_words_and_quicker_than_by_automaton():
    from itertools import chain
    from time import thread_time

    import ahocorasick

    pieces = language.pieces_of(PIECES)
    ids = {name: i for i, name in enumerate(pieces.names)}
    text = "".join(f"▁{w}\n" for w in ["theatre", "a", "日本語の", "𐍈x\ud800y", "ееё", "éa", "x" * 50, *DE.lower().split()]) + "▁"
    expected = []
    for end in range(1, len(text) + 1):
        near = [(end, start, ids[text[start:end]]) for start in range(max(0, end - pieces.longest), end) if text[start:end] in ids]
        bare = text[end - 1] != "\n" and text[end - 1] not in ids
        expected += near + [(end, end - 1, pieces.size - 1)] * bare
    assert list(zip(*(x.tolist() for x in pieces.arcs(text)), strict=True)) == expected

    finder = ahocorasick.Automaton()
    for name, i in ids.items():
        finder.add_word(name, i)
    finder.make_automaton()
    letters = np.random.default_rng(1).choice(list("etaoinshrdlucm"), (20_000, 8))
    text = "".join("▁" + "".join(w) + "\n" for w in letters)

    def took(f):
        times = []
        for _ in range(5):
            began = thread_time()
            f(text)
            times.append(thread_time() - began)
        return min(times)

    assert took(pieces.arcs) < 0.7 * took(lambda x: np.fromiter(chain.from_iterable(finder.iter(x)), np.int64))


def test_word_cache_turns_over(monkeypatch):
    pieces = language.pieces_of(PIECES)
    p = np.random.default_rng(0).dirichlet(np.ones(pieces.size), 2).T
    whole = language.Scorer(pieces, p).scores([EN, DE, FR])
    monkeypatch.setattr(language, "CACHE_WORDS", 16)
    assert np.allclose(language.Scorer(pieces, p).scores([EN, DE, FR]), whole)


def test_estimation_finds_the_language():
    pieces = language.pieces_of(PIECES)
    from collections import Counter

    counts = {"en": Counter(EN.lower().split()), "de": Counter(DE.lower().split())}
    p = language.estimate(pieces, counts)
    one = language.Scorer(pieces, p)
    assert one.scores(["the morning"])[0][:-1].argmax() == 0 and one.scores(["der morgen"])[0][:-1].argmax() == 1


JUNK = ["THE RIVER ROSE!! IN THE NIGHT!! " * 4, "river | rose | night | morning | lower | fields | water | again | under | were " * 3, "the&&& river### rose%%% in*** the$$$ night&&& " * 4, "rose rose rose rose rose rose rose rose " * 5]


def good_text(k):
    words = EN.split() + DE.split()
    rng = random.Random(k)
    return ". ".join(" ".join(rng.choice(words).strip(".").lower() + str(k % 7 or "") for _ in range(9)).capitalize() for _ in range(4 + k % 5)) + "."


def test_quality(spark, odd, crowded, empty):
    docs = spark.createDataFrame([(i, JUNK[i % 4] + JUNK[i % 4][: i % 11] if i % 5 == 0 else good_text(i)) for i in range(200)], "doc_id long, text string")
    model = quality.learn(docs)
    out = {r["doc_id"]: r for r in quality.classify(docs, model).collect()}
    assert np.mean([out[i]["keep"] == (i % 5 != 0) for i in out]) > 0.97
    found = quality.classify(odd, model)
    kept = {r["doc_id"]: r["keep"] for r in found.collect()}
    assert found.count() == odd.count() and not any(kept[i] for i in (4, 5, 6)) and kept[1]
    left = quality.classify(crowded, model)
    assert left.count() == odd.count() and {"keep", "_keep"} <= set(left.columns)
    # null and equal ids are as good as any
    for same in (None, 33, 50):
        again = quality.classify(docs, quality.learn(docs.withColumn("doc_id", F.lit(same).cast("long"))))
        assert np.mean([r["keep"] == (r["doc_id"] % 5 != 0) for r in again.collect()]) > 0.97
    nothing = quality.learn(empty)
    assert nothing["w"] is None and quality.classify(empty, nothing).count() == 0
    assert quality.classify(odd, nothing).count() == odd.count()


def test_quality_sends_the_driver_a_small_part_of_the_sample(spark, monkeypatch):
    texts = [JUNK[i % 4] + JUNK[i % 4][: i % 11] if i % 5 == 0 else good_text(i) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sent, features, fetch, fit = [], [], type(docs).toArrow, quality.fit_scorer
    monkeypatch.setattr(type(docs), "toArrow", lambda df: sent.append(fetch(df)) or sent[-1])
    monkeypatch.setattr(quality, "fit_scorer", lambda x, y: features.append(x.copy()) or fit(x, y))
    quality.learn(docs)
    assert len(sent) == 1 and len(sent[0]) == len(features[0]) == 200
    assert sent[0].nbytes < features[0].nbytes / 4
    # what the scorer is trained on are the whole shares all the same
    whole = np.array([quality.shares(t).astype(np.float32) * quality.GRAM_SCALE for t in texts], np.float32)
    assert sorted(map(bytes, features[0][:, : quality.BUCKETS])) == sorted(map(bytes, whole))


def test_labellers():
    names = quality.LABELLERS
    for text, name in zip(JUNK, ("upper", "bars", "marks", "runs"), strict=True):
        assert quality.votes(text)[names.index(name)] == "b", name
    assert "b" not in quality.votes(good_text(3)) and set(quality.votes("")) == {"-"} and len(quality.votes("é")) == len(names)


def test_labeller_accuracies_are_estimated():
    """Votes drawn from known rates: the posterior orders texts right."""
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.8
    wrong = [0.02, 0.05, 0.03, 0.02]
    right = [0.7, 0.6, 0.8, 0.5]
    cast = np.stack([np.where(good, rng.random(4000) < w, rng.random(4000) < r) for w, r in zip(wrong, right, strict=True)], 1)
    patterns = ["".join("b" if v else "g" for v in row) for row in cast]
    counts = {}
    for p in patterns:
        counts[p] = counts.get(p, 0) + 1
    posterior = quality.fit_labellers(counts)
    assert np.mean([(posterior[p] >= 0.5) == g for p, g in zip(patterns, good, strict=True)]) > 0.93


def test_kinds_of_bad_texts_that_one_labeller_knows():
    """A labeller whose bad votes never meet another's is believed, and accuracies are near those votes were drawn with."""
    rng, many = np.random.default_rng(1), len(quality.LABELLERS)
    counts = Counter()
    for _ in range(5000):
        kind = rng.integers(0, 4) if rng.random() < 0.2 else None
        counts["".join("b" if k == kind and rng.random() < 0.9 or rng.random() < 0.002 else "-" if rng.random() < 0.2 else "g" for k in range(many))] += 1
    posterior = quality.fit_labellers(dict(counts))
    assert all(posterior["g" * k + "b" + "g" * (many - 1 - k)] < 0.5 for k in range(4)) and posterior["g" * many] > 0.9
    found = quality.accuracies(dict(counts))
    assert all(g > 0.98 for _, g in found.values()) and all(0.1 < found[n][0] < 0.4 for n in quality.LABELLERS[:4]) and all(found[n][0] < 0.1 for n in quality.LABELLERS[5:])


def test_clashing_names_are_there(crowded):
    assert set(CLASHING) <= set(crowded.columns)
