"""Byte-pair encoding by backtracking, and decoding through an offset table.

Merge rules give every token but the single symbols one pair of parents. A sequence of tokens is what the merges would
have made exactly if each adjacent pair is compatible: undoing the later merge of the two, again and again, never
uncovers a pair across the seam that the rules would have merged earlier. So a word is encoded in linear time: at each
place take the longest token that an Aho-Corasick automaton finds there, check it against the token before it, fall
back to the longest token that is a prefix of it, and give up the token before it when none is left; a bit for each
place remembers the dead ends, so that no place is tried twice.

Normalisation and the split into words are those of the tokenizer file. Null texts are encoded as the empty text, which
has no tokens. Very long words take the same path and are kept out of the cache. Repeated rows give repeated rows; other
columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, slices, table, texts_of

#: Added to the code of a word's last symbol: `a` at a word's end is another symbol than `a` within it.
END = 0x1000
#: Bytes of codes that a worker keeps, those of an entry besides key and value, and the longest chunk kept; they bound its
#: memory, not what it encodes.
CACHE_BYTES, SLOT, CACHE_CHARS = 72 << 20, 110, 48

#: Compatible and incompatible pairs that a worker keeps; ids decoded at a time.
KNOWN_PAIRS, STRETCH = 200_000, 1 << 16

CHUNK = re.compile(r"[^ \n\r\t]+")


class BacktrackEncoder:
    """Tokens of a word, given the vocabulary's strings by id and the merges in order of rank."""

    def __init__(self, strings: list[str], pairs: dict[tuple[int, int], int]):
        """strings: each token as symbols. pairs: the token that merging two tokens makes; later merges have larger ids."""
        self.strings, self.pairs = strings, pairs
        self.parents = [(i, i) for i in range(len(strings))]
        for (left, right), made in pairs.items():
            if self.parents[made] == (made, made):
                self.parents[made] = (left, right)
        self.sizes = [len(s) for s in strings]
        self.index = {s: i for i, s in enumerate(strings) if s}
        self.finder = ahocorasick.Automaton()
        for i, s in enumerate(strings):
            # a token whose own string the merges encode otherwise never occurs in a result
            if s and self.whole(i):
                self.finder.add_word(s[::-1], i)
        self.finder.make_automaton()
        self.shorter = [self.prefix(i) for i in range(len(strings))]
        self.known: dict[int, bool] = {}

    def whole(self, token: int) -> bool:
        left, right = self.parents[token]
        return left == token or self.compatible(left, right, token)

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether the merges leave `left` next to `right`. below: only merges that come before this token count."""
        pairs, parents = self.pairs, self.parents
        bound = len(parents) if below is None else below
        while True:
            made = pairs.get((left, right))
            if made is not None and made < bound:
                return False
            if left > right:
                inner = parents[left][1]
                if inner != left:
                    bound, left = min(bound, left), inner
                    continue
                inner = parents[right][0]
                if inner == right:
                    return True
                bound, right = min(bound, right + 1), inner
            else:
                inner = parents[right][0]
                if inner != right:
                    bound, right = min(bound, right + 1), inner
                    continue
                inner = parents[left][1]
                if inner == left:
                    return True
                bound, left = min(bound, left), inner

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of `token` and can occur; -1 if none."""
        s = self.strings[token]
        for n in range(len(s) - 1, 0, -1):
            i = self.index.get(s[:n], -1)
            if i >= 0 and self.whole(i):
                return i
        return -1

    def encode(self, word: str) -> list[int]:
        last, sizes, known, shorter = len(word) - 1, self.sizes, self.known, self.shorter
        # at each place of the reversed word the automaton gives the longest match first
        longest = dict(reversed(list(self.finder.iter(word[::-1])))).get
        token, at, before = longest(last, -1), 0, -1
        if token >= 0 and sizes[token] > last:
            return [token]
        dead: set[int] = set()
        out: list[int] = []
        while at <= last:
            if token < 0:
                if not out:
                    raise ValueError(f"no token sequence spells {word[:50]!r}")
                dead.add(at)
                at -= sizes[before]
                token = shorter[out.pop()]
                before = out[-1] if out else -1
                continue
            end = at + sizes[token]
            if end not in dead:
                fits = before < 0 or known.get(before << 24 | token)
                if fits is None:
                    if len(known) >= KNOWN_PAIRS:
                        known.clear()
                    fits = known[before << 24 | token] = self.compatible(before, token)
                if fits:
                    out.append(token)
                    at, before = end, token
                    token = longest(last - at, -1)
                    continue
            token = shorter[token]
        return out


class OffsetTable:
    """The strings of all tokens end to end, and where each begins: decoding is gathering bytes by place."""

    def __init__(self, strings: list[str], between: str):
        blob = [(s + between).encode() for s in strings]
        self.cut = len(between.encode())
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.offsets = np.array([0, *accumulate(map(len, blob))], np.int64)

    def padded(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens, each followed by the separator."""
        parts = []
        for at in range(0, len(ids), STRETCH):
            some = ids[at : at + STRETCH]
            starts = self.offsets[some]
            sizes = self.offsets[some + 1] - starts
            ends = np.cumsum(sizes)
            # each byte's place: its token's, and how far it is behind the token's first byte
            places = np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])
            parts.append(self.blob[places].tobytes())
        return b"".join(parts)

    def decoded(self, ids) -> bytes:
        """UTF-8 of the tokens with the separator between them."""
        found = self.padded(np.asarray(ids, np.int64))
        return found[: len(found) - self.cut] if found and self.cut else found

    def decode(self, ids) -> str:
        return self.decoded(ids).decode("utf-8", "replace")


def little_endian(ids: list[int]) -> bytes:
    codes = array("I", ids)
    if sys.byteorder == "big":
        codes.byteswap()
    return codes.tobytes()


class Recent:
    """Codes made lately, within a number of bytes: when the young generation has half of them it becomes the old one, and
    what is asked for stays young."""

    def __init__(self, room: int = CACHE_BYTES):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.room, self.used = room // 2, 0

    def get(self, key: str) -> bytes | None:
        made = self.young.get(key)
        if made is None and (made := self.old.get(key)) is not None:
            self.put(key, made)
        return made

    def put(self, key: str, made: bytes) -> None:
        self.used += sys.getsizeof(key) + sys.getsizeof(made) + SLOT
        if self.used > self.room:
            # the dictionary itself stays, as loops hold on to it
            self.old = dict(self.young)
            self.young.clear()
            self.used = 0
        self.young[key] = made


#: Letters, then marks that are no apostrophe and don't begin a special token.
TAIL = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:;=-@\[-`{-~]+)")
#: Printable ASCII and Latin letters that are precomposed and lower-case alike everywhere.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
LATIN = re.compile(rf"[!-~{LETTERS}]+")


def latin_splitter(spec: dict) -> re.Pattern | None:
    """The split pattern for texts of LATIN; None if the file normalises or splits otherwise.

    There NFC changes nothing and letters and digits are known, so that no Unicode tables are needed.
    """
    kinds = [x["type"] for x in spec["normalizer"].get("normalizers", [])]
    steps = spec["pre_tokenizer"].get("pretokenizers", [])
    if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"]:
        return None
    pattern = steps[0]["pattern"]["Regex"].replace(r"\p{L}", LETTERS).replace(r"\p{N}", "0-9")
    return None if r"\p" in pattern else re.compile(pattern)


def byte_symbols() -> list[str]:
    """The symbol of each byte: visible Latin-1 characters stand for themselves, others follow from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


class WordTokenizer:
    """A tokenizer file with word-end symbols: its normaliser and splitter, with the merges done by backtracking."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, library = spec["model"], Tokenizer.from_file(path)
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or spec.get("decoder") is not None:
            raise ValueError("a BPE file with word ends and without a decoder is needed")
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        names = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for s, i in [*vocab.items(), *self.added.items()]:
            names[i] = s

        def symbols(s: str) -> str:
            if not s.endswith(suffix) or s == suffix:
                return s
            s = s[: -len(suffix)]
            return s[:-1] + chr(ord(s[-1]) + END)

        strings = ["" if n in self.added and i == self.added[n] else symbols(n) for i, n in enumerate(names)]
        pairs = {}
        for rule in model["merges"]:
            a, b = rule.split(" ") if isinstance(rule, str) else rule
            pairs.setdefault((vocab[a], vocab[b]), vocab[a + b])
        self.encoder, self.table = BacktrackEncoder(strings, pairs), OffsetTable(names, " ")
        self.recent = Recent()
        self.latin = latin_splitter(spec)
        self.symbols = byte_symbols()

    def word(self, word: str) -> bytes:
        """One word as the splitter gives it."""
        # a word of plain small letters is its own chunk; no chunk holds a line end
        key = word if word.isascii() and word.isalpha() else "\n" + word
        made = self.recent.get(key)
        if made is None:
            made = little_endian(self.encoder.encode(word[:-1] + chr(ord(word[-1]) + END)))
            if len(word) <= CACHE_CHARS:
                self.recent.put(key, made)
        return made

    def plain(self, text: str) -> bytes:
        """A text without special tokens."""
        if self.latin and LATIN.fullmatch(text):
            words = self.latin.findall(text.lower())
            if not text.isascii():
                words = [w if w.isascii() else "".join(map(self.symbols.__getitem__, w.encode())) for w in words]
        else:
            words = [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text)) if w]
        return b"".join([self.word(w) for w in words])

    def chunk(self, text: str) -> bytes:
        """A chunk without white space."""
        tail = None
        if self.latin:
            if text.isascii() and text.isalpha():
                low = text.lower()
                return self.word(text) if low == text else self.kept(text, self.word(low))
            tail = TAIL.fullmatch(text)
        if tail:
            # letters and the marks behind them are never one word
            made = b"".join([self.recent.get(t) or self.chunk(t) for t in tail.groups()])
        elif self.special and any(x in text for x in self.added):
            made = b"".join([little_endian([i]) if (i := self.added.get(x)) is not None else self.plain(x) for x in self.special.split(text) if x])
        else:
            made = self.plain(text)
        return self.kept(text, made)

    def kept(self, text: str, made: bytes) -> bytes:
        if len(text) <= CACHE_CHARS:
            self.recent.put(text, made)
        return made

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian 32-bit integers.

        No token spans white space and normalising never joins across it, so a text is the sum of its chunks.
        """
        get, older, make = self.recent.young.get, self.recent.get, self.chunk
        return b"".join([get(c) or older(c) or make(c) for c in CHUNK.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that ids, as `encode` gives them, stand for."""
        return self.table.decoded(np.frombuffer(ids, "<u4"))


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """For each row: its id, n_tokens, ids (array of int) if keep_ids, ids_sha256, decoded_sha256."""
    out = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), *([("ids", pa.list_(pa.int32()))] if keep_ids else []), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    state = ("bpe", vocabulary)

    def run(batches):
        coder = held(state, lambda: WordTokenizer(vocabulary))
        for batch in slices(batches, holding=state):
            coded = [coder.encode(t) for t in texts_of(batch.column(1))]
            counts = np.array([len(c) // 4 for c in coded], np.int64)
            columns = [batch.column(0), pa.array(counts)]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32))))
            columns.append(pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()))
            columns.append(pa.array([hashlib.sha256(coder.decode(c)).hexdigest() for c in coded], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    ids = "ids array<int>, " if keep_ids else ""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id long, n_tokens long, {ids}ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
