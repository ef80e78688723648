"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one last token of its encoding. A token that ends at the prefix (found by an
automaton over all tokens, which reports every token that is a suffix of the text read so far) is that last token if the two
tokens around its start are compatible: merging their concatenation gives back exactly the two, which shows at the seam alone. Following the last
tokens backwards gives the ids of the word, in time linear in its length, whatever the order of merges.

The tokenizer file states the rules around the words: added tokens, normaliser, splitting pattern, end-of-word suffix. Those
of `word_bpe_49k.json` are supported: NFC, white space runs to one space, lower case, a removing split, the byte
alphabet. Decoding joins the tokens by a space, as a tokenizer without a decoder does.

Texts are cut at white space, at which a word always ends, and by the splitting pattern only where that leaves more than letters. A word's ids
are kept in a bounded cache; texts never leave their task.

Defined results: a null text is an empty text: no ids, empty text back; a very long text is encoded whole, word by word (its ids
are held by one task); a prefix has one last token only, so there are no ties; rows are never merged, and repeated ones get the same
ids; an empty table gives an empty result; other columns are not read, or pass through encode() as they are, one named like the new
column too.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm.common import documents, fresh_name, per_row, with_made

END = "</w>"
#: Stands for the end-of-word suffix inside the automaton; no character of the byte alphabet.
MARK = "\x01"
#: Words kept since the last change of generation; as many older ones may be held.
CACHED_WORDS = 100_000
CACHED_PAIRS = 200_000
SPACES = regex.compile(r"\s+")
#: White space to Python's split(), but not to the tokenizers library.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Lower case letters of Unicode 16 and 17, which the tokenizers library knows and Python 3.13 does not.
NEWER_CASE = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B} | {0x10D50 + k: 0x10D70 + k for k in range(22)} | {0x16EA0 + k: 0x16EBB + k for k in range(25)}


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character for each byte: itself if it is visible, else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class Recent(dict):
    """What `make` gives for a word, kept in two generations: words seen again move to the newer one, the others go."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str):
        if len(self) > CACHED_WORDS:
            self.older = self.copy()
            self.clear()
        if (known := self.older.get(word)) is None:
            known = self.make(word)
        self[word] = known
        return known


class WordBpe:
    """The encoder of one tokenizer file."""

    def __init__(self, file: str):
        given = json.loads(open(file, encoding="utf-8").read())
        model = given["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {x["id"]: x["content"] for x in given["added_tokens"]}
        self.added = {x["content"]: x["id"] for x in given["added_tokens"]}
        self.ranks = {tuple(x if isinstance(x, list) else x.split(" ")): k for k, x in enumerate(model["merges"])}
        self.split = regex.compile(given["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        newer = regex.escape(newer_letters())
        self.newer = frozenset(newer_letters())
        #: The pattern for texts with newer letters, which then count as neither letter nor number.
        self.split_newer = regex.compile(self.split.pattern.replace("[\\p{L}]", f"(?:(?![{newer}])\\p{{L}})").replace("[\\p{N}]", f"(?:(?![{newer}])\\p{{N}})").replace("[^\\s\\p{L}\\p{N}]", f"(?:[{newer}]|[^\\s\\p{{L}}\\p{{N}}])"))
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bytes = {b: c for b, c in enumerate(byte_alphabet())}
        self.halves = {x + y: (x, y, k) for (x, y), k in self.ranks.items()}
        self.after: dict[str, dict[str, int]] = {}
        for (x, y), k in self.ranks.items():
            self.after.setdefault(x, {})[y] = k
        self.spines: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            key = token[: -len(END)] + MARK if token.endswith(END) and len(token) > len(END) else token
            self.automaton.add_word(key, (i, len(key), token))
        self.automaton.make_automaton()
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        #: For a word of normalised text: number of ids, the ids and the tokens joined by spaces; the ids as 32-bit numbers.
        self.texts = Recent(lambda word: self.as_text(self.word_ids(self.letters(word))))
        self.numbers = Recent(lambda word: self.as_numbers(self.word_ids(self.letters(word))))

    def as_text(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), " ".join(map(self.tokens.__getitem__, ids))

    @staticmethod
    def as_numbers(ids: list[int]) -> bytes:
        return np.array(ids, np.int32).tobytes()

    def symbols(self, token: str) -> list[str]:
        """The symbols that merging starts from: characters, the last with the suffix if the token ends a word."""
        if token.endswith(END) and len(token) > len(END):
            return [*token[: -len(END) - 1], token[-len(END) - 1 :]]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """The definition: the pair of lowest rank is merged, leftmost first, until none is left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(x, 1 << 60), k) for k, x in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def stands(self, i: int) -> bool:
        """Whether a token is the encoding of its own text."""
        if (known := self.whole.get(i)) is None:
            known = self.whole[i] = self.merged(self.symbols(self.tokens[i])) == [self.tokens[i]]
        return known

    def spine(self, i: int, side: int) -> list[tuple[str, int]]:
        """The symbols that stand at a token's left (0) or right (1) edge while it is merged, each with the rank that ends it."""
        if (known := self.spines[side].get(i)) is None:
            known, token, end = [], self.tokens[i], 1 << 60
            while token is not None:
                known.append((token, end))
                halves = self.halves.get(token)
                token, end = (halves[side], halves[2]) if halves else (None, end)
            self.spines[side][i] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether b may follow a: no pair of symbols that meet at the seam is merged while both are there.

        A pair's rank is above the ranks of its symbols. Of two merges of one rank the left one is done first, so the seam gives
        way to a merge within a and goes before one within b.
        """
        if (known := self.pairs.get(a << 32 | b)) is None:
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            known, right = True, self.spine(b, 0)
            for x, x_end in self.spine(a, 1):
                rank = self.after.get(x)
                if rank is not None:
                    for y, y_end in right:
                        r = rank.get(y)
                        if r is not None and r < x_end and r <= y_end:
                            known = False
            self.pairs[a << 32 | b] = known
        return known

    def word_ids(self, word: str) -> list[int]:
        """The ids of one word, given in the byte alphabet without suffix."""
        text = word + MARK
        n = len(text)
        last: list[tuple[int, int] | None] = [None] * n  # by the end of the prefix: token and where it starts
        pairs, whole = self.pairs.get, self.whole.get
        for end, (i, size, _) in self.automaton.iter(text):
            if last[end] is not None or not (whole(i) or self.stands(i)):
                continue
            start = end + 1 - size
            if start:
                before = last[start - 1]
                if before is None:
                    continue
                fits = pairs(before[0] << 32 | i)
                if not (self.compatible(before[0], i) if fits is None else fits):
                    continue
            last[end] = (i, start)
        out, step = [], last[n - 1]
        while step is not None:
            out.append(step[0])
            step = last[step[1] - 1] if step[1] else None
        return out[::-1]

    def letters(self, word: str) -> str:
        """A word in the byte alphabet."""
        return word if word.isascii() and word.isprintable() else "".join(map(self.bytes.__getitem__, word.encode()))

    def words(self, text: str) -> list[str]:
        """The words of a text without added tokens, normalised."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # character by character: no final sigma
        text = text.lower()
        chunks = SPACES.split(text) if any(x in text for x in SEPARATORS) else text.split()
        out: list[str] = []
        for chunk in chunks:
            if chunk.isalpha():
                out.append(chunk)
            elif chunk.isascii():
                out += self.split.findall(chunk)
            else:
                chunk = chunk.translate(NEWER_CASE)
                out += (self.split if self.newer.isdisjoint(chunk) else self.split_newer).findall(chunk)
        return out

    def found(self, text: str, form: Recent, given: Callable[[list[int]], object]) -> list:
        """What form (texts or numbers) gives for the words of a text, and `given` for its added tokens, in order."""
        if self.split_added is None or "<|" not in text:
            return list(map(form.__getitem__, self.words(text)))
        out: list = []
        for part in self.split_added.split(text):
            if part in self.added:
                out.append(given([self.added[part]]))
            else:
                out += map(form.__getitem__, self.words(part))
        return out

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids and the decoded text (tokens), the last two joined by spaces."""
        found = self.found(text, self.texts, self.as_text)
        counts, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
        return sum(counts), " ".join(ids), " ".join(decoded)

    def id_array(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.found(text, self.numbers, self.as_numbers)), np.int32)

    def ids(self, text: str) -> list[int]:
        return self.id_array(text).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text that the tokenizer's decode gives for ids, special tokens included."""
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=1)
def newer_letters() -> str:
    """Characters that are letters or numbers to the regex module but, by its older Unicode tables, not to the tokenizers library."""
    from tokenizers import Regex, pre_tokenizers

    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    recent = [c for c in regex.findall(r"[\p{L}\p{N}]", everything) if unicodedata.category(c) == "Cn"]
    pieces = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str("".join(recent))
    return "".join(sorted(set(recent) - {x for x, _ in pieces}))


@lru_cache(maxsize=2)
def encoder(file: str) -> WordBpe:
    """One encoder per process and file."""
    return WordBpe(file)


def encode(docs: DataFrame, file: str | None = None, text: str = "text", name: str = "input_ids") -> DataFrame:
    """docs with an array column of token ids.

    A column of that name that docs already has stays as it is; the ids then take the next free name (with an underscore).
    """
    file = file or default_file()
    name = fresh_name(docs, name)

    def work(texts: list[bytes]) -> pa.Array:
        tokenizer = encoder(file)
        ids = [tokenizer.id_array(x.decode()) for x in texts]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))

    return with_made(docs, name, "array<int>", work, text)


def decode(rows: DataFrame, file: str | None = None, ids: str = "input_ids", name: str = "decoded") -> DataFrame:
    """rows with the text that an array column of ids stands for."""
    file = file or default_file()

    @F.pandas_udf("string")
    def texts(column):
        tokenizer = encoder(file)
        return pd.Series([tokenizer.decode(x if x is not None else []) for x in column])

    return rows.withColumn(name, texts(F.col(ids)))


def _digests(texts: list[bytes], file: str) -> dict[str, list]:
    tokenizer = encoder(file)
    out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    for text in texts:
        n, ids, decoded = tokenizer.encode(text.decode())
        out["n_tokens"].append(n)
        out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
    return out


def digests(docs: DataFrame, file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    file = file or default_file()
    return per_row(docs, ["doc_id", "text"], "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda x: _digests(x["text"], file)).drop("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
