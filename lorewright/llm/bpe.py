"""BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a word ends in exactly one token.  For each
prefix the automaton of all tokens names those that are its suffixes; the one
whose predecessor (the last token of the shorter prefix) is compatible with it
is stored.  Two tokens are compatible if no merge across their border comes
before the merges that made them.  Following the stored tokens back from the
end gives the ids, in time linear in the word, with no merge loop.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import runtime, textops

_END = "</w>"
_ENDED = 0x1000
#: Words that one worker remembers, in each of two generations.
REMEMBERED = 100_000
#: Texts of other characters are normalised and split by the library itself.
ODD = re.compile("[^\t\n\r -~¡-±´-¸º»¿-įı-ſ]")
#: The pattern of the vocabulary file, for the characters that ODD leaves.
_WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PrefixBPE:
    """Tokens, merges and the automaton of a vocabulary with word ends."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str = _END):
        self.end = end
        self.token = {i: t for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for n, merge in enumerate(merges):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((left, right), n)
            self.made.setdefault(whole, (n, left, right))
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            letters = self._letters(text)
            if len(letters) == 1 or i in self.made:
                self.automaton.add_word(letters, (len(letters), i))
        self.automaton.make_automaton()
        self.known: dict[tuple[int, int], bool] = {}

    def _letters(self, token: str) -> str:
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return body[:-1] + chr(ord(body[-1]) + _ENDED)
        return token

    def compatible(self, a: int, b: int) -> bool:
        """Whether a text that merges into a, before one that merges into b, stays so."""
        if (found := self.known.get((a, b))) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[a, b] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        none = (-1, a, b)
        before = len(self.rank) + 1
        while True:
            if self.rank.get((a, b), before) < before:
                return False
            of_a, of_b = self.made.get(a, none), self.made.get(b, none)
            if of_a[0] < 0 and of_b[0] < 0:
                return True
            # Undo the later of the two merges; of equal ones the left came first.
            if of_a[0] > of_b[0]:
                before, a = of_a[0], of_a[2]
            else:
                before, b = of_b[0] + 1, of_b[1]

    def encode(self, word: str) -> list[int]:
        """Ids of one word, given in byte letters."""
        letters = word[:-1] + chr(ord(word[-1]) + _ENDED) if self.end else word
        last = [-1] * len(letters)
        length = [0] * len(letters)
        for end, (n, token) in self.automaton.iter(letters):
            if last[end] < 0:
                before = end - n
                if before < 0 or (last[before] >= 0 and self.compatible(last[before], token)):
                    last[end], length[end] = token, n
        out, at = [], len(letters) - 1
        while at >= 0:
            if last[at] < 0:
                raise ValueError(f"no token ends at letter {at} of {word!r}")
            out.append(last[at])
            at -= length[at]
        return out[::-1]


class WordCoder:
    """Encodes and decodes whole texts as a tokenizer file of word BPE says."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        said = json.loads(spec)
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.bpe = PrefixBPE(said["model"]["vocab"], said["model"]["merges"], said["model"]["end_of_word_suffix"] or "")
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.byte = byte_letters()
        self.new: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def _pair(self, ids: list[int]) -> tuple[bytes, bytes]:
        return np.array(ids, "<u4").tobytes(), " ".join(map(self._text, ids)).encode()

    def _text(self, i: int) -> str:
        return self.bpe.token[i] if i in self.bpe.token else next(t for t, n in self.special.items() if n == i)

    def _learn(self, word: str) -> tuple[bytes, bytes]:
        if (found := self.old.get(word)) is None:
            found = self._pair(self.bpe.encode("".join([self.byte[b] for b in word.encode()])))
        if len(self.new) >= REMEMBERED:
            self.new, self.old = {}, self.new
        self.new[word] = found
        return found

    def _words(self, text: str) -> list[str]:
        if ODD.search(text) is None:
            return _WORD.findall(text.lower())
        back = {c: b for b, c in enumerate(self.byte)}
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(back[c] for c in piece).decode() for piece, _ in pieces]

    def code(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        found: list[tuple[bytes, bytes]] = []
        parts = self.split.split(text) if self.split and "<|" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                found.append(self._pair([self.special[part]]))
                continue
            for word in self._words(part):
                found.append(self.new.get(word) or self._learn(word))
        return b"".join([x for x, _ in found]), b" ".join([x for _, x in found])


_CODERS: dict[str, WordCoder] = textops.cache("bpe")


def _coder(spec: str) -> WordCoder:
    name = hashlib.sha256(spec.encode()).hexdigest()
    if name not in _CODERS:
        _CODERS.clear()
        _CODERS[name] = WordCoder(spec)
    return _CODERS[name]


def encode_texts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Each row with ``n_tokens``, ``ids`` and ``decoded``.

    ``tokenizer`` is the path, on the driver, of a tokenizer file of lower-cased
    word BPE with a word-end suffix; its content (a megabyte or two) goes to the
    executors by broadcast.  ``ids`` is binary: little-endian unsigned 32-bit
    integers.  ``decoded`` is the tokens' strings joined by spaces, special
    tokens included.  No special token is added; where a text contains the
    string of one, it is that token.

    Null and empty texts, and such of white space only, have no tokens.  Input
    columns named as the results are dropped in their favour.
    """
    with open(tokenizer, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    made = ("n_tokens", "ids", "decoded")
    columns = [c for c in docs.columns if c not in made]
    docs = docs.select(*[docs[c] for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value)
        for batch in batches:
            for chunk in textops.split_chunks(batch, text):
                both = [coder.code(t or "") for t in chunk.column(text).to_pylist()]
                ids = [x for x, _ in both]
                out = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([x for _, x in both], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(chunk.column(c) for c in columns), *out], names=[*columns, *made])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return runtime.spread(docs).mapInArrow(textops.lean(run, "bpe"), schema)
