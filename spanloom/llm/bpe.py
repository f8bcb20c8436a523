"""Byte-pair encoding and decoding with a vocabulary file that marks word ends.

Texts are composed (NFC) and lower-cased, cut into words, and the bytes of each
word are merged by rank. A short word holds its parts and the ranks of adjacent
parts in two contiguous lists: the smallest rank is looked for, that boundary is
deleted, and the ranks of its neighbours are refreshed, until none is left. A
long word, where such scans would take quadratic time, keeps its ranks in a heap
over linked parts; both give the same parts. Decoding joins the tokens' strings
with blanks, as a file without a decoder asks for.

Rows: a null or empty text has no tokens and decodes to the empty string;
special tokens standing in a text are encoded as such; repeated rows are encoded
each; columns other than those kept are not read. The vocabulary has a fixed
size and is read once in each Python worker; the word memory is bounded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain, repeat
from typing import Iterable, Iterator

import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from spanloom.llm.common import per_row

DEFAULT_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: White space as the file's expressions mean it (fixed values of the format).
SPACE = r"\t-\r \x85\xa0  -     　"
#: Words as the file's expression cuts them (a fixed value of the format).
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"

NO_RANK = 1 << 60
#: Words from this many bytes on keep their ranks in a heap.
LONG_WORD = 128
#: Words remembered in a worker; then the memory starts anew.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: visible bytes for themselves, others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, extra = [], 256
    for b in range(256):
        letters.append(chr(b) if b in visible else chr(extra))
        extra += b not in visible
    return letters


class _Known(dict):
    """Parts of the words met so far."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> tuple[int, ...]:
        parts = self.make(word)
        if len(parts) < LONG_WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = parts
        return parts


class Tokenizer:
    """A vocabulary file of the tokenizers format with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model = described["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in described["added_tokens"]}
        self.strings = {i: s for s, i in (vocab | self.special).items()}
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.final = [vocab[x + suffix] for x in letters]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = n
            self.merged.append(vocab[a + b])
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.words = regex.compile(WORDS).findall
        self.ascii_words = re.compile(ASCII_WORDS).findall
        self.known = _Known(self.word)

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.final[raw[-1]]
        return tuple(self._scan(parts) if len(parts) < LONG_WORD else self._heap(parts))

    def _scan(self, parts: list[int]) -> list[int]:
        rank, merged = self.rank.get, self.merged
        ranks = list(map(rank, zip(parts, parts[1:]), repeat(NO_RANK)))
        while ranks and (least := min(ranks)) != NO_RANK:
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NO_RANK)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1)
                if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or self.rank.get((parts[i], parts[j])) != r:
                continue                                   # one of the two has changed
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.rank.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [x for x in parts if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for piece in self.cut(text) if text and "<|" in text else (text or "",):
            if piece in self.special:
                ids.append(self.special[piece])
                continue
            if piece.isascii():
                words = self.ascii_words(piece.lower())
            else:                    # letters are lowered one by one: a last sigma is like others
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                words = self.words(piece)
            ids += chain.from_iterable(map(self.known.__getitem__, words))
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(docs: DataFrame, keep: list[str], text: str = "text",
           vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Columns ``keep`` and the token ids of ``text``."""
    def run(texts: Iterable[str | None]) -> Iterator[tuple]:
        t = tokenizer(vocabulary)
        for x in texts:
            yield (t.encode(x),)
    return per_row(docs, keep, text, [StructField("ids", ArrayType(IntegerType()))], run)


def decode(rows: DataFrame, keep: list[str], ids: str = "ids",
           vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Columns ``keep`` and the text of token ``ids`` (null: empty)."""
    def run(lists: Iterable[list[int] | None]) -> Iterator[tuple]:
        t = tokenizer(vocabulary)
        for x in lists:
            yield (t.decode(x or ()),)
    return per_row(rows, keep, ids, [StructField("text", StringType())], run)


def round_trip(docs: DataFrame, keep: list[str], text: str = "text",
               vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keep`` with n_tokens and the digests of the ids and of what they decode to.

    The same encoder and decoder in one pass, without carrying ids between.
    """
    def sha(x: str) -> str:
        return hashlib.sha256(x.encode()).hexdigest()

    def run(texts: Iterable[str | None]) -> Iterator[tuple]:
        t = tokenizer(vocabulary)
        for x in texts:
            ids = t.encode(x)
            yield len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids))
    return per_row(docs, keep, text, [
        StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType())], run)
