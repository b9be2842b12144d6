"""BPE encoding and decoding of whole texts with a public lower-casing vocabulary with word ends.

Encoding follows the file's own steps: special tokens are cut out of the raw text, the rest is put in NFC, white space is
collapsed, letters are lower-cased one by one, words are cut by the file's pattern and merged (see ``bpe``). Decoding joins the
vocabulary's strings with one space, as the file names no decoder. Words repeat, so each worker keeps the ids of recent ones.

Defined cases: null text is the empty text (no tokens, the digests of the empty string); texts of any length are encoded whole;
repeated rows give repeated rows; a null doc_id is returned as null; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from creditlake.llm.bpe import load
from creditlake.llm.common import map_batches, only, read, small_batches, text_of

#: Fixed values of the vocabulary file: its white space and its pattern of words.
SPACE = "\t-\r \x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
#: What str.split() takes for white space and the file doesn't.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_RUNS = re.compile(f"[^{SPACE}]+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCodec:
    """Texts to ids and back, word by word. Two generations of recent words are kept; the older goes when the younger is full."""

    def __init__(self, path: str):
        self.model = load(path)
        self.words = regex.compile(WORDS)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.model.special, key=len, reverse=True))) + ")")
        self.known: dict[str, tuple[str, str, int]] = {}
        self.older: dict[str, tuple[str, str, int]] = {}

    def keep(self, chars: str, made: tuple[str, str, int]) -> tuple[str, str, int]:
        if len(chars) <= 64:
            if len(self.known) >= self.model.limit:
                self.older, self.known = self.known, {}
            self.known[chars] = made
        return made

    def run(self, chars: str) -> tuple[str, str, int]:
        """Ids, decoded tokens and their number of one run without white space, already lower-cased."""
        if (made := self.older.get(chars)) is not None:
            return self.keep(chars, made)
        if chars[-1] in ".,|" and chars[:-1].isalpha():  # a word and its mark are cut apart
            word, mark = (self.known.get(c) or self.run(c) for c in (chars[:-1], chars[-1]))
            return f"{word[0]} {mark[0]}", f"{word[1]} {mark[1]}", word[2] + mark[2]
        words = (chars,) if chars.isalpha() else self.words.findall(chars)
        ids = [i for word in words for i in self.model.ids(word.encode())]
        tokens = self.model.tokens
        return self.keep(chars, (" ".join(map(str, ids)), " ".join([tokens[i] for i in ids]), len(ids)))

    def plain(self, text: str) -> list[tuple[str, str, int]]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # str.lower() looks at the neighbours of a capital sigma
                text = text.replace("Σ", "σ")
        text = text.lower()
        runs = _RUNS.findall(text) if _NOT_SPACE.search(text) else text.split()
        get, run = self.known.get, self.run
        return [get(r) or run(r) for r in runs]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, the ids joined by blanks, the decoded text."""
        if "<|" in text:
            out = []
            for k, part in enumerate(self.special.split(text)):
                out += [(str(self.model.special[part]), part, 1)] if k % 2 else self.plain(part)
        else:
            out = self.plain(text)
        if not out:
            return 0, "", ""
        ids, decoded, n = zip(*out, strict=True)
        if 0 in n:  # a run of bytes that the vocabulary doesn't have
            ids, decoded = [x for x in ids if x], [x for x in decoded if x]
        return sum(n), " ".join(ids), " ".join(decoded)


@lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded text of each document."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            made = [c.digest(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([[int(i) for i in m[1].split()] for m in made], pa.list_(pa.int32())), pa.array([m[2] for m in made], pa.string())], ["doc_id", "ids", "decoded"])

    return map_batches(only(documents, doc_id=documents["doc_id"], text=text_of(documents)), run, "doc_id long, ids array<int>, decoded string")


def encode_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same ids and decoded text, kept as digests."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, ids, decoded = [], [], []
            for t in b.column("text").to_pylist():
                k, i, d = c.digest(t)
                n.append(k)
                ids.append(hashlib.sha256(i.encode()).hexdigest())
                decoded.append(hashlib.sha256(d.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(only(documents, doc_id=documents["doc_id"], text=text_of(documents)), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
