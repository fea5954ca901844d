"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word the encoding has one last token. An automaton over the
vocabulary gives the tokens that end at each place, longest first; a token is the last one of a
prefix if it forms a compatible pair with the last token of the prefix before it: the
two stay apart when the pair's own merges are undone step by step. Following the stored
tokens backwards from the end gives the ids.

Defined results: null and empty texts have no ids and decode to an empty text; each distinct
piece of text is encoded once per task; further columns are kept, and a column named like
an output is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewave.llm.chunks import Remembered, byte_symbols, lower_nfc
from tidewave.llm.memory import give_back

# Fixed values of the published vocabulary format: white space, contractions, end mark.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
WORD_END = "</w>"
ENDING = 0x1000  # a last symbol is written as its code point plus this
BASE = -1
PIECE_MEMORY = 100_000


class PrefixEncoder:
    """Tables of one vocabulary and the encoder of words."""

    def __init__(self, tokenizer_json: str):
        import ahocorasick
        import regex

        spec = json.loads(tokenizer_json)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        if suffix != WORD_END or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("a byte-level vocabulary with word ends is needed")
        self.vocab: dict[str, int] = model["vocab"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, (left, right) in enumerate(merges):
            a, b, c = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.merged.setdefault((a, b), r)
            if c not in self.rank:
                self.rank[c], self.halves[c] = r, (a, b)
        del merges, model["merges"]  # nothing but the tables is kept beside the automaton
        self.pairs: dict[tuple[int, int], bool] = {}
        self.symbols = byte_symbols()
        self.automaton = ahocorasick.Automaton()
        for token, number in sorted(self.vocab.items(), key=lambda x: self.rank.get(x[1], BASE)):
            letters = self.letters(token)
            if number in self.halves and not self.stands(number):
                continue
            self.automaton.add_word(letters, (number, len(letters)))
        self.automaton.make_automaton()
        self.names = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.names.update({i: t for t, i in self.special.items()})
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES).findall
        self.known: dict[str, bytes] = {}

    @staticmethod
    def letters(token: str) -> str:
        if token.endswith(WORD_END) and len(token) > len(WORD_END):
            body = token[:-len(WORD_END)]
            return body[:-1] + chr(ord(body[-1]) + ENDING)
        return token

    def stands(self, token: int) -> bool:
        """Whether the merges, applied to the token's own letters, rebuild it."""
        left, right = self.halves[token]
        return all(self.stands_known(x) for x in (left, right)) and self.compatible(left, right, self.rank[token])

    def stands_known(self, token: int) -> bool:
        return token not in self.halves or self.stands(token)

    def compatible(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether no merge of rank lower than ``below`` joins symbols across the border of a and b.

        Both tokens are taken apart, latest merge first, on the sides that face each other.
        A merge across the border happens if it comes before the merge that hides one of
        its parts; on equal footing the left merge comes first.
        """
        limit = len(self.merged) + 1 if below is None else below
        while True:
            r = self.merged.get((a, b))
            if r is not None and r < limit:
                return False
            ra, rb = self.rank.get(a, BASE), self.rank.get(b, BASE)
            if ra == BASE and rb == BASE:
                return True
            if ra > rb:
                limit, a = ra, self.halves[a][1]
            else:
                limit, b = rb + 1, self.halves[b][0]

    def word(self, piece: str) -> bytes:
        """Ids of one piece of text."""
        found = self.known.get(piece)
        if found is not None:
            return found
        symbols = self.symbols
        text = "".join([symbols[b] for b in piece.encode()])
        text = text[:-1] + chr(ord(text[-1]) + ENDING)
        n, pairs = len(text), self.pairs
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        for end, match in self.automaton.iter(text):
            end += 1
            if last[end] is not None:
                continue
            before = end - match[1]
            if before:
                previous = last[before]
                if previous is None:
                    continue
                pair = (previous[0], match[0])
                fits = pairs.get(pair)
                if fits is None:
                    fits = self.compatible(*pair)
                    if len(pairs) > 4 * PIECE_MEMORY:
                        pairs.clear()
                    pairs[pair] = fits
                if not fits:
                    continue
            last[end] = match
        ids, at = [], n
        while at:
            token, length = last[at]
            ids.append(token)
            at -= length
        out = np.asarray(ids[::-1], "<u4").tobytes()
        if len(self.known) >= PIECE_MEMORY:
            self.known.clear()
        self.known[piece] = out
        return out

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.word, self.pieces(lower_nfc(text))))

    def chunk(self, text: str) -> bytes:
        if self.split_special is None or "<" not in text:
            return self.plain(text)
        return b"".join(
            int(self.special[part]).to_bytes(4, "little") if part in self.special else self.plain(part)
            for part in self.split_special.split(text))

    def many(self, chunks: list[str]) -> list[bytes]:
        return [self.chunk(c) for c in chunks]


def prefix_memory(tokenizer_json: str) -> Remembered:
    """An encoder for one task; workers outlive their tasks and should not hold on to it."""
    return Remembered(PrefixEncoder(tokenizer_json).many)


def with_column(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(i) for i in keep), values], names=[*(batch.schema.names[i] for i in keep), name])


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def spellings(tokenizer_json: str) -> list[str]:
    """The spelling of every id; ids without one are empty."""
    spec = json.loads(tokenizer_json)
    known = {**{i: t for t, i in spec["model"]["vocab"].items()}, **{t["id"]: t["content"] for t in spec.get("added_tokens") or ()}}
    return [known.get(i, "") for i in range(max(known) + 1)]


def spelt(names: list[str], ids: list[bytes | None]) -> pa.Array:
    return pa.array([" ".join([names[i] for i in np.frombuffer(b or b"", "<u4").tolist()]) for b in ids], pa.string())


def encode(df: DataFrame, tokenizer_json: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the ids of each whole text as little-endian unsigned 32-bit integers.

    With ``decoded``, also the text of these ids, as ``decode`` gives it, in the same pass: one worker per task instead of two.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = names = None
        for batch in batches:
            if memory is None:
                # what reading the file takes is free again before the next table is made
                names = spellings(vocabulary.value) if decoded else None
                memory = prefix_memory(vocabulary.value)
            for part in slices(batch):
                coded = [x.tobytes() for x in memory.of(part.column(part.schema.get_field_index(text)))]
                out = replaced(part, ids, pa.array(coded, pa.binary()))
                yield replaced(out, decoded, spelt(names, coded)) if decoded else out
        del memory, names
        give_back()

    schema = with_column(df, ids, T.BinaryType())
    if decoded:
        schema = T.StructType([f for f in schema.fields if f.name != decoded] + [T.StructField(decoded, T.StringType())])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer_json: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of each row's ids: the tokens' spellings with one space between."""
    vocabulary = df.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for batch in batches:
            names = names or spellings(vocabulary.value)
            for part in slices(batch):
                yield replaced(part, text, spelt(names, part.column(part.schema.get_field_index(ids)).to_pylist()))
        del names
        give_back()

    return df.mapInArrow(run, with_column(df, text, T.StringType()))
