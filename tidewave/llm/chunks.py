"""Text in white-space chunks, encoded once per distinct chunk and task."""

from __future__ import annotations

import os
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_CHUNKS = 100_000
CHUNKS_AT_ONCE = 200_000


class Remembered:
    """Ids of the chunks of texts. Distinct chunks of a batch are encoded once; of those of
    batches before, the last ``limit`` to twice as many are kept.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = CACHED_CHUNKS):
        self.encode_many, self.limit = encode_many, limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forms(self, chunks: list[str]) -> list[bytes]:
        """The form of each of some distinct chunks."""
        known, older = self.known, self.older
        found = [known.get(c) or older.get(c) for c in chunks]
        new = [c for c, f in zip(chunks, found) if f is None]
        fresh = iter(self.encode_many(new))
        found = [next(fresh) if f is None else f for f in found]
        if len(chunks) > self.limit:
            self.older, self.known = known, dict(islice(zip(chunks, found), self.limit))
        else:
            if len(known) + len(chunks) > self.limit:
                self.older, self.known = known, {}
            self.known.update(zip(chunks, found))
        return found

    def of(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column.

        Texts are cut at blanks and line feeds; no piece of the vocabularies used here spans one.
        """
        lines = pc.replace_substring(pc.fill_null(column, ""), "\n", " ")
        lists = pc.split_pattern(lines, " ")
        coded = lists.flatten().dictionary_encode()
        forms = self.forms(texts_of(coded.dictionary))
        ids = np.frombuffer(b"".join(forms), "<u4")
        size = np.fromiter(map(len, forms), np.int64, len(forms)) // 4
        start = np.cumsum(size) - size
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        codes = coded.indices.to_numpy()
        a, n = 0, len(column)
        while a < n:
            b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNKS_AT_ONCE, "right")) - 1))
            some = codes[offsets[a]:offsets[b]]
            length = size[some]
            end = np.cumsum(length)
            total = int(end[-1]) if len(end) else 0
            flat = ids[np.arange(total) + np.repeat(start[some] - (end - length), length)]
            edge = np.concatenate([[0], end])[offsets[a:b + 1] - offsets[a]].tolist()
            for x, y in zip(edge, edge[1:]):
                yield flat[x:y]
            a = b


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is empty, bytes that aren't UTF-8 become replacement characters."""
    try:
        return pc.fill_null(column, "").to_pylist()
    except UnicodeDecodeError:
        return [(b or b"").decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def byte_symbols() -> list[str]:
    """Printable stand-ins of the 256 bytes: Latin-1 characters that print stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def lower_nfc(text: str) -> str:
    """Composed and lower-cased letter by letter."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def library_encoder(tokenizer_json: str) -> Callable[[list[str]], list[bytes]]:
    """Chunks to little-endian 32-bit ids by the tokenizers library.

    A chunk of letters, with or without one full stop or comma, is one or two pieces of the
    vocabulary's pre-tokenizer, so the library's model takes it as it is; every other chunk goes
    through the whole library.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    symbols = byte_symbols()
    tokenize = tokenizer.model.tokenize
    marks = {m: array("I", tokenizer.encode(m, add_special_tokens=False).ids).tobytes() for m in ".,"}

    def encode_many(chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        rest: list[tuple[int, str]] = []
        for i, chunk in enumerate(chunks):
            mark = marks.get(chunk[-1:], b"")
            word = lower_nfc(chunk[:-1] if mark else chunk)
            if word.isalpha():
                piece = word if word.isascii() else "".join([symbols[b] for b in word.encode()])
                out.append(array("I", [t.id for t in tokenize(piece)]).tobytes() + mark)
            else:
                rest.append((i, chunk))
                out.append(b"")
        if rest:
            found = tokenizer.encode_batch_fast([c for _, c in rest], add_special_tokens=False)
            for (i, _), e in zip(rest, found):
                out[i] = array("I", e.ids).tobytes()
        return out

    return encode_many


def library_memory(tokenizer_json: str) -> Remembered:
    """A memory for one task; workers outlive their tasks and should not hold on to it."""
    return Remembered(library_encoder(tokenizer_json))
