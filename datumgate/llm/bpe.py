"""Byte-level BPE: merges by a priority queue over a doubly linked list of symbols.

The vocabulary file is named by a parameter and read on the driver; its tables go to the
executors once. A text is cut at special tokens and by the usual pattern; each piece is
merged by taking the lowest rank from a heap, skipping entries whose symbols have
changed since. Merged pieces are kept in a bounded cache per worker: when its younger half is
full it becomes the older half, and what is used again moves back. Decoding
joins the vocabulary strings of the ids.

Defined results: a null text counts as empty, an empty text has no ids; repeated rows are encoded
alike; a text of one long piece costs n log n.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import tidy

# Fixed value: the pattern that cuts a text into pieces before the merges.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
CACHED_PIECES = 80_000  # of each half
CACHED_CHARS = 64


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 stands for itself, the rest follows at U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file."""

    def __init__(self, content: str):
        stated = json.loads(content)
        model = stated["model"]
        byte_of = {c: b for b, c in byte_alphabet().items()}
        special = {t["content"]: t["id"] for t in stated.get("added_tokens", [])}
        self.special = special
        size = 1 + max([*model["vocab"].values(), *special.values()])
        self.strings: list[bytes] = [b""] * size
        for token, number in model["vocab"].items():
            self.strings[number] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, number in special.items():
            self.strings[number] = token.encode()
        self.byte_ids = [model["vocab"][c] for _, c in sorted(byte_alphabet().items())]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ids = model["vocab"]
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.pieces = regex.compile(PATTERN)
        names = "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))
        self.special_pattern = regex.compile(f"({names})") if names else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        symbols = [self.byte_ids[b] for b in data]
        count = len(symbols)
        if count < 2:
            return symbols
        merges = self.merges
        before, after = list(range(-1, count - 1)), [*range(1, count), -1]
        heap = [
            (merges[pair][0], i, pair) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in merges
        ]
        heapq.heapify(heap)
        while heap:
            _, left, pair = heapq.heappop(heap)
            right = after[left]
            # Stale: the left symbol is gone or changed, or its neighbour is another one now.
            if right < 0 or symbols[left] != pair[0] or symbols[right] != pair[1]:
                continue
            symbols[left], symbols[right] = merges[pair][1], -1
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
                new = (symbols[left], symbols[after[right]])
                if new in merges:
                    heapq.heappush(heap, (merges[new][0], left, new))
            after[right] = -1
            if before[left] >= 0:
                new = (symbols[before[left]], symbols[left])
                if new in merges:
                    heapq.heappush(heap, (merges[new][0], before[left], new))
        return [s for s in symbols if s >= 0]

    def _packed(self, piece: str) -> bytes:
        ids = self.old.get(piece) or np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self.young) >= CACHED_PIECES:
                self.young, self.old = {}, self.young
            self.young[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        parts = [text]
        if self.special_pattern is not None and any(t in text for t in self.special):
            parts = self.special_pattern.split(text)
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                for piece in self.pieces.findall(part):
                    out.append(self.young.get(piece) or self._packed(piece))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.strings.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _vocabulary(content: str) -> Vocabulary:
    return Vocabulary(content)


def _parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as source:
        return source.read()


def encode_texts(
    docs: DataFrame, vocabulary_path: str, decode: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids): ids packed as little-endian unsigned 32-bit integers.

    With ``decode``, also the text ``decoded`` from the ids, in the same pass.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    content = docs.sparkSession.sparkContext.broadcast(_read(vocabulary_path))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content.value)
        for whole in batches:
            for batch in _parts(whole):
                packed = [vocabulary.encode(t.as_py() or "") for t in batch.column(1)]
                columns = [batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]
                if decode:
                    columns.append(pa.array([vocabulary.decode(np.frombuffer(p, "<u4")) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids binary" + (", decoded string" if decode else "")
    )


def decode_texts(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of packed ids; null ids count as none."""
    kind = encoded.schema[id_col].dataType.simpleString()
    content = encoded.sparkSession.sparkContext.broadcast(_read(vocabulary_path))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content.value)
        for whole in batches:
            for batch in _parts(whole):
                texts = [vocabulary.decode(np.frombuffer(p.as_py() or b"", "<u4")) for p in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded string")
