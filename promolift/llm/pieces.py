"""Encoding and decoding with a SentencePiece vocabulary by streaming Viterbi search.

The best segmentation of a text into pieces is the path with the highest sum of
scores. Only the last ``longest`` positions can still be extended, so the search
keeps a window of them and the text after their common ancestor: as soon as all
surviving backpointer paths meet in one boundary, the ids before it are final
and leave. What the search keeps is bounded by the distance between such
boundaries, not by the text, which it takes in parts.

No piece of a vocabulary spans the boundary before a word mark that follows
another character, so all paths meet there: words are independent, and a worker
keeps the ids of those it has met. Vocabularies of merges give their pieces
scores by rank; the search maximises their sum, which is not the same as merging.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MOST_WORDS = 500_000
LONGEST_KEPT = 64
#: Characters that the search takes in at once.
PART = 4096
UNKNOWN = -1
#: An unknown character scores this much below the worst piece.
PENALTY = 10.0


class Vocabulary:
    """Pieces with ids and scores; ``byte_ids`` stand for characters that have no piece."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.longest = max(map(len, pieces))
        self.prefixes = {piece[:n] for piece in pieces for n in range(1, len(piece) + 1)}
        self.unknown = min(score for _, score in pieces.values()) - PENALTY
        self.branches: dict[str, list] = {}
        for piece, (i, score) in pieces.items():
            branches = self.branches
            for character in piece:
                node = branches.setdefault(character, [{}, UNKNOWN, 0.0])
                branches = node[0]
            node[1:] = i, score
        self.splits_words = not any(MARK in piece.lstrip(MARK) for piece in pieces)
        self.words: dict[str, bytes] = {}
        size = max([i for i, _ in pieces.values()] + byte_ids) + 1
        self.bytes_of = [b""] * size
        for piece, (i, _) in pieces.items():
            self.bytes_of[i] = piece.replace(MARK, " ").encode()
        for value, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([value])

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size())
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in plain}
        return cls(pieces, [model.piece_to_id(f"<0x{value:02X}>") for value in range(256)])

    def _bytes_for(self, character: str) -> list[int]:
        return [self.byte_ids[value] for value in character.encode()]

    def search(self, parts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text that arrives in parts, as they become final.

        Of equal paths the one whose last piece is longest wins.
        """
        longest, pieces, prefixes = self.longest, self.pieces, self.prefixes
        nothing = float("-inf")
        window, at = "", 0
        score, back, piece = [0.0], [0], [0]

        def extend(end: int) -> None:
            """Follow all pieces that start at ``at``."""
            grow = min(at + longest, end) + 1 - len(score)
            if grow > 0:
                score.extend([nothing] * grow)
                back.extend([0] * grow)
                piece.extend([0] * grow)
            here = score[at]
            single = False
            for stop in range(at + 1, min(at + longest, end) + 1):
                text = window[at:stop]
                if text not in prefixes:
                    break
                found = pieces.get(text)
                if found:
                    single = single or stop == at + 1
                    if here + found[1] > score[stop]:
                        score[stop], back[stop], piece[stop] = here + found[1], at, found[0]
            if not single and here + self.unknown > score[at + 1]:
                score[at + 1], back[at + 1], piece[at + 1] = here + self.unknown, at, UNKNOWN

        def path(end: int) -> list[int]:
            found = []
            while end:
                start = back[end]
                found.append(self._bytes_for(window[start:end]) if piece[end] == UNKNOWN else [piece[end]])
                end = start
            return [i for ids in reversed(found) for i in ids]

        def meeting() -> int:
            """The last boundary on all paths that can still be extended."""
            alive = set(range(max(0, at - longest + 1), at + 1))
            while len(alive) > 1:
                last = max(alive)
                alive.discard(last)
                alive.add(back[last])
            return alive.pop()

        for part in parts:
            window += part
            while at + longest <= len(window):
                extend(len(window))
                at += 1
                if at % (4 * longest) == 0 and (final := meeting()):
                    yield path(final)
                    window, at = window[final:], at - final
                    score, back, piece = score[final:], [max(0, b - final) for b in back[final:]], piece[final:]
        while at < len(window):
            extend(len(window))
            at += 1
        yield path(at)

    def _searched(self, text: str) -> bytes:
        """As :meth:`search` for a text that is short enough to be kept whole.

        ``branches`` leads from a character to the pieces that go on with it, the
        id of the piece that ends there (or UNKNOWN) and its score.
        """
        n, unknown = len(text), self.unknown
        score, back, piece = [0.0] + [float("-inf")] * n, [0] * (n + 1), [0] * (n + 1)
        for at in range(n):
            here, stop, branches, single = score[at], at, self.branches, False
            for character in text[at:at + self.longest]:
                node = branches.get(character)
                if node is None:
                    break
                stop += 1
                branches, found, gain = node
                if found != UNKNOWN:
                    if stop == at + 1:
                        single = True
                    if here + gain > score[stop]:
                        score[stop], back[stop], piece[stop] = here + gain, at, found
            if not single and here + unknown > score[at + 1]:
                score[at + 1], back[at + 1], piece[at + 1] = here + unknown, at, UNKNOWN
        ids: list[int] = []
        while n:
            start = back[n]
            if piece[n] == UNKNOWN:
                ids.extend(reversed(self._bytes_for(text[start:n])))
            else:
                ids.append(piece[n])
            n = start
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encoded(self, text: str) -> bytes:
        if len(text) <= PART:
            return self._searched(text)
        parts = (text[at:at + PART] for at in range(0, len(text), PART))
        return b"".join(np.array(ids, "<u4").tobytes() for ids in self.search(parts))

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a whole text; spaces become word marks, one is put in front."""
        if not text:
            return b""
        words = text.split(" ")
        if not self.splits_words or not all(words) or MARK in text:
            return self._encoded(MARK + text.replace(" ", MARK))
        known = self.words
        for word in words:
            if word not in known:
                if len(known) > MOST_WORDS:
                    known.clear()
                    return self.encode(text)
                known[word] = self._encoded(MARK + word)
        ids = b"".join(map(known.__getitem__, words))
        for word in words if max(map(len, words)) > LONGEST_KEPT else ():
            if len(word) > LONGEST_KEPT:
                known.pop(word, None)
        return ids

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no text become replacement characters."""
        data = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data.decode(errors="replace")[1:]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.load(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, text_crc32, ids`` of every row; null and empty texts have no ids.

    The checksum is that of the text as it will be decoded: U+2581 is the word
    mark and comes back as a space.
    """
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = vocabulary(path)
        for batch in batches:
            batch["ids"] = [tool.encode(text) for text in batch.pop("text")]
            yield batch

    return docs.select(F.col("doc_id").cast("string").alias("doc"), "text", F.crc32(
        F.translate(F.coalesce("text", F.lit("")), MARK, " ").cast("binary")).alias("text_crc32")).mapInPandas(
        encode, "doc string, text_crc32 bigint, ids binary").withColumn(
        "doc_id", F.col("doc").cast(docs.schema["doc_id"].dataType)).select("doc_id", "text_crc32", "ids")


def decode_texts(encoded: DataFrame, path: str) -> DataFrame:
    """Replace ``ids`` by the ``text`` they stand for."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = vocabulary(path)
        for batch in batches:
            batch["text"] = [tool.decode(ids) for ids in batch["ids"]]
            yield batch

    kind = encoded.schema["doc_id"].dataType
    return encoded.select(F.col("doc_id").cast("string").alias("doc"), "text_crc32", "ids").mapInPandas(
        decode, "doc string, text_crc32 bigint, ids binary, text string").select(
        F.col("doc").cast(kind).alias("doc_id"), "text_crc32", "ids", "text")
