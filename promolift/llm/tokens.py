"""Token ids of whole texts, with the words encoded before kept in memory.

Both vocabularies split a text at its white space before any merge, so the ids
of a text are the ids of its words in order. Words come back often and encoding
costs far more than a lookup: each Python worker keeps the ids of the words it
has met. A text whose white space is not of the plain kind, or that holds a string
with an id of its own such as ``<|endoftext|>``, is encoded as a whole.

Most new words are Latin letters with ASCII marks behind them. What the library does
to such a word before its merges is known, and takes most of its time. So a second
instance of it, without these steps, gets the letters and the marks as they are then.

Words are also cut before their marks, and those of many texts are numbered by Arrow at
once: only different ones are looked up. Where white space has no ids, they share the ids
of their lower-case form. ``Encoder`` alone, which cuts at white space only, is for
vocabularies with other steps before the merges.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker keeps; it starts anew when they are exceeded.
MOST_WORDS = 1_000_000
LONGEST_KEPT = 64
TOGETHER = 64


#: White space other than spaces and line feeds.
OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Letters that every step treats alike whatever stands beside them, then marks.
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]"
PLAIN_WORD = re.compile(f" ?{LETTERS}+{MARKS}*")
LETTERS_ALONE = re.compile(f"{LETTERS}+")
#: The same in UTF-8, with the space before them.
SPACED_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
BEFORE_MARKS = re.compile(f"(?<={LETTERS})(?={MARKS})")
#: The steps before the merges under which plain words can be prepared here.
KNOWN_STEPS = {
    "kept": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    "dropped": (
        {"type": "Sequence", "normalizers": [
            {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
             "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}),
}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [byte for byte in range(256) if byte not in own]
    return {byte: chr(byte) for byte in own} | {byte: chr(256 + i) for i, byte in enumerate(others)}


BYTE_LETTERS = byte_letters()


def bytes_of(pattern: str) -> np.ndarray:
    """For each byte whether the pattern takes it as an ASCII character."""
    return np.array([byte < 128 and bool(re.fullmatch(pattern, chr(byte))) for byte in range(256)])


LETTER_BYTES, MARK_BYTES, WHITE_BYTES = bytes_of(LETTERS), bytes_of(MARKS), bytes_of(r"[\x20\x09-\x0D]")
#: Second bytes, after 0xC3, of the letters that are not ASCII.
SECOND_BYTES = np.array([128 <= byte < 192 and byte not in (0x97, 0xB7) for byte in range(256)])
#: The letters of all bytes, but line feeds as they are.
LETTERS_OF_BYTES = np.array([ord(BYTE_LETTERS[byte]) if byte != 0x0A else byte for byte in range(256)], "<u2")


class Encoder:
    """``spaces``: "kept" for byte-level vocabularies, where a word owns the space before
    it; "dropped" for word vocabularies, where white space has no ids."""

    #: Characters to encode at once.
    most_chars = 1 << 21

    def __init__(self, path: str, spaces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Strings that the vocabulary gives one id of their own wherever they stand.
        self.own_ids = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept = spaces == "kept"
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words: dict = {}
        # A separator is one id that no word holds.
        self.separator = "\n" if self.kept else " \x01 "
        self.separator_id = self._library(self.separator.strip(" "))[0]
        # The library without the steps before the merges, where those are known.
        self.merges = None
        steps = json.loads(self.tokenizer.to_str())
        if (steps["normalizer"], steps["pre_tokenizer"]) == KNOWN_STEPS[spaces]:
            from tokenizers.pre_tokenizers import WhitespaceSplit

            self.merges = Tokenizer.from_file(path)
            self.merges.normalizer = None
            self.merges.pre_tokenizer = WhitespaceSplit()
            # Line feeds are put between plain words, vertical tabs before their marks.
            self.prepared = BYTE_LETTERS | {
                0x0A: f" {BYTE_LETTERS[ord(self.separator.strip(' '))]} ", 0x0B: " "}

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _parts(self, text: str) -> list | None:
        """The words of a text as keys, or None where it must be encoded as a whole.

        With spaces kept, a key after a line feed starts with it, as does the first.
        """
        if not self.kept:
            return text.encode().split()
        if any(space in text for space in OTHER_SPACES):
            return None
        keys = ("\n" + text).replace("\n", " \n").split(" ")[1:]
        # White space beside white space or at an end leaves a key without a word.
        return None if "" in keys or "\n" in keys else keys

    def _whole(self, texts: list[str]) -> str:
        return self.separator.join(texts)

    def _as_before_merges(self, texts: list[str]) -> str:
        """Plain words as all steps before the merges leave them, white space where they split."""
        text = BEFORE_MARKS.sub("\x0b", "\n".join(texts))
        if not self.kept:
            text = text.lower()
        return text.encode().decode("latin-1").translate(self.prepared)

    def _separately(self, tokenizer, joined: Callable[[list[str]], str], texts: list[str]) -> list[bytes]:
        """The ids of each text: several in one call, cut at the ids of the separators."""
        groups = [texts[i:i + TOGETHER] for i in range(0, len(texts), TOGETHER)]
        encoded = tokenizer.encode_batch_fast(list(map(joined, groups)), add_special_tokens=False)
        width, out = self.dtype.itemsize, []
        for group, one in zip(groups, encoded, strict=True):
            ids = np.array(one.ids, self.dtype)
            ends = (np.flatnonzero(ids == self.separator_id) * width).tolist()
            if len(ends) != len(group) - 1:
                raise RuntimeError("a text holds the separator")
            data = ids.tobytes()
            starts, ends = [0, *[end + width for end in ends]], [*ends, len(data)]
            out += [data[start:end] for start, end in zip(starts, ends, strict=True)]
        return out

    def _learn(self, keys: list) -> dict:
        """Encode new words, plain ones by the merges alone."""
        own = self.separator.strip(" ")
        # A line feed before a word is encoded apart from it.
        line = self._bytes([self.separator_id]) if self.kept else b""
        plain: tuple[list, list] = [], []
        others: tuple[list, list] = [], []
        found = {}
        is_plain = PLAIN_WORD.fullmatch if self.merges is not None else lambda text: None
        for key in keys:
            text = key.decode() if not self.kept else key[1:] if key[0] == "\n" else " " + key
            if is_plain(text):
                plain[0].append(key)
                plain[1].append(text)
            elif text and own not in text:
                others[0].append(key)
                others[1].append(text)
            else:
                found[key] = self._bytes(self._library(text))
        for (those, texts), tokenizer, joined in (
                (plain, self.merges, self._as_before_merges), (others, self.tokenizer, self._whole)):
            if those:
                found.update(zip(those, self._separately(tokenizer, joined, texts), strict=True))
        if self.kept:
            found.update([(key, line + found[key]) for key in keys if key[0] == "\n"])
        return found

    def _keep(self, learned: dict) -> None:
        if len(self.words) + len(learned) > MOST_WORDS:
            self.words.clear()
        if len(learned) <= MOST_WORDS and max(map(len, learned), default=0) <= LONGEST_KEPT:
            self.words.update(learned)
        else:
            self.words.update((k, v) for k, v in learned.items() if len(k) <= LONGEST_KEPT)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian numbers of type ``dtype``."""
        plans = [self._parts(text) if text and not any(own in text for own in self.own_ids)
                 else None if text else [] for text in texts]
        known = self.words.get
        found = [list(map(known, plan)) if plan else [] for plan in plans]
        # Places of words not met before.
        gaps = [[i for i, data in enumerate(parts) if data is None] if None in parts else [] for parts in found]
        new = list({plan[i] for plan, places in zip(plans, gaps, strict=True) for i in places})
        learned = self._learn(new) if new else {}
        for plan, parts, places in zip(plans, found, gaps, strict=True):
            for i in places:
                parts[i] = learned[plan[i]]
        self._keep(learned)
        first = self.dtype.itemsize if self.kept else 0
        return [
            b"" if not text
            else self._bytes(self._library(text)) if plan is None
            else b"".join(parts)[first:]
            for text, plan, parts in zip(texts, plans, found, strict=True)
        ]


def marks_after_letters(data: np.ndarray) -> np.ndarray:
    """The places in UTF-8 text of marks that follow a letter."""
    letters = LETTER_BYTES[data]
    letters[1:] |= (data[:-1] == 0xC3) & SECOND_BYTES[data[1:]]
    return np.flatnonzero(letters[:-1] & MARK_BYTES[data[1:]]) + 1


class NumberedEncoder(Encoder):
    """For word vocabularies: Arrow numbers the words of all texts, each different one is
    looked up once, and the ids are taken by number.

    Words are cut before marks that follow a letter, where the library cuts them too, and
    ASCII letters are lowered first, as the library does after composing characters.
    """

    most_chars = 1 << 22
    spaces = "dropped"

    def __init__(self, path: str):
        super().__init__(path, self.spaces)
        self.lower_own_ids = [own.encode().lower() for own in self.own_ids]
        self.model = self.merges.model if self.merges is not None else None

    def _prepared(self, text: str) -> bytes | None:
        """The text with ASCII letters lowered, or None where it must be encoded as a whole."""
        data = text.encode()
        lower = data.lower()
        if any(own in lower for own in self.lower_own_ids):
            return None
        # The combining characters that ASCII letters compose with start with one of these
        # bytes: a capital letter may have no composed form where the small one has it.
        return data if b"\xcc" in data or b"\xcd" in data else lower

    def _cut(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, and the number of words before each text and after the last."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        cuts = marks_after_letters(data)
        ends = np.cumsum([0, *map(len, texts)])
        ends += np.searchsorted(cuts, ends)
        spaced = pa.LargeStringArray.from_buffers(
            len(texts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.insert(data, cuts, 0x20)))
        words = pc.ascii_split_whitespace(spaced)
        return words.values, words.offsets.to_numpy()

    def _by_merges(self, keys: list, words: list[str]) -> dict:
        """The ids of letters whose bytes are replaced, by the merges alone."""
        tokenize, id_of, ids, ends = self.model.tokenize, attrgetter("id"), [], [0]
        for word in words:
            ids += map(id_of, tokenize(word))
            ends.append(len(ids))
        data, width = self._bytes(ids), self.dtype.itemsize
        return {key: data[start * width:end * width]
                for key, start, end in zip(keys, ends, ends[1:], strict=False)}

    def _learn_cut(self, keys: list) -> dict:
        """Encode new words, letters by the merges alone."""
        letters, words, others = [], [], []
        for key in keys:
            if key.isalpha():
                word = key.decode().lower()
            else:
                text = key.decode()
                if not LETTERS_ALONE.fullmatch(text):
                    others.append(key)
                    continue
                word = text.lower().encode().decode("latin-1").translate(BYTE_LETTERS)
            letters.append(key)
            words.append(word)
        return self._by_merges(letters, words) | self._learn(others)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.model is None:
            return super().encode(texts)
        plans = list(map(self._prepared, texts))
        words, starts = self._cut([plan or b"" for plan in plans])
        numbered = words.dictionary_encode()
        keys = numbered.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.words.get, keys))
        gaps = [i for i, data in enumerate(found) if data is None]
        if gaps:
            learned = self._learn_cut([keys[i] for i in gaps])
            for i in gaps:
                found[i] = learned[keys[i]]
            self._keep(learned)
        taken = pa.array(found, pa.large_binary()).take(numbered.indices)
        places = np.concatenate([[0], np.cumsum(pc.binary_length(taken).to_numpy())])
        ends = places[starts].tolist()
        data = taken.buffers()[2]
        data = data.to_pybytes() if data is not None else b""
        return [
            self._bytes(self._library(text)) if plan is None else data[start:end]
            for text, plan, start, end in zip(texts, plans, ends, ends[1:], strict=False)
        ]


class SpacedEncoder(NumberedEncoder):
    """The same for byte-level vocabularies, where a word owns the space before it.

    White space is cut as the library cuts it: of several in a row before a word the last
    stands apart, and goes with the word if it is a space; those at an end stay together.
    """

    most_chars = 1 << 20
    spaces = "kept"
    #: White space that is not looked for among the bytes.
    other_spaces = [c for c in OTHER_SPACES if c not in "\t\x0b\x0c\r"]

    def _prepared(self, text: str) -> bytes | None:
        if any(own in text for own in self.own_ids) or any(space in text for space in self.other_spaces):
            return None
        return text.encode()

    def _cut(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([0, *map(len, texts)])
        cut = np.zeros(len(data) + 1, bool)
        cut[ends] = True
        at_end = cut.copy()
        cut[marks_after_letters(data)] = True
        white = WHITE_BYTES[data]
        turns = np.flatnonzero(white[:-1] != white[1:]) + 1
        # Words end where white space starts, which ends where words start.
        cut[turns[white[turns]]] = True
        # At the end of a text no word follows.
        last = turns[~white[turns] & ~at_end[turns]] - 1
        cut[last] = True
        cut[last[data[last] != 0x20] + 1] = True
        places = np.flatnonzero(cut)
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)])
        return words, np.searchsorted(places, ends)

    def _learn_cut(self, keys: list) -> dict:
        letters, others, found = [], [], {}
        for key in keys:
            if SPACED_LETTERS.fullmatch(key):
                letters.append(key)
            elif key.isspace():
                found[key] = self._bytes(self._library(key.decode()))
            else:
                others.append(key)
        data = LETTERS_OF_BYTES[np.frombuffer(b"\n".join(letters), np.uint8)]
        found |= self._by_merges(letters, data.tobytes().decode("utf-16-le").split("\n") if letters else [])
        texts = [key.decode() for key in others]
        found.update(zip(others, self._separately(self.tokenizer, self._whole, texts), strict=True))
        return found


@lru_cache(maxsize=4)
def encoder(path: str, spaces: str) -> Encoder:
    return {"dropped": NumberedEncoder, "kept": SpacedEncoder}[spaces](path)


def slices(texts: list[str], most_chars: int = Encoder.most_chars):
    """Consecutive slices of about ``most_chars`` characters; a long text is one by itself."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most_chars:
            yield slice(start, i)
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def encode_all(path: str, spaces: str, texts: list[str | None], end_id: int) -> list[np.ndarray]:
    """Ids of each text (null: empty) with ``end_id`` after them."""
    texts = [text or "" for text in texts]
    tool = encoder(path, spaces)
    end = np.array([end_id], tool.dtype).tobytes()
    out = []
    for part in slices(texts, tool.most_chars):
        out += [np.frombuffer(data + end, tool.dtype) for data in tool.encode(texts[part])]
    # A worker that waits keeps its words, not the room in which they were numbered.
    pa.default_memory_pool().release_unused()
    return out
