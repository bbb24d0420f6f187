"""Token ids of whole texts by the `tokenizers` library, each distinct word encoded once per Python worker.

Encoding the rare words of a corpus costs a BPE run each; frequent words are looked up. A text is cut only where the
tokenizer itself always cuts, so that its ids are those of the whole text:

* vocabularies that drop white space (a `\\s+` normaliser, a pre-tokenizer whose matches hold no white space) at any
  ASCII blank. A-Z are made small first, as the normaliser would, unless the text may hold a special token;
* byte-level vocabularies with the usual split pattern before a blank or a line feed. A run of three blanks, or two at
  the end, is split elsewhere; such a text is encoded in one piece;
* any other tokenizer encodes whole texts.

When the table of known words reaches `limit`, the half used most stays and the others go, so that a word that keeps coming back is not
encoded anew: memory is bounded, results do not depend on it.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END, FIRST, WHOLE = b"\xff", b"\xfe", b"\xfd"  # bytes that UTF-8 never uses
CHUNK = 2 << 20
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks that no letter goes with; an apostrophe may start a pre-token of letters
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿĀ-įĲ-ɏ]+")  # letters whose small form is one letter; long in every Unicode table
LETTER = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
SPLITS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")  # the blanks of bytes.split
ANY_BLANK = bytes(32 if c in b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f " else 120 for c in range(256))
OTHER_BLANKS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
LONG_RUN = re.compile(r"\s\s\s|\s\s\Z")

_encoders: dict = {}


def encoder(path: str, end_ids: tuple[int, ...] = (), limit: int = 500_000) -> "TextEncoder":
    """One encoder per worker process, vocabulary and end."""
    key = (path, end_ids, limit)
    if key not in _encoders:
        _encoders[key] = TextEncoder(path, end_ids, limit)
    return _encoders[key]


def cut_of(spec: dict) -> str:
    """Where texts may be cut: "blank", "byte" or "whole"."""
    split, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if (split.get("type"), split.get("use_regex", True), split.get("add_prefix_space")) == ("ByteLevel", True, False):
        return "whole" if normal else "byte"
    parts = split.get("pretokenizers", [])
    drops = any(p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"] for p in parts)
    known = {json.dumps(n, sort_keys=True) for n in normal.get("normalizers", [])}
    collapses = json.dumps({"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, sort_keys=True) in known
    return "blank" if drops and collapses and any(n.get("type") == "Lowercase" for n in normal["normalizers"]) else "whole"


def marks_apart(joined: bytes, between: bytes) -> bytes:
    """Puts `between` before a comma or full stop that has an ASCII letter before and a blank behind it: such a mark is a
    pre-token of its own, and most words are then known without their marks."""
    data = np.frombuffer(joined, np.uint8)
    at = np.flatnonzero((data[1:-1] == 44) | (data[1:-1] == 46)) + 1
    at = at[LETTER[data[at - 1]] & ((data[at + 1] == 32) | (data[at + 1] == 10))]
    return np.insert(data, np.repeat(at, len(between)), np.tile(np.frombuffer(between, np.uint8), len(at))).tobytes()


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... of all spans, one span after the other."""
    total = np.cumsum(sizes)
    return np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)


def distinct(joined: bytes, empty: bool) -> tuple[list[bytes], np.ndarray]:
    """The different pieces between blanks, and which of them stands at each place; `empty`: with those between two blanks that follow
    each other. `joined` ends with a blank."""
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).astype(np.int32) + 1
    offsets = np.concatenate([np.zeros(1, np.int32), ends])
    pieces = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    if not empty:
        pieces = pieces.filter(pa.array(np.diff(offsets) > 1))
    found = pieces.dictionary_encode()
    return pc.binary_slice(found.dictionary, 0, -1).to_pylist(), found.indices.to_numpy()


class _Known(dict):
    """Piece -> number; a new piece gets the next number and waits to be encoded."""

    def __init__(self):
        self.waiting: list[bytes] = []

    def __missing__(self, piece):
        number = self[piece] = len(self)
        self.waiting.append(piece)
        return number


class TextEncoder:
    def __init__(self, path: str, end_ids: tuple[int, ...], limit: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut = cut_of(spec)
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.special = any(b"<" not in t or t != b"".join(t.split()) for t in self.added)
        self.end_ids, self.limit = end_ids, limit
        self.vocabulary = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.vocabulary)]
        suffix = (spec["model"].get("end_of_word_suffix") or "") if self.cut == "blank" else ""
        if self.cut == "blank" and not suffix:
            self.cut = "whole"
        self.edges = np.array([n.startswith("Ġ") if self.cut == "byte" else bool(suffix) and n.endswith(suffix) for n in names])
        self.clear()

    def clear(self):
        self.known = _Known()
        self.pool, self.starts, self.sizes = array("I"), array("q"), array("q")
        self.uses = np.zeros(1, np.int64)
        self.known[END] = 0
        self.add(self.end_ids)

    def add(self, ids):
        self.starts.append(len(self.pool))
        self.sizes.append(len(ids))
        self.pool.extend(ids)

    def count(self, numbers: np.ndarray):
        found = np.bincount(numbers, minlength=len(self.known))
        found[:len(self.uses)] += self.uses
        self.uses = found

    def forget(self):
        """Keeps the pieces used most, at most half of `limit`, with half of their uses: what is no longer met goes in time."""
        most = np.argsort(-self.uses, kind="stable")[:self.limit // 2]
        stays = np.zeros(len(self.uses), bool)
        stays[most[self.uses[most] > 1]] = True
        names = [piece for piece, number in self.known.items() if number and stays[number] and piece[:1] != WHOLE]
        at = np.array([self.known[piece] for piece in names], np.int64)
        sizes, starts = np.frombuffer(self.sizes, np.int64)[at], np.frombuffer(self.starts, np.int64)[at]
        own, uses = np.frombuffer(self.pool, np.uint32)[spans(starts, sizes)], self.uses[at] // 2
        self.clear()
        base = len(self.pool)
        self.known.update(zip(names, range(1, len(names) + 1)))
        self.pool.frombytes(own.tobytes())
        self.starts.frombytes((base + np.cumsum(sizes) - sizes).tobytes())
        self.sizes.frombytes(sizes.tobytes())
        self.uses = np.concatenate([self.uses, uses])

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def raw(self, piece: bytes, whole: list[bytes]) -> str:
        head = piece[:1]
        if head == WHOLE:
            return whole[int(piece[1:])].decode("utf-8", "replace")
        bare = piece[1:] if head == FIRST else piece if self.cut == "blank" or head == b"\n" else b" " + piece
        return bare.decode("utf-8", "replace")

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and token counts of words of letters only, encoded as one text: the vocabulary shows where a word starts
        (byte-level, a leading blank) or ends (a suffix)."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        joined = " " * (self.cut == "byte") + " ".join(texts)
        ids = np.array(self.library([joined])[0], np.uint32)
        edge = np.flatnonzero(self.edges[ids])
        sizes = np.diff(edge, append=len(ids)) if self.cut == "byte" else np.diff(edge, prepend=-1)
        if len(sizes) != len(texts) or sizes.sum() != len(ids):
            each = self.library([" " * (self.cut == "byte") + t for t in texts])
            return np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64)
        return ids, sizes

    def learn(self, whole: list[bytes]):
        """Encodes the waiting pieces. A word and the marks behind it are separate pre-tokens, so a word with marks is the
        word, itself a known piece, and the marks."""
        waiting, base, done = self.known.waiting, len(self.sizes), 0
        joined, words, bare, others, texts = {}, [], [], [], []
        while done < len(waiting):  # once more for the words and marks that are new as well
            # pieces hold no blank, and their first bytes that UTF-8 never uses become no letters
            fresh = b" ".join(waiting[done:]).decode("utf-8", "replace").split(" ")
            for number, (piece, text) in enumerate(zip(waiting[done:], fresh), base + done):
                if PLAIN.fullmatch(text):
                    words.append(number)
                    bare.append(text)
                    continue
                core = piece.rstrip(MARKS)
                if 0 < len(core) < len(piece) and PLAIN.fullmatch(core.decode("utf-8", "replace")):
                    marks = piece[len(core):]
                    joined[number] = self.known[core], self.known[marks if self.cut == "blank" else FIRST + marks]
                else:
                    others.append(number)
                    texts.append(self.raw(piece, whole))
            done += len(fresh)
        ids, counts = self.words(bare)
        each = self.library(texts)
        sizes = np.zeros(len(waiting), np.int64)
        starts = np.zeros(len(waiting), np.int64)
        sizes[np.array(words, np.int64) - base] = counts
        starts[np.array(words, np.int64) - base] = len(self.pool) + np.cumsum(counts) - counts
        self.pool.frombytes(ids.tobytes())
        for number, own in zip(others, each):
            starts[number - base], sizes[number - base] = len(self.pool), len(own)
            self.pool.extend(own)
        self.starts.frombytes(starts.tobytes())
        self.sizes.frombytes(sizes.tobytes())
        for number, parts in joined.items():
            own = [i for n in parts for i in self.pool[self.starts[n]:self.starts[n] + self.sizes[n]]]
            self.starts[number], self.sizes[number] = len(self.pool), len(own)
            self.pool.extend(own)
        self.known.waiting = []

    def pieces(self, texts: list[bytes]):
        """The different pieces of a chunk and their places, an END after each text; and the texts that are encoded in one piece."""
        if self.cut == "blank":
            joined = (b" " + END + b" ").join(t if b"<" in t or self.special else t.lower() for t in texts) + b" " + END
            joined, whole = joined.translate(SPLITS), []
        else:
            whole = [t for t in texts if self.cut == "whole" or self.irregular(t)]
            if whole:
                numbers = iter(range(len(whole)))
                texts = [WHOLE + b"%d" % next(numbers) if self.cut == "whole" or self.irregular(t) else FIRST + t for t in texts]
                joined = (b" " + END + b" ").join(texts)
            else:
                joined = FIRST + (b" " + END + b" " + FIRST).join(texts)
            joined = joined.replace(b"\n", b" \n") + b" " + END
        if self.cut != "whole":
            joined = marks_apart(joined, b" " if self.cut == "blank" else b" " + FIRST)
        low, joined = 0, joined + b" "
        while low < len(joined):
            high = joined.find(b" ", low + CHUNK) + 1 or len(joined)
            yield *distinct(joined[low:high], self.cut != "blank"), whole
            low = high

    def numbers(self, texts: list[bytes]):
        """Numbers of pieces, chunk by chunk, all known by then."""
        for pieces, places, whole in self.pieces(texts):
            if len(self.known) > self.limit:
                self.forget()
            numbers = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))[places]
            learnt = self.known.waiting
            if learnt:
                self.learn(whole)
            self.count(numbers)
            yield numbers
            if whole:  # their numbers are used once
                for piece in pieces:
                    if piece[:1] == WHOLE:
                        self.known[piece + b"-%d" % len(self.known)] = self.known.pop(piece)

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text, its end ids included."""
        found, open_ = [], 0
        for numbers in self.numbers(texts):
            total = np.cumsum(np.frombuffer(self.sizes, np.int64)[numbers])
            ends = total[numbers == 0]
            if len(ends):
                counts = np.diff(ends, prepend=0)
                counts[0] += open_
                found.append(counts)
                open_ = int(total[-1] - ends[-1])
            elif len(total):
                open_ += int(total[-1])
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other with their end ids, and how many each has."""
        ids, counts, open_ = [], [], 0
        for numbers in self.numbers(texts):
            sizes = np.frombuffer(self.sizes, np.int64)[numbers]
            total = np.cumsum(sizes)
            where = spans(np.frombuffer(self.starts, np.int64)[numbers], sizes)
            ids.append(np.frombuffer(self.pool, np.uint32)[where] if len(where) else np.zeros(0, np.uint32))
            ends = total[numbers == 0]
            if len(ends):
                found = np.diff(ends, prepend=0)
                found[0] += open_
                counts.append(found)
                open_ = int(total[-1] - ends[-1])
            elif len(total):
                open_ += int(total[-1])
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), (np.concatenate(counts) if counts else np.zeros(0, np.int64))

    def irregular(self, text: bytes) -> bool:
        """Whether it has three blanks in a row, ends with two, or holds a special token, which ends the text before it."""
        plain = text.translate(ANY_BLANK)
        if b"   " in plain or plain.endswith(b"  ") or any(t in text for t in self.added):
            return True
        if any(blank in text for blank in OTHER_BLANKS):
            return LONG_RUN.search(text.decode("utf-8", "replace")) is not None
        return False
