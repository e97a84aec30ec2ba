"""Public tokenizers inside tasks, with caches per Python worker.

A tokenizer whose pre-tokenizer drops white space gives a text the ids of its
white-space separated words, one after the other. Such a tokenizer encodes
each distinct word once per worker; others encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
import struct
from typing import List, Tuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import GenerationCache, spread, text_bytes, text_column, worker_state

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"

#: Fixed value: the word tokenizer's split pattern as its file spells it.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words whose split needs no Unicode tables: ASCII without "<" (special
#: strings start with it) and the Latin-1 letters. Composition leaves them as
#: they are and lower case is one to one.
_PLAIN = re.compile(r"[!-;=-~À-ÖØ-öø-ÿ]+")
_PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Kinds of bytes: white space, letters, digits, others of plain words, and
#: those whose words are not cut as bytes (an apostrophe may begin a piece).
_SPACE, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)
_KINDS = np.array([_SPACE if chr(b) in " \t\n\v\f\r" else _WHOLE if b < 33 or b > 126 or chr(b) in "<'" else
                   _DIGIT if chr(b).isdigit() else _LETTER if chr(b).isalpha() else _OTHER for b in range(256)], dtype=np.uint8)
_LOWER = np.array([b | 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def _cut(column: pa.Array) -> Tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where those of each text begin, with the
    end. A word of ASCII letters, digits and other plain characters comes in
    lower case and as its pieces, any other as it is."""
    data, at = text_bytes(column)
    if not len(data):
        return text_column(data, np.zeros(1, np.int64)), np.zeros(len(at), np.int64)
    kind = _KINDS[data]
    inside = kind != _SPACE
    rows = at[(at > 0) & (at < len(data))]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[rows] = inside[rows]
    ends[:-1] &= ~inside[1:]
    ends[rows - 1] = inside[rows - 1]
    words, stops = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    whole = np.maximum.reduceat(kind, words) == _WHOLE if len(words) else np.zeros(0, bool)
    begins = starts.copy()
    begins[1:] |= inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    begins = np.flatnonzero(begins)
    first = starts[begins]
    word = np.cumsum(first) - 1
    kept = first | ~whole[word]
    begins, first, word = begins[kept], first[kept], word[kept]
    # a piece ends where the next of its word begins, the last with the word
    last = np.append(first[1:], True)[:len(first)]
    size = np.where(last, stops[word], np.append(begins[1:], 0)[:len(begins)]) - begins
    data = data[inside]
    data = np.where(np.repeat(whole, stops - words), data, _LOWER[data])
    return text_column(data, np.concatenate([[0], np.cumsum(size)])), np.searchsorted(begins, at)


def resolve(tokenizer: str) -> str:
    """A path, or the name of a file of the ``public_tokenizers`` package."""
    if os.path.isabs(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def _byte_letters() -> dict:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others, in order, for the code points from 256 on."""
    own = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class WordEncoder:
    """Token ids of texts as little-endian bytes (``dtype``)."""

    def __init__(self, tokenizer: str, capacity: int = 300_000):
        from tokenizers import Tokenizer

        path = resolve(tokenizer)
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        size = max([*conf["model"]["vocab"].values(), *(t["id"] for t in conf["added_tokens"])]) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        steps = (conf.get("pre_tokenizer") or {}).get("pretokenizers") or []
        first = steps[0] if steps else {}
        dropping = (first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
                    and "\\s" in str(first.get("pattern")) and conf.get("post_processor") is None)
        plain = dropping and first["pattern"].get("Regex") == WORD_SPLIT
        self.by_word, self.plain = bool(dropping), bool(plain)
        letters = _byte_letters()
        self.map = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(33, 256)}
        # a batch looks a word up once; pieces of words that are not cut as bytes are found again where words differ
        self.pieces = GenerationCache(self._piece, capacity // 3 if plain else capacity)
        self.words = GenerationCache(self._plain_word if plain else self._word, capacity)

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        return self._ids(word)

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.tok.model.tokenize(piece.translate(self.map))]
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def _plain_word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():  # one piece, kept as a word
            return self._piece(word.lower())
        if not _PLAIN.fullmatch(word):
            return self._ids(word)
        return b"".join(map(self.pieces.__getitem__, _PLAIN_SPLIT.findall(word.lower())))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, cut into words at ASCII white space only."""
        if self.by_word:
            return b"".join(map(self.words.__getitem__, (w.decode() for w in text.encode().split())))
        return self._ids(text)

    def encode_column(self, column: pa.Array) -> Tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a column, their ends). Words, and pieces of
        plain words, are cut as bytes; only the distinct ones are looked up one
        by one."""
        column = pc.fill_null(column, "")
        if not self.by_word:
            parts = [self._ids(t) for t in column.to_pylist()]
            ends = np.cumsum([len(p) // self.dtype.itemsize for p in parts], dtype=np.int64)
            return np.frombuffer(b"".join(parts), self.dtype), ends
        if self.plain:
            words, edges = _cut(column)
        else:
            words = pc.ascii_split_whitespace(column)
            edges = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
            words = words.flatten()
        coded = words.dictionary_encode()
        parts = list(map(self.words.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // self.dtype.itemsize
        ids, last = spread(np.frombuffer(b"".join(parts), self.dtype), np.cumsum(size) - size, size, coded.indices.to_numpy(zero_copy_only=False))
        return ids, np.concatenate([[0], last])[edges[1:]]


def word_encoder(tokenizer: str) -> WordEncoder:
    return worker_state(("word-encoder", tokenizer), lambda: WordEncoder(tokenizer))


class PieceCounter:
    """Token counts of a sentencepiece model, whole text or by pre-token.

    A pre-token is a run of spaces with the non-spaces after it. No piece of
    the models meant here holds a space after another character, so merges
    never leave a pre-token and counts add up; ``additive`` tells whether the
    loaded model's vocabulary is like that.
    """

    SPACE = "▁"
    PROBES = ("", " ", "  ", "a", "a ", " a", "a  b", "a\nb c", "x　y", "café au lait", "ﬁn", "Á b", "1 000,5 €")

    def __init__(self, tokenizer: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=resolve(tokenizer))
        inner = any(self.SPACE in self.sp.id_to_piece(i).lstrip(self.SPACE) for i in range(self.sp.vocab_size()))
        self.additive = not inner and all(
            sum(map(self.unit, self.units(p))) == self.whole(p) for p in self.PROBES)

    def whole(self, text: str) -> int:
        return len(self.sp.encode(text))

    def unit(self, unit: str) -> int:
        """Tokens of a pre-token given without its first space, which the
        model's own dummy prefix restores."""
        return len(self.sp.encode(unit)) if unit else 1

    def units(self, text: str) -> List[str]:
        """Pre-tokens, each without its first space; the model puts one space
        before a text, and reads its own space mark as a space."""
        if not text:
            return []
        if self.SPACE in text:
            text = text.replace(self.SPACE, " ")
        if "  " not in text and text[0] != " ":
            return text.split(" ")
        return [u[1:] for u in re.findall(r" +[^ ]*", " " + text)]


def piece_counter(tokenizer: str) -> PieceCounter:
    return worker_state(("piece-counter", tokenizer), lambda: PieceCounter(tokenizer))
