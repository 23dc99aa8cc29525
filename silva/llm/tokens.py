"""Token ids of whole texts with the tokenizers library, each distinct word encoded once per worker.

The tokenizer's pattern never joins characters across white space, so a text is split at ASCII
white space and each distinct word is encoded alone; ``tests/llm`` compares this with encoding
whole texts. Words of ASCII and Latin letters without special-token marks go to the model through the
pattern's pieces; all others go through the full tokenizer. A file whose rules aren't those that this relies on
encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import chain

import numpy as np

#: Distinct words that a worker remembers at most; then it starts afresh.
REMEMBERED = 500_000
#: Bytes that the vocabulary writes as other characters: each unprintable one as 256 + its rank among them.
_BYTES = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}

_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+", re.ASCII)
#: ASCII but white space, and the composed letters of Latin-1: lower-casing and composing leave their count alone.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
# The rules of the tokenizer file for which the above holds.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_workers: dict[str, WordEncoder] = {}


def _as_known(path: str) -> bool:
    """Whether the tokenizer file has the rules that allow to encode word by word."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    normal, split = found.get("normalizer") or {}, found.get("pre_tokenizer") or {}
    kinds = [x.get("type") for x in normal.get("normalizers", [])]
    steps = split.get("pretokenizers", [])
    own = len(steps) == 2 and steps[0].get("pattern") == {"Regex": _SPLIT} and steps[0].get("invert") is True and steps[1].get("type") == "ByteLevel" and steps[1].get("use_regex") is False and not steps[1].get("add_prefix_space")
    return kinds == _NORMAL and own and found["model"].get("type") == "BPE" and not found["model"].get("dropout")


class _Numbers(dict):
    """Words numbered from 0 in the order they are first asked for; those asked for lately are ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """Encodes texts to ids, word by word, remembering words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.by_word = _as_known(path)
        self.flat = np.zeros(1 << 20, dtype=np.uint32)
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, bytes] = {}
        self.words = _Numbers()
        self.ends = array("q", [0])

    def _piece(self, piece: str) -> bytes:
        """The ids of one piece of the pattern as 4-byte integers."""
        found = self.pieces.get(piece)
        if found is None:
            found = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_BYTES))]).tobytes()
        return found

    def _learn(self) -> None:
        """Encode the new words."""
        made = []
        for word in self.words.new:
            text = word.decode("utf-8", "surrogatepass")
            if text.isascii() and text.isalpha():
                made.append(self._piece(text.lower()))
            elif _PLAIN.fullmatch(text) and "<|" not in text:
                made.append(b"".join([self._piece(piece) for piece in _PIECES.findall(text.lower())]))
            else:
                made.append(array("I", self.full.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids).tobytes())
        self.words.new = []
        ids = np.frombuffer(b"".join(made), dtype=np.uint32)
        at = self.ends[-1]
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[at : at + len(ids)] = ids
        self.ends.frombytes((at + np.cumsum([len(b) // 4 for b in made], dtype=np.int64)).tobytes())

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, one after another, as uint32, and the count of each text; ``end_id`` closes each text."""
        if not self.by_word:
            own = [x.ids for x in self.full.encode_batch([t.encode("utf-8", "replace").decode() for t in texts], add_special_tokens=False)]
            end = [] if end_id is None else [end_id]
            return np.array([i for ids in own for i in (*ids, *end)], dtype=np.uint32), np.array([len(ids) + len(end) for ids in own], dtype=np.int64)
        if len(self.words) > REMEMBERED:
            self._forget()
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        per_text = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        which = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(per_text.sum()))
        if self.words.new:
            self._learn()
        ends = np.frombuffer(self.ends.tobytes(), dtype=np.int64)
        lengths = ends[which + 1] - ends[which]
        text_of = np.repeat(np.arange(len(texts)), per_text)
        counts = np.bincount(text_of, weights=lengths, minlength=len(texts)).astype(np.int64) if len(texts) else np.zeros(0, dtype=np.int64)
        total = int(lengths.sum())
        before = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
        ids = self.flat[np.repeat(ends[which] - before, lengths) + np.arange(total)]
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
        return ids, counts


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for the tokenizer file at ``path``."""
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]


def default_tokenizer() -> str:
    """Where the public word tokenizer lies; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
