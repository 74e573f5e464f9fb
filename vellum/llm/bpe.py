"""Byte-pair encoders built from a tokenizer's JSON file, exact and fast.

A merge table becomes byte-string ranks, so that one call encodes many pieces.  Two kinds are known: byte level (a
pattern splits the text, a blank leads its word) and word end (each piece ends in a mark, white space is dropped).  A
file of another shape is refused rather than guessed at.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np
import regex
import tiktoken

# fixed values: the patterns that the two kinds split by
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "\0"


@cache
def assigned(char: str) -> bool:
    """Is it a character of the Unicode version whose tables the fast way goes by?  Later ones may be letters to one library only."""
    return unicodedata.category(char) != "Cn"


def lower(text: str) -> str:
    """Lower case letter by letter: a capital sigma at the end of a word is like any other."""
    return text.replace("\u03a3", "\u03c3").lower()


@cache
def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model.get("type") != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges"):
        raise ValueError(f"{path}: a plain BPE model is needed")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: added tokens that change the text around them aren't supported")
    return spec


def _pairs(model: dict) -> list[tuple[str, str]]:
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]


class _Added:
    """Strings that become one id wherever they stand."""

    def __init__(self, tokens: list[dict]):
        self.ids = {t["content"]: t["id"] for t in tokens}
        self.pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.ids, key=len, reverse=True))) + ")") if self.ids else None

    def split(self, text: str) -> list[str]:
        return self.pattern.split(text) if self.pattern and any(k in text for k in self.ids) else [text]


class ByteLevel:
    """Encoder of the byte-level kind."""

    def __init__(self, path: str):
        spec = _load(path)
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec["normalizer"] or spec["model"].get("end_of_word_suffix"):
            raise ValueError(f"{path}: not of the byte-level kind")
        of = byte_of_char()
        self.added = _Added(spec["added_tokens"])
        text_of = {i: bytes(of[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in self.added.ids}
        ranks = {bytes([b]): b for b in range(256)}
        for a, b in _pairs(spec["model"]):
            ranks.setdefault(bytes(of[c] for c in a + b), len(ranks))
        id_of = {t: i for i, t in text_of.items()}
        self.id_of_rank = np.array([id_of[t] for t in ranks], np.uint32)
        self.rank_of_id = {int(i): r for r, i in enumerate(self.id_of_rank)}
        self.bytes_of = text_of | {i: t.encode() for t, i in self.added.ids.items()}
        self.core = tiktoken.Encoding(path, pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(BYTE_PATTERN)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        out = []
        for part in self.added.split(text):
            if part in self.added.ids:
                out.append(np.array([self.added.ids[part]], np.uint32))
            elif part:
                out.append(self.id_of_rank[self.core.encode_to_numpy(part, disallowed_special=())])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def encode_piece(self, raw: bytes) -> list[int]:
        """Ids of bytes that no pattern splits."""
        return self.id_of_rank[self.core._encode_single_piece(raw)].tolist()

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


class WordEnd:
    """Encoder of the word-end kind.  A NUL byte stands for the end mark; words that hold one take the slow way."""

    #: Words kept with their ids; beyond, the store starts anew.
    KEEP = 400_000

    def __init__(self, path: str):
        spec = _load(path)
        steps = [s.get("type") for s in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if steps != ["NFC", "Replace", "Lowercase"] or pre[0].get("pattern", {}).get("Regex") != WORD_PATTERN or spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError(f"{path}: not of the word-end kind")
        of = byte_of_char()
        self.added = _Added(spec["added_tokens"])
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.added.ids}

        def raw(token: str) -> bytes:
            return bytes(of[c] for c in token[:-4]) + END.encode() if token.endswith("</w>") else bytes(of[c] for c in token)

        ranks = {bytes([b]): b for b in range(256)}
        for b in range(1, 256):
            ranks[bytes([b, 0])] = len(ranks)
        for a, b in _pairs(spec["model"]):
            ranks.setdefault(raw(a + b), len(ranks))
        id_of = {raw(t): i for t, i in vocab.items()}
        self.id_of_rank = np.array([id_of.get(t, -1) for t in ranks], np.int64)
        ends = np.array([t.endswith(b"\0") for t in ranks], bool)
        self.ends = ends
        self.core = tiktoken.Encoding(path, pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(WORD_PATTERN)
        self.path, self.kept, self.slow, self.n_slow = path, {}, None, 0
        self.dtype = np.dtype("<u2") if max([*vocab.values(), *self.added.ids.values()], default=0) < 1 << 16 else np.dtype("<u4")

    def _slow(self, word: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(word, add_special_tokens=False).ids

    def _learn(self, words: list[bytes]) -> None:
        fast, pieces, counts = [], [], []
        for w in words:
            word = w.decode("utf-8", "replace")
            if END in word or any(k in word for k in self.added.ids) or not (word.isascii() or all(map(assigned, word))):
                self.n_slow += 1
                self.kept[w] = np.array(self._slow(word), self.dtype).tobytes()
            else:
                own = self.pieces.findall(lower(word if word.isascii() else unicodedata.normalize("NFC", word)))
                fast.append(w), counts.append(len(own))
                pieces += own
        if not fast:
            return
        ranks = self.core.encode_to_numpy(END.join(pieces) + END, disallowed_special=()) if pieces else np.zeros(0, np.uint32)
        ids = self.id_of_rank[ranks].astype(self.dtype).tobytes()
        piece_end = np.concatenate([[0], np.flatnonzero(self.ends[ranks]) + 1]) * self.dtype.itemsize
        at = piece_end[np.concatenate([[0], np.cumsum(counts)])].tolist()
        for w, a, b in zip(fast, at[:-1], at[1:], strict=True):
            self.kept[w] = ids[a:b]

    def encode_all(self, group: list[str]) -> list[bytes]:
        """Packed ids of whole texts.  Blanks never cross a word, so each word is encoded once and kept."""
        split = [t.encode("utf-8", "surrogatepass").split() for t in group]
        if len(self.kept) > self.KEEP:
            self.kept = {}
        new = set().union(*split).difference(self.kept) if split else set()
        if new:
            self._learn(list(new))
        get = self.kept.__getitem__
        return [b"".join(map(get, words)) for words in split]


@cache
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@cache
def word_end(path: str) -> WordEnd:
    return WordEnd(path)
