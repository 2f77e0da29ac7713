"""Whole-text tokenizing with the public vocabularies, fast and with bounded memory.

The `tokenizers` library defines the ids. Its files are byte-pair vocabularies, and a second engine, tiktoken, merges
pairs several times faster from the same merges. So a text goes to tiktoken when it lies in the range where both are
known to agree (see each class), and to the library when not. Tests compare the two on both sides of that line.

tiktoken joins any neighbours whose joining is a token, the library only listed pairs. Both do the same if ids rise with the order of
merges and each merged token, taken alone, is merged to itself (agrees() checks both for every token): what happens within a stretch
of a text doesn't depend on what is around it until something is joined across its ends, so the two halves of a token that stand
side by side are those that its own merging passes through. A vocabulary that fails the check goes to the library alone.
"""

from __future__ import annotations

import json
import os

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters up to U+024F that both engines take for the same kind; the two languages' tables of white space differ on the others.
_CLEAR = np.ones(0x250, bool)
_CLEAR[[0x1C, 0x1D, 0x1E, 0x1F, 0x85]] = False


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes take code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _pairs(spec: dict) -> list[tuple[str, str]]:
    return [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]


def agrees(tokens: dict[str, int], merges: list[tuple[str, str]]) -> bool:
    """Whether ids of merged tokens rise with the merges, and each of them is what its own symbols are merged to."""
    from tokenizers import Tokenizer, models

    names = [a + b for a, b in merges]
    if any(tokens[x] >= tokens[y] for x, y in zip(names, names[1:], strict=False)):
        return False
    alone = Tokenizer(models.BPE(vocab=tokens, merges=merges))
    return all(e.ids == [tokens[t]] for at in range(0, len(names), 2000) for t, e in zip(names[at : at + 2000], alone.encode_batch(names[at : at + 2000]), strict=True))


class ByteLevel:
    """Byte-level vocabularies whose ids of merges follow the merges' order. tiktoken takes texts up to U+024F without
    special strings."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        special = {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.size = self.library.get_vocab_size()
        self.ok = agrees({t: i for t, i in vocab.items() if t not in special}, _pairs(spec))
        # The pattern of the byte-level pre-tokenizer (fixed value).
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = special

    def _known(self, text: str) -> bool:
        if any(t in text for t in self.special):
            return False
        x = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
        return x.max() < len(_CLEAR) and bool(_CLEAR[x].all())

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if self.ok and self._known(text):
            return np.asarray(self.fast.encode_ordinary(text), "<u4")
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4")


class WordLevel:
    """Lower-casing byte-pair vocabularies with an end-of-word mark and dropped white space. tiktoken takes Latin-1
    texts without apostrophes (contractions are pieces of their own) or special strings. A byte at a word's end
    becomes a symbol of its own, so that the mark is part of the alphabet."""

    END = "</w>"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters, end = spec["model"]["vocab"], byte_letters(), self.END

        def told(token: str) -> str:
            stem = token.removesuffix(end)
            codes = [letters[c] + (0x100 if letters[c] >= 128 else 0) for c in stem]
            if token != stem:
                codes[-1] = letters[stem[-1]] + 0x200
            return "".join(map(chr, codes))

        base = [told(c) for c in letters] + [told(c + end) for c in letters]
        merged = [a + b for a, b in _pairs(spec)]
        ranks = {bytes([b]): b for b in range(256)}
        owner = [-1] * 256
        for name, token in [*zip(base, [*letters, *(c + end for c in letters)], strict=True), *((told(t), t) for t in merged)]:
            key = name.encode()
            if len(key) == 1:
                owner[key[0]] = vocab[token]
            elif key not in ranks:
                ranks[key] = len(owner)
                owner.append(vocab[token])
        self.owner, self.size = np.array(owner, np.int64), self.library.get_vocab_size()
        named = {t: i for i, t in enumerate(dict.fromkeys([*base, *map(told, merged)]))}
        self.ok = agrees(named, [(told(a), told(b)) for a, b in _pairs(spec)])
        self.fast = tiktoken.Encoding("word_level", pat_str="[^Ȁ-˿]*[Ȁ-˿]", mergeable_ranks=ranks, special_tokens={})
        import regex

        latin = [chr(i) for i in range(256)]
        self.kind = np.array([0 if regex.match(r"\s", c) else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3 for c in latin], np.uint8)

    def _symbols(self, text: str) -> str | None:
        """The text in the alphabet of the fast engine; None for texts that it isn't sure of."""
        try:
            raw = text.lower().encode("latin-1")
        except UnicodeEncodeError:
            return None
        x = np.frombuffer(raw, np.uint8)
        if b"'" in raw or b"<|" in raw or not _CLEAR[x].all():
            return None
        kind = self.kind[x]
        after = np.append(kind[1:], 0)
        last = (kind == 2) | (kind != after)
        keep = kind > 0
        x, last = x[keep].astype(np.uint16), last[keep]
        wide = x >= 128
        if not wide.any():
            return (x + last * np.uint16(0x200)).tobytes().decode("utf-16-le")
        at = np.cumsum(1 + wide) - 1  # of each character's last byte
        out = np.empty(len(x) + int(wide.sum()), "<u2")
        out[at] = np.where(wide, 0x80 | (x & 0x3F), x) + np.where(last, 0x200, np.where(wide, 0x100, 0))
        out[at[wide] - 1] = 0x100 + (0xC0 | (x[wide] >> 6))
        return out.tobytes().decode("utf-16-le")

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        symbols = self._symbols(text) if self.ok else None
        if symbols is not None:
            return self.owner[np.asarray(self.fast.encode_ordinary(symbols), np.int64)].astype("<u4")
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4")


_made: dict[tuple[type, str], ByteLevel | WordLevel] = {}


def encoder(kind: type, path: str) -> ByteLevel | WordLevel:
    """One per worker process."""
    if (kind, path) not in _made:
        _made[kind, path] = kind(path)
    return _made[kind, path]
