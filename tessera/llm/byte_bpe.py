"""Byte-level BPE as the two token operators use it: exact ids, token lengths, and the places in a
text at which any context splits tokens.

Ids equal those of the tokenizers library for the same file. The file must be a plain byte-level BPE
(ids in merge order, one splitting rule, no normaliser); a faster library does the merging over the
same ranks; a file of any other make is refused.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np

#: Fixed value: the splitting rule of byte-level BPE files with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def printable_bytes() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: bytes that print stand for themselves, the others,
    in order, for the code points from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, path: str):
        import tiktoken

        spec = json.loads(open(path, encoding="utf-8").read())
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        plain = (
            model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["normalizer"] is None
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges))
            and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        )
        if not plain:
            raise ValueError("not a plain byte-level BPE file")
        stand_in = printable_bytes()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(stand_in[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.tokens = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.coder = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.coder.encode(text, allowed_special="all")
        return self.coder.encode_ordinary(text)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_INK = np.zeros(256, bool)
_INK[33:127] = True
SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
#: White space beyond ASCII.
WIDE_SPACES = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """What the splitting rule takes each of the first 65,536 code points for. Unsure are those that
    editions of Unicode don't agree on, and those beyond."""
    table = np.full(0x10001, UNSURE, np.uint8)
    of = {"L": LETTER, "N": NUMBER}
    for c in range(0x10000):
        old, new = unicodedata.ucd_3_2_0.category(chr(c)), unicodedata.category(chr(c))
        if old[0] == new[0] and new[0] in "LNMPS":
            table[c] = of.get(new[0], OTHER)
    table[[9, 10, 11, 12, 13, 32, *WIDE_SPACES]] = SPACE
    return table


def stable(data: np.ndarray, special: tuple[str, ...] = ()) -> np.ndarray:
    """Offsets p at which any text that holds these bytes (whole characters) is split, whatever stands
    before or after. No special token has a space.

    Where an ASCII character that isn't a space precedes and an ASCII space follows: in the splitting
    rule no piece goes on with a space after a character that isn't one, so the tokens before p depend
    on nothing after the space, and those from p on nothing before. If there is no such place, then
    also where any other space follows, and between letters, numbers and other signs (but for other
    signs before letters, as in 's): no piece has two of these. Pairs of characters that stand inside
    a special token are left out."""
    places = np.flatnonzero(_INK[data[:-1]] & _SPACE[data[1:]]) + 1 if len(data) > 1 else np.empty(0, np.int64)
    if len(places) or len(data) < 2:
        return places
    point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    kind = kinds()[np.minimum(point, 0x10000)]
    before, after = kind[:-1], kind[1:]
    split = (before != after) & (before != SPACE) & (before != UNSURE) & (after != UNSURE) & ~((before == OTHER) & (after == LETTER))
    for token in special:
        for a, b in zip(token, token[1:]):
            split &= ~((point[:-1] == ord(a)) & (point[1:] == ord(b)))
    width = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
    return np.cumsum(width)[:-1][split]
