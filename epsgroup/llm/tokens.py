"""Token ids of a byte-level BPE vocabulary file, for use inside tasks."""

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Fixed value: how the vocabulary's texts are cut into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Characters on whose class (letter, number, white space) any two Unicode versions agree. Other texts take the slow way.
_RARE = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")


def _byte_of() -> dict[str, int]:
    """The vocabulary writes printable bytes as themselves and the others as the characters from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """encode(text): the ids of tokenizers.Tokenizer.from_file(path) without special tokens.

    The file's vocabulary runs in tiktoken, which gives the same ids several times faster.
    """

    def __init__(self, path: str):
        self.plain = Tokenizer.from_file(path)
        with open(path) as file:
            model = json.load(file)
        special = {x["content"] for x in model["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(special))) or r"(?!)")
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if _RARE.search(text) or self.special.search(text):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
