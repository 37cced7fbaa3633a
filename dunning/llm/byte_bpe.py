"""Byte-level BPE encoding by a `tokenizers` file, with a faster encoder for plain texts.

The ids are those of the `tokenizers` library.  Its vocabulary is also given to
`tiktoken`, which merges by the same ranks several times faster; that encoder takes
the texts for which both split alike beyond doubt: Latin letters, no special token
and no very long run of letters or spaces.  Any other text goes to the library.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np

#: The splitting pattern of byte-level BPE with 50k ids (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-ɏ]")
_LONG_RUN = re.compile(r"\S{5000}|\s{5000}")


def _bytes_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.special = [t["content"] for t in held.get("added_tokens", [])]
        self.fast = self._fast(held)

    @functools.cached_property
    def whole(self):
        """The library's tokenizer, opened when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _fast(self, held: dict):
        """The second encoder, or None if the file's merges are not in the order of its ids."""
        import tiktoken

        split = held.get("pre_tokenizer") or {}
        if held["model"].get("type") != "BPE" or held.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space"):
            return None
        vocabulary = {k: v for k, v in held["model"]["vocab"].items() if k not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        if made != sorted(made) or len(made) + 256 != len(vocabulary):
            return None
        byte = _bytes_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}
        return tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if (self.fast is None or _OTHER.search(text) or any(x in text for x in self.special)
                or len(text) > 5000 and _LONG_RUN.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(array("I", self.fast.encode_ordinary(text)), "<u4").tobytes()


_open: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each file in a process."""
    if path not in _open:
        _open[path] = ByteBpe(path)
    return _open[path]
