"""Whole texts to token ids of a byte-level BPE file."""

from __future__ import annotations

import functools
import json

#: Fixed value: the pre-tokenizer pattern of the byte-level files (see their README).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: character -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return table | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Ids of texts, as the tokenizers library gives them without added special tokens.

    The file's merges are handed to the faster encoder of another package; nothing is remembered between texts.
    """

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        model, alphabet = spec["model"], byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in merges]
        if order != sorted(order):
            raise ValueError("the ids of merged tokens do not follow the order of the merges")
        self.codec = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; null and empty texts have none."""
        if not text:
            return b""
        special = "all" if any(s in text for s in self.special) else set()
        return self.codec.encode_to_numpy(text, allowed_special=special, disallowed_special=()).astype("<u4", copy=False).tobytes()


@functools.lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for a worker process and file."""
    return ByteBpe(path)
