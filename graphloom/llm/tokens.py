"""Token ids of whole texts by a public byte-level vocabulary file of the tokenizers library."""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np

#: Id that ends a document.
END = 1
#: Vocabulary of the queries.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_ranks(model: dict) -> dict[bytes, int] | None:
    """Ids by bytes, if ids follow the order of merges, so that the lowest id is the first merge; else None."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}
    vocab = model["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged) or model.get("ignore_merges"):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t) and (len(t) == 1 or merged[0] <= i <= merged[-1])}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens, as tokenizers does.

    Where ids follow the order of merges, the merging itself is done by tiktoken, with the file's own vocabulary, which
    takes a quarter of the time; tests hold its ids against those of tokenizers.
    """

    def __init__(self, path: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.path = path or vocabulary_path()
        self.tokenizer = Tokenizer.from_file(self.path)
        self.tokenizer.encode_special_tokens = True
        with open(self.path) as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        ranks = _byte_ranks(spec["model"]) if plain else None
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _one(self, text: str) -> bytes:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text).astype(np.uint32).tobytes()
            except (ValueError, RuntimeError, MemoryError):  # its pattern gives up on a text
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        return [self._one(t) for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    path = path or vocabulary_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
