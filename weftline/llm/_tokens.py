"""Token ids of a public byte-level BPE vocabulary, whose file is a parameter."""

from __future__ import annotations

import json

import numpy as np

_loaded: dict[tuple, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 upwards, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _fast(path: str):
    """An encoder with the same ids that works several times faster, or None if the file isn't of the kind it covers."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, added = spec["model"], spec.get("added_tokens") or ()
    special = {x["content"]: x["id"] for x in added}
    if any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
        return None
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
    merged = [model["vocab"].get("".join(x.split(" ") if isinstance(x, str) else x)) for x in model["merges"]]
    if None in merged or merged != sorted(merged) or len(ranks) != 256 + len(merged):
        return None  # the order of merges isn't the order of ids
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoder(path: str, special: bool = True):
    """text -> uint32 ids, none added at the ends. Kept by worker process.

    A special token's string in a text is that token, as by the library's plain call; without ``special`` it is ordinary text.
    """
    if (path, special) not in _loaded:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        slow.encode_special_tokens = not special
        by_file = lambda text: np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        fast = _fast(path)

        def encode(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=())
            except BaseException as e:  # its regular expressions can run out of stack on very long runs of spaces
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
                return by_file(text)

        _loaded[path, special] = encode if fast else by_file
    return _loaded[path, special]
