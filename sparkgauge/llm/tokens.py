"""Token ids by a byte-level BPE file of the tokenizers library.

Where it can be shown to give the library's ids, tiktoken encodes a text, as it is several times as fast. It merges
whatever two neighbours make a token together, the earliest token first; the library merges the pairs that the file lists, in their order.
Both agree if tokens are numbered in the order of their merges and every token, encoded alone, is that one token: then its bytes
are never split in another way when its turn comes, whatever stands around them. Both conditions are checked when a file is loaded, and
so are its normaliser, pre-tokenizer and model. Any other file, and texts on which pattern engines may differ, go through the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from pathlib import Path

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose kind all Unicode versions agree on: Latin letters and common punctuation, but for four controls that only some engines count as space.
UNUSUAL = re.compile("[\x1c-\x1f]|[^\x00-ɏ‐-‧€]")
#: A longer word, or so much white space above one character a word, takes quadratic time in tiktoken.
LONG = 400


def pack(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if out.itemsize != 4 or os.sys.byteorder != "little":
        return b"".join(int(i).to_bytes(4, "little") for i in out)
    return out.tobytes()


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level BPE writes for bytes: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def quick_encoder(spec: dict, tokenize):
    """A tiktoken encoding that gives the ids of a tokenizer file's content, or None where that can't be shown. tokenize is the library's model."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) != ("ByteLevel", False, True):
        return None
    letters = {chr(v): k for k, v in _byte_letters().items()}
    vocab, added = model["vocab"], {t["content"] for t in spec.get("added_tokens", ())}
    words = {k: v for k, v in vocab.items() if k not in added}
    if not all(set(k) <= letters.keys() for k in words) or not letters.keys() <= words.keys():
        return None
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    numbers = [vocab.get(m, -1) for m in merged]
    if any(a >= b for a, b in zip(numbers, numbers[1:], strict=False)) or {*merged, *letters} != words.keys():
        return None
    if any([t.id for t in tokenize(m)] != [n] for m, n in zip(merged, numbers, strict=True)):
        return None
    import tiktoken

    return tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks={bytes(letters[c] for c in k): v for k, v in words.items()}, special_tokens={})


def is_common(text: str) -> bool:
    """Whether all engines cut a text into the same words, none of them very long."""
    if UNUSUAL.search(text) if not text.isascii() else any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return False
    words = text.split()
    return max(map(len, words), default=0) <= LONG and len(text) - sum(map(len, words)) <= len(words) + LONG


@lru_cache(4)
def encoder(path: str):
    """A function text -> ids as bytes, with the tokenizer file at path, which every executor must have."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    quick, added = quick_encoder(json.loads(Path(path).read_text("utf-8")), whole.model.tokenize), [t.content for t in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> bytes:
        if quick is None or not is_common(text) or any(a in text for a in added):
            return pack(whole.encode(text, add_special_tokens=False).ids)
        return pack(quick.encode_ordinary(text))

    return encode
