"""Token ids of texts by a public byte-level BPE vocabulary.

`byte_bpe_50k` exists in two forms: a `tokenizers` file and the same vocabulary as ranks. The ids
are the same (tests compare them); the ranks are used because they take a quarter of the time.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

END_OF_TEXT = 50256
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _encoding(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
        special_tokens={SPECIAL: END_OF_TEXT},
    )


def token_ids(text: str, path: str | None = None, special: bool = True) -> np.ndarray:
    """Ids (uint32) of one whole text.

    `path`: the ranks file, by default the public one of the machine the task runs on.
    `special`: the special token's string in a text is that token (as `tokenizers` has it by
    default); otherwise it is ordinary text.
    """
    encoding = _encoding(path)
    if SPECIAL not in text or not special:
        return np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), np.uint32)
    return np.asarray(encoding.encode_to_numpy(text, allowed_special="all"), np.uint32)


def as_16_bits(ids: np.ndarray) -> np.ndarray:
    """Little-endian 16-bit ids; an id above 65535 is an error, as it would become another."""
    if len(ids) and ids.max() > 0xFFFF:
        raise ValueError(f"id {ids.max()} does not fit into 16 bits")
    return ids.astype("<u2")


@lru_cache(maxsize=2)
def token_bytes(path: str | None = None) -> tuple[bytes, ...]:
    """The bytes of every id of the vocabulary, without the special token."""
    encoding = _encoding(path)
    return tuple(encoding.decode_single_token_bytes(i) for i in range(END_OF_TEXT))
