"""Ids of texts by a public sentencepiece vocabulary, and the bytes its pieces stand for."""

from __future__ import annotations

import re
from functools import lru_cache

import sentencepiece

SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
# A space that follows neither white space nor what the model reads as a space, before the end.
_START = re.compile(rf" (?<=[^\s{SPACE}] )(?=.)", re.DOTALL)


@lru_cache(maxsize=2)
def _processor(path: str | None) -> sentencepiece.SentencePieceProcessor:
    import public_tokenizers

    return sentencepiece.SentencePieceProcessor(
        model_file=path or public_tokenizers.path("piece_bpe_32k.model"))


@lru_cache(maxsize=2)
def _separable(path: str | None) -> bool:
    """Does no piece hold a space behind something else? Then no merge crosses a word's start."""
    encoder = _processor(path)
    return not any(
        re.search(f"[^{SPACE}]{SPACE}", encoder.id_to_piece(i))
        for i in range(encoder.get_piece_size()))


@lru_cache(maxsize=2)
def piece_bytes(path: str | None = None) -> tuple[bytes, ...]:
    """The bytes of every piece: U+2581 is a space, <0xHH> a byte, the rest UTF-8."""
    encoder = _processor(path)

    def of(i: int) -> bytes:
        piece = encoder.id_to_piece(i)
        byte = _BYTE.fullmatch(piece)
        if encoder.is_byte(i) and byte:
            return bytes.fromhex(byte.group(1))
        return piece.replace(SPACE, " ").encode()

    return tuple(of(i) for i in range(encoder.get_piece_size()))


def word_starts(text: str, path: str | None = None) -> list[str]:
    """The text cut where a space follows something else, without that space.

    The encoder puts it back in front of each part, and the parts' ids one after the other are the
    text's. Byte-level BPE with a pattern that takes at most one space in front of a word has
    its cuts there too. With a vocabulary that has pieces across word starts, nothing is cut.
    """
    return _START.split(text) if _separable(path) else [text]


def piece_ids(text: str, path: str | None = None) -> list[int]:
    """Ids of one whole text; special tokens' strings are plain text."""
    return _processor(path).encode(text)
