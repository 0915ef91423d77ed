"""Public tokenizers for tasks: loaded once a worker, and cut points that no token crosses."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers

BYTE_BPE, BYTE_BPE_RANKS, PIECE_BPE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"

#: Before a space that follows anything but white space, neither vocabulary can merge: see ``cuts_are_safe``.
CUT = re.compile(r"(?<=\S)(?= )")
#: Code points whose classes no Unicode version has changed since both libraries' oldest tables; others go to the slower library.
UNSETTLED = re.compile("[^\\x00-\\u036f\\u2000-\\u2064]")
CHUNK = 1 << 18


@lru_cache(maxsize=4)
def byte_bpe(path: str, special_as_text: bool = False):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = special_as_text
    return made


@lru_cache(maxsize=4)
def byte_ranks(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


@lru_cache(maxsize=4)
def piece_bpe(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def byte_bpe_bytes(path: str) -> list[bytes]:
    """Bytes of each entry by id. Entries are written byte by byte: printable Latin-1 as itself, the others from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    entries = byte_bpe(path, True).get_vocab(with_added_tokens=False)
    made = [b""] * (max(entries.values()) + 1)
    for entry, number in entries.items():
        made[number] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
    return made


@lru_cache(maxsize=4)
def piece_bpe_bytes(path: str) -> list[bytes]:
    model = piece_bpe(path)
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]


def cuts_are_safe(byte_path: str, piece_path: str) -> bool:
    """No entry of either vocabulary has a space right after anything but white space, so no merge joins the two sides of a CUT.

    The byte-level pattern also ends a match there: its classes for words, numbers and signs hold no white space, and a match that begins
    with white space ends with what follows it.
    """
    solid = re.compile("\\S ")
    return not any(solid.search(x.decode("utf-8", "replace")) for of in (byte_bpe_bytes(byte_path), piece_bpe_bytes(piece_path)) for x in of)


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Parts of a text of about ``size`` characters, cut where no token can cross."""
    at = 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def byte_ids(text: str, byte_path: str, ranks_path: str, special_as_text: bool = False) -> np.ndarray:
    """Token ids of a text by the byte-level vocabulary, as its own library gives them; long texts chunk by chunk.

    Where the classes of all characters are settled, the library that reads the same vocabulary as ranks gives the same ids in a fifth of the time.
    """
    parts = []
    for chunk in chunks(text):
        if UNSETTLED.search(chunk):
            ids = byte_bpe(byte_path, special_as_text).encode(chunk, add_special_tokens=False).ids
        elif special_as_text:
            ids = byte_ranks(ranks_path).encode_ordinary(chunk)
        else:
            ids = byte_ranks(ranks_path).encode(chunk, allowed_special="all")
        parts.append(np.array(ids, dtype=np.uint32))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)
