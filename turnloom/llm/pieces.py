"""Reads a SentencePiece model file of the BPE type; needs no library."""

from __future__ import annotations

from typing import NamedTuple

# Piece types of the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"


class Pieces(NamedTuple):
    ids: dict[str, int]
    scores: dict[int, float]
    bytes: dict[int, int]


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of each field of a message; length-delimited ones as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_pieces(data: bytes) -> Pieces:
    """Pieces that merges can give, their scores, and the ids of the byte pieces.

    Only what ``count`` relies on is accepted: BPE, the identity normaliser, a space put
    before the text, white space kept, byte fallback, no pieces of the user's own.
    """
    import struct

    ids, scores, by_byte, number = {}, {}, {}, 0
    trainer = normalizer = {}
    for field, value in _fields(data):
        if field == 1:
            piece = dict(_fields(value))
            text, kind = piece[1].decode(), piece.get(3, NORMAL)
            if kind == NORMAL:
                ids[text] = number
                scores[number] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            elif kind == BYTE:
                by_byte[int(text[3:5], 16)] = number
            elif kind in (USER, UNUSED):
                raise ValueError("pieces of the user's own are not supported")
            number += 1
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normalizer = dict(_fields(value))
    plain = normalizer.get(1) == b"identity" and normalizer.get(3, 1) and not normalizer.get(4, 1)
    if trainer.get(3) != 2 or not plain or len(by_byte) != 256:
        raise ValueError("not a BPE model with identity normaliser and byte fallback")
    if any(SPACE in text.lstrip(SPACE) for text in ids):
        raise ValueError("pieces that cross a space are not supported")
    return Pieces(ids, scores, by_byte)
