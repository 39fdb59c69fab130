"""A unigram vocabulary taken from a public tokenizer's file."""

from __future__ import annotations

import math
from dataclasses import dataclass

import sentencepiece

#: The file's place is a parameter everywhere; this is where the box has it.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: What stands for a space, and what an unknown character costs below the least likely piece.
SPACE, UNKNOWN_PENALTY = "▁", 10.0


@dataclass(eq=False)
class Vocabulary:
    """Pieces with ids and log probabilities; ``byte_ids[b]`` is the piece of a single byte."""

    pieces: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    unknown_score: float
    names: list[str]


def load_vocabulary(path: str = PIECES) -> Vocabulary:
    """Pieces of a SentencePiece model with log probabilities by rank.

    The file ranks its pieces but gives no probabilities, so the piece of rank r gets 1 / (r + 1), normalised.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(plain))))
    scores = {names[i]: -math.log(r + 1) - total for r, i in enumerate(plain)}
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Vocabulary({names[i]: i for i in plain}, scores, byte_ids, min(scores.values()) - UNKNOWN_PENALTY, names)
