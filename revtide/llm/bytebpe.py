"""Ids of a byte-level BPE tokenizer file for whole texts, fast where that is provably the same."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: The file's place is a parameter everywhere; this is where the box has it.
MODEL = public_tokenizers.path("byte_bpe_50k.json")
#: Spaces in a row that are not given to the tokenizer one by one.
LONG_RUN = 64

#: The fast way takes time with the square of a run of white space: it gets none of 512. Such a run shows in every 64th character.
_WIDE, _STRIDE = 512, 64
_WIDE_SPACE = re.compile(rf"\s{{{_WIDE // _STRIDE - 1}}}")
_RUN = re.compile(rf" {{{LONG_RUN},}}")


@dataclass
class Model:
    """A tokenizer's file as text, its byte strings by rank, and whether ranks alone give its ids."""

    text: str
    ranks: dict[bytes, int]
    by_rank: bool
    specials: list[str]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such files: itself if printable, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


def load_model(path: str = MODEL) -> Model:
    """Read the file on the driver (some megabytes, whatever the corpus) and see whether ranks give its ids.

    They do if merges come in the order of ids and every token, given as bytes, is merged to itself: two neighbours
    that together make a token are then always the pair that its merge names. (What stands exactly on a token's bytes
    came from merges within them, as when the token stands alone.) Otherwise all texts take the plain way.
    """
    with open(path, encoding="utf-8") as f:
        text = f.read()
    tokenizer = Tokenizer.from_str(text)
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    letters = _byte_letters()
    vocabulary = {t: i for t, i in tokenizer.get_vocab().items() if t not in specials}
    try:
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
    except KeyError:
        return Model(text, {}, False, specials)
    merges = [m.split(" ") if isinstance(m, str) else m for m in json.loads(text)["model"].get("merges", [])]
    made = [vocabulary.get("".join(m), -1) for m in merges]
    ordered = all(a < b for a, b in zip(made, made[1:], strict=False)) and len(made) + 256 == len(vocabulary) and sorted(ranks.values()) == list(range(len(ranks)))
    pattern = json.loads(text).get("pre_tokenizer") or {}
    usual = pattern.get("type") == "ByteLevel" and not pattern.get("add_prefix_space") and pattern.get("use_regex", True) and not json.loads(text).get("normalizer")
    own = ordered and usual and all([x.id for x in tokenizer.model.tokenize(t)] == [i] for t, i in vocabulary.items())
    return Model(text, ranks, own, specials)


def _latin(text: str) -> bool:
    """Whether all code points are below U+0100: all versions of Unicode agree on their classes; a test goes through them."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """The tokenizer's own ids of whole texts, without special tokens added (those that a text spells out count)."""

    def __init__(self, model: Model):
        self.tokenizer = Tokenizer.from_str(model.text)
        self.specials = model.specials
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={}) if model.by_rank else None
        space = self._plain(" ")
        # Where two spaces never merge, a long run of them is as many single ids.
        self.space = int(space[0]) if len(space) == 1 and len(self._plain(" " * 200)) == 200 else None

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and _latin(text) and not any(s in text for s in self.specials) and not (len(text) > _WIDE and _WIDE_SPACE.search(text[::_STRIDE])):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        if self.space is None or not _RUN.search(text):
            return self._plain(text)
        # Between two spaces of a run no merge happens; its first stays with what is before, its last with what follows.
        out, at = [], 0
        for run in _RUN.finditer(text):
            out += [self._plain(text[at : run.start() + 1]), np.full(run.end() - run.start() - 2, self.space, np.uint32)]
            at = run.end() - 1
        return np.concatenate([*out, self._plain(text[at:])])
