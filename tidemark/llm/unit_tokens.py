"""Fast exact token ids and counts in Python workers.

Ids: a byte-level vocabulary's merge ranks drive the faster encoder of the same algorithm; texts
with special strings go to the vocabulary's own library. Counts: a unit is a run between two
U+0020, and the counting vocabulary drops white space, so a text's tokens are its units' tokens in
order; units of Latin letters, digits and plain punctuation are split into pre-tokens, which are looked
up or encoded by the vocabulary's model, all others are encoded by the whole library.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

from tidemark.llm.common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of a cache generation and the longest string kept in it: at most about 100 MB a worker.
GENERATION = 240_000
LONGEST = 64

#: Units whose normal form is their lower case: no combining marks, apostrophes or special strings.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9.,;:!?()\[\]\"/%&#$*+=@_-]*")
_PRE_TOKENS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def pre_tokens(unit: str) -> list[str]:
    """The pre-tokens of a unit; none of one that only the whole library can split."""
    return _PRE_TOKENS.findall(unit.lower()) if _PLAIN.fullmatch(unit) else []


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies' letter for each byte: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_TO_LETTERS = str.maketrans({chr(b): c for b, c in byte_letters().items()})


def load_tokenizer(path: str):
    """The library's tokenizer, without truncation or padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Generations(dict):
    """A cache in two generations: what was used since the last turn survives the next."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make
        self.old: dict = {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONGEST:
                return value
        if len(self) >= GENERATION:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class TextIds:
    """ids of whole texts, as little-endian unsigned 32-bit bytes, for a byte-level vocabulary."""

    #: The byte-level pre-tokeniser's pattern; a fixed value of this family of vocabularies.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        self.special = [t["content"] for t in whole["added_tokens"]]
        vocabulary = whole["model"]["vocab"]
        to_byte = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in vocabulary.items() if t not in self.special}
        self.encoder = tiktoken.Encoding(path, pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def tokenizer(self):
        """Only texts with special strings need it."""
        return load_tokenizer(self.path)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.encoder.encode_ordinary(text)).tobytes()


class UnitCounts:
    """Token counts of whole texts for a vocabulary that lower-cases and drops white space.

    lengths is the broadcast first tier, of pre-tokens; misses go to the worker's caches, then the
    vocabulary. Counts of whole units are cached too.
    """

    def __init__(self, path: str, lengths: dict[str, int]) -> None:
        self.tokenizer = load_tokenizer(path)
        self.model = self.tokenizer.model
        self.lengths = lengths
        self.missed = Generations(self._encode)
        self.units = Generations(self._count)

    def _encode(self, token: str) -> int:
        return len(self.model.tokenize(token.encode().decode("latin-1").translate(_TO_LETTERS)))

    def _count(self, unit: str) -> int:
        found = pre_tokens(unit)
        if not found and unit:
            return len(self.tokenizer.encode(unit, add_special_tokens=False))
        get, missed = self.lengths.get, self.missed
        return sum(get(t) or missed[t] for t in found)

    def __call__(self, text: str) -> int:
        return sum(map(self.units.__getitem__, text.split(" ")))


def worker_ids(path: str) -> TextIds:
    """The worker process's own TextIds; kept from task to task."""
    return held(("ids", path), lambda: TextIds(path))
