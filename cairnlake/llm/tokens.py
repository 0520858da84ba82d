"""Token ids of whole texts by a public tokenizer file, with a memory of words.

For a tokenizer whose pre-tokenizer never joins across ASCII white space and drops it, a text's ids are those of
its blank-delimited words one after another, and a word's those of its pre-tokens. The library encodes pre-tokens that a worker
has not seen, many at a time; as each ends with an end-of-word token, their ids are told apart. What a worker
keeps is bounded, and forgetting changes no result.
"""

from __future__ import annotations

import functools
import itertools
import json

import numpy as np
import pyarrow as pa

from .common import kept
from .transducer import LATIN, character_class, latin_pattern

#: Words and pre-tokens whose ids a worker keeps at once, and pre-tokens that are encoded at once.
MOST_WORDS, MOST_PARTS, AT_ONCE = 400_000, 250_000, 2000
#: The same as a multiple, for a job that has its workers to itself.
ALONE = 3
LAST = chr(LATIN)
#: Pre-tokens that are known as such: white space parts them and nothing in them changes.
_PLAIN = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_OPEN: dict[tuple[str, int], "WordIds"] = kept("words")


def forget_half(memory: dict) -> None:
    """Drops the older half of a dict."""
    for key in list(itertools.islice(memory, len(memory) // 2)):
        del memory[key]


class WordIds:
    """Ids as little-endian unsigned 32-bit integers; words and pre-tokens are bytes."""

    def __init__(self, path: str, memory: int = 1):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": _PLAIN, "added_tokens": []}))
        for t in (self.tokenizer, self.plain):
            t.no_truncation()
            t.no_padding()
        self.special = [t["content"].encode("utf-8") for t in spec["added_tokens"]]
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = np.array([t.endswith(suffix) for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])])
        self.latin = latin_pattern(functools.partial(character_class, self.tokenizer))
        self.most_words, self.most_parts = memory * MOST_WORDS, memory * MOST_PARTS
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def _encode(self, tokenizer, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, new: list[bytes]) -> None:
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            ids = self._encode(self.plain, [b" ".join(some).decode("utf-8")])[0]
            ends = (4 * (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1)).tolist()
            assert len(ends) == len(some)
            self.parts.update(zip(some, map(ids.__getitem__, map(slice, [0, *ends], ends))))

    def _cut(self, word: bytes, special: bool) -> list[bytes] | None:
        """The pre-tokens of a word; none where only the library can tell."""
        if word.isalpha() and word.isascii():
            return [word.lower()]
        if special and any(s in word for s in self.special):
            return None
        text = word.decode("utf-8")
        return [p.encode("utf-8") for p in self.latin.findall(text.lower())] if word.isascii() or max(text) < LAST else None

    def learn(self, words: set[bytes], special: bool) -> None:
        """Takes in words; special: some may hold an added token's string."""
        cut = {word: self._cut(word, special) for word in words}
        odd = [word for word, own in cut.items() if own is None]
        self.words.update(zip(odd, self._encode(self.tokenizer, [w.decode("utf-8") for w in odd]) if odd else ()))
        needed = set().union(*(own for own in cut.values() if own))
        parts = self.parts
        if len(parts) + len(needed) > self.most_parts:
            forget_half(parts)
        self._learn_parts([p for p in needed if p not in parts])
        self.words.update((word, parts[own[0]] if len(own) == 1 else b"".join([parts[p] for p in own])) for word, own in cut.items() if own is not None)

    def of_texts(self, texts: pa.Array) -> list[bytes]:
        """The ids of whole texts; few texts at a time keep the list of words short."""
        texts = texts.cast(pa.binary()).to_pylist()
        flat, ends = [], []
        for t in texts:
            flat += t.split()
            ends.append(len(flat))
        if len(self.words) > self.most_words:
            forget_half(self.words)
        ids = list(map(self.words.get, flat))
        if new := [i for i, x in enumerate(ids) if x is None]:
            self.learn({flat[i] for i in new}, any(s in t for t in texts for s in self.special))
            for i in new:
                ids[i] = self.words[flat[i]]
        return [b"".join(ids[a:b]) for a, b in zip([0, *ends], ends)]


def word_ids(path: str, memory: int = 1) -> WordIds:
    if (path, memory) not in _OPEN:
        _OPEN[path, memory] = WordIds(path, memory)
    return _OPEN[path, memory]
