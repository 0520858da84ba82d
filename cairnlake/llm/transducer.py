"""A finite-state token counter, compiled from a tokenizer file.

The file's BPE merges become a deterministic transducer over bytes with token counts on its transitions.
A text's encoding under such merges is characterised by neighbours: a sequence of tokens is the encoding of
its bytes exactly if no merge crosses the border of any two neighbours at the time at which both stand. So
the last token of every prefix is determined by the last tokens of earlier prefixes, and these reach back only
as far as a token of the vocabulary does. A state is what later bytes can ask of the past: the bytes that
may still begin a token, the last token at each of these places, and the counts relative to the present
one. States are finite in number; they are made when first reached, and then a transition is one look-up.

The last byte of a pre-token is another letter than the same byte inside (the end-of-word suffix), so the
transducer runs one byte behind and has a transition for the end.
"""

from __future__ import annotations

import itertools
import json
import re

MOST_STATES, MOST_WORDS = 300_000, 1_000_000
LATIN = 0x130
_OPEN: dict[str, "TokenCounter"] = {}


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Tokens as strings of letters: 0-255 a byte inside a pre-token, 256-511 the same byte at its end."""

    def __init__(self, model: dict):
        suffix, byte = model["end_of_word_suffix"], _byte_letters()

        def letters(token: str) -> tuple[int, ...]:
            ends = token.endswith(suffix)
            out = [byte[c] for c in (token[: -len(suffix)] if ends else token)]
            return (*out[:-1], out[-1] + 256) if ends else tuple(out)

        self.tokens: dict[tuple, int] = {(b,): b for b in range(512)}
        self.born, self.parts, self.rank = [-1] * 512, [None] * 512, {}
        for i, pair in enumerate(model["merges"]):
            a, b = map(letters, pair if isinstance(pair, list) else pair.split(" "))
            self.rank[self.tokens[a] << 20 | self.tokens[b]] = i
            if a + b not in self.tokens:
                self.parts.append((self.tokens[a], self.tokens[b]))
                self.born.append(i)
                self.tokens[a + b] = len(self.tokens)
        self.heads = {t[:n] for t in self.tokens for n in range(1, len(t))}
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._fits: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """The tokens that stand at one edge of a token in the course of its making: (token, from, until)."""
        out, until = [], float("inf")
        while True:
            out.append((token, self.born[token], until))
            if self.parts[token] is None:
                return out
            until, token = self.born[token], self.parts[token][side]

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b can be neighbours in an encoding."""
        if (known := self._fits.get(a << 20 | b)) is not None:
            return known
        if len(self._fits) > 1_000_000:
            self._fits.clear()
        left = self._right.get(a) or self._right.setdefault(a, self._edge(a, 1))
        right = self._left.get(b) or self._left.setdefault(b, self._edge(b, 0))
        answer, rank = True, self.rank
        for x, x_from, x_until in left:
            x <<= 20
            for y, y_from, y_until in right:
                # Of merges of one rank the leftmost is first: one inside a comes before, one inside b after.
                if (r := rank.get(x | y)) is not None and x_from < r < x_until and y_from < r <= y_until:
                    answer = False
        self._fits[a << 20 | b] = answer
        return answer


class Transducer:
    """Lazily made states and transitions; count() runs a pre-token through them."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self._reset()

    def _reset(self) -> None:
        start = ((), (None,), (0,))
        self.states, self.numbers, self.steps = [start], {start: 0}, {}

    def step(self, state: int, letter: int) -> tuple[int, int]:
        """The transition's target and the change of the count that it carries."""
        key = state << 9 | letter
        if key not in self.steps:
            self.steps[key] = self._make(state, letter)
        return self.steps[key]

    def _make(self, state: int, letter: int) -> tuple[int, int]:
        m = self.merges
        tail, last, counts = self.states[state]
        string = (*tail, letter)
        for i, before in enumerate(last):
            if (token := m.tokens.get(string[i:])) is not None and (before is None or m.fits(before, token)):
                change = counts[i] + 1
                break
        else:
            raise ValueError("the merges don't determine an encoding")
        last, counts = (*last, token), tuple(c - change for c in (*counts, change))
        n = len(string)
        while n and string[-n:] not in m.heads:
            n -= 1
        made = (string[len(string) - n :], last[len(last) - n - 1 :], counts[len(counts) - n - 1 :])
        if made not in self.numbers:
            self.numbers[made] = len(self.states)
            self.states.append(made)
        return self.numbers[made], change

    def count(self, word: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self._reset()
        state, total, steps = 0, 0, self.steps
        for letter in word[:-1]:
            state, change = steps.get(state << 9 | letter) or self.step(state, letter)
            total += change
        return total + self.step(state, word[-1] + 256)[1]


def character_class(library, c: str) -> str:
    """l letter, n number, s space, o other, as the library's own pattern has them."""
    cut = lambda s: len(library.pre_tokenizer.pre_tokenize_str(s))
    return "s" if cut(c) == 0 else "l" if cut(f"a{c}") == 1 else "n" if cut(c + c) == 2 else "o"


def latin_pattern(kind) -> re.Pattern:
    """The pre-tokens of lower-cased text below U+0130, where the normalizer only lower-cases, character by character."""
    kinds = {k: "".join(re.escape(chr(i)) for i in range(LATIN) if kind(chr(i)) == k) for k in "lns"}
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['l']}]+|[{kinds['n']}]|[^{kinds['s']}{kinds['l']}{kinds['n']}]+")


class TokenCounter(dict):
    """Blank-delimited word (bytes) -> number of its tokens; forgets when it holds too many."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)  # its normalizer, and its classes of letters, digits and others
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that are normalised or strip their surroundings are not supported")
        self.transducer = Transducer(Merges(spec["model"]))
        self.classes: dict[str, str] = {}
        self.latin = latin_pattern(self._class)

    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_WORDS:
            for old in list(itertools.islice(self, MOST_WORDS // 2)):
                del self[old]
        self[word] = total = self.count(word)
        return total

    def count(self, word: bytes) -> int:
        """The tokens of a word, or of a part of one that begins and ends at borders of pre-tokens."""
        text, total = word.decode("utf-8"), 0
        while text:
            at, token = min(((i, t) for t in self.special if (i := text.find(t)) >= 0), default=(len(text), ""))
            total += self._plain(text[:at]) + bool(token)
            text = text[at + len(token) :]
        return total

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if max(text) < chr(LATIN):
            found = self.latin.findall(text.lower())
        else:
            found = self._pre_tokens(self.library.normalizer.normalize_str(text))
        return sum([self.transducer.count(p.encode("utf-8")) for p in found])

    def _class(self, c: str) -> str:
        if c not in self.classes:
            if len(self.classes) > 200_000:
                self.classes.clear()
            self.classes[c] = character_class(self.library, c)
        return self.classes[c]

    def _pre_tokens(self, text: str):
        """The automaton of 's|'t|'re|'ve|'m|'ll|'d | letters | one number | others."""
        i, n = 0, len(text)
        while i < n:
            kind = self._class(text[i])
            j = i + 1
            if text[i] == "'" and (two := text[i + 1 : i + 3]):
                j += 1 if two[0] in "st" else 2 if two in ("re", "ve", "ll") else 1 if two[0] in "md" else 0
            if j == i + 1 and kind in "lo":
                while j < n and self._class(text[j]) == kind:
                    j += 1
            if kind != "s":
                yield text[i:j]
            i = j


def token_counter(path: str) -> TokenCounter:
    if path not in _OPEN:
        _OPEN[path] = TokenCounter(path)
    return _OPEN[path]


