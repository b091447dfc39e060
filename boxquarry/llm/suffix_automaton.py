"""Generalised suffix automaton over word numbers, and matching statistics of long token streams.

The automaton is built on the driver from a bounded set of short texts (its size is at most twice their
words) and sent to the tasks; documents stream through it and are never gathered.
"""

from __future__ import annotations

import re

import numpy as np

from boxquarry.llm.text_hashing import hash_of_words

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters and digits and all characters beyond ASCII, with A-Z lower-cased."""
    return _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())


class SuffixAutomaton:
    """All word runs of ``texts``; ``members[state]`` are the texts in which the state's runs occur."""

    def __init__(self, texts: list[list[bytes]]):
        vocabulary = sorted({w for t in texts for w in t})
        hashes = hash_of_words(vocabulary)
        order = np.argsort(hashes, kind="stable")
        self.vocabulary = hashes[order]
        number = {vocabulary[k]: n for n, k in enumerate(order.tolist())}
        streams = [[number[w] for w in t] for t in texts]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        for stream in streams:
            last = 0
            for k, token in enumerate(stream):
                last = self._extend(last, token, k)
        self.members: list[tuple[int, ...]] = self._members(streams)
        pairs = {a * len(vocabulary) + b for t in streams for a, b in zip(t, t[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.streams = streams

    def _state(self, length: int, link: int, edges: dict[int, int], end: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def _split(self, above: int, token: int) -> int:
        """The state that the run of ``above`` plus ``token`` alone reaches, cut from a longer one if need be."""
        target = self.next[above][token]
        if self.length[target] == self.length[above] + 1:
            return target
        twin = self._state(self.length[above] + 1, self.link[target], dict(self.next[target]), self.end[target])
        self.link[target] = twin
        while above >= 0 and self.next[above].get(token) == target:
            self.next[above][token] = twin
            above = self.link[above]
        return twin

    def _extend(self, last: int, token: int, place: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        fresh = self._state(self.length[last] + 1, 0, {}, place)
        while last >= 0 and token not in self.next[last]:
            self.next[last][token] = fresh
            last = self.link[last]
        if last >= 0:
            self.link[fresh] = self._split(last, token)
        return fresh

    def _members(self, streams: list[list[int]]) -> list[tuple[int, ...]]:
        found: list[list[int]] = [[] for _ in self.next]
        for n, stream in enumerate(streams):
            state = 0
            for token in stream:
                state = self.next[state][token]
                up = state
                while up > 0 and (not found[up] or found[up][-1] != n):
                    found[up].append(n)
                    up = self.link[up]
        return [tuple(x) for x in found]

    def marks(self, wanted: dict[int, int]) -> list[tuple[tuple[int, int], ...]]:
        """For each state, (text, words) of each whole text of ``wanted`` (text: words) that is a suffix of its runs."""
        own: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for n, words in wanted.items():
            state = 0
            for token in self.streams[n]:
                state = self.next[state][token]
            own[state].append((n, words))
        out: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            out[state] = tuple(own[state]) + out[self.link[state]]
        return out

    def windows(self, width: int) -> list[int]:
        """For each state with runs of ``width`` words or more, the state of their last ``width`` words; else 0."""
        out = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[state] >= width:
                out[state] = out[self.link[state]] or state
        return out

    def runs(self, words: np.ndarray, least: int, bounds: np.ndarray) -> list[tuple[int, list[int]]]:
        """(start, word numbers) of the maximal stretches, in texts of these bounds, whose words and neighbouring
        pairs all occur in the automaton's texts; those of under ``least`` words hold no match of that length."""
        if not len(self.vocabulary) or not len(words):
            return []
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == words
        joined = known[1:] & known[:-1]
        cut = bounds[(bounds > 0) & (bounds < len(words))] - 1
        joined[cut] = False
        near = np.flatnonzero(joined)
        if len(near):
            code = at[near] * len(self.vocabulary) + at[near + 1]
            joined[near] = np.isin(code, self.pairs) if len(self.pairs) else False
        begins = np.flatnonzero(known & np.r_[True, ~joined])
        ends = np.flatnonzero(known & np.r_[~joined, True]) + 1
        long = ends - begins >= least
        return [(b, at[b:e].tolist()) for b, e in zip(begins[long].tolist(), ends[long].tolist(), strict=True)]

    def statistics(self, tokens: list[int]) -> tuple[list[int], list[int]]:
        """For each token, the state and the length of the longest run ending there that a text has."""
        states, lengths = [0] * len(tokens), [0] * len(tokens)
        edges, link, size = self.next, self.link, self.length
        state = length = 0
        for k, token in enumerate(tokens):
            onward = edges[state].get(token)
            while onward is None and state:
                state = link[state]
                length = size[state]
                onward = edges[state].get(token)
            if onward is None:
                length = 0
            else:
                state = onward
                length += 1
            states[k], lengths[k] = state, length
        return states, lengths
