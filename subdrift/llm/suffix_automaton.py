"""A generalised suffix automaton over sequences of words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class SuffixAutomaton:
    """``follow[s]`` maps a word to the next state, ``link[s]`` leads to the state of the
    longest suffix that occurs elsewhere too, ``length[s]`` is the longest piece of the
    state; ``note[s]`` is what ``mark`` left there for the pieces of the state."""

    def __init__(self):
        self.follow: list[dict] = [{}]
        self.link, self.length, self.note = [-1], [0], [None]

    def add(self, words: Sequence) -> Iterator[int]:
        """Takes a sequence in; gives the state of each of its beginnings."""
        state = 0
        for word in words:
            state = self._extend(state, word)
            yield state

    def _state(self, length: int, follow: dict, link: int, note) -> int:
        self.follow.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.note.append(note)
        return len(self.link) - 1

    def _extend(self, last: int, word) -> int:
        follow, link, length = self.follow, self.link, self.length
        known = follow[last].get(word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, word, known)
        new = self._state(length[last] + 1, {}, 0, None)
        while last >= 0 and word not in follow[last]:
            follow[last][word] = new
            last = link[last]
        if last >= 0:
            known = follow[last][word]
            link[new] = known if length[known] == length[last] + 1 else self._split(last, word, known)
        return new

    def _split(self, last: int, word, known: int) -> int:
        """The shorter pieces of a state get one of their own, with the same note."""
        note = self.note[known]
        copy = self._state(
            self.length[last] + 1, dict(self.follow[known]), self.link[known], dict(note) if isinstance(note, dict) else note
        )
        self.link[known] = copy
        while last >= 0 and self.follow[last].get(word) == known:
            self.follow[last][word] = copy
            last = self.link[last]
        return copy

    def statistics(self, words: Sequence, first: int, stop: int) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of the longest known piece that ends with each word."""
        follow, link, longest = self.follow, self.link, self.length
        state = length = 0
        for i in range(first, stop):
            word = words[i]
            while state and word not in follow[state]:
                state = link[state]
                length = longest[state]
            if word in follow[state]:
                state = follow[state][word]
                length += 1
            yield i, state, length
