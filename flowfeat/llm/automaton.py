"""A suffix automaton of several word sequences that knows the smallest owner of every substring."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from flowfeat.llm.common import by_value

by_value(__name__)


class SuffixAutomaton:
    """Built from (owner, words) sequences; built once, then only read."""

    def __init__(self, sequences: Iterable[tuple[int, list]]):
        self.step: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]
        self.owner: list[int | None] = [None]
        for owner, words in sequences:
            last = 0
            for word in words:
                last = self._extend(last, word, owner)
        # an owner of a string owns its suffixes
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.link[state]
            if up > 0 and (self.owner[up] is None or self.owner[state] < self.owner[up]):
                self.owner[up] = self.owner[state]

    def _state(self, size: int, step: dict, link: int, owner: int | None) -> int:
        self.size.append(size)
        self.step.append(step)
        self.link.append(link)
        self.owner.append(owner)
        return len(self.size) - 1

    def _extend(self, last: int, word, owner: int) -> int:
        size, step, link = self.size, self.step, self.link
        known = step[last].get(word)
        if known is not None and size[known] == size[last] + 1:
            if self.owner[known] is None or owner < self.owner[known]:
                self.owner[known] = owner
            return known
        if known is not None:
            return self._split(last, word, known, owner)
        new = self._state(size[last] + 1, {}, 0, owner)
        at = last
        while at != -1 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at != -1:
            target = step[at][word]
            link[new] = target if size[target] == size[at] + 1 else self._split(at, word, target, None)
        return new

    def _split(self, at: int, word, target: int, owner: int | None) -> int:
        """A copy of `target` for the shorter strings that reach it through `at`."""
        size, step, link = self.size, self.step, self.link
        copy = self._state(size[at] + 1, dict(step[target]), link[target], owner)
        while at != -1 and step[at].get(word) == target:
            step[at][word] = copy
            at = link[at]
        link[target] = copy
        return copy

    def matches(self, words: list, span: int) -> Iterator[tuple[int, int]]:
        """Stream words; for every place where the last `span` words occur in a sequence: (place, smallest owner)."""
        step, link, size = self.step, self.link, self.size
        state = length = 0
        for place, word in enumerate(words):
            while state and word not in step[state]:
                state = link[state]
                length = size[state]
            if word in step[state]:
                state = step[state][word]
                length += 1
            if length >= span:
                while size[link[state]] >= span:
                    state = link[state]
                length = span
                yield place, self.owner[state]
