"""Byte-pair encoding as a deterministic automaton over token arcs.

The automaton starts as one state with a loop for each single-byte token.  The
merges are then compiled in rank order, one gadget each: the gadget of
``(left, right) -> both``

* makes a new state, a copy of the state that ``left`` arcs enter, without the
  ``right`` arc, and redirects all ``left`` arcs into it;
* gives every state that has a ``left`` arc a ``both`` arc, which enters the
  state that ``right`` arcs enter.

A path spells a tokenization that byte-pair encoding produces, and no other
path spells the same bytes.  All arcs with one label enter one state, so the
whole automaton is kept as three short tables: the state that each label
enters, and each state's parent and removed arc.  Whether a state has an arc is
looked up along those tables and memoised, so no dense state x token table is
ever built.
"""

from __future__ import annotations

import json
from array import array

#: Pre-split pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries kept in a worker's memo of encoded chunks, and of arcs.
MEMO_ENTRIES = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(data: str) -> dict:
    """Labels, ranked merges and added tokens of a byte-level tokenizer file."""
    spec = json.loads(data)
    alphabet, vocabulary = byte_alphabet(), spec["model"]["vocab"]
    labels = {i: bytes(alphabet[c] for c in token) for token, i in vocabulary.items()}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return {
        "labels": labels,
        "merges": [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs],
        "added": {t["content"]: t["id"] for t in spec.get("added_tokens", [])},
    }


class Automaton:
    """Compiled merges; ``encode`` maps a pre-split word's bytes to ids."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        size = max(labels, default=-1) + 1
        self.labels = labels
        self.enters = array("q", [0]) * size  # the state that arcs with this label enter
        self.born = array("q", [-1]) * size  # the label exists from this gadget on; -1: never
        self.left = array("q", [-1]) * size
        self.parent, self.removed, self.made = [0], [-1], [0]
        self._arcs: dict[int, bool] = {}
        self._size = size
        for token, label in labels.items():
            if len(label) == 1:
                self.born[token] = 0
        for time, (left, right, both) in enumerate(merges, 1):
            self._gadget(time, left, right, both)
        self._arcs.clear()
        # A trie finds the longest label at a place; ``shorter`` leads to the next shorter one there.
        self.trie: dict[int, int] = {}
        ends = [-1]
        for token, label in labels.items():
            if self.born[token] < 0:
                continue
            node = 0
            for byte in label:
                step = node << 8 | byte
                node = self.trie.get(step, 0)
                if not node:
                    node = self.trie[step] = len(ends)
                    ends.append(-1)
            ends[node] = token
        self.ends = ends
        self.lengths = [len(labels.get(i, b"")) for i in range(size)]
        self.longest = max(self.lengths, default=0)
        self.shorter = [-1] * size
        for token, label in labels.items():
            node = 0
            for byte in label[:-1]:
                node = self.trie.get(node << 8 | byte, 0)
                if not node:
                    break
                if ends[node] >= 0:
                    self.shorter[token] = ends[node]

    def _gadget(self, time: int, left: int, right: int, both: int) -> None:
        if self.born[left] < 0 or self.born[right] < 0 or self.born[both] >= 0:
            return
        entered = self.enters[left]
        if not self.has_arc(entered, right):
            return  # no path reaches this merge
        self.enters[both] = self.enters[right]
        self.born[both], self.left[both] = time, left
        self.parent.append(entered)
        self.removed.append(right)
        self.made.append(time)
        self.enters[left] = len(self.parent) - 1

    def has_arc(self, state: int, token: int) -> bool:
        key = state * self._size + token
        found = self._arcs.get(key)
        if found is not None:
            return found
        parent, removed, made, born, left = self.parent, self.removed, self.made, self.born, self.left
        at, want = state, token
        found = True
        while at or born[want]:
            if made[at] > born[want]:
                if removed[at] == want:
                    found = False
                    break
                at = parent[at]
            else:
                want = left[want]
        if len(self._arcs) >= MEMO_ENTRIES:
            self._arcs.clear()
        self._arcs[key] = found
        return found

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-split word: the only path that spells it from the start state.

        Follows the longest arc first and turns back where no arc goes on;
        a place found dead is not entered again with the same label, so time is
        linear in the word's length.
        """
        n = len(word)
        enters, arcs, size, trie, ends = self.enters, self._arcs, self._size, self.trie, self.ends
        lengths, shorter, has_arc, longest = self.lengths, self.shorter, self.has_arc, self.longest
        path: list[int] = []
        dead: set[int] = set()
        at, state, token = 0, 0, -2
        while at < n:
            if token == -2:  # a place newly reached
                token, node = -1, 0
                for byte in word[at : at + longest]:
                    node = trie.get(node << 8 | byte, 0)
                    if not node:
                        break
                    if ends[node] >= 0:
                        token = ends[node]
            while token >= 0:
                key = state * size + token
                found = arcs.get(key)
                if found is None:
                    found = has_arc(state, token)
                if found and (not dead or (at + lengths[token]) * size + token not in dead):
                    break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at += lengths[token]
                state, token = enters[token], -2
            elif path:
                token = path.pop()
                dead.add(at * size + token)
                at -= lengths[token]
                state = enters[path[-1]] if path else 0
                token = shorter[token]
            else:
                raise ValueError(f"no path spells {word!r}")
        return path
