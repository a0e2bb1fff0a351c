"""Byte-pair vocabularies as left-to-right transducers.

The encoding of every prefix of a word ends in one token, and all tokens before it are
the encoding of a shorter prefix: the one after which that token *agrees* with its left
neighbour, i.e. the two, spelled out and merged again, come back as the same two. So a
scan can keep the encodings of those prefixes that an unfinished token may still start
at. That set is the state of a deterministic machine; tokens that all its encodings
share can no longer change and are emitted on the transition. States and transitions
are compiled when first needed, up to a limit; past it a word's remaining symbols are
followed without compiling, by the same rule and with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

#: Compiled states; neighbour tests kept before they are forgotten and made again.
MOST_STATES, MOST_PAIRS = 25_000, 200_000
#: Unemitted tokens after which a scan without compiled states looks for shared ones.
HELD = 64
TOKEN = 0  # the key of a trie node's token; symbols are strings
NONE = -1  # what stands left of a word's first token


class Memo(dict):
    """word -> answer: two generations, of which the older goes when the younger is full."""

    def __init__(self, answer: Callable, most: int, longest: int = 64) -> None:
        self.answer, self.most, self.longest, self.older = answer, most, longest, {}

    def __missing__(self, word: str):
        value = self.older.get(word)
        if value is None:
            value = self.answer(word)
            if len(word) > self.longest:
                return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


class State(dict):
    """Compiled transitions of one state: symbol -> (next state, emitted tokens).

    ``last`` is the last emitted token; ``live`` has, from the longest unfinished token to
    the shortest, its trie node and the tokens due before it; the last entry is at the
    trie's root, with the tokens due if the word ends here.
    """

    __slots__ = ("last", "live")

    def __init__(self, last: int, live: list) -> None:
        self.last, self.live = last, live


class Machine:
    """``spelling``: symbols of each token. ``rank``: of a pair of tokens its priority (the
    lowest merges first, then the leftmost) and the merged token, or None. ``unknown``: the
    tokens of a symbol that no token holds; such a symbol merges with nothing."""

    def __init__(
        self,
        spelling: dict[int, Sequence[str]],
        rank: Callable[[int, int], tuple[float, int] | None],
        unknown: Callable[[str], tuple[int, ...]],
    ) -> None:
        self.rank, self.unknown = rank, unknown
        self.single = {s[0]: t for t, s in spelling.items() if len(s) == 1}
        self._edges(spelling)
        # A node that nothing follows is its token alone; most are.
        self.trie: dict = {}
        for token, symbols in spelling.items():
            if self.left[token] is None:
                continue
            node = self.trie
            for s in symbols[:-1]:
                below = node.get(s)
                if type(below) is not dict:
                    below = node[s] = {} if below is None else {TOKEN: below}
                node = below
            last = symbols[-1]
            if type(node.get(last)) is dict:
                node[last][TOKEN] = token
            else:
                node[last] = token
        self._pairs: dict[int, bool] = {}
        self._states: dict[tuple, State] = {}
        self.start = self._state(NONE, [(self.trie, ())])

    def merge(self, symbols: Iterable[str]) -> list[int]:
        """The definition: merge the best pair, the leftmost of equals, until none is left."""
        tokens = [self.single[s] for s in symbols]
        while len(tokens) > 1:
            found = [
                (r[0], k, r[1])
                for k in range(len(tokens) - 1)
                if (r := self.rank(tokens[k], tokens[k + 1]))
            ]
            if not found:
                break
            _, k, merged = min(found)
            tokens[k : k + 2] = [merged]
        return tokens

    def _edges(self, spelling: dict[int, Sequence[str]]) -> None:
        """``left`` and ``right``: the part at either edge that a token is merged from (a symbol:
        itself), by token, and ``made``: the priority of that merge. A token that its own symbols
        do not merge into is never an answer, and has None. ``irregular`` are tokens with a merge
        that comes before the merges of its parts."""
        by_symbols = {tuple(s): t for t, s in spelling.items()}
        size = max(spelling, default=-1) + 1
        self.left, self.right, self.made = [None] * size, [None] * size, [None] * size
        self.symbol = {t: s for s, t in self.single.items()}
        self.irregular = set()
        left, right, made = self.left, self.right, self.made
        for symbols, token in sorted(by_symbols.items(), key=lambda x: len(x[0])):
            if len(symbols) == 1:
                made[token] = -math.inf
                left[token] = right[token] = token
                continue
            if any(s not in self.single for s in symbols):
                raise ValueError(f"no token for one of the symbols {symbols} alone")
            for k in range(1, len(symbols)):
                a, b = by_symbols.get(symbols[:k]), by_symbols.get(symbols[k:])
                if a is None or b is None or made[a] is None or made[b] is None:
                    continue
                merge = self.rank(a, b)
                if merge is None or merge[1] != token or not self._meet(a, b, merge[0]):
                    continue
                if max(made[a], made[b]) >= merge[0] or {a, b} & self.irregular:
                    self.irregular.add(token)
                left[token], right[token], made[token] = a, b, merge[0]
                break

    def spelled(self, token: int) -> list[str]:
        """The symbols of a token, from its parts."""
        out, due = [], [token]
        while due:
            token = due.pop()
            if token in self.symbol:
                out.append(self.symbol[token])
            else:
                due += (self.right[token], self.left[token])
        return out

    def _meet(self, left: int, right: int, until: float = math.inf) -> bool:
        """Whether both come to stand side by side: no merge across them, before the one of
        priority ``until``, comes before the merges that take up its parts."""
        # What stands at the edges while both are merged from their symbols, those last.
        a, b, made = [left], [right], self.made
        while (part := self.right[a[-1]]) != a[-1]:
            a.append(part)
        while (part := self.left[b[-1]]) != b[-1]:
            b.append(part)
        x, y = a.pop(), b.pop()
        taken_x, taken_y = made[a[-1]] if a else math.inf, made[b[-1]] if b else math.inf
        while True:
            merge = self.rank(x, y)
            if merge and merge[0] < min(taken_x, until) and merge[0] <= taken_y:
                return False
            if not a and not b:
                return True
            if taken_x <= taken_y:
                x = a.pop()
                taken_x = made[a[-1]] if a else math.inf
            else:
                y = b.pop()
                taken_y = made[b[-1]] if b else math.inf

    def agree(self, left: int, token: int) -> bool:
        if token in self.irregular or left in self.irregular:
            pair = [token] if left == NONE else [left, token]
            known = self.merge(s for t in pair for s in self.spelled(t)) == pair
        else:
            known = left == NONE or self._meet(left, token)
        if len(self._pairs) >= MOST_PAIRS:
            self._pairs.clear()
        self._pairs[left * len(self.left) + token] = known
        return known

    def _state(self, last: int, live: list) -> State:
        key = (last, tuple((id(node), due) for node, due in live))
        state = self._states.get(key)
        if state is None:
            state = self._states[key] = State(last, live)
        return state

    def _follow(self, last: int, live: list, symbol: str) -> list | None:
        """What is live after one more symbol; None if no token holds it."""
        below, rest, size = [], iter(live), len(self.left)
        for node, due in rest:
            node = node.get(symbol)
            if node is None:
                continue
            if type(node) is dict:
                below.append((node, due))
                token = node.get(TOKEN)
                if token is None:
                    continue
            else:
                token = node
            left = due[-1] if due else last
            known = self._pairs.get(left * size + token)
            if known or (known is None and self.agree(left, token)):
                below += [(n, d) for node, d in rest if type(n := node.get(symbol)) is dict]
                below.append((self.trie, (*due, token)))
                return below
        return None

    def _settle(self, last: int, live: list) -> tuple[int, list, tuple[int, ...]]:
        """Takes off the tokens that all live encodings share."""
        first, shared = live[0][1], 0
        for due in zip(*(due for _, due in live)):
            if due.count(due[0]) < len(due):
                break
            shared += 1
        if not shared:
            return last, live, ()
        return first[shared - 1], [(n, due[shared:]) for n, due in live], first[:shared]

    def _compile(self, state: State, symbol: str) -> tuple[State, tuple[int, ...]] | None:
        """The transition, kept in ``state``; None once there are enough states."""
        follow = self._follow(state.last, state.live, symbol)
        if follow is None:
            step = (self.start, state.live[-1][1] + self.unknown(symbol))
        else:
            if len(self._states) >= MOST_STATES:
                return None
            last, live, emitted = self._settle(state.last, follow)
            step = (self._state(last, live), emitted)
        state[symbol] = step
        return step

    def steps(self, symbols: Iterable[str]) -> Iterator[tuple[int, ...]]:
        """The tokens that each symbol makes certain, then those that the end does.

        Memory follows the lookahead, not the word's length.
        """
        state: State | None = self.start
        last, live = state.last, state.live
        for symbol in symbols:
            step = None
            if state is not None:
                step = state.get(symbol) or self._compile(state, symbol)
            if step is not None:
                state, emitted = step
                last, live = state.last, state.live
            else:
                follow = self._follow(last, live, symbol)
                if follow is None:
                    emitted = live[-1][1] + self.unknown(symbol)
                    state = self.start
                    last, live = state.last, state.live
                else:
                    state, emitted, live = None, (), follow
                    if len(live[-1][1]) > HELD:
                        last, live, emitted = self._settle(last, live)
            yield emitted
        yield live[-1][1]

    def run(self, symbols: Sequence[str]) -> list[int]:
        """The tokens of a word."""
        if len(symbols) > HELD:
            return [token for emitted in self.steps(symbols) for token in emitted]
        state, out = self.start, []
        for at, symbol in enumerate(symbols):
            step = state.get(symbol) or self._compile(state, symbol)
            if step is None:
                break
            state, emitted = step
            if emitted:
                out += emitted
        else:
            return [*out, *state.live[-1][1]]
        last, live = state.last, state.live
        for k in range(at, len(symbols)):
            follow = self._follow(last, live, symbols[k])
            if follow is None:
                return [*out, *live[-1][1], *self.unknown(symbols[k]), *self.run(symbols[k + 1 :])]
            live = follow
        return [*out, *live[-1][1]]

    def count(self, symbols: Sequence[str]) -> int:
        """How many tokens ``run`` gives: the numbers that transitions are annotated with."""
        if len(symbols) > HELD:
            return sum(map(len, self.steps(symbols)))
        return len(self.run(symbols))

    def waiting(self, symbols: Iterable[str]) -> int:
        """The most symbols that were ever read but not yet emitted as tokens."""
        held = most = 0
        for emitted in self.steps(symbols):
            held += 1 - sum(len(self.spelled(t)) if t < len(self.left) and self.left[t] is not None else 1 for t in emitted)
            most = max(most, held)
        return most


def lookahead(
    spelling: dict[int, Sequence[str]], pairs: Iterable[tuple[float, int, int]]
) -> int:
    """Symbols after a token's end that can still change it, at most.

    A new symbol can undo a merge only by a merge of higher priority that takes the
    right part first. What is set free on the left can then undo a merge of lower priority
    in turn. The longest such chain of ``pairs`` (priority, left, right), one token to the
    left at each link, bounds how far a change travels; the longest token comes on top.
    """
    longest: dict[int, int] = {}
    for _, left, right in sorted(pairs, reverse=True):  # from the last merge to the first
        reach = len(spelling[left]) + longest.get(left, 0)
        longest[right] = max(longest.get(right, 0), reach)
    return max(longest.values(), default=0) + max((len(s) for s in spelling.values()), default=0)
