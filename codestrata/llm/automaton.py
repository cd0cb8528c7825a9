"""A small deterministic automaton, run over many chunks of text at once.

Patterns are built from :func:`lit`, :func:`chars`, :func:`seq`, :func:`alt`,
:func:`many`, :func:`some` and :func:`maybe`; :class:`Automaton` joins them into
one table (Thompson construction, then subsets). It reports every position at
which one of the patterns has just ended, as a search does. Texts are laid end
to end, cut into overlapping chunks, and all chunks step through the table
together, one character per step, as NumPy lanes.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
ASCII = frozenset(map(chr, range(128))) | {"\x80"}  # \x80 stands for everything beyond ASCII


def chars(allowed: Iterable[str]):  # noqa: ANN201
    return ("c", frozenset(allowed))


def lit(text: str, case: bool = True):  # noqa: ANN201
    return ("s", [chars({c} if case else {c.lower(), c.upper()}) for c in text])


def seq(*parts):  # noqa: ANN001, ANN201
    return ("s", list(parts))


def alt(*parts):  # noqa: ANN001, ANN201
    return ("a", list(parts))


def many(part):  # noqa: ANN001, ANN201
    return ("*", part)


def maybe(part):  # noqa: ANN001, ANN201
    return ("?", part)


def some(part, least: int = 1):  # noqa: ANN001, ANN201
    return seq(*[part] * least, many(part))


class Automaton:
    def __init__(self, patterns: dict[str, tuple]):
        self.names = list(patterns)
        eps: list[list[int]] = []
        step: list[tuple[frozenset, int] | None] = []

        def new() -> int:
            eps.append([])
            step.append(None)
            return len(eps) - 1

        def build(node: tuple, a: int) -> int:
            kind, x = node
            if kind == "c":
                b = new()
                step[a] = (x, b)
                return b
            if kind == "s":
                for part in x:
                    a = build(part, glue(a))
                return a
            end = new()
            if kind == "a":
                for part in x:
                    s = new()
                    eps[a].append(s)
                    eps[build(part, s)].append(end)
                return end
            s = new()
            eps[a] += [s, end]
            e = build(x, s)
            eps[e] += [end, s] if kind == "*" else [end]
            return end

        def glue(a: int) -> int:
            s = new()
            eps[a].append(s)
            return s

        start = new()
        final = {}
        for i, p in enumerate(patterns.values()):
            final[build(p, glue(start))] = i

        def closure(states: frozenset) -> frozenset:
            todo, seen = list(states), set(states)
            while todo:
                for t in eps[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(s for s in seen if step[s] or s in final)

        symbols = sorted(ASCII)
        root = closure(frozenset([start]))
        ids, rows, accept = {root: 0}, [], []
        todo = [root]
        while todo:
            cur = todo.pop(0)
            moves: dict[str, set[int]] = {}
            for s in cur:
                if step[s]:
                    for c in step[s][0]:
                        moves.setdefault(c, set()).add(step[s][1])
            row = np.zeros(129, np.int32)
            cache: dict[frozenset, int] = {}
            for c in symbols:
                raw = frozenset(moves.get(c, ()))
                t = cache.get(raw)
                if t is None:
                    nxt = closure(raw) | root
                    if nxt not in ids:
                        ids[nxt] = len(ids)
                        todo.append(nxt)
                    t = cache[raw] = ids[nxt]
                row[ord(c)] = t
            rows.append(row)
            accept.append(sum(1 << final[s] for s in cur if s in final))
        self.table = np.stack(rows)
        self.accept = np.array(accept, np.int64)
        self.flat = np.ascontiguousarray(self.table).reshape(-1)

    def _run(self, state: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end states, hits as rows of lane, step, bit set) of lanes that step through their columns."""
        hot, flat, out = self.accept > 0, self.flat, []
        for k, column in enumerate(columns):
            state = flat[state * 129 + column]
            hit = np.flatnonzero(hot[state])
            if len(hit):
                out.append(np.stack((hit, np.full(len(hit), k), self.accept[state[hit]]), 1))
        return state, np.concatenate(out) if out else np.zeros((0, 3), np.int64)

    def scan(self, texts: list[str], chunk: int = 2048, overlap: int = 256) -> list[tuple[int, int, int]]:
        """(text, position after the match, bit set of patterns), each place once, in order.

        A chunk starts in the state that the ``overlap`` before it leads to. Where the chunk
        before ends in another state (a match in progress is longer than the overlap) it is
        scanned again from that one, so results do not depend on where chunks begin.
        """
        code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.minimum(code, 128).astype(np.int32)
        n = len(code)
        lanes = -(-n // chunk)
        padded = np.full(overlap + lanes * chunk, ord("\n"), np.int32)
        padded[overlap : overlap + n] = code
        view = np.lib.stride_tricks.sliding_window_view(padded, overlap + chunk)[::chunk]
        columns = np.ascontiguousarray(view.T)
        begin, _ = self._run(np.zeros(lanes, np.int32), columns[:overlap])
        end, hits = self._run(begin, columns[overlap:])
        while len(wrong := np.flatnonzero(begin[1:] != end[:-1]) + 1):
            begin[wrong] = end[wrong - 1]
            end[wrong], again = self._run(begin[wrong], columns[overlap:, wrong])
            again[:, 0] = wrong[again[:, 0]]
            hits = np.concatenate((hits[~np.isin(hits[:, 0], wrong)], again))
        if not len(hits):
            return []
        spots = np.stack((hits[:, 0] * chunk + hits[:, 1] + 1, hits[:, 2]), 1)
        spots = spots[np.argsort(spots[:, 0], kind="stable")]
        ends = np.cumsum([len(t) + 1 for t in texts])
        # a place right behind the line break between two texts belongs to none
        which = np.searchsorted(ends, spots[:, 0] - 1, side="right")
        first = np.concatenate(([0], ends[:-1]))
        keep = which < len(texts)
        return [(int(w), int(p - first[w]), int(b)) for w, (p, b) in zip(which[keep], spots[keep], strict=True)]
