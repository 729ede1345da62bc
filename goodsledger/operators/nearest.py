"""Best catalog text of each name among a block of texts; runs inside a task.

The texts of a block form a tree of their beginnings. All names of a group walk down it together, level by level, each
with the length of the longest common subsequence so far. Matching blocks never cross, so the ratio cannot exceed the
share that this subsequence can still reach: a branch that stays below a name's level is left for that name. Texts that
contain a name or lie in it score more than that share; the caller finds them by their pieces.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from typing import NamedTuple

import numpy as np

#: Names that walk together, and places of the tree they may hold at once before they are split.
TOGETHER = 2048
PLACES = 1 << 20
#: Characters of a name that one machine word tracks; longer names are bounded by the sum over their words.
WORD = 64
SLACK = 1e-9


class Level(NamedTuple):
    """Nodes of one depth: first child and children of each node above, own character, shortest and longest text, text that ends."""

    first: np.ndarray
    children: np.ndarray
    char: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray
    ends: np.ndarray


def similarity(name: str, text: str) -> float:
    if name == text:
        return 1.0
    if name in text or text in name:
        short, long = sorted((len(name), len(text)))
        return max(0.75, short / long)
    return SequenceMatcher(None, name, text).ratio()


def _code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def tree(texts: list[str]) -> tuple[np.ndarray, list[Level]]:
    """Alphabet and levels of distinct, sorted, non-empty texts."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = _starts(lengths)
    alphabet, codes = np.unique(_code_points(texts), return_inverse=True)
    rows, above, nodes = np.arange(len(texts)), np.zeros(len(texts), dtype=np.int64), 1
    levels = []
    for depth in range(int(lengths.max(initial=0))):
        held = lengths[rows] > depth
        rows, above = rows[held], above[held]
        char = codes[starts[rows] + depth]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (above[1:] != above[:-1]) | (char[1:] != char[:-1])
        at, node = np.flatnonzero(new), np.cumsum(new) - 1
        children = np.bincount(above[at], minlength=nodes)
        ends = np.full(len(at), -1, dtype=np.int64)
        over = lengths[rows] == depth + 1
        ends[node[over]] = rows[over]
        levels.append(Level(
            _starts(children), children, char[at], np.minimum.reduceat(lengths[rows], at), np.maximum.reduceat(lengths[rows], at), ends
        ))
        above, nodes = node, len(at)
    return alphabet, levels


def _masks(names: list[str], alphabet: np.ndarray, words: int) -> np.ndarray:
    """Places of every character of the alphabet in every name, as bits."""
    masks = np.zeros((len(names), words, len(alphabet)), dtype=np.uint64)
    lengths = np.array([len(n) for n in names], dtype=np.int64)
    points = _code_points(names)
    name = np.repeat(np.arange(len(names)), lengths)
    place = np.arange(len(points)) - np.repeat(_starts(lengths), lengths)
    code = np.minimum(np.searchsorted(alphabet, points), len(alphabet) - 1)
    known = alphabet[code] == points
    bits = np.uint64(1) << (place % WORD).astype(np.uint64)
    np.bitwise_or.at(masks, (name[known], place[known] // WORD, code[known]), bits[known])
    return masks


def reachable(names: list[str], needed: np.ndarray, alphabet: np.ndarray, levels: list[Level]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(name, text, bound)`` of every pair whose bound reaches the name's level."""
    words = -(-max(map(len, names)) // WORD)
    masks, sizes = _masks(names, alphabet, words), np.array([len(n) for n in names], dtype=np.int64)
    name, node = np.arange(len(names)), np.zeros(len(names), dtype=np.int64)
    state = np.full((len(names), words), ~np.uint64(0))
    found, held = [], 0
    for depth, level in enumerate(levels, 1):
        children = level.children[node]
        held += int(children.sum())
        if held > PLACES and len(names) > 1:
            half = len(names) // 2
            first = reachable(names[:half], needed[:half], alphabet, levels)
            second = reachable(names[half:], needed[half:], alphabet, levels)
            return np.concatenate([first[0], second[0] + half]), np.concatenate([first[1], second[1]]), np.concatenate([first[2], second[2]])
        within = np.arange(int(children.sum())) - np.repeat(_starts(children), children)
        name, state = np.repeat(name, children), np.repeat(state, children, axis=0)
        node = np.repeat(level.first[node], children) + within
        # one character of the longest common subsequence, all names and words at once (Hyyro 2004)
        mask = masks[name, :, level.char[node]]
        state = (state + (state & mask)) | (state & ~mask)
        common = np.minimum(words * WORD - np.bitwise_count(state).sum(axis=1, dtype=np.int64), depth)
        size, level_of = sizes[name], needed[name] - SLACK
        ends, bound = level.ends[node], 2 * np.minimum(common, size) / (size + depth)
        over = (ends >= 0) & (common > 0) & (bound >= level_of)
        found.append((name[over], ends[over], bound[over]))
        # the length at which the share that can still be reached is largest
        longest = level.longest[node]
        best = np.clip(size + depth - common, level.shortest[node], longest)
        reach = 2 * np.minimum(size, common + best - depth) / (size + best)
        on = (longest > depth) & (reach >= level_of)
        name, node, state = name[on], node[on], state[on]
        if not len(name):
            break
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def best_in_block(names: list[str], needed: list[float], texts: list[str], places: list[tuple[int, int]]) -> list[tuple[str, float, int, int]]:
    """``(name, -score, *place)`` of the best text of every name that reaches its level: highest score, then first place.

    Texts are measured in falling order of their bound, down to the best score found.
    """
    if not names or not texts:
        return []
    order = sorted(range(len(texts)), key=texts.__getitem__)
    texts, places = [texts[k] for k in order], [places[k] for k in order]
    alphabet, levels = tree(texts)
    # names of similar length walk together
    asked = sorted(range(len(names)), key=lambda k: len(names[k]))
    out, begun = [], 0
    while begun < len(asked):
        words = -(-len(names[asked[min(begun + TOGETHER, len(asked)) - 1]]) // WORD)
        some = asked[begun:begun + max(1, TOGETHER // words)]
        begun += len(some)
        name, text, bound = reachable([names[k] for k in some], np.array([needed[k] for k in some]), alphabet, levels)
        best: dict[int, tuple[float, int, int]] = {}
        for at in np.lexsort((-bound, name)):
            top = best.get(int(name[at]), (0.0, 0, 0))
            if bound[at] + SLACK < -top[0]:
                continue
            score = -similarity(names[some[name[at]]], texts[text[at]])
            if score < 0:
                best[int(name[at])] = min(top, (score, *places[text[at]]))
        out += [(names[some[k]], *found) for k, found in best.items()]
    return out
