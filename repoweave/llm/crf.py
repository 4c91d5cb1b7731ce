"""A linear-chain conditional random field over tokens of a text, in numpy.

States are 0 outside, 1 begin, 2 inside. A token has a fixed number of feature ids; its score for a state is the sum of
their weights. Outside has weight 0 everywhere, and inside may only follow begin or inside.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from repoweave.llm.words import LOWER, Flat, span_hash

O, B, I = 0, 1, 2  # noqa: E741
FORBIDDEN = -1e4
BUCKETS = 1024
LINE_TOKENS = 64


def _table(chars: str) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[[ord(c) for c in chars]] = True
    return mask


_DIGIT = _table("0123456789")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWERCASE = _table("abcdefghijklmnopqrstuvwxyz")
_HEX = _table("0123456789abcdefABCDEF")
_MARK = _table("+/_.-")
_TOKEN = _DIGIT | _UPPER | _LOWERCASE | _MARK
_TOKEN[128:] = True
_QUOTE = _table("\"'`")
_ASSIGN = _table("=:")
_NEWLINE = _table("\n")
_CODE = _table("{}();=<>[]")

_LENGTHS = np.array([4, 8, 12, 16, 20, 24, 32, 40, 64])
_SHARES = np.array([0.001, 0.2, 0.4, 0.6, 0.999])

# Offsets of the feature groups; the last two are hashed neighbours.
_SIZES = [10, 6, 16, 6, 2, 4, 4, 4, 6, BUCKETS, BUCKETS]
_JOINT = ((0, 1, 2, 3, 4), (5, 6, 7, 8), (9,), (10,))
_CODE_SHARES = np.array([0.001, 0.005, 0.01, 0.02, 0.05])
_STARTS = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])
FEATURES = int(sum(_SIZES))


# Spans are measured up to this many bytes, so that four counts fit one 64-bit sum; differences of sums that wrap around
# are still right.
LONGEST = 60_000


def _packed(*masks: np.ndarray) -> np.ndarray:
    return sum(mask.astype(np.uint64) << np.uint64(16 * i) for i, mask in enumerate(masks))


_SHAPE = _packed(_DIGIT, _UPPER, _LOWERCASE, _MARK)
_AROUND = _packed(_HEX, _QUOTE, _ASSIGN, _NEWLINE)


def _sums(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data], out=out[1:])
    return out


def _field(packed: np.ndarray, i: int) -> np.ndarray:
    return ((packed >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int32)


class Tokens:
    """Tokens of a slice with their features: ``starts``, ``ends`` (bytes), ``doc``, ``line`` and ``groups``, one array
    of values per feature group."""

    def __init__(self, flat: Flat):
        data = flat.data
        self.starts, self.ends = flat.runs(_TOKEN[data])
        n = len(self.starts)
        self.doc = flat.doc_of(self.starts)
        if not n:
            self.line = self.starts
            self.groups = [np.zeros(0, dtype=np.int32) for _ in _SIZES]
            return
        measured = np.minimum(self.ends, self.starts + LONGEST)
        length = (measured - self.starts).astype(np.int32)
        around = _sums(_AROUND, data)
        shape = _sums(_SHAPE, data)
        shape = shape[measured] - shape[self.starts]
        digits, upper, lower, marks = (_field(shape, i) for i in range(4))
        hexes = _field(around[measured] - around[self.starts], 0)
        turn = np.zeros(len(data) + 1, dtype=np.int32)
        digit = _DIGIT[data]
        np.cumsum(digit[1:] != digit[:-1], out=turn[2:])
        turns = turn[measured] - turn[self.starts + 1]

        # What lies between a token and the one before it or the border of the text.
        before_from = np.maximum(np.concatenate([[0], self.ends[:-1]]), flat.offsets[self.doc])
        before_from = np.maximum(before_from, self.starts - LONGEST)
        gap = around[self.starts] - around[before_from]
        quote, assign, new_line = _field(gap, 1) > 0, _field(gap, 2) > 0, _field(gap, 3) > 0
        new_line[0] = True
        new_line[1:] |= self.doc[1:] != self.doc[:-1]
        self.line = np.cumsum(new_line)
        after_to = np.minimum(np.concatenate([self.starts[1:], [len(data)]]), flat.offsets[self.doc + 1])
        after_to = np.minimum(after_to, self.ends + LONGEST)
        gap = around[after_to] - around[self.ends]
        quote_after, assign_after = _field(gap, 1) > 0, _field(gap, 2) > 0

        code = np.bincount(flat.doc_of(np.flatnonzero(_CODE[data])), minlength=flat.n)
        code_share = np.searchsorted(_CODE_SHARES, code / np.maximum(np.diff(flat.offsets), 1), side="right")
        words = span_hash(Flat(LOWER[data], flat.offsets).prefix_hash(), self.starts, self.ends)
        before = np.zeros(n, dtype=np.uint64)
        before[1:] = np.where(new_line[1:], 0, words[:-1])
        two_before = np.zeros(n, dtype=np.uint64)
        two_before[2:] = np.where(new_line[2:] | new_line[1:-1], 0, words[:-2])
        self.groups = [
            np.searchsorted(_LENGTHS, length, side="right").astype(np.int32),
            np.searchsorted(_SHARES, digits / length, side="right").astype(np.int32),
            (digits > 0) + 2 * (upper > 0) + 4 * (lower > 0) + 8 * (marks > 0),
            (turns >= 1).astype(np.int32) + (turns >= 2) + (turns >= 4) + (turns >= 8) + (turns >= 16),
            ((hexes == length) & (length >= 16)).astype(np.int32),
            quote + 2 * quote_after,
            assign + 2 * assign_after,
            np.minimum(marks, 3),
            code_share[self.doc],
            (before % np.uint64(BUCKETS)).astype(np.int32),
            ((two_before >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int32),
        ]

    def features(self) -> np.ndarray:
        return np.stack([g + s for g, s in zip(self.groups, _STARTS, strict=True)], axis=1)


@dataclass
class Model:
    weights: np.ndarray  # features x 3
    moves: np.ndarray  # from x to
    first: np.ndarray

    def scores(self, tokens: Tokens, state: int) -> np.ndarray:
        """Score of one state for all tokens; the small groups are looked up in joint tables."""
        total = np.zeros(len(tokens.starts), dtype=np.float32)
        for part in _JOINT:
            table, index = np.zeros(1), 0
            for g in part:
                weights = self.weights[_STARTS[g] : _STARTS[g] + _SIZES[g], state]
                table = (table[:, None] + weights[None, :]).ravel()
                index = index * _SIZES[g] + tokens.groups[g]
            total += table.astype(np.float32)[index]
        return total

    def dearer(self, by: float) -> Model:
        """The model with every begin worth ``by`` less."""
        less = by * np.eye(3)[B]
        return Model(self.weights, self.moves - less, self.first - less)


def train(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, rate: float = 0.3, decay: float = 1e-3) -> Model:
    """Fit by full-batch gradient of the log-likelihood (scaled forward and backward sums) with per-weight step sizes.

    ``sequences`` are ``(features, states)``; long ones are cut to LINE_TOKENS tokens, which only bounds training.
    """
    sequences = [(f[:LINE_TOKENS], y[:LINE_TOKENS]) for f, y in sequences if len(y)]
    n, width = len(sequences), max(len(y) for _, y in sequences)
    features = np.zeros((n, width, len(_SIZES)), dtype=np.int64)
    states = np.zeros((n, width), dtype=np.int64)
    real = np.arange(width)[None, :] < np.array([len(y) for _, y in sequences])[:, None]
    for i, (f, y) in enumerate(sequences):
        features[i, : len(y)], states[i, : len(y)] = f, y
    model = Model(np.zeros((FEATURES, 3)), np.zeros((3, 3)), np.zeros(3))
    allowed, allowed_first = np.ones((3, 3)), np.ones(3)
    allowed[O, I], allowed_first[I] = 0, 0
    seen = [np.full_like(p, 1e-6) for p in (model.weights, model.moves, model.first)]
    gold = np.eye(3)[states] * real[..., None]
    gold_moves = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    used = features[real]
    for _ in range(rounds):
        emit = model.weights[features].sum(axis=2)
        emit = np.where(real[..., None], np.exp(emit - emit.max(axis=2, keepdims=True)), 1.0)
        moves = np.exp(model.moves) * allowed
        forward, backward, scale = np.ones((n, width, 3)), np.ones((n, width, 3)), np.ones((n, width, 1))
        alpha = np.exp(model.first) * allowed_first * emit[:, 0]
        for t in range(width):
            if t:
                alpha = np.where(real[:, t, None], (forward[:, t - 1] @ moves) * emit[:, t], forward[:, t - 1])
            scale[:, t] = alpha.sum(axis=1, keepdims=True)
            forward[:, t] = alpha / scale[:, t]
        for t in range(width - 2, -1, -1):
            step = (emit[:, t + 1] * backward[:, t + 1] / scale[:, t + 1]) @ moves.T
            backward[:, t] = np.where(real[:, t + 1, None], step, 1.0)
        belief = forward * backward * real[..., None]
        pair = moves * np.einsum(
            "nti,ntj->ij", forward[:, :-1], emit[:, 1:] * backward[:, 1:] / scale[:, 1:] * real[:, 1:, None]
        )
        difference = gold - belief
        grad = np.zeros_like(model.weights)
        for state in (B, I):
            value = difference[..., state][real]
            for column in used.T:
                grad[:, state] += np.bincount(column, value, minlength=FEATURES)
        updates = (grad - decay * model.weights, gold_moves - pair, difference[:, 0].sum(axis=0))
        for value, g, total in zip((model.weights, model.moves, model.first), updates, seen, strict=True):
            total += g * g
            value += rate * g / np.sqrt(total)
    model.moves[O, I], model.first[I] = FORBIDDEN, FORBIDDEN
    return model


def viterbi(emit: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best state sequence of one line; of equal ones, that with the lower state at the end."""
    back = np.zeros((len(emit), 3), dtype=np.int8)
    best = (first + emit[0]).tolist()
    rows, m = emit.tolist(), moves.tolist()
    for t in range(1, len(rows)):
        new = []
        for s in (O, B, I):
            options = (best[0] + m[0][s], best[1] + m[1][s], best[2] + m[2][s])
            k = options.index(max(options))
            back[t, s] = k
            new.append(options[k] + rows[t][s])
        best = new
    states = np.zeros(len(rows), dtype=np.int8)
    states[-1] = best.index(max(best))
    for t in range(len(rows) - 1, 0, -1):
        states[t - 1] = back[t, states[t]]
    return states


def decode(model: Model, tokens: Tokens) -> np.ndarray:
    """States of all tokens, line by line.

    A line needs the full search only if some token could gain from not being outside: the gain of any path over the
    all-outside path is at most the sum of the positive parts bounded here. All other lines are outside throughout.
    """
    states = np.zeros(len(tokens.starts), dtype=np.int8)
    if not len(states):
        return states
    begin, inside = model.scores(tokens, B), model.scores(tokens, I)
    relative = model.moves - model.moves[O, O]
    leave = np.maximum(relative[:, O], 0)
    enter = np.maximum(relative.max(axis=0), model.first - model.first[O])
    gain = np.maximum(begin + (enter[B] + leave[B]), inside + (enter[I] + leave[I]))
    lines = np.unique(tokens.line[gain > 0])
    begins = np.searchsorted(tokens.line, lines, side="left")
    ends = np.searchsorted(tokens.line, lines, side="right")
    for lo, hi in zip(begins, ends, strict=True):
        emit = np.stack([np.zeros(hi - lo), begin[lo:hi], inside[lo:hi]], axis=1)
        states[lo:hi] = viterbi(emit, model.moves, model.first)
    return states
