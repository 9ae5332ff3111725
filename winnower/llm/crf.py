"""A linear-chain conditional random field over words, in numpy.

Features of a word are hashed: the word, its affixes, its byte bigrams and trigrams, and its entry in a
lexicon learned from the labelled rows. All words of a text are one chain, of any length: the forward-backward
recursion runs over blocks of BLOCK words, all blocks of a batch at once, and carries its messages from block to
block. Fitting is by gradient steps (Adam) on the conditional likelihood of a bounded sample, a slice of texts at a
time; the model is a few MB whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from winnower.llm.common import byte_runs, give_back, group_sums, mix, run_hashes

BLOCK = 64
BITS = 18
AFFIX = 4
FITTED_AT_ONCE = 1 << 17  # words

LETTERS = np.zeros(256, bool)
LETTERS[ord("a") : ord("z") + 1] = True
LETTERS[ord("A") : ord("Z") + 1] = True
LETTERS[0x80:] = True


def slots(kind: int, value: np.ndarray) -> np.ndarray:
    return (mix(value.astype(np.uint64) + np.uint64(kind << 56)) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Words:
    """The words of a batch of texts: each distinct word once, and the sequence of their numbers."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)
    number: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        hashes = run_hashes(self.data, self.starts, self.ends)
        self.hashes, self.first, self.number = np.unique(hashes, return_index=True, return_inverse=True)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, *byte_runs(data, offsets, LETTERS))


def features(words: Words, lexicon: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each distinct word's features on end, and where each word's begin."""
    starts, ends = words.starts[words.first], words.ends[words.first]
    size, n = ends - starts, len(starts)
    owner, slot = [np.arange(n)], [slots(1, words.hashes)]
    entries, kinds = lexicon
    if len(entries) and n:
        at = np.minimum(np.searchsorted(entries, words.hashes), len(entries) - 1)
        known = np.flatnonzero(entries[at] == words.hashes)
        owner.append(known)
        slot.append(slots(2, kinds[at[known]]))
    for k in range(1, AFFIX + 1):
        long = np.flatnonzero(size >= k)
        head, tail = np.zeros(len(long), np.uint64), np.zeros(len(long), np.uint64)
        for j in range(k):
            head = head << np.uint64(8) | words.data[starts[long] + j]
            tail = tail << np.uint64(8) | words.data[ends[long] - k + j]
        owner += [long, long]
        slot += [slots(2 + k, head), slots(10 + k, tail)]
    for k in (2, 3):
        count = np.maximum(size - k + 1, 0)
        who = np.repeat(np.arange(n), count)
        at = starts[who] + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        gram = np.zeros(len(who), np.uint64)
        for j in range(k):
            gram = gram << np.uint64(8) | words.data[at + j]
        owner.append(who)
        slot.append(slots(20 + k, gram))
    owner = np.concatenate([x.astype(np.int32) for x in owner])
    slot = np.concatenate(slot)
    order = np.argsort(owner, kind="stable")
    return slot[order], np.searchsorted(owner[order], np.arange(n))


@dataclass
class Blocks:
    """Words of texts dealt to blocks: each word's place and block, and how blocks follow each other.

    A text's words are one chain. Blocks only let numpy step through many of them at once: messages are carried
    from each block to the next one of its text, so no transition is lost.
    """

    place: np.ndarray
    block: np.ndarray
    first: np.ndarray  # whether a block begins its text
    rounds: list[np.ndarray]  # the blocks that are the k-th of their text, for each k > 0

    @staticmethod
    def of(text: np.ndarray, length: int) -> Blocks:
        n = len(text)
        if not n:
            none = np.zeros(0, np.int64)
            return Blocks(none, none, np.zeros(0, bool), [])
        head = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        within = np.arange(n) - np.repeat(head, np.diff(np.r_[head, n]))
        place = within % length
        begin = place == 0
        nth = within[begin] // length
        order = np.argsort(nth, kind="stable")
        ends = np.cumsum(np.bincount(nth))
        return Blocks(place, np.cumsum(begin) - 1, nth == 0, [order[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])


def unit(values: np.ndarray, axis: int | tuple[int, ...] = 0) -> np.ndarray:
    return values / np.maximum(values.sum(axis, keepdims=True), np.finfo(values.dtype).tiny)


def forward_backward(score: np.ndarray, step: np.ndarray, text: np.ndarray, pairs: bool = False, length: int = BLOCK):
    """Marginals of every word's label given all words of its text; with pairs also the expected transitions.

    First what a block does to a message is put into a matrix, for all blocks at once; then messages go from block to
    block in both directions; then each word's two messages are found within its block. Labels are the first
    axis of a message and blocks the last.
    """
    n, labels = score.shape
    if not n:
        return np.zeros((0, labels)), np.zeros((labels, labels))
    dealt = Blocks.of(text, length)
    place, block, first, many = dealt.place, dealt.block, dealt.first, len(dealt.first)
    size = np.bincount(block, minlength=many)
    wide = int(size.max())
    psi = np.ones((wide, labels, many), np.float32)
    psi[place, :, block] = np.exp(score - score.max(1, keepdims=True))
    real = np.arange(wide)[:, None] < size
    move = np.exp(step - step.max())

    carried = np.full((labels, many), 1 / labels)  # label before the block, from what is before it
    beyond = np.full((labels, many), 1 / labels)  # label at the block's end, from what is after it
    if dealt.rounds:
        linked = np.flatnonzero(~first | np.r_[~first[1:], False])  # blocks of texts that have several
        at = np.full(many, -1)
        at[linked] = np.arange(len(linked))
        through = np.where(first[linked], np.eye(labels)[:, :, None], move[:, :, None]) * psi[0][:, linked]
        for t in range(1, wide):
            moved = np.matmul(move.T, through) * psi[t][:, linked]
            through = np.where(real[t, linked], moved, through)
            if t % 8 == 0:
                through = unit(through, (0, 1))
        through = unit(through, (0, 1))
        for blocks in dealt.rounds:
            carried[:, blocks] = unit((carried[:, None, blocks - 1] * through[:, :, at[blocks - 1]]).sum(0))
        for blocks in reversed(dealt.rounds):
            beyond[:, blocks - 1] = unit((through[:, :, at[blocks]] * beyond[:, blocks]).sum(1))

    ahead, back = np.empty_like(psi), np.empty_like(psi)
    ahead[0] = unit(np.where(first, 1.0, move.T @ carried) * psi[0])
    move = move.astype(np.float32)
    for t in range(1, wide):
        ahead[t] = unit((move.T @ ahead[t - 1]) * psi[t])
    back[wide - 1] = beyond
    for t in range(wide - 2, -1, -1):
        back[t] = np.where(real[t + 1], unit(move @ (psi[t + 1] * back[t + 1])), beyond)
    expected = np.zeros((labels, labels))
    if pairs:
        for t in range(wide):
            joint = (ahead[t - 1] if t else carried)[:, None] * move[:, :, None] * (psi[t] * back[t])
            expected += unit(joint, (0, 1))[:, :, real[t] if t else ~first].sum(2)
    return unit((ahead * back)[place, :, block], 1), expected


@dataclass
class Chain:
    labels: list
    weights: np.ndarray
    step: np.ndarray
    lexicon: tuple[np.ndarray, np.ndarray]

    def marginals(self, words: Words) -> np.ndarray:
        slot, begin = features(words, self.lexicon)
        score = np.stack([group_sums(self.weights[slot, k], begin) for k in range(len(self.labels))], 1)[words.number] if len(words.number) else np.zeros((0, len(self.labels)))
        return forward_backward(score, self.step, words.text)[0]


def fit(words: Words, gold: np.ndarray, labels: list, lexicon: tuple, rounds: int = 30, rate: float = 0.25, decay: float = 1e-6) -> Chain:
    """Learns weights and transitions from words whose labels (numbers into labels) are gold."""
    m, n = len(labels), len(gold)
    weights, step = np.zeros((1 << BITS, m), np.float32), np.zeros((m, m))
    if not n or m < 2:
        return Chain(labels, weights, step, lexicon)
    slot, begin = features(words, lexicon)
    give_back()
    feats = np.diff(np.r_[begin, len(slot)])
    follows = np.flatnonzero(np.r_[False, words.text[1:] == words.text[:-1]])
    seen = np.zeros((m, m))
    np.add.at(seen, (gold[follows - 1], gold[follows]), 1)
    target = np.stack([np.bincount(words.number[gold == k], minlength=len(begin)) for k in range(m)], 1).astype(float)
    states = [[np.zeros_like(weights), np.zeros_like(weights)], [np.zeros_like(step), np.zeros_like(step)]]
    starts = np.searchsorted(words.text, np.unique(words.text))
    bounds = np.r_[starts[np.r_[True, np.diff(starts // FITTED_AT_ONCE) > 0]], n]  # slices of whole texts
    for i in range(1, rounds + 1):
        each = np.stack([group_sums(weights[slot, k], begin) for k in range(m)], 1)  # a label at a time: less memory
        held, moves = np.zeros((len(begin), m)), np.zeros((m, m))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            number = words.number[lo:hi]
            got, moved = forward_backward(each[number], step, words.text[lo:hi], pairs=True)
            held += np.stack([np.bincount(number, got[:, k], len(begin)) for k in range(m)], 1)
            moves += moved
        error = target - held
        slope = np.stack([np.bincount(slot, np.repeat(error[:, k], feats), 1 << BITS) for k in range(m)], 1) / n - decay * weights
        for value, g, (one, two) in ((weights, slope, states[0]), (step, (seen - moves) / n, states[1])):
            one += 0.1 * (g - one)
            two += 0.01 * (g * g - two)
            value += rate * (one / (1 - 0.9**i)) / (np.sqrt(two / (1 - 0.99**i)) + 1e-7)
    return Chain(labels, weights, step, lexicon)
