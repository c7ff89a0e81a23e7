"""Online logistic mixing within a text, over words.

A text is a row of words with an end mark. Before a word is spelled, bits say
whether it is the word that followed the last time in this text: behind the
same two words first, then behind the same one (each only where there was such
a time, and the second not for a word already ruled out). Each bit is
predicted by counters of hashed contexts: how many words in a row were told
so, how often the context was seen and how its last telling went; how likely
the told word is; and the context itself. The counters hold what earlier bits
of this text were, over a start that is the same for all texts. Their
stretched probabilities are mixed by weights gated by the kind of context and
the run; the weights take a step after every block of bits, blocks doubling in
length, and a map of the mixed probability, counted in this text too, refines
it. A bit is never predicted from itself or what follows, so the sum of the
logarithms is that of a probability of the text.

All texts of a batch go together; a text's score doesn't depend on the others.
"""

from __future__ import annotations

import numpy as np

#: Start of a bit's chance by the run (0, 1, 2 to 3, 4 to 7, longer), in sights its weight, and that of the map's cells.
START, STRENGTH, MAP_STRENGTH = np.array([0.03, 0.3, 0.6, 0.85, 0.95]), 2.0, 8.0
WEIGHT, FIRST_BLOCK, CELLS = 0.4, 16, 16
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
PREDICTORS = 3


def hashed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h + p.astype(np.uint64) + np.uint64(1)) * MULTIPLY
        h ^= h >> np.uint64(29)
    return h


def before(keys: np.ndarray, bits: np.ndarray | None = None) -> tuple:
    """For each place the last earlier one with the same key (or -1), how many
    earlier ones there are, and how many ones their bits add up to."""
    # One sort of keys with their places below: hashes give their top bits up for them.
    wide = np.uint64(max(1, len(keys)).bit_length())
    lined = np.sort((keys.astype(np.uint64) << wide) | np.arange(len(keys), dtype=np.uint64))
    order = (lined & ((np.uint64(1) << wide) - np.uint64(1))).astype(np.int64)
    lined >>= wide
    new = np.append(True, lined[1:] != lined[:-1])[: len(keys)]
    at = np.arange(len(keys))
    first = np.maximum.accumulate(np.where(new, at, 0))
    last, n = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    last[order] = np.where(new, -1, np.append(-1, order[:-1])[: len(keys)])
    n[order] = at - first
    if bits is None:
        return last, n, None
    total = np.cumsum(bits[order]) - bits[order]
    ones = np.empty(len(keys), np.int64)
    ones[order] = total - total[first]
    return last, n, ones


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def decisions(ids: np.ndarray, doc: np.ndarray, logp: np.ndarray) -> tuple:
    """Which words are told, and the bits in the order they are coded: place,
    kind, bit, run, and three hashed contexts."""
    n = len(ids)
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(np.append(True, doc[1:] != doc[:-1]), at, 0))
    place = at - start
    one = np.where(place >= 1, np.append(0, ids[:-1]), -7)
    two = np.where(place >= 2, np.append([0, 0], ids[:-2])[:n], -7)
    kinds = []
    for k, (key, least) in enumerate(((hashed(doc, one, two), 2), (hashed(doc, one), 1))):
        last, seen, _ = before(key)
        asked = (last >= 0) & (place >= least)
        word = np.where(asked, ids[last], -9)
        kinds.append([asked, word, asked & (word == ids), seen, last, key])
    kinds[1][0] = kinds[1][0] & ~kinds[0][2] & (kinds[1][1] != kinds[0][1])
    told = kinds[0][2] | (kinds[1][0] & kinds[1][2])
    # The words told in a row right before each place; a text's first word is never told.
    missed = np.maximum.accumulate(np.where(told, -1, at))
    run = np.where(place > 0, at - 1 - np.append(-1, missed[:-1]), 0)
    run = np.minimum(np.frexp(run.astype(np.float32))[1], 4)
    out = []
    for k, (asked, word, hit, seen, last, key) in enumerate(kinds):
        i = np.flatnonzero(asked)
        went = np.where(asked[last[i]], 1 + hit[last[i]], 0)
        likely = np.clip(-2 * logp[last[i]], 0, 15).astype(np.int64)
        kind = np.full(len(i), k)
        out.append([i, kind, hit[i].astype(np.int64), run[i], hashed(doc[i], kind + 10, run[i], np.minimum(seen[i], 3), went),
                    hashed(doc[i], kind + 20, likely, run[i] > 0), hashed(doc[i], kind + 30, key[i])])
    both = [np.concatenate(c) for c in zip(*out)]
    order = np.argsort(2 * both[0] + both[1])
    return told, [c[order] for c in both]


def score(ids: np.ndarray, doc: np.ndarray, logp: np.ndarray, n_docs: int) -> np.ndarray:
    """log10 probability of each text: ids of its words and of its end (a
    negative one) one after the other, doc their texts, ascending from 0, logp
    what spelling a word costs."""
    if not len(ids):
        return np.zeros(n_docs)
    told, (place, kind, bit, run, *contexts) = decisions(ids, doc, logp)
    total = np.bincount(doc, np.where(told, 0.0, logp), n_docs)
    if not len(place):
        return total
    of = doc[place]
    x = np.empty((PREDICTORS, len(place)))
    for j, c in enumerate(contexts):
        _, n, ones = before(c, bit)
        x[j] = stretch((ones + STRENGTH * START[run]) / (n + STRENGTH))
    gate = of * 4 + 2 * kind + (run > 0)
    weights = np.full((PREDICTORS, 4 * n_docs), WEIGHT)
    nth = before(of)[1]
    block = np.frexp((nth // FIRST_BLOCK).astype(np.float32))[1]
    order = np.argsort(block.astype(np.uint8), kind="stable")
    edges = np.append(np.searchsorted(block[order], np.arange(block.max() + 1)), len(order))
    p = np.empty(len(place))
    for a, b in zip(edges, edges[1:]):
        i = order[a:b]
        g, xs = gate[i], x[:, i]
        p[i] = 1 / (1 + np.exp(-np.clip((weights[:, g] * xs).sum(0), -9, 9)))
        gates, where = np.unique(g, return_inverse=True)
        for j in range(PREDICTORS):
            slope, bend = np.bincount(where, (bit[i] - p[i]) * xs[j]), np.bincount(where, xs[j] * xs[j])
            weights[j, gates] = np.clip(weights[j, gates] + slope / (bend + 8) / PREDICTORS, 0, 2)
    cell = np.clip((stretch(p) + 8) * (CELLS / 16), 0, CELLS - 1).astype(np.int64)
    _, n, ones = before((of * 2 + kind) * CELLS + cell, bit)
    p = (p + (ones + MAP_STRENGTH * p) / (n + MAP_STRENGTH)) / 2
    return total + np.bincount(of, np.log10(np.where(bit == 1, p, 1 - p)), n_docs)
