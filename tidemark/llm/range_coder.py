"""Context-mixing range coder for token ids, over many independent blocks at once.

Every block of ids starts from the same state, so any block can be read alone. A block's next id is predicted by three
orders: order 2 and order 1 hold, for the last two ids and the last id, the id that followed there and how often it did
so in a row; order 0 holds how frequent ids are, from the file's prior and the block's own ids. One candidate id comes
from the highest order that knows one. The three orders' adaptive estimates that it is right are mixed in the logistic
domain by weights learnt on line; what is left of the code space is shared out by order 0. One arithmetic step codes
"the candidate" or the id.

All numbers are integers, so a decoder anywhere repeats the encoder's steps exactly. Blocks are coded in lock step:
NumPy works on one id of each block at a time, so a Python step is spread over as many ids as there are blocks.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np

PART_BITS = 10
GROUP = 1 << PART_BITS  # order 0 codes the upper part of an id adaptively, and the lower part by the file's prior
GROUP_BITS, PRIOR_BITS, TOTAL_BITS = 16, 14, 32
LEAST_GROUP = 32  # of 2 ** GROUP_BITS, so that no id is without code space
REFRESH = 64  # ids between two refreshes of a block's order-0 sums
PRIOR_WEIGHT, OWN_WEIGHT = 4096, 16
BITS1, BITS2, MOST_CONFIDENCE = 9, 10, 15


_made: dict[str, tuple] = {}


def _curves() -> tuple[np.ndarray, np.ndarray]:
    """Probability of 4096 by logit (in 256ths, from -2047) and logit by probability; decimal arithmetic gives every machine the same table."""
    if "curves" in _made:
        return _made["curves"]
    squash = np.array([min(4095, max(1, int(Decimal(4096) / (1 + (Decimal(-x) / 256).exp())))) for x in range(-2047, 2048)], np.int64)
    stretch = np.searchsorted(squash, np.arange(4096)).clip(0, 4094) - 2047
    _made["curves"] = squash, stretch
    return squash, stretch


class Prior:
    """Order 0 of a file: the share of each group of ids, and of each id in its group."""

    def __init__(self, widths: np.ndarray, groups: np.ndarray):
        self.widths, self.groups = widths.astype(np.int64), groups.astype(np.int64)
        n = len(groups)
        low = np.zeros((n, GROUP + 1), np.int64)
        np.cumsum(self.widths.reshape(n, GROUP), axis=1, out=low[:, 1:])
        self.low = low
        self.id_of = np.stack([np.repeat(np.arange(GROUP), w) for w in self.widths.reshape(n, GROUP)]).astype(np.int16)
        share = self.widths.reshape(n, GROUP) * self.groups[:, None] / (1 << PRIOR_BITS) / self.groups.sum()
        self.logit = _curves()[1][np.clip((share.reshape(-1) * 4096).astype(np.int64), 1, 4095)]

    @staticmethod
    def of(ids: np.ndarray, vocabulary: int) -> Prior:
        n = -(-vocabulary // GROUP)
        counts = np.bincount(ids, minlength=n * GROUP).reshape(n, GROUP).astype(np.int64)
        total = counts.sum(axis=1, keepdims=True)
        free = (1 << PRIOR_BITS) - GROUP
        widths = 1 + counts * free // np.maximum(total, 1)
        widths[np.arange(n), counts.argmax(axis=1)] += (1 << PRIOR_BITS) - widths.sum(axis=1)
        return Prior(widths.reshape(-1).astype(np.uint16), np.maximum(1, total[:, 0] * PRIOR_WEIGHT // max(1, int(total.sum()))).astype(np.uint16))


class _Model:
    """What the blocks have learnt so far; the same calls in the same order give the same state to encoder and decoder."""

    def __init__(self, prior: Prior, n_blocks: int):
        self.prior, self.n, self.n_groups = prior, n_blocks, len(prior.groups)
        lanes = np.arange(n_blocks, dtype=np.int64)
        # What followed, as id << 4 | confidence: a table of order 1 for each block, then one of order 2 for each.
        self.table = np.zeros((n_blocks << BITS1) + (n_blocks << BITS2), np.int32)
        self.base = np.stack([lanes << BITS1, (n_blocks << BITS1) + (lanes << BITS2)])
        self.mask = np.array([[(1 << BITS1) - 1], [(1 << BITS2) - 1]])
        # How often an order was right, by its confidence and by whether it names the candidate.
        self.rates = np.full(n_blocks * 64, 8192, np.int32)
        self.rates_base = np.stack([lanes * 64, lanes * 64 + 32])
        self.weights = np.full((3, n_blocks), 1 << 14, np.int64)
        self.logits = np.empty((3, n_blocks), np.int64)
        self.mixed = np.empty((2, n_blocks), np.int64)
        self.last, self.last2 = np.zeros(n_blocks, np.int64), np.zeros(n_blocks, np.int64)
        self.lanes = lanes
        self.counts = np.repeat(prior.groups.astype(np.int32), n_blocks)  # by group, then block
        self.sums = np.full((self.n_groups + 1, n_blocks), 1 << GROUP_BITS, np.int32)
        self.sums[0] = 0
        self.flat_sums = self.sums.reshape(-1)
        self.seen = 0
        self.squash, stretch = _curves()
        self.stretch = np.repeat(stretch, 16)

    def refresh(self) -> None:
        """Sums of the groups' shares; every group keeps a least share."""
        total = int(self.prior.groups.sum()) + OWN_WEIGHT * self.seen
        free = ((1 << GROUP_BITS) - LEAST_GROUP * self.n_groups << 14) // total
        sums = np.cumsum(self.counts.reshape(self.n_groups, self.n)[:-1], axis=0, dtype=np.int64)
        sums *= free
        sums >>= 14
        sums += LEAST_GROUP * np.arange(1, self.n_groups)[:, None]
        self.sums[1:-1] = sums

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Candidate ids and the part of the code space (of 2 ** TOTAL_BITS) that each gets."""
        if self.seen % REFRESH == 0:
            self.refresh()
        mixed = self.mixed
        np.multiply(self.last, 40503, out=mixed[0])
        np.multiply(self.last2, 69621, out=mixed[1])
        mixed[1] += mixed[0]
        mixed >>= 5
        mixed &= self.mask
        self.at = mixed + self.base
        self.entry = self.table.take(self.at)
        self.sure = self.entry & 15
        self.named = self.entry >> 4
        candidate = np.where(self.sure[1], self.named[1], self.named[0]).astype(np.int64)
        self.r = ((self.named == candidate) << 4) + self.sure
        self.r += self.rates_base
        self.rate = self.rates.take(self.r)
        logits = self.logits
        logits[0] = self.prior.logit.take(candidate)
        logits[1:] = self.stretch.take(self.rate)
        logit = (self.weights * logits).sum(axis=0)
        logit >>= 16
        np.maximum(logit, -2047, out=logit)
        np.minimum(logit, 2047, out=logit)
        logit += 2047
        self.p = self.squash.take(logit)
        return candidate, np.minimum(self.p, 3968) << (TOTAL_BITS - 12)

    def update(self, ids: np.ndarray, hit: np.ndarray) -> None:
        goal = hit.astype(np.int32)
        step = ((goal << 12) - self.p) * 6 * self.logits
        step += 32768
        step >>= 16
        self.weights += step
        self.rates[self.r] = self.rate + ((goal << 16) - goal - self.rate >> 5)
        new = (ids << 4 | 1).astype(np.int32)
        entry = self.entry
        self.table[self.at] = np.where(self.named == ids, np.minimum(entry + 1, entry | MOST_CONFIDENCE), np.where(self.sure > 2, entry - 2, new))
        self.counts[(ids >> PART_BITS) * self.n + self.lanes] += OWN_WEIGHT
        self.last2, self.last = self.last, ids
        self.seen += 1


def encode(blocks: np.ndarray, prior: Prior) -> list[bytes]:
    """Code of each row of ``blocks``."""
    n, length = blocks.shape
    model, columns = _Model(prior, n), np.ascontiguousarray(blocks.T, dtype=np.int64)
    room = 2 * length + 8  # of 16 bits each; no id takes more than 32 bits
    out = np.zeros(n * room, np.int32)
    at = np.arange(n, dtype=np.int64) * room
    first = at.copy()
    low, span = np.zeros(n, np.int64), np.full(n, 1 << 56, np.int64)
    inside = prior.low.reshape(-1)
    for ids in columns:
        candidate, chance = model.predict()
        hit = ids == candidate
        rest = (1 << TOTAL_BITS) - chance
        group, part = ids >> PART_BITS, ids & (GROUP - 1)
        where = group * n + model.lanes
        start = rest * model.flat_sums.take(where) >> GROUP_BITS
        width = (rest * model.flat_sums.take(where + n) >> GROUP_BITS) - start
        place = group * (GROUP + 1) + part
        lower, upper = width * inside.take(place) >> PRIOR_BITS, width * inside.take(place + 1) >> PRIOR_BITS
        begin = np.where(hit, 0, chance + start + lower)
        size = np.where(hit, chance, upper - lower)
        unit = span >> TOTAL_BITS
        low += unit * begin
        span = unit * size
        short = span < (1 << 40)
        out[at] = low >> 40  # a carry into the word before is settled at the end
        at += short
        shift = short.astype(np.int64) << 4
        low = np.where(short, low & ((1 << 40) - 1), low) << shift
        span <<= shift
        more = np.flatnonzero(span < (1 << 40))
        if len(more):  # no id needs three words
            out[at[more]] = low[more] >> 40
            at[more] += 1
            low[more] = (low[more] & ((1 << 40) - 1)) << 16
            span[more] <<= 16
        model.update(ids, hit)
    out[at] = low + (1 << 40) - 1 >> 40  # one word names a number inside the last span; the decoder goes on with zeros
    at += 1
    words = out.reshape(n, room)
    used = at - first
    for k in range(int(used.max()) - 1, 0, -1):
        words[:, k - 1] += words[:, k] >> 16
    words &= 0xFFFF
    flat = words.astype("<u2")
    return [flat[k, : used[k]].tobytes() for k in range(n)]


def decode(codes: list[bytes], length: int, prior: Prior) -> np.ndarray:
    """The ids of each code, as rows of ``length``."""
    n = len(codes)
    model = _Model(prior, n)
    room = max(len(c) for c in codes) // 2 + 8  # zeros stand beyond the end
    words = np.zeros((n, room), np.int64)
    for k, c in enumerate(codes):
        words[k, : len(c) // 2] = np.frombuffer(c, "<u2")
    code = (words[:, 0] << 40) | (words[:, 1] << 24) | (words[:, 2] << 8) | (words[:, 3] >> 8)
    ahead = np.zeros((n, room), np.int64)  # the same bits as words that start in the middle of a word, as the register is 56 bits wide
    ahead[:, :-1] = (words[:, :-1] & 255) << 8 | words[:, 1:] >> 8
    ahead = ahead.reshape(-1)
    at = np.arange(n, dtype=np.int64) * room + 3
    span = np.full(n, 1 << 56, np.int64)
    inside, id_of = prior.low.reshape(-1), prior.id_of.reshape(-1)
    out = np.zeros((length, n), np.int64)
    for k in range(length):
        candidate, chance = model.predict()
        unit = span >> TOTAL_BITS
        value = np.minimum(code // unit, (1 << TOTAL_BITS) - 1)
        hit = value < chance
        rest = (1 << TOTAL_BITS) - chance
        value = np.where(hit, 0, value - chance)
        share = np.minimum(((value + 1 << GROUP_BITS) - 1) // rest, (1 << GROUP_BITS) - 1).astype(np.int32)
        group = (model.sums[1:] <= share).sum(axis=0, dtype=np.int16).astype(np.int64)
        where = group * n + model.lanes
        start = rest * model.flat_sums.take(where) >> GROUP_BITS
        width = (rest * model.flat_sums.take(where + n) >> GROUP_BITS) - start
        share = np.minimum(((value - start + 1 << PRIOR_BITS) - 1) // width, (1 << PRIOR_BITS) - 1)
        part = id_of.take((group << PRIOR_BITS) + share)
        place = group * (GROUP + 1) + part
        lower, upper = width * inside.take(place) >> PRIOR_BITS, width * inside.take(place + 1) >> PRIOR_BITS
        code -= unit * np.where(hit, 0, chance + start + lower)
        span = unit * np.where(hit, chance, upper - lower)
        ids = np.where(hit, candidate, group << PART_BITS | part)
        short = span < (1 << 40)
        code = np.where(short, code << 16 | ahead.take(at), code)
        at += short
        span <<= short.astype(np.int64) << 4
        more = np.flatnonzero(span < (1 << 40))
        if len(more):
            code[more] = code[more] << 16 | ahead[at[more]]
            at[more] += 1
            span[more] <<= 16
        out[k] = ids
        model.update(ids, hit)
    return np.ascontiguousarray(out.T)
