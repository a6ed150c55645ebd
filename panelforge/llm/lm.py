"""Language-model scoring with a log-bilinear neural model.

Tokens are words and one end a text. The output has two levels. On the first are the end, the most
frequent words of the training texts and groups of slots; on the second are the slots of each group. A
frequent word beyond the first level has a slot of its own, and so many of them grow with the counts;
all other words share hashed slots, which grow too. Both numbers follow the root of the tokens, and so do
the groups their slots, so a slot costs little at any size. The context is the two words (or slots)
before. Its vector is the sum of their vectors, each weighted by position, and a logit on either level
the product of that vector with the output's own plus a bias. Training is noise-contrastive estimation
with numpy over every training text, the noise of a slot being other slots of its group: each Spark
partition takes one pass over its own texts, from the same start, and the parameters are averaged,
weighted by tokens. Scoring normalises both levels exactly: the first by products of exponentials of the units
before, the second by batched matrix products.

A word in a hashed slot has the slot's probability times its share of the slot's count. A fixed part of
the probability of all hashed slots, freed by discounts, is that of the words that training has not seen;
words that were seen have the rest. How many types are unseen is estimated from those seen once and twice,
and each has an equal part, so an unknown word is not likelier than the rare words that are known.

Counts cover all training texts. The words of the ``heavy`` largest counts are broadcast and resolved
where they occur; the others meet their counts in a join.

A null text counts as empty and is its end alone. Rows with null ids are in the fold of the empty text.
Repeated rows are learned from and scored each for itself; a row is numbered in the task that scores it and takes
its id along, so the parts of its score meet whatever order the input comes in. Without training texts every token is unseen.
Other columns may have any names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import materialize

#: Words on the first level, the end among them.
CLASSES = 128
#: Slots of words' own for each root of the tokens, and at least so many, for words of so many occurrences; hashed slots for each root.
OWN, LEAST_OWN, OWN_COUNT, HASHED = 4, 2048, 3, 1
HEAVY = 100_000
DIM = 32
CONTEXT = 2
NOISE = 64
#: Noise samples on the second level, for each ``SHARED`` tokens of a group in a batch.
SLOT_NOISE, SHARED = 16, 16
#: Parameters of one row of the sums over partitions.
PIECE = 4096
#: Training partitions for each core, so that what the partitions send grows with the cluster, not with the corpus.
WAVES = 4
BATCH = 4096
#: Contexts that are scored together, so that their logits stay in a core's cache; logits below ``LARGE`` have exponentials that floats hold.
ROWS, LARGE = 512, 64.0
#: Exponentials of one position's units that are held at once.
TABLE = 1 << 23
#: The end of a text as a token; no word is empty.
END = b""
COUNT_WORDS = 500_000
#: Bytes of texts whose tokens are numbered and scored together; a longer text is alone.
SLICE = 6_000_000


def slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts in runs of ``SLICE`` bytes, each with its place."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        yield at, column.slice(at, to - at)
        at = to


def tokens_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct tokens, all tokens of the texts by their place among them, and where each text begins."""
    words, found, first = _tokens_of(texts)
    return words.to_pylist(), found, first


def _tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``tokens_of`` with the distinct tokens as an Arrow column."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    numbered = lists.flatten().dictionary_encode()
    words = numbered.dictionary.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    # White space at either end leaves an empty word; the end of a text takes its number.
    end = pc.index(words, pa.scalar(END, words.type)).as_py()
    if end < 0:
        words, end = pa.concat_arrays([words, pa.array([END], words.type)]), len(words)
    codes = numbered.indices.to_numpy(zero_copy_only=False)
    kept = codes != end
    before = np.r_[0, np.cumsum(kept)]
    bounds = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
    ends = np.cumsum(np.diff(before[bounds]) + 1)
    is_end = np.zeros(ends[-1] if len(ends) else 0, dtype=bool)
    is_end[ends - 1] = True
    found = np.full(len(is_end), end, dtype=np.int64)
    found[~is_end] = codes[kept]
    return words, found, np.r_[0, ends[:-1]].astype(np.int64)


def token_counts(rows: DataFrame) -> DataFrame:
    """``word`` and ``c`` over all texts of ``rows`` (``__text``), the end among them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, summed = [], 0, 0

        for batch in batches:
            for _, texts in slices(batch.column(0)):
                words, tokens, _ = _tokens_of(texts)
                held.append(pa.table({"word": words.cast(pa.binary()), "c": np.bincount(tokens, minlength=len(words))}))
                rows += len(words)
                # Summed again when they have doubled.
                if rows >= max(COUNT_WORDS, 2 * summed):
                    held = [_summed_counts(held)]
                    rows = summed = len(held[0])
                if summed >= COUNT_WORDS:
                    yield from held[0].to_batches()
                    held, rows, summed = [], 0, 0
        if held:
            yield from _summed_counts(held).to_batches()

    return rows.select("__text").mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _summed_counts(parts: list[pa.Table]) -> pa.Table:
    """The counts of each word over all parts."""
    found = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("c", "sum")])
    return pa.table({"word": found["word"], "c": found["c_sum"]}).combine_chunks()


@dataclass
class Slots:
    """The second level: slots of words' own, then hashed ones, dealt in turn to their groups.

    A unit is an output of the first level or, from ``outputs`` on, a slot.
    """

    head: int  # outputs of the first level before the groups
    own: int
    hashed: int
    counts: np.ndarray  # of the slots

    def __post_init__(self) -> None:
        self.own_groups, self.hashed_groups = (math.isqrt(max(n - 1, 0)) + (n > 0) for n in (self.own, self.hashed))
        self.groups = self.own_groups + self.hashed_groups
        self.outputs = self.head + self.groups

    def group(self, slot: np.ndarray) -> np.ndarray:
        return np.where(slot < self.own, slot % max(1, self.own_groups), self.own_groups + (slot - self.own) % max(1, self.hashed_groups))

    def members(self, group: int) -> slice:
        return slice(group, self.own, self.own_groups) if group < self.own_groups else slice(self.own + group - self.own_groups, None, self.hashed_groups)

    @cached_property
    def first(self) -> np.ndarray:
        """Of each unit, the output of the first level."""
        return np.r_[np.arange(self.outputs), self.head + self.group(np.arange(len(self.counts)))]

    def first_level(self, units: np.ndarray) -> np.ndarray:
        return self.first.take(units)


@dataclass
class Vocabulary:
    """The part of the counts that is broadcast, and the totals."""

    classes: dict[bytes, int]  # units
    heavy: dict[bytes, int]  # counts
    class_counts: np.ndarray
    slots: Slots
    tokens: int
    types: int
    unseen: float  # part of the hashed slots' probability
    unseen_types: float = 1.0  # among which it is shared

    def unit(self, word: bytes) -> int:
        at = self.classes.get(word)
        return self.slots.outputs + self.slots.own + crc32(word) % self.slots.hashed if at is None else at

    def units_of(self, words: pa.Array) -> np.ndarray:
        found = _values_of(words, *self._classes, -1)
        missing = np.flatnonzero(found < 0)
        hashed = np.fromiter(map(crc32, words.take(pa.array(missing)).to_numpy(zero_copy_only=False)), np.int64, len(missing))
        found[missing] = self.slots.outputs + self.slots.own + hashed % self.slots.hashed
        return found

    def counts_of(self, words: pa.Array) -> np.ndarray:
        """The counts of those that are broadcast; of others -1."""
        return _values_of(words, *self._heavy, -1)

    @cached_property
    def _classes(self) -> tuple[pa.Array, np.ndarray]:
        return pa.array(self.classes, pa.binary()), np.array([*self.classes.values()], dtype=np.int64)

    @cached_property
    def _heavy(self) -> tuple[pa.Array, np.ndarray]:
        return pa.array(self.heavy, pa.binary()), np.array([*self.heavy.values()], dtype=np.int64)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.types + 1))

    def shares(self, c: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        """log10 of a word's part of hashed slots that were counted ``n`` times (all: None), from its count (0: unseen)."""
        n = self.slots.counts[self.slots.own :].sum() if n is None else n
        return np.log10(np.where(c > 0, (1 - self.unseen) * c / n, self.unseen / self.unseen_types))


def _values_of(words: pa.Array, keys: pa.Array, values: np.ndarray, other: int) -> np.ndarray:
    """The value of each word's key, ``other`` where there is none."""
    at = pc.fill_null(pc.index_in(words, keys.cast(words.type)), len(keys)).to_numpy(zero_copy_only=False)
    return np.r_[values, other].take(at)


def vocabulary(counts: DataFrame, classes: int = CLASSES, heavy: int | None = None) -> Vocabulary:
    totals = counts.agg(F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    tokens, types, once, twice = (x or 0 for x in totals)
    own, hashed = max(LEAST_OWN, OWN * math.isqrt(tokens)), max(1, HASHED * math.isqrt(tokens))
    heavy = max(HEAVY, classes + own) if heavy is None else heavy
    # The lowest of some 2000 classes of counts above which there are at most ``heavy`` words.
    rank = F.floor(F.log("c") * 32).alias("rank")
    cutoff, held = None, 0
    for r in sorted(counts.groupBy(rank).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        held += r.n
        if held > heavy:
            break
        cutoff = r["rank"]
    top = counts.where((rank >= cutoff if cutoff is not None else F.lit(False)) | (F.length("word") == 0)).collect()
    top.sort(key=lambda r: (-r.c, bytes(r.word)))
    of = {bytes(r.word): r.c for r in top}
    ranked = [w for w in of if w != END]
    head, named = [END, *ranked[: classes - 1]], [w for w in ranked[classes - 1 :][:own] if of[w] >= OWN_COUNT]
    # All words by hashed slots, less those that are named.
    rest = np.zeros(hashed, dtype=float)
    for at, n in counts.groupBy((F.crc32("word") % hashed).alias("at")).agg(F.sum("c")).collect():
        rest[at] = n
    for w in [*head, *named]:
        rest[crc32(w) % hashed] -= of.get(w, 0)
    rest = np.maximum(rest, 0)
    slots = Slots(len(head), len(named), hashed, np.r_[[of[w] for w in named], rest].astype(float))
    units = {w: i for i, w in enumerate(head)} | {w: slots.outputs + i for i, w in enumerate(named)}
    groups = np.bincount(slots.group(np.arange(len(slots.counts))), weights=slots.counts, minlength=slots.groups)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    freed = discount * max(0, types - sum(w in of for w in units))
    unseen = freed / rest.sum() if freed and rest.any() else 1 / (rest.sum() + 1)
    # Chao's lower bound of the types that a sample lacks, in the form that allows for no type seen twice, and at
    # least so many that none has more of the hashed slots than a word that was seen once.
    lacking = max(1.0, once * (once - 1) / (2 * (twice + 1)), unseen * rest.sum() / (1 - unseen) if rest.any() else 0.0)
    return Vocabulary(units, of, np.r_[[of.get(w, 0) for w in head], groups].astype(float), slots, tokens, types, float(unseen), lacking)


@dataclass
class LogBilinear:
    context: np.ndarray  # (units + 1) x dim; the last is the start of a text
    output: np.ndarray  # outputs of the first level x dim
    position: np.ndarray  # CONTEXT x dim
    bias: np.ndarray
    inner: np.ndarray  # slots x dim
    inner_bias: np.ndarray
    slots: Slots
    squares: dict = field(default_factory=dict)  # sums of squared gradients

    NAMES = ("context", "output", "position", "bias", "inner", "inner_bias")

    @classmethod
    def start(cls, counts: np.ndarray, dim: int = DIM, seed: int = 7, slots: Slots | None = None) -> LogBilinear:
        """With small vectors and log shares as biases: close to the unigram model."""
        slots = slots or Slots(len(counts), 0, 0, np.zeros(0))
        rng, n, m = np.random.default_rng(seed), len(counts), len(slots.counts)
        context, output, inner = (rng.normal(0, 0.1, (k, dim)).astype(np.float32) for k in (n + m + 1, n, m))
        bias = np.log((counts + 1) / (counts.sum() + n)).astype(np.float32)
        return cls(context, output, np.ones((CONTEXT, dim), np.float32), bias, inner, np.log(slot_noise(slots)).astype(np.float32), slots)

    def params(self) -> np.ndarray:
        return np.concatenate([getattr(self, x).ravel() for x in self.NAMES])

    def with_params(self, flat: np.ndarray) -> LogBilinear:
        parts, at = [], 0
        for x in (getattr(self, name) for name in self.NAMES):
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return LogBilinear(*parts, self.slots)

    def learn(self, units: np.ndarray, contexts: np.ndarray, noise: np.ndarray, rng: np.random.Generator, rate: float, inner_noise: np.ndarray | None = None) -> None:
        """One Adagrad step of noise-contrastive estimation; the noise samples are shared by the batch or its group."""
        targets = self.slots.first_level(units) if self.slots.groups else units
        # In order of their outputs, so those of an output or a group lie together. Short numbers are sorted by their digits.
        order = np.argsort(targets.astype(np.uint16) if len(self.output) <= 1 << 16 else targets, kind="stable")
        units, targets, contexts = units[order], targets[order], [np.ascontiguousarray(contexts[order, i]) for i in range(CONTEXT)]
        sampled = np.searchsorted(np.cumsum(noise), rng.random(NOISE)).clip(max=len(noise) - 1)
        bias = self.bias - np.log(NOISE * noise).astype(np.float32)
        before = [self.context.take(at, axis=0) for at in contexts]
        hidden = before[0] * self.position[0]
        for i in range(1, CONTEXT):
            hidden += before[i] * self.position[i]
        outputs, noises = self.output.take(targets, axis=0), self.output.take(sampled, axis=0)
        d_own = _lacking(np.einsum("ij,ij->i", hidden, outputs) + bias[targets], 1)
        d_hidden = outputs
        d_hidden *= d_own[:, None]
        across, ones = np.ascontiguousarray(noises.T), np.ones(ROWS, np.float32)
        d_noises, d_noise_bias, odds = np.zeros_like(noises), np.zeros(NOISE), np.empty((ROWS, NOISE), np.float32)
        for at in range(0, len(units), ROWS):
            some, to = hidden[at : at + ROWS], d_hidden[at : at + ROWS]
            d_other = np.matmul(some, across, out=odds[: len(some)])
            d_other += bias[sampled]
            _lacking(d_other, -1)
            to += d_other @ noises
            d_noises += d_other.T @ some
            d_noise_bias += ones[: len(some)] @ d_other
        # The first level is small, so all of it takes the step.
        every, firsts = np.arange(len(self.output)), np.flatnonzero(np.diff(targets, prepend=-1))
        d_output = np.zeros_like(self.output)
        d_output[targets[firsts]] = np.add.reduceat(hidden * d_own[:, None], firsts, axis=0)
        np.add.at(d_output, sampled, d_noises)
        steps = [("output", every, d_output), ("bias", every, np.bincount(targets, d_own, len(every)) + np.bincount(sampled, d_noise_bias, len(every)))]
        begin = int(np.searchsorted(targets, self.slots.head))
        if inner_noise is not None and begin < len(units):
            steps += self._learn_slots(units[begin:] - self.slots.outputs, targets[begin:] - self.slots.head, hidden[begin:], d_hidden[begin:], inner_noise, rng)
        at, where = _numbered(np.concatenate(contexts), len(self.context))
        d_context = None
        for i in range(CONTEXT):
            d_context = _add_rows(d_hidden * self.position[i], where[i * len(units) : (i + 1) * len(units)], len(at), d_context)
        steps.append(("context", at, d_context))
        steps.append(("position", np.arange(CONTEXT), np.stack([np.einsum("ij,ij->j", d_hidden, x) for x in before])))
        for name, at, gradient in steps:
            step, param = gradient.astype(np.float32, copy=False), getattr(self, name)
            step /= len(units)
            if name not in self.squares:
                self.squares[name] = np.full(param.shape, 1e-6, np.float32)
            squares = self.squares[name].take(at, axis=0)
            squares += step * step
            self.squares[name][at] = squares
            step *= rate
            step /= np.sqrt(squares, out=squares)
            step += param.take(at, axis=0)
            param[at] = step

    def _learn_slots(self, slot: np.ndarray, group: np.ndarray, hidden: np.ndarray, d_hidden: np.ndarray, noise: np.ndarray, rng: np.random.Generator) -> list[tuple]:
        """Steps of the second level; adds to ``d_hidden``. Tokens come in order of groups and are laid out in rows of ``SHARED`` at most."""
        slots = self.slots
        firsts = np.flatnonzero(np.diff(group, prepend=-1))
        groups, sizes = group[firsts], np.diff(firsts, append=len(group))
        rows = -(-sizes // SHARED)
        column = np.arange(len(group)) - np.repeat(firsts, sizes)
        row = np.repeat(np.cumsum(rows) - rows, sizes) + column // SHARED
        groups, column = np.repeat(groups, rows), column % SHARED
        sizes = np.bincount(row)
        cells = row * sizes.max() + column
        at = np.searchsorted(noise, groups[:, None] + np.sort(rng.random((len(groups), SLOT_NOISE)), axis=1)).clip(max=len(noise) - 1)
        sampled = slots.order[np.clip(at, slots.starts[groups][:, None], slots.starts[groups + 1][:, None] - 1)]
        laid = np.zeros((len(groups), sizes.max(), hidden.shape[1]), np.float32)
        laid.reshape(-1, hidden.shape[1])[cells] = hidden
        vectors, inner = self.inner.take(sampled, axis=0), self.inner.take(slot, axis=0)
        bias = self.inner_bias - slots.log_noise
        d_own = _lacking(np.einsum("ij,ij->i", hidden, inner) + bias.take(slot), 1)
        d_other = laid @ vectors.transpose(0, 2, 1)
        d_other += bias.take(sampled)[:, None]
        d_other = _lacking(d_other, -1)
        d_other[np.arange(sizes.max()) >= sizes[:, None]] = 0
        inner *= d_own[:, None]
        inner += (d_other @ vectors).reshape(-1, hidden.shape[1]).take(cells, axis=0)
        d_hidden += inner
        d_vectors = (d_other.transpose(0, 2, 1) @ laid).reshape(-1, hidden.shape[1])
        found, where = _numbered(np.r_[slot, sampled.ravel()], len(slots.counts))
        d_inner = _add_rows(d_vectors, where[len(slot) :], len(found), _add_rows(hidden * d_own[:, None], where[: len(slot)], len(found)))
        return [("inner", found, d_inner), ("inner_bias", found, np.bincount(where, np.r_[d_own, d_other.sum(axis=1).ravel()], len(found)))]

    def log10_classes(self, units: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities."""
        return self.log10_units(units, contexts)[0]

    def log10_units(self, units: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Normalised log10 probabilities of the units and of all hashed slots together."""
        slots = self.slots
        # Each position's distinct units, their parts of the contexts' vectors, and the place of each context's unit among them.
        numbered = [_numbered(contexts[:, i], len(self.context)) for i in range(CONTEXT)]
        parts = [self.context.take(found, axis=0) * self.position[i] for i, (found, _) in enumerate(numbered)]
        places = [where for _, where in numbered]
        own, hashed = self._first_level(slots.first_level(units) if slots.groups else units, parts, places)
        inside = np.flatnonzero(units >= slots.outputs)
        slot = units[inside] - slots.outputs
        group = slots.first_level(units[inside]) - slots.head
        order = np.argsort(group.astype(np.uint16) if slots.groups <= 1 << 16 else group, kind="stable")
        inside, slot, group = inside[order], slot[order], group[order]
        more, bounds = np.empty(len(inside)), [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(group)]
        for start, end in itertools.pairwise(bounds):
            members = slots.members(int(group[start]))
            vectors, bias = np.ascontiguousarray(self.inner[members]), self.inner_bias[members]
            for at in range(start, end, ROWS):
                s = slice(at, min(at + ROWS, end))
                hidden = _row_sums(parts, [where.take(inside[s]) for where in places])
                more[s] = np.einsum("ij,ij->i", hidden, self.inner.take(slot[s], axis=0))
                more[s] -= _log_sums(hidden, vectors, bias)[:, 0]
        own[inside] += more + self.inner_bias[slot]
        return own / np.log(10), hashed / np.log(10)

    def _first_level(self, targets: np.ndarray, parts: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of the targets and of all hashed slots together.

        A logit is the sum of a part of each unit before and the bias, so its exponential is the product of theirs:
        exponentials are taken of the distinct units, not of every context.
        """
        slots, first_hashed = self.slots, self.slots.head + self.slots.own_groups
        longest = np.sqrt(np.einsum("ij,ij->i", self.output, self.output).max())
        reach = np.full(len(targets), np.abs(self.bias).max())
        for part, where in zip(parts, places, strict=True):
            reach += (np.sqrt(np.einsum("ij,ij->i", part, part)) * longest).take(where)
        # All outputs, and those of hashed slots.
        sums = np.zeros((len(targets), 2), np.float32)
        width = max(32, TABLE // max(1, *map(len, parts)))
        with np.errstate(over="ignore", invalid="ignore"):
            for at in range(0, len(self.output), width):
                outputs = slice(at, at + width)
                columns = np.ones((len(self.output[outputs]), 2), np.float32)
                columns[: max(0, first_hashed - at), 1] = 0
                tables = [_exponentials(part, self.output[outputs], None if i else self.bias[outputs]) for i, part in enumerate(parts)]
                for row in range(0, len(targets), ROWS):
                    s = slice(row, row + ROWS)
                    product = tables[0].take(places[0][s], axis=0)
                    for table, where in zip(tables[1:], places[1:], strict=True):
                        product *= table.take(where[s], axis=0)
                    sums[s] += product @ columns
        # Exponentials that floats may not hold: the largest logit is taken off first.
        far = ~(reach < LARGE)
        own, hashed = np.empty(len(targets)), np.empty(len(targets))
        columns = np.ones((len(self.output), 2), np.float32)
        columns[:first_hashed, 1] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            for row in range(0, len(targets), ROWS):
                s = slice(row, row + ROWS)
                hidden, logs = _row_sums(parts, [where[s] for where in places]), np.log(sums[s], dtype=np.float64)
                if far[s].any():
                    logs[far[s]] = _log_sums(hidden[far[s]], self.output, self.bias, columns)
                own[s] = np.einsum("ij,ij->i", hidden, self.output.take(targets[s], axis=0)) + self.bias[targets[s]] - logs[:, 0]
                hashed[s] = logs[:, 1] - logs[:, 0]
        return own, hashed


def _row_sums(parts: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
    """The sum of one row of each part."""
    found = parts[0].take(places[0], axis=0)
    for part, where in zip(parts[1:], places[1:], strict=True):
        found += part.take(where, axis=0)
    return found


def _exponentials(rows: np.ndarray, outputs: np.ndarray, bias: np.ndarray | None) -> np.ndarray:
    """Of the products of rows and outputs, plus a bias of the outputs."""
    found, vectors = np.empty((len(rows), len(outputs)), np.float32), np.ascontiguousarray(outputs.T)
    for at in range(0, len(rows), ROWS):
        some = np.matmul(rows[at : at + ROWS], vectors, out=found[at : at + ROWS])
        if bias is not None:
            some += bias
        np.exp(some, out=some)
    return found


def slot_noise(slots: Slots) -> np.ndarray:
    """Each slot's part of its group by counts."""
    if not slots.groups:
        return np.zeros(0)
    group, weights = slots.group(np.arange(len(slots.counts))), slots.counts + 1
    return weights / np.bincount(group, weights=weights)[group]


def noise_table(slots: Slots) -> np.ndarray:
    """For each group its number plus the running sums of its slots' parts; ``slots`` gets their order and log noise."""
    group, part = slots.group(np.arange(len(slots.counts))), slot_noise(slots)
    slots.order = np.argsort(group, kind="stable")
    slots.starts = np.searchsorted(group[slots.order], np.arange(slots.groups + 1))
    slots.log_noise = np.log(SLOT_NOISE * part).astype(np.float32)
    sums = np.cumsum(part[slots.order])
    return sums - np.repeat(np.r_[0, sums[slots.starts[1:-1] - 1]], np.diff(slots.starts)) + group[slots.order]


def _log_sums(hidden: np.ndarray, vectors: np.ndarray, bias: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """Logs of the sums of exponentials of each row's logits, a column for each of ``sums``, weights of the outputs (none: 1)."""
    sums = np.ones((len(vectors), 1), np.float32) if sums is None else sums
    # No logit is beyond this, so most need no largest one taken off.
    bound = np.sqrt(np.einsum("ij,ij->i", hidden, hidden).max() * np.einsum("ij,ij->i", vectors, vectors).max()) + np.abs(bias).max()
    logits = hidden @ vectors.T
    if bound < LARGE:
        return np.log(np.exp(logits, out=logits) @ (sums * np.exp(bias)[:, None]))
    logits += bias
    top = logits.max(axis=1)
    logits -= top[:, None]
    return np.log(np.exp(logits, out=logits) @ sums) + top[:, None]


def _lacking(odds: np.ndarray, sign: int) -> np.ndarray:
    """What the log odds of data (sign 1) or noise (-1) lack. Overwrites them."""
    if sign < 0:
        np.negative(odds, out=odds)
    # An exponential that no float holds leaves nothing lacking.
    with np.errstate(over="ignore"):
        np.exp(odds, out=odds)
    odds += 1
    return np.divide(sign, odds, out=odds)


def _numbered(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers (below ``n``) in order, and the place of each among them."""
    there = np.zeros(n, dtype=bool)
    there[at] = True
    found, places = np.flatnonzero(there), np.empty(n, dtype=np.int64)
    places[found] = np.arange(len(found))
    return found, places.take(at)


def _add_rows(values: np.ndarray, where: np.ndarray, n: int, sums: np.ndarray | None = None) -> np.ndarray:
    """The sums of the rows at each of ``n`` places, added to ``sums`` if they are given."""
    width = values.shape[1]
    if sums is None:
        sums = np.zeros((n, width), values.dtype)
    # Two floats are added at once, as one complex number.
    pairs = np.complex64 if values.dtype == np.float32 and width % 2 == 0 else values.dtype
    to, values = sums.view(pairs), np.ascontiguousarray(values).view(pairs)
    np.add.at(to.reshape(-1), (where[:, None] * to.shape[1] + np.arange(to.shape[1])).ravel(), values.ravel())
    return sums


def contexts_of(units: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """The units before each token of its text; ``start`` before the tokens at ``first``, where the texts begin."""
    found = np.full((len(units), CONTEXT), start, dtype=np.int64)
    for i in range(CONTEXT):
        found[i + 1 :, i] = units[: len(units) - i - 1]
        # A text shorter than i + 1 tokens ends at the beginning of another, whose tokens are before themselves as little.
        for at in (first + j for j in range(i + 1)):
            found[at[at < len(units)], i] = start
    return found


def train(rows: DataFrame, vocab: Vocabulary, dim: int = DIM, rate: float = 0.1, seed: int = 7) -> LogBilinear:
    """One pass over all texts of ``rows``, in each partition for itself, then the weighted mean.

    Input splits are put together to ``WAVES`` partitions a core. Their parameters are cut into pieces and added up
    piece by piece, first for some partitions each; the driver gets one sum of each piece.
    """
    model = LogBilinear.start(vocab.class_counts, dim, seed, vocab.slots)
    context = rows.sparkSession.sparkContext
    sent = context.broadcast((model, vocab))
    splits = WAVES * context.defaultParallelism
    lanes = math.isqrt(splits)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, vocab = sent.value
        own, rng = start.with_params(start.params()), np.random.default_rng(seed)
        noise = vocab.class_counts + 1
        noise, seen, held, waiting = noise / noise.sum(), 0, [], 0
        inner_noise = noise_table(own.slots)

        def step(targets: np.ndarray, contexts: np.ndarray) -> None:
            own.learn(targets, contexts, noise, rng, rate, inner_noise)

        for batch in batches:
            for _, texts in slices(batch.column(0)):
                words, tokens, first = _tokens_of(texts)
                units = vocab.units_of(words)[tokens]
                held.append((units, contexts_of(units, first, len(own.context) - 1)))
                waiting += len(units)
                if waiting >= 16 * BATCH:
                    seen, waiting = _drain(held, step, seen), 0
        seen = _drain(held, step, seen)
        if seen:
            flat = own.params()
            pieces = [(i, flat[at : at + PIECE], seen) for i, at in enumerate(range(0, len(flat), PIECE))]
            for at in range(0, len(pieces), 256):
                yield _weighted(pieces[at : at + 256], TaskContext.get().partitionId() % lanes)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, _, params, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = sums.setdefault(piece, [0.0, 0])
                total[0], total[1] = total[0] + np.frombuffer(params, dtype=np.float32).astype(np.float64) * weight, total[1] + weight
        if sums:
            yield _weighted([(piece, (total / n).astype(np.float32), n) for piece, (total, n) in sums.items()])

    schema = "piece int, lane int, params binary, n long"
    parts = rows.select("__text").coalesce(splits).mapInArrow(fitted, schema)
    means = parts.repartition("piece", "lane").mapInArrow(added, schema).repartition("piece").mapInArrow(added, schema).collect()
    if not means:
        return model
    return model.with_params(np.concatenate([np.frombuffer(r.params, dtype=np.float32) for r in sorted(means, key=lambda r: r.piece)]))


def _weighted(pieces: list[tuple[int, np.ndarray, int]], lane: int = 0) -> pa.RecordBatch:
    piece, params, n = zip(*pieces, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array([lane] * len(piece), pa.int32()), pa.array([x.tobytes() for x in params], pa.binary()), pa.array(n, pa.int64())], names=["piece", "lane", "params", "n"])


def _drain(held: list, step, seen: int) -> int:
    """Train on the tokens held back, in batches."""
    if held:
        targets, contexts = np.concatenate([c for c, _ in held]), np.concatenate([c for _, c in held])
        for at in range(0, len(targets), BATCH):
            step(targets[at : at + BATCH], contexts[at : at + BATCH])
        seen += len(targets)
        held.clear()
    return seen


def _score_rows(rows: DataFrame, vocab: Vocabulary, model: LogBilinear) -> DataFrame:
    """A row with sums for each text (``word`` null), and one for each of its words that is not broadcast."""
    sent = rows.sparkSession.sparkContext.broadcast((model, vocab))
    id_type, held_type = (rows.schema[c].dataType.simpleString() for c in ("__id", "__held"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocab = sent.value
        for batch in batches:
            for at, texts in slices(batch.column(3)):
                yield from _score_slice(batch.slice(at, len(texts)), texts, model, vocab)

    numbered = rows.select(F.monotonically_increasing_id().alias("__row"), "__id", "__held", "__text")
    schema = f"__row long, __id {id_type}, __held {held_type}, word binary, n long, n_known long, base double, lm double, unseen double"
    return numbered.mapInArrow(scored, schema)


def _score_slice(batch: pa.RecordBatch, texts: pa.Array, model: LogBilinear, vocab: Vocabulary) -> Iterator[pa.RecordBatch]:
    """``batch``: number, id and fold of each text."""
    names = ["__row", "__id", "__held", "word", "n", "n_known", "base", "lm", "unseen"]
    slots = vocab.slots
    words, tokens, first = _tokens_of(texts)
    units = vocab.units_of(words)[tokens]
    lm, hashed = model.log10_units(units, contexts_of(units, first, len(model.context) - 1))
    counts = vocab.counts_of(words)[tokens]
    # Of a hashed word that is not broadcast, all but its count, which the join brings.
    shared = units >= slots.outputs + slots.own
    slot_counts = np.maximum(slots.counts[units[shared] - slots.outputs], 1)
    lm[shared] += vocab.shares(np.maximum(counts[shared], 1), slot_counts)
    unseen = hashed + vocab.shares(np.zeros(1))[0]
    known = counts > 0
    rare = shared & (counts < 0)
    base = np.where(known, vocab.base(np.maximum(counts, 0)), 0.0)
    # The end is on the first level even where no training text has taught its count.
    base[(counts < 0) & ~shared] = vocab.base(np.zeros(1))[0]
    sums = [np.add.reduceat(x, first) for x in (np.ones(len(known), np.int64), known.astype(np.int64), base, np.where(rare, 0.0, lm))]
    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.nulls(len(texts), pa.binary()), *map(pa.array, sums), pa.nulls(len(texts), pa.float64())], names=names)
    rare = np.flatnonzero(rare)
    if rare.size:
        # One row for each text and word.
        of = np.searchsorted(first, rare, side="right") - 1
        pairs, where = np.unique(of * len(words) + tokens[rare], return_inverse=True)
        n, seen_lm, unseen_lm = (np.bincount(where, weights=w) for w in (None, lm[rare], unseen[rare]))
        word = words.cast(pa.binary()).take(pa.array(pairs % len(words)))
        none = [pa.nulls(len(pairs), batch.column(c).type) for c in (1, 2)]
        arrays = [batch.column(0).take(pa.array(pairs // len(words))), *none, word, pa.array(n), pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.float64())]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(seen_lm), pa.array(unseen_lm)], names=names)


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, heavy: int | None = None) -> DataFrame:
    """Learn from the rows where ``held_out`` is false and score all.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.
    """
    named = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), held_out.alias("__held"))
    learned = named.where(~F.col("__held"))
    counts = materialize(token_counts(learned), "token-counts")
    vocab = vocabulary(counts, classes, heavy)
    model = train(learned, vocab)
    found = materialize(_score_rows(named, vocab, model), "token-scores")
    c = F.coalesce("c", F.lit(0))
    rare = found.where("word is not null").join(counts, "word", "left")
    rare = rare.select(
        "__row",
        "__id",
        "__held",
        F.lit(0).cast("long").alias("n_tokens"),
        F.when(c > 0, F.col("n")).otherwise(0).alias("n_known"),
        (F.col("n") * F.log10((c + 1) / F.lit(vocab.tokens + vocab.types + 1))).alias("base"),
        F.when(c > 0, F.col("lm") + F.col("n") * F.log10(c)).otherwise(F.col("unseen")).alias("lm"),
    )
    whole = found.where("word is null").select("__row", "__id", "__held", F.col("n").alias("n_tokens"), "n_known", "base", "lm")
    # Only the row of a whole text has its id and fold.
    firsts = [F.max(x).alias(x) for x in ("__id", "__held")]
    sums = whole.unionByName(rare).groupBy("__row").agg(*firsts, *(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "lm")))
    return sums.select(
        F.col("__id").alias(id_col),
        F.col("__held").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("lm").alias("score"),
    )
