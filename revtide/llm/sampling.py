"""Distinct sampled segmentations of texts by perturbed A-star search over the piece lattice, and decoding.

A text is cut into words at its spaces; a word with its leading space mark is a lattice whose edges are vocabulary
pieces (and, for a character without a piece of its own, that character's bytes). Backward sums over the lattice give
the probability of each next piece. Sampling k segmentations without replacement is a search for the k largest
Gumbel-perturbed log probabilities: the best one descends from the root, choosing each piece by its probability, and
leaves at each step the other pieces as one subtree, whose largest value is a Gumbel truncated at its parent's. The
largest of all subtrees is opened next. Nothing is scored that isn't opened.

All steps of a slice of texts run as array operations; every random number is a hash of the row's key, the sample, the
word and the step, so a row's samples depend neither on its neighbours nor on how often a task was run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtide.llm.common import text_bytes, text_slices, with_column
from revtide.llm.vocabulary import PIECES, SPACE, Vocabulary, load_vocabulary
from revtide.llm.words import mix

SAMPLE = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("log_prob", T.DoubleType()),
        T.StructField("perturbed", T.DoubleType()),
        T.StructField("inclusion", T.DoubleType()),
        T.StructField("restored", T.BooleanType()),
    ]
)
#: Bytes of text that are searched together, and lattice edges of words that a task remembers.
SLICE, REMEMBERED = 1 << 18, 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class PieceTable:
    """Vocabulary pieces by length and hash of their code points, behind a filter of the hashes of pieces and prefixes."""

    def __init__(self, vocabulary: Vocabulary):
        by_length: dict[int, list[tuple[int, int, float]]] = {}
        self.filter = np.zeros(1 << 20, np.uint8)
        for piece, number in vocabulary.pieces.items():
            value, values = 0, []
            for c in piece:
                value = (value * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
                values.append(value)
            spots = self.spots(np.array(values, np.uint64))
            self.filter[spots[:-1]] |= 1
            self.filter[spots[-1]] |= 2
            by_length.setdefault(len(piece), []).append((value, number, vocabulary.scores[piece]))
        self.longest = max(by_length, default=1)
        self.tables = {}
        for length, rows in by_length.items():
            rows.sort()
            self.tables[length] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows]))
        self.unknown_score = vocabulary.unknown_score
        self.byte_ids = np.array(vocabulary.byte_ids, np.int32)

    @staticmethod
    def spots(values: np.ndarray) -> np.ndarray:
        return (values * _BASE >> np.uint64(44)).astype(np.int64)


@dataclass
class Lattice:
    """Edges of the lattices of all distinct words; a node is a place in a word, its edges stand together."""

    start: np.ndarray  # of each edge: place, length, piece id (-2: bytes), log probability at its node, sum up to it
    length: np.ndarray
    ids: np.ndarray
    log_chance: np.ndarray
    summed: np.ndarray
    edge: np.ndarray  # first edge of each place
    degree: np.ndarray
    rest: np.ndarray  # characters from a place to its word's end
    first: np.ndarray  # first place of each word
    points: np.ndarray

    def choose(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each place, by its probability."""
        edge = self.edge[place].astype(np.int64)
        todo = np.flatnonzero(self.summed[edge] < u)
        while len(todo):
            edge[todo] += 1
            todo = todo[self.summed[edge[todo]] < u[todo]]
        return edge

    def fan(self, place: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of each place side by side and their probabilities, 0 for those marked as used."""
        column = np.arange(int(self.degree[place].max(initial=1)))
        edge = np.minimum(self.edge[place][:, None] + column, len(self.start) - 1)
        free = (column < self.degree[place][:, None]) & ((used[:, None] >> column) & 1 == 0)
        return edge, np.where(free, np.exp(self.log_chance[edge]), 0.0)


def build_lattice(words: list[str], table: PieceTable) -> Lattice:
    """Lattices of words behind a space mark; U+2581 in a word itself is no space: it only goes into bytes."""
    points = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    first = np.concatenate([[0], np.cumsum(lengths)])
    n = len(points)
    rest = np.repeat(first[1:], lengths) - np.arange(n)
    literal = points == ord(SPACE)
    literal[first[:-1]] = False
    coded = np.where(literal, np.uint64(0x110000), points) + np.uint64(1)
    value, at = coded, np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for length in range(1, table.longest + 1):
        if length > 1:
            more = rest[at] >= length
            at = at[more]
            value = value[more] * _BASE + coded[at + length - 1]
        if not len(at):
            break
        sign = table.filter[table.spots(value)]
        maybe = np.flatnonzero(sign & 2)
        if length in table.tables:
            keys, numbers, scores = table.tables[length]
            spot = np.minimum(np.searchsorted(keys, value[maybe]), len(keys) - 1)
            good = keys[spot] == value[maybe]
            hit, spot = maybe[good], spot[good]
            found.append((at[hit], np.full(len(hit), length, np.int32), numbers[spot], scores[spot]))
        else:
            hit = maybe[:0]
        if length == 1:
            lost = np.setdiff1d(at, at[hit], assume_unique=True)
            found.append((lost, np.full(len(lost), 1, np.int32), np.full(len(lost), -2, np.int32), np.full(len(lost), table.unknown_score)))
        longer = (sign & 1) > 0
        at, value = at[longer], value[longer]
    start, length, ids, score = (np.concatenate(f) for f in zip(*found, strict=True))
    order = np.argsort((rest[start] * (n + 1) + start) * (table.longest + 1) + length)  # level by level, from the words' ends
    start, length, ids, score = start[order], length[order], ids[order], score[order]
    begin = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1]]))
    degree = np.diff(np.append(begin, len(start)))
    place = start[begin]
    level = np.searchsorted(rest[place], np.arange(1, int(rest.max()) + 2))
    target = np.where(length == rest[start], n, start + length)
    onward = np.zeros(n + 1)
    log_chance = np.empty(len(start))
    for a, b in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
        if a == b:
            continue
        x, y = int(begin[a]), int(begin[b]) if b < len(begin) else len(start)
        far = score[x:y] + onward[target[x:y]]
        top = np.maximum.reduceat(far, begin[a:b] - x)
        total = top + np.log(np.add.reduceat(np.exp(far - np.repeat(top, degree[a:b])), begin[a:b] - x))
        onward[place[a:b]] = total
        log_chance[x:y] = far - np.repeat(total, degree[a:b])
    summed = np.exp(log_chance)
    for column in range(1, int(degree.max())):
        at = begin[degree > column] + column
        summed[at] += summed[at - 1]
    summed[begin + degree - 1] = 2.0
    edge, degrees = np.empty(n, np.int64), np.empty(n, np.int64)
    edge[place], degrees[place] = begin, degree
    return Lattice(start, length, ids, log_chance, summed, edge, degrees, rest, first, points)


class Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Words:
    """Lattices of the words that a task has met, side by side.

    When there are more than ``REMEMBERED`` edges, those stay that most slices had, up to half as many edges, and no word of one slice only.
    """

    def __init__(self, table: PieceTable):
        self.table = table
        self.numbers = Numbers()
        self.met = np.zeros(0, np.int64)  # slices that had a word
        kinds = dict.fromkeys(("log_chance", "summed"), np.float64) | {"first": np.int64, "length": np.int16, "degree": np.int16}
        self.held = {f: np.zeros(1024, kinds.get(f, np.int32)) for f in Lattice.__dataclass_fields__}
        self.used = dict.fromkeys(self.held, 0)
        self._append("first", np.zeros(1, np.int64))

    def _append(self, name: str, values: np.ndarray) -> None:
        at, to = self.used[name], self.used[name] + len(values)
        if to > len(self.held[name]):
            more = np.empty(2 * to, self.held[name].dtype)
            more[:at] = self.held[name][:at]
            self.held[name] = more
        self.held[name][at:to] = values
        self.used[name] = to

    def _forget(self) -> None:
        old = self._all()
        sizes = np.add.reduceat(old.degree, old.first[:-1], dtype=np.int64)
        order = np.argsort(-self.met, kind="stable")
        keep = np.sort(order[(self.met[order] > 1) & (np.cumsum(sizes[order]) <= REMEMBERED // 2)])
        lengths = (old.first[1:] - old.first[:-1])[keep]
        place = _ranges(old.first[keep], lengths)
        degree = old.degree[place]
        edge = _ranges(old.edge[place], degree)
        kept = {f: getattr(old, f)[edge] for f in ("length", "ids", "log_chance", "summed")} | {f: getattr(old, f)[place] for f in ("rest", "points")}
        kept |= {"degree": degree, "edge": np.cumsum(degree, dtype=np.int64) - degree, "start": np.repeat(np.arange(len(place)), degree), "first": np.concatenate([[0], np.cumsum(lengths)])}
        self.used = dict.fromkeys(self.held, 0)
        for name, values in kept.items():
            self._append(name, values)
        words = list(self.numbers)
        self.numbers = Numbers((words[w], i) for i, w in enumerate(keep.tolist()))
        self.met = self.met[keep] // 2

    def _all(self) -> Lattice:
        return Lattice(**{name: values[: self.used[name]] for name, values in self.held.items()})

    def lattice(self, words: list[str]) -> tuple[Lattice, np.ndarray]:
        """A lattice that has all the words, and their numbers in it."""
        if self.used["start"] > REMEMBERED:
            self._forget()
        known = len(self.numbers)
        own = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if count := len(self.numbers) - known:
            new = list(islice(reversed(self.numbers), count))[::-1]
            more, edges, places = build_lattice(new, self.table), self.used["start"], self.used["edge"]
            for name in ("length", "ids", "log_chance", "summed", "degree", "rest", "points"):
                self._append(name, getattr(more, name))
            self._append("start", more.start + places)
            self._append("edge", more.edge + edges)
            self._append("first", more.first[1:] + places)
            self.met = np.concatenate([self.met, np.zeros(count, np.int64)])
        seen = np.zeros(len(self.met), bool)
        seen[own] = True
        self.met += seen
        return self._all(), own


def _ranges(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers from each ``begin`` on, as many as ``lengths`` says."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return np.repeat(begin - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _uniform(key: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from a key and counters."""
    state = key
    for part in parts:
        state = mix(state + np.asarray(part).astype(np.uint64) * _BASE + np.uint64(1))
    return ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _truncated(location: np.ndarray, u: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """A Gumbel value at ``location`` given that it is at most ``bound``."""
    with np.errstate(all="ignore"):
        return np.where(np.isneginf(location), -np.inf, location - np.logaddexp(location - bound, np.log(-np.log(u))))


@dataclass
class Steps:
    """Steps of one sample of several texts, in order."""

    doc: np.ndarray
    word: np.ndarray  # number of the word in its text
    edge: np.ndarray
    used: np.ndarray  # edges of the place that are taken, as bits
    before: np.ndarray  # log probability of what comes before the step
    other: np.ndarray  # largest value of the edges not taken

    def pick(self, at: np.ndarray) -> Steps:
        return Steps(*(getattr(self, f)[at] for f in self.__dataclass_fields__))

    @staticmethod
    def join(parts: list[Steps]) -> Steps:
        """Steps of all parts; those of a text follow each other in the order of the parts."""
        joined = Steps(*(np.concatenate([getattr(p, f) for p in parts]) for f in Steps.__dataclass_fields__))
        return joined.pick(np.argsort(joined.doc, kind="stable"))


def _descend(lattice: Lattice, doc: np.ndarray, word: np.ndarray, place: np.ndarray, key: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Walk each of the given words from ``place`` to its end: index of the word and edge of all steps in order."""
    index, at, edges = np.arange(len(doc)), place, np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    seed = mix(key[doc] ^ mix(word.astype(np.uint64) + np.uint64(sample << 40)))
    steps = np.zeros(len(doc), np.int64)
    while len(index):
        edges = lattice.choose(at, _uniform(seed[index], at - place[index] + 1))
        found.append((index, edges))
        steps[index] += 1
        more = np.flatnonzero(lattice.length[edges] < lattice.rest[at])
        index, at = index[more], at[more] + lattice.length[edges[more]]
    begin = np.cumsum(steps) - steps
    out = np.empty(int(steps.sum()), np.int64)
    for number, (i, e) in enumerate(found):
        out[begin[i] + number] = e
    return np.repeat(np.arange(len(doc)), steps), out


@dataclass
class Samples:
    """Segmentations of several texts, those of a text side by side in falling order of the perturbed value."""

    doc: np.ndarray
    ids: np.ndarray  # of all samples one after another
    ends: np.ndarray  # where each sample's ids begin, and the last one's end
    log_prob: np.ndarray
    perturbed: np.ndarray
    inclusion: np.ndarray


def sample_segmentations(texts: list[str], keys: np.ndarray, table: PieceTable, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Up to ``k`` distinct segmentations of each text: ids, log probability, perturbed log probability, inclusion."""
    found = draw(texts, keys, Words(table), k)
    out: list[list[tuple[np.ndarray, float, float, float]]] = [[] for _ in texts]
    for i, d in enumerate(found.doc.tolist()):
        out[d].append((found.ids[found.ends[i] : found.ends[i + 1]], *(float(x[i]) for x in (found.log_prob, found.perturbed, found.inclusion))))
    return out


def draw(texts: list[str], keys: np.ndarray, words: Words, k: int) -> Samples:
    """Up to ``k`` distinct segmentations of each text.

    They come in falling order of the perturbed value. Inclusion is the chance that a segmentation of this log
    probability exceeds the value of the sample that came k + 1st (1 if there is none).
    """
    split = [t.split(" ") if t else [] for t in texts]
    size = len(texts)
    counts = np.array([len(x) for x in split], np.int64)
    if not counts.sum():
        return Samples(*(np.zeros(n, kind) for n, kind in ((0, np.int64), (0, np.int32), (1, np.int64), (0, float), (0, float), (0, float))))
    table = words.table
    lattice, kind = words.lattice(list(chain.from_iterable(split)))
    origin = lattice.first[kind]
    doc = np.repeat(np.arange(size), counts)
    begin = np.cumsum(counts) - counts
    word = np.arange(len(doc)) - begin[doc]
    root = -np.log(-np.log(_uniform(keys, np.zeros(len(keys)))))

    def measured(doc: np.ndarray, word: np.ndarray, edge: np.ndarray, used: np.ndarray, turned: np.ndarray, start: np.ndarray, bound: np.ndarray, sample: int) -> Steps:
        """Probabilities and subtree values of new steps; start and bound are per text. ``turned``: steps with several edges used."""
        step = lattice.log_chance[edge]
        place = lattice.start[edge]
        total = np.cumsum(step) - step
        ends = np.searchsorted(doc, np.arange(size))
        offset = start - total[np.minimum(ends, len(total) - 1)]
        before = offset[doc] + total
        free = -np.expm1(np.minimum(step, 0))  # 0 where a place has one edge
        if len(turned):
            free[turned] = lattice.fan(place[turned], used[turned])[1].sum(1)
        with np.errstate(divide="ignore"):
            location = before + np.log(free)
        seed = mix(keys + np.uint64(1_000_003 * (7 + sample)))[doc]
        u = _uniform(seed, (word << 20) + place - origin[begin[doc] + word])
        return Steps(doc, word, edge, used, before, _truncated(location, u, bound[doc]))

    index, edge = _descend(lattice, doc, word, origin, keys, 0)
    bit = 1 << (edge - lattice.edge[lattice.start[edge]])
    paths = [measured(doc[index], word[index], edge, bit, np.zeros(0, np.int64), np.zeros(size), root, 0)]
    value = [np.where(counts > 0, root, -np.inf)]
    for sample in range(1, k + 1):
        # the largest subtree that is left, of each text
        best, source, where = np.full(size, -np.inf), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for number, path in enumerate(paths):
            ends = np.flatnonzero(np.concatenate([[True], path.doc[1:] != path.doc[:-1]])) if len(path.doc) else np.zeros(0, np.int64)
            if len(ends):
                own = path.doc[ends]
                top = np.full(size, -np.inf)
                top[own] = np.maximum.reduceat(path.other, ends)
                hits = np.flatnonzero((path.other == top[path.doc]) & (top > best)[path.doc])
                own, firsts = np.unique(path.doc[hits], return_index=True)
                best[own], source[own], where[own] = top[own], number, hits[firsts]
        value.append(best)
        if sample == k:
            break
        parts = []
        for number, path in enumerate(list(paths)):
            own = np.flatnonzero((source == number) & ~np.isneginf(best))
            if not len(own):
                continue
            at = where[own]
            place = lattice.start[path.edge[at]]
            edges, weights = lattice.fan(place, path.used[at])
            running = np.cumsum(weights, axis=1)
            drawn = _uniform(keys[own], np.full(len(own), 3), np.full(len(own), sample)) * running[:, -1]
            column = (running < drawn[:, None]).sum(1)
            turn = edges[np.arange(len(own)), column]
            path.other[at] = -np.inf  # its subtree now belongs to the new sample
            cut = np.full(size, -1, np.int64)
            cut[own] = at
            head = path.pick(np.flatnonzero(np.arange(len(path.doc)) < cut[path.doc]))
            head.other = np.full(len(head.doc), -np.inf)
            # the rest of the word of the turn, then all later words
            w = path.word[at]
            open_ = np.flatnonzero(lattice.length[turn] < lattice.rest[place])
            later = np.flatnonzero((cut[doc] >= 0) & (word > _spread(own, w, size)[doc]))
            d = np.concatenate([own[open_], doc[later]])
            order = np.argsort(d, kind="stable")
            d = d[order]
            n = np.concatenate([w[open_], word[later]])[order]
            q = np.concatenate([(place + lattice.length[turn])[open_], origin[later]])[order]
            index, edge = _descend(lattice, d, n, q, keys, sample)
            every_doc = np.concatenate([own, d[index]])
            order = np.argsort(every_doc, kind="stable")
            every_edge = np.concatenate([turn, edge])[order]
            every_used = np.concatenate([path.used[at] | 1 << column, 1 << (edge - lattice.edge[lattice.start[edge]])])[order]
            turned = np.flatnonzero(order < len(own))
            start = _spread(own, path.before[at], size, float)
            new = measured(every_doc[order], np.concatenate([w, n[index]])[order], every_edge, every_used, turned, start, best, sample)
            parts.append(Steps.join([head, new]))
        if not parts:
            break
        paths.append(Steps.join(parts))
    bound = value[k] if len(value) > k else np.full(size, -np.inf)
    docs, begins, lengths, scores, values, every = [], [], [], [], [], []
    before = 0
    for number, path in enumerate(paths):
        ids, ends = _piece_ids(lattice, path, table)
        first = np.searchsorted(path.doc, np.arange(size + 1))
        own = np.flatnonzero(np.diff(first))
        last = first[own + 1] - 1
        docs.append(own)
        begins.append(ends[first[own]] + before)
        lengths.append(ends[first[own + 1]] - ends[first[own]])
        scores.append(path.before[last] + lattice.log_chance[path.edge[last]])
        values.append(value[number][own])
        every.append(ids)
        before += len(ids)
    del paths
    doc, begin, length, log_prob, perturbed = (np.concatenate(x) for x in (docs, begins, lengths, scores, values))
    order = np.argsort(doc, kind="stable")
    doc, begin, length, log_prob, perturbed = (x[order] for x in (doc, begin, length, log_prob, perturbed))
    ends = np.concatenate([[0], np.cumsum(length)])
    ids = np.concatenate(every)[np.repeat(begin - ends[:-1], length) + np.arange(int(ends[-1]))]
    with np.errstate(over="ignore"):
        inclusion = np.where(np.isneginf(bound[doc]), 1.0, -np.expm1(-np.exp(log_prob - bound[doc])))
    return Samples(doc, ids, ends, log_prob, perturbed, inclusion)


def _spread(at: np.ndarray, values: np.ndarray, size: int, kind: type = np.int64) -> np.ndarray:
    out = np.zeros(size, kind)
    out[at] = values
    return out


def _piece_ids(lattice: Lattice, path: Steps, table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all steps, characters without a piece as their bytes, and where each step's ids begin."""
    ids = lattice.ids[path.edge]
    lost = np.flatnonzero(ids == -2)
    if not len(lost):
        return ids, np.arange(len(ids) + 1)
    raw = [chr(int(lattice.points[p])).encode("utf-8", "replace") for p in lattice.start[path.edge[lost]].tolist()]
    size = np.ones(len(ids), np.int64)
    size[lost] = [len(r) for r in raw]
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(ends[-1]), np.int32)
    plain = ids != -2
    out[ends[:-1][plain]] = ids[plain]
    place = np.repeat(ends[:-1][lost], size[lost]) + np.arange(int(size[lost].sum())) - np.repeat(np.cumsum(size[lost]) - size[lost], size[lost])
    out[place] = table.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return out, ends


class Decoder:
    """Turns piece ids into the bytes they stand for, by array operations."""

    def __init__(self, vocabulary: Vocabulary):
        raw = [name.replace(SPACE, " ").encode() for name in vocabulary.names]
        for byte, number in enumerate(vocabulary.byte_ids):
            raw[number] = bytes([byte])
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def __call__(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all runs of ids without each one's first (the mark before its first word), and where each begins."""
        size = self.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.raw[np.repeat(self.start[ids] - total[:-1], size) + np.arange(int(total[-1]))]
        keep = np.ones(len(out), bool)
        begin = total[ends[:-1]][np.diff(ends) > 0]
        keep[begin] = False
        cut = np.concatenate([[0], np.cumsum(keep)])
        return out[keep], cut[total[ends]]


def _restored(decoder: Decoder, found: Samples, texts: pa.Array) -> np.ndarray:
    """Whether each sample decodes to its text."""
    got, begin = decoder(found.ids, found.ends)
    raw, offsets = text_bytes(texts)
    same = np.diff(begin) == np.diff(offsets)[found.doc]
    at = np.flatnonzero(same)
    length = np.diff(begin)[at]
    total = np.concatenate([[0], np.cumsum(length)])
    step = np.arange(int(total[-1]))
    differs = got[np.repeat(begin[at] - total[:-1], length) + step] != raw[np.repeat(offsets[found.doc[at]] - total[:-1], length) + step]
    wrong = np.concatenate([[0], np.cumsum(differs)])
    same[at] = wrong[total[1:]] == wrong[total[:-1]]
    return same


@lru_cache(maxsize=1)
def _tools(vocabulary: Vocabulary) -> tuple[PieceTable, Decoder]:
    """Made once for all tasks that a worker runs with the same vocabulary; words are a task's own, so no idle worker holds them."""
    return PieceTable(vocabulary), Decoder(vocabulary)


def row_key(*columns: Column | str) -> Column:
    """The seed of a row's samples."""
    return F.xxhash64(*columns)


def sample_pieces(documents: DataFrame, samples: str = "samples", key_col: str = "key", text_col: str = "text", k: int = 2, vocabulary_path: str = PIECES) -> DataFrame:
    """``documents`` with ``samples``: up to ``k`` different segmentations as ids, log_prob, perturbed, inclusion, and
    restored: whether decoding them gives the text back.

    ``key_col`` is an integer that seeds the row (``row_key``; a null counts as 0): equal keys and texts give equal
    samples. A null or empty text has no samples. A text with fewer than ``k`` segmentations has as many as there
    are. Other columns stay; ``samples`` must be a new name.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    schema = T.StructType([*documents.schema.fields, T.StructField(samples, T.ArrayType(SAMPLE))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, decoder = _tools(shared.value)
        words = Words(table)
        for batch in batches:
            texts, keys = (batch.column(batch.schema.get_field_index(c)) for c in (text_col, key_col))
            for a, b in text_slices(texts, SLICE):
                own = texts.slice(a, b - a).fill_null("")
                seeds = mix(keys.slice(a, b - a).fill_null(0).to_numpy().view(np.uint64))
                found = draw(own.to_pylist(), seeds, words, k)
                ids = pa.ListArray.from_arrays(pa.array(found.ends.astype(np.int32)), pa.array(found.ids.astype(np.int32)))
                columns = [ids, *map(pa.array, (found.log_prob, found.perturbed, found.inclusion, _restored(decoder, found, own)))]
                rows = pa.StructArray.from_arrays(columns, names=[f.name for f in SAMPLE.fields])
                ends = np.searchsorted(found.doc, np.arange(b - a + 1)).astype(np.int32)
                yield with_column(batch.slice(a, b - a), samples, pa.ListArray.from_arrays(pa.array(ends), rows))

    return documents.mapInArrow(scan, schema)


def decode_pieces(rows: DataFrame, text: str = "decoded", ids_col: str = "ids", vocabulary_path: str = PIECES) -> DataFrame:
    """``rows`` with the text that their piece ids stand for; null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(shared.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            got, begin = decode(ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())]))
            texts = [got[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            yield with_column(batch, text, pa.array([t if known else None for t, known in zip(texts, ids.is_valid().to_pylist(), strict=True)], pa.string()))

    return rows.mapInArrow(scan, schema)


def segmentation_report(documents: DataFrame, id_col: str = "doc_id", k: int = 2) -> DataFrame:
    """One row per document and sample: its number, pieces, scores, a digest of its ids, and whether decoding gives the text back.

    A document without text has one row without sample.
    """
    keyed = documents.select(id_col, "text", row_key(F.col(id_col).cast("string")).alias("key"))
    one = sample_pieces(keyed, k=k).select(id_col, F.posexplode_outer("samples").alias("sample", "s")).select(id_col, "sample", "s.*")
    return one.select(
        id_col,
        "sample",
        F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")).alias("n_pieces"),
        "log_prob",
        "perturbed",
        "inclusion",
        F.when(F.col("ids").isNotNull(), F.xxhash64("ids")).alias("ids_hash"),
        "restored",
    )
