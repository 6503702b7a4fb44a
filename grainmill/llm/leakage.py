"""Evaluation texts inside training documents: CGK embedding, bit-sampling LSH over item-sized windows, exact check.

Each test item is cut into windows of `window` words (its whole text, if it has fewer). The CGK random walk reads a window
word by word and either stays or steps on, by a random bit of the step and the word it stands on; windows a few edits apart
give outputs a few places apart, equal windows equal outputs. Keys made of some output places, over several walks, find
windows within `edits` edits with the wanted recall, and equal windows always: walks are added, for each length of window,
until a simulation of such edits finds the wanted share. What collides is checked by its edit distance. Documents' windows
that can't be within so many edits of any item needn't walk: those that share too few neighbouring word pairs with the
items (q-gram lemma), or no run of words as long as the one that so many edits must leave intact.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import words

_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<![^<>]*>")
_FORMAT = regex.compile(r"\p{Cf}+")
_U = np.uint64


@dataclass(frozen=True)
class Leaks:
    window: int = 12
    edits: int = 2
    #: Share of windows to be found at the most edits their length allows. README has measured figures.
    recall: float = 0.98
    #: Walks at least, and walks at most that the target may ask for.
    walks: int = 8
    most_walks: int = 32
    samples: int = 6
    places: int = 5
    seed: int = 5
    #: Items, and characters of them, whose index is broadcast at a time; more are taken in blocks, one pass over the
    #: documents each. The characters bound the windows: an item of any length is whole in one block.
    block: int = 20_000
    block_characters: int = 8_000_000


def plain_words(text: str | None) -> list[str]:
    """Words after mark-up tags are dropped, character references resolved, compatibility forms unified and invisible
    format characters removed."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    return words(text)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) + _U(salt & 0xFFFFFFFFFFFFFFFF)) * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def cgk(symbols: np.ndarray, starts: np.ndarray, length: int, bits: np.ndarray, steps: int) -> np.ndarray:
    """Outputs (len(starts), steps) of the walk over symbols[start:start + length], 0 once it is past the end.

    bits[s]: the random bits of symbol s, one for each step.
    """
    out = np.zeros((len(starts), steps), np.int32)
    at = np.zeros(len(starts), np.int64)
    for j in range(steps):
        inside = at < length
        now = np.where(inside, symbols[np.minimum(starts + at, len(symbols) - 1)], 0)
        out[:, j] = now
        at += ((bits[now] >> _U(j)) & _U(1)).astype(np.int64) & inside
    return out


def edit_distance(one: np.ndarray, two: np.ndarray, most: int) -> np.ndarray:
    """Row by row Levenshtein distance of two arrays of equal shape, `most + 1` where it is larger than `most`."""
    return _banded(np.ascontiguousarray(one.T), np.ascontiguousarray(two.T), most)


def _banded(one: np.ndarray, two: np.ndarray, most: int) -> np.ndarray:
    """edit_distance() of columns. Only the band of the table that a distance up to `most` can touch is filled, a whole place
    of all columns at a time."""
    m, n = one.shape
    far = np.full(n, most + 1, np.int8)
    before = [np.full(n, min(j, most + 1), np.int8) for j in range(m + 1)]
    for i in range(m):
        now = [far] * (m + 1)
        now[0] = np.full(n, min(i + 1, most + 1), np.int8)
        for j in range(max(0, i - most), min(m, i + most + 1)):
            step = np.minimum(now[j], before[j + 1])
            step += 1
            now[j + 1] = np.minimum(step, before[j] + (one[i] != two[j]).view(np.int8))
        before = now
    return np.minimum(before[m], most + 1).astype(np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which for numbers is many times faster than hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class _Keys:
    """Rows by their key: a table of bits that most absent keys fail, then distinct keys with the rows of each."""

    def __init__(self, key: np.ndarray) -> None:
        self.rows = np.argsort(key, kind="stable")
        ordered = key[self.rows]
        self.first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        self.known, self.count = ordered[self.first], np.diff(np.append(self.first, len(key)))
        self.shift = _U(64 - max(10, min(22, int(len(key)).bit_length() + 5)))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[(self.known >> self.shift).astype(np.int64)] = True

    def __call__(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `key`, row) of all that are equal."""
        maybe = np.flatnonzero(self.bits[(key >> self.shift).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, key[maybe]), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == key[maybe])
        at, many = at[hit], self.count[at[hit]]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(maybe[hit], many), self.rows[np.repeat(self.first[at], many) + inside]


def edited(windows: np.ndarray, edits: int, kind: str, symbols: int, rng: np.random.Generator) -> np.ndarray:
    """Windows after edits at random places: words replaced by unknown or by known ones, or words out and as many in."""
    out, n = windows.copy(), windows.shape[1]
    for r in out:
        if kind == "moved":
            w = np.delete(r, rng.choice(n, edits // 2, replace=False))
            r[:] = np.insert(w, rng.integers(len(w) + 1, size=edits // 2), 1)
        else:
            r[rng.choice(n, edits, replace=False)] = rng.integers(2, symbols, edits) if kind == "known" else 1
    return out


def bags(columns: Iterable[np.ndarray]) -> np.ndarray:
    """The words of windows, given word by word, as sets of 64 bits."""
    return np.bitwise_or.reduce([_U(1) << (_mix(c, 79) >> _U(58)) for c in columns])


class ItemIndex:
    """Windows of a block of items by their keys. Words no item has are symbol 1, places past the end symbol 0."""

    def __init__(self, items: list[tuple[int, str]], p: Leaks) -> None:
        self.p = p
        self.symbol: dict[str, int] = {}
        texts = [(i, [self.symbol.setdefault(w, len(self.symbol) + 2) for w in plain_words(t)]) for i, t in items]
        holders: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for i, s in texts:
            size = min(p.window, len(s))
            for k in range(len(s) - size + 1 if size else 0):
                holders[size][tuple(s[k : k + size])].add(i)
        n = len(self.symbol) + 2
        rng = np.random.Generator(np.random.PCG64(p.seed))
        self.bits = [_mix(np.arange(n), int(rng.integers(1 << 62))) for _ in range(p.most_walks)]
        self.lengths = {}
        for size, windows in sorted(holders.items()):
            grid = np.array(list(windows), np.int32).reshape(-1, size)
            steps = min(3 * size, 63)
            # places in the first two thirds of the walk: later ones are mostly past the end
            draws = [[np.sort(rng.choice(max(1, 2 * steps // 3), min(p.places, 2 * steps // 3), replace=False)) for _ in range(p.samples)] for _ in range(p.most_walks)]
            draws = draws[: self.walks_for(size, draws)]
            keys = [_Keys(key) for key in self.keys(self.bits, grid.ravel(), np.arange(len(grid)) * size, size, draws)]
            members = [np.array(sorted(x), np.int64) for x in windows.values()]
            pair_table, run_table = np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
            if size > 1:
                pair_table[self.pair_cell(grid[:, :-1].ravel(), grid[:, 1:].ravel())] = True
            run = self.intact(size)
            run_table[self.run_cells(grid.ravel(), run)[(np.arange(len(grid)) * size)[:, None] + np.arange(size - run + 1)].ravel()] = True
            columns = np.ascontiguousarray(grid.T)
            self.lengths[size] = (grid, draws, keys, members, (pair_table, run_table, columns, bags(columns)))

    def allowed(self, size: int) -> int:
        return min(self.p.edits, (size - 1) // 4)

    def intact(self, size: int) -> int:
        """Words in a row that the allowed edits must leave: size - edits words at least remain, in edits + 1 runs at most."""
        edits = self.allowed(size)
        return -(-(size - edits) // (edits + 1))

    def walks_for(self, size: int, draws) -> int:
        """Walks until windows of random words are found with the wanted recall after the most edits, of whatever kind."""
        edits = self.allowed(size)
        if not edits:
            return min(self.p.walks, self.p.most_walks)
        rng, trials = np.random.Generator(np.random.PCG64(self.p.seed + size)), 1000
        symbols = trials * size + 2
        bits = [_mix(np.arange(symbols), int(rng.integers(1 << 62))) for _ in draws]
        windows = np.arange(2, symbols, dtype=np.int32).reshape(trials, size)
        starts = np.arange(trials) * size
        kinds = ["unknown", "known", *["moved"] * (edits > 1)]
        changed = [edited(windows, edits, k, symbols, rng) for k in kinds]
        found = np.zeros((len(kinds), trials), bool)
        for w in range(len(draws)):
            keys = [list(self.keys(bits[w : w + 1], x.ravel(), starts, size, draws[w : w + 1])) for x in (windows, *changed)]
            for k in range(len(kinds)):
                found[k] |= np.any([one == two for one, two in zip(keys[0], keys[k + 1])], axis=0)
            if w + 1 >= self.p.walks and found.mean(1).min() >= self.p.recall:
                return w + 1
        return len(draws)

    @staticmethod
    def pair_cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (_mix((a.astype(np.uint64) << _U(32)) | b.astype(np.uint64), 77) >> _U(44)).astype(np.int64)

    @staticmethod
    def run_cells(symbols: np.ndarray, run: int) -> np.ndarray:
        """A cell for each run of so many symbols, by its start."""
        n = len(symbols) - run + 1
        key = np.zeros(max(n, 0), np.uint64)
        for k in range(run if n > 0 else 0):
            key = _mix(key ^ symbols[k : k + n].astype(np.uint64), 78)
        return (key >> _U(44)).astype(np.int64)

    @staticmethod
    def keys(walks, symbols: np.ndarray, starts: np.ndarray, size: int, draws) -> Iterator[np.ndarray]:
        """One key array for each sample of each walk."""
        for bits, places in zip(walks, draws):
            out = cgk(symbols, starts, size, bits, 1 + max(int(d[-1]) for d in places))
            for at in places:
                key = np.zeros(len(starts), np.uint64)
                for j in at:
                    key = _mix(key ^ out[:, j].astype(np.uint64), 1 + int(j))
                yield key

    def find(self, symbols: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position, item, edits) in a run of documents' symbols; ends[k]: where the document of position k ends."""
        for size, (grid, draws, keys, members, (pair_table, run_table, columns, bag)) in self.lengths.items():
            if len(symbols) < size:
                continue
            starts = np.arange(len(symbols) - size + 1)
            starts = starts[starts + size <= ends[starts]]
            edits, run = self.allowed(size), self.intact(size)
            if size > 1:
                hit = np.concatenate([[0], np.cumsum(pair_table[self.pair_cell(symbols[:-1], symbols[1:])])])
                starts = starts[hit[starts + size - 1] - hit[starts] >= size - 1 - 2 * edits]
            hit = np.concatenate([[0], np.cumsum(run_table[self.run_cells(symbols, run)])])
            starts = starts[hit[starts + size - run + 1] > hit[starts]]
            for a in range(0, len(starts), 40_000):
                some = starts[a : a + 40_000]
                own = bags(symbols[some + k] for k in range(size))
                pairs, held = [], 0
                for key, lookup in zip(self.keys(self.bits, symbols, some, size, draws), keys):
                    pos, at = lookup(key)
                    if len(pos):
                        pairs.append(pos * np.int64(len(grid)) + at)
                        held += len(pos)
                    if held > 1_000_000:  # most keys of a window name the same items
                        pairs, held = [distinct(np.concatenate(pairs))], 0
                if not pairs:
                    continue
                pos, win = np.divmod(distinct(np.concatenate(pairs)), len(grid))
                # an edit changes two words of a window at most
                near = np.flatnonzero(np.bitwise_count(own[pos] ^ bag[win]) <= 2 * edits)
                pos, win = pos[near], win[near]
                at = some[pos]
                distance = np.full(len(at), size)
                rest = np.arange(len(at))
                for k in range(size):  # what is left is equal word for word
                    rest = rest[symbols[at[rest] + k] == columns[k][win[rest]]]
                distance[rest] = 0
                rest = np.flatnonzero(distance)
                if edits and len(rest):
                    distance[rest] = _banded(np.stack([symbols[at[rest] + k] for k in range(size)]), np.take(columns, win[rest], axis=1), edits)
                ok = np.flatnonzero(distance <= edits)
                if len(ok):
                    lens = np.array([len(members[k]) for k in win[ok]])
                    yield np.repeat(some[pos[ok]], lens), np.concatenate([members[k] for k in win[ok]]), np.repeat(distance[ok], lens)


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        get = index.symbol.get
        for batch in batches:
            docs, sizes, runs = [], [], []
            held = 0

            def flush():
                symbols = np.fromiter((s for r in runs for s in r), np.int32, held)
                bounds = np.cumsum(sizes)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                found: dict[tuple[int, int], list[int]] = {}
                for pos, item, edits in index.find(symbols, bounds[owner]):
                    key = owner[pos] * np.int64(1 << 40)
                    names, place = np.unique(item, return_inverse=True)
                    both, inverse, counts = np.unique(key + place, return_inverse=True, return_counts=True)
                    least = np.full(len(both), 99, np.int64)
                    np.minimum.at(least, inverse, edits)
                    exact = np.bincount(inverse, weights=edits == 0, minlength=len(both)).astype(int)
                    for k, c, e, x in zip(both.tolist(), counts.tolist(), least.tolist(), exact.tolist()):
                        f = found.setdefault((docs[k >> 40], int(names[k & ((1 << 40) - 1)])), [0, 99, 0])
                        f[0], f[1], f[2] = f[0] + c, min(f[1], e), f[2] + x
                if found:
                    columns = [[d for d, _ in found], [i for _, i in found], *[[v[k] for v in found.values()] for k in range(3)]]
                    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "windows", "edits", "exact_windows"])

            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r = [get(w, 1) for w in plain_words(text)]
                if r:
                    docs.append(i)
                    sizes.append(len(r))
                    runs.append(r)
                    held += len(r)
                if held > 1_000_000:
                    if (out := flush()) is not None:
                        yield out
                    docs, sizes, runs, held = [], [], [], 0
            if held and (out := flush()) is not None:
                yield out

    return run


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, p: Leaks = Leaks()) -> DataFrame:
    """(doc_id, item_id, windows, edits, exact_windows) of every document that holds a window of an item within the allowed
    edits: how many of the document's windows match, at how few edits, and how many word for word.

    The items are the query set: they are read in blocks of bounded size, each is indexed, broadcast and held against all
    documents. Null ids and null or wordless texts match nothing; no items give no rows. Short items may differ by fewer
    edits, one in four of their words beyond the first. Documents that are copies give a row each.
    """
    spark = documents.sparkSession
    queries = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    many, length = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, -(-many // p.block), -(-length // p.block_characters))
    rows = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long"), F.col(text))
    found = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).orderBy("i").collect()
        shared = spark.sparkContext.broadcast(ItemIndex([(r.i, r.t) for r in block], p))
        part = rows.mapInArrow(_search(shared), "doc_id long, item_id long, windows long, edits long, exact_windows long")
        found = part if found is None else found.unionByName(part)
    return found
