"""Benchmark items in documents, up to small edits: CGK embedding, bit-sampling LSH over item-sized windows, exact edit distance.

Texts are sequences of words (runs of letters, digits and underscores, in lower case). A CGK walk reads a window with a
pointer: at each step it puts out the word there and moves on or not as a random bit of (step, word) says, so two
windows a few edits apart put out sequences that agree in most places again and again. Tables keyed by a few sampled
places of a walk find the items a window may be near to; a Sellers alignment decides each.

Only windows near a piece of an item are walked: of d + 1 pieces of an item, d edits leave one as it is.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import keep_rows, tidy

_WORD = re.compile(r"\w+")
UNKNOWN, END = 0, 1
#: Texts searched together: what a task holds grows with their words, and fewer take more time. Results are the same.
SLICE, SMALL_SLICE = 5000, 1000
#: Words of a piece of an item that are looked up at most, and places of texts that are dealt with together.
MOST_GRAM, CHUNK = 4, 1 << 16
FOUND = "doc_id long, item_id long, distance int, item_words int, start_word long"


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def most_edits(n: int, share: float) -> int:
    return int(n * share + 1e-9)


def walks(symbols: np.ndarray, starts: np.ndarray, n: int, steps: int, seed: int) -> np.ndarray:
    """The CGK embedding of the windows of ``n`` symbols at ``starts``: a row of ``steps`` symbols each, END behind a window."""
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(1, 1 << 62, steps, dtype=np.uint64) | np.uint64(1) for _ in range(2))
    out = np.empty((len(starts), steps), np.int32)
    moved = np.zeros(len(starts), np.int64)
    last = len(symbols) - 1
    for t in range(steps):
        here = symbols[np.minimum(starts + moved, last)]
        here = np.where(moved < n, here, END)
        out[:, t] = here
        moved += ((here.astype(np.uint64) * a[t] + b[t]) >> np.uint64(47) & np.uint64(1)).astype(np.int64)
    return out


def _spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans of such sizes, one span after the other."""
    return np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


def _joined(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in keys and in the sorted table that hold the same key."""
    first, last = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
    hit = np.flatnonzero(last > first)
    times = (last - first)[hit]
    return np.repeat(hit, times), _spans(first[hit], times)


def _grams(symbols: np.ndarray, most: int):
    """g and, for each place, the key of the g symbols from there, for g up to ``most``."""
    symbols, key = symbols.astype(np.uint64), np.zeros(len(symbols), np.uint64)
    for g in range(1, min(most, len(symbols)) + 1):
        key = (key[: len(symbols) - g + 1] + symbols[g - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        yield g, key


class Items:
    """The benchmark, ready for search: vocabulary, and for each length the tables of its items' walks.

    ``tables`` are enough that a pair at the most edits allowed is found with ``recall``, by the rate at which places
    agree in edited copies of the items themselves.
    """

    STEPS, WALKS = 1.5, 4

    def __init__(self, items: list[tuple[int, str | None]], share: float, least_words: int, recall: float, seed: int):
        self.share, self.seed = share, seed
        split = [(i, w) for i, t in items if len(w := words(t)) >= least_words]
        self.vocabulary: dict[str, int] = {}
        for _, w in split:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 2)
        self.items = [(i, np.array([self.vocabulary[x] for x in w], np.int32)) for i, w in split]
        self.by_length: dict[int, list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            self.by_length.setdefault(len(w), []).append(k)
        # with few items of a length one place tells enough; with many, more places keep candidates few
        self.sampled = {n: 1 + int(np.log(len(k)) / np.log(256)) for n, k in self.by_length.items()}
        self.tables = {p: self._tables_for(recall, p) for p in set(self.sampled.values())}
        self.index = {n: self._index(n) for n in self.by_length}
        self.own_words = {}
        for n, of in self.by_length.items():
            self.own_words[n] = np.zeros(len(self.vocabulary) + 2, np.uint8)
            self.own_words[n][np.concatenate([self.items[k][1] for k in of])] = 1
        self.pieces = self._pieces()

    def _piece(self, n: int) -> int:
        """Words of a piece of an item of n words that are looked up; 0 if the edits allowed may leave no piece."""
        return min(n // (most_edits(n, self.share) + 1), MOST_GRAM)

    def _pieces(self) -> dict[int, tuple[np.ndarray, np.uint64, np.ndarray, np.ndarray]]:
        """For each g the g words that begin pieces: a table of which leading bits occur, their shift, sorted keys and their items' lengths."""
        keys: dict[int, list[np.ndarray]] = {}
        for n, of in self.by_length.items():
            if g := self._piece(n):
                begins = np.arange(most_edits(n, self.share) + 1) * n // (most_edits(n, self.share) + 1)
                found = [key[begins] for k in of for size, key in _grams(self.items[k][1], g) if size == g]
                unique = np.unique(np.concatenate(found))
                keys.setdefault(g, []).append(np.stack([unique, np.full(len(unique), n, np.uint64)]))
        pieces = {}
        for g, found in keys.items():
            key, lengths = np.concatenate(found, axis=1)
            order = np.argsort(key, kind="stable")
            bits = int(np.clip(np.ceil(np.log2(64 * len(key))), 16, 22))
            shift = np.uint64(64 - bits)
            occurs = np.zeros(1 << bits, bool)
            occurs[key >> shift] = True
            pieces[g] = occurs, shift, key[order], lengths[order].astype(np.int64)
        return pieces

    def _tables_for(self, recall: float, sampled: int) -> int:
        """Tables needed: with p, the chance that all sampled places of one agree at the most edits, 1 - (1 - p) ** tables >= recall."""
        rng = np.random.default_rng(self.seed)
        rates: list[float] = []
        for _, w in [self.items[k] for k in rng.integers(len(self.items), size=64)] if self.items else []:
            d = most_edits(len(w), self.share)
            if d:
                copy = w.copy()
                copy[rng.choice(len(w), d, replace=False)] = UNKNOWN
                steps = int(len(w) * self.STEPS)
                x, y = (walks(v, np.array([0]), len(w), steps, self.seed)[0] for v in (w, copy))
                rates.append((x == y).mean() ** sampled)
        p = max(np.quantile(rates, 0.2), 0.02) if rates else 1.0
        return int(np.clip(np.ceil(np.log(1 - recall) / np.log(1 - min(p, 0.999))), 8, 512))

    def _keys(self, symbols: np.ndarray, starts: np.ndarray, n: int):
        """The key of each window in each table."""
        steps, sampled = max(2, int(n * self.STEPS)), self.sampled[n]
        each = -(-self.tables[sampled] // self.WALKS)
        for walk in range(self.WALKS):
            out = walks(symbols, starts, n, steps, self.seed + walk).astype(np.uint64)
            rng = np.random.default_rng((self.seed, walk, n))
            for table in range(each):
                key = np.full(len(starts), walk * each + table + 1, np.uint64)
                for at in rng.choice(steps, sampled, replace=False):
                    key = (key ^ (out[:, at] + np.uint64(at << 32))) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                yield key

    def _index(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each table the sorted keys of the items of length n, and the items in that order."""
        of = self.by_length[n]
        flat = np.concatenate([self.items[k][1] for k in of])
        tables = []
        for key in self._keys(flat, np.arange(len(of)) * n, n):
            order = np.argsort(key, kind="stable")
            tables.append((key[order], np.array(of)[order]))
        return tables

    def _places(self, symbols: np.ndarray) -> dict[int, np.ndarray]:
        """For each length the places, ascending, at which the text goes on like a piece of an item of that length."""
        places, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(symbols), CHUNK):
            for g, key in _grams(symbols[lo : lo + CHUNK + MOST_GRAM - 1], MOST_GRAM):
                if g in self.pieces:
                    occurs, shift, keys, of = self.pieces[g]
                    maybe = np.flatnonzero(occurs[key[:CHUNK] >> shift])
                    at, spots = _joined(key[maybe], keys)
                    places.append(lo + maybe[at])
                    lengths.append(of[spots])
        place, length = np.concatenate(places), np.concatenate(lengths)
        order = np.argsort(length, kind="stable")  # all pieces of a length have the same g
        found, first = np.unique(length[order], return_index=True)
        return dict(zip(found.tolist(), np.split(place[order], first[1:]), strict=False))

    def _windows(self, symbols: np.ndarray, n: int, places: np.ndarray | None):
        """Starts of windows of n symbols, some at a time: those near a place (all for None) that hold enough words of items of their length."""
        d = most_edits(n, self.share)
        first, last = np.zeros(1, np.int64), np.full(1, len(symbols))
        if places is not None:
            first, last = np.maximum(places - 2 * n - d, 0), np.minimum(places + n + 1, len(symbols))
            new = np.flatnonzero(first[1:] > last[:-1]) + 1
            first, last = first[np.append(0, new)], last[np.append(new - 1, len(last) - 1)]
        # long stretches are cut, short ones taken together
        most = max(CHUNK, n)
        cuts = -(-(last - first) // most)
        first = np.repeat(first, cuts) + _spans(np.zeros(len(cuts), np.int64), cuts) * most
        sizes = np.minimum(np.repeat(last, cuts) - first, most)
        # sums may wrap around: their differences over n words are right in any type that holds n
        kind = np.uint8 if n < 1 << 8 else np.uint16 if n < 1 << 16 else np.int64
        groups = np.cumsum(sizes + n) // (2 * most)
        for lo, hi in zip(*(np.searchsorted(groups, np.unique(groups), side) for side in ("left", "right")), strict=True):
            a, size = first[lo:hi], sizes[lo:hi]
            # the last symbol is END, no item's word: windows that reach beyond it hold nothing there
            read = np.minimum(_spans(a, size + n - 1), len(symbols) - 1)
            known = np.concatenate([np.zeros(1, kind), np.cumsum(self.own_words[n][symbols[read]], dtype=kind)])
            at = _spans(np.cumsum(size + n - 1) - (size + n - 1), size)
            yield _spans(a, size)[known[at + n] - known[at] >= n - d]

    def candidates(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items that share a key in some table: starts and item numbers. ``symbols`` end with END.

        A stretch within d edits of an item holds one of any d + 1 pieces of the item as it is. Windows without one from n
        words before their start to 2 n + d behind it are left out first: no stretch that is aligned because of them can match.
        A window within d edits of an item holds at least n - d of its words, each at most as often as the item does.
        Windows that hold fewer words of all items of their length are left out next, pairs that share fewer
        words last; none loses any.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = []
        places = self._places(symbols)
        for n, tables in self.index.items():
            if n not in places and self._piece(n):
                continue
            for starts in self._windows(symbols, n, places.get(n)):
                for lo in range(0, len(starts), 1 << 16):
                    part = starts[lo : lo + (1 << 16)]
                    for key, (keys, of) in zip(self._keys(symbols, part, n), tables, strict=True):
                        hit, spots = _joined(key, keys)
                        if len(hit):
                            found.append((part[hit], of[spots]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, of = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        pairs = np.unique(starts * len(self.items) + of)
        starts, of = pairs // len(self.items), pairs % len(self.items)
        keep = np.zeros(len(starts), bool)
        for k in np.unique(of).tolist():  # the same filter once more, by the item's own words
            at, item = np.flatnonzero(of == k), self.items[k][1]
            need = len(item) - most_edits(len(item), self.share)
            mine = np.zeros(len(self.vocabulary) + 2, np.uint8)
            mine[item] = 1
            for lo in range(0, len(at), 1 << 14):
                some = at[lo : lo + (1 << 14)]
                window = symbols[np.minimum(starts[some][:, None] + np.arange(len(item)), len(symbols) - 1)]
                enough = mine[window].sum(axis=1, dtype=np.int64) >= need  # words of the item, however often: few windows pass
                some, window = some[enough], window[enough]
                shared = np.zeros(len(some), np.int64)
                for w, times in zip(*np.unique(item, return_counts=True), strict=True):
                    shared += np.minimum((window == w).sum(axis=1), times)
                keep[some] = shared >= need
        return starts[keep], of[keep]


def closest(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text, and the first place at which such a stretch ends (Sellers)."""
    row = np.zeros(len(text) + 1, np.int32)
    steps = np.arange(len(text) + 1, dtype=np.int32)
    for i, w in enumerate(item, 1):
        best = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (text != w)]))
        row = np.minimum.accumulate(best - steps) + steps
    at = int(row.argmin())
    return int(row[at]), at


def _matches(items: Items, texts: list[str | None]):
    """text number, item number, distance, start for each item within its most edits of a text; the first closest place."""
    get = items.vocabulary.get
    symbols = [np.fromiter(map(get, w, repeat(UNKNOWN)), np.int32, len(w)) for w in map(words, texts)]
    lengths = np.array([len(s) for s in symbols], np.int64)
    if not lengths.sum() or not items.items:
        return
    ends = np.cumsum(lengths + 1)
    begins = ends - lengths - 1
    flat = np.concatenate([x for s in symbols for x in (s, [END])]).astype(np.int32)
    starts, of = items.candidates(flat)
    inside = np.searchsorted(ends, starts, "right")
    order = np.lexsort((starts, of, inside))
    starts, of, inside = starts[order], of[order], inside[order]
    new = np.ones(len(starts), bool)
    new[1:] = (of[1:] != of[:-1]) | (inside[1:] != inside[:-1])
    groups = np.append(np.flatnonzero(new), len(starts))
    for lo, hi in zip(groups[:-1], groups[1:], strict=True):
        k, text = int(of[lo]), int(inside[lo])
        item = items.items[k][1]
        n, d = len(item), most_edits(len(item), items.share)
        best = None
        at = lo
        while at < hi:  # places near each other are decided in one alignment
            to = at
            while to + 1 < hi and starts[to + 1] - starts[to] <= n:
                to += 1
            left = max(int(begins[text]), int(starts[at]) - d)
            right = min(int(ends[text]) - 1, int(starts[to]) + n + d)
            distance, stop = closest(item, flat[left:right])
            if distance <= d and (best is None or distance < best[0]):
                best = (distance, max(0, left - int(begins[text]) + stop - n))
            at = to + 1
        if best is not None:
            yield text, k, best[0], best[1]


def _groups(benchmark: DataFrame, share: float, least_words: int, recall: float, seed: int, group_bytes: int):
    """The benchmark as searchable groups of at most ``group_bytes`` of text, so each that is broadcast has a bound."""
    group, held = [], 0
    for row in benchmark.select("item_id", "text").where("item_id is not null").orderBy("item_id", "text").toLocalIterator():
        group.append((row["item_id"], row["text"]))
        held += len(row["text"] or "")
        if held > group_bytes:
            yield Items(group, share, least_words, recall, seed)
            group, held = [], 0
    yield Items(group, share, least_words, recall, seed)


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, least_words: int = 1, recall: float = 0.999, seed: int = 11, group_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, distance, item_words, start_word: a row for each row of ``docs`` and item found in it.

    An item of n words is in a document if some stretch of its words is within floor(n * ``share``) insertions, deletions and
    substitutions of words; distance is the least. Letter case and all that is not a word are ignored. Items of fewer
    than ``least_words`` words, or null, match nothing; null or empty documents hold nothing. All places of all texts are
    searched. An item listed twice, or a row repeated, gives its rows each time; a null item_id matches nothing, a null doc_id stays null.
    Empty tables give no rows. The benchmark goes to the tasks in
    groups of at most ``group_bytes`` of text; with several groups the documents are read once for each.
    """
    found = None
    for items in _groups(benchmark, share, least_words, recall, seed, group_bytes):
        part = _search(docs, items)
        found = part if found is None else found.union(part)
    return found


def _search(docs: DataFrame, items: Items) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches):
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                ids, texts = batch["doc_id"].iloc[lo : lo + SLICE].tolist(), batch["text"].iloc[lo : lo + SLICE].tolist()
                rows = [(ids[t], held.value.items[k][0], d, len(held.value.items[k][1]), s) for t, k, d, s in _matches(held.value, texts)]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "item_words", "start_word"])
                yield out.astype({"doc_id": object, "item_id": "int64", "distance": "int32", "item_words": "int32", "start_word": "int64"})

    # doc_id travels as a string: pandas would turn a long column with nulls into doubles
    found = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(tidy(search), FOUND.replace("doc_id long", "doc_id string"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, least_words: int = 1, recall: float = 0.999, seed: int = 11, group_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item of the benchmark."""
    for items in _groups(benchmark, share, least_words, recall, seed, group_bytes):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def decider(held=held):
            def decide(batch):
                texts = batch.column("text").to_pylist()
                keep = np.ones(len(texts), bool)
                for lo in range(0, len(texts), SMALL_SLICE):
                    for t, *_ in _matches(held.value, texts[lo : lo + SMALL_SLICE]):
                        keep[lo + t] = False
                return keep

            return decide

        docs = keep_rows(docs, decider)
    return docs
