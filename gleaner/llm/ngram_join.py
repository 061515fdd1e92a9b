"""Jaccard self-join on word shingles by T-occurrence search.

A document is the set of its distinct shingles of five words. Two documents of sizes a and b link at a similarity of 0.75,
that is when they share T = ceil(3 (a + b) / 7) shingles. Documents that link, directly or over others, form a component.

1. Documents with equal sets are one from here on, the one with the smallest id. Of an id's rows with equal sets one goes on.
2. A document with more than a quarter of its shingles to itself can't link. Shingles are dealt into parts, and a part counts
   which of its shingles only one document has. For documents above 96 shingles two fifths of all shingles are looked at, which
   gives a lower bound and so never drops a document that links. Most documents end here.
3. The shingles of the others are counted exactly, and each document's are ordered by the length of their lists, rarest first.
   Step 2's rule is applied once more.
4. T-occurrence search within blocks of documents with equal least hash, for several hashes. A block has an inverted index. For
   each document the L longest of its lists are set aside (DivideSkip); the short ones are merged, and documents that occur
   at least T - L times are probed for the rest by binary search. A pair within one component is not probed again, so a large
   group of near copies costs little more than its tree.
5. The exact completion. Documents that link share one of the floor(n / 4) + 1 rarest shingles of each; those lists are the
   short ones, shorter still for a pair of like sizes. Lists within one component are skipped. For the others, occurrences by pair are merged by the shuffle,
   bounded by what the rest of either set can still add, and the remaining pairs are probed. No link between components
   is missed.

Step 4 only saves work for step 5: links that it doesn't see are found there. Sets are compared by 64-bit hashes of
shingles; a wrong count needs two shingles of one pair of documents with one hash. Sets are equal when they agree in size and in
two sums, over hashes that are built from two independent hashes of the words: 128 bits.

A shingle that very many documents share is never dealt to one task by all of them: step 2 sends two of its documents for
each slice of texts, which is enough to tell that nobody has it alone, and in step 3 the most frequent shingles stand last in
everybody's order without being counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import HOT_SHARE, arrow_batches, maybe_broadcast, spread_lookup
from gleaner.llm.components import components
from gleaner.llm.textbytes import Texts, mix64, slices, words
from gleaner.session import Workspace

WORDS = 5
#: The similarity is NEED / FULL; sets of sizes a and b must share NEED (a + b) / (NEED + FULL).
NEED, FULL = 3, 4
#: Documents of up to COUNT_ALL shingles are judged by all of them in step 2, and up to SHIP_ALL shingles send all: a partner
#: of the former is at most a third larger. The others are judged by, and send, the hashes below LOOKED_AT.
COUNT_ALL, SHIP_ALL, LOOKED_AT = 96, 128, np.uint64(int(0.4 * 2**64))
#: Shingles that a part of steps 2 and 3 should hold.
PART = 2_000_000
#: Counts, one for each set of a part at most, that are added up in one place.
BUCKET = 1_000_000
#: A shingle is hot when more than this share of the sets in step 3 hold it, and more than so many.
HOT_LIST, HOT_LEAST = 0.02, 1000
#: Rows that go to Python at once; whole texts and sets are long.
BATCH_ROWS = 1000
#: A chunk of a block in step 4 ends at so many shingles or documents; of each chunk so many components go on to the next.
CHUNK_SHINGLES, CHUNK_DOCUMENTS, CARRIED = 1_000_000, 2048, 32
#: Documents that a salted part of a hot block should hold.
SALT_ROWS = 1024
#: Weight of the logarithm in DivideSkip's number of long lists.
MU = 0.0085
_FACTORS = mix64(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_SEEDS = mix64(np.arange(11, 15, dtype=np.uint64))


def shingle_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct shingles of each text, ordered by text and hash; a text of fewer words is one shingle."""
    return _shingle_sets(texts)[:2]


def _shingle_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``shingle_sets``, with another hash of each shingle that is built from other hashes of the words."""
    first_hash, second_hash, owner = words(texts)
    hashes, at = _combined(first_hash, owner, len(texts))
    second, _ = _combined(second_hash, owner, len(texts))
    order = np.lexsort((hashes, at))
    hashes, second, at = hashes[order], second[order], at[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (at[1:] != at[:-1])
    return hashes[new], at[new], second[new]


def _combined(word: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle of ``n`` texts, repeats included."""
    count = np.bincount(owner, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    full = np.zeros(0, np.int64)
    if len(word) >= WORDS:
        full = np.flatnonzero(owner[: len(owner) - WORDS + 1] == owner[WORDS - 1 :])
    runs = np.zeros(len(full), np.uint64)
    for k in range(WORDS):
        runs += word[full + k] * _FACTORS[k]
    short = np.flatnonzero((count > 0) & (count < WORDS))
    whole = np.zeros(len(short), np.uint64)
    for k in range(WORDS - 1):
        has = count[short] > k
        whole[has] += word[first[short[has]] + k] * _FACTORS[k]
    return mix64(np.concatenate((runs, whole + count[short].astype(np.uint64)))), np.concatenate((owner[full], short))


def _offsets(owner: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([np.uint64(0)], np.cumsum(values, dtype=np.uint64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _with_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts, digests in zip(slices(batch.column("text")), _digests([batch])):
            yield digests.append_column("text", batch.column("text").slice(texts.first, len(texts)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column("text")):
            hashes, owner, second = _shingle_sets(texts)
            at = _offsets(owner, len(texts))
            sums = [_sums(hashes, at), _sums(mix64(second ^ _SEEDS[0]), at)]
            columns = [batch.column("doc_id").slice(texts.first, len(texts)), pa.array(np.diff(at)), *(pa.array(s.view(np.int64)) for s in sums)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "s1", "s2"])


# A set is named by its id and the sum of its hashes, as an id may stand for several sets.


def _dealt(hashes: np.ndarray, owner: np.ndarray, about: np.ndarray, parts: int) -> pa.RecordBatch:
    """Shingles of some sets by part, a row for each part: the sets (id, name, n, number of shingles here) and the hashes, in bytes."""
    part = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((owner, part))
    hashes, owner, part = hashes[order], owner[order], part[order]
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    sets, shingles = [], []
    for i, j in zip(first, np.append(first[1:], len(part))):
        here, count = np.unique(owner[i:j], return_counts=True)
        sets.append(np.column_stack((about[here], count)).astype(np.int64).tobytes())
        shingles.append(hashes[i:j].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(sets, pa.binary()), pa.array(shingles, pa.binary())], ["part", "sets", "hashes"])


def _places(hashes: np.ndarray) -> np.ndarray:
    """Of each element, how many equal ones stand before it."""
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])) if len(hashes) else np.zeros(0, bool)
    out = np.empty(len(hashes), np.int64)
    out[order] = np.arange(len(hashes)) - np.maximum.accumulate(np.where(new, np.arange(len(hashes)), 0)) if len(hashes) else 0
    return out


def _deal_texts_task(parts: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                hashes, owner = shingle_sets(texts)
                at = _offsets(owner, len(texts))
                n, name = np.diff(at), _sums(hashes, at).view(np.int64)
                sent = np.flatnonzero((n[owner] <= SHIP_ALL) | (hashes < LOOKED_AT))
                # Two documents of this slice show that a shingle is nobody's own. Each document sends one at least, to be heard of.
                first = np.concatenate(([True], owner[sent][1:] != owner[sent][:-1])) if len(sent) else np.zeros(0, bool)
                sent = sent[first | (_places(hashes[sent]) < 2)]
                ids = batch.column("doc_id").slice(texts.first, len(texts)).to_numpy(zero_copy_only=False)
                yield _dealt(hashes[sent], owner[sent], np.column_stack((ids, name, n)), parts)

    return deal


def _frequent_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles that a noticeable share of a batch's sets hold, with how many."""
    for batch in batches:
        values, at = _lists(batch.column("shingles"))
        shingle, times = np.unique(values[at[0] : at[-1]], return_counts=True)
        often = times >= max(2, batch.num_rows * HOT_LIST / 2)
        yield pa.RecordBatch.from_arrays([pa.array(shingle[often].view(np.int64)), pa.array(times[often].astype(np.int64))], ["shingle", "n"])


def _hot_shingles(sets: DataFrame, total: int) -> np.ndarray:
    """Shingles that about a share HOT_LIST of all sets hold, or more: at most a set's mean size over that share. In order.

    They only stand last in the order of shingles, so that none that is missed or too many changes a result.
    """
    found = sets.select("shingles").mapInArrow(_frequent_task, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    table = found.where(F.col("n") > max(HOT_LEAST, total * HOT_LIST)).select("shingle").toArrow()
    return np.sort(np.array(table.column("shingle").to_pylist(), np.int64).view(np.uint64))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which ``values`` stand in ``ordered``."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values if len(ordered) else np.zeros(len(values), bool)


def _deal_sets_task(parts: int, hot: np.ndarray):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = _lists(batch.column("shingles"))
            ids, names = (batch.column(c).to_numpy() for c in ("doc_id", "name"))
            about = np.column_stack((ids, names, np.diff(at)))
            values, owner = values[at[0] : at[-1]], np.repeat(np.arange(len(at) - 1), np.diff(at))
            cold = ~_among(values, hot)
            yield _dealt(values[cold], owner[cold], about, parts)

    return deal


def _hot_pieces_task(hot: np.ndarray):
    """The hot shingles of each set, as a piece like those of the parts, behind all shingles that are counted."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = _lists(batch.column("shingles"))
            rows = []
            for i, (doc_id, name) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("name").to_pylist())):
                own = values[at[i] : at[i + 1]]
                if len(own := own[_among(own, hot)]):
                    rows.append((doc_id, name, own.tobytes(), np.full(len(own), np.iinfo(np.int32).max, np.int32).tobytes()))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "name", "hashes", "lengths"])

    return pieces


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all values, offsets) of a column of hashes."""
    return column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()


def _part(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sets, hashes, set of each hash, number of sets with the hash) of a part."""
    sets = np.concatenate([np.frombuffer(b.as_buffer(), np.int64).reshape(-1, 4) for b in table.column("sets")])
    hashes = np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("hashes")])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sets[:, 3])
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    length = np.diff(np.append(new, len(hashes))).astype(np.int32)
    counts = np.empty(len(hashes), np.int32)
    counts[order] = np.repeat(length, length)
    return sets, hashes, owner, counts


def _own_task(buckets: int):
    def own_shingles(table: pa.Table) -> pa.Table:
        """How many of the shingles that a set is judged by no other set of the part has, as bytes of (id, name, n, own) by bucket of sets."""
        sets, hashes, owner, counts = _part(table)
        judged = (counts == 1) & ((sets[owner, 2] <= COUNT_ALL) | (hashes < LOOKED_AT))
        rows = np.column_stack((sets[:, :3], np.bincount(owner[judged], minlength=len(sets))))
        bucket = np.ascontiguousarray(sets[:, 1]).view(np.uint64) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        at, first = np.unique(bucket[order], return_index=True)
        blobs = [r.tobytes() for r in np.split(rows[order], first[1:])]
        return pa.table({"bucket": at.astype(np.int64), "rows": pa.array(blobs, pa.binary())})

    return own_shingles


def _list_lengths(table: pa.Table) -> pa.Table:
    """The sets of a part with the lengths of their shingles' lists, in bytes as the hashes are."""
    sets, hashes, _, counts = _part(table)
    at = np.concatenate(([0], np.cumsum(sets[:, 3])))
    blobs = [[x[i:j].tobytes() for i, j in zip(at[:-1], at[1:])] for x in (hashes, counts)]
    return pa.table({"doc_id": sets[:, 0].copy(), "name": sets[:, 1].copy(), "hashes": pa.array(blobs[0], pa.binary()), "lengths": pa.array(blobs[1], pa.binary())})


def _able(table: pa.Table) -> pa.Table:
    """The ids of a bucket's sets that have at most a quarter of their shingles to themselves, as far as looked at."""
    rows = np.concatenate([np.frombuffer(b.as_buffer(), np.int64).reshape(-1, 4) for b in table.column("rows")])
    sets, place = np.unique(rows[:, :3], axis=0, return_inverse=True)
    own = np.bincount(place.ravel(), rows[:, 3], len(sets))
    return pa.table({"doc_id": np.unique(sets[own * FULL <= sets[:, 2] * (FULL - NEED), 0])})


def _rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document the size, the shingles of its own, and its floor(n / 4) + 1 rarest shingles that others have, with their places."""
    for batch in batches:
        out = []
        for doc_id, pieces in zip(batch.column("doc_id").to_pylist(), batch.column("pieces").to_pylist()):
            hashes = np.concatenate([np.frombuffer(p["hashes"], np.uint64) for p in pieces])
            lengths = np.concatenate([np.frombuffer(p["lengths"], np.int32) for p in pieces])
            order = np.lexsort((hashes, lengths))[: len(hashes) // FULL + 1]
            shared = np.flatnonzero(lengths[order] > 1)
            out.append((doc_id, len(hashes), int(np.count_nonzero(lengths == 1)), shared.tolist(), hashes[order][shared].view(np.int64).tolist()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["doc_id", "n", "own", "at", "shingle"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column("text")):
            hashes, owner = shingle_sets(texts)
            at = _offsets(owner, len(texts))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
            least = []
            for seed in _SEEDS:
                mixed = np.append(mix64(hashes ^ seed), np.uint64(0))
                low = np.minimum.reduceat(mixed, np.minimum(at[:-1], len(mixed) - 1)) if len(at) > 1 else mixed[:0]
                least.append(low.view(np.int64))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(_SEEDS)), pa.array(np.column_stack(least).ravel()))
            name = pa.array(_sums(hashes, at).view(np.int64))
            columns = [batch.column("doc_id").slice(texts.first, len(texts)), name, pa.array(np.diff(at)), lists, keys]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "name", "n", "shingles", "keys"])


def required(a: int, b: int) -> int:
    """Shingles that sets of these sizes must share."""
    return -(-NEED * (a + b) // (NEED + FULL))


class Block:
    """Documents with an inverted index; ``links`` connects those of one component, each child with its component's least id.

    Documents are ordered by size. A document searches those before it: the others of its size or smaller.
    """

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        self.ids, self.sets = [ids[i] for i in order], [sets[i] for i in order]
        self.sizes = np.array([len(s) for s in self.sets])
        self.root = list(range(len(ids)))
        self.children: list[tuple[int, int]] = []
        every = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(ids)), self.sizes)
        by_shingle = np.argsort(every, kind="stable")
        self.entries = owner[by_shingle]  # the lists, one after the other, each by document
        new = np.ones(len(every), bool)
        new[1:] = every[by_shingle][1:] != every[by_shingle][:-1]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(every)), 0))
        self.begin, self.place = np.empty(len(every), np.int64), np.empty(len(every), np.int64)
        self.begin[by_shingle], self.place[by_shingle] = begin, np.arange(len(every))
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        child, parent = (a, b) if self.ids[a] > self.ids[b] else (b, a)
        self.root[child] = parent
        self.children.append((self.ids[child], self.ids[parent]))

    def search(self, x: int) -> Iterator[tuple[int, int]]:
        """(candidate, shared) of documents before ``x`` of another component that reach the required overlap."""
        span = slice(self.first[x], self.first[x + 1])
        begin, length = self.begin[span], self.place[span] - self.begin[span]
        least = -(-NEED * int(self.sizes[x]) // FULL)
        if np.count_nonzero(length) < least:
            return
        low = int(np.searchsorted(self.sizes, least))
        by_length = np.argsort(-length, kind="stable")
        long = min(least - 1, int(least / (MU * math.log2(max(int(length.max()), 2)) + 1)))
        short = by_length[long:]
        short = short[length[short] > 0]
        runs = length[short]
        at = np.repeat(begin[short] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
        merged = np.sort(self.entries[at], kind="stable")  # a merge of sorted runs
        merged = merged[np.searchsorted(merged, low) :]
        if not len(merged):
            return
        new = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        found, times = merged[new], np.diff(np.append(new, len(merged)))
        need = -(-NEED * (self.sizes[found] + self.sizes[x]) // (NEED + FULL))
        enough = times + long >= need
        found, times, need = found[enough], times[enough], need[enough]
        probes = self.sets[x][np.sort(by_length[:long])]
        for i in np.argsort(-times, kind="stable"):
            y = int(found[i])
            if self.find(y) == self.find(x):
                continue
            own = self.sets[y]
            hits = np.searchsorted(own, probes)
            shared = int(times[i]) + int(np.count_nonzero(own[np.minimum(hits, len(own) - 1)] == probes))
            if shared >= need[i]:
                yield y, shared

    def join(self) -> list[tuple[int, int]]:
        for x in range(1, len(self.ids)):
            for y, _ in self.search(x):
                self.link(x, y)
        return self.children

    def leaders(self, most: int) -> list[int]:
        """The least documents of the largest components."""
        count: dict[int, int] = {}
        for i in range(len(self.ids)):
            count[r] = count.get(r := self.find(i), 0) + 1
        return sorted(count, key=lambda r: (-count[r], self.ids[r]))[:most]


def _block_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the documents of each block of a partition that is sorted by block, in chunks of bounded size."""
    key, ids, sets, held = None, [], [], 0

    def close(more: bool):
        """Join what is held; with more of the block to come, hold its leaders."""
        nonlocal ids, sets, held
        links, kept = [], ([], [])
        if len(ids) > 1:
            block = Block(ids, sets)
            links = block.join()
            if more:
                leaders = block.leaders(CARRIED)
                kept = [block.ids[i] for i in leaders], [block.sets[i] for i in leaders]
        ids, sets, held = *kept, 0
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        values, at = _lists(batch.column("shingles"))
        rows = zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist(), batch.column("doc_id").to_pylist())
        for i, (k, salt, doc_id) in enumerate(rows):
            if (k, salt) != key or held >= CHUNK_SHINGLES or len(ids) >= CHUNK_DOCUMENTS:
                yield close(more=(k, salt) == key)
                key = (k, salt)
            ids.append(doc_id)
            sets.append(values[at[i] : at[i + 1]].copy())
            held += int(at[i + 1] - at[i])
    yield close(more=False)


def _probe_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        (a, a_at), (b, b_at) = _lists(batch.column("left")), _lists(batch.column("right"))
        for i in range(batch.num_rows):
            x, y = a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]]
            hits = np.searchsorted(y, x)
            keep[i] = np.count_nonzero(y[np.minimum(hits, len(y) - 1)] == x) >= required(len(x), len(y))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("u", "v")], ["u", "v"])


def _block_links(sets: DataFrame, total: int) -> DataFrame:
    """Links that connect documents with an equal key in equal place; each set is sent once for each key. A hot block is salted."""
    rows = sets.select("doc_id", "n", "shingles", F.posexplode("keys").alias("round", "key"))
    hot = rows.groupBy("round", "key").agg(F.count("*").alias("rows")).where(F.col("rows") > max(total * HOT_SHARE, SALT_ROWS))
    hot = F.broadcast(hot.select("round", "key", F.ceil(F.col("rows") / SALT_ROWS).alias("salts")))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id", "round"), F.col("salts")), F.lit(0))
    rows = rows.join(hot, ["round", "key"], "left").select(F.xxhash64("round", "key").alias("key"), salt.alias("salt"), "n", "doc_id", "shingles")
    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "doc_id").mapInArrow(_block_task, "u bigint, v bigint")


def _cross_links(sets: DataFrame, rarest: DataFrame, member: DataFrame, work: Workspace) -> DataFrame:
    """All links between documents of different components of ``member`` (node, component); others are their own."""
    own = rarest.join(member.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    each = F.explode(F.arrays_zip("at", "shingle")).alias("e")
    own = own.select("doc_id", "n", F.coalesce("component", "doc_id").alias("c"), each)
    entries = work.write(own.select("doc_id", "n", "c", "e.at", "e.shingle"), "entries")
    mixed = entries.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("shingle")
    lists = work.write(entries.join(mixed, "shingle", "left_semi"), "lists")
    # The smaller set of a pair has its first common shingle within its first seventh, or it can't have enough of them: most of
    # what a frequent passage would bring together never meets.
    a = lists.where(F.col("at") * (NEED + FULL) <= F.col("n") * (FULL - NEED)).toDF(*[f"a_{c}" if c != "shingle" else c for c in lists.columns])
    b = lists.toDF(*[f"b_{c}" if c != "shingle" else c for c in lists.columns])
    smaller = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_doc_id") < F.col("b_doc_id")))
    # A pair's first common shingle leaves enough shingles in either set: its own prefixes are shorter the closer the sizes are.
    enough = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) * (NEED + FULL) >= (F.col("a_n") + F.col("b_n")) * NEED
    met = a.join(b, "shingle").where((F.col("a_c") != F.col("b_c")) & smaller & (F.col("a_n") * FULL >= F.col("b_n") * NEED) & enough)
    pairs = met.groupBy("a_doc_id", "b_doc_id").agg(
        F.count("*").alias("times"), F.max("a_at").alias("a_at"), F.max("b_at").alias("b_at"), F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n")
    )
    bound = F.col("times") + F.least(F.col("a_n") - F.col("a_at") - 1, F.col("b_n") - F.col("b_at") - 1)
    pairs = pairs.where(bound * (NEED + FULL) >= (F.col("a_n") + F.col("b_n")) * NEED).select(F.col("a_doc_id").alias("u"), F.col("b_doc_id").alias("v"))
    pairs = maybe_broadcast(work.write(pairs, "pairs"))
    left = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("left")), "u")
    both = left.join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("right")), "v")
    return both.select("u", "v", "left", "right").mapInArrow(_probe_task, "u bigint, v bigint")


def _ids_of_two_sets(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of an id that stands for several sets to the documents that represent them; none where ids are unique."""
    several = known.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high")
    found = known.join(several.select("doc_id"), "doc_id", "left_semi").join(classes, "key")
    return found.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()


def _one_row_of_each_set(rows: DataFrame, known: DataFrame, work: Workspace) -> DataFrame:
    """``rows`` (doc_id, text) with one row for each id and set. Only rows of ids that ``known`` (doc_id, key) has more than once are compared."""
    repeated = known.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    repeated = maybe_broadcast(work.write(repeated, "repeated"))
    if not repeated.take(1):
        return rows
    several = rows.join(repeated, "doc_id", "left_semi").mapInArrow(_with_digests, "doc_id bigint, n bigint, s1 bigint, s2 bigint, text string")
    several = several.where("n > 0").groupBy("doc_id", "n", "s1", "s2").agg(F.first("text").alias("text"))
    several = work.write(several.select("doc_id", "text"), "several")
    return rows.join(repeated, "doc_id", "left_anti").unionByName(several)


def shingle_components(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id that can be reached by links, the document's own included. A null or empty text, or
    one of blanks, has no shingles and links with nothing. Rows with one doc_id are one document: they share a component. A null
    id takes no part, and its component is null. An empty table gives an empty result; other columns are not read.
    """
    with arrow_batches(documents.sparkSession, BATCH_ROWS):
        return _shingle_components(documents)


def _shingle_components(documents: DataFrame) -> DataFrame:
    work = Workspace(documents.sparkSession, "ngram-join")
    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    base = work.write(rows.mapInArrow(_digests, "doc_id bigint, n bigint, s1 bigint, s2 bigint"), "digests")
    base = base.withColumn("key", F.struct("n", "s1", "s2"))
    classes = base.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    classes = work.write(classes, "classes")
    totals = classes.agg(F.count("*").alias("n"), F.coalesce(F.sum("key.n"), F.lit(0)).alias("shingles")).first()

    reps = maybe_broadcast(work.write(classes.select(F.col("rep").alias("doc_id")).distinct(), "reps"))
    known = base.where("n > 0 and doc_id is not null").select("doc_id", "key", "n")
    joined = _one_row_of_each_set(rows.join(reps, "doc_id", "left_semi"), known.join(reps, "doc_id", "left_semi"), work)
    parts = max(1, math.ceil(totals.shingles / PART))
    dealt = joined.mapInArrow(_deal_texts_task(parts), "part bigint, sets binary, hashes binary")
    buckets = max(1, math.ceil(min(totals.n * parts, totals.shingles) / BUCKET))
    own = dealt.groupBy("part").applyInArrow(_own_task(buckets), "bucket bigint, rows binary")
    able = own.groupBy("bucket").applyInArrow(_able, "doc_id bigint").distinct()
    able = maybe_broadcast(work.write(able, "able"))
    sets = joined.join(able, "doc_id", "left_semi").mapInArrow(_sets, "doc_id bigint, name bigint, n bigint, shingles array<bigint>, keys array<bigint>")
    sets = work.write(sets.where("n > 0"), "sets")

    parts = max(1, math.ceil((sets.agg(F.sum("n")).first()[0] or 0) / PART))
    hot, schema = _hot_shingles(sets, totals.n), "doc_id bigint, name bigint, hashes binary, lengths binary"
    dealt = sets.select("doc_id", "name", "shingles").mapInArrow(_deal_sets_task(parts, hot), "part bigint, sets binary, hashes binary")
    dealt = dealt.groupBy("part").applyInArrow(_list_lengths, schema)
    if len(hot):
        dealt = dealt.unionByName(sets.select("doc_id", "name", "shingles").mapInArrow(_hot_pieces_task(hot), schema))
    pieces = dealt.groupBy("doc_id", "name").agg(F.collect_list(F.struct("hashes", "lengths")).alias("pieces"))  # of one document
    rarest = pieces.mapInArrow(_rarest, "doc_id bigint, n bigint, own bigint, at array<int>, shingle array<bigint>")
    rarest = work.write(rarest.where(F.col("own") * FULL <= F.col("n") * (FULL - NEED)), "rarest")
    able = maybe_broadcast(work.write(rarest.select("doc_id").distinct(), "still-able"))
    sets = work.write(sets.join(able, "doc_id", "left_semi"), "joined-sets")

    forest = _block_links(sets, totals.n).unionByName(_ids_of_two_sets(known, classes))
    forest = work.write(forest, "forest")
    member = components(forest, work, "blocks")
    cross = work.write(_cross_links(sets, rarest, member, work), "cross")
    if cross.take(1):
        member = components(member.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(forest).unionByName(cross), work, "all")

    named = classes.join(member.withColumnRenamed("node", "rep"), "rep", "left")
    named = work.write(named.select("key", "rows", F.coalesce("component", "rep").alias("component_id")), "named")
    linked = spread_lookup(known, named, "key", "rows", base.count()).select("doc_id", "n", "component_id")
    rest = base.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are the smallest of their component, with the columns they had; null ids all stay."""
    work = Workspace(documents.sparkSession, "one-of-each")
    others = shingle_components(documents).where("doc_id <> component_id").select(F.col("doc_id").alias("other_id")).distinct()
    others = maybe_broadcast(work.write(others, "others"))
    return documents.join(others, documents["doc_id"].cast("bigint") == others["other_id"], "left_anti")
