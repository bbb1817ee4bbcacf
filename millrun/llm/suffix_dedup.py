"""Suffix-array dedup (operator 2): bytes covered by a string that an earlier document has too.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id. The suffixes of the whole corpus are dealt out so
that equal strings always meet, and every share is ordered by a difference-cover
suffix sort:

1. Every string has an anchor, its least-hashed run of ``GRAM`` bytes, so equal
   strings have equal anchors. The strings of one anchor are consecutive; the
   bytes that they cover are the anchor's context. An anchor seen in one document
   only can't be part of a match and is left out (a hash may let too many in,
   never too few).
2. Contexts go to the share of their anchor, equal contexts of one pack of
   documents once. The strings of an anchor with over ``HOT_PACKS * HOT_EACH``
   contexts are dealt out by longer anchors instead, and those of one with over
   ``HOTTER`` times as many one by one, so no share grows with a hot passage.
3. A share sorts the suffixes of its different contexts (``dc_order``): sampled
   triples are sorted and named, the names recursed upon until they cover
   ``length`` bytes, and the other suffixes merged in. Neighbours with equal
   prefixes of ``length`` bytes form a class; its smallest id decides. A context
   that no other one agrees with far enough to either side of the anchor has no
   equal string and isn't sorted.

A large corpus takes its shares in rounds, so that only some of the contexts are
on disk at a time.

Matching is exact: contexts and prefixes are compared as bytes. Documents travel
in packs of about ``PACK_BYTES`` bytes (a longer document is a pack of its own).

Defined cases: a null text is empty; a null id counts as larger than any other
and not smaller than another null; rows with the same id don't remove from each
other; texts shorter than ``length`` stay whole; extra columns are kept by
``deduplicated`` and otherwise ignored.
"""

from __future__ import annotations

import gc
import hashlib
import time

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrun.llm.common import parts, ship, written
from millrun.llm.packs import LAST as _LAST
from millrun.llm.packs import pack_rows, packed

#: Bytes of an anchor; bytes and documents of a pack.
GRAM, PACK_BYTES, PACK_DOCS = 16, 4 << 20, 20_000
#: An anchor is hot with more contexts than so many packs with so many each have; with so many times more its strings go one by one.
HOT_PACKS, HOT_EACH, HOTTER = 256, 256, 8
#: Bytes of text for which there is one share, so that a share fits in a task's memory at any size of the corpus.
SHARE_BYTES = 16 << 20
#: Bytes of text for which there is one round, and the most rounds.
ROUND_BYTES, ROUNDS = 128 << 20, 3
#: Bytes of contexts sorted at once; ranks and symbols must stay below 2**21.
SORT_BYTES = 1 << 18
#: Bytes hashed at once, so that the arrays stay in a processor's cache.
HASH_BYTES = 1 << 15
_PLACE = np.uint64((1 << 30) - 1)


# ---- difference-cover suffix sort -------------------------------------------------

def dc_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``text`` (symbols from 1 up), right in the first ``depth`` symbols.

    Suffixes that agree that far are neighbours, in any order."""
    n = len(text)
    if n <= 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), dtype=np.int64)
    t = np.concatenate([text.astype(np.int64), np.zeros(4, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names, named = np.unique(t[sample] << 42 | t[sample + 1] << 21 | t[sample + 2], return_inverse=True)
    if depth <= 3 or len(names) == len(sample):
        by_rank = np.argsort(named)
    else:
        by_rank = dc_order(named + 1, -(-depth // 3))
    rank = np.zeros(n + 4, np.int64)
    rank[sample[by_rank]] = np.arange(1, len(sample) + 1)
    order12 = sample[by_rank]
    order12 = order12[order12 < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(t[zero] << 21 | rank[zero + 1])]
    in_one = order12 % 3 == 1
    o1, o2 = order12[in_one], order12[~in_one]
    before = (np.searchsorted(t[o1] << 21 | rank[o1 + 1], t[zero] << 21 | rank[zero + 1])
              + np.searchsorted(t[o2] << 42 | t[o2 + 1] << 21 | rank[o2 + 2],
                                t[zero] << 42 | t[zero + 1] << 21 | rank[zero + 2]))
    before = np.maximum.accumulate(before)
    out = np.empty(n, np.int64)
    out[before + np.arange(len(zero))] = zero
    at = np.arange(len(order12))
    out[at + np.searchsorted(before, at, side="right")] = order12
    return out


def class_minima(body: np.ndarray, starts: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each string ``body[s:s+length]`` the least ``order`` among equal strings."""
    sa = dc_order(body.astype(np.int64) + 1, length)
    where = np.full(len(body), -1, np.int64)
    where[starts] = np.arange(len(starts))
    ranked = where[sa]
    ranked = ranked[ranked >= 0]  # the strings, in suffix order
    at = starts[ranked]
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    words = np.ndarray((len(body) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    same = np.ones(max(len(at) - 1, 0), dtype=bool)
    for k in [*range(0, length - 7, 8), length - 8]:  # prefixes of neighbours, eight bytes at a time
        w = words[at + k]
        same &= w[1:] == w[:-1]
    first = np.flatnonzero(np.r_[True, ~same])
    least = np.minimum.reduceat(order[ranked], first)
    out = np.empty(len(starts), np.int64)
    out[ranked] = np.repeat(least, np.diff(np.r_[first, len(at)]))
    return out


# ---- packs, anchors and contexts --------------------------------------------------

def _hashed(raw: bytes, at: np.ndarray | None, a: int = 0, b: int = 0, gram: int = GRAM) -> np.ndarray:
    """Hashes of the runs of ``gram`` bytes at the places ``at``, or at all places from ``a`` to ``b``."""
    words = np.ndarray((max(len(raw) - 7, 0),), dtype="<u8", buffer=raw, strides=(1,))
    h = (words[a:b] if at is None else words[at]) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for k in [*range(8, gram - 7, 8), gram - 8]:
        h += words[a + k:b + k] if at is None else words[at + k]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


class Pack:
    """One pack with the anchors of all its strings."""

    def __init__(self, ids: bytes, sizes: bytes, body: bytes, length: int):
        self.ids, self.sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8")
        self.raw, self.length = zstandard.decompress(body), length
        self.ends = np.cumsum(self.sizes)
        n = len(self.raw)
        self.body = np.frombuffer(self.raw, np.uint8)
        room = np.maximum(self.sizes - length + 1, 0)
        first = self.ends - self.sizes
        breaks, anchors = self._runs(n, length)
        at = np.sort(np.concatenate([breaks, first, first + room]))
        at = at[(at < n - length + 1) & np.r_[True, at[1:] != at[:-1]][:len(at)]]
        doc = np.searchsorted(first, at, side="right") - 1
        last = np.r_[at[1:], n - length + 1] if len(at) else at
        use = np.flatnonzero(at < (first + room)[doc])
        self.start, self.end, self.doc = at[use], last[use], doc[use]
        self.anchor = anchors[np.searchsorted(breaks, self.start, side="right") - 1]
        self.hash = _hashed(self.raw, self.anchor)
        #: the different anchor hashes, sorted, and which one each run has
        self.distinct, self.which = np.unique(self.hash, return_inverse=True)

    def _runs(self, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the anchor of the string at a place changes, and the anchors from there on."""
        width = length - GRAM + 1  # runs of GRAM bytes in a string
        breaks, anchors, before = [], [], np.uint64(0)
        for a in range(0, n - length + 1, HASH_BYTES):
            b = min(a + HASH_BYTES, n - length + 1)
            key = _hashed(self.raw, None, a, b + width - 1)
            key &= ~_PLACE
            key |= np.arange(a, b + width - 1, dtype=np.uint64)
            span = 1
            while span < width:
                step = min(span, width - span)
                key = np.minimum(key[:-step], key[step:])
                span += step
            new = np.flatnonzero(key != np.r_[before, key[:-1]])
            if not a and (not len(new) or new[0]):
                new = np.r_[0, new]
            breaks.append(new + a)
            anchors.append((key[new] & _PLACE).astype(np.int64))
            before = key[-1]
        none = np.empty(0, np.int64)
        return np.concatenate([none, *breaks]), np.concatenate([none, *anchors])

    def spread(self) -> np.ndarray:
        """About how many different contexts each distinct anchor has; at most 255. Steers only."""
        edges = np.ndarray((max(len(self.raw) - 7, 0),), dtype="<u8", buffer=self.raw, strides=(1,))
        mark = edges[self.start] * np.uint64(0x9E3779B97F4A7C15) + edges[self.end + (self.length - 9)]
        mark = (mark * np.uint64(0xBF58476D1CE4E5B9) ^ self.hash) * np.uint64(0x94D049BB133111EB)
        by = np.argsort(mark)
        new = by[np.r_[True, mark[by[1:]] != mark[by[:-1]]][:len(by)]]
        return np.minimum(np.bincount(self.which[new], minlength=len(self.distinct)), 255).astype(np.uint8)

    def _narrowed(self, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
        """For hot runs the runs of strings with the same longer anchor: ``(which run, start, end, anchor)``."""
        gram, n = _longer(self.length), len(self.raw)
        strings, width = self.length - GRAM + 1, self.length - gram + 1
        out = []
        for a in range(0, len(s), 4096):
            at = s[a:a + 4096, None] + np.arange(strings + width - 1)
            key = _hashed(self.raw, np.minimum(at, n - gram), gram=gram) & ~np.uint64(255)
            key |= np.arange(strings + width - 1, dtype=np.uint64)
            span = 1
            while span < width:
                step = min(span, width - span)
                key = np.minimum(key[:, :-step], key[:, step:])
                span += step
            size = (e - s)[a:a + 4096, None]
            new = np.c_[np.ones(len(key), bool), key[:, 1:] != key[:, :-1]] & (np.arange(strings) < size)
            run, first = np.nonzero(new)
            last = np.r_[first[1:], 0]
            last = np.where(np.r_[run[1:] != run[:-1], True], size[run, 0], last)
            place = (key[run, first] & np.uint64(255)).astype(np.int64)
            run = run + a
            out.append((run, s[run] + first, s[run] + last, s[run] + place))
        return tuple(np.concatenate(x) for x in zip(*out))

    def contexts(self, flags: np.ndarray, length: int, shares: int, turn: int = 0, rounds: int = 1):
        """Occurrences ``(context, start, end, doc id)`` of the anchors that may match, and the
        different contexts ``(number, text, least doc id, anchor offset or -1, share)``; of one round's shares only.

        A context is numbered by the first of all its occurrences, whatever the round.
        ``flags`` is per distinct anchor: 0 none, 1 in other packs too, 2 hot, 3 hotter."""
        every, which = self.distinct, self.which
        ids = self.ids[self.doc]
        low, high = np.full(len(every), _LAST), np.full(len(every), -1 - _LAST)
        np.minimum.at(low, which, ids)
        np.maximum.at(high, which, ids)
        flag = flags[which]
        use = np.flatnonzero((flag > 0) | (low != high)[which])
        flag, s, e, o = flag[use], self.start[use], self.end[use], ids[use]
        a, h = self.anchor[use] - s, self.hash[use]
        if (flag == 2).any():  # longer anchors
            run, s2, e2, at = self._narrowed(s[flag == 2], e[flag == 2])
            calm, o2 = flag != 2, o[flag == 2][run]
            s, e, o = np.r_[s[calm], s2], np.r_[e[calm], e2], np.r_[o[calm], o2]
            a, h = np.r_[a[calm], at - s2], np.r_[h[calm], _hashed(self.raw, at, gram=_longer(length))]
            flag = np.r_[flag[calm], np.ones(len(s2), flag.dtype)]
        if (flag == 3).any():  # single strings
            n = np.where(flag == 3, e - s, 1)
            back = np.repeat(np.arange(len(flag)), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s, o, h, one = s[back] + step, o[back], h[back], flag[back] == 3
            e, a = np.where(one, s + 1, e[back]), np.where(one, -1, a[back])
            h[one] = _hashed(self.raw, s[one], gram=length)
        share, nth = _share(h, shares), np.arange(len(s))
        if rounds > 1:
            nth = np.flatnonzero(share % rounds == turn)
            s, e, o, a, share = s[nth], e[nth], o[nth], a[nth], share[nth]
        raw, stop = self.raw, e + (length - 1)
        some = [pa.array([raw[x:y] for x, y in zip(s[i:i + 8192].tolist(), stop[i:i + 8192].tolist())], pa.binary())
                for i in range(0, max(len(s), 1), 8192)]
        known = pa.concat_arrays(some).dictionary_encode()
        del some
        own, texts = known.indices.to_numpy(), known.dictionary
        first = np.empty(len(texts), np.int64)
        first[own[::-1]] = np.arange(len(own))[::-1]
        least = np.full(len(texts), _LAST)
        np.minimum.at(least, own, o)
        return own, s, e, o, nth[first], texts, least, a[first], share[first]


def _longer(length: int) -> int:
    """Bytes of a hot run's longer anchors."""
    return (GRAM + length) // 2


def _sorted_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values one after the other, and where each begins and the last ends."""
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], "<i8" if pa.types.is_large_binary(texts.type) else "<i4")
    ends = ends[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8), ends


def _share(hashes: np.ndarray, shares: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(shares)).astype(np.int64)


def _by_share(hashes: np.ndarray, shares: int):
    """The shares that hashes go to, each with the places of its own, in their order; one sort for all shares."""
    share = _share(hashes, shares)
    by = np.argsort(share, kind="stable")
    cut = np.flatnonzero(np.diff(share[by])) + 1
    for at in np.split(by, cut) if len(by) else []:
        yield int(share[at[0]]), at


def _anchors(packs: DataFrame, length: int, shares: int) -> DataFrame:
    """``share, pack, hashes, spread``: the low halves of every pack's different anchors, and about how many contexts they have."""

    def run(batches):
        for batch in batches:
            for row in pack_rows(batch):
                pack = Pack(row["ids"], row["sizes"], row["body"], length)
                h, spread = pack.distinct, pack.spread()
                own = list(_by_share(h, shares))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in own], pa.int32()), pa.array([row["pack"]] * len(own), pa.int64()),
                     pa.array([h[at].astype("<u4").tobytes() for _, at in own], pa.binary()),
                     pa.array([spread[at].tobytes() for _, at in own], pa.binary())], ["share", "pack", "hashes", "spread"])

    return packs.select("pack", "ids", "sizes", "body").mapInArrow(run, "share int, pack long, hashes binary, spread binary")


def _dealt(df: DataFrame, shares: int) -> DataFrame:
    """A task for each share, as many as the bytes need, whatever the setting for shuffles."""
    return df.repartition(max(shares, parts(df.sparkSession)), "share")


def _flags(dealt: DataFrame) -> DataFrame:
    """``pack, share, flags``: per anchor of the pack, in order: 0 alone, 1 shared, 2 hot, 3 hotter."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(b, "<u4") for b in group.column("hashes").to_pylist()]
        every, which, count = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
        spread = np.frombuffer(b"".join(group.column("spread").to_pylist()), np.uint8)
        contexts = np.bincount(which, weights=spread, minlength=len(every))
        hot = HOT_PACKS * HOT_EACH
        flag = (count > 1) * (1 + (contexts > hot).astype(np.uint8) + (contexts > hot * HOTTER))
        out = np.split(flag.astype(np.uint8)[which], np.cumsum([len(b) for b in blobs])[:-1])
        return pa.table({"pack": group.column("pack"), "share": group.column("share"),
                         "flags": pa.array([zstandard.compress(x.tobytes(), 1) for x in out], pa.binary())})

    return dealt.groupBy("share").applyInArrow(run, "pack long, share int, flags binary")


def _with_flags(row, pack: Pack, shares: int) -> np.ndarray:
    flags, given = np.zeros(len(pack.distinct), np.uint8), {f["share"]: f["flags"] for f in row["flags"] or []}
    for p, at in _by_share(pack.distinct, shares) if given else []:
        flags[at] = np.frombuffer(zstandard.decompress(given[p]), np.uint8)
    return flags


#: Of a context, in columns: bytes, place of its anchor, number (as differences), id (as differences).
_RECORD = [("size", "u1"), ("offset", "i1"), ("context", "<u4"), ("id", "<i8")]
_STEPS = {"context", "id"}


def _columns(record: list, **given: np.ndarray) -> bytes:
    """Columns one after the other."""
    return b"".join(np.ascontiguousarray(np.diff(given[k].astype(t), prepend=np.zeros(1, t)) if k in _STEPS else given[k].astype(t)).tobytes()
                    for k, t in record)


def _read_columns(record: list, data: bytes, n: int, at: int = 0) -> tuple[dict[str, np.ndarray], int]:
    """The columns of ``n`` records, and where they end."""
    out = {}
    for k, t in record:
        out[k] = np.frombuffer(data, t, n, at)
        at += out[k].nbytes
        if k in _STEPS:
            out[k] = np.cumsum(out[k], dtype=t)
    return out, at


def _sent(flagged: DataFrame, length: int, shares: int, turn: int = 0, rounds: int = 1) -> DataFrame:
    """``share, pack, contexts``: the different contexts of each pack for each share of the round."""

    def run(batches):
        squeezed = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for row in pack_rows(batch):
                pack = Pack(row["ids"], row["sizes"], row["body"], length)
                _, _, _, _, number, texts, least, offset, share = pack.contexts(
                    _with_flags(row, pack, shares), length, shares, turn, rounds)
                by = np.argsort(share, kind="stable")
                cuts = np.searchsorted(share[by], np.arange(shares + 1))
                data, ends = _sorted_out(texts.take(pa.array(by)))
                size, number, least, offset = np.diff(ends), number[by], least[by], offset[by]
                some, blobs = np.flatnonzero(np.diff(cuts)).tolist(), []
                for p in some:
                    a, b = cuts[p], cuts[p + 1]
                    blobs.append(squeezed(np.uint32(b - a).tobytes()
                                          + _columns(_RECORD, size=size[a:b], offset=offset[a:b], context=number[a:b], id=least[a:b])
                                          + data[ends[a]:ends[b]].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([row["pack"]] * len(some), pa.int64()), pa.array(blobs, pa.binary())],
                    ["share", "pack", "contexts"])

    return flagged.select("pack", "ids", "sizes", "body", "flags").mapInArrow(run, "share int, pack long, contexts binary")


def _starts(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, ``n[i]`` of each, one after the other."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _sides(data: np.ndarray, begin: np.ndarray, size: np.ndarray, offset: np.ndarray, length: int) -> np.ndarray:
    """Which contexts another one agrees with in the anchor and far enough to its left or to its right.

    A string has half of what isn't its anchor, or more, on one side, so others have no equal string."""
    half = (length - GRAM + 1) // 2
    gram, out = GRAM + half, np.zeros(len(begin), bool)
    for room, at in ((offset >= half, begin + offset - half), (size - offset >= gram, begin + offset)):
        own = np.flatnonzero(room)
        mark = _hashed(data, at[own], gram=gram)
        by = np.argsort(mark)
        same = mark[by[1:]] == mark[by[:-1]]
        out[own[by]] |= np.r_[same, False][:len(by)] | np.r_[False, same][:len(by)]
    return out


def _minima(texts: pa.Array, least: np.ndarray, offset: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of each different context, and one after the other the least ids of their classes."""
    data, ends = _sorted_out(texts)
    begin, size = ends[:-1], np.diff(ends)
    n = size - length + 1
    base = np.cumsum(n) - n
    out = np.repeat(least, n)  # of a single string: equal ones are the same context
    some = np.flatnonzero(offset >= 0)
    some = some[_sides(data, begin[some], size[some], offset[some], length)]
    words = np.ndarray((max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))
    at = begin[some] + offset[some]
    keys = [words[at + k] for k in range(0, GRAM, 8)]
    by = np.lexsort(keys)
    some, new = some[by], np.zeros(len(by), bool)
    for w in keys:
        w = w[by]
        new[1:] |= w[1:] != w[:-1]
    new[:1] = True
    cuts = np.r_[np.flatnonzero(new), len(some)]
    bulk = np.r_[0, np.cumsum(size[some])][cuts]  # bytes up to each group

    def solve(held: np.ndarray) -> None:
        body = data[_starts(begin[held], size[held])]
        found = class_minima(body, _starts(np.cumsum(size[held]) - size[held], n[held]), np.repeat(least[held], n[held]), length)
        out[_starts(base[held], n[held])] = found

    def solve_large(held: np.ndarray) -> None:
        """Too large for one sort: string by string, those with the anchor at the same place at a time."""
        for left in range(length - GRAM + 1):
            own = held[(offset[held] >= left) & (size[held] - offset[held] >= length - left)]
            rows = data[(begin[own] + offset[own] - left)[:, None] + np.arange(length)]
            which = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(length), len(own), [None, pa.py_buffer(np.ascontiguousarray(rows))]).dictionary_encode().indices.to_numpy()
            first = np.full(len(own), _LAST)
            np.minimum.at(first, which, least[own])
            out[base[own] + offset[own] - left] = first[which]

    g = 0
    while g < len(cuts) - 1:
        end = max(g + 1, int(np.searchsorted(bulk, bulk[g] + SORT_BYTES, side="right")) - 1)
        held = some[cuts[g]:cuts[end]]
        if bulk[end] - bulk[g] > SORT_BYTES:
            solve_large(held)
        elif len(held) > 1:
            solve(held)
        g = end
    return n, out


_FOUND = [("context", "<u4"), ("start", "u1"), ("end", "u1")]


def _solved(dealt: DataFrame, length: int) -> DataFrame:
    """``pack, found``: runs of strings of the pack's contexts that start in earlier documents."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        opened = zstandard.ZstdDecompressor().decompress
        instances, pieces = [], []
        for blob in group.column("contexts").to_pylist():
            data = opened(blob)
            rec, at = _read_columns(_RECORD, data, int(np.frombuffer(data, "<u4", 1)[0]), 4)
            instances.append(rec)
            pieces.append(data[at:])
        sizes = np.concatenate([rec["size"] for rec in instances]).astype(np.int64)
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [
            None, pa.py_buffer(np.r_[0, np.cumsum(sizes)]), pa.py_buffer(b"".join(pieces))])
        del pieces
        known = every.dictionary_encode()
        del every
        own, texts = known.indices.to_numpy(), known.dictionary
        least, offset = np.full(len(texts), _LAST), np.full(len(texts), -1)
        np.minimum.at(least, own, np.concatenate([rec["id"] for rec in instances]))
        np.maximum.at(offset, own, np.concatenate([rec["offset"] for rec in instances]).astype(np.int64))
        n, flat = _minima(texts, least, offset, length)
        base = np.cumsum(n) - n
        packs, found, done = [], [], 0
        for pack, rec in zip(group.column("pack").to_pylist(), instances):
            mine = own[done:done + len(rec["id"])]
            done += len(mine)
            reps = n[mine]
            step = _starts(np.zeros(len(mine), np.int64), reps)
            who = np.repeat(np.arange(len(mine)), reps)
            covered = flat[base[mine][who] + step] < rec["id"][who]
            edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
            new = np.r_[True, who[1:] != who[:-1]]  # a run ends with its context
            start = np.flatnonzero(covered & (new | (edge[:-1] == 1)))
            last = np.flatnonzero(covered & np.r_[new[1:] | (edge[1:-1] == -1), True])
            if len(start):
                packs.append(pack)
                found.append(zstandard.compress(_columns(
                    _FOUND, context=rec["context"][who[start]], start=step[start], end=step[last] + 1), 1))
        return pa.table({"pack": pa.array(packs, pa.int64()), "found": pa.array(found, pa.binary())})

    return dealt.groupBy("share").applyInArrow(run, "pack long, found binary")


def _covered(row, length: int, shares: int) -> tuple[Pack, np.ndarray]:
    """The pack and, per byte, whether it goes."""
    pack = Pack(row["ids"], row["sizes"], row["body"], length)
    own, s, e, o, number, _, least, _, _ = pack.contexts(_with_flags(row, pack, shares), length, shares)
    mark = np.zeros(len(pack.raw) + 1, np.int32)
    late = o > least[own] if len(own) else np.empty(0, bool)  # an equal context stands earlier in this pack
    np.add.at(mark, s[late], 1)
    np.add.at(mark, e[late] + length - 1, -1)
    if row["found"]:
        blobs = [zstandard.decompress(f) for f in row["found"]]
        size = sum(np.dtype(t).itemsize for _, t in _FOUND)
        recs = [_read_columns(_FOUND, b, len(b) // size)[0] for b in blobs]
        rec = {k: np.concatenate([r[k] for r in recs]).astype(np.int64) for k, _ in _FOUND}
        by = np.argsort(rec["context"], kind="stable")
        context, start, end = (rec[k][by] for k in ("context", "start", "end"))
        rest = np.flatnonzero(~late)
        a = np.searchsorted(context, number)[own[rest]]
        n = np.searchsorted(context, number, side="right")[own[rest]] - a
        who, run = np.repeat(rest, n), _starts(a, n)
        np.add.at(mark, s[who] + start[run], 1)
        np.add.at(mark, s[who] + end[run] + length - 1, -1)
    return pack, np.cumsum(mark, out=mark)[:-1] > 0


def _decided(docs: DataFrame, length: int) -> tuple[DataFrame, int]:
    """Packs with the flags and findings that decide their bytes."""
    if not GRAM + 8 <= length <= GRAM + 100:
        raise ValueError(f"length must be {GRAM + 8} to {GRAM + 100}")
    spark = docs.sparkSession
    ship(spark)
    packs = written(packed(docs, PACK_BYTES, PACK_DOCS), "packs")
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    shares, rounds = max(1, -(-total // SHARE_BYTES)), max(1, min(ROUNDS, -(-total // ROUND_BYTES)))
    flags = _flags(_dealt(_anchors(packs, length, shares), shares))
    flags = written(flags.groupBy("pack").agg(F.collect_list(F.struct("share", "flags")).alias("flags"))
                    .withColumnRenamed("pack", "of"), "flags")
    # Written, so that the texts move once for all rounds.
    packs = written(packs.join(flags, F.col("pack") == F.col("of"), "left").drop("of"), "flagged")
    del flags
    found = None
    for turn in range(rounds):
        _tidy(spark)
        part = written(_solved(_dealt(_sent(packs, length, shares, turn, rounds), shares), length), "found")
        found = found.union(part) if found else part
    _tidy(spark)
    found = found.groupBy("pack").agg(F.collect_list("found").alias("found")).withColumnRenamed("pack", "of")
    return packs.join(found, F.col("pack") == F.col("of"), "left").drop("of"), shares


def _tidy(spark) -> None:
    """Let the shuffle files of finished writes go, which Spark keeps until the driver collects its garbage."""
    for _ in range(2):  # what the first one finds may hold more
        gc.collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def report(docs: DataFrame, length: int = 50) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per document row."""
    decided, shares = _decided(docs.select("doc_id", "text"), length)

    def run(batches):
        for batch in batches:
            for k, row in enumerate(pack_rows(batch)):
                pack, gone = _covered(row, length, shares)
                removed, spans, sha = [], [], []
                for b, n in zip(pack.ends.tolist(), pack.sizes.tolist()):
                    g = gone[b - n:b]
                    removed.append(int(g.sum()))
                    spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0)
                    sha.append(hashlib.sha256(pack.body[b - n:b][~g]).hexdigest())
                ids = batch.column("rest")[k].values.field("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(pack.sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return decided.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = 50) -> DataFrame:
    """The documents, all columns, with the remaining bytes as text (and ``n_chars`` to match).

    A character that lost some of its bytes goes whole; a null text becomes empty."""
    decided, shares = _decided(docs, length)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for k, row in enumerate(pack_rows(batch)):
                pack, gone = _covered(row, length, shares)
                kept = [pack.body[b - n:b][~gone[b - n:b]].tobytes().decode("utf-8", "ignore")
                        for b, n in zip(pack.ends.tolist(), pack.sizes.tolist())]
                rest = batch.column("rest")[k].values
                new = {"text": pa.array(kept, pa.string())}
                if "n_chars" in names:
                    new["n_chars"] = pa.array([len(t) for t in kept]).cast(rest.type.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([new[c] if c in new else rest.field(c) for c in names], names)

    return decided.mapInArrow(run, docs.schema)
