"""Operator 4, suffix-array dedup of repeated 50-byte strings.

What is asked: bytes covered by a LENGTH-byte string that also starts in a
document with a smaller id.

1. Documents are dealt into parts by a hash of the row. Every window of LENGTH bytes has
   an anchor, the least hash among its GRAM-byte grams, so equal windows have
   equal anchors; runs of windows with one anchor form a piece (their bytes
   overlap by LENGTH - 1). Parts send their distinct anchors to shards, which
   send back those that two documents hold.
2. Parts send the distinct pieces with such anchors to shards by anchor. A
   shard's text is cut into sub-shards of bounded size; each gets a suffix
   array by Larsson-Sadakane refinement (numpy; the sorted prefix doubles in each
   round and settled suffixes are left alone) and common prefixes by Kasai's
   walk, done for all pieces in step. Suffixes that share LENGTH bytes form a
   class with a least document; the classes of the sub-shards are merged by binary
   search of their sorted strings.
3. Each part gets the least documents for its own pieces back and cuts its texts.

A passage in a third of all documents is one piece per part, never one row per
document, and no step pairs documents.

Defined edge cases: null text is the empty text; texts under LENGTH bytes lose
nothing; rows with one doc_id never cut each other, repeated rows included; a
null doc_id counts as smaller than all others; an empty table gives an empty
result; other columns are never looked at. Byte runs are judged on UTF-8 and
matches never cross texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import BYTE_CODE, blocks, dealt, documents, mix, partitions_for, powers, raw, run_heads

LENGTH, GRAM = 50, 20
SUBSHARD_BYTES = 2 << 20
#: Compressed input in a part, and shards for each part: what a task holds at once follows from these.
PART_BYTES, SHARDS_EACH = 4 << 20, 4
_U64 = np.uint64
_ANCHOR_BITS = 47
_NULL_ID = -(2**63)


# --- suffix arrays -----------------------------------------------------------


def suffix_array(codes: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of ``codes`` (small non-negative integers under 256) in order, to ``depth`` symbols at least (None: fully).

    Larsson-Sadakane: suffixes are first sorted by a packed prefix; a group of equal prefixes of length h is sorted by the
    group numbers h further on, which doubles h; groups of one are settled and not touched again."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    h = 7
    padded = np.zeros(n + h, np.uint64)
    padded[:n] = codes.astype(np.uint64) + _U64(1)
    key = np.zeros(n, np.uint64)
    for j in range(h):
        key = key * _U64(257) + padded[j : j + n]
    order = np.argsort(key)
    head = run_heads(key[order])
    del key, padded
    order = order.astype(np.int32 if n < 2**31 - 1 else np.int64)
    rank = np.empty(n + 1, order.dtype)
    rank[n] = -1
    starts = np.flatnonzero(head)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    size = np.diff(np.append(starts, n))
    open_ = np.repeat(size > 1, size)
    while open_.any() and (depth is None or h < depth):
        at = np.flatnonzero(open_)
        suffix = order[at]
        group = rank[suffix]
        then = rank[np.minimum(suffix.astype(np.int64) + h, n)]
        both = group.astype(np.int64) * (n + 1) + then + 1
        by = np.argsort(both)
        suffix = suffix[by]
        order[at] = suffix
        first = run_heads(both[by])
        heads = np.flatnonzero(first)
        size = np.diff(np.append(heads, len(at)))
        rank[suffix] = np.repeat(at[heads], size)
        open_[at] = np.repeat(size > 1, size)
        h *= 2
    return order


def common_prefixes(codes: np.ndarray, order: np.ndarray, most: int, cuts: np.ndarray | None = None) -> np.ndarray:
    """For each place in ``order`` but the first (0): symbols shared with the suffix before, counted up to ``most``.

    Kasai's walk in text order, where a suffix shares at least one symbol less than the one that starts before it; the text
    is walked from all ``cuts`` at once, in step."""
    n = len(codes)
    out = np.zeros(n, np.int32)
    if n == 0:
        return out
    before = np.full(n, -1, order.dtype)
    before[order[1:]] = order[:-1]
    place = np.empty(n, order.dtype)
    place[order] = np.arange(n)
    padded = np.append(codes.astype(np.int16), np.full(most + 1, -1, np.int16))
    cuts = np.arange(0, n, 256) if cuts is None else cuts
    end = np.append(cuts[1:], n)
    at, h = cuts.copy(), np.zeros(len(cuts), np.int64)
    while len(at):
        other = before[at]
        h[other < 0] = 0
        grow = np.flatnonzero((other >= 0) & (h < most))
        while len(grow):
            a, b = at[grow] + h[grow], other[grow] + h[grow]
            same = (a < n) & (b < n) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
            grow = grow[same]
            h[grow] += 1
            grow = grow[h[grow] < most]
        out[place[at]] = h
        h = np.maximum(h - 1, 0)
        at = at + 1
        go = at < end
        at, h, end = at[go], h[go], end[go]
    return out


class Classes:
    """Distinct strings of ``length`` symbols, sorted, with the least document of each; built shard by shard."""

    def __init__(self, length: int):
        self.keys, self.least = np.zeros(0, f"S{length}"), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, least: np.ndarray) -> None:
        """Add another shard's sorted distinct strings: found by binary search, or put in their place."""
        at = np.searchsorted(self.keys, keys)
        old = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        old[inside] = self.keys[at[inside]] == keys[inside]
        np.minimum.at(self.least, at[old], least[old])
        self.keys, self.least = np.insert(self.keys, at[~old], keys[~old]), np.insert(self.least, at[~old], least[~old])

    def of(self, keys: np.ndarray) -> np.ndarray:
        return self.least[np.searchsorted(self.keys, keys)]


def window_classes(text: np.ndarray, offs: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of strings end to end: (window starts in suffix order, class of each, sorted class strings, least document of each class)."""
    n, count = int(offs[-1]), len(offs) - 1
    codes = np.zeros(n + count, np.uint8)
    owner = np.repeat(np.arange(count, dtype=np.int32), np.diff(offs))
    codes[np.arange(n) + owner] = text + 1  # no UTF-8 byte is 255; 0 ends a string
    del owner
    starts = offs[:-1] + np.arange(count)
    order = suffix_array(codes)  # fully: the walk below needs the order of all suffixes
    shared = common_prefixes(codes, order, length, starts)
    who = np.searchsorted(starts, order, "right") - 1
    fits = order + length <= (offs[1:] + np.arange(count))[who]
    # Suffixes between two that share `length` symbols share as many, so those too short never stand between.
    at = order[fits]
    head = shared[fits] < length
    if len(head):
        head[0] = True
    cls = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    least = np.minimum.reduceat(doc[who[fits]], first) if len(first) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(codes, length) if len(codes) >= length else np.zeros((0, length), np.uint8)
    keys = np.ascontiguousarray(view[at[first]]).view(f"S{length}").ravel() if len(first) else np.zeros(0, f"S{length}")
    return at - who[fits], cls, keys, least


def least_documents(text: np.ndarray, offs: np.ndarray, doc: np.ndarray, length: int = LENGTH, most: int = SUBSHARD_BYTES) -> np.ndarray:
    """For each byte position at which a window starts, the least document that holds it (elsewhere the greatest integer)."""
    out = np.full(len(text), np.iinfo(np.int64).max)
    merged, parts = Classes(length), []
    for lo, hi, data, at in blocks(text, offs, most):
        starts, cls, keys, least = window_classes(data, at, doc[lo:hi], length)
        if hi - lo == len(offs) - 1:
            out[starts] = least[cls]
            return out
        merged.merge(keys, least)
        parts.append((offs[lo] + starts, cls, keys))
    for starts, cls, keys in parts:
        out[starts] = merged.of(keys)[cls]
    return out


# --- pieces ------------------------------------------------------------------


def pieces(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, anchor, hash of the piece's bytes) of texts laid end to end."""
    n = len(data)
    z = np.zeros(0, np.int64)
    if n < length:
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    up, down = powers(n)
    total = np.zeros(n + 1, _U64)
    np.cumsum(BYTE_CODE[data] * up[:n], out=total[1:])
    m = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    m >>= _U64(64 - _ANCHOR_BITS)
    width, step = length - gram + 1, 1
    while 2 * step <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if step < width:
        m = np.minimum(m[: len(m) - (width - step)], m[width - step :])
    valid = np.ones(n - length + 1, bool)
    for o in offs[1:-1].tolist():
        valid[max(0, o - length + 1) : o] = False
    head = valid.copy()
    head[1:] &= (m[1:] != m[:-1]) | ~valid[:-1]
    # A text that begins right where another ends has no window of the other before it, unless that one was too short to tell.
    begin = offs[1:-1]
    begin = begin[begin < len(valid)]
    head[begin] = valid[begin]
    first = np.flatnonzero(head)
    ends = np.flatnonzero(np.append(valid, False)[:-1] & ~np.append(valid[1:] & ~head[1:], False)) + 1
    count = ends - first
    row = np.searchsorted(offs, first, "right") - 1
    stop = first + count + length - 1
    digest = mix((total[stop] - total[first]) * down[first] + count.astype(np.uint64))
    return row, first, count, m[first], digest


def _packed(a: np.ndarray) -> bytes:
    """48-bit values, six bytes each."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _ids(t: pa.Table) -> np.ndarray:
    return t["doc_id"].fill_null(_NULL_ID).to_numpy()


def _by_shard(shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
    if not len(shard):
        return []
    order = np.argsort(shard, kind="stable")
    heads = np.flatnonzero(run_heads(shard[order]))
    return [(int(shard[order[a]]), order[a:z]) for a, z in zip(heads, np.append(heads[1:], len(order)), strict=True)]


def _shard_of(anchor: np.ndarray, shards: int) -> np.ndarray:
    return (mix(anchor) % _U64(shards)).astype(np.int64)


_BLOCK = 1 << 18


def _part_pieces(t: pa.Table, want: np.ndarray | None = None):
    """All pieces of a part: (text number, first window in it, windows, anchor, digest), by ``want`` only those with such anchors, and the bytes."""
    data, offs = raw(t["text"])
    found = []
    for lo, _, block, at in blocks(data, offs, _BLOCK):
        row, first, count, anchor, digest = pieces(block, at)
        if want is not None:
            k = np.minimum(np.searchsorted(want, anchor), max(len(want) - 1, 0))
            keep = want[k] == anchor if len(want) else np.zeros(len(anchor), bool)
            row, first, count, anchor, digest = row[keep], first[keep], count[keep], anchor[keep], digest[keep]
        found.append((row + lo, first - at[row], count, anchor, digest))
    return [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 5)], data, offs


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) with the kept bytes, or their kept_sha256 as a digest; one row per input row."""
    n = partitions_for(df, PART_BYTES)
    shards = SHARDS_EACH * n
    parts = dealt(df, id_col, text_col, n)

    def anchors(t: pa.Table) -> pa.Table:
        (row, _, _, anchor, _), _, _ = _part_pieces(t)
        doc = _ids(t)[row]
        order = np.argsort(anchor, kind="stable")
        anchor, doc = anchor[order], doc[order]
        heads = np.flatnonzero(run_heads(anchor))
        several = np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads) if len(heads) else np.zeros(0, bool)
        anchor = anchor[heads]
        said = anchor * _U64(2) + several.astype(np.uint64)
        cells = _by_shard(_shard_of(anchor, shards))
        pid = t["pid"][0].as_py()
        return pa.table({"shard": pa.array([s for s, _ in cells], pa.int32()), "pid": pa.array([pid] * len(cells), pa.int32()), "body": pa.array([_packed(said[i]) for _, i in cells], pa.binary())})

    def shared(t: pa.Table) -> pa.Table:
        lists = [_unpacked(b) for b in t["body"].to_pylist()]
        said = np.concatenate(lists)
        part = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        anchor = said >> _U64(1)
        order = np.argsort(anchor, kind="stable")
        heads = np.flatnonzero(run_heads(anchor[order]))
        size = np.diff(np.append(heads, len(order)))
        good = np.repeat((size > 1) | (np.maximum.reduceat(said[order] & _U64(1), heads) > 0), size) if len(heads) else np.zeros(0, bool)
        part, anchor = part[order][good], anchor[order][good]
        cells = _by_shard(part)
        pid = t["pid"].to_pylist()
        return pa.table({"pid": pa.array([pid[p] for p, _ in cells], pa.int32()), "body": pa.array([_packed(anchor[i]) for _, i in cells], pa.binary())})

    kind = "shard int, pid int, body binary"
    back = parts.groupBy("pid").applyInArrow(anchors, kind).groupBy("shard").applyInArrow(shared, "pid int, body binary")

    def candidates(t: pa.Table, said: pa.Table) -> pa.Table:
        want = np.sort(np.concatenate([_unpacked(b) for b in said["body"].to_pylist()])) if said.num_rows else np.zeros(0, np.uint64)
        none = pa.table({"shard": pa.array([], pa.int32()), "pid": pa.array([], pa.int32()), "digest": pa.array([], pa.binary()), "count": pa.array([], pa.binary()), "least": pa.array([], pa.binary()), "most": pa.array([], pa.binary()), "text": pa.array([], pa.binary())})
        if not t.num_rows or not len(want):
            return none
        (row, first, count, anchor, digest_), data, offs = _part_pieces(t, want)
        if not len(row):
            return none
        doc, start = _ids(t)[row], offs[row] + first
        order = np.argsort(digest_, kind="stable")
        heads = np.flatnonzero(run_heads(digest_[order]))
        least, most = np.minimum.reduceat(doc[order], heads), np.maximum.reduceat(doc[order], heads)
        one = order[heads]
        start, count, anchor, digest_ = start[one], count[one], anchor[one], digest_[one]
        flat, out = data.tobytes(), []
        pid = t["pid"][0].as_py()
        for s, i in _by_shard(_shard_of(anchor, shards)):
            text = b"".join([flat[a:z] for a, z in zip(start[i].tolist(), (start[i] + count[i] + LENGTH - 1).tolist(), strict=True)])
            out.append((s, pid, digest_[i].tobytes(), count[i].astype(np.int32).tobytes(), least[i].tobytes(), (most[i] - least[i]).tobytes(), text))
        return pa.table({name: pa.array([r[k] for r in out], none.schema.field(name).type) for k, name in enumerate(none.schema.names)})

    sent = parts.groupBy("pid").cogroup(back.groupBy("pid")).applyInArrow(candidates, "shard int, pid int, digest binary, count binary, least binary, most binary, text binary")

    def settle(t: pa.Table) -> pa.Table:
        col = lambda name, kind: [np.frombuffer(b, kind) for b in t[name].to_pylist()]
        digests, counts_, leasts, mosts = col("digest", np.uint64), col("count", np.int32), col("least", np.int64), col("most", np.int64)
        part = np.repeat(np.arange(len(digests)), [len(x) for x in digests])
        key, count, least, most = (np.concatenate(x) for x in (digests, counts_, leasts, mosts))
        data = np.frombuffer(b"".join(t["text"].to_pylist()), np.uint8)
        size = count.astype(np.int64) + LENGTH - 1
        begin = np.cumsum(size) - size
        # Equal pieces of several parts are one string with the least of their documents.
        kinds, one, inverse = np.unique(key, return_index=True, return_inverse=True)
        low = np.full(len(kinds), np.iinfo(np.int64).max)
        np.minimum.at(low, inverse, least)
        offs = np.append(0, np.cumsum(size[one]))
        text = data[np.arange(offs[-1]) + np.repeat(begin[one] - offs[:-1], size[one])] if len(one) else data[:0]
        win = least_documents(text, offs, low)
        # Runs of windows with one least document, as far as windows start.
        pos = np.arange(offs[-1])
        owner = np.repeat(np.arange(len(kinds)), size[one])
        starts_here = pos - offs[owner] < count[one][owner]
        pos, owner, win = pos[starts_here], owner[starts_here], win[starts_here]
        heads = np.flatnonzero(run_heads(owner, win))
        run_owner, run_off, run_len, run_least = owner[heads], pos[heads] - offs[owner[heads]], np.diff(np.append(heads, len(pos))), win[heads]
        lo = np.searchsorted(run_owner, np.arange(len(kinds) + 1))
        pids, out = t["pid"].to_pylist(), []
        for p in range(len(digests)):
            mine = np.flatnonzero(part == p)
            k = inverse[mine]
            reps = lo[k + 1] - lo[k]
            at = np.arange(reps.sum()) + np.repeat(lo[k] - np.append(0, np.cumsum(reps)[:-1]), reps)
            told = np.repeat(mine, reps)
            use = run_least[at] < least[told] + most[told]
            at, told = at[use], told[use]
            if len(at):
                out.append((pids[p], key[told].tobytes(), run_off[at].astype(np.int32).tobytes(), run_len[at].astype(np.int32).tobytes(), run_least[at].tobytes()))
        return pa.table({"pid": pa.array([r[0] for r in out], pa.int32()), **{c: pa.array([r[i + 1] for r in out], pa.binary()) for i, c in enumerate(("digest", "off", "len", "least"))}})

    told = sent.groupBy("shard").applyInArrow(settle, "pid int, digest binary, off binary, len binary, least binary")
    last = "kept_sha256" if digest else "kept"

    def cut(t: pa.Table, told: pa.Table) -> pa.Table:
        (row, first, _, _, key), data, offs = _part_pieces(t)
        removed = np.zeros(len(data) + 1, np.int32)
        if told.num_rows and len(row):
            col = lambda name, kind: np.concatenate([np.frombuffer(b, kind) for b in told[name].to_pylist()])
            digests, off, run, least = col("digest", np.uint64), col("off", np.int32), col("len", np.int32), col("least", np.int64)
            order = np.lexsort((off, digests))
            digests, off, run, least = digests[order], off[order], run[order], least[order]
            lo, hi = np.searchsorted(digests, key, "left"), np.searchsorted(digests, key, "right")
            reps = hi - lo
            at = np.arange(reps.sum()) + np.repeat(lo - np.append(0, np.cumsum(reps)[:-1]), reps)
            piece = np.repeat(np.arange(len(key)), reps)
            gone = least[at] < _ids(t)[row[piece]]
            at, piece = at[gone], piece[gone]
            begin = offs[row[piece]] + first[piece] + off[at]
            np.add.at(removed, begin, 1)
            np.add.at(removed, begin + run[at] + LENGTH - 1, -1)
        gone = np.cumsum(removed[:-1]) > 0
        n_removed = np.diff(np.append(0, np.cumsum(gone))[offs])
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = offs[:-1][offs[:-1] < len(gone)]
        edge[inner] = gone[inner]
        n_spans = np.diff(np.append(0, np.cumsum(edge))[offs])
        kept = []
        for i, (a, z) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            text = (data[a:z][~gone[a:z]] if n_removed[i] else data[a:z]).tobytes()
            kept.append(hashlib.sha256(text).hexdigest() if digest else text)
        return pa.table({"doc_id": t["doc_id"], "n_bytes": np.diff(offs), "n_removed": n_removed.astype(np.int64), "n_spans": n_spans.astype(np.int64), last: pa.array(kept, pa.string() if digest else pa.binary())})

    return parts.groupBy("pid").cogroup(told.groupBy("pid")).applyInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {'string' if digest else 'binary'}")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(documents(spark, sf_dir), digest=True)


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict[str, str] = {}
