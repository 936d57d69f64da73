"""The prefix trie of conversations from a sparse table over sorted LCPs.

Each turn is the MD5 of its role and text, a conversation the bytes of its
turns in order.  Range partitioning and sorting by these bytes (then by id)
puts the members of every prefix next to each other, copies included, so a
group of any size is split over tasks.  Each Arrow batch of a sorted partition
is one block:

* LCPs (in turns) of neighbours, and a sparse table of their range minima;
* each prefix is a candidate once, at the first conversation that has it, and
  finds its left and right extents by binary search on the table, each
  direction by itself and all candidates together: its members are an
  interval, and no stack or tree is kept;
* counts over an interval or a subtree are differences of running sums.

A prefix that reaches the first or last conversation of its block may go on in
another block.  Such *open* prefixes (at most those of two conversations for
each block) carry sums that add up over blocks, with a correction for what the
last conversation of a block shares with the first one of the next.  They are
added up by prefix.  What lies between is final where it is found.

Bounds: a block holds an Arrow batch (10,000 conversations) of turn digests.
The conversations ending at one open prefix are hashed in one task as a sorted
stream of packed ids, 256 an item, never as one group in memory.  One row per
sorted partition goes through one window, to compare the ends of neighbouring
partitions.  The turns of one conversation (24 bytes each, no texts) meet in
one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Bytes of a turn's digest.
WIDTH = 16
#: Ids of one packed item.
PACK = 256

_NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_PARTS = (
    "kind string, block string, place long, prefix binary, above binary, parent_conv_id long, up long, "
    "ends binary, ends_at long, ends_sha256 string, last binary, chars array<long>, number long, " + _NODE
)


def turn_rows(rows: DataFrame) -> DataFrame:
    """conv_id and its ``turns`` in order (digest, n_chars), from
    ``rows(conv_id, turn, role, text)``.  Null roles and texts are empty, rows
    of a null turn come first, rows of one turn are ordered by role, then by
    digest.  Rows without an id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("n")).alias("t"),
    )
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["n"].alias("n_chars"))).alias("turns"))


def with_shared_heads(conversations: DataFrame, group: int = 100, kinds: int = 6) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of conversation
    c - c % group, h = crc32(c as text) % kinds (all of them if fewer, none if
    there is no such conversation), then its own turns after its first h."""
    heads = conversations.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("head_id"), F.slice("turns", 1, kinds - 1).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds).cast("int")
    rows = conversations.withColumns({"h": h, "head_id": F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(group))})
    rows = rows.join(heads, "head_id", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    shared = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(shared, own).alias("turns"))


def lcp_of(a: bytes, b: bytes) -> int:
    """Turns that two conversations share from the start."""
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(v, np.uint64, 2 * n).reshape(n, 2) for v in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else n


def lcps(blobs: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """LCP of each conversation with the one before; 0 for the first."""
    out = np.zeros(len(blobs), np.int64)
    turns = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 2)
    begin = np.cumsum(sizes) - sizes
    common = np.minimum(sizes[1:], sizes[:-1])
    rows = np.flatnonzero(common)
    if not len(rows):
        return out
    size = common[rows]
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(first, size)
    same = (turns[np.repeat(begin[rows], size) + at] == turns[np.repeat(begin[rows + 1], size) + at]).all(axis=1)
    out[rows + 1] = np.minimum.reduceat(np.where(same, np.repeat(size, size), at), first)
    return out


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all windows of 1, 2, 4, ... values."""
    table = [values]
    while (half := 1 << (len(table) - 1)) * 2 <= len(values):
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def extents(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last member of the prefix of ``depth`` turns of each
    conversation ``at``.  ``table`` is over the LCPs with the one before, so
    the members go left while these are at least ``depth``, and right while
    the next ones are."""
    n = len(table[0])
    left, right = at.copy(), at.copy()
    for k in range(len(table) - 1, -1, -1):
        size = 1 << k
        fits = left - size >= 0  # the LCPs at left - size + 1 .. left
        fits[fits] = table[k][left[fits] - size + 1] >= depth[fits]
        left -= size * fits
        fits = right + size < n
        fits[fits] = table[k][right[fits] + 1] >= depth[fits]
        right += size * fits
    return left, right


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values)))


def _ids(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def _prefix(blob: bytes, depth: int) -> bytes:
    """A key for the first ``depth`` turns."""
    return hashlib.md5(blob[: depth * WIDTH]).digest() + depth.to_bytes(8, "big")


def block_parts(block: str, ids: np.ndarray, blobs: list[bytes], chars: list[np.ndarray]) -> pd.DataFrame:
    """Nodes and open parts of one block of sorted conversations."""
    n = len(ids)
    sizes = np.array([len(b) // WIDTH for b in blobs], np.int64)
    lcp = lcps(blobs, sizes)
    table = sparse_table(lcp)
    flat = _sums(np.concatenate(chars) if len(chars) else [])
    begin = np.cumsum(sizes) - sizes
    whole = flat[begin + sizes] - flat[begin]  # code points of each conversation
    # one candidate for each distinct prefix, at the first conversation with it, and the root
    fresh = sizes - lcp
    conv = np.repeat(np.arange(n), fresh)
    depth = np.arange(fresh.sum()) - np.repeat(np.cumsum(fresh) - fresh, fresh) + np.repeat(lcp, fresh) + 1
    conv, depth = np.concatenate(([0], conv)), np.concatenate(([0], depth))
    left, right = extents(table, conv, depth)
    left[0], right[0] = 0, n - 1

    new_chars = flat[begin + sizes] - flat[begin + lcp]
    leaf = (sizes > np.concatenate((lcp[1:], [-1]))).astype(np.int64)
    chars_before = flat[begin[conv] + np.maximum(depth - 1, 0)] - flat[begin[conv]]  # above the node's own turn
    members = right - left + 1
    total = _sums(whole)[right + 1] - _sums(whole)[left] - members * chars_before
    # distinct turns below: all of the first member's, then what each later one adds
    distinct = whole[left] - chars_before + _sums(new_chars)[right + 1] - _sums(new_chars)[left + 1]
    leaves = _sums(leaf)[right + 1] - _sums(leaf)[left]

    # candidates in order of (conv, depth): a node's place is found by its first member and depth
    order = np.cumsum(fresh) - fresh + 1
    at = lambda c, d: np.where(d == 0, 0, order[c] + d - lcp[c] - 1)
    above_left, _ = extents(table, left, np.maximum(depth - 1, 0))
    above_left[depth <= 1] = 0
    up = at(above_left, np.maximum(depth - 1, 0))
    children = np.bincount(up[1:], minlength=len(conv))
    least = np.minimum.reduceat(np.append(ids, ids[-1]), np.stack((left, right + 1), 1).ravel())[::2]

    # conversations that end at a node are the first of its members
    ending = np.bincount(at(*_end_nodes(table, sizes, lcp)), minlength=len(conv))
    open_ = (left == 0) | (right == n - 1)
    out = pd.DataFrame(
        {
            "conv_id": least, "depth": depth, "n_convs": members, "n_children": children, "n_leaves": leaves,
            "saved_tokens": total - distinct, "up": up, "place": np.arange(len(conv)), "block": block,
        }
    )
    out["kind"] = np.where(open_, "open", "node")
    out["parent_conv_id"] = pd.array(np.where(open_[up], 0, least[up]), "Int64")
    out.loc[open_[up], "parent_conv_id"] = pd.NA
    shas, prefixes, aboves = [None] * len(conv), [None] * len(conv), [None] * len(conv)
    packs = []
    none = hashlib.sha256(b"").hexdigest()
    for i, (lo, d, m, is_open) in enumerate(zip(left.tolist(), depth.tolist(), ending.tolist(), open_.tolist(), strict=True)):
        own = ids[lo : lo + m].tolist()
        if not is_open:
            shas[i] = hashlib.sha256(_ids(own)).hexdigest() if m else none
            continue
        prefixes[i] = _prefix(blobs[lo], d)
        aboves[i] = _prefix(blobs[lo], d - 1) if d else None
        packs.extend((prefixes[i], own[k], _ids(own[k : k + PACK])) for k in range(0, m, PACK))
    out["ends_sha256"], out["prefix"], out["above"] = shas, prefixes, aboves
    ends = pd.DataFrame(packs, columns=["prefix", "ends_at", "ends"]).assign(kind="ends")
    return pd.concat([out, ends], ignore_index=True)


def _end_nodes(table: list[np.ndarray], sizes: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First member and depth of the node at which each conversation ends."""
    first, _ = extents(table, np.arange(len(sizes)), sizes)
    first[sizes == 0] = 0
    return first, sizes


def seam_parts(last: bytes, first: bytes, chars: np.ndarray) -> pd.DataFrame:
    """What the sums of two neighbouring blocks count twice, or wrongly as a
    leaf, on the prefixes that the last conversation of the one shares with
    the first (of these ``chars``) of the other."""
    x = lcp_of(last, first)
    depth = np.arange(x + 1)
    upto = _sums(chars[:x])
    ended = len(last) // WIDTH == x
    return pd.DataFrame(
        {
            "kind": "open", "prefix": [_prefix(first, d) for d in range(x + 1)],
            "above": [_prefix(first, d - 1) if d else None for d in range(x + 1)], "depth": depth,
            "n_convs": 0, "n_children": -(depth < x).astype(np.int64), "n_leaves": -int(ended),
            "saved_tokens": upto[x] - upto[np.maximum(depth - 1, 0)],
        }
    )


def _parts(rows: DataFrame) -> DataFrame:
    """Nodes, open parts, packed ends and partition edges of sorted rows."""
    names = [c.split(":")[0].split()[0] for c in _PARTS.split(", ")]

    def shaped(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.reindex(columns=names)
        whole = [c for c, t in (c.split() for c in _PARTS.split(", ")) if t == "long"]
        return frame.astype({c: "Int64" for c in whole}).astype(object).where(frame.notna(), None)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        partition, number, last = TaskContext.get().partitionId(), 0, None
        for frame in frames:
            if not len(frame):
                continue
            blobs = [bytes(b) for b in frame["seq"]]
            chars = [np.asarray(c, np.int64) for c in frame["chars"]]
            if last is None:
                yield shaped(pd.DataFrame({"kind": ["first"], "number": [partition], "last": [blobs[0]], "chars": [chars[0].tolist()]}))
            else:
                yield shaped(seam_parts(last, blobs[0], chars[0]))
            yield shaped(block_parts(f"{partition}-{number}", frame["conv_id"].to_numpy(np.int64), blobs, chars))
            last, number = blobs[-1], number + 1
        if last is not None:
            yield shaped(pd.DataFrame({"kind": ["last"], "number": [partition], "last": [last]}))

    return rows.mapInPandas(cut, _PARTS)


def _partition_seams(parts: DataFrame) -> DataFrame:
    """Seams between sorted partitions: one row each for two neighbours."""
    edges = parts.where("kind IN ('first', 'last')").select("kind", "number", "last", "chars")
    edges = edges.withColumn("before", F.lag("last").over(Window.orderBy("number", "kind")))
    edges = edges.where("kind = 'first' AND before IS NOT NULL").select("before", "last", "chars")

    def seams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for before, last, chars in zip(frame["before"], frame["last"], frame["chars"], strict=True):
                out = seam_parts(bytes(before), bytes(last), np.asarray(chars, np.int64))
                yield out[["prefix", "above", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]]

    return edges.mapInPandas(
        seams, "prefix binary, above binary, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    ).withColumn("conv_id", F.lit(None).cast("long"))


def _ends_digests(parts: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each open prefix, hashed as a stream."""
    rows = parts.where("kind = 'ends'").select("prefix", "ends_at", "ends")
    rows = rows.repartition("prefix").sortWithinPartitions("prefix", "ends_at")

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prefix, state = None, None
        for frame in frames:
            done = []
            for key, ends in zip(map(bytes, frame["prefix"]), frame["ends"], strict=True):
                if key != prefix:
                    if prefix is not None:
                        done.append((prefix, state.hexdigest()))
                    prefix, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ends)
            if done:
                yield pd.DataFrame(done, columns=["prefix", "ends_sha256"])
        if prefix is not None:
            yield pd.DataFrame([(prefix, state.hexdigest())], columns=["prefix", "ends_sha256"])

    return rows.mapInPandas(digest, "prefix binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of ``conversations(conv_id, turns)``, ids
    distinct: conv_id (the smallest member), depth, parent_conv_id (the
    parent's conv_id, null for the root), n_convs (members), n_children,
    n_leaves (childless nodes in the subtree, itself included), saved_tokens
    (over the subtree, code points of a node's last turn times its members
    less one) and ends_sha256 (of the ids of the members that end there,
    ascending, joined by commas).  No conversations, no nodes."""
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = conversations.select("conv_id", seq.alias("seq"), F.transform("turns", lambda t: t["n_chars"]).alias("chars"))
    rows = rows.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    parts = saved(_parts(rows), "trie-parts")

    fields = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    opened = parts.where("kind = 'open'").select("prefix", "above", "depth", *fields, "conv_id")
    added = opened.unionByName(_partition_seams(parts)).groupBy("prefix").agg(
        F.first("above", ignorenulls=True).alias("above"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in fields),
    )
    added = saved(added.join(_ends_digests(parts), "prefix", "left"), "trie-open")
    heads = added.select(F.col("prefix").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    opened = added.join(heads, "above", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))

    # a final node under an open one: the parent by block and place, a key that at most one block's nodes share
    nodes = parts.where("kind = 'node'")
    of_place = parts.where("kind = 'open' AND place IS NOT NULL").select("prefix", "block", F.col("place").alias("up"))
    of_place = of_place.join(added.select("prefix", F.col("conv_id").alias("parent_conv_id")), "prefix").drop("prefix")
    columns = ["conv_id", "depth", "parent_conv_id", *fields, "ends_sha256"]
    under = nodes.where("parent_conv_id IS NULL").drop("parent_conv_id").join(of_place, ["block", "up"])
    return (
        nodes.where("parent_conv_id IS NOT NULL").select(*columns).unionByName(under.select(*columns)).unionByName(opened.select(*columns))
    )
