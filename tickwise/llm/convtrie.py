"""Conversation prefix trie by double arrays (operator 11).

A conversation is a path of turns. Paths are written as one binary value each: ``UNIT`` bytes a turn, the MD5 of role and
text and the text's size, so that byte order is path order and a node's subtree is a run of that order. Equal
paths are aggregated first: a conversation that occurs a million times is one path with a count.

Paths are range-partitioned into prefix shards of a bounded number of paths. Each shard numbers its distinct turns
densely, packs its trie into a double array (the children of a node of base ``b`` stand at ``b + turn id``, and
``check`` there names the node) and walks all its paths through it, one depth at a time. A shard only shares nodes with
other shards on its first and its last path. With the neighbours' bounds it knows which of these it is the first to
hold and whether its last path goes on, so every statistic of a shared node is a sum (or minimum) over shards: those
few partial rows are merged globally, everything else is final where it was built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, cut

#: Bytes of a turn in a path: 16 of MD5, 8 of the text's size (big-endian).
UNIT = 24
#: Distinct paths a shard holds, about.
SHARD_PATHS = 50_000
#: Member ids written out as one row for the digest of a node's ends.
ID_RUN = 65_536
#: Turns taken from the shared head conversation, at most (the remainder of a checksum by 9).
HEAD = 8

_NO_END = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """A trie over dense turn ids from 1: node ``t`` is the child of ``s`` by turn ``c`` if ``t == base[s] + c`` and
    ``check[t] == s``. Node 0 is the root."""

    #: Places tried for the children of a node before they go behind all others.
    TRIES = 32

    def __init__(self, paths: list[np.ndarray], codes: int):
        """``paths`` are sorted, distinct arrays of turn ids, a prefix before what extends it."""
        places = sum(map(len, paths)) + codes + 2
        self.base, self.check = np.zeros(places, dtype=np.int64), np.full(places, -1, dtype=np.int64)
        self._free = list(range(places + 1))  # leads to the next free place at or after
        self._end = 1
        self._take(0)
        todo = [(0, 0, 0, len(paths))]  # node, depth, run of paths through it
        while todo:
            following = []
            for node, depth, lo, hi in todo:
                if lo < hi and len(paths[lo]) == depth:
                    lo += 1
                if lo == hi:
                    continue
                at = np.fromiter((paths[i][depth] for i in range(lo, hi)), dtype=np.int64, count=hi - lo)
                cuts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
                children = at[cuts]
                base = self._place(children)
                self.base[node] = base
                self.check[base + children] = node
                places = (base + children).tolist()
                for place in places:
                    self._take(place)
                cuts = (lo + cuts).tolist() + [hi]
                following += [(places[i], depth + 1, cuts[i], cuts[i + 1]) for i in range(len(places))]
            todo = following

    def _next(self, x: int) -> int:
        free = self._free
        while x < len(free) and free[x] != x:
            if free[x] < len(free):
                free[x] = free[free[x]]
            x = free[x]
        return x

    def _take(self, x: int) -> None:
        if x >= len(self._free):
            self._free.extend(range(len(self._free), x + 1))
        self._free[x] = x + 1
        self._end = max(self._end, x + 1)

    def _place(self, children: np.ndarray) -> int:
        """A base that puts all children on free places."""
        first = int(children[0])
        at = self._next(first)
        for _ in range(self.TRIES):
            want = children + (at - first)
            self._grow(int(want[-1]))
            if len(children) == 1 or (self.check[want] == -1).all():
                return at - first
            at = self._next(at + 1)
        base = max(0, self._end - first)
        self._grow(base + int(children[-1]))
        return base

    def _grow(self, place: int) -> None:
        if place >= len(self.base):
            more = max(len(self.base), place + 1 - len(self.base))
            self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, dtype=np.int64)])

    def step(self, nodes: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The children of ``nodes`` by ``turns``; -1 where there is none."""
        to = self.base[nodes] + turns
        ok = (to >= 0) & (to < len(self.check))
        ok[ok] = self.check[to[ok]] == nodes[ok]
        return np.where(ok, to, -1)


def _keys(path: bytes) -> list[bytes]:
    """One digest per prefix of a path, the empty one first; linear in the path."""
    h = hashlib.md5()
    out = [h.digest()]
    for at in range(0, len(path), UNIT):
        h.update(path[at:at + UNIT])
        out.append(h.digest())
    return out


def _shared_depth(a: bytes, b: bytes | None) -> int:
    """Turns that two paths have in common at the start; -1 without a second path."""
    if b is None:
        return -1
    n = min(len(a), len(b)) // UNIT
    x, y = (np.frombuffer(p[:n * UNIT], dtype=f"V{UNIT}") for p in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


_NODE = ("shard int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def _shard_nodes(paths: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one shard. ``key`` is set for nodes that other shards may share; their figures are partial."""
    paths = paths.sort_values("path", ignore_index=True)
    raw, n, first = paths["path"].tolist(), paths["n"].to_numpy(), paths["first_id"].to_numpy()
    before, after = bounds["before"].iloc[0], bounds["after"].iloc[0]

    units = np.frombuffer(b"".join(raw), dtype=f"V{UNIT}")
    length = np.fromiter((len(p) // UNIT for p in raw), dtype=np.int64, count=len(raw))
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    turns, code = np.unique(units, return_inverse=True) if len(units) else (units, np.zeros(0, dtype=np.int64))
    code = code.astype(np.int64) + 1
    sizes = np.frombuffer(turns.tobytes(), dtype=np.dtype([("h", "V16"), ("n", ">i8")]))["n"].astype(np.int64)
    trie = DoubleArray([code[s:s + m] for s, m in zip(start, length)], len(turns))

    size = len(trie.check)
    n_convs, least, depth = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    last_bytes, ends = np.zeros(size, np.int64), np.full(size, -1)
    on_first, on_last = np.zeros(size, bool), np.zeros(size, bool)
    at, live, d, levels = np.zeros(len(raw), np.int64), np.arange(len(raw)), 0, []
    while True:
        np.add.at(n_convs, at, n[live])
        np.minimum.at(least, at, first[live])
        here = np.unique(at)
        depth[here] = d
        levels.append(here)
        on_first[at[live == 0]] = True
        on_last[at[live == len(raw) - 1]] = True
        done = length[live] == d
        ends[at[done]] = live[done]
        at, live = at[~done], live[~done]
        if not len(live):
            break
        c = code[start[live] + d]
        at = trie.step(at, c)
        last_bytes[at] = sizes[c - 1]
        d += 1

    # a node of the first path is new here if it goes deeper than what an earlier shard shares
    new = np.ones(size, np.int64)
    new[on_first & (depth <= _shared_depth(raw[0], before))] = 0
    children = np.zeros(size, np.int64)
    local = np.zeros(size, np.int64)
    for here in levels[1:]:
        np.add.at(children, trie.check[here], new[here])
        np.add.at(local, trie.check[here], 1)
    leaves = (local == 0).astype(np.int64)
    if _shared_depth(raw[-1], after) == length[-1]:  # the last path goes on in the next shard
        leaves[ends == len(raw) - 1] = 0
    saved = (n_convs - new) * last_bytes
    for here in reversed(levels[1:]):
        np.add.at(leaves, trie.check[here], leaves[here])
        np.add.at(saved, trie.check[here], saved[here])

    nodes = np.concatenate(levels)
    shared = on_first | on_last
    keys = {}
    for which, path in ((on_first, raw[0]), (on_last, raw[-1])):
        along = nodes[which[nodes]]
        keys |= dict(zip(along[np.argsort(depth[along])].tolist(), _keys(path)))
    parent = trie.check[nodes]
    sha = paths["ends_sha256"].tolist()
    return pd.DataFrame({
        "shard": np.full(len(nodes), bounds["shard"].iloc[0], dtype=np.int32),
        "key": [keys.get(x) for x in nodes.tolist()],
        "parent_key": [keys.get(p) if p >= 0 else None for p in parent.tolist()],
        "conv_id": least[nodes], "depth": depth[nodes],
        "parent_conv_id": pd.array(np.where((parent >= 0) & ~shared[parent], least[parent], 0), dtype="Int64"),
        "n_convs": n_convs[nodes], "n_children": children[nodes], "n_leaves": leaves[nodes],
        "saved_tokens": saved[nodes], "ends_sha256": [sha[e] if e >= 0 else None for e in ends[nodes].tolist()]})


def _id_runs(batches: Iterator[pa.RecordBatch]):
    """Rows sorted by path and id become runs of joined ids, each of at most ``ID_RUN`` ids of one path."""
    held_key, held = None, []
    for b in batches:
        keys, ids = [], []
        for key, conv in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist()):
            if held and (key != held_key or len(held) == ID_RUN):
                keys.append(held_key)
                ids.append(held)
                held = []
            held_key = key
            held.append(conv)
        yield {"key": keys, "low": [r[0] for r in ids], "ids": [",".join(map(str, r)) for r in ids]}
    if held:
        yield {"key": [held_key], "low": [held[0]], "ids": [",".join(map(str, held))]}


def _digests(batches: Iterator[pa.RecordBatch]):
    """Runs sorted by path and first id become one digest a path; one run is held at a time."""
    key, h = None, None
    for b in batches:
        keys, out = [], []
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if k != key:
                if h is not None:
                    keys.append(key)
                    out.append(h.hexdigest())
                key, h = k, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield {"key": keys, "ends_sha256": out}
    if h is not None:
        yield {"key": [key], "ends_sha256": [h.hexdigest()]}


def _member_digests(members: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the ascending ids of each path. The ids of a frequent path are range-partitioned and
    joined into runs; only the digest itself, sequential by definition, reads all runs of a path in one task."""
    runs = arrow_map(members.select("key", "conv_id").repartitionByRange("key", "conv_id")
                     .sortWithinPartitions("key", "conv_id"), _id_runs, "key binary, low long, ids string")
    return arrow_map(runs.repartition("key").sortWithinPartitions("key", "low").select("key", "ids"), _digests,
                     "key binary, ends_sha256 string")


def rebuilt_paths(turns: DataFrame, head_of: Column, head_turns: Column) -> DataFrame:
    """``conv_id, path`` of every conversation: the first ``head_turns`` turns of conversation ``head_of``, then its
    own after as many. Both columns are expressions over ``conv_id``; ``head_turns`` is at most ``HEAD``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    size = F.octet_length(text).cast("long")
    # the role's length keeps (role, text) pairs apart that run together to the same characters
    unit = F.concat(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")),
                    F.lpad(F.hex(size), 16, "0"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(
            F.col("turn").cast("long").alias("turn"), role.alias("role"), unit.alias("unit")).alias("t"))
    own = cut(rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["unit"]).alias("units")),
              "trie_turns")
    head = own.select(F.col("conv_id").alias("_head"), F.slice("units", 1, HEAD).alias("_units"))
    take = head_turns.cast("int")
    both = own.withColumn("_head", head_of).join(head, "_head", "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("_units", F.array().cast("array<string>")), F.lit(1), take),
                            F.slice("units", take + 1, F.greatest(F.size("units") - take, F.lit(0)))).alias("units"))
    return both.select("conv_id", F.unhex(F.array_join("units", "")).alias("path"))


def trie_nodes(members: DataFrame, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """One row per node of the trie over ``conv_id, path`` rows (see ``prefix_trie`` for the columns)."""
    members = members.withColumn("key", F.unhex(F.md5("path")))
    paths = (members.groupBy("key").agg(F.first("path").alias("path"), F.count("*").alias("n"),
                                        F.min("conv_id").alias("first_id")).join(_member_digests(members), "key"))
    paths = cut(paths.drop("key"), "trie_paths")
    count, size = paths.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
    shards = max(1, -(-count // shard_paths), -(-size // (shard_paths * 16 * UNIT)))
    sharded = cut(paths.repartitionByRange(shards, "path").withColumn("shard", F.spark_partition_id()), "trie_shards")

    # a row per shard, no more: the last path before it and the first path after it
    order = Window.orderBy("shard")
    bounds = sharded.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high")).select(
        "shard", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    nodes = cut(sharded.groupBy("shard").cogroup(bounds.groupBy("shard")).applyInPandas(_shard_nodes, _NODE), "trie_nodes")

    part = nodes.where("key is not null")
    merged = cut(part.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256")), "trie_merged")
    ids = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above"))
    # children of shared nodes learn their parent's id shard by shard, as one node may have most children
    near = part.select("shard", F.col("key").alias("parent_key")).join(ids, "parent_key")
    whole = nodes.where("key is null")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
               F.coalesce("ends_sha256", F.lit(_NO_END)).alias("ends_sha256")]
    return (whole.where("parent_key is null").select(*columns)
            .unionByName(whole.where("parent_key is not null").drop("parent_conv_id").join(near, ["shard", "parent_key"])
                         .withColumnRenamed("_above", "parent_conv_id").select(*columns))
            .unionByName(merged.join(ids, "parent_key", "left").withColumnRenamed("_above", "parent_conv_id").select(*columns)))


def prefix_trie(turns: DataFrame, head_of: Column, head_turns: Column, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """The trie of all rebuilt conversations, one row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    ``turns`` has ``conv_id, turn, role, text``; a null role or text is empty, a null turn comes first. Turns of equal
    number are ordered by role, then by the digest of role and text; repeated rows are turns of their own. Rows
    without a ``conv_id`` belong to no conversation. ``head_of`` and ``head_turns`` are expressions over ``conv_id``
    (see ``rebuilt_paths``). A conversation left without turns ends at the root. An empty table has no node.
    The digests of one conversation's turns (``UNIT`` bytes each) are held as one row.
    """
    return trie_nodes(cut(rebuilt_paths(turns, head_of, head_turns), "trie_members"), shard_paths)


#: The registered query in DuckDB SQL. CRC-32 is spelt out: a table of 256 remainders, then one step per digit.
ORACLE_SQL = """
with crc_table as (
  select list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) order by n) as t
  from (select unnest(range(0, 256)) as n)),
rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
turns as (
  select conv_id, list({'role': role, 'text': text} order by turn nulls first, role,
                       md5(octet_length(encode(role))::varchar || ':' || role || text)) as own
  from rows group by conv_id),
heads as (
  select conv_id, own, conv_id - conv_id % 5 as head_of, xor(list_reduce(
      [4294967295] || list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 as h
  from turns, crc_table),
rebuilt as (
  select c.conv_id, list_concat(list_slice(b.own, 1, c.h), list_slice(c.own, c.h + 1, len(c.own))) as path from heads c left join turns b on b.conv_id = c.head_of),
prefixes as (
  select conv_id, len(path) as len, d, md5(list_slice(path, 1, d)::varchar) as node,
         md5(list_slice(path, 1, d - 1)::varchar) as up, path[d] as last
  from (select *, unnest(range(0, len(path) + 1)) as d from rebuilt)),
nodes as (
  select d, path_node as node, any_value(up) as up, any_value(octet_length(encode(last.text))) as bytes, min(conv_id) as conv_id,
         count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len = d), '') as ends
  from (select *, node as path_node from prefixes) group by d, path_node),
below as (
  select a.d, a.node, b.node as sub, b.d as sub_d from
    (select distinct conv_id, d, node from prefixes) a join (select distinct conv_id, d, node from prefixes) b
    on a.conv_id = b.conv_id and b.d >= a.d group by all),
kids as (select d - 1 as d, up as node, count(*) as n from nodes where d > 0 group by all),
sums as (
  select w.d, w.node, count(*) filter (k.n is null) as n_leaves,
         sum(case when s.d = 0 then 0 else (s.n_convs - 1) * s.bytes end) as saved_tokens
  from below w join nodes s on s.node = w.sub and s.d = w.sub_d left join kids k on k.node = s.node and k.d = s.d
  group by all)
select n.conv_id, n.d::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n, 0) as n_children, s.n_leaves,
       s.saved_tokens::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join sums s using (d, node) left join kids k using (d, node)
     left join nodes p on n.d > 0 and p.d = n.d - 1 and p.node = n.up"""
