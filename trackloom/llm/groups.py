"""Links inside groups of alike items, without all pairs of a group.

Items come as members of groups (lists). In rounds, each group gives a spanning forest of the likeliest pairs between its
components, and these are verified; a group wider than a block is split into blocks, each component of which one member
stands for in the next round. Last, for lists with further pairs that pass the caller's filter, those between components that are
still apart are verified. So a group of near copies costs about as many verifications as it has members, and no link that would join
two components is lost.

Where the payload is enough to verify (`Likeness.verify`), a group is settled where it lies: pairs never become rows, only links do
(`components_in_place`).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, drop_written, mix64, ragged_index
from .components import connected

BLOCK = 512


class Likeness:
    """What the members of a group carry, and which two of them may be linked. Subclasses work on many members at once, as arrays."""

    #: Columns of the payload.
    columns: tuple[str, ...] = ()

    def load(self, columns: list):
        """The payload of Arrow columns, as a list of arrays with a row a member or of whatever `take` can pick from."""
        raise NotImplementedError

    def take(self, loaded, rows: np.ndarray):
        return [x[rows] for x in loaded]

    def reach(self, loaded) -> tuple[np.ndarray, np.ndarray]:
        """(low, high), non-negative whole numbers below 2^40, both rising with the key: members i before j may be linked only if low of j is at most high of i.

        Members of a group are sorted by low."""
        raise NotImplementedError

    def test(self, loaded, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs (i before j) may be linked, and of those how far apart they seem."""
        raise NotImplementedError

    def verify(self, loaded, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs are linked, where the payload tells."""
        raise NotImplementedError


def _forest(group, i, j, d, comp):
    """(pairs of a spanning forest of the nearest pairs between components, groups with further pairs), of pairs sorted by group and distance."""
    kept = np.zeros(len(i), bool)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    kept[starts] = True
    more = []
    for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        held_back = False
        for k, x, y in zip(range(s, s + n), comp[i[s : s + n]].tolist(), comp[j[s : s + n]].tolist()):
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
                kept[k] = True
            else:
                held_back = True
        if held_back:
            more.append(int(group[s]))
    return np.flatnonzero(kept), more


#: Rows of complete groups that are worked on at once, and pairs of them that are tested at once.
_ROWS, _TESTED = 1 << 14, 1 << 16


def _candidates(table, like: Likeness, exhaustive: bool):
    """(payload, list, id, component, group, i, j, d): rows of complete groups with more than one component, and their pairs that may be linked."""
    numbers = [table.column(k).to_numpy() for k in range(5)]
    loaded = like.load([table.column(k) for k in range(5, table.num_columns)])
    low, _ = like.reach(loaded)
    order = np.lexsort((numbers[2], low, numbers[1], numbers[0]))
    lists, block, ids, comp, part = (x[order] for x in numbers)
    new = np.append(True, (lists[1:] != lists[:-1]) | (block[1:] != block[:-1]))[: len(lists)]
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    apart = (np.minimum.reduceat(comp, starts) < np.maximum.reduceat(comp, starts))[group] if len(starts) else np.zeros(0, bool)
    across = (np.minimum.reduceat(part, starts) < np.maximum.reduceat(part, starts))[group] if len(starts) else np.zeros(0, bool)
    rows = np.flatnonzero(apart)
    lists, ids, comp, part, group, across = (x[rows] for x in (lists, ids, comp, part, group, across))
    loaded = like.take(loaded, order[rows])
    low, high = like.reach(loaded)
    base = group.astype(np.int64) << 40
    end = np.searchsorted(base + low, base + high, side="right")
    count = np.maximum(end - np.arange(len(rows)) - 1, 0)
    found = []
    done, sums = 0, np.cumsum(count)
    while done < len(rows):
        last = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + _TESTED, side="right")))
        i = np.repeat(np.arange(done, last), count[done:last])
        j = ragged_index(np.arange(done, last) + 1, count[done:last])
        use = comp[i] != comp[j]
        if exhaustive:
            use &= (part[i] != part[j]) | ~across[i]
        i, j = i[use], j[use]
        if len(i):
            ok, d = like.test(loaded, i, j)
            found.append((i[ok], j[ok], d))
        done = last
    i, j, d = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return loaded, lists, ids, comp, group, i, j, d


def _pairs_of(table, like: Likeness, exhaustive: bool):
    """(list, a, b) arrays of the pairs to verify of complete groups, and the lists with pairs held back."""
    _, lists, ids, comp, group, i, j, d = _candidates(table, like, exhaustive)
    more: list[int] = []
    if not exhaustive and len(i):
        order = np.lexsort((d, group[i]))
        i, j = i[order], j[order]
        kept, held = _forest(group[i], i, j, d[order], comp)
        more = np.unique(lists[np.searchsorted(group, held)]).tolist() if held else []
        i, j = i[kept], j[kept]
    return lists[i], ids[i], ids[j], more


#: Rounds in which each component's nearest pair is verified, at least; more follow while one in so many is a link. Pairs that are verified at once thereafter.
_NEAREST, _FEW, _AT_ONCE = 4, 8, 1 << 14


def _links_of(table, like: Likeness, exhaustive: bool):
    """(a, b) arrays of the components of verified pairs, which join those of complete groups as all their links do. Components are the
    same in all groups of the table, so that a pair that one group has joined costs nothing in the next."""
    loaded, _, ids, comp, _, i, j, d = _candidates(table, like, exhaustive)
    a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    order = np.lexsort((b, a))
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))[: len(order)]
    order = order[new]
    i, j, a, b = (x[order[np.argsort(d[order], kind="stable")]] for x in (i, j, a, b))
    _, node = np.unique(comp, return_inverse=True)
    root = np.arange(node.max() + 1 if len(node) else 0)
    found = [(np.zeros(0, np.int64),) * 2]
    rounds, fruitful = 0, True
    while len(i):
        x, y = root[node[i]], root[node[j]]
        apart = x != y
        i, j, a, b, x, y = (v[apart] for v in (i, j, a, b, x, y))
        if rounds < _NEAREST or fruitful:  # pairs are in order of distance
            _, first = np.unique(np.concatenate([x, y]), return_index=True)
            pick = np.zeros(len(i), bool)
            pick[first % max(len(i), 1)] = True
        else:
            pick = np.arange(len(i)) < _AT_ONCE
        ok = like.verify(loaded, i[pick], j[pick])
        linked = np.flatnonzero(pick)[ok]
        fruitful = _FEW * len(linked) > len(ok)
        found.append((comp[i[linked]], comp[j[linked]]))
        for p, q in zip(x[linked].tolist(), y[linked].tolist()):
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            root[max(p, q)] = min(p, q)
        while (root[root] != root).any():
            root = root[root]
        i, j, a, b = (v[~pick] for v in (i, j, a, b))
        rounds += 1
    return tuple(np.concatenate(v) for v in zip(*found))


def _complete_groups(batches, most_bytes: int = 1 << 62, most_rows: int = _ROWS):
    """Tables of whole groups of sorted batches, whose first two columns name the group, of about so many rows or bytes."""
    import pyarrow as pa

    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n < most_rows and size < most_bytes:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        lists, block = table.column(0).to_numpy(), table.column(1).to_numpy()
        cut = int(np.flatnonzero((lists != lists[-1]) | (block != block[-1]))[-1]) + 1 if lists[0] != lists[-1] or block[0] != block[-1] else 0
        if cut:  # the last group may go on
            yield table.slice(0, cut)
            held, n = table.slice(cut).to_batches(), n - cut
            size = sum(x.nbytes for x in held)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs(members: DataFrame, like: Likeness, exhaustive: bool) -> DataFrame:
    """(list, a, b): pairs to verify of each (list, block), and for a list with more pairs that pass, held back, a row without a and b."""
    import pyarrow as pa

    def run(batches):
        for table in _complete_groups(batches):
            lists, a, b, more = _pairs_of(table, like, exhaustive)
            none = pa.nulls(len(more), pa.int64())
            columns = [pa.concat_arrays([pa.array(x, pa.int64()), y]) for x, y in ((lists, pa.array(more, pa.int64())), (a, none), (b, none))]
            yield pa.RecordBatch.from_arrays(columns, ["list", "a", "b"])

    grouped = members.select("list", F.col("block").cast("long").alias("block"), "id", "comp", F.col("part").cast("long").alias("part"), *like.columns)
    grouped = grouped.repartition("list", "block").sortWithinPartitions("list", "block")
    pairs = grouped.mapInArrow(run, "list bigint, a bigint, b bigint")
    return pairs.select("list", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components_of_groups(members: DataFrame, like: Likeness, verify: Callable[[DataFrame], DataFrame], block: int = 0) -> DataFrame | None:
    """(id, component) of all members that are linked with another, by the components of all links; None without groups.

    members: list, m (its width), id and the payload. verify: takes a table of pairs, returns the linked ones (both written).
    """
    block, payload = block or BLOCK, list(like.columns)
    widest = members.agg(F.coalesce(F.max("m"), F.lit(0))).first()[0]
    links, tested, more = None, None, members.filter(F.col("m") > block).select("list")
    labels = None

    def with_components() -> DataFrame:
        if labels is None:
            return members.withColumn("comp", F.col("id"))
        return members.join(labels, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")

    def add(proposed: DataFrame, proven: DataFrame | None = None) -> None:
        nonlocal links, tested, more, labels
        proposed = cut_lineage(proposed)
        more = more.unionByName(proposed.filter("a is null").select("list"))
        pairs = proposed.filter("a is not null").select("a", "b").distinct()
        pairs = cut_lineage(pairs if proven is None else pairs.join(proven, ["a", "b"], "left_anti"))
        good = verify(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if labels is not None and good.isEmpty():
            return
        links = good if links is None else links.unionByName(good)
        labels = connected(links).withColumnRenamed("node", "id")

    while widest > 1:
        held = with_components()
        if links is not None:  # one member stands for its component
            held = held.groupBy("list", "comp").agg(F.min(F.struct("id", *payload)).alias("x"), F.first("m").alias("m")).select("list", "m", "comp", "x.*")
        parts = F.least(F.ceil(F.lit(widest / block)), F.ceil(F.col("m") / block))
        add(_pairs(held.withColumn("block", F.pmod(F.xxhash64("comp"), parts)).withColumn("part", F.lit(0)), like, False))
        widest = widest // block if widest > block else 0
    if labels is None:
        return None
    held = with_components()
    apart = held.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("list")
    parts = F.ceil(F.col("m") / (2 * block))
    held = held.join(apart.join(more.distinct(), "list", "left_semi"), "list", "left_semi").withColumn("part", F.pmod(F.xxhash64("id"), parts))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    held = held.withColumn("block", F.least("part", "other") * (1 << 31) + F.greatest("part", "other"))
    add(_pairs(held, like, True), tested)
    return labels


#: Bytes of payload, and rows with it, that are worked on at once: many, so that pairs of a size are many.
_PAYLOAD, _PAYLOAD_ROWS = 16 << 20, 1 << 16


def components_in_place(members: DataFrame, payload: DataFrame, like: Likeness, block: int = 0) -> DataFrame | None:
    """As components_of_groups, with groups settled where they lie (see Likeness.verify).

    members: list, m (its width), home (an id that groups alike share, they are worked on together) and id. payload: id and the payload.
    """
    import pyarrow as pa

    block = block or BLOCK
    widest = members.agg(F.coalesce(F.max("m"), F.lit(0))).first()[0]
    labels = None

    def run(exhaustive):
        def work(batches):
            for table in _complete_groups(batches, _PAYLOAD, _PAYLOAD_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _links_of(table, like, exhaustive)], ["a", "b"])

        return work

    def add(full: DataFrame, exhaustive: bool) -> None:
        nonlocal labels
        full = full.select("list", F.col("block").cast("long").alias("block"), "id", "comp", F.col("part").cast("long").alias("part"), *like.columns, "home")
        full = full.repartition("home", "block").sortWithinPartitions("home", "list", "block").drop("home")
        joined = connected(full.mapInArrow(run(exhaustive), "a bigint, b bigint"))
        if labels is None:
            labels = joined.withColumnRenamed("node", "id")
        elif not joined.isEmpty():  # components join, not their members: links that are settled are not read again
            joined = joined.withColumnRenamed("component", "whole")
            known = labels.join(joined.withColumnRenamed("node", "component"), "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
            single = joined.join(labels.select(F.col("id").alias("node")), "node", "left_anti").select(F.col("node").alias("id"), F.col("whole").alias("component"))
            labels = cut_lineage(known.unionByName(single))

    def with_components(some: DataFrame) -> DataFrame:
        return some.join(labels, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")

    if widest < 2:
        return None
    parts = F.least(F.ceil(F.lit(widest / block)), F.ceil(F.col("m") / block))
    held = cut_lineage(members.join(payload, "id"))  # texts meet their groups once
    add(held.withColumn("comp", F.col("id")).withColumn("block", F.pmod(F.xxhash64("comp"), parts)).withColumn("part", F.lit(0)), False)
    written = [held]
    if widest > block:
        wide = cut_lineage(held.filter(F.col("m") > block).select("list", "m", "home", "id"))
        payload = cut_lineage(held.filter(F.col("m") > block).select("id", *like.columns).dropDuplicates(["id"]))
        written += [wide, payload]
    while widest > block:  # one member stands for its component
        widest = widest // block
        if widest > 1:
            held = with_components(wide).groupBy("list", "comp").agg(F.min("id").alias("id"), F.first("m").alias("m"), F.first("home").alias("home"))
            parts = F.least(F.ceil(F.lit(widest / block)), F.ceil(F.col("m") / block))
            add(held.join(payload, "id").withColumn("block", F.pmod(F.xxhash64("comp"), parts)).withColumn("part", F.lit(0)), False)
    if len(written) > 1:
        held = with_components(wide)
        apart = held.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("list")
        parts = F.ceil(F.col("m") / (2 * block))
        held = held.join(apart, "list", "left_semi").withColumn("part", F.pmod(F.xxhash64("id"), parts))
        held = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        add(held.join(payload, "id").withColumn("block", F.least("part", "other") * (1 << 31) + F.greatest("part", "other")), True)
    drop_written(members.sparkSession, *written)
    return labels


#: A bit filter that tells which ids are certainly not wanted: words of 64 bits, 2 MB in all.
FILTER_WORDS = 1 << 18


def wanted_bits(ids: DataFrame) -> np.ndarray:
    """The filter's words for a table of ids (column id). Its size is fixed; with very many ids it lets more through."""
    import pyarrow as pa

    def places(batches):
        for batch in batches:
            place = np.unique(mix64(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(FILTER_WORDS * 64))
            word = (place >> np.uint64(6)).astype(np.int64)
            if len(word):
                edge = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                bits = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), edge)
                yield pa.RecordBatch.from_arrays([pa.array(word[edge]), pa.array(bits.view(np.int64))], ["w", "bits"])

    rows = ids.select("id").mapInArrow(places, "w bigint, bits bigint").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_WORDS, np.uint64)
    bits[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bits


def wanted_hashes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the ids (64-bit) may be among those that the filter was made of."""
    place = mix64(ids.view(np.uint64)) % np.uint64(FILTER_WORDS * 64)
    return ((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
