"""N-gram Jaccard join: documents whose shingle sets are alike, and the groups that such links form.

A text's set is its distinct word shingles as 60-bit hashes. Equal sets are one node, known by a 64-bit hash of the set.

First comes a support filter, which is exact: a set of n entries links with another one only if at most n - ceil(t*n) of
its entries stand in no other set. Sets are cut to packed blobs by ranges of the hash, so that one task counts the sets
of each entry of its range; the first time over a SAMPLE of the ranges, then, for the few sets left, over all of them.
What remains of a set are its entries with other owners, in one global order: rare ones first, by their exact count, the
very frequent ones (by a count-min sketch of all documents, of fixed size) last; those are never sent to be counted.

Two sets that link share one of their first m - ceil(t*n) + 1 entries. Leaders: each such entry's nodes are checked
against one node of theirs, which joins large groups of near copies in time linear in their number. Entries whose nodes
are not all connected then are searched in blocks of BLOCK nodes: a task compares parity bitmaps, which bound the size of
a symmetric difference from below, and gives only pairs of different components that may link, at first the closest
pair of two components alone, last all. The sets of a probe's candidates form a prefix tree: sorted by the global order, each
continues from the depth it shares with the one before and keeps the partial overlap there, and a subtree goes as soon
as the overlap so far and what is left of the probe cannot reach the threshold. Pairs within one component add nothing
to it and are left out; none between components is.

Defined results: null and empty texts have no shingle and stand alone; rows that repeat a doc_id are members of the
groups of their own texts; a null doc_id takes its group's component, or null; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatfield.llm.common import ODD, checked_broadcast, distinct_rows, held_by, join_hot, prefix_hashes, row_key, small_batches, stored, without

#: Slots of the sketch (a power of 2) and of one of its rows; share of the hash ranges of the first count; entries that a task
#: packs, or counts, at once; nodes of a block; candidates of a probe in one task; bits of a parity bitmap.
SKETCH_BITS, SKETCH_BLOCK, SAMPLE, FLUSH, BLOCK, PROBES, PARITY = 20, 1024, 4, 1 << 20, 1024, 256, 1024
#: Entries beyond what the prefix needs that leaders share with their nodes, to leave out chance pairs early.
EXTRA = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each lower-cased word in some bytes."""
    space = np.ones(len(b) + 2, bool)
    space[1:-1] = _SPACE[b]
    turn = np.flatnonzero(space[1:] != space[:-1])
    return turn[::2], prefix_hashes(_LOWER[b], turn[::2], turn[1::2])


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct 60-bit hashes of k-word shingles; fewer words make one."""
    texts = pc.fill_null(texts, "")
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1).astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] else np.zeros(0, np.uint8)
    out: list[np.ndarray] = []
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 17), "right")) - 1)  # some texts at a time, for the cache
        lens = offsets[at + 1 : to + 1] - offsets[at:to]
        b = np.full(int(lens.sum()) + to - at, 32, np.uint8)  # with a space behind each text
        begins = np.cumsum(lens + 1) - lens - 1
        for i, begin in enumerate(begins):
            b[begin : begin + lens[i]] = data[offsets[at + i] : offsets[at + i + 1]]
        start, words = _words(b)
        first = np.searchsorted(start, np.append(begins, len(b)))
        count = np.diff(first)
        h = np.full(max(0, len(words) - k + 1), k, np.uint64)
        for i in range(k):
            h = (h ^ words[i : i + len(h)]) * ODD[i % len(ODD)]
            h ^= h >> np.uint64(29)
        for i, c in enumerate(count.tolist()):
            f = int(first[i])
            if c >= k:
                s = h[f : f + c - k + 1]
            elif c:
                s = np.full(1, c, np.uint64)
                for j in range(c):
                    s = (s ^ words[f + j]) * ODD[j % len(ODD)]
                    s ^= s >> np.uint64(29)
            else:
                out.append(np.zeros(0, np.uint64))
                continue
            s = (s ^ (s >> np.uint64(32))) * ODD[1]
            s = np.sort((s ^ (s >> np.uint64(31))) >> np.uint64(4))
            out.append(s[np.append(True, s[1:] != s[:-1])])
        at = to
    return out


def node_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(60 - SKETCH_BITS)).astype(np.int64)


def least_shared(n, percent: int):
    """The entries that a set of n must share to link at all."""
    return (percent * n + 99) // 100


def least_overlap(a, b, percent: int):
    """The entries that sets of a and b entries must share to link."""
    return -((-percent * (a + b)) // (100 + percent))


def tree(sets: dict[int, np.ndarray]) -> list[int]:
    """Keys in the order in which a walk through the sets' prefix tree meets them."""
    return sorted(sets, key=lambda k: sets[k].astype(">u8").tobytes())


def walk(probe: np.ndarray, n: int, sets: dict[int, np.ndarray], sizes: dict[int, int], percent: int) -> list[int]:
    """Keys of the sets that link with the probe, by a walk through their prefix tree.

    n and sizes are the sizes of the whole sets, of which probe and sets hold the entries that may be shared.
    """
    found, path, cum, dead, least = [], np.zeros(0, np.uint64), np.zeros(1, np.int64), None, least_shared(n, percent)
    for key in tree(sets):
        s, need = sets[key], least_overlap(n, sizes[key], percent)
        m = min(len(s), len(path))
        differ = np.flatnonzero(s[:m] != path[:m])
        depth = int(differ[0]) if len(differ) else m
        if dead is not None and depth >= dead:
            continue  # the whole subtree was given up at a depth that this set shares
        dead, parts, have, at = None, [cum[: depth + 1]], int(cum[depth]), depth
        while at < len(s):
            step = s[at : at + 64]
            pos = np.searchsorted(probe, step)
            hit = (pos < len(probe)) & (probe[np.minimum(pos, len(probe) - 1)] == step)
            sums = have + np.cumsum(hit)
            parts.append(sums)
            have, at = int(sums[-1]), at + len(step)
            left = len(probe) - int(np.searchsorted(probe, step[-1], "right"))
            if have + left < least:
                dead = at
                break
            if have + min(left, len(s) - at) < need:
                break
        cum = np.concatenate(parts)
        path = s[:at]
        if at == len(s) and dead is None and have >= need:
            found.append(key)
    return found


def parity(s: np.ndarray) -> bytes:
    """PARITY bits: whether an odd number of entries has each; bits that differ between two sets need entries that differ."""
    return np.packbits(np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).tobytes()


def likely_pairs(g: pd.DataFrame, percent: int, closest: bool) -> pd.DataFrame:
    """Of each block pair (entry, lo, hi) in g, the pairs of different labels that may link by size and bitmap; closest: for two labels only the best one."""
    g = g.sort_values(["entry", "lo", "hi", "node"])
    node, label, n, m, block = (g[c].to_numpy() for c in ("node", "label", "n", "m", "block"))
    bits = np.frombuffer(b"".join(g["bits"]), np.uint64).reshape(len(g), -1)
    key = np.stack([g[c].to_numpy() for c in ("entry", "lo", "hi")])
    cuts = np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))), len(g))
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        lo, hi = key[1, a], key[2, a]
        others = a + np.flatnonzero(block[a:b] == hi)
        found = []
        for i in (a + np.flatnonzero(block[a:b] == lo)).tolist():
            j = others[others > i] if lo == hi else others
            j = j[(label[j] != label[i]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))]
            if len(j):
                apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
                ok = apart <= m[i] + m[j] - 2 * least_overlap(n[i], n[j], percent)
                found.append(np.stack([np.full(ok.sum(), i), j[ok], apart[ok]]))
        if found:
            i, j, apart = np.concatenate(found, axis=1)
            if closest:
                x, y = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
                order = np.lexsort((apart, y, x))
                order = order[np.append(True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0))[: len(order)]]
                i, j = i[order], j[order]
            out.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]))
    return pd.DataFrame(np.concatenate(out, axis=1).T if out else np.zeros((0, 2), np.int64), columns=["a", "b"]).drop_duplicates()


class Join:
    """One join: docs(doc_id, text), words to a shingle and the threshold in percent."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.spark, self.k, self.percent = docs.sparkSession, k, percent
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.docs = rows.select("doc_id", row_key(rows).alias("key"), "text")
        first = stored(self._first(), "signatures")
        self.members = first.filter("block is null").select("doc_id", "key", "n", "node")
        levels, self.total = self._levels(first.filter("block is not null").select("block", "counts"))
        self.levels = self.spark.sparkContext.broadcast(levels)
        least = F.expr(f"100 * n >= {percent} * (n + 1)")  # smaller sets link with equal ones only
        nodes = self.members.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
        self.nodes = stored(nodes.withColumn("may", least), "nodes")

    def _first(self) -> DataFrame:
        """One scan for two tables: doc_id, key, n, node of each row, and the blocks of each task's sketch."""
        k = self.k

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = np.zeros(1 << SKETCH_BITS, np.uint32)
            for batch in batches:
                sets = shingle_sets(batch.column(2), k)
                for s in sets:
                    mine[_slot(s)] += 1  # a set has few pairs in one slot; those count once
                none = pa.nulls(len(sets), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else x for s, x in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.int64()), none, pa.nulls(len(sets), pa.binary())], ["doc_id", "key", "n", "node", "block", "counts"])
            rows = np.minimum(mine, 255).astype(np.uint8).reshape(-1, SKETCH_BLOCK)
            at = np.flatnonzero(rows.any(axis=1))
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(at.astype(np.int32)), pa.array([rows[i].tobytes() for i in at], pa.binary())], ["doc_id", "key", "n", "node", "block", "counts"])

        small_batches(self.spark)
        return self.docs.mapInArrow(sign, "doc_id long, key long, n long, node long, block int, counts binary")

    def _levels(self, blocks: DataFrame) -> tuple[np.ndarray, int]:
        """For each slot of the sketch 0 (usual) to 7 (very frequent), and about how many entries all sets have."""

        def add(g: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x, np.uint8).astype(np.uint64) for x in g["counts"])
            return pd.DataFrame({"block": g["block"][:1], "counts": [total.tobytes()]})

        sums = np.zeros(((1 << SKETCH_BITS) // SKETCH_BLOCK, SKETCH_BLOCK), np.float64)
        for row in blocks.groupBy("block").applyInPandas(add, "block int, counts binary").toLocalIterator():  # the whole sketch has 2**SKETCH_BITS counts
            sums[row.block] = np.frombuffer(row.counts, np.uint64)
        usual = 4 * sums.mean() + 8
        return np.clip(np.floor(np.log2(np.maximum(sums.ravel(), 1) / usual)) + 1, 0, 7).astype(np.uint8), int(sums.sum())

    def _chosen(self, keys: DataFrame) -> DataFrame:
        """key, text of the rows with these keys."""
        return held_by(self.docs.select("key", "text"), keys, "key")

    def _dealt(self, docs: DataFrame, parts: int, sample: int) -> DataFrame:
        """part and packed sets: nodes, their sizes, and for each entry of the part's hash range its node's place and hash.

        Very frequent entries are dealt by node, to parts from `parts` on, as nobody has to count them.
        """
        levels, k, percent = self.levels, self.k, self.percent

        def pack(nodes: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            node, size = np.array(nodes, np.int64), np.array([len(s) for s in sets], np.int64)
            of, h = np.repeat(np.arange(len(sets), dtype=np.uint16), size), np.concatenate(sets)
            level = levels.value[_slot(h)]
            part = ((h >> np.uint64(28)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            part = np.where(level > 0, parts + node[of] % parts, part)
            if sample > 1:
                used = (level == 0) & (h % np.uint64(sample) == 0)
                of, h, part = of[used], h[used], part[used]
            order = np.argsort(part.astype(np.uint16) if 2 * parts <= 65536 else part, kind="stable")
            of, h, part = of[order], h[order], part[order]
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own, at = np.unique(of[a:b], return_inverse=True)
                out.append((int(part[a]), node[own].tobytes(), size[own].astype(np.uint32).tobytes(), at.astype(np.uint16).tobytes(), h[a:b].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["part", "nodes", "sizes", "at", "hashes"])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            entries = 0
            for batch in batches:
                for s in shingle_sets(batch.column(1), k):
                    if 100 * len(s) >= percent * (len(s) + 1):
                        node = node_of(s)
                        entries += 0 if node in held else len(s)
                        held[node] = s
                    if entries > FLUSH or len(held) > 60_000:
                        yield from pack([*held], [*held.values()])
                        held, entries = {}, 0
            if held:
                yield from pack([*held], [*held.values()])

        small_batches(self.spark)
        return docs.select("key", "text").mapInArrow(deal, "part long, nodes binary, sizes binary, at binary, hashes binary")

    def _alone(self, docs: DataFrame) -> DataFrame:
        """The nodes that cannot link, as too many of their entries, of a sample, stand in no other set."""
        parts, percent = self._parts(self.total // SAMPLE), self.percent

        def count(g: pd.DataFrame) -> pd.DataFrame:
            nodes, sizes, of, h = _entries(g)
            n = np.bincount(of[_owners(h) < 2], minlength=len(nodes))
            to = np.where(n > 0, nodes % parts, -1)
            return pd.DataFrame([(int(q), nodes[to == q].tobytes(), n[to == q].astype(np.uint32).tobytes(), sizes[to == q].tobytes()) for q in np.unique(to) if q >= 0], columns=["part", "nodes", "counts", "sizes"])

        def judge(g: pd.DataFrame) -> pd.DataFrame:
            nodes, counts, sizes = (np.frombuffer(b"".join(g[c]), t) for c, t in (("nodes", np.int64), ("counts", np.uint32), ("sizes", np.uint32)))
            one, first, of = np.unique(nodes, return_index=True, return_inverse=True)
            n = sizes[first].astype(np.int64)
            return pd.DataFrame({"node": one[np.bincount(of, counts, len(one)) > n - least_shared(n, percent)]})

        counted = self._dealt(docs, parts, SAMPLE).groupBy("part").applyInPandas(count, "part long, nodes binary, counts binary, sizes binary")
        return counted.groupBy("part").applyInPandas(judge, "node long")

    def _sets(self, docs: DataFrame, entries: int) -> DataFrame:
        """node, n, m, entries (its entries with other owners, in the global order), bits of the sets that may link."""
        parts, percent, levels = self._parts(entries), self.percent, self.levels

        def count(g: pd.DataFrame) -> pd.DataFrame:
            nodes, sizes, of, h = _entries(g)
            if g["part"].iloc[0] >= parts:
                level = np.uint64(7) + levels.value[_slot(h)].astype(np.uint64)
            else:
                level = np.minimum(7, np.floor(np.log2(_owners(h)))).astype(np.uint64)
            of, ordered = of[level > 0], (h | (level << np.uint64(60)))[level > 0]
            to = nodes[of] % parts
            out = []
            for q in np.unique(to):
                mine, at = np.unique(of[to == q], return_inverse=True)
                out.append((int(q), nodes[mine].tobytes(), sizes[mine].tobytes(), at.astype(np.uint32).tobytes(), ordered[to == q].tobytes()))
            return pd.DataFrame(out, columns=["part", "nodes", "sizes", "at", "hashes"])

        def gather(g: pd.DataFrame) -> pd.DataFrame:
            nodes, sizes, of, h = _entries(g, np.uint32)
            order = np.argsort(of, kind="stable")
            h, m = h[order], np.bincount(of, minlength=len(nodes))
            out = []
            for node, n, size, end in zip(nodes.tolist(), sizes.tolist(), m.tolist(), np.cumsum(m).tolist(), strict=True):
                least = least_shared(n, percent)
                if size >= least:
                    s = h[end - size : end]
                    out.append((node, n, size, s.tobytes(), parity(s), s[: size - least + min(EXTRA, least)].view(np.int64)))
            return pd.DataFrame(out, columns=["node", "n", "m", "entries", "bits", "head"])

        counted = self._dealt(docs, parts, 1).groupBy("part").applyInPandas(count, "part long, nodes binary, sizes binary, at binary, hashes binary")
        return counted.groupBy("part").applyInPandas(gather, "node long, n long, m long, entries binary, bits binary, head array<long>")

    def _parts(self, entries: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(entries / FLUSH))

    def sets(self) -> DataFrame:
        """The sets that pass the support filter."""
        may = self.nodes.filter("may")
        # Copies of a text are left out by key: a third of all rows may hold one text.
        more = join_hot(self.members.select("key", "node"), self.nodes.filter("copies > 1").select("node", "copies", F.col("key").alias("one")), "node", "copies", self.members.count(), "inner")
        single = without(self.docs.select("key", "text"), stored(more.filter("key <> one").select("key").distinct(), "copies"), "key")
        alone = stored(self._alone(single), "alone")
        left = stored(without(may.select("node", "key", "n"), alone, "node"), "left")
        entries = left.agg(F.sum("n")).first()[0] or 0
        return stored(self._sets(self._chosen(left.select("key")), entries), "sets", compression="zstd")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) that link; a probe's candidates are dealt in parts of about PROBES."""
        percent = self.percent
        pairs = stored(pairs.select("a", "b"), "pairs")
        n = pairs.count()
        if not n:
            return pairs
        per = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size")), "probes")
        part = F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / PROBES).cast("long"))
        dealt = stored(join_hot(pairs, per, "a", "size", n, "inner").select("a", "b", F.pmod(F.xxhash64("a", part), F.lit(max(1, n // 128))).alias("box")), "dealt")
        sets = sets.select("node", "n", "entries")
        members = self._with(dealt, sets, "b").select("box", "a", "b", "n", "entries")
        probes = self._with(dealt.select("box", "a").distinct(), sets, "a").select("box", "a", F.lit(None).cast("long").alias("b"), "n", "entries")

        def check(g: pd.DataFrame) -> pd.DataFrame:
            out = []
            for a, own in g.groupby("a"):
                is_probe = own["b"].isna()
                one, rest = own[is_probe].iloc[0], own[~is_probe]
                keys = [int(b) for b in rest["b"]] if len(rest) else []
                found = {b: np.frombuffer(e, np.uint64) for b, e in zip(keys, rest["entries"], strict=True)}
                sizes = dict(zip(keys, rest["n"].tolist(), strict=True))
                out += [(a, b) for b in walk(np.frombuffer(one["entries"], np.uint64), int(one["n"]), found, sizes, percent)]
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        members = members.withColumn("b", F.col("b").cast("string"))  # a null among whole numbers would make them floats
        probes = probes.withColumn("b", F.col("b").cast("string"))
        return stored(members.unionByName(probes).groupBy("box").applyInPandas(check, "a long, b long"), "links")

    def _with(self, pairs: DataFrame, sets: DataFrame, key: str) -> DataFrame:
        """pairs with the sets of `key`, each set once to a task of the join."""
        return pairs.join(sets.withColumnRenamed("node", key), key)

    def components(self) -> tuple[DataFrame, DataFrame]:
        """node, label of all nodes with a link, and links (a, b) between nodes that were found."""
        t, sets = self.percent, self.sets()
        posts = sets.select("node", "n", F.explode("head").alias("entry"))
        lead = F.min(F.struct(F.xxhash64("node").alias("r"), F.col("node").alias("a"), F.col("n").alias("na"))).alias("lead")
        common = posts.groupBy("entry").agg(F.count(F.lit(1)).alias("uses"), lead, *_same()).filter("uses > 1")
        # Entries of the same nodes, as of a passage, count as one with their number as its weight.
        common = common.groupBy("uses", "lead", "one", "two").agg(F.min("entry").alias("entry"), F.count(F.lit(1)).alias("weight"))
        common = stored(common.select("entry", "uses", "weight", "lead.a", "lead.na"), "leads")
        posts = stored(join_hot(posts, common, "entry", "uses", posts.count(), "inner"), "posts")
        near = posts.filter(f"a <> node and 100 * least(n, na) >= {t} * greatest(n, na)")
        pairs = near.groupBy("a", F.col("node").alias("b")).agg(F.sum("weight").alias("c"), F.min(F.least("n", "na")).alias("n"))
        links = self.verified(pairs.filter(F.col("c") >= F.least(F.lit(EXTRA), F.ceil(F.col("n") * t / 100))), sets)
        label = connected(links)
        for closest in (True, False):
            pairs = self._unjoined(posts, label, sets, closest)
            if pairs is None:
                break
            new = self.verified(pairs, sets)
            if not new.isEmpty():
                links = links.unionByName(new)
                label = connected(links)
        return label, links

    def _unjoined(self, posts: DataFrame, label: DataFrame, sets: DataFrame, closest: bool) -> DataFrame | None:
        """Pairs of different components that share an entry and may link; None if there is no such entry."""
        percent = self.percent
        here = stored(_labelled(posts, label), "labelled")
        mixed = here.groupBy("entry").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("size")).filter("x < y")
        mixed = stored(mixed.select("entry", "size"), "mixed")
        n = mixed.agg(F.sum(F.col("size") * F.ceil(F.col("size") / BLOCK))).first()[0]
        if not n:
            return None
        open_ = join_hot(here.select("entry", "node", "label"), mixed, "entry", "size", n, "inner")
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        open_ = open_.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node"), blocks).cast("int")})
        # A node goes to every pair of blocks with its own; a lone block is a pair with itself.
        open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        open_ = open_.select("entry", "node", "label", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        open_ = open_.join(sets.select("node", "n", "m", "bits"), "node")
        box = F.pmod(F.xxhash64("entry", "lo", "hi"), F.lit(max(1, n // (8 * BLOCK))))
        pairs = open_.withColumn("box", box).groupBy("box").applyInPandas(lambda g: likely_pairs(g, percent, closest), "a long, b long")
        return pairs.distinct()


def _same() -> list[Column]:
    """Two values that are equal for entries of the same nodes only."""
    return [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(name) for i, name in enumerate(("one", "two"))]


def _entries(g: pd.DataFrame, places=np.uint16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct nodes and sizes, and of each distinct entry its node's place and hash, in order of hash, of all blobs of a part."""
    nodes, sizes, h = (np.frombuffer(b"".join(g[c]), t) for c, t in (("nodes", np.int64), ("sizes", np.uint32), ("hashes", np.uint64)))
    before = np.cumsum([0, *(len(x) // 8 for x in g["nodes"])])
    at = np.concatenate([np.frombuffer(x, places).astype(np.int64) + b for x, b in zip(g["at"], before, strict=False)])
    one, first, place = np.unique(nodes, return_index=True, return_inverse=True)
    of = place[at]
    order = np.lexsort((of, h))
    of, h = of[order], h[order]
    new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)]  # a repeated row's set comes twice
    return one, sizes[first], of[new], h[new]


def _owners(h: np.ndarray) -> np.ndarray:
    """For each of the sorted hashes how often it stands there."""
    group = np.cumsum(np.append(True, h[1:] != h[:-1])[: len(h)]) - 1
    return np.bincount(group)[group] if len(h) else h.astype(np.int64)


def _labelled(posts: DataFrame, label: DataFrame) -> DataFrame:
    return looked_up(posts.select("entry", "node"), label, "node", "left").withColumn("label", F.coalesce("label", "node"))


def looked_up(df: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """df with the one row of the stored table that its key has: by a broadcast if the table is counted to be small, else with hot keys apart."""
    small = checked_broadcast(table)
    if small is not table:
        return df.join(small, key, how)
    total = df.count()
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    return join_hot(df, table.join(sizes, key), key, "_size", total, how).drop("_size")


def connected(links: DataFrame) -> DataFrame:
    """node, label (the least node that links reach) of every node with a link: least label around, then label of the label, until nothing changes."""
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(ends.unionByName(ends.select("a", F.col("a").alias("b"))).distinct(), "edges")
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "labels")
    while True:
        near = looked_up(both, label.withColumnRenamed("node", "b"), "b")
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("label")))
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"), own.alias("old"))
        up = label.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = stored(looked_up(near, up, "label").select("node", "old", F.least("label", "up").alias("label")), "labels")
        label = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return label


def _classes(join: Join) -> DataFrame:
    """node, copies, component, one (doc_id and key of the row that stands for it) of nodes with a link or several rows."""
    label, _ = join.components()
    nodes = join.nodes.join(label, "node", "left").filter("copies > 1 or label is not null").withColumn("label", F.coalesce("label", "node"))
    one = F.struct(F.col("first").isNull().alias("null"), F.col("first").alias("doc_id"), F.col("key"))
    least = stored(nodes.groupBy("label").agg(F.min(one).alias("one"), F.count(F.lit(1)).alias("size")), "components")
    return stored(join_hot(nodes.select("label", "node", "copies"), least, "label", "size", least.count(), "inner").select("node", "copies", F.col("one.doc_id").alias("component")), "classes")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    join = Join(docs, k, percent)
    out = join_hot(join.members, _classes(join), "node", "copies", join.members.count())
    own = F.when((F.col("n") > 0) & F.col("copies").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each component one row with the smallest doc_id (null only where there is no other)."""
    join = Join(docs, k, percent)
    label, _ = join.components()
    nodes = looked_up(join.nodes.select("node"), label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = looked_up(join.members.filter("n > 0").select("doc_id", "key", "node"), stored(nodes, "node-labels"), "node")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")
    stays = stored(rows.groupBy("label").agg(F.min(order).alias("one")).select("label", F.col("one.key").alias("one")), "stays")
    gone = looked_up(rows.select("key", "label"), stays, "label").filter("key <> one").select("key").distinct()
    return distinct_rows(docs, stored(gone, "gone"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)


QUERIES, ORACLES = {"op9_jaccard_join": op9_jaccard_join}, {}
