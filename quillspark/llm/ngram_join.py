"""Exact Jaccard self-join on word n-grams by prefix trees.

Two sets with a Jaccard similarity of at least t share an n-gram among the first
n - ceil(t n) + 1 of either one, under any order of all n-grams. The order here
is rare first, by a sketch of document frequencies of fixed size over the whole
table, so passages that many documents share seldom stand in a prefix.

1. One pass takes each text's set, its size and a fingerprint; equal sets are
   one node from there on. The same pass fills the sketch.
2. A second pass deals out prefix n-grams, packed by bucket. In a bucket, the
   nodes that share a prefix n-gram form a group named by its leader, the
   smallest of them; n-grams with the same leader share one group, and nodes whose sizes differ too
   much never do, so a pair
   that has to be compared meets in at least one group.
3. Groups get the texts of their nodes: first each node with one leader only, then
   the groups whose nodes are not yet in one component. Groups of more than GROUP nodes are cut
   into blocks and every pair of blocks is a task of its own. Each task stores
   the sets in a radix trie, common n-grams first, and searches it for one set
   at a time: the overlap with a shared edge is counted once for all sets below
   it, and a subtree is left as soon as the n-grams that remain cannot reach the
   overlap its sets need. Sets that are linked already are not compared again.
4. Links between nodes are joined to components by label propagation.

N-grams and sets are told apart by 64-bit hashes. Edge cases: null and empty
texts have no n-grams and link with nothing; a text shorter than n words is one
n-gram, its whole sequence; equal texts link; repeated ids are kept as rows;
texts are read whole; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SENT, bound_batches, coded, drop, hash_words, met, mix, owner, runs, split_words, tidy, unzipped, written, zipped
from quillspark.llm.components import components

WORDS = 5
#: Similarity in hundredths.
PERCENT = 80
#: Counters of the document-frequency sketch, and the rows it travels in.
SKETCH, BLOCKS = 1 << 24, 64
_SHIFT = np.uint64(64 - 24)
#: Nodes that meet in one task, at most about; larger groups are cut into blocks.
GROUP = 1024
#: Tasks that a leader is dealt to if there are too many leaders to be sent to all tasks.
SALTS = 64
#: Documents behind an n-gram, by the sketch, above which its bucket is split by pairs of salts.
HOT = 1 << 17
#: Prefix n-grams that one bucket holds, about, and that a task packs at a time.
BUCKET, PACK = 1_000_000, 600_000

#: Distinct offsets for the places in an n-gram.
_STEPS = np.arange(1, 65, dtype=np.uint64) * np.array(0x9E3779B97F4A7C15, np.uint64)
_ZERO = np.zeros(0, np.uint64)


def shingle_sets(text: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts as one array, and the offsets of each text in it."""
    flat, offsets = split_words(text, lower=True)
    codes, distinct = coded(flat)
    n, rows = len(codes), len(offsets) - 1
    if not n:
        return _ZERO, np.zeros(rows + 1, np.int64)
    h = hash_words(distinct)[codes]
    row = owner(offsets)
    rolled = np.zeros(n, np.uint64)
    size = np.diff(offsets)
    for k in range(words):
        part = mix(h + _STEPS[k])
        if k < n:
            rolled[: n - k] += part[k:]
    full = np.zeros(n, bool)
    if n >= words:
        full[: n - words + 1] = row[words - 1 :] == row[: n - words + 1]
    # A short text is one n-gram of its own length: the same sum over fewer words.
    short = np.flatnonzero((size > 0) & (size < words))
    extra = np.empty(len(short), np.uint64)
    for j, r in enumerate(short):
        a, b = offsets[r], offsets[r + 1]
        at = h[a:b] + _STEPS[: b - a]
        extra[j] = mix(at).sum(dtype=np.uint64) ^ np.uint64(b - a)
    value = np.concatenate((mix(rolled[full]), mix(extra)))
    own = np.concatenate((row[full], short))
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[new], own[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(own, minlength=rows))))


def fingerprints(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit value for each set; sets are equal exactly if these are, but for hash collisions."""
    import xxhash

    data, at = memoryview(values.tobytes()), (offsets * 8).tolist()
    return np.fromiter((xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)), np.uint64, len(at) - 1).view(np.int64)


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of kind 0 (id, n, fp), and of kind 1 (block, data): parts of the task's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen, kind = np.zeros(SKETCH, np.uint32), set(), None
        for b in batches:
            kind = b.schema.field(0).type
            values, offsets = shingle_sets(b.column(1))
            fp, n, rows = fingerprints(values, offsets), np.diff(offsets), len(b)
            fresh = np.fromiter((x not in seen and not seen.add(x) for x in fp.tolist()), bool, rows)
            if len(seen) > 1_000_000:
                seen.clear()
            np.add.at(sketch, (values[np.repeat(fresh, n)] >> _SHIFT).astype(np.int64), np.uint32(1))
            nil = lambda t: pa.nulls(rows, t)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int32)), b.column(0), pa.array(n, pa.int64()), pa.array(fp), nil(pa.int32()), nil(pa.binary())], ["kind", "id", "n", "fp", "block", "data"])
        if kind is not None:
            parts = [zipped(x) for x in np.split(sketch, BLOCKS)]
            nil = lambda t: pa.nulls(BLOCKS, t)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(BLOCKS, np.int32)), nil(kind), nil(pa.int64()), nil(pa.int64()), pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], ["kind", "id", "n", "fp", "block", "data"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"kind int, id {kind}, n long, fp long, block int, data binary")


def _levels(scanned: DataFrame) -> np.ndarray:
    """Quarter powers of two of the estimated document frequency, for every counter: SKETCH bytes on the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["block"]):
            total = np.zeros(SKETCH // BLOCKS, np.uint64)
            for data in t.column("data").to_pylist():
                total += unzipped(data, np.uint32)
            level = np.minimum(np.round(4 * np.log2(1.0 + total)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([t.column("block").combine_chunks().slice(0, 1), pa.array([level.tobytes()], pa.binary())], ["block", "level"])

    parts = scanned.where("kind = 1").select("block", "data").repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, level binary")
    out = np.zeros((BLOCKS, SKETCH // BLOCKS), np.uint8)
    for r in written(parts, "levels").toLocalIterator():  # a few blocks at a time
        out[r.block] = np.frombuffer(r.level, np.uint8)
    return out.reshape(-1)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (PERCENT * n + 99) // 100 + (n > 0)


def _prefixes(docs: DataFrame, text_col: str, levels, buckets: int) -> DataFrame:
    """(bucket, data): packed pairs of 40-bit n-gram and node of all prefixes."""

    def packed(token: np.ndarray, node: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = (mix(token) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((token, bucket))
        token, node, size, bucket = token[order], node[order], size[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        keys, data = [], []
        for k in range(buckets):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                names, first, idx = np.unique(node[a:b], return_index=True, return_inverse=True)
                parts = [zipped(np.diff(token[a:b], prepend=np.uint64(0))), zipped(names), zipped(size[a:b][first]), zipped(idx.astype(np.uint32))]
                keys.append(k)
                data.append(b"".join([np.array([len(p) for p in parts], np.uint32).tobytes(), *parts]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen, held, count = levels.value, set(), [], 0
        for b in batches:
            values, offsets = shingle_sets(b.column(0))
            fp, n = fingerprints(values, offsets), np.diff(offsets)
            fresh = np.fromiter((x not in seen and not seen.add(x) for x in fp.tolist()), bool, len(fp)) & (n > 0)
            if len(seen) > 1_000_000:
                seen.clear()
            rank = level[(values >> _SHIFT).astype(np.int64)]
            own = owner(offsets)
            order = np.lexsort((values, rank, own))  # a row's values stay in its place, rare first
            place = np.arange(len(values)) - offsets[own]
            chosen = order[(place < prefix_length(n)[own]) & fresh[own]]
            token, node, size, est = values[chosen] & np.uint64((1 << 40) - 1), fp[own[chosen]], n[own[chosen]].astype(np.uint32), 2.0 ** (rank[chosen] / 4.0)
            hot = est > HOT
            if hot.any():
                extra_t, extra_n, extra_s = [], [], []
                for t, x, z, e in zip(token[hot], node[hot], size[hot], est[hot], strict=True):
                    salts = int(np.ceil(e / HOT))
                    mine = int(mix(np.array([x]).view(np.uint64))[0] % np.uint64(salts))
                    pairs = np.array([[min(mine, j), max(mine, j)] for j in range(salts)], np.uint64)
                    extra_t.append(mix(t + (pairs[:, 0] << np.uint64(42)) + (pairs[:, 1] << np.uint64(53))) & np.uint64((1 << 40) - 1))
                    extra_n.append(np.full(salts, x))
                    extra_s.append(np.full(salts, z))
                token, node, size = np.concatenate((token[~hot], *extra_t)), np.concatenate((node[~hot], *extra_n)), np.concatenate((size[~hot], *extra_s))
            held.append((token, node, size))
            count += len(token)
            if count > PACK:
                yield from packed(*map(np.concatenate, zip(*held, strict=True)))
                held, count = [], 0
        if count:
            yield from packed(*map(np.concatenate, zip(*held, strict=True)))

    return docs.select(text_col).mapInArrow(run, "bucket int, data binary")


def _leaders(packed: DataFrame, buckets: int) -> DataFrame:
    """(leader, node, rank of the leader) of all groups of at least two nodes, the leader included."""

    def one(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        tokens, nodes, sizes = [], [], []
        for data in parts:
            at = np.cumsum([16, *np.frombuffer(data, np.uint32, 4).tolist()])
            t, names, size, idx = (unzipped(data[i:j], k) for i, j, k in zip(at[:-1], at[1:], (np.uint64, np.int64, np.uint32, np.uint32), strict=True))
            tokens.append(np.cumsum(t, dtype=np.uint64))
            nodes.append(names[idx])
            sizes.append(size[idx])
        token, node, size = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(sizes)
        _, inverse, counts = np.unique(token, return_inverse=True, return_counts=True)
        shared = counts[inverse] > 1
        token, node, size = inverse[shared], node[shared], size[shared]
        # Similar sets are of one size class or of neighbouring ones, so every node stands in two of them.
        size = np.floor(np.log(size) / np.log(100.01 / PERCENT)).astype(np.int64)
        token, node = np.concatenate((token * 256 + size, token * 256 + size + 1)), np.concatenate((node, node))
        rank = mix(node.view(np.uint64))
        order = np.lexsort((rank, token))
        token, node = token[order], node[order]
        first = np.ones(len(token), bool)
        first[1:] = token[1:] != token[:-1]
        leader = node[np.flatnonzero(first)[np.cumsum(first) - 1]]
        # The leader itself joins its group where another node does.
        other = leader != node
        pair = np.unique(np.stack((leader[other], node[other]), axis=1), axis=0)
        heads = np.unique(pair[:, 0])
        return np.concatenate((pair[:, 0], heads)), np.concatenate((pair[:, 1], heads))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["bucket"]):
            a, b = one(t.column("data").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array((mix(a.view(np.uint64)) >> np.uint64(1)).astype(np.int64))], ["leader", "node", "rank"])

    dealt = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "leader long, node long, rank long").distinct()


class Trie:
    """Radix trie over sets as sequences in one order; every set ends at a node of its own."""

    def __init__(self, sequences: list[np.ndarray]):
        order = sorted(range(len(sequences)), key=lambda i: sequences[i].astype(">u4").tobytes())
        self.parent, self.lo, self.hi, self.depth, self.ends = [-1], [0], [0], [0], [[]]
        self.flat = np.concatenate([sequences[i] for i in order]) if order else np.zeros(0, np.int64)
        path, at, before = [0], 0, None
        for i in order:
            seq = sequences[i]
            common = 0
            if before is not None:
                m = min(len(seq), len(before))
                differ = np.flatnonzero(seq[:m] != before[:m])
                common = int(differ[0]) if len(differ) else m
            while self.depth[path[-1]] > common and self.depth[self.parent[path[-1]]] >= common:
                path.pop()
            top = path[-1]
            if self.depth[top] > common:  # the edge to top is cut where the new sequence leaves it
                up = self.parent[top]
                middle = self._node(up, self.lo[top], self.hi[top] - (self.depth[top] - common), common)
                self.parent[top], self.lo[top] = middle, self.hi[middle]
                path[-1] = top = middle
            if len(seq) > common:
                top = self._node(top, at + common, at + len(seq), len(seq))
                path.append(top)
            self.ends[top].append(i)
            at, before = at + len(seq), seq
        n = len(self.parent)
        self.children: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            self.children[self.parent[k]].append(k)
        self.least, self.most = [1 << 60] * n, [0] * n
        for k in self._down()[::-1]:
            own = [len(sequences[i]) for i in self.ends[k]]
            self.least[k] = min([*own, *(self.least[c] for c in self.children[k])], default=1 << 60)
            self.most[k] = max([*own, *(self.most[c] for c in self.children[k])], default=0)

    def _node(self, parent: int, lo: int, hi: int, depth: int) -> int:
        self.parent.append(parent)
        self.lo.append(lo)
        self.hi.append(hi)
        self.depth.append(depth)
        self.ends.append([])
        return len(self.parent) - 1

    def _down(self) -> list[int]:
        out, todo = [], [0]
        while todo:
            k = todo.pop()
            out.append(k)
            todo += self.children[k]
        return out

    def similar(self, sequence: np.ndarray, universe: int) -> list[int]:
        """Sets whose similarity to this one is at least PERCENT hundredths."""
        mine, a = np.zeros(universe + 1, np.int32), len(sequence)
        mine[sequence + 1] = 1
        total = np.concatenate(([0], np.cumsum(mine[self.flat + 1])))
        found, todo = [], [(0, 0)]
        while todo:
            k, matched = todo.pop()
            matched += int(total[self.hi[k]] - total[self.lo[k]])
            least, most = self.least[k], self.most[k]
            if 100 * most < PERCENT * a or PERCENT * least > 100 * a:
                continue
            reach = matched + min(a - matched, most - self.depth[k])
            if (100 + PERCENT) * reach < PERCENT * (a + max(least, (PERCENT * a + 99) // 100)):
                continue
            if self.ends[k] and (100 + PERCENT) * matched >= PERCENT * (a + self.depth[k]):
                found += self.ends[k]
            todo += [(c, matched) for c in self.children[k]]
        return found


def group_links(sets: list[np.ndarray], labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets of the group that similarities connect; within a component they form a tree.

    Sets with the same label are known to be connected and are neither compared nor linked again.
    """
    m = len(sets)
    if m < 2:
        return []
    every = np.concatenate(sets)
    distinct, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(distinct), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(distinct))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    sequences = [np.sort(x) for x in np.split(rank[inverse], cuts)]
    trie = Trie(sequences)
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []
    first: dict[int, int] = {}
    for i, label in enumerate(labels or range(m)):
        parent[i] = first.setdefault(label, i)
    waiting: dict[int, set[int]] = {}  # sets that have not searched yet, by component
    for i in range(m):
        waiting.setdefault(root(i), set()).add(i)
    while len(waiting) > 1:
        # A pair in two components is still open only if neither has searched.
        at = min(waiting, key=lambda k: len(waiting[k]))
        i = waiting[at].pop()
        if not waiting[at]:
            del waiting[at]
        for j in trie.similar(sequences[i], len(distinct)):
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                links.append((i, j))
                joined = waiting.pop(a, set()) | waiting.pop(b, set())
                if joined:
                    waiting[a] = joined
    return links


def _by_leader(rows: DataFrame, leaders: DataFrame, how: str, name: str = "leader", own: str = "node") -> DataFrame:
    """rows joined to a written table with one row for each name: sent to all tasks if it is small, else by salted names, so that no large group is one task."""
    if leaders.count() <= SENT:
        return rows.join(F.broadcast(leaders), name, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return rows.withColumn("salt", F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int")).join(leaders.withColumn("salt", salts).hint("merge"), [name, "salt"], how).drop("salt")


def _grouped(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between nodes, from groups (leader, node, label) and texts (fp, z)."""
    # Only groups that are cut need their size, at most one for each GROUP rows.
    large = groups.groupBy("leader").agg(F.count("*").alias("size")).where(F.col("size") > GROUP)
    large = written(large.select("leader", F.ceil(2 * F.col("size") / GROUP).cast("int").alias("blocks")), "large")
    cut = _by_leader(groups, large, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("leader", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "node", "label")
    rows = dealt.join(texts.hint("merge"), F.col("node") == F.col("fp")).select("leader", "x", "y", "node", "label", "z")
    rows = rows.repartition("leader", "x", "y").sortWithinPartitions("leader", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for t in runs(batches, ["leader", "x", "y"]):
            node, first = np.unique(t.column("node").to_numpy(), return_index=True)
            texts = [unzip.decompress(z) for z in t.column("z").take(pa.array(first)).to_pylist()]
            sets: list[np.ndarray] = []
            for i in range(0, len(texts), 256):
                values, offsets = shingle_sets(pa.array(texts[i : i + 256], pa.binary()).cast(pa.string()))
                sets += np.split(values, offsets[1:-1])
            links = group_links(sets, t.column("label").take(pa.array(first)).to_pylist())
            if links:
                at = np.array(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(fp, z): the compressed text of every set, at least once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=3), set()
        for b in batches:
            values, offsets = shingle_sets(b.column(0))
            fp = fingerprints(values, offsets)
            rows = [i for i, (x, n) in enumerate(zip(fp.tolist(), np.diff(offsets).tolist(), strict=True)) if n and x not in seen and not seen.add(x)]
            if len(seen) > 1_000_000:
                seen.clear()
            taken = b.column(0).take(pa.array(rows, pa.int64())).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(fp[rows]), pa.array([pack.compress(x) for x in taken], pa.binary())], ["fp", "z"])

    return docs.select(text_col).mapInArrow(run, "fp long, z binary")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    scanned = written(_scan(docs, id_col, text_col), "sets")
    levels = spark.sparkContext.broadcast(_levels(scanned))  # SKETCH bytes, whatever the table
    total = scanned.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * (100 - PERCENT) / 100 / BUCKET) + 1)
    groups = written(_leaders(_prefixes(docs, text_col, levels, buckets), buckets), "groups")
    # Merge joins by name: whether a side could be broadcast at one size says nothing of the next.
    # One row for each set; the join has sorted them.
    texts = written(_texts(docs, text_col).join(groups.select(F.col("node").alias("fp")).distinct().hint("merge"), "fp", "left_semi").groupBy("fp").agg(F.first("z").alias("z")), "candidates")
    tidy(spark)
    # First every node with its most general leader alone, which links most of what will be linked.
    own = groups.groupBy("node").agg(F.min_by("leader", "rank").alias("leader")).withColumn("label", F.col("node"))
    links = written(_grouped(own, texts), "joined")
    labels = components(links)
    tidy(spark)
    # Then the groups that still hold nodes of different components: all others have nothing left to compare.
    known = groups.select("leader", "node").join(met(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = written(known.groupBy("leader").agg((F.min("label") != F.max("label")).alias("several")).where("several").select("leader"), "several")
    more = written(_grouped(_by_leader(known, several, "left_semi"), texts), "joined")
    drop(groups, texts, several, labels)
    labels = components(links.union(more))
    drop(links, more)
    tidy(spark)
    rows = scanned.where("kind = 0").select("id", "n", "fp")
    sets = rows.where("n > 0").groupBy("fp").agg(F.min("id").alias("least"))
    named = sets.join(met(labels), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = written(named, "named")
    heads = written(named.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "heads")
    # Large components get their head apart from the others, which are joined by label.
    large = written(heads.where(F.col("size") > GROUP).select("label", "component_id", F.lit(True).alias("large")), "large")
    marked = _by_leader(named, large, "left", "label", "fp")
    others = marked.where("large is null").select("fp", "label").join(met(heads.where(F.col("size") <= GROUP)), "label")
    by_set = marked.where("large").select(F.col("fp").alias("_fp"), "component_id").union(others.select("fp", "component_id"))
    full = rows.where("n > 0").join(by_set.hint("merge"), F.col("fp") == F.col("_fp")).select("id", "n", "component_id")
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.union(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
