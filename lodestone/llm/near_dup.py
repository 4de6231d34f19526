"""Near duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Documents with equal shingle sets form a class; its smallest doc_id stands for it. TREES sorted orders of the classes'
signatures, DEPTH values each, are made by one range sort, so that no order, region or group of copies has to fit in a
task. Neighbours in an order that agree in BASE values or more are candidates, in sparse and crowded regions alike: a
link of similarity 0.8 shares no such prefix in any tree once in 8 million times. Candidates chain up to groups, and
every link inside a group is confirmed (or not) on full sets: 100 |A and B| >= 80 |A or B|.

A group is searched by growing components: each reached class is compared with those not yet reached, so groups of
copies cost little more than one comparison each and no pairs are listed. Groups over GROUP classes are dealt out in
chunks by regions of the first order, each as deep as it has to be to hold no more than GROUP rows, so that close
classes meet first. Chunks are searched alone, then their components' leaders among each other, then what is still
outside the group's largest component against every chunk; so no pair of different components stays untested, whatever
the size, and the depth of a region changes the work alone.

Null or empty texts, and texts without words, have no shingles and link with nothing. Rows without doc_id link with
nothing either and are kept; their component_id is null. Repeated rows share a class. Texts are read whole. An empty
table gives an empty result; extra columns are ignored, and kept by deduplicate().
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SLICE, Scratch, join_hot, table

WIDTH = 5
TREES, DEPTH, BASE = 40, 8, 5
#: Classes that one task compares at once.
GROUP = 2000
#: Rows of a sorted order that are looked at together, and those of a partition, about.
RUN_ROWS, ORDER_ROWS = 100_000, 1_000_000

_rng = np.random.default_rng(20_240_601)
_MUL = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)
_PLACE = (_rng.integers(0, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


class _Hashes(dict):
    """Word hashes that a Python worker has met, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        made = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = made
        return made


_WORDS = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    return byte_shingles((text or "").encode("utf-8", "surrogatepass"), width)


def byte_shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    words = text.lower().split()  # of bytes: A-Z alone, ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += each[j : j + n] * _PLACE[j % len(_PLACE)]
    return np.unique(_mix(total + np.uint64(width)))


def signature(tokens: np.ndarray) -> np.ndarray:
    """TREES x DEPTH values of 16 bits."""
    x, least = tokens.astype(np.uint32), None
    for at in range(0, len(x), 256):
        part = ((x[at : at + 256, None] ^ _XOR) * _MUL).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least.astype(np.uint16)


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    data = tokens.tobytes()
    h = xxhash.xxh3_128_intdigest(data)
    return (h & (2**64 - 1)) - 2**63, (h >> 64) - 2**63


def _batches(run: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                yield run(whole.slice(at, SLICE))

    return each


def _signed(docs: DataFrame, width: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, lo, hi, sig = [], [], [], []
        for text in batch.column("text").to_pylist():
            tokens = shingles(text, width)
            a, b = set_key(tokens)
            n.append(len(tokens))
            lo.append(a)
            hi.append(b)
            sig.append(signature(tokens).tobytes() if len(tokens) else None)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "lo", "hi", "sig"])

    return docs.select("doc_id", "text").mapInArrow(_batches(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, lo long, hi long, sig binary")


def _orders(classes: DataFrame) -> DataFrame:
    """A row for each class and tree; front and back are the tree's DEPTH values, 16 bits each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        if not n:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64())], ["tree", "front", "back", "node"])
        values = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(n * TREES, DEPTH).astype(np.uint64)
        packed = [sum(values[:, a + i] << np.uint64(16 * (3 - i)) for i in range(4)).view(np.int64) for a in (0, 4)]
        node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), TREES)
        return pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array(packed[0]), pa.array(packed[1]), pa.array(node)], ["tree", "front", "back", "node"])

    return classes.select("node", "sig").mapInArrow(_batches(run), "tree int, front long, back long, node long")


def _agree(tree: np.ndarray, front: np.ndarray, back: np.ndarray) -> np.ndarray:
    """How many leading values each row shares with the one before it; -1 for the first and at another tree."""
    x, y = front[1:] ^ front[:-1], back[1:] ^ back[:-1]
    same = np.zeros(len(x), np.int64)
    alive = np.ones(len(x), bool)
    for word in (x, y):
        for shift in (48, 32, 16, 0):
            alive &= ((word >> np.uint64(shift)) & np.uint64(0xFFFF)) == 0
            same += alive
    same[tree[1:] != tree[:-1]] = -1
    return np.concatenate([[-1], same])


def neighbours(tree: np.ndarray, front: np.ndarray, back: np.ndarray) -> np.ndarray:
    """True where a row and the one before it are candidates."""
    return _agree(tree, front, back) >= BASE


def regions(same: np.ndarray, group: int) -> np.ndarray:
    """The first row of each row's region: rows of one prefix, longer where more than group rows share it; the longest
    prefixes are cut after group rows."""
    first = np.zeros(len(same), np.int64)
    open_ = np.ones(len(same), bool)
    for depth in range(BASE, DEPTH + 1):
        starts = np.flatnonzero(same < depth)
        length = np.diff(np.append(starts, len(same)))
        at, size = np.repeat(starts, length), np.repeat(length, length)
        if depth == DEPTH:
            at, size = at + (np.arange(len(same)) - at) // group * group, 0
        here = open_ & (size <= group)
        first[here] = at[here]
        open_ &= ~here
    return first


class _Forest:
    """Union-find over the nodes of a task; each component's smallest node is its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top and x != top:
            up[x] = top
            x = y
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> tuple[list[int], list[int]]:
        nodes = list(self.up)
        return nodes, [self.root(x) for x in nodes]


def _chains(ordered: DataFrame, group: int) -> DataFrame:
    """From sorted partitions: candidate links (kind 0: a, b), as stars; each partition's first and last row (kind 1: tree,
    front, back, a); and the region (b) of each row (a) of the first order (kind 2). Regions end with what is looked at
    together; they deal work out and decide nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, first, last = _Forest(), None, None

        def out(kind, *columns):
            n = len(columns[-1])
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), *(pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["kind", "tree", "front", "back", "a", "b"])

        for whole in batches:
            for at in range(0, whole.num_rows, RUN_ROWS):
                part = whole.slice(at, RUN_ROWS)
                tree, front, back, node = (part.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "front", "back", "node"))
                here = tree == 0
                if here.any():
                    same = _agree(tree, front.view(np.uint64), back.view(np.uint64))[here]
                    yield out(2, None, None, None, node[here], node[here][regions(same, group)])
                if last is not None:
                    tree, front, back, node = (np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(last, (tree, front, back, node), strict=True))
                first = first or tuple(int(x[0]) for x in (tree, front, back, node))
                for i in np.flatnonzero(neighbours(tree, front.view(np.uint64), back.view(np.uint64))):
                    if node[i] != node[i - 1]:
                        forest.join(int(node[i]), int(node[i - 1]))
                last = tuple(int(x[-1]) for x in (tree, front, back, node))
        if first is None:
            return
        nodes, roots = forest.stars()
        for at in range(0, len(nodes), 10_000):
            yield out(0, None, None, None, nodes[at : at + 10_000], roots[at : at + 10_000])
        yield out(1, *([x, y] for x, y in zip(first, last, strict=True)), [None, None])

    return ordered.mapInArrow(run, "kind int, tree int, front long, back long, a long, b long")


def _seams(edges: DataFrame) -> DataFrame:
    """Links across the borders of sorted partitions, from two rows for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({tuple(r.values()) for b in batches for r in b.to_pylist()})
        if rows:
            tree, front, back, node = (np.array(x) for x in zip(*rows, strict=True))
            found = [i for i in range(1, len(rows)) if _agree(tree[i - 1 : i + 1], front[i - 1 : i + 1].view(np.uint64), back[i - 1 : i + 1].view(np.uint64))[1] >= BASE and node[i] != node[i - 1]]
            yield pa.RecordBatch.from_arrays([pa.array([int(node[i]) for i in found], pa.int64()), pa.array([int(node[i - 1]) for i in found], pa.int64())], ["a", "b"])

    return edges.select("tree", "front", "back", F.col("a").alias("node")).repartition(1).mapInArrow(run, "a long, b long")


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """node and root (the smallest node it reaches), for the nodes of links (a, b), by large and small stars.

    Nodes of very many links are met by broadcast, so that no star lands in one task. Every round is written, so a lost executor repeats one round's tasks alone."""
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = scratch.cut(links.filter("a <> b").select(high.alias("u"), low.alias("v")).distinct(), "links")

    def star(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))

    def mark(e: DataFrame):
        return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()

    before = mark(edges.df)
    while before["n"]:
        both = edges.df.unionByName(edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = star(both).select("u", F.least("u", "m").alias("m"), "n")
        large = scratch.cut(join_hot(both, least, ["u"], 2 * before["n"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = star(large.df)
        small = join_hot(large.df, least, ["u"], large.df.count()).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        new = scratch.cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        edges.drop()
        large.drop()
        edges, after = new, mark(new.df)
        if after == before:
            break
        before = after
    pairs = edges.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())


def near(a, b):
    """Sizes that two linked sets can have."""
    return 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)


class Sets:
    """Token sets of a task, renumbered and laid end to end."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        names, self.tokens = np.unique(np.concatenate(sets), return_inverse=True)
        self.mask = np.zeros(len(names), bool)

    def linked(self, one: int, others: np.ndarray) -> np.ndarray:
        """Those of the others (rising) that are similar enough."""
        others = others[near(self.sizes[others], self.sizes[one])]
        if not len(others):
            return others
        own = self.tokens[self.at[one] : self.at[one + 1]]
        self.mask[own] = True
        if 3 * int(self.sizes[others].sum()) > len(self.tokens):
            common = np.add.reduceat(self.mask[self.tokens], self.at[:-1], dtype=np.int64)[others]
        else:
            common = np.array([np.count_nonzero(self.mask[self.tokens[self.at[o] : self.at[o + 1]]]) for o in others])
        self.mask[own] = False
        return others[100 * common >= 80 * (self.sizes[one] + self.sizes[others] - common)]


def grow(sets: Sets) -> np.ndarray:
    """For each set the first one of its component."""
    root, rest = np.full(len(sets.sizes), -1), np.arange(len(sets.sizes))
    for start in range(len(root)):
        if root[start] >= 0:
            continue
        root[start], queue = start, [start]
        rest = rest[root[rest] < 0]
        while queue and len(rest):
            hits = sets.linked(queue.pop(), rest)
            root[hits] = start
            queue += hits.tolist()
            rest = rest[root[rest] < 0]
    return root


def _by_group(rows: DataFrame, keys: list[str], columns: list[str], width: int, one: Callable[[list[dict], list[np.ndarray]], list[tuple[int, int]]]) -> DataFrame:
    """one(rows, their sets) for each group of keys; groups are bounded, so a task holds one of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows_, sets = None, [], []

        def done():
            made = one(rows_, sets) if len(rows_) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.int64())], ["a", "b"])

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                for row in whole.slice(at, SLICE).to_pylist():
                    if (k := [row[c] for c in keys]) != key:
                        if rows_:
                            yield done()
                        key, rows_, sets = k, [], []
                    sets.append(byte_shingles(zlib.decompress(row.pop("text")), width))
                    rows_.append(row)
        if rows_:
            yield done()

    dealt = rows.select(*keys, *columns, "text").repartition(*keys).sortWithinPartitions(*keys, "node")
    return dealt.mapInArrow(run, "a long, b long")


def _grown(rows: list[dict], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    return [(rows[i]["node"], rows[r]["node"]) for i, r in enumerate(grow(Sets(sets)).tolist()) if i != r]


def _outside(rows: list[dict], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between the labels of rows that came to be compared (out) and of the chunk's own."""
    all_sets, label = Sets(sets), np.array([r["label"] for r in rows])
    own = np.flatnonzero([not r["out"] for r in rows])
    found: set[tuple[int, int]] = set()
    for i in np.flatnonzero([r["out"] for r in rows]):
        hits = all_sets.linked(i, own[label[own] != label[i]])
        found |= {(int(label[i]), int(x)) for x in np.unique(label[hits])}
    return sorted(found)


def _links(scratch: Scratch, members: DataFrame, total: int, width: int, group: int) -> DataFrame:
    """Links (a, b) that make up the components of members (node, root, n: the group's size, cell, text), whatever the
    sizes of their groups."""
    links = [scratch.cut(_by_group(members.filter(F.col("n") <= group), ["root"], ["node"], width, _grown), "links").df]
    big = members.filter(F.col("n") > group).withColumn("chunk", F.xxhash64("cell"))  # of a hot root: never dealt by root
    if not big.take(1):
        return links[0]
    here, chunks = big, None
    while True:
        made = scratch.cut(_by_group(here, ["root", "chunk"], ["node"], width, _grown), "chunks").df
        links.append(made)
        followers = made.select(F.col("a").alias("node")).distinct()
        leaders = scratch.cut(here.select("root", "node", "text").join(followers, "node", "left_anti"), "leaders").df
        left = leaders.groupBy("root").agg(F.count("*").alias("n"))
        count = leaders.count()
        if chunks is not None and count >= chunks or not left.filter(F.col("n") > 1).take(1):
            break
        done = not left.filter(F.col("n") > group).take(1)
        chunks = count
        here = join_hot(leaders, left, ["root"], count).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(count)), F.ceil(F.col("n") / group)))
        if done:
            links.append(scratch.cut(_by_group(here, ["root", "chunk"], ["node"], width, _grown), "leaders").df)
            break
    so_far = links[1]
    for x in links[2:]:
        so_far = so_far.unionByName(x)
    labels = components(scratch, so_far).withColumnRenamed("root", "label")
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / group)).cast("int")
    labelled = scratch.cut(big.withColumn("chunk", chunk).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled").df
    by_label = labelled.groupBy("root", "label").agg(F.count("*").alias("k"))
    # a group's main component, and the lots that all others are dealt in; each lot meets every chunk of its group
    main = by_label.groupBy("root").agg(F.max(F.struct("k", "label")).alias("m"), F.sum("k").alias("rows"))
    main = main.select("root", F.col("m.label").alias("main"), F.ceil((F.col("rows") - F.col("m.k")) / group).cast("int").alias("lots"), "rows")
    marked = join_hot(labelled, main.filter("lots > 0"), ["root"], total, "rows")
    lot = F.pmod(F.xxhash64("node", F.lit(1)), F.col("lots")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    own = marked.withColumn("lot", every(F.col("lots"))).select("root", "chunk", "lot", "node", "label", F.lit(False).alias("out"), "text")
    sent = marked.filter(F.col("label") != F.col("main")).withColumn("chunk", every(F.ceil(F.col("n") / group))).select("root", "chunk", lot.alias("lot"), "node", "label", F.lit(True).alias("out"), "text")
    links.append(scratch.cut(_by_group(own.unionByName(sent), ["root", "chunk", "lot"], ["node", "label", "out"], width, _outside), "outside").df)
    made = links[0]
    for x in links[1:]:
        made = made.unionByName(x)
    return made


def classes(spark: SparkSession, docs: DataFrame, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles and component_id for every row."""
    scratch = Scratch(spark, "near")
    signed = scratch.cut(_signed(docs, width), "signed")
    ids = signed.df.select("doc_id", "n_shingles", "lo", "hi")
    linking = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    reps = scratch.cut(ids.filter(linking).groupBy("lo", "hi").agg(F.min("doc_id").cast("long").alias("node"), F.count("*").alias("n")), "classes").df
    # one row for each class, even where its doc_id is repeated
    first = scratch.cut(signed.df.filter(linking).select(F.col("doc_id").cast("long").alias("node"), "lo", "hi", "sig").join(reps.select("node", F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "node").filter("lo = lo2 and hi = hi2").select("node", "sig"), "signatures")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-first.df.count() * TREES // ORDER_ROWS))
    order = ["tree", "front", "back", "node"]
    chains = scratch.cut(_chains(_orders(first.df).repartitionByRange(parts, *order).sortWithinPartitions(*order), group), "chains")
    first.drop()
    candidates = chains.df.filter("kind = 0").select("a", "b").unionByName(_seams(chains.df.filter("kind = 1")))
    groups = scratch.cut(components(scratch, candidates), "groups")
    sizes, grouped = groups.df.groupBy("root").agg(F.count("*").alias("n")), groups.df.count()
    cells = chains.df.filter("kind = 2").select(F.col("a").alias("node"), F.col("b").alias("cell")).groupBy("node").agg(F.min("cell").alias("cell"))
    placed = scratch.cut(join_hot(groups.df, sizes, ["root"], grouped).join(cells, "node"), "placed")
    chains.drop()
    # candidates grow with the corpus: never broadcast; texts cross the network packed
    texts = _packed(docs).join(placed.df.hint("merge"), "node")
    texts = texts.groupBy("node", "root", "n", "cell").agg(F.first("text").alias("text")) if _repeats(ids) else texts
    members = scratch.cut(texts, "members")
    links = _links(scratch, members.df, grouped, width, group)
    roots = scratch.cut(components(scratch, links), "roots").df
    named = reps.join(roots, "node", "left").select("lo", "hi", F.coalesce("root", "node").alias("component_id"), "n")
    linked = join_hot(ids.filter(linking), named, ["lo", "hi"], ids.count()).select("doc_id", "n_shingles", "component_id")
    alone = ids.filter(~linking).select("doc_id", "n_shingles", F.col("doc_id").cast("long").alias("component_id"))
    result = scratch.cut(linked.unionByName(alone), "result").df
    for cut in (members, placed, signed):
        cut.drop()
    return result


def _packed(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array([zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in batch.column("text").to_pylist()], pa.binary())], ["node", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("node"), "text").filter("node is not null").mapInArrow(_batches(run), "node long, text binary")


def _repeats(ids: DataFrame) -> bool:
    """Whether a doc_id stands in several rows."""
    return bool(ids.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").take(1))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = classes(spark, table(spark, sf_dir, "documents"), width=4)
    return made.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(spark: SparkSession, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One document of each component, that with its smallest doc_id; the same columns. Repeated rows leave one."""
    made = classes(spark, docs, width)
    keep = made.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_keep")).distinct()
    # the row travels as one column, so that its names meet no others
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id")
    kept = rows.join(keep.hint("merge"), F.col("doc_id") == F.col("_keep"), "left_semi")
    if _repeats(docs.select("doc_id")):
        one = W.partitionBy("doc_id").orderBy(F.xxhash64("row"))
        kept = kept.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    return kept.select("row.*").unionByName(docs.filter(F.col("doc_id").isNull()))


#: Every pair that shares a shingle is counted here: for small tables alone.
ORACLE_SQL = {
    "op9_near_dup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
             n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
             l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
             e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
             m AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, coalesce(d.doc_id <= m.b, true) AS kept
        FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.a"""
}
