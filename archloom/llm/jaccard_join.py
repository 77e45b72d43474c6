"""N-gram Jaccard join: a MinHash LSH forest finds candidates, whole word windows decide.

1. Each text becomes a node (equal word sequences are one node) with ``trees`` labels of ``depth``
   min-hashes. The nodes of a tree, sorted by label, are its prefix trie: nodes that agree on a
   prefix lie side by side.
2. The tries are sized from ``shortest`` down (``tries``): how many nodes share each prefix of each node.
3. A node is matched at its whole label, the longest prefix, in each tree at first. As long as a pair at the
   threshold could be missed more often than the target recall allows, the node's matches are shortened
   level by level, and at the last level only in as many trees as the recall needs: crowded prefixes
   are shortened last (``asked``). Below ``crowd`` nodes the size of a prefix doesn't matter for the choice: trees
   in which the node is alone would else be preferred to those in which it meets its partner. A node's
   recall doesn't rest on that of its partner.
4. Nodes that share a matched prefix are compared by their signatures, in blocks, and yield a
   spanning set of candidate edges (never all pairs of a group).
5. The texts of each candidate component are compared exactly, in blocks: every pair counts, and
   verified links join the final classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archloom.llm.grouping import components, group_starts, spread, whole_groups
from archloom.llm.words import chunks, hash_words, mix, powers, shingles, text_buffers
from archloom.sources.scratch import Scratch

SEED = 20_250_101
NODE_SCHEMA = "doc_id long, tk long, node long, words long, sig binary, labels binary"


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which a pair at ``threshold`` shares one of ``trees`` labels often enough."""
    for length in range(depth, 0, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    raise ValueError(f"{trees} trees can't reach a recall of {recall} at {threshold}: use more")


def text_key(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit key for each text's word sequence."""
    up = powers(int(np.diff(at).max(initial=0)) + 2)[0]
    place = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[place + 1])])
    return mix((total[at[1:]] - total[at[:-1]]) ^ np.diff(at).astype(np.uint64)).view(np.int64)


def _signer(size: int, trees: int, depth: int):
    """Nodes of rows (doc_id, tk, text): a key, the words, a signature of a byte a min-hash, and each tree's label."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(2))
            for lo, hi in chunks(offsets):
                h, at = hash_words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                s, begin = shingles(h, at, size)
                full = np.flatnonzero(np.diff(begin))
                low = np.zeros((len(full), trees * depth), np.uint32)
                if len(full):
                    v = np.empty_like(s)
                    for j in range(trees * depth):
                        np.multiply(s, a[j], out=v)
                        v += b[j]
                        v >>= np.uint64(32)
                        low[:, j] = np.minimum.reduceat(v, begin[full])
                wide = low.astype(">u4").tobytes()
                sig = (low & 0xFF).astype(np.uint8).tobytes()
                n = trees * depth
                some = pa.array(full)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, hi - lo).take(some),
                        batch.column(1).slice(lo, hi - lo).take(some),
                        pa.array(text_key(h, at)[full]),
                        pa.array(np.diff(at)[full].astype(np.int64)),
                        pa.array([sig[i * n : (i + 1) * n] for i in range(len(full))], pa.binary()),
                        pa.array([wide[i * n * 4 : (i + 1) * n * 4] for i in range(len(full))], pa.binary()),
                    ],
                    names=["doc_id", "tk", "node", "words", "sig", "labels"],
                )

    return sign


def prefix_key(tree: Column, depth: int, length: Column | int) -> Column:
    """The key of the first ``length`` min-hashes of a tree's label (``labels``: all trees' labels in order)."""
    return F.xxhash64(tree, F.substring("labels", tree * (4 * depth) + 1, 4 * length))


def _levels(nodes: DataFrame, trees: int, depth: int, length: int, only: DataFrame | None = None) -> DataFrame:
    """(node, tree, key) of the prefixes of one length; of the (node, tree) in ``only`` where it is given."""
    each = nodes.select("node", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    if only is not None:
        each = only.select("node", "tree").join(nodes.select("node", "labels"), "node")
    return each.select("node", "tree", prefix_key(F.col("tree"), depth, length).alias("key"))


def tries(nodes: DataFrame, scratch: Scratch, *, trees: int, depth: int, shortest: int) -> DataFrame:
    """(node, tree, key, length, n): the prefixes that a node shares with others, with the number of nodes that do."""
    parts, shared, some = [], None, nodes
    for length in range(shortest, depth + 1):
        keys = _levels(some, trees, depth, length, shared)
        sizes = keys.groupBy("tree", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = scratch.keep(keys.join(sizes, ["tree", "key"]).withColumn("length", F.lit(length)))
        parts.append(shared)
        if shared.isEmpty():
            break
        if length == shortest:  # few nodes share a prefix: only their labels are shuffled again
            some = scratch.keep(nodes.select("node", "labels").join(shared.select("node").distinct(), "node", "left_semi"))
    return reduce(DataFrame.unionByName, parts)


def matched_lengths(shared: np.ndarray, miss: np.ndarray, limit: float, crowd: int) -> np.ndarray:
    """The length at which each node is matched in each tree, counted from the shortest.

    ``shared``: nodes by lengths by trees, how many nodes share that prefix. ``miss``: the logarithm of how often a
    pair at the threshold shares no prefix of a length, ``limit``: of how often it may share none in any tree.
    """
    n, levels, trees = shared.shape
    cut = np.full((n, trees), levels - 1)
    for level in range(levels - 2, -1, -1):
        lacks = miss[cut].sum(axis=1) - limit
        need = np.where(lacks > 1e-12, np.ceil(lacks / (miss[level + 1] - miss[level]) - 1e-9), 0)
        can = cut == level + 1
        weight = np.where(shared[:, level] > crowd, shared[:, level], 0)
        few = np.argsort(np.where(can, weight, np.iinfo(np.int64).max), axis=1, kind="stable")
        place = np.empty_like(few)
        np.put_along_axis(place, few, np.broadcast_to(np.arange(trees), few.shape), axis=1)
        cut[can & (place < need[:, None])] = level
    return cut


def asked(found: DataFrame, *, threshold: float, recall: float, trees: int, depth: int, shortest: int, crowd: int) -> DataFrame:
    """(node, tree, length) of the prefixes at which nodes are matched and not alone. ``found``: as ``tries`` gives."""
    miss = np.log(1 - threshold ** np.arange(shortest, depth + 1))
    limit = np.log(1 - recall)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = batch.column("x")
            flat = each.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(each.offsets.to_numpy()))
            tree, length, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("tree", "length", "n"))
            shared = np.ones((batch.num_rows, len(miss), trees), np.int64)
            shared[row, length - shortest, tree] = n
            cut = matched_lengths(shared, miss, limit, crowd)
            others = np.take_along_axis(shared, cut[:, None, :], axis=1)[:, 0, :] > 1
            at, tree = np.nonzero(others)
            yield pa.record_batch([batch.column("node").take(pa.array(at)), pa.array(tree.astype(np.int32)), pa.array((cut[at, tree] + shortest).astype(np.int32))], names=["node", "tree", "length"])

    sizes = found.groupBy("node").agg(F.collect_list(F.struct("tree", "length", "n")).alias("x"))
    return sizes.mapInArrow(choose, "node long, tree int, length int")


def meetings(found: DataFrame, asks: DataFrame) -> DataFrame:
    """(node, key, n) of all nodes below the prefixes that some node is matched at."""
    wanted = found.join(asks, ["node", "tree", "length"], "left_semi").select("tree", "key").distinct()
    return found.join(wanted, ["tree", "key"], "left_semi").select("node", "key", "n")


def _candidates(width: int, least: float):
    """Spanning candidate edges of each (key, block pair): rows whose signatures agree often enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "b1", "b2"]):
            n = table.num_rows
            starts = group_starts(table, ["key", "b1", "b2"])
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            node = table.column("node").to_numpy()
            own = table.column("own").to_numpy()
            apart = (table.column("b1").to_numpy() != table.column("b2").to_numpy())
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(n, width)
            label = np.arange(n)
            left = np.arange(n - 1)
            step = 1
            while True:
                left = left[left + step < n]
                left = left[group[left] == group[left + step]]
                if not len(left):
                    break
                todo = left[~apart[left] | (own[left] != own[left + step])]
                todo = todo[label[todo] != label[todo + step]]  # shares of one component already
                for lo in range(0, len(todo), 65536):
                    i = todo[lo : lo + 65536]
                    near = (sig[i] == sig[i + step]).mean(axis=1) >= least
                    if near.any():
                        label = spread(label, i[near], i[near] + step)
                step += 1
            moved = np.flatnonzero(label != np.arange(n))
            yield pa.record_batch([pa.array(node[label[moved]]), pa.array(node[moved])], names=["a", "b"])

    return compare


def _verify(size: int, num: int, den: int):
    """Exact links within each (component, block pair): counts for each node, and spanning edges."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["component", "b1", "b2"], 256):
            starts = np.append(group_starts(table, ["component", "b1", "b2"]), table.num_rows)
            all_node, all_own = table.column("node").to_numpy(), table.column("own").to_numpy()
            raw, offsets = text_buffers(table.column("text"))
            nodes, counts, roots = [], [], []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):  # one row a node
                h, at = hash_words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                s, begin = shingles(h, at, size)
                owner = np.repeat(np.arange(hi - lo), np.diff(begin))
                order = np.lexsort((owner, s))
                s, owner = s[order], owner[order]
                if not len(s):
                    continue
                fresh = np.ones(len(s), bool)
                fresh[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
                s, owner = s[fresh], owner[fresh]
                n = hi - lo
                sizes = np.bincount(owner, minlength=n)
                head = np.ones(len(s), bool)
                head[1:] = s[1:] != s[:-1]
                term = np.cumsum(head) - 1
                many = np.bincount(term)[term] > 1
                term, owner = np.unique(term[many], return_inverse=True)[1], owner[many]
                shared = np.zeros((n, n), np.float32)
                for base in range(0, int(term.max(initial=-1)) + 1, 4096):
                    part = (term >= base) & (term < base + 4096)
                    x = np.zeros((n, min(4096, int(term.max()) + 1 - base)), np.float32)
                    x[owner[part], term[part] - base] = 1
                    shared += x @ x.T
                shared = shared.astype(np.int64)
                near = den * shared >= num * (sizes[:, None] + sizes[None, :] - shared)
                np.fill_diagonal(near, False)
                own = all_own[lo:hi]
                if len(np.unique(own)) > 1:
                    near &= own[:, None] != own[None, :]
                a, b = np.nonzero(near)
                label = spread(np.arange(n), a, b)
                part_node = all_node[lo:hi]
                nodes.append(part_node)
                counts.append(near.sum(axis=1))
                roots.append(part_node[label])
            if nodes:
                yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in (nodes, counts, roots)], names=["node", "links", "root"])

    return links


def _in_blocks(df: DataFrame, rows: str, block: int) -> DataFrame:
    """Each row of a group of ``rows`` rows once for each pair of blocks that its own block is in."""
    count = F.ceil(F.col(rows) / F.lit(block)).cast("int")
    own = df.withColumn("own", F.pmod(F.xxhash64("node"), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    return own.withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other")).drop("other")


def _classes(docs: DataFrame, scratch: Scratch, *, id_col: str, text_col: str, shingle: int, threshold: float, trees: int, depth: int, recall: float, shortest: int, crowd: int, signature_share: float, prefix_block: int, text_block: int) -> DataFrame:
    """(doc_id, tk, n, first, class_id, n_links, n_copies) for each different (id, text) with words: ``n`` rows; ``first``: the class's one to stay."""
    if prefix_length(threshold, trees, depth, recall) < shortest:
        raise ValueError(f"prefixes of {shortest} can't reach a recall of {recall} at {threshold}: use shorter ones, or more trees")
    spec = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tk", T.LongType(), False), T.StructField("text", T.StringType(), False)])
    rows = _keyed(docs, id_col, text_col).where("doc_id is not null").to(spec)
    signed = scratch.keep(rows.mapInArrow(_signer(shingle, trees, depth), NODE_SCHEMA))
    # one row for each different (id, text), then one for each node: equal nodes have equal labels
    once = scratch.keep(signed.groupBy("doc_id", "tk", "node").agg(F.count("*").alias("n")))
    signs = signed.groupBy("node").agg(F.min("sig").alias("sig"), F.min("labels").alias("labels"))
    heads = once.groupBy("node").agg(F.min(F.struct("doc_id", "tk")).alias("head"), F.sum("n").alias("rows"))
    nodes = scratch.keep(signs.join(heads, "node").select("node", "sig", "labels", F.col("head.doc_id").alias("rep"), F.col("head.tk").alias("rep_tk"), "rows"))
    scratch.drop(signed)

    forest = {"trees": trees, "depth": depth, "shortest": shortest}
    found = tries(nodes, scratch, **forest)
    asks = asked(found, threshold=threshold, recall=recall, crowd=crowd, **forest)
    hits = _in_blocks(meetings(found, asks), "n", prefix_block).join(nodes.select("node", "sig"), "node")
    hits = hits.select("key", "b1", "b2", "own", "node", "sig").repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2", "node")
    close = scratch.keep(hits.mapInArrow(_candidates(trees * depth, signature_share), "a long, b long").distinct())

    groups = scratch.keep(components(close, scratch))
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    members = groups.join(sizes, "component").join(nodes.select("node", "rep", "rep_tk"), "node")
    members = members.select(F.col("rep").alias("doc_id"), F.col("rep_tk").alias("tk"), "node", "component", "n")
    texts = rows.join(members.hint("shuffle_hash"), ["doc_id", "tk"]).select("node", "component", "n", "text")
    texts = texts.dropDuplicates(["node", "component"])  # rows that repeat
    texts = _in_blocks(texts, "n", text_block).select("component", "b1", "b2", "own", "node", "text")
    texts = texts.repartition("component", "b1", "b2").sortWithinPartitions("component", "b1", "b2", "node")
    num, den = _ratio(threshold)
    verified = scratch.keep(texts.mapInArrow(_verify(shingle, num, den), "node long, links long, root long"))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(verified.where("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b")), scratch)
    by_node = nodes.select("node", "rep", "rep_tk", "rows").join(links, "node", "left").join(classes, "node", "left")
    by_node = scratch.keep(by_node.select("node", F.struct("rep", "rep_tk").alias("head"), "rows", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")))
    first = by_node.groupBy("component").agg(F.min("head").alias("first"))
    by_node = by_node.join(first, "component").select("node", "first", F.col("first.rep").alias("class_id"), F.col("links").alias("n_links"), (F.col("rows") - 1).alias("n_copies"))
    out = once.join(by_node, "node").withColumn("first", F.struct("doc_id", "tk") == F.col("first"))
    return scratch.keep(out.select("doc_id", "tk", "n", "first", "class_id", "n_links", "n_copies"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))


#: With these the tries miss a pair at 0.8 once in 100,000 times at most, others more rarely.
FOREST = {"shingle": 5, "threshold": 0.8, "trees": 32, "depth": 8, "recall": 0.99999, "shortest": 5, "crowd": 256, "signature_share": 0.68, "prefix_block": 1024, "text_block": 256}


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: (id, class_id long, n_links long, n_copies long).

    class_id: smallest id among the documents joined, directly or through others, by links of
    Jaccard ``threshold`` or more over ``shingle``-word windows. n_links: different word sequences
    that the document's own is linked to. n_copies: other rows with the same word sequence.
    A text shorter than the window is one window of all its words. Texts without words (null,
    empty, white space) link to nothing: they are classes of their own with no links. Rows without
    an id come back with a null class and no links. Rows with equal id and text are compared once and
    get equal results; of rows with one id and different texts each is a document of its own. Columns
    other than the two are ignored. ``options``: see ``FOREST``.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    known = _classes(docs, scratch, id_col=id_col, text_col=text_col, **{**FOREST, **options})
    each = known.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"), "class_id", "n_links", "n_copies").drop("copy")
    # texts without words were not signed
    rows = _keyed(docs, id_col, text_col)
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    zero = F.lit(0).cast("long")
    alone = rows.where(F.col("doc_id").isNull() | blank).select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_copies"))
    return each.unionByName(alone).withColumnRenamed("doc_id", id_col)


def _ratio(threshold: float) -> tuple[int, int]:
    """``threshold`` as a ratio of integers, for an exact comparison: I/U >= num/den."""
    from fractions import Fraction

    x = Fraction(str(threshold))
    return x.numerator, x.denominator


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` (all columns) with one row of each class: that with the smallest id, then text hash.

    Of rows with equal id and text one stays, whichever. Rows without an id and texts without words
    are in no class and all stay.
    """
    scratch = Scratch(docs.sparkSession, "first")
    known = _classes(docs, scratch, id_col=id_col, text_col=text_col, **{**FOREST, **options})
    key = [F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))]

    def on(these: DataFrame) -> tuple[DataFrame, Column]:
        marked = these.select(F.col("doc_id").alias("_k1"), F.col("tk").alias("_k2"))
        return marked.hint("shuffle_hash"), (key[0] == F.col("_k1")) & (key[1] == F.col("_k2"))

    stays = docs.join(*on(known.where("not first or n > 1")), "left_anti")
    again = known.where("first and n > 1")
    if again.isEmpty():
        return stays
    one = docs.join(*on(again), "left_semi").withColumns({"_k1": key[0], "_k2": key[1]}).dropDuplicates(["_k1", "_k2"]).drop("_k1", "_k2")
    return stays.unionByName(one)
