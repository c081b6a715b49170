"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word shingles. Texts with the same word sequence are one
class of copies from the start; one representative stands for them. Each
representative has ``HASHES`` MinHash values; those that agree in one whole
band share a bucket and are candidates. A candidate pair's values are compared
a chunk at a time, and the pair is dropped as soon as the posterior probability
(uniform prior) that its similarity reaches the threshold falls below
``TOLERANCE``. What is left is verified exactly on the shingle sets.

No bucket lists its pairs. It is cut into blocks of about ``BLOCK`` members; the
values of a block meet in one task, and of the pairs that survive the pruning
only a spanning forest leaves it, most agreements first. Those links are
verified exactly and joined to classes. A block all of whose links held is done:
its surviving pairs are of one class. Other blocks, and pairs of blocks of one
bucket, are compared once more, now only between members of different classes;
survivors are verified in the same task, and links that join classes leave it.
So every pair of different texts that share a
bucket is either of one class already or compared.

The chance that two texts at the threshold share no band is
(1 - 0.8**4)**32 = 5e-8; it is smaller above it.

Definitions: words are lower-cased (A-Z only) runs of digits, ASCII letters and
all characters beyond ASCII; a shingle is five consecutive words, or all words
of a shorter text. Null texts and texts without words are similar to nothing.
Rows that repeat count as copies. A null doc_id is an id like any other and
sorts first. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textvec as tv
from ledgerloom.llm.common import boxed, column, hinted, text_key, typed
from ledgerloom.llm.components import components
from ledgerloom.session import materialise

SIZE = 5
THRESHOLD = 0.8
HASHES = 128
BAND = 4
CHUNK = 16
TOLERANCE = 1e-6
BLOCK = 256
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"

_MULTIPLIERS = tv.mix(np.arange(1000, 1000 + HASHES, dtype=np.uint64)) | np.uint64(1)


def _shingles(texts: pa.Array):
    """Per slice: shingle hashes, first shingle number per text, word-sequence hashes."""
    for _, data, offsets in tv.text_slices(texts):
        words, first = tv.word_hashes(tv.LOWER[data], offsets, tv.PLAIN)
        shingles, starts = tv.shingle_hashes(words, first, SIZE)
        yield words, first, shingles, starts


def sequence_keys(texts: pa.Array) -> pa.Array:
    """128 bits that stand for a text's word sequence; null if it has no word."""
    out = []
    for words, first, _, _ in _shingles(texts):
        lengths = np.diff(first)
        place = np.arange(len(words), dtype=np.uint64) - np.repeat(first[:-1], lengths).astype(np.uint64)
        halves = []
        for salt in (np.uint64(0x51ED270B), np.uint64(0xA24BAED5)):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tv.mix(words ^ tv.mix(place * np.uint64(2) + salt)))])
            halves.append(tv.mix((sums[first[1:]] - sums[first[:-1]]) ^ lengths.astype(np.uint64)))
        packed = np.stack(halves, axis=1).tobytes()
        out += [packed[16 * i : 16 * i + 16] if n else None for i, n in enumerate(lengths.tolist())]
    return pa.array(out, pa.binary())


def signatures(texts: pa.Array) -> pa.Array:
    """MinHash values as little-endian uint32, one binary per text; null without words."""
    out = []
    for _, _, shingles, starts in _shingles(texts):
        counts = np.diff(starts)
        full = np.flatnonzero(counts)
        values = np.zeros((len(full), HASHES), np.uint32)
        if len(full):
            at = starts[:-1][full]
            for k in range(HASHES):
                hashed = ((shingles * _MULTIPLIERS[k]) >> np.uint64(32)).astype(np.uint32)
                values[:, k] = np.minimum.reduceat(hashed, at)
        rows: list[bytes | None] = [None] * len(counts)
        for i, row in enumerate(full.tolist()):
            rows[row] = values[i].tobytes()
        out += rows
    return pa.array(out, pa.binary())


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def band_keys(values: pa.Array) -> pa.Array:
    """One 64-bit bucket key per band of a signature."""
    matrix = _matrix(values).astype(np.uint64)
    n_bands = HASHES // BAND
    keys = np.empty((len(matrix), n_bands), np.uint64)
    for b in range(n_bands):
        key = np.full(len(matrix), b + 1, np.uint64)
        for c in range(b * BAND, (b + 1) * BAND):
            key = tv.mix(key ^ matrix[:, c]) + np.uint64(c)
        keys[:, b] = key
    offsets = np.arange(0, n_bands * len(matrix) + 1, n_bands, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 16, 32, ... values compared: the fewest that must agree to go on.

    The posterior of the similarity s given m of n agreements is proportional to
    s**m (1-s)**(n-m); its tail above the threshold is added up numerically.
    """
    grid = (np.arange(4000) + 0.5) / 4000
    out = []
    for n in range(CHUNK, HASHES + 1, CHUNK):
        for m in range(n + 1):
            weight = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(weight - weight.max())
            if weight[grid >= threshold].sum() >= tolerance * weight.sum():
                out.append(m)
                break
    return out


_LEAST = least_matches()


def similar(left: pa.Array, right: pa.Array) -> pa.Array:
    """Whether the exact Jaccard similarity of two shingle sets reaches the threshold."""
    out = []
    for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True):
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(a, b, assume_unique=True))
        union = len(a) + len(b) - common
        out.append(bool(union) and common >= THRESHOLD * union - 1e-9)
    return pa.array(out, pa.bool_())


def representatives(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies, nodes): every row with its node, and per node its head, copies and signature.

    copies: doc_id, text_key, n_rows, node (null without words). A node is a
    64-bit number drawn from the 128-bit key of the word sequence.
    """
    plain = typed(docs, doc_id="bigint", text="string").withColumn("text_key", text_key(F.col("text")))
    keyed = plain.select(
        "doc_id", "text_key", F.arrow_udf(sequence_keys, "binary")("text").alias("seq"),
        F.arrow_udf(signatures, "binary")("text").alias("sig"),
    )
    copies = materialise(keyed.groupBy("doc_id", "text_key", "seq").agg(F.count("*").alias("n_rows"), F.max("sig").alias("sig")))
    heads = copies.filter("seq is not null").groupBy("seq").agg(
        F.min(F.struct("doc_id", "text_key")).alias("head"), F.sum("n_rows").alias("n_copies"), F.max("sig").alias("sig")
    )
    nodes = materialise(heads.withColumn("node", F.xxhash64("seq")))
    clash = nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    if clash:  # two of the 128-bit keys met in 64 bits: number the classes instead
        nodes = materialise(heads.withColumn("node", F.monotonically_increasing_id()))
    rows = copies.join(nodes.select("seq", "node"), "seq", "left").select("doc_id", "text_key", "n_rows", "node")
    return rows, nodes


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of each representative; few of them are looked up without a shuffle of the texts."""
    plain = typed(docs, doc_id="bigint", text="string").withColumn("text_key", text_key(F.col("text")))
    heads = hinted(nodes.select("node", F.col("head.doc_id").alias("h_id"), F.col("head.text_key").alias("h_key")))
    same = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key"))
    return plain.join(heads, same).select("node", "text").dropDuplicates(["node"])


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs a, b whose exact similarity reaches the threshold, written once."""
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    texts = _texts(docs, nodes.join(wanted, "node", "left_semi"))
    sets = materialise(texts.select("node", F.arrow_udf(shingle_sets, "binary")("text").alias("s")))
    left, right = (sets.select(F.col("node").alias(c), F.col("s").alias(f"set_{c}")) for c in "ab")
    met = pairs.join(left, "a").join(right, "b")
    return materialise(met.filter(F.arrow_udf(similar, "boolean")("set_a", "set_b")).select("a", "b"))


def _survivors(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of rows a, b that the chunk by chunk comparison keeps, with their agreements."""
    matches = np.zeros(len(a), np.int64)
    for step, least in enumerate(_LEAST):
        cut = slice(step * CHUNK, (step + 1) * CHUNK)
        matches += (values[a, cut] == values[b, cut]).sum(axis=1)
        stay = matches >= least
        a, b, matches = a[stay], b[stay], matches[stay]
    return a, b, matches


def _forest(a: np.ndarray, b: np.ndarray, matches: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the pairs that make a spanning forest, those of most agreements first."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i in np.argsort(-matches, kind="stable").tolist():
        x, y = find(int(a[i])), find(int(b[i]))
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, np.int64)


def block_links(batches):
    """a, b: candidate links that span each block of a partition sorted by (bucket, block).

    All pairs of a block are compared in place. Of those that survive only a
    spanning forest leaves, so a block gives fewer rows than it has members.
    """
    held: pa.Table | None = None
    for batch in chain(batches, [None]):
        if batch is not None:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
        if held is None or not len(held):
            continue
        bucket, block = (held[c].to_numpy() for c in ("bucket", "block"))
        starts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])]))
        ends = np.concatenate([starts[1:], [len(bucket)]])
        # The last group may go on in the next batch.
        whole = len(starts) if batch is None else len(starts) - 1
        if whole:
            upto = int(ends[whole - 1])
            part = held.slice(0, upto)
            node = part["node"].to_numpy()
            values = _matrix(part["sig"].combine_chunks())
            out_a, out_b = [], []
            for s, e in zip(starts[:whole].tolist(), ends[:whole].tolist(), strict=True):
                a, b = np.triu_indices(e - s, 1)
                a, b, matches = _survivors(values[s:e], a, b)
                if len(a):
                    kept = _forest(a, b, matches, e - s)
                    out_a.append(node[s + a[kept]])
                    out_b.append(node[s + b[kept]])
            if out_a:
                x, y = np.concatenate(out_a), np.concatenate(out_b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
            held = held.slice(upto)


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles each of the sets a shares with each of the sets b.

    Shared shingles are counted as a product of membership matrices, some
    columns at a time.
    """
    sizes = [len(x) for x in sets]
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(a), len(b)), np.float32)
    width = 4096
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [begin, begin + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[lo:hi], column[lo:hi] - begin] = 1
        common += part[a] @ part[b].T
    return common


def tile_links(tile: pa.Table) -> pa.Table:
    """a, b: similar pairs that join different classes, one end from each block.

    Pairs of different classes are compared chunk by chunk, the survivors are
    verified exactly, and a spanning forest of the classes leaves the task.
    """
    i, j = tile["i"][0].as_py(), tile["j"][0].as_py()
    block = np.array(tile["block"].to_pylist())
    node, label = (np.array(tile[c].to_pylist(), np.int64) for c in ("node", "label"))
    values = _matrix(tile["sig"].combine_chunks())
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    pairs = label[left][:, None] != label[right][None, :]
    if i == j:
        pairs &= node[left][:, None] < node[right][None, :]
    a, b = np.nonzero(pairs)
    a, b, matches = _survivors(values, left[a], right[b])
    if len(a):
        used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        column = tile["shingles"].combine_chunks()
        sets = [np.frombuffer(column[int(k)].as_py(), np.uint64) for k in used]
        rows, row_at = np.unique(place[: len(a)], return_inverse=True)
        cols, col_at = np.unique(place[len(a) :], return_inverse=True)
        common = _common(sets, rows, cols)[row_at, col_at]
        sizes = np.array([len(x) for x in sets])
        union = sizes[place[: len(a)]] + sizes[place[len(a) :]] - common
        linked = common >= THRESHOLD * union - 1e-6
        a, b, matches = a[linked], b[linked], matches[linked]
        _, class_ = np.unique(label, return_inverse=True)
        kept = _forest(class_[a], class_[b], matches, int(class_.max()) + 1)
        a, b = a[kept], b[kept]
    return pa.table({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})


def near_links(docs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, labels): verified links a, b between nodes, and node, root of their classes."""
    members = nodes.select("node", "sig", F.explode(F.arrow_udf(band_keys, "array<bigint>")("sig")).alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node", "bucket"), "node")).alias("p"))
    sizes = sizes.filter("size > 1").select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.col("p.node").alias("pivot"))
    number = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks").cast("long")).cast("int")
    members = materialise(members.select("node", "bucket").join(sizes, "bucket").withColumn("block", number))

    # Within blocks; a bucket of several blocks has one member in all of them.
    everywhere = members.filter("blocks > 1 and node = pivot").select(
        "bucket", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("block").alias("own")
    ).filter("block <> own").drop("own")
    signed = nodes.select("node", "sig")
    dealt = members.select("bucket", "node", "block").unionByName(everywhere).join(signed, "node")
    grouped = dealt.repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    asked = materialise(grouped.select("bucket", "block", "node", "sig").mapInArrow(block_links, "a bigint, b bigint").distinct())
    links = _verified(docs, nodes, asked)
    labels = components(links)

    # Blocks that still hold several classes, and buckets of several blocks that do.
    labelled = members.join(labels, "node", "left").select("bucket", "node", "block", "blocks", F.coalesce("root", "node").alias("label"))
    open_ = asked.join(links, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    doubtful = labelled.join(open_, "node", "left_semi").select("bucket").union(labelled.filter("blocks > 1").select("bucket")).distinct()
    labelled = materialise(labelled.join(doubtful, "bucket", "left_semi"))
    split = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    rows = labelled.join(split, "bucket", "left_semi").join(signed, "node")
    texts = _texts(docs, nodes.join(materialise(rows.select("node").distinct()), "node", "left_semi"))
    rows = rows.join(texts.select("node", F.arrow_udf(shingle_sets, "binary")("text").alias("shingles")), "node")
    tiles = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", "node", "label", "sig", "shingles", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    more = materialise(tiles.groupBy("bucket", "i", "j").applyInArrow(tile_links, "a bigint, b bigint").distinct())
    if more.isEmpty():
        return links, labels
    joined = labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)
    return links.union(more), components(joined)


def shingle_sets(texts: pa.Array) -> pa.Array:
    """The sorted distinct shingle hashes of each text, as one binary."""
    out = []
    for _, _, shingles, starts in _shingles(texts):
        out += [np.unique(shingles[starts[i] : starts[i + 1]]).tobytes() for i in range(len(starts) - 1)]
    return pa.array(out, pa.binary())


def tile_degrees(tile: pa.Table) -> pa.Table:
    """node, n: how many members of the other block (or of its own) are similar to it."""
    home = np.array(tile["block"].to_pylist()) == tile["i"][0].as_py()
    same = tile["i"][0].as_py() == tile["j"][0].as_py()
    sets = [np.frombuffer(x, np.uint64) for x in tile["shingles"].to_pylist()]
    sizes = np.array([len(x) for x in sets])
    a = np.flatnonzero(home)
    b = a if same else np.flatnonzero(~home)
    common = _common(sets, a, b)
    union = sizes[a][:, None] + sizes[b][None, :] - common
    linked = common >= THRESHOLD * union - 1e-6
    if same:
        np.fill_diagonal(linked, False)
    nodes = np.array(tile["node"].to_pylist(), np.int64)
    degree = np.zeros(len(sets), np.int64)
    degree[a] += linked.sum(axis=1)
    if not same:
        degree[b] += linked.sum(axis=0)
    return pa.table({"node": nodes, "n": degree})


def link_counts(docs: DataFrame, nodes: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """node, n_links: the number of other texts similar to each linked text, exactly.

    Both ends of a link are in one class. Where the links found already are all
    pairs of a class they are counted; the other classes are compared block by
    block, ``BLOCK`` texts against ``BLOCK`` texts a task, and only counts leave
    the task.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    roots = labels.select("node", "root").union(labels.select(F.col("root"), F.col("root"))).distinct()
    known = materialise(roots.join(ends, "node", "left").fillna(0, ["n_links"]))
    per_class = known.groupBy("root").agg(F.count("*").alias("size"), F.sum("n_links").alias("ends"))
    per_class = materialise(per_class.withColumn("whole", F.col("ends") == F.col("size") * (F.col("size") - 1)))
    done = known.join(per_class.filter("whole"), "root", "left_semi").select("node", "n_links")
    rest = materialise(known.join(per_class.filter("not whole"), "root").select("node", "root", "size"))
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    sets = _texts(docs, nodes.join(rest, "node", "left_semi")).select("node", F.arrow_udf(shingle_sets, "binary")("text").alias("shingles"))
    dealt = rest.join(sets, "node").select(
        "node", "root", "shingles", n_blocks.alias("blocks"), F.pmod(F.xxhash64("node", F.lit(7)), n_blocks.cast("long")).cast("int").alias("block")
    )
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "root", "shingles", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    counted = tiles.groupBy("root", "i", "j").applyInArrow(tile_degrees, "node bigint, n bigint")
    return materialise(done.union(counted.groupBy("node").agg(F.sum("n").alias("n_links"))))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_rows, class_id, is_kept, n_copies, n_links per distinct (doc_id, text).

    class_id is the least doc_id of the class; the row that carries it is kept.
    n_copies counts the rows with the same word sequence, itself included;
    n_links the other word sequences whose similarity reaches the threshold.
    """
    copies, nodes = representatives(docs)
    links, labels = near_links(docs, nodes)
    degree = link_counts(docs, nodes, links, labels)
    rooted = nodes.select("node", "n_copies", "head").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialise(rooted.join(degree, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0))))
    heads = rooted.groupBy("root").agg(F.min("head").alias("first"))
    placed = rooted.join(heads, "root").select("node", "n_copies", "n_links", "first")
    out = copies.join(placed, "node", "left")
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return out.select(
        "doc_id", "text_key", "n_rows",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        (F.col("node").isNull() | F.coalesce(first, F.lit(False))).alias("is_kept"),
        F.coalesce("n_copies", "n_rows").cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each class, all columns; texts without words all stay."""
    kept = materialise(classes(docs).filter("is_kept").select(
        F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"), (F.col("n_rows") > 1).alias("many")
    ))
    text = column(docs, "text", "string")
    rows = boxed(docs, id=column(docs, "doc_id", "bigint"), key=text_key(text), worded=F.coalesce(text.rlike(_WORD), F.lit(False)))
    met = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    again = F.col("many") & F.col("worded")
    several = met.filter(again).dropDuplicates(["kept_id", "kept_key"])
    return met.filter(~again).select("row").union(several.select("row")).select("row.*")
