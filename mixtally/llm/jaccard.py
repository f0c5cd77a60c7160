"""N-gram Jaccard join: count vectors in R-trees bound the overlap, survivors are verified on whole shingle sets.

The points are count vectors: a document's shingles are hashed into groups, about as many as there are shingles, and each
coordinate counts one group. The sum of coordinate minima bounds the intersection of two sets from above (vectors of
different length are folded to the shorter), and an R-tree node's greatest coordinates bound it for all points below. One
R-tree over a corpus can't be dealt out, as in many dimensions every leaf meets almost every other; so the root's fan-out is
by token. Two sets that reach the threshold share one of their first n - ceil(0.8 n) + 1 tokens in any global order, so
documents meet in the pages of those tokens, and each page has an R-tree, which alone says who is paired. The order goes from rare to frequent tokens,
by the exact number of documents that have each: chunks of documents exchange their distinct tokens (48 bits of the hash,
sorted, as differences) and get back a frequency class of each. A token of one document opens no page, so only documents
that share their rarest tokens send points at all, and a frequent passage is met only by documents that consist of such.

Equal sets are one node (named by the set's hash) before anything is exchanged. Pages emit few
of their pairs in the first two steps, and in the third those that nothing else decides:

1. Each page covers its nodes by stars: a leader and the nodes whose bound with it reaches the threshold. The pairs are
   verified and components formed.
2. Nodes outside their page's largest component are paired with their best bound elsewhere; verified, and merged.
3. Pairs of a page that still stand in different components and reach the bound are verified, all of them. Texts with
   similarities just below the threshold make up to half the square of their number.

Pairs within a component need no verifying, and pairs below the bound can't link, so the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks as C
from .components import components
from .skew import salted_join
from .textops import U64, Words, flat, grams, mix, pieces, ranges, segments

#: Words in a shingle; percent of the union that the intersection of two linked sets has at least.
SHINGLE, PERCENT = 5, 80
#: Least groups of a count vector, as many as an R-tree's boxes have.
GROUPS = 32
#: Chunks for each bucket of the exchange of tokens, and buckets of that for each bucket of pages, which are far fewer.
CHUNKS_A_BUCKET, PAGE_BUCKETS_PART = 2, 4
#: Nodes in a leaf of an R-tree.
LEAF = 4
#: Most rows of a table that is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 500_000


class Sets:
    """Shingle sets of some rows: `token` (sorted within a row, distinct), `first` of each row, `node` names each set."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, n: int = SHINGLE):
        words = Words(data, offs, lower=True)
        h = words.hashes()
        rows = len(offs) - 1
        count = np.diff(words.first)
        token = grams(h, n)
        at = np.flatnonzero(words.row[n - 1 :] == words.row[: len(token)]) if len(token) else np.zeros(0, np.int64)
        token, row = token[at], words.row[at]
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for k in range(n - 1):
                live = np.flatnonzero(count[short] > k)
                whole[live] = mix(whole[live] * U64(0x9E3779B97F4A7C15) + h[words.first[short[live]] + k])
            token, row = np.concatenate([token, mix(whole + U64(n))]), np.concatenate([row, short])
        order = np.lexsort((token, row))
        token, row = token[order], row[order]
        keep = segments(row, token)
        self.token, self.row = token[keep], row[keep]
        self.first = np.searchsorted(self.row, np.arange(rows + 1))
        self.size = np.diff(self.first)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.token + U64(1)))])
        self.node = mix((total[self.first[1:]] - total[self.first[:-1]]) + self.size.astype(np.uint64)).view(np.int64)


def _sets(batch: pa.RecordBatch, text: str, n: int) -> Iterator[tuple[int, int, Sets]]:
    data, offs = flat(batch.column(text))
    for a, b in pieces(offs, 1 << 20):
        yield a, b, Sets(data[offs[a] : offs[b]], offs[a : b + 1], n)
    C.release()


def features(docs: DataFrame, text: str, key: str, n: int) -> DataFrame:
    """(key, n_shingles, node): the node is null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s in _sets(batch, text, n):
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(a, b - a), pa.array(s.size, pa.int64()), pa.array(s.node, pa.int64(), mask=s.size == 0)], names=[key, "n_shingles", "node"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n_shingles long, node long")


class ChunkSets:
    """The distinct sets of a chunk's documents, piece by piece, and the chunk's tokens (48 bits) with how many of the sets have each."""

    def __init__(self, table: pa.Table, text: str, n: int):
        data, offs = flat(table.column(text))
        self.parts, seen, tokens = [], set(), []
        for a, b in pieces(offs, 1 << 20):
            s = Sets(data[offs[a] : offs[b]], offs[a : b + 1], n)
            own = [i for i in np.flatnonzero(s.size > 0).tolist() if (node := int(s.node[i])) not in seen and not seen.add(node)]
            stay = np.zeros(len(s.size), bool)
            stay[own] = True
            at = np.flatnonzero(stay[s.row])
            number = np.cumsum(stay) - 1
            self.parts.append((s.token[at], number[s.row[at]], s.node[own], s.size[own]))
            tokens.append(s.token[at] >> U64(16))
        self.tokens, self.count = np.unique(np.concatenate(tokens) if tokens else np.zeros(0, np.uint64), return_counts=True)

    def bounds(self, buckets: int) -> np.ndarray:
        """Where each bucket's tokens begin: buckets are ranges of the hash, so neighbours differ little."""
        return np.searchsorted(((self.tokens >> U64(16)) * U64(buckets)) >> U64(32), np.arange(buckets + 1, dtype=np.uint64))

    def dealt(self, chunk: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
        bounds = self.bounds(buckets)
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            step = np.diff(self.tokens[bounds[b] : bounds[b + 1]], prepend=U64(0))
            # Bytes of one weight lie together; the high ones are nearly all zero.
            yield chunk, b, C.pack(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T), self.count[bounds[b] : bounds[b + 1]].astype(np.uint32))

    def classes(self, replies: list[bytes]) -> np.ndarray:
        parts = sorted((C.unpack(r) for r in replies), key=lambda x: int(x[0][0]))
        return np.concatenate([p[1] for p in parts] or [np.zeros(0, np.uint8)])


def _answer_classes(bucket: int, asked: list[tuple[int, list[np.ndarray]]]) -> Iterator[tuple[int, bytes]]:
    """The binary logarithm of how many sets have each token; 0 for those of one set."""
    tokens = [np.cumsum(np.ascontiguousarray(a[0].reshape(8, -1).T).view(np.uint64).ravel()) for _, a in asked]
    distinct, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([a[1] for _, a in asked]), minlength=len(distinct))
    level = np.log2(total).astype(np.uint8)[inverse]
    at = 0
    for (chunk, _), own in zip(asked, tokens):
        yield chunk, C.pack(np.array([bucket]), level[at : at + len(own)])
        at += len(own)


def _prefix_sizes(size: np.ndarray, percent: int) -> np.ndarray:
    return size - -(-size * percent // 100) + 1


def entries(chunks: DataFrame, text: str, n: int, percent: int, buckets: int) -> DataFrame:
    """Each chunk's first tokens that other sets have too, with the nodes that have them, by bucket of the token."""
    exchange = C.Exchange(chunks, buckets)
    classes = exchange.answer(exchange.ask(lambda chunk, table: ChunkSets(table, text, n).dealt(chunk, buckets)), _answer_classes)

    def first(chunk: int, table: pa.Table, replies: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        sets = ChunkSets(table, text, n)
        level = sets.classes(replies)
        tokens, owners, nodes, sizes = [], [], [], []
        base = 0
        for token, row, node, size in sets.parts:
            own = level[np.searchsorted(sets.tokens, token >> U64(16))]
            by = np.lexsort((token, own, row))
            row = row[by]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = (place < _prefix_sizes(size, percent)[row]) & (own[by] > 0)
            tokens.append(token[by][keep])
            owners.append(row[keep] + base)
            nodes.append(node)
            sizes.append(size)
            base += len(node)
        if not base:
            return
        token, owner, node, size = (np.concatenate(x) for x in (tokens, owners, nodes, sizes))
        where = (token >> U64(20)) % U64(buckets)
        by = np.lexsort((token, where))
        bounds = np.searchsorted(where[by], np.arange(buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = by[bounds[b] : bounds[b + 1]]
            here, mine = np.unique(owner[own], return_inverse=True)
            yield chunk, b, C.pack(token[own], mine.astype(np.uint32), node[here], size[here].astype(np.uint32))

    return exchange.ask_again(classes, first)


def point_of(tokens: np.ndarray) -> np.ndarray:
    """The count vector of a set: the greatest power of two of groups that isn't over its size, GROUPS at least."""
    groups = max(GROUPS, 1 << (len(tokens).bit_length() - 1))
    return np.bincount((tokens >> U64(32)).astype(np.int64) & (groups - 1), minlength=groups)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Count vectors (rows) with fewer groups."""
    return points if points.shape[-1] == groups else points.reshape(*points.shape[:-1], -1, groups).sum(axis=-2)


class Pages:
    """A bucket's pages: nodes (`node`, `size`), and of each page its members, from `first` to the next; later the nodes' points."""

    def __init__(self, blob: bytes, points: dict[int, np.ndarray] | None = None):
        self.node, size, self.first, member, *own = C.unpack(blob)
        self.size, self.member = size.astype(np.int64), member.astype(np.int64)
        self.coarse = None
        if points is not None:
            own = [np.concatenate([points[x] for x in self.node.tolist()]), np.array([len(points[x]) for x in self.node.tolist()], np.uint32)]
        if own:
            counts, self.groups = own[0].astype(np.int32), own[1].astype(np.int64)
            ends = np.cumsum(self.groups)
            # Points of one length stand in one matrix: row[i] is node i's.
            self.row, self.matrix = np.zeros(len(self.node), np.int64), {}
            self.coarse = np.zeros((len(self.node), GROUPS), np.int32)
            for g in np.unique(self.groups).tolist():
                same = np.flatnonzero(self.groups == g)
                self.row[same] = np.arange(len(same))
                self.matrix[g] = counts[ends[same][:, None] - g + np.arange(g)]
                self.coarse[same] = folded(self.matrix[g], GROUPS)

    @staticmethod
    def of(blobs: list[bytes], buckets: int) -> Iterator[tuple[int, bytes]]:
        """Of a bucket of tokens, all pages of at least two nodes, by the bucket of their least node.

        Near copies share many tokens, and so many pages; by their least node these meet again, and equal ones become one.
        """
        parts = [C.unpack(b) for b in blobs]
        node = np.concatenate([p[2] for p in parts])
        base = np.cumsum([0] + [len(p[2]) for p in parts])
        distinct, first, inverse = np.unique(node, return_index=True, return_inverse=True)
        token = np.concatenate([p[0] for p in parts])
        member = inverse[np.concatenate([p[1].astype(np.int64) + base[i] for i, p in enumerate(parts)])]
        by = np.lexsort((member, token))
        token, member = token[by], member[by]
        keep = segments(token, member)
        token, member = token[keep], member[keep]
        at = segments(token)
        count = np.diff(np.append(at, len(token)))
        at, count = at[count > 1], count[count > 1]
        size = np.concatenate([p[3] for p in parts])[first]
        where = mix(distinct[member[at]].view(np.uint64)) % U64(buckets)
        for b in np.unique(where).tolist():
            own = np.flatnonzero(where == b)
            used, mine = np.unique(member[ranges(at[own], count[own])], return_inverse=True)
            yield int(b), C.pack(distinct[used], size[used], np.concatenate([[0], np.cumsum(count[own])]), mine.astype(np.uint32))

    @staticmethod
    def joined(blobs: list[bytes]) -> bytes:
        """The blob of the distinct pages of several."""
        parts = [C.unpack(b) for b in blobs]
        node, first, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        pages: dict[bytes, int] = {}
        for i, (_, _, ends, member) in enumerate(parts):
            own = inverse[member.astype(np.int64) + base[i]].astype(np.uint32)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                pages.setdefault(own[a:b].tobytes(), b - a)
        return C.pack(node, np.concatenate([p[1] for p in parts])[first], np.concatenate([[0], np.cumsum(list(pages.values()))]), np.frombuffer(b"".join(pages), np.uint32))

    def blob(self) -> bytes:
        counts = np.concatenate([self.matrix[g][r] for g, r in zip(self.groups.tolist(), self.row.tolist())])
        return C.pack(self.node, self.size.astype(np.uint32), self.first, self.member.astype(np.uint32), counts.astype(np.uint16 if counts.max(initial=0) < 1 << 16 else np.uint32), self.groups.astype(np.uint32))

    def bound(self, own: np.ndarray, x: int, percent: int) -> np.ndarray:
        """For each of the nodes, what the summed minima with node x leave above the threshold; below 0 they can't link."""
        most = np.minimum(self.coarse[own], self.coarse[x]).sum(axis=1)
        out = 100 * most - percent * (self.size[own] + self.size[x] - most)
        point = self.matrix[int(self.groups[x])][self.row[x]]
        for g in np.unique(self.groups[own[out >= 0]]).tolist():
            at = np.flatnonzero((out >= 0) & (self.groups[own] == g))
            common = min(g, len(point))
            if common > GROUPS:
                most = np.minimum(folded(self.matrix[g][self.row[own[at]]], common), folded(point, common)).sum(axis=1)
                out[at] = 100 * most - percent * (self.size[own[at]] + self.size[x] - most)
        return out

    def lists(self) -> Iterator[np.ndarray]:
        for a, b in zip(self.first[:-1], self.first[1:]):
            yield self.member[a:b]


class RTree:
    """A packed R-tree over count vectors. Nodes keep the greatest coordinates and the least size of what is below."""

    def __init__(self, pages: Pages, own: np.ndarray, percent: int):
        self.pages, self.percent = pages, percent
        by = own
        parts = [by]
        while len(parts[0]) > LEAF:  # halve along the widest coordinate until leaves are small
            split = []
            for p in parts:
                values = pages.coarse[p]
                axis = int(np.argmax(values.max(axis=0) - values.min(axis=0)))
                order = np.argsort(values[:, axis], kind="stable")
                split += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
            parts = split
        self.leaves = parts
        self.levels = [(np.stack([pages.coarse[p].max(axis=0) for p in parts]), np.array([pages.size[p].min() for p in parts]))]
        while len(self.levels[-1][0]) > 1:
            top, least = self.levels[-1]
            self.levels.append((np.maximum(top[0::2], top[1::2]), np.minimum(least[0::2], least[1::2])))

    def near(self, x: int) -> np.ndarray:
        """Nodes whose bound with x reaches the threshold, x too."""
        at = np.zeros(1, np.int64)
        for k, (top, least) in enumerate(reversed(self.levels)):
            if k:
                at = np.concatenate([2 * at, 2 * at + 1])
            most = np.minimum(top[at], self.pages.coarse[x]).sum(axis=1)
            at = at[100 * most >= self.percent * (least[at] + self.pages.size[x] - most)]
            if not len(at):
                return at
        own = np.concatenate([self.leaves[i] for i in at])
        return own[self.pages.bound(own, x, self.percent) >= 0]


def stars(pages: Pages, page: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that cover the page: each node that is in reach of an earlier leader is paired with the first such leader."""
    tree = RTree(pages, page, percent)
    out, left = [], page
    free = np.zeros(len(pages.node), bool)
    free[page] = True
    while len(left) > 1:
        leader = int(left[0])
        free[leader] = False
        reach = tree.near(leader)
        reach = reach[free[reach]]
        free[reach] = False
        out.append(np.stack([np.full(len(reach), leader), reach], axis=1))
        left = left[free[left]]
    return np.concatenate(out)


def crossing(pages: Pages, page: np.ndarray, label: np.ndarray, percent: int, best: bool) -> np.ndarray:
    """Pairs of the page with different labels whose bound reaches the threshold; if best, one for each node outside the largest label, apart from the stars' pairs."""
    names, inverse, count = np.unique(label[page], return_inverse=True, return_counts=True)
    if len(names) < 2:
        return np.zeros((0, 2), np.int64)
    outside = page[inverse != np.argmax(count)]
    tree = RTree(pages, page, percent)
    tested = {(a, b) for a, b in np.sort(stars(pages, page, percent), axis=1).tolist()} if best else ()
    out = []
    for x in outside.tolist():
        reach = tree.near(x)
        reach = reach[label[reach] != label[x]]
        if best and len(reach):
            score = pages.bound(reach, x, percent)
            reach = next(([y] for y in reach[np.argsort(-score, kind="stable")].tolist() if (min(x, y), max(x, y)) not in tested), [])
        out.append(np.stack([np.full(len(reach), x), np.asarray(reach, np.int64)], axis=1))
    return np.concatenate(out)


def _pairs_batch(pages: Pages, found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.sort(pages.node[np.concatenate(found)], axis=1) if found else np.zeros((0, 2), np.int64)
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])


def first_pairs(pages: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                p = Pages(blob.as_py())
                yield _pairs_batch(p, [stars(p, page, percent) for page in p.lists()])

    return pages.mapInArrow(run, "a long, b long").distinct()


def _members(pages: DataFrame) -> DataFrame:
    """(bucket, node) of the nodes in each bucket's pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
                node = C.unpack(blob.as_py())[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), bucket), pa.int32()), pa.array(node, pa.int64())], names=["bucket", "node"])

    return pages.mapInArrow(run, "bucket int, node long")


def with_points(pages: DataFrame, points: DataFrame) -> DataFrame:
    """The pages with their nodes' points; points is (node, own)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = {node: C.unpack(own)[0] for node, own in zip(right.column("node").to_pylist(), right.column("own").to_pylist())}
        rows = [(bucket, Pages(blob, known).blob()) for bucket, blob in zip(left.column("bucket").to_pylist(), left.column("blob").to_pylist())]
        return pa.Table.from_batches([C.batch_of(rows, ["bucket", "blob"], [pa.int32(), pa.binary()])])

    own = _members(pages).join(points, "node").select("bucket", "node", "own")
    return pages.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(run, "bucket int, blob binary")


def later_pairs(pages: DataFrame, labels: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs of `crossing`; labels has (a, b): the node, and its component."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        node, root = (np.asarray(right.column(c), np.int64) for c in ("a", "b"))
        order = np.argsort(node)
        node, root = node[order], root[order]
        for blob in left.column("blob").to_pylist():
            p = Pages(blob)
            label = p.node.copy()
            if len(node):
                at = np.minimum(np.searchsorted(node, p.node), len(node) - 1)
                label = np.where(node[at] == p.node, root[at], label)
            out.append(_pairs_batch(p, [crossing(p, page, label, percent, best) for page in p.lists()]))
        return pa.Table.from_batches(out, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    known = _members(pages).withColumnRenamed("node", "a").join(labels, "a").select("bucket", "a", "b")
    return pages.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(run, "a long, b long").distinct()


def described(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, text: str, key: str, n: int, describe) -> DataFrame:
    """(node, own) of each wanted node, where own packs what describe(tokens) makes of its set; checkpointed."""
    need = C.checkpointed(wanted.distinct().join(nodes, "node"))
    need = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = np.asarray(batch.column("node"), np.int64)
            for a, b, s in _sets(batch, text, n):
                own = np.flatnonzero(s.node == want[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(s.node[own], pa.int64()), pa.array([C.pack(describe(s.token[s.first[i] : s.first[i + 1]])) for i in own], pa.binary())], names=["node", "own"])

    return C.checkpointed(docs.select(key, text).join(need, key).select("node", text).mapInArrow(run, "node long, own binary"))


def sets_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(np.cumsum(x), np.cumsum(y), assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, text: str, key: str, n: int, percent: int) -> DataFrame:
    """Those of the (checkpointed) pairs of nodes whose whole sets link."""
    both = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    known = described(both, docs, nodes, text, key, n, lambda tokens: np.diff(tokens, prepend=U64(0)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last, x = None, None
            for a, one, two in zip(batch.column("a").to_pylist(), batch.column("own_a"), batch.column("own_b")):
                if a != last:
                    last, x = a, C.unpack(one.as_py())[0]
                keep.append(sets_link(x, C.unpack(two.as_py())[0], percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    one = known.select(F.col("node").alias("b"), F.col("own").alias("own_b"))
    two = known.select(F.col("node").alias("a"), F.col("own").alias("own_a"))
    return C.checkpointed(pairs.join(one, "b").join(two, "a").mapInArrow(compare, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of each document: the least `key` that its links reach, itself included.

    A document's set holds its distinct n-word shingles (words [^\\x20\\x09-\\x0D]+, A-Z lower-cased); with fewer words, the
    whole sequence as one. Two documents link when 100 * intersection >= percent * union. A null, empty or blank text has
    an empty set and links with nothing. A document without a key links with nothing either and has a null component_id.
    Repeated rows give repeated result rows. The key must be an integer, or it is a TypeError. An empty table gives an empty result. A
    text of any length is one set, whole, which takes some 50 bytes of memory for each of its bytes.
    """
    C.check_key(docs, key)
    C.small_batches(docs.sparkSession)
    found = C.checkpointed(features(docs, text, key, n))
    nodes = found.where(F.col("node").isNotNull() & F.col(key).isNotNull()).groupBy("node").agg(F.min(key).alias(key))
    known = docs.where(F.col(key).isNotNull())
    chunks = C.pack_documents(known.select(text), text)
    buckets = C.bucket_count(chunks, CHUNKS_A_BUCKET)

    groups = max(12, buckets // PAGE_BUCKETS_PART)

    def page(bucket: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([C.batch_of(list(Pages.of([blob for _, _, blob in C.opened(table.column("blob").to_pylist())], groups)), ["bucket", "blob"], [pa.int32(), pa.binary()])])

    def join(bucket: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([C.batch_of([(bucket[0].as_py(), Pages.joined(table.column("blob").to_pylist()))], ["bucket", "blob"], [pa.int32(), pa.binary()])])

    pages = entries(chunks, text, n, percent, buckets).groupBy("place").applyInArrow(page, "bucket int, blob binary")
    pages = C.checkpointed(pages.groupBy("bucket").applyInArrow(join, "bucket int, blob binary"))
    points = described(_members(pages).select("node"), known, nodes, text, key, n, lambda tokens: point_of(tokens).astype(np.uint32))
    pages = C.checkpointed(with_points(pages, points))
    tested = C.checkpointed(first_pairs(pages, percent))
    links = verified(tested, known, nodes, text, key, n, percent)
    labels = components(links)
    for best in (True, False):
        more = C.checkpointed(later_pairs(pages, labels, percent, best).join(tested, ["a", "b"], "left_anti"))
        if more.isEmpty():
            continue
        new = verified(more, known, nodes, text, key, n, percent)
        tested = tested.unionByName(more)
        if not new.isEmpty():
            links = links.unionByName(new)
            labels = components(labels.unionByName(new))
    # A component's least document, by node first: a third of all documents may be copies, and a third of all nodes one component.
    own = labels.select(F.col("a").alias("node"), F.col("b").alias("other"))
    rooted = C.checkpointed(nodes.join(own, "node", "left").select("node", F.coalesce("other", "node").alias("root"), F.col(key).alias("__least")))
    least = rooted.groupBy("root").agg(F.min("__least").alias("component_id"))
    named = salted_join(rooted.select("node", "root"), least, "root").select("node", "component_id")
    out = salted_join(found, named, "node")
    return out.select(key, "n_shingles", F.when(F.col(key).isNotNull(), F.coalesce("component_id", key)).alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
