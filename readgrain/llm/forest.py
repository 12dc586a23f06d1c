"""N-gram Jaccard join by a MinHash LSH forest and exact verification.

Each text gives, for TREES trees, a path of DEPTH MinHash values of its five-word shingles. The paths of all trees are sorted (one range
sort over tree, path and text), which is a prefix trie of each tree: texts below a node of the trie stand together, and neighbours' common
prefixes say how deep they part. How long a prefix two texts must share follows from the threshold alone, not from what a sample of the
table looks like: prefixes are shortened from DEPTH on until the expected recall of pairs that are just as alike as the threshold, which
share the fewest prefixes of all pairs to be found, reaches the target. So it holds for each pair, and not for the average of a table's.

One pass over the sorted paths then ties texts below the same node. Texts that only chance has put there are kept apart by one-bit
sketches: a text becomes a leader if no leader is near it, and texts are tied to all leaders that can be near a text near them (the
triangle inequality of the Jaccard distance, and four standard errors of the sketches). What a node ties together is passed on as one tie
a text. The components of the ties are the groups in which all pairs are verified, exactly, on shingle sets. A range border within a node
costs nothing: both sides are tied. The ties of a few trees are followed first, and the other trees only tie what isn't in one group yet.

A group is cut into classes of similar size, as texts of less than THRESHOLD times the shingles of another can't be near it, and classes
into blocks by hash. Each pair of blocks of the same or of neighbouring classes is a task's work: it counts common shingles by a matrix
product and returns one row per text, with the number of its links and the smallest text it hangs together with. So rows grow with the
number of blocks, not of pairs, no pair within a group is left out, and no group lands in one task. Exact copies are one text throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from readgrain.llm.common import Cache, documents, forget, gathered, materialise, slices, task
from readgrain.llm.graph import components
from readgrain.llm.member import maybe_members

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 28, 8, 0.9998
#: Trees whose ties are followed before those of the others are looked for.
FIRST = 7
#: A block's texts, and its shingles in all.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Rows of one trie node that are looked at together.
PIECE = 1 << 16
ODD = 0x9E3779B97F4A7C15
MASK = 2**64 - 1


def expected_recall(likeness: float, length: int, trees: int = TREES) -> float:
    """The probability that two texts share a prefix in a tree at least."""
    return 1 - (1 - likeness**length) ** trees


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def make_shingler(width: int = WORDS):  # noqa: ANN201
    """A function from a text to the 64-bit hashes of its word n-grams; a shorter text is one n-gram, a text without words none."""
    import numpy as np

    cache = Cache(word_hash, 300_000)
    keys = [np.uint64((ODD * (2 * i + 1)) & MASK) for i in range(width)]

    def each(text: str) -> np.ndarray:
        words = text.encode("utf-8").split()
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        if max(map(len, words)) > 64:
            h = np.fromiter((cache[w] if len(w) <= 64 else word_hash(w) for w in words), np.uint64, n)
        else:
            h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
        m = max(1, n - width + 1)
        x = np.zeros(m, np.uint64)
        for i in range(min(width, n)):
            x += (h[i : i + m] ^ (h[i : i + m] >> np.uint64(29))) * keys[i]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    return each


def make_paths(trees: int = TREES, depth: int = DEPTH):  # noqa: ANN201
    """A function from shingle hashes to the MinHash values of all paths (trees * depth of 16 bits, in the order of bytes) and a sketch of one bit of each."""
    import numpy as np

    r = np.random.default_rng(5)
    n = trees * depth
    a = r.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = r.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)

    def each(shingles: np.ndarray) -> tuple[bytes, bytes]:
        h = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(n, 2**32 - 1, np.uint32)
        for at in range(0, len(h), 4096):
            x = np.multiply.outer(a, h[at : at + 4096])
            x += b[:, None]
            np.minimum(low, x.min(axis=1), out=low)
        low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        low ^= low >> np.uint32(13)
        return (low >> np.uint32(16)).astype(">u2").tobytes(), np.packbits((low & np.uint32(1)).astype(bool)).tobytes()

    return each


def text_key(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8")).digest()


def signatures(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """doc_id, key (of the text; null for a text without words), node (the key's first 64 bits), shingles (their number), path and sketch."""
    schema = StructType.fromDDL(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, node long, shingles int, path binary, sketch binary")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingle, path = make_shingler(), make_paths(trees, depth)

        def of(t: str) -> tuple:
            s = np.unique(shingle(t))
            if not len(s):
                return (None,) * 5
            key = text_key(t)
            return key, int.from_bytes(key[:8], "big", signed=True), len(s), *path(s)

        types = (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        for batch in batches:
            for part in slices(batch, 1, 1000):
                got = zip(*[of(t or "") for t in part.column(1).to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(got, types, strict=True))], schema.names)

    return docs.select("doc_id", "text").mapInArrow(task(run), schema)


def prefix_length(near: dict[tuple[int, int], int] | None = None, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> tuple[int, float, float]:
    """The longest prefix at which pairs are found with the target recall: its length, the recall expected of pairs as alike as these, and the share of these that is found.

    near: (equal MinHash values, longest common prefix in a tree) -> number of pairs. Without any, prefixes are shortened for pairs at the
    threshold itself, so that each pair at the threshold or above is found with the target recall.
    """
    seen = near or {(threshold * trees * depth, depth): 1}
    total = sum(seen.values())
    for k in range(depth, 0, -1):
        expected = sum(n * expected_recall(same / (trees * depth), k, trees) for (same, _), n in seen.items()) / total
        found = sum(n for (_, run), n in seen.items() if run >= k) / total
        if k == 1 or expected >= recall and found >= recall:
            return k, expected, found
    raise AssertionError


def cuts(threshold: float, values: int) -> tuple[int, int]:
    """Equal bits of two sketches at which a text needs no leader of its own, and at which it is tied to a leader.

    A text is as near to its leader as the threshold by its sketch; its true distance is larger by up to four standard errors. What is
    near the text is then within that distance and 1 - threshold of the leader, and its sketch says so up to four standard errors again.
    """
    error = lambda j: 2 * math.sqrt((1 + j) / 2 * (1 - j) / 2 / values)
    far = (1 - threshold) + 4 * error(threshold)
    least = max(0.0, 1 - far - (1 - threshold))
    least = max(0.0, least - 4 * error(least))
    return math.ceil((1 + threshold) / 2 * values), math.floor((1 + least) / 2 * values)


def led(labels, sketches, values: int, own: int, tied: int):  # noqa: ANN001, ANN201
    """Of the texts below one trie node: numbers of the components that they are in, by ties to leaders and by equal labels.

    Texts near a leader become no leaders. Once all are in one component, no further leader can tie anything.
    """
    import numpy as np

    found, part = np.unique(labels, return_inverse=True)
    n, left = len(found), np.arange(len(labels))
    while n > 1 and len(left):
        at = left[0]
        same = values - np.bitwise_count(sketches ^ sketches[at]).sum(axis=1, dtype=np.int64)
        near = same >= tied
        near[at] = True
        ids = np.unique(part[near])
        if len(ids) > 1:
            part[np.isin(part, ids)] = ids[0]
            n -= len(ids) - 1
        left = left[same[left] < own]
        left = left[left != at]
    return part


def ties(texts: DataFrame, trees: range, length: int, threshold: float, values: int, depth: int) -> DataFrame:
    """a and b: labels of texts that share a prefix of `length` values in one of the trees and may be near. texts has a label per text; texts of one label are tied already."""
    tree = F.posexplode(F.array(*[F.substring("path", 2 * depth * t + 1, 2 * depth) for t in trees])).alias("tree", "path")
    rows = texts.select("label", "node", "sketch", tree)
    sorted_paths = rows.repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node").select("tree", "path", "label", "sketch")
    own, tied = cuts(threshold, values)
    width, size = 2 * length, -(-values // 64) * 8

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def arrays(batch: pa.RecordBatch) -> list:
            n = batch.num_rows
            place = np.empty((n, width + 1), np.uint8)
            place[:, 0] = batch.column(0).to_numpy()
            place[:, 1:] = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, -1)[:, :width]
            bits = np.zeros((n, size), np.uint8)
            bits[:, : -(-values // 8)] = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, -1)
            return [place, batch.column(2).to_numpy(), bits.view(np.uint64)]

        def batch_of(a, b, place) -> pa.RecordBatch:  # noqa: ANN001
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(place, pa.binary())], ["a", "b", "place"])

        def ended(kept: list, borders: set[int]) -> Iterator:
            """Ties of all runs in kept; of the runs that begin at `borders` also the first label of each component, with their place."""
            place, labels, bits = kept
            fresh = np.ones(len(labels), bool)
            fresh[1:] = (place[1:] != place[:-1]).any(axis=1)
            start = np.nonzero(fresh)[0]
            count = np.diff(np.append(start, len(labels)))
            two = start[count == 2]
            near = (values - np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1, dtype=np.int64) >= tied) & (labels[two] != labels[two + 1])
            a, b = [labels[two + 1][near]], [labels[two][near]]
            edges: list = []
            for s, n in zip(start.tolist(), count.tolist(), strict=True):
                if n <= 2 and s not in borders:
                    continue
                own_labels = labels[s : s + n]
                part = led(own_labels, bits[s : s + n], values, own, tied)
                first = np.full(int(part.max()) + 1, np.iinfo(np.int64).max)
                np.minimum.at(first, part, own_labels)
                if n > 2:
                    pairs = np.unique(np.c_[own_labels, first[part]], axis=0)
                    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                    a.append(pairs[:, 0])
                    b.append(pairs[:, 1])
                if s in borders:
                    edges += [(int(x), place[s].tobytes()) for x in np.unique(first[part])]
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield batch_of(a, b, [None] * len(a))
            if edges:
                yield batch_of([x for x, _ in edges], [None] * len(edges), [p for _, p in edges])

        kept, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            new = arrays(batch)
            kept = new if kept is None else [np.concatenate([x, y]) for x, y in zip(kept, new, strict=True)]
            fresh = np.nonzero((kept[0][1:] != kept[0][:-1]).any(axis=1))[0]
            last = int(fresh[-1]) + 1 if len(fresh) else 0  # where the run begins that isn't over
            whole = len(kept[1]) - last > PIECE
            at = len(kept[1]) if whole else last
            if at:
                done = [x[:at] for x in kept]
                yield from ended(done, ({0} if first else set()) | ({last} if whole else set()))
                # a piece that was cut off goes on with the next rows
                first = whole
                kept = [x[at:] for x in kept]
        if kept is not None and len(kept[1]):
            fresh = np.nonzero((kept[0][1:] != kept[0][:-1]).any(axis=1))[0]
            yield from ended(kept, ({0} if first else set()) | {int(fresh[-1]) + 1 if len(fresh) else 0})

    found = materialise(gathered(sorted_paths.mapInArrow(task(run), "a long, b long, place binary")), "forest-ties")
    edges = found.filter("b IS NULL").select("a", "place")
    hubs = edges.groupBy("place").agg(F.min("a").alias("b"))
    across = edges.join(hubs, "place").filter("a != b").select("a", "b")
    return found.filter("b IS NOT NULL").select("a", "b").union(across).distinct()


def candidate_groups(texts: DataFrame, length: int, threshold: float, trees: int, depth: int, first: int = FIRST) -> DataFrame:
    """node and group, for the texts that are tied to another.

    The first trees tie most of what is near; in the others only texts that aren't in one group yet are tied, so a large group doesn't
    give its ties in every tree.
    """
    groups = lambda rows, of, name: components(materialise(gathered(ties(rows, of, length, threshold, trees * depth, depth)), f"{name}-ties"), "a", "b", name)
    one = materialise(gathered(groups(texts.withColumn("label", F.col("node")), range(min(first, trees)), "forest-first").select(F.col("node").alias("_n"), F.col("root").alias("_r"))), "forest-first")
    # 16 bytes a row; beyond a million rows the join is left to the planner
    known = F.broadcast(one) if one.count() <= 1_000_000 else one
    labelled = texts.join(known, F.col("node") == F.col("_n"), "left").withColumn("label", F.coalesce("_r", "node")).drop("_n", "_r")
    two = groups(labelled, range(min(first, trees), trees), "forest-second").select(F.col("node").alias("_a"), F.col("root").alias("_b"))
    # texts of the first groups, and those that only the second trees tie
    left = one.join(two, F.col("_r") == F.col("_a"), "left").select(F.col("_n").alias("node"), F.coalesce("_b", "_r").alias("group"))
    more = two.join(one, F.col("_a") == F.col("_n"), "left_anti").select(F.col("_a").alias("node"), F.col("_b").alias("group"))
    return materialise(gathered(left.union(more)), "forest-groups")


def overlaps(left: list, right: list | None):  # noqa: ANN001, ANN201
    """Numbers of common elements of sorted sets: a matrix, left against right, or left against left."""
    import numpy as np

    sets = left if right is None else left + right
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    start = np.empty(len(value), bool)
    start[0] = True
    np.not_equal(value[1:], value[:-1], out=start[1:])
    run = np.cumsum(start) - 1
    often = np.bincount(run)[run] > 1  # a value of one set alone is common to none
    owner, run = owner[often], run[often]
    if not len(run):
        return np.zeros((len(left), len(left if right is None else right)), np.int64)
    ids = np.cumsum(np.concatenate([[0], (run[1:] != run[:-1]).astype(np.int64)]))
    n, total = len(left), np.zeros((len(left), len(left if right is None else right)))
    for low in range(0, int(ids[-1]) + 1, 4096):
        a, b = np.searchsorted(ids, [low, low + 4096])
        m = np.zeros((len(sets), min(4096, int(ids[-1]) + 1 - low)), np.float32)
        m[owner[a:b], ids[a:b] - low] = 1
        total += m[:n] @ (m.T if right is None else m[n:].T)
    return np.rint(total).astype(np.int64)


def hanging_together(near):  # noqa: ANN001, ANN201
    """Per row of a symmetric boolean matrix, the first row that links lead to."""
    import numpy as np

    top = np.arange(len(near))
    open_ = near.any(axis=1)
    for i in range(len(near)):
        if not open_[i]:
            continue
        seen, front = np.zeros(len(near), bool), np.zeros(len(near), bool)
        front[i] = True
        while front.any():
            seen |= front
            front = near[front].any(axis=0) & ~seen
        top[seen] = i
        open_ &= ~seen
    return top


def verify(keys: list[bytes], sets: list, side: list[int], threshold: float) -> Iterator[tuple[bytes, bytes, int]]:
    """(key, smallest key it hangs together with, links) of the texts with a link; side: 0 and 1 for two blocks, all 0 for one."""
    import numpy as np

    order = sorted(range(len(keys)), key=keys.__getitem__)
    a = [i for i in order if side[i] == 0]
    b = [i for i in order if side[i] == 1]
    common = overlaps([sets[i] for i in a], [sets[i] for i in b] if b else None)
    size = np.array([len(s) for s in sets])
    other = b or a
    near = common >= threshold / (1 + threshold) * (size[a][:, None] + size[other][None, :]) - 1e-9
    whole = np.zeros((len(keys), len(keys)), bool)
    whole[np.ix_(a, other)] = near
    whole |= whole.T
    np.fill_diagonal(whole, False)
    whole = whole[np.ix_(order, order)]
    links, top = whole.sum(axis=1), hanging_together(whole)
    return ((keys[order[i]], keys[order[top[i]]], int(links[i])) for i in np.nonzero(links)[0])


def dealt(members: DataFrame, threshold: float, block: int, most: int = BLOCK_SHINGLES) -> DataFrame:
    """members with their size class, own block, and numbers of blocks: of the class (parts), of the next smaller (below) and the next larger one (above)."""
    step = math.log(1 / threshold) * 1.0001  # texts whose sizes differ by less than the threshold allows are at most a class apart
    members = members.withColumn("class", F.floor(F.ln("shingles") / step).cast("int"))
    sizes = members.groupBy("group", "class").agg(F.count("*").alias("n"), F.sum("shingles").alias("all"))
    sizes = sizes.withColumn("parts", F.greatest(F.ceil(F.col("n") / F.lit(block)), F.ceil(F.col("all") / F.lit(most))).cast("int"))
    by = Window.partitionBy("group").orderBy("class")
    near = lambda f, d: F.when(f("class").over(by) == F.col("class") + d, f("parts").over(by)).otherwise(0).alias("below" if d < 0 else "above")
    sizes = materialise(gathered(sizes.select("group", "class", "parts", near(F.lag, -1), near(F.lead, 1))), "forest-sizes")
    return members.join(sizes, ["group", "class"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))


def links(docs: DataFrame, texts: DataFrame, groups: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """key, root and links, from each pair of blocks in which the key has a link."""
    members = texts.join(groups, "node").select("key", "rep", "shingles", "group")
    placed = materialise(gathered(dealt(members, threshold, block).select(F.col("rep").alias("_rep"), "key", "group", "class", "parts", "below", "above", "own")), "forest-members")
    # only texts that can be members leave the map side, as shingles
    some = maybe_members(docs.select("doc_id", "text"), "doc_id", placed, "_rep", "_can").filter("_can").select("doc_id", "text")
    schema = StructType.fromDDL(f"_doc {docs.schema['doc_id'].dataType.simpleString()}, _key binary, shingles binary")

    def shingled(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingle = make_shingler()
        for batch in batches:
            for part in slices(batch, 1, 500):
                found = [(text_key(t or ""), np.unique(shingle(t or "")).tobytes()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([k for k, _ in found], pa.binary()), pa.array([s for _, s in found], pa.binary())], schema.names)

    sets = some.mapInArrow(task(shingled), schema).join(placed, F.col("_doc").eqNullSafe(F.col("_rep")) & (F.col("_key") == F.col("key")))
    own, low = F.col("own"), F.col("class")
    to = lambda n, make: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0))), make)).otherwise(F.array())
    unit = lambda c, p, up, q, side: F.struct(c.alias("c"), p.alias("p"), F.lit(up).alias("up"), q.alias("q"), side.cast("int").alias("side"))
    units = F.concat(
        to("parts", lambda o: unit(low, F.least(own, o), 0, F.greatest(own, o), own > o)),
        to("below", lambda o: unit(low - 1, o, 1, own, F.lit(1))),
        to("above", lambda o: unit(low, own, 1, o, F.lit(0))),
    )
    # one unit of work per pair of blocks; a task reads its units one after another
    work_rows = sets.select("group", "key", "shingles", F.explode(units).alias("u")).select("group", "u.c", "u.p", "u.up", "u.q", "u.side", "key", "shingles")
    work_rows = work_rows.repartition("group", "c", "p", "up", "q").sortWithinPartitions("group", "c", "p", "up", "q")

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        now, rows, out = None, {}, []

        def done() -> Iterator:
            one = not now[3] and now[2] == now[4]
            side = [0 if one else s for s, _ in rows.values()]
            if len(rows) > 1 and (one or len(set(side)) > 1):
                yield from verify(list(rows), [np.frombuffer(s, np.uint64) for _, s in rows.values()], side, threshold)

        def batch_of(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["key", "root", "links"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:6]]
            for i in range(batch.num_rows):
                at = tuple(c[i] for c in columns[:5])
                if at != now:
                    if now is not None:
                        out += done()
                    now, rows = at, {}
                    if len(out) >= 5000:
                        yield batch_of(out)
                        out = []
                rows[batch.column(6)[i].as_py()] = (columns[5][i], batch.column(7)[i].as_py())
        if now is not None:
            out += done()
        if out:
            yield batch_of(out)

    return work_rows.mapInArrow(task(work), "key binary, root binary, links long")


def join(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, key, class_id (the smallest doc_id of the class), n_links (other texts at the threshold or above) and copies (rows with this text), a row per row.

    Words are runs without ASCII blanks, compared as they are. A class holds all texts that links join, and all copies of each. Null
    texts and texts without words have no links; each such row is its own class, with its own doc_id. A text of fewer than five words has
    one shingle, all of it. Very long texts are read whole. Rows with a null doc_id keep their class, whose class_id is null if no other
    row is in it. An empty table gives no rows. Columns other than doc_id and text aren't read.
    """
    sigs = materialise(signatures(docs, trees, depth), "forest-signatures")
    keys = materialise(sigs.select("doc_id", "key"), "forest-keys")
    texts = sigs.filter(F.col("key").isNotNull()).groupBy("key", "node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("shingles", "path", "sketch")])
    texts = materialise(texts, "forest-texts")
    forget(sigs)
    length = prefix_length(None, threshold, trees, depth, recall)[0]
    groups = candidate_groups(texts, length, threshold, trees, depth)
    found = materialise(gathered(links(docs, texts.drop("path", "sketch"), groups, threshold, block)), "forest-links")
    per = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    roots = components(found.filter("key != root").select("key", "root"), "key", "root", "forest-classes")
    tied = texts.select("key", "rep").join(roots, F.col("key") == F.col("node")).select("key", "root", "rep")
    least = tied.groupBy("root").agg(F.min("rep").alias("least"))
    tied = tied.join(least, "root").join(per, "key").select(F.col("key").alias("_k"), "least", "n_links")
    classes = texts.select("key", "rep", "copies").join(tied, F.col("key") == F.col("_k"), "left").select(F.col("key").alias("_key"), F.coalesce("least", "rep").alias("class"), "n_links", "copies")
    # written, so that the join below has a plain exchange on either side, and a text with very many copies can be split
    classes = materialise(gathered(classes), "forest-texts-classes")
    both = keys.join(classes, F.col("key") == F.col("_key"), "left")
    return both.select(
        "doc_id", "key", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies")
    )


def distinct_documents(docs: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """docs without the rows that have a class mate with a smaller doc_id, and without all but one of those with equal id and text.

    All rows of null texts and texts without words stay. Columns of docs are as they were, whatever their names; of rows with equal id and
    text any one stays. An empty table gives an empty one.
    """
    classes = materialise(gathered(join(docs, **how)), "forest-documents")
    gone = classes.filter(F.col("key").isNotNull() & F.col("class_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__rg_id"), F.col("key").alias("__rg_key")).distinct()
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    gone = materialise(gathered(gone), "forest-gone")
    # rows that can't be gone stay where they are; only the others are joined
    marked = maybe_members(docs, "doc_id", gone, "__rg_id", "__rg_can")
    rest = marked.filter("__rg_can").select(*docs.columns).join(gone, F.col("doc_id").eqNullSafe(F.col("__rg_id")) & (key == F.col("__rg_key")), "left_anti")
    kept = marked.filter("NOT __rg_can").select(*docs.columns).unionByName(rest)
    twice = classes.filter("copies > 1").groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("__rg_id"), F.col("key").alias("__rg_key"))
    twice = materialise(gathered(twice), "forest-repeats")
    if twice.isEmpty():
        return kept
    same = F.col("doc_id").eqNullSafe(F.col("__rg_id")) & (key == F.col("__rg_key"))
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir)).drop("key")
