"""N-gram Jaccard join (operator 3): vertical partitioning of the global n-gram order.

Documents are sets of 5-word shingles; two link at similarity 0.8 or more. Equal sets form one
*class*, named by a 64-bit digest of the set, so copies never become pairs.

Global order
    By corpus frequency, rarest first, then by hash. Frequencies come from all documents
    through a sketch of fixed size (2**20 counters); any common order gives exact results, a good one keeps frequent
    passages out of the prefixes. Cut points split the order into ``fragments`` of equal weight.

Candidates
    Similar sets share an n-gram within their first ``n - ceil(0.8 n) + 1`` (prefix filter). Postings of
    prefixes are dealt by n-gram; lists of up to ``small`` classes give their pairs that pass the
    length and position filters. A longer list gives a star only: its classes against its centre, the
    class whose n-grams are most frequent, which is what a group of near copies shares. An n-gram that the sketch
    counts above ``hot`` is dealt by n-gram and salt, so no task holds its whole list; the centres of the
    salted parts then form a star among themselves.

Verification
    For each pair and fragment the overlap of the two segments is counted apart; the sum per pair
    decides exactly.

The rest of long lists
    After linking, classes of a long list in *different* components are compared inside tasks through
    upper bounds (overlap of 256 per-bucket counts, which never is below the true overlap); only pairs
    whose bound reaches the threshold are emitted and verified. One side of a comparison is always outside the
    list's largest component, and sizes more than the threshold apart never meet, so a list that is one group of
    near copies and a few others costs about its length. So no link between different
    components is lost, and a group of near copies never is expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwise.llm.components import connected
from blockwise.llm.frames import fresh_name, saved, scratch, table, tree_merge
from blockwise.llm.textblocks import Block, blocks, mix64, shingle_sets

#: Similarity as a fraction of integers, so that nothing is rounded.
NUM, DEN = 80, 100
SKETCH_BITS, SKETCH_PARTS = 20, 64
PROFILE = 256
BLOOM_BITS = 24
_POSTING_BYTES = 28
_SALTED = np.uint32(1 << 31)  # flag in the positions of salted postings


@dataclass(frozen=True)
class Limits:
    """Sizes that change plans but no result: lists given as pairs, postings of an n-gram in a part, sides of a comparison in a task."""

    small: int = 24
    hot: int = 1 << 16
    side: int = 2048


def set_digest(s: np.ndarray) -> int:
    """Order-free 64-bit digest of a set of hashes."""
    total = mix64(s).sum(dtype=np.uint64) if len(s) else np.uint64(0)
    return int(mix64(np.array([total]) ^ mix64(np.array([len(s)], dtype=np.uint64)))[0].astype(np.int64))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def needed_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of linked sets of these sizes: DEN * o >= NUM * (a + b - o)."""
    return -(-NUM * (a.astype(np.int64) + b) // (NUM + DEN))


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _profiles(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Rows (id, n_shingles, set_id) of all documents, and each task's sketch in parts."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        known: set[int] = set()
        id_type = None
        for b in batches:
            id_type = b.schema.types[0]
            for block in blocks(b.column(1)):
                sets = shingle_sets(block, k)
                names = [set_digest(s) for s in sets]
                for s, name in zip(sets, names, strict=True):
                    if name not in known:
                        known.add(name)
                        sketch += np.bincount(_bucket(s), minlength=1 << SKETCH_BITS).astype(np.uint32) if len(s) > 1 << 16 else 0
                        if len(s) <= 1 << 16:
                            np.add.at(sketch, _bucket(s), 1)
                n = block.n_docs
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(block.first, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), *(pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary()))],
                    names=[id_col, "n_shingles", "set_id", "part", "task", "bits"],
                )
        if id_type is not None and sketch.any():
            m = SKETCH_PARTS
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(m, id_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(range(m), pa.int32()), pa.array([TaskContext.get().partitionId()] * m, pa.int32()),
                    pa.array([x.astype("<u4").tobytes() for x in np.split(sketch, m)]),
                ],
                names=[id_col, "n_shingles", "set_id", "part", "task", "bits"],
            )

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"`{id_col}` {kind}, n_shingles bigint, set_id bigint, part int, task int, bits binary")


def _plus(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of two unsigned counters, which stop at their largest value."""
    total = x + y
    total[total < x] = 0xFFFFFFFF
    return total


def _sum_sketches(rows: DataFrame) -> np.ndarray:
    """The sketch of the corpus: merged on executors as a tree, 2**20 counters in all on the driver."""
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    width = len(out) // SKETCH_PARTS
    for r in tree_merge(rows.where("part is not null").select("part", "task", "bits"), _plus, "<u4").collect():
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["bits"], "<u4")
    return out


def cut_points(sketch: np.ndarray, fragments: int) -> np.ndarray:
    """Keys (frequency, upper half of the hash) that split the order into parts of equal weight."""
    freq, n = np.unique(sketch[sketch > 0], return_counts=True)
    if not len(freq):
        return np.zeros(0, dtype=np.uint64)
    weight = np.cumsum(freq.astype(np.float64) * n)
    cuts = []
    for q in np.arange(1, fragments) / fragments * weight[-1]:
        i = int(np.searchsorted(weight, q))
        inside = (q - (weight[i - 1] if i else 0.0)) / (weight[i] - (weight[i - 1] if i else 0.0))
        cuts.append((int(freq[i]) << 32) | min(int(inside * 2**32), 2**32 - 1))
    return np.array(cuts, dtype=np.uint64)


def order_keys(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return (sketch[_bucket(s)].astype(np.uint64) << np.uint64(32)) | (s >> np.uint64(32))


def _postings(docs: DataFrame, sketch: Broadcast, parts: int, hot: int, text_col: str, k: int) -> DataFrame:
    """Prefix n-grams packed by target part: (part, n-grams, classes, sizes, positions, centralities); those of hot n-grams are salted by class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        known: set[int] = set()
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            t = np.concatenate([h[0] for h in held])
            m = [len(h[0]) for h in held]
            s = np.repeat(np.array([h[1] for h in held], dtype="<i8"), m)
            n = np.repeat(np.array([h[2] for h in held], dtype="<u4"), m)
            c = np.repeat(np.array([h[3] for h in held], dtype="<f4"), m)
            p = np.concatenate([np.arange(x, dtype="<u4") for x in m])
            salts = counts[_bucket(t)].astype(np.uint64) // np.uint64(hot)
            salt = mix64(s.astype(np.uint64)) % (salts + np.uint64(1))
            p |= np.where(salts > 0, _SALTED, np.uint32(0))
            to = ((t + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edge = np.searchsorted(to[order], np.arange(parts + 1))
            rows = [(i, b"".join(x[order[a:b]].tobytes() for x in (t, s, n, p, c))) for i, (a, b) in enumerate(zip(edge, edge[1:], strict=False)) if b > a]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "postings"])

        for b in batches:
            for block in blocks(b.column(0)):
                for s in shingle_sets(block, k):
                    n = len(s)
                    if n < 4:  # different sets of fewer cannot reach 4/5
                        continue
                    name = set_digest(s)
                    if name in known:
                        continue
                    known.add(name)
                    freq = counts[_bucket(s)]
                    first = np.argsort(freq, kind="stable")[: prefix_length(n)]  # sets are sorted by hash
                    held.append((s[first], name, n, float(freq.mean())))
                    size += len(first)
                if size > 1 << 19:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.select(text_col).mapInArrow(run, "part int, postings binary")


def _unpack(blobs: Iterable) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    for x in blobs:
        raw = x.as_buffer()
        m, at = raw.size // _POSTING_BYTES, 0
        for out, kind in zip(parts, ("<u8", "<i8", "<u4", "<u4", "<f4"), strict=True):
            out.append(np.frombuffer(raw, kind, m, at))
            at += m * np.dtype(kind).itemsize
    return [np.concatenate(p) for p in parts]


def _passes(na: np.ndarray, nb: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Length filter, and prefix filter of the pair: its first shared n-gram has room for the whole overlap behind it in both sets.

    The first one always passes, so it is enough that one shared n-gram does.
    """
    na, nb, pa_, pb = (x.astype(np.int64) for x in (na, nb, pa_, pb))
    fits = DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)
    return fits & (np.minimum(na - pa_, nb - pb) >= needed_overlap(na, nb))


_CANDIDATES = "token bigint, a bigint, b bigint, na bigint, nb bigint, centre float"


def candidates(g: pa.Table, small: int) -> pa.Table:
    """One part's posting lists -> pairs (a, b), members (token, a, null) of long lists, and centres (the same, with centrality) of salted ones."""
    t, s, n, p, c = _unpack(g.column("postings"))
    order = np.lexsort((s, t))
    t, s, n, p, c = t[order], s[order], n[order], p[order], c[order]
    keep = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])  # copies met in several tasks
    t, s, n, p, c = t[keep], s[keep], n[keep], p[keep], c[keep]
    salted, p = p >= _SALTED, p & ~_SALTED
    start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    size = np.diff(np.append(start, len(t)))
    long = (size > small) | salted[start]
    left, right, member, centres = [], [], [], []

    def add(x: np.ndarray, y: np.ndarray) -> None:
        ok = _passes(n[x], n[y], p[x], p[y])
        left.append(x[ok])
        right.append(y[ok])

    for m in range(2, small + 1):
        rows = start[size == m]
        i, j = np.triu_indices(m, 1)
        step = max((1 << 18) // len(i), 1)  # most pairs fall here, so they are filtered a few lists at a time
        for lo in range(0, len(rows), step):
            add((rows[lo : lo + step, None] + i).ravel(), (rows[lo : lo + step, None] + j).ravel())
    for a, m in zip(start[long].tolist(), size[long].tolist(), strict=True):
        at = np.arange(a, a + m)
        centre = at[np.lexsort((s[at], -c[at]))[0]]
        if salted[a]:
            centres.append(centre)
        if m > small:
            rest = at[at != centre]
            add(np.minimum(rest, centre), np.maximum(rest, centre))
        member.append(at)
    none = np.zeros(0, dtype=np.int64)
    left, right, member = (np.concatenate(x) if x else none for x in (left, right, member))
    order = np.lexsort((s[right], s[left]))  # s ascends within a list; a pair can share several lists
    left, right = left[order], right[order]
    new = np.ones(len(left), dtype=bool)
    new[1:] = (s[left[1:]] != s[left[:-1]]) | (s[right[1:]] != s[right[:-1]])
    left, right = left[new], right[new]
    both = (s[left], s[right], n[left].astype(np.int64), n[right].astype(np.int64))
    one = np.concatenate([member, np.array(centres, dtype=np.int64)])
    k, m = len(left), len(one)
    return pa.table({
        "token": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(t[one].astype(np.int64))]),
        "a": pa.array(np.concatenate([both[0], s[one]])),
        "b": pa.concat_arrays([pa.array(both[1]), pa.nulls(m, pa.int64())]),
        "na": pa.array(np.concatenate([both[2], n[one].astype(np.int64)])),
        "nb": pa.concat_arrays([pa.array(both[3]), pa.nulls(m, pa.int64())]),
        "centre": pa.concat_arrays([pa.nulls(k + len(member), pa.float32()), pa.array(c[centres].astype(np.float32), pa.float32())]),
    })


def _star_of_centres(found: DataFrame) -> DataFrame:
    """Pairs of the centres of a hot n-gram's salted parts with the most central one of them."""
    centres = found.where("centre is not null").select("token", "a", "na", "centre")
    best = centres.groupBy("token").agg(F.max(F.struct("centre", "a", "na")).alias("c")).select("token", F.col("c.a").alias("b"), F.col("c.na").alias("nb"))
    near = f"a <> b and {DEN} * least(na, nb) >= {NUM} * greatest(na, nb)"
    first = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y))
    return centres.join(best, "token").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), first("na", "nb").alias("na"), first("nb", "na").alias("nb"))


def _bloom_at(names: np.ndarray) -> list[np.ndarray]:
    return [(mix64(names.astype(np.uint64) + np.uint64(i)) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64) for i in range(3)]


def _bloom(names: DataFrame) -> np.ndarray:
    """2**24 bits of the class names in column ``name``; full bits only let more sets through."""
    parts = 16

    def some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BLOOM_BITS, dtype=bool)
        for b in batches:
            for at in _bloom_at(b.column(0).to_numpy()):
                bits[at] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(parts), pa.int32()), pa.array([TaskContext.get().partitionId()] * parts, pa.int32()), pa.array([np.packbits(x).tobytes() for x in np.split(bits, parts)])], names=["part", "task", "bits"]
            )

    out = np.zeros((1 << BLOOM_BITS) // 8, dtype=np.uint8)
    width = len(out) // parts
    for r in tree_merge(saved(names.mapInArrow(some, "part int, task int, bits binary"), "bloom"), np.bitwise_or, "u1").collect():
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(out).astype(bool)


def _segments(docs: DataFrame, sketch: Broadcast, cuts: np.ndarray, wanted: Broadcast, only: tuple[int, ...], text_col: str, k: int) -> DataFrame:
    """(set_id, fragment, grams, profile) of the wanted classes: one row for each of the fragments ``only``, empty ones too.

    Fragment -1 is the profile of bucket counts instead, fragment -2 the first fragment in 32-bit hashes. A class
    met in several tasks has equal rows from each.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bits = sketch.value, wanted.value
        known: set[int] = set()
        for b in batches:
            for block in blocks(b.column(0)):
                names, parts, grams, profiles = [], [], [], []
                for s in shingle_sets(block, k):
                    if len(s) < 4:
                        continue
                    name = set_digest(s)
                    if name in known or not all(bits[at[0]] for at in _bloom_at(np.array([name]))):
                        continue
                    known.add(name)
                    f = np.searchsorted(cuts, order_keys(s, counts), side="right")
                    for i in only:
                        names.append(name)
                        parts.append(i)
                        grams.append(s[f == i].astype(np.int64) if i >= 0 else np.unique(s[f == 0] >> np.uint64(32)).astype(np.int64) if i == -2 else np.zeros(0, np.int64))
                        profiles.append(np.bincount((s & np.uint64(PROFILE - 1)).astype(np.int64), minlength=PROFILE).astype("<u4").tobytes() if i == -1 else None)
                if names:
                    ends = np.cumsum([0, *map(len, grams)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.int64()), pa.array(parts, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams))), pa.array(profiles, pa.binary())],
                        names=["set_id", "fragment", "grams", "profile"],
                    )

    return docs.select(text_col).mapInArrow(run, "set_id bigint, fragment int, grams array<bigint>, profile binary")


class _Corpus:
    """The documents with the fixed-size tables that every pass over them needs."""

    def __init__(self, docs: DataFrame, sketch: Broadcast, fragments: int, text_col: str, k: int):
        self.docs, self.sketch, self.fragments, self.text_col, self.k = docs, sketch, fragments, text_col, k
        self.cuts = cut_points(sketch.value, fragments)

    def segments(self, names: DataFrame, only: tuple[int, ...]) -> DataFrame:
        """Rows of the classes in column ``name`` (and, by chance, of a few others)."""
        bits = self.docs.sparkSession.sparkContext.broadcast(_bloom(names))
        got = _segments(self.docs, self.sketch, self.cuts, bits, only, self.text_col, self.k)
        if only == (-2,):
            got = got.withColumn("grams", F.transform("grams", lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int")))
        return saved(got, "segments")


def _overlaps(pairs: DataFrame, segments: DataFrame, fragments: tuple[int, ...]) -> DataFrame:
    """(a, b, na, nb, fragment, o, sa, sb): the overlap of two segments and their sizes, per pair and fragment."""
    cut = segments.select("set_id", "fragment", "grams")
    wide = pairs.select("a", "b", "na", "nb", F.explode(F.array([F.lit(i) for i in fragments])).alias("fragment"))
    left = wide.join(cut.select(F.col("set_id").alias("a"), "fragment", F.col("grams").alias("ga")), ["a", "fragment"])
    both = left.join(cut.select(F.col("set_id").alias("b"), "fragment", F.col("grams").alias("gb")), ["b", "fragment"])
    o = F.size(F.array_intersect("ga", "gb")).cast("bigint")
    return both.select("a", "b", "na", "nb", "fragment", o.alias("o"), F.size("ga").alias("sa"), F.size("gb").alias("sb")).distinct()


def _names(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("name"))


def _verified(pairs: DataFrame, corpus: _Corpus) -> DataFrame:
    """Linked pairs (a, b): partial overlaps are counted fragment by fragment and summed per pair.

    The first fragment, of the rarest n-grams, goes ahead in 32-bit hashes, whose overlap is never less than the
    true one: a pair goes on only if that and all that is left in the other fragments could reach the threshold, so
    few sets travel whole.
    """
    need = F.expr(f"({NUM} * (na + nb) + {NUM + DEN - 1}) div {NUM + DEN}")
    ahead = _overlaps(pairs, corpus.segments(_names(pairs), (-2,)), (-2,))
    # Equal 32-bit hashes within a set count as left in other fragments, so this stays an upper bound.
    ahead = saved(ahead.where(F.col("o") + F.least(F.col("na") - F.col("sa"), F.col("nb") - F.col("sb")) >= need).select("a", "b", "na", "nb"), "ahead")
    if ahead.isEmpty():
        return ahead.select("a", "b")
    whole = tuple(range(corpus.fragments))
    part = _overlaps(ahead, corpus.segments(_names(ahead), whole), whole)
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("overlap"))
    return saved(total.where(F.col("overlap") * DEN >= (F.col("na") + F.col("nb") - F.col("overlap")) * NUM).select("a", "b"), "links")


def across(g: pa.Table) -> pa.Table:
    """One group of a long list: pairs of its two sides, in different components, whose bound reaches the threshold."""
    s, comp, n, side = (g.column(x).to_numpy() for x in ("set_id", "root", "n", "side"))
    prof = np.stack([np.frombuffer(x.as_buffer(), "<u4") for x in g.column("profile")]).astype(np.int32)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    right = right[np.argsort(n[right], kind="stable")]
    out = []
    for i in left.tolist():
        lo, hi = np.searchsorted(DEN * n[right], NUM * n[i], side="left"), np.searchsorted(NUM * n[right], DEN * n[i], side="right")
        j = right[lo:hi]
        j = j[comp[j] != comp[i]]
        if len(j):
            bound = np.minimum(prof[j], prof[i]).sum(1)
            j = j[bound >= needed_overlap(n[j], n[i])]
            out += [(int(s[i]), int(s[x]), int(n[i]), int(n[x])) if s[i] < s[x] else (int(s[x]), int(s[i]), int(n[x]), int(n[i])) for x in j.tolist()]
    return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(("a", "b", "na", "nb"))})


def comparisons(rows: DataFrame, side: int) -> DataFrame:
    """Members of long lists (token, set_id, root, n, profile) dealt into the groups in which ``across`` compares them.

    The left side of a group holds classes outside the list's largest component, the right side any. Classes are
    kept apart by size bands of the threshold's ratio (linked sizes lie in the same or in neighbouring bands), and bands
    are cut into blocks of about ``side``.
    """
    of_root = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("m"))
    main = of_root.groupBy("token").agg(F.max(F.struct("m", "root")).alias("most")).select("token", F.col("most.root").alias("main"))
    rows = rows.join(main, "token").withColumn("band", F.floor(F.log("n") / F.log(F.lit(DEN / NUM))).cast("int")).withColumn("minor", F.col("root") != F.col("main"))
    sizes = rows.groupBy("token", "band").agg(F.ceil(F.sum(F.col("minor").cast("int")) / side).alias("lefts"), F.ceil(F.count(F.lit(1)) / side).alias("rights"))
    near = lambda c, name: [F.col("token"), (F.col("band") + c).alias("band"), F.lit(-c).alias("off"), F.col(name)]
    to = lambda name: sizes.select(*near(-1, name)).unionByName(sizes.select(*near(0, name))).unionByName(sizes.select(*near(1, name)))
    base = ["token", "set_id", "root", "n", "profile"]
    blocks_of = lambda name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(name) - 1))
    left = (
        rows.where("minor").join(sizes.select("token", "band", "lefts"), ["token", "band"]).join(to("rights").where("rights > 0"), ["token", "band"])
        .withColumn("l", F.pmod(F.xxhash64("set_id"), "lefts")).withColumn("r", blocks_of("rights")).withColumn("rb", F.col("band") + F.col("off"))
        .select(*base, F.lit(0).alias("side"), F.col("band").alias("lb"), "l", "rb", "r")
    )
    right = (
        rows.join(sizes.select("token", "band", "rights"), ["token", "band"]).join(to("lefts").where("lefts > 0"), ["token", "band"])
        .withColumn("r", F.pmod(F.xxhash64("set_id"), "rights")).withColumn("l", blocks_of("lefts")).withColumn("lb", F.col("band") + F.col("off"))
        .select(*base, F.lit(1).alias("side"), "lb", "l", F.col("band").alias("rb"), "r")
    )
    return left.unionByName(right)


def _rest_of_long_lists(members: DataFrame, roots: DataFrame, corpus: _Corpus, side: int) -> DataFrame | None:
    """Candidate pairs between components inside long lists."""
    named = members.join(roots.select(F.col("vertex").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    mixed = named.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("token")
    rows = saved(named.join(mixed, "token"), "mixed")
    if rows.isEmpty():
        return None
    profiles = corpus.segments(rows.select(F.col("set_id").alias("name")), (-1,)).dropDuplicates(["set_id"]).select("set_id", "profile")
    dealt = comparisons(rows.select("token", "set_id", "root", "n").join(profiles, "set_id"), side)
    more = saved(dealt.groupBy("token", "lb", "l", "rb", "r").applyInArrow(across, "a bigint, b bigint, na bigint, nb bigint").distinct(), "rest")
    return None if more.isEmpty() else more


def similar_classes(docs: DataFrame, k: int = 5, fragments: int = 4, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(members, roots): id, n_shingles, set_id of every row; set_id -> root of every class with a link."""
    spark = docs.sparkSession
    profiles = saved(_profiles(docs, id_col, text_col, k), "profiles")
    members = profiles.where("part is null").select(id_col, "n_shingles", "set_id")
    corpus = _Corpus(docs, spark.sparkContext.broadcast(_sum_sketches(profiles)), fragments, text_col, k)
    total = members.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) * (DEN - NUM) // DEN * _POSTING_BYTES // (16 << 20)))
    small = limits.small
    found = saved(_postings(docs, corpus.sketch, parts, limits.hot, text_col, k).groupBy("part").applyInArrow(lambda g: candidates(g, small), _CANDIDATES), "candidates")
    pairs = found.where("b is not null").select("a", "b", "na", "nb").unionByName(_star_of_centres(found))
    links = _verified(pairs.distinct(), corpus)
    roots = saved(connected(links), "roots")
    # Salted parts of one n-gram may have met in one part, which repeats no member, or in several.
    long_lists = found.where("b is null and centre is null").select("token", F.col("a").alias("set_id"), F.col("na").alias("n"))
    more = None if long_lists.isEmpty() else _rest_of_long_lists(long_lists, roots, corpus, limits.side)
    if more is not None:
        extra = _verified(more, corpus)
        edges = roots.select(F.col("vertex").alias("a"), F.col("root").alias("b")).unionByName(extra)
        roots = saved(connected(edges), "roots")
    return members, roots


def _classes(members: DataFrame, roots: DataFrame) -> DataFrame:
    """set_id and root of every class of documents with words; a class without links is its own root."""
    some = members.where("n_shingles > 0").select("set_id").distinct()
    return some.join(roots.select(F.col("vertex").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))


def jaccard_components(docs: DataFrame, k: int = 5, fragments: int = 4, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the least id reachable by links).

    Null, empty and blank texts have no shingles and are their own component, as are repeated rows of them.
    Repeated ids share whatever their texts link to; a null id links like others but names no component (a component of
    null ids only has a null name); an empty table gives an empty result. Working tables are deleted, the result stays.
    """
    with scratch(docs.sparkSession) as made:
        members, roots = similar_classes(docs, k, fragments, id_col, text_col, limits)
        least_of = members.where("n_shingles > 0").groupBy("set_id").agg(F.min(id_col).alias("least"))
        classes = least_of.join(roots.select(F.col("vertex").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
        named = classes.join(least, "root").select("set_id", "component_id")
        out = members.join(named, "set_id", "left").select(
            id_col, "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", id_col)).otherwise(F.col(id_col)).alias("component_id")
        )
        out = saved(out, "components")
        made.pop()
    return out


def _with_set_id(docs: DataFrame, name: str, text_col: str, k: int) -> DataFrame:
    """``docs`` and the class of each row in column ``name`` (null without words)."""
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [set_digest(s) if len(s) else None for block in blocks(b.column(at)) for s in shingle_sets(block, k)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.int64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def one_per_group(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 32 << 20, limits: Limits = Limits()) -> DataFrame:
    """One row of ``docs`` for each component, with its columns: that of the least id (nulls last), then of the least class.

    Rows are told apart by id and class, so an id on two different texts counts as two rows; of rows equal in both
    one stays. Rows without words are their own components and all stay; an empty table gives an empty result.
    Texts are not shuffled but for the rows that stand for their component and are repeated. The table of rows to drop is
    measured: up to ``broadcast_bytes`` go to every task, more are joined by a shuffle.
    """
    spark = docs.sparkSession
    with scratch(spark) as made:
        members, roots = similar_classes(docs, k, id_col=id_col, text_col=text_col, limits=limits)
        rows = members.where("n_shingles > 0").groupBy(F.col(id_col).alias("_id"), "set_id").agg(F.count(F.lit(1)).alias("m")).join(_classes(members, roots), "set_id")
        first = rows.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "set_id")).alias("f")).select("root", F.col("f._id").alias("_first"), F.col("f.set_id").alias("_first_set"))
        stays = F.col("_id").eqNullSafe(F.col("_first")) & (F.col("set_id") == F.col("_first_set"))
        verdict = saved(rows.join(first, "root").select("_id", "set_id", stays.alias("_stays"), "m").where("not _stays or m > 1").drop("m"), "verdicts")
        made.pop()  # the result reads it
    n, size = verdict.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("_id").cast("string"))), F.lit(0))).first()
    if not n:
        return docs
    tag = fresh_name("_set", docs.columns)
    verdict = verdict.select(F.col("_id").alias("_verdict_id"), F.col("set_id").alias("_verdict_set"), "_stays")
    small = 48 * n + size <= broadcast_bytes
    tagged = _with_set_id(docs, tag, text_col, k).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(tag).alias("_set"))
    hit = tagged.join(F.broadcast(verdict) if small else verdict, F.col("_id").eqNullSafe(F.col("_verdict_id")) & (F.col("_set") == F.col("_verdict_set")), "left")
    alone = hit.where("_stays is null").select("_row.*")
    if verdict.where("_stays").isEmpty():
        return alone
    return alone.unionByName(hit.where("_stays").dropDuplicates(["_id", "_set"]).select("_row.*"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
