"""Near-duplicate documents: MinHash, banding, verification, connected components.

Plan
----
1. One pass over the texts writes, per document, a digest of its folded words, its
   shingle count and a signature of ``bands * rows`` universal hash minima.
2. Documents with equal words collapse to the one with the smallest id, by a plain
   aggregate, so copies are never compared.
3. Bands of the signatures are dealt to buckets; buckets with one member go, buckets
   with the same members are kept once.
4. Star round: each member is compared with its bucket's least member only, first by
   signature, then, if they agree enough, on the full shingle sets.  That is one pair per
   member, and texts are sent once for each pair that may be a link.
5. Components of those links.  Buckets whose other members are all connected are done.
6. Open buckets: members of different components meet.  The members outside a bucket's
   largest component are dealt to blocks, and so are those inside; only pairs of blocks
   that hold different components become groups.  A group's signatures are compared first;
   only the texts of members that may have a link follow, and their full sets decide.
   Blocks are bounded in members and in shingles, so a task's memory is.
7. Large-star / small-star over all links.

So a bucket of n members of which m are not connected to its largest component by the star
round sends n * m / ``block`` signatures, not n * n texts.  At a threshold of 0.85 this makes 25 bands of 5 rows: a pair at 0.85 misses every band with
probability 4.3e-7, and one at 0.9 with 2e-10.  A pair at 0.85 that a band finds is dropped
before its sets are compared with probability 5.9e-8: 4.9e-7 in all.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_with_ids, settle, tidy
from .components import components
from .words import Words, batches, mix, odd_weights, windows, words_of


@dataclass(frozen=True)
class MinHashParams:
    """percent: the least similarity, in hundredths; shingle: words in a shingle; miss: how likely
    a pair at the threshold may miss every band (the number of bands follows from it); block,
    most_shingles: members and shingles of a block; chunk: members that meet a bucket's least
    member in one task.  The last three bound tasks and drop nothing."""

    shingle: int = 5
    percent: int = 80
    rows: int = 5
    miss: float = 5e-7
    block: int = 2048
    most_shingles: int = 1 << 21
    chunk: int = 4096
    seed: int = 6

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log1p(-((self.percent / 100) ** self.rows)))

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_agreement(self) -> float:
        """Signatures of a pair at the threshold agree less often with probability 5.9e-8 (0.85) or 1.7e-8 (0.8)."""
        p = self.percent / 100
        return p - 6 * (p * (1 - p) / self.hashes) ** 0.5


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Per text its sorted distinct shingles; fewer words than ``size`` give one, none give none."""
    every = windows(words.hash, size)
    sets = []
    for d, n in enumerate(words.counts):
        at = words.first[d]
        if n >= size:
            sets.append(np.unique(every[at : at + n - size + 1]))
        elif n:
            sets.append(np.array([xxhash.xxh3_64_intdigest(words.hash[at : at + n].tobytes(), seed=int(n))], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray], params: MinHashParams) -> np.ndarray:
    """Minima of ``a * x + b`` (upper 32 bits) over each set; zeros for an empty set."""
    a, b = odd_weights(params.hashes, params.seed), odd_weights(params.hashes, params.seed + 1)
    out = np.zeros((len(sets), params.hashes), np.uint32)
    some = [d for d, s in enumerate(sets) if len(s)]
    at = 0
    with np.errstate(over="ignore"):
        while at < len(some):
            to, size = at, 0
            while to < len(some) and (to == at or size + len(sets[some[to]]) <= 1 << 15):
                size += len(sets[some[to]])
                to += 1
            x = np.concatenate([sets[d] for d in some[at:to]])
            starts = np.cumsum([0, *(len(sets[d]) for d in some[at : to - 1])])
            y = np.empty_like(x)
            for k in range(params.hashes):
                np.multiply(x, a[k], out=y)
                y += b[k]
                out[some[at:to], k] = np.minimum.reduceat(y, starts) >> np.uint64(32)
            at = to
    return out


def _sign(params: MinHashParams):
    def run(it):
        for batch in batches(it):
            words = words_of(batch.column("text"), fold=True)
            sets = shingle_sets(words, params.shingle)
            digests = [
                xxhash.xxh3_128_digest(words.hash[words.first[d] : words.first[d + 1]].tobytes()) if n else None
                for d, n in enumerate(words.counts)
            ]
            yield pa.record_batch(
                [
                    batch.column("id"),
                    pa.array(digests, pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([row.tobytes() for row in signatures(sets, params)], pa.binary()),
                    *batch.columns[2:],
                ],
                ["id", "digest", "n_shingles", "signature", *batch.schema.names[2:]],
            )

    return run


def _band(params: MinHashParams):
    @F.pandas_udf("array<long>")
    def keys(signature: pd.Series) -> pd.Series:
        if not len(signature):
            return pd.Series([], dtype=object)
        rows = np.frombuffer(b"".join(signature), np.uint32).reshape(len(signature), params.bands, params.rows)
        key = np.broadcast_to(np.arange(params.bands, dtype=np.uint64), rows.shape[:2])
        with np.errstate(over="ignore"):
            for k in range(params.rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
        return pd.Series(list(key.view(np.int64)))

    return keys


def _matrix(column, params: MinHashParams) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), params.hashes)


def near_sizes(a: np.ndarray, b, params: MinHashParams) -> np.ndarray:
    """Whether sets of these sizes can be similar enough at all."""
    return 100 * np.minimum(a, b) >= params.percent * np.maximum(a, b)


def linked(a: np.ndarray, b: np.ndarray, params: MinHashParams) -> bool:
    """The contract's test on two full sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= params.percent * (len(a) + len(b) - both)


def candidates_in(signs: np.ndarray, sizes: np.ndarray, groups: np.ndarray, params: MinHashParams):
    """Pairs (i, later ones) of different groups whose sizes and signatures allow a link."""
    for i in range(len(sizes) - 1):
        rest = np.flatnonzero(groups[i + 1 :] != groups[i]) + i + 1
        rest = rest[near_sizes(sizes[rest], sizes[i], params)]
        if len(rest):
            rest = rest[(signs[rest] == signs[i]).mean(1) >= params.least_agreement]
            if len(rest):
                yield i, rest


def links_in(ids: np.ndarray, signs: np.ndarray, sets: list[np.ndarray], params: MinHashParams, groups: np.ndarray | None = None):
    """Links that connect what the true links of one group connect; ``groups`` are connected already."""
    groups = np.arange(len(ids)) if groups is None else np.unique(groups, return_inverse=True)[1]
    sizes, held = np.array([len(s) for s in sets]), None
    for i, rest in candidates_in(signs, sizes, groups, params):
        if len(rest) >= _MANY and held is None:
            held = Holders(sets)
        if len(rest) < _MANY or held.cost(i) > _PAIR * len(rest) * len(sets[i]):
            rest = (j for j in rest if groups[j] != groups[i] and linked(sets[i], sets[j], params))
        else:
            both = held.shared(i)[rest]
            rest = rest[(both > 0) & (100 * both >= params.percent * (sizes[i] + sizes[rest] - both))]
        for j in rest:  # groups grow while this runs, and stay flat
            if groups[j] != groups[i]:
                yield min(ids[i], ids[j]), max(ids[i], ids[j])
                groups[groups == groups[j]] = groups[i]


#: From so many candidates on one count over a set's holders is weighed against merging pair by pair,
#: which costs about so many steps for each of the set's shingles.  Both give the same links.
_MANY, _PAIR = 16, 4


class Holders:
    """The sets that hold each shingle of a group, to count what one set shares with all others at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.ends = np.cumsum([0, *(len(s) for s in sets)])
        self.codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.owners = np.repeat(np.arange(len(sets)), np.diff(self.ends))[np.argsort(self.codes, kind="stable")]
        self.first = np.cumsum([0, *np.bincount(self.codes)])

    def _codes(self, i: int) -> np.ndarray:
        return self.codes[self.ends[i] : self.ends[i + 1]]

    def cost(self, i: int) -> int:
        """Holders of the shingles of set ``i``, counted with repeats."""
        own = self._codes(i)
        return int((self.first[own + 1] - self.first[own]).sum())

    def shared(self, i: int) -> np.ndarray:
        """How many shingles each set has in common with set ``i``."""
        own = self._codes(i)
        many = self.first[own + 1] - self.first[own]
        shift = self.first[own] - np.cumsum([0, *many[:-1]])
        return np.bincount(self.owners[np.repeat(shift, many) + np.arange(many.sum())], minlength=len(self.ends) - 1)


def _agree(params: MinHashParams):
    @F.arrow_udf("boolean")
    def agree(a: pa.Array, b: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.bool_())
        return pa.array((_matrix(a, params) == _matrix(b, params)).mean(1) >= params.least_agreement)

    return agree


def _pairs(found: list[tuple[int, int]], names=("u", "v")) -> pa.RecordBatch:
    return pa.record_batch([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], list(names))


def _star(params: MinHashParams):
    """Rows in runs of (u, chunk), the texts of u ahead of its members': each member meets u."""

    def run(it):
        last, centre = None, []
        for whole in it:
            for batch in batches([whole]):
                sets = shingle_sets(words_of(batch.column("text"), fold=True), params.shingle)
                found = []
                for own, u, v, chunk in zip(sets, *(batch.column(c).to_pylist() for c in ("u", "v", "chunk"))):
                    if (u, chunk) != last:
                        last, centre = (u, chunk), []
                    if v == u:
                        centre.append(own)
                    elif any(linked(c, own, params) for c in centre):
                        found.append((u, v))
                yield _pairs(found)

    return run


def _runs(it, of: str):
    """Tables of equal ``of`` from batches sorted by it, one at a time."""
    held, last = [], None
    for batch in it:
        groups = batch.column(of).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1), len(groups)] if len(groups) else []
        for at, to in zip(cuts, cuts[1:]):
            if held and groups[at] != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(at, to - at))
            last = groups[at]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sift(params: MinHashParams):
    """Of each group the members that may have a link into another component."""

    def run(it):
        for group in _runs(it, "grp"):
            signs, sizes = _matrix(group["signature"], params), group["n"].to_numpy()
            wanted = np.zeros(len(sizes), bool)
            for i, rest in candidates_in(signs, sizes, group["label"].to_numpy(), params):
                wanted[i] = wanted[rest] = True
            if wanted.any():
                yield from group.filter(pa.array(wanted)).to_batches()

    return run


def _meet(params: MinHashParams):
    """Groups arrive as runs of equal ``grp``; one of them is held at a time."""

    def run(it):
        for group in _runs(it, "grp"):
            ids = group["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            group = group.take(pa.array(order))
            sets = shingle_sets(words_of(group["text"].combine_chunks(), fold=True), params.shingle)
            yield _pairs(list(links_in(ids[order], _matrix(group["signature"], params), sets, params, group["label"].to_numpy())))

    return run


def banded(signed: DataFrame, params: MinHashParams) -> DataFrame:
    """``key, id, n, first, members``: each representative in each bucket of two or more; buckets of the same members once."""
    reps = signed.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("id", "n_shingles", "signature")).alias("r"))
    dealt = settle(reps.select(F.col("r.id").alias("id"), F.col("r.n_shingles").alias("n"), F.explode(_band(params)("r.signature")).alias("key")), "bands")
    buckets = (
        dealt.groupBy("key")
        .agg(F.count("*").alias("members"), F.min("id").alias("first"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"))
        .filter("members > 1")
        .groupBy("members", "first", "who")
        .agg(F.min("key").alias("key"))
    )
    return settle(dealt.join(buckets.select("key", "first", "members"), "key"), "buckets")


def star_links(docs: DataFrame, signed: DataFrame, held: DataFrame, params: MinHashParams) -> DataFrame:
    """Links ``(u, v)`` of members with their bucket's least member."""
    pairs = settle(held.filter("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v")).distinct(), "pairs")
    ends = settle(pairs.select("u").union(pairs.select("v")).distinct().toDF("id"), "ends")
    signs = rows_with_ids(signed.select("id", "n_shingles", "signature"), ends, "id")
    side = lambda c: signs.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
    met = pairs.join(side("u"), "u").join(side("v"), "v")
    met = met.filter(100 * F.least("n_u", "n_v") >= params.percent * F.greatest("n_u", "n_v"))
    close = settle(met.filter(_agree(params)("s_u", "s_v")).select("u", "v").distinct(), "close")
    # A least member's texts go to each chunk of its partners; a chunk is read as a stream.
    chunks = close.groupBy("u").agg(F.ceil(F.count("*") / params.chunk).cast("int").alias("chunks"))
    members = close.join(chunks, "u").select("u", "v", F.pmod(F.xxhash64("v", F.lit(params.seed)), F.col("chunks")).cast("int").alias("chunk"))
    members = settle(members, "star")
    centres = members.select("u", F.col("u").alias("v"), "chunk").distinct()
    wanted = members.union(centres).groupBy("v").agg(F.collect_list(F.struct("u", "chunk")).alias("at")).withColumnRenamed("v", "id")
    wanted = settle(wanted, "star-ids")
    texts = rows_with_ids(docs.select("id", "text"), wanted.select("id"), "id")
    sent = texts.join(wanted, "id").select("id", "text", F.explode("at").alias("a")).select("a.u", "a.chunk", F.col("id").alias("v"), "text")
    sent = sent.repartition("u", "chunk").sortWithinPartitions("u", "chunk", F.col("v") != F.col("u"))
    return sent.mapInArrow(tidy(_star(params)), "u long, v long").distinct()


def open_links(docs: DataFrame, signed: DataFrame, held: DataFrame, found: DataFrame, params: MinHashParams) -> DataFrame | None:
    """Links between components inside buckets; None if every bucket's members are connected."""
    known = held.filter("id <> first and members > 2").join(found, F.col("id") == F.col("node"), "left")
    known = known.select("key", "id", "n", F.coalesce("component", "id").alias("label"))
    parts = settle(known.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s")), "parts")
    blocks = lambda c, s: F.greatest(F.ceil(c / params.block), F.ceil(s / params.most_shingles)).cast("int")
    most = F.max(F.struct("c", "s", "label"))
    open_ = parts.groupBy("key").agg(F.count("*").alias("labels"), F.sum("c").alias("c"), F.sum("s").alias("s"), most.alias("m")).filter("labels > 1")
    open_ = open_.select(
        "key",
        F.col("m.label").alias("major"),
        blocks(F.col("m.c"), F.col("m.s")).alias("large"),
        blocks(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s")).alias("small"),
    )
    open_ = settle(open_, "open")
    if open_.isEmpty():
        return None
    own = lambda of: F.pmod(F.xxhash64("id", F.lit(params.seed)), F.col(of))
    of_major = F.transform(F.sequence(F.lit(0), F.col("small") - 1), lambda o: F.xxhash64("key", F.lit(1), o, F.col("own")))
    with_major = F.transform(F.sequence(F.lit(0), F.col("large") - 1), lambda o: F.xxhash64("key", F.lit(1), F.col("own"), o))
    others = F.filter(F.sequence(F.lit(0), F.col("small") - 1), lambda o: o != F.col("own"))
    with_minor = F.transform(others, lambda o: F.xxhash64("key", F.lit(0), F.least(o, F.col("own")), F.greatest(o, F.col("own"))))
    is_major = F.col("label") == F.col("major")
    members = (
        known.join(open_, "key")
        .withColumn("own", F.when(is_major, own("large")).otherwise(own("small")).cast("int"))
        .select("id", "label", F.explode(F.when(is_major, of_major).otherwise(F.concat(with_major, with_minor))).alias("grp"))
    )
    members = settle(members, "members")
    ends = settle(members.select("id").distinct(), "ends")
    signs = rows_with_ids(signed.select("id", F.col("n_shingles").alias("n"), "signature"), ends, "id").distinct()
    sifted = members.join(signs, "id").select("grp", "id", "label", "n", "signature").repartition("grp").sortWithinPartitions("grp")
    sifted = settle(sifted.mapInArrow(tidy(_sift(params)), "grp long, id long, label long, n long, signature binary").drop("n"), "sifted")
    ends = settle(sifted.select("id").distinct(), "ends")
    texts = rows_with_ids(docs.select("id", "text"), ends, "id")
    met = texts.join(sifted, "id").select("grp", "id", "label", "signature", "text").repartition("grp").sortWithinPartitions("grp")
    return met.mapInArrow(tidy(_meet(params)), "u long, v long")


def near_duplicates(
    docs: DataFrame, params: MinHashParams = MinHashParams(), id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``, and the columns of ``carry`` as
    ``carry_0, carry_1, ...``.

    docs: a DataFrame that can be read again, with a long id and a text; other columns
    are ignored.  Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; a set
    holds the distinct shingles of ``params.shingle`` words, or the whole sequence as one
    if there are fewer.  Two documents are linked if ``100 * intersection >= percent *
    union``.  component_id is the smallest id reachable.  Null and empty texts have empty
    sets and are linked with nothing.  Repeated rows give one row each; rows that share an id
    but not the text are one node with several texts.  Rows with a null id are returned with a
    null component and kept, and link with nothing.
    """
    kept = [F.col(f"`{c}`").alias(f"carry_{k}") for k, c in enumerate(carry)]
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *kept)
    schema = T.StructType.fromDDL("id long, digest binary, n_shingles long, signature binary")
    signed = settle(docs.mapInArrow(tidy(_sign(params)), T.StructType(schema.fields + docs.schema.fields[2:])), "signed")
    docs, known = docs.filter("id is not null"), signed.filter("id is not null")
    held = banded(known, params)
    links = settle(star_links(docs, known, held, params), "links")
    found = settle(components(links), "stars")
    more = open_links(docs, known, held, found, params)
    if more is not None:
        more = settle(more, "links")
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    reps = known.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    classes = settle(
        reps.join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component")),
        "classes",
    )
    own = signed.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"), "n_shingles", *docs.columns[2:])
    return own.join(classes, "digest", "left").select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
        *docs.columns[2:],
    )
