"""Removal of long repeated word passages by a compacted de Bruijn graph of anchors.

Every window of ``window`` words has one anchor: its least-hashed run of ``k`` words
(leftmost on ties).  The anchor is a matter of the window's words alone, so a repeated
window repeats its anchor.  Anchors are the nodes.  Consecutive anchors of a document are joined
by an edge, the k-mer of all words between them, document ends included; an anchor's context is
its pair of edges.  Over the corpus an anchor is

* unique: it occurs once, so no window whose anchor it is repeats;
* through: it occurs again and always in the same context, a nonbranching node;
* branching: it occurs again in different contexts.

Compaction: the nodes' kinds are joined back to their places, and a run of through anchors becomes
one path.  A through anchor has equal neighbours at all its places, so every place of any of its
nodes is a place of the whole path; one join compacts it, however long it is.  Windows all of
whose anchors are through lie on such a path; the others whose anchor is branching are doubtful
and told by their own hashes.

Verification: each path, and each run of neighbouring doubtful windows whose hashes also stand as
neighbours in another text, is a span with source coordinates (document, position) and those of
its first place.  Both places' words are read from the texts and compared; no span is removed on a
hash.  Spans whose words differ (a collision) are taken apart, and their windows grouped by
their words.

So the corpus-wide tables hold one row per anchor (about 1 in 14 words) and per doubtful
window, never one per word, and copies of any number cost their anchors only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_with_ids, settle, tidy
from .words import Words, _power_tables, batches, mix, windows, words_of

_NULL_ID = -(1 << 63)

PLACE = ("id", "h", "at", "n")
REF = ("r_id", "r_h", "r_at")


@dataclass(frozen=True)
class SubstringParams:
    """bits: of the hashes of doubtful windows; fewer make more collisions, not other results."""

    window: int = 50
    k: int = 8
    bits: int = 64


@dataclass
class Anchored:
    """For a column of texts: which windows exist, their anchors, and the anchors' graph."""

    words: Words
    valid: np.ndarray  # start positions of windows
    own: np.ndarray  # the anchor of each, as an index into ``at``
    at: np.ndarray  # positions of anchors
    node: np.ndarray
    context: np.ndarray
    inside: tuple[np.ndarray, np.ndarray]  # anchors first..last (exclusive) that lie in each window


def anchors_of(words: Words, params: SubstringParams) -> Anchored:
    none = np.empty(0, np.int64)
    n, size, k = len(words.hash), params.window, params.k
    room = words.room()
    valid = np.flatnonzero(room >= size)
    if not len(valid):
        return Anchored(words, none, none, none, none.astype(np.uint64), none.astype(np.uint64), (none, none))
    grams = windows(words.hash, k, seed=23)
    # 36 bits of hash and 28 of position: the least is the least-hashed, then the leftmost.
    packed = (grams >> np.uint64(28) << np.uint64(28)) | np.arange(len(grams), dtype=np.uint64)
    span, width, least = size - k + 1, 1, packed
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    low = np.minimum(least[valid], least[valid + span - width])
    anchor = (low & np.uint64((1 << 28) - 1)).astype(np.int64)
    at, own = np.unique(anchor, return_inverse=True)
    node = grams[at]
    # Edges as hashes of all words from one anchor's start to the next one's end.
    with np.errstate(over="ignore"):
        up, down = _power_tables(n + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * up[:n])])
        text = np.searchsorted(words.first, at, side="right") - 1
        begin, end = words.first[text], words.first[text + 1]
        before = np.concatenate([[-1], at[:-1]])
        after = np.concatenate([at[1:], [n]])
        first, last = before < begin, after >= end
        a, b = np.where(first, begin, before), np.where(last, end, np.minimum(after + k, n))
        hash_of = lambda s, e: mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        left, right = hash_of(a, at + k), hash_of(at, b)
        context = mix(left * np.uint64(3) + first.astype(np.uint64)) + mix(right * np.uint64(5) + last.astype(np.uint64))
    inside = np.searchsorted(at, valid), np.searchsorted(at, valid + size - k, side="right")
    return Anchored(words, valid, own, at, node, context, inside)


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _joined_sha(text: str | None) -> str:
    return hashlib.sha256(b" ".join((text or "").encode("utf-8", "surrogatepass").split())).hexdigest()


def _scan(params: SubstringParams):
    def run(it):
        for batch in batches(it):
            words = words_of(batch.column("text"))
            found = anchors_of(words, params)
            cuts = np.searchsorted(found.at, words.first)
            text = np.searchsorted(words.first, found.at, side="right") - 1
            yield pa.record_batch(
                [
                    batch.column("id"),
                    batch.column("h"),
                    pa.array(words.counts, pa.int64()),
                    pa.array([_joined_sha(t) for t in batch.column("text").to_pylist()]),
                    _lists(found.node.view(np.int64), cuts, pa.int64()),
                    _lists(found.context.view(np.int64), cuts, pa.int64()),
                    _lists((found.at - words.first[text]).astype(np.int32), cuts, pa.int32()),
                ],
                ["id", "h", "n_words", "kept_sha256", "node", "context", "at"],
            )

    return run


def _flat_marks(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of an int-list column and the row of each."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def _runs_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of each run of consecutive numbers."""
    cuts = np.flatnonzero(np.concatenate([[True], starts[1:] != starts[:-1] + 1])) if len(starts) else np.empty(0, np.int64)
    return starts[cuts], np.diff(np.append(cuts, len(starts)))


def _judge(params: SubstringParams):
    """From the marked anchors of each text: places of compacted paths, and doubtful windows."""

    def run(it):
        for batch in batches(it):
            words = words_of(batch.column("text"))
            found = anchors_of(words, params)
            again, through = np.zeros(len(found.at), bool), np.zeros(len(found.at), bool)
            marks, row = _flat_marks(batch.column("marks"))  # 2 * position + (1 if through)
            k = np.searchsorted(found.at, words.first[row] + (marks >> 1))
            again[k], through[k] = True, (marks & 1).astype(bool)
            open_ = np.concatenate([[0], np.cumsum(~through)])
            sure = open_[found.inside[0]] == open_[found.inside[1]]
            doubt = ~sure & again[found.own]
            # A run of windows with through anchors only is a place of one nonbranching path.
            at, many = _runs_of(found.valid[sure])
            first = np.searchsorted(found.at, at)
            last = np.searchsorted(found.at, at + many - 1 + params.window - params.k, side="right")
            keys = [xxhash.xxh3_64_intdigest(found.node[a:b].tobytes()) for a, b in zip(first.tolist(), last.tolist())]
            text = np.searchsorted(words.first, at, side="right") - 1
            cuts = np.searchsorted(at, words.first)
            starts = found.valid[doubt]
            owner = np.searchsorted(words.first, starts, side="right") - 1
            doubts = np.searchsorted(starts, words.first)
            hashes = windows(words.hash, params.window, seed=35) if len(starts) else np.empty(0, np.uint64)
            hashes = hashes[starts] >> np.uint64(64 - params.bits) if len(starts) else hashes
            yield pa.record_batch(
                [
                    batch.column("id"),
                    batch.column("h"),
                    _lists((at - words.first[text]).astype(np.int32), cuts, pa.int32()),
                    _lists(many.astype(np.int32), cuts, pa.int32()),
                    _lists(np.array(keys, np.uint64).view(np.int64), cuts, pa.int64()),
                    _lists((starts - words.first[owner]).astype(np.int32), doubts, pa.int32()),
                    _lists(hashes.view(np.int64), doubts, pa.int64()),
                ],
                ["id", "h", "path_at", "path_n", "path", "doubt", "doubt_hash"],
            )

    return run


def _cut(params: SubstringParams, contents: bool):
    """What is left of each text without the windows of ``hits`` (first, number), and the words of its ``spans``."""

    def run(it):
        for batch in batches(it):
            words = words_of(batch.column("text"))
            cover = np.zeros(len(words.hash) + 1, np.int64)
            for d, hits in enumerate(batch.column("hits").to_pylist()):
                for hit in hits or ():
                    cover[words.first[d] + hit["at"]] += 1
                    cover[words.first[d] + hit["at"] + hit["n"] - 1 + params.window] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            removed, shas, kept, spans = [], [], [], []
            for d, (text, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())):
                own = gone[words.first[d] : words.first[d + 1]]
                parts = (text or "").encode("utf-8", "surrogatepass").split()
                left = b" ".join([w for w, g in zip(parts, own.tolist()) if not g])
                removed.append(int(own.sum()))
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "replace") if contents else None)
                spans.append([s | {"words": b" ".join(parts[s["at"] : s["at"] + s["n"] - 1 + params.window])} for s in wanted or ()])
            span = pa.struct([(c, pa.int64()) for c in REF] + [("at", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])
            yield pa.record_batch(
                [batch.column("id"), batch.column("h"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(span))],
                ["id", "h", "n_removed", "kept_sha256", "kept_text", "spans"],
            )

    return run


_CUT = (
    "id long, h long, n_removed long, kept_sha256 string, kept_text string,"
    " spans array<struct<r_id: long, r_h: long, r_at: long, at: int, n: int, words: binary>>"
)


def repeated_places(judged: DataFrame) -> DataFrame:
    """``id, h, at, n, r_id, r_h, r_at``: runs of ``n`` windows that seem to stand at the first place r too.

    A path's places all run to its first.  A doubtful window runs to the first place of its
    hash; neighbours that run to neighbours are one run.
    """
    first = F.min(F.struct("id", "h", F.col("at").cast("long").alias("at"))).alias("r")
    ref = [F.col(f"r.{c}").alias(f"r_{c}") for c in ("id", "h", "at")]
    paths = judged.select("id", "h", F.explode(F.arrays_zip("path_at", "path_n", "path")).alias("p"))
    paths = paths.select("id", "h", F.col("p.path_at").alias("at"), F.col("p.path_n").alias("n"), F.col("p.path").alias("path"))
    known = paths.groupBy("path", "n").agg(F.count("*").alias("places"), first).filter("places > 1").select("path", "n", *ref)
    sure = paths.join(known, ["path", "n"]).select(*PLACE, *REF)
    windows_ = judged.select("id", "h", F.explode(F.arrays_zip("doubt", "doubt_hash")).alias("w"))
    windows_ = windows_.select("id", "h", F.col("w.doubt").alias("at"), F.col("w.doubt_hash").alias("hash"))
    known = windows_.groupBy("hash").agg(F.count("*").alias("places"), first).filter("places > 1").select("hash", *ref)
    moved = windows_.join(settle(known, "again"), "hash").withColumn("shift", F.col("r_at") - F.col("at")).distinct()
    along = Window.partitionBy("id", "h", "r_id", "r_h", "shift").orderBy("at")
    island = moved.withColumn("island", F.col("at") - F.row_number().over(along))
    doubtful = island.groupBy("id", "h", "r_id", "r_h", "shift", "island").agg(F.min("at").alias("at"), F.count("*").cast("int").alias("n"))
    return sure.unionByName(doubtful.withColumn("r_at", F.col("at") + F.col("shift")).select(*PLACE, *REF))


def cut_texts(docs: DataFrame, hits: DataFrame, spans: DataFrame, params: SubstringParams, contents: bool) -> DataFrame:
    """The rows of ``docs`` that ``hits`` or ``spans`` name, cut, with the words of their spans; written."""
    own = hits.groupBy("id", "h").agg(F.collect_list(F.struct("at", "n")).alias("hits"))
    asked = spans.groupBy("id", "h").agg(F.collect_list(F.struct(*REF, "at", "n")).alias("spans"))
    wanted = settle(own.join(asked, ["id", "h"], "full"), "wanted")
    rows = rows_with_ids(docs, wanted.select("id").distinct(), "id").join(wanted, ["id", "h"])
    return settle(rows.mapInArrow(tidy(_cut(params, contents)), _CUT), "cut")


def unequal(cut: DataFrame) -> DataFrame:
    """Runs whose words are not those of the place they run to, told by ``r_id, r_h, r_at, n``."""
    each = cut.select(F.explode("spans").alias("s")).select("s.*")
    ends = each.groupBy(*REF, "n").agg(F.min("words").alias("least"), F.max("words").alias("most"))
    return settle(ends.filter("least <> most").select(*REF, "n"), "unequal")


def by_words(docs: DataFrame, runs: DataFrame, bad: DataFrame, params: SubstringParams) -> DataFrame:
    """``runs`` with all windows that share a place with a bad run grouped by their words instead."""
    one = lambda df: df.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    place = ["r_id", "r_h", (F.col("r_at") + F.col("k")).alias("r_at")]
    doubted = settle(one(bad).select(*place).distinct(), "doubted")
    each = one(runs).select("id", "h", (F.col("at") + F.col("k")).cast("int").alias("at"), F.lit(1).alias("n"), *place)
    asked = settle(each.join(doubted, list(REF), "left_semi"), "asked")
    rest = each.join(doubted, list(REF), "left_anti")
    shown = cut_texts(docs, asked.limit(0).select(*PLACE), asked.select(*PLACE, *REF).distinct(), params, False)
    shown = shown.select("id", "h", F.explode("spans").alias("s")).select("id", "h", "s.at", "s.n", "s.words")
    twice = shown.groupBy("words").agg(F.count("*").alias("places")).filter("places > 1").select("words")
    return rest.select(*PLACE).unionByName(shown.join(twice, "words", "left_semi").select(*PLACE)).distinct()


def remove_repeats(
    docs: DataFrame, params: SubstringParams = SubstringParams(), id_col: str = "doc_id", text_col: str = "text", contents: bool = False
) -> DataFrame:
    """Per row ``doc_id, n_words, n_removed, kept_sha256``; with ``contents`` also ``kept_text``
    (null where nothing was removed: the text stands).

    A word goes if it lies in a window of ``params.window`` consecutive words of its text
    whose words also start anywhere else, in the same or another row; all windows are judged
    on the input.  Words are runs outside ``[\\x20\\x09-\\x0D]``, unchanged; kept ones are joined
    by one space.  Null and empty texts have no words.  Repeated rows are places of their own,
    so they remove each other's passages.  Null ids are allowed; other columns are ignored.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    key = ["id", "h"]
    seen = settle(
        docs.mapInArrow(
            tidy(_scan(params)),
            "id long, h long, n_words long, kept_sha256 string, node array<long>, context array<long>, at array<int>",
        ),
        "anchors",
    )
    each = seen.select("id", "h", F.explode(F.arrays_zip("node", "context", "at")).alias("a")).select("id", "h", "a.*")
    nodes = settle(
        each.groupBy("node")
        .agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
        .filter("n > 1")
        .select("node", (F.col("low") == F.col("high")).cast("int").alias("through")),
        "nodes",
    )
    marks = settle(
        each.select("id", "h", "node", "at")
        .join(nodes, "node")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_set(2 * F.col("at") + F.col("through"))).alias("marks")),
        "marks",
    )
    judged = settle(
        rows_with_ids(docs, marks.select("id").distinct(), "id")
        .join(marks, key)
        .mapInArrow(
            tidy(_judge(params)),
            "id long, h long, path_at array<int>, path_n array<int>, path array<long>, doubt array<int>, doubt_hash array<long>",
        ),
        "judged",
    )
    runs = settle(repeated_places(judged), "runs")
    elsewhere = runs.filter((F.col("id") != F.col("r_id")) | (F.col("h") != F.col("r_h")) | (F.col("at") != F.col("r_at")))
    there = elsewhere.select(F.col("r_id").alias("id"), F.col("r_h").alias("h"), F.col("r_at").cast("int").alias("at"), "n", *REF)
    spans = elsewhere.select(*PLACE, *REF).unionByName(there).distinct()
    cut = cut_texts(docs, runs.select(*PLACE).distinct(), spans, params, contents)
    bad = unequal(cut)
    if not bad.isEmpty():
        cut = cut_texts(docs, settle(by_words(docs, runs, bad, params), "runs"), spans.limit(0), params, contents)
    cut = cut.drop("spans").dropDuplicates(key).withColumnRenamed("kept_sha256", "sha")
    out = seen.select("id", "h", "n_words", "kept_sha256").join(cut, key, "left")
    return out.select(
        F.nullif("id", F.lit(_NULL_ID)).alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("sha", "kept_sha256").alias("kept_sha256"),
        *(["kept_text"] if contents else []),
    )
