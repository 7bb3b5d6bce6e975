"""Byte-pair merging of a SentencePiece BPE model over ragged numpy arrays.

A text gets a leading space and is cut into chunks: a run of spaces with the
characters behind it, or a single character that occurs in no longer piece (such as
a line feed).  No piece crosses such a border (``Pieces`` checks its vocabulary for
that), so each chunk merges on its own and equal chunks give equal ids.  A table
holds the distinct chunks met so far; the missing ones of a batch are segmented
together: in each round every chunk applies its one best pair - best score, then
leftmost - which is the order in which the library's queue pops them.  A chunk of over
512 characters has rounds of its own, each of which merges all places of its best pair.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

_NONE = np.int64(1) << 62
_LONG = 512
_BLOCK = 1024


def path_of(name_or_path: str) -> str:
    """A file of public_tokenizers by its bare name, anything else as it is."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


class Pieces:
    """Vocabulary, merge table and chunk borders of a model with byte fallback and identity normaliser."""

    def __init__(self, model: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path_of(model), "rb") as f:
            proto.ParseFromString(f.read())
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if (
            trainer.model_type != trainer.BPE
            or not trainer.byte_fallback
            or trainer.treat_whitespace_as_suffix
            or spec.precompiled_charsmap
            or spec.remove_extra_whitespaces
            or not (spec.add_dummy_prefix and spec.escape_whitespaces)
        ):
            raise ValueError("expected a BPE model with byte fallback, identity normaliser and dummy prefix")
        plain = {p.piece.replace("▁", " "): (i, p.score) for i, p in enumerate(proto.pieces) if p.type == p.NORMAL}
        if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        if any(" " in p.lstrip(" ") for p in plain):
            raise ValueError("pieces cross white-space markers: chunks would not be independent")
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == p.BYTE}
        self.bytes_of: dict[int, bytes] = {i: p.encode() for p, (i, _) in plain.items()}
        self.bytes_of |= {i: bytes([b]) for b, i in self.byte_id.items()}
        # Symbols are piece ids; a character that is no piece itself but part of one gets an id behind them.
        self.symbol = {p: i for p, (i, _) in plain.items()}
        self.size = len(proto.pieces)
        inner = {c for p in plain if len(p) > 1 for c in p}
        self.extra: list[str] = []
        for c in sorted(inner - self.symbol.keys()):
            self.symbol[c] = self.size + len(self.extra)
            self.extra.append(c)
        ranks = np.unique([-s for _, s in plain.values()], return_inverse=True)[1]
        rank = dict(zip((i for i, _ in plain.values()), ranks.tolist()))
        merges = {}
        for p, (i, _) in plain.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    merges[(a << 20) | b] = (rank[i], i)
        self.merges = merges
        #: Symbol of each code point; an unknown one has its negative code point minus 1.
        self.of_code = -1 - np.arange(0x110000, dtype=np.int64)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.of_code[ord(c)] = i
        self._build_hash()
        alone = "".join(re.escape(c) for c in "\n\r\t" if c not in inner)
        self.cut = re.compile(rf" *[^ {alone}]+|[{alone}]| +" if alone else r" *[^ ]+| +")

    def _build_hash(self) -> None:
        """Open addressing, so that a round's look-ups are a few vector passes."""
        keys = np.array(list(self.merges), np.int64)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.value = np.zeros((1 << self.bits, 2), np.int64)
        values = np.array(list(self.merges.values()), np.int64).reshape(-1, 2)
        slots = self._slot(keys)
        self.most_probes = 0
        for key, value, slot in zip(keys.tolist(), values, slots.tolist()):
            probes = 1
            while self.keys[slot] != -1:
                slot = (slot + 1) & ((1 << self.bits) - 1)
                probes += 1
            self.keys[slot], self.value[slot] = key, value
            self.most_probes = max(self.most_probes, probes)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE if the pair does not merge) and merged symbol."""
        rank, merged = np.full(len(left), _NONE), np.zeros(len(left), np.int64)
        keys = (left << 20) | right
        slot, open_ = self._slot(keys), np.flatnonzero((left >= 0) & (right >= 0))
        slot = slot[open_]
        while len(open_):
            there = self.keys[slot]
            hit = there == keys[open_]
            rank[open_[hit]], merged[open_[hit]] = self.value[slot[hit], 0], self.value[slot[hit], 1]
            more = ~hit & (there != -1)
            open_, slot = open_[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return rank, merged

    def chunks(self, text: str | None) -> list[str]:
        return self.cut.findall(" " + text.replace("▁", " ")) if text else []

    def _symbols(self, text: str) -> np.ndarray:
        return self.of_code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _ids(self, symbols: list[int]) -> list[int]:
        if min(symbols) >= 0 and max(symbols) < self.size:
            return symbols
        ids = []
        for s in symbols:
            if 0 <= s < self.size:
                ids.append(s)
            else:
                ids += [self.byte_id[b] for b in (chr(-1 - s) if s < 0 else self.extra[s - self.size]).encode("utf-8", "surrogatepass")]
        return ids

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk."""
        out: list[list[int]] = [[]] * len(chunks)
        short = []
        for k, chunk in enumerate(chunks):
            if len(chunk) > _LONG:
                out[k] = self._ids(self._merge_long(self._symbols(chunk)))
            else:
                short.append(k)
        short.sort(key=lambda k: len(chunks[k]))  # chunks of like length finish together
        at = 0
        while at < len(short):
            to, size = at, 0
            while to < len(short) and size < 1 << 16:
                size += len(chunks[short[to]])
                to += 1
            for k, symbols in zip(short[at:to], self._merge_batch([chunks[k] for k in short[at:to]])):
                out[k] = self._ids(symbols)
            at = to
        return out

    def _merge_batch(self, chunks: list[str]) -> list[list[int]]:
        """Rank-synchronous merging: one best pair of every unfinished sequence a round."""
        sym = self._symbols("".join(chunks))
        seq = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
        done: list[list[int]] = [[]] * len(chunks)

        def pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            after = np.minimum(at + 1, len(sym) - 1)
            same = (at + 1 < len(sym)) & (seq[at] == seq[after])
            return self.look_up(np.where(same, sym[at], -1), np.where(same, sym[after], -1))

        rank, merged = pairs(np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            best = np.minimum.reduceat(np.where(rank == _NONE, _NONE, (rank << 32) | np.arange(len(sym))), starts)
            ended = best == _NONE
            sizes = np.diff(np.append(starts, len(sym)))
            keep = np.repeat(~ended, sizes)
            if ended.any():
                flat, cuts = sym[~keep].tolist(), np.concatenate([[0], np.cumsum(sizes[ended])]).tolist()
                for k, a, b in zip(seq[starts[ended]].tolist(), cuts, cuts[1:]):
                    done[k] = flat[a:b]
            at = best[~ended] & 0xFFFFFFFF
            sym[at] = merged[at]
            keep[at + 1] = False
            new = (np.cumsum(keep) - 1)[at]
            sym, seq, rank, merged = sym[keep], seq[keep], rank[keep], merged[keep]
            if len(new):
                changed = np.concatenate([new, np.maximum(new - 1, 0)])
                rank[changed], merged[changed] = pairs(changed)
        return done

    def _merge_long(self, sym: np.ndarray) -> list[int]:
        """One very long sequence, rank by rank: a round merges all places of the lowest rank at once.

        Places are linked, not moved, and the lowest rank is found over blocks, so a round costs what it
        changes.  Places that overlap go by turns from the left.  A merge that forms a pair of the same or
        a lower rank ends its round, as that pair comes before the places further right.
        """
        n = len(sym)
        sym, after, before = sym.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, merged = np.full(-(-n // _BLOCK) * _BLOCK, _NONE), np.zeros(n, np.int64)
        rank[: n - 1], merged[: n - 1] = self.look_up(sym[:-1], sym[1:])
        blocks, alive = rank.reshape(-1, _BLOCK), np.ones(n, bool)
        least = blocks.min(1)
        while (lowest := least.min()) != _NONE:
            rows = np.flatnonzero(least == lowest)
            row, col = np.nonzero(blocks[rows] == lowest)
            at = rows[row] * _BLOCK + col
            k = np.arange(len(at))
            apart = np.concatenate([[True], after[at[:-1]] != at[1:]])
            at = at[(k - np.maximum.accumulate(np.where(apart, k, 0))) % 2 == 0]
            right = after[at]
            left, beyond, new = before[at], after[right], merged[at]
            left_sym = np.where(left >= 0, sym[left], -1)
            touching = np.flatnonzero(left[1:] == right[:-1]) + 1  # the place before is merged by now
            left[touching], left_sym[touching] = at[touching - 1], new[touching - 1]
            rank_l, merged_l = self.look_up(left_sym, new)
            rank_r, merged_r = self.look_up(new, np.where(beyond < n, sym[np.minimum(beyond, n - 1)], -1))
            sooner = np.flatnonzero((rank_l <= lowest) | (rank_r <= lowest))
            to = sooner[0] + 1 if len(sooner) else len(at)
            at, right, left, beyond = at[:to], right[:to], left[:to], beyond[:to]
            sym[at], after[at], alive[right], rank[right] = new[:to], beyond, False, _NONE
            before[beyond[beyond < n]] = at[beyond < n]
            rank[at], merged[at] = rank_r[:to], merged_r[:to]
            rank[left[left >= 0]], merged[left[left >= 0]] = rank_l[:to][left >= 0], merged_l[:to][left >= 0]
            changed = np.unique(np.concatenate([at, right, left[left >= 0]]) // _BLOCK)
            least[changed] = blocks[changed].min(1)
        return sym[alive].tolist()


@lru_cache(2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


class ChunkTable(dict):
    """chunk -> what ``entry(ids)`` makes of its ids; emptied when it outgrows ``limit`` chunks."""

    def __init__(self, model: Pieces, entry, limit: int = 200_000):
        super().__init__()
        self.model, self.entry, self.limit = model, entry, limit

    def add(self, chunked: list[list[str]]) -> None:
        """Segment the distinct chunks that are missing; afterwards all of ``chunked`` can be looked up."""
        if len(self) > self.limit:
            self.clear()
        missing = list(set().union(*chunked).difference(self)) if chunked else []
        for chunk, ids in zip(missing, self.model.segment(missing)):
            self[chunk] = self.entry(ids)
