"""Operator 1: n-gram Jaccard join by universe-partition pigeonhole, exact at its threshold.

A document is its set of 5-word shingles (hashes of 64 bits). Sets with J >= 0.75 differ in at most
H = (|A| + |B|) / 7 shingles. Sets are put in size bands; a band's scheme parts the universe of
shingles into segments by hash. Each non-empty segment of a set offers the signature of its subset (F)
and its one-deletion neighbourhood (D: the subset and the subset less each one shingle). If two linked
sets share no F of a segment they differ there in one shingle at least, if they share no D in two.

Allocation by cost: every signature has a price, the estimated number of documents beyond chance that
hold its rarest shingle, times ``DELETION`` in a neighbourhood, whose rows are more. A set takes
signatures in the order of price until what it took allocates H + 1 differences: one for a segment
whose F is taken, two once its whole neighbourhood is. Were none of them shared, the sets would differ
in more than H shingles, so the cheapest signature that two linked sets share is taken by both: the
order is the same for all. Segments without a cheap signature get nothing. So what many documents
share (a passage, a line) is left out, and texts that are mostly such get neighbourhoods in their other
segments before they get a dear one. A set joins its own band's scheme and, if its partner may be larger,
the next one's. In the smallest band the whole set is one segment with its neighbourhood; a set whose
segments allocate too little in all (rare) also gives its cheapest shingles, as many as a prefix
filter needs.

Candidates are groups of sets with one signature. Equal sets are one node from the start. A slice
passes a signature's nodes on, but of more than ``SENT`` only the least one and keeps the others as a
part of the group, so a signature that a third of all documents share crosses the exchange once for
each slice; groups with the same members become one. In each round every component is compared with
one other of a group, exactly, on the shingles; links merge components, and groups that are within one
component are done. What still stands in one group but in different components is compared block by
block inside tasks, by bounds on sizes and folded bitmaps: first each set gives only its nearest ones,
which merges what copies of copies leave apart (groups of ``CROWD`` members or more), then every pair that the bounds let pass and that is
still in two components, so no link between components can be missed. A pair of several groups is
compared in the first of them only.

Defined results: null and empty texts and texts without words have no shingles and are linked with
nothing (their component is their own id); a text of under five words is one shingle; copies are
linked; ties go to the least id; every row is a document of its own, so rows that repeat an id may have
different sizes and components, and an id alone links nothing; a null id keeps its row, and is a
component's id only where all of its ids are null or it is linked with nothing; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from marlspring.llm.common import arrow_rows, lean, passing_tables, slices, text_of, written
from marlspring.llm.components import components
from marlspring.llm.hashing import mix, runs, word_hashes

WORDS = 5
#: The threshold as a fraction.
NUM, DEN = 75, 100
#: First size of each band; the sets of the first band allow one difference at most.
BANDS = [1, 6, *(6 * 3**k for k in range(1, 18))]
#: Counters of the frequency sketch (4 MB, whatever the corpus size), and pieces it is summed in.
SKETCH, PIECES = 1 << 20, 64
#: Members of a group, and bytes of their bitmaps, that are compared with as many others in one step.
BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: Rounds in which every component is compared with one other of a group, then with its nearest ones, before the rest is compared in full.
ROUNDS = ("hub", "nearest")
#: Members of a group from which on its sets are first compared with their nearest ones only.
CROWD = 64
#: Nearest sets that a set is compared with in such a round, and groups that a member's row names (more only cost repeated pairs).
NEAREST, NAMED = 3, 16
#: Bytes of text in a task's slice, and members of one signature that a slice sends on one by one.
SLICE, SENT = 400_000, 8
#: What a signature of a one-deletion neighbourhood costs more than a whole segment's.
DELETION = 4
#: Signature rows that a bucket is made for, keys of a group in one row, and tasks that a hot group's rows are dealt to.
BUCKET_ROWS, LONG, SALTS = 2_000_000, 50_000, 32
#: Rows that a Python task holds at a time; a row may carry two whole sets.
ARROW_ROWS = 500
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_U = np.uint64


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(_FOLD)


def shingle_sets(texts: list[str | None], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and their offsets by text."""
    hashes, ends = word_hashes([fold(t) for t in texts])
    n_words = np.diff(ends)
    who = np.repeat(np.arange(len(texts)), n_words)
    h = runs(hashes, k)
    whole = who[: len(h)] == who[k - 1 :] if len(h) else np.zeros(0, bool)
    h, owner = h[whole], who[: len(h)][whole]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        extra = np.concatenate([runs(hashes[ends[i] : ends[i + 1]], int(n_words[i])) for i in short])
        h, owner = np.concatenate([h, extra]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[first], owner[first]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def set_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A node's key: a hash of the whole set, as a signed number."""
    total = np.append(_U(0), np.cumsum(mix(h ^ _U(0xA5A5A5A5A5A5A5A5))))
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(_U) * _U(0x9E3779B97F4A7C15)).astype(np.int64)


def bitmap(h: np.ndarray) -> bytes:
    """Parity of the hashes by slot, in 1 to 2 slots for each; halves may be folded with exclusive or."""
    b = max(64, 1 << len(h).bit_length())
    return np.packbits((np.bincount((h & _U(b - 1)).astype(np.int64), minlength=b) & 1).astype(np.uint8), bitorder="little").tobytes()


def bits_differ(a: bytes, b: bytes) -> int:
    """A lower bound on the number of elements in which two sets differ."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def allowed(a, b):
    """Most differences of two linked sets of these sizes: |A|+|B|-2i where 100 i >= 75 (|A|+|B|-i)."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, n, key, bits of every document (kind 0), and the sketch of shingle frequencies in pieces (kind 1)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        names = ["kind", "doc_id", "n", "key", "bits"]
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                h, at = shingle_sets(part.column(1).to_pylist())
                counts += np.bincount((h >> _U(44)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
                n = np.diff(at)
                bits = [bitmap(h[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:])]
                key = pa.array(set_keys(h, at), mask=n == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), part.column(0), pa.array(n.astype(np.int64)), key, pa.array(bits, pa.binary())], names)
        pieces = np.split(counts, PIECES)
        none = pa.nulls(PIECES, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(PIECES, np.int32)), pa.array(np.arange(PIECES)), none, none, pa.array([p.tobytes() for p in pieces], pa.binary())], names)

    return docs.mapInArrow(run, "kind int, doc_id long, n long, key long, bits binary")


def summed_sketch(table: DataFrame) -> np.ndarray:
    """The frequency sketch over all documents: partitions are summed first, then pieces."""

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[k] = held.get(k, 0) + np.frombuffer(raw, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["doc_id", "bits"])

    pieces = table.where("kind = 1").select("doc_id", "bits").mapInArrow(add, "doc_id long, bits binary")
    rows = pieces.repartition(PIECES, "doc_id").mapInArrow(add, "doc_id long, bits binary").collect()  # PIECES rows
    counts = np.zeros(SKETCH, np.uint32)
    for r in rows:
        counts[r.doc_id * (SKETCH // PIECES) : (r.doc_id + 1) * (SKETCH // PIECES)] += np.frombuffer(r.bits, np.uint32)
    return counts


def _least(owner: np.ndarray, cost: np.ndarray, sig: np.ndarray, quota: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) of each owner's first ``quota`` signatures by cost, then signature."""
    order = np.lexsort((sig, cost, owner))
    owner, sig = owner[order], sig[order]
    starts = np.searchsorted(owner, np.arange(len(quota)))
    keep = np.arange(len(owner)) - starts[owner] < quota[owner]
    return owner[keep], sig[keep]


def prices(counts: np.ndarray) -> np.ndarray:
    """What a shingle of each counter costs: 1, plus the documents beyond those that share the counter by chance."""
    chance = float(np.median(counts))
    return (1 + np.clip(counts - chance - 3 * np.sqrt(chance), 0, 1 << 20)).astype(np.uint64)


def _ranked(price: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """The place of signatures in the one order by price, then by the signature itself."""
    return (np.minimum(price.astype(_U), _U((1 << 24) - 1)) << _U(40)) | (sig >> _U(24))


def _bound(owner: np.ndarray, place: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """Each owner's place number ``quota`` in order, the last of all where it has fewer."""
    order = np.lexsort((place, owner))
    starts = np.searchsorted(owner[order], np.arange(len(quota) + 1))
    out = np.full(len(quota), np.iinfo(_U).max, _U)
    enough = np.flatnonzero(np.diff(starts) >= quota)
    out[enough] = place[order[starts[enough] + quota[enough] - 1]]
    return out


def _allocated(o: np.ndarray, segment: np.ndarray, y: np.ndarray, c: np.ndarray, salt: np.uint64, quota: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(owner, signature) of what each set takes of its segments, and which sets' segments allocate less than their quota.

    o, segment, y, c: owner, segment, hash and price of each shingle.
    """
    order = np.lexsort((c, segment, o))  # the rarest shingle of a segment comes first
    o, segment, y, c = o[order], segment[order], y[order], c[order]
    start = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (segment[1:] != segment[:-1])))
    size = np.diff(np.append(start, len(o)))
    who, total, first = o[start], np.add.reduceat(y, start), c[start]
    tag = segment[start] * _U(0xC2B2AE3D27D4EB4F) + salt
    whole = mix(total + tag)
    place = _ranked(first, whole)
    bound = _bound(who, place, quota)
    # Neighbourhoods that may cost less than what the segments alone would take.
    near = np.flatnonzero(first * _U(DELETION) <= bound[who] >> _U(40))
    same = mix(total[near] + (tag[near] ^ _U(0xB5297A4D3F84D5B5)))
    same_place = _ranked(first[near] * _U(DELETION), same)
    many = np.flatnonzero(size[near] > 1)
    held = size[near[many]]
    at = np.repeat(np.arange(len(many)), held)
    inner = np.arange(len(at)) - np.repeat(np.cumsum(held) - held, held)
    of = near[many][at]
    less = mix(total[of] - y[start[of] + inner] + (tag[of] ^ _U(0xB5297A4D3F84D5B5)))
    rarest = np.where(inner == 0, c[start[of] + 1], first[of])  # of what is left
    less_place = _ranked(rarest * _U(DELETION), less)
    if len(many):
        complete = np.maximum(np.maximum.reduceat(less_place, np.cumsum(held) - held), same_place[many])
        events, owners = np.concatenate([place, complete]), np.concatenate([who, who[near[many]]])
        bound = _bound(owners, events, quota)
    else:
        owners = who
    found = [(w[p <= bound[w]], g[p <= bound[w]]) for w, g, p in ((who, whole, place), (who[near], same, same_place), (who[of], less, less_place))]
    return found, np.bincount(owners, minlength=len(quota)) < quota


def signatures(h: np.ndarray, at: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, signature) rows of a slice's sets; ``price`` is by the shingles' counters."""
    size = np.diff(at)
    band = np.searchsorted(BANDS, size, side="right") - 1
    owner = np.repeat(np.arange(len(size)), size)
    cost = price[(h >> _U(44)).astype(np.int64)].astype(_U)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for scheme in np.unique(np.concatenate([band, band + 1])) if len(size) else []:
        if scheme < 0 or scheme + 1 >= len(BANDS):
            continue
        low, high = BANDS[scheme], BANDS[scheme + 1] - 1
        largest = np.minimum(high, size * DEN // NUM)
        members = (size > 2) & ((band == scheme) | ((band == scheme - 1) & (largest >= low)))
        mine = members[owner]
        if not mine.any():
            continue
        o, x, c = owner[mine], h[mine], cost[mine]
        salt = _U((int(scheme) + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        y = mix(x ^ salt)
        if scheme == 0:  # one segment and its one-deletion neighbourhood: one difference at most
            total = np.zeros(len(size), _U)
            np.add.at(total, o, y)
            whole = np.flatnonzero(members)
            found += [(whole, mix(total[whole])), (o, mix(total[o] - y))]
            continue
        segments = max(1, -(-high // 2))
        segment = ((y >> _U(32)) * _U(segments)) >> _U(32)
        quota = np.where(members, allowed(size, largest) + 1, 1)
        taken, few = _allocated(o, segment, y, c, salt, quota)
        found += taken
        few &= members
        if few.any():  # the segments allocate too little: the cheapest shingles themselves
            some = few[o]
            found.append(_least(o[some], c[some], mix(y[some] ^ _U(0x94D049BB133111EB)), size - (size * NUM + DEN - 1) // DEN + 1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _runs_of(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sig, key) rows in order, and the start and length of each signature's run."""
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    first = np.ones(len(sig), bool)
    first[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key = sig[first], key[first]
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
    return sig, key, start, np.diff(np.append(start, len(sig)))


def _emitted(sig: np.ndarray, key: np.ndarray, start: np.ndarray, length: np.ndarray, partial: np.ndarray) -> pa.RecordBatch:
    """Groups as rows gid, keys, weight, partial. A whole group is known by its keys, and counted once for each signature.

    No row grows with its group: one of over ``LONG`` keys is several parts.
    """
    many = np.flatnonzero(length > 1)
    start, length, partial = start[many], length[many], partial[many] | (length[many] > LONG)
    total = np.append(_U(0), np.cumsum(mix(key.astype(_U))))
    known = mix(total[start + length] - total[start] + length.astype(_U))
    gid = np.where(partial, sig[start], known & ~_U(1)) if len(many) else np.zeros(0, _U)
    whole, parts = np.flatnonzero(~partial), np.flatnonzero(partial)
    _, first, counts = np.unique(gid[whole], return_index=True, return_counts=True)
    rows, weight = np.concatenate([whole[first], parts]), np.concatenate([counts, np.ones(len(parts), np.int64)])
    pieces = -(-length[rows] // LONG)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    rows, weight = np.repeat(rows, pieces), np.repeat(weight, pieces)
    gid, start, length, partial = gid[rows], start[rows] + nth * LONG, np.minimum(length[rows] - nth * LONG, LONG), partial[rows]
    ends = np.append(0, np.cumsum(length))
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], length) + np.repeat(start, length)
    keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[at]))
    return pa.RecordBatch.from_arrays([pa.array(gid.astype(np.int64)), keys, pa.array(weight.astype(np.int64)), pa.array(partial)], ["gid", "keys", "weight", "partial"])


def groups(docs: DataFrame, price, buckets: int) -> DataFrame:
    """gid, key, weight, salt: groups of nodes that share a signature, a row for each member; a hot group's members differ in ``salt``.

    A slice sends the members of a signature on, or, of more than ``SENT`` members, its least one, and
    keeps those together as a part. A signature with parts is one group by the signature; all others
    are whole where they meet, and groups with the same members become one, weighted.
    """

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                h, at = shingle_sets(part.column(0).to_pylist())
                key = set_keys(h, at)
                who, sig = signatures(h, at, price.value)
                sig, key, start, length = _runs_of(sig | _U(1), key[who])
                hot = length > SENT
                if hot.any():
                    held = _emitted(sig, key, start[hot], length[hot], np.ones(hot.sum(), bool))
                    # Parts go on as they are, so those of one signature may go to any bucket.
                    spread = pa.array(((mix(held.column(0).to_numpy().astype(_U) ^ key[0].astype(_U)) >> _U(7)) % _U(buckets)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([spread, *held.columns, pa.nulls(len(held), pa.binary())], names)
                kept = np.ones(len(sig), bool)
                kept[np.repeat(hot, length)] = False
                kept[start[hot]] = True
                sig = sig & ~_U(1) | np.repeat(hot, length).astype(_U)  # the lowest bit marks a part
                sig, key = sig[kept], key[kept]
                bucket = ((sig >> _U(1)) % _U(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cut))
                blob = [np.stack([sig[order[cut[b] : cut[b + 1]]].astype(np.int64), key[order[cut[b] : cut[b + 1]]]]).tobytes() for b in full]
                n = len(full)
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(blob, pa.binary())], names)

    names = ["bucket", "gid", "keys", "weight", "partial", "blob"]

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, keys = [], []
        for batch in batches:
            own = batch.filter(pc.is_valid(batch.column(1)))
            if own.num_rows:
                yield pa.RecordBatch.from_arrays(own.columns[1:5], names[1:5])
            for raw in batch.column(5).drop_null():
                both = np.frombuffer(raw.as_buffer(), np.int64).reshape(2, -1)
                sigs.append(both[0].astype(_U))
                keys.append(both[1].copy())
        if sigs:
            sig, key = np.concatenate(sigs), np.concatenate(keys)
            parts = np.unique(sig[(sig & _U(1)) == 1])
            sig, key, start, length = _runs_of(sig | _U(1), key)
            yield _emitted(sig, key, start, length, np.isin(sig[start], parts))

    dealt = docs.select("text").mapInArrow(deal, "bucket int, gid long, keys array<long>, weight long, partial boolean, blob binary")
    # Written, as whole groups and parts are both read from it and would each meet anew.
    found = written(dealt.repartition(buckets, "bucket").mapInArrow(meet, "gid long, keys array<long>, weight long, partial boolean"))
    whole = found.where("NOT partial").groupBy("gid").agg(F.first("keys").alias("keys"), F.sum("weight").alias("weight"))
    member = whole.select("gid", F.explode("keys").alias("key"), "weight", F.lit(0).alias("salt"))
    part = found.where("partial").select("gid", F.explode("keys").alias("key"), "weight").distinct()
    return member.union(part.withColumn("salt", F.expr(f"cast(pmod(xxhash64(key), {SALTS}) as int)")))


def _salted(per_group: DataFrame) -> DataFrame:
    """Rows by group (gid, hot and others) once for each salt that the group's members have."""
    return per_group.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")


def member_sets(docs: DataFrame, wanted) -> DataFrame:
    """key, n, set (64-bit hashes) of the nodes whose key passes a bitmap of wanted keys; a few rows for each key."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                h, at = shingle_sets(part.column(0).to_pylist())
                key = set_keys(h, at)
                low = key.astype(_U) & _U(WANTED - 1)
                hit = (wanted.value[(low >> _U(6)).astype(np.int64)] >> (low & _U(63))) & _U(1) == 1
                rows = []
                for i in np.flatnonzero(hit & (np.diff(at) > 0)):
                    k = int(key[i])
                    if k not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(k)
                        rows.append((k, h[at[i] : at[i + 1]].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["key", "set"])

    return docs.select("text").mapInArrow(run, "key long, set binary")


#: Bits of the broadcast bitmap of wanted keys (8 MB, whatever their number).
WANTED = 1 << 26


def wanted_bitmap(keys: DataFrame) -> np.ndarray:
    """Bits set for the low bits of the keys, summed in rows of 4096 bits (16384 rows at most reach the driver, in one job)."""
    at = F.expr(f"shiftright(key & {WANTED - 1}, 6)")
    bits = keys.select(at.alias("at"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"), F.shiftright(at, 6).alias("row"))
    rows = bits.repartition("row").groupBy("row", "at").agg(F.bit_or("bit").alias("bits"))  # dealt out once for both sums
    words = rows.groupBy("row").agg(F.collect_list("at").alias("at"), F.collect_list("bits").alias("bits")).toArrow()  # 64 words each
    out = np.zeros(WANTED // 64, np.int64)
    out[words.column("at").combine_chunks().flatten().to_numpy()] = words.column("bits").combine_chunks().flatten().to_numpy()
    return out.view(_U)


@F.pandas_udf(BooleanType())
def near(n_a, n_b, bits_a, bits_b):
    """Whether two sets may be linked, by sizes and bitmaps."""
    return pd.Series([bits_differ(x, y) <= allowed(int(a), int(b)) for a, b, x, y in zip(n_a, n_b, bits_a, bits_b)])


@F.pandas_udf(BooleanType())
def linked(set_a, set_b):
    """Whether two sets are linked, exactly."""
    out = []
    for a, b in zip(set_a, set_b):
        x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
        both = np.sort(np.concatenate([x, y]), kind="stable")
        i = int((both[1:] == both[:-1]).sum())
        out.append(DEN * i >= NUM * (len(x) + len(y) - i))
    return pd.Series(out)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked."""
    left, right = sets.select(F.col("key").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("key").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").where(linked("set_a", "set_b")).select("a", "b")


def jaccard_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each document."""
    spark: SparkSession = documents.sparkSession
    docs = text_of(documents)
    # Everything until the last, narrow join runs within.
    with arrow_rows(spark, ARROW_ROWS), passing_tables(spark) as keep:
        table = keep(written(nodes(docs)))
        price = spark.sparkContext.broadcast(prices(summed_sketch(table)))
        shingles = table.where("kind = 0").agg(F.sum("n")).first()[0] or 0
        # A set sends about a third of its shingles' number in signatures.
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(shingles / 3 / BUCKET_ROWS))
        grouped = written(groups(docs, price, buckets))
        labels = keep(_linked_components(spark, docs, table, grouped))
    rows = table.where("kind = 0").select("doc_id", "n", "key").join(labels, "key", "left").select("doc_id", "n", F.coalesce("root", "key").alias("root"))
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def _linked_components(spark: SparkSession, docs: DataFrame, table: DataFrame, members: DataFrame) -> DataFrame:
    """key, root of every node that is linked with another, from the groups' members (gid, key, weight, salt)."""
    sizes = table.where("kind = 0 AND key IS NOT NULL").groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    known = written(sizes.join(members.select("key").distinct(), "key", "left_semi"))
    at, labels, edges = members.withColumn("root", F.col("key")), None, None
    for kind in ROUNDS:
        if kind == "hub":
            pairs = written(_possible(written(_hub_pairs(at)), known))
        else:
            pairs = _nearest(_cross_pairs(at, known, nearest=True))
        new = written(verified(pairs, _of_pairs(docs, pairs)))
        edges = new if edges is None else edges.union(new)
        labels = components(edges)
        # Groups that are within one component are done; the others' members stay, with their components.
        labelled = written(at.select("gid", "key", "weight", "salt").join(labels, "key", "left").select("gid", "key", "weight", "salt", F.coalesce("root", "key").alias("root")))
        open_ = labelled.groupBy("gid").agg(F.min("root").alias("x"), F.max("root").alias("y"), (F.max("salt") > 0).alias("hot")).where("x <> y").select("gid", "hot")
        at = written(labelled.join(_salted(open_), ["gid", "salt"], "left_semi"))
    pairs = written(_cross_pairs(at, known).select("a", "b").distinct())
    new = written(verified(pairs, _of_pairs(docs, pairs)))
    return components(edges.union(new)) if not new.isEmpty() else labels


def _hub_pairs(members: DataFrame) -> DataFrame:
    """a, b: one node of each component of a group, and one of the least component that it meets most (gid, key, weight, salt, root)."""
    one = members.groupBy("gid", "root").agg(F.min("key").alias("key"), F.max("weight").alias("weight"), F.max("salt").alias("salt"))
    hub = _salted(one.groupBy("gid").agg(F.min(F.struct("root", "key")).alias("hub"), (F.max("salt") > 0).alias("hot")))
    met = one.join(hub, ["gid", "salt"]).where("root <> hub.root").groupBy("root", F.col("hub.root").alias("other")).agg(F.sum("weight").alias("n"), F.min(F.struct("key", F.col("hub.key").alias("to"))).alias("pair"))
    return met.groupBy("root").agg(F.max(F.struct("n", "pair")).alias("m")).select(F.col("m.pair.key").alias("a"), F.col("m.pair.to").alias("b"))


def _of_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, set of the nodes that pairs name, written; made anew from the texts, as few of all sets are ever named."""
    keys = written(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    wanted = docs.sparkSession.sparkContext.broadcast(wanted_bitmap(keys))
    return written(member_sets(docs, wanted).join(keys, "key", "left_semi").dropDuplicates(["key"]))


def _nearest(pairs: DataFrame) -> DataFrame:
    """a, b: of each node's pairs (a, b, apart) the ``NEAREST`` least apart."""
    best = pairs.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct("apart", "b"))), 1, NEAREST).alias("m"))
    return written(best.select("a", F.explode("m.b").alias("b")))


def _cross_pairs(members: DataFrame, known: DataFrame, nearest: bool = False) -> DataFrame:
    """a, b, apart: pairs of one group but two components (gid, key, root) that sizes and bitmaps don't rule out.

    A group is cut into blocks of about ``BLOCK`` members or ``BLOCK_BYTES``, and a task compares two blocks at a time as
    arrays: only pairs that pass leave it (``nearest``: a member's nearest in the other block), so
    neither a group nor its pairs are ever gathered. A member names its first groups; a pair that
    shares an earlier one is left to that.
    """
    width = known.select("key", F.octet_length("bits").cast("long").alias("w"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("w") / BLOCK_BYTES)).cast("int")
    sizes = members.join(width, "key").groupBy("gid").agg(blocks.alias("blocks"), (F.max("salt") > 0).alias("hot"), F.count("*").alias("n"))
    sizes = written(sizes.where(f"n >= {CROWD if nearest else 0}").drop("n"))
    named = members.groupBy("key").agg(F.expr(f"slice(array_sort(collect_list(gid)), 1, {NAMED})").alias("named"))
    rows = members.join(_salted(sizes), ["gid", "salt"]).join(written(known.join(named, "key")), "key").withColumn("own", F.expr("cast(pmod(xxhash64(key, 7), blocks) as int)"))
    earlier = F.expr("filter(named, g -> g < gid)").alias("named")
    dealt = rows.select("gid", "key", "root", "n", "bits", earlier, "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    dealt = dealt.select("gid", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "key", "root", "n", "bits", "named")

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            gid, lo, hi = (table.column(k).to_numpy() for k in range(3))
            starts = np.flatnonzero(np.append(True, (gid[1:] != gid[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))) if len(gid) else [0]
            yield _pass(table.slice(0, starts[-1]), starts, nearest)
            held = table.slice(starts[-1]).to_batches()  # the last group may go on
        if held:
            table = pa.Table.from_batches(held)
            yield _pass(table, np.array([0, table.num_rows]), nearest)

    keys = ["gid", "lo", "hi"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long, apart int")


def _masks(named: pa.ListArray) -> np.ndarray:
    """A row of bits for each list: which groups it names, of those that two lists name at least."""
    _, groups, counts = np.unique(named.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = counts[groups] > 1
    slot = np.cumsum(counts > 1) - 1
    who = np.repeat(np.arange(len(named)), pc.list_value_length(named).to_numpy(zero_copy_only=False))[shared]
    at = slot[groups[shared]]
    bits = np.zeros((len(named), max(1, -(-int((counts > 1).sum()) // 64))), _U)
    np.bitwise_or.at(bits, (who, at >> 6), _U(1) << (at & 63).astype(_U))
    return bits


def _pass(table: pa.Table, starts: np.ndarray, nearest: bool) -> pa.RecordBatch:
    """The pairs of consecutive groups of rows (gid, lo, hi, own, key, root, n, bits, named) that pass."""
    lo, hi, own, key, root, n = (table.column(k).to_numpy() for k in range(1, 7))
    bits, named = table.column(7).to_pylist(), table.column(8).combine_chunks()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if e - s < 2 or (root[s:e] == root[s]).all():
            continue
        mask = _masks(named.slice(s, e - s))
        order = s + np.argsort(n[s:e], kind="stable")
        by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in sorted({len(bits[i]) for i in order}):
            at = np.array([i for i in order if len(bits[i]) == width])
            by[width] = at, np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), -1)
        for width, (at, rows) in by.items():
            others = [(at, rows, True)]
            if 2 * width in by:  # linked sets' bitmaps differ by one halving at most
                wide, full = by[2 * width]
                half = full.shape[1] // 2
                others.append((wide, full[:, :half] ^ full[:, half:], False))
            for to, matrix, same in others:
                for k, i in enumerate(at.tolist()):
                    first = k + 1 if same else 0
                    last = np.searchsorted(n[to], n[i] * DEN // NUM, side="right")  # rows are in the order of sizes
                    j = to[first:last]
                    ok = (root[j] != root[i]) & (DEN * np.minimum(n[j], n[i]) >= NUM * np.maximum(n[j], n[i]))
                    if lo[s] != hi[s]:
                        ok &= own[j] != own[i]
                    ok = np.flatnonzero(ok)
                    ok = ok[~(mask[j[ok] - s] & mask[i - s]).any(axis=1)]
                    if len(ok):
                        j = j[ok]
                        apart = np.bitwise_count(matrix[first:last][ok] ^ rows[k]).sum(axis=1, dtype=np.int32)
                        near_ = np.flatnonzero(apart <= allowed(n[j], n[i]))
                        if nearest and len(near_):
                            near_ = near_[[apart[near_].argmin()]]
                        out.append((np.full(len(near_), key[i]), key[j[near_]], apart[near_]))
    a, b, apart = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    if not nearest:
        a, b = np.minimum(a, b), np.maximum(a, b)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(apart)], ["a", "b", "apart"])


def _possible(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs that sizes and bitmaps don't rule out."""
    left = known.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = known.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    sized = pairs.join(left, "a").join(right, "b").where(f"{DEN} * least(n_a, n_b) >= {NUM} * greatest(n_a, n_b)")
    return sized.where(near("n_a", "n_b", "bits_a", "bits_b")).select("a", "b")
