"""Near-duplicate links by Jaccard similarity of word shingles, through parity sketches.

A text's set is cut into parts by hash, and the sketch of a part is the XOR of the hashes in it.
One shingle more or less changes one part, so the number of parts in which two sketches differ (their
Hamming distance over parts) is never more than the symmetric difference. For sets of sizes
a and b with similarity ``NUMERATOR/DENOMINATOR`` the latter is at most (a + b) / 7.

Size bands double. A text joins in its own band and, where a partner may be larger, in the next; all
texts of a band use the same parts. Each emits the keys of its first d + 1 + s parts that aren't
empty, d being the largest difference any partner allows: by the pigeonhole principle, linked texts
share 1 + s keys at least. s is a reserve: a key in more than ``COMMON`` classes yields no pairs, and
as many such keys as ``spare(s)`` leave enough others for all partners of a text. Partners that share more of them (in
large groups of near copies, in texts made of common passages) meet in the common keys: each drops its ``spare(s)`` most
frequent ones, and a pair that shares more than that still has one in common.

1. Equal sets become one class. 2. Keys go to ranges of the hash space, packed; a range finds
keys of several classes and counts shared keys by pair; pairs below the guaranteed number are
impossible. 3. Candidates that bit sketches don't rule out are verified on the whole sets, first those that would span the groups,
then only those between groups that are still apart. 4. Common keys: members are verified
against the first one, then groups that are still apart are compared in blocks by bit sketches,
whose Hamming distance is a lower bound as well, and what passes is verified: the nearest pairs of each
group first, then, in the keys that had more, ever more of those that are still apart, until none is left. A pair that meets in several keys comes
from the first of them. No candidate is dropped.

Shingles are 64-bit hashes; two different ones agree with a chance of 2**-64. A class is named by 58 bits of two folds of its
set, so two given sets that differ share a name with a chance of 2**-58: among 10**8 different texts one such pair is expected in about 60 runs.

Defined results: null texts and texts without words have no shingles and are linked with nothing; a
text of one to four words is one shingle; rows with equal doc_id are separate rows of one group if linked; a
null doc_id never is the id of a component unless all ids of a group are null; an empty table
gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.llm.components import components, lookup, merged
from tidewave.llm.memory import give_back, release
from tidewave.llm.words import NOT_SPACE, Words, mixed, pieces, words_of
from tidewave.operators.sizing import cut_lineage

SHINGLE = 5
NUMERATOR, DENOMINATOR = 3, 4
SINGLE_UP_TO = 127  # in bands up to this size every shingle is a part
COMMON = 32
LARGEST_RESERVE = 63
KEYS_PER_RANGE = 200_000
KEYS_AT_ONCE = 250_000
KEYS_PER_ROW = 64
BROADCAST_ROWS = 200_000
FIRST_PAIRS = 2
FIRST_KEYS = 16
HALF = np.uint64(32)
LOW_HALF = np.uint64((1 << 32) - 1)
SHORT_BYTES = 5
ROWS_AT_ONCE = 500
BLOCK = 4096
PLACES = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def allowed(a: int, largest: int) -> int:
    """Largest symmetric difference of a set of size a and a partner of up to ``largest``."""
    return (a + min(DENOMINATOR * a // NUMERATOR, largest)) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def reserve(n: int) -> int:
    d = allowed(n, 2 * n)
    return max(0, min(2 * (d + 1) // 5 + 1, n - d - 1, LARGEST_RESERVE))


def spare(s: Column) -> Column:
    """Common keys a text can have and still meet every partner elsewhere; no more than any partner's reserve."""
    return F.greatest(F.lit(0), F.floor(3 * s / 4) - 1)


def sets_of(words: Words) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h = words.hashes
    n = len(h) - SHINGLE + 1
    all_shingles = mixed(sum(h[j:n + j] * PLACES[j] for j in range(SHINGLE))) if n > 0 else h[:0]
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= SHINGLE:
            found = np.sort(all_shingles[a:b - SHINGLE + 1])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif b > a:
            yield mixed((h[a:b] * PLACES[:b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield h[:0]


def class_of(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set; its last six bits are the reserve."""
    n = len(shingles)
    fold = mixed(np.asarray([np.bitwise_xor.reduce(shingles), shingles.sum() + np.uint64(n)]))
    name = int(mixed(fold[:1] ^ (fold[1:] * PLACES[1]))[0])
    return ((name & ~63) | reserve(n)) - (1 << 64 if name >> 63 else 0)


def short_name(name: int) -> int:
    """40 bits of a class's name, the reserve among them."""
    return ((name >> 30) & 0x3FFFFFFFF) << 6 | name & 63


def short_of(name: str) -> Column:
    return F.shiftleft(F.shiftrightunsigned(name, 30), 6).bitwiseOR(F.col(name).bitwiseAND(63))


def bands(n: int) -> list[tuple[int, int]]:
    """(band, keys to emit) of a set of size n."""
    own = n.bit_length() - 1
    found = [(own, allowed(n, (2 << own) - 1))]
    if DENOMINATOR * n // NUMERATOR >= 2 << own:
        found.append((own + 1, allowed(n, 4 << own)))
    return [(band, d + 1 + reserve(n)) for band, d in found]


def keys_of(shingles: np.ndarray) -> np.ndarray:
    """Keys of the first parts of a set in each of its bands."""
    found = []
    for band, need in bands(len(shingles)):
        largest = (2 << band) - 1
        if largest <= SINGLE_UP_TO:
            words = shingles[:need]
        else:
            part = ((shingles >> np.uint64(32)) * np.uint64(largest)) >> np.uint64(32)
            head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))[:need + 1]
            words = np.bitwise_xor.reduceat(shingles[:head[-1]] if len(head) > need else shingles, head[:need])
        if len(words) < need:
            raise ValueError("a set fills too few parts of its sketch; choose other shingle constants")
        found.append(mixed(words ^ np.uint64((band + 1) * int(PLACES[2]) % 2**64)))
    return np.concatenate(found)


def bit_sketch(shingles: np.ndarray) -> bytes:
    """Parity bits over at least twice as many places as shingles."""
    places = 64 << max(0, (2 * len(shingles) - 1).bit_length() - 6)
    at = (shingles >> np.uint64(8)).astype(np.int64) & (places - 1)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(bool), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch brought to fewer places; parities of merged places are added."""
    bits = np.frombuffer(sketch, np.uint64)
    return np.bitwise_xor.reduce(bits.reshape(-1, size // 8), axis=0)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if NUMERATOR * max(len(a), len(b)) > DENOMINATOR * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def each_set(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, np.ndarray]]:
    column = batch.column(batch.schema.get_field_index(text))
    for a, b in pieces(column):
        for i, shingles in enumerate(sets_of(words_of(column.slice(a, b - a), NOT_SPACE))):
            yield a + i, shingles


def texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, class, n_shingles, n_keys) of each row; checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, size, keys = [], [], []
            for _, s in each_set(batch, "text"):
                name.append(class_of(s) if len(s) else None)
                size.append(len(s))
                keys.append(sum(need for _, need in bands(len(s))) if len(s) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(name, pa.int64()), pa.array(size, pa.int64()), pa.array(keys, pa.int64())],
                names=["doc_id", "text_hash", "class", "n_shingles", "n_keys"])
        give_back()

    rows = texts(docs, doc_id, text).mapInArrow(run, "doc_id long, text_hash long, class long, n_shingles long, n_keys long")
    return cut_lineage(rows)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def packed_keys(docs: DataFrame, text: str, n_ranges: int) -> DataFrame:
    """Rows (range, common, keys, names): packed arrays of keys, one row per batch and range.

    A key is 32 bits, as the range tells others, and the short name of its class, so that it takes 9 bytes however many
    ranges there are. Keys or classes that agree in these bits only add candidates: two keys of one class that do are told
    apart, and classes of one short name are for the caller to compare. Of a key that many classes of one
    batch have, a range gets enough to know it as common; the others are already told apart, as whole keys.
    """
    at_once = max(KEYS_AT_ONCE, min(4 * KEYS_AT_ONCE, KEYS_PER_ROW * n_ranges))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, seen, n = [], [], set(), 0
        for batch in batches:
            for _, s in each_set(batch, "text"):
                if len(s) and (name := class_of(s)) not in seen:
                    seen.add(name)
                    keys.append(keys_of(s))
                    names.append(np.full(len(keys[-1]), short_name(name), np.int64))
                    n += len(keys[-1])
                    if n >= at_once:
                        yield from packed_rows(keys, names)
                        keys, names, seen, n = [], [], set(), 0
        yield from packed_rows(keys, names)
        give_back()

    def packed_rows(keys: list[np.ndarray], names: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if keys:
            key, name = np.concatenate(keys), np.concatenate(names)
            key = ((key >> HALF) * np.uint64(n_ranges) >> HALF) << HALF | key & LOW_HALF
            order = np.argsort(key, kind="stable")
            key, name = key[order], name[order]
            again = 1 + np.flatnonzero((key[1:] == key[:-1]) & (name[1:] == name[:-1]))
            if len(again):  # a partner that has both does the same
                key[again] += np.uint64(1)
                order = np.argsort(key, kind="stable")
                key, name = key[order], name[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            turn = np.arange(len(key)) - np.repeat(head, np.diff(np.append(head, len(key))))
            over = turn > COMMON
            target = (key >> HALF).astype(np.int64)
            target[over] = (name[over] >> 6) % n_ranges
            rows = []
            for common in (False, True):
                some = np.flatnonzero(over == common)
                some = some[np.argsort(target[some], kind="stable")]
                edge = np.flatnonzero(np.concatenate([[True], target[some][1:] != target[some][:-1]])) if len(some) else []
                for part in np.split(some, edge[1:]) if len(some) else ():
                    own = name[part].view(np.uint8).reshape(-1, 8)[:, :SHORT_BYTES]
                    rows.append((int(target[part[0]]), common, key[part].astype(np.uint64 if common else np.uint32).tobytes(), own.tobytes()))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
                names=["range", "common", "keys", "names"])

    return docs.select(F.col(text).alias("text")).mapInArrow(emit, "range int, common boolean, keys binary, names binary")


def shared_keys(docs: DataFrame, text: str, n_keys: int) -> DataFrame:
    """Rows (common, x, y, n): pairs of short names x, y with n shared keys, and common keys x of a short name y. Checkpointed."""

    def meet(table: pa.Table) -> pa.Table:
        out = pairs_of_range(table)
        give_back()
        return out

    def pairs_of_range(table: pa.Table) -> pa.Table:
        xs, ys, ns, kinds = [], [], [], []
        here = np.uint64(table.column("range")[0].as_py()) << HALF

        def gathered(is_common: bool) -> tuple[np.ndarray, np.ndarray]:
            """Keys and short names of the rows of one kind."""
            rows = table.filter(pc.equal(table.column("common"), is_common))
            keys, own = (b"".join(rows.column(c).to_pylist()) for c in ("keys", "names"))
            raw = np.zeros((len(own) // SHORT_BYTES, 8), np.uint8)
            raw[:, :SHORT_BYTES] = np.frombuffer(own, np.uint8).reshape(-1, SHORT_BYTES)
            return np.frombuffer(keys, np.uint64 if is_common else np.uint32).astype(np.uint64), raw.view(np.int64).reshape(-1)

        def tell(is_common: bool, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
            kinds.append(np.full(len(x), is_common))
            xs.append(x.view(np.int64))
            ys.append(y)
            ns.append(n.astype(np.int64))

        more, owners = gathered(True)
        tell(True, more, owners, np.zeros(len(more)))
        key, name = gathered(False)
        own, at = np.unique(name, return_inverse=True)
        both = np.unique(key << HALF | at.astype(np.uint64))
        key, at = both >> HALF, both & LOW_HALF
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.append(head, len(key)))
        pairs = [np.empty(0, np.uint64)]
        for k in range(2, COMMON + 1):
            first = head[size == k]
            i, j = np.triu_indices(k, 1)
            pairs.append((at[first[:, None] + i] << HALF | at[first[:, None] + j]).reshape(-1))
        pairs, n = np.unique(np.concatenate(pairs), return_counts=True)
        tell(False, own[pairs >> HALF], own[pairs & LOW_HALF], n)
        hot = np.repeat(size > COMMON, size)
        tell(True, here | key[hot], own[at[hot]], np.zeros(int(hot.sum())))
        return pa.table({"common": pa.array(np.concatenate(kinds)), "x": pa.array(np.concatenate(xs)), "y": pa.array(np.concatenate(ys)), "n": pa.array(np.concatenate(ns))})

    packed = packed_keys(docs, text, max(1, math.ceil(n_keys / KEYS_PER_RANGE)))
    return cut_lineage(packed.groupBy("range").applyInArrow(meet, "common boolean, x long, y long, n long"))


def names_of(rows: DataFrame) -> DataFrame:
    """(short, class) of each class. Checkpointed."""
    return cut_lineage(rows.where("class is not null").select(short_of("class").alias("short"), "class").distinct())


def namesakes(names: DataFrame) -> DataFrame:
    """Pairs (a, b) of the classes that have one short name, which ``shared_keys`` takes for one."""
    several = names.groupBy("short").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("short")
    few = cut_lineage(names.join(lookup(cut_lineage(several)), "short"))
    return few.select("short", F.col("class").alias("a")).join(few.select("short", F.col("class").alias("b")), "short").where("a < b").select("a", "b")


def sets_table(docs: DataFrame, doc_id: str, text: str, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, shingles, sketch) of the wanted classes, from one text of each. Checkpointed."""
    chosen = (
        rows.join(wanted, "class").groupBy("class")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("row"))
        .select(F.col("row.doc_id").alias("_doc"), F.col("row.text_hash").alias("_hash"), F.col("class").alias("_class"))
    )
    chosen = cut_lineage(chosen)
    n = chosen.count()
    chosen = F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen
    found = texts(docs, doc_id, text).join(chosen, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, shingles, sketch, held = [], [], [], 0
            for i, s in each_set(batch, "text"):
                name.append(batch.column(1)[i].as_py())
                shingles.append(s.tobytes())
                sketch.append(bit_sketch(s))
                held += 8 * len(s)
                if held > 16 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(shingles, pa.binary()), pa.array(sketch, pa.binary())], names=["class", "shingles", "sketch"])
                    name, shingles, sketch, held = [], [], [], 0
        give_back()

    made = found.select("text", F.col("_class").alias("class")).mapInArrow(run, "class long, shingles binary, sketch binary")
    made = cut_lineage(made)
    return made if made.count() == n else cut_lineage(made.dropDuplicates(["class"]))


def screened(pairs: DataFrame, sets: DataFrame, columns: list[str], passes: Callable[..., bool]) -> DataFrame:
    """The pairs (a, b) for which ``passes`` holds on the given columns of a and then of b. Checkpointed.

    Pairs that are few, as counted, go to the sets, so that only the sets of these pairs are shuffled, and once.
    """
    pairs = cut_lineage(pairs)
    few = pairs.count() <= BROADCAST_ROWS

    def of(name: str) -> DataFrame:
        return sets.select(F.col("class").alias(name), *(F.col(c).alias(f"_{name}_{c}") for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                given = zip(*(part.column(i).to_pylist() for i in range(2, part.num_columns)))
                yield part.select([0, 1]).filter(pa.array([passes(*row) for row in given], pa.bool_()))
        give_back()

    if few:
        others = of("b").join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
        joined = of("a").join(F.broadcast(pairs), "a").join(others, "b")
    else:
        joined = pairs.join(of("a"), "a").join(of("b"), "b")
    return cut_lineage(joined.select("a", "b", *(f"_{n}_{c}" for n in "ab" for c in columns)).mapInArrow(run, "a long, b long"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar."""
    return screened(pairs, sets, ["shingles"], lambda x, y: similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))


def within_reach(x_size: int, x_sketch: bytes, y_size: int, y_sketch: bytes) -> bool:
    """Whether sizes and parity bits leave room for similarity."""
    if NUMERATOR * max(x_size, y_size) > DENOMINATOR * min(x_size, y_size):
        return False
    places = min(len(x_sketch), len(y_sketch))
    distance = int(np.bitwise_count(folded(x_sketch, places) ^ folded(y_sketch, places)).sum())
    return (DENOMINATOR + NUMERATOR) * distance <= (DENOMINATOR - NUMERATOR) * (x_size + y_size)


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that sizes and bit sketches don't rule out."""
    small = sets.select("class", (F.octet_length("shingles") / 8).cast("int").alias("size"), "sketch")
    return screened(pairs, small, ["size", "sketch"], within_reach)


def reserve_of(name: str) -> Column:
    return F.col(name).bitwiseAND(63)


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose classes have no common label."""
    of = labels.select(F.col("node").alias("a"), F.col("label").alias("_la"))
    to = labels.select(F.col("node").alias("b"), F.col("label").alias("_lb"))
    both = pairs.join(of, "a", "left").join(to, "b", "left")
    return both.where(F.coalesce("_la", "a") != F.coalesce("_lb", "b")).select("a", "b")


def block_pairs(members: DataFrame, labels: DataFrame, sketches: DataFrame, limit: int, once: bool) -> DataFrame:
    """Pairs (a, b, key, more) within common keys whose labels differ and that bit sketches don't rule out.

    The members of a key are cut into blocks; every two blocks of a key meet in one group. Only keys
    that still hold several labels take part. Of a label's pairs in a group the ``limit`` with the nearest
    sketches come; ``more`` tells that there are others in the key, for a later round. With ``once`` every class takes part in one key only.
    Else a pair comes from the first key of both, and from later ones only if that is beyond the ``FIRST_KEYS`` first of either.
    """
    known = members.join(labels, members["class"] == labels["node"], "left").select("key", "class", F.coalesce("label", "class").alias("label"))
    open_keys = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("k")).where("low < high")
    open_keys = lookup(cut_lineage(open_keys.select("key", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))))
    known = known.join(open_keys, "key")
    if once:
        first = known.groupBy("class").agg(F.min(F.struct("key", "label", "blocks")).alias("first"))
        known = first.select("class", "first.*")
    rows = known.join(sketches, "class")
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    spread = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "class", "label", "size", "sketch", "first_keys")

    def earlier_keys(table: pa.Table, order: np.ndarray) -> np.ndarray:
        """Those of each row's first keys that come before the key of this group, else -1."""
        lists = table.column("first_keys").combine_chunks()
        size, flat = pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy()
        out = np.full((len(size), FIRST_KEYS), -1)
        out[np.arange(FIRST_KEYS) < size[:, None]] = flat
        out[out >= (0 if once else table.column("key")[0].as_py())] = -1
        return out[order]

    def compare(table: pa.Table) -> pa.Table:
        size = table.column("size").to_numpy()
        order = np.lexsort((table.column("class").to_numpy(), size))
        size, name, label = size[order], table.column("class").to_numpy()[order], table.column("label").to_numpy()[order]
        sketch = table.column("sketch").take(pa.array(order)).to_pylist()
        width = np.asarray([len(x) for x in sketch])  # grows with the size
        earlier = earlier_keys(table, order)
        ones, others, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        more = False
        for w in np.unique(width).tolist():
            first, end, last = np.searchsorted(width, [w, w + 1, 2 * w + 1]).tolist()
            bits = np.stack([folded(x, w) for x in sketch[first:last]])
            ends = np.searchsorted(size, DENOMINATOR * size[first:end] // NUMERATOR, "right").tolist()
            for i in range(first, end):
                rest = slice(i + 1, ends[i - first])
                distance = np.bitwise_count(bits[i + 1 - first:rest.stop - first] ^ bits[i - first]).sum(axis=1, dtype=np.int64)
                near = (DENOMINATOR + NUMERATOR) * distance <= (DENOMINATOR - NUMERATOR) * (size[rest] + size[i])
                found = np.flatnonzero(near & (label[rest] != label[i]))
                own = earlier[i][earlier[i] >= 0]
                if len(found) and len(own):
                    found = found[~np.isin(earlier[i + 1 + found], own).any(axis=1)]
                if len(found) > limit:
                    more, found = True, found[np.argsort(distance[found], kind="stable")[:limit]]
                ones.append(np.full(len(found), i))
                others.append(i + 1 + found)
                far.append(distance[found])
        one, other, far = np.concatenate(ones), np.concatenate(others), np.concatenate(far)
        order = np.lexsort((far, label[one]))
        one, other = one[order], other[order]
        head = np.flatnonzero(np.concatenate([[True], label[one][1:] != label[one][:-1]])) if len(one) else np.empty(0, np.int64)
        turn = np.arange(len(one)) - np.repeat(head, np.diff(np.append(head, len(one))))
        more = more or bool((turn >= limit).any())
        a, b = name[one[turn < limit]], name[other[turn < limit]]
        key = np.full(len(a), table.column("key")[0].as_py(), np.int64)
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "key": pa.array(key), "more": pa.array(np.full(len(a), more))})

    return met.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long, key long, more boolean")


def crowded_members(shared: DataFrame, names: DataFrame) -> DataFrame:
    """(key, class) of the common keys in which classes with too many of them have to meet. Keys are numbered, the most frequent first."""
    common = shared.where("common").select(F.col("x").alias("key"), F.col("y").alias("short")).distinct()
    common = cut_lineage(common.join(names, "short").select("key", "class"))
    counts = common.groupBy("class").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") > spare(reserve_of("class")))
    crowded = cut_lineage(common.join(lookup(cut_lineage(counts)), "class"))
    often = crowded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key")
    often = lookup(cut_lineage(often.withColumn("number", F.monotonically_increasing_id())))
    rare_first = W.partitionBy("class").orderBy("n", "key")
    return (
        crowded.join(often, "key").withColumn("turn", F.row_number().over(rare_first))
        .where(F.col("turn") <= F.col("all") - spare(reserve_of("class"))).select(F.col("number").alias("key"), "class")
    )


def sketches_of(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(class, size, sketch, first_keys) of the classes with common keys; ``first_keys`` are the first of them in ascending order. Checkpointed."""
    first = members.groupBy("class").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST_KEYS).alias("first_keys"))
    own = sets.select("class", (F.octet_length("shingles") / 8).cast("int").alias("size"), "sketch")
    return cut_lineage(own.join(lookup(cut_lineage(first)), "class"))


def linked_classes(docs: DataFrame, rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, label) of the classes that are linked with another."""
    spark = docs.sparkSession
    n_keys = rows.agg(F.sum("n_keys")).first()[0] or 0
    shared = shared_keys(docs, text, n_keys)
    names = lookup(names_of(rows))
    release(spark)
    low = F.least(reserve_of("x"), reserve_of("y"))
    high = F.greatest(spare(reserve_of("x")), spare(reserve_of("y")))
    met = cut_lineage(
        shared.where("not common").groupBy("x", "y").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= F.greatest(F.lit(1), 1 + low - high)).select("x", "y"))
    met = met.join(names.select(F.col("short").alias("x"), F.col("class").alias("a")), "x").join(names.select(F.col("short").alias("y"), F.col("class").alias("b")), "y")
    pairs = cut_lineage(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(namesakes(names)))
    members = cut_lineage(crowded_members(shared, names))
    crowded = members.select("class").distinct()
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(crowded).distinct()
    sets = sets_table(docs, doc_id, text, rows, wanted)
    del shared
    release(spark)

    firsts = lookup(cut_lineage(members.groupBy("key").agg(F.min("class").alias("a"))))
    starred = members.join(firsts, "key").where("class != a").select("a", F.col("class").alias("b")).distinct()
    pairs = plausible(pairs.union(starred).distinct(), sets)
    links = verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets)
    labels = lookup(components(links))
    release(spark)
    rest = cut_lineage(apart(pairs, labels))
    if rest.limit(1).count():
        labels = lookup(merged(labels, verified(rest, sets)))

    # the first round joins what it can through one key of each class, the second looks at all, the others at those that had more
    sketches = sketches_of(members, sets)
    limit, once = FIRST_PAIRS, True
    while True:
        release(spark)
        rest = cut_lineage(block_pairs(members, labels, sketches, limit, once))
        if rest.limit(1).count():
            labels = lookup(merged(labels, verified(rest.select("a", "b").distinct(), sets)))
        if not once:
            unfinished = cut_lineage(rest.where("more").select("key").distinct())
            if not unfinished.limit(1).count():
                return labels
            members = cut_lineage(members.join(lookup(unfinished), "key"))
        limit, once = limit if once else 16 * limit, False


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, class, component_id, n_rows) of each row.

    ``class`` is the group's name, null for texts without words; ``n_rows`` counts the group's rows.
    """
    rows = classes(docs, doc_id, text)
    labels = lookup(linked_classes(docs, rows, doc_id, text))
    named = rows.join(labels, rows["class"] == labels["node"], "left").select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("label", "class").alias("class"))
    groups = cut_lineage(
        named.where("class is not null").groupBy("class")
        .agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1"))
    groups = lookup(groups)
    return named.join(groups, "class", "left").select(
        "doc_id", "text_hash", "n_shingles", "class",
        F.when(F.col("n_rows").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_rows", F.lit(1)).alias("n_rows"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with one of each group: the one with the smallest doc_id, null last, then text hash.

    Rows equal in doc_id and text are one; texts without words all stay.
    """
    linked = cut_lineage(link(docs, doc_id, text))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    groups = linked.where("class is not null").groupBy("class")
    first = groups.agg(F.min(order).alias("row"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = cut_lineage(
        linked.where("n_rows > 1").join(first, "class")
        .where(~order.eqNullSafe(F.col("row"))).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct())
    gone = lookup(gone)
    here = docs.withColumn("_here", F.xxhash64(text))
    kept = here.join(gone, F.col(doc_id).eqNullSafe(F.col("_doc")) & (F.col("_here") == F.col("_hash")), "left_anti")
    worded = linked.where("class is not null")
    if worded.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        bare = linked.where("class is null").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
        same = F.col(doc_id).eqNullSafe(F.col("_d")) & (F.col("_here") == F.col("_t"))
        kept = kept.join(bare, same, "left_anti").dropDuplicates([doc_id, "_here"]).unionByName(kept.join(bare, same, "left_semi"))
    return kept.select(*docs.columns)
