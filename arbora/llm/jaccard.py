"""N-gram Jaccard join by parity sketches.

A text's set is its distinct five-word shingles as 64-bit hashes.  Its parity
sketch has a bit for each residue of the hashes, flipped by each shingle, so
the Hamming distance of two sketches is at most the size of the symmetric
difference; that distance refutes candidates without their sets.

Candidates come from a pigeonhole join.  Sets of sizes a and b with a Jaccard
index of at least 0.8 differ in at most d = (a + b) / 9 shingles.  Within a
size band the hash range is cut into chunks, and a chunk's key is the XOR of
its shingles' hashes.  A differing shingle spoils one chunk of each set, so
among the first d + 1 chunks of both, in an order that depends on contents
only (fullest first), one is equal.  Bands are powers of two with a band of its
own for pairs over each boundary.  A set with too few filled chunks also emits
its empty ones, which keeps the guarantee.

The join's work is bounded whatever the groups are.  Each task first joins its
own rows by key and forwards one of them, its hub; the keys themselves travel
as packed arrays.  Equal sets are one class with one representative, and only
representatives are compared.  Those of a key are compared with the key's hub
(one of eight hashings of the ids, by key), survivors of the sketch test are
verified on their texts, and linked texts become components.

Representatives in keys that still hold several components go through a second
pigeonhole among themselves alone.  There each set takes its d + 1 cheapest chunk keys instead of its fullest, by
how many pairs of different components a key has, an order that is the same
for all sets, so two linked sets still share one.  Keys that only one component
has cost nothing: a text that shares much with a large group, but not enough,
has chunks of its own and does not meet the group at all.

Defined cases: a text with fewer words than five is one shingle of the whole;
a null, empty or blank text has an empty set and no link; a null id never
links; rows that repeat an id are kept, and the id's links are those of all its
rows; very long texts are taken whole; ties for a class's or component's id go
to the smallest; extra columns, of whatever names, stay in ``representatives``
and are ignored otherwise; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm import components, storage, textkit

K = 5
#: Chunks for each shingle of the largest set of a band.
CHUNKS = 0.35
#: Keys that a task joins among themselves before it sends them on.
FLUSH = 1_500_000
#: Routes whose keys leave a task together.
ROUTES = 64
#: 64-bit words of the short sketch that goes with a key's rows.
WORDS = 8
#: Partners that are verified beside one copy of their hub's text.
BLOCK = 256

DOC, KEYS, PAIR, MEMBER = 0, 1, 2, 3
_SCHEMA = "route int, kind int, doc_id bigint, other bigint, n int, fp1 bigint, fp2 bigint, payload binary, sketch array<bigint>, words array<bigint>"
_U = np.uint64
_SALTS = np.array([textkit.mix_int(77 + k) for k in range(8)], _U)
_MASK = (1 << 64) - 1


def band(n: int) -> int:
    return n.bit_length() - 1


def tags(n: int) -> list[tuple[int, int, int]]:
    """For a set of n shingles: (tag, chunks, d) of its band and of the boundaries it is near."""
    j = band(n)
    top = (2 << j) - 1
    out = [(2 * j, max(8, int(CHUNKS * (2 << j)) + 1), (n + min(n * 5 // 4, top)) // 9)]
    for i in (j, j + 1):
        low = 1 << i  # the boundary between bands i - 1 and i
        if i and 5 * n >= 4 * low and n <= (low - 1) * 5 // 4:
            out.append((2 * i - 1, max(8, int(CHUNKS * 1.25 * low) + 1), (n + (n * 5 // 4 if n < low else low - 1)) // 9))
    return out


def _chunk_keys(shingles: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each tag of a set (ascending hashes): the tag, how many of its keys are needed, and all its keys."""
    high, scrambled = shingles >> _U(32), textkit.mix(shingles + _U(0x5851F42D4C957F2D))
    for tag, chunks, d in tags(len(shingles)):
        chunk = (high * _U(chunks)) >> _U(32)
        first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        count = np.diff(np.append(first, len(chunk)))
        own = chunk[first]
        salt = _U(textkit.mix_int(tag + 1))
        signature = textkit.mix((np.bitwise_xor.reduceat(scrambled, first) ^ salt) + own * _U(0x9E3779B97F4A7C15))
        # The fullest chunks have the smallest keys.
        keys = ((31 - np.minimum(count, 31)).astype(_U) << _U(59)) | (signature >> _U(5))
        if len(keys) <= d:
            empty = np.setdiff1d(np.arange(chunks, dtype=_U), own)
            keys = np.append(keys, (_U(31) << _U(59)) | (textkit.mix(empty + salt + _U(1)) >> _U(5)))
            d = len(keys)
        yield tag, min(d + 1, len(keys)), keys


def chunk_keys(shingles: np.ndarray) -> np.ndarray:
    """The keys that a set is joined by."""
    return np.concatenate([keys if need == len(keys) else np.partition(keys, need - 1)[:need] for _, need, keys in _chunk_keys(shingles)])


def parity_sketch(shingles: np.ndarray, bits: int = 0) -> bytes:
    """A parity bit for each residue: two to four bits for each shingle, 64 at least, or as many as are said."""
    bits = bits or max(64, 4 << band(len(shingles)))
    odd = np.bincount((shingles & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(one: Column, two: Column) -> Column:
    """Hamming distance of two sketches, at most the symmetric difference; one of twice the length is folded first."""
    bits = lambda x, y: F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    half = lambda x, at: F.slice(x, at, (F.size(x) / 2).cast("int"))
    folded = lambda x: F.zip_with(half(x, F.lit(1)), half(x, (F.size(x) / 2 + 1).cast("int")), lambda a, b: a.bitwiseXOR(b))
    both = F.when(F.size(one) == F.size(two), bits(one, two)).when(F.size(one) > F.size(two), bits(folded(one), two)).otherwise(bits(one, folded(two)))
    return F.aggregate(both, F.lit(0), lambda n, x: n + x)


def _join_by_key(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order entries by key and hub first; returns keys, ids, each entry's hub and whether it leads."""
    order = np.lexsort((textkit.mix(ids.view(_U) ^ _SALTS[(keys & _U(7)).astype(np.int64)]), keys))
    keys, ids = keys[order], ids[order]
    lead = np.ones(len(keys), bool)
    lead[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(lead)
    size = np.diff(np.append(first, len(keys)))
    return keys, ids, np.repeat(ids[first], size), lead


def _multiple(keys: np.ndarray) -> np.ndarray:
    """Whether each entry shares its key with another."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _rows(**columns) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values())
    types = (("route", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("other", pa.int64()), ("n", pa.int32()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("payload", pa.binary()), ("sketch", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays([pa.array(columns[k], kind) if k in columns else pa.nulls(n, kind) for k, kind in types], [k for k, _ in types])


def _pair_rows(ids: np.ndarray, hubs: np.ndarray) -> Iterator[pa.RecordBatch]:
    pairs = np.unique(np.stack([ids, hubs], 1)[ids != hubs], axis=0)
    if len(pairs):
        yield _rows(route=textkit.mix(pairs[:, 0].view(_U)).view(np.int64) % 1021, kind=np.full(len(pairs), PAIR), doc_id=pairs[:, 0], other=pairs[:, 1])


def _member_rows(ids: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(ids), 100_000):
        own, key = ids[a : a + 100_000], keys[a : a + 100_000].view(np.int64)
        yield _rows(route=textkit.mix(own.view(_U)).view(np.int64) % 1021, kind=np.full(len(own), MEMBER), doc_id=own, other=key)


def _flush(keys: list[np.ndarray], ids: list[np.ndarray], routes: int) -> Iterator[pa.RecordBatch]:
    """Join a task's keys among themselves, and send one row of each on."""
    key, doc = np.concatenate(keys), np.concatenate(ids)
    several = _multiple(key)
    k, d, hub, lead = _join_by_key(key[several], doc[several])
    yield from _pair_rows(d, hub)
    yield from _member_rows(d, k)
    key, doc = np.concatenate([key[~several], k[lead]]), np.concatenate([doc[~several], d[lead]])
    route = (key % _U(routes)).astype(np.int64)
    order = np.argsort(route, kind="stable")
    key, doc, route = key[order], doc[order], route[order]
    cut = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1], [True]]))
    low = int(doc.min())
    narrow = int(doc.max()) - low < 1 << 32
    packed = (doc - low).astype(np.uint32) if narrow else doc
    a = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    for k in range(0, len(a), ROUTES):
        own = a[k : k + ROUTES]
        yield _rows(route=[int(route[x]) for x, _ in own], kind=np.full(len(own), KEYS), other=np.full(len(own), low), n=[y - x for x, y in own], payload=[key[x:y].tobytes() + packed[x:y].tobytes() for x, y in own])


def _sketch(routes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        for batch in batches:
            doc_ids = batch.column(0)
            n, fp1, fp2, sketches, short = [], [], [], [], []
            number = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
            known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
            for a, _, _, _, _, _, hashes, at, _ in textkit.texts_in_runs(batch.column(1)):
                for k, s in enumerate(textkit.shingle_sets(hashes, at, K), a):
                    n.append(len(s))
                    fp1.append(int(s.sum()) & _MASK)
                    fp2.append(int(np.bitwise_xor.reduce(textkit.mix(s))) if len(s) else 0)
                    sketches.append(np.frombuffer(parity_sketch(s), np.int64) if len(s) else None)
                    short.append(np.frombuffer(parity_sketch(s, 64 * WORDS), np.int64))
                    if len(s) and known[k]:
                        keys.append(own := chunk_keys(s))
                        ids.append(np.full(len(own), number[k]))
                        held += len(own)
            as_long = lambda x: np.array(x, _U).view(np.int64)
            yield _rows(route=(np.arange(len(n)) * 2654435761 + int(number[0] if len(n) else 0)) % 1021, kind=np.full(len(n), DOC), doc_id=doc_ids, n=n, fp1=as_long(fp1), fp2=as_long(fp2), sketch=sketches, words=short)
            if held >= FLUSH:
                yield from _flush(keys, ids, routes)
                keys, ids, held = [], [], 0
        if held:
            yield from _flush(keys, ids, routes)
        batch, keys, ids = None, [], []
        textkit.release()

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join each route's keys; rows come ordered by route."""
    keys, ids, at = [], [], None

    def joined() -> Iterator[pa.RecordBatch]:
        key, doc = np.concatenate(keys), np.concatenate(ids)
        several = _multiple(key)
        k, d, hub, _ = _join_by_key(key[several], doc[several])
        yield from _pair_rows(d, hub)
        yield from _member_rows(d, k)

    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if len(rest := np.flatnonzero(kind != KEYS)):
            yield batch.take(pa.array(rest))
        for i in np.flatnonzero(kind == KEYS).tolist():
            route, low, n, payload = (batch.column(c)[i].as_py() for c in ("route", "other", "n", "payload"))
            if route != at and keys:
                yield from joined()
                keys, ids = [], []
            at = route
            keys.append(np.frombuffer(payload, _U, n))
            tail = payload[8 * n :]
            ids.append(np.frombuffer(tail, np.int64) if len(tail) == 8 * n else np.frombuffer(tail, np.uint32).astype(np.int64) + low)
    if keys:
        yield from joined()
    textkit.release()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * |a and b| >= 80 * |a or b| of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[place] == a).sum())
    return 100 * both >= 80 * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each hub's texts come first, then its partners': the linked pairs."""
    at, leads = None, []
    for batch in batches:
        hubs, slots, ids, lead = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hub", "slot", "id", "lead"))
        a, b = [], []
        for start, _, _, _, _, _, hashes, offsets, _ in textkit.texts_in_runs(batch.column("text")):
            for k, s in enumerate(textkit.shingle_sets(hashes, offsets, K), start):
                if (hubs[k], slots[k]) != at:
                    at, leads = (hubs[k], slots[k]), []
                if lead[k]:
                    leads.append(s)
                elif any(similar(s, x) for x in leads):
                    a.append(ids[k])
                    b.append(hubs[k])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _links(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b: a hub) of representatives that link, verified on their texts."""
    spark = docs.sparkSession
    side = lambda k, name: sets.select(F.col("rep").alias(name), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    both = pairs.join(side(1, "a"), "a").join(side(2, "b"), "b").where("5 * n1 >= 4 * n2 and 5 * n2 >= 4 * n1")
    left, left_path = storage.materialize(both.where(9 * sketch_distance(F.col("s1"), F.col("s2")) <= F.col("n1") + F.col("n2")).select("a", "b").distinct(), "candidates")
    blocks = left.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).select(F.expr("b ^ 0L").alias("hub"), "blocks")
    placed = left.join(blocks, F.col("b") == F.col("hub")).select("a", "hub", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("slot"))
    need = placed.select(F.col("a").alias("id"), "hub", "slot", F.lit(False).alias("lead")).union(placed.select(F.col("hub").alias("id"), "hub", "slot", F.lit(True).alias("lead")).distinct())
    wanted = storage.marked(docs, "doc_id", left.select("a").union(left.select("b")), "wanted").where("wanted")
    texts = wanted.join(need.hint("shuffle_hash"), F.col("doc_id") == F.col("id")).select("hub", "slot", "id", "lead", "text")
    ordered = texts.repartition("hub", "slot").sortWithinPartitions("hub", "slot", F.desc("lead"))
    links, _ = storage.materialize(ordered.mapInArrow(_verify, "a bigint, b bigint"), "links")
    storage.drop(spark, left_path)
    return links


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _placed(rows: DataFrame, rooted: DataFrame) -> DataFrame:
    """``rows`` (with a column ``rep``) with the root of each representative's component."""
    return rows.join(rooted, F.col("rep") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "rep"))


def _costs(placed: DataFrame) -> DataFrame:
    """k, main, cost: of each key the largest component, and its pairs of rows of different ones."""
    counts = placed.groupBy("key", "root").agg(F.count("*").alias("n_root"))
    square = F.col("n_root").cast("double") * F.col("n_root")
    keys = counts.groupBy("key").agg(F.sum("n_root").cast("double").alias("all"), F.sum(square).alias("inside"), F.max(F.struct("n_root", "root"))["root"].alias("main"))
    return keys.select(F.expr("key ^ 0L").alias("k"), "main", (F.col("all") * F.col("all") - F.col("inside")).alias("cost")).where("cost > 0")


def _all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, n, tag, need, key: all keys of every text's set, and how many of a tag's are needed."""
    for batch in batches:
        reps = batch.column(0).to_numpy()
        for a, _, _, _, _, _, hashes, at, _ in textkit.texts_in_runs(batch.column(1)):
            for k, s in enumerate(textkit.shingle_sets(hashes, at, K), a):
                for tag, need, keys in _chunk_keys(s) if len(s) else ():
                    full = lambda x, kind: pa.array(np.full(len(keys), x), kind)  # noqa: B023, E731
                    columns = [full(reps[k], pa.int64()), full(len(s), pa.int32()), full(tag, pa.int32()), full(need, pa.int32()), pa.array(keys.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["rep", "n", "tag", "need", "key"])
    textkit.release()


def _across(reps: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of representatives (rep, root) of different components that a second pigeonhole, sizes and short sketches leave.

    One of a pair is outside its key's main component; within the main component nothing is compared.
    """
    spark = docs.sparkSession
    wanted = storage.marked(docs, "doc_id", reps.select("rep"), "wanted").where("wanted")
    texts = wanted.join(reps.select(F.col("rep").alias("id")), F.col("doc_id") == F.col("id")).select("id", "text")
    keys, keys_path = storage.materialize(texts.mapInArrow(_all_keys, "rep bigint, n int, tag int, need int, key bigint").join(reps, "rep"), "keys")
    ranked = keys.join(_costs(keys), F.col("key") == F.col("k"), "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    cheapest = Window.partitionBy("rep", "n", "tag").orderBy("cost", "key")
    kept = ranked.withColumn("place", F.row_number().over(cheapest)).where("place <= need and cost > 0").select("key", "rep", "root", "n", "main")
    short = sets.select(F.col("rep").alias("of"), F.col("n").alias("size"), "words")
    kept, kept_path = storage.materialize(kept.join(short, (F.col("rep") == F.col("of")) & (F.col("n") == F.col("size"))).drop("of", "size"), "kept")
    side = lambda k, at: at.select("key", F.col("rep").alias(f"i{k}"), F.col("root").alias(f"r{k}"), F.col("n").alias(f"n{k}"), F.col("words").alias(f"w{k}"), (F.col("root") == F.col("main")).alias(f"m{k}"))
    distance = " + ".join(f"bit_count(w1[{i}] ^ w2[{i}])" for i in range(WORDS))
    both = side(1, kept.where("root <> main")).join(side(2, kept), "key")
    both = both.where("r1 <> r2 and (m2 or i1 < i2)").where(f"5 * n1 >= 4 * n2 and 5 * n2 >= 4 * n1 and 9 * ({distance}) <= n1 + n2")
    pairs, _ = storage.materialize(both.select(F.col("i1").alias("a"), F.col("i2").alias("b")).distinct(), "pairs")
    storage.drop(spark, keys_path)
    storage.drop(spark, kept_path)
    return pairs


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links), n_links.

    ``n_links`` counts the class's links to other classes that were verified on the way, and one more if the class
    has several rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routes = max(64, 8 * partitions)
    sketched = docs.mapInArrow(_sketch(routes), _SCHEMA)
    matched = sketched.repartition(partitions, "route").sortWithinPartitions("route").mapInArrow(_match, _SCHEMA)
    table, table_path = storage.materialize(matched, "sketches")

    # Equal sets are one class; its representative is its smallest id, and sketches follow from the set.
    found = table.where(F.col("kind") == DOC)
    classes = found.where("n > 0 and doc_id is not null").groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("words").alias("words"))
    classes, _ = storage.materialize(classes, "classes")
    sets = classes.select("rep", "n", "sketch", "words")
    of_set = classes.select(F.col("n").alias("size"), F.col("fp1").alias("f1"), F.col("fp2").alias("f2"), "rep", "copies")
    rows = found.select("doc_id", "n", "fp1", "fp2").join(of_set, (F.col("n") == F.col("size")) & (F.col("fp1") == F.col("f1")) & (F.col("fp2") == F.col("f2")), "left")
    info, _ = storage.materialize(rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"), "copies"), "rows")
    of = info.where("rep is not null").select(F.col("doc_id").alias("id"), "rep")

    pairs = table.where(F.col("kind") == PAIR).select(F.col("doc_id").alias("a"), F.col("other").alias("b"))
    pairs = pairs.join(of.withColumnRenamed("rep", "ra"), F.col("a") == F.col("id")).drop("id").join(of.withColumnRenamed("rep", "rb"), F.col("b") == F.col("id"))
    links = _links(pairs.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), sets, docs)
    # An id of several rows connects their classes.
    repeated = of.groupBy("id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most").select(F.col("id").alias("of"), "least")
    links = links.union(of.join(repeated, F.col("id") == F.col("of")).where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    # Two rounds bring nearly every group to one root; the last call below settles the rest.
    stars, stars_path = storage.materialize(components.components(links, rounds=2, settle=False), "stars")
    rooted = stars.groupBy("node").agg(F.min("root").alias("root"))

    # Representatives in keys where not all were compared, and not all have one root yet.
    node = _placed(of, rooted).select("id", "rep", "root")
    member = table.where(F.col("kind") == MEMBER).select(F.col("doc_id").alias("of"), F.col("other").alias("key"))
    member = member.join(node, F.col("of") == F.col("id")).select("key", "rep", "root").distinct()
    some = member.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 2 and low <> high").select(F.expr("key ^ 0L").alias("open_key"))
    reps, _ = storage.materialize(member.join(some, F.col("key") == F.col("open_key")).select("rep", "root").distinct(), "open")
    storage.drop(spark, table_path)
    wanted = _across(reps, sets, docs)
    more = _links(wanted, sets, docs)
    links = links.union(more)
    rooted = components.components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    storage.drop(spark, stars_path)

    every = _unordered(links).distinct()
    degree = every.select(F.col("a").alias("node")).union(every.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = rooted.join(degree, "node", "left")
    return info.join(linked, F.col("rep") == F.col("node"), "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("root", "rep", "doc_id").alias("component_id"),
        (F.coalesce("n_links", F.lit(0)) + F.when(F.col("copies") > 1, 1).otherwise(0)).alias("n_links"),
    )


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked texts, that of the smallest id; rows without a link or an id stay.

    Rows that repeat an id stay or go together.
    """
    groups = similar_groups(docs, key, text)
    gone, _ = storage.materialize(groups.where("component_id <> doc_id").select(F.col("doc_id").alias(storage.free_name(docs, "gone"))).distinct(), "copies")
    return docs.join(gone, F.col(key) == F.col(gone.columns[0]), "left_anti")
