"""Jaccard join of word n-gram sets by token-combination prefixes.

After Wang et al., Local Similarity Search for Unstructured Text (SIGMOD 2016). A token is an n-gram. Tokens are ordered
rare before frequent. In a set of n tokens at most n - ceil(t n) can be missing from a similar set, so any prefix with
more tokens than that has a token in common with it. Frequent tokens are split into classes, and of a
class only pairs are indexed; a class with m tokens in the prefix then counts m - 1, so the prefix is extended until the
counts exceed what may be missing. Rare tokens are indexed singly. Sets that share an index entry are verified exactly.

Tokens that occur in one set only are counted as missing and dropped, which also drops every set with too many of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, documents, partitions, settled, star_links
from .hashing import by_part, lists, mixed, planes, runs, text_groups, unplanes, windows, words
from .registry import query

WIDTH, PERCENT = 4, 85
#: A token in more sets than this, or oftener than LOCAL in one batch of texts, is frequent.
FREQUENT, LOCAL = 16, 8
#: Classes of frequent tokens. Sets under SMALL tokens may have too few to make a pair in any, so they are indexed singly.
CLASSES = 16
#: Bits of a set's sketch, in numbers of 64.
SKETCH = 8
# A token is 56 bits of its hash; the bit below tells frequent ones.
_TOKEN, _FREQUENT, _CUT = np.uint64(2**64 - 2**8), np.uint64(1), np.uint64(8)


def tokens_of(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, token) of the distinct n-grams of each text, sorted; a text of fewer words is one token."""
    texts, hashes = words(data, offsets, fold=True)
    at, found = windows(texts, hashes, width)
    owner = texts[at]
    counts = np.bincount(texts, minlength=len(offsets) - 1)
    for short in range(1, width):
        some = np.flatnonzero(counts == short)
        if len(some):
            first = np.searchsorted(texts, some)
            whole = np.zeros(len(some), np.uint64)
            for k in range(short):
                whole = mixed(whole + hashes[first + k] + np.uint64(short))
            owner, found = np.append(owner, some), np.append(found, whole)
    found = found & _TOKEN
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    return owner[keep], found[keep]


def keys_of(group: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Row keys from the hash of a batch of rows and the places in it: they need not be sent along."""
    return mixed(group + places.astype(np.uint64)).view(np.int64)


def sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, doc_id, n, d1, d2, carrier, tokens) for every row of ``docs`` (doc_id, text).

    n is the number of distinct tokens, d1 and d2 their 128-bit digest. Of equal sets in a batch one row with a doc_id is the carrier; its
    ``tokens`` are those that other carriers share, with the lowest bit set if frequent. Rows are told apart by ``key``, which follows from the rows hashed together.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("key"))
    schema = "part int, key long, doc_id long, n long, d1 long, d2 long, carrier boolean, body binary"

    def emit(part, key, doc_id, n, d1, d2, carrier, body):
        return pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(key, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(d1, pa.int64()),
             pa.array(d2, pa.int64()), pa.array(carrier, pa.bool_()), pa.array(body, pa.binary())],
            ["part", "key", "doc_id", "n", "d1", "d2", "carrier", "body"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_groups(batch.column(1)):
                size = end - start
                seen = batch.column(2).slice(start, size).to_numpy().view(np.uint64)
                group = mixed(np.sum(mixed(seen + np.arange(size, dtype=np.uint64)), keepdims=True))
                keys = keys_of(group, np.arange(size))
                owner, token = tokens_of(data, offsets, width)
                n = np.bincount(owner, minlength=size)
                digests = []
                for salt in (np.uint64(1), np.uint64(0x5851F42D4C957F2D)):
                    sums = np.zeros(len(token) + 1, np.uint64)
                    np.cumsum(mixed(token ^ salt), out=sums[1:])
                    ends = np.cumsum(n)
                    digests.append((sums[ends] - sums[ends - n]).view(np.int64))
                named = np.rec.fromarrays([*digests, n])
                carrier = np.zeros(size, bool)
                able = np.flatnonzero((n > 0) & batch.column(0).slice(start, size).is_valid().to_numpy(zero_copy_only=False))
                carrier[able[np.unique(named[able], return_index=True)[1]]] = True
                live = carrier[owner]
                owner, token = owner[live], token[live]
                order = np.argsort(token, kind="stable")
                run, first, length = runs(token[order])
                hot = length > LOCAL
                is_hot = hot[run]
                hot_owner, hot_token = owner[order][is_hot], token[order][is_hot] | _FREQUENT
                back = np.argsort(hot_owner, kind="stable")
                hot_owner, hot_token = hot_owner[back], hot_token[back]
                edges = np.searchsorted(hot_owner, np.arange(size + 1))
                yield emit(
                    np.abs(keys) % parts, keys, batch.column(0).slice(start, size), n, *digests, carrier,
                    [hot_token[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])],
                )
                keep = ~is_hot
                keep[first[hot]] = True
                sent, flag = token[order][keep], is_hot[keep]
                who = np.where(flag, 0, owner[order][keep] + 1).astype(np.uint32)
                part = ((sent >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                rows = []
                for p, at in by_part(part, parts):
                    head = np.array([len(at)], np.uint64).tobytes() + group.tobytes()
                    rows.append((p, head + planes(sent[at] >> _CUT) + planes(who[at])))
                nothing = [None] * len(rows)
                yield emit([r[0] for r in rows], nothing, nothing, nothing, nothing, nothing, nothing, [r[1] for r in rows])

    result = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("carrier", pa.bool_()), ("tokens", pa.list_(pa.int64()))])

    def count(table: pa.Table) -> pa.Table:
        """The tokens of one part of the range: those of a single entry are dropped, the others go back to their sets."""
        own = table.filter(table["key"].is_valid())
        bodies = [np.frombuffer(b, np.int64) for b in own["body"].to_pylist()]
        kept = pa.table([*[own[c] for c in ("key", "doc_id", "n", "d1", "d2", "carrier")], lists(np.concatenate(bodies) if bodies else [], [len(b) for b in bodies], pa.int64())], schema=result)
        tokens, flags, keys = [], [], []
        for body in table.filter(table["key"].is_null())["body"].to_pylist():
            head = np.frombuffer(body, np.uint64, 2)
            count = int(head[0])
            tokens.append(unplanes(body[16 : 16 + 8 * count], "u8") << _CUT)
            who = unplanes(body[16 + 8 * count :], "u4")
            keys.append(keys_of(head[1:], who.astype(np.int64) - 1))
            flags.append(who == 0)
        if not tokens:
            return kept
        token, key, flag = np.concatenate(tokens), np.concatenate(keys), np.concatenate(flags)
        order = np.argsort(token, kind="stable")
        token, key, flag = token[order], key[order], flag[order]
        run, first, length = runs(token)
        frequent = (length > FREQUENT) | np.logical_or.reduceat(flag, first)
        back = ((length > 1) | frequent)[run] & ~flag
        token, key = (token | frequent[run].astype(np.uint64))[back].view(np.int64), key[back]
        order = np.argsort(key, kind="stable")
        run, first, length = runs(key[order])
        if not len(first):
            return kept
        none = pa.nulls(len(first), pa.int64())
        more = pa.table([pa.array(key[order][first]), none, none, none, none, pa.nulls(len(first), pa.bool_()), lists(token[order], length, pa.int64())], schema=result)
        return pa.concat_tables([kept, more])

    ddl = "key long, doc_id long, n long, d1 long, d2 long, carrier boolean, tokens array<long>"
    counted = source.mapInArrow(scan, schema).groupBy("part").applyInArrow(count, ddl)
    own = settled(counted)
    rows = own.filter(F.col("n").isNotNull())
    shared = own.filter(F.size("tokens") > 0).groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("shared"))
    return rows.drop("tokens").join(shared, "key", "left").withColumnRenamed("shared", "tokens")


def least_shared(n, percent: int):
    return -(-percent * n // 100)


def signatures(tokens: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The index entries of one set of n tokens, of which ``tokens`` are shared with others."""
    spare = n - least_shared(n, percent) - (n - len(tokens))  # tokens that may still be missing
    frequent = (tokens & _FREQUENT).astype(bool)
    name = mixed(tokens)
    order = np.lexsort((name, frequent))
    name, frequent = name[order], frequent[order]
    small = least_small(percent)
    found = []
    if least_shared(small[0], percent) > least_shared(n, percent) or n <= small[1]:
        found.append(mixed(name[: spare + 1] ^ np.uint64(0xA5)))
    if n >= small[0]:
        rare = int((~frequent).sum())
        found.append(mixed(name[: min(rare, spare + 1)] ^ np.uint64(0x17)))
        if rare <= spare:
            need, classes = spare + 1 - rare, {}
            for value in name[rare:].tolist():
                held = classes.setdefault(value % CLASSES, [])
                need -= bool(held)
                held.append(value)
                if need == 0:
                    break
            for held in classes.values():
                held = np.array(held, np.uint64)
                a, b = np.triu_indices(len(held), 1)
                low, high = np.minimum(held[a], held[b]), np.maximum(held[a], held[b])
                found.append(mixed(mixed(low) + high))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def least_small(percent: int) -> tuple[int, int]:
    """Sets from the first size on always have enough tokens for the classes; only sets up to the second are similar to smaller ones."""
    n = 1
    while least_shared(n, percent) <= CLASSES:
        n += 1
    return n, 100 * n // percent


def index(found: DataFrame, percent: int) -> DataFrame:
    """(sig, sid, n) of sets (sid, n, tokens); ``n`` becomes the number of all and of shared tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            values, edges = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            sids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            made = [signatures(values[a:b], int(n), percent) for a, b, n in zip(edges[:-1], edges[1:], sizes)]
            count = [len(m) for m in made]
            all_made = np.concatenate(made).view(np.int64) if made else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(all_made), pa.array(np.repeat(sids, count)), pa.array(np.repeat(sizes, count)), pa.array(np.repeat(np.diff(edges).astype(np.int64), count))], ["sig", "sid", "n", "shared"])

    made = found.select("sid", "n", "tokens").mapInArrow(run, "sig long, sid long, n long, shared long")
    return made.select("sig", "sid", F.struct(F.col("n").alias("all"), "shared").alias("n"))


def verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Tokens no other set has cannot be common, so the shared ones suffice."""
    left = found.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = found.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return both.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def near(percent: int):
    """Whether two sets of ``n`` and ``m`` (all, shared) tokens can be similar: only shared tokens can be common to both."""
    common, total = F.least("n.shared", "m.shared"), F.col("n.all") + F.col("m.all")
    return 100 * common >= percent * (total - common)


def sketches(found: DataFrame) -> DataFrame:
    """(sid, n) of sets (sid, n, tokens): ``n`` becomes the number of all and of shared tokens and a sketch, a bit for each of 64 * SKETCH classes of tokens that is set if the set has an odd number of them."""
    names = [f"w{k}" for k in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                size, tokens = batch.num_rows, batch.column(2).flatten().to_numpy().view(np.uint64)
                lengths = pc.list_value_length(batch.column(2)).to_numpy()
                place = np.repeat(np.arange(size), lengths) * 64 * SKETCH + (mixed(tokens & _TOKEN) % np.uint64(64 * SKETCH)).astype(np.int64)
                odd = (np.bincount(place, minlength=size * 64 * SKETCH) & 1).astype(np.uint8).reshape(size, -1)
                bits = np.packbits(odd, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths.astype(np.int64)), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(SKETCH)]], ["sid", "all", "shared", *names])

    made = found.select("sid", "n", "tokens").mapInArrow(run, "sid long, `all` long, shared long, " + ", ".join(f"{w} long" for w in names))
    return made.select("sid", F.struct("all", "shared", *names).alias("n"))


def close(percent: int):
    """Whether two sets of ``sketches`` can be similar: they differ in as many tokens as bits at least. No similar pair is lost."""
    bits = sum((F.bit_count(F.col(f"n.w{k}").bitwiseXOR(F.col(f"m.w{k}"))) for k in range(SKETCH)), F.lit(0))
    common = F.col("n.shared") + F.col("m.shared") - bits  # twice the common tokens, at most
    return (100 + percent) * common >= 2 * percent * (F.col("n.all") + F.col("m.all"))


def links(found: DataFrame, percent: int) -> DataFrame:
    """Verified pairs of sets (sid, n, tokens) that connect all similar ones. A set with too few shared tokens is out."""
    alive = settled(found.filter((F.size("tokens") > 0) & (100 * F.size("tokens") >= percent * F.col("n"))))
    entries = index(alive, percent)
    shared = entries.groupBy("sig").agg(F.count("*").alias("members")).filter("members > 1").select("sig")
    entries = settled(entries.join(shared, "sig"))
    return star_links(entries, lambda pairs: verified(pairs, alive, percent), near(percent), sketches=sketches(alive), close=close(percent))


def joined(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Sets are compared as 64-bit hashes of their n-grams, of words split at ASCII white space with A-Z lower-cased. Null and empty texts
    have the empty set and link with nothing; equal sets always link. Rows of one doc_id are one document. A null doc_id
    gets a null component and is nobody's neighbour.
    """
    rows = settled(sets(docs, width))
    known = rows.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    same = known.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("sid"))
    carried = known.filter("carrier").groupBy("d1", "d2", "n").agg(F.min("key").alias("key"))
    found = carried.join(rows.select("key", "tokens").distinct(), "key").join(same, ["d1", "d2", "n"]).select("sid", "n", "tokens")
    same_id = known.join(same, ["d1", "d2", "n"]).filter("doc_id <> sid").select(F.col("doc_id").alias("a"), F.col("sid").alias("b"))
    labels = components(links(found, percent).union(same_id))
    placed = rows.select("doc_id", F.col("n").alias("n_shingles")).join(labels, F.col("doc_id") == F.col("node"), "left")
    return placed.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id is the least of its component or null."""
    spare = joined(docs, width, percent).filter("component_id <> doc_id").select(F.col("doc_id").alias("_spare")).distinct()
    return docs.join(spare, docs["doc_id"] == spare["_spare"], "left_anti")


@query("op3_ngram_jaccard_join")
def op3(spark, sf_dir):
    return joined(documents(spark, sf_dir))
