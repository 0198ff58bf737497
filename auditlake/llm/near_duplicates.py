"""Near-duplicate texts: an exact Jaccard join by way of a token-group matrix.

1. Every text becomes its set of tokens, in one order over all tokens: rare ones first, by a count of hashed tokens
   over all texts. Texts with the same set are one class; only one of them goes on.
2. Classes are partitioned into groups of alike sets: those whose two smallest rare tokens, by hash, agree.
3. The matrix has a row per group: the union of its members' tokens, hashed to as many columns as the mean size of the
   sets asks for, with the sizes of its smallest and largest member. Its inverted side lists, per token, the groups
   that have it among the tokens a member must share.
4. A query is the larger set of a pair. It meets the groups that list one of its first tokens, and bounds its
   overlap with such a group by the columns that the group's row lacks. Only groups that may still hold a partner are
   opened, and only then are single sets compared.

No link is lost: of two sets that are alike enough, the larger one's first tokens and the smaller one's first
tokens, as many as the threshold allows to differ and one more, have one in common, whatever the order; and the
bound never falls below the true overlap. Grouping and the counts decide how much is opened, not what is found.
"""

from __future__ import annotations

import math
import re
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.session import shuffle_partitions

WORD = re.compile(r"[a-z0-9]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Hashed tokens are counted in 2**SKETCH_BITS numbers, whatever the corpus.
SKETCH_BITS = 22
#: Tokens that a larger share of the texts use are no rare ones, and don't decide a text's group.
COMMON_SHARE = 0.001
#: The matrix has this many columns, or the next power of two, per token of a mean set; 64 at least and 4096 at most.
COLUMNS_PER_TOKEN = 2
#: Groups are told by 40 bits: should two agree, they are one larger group.
GROUP_BITS = 40
#: Sizes in postings: larger ones than these are told as unlimited, and don't limit what is met.
SIZE_LIMIT, QUERY_LIMIT = (1 << 11) - 1, (1 << 23) - 1


def token_hashes(texts: list[str | None], cache: dict[str, int]) -> np.ndarray:
    """The 64-bit hashes of the different words of the texts together, sorted."""
    words = set(WORD.findall(" ".join(t for t in texts if t).lower()))
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = cache.get(w)
        if h is None:
            if len(cache) > 500_000:
                cache.clear()
            h = cache[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    out.sort()
    return out


def _batches(batches: Iterator[pa.RecordBatch], texts: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    cache: dict[str, int] = {}
    for b in batches:
        columns = [b.column(b.num_columns - texts + k).to_pylist() for k in range(texts)]
        yield b, [token_hashes(list(row), cache) for row in zip(*columns)]


def token_counts(df: DataFrame, texts: list[str]) -> tuple[np.ndarray, int, int]:
    """How many rows have each hashed token: 2**SKETCH_BITS numbers of one byte, 0 to 15 exactly, then 16 per doubling;
    with them the rows that have a token, and the tokens of their sets in all.

    A task counts its rows first and sends its numbers in parts of 1024, of each the places and counts that aren't 0;
    the parts are added up as they come. What reaches the driver are the numbers themselves, 4 MB whatever the corpus.
    """
    part = 1 << 10
    sums_at = (1 << SKETCH_BITS) // part  # the part of rows and tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        rows = tokens = 0
        for _, sets in _batches(batches, len(texts)):
            if sets:
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
                rows, tokens = rows + sum(len(h) > 0 for h in sets), tokens + sum(map(len, sets))
        chunks, lows, counts = [sums_at], [np.arange(2, dtype="<u2").tobytes()], [np.array([rows, tokens], "<i8").tobytes()]
        for k in range(sums_at):
            n = total[k * part : (k + 1) * part]
            at = np.flatnonzero(n)
            if len(at):
                chunks.append(k)
                lows.append(at.astype("<u2").tobytes())
                counts.append(n[at].astype(np.uint8 if n.max() < 256 else "<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(lows, pa.binary()), pa.array(counts, pa.binary())], ["chunk", "lows", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, lows, counts in zip(*(c.to_pylist() for c in b.columns)):
                at = np.frombuffer(lows, "<u2")
                sums.setdefault(k, np.zeros(part, np.int64))[at] += np.frombuffer(counts, np.uint8 if len(counts) == len(at) else "<i8")
        made = [n[:2].astype("<i8").tobytes() if k == sums_at else coarse(n).tobytes() for k, n in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(made, pa.binary())], ["chunk", "counts"])

    parts = df.select(*texts).mapInArrow(run, "chunk int, lows binary, counts binary").repartition("chunk")
    out, rows, tokens = np.ones(1 << SKETCH_BITS, np.uint8), 0, 0
    for r in parts.mapInArrow(add, "chunk int, counts binary").collect():
        if r.chunk == sums_at:
            rows, tokens = map(int, np.frombuffer(r.counts, "<i8"))
        else:
            out[r.chunk * part : (r.chunk + 1) * part] = np.frombuffer(r.counts, np.uint8)
    return out, rows, tokens


def coarse(n: np.ndarray) -> np.ndarray:
    n = np.maximum(np.asarray(n, np.float64), 1)
    return np.where(n < 16, n, np.minimum(255, 16 + np.floor(4 * (np.log2(n) - 4)))).astype(np.uint8)


def first_tokens(size: Column, t: float) -> Column:
    """How many first tokens of a set, as the larger one of a pair, must meet the other's."""
    return size - F.ceil(size * t - 1e-9) + 1


def listed_tokens(size: Column, t: float) -> Column:
    """The same for the smaller one of a pair."""
    return size - F.ceil(size * (2 * t / (1 + t)) - 1e-9) + 1


def matrix_words(rows: int, tokens: int) -> int:
    """How many numbers of 64 columns a row of the matrix takes."""
    mean = max(1, tokens / rows) if rows else 1
    return min(64, 1 << max(0, math.ceil(math.log2(COLUMNS_PER_TOKEN * mean / 64))))


def classes(df: DataFrame, row_id: str, texts: list[str], counts: np.ndarray, n_rows: int, words: int, carry: list[str]) -> DataFrame:
    """Every row with a token as a member of its class: `sig`, the id and the carried columns, each once. And every class
    once, with `tokens` and without an id: its group `grp`, its size, its columns `m0`, `m1` and so on, and `alone`, how many
    tokens at the start no other row has. Members are spread by their id, classes by their group.

    Tokens are packed in order, 6 bytes each: the chance that two different tokens of a pair agree in all 48 bits is
    about 1 in 10**11. Rows without any token are left out: they are alike to nothing. Of the copies that a task
    reads only the first sends the class on.
    """
    sketch = df.sparkSession.sparkContext.broadcast(counts)  # 4 MB, whatever the corpus
    common = int(coarse(np.array([max(16.0, COMMON_SHARE * n_rows)]))[0])
    own = [f for f in df.select(row_id, *carry).schema.fields]
    columns = [f"m{k}" for k in range(words)]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = "grp bigint, sig bigint, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", size int, alone int, " + ", ".join(f"{c} bigint" for c in columns) + ", tokens binary"
    target = to_arrow_schema(StructType.fromDDL(schema))
    as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sketch.value
        seen: set[int] = set()
        for b, sets in _batches(batches, len(texts)):
            keep, sigs, sig, group, alone, size, bits, tokens = [], [], [], [], [], [], [], []
            for i, h in enumerate(sets):
                if not len(h):
                    continue
                keep.append(i)
                sigs.append(s := xxhash.xxh3_64_intdigest(h.tobytes()))
                if s in seen:
                    continue
                seen.add(s)
                weight = count[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((h, weight))
                rare = h[weight < common]
                anchor = np.sort((rare if len(rare) >= 2 else h) * MIX)[:2]  # by another order than that of the sets
                at = ((h >> np.uint64(20)) % np.uint64(64 * words)).astype(np.int64)
                flags = np.zeros(64 * words, bool)
                flags[at] = True
                sig.append(s)
                group.append(xxhash.xxh3_64_intdigest(anchor.tobytes()) >> (64 - GROUP_BITS))
                alone.append(int((weight <= 1).sum()))
                size.append(len(h))
                bits.append(np.packbits(flags, bitorder="little").view("<i8"))
                tokens.append(h[order].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            ids = [b.column(1 + k).take(pa.array(keep, pa.int32())) for k in range(len(own))]
            n = len(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), as_long(sigs), *ids, *(pa.nulls(n, f.type) for f in list(target)[2 + len(own) :])], schema=target)
            n, table = len(sig), np.array(bits, np.int64).reshape(len(sig), words)
            yield pa.RecordBatch.from_arrays(
                [as_long(group), as_long(sig), *(pa.nulls(n, f.type) for f in list(target)[2 : 2 + len(own)]), pa.array(size, pa.int32()), pa.array(alone, pa.int32()), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(words)), pa.array(tokens, pa.binary())], schema=target,
            )

    names = [f.name for f in own]
    picked = df.select(F.xxhash64(row_id).alias("__h"), *names, *[F.col(t).alias(f"__t{k}") for k, t in enumerate(texts)])
    spread = picked.mapInArrow(run, schema).repartition(shuffle_partitions(df.sparkSession), "grp")
    return spread.dropDuplicates(["grp", "sig", *names])


def _exploded(df: DataFrame, keep: list[Column | str], count: Column) -> DataFrame:
    """One row per first token that another row may have: `at`, its place and above 32 bits a number for its 6 bytes.
    Two tokens of one number only make a group a candidate that its bound then has to refuse."""
    d = df.select("*", count.cast("int").alias("__n")).where("alone < __n")
    d = d.select(*keep, "tokens", F.explode(F.sequence("alone", F.col("__n") - 1)).alias("place"))
    return d.withColumn("at", _two(F.hash(F.expr("substring(tokens, place * 6 + 1, 6)")), F.col("place"))).drop("tokens", "place")


def _two(high: Column, low: Column, bits: int = 32) -> Column:
    """Two integers in one, the lower not negative: rows that move are as many as first tokens, so each byte counts."""
    return F.shiftleft(high.cast("bigint"), bits).bitwiseOR(low.cast("bigint"))


def _low(c: str | Column, bits: int = 32) -> Column:
    return (F.col(c) if isinstance(c, str) else c).bitwiseAND(F.lit((1 << bits) - 1))


def _high(c: str | Column, bits: int = 32) -> Column:
    return F.shiftright(c, bits)


def _at_most(size: Column, limit: int) -> Column:
    return F.least(size, F.lit(limit))


def need(a: Column, b: Column, t: float) -> Column:
    """How many tokens two sets of these sizes must share."""
    return F.ceil((a + b) * (t / (1 + t)) - 1e-9)


def met_groups(sets: DataFrame, t: float, words: int, bounded: bool = True) -> DataFrame:
    """(grp, size, g), spread by grp: the groups that a set of that group and size may have a partner in, by its tokens, its
    size and their places, and, if bounded, by the columns that the group's row of the matrix lacks. Sets of more than
    QUERY_LIMIT tokens have that size here."""
    columns = [f"m{k}" for k in range(words)]
    matrix = sets.groupBy("grp").agg(_two(_at_most(F.min("size"), SIZE_LIMIT), _at_most(F.max("size"), SIZE_LIMIT), 11).alias("sizes"), (F.count(F.lit(1)) > 1).cast("int").alias("several"), *[F.bit_or(c).alias(f"g{c}") for c in columns])
    listed = _exploded(sets, ["grp"], listed_tokens(F.col("size"), t)).select("grp", _high("at").alias("token"), _low("at").alias("place")).groupBy("grp", "token").agg(F.min("place").alias("place"))
    lists = listed.join(matrix, "grp").select(_two(F.col("grp"), _two(F.col("sizes"), F.col("several"), 1), 23).alias("to"), _two(F.col("token"), F.col("place")).alias("listed"), *[f"g{c}" for c in columns])
    queries = _exploded(sets, [_two(F.col("grp"), _at_most(F.col("size"), QUERY_LIMIT), 23).alias("of"), *columns], first_tokens(F.col("size"), t))
    size, small, large = _low("of", 23), _low(_high("to", 12), 11), _low(_high("to", 1), 11)
    least = need(size, F.greatest(small, F.ceil(size * t - 1e-9)), t)  # what a partner in the group must share at least
    fits = (large == SIZE_LIMIT) | ((large >= F.ceil(size * t - 1e-9)) & (large - _low("listed") >= least))
    may = (small <= size) & (size - _low("at") >= least) & fits
    if bounded:  # at least as many tokens does the group lack as its row lacks columns
        may = may & (size - sum((F.bit_count(F.col(c).bitwiseAND(F.bitwise_not(F.col(f"g{c}")))) for c in columns), F.lit(0)) >= least)
    other = (_high("of", 23) != _high("to", 23)) | (_low("to", 1) == 1)
    met = queries.join(lists, _high("at") == _high("listed")).where(((size == QUERY_LIMIT) | may) & other)
    found = met.select(_high("of", 23).alias("grp"), size.cast("int").alias("size"), _high("to", 23).alias("g"))
    return found.repartition(shuffle_partitions(sets.sparkSession), "grp").dropDuplicates(["grp", "size", "g"])


def alike_classes(sets: DataFrame, t: float, words: int) -> DataFrame:
    """(sig_a, sig_b, size_a, size_b, common) of different classes whose sets are alike to at least t.

    `sets` are the different classes, spread and kept by group. Tokens move once for each pair that sizes and columns
    leave, and nothing wider than its columns before.
    """
    columns = [f"m{k}" for k in range(words)]
    q = sets.select(F.col("grp").alias("grp_q"), F.col("sig").alias("sig_a"), F.col("size").alias("size_a"), *columns)
    s = sets.select(F.col("grp").alias("g_b"), F.col("sig").alias("sig_b"), F.col("size").alias("size_b"), *[F.col(c).alias(f"b{c}") for c in columns], F.col("tokens").alias("tokens_b"))
    # a difference of 0 is no equality that the planner would spread the kept sets anew for
    same = _at_most(F.col("size_a"), QUERY_LIMIT).bitwiseXOR(F.col("size")) == 0
    opened = met_groups(sets, t, words).join(q, (F.col("grp") == F.col("grp_q")) & same).select("grp", "sig_a", "size_a", *columns, "g")
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"b{c}"))) for c in columns), F.lit(0))
    smaller = (F.col("size_b") < F.col("size_a")) | ((F.col("size_b") == F.col("size_a")) & (F.col("sig_b") < F.col("sig_a")))
    alike = F.col("size_b") >= F.ceil(F.col("size_a") * t - 1e-9)
    close = F.col("size_a") + F.col("size_b") - differ >= 2 * need(F.col("size_a"), F.col("size_b"), t)
    pairs = opened.join(s, F.col("g") == F.col("g_b")).where(smaller & alike & close).select("grp", "sig_a", "sig_b", "size_a", "size_b", "tokens_b")
    a = sets.select(F.col("grp").alias("grp_a"), "sig", F.col("tokens").alias("tokens_a"))
    both = pairs.join(a, (F.col("grp") == F.col("grp_a")) & (F.col("sig_a").bitwiseXOR(F.col("sig")) == 0))
    return _compare(both.select("sig_a", "sig_b", "size_a", "size_b", "tokens_a", "tokens_b"), t)


def _compare(pairs: DataFrame, t: float) -> DataFrame:
    """The pairs that are alike, by their token sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unpack = lambda x: {x[k : k + 6] for k in range(0, len(x), 6)}
            common, last, mine = [], None, set()
            for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                if x != last:
                    last, mine = x, unpack(x)
                common.append(sum(y[k : k + 6] in mine for k in range(0, len(y), 6)))
            n = np.array(common, np.int64)
            either = b.column(2).to_numpy() + b.column(3).to_numpy() - n
            keep = np.flatnonzero(n * 1_000_000 >= round(t * 1_000_000) * either)
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(4)), pa.array(n[keep].astype(np.int32))], ["sig_a", "sig_b", "size_a", "size_b", "common"])

    return pairs.mapInArrow(run, "sig_a bigint, sig_b bigint, size_a int, size_b int, common int")


def near_duplicates(df: DataFrame, row_id: str, texts: list[str], t: float, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of classes, members, kept): the classes of equal token sets that are alike to at least t, as in
    `alike_classes`; (sig, row id, carried columns) of every row with a token, each once; and the cached table that both
    read, to be released with `release_with` or by hand.

    Words are the runs of a-z and 0-9 of all the text columns together, in lower case, each once; nulls count as
    empty. Rows without a word are members of nothing. A row sent again, with the same id and texts, is one member.
    A class stands for all its copies, so that however many they are no pair of copies is looked at.
    """
    carry = carry or []
    counts, rows, tokens = token_counts(df, texts)
    words = matrix_words(rows, tokens)
    own = [row_id, *carry]  # under names of our own until the end
    named = df.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(own)], *texts)
    kept = classes(named, "__0", texts, counts, rows, words, [f"__{i}" for i in range(1, len(own))]).persist(StorageLevel.MEMORY_AND_DISK)
    members = kept.where("tokens IS NULL").select("sig", *[f"__{i}" for i in range(len(own))]).toDF("sig", *own)
    sets = kept.where("tokens IS NOT NULL").drop(*[f"__{i}" for i in range(len(own))])
    return alike_classes(sets, t, words), members, kept


def release_with(result: DataFrame, kept: DataFrame) -> DataFrame:
    """The result; when nobody holds it any more, the cached table is released. A result made of it is still right."""

    def release() -> None:
        try:
            kept.unpersist()
        except Exception:  # the session may be gone by then
            pass

    weakref.finalize(result, release).atexit = False
    return result


def member_pairs(pairs: DataFrame, members: DataFrame, row_id: str, kind: str) -> DataFrame:
    """(a, b), the smaller first: all pairs of members of one class and of alike classes whose kinds agree or are
    unknown, as many as there are. Where groups of copies are large, classes and their pairs say the same in fewer rows."""
    m = members.select("sig", F.col(row_id).alias("id"), F.col(kind).alias("kind"))
    several = m.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    links = pairs.select("sig_a", "sig_b").unionByName(several.select(F.col("sig").alias("sig_a"), F.col("sig").alias("sig_b")))
    end = lambda x: m.select(F.col("sig").alias(f"sig_{x}"), F.col("id").alias(x), F.col("kind").alias(f"kind_{x}"))
    agree = F.col("kind_a").isNull() | F.col("kind_b").isNull() | (F.col("kind_a") == F.col("kind_b"))
    once = (F.col("a") < F.col("b")) | ((F.col("sig_a") != F.col("sig_b")) & (F.col("a") != F.col("b")))
    found = links.join(end("a"), "sig_a").join(end("b"), "sig_b").where(agree & once)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
