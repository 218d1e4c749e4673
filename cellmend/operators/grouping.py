"""Feature vectors, leaf orders, windows and blocks, schedules and samples of cells and queries."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmend.functions.scalars import plain_text
from cellmend.session import BROADCAST_ROWS, Stages, broadcast_if_small, shuffle_width

#: columns that at least one row in so many has are laid out as numbers in a leaf order
LAID_OUT = 16
#: numbers that a leaf order holds at once to find the nearest of some clusters
BLOCK = 1_000_000
#: searches a merge, on average, up to which clusters are searched together
SEARCHES = 16
#: columns are rare that at most one cluster in so many has
RARE = 64
#: clusters from which rare columns are used, and how many that share none, and in all, are compared with one at most
LEAST, BESIDES, COMPARED = 12_000, 64, 512


def exact_windows(order: Column, k: int) -> Column:
    """Windows of k over an ordered array, half a window apart, the last one at the very end; short arrays give none."""
    stride, n = max(1, k // 2), F.size(order)
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), n - k, F.lit(stride)), F.array(n - k)))
    return F.when(n >= k, F.transform(starts, lambda s: F.slice(order, s + 1, k))).otherwise(F.array().cast("array<array<string>>"))


def numbered(spark: SparkSession, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with dense numbers from 0 in the order of columns.

    Rows are spread by ranges of the order and numbered where they lie, so that no task sorts more than its part.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = Stages(spark, "numbers").keep(placed)  # numbers are given once
    part, low = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition
    offsets = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = offsets.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + low).drop("_part", "_at", "_offset")


def ranks(spark: SparkSession, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with `rank` (from 1) and `members` of their key.

    A key's rank is the distance to its first number. So a key with a third of all rows is ranked in as many
    tasks as its rows fill, where a window would sort it in one.
    """
    placed = numbered(spark, rows, [*keys, *order], "_i")
    first = Stages(spark, "ranks").keep(placed.groupBy(*keys).agg(F.min("_i").alias("_first"), F.count("*").alias("members")))
    same = [placed[k].eqNullSafe(first[k]) for k in keys]
    return placed.join(first, same).select(*(placed[c] for c in rows.columns), (F.col("_i") - F.col("_first") + 1).alias("rank"), "members")


def exact_blocks(spark: SparkSession, ordered: DataFrame, keys: list[str], order: list[str], k: int, least: int = 3) -> DataFrame:
    """Adds block 0, 1, ... of k rows in order; incomplete blocks, and keys with fewer than `least` blocks, are left out."""
    x = ranks(spark, ordered, keys, order).where(F.expr(f"rank <= (members div {k}) * {k} and members div {k} >= {least}"))
    return x.withColumn("block", F.expr(f"(rank - 1) div {k}")).drop("rank", "members")


def quartiles(spark: SparkSession, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds quartile: floor(4 * rank / n), 3 at most, rank from 0."""
    return ranks(spark, rows, keys, order).withColumn("quartile", F.least(F.lit(3), F.floor((F.col("rank") - 1) * 4 / F.col("members"))).cast("int")).drop("rank", "members")


def round_robin_sample(candidates: DataFrame, stratum: list[str], rank_hash: Column, cap: int) -> DataFrame:
    """The first `cap` rows (the size of the sample is the feature) when strata take turns, rows of a stratum in the order of their hash."""
    ranked = candidates.withColumn("_h", rank_hash).withColumn("turn", F.row_number().over(Window.partitionBy(*stratum).orderBy("_h")))
    ranked = ranked.where(F.col("turn") <= cap)  # no stratum gives more, so tasks keep no more of it before they send it on
    return ranked.orderBy("turn", *stratum).limit(cap).drop("_h")


def hamilton_quotas(cells: DataFrame, keys: list[str], stratum: str, share: float, seed: int) -> DataFrame:
    """(keys, stratum, quota): a sample of floor(share * n) per key divided over strata by largest remainder, ties by digest."""
    per = cells.groupBy(*keys, stratum).agg(F.count("*").alias("count"))
    w = Window.partitionBy(*keys)
    per = per.withColumn("sample_n", F.floor(F.sum("count").over(w) * F.lit(share)))
    exact = F.col("sample_n") * F.col("count") / F.sum("count").over(w)
    per = per.withColumns({"_floor": F.floor(F.round(exact, 9)), "_fraction": F.round(exact - F.floor(F.round(exact, 9)), 9)})
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit("quota"), F.col(stratum)), 256)
    rank = F.row_number().over(w.orderBy(F.desc("_fraction"), digest))
    rest = F.col("sample_n") - F.sum("_floor").over(w)
    return per.withColumn("quota", F.least(F.col("count"), F.col("_floor") + (rank <= rest).cast("int")).cast("long")).select(*keys, stratum, "count", "quota")


def hash_ranked(spark: SparkSession, cells: DataFrame, keys: list[str], cell: str, seed: int, ties: list[str]) -> DataFrame:
    """Adds sample_rank: the place of a cell among its key by digest."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(cell)), 256)
    return ranks(spark, cells.withColumn("_d", digest), keys, ["_d", cell, *ties]).withColumn("sample_rank", F.col("rank").cast("int")).drop("_d", "rank", "members")


def round_robin_schedule(spark: SparkSession, queries: DataFrame, condition: str, order: str, seed: int) -> DataFrame:
    """Adds turn and key_position: conditions take turns in a seeded order of their own; (turn, key_position) is the schedule.

    The conditions of a run are few by design (they are named in its configuration) and are shuffled on the driver.
    """
    conditions = sorted(r[0] for r in queries.select(condition).distinct().collect())
    random.Random(seed).shuffle(conditions)
    place = F.array_position(F.array(*map(F.lit, conditions)), F.col(condition)) - 1
    return ranks(spark, queries, [condition], [order]).withColumns({"turn": F.col("rank").cast("int"), "key_position": place}).drop("rank", "members")


def derangement(n: int, seed: int) -> list[int]:
    """A seeded order of n places in which none stays, found by shuffling until one fits."""
    if n < 2:
        raise ValueError("fewer than two places can't all change")
    rng, order = random.Random(seed), list(range(n))
    while any(i == x for i, x in enumerate(order)):
        rng.shuffle(order)
    return order


def _counted(texts: DataFrame, key: str, text: str, low: int, high: int, corpus: str | None, times: str | None) -> tuple[DataFrame, DataFrame]:
    """(texts (key, _of, _grams), terms (_of, term, idf)), both written: of each text the terms in order with 1 + ln tf."""
    stages = Stages(texts.sparkSession, "terms")
    of, often = F.col(corpus) if corpus else F.lit(""), F.col(times) if times else F.lit(1)
    own = texts.select(key, of.alias("_of"), often.alias("_times"), plain_text(F.col(text)).alias("_text"))
    own = own.groupBy(key, "_of", "_times").agg(F.count("*").alias("_rows"), F.collect_list("_text").alias("_texts"))  # the rows of one key
    own = own.repartition(shuffle_width(texts.sparkSession))  # a small table of texts is many n-grams
    counted = T.StructType([*own.drop("_texts").schema, T.StructField("_grams", T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))])

    def run(batches):
        for batch in batches:
            counts = [sorted(Counter(t[i : i + k] for t in of for k in range(low, high + 1) for i in range(len(t) - k + 1)).items()) for of in batch.column(4).to_pylist()]
            terms, tf = pa.array([g for c in counts for g, _ in c], pa.string()), pa.array([n for c in counts for _, n in c], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], _lists(map(len, counts), pa.StructArray.from_arrays([terms, tf], ["term", "tf"]))], counted.names)

    # counted where the text lies, so that its n-grams don't travel to meet
    grams = own.mapInArrow(run, counted).withColumn("_grams", F.transform("_grams", lambda g: F.struct(g["term"], (1 + F.log(g["tf"])).alias("w"))))
    grams = stages.keep(grams)
    n = grams.groupBy("_of").agg(F.sum(F.col("_times") * F.col("_rows")).alias("_all"))
    df = grams.select("_of", "_times", F.explode("_grams.term").alias("term")).groupBy("_of", "term").agg(F.sum("_times").alias("df")).join(F.broadcast(n), "_of")  # a corpus is one row
    return grams.drop("_times", "_rows"), stages.keep(df.select("_of", "term", (F.log((1.0 + F.col("_all")) / (1 + F.col("df"))) + 1).alias("idf")))


def _lists(lengths, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), values)


def term_weights(texts: DataFrame, key: str, text: str, low: int = 2, high: int = 5, corpus: str | None = None, times: str | None = None) -> DataFrame:
    """(key, term, w) of character n-grams: 1 + ln tf times ln((1 + N) / (1 + df)) + 1.

    Texts of one key are counted together. N and df are of the texts of one corpus, all being one unless told; a text counts as
    often as `times` says.
    """
    grams, df = _counted(texts, key, text, low, high, corpus, times)
    return grams.select(key, "_of", F.inline("_grams")).join(broadcast_if_small(df), ["_of", "term"]).select(key, "term", (F.col("w") * F.col("idf")).alias("w"))


def term_lists(texts: DataFrame, key: str, text: str, low: int = 2, high: int = 5, corpus: str | None = None, times: str | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(key, terms, weights): the terms and weights of term_weights, one row per text, terms as 64-bit hashes.

    Up to `limit` terms of all corpora go to the texts; more meet them by a join. The numbers are the same.
    """
    grams, df = _counted(texts, key, text, low, high, corpus, times)
    df = df.withColumn("hash", F.xxhash64("term"))
    if df.count() > limit:
        each = grams.select(key, "_of", F.inline("_grams")).join(df, ["_of", "term"])
        lists = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "hash", (F.col("w") * F.col("idf")).alias("w")))).alias("_l"))  # the terms of one text
        lists = lists.select(key, F.col("_l.hash").alias("terms"), F.col("_l.w").alias("weights"))
        return grams.select(key).join(lists, key, "left").select(key, *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("terms", "array<bigint>"), ("weights", "array<double>"))))
    known = {of: (pa.array(x["term"], pa.string()), x["hash"].to_numpy(), x["idf"].to_numpy()) for of, x in df.toPandas().groupby("_of")}

    def run(batches):
        for batch in batches:
            for of in batch.column(1).unique().to_pylist():
                part = batch.filter(pc.equal(batch.column(1), of))
                lists = part.column(2)
                flat = lists.flatten()
                if not len(flat):
                    none = [0] * len(part)
                    yield pa.RecordBatch.from_arrays([part.column(0), _lists(none, pa.array([], pa.int64())), _lists(none, pa.array([], pa.float64()))], [key, "terms", "weights"])
                    continue
                terms, hashes, idf = known[of]
                at = pc.index_in(flat.field("term"), value_set=terms).to_numpy(zero_copy_only=False)
                lengths = pc.list_value_length(lists).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(lengths, pa.array(hashes[at])), _lists(lengths, pa.array(flat.field("w").to_numpy() * idf[at]))], [key, "terms", "weights"])

    schema = T.StructType([*grams.select(key).schema, T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    return grams.select(key, "_of", "_grams").mapInArrow(run, schema)


def unit_vectors(weighted: DataFrame, key: str) -> DataFrame:
    """(key, term, weight) of (key, term, w) at unit length."""
    norm = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm")).where("norm > 0")
    return weighted.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf(texts: DataFrame, key: str, text: str, low: int = 2, high: int = 5) -> DataFrame:
    """(key, term, weight): unit vectors of character n-grams."""
    return unit_vectors(term_weights(texts, key, text, low, high), key)


def merged_vectors(parts: list[tuple[str, DataFrame, float]], key: str) -> DataFrame:
    """Weighted union of vector tables, terms marked by their view, at unit length again."""
    out = None
    for name, df, share in parts:
        one = df.select(key, F.concat(F.lit(f"{name}:"), F.col("term")).alias("term"), (F.col("weight") * share).alias("w"))
        out = one if out is None else out.unionByName(one)
    return unit_vectors(out, key)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers: 1 where both have no length, 0 where one has none."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    both = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(both)


def _alike_columns(n: int, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries with columns of one value in the same rows put together: products of rows stay, with fewer entries."""
    if not row.size:
        return row, col, value
    at = np.lexsort((row, col))
    row, col, value = row[at], col[at], value[at]
    start = np.flatnonzero(np.r_[True, col[1:] != col[:-1]])
    many = np.diff(np.r_[start, col.size])
    # a column's rows are told by two sums of 64 random bits
    marks = np.random.default_rng(0).integers(0, 2**64, (2, n), dtype=np.uint64)
    kind = np.column_stack([np.add.reduceat(m[row], start) for m in marks])
    one = np.minimum.reduceat(value, start) == np.maximum.reduceat(value, start)
    kind[~one] = np.column_stack([np.flatnonzero(~one), np.full((~one).sum(), -1)]).astype(np.uint64)
    _, first, which = np.unique(kind, axis=0, return_index=True, return_inverse=True)
    which = which.ravel()
    length = np.sqrt(np.bincount(which, weights=value[start] ** 2))
    kept = np.zeros(start.size, dtype=bool)
    kept[first] = True
    value = np.where(np.repeat(one, many), np.repeat(length[which], many), value)
    entry = np.repeat(kept, many)
    return row[entry], np.repeat(which, many)[entry], value[entry]


def average_linkage_order(groups: list[list[str]], vectors) -> list[str]:
    """Leaves of average linkage under cosine distance; groups: the ids of each vector; vectors: a matrix, or (row, column, value) of its entries.

    Of equally near clusters the pair with the smallest first ids merges first; a merge puts the nearer
    ends together, and of equals the order that compares smaller. So the ids of equal vectors follow each
    other by name, and only different vectors are linked. The mean cosine of two clusters is the product
    of their sums of unit vectors over both sizes: what is held grows with the vectors' entries, not with
    their pairs. Clusters that are each other's nearest merge whenever they are met: with that order of
    pairs no other merge comes between, so the tree is that of taking the nearest pair each time. The
    nearest of all whose own has merged are searched together, of many clusters among those that share a
    rare column as far as no other can be nearer; where that takes too many searches, as
    next to a cluster that is the nearest of most, a chain of nearest ones goes on, with at most three a
    cluster. Columns that become frequent as clusters merge are laid out too.
    """
    n = len(groups)
    if isinstance(vectors, tuple):
        dense, (row, col, value) = np.zeros((n, 0)), _alike_columns(n, *vectors)
    else:
        dense, row, col, value = np.asarray(vectors, dtype=float), np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    length = np.sqrt((dense**2).sum(axis=1) + np.bincount(row, weights=value**2, minlength=n))
    unit = np.where(length > 0, length, 1)
    value = value / unit[row]
    # columns that many rows have are laid out; vectors without length are alike, and unlike all others: a direction of their own
    often = np.bincount(col, minlength=1) * LAID_OUT >= n
    place = np.cumsum(often) - 1
    laid = np.zeros((n, int(often.sum())))
    k = often[col] if col.size else np.zeros(0, bool)
    laid[row[k], place[col[k]]] = value[k]
    x = np.column_stack([dense / unit[:, None], laid, (length == 0).astype(float)])
    row, col, value = row[~k], col[~k], value[~k]
    at = np.lexsort((col, row))
    cuts = np.searchsorted(row[at], np.arange(1, n))
    cols, values = np.split(col[at], cuts), np.split(value[at], cuts)

    same: dict[tuple[bytes, bytes, bytes], int] = {}
    members: list[list[str]] = []
    first = []
    for i in range(n):
        key = ((np.round(x[i], 12) + 0.0).tobytes(), cols[i].tobytes(), np.round(values[i], 12).tobytes())
        at = same.setdefault(key, len(members))
        if at == len(members):
            members.append([])
            first.append(i)
        members[at].extend(groups[i])
    members = [sorted(m) for m in members]
    order = sorted(range(len(members)), key=lambda i: members[i][0])
    members, first = [members[i] for i in order], [first[i] for i in order]
    x, leaf_cols, leaf_values = x[first], [cols[i] for i in first], [values[i] for i in first]
    n = len(members)
    if not n:
        return []

    size = np.array([float(len(m)) for m in members])
    sums, own = x * size[:, None], [(c, v * s) for c, v, s in zip(leaf_cols, leaf_values, size)]
    ends, follows = [(i, i) for i in range(n)], [-1] * n
    wide = int(max((c[-1] for c in leaf_cols if c.size), default=-1)) + 1
    buffer = np.zeros(wide)

    def laid_out(sums, own):
        """(sums, own) with the columns that have become frequent among clusters laid out."""
        lengths, cols = [len(c) for c, _ in own], np.concatenate([c for c, _ in own])
        often = np.bincount(cols, minlength=wide) * LAID_OUT >= len(own)
        k, place, rows = often[cols], np.cumsum(often) - 1, np.repeat(np.arange(len(own)), lengths)
        if not k.any():
            return sums, own
        more = np.zeros((len(own), int(often.sum())))
        more[rows[k], place[cols[k]]] = np.concatenate([v for _, v in own])[k]
        return np.column_stack([sums, more]), [(c[~often[c]], v[~often[c]]) for c, v in own]

    def postings():
        rows, all_cols = np.repeat(np.arange(len(own)), [len(c) for c, _ in own]), np.concatenate([c for c, _ in own])
        by = np.argsort(all_cols, kind="stable")
        return np.searchsorted(all_cols[by], np.arange(wide + 1)), rows[by], np.concatenate([v for _, v in own])[by]

    def without_rare():
        """(rare columns, lengths of the mean vectors in all others). A merged cluster's is at most the larger of both."""
        rare = np.diff(starts) * RARE <= len(own)
        often = ~rare[np.repeat(np.arange(wide), np.diff(starts))]
        return rare, np.sqrt((sums**2).sum(axis=1) + np.bincount(post_row[often], weights=post_value[often] ** 2, minlength=len(own))) / size

    def expanded(cols):
        """(entries, how many of each) of the postings of columns."""
        many = starts[cols + 1] - starts[cols]
        entries = np.repeat(starts[cols] - np.cumsum(many) + many, many)
        entries += np.arange(entries.size)
        return entries, many

    def first_of_nearest(of, cosine, rows, n):
        """(distances, rows): for each of n, named by `of`, the nearest; of equally near ones the first."""
        top = np.full(n, -np.inf)
        np.maximum.at(top, of, cosine)
        k = cosine >= top[of] - 2e-12
        of, d, rows = of[k], np.round(np.clip(1 - cosine[k], 0, 2), 12), rows[k]
        best = np.lexsort((rows, d, of))
        best = best[np.diff(of[best], prepend=-1) > 0]
        return d[best], rows[best]

    def compared(laid, which, of, rows):
        """Cosines of pairs: clusters which[of], whose entries are laid out, and rows."""
        out = np.zeros(len(of))
        for low in range(0, len(of), 8192):
            i, j = of[low : low + 8192], rows[low : low + 8192]
            these = [own[r] for r in j]
            pair = np.repeat(np.arange(len(j)), [len(c) for c, _ in these])
            products = laid[i[pair], np.concatenate([c for c, _ in these])] * np.concatenate([v for _, v in these])
            out[low : low + 8192] = (np.einsum("ij,ij->i", sums[which[i]], sums[j]) + np.bincount(pair, weights=products, minlength=len(j))) / size[j] / size[which[i]]
        return out

    def nearest_by_rare(some):
        """(known, distances, rows) of the clusters nearest to some, as `nearest` gives, where few need to be compared.

        The cosine of two clusters is at most the product of their rare columns plus that of the lengths of all others, so
        only those are compared that share a rare column and may be nearer by this than one that was compared, and the ones
        with so much length in the others that they may be nearer without a shared one.
        """
        known, distance, row = np.zeros(len(some), bool), np.zeros(len(some)), np.zeros(len(some), int)
        by_length = np.argsort(-rest)
        lengths = -rest[by_length]
        own_cols = [own[i][0] for i in some]
        found = np.array([(starts[c + 1] - starts[c])[rare[c]].sum() for c in own_cols])
        blocks = np.cumsum(np.maximum(found, max(1, wide // 8))) // BLOCK
        parts = np.split(np.arange(len(some)), np.flatnonzero(np.diff(blocks)) + 1)
        laid = np.zeros((max(map(len, parts)), wide))
        for part in parts:
            which = some[part]
            cols, weights = (np.concatenate([own[i][k] for i in which]) for k in (0, 1))
            of, k = np.repeat(np.arange(len(part)), [len(own_cols[p]) for p in part]), rare[cols]
            entries, many = expanded(cols[k])
            place = np.repeat(of[k] * len(size), many) + now[post_row[entries]]
            by = np.argsort(place)
            place = place[by]
            start = np.flatnonzero(np.diff(place, prepend=-1))
            if not len(start):
                continue
            of, rows = np.divmod(place[start], len(size))
            most = np.add.reduceat((post_value[entries] * np.repeat(weights[k], many))[by], start) / size[rows] / size[which[of]] + rest[which[of]] * rest[rows]
            k = (rows != which[of]) & ~gone[rows]
            of, rows, most = of[k], rows[k], most[k]
            if not len(of):
                continue
            at = np.repeat(np.arange(len(part)), [len(own_cols[p]) for p in part]), cols
            laid[at] = weights
            start = np.flatnonzero(np.diff(of, prepend=-1))
            top = np.full(len(part), -np.inf)
            top[of[start]] = np.maximum.reduceat(most, start)
            first = np.flatnonzero(most == top[of])
            first = first[np.diff(of[first], prepend=-1) > 0]
            least = np.full(len(part), np.inf)
            least[of[first]] = compared(laid, which, of[first], rows[first]) - 4e-12
            # those that may be nearer without a shared column, as many from the longest on
            besides = np.searchsorted(lengths, -least / np.maximum(rest[which], 1e-300), side="right")
            k = most >= least[of]
            sure = np.isfinite(least) & (least > 0) & (besides <= BESIDES) & (np.bincount(of[k], minlength=len(part)) <= COMPARED)
            k &= sure[of]
            besides = np.where(sure, besides, 0)
            more = by_length[np.arange(besides.sum()) - np.repeat(np.cumsum(besides) - besides, besides)]
            of, rows = np.r_[of[k], np.repeat(np.arange(len(part)), besides)], np.r_[rows[k], more]
            k = (rows != which[of]) & ~gone[rows]
            of, rows = of[k], rows[k]
            distance[part[sure]], row[part[sure]] = first_of_nearest(of, compared(laid, which, of, rows), rows, len(part))
            known[part] = sure
            laid[at] = 0
        return known, distance, row

    def nearest(some):
        """(distances, rows) of the clusters nearest to some; of equally near ones the first."""
        distance, row = np.zeros(len(some)), np.zeros(len(some), int)
        lengths = np.array([len(own[i][0]) for i in some])
        cols = np.concatenate([own[i][0] for i in some])
        found = np.bincount(np.repeat(np.arange(len(some)), lengths), weights=starts[cols + 1] - starts[cols], minlength=len(some))
        blocks = np.cumsum(np.maximum(found, len(size))) // BLOCK
        for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(blocks)) + 1):
            which = some[part]
            cols, weights = (np.concatenate([own[i][k] for i in which]) for k in (0, 1))
            entries, many = expanded(cols)
            place = np.repeat(np.repeat(np.arange(len(part)) * len(size), lengths[part]), many)
            place += now[post_row[entries]]
            weights /= np.repeat(size[which], lengths[part])
            cosine = (sums[which] / size[which][:, None]) @ sums.T
            cosine += np.bincount(place, weights=post_value[entries] * np.repeat(weights, many), minlength=cosine.size).reshape(cosine.shape)
            cosine /= size
            cosine[np.arange(len(part)), which] = -np.inf
            top = cosine.max(axis=1)
            if top.min() <= 2e-12:  # else those that are gone, at 0, aren't the nearest
                cosine[:, np.flatnonzero(gone)] = -np.inf
                top = cosine.max(axis=1)
            at, near = np.divmod(np.flatnonzero(cosine >= top[:, None] - 2e-12), len(size))
            distance[part], row[part] = first_of_nearest(at, cosine[at, near], near, len(part))
        return distance, row

    def leaf(p, q):
        buffer[leaf_cols[p]] = leaf_values[p]
        cosine = x[p] @ x[q] + buffer[leaf_cols[q]] @ leaf_values[q]
        buffer[leaf_cols[p]] = 0
        return round(float(np.clip(1 - cosine, 0, 2)), 12)

    def merge(i, j):
        (a0, a1), (b0, b1) = ends[i], ends[j]
        ab, ba = leaf(a1, b0), leaf(b1, a0)
        if ab < ba or (ab == ba and members[a0][0] < members[b0][0]):
            follows[a1], ends[i] = b0, (a0, b1)
        else:
            follows[b1], ends[i] = a0, (b0, a1)
        sums[i] += sums[j]
        sums[j] = 0
        size[i] += size[j]
        rest[i], rest[j] = max(rest[i], rest[j]), 0
        (some, these), (more, those) = own[i], own[j]
        buffer[some] = these
        buffer[more] += those
        both = np.union1d(some, more)
        own[i], own[j] = (both, buffer[both]), (some[:0], these[:0])
        buffer[both] = 0
        now[now == j] = i
        gone[j] = True

    # a row stays the cluster's that is named by the smaller member; one is open while its nearest isn't known
    starts, post_row, post_value = postings()
    by_rare = True
    rare, rest = without_rare()
    now, gone = np.arange(n), np.zeros(n, bool)
    far, near, opened = np.zeros(n), np.zeros(n, int), np.ones(n, bool)
    left, searched = n, 0
    chain: list[int] = []
    while left > 1:
        some = np.flatnonzero(opened)
        if len(some) and searched + len(some) <= SEARCHES * (n - left) + n:
            searched, chain = searched + len(some), []
            opened[some] = False
            if by_rare and left >= LEAST:
                known, far[some], near[some] = nearest_by_rare(some)
                by_rare = 4 * known.sum() >= len(some)  # else these take time and spare little
                some = some[~known]
            if len(some):
                far[some], near[some] = nearest(some)
            pairs = np.flatnonzero((near[near] == np.arange(len(near))) & (near > np.arange(len(near))))
            if not len(pairs):  # only if sums of another order round otherwise
                continue
        else:
            if not chain:
                chain.append(int(np.flatnonzero(~gone)[0]))
            i = chain[-1]
            if opened[i]:
                far[i : i + 1], near[i : i + 1] = nearest(np.array([i]))
                opened[i] = False
            key = lambda k: (far[k], min(k, near[k]), max(k, near[k]))
            if len(chain) < 2 or key(i) < key(chain[-2]):
                chain.append(int(near[i]))
                continue
            pairs = np.array([min(chain[-2:])])
            near[pairs[0]] = max(chain[-2:])
            chain = chain[:-2]
        touched = np.zeros(len(near), bool)
        touched[pairs] = touched[near[pairs]] = True
        opened |= touched[near] & ~gone
        for i, j in zip(pairs, near[pairs]):
            merge(i, j)
            near[j] = j
        opened[pairs], left = True, left - len(pairs)
        opened &= ~gone
        if 4 * left < 3 * len(gone):
            kept, moved = np.flatnonzero(~gone), np.cumsum(~gone) - 1
            sums, own = laid_out(sums[kept], [own[c] for c in kept])
            size, ends = size[kept], [ends[c] for c in kept]
            far, near, opened = far[kept], moved[near[kept]], opened[kept]
            chain = [int(moved[c]) for c in chain]
            now, gone = np.arange(left), np.zeros(left, bool)
            starts, post_row, post_value = postings()
            rare, rest = without_rare()
    at, out = ends[int(np.flatnonzero(~gone)[0])][0], []
    while at >= 0:
        out += members[at]
        at = follows[at]
    return out


def bucket_orders(vectors: DataFrame, bucket: list[str], key: str, dense, largest: int | None) -> DataFrame:
    """(bucket..., part, ordered) of items (bucket..., key, _v); dense: makes vectors for average_linkage_order of a series.

    A bucket is one order. Only if `largest` is given, a bucket above it is cut into unrelated parts of about
    that size by the hash of the key. Keys of equal vectors travel as one row.
    """
    part = F.lit(0).cast("long")
    if largest:
        n = vectors.groupBy(*bucket).agg(F.count("*").alias("_n"))
        vectors, part = vectors.join(n, bucket), F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / largest))
    alike = vectors.withColumn("part", part).groupBy(*bucket, "part", "_v").agg(F.sort_array(F.collect_list(F.col(key).cast("string"))).alias("_keys"))
    return linked(alike, [*bucket, "part"], dense)


def linked(alike: DataFrame, bucket: list[str], dense) -> DataFrame:
    """(bucket..., ordered) of (bucket..., _keys, _v): the ids of each vector."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in alike.select(*bucket).schema), "ordered array<string>"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*pdf[bucket].iloc[0], average_linkage_order([list(k) for k in pdf["_keys"]], dense(pdf["_v"]))]], columns=[*bucket, "ordered"])

    return alike.groupBy(*bucket).applyInPandas(run, schema)


def leaf_orders(items: DataFrame, bucket: list[str], key: str, vector: str, largest: int | None = None) -> DataFrame:
    """(bucket..., part, ordered): the leaf order of each bucket, see bucket_orders."""
    return bucket_orders(items.select(*bucket, key, F.col(vector).alias("_v")), bucket, key, lambda v: np.stack([np.asarray(x, dtype=float) for x in v]), largest)


def first_of_equal(actions: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """One row per set of equal columns, the smallest by order."""
    rest = [c for c in actions.columns if c not in same]
    return actions.groupBy(*same).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*same, "_r.*").select(*actions.columns)
