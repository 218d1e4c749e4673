"""Queries over groups of cells: how they are made, paired for comparison, and how their ledgers are merged."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmend.functions.scalars import format_signature, value_type
from cellmend.operators.grouping import bucket_orders, derangement, exact_windows, linked, numbered, term_lists
from cellmend.operators.prompts import query_id
from cellmend.operators.statistics import derived_seed

# fixed values: answers of which other phases a phase may reuse
REUSABLE = {
    "bgr_selected_union": ["preliminary_random", "preliminary_singleton", "preliminary_structured"],
    "offline_group_calibration": ["preliminary_random", "preliminary_singleton", "preliminary_structured"],
    "online_selected_union": ["offline_group_calibration", "preliminary_random", "preliminary_singleton", "preliminary_structured"],
    "preliminary_singleton": ["model_preflight"],
}

SIGNATURE = ["dirty_type", "dirty_format", "base_type", "base_format"]
PATTERN = ["base_share", *SIGNATURE]
#: terms of sparse vectors that are laid out at once
TERMS = 4096


def dense_vectors(column: pd.Series) -> np.ndarray:
    """A matrix with the products of sparse vectors. With more terms than vectors it holds their coordinates in the space that they span."""
    place: dict[str, int] = {}
    at, value, ends = [], [], [0]
    for v in column:
        for t in v if v is not None else ():
            at.append(place.setdefault(t["term"], len(place)))
            value.append(t["weight"])
        ends.append(len(at))
    n, at, value = len(ends) - 1, np.array(at, dtype=int), np.array(value, dtype=float)
    row = np.repeat(np.arange(n), np.diff(ends))

    def block(low: int, high: int) -> np.ndarray:
        out, k = np.zeros((n, high - low)), (at >= low) & (at < high)
        out[row[k], at[k] - low] = value[k]
        return out

    if len(place) <= max(n, TERMS):
        return block(0, max(1, len(place)))
    products = np.zeros((n, n))
    for low in range(0, len(place), TERMS):
        part = block(low, min(low + TERMS, len(place)))
        products += part @ part.T
    length, axes = np.linalg.eigh(products)
    kept = length > 1e-13 * max(1.0, float(length[-1]))
    out = axes[:, kept] * np.sqrt(length[kept])
    out[np.diag(products) == 0] = 0
    return out


def entries(column: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of sparse vectors, each a pair of arrays: terms and their weights."""
    lengths = [len(v["terms"]) if v is not None else 0 for v in column]
    both = [v for v in column if v is not None and len(v["terms"])]
    if not both:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
    _, which = np.unique(np.concatenate([v["terms"] for v in both]), return_inverse=True)
    return np.repeat(np.arange(len(column)), lengths), which, np.concatenate([v["weights"] for v in both]).astype(float)


def packed(weighted: DataFrame, key: str, weight: str = "w") -> DataFrame:
    """(key, _v): the terms of a key, as 64-bit hashes in order, their weights, and the length of these."""
    one = F.struct(F.xxhash64("term").alias("term"), F.col(weight).alias("w"))
    v = weighted.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("v"), F.sqrt(F.sum(F.col(weight) ** 2)).alias("length"))  # the terms of one value
    return v.select(key, F.struct(F.col("v.term").alias("terms"), F.col("v.w").alias("weights"), "length").alias("_v"))


def merged_packed(first: DataFrame, second: DataFrame, key: str, shares: tuple[float, float]) -> DataFrame:
    """(key, _v) of two written tables of it that have no terms in common, each at unit length times its share."""
    unit = lambda v, share: F.transform(v["weights"], lambda w: w * share / v["length"])
    both = first.withColumnRenamed("_v", "_a").join(second.withColumnRenamed("_v", "_b"), key)
    a, b = F.col("_a"), F.col("_b")
    return both.select(key, F.struct(F.concat(a["terms"], b["terms"]).alias("terms"), F.concat(unit(a, shares[0]), unit(b, shares[1])).alias("weights")).alias("_v"))


def sparse_leaf_orders(items: DataFrame, bucket: list[str], key: str, terms: DataFrame, largest: int | None = None) -> DataFrame:
    """(bucket..., part, ordered) by the cosine of sparse vectors (key, term, weight). Items without terms have no length."""
    vectors = packed(terms.withColumn("weight", F.round("weight", 12)), key, "weight")
    alone = F.when(F.col("_v").isNotNull(), F.struct("_v.terms", "_v.weights")).alias("_v")  # of equal vectors one row
    return bucket_orders(items.join(vectors, key, "left").select(*bucket, key, alone), bucket, key, entries, largest)


def form_orders(items: DataFrame, bucket: list[str], key: str, form: str, vectors: DataFrame) -> DataFrame:
    """(bucket..., ordered) of items (bucket..., key, form) by the cosine of the vectors (form, _v) of their forms.

    Two items have one order, by name, whatever their vectors, so only forms of larger buckets travel.
    """
    sized = items.withColumn("_n", F.count("*").over(Window.partitionBy(*bucket)))  # a bucket is one order in one task
    ids = F.sort_array(F.collect_list(F.col(key).cast("string")))  # two, or those of one form
    few = sized.where("_n <= 2").groupBy(*bucket).agg(ids.alias("ordered"))
    alike = sized.where("_n > 2").groupBy(*bucket, form).agg(ids.alias("_keys")).join(vectors, form, "left").select(*bucket, "_keys", "_v")
    return few.unionByName(linked(alike, bucket, entries))


def group_actions(cells: DataFrame, orders: list[tuple[str, DataFrame]], sizes: list[int]) -> DataFrame:
    """(query_id, view, dataset, cell_ids, size): every cell alone, and windows of each size over the orders of each view.

    orders: (view, table with dataset and `ordered` cell ids). The same set of cells is one query, under
    the view that comes first by name. Sets meet as they are, under numbers of views, and are named once.
    """
    names = sorted({"singleton", *(view for view, _ in orders)})
    numbered_as = lambda view: F.lit(names.index(view)).alias("_view")
    parts = [cells.select(numbered_as("singleton"), "dataset", F.array("cell_id").alias("cell_ids"))]
    for view, order in orders:
        windows = F.concat(*(exact_windows(F.col("ordered"), k) for k in sizes))
        parts.append(order.select(numbered_as(view), "dataset", F.explode(windows).alias("cell_ids")))
    x = reduce(DataFrame.unionByName, parts).withColumn("cell_ids", F.array_sort("cell_ids"))
    x = x.groupBy("dataset", "cell_ids").agg(F.min("_view").alias("_view"))
    view = F.element_at(F.array(*map(F.lit, names)), F.col("_view") + 1)
    return x.select(view.alias("view"), "dataset", "cell_ids", F.size("cell_ids").alias("size"), query_id(F.col("dataset"), F.col("cell_ids")).alias("query_id"))


def signatures(cells: DataFrame) -> DataFrame:
    """cells (dirty_value, base_value, base_share, column_name) with the types and formats of both values."""
    return cells.withColumns({f"{n}_{k}": f(F.col(f"{n}_value")) for n in ("dirty", "base") for k, f in (("type", value_type), ("format", format_signature))})


def cell_forms(signed: DataFrame, masked: DataFrame) -> DataFrame:
    """Cells with masked row, pattern and form.

    Vectors depend on the signature alone, the pattern, or on the data set, column and masked row besides, the form: so they are made for these.
    """
    named = lambda *of: F.sha2(F.to_json(F.struct(*of)), 256)
    return signed.join(masked, "cell_id").withColumns({"pattern": named(*PATTERN), "form": named("dataset", "column_name", "masked", *PATTERN)})


def forms_of(cells: DataFrame) -> DataFrame:
    """Forms of such cells with pattern, times and what they consist of."""
    return cells.groupBy("form", "pattern", "dataset", "column_name", "masked", *PATTERN).agg(F.count("*").alias("times"))


def pattern_vectors(patterns: DataFrame, key: str = "pattern") -> DataFrame:
    """(pattern, term, w): types and formats of the dirty and the base value and the signed log of the base value's support."""
    terms = [F.struct(F.concat(F.lit(f"{c}="), c).alias("term"), F.lit(1.0).alias("w")) for c in SIGNATURE]
    support = F.struct(F.lit("support=base").alias("term"), (F.signum("base_share") * F.log1p(F.abs("base_share"))).alias("w"))
    return patterns.select(key, F.inline(F.array(*terms, support)))


def semantic_vectors(forms: DataFrame, weight: float = 1.5) -> DataFrame:
    """(form, _v), as packed gives: n-grams of the masked rows of each data set, with the signature as further terms."""
    share = F.col("base_share")
    bucket = F.when(share == 0, "zero").when(share < 0.25, "low").when(share < 0.75, "medium").otherwise("high")
    tokens = [F.concat(F.lit("signature:column:"), "column_name"), *(F.concat(F.lit(f"signature:{c}:"), c) for c in SIGNATURE), F.concat(F.lit("signature:support:base:"), bucket)]
    own = forms.select("form", F.array(*map(F.xxhash64, tokens)).alias("_own"))
    both = term_lists(forms, "form", "masked", corpus="dataset", times="times").join(own, "form")
    terms, weights = F.concat("terms", "_own"), F.concat("weights", F.array_repeat(F.lit(weight), len(tokens)))
    both = both.select("form", terms.alias("terms"), weights.alias("weights"))
    return both.select("form", F.struct("terms", "weights", F.sqrt(F.aggregate("weights", F.lit(0.0), lambda s, w: s + w * w)).alias("length")).alias("_v"))


def row_orders(cells: DataFrame) -> DataFrame:
    """Error cells of one row in column order, where there are two or more. A row has no more cells than columns."""
    x = cells.groupBy("dataset", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "cell_id"))).alias("m"))
    return x.where(F.size("m") > 1).select("dataset", F.transform("m", lambda s: s["cell_id"]).alias("ordered"))


def pair_features(actions: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per cell and query: place of the member, size, cost and saving against asking its cells alone."""
    cost = F.when(F.col("size") == 1, 202).otherwise(64 + 202 * F.col("size")).cast("long")
    x = actions.withColumn("query_cost", cost).select("query_id", "view", "dataset", "size", "query_cost", F.posexplode("cell_ids").alias("member_index", "cell_id"))
    x = x.withColumns({"position": F.round(F.col("member_index") / F.greatest(F.lit(1), F.col("size") - 1), 9), "saving_ratio": F.round(1 - F.col("query_cost") / (202.0 * F.col("size")), 9)})
    return x.join(cells.select("cell_id", "column_name", "row_idx"), "cell_id")


def random_partner(blocks: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """blocks (keys, block, member_index, cell_id) with partner_block: at each place of the blocks of a condition, the members change blocks so that none stays.

    Only block numbers go to Python, one row per condition.
    """
    per = blocks.groupBy(*keys).agg((F.max("block") + 1).cast("int").alias("n"), (F.max("member_index") + 1).cast("int").alias("k")).where("n > 1")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in per.select(*keys).schema), "block bigint, member_index int, partner_block bigint"])

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                for j in range(int(r["k"])):
                    order = derangement(int(r["n"]), derived_seed(seed, *(r[c] for c in keys), j))
                    rows += [[*(r[c] for c in keys), i, j, x] for i, x in enumerate(order)]
            yield pd.DataFrame(rows, columns=[*keys, "block", "member_index", "partner_block"])

    return blocks.join(per.mapInPandas(run, schema), [*keys, "block", "member_index"])


def compatible_phase(target: Column, source: Column) -> Column:
    """A phase may reuse its own answers and those of the phases listed for it."""
    return reduce(lambda a, b: a | b, ((target == t) & source.isin(*s) for t, s in REUSABLE.items()), target == source)


def merged_ledger(segments: list[tuple[str, DataFrame]], identity: list[str]) -> DataFrame:
    """Segments in order, each with its role; the last row per identity over all of them, and whether it is fresh (of the last segment)."""
    parts = [df.withColumns({"role": F.lit(name), "segment": F.lit(i)}) for i, (name, df) in enumerate(segments)]
    x = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rest = [c for c in x.columns if c not in identity]
    top = x.groupBy(*identity).agg(F.max_by(F.struct(*rest), F.struct("segment", "row_index")).alias("r"))
    return top.select(*identity, "r.*").withColumn("fresh", F.col("segment") == len(segments) - 1)


def retry_plan(requests: DataFrame, ledger: DataFrame, identity: list[str], attempts: int = 6, debit: int = 1024) -> DataFrame:
    """Requests without an answer, with the cost of asking until the last attempt."""
    done = ledger.where(F.col("status") == "success").select(*identity).distinct()
    return requests.join(done, identity, "left_anti").withColumn("worst_case_tokens", (F.col("planned_tokens") * attempts + debit).cast("long"))


def schedule_index(spark, scheduled: DataFrame) -> DataFrame:
    """Dense numbers in the order (turn, key_position)."""
    return numbered(spark, scheduled, ["turn", "key_position"], "logical_index")
