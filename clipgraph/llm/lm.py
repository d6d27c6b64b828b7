"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Every previous word has a restaurant whose customers are the words that follow it; all of them share one parent
restaurant of words, whose parent is uniform. Seating is sampled by Gibbs sweeps: the table count of each (context, word)
pair is redrawn by seating its customers one after another, given the parent's probability and the other tables of the context; the
tables of all contexts are the parent's customers. Predictive probabilities are averaged over the kept sweeps.

A pair seen once has one table whatever the sweep, so only pairs with two or more customers are sampled; the others enter as
sums. Seating costs the logarithm of a large count: from 64 customers on, a block of a sixteenth of those seated draws its
new tables at once. Draws are functions of the pair and the sweep, so a task that runs again draws the same.

Counts are Spark aggregations over all training rows and grow with the input; words are 64-bit hashes. A null text is
empty and scores its end token. Repeated rows count each time and are returned each time; a null id's remainder is that of the empty text.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgraph.llm.common import SPACED, Scratch, crc_rest, lowered, text_of
from clipgraph.session import measured_bytes

#: Discount and strength of the context restaurants and of the parent.
DISCOUNT, STRENGTH, ROOT_DISCOUNT, ROOT_STRENGTH = 0.75, 1.0, 0.75, 1.0
START, END = 0, 1  # keys of the two marks; word hashes are used as they are
ONE_BY_ONE = 64


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """A number in (0, 1) for each key and step."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def seat(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, key: np.ndarray, strength: float, discount: float) -> np.ndarray:
    """Table counts after seating the customers of one dish in turn.

    A customer opens a table with weight (strength + discount * all tables) * parent probability and joins one with
    weight seated - discount * own tables. ``others`` is the number of tables of other dishes in the restaurant.
    """
    tables = np.minimum(customers, 1).astype(float)
    n, step, live = tables.copy(), 0, np.nonzero(customers > 1)[0]
    while len(live):
        t, seen = tables[live], n[live]
        new = (strength + discount * (others[live] + t)) * parent[live]
        p = new / (new + np.maximum(seen - discount * t, 1e-12))
        block = np.minimum(customers[live] - seen, np.maximum(1, np.where(seen < ONE_BY_ONE, 1, seen // 16)))
        a, b = uniform(key[live], 2 * step), uniform(key[live], 2 * step + 1)
        gauss = np.rint(block * p + np.sqrt(block * p * (1 - p)) * np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b))
        tables[live] = t + np.where(block == 1, (a < p).astype(float), np.clip(gauss, 0, block))
        n[live] = seen + block
        step += 1
        live = live[n[live] < customers[live]]
    return tables


def seating(strength: float, discount: float):
    @F.pandas_udf("double")
    def run(customers: pd.Series, others: pd.Series, parent: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(seat(customers.to_numpy(float), others.to_numpy(float), parent.to_numpy(float), key.to_numpy(np.int64), strength, discount))

    return run


def tokens(docs: DataFrame) -> DataFrame:
    """One row per token: doc_id, row key, context u and token w as hashes."""
    d = docs.select("doc_id", text_of().alias("_t")).select(
        "doc_id", F.xxhash64("_t").alias("row"),
        F.transform(F.regexp_extract_all(lowered(F.col("_t")), F.lit(SPACED), F.lit(0)), lambda w: F.xxhash64(w)).alias("h"))
    left = F.concat(F.array(F.lit(START).cast("long")), "h")
    right = F.concat("h", F.array(F.lit(END).cast("long")))
    return d.select("doc_id", "row", F.explode(F.arrays_zip(left.alias("u"), right.alias("w"))).alias("p")).select("doc_id", "row", "p.u", "p.w")


def score(docs: DataFrame, modulus: int = 10, burn_in: int = 1, samples: int = 2, limit: int = 32 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row, and perplexity.

    Per-word and per-context tables are broadcast while they measure at most ``limit`` bytes and shuffled beyond. A token
    travels as its row key and one hash of its pair, and only once; its values come back summed per row and task.
    """
    held_out = crc_rest(F.col("doc_id"), modulus) == 0
    toks, scratch = tokens(docs), Scratch(docs.sparkSession)
    pairs = scratch.save(toks.groupBy("u", "w").agg(F.count_if(~held_out).alias("c")))
    words = scratch.save(pairs.groupBy("w").agg(F.sum("c").cast("double").alias("count"), F.count_if(F.col("c") == 1).cast("double").alias("once")))
    contexts = scratch.save(pairs.groupBy("u").agg(F.sum("c").cast("double").alias("cu"), F.count_if(F.col("c") == 1).cast("double").alias("once")))
    n, v = words.where("count > 0").agg(F.coalesce(F.sum("count"), F.lit(0.0)), F.count("*")).head()
    base = 1.0 / (v + 1)
    near = lambda t: F.broadcast(t) if measured_bytes(t) <= limit else t
    # seatings of the pairs with two or more customers; the kept sweeps stay on the row as t0, t1, ...
    many, root_tables = scratch.save(pairs.where("c > 1").select("u", "w", F.col("c").cast("double").alias("c"), F.lit(1.0).alias("t"))), float(v)
    root_seating, context_seating = seating(ROOT_STRENGTH, ROOT_DISCOUNT), seating(STRENGTH, DISCOUNT)
    per_word, per_context = words.select("w", "count"), contexts.select("u", "cu")
    for sweep in range(burn_in + samples):
        w = words.join(many.groupBy("w").agg(F.sum("t").alias("more")), "w", "left").select("w", (F.col("once") + F.coalesce("more", F.lit(0.0))).alias("cw"))
        w = scratch.save(w.withColumn("tw", root_seating("cw", F.greatest(F.lit(root_tables) - 1, F.lit(0.0)), F.lit(base), F.xxhash64("w", F.lit(sweep)))))
        customers, root_tables = w.agg(F.coalesce(F.sum("cw"), F.lit(0.0)), F.coalesce(F.sum("tw"), F.lit(0.0))).head()
        w = w.select("w", ((F.col("cw") - ROOT_DISCOUNT * F.col("tw") + (ROOT_STRENGTH + ROOT_DISCOUNT * root_tables) * base)
                           / (ROOT_STRENGTH + customers)).alias("pw"))
        u = scratch.save(contexts.join(many.groupBy("u").agg(F.sum("t").alias("more")), "u", "left").select("u", (F.col("once") + F.coalesce("more", F.lit(0.0))).alias("tu")))
        if sweep >= burn_in:
            i = sweep - burn_in
            per_word, per_context = per_word.join(w.withColumnRenamed("pw", f"pw{i}"), "w"), per_context.join(u.withColumnRenamed("tu", f"tu{i}"), "u")
            many = many.withColumn(f"t{i}", F.col("t"))
        if sweep < burn_in + samples - 1:
            new = context_seating("c", F.greatest(F.col("tu") - F.col("t"), F.lit(0.0)), "pw", F.xxhash64("u", "w", F.lit(sweep)))
            past = [c for c in many.columns if c not in ("u", "w", "c", "t")]
            many = scratch.save(many.join(near(w), "w").join(near(u), "u").select("u", "w", "c", *past, new.alias("t")))
    own = [f"t{i}" for i in range(samples)]
    single = F.col("c").cast("double")
    once = pairs.where("c <= 1").select("u", "w", single.alias("c"), *[single.alias(t) for t in own])
    per_word, per_context = scratch.save(per_word), scratch.save(per_context)
    table = many.select("u", "w", "c", *own).unionByName(once).join(near(per_word), "w").join(near(per_context), "u")
    seated, unseen = F.lit(0.0), F.lit(0.0)
    for i, t in enumerate(own):
        seated = seated + (F.col("c") - DISCOUNT * F.col(t) + (STRENGTH + DISCOUNT * F.col(f"tu{i}")) * F.col(f"pw{i}")) / (STRENGTH + F.col("cu"))
        unseen = unseen + F.col(f"pw{i}")
    p = F.when(F.col("cu") > 0, seated).otherwise(unseen) / samples
    pair = F.xxhash64("u", "w")
    # one hash is the join key of tokens and table; only where two pairs share theirs are the pairs themselves compared
    table = scratch.save(table.select(pair.alias("pair"), "u", "w", F.log10(p).alias("lp"), F.log10((F.col("count") + 0.1) / F.lit(n + 0.1 * (v + 1))).alias("lb"),
                                      (F.col("count") > 0).alias("known"), (F.col("w") == END).alias("end")))
    scratch.drop(pairs)
    shared = table.groupBy("pair").count().where("count > 1").limit(1).count() > 0
    if shared:
        joined = toks.join(table.drop("pair"), ["u", "w"])
    else:
        joined = toks.select("doc_id", "row", pair.alias("pair")).join(table.drop("u", "w"), "pair")
    summed = scratch.save(joined.groupBy("doc_id", "row").agg(F.count_if("end").alias("times"), F.count("*").alias("n_tokens"), F.count_if("known").alias("n_known"),
                                                              F.sum("lb").alias("base_score"), F.sum("lp").alias("score")))
    scratch.drop(table)
    # every row has one end token, so their number tells how often a row is repeated
    out = summed.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    each = lambda c: (F.col(c) / F.col("times"))
    return out.select("doc_id", held_out.alias("held_out"), each("n_tokens").cast("long").alias("n_tokens"), each("n_known").cast("long").alias("n_known"),
                      F.lit(int(n)).cast("long").alias("train_tokens"), each("base_score").alias("base_score"), each("score").alias("score"),
                      F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
