"""Propagation of class probabilities over edge tables, and its staged and fused variants."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.functions import arrays as A
from clipgraph.operators.blocks import group_counts
from clipgraph.operators.knn import edge_weights, knn
from clipgraph.operators.vectors import unit_by
from clipgraph.session import SMALL_BYTES, cut, join_small, keys, measured_bytes, rounds, stored

CUT_EVERY = 5


def _minmax(df: DataFrame, by, value: Column, out: str) -> DataFrame:
    by = keys(by)
    span = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return join_small(df, span, by).withColumn(out, (value - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)) \
             .drop("_lo", "_hi")


def row_side(base: DataFrame, ident: str = "clip_id", p: str = "p") -> Callable[[DataFrame], DataFrame]:
    """How the probability rows meet the edges in every step. Their size never changes, so it is measured once: small
    tables are broadcast and the edges stay where they are, larger ones are shuffled by the edge target."""
    return F.broadcast if measured_bytes(base.select(ident, p)) <= SMALL_BYTES else (lambda df: df)


def neighbor_sum(edges: DataFrame, q: DataFrame, n_classes: int, ident: str = "clip_id", p: str = "p",
                 weight: str = "w", side: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """sum over neighbours of w * q: (src, agg). Partial sums are combined before the shuffle by ``src``."""
    right = side(q.select(F.col(ident).alias("dst"), F.col(p).alias("_q")))
    return edges.select("src", "dst", F.col(weight).alias("_w")).join(right, "dst") \
                .groupBy("src").agg(A.E(A.weighted_sums("_q", n_classes, "_w")).alias("agg"))


def propagate(probs: DataFrame, edges: DataFrame, alpha: float = 0.75, iters: int = 5, sharp: float = 10.0,
              conf_pow: float = 0.0, conf_alpha: float = 0.0, node_u: str | None = None, u_beta: float = 0.0,
              by: str = "grp", ident: str = "clip_id", p: str = "p", weighted: bool = False, ready: bool = False,
              n_classes: int | None = None, every: int = CUT_EVERY) -> DataFrame:
    """Q <- (1 - a) P + a * sum_j w_ij Q_j, repeated.

    ``conf_pow`` scales a neighbour's weight by its confidence, ``conf_alpha`` raises a for rows of low confidence and
    ``node_u`` (with ``u_beta``) drives it from an uncertainty column. ``weighted`` says that edges carry ``w`` already,
    ``ready`` that both tables are materialised.
    """
    n = n_classes or A.width_of(probs, p)
    w = edges if weighted else edge_weights(edges, sharp)
    if conf_pow > 0:
        conf = probs.select(F.col(ident).alias("dst"), F.pow(F.array_max(p), F.lit(float(conf_pow))).alias("_c"))
        w = w.join(conf, "dst").withColumn("w", F.col("w") * F.col("_c")).drop("_c")
        w = w.withColumn("w", F.col("w") / (F.sum("w").over(Window.partitionBy("src")) + 1e-12))
    base = probs
    if node_u is not None and u_beta != 0.0:
        base = _minmax(base, by, F.col(node_u).cast("double"), "_u")
        rate = F.lit(alpha) + F.lit((1 - alpha) * u_beta) * F.col("_u")
        base = base.withColumn("_a", F.greatest(F.lit(0.0), F.least(F.lit(0.99), rate))).drop("_u")
    elif conf_alpha > 0:
        base = _minmax(base, by, F.array_max(p), "_cn")
        rate = F.lit(alpha) + F.lit((1 - alpha) * conf_alpha) * (1 - F.col("_cn"))
        base = base.withColumn("_a", F.greatest(F.lit(0.0), F.least(F.lit(0.99), rate))).drop("_cn")
    else:
        base = base.withColumn("_a", F.lit(float(alpha)))
    plain = ready and conf_pow == 0 and conf_alpha == 0 and node_u is None
    w = w.select("src", "dst", "w") if plain and weighted else cut(w.select("src", "dst", "w"))
    base = base if plain else cut(base)
    mix = A.both(p, f"coalesce(agg, {A.zeros(p)})", lambda x, y: f"(1 - _a) * {x} + _a * {y}")
    side = row_side(base, ident, p)
    q = base.select(ident, p)
    for step in range(1, iters + 1):
        agg = neighbor_sum(w, q, n, ident, p, side=side)
        q = base.join(agg.withColumnRenamed("src", ident), ident, "left").select(ident, A.E(mix).alias(p))
        if step % every == 0 and step < iters:
            q = cut(q)
    return base.drop(p, "_a").join(q, ident)


def propagate_lame(probs: DataFrame, edges: DataFrame, beta: float, tol: float = 1e-6, iters: int = 100,
                   ident: str = "clip_id", p: str = "p", every: int = 4) -> DataFrame:
    """z <- softmax(log p + beta * sum_j w_ij z_j) until no entry moves by more than tol.

    The stop test runs once per cut, on a column that holds the change of the newest step.
    """
    n = A.width_of(probs, p)
    w = cut(edge_weights(edges).select("src", "dst", "w"))
    base = cut(probs.withColumn("_lp", A.E(A.log_each(p))))
    side = row_side(base, ident, p)
    z = base.select(ident, p)
    for step in range(1, iters + 1):
        agg = neighbor_sum(w, z, n, ident, p, side=side).withColumnRenamed("src", ident)
        logits = A.both("_lp", f"coalesce(agg, {A.zeros('_lp')})", lambda a, b: f"{a} + {A.num(beta)} * {b}")
        change = f"array_max({A.both(p, '_old', lambda a, b: f'abs({a} - {b})')})"
        old = z.select(ident, F.col(p).alias("_old"))
        z = base.drop(p).join(agg, ident, "left").join(old, ident).withColumn(p, A.E(A.softmax(logits))) \
                .withColumn("_d", A.E(change)) \
                .select(ident, p, "_d")
        if step % every == 0 or step == iters:
            z = cut(z)
            if (z.agg(F.max("_d")).head()[0] or 0.0) < tol:
                break
        z = z.select(ident, p) if step % every else z
    return base.drop(p, "_lp").join(z.select(ident, p), ident)


def rebuild_features(emb: DataFrame, q: DataFrame, lam: float, f: str = "f", p: str = "p",
                     ident: str = "clip_id") -> DataFrame:
    """[f, lam * sqrt(q)] per row: the features of the next stage's graph."""
    joined = emb.join(q.select(ident, F.col(p).alias("_q")), ident)
    root = A.each("_q", lambda x: f"{A.num(lam)} * sqrt({x})")
    return joined.withColumn(f, A.E(f"concat({f}, {root})")).drop("_q")


def graph_features(emb: DataFrame, probs: DataFrame, gamma: float, by: str = "grp", f: str = "f", p: str = "p",
                   ident: str = "clip_id") -> DataFrame:
    """[unit(centred f), gamma * sqrt(v)] per row."""
    return rebuild_features(unit_by(emb, by, f), probs, gamma, f, p, ident)


def blend_evidence(q: DataFrame, evidence: Sequence[tuple[DataFrame, float]], parts: int, ident: str = "clip_id",
                   p: str = "p", gated: bool = False) -> DataFrame:
    """Inject one or more evidence tables by log-linear pooling, each with weight g / parts."""
    for v, g in evidence:
        if g == 0:
            continue
        gate = f"{A.num(g / parts)} * (1 - array_max({p}))" if gated else g / parts
        q = q.join(v.select(ident, F.col(p).alias("_v")), ident) \
             .withColumn(p, A.E(A.pool(p, "_v", gate))).drop("_v")
    return q


Hook = Callable[[DataFrame, int], DataFrame]
Rule = Callable[[DataFrame, DataFrame], DataFrame]


def multistage(probs: DataFrame, emb: DataFrame, stages: Sequence[float], k: int = 30, alpha: float = 0.75,
               iters: int = 5, temp: float = 1.0, conf_pow: float = 0.0, conf_alpha: float = 0.0,
               evidence: DataFrame | Sequence[tuple[DataFrame, float]] | None = None, g: float = 0.0,
               where: str = "none", rebuild_from: str = "current", truth: DataFrame | None = None, seed: int = 0,
               rule: Rule | None = None, hook: Hook | None = None,
               transform: Callable[[DataFrame], DataFrame] | None = None,
               by: str = "grp", ident: str = "clip_id", f: str = "f", p: str = "p",
               first_edges: DataFrame | None = None, centered: bool = False) -> DataFrame:
    """Refinement in stages: propagate, sharpen, inject evidence, rebuild the graph on [f, lam sqrt(Q)], repeat.

    ``where`` is none, last, once or every; the total evidence weight g is split over the injections. ``rebuild_from``
    names what the rebuilt graphs see: current, none (the first graph is kept), permuted, initial or truth. ``rule``
    replaces the propagation, ``hook(q, stage)`` runs after every stage, ``transform`` maps the embedding first.
    """
    from clipgraph.operators.vectors import permute_within

    sources = [] if evidence is None else [(evidence, g)] if isinstance(evidence, DataFrame) else list(evidence)
    parts = len(stages) + 1 if where == "every" else 1
    n = A.width_of(probs, p)
    run = rule or (lambda q, e: propagate(q, e, alpha, iters, conf_pow=conf_pow, conf_alpha=conf_alpha, by=by, ident=ident,
                                          p=p, weighted=True, ready=True, n_classes=n))
    probs = cut(probs)
    if transform is not None:
        emb = transform(emb)
    unit = cut((emb if centered else unit_by(emb, by, f)).select(by, ident, f))

    def stage(q: DataFrame, edges: DataFrame, inject: bool, number: int) -> DataFrame:
        q = run(q, edges).withColumn(p, A.E(A.sharpen(p, temp)))
        if inject:
            q = blend_evidence(q, sources, parts, ident, p)
        return cut(hook(q, number) if hook else q)

    counts = group_counts(unit, unit, by)  # the groups stay the same in every stage

    def graph(rows: DataFrame) -> DataFrame:
        return knn(rows, by, k, f, ident, center=False, counts=counts)

    # the built-in rule needs only the weights, so that is what gets written
    kept = (lambda e: cut(e)) if rule else (lambda e: cut(edge_weights(e).select("src", "dst", "w")))
    edges = kept(first_edges if first_edges is not None else graph(unit))
    q = stage(probs, edges, where in ("every", "once"), 0)
    for number, lam in enumerate(stages, 1):
        if rebuild_from != "none":
            source = {"current": q, "initial": probs, "truth": truth}.get(rebuild_from)
            if rebuild_from == "permuted":
                source = permute_within(q.select(by, ident, p), by, ident, [p], seed + number)
            edges = kept(graph(rebuild_features(unit, source, lam, f, p, ident)))
        q = stage(q, edges, where == "every", number)
    if where == "last":
        q = blend_evidence(q, sources, 1, ident, p)
    return q


def cascade(probs: DataFrame, emb: DataFrame, correct: Callable[[DataFrame], DataFrame], stages: Sequence[float],
            **options) -> DataFrame:
    """A second multi-stage pass over the corrected output of the first."""
    first = correct(multistage(probs, emb, stages, **options))
    return multistage(cut(first), emb, stages, **options)


def knn_smooth(probs: DataFrame, emb: DataFrame, k: int, alpha: float, iters: int, by: str = "grp",
               scaled: bool = False, **options) -> DataFrame:
    """Smoothing over the directed (not mutual) graph, optionally after per-dimension scaling."""
    from clipgraph.operators.vectors import zscore_by

    rows = zscore_by(emb, by) if scaled else emb
    edges = knn(rows, by, k, center=not scaled, is_mutual=False)
    return propagate(probs, edges, alpha, iters, by=by, **options)


def fuse_graphs(graphs: Sequence[DataFrame], weights: Sequence[float] | Column, sharp: float = 10.0) -> DataFrame:
    """Convex combination of row-normalised graphs as one weighted edge table."""
    parts = [edge_weights(g, sharp).select("src", "dst", (F.col("w") * F.lit(float(a))).alias("w"))
             for g, a in zip(graphs, weights) if a > 0]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate_fused(probs: DataFrame, graphs: Sequence[DataFrame], weights: Sequence[float], alpha: float = 0.75,
                    iters: int = 5, **options) -> DataFrame:
    return propagate(probs, fuse_graphs(graphs, weights), alpha, iters, weighted=True, **options)


def smoothness(probs: DataFrame, weighted: DataFrame, by: str = "grp", ident: str = "clip_id",
               p: str = "p") -> DataFrame:
    """sum_ij w_ij |q_i - q_j|^2 / 2 per group."""
    a = probs.select(by, F.col(ident).alias("src"), F.col(p).alias("_pa"))
    b = probs.select(F.col(ident).alias("dst"), F.col(p).alias("_pb"))
    far = A.let(A.sub("_pa", "_pb"), lambda d: A.dot(d, d))
    return weighted.select("src", "dst", "w").join(a, "src").join(b, "dst") \
                   .groupBy(by).agg(A.E(f"sum(w * {far}) / 2").alias("smoothness"))


def adaptive_weights(probs: DataFrame, graphs: Sequence[DataFrame], outer: int = 3, r: float = 2.0,
                     alpha: float = 0.75, iters: int = 5, by: str = "grp", ident: str = "clip_id",
                     p: str = "p") -> tuple[DataFrame, DataFrame]:
    """Per-group graph weights from inverse smoothness, alternated with propagation: (Q, weight table)."""
    weighted = [cut(edge_weights(g).select("src", "dst", "w")) for g in graphs]
    rows = probs.select(by, F.col(ident).alias("src"))
    table = cut(probs.select(by).distinct().withColumn("a", F.array(*[F.lit(1 / len(graphs))] * len(graphs))))
    q = probs
    for _ in range(outer):
        fused = None
        for i, g in enumerate(weighted):
            part = g.join(rows, "src").join(table, by).select("src", "dst", (F.col("w") * F.col("a")[i]).alias("w"))
            fused = part if fused is None else fused.unionByName(part)
        q = cut(propagate(probs, fused, alpha, iters, weighted=True, by=by, ident=ident, p=p))
        inv = None
        for i, g in enumerate(weighted):
            s = smoothness(q, g, by, ident, p).select(
                by, F.pow(1 / F.greatest("smoothness", F.lit(1e-12)), F.lit(1 / (r - 1))).alias(f"_i{i}"))
            inv = s if inv is None else inv.join(s, by)
        total = sum(F.col(f"_i{i}") for i in range(len(graphs)))
        table = cut(inv.select(by, F.array(*[F.col(f"_i{i}") / total for i in range(len(graphs))]).alias("a")))
    return q, table


def label_propagate(df: DataFrame, labelled: str, n_classes: int, by: str = "grp", k: int = 10, alpha: float = 0.9,
                    iters: int = 10, f: str = "f", ident: str = "clip_id", label: str = "label") -> DataFrame:
    """Spread the labels of rows where ``labelled`` is true to the others over clamped, row-normalised cosines."""
    edges = knn(df, by, k, f, ident)
    pos = edges.where("mutual").withColumn("w", F.greatest("sim", F.lit(0.0)))
    total = F.sum("w").over(Window.partitionBy("src"))
    pos = pos.withColumn("w", F.col("w") / (total + 1e-12))
    seed = A.E(f"IF({labelled}, {A.one_hot(label, n_classes)}, array_repeat(0D, {n_classes}))")
    return propagate(df.select(by, ident, label, labelled, seed.alias("p")), pos, alpha, iters, weighted=True, by=by,
                     ident=ident)


def average_by(probs: DataFrame, by, ident: str = "clip_id", p: str = "p") -> DataFrame:
    """Replace every row by the mean of its group (segment, label or cluster)."""
    n = A.width_of(probs, p)
    means = probs.groupBy(*keys(by)).agg(A.E(A.mean_array(p, n)).alias("_m"))
    return join_small(probs, means, keys(by)).withColumn(p, F.col("_m")).drop("_m")


def ensemble_runs(probs: DataFrame, how: str = "arith", ident: str = "clip_id", p: str = "p",
                  by: str = "grp") -> DataFrame:
    """Mean of the rows of several runs per clip, arithmetic or geometric."""
    n = A.width_of(probs, p)
    if how == "arith":
        mean = probs.groupBy(by, ident).agg(A.E(A.mean_array(p, n)).alias("_m"))
        return mean.select(by, ident, A.E(A.normalize("_m")).alias(p))
    logs = probs.withColumn("_l", A.E(A.log_each(p)))
    mean = logs.groupBy(by, ident).agg(A.E(A.mean_array("_l", n)).alias("_m"))
    return mean.select(by, ident, A.E(A.softmax("_m")).alias(p))


def components(edges: DataFrame, nodes: DataFrame, ident: str = "clip_id", max_rounds: int | None = None) -> DataFrame:
    """Connected components of an undirected edge table: (clip, component = smallest id).

    Every round takes the smallest neighbouring label and then the label's own label, so long chains shorten fast. Rounds go on until no label changes; a given limit that ends them earlier raises.
    """
    both = stored(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
               .distinct())
    labels = stored(nodes.select(ident, F.col(ident).alias("component")))
    for _ in rounds(max_rounds):
        near = both.join(labels.select(F.col(ident).alias("dst"), F.col("component").alias("_c")), "dst") \
                   .groupBy("src").agg(F.min("_c").alias("_near"))
        stepped = labels.join(near.withColumnRenamed("src", ident), ident, "left") \
                        .select(ident, F.col("component").alias("_old"),
                                F.least("component", F.coalesce("_near", "component")).alias("_c"))
        jump = stepped.select(F.col(ident).alias("_c"), F.col("_c").alias("_cc"))
        new = stored(stepped.join(jump, "_c", "left")
                  .select(ident, "_old", F.least("_c", F.coalesce("_cc", "_c")).alias("component")))
        changed = new.where(F.col("_old") != F.col("component")).limit(1).count()
        labels = new.select(ident, "component")
        if not changed:
            return labels
    raise RuntimeError(f"components: labels still change after {max_rounds} rounds")


def blend_cluster_mean(probs: DataFrame, clusters: DataFrame, rho: float, ident: str = "clip_id", p: str = "p",
                       by: str = "grp") -> DataFrame:
    """(1 - rho) p + rho * mean of p over the row's cluster."""
    n = A.width_of(probs, p)
    joined = probs.join(clusters, ident)
    means = joined.groupBy(by, "component").agg(A.E(A.mean_array(p, n)).alias("_m"))
    return join_small(joined, means, [by, "component"]).withColumn(
        p, A.E(A.both(p, "_m", lambda x, m: f"(1 - {A.num(rho)}) * {x} + {A.num(rho)} * {m}"))).drop("_m")
