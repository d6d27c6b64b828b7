"""Secret scans: fixed patterns and a randomness test battery. Built-in functions only.

Three patterns (assigned values, access keys, long hex) give base spans. The battery looks at other long tokens: the
encoding is the narrowest alphabet that holds the token (hex, base32 and base36 in either case, alphanumeric, base64), without dashes and padding; chi-squared uniformity over that alphabet and the serial
correlation of neighbouring symbols must not contradict a random string; the runs test gives a p-value under the
hypothesis of an ordinary word, where letter case and digits seldom alternate. Long tokens carry a larger weight, and a
false-discovery threshold over the whole corpus decides. The threshold needs only a histogram of p-values (a bounded number of bins).

Offsets are code points, end exclusive. Null texts count as empty and have no spans. Rows are independent of each other and never shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgraph.llm.common import text_of
from clipgraph.session import cut

#: Patterns and the least length of their value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = (("assign", ASSIGN, 1, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
BINS_PER_UNIT, BINS = 8, 400


def places(kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """Array of (start, kind rank, end, kind, match): leftmost non-overlapping matches whose value is long enough.

    The pieces between the matches give the offsets: a match starts after all earlier pieces and matches.
    """
    whole = F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all("_t", F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split("_t", pattern, -1).alias("piece"), whole.alias("match"), value.alias("value"))
    empty = F.expr("named_struct('at', 0, 'out', cast(array() AS array<struct<start:int,rank:int,end:int,kind:string,match:string>>))")

    def step(s, x):
        start = s["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    # most texts hold no long enough match; the cheap test spares them the walk
    some = {"assign": F.col("_t").rlike(pattern), "access": F.col("_t").contains("AKIA"), "hex": F.col("_t").rlike("[0-9a-f]{32}")}.get(kind, F.col("_t").rlike(pattern))
    return F.when(some, F.aggregate(parts, empty, step, lambda s: s["out"])).otherwise(empty["out"])


#: Alphabets from narrow to wide: name, pattern of the whole token, number of symbols. Separators and padding are no symbols.
ENCODINGS = (("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", 16), ("base32", "^(?:[A-Z2-7]+|[a-z2-7]+)$", 32), ("base36", "^(?:[0-9A-Z]+|[0-9a-z]+)$", 36), ("alnum", "^[0-9A-Za-z]+$", 62))


def symbols(body: Column) -> Column:
    """Size of the narrowest alphabet that holds the whole body."""
    out = F.lit(64.0)
    for _, pattern, k in reversed(ENCODINGS):
        out = F.when(body.rlike(pattern), float(k)).otherwise(out)
    return out


def battery(span: Column) -> Column:
    """(start, rank, end, kind, weighted -log10 p) of a token; null when a test contradicts randomness."""
    bare = F.regexp_replace(span["match"], "=+$", "")
    dashed = F.regexp_replace(bare, "[-_]", "")
    # separators between runs of hex, base32 or base36 symbols are not part of the string; elsewhere they are symbols of base64
    token = F.when(dashed.rlike("^(?:[0-9A-Z]+|[0-9a-z]+)$"), dashed).otherwise(bare)
    n = F.length(token).cast("double")
    k = symbols(token)
    chars = F.split(token, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double"))
    chi2 = k / n * F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c) - n
    uniform = chi2 <= (k - 1) + 3.1 * F.sqrt(2 * (k - 1))
    codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
    mean = F.aggregate(codes, F.lit(0.0), lambda s, c: s + c) / n
    var = F.aggregate(codes, F.lit(0.0), lambda s, c: s + (c - mean) * (c - mean))
    serial = F.aggregate(F.zip_with(codes, F.slice(codes, 2, F.length(token)), lambda a, b: F.coalesce((a - mean) * (b - mean), F.lit(0.0))),
                         F.lit(0.0), lambda s, c: s + c) / F.greatest(var, F.lit(1e-9))
    independent = F.abs(serial + 1 / n) <= 3.3 / F.sqrt(n)
    kinds = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 1).when(c.rlike("[a-z]"), 2).when(c.rlike("[A-Z]"), 3).otherwise(4))
    switches = F.aggregate(F.zip_with(kinds, F.slice(kinds, 2, F.length(token)), lambda a, b: F.coalesce((a != b).cast("double"), F.lit(0.0))),
                           F.lit(0.0), lambda s, c: s + c)
    # Chernoff bound on the tail of a binomial with the switch rate of ordinary tokens
    rate, q = switches / (n - 1), F.lit(0.12)
    share = F.least(rate, F.lit(0.999999))
    tail = F.when(rate <= q, 0.0).otherwise((n - 1) * (share * F.log10(share / q) + (1 - share) * F.log10((1 - share) / (1 - q))))
    weight = F.least(n / 32, F.lit(2.0))
    return F.when(uniform & independent & (tail > 0), F.struct(span["start"].alias("start"), F.lit(3).alias("rank"), span["end"].alias("end"),
                                                             F.lit("random").alias("kind"), (tail + F.log10(weight)).alias("strength")))


def threshold(cands: DataFrame, level: float) -> float:
    """Benjamini-Hochberg over all tokens tested, from a histogram of -log10 p; infinite when nothing passes."""
    bins = F.least(F.floor(F.greatest(F.col("s"), F.lit(0.0)) * BINS_PER_UNIT), F.lit(BINS))
    rows = (cands.select("_tested", F.col("_random.strength").alias("ss"))
            .select(F.explode(F.concat(F.col("ss"), F.array_repeat(F.lit(0.0), F.greatest(F.col("_tested") - F.size("ss"), F.lit(0))))).alias("s"))
            .groupBy(bins.alias("b")).count().orderBy(F.desc("b")).collect())
    total, above, best = sum(r["count"] for r in rows), 0, float("inf")
    for r in rows:
        above += r["count"]
        if 10.0 ** (-r["b"] / BINS_PER_UNIT) <= level * above / total:
            best = r["b"] / BINS_PER_UNIT
    return best


def scan(docs: DataFrame, level: float = 0.001, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all when None) with ``base`` and ``all_spans``: arrays of (start, rank, end, kind) ordered by start, then kind."""
    base = F.array_sort(F.concat(*[places(k, p, g, least, i) for i, (k, p, g, least) in enumerate(KINDS)]))
    d = docs.withColumn("_t", text_of(text)).withColumn("_base", base)
    free = F.filter(places("random", TOKEN, 0, 20, 3), lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    d = d.withColumn("_tokens", free).withColumn("_tested", F.size("_tokens"))
    d = d.withColumn("_random", F.filter(F.transform("_tokens", battery), lambda x: x.isNotNull()))
    plain = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    # only what the caller keeps is written, and the spans without their matches
    d = cut(d.select(*(docs.columns if keep is None else keep), F.transform("_base", plain).alias("_base"), "_random", "_tested"))
    limit = threshold(d, level)
    found = F.filter("_random", lambda s: s["strength"] >= F.lit(limit))
    return (d.withColumn("base", F.col("_base"))
            .withColumn("all_spans", F.array_sort(F.concat(F.col("base"), F.transform(found, plain)))).drop("_base", "_random", "_tested"))


def listing(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """Replace every found span by the mask; overlapping spans are covered together. The columns stay as they are."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, x):
        apart = x["start"] >= s["at"]
        gap = F.substring(F.col("_row.text"), s["at"] + 1, x["start"] - s["at"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(apart, F.concat(s["out"], gap, F.lit(mask))).otherwise(s["out"]).alias("out"))

    done = F.aggregate("all_spans", start, step, lambda s: F.concat(s["out"], F.substring(F.col("_row.text"), s["at"] + 1, F.length("_row.text"))))
    # the row travels as one struct, so no column of the input can clash with the scan's own
    rows = scan(docs.select(F.struct(*docs.columns).alias("_row")), text="_row.text")
    clean = F.when(F.size("all_spans") > 0, done).otherwise(F.col("_row.text"))
    new = {"text": clean, "n_chars": F.when(F.size("all_spans") > 0, F.length(clean)).otherwise(F.col("_row.n_chars"))} if "n_chars" in docs.columns else {"text": clean}
    return rows.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
