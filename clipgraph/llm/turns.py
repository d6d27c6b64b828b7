"""Repair of conversation structure by cheapest edits, with Hirschberg's divide and conquer.

A conversation should read ``(s?(ua)+)?`` in role initials: perhaps a system turn, then user and assistant in turn. Its rows may be
kept (0), given the role user or assistant (2) or deleted (3), empty user or assistant turns may be inserted (2), and a truncated row
that stays costs 1 more; blank and repeated rows must go. Four states (nothing yet, after s, after u, after a) describe what was built, so
a row is a four by four table of costs. Of all cheapest edits the one whose letters D, I, K, R come first in ASCII order is taken.

Reconstruction is linear in space: a forward cost vector to the middle and a backward one from it meet, the crossing state is the
one on a cheapest path whose letters so far come first, and both halves are solved the same way. Letters need not be kept for the comparison: beside each
state's cost stands the rank of its letters among the four states (no two states have equal letters, and none are a beginning of
others, since every row ends in one of D, K, R).

The same tables compose: a stretch of rows is again a four by four table of costs and ranks. A conversation is therefore cut into
stretches of at most ``stretch`` rows, which are folded to tables where they are; tables of ``fan`` stretches are folded again until one is left. Going back
down, Hirschberg on the tables gives every stretch its entry and exit state, and Hirschberg on its rows the edits. A conversation with any share of
all rows is spread over many tasks; no task holds more than ``stretch`` rows or ``fan`` tables.

Defined cases: null texts and roles are one space (hence blank, or a role that must change), a null turn sorts first and counts for no gap, null
conversation ids are one conversation. Rows of one turn are ordered by role, then text; identical rows are repeats of the first. An empty
table gives no rows. Input columns other than ``conv_id``, ``turn``, ``role`` and ``text`` are not read and cannot clash.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipgraph.session import cut

NOTHING, S, U, A = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEVER = 1 << 40
#: Rows by kind: the initial (other ones cannot be kept) and whether the row is whole, truncated or must go; END closes a conversation.
INITIALS = "sua?"
MUST_GO, END = 8, 9
BLANK = r"[^\x20\x09-\x0D]"
ROLES = {S: "system", U: "user", A: "assistant"}
INSERTED = {NOTHING: U, S: U, U: A, A: U}


def kind(initial: str, fault: int) -> int:
    """Number of a row's kind; fault 0 none, 1 truncated, 2 blank or repeated."""
    at = INITIALS.find(initial) if initial else -1
    return MUST_GO if fault == 2 else 2 * (at if at >= 0 else 3) + fault


def _choices(code: int) -> list[list[tuple[int, str] | None]]:
    """(cost, letters) from each state to each state over a row of this kind: inserts first, then the letter of the row."""
    out: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]

    def offer(y: int, x: int, cost: int, letters: str) -> None:
        if out[y][x] is None or (cost, letters) < out[y][x]:
            out[y][x] = (cost, letters)

    for y in range(4):
        state, paid, letters = y, 0, ""
        for _ in range(3):
            if code == END:
                if state in (NOTHING, A):
                    offer(y, A, paid, letters)
            else:
                offer(y, state, paid + DELETE, letters + "D")
                if code != MUST_GO:
                    initial, more = INITIALS[code // 2], TRUNCATED * (code % 2)
                    if initial == "s" and state == NOTHING:
                        offer(y, S, paid + KEEP + more, letters + "K")
                    if initial == "sua"[INSERTED[state] - 1]:
                        offer(y, INSERTED[state], paid + KEEP + more, letters + "K")
                    offer(y, INSERTED[state], paid + REROLE + more, letters + "R")
            state, paid, letters = INSERTED[state], paid + INSERT, letters + "I"
    return out


CHOICES = [_choices(c) for c in range(10)]


def _table(code: int) -> tuple[list[list[int]], list[list[int]]]:
    """Costs and, from each state, the rank of the letters to every state."""
    costs, ranks = [], []
    for row in CHOICES[code]:
        order = sorted((x for x in range(4) if row[x]), key=lambda x: row[x][1])
        costs.append([row[x][0] if row[x] else NEVER for x in range(4)])
        ranks.append([order.index(x) if row[x] else 0 for x in range(4)])
    return costs, ranks


TABLES = [_table(c) for c in range(10)]


def forward(items: Sequence, lo: int, hi: int, entry: int) -> tuple[list[int], list[int]]:
    """Least cost to each state after items [lo, hi), and the rank of its first letters among the states."""
    cost, rank = [NEVER] * 4, [0] * 4
    cost[entry] = 0
    for i in range(lo, hi):
        c, r = items[i]
        new, order = [NEVER] * 4, []
        for x in range(4):
            best = min((cost[y] + c[y][x], rank[y], y) for y in range(4))
            if best[0] < NEVER:
                new[x] = best[0]
                order.append((best[1], r[best[2]][x], x))
        order.sort()
        cost, rank = new, [0] * 4
        for n, (_, _, x) in enumerate(order):
            rank[x] = n
    return cost, rank


def backward(items: Sequence, lo: int, hi: int, leave: int) -> list[int]:
    """Least cost from each state before items [lo, hi) to the state ``leave`` after them."""
    cost = [NEVER] * 4
    cost[leave] = 0
    for i in range(hi - 1, lo - 1, -1):
        c = items[i][0]
        cost = [min(NEVER, *(c[y][x] + cost[x] for x in range(4))) for y in range(4)]
    return cost


def crossings(items: Sequence, entry: int, leave: int) -> list[int]:
    """The state after every item on the cheapest, first path from ``entry`` to ``leave``."""
    out = [leave] * len(items)
    open_ = [(0, len(items), entry, leave)]
    while open_:
        lo, hi, start, end = open_.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        (cost, rank), rest = forward(items, lo, mid, start), backward(items, mid, hi, end)
        x = min(range(4), key=lambda x: (cost[x] + rest[x], rank[x]))
        out[mid - 1] = x
        open_ += [(lo, mid, start, x), (mid, hi, x, end)]
    return out


def fold(items: Sequence) -> tuple[list[list[int]], list[list[int]]]:
    """One table for a stretch of items."""
    both = [forward(items, 0, len(items), y) for y in range(4)]
    return [c for c, _ in both], [r for _, r in both]


def edits(codes: Sequence[int], entry: int, leave: int) -> Iterator[tuple[int, str, int]]:
    """Cost and letters of every row (inserts before it included) and the state they start from."""
    state = entry
    for code, x in zip(codes, crossings([TABLES[c] for c in codes], entry, leave)):
        yield *CHOICES[code][state][x], state
        state = x


def ordered(docs: DataFrame) -> DataFrame:
    """Rows in the order of conversations and turns with ``pos``, spread evenly whatever the sizes of conversations.

    Conversation ids are strings from here on: integers beside nulls would lose digits in pandas.
    """
    given = docs.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    # rows that agree in everything may lie in different partitions: their number in the input is the last key
    salted = given.withColumn("_s", F.monotonically_increasing_id())
    by = ["conv_id", "turn", "role", "text", "_s"]
    return cut(salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("_s").withColumn("pos", F.monotonically_increasing_id()))


def damaged(docs: DataFrame) -> DataFrame:
    """The rows as the contract of the query damages them, by a number drawn from conversation and turn."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    d = docs.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key.cast("binary")) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_d").where("_d <> 0")
    return d.withColumn("_n", F.explode(F.when(F.col("_d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_n", "_d")


def fault_of(text: Column) -> Column:
    """2 without a visible character, 1 when the last one is not . ! or ?, else 0."""
    return F.when(~text.rlike(BLANK), 2).when(text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), 0).otherwise(1)


LEAF = ("conv_id STRING, lo LONG, hi LONG, codes BINARY, costs ARRAY<LONG>, ranks ARRAY<LONG>, first STRING, last STRING, "
        "n_blank LONG, n_duplicate LONG, n_truncated LONG, n_illegal LONG")
LEGAL = {"su", "ua", "au"}


def stretches(rows: DataFrame, stretch: int) -> DataFrame:
    """One row per stretch of a conversation: kinds of its rows, its table and its counts."""
    block = F.struct(F.shiftright("pos", 33).alias("p"), F.floor(F.col("pos").bitwiseAND(F.lit((1 << 33) - 1)) / stretch).alias("b"))
    thin = rows.select("pos", "conv_id", F.substring("role", 1, 1).alias("initial"), fault_of(F.col("text")).alias("fault"), "role", F.sha2("text", 256).alias("_t"))
    seen = thin.where("fault < 2").groupBy("conv_id", "role", "_t").agg(F.min("pos").alias("pos"))
    marks = seen.select("pos", "conv_id", F.lit("").alias("initial"), F.lit(-1).alias("fault"))
    both = thin.select(*marks.columns).unionByName(marks).withColumn("_b", block)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        firsts = set(f["pos"][f["fault"] == -1])
        f = f[f["fault"] >= 0].sort_values("pos")
        out, last = [], None
        for pos, conv, initial, fault in zip(f["pos"], f["conv_id"].to_numpy(dtype=object), f["initial"], f["fault"]):
            conv = None if pd.isna(conv) else conv
            repeated = fault < 2 and pos not in firsts
            if last is None or conv != last[0]:
                last = [conv, pos, pos, [], initial, initial, 0, 0, 0, 0]
                out.append(last)
            else:
                last[9] += last[5] + initial not in LEGAL
                last[2], last[5] = pos, initial
            last[3].append(kind(initial, 2 if repeated else fault))
            last[6] += fault == 2
            last[7] += repeated
            last[8] += fault == 1 and not repeated
        done = []
        for conv, lo, hi, codes, *rest in out:
            costs, ranks = fold([TABLES[c] for c in codes])
            done.append((conv, lo, hi, bytes(codes), sum(costs, []), sum(ranks, []), *rest))
        return pd.DataFrame(done, columns=["conv_id", "lo", "hi", "codes", "costs", "ranks", "first", "last", "n_blank", "n_duplicate", "n_truncated", "n_illegal"])

    return cut(both.groupBy("_b").applyInPandas(run, LEAF))


def _square(flat: Sequence[int]) -> list[list[int]]:
    return [[int(v) for v in flat[i:i + 4]] for i in (0, 4, 8, 12)]


def routed(leaves: DataFrame, fan: int) -> DataFrame:
    """Entry and exit state of every stretch; ``final`` marks the last one of its conversation."""
    def up(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("nth")
        costs, ranks = fold([(_square(c), _square(r)) for c, r in zip(f["costs"], f["ranks"])])
        return pd.DataFrame({"conv_id": f["conv_id"].to_numpy()[:1], "nth": f["_up"].to_numpy()[:1], "lo": f["lo"].to_numpy()[:1], "costs": [sum(costs, [])], "ranks": [sum(ranks, [])]})

    def down(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("nth")
        final, items = bool(f["final"].iloc[0]), [(_square(c), _square(r)) for c, r in zip(f["costs"], f["ranks"])]
        entry, leave = int(f["entry"].iloc[0]), int(f["leave"].iloc[0])
        path = crossings(items + [TABLES[END]] if final else items, entry, A if final else leave)[:len(items)]
        last = [final and i == len(items) - 1 for i in range(len(items))]
        return pd.DataFrame({"_c": f["conv_id"].to_numpy(), "_n": f["nth"].to_numpy(), "lo": f["lo"].to_numpy(), "entry": [entry, *path[:-1]],
                             "leave": [-1 if z else x for x, z in zip(path, last)], "final": last})

    many = leaves.groupBy("conv_id").count()
    sized = leaves.join(many.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    whole = sized.where("count = 1").select("conv_id", "lo", F.lit(NOTHING).alias("entry"), F.lit(-1).alias("leave"), F.lit(True).alias("final"))
    # only conversations of several stretches climb: one row per stretch, numbered in order
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("lo")) - 1
    levels = [cut(sized.where("count > 1").select("conv_id", nth.cast("long").alias("nth"), "lo", "costs", "ranks"))]
    while levels[-1].where("nth > 0").head(1):
        keyed = levels[-1].withColumn("_up", F.floor(F.col("nth") / fan))
        levels.append(cut(keyed.groupBy("conv_id", "_up").applyInPandas(up, "conv_id STRING, nth LONG, lo LONG, costs ARRAY<LONG>, ranks ARRAY<LONG>")))
    states = levels[-1].select(F.col("conv_id").alias("_c"), F.col("nth").alias("_n"), F.lit(NOTHING).alias("entry"), F.lit(-1).alias("leave"), F.lit(True).alias("final"))
    for level in reversed(levels[:-1]):
        keyed = level.withColumn("_up", F.floor(F.col("nth") / fan))
        joined = keyed.join(states.drop("lo"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_up") == F.col("_n"))).drop("_c", "_n")
        states = cut(joined.groupBy("conv_id", "_up").applyInPandas(down, "_c STRING, _n LONG, lo LONG, entry INT, leave INT, final BOOLEAN"))
    if len(levels) == 1:
        return whole
    return whole.unionByName(states.select(F.col("_c").alias("conv_id"), "lo", "entry", "leave", "final"))


def solved(leaves: DataFrame, fan: int) -> DataFrame:
    """conv_id, lo, letters of every row of each stretch with the state before them, and the closing inserts of a conversation."""
    routes = routed(leaves, fan).select(F.col("lo").alias("_lo"), "entry", "leave", "final")
    todo = leaves.select("conv_id", "lo", "codes").join(routes, F.col("lo") == F.col("_lo")).drop("_lo")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for conv, lo, codes, entry, leave, final in zip(f["conv_id"].to_numpy(dtype=object), f["lo"], f["codes"], f["entry"], f["leave"], f["final"]):
                done = list(edits([*codes, END] if final else list(codes), entry, A if final else leave))
                out.append((conv, lo, sum(c for c, _, _ in done), [x for _, x, _ in done], [s for _, _, s in done]))
            yield pd.DataFrame(out, columns=["conv_id", "lo", "cost", "letters", "states"])

    return cut(todo.mapInPandas(run, "conv_id STRING, lo LONG, cost LONG, letters ARRAY<STRING>, states ARRAY<INT>"))


class Repair:
    """Repaired conversations: ``summary`` per conversation, ``stretches`` with the letters, ``rows`` in order."""

    def __init__(self, docs: DataFrame, stretch: int = 4096, fan: int = 512):
        self.kind = docs.schema["conv_id"].dataType
        self.rows = ordered(docs)
        self.leaves = stretches(self.rows, stretch)
        self.solved = solved(self.leaves, fan)

    def summary(self) -> DataFrame:
        """conv_id, gaps, counts of faults, illegal neighbours and the cost, by sums over stretches."""
        turns = self.rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("_span"))
        some = self.rows.where("turn IS NOT NULL").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count("*").alias("_n"))
        before = F.lag("last").over(Window.partitionBy("conv_id").orderBy("lo"))
        edge = F.when(before.isNotNull() & ~F.concat(before, F.col("first")).isin(*LEGAL), 1).otherwise(0)
        counts = self.leaves.drop("codes", "costs", "ranks").withColumn("_edge", edge).groupBy("conv_id").agg(
            F.sum("n_blank").alias("blank"), F.sum("n_duplicate").alias("duplicate"), F.sum("n_truncated").alias("truncated"),
            (F.sum("n_illegal") + F.sum("_edge")).alias("illegal"))
        cost = self.solved.groupBy("conv_id").agg(F.sum("cost").alias("cost"))
        out = turns
        for side in (some, counts, cost):
            side = side.withColumnRenamed("conv_id", "_c")
            out = out.join(side, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
        return out.select(F.col("conv_id").cast(self.kind).alias("conv_id"), (F.col("_span") - F.coalesce("_n", F.lit(0))).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost")

    def lines(self) -> DataFrame:
        """conv_id, pos, part, letters and state of edits (part 0) and role and text of rows (part 1); inserts that close a conversation have no row."""
        e = self.solved.select("conv_id", "lo", F.posexplode(F.arrays_zip("letters", "states")).alias("i", "e"))
        e = e.select("conv_id", (F.col("lo") + F.col("i")).alias("pos"), F.lit(0).alias("part"), F.col("e.letters").alias("letters"), F.col("e.states").alias("state"),
                     F.lit("").alias("role"), F.lit("").alias("text"))
        r = self.rows.select("conv_id", "pos", F.lit(1).alias("part"), F.lit("").alias("letters"), F.lit(0).alias("state"), "role", "text")
        # an edit of a row comes right before it; closing inserts stand at the position after the last row, before any row of another conversation
        return e.unionByName(r)

    def merged(self, each: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
        """Apply ``each`` to (conv_id, edit, role, text) in order, one conversation after the other, streamed."""
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def events() -> Iterator[tuple]:
                letters, state = "", 0
                for f in frames:
                    for conv, part, now, at, role, text in zip(f["conv_id"].to_numpy(dtype=object), f["part"], f["letters"], f["state"], f["role"], f["text"]):
                        if part == 0:
                            letters, state = now, at
                            if not now or now[-1] == "I":  # closing inserts
                                yield (None if pd.isna(conv) else conv), letters, state, None, None
                        else:
                            yield (None if pd.isna(conv) else conv), letters, state, role, text

            out = []
            for row in each(events()):
                out.append(row)
                if len(out) == 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

        names = [c.split()[0] for c in schema.split(", ")]
        return self.lines().repartition("conv_id").sortWithinPartitions("conv_id", "pos", "part").mapInPandas(run, schema).withColumn("conv_id", F.col("conv_id").cast(self.kind))

    def repaired(self) -> DataFrame:
        """The rows of the repaired conversations: conv_id, place, role, text and the edit that made them (I, K, R)."""
        def each(events: Iterator) -> Iterator:
            last, place = object(), 0
            for conv, letters, state, role, text in events:
                if conv != last:
                    last, place = conv, 0
                for letter, name, words in turns_of(letters, state, role, text):
                    yield conv, place, name, words, letter
                    place += 1

        return self.merged(each, "conv_id STRING, place LONG, role STRING, text STRING, edit STRING")

    def digest(self) -> DataFrame:
        """conv_id, the audit (letters in order) and the hash of the repaired rows; a conversation passes through its task as a stream."""
        def each(events: Iterator) -> Iterator:
            last, some, audit, sha, started = None, False, [], hashlib.sha256(), False
            for conv, letters, state, role, text in events:
                if not started or conv != last:
                    if started:
                        yield last, "".join(audit), sha.hexdigest()
                    last, some, audit, sha, started = conv, False, [], hashlib.sha256(), True
                audit.append(letters)
                for _, name, words in turns_of(letters, state, role, text):
                    sha.update(f"{chr(10) if some else ''}{name}:{words}".encode("utf-8", "surrogatepass"))
                    some = True
            if started:
                yield last, "".join(audit), sha.hexdigest()

        return self.merged(each, "conv_id STRING, audit STRING, repaired_sha256 STRING")


def turns_of(letters: str, state: int, role: str | None, text: str | None) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of the turns that the letters of one row leave."""
    for letter in letters:
        if letter == "D":
            continue
        new = INSERTED[state]
        if letter == "K" and role is not None and role[:1] == "s":
            new = S
        yield letter, role if letter == "K" else ROLES[new], "" if letter == "I" else text
        state = new


def audit(docs: DataFrame, stretch: int = 4096, fan: int = 512) -> DataFrame:
    """Summary, audit and hash of every conversation that has rows."""
    done = Repair(docs, stretch, fan)
    side = done.digest().withColumnRenamed("conv_id", "_c")
    return done.summary().join(side, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")


def audit_damaged(docs: DataFrame, stretch: int = 4096, fan: int = 512) -> DataFrame:
    """Damage the rows, then audit every original conversation; one that lost all rows has zeros."""
    ids = docs.select("conv_id").distinct()
    found = audit(damaged(docs), stretch, fan).withColumnRenamed("conv_id", "_c")
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
