"""Conversation repair, language identification and periodic runs against brute force on small tables."""
from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from clipgraph.llm import language, periodic, queries, turns
from clipgraph.registry.check import TABLES, compare

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


# ---- conversation repair

def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def brute_repair(rows):
    """All edits by dynamic programming over whole strings: no halves, no ranks."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        kept = SPACED.findall(text)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1][-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def closed(table):
        table = dict(table)
        for _ in range(3):
            for state, (c, edits, lines) in list(table.items()):
                new = (c + 2, edits + "I", (*lines, names[follow[state]] + ":"))
                if follow[state] not in table or new < table[follow[state]]:
                    table[follow[state]] = new
        return table

    # inserts are tried before every row, from every state, with whole strings compared
    for (_, _, role, text), fault in zip(rows, faults):
        options = []
        for state, (c, edits, lines) in best.items():
            at = state
            for _ in range(3):
                options.append((at, (c + 3, edits + "D", lines)))
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    if role[:1] == "s" and at == "" or role[:1] == follow[at]:
                        options.append((role[:1], (c + more, edits + "K", (*lines, f"{role}:{text}"))))
                    options.append((follow[at], (c + more + 2, edits + "R", (*lines, f"{names[follow[at]]}:{text}"))))
                c, edits, lines, at = c + 2, edits + "I", (*lines, names[follow[at]] + ":"), follow[at]
        best = {}
        for state, option in options:
            if state not in best or option[:2] < best[state][:2]:
                best[state] = option
    cost, audit, lines = min(v for k, v in closed(best).items() if k in ("", "a"))
    known = [t for _, t, _, _ in rows if t is not None]
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, n, most):
    rng, out = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randrange(1, most)):
            out.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "use"]),
                        rng.choice(["Yes.", "No", "what?", " ", "", None, "a b c!\n", "fin. x", f"t{turn}."])))
    return out + [(None, t, r, "x.") for t, r in enumerate(["user", "assistant"])] + [(2 ** 60 + 1, 1, "user", "big?"), (2 ** 60 + 1, 1, "user", "big?")]


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("stretch,fan", [(4096, 512), (2, 2)])
def test_repair_equals_brute_force(spark, stretch, fan):
    rows = conversations(5, 120, 9) + conversations(6, 0, 1) + [(7777, t, r, f"m{t}.") for t, r in enumerate(["system"] + ["user", "assistant", "user"] * 20)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id LONG, turn LONG, role STRING, text STRING, audit STRING, pos INT").repartition(3)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in turns.audit_damaged(docs, stretch, fan).collect()}
    broken = brute_damage(rows)
    want = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in broken if r[0] == conv]
        want[conv] = brute_repair(mine) if mine else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got == want


def test_repaired_rows_follow_the_grammar(spark):
    docs = spark.createDataFrame(conversations(9, 40, 7), "conv_id LONG, turn LONG, role STRING, text STRING")
    found = {}
    for r in turns.Repair(docs, 3, 2).repaired().collect():
        found.setdefault(r["conv_id"], []).append((r["place"], r["role"][0], r["edit"]))
    for listed in found.values():
        listed.sort()
        assert [p for p, _, _ in listed] == list(range(len(listed)))
        assert re.fullmatch("s?(ua)+", "".join(r for _, r, _ in listed)) and {e for _, _, e in listed} <= set("IKR")


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id LONG, turn LONG, role STRING, text STRING")
    assert turns.audit_damaged(empty).count() == 0


def test_halves_of_long_conversations():
    rng = random.Random(3)
    for _ in range(200):
        codes = [rng.randrange(9) for _ in range(rng.randrange(1, 40))] + [turns.END]
        # one pass with whole strings
        best = {turns.NOTHING: (0, "")}
        for code in codes:
            new = {}
            for y, (c, s) in best.items():
                for x, choice in enumerate(turns.CHOICES[code][y]):
                    if choice and (x not in new or (c + choice[0], s + choice[1]) < new[x]):
                        new[x] = (c + choice[0], s + choice[1])
            best = new
        done = list(turns.edits(codes, turns.NOTHING, turns.A))
        assert (sum(c for c, _, _ in done), "".join(s for _, s, _ in done)) == best[turns.A]
        cut_at = rng.randrange(1, len(codes) + 1)
        parts = [turns.fold([turns.TABLES[c] for c in p]) for p in (codes[:cut_at], codes[cut_at:]) if p]
        assert turns.fold(parts)[0] == turns.fold([turns.TABLES[c] for c in codes])[0]


# ---- language identification

WORDS = {"aa": "the and that with from this have were been which their would".split(), "bb": "der und das mit von dies haben waren sein welche ihre würde".split(),
         "cc": "el y que con desde esto tienen fueron sido cual sus haría".split()}


def sentences(rng, lang, n):
    return " ".join("".join(rng.sample(WORDS[lang], 1)) for _ in range(n)) + "."


def test_language_on_held_out_texts(spark):
    rng = random.Random(2)
    rows = [(i, sentences(rng, lang, rng.randrange(8, 60)), lang, "s", 0, "x") for i, lang in enumerate(rng.choices(list(WORDS), k=400))]
    odd = [(1000, None, "aa", "s", 0, "x"), (1001, "", "bb", "s", 0, "x"), (1002, "12 !? 3", "cc", "s", 0, "x"), (1003, sentences(rng, "bb", 9000), None, "s", 0, "x"),
           (1003, sentences(rng, "cc", 30), None, "s", 0, "x"), (None, "the and that with from this have been which", "aa", "s", 0, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id LONG, text STRING, lang STRING, source STRING, score INT, lang_pred STRING")
    known = language.fit(docs)
    assert set(known) == set(WORDS)
    got = language.identify(docs, known).collect()
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 50 and all(r["lang_pred"] == r["lang"] and not r["rejected"] for r in held)
    by_text = {r["text"]: r for r in got}
    for t in (None, "", "12 !? 3"):
        assert (by_text[t]["lang_pred"], by_text[t]["score"]) == ("und", 0.0)
    assert by_text[odd[3][1]]["lang_pred"] == "bb" and by_text[odd[4][1]]["lang_pred"] == "cc" and by_text[odd[5][1]]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_never_reads_the_held_out_fold(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, "some words here", "xx") for i in held], "doc_id LONG, text STRING, lang STRING")
    assert language.fit(docs) == {}
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in language.identify(docs, {}).collect()} == {("und", 0.0, True)}
    assert language.identify(docs.limit(0), {}).count() == 0


def test_language_sample_has_its_bounds(spark):
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 26)} " * 500, "xx") for i in range(300)], "doc_id LONG, text STRING, lang STRING")
    assert len(language.fit(docs, rows=16, size=1024)["xx"]) <= 1024


# ---- periodic runs

def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        v = rng.choice([1, 2, 3, 5, 20])
        w = [str(rng.randrange(v)) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) + 1)
            w[i:i] = [str(rng.randrange(v)) for _ in range(rng.randrange(1, 6))] * rng.randrange(2, 8)
        assert periodic.runs(w) == brute_runs(w)


def test_runs_of_a_table(spark):
    rng = random.Random(4)
    texts = [None, "", "one", "a " * 9, "a b c " * 3000, "x y x y x y x y z z z z z z", " \t\n"] + [" ".join(str(rng.randrange(4)) for _ in range(rng.randrange(90))) for _ in range(80)]
    ids = [*range(len(texts) - 2), None, 3]
    docs = spark.createDataFrame([(i, t, 5, "runs") for i, t in zip(ids, texts)], "doc_id LONG, text STRING, start INT, runs STRING")
    got = sorted(map(tuple, periodic.digest(periodic.detect(docs, plant=True)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)
    want = []
    for i, t in zip(ids, texts):
        w = SPACED.findall(t or "")
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute_runs(w)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        top = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1] or [(None, None, None)]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(found), *top[0], 1000 * top[0][1] // top[0][2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
                     sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert got == sorted(want, key=str)
    assert periodic.detect(docs.limit(0)).count() == 0


def test_queries_are_registered():
    assert {"op11_turns", "op12_language", "op13_runs"} <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert compare(queries.queries()[name](spark, folder), con, queries.oracle_sql()[name]) is None
