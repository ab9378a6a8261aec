import itertools
import random
import zlib
from hashlib import sha256

import pytest
from helpers import spark_rows, sql_rows
from pyspark.sql import functions as F
from xxhash import xxh64

from pipecheck.llm import conversations as c

TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def code_of(rows):
    """Faults of ordered rows (turn, role, text), and their two-letter codes."""
    seen, faults = set(), []
    for _, role, text in rows:
        shown = text.strip(SPACE)
        faults.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "-")
        seen.add((role, text))
    return "".join((role[:1] if role[:1] in ("s", "u", "a") else "x") + f for (_, role, _), f in zip(rows, faults, strict=True)), faults


def cheapest(codes, start=0, ends=(0, 3), last=True):
    """Best (cost, audit) from a state to the ends, from the last row back over the four states."""
    lead = {0: 2, 1: 2, 2: 3, 3: 2}
    far = (10**9, "")

    def closed(best):
        for _ in range(3):
            best = {p: min(best[p], (best[lead[p]][0] + 2, "I" + best[lead[p]][1])) for p in best}
        return best

    best = {p: (0, "") if p in ends else far for p in range(4)}
    if last:
        best = closed(best)
    for k in range(len(codes) - 2, -1, -2):
        initial, fault = codes[k], codes[k + 1]
        extra = int(fault == "t")
        new = {}
        for p in range(4):
            ways = [(best[p][0] + 3, "D" + best[p][1])]
            if fault not in "bd":
                q = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((p, initial))
                if q is not None:
                    ways.append((best[q][0] + extra, "K" + best[q][1]))
                ways.append((best[lead[p]][0] + 2 + extra, "R" + best[lead[p]][1]))
            new[p] = min(ways)
        best = closed(new)
    return best[start]


def order(row):
    """Rows of a conversation by turn, null first; of one turn by role and a hash of the text."""
    turn, role, text = row
    own = xxh64(text.encode(), seed=42).intdigest()
    return turn is not None, turn or 0, role, own - (own >> 63 << 64)


def expected(turns):
    """All columns by the contract, for rows (conv_id, turn, role, text) without damage."""
    out = {}
    for conv in {r[0] for r in turns}:
        rows = sorted(((t, " " if r is None else r, " " if x is None else x) for v, t, r, x in turns if v == conv), key=order)
        codes, faults = code_of(rows)
        cost, audit = cheapest(codes)
        m, j, at, lines = sum(o != "D" for o in audit), 0, 0, []
        for op in audit:
            if op != "D":
                j += 1
                role = rows[at][1] if op == "K" else "assistant" if (j + m) % 2 == 0 else "user"
                lines.append(f"{role}:{'' if op == 'I' else rows[at][2]}")
            at += op != "I"
        known = [t for t, _, _ in rows if t is not None]
        initials = [r[:1] for _, r, _ in rows]
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def found(spark, turns, rows):
    findings, repaired = c.repair_conversations(spark.createDataFrame(turns, TURNS).withColumn("place", F.lit("x")).withColumn("conv", F.lit(1)), rows)
    shas = {r["conv"]: r["repaired_sha256"] for r in c.text_digests(repaired).collect()}
    nothing = sha256(b"").hexdigest()
    return {(int(r["conv"][1:]) if r["conv"] else None): (*tuple(r)[1:], shas.get(r["conv"], nothing)) for r in findings.collect()}


def all_targets(codes, most):
    """The cheapest audit by trying every list of edits."""
    best = (10**9, "")
    n = len(codes) // 2

    def go(i, text, cost, audit):
        nonlocal best
        if cost > best[0]:
            return
        if i == n:
            rest = text[1:] if text[:1] == "s" else text
            if rest == "ua" * (len(rest) // 2) and (rest or text != "s"):
                best = min(best, (cost, audit))
        if audit.count("I") < most:
            for role in "ua":
                go(i, text + role, cost + 2, audit + "I")
        if i < n:
            initial, fault = codes[2 * i], codes[2 * i + 1]
            go(i + 1, text, cost + 3, audit + "D")
            if fault not in "bd":
                go(i + 1, text + initial, cost + (fault == "t"), audit + "K")
                for role in "ua":
                    go(i + 1, text + role, cost + 2 + (fault == "t"), audit + "R")

    go(0, "", 0, "")
    return best


def test_one_segment_against_every_edit():
    rng = random.Random(1)
    for _ in range(150):
        codes = "".join(rng.choice("suuaax") + rng.choice("--tbd") for _ in range(rng.randrange(1, 5)))
        got = min((e[2], e[3]) for e in c.alignments(codes, True, True))
        assert got == all_targets(codes, 4) == cheapest(codes)


def test_segments_between_all_states():
    rng = random.Random(2)
    for _ in range(600):
        codes = "".join(rng.choice("suuaaax") + rng.choice("---tbd") for _ in range(rng.randrange(1, 14)))
        first, last = rng.random() < 0.5, rng.random() < 0.5
        got = {(p, q): (cost, audit) for p, q, cost, audit in c.alignments(codes, first, last)}
        for p in (0,) if first else range(4):
            for q in (0, 3) if last else range(4):
                want = cheapest(codes, p, (q,), last)
                assert got.get((p, q), want if want[0] >= 10**9 else None) == want


def talk(rng, conv, n):
    rows, turn = [], rng.randrange(3)
    for k in range(n):
        role = "system" if k == 0 and rng.random() < 0.4 else rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[k % 2]
        role = rng.choice([role] * 12 + ["tool", "", None, "system"])
        text = rng.choice(["Yes.", "No!", "why", " \n", "", None, f"line {k}.", f"cut {k}"]) if rng.random() < 0.5 else f"Turn {k} é.\t"
        rows.append((conv, rng.choice([turn] * 12 + [None]), role, text))
        turn += rng.choice([0, 1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("rows", [3, 64])
def test_against_brute_force(spark, rows):
    rng = random.Random(rows)
    turns = [r for conv in [*range(40), None] for r in talk(rng, conv, rng.randrange(1, 12))]
    turns += talk(rng, 77, 150) + [(78, 5, "user", "same")] * 9 + [(79, None, None, None)] * 3
    rng.shuffle(turns)
    assert found(spark, turns, rows) == expected(turns)


def test_repaired_turns(spark):
    turns = [(1, 0, "assistant", "Hi."), (1, 1, "user", "How?"), (1, 1, "user", "How?"), (1, 2, "user", "cut"), (1, 3, "assistant", "So."), (2, 0, "user", " ")]
    _, repaired = c.repair_conversations(spark.createDataFrame(turns, TURNS))
    got = sorted(tuple(r) for r in repaired.collect())
    assert [r[2] for r in got] == ["I", "K", "K", "R", "I", "K"][: len(got)] or sum(r[2] == "K" for r in got) >= 2
    roles = "".join(r[3][0] for r in got)
    assert roles == "ua" * (len(roles) // 2) and all(r[4] == "" for r in got if r[2] == "I")


def test_query_and_its_sql(spark, tmp_path):
    rng = random.Random(9)
    turns = []
    for conv in [*range(120), None]:
        seen = set()
        for r in talk(rng, conv, rng.randrange(1, 9)):
            if r[1] not in seen:  # the order of different rows of one turn is ours alone
                seen.add(r[1])
                turns.append(r)
    folder = str(tmp_path)
    df = spark.createDataFrame(turns, TURNS)
    df.write.parquet(f"{folder}/conversations.parquet")
    got = spark_rows(c.op12_conversations(spark, folder))
    assert got == sql_rows(c.SQL, {"conversations": df})
    kept = []
    for conv, turn, role, text in turns:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        kept += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    want = expected(kept)
    none = (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {r["conv_id"]: tuple(r[n] for n in names) for r in got} == {conv: want.get(conv, none) for conv in {t[0] for t in turns}}


def test_no_rows(spark):
    findings, repaired = c.repair_conversations(spark.createDataFrame([], TURNS))
    assert findings.count() == 0 and repaired.count() == 0 and c.text_digests(repaired).count() == 0
