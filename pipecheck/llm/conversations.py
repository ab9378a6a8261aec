"""Conversations with broken turns are aligned to the grammar of roles and repaired (operator 12)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipecheck.llm.common import SPACES, SQL_SPACES, hash128, sql_crc32, table
from pipecheck.llm.ranks import group_key, placed
from pipecheck.session import written

# The costs of the edits, in the order of their letters.
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
# A conversation is aligned in segments of so many rows.
ROWS = 64

# States of the grammar (s?(ua)+)?: nothing yet, behind s, behind u, behind a pair. The first and the last may end it.
STATES = (0, 1, 2, 3)
ENDS = (0, 3)
AFTER = {"s": 1, "u": 2, "a": 3}

_NEVER = float("inf")

ENTRIES = "array<struct<p: int, q: int, cost: bigint, audit: string>>"


def next_role(state: int) -> str:
    return "a" if state == 2 else "u"


class Alignment:
    """One segment against the tails of the string ...uaua (or ...auau) that end in state ``q``.

    ``cost[i][r]`` is the cheapest way to turn the rows from ``i`` on into the last ``r`` letters: a Wagner-Fischer matrix counted
    from the end, so one matrix holds the targets of all lengths. Rows and letters that are this far apart in number cost more than
    ``bound``, the cost of a known repair, are outside of the band (Ukkonen) and never made. Insertions stand before a row, so behind
    the last row only where the conversation ends.
    """

    def __init__(self, rows: list[tuple[str, str]], q: int, last: bool, bound: int):
        self.rows, self.last, n = rows, last, len(rows)
        self.letters = "ua" if q == 2 else "au"
        wider, narrower = bound // INSERT, bound // DELETE
        self.cost: list[dict[int, int]] = [{} for _ in range(n + 1)]
        self.cost[n] = {r: INSERT * r for r in range(wider + 1)} if last else {0: 0}
        for i in range(n - 1, -1, -1):
            initial, fault = rows[i]
            below, own = self.cost[i + 1], self.cost[i]
            for r in range(max(0, n - i - narrower), n - i + wider + 1):
                best = below.get(r, _NEVER) + DELETE
                if r:
                    best = min(best, own.get(r - 1, _NEVER) + INSERT)
                    if fault not in "bd":
                        best = min(best, below.get(r - 1, _NEVER) + self.emit(initial, fault, r))
                if best < _NEVER:
                    own[r] = best

    def letter(self, r: int) -> str:
        return self.letters[(r + 1) % 2]

    def emit(self, initial: str, fault: str, r: int) -> int:
        return (0 if initial == self.letter(r) else REROLE) + (CUT_OFF if fault == "t" else 0)

    def audit(self, i: int, r: int) -> str:
        """The ASCII-least cheapest edits from cell (i, r) on: at each cell the least letter that keeps the cost."""
        out, n = [], len(self.rows)
        while i < n or r:
            now = self.cost[i][r]
            if i < n and self.cost[i + 1].get(r, _NEVER) + DELETE == now:
                out.append("D")
                i += 1
            elif r and (i < n or self.last) and self.cost[i].get(r - 1, _NEVER) + INSERT == now:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.rows[i][0] == self.letter(r) else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def _known_cost(rows: list[tuple[str, str]], role: str) -> int:
    """Cost of the plain repair that deletes what it must and gives all other rows the roles in turn."""
    cost = 0
    for initial, fault in rows:
        if fault in "bd":
            cost += DELETE
        else:
            cost += (0 if initial == role else REROLE) + (CUT_OFF if fault == "t" else 0)
            role = "a" if role == "u" else "u"
    return cost


def alignments(codes: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(p, q, cost, audit) of the best repair of a segment from state p to state q, for all that can be.

    ``codes`` has two letters a row: s, u, a or x for the role's initial, then b, d, t or - for the fault. Every feasible
    length of the target is looked at; lengths of equal cost are backtraced and their audits compared.
    """
    rows = list(zip(codes[::2], codes[1::2], strict=True))
    n = len(rows)
    # At most two insertions lead from the plain repair into any wanted state.
    bound = max(_known_cost(rows, "u"), _known_cost(rows, "a")) + 2 * INSERT
    systems = [(i, CUT_OFF if fault == "t" else 0) for i, (initial, fault) in enumerate(rows) if initial == "s" and fault not in "bd"]
    found = []
    for q in STATES:
        if last and q not in ENDS:
            continue
        if q in (0, 1):
            if q == 0 or not first:
                found.append((q, q, DELETE * n, "D" * n))
            if q == 1 and systems:
                cost, audit = min((DELETE * (n - 1) + extra, "D" * i + "K" + "D" * (n - 1 - i)) for i, extra in systems)
                found.append((0, 1, cost, audit))
            continue
        grid = Alignment(rows, q, last, bound)
        for p in (0,) if first else STATES:
            begins = next_role(p)
            ways = [(c, 0, r) for r, c in grid.cost[0].items() if (grid.letter(r) == begins if r else p == q)]
            if p == 0:
                # The system turn: what stands before it goes, what follows is a target of its own.
                for i, extra in systems:
                    ways += [(DELETE * i + extra + c, i + 1, r) for r, c in grid.cost[i + 1].items() if r and grid.letter(r) == "u"]
            if ways:
                least = min(c for c, _, _ in ways)
                audit = min(("D" * (i - 1) + "K" if i else "") + grid.audit(i, r) for c, i, r in ways if c == least)
                found.append((p, q, least, audit))
    return found


def row_faults(turns: DataFrame) -> DataFrame:
    """conv, turn, role, h1, h2, place, size, fault of every row of ``turns``, as a written table.

    ``conv`` is the conversation's key, h1 and h2 a 128-bit hash of the text, place the row's number in its conversation.
    fault is the first of blank, duplicate and truncated, by its letter, or -.
    """
    text = F.coalesce("text", F.lit(" "))
    shown = F.rtrim(text, F.lit(SPACES))
    h1, h2 = hash128(text)
    ends = F.substring(shown, -1, 1).isin(*".!?")
    own = F.when(shown == "", "b").when(~ends, "t").otherwise("-")
    keys = turns.select(
        group_key(F.col("conv_id")).alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), h1.alias("h1"), h2.alias("h2"), own.alias("own")
    )
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("h1"), F.col("h2")]
    places = written(placed(written(keys, "turn-keys"), "conv", order, "turn-places"), "turn-ranks")
    same = ["conv", "role", "h1", "h2"]
    repeats = places.groupBy(*same).agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    fault = F.when((F.col("own") != "b") & (F.col("place") > F.col("first")), "d").otherwise(F.col("own"))
    return written(places.join(repeats, same, "left").select(*same, "turn", "place", "size", fault.alias("fault")), "turn-faults")


def segment_options(faults: DataFrame, rows: int = ROWS) -> DataFrame:
    """conv, seg, n_segs, codes, counts and the best repairs between any two states of each segment, as a written table.

    Rows reach Python as one short text a segment. Its first two letters may be the last row of the segment before, for the
    roles that meet there. The counts are blank, duplicate, truncated and illegal.
    """
    initial = F.substring("role", 1, 1)
    code = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), "fault")
    # The last row of a segment also stands, as a neighbour, in the next one.
    ahead = F.when(F.col("place") % rows == rows - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = faults.select("conv", "place", "size", code.alias("code"), F.explode(ahead).alias("ahead"))
    dealt = dealt.withColumn("seg", F.expr(f"place div {rows}") + F.col("ahead"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "code")))
    segments = dealt.groupBy("conv", "seg").agg(
        F.array_join(F.transform(ordered, lambda r: r["code"]), "").alias("codes"), F.max("ahead").alias("met"), F.max("size").alias("size"),
        F.count_if(F.col("ahead") == 0).alias("n"),
    ).filter("n > 0")
    n_segs = F.expr(f"(size + {rows - 1}) div {rows}")

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, bool, bool], list] = {}
        for batch in batches:
            out = []
            for conv, seg, codes, met, n in zip(batch["conv"], batch["seg"], batch["codes"], batch["met"], batch["n_segs"], strict=True):
                initials = codes[::2]
                illegal = sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))
                own = codes[2:] if met else codes
                key = (own, seg == 0, seg == n - 1)
                if key not in known:
                    if len(known) > 100_000:
                        known.clear()
                    entries = alignments(*key)
                    if n == 1:
                        entries = [min(entries, key=lambda e: (e[2], e[3]))]
                    known[key] = [dict(zip(("p", "q", "cost", "audit"), e, strict=True)) for e in entries]
                faults = own[1::2]
                out.append((conv, seg, n, own, faults.count("b"), faults.count("d"), faults.count("t"), illegal, known[key]))
            yield pd.DataFrame(out, columns=["conv", "seg", "n_segs", "codes", "blank", "duplicate", "truncated", "illegal", "entries"])

    schema = f"conv string, seg bigint, n_segs bigint, codes string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, entries {ENTRIES}"
    return written(segments.select("conv", "seg", "codes", "met", n_segs.alias("n_segs")).mapInPandas(aligned, schema), "segment-options")


def chosen_repairs(options: DataFrame) -> DataFrame:
    """``options`` with the one entry of each segment that the cheapest repair of its conversation takes, as a written table.

    The segments of a long conversation pass one task from its end, which keeps the best cost behind each state, and then from its
    start, which follows the choices: four numbers are held, however long it is. Audits of equal cost differ within the segment,
    as each ends with a row's letter, so the least one there is the least on the whole.
    """

    def backwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, behind = None, {}
        for batch in batches:
            out = []
            for conv, seg, entries in zip(batch["conv"], batch["seg"], batch["entries"], strict=True):
                if conv != at:
                    at, behind = conv, dict.fromkeys(ENDS, 0)
                best = {}
                for k, e in enumerate(entries):
                    if e["q"] in behind:
                        way = (e["cost"] + behind[e["q"]], e["audit"], k, e["q"])
                        best[e["p"]] = min(best.get(e["p"], way), way)
                behind = {p: way[0] for p, way in best.items()}
                out.append((conv, seg, [best[p][2] if p in best else -1 for p in STATES], [best[p][3] if p in best else -1 for p in STATES]))
            yield pd.DataFrame(out, columns=["conv", "seg", "picks", "leads"])

    def forwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, 0
        for batch in batches:
            out = []
            for conv, seg, picks, leads in zip(batch["conv"], batch["seg"], batch["picks"], batch["leads"], strict=True):
                if conv != at:
                    at, state = conv, 0
                out.append((conv, seg, picks[state]))
                state = leads[state]
            yield pd.DataFrame(out, columns=["conv", "seg", "pick"])

    long = options.filter("n_segs > 1").select("conv", "seg", "entries")
    back = long.repartition("conv").sortWithinPartitions("conv", F.desc("seg")).mapInPandas(
        backwards, "conv string, seg bigint, picks array<int>, leads array<int>"
    )
    picks = written(back.sortWithinPartitions("conv", "seg").mapInPandas(forwards, "conv string, seg bigint, pick int"), "segment-picks")
    met = options.join(picks, ["conv", "seg"], "left").withColumn("entry", F.get("entries", F.coalesce("pick", F.lit(0))))
    return written(met.select(*options.drop("entries").columns, "entry.p", "entry.cost", "entry.audit"), "segment-repairs")


def row_decisions(repairs: DataFrame, rows: int = ROWS) -> DataFrame:
    """conv, place, op, new_role, before, after of every row: its letter, its role if that changes, and the roles inserted beside it."""

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = {"u": "user", "a": "assistant"}
        for batch in batches:
            out = []
            for conv, seg, codes, state, audit in zip(batch["conv"], batch["seg"], batch["codes"], batch["p"], batch["audit"], strict=True):
                place, before = seg * rows, ""
                for op in audit:
                    initial = codes[2 * (place - seg * rows)] if op == "K" else next_role(state)
                    if op != "D":
                        state = AFTER[initial]
                    if op == "I":
                        before += initial
                        continue
                    out.append([conv, place, op, names[initial] if op == "R" else None, before, ""])
                    place, before = place + 1, ""
                if before:
                    out[-1][-1] = before
            yield pd.DataFrame(out, columns=["conv", "place", "op", "new_role", "before", "after"])

    schema = "conv string, place bigint, op string, new_role string, before string, after string"
    return repairs.select("conv", "seg", "codes", "p", "audit").mapInPandas(steps, schema)


def repaired_turns(turns: DataFrame, faults: DataFrame, decisions: DataFrame) -> DataFrame:
    """conv, position, op, role, text of the repaired conversations, each in one partition and in order.

    Only here texts are shuffled, once. In the sorted rows of a conversation each text stands before the decisions on
    the rows that have it, so one text is held at a time, whatever the conversation's length.
    """
    text = F.coalesce("text", F.lit(" "))
    h1, h2 = hash128(text)
    own = turns.select(group_key(F.col("conv_id")).alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), h1.alias("h1"), h2.alias("h2"), text.alias("text"))
    told = faults.join(decisions, ["conv", "place"]).select("conv", "turn", "role", "h1", "h2", "place", "op", "new_role", "before", "after")
    stream = own.unionByName(told, allowMissingColumns=True).repartition("conv").sortWithinPartitions(
        "conv", F.asc_nulls_first("turn"), "role", "h1", "h2", F.asc_nulls_first("place")
    )

    def repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = {"u": "user", "a": "assistant"}
        at, position, held = None, 0, None
        for batch in batches:
            out = []
            for conv, role, text, op, new_role, before, after in zip(
                *(batch[c] for c in ("conv", "role", "text", "op", "new_role", "before", "after")), strict=True
            ):
                if conv != at:
                    at, position = conv, 0
                if op is None:
                    held = text
                    continue
                lines = [("I", names[c], "") for c in before]
                if op != "D":
                    lines.append((op, new_role or role, held))
                lines += [("I", names[c], "") for c in after]
                for line in lines:
                    out.append((conv, position, *line))
                    position += 1
            yield pd.DataFrame(out, columns=["conv", "position", "op", "role", "text"])

    plain = stream.select("conv", "role", "text", "op", "new_role", "before", "after")
    return plain.mapInPandas(repaired, "conv string, position bigint, op string, role string, text string")


def text_digests(repaired: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of ``repaired_turns``: a running SHA-256 of ``role:text``, joined by newlines.

    SHA-256 goes from the first byte to the last, so a conversation passes one task; nothing of it is kept.
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest = None, None
        for batch in batches:
            out = []
            for conv, role, text in zip(batch["conv"], batch["role"], batch["text"], strict=True):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if conv == at:
                    digest.update(b"\n" + line)
                    continue
                if digest:
                    out.append((at, digest.hexdigest()))
                at, digest = conv, hashlib.sha256(line)
            yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
        if digest:
            yield pd.DataFrame([(at, digest.hexdigest())], columns=["conv", "repaired_sha256"])

    return repaired.select("conv", "role", "text").mapInPandas(digests, "conv string, repaired_sha256 string")


def repair_conversations(turns: DataFrame, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """One row of findings per conversation of ``turns`` (conv_id, turn, role, text), and the repaired turns.

    Findings: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. Turns: conv, position, op (K, R, I), role, text.
    ``conv`` is ``group_key(conv_id)``; a null conv_id is a conversation too. Rows stand by turn, null first; those of one turn by role
    and then by a hash of the text. Null roles and texts are one space. Rows that are all deleted leave no turns. Other columns
    are not read. A conversation of any length is cut into segments that are aligned one by one.
    """
    faults = row_faults(turns)
    repairs = chosen_repairs(segment_options(faults, rows))
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    audits = F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda s: s["audit"])
    totals = repairs.groupBy("conv").agg(*(F.sum(c).alias(c) for c in counts), F.array_join(audits, "").alias("audit"))
    turn = F.col("turn")
    missing = faults.filter("turn is not null").select("conv", "turn").distinct().groupBy("conv").agg((F.max(turn) - F.min(turn) + 1 - F.count("*")).alias("gaps"))
    findings = totals.join(missing, "conv", "left").select("conv", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), *counts, "audit")
    return findings, repaired_turns(turns, faults, row_decisions(repairs, rows))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` as the query damages them, by the CRC-32 of ``conv_id:turn``: rows dropped, emptied, cut off, repeated or given to the user."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(kind == 4, "user").otherwise(shown("role"))
    kept = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return kept.select("conv_id", "turn", "role", "text", F.explode(copies).alias("copy")).drop("copy")


def op12_conversations(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    findings, repaired = repair_conversations(damaged(turns))
    ids = turns.select("conv_id", group_key(F.col("conv_id")).alias("conv")).distinct()
    met = ids.join(findings, "conv", "left").join(text_digests(repaired), "conv", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return met.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def _behind(op: str, cost: str, way: str) -> str:
    return f"{{'c': {way}.c + {cost}, 's': '{op}' || {way}.s}}"


def _best(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _row_ways(p: int) -> str:
    """The best over a row's own letter from state p, by the best ways behind it (o0 to o3)."""
    keeps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[p]
    free = [f"CASE WHEN initial = '{c}' THEN {_behind('K', 'extra', f'o{q}')} END" for c, q in keeps.items()]
    free.append(_behind("R", "2 + extra", "o3" if p == 2 else "o2"))
    return _best(_behind("D", "3", f"o{p}"), *(f"CASE WHEN fault NOT IN ('b', 'd') THEN {w} END" for w in free))


# From the last row to the first: for each state of the grammar the cheapest edits behind it, equal costs by the least text.
SQL = f"""
WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM marked WHERE kind <> 0
), placed AS (
  SELECT *, coalesce(':' || conv_id, '') AS conv, rtrim(text, {SQL_SPACES}) AS shown,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM damaged
), faults AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN shown = '' THEN 'b'
      WHEN place > min(place) OVER (PARTITION BY conv, role, text) THEN 'd' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault
  FROM placed
), rows_ AS (
  SELECT *, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS extra,
    lag(initial) OVER (PARTITION BY conv ORDER BY place) || initial NOT IN ('su', 'ua', 'au') AS broken FROM faults
), ways AS (
  SELECT DISTINCT conv, n AS i, {{'c': 0::BIGINT, 's': ''}} AS v0, {{'c': 4::BIGINT, 's': 'II'}} AS v1, {{'c': 2::BIGINT, 's': 'I'}} AS v2, {{'c': 0::BIGINT, 's': ''}} AS v3 FROM rows_
  UNION ALL
  SELECT conv, i, {_best('b0', _behind('I', '2', _best('b2', _behind('I', '2', 'b3'))))}, {_best('b1', _behind('I', '2', _best('b2', _behind('I', '2', 'b3'))))},
    {_best('b2', _behind('I', '2', 'b3'))}, {_best('b3', _behind('I', '2', 'b2'))}
  FROM (SELECT conv, i, {_row_ways(0)} AS b0, {_row_ways(1)} AS b1, {_row_ways(2)} AS b2, {_row_ways(3)} AS b3
    FROM (SELECT r.conv, w.i - 1 AS i, v0 AS o0, v1 AS o1, v2 AS o2, v3 AS o3, initial, fault, extra FROM ways w JOIN rows_ r ON r.conv = w.conv AND r.place = w.i))
), found AS (
  SELECT conv, v0.c AS cost, v0.s AS audit FROM ways WHERE i = 0
), letters AS (
  SELECT conv, audit, k, audit[k] AS op FROM (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS k FROM found)
), lines AS (
  SELECT *, sum((op <> 'I')::INT) OVER w AS place, sum((op <> 'D')::INT) OVER w AS j, sum((op <> 'D')::INT) OVER (PARTITION BY conv) AS m
  FROM letters WINDOW w AS (PARTITION BY conv ORDER BY k ROWS UNBOUNDED PRECEDING)
), repaired AS (
  SELECT l.conv, sha256(string_agg(CASE WHEN op = 'K' THEN r.role WHEN (j + m) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN op = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY k)) AS sha
  FROM lines l LEFT JOIN rows_ r ON r.conv = l.conv AND r.place = l.place WHERE op <> 'D' GROUP BY l.conv
), counted AS (
  SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (broken) AS illegal FROM rows_ GROUP BY conv
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(':' || conv_id, '') AS conv FROM conversations) o
LEFT JOIN counted USING (conv) LEFT JOIN found USING (conv) LEFT JOIN repaired USING (conv)
"""

QUERIES = {"op12_conversations": (op12_conversations, SQL)}
