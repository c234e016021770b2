"""Repair of the turn structure of conversations by error-correcting Earley parsing.

A well-formed conversation is an optional system turn followed by pairs of a
user and an assistant turn. The grammar below says so over the initials of
roles, and three kinds of error productions let a row be deleted, get another
role, or be inserted. Chart items keep the least (cost, audit), where the audit
holds the initials of the edits made so far; the completed chart's audit fixes
the repair, as the grammar leaves one role open at each place.
"""

from __future__ import annotations

import hashlib
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Grammar over role initials. A nonterminal stands only first on a right side, so every item begins in column 0 and a column holds a dozen items at most.
RULES = (("all", ("conversation", "$")), ("conversation", ()), ("conversation", ("turns",)), ("turns", ("turns", "u", "a")), ("turns", ("u", "a")), ("turns", ("s", "u", "a")))
#: What edits cost, and what a truncated row costs that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Roles that edits can give.
ROLES = {"u": "user", "a": "assistant"}
#: An item that costs this much more than another of its column can't win: the other gets to where it stands by two inserts, and a system row it can't take any more by a delete.
SLACK = 2 * INSERT + DELETE
#: Letters of an audit from which the part that all items share is handed over.
SETTLE = 256

_HEADS = {head for head, _ in RULES}
_FIRST = {b: [k for k, (_, right) in enumerate(RULES) if right[:1] == (b,)] for b in _HEADS}


class Chart:
    """The newest column of the chart of one conversation: (rule, dot) -> (cost, audit)."""

    def __init__(self) -> None:
        self.column = self._closed({(k, 0): (0, "") for k in range(len(RULES))})

    @staticmethod
    def _closed(column: dict) -> dict:
        """Completions and insert productions, until no item of the column gets better."""
        todo = deque(column)
        while todo:
            k, dot = item = todo.popleft()
            (head, right), (cost, audit) = RULES[k], column[item]
            if dot == len(right):  # those that wait for this nonterminal stand in column 0, at no cost
                found = [((p, 1), (cost, audit)) for p in _FIRST[head]]
            elif right[dot] in ROLES:
                found = [((k, dot + 1), (cost + INSERT, audit + "I"))]
            else:
                continue
            for other, weight in found:
                if other not in column or weight < column[other]:
                    column[other] = weight
                    todo.append(other)
        return column

    def row(self, initial: str, must_go: bool, truncated: bool) -> str:
        """Takes one row; returns the letters of the audit that are settled by now."""
        column, extra = {}, TRUNCATED * truncated

        def offer(item: tuple, weight: tuple) -> None:
            if item not in column or weight < column[item]:
                column[item] = weight

        for (k, dot), (cost, audit) in self.column.items():
            right = RULES[k][1]
            if dot == len(right) or right[dot] in _HEADS:
                continue
            offer((k, dot), (cost + DELETE, audit + "D"))
            if not must_go and right[dot] == initial:
                offer((k, dot + 1), (cost + extra, audit + "K"))
            if not must_go and right[dot] in ROLES:
                offer((k, dot + 1), (cost + REROLE + extra, audit + "R"))
        least = min(cost for cost, _ in column.values())
        self.column = self._closed({i: w for i, w in column.items() if w[0] <= least + SLACK})
        audits = [a for _, a in self.column.values()]
        if len(audits[0]) < SETTLE:
            return ""
        low, high = min(audits), max(audits)
        same = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        if same:
            self.column = {i: (cost, a[same:]) for i, (cost, a) in self.column.items()}
        return low[:same]

    def end(self) -> tuple[int, str]:
        """Cost of the repair and the letters not handed over yet."""
        return self.column[0, 1]


class Repair:
    """Repairs one conversation, row by row; `edits` come out as soon as they are settled."""

    def __init__(self) -> None:
        self.chart, self.waiting, self.next = Chart(), deque(), "u"
        self.first, self.cost = True, 0

    def row(self, row: dict) -> list[dict]:
        self.waiting.append(row)
        fault = row["fault"]
        return self._edits(self.chart.row((row["role"] or " ")[:1], fault in ("blank", "duplicate"), fault == "truncated"))

    def end(self) -> list[dict]:
        self.cost, rest = self.chart.end()
        return self._edits(rest)

    def _edits(self, letters: str) -> list[dict]:
        out = []
        for x in letters:
            row = {"turn": None, "text": "", "fault": None} if x == "I" else self.waiting.popleft()
            if x in "RI":
                row = row | {"role": ROLES[self.next]}
            if x != "D":
                system = x == "K" and self.first and row["role"][:1] == "s"
                self.next = "u" if system or self.next == "a" else "a"
                self.first = False
            out.append(row | {"edit": x})
        return out


def mark_faults(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text, present) with `fault`, one conversation after the other within partitions, in order.

    Order: by turn, nulls first, then role and text. A row's first fault counts:
    `blank` (no character but white space), `duplicate` (role and text seen
    earlier in the conversation), `truncated` (the last character that is not
    white space is none of `.!?`); else null. Rows with `present` false have
    none and stand for a conversation that would else vanish. One exchange, by
    conversation: Spark's sorts spill, so a conversation of any length is
    streamed, never held.
    """
    space = F.lit(" \t\n\x0b\x0c\r")
    bare = F.rtrim("text", space)
    seen = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    dealt = turns.select("conv_id", "turn", "role", "text", "present").repartition("conv_id")
    fault = F.when(~F.col("present"), None).when(bare == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    placed = dealt.withColumn("nth", F.row_number().over(seen)).withColumn("fault", fault)
    return placed.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth").drop("nth")


def _conversations(batches):
    """(conv_id, rows) of a partition in which conversations lie one after the other; rows come as they are read."""
    last, began = None, False
    for b in batches:
        for row in b.to_pylist():
            new = not began or row["conv_id"] != last
            last, began = row["conv_id"], True
            yield new, row


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _prepared(turns: DataFrame) -> DataFrame:
    """Null roles and texts become one space; without a column `present`, every row is there."""
    present = F.col("present") if "present" in turns.columns else F.lit(True)
    return mark_faults(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), present.alias("present")))


def repair_turns(turns: DataFrame) -> DataFrame:
    """The cheapest edits: one row for each, `conv_id`, `seq` (from 0), `edit` (K, R, D or I), `turn`, `role`, `text`, `fault`.

    Rows with edit D are those that go; all others, by `seq`, are the repaired
    conversation. Ties between edits go to the least string of their initials.
    Takes `turns` (conv_id, turn, role, text; further columns are ignored);
    null ids make one conversation. A null role or text counts as one space. An
    empty table gives an empty one. Time is linear in the rows but for rows of
    neither role in long stretches, whose texts wait until the parse decides.
    """
    schema = T.StructType([
        turns.schema["conv_id"], T.StructField("seq", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("turn", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in ("role", "text", "fault")),
    ])

    def run(batches):
        arrow, out, repair, key, seq = None, [], None, None, 0

        def numbered(edits):
            nonlocal seq
            for e in edits:
                out.append({"conv_id": key, "seq": seq, **{c: e[c] for c in ("edit", "turn", "role", "text", "fault")}})
                seq += 1

        for new, row in _conversations(batches):
            if new:
                if repair:
                    numbered(repair.end())
                repair, key, seq = Repair(), row["conv_id"], 0
            if row["present"]:
                numbered(repair.row(row))
            if len(out) >= 1_000:
                yield _table(out, arrow := arrow or to_arrow)
                out.clear()
        if repair:
            numbered(repair.end())
        if out:
            yield _table(out, to_arrow)

    to_arrow = _arrow(schema)
    return _prepared(turns).mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repair_report(turns: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, the cost and audit of its repair and a digest of the repaired rows.

    `gaps` (turn numbers missing between the least and the greatest),
    `blank`, `duplicate`, `truncated` (rows by first fault), `illegal`
    (neighbours whose role initials are not su, ua or au), `cost`, `audit` and
    `repaired_sha256` (`role:text` of the repaired rows, joined by newlines).
    A conversation without rows has zeros and empty strings. Handles what
    `repair_turns` handles.
    """
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([turns.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in counts), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    to_arrow = _arrow(schema)

    class Report:
        def __init__(self, key):
            self.key, self.repair, self.sha, self.audit, self.begun = key, Repair(), hashlib.sha256(), [], False
            self.n, self.low, self.high, self.turns, self.before = dict.fromkeys(counts, 0), None, None, 0, None

        def take(self, edits):
            for e in edits:
                self.audit.append(e["edit"])
                if e["edit"] != "D":
                    self.sha.update((("\n" if self.begun else "") + e["role"] + ":" + e["text"]).encode())
                    self.begun = True

        def row(self, row):
            turn, initial = row["turn"], row["role"][:1]
            if turn is not None and turn != self.high:  # rows come by turn
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            if row["fault"]:
                self.n[row["fault"]] += 1
            self.n["illegal"] += self.before is not None and self.before + initial not in ("su", "ua", "au")
            self.before = initial
            self.take(self.repair.row(row))

        def end(self):
            self.take(self.repair.end())
            self.n["cost"] = self.repair.cost
            if self.low is not None:
                self.n["gaps"] = self.high - self.low + 1 - self.turns
            return {"conv_id": self.key, **self.n, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}

    def run(batches):
        out, report = [], None
        for new, row in _conversations(batches):
            if new:
                if report:
                    out.append(report.end())
                report = Report(row["conv_id"])
            if row["present"]:
                report.row(row)
            if len(out) >= 1_000:
                yield _table(out, to_arrow)
                out.clear()
        if report:
            out.append(report.end())
        if out:
            yield _table(out, to_arrow)

    return _prepared(turns).mapInArrow(run, schema)


def damage(turns: DataFrame) -> DataFrame:
    """`turns` with faults put in by crc32(`conv_id:turn`) % 20, and `present` false for rows that are dropped.

    0 drops the row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats it, 4
    gives it the role user. Nulls count as one space.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "UTF-8")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(spaced("role"))
    out = turns.withColumn("kind", kind).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), "kind")
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("copy", "kind")


def op13_earley_repair(spark, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the stated damage."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_report(damage(turns))


_SPACE = r"[^\x20\x09-\x0D]"
#: By another route than the chart: least (cost, audit) of the four states of an automaton (nothing yet, after s, after u, after a), folded over the rows.
OP13_SQL = rf"""
WITH base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c, x:
      list_reduce(range(8), lambda h, i: CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END, xor(c, ord(x)::BIGINT)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM base, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS r(i) WHERE kind <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM ordered),
marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{_SPACE}') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
listed AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'i': left(role, 1), 'role': role, 'text': text, 'gone': fault IN ('blank', 'duplicate'), 'more': CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END}} ORDER BY pos) AS rows
  FROM marked GROUP BY conv_id),
-- each state after a row: delete it, or take it from the state before; then inserts
parsed AS (
  SELECT *, list_reduce(rows, lambda z, r: list_transform([list_transform([{{
        'n': {{'c': z.n.c + 4, 'a': z.n.a || 'D'}},
        's': least({{'c': z.s.c + 4, 'a': z.s.a || 'D'}}, {{'c': CASE WHEN NOT r.gone AND r.i = 's' THEN z.n.c + r.more ELSE 1000000000 END, 'a': z.n.a || 'K'}}),
        'u': least({{'c': z.u.c + 4, 'a': z.u.a || 'D'}}, list_min(list_transform([z.n, z.s, z.a], lambda p:
              {{'c': CASE WHEN r.gone THEN 1000000000 WHEN r.i = 'u' THEN p.c + r.more ELSE p.c + 3 + r.more END, 'a': p.a || CASE WHEN r.i = 'u' THEN 'K' ELSE 'R' END}}))),
        'a': least({{'c': z.a.c + 4, 'a': z.a.a || 'D'}}, {{'c': CASE WHEN r.gone THEN 1000000000 WHEN r.i = 'a' THEN z.u.c + r.more ELSE z.u.c + 3 + r.more END, 'a': z.u.a || CASE WHEN r.i = 'a' THEN 'K' ELSE 'R' END}})
      }}], lambda v: {{'n': v.n, 's': v.s, 'a': v.a, 'u': least(v.u, {{'c': v.n.c + 3, 'a': v.n.a || 'I'}}, {{'c': v.s.c + 3, 'a': v.s.a || 'I'}}, {{'c': v.a.c + 3, 'a': v.a.a || 'I'}})}})[1]],
      lambda v: {{'n': v.n, 's': v.s, 'u': least(v.u, {{'c': v.a.c + 3, 'a': v.a.a || 'I'}}), 'a': least(v.a, {{'c': v.u.c + 3, 'a': v.u.a || 'I'}})}})[1],
      {{'n': {{'c': 0, 'a': ''}}, 's': {{'c': 1000000000, 'a': ''}}, 'u': {{'c': 3, 'a': 'I'}}, 'a': {{'c': 6, 'a': 'II'}}}}) AS z
  FROM listed),
best AS (SELECT *, least(z.n, z.a) AS won FROM parsed),
-- the audit walked again, with the rows it uses up and the role that is due
walked AS (
  SELECT *, list_reduce(string_split(won.a, ''), lambda w, x: {{
      'k': w.k + CASE WHEN x = 'I' THEN 0 ELSE 1 END,
      'due': CASE WHEN x = 'D' OR x = '' THEN w.due WHEN w.first AND x = 'K' AND rows[w.k].i = 's' THEN 'user' WHEN w.due = 'user' THEN 'assistant' ELSE 'user' END,
      'first': w.first AND x IN ('D', ''),
      'out': CASE WHEN x = 'D' OR x = '' THEN w.out ELSE w.out || CASE WHEN w.first THEN '' ELSE chr(10) END
         || CASE x WHEN 'K' THEN rows[w.k].role || ':' || rows[w.k].text WHEN 'R' THEN w.due || ':' || rows[w.k].text ELSE w.due || ':' END END
    }}, {{'k': 1, 'due': 'user', 'first': true, 'out': ''}}) AS w
  FROM best),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(won.c, 0)::BIGINT AS cost, coalesce(won.a, '') AS audit, sha256(coalesce(w.out, '')) AS repaired_sha256
FROM ids i LEFT JOIN walked ON i.conv_id IS NOT DISTINCT FROM walked.conv_id
"""
