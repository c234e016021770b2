"""Chat formatting: records of many layouts become canonical turns, and turns become marked text with a loss mask.

A record's nested field paths are hashed; the fingerprint selects a declarative
mapping, which says where roles and texts lie. Formatted text comes in pieces of
bounded size, and can be read back without loss.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import private_name, settle

# ---- layouts ----

#: A mapping is a list of steps, each one of
#:   ("turn", role, path, ...)            one turn of a fixed role; texts of further paths that are there and not empty follow after a blank line
#:   ("each", array, role path, text path) a turn for each element
#:   ("pairs", array, role, role)          a turn for each text of each inner array, the roles in turn
#: Paths marked with ? may be missing. `[]` stands for the elements of an array.
MAPPINGS = {
    "turn_row": [("each", "", "role", "text")],
    "prompt_response": [("turn", "system", "system?"), ("turn", "user", "prompt"), ("turn", "assistant", "response")],
    "prompt_completion": [("turn", "system", "system?"), ("turn", "user", "prompt"), ("turn", "assistant", "completion")],
    "instruction_output": [("turn", "system", "system?"), ("pairs", "history[]?", "user", "assistant"), ("turn", "user", "instruction", "input?"), ("turn", "assistant", "output")],
    "instruction_response": [("turn", "system", "system?"), ("turn", "user", "instruction", "context?"), ("turn", "assistant", "response")],
    "question_answer": [("turn", "system", "system_prompt?"), ("turn", "user", "question"), ("turn", "assistant", "answer")],
    "messages": [("turn", "system", "system?"), ("each", "messages[]", "role", "content")],
    "message_parts": [("turn", "system", "system?"), ("each", "messages[]", "role", "content[].text")],
    "conversations": [("turn", "system", "system?"), ("each", "conversations[]", "from", "value")],
    "chosen": [("turn", "user", "prompt"), ("turn", "assistant", "chosen")],
    "chosen_messages": [("each", "chosen[]", "role", "content")],
}
#: Other names of roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _paths_of(step: tuple) -> list[tuple[list[str], bool]]:
    """Groups of paths that come together, and whether they may be missing."""
    if step[0] == "turn":
        return [([p.rstrip("?")], p.endswith("?")) for p in step[2:]]
    array = step[1].rstrip("?")
    if step[0] == "pairs":
        return [([f"{array}[]"], step[1].endswith("?"))]
    return [([f"{array}.{p}" if array else p for p in step[2:]], step[1].endswith("?"))]


#: Field names that layouts are told by; all others are taken for further data of a record.
NAMES = {n for m in MAPPINGS.values() for s in m for group, _ in _paths_of(s) for p in group for n in re.split(r"[.\[\]]+", p) if n}


def field_paths(value: object, at: str = "") -> set[str]:
    """Paths of the leaves of a JSON value, as far as their names are known to some layout."""
    if isinstance(value, dict):
        return {p for k, v in value.items() if k in NAMES for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    """Digest of the sorted paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:32]


def _variants(steps: list[tuple]):
    """Sets of paths that a record of this layout can have: with and without each optional group, and with arrays that are empty."""
    groups = []
    for step in steps:
        for group, optional in _paths_of(step):
            have = [frozenset(group)]
            if "[]" in group[0]:  # no element at all, or only empty inner arrays
                stems = [group[0][: m.end()] for m in re.finditer(r"\[\]", group[0])]
                empty = [frozenset({s, *(p for p in group[1:] if not p.startswith(s))} if i else {s}) for i, s in enumerate(stems)]
                have += empty
                if step[0] == "each" and "[]" in step[3]:  # texts in parts, some or all turns without any
                    arr, role = step[1].rstrip("?"), f"{step[1].rstrip('?')}.{step[2]}"
                    bare = f"{arr}.{step[3].split('[]')[0]}[]"
                    have += [frozenset({role, bare}), frozenset({*group, bare})]
            if optional:
                have.append(frozenset())
            groups.append(have)
    for pick in itertools.product(*groups):
        yield set().union(*pick)


#: Fingerprint -> name of the mapping.
LAYOUTS = {fingerprint(v): name for name, steps in MAPPINGS.items() for v in _variants(steps)}


def _get(value: object, path: str) -> list:
    """All values at a path; none where a field is missing."""
    found = [value]
    for name in [x for x in re.split(r"\.|(?=\[\])", path) if x]:
        if name == "[]":
            found = [x for v in found if isinstance(v, list) for x in v]
        else:
            found = [v[name] for v in found if isinstance(v, dict) and name in v]
    return found


def _text(values: list) -> str:
    return "".join("" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in values)


def record_turns(record: object) -> tuple[str, str | None, list[dict]]:
    """Fingerprint, name of the layout (null if none is known) and canonical turns of one parsed record."""
    mark = fingerprint(field_paths(record))
    layout, turns = LAYOUTS.get(mark), []
    for step in MAPPINGS.get(layout, ()):
        if step[0] == "turn":
            texts = [_text(_get(record, p.rstrip("?"))) for p in step[2:]]
            if step[2].endswith("?") and not _get(record, step[2].rstrip("?")):
                continue
            turns.append({"role": step[1], "text": "\n\n".join([texts[0], *(t for t in texts[1:] if t)])})
        elif step[0] == "pairs":
            for inner in _get(record, step[1].rstrip("?")):
                for role, text in zip(itertools.cycle(step[2:]), inner if isinstance(inner, list) else [inner]):
                    turns.append({"role": role, "text": _text([text])})
        else:
            for one in _get(record, step[1].rstrip("?")):
                role = _text(_get(one, step[2]))
                turns.append({"role": ROLE_NAMES.get(role, role), "text": _text(_get(one, step[3]))})
    return mark, layout, turns


def canonical_turns(records: DataFrame, record: str | None = None) -> DataFrame:
    """`records` plus `layout_sha`, `layout` (null: unknown) and `turns` (array of role and text).

    A record is the JSON text in column `record`, or else the row itself.
    Texts that aren't JSON or have no known layout have null in `layout` and no
    turns; nothing is dropped. Null texts and roles become empty. Fields that no layout names don't count.
    Columns of these three names give way.
    """
    records = records.drop("layout_sha", "layout", "turns")
    cell = private_name(records, "record")
    if record is None:
        known = [f"`{c}`" for c in records.columns if c in NAMES]
        value = F.to_json(F.struct(*known), {"ignoreNullFields": "false"}) if known else F.lit("{}")
    else:
        value = F.col(f"`{record}`")
    turn = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    schema = T.StructType([*records.schema.fields, T.StructField("layout_sha", T.StringType()), T.StructField("layout", T.StringType()), T.StructField("turns", turn)])
    tail = to_arrow_schema(T.StructType(schema.fields[-3:]))

    def parse(text):
        try:
            return record_turns(json.loads(text))
        except (TypeError, ValueError):
            return None, None, []

    def run(batches):
        for b in batches:
            found = [parse(x) for x in b.column(b.num_columns - 1).to_pylist()]
            new = [pa.array(x, f.type) for x, f in zip(zip(*found), tail)] if found else [pa.array([], f.type) for f in tail]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [f.name for f in schema])

    # plain names on the way, as a name may hold dots
    return records.withColumn(cell, value).toDF(*(f"c{i}" for i in range(len(records.columns) + 1))).mapInArrow(run, schema)


# ---- the template ----

#: What opens and closes the turns of a role; `[ROLE]` names any other role.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
OTHER = ("[ROLE] ", " [/ROLE]", "[TEXT] ", " [/TEXT]")
START = "<s>"
#: Characters of a piece from which the next turn starts another.
PIECE = 1 << 20

_CONTROL = r"(?:/?s>|/?(?:INST|SYS|ROLE|TEXT)\])"


def escaped(c):
    """A column's text with a backslash more after the first character of each control string, so that none is left; those in the text that have backslashes get one more."""
    return F.regexp_replace(c, rf"([<\[])(\\*{_CONTROL})", r"$1\\$2")


_ESCAPED = re.compile(rf"([<\[])\\(\\*{_CONTROL})")
#: One turn as it stands in a piece: escaped texts hold no control string, so the first closing mark ends it.
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|\[SYS\] (?P<system>.*?) \[/SYS\]|\[ROLE\] (?P<role>.*?) \[/ROLE\]\[TEXT\] (?P<text>.*?) \[/TEXT\]|<s> (?P<assistant>.*?) </s>", re.DOTALL)


def _formatted(role, text):
    out = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1] + OTHER[2]), escaped(text), F.lit(OTHER[3]))
    for name, (a, b) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit((START if name == "assistant" else "") + a), escaped(text), F.lit(b))).otherwise(out)
    return out


def format_chat(turns: DataFrame, *, piece: int = PIECE) -> DataFrame:
    """Pieces of formatted conversations: `conv_id`, `piece` (ascending from 0), `n_turns`, `text`, `loss` (array of start and end).

    `turns` has conv_id, role, text and the order columns `turn` and, where
    there, `seq`. Nulls come first; rows that tie go by role and text, and equal
    rows stay as often as they are there. Null roles and texts count as empty;
    rows of a null conv_id make one conversation. `loss` has the code points of
    a piece under the loss mask: assistants' texts, escapes included. A
    conversation's pieces in order, put together, are its text; a piece holds
    whole turns and about `piece` characters beyond its last turn at most, so a
    conversation of any length stays within bounds. One exchange, by conversation. An empty table gives an empty one.
    """
    order = [F.col(c).asc_nulls_first() for c in ("turn", "seq") if c in turns.columns]
    plain = turns.select("conv_id", *(c for c in ("turn", "seq") if c in turns.columns), *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    whole = plain.withColumn("cell", _formatted(F.col("role"), F.col("text"))).withColumn("size", F.char_length("cell"))
    w = Window.partitionBy("conv_id").orderBy(*order, "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = whole.withColumns({"at": F.sum("size").over(w) - F.col("size"), "nth": F.count(F.lit(1)).over(w)})
    placed = placed.withColumn("piece", (F.col("at") / piece).cast("long"))
    head = F.when(F.col("role") == "assistant", len(START + MARKS["assistant"][0])).otherwise(0)
    tail = len(MARKS["assistant"][1])
    cells = F.array_sort(F.collect_list(F.struct("nth", "cell", "at", (F.col("at") + head).alias("start"), (F.col("at") + F.col("size") - tail).alias("end"), (F.col("role") == "assistant").alias("loss"))))
    out = placed.groupBy("conv_id", "piece").agg(cells.alias("cells"), F.min("at").alias("base"))
    spans = F.transform(F.filter("cells", lambda c: c["loss"]), lambda c: F.struct((c["start"] - F.col("base")).alias("start"), (c["end"] - F.col("base")).alias("end")))
    return out.select("conv_id", "piece", F.size("cells").cast("long").alias("n_turns"), F.array_join(F.col("cells.cell"), "").alias("text"), spans.alias("loss"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def piece_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns of a piece. Text that is no turn is an error."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        name = m.lastgroup
        role, body = (m["role"], m["text"]) if name == "text" else (name, m[name])
        out.append((unescape(role), unescape(body)))
    if at != len(text):
        raise ValueError(f"no turn at character {at}")
    return out


def read_back(pieces: DataFrame) -> DataFrame:
    """What formatted pieces say of each conversation: `conv_id`, `n_turns`, `turns_sha256`, `loss_chars`, `loss_sha256`, `formatted_chars`.

    Turns are parsed from the text, and what is under the loss mask is cut out
    of it and unescaped. Pieces are streamed in order; only digests and sums
    are kept of a conversation, whatever its length.
    """
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    schema = T.StructType([pieces.schema["conv_id"], *longs("n_turns"), T.StructField("turns_sha256", T.StringType()), *longs("loss_chars"), T.StructField("loss_sha256", T.StringType()), *longs("formatted_chars")])
    arrow = to_arrow_schema(schema)

    class Digest:
        def __init__(self, key):
            self.key, self.n, self.loss_chars, self.chars, self.turns, self.loss = key, 0, 0, 0, hashlib.sha256(), hashlib.sha256()

        def row(self) -> dict:
            return dict(zip(schema.names, (self.key, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)))

    def run(batches):
        now, done = None, []
        for b in batches:
            for key, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "loss"))):
                if now is None or key != now.key:
                    done += [now.row()] if now else []
                    now = Digest(key)
                for role, body in piece_turns(text):
                    now.n += 1
                    now.turns.update(f"{role}\n{body}\n".encode())
                for span in spans:
                    body = unescape(text[span["start"] : span["end"]])
                    now.loss_chars += len(body)
                    now.loss.update(body.encode())
                now.chars += len(text)
            if len(done) >= 1_000:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done = []
        if now:
            yield pa.RecordBatch.from_pylist([*done, now.row()], arrow)

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(run, schema)


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    """All `conversations` and one full of control strings, formatted, written, and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = canonical_turns(rows.unionByName(hard)).select("conv_id", "turn", F.posexplode("turns").alias("seq", "one")).select("conv_id", "turn", "seq", "one.role", "one.text")
    return read_back(settle(format_chat(turns), "chat"))


OP11_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 13 ELSE 31 + length(role) END + length(text)
    + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|/?(?:INST|SYS|ROLE|TEXT)\])')) AS chars FROM rows),
listed AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM listed
"""
