"""Repair of the turns of conversations by the cheapest edits.

Rows of a conversation are kept (K, free), given another role (R, 3), or deleted (D, 4; blank rows and rows seen before must be), and empty rows may
be inserted (I, 3), so that roles go `(s?(ua)+)?`: nothing, or user and assistant in turn after at most one system row. A row left in that does not end in
`.`, `!` or `?` adds 3. Of the cheapest edits those whose letters are ASCII-least are made.

An automaton of four states knows which role may follow. A backward pass finds, for each row and state, the least cost of the rows from there on; it stores this
vector only at checkpoints, a square root of the rows apart. A forward walk then takes the least letter among the edits that are tight, and
computes the vectors of a block again when it comes to it.

A conversation of more than FRAGMENT rows is cut into fragments, so that no task holds it whole. A fragment's rows are a 4 x 4
matrix of costs (least plus) between states; products of these over the fragments behind, worked out in a tree of FAN, give each fragment its vector
at the end. With that a fragment maps the state it is entered in to one it is left in, and products of these maps give the entry states. All
fragments are then walked at once. Only a digest of the whole conversation goes through the fragments in order, one at a time, as the hash asks for it.

Defined results: a null role or text counts as one space; rows go by turn, null turns first, rows of one turn by the md5 of role and text; repeated rows
are duplicates, only the first counts; rows without conv_id are one conversation; an initial is the first character of a role (empty roles have none and fit nowhere);
a conversation whose rows are all gone has zeros, an empty audit and the hash of nothing; very long texts count whole; an empty table gives an empty result; other columns are not
read. Equality of texts is that of their md5.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pixelweir.llm.common import SLICE, hot_join, numbered, written

#: Rows of a fragment; larger conversations are cut into several.
FRAGMENT = 1024
#: Fragments that are put together by one task.
FAN = 512
BLANKS = b" \t\n\v\f\r"

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a row whose role has this initial, and after a row that is inserted or given another role (user or assistant).
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FORCED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
RETYPE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
FAR = 1 << 60
#: Cost of the end of a conversation in each state: what has to be inserted.
LAST = (0, 2 * INSERT, INSERT, 0)

#: What the edits need of a row: whether it must go, what it costs if it stays, its initial.
Row = tuple[bool, int, str]


def _before(row: Row, after: tuple) -> tuple:
    """The costs from a row on, from the costs after it."""
    gone, extra, initial = row
    out = [DELETE + x for x in after]
    if not gone:
        for state in range(4):
            to = NEXT[state].get(initial)
            kept = FAR if to is None else extra + after[to]
            out[state] = min(out[state], kept, RETYPE + extra + after[FORCED[state]])
    user, assistant = min(out[USER], INSERT + out[ASSISTANT]), min(out[ASSISTANT], INSERT + out[USER])
    return min(out[START], INSERT + user), min(out[SYSTEM], INSERT + user), user, assistant


def matrix(rows: list[Row]) -> list[int]:
    """Least cost of a fragment from each state (row by row) to each state after it."""
    columns = []
    for end in range(4):
        costs = tuple(0 if k == end else FAR for k in range(4))
        for row in reversed(rows):
            costs = tuple(min(x, FAR) for x in _before(row, costs))
        columns.append(costs)
    return [columns[q][p] for p in range(4) for q in range(4)]


def product(a: list[int], b: list[int]) -> list[int]:
    return [min(FAR, *(a[4 * p + k] + b[4 * k + q] for k in range(4))) for p in range(4) for q in range(4)]


def through(a: list[int], b: list[int]) -> list[int]:
    """The state map of one fragment followed by another's."""
    return [b[x] for x in a]


def walk(rows: list[Row], state: int, end: tuple) -> Iterator[tuple[str, int | None, int]]:
    """The edits of a fragment entered in a state: letter, row (None for an inserted one) and the state after it."""
    step = max(1, math.isqrt(len(rows)))
    checkpoints, costs = {len(rows): end}, end
    for k in range(len(rows) - 1, -1, -1):
        costs = _before(rows[k], costs)
        if k % step == 0:
            checkpoints[k] = costs
    for first in range(0, len(rows), step):
        last = min(first + step, len(rows))
        vectors = [checkpoints[last]]
        for k in range(last - 1, first - 1, -1):
            vectors.append(_before(rows[k], vectors[-1]))
        for k in range(first, last):
            after = vectors[last - k - 1]
            here = vectors[last - k]
            gone, extra, initial = rows[k]
            while True:
                left = here[state]
                to = NEXT[state].get(initial)
                if left == DELETE + after[state]:
                    yield "D", k, state
                elif left == INSERT + here[FORCED[state]]:
                    state = FORCED[state]
                    yield "I", None, state
                    continue
                elif not gone and to is not None and left == extra + after[to]:
                    state = to
                    yield "K", k, state
                else:
                    state = FORCED[state]
                    yield "R", k, state
                break


def endings(state: int) -> Iterator[tuple[str, None, int]]:
    """What is inserted at the end of a conversation."""
    while LAST[state]:
        state = FORCED[state]
        yield "I", None, state


class Fragment:
    """A run of rows of one conversation, in order, with what is known of the rest."""

    def __init__(self, head: dict, turns: list, roles: list[str], texts: list[bytes], marks: list[str], again: list[bool]):
        self.key, self.block, self.conv_id, self.after, self.entry = (head[x] for x in ("key_", "block_", "conv_id", "after_", "entry_"))
        self.turns, self.roles, self.texts = turns, roles, texts
        self.faults: list[str] = []
        self.rows: list[Row] = []
        seen: set[str] = set()
        for role, text, mark, before in zip(roles, texts, marks, again, strict=True):
            ending = text.rstrip(BLANKS)[-1:]
            fault = "blank" if not ending else "duplicate" if before or mark in seen else "" if ending in b".!?" else "truncated"
            seen.add(mark)
            self.faults.append(fault)
            self.rows.append((fault in ("blank", "duplicate"), UNFINISHED if fault == "truncated" else 0, role[:1]))

    def end(self) -> tuple:
        """Costs after the fragment, from the product of all fragments behind it."""
        return LAST if self.after is None else tuple(min(self.after[4 * p + q] + LAST[q] for q in range(4)) for p in range(4))

    def edits(self) -> Iterator[tuple[str, int | None, str, bytes]]:
        """Letter, row, role and text of each edit; deleted rows have the role that they had."""
        state = START if self.entry is None else self.entry
        for letter, row, state in walk(self.rows, state, self.end()):  # noqa: B007
            yield letter, row, self.roles[row] if letter in "KD" else ROLE[state], b"" if row is None else self.texts[row]
        if self.after is None:
            for letter, row, state in endings(state):
                yield letter, row, ROLE[state], b""

    def exit(self, state: int) -> int:
        """The state that the fragment is left in if it is entered in this one."""
        for _, _, state in walk(self.rows, state, self.end()):  # noqa: B007
            pass
        return state


#: Columns of the rows that are dealt to fragments.
DEALT = ("key_", "block_", "conv_id", "turn", "role", "text", "mark_", "again_", "gone_", "after_", "entry_")


def over_fragments(rows: DataFrame, work: Callable[[Fragment], list[tuple]], schema: str) -> DataFrame:
    """The rows that `work` gives for each fragment. A task sorts its rows and reads them as a stream, holding one fragment at a time."""
    kept = rows.select(*DEALT).repartition("key_", "block_").sortWithinPartitions("key_", "block_", F.col("turn").asc_nulls_first(), "mark_")
    made = to_arrow_schema(StructType.fromDDL(schema))

    def fragment(at: tuple, given: list[dict[str, list]]) -> Fragment:
        many = {c: [x for part in given for x in part[c]] for c in given[0]}
        head = {c: many[c][0] for c in many}
        live = [k for k, gone in enumerate(many["gone_"]) if not gone]
        pick = lambda c: [many[c][k] for k in live]  # noqa: E731
        return Fragment(head, pick("turn"), pick("role"), [x.encode() for x in pick("text")], pick("mark_"), pick("again_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(made)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, made, strict=True)], schema=made)

        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            columns = {c: batch.column(c).to_pylist() for c in DEALT}
            keys = list(zip(columns["key_"], columns["block_"], strict=True))
            first = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[first]:
                    if held and keys[first] != at:
                        out += work(fragment(at, held))
                        held = []
                    at = keys[first]
                    held.append({c: x[first:k] for c, x in columns.items()})
                    first = k
            if len(out) >= SLICE:
                yield flush(out)
                out = []
        if held:
            out += work(fragment(at, held))
        yield flush(out)

    return kept.mapInArrow(run, schema)


def before_each(parts: DataFrame, combine: Callable[[list[int], list[int]], list[int]], fan: int = FAN) -> DataFrame:
    """key_, block_ and before_: what all parts (key_, block_, part) of a key at smaller blocks combine to; null at its first.

    A task combines at most `fan` parts; more go through a tree of groups, up and down again.
    """

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block_")
        value, before = pdf["start_"].iloc[0], []
        for part in pdf["part"]:
            before.append(value)
            value = list(part) if value is None else combine(list(value), list(part))
        return pd.DataFrame({"key_": pdf["key_"], "block_": pdf["block_"], "before_": before})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block_")
        value = None
        for part in pdf["part"]:
            value = list(part) if value is None else combine(value, list(part))
        return pd.DataFrame({"key_": pdf["key_"].iloc[:1], "block_": pdf["group_"].iloc[:1], "part": [value]})

    out = "key_ string, block_ long, before_ array<long>"
    most = parts.groupBy("key_").count().agg(F.max("count")).first()[0] or 0
    if most <= fan:
        return parts.withColumn("start_", F.lit(None).cast("array<long>")).groupBy("key_").applyInPandas(scan, out)
    # the parts of a key are numbered without gaps, so a group has `fan` of them at most
    grouped = parts.withColumn("group_", F.floor(F.col("block_") / fan).cast("long"))
    groups = written(grouped.groupBy("key_", "group_").applyInPandas(whole, "key_ string, block_ long, part array<long>"), "groups")
    starts = before_each(groups, combine, fan).select("key_", F.col("block_").alias("group_"), F.col("before_").alias("start_"))
    return grouped.join(starts, ["key_", "group_"]).groupBy("key_", "group_").applyInPandas(scan, out)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone of the rows after damage: by the crc32 of `conv_id:turn`, a row in 20 each is dropped (gone), loses
    its text, loses its `.`, `!` and `?`, comes twice, or is given the role user. Nulls count as one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind_"))
    text = F.when(F.col("kind_") == 1, "").when(F.col("kind_") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind_") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind_") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind_") == 0).alias("gone"), copies.alias("copy_")).drop("copy_")


def dealt(rows: DataFrame, fragment: int = FRAGMENT, fan: int = FAN) -> DataFrame:
    """Rows (conv_id, turn, role, text, and `gone` for those that are no longer there) with what over_fragments() needs: the fragment, whether
    the row was seen in an earlier one, the costs behind the fragment and the state that it is entered in."""
    space = F.lit(" ")
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    kept = rows.select(key.alias("key_"), "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), gone.alias("gone_"))
    kept = kept.withColumn("mark_", F.md5(F.concat_ws(":", F.length("key_").cast("string"), "key_", F.length("role").cast("string"), "role", "text").cast("binary")))
    sizes = kept.groupBy("key_").agg(F.count("*").alias("n_")).where(F.col("n_") > fragment)
    large = written(sizes.withColumn("large_", F.lit(True)), "large")
    if large.isEmpty():
        return _filled(kept)
    found = written(hot_join(kept, large, "key_", "n_", kept.count(), "left"), "dealt")
    single = _filled(found.where("large_ IS NULL"))
    ranked = numbered(found.where("large_"), [F.col("key_"), F.col("turn").asc_nulls_first(), F.col("mark_")], "number_").withColumn("block_", F.expr(f"number_ DIV {fragment}"))
    early = ranked.where("NOT gone_").groupBy("mark_").agg(F.min("block_").alias("first_"), F.max("block_").alias("last_"), F.count("*").alias("n_")).where("first_ < last_").drop("last_")
    again = hot_join(ranked, written(early, "early"), "mark_", "n_", ranked.count(), "left").withColumn("again_", F.coalesce(F.col("first_") < F.col("block_"), F.lit(False)))
    cut = written(again.select("key_", "block_", "conv_id", "turn", "role", "text", "mark_", "again_", "gone_"), "cut")
    # the passes over costs and states need the last character of a text only
    ends = F.right(F.expr(r"trim(TRAILING ' \t\n\u000B\f\r' FROM text)"), F.lit(1))
    slim = _filled(cut.withColumn("text", ends))
    part = "key_ string, block_ long, part array<long>"
    costs = over_fragments(slim, lambda x: [(x.key, -x.block, matrix(x.rows))], part)
    behind = before_each(written(costs, "costs"), lambda a, b: product(b, a), fan).select("key_", (-F.col("block_")).alias("block_"), F.col("before_").alias("after_"))
    behind = written(behind, "behind")
    maps = over_fragments(slim.drop("after_").join(behind, ["key_", "block_"]), lambda x: [(x.key, x.block, [x.exit(k) for k in range(4)])], part)
    entries = before_each(written(maps, "maps"), through, fan).select("key_", "block_", F.get("before_", F.lit(START)).cast("int").alias("entry_"))
    edges = behind.join(entries, ["key_", "block_"])
    return cut.join(edges, ["key_", "block_"]).select(*DEALT).unionByName(single)


def _filled(rows: DataFrame) -> DataFrame:
    """The columns DEALT; those that are not there have what a lone fragment has."""
    none = {"block_": F.lit(0).cast("long"), "again_": F.lit(False), "after_": F.lit(None).cast("array<long>"), "entry_": F.lit(None).cast("int")}
    return rows.select(*(F.col(c) if c in rows.columns else none[c].alias(c) for c in DEALT))


def repaired(rows: DataFrame, fragment: int = FRAGMENT, fan: int = FAN) -> DataFrame:
    """The edits of every conversation, in the order of fragment and at: edit (K, R, D or I), and the turn, role and text of its row; inserted rows
    have no turn. Without the rows of edit D these are the repaired conversations."""

    def work(found: Fragment) -> list[tuple]:
        return [(found.conv_id, found.block, at, letter, None if row is None else found.turns[row], role, text.decode()) for at, (letter, row, role, text) in enumerate(found.edits())]

    kind = rows.schema["conv_id"].dataType.simpleString()
    return over_fragments(dealt(rows, fragment, fan), work, f"conv_id {kind}, fragment long, at long, edit string, turn long, role string, text string")


#: What is told of a fragment: counts, edges, and for fragments of cut conversations the repaired bytes, which are hashed when all are there.
TOLD = "turns_first long, turns_last long, turns_n long, blank long, duplicate long, truncated long, illegal long, initial_first string, initial_last string, cost long, audit string, repaired binary"
COST = {"K": 0, "R": RETYPE, "D": DELETE, "I": INSERT}
LEGAL = ("su", "ua", "au")


def _told(found: Fragment) -> list:
    turns = [x for x in found.turns if x is not None]
    initials = [x[:1] for x in found.roles]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    edits = list(found.edits())
    cost = sum(COST[letter] + (found.rows[row][1] if row is not None and letter != "D" else 0) for letter, row, _, _ in edits)
    lines = [role.encode() + b":" + text for letter, _, role, text in edits if letter != "D"]
    edge = (turns[0], turns[-1], len(set(turns))) if turns else (None, None, 0)
    initial = (initials[0], initials[-1]) if initials else (None, None)
    return [*edge, *(found.faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, *initial, cost, "".join(x[0] for x in edits), b"\n".join(lines) if lines else None]


class Whole:
    """What is told of a conversation, from its fragments one after the other."""

    def __init__(self):
        self.first = self.last = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.hash, self.any = hashlib.sha256(), False

    def add(self, first, last, n, blank, duplicate, truncated, illegal, initial_first, initial_last, cost, audit, repaired) -> None:
        self.turns += n - (first is not None and first == self.last)
        self.first = first if self.first is None else self.first
        self.last = last if last is not None else self.last
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal += illegal + (self.initial is not None and initial_first is not None and self.initial + initial_first not in LEGAL)
        self.initial = self.initial if initial_last is None else initial_last
        self.cost += cost
        self.audit.append(audit)
        if repaired is not None:
            self.hash.update(b"\n" + repaired if self.any else repaired)
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(rows: DataFrame, fragment: int = FRAGMENT, fan: int = FAN) -> DataFrame:
    """One row for each conv_id: faults of its rows, cost and letters of the edits, and a hash of the repaired turns (`role:text`, one a line)."""
    given, kind = dealt(rows, fragment, fan), rows.schema["conv_id"].dataType.simpleString()

    def alone(found: Fragment) -> list[tuple]:
        whole = Whole()
        whole.add(*_told(found))
        return [(found.conv_id, *whole.row())]

    out = over_fragments(given.where("after_ IS NULL AND entry_ IS NULL"), alone, f"conv_id {kind}, {DIGEST}")
    parts = over_fragments(given.where("after_ IS NOT NULL OR entry_ IS NOT NULL"), lambda x: [(x.key, x.block, x.conv_id, *_told(x))], f"key_ string, block_ long, conv_id {kind}, {TOLD}")
    return out.unionByName(folded(parts, kind))


def folded(parts: DataFrame, kind: str) -> DataFrame:
    """The digests of cut conversations. Their fragments pass through a task as a stream; it holds one of them, and the letters."""
    sorted_ = parts.repartition("key_").sortWithinPartitions("key_", "block_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole, id_ = None, None, None
        done: list[tuple] = []
        id_kind = None
        for batch in (x.slice(k, 16) for x in batches for k in range(0, x.num_rows, 16)):
            id_kind = batch.column(2).type
            for k, conv_id, *told in zip(batch.column(0).to_pylist(), *(batch.column(c).to_pylist() for c in range(2, batch.num_columns)), strict=True):
                if whole is None or k != key:
                    if whole is not None:
                        done.append((id_, *whole.row()))
                    key, id_, whole = k, conv_id, Whole()
                whole.add(*told)
        if whole is not None:
            done.append((id_, *whole.row()))
            kinds = [id_kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names=["conv_id", *(x.split(" ")[0] for x in DIGEST.split(", "))])

    return sorted_.mapInArrow(run, f"conv_id {kind}, {DIGEST}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _sql() -> str:
    """DuckDB SQL for query(): the least (cost, letters, turns) of each state, row by row."""
    far = "{'cost': 1000000000, 'audit': '', 'said': ''}"
    add = lambda x, cost, letter, said="''": f"{{'cost': {x}.cost + {cost}, 'audit': {x}.audit || '{letter}', 'said': {x}.said || {said}}}"  # noqa: E731
    line = lambda role: f"chr(10) || '{role}:'"  # noqa: E731
    insert = lambda x, role: add(x, INSERT, "I", line(role))  # noqa: E731
    closed = f"""u1 AS (SELECT *, least(u, {insert("o", "user")}, {insert("s", "user")}, {insert("a", "user")}) AS iu FROM given),
      a1 AS (SELECT *, least(a, {insert("iu", "assistant")}) AS ia FROM u1),
      u2 AS (SELECT * REPLACE (least(iu, {insert("ia", "user")}) AS iu) FROM a1)"""
    extra = f"(CASE WHEN truncated THEN {UNFINISHED} ELSE 0 END)"
    stay = lambda x, initial: f"CASE WHEN NOT gone AND initial = '{initial}' THEN {add(x, extra, 'K', 'chr(10) || role || chr(58) || text')} ELSE {far} END"  # noqa: E731
    other = lambda x, role: f"CASE WHEN NOT gone THEN {add(x, f'{RETYPE} + {extra}', 'R', f'{line(role)} || text')} ELSE {far} END"  # noqa: E731
    to_user = ", ".join(f"{stay(x, 'u')}, {other(x, 'user')}" for x in ("o", "s", "ia"))
    return rf"""
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, steps),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) FROM kinds WHERE kind <> 0),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce('=' || conv_id, ''))::VARCHAR || ':' || coalesce('=' || conv_id, '') || ':' || length(role)::VARCHAR || ':' || role || ':' || text)) AS i FROM damaged),
marked AS (SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, left(role, 1) AS initial,
    NOT regexp_matches(text, '[.!?][ 	-]*$') AS open, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
faulty AS (SELECT *, blank OR again AS gone, NOT blank AND NOT again AND open AS truncated FROM marked),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faulty GROUP BY 1),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'cost': 0, 'audit': '', 'said': ''}} AS o, {far} AS s, {far} AS u, {far} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL (
    WITH given AS (SELECT w.*, f.gone, f.truncated, f.initial, f.role, f.text FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1),
      {closed}
    SELECT conv_id, i + 1, {add("o", DELETE, "D")}, least({add("s", DELETE, "D")}, {stay("o", "s")}), least({add("iu", DELETE, "D")}, {to_user}),
      least({add("ia", DELETE, "D")}, {stay("iu", "a")}, {other("iu", "assistant")}) FROM u2)),
given AS (SELECT w.* FROM walk w LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(t.n, 0)),
{closed},
best AS (SELECT conv_id, least(o, ia) AS x FROM u2)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(x.cost AS BIGINT) AS cost, x.audit AS audit, sha256(substr(x.said, 2)) AS repaired_sha256
FROM best b LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
"""


SQL = _sql()
