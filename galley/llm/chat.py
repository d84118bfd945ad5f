"""Operator 1. Chat formatting as a prefix tree that holds shared turns once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.llm import common

#: The template's signs, and strings that templates of other models give a meaning; all are escaped inside texts.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED = "assistant"


def escape(text: str) -> str:
    """Double every backslash, and put one after the first character of every control string."""
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\)?", lambda m: m[1] or "", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and the span of its text in it."""
    head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse_turn(turn: str) -> tuple[str, str]:
    if not (turn.startswith(TURN) and turn.endswith(END) and TEXT in turn):
        raise ValueError(f"no turn: {turn[:40]!r}")
    role, _, text = turn[len(TURN) : -len(END)].partition(TEXT)
    return unescape(role), unescape(text)


def _batches(rows: Iterator[dict], schema: pa.Schema, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row.get("formatted") or "") * 2 + 40 * len(row.get("path") or ())
        if size > limit or len(held) == 5000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ddl.split(", ")])


TRACED = "conv_id long, k long, node binary, parent binary, formatted string, tokens long, position long, learn_from long, learn_to long"
TREE = "node binary, parent binary, segment binary, path array<binary>, inside long, k long, formatted string, tokens long, position long, learn_from long, learn_to long"


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each turn's node: a digest of all turns up to it. Rows come sorted by conversation and turn; only the running
    digest is held, so a conversation may be of any length."""

    def rows() -> Iterator[dict]:
        conv, k, node, position = object(), 0, None, 0
        for batch in batches:
            for r in common.dicts(batch):
                if r["conv_id"] != conv:
                    conv, k, node, position = r["conv_id"], 0, None, 0
                formatted, lo, hi = format_turn(r["role"], r["text"])
                parent, node = node, hashlib.blake2b((node or b"") + formatted.encode(), digest_size=16).digest()
                learn = (lo, hi) if r["role"] == LEARNED else (0, 0)
                yield {
                    "conv_id": conv, "k": k, "node": node, "parent": parent, "formatted": formatted, "tokens": len(formatted),
                    "position": position, "learn_from": learn[0], "learn_to": learn[1],
                }
                k, position = k + 1, position + len(formatted)

    return _batches(rows(), _arrow(TRACED))


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tree rows, one per node, from the conversation that stands for it. A segment is a chain of nodes that the same
    conversations pass; its first node heads it and has the path of heads from the root."""

    def rows() -> Iterator[dict]:
        conv, path, passed, inside = object(), [], None, 0
        for batch in batches:
            for r in common.dicts(batch):
                if r["conv_id"] != conv or r["k"] == 0:
                    conv, path, passed = r["conv_id"], [], None
                head = r["passed"] != passed
                if head:
                    path, passed, inside = [*path, r["node"]], r["passed"], 0
                if r["stands"]:
                    out = {c: r[c] for c in ("node", "parent", "k", "formatted", "tokens", "position", "learn_from", "learn_to")}
                    yield out | {"segment": path[-1], "path": path if head else None, "inside": inside}
                inside += r["tokens"]

    return _batches(rows(), _arrow(TREE))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        sizes = batch.column("tokens").to_pylist()
        at = []
        for n in sizes:
            at.append(before)
            before += n
        yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("path"), batch.column("tokens"), pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], ["segment", "path", "tokens", "part", "before"])


def _merged(spans: Column) -> Column:
    """Sorted intervals with those that touch joined."""
    kind = "array<struct<lo:bigint,hi:bigint>>"

    def add(held: Column, x: Column) -> Column:
        last = F.element_at(held, -1)
        joined = F.concat(F.slice(held, 1, F.size(held) - 1), F.array(F.struct(last["lo"].alias("lo"), x["hi"].alias("hi"))))
        return F.when((F.size(held) > 0) & (F.try_element_at(held, F.lit(-1))["hi"] == x["lo"]), joined).otherwise(F.concat(held, F.array(x)))

    return F.aggregate(spans, F.array().cast(kind), add)


class PrefixTree:
    """Conversations merged on the turns they begin with.

    turns: rows (conv_id, turn, role, text). Turns are ordered by turn, then role, then text, nulls first; a null role
    or text is empty; rows without a conv_id are one conversation; repeated rows are turns of their own. Texts may be of any
    length. Other columns are ignored; an empty table gives no nodes and no paths. Tokens are code points.

    nodes() has every distinct prefix's last turn once: its formatted text, its place `start` in the emitted stream,
    which is depth-first, so that a subtree is one run; `position`, the position id of its first token, equal to the
    tokens on the way from the root; `attend`, the intervals of the stream its ancestors fill, which together with
    the tokens before it in its own turn are all it may see; and the span under the loss mask. paths() maps the
    conversations to nodes. Chains that the same conversations share are laid out as one segment, so paths hold
    branching points only. No tree, node or conversation is gathered in one place: a first turn that a third of all
    conversations share is one row, and a conversation of any length is streamed.
    """

    def __init__(self, turns: DataFrame) -> None:
        empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), empty("role").alias("role"), empty("text").alias("text"))
        ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        self.traced = common.materialize(ordered.select("conv_id", "role", "text").mapInArrow(_trace, TRACED), "traced")
        passed = self.traced.groupBy("node").agg(F.count("*").alias("passed"), F.min("conv_id").alias("stand"))
        known = self.traced.join(common.materialize(passed, "passed"), "node").withColumn("stands", F.col("conv_id").eqNullSafe(F.col("stand")))
        known = known.drop("stand").repartition("conv_id").sortWithinPartitions("conv_id", "k")
        self.tree = common.materialize(known.mapInArrow(_grow, TREE), "tree")

    def paths(self) -> DataFrame:
        """(conv_id, k, node)."""
        return self.traced.select("conv_id", "k", "node")

    def nodes(self) -> DataFrame:
        """(node, parent, depth, formatted, start, length, position, attend, learn_from, learn_to)."""
        sizes = common.materialize(self.tree.groupBy("segment").agg(F.sum("tokens").alias("tokens")), "sizes")
        segments = self.tree.where("path is not null").select("segment", "path").join(sizes, "segment").select("segment", "path", "tokens")
        laid = segments.repartitionByRange("path").sortWithinPartitions("path")
        laid = common.materialize(laid.mapInArrow(_running, "segment binary, path array<binary>, tokens long, part int, before long"), "laid")
        parts = laid.groupBy("part").agg(F.sum("tokens").alias("sum"))
        shift = (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("shift")  # one row for each partition
        begins = laid.join(common.materialize(parts.select("part", shift), "parts"), "part").withColumn("begin", F.col("before") + F.col("shift"))
        begins = common.materialize(begins.select("segment", "path", "begin", "tokens"), "begins")
        above = begins.select("segment", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("up"))
        spans = begins.select(F.col("segment").alias("up"), F.struct(F.col("begin").alias("lo"), (F.col("begin") + F.col("tokens")).alias("hi")).alias("span"))
        above = above.join(spans, "up").groupBy("segment").agg(F.sort_array(F.collect_list("span")).alias("spans"))
        placed = begins.drop("path", "tokens").join(above, "segment", "left")
        kind = "array<struct<lo:bigint,hi:bigint>>"
        start = F.col("begin") + F.col("inside")
        own = F.when(F.col("inside") > 0, F.array(F.struct(F.col("begin").alias("lo"), start.alias("hi")))).otherwise(F.array().cast(kind))
        return self.tree.join(common.materialize(placed, "placed"), "segment").select(
            "node", "parent", F.col("k").alias("depth"), "formatted", start.alias("start"), F.col("tokens").alias("length"), "position",
            _merged(F.concat(F.coalesce("spans", F.array().cast(kind)), own)).alias("attend"), "learn_from", "learn_to",
        )


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, positions long, attended long"

    def rows() -> Iterator[dict]:
        conv, state = object(), None

        def closed() -> dict:
            turns, learned, n, chars, size, positions, attended = state
            return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": learned.hexdigest(), "formatted_chars": size, "positions": positions, "attended": attended}

        for batch in batches:
            for r in common.dicts(batch):
                if r["conv_id"] != conv:
                    if state:
                        yield closed()
                    conv, state = r["conv_id"], [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, 0]
                role, text = parse_turn(r["formatted"])
                state[0].update(f"{role}\n{text}\n".encode())
                masked = unescape(r["formatted"][r["learn_from"] : r["learn_to"]])
                state[1].update(masked.encode())
                state[2] += 1
                state[3] += len(masked)
                state[4] += len(r["formatted"])
                state[5] += r["position"]
                state[6] += r["attended"]
        if state:
            yield closed()

    return _batches(rows(), _arrow(names))


def digests(tree: PrefixTree) -> DataFrame:
    """Per conversation, what is read back from the tree's nodes along its path: with the texts, the sum of its turns'
    first position ids, and the number of tokens that the attention intervals of its turns hold."""
    held = F.aggregate("attend", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"]).alias("attended")
    nodes = common.materialize(tree.nodes().select("node", "formatted", "learn_from", "learn_to", "position", held), "nodes")
    rows = tree.paths().join(nodes, "node").repartition("conv_id").sortWithinPartitions("conv_id", "k")
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, positions long, attended long"
    return rows.drop("node").mapInArrow(_read_back, out)


def op1_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, LEARNED, text)], "conv_id long, turn long, role string, text string")
    turns = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return digests(PrefixTree(turns))


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP1_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (SELECT *, {len(TURN) + len(TEXT) + len(END)} + length({_sql_escape('role')}) + length({_sql_escape('text')}) AS size FROM t),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM s)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars, sum(position)::BIGINT AS positions, sum(position)::BIGINT AS attended
FROM p GROUP BY conv_id
"""
