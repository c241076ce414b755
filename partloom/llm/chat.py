"""Chat formatting: a hidden Markov model over speaker markers and line features recovers roles by Viterbi.

A row's text is cut into segments where a line begins with a speaker marker. Segments are the steps of the model; their
observation joins the marker, the place and the shape of the lines. Counts over all rows with a known role give the
model. Roles are decoded without the role column, and each segment is rendered as one turn.

Conversations are cut into chunks of CHUNK turn numbers; where many rows share a turn, so that a chunk would hold over
CHUNK_ROWS of them, the conversation is cut finer, by turn and by the hash that orders the rows of one turn. A chunk of a longer conversation is first summed up as a
matrix of best scores from each state before it to each state at its end; these are combined in a tree of FANOUT, and
the states at chunk borders come back down the tree. So no task holds a whole long conversation, and the path is still
the best one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.llm.common import materialise, small_batches

ROLES = ("system", "user", "assistant")
CHUNK = FANOUT = 64
#: Chunks of more rows are cut at hashes; each turn then has up to PARTS of them.
CHUNK_ROWS, PARTS = 4096, 4096
#: Turns are taken to lie between minus and plus this number; all beyond share the outer chunk.
FARTHEST = 1 << 46
# fixed values: how speakers are marked at the beginning of a line
MARKERS = {"system": r"system|instructions?", "user": r"user|human|question|q|customer|me", "assistant": r"assistant|ai|bot|answer|a|agent|model"}
MARKER = re.compile("|".join(rf"(?P<{role}>(?:<\|(?:im_start\|>)?|\[|#+ ?|\*\*)?(?:{words})(?:\|>|\]:?|\*\*:?|:))" for role, words in MARKERS.items()), re.I)
PRIOR = 20.0  # pseudo-counts by which a marker speaks for its role
OBSERVATIONS = 4 * 2 * 2 * 4 * 4 * 2


def segments(text: str, first: bool) -> list[tuple[int, str, int]]:
    """(observation, text without marker, lines) of each segment; an empty text is one empty segment."""
    runs: list[tuple[int, list[str]]] = [(0, [])]
    for line in text.split("\n"):
        m = MARKER.match(line)
        if m:
            if len(runs) == 1 and not runs[0][1]:
                runs.pop()
            runs.append((1 + ROLES.index(m.lastgroup or ""), [line[m.end() :].lstrip(" \t")]))
        else:
            runs[-1][1].append(line)
    out = []
    for k, (marker, lines) in enumerate(runs):
        body = "\n".join(lines)
        long_ = min(3, max(0, len(body) // 80))
        many = min(3, len(lines) - 1)
        asks = "?" in body
        obs = ((((marker * 2 + (k == 0)) * 2 + first) * 4 + many) * 4 + long_) * 2 + asks
        out.append((int(obs), body, len(lines)))
    return out


class Model:
    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        norm = lambda c: np.log(c / c.sum(-1, keepdims=True))
        emit = emit + 0.1
        for r in range(3):
            emit[r].reshape(4, -1)[1 + r] += PRIOR / (OBSERVATIONS // 4)
        self.start, self.step, self.emit = norm(start + 1.0), norm(step + 1.0), norm(emit)

    def scores(self, obs: list[int]) -> np.ndarray:
        return self.emit[:, obs].T

    def matrix(self, obs: list[int]) -> np.ndarray:
        """Best score from each state before the first step (the last row: from the start) to each state at the last one."""
        e = self.scores(obs)
        m = np.vstack([self.step, self.start]) + e[0]
        for x in e[1:]:
            m = (m[:, :, None] + self.step[None]).max(1) + x
        return m

    def decode(self, obs: list[int], before: int, last: int) -> list[int]:
        """Best states; before is the state in front (-1: none), last the state at the end (-1: free). Ties: first role."""
        e = self.scores(obs)
        v = (self.start if before < 0 else self.step[before]) + e[0]
        back = []
        for x in e[1:]:
            all_ = v[:, None] + self.step
            back.append(all_.argmax(0))
            v = all_.max(0) + x
        state = int(v.argmax()) if last < 0 else last
        path = [state]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :3]).max(1)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _sorted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def train(rows: DataFrame) -> Model:
    """Counts of all rows with a known role: first roles, steps between turn numbers n and n+1, and observations."""
    known = rows.where(F.col("role").isin(*ROLES))
    by_turn = known.groupBy("conv", "turn").agg(F.min("role").alias("role"))
    start = by_turn.groupBy("conv").agg(F.min_by("role", "turn").alias("role")).groupBy("role").count().collect()
    after = by_turn.select("conv", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    steps = by_turn.join(after, ["conv", "turn"]).groupBy("role", "next").count().collect()  # nine rows at most

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, OBSERVATIONS), np.int64)
        for batch in batches:
            for role, turn, text in zip(*(batch.column(c).to_pylist() for c in ("role", "turn", "text"))):
                for obs, _, _ in segments(text, turn == 0):
                    total[ROLES.index(role), obs] += 1
        r, o = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(o.astype(np.int32)), pa.array(total[r, o])], ["r", "o", "c"])

    seen = known.select("role", "turn", "text").mapInArrow(observe, "r int, o int, c bigint").groupBy("r", "o").agg(F.sum("c").alias("c")).collect()
    a, b, c = np.zeros(3), np.zeros((3, 3)), np.zeros((3, OBSERVATIONS))
    for role, n in start:
        a[ROLES.index(role)] += n
    for role, after_, n in steps:
        b[ROLES.index(role), ROLES.index(after_)] += n
    for r, o, n in seen:
        c[r, o] += n
    return Model(a, b, c)


BORDER = "conv string, chunk bigint, before int, last int"


def borders(rows: DataFrame, model: Model) -> DataFrame:
    """For every chunk of conversations with more than one: the best path's state before it and at its end."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 2):
            obs = [s[0] for r in run for s in segments(r[4], r[2] == 0)]
            yield pa.RecordBatch.from_arrays([pa.array([run[0][0]]), pa.array([run[0][1]], pa.int64()), pa.array([model.matrix(obs).ravel().tolist()], pa.list_(pa.float64()))], ["conv", "chunk", "m"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 2):
            m = np.reshape(run[0][3], (4, 3))
            for r in run[1:]:
                m = _times(m, np.reshape(r[3], (4, 3)))
            yield pa.RecordBatch.from_arrays([pa.array([run[0][0]]), pa.array([run[0][1]], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], ["conv", "chunk", "m"])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 2):
            before, last = run[0][4], run[0][5]
            v, back = np.reshape(run[0][3], (4, 3))[before], []  # before -1 is the last row: the start
            for r in run[1:]:
                all_ = v[:, None] + np.reshape(r[3], (4, 3))[:3]
                back.append(all_.argmax(0))
                v = all_.max(0)
            path = [int(v.argmax()) if last < 0 else last]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            path = path[::-1]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in run]), pa.array([r[2] for r in run], pa.int64()), pa.array([before, *path[:-1]], pa.int32()), pa.array(path, pa.int32())], ["conv", "chunk", "before", "last"])

    mats = "conv string, chunk bigint, m array<double>"
    levels = [materialise(_sorted(rows, ["conv", "chunk"], ["turn", "mix", "role", "text"]).select("conv", "chunk", "turn", "role", "text").mapInArrow(sum_up, mats), "chunks")]
    while levels[-1].groupBy("conv").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a < b").limit(1).count():
        up = levels[-1].select("conv", F.floor(F.col("chunk") / FANOUT).alias("up"), "chunk", "m")
        levels.append(materialise(_sorted(up, ["conv", "up"], ["chunk"]).mapInArrow(combine, mats), "chunks"))
    known = levels[-1].select("conv", "chunk", F.lit(-1).alias("before"), F.lit(-1).alias("last"))
    for level in reversed(levels[:-1]):
        down = level.withColumn("up", F.floor(F.col("chunk") / FANOUT)).join(known.select("conv", F.col("chunk").alias("up"), "before", "last"), ["conv", "up"])
        known = materialise(_sorted(down.select("conv", "up", "chunk", "m", "before", "last"), ["conv", "up"], ["chunk"]).mapInArrow(descend, BORDER), "borders")
    return known


RESULT = "conv_id bigint, turn bigint, given_role string, role string, n_segments int, n_lines int, rendered string, rendered_sha256 string"


def render(role: str, body: str) -> str:
    return f"<|{role}|>\n{body.strip()}\n<|end|>\n"


def format_chat(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: Column | None = None) -> DataFrame:
    """One row for each input row: its roles by Viterbi (that of its first segment in role), and its canonical turns.

    The given role is used for counts only and carried along; rows without a known role, or for which learn is false, do
    not count. Ids that are no whole numbers are texts, and stay so. A null text is an empty one. A turn that is null or no
    number is turn 0; ties are ordered by a hash of role and text, then by
    role and text; only rows that repeat all of it are never parted, however many they are. A row without conv_id is a conversation of its
    own. Without any known role only markers decide. Repeated rows are steps of their own. Empty tables give no rows;
    other columns are ignored.
    """
    small_batches(conversations.sparkSession)
    t = F.coalesce(F.col(turn).try_cast("bigint"), F.lit(0))
    whole = isinstance(conversations.select(conv_id).schema[0].dataType, T.IntegralType)
    kind, arrow_kind = ("bigint", pa.int64()) if whole else ("string", pa.string())
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    alone = F.concat(F.lit("alone "), F.xxhash64(t, F.col(role), body).cast("string"))
    rows = conversations.select(
        F.coalesce(F.col(conv_id).cast("string"), alone).alias("conv"), t.alias("turn"), F.col(role).cast("string").alias("role"), body.alias("text"), F.col(conv_id).cast(kind).alias("id"), F.xxhash64(F.col(role), body).alias("mix"),
        F.coalesce(learn if learn is not None else F.lit(True), F.lit(False)).alias("learn"),
    )
    model = train(rows.where("learn"))
    place = F.greatest(F.least("turn", F.lit(FARTHEST)), F.lit(-FARTHEST)) + FARTHEST  # chunk numbers are in the order of the rows
    rows = rows.withColumn("chunk", F.floor(place / CHUNK))
    crowded = rows.groupBy("conv", "chunk").count().where(F.col("count") > CHUNK_ROWS).select("conv").distinct()
    if crowded.limit(1).count():
        part = F.floor((F.col("mix") / 2.0**64 + 0.5) * PARTS).cast("bigint")
        fine = place * PARTS + F.greatest(F.least(part, F.lit(PARTS - 1)), F.lit(0))
        rows = rows.join(crowded.withColumn("_fine", F.lit(True)), "conv", "left").withColumn("chunk", F.when(F.col("_fine"), fine).otherwise(F.col("chunk"))).drop("_fine")
    long_ = rows.groupBy("conv").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a < b").select("conv")
    if long_.limit(1).count():
        rows = rows.join(borders(rows.join(long_, "conv", "left_semi"), model), ["conv", "chunk"], "left")
    else:
        rows = rows.withColumn("before", F.lit(-1)).withColumn("last", F.lit(-1))
    ready = _sorted(rows.select("conv", "chunk", "turn", "role", "text", "id", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("last", F.lit(-1)).alias("last"), "mix"), ["conv", "chunk"], ["turn", "mix", "role", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * 8
            kinds = (arrow_kind, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "turn", "given_role", "role", "n_segments", "n_lines", "rendered", "rendered_sha256"])

        for group in _runs(batches, 2):
            parts = [segments(r[4], r[2] == 0) for r in group]
            states = iter(model.decode([s[0] for p in parts for s in p], group[0][6], group[0][7]))
            for r, part in zip(group, parts):
                roles = [ROLES[next(states)] for _ in part]
                text_ = "".join(render(name, s[1]) for name, s in zip(roles, part))
                out.append((r[5], r[2], r[3], roles[0], len(part), sum(s[2] for s in part), text_, hashlib.sha256(text_.encode()).hexdigest()))
            if len(out) > 1000:
                yield flush()
                out.clear()
        yield flush()

    return ready.mapInArrow(run, RESULT.replace("conv_id bigint", f"conv_id {kind}", 1)).withColumnsRenamed({"conv_id": conv_id, "turn": turn})
