"""Roles and turns of chat transcripts by a hidden Markov model over their lines.

A transcript is a list of lines. The states are the roles, each as the first line of a turn or a later one. A line is seen as one
of a few symbols: the speaker marker it begins with ("User:", "### Assistant", "<|system|>", ...), else what it looks like
(question, code, list, short, long). Viterbi finds the likeliest states, so lines without markers take the role that fits their place.

Lines are dealt out by ranges of (transcript, line), so a transcript of any length is spread over parts of bounded size. A part of a
spread transcript gives the best score from every state before it to every state at its end. These small tables are chained along the
transcript, and then every part is decoded on its own with its ends known. No task holds more than one part.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epsgroup.ship import ship
from epsgroup.workspace import Workspace

ROLES = ("system", "user", "assistant")
START, LATER = 0, 1  # state 2 * role + START or LATER

# Speaker names by role, as transcripts write them.
NAMES = {
    "system": ("system", "sys", "instruction", "instructions"),
    "user": ("user", "human", "customer", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "model", "agent", "answer", "a"),
}
_ROLE_OF = {name: role for role, names in enumerate(NAMES.values()) for name in names}
_ANY = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
MARKER = re.compile(rf"^\s*(?:<\|(?:im_start\|>)?({_ANY})(?:\|>)?|#+\s*({_ANY})\s*:?(?=\s|$)|[\[*]*({_ANY})[\]*]*\s*:[*]*)\s*", re.IGNORECASE)
SHAPES = ("blank", "question", "code", "list", "short", "long")
SYMBOLS = len(ROLES) + len(SHAPES)


def seen(line: str) -> tuple[int, str]:
    """(symbol, line without its marker)."""
    found = MARKER.match(line)
    if found:
        return _ROLE_OF[next(g for g in found.groups() if g).lower()], line[found.end() :]
    text = line.strip()
    if not text:
        shape = "blank"
    elif text.endswith("?"):
        shape = "question"
    elif text.startswith(("```", "    ", "def ", "import ", "{", "}")):
        shape = "code"
    elif re.match(r"([-*•]|\d+[.)])\s", text):
        shape = "list"
    else:
        shape = "short" if len(text) < 80 else "long"
    return len(ROLES) + SHAPES.index(shape), line


class Model:
    """log probabilities of a first state, of a next state, and of symbols."""

    def __init__(self, first: np.ndarray, next_: np.ndarray, symbol: np.ndarray):
        with np.errstate(divide="ignore"):
            self.first, self.next, self.symbol = np.log(first), np.log(next_), np.log(symbol)


def fitted(turns: dict, lengths: dict, symbols: dict, starts: dict) -> Model:
    """A model from counts: role pairs in sequence, (turns, lines) by role, (role, symbol) of lines, first roles. All are smoothed."""
    n = len(ROLES)
    first, next_, symbol = np.zeros(2 * n), np.zeros((2 * n, 2 * n)), np.full((2 * n, SYMBOLS), 1e-4)
    for role in range(n):
        first[2 * role] = starts.get(role, 0) + 0.5
        many, lines = lengths.get(role, (0, 0))
        stay = (max(0, lines - many) + 1) / (lines + 2)
        after = np.array([turns.get((role, other), 0) + 0.5 for other in range(n)])
        for kind in (START, LATER):
            next_[2 * role + kind, 2 * role + LATER] = stay
            next_[2 * role + kind, ::2] = (1 - stay) * after / after.sum()
        for look in range(len(SHAPES)):
            n_seen = symbols.get((role, len(ROLES) + look), 0) + 1
            symbol[2 * role + START, len(ROLES) + look] = n_seen
            symbol[2 * role + LATER, len(ROLES) + look] = n_seen
        shapes = symbol[2 * role, len(ROLES) :].sum()
        symbol[2 * role : 2 * role + 2, len(ROLES) :] /= shapes
        # A marker opens a turn of its role; a turn can also open without one, and rarely one occurs within a text.
        symbol[2 * role + START, len(ROLES) :] *= 0.05
        symbol[2 * role + START, role] = 0.95
        symbol[2 * role + LATER, : len(ROLES)] = 1e-4
    return Model(first / first.sum(), next_ / next_.sum(1, keepdims=True), symbol / symbol.sum(1, keepdims=True))


def table_of(model: Model, symbols: np.ndarray) -> np.ndarray:
    """(state before, state at the end): best log probability of these lines."""
    best = model.next + model.symbol[:, symbols[0]]
    for s in symbols[1:]:
        best = (best[:, :, None] + model.next[None]).max(1) + model.symbol[:, s]
    return best


def path_of(model: Model, symbols: np.ndarray, before: int | None, end: int | None) -> np.ndarray:
    """The likeliest states of these lines between known ends (None: open)."""
    score = (model.first if before is None else model.next[before]) + model.symbol[:, symbols[0]]
    back = []
    for s in symbols[1:]:
        ways = score[:, None] + model.next
        back.append(ways.argmax(0))
        score = ways.max(0) + model.symbol[:, s]
    state = int(score.argmax()) if end is None else end
    states = [state]
    for pointers in reversed(back):
        state = int(pointers[state])
        states.append(state)
    return np.array(states[::-1])


def _read(batches):
    """Lines with their symbol and part."""
    part = TaskContext.get().partitionId()
    for batch in batches:
        looks = [seen(x or "") for x in batch.column(2).to_pylist()]
        symbols, texts = [*zip(*looks, strict=True)] or [(), ()]
        parts = pa.array(np.full(batch.num_rows, part, np.int32))
        arrays = [*batch.columns[:2], parts, pa.array(symbols, pa.int32()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["conv", "line", "part", "symbol", "text"])


def _chained(tables: pa.Table, model: Model) -> pa.Table:
    """(conv, part, before, end): the states around each part on the best path of a transcript. The first has no state before."""
    rows = tables.sort_by("part")
    steps = [np.frombuffer(b).reshape(2 * len(ROLES), -1) for b in rows.column("best").to_pylist()]
    score, back = steps[0].max(0), []
    for step in steps[1:]:
        ways = score[:, None] + step
        back.append(ways.argmax(0))
        score = ways.max(0)
    ends = [int(score.argmax())]
    for pointers in reversed(back):
        ends.append(int(pointers[ends[-1]]))
    ends = ends[::-1]
    before = pa.array([None, *ends[:-1]], pa.int32())
    return pa.table({"conv": rows.column("conv"), "part": rows.column("part"), "before": before, "end": pa.array(ends, pa.int32())})


def _tables(lines: pa.Table, model: Model) -> pa.Table:
    rows = lines.sort_by("line")
    best = table_of(model, rows.column("symbol").to_numpy())
    if rows.column("opens")[0].as_py():  # the transcript begins here: all rows start from the first-state scores
        symbols = rows.column("symbol").to_numpy()
        first = np.full((2 * len(ROLES),) * 2, -np.inf)
        np.fill_diagonal(first, model.first + model.symbol[:, symbols[0]])
        best = first if len(symbols) == 1 else (first[:, :, None] + table_of(model, symbols[1:])[None]).max(1)
    return pa.table({"conv": rows.column("conv")[:1], "part": rows.column("part")[:1], "best": pa.array([best.tobytes()])})


def _decoded(lines: pa.Table, ends: pa.Table, model: Model) -> pa.Table:
    """Pieces of turns in a part: (conv, part, piece, role, lines, text). Piece 0 goes on with the turn before the part."""
    rows = lines.sort_by("line")
    before, end = (ends.column(c)[0].as_py() for c in ("before", "end")) if ends.num_rows else (None, None)
    states = path_of(model, rows.column("symbol").to_numpy(), before, end)
    turn = np.cumsum(states % 2 == START)
    texts = rows.column("text").to_pylist()
    first = np.flatnonzero(np.concatenate([[True], turn[1:] != turn[:-1]]))
    pieces = [texts[a:b] for a, b in zip(first, [*first[1:], len(texts)], strict=True)]
    n = len(first)
    conv, part = (rows.column(c).take(pa.array(np.zeros(n, np.int64))) for c in ("conv", "part"))
    return pa.table({
        "conv": conv, "part": part, "piece": pa.array(turn[first].astype(np.int32)), "role": pa.array((states[first] // 2).astype(np.int32)),
        "lines": pa.array([len(p) for p in pieces], pa.int64()), "text": pa.array(["\n".join(p) for p in pieces]),
    })


def parse(lines: DataFrame, conv_col: str, line_col: str, text_col: str, model: Model, ws: Workspace) -> DataFrame:
    """(conv_col, turn, role, n_lines, text): the turns of each transcript, counted from 0, without their markers.

    `line_col` orders the lines of a transcript (ties by text). Null lines are blank; rows with a null transcript or order are left
    out; repeated rows are lines of their own; other columns are ignored; an empty table gives no rows.
    """
    spark = lines.sparkSession
    ship(spark)
    kind = lines.schema[conv_col].dataType.simpleString()
    rows = lines.select(F.col(conv_col).alias("conv"), F.col(line_col).cast("long").alias("line"), F.col(text_col).alias("text"))
    rows = rows.where("conv IS NOT NULL AND line IS NOT NULL").repartitionByRange("conv", "line", "text")
    rows = rows.sortWithinPartitions("conv", "line", "text")
    rows = ws.save(rows.mapInArrow(_read, f"conv {kind}, line long, part int, symbol int, text string"), "lines")
    parts = ws.save(rows.groupBy("conv", "part").agg(F.count("*").alias("n")), "parts")
    spread = parts.groupBy("conv").agg(F.count("*").alias("parts"), F.min("part").alias("opening")).where("parts > 1")
    spread = ws.save(spread.drop("parts"), "spread")
    wide = rows.drop("text").join(spread, "conv").withColumn("opens", F.col("part") == F.col("opening"))
    best = wide.groupBy("conv", "part").applyInArrow(lambda t: _tables(t, model), f"conv {kind}, part int, best binary")
    ends = best.groupBy("conv").applyInArrow(lambda t: _chained(t, model), f"conv {kind}, part int, before int, end int")
    ends = ws.save(ends, "ends")
    pieces = rows.groupBy("conv", "part").cogroup(ends.groupBy("conv", "part")).applyInArrow(
        lambda t, e: _decoded(t, e, model), f"conv {kind}, part int, piece int, role int, lines long, text string"
    )
    pieces = ws.save(pieces, "pieces")
    counts = pieces.groupBy("conv", "part").agg(F.max("piece").alias("last"))
    base = F.coalesce(F.sum("last").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.join(counts.select("conv", "part", base.alias("base")), ["conv", "part"])
    turns = placed.groupBy("conv", (F.col("base") + F.col("piece") - 1).cast("long").alias("turn"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "\n")
    turns = turns.agg(F.min("role").alias("role"), F.sum("lines").alias("n_lines"), whole.alias("text"))
    names = F.array(*[F.lit(r) for r in ROLES])
    return turns.select(F.col("conv").alias(conv_col), "turn", F.get(names, "role").alias("role"), "n_lines", "text")


def render(turns: DataFrame) -> DataFrame:
    """Turns with the column `rendered`: <|role|>, the trimmed text, <|end|>, each on lines of its own."""
    return turns.withColumn("rendered", F.format_string("<|%s|>\n%s\n<|end|>", "role", F.trim("text")))


def learn(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> Model:
    """A model from conversations with known roles: counts of role pairs, lines and symbols over all rows. Other roles are left out."""
    ship(turns.sparkSession)
    number = {role: i for i, role in enumerate(ROLES)}
    role = F.coalesce(*[F.when(F.col(role_col) == r, i) for r, i in number.items()]).cast("int")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.col(text_col).alias("text"))
    rows = rows.where("role IS NOT NULL")
    heads = rows.select("conv", "turn", "role")
    after = heads.select("conv", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    pairs = {(r["role"], r["next"]): r["count"] for r in heads.join(after, ["conv", "turn"]).groupBy("role", "next").count().collect()}
    starts = {r["role"]: r["count"] for r in heads.where("turn = 0").groupBy("role").count().collect()}

    def counted(batches):
        for batch in batches:
            found: dict[tuple[int, int], int] = {}
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                for key in ((own, -1), *((own, -2) for _ in lines), *((own, seen(x)[0]) for x in lines)):
                    found[key] = found.get(key, 0) + 1
            keys = [*zip(*found, strict=True)] or [(), ()]
            arrays = [pa.array(keys[0], pa.int32()), pa.array(keys[1], pa.int32()), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["role", "look", "n"])

    looks = rows.select("role", "text").mapInArrow(counted, "role int, look int, n long").groupBy("role", "look").agg(F.sum("n").alias("n")).collect()
    symbols = {(r["role"], r["look"]): r["n"] for r in looks}
    lengths = {i: (symbols.get((i, -1), 0), symbols.get((i, -2), 0)) for i in range(len(ROLES))}
    return fitted(pairs, lengths, {k: v for k, v in symbols.items() if k[1] >= 0}, starts)


def transcript(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, silent: Column) -> DataFrame:
    """(conv_col, line, text): the lines of conversations, written with a speaker marker before each turn that is not `silent`.

    The style of the marker depends on the conversation. `line` grows with turn and line, and is not gapless.
    """
    role = F.col(role_col)
    styles = [F.concat(F.initcap(role), F.lit(": ")), F.concat(F.lit("### "), F.initcap(role), F.lit(": ")), F.concat(F.lit("<|"), role, F.lit("|> "))]
    mark = F.get(F.array(*styles), F.pmod(F.crc32(F.col(conv_col).cast("string")), F.lit(len(styles))).cast("int"))
    text = F.concat(F.when(silent, "").otherwise(F.coalesce(mark, F.lit(""))), F.coalesce(text_col, F.lit("")))
    split = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.posexplode(F.split(text, "\n")).alias("at", "text"))
    return split.select(F.col("conv").alias(conv_col), F.expr("turn * 4294967296 + at").alias("line"), "text")
