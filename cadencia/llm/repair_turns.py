"""Repair of conversation structure at least cost.

Every row of a conversation may be kept (cost 0, letter K), get another role
(user or assistant; 2, R) or be deleted (3, D; required for blank and repeated
rows); an empty user or assistant row may be inserted anywhere (2, I). A kept or
changed row that ends without a full stop, exclamation or question mark adds 1.
The role initials that remain must match ``(s?(ua)+)?``. Of the cheapest edits
those count whose letters, in order, are least in ASCII.

A path through the edits is weighed by one integer: its cost stands in the high
digits, below it each letter has a digit at its place, and places after the last
letter are zero. The least integer is the answer, so an ordinary shortest path
over (rows done, grammar state) decides cost and letters at once. Letters of two
equally cheap paths over the same rows are never prefixes of one another (more
inserts cost more), so what follows cannot turn their order round.

A conversation of any length is cut into blocks of turns. A block is summed up
by its cheapest path from each grammar state to each; the blocks of a
conversation are then chained in order, one summary at a time, and the letters
chosen go back to the rows of each block. Texts are hashed in a stream, as the
digest of a conversation has to see them in order. No task holds a conversation.

Order is by turn (nulls first); rows of one turn are ordered by role and then by
a hash of role and text. A null role or text is one space, that is a blank row.
Null conv_ids are one conversation. Roles with another initial than s, u, a can't
be kept, nor can s after the first row left. Rows that are equal in conversation,
turn, role and text are all counted; all but one are repeats. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: turns of a block
SPAN_BITS = 8
SPAN = 1 << SPAN_BITS
#: white space of the contract, as characters
WHITE = " \t\n\x0b\x0c\r"
LETTERS = "DIKR"
D, I, K, R = 1, 2, 3, 4
#: grammar states: nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = range(4)
#: states from which a user or an assistant may follow, and where that leads
TURNS = ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT))
#: classes of initials
OTHER = 3
INITIALS = {"s": 0, "u": 1, "a": 2}
#: faults of a row as the path sees them
FINE, CUT, GONE = range(3)
LEGAL = {(0, 1), (1, 2), (2, 1)}
LOWEST = -(1 << 63)


def conversation_key(conv_id: str) -> Column:
    """A string for each conv_id, another one for null."""
    c = F.col(conv_id)
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), c.cast("string")))


def damage(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults planted by crc32(conv_id:turn) % 20."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    roll = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = table.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), roll.alias("roll")).where("roll <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("roll") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("roll") == 1, F.lit("")).when(F.col("roll") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("roll") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def keyed(rows: DataFrame) -> DataFrame:
    """cid, place (turn, nulls lowest), role, text, same (a hash of role and text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        conversation_key("conv_id").alias("cid"),
        F.coalesce(F.col("turn").cast("long"), F.lit(LOWEST)).alias("place"),
        role.alias("role"),
        text.alias("text"),
        F.md5(F.concat_ws("\x00", F.char_length(role).cast("string"), role, text).cast("binary")).alias("same"),
        F.col("turn").isNull().alias("unplaced"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """Narrow rows: equal ones counted (n), with faults and whether they come first."""
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    kind = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(OTHER)
    faults = keyed(rows).select(
        "cid", "place", "role", "same", "unplaced", kind.alias("kind"), (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut")
    )
    counted = faults.groupBy("cid", "place", "same").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("role", "unplaced", "kind", "blank", "cut")]
    )
    first = counted.groupBy("cid", "same").agg(F.min("place").alias("_first"))
    return counted.join(first, ["cid", "same"]).select(
        "cid",
        F.when(F.col("place") == LOWEST, F.lit(LOWEST)).otherwise(F.shiftright("place", SPAN_BITS)).alias("block"),
        "place",
        "role",
        "same",
        "n",
        "unplaced",
        "kind",
        "blank",
        "cut",
        (F.col("place") == F.col("_first")).alias("first"),
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000, letters: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of ``most`` rows, or less where strings and lists are long."""
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str | list))
        if len(held) >= most or size >= letters:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


# --- weights


def _grown(path, cost: int, digit: int, width: int):
    """A path (weight, letters) with one more letter; ``width`` places of four bits."""
    weight, at = path
    return weight + (cost << 4 * width) + (digit << 4 * (width - 1 - at)), at + 1


def _offer(paths: list, to: int, path) -> None:
    if paths[to] is None or path[0] < paths[to][0]:
        paths[to] = path


def _inserted(paths: list, width: int) -> list:
    """The least path to each state when rows may be inserted.

    TURNS is in an order in which one pass is enough: a third insert in a row
    would come back to a state already reached for less.
    """
    paths = list(paths)
    for s, t in TURNS:
        if paths[s] is not None:
            _offer(paths, t, _grown(paths[s], 2, I, width))
    return paths


def _stepped(paths: list, kind: int, fault: int, width: int) -> list:
    """The least path to each state after one row."""
    before = _inserted(paths, width)
    after: list = [None] * 4
    for s, path in enumerate(before):
        if path is not None:
            _offer(after, s, _grown(path, 3, D, width))
    if fault == GONE:
        return after
    late = 1 if fault == CUT else 0
    if kind == INITIALS["s"] and before[START] is not None:
        _offer(after, SYSTEM, _grown(before[START], late, K, width))
    for s, t in TURNS:
        if before[s] is not None:
            keeps = kind == (INITIALS["u"] if t == USER else INITIALS["a"])
            _offer(after, t, _grown(before[s], late if keeps else late + 2, K if keeps else R, width))
    return after


def _read(path, width: int) -> tuple[int, str]:
    """Cost and letters of a path."""
    weight, n = path
    digits = f"{weight & ((1 << 4 * width) - 1):0{width}x}"[:n] if width else ""
    return weight >> 4 * width, digits.translate(str.maketrans("1234", LETTERS))


def _weighed(cost: int, letters: str, width: int) -> int:
    """The weight of a path of that cost and letters."""
    digits = int(letters.translate(str.maketrans(LETTERS, "1234")) or "0", 16)
    return (cost << 4 * width) + (digits << 4 * (width - len(letters)))


@lru_cache(maxsize=4096)
def _short(rows: tuple) -> tuple:
    """For each pair of states, cost and letters of the least path over ``rows``, or None."""
    width = 3 * len(rows)  # up to two inserts stand before a row
    out = []
    for s in range(4):
        paths: list = [None] * 4
        paths[s] = (0, 0)
        for kind, fault in rows:
            paths = _stepped(paths, kind, fault, width)
        out.append(tuple(None if p is None else _read(p, width) for p in paths))
    return tuple(out)


def _chained(left: tuple, right: tuple) -> tuple:
    """The least paths over two neighbouring runs of rows."""
    out = []
    for s in range(4):
        ends = []
        for t in range(4):
            found = [(left[s][m], right[m][t]) for m in range(4) if left[s][m] and right[m][t]]
            joined = [(a[0] + b[0], a[1] + b[1]) for a, b in found]
            width = max((len(x[1]) for x in joined), default=0)
            ends.append(min(joined, key=lambda x: _weighed(*x, width), default=None))
        out.append(tuple(ends))
    return tuple(out)


def summary(rows: list[tuple[int, int]]) -> tuple:
    """The least paths of a run of (kind, fault) between all states, by halves."""
    if len(rows) <= SPAN:
        return _short(tuple(rows))
    half = len(rows) // 2
    return _chained(summary(rows[:half]), summary(rows[half:]))


# --- blocks

PATHS = "array<struct<cost:long,letters:string>>"
BLOCK_SCHEMA = f"cid string, block long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, head int, tail int, paths {PATHS}"
_PATHS = pa.list_(pa.struct([("cost", pa.int64()), ("letters", pa.string())]))
_NUMBERS = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")


def blocks(narrow: DataFrame) -> DataFrame:
    """One row per conversation and block: counts, first and last initial, least paths."""
    schema = pa.schema(
        [("cid", pa.string()), ("block", pa.int64()), *[(c, pa.int64()) for c in _NUMBERS], ("head", pa.int32()), ("tail", pa.int32()), ("paths", _PATHS)]
    )

    def one(key: tuple, rows: Iterator[tuple]) -> tuple:
        codes, turns = [], set()
        blank = duplicate = truncated = illegal = 0
        last = head = None
        for _, _, place, _, _, n, unplaced, kind, empty, cut, first in rows:
            if not unplaced:
                turns.add(place)
            gone = n if empty else n - 1 if first else n
            if empty:
                blank += n
            else:
                duplicate += gone
                truncated += n - gone if cut else 0
            illegal += (n - 1 if (kind, kind) not in LEGAL else 0) + (1 if last is not None and (last, kind) not in LEGAL else 0)
            head, last = kind if head is None else head, kind
            if n > gone:
                codes.append((kind, CUT if cut else FINE))
            codes += [(kind, GONE)] * gone
        paths = [None if p is None else {"cost": p[0], "letters": p[1]} for ends in summary(codes) for p in ends]
        low, high = (min(turns), max(turns)) if turns else (None, None)
        return *key, low, high, len(turns), blank, duplicate, truncated, illegal, head, last, paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((one(k, g) for k, g in groupby(_rows(batches), key=lambda r: r[:2])), schema)

    ordered = narrow.repartition("cid", "block").sortWithinPartitions("cid", "block", "place", "role", "same")
    return ordered.mapInArrow(run, BLOCK_SCHEMA)


CONVERSATION_SCHEMA = (
    "cid string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<block:long,state:int,letters:string>>"
)


def conversations(summed: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, letters, and the letters of each block."""
    schema = pa.schema(
        [
            ("cid", pa.string()),
            *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
            ("audit", pa.string()),
            ("pieces", pa.list_(pa.struct([("block", pa.int64()), ("state", pa.int32()), ("letters", pa.string())]))),
        ]
    )

    def one(cid: str, rows: Iterator[tuple]) -> tuple:
        total = {c: 0 for c in _NUMBERS}
        low = high = last = None
        # of each state: cost, the letters since all paths were last alike
        ends: list = [(0, ""), None, None, None]
        back: list[tuple[int, list]] = []
        for _, block, first, final, *numbers, head, tail, paths in rows:
            for c, x in zip(_NUMBERS[2:], numbers):
                total[c] += x
            if first is not None:
                low, high = (first, final) if low is None else (min(low, first), max(high, final))
            total["illegal"] += last is not None and (last, head) not in LEGAL
            last = tail
            chosen: list = [None] * 4
            after: list = [None] * 4
            for t in range(4):
                through = [(s, paths[4 * s + t]) for s in range(4) if ends[s] is not None and paths[4 * s + t] is not None]
                found = [(ends[s][0] + p["cost"], ends[s][1] + p["letters"], s, p["letters"]) for s, p in through]
                if found:
                    width = max(len(x[1]) for x in found)
                    cost, letters, s, piece = min(found, key=lambda x: _weighed(x[0], x[1], width))
                    after[t], chosen[t] = (cost, letters), (s, piece)
            back.append((block, chosen))
            alike = _alike([e[1] for e in after if e is not None])
            ends = [None if e is None else (e[0], e[1][alike:]) for e in after]
        closing = [None if e is None else (s, e) for s, e in enumerate(ends)]
        done = []
        for found in closing:
            if found is not None:
                s, (cost, letters) = found
                missing = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[s]
                done.append((cost + 2 * len(missing), letters + missing, s, missing))
        width = max(len(x[1]) for x in done)
        cost, _, state, missing = min(done, key=lambda x: _weighed(x[0], x[1], width))
        pieces = []
        for block, chosen in reversed(back):
            state, piece = chosen[state]
            pieces.append({"block": block, "state": state, "letters": piece + missing})
            missing = ""
        pieces.reverse()
        gaps = 0 if low is None else high - low + 1 - total["turns"]
        counts = [min(gaps, -LOWEST - 1), total["blank"], total["duplicate"], total["truncated"], total["illegal"]]
        return cid, *counts, cost, "".join(p["letters"] for p in pieces), pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((one(k, g) for k, g in groupby(_rows(batches), key=lambda r: r[0])), schema)

    return summed.repartition("cid").sortWithinPartitions("cid", "block").mapInArrow(run, CONVERSATION_SCHEMA)


def _alike(texts: list[str]) -> int:
    """How many letters all texts begin with."""
    low, high = min(texts), max(texts)
    at = 0
    for a, b in zip(low, high):
        if a != b:
            break
        at += 1
    return at


def _lines(narrow: DataFrame, found: DataFrame) -> DataFrame:
    """cid, block, pos, place, same, role of the rows left; inserted rows have no ``same``."""
    schema = pa.schema([("cid", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("place", pa.int64()), ("same", pa.string()), ("role", pa.string())])
    names = {USER: "user", ASSISTANT: "assistant"}

    def one(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        # the chosen letters come first, then the block's rows
        _, _, _, _, _, state, letters = next(rows)[:7]
        todo = iter(letters)
        pos = 0

        def turned(state: int) -> int:
            return ASSISTANT if state == USER else USER

        def inserts(state: int) -> Iterator[tuple]:
            # up to the letter of the next row, which is sent last
            for c in todo:
                if c != "I":
                    yield c, state
                    return
                state = turned(state)
                yield "I", state

        for _, _, place, role, same, kind, _, n in rows:
            for _ in range(n):
                for c, state in inserts(state):
                    if c == "I":
                        yield *key, pos, None, None, names[state]
                    elif c == "K":
                        state = SYSTEM if kind == INITIALS["s"] else USER if kind == INITIALS["u"] else ASSISTANT
                        yield *key, pos, place, same, role
                    elif c == "R":
                        state = turned(state)
                        yield *key, pos, place, same, names[state]
                    pos += c != "D"
        for _, state in inserts(state):
            yield *key, pos, None, None, names[state]
            pos += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((x for k, g in groupby(_rows(batches), key=lambda r: r[:2]) for x in one(k, g)), schema)

    null = lambda kind: F.lit(None).cast(kind)
    piece = found.select("cid", F.explode("pieces").alias("p")).select(
        "cid", "p.block", null("long").alias("place"), null("string").alias("role"), null("string").alias("same"), F.col("p.state").alias("kind"), "p.letters", F.lit(0).cast("long").alias("n")
    )
    rows = narrow.select("cid", "block", "place", "role", "same", "kind", null("string").alias("letters"), "n")
    both = piece.unionByName(rows).repartition("cid", "block")
    return both.sortWithinPartitions("cid", "block", F.col("n") > 0, "place", "role", "same").mapInArrow(run, "cid string, block long, pos long, place long, same string, role string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was found and the repaired rows of conversations (conv_id, turn, role, text).

    The first result has cid (``conversation_key``), gaps, blank, duplicate,
    truncated, illegal, cost and audit; the second cid, block, pos, role and text,
    in the order of block and pos. A conversation of which nothing is left has no
    rows in the second one, one without rows none in both.
    """
    narrow = stored(marked(rows))
    found = stored(conversations(blocks(narrow)))
    lines = _lines(narrow, found)
    texts = keyed(rows).select("cid", "place", "same", "text").dropDuplicates(["cid", "place", "same"])
    kept = lines.where("same IS NOT NULL").join(texts, ["cid", "place", "same"]).select("cid", "block", "pos", "role", "text")
    new = lines.where("same IS NULL").select("cid", "block", "pos", "role", F.lit("").alias("text"))
    return found.drop("pieces"), kept.unionByName(new)


def digests(lines: DataFrame) -> DataFrame:
    """(cid, repaired_sha256): the digest of ``role:text`` joined by newlines, taken in a stream."""
    schema = pa.schema([("cid", pa.string()), ("repaired_sha256", pa.string())])

    def one(cid: str, rows: Iterator[tuple]) -> tuple:
        h = hashlib.sha256()
        for i, (_, _, _, role, text) in enumerate(rows):
            h.update(f"{chr(10) if i else ''}{role}:".encode())
            h.update(text.encode())
        return cid, h.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((one(k, g) for k, g in groupby(_rows(batches), key=lambda r: r[0])), schema)

    return lines.repartition("cid").sortWithinPartitions("cid", "block", "pos").mapInArrow(run, "cid string, repaired_sha256 string")


def repaired(table: DataFrame) -> DataFrame:
    """Damage, repair, and one row for every conv_id of the table."""
    found, lines = repair(damage(table))
    every = table.groupBy(conversation_key("conv_id").alias("cid")).agg(F.first("conv_id").alias("conv_id"))
    whole = every.join(found, "cid", "left").join(digests(lines), "cid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return whole.select(
        "conv_id",
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def repaired_sql() -> str:
    """DuckDB SQL of ``repaired`` over conversations, one row of a conversation at a time."""

    def grown(path: str, cost: str, letter: str, line: str) -> str:
        return f"CASE WHEN {path} IS NULL THEN NULL ELSE struct_pack(c := {path}.c + {cost}, a := {path}.a || '{letter}', r := {path}.r || {line}) END"

    def least(*paths: str) -> str:
        return f"list_sort(list_filter([{', '.join(paths)}], lambda x: x IS NOT NULL))[1]"

    line = "chr(10) || role || ':' || text"
    new = {t: f"chr(10) || '{n}:'" for t, n in ((USER, "user"), (ASSISTANT, "assistant"))}
    user = least("v2", *[grown(f"v{s}", "2", "I", new[USER]) for s in (START, SYSTEM, ASSISTANT)])
    assistant = least("v3", grown("w2", "2", "I", new[ASSISTANT]))

    def took(s: int, t: int) -> str:
        own = "u" if t == USER else "a"
        keep = grown(f"w{s}", "late", "K", line)
        change = grown(f"w{s}", "late + 2", "R", f"{new[t]} || text")
        return f"CASE WHEN fault IN ('blank', 'duplicate') THEN NULL WHEN initial = '{own}' THEN {keep} ELSE {change} END"

    def gone(s: int) -> str:
        return grown(f"w{s}", "3", "D", "''")

    keep_system = f"CASE WHEN fault IN ('blank', 'duplicate') OR initial <> 's' THEN NULL ELSE {grown('w0', 'late', 'K', line)} END"
    return f"""WITH RECURSIVE byte AS (SELECT i, list_reduce([i] || range(1, 9), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
         FROM (SELECT unnest(range(0, 256)) AS i)),
tab AS (SELECT list(v ORDER BY i) AS tb FROM byte),
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda x: ('0x' || x)::BIGINT),
      lambda c, b: xor(c >> 8, tb[xor(c, b) % 256 + 1])), 4294967295) % 20 AS roll FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE WHEN roll = 4 THEN 'user' ELSE role END AS role,
    CASE roll WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN roll = 3 THEN 2 ELSE 1 END)) AS copy FROM r WHERE roll <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM n),
x AS MATERIALIZED (SELECT *, left(role, 1) AS initial, CASE WHEN trimmed = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
walk AS (SELECT conv_id, 0 AS i, struct_pack(c := 0, a := '', r := '') AS v0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, r VARCHAR)) AS v1,
    CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, r VARCHAR)) AS v2, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, r VARCHAR)) AS v3 FROM (SELECT DISTINCT conv_id FROM x)
  UNION ALL SELECT conv_id, i, {gone(0)}, {least(gone(1), keep_system)}, {least(gone(2), took(0, 2), took(1, 2), took(3, 2))}, {least(gone(3), took(2, 3))}
  FROM (SELECT *, {assistant} AS w3 FROM (SELECT w.conv_id, x.i, x.role, x.text, x.initial, x.fault, CASE WHEN x.fault = 'truncated' THEN 1 ELSE 0 END AS late,
      v0 AS w0, v1 AS w1, v3, {user} AS w2 FROM walk w JOIN x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1))),
ends AS (SELECT conv_id, {least('v0', 'v3', grown('v2', '2', 'I', new[ASSISTANT]), grown('v1', '4', 'II', new[USER] + ' || ' + new[ASSISTANT]))} AS best
  FROM walk QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
pair AS (SELECT conv_id, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM (
  SELECT conv_id, initial, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM x) GROUP BY conv_id),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM x GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN pair p ON p.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN ends n ON n.conv_id IS NOT DISTINCT FROM e.conv_id"""
