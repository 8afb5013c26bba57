"""Repair of conversations: the cheapest edits after which the roles are ``(system? (user assistant)+)?``.

Nodes are (turns read, state), a state saying what the kept roles so far allow next; arcs are Keep (0), Insert (3), Rerole (3)
and Delete (4), and 3 more for a truncated turn that stays. Costs are small integers, so distances to the end come from Dial's
bucket queue: a ring of buckets, one a distance, taken in turn, each node settled when its bucket comes. Then the audit is walked
from the start along tight arcs (those on cheapest paths), of several the one of least letter. The letters fix the roles: in
each state only one role can be inserted or given.

Faults, first one counts: blank (no character but white space), duplicate (role and text seen earlier), truncated (last
character that isn't white space is none of ``.!?``). Blank and duplicate turns must go.

A conversation of up to BLOCK turns is repaired by one task that reads sorted rows and holds one conversation. Longer ones are
numbered over ranges and cut into blocks: a task finds a block's distances from each state to each, one scan over a
conversation's blocks (16 numbers each) gives the distance to the end after each block, a task walks a block from each state,
and another scan chains the states; repeated turns are found by a joint minimum of places. So the text of a conversation of any
length lies in as many tasks as it has blocks; only a digest over its whole repaired text, which is sequential, reads it in one,
block after block.

Turns are ordered by number, null first; those of one number by the digest of role and text, so equal rows are neighbours. A null
role or text is one space. A null id is a conversation like others. Roles that start with none of s, u, a (in lower case), empty
ones too, can't be kept. Texts may have any length. An empty table gives no rows; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, materialise, numbered, spread_join

#: Turns of a conversation that one task repairs at once.
BLOCK = 8192
KEEP, INSERT, REROLE, DELETE, TRUNCATED = 0, 3, 3, 4, 3
_LONGEST = max(DELETE, INSERT, REROLE + TRUNCATED, KEEP + TRUNCATED)
#: States: nothing yet, after system, after user, after assistant. The state that a turn's role leads to, if it may stand there.
_AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state that the one role which can be inserted or given leads to, and that role.
_NEXT, _ROLE = (2, 2, 3, 2), {2: "user", 3: "assistant"}
_BEFORE = {p: [q for q in range(4) if _NEXT[q] == p] for p in range(4)}
_NEVER = 1 << 60
_END = (0, _NEVER, _NEVER, 0)
_ID = ["known", "key"]  # a conversation, as columns that hold no null

#: What the search needs of a turn: its role's initial, whether it must go, whether it is truncated.
Turn = tuple[str, bool, bool]


def distances(turns: list[Turn], end: Iterable[int], last: bool) -> list[int]:
    """The least cost from each node 4 * turn + state to the end, where each state costs ``end`` more. last: turns may be inserted
    after these, too."""
    n, end = len(turns), list(end)
    dist = [_NEVER] * (4 * n + 4)
    now = min(end)
    size = max([_LONGEST, *(e - now for e in end if e < _NEVER)]) + 1
    ring: list[list[int]] = [[] for _ in range(size)]
    waiting = 0

    def reach(node: int, cost: int) -> int:
        if cost >= dist[node]:
            return 0
        dist[node] = cost
        ring[cost % size].append(node)
        return 1

    for q, e in enumerate(end):
        waiting += reach(4 * n + q, e)
    while waiting:
        bucket = ring[now % size]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != now:  # reached more cheaply since
                continue
            i, p = divmod(node, 4)
            if i < n or last:
                for q in _BEFORE[p]:
                    waiting += reach(4 * i + q, now + INSERT)
            if not i:
                continue
            initial, goes, truncated = turns[i - 1]
            before = 4 * i - 4
            waiting += reach(before + p, now + DELETE)
            if not goes:
                more = now + TRUNCATED * truncated
                for q in range(4):
                    if _AFTER.get((q, initial)) == p:
                        waiting += reach(before + q, more + KEEP)
                for q in _BEFORE[p]:
                    waiting += reach(before + q, more + REROLE)
        now += 1
    return dist


def walk(turns: list[Turn], dist: list[int], state: int, last: bool) -> Iterator[tuple[str, int, int]]:
    """(edit, turn, state after it) from ``state`` to the end, along tight arcs, of several the one of least letter."""
    n, i = len(turns), 0
    while i < n or (last and dist[4 * i + state]):
        here = dist[4 * i + state]
        initial, goes, truncated = turns[i] if i < n else ("", True, False)
        kept = None if goes else _AFTER.get((state, initial))
        if i < n and here == DELETE + dist[4 * i + 4 + state]:
            edit, i = "D", i + 1
        elif here == INSERT + dist[4 * i + _NEXT[state]]:
            edit, state = "I", _NEXT[state]
        elif kept is not None and here == KEEP + TRUNCATED * truncated + dist[4 * i + 4 + kept]:
            edit, i, state = "K", i + 1, kept
        else:
            edit, i, state = "R", i + 1, _NEXT[state]
        yield edit, i - (edit != "I"), state


def _streamed(rows: DataFrame, keys: list[str], order: list[Column | str], ddl: str, schema: pa.Schema, start: Callable, step: Callable, end: Callable) -> DataFrame:
    """Runs of equal keys in sorted partitions: state = start(), rows out of step(key, state, row), then of end(key, state)."""

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = row[: len(keys)]
                if key != now:
                    if now is not None:
                        out += end(now, state)
                    now, state = key, start()
                out += step(now, state, row[len(keys) :])
            if out:
                yield made(out)
        if now is not None:
            yield made(list(end(now, state)))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)


_EDIT = pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_REPAIRED = pa.schema(
    [("known", pa.bool_()), ("key", pa.string()), ("block", pa.int64()), ("blocks", pa.int64()), ("edits", pa.list_(_EDIT))]
    + [(c, pa.int64()) for c in ("cost", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high")]
    + [("first", pa.string()), ("last", pa.string())]
)
_REPAIRED_DDL = "known boolean, key string, block long, blocks long, edits array<struct<edit string, turn long, role string, text string>>, cost long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string"


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _repaired(key: tuple, rows: list[tuple]) -> list[tuple]:
    """One block: rows (turn, digest, role, text, blank, truncated, again, blocks, entry, goal)."""
    block, blocks, (_, _, _, _, _, _, _, _, entry, goal) = key[2], rows[0][7], rows[0]
    last, seen = block == blocks - 1, set()
    turns, counts, initials, numbers = [], [0, 0, 0], [], []
    for turn, digest, role, _, blank, truncated, again, *_ in rows:
        if again is None:  # the whole conversation is here
            again = digest in seen
            seen.add(digest)
        counts[0 if blank else 1 if again else 2] += blank or again or truncated
        turns.append((role[:1], blank or again, truncated))
        initials.append(role[:1])
        if turn is not None and (not numbers or numbers[-1] != turn):
            numbers.append(turn)
    dist = distances(turns, goal, last)
    edits, state = [], entry
    for edit, i, state in walk(turns, dist, entry, last):
        turn, _, role, text, *_ = rows[i] if edit != "I" else (None, None, None, "")
        edits.append((edit, turn, role if edit in "DK" else _ROLE[state], text))
    cost = dist[entry] - (0 if last else goal[state])
    illegal = sum(not _legal(a, b) for a, b in zip(initials, initials[1:]))
    low, high = (numbers[0], numbers[-1]) if numbers else (None, None)
    return [(*key[:2], block, blocks, [dict(zip(("edit", "turn", "role", "text"), e)) for e in edits], cost, *counts, illegal, len(numbers), low, high, initials[0], initials[-1])]


def _blocks_of_long(rows: DataFrame) -> DataFrame:
    """``rows`` of long conversations with their block, the number of blocks, whether their line stood earlier (again), the
    block's entry state and the costs after it (goal)."""
    rows = materialise(numbered(rows, _ID, ["turn", "digest"]), "numbered-turns")
    first = rows.groupBy(*_ID, "digest").agg(F.min("at").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    rows = spread_join(rows, materialise(first, "repeated-turns"), [*_ID, "digest"], "rows", ["first"], ["at"])
    rows = rows.withColumns({"again": F.coalesce(F.col("at") > F.col("first"), F.lit(False)), "block": F.floor(F.col("at") / BLOCK), "blocks": F.ceil(F.col("n") / BLOCK)})
    rows = materialise(rows.drop("first", "n"), "turns")
    narrow = rows.select(*_ID, "block", "at", F.substring("role", 1, 1).alias("initial"), (F.col("blank") | F.col("again")).alias("goes"), "truncated", "blocks")
    keyed = [("known", pa.bool_()), ("key", pa.string()), ("block", pa.int64())]
    numbers = pa.schema([*keyed, ("found", pa.list_(pa.int64()))])
    ddl = "known boolean, key string, block long, found array<bigint>"

    def gather(key: tuple, state: list, row: tuple) -> tuple:
        state.append(row)
        return ()

    def matrix(key: tuple, turns: list[tuple]) -> list[tuple]:
        last = key[2] == turns[0][4] - 1
        own = [(t[1], t[2], t[3]) for t in turns]
        columns = [distances(own, [0 if q == p else _NEVER for q in range(4)], last)[:4] for p in range(4)]
        return [(*key, [columns[p][q] for q in range(4) for p in range(4)])]

    def after(key: tuple, state: list, row: tuple) -> list[tuple]:
        """Blocks from the last to the first: what costs lie after each."""
        goal = list(state or _END)
        state[:] = [min(row[1][4 * q + p] + goal[p] for p in range(4)) for q in range(4)]
        return [(*key, row[0], goal)]

    def exits(key: tuple, turns: list[tuple]) -> list[tuple]:
        own, goal, last = [(t[1], t[2], t[3]) for t in turns], turns[0][5], key[2] == turns[0][4] - 1
        dist, out = distances(own, goal, last), []
        for q in range(4):
            out.append(q)
            if dist[q] < _NEVER:
                for _, _, out[q] in walk(own, dist, q, last):
                    pass
        return [(*key, out)]

    def chain(key: tuple, state: list, row: tuple) -> list[tuple]:
        entry = state[0] if state else 0
        state[:] = [row[1][entry]]
        return [(*key, row[0], [entry])]

    nothing = lambda key, state: ()
    costs = _streamed(narrow, [*_ID, "block"], ["at"], ddl, numbers, list, gather, matrix)
    goals = materialise(_streamed(costs, _ID, [F.col("block").desc()], ddl, numbers, list, after, nothing), "goals").withColumnRenamed("found", "goal")
    ends = _streamed(narrow.join(goals, [*_ID, "block"]), [*_ID, "block"], ["at"], ddl, numbers, list, gather, exits)
    entries = materialise(_streamed(ends, _ID, ["block"], ddl, numbers, list, chain, nothing), "entries").withColumn("entry", F.col("found")[0].cast("int"))
    return rows.join(goals, [*_ID, "block"]).join(entries.drop("found"), [*_ID, "block"])


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each block of a conversation (known, key: its id as a string): its edits in order (edit, turn, role, text;
    role and text as they are after it), cost, numbers of blank, duplicate and truncated turns and of illegal neighbours, its
    distinct turn numbers with the least and the greatest, and its first and last initials. Most have one block."""
    bound_batches(turns.sparkSession)
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    conversation = F.col(id_col).cast("string")
    rows = turns.select(conversation.isNotNull().alias("known"), F.coalesce(conversation, F.lit("")).alias("key"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    line = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2(line, 256)), "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "truncated": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")})
    sizes = rows.groupBy(*_ID).count().where(F.col("count") > BLOCK).withColumnRenamed("count", "rows")
    columns = [*_ID, "block", "turn", "digest", "role", "text", "blank", "truncated", "again", "blocks", "entry", "goal"]
    whole = {"block": F.lit(0).cast("long"), "again": F.lit(None).cast("boolean"), "blocks": F.lit(1).cast("long"), "entry": F.lit(0), "goal": F.array(*(F.lit(e).cast("long") for e in _END))}
    long = materialise(sizes, "long-conversations")
    if long.isEmpty():
        dealt = rows.withColumns(whole).select(*columns)
    else:
        parts = materialise(spread_join(rows, long, _ID, "rows", ["rows"], ["turn", "digest"]), "conversations")
        dealt = parts.where("rows is null").withColumns(whole).select(*columns).union(_blocks_of_long(parts.where("rows is not null").drop("rows")).select(*columns))

    def gather(key: tuple, state: list, row: tuple) -> tuple:
        state.append(row)
        return ()

    return _streamed(dealt, [*_ID, "block"], [F.col("turn").asc_nulls_first(), "digest"], _REPAIRED_DDL, _REPAIRED, list, gather, _repaired)


def reports(repaired: DataFrame) -> DataFrame:
    """(known, key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of
    `repair`: numbers left out among its turns, its faults, and the digest of ``role:text`` of what is left, line by line."""
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    audit = F.array_join(F.transform("edits", lambda e: e["edit"]), "")
    kept = F.filter("edits", lambda e: e["edit"] != "D")
    lines = F.array_join(F.transform(kept, lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    one = repaired.where("blocks = 1").select(*_ID, gaps.alias("gaps"), *counts, audit.alias("audit"), F.sha2(lines, 256).alias("repaired_sha256"))
    several = repaired.where("blocks > 1").select(*_ID, "block", *counts, "turns", "low", "high", "first", "last", audit.alias("audit"), (F.size(kept) > 0).alias("some"), lines.alias("lines"))

    def step(key: tuple, state: dict, row: tuple) -> tuple:
        _, *numbers, turns, low, high, first, last, audit, some, lines = row
        for k, v in enumerate(numbers):
            state["counts"][k] += v
        if state["last"] is not None:
            state["counts"][3] += not _legal(state["last"], first)
        if low is not None:
            state["turns"] += turns - (state["high"] == low)
            state["low"] = low if state["low"] is None else state["low"]
            state["high"] = high
        state["last"] = last
        state["audit"].append(audit)
        if some:
            state["hash"].update(("\n" if state["some"] else "").encode() + lines.encode("utf-8", "surrogatepass"))
            state["some"] = True
        return ()

    def start() -> dict:
        return {"counts": [0] * 5, "turns": 0, "low": None, "high": None, "last": None, "audit": [], "hash": hashlib.sha256(), "some": False}

    def end(key: tuple, state: dict) -> list[tuple]:
        gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
        return [(*key, gaps, *state["counts"], "".join(state["audit"]), state["hash"].hexdigest())]

    schema = pa.schema([("known", pa.bool_()), ("key", pa.string()), ("gaps", pa.int64()), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    ddl = "known boolean, key string, gaps long, " + "".join(f"{c} long, " for c in counts) + "audit string, repaired_sha256 string"
    return one.union(_streamed(several, _ID, ["block"], ddl, schema, start, step, end))


def with_ids(found: DataFrame, turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``found`` for every conversation of ``turns``, under its own id; one of which nothing was found: zeros and empty texts."""
    text = F.col(id_col).cast("string")
    ids = turns.select(F.col(id_col)).distinct().withColumns({"known": text.isNotNull(), "key": F.coalesce(text, F.lit(""))})
    out = ids.join(found, _ID, "left")
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return out.select(F.col(id_col), *(F.coalesce(F.col(c), none.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns if c not in _ID))
