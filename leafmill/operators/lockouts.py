"""Lockout after failed sign-ins, folded in parallel.

The rule is sequential: what an attempt does depends on the count of failures and the lock
before it. But a stretch of attempts is a small function from the state before it to the
state after it, and two such functions make one. So a user's attempts are cut into
blocks of equal size, each block becomes its function, functions are put together in a
tree, and the states so found let every block be gone through on its own: a user with a
third of all attempts is as many tasks as any.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import fixed_values as fv
from leafmill.functions.ordered import number_within
from leafmill.session import cut_lineage

BLOCK_ROWS = 4096  # attempts of a user that are gone through one after the other
FANOUT = 64  # functions that are put together one after the other

START = "failures int, until long"
FUNCTION = "u long, none boolean, block long, last long, classes array<int>, upto array<long>, reset array<boolean>, failures array<int>, until array<long>"


def sign_in(failures: int, until: int | None, at: int, success: bool, limit: int, span: int) -> tuple[int, int | None, str]:
    """One attempt, times in microseconds: (failures, until, outcome).

    While locked, nothing counts. The end of a lock leaves the count as it was, so one
    more failure locks again; the time of a lock that is over stays on record.
    """
    if until is not None and until > at:
        return failures, until, "rejected"
    if success:
        return 0, until, "success"
    if failures + 1 >= limit:
        return failures + 1, at + span, "locked"
    return failures + 1, until, "failure"


@dataclass
class Stretch:
    """What a stretch of attempts makes of a state.

    `pieces[c]` lists (upto, reset, failures, until): of a state with c failures (limit - 1
    stands for more) and a lock of at most `upto`, the smallest that fits, the stretch
    makes `failures` if it resets the count, else so many more, and sets the lock `until`
    or, if that is None, leaves it. A lock beyond the last `upto` outlives the stretch.
    """

    last: int
    pieces: list[list[tuple[int, bool, int, int | None]]]

    def end(self, failures: int, until: int | None) -> tuple[int, int | None]:
        found = self.find(min(failures, len(self.pieces) - 1), until)
        if found is None:
            return failures, until
        _, reset, more, lock = found
        return (more if reset else failures + more), (until if lock is None else lock)

    def find(self, c: int, until: int | None):
        mine = self.pieces[c]
        at = 0 if until is None else bisect.bisect_left(mine, until, key=lambda p: p[0])
        return mine[at] if at < len(mine) else None

    def then(self, other: Stretch) -> Stretch:
        """Both stretches, one after the other."""
        out = []
        for c, mine in enumerate(self.pieces):
            both = []
            for upto, reset, more, lock in mine:
                after = min(more if reset else c + more, len(self.pieces) - 1)
                found = other.find(after, lock)
                if found is not None:
                    _, again, further, later = found
                    reset, more, lock = reset or again, further if again else more + further, lock if later is None else later
                both.append((upto, reset, more, lock))
            both += [p for p in other.pieces[c] if p[0] > self.last]  # locks that outlive the first
            out.append(_joined(both))
        return Stretch(other.last, out)


def _joined(pieces: list) -> list:
    """Neighbouring pieces with one result are one."""
    out: list = []
    for p in pieces:
        if out and out[-1][1:] == p[1:]:
            out[-1] = p
        else:
            out.append(p)
    return out


def stretch_of(times: list[int], success: list[bool], limit: int, span: int) -> Stretch:
    """The function of some attempts in order, found from the last to the first."""
    n = len(times)
    ends: list = [None] * n + [[(False, 0, None)] * limit]
    for i in range(n - 1, -1, -1):
        if success[i]:
            reset, more, lock = ends[i + 1][0]
            ends[i] = [(True, more, lock)] * limit
            continue
        row = [(r, m if r else m + 1, k) for r, m, k in ends[i + 1][1:limit]]
        lock = times[i] + span
        r, m, k = ends[bisect.bisect_left(times, lock, i + 1)][limit - 1]  # the first attempt that is not rejected
        ends[i] = [*row, (r, m if r else m + 1, lock if k is None else k)]
    # a lock set before the stretch ends within `span` of its first attempt
    reach = min(n, bisect.bisect_left(times, times[0] + span) + 1)
    return Stretch(times[-1], [_joined([(times[i], *ends[i][c]) for i in range(reach)]) for c in range(limit)])


def _to_row(key: tuple, s: Stretch) -> dict:
    flat = [(c, *p) for c, mine in enumerate(s.pieces) for p in mine]
    return dict(zip(("u", "none", "block", "last", "classes", "upto", "reset", "failures", "until"), (*key, s.last, *map(list, zip(*flat)))))


def _from_row(row: dict, limit: int) -> Stretch:
    pieces: list[list] = [[] for _ in range(limit)]
    for c, *p in zip(row["classes"], row["upto"], row["reset"], row["failures"], row["until"]):
        pieces[c].append(tuple(p))
    return Stretch(row["last"], pieces)


def _arrow(spark_type):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_type)


def lockouts(attempts: DataFrame, failures_to_lock: int = fv.LOCKOUT_FAILURES, minutes: int = fv.LOCKOUT_MINUTES) -> DataFrame:
    """(user_id, ts, ord, outcome, failures, locked_until) of every sign-in attempt (user_id, ts, ord, success), in the order of (ts, ord).

    A null success is a failure; attempts without a user are those of one user. Times must
    not be null.
    """
    import pyarrow as pa

    limit, span = failures_to_lock, minutes * 60_000_000
    functions, size, fanout = _arrow(T.StructType.fromDDL(FUNCTION)), BLOCK_ROWS, FANOUT
    rows = attempts.select(F.coalesce("user_id", F.lit(0)).cast("long").alias("u"), F.col("user_id").isNull().alias("none"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
                           "ord", F.coalesce("success", F.lit(False)).alias("success"))
    rows = rows.withColumn("_day", F.floor(F.col("t") / 86_400_000_000))
    rows = number_within(rows, ["u", "none"], ["t", "ord"], "_day", "_n").withColumn("block", F.floor(F.col("_n") / size)).drop("_day", "_n")
    key = ["u", "none", "block"]
    sorted_rows = rows.repartition(*key).sortWithinPartitions(*key, "t", "ord")

    def fold(batches):
        """A function per block; rows come block by block."""
        now, times, marks = None, [], []
        for batch in batches:
            out = []
            for u, none, block, t, ok in zip(*(batch.column(c).to_pylist() for c in (*key, "t", "success"))):
                if now != (u, none, block):
                    if times:
                        out.append(_to_row(now, stretch_of(times, marks, limit, span)))
                    now, times, marks = (u, none, block), [], []
                times.append(t)
                marks.append(ok)
            yield from pa.Table.from_pylist(out, schema=functions).to_batches()
        if times:
            yield from pa.Table.from_pylist([_to_row(now, stretch_of(times, marks, limit, span))], schema=functions).to_batches()

    def put_together(table: pa.Table) -> pa.Table:
        mine = sorted(table.to_pylist(), key=lambda r: r["block"])
        whole = _from_row(mine[0], limit)
        for r in mine[1:]:
            whole = whole.then(_from_row(r, limit))
        return pa.Table.from_pylist([_to_row((mine[0]["u"], mine[0]["none"], mine[0]["block"] // fanout), whole)], schema=functions)

    starts_schema = T.StructType.fromDDL(f"u long, none boolean, block long, {START}")

    def walk(functions_: list[dict], failures: int, until: int | None) -> pa.Table:
        """The state before each of the functions in order."""
        out = []
        for r in sorted(functions_, key=lambda r: r["block"]):
            out.append({"u": r["u"], "none": r["none"], "block": r["block"], "failures": failures, "until": until})
            failures, until = _from_row(r, limit).end(failures, until)
        return pa.Table.from_pylist(out, schema=_arrow(starts_schema))

    levels = [cut_lineage(sorted_rows.mapInArrow(fold, FUNCTION))]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) >= fanout:
        up = levels[-1].withColumn("_up", F.floor(F.col("block") / fanout)).groupBy("u", "none", "_up")
        levels.append(cut_lineage(up.applyInArrow(lambda t: put_together(t.drop_columns(["_up"])), FUNCTION)))
    starts = levels[-1].groupBy("u", "none").applyInArrow(lambda t: walk(t.to_pylist(), 0, None), starts_schema)
    for level in reversed(levels[:-1]):
        children = level.withColumn("_up", F.floor(F.col("block") / fanout)).groupBy("u", "none", "_up")
        parents = starts.withColumnRenamed("block", "_up").groupBy("u", "none", "_up")

        def down(functions_: pa.Table, start: pa.Table) -> pa.Table:
            one = start.to_pylist()[0]
            return walk(functions_.drop_columns(["_up"]).to_pylist(), one["failures"], one["until"])

        starts = children.cogroup(parents).applyInArrow(down, starts_schema)

    out_schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("none", T.BooleanType()), T.StructField("t", T.LongType()), rows.schema["ord"],
                               T.StructField("outcome", T.StringType()), T.StructField("failures", T.IntegerType()), T.StructField("until", T.LongType())])

    def go_through(batches):
        now, state = None, None
        for batch in batches:
            made = []
            for u, none, block, t, ok, f, k in zip(*(batch.column(c).to_pylist() for c in (*key, "t", "success", "failures", "until"))):
                if now != (u, none, block):
                    now, state = (u, none, block), (f, k)
                *state, outcome = sign_in(*state, t, ok, limit, span)
                made.append((outcome, *state))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("none"), batch.column("t"), batch.column("ord"), pa.array([m[0] for m in made], pa.string()),
                                              pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.int64())], out_schema.names)

    joined = rows.join(starts, key).repartition(*key).sortWithinPartitions(*key, "t", "ord")
    done = joined.mapInArrow(go_through, out_schema)
    return done.select(F.when(~F.col("none"), F.col("u")).alias("user_id"), F.timestamp_micros("t").alias("ts"), "ord", "outcome", "failures", F.timestamp_micros("until").alias("locked_until"))
