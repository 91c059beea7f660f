"""Repair of a conversation's structure by the cheapest edits, over a shared grammar.

Each row is one symbol: its role's initial and whether it is whole, truncated or must go. Re-Pair
turns the frequent pairs of symbols into rules that all conversations share. A symbol is a
transfer matrix over the states of a well-formed conversation, ``(s?(ua)+)?``, in the
semiring of (cost, audit): the least cost, then the least audit. A rule's matrix is the
product of its two sides', made once and bottom-up, its audits ropes over theirs. So a
conversation is a short product of matrices, and its edits are read off one rope.

The order of audits survives concatenation: two audits of the same rows and cost cannot be
one a beginning of the other, since the longer has more insertions and so costs more.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import cut, fresh

#: Costs of the edits, and of a truncated row that stays.
RECAST, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Where a role's initial leads from: 0 nothing yet, 1 after the system row, 2 after a user, 3 after an assistant.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTS = (0, 3)
#: Symbols of rows: the initial (o: any other), in capitals if truncated; x must be deleted.
GONE, OTHER = "x", "o"
#: Rules are written as characters from here on.
_FIRST_RULE = 0x4E00
_WHITE = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
COUNTS = ("gaps", *FAULTS, "illegal")


# --- ropes and matrices


def _leaves(rope):
    stack = [rope]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        else:
            stack += (x[1], x[0])


def flat(rope) -> str:
    return "".join(_leaves(rope))


def joined(a, b):
    """A rope of both: a plain string while it is short, else a pair that shares its sides."""
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= 64:
        return a + b
    return (a, b) if a and b else a or b


def before(a, b) -> bool:
    """Whether rope a is less than rope b, read leaf by leaf up to the first difference."""
    one, two, x, y = _leaves(a), _leaves(b), "", ""
    while True:
        x, y = x or next(one, ""), y or next(two, "")
        if not x or not y:
            return bool(y)
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]


def better(p, q) -> bool:
    """Whether the (cost, rope) p comes before q; None is no way at all."""
    if p is None or q is None:
        return p is not None
    return p[0] < q[0] or p[0] == q[0] and before(p[1], q[1])


def product(a: list, b: list) -> list:
    """Rows of (cost, rope) times a 4 x 4 matrix, in the semiring."""
    out = []
    for row in a:
        made = [None] * 4
        for k, p in enumerate(row):
            if p is not None:
                for j, q in enumerate(b[k]):
                    if q is not None and (made[j] is None or p[0] + q[0] <= made[j][0]):
                        r = (p[0] + q[0], joined(p[1], q[1]))
                        if better(r, made[j]):
                            made[j] = r
        out.append(made)
    return out


def _matrix(ways) -> list:
    m = [[None] * 4 for _ in range(4)]
    for i, j, cost, op in ways:
        if better((cost, op), m[i][j]):
            m[i][j] = (cost, op)
    return m


def _insertions() -> list:
    """Any number of insertions: a user or an assistant row, wherever the state allows it."""
    step = [(i, j, INSERT, "I") for (i, r), j in STEPS.items() if r in "ua"]
    once = _matrix([(i, i, 0, "") for i in range(4)] + step)
    return product(product(once, once), once)


def terminals() -> dict[str, list]:
    """The matrix of every row symbol: insertions before the row, then what becomes of it."""
    out, stays = {}, _insertions()
    for symbol in "suaoSUAOx":
        ways = [(i, i, DELETE, "D") for i in range(4)]
        if symbol != GONE:
            more = TRUNCATED if symbol.isupper() else 0
            ways += [(i, j, more, "K") for (i, r), j in STEPS.items() if r == symbol.lower()]
            ways += [(i, j, RECAST + more, "R") for (i, r), j in STEPS.items() if r in "ua"]
        out[symbol] = product(stays, _matrix(ways))
    return out


class Grammar:
    """Rules (pairs of symbols, each later than its parts), and a matrix for each."""

    def __init__(self, rules: tuple[str, ...]) -> None:
        self.rules = [(pair, chr(_FIRST_RULE + k)) for k, pair in enumerate(rules)]
        self.matrices = terminals()
        for pair, name in self.rules:
            self.matrices[name] = product(self.matrices[pair[0]], self.matrices[pair[1]])
        self.known: dict[str, tuple[int, str]] = {}

    def compress(self, symbols: str) -> str:
        for pair, name in self.rules:
            symbols = symbols.replace(pair, name)
        return symbols

    def expand(self, symbols: str) -> str:
        for pair, name in reversed(self.rules):
            symbols = symbols.replace(name, pair)
        return symbols

    def cheapest(self, symbols: str) -> tuple[int, str]:
        """(cost, audit) of a conversation; equal ones are worked out once a worker."""
        found = self.known.get(symbols)
        if found is None:
            row = [[(0, ""), None, None, None]]
            for symbol in self.compress(symbols):
                row = product(row, self.matrices[symbol])
            end = product(row, _insertions())[0]
            best = None
            for state in ACCEPTS:
                if better(end[state], best):
                    best = end[state]
            found = best[0], flat(best[1])
            if len(symbols) <= 64:
                if len(self.known) >= 200_000:
                    self.known.clear()
                self.known[symbols] = found
        return found


@lru_cache(maxsize=2)
def _grammar(rules: tuple[str, ...]) -> Grammar:
    return Grammar(rules)


def repair_rules(sequences: DataFrame, col: str, most: int = 512, rounds: int = 12) -> tuple[str, ...]:
    """Re-Pair over all sequences: in each round the pairs at least half as frequent as the
    most frequent one become rules, until none occurs twice, ``most`` rules are made or
    ``rounds`` have passed. Pairs are counted in their partitions first; a round returns at
    most ``most`` of them. The rules change how much is shared, never a result."""
    rules: list[str] = []
    for _ in range(rounds):
        done = tuple(rules)

        def count(batches, done=done):
            import pyarrow as pa

            total: Counter = Counter()
            grammar = _grammar(done)
            for batch in batches:
                for s in batch.columns[0].to_pylist():
                    s = grammar.compress(s)
                    pairs = Counter(map("".join, zip(s, s[1:], strict=False)))
                    for pair in pairs:  # a run of one symbol holds half as many pairs
                        total[pair] += pairs[pair] if pair[0] != pair[1] else s.count(pair)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["pair", "n"])

        counts = sequences.select(col).mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        found = counts.where("n > 1").orderBy(F.desc("n"), "pair").limit(most - len(rules)).collect()
        rules += [r.pair for r in found if 2 * r.n >= found[0].n]
        if not found or len(rules) >= most:
            break
    return tuple(rules)


# --- conversations


def _ordered(rows: DataFrame, names: tuple[str, ...], copies: str | None) -> DataFrame:
    conv, turn, role, text = names
    null = F.lit(" ")
    n = F.col(copies).cast("int") if copies else F.lit(1)
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), null).alias("role"),
        F.coalesce(F.col(text).cast("string"), null).alias("text"), F.coalesce(n, F.lit(0)).alias("copies"),
    )


def _symbols(batches):
    """Rows in order to one row a conversation: its counts and its symbols."""
    names = ["conv", *COUNTS, "symbols"]
    open_, done, kind = None, [], None

    def close():
        kinds, turns = open_["kinds"], open_["turns"]
        gaps = open_["last"] - open_["first"] + 1 - turns if turns else 0
        done.append((open_["conv"], gaps, *(kinds[f] for f in FAULTS), open_["illegal"], "".join(open_["symbols"])))

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, new, turn, initial, fault, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if new:
                if open_ is not None:
                    close()
                open_ = {"conv": conv, "kinds": Counter(), "turns": 0, "first": None, "last": None, "illegal": 0, "symbols": [], "role": None}
            for k in range(copies):
                f = "duplicate" if k and fault != "blank" else fault
                open_["kinds"][f] += 1
                low = initial if initial in ("s", "u", "a") else OTHER
                open_["symbols"].append(GONE if f in ("blank", "duplicate") else low.upper() if f == "truncated" else low)
                if open_["role"] is not None and open_["role"] + initial not in ("su", "ua", "au"):
                    open_["illegal"] += 1
                open_["role"] = initial
            if copies and turn is not None:
                if turn != open_["last"]:
                    open_["turns"] += 1
                open_["last"] = turn
                open_["first"] = turn if open_["first"] is None else open_["first"]
        if len(done) >= 4096:
            yield _record(done, kind, names, "cnnnnns")
            done = []
    if open_ is not None:
        close()
        yield _record(done, kind, names, "cnnnnns")


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _record(rows: list[tuple], kind, names: list[str], form: str):
    """An Arrow batch of rows; form has a letter for each column: the conversation's id (of
    its own type), a whole number or a string."""
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    types = [{"c": kind, "n": pa.int64(), "s": pa.string()}[f] for f in form]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def plans(rows: DataFrame, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), copies: str | None = None, rules: int = 512) -> DataFrame:
    """One row a conversation: (conv, gaps, blank, duplicate, truncated, illegal, symbols,
    cost, audit). ``names`` are the columns of conversation, turn, role and text.

    Rows count in order of turn (nulls first), role, text. Null roles and texts are one blank;
    a null conversation id is one conversation. ``copies`` names a column of how often a row
    counts in place; with 0 a row only says that its conversation exists. A row's first fault
    counts: blank (nothing but white space), duplicate (role and text seen before), truncated
    (does not end in ``.``, ``!`` or ``?``). A conversation without rows has zeros and an
    empty audit.

    A conversation's rows pass one task in order, sorted by Spark with spilling; the worker
    keeps one character of each.
    """
    r = _ordered(rows, names, copies)
    key = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))
    r = r.withColumn("h", key).repartition("conv")
    order = ["gone", F.asc_nulls_first("turn"), "role", "text"]
    r = r.withColumn("gone", (F.col("copies") <= 0).cast("int"))
    # both windows and the sort use the one exchange by conversation
    seen = F.row_number().over(Window.partitionBy("conv", "h").orderBy(*order)) > 1
    r = r.withColumn("seen", seen).withColumn("new", F.row_number().over(Window.partitionBy("conv").orderBy(*order, "seen")) == 1)
    end = F.rtrim("text", F.lit(_WHITE))
    last = F.right(end, F.lit(1))
    fault = F.when(end == "", "blank").when(F.col("seen"), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    fed = r.sortWithinPartitions(F.asc_nulls_first("conv"), *order, "seen").select("conv", "new", "turn", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"), "copies")
    kind = r.schema["conv"].dataType
    schema = StructType([StructField("conv", kind), *(StructField(c, LongType()) for c in COUNTS), StructField("symbols", StringType())])
    found = cut(fed.mapInArrow(_symbols, schema))
    made = repair_rules(cut(found.select("symbols").distinct()), "symbols", rules)

    def solve(batches):
        import pyarrow as pa

        grammar = _grammar(made)
        for batch in batches:
            got = [grammar.cheapest(s) for s in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string())], [*batch.schema.names, "cost", "audit"])

    return found.mapInArrow(solve, StructType([*schema.fields, StructField("cost", LongType()), StructField("audit", StringType())]))


def _edits(batches):
    """Follows each conversation's audit along its rows: (conv, role, text) for every row of
    the repaired one, in order, then (conv, counts, cost, audit) after the last."""
    plan, ops, at, state = None, "", 0, 0

    def insertions():
        nonlocal at, state
        while at < len(ops) and ops[at] == "I":
            yield plan[0], "assistant" if state == 2 else "user", ""
            state, at = 3 if state == 2 else 2, at + 1

    for batch in batches:
        for conv, row, role, text, copies, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not row:  # the plan comes before the rows
                if plan is not None:
                    yield from insertions()
                    yield plan
                plan, ops, at, state = (conv, *counts, text), text, 0, 0
                continue
            for _ in range(copies):
                yield from insertions()
                op, at = ops[at], at + 1
                if op != "D":
                    to = role if op == "K" else "assistant" if state == 2 else "user"
                    yield conv, to, text
                    state = STEPS[state, to[0]]
    if plan is not None:
        yield from insertions()
        yield plan


def _followed(rows: DataFrame, plan: DataFrame, names, copies) -> DataFrame:
    counts = [*COUNTS, "cost"]
    r = _ordered(rows, names, copies).where("copies > 0").select("conv", F.lit(1).alias("row"), "turn", "role", "text", "copies", *(F.lit(None).cast("long").alias(c) for c in counts))
    p = plan.select("conv", F.lit(0).alias("row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).alias("copies"), *counts)
    both = p.unionByName(r).repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "row", F.asc_nulls_first("turn"), "role", "text")
    return both.drop("turn")


def repaired(rows: DataFrame, plan: DataFrame, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), copies: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text): the rows of the repaired conversations, turns numbered
    from 0. Texts stay as they are; inserted rows have empty ones."""
    fed = _followed(rows, plan, names, copies)
    conv, turn, role, text = names
    schema = StructType([StructField(conv, fed.schema["conv"].dataType), StructField(turn, LongType()), StructField(role, StringType()), StructField(text, StringType())])

    kind = _arrow(fed.schema["conv"].dataType)

    def run(batches):
        done, n = [], 0
        for made in _edits(batches):
            if len(made) > 3:
                n = 0
                continue
            done.append((made[0], n, *made[1:]))
            n += 1
            if len(done) >= 1024:
                yield _record(done, kind, schema.names, "cnss")
                done = []
        yield _record(done, kind, schema.names, "cnss")

    return fed.mapInArrow(run, schema)


def digests(rows: DataFrame, plan: DataFrame, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), copies: str | None = None) -> DataFrame:
    """The plans with the SHA-256 of each repaired conversation (``role:text``, joined by line
    feeds), taken row by row: nothing of a conversation is held."""
    fed = _followed(rows, plan, names, copies)
    out = [names[0], *COUNTS, "cost", "audit", "repaired_sha256"]
    kinds = {names[0]: fed.schema["conv"].dataType, "audit": StringType(), "repaired_sha256": StringType()}
    schema = StructType([StructField(c, kinds.get(c, LongType())) for c in out])

    kind = _arrow(fed.schema["conv"].dataType)

    def run(batches):
        sha, first, done = hashlib.sha256(), True, []
        for made in _edits(batches):
            if len(made) == 3:
                sha.update(f"{'' if first else chr(10)}{made[1]}:{made[2]}".encode())
                first = False
                continue
            done.append((*made, sha.hexdigest()))
            sha, first = hashlib.sha256(), True
            if len(done) >= 4096:
                yield _record(done, kind, out, "cnnnnnnss")
                done = []
        yield _record(done, kind, out, "cnnnnnnss")

    return fed.mapInArrow(run, schema)


# --- damage, to measure repairs by


def damaged(rows: DataFrame, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), copies: str = "copies") -> DataFrame:
    """rows with one fault in four of 20 places of crc32(``conversation:turn``), and one more
    in a fifth: 0 drops the row (no copies), 1 empties its text, 2 takes out its ``.``, ``!``
    and ``?``, 3 repeats it (two copies), 4 makes its role user. Nulls are one blank."""
    conv, turn, role, text = names
    n = fresh(copies, rows.columns)
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat(known(conv), F.lit(":"), known(turn)).cast("binary")), F.lit(20))
    new_text = F.when(k == 1, "").when(k == 2, F.translate(known(text), ".!?", "")).otherwise(known(text))
    new_role = F.when(k == 4, "user").otherwise(known(role))
    number: Column = F.when(k == 0, 0).when(k == 3, 2).otherwise(1)
    return rows.withColumns({text: new_text, role: new_role, n: number})
