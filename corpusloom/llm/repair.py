"""Repair of the structure of conversations by a run-length dynamic program.

A conversation is well formed if its roles' initials match ``(s?(ua)+)?``.  Each row has at most one fault,
the first of: blank (nothing but white space), duplicate (role and text seen earlier),
truncated (the text doesn't end with one of ``.!?``).  The edits are Keep (0), Rerole to user or
assistant (3), Delete (4; the only one for blank and duplicate rows) and Insert of an empty
message anywhere (3); a truncated row that stays costs 3 more.

A row is a symbol: its role's class with its fault.  Equal consecutive symbols are one run.  A symbol is a
min-plus matrix over the four states of the pattern (start, s, u, a); a run is a power of
it, made of cached powers of two.  Costs to go are carried backwards over the runs; then the choices
are unrolled forwards, run by run in halves, always with the letter that is ASCII-least among
the cheapest (``DIKR``).  From a state a letter leads to one state only, so the audit is the least of all cheapest ones.

Scale: a conversation is read by one task, in order, and is gone when the next begins; all texts are shuffled
once.  Conversations of more than ``LONG_ROWS`` rows or ``LONG_BYTES`` of text are counted beforehand and
go another way that gives the same rows: their rows are sorted into ranges (a hot conversation
spans many), cut into pieces of 4096, whose matrices are multiplied in parallel.  Only a piece's
matrix (16 numbers), its ends and its letters are gathered by conversation.  What remains in one task is what the result asks for: one
SHA-256 over the whole repaired conversation, streamed, and one audit string.

Edge cases: a null role or text is one space.  A null id is one conversation, null turns
come first.  Rows of equal turn are ordered by role, then by the SHA-256 of role and text; equal rows
are interchangeable.  Roles whose first character is not s, u or a (the empty role too) can't be kept.  A gap beyond a long is the
largest long.  Conversations without rows don't occur here; ``digest`` adds them.  An empty
table gives an empty result.  Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import broadcast_if_small, column, materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
LONG_ROWS, LONG_BYTES = 1 << 16, 1 << 25
#: Rows of a piece of a long conversation, as a power of two.
PIECE_BITS = 12
START, S, U, A = range(4)
ROLE = {U: "user", A: "assistant"}
_LEGAL = {"su", "ua", "au"}
_FAR = 1 << 60
_LONG = (1 << 63) - 1
#: The symbol of a row that must go; other symbols are the role's class (o: none), in upper case if truncated.
GONE = "-"

Vector = tuple[int, int, int, int]


def added(state: int) -> int:
    """Where an inserted or reroled message leads."""
    return A if state == U else U


def kept(symbol: str, state: int) -> int | None:
    """Where a kept message leads, if it may follow."""
    kind = symbol.lower()
    if kind == "s":
        return S if state == START else None
    if kind in "ua":
        return added(state) if "ua"[added(state) - U] == kind else None
    return None


@lru_cache(None)
def step(symbol: str) -> tuple[Vector, ...]:
    """The min-plus matrix of a row: any inserts, then one edit."""
    out = []
    for state in range(4):
        row, at, cost = [_FAR] * 4, state, 0
        for _ in range(3):
            row[at] = min(row[at], cost + DELETE)
            if symbol != GONE:
                stays = cost + TRUNCATED * symbol.isupper()
                row[added(at)] = min(row[added(at)], stays + REROLE)
                if (to := kept(symbol, at)) is not None:
                    row[to] = min(row[to], stays + KEEP)
            at, cost = added(at), cost + INSERT
        out.append(tuple(row))
    return tuple(out)


#: Costs to go after the last row: inserts up to an accepted state.
END: Vector = (0, 2 * INSERT, INSERT, 0)


def product(x: tuple[Vector, ...], y: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(min(a[k] + y[k][j] for k in range(4)) for j in range(4)) for a in x)


@lru_cache(None)
def power(symbol: str, bit: int) -> tuple[Vector, ...]:
    """The matrix of 2^bit rows of one symbol."""
    return step(symbol) if bit == 0 else product(power(symbol, bit - 1), power(symbol, bit - 1))


@lru_cache(1 << 16)
def before(symbol: str, length: int, after: Vector) -> tuple[Vector, int]:
    """Costs to go before a run, less their least one, and that."""
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            m = power(symbol, bit)
            after = tuple(min(map(sum, zip(row, after, strict=True))) for row in m)
    low = min(after)
    return tuple(c - low for c in after), low


@lru_cache(1 << 16)
def choice(symbol: str, after: Vector, state: int) -> tuple[str, int]:
    """The letters for one row, inserts before it included, and the state behind it."""
    (costs, low), letters = before(symbol, 1, after), ""
    while True:
        cost = costs[state] + low
        if DELETE + after[state] == cost:
            return letters + "D", state
        if INSERT + costs[added(state)] + low == cost:
            letters, state = letters + "I", added(state)
            continue
        stays = TRUNCATED * symbol.isupper()
        if (to := kept(symbol, state)) is not None and KEEP + stays + after[to] == cost:
            return letters + "K", to
        return letters + "R", added(state)


@lru_cache(1 << 14)
def unrolled(symbol: str, length: int, after: Vector, state: int) -> tuple[tuple[str, ...], int]:
    """The letters of each row of a run, and the state behind it."""
    if length == 1:
        letters, state = choice(symbol, after, state)
        return (letters,), state
    half = length // 2
    first, state = unrolled(symbol, length - half, before(symbol, half, after)[0], state)
    second, state = unrolled(symbol, half, after, state)
    return first + second, state


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(s, len(list(g))) for s, g in groupby(symbols)]


def walk(symbols: list[tuple[str, int]], after: Vector, state: int) -> tuple[list[str], int]:
    """The letters of each row of the runs ``symbols``, and the state behind them."""
    stack = []
    for symbol, length in reversed(symbols):
        stack.append((symbol, length, after))
        after, _ = before(symbol, length, after)
    letters = []
    while stack:
        more, state = unrolled(*stack.pop(), state)
        letters += more
    return letters, state


def ending(state: int) -> str:
    """The letters behind the last row."""
    return "I" * (END[state] // INSERT)


def messages(letters: list[str], roles: list, texts: list, state: int) -> list[list[tuple[str, str]]]:
    """For each row the messages (role, text) that its letters give, in order."""
    out = []
    for own, role, text in zip(letters, roles, texts, strict=True):
        lines = []
        for letter in own:
            if letter == "D":
                continue
            if letter == "K":
                state = {"s": S, "u": U, "a": A}[role[0]]
                lines.append((role, text))
            else:
                state = added(state)
                lines.append((ROLE[state], "" if letter == "I" else text))
        out.append(lines)
    return out


def symbol_of(initial: str, blank: bool, cut: bool, again: bool) -> str:
    if blank or again:
        return GONE
    kind = initial if initial in ("s", "u", "a") else "o"
    return kind.upper() if cut else kind


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): ``rows`` with a fifth of them damaged by the hash of id and turn.

    Of 20 hashes, 0 drops the row, 1 empties the text, 2 removes its ``.!?``, 3 repeats the
    row, 4 makes its role user.  Nulls are one space.
    """
    conv, turn, role, text = (column(c) for c in ("conv_id", "turn", "role", "text"))
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    whole = shown(text)
    changed = rows.select(
        conv.alias("conv_id"),
        turn.alias("turn"),
        F.when(kind == 4, "user").otherwise(shown(role)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(whole, ".!?", "")).otherwise(whole).alias("text"),
        kind.alias("kind"),
    ).where(F.col("kind") != 0)
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return changed.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


@dataclass
class Repaired:
    """``short``: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, messages array),
    a row for each conversation.  Long ones, if there are any, have (conv, ... audit) in
    ``long`` and their messages in ``long_messages``: (conv, at, role, text), ordered by ``at``."""

    short: DataFrame
    long: DataFrame | None = None
    long_messages: DataFrame | None = None

    def report(self) -> DataFrame:
        short = self.short.drop("messages")
        return short if self.long is None else short.unionByName(self.long)

    def messages(self) -> DataFrame:
        """(conv, at, role, text): the repaired conversations."""
        short = self.short.select("conv", F.posexplode("messages").alias("at", "m")).select("conv", F.col("at").cast("long").alias("at"), "m.role", "m.text")
        return short if self.long_messages is None else short.unionByName(self.long_messages)

    def digests(self) -> DataFrame:
        """(conv, ..., audit, repaired_sha256): the report with the hash of ``role:text`` lines."""
        lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
        short = self.short.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("messages")
        if self.long is None:
            return short
        hashes = _in_order(self.long_messages, "at", _hashed, f"conv {_kind(self.short)}, repaired_sha256 string")
        long = _joined(self.long, hashes).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
        return short.unionByName(long)


def _kind(df: DataFrame) -> str:
    return df.schema["conv"].dataType.simpleString()


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with the columns of ``right`` by conversation (and piece, where both have it); null ids are equal."""
    keys = [c for c in ("conv", "piece") if c in left.columns and c in right.columns]
    other = right.withColumnsRenamed({c: f"{c}_" for c in keys})
    on = [left[c].eqNullSafe(other[f"{c}_"]) for c in keys]
    return left.join(other, on, "left").drop(*[f"{c}_" for c in keys])


def _groups(batches: Iterator[pa.RecordBatch], size: int = 4096) -> Iterator[tuple]:
    """(id, slices of batches) of the conversations in order, each slice when it is read."""
    conv, held = None, []
    for whole in batches:
        for start in range(0, whole.num_rows, size):
            batch = whole.slice(start, size)
            ids, at = batch.column(0).to_pylist(), 0
            for key, group in groupby(ids):
                n = len(list(group))
                if held and key != conv:
                    yield conv, held
                    held = []
                conv = key
                held.append(batch.slice(at, n))
                at += n
    if held:
        yield conv, held


def _in_order(df: DataFrame, by: str | list[str], f: Callable, schema: str) -> DataFrame:
    """``f`` over batches of ``df`` in which conversations are whole and in order."""
    keys = ["conv", *([by] if isinstance(by, str) else by)]
    return df.repartition("conv").sortWithinPartitions(*keys).mapInArrow(f, schema)


def _lists(slices: list[pa.RecordBatch], *names: str) -> list[list]:
    return [[v for s in slices for v in s.column(n).to_pylist()] for n in names]


def _illegal(initials: list[str]) -> int:
    return sum(x + y not in _LEGAL for x, y in zip(initials, initials[1:], strict=False))


def repair(
    rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, piece_bits: int = PIECE_BITS
) -> Repaired:
    """The cheapest repair of every conversation."""
    shown = lambda c: F.coalesce(column(c).cast("string"), F.lit(" "))
    base = rows.select(column(id_col).alias("conv"), column(turn_col).cast("long").alias("turn"), shown(role_col).alias("role"), shown(text_col).alias("text"))
    sizes = base.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    large = materialize(sizes.where((F.col("n") > long_rows) | (F.col("size") > long_bytes)).select("conv"), "long-conversations")
    count = large.count()
    if not count:
        return Repaired(_short(_prepared(base)))
    ids = broadcast_if_small(large.select(F.col("conv").alias("long")), count)
    own = base["conv"].eqNullSafe(ids["long"])
    report, lines = _long(_prepared(base.join(ids, own, "left_semi")), piece_bits)
    return Repaired(_short(_prepared(base.join(ids, own, "left_anti"))), report, lines)


def _prepared(base: DataFrame) -> DataFrame:
    """Rows with what their symbols depend on: initial, blank, cut, digest (of role and text)."""
    body = F.rtrim("text", F.lit(SPACE))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return base.select("*", F.substring("role", 1, 1).alias("initial"), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"), digest.alias("digest"))


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _short(rows: DataFrame) -> DataFrame:
    schema = f"conv {_kind(rows)}, {_COUNTS}, messages array<struct<role:string,text:string>>"
    kinds = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def each(batches):
        ids, found, size = [], [], 0

        def batch():
            columns = [pa.concat_arrays(ids), *(pa.array(c, pa.int64()) for c in list(zip(*found, strict=True))[:6]), pa.array([f[6] for f in found], pa.string()), pa.array([f[7] for f in found], kinds)]
            return pa.RecordBatch.from_arrays(columns, [*(c.split()[0] for c in f"conv x, {_COUNTS}".split(", ")), "messages"])

        for _, slices in _groups(batches):
            turns, roles, texts, initials, blank, cut, digests = _lists(slices, "turn", "role", "text", "initial", "blank", "cut", "digest")
            seen, symbols, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
            for i, b, c, d in zip(initials, blank, cut, digests, strict=True):
                again = d in seen
                seen.add(d)
                symbols.append(symbol_of(i, b, c, again))
                if fault := "blank" if b else "duplicate" if again else "truncated" if c else None:
                    counts[fault] += 1
            done = runs("".join(symbols))
            after, cost = END, 0
            for symbol, length in reversed(done):
                after, low = before(symbol, length, after)
                cost += low
            cost += after[START]
            letters, state = walk(done, END, START)
            last = ending(state)
            lines = [{"role": r, "text": t} for own in messages(letters, roles, texts, START) for r, t in own]
            for _ in last:
                state = added(state)
                lines.append({"role": ROLE[state], "text": ""})
            known = [t for t in turns if t is not None]
            gaps = min(max(known) - min(known) + 1 - len(set(known)), _LONG) if known else 0
            ids.append(slices[0].column(0).slice(0, 1))
            found.append((gaps, *counts.values(), _illegal(initials), cost, "".join(letters) + last, lines))
            size += sum(map(len, texts))
            if len(ids) >= 2000 or size > 8_000_000:
                yield batch()
                ids, found, size = [], [], 0
        if ids:
            yield batch()

    return _in_order(rows, ["turn", "role", "digest"], each, schema)


def _long(rows: DataFrame, piece_bits: int) -> tuple[DataFrame, DataFrame]:
    """(report, messages) of long conversations."""
    kind = _kind(rows)
    order = ["conv", "turn", "role", "digest", "own"]
    own = rows.withColumn("own", F.monotonically_increasing_id())
    ordered = materialize(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    seen = ordered.where(~F.col("blank")).groupBy("conv", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = materialize(seen.select(F.col("conv").alias("conv_"), F.col("digest").alias("digest_"), "first"), "seen-again")
    thin = ordered.select("conv", "at", "turn", "initial", "blank", "cut", "digest")
    on = thin["conv"].eqNullSafe(seen["conv_"]) & (thin["digest"] == seen["digest_"]) & ~thin["blank"]
    marked = thin.join(broadcast_if_small(seen, seen.count()), on, "left").withColumn("again", F.coalesce(F.col("at") > F.col("first"), F.lit(False)))
    group = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol: Column = F.when(F.col("blank") | F.col("again"), GONE).otherwise(F.when(F.col("cut"), F.upper(group)).otherwise(group))
    marked = marked.select("conv", "at", "turn", "initial", symbol.alias("symbol"), "blank", (~F.col("blank") & F.col("again")).alias("duplicate"), F.shiftright("at", piece_bits).alias("piece"))
    whole = F.sort_array(F.collect_list(F.struct("at", "symbol", "initial")))
    counts = [F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate")]
    pieces = marked.groupBy("conv", "piece").agg(whole.alias("rows"), *counts)
    symbols = F.array_join(F.transform("rows", lambda r: r["symbol"]), "")
    pieces = materialize(pieces.select("conv", "piece", F.transform("rows", lambda r: r["at"]).alias("ats"), symbols.alias("symbols"), F.transform("rows", lambda r: r["initial"]).alias("initials"), "blank", "duplicate"), "pieces")
    turns = ordered.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("different"))

    after = pieces.select("conv", "piece", "symbols").mapInArrow(_matrices, f"conv {kind}, piece long, matrix array<long>")
    after = materialize(_joined(pieces, _in_order(after, "piece", _backwards, f"conv {kind}, piece long, after array<long>, cost long")), "costs-to-go")
    ends = after.select("conv", "piece", "symbols", "initials", "after").mapInArrow(_ends, f"conv {kind}, piece long, ends array<long>, first string, last string, illegal long")
    starts = _in_order(ends, "piece", _forwards, f"conv {kind}, piece long, start long, final boolean, illegal long")
    known = materialize(_joined(after, starts), "states")
    edited = known.select("conv", "piece", "ats", "symbols", "after", "start", "final").mapInArrow(_edited, f"conv {kind}, piece long, audit string, edits array<struct<at:long,letters:string,start:long>>")
    edited = materialize(edited, "edits")
    audit = edited.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("piece", "audit"))).alias("parts"))
    audit = audit.select("conv", F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"))
    cut = F.sum(F.length(F.regexp_replace("symbols", "[^SUAO]", ""))).cast("long")
    sums = known.groupBy("conv").agg(F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), cut.alias("truncated"), F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"))
    wide = F.col("high").cast("decimal(20,0)") - F.col("low") + 1 - F.col("different")
    gaps = turns.select("conv", F.coalesce(F.least(wide, F.lit(_LONG)).cast("long"), F.lit(0)).alias("gaps"))
    report = _joined(_joined(gaps, sums), audit)
    edits = edited.select(F.explode("edits").alias("e")).select("e.*").where(F.col("letters") != "D")
    lines = edits.join(ordered.select("conv", "at", "role", "text"), "at").select("conv", "at", "letters", "start", "role", "text")
    lines = lines.mapInArrow(_lines, f"conv {kind}, at long, part long, role string, text string")
    return report, lines.select("conv", F.struct("at", "part").alias("at"), "role", "text").withColumn("at", F.col("at.at") * 64 + F.col("at.part"))


def _matrices(batches):
    for batch in batches:
        out = []
        for symbols in batch.column("symbols").to_pylist():
            m = None
            for symbol, length in runs(symbols):
                for bit in range(length.bit_length()):
                    if length >> bit & 1:
                        m = power(symbol, bit) if m is None else product(m, power(symbol, bit))
            out.append([c for row in m for c in row])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["conv", "piece", "matrix"])


def _of_conversations(batches, names: list[str], out: list[tuple], each: Callable):
    """A batch for each conversation: the columns ``out`` (name, type) that ``each`` makes of the columns ``names``."""
    for _, slices in _groups(batches):
        columns = each(*_lists(slices, *names))
        ids = pa.concat_arrays([s.column(0) for s in slices])
        pieces = pa.concat_arrays([s.column(1) for s in slices])
        yield pa.RecordBatch.from_arrays([ids, pieces, *(pa.array(c, t) for c, (_, t) in zip(columns, out, strict=True))], ["conv", "piece", *(n for n, _ in out)])


def _backwards(batches):
    def each(matrices):
        after, low, costs, out = END, 0, [], []
        for flat in reversed(matrices):
            out.append(list(after))
            after = tuple(min(flat[4 * p + q] + after[q] for q in range(4)) for p in range(4))
            costs.append(after[START] + low)
            low += min(after)
            after = tuple(c - min(after) for c in after)
        return out[::-1], [costs[-1] if k == 0 else None for k in range(len(out))]

    return _of_conversations(batches, ["matrix"], [("after", pa.list_(pa.int64())), ("cost", pa.int64())], each)


def _ends(batches):
    for batch in batches:
        ends, first, last, illegal = [], [], [], []
        for symbols, initials, after in zip(*(batch.column(c).to_pylist() for c in ("symbols", "initials", "after")), strict=True):
            ends.append([walk(runs(symbols), tuple(after), state)[1] for state in range(4)])
            first.append(initials[0])
            last.append(initials[-1])
            illegal.append(_illegal(initials))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends, pa.list_(pa.int64())), pa.array(first), pa.array(last), pa.array(illegal, pa.int64())], ["conv", "piece", "ends", "first", "last", "illegal"])


def _forwards(batches):
    def each(ends, first, last, illegal):
        state, starts = START, []
        for e in ends:
            starts.append(state)
            state = e[state]
        joints = [0, *(x + y not in _LEGAL for x, y in zip(last, first[1:], strict=False))]
        return starts, [k == len(ends) - 1 for k in range(len(ends))], [i + j for i, j in zip(illegal, joints, strict=True)]

    return _of_conversations(batches, ["ends", "first", "last", "illegal"], [("start", pa.int64()), ("final", pa.bool_()), ("illegal", pa.int64())], each)


def _edited(batches):
    kind = pa.list_(pa.struct([("at", pa.int64()), ("letters", pa.string()), ("start", pa.int64())]))
    for batch in batches:
        audits, edits = [], []
        for ats, symbols, after, state, final in zip(*(batch.column(c).to_pylist() for c in ("ats", "symbols", "after", "start", "final")), strict=True):
            letters, end = walk(runs(symbols), tuple(after), state)
            if final:
                letters[-1] += ending(end)
            own = []
            for at, word, symbol in zip(ats, letters, symbols, strict=True):
                own.append({"at": at, "letters": word, "start": state})
                for letter in word:
                    state = state if letter == "D" else kept(symbol, state) if letter == "K" else added(state)
            audits.append("".join(letters))
            edits.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(audits), pa.array(edits, kind)], ["conv", "piece", "audit", "edits"])


def _lines(batches):
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            at, part, roles, texts = [], [], [], []
            for k, (letters, state, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("letters", "start", "role", "text")), strict=True)):
                for p, (r, t) in enumerate(messages([letters], [role], [text], state)[0]):
                    at.append(k)
                    part.append(p)
                    roles.append(r)
                    texts.append(t)
            own = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv").take(own), batch.column("at").take(own), pa.array(part, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], ["conv", "at", "part", "role", "text"])


def _hashed(batches):
    """One hash for each conversation, over its lines as they come."""
    conv, last, h = None, None, None
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True)
            for k, (key, role, text) in enumerate(rows):
                if h is not None and key != conv:
                    yield pa.RecordBatch.from_arrays([last, pa.array([h.hexdigest()])], ["conv", "repaired_sha256"])
                    h = None
                if h is None:
                    conv, last, h = key, batch.column("conv").slice(k, 1), hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
    if h is not None:
        yield pa.RecordBatch.from_arrays([last, pa.array([h.hexdigest()])], ["conv", "repaired_sha256"])


def digest(repaired: Repaired, every: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The report and hash of every conversation of ``every``, also of those without rows."""
    ids = every.select(column(id_col).alias("conv")).distinct()
    rows = _joined(ids, repaired.digests())
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("conv").alias(id_col), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
