"""Conversation structure repair by least edits (operator 12).

A conversation's turns are edited so that the roles follow the grammar
``(s?(ua)+)?`` at least cost. A recursive DuckDB query inside each
hash-partitioned batch advances one turn a recursion, for all conversations of
the batch at once, and keeps for each grammar state the least (cost, audit).

A conversation of any length is cut into segments of ``SEGMENT`` turns, so that
no batch holds one whole: a segment is solved from each of the four states. The
segments of a longer conversation are then composed, ``SEGMENT`` at a time, by
the same recursive query with segments in the place of turns, until one is
left; the choices go down again to the turns. Audits of one start state that
end in different states differ, and neither begins with the other (both edit
the same turns, and inserts stand before a turn), so at a higher level the rank
of a segment's audit among those of its start state stands for the audit.

Rows are range-sorted by conversation and turn, so no task holds one
conversation's rows; whether a text was seen before is found by the least row
number of a text, joined by row number, so repeated texts make no hot key. Only
the repaired conversation's sha256, a digest in order, and its audit are made
by one task for a conversation, as a stream.

Edits, by initial: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an
empty user or assistant turn 5; a truncated turn that isn't deleted adds 5;
blank and duplicate turns must go.

Defined cases: a null text or role is one space; null turns come first and
leave no gaps; a null conv_id is a conversation of its own; turns of the same
number are ordered by role, then by hashes of the text; a repeated row is
another turn, and a duplicate of the first; texts of any length are read whole;
an empty table gives an empty result. Only the named columns are read, so extra
columns can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, small_batches

SEGMENT = 64
#: Turns (or segments) that one DuckDB query takes at least, where there are so many.
BATCH = 8192
BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ["", "blank", "duplicate", "truncated"]
INITIALS = "sua"
#: States: nothing yet, after system, after user, after assistant; what may be inserted or reroled to in each, and where it leads.
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ROLES = {"u": "user", "a": "assistant"}


def transitions() -> list[tuple[str, int, int, int, int, str]]:
    """(initial, fault, from, to, cost, token) for one turn; a token lists edits and the roles they make, two characters each."""
    best: dict[tuple, tuple] = {}
    for initial in (*INITIALS, "o"):
        for fault in range(len(FAULTS)):
            for start in NEXT:
                state, cost, token = start, 0, ""
                for _ in range(3):  # nothing, one or two inserts: more return to a state
                    made = [(state, 2, "D-")]
                    if FAULTS[fault] not in ("blank", "duplicate"):
                        more = 5 * (FAULTS[fault] == "truncated")
                        if (state, initial) in KEEP:
                            made.append((KEEP[state, initial], more, "K" + initial))
                        role, to = NEXT[state]
                        made.append((to, 1 + more, "R" + role))
                    for to, price, edit in made:
                        key, new = (initial, fault, start, to), (cost + price, token + edit)
                        best[key] = min(best.get(key, new), new)
                    role, to = NEXT[state]
                    state, cost, token = to, cost + 5, token + "I" + role
    return [(*k, *v) for k, v in sorted(best.items())]


#: Inserts after the last turn that end in a whole conversation, by state.
ENDINGS = {0: (0, ""), 1: (10, "IuIa"), 2: (5, "Ia"), 3: (0, "")}

_ADVANCE = """
WITH RECURSIVE w(node, i, s, t, best) AS (
  SELECT node, 0, s, s, {'cost': 0::BIGINT, 'path': ''} FROM (SELECT DISTINCT node FROM edges), range(4) r(s)
  UNION ALL
  SELECT w.node, w.i + 1, w.s, e.t, min({'cost': w.best.cost + e.cost, 'path': w.best.path || e.token})
  FROM w JOIN edges e ON e.node = w.node AND e.i = w.i + 1 AND e.s = w.t GROUP BY w.node, w.i + 1, w.s, e.t),
last AS (SELECT node, max(i) AS i FROM edges GROUP BY node)
SELECT node, s::INT AS s, t::INT AS t, best.cost AS cost, best.path AS path, chr((64 + row_number() OVER (PARTITION BY node, s ORDER BY best.path))::INT) AS letter
FROM w JOIN last USING (node, i) ORDER BY node, s, t"""

_ENTRY = "array<struct<s:int,t:int,cost:long,path:string,letter:string>>"
_ENTRY_TYPE = pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("path", pa.string()), ("letter", pa.string())]))


def _connection():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    con.execute("CREATE TABLE transitions(initial VARCHAR, fault INT, s INT, t INT, cost INT, token VARCHAR)")
    con.executemany("INSERT INTO transitions VALUES (?, ?, ?, ?, ?, ?)", transitions())
    return con


def _solve(con, edges: str, **tables: pa.Table) -> pa.Table:
    for name, t in tables.items():
        con.register(name, t)
    con.execute(f"CREATE OR REPLACE TEMP TABLE edges AS {edges}")
    out = con.sql(_ADVANCE).to_arrow_table()
    for name in tables:
        con.unregister(name)
    return out


def _entries(solved: pa.Table, nodes: int) -> pa.Array:
    """The entries of each node, as lists."""
    solved = solved.combine_chunks()
    off = np.searchsorted(solved["node"].to_numpy(), np.arange(nodes + 1)).astype(np.int32)
    fields = [solved[c].combine_chunks().cast(t) for c, t in zip(("s", "t", "cost", "path", "letter"), (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()))]
    fields = [f.combine_chunks() if isinstance(f, pa.ChunkedArray) else f for f in fields]
    return pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays(fields, names=["s", "t", "cost", "path", "letter"])).cast(_ENTRY_TYPE)


def _whole_nodes(batches, key: list[str], least: int = BATCH):
    """Tables of at least ``least`` rows that end where the key changes, with the node's number of each row."""
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(t: pa.Table, last: bool):
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in key:
            code = t[c].combine_chunks().dictionary_encode(null_encoding="encode")
            code = code.indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        node = np.cumsum(new) - 1
        end = t.num_rows if last else int(np.flatnonzero(new)[-1])
        return t.slice(0, end), node[:end], t.slice(end)

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= least:
            whole, node, rest = cut(pa.Table.from_batches(held), False)
            if whole.num_rows:
                yield whole, node
            held = rest.combine_chunks().to_batches() if rest.num_rows else []
            n = rest.num_rows
    if n:
        yield cut(pa.Table.from_batches(held), True)[:2]


def damaged(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows with their planted faults: (_conv, _turn, _role, _text, and what orders rows of one turn)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_id).alias("_conv"), F.col(turn).alias("_turn"), blank(role).alias("_first_role"), blank(text).alias("_first"),
                        (F.crc32(F.concat(blank(conv_id), F.lit(":"), blank(turn)).cast("binary")) % 20).cast("int").alias("_d"))
    rows = rows.where("_d <> 0").withColumn("_copy", F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    body = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("_first", "[.!?]", "")).otherwise(F.col("_first"))
    order = [F.xxhash64("_first").alias("_o1"), F.xxhash64(F.lit("turn"), F.col("_first")).alias("_o2"), "_copy"]
    return rows.select("_conv", "_turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("_first_role")).alias("_role"), body.alias("_text"), "_first_role", *order)


def plain(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows as they are, in the form of :func:`damaged`."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col(conv_id).alias("_conv"), F.col(turn).alias("_turn"), blank(role).alias("_role"), blank(text).alias("_text"), blank(role).alias("_first_role"),
                        F.xxhash64(blank(text)).alias("_o1"), F.xxhash64(F.lit("turn"), blank(text)).alias("_o2"), F.lit(0).alias("_copy"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` range-sorted by conversation and turn, with a row number ``_rid`` that rises in that order; a written table."""
    order = [F.col(c).asc_nulls_first() for c in ("_conv", "_turn", "_first_role", "_o1", "_o2", "_copy")]
    n = partitions(rows.sparkSession)
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_rid", F.monotonically_increasing_id())
    bare = F.rtrim("_text", F.lit(BLANKS))
    last = F.substring(bare, -1, 1)
    initial = F.substring("_role", 1, 1)
    return materialize(rows.select("_rid", "_conv", "_turn", "_role", "_text", F.when(initial.isin(*INITIALS), initial).otherwise("o").alias("_initial"), (bare == "").alias("_blank"), (~last.isin(".", "!", "?")).alias("_cut"),
                                   F.xxhash64("_text").alias("_h1"), F.xxhash64(F.lit("text"), F.col("_text")).alias("_h2")), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """(_rid, _conv, _initial, _fault) of each turn: the first of its faults, by place in ``FAULTS``."""
    narrow = turns.select("_rid", "_conv", "_role", "_initial", "_blank", "_cut", "_h1", "_h2")
    firsts = narrow.groupBy("_conv", "_role", "_h1", "_h2").agg(F.min("_rid").alias("_rid")).select("_rid", F.lit(True).alias("_seen"))
    found = F.when(F.col("_blank"), 1).when(F.col("_seen").isNull(), 2).when(F.col("_cut"), 3).otherwise(0)
    return narrow.join(firsts, "_rid", "left").select("_rid", "_conv", "_initial", found.cast("int").alias("_fault"))


def segments(marked: DataFrame) -> DataFrame:
    """Solved runs of up to ``SEGMENT`` successive turns of a conversation: (_conv, _seg, _rids, _entries and counts); a written table."""
    run = F.shiftright("_rid", 33)  # the range partition
    nth = F.row_number().over(Window.partitionBy("_conv", run).orderBy("_rid"))
    rows = marked.withColumn("_i", ((nth - 1) % SEGMENT + 1).cast("int")).withColumn("_seg", F.col("_rid") - F.col("_i"))  # rows of a run are numbered one after another
    rows = rows.repartition("_conv", "_seg").sortWithinPartitions("_conv", "_seg", "_i").select("_conv", "_seg", "_i", "_rid", "_initial", "_fault")

    def solve(batches):
        con = _connection()
        for t, node in _whole_nodes(batches, ["_conv", "_seg"]):
            nodes, initial, fault = int(node[-1]) + 1, t["_initial"].combine_chunks(), t["_fault"].to_numpy()
            turns = pa.table({"node": pa.array(node), "i": t["_i"], "initial": initial, "fault": t["_fault"]})
            solved = _solve(con, "SELECT node, i, s, t, cost, token FROM turns JOIN transitions USING (initial, fault)", turns=turns)
            first = np.flatnonzero(np.concatenate([[True], np.diff(node) > 0]))
            last = np.append(first[1:], len(node)) - 1
            count = lambda mask: pa.array(np.bincount(node[mask], minlength=nodes).astype(np.int64))
            letters = np.array(initial.to_pylist())
            pair = np.char.add(letters[:-1], letters[1:]) if len(letters) > 1 else np.zeros(0, "U2")
            odd = np.concatenate([[False], (np.diff(node) == 0) & ~np.isin(pair, ["su", "ua", "au"])])
            off = np.append(first, len(node)).astype(np.int32)
            rids = pa.ListArray.from_arrays(pa.array(off), t["_rid"].combine_chunks())
            yield pa.RecordBatch.from_arrays([t["_conv"].combine_chunks().take(pa.array(first)), t["_seg"].combine_chunks().take(pa.array(first)), rids, _entries(solved, nodes), *[count(fault == k) for k in (1, 2, 3)], count(odd), pa.array(letters[first]), pa.array(letters[last])],
                                             names=["_conv", "_seg", "_rids", "_entries", "blank", "duplicate", "truncated", "illegal", "_from", "_to"])

    kind = dict(marked.dtypes)["_conv"]
    return materialize(rows.mapInArrow(solve, f"_conv {kind}, _seg long, _rids array<long>, _entries {_ENTRY}, blank long, duplicate long, truncated long, illegal long, _from string, _to string"), "segments")


def compose(children: DataFrame) -> DataFrame:
    """One node for each ``SEGMENT`` successive ``children(_conv, _seg, _entries)``: (_conv, _seg, _kids, _entries); a written table."""
    nth = F.row_number().over(Window.partitionBy("_conv").orderBy("_seg"))
    rows = children.withColumn("_i", ((nth - 1) % SEGMENT + 1).cast("int")).withColumn("_node", F.floor((nth - 1) / SEGMENT).cast("long"))
    rows = rows.select("_conv", "_node", "_i", "_seg", F.transform("_entries", lambda e: F.struct(e["s"].alias("s"), e["t"].alias("t"), e["cost"].alias("cost"), F.concat(e["letter"], e["t"].cast("string")).alias("token"))).alias("e"))
    rows = rows.repartition("_conv", "_node").sortWithinPartitions("_conv", "_node", "_i")

    def solve(batches):
        con = _connection()
        for t, node in _whole_nodes(batches, ["_conv", "_node"], BATCH // 16):
            nodes = int(node[-1]) + 1
            first = np.flatnonzero(np.concatenate([[True], np.diff(node) > 0]))
            kids = pa.table({"node": pa.array(node), "i": t["_i"], "e": t["e"]})
            solved = _solve(con, "SELECT node, i, e.s AS s, e.t AS t, e.cost AS cost, e.token AS token FROM (SELECT node, i, unnest(e) AS e FROM kids)", kids=kids)
            off = np.append(first, len(node)).astype(np.int32)
            segs = t["_seg"].combine_chunks()
            yield pa.RecordBatch.from_arrays([t["_conv"].combine_chunks().take(pa.array(first)), segs.take(pa.array(first)), pa.ListArray.from_arrays(pa.array(off), segs), _entries(solved, nodes)], names=["_conv", "_seg", "_kids", "_entries"])

    kind = dict(children.dtypes)["_conv"]
    return materialize(rows.mapInArrow(solve, f"_conv {kind}, _seg long, _kids array<long>, _entries {_ENTRY}"), "composed")


def _several(nodes: DataFrame) -> DataFrame:
    """Nodes of conversations that have more than one, matched by hash and by value."""
    many = nodes.groupBy("_conv").count().where("count > 1").select(F.col("_conv").alias("_c"))
    return nodes.join(many, F.col("_conv").eqNullSafe(F.col("_c")), "left_semi")


def _same(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on conversation and segment; null is a conversation like any other."""
    right = right.withColumnsRenamed({"_conv": "_conv2", "_seg": "_seg2"})
    return left.join(right, F.col("_conv").eqNullSafe(F.col("_conv2")) & (F.col("_seg") == F.col("_seg2")), how).drop("_conv2", "_seg2")


def choices(segs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The path of each segment in its conversation's cheapest repair (_conv, _seg, _path), and (_conv, cost, _tail) of each conversation."""
    levels = []
    top = segs.select("_conv", "_seg", "_entries")
    while True:
        several = materialize(_several(top), "several")
        if not several.limit(1).count():
            break
        levels.append(compose(several))
        rest = _same(top, several.select("_conv", "_seg"), "left_anti")
        top = materialize(rest.unionByName(levels[-1].select("_conv", "_seg", "_entries")), "tops")
    ends = F.create_map(*[x for k, (c, tail) in ENDINGS.items() for x in (F.lit(k), F.struct(F.lit(c).cast("long").alias("c"), F.lit(tail).alias("tail")))])
    whole = F.transform(F.filter("_entries", lambda e: e["s"] == 0), lambda e: F.struct((e["cost"] + ends[e["t"]]["c"]).alias("cost"), F.concat(e["path"], ends[e["t"]]["tail"]).alias("all"), ends[e["t"]]["tail"].alias("tail"), e["path"].alias("path"), e["t"].alias("t")))
    best = materialize(top.select("_conv", "_seg", F.array_min(whole).alias("b")).select("_conv", "_seg", "b.*"), "best")
    chosen = best.select("_conv", "_seg", F.lit(0).alias("_s"), "path")
    for level in range(len(levels) - 1, -1, -1):
        # a node's path has a letter and a state for each child
        kids = _same(chosen, levels[level].select("_conv", "_seg", "_kids")).select("_conv", "_s", "path", F.posexplode("_kids").alias("k", "_seg"))
        kids = kids.select("_conv", "_seg", F.expr("if(k = 0, _s, int(substring(path, 2 * k, 1)))").alias("_s"), F.expr("int(substring(path, 2 * k + 2, 1))").alias("_t"))
        below = levels[level - 1] if level else segs
        found = _same(kids, below.select("_conv", "_seg", "_entries")).select("_conv", "_seg", "_s", F.expr("filter(_entries, e -> e.s = _s AND e.t = _t)[0].path").alias("path"))
        chosen = materialize(_same(chosen, levels[level].select("_conv", "_seg"), "left_anti").unionByName(found), "chosen")
    for t in levels:
        discard(t)
    return chosen.select("_conv", "_seg", F.col("path").alias("_path")), best.select("_conv", "cost", F.col("tail").alias("_tail"))


def rebuilt(turns: DataFrame, segs: DataFrame, chosen: DataFrame, tails: DataFrame) -> DataFrame:
    """(_conv, audit, repaired_sha256) of each conversation, made as a stream over its turns in order."""
    kind = dict(turns.dtypes)["_conv"]
    edits = _same(segs.select("_conv", "_seg", "_rids"), chosen).select("_conv", F.explode(F.arrays_zip(F.col("_rids").alias("r"), F.regexp_extract_all("_path", F.lit("((?:I[ua])*[DKR].)"), F.lit(1)).alias("t"))).alias("x"))
    none = F.lit(None).cast("string")
    edits = edits.select("_conv", F.col("x.r").alias("_rid"), F.lit(0).alias("_kind"), F.col("x.t").alias("_edit"), none.alias("_role"), none.alias("_text"))
    tail = tails.select("_conv", F.lit(2**63 - 1).alias("_rid"), F.lit(0).alias("_kind"), F.col("_tail").alias("_edit"), none.alias("_role"), none.alias("_text"))
    texts = turns.select("_conv", "_rid", F.lit(1).alias("_kind"), none.alias("_edit"), "_role", "_text")
    rows = edits.unionByName(tail).unionByName(texts).repartition("_conv").sortWithinPartitions("_conv", "_rid", "_kind")

    def run(batches):
        now, sha, audit, lines, edit, open_ = None, None, [], 0, "", False

        def put(role: str, text: str):
            nonlocal lines
            sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            lines += 1

        def done():
            return pa.RecordBatch.from_pylist([{"_conv": now, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema=made)

        made = None
        for b in batches:
            made = pa.schema([("_conv", b.schema.field(0).type), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for conv, rid, which, found, role, text in zip(*(b.column(i).to_pylist() for i in range(6))):
                if not open_ or conv != now:
                    if open_:
                        yield done()
                    now, sha, audit, lines, open_ = conv, hashlib.sha256(), [], 0, True
                if which == 0:
                    edit = found
                    audit.append(edit[::2])
                    if edit.startswith("I"):
                        for k in range(0, len(edit), 2):
                            if edit[k] != "I":
                                break
                            put(ROLES[edit[k + 1]], "")
                elif edit[-2] == "K":
                    put(role, text)
                elif edit[-2] == "R":
                    put(ROLES[edit[-1]], text)
        if open_:
            yield done()

    return rows.mapInArrow(run, f"_conv {kind}, audit string, repaired_sha256 string")


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    With ``damage`` the rows get planted faults first, by crc32 of conversation and turn."""
    small_batches(turns.sparkSession)
    rows = numbered((damaged if damage else plain)(turns, conv_id, turn, role, text))
    segs = segments(faults(rows))
    chosen, tops = choices(segs)
    chosen = materialize(chosen, "paths")
    sums = segs.groupBy("_conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    pair = F.concat(F.lag("_to").over(Window.partitionBy("_conv").orderBy("_seg")), F.col("_from"))
    borders = _several(segs.select("_conv", "_seg", "_from", "_to")).select("_conv", pair.alias("pair")).where("pair is not null and pair not in ('su', 'ua', 'au')").groupBy("_conv").agg(F.count(F.lit(1)).alias("_more"))
    numbers = rows.groupBy("_conv").agg(F.coalesce(F.max("_turn") - F.min("_turn") + 1 - F.count_distinct("_turn"), F.lit(0)).cast("long").alias("gaps"))
    parts = [turns.select(F.col(conv_id).alias("_conv")).distinct(), sums, borders, numbers, tops.select("_conv", "cost"), rebuilt(rows, segs, chosen, tops)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    one = every.groupBy("_conv").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in (*counts, "_more")], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    return one.withColumn("illegal", F.col("illegal") + F.col("_more")).select(F.col("_conv").alias("conv_id"), *counts, "audit", "repaired_sha256")
