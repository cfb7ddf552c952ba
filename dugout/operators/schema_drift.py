"""Schemas that drift between files: read everything into one table and report each change.

Every file's schema is a tree of fields. Two consecutive schemas of one stream are compared by a tree edit distance.
A field that keeps its name under a parent that stays is the same field; of all scripts of ``add``, ``delete``,
``rename`` and ``move`` (of whole subtrees) for the rest the one of least total cost is taken, by an optimal assignment of the
fields that went to the fields that came. The order of fields does not count.

What a rename costs is learned from the files themselves, there is no list of known names. Two names are likely one
fact if their values are distributed alike, if they never stand in one file together, if the one comes where and whenever
the other goes, and if one is spelled like or shortened from the other (see ``rename_odds``). The statistics are counts over all files, kept for
each pair of names of which one went while the other came; they grow with the vocabulary of columns, not with the files.

The scripts are composed along each stream: a column is followed back, rename by rename and file by file, to the first
file that has it (pointer doubling), and compiled into projections that bring every file to one set of columns. Streams
whose columns start under different names of one fact are brought together by the renames seen in other streams.

The lines are split, classified and counted inside the JVM by (file, position), with map-side
combination, so no file and no stream is ever gathered into one task; only schemas (tens of
fields a file) reach Python.

Defined results: a file without header line has no schema and is passed over; columns compare in
lower case without surrounding blanks; a column all of whose values are null markers has no type
and is never ``retyped``; repeated lines count once for nothing but the profile; an empty table
gives an empty result; of two columns with one name in a file the first counts for the changes, and in the
unified table the second gets a number behind its name; a line with an odd number of quotes is split at every comma.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.operators.pointers import roots
from dugout.session import cut, spread

#: Spellings of null in the files.
NULL_MARKERS = ["", "na", "n/a", "nan", "null", "-", "--"]

#: File ids of a stretch (see ``previous_files``).
BUCKET = 4096

_INT = r"^[+-]?[0-9]+$"
_PCT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)%$"
_DEC = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

#: What a move of a subtree costs; adding or deleting a field costs 1.
MOVE = 0.5


@dataclass
class Profile:
    """Values of a field: how many, the share of numbers, their mean and deviation, the mean length in characters."""

    n: float = 0.0
    numbers: float = 0.0
    mean: float = 0.0
    spread: float = 0.0
    length: float = 0.0


@dataclass
class Node:
    """A field of a schema tree: type is '' if unknown, ``children`` are the fields of a struct."""

    name: str
    type: str = ""
    profile: Profile | None = None
    children: list["Node"] = field(default_factory=list)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


@dataclass
class Evidence:
    """What all files say about two names: share of the rarer one's files in which both stand, log of how much more often
    than by chance the one comes when the other goes, and the profiles of all their values."""

    together: float
    lift: float
    old: Profile
    new: Profile


def _parts(name: str) -> list[str]:
    for sign, word in (("%", "_pct"), ("+", "_plus"), ("/", "_per_"), ("-", "_"), (" ", "_")):
        name = name.replace(sign, word)
    return [p for p in name.split("_") if p] or [name]


def likeness(a: str, b: str) -> float:
    """How alike two names are spelled, 0 to 1: shared bigrams, a shared word, initials, or one shortened from the other."""
    x, y = _parts(a), _parts(b)
    s, t = "".join(x), "".join(y)
    if s == t:
        return 1.0
    if len(s) > len(t):
        x, y, s, t = y, x, t, s
    grams = lambda v: {v[i:i + 2] for i in range(len(v) - 1)} or {v}
    p, q = grams(s), grams(t)
    best = 2 * len(p & q) / (len(p) + len(q))
    if len(y) > 1 and s == "".join(w[0] for w in y):
        best = max(best, 0.9)
    if set(x) & set(y) or (len(s) > 1 and s in t):
        best = max(best, 0.7)
    rest = iter(t)
    if s[0] == t[0] and all(c in rest for c in s):
        best = max(best, 0.5 + 0.3 * len(s) / len(t))
    return best


def overlap(a: Profile | None, b: Profile | None) -> tuple[float, float]:
    """(how much two profiles overlap, 0 to 1; how far that can be trusted, 0 to 1). Numbers count as normally distributed
    (Bhattacharyya coefficient), other values by their length."""
    if a is None or b is None or not a.n or not b.n:
        return 0.5, 0.0
    least = lambda p: max(p.spread, abs(p.mean) / 1000, 1e-6)
    s, t = least(a), least(b)
    numbers = math.sqrt(2 * s * t / (s * s + t * t)) * math.exp(-((a.mean - b.mean) ** 2) / (4 * (s * s + t * t)))
    n = min(a.n, b.n)
    return min(a.numbers, b.numbers) * numbers + min(1 - a.numbers, 1 - b.numbers) * math.exp(-abs(a.length - b.length) / 3), n / (n + 3)


def rename_odds(old: Node, new: Node, near: int | None = None, seen: Evidence | None = None) -> float:
    """Log odds that two fields are one fact. ``near``: how many of the fields that stand before and behind are the same (None: not known)."""
    alike, trust = overlap(seen.old, seen.new) if seen else overlap(old.profile, new.profile)
    s = -2.0 + 3.0 * likeness(old.name, new.name) + 2.0 * (2.0 * alike - 1.0) * trust
    if near is not None:
        s += (-0.5, 0.5, 1.5)[near]
    if seen is not None:
        s += seen.lift + (0.5 if not seen.together else -6.0 * min(1.0, 20.0 * seen.together))
    return s


def rename_cost(old: Node, new: Node, near: int | None = None, seen: Evidence | None = None) -> float:
    """Cost of a rename, 0 to 2; 2 is as dear as delete and add, and is reached where a rename is less likely than not."""
    if bool(old.children) != bool(new.children):
        return 2.0
    return min(2.0, 4.0 / (1.0 + math.exp(max(-50.0, min(50.0, rename_odds(old, new, near, seen))))))


def _assign(cost: list[list[float]]) -> list[int]:
    """Least-cost assignment of rows to columns (square matrix, shortest augmenting paths)."""
    n = len(cost)
    u, v, p, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = [math.inf] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], math.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0], j0 = p[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[p[j] - 1] = j - 1
    return out


def _first(nodes: list[Node]) -> dict[str, Node]:
    return {n.name: n for n in reversed(nodes)}


def _neighbours(nodes: list[Node], kept: set[str]) -> dict[str, tuple[str, str]]:
    """(kept name before, kept name behind) of each field."""
    before, out, behind = "", {}, ""
    for n in nodes:
        out[n.name] = before
        before = n.name if n.name in kept else before
    both = {}
    for n in reversed(nodes):
        both[n.name] = (out[n.name], behind)
        behind = n.name if n.name in kept else behind
    return both


Change = tuple[str, str, str]


def least_script(old: list[Node], new: list[Node], corpus: dict[tuple[str, str], Evidence] | None = None,
                 old_path: str = "", new_path: str = "") -> tuple[float, list[Change]]:
    """(cost, script) of turning one list of fields into the other; the script has (change, old path, new path)."""
    script: list[Change] = []
    gone: list[tuple[str, Node, tuple[str, str]]] = []
    come: list[tuple[str, Node, tuple[str, str]]] = []

    def retyped(o: Node, n: Node, a: str, b: str) -> None:
        if o.type and n.type and o.type != n.type:
            script.append(("retyped", a, b))

    def walk(a: list[Node], b: list[Node], path: str) -> None:
        x, y = _first(a), _first(b)
        kept = x.keys() & y.keys()
        at, to = _neighbours(list(x.values())[::-1], kept), _neighbours(list(y.values())[::-1], kept)
        for name, o in x.items():
            if name in kept:
                retyped(o, y[name], old_path + path + name, new_path + path + name)
                walk(o.children, y[name].children, f"{path}{name}.")
            else:
                gone.append((path, o, at[name]))
        come.extend((path, n, to[name]) for name, n in y.items() if name not in kept)

    walk(old, new, "")
    gone.sort(key=lambda g: (g[0], g[1].name))
    come.sort(key=lambda g: (g[0], g[1].name))
    total = 0.0
    inner: dict[tuple[int, int], list[Change]] = {}
    n = len(gone) + len(come)
    cost = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i < len(gone) and j < len(come):
                (p, o, x), (q, m, y) = gone[i], come[j]
                below, inner[i, j] = least_script(o.children, m.children, corpus, f"{old_path}{p}{o.name}.", f"{new_path}{q}{m.name}.")
                near = (x[0] == y[0]) + (x[1] == y[1]) if p == q else None
                name = 0.0 if o.name == m.name else rename_cost(o, m, near, (corpus or {}).get((p + o.name, q + m.name)))
                cost[i][j] = name + (0.0 if p == q else MOVE) + below
            elif i < len(gone):
                cost[i][j] = float(gone[i][1].size())
            elif j < len(come):
                cost[i][j] = float(come[j][1].size())
    matched = set()
    for i, j in enumerate(_assign(cost) if n else []):
        if i >= len(gone):
            continue
        p, o, _ = gone[i]
        if j < len(come) and cost[i][j] < o.size() + come[j][1].size():
            q, m, _ = come[j]
            a, b = f"{old_path}{p}{o.name}", f"{new_path}{q}{m.name}"
            script += [("renamed", a, b)] * (o.name != m.name) + [("moved", a, b)] * (p != q)
            retyped(o, m, a, b)
            script += inner[i, j]
            matched.add(j)
            total += cost[i][j]
        else:
            script.append(("removed", f"{old_path}{p}{o.name}", ""))
            total += o.size()
    for j, (q, m, _) in enumerate(come):
        if j not in matched:
            script.append(("added", "", f"{new_path}{q}{m.name}"))
            total += m.size()
    return total, script


def edit_script(old: list[Node], new: list[Node], corpus: dict[tuple[str, str], Evidence] | None = None) -> list[Change]:
    """(change, old path, new path) of a least-cost script; change is added, removed, renamed, retyped or moved."""
    return least_script(old, new, corpus)[1]


def split_line(c: Column) -> Column:
    """Fields of a CSV line, quotes taken off; a quoted field may hold commas and doubled quotes. What stands between an odd
    and an even quote is quoted, and an empty stretch between two quoted ones is a doubled quote."""
    bar = "\x01"
    parts = F.split(c, '"', -1)
    last = F.size(parts) - 1
    read = F.transform(parts, lambda x, i: F.when(i % 2 == 1, x).when((x == "") & (i > 0) & (i < last), F.lit('"')).otherwise(F.replace(x, F.lit(","), F.lit(bar))))
    quoted = F.split(F.array_join(read, ""), bar, -1)
    return F.when(F.contains(c, F.lit('"')) & (last % 2 == 0), F.transform(quoted, lambda x: F.trim(x))).otherwise(F.split(c, ",", -1))


def headers(lines: DataFrame) -> DataFrame:
    """(file_id, feed, kind, season, names) from the header lines."""
    tidy = lambda x: F.lower(F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    return (
        lines.where((F.col("line_no") == 0) & F.col("line").isNotNull())
        .groupBy("file_id")
        .agg(F.min_by(F.struct("feed", "kind", "season", "line"), "line_no").alias("f"))
        .select("file_id", "f.feed", "f.kind", "f.season", F.transform(split_line(F.col("f.line")), tidy).alias("names"))
    )


def name_differences(lines: DataFrame) -> DataFrame:
    """(file_id, column_name, side): the names that a file has (``came``) or lacks (``went``) against the one before it, whatever they stand for."""
    h = cut(headers(lines))
    before = h.select(F.col("file_id").alias("prev_file_id"), F.col("names").alias("old"))
    both = h.join(previous_files(h), "file_id").join(before, "prev_file_id")
    side = lambda x, y, name: both.select("file_id", F.explode(F.array_except(x, y)).alias("column_name"), F.lit(name).alias("side"))
    return side("names", "old", "came").unionByName(side("old", "names", "went"))


def file_schemas(lines: DataFrame) -> DataFrame:
    """One row a file: its place in the stream and its fields with type and profile of values, from raw CSV lines
    (file_id, line_no, line, feed, kind, season). Types are integer, decimal and text; ``reads`` is the column kind that
    reads every value (see ``lenient``): long, double (per cent included) or string, empty if there is no value."""
    head = headers(lines).select("file_id", "feed", "kind", "season", F.posexplode("names").alias("pos", "name"))
    v = F.trim("v")
    is_int, is_dec, is_pct = v.rlike(_INT), v.rlike(_DEC), v.rlike(_PCT)
    share = F.replace(v, F.lit("%"), F.lit("")).try_cast("double") / 100
    stats = (
        spread(lines.select("file_id", "line_no", "line").where((F.col("line_no") > 0) & F.col("line").isNotNull()))
        .select("file_id", F.posexplode(split_line(F.col("line"))).alias("pos", "v"))
        .where(~F.lower(v).isin(NULL_MARKERS))
        .select("file_id", "pos", v.alias("v"), is_int.alias("i"), is_dec.alias("d"), is_pct.alias("p"))
        .withColumn("x", F.when(F.col("i") | F.col("d"), F.col("v").try_cast("double")).when(F.col("p"), share))
        .groupBy("file_id", "pos")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("i").alias("n_int"),
            F.count_if("d").alias("n_dec"),
            F.count_if("p").alias("n_pct"),
            F.count_if(F.col("i") & F.col("v").try_cast("bigint").isNull()).alias("n_wide"),
            F.count("x").alias("n_num"),
            F.avg("x").alias("mean"),
            F.stddev_pop("x").alias("spread"),
            F.avg(F.length("v")).alias("length"),
        )
    )
    n = F.col("n")
    kind = (
        F.when(n.isNull(), F.lit(""))
        .when(F.col("n_int") == n, F.lit("integer"))
        .when(F.col("n_int") + F.col("n_dec") == n, F.lit("decimal"))
        .otherwise(F.lit("text"))
    )
    reads = (
        F.when(n.isNull(), F.lit(""))
        .when((F.col("n_int") == n) & (F.col("n_wide") == 0), F.lit("long"))
        .when((F.col("n_int") + F.col("n_dec") + F.col("n_pct") == n) & (F.col("n_wide") == 0), F.lit("double"))
        .otherwise(F.lit("string"))
    )
    return (
        head.join(stats, ["file_id", "pos"], "left")
        .select("file_id", "feed", "kind", "season", "pos", "name", kind.alias("type"), F.coalesce("n", F.lit(0)).alias("n"),
                F.coalesce("n_num", F.lit(0)).alias("n_num"), "mean", "spread", "length", reads.alias("reads"))
        .groupBy("file_id", "feed", "kind", "season")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "name", "type", "n", "n_num", "mean", "spread", "length", "reads"))).alias("fields"))
    )


def _number(x) -> float:
    return 0.0 if x is None or x != x else float(x)


def _profile(n, n_num, mean, spread, length) -> Profile:
    return Profile(_number(n), _number(n_num) / max(_number(n), 1.0), _number(mean), _number(spread), _number(length))


def _nodes(fields: Iterable) -> list[Node]:
    """Fields named with dots become nested nodes."""
    top: list[Node] = []
    seen: dict[str, Node] = {}
    for f in fields:
        at, parts = top, str(f["name"]).split(".") if "." in str(f["name"]).strip(".") else [str(f["name"])]
        for k, part in enumerate(parts):
            key = ".".join(parts[: k + 1])
            if key not in seen:
                seen[key] = Node(part)
                at.append(seen[key])
            elif k == len(parts) - 1:
                break
            at = seen[key].children
        else:
            node = seen[".".join(parts)]
            node.type, node.profile = f["type"] or "", _profile(f["n"], f["n_num"], f["mean"], f["spread"], f["length"])
    return top


def previous_files(schemas: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(file_id, prev_file_id) in the order (season, file_id) of each feed and kind.

    A window sees the files of one feed, kind, season and stretch of ``bucket`` ids; the last file of the stretch before
    comes from the stretches' own sequence, so no task holds a whole feed however large it is."""
    f = schemas.select("file_id", "feed", "kind", "season", F.floor(F.col("file_id") / bucket).alias("stretch"))
    keys = ["feed", "kind", "season", "stretch"]
    within = f.withColumn("inner", F.lag("file_id").over(Window.partitionBy(*keys).orderBy("file_id")))
    last = f.groupBy(*keys).agg(F.max("file_id").alias("last")).withColumn(
        "border", F.lag("last").over(Window.partitionBy("feed", "kind").orderBy("season", "stretch"))).select(
        *[F.col(k).alias(f"_{k}") for k in keys], "border")
    on = [within[k].eqNullSafe(last[f"_{k}"]) for k in keys]
    first = within.where("inner is null").join(last, on).select("file_id", F.col("border").alias("prev_file_id"))
    return within.where("inner is not null").select("file_id", F.col("inner").alias("prev_file_id")).unionByName(first).where("prev_file_id is not null")


def _evidence(schemas: DataFrame, pairs: DataFrame) -> DataFrame:
    """(file_id, known): for each pair of files the evidence on every name that went against every name that came."""
    cand = pairs.where("size(gone) > 0 and size(come) > 0").select("file_id", F.explode("gone").alias("a"), "come").select(
        "file_id", "a", F.explode("come").alias("b"))
    total = pairs.where("size(gone) > 0 or size(come) > 0").count()
    went = pairs.select(F.explode("gone").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n_gone"))
    came = pairs.select(F.explode("come").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n_come"))
    both = cand.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    f = F.col("f")
    of_name = schemas.select(F.explode("fields").alias("f")).select("f.*").groupBy("name").agg(
        F.count(F.lit(1)).alias("files"), F.sum("n").alias("n"), F.sum("n_num").alias("n_num"),
        F.try_divide(F.sum(F.col("mean") * F.col("n_num")), F.sum("n_num")).alias("mean"),
        F.try_divide(F.sum((F.col("spread") * F.col("spread") + F.col("mean") * F.col("mean")) * F.col("n_num")), F.sum("n_num")).alias("square"),
        F.try_divide(F.sum(F.col("length") * F.col("n")), F.sum("n")).alias("length"))
    of_name = of_name.select("name", "files", F.struct(
        "n", "n_num", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))).alias("spread"), "length").alias("f"))
    side = lambda k: of_name.select(F.col("name").alias(k), F.col("files").alias(f"files_{k}"), f.alias(f"f_{k}"))
    # equal headers count once, so this grows with the variety of schemas
    headers = schemas.select(F.sort_array(F.array_distinct("fields.name")).alias("names")).groupBy("names").agg(F.count(F.lit(1)).alias("n"))
    together = headers.select(F.explode("names").alias("a"), "names", "n").join(both.select("a", "b"), "a").where(
        F.array_contains("names", F.col("b"))).groupBy("a", "b").agg(F.sum("n").alias("n_together"))
    e = (
        both.join(went, "a").join(came, "b").join(side("a"), "a").join(side("b"), "b").join(together, ["a", "b"], "left")
        .select("a", "b", "f_a", "f_b",
                (F.coalesce("n_together", F.lit(0)) / F.least("files_a", "files_b")).alias("together"),
                F.log((F.col("n_both") + 0.5) / (F.col("n_gone") * F.col("n_come") / F.lit(float(max(total, 1))) + 0.5)).alias("lift"))
    )
    return cand.join(e, ["a", "b"]).groupBy("file_id").agg(F.collect_list(F.struct("a", "b", "together", "lift", "f_a", "f_b")).alias("known"))


def schema_changes(lines: DataFrame, schemas: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """(file_id, prev_file_id, feed, kind, season, column_name, old_name, change) between each file and the one
    before it of the same feed and kind in the order (season, file_id)."""
    schemas = cut(file_schemas(lines)) if schemas is None else schemas
    order = previous_files(schemas) if order is None else order
    before = schemas.select(F.col("file_id").alias("prev_file_id"), F.col("fields").alias("prev_fields"))
    names, old = F.col("fields.name"), F.col("prev_fields.name")
    pairs = cut(schemas.join(order, "file_id").join(before, "prev_file_id").select(
        "file_id", "prev_file_id", "feed", "kind", "season", "fields", "prev_fields",
        F.array_except(old, names).alias("gone"), F.array_except(names, old).alias("come")))
    facts = pairs.join(_evidence(schemas, pairs), "file_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                known = r.known if r.known is not None else []
                p = lambda x: _profile(x["n"], x["n_num"], x["mean"], x["spread"], x["length"])
                corpus = {(k["a"], k["b"]): Evidence(k["together"], k["lift"], p(k["f_a"]), p(k["f_b"])) for k in known}
                for change, old, new in edit_script(_nodes(r.prev_fields), _nodes(r.fields), corpus):
                    rows.append((r.file_id, r.prev_file_id, r.feed, r.kind, r.season, new or old, old or None, change))
            yield pd.DataFrame(rows, columns=["file_id", "prev_file_id", "feed", "kind", "season", "column_name", "old_name", "change"])

    return facts.select("file_id", "prev_file_id", "feed", "kind", "season", "fields", "prev_fields", "known").mapInPandas(
        run, "file_id bigint, prev_file_id bigint, feed string, kind string, season int, column_name string, old_name string, change string")


def first_names(schemas: DataFrame, changes: DataFrame, order: DataFrame) -> DataFrame:
    """(file_id, pos, name, first, since): each file's fields with the name under which, and the file in which, the fact began in its stream.

    A stretch is a name's files from the one where it came to the one before it went; a renamed field's stretch leads to
    the stretch of the old name that holds the file before, so a name used again later for another fact is told apart."""
    cols = schemas.select("file_id", "feed", "kind", "season", F.explode("fields").alias("f")).select("file_id", "feed", "kind", "season", "f.pos", "f.name")
    came = changes.where(F.col("change").isin("added", "renamed")).select("file_id", F.col("column_name").alias("name"), F.lit(True).alias("came")).distinct()
    later = order.select("file_id", F.lit(True).alias("later"))
    w = Window.partitionBy("feed", "kind", "name").orderBy("season", "file_id")
    begin = F.when(F.col("later").isNull() | F.col("came").isNotNull(), F.struct("season", "file_id"))
    held = cut(cols.join(came, ["file_id", "name"], "left").join(later, "file_id", "left").withColumn("begin", F.last(begin, ignorenulls=True).over(w)).select(
        "file_id", "pos", "name", F.struct("begin", "name").alias("key")))
    at = held.select(F.col("file_id").alias("prev_file_id"), F.col("name").alias("old_name"), F.col("key").alias("up")).distinct()
    now = held.select("file_id", F.col("name").alias("column_name"), "key").distinct()
    links = changes.where("change = 'renamed'").join(at, ["prev_file_id", "old_name"]).join(now, ["file_id", "column_name"]).select("key", "up")
    root = F.coalesce("root", "key")
    return held.join(roots(links), "key", "left").select("file_id", "pos", "name", root["name"].alias("first"), root["begin"].alias("since"))


def common_names(schemas: DataFrame, changes: DataFrame) -> dict[str, str]:
    """The name of most files of each group of names that renames connect, by name. Renames of many files count first, and two
    names that stand in one file are never brought together. What the driver sees grows with the vocabulary of renamed columns."""
    seen = changes.where("change = 'renamed'").groupBy("old_name", "column_name").agg(F.count(F.lit(1)).alias("n")).collect()
    if not seen:
        return {}
    edges = sorted(((r["n"], r["old_name"], r["column_name"]) for r in seen), key=lambda e: (-e[0], e[1], e[2]))
    names = sorted({x for _, a, b in edges for x in (a, b)})

    def find(up: dict[str, str], x: str) -> str:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    linked = {x: x for x in names}
    for _, a, b in edges:
        linked[find(linked, a)] = find(linked, b)
    # files of every two names that some renames connect; others are never compared, and equal headers count once
    of = schemas.sparkSession.createDataFrame([(x, find(linked, x)) for x in names], "x string, part string")
    sets = schemas.select(F.sort_array(F.array_distinct("fields.name")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    sets = sets.select("s", "n", F.explode("s").alias("x")).join(of, "x").groupBy("s", "part").agg(F.sort_array(F.collect_set("x")).alias("t"), F.first("n").alias("n"))
    pairs = sets.select(F.explode("t").alias("x"), "t", "n").select("x", F.explode("t").alias("y"), "n").groupBy("x", "y").agg(F.sum("n").alias("n"))
    files: dict[str, int] = {}
    apart: dict[str, set[str]] = {x: set() for x in names}
    for r in pairs.toLocalIterator():
        apart[r["x"]].add(r["y"])
        if r["x"] == r["y"]:
            files[r["x"]] = r["n"]
    up, group = {x: x for x in names}, {x: {x} for x in names}
    for _, a, b in edges:
        a, b = find(up, a), find(up, b)
        if len(group[a]) < len(group[b]):
            a, b = b, a
        # a name is in one file with itself; only names of the other group count
        if a != b and apart[a].isdisjoint(group[b]):
            up[b] = a
            group[a] |= group.pop(b)
            apart[a] |= apart.pop(b)
    return {x: max(g, key=lambda y: (files.get(y, 0), y)) for g in group.values() for x in g}


def unified_positions(schemas: DataFrame, changes: DataFrame, order: DataFrame) -> DataFrame:
    """The compiled scripts: (file_id, pos, column) maps each file's every field to a column of the one consistent table, no
    two of a file to the same one."""
    named = first_names(schemas, changes, order)
    common = common_names(schemas, changes)
    to = schemas.sparkSession.createDataFrame(sorted(common.items()), "first string, common string")
    cols = named.join(to, "first", "left").select("file_id", "pos", "name", "since", F.coalesce("common", "first").alias("column"))
    k = lambda *c: F.row_number().over(Window.partitionBy("file_id", *c).orderBy("since", "pos"))
    # of two fields of one column the older fact keeps it; the other goes by its own name, and by a number if that is taken too
    cols = cols.withColumn("column", F.when(k("column") == 1, F.col("column")).otherwise(F.col("name")))
    cols = cols.withColumn("k", k("column"))
    cols = cols.select("file_id", "pos", "since", F.when(F.col("k") == 1, F.col("column")).otherwise(F.concat_ws("_", "column", F.col("k").cast("string"))).alias("column"))
    return cols.select("file_id", "pos", F.when(k("column") == 1, F.col("column")).otherwise(F.concat_ws(" at ", "column", F.col("pos").cast("string"))).alias("column"))


@dataclass
class Unified:
    """The columns of the consistent table with the kind that reads all their values, and where each file has them."""

    columns: dict[str, str]
    positions: DataFrame


def unify(lines: DataFrame) -> Unified:
    """Every column that some file has, from one reading of the lines: tens of names."""
    schemas = cut(file_schemas(lines))
    order = cut(previous_files(schemas))
    positions = cut(unified_positions(schemas, cut(schema_changes(lines, schemas, order)), order))
    fields = schemas.select("file_id", F.explode("fields").alias("f")).select("file_id", "f.pos", "f.reads")
    kinds = positions.join(fields, ["file_id", "pos"]).groupBy("column").agg(F.collect_set("reads").alias("k"))
    has = lambda k: F.array_contains("k", k)
    kind = F.when(has("string") | ~(has("long") | has("double")), "string").when(has("double"), "double").otherwise("long")
    found = {r["column"]: r["kind"] for r in kinds.select("column", kind.alias("kind")).where("column <> ''").orderBy("column").collect()}
    return Unified(found, positions)


def lenient(raw: Column, kind: str) -> Column:
    """A raw value as ``kind`` whatever type its file gave it: ``double`` reads per cent as a share, ``int`` reads whole
    decimals, ``season`` reads also ``2024-25`` (the year it ends), ``id`` gives bare numbers the prefix ``sa`` and ignores case."""
    v = F.trim(raw)
    v = F.when(~F.lower(v).isin(NULL_MARKERS), v)
    number = F.when(v.rlike(r"^[+-]?[0-9.]+%$"), F.rtrim(F.replace(v, F.lit("%"), F.lit(""))).try_cast("double") / 100).otherwise(v.try_cast("double"))
    whole = F.when(number == F.floor(number), number.cast("int"))
    if kind == "double":
        return F.when(~F.isnan(number), number)
    if kind == "int":
        return whole
    if kind == "long":
        return v.try_cast("bigint")
    if kind == "season":
        return F.when(v.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.substring(v, 1, 4).try_cast("int") + 1).otherwise(whole)
    if kind == "id":
        return F.when(v.rlike("^[0-9]+$"), F.concat(F.lit("sa"), v)).otherwise(F.lower(v))
    return v


def unified_table(lines: DataFrame, plan: Unified, columns: list[str], types: dict[str, str]) -> DataFrame:
    """All lines in one consistent table: (file_id, line_no, feed, kind, season) and ``columns``, read by ``types``
    (see ``lenient``; null where a value cannot be read or a file lacks the column)."""
    pos = plan.positions.where(F.col("column").isin(columns)).groupBy("file_id").agg(
        F.map_from_entries(F.collect_list(F.struct("column", "pos"))).alias("at"))
    body = spread(lines.where((F.col("line_no") > 0) & F.col("line").isNotNull())).join(pos, "file_id").select(
        "file_id", "line_no", "feed", "kind", "season", "at", split_line(F.col("line")).alias("v"))

    keys = ["file_id", "line_no", "feed", "kind", "season"]  # a column of such a name gets an underscore

    def pick(name: str):
        return lenient(F.get(F.col("v"), F.try_element_at("at", F.lit(name))), types.get(name, "string")).alias(name + "_" * (name in keys))

    return body.select(*keys, *[pick(c) for c in columns])
