"""Schemas that drift between the files of a feed: what changed, and one table for all files."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnwork.session import broadcast_if_small, materialise, stored

#: Costs of the edit script. A rename is cheaper than a removal with an addition, a move dearer than a rename.
RENAME, MOVE, RETYPE, NODE = 0.5, 0.75, 0.25, 1.0
#: Labels that become columns of the one table; what a feed whose field names are data holds beyond them is in `extra`.
MAX_COLUMNS = 2000

Tree = tuple[str, dict[str, "Tree"]]  # JSON type, children; an array has the child ELEMENT
#: The name of the child that stands for all elements of an array; no field can have it.
ELEMENT = "\0[]"


def read_tree(text: str) -> Tree:
    """The tree of a schema as Spark writes it for variants, e.g. OBJECT<a: STRING, b: ARRAY<BIGINT>>. What is
    only ever null has no type and is left out."""
    at = 0

    def node() -> Tree:
        nonlocal at
        word = re.compile(r"[A-Z_]+").match(text, at)
        kind = word.group() if word else "VARIANT"
        at = word.end() if word else at
        if kind == "DECIMAL" and text[at : at + 1] == "(":
            at = text.index(")", at) + 1
        children: dict[str, Tree] = {}
        if kind in ("OBJECT", "ARRAY") and text[at : at + 1] == "<":
            at += 1
            if kind == "ARRAY":
                children[ELEMENT] = node()
            else:
                while text[at] != ">":
                    if text[at] == "`":
                        end = at + 1
                        while text[end] != "`" or text[end + 1 : end + 2] == "`":
                            end += 2 if text[end] == "`" else 1
                        name, at = text[at + 1 : end].replace("``", "`"), end + 1
                    else:
                        end = text.index(":", at)
                        name, at = text[at:end], end
                    at += 2
                    children[name] = node()
                    if text[at : at + 2] == ", ":
                        at += 2
            at += 1
        return json_type(kind), {k: v for k, v in children.items() if v[0] != "null"}

    return node()


def json_type(kind: str) -> str:
    return {"STRING": "string", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array", "VOID": "null", "VARIANT": "mixed", "DATE": "string", "TIMESTAMP": "string"}.get(kind, "number")


def merge_trees(trees: Iterable[Tree]) -> Tree:
    """One tree for the values of several: all their types, and the children that any of them has."""
    trees = list(trees)
    kinds = sorted({k for t in trees for k in t[0].split("+")})
    names = sorted({n for t in trees for n in t[1]})
    return "+".join(kinds), {n: merge_trees(t[1][n] for t in trees if n in t[1]) for n in names}


def assign(cost: Sequence[Sequence[float]] | np.ndarray) -> list[int]:
    """The column of each row at the least sum; there are at least as many columns as rows (shortest augmenting
    paths with potentials)."""
    cost = np.asarray(cost, float)
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of, col_of = np.full(m, -1), np.full(n, -1)
    for start in range(n):
        dist, came = cost[start] - u[start] - v, np.full(m, start)
        open_ = np.ones(m, bool)
        path: list[int] = []
        while True:
            j = int(np.where(open_, dist, np.inf).argmin())
            open_[j] = False
            if row_of[j] < 0:
                break
            path.append(j)
            r = row_of[j]
            via = dist[j] + cost[r] - u[r] - v
            better = open_ & (via < dist)
            dist[better], came[better] = via[better], r
        u[start] += dist[j]
        for k in path:
            u[row_of[k]] += dist[j] - dist[k]
            v[k] += dist[k] - dist[j]
        while True:
            r = came[j]
            row_of[j], col_of[r], j = r, j, col_of[r]
            if r == start:
                break
    return col_of.tolist()


def best_pairs(gain: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """Pairs of names, each used once on its side, with the greatest sum of gains; each connected group of names
    is solved by itself."""
    root: dict[tuple[int, str], tuple[int, str]] = {}

    def find(x: tuple[int, str]) -> tuple[int, str]:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in gain:
        root[find((0, a))] = find((1, b))
    groups: dict[tuple[int, str], list[tuple[str, str]]] = {}
    for p in sorted(gain):
        groups.setdefault(find((0, p[0])), []).append(p)
    out: list[tuple[str, str]] = []
    for pairs in groups.values():
        if len(pairs) == 1:
            out += pairs
            continue
        rows, cols = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
        grid = np.zeros((len(rows), len(cols)))
        place = [{x: i for i, x in enumerate(side)} for side in (rows, cols)]
        for a, b in pairs:
            grid[place[0][a], place[1][b]] = -gain[a, b]
        flip = len(rows) > len(cols)
        for i, j in enumerate(assign(grid.T if flip else grid)):
            if (p := (rows[j], cols[i]) if flip else (rows[i], cols[j])) in gain:
                out.append(p)
    return out


Path = tuple[str, ...]
Step = tuple[str, Path | None, Path | None]


def edit_script(old: Tree, new: Tree, evidence: dict[tuple[str, str], float] | None = None) -> tuple[float, list[Step]]:
    """The cheapest script that turns one unordered schema tree into the other, and its cost.

    Steps are (change, old path, new path), paths as names from the root: `retyped`, `removed` (no new path),
    `added` (no old path), `renamed`, `moved`. The distance is the constrained one in which a matched node has a
    matched parent, and removing or adding takes a whole subtree: unlike the unconstrained distance, whose
    least script is NP-hard to find for unordered trees, it has an exact solution, by an assignment of children at
    each pair of nodes, in which children of one name compete with renames. Then, of what that script removes
    and adds, subtrees of equal name and shape are moves, as many as there can be.

    With `evidence` top-level names stand for themselves: equal names are matched, and a name may become another
    only where `evidence` has the pair, with a strength that decides between equal costs. A name with
    several supported partners is renamed to each of them, while costs and steps below follow one of them.
    """
    ids: dict[tuple, int] = {}
    kind: list[str] = []
    kids: list[dict[str, int]] = []
    size: list[float] = []

    def intern(t: Tree) -> int:
        own = {n: intern(c) for n, c in sorted(t[1].items())}
        key = (t[0], *own.items())
        if key not in ids:
            ids[key] = len(kind)
            kind.append(t[0]), kids.append(own), size.append(NODE + sum(size[c] for c in own.values()))
        return ids[key]

    solved: dict[tuple[int, int], tuple[float, list[tuple[str, str]]]] = {}

    def matching(a: int, b: int) -> tuple[float, list[tuple[str, str]]]:
        """What it costs to turn node a into node b, which are matched, and the pairs of their children."""
        if (found := solved.get((a, b))) is not None:
            return found
        same = [(n, n) for n in kids[a] if kids[b].get(n) == kids[a][n]]  # equal subtrees of a name: nothing is cheaper
        left, right = ({n: c for n, c in kids[x].items() if (n, n) not in set(same)} for x in (a, b))
        gain = {}
        for x, i in left.items():
            for y, j in right.items():
                if (x == ELEMENT) == (y == ELEMENT):
                    g = size[i] + size[j] - (0 if x == y else RENAME) - matching(i, j)[0]
                    if g > 0:
                        gain[x, y] = g + (1e-6 if x == y else 0)
        solved[a, b] = out = priced(a, b, same + best_pairs(gain))
        return out

    def priced(a: int, b: int, pairs: list[tuple[str, str]]) -> tuple[float, list[tuple[str, str]]]:
        cost = (RETYPE if kind[a] != kind[b] else 0) + size[a] + size[b] - 2 * NODE
        for x, y in pairs:
            i, j = kids[a][x], kids[b][y]
            cost += (0 if x == y else RENAME) + (matching(i, j)[0] if i != j else 0) - size[i] - size[j]
        return cost, pairs

    def top(a: int, b: int) -> tuple[float, list[tuple[str, str]]]:
        same = [(n, n) for n in kids[a] if n in kids[b]]
        ok = {(x, y): s for (x, y), s in evidence.items() if x in kids[a] and y in kids[b] and x not in kids[b] and y not in kids[a]}
        worth = {p: 1e9 + size[kids[a][p[0]]] + size[kids[b][p[1]]] - matching(kids[a][p[0]], kids[b][p[1]])[0] + min(s, 1e6) * 1e-7 for p, s in ok.items()}
        return priced(a, b, same + best_pairs(worth))

    raw: list[tuple[str, Path | None, Path | None, int]] = []

    def emit(a: int, b: int, at: Path, to: Path, solution: tuple[float, list[tuple[str, str]]]) -> None:
        if kind[a] != kind[b]:
            raw.append(("retyped", at, to, -1))
        pairs = solution[1]
        for x, y in pairs:
            i, j = kids[a][x], kids[b][y]
            if x != y:
                raw.append(("renamed", (*at, x), (*to, y), -1))
            if i != j:
                emit(i, j, (*at, x), (*to, y), matching(i, j))
        left, right = {x for x, _ in pairs}, {y for _, y in pairs}
        raw.extend(("removed", (*at, x), None, c) for x, c in kids[a].items() if x not in left)
        raw.extend(("added", None, (*to, y), c) for y, c in kids[b].items() if y not in right)

    a, b = intern(old), intern(new)
    solution = matching(a, b) if evidence is None else top(a, b)
    total = solution[0]
    emit(a, b, (), (), solution)

    if evidence:
        own = {(x, y) for x, y in solution[1]}
        more = [p for p in sorted(evidence) if p not in own and p[0] in kids[a] and p[1] in kids[b] and p[0] not in kids[b] and p[1] not in kids[a]]
        gone, come = {(x,) for x, _ in more}, {(y,) for _, y in more}
        raw = [s for s in raw if not (s[0] == "removed" and s[1] in gone or s[0] == "added" and s[2] in come)]
        raw += [("renamed", (x,), (y,), -1) for x, y in more]
    waiting: dict[tuple[str, int], list[Path]] = {}
    for change, _, to, shape in raw:
        if change == "added":
            waiting.setdefault((to[-1], shape), []).append(to)
    steps: list[Step] = []
    moved: set[Path] = set()
    for change, at, _, shape in raw:
        if change == "removed" and at[-1] != ELEMENT and (there := waiting.get((at[-1], shape))):
            to = there.pop(0)
            moved |= {(0, *at), (1, *to)}
            total += MOVE - 2 * size[shape]
            steps.append(("moved", at, to))
    steps += [(c, at, to) for c, at, to, _ in raw if not (c == "removed" and (0, *at) in moved or c == "added" and (1, *to) in moved)]
    return total, sorted(steps, key=repr)


def shown(path: Path) -> str:
    """A path as text. Only the list of its names tells a name with a dot from two names."""
    return ".".join("[]" if x == ELEMENT else x for x in path) or "$"


def fields_of(df: DataFrame, payload: str, donor: str | None = None) -> DataFrame:
    """`df` without `payload`, with `field` and `value` (variant) for each top-level field of the JSON object in
    `payload` whose value is not null, and `_name`, the text of the field `donor`. Payloads that are no JSON
    object, or repeat a field, give no row."""
    whole = F.when(F.col(payload).rlike(r"(?s)^\s*\{.*\}\s*$"), F.try_parse_json(F.col(payload)))
    rest = [c for c in df.columns if c != payload]
    parsed = df.select(*rest, F.try_variant_get(whole, "$", "map<string,variant>").alias("_m"))
    name = [] if donor is None else [F.try_variant_get(F.try_element_at("_m", F.lit(donor)), "$", "string").alias("_name")]
    return parsed.select(*rest, *name, F.explode("_m").alias("field", "value")).where("value is not null and not is_variant_null(value)")


_STEPS = T.ArrayType(T.StructType([T.StructField("change", T.StringType()), T.StructField("path", T.StringType()), T.StructField("old_path", T.ArrayType(T.StringType())), T.StructField("new_path", T.ArrayType(T.StringType()))]))


@F.pandas_udf(_STEPS)
def _scripts(sides: pd.Series, evidence: pd.Series) -> pd.Series:
    read: dict[str, Tree] = {}

    def one(rows, pairs):  # noqa: ANN001, ANN202
        trees: tuple[dict[str, list[Tree]], ...] = ({}, {})
        for r in rows:
            if (s := r["schema"]) not in read:
                read[s] = read_tree(s)
            trees[r["side"]].setdefault(r["field"], []).append(read[s])
        old, new = (("object", {n: merge_trees(t) for n, t in side.items()}) for side in trees)
        found = {(p["old"], p["new"]): float(p["n"]) for p in (pairs if pairs is not None else ())}
        out = []
        for change, at, to in edit_script(old, new, found)[1]:
            path = f"{shown(at)}>{shown(to)}" if change in ("renamed", "moved") else shown(at if to is None else to)
            plain = [None if p is None else ["[]" if x == ELEMENT else x for x in p] for p in (at, to)]
            out.append({"change": change, "path": path, "old_path": plain[0], "new_path": plain[1]})
        return out

    return pd.Series([one(a, b) for a, b in zip(sides, evidence)])


def schema_changes(df: DataFrame, feed: str, file: str, donor: str, payload: str) -> DataFrame:
    """Each change of a file against its feed's previous file: `feed`, `file`, `change`, `path` (text), `old_path`
    and `new_path` (lists of names, null where there is none).

    Changes come from the cheapest edit script between the two schema trees (see edit_script). A top-level
    field that is gone may be renamed to one that has come only when every record name (`donor`, a field of the
    object) with a value in both has an equal JSON value there, and at least one has. A record name given twice
    in a file, with several values in a field, agrees when the least and the greatest hashes of them do. Null
    feeds or files are left out; rows that repeat change nothing; an empty table has no changes.

    Payloads are parsed once: a row for each field with its schema and two 64-bit hashes of its value. Schemas are
    folded to (file, field) before any comparison; hashes are looked up only for fields that came or went,
    in joins keyed by (feed, file, record name), so that even a feed with a third of all rows is spread
    over its files and records. Only pairs with an equal value in some record are candidates of a rename; they are
    then held against all records. A task holds the schemas of single files.
    """
    # No name of the input can clash with these.
    base = df.select(F.col(feed).alias("_feed"), F.col(file).alias("_file"), F.col(payload).alias("_payload")).where("_feed is not null and _file is not null")
    key = ["_feed", "_file"]
    text = F.to_json("value")
    values = stored(fields_of(base, "_payload", donor).select(*key, "_name", "field", F.schema_of_variant("value").alias("schema"), F.xxhash64(text).alias("_h"), F.xxhash64(text, F.lit(1)).alias("_i")))
    order = W.partitionBy("_feed").orderBy("_file")
    files = materialise(base.select(*key).distinct().select(*key, F.lag("_file").over(order).alias("_prev"), F.lead("_file").over(order).alias("_next")))

    # Every schema is the new side of its file and the old side of the next one.
    schemas = values.select(*key, "field", "schema").distinct().join(files, key)
    sided = schemas.select("_feed", "field", "schema", F.explode(F.array(F.struct(F.when(F.col("_prev").isNotNull(), F.col("_file")).alias("t"), F.lit(1).alias("side")), F.struct(F.col("_next").alias("t"), F.lit(0).alias("side")))).alias("_s")).where("_s.t is not null")
    grouped = sided.groupBy("_feed", F.col("_s.t").alias("_file")).agg(F.collect_list(F.struct("field", F.col("_s.side").alias("side"), "schema")).alias("_sides"))
    names = lambda side: F.transform(F.filter("_sides", lambda r: r["side"] == side), lambda r: r["field"])
    pair = lambda side: F.transform(F.filter("_sides", lambda r: r["side"] == side), lambda r: F.struct(r["field"], r["schema"]))
    grouped = materialise(grouped.where(F.size(F.array_except(pair(0), pair(1))) + F.size(F.array_except(pair(1), pair(0))) > 0).select(*key, "_sides", F.array_except(names(0), names(1)).alias("_gone"), F.array_except(names(1), names(0)).alias("_come")))

    # The roles of a stored file: what goes after it, and what has come with it.
    both = grouped.where("size(_gone) > 0 and size(_come) > 0").join(files.select(*key, "_prev"), key)
    roles = both.select("_feed", F.explode(F.array(F.struct(F.col("_prev").alias("at"), F.lit(True).alias("gone"), F.col("_gone").alias("names")), F.struct(F.col("_file").alias("at"), F.lit(False).alias("gone"), F.col("_come").alias("names")))).alias("_r"), F.col("_file").alias("_target"))
    roles = materialise(roles.select("_feed", F.col("_r.at").alias("_file"), "_target", F.col("_r.gone").alias("_gone"), F.explode("_r.names").alias("field")))
    held = values.where("_name is not null").join(broadcast_if_small(roles), [*key, "field"])
    held = held.groupBy("_feed", "_target", "_name", "_gone", "field").agg(*(f(c).alias(f"{n}{c}") for c in ("_h", "_i") for n, f in (("lo", F.min), ("hi", F.max))))
    value = F.struct("field", F.struct("lo_h", "hi_h", "lo_i", "hi_i").alias("v"))
    per_name = held.groupBy("_feed", "_target", "_name").agg(F.collect_list(F.when(F.col("_gone"), value)).alias("_old"), F.collect_list(F.when(~F.col("_gone"), value)).alias("_new"))
    per_name = stored(per_name.where("size(_old) > 0 and size(_new) > 0"))
    target = ["_feed", "_target"]
    equal = F.flatten(F.transform("_old", lambda a: F.transform(F.filter("_new", lambda b: a["v"] == b["v"]), lambda b: F.struct(a["field"].alias("old"), b["field"].alias("new")))))
    pairs = per_name.select(*target, F.explode(equal).alias("_p")).groupBy(*target, "_p").agg(F.count("*").alias("n"))
    pairs = materialise(pairs.groupBy(*target).agg(F.collect_list(F.struct(F.col("_p.old").alias("old"), F.col("_p.new").alias("new"), "n")).alias("_pairs")))
    # A pair falls where some record has both fields with other values.
    kept = lambda c, p, end: F.filter(c, lambda x: x["field"] == p[end])
    against = F.filter("_pairs", lambda p: F.exists(kept("_old", p, "old"), lambda a: F.exists(kept("_new", p, "new"), lambda b: a["v"] != b["v"])))
    fallen = per_name.join(broadcast_if_small(pairs), target).select(*target, F.explode(against).alias("_p")).distinct().groupBy(*target).agg(F.collect_list("_p").alias("_fallen"))
    evidence = pairs.join(fallen, target, "left").select("_feed", F.col("_target").alias("_file"), F.when(F.col("_fallen").isNull(), F.col("_pairs")).otherwise(F.array_except("_pairs", "_fallen")).alias("_pairs"))

    steps = grouped.join(evidence, key, "left").select(*key, F.explode(_scripts("_sides", "_pairs")).alias("_s"))
    return steps.select(F.col("_feed").alias(feed), F.col("_file").alias(file), *(F.col(f"_s.{c}").alias(c) for c in ("change", "path", "old_path", "new_path")))


def top_level_changes(changes: DataFrame) -> DataFrame:
    """`field` and `change` (renamed, removed, added, retyped) of the top-level fields in edit scripts, beside the
    other columns. A move with an end at the top takes that end's field away or brings it."""
    at_top = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) == 1
    old, new = F.get("old_path", F.lit(0)), F.get("new_path", F.lit(0))
    row = lambda ok, field, change: F.when(ok, F.struct(field.alias("field"), F.lit(change).alias("change")))
    is_ = lambda *c: F.col("change").isin(*c)
    found = F.array_compact(F.array(
        row(is_("renamed") & at_top("old_path") & at_top("new_path"), F.concat(old, F.lit(">"), new), "renamed"),
        row(is_("removed", "moved") & at_top("old_path"), old, "removed"),
        row(is_("added", "moved") & at_top("new_path"), new, "added"),
        row(is_("retyped") & at_top("old_path") & at_top("new_path") & (old == new), new, "retyped"),
    ))
    rest = [c for c in changes.columns if c not in ("change", "field")]
    return changes.select(*rest, F.explode(found).alias("_f")).select(*rest, "_f.field", "_f.change")


def column_labels(fields: DataFrame, changes: DataFrame, feed: str, file: str) -> DataFrame:
    """`feed`, `file`, `field`, `label`: the column in which a file's field stands, where it is not the field's own
    name. A field takes the last name that the edit scripts of its own feed lead to from that file on; names
    of other feeds have no say. Where that gives several fields of a file one label, the field of that name has
    it, else the least; the others get a null label.

    `fields` holds feed, file and field of all fields present. Renames are followed by pointer doubling, in as many
    rounds as the logarithm of the longest chain.
    """
    top = changes.where(F.col("change").isin("renamed", "added", "removed", "moved")).select(F.col(feed).alias("_feed"), F.col(file).alias("_file"), "change", "old_path", "new_path")
    one = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    renamed = top.where("change = 'renamed' and size(old_path) = 1 and size(new_path) = 1").groupBy("_feed", "_file", one("old_path").alias("old")).agg(F.min(one("new_path")).alias("new"))
    renamed = materialise(renamed.groupBy("_feed", "_file", "new").agg(F.min("old").alias("old")))
    come = renamed.select("_feed", "_file", F.col("new").alias("field")).union(top.where("change <> 'renamed' and size(new_path) = 1").select("_feed", "_file", one("new_path")))
    # Runs: a name of a feed from the file in which it came (null: the first) to the file that renames it.
    ends = renamed.select("_feed", "_file", F.col("old").alias("field"), "new")
    marks = come.withColumn("_come", F.lit(True)).unionByName(ends, allowMissingColumns=True)
    line = W.partitionBy("_feed", "field").orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    runs = marks.withColumn("_from", F.last(F.when(F.col("_come"), F.col("_file")), ignorenulls=True).over(line)).where("new is not null")
    state = materialise(runs.select("_feed", "field", "_from", F.col("new").alias("label"), F.col("_file").alias("_at")))
    while True:  # (label, _at) is the run that follows; where there is one, jump to where it leads
        ahead = state.select("_feed", F.col("field").alias("label"), F.col("_from").alias("_at"), F.col("label").alias("_l2"), F.col("_at").alias("_a2"))
        further = materialise(state.join(ahead, ["_feed", "label", "_at"]).select("_feed", "field", "_from", F.col("_l2").alias("label"), F.col("_a2").alias("_at")))
        if further.isEmpty():
            break
        rest = state.join(further.select("_feed", "field", F.col("_from").alias("_f")), (state["_feed"] == further["_feed"]) & (state["field"] == further["field"]) & state["_from"].eqNullSafe(F.col("_f")), "left_anti")
        state = materialise(rest.unionByName(further))
    # The run of a field in a file is the one that began last; each present field looks its own up.
    present = fields.select(F.col(feed).alias("_feed"), F.col(file).alias("_file"), "field").distinct()
    marked = present.join(come.distinct().withColumn("_come", F.lit(True)), ["_feed", "_file", "field"], "left")
    upto = W.partitionBy("_feed", "field").orderBy("_file").rowsBetween(W.unboundedPreceding, W.currentRow)
    dated = marked.withColumn("_from", F.last(F.when(F.col("_come"), F.col("_file")), ignorenulls=True).over(upto)).alias("d")
    s = state.alias("s")
    labelled = dated.join(s, (F.col("d._feed") == F.col("s._feed")) & (F.col("d.field") == F.col("s.field")) & F.col("d._from").eqNullSafe(F.col("s._from")), "left")
    labelled = labelled.select("d._feed", "d._file", "d.field", F.coalesce("s.label", "d.field").alias("label"))
    rank = F.row_number().over(W.partitionBy("_feed", "_file", "label").orderBy(F.col("field") != F.col("label"), "field"))
    chosen = labelled.withColumn("_n", rank).where("field <> label or _n > 1")
    return chosen.select(F.col("_feed").alias(feed), F.col("_file").alias(file), "field", F.when(F.col("_n") == 1, F.col("label")).alias("label"))


def unified_table(df: DataFrame, changes: DataFrame, feed: str, file: str, payload: str, keep: Sequence[str], max_columns: int = MAX_COLUMNS) -> DataFrame:
    """All records in one table: `keep`, one text column for each label (renamed fields in one column), and `extra`
    (a map of values that have no column of their own). Strings stand as they are, other values as JSON, so a
    field keeps its column whatever type it has in a file. Unreadable payloads give no row.

    The edit scripts are compiled into a projection of each file (see column_labels), which is applied to that
    file's records alone. Labels beyond the `max_columns` that most records have are in `extra`, under the label.
    Only labels, never records, come to the driver.
    """
    keep = list(keep)
    where = [F.col(feed).alias("_feed"), F.col(file).alias("_file")]
    whole = F.when(F.col(payload).rlike(r"(?s)^\s*\{.*\}\s*$"), F.try_parse_json(F.col(payload)))
    parsed = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)), *where, F.try_variant_get(whole, "$", "map<string,variant>").alias("_v")).where("_v is not null")
    text = lambda _, v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(~F.is_variant_null(v), F.to_json(v))
    texts = stored(parsed.select(*(c for c in parsed.columns if c != "_v"), F.map_filter(F.transform_values("_v", text), lambda _, x: x.isNotNull()).alias("_m")))
    uses = materialise(texts.select("_feed", "_file", F.explode(F.map_keys("_m")).alias("field")).groupBy("_feed", "_file", "field").agg(F.count("*").alias("n")))
    moved = changes.select(F.col(feed).alias("_feed"), F.col(file).alias("_file"), "change", "old_path", "new_path")
    labels = materialise(column_labels(uses.where("_feed is not null and _file is not null"), moved, "_feed", "_file"))
    named = uses.join(labels.withColumn("_l", F.lit(True)), ["_feed", "_file", "field"], "left").select(F.when(F.col("_l"), F.col("label")).otherwise(F.col("field")).alias("label"), "n").where("label is not null")
    columns = sorted(r["label"] for r in named.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(max_columns).collect())
    own = labels.groupBy("_feed", "_file").agg(F.map_from_entries(F.collect_list(F.struct("field", F.coalesce("label", F.lit(""))))).alias("_to"))
    joined = texts.join(broadcast_if_small(materialise(own)), ["_feed", "_file"], "left")
    # One entry for each value: its label (empty: none), its own name, and the text.
    entries = F.transform(F.map_entries("_m"), lambda e: F.struct(F.coalesce(F.try_element_at("_to", e["key"]), e["key"]).alias("l"), e["key"].alias("k"), e["value"].alias("v")))
    whole_row = joined.withColumn("_e", entries)
    labelled = F.map_from_entries(F.transform(F.filter("_e", lambda e: e["l"] != ""), lambda e: F.struct(e["l"], e["v"])))
    whole_row = whole_row.withColumn("_c", labelled)
    lost = F.map_from_entries(F.transform(F.filter("_e", lambda e: e["l"] == ""), lambda e: F.struct(e["k"], e["v"])))
    shown_as, taken = [], {k.lower() for k in keep} | {"extra"}
    for c in columns:
        label = c
        while label.lower() in taken:
            label += "_"
        taken.add(label.lower())
        shown_as.append(F.try_element_at("_c", F.lit(c)).alias(label))
    known = F.array(*(F.lit(c) for c in columns)) if columns else F.array().cast("array<string>")
    rare = F.map_filter("_c", lambda k, _: ~F.array_contains(known, k))
    extra = F.map_concat(rare, F.map_filter(lost, lambda k, _: ~F.map_contains_key(rare, k)))
    return whole_row.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)), *shown_as, extra.alias("extra"))
