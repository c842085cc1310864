"""Several values packed in one text field: one row for each value, with its position."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnwork.session import BROADCAST_BYTES, materialise

#: Words that stand for no value, and words that join two values, in any case, where a caller names no others.
NOTHING = ("n/a", "none", "null", "nil", "nan", "na", "tbd", "unknown", "nothing", "empty", "keine", "ninguno")
JOINING = ("and", "und", "et", "y", "or", "oder")
#: Characters of which values are made. In paths a slash is one of them.
_LETTER = r"\p{L}\p{M}\p{N}_.@#~%$=:\-"
#: Masks in a skeleton. Every other character of a skeleton stands for itself.
ORDINARY, NOWORD, JOINWORD, DASH, SLASH = "a", "\x01", "\x02", "\x03", "\x04"
_QUOTES, _OPEN = "\"'`", {"[": "]", "{": "}", "(": ")"}
_MARKS = DASH + "*•–—·‣▪"
#: How a value's text is turned into the value: as it is, JSON escapes, doubled quotes, the same two in single quotes.
AS_IS, ESCAPED, DOUBLED, ESCAPED_SINGLE, DOUBLED_SINGLE = range(5)
HEAVY_SKELETONS = 2000


def _patterns(path: bool, nothing: Sequence[str], joining: Sequence[str]) -> tuple[str, list[tuple[str, str]]]:
    letter = f"[{_LETTER}{'/' if path else ''}]"
    alone = lambda x: f"(?<!{letter})(?:{x})(?!{letter})"
    words = alone("(?i:" + "|".join(map(re.escape, nothing)) + ")")
    joins = alone("(?i:" + "|".join(map(re.escape, joining)) + ")")
    dash = alone("-+")
    masks = [(words, NOWORD), (joins, JOINWORD), (dash, DASH), *([(alone("/"), SLASH)] if path else []), (f"{letter}+", ORDINARY)]
    return f"(?s){words}|{joins}|{dash}|{letter}+|.", masks


def pieces(text: Column, path: bool, nothing: Sequence[str] = NOTHING, joining: Sequence[str] = JOINING) -> Column:
    """The text cut into runs of ordinary characters and single other characters."""
    return F.regexp_extract_all(text, F.lit(_patterns(path, nothing, joining)[0]), F.lit(0))


def skeleton(text: Column, path: bool, nothing: Sequence[str] = NOTHING, joining: Sequence[str] = JOINING) -> Column:
    """The text with every piece masked by one character; its n-th character is the n-th piece."""
    for pattern, mask in _patterns(path, nothing, joining)[1]:
        text = F.regexp_replace(text, pattern, mask)
    return text


def resolve(skeleton: str, path: bool) -> list[tuple[int, int, int]]:
    """Where the values of a skeleton lie: (first piece, number of pieces, how to unescape)."""
    s, i, n = skeleton, 0, len(skeleton)

    def trim(i: int, n: int) -> tuple[int, int]:
        while i < n and s[i].isspace():
            i += 1
        while n > i and s[n - 1].isspace():
            n -= 1
        return i, n

    def wraps(i: int, n: int) -> bool:
        """Whether the bracket at i closes at n - 1 and not before."""
        depth, quote, start = 0, "", True
        k = i
        while k < n:
            c = s[k]
            if quote:
                if c == "\\":
                    k += 1
                elif c == quote and closes(k, n, quote):
                    quote = ""
            elif c in _QUOTES and start:
                quote = c
            elif c in _OPEN:
                depth += 1
            elif c in _OPEN.values():
                depth -= 1
                if not depth:
                    return k == n - 1
            start = c.isspace() or c in ",;|[{(" or (start and c in _MARKS)
            k += 1
        return False

    def closes(k: int, n: int, quote: str) -> bool:
        """Whether the quote at k ends a value: what follows is the end, a separator or a bracket's end."""
        return k + 1 >= n or s[k + 1].isspace() or s[k + 1] in ",;|]})" or (s[k + 1] in "/+&" and not path)

    i, n = trim(i, n)
    escapes = False
    while n - i >= 2 and s[i] in _OPEN and s[n - 1] == _OPEN[s[i]] and wraps(i, n):
        escapes = True
        i, n = trim(i + 1, n - 1)

    found: list[tuple[int, int, int]] = []
    while i < n:
        c = s[i]
        if c.isspace() or c in ",;|":
            i += 1
            continue
        lone = (i + 1 >= n or s[i + 1].isspace()) and (i == 0 or s[i - 1].isspace() or s[i - 1] in ",;|")
        if (c in "/+&" and (lone or not path)) or (c in JOINWORD + SLASH and lone) or (c in _MARKS and lone):
            i += 1
            continue
        if c in _QUOTES:
            k, doubled, escaped = i + 1, False, False
            while k < n:
                if escapes and s[k] == "\\" and k + 1 < n:
                    escaped = True
                    k += 2
                    continue
                if s[k] == c:
                    if not escaped and k + 1 < n and s[k + 1] == c and not (k == i + 1 and closes(k, n, c)):
                        doubled = True
                        k += 2
                        continue
                    if closes(k, n, c):
                        break
                k += 1
            if k < n:
                inner = s[i + 1 : k]
                if inner.strip() and inner != NOWORD and inner != DASH and inner != "?":
                    how = (ESCAPED_SINGLE if c == "'" else ESCAPED) if escaped else (DOUBLED_SINGLE if c == "'" else DOUBLED) if doubled else AS_IS
                    found.append((i + 1, k - i - 1, how))
                i = k + 1
                continue
        k = i + 1
        while k < n and not (s[k].isspace() or s[k] in ",;|" or (s[k] in "/+&" and not path)):
            k += 1
        if s[i:k] not in (NOWORD, DASH, "?", "??", "???", "[]", "{}", "()"):
            found.append((i, k - i, AS_IS))
        i = k
    return found


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in "slm"])))
def _resolve(skeletons: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([[{"s": a, "l": b, "m": c} for a, b, c in resolve(s, p)] for s, p in zip(skeletons, path)])


def unpack_values(df: DataFrame, text: str, path: str, keep: Sequence[str], rules_from: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES, nothing: Sequence[str] = NOTHING, joining: Sequence[str] = JOINING) -> DataFrame:
    """One row for each value packed in `text`: `keep`, `item_pos` (from 1) and `item`.

    `path` (boolean column) tells texts whose values are paths, in which a slash belongs to the value.
    Null, blank and "nothing" texts give no row, nor do empty slots; repeated values are repeated. Values
    are whole whatever their length. `rules_from` may name a cheaper frame with the same two columns that
    holds every text of `df` (more is harmless), from which skeletons are gathered.

    Texts are reduced to delimiter skeletons; a splitting rule is resolved once for each distinct
    skeleton; the rules are broadcast when their measured size allows, otherwise the heaviest skeletons'
    rules are broadcast (there are at most HEAVY_SKELETONS, none with more than its share of the bytes) and the others
    joined by shuffle; then values are extracted by piece positions, all inside the JVM. `nothing` and `joining` are
    the words for no value and the words that join two.
    """
    source = (rules_from if rules_from is not None else df).select(F.col(text).alias("_t"), F.col(path).alias("_path"))
    words = (tuple(nothing), tuple(joining))
    shape = lambda t, p: F.when(p, skeleton(t, True, *words)).otherwise(skeleton(t, False, *words))
    counted = source.where("_t is not null").select(shape(F.col("_t"), F.col("_path")).alias("_k"), "_path").groupBy("_k", "_path").agg(F.count("*").alias("_n"))
    rules = materialise(counted.withColumn("_rule", _resolve("_k", "_path")))
    size = rules.agg(F.coalesce(F.sum(F.octet_length("_k") + 64 + 24 * F.size("_rule")), F.lit(0)).alias("b"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()

    texts = df.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_t"), F.col(path).alias("_path")).withColumn("_k", shape(F.col("_t"), F.col("_path")))
    plain = rules.select("_k", "_path", "_rule")
    if size["b"] <= broadcast_bytes:
        ruled = texts.join(F.broadcast(plain), ["_k", "_path"])
    else:
        is_heavy = (F.col("_n") > size["n"] / HEAVY_SKELETONS) & (F.octet_length("_k") + 64 + 24 * F.size("_rule") <= broadcast_bytes / HEAVY_SKELETONS)
        heavy = F.broadcast(rules.where(is_heavy).select("_k", "_path", "_rule"))
        rest = texts.join(heavy.select("_k", "_path"), ["_k", "_path"], "left_anti").join(rules.where(~is_heavy).select("_k", "_path", "_rule"), ["_k", "_path"])
        ruled = texts.join(heavy, ["_k", "_path"]).unionByName(rest)
    cut = ruled.where(F.size("_rule") > 0).withColumn("_pieces", F.when(F.col("_path"), pieces(F.col("_t"), True, *words)).otherwise(pieces(F.col("_t"), False, *words)))
    values = cut.select(*keep, F.posexplode(F.transform("_rule", lambda r: F.struct(F.array_join(F.slice("_pieces", r["s"] + 1, r["l"]), "").alias("v"), r["m"].alias("m")))).alias("_at", "_v"))
    v, how = F.col("_v.v"), F.col("_v.m")
    json = lambda x: F.coalesce(F.from_json(F.concat(F.lit('["'), x, F.lit('"]')), "array<string>")[0], x)
    single = F.regexp_replace(F.replace(v, F.lit("\\'"), F.lit("'")), r'(?<!\\)"', '\\\\"')
    item = F.when(how == AS_IS, v).when(how == DOUBLED, F.replace(v, F.lit('""'), F.lit('"'))).when(how == DOUBLED_SINGLE, F.replace(v, F.lit("''"), F.lit("'"))).when(how == ESCAPED, json(v)).otherwise(json(single))
    return values.select(*keep, (F.col("_at") + 1).alias("item_pos"), item.alias("item"))
