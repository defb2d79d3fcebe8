"""Signals of resources that a file keeps: fields of heavy types against the calls that release them."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.paths import name_tokens
from lodegraph.sources import tokens
from lodegraph.sources.bodies import Bodies, matches

# Tokens of type names by kind, the first kind that matches counts.
TYPE_TOKENS = {
    "engine": "engine renderer player exoplayer filament glsurfaceview",
    "native-model": "model llm litert interpreter tflite onnx tokenizer",
    "bitmap": "bitmap drawable picture image",
    "connection": "connection socket client database datasource dao session",
    "file-read": "filereader bufferedreader inputstream randomaccessfile filechannel",
    "stream": "stream channel cursor reader writer",
    "listener": "listener callback observer subscriber subscription disposable watcher",
    "collection": "list mutablelist arraylist linkedlist map mutablemap hashmap set mutableset hashset array deque queue "
    "vector buffer stringbuilder sparsearray",
}
# Names of calls, and of methods that check.
RELEASE = "close release dispose free shutdown destroy cancel terminate quit unbind detach unregister unsubscribe removelistener"
APPEND = "add addall put putall append push offer enqueue insert addlast"
EVICT = "remove removeat removeall removefirst removelast clear evict delete drop pop poll truncate trimtosize"
READ_ALL = "readbytes readtext readallbytes readstring readlines getbytes readfile slurp"
COPY = "allocatedirect copyof copyofrange copyinto wrap asreadonlybuffer newarray clone"
VALIDATION = "validate validation valid check probe verify isvalid ensure inspect preview canload canrun diagnose health"
LOAD = "initialize init load loadmodel open connect instantiate warmup start prepare getengine"


def names(text: Column, words: str) -> Column:
    """A word is the whole text, its joined tokens, or one of them."""
    listed = F.array(*(F.lit(w) for w in words.split()))
    tokens = name_tokens(text)
    return F.arrays_overlap(F.concat(F.array(F.lower(text), F.array_join(tokens, "")), tokens), listed)


def kind(text: Column) -> Column:
    pairs = list(TYPE_TOKENS.items())
    return reduce(lambda c, p: c.when(names(text, p[1]), p[0]), pairs[1:], F.when(names(text, pairs[0][1]), pairs[0][0]))


def simple_name(text: Column) -> Column:
    """The name of a type without its arguments and qualifiers."""
    return F.regexp_replace(F.element_at(F.split(F.split(text, "<")[0], r"\."), -1), "[^A-Za-z0-9_]", "")


def facts(fields: DataFrame, types: DataFrame, calls: DataFrame) -> DataFrame:
    """file, line, kind, symbol, owner, type, releases of fields that hold a resource.

    fields: file, owner, name, line, type; types: file, name (declared in the file); calls:
    file, line, callee, receiver.  A type that the file declares is judged by its own fields:
    the first heavy one names its kind, and one with none but light fields is no resource.
    """
    inner = fields.withColumn("inner", kind(F.col("type"))).groupBy("file", F.col("owner").alias("wanted")).agg(
        F.min(F.when(F.col("inner").isNotNull(), F.struct("line", "name", "inner")))["inner"].alias("inner"), F.count(F.lit(1)).alias("own")
    )
    local = types.select("file", F.col("name").alias("wanted")).distinct().join(inner, ["file", "wanted"], "left")
    rows = fields.filter(F.trim("type") != "").withColumn("wanted", simple_name(F.col("type"))).join(local, ["file", "wanted"], "left")
    rows = rows.withColumn("kind", F.when(F.col("own") > 0, F.col("inner")).otherwise(kind(F.col("type")))).filter("kind is not null")
    freed = calls.filter(names(F.col("callee"), RELEASE)).groupBy("file", F.col("receiver").alias("name")).agg(
        F.array_sort(F.collect_set("line")).alias("releases")
    )
    return rows.join(freed, ["file", "name"], "left").select(
        "file", "line", "kind", F.col("name").alias("symbol"), "owner", "type", F.coalesce("releases", F.expr("cast(array() as array<bigint>)")).alias("releases")
    )


def signals(found: DataFrame, calls: DataFrame) -> DataFrame:
    """file, line, kind, symbol: what facts() and the calls of a file give rise to.

    calls: file, owner, method, line, at, callee, receiver.  Releases, additions and removals
    count where their receiver is the field, wherever in the file they stand.
    """
    held = found.filter("kind not in ('collection', 'listener')")
    out = [
        held.select("file", "line", F.lit("field-retained-resource").alias("kind"), "symbol"),
        held.filter(F.size("releases") == 0).select("file", "line", F.lit("no-release-path").alias("kind"), "symbol"),
        found.filter((F.col("kind") == "listener") & (F.size("releases") == 0)).select("file", "line", F.lit("listener-without-removal").alias("kind"), "symbol"),
    ]
    grown = calls.filter("receiver is not null").groupBy("file", F.col("receiver").alias("symbol")).agg(
        F.max(names(F.col("callee"), APPEND)).alias("added"), F.max(names(F.col("callee"), EVICT)).alias("removed")
    )
    out.append(
        found.filter("kind = 'collection'").join(grown.filter("added and not removed"), ["file", "symbol"]).select("file", "line", F.lit("unbounded-collection").alias("kind"), "symbol")
    )
    checks = F.arrays_overlap(name_tokens(F.col("method")), F.array(*(F.lit(w) for w in VALIDATION.split())))
    loads = calls.filter(checks & names(F.col("callee"), LOAD)).groupBy("file", "owner", "method").agg(F.min(F.struct("at", "line"))["line"].alias("line"))
    out.append(loads.select("file", "line", F.lit("eager-load-on-validation").alias("kind"), F.col("method").alias("symbol")))
    copies = calls.groupBy("file", "line").agg(
        F.min(F.when(names(F.col("callee"), READ_ALL), F.col("at"))).alias("read"), F.min(F.when(names(F.col("callee"), COPY), F.col("at"))).alias("copied")
    )
    out.append(copies.filter("read <> copied").select("file", "line", F.lit("double-materialisation").alias("kind"), F.lit(None).cast("string").alias("symbol")))
    return reduce(DataFrame.unionByName, out)


# ---------------------------------------------------------------- the same over whole texts

SIGNALS = "file string, line long, kind string, symbol string"


def _name_tokens(text: str) -> list[str]:
    spaced = re.sub("([a-z0-9])([A-Z])", r"\1 \2", re.sub("[^A-Za-z0-9]+", " ", text))
    return spaced.lower().split()


@lru_cache(100_000)
def _named(text: str, words: str) -> bool:
    parts, listed = _name_tokens(text), words.split()
    return any(p in listed for p in (text.lower(), "".join(parts), *parts))


def _kind(text: str) -> str | None:
    return next((k for k, words in TYPE_TOKENS.items() if _named(text, words)), None)


def _simple_name(text: str) -> str:
    return re.sub("[^A-Za-z0-9_]", "", text.split("<")[0].split(".")[-1])


def _kinds(b: Bodies) -> list[tuple[int, str]]:
    """Name row and kind of the fields that hold a resource, as facts() finds them."""
    name, line = b.text, b.s.line
    members: dict = {}
    for owner, row, text in b.fields():
        members.setdefault((int(b.number[row]), owner), []).append((row, text))
    owners = dict(zip(b.type_at.tolist(), name(b.type_at).to_pylist()))
    light: dict = {}
    for (of, owner), rows in members.items():
        heavy = [(line[r].as_py(), name(np.array([r]))[0].as_py(), k) for r, t in rows if (k := _kind(t))]
        # Types of one name in a file are judged together.
        light[of, owners[owner]] = min([*heavy, *([light[of, owners[owner]]] if light.get((of, owners[owner])) else [])], default=None)
    found = []
    for (of, _), rows in members.items():
        for row, text in rows:
            if text.strip(" "):
                wanted = (of, _simple_name(text))
                kind = (light[wanted][2] if light[wanted] else None) if wanted in light else _kind(text)
                if kind:
                    found.append((row, kind))
    return found


def _signals(b: Bodies) -> list[tuple[int, str, int]]:
    """Row, kind and symbol row (or -1) of the signals() of a table of tokens."""
    s, (at, receiver) = b.s, b.calls()
    used, which = np.unique(s.codes[at], return_inverse=True)
    callees = s.words.take(pa.array(used)).to_pylist()
    calls = lambda words: np.array([_named(c, words) for c in callees], bool)[which]
    symbol = b.number * len(s.words) + s.codes

    def held(words):
        kept = calls(words) & (receiver >= 0)
        return set((b.number[at[kept]] * len(s.words) + s.codes[receiver[kept]]).tolist())

    freed, added, removed = held(RELEASE), held(APPEND), held(EVICT)
    found = []
    for row, kind in _kinds(b):
        key = int(symbol[row])
        if kind == "listener":
            if key not in freed:
                found.append((row, "listener-without-removal", row))
        elif kind == "collection":
            if key in added and key not in removed:
                found.append((row, "unbounded-collection", row))
        else:
            found.append((row, "field-retained-resource", row))
            if key not in freed:
                found.append((row, "no-release-path", row))
    # The first call that loads in each method that checks, by names of owner and method.
    loads = at[calls(LOAD)]
    left, of = matches(b.body[loads], b.fn_body)
    checks, first = {}, {}
    for row, i in zip(loads[left].tolist(), of.tolist()):
        if i >= 0:
            method, owner = int(b.fn_at[i]), int(b.fn_owner[i])
            code = int(s.codes[method])
            if code not in checks:
                checks[code] = not set(_name_tokens(s.words[code].as_py())).isdisjoint(VALIDATION.split())
            if checks[code]:
                first.setdefault((int(b.number[row]), code, int(s.codes[owner]) if owner >= 0 else -1), (row, method))
    found += [(row, "eager-load-on-validation", method) for row, method in first.values()]
    # Both kinds of call on one line of a file, not one call of both kinds.
    lines, read, copied = np.asarray(s.line.fill_null(-1)), {}, {}
    for words, seen in ((READ_ALL, read), (COPY, copied)):
        for row in at[calls(words)].tolist():
            seen.setdefault((int(b.number[row]), int(lines[row])), row)
    found += [(row, "double-materialisation", -1) for key, row in read.items() if key in copied and copied[key] != row]
    return found


def _signalled(batches):
    for table in tokens._flattened(batches):
        b = Bodies(table)
        found = _signals(b)
        row, symbol = (np.array([f[i] for f in found], np.int64) for i in (0, 2))
        yield from pa.table({
            "file": tokens._picked(b.files, row), "line": tokens._picked(b.s.line, row), "kind": pa.array([f[1] for f in found], pa.string()), "symbol": b.text(symbol),
        }).to_batches(10_000)


def text_signals(texts: DataFrame) -> DataFrame:
    """signals() of texts (file, language, content), found file by file without a row for each field or call."""
    return tokens.tokenised(texts).mapInArrow(_signalled, SIGNALS)
